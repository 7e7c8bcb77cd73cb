"""Connected components of a link table, for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Labels that are broadcast, and written by ``PARTS`` tasks, at most: rounds over a small graph don't pay for all shuffle partitions.
FEW, PARTS = 100_000, 8


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, comp`` for every id in a link; comp is the least id reachable.

    Each round takes the least label among neighbours and then the label of that label, so a path of n links takes about
    log n rounds; every round is written to the shared folder, which ends its lineage.
    """
    both = written(links.select(F.col(a).alias("id"), F.col(b).alias("near")).unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("near"))).distinct(), "links")
    labels = written(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("comp")), "labels")
    few = labels.count() <= FEW
    small = F.broadcast if few else lambda df: df
    while True:
        heard = both.join(small(labels.select(F.col("id").alias("near"), F.col("comp").alias("told"))), "near").groupBy("id").agg(F.min("told").alias("told"))
        if few:
            heard = heard.coalesce(PARTS)
        least = heard.join(small(labels), "id").select("id", "comp", F.least("comp", "told").alias("next"))
        jump = small(labels.select(F.col("id").alias("next"), F.col("comp").alias("far")))
        moved = written(least.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("comp"), (F.least("next", F.coalesce("far", "next")) < F.col("comp")).alias("changed")), "labels")
        labels = moved.select("id", "comp")
        if moved.filter("changed").isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``labels`` (id, comp) of some links with further ones: only the components that these join are labelled anew."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("comp").alias(f"of_{end}"))
    ends = links.join(of(a), a, "left").join(of(b), b, "left").select(F.coalesce(f"of_{a}", a).alias("one"), F.coalesce(f"of_{b}", b).alias("two"))
    ends = written(ends.filter("one <> two").distinct(), "joined")
    if ends.isEmpty():
        return labels
    moved = components(ends, "one", "two")
    # A component's own id is in the labels; ids without links so far aren't.
    known = labels.unionByName(moved.select("id", F.col("id").alias("comp"))).distinct()
    return written(beside(known, moved.select(F.col("id").alias("comp"), F.col("comp").alias("least")), "comp").select("id", F.coalesce("least", "comp").alias("comp")), "labels")


def beside(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``labels`` have for ``key``; few labels are broadcast, as one key may have most of the rows."""
    return rows.join(F.broadcast(labels) if labels.count() <= FEW else labels, key, "left")
