"""Differences between versions of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change): items added, removed or changed in a field; of items that share a key the first (by pos) counts."""
    first = lambda f: f.groupBy(*keys).agg(F.min_by(F.struct(*fields), "pos").alias("x"))
    a, b = first(old).withColumnsRenamed({k: f"a_{k}" for k in keys} | {"x": "a"}), first(new).withColumnsRenamed({k: f"b_{k}" for k in keys} | {"x": "b"})
    on = None
    for k in keys:
        same = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = same if on is None else on & same
    both = a.join(b, on, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*[F.when(F.col("b").isNotNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys], change.alias("change"), "a", "b").filter("change is not null")


def field_changes(changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, before, after): the fields that differ in changed items, as text."""
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), text("a", f).alias("before"), text("b", f).alias("after"), F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).alias("same")) for f in fields])
    rows = changes.filter("change = 'changed'").select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return rows.filter(~F.col("same")).drop("same")


def summary(changes: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): like '+2, -1, 3 changed'."""
    counts = changes.groupBy(*by).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    part = lambda c, before, after: F.when(F.col(c) > 0, F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after)))
    return counts.select(*by, F.concat_ws(", ", part("added", "+", ""), part("removed", "-", ""), part("changed", "", " changed")).alias("text"))


def string_lists(rows: DataFrame, old: str, new: str) -> DataFrame:
    """``rows`` with what was added to and removed from a list of texts, and whether it was only put in another order."""
    added, removed = F.array_except(new, old), F.array_except(old, new)
    return rows.withColumns({"added": added, "removed": removed, "reordered": (F.size(added) == 0) & (F.size(removed) == 0) & (F.col(old) != F.col(new))})


def keyless(old: DataFrame, new: DataFrame, group: list[str], body: str) -> DataFrame:
    """(group, n, change, before, after): items without a key, as multisets; what went and what came is paired in order."""
    count = lambda f, n: f.groupBy(*group, body).agg(F.count("*").alias(n))
    both = count(old, "a").join(count(new, "b"), [*group, body], "full_outer").select(*group, body, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d"))
    order = Window.partitionBy(*group).orderBy(body, "_i")
    side = lambda sign, name: both.filter(F.col("d") * sign > 0).select(*group, body, F.explode(F.sequence(F.lit(1), F.abs("d").cast("int"))).alias("_i")).withColumn("n", F.row_number().over(order)).select(*group, "n", F.col(body).alias(name))
    pairs = side(1, "before").join(side(-1, "after"), [*group, "n"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return pairs.select(*group, "n", change.alias("change"), "before", "after")


def scalars(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, change): scalar fields of records that were added, removed or changed."""
    both = old.select(*keys, F.struct(*fields).alias("a")).join(new.select(*keys, F.struct(*fields).alias("b")), keys)
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), text("a", f).alias("before"), text("b", f).alias("after")) for f in fields])
    rows = both.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").filter("before <> after")
    return rows.select(*keys, "field", F.when(F.col("before") == "", "added").when(F.col("after") == "", "removed").otherwise("changed").alias("change"))


def new_items(old: DataFrame, new: DataFrame, group: list[str], body: str) -> DataFrame:
    """Items of the new list that the old one hasn't (what a person edited)."""
    return new.join(old.select(*group, body).distinct(), [*group, body], "left_anti")


def changed_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(research_id, sections): names of the sections whose body differs or that came or went, sorted."""
    both = old.select("research_id", "section", F.col("body").alias("a")).join(new.select("research_id", "section", F.col("body").alias("b")), ["research_id", "section"], "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("research_id").agg(F.array_sort(F.collect_list("section")).alias("sections"))


def same_but(rows: DataFrame, old: str, new: str, ignored: list[str]) -> DataFrame:
    """``rows`` with ``changed``: whether two structs differ in other fields than the ignored ones."""
    return rows.withColumn("changed", ~F.col(old).dropFields(*ignored).eqNullSafe(F.col(new).dropFields(*ignored)))
