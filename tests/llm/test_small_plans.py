"""Follow-up work grows with what is still open, and plans don't do the same work twice."""

import numpy as np
import pytest

from threatweave.llm import graph, kneser_ney, minhash
from threatweave.llm.common import table

SF = "/root/testdata/sf0.001"


def test_families_link_components(spark, monkeypatch):
    """A large component of near copies in many open buckets gives one link for each outsider, and not one for each of its sets."""
    rng = np.random.default_rng(3)
    rows = []
    for bucket in range(40):
        own = sorted(rng.choice(np.arange(100, 400), 200, replace=False).tolist())
        rows += [(bucket, (i, i), (50, 50)) for i in own] + [(bucket, (900 + bucket % 3, 0), (900 + bucket % 3, 0))]
    rows += [(99, (1000, 0), (1000, 0)), (99, (1001, 0), (1001, 0))]
    kind = "struct<doc_id:bigint,mark:bigint>"
    bands = spark.createDataFrame([(b, r) for b, r, _ in rows], f"bucket long, rep {kind}")
    labels = spark.createDataFrame(sorted({(r, c) for _, r, c in rows}), f"rep {kind}, comp {kind}")
    given = []

    def counted(links, a, b):
        given.append(links.count())
        return graph.components(links, a, b)

    monkeypatch.setattr(minhash, "components", counted)
    found = minhash._families(minhash._unsettled(bands, labels), minhash.FAMILY).collect()
    # Three outsiders of the large component, and a bucket of two strangers.
    assert given == [4]
    assert {(r["rep"], r["comp"]) for r in found} == {(r, c) for _, r, c in rows} and len(found) == len({r for _, r, _ in rows})
    by = {r["rep"][0]: r["family"] for r in found}
    assert len({f for i, f in by.items() if i < 1000}) == 1 and by[1000] == by[1001] != by[900]


@pytest.mark.parametrize("few", [0, 100_000])
def test_extended_labels(spark, few, monkeypatch):
    """Further links give the labels that all links together give; links within components change nothing."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(4)
    first = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2)) if a != b]
    more = [(int(a), int(b)) for a, b in rng.integers(0, 80, (25, 2)) if a != b]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = graph.components(frame(first), "a", "b")
    read = lambda df: sorted((r["id"], r["comp"]) for r in df.collect())
    assert read(graph.extended(labels, frame(more), "a", "b")) == read(graph.components(frame(first + more), "a", "b"))
    assert graph.extended(labels, frame(first), "a", "b") is labels


def test_windows_are_scored_once(spark, monkeypatch):
    """The head's windows and all others go through the joins together, and the model's tables are written once."""
    passes, tables = [], []
    scored, write = kneser_ney.probabilities, kneser_ney.written
    monkeypatch.setattr(kneser_ney, "probabilities", lambda *a: passes.append(1) or scored(*a))
    monkeypatch.setattr(kneser_ney, "written", lambda df, name, *a: tables.append((name, sorted(df.columns))) or write(df, name, *a))
    kneser_ney.quality_classifier(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    assert passes == [1]
    assert sum(columns == ["c", "gram"] for _, columns in tables) == kneser_ney.ORDER == sum(name == "kneser-contexts" for name, _ in tables)
