"""Operators against brute force on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from threatweave.llm import chunk_dedup, registry, tokens
from threatweave.llm.chunk_dedup import RUN, cuts
from threatweave.llm.minhash import BOUNDS, may_link

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_op1(spark, docs):
    only = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    )
    for r in result(spark, "op1_pii"):
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(rules) for m in re.finditer(p, docs[r["doc_id"]]) if ok(m[0]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert {f"{n}:{s}:{e}" for s, _, e, n in spans} <= set(r["spans"].split(",")) | {""}


def test_op2(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    common, where = Counter(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    for r in result(spark, "op2_minhash_near_dedup"):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]), top(r["doc_id"]) == r["doc_id"])


def test_sequential_test_keeps_similar_signatures():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (4000, 252), dtype=np.uint16)
    same = rng.random((4000, 252)) < 0.85
    near, far = np.where(same, a, a + np.uint16(1)), np.where(rng.random((4000, 252)) < 0.4, a, a + np.uint16(1))
    assert may_link(a, near).all() and not may_link(a, far).any() and BOUNDS[0][1] < BOUNDS[-1][1]


@pytest.mark.parametrize("family", [20_000, 3])
def test_op2_families(spark, family, monkeypatch):
    """Chains of near copies that the stars leave open, in families beyond the bound and in several blocks."""
    from threatweave.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 220)]
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.integers(0, 220, rng.integers(0, 8)):
            w[at] = f"v{rng.integers(0, 10_000)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.near_duplicates(docs, minhash.NEED, family=family).collect()
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == label


@pytest.fixture(scope="module")
def encoded(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {i: x.ids for i, x in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op3(spark, encoded):
    rows = {r["doc_id"]: r for r in result(spark, "op3_token_files")}
    start = 0
    for i in sorted(encoded):
        ids = [*encoded[i], 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op9(spark, encoded):
    rows = result(spark, "op9_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(encoded)
    for i, pieces in by_doc.items():
        ids, at = [*encoded[i], 2], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 4096
    groups = Counter()
    for r in rows:
        if r["offset"] == 0:
            groups[r["step_group"]] += r["tier"]
    assert max(groups.values()) - min(groups.values()) <= 4096


def test_step_groups_are_balanced(spark):
    """Over many tasks with windows of all tiers, groups differ by one window at most."""
    from threatweave.llm import packing

    texts = [(i, "river stone " * (i * 37 % 900 + 1)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows = packing.pack(docs, tokenizer_path=tokens.default_path(), end_id=2, block_tokens=20_000, step_tokens=30_000).collect()
    groups, windows = Counter(), {}
    for r in rows:
        windows[r["sequence_id"]] = (r["step_group"], r["tier"])
    for g, tier in windows.values():
        groups[g] += tier
    assert len(groups) == round(sum(groups.values()) / 30_000) and max(groups.values()) - min(groups.values()) <= 4096


def test_word_cache_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    texts = ["It's a test, isn't it? Yes.", "Äpfel, ÖL. éa İstanbul ſ ﬁ", "a\tb c  d\n\n", "<|startoftext|> x <|ENDOFTEXT|>.", "don't.. a.b, 3,5 x'll", "", "éclair é. naïve,", "日本語 テキスト。"]
    ids, at = tokens.WordEncoder(tokens.default_path()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_op4(spark, docs):
    for r in result(spark, "op4_quality_rules"):
        t = docs[r["doc_id"]]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = defaultdict(list)
        for k in range(len(w) - 2):
            windows[tuple(w[k : k + 3])].append(k)
        covered = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert want == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert not (failed and r["kept"])


def test_op4_rejects_labelled_bad(spark):
    """The score itself decides: of what passes the base rules, bad documents go and trusted ones stay."""
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = defaultdict(list)
    for r in registry.QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").collect():
        if not r["base_failed"]:
            kept[labels.get(r["doc_id"])].append(r["kept"])
    assert np.mean(kept[1, 0]) > 0.98 and np.mean(kept[0, 0] + kept[0, 1]) < 0.1


def repeats_by_hand(docs):
    """Document -> (n_bytes, repeats) from all chunks of all texts in memory; ``docs`` are (doc_id, text) of distinct ids."""
    found = {}
    for i, t in docs:
        data, at, found[i] = (t or "").encode(), 0, []
        for e in cuts(data):
            found[i].append((at, e, data[at:e]))
            at = e
    places = defaultdict(list)
    for i in sorted(found):
        for s, e, x in found[i]:
            places[x].append((i, s))
    out = {}
    for i, own in found.items():
        runs = []
        for s, e, x in own:
            if len(places[x]) > 1:
                gone = 0 if places[x][0] == (i, s) else e - s
                if runs and runs[-1][1] == s:
                    runs[-1] = (runs[-1][0], e, runs[-1][2] + gone)
                else:
                    runs.append((s, e, gone))
        out[i] = sum(e - s for s, e, _ in own), ",".join(f"{s}:{e}:{g}" for s, e, g in runs if e - s >= RUN)
    return out


def test_op5(spark, docs):
    rows = result(spark, "op5_chunk_dedup")
    hand = repeats_by_hand(docs.items())
    assert {r["doc_id"]: (r["n_bytes"], r["repeats"]) for r in rows} == hand and len(rows) == len(hand)
    for r in rows:
        runs = [tuple(map(int, x.split(":"))) for x in r["repeats"].split(",") if x]
        assert (r["has_repeat"], r["n_repeats"]) == (bool(runs), len(runs))
        assert (r["repeat_bytes"], r["removed_bytes"]) == (sum(e - s for s, e, _ in runs), sum(g for *_, g in runs))
        assert r["kept"] == (r["removed_bytes"] < r["n_bytes"] or not r["n_bytes"])


def test_op5_splits_common_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(chunk_dedup, "SHARE", 3)
    common = " ".join(f"footer{k}" for k in range(60))
    rows = [(i, f"{t or ''} {common} {common if i % 3 == 0 else ''}") for i, t in list(docs.items())[:40]]
    out = chunk_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["repeats"]) for r in out} == repeats_by_hand(rows)
    assert all(r["has_repeat"] for r in out)


def test_op5_finds_planted_passages(spark):
    """Passages of 51 words, each put into two texts."""
    rng = np.random.default_rng(11)
    names = np.array(["".join(rng.choice(list("abcdefghiklmnoprstuvw"), n)) for n in rng.integers(2, 11, 4000)])
    prose = lambda n: " ".join(rng.choice(names, n))
    rows = []
    for k in range(400):
        passage = prose(51)
        rows += [(2 * k, f"{prose(40)} {passage} {prose(30)}"), (2 * k + 1, f"{prose(70)} {passage}")]
    rows += [(k, prose(150)) for k in range(1000, 1400)]
    out = {r["doc_id"]: r["has_repeat"] for r in chunk_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([out[k] for k in range(800)]) > 0.97 and not any(out[k] for k in range(1000, 1400))


def test_cuts_resist_insertions():
    data = bytes(np.random.default_rng(3).integers(97, 123, 20_000, dtype=np.uint8))
    a, b = cuts(data), cuts(data[:5000] + b"inserted" + data[5000:])
    assert a[-1] == len(data) and len(set(a) & {x - 8 for x in b if x > 5400}) > 0.95 * sum(x > 5400 for x in a)


def test_op6(spark, docs):
    split = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    for r in result(spark, "op6_decontamination"):
        w = split(docs[r["doc_id"]])
        hit = set().union(*[grams.get(tuple(w[k : k + 12]), set()) for k in range(len(w) - 11)]) if len(w) > 11 else set()
        assert hit <= set(r["item_ids"]) and r["kept"] == (not r["contaminated"]) and (hit or len(r["item_ids"]) == 0)


def test_op7(spark, docs):
    rows = result(spark, "op7_kd_sharding")
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / 8, max(r["size"] for r in rows)
    assert max(abs(s - mean) for s in sizes.values()) <= max(largest, 0.05 * mean)


def test_op7_keeps_equal_texts_together(spark):
    """Groups of equal texts lie in one shard; only one that is larger than a shard's share of deviation is spread."""
    from threatweave.llm import sharding

    texts = [(i, f"text {i // 3} " + "x" * (i // 3 * 53 % 400), "en") for i in range(3000)] + [(10_000 + i, "hot " * 100, "en") for i in range(900)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()
    held, where = Counter(), defaultdict(set)
    for r in rows:
        held[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(held.values()) / 8
    assert all(abs(n - mean) <= 0.05 * mean for n in held.values())
    assert sorted(len(x) for x in where.values())[:-1] == [1] * 1000 and max(len(x) for x in where.values()) > 1


def test_op8(spark, docs):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT"}
    found = {r["doc_id"]: set(r["families"]) for r in result(spark, "op8_licences")}
    for i, t in docs.items():
        assert {lines[x] for x in t.split("\n") if x in lines} <= found.get(i, set())


def test_op10(spark):
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = registry.QUERIES["op10_kneser_ney"](spark, "/root/testdata/sf0.01").collect()
    kept = defaultdict(list)
    for r in rows:
        if r["doc_id"] in good:
            kept[good[r["doc_id"]]].append(r["kept"])
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.3


def test_kneser_ney_sums_to_one(spark):
    """The probabilities of all characters after a context add up to one."""
    from threatweave.llm import kneser_ney as kn

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abracadabra abra cadabra", "banana bandana", "abba cab dab"] * 3)], "doc_id long, text string")
    seen = sorted(set("".join(["abracadabra abra cadabra", "banana bandana", "abba cab dab"])))
    windows = [context + c for context in ("abra", "bana", "zzzz") for c in seen]
    totals = defaultdict(float)
    for r in kn.probabilities(spark.createDataFrame(list(enumerate(windows)), "key long, gram string"), kn.model(docs)[0]).collect():
        totals[windows[r["key"]][:-1]] += r["p"]
    assert len(totals) == 3 and all(0.85 < total < 1.0001 for total in totals.values())


def kneser_ney_by_hand(trusted, order=5):
    """A function (window -> probability), straight from the definitions."""
    tables = {order: Counter(t[k : k + order] for t in ("\x02" * (order - 1) + t for t in trusted) for k in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cut = {}
    for n, grams in tables.items():
        n1, n2, n3, n4 = (sum(c == k for c in grams.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cut[n] = [min(0.95 * k, max(0.05, k - (k + 1) * y * b / a)) if a and b else min(0.75, 0.5 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    def p(window):
        n = len(window)
        if n == 0:
            return 1 / (len(tables[1]) + 1)
        held = {g: c for g, c in tables[n].items() if g[:-1] == window[:-1]}
        if not held:
            return p(window[1:])
        off = lambda c: cut[n][min(c, 3) - 1]
        own = held.get(window, 0)
        return ((own - off(own) if own else 0) + sum(map(off, held.values())) * p(window[1:])) / sum(held.values())

    return p


@pytest.mark.parametrize("most", [0, 12, 1 << 20])
def test_kneser_ney_by_hand(spark, most):
    """Bits of documents over several blocks equal those of the definitions, with an empty, a partial and a full head."""
    from threatweave.llm import kneser_ney as kn

    trusted = ["abracadabra abra cadabra", "banana bandana", "abba cab dab", "a banana"] * 2
    p = kneser_ney_by_hand(trusted)
    texts = ["banana", "xyz abra", "", None, "dab dab", "cabana \U0001f600"] * 3
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    model, counts = kn.model(spark.createDataFrame([(t,) for t in trusted], "text string"))
    marked = kn.blocks(docs)
    assert marked.select("block").distinct().count() > 1
    rows = kn.perplexities(marked, kn.scored_blocks(marked, model, counts, most), ["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        padded = "\x02" * 4 + t
        bits = [-np.log2(p(padded[k : k + 5])) for k in range(len(t))]
        assert r["n_scored"] == len(t) and abs(r["bits"] - 1000 * (np.mean(bits) if t else 0)) <= 1


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(registry.SQL[name])
    rows = result(spark, name)
    columns = sorted(rel.columns)
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
