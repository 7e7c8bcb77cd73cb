"""Operator 1 beyond its base spans: labelled planted cases, and the two fits."""

import random

from threatweave.llm import pii

FILLER = "the river runs past the old mill and the garden where people sit in the evening and talk about music".split()


def planted(n=400, seed=5):
    """(text, wanted spans, decoys): sentences with loose personal data and secrets, and with what only looks like them."""
    rng = random.Random(seed)
    token = lambda k, chars="0123456789abcdef": "".join(rng.choice(chars) for _ in range(k))
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    name = lambda: rng.choice(["anna.k", "b-miller", "j_ortiz", "lea.dupont7", "max99"])
    area = lambda: rng.choice(["212", "415", "303", "617"])
    make = [
        ("email", lambda: ("Write a mail to ", f"{name()} [at] garden{rng.randrange(90)} [dot] com", " today")),
        ("email", lambda: ("contact: ", f"{name()}(at)stone{rng.randrange(90)}.org", "")),
        ("email", lambda: ("Schreib an ", f"{name()} [AT] fluss{rng.randrange(90)}.de", " bitte")),
        ("phone", lambda: ("call me: ", f"({area()}) {rng.randrange(200, 990)}-{rng.randrange(1000, 9999)}", " soon")),
        ("phone", lambda: ("Teléfono: ", f"{area()}-{rng.randrange(200, 990)}-{rng.randrange(1000, 9999)}", "")),
        ("secret", lambda: ('api_key = "', token(32), '"')),
        ("secret", lambda: ("token: ", "ghp_" + token(36, mixed), "")),
        ("secret", lambda: ("password='", token(12, mixed) + "7a", "'")),
        ("secret", lambda: ('login with secret = "', token(40), '"')),
        (None, lambda: ("commit ", token(40), " was merged")),
        (None, lambda: ("the uuid ", f"{token(8)}-{token(4)}-{token(4)}-{token(4)}-{token(12)}", " of it")),
        (None, lambda: ("order ", str(rng.randrange(10**15, 10**16)), " was sent")),
        (None, lambda: ("see https://example.org/files/", token(24), " for it")),
        (None, lambda: ("version ", f"{rng.randrange(300, 900)}.{rng.randrange(300, 900)}.{rng.randrange(9)}.{rng.randrange(9)}", " of it")),
    ]
    rows = []
    for i in range(n):
        kind, build = make[i % len(make)]
        left, value, right = build()
        before = " ".join(rng.choices(FILLER, k=rng.randrange(3, 12))) + ". " + left
        span = (len(before), len(before) + len(value))
        rows.append((i, before + value + right + " " + " ".join(rng.choices(FILLER, k=5)), kind, span))
    return rows


def test_added_spans_on_labelled_cases(spark):
    rows = planted()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r["doc_id"]: {(pii.KINDS[c["k"]], c["s"], c["e"]) for c in r["spans"]} for r in pii.find_spans(docs).collect()}
    for kind in ("email", "phone", "secret"):
        wanted = [(i, span) for i, _, k, span in rows if k == kind]
        assert sum((kind, *span) in found[i] for i, span in wanted) >= 0.9 * len(wanted), kind
    decoys = [i for i, _, k, _ in rows if k is None]
    wrong = [(rows[i][1], found[i]) for i in decoys if found[i]]
    assert len(wrong) <= 0.05 * len(decoys), wrong[:5]


def test_redaction_covers_added_spans(spark):
    rows = [(1, 'Use token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" or a@b.org now'), (2, "nothing here")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 'Use token = "<SECRET>" or <EMAIL> now', 2: "nothing here"}


def test_em_finds_reliabilities():
    """Votes drawn from known reliabilities: the posterior agrees with the truth, and a useless labeler doesn't sway it."""
    rng = random.Random(3)
    right = (0.95, 0.85, 0.8, 0.5, 0.75)
    drawn, counts = [], {}
    for _ in range(6000):
        truth = rng.random() < 0.3
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < p) == truth else -1) for p in right)
        drawn.append((truth, votes))
        counts[votes] = counts.get(votes, 0) + 1
    post = pii.em(counts, len(right))
    assert sum((post[v] > 0.5) == t for t, v in drawn) > 0.93 * len(drawn)
    assert abs(sum(post[v] for _, v in drawn) / len(drawn) - 0.3) < 0.05
    useless = [v for v in counts if v[3] == 1 and (*v[:3], -1, v[4]) in counts]
    assert sum(abs(post[v] - post[(*v[:3], -1, v[4])]) for v in useless) / len(useless) < 0.1


def test_classifier_follows_the_posteriors():
    """The weights tell patterns of agreeing labelers from patterns of refusing ones, by kind."""
    row = lambda k, votes, n, form=0: {"k": k, **dict(zip(pii.VOTES, votes, strict=True)), "size": 2, "form": form, "n": n}
    patterns = [row(2, (1, 1, 1, 1, 0), 500), row(2, (-1, -1, -1, 0, -1), 400), row(2, (1, 0, 1, 1, 0), 90), row(2, (-1, 0, 0, -1, 0), 60), row(3, (0, 1, 1, 1, 0), 50, 2), row(3, (0, -1, -1, 0, -1), 40, 2)]
    weights = pii.train(patterns)
    odds = [sum(weights[f] for f in pii.indicators(p["k"], p)) for p in patterns]
    assert min(odds[0], odds[2], odds[4]) > 1 and max(odds[1], odds[3], odds[5]) < -1
    assert pii.train([]) == {}
