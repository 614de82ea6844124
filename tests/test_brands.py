"""Look-alike joins against brute force over all pairs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions.similarity import jaro_batch
from lurewatch.operators import brands as B
from lurewatch.operators.containment import containment_hits

BRANDS = ["paypal", "google", "ups", "usps", "amazon", "bankofamerica", "ebay", "oo"]


def edits(word: str, rng: random.Random) -> str:
    i = rng.randrange(len(word))
    kind = rng.randrange(7)
    c = rng.choice("abcdefghijklmnopqrstuvwxyz01-é")
    return [word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word[:i] + word[i + 1:i + 2] + word[i:i + 1] + word[i + 2:],
            word + rng.choice(["login", "xyz", "-secure", "hub"]), word[::-1], word][kind]


def one_edit(l: str, b: str) -> dict:
    found = {}
    if any(b[:i] + b[i + 1:] == l for i in range(len(b))):
        found["omission"] = 0.95
    if any(l[:i] + l[i + 1:] == b for i in range(len(l))):
        found["insertion"] = 0.90
    if len(l) == len(b):
        diff = [i for i in range(len(b)) if l[i] != b[i]]
        if len(diff) == 1:
            found["substitution"] = 0.92
            x = ord(l[diff[0]]) ^ ord(b[diff[0]])
            if x and x & (x - 1) == 0 and (l[diff[0]].isalnum() or l[diff[0]] == "-"):
                found["bitsquatting"] = 0.94
        if len(diff) == 2 and diff[1] == diff[0] + 1 and l[diff[0]] == b[diff[1]] and l[diff[1]] == b[diff[0]]:
            found["transposition"] = 0.93
    if any(s in b and b.replace(s, d) == l for s, ds in refdata.HOMOPHONES.items() for d in ds.split()):
        found["homophone"] = 0.85
    if b in l and any(k in l.replace(b, "") for k in refdata.COMBO_KEYWORDS):
        found["combosquatting"] = 0.87
    return found


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(7)
    out = {edits(rng.choice(BRANDS), rng) for _ in range(400)} | {"ups", "login", "paypa1", "a", "paypalpaypal"}
    return sorted(x for x in out if x)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_matches_equal_brute_force(spark, labels):
    ldf = spark.createDataFrame([(x,) for x in labels], "label string")
    bdf = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    got = {(r.label, r.brand): (r.technique, round(r.score, 6)) for r in B.scored_pairs(B.unprotected_labels(ldf, bdf), bdf).collect()}
    want = {}
    for l in labels:
        if l in BRANDS:
            continue
        for b in BRANDS:
            found = one_edit(l, b)
            if found:
                best = max(found, key=found.get)
                want[l, b] = (best, found[best])
            elif distance(l, b) > 2:
                s = 0.75 * float(jaro_batch([l], [b])[1][0])
                if s >= 0.70:
                    want[l, b] = ("high_similarity", round(s, 6))
    assert got == want and any(t == "high_similarity" for t, _ in want.values())


def test_jaro_known_values():
    j, jw = jaro_batch(["martha", "dixon", "same", "abc", ""], ["marhta", "dicksonx", "same", "xyz", "a"])
    assert [round(float(x), 4) for x in j] == [0.9444, 0.7667, 1.0, 0.0, 0.0]
    assert [round(float(x), 4) for x in jw] == [0.9611, 0.8133, 1.0, 0.0, 0.0]


def test_containment_forms_agree(spark):
    texts = spark.createDataFrame(pd.DataFrame({"id": range(5), "t": ["paypal-login", "xxgoogle", "ebayebay", "none", "usps.ups"]}))
    terms = spark.createDataFrame([(b,) for b in BRANDS], "term string")
    pairs = lambda df: sorted((r.id, r.term) for r in df.collect())
    literal, joined = containment_hits(texts, "t", terms, "term"), containment_hits(texts, "t", terms, "term", literal_max=2)
    assert pairs(literal) == pairs(joined) and len(pairs(literal)) == 6


def test_ties_go_to_first_brand(spark):
    ldf = spark.createDataFrame([("cat",)], "label string")
    bdf = spark.createDataFrame([("cats",), ("bcat",)], "brand string")
    r = B.best_brand_per_label(ldf, bdf).first()
    assert (r.brand, r.technique) == ("bcat", "omission")


def test_long_brand_table_uses_joins(spark, labels, monkeypatch):
    ldf = spark.createDataFrame([(x,) for x in labels], "label string")
    bdf = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    want = sorted(map(tuple, B.technique_matches(ldf, bdf).collect()))
    monkeypatch.setattr(B, "bounded_values", lambda *a: None)
    monkeypatch.setattr(B, "sized_broadcast", lambda df, *a: df)
    assert sorted(map(tuple, B.technique_matches(ldf, bdf).collect())) == want


def test_idn_host(spark):
    from lurewatch.operators.parts import url_parts

    df = spark.createDataFrame([(1, "https://pаypаl.com/")], "url_id long, url string")
    r = B.lookalike_hosts(url_parts(df), spark.createDataFrame([("paypal",)], "brand string")).first()
    assert (r.brand, r.technique, r.severity) == ("paypal", "idn_homograph", "critical")
    assert F is not None


def test_similarity_candidates_are_few(spark):
    """Fewer than one in a hundred of all pairs of unrelated names is compared; every pair that scores is."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("etaoinsrhldcumfpgwybvkxjqz"[: rng.randint(12, 26)]) for _ in range(rng.randint(5, 14)))
    names, brands = sorted({name() for _ in range(400)}), sorted({name() for _ in range(80)})
    near = [b[:3] + "q" + b[3:-1] + "zz" for b in brands[:20]]
    ldf = spark.createDataFrame([(x,) for x in names + near], "label string")
    bdf = spark.createDataFrame([(b,) for b in brands], "brand string")
    pairs = {(r.label, r.brand) for r in B.similarity_candidates(ldf, bdf).collect()}
    assert len(pairs) < 0.01 * len(names) * len(brands)
    _, jw = jaro_batch([x for x in names + near for _ in brands], brands * len(names + near))
    every = [(x, b) for x in names + near for b in brands]
    assert {p for p, s in zip(every, jw) if s >= 14 / 15 and distance(*p) > 2 and p[0] not in brands} <= pairs


def test_brand_table_beyond_the_broadcast_bound(spark, labels, monkeypatch):
    ldf = spark.createDataFrame([(x,) for x in labels], "label string")
    bdf = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    want = sorted(map(tuple, B.scored_pairs(ldf, bdf).collect()))
    monkeypatch.setattr(B, "sized_broadcast", lambda df, *a: df)
    assert sorted(map(tuple, B.scored_pairs(ldf, bdf).collect())) == want


def test_ratio_pairs_equal_brute_force(spark, labels, monkeypatch):
    from difflib import SequenceMatcher

    from lurewatch.plans import brands as P

    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12)))
    names = [*labels, "thefacebook", "faceboook", "b", "ob", "x" * 90 + "paypal", *(name() for _ in range(150))]
    brands = sorted({*BRANDS, "facebook", "y" * 20 + "x" * 80, *(name() for _ in range(30))})
    monkeypatch.setattr(P, "corpus_labels", lambda *a: spark.createDataFrame([(x,) for x in names], "label string"))
    monkeypatch.setattr(P.fx, "brands", lambda *a: spark.createDataFrame([(b,) for b in brands], "brand string"))
    got = {(r.label, r.brand): r.ratio for r in P._ratio(spark, "").collect()}
    every = {(x, b): SequenceMatcher(None, x, b).ratio() for x in names for b in brands if x != b}
    assert got == {p: r for p, r in every.items() if r > 0.7}
    assert ("thefacebook", "facebook") in got and ("faceboook", "facebook") in got
