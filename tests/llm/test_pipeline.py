"""The pipeline's stages against brute-force versions on the smallest data, and the registered queries."""

import collections
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import expect, lower, rows, slow_components, slow_counts, slow_targets, words  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
PAIR = ("doc_id", "text")


def test_stages(spark):
    import corpus_pipeline as cp
    from lurewatch.llm.common import stored
    from lurewatch.llm.line_quality import fit_on_labels, line_features, viterbi

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "packing"] and cp.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    stage = dict(cp.STAGES)

    w = fit_on_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(t):
        bits, sizes = line_features(t.encode())
        score = [sum(w[i] for i in range(len(w) - 1) if f >> i & 1) for f in bits]
        share = sum(n for n, y in zip(sizes, viterbi(score, w[-1])) if y) / max(1, len(words(t)))
        return not slow_counts(t)[-1] and share >= 0.5

    out = stored(stage["quality_rules"](spark, docs, SF), "t")
    text = [x for x in text if good(x[1])]
    assert rows(out, *PAIR) == expect(x[:2] for x in text) and out.columns == docs.columns

    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for d, t, _ in text:
        for x in t.split("\n"):
            held[key(x)].add(d)
    gone = lambda d, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != d
    text = [(d, "\n".join(x for x in t.split("\n") if not gone(d, x)), s) for d, t, s in text]
    out = stored(stage["line_dedup"](spark, out, SF), "t")
    assert rows(out, *PAIR, "n_chars") == expect((d, t, len(t)) for d, t, _ in text) and out.columns == docs.columns

    comp = slow_components([x[:2] for x in text], 5, 80)
    text = [x for x in text if comp[x[0]][1] == x[0]]
    out = stored(stage["near_duplicates"](spark, out, SF), "t")
    assert rows(out, *PAIR) == expect(x[:2] for x in text) and out.columns == docs.columns

    sizes = collections.Counter()
    for _, t, s in text:
        sizes[s] += len(words(t))
    out = stored(stage["source_mix"](spark, out, SF), "t")
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len(words(r.text))
    assert {s: got[s] for s in sizes} == {s: math.floor(x + 1e-9) for s, x in slow_targets(sizes).items()} and out.columns == docs.columns

    last = stage["packing"](spark, out, SF)
    assert last.where("piece = 0").count() == out.count()
    assert rows(cp.run(spark, SF), *last.columns) == rows(last, *last.columns)


def test_mix_stage_keeps_on_where_a_source_has_only_blank_texts(spark):
    import corpus_pipeline as cp
    from lurewatch.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blank = docs.limit(3).selectExpr(*[{"doc_id": "-doc_id - 1 AS doc_id", "text": "IF(doc_id % 2 = 0, NULL, ' \\n') AS text", "source": "'blank' AS source"}.get(c, c) for c in docs.columns])
    both = stored(docs.unionByName(blank), "t")
    out = stored(dict(cp.STAGES)["source_mix"](spark, both, SF), "t")
    assert out.count() > 0 and out.where("source = 'blank'").count() == 0
    assert dict(cp.STAGES)["packing"](spark, out, SF).where("piece = 0").count() == out.count()


NAMES = ["pipeline", *(f"op{n}_" for n in range(1, 14))]


def test_queries_are_registered():
    found = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(found) == 14 and all(sum(n.startswith(x) for n in found if x != "op1_" or n.startswith("op1_")) == 1 for x in NAMES)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, SF)
    got = rows(df, *sorted(df.columns))
    assert got
    if sql := entry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert got == expect(tuple(r[cols.index(c)] for c in sorted(df.columns)) for r in cur.fetchall())
