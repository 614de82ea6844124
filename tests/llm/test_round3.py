"""Operators 11 to 13 against brute-force versions, on a fixture of edge cases and on empty tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, TEXTS, docs, none, words  # noqa: F401


def slow_runs(w, min_length=6, min_exponent=4):
    """Every period by itself: the maximal stretches in which words a period apart are equal."""
    out = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_random_words():
    from lurewatch.llm.maximal_pairs import chunk_runs

    rng = random.Random(1)
    texts = []
    for _ in range(300):
        k = rng.choice([1, 2, 3, 8])
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
        texts.append([rng.randrange(k) for _ in range(rng.randint(0, 10))] + unit * rng.randint(0, 9) + unit[: rng.randint(0, 5)] + [rng.randrange(k) for _ in range(rng.randint(0, 30))])
    texts += [[0] * 200, [0, 1] * 100, [0, 0, 1] * 60 + [0, 0, 1, 1] * 40, []]
    for length, exponent in ((6, 4), (4, 2), (12, 3)):
        got = chunk_runs([np.array(t, np.int64) for t in texts], length, exponent)
        for i, t in enumerate(texts):
            assert got.get(i, []) == slow_runs(t, length, exponent), (t, length, exponent)


def test_runs_of_a_long_text():
    from lurewatch.llm.maximal_pairs import chunk_runs

    rng = np.random.default_rng(3)
    unit = rng.integers(0, 50, 700)
    text = np.concatenate((rng.integers(0, 9, 30_000), np.tile(unit, 12), np.zeros(40_000, np.int64), [1]))
    runs = chunk_runs([text], 6, 4)[0]
    assert any(q == 700 and n >= 8400 for _, n, q in runs) and any(q == 1 and n >= 40_000 for _, n, q in runs)
    for s, n, q in runs:
        assert (text[s : s + n - q] == text[s + q : s + n]).all() and n >= max(6, 4 * q)
        assert s == 0 or text[s - 1] != text[s - 1 + q]
        assert s + n == len(text) or text[s + n] != text[s + n - q]


def test_run_query(spark, docs, none, tmp_path):  # noqa: F811
    from lurewatch.llm.queries import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_maximal_pair_runs"](spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, _ in TEXTS:
        w = words(text)
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = slow_runs(w) if len(w) < 5000 else None
        if runs is None:
            continue
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert len(got) == len(TEXTS)
    short = collections.Counter(want)
    assert short == collections.Counter(tuple(r) for r in got if r.doc_id != 13) and any(r[1] for r in want)
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert not QUERIES["op13_maximal_pair_runs"](spark, f"{tmp_path}/none").collect()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_merkle(rows):
    """(doc_id, source, rest, text) -> multiset of result rows, by lists."""
    leaf = lambda r, text: sha(field(r[0]) + field(r[1]) + r[2] + field(text))

    def levels(bottom):
        out = [bottom]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[3])))
        trees[s] = levels([leaf(r, r[3]) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            text = r[3]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            path, cur = [], leaf(r, text)
            for tree, at in ((trees[s], i), (top, place)):
                for lv in tree[:-1]:
                    run = range(at - at % 3, min(at - at % 3 + 3, len(lv)))
                    path += [lv[k] for k in run if k != at]
                    cur = sha("".join(cur if k == at else lv[k] for k in run))
                    at //= 3
            out.append((r[0], leaf(r, r[3]), trees[s][-1][0], top[-1][0], sha("".join(path)), cur, cur == top[-1][0]))
    return collections.Counter(out)


@pytest.mark.parametrize("band", [7, 1, 2])
def test_manifest(spark, none, tmp_path, monkeypatch, band):  # noqa: F811
    from lurewatch.llm import merkle
    from lurewatch.llm.queries import QUERIES

    monkeypatch.setattr(merkle, "BAND", band)
    monkeypatch.setattr(merkle, "BLOCK", 3**band)
    data = [(i, s, "en", len(t or ""), t, 1, 2, "x", "y") for i, t, s in TEXTS] + [(100 + i, f"s{i % 11}", None, i, f"a\nb{i}", 1, 2, "x", "y") for i in range(60)]
    schema = "doc_id long, source string, lang string, n_chars int, text string, level int, lo long, digest string, tree string"
    spark.createDataFrame(data, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_merkle_intervals"](spark, str(tmp_path)).collect()
    want = slow_merkle([(r[0], r[1], field(r[2]) + field(r[3]), r[4]) for r in data])
    assert collections.Counter(tuple(r) for r in got) == want
    assert {r.verified for r in got} == {True, False}
    if band == 7:
        spark.createDataFrame(data[:1], schema).write.parquet(f"{tmp_path}/one/documents.parquet")
        one = QUERIES["op11_merkle_intervals"](spark, f"{tmp_path}/one").collect()
        assert collections.Counter(tuple(r) for r in one) == slow_merkle([(data[0][0], data[0][1], field("en") + field(data[0][3]), data[0][4])])
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
        assert not QUERIES["op11_merkle_intervals"](spark, f"{tmp_path}/none").collect()


def test_manifest_intervals_nest(spark):
    from lurewatch.llm.merkle import build_manifest

    data = [(i, "a" if i % 3 else "b", None, 1, f"t{i}") for i in range(40)]
    m = build_manifest(spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string"))
    nodes = m.nodes.collect()
    for v in nodes:
        assert v.hi <= v.n and v.lo % 3**v.level == 0
        above = [u for u in nodes if u.tree == v.tree and u.level == v.level + 1 and u.lo <= v.lo and v.hi <= u.hi]
        assert len(above) == (0 if (v.lo, v.hi) == (0, v.n) else 1)


def check_packed(texts, got, window):
    """Every document's ids lie in exactly one piece each, sequences are gapless, all are full but for powers of two."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    sets = collections.defaultdict(list)
    for doc_id, text in texts:
        sets[doc_id].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(sets) == set(by_doc)
    for doc_id, docs_ids in sets.items():
        # repeated doc_ids: each piece fits one of its documents, and lengths add up
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, docs_ids))
        for r in by_doc[doc_id]:
            assert any(r.doc_tokens == len(ids) and r.start + r.length <= len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in docs_ids)
        if len(docs_ids) == 1:
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                assert r.start == at and r.length > 0
                at += r.length
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    short = []
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0
        short += [at] if at < window else []
    assert len(short) == len(set(short))
    return seqs


@pytest.mark.parametrize(("window", "block", "weights"), [(2048, 1024, None), (64, 16, None), (64, 4, {"a": 1, "b": 7, None: 2}), (16, 4, {"d": 50})])
def test_deficit_packing(docs, none, window, block, weights):  # noqa: F811
    from lurewatch.llm.deficit_packing import pack_by_deficit
    from lurewatch.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    got = pack_by_deficit(docs, path, weights, window=window, block_windows=block).collect()
    check_packed([(t[0], t[1]) for t in TEXTS], got, window)
    assert not pack_by_deficit(none, path).collect()


def test_windows_keep_their_proportions(spark):
    from lurewatch.llm.deficit_packing import SLICE, pack_by_deficit
    from lurewatch.llm.queries import tokenizer_path

    rng = random.Random(5)
    data = [(i, " ".join("word" for _ in range(rng.randint(1, 900))), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = pack_by_deficit(df, tokenizer_path("word_bpe_49k.json"), window=512, block_windows=32).collect()
    seqs = check_packed([(d[0], d[1]) for d in data], got, 512)
    size = collections.Counter()
    for r in got:
        size[r.source] += r.length
    served, total = collections.Counter(), 0
    for s in sorted(seqs):
        for r in seqs[s]:
            served[r.source] += r.length
            total += r.length
        for source, n in size.items():  # no source is ever further from its share than its last turns
            assert abs(served[source] - total * n / sum(size.values())) <= 2 * SLICE, (s, source)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_adds_up(seed):
    from lurewatch.llm.deficit_packing import Schedule

    rng = random.Random(seed)
    sizes = [rng.randint(400, 20_000) for _ in range(rng.randint(1, 8))]
    weights = sizes if seed % 2 else [rng.randint(1, 9) for _ in sizes]
    s = Schedule(sizes, list(weights), window=32, block_windows=8)
    assert s.boundary(s.blocks) == sizes
    for b in range(s.blocks):
        takes = s.serve(b)
        assert (takes >= 0).all() and takes.sum(axis=1).tolist() == s.windows(b)
        assert takes.sum(axis=0).tolist() == [y - x for x, y in zip(s.boundary(b), s.boundary(b + 1), strict=True)]
        num, den = s.targets(b * s.block_tokens)
        assert all(abs(x / den - c) <= 1 for x, c in zip(num, s.boundary(b), strict=True))
    for q in range(len(sizes)):
        for at in rng.sample(range(sizes[q]), 20):
            b = s.block_of(q, at, rng.randrange(s.blocks))
            assert s.boundary(b)[q] <= at < s.boundary(b + 1)[q]


def test_mix_cuts_between_equal_rows(spark):
    """A source of many equal rows: whole copies up to the budget and one shortened, nothing rounded down."""
    from lurewatch.llm.mixing import mix_sources, mixed_documents

    text = "one two  three\nfour five"
    data = [(None, text, "b", {"k": 1})] * 37 + [(i, f"w{i} " * (i % 9), "a", None) for i in range(60)] + [(500 + i, "solo words here", None, None) for i in range(11)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, extra map<string,int>").repartition(4)
    want = {r.source_name: r.t for r in mix_sources(docs).groupBy("source_name").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    for range_rows in (2_000, 3):
        got = mixed_documents(docs, range_rows=range_rows).collect()
        size = collections.Counter()
        for r in got:
            size["-" if r.source is None else f"s{r.source}"] += len(words(r.text))
        assert dict(size) == {k: v for k, v in want.items() if v}
        parts = collections.Counter((r.source, r.doc_id) for r in got if r.text not in {d[1] for d in data})
        assert all(n == 1 for n in parts.values()) and len({s for s, _ in parts}) == len(parts)  # at most one shortened a source
        assert all(r.extra == {"k": 1} for r in got if r.source == "b")


def test_line_dedup_of_a_text_of_common_lines(spark):
    import time

    from lurewatch.llm.line_dedup import dedup_lines

    lines = [f"this is the very common line number {i}" for i in range(40_000)]
    data = [(i, "\n".join(lines[i:] + ["own"]), "x") for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lines string")
    for limit in (32 << 20, 0):
        begun = time.time()
        got = {r.doc_id: (r["__n_lines"], r["__n_dropped"], r.text) for r in dedup_lines(docs, broadcast_bytes=limit).collect()}
        assert got[2] == (39_999, 0, data[2][1])
        assert got[0] == (40_001, 39_998, "\n".join([*lines[:2], "own"])) and got[1][1] == 39_998
        assert time.time() - begun < 20


def test_licence_identifiers_of_no_known_family():
    from lurewatch.llm.license_scan import automaton, scan_text

    def scan(t):
        found = scan_text(t, automaton())
        return found[5], found[8], found[9], found[6]

    tag = b"SPDX-License-Identifier: "
    assert scan(tag + b"0BSD")[:3] == ("bsd", "0BSD", "none") and scan(tag + b"Artistic-2.0")[:3] == ("artistic", "Artistic-2.0", "notice")
    assert scan(tag + b"NOASSERTION")[:3] == ("", "NOASSERTION", "unknown")
    assert scan(tag + b"Foo-1.0")[:3] == ("foo-1.0", "Foo-1.0", "unknown")
    assert scan(tag + b"see the file")[:3] == ("", "", None)
    assert scan(tag + b"Foo-1.0 OR MIT")[2] == "notice" and scan(tag + b"Foo-1.0 AND MIT")[2] == "unknown"
    assert scan(tag + b"(MIT OR GPL-2.0-only")[2] is None and scan(tag + b"(MIT OR GPL-2.0-only")[3] < scan(tag + b"MIT OR GPL-2.0-only")[3]


def slow_packing(counts, caps, rule, weights):
    """One piece at a time, longest first, over all open sequences."""
    bins, cap, w = [], np.array(caps, float), np.array(weights)
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length])
        for _ in range(counts[length]):
            fits = [i for i, b in enumerate(bins) if (b >= need).all()]
            if not fits:
                bins.append(np.array(caps) - need)
            elif rule == "norm":
                bins[min(fits, key=lambda i: (w * ((bins[i] - need) / cap) ** 2).sum())] -= need
            else:
                bins[max(fits, key=lambda i: (w * (bins[i] / cap) * (need / cap)).sum())] -= need
    return sorted(tuple(b.tolist()) for b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_counts_are_placed_like_single_pieces(rule):
    from lurewatch.llm.packing import place_counts

    rng = random.Random(2)
    for _ in range(150):
        tokens = rng.randint(20, 60)
        caps = (tokens, rng.randint(3, 12), rng.randint(tokens * tokens // 2, tokens * tokens))
        most = int(caps[2] ** 0.5)
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, min(tokens, most) + 1), 6)}
        weights = (1.0, 0.3, 0.5)
        room = collections.defaultdict(lambda: np.array(caps))
        for length, _, number, per, seq, _ in place_counts(counts, caps, rule, weights):
            for t in range(number):
                room[seq + t // per] = room[seq + t // per] - np.array([length, 1, length * length])
        assert sorted(tuple(b.tolist()) for b in room.values()) == slow_packing(counts, caps, rule, weights)


def test_secret_names_and_expressions():
    from lurewatch.llm.secret_scan import find_secrets, lexed_literals, name_weight

    hit = lambda s: [(s[i:j], name) for i, j, _, name in lexed_literals(s)]
    x = b"Zx81kQ77pLm2"
    for clean in (b'author = "JaneSmith1984"', b'tokenizer = "word_bpe_49k.json"', b"authority: JaneSmith1984", b"secretary: JaneSmith1984", b"max_tokens=Zx81kQ77pLm2"):
        assert hit(clean) == [], clean
    assert all(name_weight(n) for n in (b"dbPassword", b"clientSecret", b"client-secret", b"authtoken", b"AUTH", b"x.api.key", b"dbpwd", b"aws_access_key"))
    assert hit(b'password = """' + x + b'"""') == [(x, b"password")] and hit(b"db_pwd = '''\n" + x + b"\n'''") == [(b"\n" + x + b"\n", b"db_pwd")]
    assert hit(b"db_pwd = `" + x + b"`") == [(x, b"db_pwd")]
    assert hit(b'seed = "' + x + b'"\npassword = "pre" + seed') == [(x, b"password")]
    assert hit(b'a = "pre"\npassword = a + "' + x + b'"') == [(x, b"password")]
    assert hit(b'password = os.getenv("X") or "' + x + b'"') == [(x, b"password")] and hit(b'password = os.getenv("DB_PWD_1x")') == []
    assert hit(b"<password>" + x + b"</password>") == [(x, b"password")] and hit(b"<name>" + x + b"</name>") == []
    assert hit(b'password = "trueNorth7x2"') == [(b"trueNorth7x2", b"password")] and hit(b'password = "example-key-12A"') == []
    assert find_secrets(b"<secret>" + x + b"</secret>")[4] == "literal:8:20"


def test_repeated_rows_with_a_map_column(spark):
    from lurewatch.llm.signature_join import keep_first_of_groups

    text = " ".join(f"w{i}" for i in range(40))
    data = [(1, text, {"k": 1}), (1, text, {"k": 1}), (2, text, None), (3, "other words stand here alone", {"k": 3})]
    got = keep_first_of_groups(spark.createDataFrame(data, "doc_id long, text string, extra map<string,int>")).collect()
    assert sorted((r.doc_id, str(r.extra)) for r in got) == [(1, "{'k': 1}"), (3, "{'k': 3}")]


def test_repeated_labelled_rows_count_once(spark):
    from lurewatch.llm.line_quality import fit_on_labels

    texts = [(i, f"Some good line of prose number {i} is here.\n$$$ ### {i}" if i % 2 else f"### {i} $$$ |||\n>>> *** {i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once = fit_on_labels(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    often = fit_on_labels(spark.createDataFrame(texts + [texts[1]] * 50, "doc_id long, text string"), labels)
    assert np.allclose(once, often)


def test_pipeline_of_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_starts_no_python_for_its_runs(spark):
    """A list made into a frame is read by Python workers of a second daemon, beside those that make the token ids."""
    from lurewatch.llm.packing import best_fit
    from lurewatch.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "one two three")], "doc_id long, text string")
    got = best_fit(docs, tokenizer_path("word_bpe_49k.json"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert sorted((r.doc_id, r.sequence_id) for r in got.collect()) == [(1, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "packing"])
def test_stages_read_few_texts_at_a_time(spark, tmp_path, stage):
    """Spark's 4,096 rows a Parquet batch are one large array of whole texts, which the heap holds in one piece."""
    import corpus_pipeline

    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.createDataFrame([(1, "one two three", "en", "a", 13)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set(key, "4096")
    dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert int(spark.conf.get(key)) <= 512
