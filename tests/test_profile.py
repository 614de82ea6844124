"""The character and n-gram kernel against counting string by string."""

from __future__ import annotations

import math
from collections import Counter
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lurewatch.functions.profile import CodePoints, profile_batch, string_profile


def entropy(items) -> float:
    n = len(items)
    return -sum(c / n * math.log2(c / n) for c in Counter(items).values()) if n else 0.0


def grams(s: str, k: int) -> list[str]:
    return [s[i:i + k] for i in range(len(s) - k + 1)]


def expected(url: str, host: str, path: str) -> dict:
    longest = lambda s: max((len(list(g)) for _, g in groupby(s)), default=0)
    n = len(host)
    return {
        "url_distinct": len(set(url)), "url_top": max(Counter(url).values(), default=0), "url_entropy": entropy(url), "url_run": longest(url),
        "bigrams": len(set(grams(url, 2))), "bigram_entropy": entropy(grams(url, 2)), "trigrams": len(set(grams(url, 3))),
        "trigram_entropy": entropy(grams(url, 3)), "host_distinct": len(set(host)), "host_entropy": entropy(host), "host_run": longest(host),
        "host_jumps": sum(abs(ord(a) - ord(b)) > 5 for a, b in zip(host, host[1:])),
        "host_repeats": any(host[:k] * (n // k) == host[:n // k * k] for k in range(2, n // 2)), "path_entropy": entropy(path)}


def assert_rows(rows):
    got = profile_batch(*[list(c) for c in zip(*rows)])
    for i, row in enumerate(rows):
        assert {n: v[i] for n, v in got.items()} == pytest.approx(expected(*row), abs=1e-9), row


TEXTS = st.one_of(st.text("ab", max_size=30), st.text("abc./é𝒳\x00\n", max_size=40))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS, TEXTS), min_size=1, max_size=8))
def test_batches_equal_single_strings(rows):
    assert_rows(rows)


def test_long_strings_and_large_alphabets():
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))
    assert_rows([(many, "ab" * 5_000, ""), ("", "", many), ("x" * 50_000, "ab" * 5_000 + "c" * 10_000, "/")])


def test_grams_are_renumbered_where_keys_would_not_fit():
    strings = ["".join(chr(0x10000 + (i * j) % 70_001) for i in range(3_000)) for j in (1, 7, 30_011)]
    rows, counts = CodePoints(strings).grams(5)
    for i, s in enumerate(strings):
        assert sorted(counts[rows == i]) == sorted(Counter(grams(s, 5)).values())


def test_nulls_count_as_empty(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "aab", "a.b", "")], "id int, u string, h string, p string")
    rows = {r.id: r.p.asDict() for r in df.select("id", string_profile(df.u, df.h, df.p).alias("p")).collect()}
    assert rows[1] == expected("", "", "")
    assert rows[2] == pytest.approx(expected("aab", "a.b", ""))
    assert df.where("false").select(string_profile(df.u, df.h, df.p)).count() == 0
