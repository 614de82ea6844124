"""Column recipes over strings: counts, ratios, runs, entropies, lexicon hits.

Everything is a native Column expression.  Two rules keep the wide feature
projections fast: a *count of lexicon hits* is a sum of ``contains`` tests
(code-generated, no lambda), and array lambdas are used only where a value
really is a fold over the characters or tokens of one string.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """0/1 integer of a condition; NULL counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_of(s: Column, token: str) -> Column:
    """Non-overlapping occurrences of a fixed token."""
    gap = F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))
    return gap if len(token) == 1 else (gap / F.lit(len(token))).cast("int")


def count_re(s: Column, regex: str) -> Column:
    return F.regexp_count(s, F.lit(regex))


def ratio(num: Column, den: Column) -> Column:
    """``num/den`` as double, 0 when the denominator is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def sql_text(value: str) -> str:
    """A string literal in Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(s: str, terms: Iterable[str]) -> Column:
    """True when any term occurs in the SQL expression ``s``.

    The list helpers take SQL text and build one expression: a hundred terms
    cost one call into the JVM when the plan is built, not several hundred.
    """
    terms = list(terms)
    if len(terms) > 16:  # one automaton instead of a method too long for the JIT compiler
        return F.expr(f"({s} RLIKE {sql_text('|'.join(re.escape(t) for t in terms))})")
    tests = [f"contains({s}, {sql_text(t)})" for t in terms]
    return F.expr("(" + " OR ".join(tests or ["false"]) + ")")


def hits_of(s: str, terms: Iterable[str]) -> Column:
    """How many of the terms occur in ``s`` (overlaps count; each term once)."""
    return F.expr("(" + " + ".join([f"CAST(contains({s}, {sql_text(t)}) AS INT)" for t in terms] or ["0"]) + ")")


def _weights(s: str, terms: Iterable[tuple[str, float]]) -> list[str]:
    return [f"CASE WHEN contains({s}, {sql_text(t)}) THEN {w}{'D' if isinstance(w, float) else ''} "
            f"ELSE {'0D' if isinstance(w, float) else '0'} END" for t, w in terms]


def weight_of(s: str, terms: Iterable[tuple[str, float]]) -> Column:
    """Sum of the weights of the terms that occur in ``s``."""
    return F.expr("(" + " + ".join(_weights(s, terms)) + ")")


def max_weight_of(s: str, terms: Iterable[tuple[str, float]]) -> Column:
    return F.expr("greatest(" + ", ".join(_weights(s, terms)) + ")")


def ends_with_any(s: str, ends: Iterable[str]) -> Column:
    return F.expr("(" + " OR ".join(f"endswith({s}, {sql_text(e)})" for e in ends) + ")")


def chars(s: Column) -> Column:
    """Characters (code points) of a string."""
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def tokens(s: Column, regex: str) -> Column:
    return F.regexp_extract_all(s, F.lit(regex), F.lit(0))


def max_len(arr: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(arr, lambda x: F.length(x))), F.lit(0))


def min_len(arr: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(arr, lambda x: F.length(x))), F.lit(0))


def sum_len(arr: Column) -> Column:
    """Total length of array elements."""
    return F.length(F.array_join(arr, ""))


def longest_run(s: Column, regex: str) -> Column:
    """Length of the longest match of ``regex`` in ``s``."""
    return max_len(tokens(s, regex))


def longest_same(s: Column) -> Column:
    """Longest run of one repeated character."""
    return F.when(F.length(s) > 0, F.greatest(F.lit(1), max_len(_runs(s)))).otherwise(F.lit(0))


def _runs(s: Column) -> Column:
    """Runs of two or more equal characters."""
    return F.regexp_extract_all(s, F.lit(r"(?s)((.)\2+)"), F.lit(1))


def sorted_chars(s: Column) -> Column:
    """The characters of a string in order, as a string: equal characters become one run."""
    return F.array_join(F.sort_array(chars(s)), "")


def _entropy_of(n: Column, counts: Column) -> Column:
    """``log2 n - sum(c log2 c) / n``; only counts above 1 contribute to the sum."""
    acc = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c))
    return F.when(n > 0, F.log2(n.cast("double")) - acc / n).otherwise(F.lit(0.0))


def entropy(s: Column) -> Column:
    """Shannon entropy (bits) of the characters."""
    runs = _runs(sorted_chars(s))
    return _entropy_of(F.length(s), F.transform(runs, lambda r: F.length(r).cast("double")))


def length_band(n: Column) -> Column:
    return (F.when(n < 20, 0).when(n < 40, 1).when(n < 60, 2).when(n < 80, 3).otherwise(4)).cast("int")


def url_decode(s: Column) -> Column:
    """Percent-decode; ``+`` stays a plus, undecodable input is returned unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def points_by(s: str, weights: Iterable[tuple[str, float]]) -> Column:
    """Weight of the exact value of ``s``, 0 when it is not listed."""
    groups: dict = {}
    for t, w in weights:
        groups.setdefault(w, []).append(sql_text(t))
    cases = " ".join(f"WHEN {s} IN ({', '.join(ts)}) THEN {w}" for w, ts in groups.items())
    return F.expr(f"CASE {cases} ELSE 0 END")
