"""Shared DuckDB fragments: the URL corpus, its parts, and text idioms."""

from __future__ import annotations

from lurewatch.plans import fixtures

Q = {"part": "part", "pages": "pages"}
KNOWN = fixtures.KNOWN_SQL.format(**Q)
HOSTILE = fixtures.HOSTILE_SQL.format(**Q)
CORPUS = fixtures.CORPUS_SQL.format(**Q)
BRANDS = fixtures.BRANDS_SQL.format(**Q)

SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
IPV4 = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(terms) -> str:
    return "[" + ", ".join(lit(t) for t in terms) + "]"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def count_of(s: str, token: str) -> str:
    return f"((length({s}) - length(replace({s}, {lit(token)}, ''))) // {len(token)})"


def count_re(s: str, rx: str) -> str:
    return f"len(regexp_extract_all({s}, {lit(rx)}))"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def hits(s: str, terms) -> str:
    return f"len(list_filter({arr(terms)}, lambda t: contains({s}, t)))"


def has_any(s: str, terms) -> str:
    return f"({hits(s, terms)} > 0)"


def ends_any(s: str, ends) -> str:
    return f"(len(list_filter({arr(ends)}, lambda t: ends_with({s}, t))) > 0)"


def longest(s: str, rx: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({s}, {lit(rx)}), lambda t: length(t))), 0)"


def shortest(s: str, rx: str) -> str:
    return f"coalesce(list_min(list_transform(regexp_extract_all({s}, {lit(rx)}), lambda t: length(t))), 0)"


def total_len(s: str, rx: str) -> str:
    return f"length(array_to_string(regexp_extract_all({s}, {lit(rx)}), ''))"


def chars(s: str) -> str:
    return f"regexp_extract_all({s}, '(?s).')"


def entropy(s: str) -> str:
    return f"(CASE WHEN length({s}) > 0 THEN list_entropy({chars(s)}) ELSE 0.0 END)"


def same_run(s: str) -> str:
    return (f"coalesce(list_max(list_transform(list_distinct({chars(s)}), lambda c: "
            f"list_max(list_transform(regexp_extract_all({s}, regexp_escape(c) || '+'), lambda r: length(r))))), 0)")


def parts_cte(source: str = CORPUS, extra: str = "") -> str:
    """CTEs ``corpus`` and ``p``: the corpus with its URL parts."""
    cleaned = r"regexp_replace(regexp_replace(url, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+', '')"
    suffixes = arr(__import__("lurewatch.refdata", fromlist=["SUFFIXES"]).SUFFIXES)
    return rf"""
corpus AS ({source}),
p0 AS (SELECT *, {cleaned} AS cu FROM corpus),
p1 AS (SELECT * EXCLUDE (cu), lower(regexp_extract(cu, '{SPLIT}', 1, 's')) AS scheme, regexp_extract(cu, '{SPLIT}', 2, 's') AS netloc,
   regexp_replace(regexp_extract(cu, '{SPLIT}', 3, 's'), ';[^/]*$', '') AS path,
   regexp_extract(cu, '{SPLIT}', 4, 's') AS query, regexp_extract(cu, '{SPLIT}', 5, 's') AS fragment FROM p0),
p2 AS (SELECT *, regexp_replace(regexp_replace(lower(netloc), '^.*@', ''), ':[0-9]*$', '') AS host FROM p1),
p3 AS (SELECT *, try_cast(nullif(regexp_extract(netloc, ':([0-9]+)$', 1), '') AS INTEGER) AS port,
   CASE WHEN host = '' THEN 0 ELSE len(string_split(host, '.')) END AS n_labels,
   (regexp_matches(host, '{IPV4}') OR regexp_matches(host, '^\[.*\]$')) AS is_ip,
   string_split(host, '.') AS ls FROM p2),
p4 AS (SELECT *, CASE WHEN n_labels < 2 OR is_ip THEN '' ELSE ls[-1] END AS tld,
   CASE WHEN n_labels < 2 OR is_ip THEN '' WHEN list_contains({suffixes}, ls[-2] || '.' || ls[-1]) THEN ls[-2] || '.' || ls[-1]
        ELSE ls[-1] END AS suffix FROM p3),
p5 AS (SELECT *, CASE WHEN suffix = '' THEN ls ELSE ls[1:len(ls) - len(string_split(suffix, '.'))] END AS rest FROM p4),
p AS (SELECT *, CASE WHEN is_ip THEN host WHEN len(rest) = 0 THEN '' ELSE rest[-1] END AS domain_label,
   CASE WHEN is_ip OR len(rest) < 2 THEN '' ELSE array_to_string(rest[1:len(rest) - 1], '.') END AS subdomain,
   CASE WHEN suffix = '' OR len(rest) = 0 OR rest[-1] = '' THEN '' ELSE rest[-1] || '.' || suffix END AS registered_domain,
   string_split(replace(host, 'www.', ''), '.')[1] AS host_label FROM p5){extra}"""


def select_features(spec: dict[str, tuple[str, str]], cte: str, frm: str = "p", key: str = "url_id") -> str:
    """``WITH cte SELECT key, typed features``: kinds ``i`` bigint, ``d`` double rounded to 6, ``s`` string, ``b`` boolean."""
    cols = [f"CAST({key} AS BIGINT) AS {key}"] if key else []
    for name, (kind, expr) in spec.items():
        if kind == "i":
            cols.append(f"CAST({expr} AS BIGINT) AS {name}")
        elif kind == "d":
            cols.append(f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}")
        else:
            cols.append(f"{expr} AS {name}")
    return f"WITH {cte}\nSELECT " + ",\n ".join(cols) + f"\nFROM {frm}"
