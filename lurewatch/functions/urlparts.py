"""URL splitting as Column expressions (one anchored expression, RFC 3986 appendix B).

``parse_url`` is not used: it rejects exactly the hostile inputs this package
exists for (underscored or non-ASCII hosts, ``|`` in paths) and drops
user-info and port from the authority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.text import sql_text
from lurewatch.session import bounded_values, sized_broadcast

SPLIT_RE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
IPV4_RE = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def clean_url(url: Column) -> Column:
    """Remove what a browser ignores: tabs and line breaks anywhere, blanks in front."""
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``scheme, netloc, path, query, fragment`` (path without ``;parameters`` of its last segment)."""
    u = clean_url(F.col(url))

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(u, SPLIT_RE, i), F.lit(""))

    return df.withColumns({
        "scheme": F.lower(part(1)), "netloc": part(2), "path": F.regexp_replace(part(3), r";[^/]*$", ""),
        "query": part(4), "fragment": part(5),
    })


def _suffix_columns(listed: list[str] | None) -> list[str]:
    """``sfx2``/``sfx3``: the last two / three labels where they are a public suffix (literal list form)."""
    values = ", ".join(sql_text(v) for v in listed) if listed else "''"
    return [f"CASE WHEN n_labels >= {n} AND substring_index(host, '.', -{n}) IN ({values}) "
            f"THEN substring_index(host, '.', -{n}) END AS sfx{n}" for n in (2, 3)]


# each entry may use the aliases before it
HOST_COLUMNS = [
    r"regexp_replace(regexp_replace(lower(netloc), '^.*@', ''), ':[0-9]*$', '') AS host",
    r"try_cast(nullif(regexp_extract(netloc, ':([0-9]+)$', 1), '') AS int) AS port",
    "CASE WHEN host = '' THEN 0 ELSE length(host) - length(replace(host, '.', '')) + 1 END AS n_labels",
    r"host RLIKE '^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^[\\[].*[\\]]$' AS is_ip",
]
NAME_COLUMNS = [
    "CASE WHEN n_labels < 2 OR is_ip THEN '' ELSE substring_index(host, '.', -1) END AS tld",
    "CASE WHEN is_ip THEN '' ELSE coalesce(sfx3, sfx2, tld) END AS suffix",
    "CASE WHEN suffix = '' THEN host ELSE left(host, greatest(length(host) - length(suffix) - 1, 0)) END AS _rest",
    "CASE WHEN is_ip THEN host ELSE substring_index(_rest, '.', -1) END AS domain_label",
    "CASE WHEN is_ip THEN '' ELSE left(_rest, greatest(length(_rest) - length(domain_label) - 1, 0)) END AS subdomain",
    "CASE WHEN suffix = '' OR domain_label = '' THEN '' ELSE concat(domain_label, '.', suffix) END AS registered_domain",
    "substring_index(replace(host, 'www.', ''), '.', 1) AS host_label",
]


def add_host_parts(df: DataFrame, suffixes: DataFrame | list[str]) -> DataFrame:
    """Add ``host, port, n_labels, is_ip, tld, suffix, registered_domain, domain_label, subdomain, host_label``.

    Public suffixes of two or three labels are looked up as a literal set while
    the list is short, else by equi joins with the suffix table; without a
    match the suffix is the last label.  ``host_label`` (first label, ``www.``
    removed) is the string compared with brands.
    """
    listed = suffixes if isinstance(suffixes, list) else bounded_values(suffixes, "suffix")
    if listed is not None:
        return df.selectExpr("*", *HOST_COLUMNS, *_suffix_columns(listed), *NAME_COLUMNS).drop("sfx2", "sfx3", "_rest")
    out = df.selectExpr("*", *HOST_COLUMNS, "substring_index(host, '.', -2) AS _last2", "substring_index(host, '.', -3) AS _last3")
    n_dots = F.length("suffix") - F.length(F.replace(F.col("suffix"), F.lit("."), F.lit("")))
    two = sized_broadcast(suffixes.where(n_dots == 1).select(F.col("suffix").alias("sfx2")))
    three = sized_broadcast(suffixes.where(n_dots == 2).select(F.col("suffix").alias("sfx3")))
    out = (out.join(two, (F.col("_last2") == F.col("sfx2")) & (F.col("n_labels") >= 2), "left")
           .join(three, (F.col("_last3") == F.col("sfx3")) & (F.col("n_labels") >= 3), "left"))
    return out.selectExpr("*", *NAME_COLUMNS).drop("sfx2", "sfx3", "_rest", "_last2", "_last3")
