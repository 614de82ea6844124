"""DuckDB statements for sources and corpus building."""

from __future__ import annotations

from lurewatch.plans import fixtures as fx
from oracles.common import CORPUS, KNOWN

T = {"part": "part", "lineitem": "lineitem"}
A, B = fx.FEED_A_SQL.format(**T), fx.FEED_B_SQL.format(**T)
FEEDS = f"a AS ({A}), b AS ({B})"
NORM = "lower(trim(url, ' '))"
LIFE = f"""life AS (SELECT CAST(o_orderkey AS VARCHAR) AS phish_id, CASE WHEN o_orderkey % 9 > 0 THEN url END AS url, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS submission_time,
  o_orderstatus = 'F' AS verified, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS verification_time, o_orderstatus = 'O' AS online, brand AS target, 1::BIGINT AS label
  FROM orders JOIN ({KNOWN}) k ON o_custkey = url_id)"""
MERGE = f"""{FEEDS},
da AS (SELECT {NORM} AS n, url, label, f1 AS f FROM a QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY ord, f1) = 1),
db AS (SELECT {NORM} AS n, url, label, f1 AS f FROM b QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY ord, f1) = 1),
merged AS (SELECT coalesce(da.n, db.n) AS url_normalized, coalesce(da.url, db.url) AS url,
  CAST(CASE WHEN da.label IS NOT NULL AND db.label IS NOT NULL AND da.label <> db.label THEN 1 ELSE coalesce(da.label, db.label) END AS BIGINT) AS label,
  CASE WHEN da.n IS NULL THEN 'b' WHEN db.n IS NULL THEN 'a' ELSE 'a|b' END AS sources, round(da.f, 6) AS f_a, round(db.f, 6) AS f_b FROM da FULL JOIN db ON da.n = db.n)"""
HASH = "md5('42:' || url)"

ORACLES = {
    "labelled_csv_feed": f"WITH {FEEDS} SELECT url, CAST(label AS BIGINT) AS label, 'vendor_b' AS source, CAST(ord AS BIGINT) AS ord, round(f1, 6) AS f1 FROM b",
    "line_feed": f"SELECT trim(url, ' ') AS url, 1::BIGINT AS label, 'open_list' AS source FROM ({CORPUS}) c WHERE url_id % 10 <> 0 AND trim(url, ' ') <> ''",
    "url_list": f"SELECT url FROM ({KNOWN}) k",
    "json_feed": f"SELECT url, 1::BIGINT AS label, 'json_feed' AS source FROM ({KNOWN}) k WHERE url_id % 7 > 0",
    "json_array_feed": f"SELECT url, 1::BIGINT AS label, 'json_array' AS source FROM ({KNOWN}) k WHERE url_id % 7 > 0",
    "partitioned_feed": f"SELECT url_id, url, '2024-03-15' AS snapshot_date FROM ({KNOWN}) k WHERE url_id % 3 = 0",
    "commented_csv_feed": f"SELECT url, 1::BIGINT AS label, 'commented' AS source FROM ({KNOWN}) k WHERE url_id % 5 <> 0 AND url_id % 7 <> 0",
    "ranked_domains": "SELECT 'https://site' || CAST(o_custkey AS VARCHAR) || '.com' AS url, CAST(o_orderkey + 1 AS BIGINT) AS rank, 0::BIGINT AS label, 'ranked' AS source FROM orders ORDER BY o_orderkey LIMIT 10000",
    "lifecycle_feed": f"WITH {LIFE} SELECT * FROM life WHERE url IS NOT NULL",
    "latest_lifecycle_snapshot": f"WITH {LIFE} SELECT *, '20240315' AS snapshot_date FROM life WHERE url IS NOT NULL AND online",
    "corpus_sink_roundtrip": f"""WITH {FEEDS}, c AS (SELECT url, label, f1 FROM a WHERE label IN (0, 1) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord, f1) = 1)
SELECT 'vendor_a' AS source, CAST(label AS BIGINT) AS label, count(*) AS n, count(DISTINCT url) AS n_urls, round(sum(f1), 6) AS sum_f1, CAST(sum(length(url)) AS BIGINT) AS n_chars FROM c GROUP BY label""",
    "keep_first_dedupe": f"""WITH {FEEDS} SELECT {NORM} AS url_normalized, url, CAST(label AS BIGINT) AS label, CAST(ord AS BIGINT) AS ord, round(f1, 6) AS f1 FROM a
QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY ord, f1, label NULLS FIRST) = 1""",
    "merged_corpus": f"WITH {MERGE} SELECT * FROM merged",
    "common_urls": f"WITH {FEEDS} SELECT count(*) AS n_common FROM (SELECT {NORM} FROM a INTERSECT SELECT {NORM} FROM b) x",
    "common_url_set": f"WITH {FEEDS} SELECT {NORM} AS url_normalized FROM a INTERSECT SELECT {NORM} FROM b",
    "supplemented_corpus": f"""WITH {FEEDS}, s AS (SELECT url, label FROM a), u AS (SELECT * FROM s UNION ALL SELECT url, label FROM b WHERE {NORM} NOT IN (SELECT {NORM} FROM s))
SELECT url, CAST(label AS BIGINT) AS label, count(*) AS n FROM u GROUP BY ALL""",
    "urls_not_held": f"WITH {FEEDS} SELECT DISTINCT url FROM b WHERE {NORM} NOT IN (SELECT {NORM} FROM a)",
    "cleaned_corpus": f"""WITH {FEEDS} SELECT url, CAST(label AS BIGINT) AS label, CAST(ord AS BIGINT) AS ord, round(f1, 6) AS f1 FROM b WHERE label IN (0, 1)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord, f1, label) = 1""",
    "feed_union": f"""WITH {FEEDS}, u AS (SELECT 'a' AS source, label, url FROM a UNION ALL SELECT 'pages', NULL, url FROM pages)
SELECT source, CAST(label AS BIGINT) AS label, count(*) AS n, count(DISTINCT url) AS n_urls FROM u GROUP BY source, label""",
    "first_source_union": f"""WITH {FEEDS}, u AS (SELECT url, 1 AS label, 0 AS p FROM b UNION ALL SELECT url, coalesce(label, 0), 1 FROM a UNION ALL SELECT url, 0, 2 FROM pages)
SELECT url, CAST(label AS BIGINT) AS label FROM u WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY p, label) = 1""",
    "www_variants": f"""WITH s AS (SELECT url, url_id AS rank FROM ({KNOWN}) k), h AS (SELECT url FROM s)
SELECT url, false AS generated FROM s UNION ALL SELECT CASE WHEN contains(url, 'www.') THEN replace(url, 'www.', '') ELSE 'https://www.' || replace(url, 'https://', '') END, true FROM h""",
    "seeded_sample": f"SELECT url_id, url FROM ({CORPUS}) c ORDER BY {HASH}, url LIMIT 1000",
    "balanced_classes": f"""WITH d AS (SELECT url, CAST(CASE WHEN technique_id IN (1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS label FROM ({KNOWN}) k),
g AS (SELECT * FROM d WHERE label = 0 QUALIFY row_number() OVER (ORDER BY {HASH}, url) <= (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM d))
SELECT * FROM d WHERE label = 1 UNION ALL SELECT * FROM g""",
    "label_distribution": f"WITH {MERGE} SELECT label, count(*) AS n_urls FROM merged GROUP BY label",
    "corpus_statistics": f"""WITH {FEEDS} SELECT count(*) AS total_urls, CAST(count(*) FILTER (label = 0) AS BIGINT) AS legitimate_urls, CAST(count(*) FILTER (label = 1) AS BIGINT) AS phishing_urls,
round(count(*) FILTER (label = 1) / count(*), 6) AS phishing_ratio, 2::BIGINT AS num_features,
CAST(count(*) FILTER (label IS NULL) + count(*) FILTER (url IS NULL) + count(*) FILTER (ord IS NULL) + count(*) FILTER (f1 IS NULL) AS BIGINT) AS missing_values,
count(*) - count(DISTINCT url) AS duplicate_urls FROM a""",
}
