"""URL tables derived from the given tables, in SQL that several engines can run.

``{part}`` and ``{pages}`` are the table references; no statement contains a
backslash, so the text means the same in every dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurewatch.session import dealt, settle, small_table

BRAND = "replace(lower(p_name), ' ', '')"

# URLs with a known look-alike technique and brand
KNOWN_SQL = f"""
SELECT k AS url_id, b AS brand, t AS technique_id,
 CASE WHEN k % 3 = 0 THEN 'http://' ELSE 'https://' END ||
 CASE t WHEN 0 THEN 'www.' || b || '.com'
  WHEN 1 THEN substr(b,1,i-1) || substr(b,i+1) || '.com'
  WHEN 2 THEN substr(b,1,i) || substr(b,i,1) || substr(b,i+1) || '.com'
  WHEN 3 THEN substr(b,1,i-1) || 'x' || substr(b,i+1) || '.com'
  WHEN 4 THEN substr(b,1,j-1) || substr(b,j+1,1) || substr(b,j,1) || substr(b,j+2) || '.com'
  WHEN 5 THEN b || '-login.com'
  WHEN 6 THEN b || '.evil-host.tk'
  WHEN 7 THEN b || '.tk'
  WHEN 8 THEN '192.168.' || CAST(k % 256 AS STRING) || '.' || CAST(k % 200 AS STRING)
  WHEN 9 THEN 'bit.ly'
  WHEN 10 THEN 'site' || CAST(k AS STRING) || '.net/' || b
  ELSE 'www' || b || '.com' END || '/p/' || CAST(k AS STRING) AS url
FROM (SELECT k, b, CAST(1 + k % length(b) AS INT) AS i, CAST(1 + k % (length(b)-1) AS INT) AS j,
             CAST(k % 12 AS INT) AS t
      FROM (SELECT p_partkey AS k, {BRAND} AS b FROM {{part}}) x) y
"""

# URLs with one obfuscation each: encodings, ports, user-info, non-ASCII, odd hosts, long paths
HOSTILE_SQL = f"""
SELECT k AS url_id,
 CASE CAST(k % 30 AS INT)
  WHEN 0 THEN 'HTTP://User@' || b || '.com:8080/Path/../x.php?next=http%3A%2F%2Fevil.tk&a=1&a=2&b=#frag'
  WHEN 1 THEN 'https://secure-' || b || '-login.verify-account.tk/login/confirm.php?session=' || md5(b)
  WHEN 2 THEN 'http://xn--' || b || '-9za.com/'
  WHEN 3 THEN 'https://' || replace(replace(b, 'o', 'о'), 'a', 'а') || 'é.com/signin'
  WHEN 4 THEN 'http://' || b || '​.com/zero'
  WHEN 5 THEN 'http://0x7f.0x0.0x0.0x1/' || b
  WHEN 6 THEN 'http://0177.00.00.01/' || b || '//x'
  WHEN 7 THEN 'http://' || CAST(100000000 + k AS STRING) || '/x'
  WHEN 8 THEN 'http://' || b || '%2ecom.evil.top/%2525%41%42%43%44login'
  WHEN 9 THEN 'www.' || b || '.co.uk/a' || CAST(k AS STRING) || '.b.c.exe'
  WHEN 10 THEN 'https://a.b.c.' || b || '.com.account-verify.xyz/urgent/verify-your-account.html?redirect=https://evil'
  WHEN 11 THEN 'http://xkcdqzvxj' || CAST(k AS STRING) || '.info/'
  WHEN 12 THEN 'https://' || b || '_' || b || '.online/~user|x/a' || CAST(k AS STRING) || ';p=1'
  WHEN 13 THEN 'ftp://files.' || b || '.org/pub' || CAST(k AS STRING) || '.tar.zip'
  WHEN 14 THEN 'https://asdfqwer' || CAST(k AS STRING) || 'zxcv.biz/'
  WHEN 15 THEN 'http://tinyurl.com/' || substr(md5(b || CAST(k AS STRING)), 1, 8)
  WHEN 16 THEN 'https://' || b || '.net/' || repeat(md5(b), 5)
  WHEN 17 THEN 'https://192.168.1.' || CAST(k % 256 AS STRING) || ':8443/' || b || '/signin'
  WHEN 18 THEN 'https://' || b || '..com/'
  WHEN 19 THEN 'data:text/html,<script>' || b
  WHEN 20 THEN 'https://' || b || b || 's1.com/'
  WHEN 21 THEN 'https://' || upper(b) || '.COM/LOGIN?Password=1&Update=Now'
  WHEN 22 THEN 'https://www.' || b || '.com/‮' || CAST(k AS STRING) || 'gpj.exe'
  WHEN 23 THEN 'http://paypal.com.' || b || '.ml/wp-admin/index.php?url=x'
  WHEN 24 THEN 'https://login-paypa1-' || CAST(k AS STRING) || '.verifyinfo-auth.com/account/suspended'
  WHEN 25 THEN 'https://' || b || 'hub.org/offers'
  WHEN 26 THEN 'http://pay' || b || '-amaz0n.support/billing/update-payment'
  WHEN 27 THEN 'https://paypal-' || b || CAST(k AS STRING) || '.com/start'
  WHEN 28 THEN 'https://young' || b || CAST(k AS STRING) || '.com/start'
  ELSE 'https://amazom.com/a' || CAST(k AS STRING) END || CASE WHEN k % 30 IN (9, 12, 13, 22) THEN '' ELSE '/q' || CAST(k AS STRING) END AS url
FROM (SELECT p_partkey AS k, {BRAND} AS b FROM {{part}}) x
"""

# every distinct URL of the given data: raw pages, known look-alikes, hostile ones
CORPUS_SQL = f"""
SELECT page_id AS url_id, 'page' AS origin, url FROM {{pages}}
UNION ALL SELECT 1000000000 + url_id AS url_id, 'known' AS origin, url FROM ({KNOWN_SQL}) kn
UNION ALL SELECT 2000000000 + url_id AS url_id, 'hostile' AS origin, url FROM ({HOSTILE_SQL}) ho
"""

BRANDS_SQL = f"SELECT DISTINCT {BRAND} AS brand FROM {{part}}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names of the parts, dealt: every URL made of them is parsed and scored at length."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"))


def known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark.sql(KNOWN_SQL, part=_names(spark, sf_dir)), ["url"])


def hostile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark.sql(HOSTILE_SQL, part=_names(spark, sf_dir)), ["url"])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "url"))
    return settle(spark.sql(CORPUS_SQL, part=_names(spark, sf_dir), pages=pages), ["url"])


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_table(spark.sql(BRANDS_SQL, part=table(spark, sf_dir, "part")))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL occurrences: one row per line item, URL of its part (many rows per URL)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    urls = known_urls(spark, sf_dir).select("url_id", "brand", "technique_id", "url")
    return li.join(urls, li.l_partkey == urls.url_id).drop("l_partkey")


_FEED = """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(url) ELSE ' ' || url || ' ' END AS url,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 2
      WHEN technique_id IN (0, 9, 10, 11) THEN CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END ELSE 1 END AS label,
 l_orderkey * 10 + l_linenumber AS ord, l_quantity AS f1, l_partkey
FROM {lineitem} l JOIN (""" + KNOWN_SQL + """) kn ON l.l_partkey = kn.url_id
"""
# two labelled feeds over URL occurrences: mixed case, blanks, conflicting, missing and invalid labels
# every line item is in a feed: even orders in A, odd ones and every third in B; every fourth order's URLs are new in B
FEED_A_SQL = f"SELECT url, label, ord, f1 FROM ({_FEED}) fe WHERE ord % 20 < 10"
FEED_B_SQL = f"""SELECT CASE WHEN ord % 40 BETWEEN 10 AND 19 THEN replace(replace(url, '/p/', '/q/'), '/P/', '/Q/') ELSE url END AS url, label, ord, f1
 FROM ({_FEED}) fe WHERE ord % 20 >= 10 OR ord % 30 < 10"""


def _feed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, part=table(spark, sf_dir, "part"), lineitem=table(spark, sf_dir, "lineitem"))


def feed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir, FEED_A_SQL)


def feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir, FEED_B_SQL)


# scored rows with a truth label: documents as items, three deterministic scores per item
SCORED_SQL = """
SELECT l.doc_id, l.quality AS label, CAST(d.n_chars % 997 AS DOUBLE) / 997 AS score, CAST(d.n_chars % 613 AS DOUBLE) / 613 AS score_b,
 CAST(d.n_chars % 211 AS DOUBLE) / 211 AS score_c, CASE WHEN d.n_chars % 997 >= 400 THEN 1 ELSE 0 END AS prediction
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""
# one row per (item, model): votes of three scorers
VOTES_SQL = f"""
SELECT doc_id, label, 'forest' AS model, score AS probability FROM ({SCORED_SQL}) s1
UNION ALL SELECT doc_id, label, 'boosted' AS model, score_b AS probability FROM ({SCORED_SQL}) s2
UNION ALL SELECT doc_id, label, 'linear' AS model, score_c AS probability FROM ({SCORED_SQL}) s3
"""
# a scan history: one row per event (decision NULL = unclear; failed scans carry an error)
SCAN_LOG_SQL = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'https://host' || CAST(user_id AS STRING) || '.com/' AS url, user_id,
 CASE event_type WHEN 'click' THEN true WHEN 'purchase' THEN NULL WHEN 'error' THEN NULL ELSE false END AS is_phishing,
 CASE WHEN event_type = 'error' THEN 'timeout' END AS error, value AS confidence
FROM {events} e
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED_SQL, labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOTES_SQL, labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCAN_LOG_SQL, events=table(spark, sf_dir, "events"))


# snapshots over the registered domains of the known URLs
# DNS facts of two days; on the first day the mail and name server flags were the other way round
DNS_SQL = f"""
WITH named AS (
 SELECT {BRAND} || '.com' AS domain, min(p_partkey) AS k FROM {{part}} GROUP BY {BRAND}
 UNION ALL SELECT {BRAND} || '-login.com' AS domain, min(p_partkey) + 1 AS k FROM {{part}} GROUP BY {BRAND}
 UNION ALL SELECT CASE CAST(p_partkey % 30 AS INT) WHEN 11 THEN 'xkcdqzvxj' || CAST(p_partkey AS STRING) || '.info' WHEN 14 THEN 'asdfqwer' || CAST(p_partkey AS STRING) || 'zxcv.biz'
  ELSE 'young' || {BRAND} || CAST(p_partkey AS STRING) || '.com' END AS domain, p_partkey AS k FROM {{part}} WHERE p_partkey % 30 IN (11, 14, 28))
SELECT domain, day AS as_of, k % 2 = 0 AS has_a, (k % 5 = 0) = (day = 2) AS has_mx, (k % 7 = 0) = (day = 2) AS has_ns,
 array('8.8.' || CAST(k % 256 AS STRING) || '.1', CASE CAST(k % 6 AS INT) WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '172.' || CAST(k % 40 AS STRING) || '.0.9'
  WHEN 2 THEN '192.168.0.7' WHEN 3 THEN '127.0.0.1' WHEN 4 THEN '300.1.1.1' ELSE 'bad' END) AS ips
FROM (SELECT domain, k, 1 AS day FROM named UNION ALL SELECT domain, k, 2 AS day FROM named) x WHERE k % 3 <> 0
"""
# registrations: known names by the orders of their parts, young ones up to a year old
WHOIS_SQL = f"""
SELECT 'young' || {BRAND} || CAST(p_partkey AS STRING) || '.com' AS domain, DATE '1998-06-30' - CAST(p_partkey % 365 AS INT) AS created FROM {{part}} WHERE p_partkey % 30 = 28
UNION ALL SELECT domain, min(o_orderdate) AS created FROM (SELECT {BRAND} || '.com' AS domain, p_partkey AS k FROM {{part}}) x
JOIN {{orders}} o ON o.o_orderkey = k GROUP BY domain
"""
REPUTATION_SQL = f"""
SELECT sha2(regexp_replace(lower(trim(url)), '/$', ''), 256) AS url_hash,
 CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'safe_browsing' WHEN 1 THEN 'scanners' WHEN 2 THEN 'sandbox' ELSE 'community' END AS service,
 CASE WHEN l_orderkey % 5 = 0 THEN 'error' WHEN l_orderkey % 11 = 0 THEN 'not_found' ELSE 'checked' END AS status, l_orderkey % 3 = 0 AS flagged,
 CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_orderkey % 7 END AS INT) AS malicious, CAST(l_suppkey % 5 AS INT) AS suspicious, CAST(l_quantity * 2 AS INT) AS score,
 l_suppkey % 3 = 0 AS verified, l_suppkey % 4 = 0 AS valid, CAST(l_shipdate AS TIMESTAMP) AS checked_at
FROM {{lineitem}} l JOIN ({KNOWN_SQL}) kn ON l.l_partkey = kn.url_id
"""
# service findings and requests for them, both events: each key is asked again and again
SERVICE_EVENTS_SQL = """
SELECT 'u' || CAST(user_id AS STRING) AS url_hash, CAST(ts AS TIMESTAMP) AS checked_at, event_id, event_type,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'safe_browsing' WHEN 1 THEN 'scanners' WHEN 2 THEN 'sandbox' ELSE 'community' END AS service,
 CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'not_found' ELSE 'checked' END AS status,
 value > 50 AS flagged, CAST(event_id % 6 AS INT) AS malicious, CAST(event_id % 9 AS INT) AS suspicious, CAST(floor(value) AS INT) AS score,
 event_id % 3 = 0 AS verified, event_id % 2 = 0 AS valid
FROM {events} e
"""
