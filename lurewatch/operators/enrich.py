"""Enrichment by snapshot tables: cached verdicts, DNS, WHOIS, address ranges, reputation feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch import refdata
from lurewatch.functions import text as X
from lurewatch.session import sized_broadcast

PRIVATE_RANGES = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8)]  # fixed values (RFC 1918, loopback)
NEW_DAYS, YOUNG_DAYS = 30, 180  # fixed values: domain age bands


# --- cached verdicts (as-of with time to live) --------------------------------

def asof_verdicts(requests: DataFrame, cache: DataFrame, ttl: int, slot: int | None = None) -> DataFrame:
    """Newest cached verdict not older than ``ttl`` seconds at each request: adds ``verdict, checked_us, is_hit``.

    ``requests``: ``key, us`` (microseconds) and any payload; ``cache``: ``key,
    us, verdict``.  Time is cut into slots: inside a slot requests and verdicts
    meet in one ordered pass, across slots only the last verdict per (key, slot)
    travels.  So a key holding a third of all rows is split by time and no pair
    of request and verdict is ever materialised.
    """
    slot_us = (slot or max(1, ttl // 600)) * 1_000_000
    ttl_us = ttl * 1_000_000
    span = -(-ttl_us // slot_us) + 1  # slots a verdict can reach forward
    payload = [c for c in requests.columns if c not in ("key", "us")]
    at = lambda df: df.withColumn("slot", F.floor(F.col("us") / slot_us))
    req = at(requests).withColumn("req", F.struct(*payload)).select("key", "us", "slot", "req", F.lit(1).alias("kind"))
    ver = at(cache).select("key", "us", "slot", F.struct("us", "verdict").alias("v"), F.lit(0).alias("kind"))
    both = req.withColumn("v", F.lit(None).cast(ver.schema["v"].dataType)).unionByName(ver.withColumn(
        "req", F.lit(None).cast(req.schema["req"].dataType)))
    w = Window.partitionBy("key", "slot").orderBy("us", "kind", "v.verdict").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("near", F.last("v", ignorenulls=True).over(w)).where("kind = 1").select("key", "us", "slot", "req", "near")
    # last verdict of each (key, slot), carried to the request slots within reach; blocks of `span` slots bound the window
    last = ver.groupBy("key", "slot").agg(F.max("v").alias("v"))
    block = lambda c: F.floor(c / span)
    marks = inside.select("key", "slot").distinct().select(
        "key", "slot", block(F.col("slot")).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast(ver.schema["v"].dataType).alias("v"))
    feed = last.select("key", "slot", F.explode(F.array(block(F.col("slot")), block(F.col("slot")) + 1)).alias("block"),
                       F.lit(1).alias("kind"), "v")
    wb = Window.partitionBy("key", "block").orderBy("slot", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marks.unionByName(feed).withColumn("far", F.last("v", ignorenulls=True).over(wb)).where("kind = 0").select("key", "slot", "far")
    out = inside.join(carried, ["key", "slot"], "left")
    v = F.coalesce("near", "far")
    fresh = F.coalesce(F.col("us") - v["us"] < ttl_us, F.lit(False))
    return out.select("key", "us", "req.*", F.when(fresh, v["verdict"]).alias("verdict"), F.when(fresh, v["us"]).alias("checked_us"),
                      fresh.alias("is_hit"))


# --- DNS / WHOIS / address snapshots -------------------------------------------

def latest_facts(snapshot: DataFrame, as_of: Column | None = None, key: str = "domain") -> DataFrame:
    """One row per key: the newest one at or before ``as_of`` (all rows count where it is None).

    Snapshots without an ``as_of`` column hold one state, of which repeated rows are dropped.
    """
    if "as_of" not in snapshot.columns:
        return snapshot.dropDuplicates([key])
    rows = snapshot if as_of is None else snapshot.where(F.col("as_of") <= as_of)
    facts = [c for c in snapshot.columns if c not in (key, "as_of")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*facts), "as_of").alias("_f")).select(key, "_f.*")


def _spread(parts: DataFrame, asked: Column | None = None) -> DataFrame:
    """Join key of the registered domain; rows without one (IP and nameless hosts), and rows that are not ``asked``, are
    dealt over many keys that match nothing."""
    ids = F.col("url_id") if "url_id" in parts.columns else F.lit(0)
    empty = F.concat(F.lit("#"), F.pmod(F.xxhash64(ids), F.lit(1024)).cast("string"))
    none = F.coalesce("registered_domain", F.lit("")) == ""
    if asked is not None:
        none = none | ~F.coalesce(asked, F.lit(False))
    return parts.withColumn("_domain", F.when(none, empty).otherwise(F.col("registered_domain")))


def with_dns(parts: DataFrame, dns: DataFrame, as_of: Column | None = None, asked: Column | None = None) -> DataFrame:
    """Left join on the registered domain: ``has_a, has_mx, has_ns, exists_in_dns`` (absent = false); newest snapshot at ``as_of``.

    Rows that are not ``asked`` look nothing up.
    """
    d = latest_facts(dns, as_of).select(F.col("domain").alias("_domain"), "has_a", "has_mx", "has_ns")
    f = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return _spread(parts, asked).join(d, "_domain", "left").select(
        *parts.columns, f("has_a"), f("has_mx"), f("has_ns"),
        F.coalesce(F.col("has_a") | F.col("has_mx") | F.col("has_ns"), F.lit(False)).alias("exists_in_dns"))


def with_domain_age(parts: DataFrame, whois: DataFrame, as_of: Column, asked: Column | None = None) -> DataFrame:
    """Age in days at ``as_of`` and its threat (under 30 days 40, under 180 days 20); an age of 0 counts.

    Rows that are not ``asked`` look nothing up.
    """
    w = latest_facts(whois, as_of).select(F.col("domain").alias("_domain"), "created")
    age = F.datediff(as_of, F.col("created"))
    threat = F.when(age < NEW_DAYS, 40).when(age < YOUNG_DAYS, 20).otherwise(0)
    return _spread(parts, asked).join(w, "_domain", "left").select(
        *parts.columns, age.alias("domain_age_days"), F.when(age.isNotNull(), threat).otherwise(0).alias("age_threat"))


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 as bigint, NULL when malformed."""
    p = F.split(ip, r"\.")
    n = [F.try_element_at(p, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    ok = (F.size(p) == 4) & n[0].between(0, 255) & n[1].between(0, 255) & n[2].between(0, 255) & n[3].between(0, 255)
    return F.when(ok, ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3])


def private_addresses(resolved: DataFrame, ips: str = "ips") -> DataFrame:
    """Range join of exploded addresses with the private ranges: rows ``domain, ip, low`` that match.

    The range table has four rows, so it enters as a literal filter over the exploded addresses.
    """
    rows = resolved.select("domain", F.explode(ips).alias("ip")).withColumn("n", ipv4_number(F.col("ip")))
    hit = F.lit(None).cast("string")
    for base, bits in PRIVATE_RANGES:
        a, b, c, d = (int(x) for x in base.split("."))
        lo = ((a * 256 + b) * 256 + c) * 256 + d
        hit = F.when(F.col("n").between(lo, lo + 2 ** (32 - bits) - 1), F.lit(base)).otherwise(hit)
    return rows.withColumn("low", hit).where(F.col("low").isNotNull()).select("domain", "ip", "low")


# --- reputation ------------------------------------------------------------------

SERVICES = ["safe_browsing", "scanners", "sandbox", "community"]
# Seconds that a service's finding stays valid
SERVICE_TTL = {"safe_browsing": 3600, "scanners": 3600, "sandbox": 3600, "community": 86400}
#: What a service reports about a URL; ``status`` is checked, not_found or error.
FINDING = ["status", "flagged", "malicious", "suspicious", "score", "verified", "valid"]


def _finding(reputation: DataFrame) -> Column:
    """A row's finding, by check time; facts that the table does not have are null (false for the flags)."""
    empty = {"flagged": False, "verified": False, "valid": False}
    has = lambda c: F.col(c) if c in reputation.columns else F.lit(empty.get(c)).cast("boolean" if c in empty else "int")
    return F.struct("checked_at", *[has(c).alias(c) for c in FINDING])


def service_findings(reputation: DataFrame, as_of: Column | None = None, ttl: dict[str, int] = SERVICE_TTL, services: list[str] = SERVICES) -> DataFrame:
    """``url_hash`` and a struct per service: its newest finding at ``as_of`` that has not expired (null: none).

    Each service has a time to live of its own (seconds).  Failed checks say nothing and hide no older finding; of
    findings at one time the greater row counts.  Without ``as_of`` the newest finding counts, whatever its age.  One
    aggregate that combines before its shuffle, so a URL that holds many rows costs one row per task.
    """
    rows = reputation.where(F.col("status") != "error")
    if as_of is not None:
        alive = F.create_map(*[x for s in services for x in (F.lit(s), F.lit(ttl[s]).cast("long"))])
        age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("checked_at")
        rows = rows.where((age >= 0) & (age < F.try_element_at(alive, F.col("service")) * F.lit(1_000_000)))
    found = _finding(reputation)
    return rows.groupBy("url_hash").agg(*[F.max(F.when(F.col("service") == s, found)).alias(s) for s in services])


def reputation_wide(urls: DataFrame, reputation: DataFrame, as_of: Column | None = None, ttl: dict[str, int] = SERVICE_TTL, services: list[str] = SERVICES) -> DataFrame:
    """``urls`` (with ``url_hash``) and, per service, the facts of its newest valid finding (``<service>_<fact>``)."""
    p = service_findings(reputation, as_of, ttl, services)
    p = p.select("url_hash", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in services for c in FINDING])
    return urls.join(p, "url_hash", "left")


def asof_findings(requests: DataFrame, reputation: DataFrame, ttl: dict[str, int] = SERVICE_TTL, services: list[str] = SERVICES) -> DataFrame:
    """Per request and service, the newest finding at the request's own time that has not expired by then.

    ``requests``: ``url_hash, us`` (microseconds) and any payload; the result has ``service, checked_us`` and the finding's
    facts besides (null where there is none).  The as-of pass runs once for all services, on (URL, service) and with the
    longest time to live; each service's own then decides.
    """
    payload = [c for c in requests.columns if c not in ("url_hash", "us")]
    key = F.concat_ws("|", "url_hash", "service")
    asked = requests.withColumn("service", F.explode(F.array(*map(F.lit, services)))).select(key.alias("key"), "us", "url_hash", "service", *payload)
    rows = reputation.where((F.col("status") != "error") & F.col("service").isin(services))
    cache = rows.select(key.alias("key"), F.unix_micros("checked_at").alias("us"), _finding(reputation).alias("verdict"))
    out = asof_verdicts(asked, cache, max(ttl[s] for s in services))
    alive = F.create_map(*[x for s in services for x in (F.lit(s), F.lit(ttl[s]).cast("long"))])
    fresh = F.col("is_hit") & (F.col("us") - F.col("checked_us") < alive[F.col("service")] * F.lit(1_000_000))
    return out.select("url_hash", "us", *payload, "service", F.when(fresh, F.col("checked_us")).alias("checked_us"),
                      *[F.when(fresh, F.col(f"verdict.{c}")).alias(c) for c in FINDING])


def flag_ratio(reputation: DataFrame) -> DataFrame:
    """Per URL: services checked, services flagging, and their ratio."""
    done = F.col("status") == "checked"
    return reputation.groupBy("url_hash").agg(
        F.count_if(done).alias("n_checked"), F.count_if(done & F.col("flagged")).alias("n_flagged"),
        F.coalesce(F.try_divide(F.count_if(done & F.col("flagged")).cast("double"), F.count_if(done)), F.lit(0.0)).alias("flag_ratio"))


# --- domain classification and gating ---------------------------------------------

def classify_domains(df: DataFrame) -> DataFrame:
    """Existence x garbage x age: ``classification, threat_level, confidence`` (needs ``exists_in_dns, is_garbage, domain_age_days``)."""
    e, g, age = F.col("exists_in_dns"), F.col("is_garbage"), F.col("domain_age_days")
    brand = X.any_of("lower(domain_label)", refdata.ABSENT_DOMAIN_BRANDS)
    return df.select(
        "*", F.when(~F.col("tld_valid"), "INVALID_TLD").when(g & ~e, "RANDOM_GARBAGE_NOT_ON_INTERNET").when(~e, "NOT_ON_INTERNET")
        .when(g, "EXISTS_BUT_SUSPICIOUS").otherwise("REAL_DOMAIN_EXISTS").alias("classification"),
        F.when(~F.col("tld_valid"), 5).when(g & ~e, 10).when(~e & brand, 90).when(~e, 60).when(g, 70)
        .when(age < NEW_DAYS, 40).when(age < YOUNG_DAYS, 20).otherwise(0).alias("threat_level"),
        F.when(~F.col("tld_valid"), 0.0).when(g & ~e, 0.95).when(~e, 0.90).when(g, 0.75).otherwise(0.85).alias("domain_confidence"))


def gated(scored: DataFrame, enrich, risk: str = "risk_score", at_least: int = 15) -> DataFrame:
    """Two-stage gate: only rows with enough risk take the expensive ``enrich`` step; the rest pass by unchanged."""
    hot = enrich(scored.where(F.col(risk) >= at_least)).withColumn("enriched", F.lit(True))
    cold = scored.where(F.coalesce(F.col(risk) < at_least, F.lit(True))).withColumn("enriched", F.lit(False))
    return hot.unionByName(cold, allowMissingColumns=True)
