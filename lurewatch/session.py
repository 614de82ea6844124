"""Session defaults and the two size decisions every job shares.

Nothing here schedules work: joins stay declarative and Spark (Catalyst, AQE)
picks the physical operator.  A side is only *hinted* as broadcast after its
row count has been bounded by an actual (limited) count.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000
LITERAL_LIST_MAX = 512
DEALT_ROWS = 5_000
JIT_LIMIT = "8000"  # bytes of a method that HotSpot still compiles


def build_session(app: str = "lurewatch", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.codegen.hugeMethodLimit": JIT_LIMIT,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def compiled(spark: SparkSession) -> None:
    """Have wide projections compiled: one method for a whole stage of them is beyond what HotSpot compiles and would be
    interpreted for every row; under this limit Spark runs them as separate operators, whose code is split into small methods."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, probe: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only when a limited count proves the side is small.

    ``probe`` is a cheaper frame with at least as many rows (the input of a
    ``distinct``, say): its limited count stops after ``max_rows``.  Beyond the
    bound the frame is returned as is, and the join falls back to a shuffled
    join (with AQE skew splitting).
    """
    n = (df if probe is None else probe).limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spread_left_join(df: DataFrame, side: DataFrame, on: list[str], spread: str, max_rows: int = BROADCAST_MAX_ROWS, salts: int = 32) -> DataFrame:
    """Left join of a wide frame to a side with one row per key, whatever share of the rows one key holds.

    The side is written once and counted.  A small one is broadcast, so the wide rows stay where they are; a larger one is
    repeated per salt and the wide rows are salted by a hash of their column ``spread``, so a hot key is dealt to ``salts`` tasks.
    """
    side = materialize(side)
    if side.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(side), on, "left")
    side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(side, [*on, "_salt"], "left").drop("_salt")


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Evaluate derived columns exactly once per row.

    The optimizer pushes predicates on a score below the projections that
    compute it and pastes a copy of every intermediate expression per reference
    (code beyond the JVM's method limit, and every regex evaluated again).  A
    one-element ``explode`` is narrow and stops the substitution.
    """
    keep = [c for c in df.columns if c not in columns]
    packed = df.select(*keep, F.explode(F.array(F.struct(*columns))).alias("_s"))
    return packed.select(*keep, *[F.col(f"_s.`{c}`").alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    A temporary directory is used only where nothing is configured (local tests).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lurewatch-"))
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several branches read (survives the loss of executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int = DEALT_ROWS) -> DataFrame:
    """The frame in parts of some ``rows`` rows, so that costly work per row reaches all cores.

    A file of a few MB holds millions of short rows and is read in one or two tasks, whatever is done with each row after
    that.  Nothing happens to a frame that comes in enough parts.
    """
    n = -(-df.count() // rows)
    return df.repartition(n) if n > df.rdd.getNumPartitions() else df


def small_table(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """A reference table as a local relation when it is provably small, else the frame itself."""
    rows = df.limit(max_rows + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, schema=df.schema) if rows.num_rows <= max_rows else df


def bounded_values(df: DataFrame, column: str, limit: int = LITERAL_LIST_MAX) -> list | None:
    """Distinct values of a reference column, or ``None`` when there are too many.

    At most ``limit + 1`` rows ever reach the driver; callers must have a join
    form for the ``None`` case.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return sorted(r[0] for r in rows)
