"""SQL surface: functions registered in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lurewatch import refdata
from lurewatch.functions.punycode import decode_label_udf
from lurewatch.functions.similarity import jaro_winkler_udf, sequence_ratio_udf


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")"


def register_functions(spark: SparkSession) -> None:
    """Register ``jaro_winkler``, ``sequence_ratio``, ``decode_label``, ``url_hash`` and ``lookalike_names(brand)``.

    The last returns an array of rows: ``FROM (SELECT lookalike_names(brand) AS vs FROM t) LATERAL VIEW inline(vs) v``.
    """
    spark.udf.register("jaro_winkler", jaro_winkler_udf())
    spark.udf.register("sequence_ratio", sequence_ratio_udf())
    spark.udf.register("decode_label", decode_label_udf())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION url_hash(url STRING) RETURNS STRING "
              "RETURN sha2(regexp_replace(lower(trim(url)), '/$', ''), 256)")
    i = "substr(b, 1, p - 1)"
    near, looks = _map(refdata.VARIANT_KEYBOARD), _map(refdata.VARIANT_LOOKALIKE)
    row = "ARRAY<STRUCT<kind: STRING, position: INT, variant: STRING>>"

    def one(kind: str, variant: str) -> str:
        return f"named_struct('kind', '{kind}', 'position', p, 'variant', {variant})"

    def each(kind: str, variant: str) -> str:
        return f"transform(sequence(1, length(b)), p -> {one(kind, variant)})"

    keyed = f"transform(filter(split(coalesce({near}[substr(b, p, 1)], ''), ''), c -> c <> ''), c -> {one('keyboard', f'concat({i}, c, substr(b, p + 1))')})"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION every_lookalike(b STRING) RETURNS {row}
RETURN concat(
  {each('omission', f"concat({i}, substr(b, p + 1))")}, flatten(transform(sequence(1, length(b)), p -> {keyed})),
  {each('doubling', "concat(substr(b, 1, p), substr(b, p))")},
  {each('swap', f"IF(p < length(b), concat({i}, substr(b, p + 1, 1), substr(b, p, 1), substr(b, p + 2)), b)")},
  {each('lookalike', f"concat({i}, coalesce({looks}[substr(b, p, 1)], substr(b, p, 1)), substr(b, p + 1))")})""")
    # each name once, under its first kind and position, as the table form gives it
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION lookalike_names(b STRING) RETURNS {row}
RETURN element_at(transform(array(every_lookalike(b)), a -> filter(a, (v, n) -> v.variant <> b AND array_position(transform(a, x -> x.variant), v.variant) = n + 1)), 1)""")
