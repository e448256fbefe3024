"""The queries of the problems 1, 6, 7 and 8 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import packing, percentiles, splitting, tokens
from gridloom.session import cut, spread_out, table

CHARACTERS = 8192


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles_of(table(spark, sf_dir, "series"), table(spark, sf_dir, "sweep"))


def p1_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's percentiles held against all its values; the SQL counts the same values."""
    held = percentiles.rank_errors(table(spark, sf_dir, "series"), table(spark, sf_dir, "sweep"))
    return held.withColumn("run_day", held["run_day"].cast("string"))


def p1_small_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of buffers of 64 values, which collapse often: every percentile is held against the bound that its sketch carries."""
    held = percentiles.rank_errors(table(spark, sf_dir, "series"), table(spark, sf_dir, "sweep"), allowed=None, k=64)
    return held.withColumn("run_day", held["run_day"].cast("string"))


def p1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of the groups that fit into one buffer: there the sketch is exact."""
    held = p1_percentiles(spark, sf_dir).where(F.col("n") <= percentiles.K)
    return held.withColumn("run_day", held["run_day"].cast("string"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_documents(spark, sf_dir))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, decoded from their ids; a null text has the ids of an empty one."""
    return tokens.decode_ids(tokens.encode(_documents(spark, sf_dir)))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the characters of a text's tokens reach, and whether they follow each other without gaps."""
    s = tokens.encode_spans(_documents(spark, sf_dir))
    gaps = F.expr("exists(sequence(1, size(starts)), i -> i < size(starts) and starts[i] > ends[i - 1])")
    return s.select("doc_id", F.coalesce(F.array_max("ends"), F.lit(0)).cast("bigint").alias("chars"), F.when(F.size("starts") > 0, gaps | (F.col("starts")[0] > 0)).otherwise(False).alias("gaps"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_counts(_documents(spark, sf_dir)), "doc_id", "tokens")


def p7_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing by characters, which SQL can count: of each speech the pieces, their sum, and whether their containers hold what they say and no more than fits."""
    packed = cut(packing.pack(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("chars")), "doc_id", "chars", CHARACTERS))
    fills = packed.groupBy("bin").agg(F.sum("tokens").alias("sum"))
    fits = (F.col("sum") == F.col("fill")) & (F.col("sum") <= CHARACTERS)
    return packed.join(fills, "bin").groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("chars"), F.bool_and(fits).alias("fits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(_documents(spark, sf_dir)).where("piece_no = 1").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_rank_errors, p1_small_buffers, p1_exact, p6_ids, p6_texts, p6_spans, p7_containers, p7_by_characters, p8_found, p8_pieces)}

_VALUES = """WITH s AS (SELECT DISTINCT * FROM series), w AS (SELECT DISTINCT * FROM sweep),
v AS (SELECT 'series.saidi' AS measure, graph_id, run_day, saidi AS v FROM s UNION ALL SELECT 'series.p', graph_id, run_day, p FROM s
 UNION ALL SELECT 'sweep.rel', graph_id, CAST(run_at AS DATE), unnest(rel) FROM w UNION ALL SELECT 'sweep.p', graph_id, CAST(run_at AS DATE), unnest(p) FROM w),
f AS (SELECT measure, graph_id, run_day, v + 0.0 AS v FROM v WHERE v IS NOT NULL AND isfinite(v) AND v >= 0)"""

_GROUPS = f"""{_VALUES}
SELECT measure, 'day' AS period, graph_id, CAST(run_day AS VARCHAR) AS run_day, count(*) AS n, true AS within FROM f GROUP BY measure, graph_id, run_day
UNION ALL SELECT measure, 'all', graph_id, NULL, count(*), true FROM f GROUP BY measure, graph_id"""

_NEAREST = ", ".join(f"l[CAST(greatest(1, ceil({p} / 100 * n - 1e-9)) AS BIGINT)] AS p{p:02d}" for p in percentiles.PERCENTILES)
_EXACT = f"""{_VALUES}, g AS (SELECT measure, 'day' AS period, graph_id, CAST(run_day AS VARCHAR) AS run_day, count(*) AS n, list_sort(list(v)) AS l FROM f GROUP BY measure, graph_id, run_day
 UNION ALL SELECT measure, 'all', graph_id, NULL, count(*), list_sort(list(v)) FROM f GROUP BY measure, graph_id)
SELECT measure, period, graph_id, run_day, n, {_NEAREST}, 0.0 AS max_rank_error FROM g WHERE n <= {percentiles.K}"""

SQL: dict[str, str] = {
    "p1_exact": _EXACT,
    "p7_by_characters": f"SELECT doc_id, CAST(greatest(1, ceil(coalesce(n_chars, 0) / {CHARACTERS})) AS BIGINT) AS pieces, CAST(coalesce(n_chars, 0) AS BIGINT) AS chars, true AS fits FROM documents",
    "p1_rank_errors": _GROUPS,
    "p1_small_buffers": _GROUPS,
    "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_spans": "SELECT doc_id, coalesce(length(text), 0) AS chars, false AS gaps FROM documents",
}
