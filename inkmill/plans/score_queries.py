"""Queries over judgements. The tables hold no judge scores, so rows are derived from `events`,
deterministically: they exercise the operators and are nobody's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.scalars import binomial_tail, version_key
from inkmill.operators import scores as S
from inkmill.plans.base import Registry, table

VERSIONS = [f"v{i}" for i in range(8)]
R = Registry()


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    value = F.expr("pmod(cast(floor(value) AS INT), 10) - 4")
    text = F.when(value < 0, F.concat(F.when(F.col("event_id") % 2 == 0, "−").otherwise("-"), F.abs(value).cast("string"))).otherwise(value.cast("string"))
    credited = F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(text)
    direction = F.when(F.col("event_id") % 10 == 0, "received").when(F.col("event_id") % 17 == 0, "").otherwise("Own")
    return e.select(
        (F.col("event_id") % 3 + 1).cast("string").alias("round"), F.concat(F.lit("v"), F.col("user_id") % 8).alias("member"), F.concat(F.lit("v"), F.col("event_id") % 8).alias("opponent"),
        credited.alias("credited"), text.alias("score_as_written"), direction.alias("direction"), F.when(F.col("event_id") % 19 == 0, "").otherwise(F.col("event_type")).alias("judge"),
        F.lit("").alias("judge_index"), F.lit("").alias("sheet"), F.col("event_id").alias("ord"), F.col("ts").alias("at"),
    )


ROWS = """
WITH raw AS (
  SELECT (event_id % 3 + 1)::VARCHAR AS round, 'v' || (user_id % 8) AS member, 'v' || (event_id % 8) AS opponent,
         (((floor(value)::INT % 10) + 10) % 10) - 4 AS s, event_id % 10 = 0 AS received, event_id % 17 = 0 AND event_id % 10 <> 0 AS nodir,
         CASE WHEN event_id % 19 = 0 THEN '' ELSE event_type END AS judge, event_id AS ord, ts AS made
  FROM events WHERE value IS NOT NULL),
labelled AS (
  SELECT *, CASE WHEN received OR nodir THEN 'direction' WHEN member = opponent THEN 'incomplete' WHEN s NOT BETWEEN -4 AND 4 THEN 'range' ELSE 'ok' END AS status FROM raw),
ranked AS (
  SELECT *, row_number() OVER w AS rn, first_value(s) OVER w AS first_s FROM labelled WHERE status = 'ok'
  WINDOW w AS (PARTITION BY round, member, opponent, judge ORDER BY ord)),
votes AS (SELECT *, judge = '' OR rn = 1 AS kept FROM ranked)
"""


def _pair(how: str, pool: bool = False):
    return lambda s, d: S.pair_scores(score_rows(s, d), how, pool)


for _how, _sql in (("mean", "avg(s)"), ("median", "median(s)"), ("sum", "sum(s)::DOUBLE")):
    R.add(f"pair_score_{_how}", _pair(_how), ROWS + f"SELECT round, member, opponent, count(*) AS n, {_sql} AS score FROM votes WHERE kept GROUP BY 1, 2, 3")
R.add("pair_score_pooled", _pair("mean", True), ROWS + "SELECT 'all' AS round, member, opponent, count(*) AS n, avg(s) AS score FROM votes WHERE kept GROUP BY 2, 3")
R.add(
    "pair_matrix", lambda s, d: S.pair_matrix(score_rows(s, d), VERSIONS),
    ROWS + "SELECT member, " + ", ".join(f"avg(s) FILTER (opponent = '{v}') AS {v}" for v in VERSIONS) + " FROM votes WHERE kept GROUP BY 1",
)
R.add(
    "score_skips", lambda s, d: S.labelled_scores(score_rows(s, d)).groupBy("status").agg(F.count("*").alias("n")),
    ROWS + "SELECT status, count(*) AS n FROM labelled GROUP BY 1",
)
R.add(
    "vote_dedup", lambda s, d: S.votes(score_rows(s, d)).groupBy("member", "opponent").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("repeats"), F.count_if("conflict").alias("conflicts")),
    ROWS + "SELECT member, opponent, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS repeats, count(*) FILTER (NOT kept AND s <> first_s) AS conflicts FROM votes GROUP BY 1, 2",
)
_POOLED = ROWS + ", p AS (SELECT member, opponent, avg(s) AS score FROM votes WHERE kept GROUP BY 1, 2) "


def _pooled(s, d):
    return S.pair_scores(score_rows(s, d), "mean", True)


R.add(
    "received_mirror", lambda s, d: S.mirrored(_pooled(s, d)),
    _POOLED + "SELECT member, opponent, score, 'own' AS direction FROM p UNION ALL SELECT opponent, member, -score, 'received' FROM p",
)
R.add(
    "both_directions", lambda s, d: S.both_directions(_pooled(s, d)),
    _POOLED + """SELECT a.member, a.opponent, a.score AS left_score, b.score AS right_score, abs(a.score + b.score) < 1e-9 AS negation,
    sign(a.score) * sign(b.score) > 0 AS flip FROM p a JOIN p b ON a.member = b.opponent AND a.opponent = b.member WHERE a.member < a.opponent""",
)
R.add(
    "member_stats", lambda s, d: S.member_stats(score_rows(s, d), "v0"),
    ROWS + """SELECT member, count(*) AS n, median(s) AS median, avg(s) AS mean,
    CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(s, 0.75) - quantile_cont(s, 0.25) END::DOUBLE AS iqr,
    count(*) FILTER (s > 0) AS wins, count(*) FILTER (s < 0) AS losses, count(*) FILTER (s = 0) AS ties,
    median(s) FILTER (opponent = 'v0') AS vs_base, count(*) FILTER (opponent = 'v0' AND s <> 0) AS base_decided,
    count(*) FILTER (opponent = 'v0' AND s < 0) AS base_losses FROM votes WHERE kept GROUP BY 1""",
)


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a version holds against the base: no evidence fails, else a one-sided test of the
    decided votes, or (`median_holds`) their median."""
    stats = S.member_stats(score_rows(spark, sf_dir), "v0")
    p = binomial_tail(F.col("base_losses").cast("int"), F.col("base_decided").cast("int"))
    verdict = lambda holds: F.when(F.col("member") == "v0", F.lit(None)).when(F.col("vs_base").isNull(), F.lit(False)).otherwise(holds)
    return stats.select("member", F.round(p, 9).alias("p"), verdict(~(p < 0.05)).alias("passes"), verdict(F.col("vs_base") >= 0).alias("median_holds"))


R.add(
    "sign_test", sign_test,
    ROWS + """, m AS (SELECT member, count(*) FILTER (opponent = 'v0' AND s <> 0) AS n, count(*) FILTER (opponent = 'v0' AND s < 0) AS k, median(s) FILTER (opponent = 'v0') AS v FROM votes WHERE kept GROUP BY 1),
    i AS (SELECT unnest(range(0, (SELECT max(n) FROM m) + 1)) AS i),
    t AS (SELECT member, v, CASE WHEN n <= 0 THEN 1.0::DOUBLE ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i.i + 1) - lgamma(n - i.i + 1) - n * ln(2.0::DOUBLE))) FROM i WHERE i.i BETWEEN k AND n) END AS p FROM m)
    SELECT member, round(p, 9) AS p, CASE WHEN member = 'v0' THEN NULL WHEN v IS NULL THEN false ELSE NOT (p < 0.05) END AS passes, CASE WHEN member = 'v0' THEN NULL WHEN v IS NULL THEN false ELSE v >= 0 END AS median_holds FROM t""",
)
R.add(
    "panel_quality", lambda s, d: S.panel_quality(score_rows(s, d)),
    ROWS + "SELECT judge, count(*) AS n, count(*) FILTER (s = 0) / count(*) AS zero_share, avg(abs(s)) AS mean_abs, max(abs(s))::DOUBLE AS max_abs, avg(s) AS mean FROM votes WHERE kept GROUP BY 1",
)
R.add(
    "score_histogram", lambda s, d: S.votes(score_rows(s, d)).where("kept").groupBy("judge", "score").agg(F.count("*").alias("n")),
    ROWS + "SELECT judge, s::DOUBLE AS score, count(*) AS n FROM votes WHERE kept GROUP BY 1, 2",
)
R.add(
    "newest_sheet", lambda s, d: S.newest_per_slot(score_rows(s, d)).select("member", "judge", "ord"),
    ROWS + "SELECT member, judge, ord FROM raw QUALIFY row_number() OVER (PARTITION BY member, judge ORDER BY made DESC, ord DESC) = 1",
)


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    labels = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("user_id") % 3, F.lit("_i"), F.col("event_id") % 12).alias("label")).distinct()
    labels = labels.union(spark.createDataFrame([("orig",), ("a2",), ("a10",)], "label string"))
    # A few dozen distinct labels: one ordered partition is enough.
    return labels.select("label", F.row_number().over(Window.orderBy(version_key(F.col("label")))).alias("place"))


R.add(
    "version_order", version_order,
    """WITH l AS (SELECT DISTINCT 'r' || (user_id % 3) || '_i' || (event_id % 12) AS label FROM events UNION ALL SELECT unnest(['orig', 'a2', 'a10']))
    SELECT label, row_number() OVER (ORDER BY label <> 'orig', regexp_extract(label, '^[a-z]+'), regexp_extract(label, '([0-9]+)', 1)::INT NULLS FIRST, coalesce(try_cast(regexp_extract(label, '_i([0-9]+)', 1) AS INT), -1)) AS place
    FROM (SELECT CASE WHEN label = 'orig' THEN 'orig' ELSE label END AS label FROM l) WHERE label <> 'orig' OR true""".replace("regexp_extract(label, '([0-9]+)', 1)::INT NULLS FIRST", "try_cast(regexp_extract(label, '([0-9]+)', 1) AS INT) NULLS FIRST"),
)
QUERIES, ORACLE_SQL = R.queries, R.sql
