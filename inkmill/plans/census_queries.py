"""Queries over the defect census, on ledger rows derived from `events`, and over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import census as C
from inkmill.operators import scores as S
from inkmill.plans.base import Registry, table
from inkmill.plans.score_queries import ROWS, score_rows

FLOOR = 20
R = Registry()


def defect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    tiers, severities = F.array(*map(F.lit, C.TIERS)), F.array(*map(F.lit, C.SEVERITIES))
    return e.select(
        F.concat(F.lit("v"), F.col("user_id") % 8).alias("version"), F.col("event_type").alias("session"),
        F.element_at(tiers, (F.col("event_id") % 6 + 1).cast("int")).alias("tier"), F.element_at(severities, F.expr("cast(pmod(floor(value), 4) + 1 AS INT)")).alias("severity"),
        F.when(F.col("event_id") % 2 == 0, "own").otherwise("peer").alias("source"), F.concat(F.lit("M"), F.col("event_id") % 23).alias("check"),
        F.concat(F.lit("Line "), F.col("user_id") % 5, F.lit("  of part "), F.col("event_id") % 4).alias("evidence"),
        F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("introduced").alias("side"), (F.col("event_id") % 40).alias("comparison"), "event_id",
    )


DEFECTS = """
WITH d AS (
  SELECT 'v' || (user_id % 8) AS version, event_type AS session,
    ['correctness','preservation','completeness','consistency','writing','formatting'][event_id % 6 + 1] AS tier,
    ['minor','major','critical','fatal'][((floor(value)::INT % 4) + 4) % 4 + 1] AS severity,
    CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'peer' END AS source, 'M' || (event_id % 23) AS "check",
    'line ' || (user_id % 5) || ' of part ' || (event_id % 4) AS ev, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'introduced' END AS side,
    event_id % 40 AS comparison, event_id
  FROM events WHERE value IS NOT NULL),
tiers AS (SELECT unnest(['correctness','preservation','completeness','consistency','writing','formatting']) AS tier, unnest(range(6)) AS tier_ord),
sevs AS (SELECT unnest(['minor','major','critical','fatal']) AS severity, unnest([3,2,1,0]) AS sev_ord, unnest([1,2,3,4]) AS w),
srcs AS (SELECT unnest(['own','peer']) AS source, unnest([0,1]) AS src_ord),
u AS (SELECT DISTINCT session, version, source, tier, severity, "check", ev FROM d),
c AS (
  SELECT version, tier, severity, source, (sev_ord * 12 + tier_ord * 2 + src_ord)::INT AS cell,
    (SELECT count(*) FROM u WHERE u.version = v.version AND u.tier = tiers.tier AND u.severity = sevs.severity AND u.source = srcs.source) AS n
  FROM (SELECT DISTINCT version FROM d) v, tiers, sevs, srcs),
p AS (SELECT *, sum(n) OVER (PARTITION BY version ORDER BY cell)::BIGINT AS running FROM c)
"""
_CELLS = "SELECT version, tier, severity, source, cell, n "


def _census(s, d):
    return C.census(defect_rows(s, d))


R.add("defect_census", lambda s, d: _census(s, d).select("version", "tier", "severity", "source", "cell", "n"), DEFECTS + _CELLS + "FROM c")
R.add(
    "defect_rollup", lambda s, d: C.rollups(_census(s, d)),
    DEFECTS + "SELECT version, tier, severity, sum(n)::BIGINT AS n FROM c GROUP BY GROUPING SETS ((version, tier, severity), (version, severity), (version, tier), (version))",
)
R.add("census_prefix", lambda s, d: C.prefix_sums(_census(s, d)).select("version", "cell", "n", "running"), DEFECTS + "SELECT version, cell, n, running FROM p")
for _floor in (0, FLOOR, 10**9):
    R.add(
        f"adaptive_prefix_{_floor}", lambda s, d, f=_floor: C.adaptive_prefix(C.prefix_sums(_census(s, d)), f),
        DEFECTS + f"SELECT CASE WHEN {_floor} <= 0 THEN 0 ELSE coalesce(min(cell + 1) FILTER (least >= {_floor}), 48) END::INT AS cells_used FROM (SELECT cell, min(running) AS least FROM p GROUP BY cell)",
    )
R.add(
    "issue_matrix", lambda s, d: _census(s, d).groupBy("version").pivot("cell", list(range(48))).agg(F.sum("n")).select("version", *(F.col(str(i)).alias(f"c{i}") for i in range(48))),
    DEFECTS + "SELECT version, " + ", ".join(f"(sum(n) FILTER (cell = {i}))::BIGINT AS c{i}" for i in range(48)) + " FROM c GROUP BY 1",
)


def champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.champion_ranking(_census(spark, sf_dir), S.member_stats(score_rows(spark, sf_dir), "v0"), FLOOR)


_RANK = ROWS + """, s AS (SELECT member, median(s) AS median, avg(s) AS mean, CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(s, 0.75) - quantile_cont(s, 0.25) END::DOUBLE AS iqr FROM votes WHERE kept GROUP BY 1)
"""
R.add(
    "champion_rank", champion,
    _RANK.rstrip() + ", " + DEFECTS.strip().removeprefix("WITH ") + f""", k AS (SELECT coalesce(min(cell + 1) FILTER (least >= {FLOOR}), 48) AS used FROM (SELECT cell, min(running) AS least FROM p GROUP BY cell)),
    lead AS (SELECT version, list(n ORDER BY cell) AS l FROM c, k WHERE cell < used GROUP BY version)
    SELECT member, median, mean, iqr, row_number() OVER (ORDER BY l, median DESC, mean DESC, iqr, member)::INT AS place FROM s LEFT JOIN lead ON member = version""",
)
_NETS = DEFECTS + """, once AS (SELECT DISTINCT comparison, side, tier, severity, "check", ev FROM d),
sg AS (SELECT *, CASE WHEN side = 'resolved' THEN w ELSE -w END AS sw, tier = 'formatting' AND "check" IN ('M18', 'M19') AS len FROM once JOIN sevs USING (severity)),
net AS (SELECT comparison, tier, greatest(-4, least(4, coalesce(sum(sw) FILTER (NOT len), 0) + greatest(-1, least(1, coalesce(sum(sw) FILTER (len), 0)))))::INT AS net,
  max(w) FILTER (side = 'resolved') AS wr, max(w) FILTER (side = 'introduced') AS wi FROM sg GROUP BY 1, 2)
"""
R.add("tier_nets", lambda s, d: C.tier_nets(defect_rows(s, d), ["comparison"]).select("comparison", "tier", F.col("net").cast("int").alias("net")), _NETS + "SELECT comparison, tier, net FROM net")
R.add(
    "derived_scores", lambda s, d: C.derived_scores(defect_rows(s, d), ["comparison"]),
    _NETS + """, f AS (SELECT comparison, first(tier ORDER BY tier_ord) AS any_tier, first(struct_pack(t := tier, n := net, r := CASE WHEN net > 0 THEN wr ELSE wi END) ORDER BY tier_ord) FILTER (net <> 0) AS x
      FROM net JOIN tiers USING (tier) GROUP BY 1)
    SELECT comparison, coalesce(sign(x.n) * least(abs(x.n), CASE WHEN x.r >= 3 THEN 4 WHEN x.r = 2 THEN 3 ELSE 2 END), 0)::INT AS score, coalesce(x.t, any_tier) AS basis FROM f""",
)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census recounted over rows whose event id has a label of quality 1 (a stand-in verdict)."""
    rows = defect_rows(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("event_id"))
    kept = rows.join(good, "event_id", "left_semi")
    return C.recount(C.census(rows), kept).select("version", "tier", "severity", "source", "n", "kept")


R.add(
    "audited_census", audited,
    DEFECTS + """SELECT version, tier, severity, source, n, (SELECT count(*) FROM (SELECT DISTINCT session, version, source, tier, severity, "check", ev FROM d WHERE event_id IN (SELECT doc_id FROM labels WHERE quality = 1)) x
    WHERE x.version = c.version AND x.tier = c.tier AND x.severity = c.severity AND x.source = c.source) AS kept FROM c""",
)
R.add(
    "label_join", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")),
    "SELECT source, count(*) AS n, count(quality) AS labelled, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
