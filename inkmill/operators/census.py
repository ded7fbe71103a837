"""Defect census: a dense lattice of counts, its roll-ups, prefix sums and the ranking on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tiers in order of priority and severities with their weights.
TIERS = ("correctness", "preservation", "completeness", "consistency", "writing", "formatting")
SEVERITIES = {"minor": 1, "major": 2, "critical": 3, "fatal": 4}
CAP = 4
LENGTH_CHECKS = ("M18", "M19")


def squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def distinct_defects(rows: DataFrame) -> DataFrame:
    """One row of each (session, version, source, tier, severity, check, evidence without case and spacing)."""
    keyed = rows.withColumn("evidence_key", squeezed(F.col("evidence")))
    return keyed.dropDuplicates(["session", "version", "source", "tier", "severity", "check", "evidence_key"])


def lattice(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """Every (version, tier, severity, source) with the ordinals that give the 48 cells their order."""
    dims = [(t, i, s, 4 - w, src, j) for i, t in enumerate(TIERS) for s, w in SEVERITIES.items() for j, src in enumerate(("own", "peer"))]
    cells = spark.createDataFrame(dims, "tier string, tier_ord int, severity string, sev_ord int, source string, src_ord int")
    cells = cells.withColumn("cell", F.col("sev_ord") * 12 + F.col("tier_ord") * 2 + F.col("src_ord"))
    return versions.select("version").distinct().crossJoin(F.broadcast(cells))  # 48 fixed cells a version


def census(rows: DataFrame) -> DataFrame:
    """Counts in every cell of the lattice, zeros included."""
    counts = distinct_defects(rows).groupBy("version", "tier", "severity", "source").agg(F.count("*").alias("n"))
    dense = lattice(rows.sparkSession, rows).join(counts, ["version", "tier", "severity", "source"], "left")
    return dense.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def rollups(counts: DataFrame) -> DataFrame:
    """Totals by tier and severity, by severity, by tier and in all, per version."""
    text = "SELECT version, tier, severity, sum(n) AS n FROM {counts} GROUP BY GROUPING SETS ((version, tier, severity), (version, severity), (version, tier), (version))"
    return counts.sparkSession.sql(text, counts=counts)


def prefix_sums(counts: DataFrame) -> DataFrame:
    running = Window.partitionBy("version").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("running", F.sum("n").over(running))


def adaptive_prefix(prefixes: DataFrame, floor: int) -> DataFrame:
    """One row: the cells that lead the ranking, up to the first where every version has `floor`
    defects; all 48 where none does, 0 for a floor of 0 or less."""
    least = prefixes.groupBy("cell").agg(F.min("running").alias("least"))
    reached = F.coalesce(F.min(F.when(F.col("least") >= floor, F.col("cell") + 1)), F.lit(48))
    return least.agg((F.lit(0) if floor <= 0 else reached).cast("int").alias("cells_used"))


def champion_ranking(counts: DataFrame, stats: DataFrame, floor: int) -> DataFrame:
    """Versions by their leading cells, then median, mean (both descending), IQR and name."""
    prefixes = prefix_sums(counts)
    used = adaptive_prefix(prefixes, floor)
    leading = prefixes.join(F.broadcast(used), F.col("cell") < F.col("cells_used"))  # one row
    arrays = leading.groupBy("version").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "n"))), lambda x: x["n"]).alias("lead"))
    joined = stats.join(arrays, stats["member"] == arrays["version"], "left")
    order = Window.orderBy(
        F.coalesce("lead", F.array().cast("array<long>")), F.coalesce("median", F.lit(-99.0)).desc(), F.coalesce("mean", F.lit(-99.0)).desc(), F.coalesce("iqr", F.lit(99.0)), "member"
    )
    # The input has one row a version, so the single ordered partition is small.
    return joined.select("member", "median", "mean", "iqr", F.row_number().over(order).alias("place"))


def tier_nets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Net score of each comparison and tier: resolved minus introduced weights, length checks capped
    at one point, the tier at four."""
    weight = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))[F.col("severity")]
    signed = F.when(F.col("side") == "resolved", weight).otherwise(-weight)
    length = (F.col("tier") == "formatting") & F.col("check").isin(*LENGTH_CHECKS)
    plain = F.coalesce(F.sum(F.when(~length, signed)), F.lit(0))
    capped = F.greatest(F.lit(-1), F.least(F.lit(1), F.coalesce(F.sum(F.when(length, signed)), F.lit(0))))
    rung = lambda side: F.max(F.when(F.col("side") == side, weight))
    once = rows.dropDuplicates([*keys, "side", "tier", "severity", "check", "evidence"])
    return once.groupBy(*keys, "tier").agg(
        F.greatest(F.lit(-CAP), F.least(F.lit(CAP), plain + capped)).alias("net"), rung("resolved").alias("worst_resolved"), rung("introduced").alias("worst_introduced")
    )


def derived_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per comparison: the score of the first tier with a net, bounded by the rung of its own worst
    severity on the deciding side (2, 3 from major, 4 from critical), and that tier as the basis."""
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    nets = tier_nets(rows, keys).withColumn("ord", order)
    first = F.min(F.when(F.col("net") != 0, F.struct("ord", "tier", "net", "worst_resolved", "worst_introduced")))
    out = nets.groupBy(*keys).agg(first.alias("d"), F.min_by("tier", "ord").alias("any_tier"))
    worst = F.when(F.col("d.net") > 0, F.col("d.worst_resolved")).otherwise(F.col("d.worst_introduced"))
    rung = F.when(worst >= 3, 4).when(worst == 2, 3).otherwise(2)
    score = F.coalesce(F.signum("d.net") * F.least(F.abs("d.net"), rung), F.lit(0.0)).cast("int")
    return out.select(*keys, score.alias("score"), F.coalesce("d.tier", "any_tier").alias("basis"))


def recount(template: DataFrame, kept_rows: DataFrame) -> DataFrame:
    """The census of a subset of rows over the same lattice."""
    counts = distinct_defects(kept_rows).groupBy("version", "tier", "severity", "source").agg(F.count("*").alias("kept"))
    return template.join(counts, ["version", "tier", "severity", "source"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
