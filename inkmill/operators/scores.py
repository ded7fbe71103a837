"""Pairwise judgements: cleaning, vote deduplication, pair and member aggregates.

Score rows have round, member, opponent, credited, score_as_written, direction, judge, judge_index,
sheet and a total order column `ord`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions.scalars import iqr, parse_score, version_key

LEAST, MOST = -4, 4


def labelled_scores(rows: DataFrame) -> DataFrame:
    """Add `score` (credited, else as written, negated for received rows) and `status`: direction,
    incomplete, range or ok."""
    credited, written = parse_score(F.col("credited")), parse_score(F.col("score_as_written"))
    direction = F.lower(F.trim(F.coalesce("direction", F.lit(""))))
    member, opponent = F.trim(F.coalesce("member", F.lit(""))), F.trim(F.coalesce("opponent", F.lit("")))
    raw = F.coalesce(credited, written)
    score = F.when(credited.isNull() & (direction == "received"), -written).otherwise(raw)
    status = (
        F.when(direction != "own", "direction")
        .when((member == "") | (opponent == "") | raw.isNull() | (member == opponent), "incomplete")
        .when((raw != F.floor(raw)) | ~raw.between(LEAST, MOST), "range")
        .otherwise("ok")
    )
    return rows.withColumn("score", score).withColumn("status", status)


def votes(rows: DataFrame) -> DataFrame:
    """Usable rows, one of each judge identity (the first by `ord`) with `conflict` for a repeat of
    another score; rows without an identity are all kept."""
    usable = labelled_scores(rows).where("status = 'ok'")
    identity = ["round", "member", "opponent", "judge", "judge_index", "sheet"]
    order = Window.partitionBy(*identity).orderBy("ord")
    bare = (F.coalesce("judge", F.lit("")) == "") & (F.coalesce("judge_index", F.lit("")) == "")
    ranked = usable.withColumn("rn", F.row_number().over(order)).withColumn("first_score", F.first("score").over(order))
    return ranked.withColumn("kept", bare | (F.col("rn") == 1)).withColumn("conflict", ~F.col("kept") & (F.col("score") != F.col("first_score")))


def aggregate_of(how: str) -> Column:
    return {"mean": F.avg("score"), "median": F.median("score"), "sum": F.sum("score")}[how]


def pair_scores(rows: DataFrame, how: str = "mean", pool_rounds: bool = False) -> DataFrame:
    """One row per (round, member, opponent): n and the aggregate; pooled rounds are `all`."""
    kept = votes(rows).where("kept")
    if pool_rounds:
        kept = kept.withColumn("round", F.lit("all"))
    return kept.groupBy("round", "member", "opponent").agg(F.count("*").alias("n"), aggregate_of(how).alias("score"))


def pair_matrix(rows: DataFrame, versions: list[str], how: str = "mean") -> DataFrame:
    """Members by opponents, pooled; a pair that nobody judged is null."""
    kept = votes(rows).where("kept")
    return kept.groupBy("member").pivot("opponent", versions).agg(aggregate_of(how))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Own rows and the opponents' negated views of them."""
    own = pairs.select("member", "opponent", "score", F.lit("own").alias("direction"))
    return own.unionByName(pairs.select(F.col("opponent").alias("member"), F.col("member").alias("opponent"), (-F.col("score")).alias("score"), F.lit("received").alias("direction")))


def both_directions(pairs: DataFrame) -> DataFrame:
    """Pairs judged both ways: left and right score, whether one negates the other."""
    a, b = pairs.alias("a"), pairs.alias("b")
    both = a.join(b, (F.col("a.member") == F.col("b.opponent")) & (F.col("a.opponent") == F.col("b.member")) & (F.col("a.member") < F.col("a.opponent")))
    left, right = F.col("a.score"), F.col("b.score")
    return both.select(F.col("a.member").alias("member"), F.col("a.opponent").alias("opponent"), left.alias("left_score"), right.alias("right_score"), (F.abs(left + right) < 1e-9).alias("negation"), (F.signum(left) * F.signum(right) > 0).alias("flip"))


def member_stats(rows: DataFrame, base: str) -> DataFrame:
    """Per member: n, median, mean, IQR, wins, losses, ties and the median against the base version."""
    kept = votes(rows).where("kept")
    return kept.groupBy("member").agg(
        F.count("*").alias("n"), F.median("score").alias("median"), F.avg("score").alias("mean"), iqr(F.col("score")).alias("iqr"),
        F.count_if(F.col("score") > 0).alias("wins"), F.count_if(F.col("score") < 0).alias("losses"), F.count_if(F.col("score") == 0).alias("ties"),
        F.median(F.when(F.col("opponent") == base, F.col("score"))).alias("vs_base"),
        F.count_if((F.col("opponent") == base) & (F.col("score") != 0)).alias("base_decided"),
        F.count_if((F.col("opponent") == base) & (F.col("score") < 0)).alias("base_losses"),
    )


def candidates(rows: DataFrame, original: str) -> DataFrame:
    """What a round is decided on, per member: n, median, mean, iqr, original_n and original_median (the
    scores against the original) and the digest of its text, here of its name's."""
    kept = votes(rows).where("kept")
    against = F.when(F.col("opponent") == original, F.col("score"))
    return kept.groupBy("member").agg(
        F.count("*").alias("n"), F.median("score").alias("median"), F.avg("score").alias("mean"), iqr(F.col("score")).alias("iqr"),
        F.count(against).alias("original_n"), F.median(against).alias("original_median"),
    ).withColumn("digest", F.md5("member"))


def panel_quality(rows: DataFrame) -> DataFrame:
    """One row per judge: n, share of zeros, mean and greatest absolute score, mean."""
    kept = votes(rows).where("kept")
    size = F.abs("score")
    return kept.groupBy("judge").agg(F.count("*").alias("n"), (F.count_if(F.col("score") == 0) / F.count("*")).alias("zero_share"), F.avg(size).alias("mean_abs"), F.max(size).alias("max_abs"), F.avg("score").alias("mean"))


def newest_per_slot(rows: DataFrame) -> DataFrame:
    """The last sheet of each (member, judge) slot by time, then id."""
    order = Window.partitionBy("member", "judge").orderBy(F.col("at").desc(), F.col("ord").desc())
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def score_preview(pairs: DataFrame) -> DataFrame:
    """The directed pairs of each round as lines of text: place 0 heads the columns, then one line a
    member, natural version order, two decimals (ties to even), a dash on the diagonal and blanks for unjudged pairs.

    Arrays and maps here hold a round's versions, as many as the printed matrix is wide.
    """
    pad = lambda c: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 8 - F.length(c))), c)
    names = pairs.select("round", F.col("member").alias("v")).union(pairs.select("round", "opponent")).distinct()
    versions = names.groupBy("round").agg(F.transform(F.array_sort(F.collect_list(F.struct(version_key(F.col("v")).alias("k"), "v"))), lambda x: x["v"]).alias("versions"))
    cells = pairs.groupBy("round", "member").agg(F.map_from_entries(F.collect_list(F.struct("opponent", F.format_string("%8.2f", F.bround("score", 2))))).alias("cells"))
    rows = versions.select("round", "versions", F.posexplode("versions").alias("pos", "member")).join(cells, ["round", "member"], "left")
    cell = lambda v: F.when(v == F.col("member"), F.lit("       —")).otherwise(F.coalesce(F.try_element_at("cells", v), F.lit(" " * 8)))
    body = rows.select("round", (F.col("pos") + 1).alias("place"), F.concat(pad(F.col("member")), F.lit(" "), F.array_join(F.transform("versions", cell), "")).alias("text"))
    head = versions.select("round", F.lit(0).alias("place"), F.concat(F.lit(" " * 9), F.array_join(F.transform("versions", pad), " ")).alias("text"))
    return head.unionByName(body)
