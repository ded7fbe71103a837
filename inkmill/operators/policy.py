"""Venue profiles as rows: what each profile says, what it takes over from others, and the caps that a
text must keep.

A setting is (profile, article_type, section, unit, cap, tolerance). A null article_type holds for all
types. A null cap is said on purpose: such texts are counted, not judged, and nothing is taken over for
them. Profiles name a parent to take over from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.operators.prose import sentence_rows

#: The form of a profile file.
PROFILE = (
    "id string, extends string, style_limits struct<sentence_words: map<string, double>, paragraph_words: map<string, double>, tolerance: double>, "
    "article_types array<struct<id: string, style_limits: struct<sentence_words: map<string, double>, paragraph_words: map<string, double>, tolerance: double>>>"
)
#: The editorial bars by section, which only tell what is worth counting.
SENTENCE_BARS = {"front": 40, "abstract": 40, "legend": 40, "body": 46, "methods": 61}
PARAGRAPH_BAR = 250


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((profile, parent), settings) of a folder of profile files, one JSON object each. A file that is no
    object, or has no id, is left out."""
    raw = spark.read.schema(PROFILE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where(F.trim("id") != "")
    profiles = raw.select(F.lower(F.trim("id")).alias("profile"), F.lower(F.trim("extends")).alias("parent"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("id"), "style_limits"))
    each = raw.select(F.lower(F.trim("id")).alias("profile"), F.explode(F.concat(own, F.coalesce("article_types", F.filter(own, lambda x: F.lit(False))))).alias("t"))
    out = None
    for unit in ("sentence", "paragraph"):
        rows = each.select("profile", F.col("t.id").alias("article_type"), F.explode(F.col(f"t.style_limits.{unit}_words")).alias("section", "cap"), F.col("t.style_limits.tolerance").alias("tolerance"))
        rows = rows.select("profile", "article_type", "section", F.lit(unit).alias("unit"), "cap", F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"))
        out = rows if out is None else out.unionByName(rows)
    return profiles, out


def lineage(profiles: DataFrame, most: int = 16) -> DataFrame:
    """profile, source, distance: each profile itself and those it takes over from, nearest first.

    Distances double from round to round, so `most` ancestors take log2(most) joins; a circle of parents
    ends where it comes back to a profile it already has.
    """
    known = profiles.select("profile", F.col("profile").alias("source"), F.lit(0).alias("distance"))
    known = known.unionByName(profiles.where("parent IS NOT NULL AND parent <> profile").select("profile", F.col("parent").alias("source"), F.lit(1).alias("distance")))
    step = 1
    while step < most:
        more = known.alias("a").join(known.alias("b"), F.col("a.source") == F.col("b.profile")).select("a.profile", "b.source", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        known = more.groupBy("profile", "source").agg(F.min("distance").alias("distance"))
        step *= 2
    return known.join(profiles.select(F.col("profile").alias("source")), "source", "left_semi").select("profile", "source", "distance")


def resolved(profiles: DataFrame, settings: DataFrame) -> DataFrame:
    """profile, article_type, section, unit, cap, tolerance, source: what holds for each profile.

    The nearest profile that says anything decides, and there a setting of the article type goes before
    one for all types; what it says holds even if it is a null cap. Every article type that a profile or
    one it takes over from names has rows of its own, as has the null type. Of several equal settings
    the least cap counts, nulls last.
    """
    line = lineage(profiles)
    said = line.join(settings.withColumnRenamed("profile", "source"), "source")
    types = said.select("profile", "article_type").distinct().withColumnRenamed("article_type", "wanted")
    types = types.unionByName(profiles.select("profile", F.lit(None).cast("string").alias("wanted"))).distinct()
    fits = said.join(types, "profile").where(F.col("article_type").isNull() | F.col("article_type").eqNullSafe(F.col("wanted")))
    order = Window.partitionBy("profile", "wanted", "section", "unit").orderBy("distance", F.col("article_type").isNull(), F.col("cap").asc_nulls_last())
    first = fits.withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select("profile", F.col("wanted").alias("article_type"), "section", "unit", "cap", "tolerance", "source")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def long_text(lines: DataFrame, policy: DataFrame) -> DataFrame:
    """doc_id, line, kind, unit, nth, n_words, cap, tier: sentences and paragraphs that are too long.

    lines: doc_id, line, raw, kind (from `section_kinds`), profile, article_type; policy: from `resolved`.
    A finding is over floor(cap * (1 + tolerance) + 1e-9) words. Where no setting or a null cap holds, a
    text over the editorial bar is an advisory, with a null cap. A type the profile doesn't name is held
    to the settings for all types. nth is 0 for a paragraph. Null lines have no rows.
    """
    rows = lines.where(F.col("raw").isNotNull())
    paragraphs = rows.select("doc_id", "line", F.lit(0).alias("nth"), F.lit("paragraph").alias("unit"), _words(F.col("raw")).alias("n_words"))
    sentences = sentence_rows(rows).select("doc_id", "line", "nth", F.lit("sentence").alias("unit"), _words(F.col("sentence")).alias("n_words"))
    long = paragraphs.unionByName(sentences).where("n_words > 0")
    heads = rows.select(F.col("doc_id").alias("d"), F.col("line").alias("l"), "kind", "profile", "article_type")
    long = long.join(heads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l"))).drop("d", "l")
    own = policy.select(F.col("profile").alias("p"), F.col("article_type").alias("t"), F.col("section").alias("s"), F.col("unit").alias("u"), "cap", "tolerance", F.lit(True).alias("said"))
    same = (F.col("profile") == F.col("p")) & (F.col("kind") == F.col("s")) & (F.col("unit") == F.col("u"))
    named = long.join(policy.select(F.col("profile").alias("p2"), F.col("article_type").alias("t2")).where("t2 IS NOT NULL").distinct(), (F.col("profile") == F.col("p2")) & (F.col("article_type") == F.col("t2")), "left")
    named = named.withColumn("wanted", F.when(F.col("t2").isNotNull(), F.col("article_type"))).drop("p2", "t2")
    found = named.join(own, same & F.col("wanted").eqNullSafe(F.col("t")), "left")
    cap = F.floor(F.col("cap") * (1 + F.coalesce("tolerance", F.lit(0.0))) + 1e-9).cast("long")
    bars = F.create_map(*(F.lit(x) for pair in SENTENCE_BARS.items() for x in pair))
    bar = F.when(F.col("unit") == "paragraph", F.lit(PARAGRAPH_BAR)).otherwise(F.try_element_at(bars, F.col("kind")))
    tier = F.when(F.col("n_words") > cap, "finding").when(cap.isNull() & (F.col("n_words") > bar), "advisory")
    return found.select("doc_id", "line", "kind", "unit", "nth", "n_words", cap.alias("cap"), tier.alias("tier")).where("tier IS NOT NULL")
