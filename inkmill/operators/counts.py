"""Counts written in words: runs of number words in running text, what they come to, and whether they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.scalars import match_spans

#: Number words, words that look like plurals and are none, irregular plurals, what may follow a
#: pronoun `one`, labels that take a number as a name.
UNITS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
NO_PLURALS = (
    "is was has does this his hers ours yours theirs its as less always various perhaps across unless thus plus versus towards afterwards "
    "nevertheless whereas yes class process analysis basis status hypothesis synthesis emphasis diagnosis prognosis thesis crisis focus virus "
    "apparatus census consensus bias means news physics mathematics economics genomics omics"
).split()
IRREGULAR_PLURALS = "data criteria phenomena analyses children people mice indices matrices vertices axes genera loci taxa".split()
AFTER_PRONOUN = (
    "another hand side way thing time day bit step of that which who whom whose where such may can could should is was does did has had will "
    "would must might shall needs wants"
).split()
LABELS = (
    "run step phase group round patient donor sample dataset figure table experiment trial cohort method version set batch replicate timepoint "
    "condition arm case panel clone"
).split()
DETERMINERS = "the a an this that these those its their our all both any each every only exactly".split()

_WORD = "|".join(sorted([*UNITS, *SCALES], key=len, reverse=True))
#: A maximal run of number words, one space, hyphen or `and` apart.
RUN = rf"(?i)(?<![\w-])(?:{_WORD})(?:[-\s](?:and[-\s])?(?:{_WORD}))*(?![\w-])"


def words_value(written: Column) -> Column:
    """What a run of number words comes to; null where an `and` follows no scale word, and for others."""
    words = F.split(F.lower(F.trim(written)), r"[-\s]+")
    values = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    scales = F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"), F.lit("").alias("before"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        part = F.when(s["part"] == 0, F.lit(1).cast("long")).otherwise(s["part"])
        scale, unit = F.try_element_at(scales, w), F.try_element_at(values, w)
        total = F.when(scale > 100, s["total"] + part * scale).otherwise(s["total"])
        own = F.when(scale > 100, F.lit(0).cast("long")).when(scale == 100, part * 100).when(unit.isNotNull(), s["part"] + unit).otherwise(s["part"])
        ok = s["ok"] & (scale.isNotNull() | unit.isNotNull() | ((w == "and") & s["before"].isin(*SCALES)))
        return F.struct(total.alias("total"), own.alias("part"), w.alias("before"), ok.alias("ok"))

    end = F.aggregate(words, start, step)
    return F.when(end["ok"] & (end["total"] + end["part"] > 0), end["total"] + end["part"])


def _plural(noun: Column) -> Column:
    return noun.isin(*IRREGULAR_PLURALS) | ((F.length(noun) >= 4) & noun.endswith("s") & ~noun.isin(*NO_PLURALS))


def is_count(text: Column, start: Column, written: Column) -> Column:
    """Whether the number words at `start` (from 0) of a text count something: they stand before a plural
    noun, before `of` and a number, before a unit or `per`, and are neither a name's number nor a pronoun."""
    end = start + F.length(written)
    tail = F.substring(text, end + 1, F.length(text))
    before = lambda n: F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))
    first, single = F.get(F.split(F.lower(F.trim(written)), r"[-\s]+"), F.lit(0)), F.lower(F.trim(written)) == "one"
    follower = F.lower(F.regexp_extract(tail, r"^\s+([A-Za-z][A-Za-z'-]*)", 1))
    nearest = F.btrim(F.lower(F.regexp_extract(tail, r"^\s+([A-Za-z][A-Za-z-]*)\b", 1)), F.lit("-"))
    nouns = F.transform(F.slice(F.regexp_extract_all(tail, F.lit("[A-Za-z][A-Za-z-]*"), F.lit(0)), 1, 4), lambda w: F.btrim(F.lower(w), F.lit("-")))
    labelled = before(24).rlike(rf"(?i)\b(?:{'|'.join(LABELS)}|cell\s+line)\s+$")
    bare_scale = first.isin(*SCALES) & ~before(4).rlike(r"(?i)\ba\s+$")
    of_number = tail.rlike(rf"(?i)^\s+of\s+(?:the\s+|these\s+|those\s+|its\s+|their\s+)?(?:{_WORD}|\d+)\b")
    idiom = (first == "one") & (follower.isin(*AFTER_PRONOUN) | before(12).rlike(r"(?i)\b(?:no|for|at|in)\s+$"))
    unit = tail.rlike(r"(?i)^\s*(?:percent|%|fold\b|times\b|orders?\s+of\s+magnitude)") | tail.rlike(r"^\s+(?:[A-Za-z][A-Za-z-]*\s+){0,2}per\s+")
    lone = single & ~before(16).rlike(rf"(?i)\b(?:{'|'.join(DETERMINERS)})\s+$") & ~_plural(nearest)
    plural = F.exists(nouns, lambda n: ~n.endswith("ly") & _plural(n))
    return F.when(labelled | bare_scale, False).when(of_number, ~single).when(idiom, False).when(unit, True).when(lone, False).otherwise(plural)


def spelled_counts(lines: DataFrame) -> DataFrame:
    """doc_id, line, start (from 0), written, number: counts in words in lines of doc_id, line, raw.

    A run that is no number as a whole is a list: it is cut at each ` and ` and its members count for
    themselves. Null and empty lines have none.
    """
    rows = lines.where(F.col("raw").rlike(RUN)).select("doc_id", "line", "raw", F.explode(match_spans(F.col("raw"), RUN)).alias("run"))
    apart = F.split(F.col("run.text"), r"\sand\s")
    parts = F.when(words_value(F.col("run.text")).isNotNull(), F.array("run.text")).otherwise(apart)
    begins = F.transform("parts", lambda p, i: F.col("run.start") + F.aggregate(F.slice(F.col("parts"), 1, i), F.lit(0), lambda n, x: n + F.length(x) + 5))
    rows = rows.withColumn("parts", parts).withColumn("begins", begins).select("doc_id", "line", "raw", F.explode(F.arrays_zip("parts", "begins")).alias("p"))
    rows = rows.select("doc_id", "line", "raw", F.col("p.begins").alias("start"), F.col("p.parts").alias("written"))
    rows = rows.withColumn("number", words_value(F.col("written"))).where("number IS NOT NULL")
    return rows.where(is_count(F.col("raw"), F.col("start"), F.col("written"))).select("doc_id", "line", "start", "written", "number")
