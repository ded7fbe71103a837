"""Quantities, identifiers and locations that lines state, and rules over candidates and votes.

Lines have doc_id, line and raw, as from `text.lines_of`.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from inkmill.operators import fixed
from inkmill.operators.census import adaptive_prefix, prefix_sums
from inkmill.operators.rounds import settled

#: What a line may report: label and the pattern whose first group is the value.
METRICS = {
    "p-value": r"(?i)\bp\s*((?:<=|>=|[<>=])\s*[0-9]*\.?[0-9]+(?:\s*[×x]\s*10\s*\^?\s*[-+]?[0-9]+)?)",
    "n": r"\bn\s*=\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)",
    "percentage": r"([0-9]+(?:\.[0-9]+)?)\s*%",
    "fold": r"([0-9]+(?:\.[0-9]+)?)\s*-?\s*fold\b",
    "AUC": r"\bAUC\s*=\s*([0-9]*\.?[0-9]+)",
}
SHOWN = 12
QUANTITY = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def metric_operator(value: Column) -> Column:
    """The comparator of a p-value; equality is the empty one."""
    return F.regexp_extract(value, "^(<=|>=|[<>])", 1)


def metric_number(value: Column) -> Column:
    """The number a value writes, as one double for all its spellings: `0.050` and `.05`, `1,200` and
    `1200`, `5 × 10^-8`, `5 \\times 10^{-8}` and `5e-8`. Null where it is no number."""
    plain = F.regexp_replace(F.replace(value, F.lit("\\times"), F.lit("×")), r"[<>={},\s\x{A0}\x{202F}]", "")
    plain = F.translate(plain, "−⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "--0123456789")
    return F.regexp_replace(plain, r"[×x]10\^?", "e").try_cast("double")


def metrics(lines: DataFrame) -> DataFrame:
    """doc_id, line, label, operator, number of every reported quantity."""

    def of(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("raw", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    rows = lines.select("doc_id", "line", F.explode(F.concat(*(of(*m) for m in METRICS.items()))).alias("m"))
    value = F.col("m.value")
    return rows.select("doc_id", "line", "m.label", metric_operator(value).alias("operator"), metric_number(value).alias("number")).where("number IS NOT NULL")


def inventory(
    found: DataFrame, key: list[str], shown: int, spelled: list[str] | None = None, keyed: Callable[[DataFrame], DataFrame] = lambda x: x, again: Callable[[Callable], DataFrame] | None = None
) -> DataFrame:
    """key, n, n_docs, places: how often each key occurs, and its first `shown` places as doc:line.

    Where the key is made from columns `spelled`, keyed adds it, once for each spelling in a document. again
    gives what is found in the lines that a function leaves of all lines; without it, found is filtered.

    Occurrences are counted by spelling and document, with bits that tell a lower bound of their lines. Each
    document of a key has a place, so the first places lie in the key's first `shown` documents, and in those
    up to which there are `shown` lines; only the lines of these are read again for them.
    """
    spelled = spelled or key
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(line), 64) AS INT))")
    spellings = settled(keyed(found.groupBy(*spelled, "doc_id").agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))))
    by_doc = spellings.groupBy(*key, "doc_id").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("bits")).alias("lines"))
    counts = by_doc.groupBy(*key).agg(F.sum("n").alias("n"), F.count("doc_id").alias("n_docs"))
    order = Window.partitionBy(*key).orderBy("doc_id")
    before = F.coalesce(F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_doc.withColumn("nth", F.row_number().over(order)).withColumn("before", before).where((F.col("nth") <= shown) & (F.col("before") < shown))
    same = lambda columns: F.expr(" AND ".join(f"{c} <=> first_{c}" for c in columns))
    first = first.select(*(F.col(c).alias(f"first_{c}") for c in (*key, "doc_id")))
    named = list(dict.fromkeys((*spelled, *key, "doc_id")))
    wanted = spellings.join(first, same((*key, "doc_id")), "left_semi").select(*(F.col(c).alias(f"first_{c}") for c in named))
    docs = wanted.select(F.col("first_doc_id").alias("some_doc_id")).distinct()
    some = lambda rows: rows.join(docs, F.col("doc_id").eqNullSafe(F.col("some_doc_id")), "left_semi")
    near = (again(some) if again else some(found)).join(wanted, same((*spelled, "doc_id")))
    places = near.select(*(F.col(f"first_{c}").alias(c) for c in key), "doc_id", "line").distinct()
    places = places.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "line"))).where(F.col("nth") <= shown)
    listed = places.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(":", "doc_id", "line").alias("at")))).alias("at"))
    return counts.join(listed, key).select(*key, "n", "n_docs", F.array_join("at.at", " ").alias("places"))


def metric_inventory(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Occurrences of each (label, operator, number), with its first `shown` places as doc:line."""
    return inventory(found, ["label", "operator", "number"], shown)


def metric_divergence(found: DataFrame, context: str = "doc_id") -> DataFrame:
    """Labels that one context reports with several values: context, label, number of values, range."""
    values = found.select(context, "label", "operator", "number").distinct()
    out = values.groupBy(context, "label").agg(F.count("*").alias("n_values"), F.min("number").alias("least"), F.max("number").alias("most"))
    return out.where("n_values > 1")


def number_format_mix(lines: DataFrame) -> DataFrame:
    """Documents that write large numbers both with and without thousands separators.

    Years and plain numbers of up to four digits take no part.
    """
    number = F.explode(F.regexp_extract_all("raw", F.lit(QUANTITY), F.lit(0))).alias("number")
    rows = lines.where("raw RLIKE '[0-9]{4}|[0-9],[0-9]{3}'").select("doc_id", number).withColumn("number", F.regexp_replace("number", ",+$", ""))
    digits = F.replace("number", F.lit(","), F.lit(""))
    separated = F.col("number").contains(",")
    year = (F.length(digits) == 4) & digits.rlike("^(19|20)")
    sound = ~separated | F.col("number").rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    rows = rows.where(sound & ~year & ((F.length(digits) > 4) | separated))
    counts = rows.groupBy("doc_id").agg(F.count_if(separated).alias("n_separated"), F.count_if(~separated).alias("n_plain"))
    return counts.where("n_separated > 0 AND n_plain > 0")


def formatted_number(value: Column) -> Column:
    """Thousands separators, at most six decimals, no trailing zeros; an exponent below 5e-7."""
    tiny = F.regexp_replace(F.format_string("%.5e", value), r"\.?0+e", "e")
    plain = F.regexp_replace(F.format_number(value, 6), r"\.?0+$", "")
    return F.when((value != 0) & (F.abs(value) < 5e-7), tiny).otherwise(plain)


def doi_year_signal(doi: Column, year: Column) -> Column:
    """The first four-digit token of a DOI's suffix that differs from the entry's year by 2 to 100 and
    ends on the same two digits; null if there is none."""
    tokens = F.split(F.regexp_extract(doi, "^[^/]*/(.*)$", 1), "[^0-9]+")

    def corrupt(t: Column) -> Column:
        apart = F.abs(t.try_cast("int") - year.try_cast("int"))
        return (F.length(t) == 4) & (F.right(t, F.lit(2)) == F.right(year, F.lit(2))) & apart.between(2, 100)

    return F.when(year.rlike("^[0-9]{4}$"), F.get(F.filter(tokens, corrupt), F.lit(0)))


def check_id(raw: Column) -> Column:
    """A check's id without case and spaces; formatting rules count as M20, rubric items Q1 to Q12 as J3."""
    key = F.replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(key.startswith("FMT-"), "M20").when(key.rlike("^Q([1-9]|1[0-2])$"), "J3").otherwise(key)


#: The endings by which evidence names a document.
ENDINGS = "md|markdown|txt|tex|ltx|docx|doc|rtf|pdf|csv|tsv|json|py|bib"


def location_of(evidence: Column) -> tuple[Column, Column, Column]:
    """(line, words, document) that a piece of evidence names; line and document may be null."""
    line = F.regexp_extract(evidence, r"(?i)(?:\blines?\b|\bln\b|\bl\.)\s*[:#]?\s*([0-9]+)\b", 1)
    doc = F.regexp_extract(evidence, rf"(?i)([0-9A-Za-z_][0-9A-Za-z_./-]*\.(?:{ENDINGS}))(?::[0-9]+|\b)", 1)
    words = F.regexp_extract_all(F.lower(evidence), F.lit("[0-9a-z]+"), F.lit(0))
    return F.nullif(line, F.lit("")).try_cast("long"), words, F.nullif(F.lower(doc), F.lit(""))


def placeholders(lines: DataFrame) -> DataFrame:
    """Hand-off placeholders: payload, whether its fact can be looked up, and which kind it is, the first
    of PLACEHOLDER_KINDS whose patterns it all has."""
    hits = F.explode(F.regexp_extract_all("raw", F.lit(fixed.PLACEHOLDER), F.lit(1))).alias("payload")
    rows = lines.select("doc_id", "line", hits).withColumn("payload", F.btrim("payload", F.lit(" :;-")))
    low = F.lower("payload")
    kind = F.coalesce(*(F.when(reduce(and_, (low.rlike(p) for p in patterns)), F.lit(name)) for name, patterns in fixed.PLACEHOLDER_KINDS), F.lit(""))
    found = F.when(low.rlike(fixed.FINDABLE), "searchable").otherwise("author-only")
    return rows.select("doc_id", "line", F.left("payload", F.lit(200)).alias("payload"), found.alias("class"), kind.alias("kind"))


def abstained(dispositions: Column) -> Column:
    """Whether a comparison disposed of every check as `unable`; one without checks did not abstain."""
    return F.coalesce((F.size(dispositions) > 0) & F.forall(dispositions, lambda x: F.lower(F.trim(x)) == "unable"), F.lit(False))


def selected(only: list[str], round_col: str, stage_col: str, session_col: str) -> Column:
    """A filter that is the union of items ROUND, STAGE, ROUND:STAGE and session names; none: all rows."""
    keep = F.lit(not only)
    for item in only:
        left, _, right = item.partition(":")
        if right:
            keep |= (F.col(round_col) == left) & (F.col(stage_col) == right)
        else:
            keep |= (F.col(round_col) == item) | (F.col(stage_col) == item) | (F.col(session_col) == item)
    return F.coalesce(keep, F.lit(False))


def label_key(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(label), r"\s+", " "))


def resolved_labels(rows: DataFrame, label_map: DataFrame, label_col: str = "opponent_label") -> DataFrame:
    """rows with the id that their sheet's map (sheet, label, id) gives the label; id null: a diagnostic."""
    ids = label_map.select("sheet", label_key(F.col("label")).alias("__key"), "id").dropDuplicates(["sheet", "__key"])
    return rows.withColumn("__key", label_key(F.col(label_col))).join(ids, ["sheet", "__key"], "left").drop("__key")


def shared_prefix(names: DataFrame, group: str, name: str) -> DataFrame:
    """The longest prefix that all names of a group share, cut after its last - or _; one name has none.

    The least and the greatest name share what all names share, so the group is never gathered.
    """
    out = names.where(F.col(name).isNotNull()).groupBy(group).agg(F.min(name).alias("a"), F.max(name).alias("b"), F.count("*").alias("n"))
    most = F.least(F.length("a"), F.length("b"))
    same = F.filter(F.sequence(F.lit(0), most), lambda k: F.substring(F.col("a"), F.lit(1), k) == F.substring(F.col("b"), F.lit(1), k))
    common = F.substring(F.col("a"), F.lit(1), F.array_max(same))
    return out.select(group, F.when(F.col("n") > 1, F.regexp_extract(common, "^(.*[-_])", 1)).otherwise("").alias("prefix"))


def package_tokens(files: DataFrame, package: str, content: str) -> DataFrame:
    """A package's token: seven hex digits over the sorted digests of its files.

    Only digests of fixed size are gathered, one for each file of a package.
    """
    digests = files.select(package, F.sha2(F.col(content), 256).alias("sha"))
    return digests.groupBy(package).agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), "\n"), 256), F.lit(7)).alias("token"))


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x and y) and SequenceMatcher(None, x, y).ratio() >= 0.85 for x, y in zip(a, b)])


def identifier_near(kind: Column, a: Column, b: Column) -> Column:
    """Whether two identifiers may be one entry before and after a correction, by built-in expressions:
    DOIs of one length that differ in one or two characters; others, of seven characters or more, where
    one begins with the other."""
    apart = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    begins = (F.least(F.length(a), F.length(b)) >= 7) & (F.startswith(a, b) | F.startswith(b, a))
    near = F.when(kind == "doi", (F.length(a) == F.length(b)) & (apart <= 2)).otherwise(begins)
    return F.coalesce((a != "") & (b != "") & (a != b) & near, F.lit(False))


def identifier_similar(kind: Column, a: Column, b: Column) -> Column:
    """`identifier_near`, or identifiers other than DOIs whose matching blocks cover 85% of both."""
    return identifier_near(kind, a, b) | (F.coalesce(a != b, F.lit(False)) & (kind != "doi") & _alike(a, b))


def champion(stats: DataFrame, counts: DataFrame, base: str, panel: int, against: int, floor: int, least: float = 0.0) -> DataFrame:
    """One row: the member that wins a round, whether that is the base, and how many cells decided.

    stats: member, n, median, mean, iqr, original_n, original_median, digest; counts: version, cell, n
    (from `census.census`). A member needs a panel of `panel` scores; one that is not the base also
    needs `against` scores against the original with a median of at least `least`. Those left are ranked
    by their defects, cell by cell, over the leading cells up to the first where each has `floor` in
    all; then by median and mean, higher first, spread and digest, never by name. The base stays where
    the winner has its median, mean and spread, or where nobody is left.

    One row a member comes in, so one ordered task is enough.
    """
    is_base = F.col("member") == base
    passes = (F.col("n") >= panel) & (is_base | ((F.col("original_n") >= against) & (F.col("original_median") >= least)))
    left = stats.where(F.coalesce(passes, F.lit(False))).select("member", "median", "mean", "iqr", "digest")
    prefixes = prefix_sums(counts.join(left.select(F.col("member").alias("version")), "version", "left_semi"))
    used = adaptive_prefix(prefixes, floor)
    leading = prefixes.join(F.broadcast(used), F.col("cell") < F.col("cells_used"))  # one row
    lead = leading.groupBy(F.col("version").alias("member")).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "n"))), lambda x: x["n"]).alias("lead"))
    ranked = left.join(lead, "member", "left").withColumn("lead", F.coalesce("lead", F.array().cast("array<long>")))
    best = ranked.orderBy("lead", F.desc_nulls_last("median"), F.desc_nulls_last("mean"), F.asc_nulls_last("iqr"), "digest").limit(1)
    best = best.select("member", *(F.col(c).alias(f"best_{c}") for c in ("median", "mean", "iqr")))
    own = left.where(is_base).select("median", "mean", "iqr").limit(1)
    both = stats.sparkSession.range(1).select().join(best, how="left").join(own, how="left").join(used, how="left")  # one row each
    same = F.col("best_median").eqNullSafe(F.col("median")) & F.col("best_mean").eqNullSafe(F.col("mean")) & F.col("best_iqr").eqNullSafe(F.col("iqr"))
    stays = F.col("member").isNull() | (F.col("member") == base) | (same & F.col("median").isNotNull())
    return both.select(F.when(stays, F.lit(base)).otherwise(F.col("member")).alias("champion"), stays.alias("base_kept"), "cells_used")


def below_floor(p: Column, n: Column, family: Column) -> Column:
    """Whether a corrected p-value is smaller than n signs can give, family * 2 / 2^n, with 2% to spare;
    fewer than five signs tell nothing."""
    floor = family * 2 / F.pow(F.lit(2.0), n)
    return (n >= 5) & (p < floor - F.greatest(F.lit(1e-12), floor * 0.02))
