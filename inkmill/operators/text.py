"""Inventories over the lines and tokens of documents, and rules that give one row per finding.

Input tables have doc_id and text; lines are counted from 1 and blank lines keep their number.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions.scalars import let, spelling_key


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line, raw: every physical line of every text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).alias("line"), "raw")


def matches_of(lines: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """One row per match of a pattern: doc_id, line, nth (from 1), match."""
    hits = F.posexplode(F.regexp_extract_all("raw", F.lit(pattern), F.lit(group))).alias("nth", "match")
    return lines.select("doc_id", "line", "raw", hits).withColumn("nth", F.col("nth") + 1)


def occurrences(lines: DataFrame, term: str, exact: str | None = None) -> DataFrame:
    """doc_id, line, match, exact, excerpt of each variant of a term: any case, hyphen or spaces
    between words, optional plural."""
    words = [w for w in term.split() if w]
    pattern = r"(?i)\b" + r"[\s-]*".join(words) + r"(?:es|s)?\b"
    found = matches_of(lines, pattern)
    return found.select("doc_id", "line", "match", (F.col("match") == F.lit(exact or term)).alias("exact"), F.left(F.trim("raw"), F.lit(140)).alias("excerpt"))


#: Words as Unicode letters, digits and underscores, whatever the regular-expression dialect calls a word.
WORDS = r"[\p{L}\p{N}_]+"


def acronyms(lines: DataFrame, least: int = 1) -> DataFrame:
    """All-caps tokens: occurrences, documents, first use by (document, line)."""
    tokens = matches_of(lines, WORDS).where(F.col("match").rlike("^[A-Z]{2,}$"))
    first = F.min(F.struct("doc_id", "line"))
    out = tokens.groupBy(F.col("match").alias("token")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), first.alias("f"))
    return out.where(F.col("n") >= least).select("token", "n", "n_docs", F.col("f.doc_id").alias("first_doc"), F.col("f.line").alias("first_line"))


def place_of(tokens: DataFrame) -> Column:
    """One value that orders tokens by doc_id, line and nth, null ids first.

    For whole ids it is a number, so that aggregations keep one row a group in a hash table; a least
    struct would have them sort all tokens first. A text has fewer than 2^31 lines and 10^9 matches a line.
    """
    if not isinstance(tokens.schema["doc_id"].dataType, T.IntegralType):
        return F.struct("doc_id", "line", "nth")
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(-(10**19 - 1))))
    within = F.col("line").cast("long") * F.lit(10**9) + F.col("nth")
    return doc * F.lit(Decimal(10**19)) + within.cast("decimal(19,0)")


def families(tokens: DataFrame, key: Callable[[Column], Column], surface: Column, least: int = 0, least_count: int = 1, need: str | None = None) -> DataFrame:
    """Surfaces that share a key: forms, the majority form (ties: the one used first), occurrences.

    Occurrences are counted by surface before anything else, so keys are made of distinct surfaces and a
    group holds distinct forms only. Keys of fewer than `least` characters have no family.
    """
    counts = tokens.select(surface.alias("surface"), place_of(tokens).alias("at")).groupBy("surface").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    counts = counts.withColumn("key", key(F.col("surface"))).where(F.length("key") >= least)
    out = counts.groupBy("key").agg(
        F.count("*").alias("n_forms"), F.min("n").alias("least"), F.sum("n").alias("n"),
        F.array_sort(F.collect_list("surface")).alias("forms"), F.min(F.struct(-F.col("n"), "at", "surface"))["surface"].alias("majority"),
        F.bool_or(F.col("surface").contains(need) if need else F.lit(True)).alias("has"),
    )
    return out.where((F.col("n_forms") >= 2) & (F.col("least") >= least_count) & F.col("has")).select("key", "n_forms", "n", F.array_join("forms", "|").alias("forms"), "majority")


def spelling_families(lines: DataFrame, least: int = 5) -> DataFrame:
    return families(matches_of(lines, r"[A-Za-z]{5,}"), spelling_key, F.lower("match"), least)


def hyphen_families(lines: DataFrame, least: int = 5) -> DataFrame:
    low = F.lower(F.regexp_replace("match", "^-+|-+$", ""))
    return families(matches_of(lines, r"[A-Za-z][A-Za-z-]{4,}"), lambda s: F.regexp_replace(s, "-", ""), low, least, least_count=2, need="-")


def case_families(lines: DataFrame) -> DataFrame:
    return families(matches_of(lines, r"[A-Za-z]{2,}"), F.lower, F.col("match"))


def repeated_lines(lines: DataFrame, least: int = 2) -> DataFrame:
    norm = F.trim(F.regexp_replace("raw", r"\s+", " "))
    counts = lines.select("doc_id", norm.alias("norm")).where("norm <> ''").groupBy("doc_id", "norm").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def page_furniture(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """Lines on at least max(2, whole part of share * pages) of a document, counted by occurrence.

    pages: doc_id, page, text.
    """
    lines = pages.select("doc_id", "page", F.explode(F.split("text", "\n")).alias("raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    totals = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    counts = lines.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).join(totals, "doc_id")
    return counts.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * share)))


def vocabulary(lines: DataFrame, least: int = 2) -> DataFrame:
    words = matches_of(lines, WORDS).where(F.col("match").rlike("^[A-Z][a-z]{3,}$"))
    return words.groupBy(F.col("match").alias("term")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def identifiers(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """kind, value, first document and line of each distinct identifier."""
    found = [matches_of(lines, p).select(F.lit(k).alias("kind"), F.lower("match").alias("value"), "doc_id", "line") for k, p in kinds.items()]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    out = rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("f"))
    return out.select("kind", "value", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.line").alias("first_line"))


def carried(lines: DataFrame, is_heading: Column, label: Column, start: str = "front") -> DataFrame:
    """`section`: the last heading at or before each line; `part`: how many headings so far."""
    order = Window.partitionBy("doc_id").orderBy("line")
    last = F.last(F.when(is_heading, label), ignorenulls=True).over(order)
    return lines.withColumn("section", F.coalesce(last, F.lit(start))).withColumn("part", F.sum(F.when(is_heading, 1).otherwise(0)).over(order))


def claim_strength(lines: DataFrame, hedges: list[str], absolutes: list[str]) -> DataFrame:
    count = lambda words: F.regexp_count(F.lower("raw"), F.lit(r"\b(" + "|".join(words) + r")\b"))
    out = lines.select("doc_id", "line", count(hedges).alias("n_hedge"), count(absolutes).alias("n_absolute"))
    return out.where("n_hedge > 0 OR n_absolute > 0")


def confusable_pairs(lines: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Documents with both members of a pair: lines with each, and lines with both."""
    has = lambda w: F.lower("raw").rlike(rf"\b{w}\b")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), has(a).alias("in_a"), has(b).alias("in_b")) for a, b in pairs)))
    rows = lines.select("doc_id", each.alias("p")).select("doc_id", "p.*").where("in_a OR in_b")
    out = rows.groupBy("doc_id", "a", "b").agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"))
    return out.where("n_a > 0 AND n_b > 0")


def key_terms(lines: DataFrame, terms: list[str]) -> DataFrame:
    """Per term: lines that contain it, the first of them and its opening 120 characters."""
    each = F.explode(F.array(*map(F.lit, terms))).alias("term")
    rows = lines.select("doc_id", "line", "raw", each).where(F.contains(F.lower("raw"), F.lower("term")))
    out = rows.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line", F.left("raw", F.lit(120)).alias("context"))).alias("f"))
    return out.select("term", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.line").alias("first_line"), F.col("f.context").alias("context"))


def term_repetition(lines: DataFrame, size: int = 3, top: int = 3) -> DataFrame:
    """The most repeated word n-grams of each line: up to `top` by count, then length, then text."""
    words = F.regexp_extract_all(F.lower("raw"), F.lit(r"[a-z]+"), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    rows = lines.select("doc_id", "line", words.alias("w")).where(F.size("w") >= size).select("doc_id", "line", F.sort_array(grams).alias("g"))

    def counted(g: Column) -> Column:
        """(-n, -length, gram) of each run of equal grams in sorted ones that has two or more."""
        starts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: ~F.get(g, i).eqNullSafe(F.get(g, i - 1)) & F.get(g, i).eqNullSafe(F.get(g, i + 1)))
        ends = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i).eqNullSafe(F.get(g, i - 1)) & ~F.get(g, i).eqNullSafe(F.get(g, i + 1)))
        return F.zip_with(starts, ends, lambda a, b: F.struct((a - b - 1).alias("less"), (-F.length(F.get(g, a))).alias("short"), F.get(g, a).alias("gram")))

    # Every line is one row from its text to its places: nothing is shuffled.
    best = F.slice(F.sort_array(let(F.col("g"), counted)), 1, top)
    found = rows.select("doc_id", "line", F.posexplode(best).alias("at", "b"))
    return found.select("doc_id", "line", F.col("b.gram").alias("gram"), (-F.col("b.less")).cast("long").alias("n"), (F.col("at") + 1).alias("place"))


def length_caps(docs: DataFrame, line_cap: int, factor: float) -> DataFrame:
    """Lines over the relaxed word cap: floor(cap * factor + 1e-9)."""
    words = F.regexp_count("raw", F.lit(r"[^\s]+"))
    return lines_of(docs).select("doc_id", "line", words.alias("n_words"), F.floor(F.lit(line_cap * factor + 1e-9)).alias("cap")).where("n_words > cap")


def number_ledger(lines: DataFrame) -> DataFrame:
    """Numbers with the word after them and whether thousands are grouped."""
    found = matches_of(lines, r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?: [A-Za-z]+)?")
    number = F.regexp_extract("match", r"^([0-9.,]+)", 1)
    return found.select("doc_id", "line", "nth", number.alias("number"), F.regexp_extract("match", r" ([A-Za-z]+)$", 1).alias("unit"), number.contains(",").alias("grouped"))


def comma_glue(lines: DataFrame, limit: int = 24) -> DataFrame:
    """Words glued by a comma without a space, up to `limit` of a document by (line, nth)."""
    found = matches_of(lines, r"[A-Za-z]+,[A-Za-z]+")
    order = Window.partitionBy("doc_id").orderBy("line", "nth")
    return found.select("doc_id", "line", "nth", "match", F.row_number().over(order).alias("rn")).where(F.col("rn") <= limit).drop("rn")


def empty_runs(lines: DataFrame, allowed: int = 1) -> DataFrame:
    """Islands of blank lines longer than allowed: first line and length."""
    blank = lines.where(F.trim("raw") == "")
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    out = blank.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line").alias("first_line"), F.count("*").alias("n"))
    return out.where(F.col("n") > allowed).drop("island")


def leftovers(lines: DataFrame, phrases: list[str], limit: int = 24) -> DataFrame:
    """The first listed phrase of each line that has one."""
    hit = F.coalesce(*(F.when(F.contains(F.lower("raw"), F.lit(p.lower())), F.lit(p)) for p in phrases)) if phrases else F.lit(None).cast("string")
    return lines.select("doc_id", "line", hit.alias("phrase")).where("phrase IS NOT NULL")


def glued_mail(lines: DataFrame) -> DataFrame:
    """Lines where an address touches a colon or a bracket, or a label colon lacks its space."""
    return lines.where(F.col("raw").rlike(r"[:;)][A-Za-z0-9._-]+@|[A-Za-z]:[A-Za-z0-9._-]+@")).select("doc_id", "line")


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def masked(text: Column) -> Column:
    """Addresses, links, identifiers and paths blanked."""
    return F.regexp_replace(text, r"https?://[^\s]+|10\.[0-9]{4,9}/[^\s]+|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|/[A-Za-z0-9_.-]+/[^\s]+", " ")


def without_comment(text: Column) -> Column:
    r"""A TeX line up to its first unescaped percent sign."""
    return F.regexp_extract(text, r"^([^%\\]*+(?:\\.[^%\\]*+)*+)", 1)  # runs at a time: long lines don't pile up calls


def order_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First occurrences smaller than an earlier first occurrence. rows: keys, pos, n."""
    first = rows.groupBy(*keys, "n").agg(F.min("pos").alias("pos"))
    before = Window.partitionBy(*keys).orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("most", F.max("n").over(before)).where("n < most")
