"""Contact facts of a package before and after a revision, and printed statistics below what they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
#: Hosts and names that stand for an address to be filled in.
PLACEHOLDER_ADDRESS = r"(?i)@(?:example\.(?:com|org|net)|domain\.com|email\.com)$|^(?:your|author|name|firstname\.lastname)@"

#: What a table of adjusted p-values says of itself, its rows in print and in LaTeX, its family.
POOLED, ADJUSTED = r"(?i)single\s+pooled\s+family", r"(?i)Holm"
PRINTED_ROW = r"\b(?:10|none)\s+(\d{1,3})\s+(\d+(?:\.\d+)?(?:\s*[×x]\s*10\s*[+−-]?\s*\d+|[eE][+−-]?\d+)?)\b"
LATEX_ROW = r"&\s*(?:10|none)\s*&\s*(\d{1,3})\s*&\s*(?:\\textbf\{)?(\d+(?:\.\d+)?(?:\s*\\times\s*10\^\{?[+−-]?\d+\}?|[eE][+−-]?\d+)?)"
FAMILY_OF_TESTS, FAMILY_OF = r"(?i)\b(\d{1,3})[-\s]+tests?[-\s]+family\b", r"(?i)\bfamily\s+of\s+(\d{1,3})\b"
LEAST_ROWS, LEAST_PAIRS, TOLERANCE = 5, 5, 0.02


def addresses(texts: DataFrame) -> DataFrame:
    """package, address: the distinct addresses of texts of package and text, lower-cased."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(ADDRESS), F.lit(0)))).alias("address")
    return texts.where(F.contains("text", F.lit("@"))).select("package", found).distinct()


def address_changes(before: DataFrame, after: DataFrame, evidence: DataFrame, verified: DataFrame) -> DataFrame:
    """package, address, change, level: addresses that a revision adds, loses or should have replaced.

    before, after: package, text; evidence: text; verified: package, old, new (old may be null).
    An added address is an `error` unless evidence has it word for word or a row verifies it. A removed
    one is a `warning` unless it is a placeholder or a verified address that is there replaces it. A
    replaced address that is still there is a `warning` (`superseded`). Case doesn't count.
    """
    old, new = addresses(before), addresses(after)
    known = addresses(evidence.select(F.lit("").alias("package"), "text")).select("address")
    rows = verified.select("package", F.lower(F.trim("old")).alias("old"), F.lower(F.trim("new")).alias("new"))
    checked = rows.select("package", F.col("new").alias("address")).where("address IS NOT NULL").distinct()
    added = new.join(old, ["package", "address"], "left_anti").join(known, "address", "left_anti").join(checked, ["package", "address"], "left_anti")
    there = rows.join(new.withColumnRenamed("address", "new"), ["package", "new"], "left_semi").select("package", F.col("old").alias("address")).distinct()
    removed = old.join(new, ["package", "address"], "left_anti").where(~F.col("address").rlike(PLACEHOLDER_ADDRESS)).join(there, ["package", "address"], "left_anti")
    moved = rows.where("old <> new").select("package", F.col("old").alias("address")).distinct()
    left = new.join(moved, ["package", "address"], "left_semi")
    said = lambda df, change, level: df.select("package", "address", F.lit(change).alias("change"), F.lit(level).alias("level"))
    return said(added, "added", "error").unionByName(said(removed, "removed", "warning")).unionByName(said(left, "superseded", "warning"))


def printed_p(text: Column) -> Column:
    """A printed p-value as a double: plain, with an e, or times a power of ten."""
    plain = F.regexp_replace(F.translate(F.replace(text, F.lit("\\times"), F.lit("x")), "−×", "-x"), r"[{}\s]", "")
    return F.regexp_replace(plain, r"x10\^?", "e").try_cast("double")


def floor_violations(lines: DataFrame) -> DataFrame:
    """doc_id, line, n, p, family: printed adjusted p-values that no test of n pairs can reach.

    Read only where a document says that it adjusts over a single pooled family, and five rows or more
    of five pairs or more can be read. The least p is family * 2 / 2^n, with TOLERANCE to spare; the
    family is the stated one, the first that is, else the number of rows. A line gives its first row.
    """
    raw = F.coalesce("raw", F.lit(""))
    says = lines.groupBy("doc_id").agg(F.bool_or(raw.rlike(POOLED)).alias("pooled"), F.bool_or(raw.rlike(ADJUSTED)).alias("adjusted"))
    says = says.where("pooled AND adjusted").select("doc_id")
    at = F.struct("line")
    first = lambda p: F.min(F.when(raw.rlike(p), F.struct(at.alias("at"), F.regexp_extract(raw, p, 1).cast("int").alias("m"))))["m"]
    stated = lines.join(says, "doc_id", "left_semi").groupBy("doc_id").agg(F.coalesce(first(FAMILY_OF_TESTS), first(FAMILY_OF)).alias("stated"))
    text = F.col("raw")
    part = lambda i: F.when(text.rlike(PRINTED_ROW), F.regexp_extract(text, PRINTED_ROW, i)).when(text.rlike(LATEX_ROW), F.regexp_extract(text, LATEX_ROW, i))
    rows = lines.join(says, "doc_id", "left_semi").select("doc_id", "line", part(1).cast("int").alias("n"), printed_p(part(2)).alias("p")).where(F.col("p").isNotNull() & (F.col("n") >= LEAST_PAIRS))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= LEAST_ROWS).join(stated, "doc_id")
    rows = rows.join(counts.select("doc_id", F.coalesce("stated", "n_rows").cast("long").alias("family")), "doc_id")
    floor = F.col("family") * 2 / F.pow(F.lit(2.0), F.col("n"))
    return rows.where(F.col("p") < floor - F.greatest(F.lit(1e-12), floor * TOLERANCE)).select("doc_id", "line", "n", "p", "family")
