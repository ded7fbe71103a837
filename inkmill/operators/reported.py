"""Values that lines report under a label, each in one canonical spelling, their inventory and where they
disagree. Lines have doc_id, line and raw, as from `text.lines_of`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.operators.claims import inventory

#: Labels and the patterns of their values, in the order of the report. A pattern's first group
#: is the value; an interval has two.
LABELS = (
    (
        "p-value",
        r"\b[pP](?:(?:\s*[-_]?\s*[vV]alues?)\s*(?:<=|>=|[=<>≤≥]|\bof\b)|\s*(?:<=|>=|[=<>≤≥]))\s*"
        r"((?:\d+\.?\d*|\.\d+)(?:[eE][+\-−]?\d+)?(?:\s*(?:[×x]|\\times)\s*10\s*(?:\^\s*\{?\s*[+\-−]?\d+\s*\}?|[⁰¹²³⁴-⁹⁻]+))?)",
    ),
    ("n", r"\b[nN]\s*=\s*(\d{1,3}(?:[,   ]\d{3})+|\d+)\b(?![.,]\d)(?![   ]\d{3}\b)"),
    ("AUC", r"(?i)\bAU(?:C|ROC)\s*[:=]\s*([+\-−]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+\-−]?\d+)?%?)"),
    ("AUC", r"(?i)\bAU(?:C|ROC)\s*(?:(?:was|is|of|approximately|approx\.?|about)\s*)*([0-9](?:\.\d+)?%?)(?!\d|\.\d)"),
    ("percentage", r"(?<![\w.])([+\-−]?(?:\.\d+|\d{1,4}(?:\.\d+)?))\s*%"),
    ("CI", r"(?i)\bCI\s*(?:[:=,]\s*)?(?:[\[(]\s*)?([+\-−]?\d+(?:\.\d+)?)\s*(?:[–—−-]|to|,)\s*([+\-−]?\d+(?:\.\d+)?)\s*[\]\)]?"),
    ("R2", r"(?i)\bR(?:\^?2|²)\s*(?:[:=]|\bwas\b|\bis\b|\bof\b)\s*([+\-−]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+\-−]?\d+)?)\b"),
    ("fold", r"(?i)\b(\d+\.?\d*)[- ]?fold\b"),
    ("accession", r"(?i)\b(GSE\d+|PRJNA\d+|SR[APRX]\d+|E-MTAB-\d+|zenodo\.\d+)\b"),
    ("version", r"(?i)\b(?:v(?:er(?:sion)?)?\.?\s?)(\d+(?:\.\d+)+)\b"),
)
#: What a match of a label opens with, sought first: to Java a word boundary is dear, and would be tried everywhere.
_OPENS = {
    "p-value": "(?=[pP])", "n": "(?=[nN])", "AUC": "(?=[aA])", "percentage": r"(?=[+\-−.\d])", "CI": "(?=[cC])", "R2": "(?=[rR])", "fold": r"(?=\d)",
    "accession": "(?=[gpseGPSEzZ])", "version": "(?=[vV])",
}
#: Labels of numbers; the others are names.
NUMERIC = ("p-value", "n", "AUC", "percentage", "CI", "R2", "fold")
#: Labels whose keys need more than the pattern's first group.
WHOLE = ("p-value", "CI")
SHOWN = 12


def _number(text: Column) -> Column:
    """The double that a spelling stands for, as text; the spelling itself where it is none."""
    plain = F.translate(F.regexp_replace(F.replace(text, F.lit("\\times"), F.lit("x")), r"[{}\s,  ]", ""), "×−⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "x--0123456789")
    value = F.regexp_replace(plain, r"x10\^?", "e").try_cast("double")
    return F.coalesce(value.cast("string"), text)


def canonical(label: str, operator: Column, value: Column, upper: Column) -> Column:
    """A value in one spelling: `p < .050` and `P < 0.05`, `n = 1,234` and `n=1234`, `5 × 10⁻⁸` and `5e-8`
    are the same; a p-value keeps its comparator, an interval both ends, a count all its digits."""
    if label == "n":
        digits = F.regexp_replace(value, r"[,\s  ]", "")
        return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    if label == "CI":
        return F.concat(_number(value), F.lit(".."), _number(upper))
    return F.concat(operator, _number(value)) if label in NUMERIC else F.lower(value)


def spelled_values(lines: DataFrame) -> DataFrame:
    """doc_id, line, label, said: what is found under a label, whole where its value doesn't tell all."""

    def of(label: str, pattern: str) -> Column:
        found = F.regexp_extract_all("raw", F.lit(_OPENS[label] + pattern), F.lit(0 if label in WHOLE else 1))
        return F.transform(found, lambda m: F.struct(F.lit(label).alias("label"), m.alias("said")))

    every = F.explode(F.concat(*(of(*x) for x in LABELS))).alias("m")
    return lines.where("raw IS NOT NULL").select("doc_id", "line", every).select("doc_id", "line", "m.*")


def _of_label(of: Callable[[str, str], Column]) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in dict(LABELS).items():
        out = F.when(F.col("label") == label, of(label, pattern)).otherwise(out)
    return out


def _value(label: str, pattern: str) -> Column:
    return F.regexp_extract("said", pattern, 1) if label == "p-value" else F.col("said")


def _key(label: str, pattern: str) -> Column:
    operator = F.translate(F.regexp_extract("said", "(<=|>=|[<>≤≥])", 1), "≤≥", "<>") if label == "p-value" else F.lit("")
    ends = [F.regexp_extract("said", pattern, i) for i in (1, 2)] if label == "CI" else [_value(label, pattern), F.lit("")]
    return canonical(label, operator, *ends)


def reported_values(lines: DataFrame) -> DataFrame:
    """doc_id, line, label, value (as written), key (canonical): every value under a label. Null lines
    have none."""
    return spelled_values(lines).select("doc_id", "line", "label", _of_label(_value).alias("value"), _of_label(_key).alias("key"))


def line_inventory(lines: DataFrame, shown: int = SHOWN) -> DataFrame:
    """value_inventory() of the values of lines: a key is made once for each spelling in a document, and
    only lines of documents that places are in are scanned again."""
    keyed = lambda x: x.withColumn("key", _of_label(_key))
    return inventory(spelled_values(lines), ["label", "key"], shown, ["label", "said"], keyed, lambda some: spelled_values(some(lines)))


def value_inventory(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """label, key, n, n_docs, places: how often each value is reported, and its first `shown` places."""
    return inventory(found, ["label", "key"], shown)


def value_divergence(found: DataFrame, context: str = "doc_id") -> DataFrame:
    """context, label, n_values: numbers that one context reports in several values."""
    values = found.where(F.col("label").isin(*NUMERIC)).groupBy(context, "label").agg(F.count_distinct("key").alias("n_values"))
    return values.where("n_values > 1")
