"""Many line rules in one scan, and their findings fanned out to one artifact each in one job.

Each rule is a pattern; all are evaluated beside each other on a line, so the lines are read and masked
once however many rules there are. Lines have doc_id, line and raw, as from `text.lines_of`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.scalars import match_spans
from inkmill.sources.tables import replace_folder


@dataclass(frozen=True)
class Rule:
    """A rule's name, the artifact its findings go to, how sure it is, and its pattern."""

    name: str
    artifact: str
    tier: str
    pattern: str


#: Rules of the shape of text, in the order of the report.
TEXT_RULES = (
    Rule("double-space", "hygiene", "finding", r" {2,}"),
    Rule("space-before-stop", "hygiene", "finding", r"\s+[,;:.!?]"),
    Rule("repeated-stop", "hygiene", "finding", r"[,;:]{2,}|[!?]{2,}"),
    Rule("empty-brackets", "hygiene", "finding", r"\(\s*\)|\[\s*\]"),
    Rule("comma-glue", "hygiene", "finding", r"[A-Za-z]+,[A-Za-z]+"),
    Rule("stop-glue", "hygiene", "advisory", r"[a-z]{2,}\.[A-Z][a-z]+"),
    Rule("glued-address", "hygiene", "finding", r"[:;)][A-Za-z0-9._-]+@"),
    Rule("straight-quote", "typography", "advisory", r"[\"']"),
    Rule("joined-marks", "typography", "finding", r"[#$%&*]{3,}"),
    Rule("grouped-number", "numbers", "advisory", r"\b[0-9]{1,3}(?:,[0-9]{3})+\b"),
    Rule("plain-number", "numbers", "advisory", r"\b[0-9]{5,}\b"),
    Rule("glued-unit", "numbers", "finding", r"\b[0-9]+(?:mg|ml|kg|km|nm|mm|cm)\b"),
    Rule("leftover", "leftovers", "finding", r"(?i)\b(?:todo|tbd|xxx|fixme|licensed under|all rights reserved)\b"),
)


def bundle(lines: DataFrame, rules: tuple[Rule, ...] = TEXT_RULES, masked: Column | None = None) -> DataFrame:
    """doc_id, line, artifact, rule, tier, start (from 0), match: all findings of all rules in one scan.

    Masked and null lines have none. A rule's matches on a line don't overlap; those of two rules may.
    """
    rows = lines.where(~F.coalesce(masked, F.lit(False))) if masked is not None else lines
    one = lambda r: F.transform(match_spans(F.col("raw"), r.pattern), lambda m: F.struct(F.lit(r.artifact).alias("artifact"), F.lit(r.name).alias("rule"), F.lit(r.tier).alias("tier"), m["start"].alias("start"), m["text"].alias("match")))
    none = F.array().cast("array<struct<artifact:string,rule:string,tier:string,start:int,match:string>>")
    each = F.flatten(F.array(none, *(F.when(F.col("raw").rlike(r.pattern), one(r)).otherwise(none) for r in rules)))
    return rows.select("doc_id", "line", F.explode(each).alias("f")).select("doc_id", "line", "f.*")


def bundle_summary(findings: DataFrame) -> DataFrame:
    """artifact, rule, tier, n, n_docs, first_doc, first_line."""
    keys = ["artifact", "rule", "tier"]
    first = F.min(F.struct("doc_id", "line"))
    each = findings.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), first.alias("first"))
    return out.select(*keys, "n", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))


def write_artifacts(findings: DataFrame, path: str, columns: list[str], parts: int = 8) -> None:
    """One folder an artifact below path, in one job each for JSON rows and for Markdown tables.

    findings need the column artifact; `columns` are those of the tables. An artifact of any size is dealt
    into up to `parts` files by hash, part=0 and so on, each sorted by `columns` and, in Markdown, with a
    head of its own.
    Both folders replace what stood there, whole or not at all.
    """
    salt = F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")
    dealt = findings.select("artifact", *columns, salt.alias("part")).repartition("artifact", "part")

    def json_rows(new: str) -> None:
        dealt.sortWithinPartitions("artifact", "part", *columns).write.partitionBy("artifact", "part").json(new)

    def markdown(new: str) -> None:
        cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")
        body = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(cell(c), F.lit("|"), F.lit("\\|")) for c in columns)), F.lit(" |"))
        heads = dealt.select("artifact", "part").distinct().select("artifact", "part", F.posexplode(F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "---|" * len(columns)))).alias("place", "value"))
        rows = dealt.select("artifact", "part", F.lit(2).alias("place"), body.alias("value"), *columns)
        both = heads.unionByName(rows, allowMissingColumns=True).repartition("artifact", "part").sortWithinPartitions("artifact", "part", "place", *columns)
        both.select("artifact", "part", "value").write.partitionBy("artifact", "part").text(new)

    write: Callable[[str, Callable[[str], None]], None] = lambda name, how: replace_folder(findings.sparkSession, f"{path.rstrip('/')}/{name}", how)
    write("json", json_rows)
    write("markdown", markdown)
