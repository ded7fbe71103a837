"""Delimited tables that stand in a text column: dialect, header and body as expressions, and their cells
as rows. Quotes may hold delimiters and line ends; nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.scalars import let

#: Delimiters in the order they are preferred, with how often a header must have one.
DELIMITERS = (("\t", 1), ("|", 2), (",", 1))
LEAST_LINES = 3


def _field(delimiter: str) -> str:
    """A field with what stands before it: a line end or the delimiter."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return rf'(?:\n|{d}) *+(?:"[^"]*+(?:""[^"]*+)*+(?:"[^\n{d}]*+|\z)|[^\n{d}]*+)'


def _value(match: Column) -> Column:
    """A field's text: quotes taken off, doubled ones made single, spaces around it removed."""
    own = F.ltrim(F.substring(match, 2, F.length(match)))
    inner, after = F.regexp_extract(own, r'(?s)^"([^"]*+(?:""[^"]*+)*+)', 1), F.regexp_extract(own, r'(?s)^"[^"]*+(?:""[^"]*+)*+"?(.*)$', 1)
    return F.regexp_replace(F.when(own.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), after)).otherwise(own), r"^\s+|\s+$", "")


def _records(text: Column, delimiter: str) -> Column:
    """All records as arrays of fields. A line end before a field starts a record."""
    matches = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(_field(delimiter)), F.lit(0))

    def cut(found: Column) -> Column:
        starts = F.filter(F.transform(found, lambda m, i: F.when(m.startswith("\n"), i + 1)), lambda s: s.isNotNull())
        length = F.size(found)
        return let(F.transform(found, _value), lambda fields: let(starts, lambda s: F.transform(s, lambda at, i: F.slice(fields, at, F.coalesce(F.get(s, i + 1), length + 1) - at))))

    return F.filter(let(matches, cut), lambda r: (F.size(r) > 1) | (F.get(r, F.lit(0)) != ""))


def _edges(record: Column, lead: Column, trail: Column) -> Column:
    """A record of a table with bars at its edges, without the empty first and last field they make."""
    left = F.when(lead & (F.get(record, F.lit(0)) == ""), F.slice(record, 2, F.size(record))).otherwise(record)
    return F.when(trail & (F.size(left) > 0) & (F.element_at(left, -1) == ""), F.slice(left, 1, F.size(left) - 1)).otherwise(left)


def tables_of(texts: DataFrame) -> DataFrame:
    """doc_id, delimiter, header, body, agreement: the table that each text is, if it is one.

    The first line with text tells the delimiter: a tab, else two bars, else a comma; a text needs three
    such lines, a header of two fields and a body. Bars at the header's edges are edges in all rows, and a
    row of dashes under the header goes. agreement is the share of body rows with as many fields as the
    header. Null texts are no tables.
    """
    text = F.regexp_replace("text", r"\r\n?", "\n")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")
    rows = texts.select("doc_id", text.alias("text"), lines.alias("lines")).where(F.size("lines") >= LEAST_LINES)
    head = F.get("lines", F.lit(0))
    enough = [(d, F.size(F.split(head, "\\" + d if d == "|" else d, -1)) > n) for d, n in DELIMITERS]
    delimiter = F.coalesce(*(F.when(when, F.lit(d)) for d, when in enough))
    rows = rows.select("doc_id", "text", F.trim(head).alias("head"), delimiter.alias("delimiter")).where("delimiter IS NOT NULL")
    records = reduce(lambda out, d: F.when(F.col("delimiter") == d[0], _records(F.col("text"), d[0])).otherwise(out), reversed(DELIMITERS[1:]), _records(F.col("text"), "\t"))
    bars = F.col("delimiter") == "|"
    # Exploding one value keeps the optimizer from writing the records out anew in every filter below.
    rows = rows.select("doc_id", "delimiter", "head", F.explode(F.array(records)).alias("records"))
    lead, trail = bars & F.col("head").startswith("|"), bars & F.col("head").endswith("|")
    rows = rows.select("doc_id", "delimiter", F.explode(F.array(F.transform("records", lambda r: _edges(r, lead, trail)))).alias("records"))
    second = F.get("records", F.lit(1))
    ruler = F.coalesce(bars & (F.size(second) > 0) & F.forall(second, lambda c: c.rlike(r"^:?-{2,}:?$")), F.lit(False))
    body = F.slice("records", F.when(ruler, 3).otherwise(2), F.size("records"))
    rows = rows.select("doc_id", "delimiter", F.get("records", F.lit(0)).alias("header"), body.alias("body")).where((F.size("header") >= 2) & (F.size("body") > 0))
    same = F.size(F.filter("body", lambda r: F.size(r) == F.size("header"))) / F.size("body")
    return rows.withColumn("agreement", same)


def table_cells(tables: DataFrame) -> DataFrame:
    """doc_id, row (from 1), label, place (from 1), column, cell: a table's body in long form; the label is
    the row's first field. Fields beyond the header's have no column and are left out."""
    rows = tables.select("doc_id", "header", F.posexplode("body").alias("row", "fields"))
    cells = F.posexplode(F.slice("fields", 1, F.size("header"))).alias("at", "cell")
    out = rows.select("doc_id", (F.col("row") + 1).alias("row"), "header", F.get("fields", F.lit(0)).alias("label"), cells)
    return out.select("doc_id", "row", "label", (F.col("at") + 1).alias("place"), F.get("header", F.col("at")).alias("column"), "cell")
