"""Score CSVs, listings of files, lenient JSON, literals in code, and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.operators.regions import states

SCORES = T.StructType([T.StructField(c, T.StringType()) for c in (
    "round", "member", "opponent_id", "credited", "score_as_written", "direction", "opponent_label", "sheet_target",
    "source_judge_run", "source_judge_index", "basis", "resolved", "introduced", "reason",
)])


#: Score files by name, and any CSV file.
NAMED_SCORES = "*[rR][oO][uU][nN][dD][0-9]*_[rR][aA][wW]_[sS][cC][oO][rR][eE][sS].[cC][sS][vV]"
ANY_CSV = "*.[cC][sS][vV]"


def score_files(spark: SparkSession, folder: str) -> str:
    """Which files of a folder are read: those named round<N>_raw_scores.csv, else all CSV files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", NAMED_SCORES).load(folder).select("path")
    return ANY_CSV if listed.isEmpty() else NAMED_SCORES


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score files under a folder (see `score_files`), quoted line breaks kept, faults raised.

    `ord` is the path, then the row: a file with quoted line breaks is read by one task, so its rows
    keep their order, and how files are dealt to tasks makes no difference.
    """
    rows = spark.read.schema(SCORES).csv(
        folder, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", pathGlobFilter=score_files(spark, folder), recursiveFileLookup=True, enforceSchema=False
    )
    path = F.col("_metadata.file_path")
    named = F.nullif(F.regexp_extract(path, r"(?i)round(\d+)", 1), F.lit(""))
    return rows.select(
        F.coalesce(F.nullif(F.trim("round"), F.lit("")), named, F.lit("1")).alias("round"), "member", F.col("opponent_id").alias("opponent"), "credited", "score_as_written", "direction",
        F.col("source_judge_run").alias("judge"), F.col("source_judge_index").alias("judge_index"), F.col("sheet_target").alias("sheet"), path.alias("path"),
        F.struct(path.alias("path"), F.monotonically_increasing_id().alias("row")).alias("ord"),
    )


#: A field of a row, and a row all of whose quotes are closed. A quote opens only where a field starts.
_FIELD = r'(?: *"[^"]*(?:""[^"]*)*"(?:[^",][^,]*)?| *[^", ][^,]*| *)'
CLOSED_ROW = rf"^{_FIELD}(?:,{_FIELD})*$"
CLOSES_QUOTE = r'^[^"]*(?:""[^"]*)*"(?:$|[^"])'
AFTER_QUOTE = r'^[^"]*(?:""[^"]*)*"((?:$|[^"]).*)$'
MARKER, PROMPT = r"^\s*==> (.+) <==\s*$", r"^\(base\) |\$$"


def dump_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of a `==> path <==` listing: doc_id, path, block, nth (from 1), raw. lines: doc_id, line, raw.

    A marker inside an open quotation is text. Outside quotations blank lines go, and so do lines without
    a comma that are a shell's prompt. What comes before a document's first marker is left out.
    """
    raw = F.coalesce("raw", F.lit(""))
    rest = F.regexp_extract(raw, AFTER_QUOTE, 1)
    # 0 between fields' quotations, 1 inside one, 2 before the first marker
    outside = F.when(raw.rlike(CLOSED_ROW), 0).otherwise(1)
    inside = F.when(~raw.rlike(CLOSES_QUOTE), 1).when(~rest.contains(","), 0).when(F.regexp_extract(rest, "^[^,]*,(.*)$", 1).rlike(CLOSED_ROW), 0).otherwise(1)
    before = F.when(raw.rlike(MARKER), 0).otherwise(2)
    rows = states(lines.select("doc_id", "line", raw.alias("raw")), F.array(F.when(raw.rlike(MARKER), 0).otherwise(outside), inside, before), start=2)
    head = F.when((F.col("before") != 1) & F.col("raw").rlike(MARKER), F.regexp_extract("raw", MARKER, 1))
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = rows.withColumn("head", head).withColumn("path", F.last("head", ignorenulls=True).over(order)).withColumn("block", F.count("head").over(order))
    text = (F.col("before") == 1) | ((F.trim("raw") != "") & ~(~F.contains("raw", F.lit(",")) & F.col("raw").rlike(PROMPT)))
    rows = rows.where(F.col("path").isNotNull() & F.col("head").isNull() & text)
    return rows.select("doc_id", "path", "block", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("line")).alias("nth"), "raw")


def dumps(lines: DataFrame) -> DataFrame:
    """doc_id of the texts that are listings of score files: the first row with a comma of some block
    names an opponent column. lines: doc_id, line, raw."""
    rows = dump_blocks(lines).where(F.contains("raw", F.lit(",")))
    heads = rows.groupBy("doc_id", "block").agg(F.min_by("raw", "nth").alias("head"))
    names = F.transform(F.split("head", ","), lambda x: F.lower(F.regexp_replace(x, r"^[\s\"]+|[\s\"]+$", "")))
    return heads.where(F.arrays_overlap(names, F.array(F.lit("opponent_id"), F.lit("opponent_label")))).select("doc_id").distinct()


def lenient_json(text: Column, schema: str) -> Column:
    """The object in a fenced block, or in the outermost braces, of prose around it."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.nullif(fenced, F.lit("")), schema), F.from_json(F.nullif(braces, F.lit("")), schema))


def code_literals(lines: DataFrame) -> DataFrame:
    """`NAME = literal` lines: name and literal text. lines: doc_id, line, raw."""
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*([0-9][0-9_.eE+-]*|\"[^\"]*\"|'[^']*')\s*[,;]?\s*$"
    return lines.select("doc_id", "line", F.regexp_extract("raw", pattern, 1).alias("name"), F.regexp_extract("raw", pattern, 2).alias("literal")).where("name <> ''")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside `path`, then put the finished folder in its place: a failed write leaves what was
    there. Where a store renames by copying, a reader may meet the folder missing in between."""
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def move(a: str, b: str) -> None:
        if not fs.rename(path_of(a), path_of(b)):
            raise OSError(f"can't move {a} to {b}")

    try:
        write(new)
        held = fs.exists(path_of(path))
        if held:
            move(path, old)
        try:
            move(new, path)
        except Exception:
            if held:
                move(old, path)
            raise
        if held:
            fs.delete(path_of(old), True)
    finally:
        fs.delete(path_of(new), True)


def write_csv(df: DataFrame, path: str) -> None:
    """Whole or not at all: finished files take the place of the folder's old ones."""
    replace_folder(df.sparkSession, path, lambda new: df.write.option("header", True).option("escape", '"').csv(new))


def write_json(df: DataFrame, path: str) -> None:
    replace_folder(df.sparkSession, path, lambda new: df.write.json(new))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as an aligned Markdown table; more than `most` rows end in a note."""
    rows = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in df.limit(most + 1).collect()]
    more, rows = len(rows) > most, rows[:most]
    width = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    out = [line(df.columns), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)]
    return "\n".join([*out, *(["INCOMPLETE: more rows exist"] if more else [])])
