"""Where the numbers and the denials of a text stand in the tables that come with it.

Tables come in long form: file, row (a number), label (the row's name), column, place (the column's
number), cell. Numbers are matched by value and by context: a sentence must share a noun with the
column or file, and where it names a row of the file, the value must stand in the row it names best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import scalars as X
from inkmill.operators.dictionary import dictionary_hits
from inkmill.operators.rounds import settled

#: Words that tie nothing, kinds of line that prove nothing, words of another statistic.
CONTEXT_STOPWORDS = (
    "n no value values data dataset datasets file files table tables column columns row rows number numbers count counts total mean median "
    "min max sum the a an of in on for and or with from by to at as is are was were be been this that these those we our it its"
).split()
UNPROVABLE_KINDS = ("front", "heading", "refs", "references", "table")
ESTIMATORS = ("mean", "average", "median", "rate", "proportion", "percentage", "ratio", "fraction", "share")
#: What a denial says, and the denials that speak of methods only if a method is named.
DENIAL = (
    r"(?i)\b(?:could\s+not\s+be\s+(?:run|executed|evaluated|included|applied)|was\s+not\s+run|were\s+not\s+run|not\s+(?:run|evaluated|included)|"
    r"did\s+not\s+produce\s+(?:any\s+)?output|produced\s+no\s+output|failed\s+to\s+produce\s+(?:any\s+)?output|could\s+not\s+be\s+assessed|"
    r"is\s+not\s+evaluated|are\s+not\s+evaluated|was\s+excluded|were\s+excluded)\b"
)
METHOD_DENIAL = r"(?i)\b(?:(?:was|were)\s+excluded|not\s+included|could\s+not\s+be\s+included)\b"
TOOL_HEADER = r"(?i)^\s*(?:tool|method|caller|software|pipeline|package|program|algorithm|model|scorer|name)\s*$"
TABLE_TOKEN = r"^[A-Za-z][A-Za-z0-9_.\-]{1,24}$"
NO_TOKENS = ("true", "false", "nan", "inf")

REACH, PER_TOKEN, PER_CLAIM = 200, 2, 4


def context_stem(token: Column) -> Column:
    return (
        F.when((F.length(token) > 4) & token.endswith("ies"), F.concat(F.left(token, F.length(token) - 3), F.lit("y")))
        .when((F.length(token) > 4) & token.endswith("es") & ~token.rlike("(?:ses|ches|shes|xes)$"), F.left(token, F.length(token) - 2))
        .when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.left(token, F.length(token) - 1))
        .otherwise(token)
    )


def context_tokens(text: Column) -> Column:
    """The distinct nouns of a sentence, header or label, sorted: stems of three letters or more."""
    stems = F.transform(X.header_tokens(F.coalesce(text, F.lit(""))), context_stem)
    kept = F.filter(stems, lambda t: (F.length(t) >= 3) & ~t.isin(CONTEXT_STOPWORDS) & ~t.rlike(r"^\d+$"))
    return F.array_sort(F.array_distinct(kept))


def value_index(cells: DataFrame) -> DataFrame:
    """key, file, column, kind, label, at: where each number stands, as a cell or as the sum, min or max
    of a column with three numbers or more and no cell in percent or a currency. at orders the places:
    by file and column, cells by row first; equal cells of one label are one place, the first."""
    number = F.round(X.cell_number(F.col("cell")), 6)
    unit = F.col("cell").rlike(r"[%$€£]")
    rows = cells.select("file", "row", F.coalesce(F.trim("label"), F.lit("")).alias("label"), "column", "place", number.alias("key"), unit.alias("unit"))
    plain = rows.where(~F.coalesce("unit", F.lit(False)) & F.col("key").isNotNull())
    each = plain.groupBy("key", "file", "column", "place", "label").agg(F.min("row").alias("row")).select("key", "file", "column", "label", F.lit("cell").alias("kind"), F.struct("file", "place", F.lit(0).alias("rank"), F.col("row").cast("long").alias("row")).alias("at"))
    whole = rows.groupBy("file", "column", "place").agg(F.sum("key").alias("sum"), F.min("key").alias("min"), F.max("key").alias("max"), F.count("key").alias("n"), F.max(F.coalesce("unit", F.lit(False))).alias("unit"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.round(F.col(k), 6).alias("key"), F.lit(i).alias("rank")) for i, k in enumerate(("sum", "min", "max"), 1)))).alias("a")
    total = whole.where("n >= 3 AND NOT unit").select("file", "column", "place", kinds)
    total = total.select("a.key", "file", "column", F.lit("").alias("label"), "a.kind", F.struct("file", "place", F.col("a.rank").alias("rank"), F.lit(0).cast("long").alias("row")).alias("at"))
    return each.unionByName(total)


def best_labels(sentences: DataFrame, cells: DataFrame) -> DataFrame:
    """tokens, file, label: for each set of tokens the labels of a file that share most with it.

    A token that all labels of a file have tells none apart and is left out; sets that share nothing
    more with any label have no row."""
    labels = cells.select("file", F.trim("label").alias("label")).where(F.col("label") != "").distinct()
    sizes = labels.groupBy("file").agg(F.count("*").alias("n_labels"))
    terms = labels.select("file", "label", F.explode(context_tokens(F.col("label"))).alias("token"))
    common = terms.groupBy("file", "token").agg(F.count("*").alias("n")).join(sizes, "file").where("n < n_labels").select("file", "token")
    told = terms.join(common, ["file", "token"])
    each = sentences.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    shared = each.join(told, "token").groupBy("tokens", "file", "label").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy("tokens", "file"))
    return shared.withColumn("most", most).where("n = most").select("tokens", "file", "label")


def provenance(numbers: DataFrame, cells: DataFrame) -> DataFrame:
    """The first place in the tables that proves each number: numbers' id, number, with file, column,
    proof (cell, sum, min or max) and label; nulls where nothing does.

    numbers: id (unique), number, kind, sentence. Nothing proves a number in a line of UNPROVABLE_KINDS,
    one written as a citation or superscript, or one whose sentence has no noun in common with column
    and file. A cell also needs the row the sentence names best, if it names any. A sum, min or max
    doesn't prove a sentence that speaks of another statistic, and proves a bare number, one without
    a sentence. The numbers and the nouns of their sentences are settled once, as each step reads them.
    """
    index = value_index(cells)
    text = F.trim(F.coalesce("sentence", F.lit("")))
    number = F.trim(F.coalesce("number", F.lit("")))
    key = X.let(F.regexp_replace(F.regexp_replace(number, "[  \\u00a0\\s]", ""), r"\.$", ""), lambda n: F.round(X.cell_number(n), 6))
    marked = F.replace(text, number, F.lit("\u0001"))
    cited = marked.rlike(r"\^\s*\x01\s*\^|\[\s*\x01\s*[,\]]|[\[,]\s*\x01\s*\]")
    veto = text.rlike(rf"(?i)\b(?:{'|'.join(ESTIMATORS)})\b")
    provable = ~F.lower(F.trim(F.coalesce("kind", F.lit("")))).isin(*UNPROVABLE_KINDS)
    rows = settled(numbers.where(provable).select("id", key.alias("key"), (text == "").alias("bare"), cited.alias("cited"), veto.alias("veto"), context_tokens(text).alias("tokens")))
    rows = rows.where("key IS NOT NULL")
    told = rows.where("NOT bare AND NOT cited")

    columns = cells.select("file", "column").distinct()
    terms = columns.select("file", "column", F.explode(F.array_union(context_tokens(F.col("column")), context_tokens(F.col("file")))).alias("token"))
    spoken = told.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    near = spoken.join(terms, "token").select("tokens", "file", "column").distinct()  # the columns a set of nouns speaks of
    best = best_labels(rows, cells).withColumnRenamed("label", "best")
    named = best.select("tokens", "file").distinct().withColumn("named", F.lit(True))
    near = near.join(named, ["tokens", "file"], "left")

    said = told.select("id", "key", "tokens", "veto").join(near, "tokens")
    first = index.groupBy("key", "file", "column", "kind").agg(F.min(F.struct("at", "label")).alias("place"))
    found = said.join(first, ["key", "file", "column"])
    loose = found.where(F.when(F.col("kind") == "cell", F.col("named").isNull()).otherwise(~F.col("veto")))
    loose = loose.select("id", F.struct("place.at", "column", "kind", "place.label").alias("hit"))
    cell = index.where("kind = 'cell'").select("key", "file", "column", "label", "at")
    exact = said.where("named").join(best, ["tokens", "file"]).join(cell.withColumnRenamed("label", "best"), ["key", "file", "column", "best"])
    unnamed = said.where("named").join(cell.where("label = ''"), ["key", "file", "column"])  # a row without a name contradicts none
    hits = loose.unionByName(exact.select("id", F.struct("at", "column", F.lit("cell").alias("kind"), F.col("best").alias("label")).alias("hit")))
    hits = hits.unionByName(unnamed.select("id", F.struct("at", "column", F.lit("cell").alias("kind"), "label").alias("hit")))
    bare = rows.where("bare").select("id", "key").join(first.where("kind <> 'cell'"), "key").select("id", F.struct("place.at", "column", "kind", "place.label").alias("hit"))
    proved = hits.unionByName(bare).groupBy("id").agg(F.min("hit").alias("hit"))
    return numbers.select("id", "number").join(proved, "id", "left").select("id", "number", F.col("hit.at.file").alias("file"), F.col("hit.column").alias("column"), F.col("hit.kind").alias("proof"), F.col("hit.label").alias("label"))


def table_tokens(cells: DataFrame, most_values: int = 40, longest: int = 24) -> DataFrame:
    """token, tool_like, source, context: values of columns that name tools and of categorical columns.

    A column is categorical if it has most_values distinct values at most, some repeated, none longer
    than `longest`. context: the values of the file's other categorical columns, lower-cased, sorted.
    """
    rows = cells.select("file", "column", F.trim("cell").alias("value")).where("value <> ''")
    values = rows.groupBy("file", "column", "value").agg(F.count("*").alias("n"))
    shape = values.groupBy("file", "column").agg(F.count("*").alias("distinct"), F.sum("n").alias("rows"), F.max(F.length("value")).alias("longest"))
    shape = shape.select("file", "column", ((F.col("distinct") <= most_values) & (F.col("distinct") < F.col("rows")) & (F.col("longest") <= longest)).alias("categorical"))
    shape = shape.withColumn("tool_like", F.col("column").rlike(TOOL_HEADER)).where("categorical OR tool_like")
    held = values.join(shape, ["file", "column"])
    words = held.where("categorical").where(F.length("value") >= 2).groupBy("file", "column").agg(F.collect_set(F.lower("value")).alias("words"))
    others = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("column", "words"))).alias("by_column"))
    token = held.where(F.col("value").rlike(TABLE_TOKEN) & ~F.lower("value").isin(*NO_TOKENS)).join(others, "file", "left")
    rest = F.flatten(F.map_values(F.map_filter(F.coalesce("by_column", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))), lambda c, _: c != F.col("column"))))
    source = F.concat(F.lit("value '"), F.col("value"), F.lit("' of column '"), F.col("column"), F.lit("' in "), F.col("file"))
    return token.select(F.lower("value").alias("token"), "tool_like", source.alias("source"), F.array_sort(F.array_distinct(rest)).alias("context"))


def denials(texts: DataFrame) -> DataFrame:
    """doc_id, line, nth, claim, at, method_only: each denial with REACH characters either side, and
    where in this excerpt (from 0) it starts. White space runs count as one space."""
    text = F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"\s+", " "))
    rows = texts.select("doc_id", "line", text.alias("s")).where(F.col("s").rlike(DENIAL))
    rows = rows.select("doc_id", "line", "s", F.posexplode(X.match_spans(F.col("s"), DENIAL)).alias("nth", "d"))
    start = F.col("d.start")
    lo = F.greatest(start - REACH, F.lit(0))
    excerpt = F.substring(F.col("s"), lo + 1, start + F.length("d.text") + REACH - lo)
    return rows.select("doc_id", "line", "nth", excerpt.alias("claim"), (start - lo).alias("at"), F.col("d.text").rlike(METHOD_DENIAL).alias("method_only"))


def first_copies(claims: DataFrame) -> DataFrame:
    """The first of a document's equal claims: the later ones have the same sources and give none again.

    line and nth are packed into one decimal, so the least is kept in a hash table and no task sorts its claims.
    """
    per_line = F.lit(1 << 31).cast("decimal(10,0)")
    kind = claims.schema["line"].dataType
    least = F.min(F.col("line").cast("decimal(20,0)") * per_line + F.col("nth").cast("decimal(10,0)")).alias("first")
    kept = claims.groupBy("doc_id", "claim", "at", "method_only").agg(least).withColumn("nth", F.pmod("first", per_line).cast("int"))
    line = F.expr("(first - CAST(nth AS DECIMAL(10, 0))) div 2147483648BD").cast(kind)
    return kept.select("doc_id", line.alias("line"), "nth", "claim", "at", "method_only")


def negative_claims(texts: DataFrame, cells: DataFrame, per_token: int = PER_TOKEN, per_claim: int = PER_CLAIM) -> DataFrame:
    """doc_id, line, nth, token, source, place: denials of what a table holds.

    A token must stand before the denial; denials that may speak of samples need a tool's token. A claim
    gives its sources in order: those whose context it names first, then tools, then by token and source;
    `per_token` of one token and `per_claim` in all at most. A claim that repeats a document's earlier
    one in its first 80 characters doesn't give the same token and source again.
    """
    claims, tokens = first_copies(denials(texts)), table_tokens(cells)
    names = tokens.select("token").unionByName(tokens.select(F.explode("context").alias("token"))).distinct()
    sought = claims.select(F.struct("doc_id", "line").alias("doc_id"), F.col("nth").alias("line"), F.col("claim").alias("raw"))
    hits = dictionary_hits(sought, names.select(F.lit("").alias("family"), F.col("token").alias("variant")))
    hits = hits.groupBy("doc_id.doc_id", "doc_id.line", F.col("line").alias("nth"), F.col("variant").alias("token")).agg(F.min("start").alias("start"))
    present = hits.groupBy("doc_id", "line", "nth").agg(F.collect_set("token").alias("present"), F.collect_list(F.struct("token", "start")).alias("found"))
    rows = claims.join(present, ["doc_id", "line", "nth"]).select("*", F.explode("found").alias("f")).where(F.col("f.start") - 1 < F.col("at"))
    rows = rows.select("doc_id", "line", "nth", "claim", "method_only", "present", F.col("f.token").alias("token")).join(tokens, "token").where("tool_like OR NOT method_only")
    rows = rows.withColumn("off_context", (~F.arrays_overlap("context", "present")).cast("int")).withColumn("no_tool", (~F.col("tool_like")).cast("int"))
    rows = rows.select("doc_id", "line", "nth", "token", "source", "off_context", "no_tool", F.left("claim", F.lit(80)).alias("head"))
    again = Window.partitionBy("doc_id", "token", "source", "head").orderBy("line", "nth")
    rows = rows.withColumn("copy", F.row_number().over(again)).where("copy = 1")
    order = [F.col(c) for c in ("off_context", "no_tool", "token", "source")]
    claim = ["doc_id", "line", "nth"]
    rows = rows.withColumn("of_token", F.row_number().over(Window.partitionBy(*claim, "token").orderBy(*order))).where(F.col("of_token") <= per_token)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*claim).orderBy(*order))).where(F.col("place") <= per_claim)
    return rows.select(*claim, "token", "source", "place")
