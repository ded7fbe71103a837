"""Arguments that a text leaves open, one row a finding. Lines are paragraphs: doc_id, line, raw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.prose import sentence_rows
from inkmill.operators.rounds import settled

#: Shapes of a sentence and the rule each belongs to, in the order of the report.
SHAPES = (
    ("T9L", r"(?i)\btests?\s+whether\b[^.]{0,160}\bbecause\b"),
    ("T9L", r"(?i)\binvert(?:ing|s|ed)?\s+the\s+downsampling\b"),
    ("T9L", r"(?i)\bwill\s+be\s+flagged\s+as\b"),
    ("T9L", r"(?i)\bwhich\s+it\s+needs\b"),
    ("T9L", r"(?i)\baccompanied\s+chiefly\s+by\b|\bchiefly\s+accompanied\s+by\b"),
    ("T9U", r"(?i)\bapproximately\s+any\b"),
    ("T9U", r"(?i)\bmetric-dependent\b"),
    ("T9U", r"(?i)\bpurity\s+floor\b"),
)
#: Shapes of a paragraph.
LIMITATIONS = r"(?is)\bthis\s+study\s+has\s+the\s+following\s+limitations\b.{0,80}\bfirst\b"
EXPECTATION = r"(?is)\b(?:we\s+)?(?:therefore\s+)?expected?\b.{0,260}\bwhich\s+implies\b"
THEREFORE = r"(?i)^\s*we\s+therefore\b"
CAUSAL = r"(?i)\b(?:because|since|thus|hence|so|as\s+a\s+result|therefore|accordingly)\b"
NEGATION = r"(?i)\b(?:not|no|none|never|without|neither|nor|cannot)\b|n['’]t\b"
SHORT = 10


def affirmed(text: Column, pattern: str) -> Column:
    """Whether the first match of a pattern has no negation before it in its clause."""
    before = F.get(F.split(text, pattern, 2), F.lit(0))
    return F.coalesce(text.rlike(pattern) & ~F.element_at(F.split(before, "[.;:!?]", -1), -1).rlike(NEGATION), F.lit(False))


def word_runs(text: Column) -> Column:
    """Runs of letters, digits, _ and -, lower-cased, and each other sign by itself, in their order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9_-]+|[^A-Za-z0-9_\s-]"), F.lit(0))


def described_above(lines: DataFrame, masked: Column | None = None) -> DataFrame:
    """doc_id, line, nth, term: mentions `the X described above` with no X before them in their document.

    nth is the place of X among the line's words and signs. X counts as used where it stands as a word
    or as whole parts of a word with hyphens. Masked lines hold no mention, but their words count. Mentions
    are few and settled once; a word crosses the network only if it may be a term of its document.
    """
    rows = lines.select("doc_id", "line", "raw", (F.coalesce(masked, F.lit(False)) if masked is not None else F.lit(False)).alias("masked"))
    hint = rows.where(~F.col("masked") & F.col("raw").rlike(r"(?i)\bthe\s+[a-z][a-z-]{3,}\s+described\s+above\b"))
    words = hint.select("doc_id", "line", word_runs(F.col("raw")).alias("w"))
    place = F.filter(F.sequence(F.lit(2), F.size("w") - 2), lambda i: (
        F.element_at("w", i - 1).rlike("(?:^|-)the$") & F.element_at("w", i).rlike("^[a-z][a-z-]{3,}$") & (F.element_at("w", i + 1) == "described") & F.element_at("w", i + 2).rlike("^above(?:-|$)")
    ))
    said = words.where(F.size("w") >= 4).select("doc_id", "line", "w", F.explode(place).alias("nth")).select("doc_id", "line", "nth", F.element_at("w", F.col("nth")).alias("term"))
    said = settled(said)
    docs = said.select("doc_id", "term").distinct()
    sought = docs.groupBy("doc_id").agg(F.bit_or(term_bit("term")).alias("sought"))
    every = rows.join(sought, "doc_id").select("doc_id", "line", "sought", F.posexplode(word_runs(F.col("raw"))).alias("at", "word"))
    return late_mentions(said, docs, terms_sought(every))


def term_bit(term: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({term}), 64) AS INT))")


def terms_sought(words: DataFrame) -> DataFrame:
    """doc_id, line, at, term: words, and whole parts of words with hyphens, whose bit is among those sought
    in their document. A term has four letters at least."""
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.transform(F.sequence(F.lit(1), F.size("p") - i + 1), lambda n: F.array_join(F.slice(F.col("p"), i, n), "-"))))
    long_ = words.where(F.length("word") >= 4).withColumn("p", F.split("word", "-", -1))
    each = F.when(F.contains("word", F.lit("-")), F.array_distinct(spans)).otherwise(F.array("word"))
    return long_.select("doc_id", "line", "at", "sought", F.explode(each).alias("term")).where(F.col("sought").bitwiseAND(term_bit("term")) != 0).drop("sought")


def late_mentions(said: DataFrame, docs: DataFrame, every: DataFrame) -> DataFrame:
    """The mentions that no use of their term precedes."""
    first = every.join(docs, ["doc_id", "term"], "left_semi").groupBy("doc_id", "term").agg(F.min(F.struct("line", (F.col("at") + 1).alias("nth"))).alias("first"))
    late = said.join(first, ["doc_id", "term"], "left").where(F.col("first").isNull() | (F.struct("line", "nth") <= F.col("first")))
    return late.select("doc_id", "line", "nth", "term")


def logic_rows(lines: DataFrame, masked: Column | None = None) -> DataFrame:
    """doc_id, line, rule, place, evidence: the shapes of SHAPES (place 1 to 8, each once a paragraph, with
    its first sentence), expectations offered as evidence (9), counted limitations (10), `We therefore`
    after a short paragraph without a cause (11), and `the X described above` without an X (12).

    A shape that is denied doesn't count. Masked paragraphs are left out, but stay in front of the
    next ones. Null paragraphs count as empty.
    """
    rows = lines.select("doc_id", "line", F.coalesce("raw", F.lit("")).alias("raw"), (F.coalesce(masked, F.lit(False)) if masked is not None else F.lit(False)).alias("masked"))
    before = F.lag("raw").over(Window.partitionBy("doc_id").orderBy("line"))
    open_ = rows.withColumn("before", before).where(~F.col("masked"))
    finding = lambda when, rule, place, evidence: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(place).alias("place"), evidence.alias("evidence")))

    sentences = sentence_rows(open_)
    text = F.trim("sentence")
    hits = F.array_compact(F.array(*(finding(affirmed(text, p), rule, i, F.left(text, F.lit(220))) for i, (rule, p) in enumerate(SHAPES, 1))))
    shapes = sentences.select("doc_id", "line", "nth", F.explode(hits).alias("f")).groupBy("doc_id", "line", F.col("f.rule").alias("rule"), F.col("f.place").alias("place"))
    shapes = shapes.agg(F.min_by("f.evidence", "nth").alias("evidence")).select("doc_id", "line", "rule", "place", "evidence")

    raw, start = F.col("raw"), F.left(F.trim("raw"), F.lit(220))
    words = F.size(F.filter(F.split("before", r"\s+"), lambda w: w != ""))
    unfounded = raw.rlike(THEREFORE) & F.col("before").isNotNull() & (words <= SHORT) & ~F.col("before").rlike(CAUSAL)
    whole = F.array_compact(F.array(finding(affirmed(raw, EXPECTATION), "T9L", 9, start), finding(raw.rlike(LIMITATIONS), "T9L", 10, start), finding(unfounded, "T9L", 11, start)))
    whole = open_.select("doc_id", "line", F.explode(whole).alias("f")).select("doc_id", "line", "f.rule", "f.place", "f.evidence")

    above = described_above(rows, F.col("masked")).select("doc_id", "line", F.lit("T9A").alias("rule"), F.lit(12).alias("place"), F.col("term").alias("evidence"))
    return shapes.unionByName(whole).unionByName(above)
