"""Many fixed phrases sought in one scan: an Aho-Corasick automaton over all of them, and what is read
off its hits. Lines have doc_id, line and raw, as from `text.lines_of`.

A dictionary is sent to the workers in parts of bounded size (PART_BYTES of text), each in a scan of
its own, so it may be of any size; most have one part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions.scalars import let

#: An automaton takes some 50 bytes a character.
PART_BYTES = 1 << 21

#: Dashes that may stand for a space, words a long form doesn't start with.
DASHES = "-‐‑‒–—"
FILLERS = (
    "we the our in and using used with a an this that of from by for all were was is are performed then also here assessed measured "
    "analyzed analysed evaluated scored called denoted denotes hereafter abbreviated namely termed"
).split()
GENERIC_HEADS = (
    "number numbers reference value values total count counts level levels set sets list lists file files table tables figure figures "
    "page pages line lines row rows data dataset datasets sample samples cell cells type types group groups result results method methods "
    "case cases part parts end ends use uses name names"
).split()

_GAP = re.compile(rf"[\s{re.escape(DASHES)}]+")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def folded(text: str) -> str:
    """Lower case, one character for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def loosened(text: str) -> tuple[str, list[int]]:
    """Text with each run of spaces and dashes as one space, and where each character came from."""
    out, at, last = [], [], 0
    for m in _GAP.finditer(text):
        out += [text[last : m.start()], " "]
        at += [*range(last, m.start()), m.start()]
        last = m.end()
    return "".join([*out, text[last:]]), [*at, *range(last, len(text))]


def _hits(terms, loose: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        groups: dict[str, list[int]] = {}
        for i, (_, variant) in enumerate(terms.value):
            key = folded(variant.strip())
            key = loosened(key)[0].strip() if loose else key
            if key:
                groups.setdefault(key, []).append(i)
        automaton = ahocorasick.Automaton()
        for key, members in groups.items():
            automaton.add_word(key, (len(key), members))
        if groups:
            automaton.make_automaton()
        for batch in batches:
            row, start, length, term = [], [], [], []
            for n, raw in enumerate(batch.column("raw").to_pylist() if groups else ()):
                text, at = folded(raw or ""), None
                if loose:
                    text, at = loosened(text)
                done: dict[int, int] = {}
                for last, (size, members) in automaton.iter(text):
                    lo, hi = last + 1 - size, last + 1
                    if loose:  # a plural belongs to the hit
                        hi += 2 if text[hi : hi + 2] == "es" and text[hi + 2 : hi + 3] not in _ALNUM else text[hi : hi + 1] == "s" and text[hi + 1 : hi + 2] not in _ALNUM
                    if (lo and text[lo - 1] in _ALNUM) or (hi < len(text) and text[hi] in _ALNUM) or lo < done.get(members[0], 0):
                        continue
                    done[members[0]] = hi  # hits of one phrase don't overlap
                    begin, end = (lo, hi) if at is None else (at[lo], at[hi - 1] + 1)
                    for i in members:
                        row.append(n), start.append(begin + 1), length.append(end - begin), term.append(i)
            names = [*batch.schema.names[:-1], "start", "length", "family", "variant", "raw"]
            taken = [c.take(pa.array(row, pa.int64())) for c in batch.columns]
            pick = [pa.array([terms.value[i][j] for i in term], pa.string()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken[:-1], pa.array(start, pa.int32()), pa.array(length, pa.int32()), *pick, taken[-1]], names)

    return run


def dictionary_hits(lines: DataFrame, terms: DataFrame, loose: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, line, start (from 1), length, family, variant, raw: all hits of the variants in terms.

    Case makes no difference, and neither a letter of A-Z nor a digit may touch a hit. Hits of one
    variant don't overlap; those of different ones may. With `loose` any run of spaces and dashes
    stands for another and a hit takes a plural s or es along. Null and blank variants are left out,
    equal rows of terms count once; null lines have no hits. Other columns of terms are ignored.
    """
    spark = lines.sparkSession
    rows = lines.select("doc_id", "line", "raw")
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in ("doc_id", "line")]
    schema = ", ".join(f"{c} {t}" for c, t in kinds) + ", start int, length int, family string, variant string, raw string"
    known = terms.select(F.col("family").cast("string").alias("family"), F.col("variant").cast("string").alias("variant")).where(F.trim("variant") != "").distinct()
    octets = known.agg(F.coalesce(F.sum(F.octet_length("variant") + F.coalesce(F.octet_length("family"), F.lit(0))), F.lit(0))).first()[0]
    parts, out = max(1, -(-octets // part_bytes)), None
    for p in range(parts):
        some = known.where(F.pmod(F.xxhash64("variant"), F.lit(parts)) == p).orderBy("family", "variant").collect()
        hits = rows.mapInArrow(_hits(spark.sparkContext.broadcast([tuple(r) for r in some]), loose), schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def _held(phrases, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        keys: dict[str, list[int]] = {}
        for i, (_, phrase) in enumerate(phrases.value):
            keys.setdefault(phrase, []).append(i)
        empty = keys.pop("", [])
        automaton = ahocorasick.Automaton()
        for phrase, members in keys.items():
            automaton.add_word(phrase, members)
        if keys:
            automaton.make_automaton()
        for batch in batches:
            row, found = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                if text is not None:
                    some = {i for _, members in automaton.iter(text) for i in members} if keys else set()
                    for i in sorted(some.union(empty)):
                        row.append(n), found.append(phrases.value[i][0])
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], ["doc_id", "key"])

    return run


def phrases_in(texts: DataFrame, phrases: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, key: which texts (doc_id, text) hold which phrases (key, phrase), character by character.

    A text gives one row for each row of phrases that it holds. The empty phrase is in every text that is
    not null; null phrases and null texts give no rows.
    """
    spark = texts.sparkSession
    rows, known = texts.select("doc_id", "text"), phrases.select("key", "phrase").where(F.col("phrase").isNotNull())
    kind = known.limit(0).toArrow().schema.field("key").type
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key {known.schema['key'].dataType.simpleString()}"
    parts, out = max(1, -(-(known.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]) // part_bytes)), None
    for p in range(parts):
        some = known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == p).orderBy("key", "phrase").collect()
        if some:
            hits = rows.mapInArrow(_held(spark.sparkContext.broadcast([tuple(r) for r in some]), kind), schema)
            out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], schema)


def longest_hits(hits: DataFrame) -> DataFrame:
    """Hits that don't overlap: from the left, of those that start at one place the longest, and what
    starts inside one that is taken goes. Of equal spans the least variant stays."""
    one = F.struct("start", (-F.col("length")).alias("less"), "variant", "family", "raw")
    groups = hits.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(one)).alias("hits"))
    empty = F.struct(F.lit(0).alias("stop"), F.filter("hits", lambda h: F.lit(False)).alias("taken"))

    def step(held: Column, h: Column) -> Column:
        more = F.struct((h["start"] - h["less"]).alias("stop"), F.concat(held["taken"], F.array(h)).alias("taken"))
        return F.when(h["start"] >= held["stop"], more).otherwise(held)

    kept = groups.select("doc_id", "line", F.explode(F.aggregate("hits", empty, step)["taken"]).alias("h"))
    return kept.select("doc_id", "line", "h.start", (-F.col("h.less")).alias("length"), "h.family", "h.variant", "h.raw")


def family_rows(lines: DataFrame, families: DataFrame) -> DataFrame:
    """One row for each occurrence of each listed variant of a family: family, variant (as written),
    pattern (as listed), doc_id, line, start, excerpt."""
    hits = dictionary_hits(lines, families)
    written = F.substring(F.col("raw"), F.col("start"), F.col("length"))
    return hits.select("family", written.alias("variant"), F.col("variant").alias("pattern"), "doc_id", "line", "start", F.left(F.trim("raw"), F.lit(140)).alias("excerpt"))


def long_form_candidates(phrase: Column) -> Column:
    """The tails of a phrase that can be an acronym's long form, as arrays of words, longest first.

    A tail has two words or more or is one compound with a hyphen, starts neither with a filler nor
    with a generic noun, and holds no markup; of tails equal but for case the first stays.
    """
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace(phrase, r"\s+", " ")), " "), lambda w: F.btrim(w, F.lit(",;:.()[]"))), lambda w: w != "")
    def fits(t: Column) -> Column:
        head = F.lower(F.get(t, F.lit(0)))
        markup = F.exists(t, lambda w: w.rlike(r"[\\{}(]"))
        return ~head.isin(FILLERS) & ((F.size(t) >= 2) | head.contains("-")) & ~F.rtrim(head, F.lit(",;:")).isin(GENERIC_HEADS) & ~markup

    tails = let(words, lambda held: F.transform(held, lambda w, i: F.slice(held, i + 1, F.size(held) - i)))

    def first(kept: Column) -> Column:
        return let(F.transform(kept, lambda t: F.lower(F.array_join(t, " "))), lambda low: F.filter(kept, lambda t, i: F.array_position(low, F.get(low, i)) == i + 1))

    return let(F.filter(tails, fits), first)


#: A quotation on one line.
QUOTED = r"[“\"][^”\"]{0,300}[”\"]"


def long_form_residues(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, section, token, line, start, written: long forms used after a section's first use of one.

    lines: doc_id, section, line, raw; forms: token, variant. Of overlapping hits the longest counts.
    Hits in quotations count for nothing. A hit right before the token in brackets is a definition: it
    can be the first use, but never a residue; right before another listed token it is that one's
    definition and counts for nothing.
    """
    section = lines.select(F.col("doc_id").alias("d"), F.col("line").alias("l"), "section")
    hits = dictionary_hits(lines, forms.select(F.col("token").alias("family"), "variant"), loose=True)
    split = hits.select(F.struct("doc_id", "family").alias("doc_id"), *(c for c in hits.columns if c != "doc_id"))
    hits = longest_hits(split).select("doc_id.doc_id", *(c for c in hits.columns if c != "doc_id"))  # of each token's own hits
    before = F.substring(F.col("raw"), F.lit(1), F.col("start") - 1)
    blank = F.regexp_replace("raw", QUOTED, "")
    quoted = F.length("raw") > F.length(blank)
    inside = F.size(F.split(F.regexp_replace(before, QUOTED, ""), r"[“\"]")) > 1
    closes = F.substring(F.col("raw"), F.col("start") + F.col("length"), F.lit(301)).rlike(r"^[^”\"]*[”\"]")
    follows = F.regexp_extract(F.substring(F.col("raw"), F.col("start") + F.col("length"), F.length("raw")), r"^\s*\(\s*([A-Za-z0-9-]+)\s*[),;]", 1)
    tokens = forms.select(F.lower("token").alias("defined")).distinct()
    rows = hits.where(~(quoted & inside & closes)).withColumn("defined", F.lower(follows))
    own = F.col("defined") == F.lower("family")
    known = rows.join(tokens.withColumn("is_token", F.lit(True)), "defined", "left").where(own | F.col("is_token").isNull())
    known = known.join(section, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l")))
    order = Window.partitionBy("doc_id", "section", "family").orderBy("line", "start")
    known = known.withColumn("use", F.row_number().over(order)).where((F.col("use") > 1) & ~own)
    return known.select("doc_id", "section", F.col("family").alias("token"), "line", "start", F.substring(F.col("raw"), F.col("start"), F.col("length")).alias("written"))
