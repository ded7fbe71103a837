"""Personal data by patterns of its own and by bootstrapped contexts, in DataFrame operations only.

Base spans are the matches of four fixed patterns. They seed a bootstrap: the word before a span is
its lexical pattern. A pattern's confidence for a kind is the summed score of the known instances
after it over all words that follow it anywhere; patterns with enough distinct instances and
confidence score the instances they introduce, which then count for other patterns, until no pattern
is new and no confidence grows. Words of a kind's rough shape after a confident pattern become additional spans.

The patterns below are written so that Java's matcher never backtracks over a run or recurses on a
group: runs and groups are possessive, and a match starts where a run starts or the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A part of the text without which a kind can't occur.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words that may be an identifier: whole words with a digit or an @ in them.
LOOSE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SHAPES = {
    "email": r"^[^@]+(?:@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[^0-9]*[0-9]{1,3}(?:[.,][0-9]{1,3}){3}[^0-9]*$",
    "card": r"^[^0-9]*(?:[0-9][-.]?){13,18}[0-9][^0-9]*$",
    "phone": r"^[^0-9]*(?:[0-9][-./()]?){7,14}[0-9][^0-9]*$",
}
SPAN = "array<struct<start:int,end:int,value:string,left:string>>"
SUPPORT, CONFIDENCE = 5, 0.8
#: Confidences are at rest when all of them together grow by less in a round.
REST = 1e-6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
    "card": _valid_card,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def spans_of(text: Column, pattern: str, valid: Callable[[Column], Column], needs: str | None = None) -> Column:
    """Valid matches of a pattern with code-point positions and the word before each.

    The pieces between matches give the positions: a match starts after all pieces and matches so far.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        left = F.lower(F.regexp_extract(F.right(x["gap"], F.lit(120)), r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*$", 1))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), left.alias("left"))).cast(SPAN)
        good = F.coalesce(x["hit"].isNotNull() & valid(x["hit"]), F.lit(False))
        return F.struct(end.alias("pos"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    may = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    return F.when(may & text.rlike(pattern), found).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    order = F.array_sort(spans)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and per kind an array of valid base spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", *(spans_of(F.col("text"), PATTERNS[k], VALID[k], NEEDS[k]).alias(k) for k in KINDS))


def discovered(rows: DataFrame) -> DataFrame | None:
    """(id, mark, start, kind, end) of spans that confident contexts add, or None where none does.

    rows: base_spans() with `mark`, a hash of the text that tells rows of one id apart.
    """
    tagged = [F.transform(F.col(k), lambda s, i=i: F.struct(F.lit(i).alias("kind"), s["value"].alias("value"), s["left"].alias("left"))) for i, k in enumerate(KINDS)]
    spans = rows.select(F.explode(F.concat(*tagged)).alias("s")).select("s.*").where("left <> ''")
    seeds = materialize(spans.groupBy("kind", "left", "value").agg(F.count("*").alias("n")))
    if seeds.groupBy("kind", "left").count().where(F.col("count") >= SUPPORT).isEmpty():
        return None
    loose = spans_of(F.col("text"), LOOSE, lambda v: F.lit(True))
    taken = F.concat(*(F.col(k) for k in KINDS))
    free = F.filter(loose, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    others = rows.select("id", "mark", F.explode(free).alias("s")).select("id", "mark", "s.*")
    kinds = F.filter(F.array(*(F.when(F.col("value").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS))), lambda x: x.isNotNull())
    others = materialize(others.select("*", F.explode(kinds).alias("kind")))
    candidates = others.where("left <> ''").groupBy("kind", "left", "value").agg(F.count("*").alias("n"))
    counted = seeds.select("*", F.lit(True).alias("base")).unionByName(candidates.select("*", F.lit(False).alias("base")))
    # Contexts that could reach SUPPORT if all their candidates became known: no round can admit another.
    wide = materialize(counted.groupBy("kind", "left").agg(F.count_distinct("value").alias("most")).where(F.col("most") >= SUPPORT).drop("most"))
    words = rows.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("left")).where("left <> ''")
    totals = words.join(wide.select("left").distinct(), "left").groupBy("left").agg(F.count("*").alias("total"))
    counted = materialize(counted.join(wide, ["kind", "left"]).join(totals, "left"))
    base, open_ = counted.where("base").withColumn("score", F.lit(1.0)).drop("base"), counted.where("NOT base").drop("base")

    def confident(known: DataFrame) -> DataFrame:
        scored = known.groupBy("kind", "left").agg(F.sum(F.col("score") * F.col("n")).alias("mass"), F.count_distinct("value").alias("support"), F.max("total").alias("total"))
        share = F.least(F.lit(1.0), F.col("mass") / F.col("total"))
        return scored.where(F.col("support") >= SUPPORT).select("kind", "left", share.alias("confidence")).where(F.col("confidence") >= CONFIDENCE)

    # Scores and patterns only grow, so the rounds come to rest; a pattern may become confident after
    # a round in which no pattern was new, so confidences must rest as well.
    patterns, last = materialize(confident(base)), (0, 0.0)
    while True:
        count, total = patterns.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if not count:
            return None
        if count == last[0] and total - last[1] < REST:
            break
        last = count, total
        values = open_.join(patterns, ["kind", "left"]).groupBy("kind", "value").agg(F.max("confidence").alias("score"))
        known = base.unionByName(open_.join(values, ["kind", "value"]).select(*base.columns))
        now = materialize(confident(known))
        release(patterns)
        patterns = now
    hits = others.join(patterns, ["kind", "left"]).select("id", "mark", "start", "kind", "end").distinct()
    return materialize(hits)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and the digest are of base spans; `spans` lists base and added ones as kind:start:end in
    code points, end exclusive. Null text counts as empty and has no spans. Rows come out one for
    one; repeated rows have equal results. Other columns are ignored.
    """
    rows = base_spans(docs, id_col, text_col)
    added = discovered(rows.withColumn("mark", F.xxhash64("text")))
    base = F.concat(*(_tagged(F.col(k), i) for i, k in enumerate(KINDS)))
    out = rows.select("id", F.xxhash64("text").alias("mark"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"))
    if added is None:
        out = out.withColumn("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    else:
        lists = added.groupBy(F.col("id").alias("a_id"), F.col("mark").alias("a_mark")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
        lists = materialize(lists)
        out = out.join(lists, out["id"].eqNullSafe(lists["a_id"]) & (out["mark"] == lists["a_mark"]), "left")
        out = out.withColumn("more", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return out.select(
        F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"),
    )
