"""Names for rows that may not keep their own: the first free numbers, and unique names of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reserved blocks of ids, the pattern of an id that may stay.
BLOCKS = ((901, 999), (9001, 9999))
RESERVED_ID = r"^X-(?:9\d{2}|9\d{3})$"
#: The longest name of a sheet, the characters it may not hold.
SHEET_LENGTH = 31
SHEET_FORBIDDEN = r"[\[\]:*?/\\]"


def free_ranges(used: DataFrame, blocks: tuple[tuple[int, int], ...], group: str) -> DataFrame:
    """group, first, last, before: the runs of unused numbers in each group's blocks, in rising order,
    and how many free numbers come before each. used: group, number; a group without used numbers has
    none here."""
    ends = F.array(*(F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for a, b in blocks))
    block = used.select(group).distinct().select(group, F.explode(ends).alias("b"))
    inside = used.join(block, group).where("number BETWEEN b.first AND b.last").select(group, "b", F.col("number").alias("n")).distinct()
    edges = block.select(group, "b", F.explode(F.array(F.col("b.first") - 1, F.col("b.last") + 1)).alias("n")).unionByName(inside)
    nexts = edges.withColumn("next", F.lead("n").over(Window.partitionBy(group, "b").orderBy("n"))).where("next > n + 1")
    runs = nexts.select(group, (F.col("n") + 1).alias("first"), (F.col("next") - 1).alias("last"))
    so_far = F.sum(F.col("last") - F.col("first") + 1).over(Window.partitionBy(group).orderBy("first"))
    return runs.withColumn("before", so_far - (F.col("last") - F.col("first") + 1))


def remapped_ids(rows: DataFrame, existing: DataFrame, blocks: tuple[tuple[int, int], ...] = BLOCKS, reserved: str = RESERVED_ID, prefix: str = "X-") -> DataFrame:
    """grp, ord, id, new_id: rows that keep their id, and others moved to the first free numbers.

    rows: grp, ord (unique in grp), id; existing: grp, id. In the order of ord, a row keeps an id that
    fits `reserved` and that neither `existing` nor a row before it has; any other row takes the least
    number of the blocks that is free by then, which a later row's own id does not reserve. A null
    new_id: the blocks are full. Null and blank ids never stay.

    Moved rows take ever higher numbers, so a row can keep number k unless more rows have moved before
    it than free numbers lie below k. Only rows that might keep their id, no more than there are
    reserved ids, are gone through one after the other; moved rows meet the free ranges by rank.
    """
    own = F.trim(F.coalesce("id", F.lit("")))
    rows = rows.select("grp", "ord", "id", own.alias("own"))
    rows = rows.withColumn("earlier", F.row_number().over(Window.partitionBy("grp").orderBy("ord")) - 1)
    number = F.regexp_extract("own", r"(\d+)$", 1).try_cast("long")
    held = existing.select("grp", F.trim(F.coalesce("id", F.lit(""))).alias("own")).where("own <> ''").distinct()
    none = rows.select("grp").distinct().withColumn("number", F.lit(-1).cast("long"))  # so that each group has ranges
    used = held.where(F.col("own").rlike(rf"^{prefix}\d+$")).select("grp", number.alias("number")).unionByName(none)
    ranges = free_ranges(used, blocks, "grp")

    first = rows.where(F.col("own").rlike(reserved)).groupBy("grp", "own").agg(F.min(F.struct("earlier", "ord")).alias("f"))
    may = first.join(held, ["grp", "own"], "left_anti").select("grp", F.col("f.earlier").alias("earlier"), F.col("f.ord").alias("ord"), number.alias("number"))
    among = may.join(ranges, "grp").where("number BETWEEN first AND last").select("grp", "ord", (F.col("before") + F.col("number") - F.col("first")).alias("below"))
    may = may.join(among, ["grp", "ord"], "left").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("earlier", "number", "below", "ord"))).alias("may"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("kept"), F.transform(F.filter("may", lambda x: F.lit(False)), lambda x: x["ord"]).alias("ords"))

    def keep(s: Column, x: Column) -> Column:
        free = F.size(F.filter(s["kept"], lambda k: k < x["number"]))
        fits = x["below"].isNull() | (x["earlier"] - s["n"] <= x["below"] - free)
        more = F.when(x["below"].isNull(), s["kept"]).otherwise(F.concat(s["kept"], F.array(x["number"])))
        return F.when(fits, F.struct((s["n"] + 1).alias("n"), more.alias("kept"), F.concat(s["ords"], F.array(x["ord"])).alias("ords"))).otherwise(s)

    stays = may.select("grp", F.explode(F.aggregate("may", start, keep)["ords"]).alias("ord")).withColumn("stays", F.lit(True))
    rows = rows.join(stays, ["grp", "ord"], "left")
    again = rows.where("stays").select("grp", number.alias("number")).unionByName(used)
    moved = rows.where("stays IS NULL").select("grp", "ord").withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("ord")))
    slot = moved.join(free_ranges(again, blocks, "grp"), "grp").where("rank > before AND rank <= before + last - first + 1")
    slot = slot.select("grp", "ord", (F.col("first") + F.col("rank") - F.col("before") - 1).alias("slot"))
    out = rows.join(slot, ["grp", "ord"], "left")
    return out.select("grp", "ord", "id", F.when(F.col("stays"), F.col("own")).when(F.col("slot").isNotNull(), F.concat(F.lit(prefix), F.format_string("%03d", "slot"))).alias("new_id"))


def sheet_tabs(runs: DataFrame) -> DataFrame:
    """book, ord, stem, round, tab: names of sheets, unique in a book without regard to case.

    runs: book, ord (unique in book), stem, round. A name is the stem and `_rN`, `_all` or the round's
    own text, without forbidden characters, in SHEET_LENGTH characters; a taken one gets `~2`, `~3`, ...
    between stem and round, in the order of ord. A book's names are gone through in one row.
    """
    clean = F.trim(F.regexp_replace(F.coalesce("stem", F.lit("")), SHEET_FORBIDDEN, "_"))
    digits = F.col("round").rlike(r"^[0-9]+$")
    suffix = F.when(digits, F.concat(F.lit("_r"), F.coalesce(F.nullif(F.ltrim(F.col("round"), F.lit("0")), F.lit("")), F.lit("0")))).otherwise(
        F.concat(F.lit("_"), F.regexp_replace(F.coalesce("round", F.lit("")), SHEET_FORBIDDEN, "_"))
    )
    rows = runs.select("book", "ord", "stem", "round", F.when(clean == "", "run").otherwise(clean).alias("base"), F.left(suffix, F.lit(SHEET_LENGTH)).alias("suffix"))
    books = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", "stem", "round", "base", "suffix"))).alias("runs"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("tabs"))

    def name(x: Column, i: Column) -> Column:
        tag = F.when(i > 1, F.concat(F.lit("~"), i.cast("string"))).otherwise("")
        room = F.lit(SHEET_LENGTH) - F.length(x["suffix"]) - F.length(tag)
        return F.left(F.concat(F.left(x["base"], F.when(i > 1, F.greatest(room, F.lit(1))).otherwise(room)), tag, x["suffix"]), F.lit(SHEET_LENGTH))

    def step(s: Column, x: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(s["used"]) + 1), lambda i: name(x, i))
        tab = F.get(F.filter(tries, lambda t: ~F.array_contains(s["used"], F.lower(t))), F.lit(0))
        return F.struct(F.concat(s["used"], F.array(F.lower(tab))).alias("used"), F.concat(s["tabs"], F.array(tab)).alias("tabs"))

    tabs = F.aggregate("runs", start, step)["tabs"]
    each = books.withColumn("tabs", tabs).select("book", F.explode(F.arrays_zip("runs", "tabs")).alias("x"))
    return each.select("book", "x.runs.ord", "x.runs.stem", "x.runs.round", F.col("x.tabs").alias("tab"))
