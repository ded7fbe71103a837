"""Phrases that hold together, by counting all phrases with Suffix-sigma.

Every position of a text starts a suffix, cut after max_n words, at the end of its piece, and before
a word that occurs less than `least` times in its language, as no phrase that counts goes beyond
one. (The words' counts come first; a bitmap of fixed size tells the workers which words reach
`least`. Two words may share a bit: then a suffix is longer than it need be, and the result the same.)
Tasks add up equal suffixes as they go, which is what makes copies and common passages cheap.

Suffixes are shuffled by language and first word into ranges of that order, as runs in which each
keeps only what differs from the one before. There they are sorted in reverse lexicographic order, and
one stack of open prefixes counts all prefixes in one pass. The ranges are even by a sample of
suffixes (it only decides where ranges end), so a very common first word spans several of them. A
prefix that meets either end of a range may go on in the next: it leaves with the count it has,
whatever that is, and these parts are summed afterwards.

Counts of a phrase's parts are joined to it afterwards, for each place where it can be cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions

STRETCH = 1 << 22
SLOTS = 1 << 26
BLOCK = 1 << 16
MOST_WORDS = 400_000
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_STEP = 2000, 100_000, 32
#: Ranges to a shuffle partition at least, and words to a range at most (24 bytes each where it is counted).
RANGES_PER_PARTITION, RANGE_WORDS = 3, 4_000_000

_END = b"\xff"  # in no UTF-8 text, so it can stand for the end of a piece
_FOLD = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(data: bytes) -> list[bytes]:
    """Words of folded text, with _END between pieces."""
    return data.replace(_END, b" \xff ").split()


def stretches(texts: Iterator[bytes], more: int, size: int = STRETCH) -> Iterator[tuple[list[bytes], int]]:
    """(words, own): the words of some texts or of a stretch of a long one, of which the first `own`
    belong to it; up to `more` words after them let suffixes run on into the next stretch."""
    held, length = [], 0
    for text in texts:
        data = text.translate(_FOLD)
        if len(data) > size:
            lo = 0
            while lo < len(data):
                hi = min([x for x in (data.find(b" ", lo + size), data.find(_END, lo + size)) if x >= 0], default=len(data))
                words, own, ahead = _words(data[lo:hi]), 0, 4096
                own = len(words)
                while hi < len(data) and len(after := _words(data[hi : hi + ahead])) <= more and hi + ahead < len(data):
                    ahead *= 2
                yield (words + after[:more] if hi < len(data) else words), own
                lo = hi
            continue
        held.append(data)
        length += len(data)
        if length > size:
            words = _words(_END.join(held))
            yield words, len(words)
            held, length = [], 0
    if held:
        words = _words(_END.join(held))
        yield words, len(words)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterator[bytes]]]:
    lang = batch.column("lang").dictionary_encode()
    text = batch.column("text").cast(pa.large_binary())
    for i, name in enumerate(lang.dictionary.to_pylist()):
        at = np.flatnonzero(np.asarray(lang.indices) == i)
        yield name, (text[int(j)].as_py() for j in at)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count), a word once a task or a few times; the null word counts them all."""
    held: dict[str, Counter] = {}

    def given() -> pa.RecordBatch:
        lang = [x for x, c in held.items() for _ in c]
        word = pa.array([w for c in held.values() for w in c], pa.binary()).cast(pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), word, pa.array([n for c in held.values() for n in c.values()], pa.int64())], ["lang", "word", "count"])
        held.clear()
        return out

    for batch in batches:
        for lang, texts in _by_lang(batch):
            counts = held.setdefault(lang, Counter())
            for words, own in stretches(texts, 0):
                counts.update(words[:own])
                counts[None] += own - counts.pop(_END, 0)
        if sum(map(len, held.values())) > MOST_WORDS:
            yield given()
    yield given()


def _slot(lang: bytes, word: bytes) -> int:
    return zlib.crc32(lang + b"\0" + word) & (SLOTS - 1)


def _bits(rows: pa.Table) -> pa.Table:
    held = np.zeros(BLOCK, bool)
    held[rows.column("bit").to_numpy()] = True
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def _bitmap(words: DataFrame) -> np.ndarray:
    """One bit for each word's slot; at most SLOTS / BLOCK rows reach the driver."""
    slot = F.crc32(F.concat_ws("\0", "lang", "word").cast("binary")).bitwiseAND(F.lit(SLOTS - 1))
    at = words.select((slot / BLOCK).cast("int").alias("block"), (slot % BLOCK).cast("int").alias("bit")).distinct()
    out = np.zeros((SLOTS // BLOCK, BLOCK // 8), np.uint8)
    for r in at.groupBy("block").applyInArrow(_bits, "block int, bits binary").collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _suffixes(words: list[bytes], own: int, frequent, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(values, rows, counts): the distinct suffixes of two words or more in rising order, each word
    as a number into the sorted values and -1 after the last; and how often each occurs."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    values = coded.dictionary.to_pylist()
    kept = sorted(i for i, w in enumerate(values) if frequent(w))
    kept.sort(key=values.__getitem__)
    number = np.full(len(values) + 1, -1, np.int64)
    number[kept] = np.arange(len(kept))
    ids = np.concatenate([number[np.asarray(coded.indices)], np.full(size, -1)])
    at = np.flatnonzero((ids[:own] >= 0) & (ids[1 : own + 1] >= 0))
    columns = [ids[at]]
    for k in range(1, size):
        columns.append(np.where(columns[-1] >= 0, ids[at + k], -1))
    base = len(kept) + 1
    keys, held = [], None
    for c in columns:  # as few sort keys as 63 bits each allow
        if held is None or width * base >= 1 << 62:
            if held is not None:
                keys.append(held)
            held, width = c + 1, base
        else:
            held, width = held * base + c + 1, width * base
    keys.append(held)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    first = np.flatnonzero(new)
    rows = np.stack([c[order[first]] for c in columns], axis=1) if len(at) else np.empty((0, size), np.int64)
    return [values[i] for i in kept], rows, np.diff(np.append(first, len(at)))


def lower_bound(values: list[bytes], rows: np.ndarray, words: tuple[bytes, ...]) -> int:
    """The first of the sorted rows that is not less than these words (b"": none)."""
    lo, hi = 0, len(rows)
    for k, w in enumerate(words):
        if not w:
            break
        n = bisect_left(values, w)
        at = lo + int(np.searchsorted(rows[lo:hi, k], n))
        if n == len(values) or values[n] != w:
            return at
        lo, hi = at, lo + int(np.searchsorted(rows[lo:hi, k], n, "right"))
    return lo


def _narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers from 0 on in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if values.max(initial=0) < 1 << 8 * w)
    return values.astype(f"<u{width}").tobytes(), width


def packed(values: list[bytes], rows: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """(words, shape, tails, counts) of sorted suffixes: each row keeps what differs from the one before.

    shape holds a byte a row, 16 times the words shared with the row before plus the row's words.
    """
    length = (rows >= 0).sum(axis=1)
    same = np.zeros_like(rows, dtype=bool)
    same[1:] = (rows[1:] == rows[:-1]) & (rows[1:] >= 0)
    shared = np.minimum.accumulate(same, axis=1).sum(axis=1)
    own = (np.arange(rows.shape[1]) >= shared[:, None]) & (rows >= 0)
    used, tails = np.unique(rows[rows >= 0], return_inverse=True)
    number = np.zeros_like(rows)
    number[rows >= 0] = tails
    tails, width = _narrow(number[own])
    times, count_width = _narrow(counts)
    shape = np.concatenate([np.array([width, count_width]), 16 * shared + length]).astype(np.uint8)
    return _END.join(values[i] for i in used), shape.tobytes(), tails, times


def unpacked(words: bytes, shape: bytes, tails: bytes, counts: bytes, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(values, rows, counts) as they were given to `packed`, without unused values."""
    shape = np.frombuffer(shape, np.uint8)
    flat, times = np.frombuffer(tails, f"<u{shape[0]}").astype(np.int64), np.frombuffer(counts, f"<u{shape[1]}").astype(np.int64)
    shared, length = (shape[2:] // 16).astype(np.int64), (shape[2:] % 16).astype(np.int64)
    start = np.append(0, np.cumsum(length - shared)[:-1]) - shared
    rows = np.full((len(length), size), -1, np.int64)
    for k in range(size):
        own = (shared <= k) & (k < length)
        rows[own, k] = flat[start[own] + k]
        last = np.maximum.accumulate(np.where(shared <= k, np.arange(len(length)), -1))  # the row this word was written in
        rows[:, k] = rows[last, k]
    return words.split(_END), rows, times


def _frequent(bits: np.ndarray, lang: bytes):
    def known(word: bytes) -> bool:
        slot = _slot(lang, word)
        return word != _END and bool(bits[slot >> 3] >> (slot & 7) & 1)

    return known


def _some_suffixes(size: int, bitmap):
    """(lang, words) of every SAMPLE_STEP-th suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts in _by_lang(batch):
                for words, own in stretches(texts, size - 1):
                    values, rows, _ = _suffixes(words, own, _frequent(bitmap.value, name.encode()), size)
                    some = [_END.join(values[i] for i in r if i >= 0) for r in rows[::SAMPLE_STEP].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.binary())], ["lang", "words"])

    return run


def _suffix_runs(size: int, bitmap, bounds):
    """(part, lang, words, shape, tails, counts): the suffixes of a stretch that fall into one range.

    A range's number is that of the bounds that are not above its suffixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts in _by_lang(batch):
                lang = name.encode()
                below = sum(b[0] < lang for b in bounds.value)
                own_bounds = [b[1:] for b in bounds.value if b[0] == lang]
                for words, own in stretches(texts, size - 1):
                    values, rows, counts = _suffixes(words, own, _frequent(bitmap.value, lang), size)
                    cuts = [0, *(lower_bound(values, rows, b) for b in own_bounds), len(rows)]
                    out = [(below + i, name, *packed(values, rows[lo:hi], counts[lo:hi])) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
                    if out:
                        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 4]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["part", "lang", "words", "shape", "tails", "counts"])

    return run


def count_prefixes(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, rows, counts) of the prefixes of k words, 2 or more, of suffixes in reverse lexicographic order.

    The stack of open prefixes is worked through for all rows at once: the prefix of k words at a row
    is opened where it differs from the row before and closed where it differs from the row after.
    One that closes with less than `least` is dropped, unless it was open at either end.
    """
    differs = np.zeros(len(rows), bool)
    differs[:1] = True
    for k in range(1, rows.shape[1] + 1):
        differs[1:] |= rows[1:, k - 1] != rows[:-1, k - 1]
        if k == 1:
            continue
        opened = np.flatnonzero(differs & (rows[:, k - 1] >= 0))
        if not len(opened):
            return
        edges = np.append(np.flatnonzero(differs), len(rows))
        closed = edges[np.searchsorted(edges, opened, "right")]
        sums = np.append(0, np.cumsum(counts))
        total = sums[closed] - sums[opened]
        give = (total >= least) | (opened == 0) | (closed == len(rows))
        yield k, opened[give], total[give]


def _prefix_counts(size: int, least: int):
    def run(runs: pa.Table) -> pa.Table:
        parts = [unpacked(*(c.as_py() for c in r), size) for r in zip(*(runs.column(c) for c in ("words", "shape", "tails", "counts")))]
        values = sorted(set().union(*(p[0] for p in parts)))
        number = {w: i for i, w in enumerate(values)}
        rows = np.concatenate([np.append(np.array([number[w] for w in own]), -1)[r] for own, r, _ in parts])
        counts = np.concatenate([p[2] for p in parts])
        order = np.lexsort(rows.T[::-1])[::-1]
        rows, counts = rows[order], counts[order]
        held = [[], [], []]
        for k, at, total in count_prefixes(rows, counts, least):
            held[0] += [k] * len(at)
            held[1] += [b" ".join(values[i] for i in r).decode() for r in rows[at, :k].tolist()]
            held[2] += total.tolist()
        lang = runs.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(held[0]), pa.string()), "size": pa.array(held[0], pa.int32()), "phrase": pa.array(held[1], pa.string()), "count": pa.array(held[2], pa.int64())})

    return run


def _bounds(sample: DataFrame, ranges: int, size: int) -> list[tuple[bytes, ...]]:
    """Where ranges end: evenly spaced suffixes of a bounded sample."""
    rows = sorted((r["lang"].encode(), *bytes(r["words"]).split(_END)) for r in sample.limit(SAMPLE_ROWS).collect())
    rows = [r + (b"",) * (size + 1 - len(r)) for r in rows]
    return sorted({rows[i * len(rows) // ranges] for i in range(1, ranges)}) if rows else []


def phrase_counts(docs: DataFrame, least: int = 100, max_n: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f), (lang, n)): all phrases of 1 to max_n words that occur `least` times,
    and the number of words of each language. Both are written tables."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_word_counts, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("f"))
    counts = materialize(counts.where(F.col("word").isNull() | (F.col("f") >= least)))
    words = counts.where("word IS NOT NULL")
    bitmap = spark.sparkContext.broadcast(_bitmap(words))
    tokens = counts.where("word IS NULL").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    ranges = max(RANGES_PER_PARTITION * shuffle_partitions(spark), -(-tokens // RANGE_WORDS))
    some = texts.sample(min(1.0, SAMPLE_DOCS / max(1, texts.count())), seed=13).mapInArrow(_some_suffixes(max_n, bitmap), "lang string, words binary")
    bounds = spark.sparkContext.broadcast(_bounds(some, ranges, max_n))
    runs = texts.mapInArrow(_suffix_runs(max_n, bitmap, bounds), "part int, lang string, words binary, shape binary, tails binary, counts binary")
    parts = runs.groupBy("part", "lang").applyInArrow(_prefix_counts(max_n, least), "lang string, size int, phrase string, count long")
    phrases = parts.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    single = words.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "f")
    out = materialize(phrases.unionByName(single))
    totals = materialize(counts.where("word IS NULL").select("lang", F.col("f").alias("n")))
    release(counts)
    return out, totals


def collocations(
    docs: DataFrame, least: int = 100, max_n: int = 5, share: int = 100, most: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 to max_n words.

    A phrase that occurs a >= least times scores floor(1000 * a * n / (l * r)) at its worst cut, ties
    to the shortest first part. It is dropped if a longer such phrase that holds it occurs at least
    `share` percent as often. Ranks go by score, then a, both falling, then phrase in byte order.
    Null texts are empty, a null language counts as `und`; repeated rows count each time. A language
    with no such phrase gives no row. Arithmetic is in decimals of 38 digits. Other columns are ignored.
    """
    if max_n < 2 or least < 1:
        raise ValueError("max_n must be 2 or more and least 1 or more")
    counted, totals = phrase_counts(docs, least, max_n, lang_col, text_col)
    words = F.split("phrase", " ")
    phrases = counted.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"))
    text = lambda start, length: F.array_join(F.slice("words", start, length), " ")

    longest = phrases.where("size > 2").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    longest = longest.select("lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"))
    longest = longest.select("lang", text(F.col("start"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))

    cuts = kept.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    for keys in (["lang", "salt"], ["lang"]):  # the best of each part of a language first, so no task ranks all of one
        scored = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
