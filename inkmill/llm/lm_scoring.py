"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c becomes the level q = 1 + floor(log c / log BASE), and the filter holds (n-gram, 1) to
(n-gram, q); probing levels upward until one is missing reads the level back, never too low. Word and
word-pair counts are summed by key partition, and each partition fills its own segment of the filter,
sized by its items. The filter grows with the corpus, so its bytes are summed first: up to
MAX_BROADCAST it is broadcast; beyond, the segments stay where they are and the buckets of texts send
them their n-grams and get levels back.

The score smooths the pair count by the word's own probability (Dirichlet prior of weight PRIOR), both
from probes. The base score needs exact word counts; buckets get those of their own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import bucketed, packed, partition_of, partition_slices, spread, unpacked
from .common import lean, lean_cogroup, lean_group, materialize, release, shuffle_partitions, sweep
from .textbytes import U64, Words, mix, words_of

BASE = 1.5
#: 7 probes of 10 bits an item: a missing item is found with probability (1 - exp(-0.7))^7 = 0.8%.
PROBES = 7
BITS_PER_ITEM = 10
PRIOR = 2000.0
MAX_BROADCAST = 128 << 20
FLUSH = 2_000_000
END = U64(0x8F1BBCDCBFA53E0B)
_NEXT = U64(0x9E3779B97F4A7C15)


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and each text's first token."""
    bounds = words.bounds + np.arange(len(words.bounds))
    tokens = np.full(bounds[-1], END, U64)
    tokens[np.arange(len(words.hashes)) + words.owner()] = words.hashes
    return tokens, bounds


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """The key of each token with the one before; the first of a text follows an end."""
    before = np.append(END, tokens[:-1])
    return mix(before * _NEXT + tokens)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the mean of the whole numbers it covers, 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    return np.where(level > 0, (low + np.maximum(low, np.ceil(BASE**level - 1e-9) - 1)) / 2, 0.0)


class Segment:
    """A Bloom filter over the (key, level) items of one key partition."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @classmethod
    def filled(cls, keys: np.ndarray, level: np.ndarray) -> Segment:
        size = max(64, int(BITS_PER_ITEM * level.sum()))
        out = cls(np.zeros(size // 8 + 1, np.uint8), size)
        for q in range(1, int(level.max(initial=0)) + 1):
            for at in out._places(keys[level >= q], q):
                np.bitwise_or.at(out.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    @staticmethod
    def _probes(keys: np.ndarray, q: int, size) -> Iterator[np.ndarray]:
        a = mix(keys ^ mix(np.array([q], U64)))
        b = mix(a) | U64(1)
        for i in range(PROBES):
            yield ((a + U64(i) * b) % size).astype(np.int64)

    def _places(self, keys: np.ndarray, q: int) -> Iterator[np.ndarray]:
        return self._probes(keys, q, U64(self.size))

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: the last before the first that is missing."""
        return Filter([(0, self.bits, self.size)], 1).level(keys, np.zeros(len(keys), np.int64))


class Filter:
    """The segments (key partition, bits, size) one after the other, so that keys of all partitions are read at once."""

    def __init__(self, segments: list[tuple[int, np.ndarray, int]], parts: int):
        lengths = [len(bits) for _, bits, _ in segments]
        # Partitions without a segment read from zeros at the end.
        self.bits = np.concatenate([*(bits for _, bits, _ in segments), np.zeros(8, np.uint8)])
        self.first, self.size = np.full(parts, len(self.bits) - 8), np.full(parts, 64, U64)
        for (part, _, size), end, length in zip(segments, np.cumsum(lengths).tolist(), lengths):
            self.first[part], self.size[part] = end - length, size

    def level(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        left, q = np.arange(len(keys)), 1
        while len(left):
            first, hit = self.first[part[left]], np.ones(len(left), bool)
            for at in Segment._probes(keys[left], q, self.size[part[left]]):
                hit &= (self.bits[first + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
            left = left[hit]
            out[left] = q
            q += 1
        return out


def _sent(parts: int):
    """Input side: per partition the words and pairs of the training texts with their counts."""

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(held)
        out: dict[int, list[bytes]] = {}
        for i, keys in enumerate((tokens, pairs_of(tokens))):
            keys, counts = np.unique(keys, return_counts=True)
            order, slices = partition_slices(keys, parts)
            keys, counts = keys[order], counts[order].astype(np.uint32)
            for part, a, b in slices:
                row = out.setdefault(part, [b""] * 4)
                row[2 * i], row[2 * i + 1] = packed(keys[a:b]), packed(counts[a:b])
        columns = [pa.array(list(out), pa.int32()), *(pa.array([r[i] for r in out.values()], pa.binary()) for i in range(4))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "words", "word_counts", "pairs", "pair_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for words in words_of(batch.column(0), lower=True):
                held.append(tokens_of(words)[0])
                count += len(held[-1])
                if count > FLUSH:
                    yield from rows(held)
                    held, count = [], 0
        if held:
            yield from rows(held)

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _segment(table: pa.Table) -> pa.Table:
    words, word_counts = _summed(unpacked(table.column("words"), U64), unpacked(table.column("word_counts"), np.uint32))
    pairs, pair_counts = _summed(unpacked(table.column("pairs"), U64), unpacked(table.column("pair_counts"), np.uint32))
    made = Segment.filled(np.concatenate([words, ~pairs]), levels(np.maximum(1, np.concatenate([word_counts, pair_counts]))))
    row = {"part": table.column("part")[0].as_py(), "bits": packed(made.bits), "size": made.size, "tokens": int(word_counts.sum()), "types": len(words)}
    return pa.table({k: [v] for k, v in row.items()}).cast(pa.schema([("part", pa.int32()), ("bits", pa.binary()), ("size", pa.int64()), ("tokens", pa.int64()), ("types", pa.int64())]))


def _own_counts(parts: int):
    """A bucket's distinct words with their counts in its training texts, 0 included."""

    def run(table: pa.Table) -> pa.Table:
        train = np.array(table.column("train").to_pylist(), bool)
        found = []
        for words in words_of(table.column("text").combine_chunks(), lower=True):
            tokens, bounds = tokens_of(words)
            keys, at = np.unique(tokens, return_inverse=True)
            learned = np.repeat(train[words.first : words.first + words.texts], np.diff(bounds))
            found.append((keys, np.bincount(at, learned, len(keys))))
        keys, counts = _summed(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
        order, slices = partition_slices(keys, parts)
        keys, counts = keys[order], counts[order]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "part": pa.array([p for p, _, _ in slices], pa.int32()), "bucket": pa.array([bucket] * len(slices), pa.int32()),
            "keys": pa.array([packed(keys[a:b]) for _, a, b in slices], pa.binary()), "counts": pa.array([packed(counts[a:b]) for _, a, b in slices], pa.binary()),
        })

    return run


def _whole_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    keys, counts = unpacked(table.column("keys"), U64), unpacked(table.column("counts"), np.int64)
    bucket = spread(table.column("bucket").to_pylist(), table.column("keys"), 8)
    own, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts, len(own)).astype(np.int64)[at]
    order = np.argsort(bucket, kind="stable")
    keys, total, bucket = keys[order], total[order], bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = list(zip(start, np.append(start[1:], len(bucket))))
    columns = [pa.array(bucket[start], pa.int32()), *(pa.array([packed(x[a:b]) for a, b in ends], pa.binary()) for x in (keys, total))]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts"])


def _asked(parts: int):
    """A bucket's distinct filter keys by partition, for segments that are not broadcast."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        for part in words_of(table.column("text").combine_chunks(), lower=True):
            tokens = tokens_of(part)[0]
            found.append((np.unique(tokens), np.unique(pairs_of(tokens))))
        words, pairs = (np.unique(np.concatenate([x[i] for x in found])) for i in (0, 1))
        keys, raw = np.concatenate([words, ~pairs]), np.concatenate([words, pairs])
        order, slices = partition_slices(raw, parts)
        keys, bucket = keys[order], table.column("bucket")[0].as_py()
        return pa.table({
            "part": pa.array([p for p, _, _ in slices], pa.int32()), "bucket": pa.array([bucket] * len(slices), pa.int32()),
            "keys": pa.array([packed(keys[a:b]) for _, a, b in slices], pa.binary()),
        })

    return run


def _told(asked: pa.Table, segments: pa.Table) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    out = []
    if segments.num_rows:
        segment = Segment(unpacked(segments.column("bits"), np.uint8), segments.column("size")[0].as_py())
        for bucket, keys in zip(asked.column("bucket").to_pylist(), asked.column("keys").to_pylist()):
            level = segment.level(np.frombuffer(keys, U64))
            out.append((bucket, keys, packed(level)))
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _filter_keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys as the filter holds them (pairs inverted) and as they are dealt to partitions,
    and where each token's word and pair are among them."""
    words, word_at = np.unique(tokens, return_inverse=True)
    pairs, pair_at = np.unique(pairs_of(tokens), return_inverse=True)
    return np.concatenate([words, ~pairs]), np.concatenate([words, pairs]), word_at, pair_at + len(words)


def _scores(parts: int, model, tokens_total: int, types: int, schema: T.StructType):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema_table(schema)
        kind = np.array(told.column("kind").to_pylist(), np.int32)
        exact, asked = (told.filter(pa.array(kind == i)) for i in (0, 1))
        sorted_ = [(keys[order], counts[order]) for keys, counts in ((unpacked(x.column("keys"), U64), unpacked(x.column("counts"), np.int64)) for x in (exact, asked)) for order in (np.argsort(keys),)]
        (own_keys, own_counts), (filter_keys, filter_levels) = sorted_
        out = []
        for words in words_of(texts.column("text").combine_chunks(), lower=True):
            tokens, bounds = tokens_of(words)
            known = own_counts[np.searchsorted(own_keys, tokens)]
            base = np.log10((known + 1) / (tokens_total + types + 1))
            every, raw, word_at, pair_at = _filter_keys(tokens)
            if model is not None:
                level = model.value.level(every, partition_of(raw, parts))
            elif len(filter_keys):
                at = np.minimum(np.searchsorted(filter_keys, every), len(filter_keys) - 1)
                level = np.where(filter_keys[at] == every, filter_levels[at], 0)
            else:
                level = np.zeros(len(every), np.int64)
            count = expected(level)
            before = np.append(count[np.searchsorted(every[: word_at.max() + 1], END)], count[word_at][:-1])
            own = (count[word_at] + 1) / (tokens_total + types + 1)
            score = np.log10((count[pair_at] + PRIOR * own) / (np.maximum(before, count[pair_at]) + PRIOR))
            at = bounds[:-1]
            out.append((np.diff(bounds), np.add.reduceat((known > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(score, at)))
        n_tokens, n_known, base, score = (np.concatenate([x[i] for x in out]) for i in range(4))
        total = np.full(len(n_tokens), tokens_total, np.int64)
        return pa.table([texts.column("id"), *(pa.array(x) for x in (n_tokens, n_known, total, base, score))], names=schema.names)

    return run


def schema_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def lm_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for every row, learned where `train` holds.

    train: a boolean Column of docs; null counts as false. Tokens are the words (A-Z lowered) and one
    end a text; null text is empty, so has the end alone. Both scores are log10 probabilities of the
    text. Without training rows every count is 0 and the scores those of an empty model. Rows come
    out one for one; repeated rows count, and learn, as often as they occur.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    train = F.coalesce(train, F.lit(False))
    learned = docs.where(train).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = learned.mapInArrow(lean(_sent(parts)), "part int, words binary, word_counts binary, pairs binary, pair_counts binary")
    segments = sent.groupBy("part").applyInArrow(lean_group(_segment), "part int, bits binary, size long, tokens long, types long")
    segments = materialize(segments)
    del sent
    sweep(spark)
    total = segments.agg(F.sum("tokens"), F.sum("types"), F.sum(F.length("bits"))).first()
    tokens_total, types, size = (x or 0 for x in total)

    own = bucketed(docs, id_col, text_col, train.alias("train"))
    counts = own.groupBy("bucket").applyInArrow(lean_group(_own_counts(parts)), "part int, bucket int, keys binary, counts binary")
    told = counts.repartition(parts, "part").mapInArrow(lean(_whole_counts), "bucket int, keys binary, counts binary").withColumn("kind", F.lit(0))
    model = None
    if size <= max_broadcast:
        held = [(r["part"], np.frombuffer(r["bits"], np.uint8), r["size"]) for r in segments.select("part", "bits", "size").toLocalIterator()]
        model = spark.sparkContext.broadcast(Filter(held, parts))
        release(segments)
    else:
        asked = own.groupBy("bucket").applyInArrow(lean_group(_asked(parts)), "part int, bucket int, keys binary")
        levels_told = asked.groupBy("part").cogroup(segments.select("part", "bits", "size").groupBy("part"))
        told = told.unionByName(levels_told.applyInArrow(lean_cogroup(_told), "bucket int, keys binary, counts binary").withColumn("kind", F.lit(1)))
    schema = T.StructType([own.schema["id"]]).add("n_tokens", T.LongType()).add("n_known", T.LongType()).add("train_tokens", T.LongType())
    schema = schema.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    out = own.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lean_cogroup(_scores(parts, model, tokens_total, types, schema)), schema)
    return out.withColumnRenamed("id", id_col)
