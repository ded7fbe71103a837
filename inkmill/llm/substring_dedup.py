"""Repeated passages removed by prefix-partitioned suffix trees over words.

A suffix starts at every word; nodes of the suffix tree at a depth of `size` words or more with
several leaves are the repeats, and a word goes if one of its windows of `size` words is not the
first leaf of such a node. The tree is never whole in one place:

1. Counting. The prefix of a suffix is the 8-word gram of least hash within its first `size` words:
   suffixes that agree on `size` words have the same one, so no deep node is split, and neighbouring
   suffixes mostly share one, so their words travel once. Buckets of texts count their suffixes under
   each prefix. Prefixes of one bucket only lead to no node beyond it and are cut.
2. Prefixes of variable length. A prefix over more than GROUP suffixes is lengthened to all first
   `size` words of each; under such a prefix a bucket has one leaf, so every group fits in memory.
3. Subtrees. The words of the suffixes are dealt by prefix. Each partition sorts the suffixes of some
   groups at a time by doubling, takes the common length of neighbours, and reads the internal nodes
   off as the intervals of common length `size` or more. The leaf of least (document, position)
   stays; buckets are told the places of their other leaves.
4. Each bucket marks the words under those leaves and under windows repeated within it.

Suffixes are compared word by word, words by 64-bit hashes; windows of one bucket by 64-bit hashes.
A bucket sends each window once, from its own first place, so a passage in a third of all documents
costs one leaf a bucket. The texts are shuffled into their buckets by one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .buckets import answers, bucketed, member, packed, partition_slices, spread, unpacked
from .common import shuffle_partitions
from .textbytes import U64, Words, all_words, windows

SIZE = 20
SHORT = 8
SHORT_MASK = U64((1 << 48) - 1)
NO_ID = -(1 << 63)
#: Suffixes under one prefix before it is lengthened.
GROUP = 100_000
#: Words sorted at a time, whole groups each.
CHUNK = 1 << 20
LONGER = U64(1 << 62)


class Bucket:
    """The documents of a bucket, sorted by id, equal rows once; `rows` maps rows to documents."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_pylist()
        texts = table.column("text").combine_chunks()
        raw = texts.to_pylist()
        key = [(NO_ID if i is None else i, int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little")) for i, t in zip(ids, raw)]
        order = sorted(range(len(key)), key=key.__getitem__)
        held, self.rows = [], np.zeros(len(key), np.int64)
        for at in order:
            if not held or key[held[-1]] != key[at]:
                held.append(at)
            self.rows[at] = len(held) - 1
        self.ids = np.array([key[i][0] for i in held], np.int64)
        self.marks = np.array([key[i][1] for i in held], np.uint32)
        self.words: Words = all_words(texts.take(pa.array(held, pa.int64())), lower=False)

    def inside(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it lies in one document) of the windows of `size` words."""
        hashes = windows(self.words.hashes, size)
        ends = np.repeat(self.words.bounds[1:], np.diff(self.words.bounds))[: len(hashes)]
        return hashes, np.arange(len(hashes)) + size <= ends

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(at, prefix): the first place in this bucket of each distinct window, and its prefix."""
        short = (windows(self.words.hashes, SHORT) & SHORT_MASK) + U64(1)
        hashes, whole = self.inside(size)
        least = short[: len(whole)].copy()
        for k in range(1, size - SHORT + 1):
            np.minimum(least, short[k : k + len(whole)], out=least)
        at = np.flatnonzero(whole)
        at = np.sort(at[np.unique(hashes[at], return_index=True)[1]])
        return at, least[at]


def _send_prefixes(size: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(Bucket(table).prefixes(size)[1], return_counts=True)
        order, slices = partition_slices(_dealt(keys), parts)
        keys, counts = keys[order], counts[order].astype(np.uint32)
        bucket = table.column("bucket")[0].as_py()
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in slices], pa.int32()),
                "bucket": pa.array([bucket] * len(slices), pa.int32()),
                "keys": pa.array([packed(keys[a:b]) for _, a, b in slices], pa.binary()),
                "counts": pa.array([packed(counts[a:b]) for _, a, b in slices], pa.binary()),
            }
        )

    return run


def _dealt(keys: np.ndarray) -> np.ndarray:
    """Short prefixes have 48 bits; dealing needs bits above the fortieth."""
    return keys * U64(0x9E3779B97F4A7C15)


def _shared_prefixes(group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefixes of several buckets, marked where they have to be lengthened."""
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        keys, counts = unpacked(table.column("keys"), U64), unpacked(table.column("counts"), np.uint32)
        bucket = spread(table.column("bucket").to_pylist(), table.column("keys"), 8)
        order = np.argsort(keys, kind="stable")
        keys, counts, bucket = keys[order], counts[order].astype(np.int64), bucket[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        often = np.diff(np.append(start, len(keys)))
        total = np.add.reduceat(counts, start) if len(start) else start
        shared = np.repeat(often > 1, often)
        marked = np.where(np.repeat(total > group, often), keys | LONGER, keys)
        yield from answers(bucket[shared], marked[shared]).to_batches()

    return run


SUFFIXES = "part int, bucket int, keys binary, at binary, length binary, words binary, ids binary, marks binary, starts binary"


def _send_suffixes(size: int, parts: int):
    """Runs of neighbouring suffixes under one prefix: (prefix, place of the first, words), packed."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SUFFIXES.split(", ")]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        out = []
        if texts.num_rows and told.num_rows:
            own = Bucket(texts)
            bucket, w = texts.column("bucket")[0].as_py(), own.words
            answer = unpacked(told.column("keys"), U64)
            longer = np.sort(answer[answer >= LONGER] ^ LONGER)
            at, keys = own.prefixes(size)
            wanted = member(keys, np.sort(answer & ~LONGER))
            at, keys = at[wanted], keys[wanted]
            split = member(keys, longer)
            keys[split] = own.inside(size)[0][at[split]]
            first = np.append(True, (at[1:] != at[:-1] + 1) | (keys[1:] != keys[:-1]) | split[1:])[: len(at)]
            # a window of the next text differs in place by `size` at least, so no run crosses a border
            begin = np.flatnonzero(first)
            length = np.diff(np.append(begin, len(at))) + size - 1
            at, keys = at[begin], keys[begin]
            order, slices = partition_slices(_dealt(keys), parts)
            at, keys, length = at[order], keys[order], length[order]
            doc = np.searchsorted(w.bounds, at, "right") - 1
            for part, a, b in slices:
                docs = np.unique(doc[a:b])
                words = w.hashes[_ranges(at[a:b], length[a:b])]
                arrays = (keys[a:b], at[a:b].astype(np.uint32), length[a:b].astype(np.uint32), words, own.ids[docs], own.marks[docs], w.bounds[docs].astype(np.uint32))
                out.append((part, bucket, *map(packed, arrays)))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))})

    return run


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for start[1], and so on."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def suffix_order(words: np.ndarray, left: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at` in order, and the common length of each with the one before.

    left: words from each place to the end of its run, where suffixes end. Ranks of 1, 2, 4, 8 and 16
    words come by doubling, so order and common length are exact up to 31 words.
    """
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1]
    step = 1
    while step < 16:
        low = np.zeros(n, np.int64)
        low[: n - step] = ranks[-1][step:]
        low[left <= step] = 0
        ranks.append(np.unique(ranks[-1] * (n + 2) + low, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    after = np.where(left[at] > 16, ranks[-1][np.minimum(at + 16, n - 1)], 0)
    order = np.argsort(ranks[-1][at] * (n + 2) + after, kind="stable")
    here = at[order]
    a, b = here[:-1], here[1:]
    common = np.zeros(len(a), np.int64)
    for level in range(4, -1, -1):
        size = 1 << level
        x, y = a + common, b + common
        room = np.minimum(left[a], left[b]) - common >= size
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += size * (room & (ranks[level][x] == ranks[level][y]))
    return order, np.append(0, common)[: len(order)]


def _later_leaves(size: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves of the subtrees' internal nodes of depth `size` or more, but each node's least."""
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        column = lambda name, dtype: unpacked(table.column(name), dtype)
        keys, at, length, words = column("keys", U64), column("at", np.uint32).astype(np.int64), column("length", np.uint32).astype(np.int64), column("words", U64)
        bucket = spread(table.column("bucket").to_pylist(), table.column("keys"), 8)
        ids, marks, place = [], [], []
        for where, *docs in zip(*(table.column(c).to_pylist() for c in ("at", "ids", "marks", "starts"))):
            where, (own, mark, start) = np.frombuffer(where, np.uint32), (np.frombuffer(x, t) for x, t in zip(docs, (np.int64, np.uint32, np.uint32)))
            doc = np.searchsorted(start, where, "right") - 1
            ids.append(own[doc]), marks.append(mark[doc]), place.append(where.astype(np.int64) - start[doc])
        ids, marks, place = np.concatenate(ids), np.concatenate(marks), np.concatenate(place)
        offset = np.cumsum(length) - length
        order = np.argsort(keys, kind="stable")
        total = np.cumsum(length[order])
        group_end = np.append(np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1, len(order))
        found, lo = [], 0
        while lo < len(order):
            full = np.searchsorted(total, (total[lo - 1] if lo else 0) + chunk, "right")
            ends = group_end[group_end <= full]
            hi = int(ends[-1]) if len(ends) and ends[-1] > lo else int(group_end[np.searchsorted(group_end, lo, "right")])
            run_of = order[lo:hi]
            n = length[run_of]
            text = words[_ranges(offset[run_of], n)]
            left = np.repeat(np.cumsum(n), n) - np.arange(len(text))
            start = np.flatnonzero(left >= size)
            owner = np.repeat(run_of, n - size + 1)
            step = start - np.repeat(np.cumsum(n) - n, n - size + 1)
            sorted_at, common = suffix_order(text, left, start)
            node = np.cumsum(common < size)
            owner, step = owner[sorted_at], step[sorted_at]
            least = np.lexsort((place[owner] + step, marks[owner], ids[owner], node))
            node = node[least]
            other = least[np.append(False, node[1:] == node[:-1])]
            found.append((bucket[owner[other]], (at[owner[other]] + step[other]).astype(np.uint32)))
            lo = hi
        yield from answers(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])).to_batches()

    return run


def _keep(size: int, schema: T.StructType, with_text: bool):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f.name: pa.array([]) for f in schema}).select(schema.names)
        own = Bucket(texts)
        w = own.words
        hashes, whole = own.inside(size)
        gone = np.zeros(len(w.hashes) + 1, np.int64)
        at = np.flatnonzero(whole)
        repeat = np.ones(len(hashes), bool)
        repeat[at[np.unique(hashes[at], return_index=True)[1]]] = False
        repeat &= whole
        if told.num_rows:
            repeat[unpacked(told.column("keys"), np.uint32)] = True
        at = np.flatnonzero(repeat)
        gone[at] += 1
        gone[at + size] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        last = np.zeros(len(keep), bool)  # the last kept word of its document has no space after it
        kept_at = np.flatnonzero(keep)
        owner = w.owner()
        if len(kept_at):
            last[kept_at[np.append(owner[kept_at][1:] != owner[kept_at][:-1], True)]] = True
        edge = np.zeros(len(w.data) + 2, np.int64)
        np.add.at(edge, w.begin[keep], 1)
        np.add.at(edge, w.end[keep] + ~last[keep], -1)
        mask = np.cumsum(edge[: len(w.data)]) > 0
        data = w.data.copy()
        spaced = w.end[keep & ~last]
        data[spaced] = 32
        out = data[mask]
        size_at = np.append(0, np.cumsum(mask))[w.starts]
        counts = np.diff(w.bounds)
        removed = np.diff(np.append(0, np.cumsum(~keep))[w.bounds])
        kept = [out[a:b].tobytes() for a, b in zip(size_at[:-1], size_at[1:])]
        digest = [hashlib.sha256(x).hexdigest() for x in kept]
        rows = own.rows
        columns = [texts.column("id"), pa.array(counts[rows]), pa.array(removed[rows]), pa.array([digest[i] for i in rows])]
        if with_text:
            columns.append(pa.array([kept[i].decode() for i in rows]))
        return pa.table(columns, names=schema.names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_text: bool = True, group: int = GROUP, chunk: int = CHUNK
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, and with_text also kept_text: kept words joined by spaces.

    A word goes if some window of `size` consecutive words over it also starts earlier, in a document
    of smaller id or before it in its own; windows are judged on the input. Ids are whole numbers. A
    null text has no words; a null id comes before all others; of rows with one id and different
    texts a hash of the text decides the order; rows equal in both are one document and each gets
    its result. Texts shorter than a window stay whole. Other columns are ignored.
    """
    if not SHORT <= size <= 31:
        raise ValueError(f"size must be {SHORT} to 31 words")
    parts = shuffle_partitions(docs.sparkSession)
    own = bucketed(docs, id_col, text_col)
    answer = "bucket int, keys binary"
    prefixes = own.groupBy("bucket").applyInArrow(_send_prefixes(size, parts), "part int, bucket int, keys binary, counts binary")
    shared = prefixes.repartition(parts, "part").mapInArrow(_shared_prefixes(group), answer)
    suffixes = own.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_send_suffixes(size, parts), SUFFIXES)
    later = suffixes.repartition(parts, "part").mapInArrow(_later_leaves(size, chunk), answer)
    schema = T.StructType([own.schema["id"]]).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
    if with_text:
        schema = schema.add("kept_text", T.StringType())
    out = own.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(_keep(size, schema, with_text), schema)
    return out.withColumnRenamed("id", id_col)
