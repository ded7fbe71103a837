"""N-gram Jaccard join with two-level PartEnum signatures: exact links, without all pairs.

Sets are grouped in bands of like size. Two sets with Jaccard similarity of at least 3/4 differ in
d <= (a + b) / 7 elements, a and b their sizes, so the larger size of a band bounds d by some k. In
each band the feature domain is split by hash into n1 partitions, n1 > k / 2, and each of these into
PARTS = 3. As k differences fall on n1 partitions, some partition has at most one, so two of its three
parts are the same in both sets: a set's signatures are, for each partition, the hashes of all its
subsets of two parts. A set joins the band above too if it has partners there.

A partition without a difference shares three signatures, one with a single difference one, so the
differences spoil two signatures each while they last to reach every partition, and one each beyond
that. A subset whose parts are empty in a set gives no signature, so a partition with two empty parts
shares two signatures without a difference and none with one. What k differences can't spoil is the
set's `need`: the least number of signatures it shares with any similar set. Sets for which that is
nothing (few) also send the elements of their prefix filter; two that are similar share one of those.

Signatures travel packed: an input task sends one row of byte arrays to each partition, five bytes a
signature and nine a set, and a partition expands one range of signatures at a time. Partitions are
few, as a set's key comes once in each that it has signatures in. Groups of up to
PAIRWISE sets with one signature give their pairs. Larger groups come from a passage that many texts
share, or from many near copies. A set that shares at least `need` signatures with every partner can
leave its `need - 1` largest groups: any partner still meets it in a smaller one. This empties the
groups of common passages. What stays, such as a thousand near copies, is compared with one pivot a
group; then groups whose sets are not all of one component yet are dealt into cells of two blocks of
bounded bytes, and a cell compares the sets of different components. It gives the sets that have a near
partner, first by short sketches, then by long ones, and last, from whole sets, a forest of links: no
step gives the pairs of a large group. Before whole sets are dealt, groups that share sets become one
where that ships fewer bytes, so that a set is not shipped for each signature that it shares.

Candidates are first thinned to one partner a set; once these give components, only pairs across
components are compared. Candidates that a parity sketch rules out go first (each differing element
flips one bit, so the bits that differ never outnumber the elements); the rest are verified on the
whole sets. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import lean, materialize, release, shuffle_partitions, sweep, worker_held
from .components import components
from .textbytes import U64, mix, shingle_sets, words_of

PAIRWISE = 8
#: Parts of a partition, and how many of them may differ between two sets that agree in it.
PARTS, DIFFER = 3, 1
SUBSETS = list(combinations(range(PARTS), PARTS - DIFFER))
#: Share of partitions beyond those that k differences can spoil.
SLACK = 0.2
GROWTH = 1.5
FLUSH = 500_000
#: Signatures that a partition holds packed, and that it expands at a time.
HELD, EXPANDED = 4_000_000, 250_000
#: Partitions of signatures that a small input has at most.
LEAST_PARTS = 16
#: Least bits of a set's sketch, and of the short one that pairs are sifted by first.
SKETCH, COARSE = 2048, 256
#: Ids of texts that are sent to all workers, about 100 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 300_000
#: Bytes of sketches in one block of a cell, and of whole sets.
BLOCK, WHOLE_BLOCK = 1 << 20, 4 << 20


def _bands(most: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, first-level partitions) of each band up to sizes of `most`, from 3 on."""
    out, low = [], 3
    while low <= most:
        high = int(low * GROWTH)
        out.append((low, high, int(np.ceil((2 * high // 7 + 1) / (DIFFER + 1) / (1 - SLACK)))))
        low = high + 1
    return out


def similar(size_a: np.ndarray, size_b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Jaccard similarity of at least 0.75, in whole numbers."""
    return 100 * common >= 75 * (size_a + size_b - common)


def _class_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 63-bit key of each set, a function of its elements alone."""
    sizes = np.diff(bounds)
    total = np.append(U64(0), np.cumsum(mix(hashes ^ U64(0x5BF03635))))
    other = np.append(U64(0), np.cumsum(mix(hashes + U64(0x1F83D9AB))))
    key = mix(total[bounds[1:]] - total[bounds[:-1]]) + U64(3) * mix(other[bounds[1:]] - other[bounds[:-1]])
    return (mix(key + sizes.astype(U64)) >> U64(1)).astype(np.int64)


def _sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set the parity of its elements in each of m hash buckets, m a power of two from SKETCH up."""
    out, low = [], (mix(hashes ^ U64(0xC2B2AE35)) & U64(0x7FFFFFFF)).astype(np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        m = max(SKETCH, 1 << (2 * (b - a) - 1).bit_length()) if b > a else SKETCH
        out.append(np.packbits((np.bincount(low[a:b] & (m - 1), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def _coarse(sketch: bytes, size: int) -> bytes:
    """A sketch folded to about a bit an element, enough to tell sets that share little."""
    x, bits = np.frombuffer(sketch, np.uint64), max(COARSE, 1 << (max(size, 1) - 1).bit_length())
    return np.bitwise_xor.reduce(x.reshape(-1, bits // 64), axis=0).tobytes()


def _flips(a: bytes, b: bytes) -> int:
    """Buckets whose parity differs; the longer sketch is folded, as its buckets are residues."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n_a, n_b, sketch_a, sketch_b), the pairs that differ in few enough buckets."""
    for batch in batches:
        n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
        keep = pa.array([7 * _flips(p, q) <= i + j for i, j, p, q in zip(n, m, x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_held(None)
    for batch in batches:
        for words in words_of(batch.column(1), lower=True):
            hashes, bounds = shingle_sets(words)
            sizes, need = np.diff(bounds), _signatures(hashes, bounds)[3]
            sketches = _sketches(hashes, bounds)
            coarse = [_coarse(x, n) for x, n in zip(sketches, sizes.tolist())]
            columns = [batch.column(0).slice(words.first, words.texts), pa.array(sizes, pa.int64()), pa.array(_class_keys(hashes, bounds)), pa.array(sketches, pa.binary()), pa.array(coarse, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(need[:, i])) for i in (0, 1))], names=["id", "n_shingles", "set_key", "sketch", "coarse", "need", "need_above"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_held(None)
    for batch in batches:
        for words in words_of(batch.column(0), lower=True):
            hashes, bounds = shingle_sets(words)
            yield pa.RecordBatch.from_arrays([pa.array(_class_keys(hashes, bounds)), _lists(hashes.view(np.int64), bounds)], names=["set_key", "hashes"])


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, owning set, 1 if of the band above, need[set, band above]) of all the sets."""
    sizes = np.diff(bounds)
    need = np.zeros((len(sizes), 2), np.int64)
    bands = _bands(int(sizes.max(initial=0)) * 4 // 3)
    found = [(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.uint8))]
    low = np.array([b[0] for b in bands] + [np.iinfo(np.int64).max])
    own = np.searchsorted(low, sizes, "right") - 1
    for up in (0, 1) if bands else ():
        chosen = np.flatnonzero((own >= 0) & ((sizes * 4 // 3 >= low[own + 1]) if up else True))
        if not len(chosen):
            continue
        band, count = own[chosen] + up, sizes[chosen]
        high, first_level = (np.array([b[i] for b in bands] + [1])[band] for i in (1, 2))
        most = (count + np.minimum(high, count * 4 // 3)) // 7  # no partner here differs in more
        local = np.repeat(np.arange(len(chosen)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1][chosen], count)
        h = hashes[at]
        salt = mix(band.astype(U64) + U64(0xA5A5))
        begin = PARTS * (np.cumsum(first_level) - first_level)
        slot = begin[local] + ((mix(h ^ salt[local]) >> U64(33)) % (PARTS * first_level[local]).astype(U64)).astype(np.int64)
        total = PARTS * int(first_level.sum())
        parts, filled = np.zeros(total, U64), np.bincount(slot, minlength=total).reshape(-1, PARTS)
        np.add.at(parts, slot, mix(h + U64(0x3C6EF372)))
        parts = mix(parts + (np.arange(total) % PARTS).astype(U64)).reshape(-1, PARTS)
        holder = np.repeat(np.arange(len(chosen)), first_level)
        number = np.arange(len(holder)) - begin[holder] // PARTS
        name = mix(salt[holder] + number.astype(U64))
        for i, subset in enumerate(SUBSETS):
            sig = mix(sum(parts[:, j] for j in subset) ^ (name + U64(i)))
            some = filled[:, subset].any(axis=1)
            found.append((sig[some], chosen[holder[some]], np.full(some.sum(), up, np.uint8)))
        empty = (filled == 0).sum(axis=1)
        three, two = (np.bincount(holder[at], minlength=len(chosen)) for at in (empty < 2, empty == 2))
        agree = 3 * three + 2 * two - 2 * np.minimum(most, three + two) - np.minimum(np.maximum(0, most - three - two), three)
        need[chosen, up] = agree
        weak = np.flatnonzero(agree <= 0)
        if len(weak):  # the prefix filter of these: elements in hash order, n - ceil(3n/4) + 1 of each
            length = count[weak] - (3 * count[weak] + 3) // 4 + 1
            mine = np.repeat(weak, length)
            nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            h = hashes[bounds[:-1][chosen[mine]] + nth]
            found.append((mix(h ^ mix(salt[mine] + U64(0xFFFFFFFF))), chosen[mine], np.full(len(h), up, np.uint8)))
    return (*(np.concatenate([x[i] for x in found]) for i in range(3)), need)


def _packed(parts: int):
    """Input side: per partition one row of arrays sig (low 32 bits), high (7 bits, and one for the
    band above), both in the order of their sets, keys, and counts, the signatures of each key."""

    def rows(sig: list[np.ndarray], key: list[np.ndarray], ups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, k, u = np.concatenate(sig), np.concatenate(key), np.concatenate(ups)
        part = ((s >> U64(39)) % U64(parts)).astype(np.int64)
        s &= U64((1 << 39) - 1)
        order = np.lexsort((s, k, part))
        s, k, part, u = s[order], k[order], part[order], u[order]
        new = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (part[1:] != part[:-1]))
        s, k, part, u = s[new], k[new], part[new], u[new]
        for p, lo, hi in zip(*_runs(part)):
            own, first = s[lo:hi], np.flatnonzero(np.append(True, k[lo + 1 : hi] != k[lo : hi - 1]))
            counts = np.diff(np.append(first, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in ((own & U64(0xFFFFFFFF)).astype(np.uint32), (own >> U64(32)).astype(np.uint8) | u[lo:hi] << 7, k[lo:hi][first], _narrow(counts)))],
                names=["part", "sig", "high", "keys", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_held(None)
        sig, key, ups, held = [], [], [], 0
        for batch in batches:
            for words in words_of(batch.column(0), lower=True):
                hashes, bounds = shingle_sets(words)
                s, owner, up, _ = _signatures(hashes, bounds)
                sig.append(s), key.append(_class_keys(hashes, bounds)[owner]), ups.append(up)
                held += len(s)
                if held > FLUSH:
                    yield from rows(sig, key, ups)
                    sig, key, ups, held = [], [], [], 0
        if held:
            yield from rows(sig, key, ups)

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 and more in the shortest type that holds them all."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _unpacked(low: pa.Buffer, high: pa.Buffer, keys: pa.Buffer, counts: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, at, keys) of a packed row in the order of the high 7 bits; at: each one's place in keys."""
    own = np.frombuffer(keys, np.int64)
    count = np.frombuffer(counts, f"u{counts.size // len(own)}")
    top = np.frombuffer(high, np.uint8)
    order = np.argsort(top & 127, kind="stable")
    at = np.repeat(np.arange(len(own), dtype=np.min_scalar_type(len(own))), count)
    return np.frombuffer(low, np.uint32)[order], top[order], at[order], own.copy()


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """(value, start, end) of each run of equal values."""
    if not len(x):
        return [], [], []
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[start].tolist(), start.tolist(), np.append(start[1:], len(x)).tolist()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among the sets that share a signature: (kind 0, a, b) pairs of small groups, and
    (kind 1, group, set) of large ones, kind 2 where the signature is of the set's band above; `size`
    is the group's."""
    rows = []
    for batch in batches:
        for part, *packed in zip(batch.column(0).to_pylist(), *([x.as_buffer() for x in c] for c in batch.columns[1:])):
            rows.append((part, *_unpacked(*packed)))
    total = sum(len(r[1]) for r in rows)
    ranges = 1
    while ranges < 128 and total > ranges * EXPANDED:
        ranges *= 2
    cuts = np.arange(ranges + 1, dtype=np.int64) * (128 // ranges)
    ends = [np.searchsorted(top & 127, cuts) for _, _, top, _, _ in rows]
    for r in range(ranges):
        sig, key, ups = [], [], []
        for (part, low, top, at, own), end in zip(rows, ends):
            now = slice(end[r], end[r + 1])
            sig.append(low[now].astype(U64) | (top[now] & 127).astype(U64) << U64(32) | U64(part) << U64(39))
            key.append(own[at[now]]), ups.append(top[now] >> 7)
        if sig:
            yield from _shared(np.concatenate(sig), np.concatenate(key), np.concatenate(ups))


def _shared(s: np.ndarray, k: np.ndarray, u: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(s, kind="stable")
    s, k, u = s[order], k[order], u[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    s, k, u = s[same], k[same], u[same]
    if not len(s):
        return
    order = np.lexsort((k, s))
    s, k, u = s[order], k[order], u[order]
    new = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]))
    s, k, u = s[new], k[new], u[new]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(start, len(s)))
    size = np.repeat(size, size)
    small = size <= PAIRWISE
    pairs = [np.empty((0, 2), np.int64)]
    for gap in range(1, PAIRWISE):
        at = np.flatnonzero(small[:-gap] & (s[:-gap] == s[gap:]))
        if len(at):
            pairs.append(np.stack([k[at], k[at + gap]], axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    large = np.flatnonzero(~small)
    kind = np.concatenate([np.zeros(len(pairs), np.int32), 1 + u[large].astype(np.int32)])
    a = np.concatenate([pairs[:, 0], s[large].view(np.int64)])
    b = np.concatenate([pairs[:, 1], k[large]])
    of = np.concatenate([np.zeros(len(pairs), np.int64), size[large]])
    for lo in range(0, len(kind), 100_000):
        hi = lo + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(x[lo:hi]) for x in (kind, a, b, of)], names=["kind", "a", "b", "size"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each cell of a stream of rows (group, low, high, ...) in that order."""
    held, last = [], None
    for batch in batches:
        ids = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(1 + np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))).tolist(), len(ids)] if len(ids) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and tuple(ids[lo]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(ids[lo])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _chunks(root: np.ndarray, most: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether of one root) of stretches of sorted roots; small roots come together."""
    begin = end = 0
    for _, start, stop in zip(*_runs(root)):
        if end > begin and stop - begin > most:
            yield begin, end, root[begin] == root[end - 1]
            begin = start
        end = stop
    if end > begin:
        yield begin, end, root[begin] == root[end - 1]


def _near(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a cell sorted by root, (rows, rows, matrix) of sets of different roots that sizes and sketches
    can't rule out. A cell with low = high compares the sets of one block, else those of block low with
    those of block high."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    own, root, n = (table.column(c).to_numpy() for c in ("own", "root", "n"))
    raw = table.column("sketch").to_pylist()
    width = min(map(len, raw))
    sketch = np.empty((len(raw), width // 8), U64)
    for i, x in enumerate(raw):
        sketch[i] = np.bitwise_xor.reduce(np.frombuffer(x, U64).reshape(-1, width // 8), axis=0)
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    step = max(1, (8 << 20) // max(1, width * len(right)))
    for start, end, one in _chunks(root[left], 64):
        if low == high:
            after = right[end if one else start :]
        else:
            after = right[root[right] != root[left[start]]] if one else right
        for lo in range(start, end if len(after) else start, step):
            rows = left[lo : min(lo + step, end)]
            flips = np.bitwise_count(sketch[rows, None, :] ^ sketch[None, after, :]).sum(axis=2, dtype=np.int64)
            a, b = n[rows, None], n[None, after]
            yield rows, after, (7 * flips <= a + b) & (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (root[rows, None] != root[None, after])


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells of rows (group, low, high, own, set_key, root, n, sketch), the pairs (group, a, b) of _near."""
    for table in map(lambda t: t.sort_by("root"), _cells(batches)):
        key, group = table.column("set_key").to_numpy(), table.column("group")[0].as_py()
        for rows, after, near in _near(table):
            i, j = np.nonzero(near)
            pairs = np.unique(np.sort(np.stack([key[rows[i]], key[after[j]]], axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), group)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["group", "a", "b"])


def _cell_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets in the pairs of _near, once a task: never more rows than come in."""
    found, held = np.empty(0, np.int64), []
    for table in map(lambda t: t.sort_by("root"), _cells(batches)):
        hit = np.zeros(table.num_rows, bool)
        for rows, after, near in _near(table):
            hit[rows] |= near.any(axis=1)
            hit[after] |= near.any(axis=0)
        held.append(table.column("set_key").to_numpy()[hit])
        if sum(map(len, held)) > max(100_000, len(found)):
            found, held = np.unique(np.concatenate([found, *held])), []
    found = np.unique(np.concatenate([found, *held]))
    for lo in range(0, len(found), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 100_000])], names=["set_key"])


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells of rows (group, low, high, own, set_key, root, n, sketch) whose sketch is the whole set,
    links (a, b) that join the same roots as all links inside the cell would: a forest of the roots."""
    for table in _cells(batches):
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        own, key, root, n = (table.column(c).to_numpy() for c in ("own", "set_key", "root", "n"))
        sets = [np.frombuffer(x, U64) for x in table.column("sketch").to_pylist()]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        elements, holder = np.concatenate([sets[j] for j in right]), np.repeat(right, n[right])
        order = np.argsort(elements, kind="stable")
        elements, holder = elements[order], holder[order]
        root, out = root.copy(), []
        for i in left.tolist():
            first, last = (np.searchsorted(elements, sets[i], side) for side in ("left", "right"))
            length = last - first
            at = np.arange(length.sum()) + np.repeat(first - np.cumsum(length) + length, length)
            common = np.bincount(holder[at], minlength=len(n))[right]
            linked = right[similar(n[i], n[right], common) & (root[right] != root[i])]
            _, one = np.unique(root[linked], return_index=True)
            for j in linked[one].tolist():
                out.append((min(key[i], key[j]), max(key[i], key[j])))
            if len(linked):
                root[np.isin(root, root[linked])] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _in_cells(large: DataFrame, roots: DataFrame, classes: DataFrame, parts: int, thin: bool, of: str = "coarse", block: int = BLOCK, run=None) -> DataFrame:
    """What the large groups whose sets are not all of one component hold. `of` names the column of
    classes that is dealt into cells, as a set comes in each of its groups.

    With thin the sets that have a near partner of another component, as many rows at most as groups
    have sets; without, the pairs themselves, as many as the square of a group. With `run`, a function of
    cells, its pairs (a, b).
    """
    rows = large.join(roots, large["set_key"] == roots["node"], "left").select("group", "set_key", F.coalesce("root", "set_key").alias("root"))
    rows = materialize(rows)
    mixed = rows.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("sets")).where("lo <> hi")
    mixed = materialize(mixed.select("group", "sets"))
    left = rows.join(mixed, "group")
    some = _of_keys(classes.select("set_key", "n", of), left.select("set_key"))
    bytes_of = left.join(some.select("set_key", F.length(of).alias("bytes")), "set_key").groupBy("group").agg(F.sum("bytes").alias("bytes"))
    blocks = materialize(bytes_of.select("group", F.ceil(F.col("bytes") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    dealt = left.join(blocks, "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # The sketch comes last, so that only the deal into cells ships it once for each of a set's groups.
    dealt = dealt.join(some, "set_key")
    dealt = dealt.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "set_key", "root", F.col("n").cast("long").alias("n"), F.col(of).alias("sketch"))
    dealt = dealt.repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high")
    if run is not None:
        found = materialize(dealt.mapInArrow(lean(run), "a long, b long"))
    elif thin:
        found = materialize(dealt.mapInArrow(lean(_cell_sets), "set_key long"))
    else:
        found = materialize(dealt.mapInArrow(lean(_cell_pairs), "group long, a long, b long"))
    release(rows), release(mixed), release(blocks)
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = batch.columns
        keep = []
        for i in range(batch.num_rows):
            p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
            common = len(p) + len(q) - len(np.union1d(p, q))
            keep.append(bool(similar(len(p), len(q), common)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def _sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidate pairs that sizes and sketches, first the short ones, can't rule out."""
    for sketch in ("coarse", "sketch"):
        some = _of_keys(classes.select("set_key", "n", sketch), pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")))
        one, two = (some.select(F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col(sketch).alias(f"sketch_{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").where(_NEAR_SIZES)
        pairs = materialize(both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(_sift), "a long, b long"))
    return pairs


def _of_keys(classes: DataFrame, keys: DataFrame) -> DataFrame:
    """The classes with these keys; up to MAX_BROADCAST keys go to the classes, so that sketches of sets
    without candidates don't cross the network. More keys leave the cut to the join that follows."""
    keys = materialize(keys.distinct())
    return classes.join(F.broadcast(keys), "set_key", "left_semi") if keys.count() <= MAX_BROADCAST else classes


_NEAR_SIZES = "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are not yet known to be of one component."""
    for x in "ab":
        known = roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        pairs = pairs.join(known, x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    return pairs.where("root_a <> root_b").select("a", "b")


def _sets_of(keys: DataFrame, classes: DataFrame, own: DataFrame) -> DataFrame:
    """set_key, hashes: the whole sets of distinct keys, from one text each."""
    wanted = materialize(keys.join(classes, "set_key").select("first"))
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = own.join(wanted, own["id"].eqNullSafe(wanted["first"]), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(lean(_full_sets), "set_key long, hashes array<long>"))
    del texts
    sweep(own.sparkSession)
    release(wanted)
    return sets


def _links(pairs: DataFrame, classes: DataFrame, own: DataFrame) -> DataFrame:
    """Of the candidate pairs of set keys, those that link; only their sets are built, one text each."""
    sets = _sets_of(pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct(), classes, own)
    one = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("x")).dropDuplicates(["a"])
    two = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("y")).dropDuplicates(["b"])
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    links = materialize(both.mapInArrow(lean(_verified), "a long, b long"))
    release(sets)
    return links


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [x.values.to_numpy() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set_key", "n", "whole"])


def _links_in_groups(large: DataFrame, roots: DataFrame, classes: DataFrame, own: DataFrame, parts: int) -> DataFrame | None:
    """Links inside large groups that join all sets of different components that link there.

    Sets without a near partner by the short sketches go first, then those without one by the long
    ones; the rest are compared as whole sets. Each step gives sets or a forest, never pairs of sets.
    """
    for sketch in ("coarse", "sketch"):
        hits = _in_cells(large, roots, classes, parts, True, sketch)
        if hits.isEmpty():
            return None
        large = materialize(large.join(hits.distinct(), "set_key", "left_semi").select("group", "set_key"))
        release(hits)
    sets = _sets_of(large.select("set_key").distinct(), classes, own).dropDuplicates(["set_key"])
    sets = materialize(sets.mapInArrow(lean(_packed_sets), "set_key long, n long, whole binary"))
    merged = _merged(large, roots, sets.select("set_key", (8 * F.col("n")).alias("bytes")), WHOLE_BLOCK)
    return _in_cells(merged, roots, sets, parts, True, "whole", WHOLE_BLOCK, _cell_links).distinct()


def _merged(large: DataFrame, roots: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(group, set_key) rows in which every two sets of one group of different components still meet.

    Groups of one component alone go. Those that share sets, directly or through others, become one
    where its cells get fewer bytes than theirs: a set comes once for each block of its group.
    """
    rows = large.join(roots, large["set_key"] == roots["node"], "left").select("group", "set_key", F.coalesce("root", "set_key").alias("root"))
    rows = materialize(rows.join(sizes, "set_key"))
    per_group = rows.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("set_key").alias("least"), F.sum("bytes").alias("bytes")).where("lo <> hi")
    per_group = materialize(per_group.select("group", "least", (F.col("bytes") * F.ceil(F.col("bytes") / block)).alias("cost")))
    rows = materialize(rows.join(per_group.select("group", "least"), "group").select("group", "least", "set_key", "bytes"))
    whole = components(rows, "least", "set_key")

    def of_whole(table: DataFrame, key: str) -> DataFrame:
        return table.join(whole, table[key] == whole["node"], "left").withColumn("whole", F.coalesce("root", key)).drop("node", "root")

    members = materialize(of_whole(rows.select("set_key", "bytes").distinct(), "set_key"))
    apart = materialize(of_whole(per_group, "least"))
    cost = members.groupBy("whole").agg((F.sum("bytes") * F.ceil(F.sum("bytes") / block)).alias("one"))
    cost = cost.join(apart.groupBy("whole").agg(F.sum("cost").alias("many")), "whole")
    one = materialize(cost.where("one <= many").select("whole"))
    kept = rows.join(apart.join(one, "whole", "left_anti").select("group"), "group", "left_semi").select("group", "set_key")
    return materialize(members.join(one, "whole").select(F.col("whole").alias("group"), "set_key").union(kept))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links, own included).

    Words are lower-cased (A-Z); shingles have five words; a shorter text has its whole sequence as
    its one shingle. Null, empty and wordless texts have no shingles and link with nothing. Rows
    come out one for one; repeated rows are copies of each other. Other columns are ignored.
    """
    parts = shuffle_partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([own.schema["id"]]).add("n_shingles", T.LongType()).add("set_key", T.LongType()).add("sketch", T.BinaryType()).add("coarse", T.BinaryType()).add("need", T.LongType()).add("need_above", T.LongType())
    per_doc = materialize(own.mapInArrow(lean(_per_document), schema))
    shingles = per_doc.agg(F.sum("n_shingles")).first()[0] or 0
    packs = -(-int(1.2 * shingles) // HELD)
    parts, packs = max(parts, packs), max(min(parts, LEAST_PARTS), packs)
    classes = per_doc.where("n_shingles > 0").groupBy("set_key")
    same = ("sketch", "coarse", "need", "need_above")  # functions of the set
    classes = materialize(classes.agg(F.min("id").alias("first"), F.any_value("n_shingles").alias("n"), *(F.any_value(c).alias(c) for c in same)))

    sweep(docs.sparkSession)
    packed = own.select("text").mapInArrow(lean(_packed(packs)), "part int, sig binary, high binary, keys binary, counts binary")
    found = materialize(packed.repartition(packs, "part").mapInArrow(lean(_groups), "kind int, a long, b long, size long"))
    del packed
    sweep(docs.sparkSession)
    small = found.where("kind = 0").select("a", "b")
    large = found.where("kind > 0").select("kind", F.col("a").alias("group"), F.col("b").alias("set_key"), "size")
    mine = W.partitionBy("set_key", "kind")  # a set has few signatures
    large = large.withColumn("n_large", F.count("*").over(mine)).withColumn("nth", F.row_number().over(mine.orderBy("size", "group")))
    need = F.when(F.col("kind") == 1, F.col("need")).otherwise(F.col("need_above"))
    large = large.join(classes.select("set_key", "need", "need_above"), "set_key").where(F.col("nth") <= F.col("n_large") - F.greatest(F.lit(1), need) + 1)
    large = materialize(large.groupBy("group", "set_key").agg(F.max("n_large").alias("n_large")))
    # The set with most signatures in large groups is the likeliest original of a group of copies.
    pivots = materialize(large.groupBy("group").agg(F.max(F.struct("n_large", "set_key"))["set_key"].alias("pivot")))
    stars = large.join(pivots, "group").where("pivot <> set_key")
    stars = stars.select(F.least("pivot", "set_key").alias("a"), F.greatest("pivot", "set_key").alias("b"))
    pairs = materialize(small.union(stars).distinct())

    tree = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars)
    tree = materialize(tree.distinct())
    links = _links(_sifted(tree, classes), classes, own)
    roots = components(links)
    rest = materialize(_across(pairs.join(tree, ["a", "b"], "left_anti"), roots))
    if not rest.isEmpty():
        links = links.union(_links(_sifted(rest, classes), classes, own))
        roots = components(links)
    more = _links_in_groups(large, roots, classes, own, parts)
    if more is not None:
        roots = components(links.union(more))

    label = F.coalesce("root", "set_key").alias("root")
    members = materialize(classes.join(roots, classes["set_key"] == roots["node"], "left").select("set_key", "first", label))
    least = materialize(members.groupBy("root").agg(F.min("first").alias("least")))
    named = materialize(members.join(least, "root").select("set_key", "least"))
    for x in (classes, found, large, pivots, pairs, tree, rest, members, least):
        release(x)
    out = per_doc.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that lead their component (least id), with all their columns."""
    lead = jaccard_components(docs, id_col, text_col).where(F.col("component_id").eqNullSafe(F.col(id_col)))
    lead = lead.select(F.col(id_col).alias("__id")).distinct()
    return docs.join(lead, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
