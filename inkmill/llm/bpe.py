"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf of a word's tree holds (rank, position) of one pair of neighbouring symbols, each inner
node the least of its children, so the root is the leftmost pair of lowest rank. A merge rewrites
the leaves of at most three pairs and the nodes above them, until no pair can merge. The trees of
many words of like length sit side by side in numpy arrays and take their steps together.

A worker keeps a bounded memo of the words that it has encoded; the tree encodes every word once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, worker_held

MEMO_WORDS = 1 << 18
NONE = np.int64(1) << 62
SPACE = r"\t-\r \x85\xa0  -     　"


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 + its order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordBPE:
    """The model of a tokenizers JSON file: lower-cased words with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_characters()
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        made = np.array(pairs, np.int64).reshape(-1, 3)
        key = made[:, 0] << 32 | made[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[:, 2]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.tokens: list[str] = [""] * size
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        self.pattern = pattern.replace(r"[^\s", f"[^{SPACE}")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE where it can't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, at in by_width.items():
            most = max(1, (1 << 16) >> bits)
            for lo in range(0, len(at), most):
                part = at[lo : lo + most]
                for i, ids in zip(part, self._merge([words[i] for i in part], 1 << bits)):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> Iterator[bytes]:
        """Merge words of at most `width` bytes, one segment tree each."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.first[raw]
        rows = np.arange(n)
        symbol[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        alive = np.arange(width) < sizes[:, None]

        tree = np.full((n, 2 * width), NONE)
        rank = self.rank(symbol[:, :-1], symbol[:, 1:])
        rank[np.arange(1, width) >= sizes[:, None]] = NONE
        tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + np.arange(width - 1), NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        rows = rows[tree[:, 1] < NONE]
        while len(rows):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            symbol[rows, i] = self.made[root // width]
            alive[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            inside = k < sizes[rows]
            before[rows[inside], k[inside]] = i[inside]
            h = before[rows, i]

            right = np.full(len(rows), NONE)
            r, a, b = rows[inside], i[inside], k[inside]
            new = self.rank(symbol[r, a], symbol[r, b])
            right[inside] = np.where(new < NONE, new * width + a, NONE)
            led = h >= 0
            r, a, b = rows[led], h[led], i[led]
            new = self.rank(symbol[r, a], symbol[r, b])
            tree[rows, width + i] = right
            tree[rows, width + j] = NONE
            tree[r, width + a] = np.where(new < NONE, new * width + a, NONE)
            owner, node = np.concatenate([rows, rows, r]), np.concatenate([i, j, a]) + width
            while node[0] > 1:
                node = node >> 1
                tree[owner, node] = np.minimum(tree[owner, 2 * node], tree[owner, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]

        ids = symbol[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        lo = 0
        for hi in ends.tolist():
            yield ids[lo:hi]
            lo = hi

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, special ones included: the format has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Encodes texts in batches; words that recur come from a bounded memo."""

    def __init__(self, model: WordBPE):
        self.model, self.memo = model, {}
        self.words = regex.compile(model.pattern).findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(model.added, key=len, reverse=True))) + ")").split if model.added else None

    def _parts(self, text: str) -> list[list[str] | int]:
        """Words of each stretch between added tokens, and the ids of those tokens."""
        pieces = self.split(text) if self.split and "<|" in text else [text]
        out: list[list[str] | int] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(self.model.added[piece])
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                out.append(self.words(piece.lower()))
        return out

    def _learn(self, new: set[str]) -> None:
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
        words = sorted(new)
        self.memo.update(zip(words, self.model.encode_words([w.encode("utf-8", "surrogatepass") for w in words])))

    def _joined(self, parts: list[list[str] | int]) -> bytes:
        out = []
        for part in parts:
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
                continue
            for lo in range(0, len(part), MEMO_WORDS // 2):
                words = part[lo : lo + MEMO_WORDS // 2]
                try:
                    out.append(b"".join(map(self.memo.__getitem__, words)))
                except KeyError:  # the memo was emptied meanwhile
                    self._learn(set(words).difference(self.memo))
                    self._learn(set(words).difference(self.memo))
                    out.append(b"".join(map(self.memo.__getitem__, words)))
        return b"".join(out)

    def encode(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """The ids of each text in order, as little-endian unsigned 32-bit integers; null: none."""
        held: list[list[list[str] | int]] = []
        new: set[str] = set()
        count = 0
        for text in texts:
            parts = self._parts(text or "")
            held.append(parts)
            for part in parts:
                if not isinstance(part, int):
                    count += len(part)
                    new.update(set(part).difference(self.memo))
            if len(new) > MEMO_WORDS // 8 or count > 2_000_000:
                self._learn(new)
                yield from map(self._joined, held)
                held, new, count = [], set(), 0
        self._learn(new)
        yield from map(self._joined, held)


def _encoder(path: str) -> Encoder:
    return worker_held(("encoder", path), lambda: Encoder(WordBPE(path)))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and with_ids also token_ids.

    `tokenizer` is the path of a tokenizers JSON file of the kind of WordBPE, on every worker.
    Null text counts as empty and has no tokens. Rows come out one for one, repeated ids included;
    other columns are ignored. Half surrogates can't occur in Spark strings.
    """
    schema = T.StructType([docs.schema[id_col]]).add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    if with_ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    slice_rows = 256

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(lo, slice_rows)
                counts, digests, decoded, ids_out = [], [], [], []
                for ids in encoder.encode(x.as_py() for x in batch.column(1)):
                    text = encoder.model.decode(ids)
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                new = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    new.append(pa.array(ids_out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=schema.names)

    return docs.select(id_col, F.col(text_col)).mapInArrow(lean(encode), schema)
