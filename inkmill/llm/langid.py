"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The unit is a run of letters: the state starts anew at each run, the network labels every byte of
it, and a document's probabilities are the mean over all its labelled positions. As a run's output
depends on its bytes alone, a worker computes each distinct run once and keeps a bounded memo.

Training is backpropagation through time with Adam on the driver, over runs drawn from a bounded,
hash-chosen sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, worker_held

#: A run of letters. [^\W\d_] also lets through a few numerals such as superscripts; see _counts.
RUN = re.compile(r"[^\W\d_]+")
MAX_BYTES = 32
MEMO_RUNS = 1 << 18
UNKNOWN = "und"


def _pieces(run: str) -> list[bytes]:
    raw = run.encode("utf-8", "replace")
    return [raw[i : i + MAX_BYTES] for i in range(0, len(raw), MAX_BYTES)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Two gated recurrent layers (one each way) of `hidden` units and a softmax at every byte."""

    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        h, k = hidden, len(langs)
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p["x" + way] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p["u" + way] = rng.normal(0, 0.7 / np.sqrt(h), (h, 2 * h)).astype(np.float32)
            self.p["c" + way] = rng.normal(0, 0.7 / np.sqrt(h), (h, h)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.p["ob"] = np.zeros(k, np.float32)

    def _run(self, way: str, x: np.ndarray, keep: bool):
        """States of one direction over x (batch, time); with `keep` also what backward needs."""
        h, p = self.hidden, self.p
        n, steps = x.shape
        state = np.zeros((n, h), np.float32)
        states = np.empty((steps, n, h), np.float32)
        tape = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = p["x" + way][x[:, t]]
            zr = _sigmoid(a[:, : 2 * h] + state @ p["u" + way])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + (r * state) @ p["c" + way])
            new = state + z * (c - state)
            if keep:
                tape.append((t, state, z, r, c))
            states[t] = state = new
        return states, tape

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch, language) at every byte."""
        both = np.concatenate([self._run("f", x, False)[0], self._run("b", x, False)[0]], axis=2)
        s = both @ self.p["o"] + self.p["ob"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean cross-entropy over all positions."""
        p, h = self.p, self.hidden
        n, steps = x.shape
        runs = {way: self._run(way, x, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        s = both @ p["o"] + p["ob"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        loss = float(-np.log(np.maximum(s[:, np.arange(n), y], 1e-9)).mean())
        d = s
        d[:, np.arange(n), y] -= 1
        d /= n * steps
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = np.einsum("tnh,tnk->hk", both, d, optimize=True)
        g["ob"] = d.sum(axis=(0, 1))
        d_both = d @ p["o"].T
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            carry = np.zeros((n, h), np.float32)
            u, c_w = p["u" + way], p["c" + way]
            for t, state, z, r, c in reversed(runs[way][1]):
                d_new = d_both[t][:, part] + carry
                d_c = d_new * z * (1 - c * c)
                d_rs = d_c @ c_w.T
                d_z = d_new * (c - state) * z * (1 - z)
                d_r = d_rs * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                carry = d_new * (1 - z) + d_rs * r + d_zr @ u.T
                g["c" + way] += (r * state).T @ d_c
                g["u" + way] += state.T @ d_zr
                np.add.at(g["x" + way], x[:, t], np.concatenate([d_zr, d_c], axis=1))
        return g, loss

    def fit(self, runs_by_lang: list[list[bytes]], steps: int = 220, batch: int = 512, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over batches of equal-length runs, every language as often as the others."""
        rng = np.random.default_rng(seed)
        pools: dict[int, list[np.ndarray]] = {}
        for k, runs in enumerate(runs_by_lang):
            for w in runs:
                pools.setdefault(len(w), [[] for _ in runs_by_lang])[k].append(w)
        lengths = sorted(n for n, by in pools.items() if sum(map(bool, by)) > len(by) // 2)
        if not lengths:
            return
        share = np.array([n * sum(len(b) for b in pools[n]) for n in lengths], float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            by = pools[lengths[rng.choice(len(lengths), p=share / share.sum())]]
            held = [k for k, b in enumerate(by) if b]
            y = rng.choice(held, batch)
            x = np.stack([np.frombuffer(by[k][rng.integers(len(by[k]))], np.uint8) for k in y])
            g, _ = self.gradients(x, y)
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


class _Memo:
    """Per distinct run: the sum over its positions of the probabilities, and how many positions."""

    def __init__(self, model: ByteGRU):
        self.model, self.at = model, {}
        self.sums = np.zeros((0, len(model.langs) + 1))

    def learn(self, runs: list[str]) -> None:
        if len(self.at) + len(runs) > MEMO_RUNS:
            self.at, self.sums = {}, self.sums[:0]
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, run in enumerate(runs):
            if run.isalpha() or any(map(str.isalpha, run)):
                for piece in _pieces(run):
                    at, raw = by_length.setdefault(len(piece), ([], []))
                    at.append(i)
                    raw.append(piece)
        new = np.zeros((len(runs), self.sums.shape[1]))
        for n, (at, raw) in by_length.items():
            for lo in range(0, len(at), 8192):
                x = np.frombuffer(b"".join(raw[lo : lo + 8192]), np.uint8).reshape(-1, n)
                np.add.at(new[:, :-1], at[lo : lo + 8192], self.model.positions(x).sum(axis=0))
                np.add.at(new[:, -1], at[lo : lo + 8192], n)
        base = len(self.at)
        self.at |= {run: base + i for i, run in enumerate(runs)}
        self.sums = np.concatenate([self.sums, new])

    def pooled(self, counts: Counter) -> np.ndarray | None:
        """The document's probabilities: the mean over its labelled positions."""
        total = np.zeros(self.sums.shape[1])
        items = list(counts.items())
        for lo in range(0, len(items), MEMO_RUNS // 2):
            part = items[lo : lo + MEMO_RUNS // 2]
            if new := [w for w, _ in part if w not in self.at]:
                before = len(self.at)
                self.learn(new)
                if len(self.at) < before + len(new):
                    self.learn([w for w, _ in part if w not in self.at])
            at = np.fromiter((self.at[w] for w, _ in part), np.int64, len(part))
            total += np.fromiter((c for _, c in part), float, len(part)) @ self.sums[at]
        return total[:-1] / total[-1] if total[-1] else None


def _ahead(texts: pa.Array, memo: _Memo | None) -> Iterator[Counter]:
    """The run counts of each text; new runs of many texts are learned together, in large batches."""
    held: list[Counter] = []
    new: set[str] = set()
    for text in texts:
        counts = Counter(RUN.findall(text.as_py().lower())) if text.is_valid else Counter()
        held.append(counts)
        if memo:
            new.update(w for w in counts if w not in memo.at)
        if len(new) > MEMO_RUNS // 8 or len(held) >= 2000:
            if new:
                memo.learn(sorted(new))
            yield from held
            held, new = [], set()
    if new:
        memo.learn(sorted(new))
    yield from held


def _memo(model: ByteGRU) -> _Memo:
    """One memo a worker process, as workers serve many tasks."""
    return worker_held(("languages", *(v.tobytes() for v in model.p.values())), lambda: _Memo(model))


def train_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 300, max_chars: int = 100_000
) -> ByteGRU | None:
    """Fit on about docs_per_lang hash-chosen documents of each language, of up to max_chars each.

    The sample depends on ids and texts alone, not on the layout of the files, and is put in order.

    Returns None where no row has both a text and a language.
    """
    known = docs.where((F.length(text_col) <= max_chars) & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 20))
    chosen = F.lit(False)
    for k in langs:
        chosen = chosen | ((F.col(lang_col) == k) & (bucket < int((1 << 20) * min(1.0, docs_per_lang / sizes[k]))))
    rows = {k: [] for k in langs}
    for r in sorted(tuple(r) for r in known.where(chosen).select(lang_col, text_col).toLocalIterator()):
        rows[r[0]] += [p for w in RUN.findall(r[1].lower()) for p in _pieces(w)]
    model = ByteGRU(langs)
    model.fit([rows[k] for k in langs])
    return model


def _labelled(docs: DataFrame, model: ByteGRU | None, text_col: str, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs, and __lang, __score, __positions read off the text alone."""
    schema = T.StructType([docs.schema[c] for c in carry])
    schema = schema.add("__lang", T.StringType()).add("__score", T.DoubleType()).add("__positions", T.LongType())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(model) if model else None
        for batch in batches:
            langs, scores, seen = [], [], []
            for counts in _ahead(batch.column(0), memo):
                pooled = memo.pooled(counts) if memo and counts else None
                if pooled is None:
                    langs.append(UNKNOWN), scores.append(0.0), seen.append(0)
                else:
                    best = int(pooled.argmax())
                    langs.append(model.langs[best]), scores.append(min(1.0, float(pooled[best])))
                    seen.append(sum(len(w.encode("utf-8", "replace")) * c for w, c in counts.items()))
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(seen, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=schema.names)

    return docs.select(F.col(text_col).alias("__text"), *carry).mapInArrow(lean(label), schema)


def identify_languages(docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (pooled probability of lang_pred, 0 to 1), n_positions labelled.

    A null text, one without letters, or a missing model gives `und` with score 0. Only the text is
    read; rows come out one for one, repeated ids included, and other columns are ignored.
    """
    out = _labelled(docs, model, text_col, [id_col])
    return out.select(id_col, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__positions").alias("n_positions"))


def keep_identified(docs: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is recognised from their text, with all their columns.

    The model learns from the documents' own labels. Rows go whose text is null or has no letters,
    or whose score is under least_score. Repeated rows stay as often as they came in.
    """
    out = _labelled(docs, train_language_model(docs, text_col=text_col), text_col, docs.columns)
    return out.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).select(*docs.columns)
