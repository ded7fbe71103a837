"""Quality scores by a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Shallow regression trees, fitted to the
gradient of the log loss, are boosted in cycles over the features, each adding to its feature's
lookup table only; then cycles over the strongest pairs of features add to two-way tables. A score is
the logistic of a sum of table entries, read for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "letters", "spaces", "marks", "rare_marks", "lines",
    "line_length", "distinct_words", "distinct_lines", "words_marked", "stop_marks",
)
BINS = 32
PAIR_BINS = 8


def featured(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The columns to keep and the features of a text, all from built-in expressions. Null: empty."""
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    words = F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("__text", r"\n"), lambda w: w != "")
    rows = rows.select("*", words.alias("__words"), lines.alias("__lines"))
    kept = rows.columns[: len(keep)]
    return rows.select(*kept, *(c.alias(n) for n, c in zip(FEATURES, _features(F.col("__text"), F.col("__words"), F.col("__lines")))))


def _features(text: Column, words: Column, lines: Column) -> list[Column]:
    chars = F.length(text).cast("double")
    some = F.greatest(chars, F.lit(1.0))
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    one = F.lit(1.0)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / some

    return [
        F.log1p(chars),
        F.log1p(n_words),
        chars / F.greatest(n_words, one),
        share(r"\p{Lu}"),
        share(r"[0-9]"),
        share(r"\p{L}"),
        share(r"\s"),
        share(r"[^\p{L}\p{N}\s]"),
        share(r"[^\p{L}\p{N}\s.,;:'\"()-]"),
        F.log1p(n_lines),
        chars / F.greatest(n_lines, one),
        F.size(F.array_distinct(words)) / F.greatest(n_words, one),
        F.size(F.array_distinct(lines)) / F.greatest(n_lines, one),
        F.regexp_count(text, F.lit(r"\S[^\p{L}\p{N}\s.,;:'\"()-](?=\s|$)")) / F.greatest(n_words, one),
        share(r"[.!?]"),
    ]


class AdditiveModel:
    """Tables per feature and per pair of features over bins, and an intercept."""

    def __init__(self, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3, smooth: float = 4.0):
        self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.leaves, self.smooth = rounds, pairs, pair_rounds, rate, leaves, smooth
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def _coarse(self, bins: np.ndarray, f: int) -> np.ndarray:
        return bins[:, f] * PAIR_BINS // (len(self.edges[f]) + 1)

    def _tree(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """A tree of few leaves over ordered bins: split, best first, where the gain is largest."""
        g, h = np.append(0.0, np.cumsum(grad)), np.append(0.0, np.cumsum(hess))
        value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + self.smooth)
        parts = [(0, len(grad))]
        for _ in range(self.leaves - 1):
            best = (1e-9, None, None)
            for part in parts:
                a, b = part
                if b - a < 2:
                    continue
                c = np.arange(a + 1, b)
                gain = value(a, c) + value(c, b) - value(a, b)
                if gain.max() > best[0]:
                    best = (float(gain.max()), part, int(c[gain.argmax()]))
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(len(grad))
        for a, b in parts:
            out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + self.smooth)
        return out

    def _grid_tree(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """A tree of depth two over a grid: one cut of each feature, each quadrant its own leaf."""
        g = np.zeros((grad.shape[0] + 1, grad.shape[1] + 1))
        h = np.zeros_like(g)
        g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
        best, cut = 1e-9, None
        for i in range(1, grad.shape[0]):
            for j in range(1, grad.shape[1]):
                gq = np.array([g[i, j], g[-1, j] - g[i, j], g[i, -1] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]])
                hq = np.array([h[i, j], h[-1, j] - h[i, j], h[i, -1] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]])
                if (gain := float((gq**2 / (hq + self.smooth)).sum())) > best:
                    best, cut = gain, (i, j, gq / (hq + self.smooth))
        out = np.zeros_like(grad)
        if cut:
            i, j, v = cut
            out[:i, :j], out[i:, :j], out[:i, j:], out[i:, j:] = v
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = self._binned(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                b = bins[:, f]
                step = self.rate * self._tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                score += step[b]
        gains = []
        p = 1 / (1 + np.exp(-score))
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                cell = self._coarse(bins, i) * PAIR_BINS + self._coarse(bins, j)
                g, h = np.bincount(cell, y - p, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
                gains.append((-float((g * g / (h + self.smooth)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains)[: self.n_pairs]]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                p = 1 / (1 + np.exp(-score))
                a, b = self._coarse(bins, i), self._coarse(bins, j)
                cell = a * PAIR_BINS + b
                shape = (PAIR_BINS, PAIR_BINS)
                g = np.bincount(cell, y - p, PAIR_BINS**2).reshape(shape)
                step = self.rate * self._grid_tree(g, np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(shape))
                table += step
                score += step[a, b]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            out += table[bins[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[self._coarse(bins, i), self._coarse(bins, j)]
        return 1 / (1 + np.exp(-out))


def train_quality_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 8000
) -> AdditiveModel | None:
    """Fit on about most_rows labelled documents, chosen by a hash of the id. None without labels.

    Rows whose label or text is null are not learned from; of a repeated id every pairing counts.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    share = min(1.0, most_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("__id", F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.where(F.col(text_col).isNotNull()).join(known, docs[id_col] == F.col("__id"))
    found = featured(rows, F.col(text_col), F.col("__y")).toPandas().to_numpy(float)
    if not len(found):
        return None
    found = found[np.lexsort(found.T)]
    return AdditiveModel().fit(found[:, 1:], found[:, 0])


def quality_scores(docs: DataFrame, model: AdditiveModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier). Null counts as the empty text; rows one for one.

    Without a model every score is 0.5. Only the text is read.
    """
    schema = T.StructType([docs.schema[id_col]]).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], axis=1)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=schema.names)

    return featured(docs, F.col(text_col), F.col(id_col)).mapInArrow(run, schema)
