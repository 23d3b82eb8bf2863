"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins. Boosting goes round the features in
turn and adds one shallow tree on one feature's bins at a time, so the sum of a
feature's trees is a lookup table; the pairs that explain most of what is left
get two-dimensional tables in the same way. A score is a sum of table entries.

Defined cases: null or empty text has zero features and is scored like any other;
ties in a split take the lowest bin; repeated rows are scored row by row; an empty
table gives no rows; without labelled rows, or with one class, all scores are the
prior.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fold, mapped, steps, windows

#: The training sample: labelled rows at most, chosen by a hash of the id.
SAMPLE_ROWS = 12_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS = 32, 120, 0.15, 4, 8
THRESHOLD = 0.3

FEATURES = [
    "log_words", "word_length", "longest_word", "symbols", "capitals", "digits", "stops", "bangs", "bars", "other_marks",
    "distinct_words", "repeated_threes", "repeated_lines", "line_words", "non_ascii",
]

_CLASS = np.zeros((256, 8), np.int8)
for _k, _chars in enumerate([b"#*$%&<>@^~", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"\"'()[]{}=+/\\_-`"]):
    _CLASS[list(_chars), _k] = 1
_CLASS[128:, 7] = 1


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values in each segment."""
    out = np.zeros(len(bounds) - 1)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            out[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
    return out


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = [np.zeros((0, len(FEATURES)))]
    for a, b, raw, offsets in steps(texts):
        n, w = b - a, Words(raw, offsets)
        size = np.diff(offsets)
        words = np.diff(w.first)
        length = w.end - w.start
        per_word = np.maximum(words, 1)
        letters = np.maximum(_sums(length, w.first), 1)
        count = [_sums(_CLASS[:, k][raw], offsets) for k in range(8)]
        longest = np.zeros(n)
        full = words > 0
        if len(length):
            longest[full] = np.maximum.reduceat(length, w.first[:-1][full])
        h = w.hashes()
        threes = windows(h, 3)
        # Windows that lie within one text.
        bound = np.minimum(w.first, len(threes))
        own = np.stack([bound[:-1], np.maximum(bound[:-1], np.minimum(w.first[1:] - 2, len(threes)))], 1)
        n_threes = own[:, 1] - own[:, 0]
        d_threes = np.array([_distinct(threes, r)[0] for r in own]) if n else np.zeros(0)
        breaks = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))
        first_line = np.searchsorted(breaks, offsets)
        in_line = np.searchsorted(w.start, breaks)
        total = np.zeros(len(h) + 1, np.uint64)
        # A line's hash weighs its words by their place, so that equal lines have equal hashes wherever they stand.
        place = np.arange(len(h)) - np.repeat(in_line[:-1], np.diff(in_line)) if len(h) else np.zeros(0, np.int64)
        np.cumsum(h * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), out=total[1:])
        line = (total[in_line[1:]] - total[in_line[:-1]])[: len(breaks) - 1]
        has = np.diff(in_line) > 0
        kept = np.concatenate([[0], np.cumsum(has)])[first_line]
        lines = np.diff(kept)
        d_lines = _distinct(line[has], kept)
        out.append(
            np.stack(
                [
                    np.log1p(words), letters / per_word, np.minimum(longest, 1000), count[0] / per_word, count[1] / letters, count[2] / letters, count[3] / per_word, count[4] / per_word, count[5] / per_word, count[6] / per_word,
                    _distinct(h, w.first) / per_word, (n_threes - d_threes) / np.maximum(n_threes, 1), (lines - d_lines) / np.maximum(lines, 1), words / np.maximum(lines, 1), count[7] / np.maximum(size, 1),
                ],
                1,
            )
        )
    return np.concatenate(out)


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray]
    tables: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, c in enumerate(self.cuts):
            out += self.tables[j][np.searchsorted(c, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Points between quantiles, and so between distinct values."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="lower")) if len(x) else np.zeros(1)
    every = np.unique(x)
    return np.array([(v + every[np.searchsorted(every, v) - 1]) / 2 for v in values[1:]])


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels on ordered bins: each bin's step."""

    def split(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        left = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
        k = int(left.argmax())
        return float(left[k] - cg[-1] ** 2 / (ch[-1] + 1)), lo + k + 1

    edges = [0, len(g)]
    for _ in range(2):
        gains = [(*split(a, b), a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        edges = sorted({*edges, *(cut for gain, cut, _ in gains if gain > 1e-9)})
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes into four leaves: gain and each cell's step."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    tg, th = cg[-1, -1], ch[-1, -1]
    quads = lambda c, t: [c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], t - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1]]
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gain = sum(a**2 / (b + 1) for a, b in zip(quads(cg, tg), quads(ch, th), strict=True)) - tg**2 / (th + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    n, d = len(x), len(FEATURES)
    prior = float(np.clip((y.sum() + 1) / (n + 2), 1e-6, 1 - 1e-6)) if n else 0.5
    base = float(np.log(prior / (1 - prior)))
    cuts = [_cuts(x[:, j], BINS) if n else np.zeros(0) for j in range(d)]
    coarse = [_cuts(x[:, j], PAIR_BINS) if n else np.zeros(0) for j in range(d)]
    model = Gam(base, cuts, np.zeros((d, BINS + 1)), [], coarse, [])
    if n < 2 or len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(cuts[j], x[:, j], "right") for j in range(d)]
    margin = np.full(n, base)
    rest = lambda: (y - (p := 1 / (1 + np.exp(-margin))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(ROUNDS):
        for j in range(d):
            g, h = rest()
            bins = len(cuts[j]) + 1
            step = RATE * _tree(np.bincount(at[j], g, bins), np.bincount(at[j], h, bins))
            model.tables[j, :bins] += step
            margin += step[at[j]]
    at2 = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(d)]
    wide = [len(c) + 1 for c in coarse]
    cell = lambda i, j, v: np.bincount(at2[i] * wide[j] + at2[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])
    g, h = rest()
    gains = sorted(((-_tree2(cell(i, j, g), cell(i, j, h))[0], i, j) for i in range(d) for j in range(i + 1, d)))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(ROUNDS // 3):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = rest()
            step = RATE * _tree2(cell(i, j, g), cell(i, j, h))[1]
            table += step
            margin += step[at2[i], at2[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, usable=None) -> Gam:
    """Trains on a bounded sample of the labelled documents: at most SAMPLE_ROWS labels go to the workers and as many feature rows to the driver."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    n = rows.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    few = rows.where(chance < min(1.0, 0.95 * SAMPLE_ROWS / max(1, n))).select("doc_id", "quality").limit(SAMPLE_ROWS)
    picked = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    got = mapped(picked, run, "quality int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), float)
    order = np.lexsort([*x.T, y])  # the rows' order must not matter
    return train(x[order], y[order])


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Gam) -> DataFrame:
    """The documents, all columns as they are, that the model accepts."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(features(b.column(at))) >= THRESHOLD))

    return mapped(docs, run, docs.schema)


def op5_quality_gam(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
