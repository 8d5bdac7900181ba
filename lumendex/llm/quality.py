"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on binned features are boosted cyclically, one feature after the
other, and add up to one lookup table per feature; then the pairs of features that
still explain most get a two-dimensional table each, boosted the same way.  A text
is scored by adding the table entries of its bins, vectorised over the batch.

Learning reads a bounded sample of labelled rows (`Params.rows`, by hash).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, saved, ship, widened
from .kernels import SPACE, Words, buffers, chunks
from .langid import held_out

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "non_ascii", "newlines", "odd_word_ends",
    "bare_symbols", "repeats", "distinct", "top_word", "sentence_ends", "long_words", "capital_words", "line_words",
)


@dataclass
class Params:
    """Bounds and sizes of training."""

    #: Labelled rows that learning reads at most.
    rows: int = 20_000
    bins: int = 32
    rounds: int = 120
    pairs: int = 6
    pair_rounds: int = 60
    rate: float = 0.15
    ridge: float = 2.0
    leaf: int = 10


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)  # 0 letter, 1 upper, 2 digit, 3 symbol, 4 part of a non-ASCII character
    table[65:91] = 1
    table[48:58] = 2
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        table[a:b] = 3
    table[128:] = 4
    table[SPACE] = 5
    return table


_CLASS = _classes()
#: Marks that a word of ordinary prose ends with.
_PLAIN_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:?)\"'"])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature rows (texts x FEATURES) of consecutive texts in a UTF-8 buffer; an empty text has zeros."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    per = np.bincount(owner * 6 + kind, minlength=6 * n).reshape(n, 6).astype(float)
    lines = np.bincount(owner[data == 10], minlength=n).astype(float)
    per_byte, count = np.maximum(size, 1), np.maximum(words.count, 1).astype(float)

    def by_doc(mask: np.ndarray, docs: np.ndarray = words.doc) -> np.ndarray:
        return np.bincount(docs[mask], minlength=n).astype(float)

    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    head = data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    length = words.end - words.start
    letters = np.concatenate(([0], np.cumsum((kind != 3).astype(np.int64))))
    bare = letters[words.end] == letters[words.start]
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((words.hash, words.doc))
    h, d = words.hash[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.concatenate((np.flatnonzero(new), [len(h)]))) if len(h) else np.zeros(0, int)
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    distinct = np.bincount(d[new], minlength=n) if len(h) else np.zeros(n)
    return np.column_stack([
        np.log1p(size), np.log1p(words.count), np.bincount(words.doc, weights=length, minlength=n) / count, per[:, 1] / per_byte, per[:, 2] / per_byte,
        per[:, 3] / per_byte, per[:, 4] / per_byte, lines / per_byte, by_doc((_CLASS[last] == 3) & ~_PLAIN_ENDS[last]) / count,
        by_doc(bare) / count, by_doc(same) / count, distinct / count, top / count, by_doc(last == ord(".")) / count, by_doc(length > 12) / count,
        by_doc((_CLASS[head] == 1) & (length > 1)) / count, words.count / (lines + 1),
    ])


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Params) -> int:
    """Best cut of bins [0, i) and [i, ...), or 0 for none."""
    if len(g) < 2:
        return 0
    a, b, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = a**2 / (b + p.ridge) + (g.sum() - a) ** 2 / (h.sum() - b + p.ridge)
    gain[(c < p.leaf) | (n.sum() - c < p.leaf)] = -1
    i = int(gain.argmax())
    return i + 1 if gain[i] > g.sum() ** 2 / (h.sum() + p.ridge) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Params, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of a tree of at most `depth` levels."""
    i = _split(g, h, n, p) if depth else 0
    if not i:
        return np.full(len(g), g.sum() / (h.sum() + p.ridge))
    return np.concatenate([_tree(g[:i], h[:i], n[:i], p, depth - 1), _tree(g[i:], h[i:], n[i:], p, depth - 1)])


def _grid(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Best tree of one cut along rows and, on either side, one along columns; and its gain."""
    best, found = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + p.ridge)
    for i in range(1, len(g)):
        values, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, i), slice(i, None)):
            a, b, c = g[rows].sum(axis=0), h[rows].sum(axis=0), n[rows].sum(axis=0)
            j = _split(a, b, c, p)
            for cols in (slice(0, j), slice(j, None)) if j else (slice(None),):
                values[rows, cols] = a[cols].sum() / (b[cols].sum() + p.ridge)
                gain += a[cols].sum() ** 2 / (b[cols].sum() + p.ridge)
        if gain - whole > best:
            best, found = gain - whole, values
    return found, best


def fit(x: np.ndarray, y: np.ndarray, params: Params | None = None) -> Model:
    """Learn from feature rows and 0/1 labels; without rows every score is 0.5, with one class near that class."""
    p = params or Params()
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return Model([np.zeros(0)] * width, [np.zeros(1)] * width)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, p.bins + 1)[1:-1])) for k in range(width)]
    b = _binned(x, edges)
    sizes = [len(e) + 1 for e in edges]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, [np.zeros(s) for s in sizes], [], float(np.log(rate / (1 - rate))))
    f = np.full(len(y), model.bias)
    ones = [np.bincount(b[:, k], minlength=sizes[k]) for k in range(width)]

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    for _ in range(p.rounds):
        for k in range(width):
            g, h = slope()
            step = p.rate * _tree(np.bincount(b[:, k], g, sizes[k]), np.bincount(b[:, k], h, sizes[k]), ones[k], p)
            model.tables[k] += step
            f += step[b[:, k]]
    coarse = [np.minimum(b[:, k] * 8 // max(1, sizes[k]), 7) for k in range(width)]

    def cells(i: int, j: int, w: np.ndarray | None) -> np.ndarray:
        return np.bincount(coarse[i] * 8 + coarse[j], w, 64).reshape(8, 8)

    g, h = slope()
    ranked = sorted(((-_grid(cells(i, j, g), cells(i, j, h), cells(i, j, None), p)[1], i, j) for i in range(width) for j in range(i)))
    model.pairs = [(i, j, np.zeros((8, 8))) for gain, i, j in ranked[: p.pairs] if gain < 0]
    for _ in range(p.pair_rounds):
        for i, j, table in model.pairs:
            g, h = slope()
            step = p.rate * _grid(cells(i, j, g), cells(i, j, h), cells(i, j, None), p)[0]
            table += step
            f += step[coarse[i], coarse[j]]
    return model


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each feature row."""
    b = _binned(x, model.edges)
    total = np.full(len(x), model.bias)
    for k, table in enumerate(model.tables):
        total += table[b[:, k]]
    for i, j, table in model.pairs:
        a, c = (np.minimum(b[:, k] * 8 // max(1, len(model.tables[k])), 7) for k in (i, j))
        total += table[a, c]
    return 1 / (1 + np.exp(-total))


def text_features(column: pa.Array) -> np.ndarray:
    """Feature rows of a string column."""
    data, offs = buffers(column)
    found = [features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in chunks(offs)]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """Fit on labels (doc_id, quality) outside the held-out fold, joined to the texts of `docs`.

    Null labels are left out; a document with several labels counts once for each.
    """
    params = params or Params()
    ship(docs.sparkSession)
    rows = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = saved(rows.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "quality").limit(params.rows), "quality-sample")
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), flat], ["doc_id", "quality", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    got = joined.mapInArrow(lean(run), "doc_id long, quality int, x array<double>").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, width)), np.zeros(0), params)
    got = got.combine_chunks().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, width)
    return fit(x, np.array(got["quality"]).astype(float), params)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """`docs` with score and predicted.

    Only `text` is read, whole however long; other columns pass through whatever
    their names, but columns with the added names are replaced.  A null text scores
    as an empty one; repeated rows and equal texts score alike; an empty table gives
    no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    schema = widened(docs, "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(model, text_features(b.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(lean(run), schema)
