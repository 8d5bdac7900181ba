"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word's subwords are the word itself and its 2- to 4-grams of code points, with
end marks, hashed to `buckets`.  A text is the mean embedding of all its subwords;
a linear softmax over it gives the language.  Both are trained together by
stochastic gradient descent in numpy, on word windows of several lengths out of a
bounded, per-language sample of labelled rows.  Scores are calibrated by a
temperature, and a rejection threshold is set on rows that training did not see.

As the mean and the softmax's weights are linear, a trained model is one table of
logits per bucket, and a word's logits are summed once per distinct word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, lean, release, saved, ship, widened
from .kernels import U, mix

_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = (0x9E3779B97F4A7C15 | 3) & 0xFFFFFFFFFFFFFFFF
_NGRAMS = (2, 3, 4)
#: Distinct words a worker keeps the logits of.
CACHE = 100_000
#: Words that training hashes at a time: some 2 KB each meanwhile.
HASHED = 10_000


@dataclass
class Params:
    """Bounds and sizes of training."""

    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 6
    batch: int = 64
    #: Steps of descent at least; small samples are gone through more often.
    least_steps: int = 1500
    rate: float = 30.0
    #: Labelled rows per language that training reads at most.
    rows_per_language: int = 2000
    #: Lengths in words of the windows that training takes of each of these rows; prediction reads whole texts.
    windows: tuple[int, ...] = (3, 8, 20, 60)
    #: Part of held-back rows of known language that may be rejected.
    false_rejection: float = 0.001
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: logits, already divided by the temperature
    bias: np.ndarray
    threshold: float = 0.0
    stats: dict = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 when divided by 5 (null counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of the words, flattened, and the n+1 offsets of the words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.concatenate(([0], np.cumsum(size)))
    n = len(code)
    up, down = np.full(n + 1, _BASE, dtype=U), np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=U)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(mix(code.astype(U) + U(1)) * up[:n], out=total[1:])
    owner = np.repeat(np.arange(len(words)), size)
    end = first[1:][owner]
    at, own = [first[:-1]], [np.arange(len(words))]
    value = [mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]])]
    for k in _NGRAMS:
        s = np.flatnonzero(np.arange(n) + k <= end)
        at.append(s)
        own.append(owner[s])
        value.append(mix((total[s + k] - total[s]) * down[s] + U(k)))
    own_all = np.concatenate(own)
    order = np.argsort(own_all, kind="stable")
    hashed = (np.concatenate(value) % U(buckets)).astype(np.int64)[order]
    return hashed, np.concatenate(([0], np.cumsum(np.bincount(own_all, minlength=len(words)))))


def _subwords_lean(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """As `subwords`, of many words: in less memory, with buckets of 32 bits."""
    flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(words), HASHED):
        hashed, offs = subwords(words[a : a + HASHED], buckets)
        flat.append(hashed.astype(np.int32))
        size.append(np.diff(offs))
    return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(size))))


def windows_of(text: str, key: int, lengths: tuple[int, ...] = Params.windows) -> list[list[str]]:
    """Word windows of the text, at positions that `key` decides; a short text gives itself."""
    words = words_of(text)
    found, rng = [], np.random.default_rng(key)
    for k in lengths:
        if words and (len(words) > k or not found or k == lengths[-1]):
            a = int(rng.integers(0, max(1, len(words) - k + 1)))
            found.append(words[a : a + k])
    return found


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(pieces: list[list[str]], labels: list[str], test: np.ndarray, params: Params) -> Model:
    """Train on word lists with labels; rows where `test` is true only calibrate."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((params.buckets, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(x) for x in labels])
    known = {w: i for i, w in enumerate(dict.fromkeys(w for p in pieces for w in p))}
    flat, offs = _subwords_lean(list(known), params.buckets)  # of the distinct words only
    ids = [np.array([known[w] for w in p], np.int32) for p in pieces]
    del known
    each = np.diff(offs)

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the pieces' subwords, flattened, and their number in each piece."""
        words = np.concatenate([ids[r] for r in rows])
        n = each[words]
        at = np.repeat(offs[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return flat[at], np.add.reduceat(n, np.concatenate(([0], np.cumsum([len(ids[r]) for r in rows])[:-1])))

    rng = np.random.default_rng(params.seed)
    emb = rng.normal(0, 0.1, (params.buckets, params.dim)).astype(np.float32)
    out, bias = np.zeros((params.dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    train = np.flatnonzero(~test)
    per_epoch = len(train) // params.batch + 1
    epochs = max(params.epochs, -(-params.least_steps // per_epoch))
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), params.batch):
            rows = train[a : a + params.batch]
            rate = np.float32(params.rate * (1 - done / steps))
            done += 1
            idx, count = gather(rows)
            owner = np.repeat(np.arange(len(rows)), count)
            mean = np.add.reduceat(emb[idx], np.concatenate(([0], np.cumsum(count)[:-1])), axis=0) / count[:, None]
            g = _softmax(mean @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = (g @ out.T) / count[:, None]
            out -= rate * 0.1 * (mean.T @ g)
            bias -= rate * 0.1 * g.sum(axis=0)
            np.subtract.at(emb, idx, (rate * back.astype(np.float32))[owner])
    table = emb @ out
    held = np.flatnonzero(test)
    model = Model(languages, table, bias)
    if len(held):
        logits = np.stack([table[gather([r])[0]].mean(axis=0) for r in held]) + bias
        best = min(
            np.geomspace(0.05, 5, 40), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        )
        model.table, model.bias = (table / best).astype(np.float32), (bias / best).astype(np.float32)
        p = _softmax(logits / best)
        model.threshold = float(min(0.5, np.quantile(p.max(axis=1), params.false_rejection)))
        model.stats = {"held": len(held), "accuracy": float((p.argmax(axis=1) == y[held]).mean()), "temperature": float(best)}
    return model


def sample(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, lang of the training rows: at most rows_per_language of each language, those of the least hashes.

    A language's rows are dealt to salts that each keep their part of the bound.  A
    count of rows by language gives the hash below which that part lies almost surely
    (eight standard deviations), so that only some rows more than the bound are
    ranked, however many rows a language has.
    """
    salts = 16
    each = params.rows_per_language // salts
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", "lang").withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    counts = saved(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    share = F.lit(salts * (each + 8 * each**0.5 + 16)) / F.col("n")
    rows = rows.join(broadcast_if_small(counts), "lang").filter(F.col("h") / F.lit(2.0**64) + 0.5 < share)
    rows = rows.withColumn("s", F.pmod("h", F.lit(salts)))
    rank = F.row_number().over(Window.partitionBy("lang", "s").orderBy("h", "doc_id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= each).select("doc_id", "lang").distinct()


def train(docs: DataFrame, params: Params | None = None) -> Model:
    """Fit on labelled rows of `docs` (doc_id, text, lang) outside the held-out fold."""
    params = params or Params()
    ship(docs.sparkSession)
    chosen = saved(sample(docs, params), "lang-sample")  # languages x rows_per_language ids at most
    cols = docs.select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, keys, pieces = [], [], [], []
            for d, lang, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                key = zlib.crc32(str(d).encode())
                for p in windows_of(text, key, params.windows):
                    ids.append(d)
                    langs.append(lang)
                    keys.append(key)
                    pieces.append(" ".join(p))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(pieces, pa.string())], ["lang", "key", "piece"])

    got = cols.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").mapInArrow(lean(cut), "lang string, key long, piece string").toArrow()
    rows = sorted(zip(got["key"].to_pylist(), got["lang"].to_pylist(), got["piece"].to_pylist(), strict=True))
    rows = [r for r in rows if r[2]]
    del got
    same: dict[str, str] = {}  # equal words are one object
    pieces = [[same.setdefault(w, w) for w in r[2].split(" ")] for r in rows]
    labels, test = [r[1] for r in rows], np.array([r[0] // 5 % 8 == 0 for r in rows], dtype=bool)
    del rows, same
    release()
    model = fit(pieces, labels, test, params)
    del pieces
    release()  # the driver's Python lives on
    return model


class Scorer:
    """Language and probability of texts; keeps the logits of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows, self.counts = np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
            self.rows, self.counts = self.rows[:0], self.counts[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            flat, offs = subwords(new, len(self.model.table))
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.model.table[flat], offs[:-1], axis=0)])
            self.counts = np.concatenate([self.counts, np.diff(offs).astype(np.float32)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return langs, scores
        lists = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        full = [i for i, w in enumerate(lists) if w]
        if not full:
            return langs, scores
        missing = [w for i in full for w in lists[i] if w not in self.known]
        if len(self.known) + len(missing) > CACHE:
            missing = [w for i in full for w in lists[i]]
        self._learn(missing)
        look = self.known.__getitem__
        idx = np.array([look(w) for i in full for w in lists[i]])
        start = np.concatenate(([0], np.cumsum([len(lists[i]) for i in full])[:-1]))
        logits = np.add.reduceat(self.rows[idx], start, axis=0) / np.add.reduceat(self.counts[idx], start)[:, None] + self.model.bias
        p = _softmax(logits.astype(np.float64))
        best = p.argmax(axis=1)
        for i, k, s in zip(full, best, p.max(axis=1), strict=True):
            langs[i], scores[i] = self.model.languages[k], float(s)
        return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, lang_score and rejected.

    Only `text` is read, whole however long; other columns pass through whatever
    their names, but columns with the added names are replaced.  A text that is null,
    empty or without a letter is `und` with score 0 and rejected; a model without
    languages calls every text so.  Of equally likely languages the first by code
    point counts; repeated rows get equal results; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "rejected")
    at = docs.columns.index("text")
    schema = widened(docs, "lang_pred string, lang_score double, rejected boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                langs, scores = score(b.column(at).to_pylist())
                gone = [x == "und" or s < model.threshold for x, s in zip(langs, scores, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())],
                    [*b.schema.names, "lang_pred", "lang_score", "rejected"],
                )

    return docs.mapInArrow(lean(run), schema)
