"""Secret scanning: fixed patterns, and a character network over every candidate and its context.

The base patterns (`assign`, `access`, `hex`) always hold.  Beside them every token
that mixes kinds of characters is a candidate, as far as no base span covers it: a
small convolutional network in numpy reads its characters and those around it, and
candidates that score at or above a threshold are added as kind `cnn`.  The network
learns from labelled findings: candidates that base patterns meet, in a bounded,
seeded sample of the table, and generated secrets and look-alikes of known label.
Its scores are calibrated (Platt) on half of the rows that training did not see;
the threshold is the highest that finds `Params.recall` of the secrets in the other half.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, ship, widened

# The base patterns, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate: a token of LEAST characters or more with a digit and a letter, or with a capital letter somewhere behind a small one.
LEAST = 12
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LEAST},}}", re.A)
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])|[^a-z]*[a-z][^A-Z]*[A-Z]", re.A)
#: The name in front of a value, which is no part of the secret.
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*=(?!=)", re.A)
CONTEXT = 24
SEGMENT = 64

Span = tuple[int, int, int]  # start, kind, end


@dataclass
class Params:
    """Bounds and sizes of training."""

    #: Candidates of the table that training reads at most.
    rows: int = 2000
    #: Characters of a table candidate that training reads at most; longer ones are scanned all the same.
    longest: int = 4096
    generated: int = 3000
    dim: int = 8
    filters: int = 24
    width: int = 5
    epochs: int = 8
    batch: int = 32
    rate: float = 0.1
    recall: float = 0.98
    seed: int = 11


@dataclass
class Model:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns: leftmost, not overlapping within a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[Span] = ()) -> list[tuple[int, int]]:
    """Every token that may be a secret, without a name and an equals sign before it or a full stop behind it, and only what lies outside `spans`."""
    found = []
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        name = _NAME.match(text, start, end)
        start = name.end() if name else start
        while end > start and text[end - 1] == ".":
            end -= 1
        for s, _, e in sorted(x for x in spans if x[0] < end and start < x[2]):
            found.append((start, s))
            start = max(start, e)
        found.append((start, end))
    return [(s, e) for s, e in found if e - s >= LEAST and _MIXED.match(text, s, e)]


def _codes() -> np.ndarray:
    table = np.full(128, 1, np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-\"':; \n@,<>()[]{}#&?!%$*|~"):
        table[ord(c)] = i + 2
    return table


_CODE = _codes()
_SYMBOLS = int(_CODE.max()) + 1


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Segments (n x length) of codes for a candidate: each with the context of its first and last character.

    A long candidate gives several overlapping segments, so that all of it is read;
    codes inside the candidate are shifted to a second alphabet.
    """
    left, right = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    raw = np.frombuffer(text[left:right].encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(raw < 128, _CODE[np.minimum(raw, 127)], 1)
    code[start - left : end - left] += _SYMBOLS
    code = np.concatenate([np.zeros(CONTEXT - (start - left), np.int64), code, np.zeros(CONTEXT - (right - end), np.int64)])
    width = SEGMENT + 2 * CONTEXT
    count = max(1, -(-(len(code) - width) // SEGMENT) + 1)
    code = np.concatenate([code, np.zeros((count - 1) * SEGMENT + width - len(code), np.int64)])
    return np.lib.stride_tricks.sliding_window_view(code, width)[::SEGMENT]


def _pooled(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Max-pooled filter outputs of segments, where the maximum lies, and the unfolded input."""
    x = model.embed[codes]
    wide = np.lib.stride_tricks.sliding_window_view(x, model.conv.shape[0] // x.shape[2], axis=1)
    wide = wide.transpose(0, 1, 3, 2).reshape(len(x), wide.shape[1], -1)
    out = np.maximum(wide @ model.conv + model.conv_bias, 0)
    at = out.argmax(axis=1)
    return np.take_along_axis(out, at[:, None], axis=1)[:, 0], at, wide


def logits(model: Model, items: list[np.ndarray]) -> np.ndarray:
    """One logit per candidate: filters are pooled over all its segments."""
    if not items:
        return np.zeros(0)
    codes = np.concatenate(items)
    pooled = np.concatenate([_pooled(model, codes[a : a + 512])[0] for a in range(0, len(codes), 512)])
    first = np.concatenate(([0], np.cumsum([len(x) for x in items])[:-1]))
    return np.maximum.reduceat(pooled, first, axis=0) @ model.dense + model.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def probability(model: Model, items: list[np.ndarray]) -> np.ndarray:
    """Calibrated score of each candidate."""
    return _sigmoid(model.scale[0] * logits(model, items) + model.scale[1])


def generated(count: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label) of known kinds of secrets and of look-alikes."""
    rng = np.random.default_rng(seed)

    def pick(alphabet: str, n: int) -> str:
        return "".join(np.array(list(alphabet))[rng.integers(0, len(alphabet), n)])

    digit, small, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    alnum = small + small.upper() + digit

    def words(n: int) -> str:
        return " ".join(pick("etaoinshrdlu", int(k)) for k in rng.integers(2, 9, n))

    found = []
    for k in range(count):
        n = int(rng.integers(20, 64))
        if k % 2:
            kind = k // 2 % 8
            body = (pick(alnum, int(rng.integers(13, 19))) + pick(digit, 1), pick(small, 3) + pick(small + small.upper(), n) + pick(small.upper(), 1), pick(hexa, 40), pick(alnum, n), "ghp_" + pick(alnum, 36), pick(alnum + "+/", 40), "eyJ" + pick(alnum, 20) + "." + pick(alnum + "_-", n), "sk_live_" + pick(alnum, 24))[kind]
            lead = ('token = "', "Authorization: Bearer ", "key=", 'secret: "', "client_secret=", "credentials ")[int(rng.integers(0, 6))]
        else:
            kind = k // 2 % 9
            body = (
                "".join(w.capitalize() for w in words(3).split()) + "Name",
                words(1) + "." + words(1).capitalize() + words(1).capitalize() + "." + words(1) + "Of",
                words(1) + "." + pick(digit, 2) + "@mail" + pick(digit, 1) + ".example.com",
                pick("etaoinshrdlu", n // 2 + 8) + pick(digit, 1),
                words(3).replace(" ", "-") + "-" + pick(digit, 4) + "-page",
                "20" + pick(digit, 2) + "-01-0" + pick("123", 1) + "T" + pick(digit, 2) + "." + pick(digit, 6) + "Z",
                "/usr/lib/" + words(2).replace(" ", "/") + "/v" + pick(digit, 1) + "." + pick(digit, 2),
                "version-" + pick(digit, 1) + "." + pick(digit, 2) + ".0-" + words(1) + "-release",
                words(1) + "_" + words(1) + "_" + words(1) + "_" + pick(digit, 3) + "_id",
            )[kind]
            lead = ""
        before = words(int(rng.integers(0, 6))) + " " + lead
        found.append((before + body + ('" ' if lead.endswith('"') else " ") + words(int(rng.integers(0, 6))), len(before), len(before) + len(body), k % 2))
    return [x for x in found if x[2] - x[1] >= LEAST]


def fit(items: list[np.ndarray], y: np.ndarray, test: np.ndarray, params: Params) -> Model:
    """Train by stochastic gradient descent; of the rows where `test` is true every other one calibrates, and the rest set the threshold."""
    p, rng = params, np.random.default_rng(params.seed)
    model = Model(
        rng.normal(0, 0.3, (2 * _SYMBOLS, p.dim)).astype(np.float32),
        rng.normal(0, 0.15, (p.width * p.dim, p.filters)).astype(np.float32),
        np.zeros(p.filters, np.float32), rng.normal(0, 0.3, p.filters).astype(np.float32), 0.0,
    )
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(items) else np.zeros(0, int)
    codes = np.concatenate(items) if items else np.zeros((0, 1), np.int64)
    train = np.flatnonzero(~test)
    if not len(train) or len(set(y[train])) < 2:
        return model
    for epoch in range(p.epochs):
        rng.shuffle(train)
        for a in range(0, len(train), p.batch):
            rows = first[train[a : a + p.batch]]  # a segment each: long candidates are alike all along
            c, t = codes[rows], y[train[a : a + p.batch]]
            pooled, at, wide = _pooled(model, c)
            rate = p.rate * (1 - epoch / p.epochs)
            g = ((_sigmoid(pooled @ model.dense + model.bias) - t) / len(rows)).astype(np.float32)
            back = np.where(pooled > 0, g[:, None] * model.dense, 0)
            model.dense -= rate * 2 * (pooled.T @ g)
            model.bias -= float(rate * 2 * g.sum())
            picked = np.take_along_axis(wide, at[:, :, None], axis=1)  # rows x filters x (width * dim)
            grad_in = back[:, :, None] * model.conv.T[None]
            model.conv -= rate * 5 * np.einsum("rf,rfk->kf", back, picked)
            model.conv_bias -= rate * 5 * back.sum(axis=0)
            where = at[:, :, None] + np.arange(p.width)
            symbol = c[np.arange(len(rows))[:, None, None], where]
            np.subtract.at(model.embed, symbol, (rate * 10 * grad_in.reshape(len(rows), p.filters, p.width, p.dim)).astype(np.float32))
    held, judged = np.flatnonzero(test)[::2], np.flatnonzero(test)[1::2]
    if len(held) and len(set(y[held])) == 2 and y[judged].any():
        z, t = logits(model, [items[i] for i in held]), y[held]
        s, b = 1.0, 0.0
        for _ in range(300):  # Platt scaling by gradient descent
            d = _sigmoid(s * z + b) - t
            s, b = s - 0.05 * float((d * z).mean() + 1e-3 * s), b - 0.2 * float(d.mean())
        model.scale = (max(s, 1e-3), b)
        q = np.sort(probability(model, [items[i] for i in judged if y[i]]))
        model.threshold = float(q[int((1 - p.recall) * len(q))])
    return model


def train(docs: DataFrame, params: Params | None = None) -> Model:
    """Fit on a bounded sample of the candidates that base patterns meet in all texts, and on generated findings and look-alikes.

    A candidate that no base pattern meets may be a secret or none, so it is not a
    label; repeated candidates count once, and null and empty texts have none.
    """
    params = params or Params()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                spans = [(s, e) for s, _, e in base_spans(text)]
                for s, e in candidates(text):
                    if not any(x < e and s < z for x, z in spans):
                        continue
                    around = text[max(0, s - CONTEXT) : e + CONTEXT]
                    key = hashlib.md5(around.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, around, s - max(0, s - CONTEXT), e - s))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "around", "start", "size"])

    schema = "key string, around string, start int, size int"
    found = docs.select("text").mapInArrow(lean(run), schema).filter(F.col("size") <= params.longest)
    rank = found.dropDuplicates(["key"])
    rows = [tuple(r) for r in rank.orderBy("key").limit(params.rows).select("around", "start", "size").collect()]
    labelled = [(t, s, s + n, 1) for t, s, n in rows] + generated(params.generated, params.seed)
    items = [encode(t, s, e) for t, s, e, _ in labelled]
    test = np.array([zlib.crc32(t[s:e].encode("utf-8", "surrogatepass")) % 4 == 0 for t, s, e, _ in labelled], bool)
    return fit(items, np.array([y for *_, y in labelled], float), test, params)


def spans_of(texts: list[str | None], model: Model | None) -> list[list[Span]]:
    """All spans of each text, by start and kind; a null text has none."""
    found, asked, items = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text) if text else []
        found.append(spans)
        if text and model is not None:
            for s, e in candidates(text, spans):
                asked.append((i, s, e))
                items.append(encode(text, s, e))
    if asked:
        for (i, s, e), q in zip(asked, probability(model, items), strict=True):
            if q >= model.threshold:
                found[i].append((s, 3, e))
        for i in {i for i, *_ in asked}:
            found[i].sort()
    return found


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) replaced."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with spans (array of kind, start, end; code points, end exclusive) and redacted (the text without secrets).

    Only `text` is read; other columns pass through whatever their names, but
    columns with the added names are replaced.  A null text has no spans and stays
    null, an empty one stays empty; very long texts and candidates are read whole;
    repeated rows get equal results, spans that start together stand in order of
    kind, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("spans", "redacted")
    at = docs.columns.index("text")
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(a, 512)
                texts = b.column(at).to_pylist()
                found = spans_of(texts, model)
                cells = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]
                clean = [t if t is None else redact(t, x) for t, x in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cells, pa.list_(span)), pa.array(clean, pa.string())], [*b.schema.names, "spans", "redacted"]
                )

    return docs.mapInArrow(lean(run), widened(docs, "spans array<struct<kind:string,start:int,end:int>>, redacted string"))
