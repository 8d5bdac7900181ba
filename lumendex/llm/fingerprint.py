"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into paragraphs at line ends, and long paragraphs further after words
whose hash says so, so that an edit changes the pieces it touches and no others.
Each piece's 64-bit digest (with the count of equal pieces before it) goes into
three cells of a sketch; a cell holds a count and the sums of digests and of their
check values.  Sketches subtract cell by cell: what two texts share vanishes, and
peeling cells with one digest left recovers the digests that differ.  If peeling
gets stuck, both sketches are made anew with twice the cells, until it succeeds.

A sketch has a power of two of cells, and folds to any smaller power by adding
halves, so that texts of different lengths compare.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, ship
from .kernels import CHUNK, U, Words, mix

#: A long paragraph is cut after one in so many words.
PIECE = 8
CELLS = 3
LEAST = 16
#: Rows worked on together.
GROUP = 1000
#: Parts of the order by doc_id at most, in two levels of 64.
_LEVEL = 64


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the pieces of UTF-8 texts, flattened, and the n+1 offsets of the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    w = Words(data, offs)
    n = len(w.hash)
    if not n:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    cut = w.hash % U(PIECE) == 0
    cut[:-1] |= (w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]])
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(n) - np.repeat(first, last - first + 1)
    digest = mix(np.add.reduceat(mix(w.hash + U(0x9E3779B97F4A7C15) * place.astype(U)), first) + (last - first).astype(U))
    doc = w.doc[first]
    order = np.lexsort((digest, doc))
    d, o = digest[order], doc[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])))
    nth = np.arange(len(d)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    d = np.where(nth > 0, mix(d + nth.astype(U)), d)
    return d, np.searchsorted(o, np.arange(len(texts) + 1))


def _check(x: np.ndarray) -> np.ndarray:
    return mix(x ^ U(0xA5A5A5A55A5A5A5A))


class Sketches:
    """Sketches side by side: sizes[i] cells each, all cells in flat arrays."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        total = int(self.first[-1])
        self.count, self.key, self.check = np.zeros(total, np.int64), np.zeros(total, U), np.zeros(total, U)

    def add(self, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> None:
        """Put digests into their owners' cells, with sign 1, or take them out, with -1."""
        wrap = sign.astype(np.int64).view(U)
        for k in range(CELLS):
            at = self.first[owner] + (mix(digests + U(k + 1) * U(0xC2B2AE3D27D4EB4F)) & (self.sizes[owner] - 1).astype(U)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, digests * wrap)
            np.add.at(self.check, at, _check(digests) * wrap)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests found in each sketch, and whether nothing is left in it."""
        found = np.zeros(len(self.sizes), np.int64)
        owner_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            wrap = sign.view(U)
            value = self.key[look] * wrap
            pure = (np.abs(sign) == 1) & (self.check[look] * wrap == _check(value))
            look, sign, value = look[pure], sign[pure], value[pure]
            owner = owner_of[look]
            order = np.lexsort((value, owner))
            owner, value, sign = owner[order], value[order], sign[order]
            once = np.ones(len(owner), bool)
            once[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
            owner, value, sign = owner[once], value[once], sign[once]
            if not len(owner):
                break
            self.add(owner, value, -sign)
            found += np.bincount(owner, minlength=len(found))
            look = np.flatnonzero(np.abs(self.count) == 1)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return found, np.bincount(owner_of[left], minlength=len(found)) == 0


def _power(x: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(x, LEAST))).astype(np.int64)


def sizes_of(counts: np.ndarray) -> np.ndarray:
    """Cells of the fingerprint of a text of so many pieces."""
    return _power(counts / 2)


Items = tuple[np.ndarray, np.ndarray]


def difference(a: Items, rows_a: np.ndarray, b: Items, rows_b: np.ndarray) -> np.ndarray:
    """How many digests differ between texts rows_a[i] of `a` and rows_b[i] of `b`, by subtraction and peeling."""
    out = np.zeros(len(rows_a), np.int64)
    n_a, n_b = np.diff(a[1])[rows_a], np.diff(b[1])[rows_b]
    sizes = np.maximum(np.maximum(sizes_of(n_a), sizes_of(n_b)), _power(np.abs(n_a - n_b) * 1.5))
    todo = np.arange(len(rows_a))

    def taken(items: Items, rows: np.ndarray) -> Items:
        n = np.diff(items[1])[rows]
        at = np.repeat(items[1][rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return items[0][at.astype(np.int64)], np.repeat(np.arange(len(rows)), n)

    while len(todo):
        table = Sketches(sizes[todo])
        for items, rows, sign in ((a, rows_a[todo], 1), (b, rows_b[todo], -1)):
            digests, owner = taken(items, rows)
            table.add(owner, digests, np.full(len(owner), sign, np.int64))
        found, done = table.peel()
        out[todo[done]] = found[done]
        todo = todo[~done]
        sizes[todo] *= 2
    return out


def likeness(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Shared pieces by all pieces of two texts; 1 for two texts without any."""
    common = (n_a + n_b - differ) / 2
    return np.where(n_a + n_b > 0, common / np.maximum(n_a + n_b - common, 1), 1.0)


def strings(items: Items) -> list[str]:
    """Each text's fingerprint: its number of cells, and their counts, digest sums and check sums in base 64."""
    n = np.diff(items[1])
    table = Sketches(sizes_of(n))
    owner = np.repeat(np.arange(len(n)), n)
    table.add(owner, items[0], np.ones(len(owner), np.int64))
    cells = np.zeros(len(table.count), dtype=[("n", "<i4"), ("key", "<u8"), ("check", "<u8")])
    cells["n"], cells["key"], cells["check"] = table.count, table.key, table.check
    raw = cells.tobytes()
    width = cells.itemsize
    return [f"{m}:" + base64.b64encode(raw[a * width : (a + m) * width]).decode() for m, a in zip(table.sizes.tolist(), table.first.tolist(), strict=False)]


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def compare(rows: list[tuple[int | None, str]], following: str) -> list[list]:
    """Result columns of consecutive rows, the last of which `following` comes after."""
    texts = [t for _, t in rows] + [following]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    new = [edited(t, n).encode("utf-8", "surrogatepass") for t, n in zip(texts, texts[1:], strict=False)]
    own, changed = pieces(raw), pieces(new)
    at = np.arange(len(rows))
    n_own, n_new = np.diff(own[1]), np.diff(changed[1])
    near_edited = likeness(n_own[:-1], n_new, difference(own, at, changed, at))
    near_next = likeness(n_own[:-1], n_own[1:], difference(own, at, own, at + 1))
    return [
        [d for d, _ in rows], [len(t) for _, t in rows], [hashlib.sha256(x).hexdigest() for x in new],
        strings(own)[:-1], strings(changed), near_edited.tolist(), near_next.tolist(),
    ]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edit with the next text by doc_id, and their likenesses.

    doc_id and text are read.  Null texts count as empty; null ids come first;
    rows of equal id are ordered by text; the last row is followed by the first.
    A very long text is sketched whole; columns other than doc_id and text, whatever
    their names, are not read.  An empty table gives no rows.

    Rows are dealt to ranges of doc_id and sorted there; the first row of a range
    is sent to the range before too, so texts are shuffled once and no task sees
    more than its range, row after row.
    """
    spark = docs.sparkSession
    ship(spark)
    least = -(1 << 63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(_LEVEL * _LEVEL, 4 * tasks))
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    coarse = [cuts[i : i + _LEVEL] for i in range(0, len(cuts), _LEVEL)]

    def longs(values: list[int]):
        return F.array(*[F.lit(v).cast("long") for v in values])

    if coarse:
        upper = F.greatest(F.size(F.filter(longs([c[0] for c in coarse]), lambda c: c <= F.col("k"))), F.lit(1)) - 1
        inner = F.element_at(F.array(*[longs(c) for c in coarse]), upper + 1)
        part = upper * _LEVEL + F.size(F.filter(inner, lambda c: c <= F.col("k")))
    else:
        part = F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    heads = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min("k")).collect())  # a row a range
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    sent = rows.filter(F.col("k").isin([k for _, k in heads]))
    if heads:
        to = F.map_from_arrays(longs(list(before)), F.array(*[F.lit(p) for p in before.values()]))
        sent = sent.withColumn("part", F.element_at(to, F.col("k")))
    both = rows.withColumn("last", F.lit(False)).unionByName(sent.withColumn("last", F.lit(True)))
    both = both.repartition(tasks, "part").sortWithinPartitions("part", "last", "k", "text").select("doc_id", "text", "last")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []
        size = 0

        def result(following: str) -> pa.RecordBatch:
            columns = compare(waiting, following)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for d, text, last in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if waiting and (last or size > CHUNK or len(waiting) >= GROUP):
                    yield result(text)
                    size = 0
                if not last:
                    waiting.append((d, text))
                    size += len(text)

    return both.mapInArrow(lean(run), _SCHEMA)
