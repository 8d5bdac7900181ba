"""MinHash near-duplicate detection, exact in its confirmed links.

1. Each text's set of word shingles is hashed; texts of equal sets are one class,
   represented by its least doc_id.
2. One-permutation MinHash with optimal densification gives each class a
   signature, cut into bands; classes with an equal band share a bucket.
3. In each bucket the least class is a centre, and the others are candidates of it:
   a star, so a bucket of n gives n - 1 pairs.  Pairs whose set sizes cannot reach
   the similarity go; the others are confirmed on the full sets.
4. Connected classes are found by label propagation with pointer jumping.
5. The centre has been compared with all of its bucket by then.  If the others are
   not all in one component, a link between two of them may be left, so they are
   compared block by block: each task gets two bounded blocks, counts
   common shingles by matrix products, and returns a forest of the links it finds
   between components.  The components are then joined.

No pair outside the stars is ever a row.  With 32 bands of 4 bins, two classes at
similarity 0.75 share no bucket with probability 5e-6, and less above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..runtime import broadcast_if_small, lean, saved, ship, unused
from .kernels import U, Words, bands, buffers, chunks, mix, one_permutation, shingles

_SET = ["s1", "s2", "n"]


@dataclass(frozen=True)
class Params:
    """Shingle length, similarity, and sizes of signatures and blocks."""

    words: int = 5
    percent: int = 75
    bins: int = 128
    rows: int = 4
    #: Shingles that a block holds about, over all its sets.
    block: int = 400_000
    #: Classes that a block holds about.
    members: int = 512


def _sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offs = buffers(column)
    for a, b in chunks(offs):
        yield shingles(Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), k)


def _by_set(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums and the size of each set."""
    n = np.diff(offsets)
    out = []
    for salt in (U(1), U(0x9E3779B97F4A7C15)):
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(hashes ^ salt))))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1], n.astype(np.int64)


def signatures(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, s1, s2, n of every text, and its bands (empty for a text without words)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for h, o in _sets(b.column(1), params.words):
                n = len(o) - 1
                s1, s2, size = _by_set(h, o)
                keys = bands(one_permutation(h, o, params.bins), params.rows).view(np.int64)
                keys = keys[size > 0]
                ends = np.concatenate(([0], np.cumsum(np.where(size > 0, keys.shape[1], 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(s1), pa.array(s2), pa.array(size), lists], ["doc_id", *_SET, "bands"])
                at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, s1 long, s2 long, n long, bands array<long>")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _common(x: np.ndarray, ends_x: np.ndarray, y: np.ndarray, ends_y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets x with all sets y, by products of incidence matrices in slabs."""
    keys = np.intersect1d(x, y)
    out = np.zeros((len(ends_x) - 1, len(ends_y) - 1), np.float32)
    own_x, own_y = np.repeat(np.arange(len(ends_x) - 1), np.diff(ends_x)), np.repeat(np.arange(len(ends_y) - 1), np.diff(ends_y))
    at_x, at_y = np.searchsorted(keys, x), np.searchsorted(keys, y)
    in_x = (at_x < len(keys)) & (keys[np.minimum(at_x, max(0, len(keys) - 1))] == x) if len(keys) else np.zeros(len(x), bool)
    in_y = (at_y < len(keys)) & (keys[np.minimum(at_y, max(0, len(keys) - 1))] == y) if len(keys) else np.zeros(len(y), bool)
    slab = 4096
    for a in range(0, len(keys), slab):
        width = min(slab, len(keys) - a)
        m_x, m_y = np.zeros((len(out), width), np.float32), np.zeros((out.shape[1], width), np.float32)
        k = in_x & (at_x >= a) & (at_x < a + width)
        m_x[own_x[k], at_x[k] - a] = 1
        k = in_y & (at_y >= a) & (at_y < a + width)
        m_y[own_y[k], at_y[k] - a] = 1
        out += m_x @ m_y.T
    return out


def forest(ids: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components among sets of two blocks (side 0 and 1; or of one block, all 0): as many as join what is linked."""
    parent = {int(x): int(x) for x in label}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    if not len(left):
        return []
    size = np.array([len(s) for s in sets], np.int64)
    flat = [np.concatenate([sets[i] for i in part]) for part in (left, right)]
    ends = [np.concatenate(([0], np.cumsum(size[part]))) for part in (left, right)]
    both = _common(flat[0], ends[0], flat[1], ends[1]).astype(np.int64)
    union = size[left][:, None] + size[right][None] - both
    rows, cols = np.nonzero((100 * both >= percent * union) & (label[left][:, None] != label[right][None]))
    found = []
    for i, j in zip(left[rows], right[cols], strict=True):
        p, q = root(int(label[i])), root(int(label[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((int(ids[i]), int(ids[j])))
    return found


def _confirm(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar enough."""
    k, percent = params.words, params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                a_sets = [h[o[i] : o[i + 1]] for h, o in _sets(b.column(2), k) for i in range(len(o) - 1)]
                b_sets = [h[o[i] : o[i + 1]] for h, o in _sets(b.column(3), k) for i in range(len(o) - 1)]
                keep = []
                for x, y in zip(a_sets, b_sets, strict=True):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def _rest(members: DataFrame, labels: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Links (a, b) between components inside buckets (bucket, id, n; without centres) that hold more than one component."""
    k, percent = params.words, params.percent
    known = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = saved(known, "dup-known")
    open_ = known.groupBy("bucket").agg(F.count_distinct("label").alias("c"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("m")).filter("c > 1")
    blocks = F.greatest(F.ceil(F.col("all") / params.block), F.ceil(F.col("m") / params.members)).cast("int")
    placed = known.join(open_.select("bucket", blocks.alias("nb")), "bucket").withColumn("own", F.pmod(F.xxhash64("id", "bucket"), F.col("nb")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "label",
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )

    def run(table: pa.Table) -> pa.Table:
        if table["lo"][0].as_py() < table["hi"][0].as_py() and len(set(table["side"].to_pylist())) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})  # one block got no member; the other is compared with itself elsewhere
        sets = [h[o[i] : o[i + 1]] for h, o in _sets(table["text"].combine_chunks(), k) for i in range(len(o) - 1)]
        found = forest(table["id"].to_numpy(), table["label"].to_numpy(), table["side"].to_numpy(), sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    full = dealt.join(texts.select("id", "text"), "id").select("bucket", "lo", "hi", "id", "label", "side", "text")
    return full.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    Null and wordless texts have no shingles and are alone; rows of equal doc_id
    are one vertex if their sets are equal (ids are expected to be unique: of rows
    with equal id and different texts each stands for the id); null ids are left
    out of all classes and their own component (null).  Of equal sets the least id
    stands; a very long text's set is whole; columns other than doc_id and text,
    whatever their names, are not read.  An empty table gives no rows.
    """
    params = params or Params()
    rows = saved(signatures(docs, params), "dup-rows")
    some = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = saved(some.groupBy(*_SET).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "dup-classes")
    heads = some.join(classes.select(F.col("id").alias("doc_id"), *_SET), ["doc_id", *_SET], "left_semi")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = heads.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key")).repartition(parts, "key")  # one shuffle for the counts and the join
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("centre"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("same"))
    members = cells.join(shared.filter("m > 1"), "key")
    # buckets of the same classes are one: by their number, least id and sum of hashes
    members = members.select(F.xxhash64("m", "centre", "same").alias("bucket"), "centre", "id", "n").distinct()
    members = saved(members, "dup-members")
    size = classes.select(F.col("id").alias("centre"), F.col("n").alias("nc"))
    stars = members.filter("id <> centre").select("centre", "id", "n").distinct().join(size, "centre").filter(_fits(F.col("n"), F.col("nc"), params.percent))
    stars = saved(stars.select(F.col("centre").alias("a"), F.col("id").alias("b")), "dup-stars")
    wanted = members.select("id").distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = source.join(broadcast_if_small(saved(wanted, "dup-wanted"), 1_000_000), "id", "left_semi")
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])
    texts = saved(texts, "dup-texts")
    links = saved(_confirm(stars, texts, params), "dup-links")
    labels = components(links)
    more = saved(_rest(members.filter("id <> centre").select("bucket", "id", "n"), labels, texts, params), "dup-more")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    component = F.coalesce("label", "id")
    of_set = classes.join(labels, "id", "left").select(*[F.col(c).alias(f"_{c}") for c in _SET], component.alias("component"))
    same = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n"))
    alone = rows.filter((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component"))
    out = some.join(of_set, same).select("doc_id", "n", "component").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """Those rows of `docs` that stand for their component; all columns stay.

    Rows that share both doc_id and text count as one, and one of them stays; rows
    without a doc_id all stay.  Other columns pass through whatever their names.
    """
    out, pair = unused(docs.columns, "gone", "twice")
    found = saved(near_duplicates(docs.select("doc_id", "text"), params), "dup-result")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias(out)).distinct()
    twice = saved(found.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(pair)).count().filter("count > 1").select(pair), "dup-twice")
    gone = broadcast_if_small(saved(gone, "dup-gone"), 1_000_000)
    rest = docs.join(gone, F.col("doc_id") == F.col(out), "left_anti")
    if not twice.limit(1).count():
        return rest
    single = rest.join(twice, F.col("doc_id") == F.col(pair), "left_anti")
    repeated = rest.join(twice, F.col("doc_id") == F.col(pair), "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)
