"""The five stages of duplicate resolution.

1. Equal content (sha256): certain.
2. Equal capture date and camera, validated by hashes: high if validated, else
   near-certain.
3. Perceptual similarity by both hashes, without bursts, greedily in id order.
4. Overlapping groups merge where what is not shared is alike.
5. Photos without a hash join the first group that has their capture date and camera.

Stages 1, 2 and 5 are aggregations and equi-joins; the similarity joins run on
distinct hashes through block keys.  Stages 3 and 4 depend on order only inside a
connected component, and run there on collapsed inputs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import exif_key, exif_seconds, sequential_seconds
from ..functions.hashing import consensus, strict_consensus
from ..operators import resolve
from ..operators.components import components
from ..operators.hamming import hamming_pairs
from ..operators.ranking import elect
from ..runtime import dense_ids, saved, ship
from ..schema import CERTAIN, HIGH, NEAR_CERTAIN

EXACT, CAPTURE, PERCEPTUAL = 1, 2, 3
_MEMBERS = ["phase", "group", "id"]


def _key() -> Column:
    return exif_key(F.col("exif_date"), F.col("exif_camera_model"))


def exact_groups(photos: DataFrame) -> DataFrame:
    """(phase, group, id, confidence) of photos of equal content; a group is named by its least id."""
    keys = photos.groupBy("sha256").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    found = photos.join(keys, "sha256").select(F.lit(EXACT).alias("phase"), "group", "id")
    return found.withColumn("confidence", F.lit(CERTAIN))


def validated_hashes(photos: DataFrame) -> DataFrame:
    """(key, phash, dhash) of captures that another photo of the same capture matches within 2 bits."""
    rows = photos.withColumn("key", _key()).filter(F.col("key").isNotNull() & F.col("phash").isNotNull())
    kinds = saved(rows.groupBy("key", "phash", "dhash").agg(F.count(F.lit(1)).alias("n")), "capture-hashes")
    close = hamming_pairs(kinds, "phash", 2, within=("key",))
    same = kinds.select("key", F.col("phash").alias("a"), F.col("phash").alias("b")).distinct()
    pairs = close.select("key", "a", "b").unionByName(same)
    left = kinds.select("key", F.col("phash").alias("a"), F.col("dhash").alias("da"))
    right = kinds.select("key", F.col("phash").alias("b"), F.col("dhash").alias("db"))
    both = pairs.join(left, ["key", "a"]).join(right, ["key", "b"])
    other = (F.col("a") != F.col("b")) | ~F.col("da").eqNullSafe(F.col("db"))
    both = both.filter(other & strict_consensus(F.col("a"), F.col("da"), F.col("b"), F.col("db")))
    ends = both.select("key", F.col("a").alias("phash"), F.col("da").alias("dhash")).unionByName(
        both.select("key", F.col("b").alias("phash"), F.col("db").alias("dhash"))
    )
    return ends.unionByName(kinds.filter("n >= 2").select("key", "phash", "dhash")).distinct()


def capture_members(photos: DataFrame) -> DataFrame:
    """(key, id, phash, validated, hashed) of photos whose capture is shared."""
    rows = photos.withColumn("key", _key()).filter(F.col("key").isNotNull()).select("key", "id", "phash", "dhash")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("phash").alias("hashed")).filter("n >= 2")
    valid = validated_hashes(photos).withColumn("validated", F.lit(True))
    shared = rows.join(keys.select("key", "hashed"), "key")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("key", "phash", "dhash")]
    joined = shared.alias("l").join(valid.alias("r"), same[0] & same[1] & same[2], "left")
    return joined.select("l.key", "l.id", "l.phash", F.coalesce("validated", F.lit(False)).alias("validated"), "hashed")


def capture_groups(photos: DataFrame) -> DataFrame:
    """(phase, group, id, confidence) of photos of one capture, where hashes allow it."""
    kept = capture_members(photos).filter(F.col("validated") | F.col("phash").isNull() | (F.col("hashed") < 2))
    kept = saved(kept.select("key", "id", "validated"), "capture-kept")
    keys = kept.groupBy("key").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("v")).filter("n >= 2")
    level = F.when(F.col("v") >= 2, HIGH).otherwise(NEAR_CERTAIN)
    return kept.join(keys.select("key", "group", level.alias("confidence")), "key").select(F.lit(CAPTURE).alias("phase"), "group", "id", "confidence")


_KIND = ["phash", "dhash", "exif_date", "exif_camera_model"]


def photo_kinds(photos: DataFrame, grouped: DataFrame) -> DataFrame:
    """Classes of hashed photos that no later test can tell apart: kind (least id), their number, and the first id not in `grouped`."""
    rows = photos.filter(F.col("phash").isNotNull()).select("id", *_KIND)
    rows = rows.join(grouped.select("id").distinct().withColumn("old", F.lit(True)), "id", "left")
    first = F.min(F.when(F.col("old").isNull(), F.col("id"))).alias("first")
    return rows.groupBy(*_KIND).agg(F.min("id").alias("kind"), F.count(F.lit(1)).alias("n"), first)


def accepted_kinds(kinds: DataFrame) -> DataFrame:
    """(a, b, confidence): pairs of kinds, one of which has an ungrouped photo, that match and are no burst; loops for kinds of several photos."""
    close = hamming_pairs(kinds, "phash", 3).select("a", "b")
    same = kinds.select(F.col("phash").alias("a"), F.col("phash").alias("b")).distinct()
    cols = ["kind", "first", *_KIND, "sec"]
    timed = kinds.withColumn("sec", exif_seconds(F.col("exif_date")))
    left = timed.select(*[F.col(c).alias(f"l_{c}") for c in cols])
    right = timed.select(*[F.col(c).alias(f"r_{c}") for c in cols])
    pairs = close.unionByName(same).join(left, F.col("a") == F.col("l_phash")).join(right, F.col("b") == F.col("r_phash"))
    other = (F.col("l_phash") != F.col("r_phash")) | (F.col("l_kind") < F.col("r_kind"))
    seeded = F.col("l_first").isNotNull() | F.col("r_first").isNotNull()
    burst = sequential_seconds(*[F.col(f"{s}_{c}") for s in "lr" for c in ("exif_camera_model", "exif_date", "sec")])
    level = consensus(*[F.col(f"{s}_{c}") for s in "lr" for c in ("phash", "dhash")])
    found = pairs.filter(other & seeded & ~burst).select(F.col("l_kind").alias("a"), F.col("r_kind").alias("b"), level.alias("confidence"))
    loops = kinds.filter("n >= 2 AND first IS NOT NULL").select(F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(NEAR_CERTAIN).alias("confidence"))
    return found.filter(F.col("confidence").isNotNull()).unionByName(loops)


def perceptual_groups(photos: DataFrame, grouped: DataFrame) -> DataFrame:
    """(phase, group, id, confidence) of similar photos around seeds that are not in `grouped`."""
    ship(photos.sparkSession)
    kinds = saved(photo_kinds(photos, grouped), "kinds")
    edges = saved(accepted_kinds(kinds), "kind-edges")
    labels = saved(components(edges), "kind-components")
    vertices = kinds.join(labels.withColumnRenamed("id", "kind"), "kind").select("label", "kind", "n", F.coalesce("first", F.lit(-1)).alias("first"))
    rows = vertices.select("label", F.col("kind").alias("a"), F.col("first").alias("b"), "n", F.lit(-1).alias("confidence"))
    rows = rows.unionByName(edges.join(labels.withColumnRenamed("id", "a"), "a").select("label", "a", "b", F.lit(0).cast("long").alias("n"), "confidence"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        is_vertex = frame["confidence"] < 0
        seeds = [(int(b), int(a), int(n)) for a, b, n in frame.loc[is_vertex, ["a", "b", "n"]].itertuples(index=False)]
        near = [(int(a), int(b), int(c)) for a, b, c in frame.loc[~is_vertex, ["a", "b", "confidence"]].itertuples(index=False)]
        out = [(g, k, c) for g, ks, c in resolve.greedy(seeds, near) for k in ks]
        return pd.DataFrame(out, columns=["g", "kind", "confidence"])

    found = rows.groupBy("label").applyInPandas(run, "g long, kind long, confidence int")
    of_kind = found.join(kinds, "kind").select("g", "confidence", *_KIND)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _KIND]
    members = photos.select("id", *_KIND).alias("l").join(of_kind.alias("r"), same[0] & same[1] & same[2] & same[3]).select("g", "l.id", "r.confidence")
    members = saved(members, "perceptual")
    least = members.groupBy("g").agg(F.min("id").alias("group"))
    return members.join(least, "g").select(F.lit(PERCEPTUAL).alias("phase"), "group", "id", "confidence")


def merge_groups(photos: DataFrame, members: DataFrame) -> DataFrame:
    """Merge overlapping groups: (phase, group, id, confidence), named by the group that made each result last."""
    ship(photos.sparkSession)
    wide = members.groupBy("id").agg(*[F.min(F.when(F.col("phase") == p, F.col("group"))).alias(f"g{p}") for p in (EXACT, CAPTURE, PERCEPTUAL)])
    pattern = ["g1", "g2", "g3", "phash"]
    wide = saved(wide.join(photos.select("id", "phash"), "id").select("id", *pattern), "memberships")
    atoms = saved(wide.groupBy(*pattern).agg(F.min("id").alias("atom")), "atoms")
    level = members.groupBy("phase", "group").agg(F.min("confidence").alias("confidence"))
    of_group = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"g{p}").alias("group")) for p in (EXACT, CAPTURE, PERCEPTUAL)]))
    parts = atoms.select("atom", "phash", of_group.alias("g")).select("atom", "phash", "g.phase", "g.group").filter(F.col("group").isNotNull())
    parts = saved(parts.join(level, ["phase", "group"]), "group-atoms")
    node = F.col("group") * 4 + F.col("phase")  # a group as a vertex beside the atoms' negative ids
    labels = components(parts.select(node.alias("a"), (-F.col("atom") - 1).alias("b")))
    rows = parts.withColumn("node", node).join(labels.withColumnRenamed("id", "node"), "node").select("label", *["phase", "group", "confidence", "atom", "phash"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        phash = {int(a): None if p is None or pd.isna(p) else int(p) for a, p in zip(frame["atom"], frame["bits"], strict=True)}
        groups = [((int(k[0]), int(k[1])), set(map(int, g["atom"])), int(g["confidence"].iloc[0])) for k, g in frame.groupby(["phase", "group"])]
        out = [(o[0], o[1], a, c) for o, atoms, c in resolve.merge(groups, phash) for a in sorted(atoms)]
        return pd.DataFrame(out, columns=["phase", "group", "atom", "confidence"])

    rows = rows.select("label", "phase", "group", "confidence", "atom", F.col("phash").cast("string").alias("bits"))  # text, as nulls would make doubles
    merged = rows.groupBy("label").applyInPandas(run, "phase int, group long, atom long, confidence int")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in pattern]
    named = wide.alias("l").join(atoms.alias("r"), same[0] & same[1] & same[2] & same[3]).select("l.id", "atom")
    return merged.join(named, "atom").select("phase", "group", "id", "confidence")


def attach_orphans(photos: DataFrame, members: DataFrame) -> DataFrame:
    """`members` with photos that are in no group and have no hash, added to the first group of their capture."""
    keyed = photos.withColumn("key", _key()).filter(F.col("key").isNotNull())
    first = members.join(keyed.select("id", "key"), "id").groupBy("key").agg(F.min(F.struct("phase", "group", "confidence")).alias("g"))
    orphans = keyed.filter(F.col("phash").isNull()).join(members.select("id").distinct(), "id", "left_anti").select("id", "key")
    return members.unionByName(orphans.join(first, "key").select("g.phase", "g.group", "id", "g.confidence"))


def find_duplicates(photos: DataFrame) -> DataFrame:
    """(phase, group, id, confidence): all groups of two photos or more; (phase, group) orders them.

    A photo can be in two groups that share it but are not alike otherwise.
    """
    photos = photos.select("id", "sha256", *_KIND)
    early = saved(exact_groups(photos).unionByName(capture_groups(photos)), "early")
    members = early.unionByName(perceptual_groups(photos, early))
    return attach_orphans(photos, saved(merge_groups(photos, saved(members, "members")), "merged"))


def resolve_duplicates(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) as stored: ids number the groups in their order; the best copy of each is elected."""
    found = saved(find_duplicates(photos), "found")
    heads = found.groupBy("phase", "group").agg(F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    heads = saved(dense_ids(heads.drop("n"), ["phase", "group"], "group_id"), "heads")
    members = saved(found.join(heads.select("phase", "group", "group_id"), ["phase", "group"]).select("group_id", "id"), "group-members")
    best = elect(members.join(photos.select("id", "format", "size", "mtime"), "id"))
    return heads.select("group_id", "confidence").join(best, "group_id"), members.select("group_id", F.col("id").alias("photo_id"))
