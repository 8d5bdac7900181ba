"""The two order-dependent steps of duplicate resolution, as plain functions over one component.

Both run on collapsed inputs (classes of photos with equal hashes and capture data;
atoms of photos with equal memberships), so their size follows distinct contents,
not copies.
"""

from __future__ import annotations

from collections import defaultdict

from ..schema import CERTAIN

#: Two exclusive sides of a merge are alike within so many bits of the first hash.
MERGE_BITS = 3


def greedy(seeds: list[tuple[int, int, int]], edges: list[tuple[int, int, int]]) -> list[tuple[int, list[int], int]]:
    """Groups (seed class, classes, confidence) of one component.

    seeds: (first ungrouped id or a negative number for none, class, photos in the
    class); edges: (class, class, confidence), with a loop for a class of several
    photos.  Classes are taken in order of their first id; a group is the class and
    its neighbours not used yet, if that makes two photos.
    """
    size = {c: n for _, c, n in seeds}
    near: dict[int, dict[int, int]] = defaultdict(dict)
    for a, b, conf in edges:
        near[a][b] = conf
        near[b][a] = conf
    used: set[int] = set()
    found = []
    for first, c, _ in sorted(seeds):
        if first < 0 or c in used:
            continue
        group = [c, *sorted(x for x in near[c] if x != c and x not in used)]
        if sum(size[x] for x in group) < 2:
            continue
        worst = min([CERTAIN, *(near[c][x] for x in group[1:]), *([near[c][c]] if c in near[c] else [])])
        used.update(group)
        found.append((c, group, worst))
    return found


def _alike(a: set[int], b: set[int], phash: dict[int, int | None]) -> bool:
    """Whether two overlapping groups may merge: one has nothing of its own, or what is their own has a close pair or no hash."""
    own_a, own_b = a - b, b - a
    if not own_a or not own_b:
        return True
    left = {phash[x] for x in own_a if phash[x] is not None}
    right = {phash[x] for x in own_b if phash[x] is not None}
    if not left or not right:
        return True
    return any(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= MERGE_BITS for x in left for y in right)


def merge(groups: list[tuple[tuple[int, int], set[int], int]], phash: dict[int, int | None]) -> list[tuple[tuple[int, int], set[int], int]]:
    """Merge overlapping groups (order, atoms, confidence) in order; each result has the order of the group that made it last."""
    merged: list[tuple[tuple[int, int], set[int], int]] = []
    for order, atoms, conf in sorted(groups, key=lambda g: g[0]):
        fit = [g for g in merged if g[1] & atoms and _alike(atoms, g[1], phash)]
        if fit:
            merged = [g for g in merged if not any(g is f for f in fit)]
            atoms = atoms.union(*(f[1] for f in fit))
            conf = min(conf, *(f[2] for f in fit))
        merged.append((order, set(atoms), conf))
    return merged
