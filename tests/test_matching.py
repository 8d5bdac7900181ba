"""Duplicate resolution on hand-built rows, and against a plain model on random ones."""

import random

import pytest

from lumendex.plans import matching
from lumendex.schema import CERTAIN, HIGH, NEAR_CERTAIN, PHOTOS, PROBABLE

MAX = -1  # 64 set bits
D = ("2024-01-15 12:00:00", "EOS R5")
NO = (None, None)


def row(i, sha=None, h=None, d="same", when=NO, fmt="JPEG", size=1000, mtime=1000, source=1):
    return (i, source, f"/p/{i}", size, fmt, sha or f"sha{i}", h, h if d == "same" else d, mtime, when[0], None, when[1], None, None, None, None)


def at(seconds, model="EOS R5"):
    return (f"2024-01-15 12:{seconds // 60:02d}:{seconds % 60:02d}", model)


def groups(spark, rows):
    found = {}
    for r in matching.find_duplicates(spark.createDataFrame(rows, PHOTOS)).collect():
        found.setdefault((r["phase"], r["group"]), [set(), r["confidence"]])[0].add(r["id"])
    return [(sorted(ids), conf) for _, (ids, conf) in sorted(found.items())]


SCENARIOS = {
    "same content": ([row(1, "a", 100), row(2, "a", 100), row(3, "b", MAX)], [([1, 2], CERTAIN)]),
    "same capture without hashes": ([row(1, when=D), row(2, when=D)], [([1, 2], NEAR_CERTAIN)]),
    "same capture, close hashes": ([row(1, h=100, when=D), row(2, h=101, when=D)], [([1, 2], HIGH)]),
    "same capture, one far": ([row(1, h=100, when=D), row(2, h=101, when=D), row(3, h=MAX, when=D)], [([1, 2], HIGH)]),
    "same capture, one hash": ([row(1, h=5, when=D), row(2, when=D), row(3, when=D)], [([1, 2, 3], NEAR_CERTAIN)]),
    "pair, one hash": ([row(1, h=100, when=D), row(2, when=D)], [([1, 2], NEAR_CERTAIN)]),
    "second hash far": ([row(1, h=0, d=0), row(2, h=1, d=MAX)], []),
    "distance 3, same capture": ([row(1, h=0, when=D), row(2, h=7, when=D)], [([1, 2], PROBABLE)]),
    "distance 4": ([row(1, h=0), row(2, h=15)], []),
    "second hash at 4": ([row(1, h=0, d=0), row(2, h=3, d=15)], []),
    "second hash missing, 2": ([row(1, h=0, d=None), row(2, h=3, d=0)], [([1, 2], NEAR_CERTAIN)]),
    "second hash missing, 3": ([row(1, h=0, d=None), row(2, h=7, d=0)], []),
    "equal hashes": ([row(1, h=9), row(2, h=9)], [([1, 2], NEAR_CERTAIN)]),
    "burst 2 s": ([row(1, h=9, when=at(0)), row(2, h=9, when=at(2))], []),
    "burst 60 s": ([row(1, h=9, when=at(0)), row(2, h=9, when=at(60))], []),
    "61 s": ([row(1, h=9, when=at(0)), row(2, h=9, when=at(61))], [([1, 2], NEAR_CERTAIN)]),
    "burst of five": ([row(i, h=9, when=at(i)) for i in range(1, 6)], []),
    "burst with a copy": ([row(1, h=9, when=at(0)), row(2, h=9, when=at(2)), row(3, h=9, when=at(0))], [([1, 3], HIGH)]),
    "calendar of 31-day months": ([row(1, h=9, when=("2022-12-31 10:00:00", "X")), row(2, h=9, when=("2023-01-07 10:00:00", "X"))], []),
    "bridge": ([row(1, "s", 0xFF00), row(2, "s", 0xFF00), row(3, "o", 0xFF01)], [([1, 2, 3], NEAR_CERTAIN)]),
    "leader by hash, raw by capture": ([row(1, h=1, d=0, when=D), row(2, h=0, d=7, when=D), row(3, when=D, fmt="HEIC")], [([1, 2, 3], PROBABLE)]),
    "raw of another capture": ([row(1, h=0, when=D), row(2, h=1, when=D), row(3, when=NO, fmt="HEIC"), row(4, when=("2020-01-01 00:00:00", "Y"), fmt="HEIC")], [([1, 2], HIGH)]),
    "unknown camera": ([row(1, when=(D[0], None)), row(2, when=(D[0], None))], [([1, 2], NEAR_CERTAIN)]),
    "camera named unknown": ([row(1, when=(D[0], None)), row(2, when=(D[0], "unknown"))], [([1, 2], NEAR_CERTAIN)]),
    "camera and none": ([row(1, when=D), row(2, when=(D[0], None))], []),
    "flat pictures": ([row(1, h=MAX, d=0), row(2, h=MAX, d=0)], [([1, 2], NEAR_CERTAIN)]),
    "one photo": ([row(1, h=1)], []),
    "none": ([], []),
}


def apart(cases):
    """All cases in one table that cannot meet: hashes are turned by a mask of their own each, which keeps distances, and years are moved."""
    rng, rows = random.Random(9), []
    for k, case in enumerate(cases):
        p, d = rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-(1 << 63), 1 << 63)
        for r in case:
            r = list(r)
            r[0] += 1000 * k
            r[5] += f"-{k}"
            r[6] = None if r[6] is None else r[6] ^ p
            r[7] = None if r[7] is None else r[7] ^ d
            r[9] = None if r[9] is None else f"{int(r[9][:4]) - 20 * k}{r[9][4:]}"
            rows.append(tuple(r))
    return rows


def split(found, count):
    out = [[] for _ in range(count)]
    for ids, conf in found:
        out[ids[0] // 1000].append(([i % 1000 for i in ids], conf))
    return out


@pytest.fixture(scope="module")
def results(spark):
    return dict(zip(SCENARIOS, split(groups(spark, apart([rows for rows, _ in SCENARIOS.values()])), len(SCENARIOS)), strict=True))


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(results, name):
    assert results[name] == SCENARIOS[name][1]


def test_empty_table(spark):
    assert groups(spark, []) == []


def model(rows):
    """The five stages, photo by photo, in lists and sets."""
    photo = {r[0]: r for r in rows}
    ham = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    key = lambda r: None if r[9] is None else f"{r[9]}|{r[11] or 'unknown'}"
    conf = lambda d: 3 if d <= 2 else 1 if d <= 3 else None

    def seconds(r):
        day, t = r[9].split(" ")
        y, m, d = map(int, day.split("-"))
        h, mi, s = map(int, t.split(":"))
        return (y * 365 + y // 4 + m * 31 + d) * 86400 + h * 3600 + mi * 60 + s

    def burst(a, b):
        return None not in (a[9], b[9], a[11], b[11]) and a[11] == b[11] and a[9] != b[9] and abs(seconds(a) - seconds(b)) <= 60

    def by(f):
        found = {}
        for r in rows:
            if f(r) is not None:
                found.setdefault(f(r), []).append(r[0])
        return sorted(found.values(), key=min)

    listed = [((1, min(g)), set(g), 4) for g in by(lambda r: r[5]) if len(g) > 1]
    for g in by(key):
        hashed = [i for i in g if photo[i][6] is not None]
        valid = {x for a in hashed for b in hashed if a != b for x in (a, b) if ham(photo[a][6], photo[b][6]) <= 2 and (None in (photo[a][7], photo[b][7]) or ham(photo[a][7], photo[b][7]) <= 2)}
        kept = [i for i in g if i in valid or photo[i][6] is None or len(hashed) < 2]
        if len(g) > 1 and len(kept) > 1:
            listed.append(((2, min(kept)), set(kept), 2 if len(valid) > 1 else 3))
    listed.sort(key=lambda g: g[0])
    old, used, third = set().union(*[g[1] for g in listed], set()), set(), []
    for a in rows:
        if a[0] in old or a[6] is None or a[0] in used:
            continue
        mine, worst = [a[0]], 4
        for b in rows:
            if b[0] == a[0] or b[0] in used or b[6] is None or burst(a, b):
                continue
            c = conf(ham(a[6], b[6]))
            if c is None:
                continue
            if None not in (a[7], b[7]):
                e = conf(ham(a[7], b[7]))
                if e is None:
                    continue
                c = min(c, e)
            elif ham(a[6], b[6]) > 2:
                continue
            mine.append(b[0])
            worst = min(worst, c)
        if len(mine) > 1:
            used.update(mine)
            third.append(((3, min(mine)), set(mine), worst))
    merged = []
    for order, ids, c in listed + sorted(third, key=lambda g: g[0]):
        def alike(other):
            x, y = ids - other, other - ids
            if not x or not y:
                return True
            px, py = ([photo[i][6] for i in s if photo[i][6] is not None] for s in (x, y))
            return not px or not py or any(ham(p, q) <= 3 for p in px for q in py)
        fit = [g for g in merged if g[1] & ids and alike(g[1])]
        merged = [g for g in merged if g not in fit]
        merged.append((order, ids.union(*[g[1] for g in fit]), min([c, *[g[2] for g in fit]])))
    grouped = set().union(*[g[1] for g in merged], set())
    final = [(o, set(ids), c) for o, ids, c in merged]
    for r in rows:
        if r[0] not in grouped and r[6] is None and key(r) is not None:
            home = next((g for g, m in zip(final, merged, strict=True) if any(key(photo[i]) == key(r) for i in m[1])), None)
            if home:
                home[1].add(r[0])
    return [(sorted(ids), c) for o, ids, c in sorted(final, key=lambda g: g[0])]


def test_against_model(spark):
    rng, cases = random.Random(3), []
    for _ in range(12):
        rows = []
        for i in range(1, 40):
            h = rng.choice([None, *[rng.choice([0, 1, 3, 7, 0xFF00, 0xFF01, MAX]) for _ in range(4)]])
            d = None if h is None or rng.random() < 0.2 else rng.choice([0, 1, 7, 15])
            when = rng.choice([NO, at(0), at(30), at(61), at(200, "B"), (at(0)[0], None)])
            rows.append(row(i, rng.choice("abcdefgh") if rng.random() < 0.3 else None, h, d, when))
        cases.append(rows)
    assert split(groups(spark, apart(cases)), len(cases)) == [model(rows) for rows in cases]


def test_stored_ids_and_best_copy(spark):
    rows = [row(1, "a", fmt="JPEG", size=9), row(2, "a", fmt="CR2", size=1), row(3, "b", size=5, mtime=9), row(4, "b", size=5, mtime=8), row(5, "c", size=1), row(6, "c", size=2), row(7, "d"), row(8, "d")]
    found, members = matching.resolve_duplicates(spark.createDataFrame(rows, PHOTOS))
    assert [(r["group_id"], r["source_of_truth_id"]) for r in found.orderBy("group_id").collect()] == [(1, 2), (2, 4), (3, 6), (4, 7)]
    assert members.count() == 8
