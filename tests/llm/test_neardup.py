"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from lumendex.llm import kernels, neardup


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def truth(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \t\n", "one", "One", "one two three four", "ONE two  three\nfour", "é É", "a b c d e", "a b c d e f", "x " * 3000]
    for _ in range(25):
        texts.append(" ".join(word() for _ in range(rng.randint(1, 120))))
    base = [word() for _ in range(150)]
    for _ in range(60):  # a family whose members differ from each other more than from the base
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += [rng.choice(texts) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "members"), [(1, 512), (2, 8)])
def test_against_all_pairs(spark, seed, members):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component_id string")
    out = neardup.near_duplicates(df, neardup.Params(members=members)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == truth(rows)
    assert len(out) == len(rows)


def test_block_comparison_alone(spark):
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(10**6, 50, replace=False)).astype(np.uint64) for _ in range(6)]
    sets += [np.sort(np.concatenate([s[:45], rng.choice(10**6, 3) + 10**7]).astype(np.uint64)) for s in sets]
    ids = np.arange(12)
    found = neardup.forest(ids, ids, np.zeros(12, int), sets, 75)
    assert {tuple(sorted(x)) for x in found} == {(i, i + 6) for i in range(6)}
    across = neardup.forest(ids, ids, (ids >= 6).astype(int), sets, 75)
    assert {tuple(sorted(x)) for x in across} == {(i, i + 6) for i in range(6)}
    assert neardup.forest(ids, np.array([0] * 12), np.zeros(12, int), sets, 75) == []


def test_deduplicate(spark):
    rows = [(1, "a b c d e f", "p"), (2, "A b c d e f", "q"), (3, "z", "r"), (3, "z", "r"), (None, "q", "s"), (None, None, "t"), (5, None, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=repr)


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        n = 400
        both = rng.integers(0, 2**63, int(n * share)).astype(np.uint64) * np.uint64(2)
        own = [rng.integers(0, 2**63, (n - len(both)) // 2).astype(np.uint64) * np.uint64(2) for _ in range(2)]
        sets = [np.sort(np.concatenate([both, x])) for x in own]
        flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        s = kernels.one_permutation(flat, ends, 1024)
        assert abs((s[0] == s[1]).mean() - len(both) / (len(both) + sum(map(len, own)))) < 0.08


def test_words_and_shingles():
    texts = ["", "a", "a b", " A  b\tc d e f ", "\x0b\x0c", "é ÀB x", "a b c d e a b c d e"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    w = kernels.Words(data, offs)
    assert w.count.tolist() == [len(t.split()) for t in raw]
    h, o = kernels.shingles(w, 5)
    assert np.diff(o).tolist() == [len(shingle_set(t)) for t in texts]
    assert [c for c in kernels.chunks(offs, 4)][-1][1] == len(texts)


def test_blocks_without_members(spark):
    text = " ".join(f"w{i}" for i in range(60))
    texts = spark.createDataFrame([(1, text), (2, text + " more"), (3, text + " other")], "id long, text string")
    labels = spark.createDataFrame([], "id long, label long")
    members = [(b, i, 56) for b in range(30) for i in range(1, 3 + b % 2)]
    rest = neardup._rest(spark.createDataFrame(members, "bucket long, id long, n long"), labels, texts, neardup.Params(block=40))
    assert {tuple(sorted(r)) for r in rest.collect()} >= {(1, 2)}
    ids = np.arange(2)
    sets = [np.arange(50, dtype=np.uint64)] * 2
    assert neardup.forest(ids, ids, np.ones(2, int), sets, 75) == []
