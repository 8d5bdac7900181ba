"""Mixing against SQL, sharding against its laws."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumendex.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size int, target string"


def words(n, w="w"):
    return " ".join([w] * n)


CASES = {
    "empty": [],
    "no words": [(1, None, "a"), (2, "", None), (3, " \n\t", "b")],
    "one source": [(i, words(i), "a") for i in range(5)],
    "null last": [(1, words(10), None), (2, words(10), "a"), (3, words(5), "B"), (4, words(3), "é"), (5, None, None)],
    "capped": [(1, words(1), "c"), (2, words(100), "a"), (3, words(100), "b"), (4, words(2), "c")],
    "repeated rows": [(1, words(7), "a")] * 4 + [(2, words(9), "b")] * 3 + [(None, words(2), "b"), (None, words(3), "c")],
    "hot source": [(i, words(1 + i % 13), "a" if i % 3 else f"s{i % 7}") for i in range(300)],
    "long": [(1, words(20_000), "a"), (2, words(3), "b"), (3, words(50), "c")],
}


@pytest.mark.parametrize("name", CASES)
def test_mix(spark, name):
    rows = [(*r, 7, "x") for r in CASES[name]]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(df)
    assert len(mixed.columns) == len(set(mixed.columns))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, mixed.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, size INT, target VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.SQL})").fetchall(), key=repr)
    assert got == want
    assert mixing.expand(mixed).count() == sum(r["repeats"] for r in mixed.collect())
    per = {}
    for r in mixed.collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9
        x = per.setdefault(r["source"], [r["target"], 0, 0])
        x[1] += r["taken"]
        x[2] = max(x[2], r["size"])
    ids = [r[0] for r in rows]
    if len(set(ids)) == len(ids):
        assert all(abs(t - taken) <= most / 2 + 1e-6 for t, taken, most in per.values())
    total = sum(r[1] for r in got)
    assert sum(t for t, _, _ in per.values()) == pytest.approx(total)


SHARDED = {
    "empty": [],
    "few": [(1, "a"), (2, "a"), (3, None)],
    "nulls and blanks": [(i, None if i % 2 else "") for i in range(40)] + [(None, "x")] * 5,
    "pairs": [(i, f"t{i // 2}") for i in range(400)],
    "hot": [(i, "same" if i % 3 == 0 else f"t{i // 4}") for i in range(900)],
    "one text": [(i, "same") for i in range(100)],
    "repeated": [(1, "a")] * 50 + [(2, "b")] * 30,
    "long": [(i, "x" * (100_000 if i == 3 else 5) + str(i % 20)) for i in range(64)],
}


@pytest.mark.parametrize("name", SHARDED)
def test_shard(spark, name):
    rows = SHARDED[name]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, b int")
    out = sharding.assign(df, shards=16).collect()
    assert len(out) == len(rows)
    per = {s: [] for s in range(16)}
    for r in out:
        per[r["shard"]].append(r["slot"])
    sizes = [len(x) for x in per.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    again = sharding.assign(df, shards=16).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    if len({r[0] for r in rows}) == len(rows):
        text = dict(rows)
        groups = {}
        for r in out:
            t = text[r["doc_id"]]
            assert r["size"] == len((t or "").encode()) + 1
            groups.setdefault(t, []).append(r["shard"])
        # a group is cut at the end of a shard, or if it fills shards: fewer cuts than shards over all
        assert sum(len(set(g)) - 1 for g in groups.values()) <= 15


def test_native_plans(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string")
    for out in (mixing.mix(df), sharding.assign(df)):
        plan = out._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    assert mixing.mix(df).filter(F.col("repeats") > 3).isEmpty()


def test_stages_keep_columns_of_clashing_names(spark):
    import corpus_pipeline

    names = [
        "_h", "h", "of", "whole", "cut", "size", "target", "taken", "repeats", "source_size", "spans", "redacted", "rejected", "lang_pred", "lang_score",
        "_gone", "_twice", "gone", "twice", "bucket", "label", "n", "kept", "key",
    ]
    texts = ["the owl sees the old tree", "the owl sees the old tree", None, "", "la casa es muy grande y blanca", "token = abcdef123456 here", "x " * 20_000]
    rows = [(i, t, ("en", "es", None)[i % 3], ("a", "b", None)[i % 3], len(t or ""), *names) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id at all", "en", "a", 12, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert {tuple(r[5:]) for r in got.collect()} == {tuple(names)}, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert set(names) <= set(last.columns) and last.count() == len(rows)
