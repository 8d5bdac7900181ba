"""Quality, language and secrets: held-out accuracy on the test tables, and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumendex.llm import langid, quality, queries, secrets

DATA = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "123 !!", "x"), (5, "a" * 300_000, "x"), (5, "the and of", "x"), (None, "der und die", "x")]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality(spark):
    out = {r["doc_id"]: r for r in queries.op1_quality(spark, DATA).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [(out[d]["score"], y) for d, y in labels.items() if out[d]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_quality_edges(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for labels in ([], [(1, 1)], [(1, 1), (1, 0), (2, None), (99, 1)]):
        model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = quality.classify(df, model)
        assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == len(ODD)
        assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.classify(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_additive_tables_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], quality.Params(rounds=20))
    s = quality.score(model, x[3000:])
    assert ((s > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    assert model.pairs[0][:2] == (1, 0)


def test_features_of_a_text_do_not_depend_on_its_batch():
    texts = ["Good. Text here", "", "BAD!! BAD!! 12", "é | x | y", "a\nb\nc"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    whole = quality.features(np.frombuffer(b"".join(raw), np.uint8), ends)
    for i, r in enumerate(raw):
        assert np.allclose(whole[i], quality.features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0])


def test_language(spark, docs):
    out = queries.op8_language(spark, DATA).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"]]
    assert len(out) == 1000 and np.mean(held) > 0.97
    assert sum(r["rejected"] for r in out) <= 5


def test_language_sample_is_not_cut(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    taken = {r["lang"]: r["count"] for r in langid.sample(rows, langid.Params()).groupBy("lang").count().collect()}
    assert taken == {"de": 2000, "en": 2000}


def test_language_edges(spark, docs):
    df = spark.createDataFrame([(*r[:2], "x") for r in ODD], "doc_id long, text string, rejected string")
    model = langid.train(docs.limit(200), langid.Params(least_steps=100))
    out = langid.predict(df, model)
    got = {(r["text"] or "")[:3]: r["lang_pred"] for r in out.collect()}
    assert got[""] == got[" \n"] == got["123"] == "und" and got["the"] == "en"
    assert all((r["lang_pred"] == "und") <= (r["rejected"] and r["lang_score"] == 0) for r in out.collect())
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    one = langid.train(spark.createDataFrame([(i, "wort " * 5, "de") for i in range(1, 9)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(df, one).collect()} == {"de", "und"}


def base(text):
    """The fixed patterns in their plainest form."""
    found = []
    for k, (kind, pattern, group, least) in enumerate((
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


TRICKY = [
    "token: token: abcdef", 'API_KEY = "abc.def/ghi"', "apikey=12345", "passwd  :  'longvalue'", "secret=" + "a" * 5000, "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
    "xAKIAAKIA" + "C" * 20, "f" * 24 + "g" + "0" * 23, "Toſen=abcdefg toKen=abcdefg", "é token=\"deadbeefdeadbeefdeadbeef\" secret=zzzzzz", "password=" + "x", "", None,
]


def test_base_spans():
    for text in TRICKY:
        got = [(secrets.KINDS[k], s, e) for s, k, e in secrets.base_spans(text or "")]
        assert got == base(text or ""), text


def test_secrets(spark):
    out = {r["doc_id"]: r for r in queries.op6_secrets(spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for d, text in texts.items():
        want = base(text or "")
        r = out[d]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        kept = [x for x in r["spans"].split(",") if x and not x.startswith("cnn:")]
        assert ",".join(kept) == joined
    assert sum("cnn" in r["spans"] for r in out.values()) <= 5


def test_network_finds_what_patterns_do_not():
    p = secrets.Params()
    known, new = secrets.generated(1500, 1), secrets.generated(600, 2)
    items = [secrets.encode(t, s, e) for t, s, e, _ in known]
    test = np.array([zlib.crc32(t.encode()) % 4 == 0 for t, *_ in known])
    model = secrets.fit(items, np.array([y for *_, y in known], float), test, p)
    q = secrets.probability(model, [secrets.encode(t, s, e) for t, s, e, _ in new])
    y = np.array([y for *_, y in new])
    assert (q[y == 1] >= model.threshold).mean() > 0.93 and (q[y == 0] >= model.threshold).mean() < 0.03


def test_secrets_edges(spark):
    rows = [(i, t, "s") for i, t in enumerate(TRICKY)] + [(1, "token=abcdef", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = secrets.train(df, secrets.Params(generated=200))
    out = secrets.scan(df, model)
    assert out.columns == ["doc_id", "text", "spans", "redacted"] and out.count() == len(rows)
    for r in out.collect():
        assert (r["redacted"] is None) == (r["text"] is None)
        if r["text"]:
            assert not base(r["redacted"]), r
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string"), secrets.train(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert secrets.redact("abcdef", [(1, 0, 4), (2, 2, 3), (3, 2, 5)]) == "a[SECRET]f"


def test_language_training_hashes_words_in_parts():
    import tracemalloc

    words = [f"{chr(97 + i % 26)}{i:x}words" for i in range(60_000)]
    pieces = [words[a : a + 50] for a in range(0, len(words), 50)]
    labels, test = ["a" if i % 2 else "b" for i in range(len(pieces))], np.arange(len(pieces)) % 8 == 0
    tracemalloc.start()
    model = langid.fit(pieces, labels, test, langid.Params(epochs=1, least_steps=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["a", "b"] and peak < 60 << 20
    for x, y in zip(langid._subwords_lean(words, 1 << 15), langid.subwords(words, 1 << 15), strict=True):
        assert (x == y).all()
