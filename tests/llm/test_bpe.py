"""BPE against the tokenizers library, word by word and through both joins."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumendex import runtime
from lumendex.llm import bpe, kernels
from lumendex.llm.queries import word_vocabulary

SCHEMA = "doc_id long, text string, ids string, extra int"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_encode_as_the_text(library):
    rng = random.Random(1)
    pool = [chr(i) for i in range(0x250)] + list("  \n\t''’…“Σσς́漢字İK 　\x1c\x1d​") + ["'s", "'re", "<|endoftext|>", "<|"] * 5
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))
        whole = library.encode(text, add_special_tokens=False).ids
        assert [i for w in bpe.words_of(text) for i in library.encode(w, add_special_tokens=False).ids] == whole, text


@pytest.mark.parametrize("head", [0, 4, 1000])
@pytest.mark.parametrize("keep_text", [True, False])
def test_encode_and_decode(spark, library, head, keep_text):
    texts = [None, "", " \n", "The cat's <|endoftext|>HAT!! can't", "the the cat", "x" * 5000, "漢字 Σς ’s", "the the cat"]
    rows = [(i, t, "gone", i) for i, t in enumerate(texts)] + [(4, "the the cat", "gone", 4), (None, "the owl", "gone", 9), (4, "other words", "gone", 5)]
    vocabulary = word_vocabulary()
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), vocabulary, head=head, keep_text=keep_text), vocabulary)
    assert out.columns == ["doc_id", *(["text"] if keep_text else []), "extra", "ids", "decoded"]
    got = sorted((r["extra"], tuple(r["ids"]), r["decoded"]) for r in out.collect())
    want = []
    for _, t, _, e in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((e, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_empty_table_and_odd_ids(spark):
    vocabulary = word_vocabulary()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []
    rows = spark.createDataFrame([([320, 99999, -1, 320],), (None,), ([],)], "ids array<int>")
    piece = vocabulary.pieces[320]
    assert sorted((r["decoded"] or "null") for r in bpe.decode(rows, vocabulary).collect()) == sorted([f"{piece} {piece}", "null", "null"])


def test_lookup_compares_words():
    import numpy as np

    look = bpe.Lookup(["a", "b", "c"], [np.array(x, "<u2").tobytes() for x in ([7], [8, 9], [10])], "<u2")
    known, first, size = look.find(["b", "x", "a", "b"])
    assert known.tolist() == [True, False, True, True] and look.gather(first, size).tolist() == [8, 9, 7, 8, 9]
    assert not bpe.Lookup([], [], "<u2").find(["a"])[0].any()


def test_columns_named_like_internal_ones(spark):
    vocabulary = word_vocabulary()
    names = ["h", "read", "kind", "at", "found", "words_at", "ids_at", "_h", "word"]
    rows = spark.createDataFrame([(1, "the owl", *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = bpe.decode(bpe.encode(rows, vocabulary, head=1), vocabulary)
    assert out.columns == ["doc_id", "text", *names, "ids", "decoded"]
    assert sorted(tuple(r[2:-2]) for r in out.collect()) == [tuple(names)] * 2


def test_a_very_long_text_and_a_word_in_every_row(spark, library):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200_000))
    rows = [(i, f"common word{i % 7}") for i in range(2000)] + [(-1, long)]
    vocabulary = word_vocabulary()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, head=1).collect()}
    assert len(got) == len(rows)
    for i, t in rows[::500] + rows[-1:]:
        assert got[i] == library.encode(t, add_special_tokens=False).ids


def test_lookup_builds_no_table_of_its_words():
    import numpy as np

    words = [f"word{i}" for i in range(200_000)]
    look = bpe.Lookup(words, [np.array([i], "<u4").tobytes() for i in range(len(words))], "<u4")
    look.find(words[:2])  # what is made once
    usual = pa.default_memory_pool()
    watched = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(watched)
    try:
        known, first, size = look.find(["word7", "x", "word199999"])
    finally:
        pa.set_memory_pool(usual)
    assert known.tolist() == [True, False, True] and look.gather(first, size).tolist() == [7, 199999]
    assert watched.max_memory() < 1 << 20


def test_lookup_tells_words_of_equal_hash_apart():
    import numpy as np

    look = bpe.Lookup(["\u6f22a", "\u6f22A", "b"], [np.array([i], "<u2").tobytes() for i in range(3)], "<u2")
    known, first, size = look.find(["\u6f22A", "\u6f22a", "b", "B"])
    assert known.tolist() == [False, True, True, False] and look.gather(first, size).tolist() == [0, 2]


def test_workers_keep_one_tokenizer_over_calls(spark):
    vocabulary = word_vocabulary()
    for i in range(3):
        rows = spark.createDataFrame([(j, f"odd{i}x{j}") for j in range(200)], "doc_id long, text string")
        assert bpe.decode(bpe.encode(rows, vocabulary, head=1), vocabulary).count() == 200

    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._ready)] * b.num_rows, pa.int32())], ["n"])

    found = spark.range(64).repartition(64).mapInArrow(kept, "n int").agg(F.max("n")).first()[0]
    assert 1 <= found <= 2


def test_a_task_leaves_no_batch_or_table_in_its_worker(spark, monkeypatch):
    left = []
    monkeypatch.setattr(runtime, "release", lambda: left.append(pa.total_allocated_bytes()))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.add(b.column(0), 1)], ["x"])

    source = pa.RecordBatch.from_arrays([pa.array(np.zeros(100_000, np.int64))], ["x"])
    before = pa.total_allocated_bytes()
    for b in runtime.lean(run)(source for _ in range(3)):
        assert b.num_rows == 100_000
        del b
    work = runtime.lean(run)(iter([source, source]))
    next(work)
    work.close()  # a task that ends early
    assert len(left) == 2 and all(size - before < 1 << 19 for size in left)

    def hashed(batches):
        for b in batches:
            kernels.hashes(pa.array(["a"]))
            yield b

    def tables(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(kernels._POWERS)] * b.num_rows, pa.int64())], ["id"])

    monkeypatch.undo()
    runtime.ship(spark)
    assert spark.range(64).repartition(64).mapInArrow(runtime.lean(hashed), "id long").count() == 64
    assert spark.range(64).repartition(64).mapInArrow(tables, "id long").agg(F.max("id")).first()[0] == 0


def test_texts_split_together_give_the_words_of_each(monkeypatch):
    rng = random.Random(7)
    plain = [chr(i) for i in range(0x180) if i != 0x130] + list("  \n\t''''strevlmdSTREVLMDab12--") * 20

    def lists(texts):
        ends, words = bpe.all_words(texts)
        words = words.to_pylist()
        assert len(ends) == len(texts) + 1 and ends[-1] == len(words)
        return [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    for pool in (plain, plain + ["漢", "İ", " ", "<|endoftext|>", "<|", "\U0001f600"]):
        for _ in range(1000):
            texts = [rng.choice([None, "", "".join(rng.choices(pool, k=rng.randint(1, 40)))]) for _ in range(rng.randint(0, 6))]
            assert lists(texts) == [bpe.words_of(t) for t in texts], texts
    want = bpe.words_of("It's 'ere, d'Été 42!")
    monkeypatch.setattr(bpe, "words_of", None)  # texts without odd characters are split by arrays alone
    batch = pa.RecordBatch.from_arrays([pa.array(["It's 'ere, d'Été 42!", None])], ["text"])
    ends, words, *_ = bpe._split(batch, 0, bpe.Lookup([], [], "<u2"))
    assert words.to_pylist() == want and ends.tolist() == [0, len(want), len(want)]


@pytest.mark.parametrize("counted", [3, 100_000])
def test_frequent_words_are_counted_in_parts(spark, monkeypatch, counted):
    texts = [None, "", " "] + [f"the {'owl ' * (i % 3)} word{i}" for i in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    run = []
    monkeypatch.setattr(bpe, "COUNTED", counted)
    monkeypatch.setattr(bpe, "lean", lambda f: run.append(f) or runtime.lean(f))
    assert bpe.frequent_words(rows, 2) == ["the", "word"]
    monkeypatch.setattr(bpe, "words_of", None)  # no word of a plain text is a Python object before it is known to be frequent
    batches = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])] * 2
    total = {}
    for b in run[0](iter(batches)):
        for word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[word] = total.get(word, 0) + n
    assert total["the"] == 800 and total["owl"] == 798
    assert list(run[0](iter([]))) == []
