"""Byte-pair encoding and decoding of a corpus through a table of its distinct words.

Texts are split into words in Spark.  The most frequent words, HEAD at most, are
encoded once and broadcast, as any join on them would have hot keys; every text's
ids are laid out with gaps where other words stand.  These others go by word to
the table of distinct words, sorted there, so that each is encoded once by the
tokenizers library, and their ids come back by document and position into the
gaps.  What the driver and the workers hold does not grow with the corpus.
Decoding joins ids to pieces of the vocabulary, a table of fixed size, by place.

The split follows the vocabulary's own rules, so that encoding the words one by
one gives what encoding the text gives.  Texts are split many at a time, by the
classes of their characters, into Arrow strings.  Where a text has characters beyond
Latin Extended-A, whose classes and cases differ between Unicode versions, a run between ASCII
white space is one word, which the library then splits by its own tables.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, release, ship, unused, widened
from .kernels import hashes

#: Frequent words that are broadcast, at most: some 25 bytes each.
HEAD = 1_000_000
#: Distinct words a task counts before it passes them on, and how often it must have met one to call it frequent.
COUNTED, OFTEN = 300_000, 2
#: Texts that are split at a time: where they have odd characters, their words are Python objects, some 60 bytes each.
TEXTS = 250

# The vocabulary's rules for splitting, and its special tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
_L, _N, _S = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}{_S}]+")
_WIDE = re.compile("[^\x00-ſ]|İ")
_BLANK = re.compile("[\t-\r ]+")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: The class of every character that a text split by _WORD alone can have.
_CLASS = np.array([next((k for k, c in enumerate((_S, _L, _N)) if re.match(f"[{c}]", chr(i))), _OTHER) for i in range(0x180)], np.uint8)


def words_of(text: str | None) -> list[str]:
    """The words of a text, in order; encoding each gives the encoding of the text."""
    if not text:
        return []
    if "<|" in text and SPECIAL.search(text):
        found = []
        for i, part in enumerate(SPECIAL.split(text)):
            found += [part] if i % 2 else words_of(part)
        return found
    if text.isascii() or not _WIDE.search(text):
        return _WORD.findall(text.lower())
    found = []
    for run in _BLANK.split(text):
        found += [run] if _WIDE.search(run) else _WORD.findall(run.lower())
    return [w for w in found if w]


def _odd(text: str | None) -> bool:
    """Whether a text needs words_of: it has a special token, or characters that not _CLASS has."""
    if not text:
        return False
    if "<|" in text and SPECIAL.search(text):
        return True
    if text.isascii():
        return False
    return "İ" in text or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) >= len(_CLASS)


def _plain_words(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """words_of each text without odd characters: their numbers, and all words."""
    lower = [(t or "").lower() for t in texts]
    cells = np.frombuffer(("\n".join(lower) + "\n\n\n").encode("utf-16-le"), "<u2")  # white space after each, and room to look ahead
    kind = _CLASS[cells]
    kept = kind != _SPACE  # every character but white space belongs to a word
    first = kept.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # 's and the like where a run of other signs begins: the letters belong to it, and what follows is another word
    mark = np.flatnonzero(cells == ord("'"))
    mark = mark[first[mark]]
    a, b = cells[mark + 1], cells[mark + 2]
    short = np.isin(a, [ord(x) for x in "stmd"])
    long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    first[mark[short | long] + 1] = False
    after = np.concatenate((mark[short] + 2, mark[long] + 3))
    first[after[kept[after]]] = True
    start = np.flatnonzero(first)
    text_ends = np.cumsum([len(t) + 1 for t in lower])
    n = np.diff(np.searchsorted(start, np.concatenate(([0], text_ends))))
    size = kept.astype(np.int32)
    size += kept & (wide := cells >= 0x80)  # in UTF-8
    at = np.cumsum(size, dtype=np.int32)
    ends = np.append(at[start] - size[start], at[-1])  # at most a batch's bytes
    cells = cells[kept]
    data = cells.tobytes().decode("utf-16-le").encode() if wide.any() else cells.astype(np.uint8).tobytes()
    return n, pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data))


def all_words(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """words_of each text: the n+1 offsets of the texts, and all words."""
    counts, words = [np.zeros(1, np.int64)], [pa.array([], pa.string())]
    for odd, part in groupby(texts, _odd):
        if odd:
            lists = [words_of(t) for t in part]
            counts.append(np.array([len(x) for x in lists]))
            words.append(pa.array([w for x in lists for w in x], pa.string()))
        else:
            n, found = _plain_words(list(part))
            counts.append(n)
            words.append(found)
    return np.cumsum(np.concatenate(counts)), pa.concat_arrays(words) if len(words) > 2 else words[-1]


class Vocabulary:
    """A tokenizer file's content, checked to have the rules this module splits by."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        self.name = hashlib.sha256(self.json.encode()).hexdigest()
        rules = json.loads(self.json)
        split = rules["pre_tokenizer"]["pretokenizers"][0]
        names = [x["type"] for x in rules["normalizer"]["normalizers"]]
        if split["pattern"].get("Regex") != PATTERN or not split["invert"] or names != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} splits text by other rules")
        ids = rules["model"]["vocab"] | {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.pieces: list[str | None] = [None] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            self.pieces[i] = piece
        self.dtype = "<u2" if len(self.pieces) <= 1 << 16 else "<u4"


_ready: dict = {}


def _once(key: object, make):
    """A worker's own copy of what `make` builds from a broadcast, by its content's name: one for all calls; the latest few only."""
    if key not in _ready:
        if len(_ready) > 3:
            _ready.clear()
        _ready[key] = make()
        release()  # building takes as much again
    return _ready[key]


def _summed(parts: list[pa.Table]) -> pa.Table:
    """word, n with each word once."""
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def frequent_words(docs: DataFrame, most: int) -> list[str]:
    """The words of `text` that tasks meet often, by how often, `most` at most; every text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []  # words and counts, each word once in a part

        def rows() -> Iterator[pa.RecordBatch]:
            often = _summed(parts)
            often = often.filter(pc.greater_equal(often["n"], OFTEN))
            parts.clear()
            yield from often.to_batches(max_chunksize=50_000)

        for b in batches:
            for a in range(0, b.num_rows, TEXTS):
                found = all_words(b.column(0).slice(a, TEXTS).to_pylist())[1].value_counts()
                parts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(map(len, parts)) > 2 * COUNTED:
                    parts[:] = [_summed(parts)]
                    if len(parts[0]) > COUNTED:
                        yield from rows()
        if parts:
            yield from rows()

    ship(docs.sparkSession)
    counted = docs.select("text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.col("n").desc(), "word").limit(most).select("word").toArrow()["word"].to_pylist()


def encoded_words(tok, words: list[str], dtype: str) -> list[bytes]:
    """The ids of each word, as little-endian integers."""
    parts = (words[a : a + 10_000] for a in range(0, len(words), 10_000))  # the library's results are large
    return [np.array(x.ids, dtype).tobytes() for part in parts for x in tok.encode_batch_fast(part, add_special_tokens=False)]


def _tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


class Lookup:
    """A bounded table of words as flat arrays, by hash, which are broadcast as they are: a worker builds nothing from them.

    Words are compared themselves, not hashes of them alone; of words of equal hash the first is kept.
    """

    def __init__(self, words: list[str], ids: list[bytes], dtype: str):
        column = pa.array(words, pa.string())
        self.hashes, kept = np.unique(hashes(column), return_index=True)
        self.words = column.take(pa.array(kept))
        size = np.array([len(x) for x in ids], np.int32) // np.dtype(dtype).itemsize
        self.size, self.first = size[kept], (np.cumsum(size) - size).astype(np.int32)[kept]  # bounded by HEAD words
        self.ids = np.frombuffer(b"".join(ids), dtype)

    def find(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is known, and its first id and number of ids."""
        none = np.zeros(len(words), np.int64)
        if not len(self.words) or not len(words):
            return none.astype(bool), none, none
        found = (words if isinstance(words, pa.Array) else pa.array(words, pa.string())).dictionary_encode()
        distinct, each = found.dictionary, found.indices.to_numpy()
        own = hashes(distinct)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        have = (self.hashes[at] == own) & pc.equal(distinct, self.words.take(pa.array(at))).to_numpy(zero_copy_only=False)
        first, size = self.first[at].astype(np.int64), np.where(have, self.size[at], 0).astype(np.int64)
        return have[each], first[each], size[each]

    def gather(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        n = size.cumsum()
        total = int(n[-1]) if len(n) else 0
        return self.ids[np.repeat(first - (n - size), size) + np.arange(total)]


def _split(batch: pa.RecordBatch, column: int, look: Lookup) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the texts' words, the words, whether each is frequent, and its first id and number of ids."""
    ends, words = all_words(batch.column(column).to_pylist())
    return ends, words, *look.find(words)


def _slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of values[ends[i]:ends[i + 1]], for every i."""
    raw = np.ascontiguousarray(values)
    offsets = pa.py_buffer((ends * raw.itemsize).astype(np.int64).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, head: int = HEAD, keep_text: bool = True) -> DataFrame:
    """`docs` with ids (array of int), as the tokenizers library encodes `text` without added special tokens.

    doc_id and text are read; other columns pass through whatever their names, but
    a column named ids is replaced; without keep_text the text is left out, and so
    not shuffled.  A null or empty text has no ids.  Rows may repeat, in doc_id or
    as a whole; each gets its ids; null ids are an id like others.  A very long text
    is one row all the way.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("ids")
    dtype = vocabulary.dtype
    common = frequent_words(docs, head)
    known = spark.sparkContext.broadcast(Lookup(common, encoded_words(_tokenizer(vocabulary.json), common, dtype) if common else [], dtype))
    kept = [c for c in docs.columns if keep_text or c != "text"]
    plain = len(kept)
    h, read, kind, at, found, words_at, ids_at = unused([*docs.columns, "word", "ids"], "h", "read", "kind", "at", "found", "words_at", "ids_at")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    own = f"{kind} int, {found} binary, {words_at} binary, {ids_at} binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids of the frequent words, and where, in words and in ids, others are missing."""
        look, pack = known.value, pa.Codec("zstd", compression_level=6)
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):
                b = whole.slice(a, TEXTS)
                ends, _, have, first, size = _split(b, plain + 1, look)
                upto = np.concatenate(([0], np.cumsum(size)))
                gone = np.flatnonzero(~have)
                doc = np.searchsorted(ends, gone, side="right") - 1
                cuts = np.searchsorted(gone, ends)
                flat, bounds = look.gather(first, size), upto[ends]
                ids = pa.array([pack.compress(flat[x:y].tobytes(), asbytes=True) if y > x else b"" for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())
                gaps = [_slices(x.astype(np.int32), cuts) for x in (gone - ends[doc], upto[gone] - upto[ends[doc]])]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: plain + 1], pa.array(np.ones(b.num_rows, np.int32)), ids, *gaps], [*b.schema.names[: plain + 1], kind, found, words_at, ids_at]
                )

    main = keyed.select(*kept, h, F.col("text").alias(read))
    laid = main.mapInArrow(lean(place), widened(main.drop(read), own))

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, h, at, word) of words that are not frequent; `at` is their place among the words."""
        look = known.value
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):
                b = whole.slice(a, TEXTS)
                ends, words, have, _, _ = _split(b, 2, look)
                gone = np.flatnonzero(~have)
                doc = np.searchsorted(ends, gone, side="right") - 1
                columns = [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array((gone - ends[doc]).astype(np.int32)), words.take(pa.array(gone))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", h, at, "word"])

    source, name = spark.sparkContext.broadcast(vocabulary.json), ("tokenizer", vocabulary.name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of every occurrence; words come sorted, so that each is encoded once (again only where a batch ends in it)."""
        tok = _once(name, lambda: _tokenizer(source.value))
        for b in batches:
            words = b.column(3).dictionary_encode()
            ids = pa.array(encoded_words(tok, words.dictionary.to_pylist(), dtype), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids.take(words.indices)], ["doc_id", h, at, found])

    key = f"doc_id {dict(docs.dtypes)['doc_id']}, {h} long, {at} int"
    rest = keyed.select("doc_id", h, "text").mapInArrow(lean(gaps), f"{key}, word string")
    rest = rest.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(lean(each_once), f"{key}, {found} binary")
    both = laid.unionByName(rest.withColumn(kind, F.lit(0)), allowMissingColumns=True)
    both = both.repartition(parts, "doc_id", h).sortWithinPartitions("doc_id", h, kind)
    names = both.columns
    place_of = {c: names.index(c) for c in ("doc_id", h, kind, at, found, words_at, ids_at)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole ids of each document; the ids of its other words come before it."""
        current, other = None, {}
        for whole in batches:
            for a in range(0, whole.num_rows, 5000):
                b = whole.slice(a, 5000)
                doc, hashed, kinds, ats, values = (b.column(place_of[c]).to_pylist() for c in ("doc_id", h, kind, at, found))
                rows, out = [], []
                for i, k in enumerate(kinds):
                    if (doc[i], hashed[i]) != current:
                        current, other = (doc[i], hashed[i]), {}
                    if k == 0:
                        other[ats[i]] = values[i]
                        continue
                    rows.append(i)
                    ids = np.frombuffer(_unpacked(values[i]), dtype)
                    spots = np.frombuffer(b.column(place_of[words_at])[i].as_buffer(), np.int32).tolist()
                    if spots:
                        pieces, done = [], 0
                        for w, n in zip(spots, np.frombuffer(b.column(place_of[ids_at])[i].as_buffer(), np.int32).tolist(), strict=True):
                            pieces += [ids[done:n], np.frombuffer(other[w], dtype)]
                            done = n
                        ids = np.concatenate([*pieces, ids[done:]])
                    out.append(ids.astype(np.int32))
                if rows:
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in range(plain)), lists], [*kept, "ids"])

    return both.mapInArrow(lean(fill), widened(docs.select(*kept), "ids array<int>"))


def _unpacked(raw: bytes) -> bytes:
    """The content of a zstandard frame, or nothing of nothing."""
    return _unpacker()(raw) if raw else b""


@cache
def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def decode(encoded: DataFrame, vocabulary: Vocabulary, column: str = "ids") -> DataFrame:
    """`encoded` with decoded: the pieces of its ids, joined as the library's decode does for this vocabulary (by a space).

    Ids outside the vocabulary are left out; null ids give null, no ids an empty text.
    """
    spark = encoded.sparkSession
    ship(spark)
    encoded = encoded.drop("decoded")
    pieces, name = spark.sparkContext.broadcast(vocabulary.pieces), ("pieces", vocabulary.name)
    at = encoded.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _once(name, lambda: pa.array(pieces.value, pa.string()))
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                lists = b.column(at)
                flat = lists.flatten()
                inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
                got = table.take(pc.if_else(inside, flat, None))
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
                if got.null_count:
                    good = np.concatenate(([0], np.cumsum(got.is_valid().to_numpy(zero_copy_only=False))))
                    ends, got = good[ends], got.drop_null()
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), got), " ")
                joined = pc.if_else(lists.is_valid(), joined, None)
                yield pa.RecordBatch.from_arrays([*b.columns, joined], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(lean(run), widened(encoded, "decoded string"))
