"""Fingerprints, main text, search and the pipeline against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumendex.llm import fingerprint, htmltext, mixing, queries, search, secrets

SMALL = "/root/testdata/sf0.001"


def test_difference_is_exact():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), n).tolist()) + "\n" * (n % 3) for n in rng.integers(0, 900, 40)]
    texts += ["", "a", "a a a a a a a a " * 50, "x\nx\nx\ny"]
    items = fingerprint.pieces([t.encode() for t in texts])
    sets = [set(items[0][items[1][i] : items[1][i + 1]].tolist()) for i in range(len(texts))]
    assert all(len(s) == n for s, n in zip(sets, np.diff(items[1]), strict=True))
    a, b = rng.integers(0, len(texts), 200), rng.integers(0, len(texts), 200)
    found = fingerprint.difference(items, a, items, b)
    assert found.tolist() == [len(sets[i] ^ sets[j]) for i, j in zip(a, b, strict=True)]


def test_an_edit_changes_only_pieces_it_touches():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(1000)]
    other = [*words]
    other[500] = "changed"
    items = fingerprint.pieces([" ".join(w).encode() for w in (words, other)])
    assert fingerprint.difference(items, np.array([0]), items, np.array([1]))[0] <= 6


ROWS = {
    "empty": [],
    "one": [(5, "only one")],
    "odd": [(3, None), (1, ""), (2, "a"), (10, "aé漢b"), (7, "x" * 50_001), (None, "none"), (8, "p q r " * 400)],
    "ties": [(1, "b"), (1, "a"), (1, "a"), (2, "c d"), (2, "c d")],
    "many": [(i * 37 % 1000, f"text {i} " * (i % 9)) for i in range(300)],
}


@pytest.mark.parametrize("name", ROWS)
def test_fingerprints(spark, name):
    rows = ROWS[name]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars string")
    got = fingerprint.fingerprints(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    text = {(r[0]): r[1] for r in rows}
    if len(text) == len(rows):
        by_text = {}
        for r in got:
            assert by_text.setdefault(text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


PAGES = [
    (None, ""), ("", ""), ("<p>a", "a"), ("<div><p>x</div>y", "x y"), ("<ul><li>a<li>b</ul>", "a b"), ("a<!-- x", "a"), ("<script>if(a<b)", ""),
    ("<p>a&nbsp;b &amp;lt; <i>c</i>d</p>e", "a b &lt; cd e"), ("<style>p{}</style><p>t\n\n u</p>", "t u"), ("x < y & z", "x < y & z"), ("<p>a<br>b</p>", "a b"),
    ("<body><nav>menu one</nav><article><h1>T</h1><p>First, long enough paragraph, with commas.</p><p>s</p><aside>side</aside></article><footer>f</footer>", "T First, long enough paragraph, with commas. s"),
    ("<body><div class='ad'>Buy, buy, buy this thing now, please!</div><div id=main><p>Short but real text, of the page itself.</p></div><div class=comments><p>I disagree, strongly, with all of it.</p></div>", "Short but real text, of the page itself."),
    ("<body><form><p>Subscribe, now, to our great letter</p><input></form><section><p>The text, which is long enough, stays.</p><script>var a='</p>'</script></section>", "The text, which is long enough, stays."),
    ("<body><div><a href=1>one, two, three, four, five</a> <a href=2>six, seven, eight, nine</a></div><div><p>A paragraph, not a list of links, is kept.</p></div>", "A paragraph, not a list of links, is kept."),
    ("<p><b>open bold <p>next</p>", "open bold next"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<article><p>Kept, as the article goes on, here.</p><div class=\"cookie-notice\">We use cookies, you know, for all.</div></article>", "Kept, as the article goes on, here."),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert htmltext.extract(page) == want


LONG = "".join(f"<p>Paragraph {i}, long enough to score, with a comma or two, and some more words after it, all of which are plain text.</p>" for i in range(12))
TOLD = " ".join(f"Paragraph {i}, long enough to score, with a comma or two, and some more words after it, all of which are plain text." for i in range(12))
COMMENTS = f"<div class=comments><article class=comment>{LONG.replace('Paragraph', 'Reader')}</article></div>"
WHOLE = [
    (f"<article><h1>Title</h1>lead <b>in</b><section>{LONG}</section><section><h2>End</h2><p>Short close.</p></section><p>By me.</p><ul><li>a<li>b</ul><table><tr><td>1</table>"
     "<ul><li><a href=1>elsewhere</a></ul></article>", f"Title lead in {TOLD} End Short close. By me. a b 1"),
    (f"<main><h1>T</h1><div><div>{LONG}</div><p>s</p></div></main><p>out</p>", f"T {TOLD} s"),
    (f"<main><h1>T</h1><article>{LONG}</article>{COMMENTS}</main>", f"T {TOLD}"),
    (f"<div class='layout with-sidebar'><article>{LONG}</article></div>", TOLD),
    (f"<div class='page no-header'>{LONG}</div><div class=sidebar><p>Some other things, which are not part of it.</p></div>", TOLD),
    (f"<article><div class='entry-header'><h1>T</h1></div>{LONG}<div class=share>Share this</div></article>", f"T {TOLD}"),
    (f"<article><p>Kept, as the article goes on, here.</p>{COMMENTS}</article>", "Kept, as the article goes on, here."),
    (f"<div><p>Kept, as the text goes on, right here.</p></div><div class='comment-content'>{LONG}</div>", "Kept, as the text goes on, right here."),
]


@pytest.mark.parametrize(("page", "want"), WHOLE)
def test_whole_article(page, want):
    assert htmltext.extract(page) == want


ODD = [
    ("<article><p title=it's>Hello world, here it is.</p><p>Second para.</p></article>", "Hello world, here it is. Second para."),
    ('<article><p data-x="a>b" title=\'c"d\'>One, two.</p><img alt="x > y"><p/class=a>Three.</p></article>', "One, two. Three."),
    ("<article><p>Four < five, 6 <7 and <b x='y>bold</b> text.</p></article>", "Four < five, 6 <7 and bold text."),
    ("<article><p =odd =\"v\" a = 'b'>Six.</p></article>", "Six."),
    ("<div>" * 300 + "<nav><ul><li>MENU ITEM</li></ul></nav><article><p>Real article text, long enough.</p></article>" + "</div>" * 300, "Real article text, long enough."),
    (
        f"<body><div>x</div><div class='article-body'><div><p>{'Long, longer, ' * 20}</p></div><h2>Heading two</h2><div><p>Short end.</p></div> loose</div></body>",
        " ".join(("Long, longer, " * 20).split()) + " Heading two Short end. loose",
    ),
    (
        f"<body><div><div><p>{'Long, longer, ' * 20}</p></div>Loose text beside the container, with <b>bold</b> words.<h2>Between</h2><div><p>{'More, yet more, ' * 15}</p></div><ul><li><a>Link</a></li></ul></div></body>",
        " ".join(("Long, longer, " * 20).split()) + " Loose text beside the container, with bold words. Between " + " ".join(("More, yet more, " * 15).split()),
    ),
]


@pytest.mark.parametrize(("page", "want"), ODD)
def test_odd_markup(page, want):
    assert htmltext.extract(page) == want


@pytest.mark.parametrize("page", ["<a b='y ", "<div>x", "<b><p>x</p>", "</b><div>", "<table><td></b>", "<li><", "<!-", "&#x41;,", "<div class='ad'>some words, and more of them</div>"])
def test_time_is_linear(page):
    import time

    page = "<b><article>" + page * (200_000 // len(page))
    began = time.process_time()
    htmltext.extract(page)
    assert time.process_time() - began < 4


def test_pages(spark):
    import html
    import re

    for r in queries.op10_html(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub("<(?:/?(?:h1|p|li|ul)|br)>", " ", inside))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "y")], "page_id long, html string, text string")
    assert [tuple(r) for r in htmltext.extract_pages(df).orderBy("text").collect()] == [(1, None, "", 0), (1, "<p>a", "a", 1)]
    assert htmltext.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [16, 1000])
def test_search(spark, shard_rows):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000, None), (1020, ""), (1040, "unheard-of words"), (1060, "the the of"), (None, "the")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int")
    got = {}
    for r in search.top_k(df, F.col("doc_id") % 20 == 0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    bags = {i: Counter((t or "").encode().lower().split()) for i, t in rows if i is not None}
    length = {i: sum(b.values()) for i, b in bags.items()}
    n, mean, df_ = len(bags), sum(length.values()) / len(bags), Counter(w for b in bags.values() for w in b)
    for q in (i for i in bags if i % 20 == 0):
        score = {}
        for i, b in bags.items():
            s = sum(k * math.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, k in bags[q].items() if w in b)
            if s > 0:
                score[i] = s
        best = sorted(score.values(), reverse=True)[:10]
        assert [s for _, s in got.get(q, [])] == pytest.approx(best)
        assert all(score[i] == pytest.approx(s) for i, s in got.get(q, []))
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0


def _shard_of(texts: list[str], mean: float):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    row = search._packed(np.arange(len(texts)), np.zeros(len(texts), bool), [search.term_lists(pa.array(texts))])
    names = [c.split(" ")[0] for c in search._INDEX.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)
    return search.Shard(batch, 0, mean, np.zeros(0, np.int64))


def test_search_rescores_few_under_a_low_threshold(monkeypatch):
    """A threshold that lets every document pass does not have every one scored again in double precision."""
    import pyarrow as pa

    texts = ["w " * (i % 50 + 1) + f"x{i}" for i in range(400)]
    mean = sum(len(t.split()) for t in texts) / len(texts)
    shard = _shard_of(texts, mean)
    terms, counts, _, _ = search.term_lists(pa.array(["w w w x7"]))
    rows = pa.table({"id": [20], "terms": [terms.tolist()], "counts": [counts.tolist()], "weights": [[1.5] * len(terms)]})
    queries = search.Queries(rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
    queries.prepare()
    scored, exact = [], search.Shard._exact
    monkeypatch.setattr(search.Shard, "_exact", lambda self, doc, *a: scored.append(doc) or exact(self, doc, *a))
    found = [(int(shard.ids[d]), s) for _, docs, score in shard.top(queries, np.array([1e-6]), 10) for d, s in zip(docs, score, strict=True)]

    def bm25(i):
        bag = Counter(texts[i].split())
        norm = 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)
        return sum(1.5 * k * bag[w] * 2.2 / (bag[w] + norm) for w, k in (("w", 3), ("x7", 1)) if w in bag)

    want = sorted(range(400), key=lambda i: (-round(bm25(i), 9), i))[:10]
    assert [i for i, _ in sorted(found, key=lambda x: (-round(x[1], 9), x[0]))] == want
    assert all(s == pytest.approx(bm25(i)) for i, s in found)
    assert len(scored) < 40  # equal scores pass together: 8 documents of each length


def test_search_first_rounds_score_in_single_precision(monkeypatch):
    """A rough round scores nothing in double precision and keeps the best; what it leaves open is then scored alone, like elsewhere."""
    import pyarrow as pa

    texts = [f"w x{i % 7} " + "y " * (i % 90) + f"z{i}" for i in range(300)]
    shard = _shard_of(texts, 40.0)
    lists = [search.term_lists(pa.array([t])) for t in ("w x3 y", "x5 z12 y y")]
    rows = pa.table({"id": [20, 40], "terms": [x[0].tolist() for x in lists], "counts": [x[1].tolist() for x in lists], "weights": [[1.5] * len(x[0]) for x in lists]})
    queries = search.Queries(rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
    queries.prepare()
    want = {(int(r), int(d)): s for rows, docs, score in shard.top(queries, np.zeros(2), 10) for r, d, s in zip(rows, docs, score, strict=True)}
    scored, exact = [], search.Shard._exact
    monkeypatch.setattr(search.Shard, "_exact", lambda self, doc, *a: scored.append(doc) or exact(self, doc, *a))
    least = np.zeros(2)
    found = {(int(r), int(d)): s for rows, docs, score in shard.top(queries, least, 10, rough=True) for r, d, s in zip(rows, docs, score, strict=True)}
    assert not scored and len(want) == 20 and want.keys() <= found.keys() and len(found) < 60
    assert all(found[x] == pytest.approx(s, rel=1e-5) for x, s in want.items())
    assert all(0 < low <= min(s for (r, _), s in want.items() if r == i) for i, low in enumerate(least))
    pairs = sorted((int(shard.ids[d]), r) for r, d in found)
    known = [np.array([x[i] for x in pairs]) for i in (1, 0)]
    got = {(int(r), int(d)): s for rows, docs, score in shard.again(queries, *known) for r, d, s in zip(rows, docs, score, strict=True)}
    assert got.keys() == found.keys() and len(scored) == len(found) and all(got[x] == s for x, s in want.items())


def test_search_crowds_of_equal_scores(spark):
    """More equal scores than are carried from round to round: the least ids are the best all the same, over many shards."""
    rows = [(i, "a b c") for i in range(1, 700)] + [(i, f"a b c d{i}") for i in range(700, 900)] + [(60, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in search.top_k(df, F.col("doc_id").isin(20, 60, 800), shard_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {20: list(range(1, 11)), 60: list(range(1, 11)), 800: [800, *range(1, 10)]}


def test_search_query_rows_of_equal_id(spark):
    """Query rows of one id are one query of all their words, and documents that differ outside it rank by id."""
    rows = [(20, "a b"), (20, "b c"), (1, "b b"), (2, "c d"), (5, "a y1 y2"), (4, "a z1 z2"), (3, "e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in search.top_k(df, F.col("doc_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    bags = [(i, Counter(t.split())) for i, t in rows]
    df_, mean, asked = Counter(w for _, b in bags for w in b), sum(len(t.split()) for _, t in rows) / len(rows), Counter("abbc")
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df_.items()}
    want = [(i, sum(asked[w] * idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, n in b.items())) for i, b in bags]
    want = sorted(((i, s) for i, s in want if s > 0), key=lambda x: (-x[1], x[0]))
    assert [s for _, s in got] == pytest.approx([s for _, s in want])
    assert [i for i, _ in got if i in (4, 5)] == [4, 5] and sorted(i for i, _ in got) == sorted(i for i, _ in want)
    assert len({s for i, s in got if i in (4, 5)}) == 1


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        kept[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == before.columns
    rows = {name: (list(map(tuple, a.collect())), list(map(tuple, b.collect()))) for name, (a, b) in kept.items()}
    a, b = rows["language"]
    assert len(a) - len(b) <= 1 and set(b) <= set(a)
    from tests.llm.test_neardup import truth

    a, b = rows["near_duplicates"]
    alone = {i for i, (_, _, keep) in truth([r[:2] for r in a]).items() if keep}
    assert sorted(b) == sorted(r for r in a if r[0] in alone)
    a, b = rows["secrets"]
    clean = {r[0]: r for r in b}
    for r in a:
        spans = secrets.base_spans(r[1] or "")
        assert not spans or not secrets.base_spans(clean[r[0]][1])
        assert (clean[r[0]] == r) or "[SECRET]" in clean[r[0]][1]
        assert clean[r[0]][4] == len(clean[r[0]][1])
    a, b = rows["mixing"]
    times = {r["doc_id"]: r["repeats"] for r in mixing.mix(kept["mixing"][0]).collect()}
    assert Counter(b) == Counter({r: times[r[0]] for r in a if times[r[0]]})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows["mixing"][1]:
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[(r[0], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in kept["bpe"][1].collect()) == want
