"""Small cases of the corpus operators against brute force, round trips and other libraries."""

import base64
import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, chat, html_template, line_dedup, ngram_join, packing, simhash, substrings, topk, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    pool = list("ab 'stremvdl \n\t\x1c\x85\xa0½²Ⅷ一é日本😀<|endoftext|>19...") + [chr(i) for i in range(32, 0x250)]
    return ["", " ", "\n\n", "a" * 5000, "word " * 3000] + ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(300)]


# -- 1 -------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(odd_texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(RANKS)
    for text, ids in zip(odd_texts, own.encode(odd_texts)):
        assert ids == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_merge_tree_and_forest_agree():
    own = bpe.Codec(RANKS)
    r = random.Random(1)
    pieces = [bytes(r.choice(b"abcdet \xc3\xa9") for _ in range(r.randint(2, 16))) for _ in range(200)]
    pieces = [p for p in pieces if p not in own.ranks]
    assert [tuple(x) for x in own.forest.encode(pieces, 16)] == [own.tree.encode(p) for p in pieces]


def test_bpe_columns_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, token_ids string").withColumn("odd`name", F.struct(F.lit(1).alias("a b")))
    out = bpe.decode_documents(bpe.encode_documents(df, RANKS), RANKS).collect()
    assert sorted((r.decoded.decode(), len(r.token_ids)) for r in out) == [("", 0), ("", 0), ("hello world", 2)]
    rows = bpe.round_trip(df, RANKS).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {1: 2, None: 0, 2: 0}
    assert bpe.round_trip(df.limit(0), RANKS).count() == 0


# -- 2 -------------------------------------------------------------------------------------------------------------


def test_packing_ids_equal_tokenizers(odd_texts):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(TOKENIZER)
    odd_texts = [*odd_texts, "hello <|endoftext|> world", "<|endoftext|><|endoftext|>x", "a  <|endoftext", "<|endoftext|>"]
    for text, data in zip(odd_texts, packing.TokenizerIds(TOKENIZER).encode(odd_texts)):
        assert np.frombuffer(data, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_places_every_piece(spark):
    texts = [(i, "tok " * n) for i, n in enumerate([0, 1, 5, 30, 31, 40, 64, 100, 200] * 4)] + [(99, None), (None, "x y")] + [(7, "same")] * 5
    pieces = packing.token_pieces(docs(spark, texts), TOKENIZER, 64).collect()
    placed = packing.pack_documents(docs(spark, texts), TOKENIZER, 64).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in pieces) == sorted((str(r.doc_id), r.piece, r.length) for r in placed)
    n = check_packing(placed, 64)
    assert n >= -(-sum(r.length for r in placed) // 64)
    for r in pieces:
        assert r.length == 64 or r.piece == 0
    assert packing.pack_documents(docs(spark, []), TOKENIZER, 64).count() == 0


def test_packing_of_one_hot_length(spark):
    df = docs(spark, [(i, "tok tok") for i in range(3000)] + [(5000, "tok " * 61)])
    placed = packing.pack_documents(df, TOKENIZER, 64).collect()
    n = next(r.length for r in placed if r.doc_id == 0)
    assert len({r.doc_id for r in placed}) == 3001 and check_packing(placed, 64) <= -(-3000 // (64 // n)) + 3


def test_packed_sequences_hold_the_ids(spark):
    rows = packing.packed_sequences(docs(spark, [(1, "one two"), (2, "three " * 50)]), TOKENIZER, 16).collect()
    assert all(len(r.ids) <= 16 for r in rows) and sum(r.ids.count(0) for r in rows) == 2


def test_plan_is_tight():
    r = random.Random(5)
    counts = {}
    for _ in range(4000):
        n = r.randint(1, 2048)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan_bins(counts)
    used = {}
    for uses, times in plan:
        assert sum(n * c for n, c in uses) <= 2048
        for n, c in uses:
            used[n] = used.get(n, 0) + c * times
    assert used == counts
    assert sum(t for _, t in plan) <= 1.02 * -(-sum(n * c for n, c in counts.items()) // 2048)


def test_crc_is_of_the_ids(spark):
    row = packing.token_pieces(docs(spark, [(1, "hello")]), TOKENIZER).first()
    ids = np.frombuffer(next(packing.TokenizerIds(TOKENIZER).encode(["hello"])), "<u4").tolist()
    assert row.ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


# -- 3 -------------------------------------------------------------------------------------------------------------


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "alone"), (3, None, None, "who")]
    rows = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for conv, perspective in {(r.conv_id, r.perspective) for r in rows}:
        own = sorted((r for r in rows if (r.conv_id, r.perspective) == (conv, perspective)), key=lambda r: r.char_start)
        text = "".join(r.rendered for r in own)
        for r in own:
            assert text[r.char_start : r.char_end] == r.rendered
            assert (r.mask_start is not None) == (r.speaker == perspective)
            if r.train:
                assert text[r.mask_start : r.mask_end].endswith("<|im_end|>")
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (3, "unknown")}
    assert len([r for r in rows if r.conv_id == 1 and r.perspective == "ann"]) == 4


def test_chat_empty_extra_and_long(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat.rotate(spark.createDataFrame([], kind)).count() == 0
    turns = [(1, i, ("ann", "bob")[i % 2], f"said {i}") for i in range(1200)]
    df = spark.createDataFrame(turns, kind).withColumn("copies", F.lit(9)).withColumn("perspective", F.lit("x")).withColumn("_block", F.lit(1))
    rows = sorted((r for r in chat.rotate(df).collect() if r.perspective == "ann"), key=lambda r: r.char_start)
    assert [r.turn for r in rows] == list(range(1200))
    assert all(a.char_end == b.char_start for a, b in zip(rows, rows[1:])) and rows[0].char_start == 0


# -- 4 -------------------------------------------------------------------------------------------------------------


def brute_top(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * (1 + 5 * (i % 7 == 0)) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, [0.0] * 8), (2001, [1e-9] * 8)]
    bad = [(3000, None), (3001, [1.0, None] + [0.0] * 6), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "COORDINATE_FROM", 0.2)  # so that both ways of pruning are used
    v = topk.integer_vectors(df)
    got = {}
    for x in topk.top_k(v, v.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    whole = [(i, [int(np.floor(256 * c)) for c in w]) for i, w in rows + rows[:3]]
    want = brute_top(whole, {i for i, _ in whole if i % 10 == 0}, 5)
    assert {q: [m[i + 1] for i in range(len(m))] for q, m in got.items()} == want


def test_top_k_small_tables(spark):
    v = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 0"), 5).collect()] == [(0, 1, 256 * 512)]
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_top_k_large_components_and_repeats(spark):
    big = [(0, [float(1 << 26)] * 4), (1, [float(1 << 26), 3.0, 0.0, 1.0]), (2, [-float(1 << 26)] * 4), (3, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in big], "vec_id long, embedding array<double>, v int")
    v = topk.integer_vectors(df)
    whole = [(i, [int(256 * c) for c in w]) for i, w in big]
    got = {}
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(v, v, 3).collect()
    for x in topk.top_k(v.where("vec_id <> 2"), v.where("vec_id = 3"), 3).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute_top([w for w in whole if w[0] != 2], {3}, 3)
    assert {q: [(i + 1, *m) for i, m in enumerate(ms)] for q, ms in want.items()} == {q: sorted(ms) for q, ms in got.items()}
    with pytest.raises(Exception, match="too large"):
        topk.integer_vectors(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()
    same = topk.integer_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [1.5, 1.0])], "vec_id long, embedding array<double>"))
    assert [(r.rank, r.vec_id) for r in topk.top_k(same, same.where("vec_id = 1"), 3).orderBy("rank").collect()] == [(1, 2), (2, 2), (3, 3)]


def test_top_k_skips_short_lanes(spark, monkeypatch):
    monkeypatch.setattr(topk, "LANE", 1)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * (100 if i < 1100 else 0.01) for _ in range(8)]) for i in range(6000)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in topk.top_k(v, v.where("vec_id % 500 = 0"), 5).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    want = brute_top([(i, [int(np.floor(256 * c)) for c in w]) for i, w in rows], set(range(0, 6000, 500)), 5)
    assert {q: [m[i + 1] for i in range(len(m))] for q, m in got.items()} == want


def test_top_k_of_equal_lengths_and_of_unequal_reach(spark, monkeypatch):
    monkeypatch.setattr(topk, "LANE", 1)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "BUCKET", 128)
    r = np.random.default_rng(7)
    unit = r.normal(size=(4000, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    # the second table's longest vectors all lie on one side, so that queries of the other side reach far down
    tall = np.concatenate([np.abs(r.normal(size=(200, 16))) * 9, r.normal(size=(3800, 16))])
    for m in (unit, tall):
        rows = [(i, v.tolist()) for i, v in enumerate(m)]
        v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        whole = np.floor(256 * m).astype(np.int64)
        got = {}
        for x in topk.top_k(v, v.where("vec_id % 20 = 0"), 5).collect():
            got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
        assert len(got) == 200
        for q, best in got.items():
            scores = whole @ whole[q]
            order = [i for i in np.lexsort((np.arange(len(m)), -scores)) if i != q][:5]
            assert [best[i + 1] for i in range(5)] == [(i, scores[i]) for i in order]


# -- 5 -------------------------------------------------------------------------------------------------------------


def test_html_main_text(spark):
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><header>top</header><nav><a href="/">home</a></nav><div class="cookie-notice">accept</div>'
        "<article><h1>Head &amp; more</h1><p>One<br>two  <b>three</b><p>four</article><div id='comments'><p>reader</p></div><footer>&copy;</footer></body></html>")
    rows = [(1, "http://a.example/x", page), (2, "http://a.example/y", page.replace("four", "five")), (3, None, None), (4, "odd", "<div>just text</div>"), (1, "http://a.example/x", page)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = "Head & more\nOne two three\nfour"
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, want.replace("four", "five"), len(want)), (3, "", 0), (4, "just text", 9)]


def test_html_template_slot_without_article(spark):
    page = '<body><div class="a1"><a href="/">x y z</a></div><div class="b2"><p>{}</p></div><div class="c3">tiny</div></body>'
    rows = [(i, "http://h.example/", page.format(f"long text of page {i} " * 10)) for i in range(5)]
    for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == (f"long text of page {r.page_id} " * 10).strip()


def main_texts(spark, pages):
    rows = [(i, "http://h.example/", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_containers_that_few_pages_have(spark):
    slug = lambda i: "".join("abcdefghij"[int(c)] for c in str(i + 100))
    mixed = [f"<body><article><p>intro {i}</p>" + (f"<figure class='wide'><p>seen {i}</p></figure><section id='part-{slug(i)}'><div><p>more {i}</p></div></section>" if i % 3 == 0 else "") + "</article></body>" for i in range(9)]
    assert main_texts(spark, mixed) == {i: f"intro {i}" + (f"\nseen {i}\nmore {i}" if i % 3 == 0 else "") for i in range(9)}
    # all text in containers of one page, beside one that all have
    long = lambda i: f"long text of page {i} " * 10
    named = [f"<body><div class='top'><a href='/'>x y z</a></div><div id='post-{slug(i)}'><p>{long(i)}</p></div><div class='c'>tiny {i}</div></body>" for i in range(9)]
    for i, text in main_texts(spark, named).items():
        assert text.split("\n")[0] == long(i).strip() and "x y z" not in text
    # articles that lie where few pages have them
    moved = [f"<body><main><p>lead {i}</p></main>" + (f"<div id='{slug(i)}'><article><p>body {i}</p></article></div>" if i < 2 else "") + "</body>" for i in range(9)]
    assert main_texts(spark, moved) == {i: f"lead {i}" + (f"\nbody {i}" if i < 2 else "") for i in range(9)}


def test_html_template_text(spark):
    # containers of text that all pages have go; phrases that repeat among a page's own text stay
    page = lambda i: (
        f"<body><div class='zz'><p>{'the same words on all pages ' * 20}</p></div><div class='yy'><p>Share this story</p><p>story {i} with words of its own</p>"
        + ("<section class='k'><p>Keep on reading</p></section>" if i % 4 else "") + ("<p>now and then</p>" if i % 3 == 0 else "") + "</div></body>")
    own = lambda i: f"Share this story\nstory {i} with words of its own" + ("\nnow and then" if i % 3 == 0 else "")
    assert main_texts(spark, [page(i) for i in range(12)]) == {i: own(i) for i in range(12)}
    dishes = [f"<body><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>egg {i}</p><h2>Method</h2><p>Cook {i}</p><div class='k'><p>All rights</p></div></article></body>" for i in range(6)]
    assert main_texts(spark, dishes) == {i: f"Dish {i}\nIngredients\negg {i}\nMethod\nCook {i}" for i in range(6)}
    # the same without an article; a section whose text differs on one page has text of its own
    plain = [d.replace("article", "div") for d in dishes]
    assert main_texts(spark, plain) == {i: f"Dish {i}\nIngredients\negg {i}\nMethod\nCook {i}" for i in range(6)}
    mixed = [f"<body><article><p>story {i}</p><section class='k'><p>Keep on reading</p>{'<p>but once</p>' if i == 3 else ''}</section></article></body>" for i in range(12)]
    assert main_texts(spark, mixed) == {i: f"story {i}\nKeep on reading" + ("\nbut once" if i == 3 else "") for i in range(12)}
    # copies of one page keep their text, and two pages say nothing about a template
    article = [f"<body><article><p>Share this story</p><p>story {i}</p></article></body>" for i in range(6)]
    assert set(main_texts(spark, article[:1] * 6).values()) == {"Share this story\nstory 0"}
    assert set(main_texts(spark, dishes[:1] * 6).values()) == {"Dish 0\nIngredients\negg 0\nMethod\nCook 0"}
    assert main_texts(spark, dishes[:2])[1] == "Dish 1\nIngredients\negg 1\nMethod\nCook 1\nAll rights"


def test_html_marks():
    own = lambda html: html_template.Page(html).text(set())
    for around in ("div class='page has-sidebar'", "div class='container no-sidebar'", "div class='site menu-open'", "form id='aspnetForm'", "div class='sidebar'"):
        assert own(f"<body><{around}><nav><a href='/'>home</a></nav><article><p>the text</p></article></{around.split()[0]}></body>") == "the text"
        assert own(f"<body><{around}><nav>short <a href='/'>home</a></nav><div><p>the text of this page</p></div></{around.split()[0]}></body>") == "the text of this page"
    page = "<article><p>one<ul class='menu'><li>x<ul><li>y</ul></li><li>z</ul><p>two<p class='notice'>n<p>three<ol class=\"comment-list\"><li>c<p>d</ol><ul><li>four</ul></article>"
    assert own(page) == "one\ntwo\nthree\nfour"
    for name in ("ad-slot", "share-tools", "related-posts", "advertorial-wrap", "post-share-buttons", "newsletter-panel", "site-notice-bar"):
        assert own(f"<article><p>one</p><div class='{name}'><p>not the text</p></div><p>two</p></article>") == "one\ntwo", name
    for name in ("social-history", "related-work", "notice-period", "share-price", "search-results-explained"):
        assert own(f"<article><p>one</p><div class='{name}'><p>the text</p></div></article>") == "one\nthe text", name
    assert own("<main><p>text</p></main><footer>a long line of the footer, more than the text</footer>") == "text"
    assert own("<article><p>text</p><div id='comments'><p>a comment that is longer than the text</p></div></article>") == "text"
    assert own("<title>only a title</title><p>t") == "t"
    assert own("<article>text<div id='comments'><article class='comment'>said</article></div><ul><li class='share'>a<ul><li>b<li>c</ul><li>d</ul></article>") == "text\nd"
    assert own("<article class='sponsored'>text</article><div id='comments'><article class='comment'>said by a reader</article></div>") == "text"


def test_html_takes_linear_time():
    import time

    for source in ("<a " * 350_000, "<a '\">" * 100_000, '<a ">" ' * 100_000, "<div>" * 100_000 + "x", "<ul><li>" * 50_000, "<div class='comment'><article class='comment'>" * 20_000, "<script>" * 100_000):
        began = time.process_time()
        html_template.Page(source).text(set())
        assert time.process_time() - began < 10, source[:20]


def test_html_template_equals_brute_force(spark):
    r = random.Random(7)
    common = ["Share this", "Read on", "All rights"]
    pages = []
    for i in range(30):
        parts = [f"<p>own text {i} {k}</p>" for k in range(r.randint(1, 4))] + [f"<p>{c}</p>" for c in common if r.random() < (0.95, 0.6, 1)[common.index(c)]]
        aside = f"<div class='kk'><p>Box text</p><p>own {i}</p></div><div class='kl'><p>Only box text</p><section class='km'><p>Deeper</p></section></div>" if i % 3 else ""
        pages.append(f"<body><article>{''.join(parts)}{aside}<div class='kn'><p>{'Now' if r.random() < 0.7 else 'Then'}</p></div></article></body>")
    seen = [html_template.Page(p) for p in pages]
    vectors, tokens = {}, {}
    for i, page in enumerate(seen):
        for path, times, *_ in page.rows():
            vectors.setdefault(path, [0] * 30)[i] = times

    def around(page, path):
        while True:
            yield path
            if path == 0:
                return
            path = page.above[path]

    for page in seen:
        for path, text, _ in page.blocks:
            token = vectors[html_template.spoken(path, text)]
            n = sum(t > 0 for t in token)
            tokens[path, text] = n >= 15 and (token in [vectors[p] for p in around(page, path)] or n >= 27)
    own = collections.Counter()
    for page in seen:
        for path, text, _ in page.blocks:
            for p in around(page, path):
                own[p] += 0 if tokens[path, text] else 1
    top = {p for page in seen for p, v in page.paths.items() if v[4] and not page.paths[page.above[p]][4]}
    want = {}
    for i, page in enumerate(seen):
        want[i] = "\n".join(text for path, text, _ in page.blocks if not tokens[path, text] or path in top or own[path])
    assert main_texts(spark, pages) == want
    assert any("Only box text" in p for p in pages) and not any("Only box text" in t or "Deeper" in t for t in want.values()) and any("Box text" in t and "Share this" in t for t in want.values())


def test_html_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>", "y")], "page_id long, url string, html string, text string").withColumn("_host", F.lit(1)).withColumn("kept", F.lit(2))
    assert [tuple(r) for r in html_template.extract(df).collect()] == [(1, "http://a.example/", "x", 1)]
    assert html_template.extract(df.limit(0)).count() == 0


def test_html_long_and_broken():
    assert html_template.Page("<div>" * 3000 + "x" + "<a href='" + "y" * 1000).text(set()) == "x"
    assert html_template.Page('<p title="a>b">t</p><!-- c <p>no</p> --><p>u').text(set()) == "t\nu"


# -- 6 -------------------------------------------------------------------------------------------------------------


def test_toxicity_finds_planted_words(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice(("ba", "do", "ki", "lu", "mer", "ton")) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(("vileword", "nastything", "horrid"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.report(docs(spark, rows), l).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == int(x.doc_id % 4 == 0) for x in held) >= 0.95 * len(held)
    extra = docs(spark, [(9000, None), (9001, "")])
    assert all(0 <= x.score <= 1 for x in toxicity.report(docs(spark, rows).unionByName(extra), l).where("doc_id >= 9000").collect())
    assert toxicity.report(docs(spark, rows[:3]), l.limit(0)).where("score <> 0").count() == 0


def test_toxicity_features_equal_brute_force():
    import zstandard

    ordinary, toxic = b" and the other words of all texts " * 9, b" vileword  nastything "
    texts = ["and the other words", "so a vileword was said of all the other words that were", None, "", "nastything " * 40, "Vileword, and a nastything. " * 5]

    def one(window, behind):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, strategy=6, target_length=64, write_content_size=0, write_dict_id=0, write_checksum=0)
        held = zstandard.ZstdCompressionDict(ordinary + behind, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(window))

    for text, row in zip(texts, toxicity.measure(ordinary, toxic)(texts)):
        w = (text or "").lower().split()
        parts = [(" " + " ".join(w[i : i + 8]) + " " + "\n" * 16).encode() for i in range(0, len(w), 8)]
        saved = [max(0, one(p, bytes(len(toxic))) - one(p, toxic)) for p in parts]
        counts = [sum(d >= level for d in saved) for level in (1, 2, 3, 4, 5)]
        want = [*np.log1p(counts), *[c / max(1, len(parts)) for c in counts[:3]], max(saved, default=0), np.log1p(len(parts))]
        assert np.allclose(row, want)
    assert toxicity.measure(ordinary, toxic)(texts)[1][0] > 0 and toxicity.measure(ordinary, toxic)(texts)[0][0] == 0


def test_toxic_pieces_and_cut():
    assert toxicity.pieces("nastything", frozenset([" nast", "nasty"])) == [" nasty"]
    assert toxicity.pieces("a", frozenset()) == []
    assert b"vileword" in toxicity.train_toxic([(b" vileword ", 40), (b" nastything ", 30), (b" horrid ", 20)])
    assert toxicity.best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == 0.5


def test_toxicity_clashes_and_repeats(spark):
    rows = [(i, " ".join(f"w{i}x{j} " + ("vileword" if i % 3 == 0 else "quiet") for j in range(8)), i) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, toxicity int").withColumn("_toxicity", F.lit("x")).withColumn("toxic", F.lit(7))
    l = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.keep_clean(df, l)
    assert out.dtypes == df.dtypes
    kept = out.collect()
    assert {r.doc_id for r in kept} == {i for i in range(120) if i % 3} and all(r.toxicity == r.doc_id for r in kept)
    assert toxicity.report(df.limit(0), l).count() == 0
    long = toxicity.report(docs(spark, [(r[0], r[1]) for r in rows] + [(500, "quiet calm speech " * 30000), (501, "quiet calm speech " * 300 + "vileword is here " * 40)]), l).where("doc_id >= 500").collect()
    assert {r.doc_id: r.predicted for r in long} == {500: 0, 501: 1}
    same = docs(spark, [(i, "the same words") for i in range(40)])
    assert toxicity.report(same, l.where("doc_id < 40")).where("predicted = 1").count() == 0


# -- 7 -------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, span):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    own = {}
    for d, w in words.items():
        for i in range(len(w) - span + 1):
            own.setdefault(tuple(w[i : i + span]), set()).add(d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if min(own[tuple(w[i : i + span])]) < d:
                gone[i : i + span] = [True] * span
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("span", [5, 12, 50])
def test_substrings_equal_brute_force(spark, span):
    import hashlib

    r = random.Random(span)
    rows = [(i, " ".join(r.choice("abcdefgh") + str(r.randint(0, 60)) for _ in range(r.randint(0, 150)))) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(span + 7))
    rows += [(100 + i, f"x{i} {passage} y{i} " + rows[i][1]) for i in range(15)] + [(200, rows[5][1]), (201, "z z " * 90), (202, "z " * 200), (203, None), (204, "")]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.report(docs(spark, rows), span).collect()}
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in brute_repeats(rows, span).items()}
    assert got == want


def test_substring_stage_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "s", 9, 1), (2, "new " + text, "t", 9, 2), (None, text, "u", 9, 3), (3, "short\ttext", None, 9, 4), (4, None, "v", 9, 5)], "doc_id long, text string, starts string, _cut int, _t int")
    out = substrings.dedup_substrings(df, length="_cut")
    assert out.dtypes == df.dtypes
    got = {r.doc_id: (r.text, r.starts, r._cut) for r in out.collect()}
    assert got == {1: (text, "s", 9), 2: ("new", "t", 3), None: (text, "u", 9), 3: ("short\ttext", None, 9), 4: (None, "v", 9)}
    assert substrings.report(df.limit(0)).count() == 0
    gone = substrings.dedup_substrings(docs(spark, [(1, text), (2, text)])).collect()
    assert {r.doc_id: r.text for r in gone} == {1: text, 2: ""}


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_edited_text_and_likeness(spark):
    import hashlib

    rows = [(10, "alpha beta gamma delta"), (20, "epsilon"), (30, None), (40, "zeta eta theta iota kappa"), (50, "alpha beta gamma delta")]
    got = {r.doc_id: r for r in simhash.edited_fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows)
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert got[d].n_chars == len(t) and 0 <= got[d].near_edited <= 1
    assert got[10].fingerprint == got[50].fingerprint and got[50].near_next == 1.0
    assert simhash.edited_fingerprints(docs(spark, rows[:1])).first().near_next == 1.0
    assert simhash.edited_fingerprints(docs(spark, [])).count() == 0


def test_fingerprints_of_repeated_ids_and_long_texts(spark):
    from collections import Counter

    long = " ".join(f"word{i % 900}" for i in range(2 * simhash.CHUNK + 77))
    df = docs(spark, [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma delta"), (2, long)]).withColumn("_block", F.lit(7)).withColumn("_kind", F.lit("x"))
    rows = simhash.edited_fingerprints(df).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 2]
    # votes by brute force, with the engine's own word hashes
    counts = Counter(long.split())
    hashed = {r.w: (r.a, r.b) for r in spark.createDataFrame([(w,) for w in counts], "w string").select("w", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()}
    weigh = lambda w: min(max(len(w) - 3, 0), 7) + 1
    votes, total = [0] * 128, sum(weigh(w) * n for w, n in counts.items())
    for w, n in counts.items():
        bits = (hashed[w][0] & (1 << 64) - 1) | (hashed[w][1] & (1 << 64) - 1) << 64
        for i in range(128):
            votes[i] += weigh(w) * n * (bits >> i & 1)
    want = sum(1 << i for i in range(128) if 2 * votes[i] > total)
    assert next(r.fingerprint for r in rows if r.doc_id == 2) == f"{want:032x}"


def test_next_document_over_many_blocks(spark):
    rows = [(i * i, f"text {i}") for i in range(500)]
    got = {r.doc_id: r.next_text for r in simhash.followed(docs(spark, rows)).where("_spare = 0").collect()}
    assert got == {i * i: f"text {(i + 1) % 500}" for i in range(500)}


def test_near_fingerprints_equal_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(128) for _ in range(30)]
    all_ = {f"{b:032x}" for b in base} | {f"{b ^ sum(1 << k for k in r.sample(range(128), n)):032x}" for b in base for n in (1, 3, 6, 7, 9)}
    df = spark.createDataFrame([(x,) for x in all_], "fingerprint string")
    got = {(a.fingerprint, a.near_fingerprint, a.distance) for a in simhash.near(df).collect()}
    d = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {(a, b, d(a, b)) for a in all_ for b in all_ if a < b and d(a, b) <= 6}


@pytest.mark.parametrize("blocks, radius", [(8, 6), (8, 3), (4, 3)])
def test_near_of_a_hot_key_equals_brute_force(spark, monkeypatch, blocks, radius):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    r = random.Random(9)
    base = r.getrandbits(128) | 1 << 127
    # a third of all share 96 bits, so that one key of each table is hot
    all_ = {f"{base ^ r.getrandbits(5) ^ r.getrandbits(2) << 20:032x}" for _ in range(400)} | {f"{r.getrandbits(128):032x}" for _ in range(200)} | {"0" * 32, "f" * 32}
    asked = sorted(all_)[::7] + ["0" * 31 + "1", None]
    df, queries = (spark.createDataFrame([(x,) for x in xs], "fingerprint string") for xs in ([*all_, *sorted(all_)[:9], None], asked))
    found = [(a.fingerprint, a.near_fingerprint, a.distance) for a in simhash.near(df, queries, radius, blocks).collect()]
    d = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(a, b, d(a, b)) for a in asked if a for b in all_ if a != b and d(a, b) <= radius}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_near_counts_equal_brute_force(spark):
    r = random.Random(10)
    base = [r.getrandbits(128) for _ in range(40)]
    rows = [(i, f"{r.choice(base) ^ sum(1 << k for k in r.sample(range(128), r.choice((0, 0, 1, 3, 4)))):032x}", "x") for i in range(600)] + [(None, f"{base[0]:032x}", "y"), (20, f"{base[1]:032x}", "z"), (40, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, _cells string")
    d = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = sorted(((i, f, c, sum(d(f, g) <= 6 for _, g, _ in rows if g) - 1 if i is not None and i % 20 == 0 and f else None) for i, f, c in rows), key=str)
    assert sorted(map(tuple, simhash.near_counts(df).collect()), key=str) == want
    assert simhash.near_counts(df.limit(0)).count() == 0


# -- 9 -------------------------------------------------------------------------------------------------------------


def brute_join(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    rep = {}
    for d, s in sorted(sets.items()):
        if s:
            rep.setdefault(s, d)
    links = {d: [e for t, e in rep.items() if e != d and 5 * len(s & t) >= 4 * len(s | t)] for s, d in rep.items()}
    root = {d: d for d in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, bs in links.items():
        for b in bs:
            root[max(find(a), find(b))] = min(find(a), find(b))
    n = {}
    for s in sets.values():
        n[s] = n.get(s, 0) + 1
    return {d: (rep.get(s, d), n[s] if s else 1, len(links.get(rep.get(s), [])), find(rep[s]) if s else d) for d, s in sets.items()}


def test_jaccard_join_equals_brute_force(spark):
    r = random.Random(9)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randint(1, 150))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 50))):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1004, " \n")]
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in ngram_join.jaccard_join(docs(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_cells_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(10)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(200)] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in ngram_join.jaccard_join(docs(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_keep_one_and_components(spark):
    df = docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other"), (4, None), (None, "a b c d e f g")])
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(df).collect()) == ["1", "3", "4", "None"]
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 99)], "a long, b long")
    assert {(r.node, r.root) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(41)} | {(x, 99) for x in (99, 100, 101)}
    assert ngram_join.components(edges.limit(0)).count() == 0


def test_keep_one_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, None, 7)], "doc_id long, text string, _id int").withColumn("_text", F.lit(0)).withColumn("rep", F.lit(1))
    out = ngram_join.keep_one(df)
    assert out.dtypes == df.dtypes and sorted((r.doc_id, r._id) for r in out.collect()) == [(1, 5), (3, 7)]
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    rows = []
    for i in range(1000):  # sets of 200 shingles, of which two texts share 178: 178 / 222 = 0.802
        w = [f"w{i}x{j}" for j in range(204)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[22:] + [f"v{i}x{j}" for j in range(22)]))]
    got = ngram_join.jaccard_join(docs(spark, rows)).where("n_links = 1").count()
    assert got >= 0.999 * len(rows)


def test_long_texts_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(12)]
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in ngram_join.jaccard_join(docs(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_keep_one_texts_of_one_doc_id(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (3, a), (4, "v w x"), (4, None)]
    got = ngram_join.keep_one(docs(spark, rows)).collect()
    assert sorted(str(r.text) for r in got) == sorted([a, b, c, "v w x", "None"])
    assert {(r.doc_id, r.text) for r in got} <= set(rows)


# -- 10 ------------------------------------------------------------------------------------------------------------


def test_line_dedup_in_pairs_equals_brute_force(spark):
    import hashlib

    r = random.Random(12)
    passage = [f"passage line {i}" for i in range(60)]
    rows = [(d, "\n".join([f"own {d} {i}" for i in range(r.randint(0, 5))] + passage[r.randint(0, 5) : r.randint(30, 60)] + [f"end {d}"])) for d in range(12)] + [(20, "a\nb"), (21, "a\nb"), (22, "z\n" * 9)]
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
    seen, want, stay = set(), {}, 0
    for d, t in rows:
        ls = t.split("\n")
        x = list(map(h, ls))
        c = [i > 1 and (x[i - 2] * line_dedup.BASE % line_dedup.MODULUS + x[i - 1]) % line_dedup.MODULUS % line_dedup.SPREAD == 0 for i in range(len(x))]
        at = [i for i in range(len(x)) if i == 0 or c[i] and not c[i - 1] and i < len(x) - 1] + [len(x)]
        kept = []
        for a, b in zip(at, at[1:]):
            assert b - a > 1
            if tuple(ls[a:b]) not in seen:
                kept += ls[a:b]
            seen.add(tuple(ls[a:b]))
        want[d] = "\n".join(kept)
        stay += sum(line.startswith("passage") for line in kept) if d else 0
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, rows)).collect()} == want
    assert stay < sum(t.count("passage") for d, t in rows if d) / 4


def test_line_dedup_of_one_long_text(spark):
    text = "\n".join(f"line {i % 40000}" for i in range(200_000))
    row = line_dedup.report(docs(spark, [(1, text)])).first()
    assert row.n_lines == 200_000 and 100_000 < row.n_removed < 200_000


def test_line_dedup_texts_of_one_doc_id(spark):
    block, other = ("\n".join(f"{name} {i}" for i in range(30)) for name in ("line", "else"))
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs(spark, [(1, block), (2, block), (2, other)])).collect()}
    assert (1, block) in got and (2, other) in got and (2, block) not in got and len(got) == 3


def test_line_dedup_edges(spark):
    block = "\n".join(f"line {i}" for i in range(30))
    df = spark.createDataFrame([(1, block, "a"), (2, "own start\n" + block + "\nown end", "b"), (3, None, "c"), (4, "", "d"), (5, "one line", "e"), (6, "one line", "f"), (None, block, "g"), (1, block, "h")], "doc_id long, text string, source string")
    clash = df.withColumn("_ls", F.lit(1)).withColumn("_gone", F.lit(-1).cast("long")).withColumn("_key", F.lit("k")).withColumn("_kept", F.lit(2)).withColumn("n_removed", F.lit(3))
    out = line_dedup.dedup_lines(clash, length="_gone")
    assert out.dtypes == clash.dtypes
    rows = out.collect()
    assert {(r._ls, r._key, r._kept, r.n_removed) for r in rows} == {(1, "k", 2, 3)}
    got = {r.source: r.text for r in rows}
    assert got["a"] == block and got["h"] == block and got["g"] == block
    assert got["b"].count("line") <= 15 and got["b"].startswith("own start") and got["b"].endswith("own end")
    assert [got[k] for k in "cdef"] == [None, "", "one line", "one line"]
    assert {r.source: r._gone for r in rows} == {k: len(got["b"]) if k == "b" else -1 for k in "abcdefgh"}
    assert line_dedup.report(df.limit(0)).count() == 0


def test_line_dedup_of_odd_lines_equals_brute_force(spark):
    import hashlib

    r = random.Random(21)
    pool = ["", " ", "a", "b\r", "é", "x" * 3000, "\t", "same"]
    rows = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14))) if d % 9 else None) for d in range(150)]
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
    seen, want = set(), {}
    for d, t in rows:
        ls = (t or "").split("\n")
        x = list(map(h, ls))
        c = [i > 1 and (x[i - 2] * line_dedup.BASE % line_dedup.MODULUS + x[i - 1]) % line_dedup.MODULUS % line_dedup.SPREAD == 0 for i in range(len(x))]
        at = [i for i in range(len(x)) if i == 0 or c[i] and not c[i - 1] and i < len(x) - 1] + [len(x)]
        kept = []
        for a, b in zip(at, at[1:]):
            if b - a < 2 or tuple(ls[a:b]) not in seen:
                kept += ls[a:b]
            if b - a > 1:
                seen.add(tuple(ls[a:b]))
        want[d] = t if len(kept) == len(ls) else "\n".join(kept)
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, rows)).collect()} == want


def test_boundaries_resist_shifts(spark):
    text = "\n".join(f"unique line {i * 37 % 101}" for i in range(80))
    df = docs(spark, [(1, text), (2, "\n".join(["x", "y", "z"]) + "\n" + text)])
    a, b = (set(r._hash for r in line_dedup.chunks(df).where(F.col("doc_id") == i).collect()) for i in (1, 2))
    assert len(a & b) >= len(a) - 1
