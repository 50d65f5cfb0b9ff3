"""Operators on single texts against brute force, the library's own results and held-out labels."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab.llm import bpe, chat_format, fingerprints, html_extraction, language_id, packing, quality_classifier, quality_rules, url_filter, word_tokens

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
LETTERS = "abcdeS'tTl  \n\t0129ª²½éÉÄßæİΣς中国😀ñ\u0303\u0301  !?<|>-_/.\u200b\x1f\x85Ⅷ٣"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for _ in range(800)] + ["a<|endoftext|>b <|startoftext|>", "'s't're've'm'll'd''s !'s", "x" * 3000, "", "ab" * 2000]


def test_ids_are_the_librarys(texts):
    path = word_tokens.vocabulary()
    library, own, kept = word_tokens.tokenizer(path), bpe.encoder(path), word_tokens.library_ids(path)
    for text, raw, (n, ids, decoded) in zip(texts, kept.encode(texts), own.summaries(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert raw == np.array(expected, "<u4").tobytes()
        assert (n, ids, decoded) == (len(expected), " ".join(map(str, expected)), library.decode(expected, skip_special_tokens=False))
        assert own.encode(text) == expected


def test_bpe_columns(spark, odd, no_docs):
    found = odd.select("text", bpe.bpe_ids(F.col("text")).alias("ids"), bpe.bpe_summary(F.col("text")).alias("r")).select("*", bpe.bpe_text(F.col("ids")).alias("t")).collect()
    assert all(len(r.ids) == r.r.n_tokens and sha(r.t) == r.r.decoded_sha256 for r in found)
    assert no_docs.select(bpe.bpe_summary(F.col("text"))).isEmpty()


def pieces_hold(found, docs, largest=4096):
    """Every id of every document in one piece, sequences without gaps, full at powers of two."""
    library = word_tokens.tokenizer(word_tokens.vocabulary())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    for i, rows in found.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[i])) and zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset == rows.length.cumsum() - rows.length).all()
        total = int(rows.length.sum())
        assert total <= largest and total & (total - 1) == 0


def test_packing(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    found = packing.op3_packing(spark, SF).toPandas()
    assert set(found.doc_id) == set(docs.doc_id)
    pieces_hold(found, zip(docs.doc_id, docs.text, strict=True))
    cost = found.assign(c=found.length.astype(float) ** 2).groupby(["tier", "step_group"]).c.sum()
    assert cost.groupby("tier").apply(lambda c: c.max() <= 2.5 * max(c.median(), 1)).all()


def test_packing_of_odd_texts(odd, no_docs):
    assert packing.pack(no_docs).isEmpty() or packing.pack(no_docs).count() == 0
    found = packing.pack(odd.where("doc_id <> 7")).toPandas()
    pieces_hold(found, [(r.doc_id, r.text) for r in odd.where("doc_id <> 7").collect()])
    assert packing.pack(odd.where("doc_id = 7")).selectExpr("sum(length) = sum(doc_tokens)").first()[0]


def brute_rules(text):
    raw = (text or "").encode()
    words = [w.decode() for w in raw.split()]
    lines = (text or "").split("\n")
    repeats = {}
    for k in range(len(words) - 2):
        repeats.setdefault(tuple(words[k : k + 3]), []).append(k)
    inside = {k + j for at in repeats.values() if len(at) > 1 for k in at for j in range(3)}
    dup = sum(1 for k, x in enumerate(lines) if x.encode().split() and x in lines[:k])
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), failed


def test_rules_against_brute_force(spark):
    found = {r.doc_id: r for r in quality_rules.op9_repetition_rules(spark, SF).collect()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(text)
        assert not (r.kept and r.base_failed)
        if labels.get(i) == 1 and not r.base_failed:
            assert r.kept


def test_rules_of_odd_texts(odd):
    for r in odd.select("text", quality_rules.repetition_rules(F.col("text")).alias("r")).collect():
        if r.text is None or len(r.text) < 1000:
            assert (r.r.n_words, r.r.word_chars, r.r.n_symbols, r.r.n_dup_lines, r.r.n_repeat_words, r.r.base_failed) == brute_rules(r.text)
        assert not r.r.kept


def test_language_of_held_out(spark, odd, no_docs):
    lang = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang")
    found = language_id.op8_language_id(spark, SF2).join(lang, "doc_id").where("held_out")
    assert found.selectExpr("avg(cast(lang = lang_pred as int))").first()[0] > 0.98
    trees = language_id.train(spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour", "fr")], "doc_id long, text string, lang string"))
    names = {r.doc_id: r.r for r in odd.select("doc_id", language_id.language_of(F.col("text"), trees).alias("r")).collect()}
    assert [names[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and names[8].lang_pred != "und"
    assert language_id.train(no_docs.withColumn("lang", F.lit("x"))) == {}
    assert language_id.identify(["abc"], {}) == (["und"], [0.0])


def test_code_lengths_are_exact():
    """Batches or not, a text costs the same, and frozen shares of each context sum to at most one."""
    docs = ["the cat sat", "the hat", "a cat"]
    codes, _ = language_id.grams(docs)
    counted = {n: np.unique(codes & np.uint32((1 << 8 * n) - 1), return_counts=True) for n in range(1, 5)}
    tree = language_id.ContextTree({n: (c.astype(np.int64), t) for n, (c, t) in counted.items()})
    every = np.arange(256, dtype=np.uint32) | (np.uint32(ord("t")) << 24 | np.uint32(ord("h")) << 16 | np.uint32(ord("e")) << 8)
    assert np.exp2(-tree.bits(every).astype(float)).sum() <= 1.0001
    assert np.allclose(tree.bits(np.concatenate([every, every]))[:256], tree.bits(every))


def test_quality_of_held_out(spark):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    found = quality_classifier.op5_quality_classifier(spark, SF2).join(labels, "doc_id").where("held_out").toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    assert (found.predicted == found.quality).mean() > 0.95


def test_quality_of_odd_texts(spark, odd, no_docs):
    stats = odd.select("doc_id", quality_classifier.text_statistics(F.col("text")).alias("stats"))
    model = quality_classifier.train(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.s for r in stats.select(quality_classifier.scorer(model)("stats").alias("s")).collect()} == {0.5}
    assert no_docs.select(quality_classifier.text_statistics(F.col("text"))).isEmpty()


def test_isotonic():
    assert quality_classifier.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0, 1.0])).tolist() == [0.5, 0.5, 2.0]


def test_fingerprints(spark, odd, no_docs):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    found = fingerprints.op1_lcp_fingerprints(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found.doc_id.tolist() == docs.doc_id.tolist()
    for k, text in enumerate(docs.text):
        following, quarter = docs.text[(k + 1) % len(docs)], len(text) // 4
        assert found.n_chars[k] == len(text) and found.edited_sha256[k] == sha(text[: len(text) - quarter] + following[:quarter])
    assert found.near_edited.median() > 0.65 and found.near_next.median() < 0.1
    alone = [fingerprints.to_string(fingerprints.parse([x])[0]) for x in docs.text]
    assert found.fingerprint.tolist() == alone == [fingerprints.to_string(x) for x in fingerprints.parse(docs.text.tolist())]
    whole = fingerprints.fingerprints(odd).collect()
    assert len(whole) == 10 and len({r.fingerprint for r in whole if r.doc_id in (6, 7)}) == 1
    assert {r.n_chars for r in whole if r.doc_id in (1, 2)} == {0}
    assert fingerprints.fingerprints(no_docs).isEmpty()


def test_equal_substrings_share_names_at_any_offset():
    draw = random.Random(1)
    core = "".join(draw.choice("abcdefgh ij") for _ in range(3000))
    a, b, c = fingerprints.parse([core, "some words before it. " + core, "".join(draw.choice("abcdefgh ij") for _ in range(3000))])
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.1
    assert fingerprints.likeness(fingerprints.from_string(fingerprints.to_string(a)), a) == 1.0
    assert fingerprints.to_string(fingerprints.parse(["x", core, ""])[1]) == fingerprints.to_string(a)


def kept(page):
    """(whether they are an article's, the page's blocks)."""
    return html_extraction.main_text(page)[:2]


def test_html_blocks():
    page = '<body><nav>m</nav><div class="ad">buy</div><article><h1>T &amp; U</h1><p><b>one<br>two <p>three<div class="comments"><p>me</div></article><footer>f</footer><script>var a="<p>";</script></body>'
    assert html_extraction.main_text(page) == (True, ["T & U", "one two", "three"], [False] * 3, ["m buy", "me f"])
    assert kept("") == (False, []) and kept("<p") == (False, ["<p"])


def test_html_keeps_text_behind_unclosed_elements():
    """Only scripts, styles and the like swallow what follows; other elements that are never closed hold nothing."""
    for odd in ('<svg width="1"/>', "<svg>", "<select><option>x", "<noscript>", "<template>", "<button>", '<canvas id="c">', "<video>"):
        found = kept(f"<article><p>one</p>{odd}<p>two</p></article><footer>f</footer>")[1]
        assert [t for t in found if t != "x"] == ["one", "two"], odd
    assert kept("<article><p>one</p><select><option>x</select><svg><text>no</text></svg><p>two</p></article>") == (True, ["one", "two"])
    assert kept("<p>one<script>var a = 1;") == (False, ["one"])


def test_html_class_words_inside_an_article():
    page = '<article><p class="market share">a</p><div class="search-history">b</div><h2 class="section-header">c</h2><div class="share-bar">no</div><p class="ad">no</p><div class="comments">no</div></article>'
    assert html_extraction.main_text(page) == (True, ["a", "b", "c"], [True, False, False], ["no no no"])


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "x</i>" * 20_000, "<b>" * 20_000 + "<p>a</p>" * 20_000, "<div>" * 40_000 + "x", "<li>x" * 40_000])
def test_html_parser_is_linear(page):
    import time

    began = time.process_time()
    html_extraction.main_text(page)
    assert time.process_time() - began < 5


def test_html_wrappers_keep_their_article():
    """Layout classes are no sidebars, and an article inside a dropped wrapper stays, but not one among comments."""
    for wrapper in ('div class="layout has-sidebar"', 'div class="no-sidebar"', 'div class="content with-nav"', 'div class="entry-header"', 'form id="aspnetForm"', 'div class="sidebar"', 'div class="widget banner"'):
        name = wrapper.split()[0]
        page = f"<body><nav>m</nav><{wrapper}><article><p>story</p></article></{name}><div class='site-footer'>f</div></body>"
        assert kept(page) == (True, ["story"]), wrapper
    assert kept('<article class="post related-posts"><div class="entry-header">title</div>own</article>') == (True, ["title", "own"])
    assert kept('<form><div>whole page</div><button>go</button></form>') == (False, ["whole page"])
    assert kept('<div class="layout has-sidebar"><p>open</p><div class="sidebar">s</div><div class="ad-slot">a</div></div>') == (False, ["open"])
    talk = '<div class="comments"><article>me too</article></div><aside><article>teaser</article></aside>'
    assert kept(f"<article>story{talk}</article>{talk}") == (True, ["story"])
    assert kept(f"<p>story</p>{talk}") == (False, ["story"])


def test_html_query_against_the_pages_own_articles(spark):
    """The query's text of each page is what stands between its article tags, by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if self.inside and tag in html_extraction.BLOCKS:
                self.parts.append("\n")
            elif self.inside and tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if self.inside and tag in html_extraction.BLOCKS:
                self.parts.append("\n")
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data.replace("\n", " "))

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    for r in html_extraction.op2_host_suffix_array(spark, SF).collect():
        parser = Article()
        parser.feed(pages.html[r.page_id])
        lines = [" ".join(x.split()) for x in "".join(parser.parts).split("\n")]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_html_doubtful_blocks_are_judged_by_their_host(spark):
    """A block of an article that is named like a notice goes if three pages of the host have it, and stays if it is a story's."""
    notice, body = "sign our letter today and share this with all your friends", lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, f"http://h.example/{k}", f'<article><p>{body(k)}</p><div class="share">{notice if k < 4 else body(100 + k)}</div></article>') for k in range(6)]
    rows += [(k, f"http://h.example/{k}", f"<article><p>{body(k)}</p><p>{notice}</p></article>") for k in range(6, 9)]
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(4)] == [body(k) for k in range(4)]
    assert [found[k] for k in (4, 5)] == [f"{body(k)}\n{body(100 + k)}" for k in (4, 5)]
    assert [found[k] for k in (6, 7, 8)] == [f"{body(k)}\n{notice}" for k in (6, 7, 8)]


PLAIN = ["notice", "alert", "comment", "replies", "menu", "banner", "login", "signup", "paywall", "toolbar"]


@pytest.mark.parametrize("hosts", [1, 2, 5])
def test_html_boxes_inside_an_article_go_by_name_and_links(spark, hosts):
    """On a host of any size: notices, menus, forms and comments by their names, lists of links by their links; a part that wraps
    the article stays, and so does a part of its own text under a doubtful name."""
    body = lambda k: [" ".join(f"w{k}x{b}y{j}" for j in range(20)) for b in range(3)]
    rows, want, k = [], {}, 0
    for name in [*PLAIN, "share", "related", "widget", "media"]:
        for _ in range(hosts):
            a, b, c = body(k)
            box = f'<div class="{name}"><p>box {k} of words</p></div>' if name in PLAIN else f'<ul class="{name}"><li><a href="#">one {k}</a></li><li><a href="#">two {k}</a></li></ul>'
            for page, text in ((f"<article><p>{a}</p>{box}<p>{b}</p><p>{c}</p>{box}</article>", [a, b, c]), (f'<article><div class="{name}"><p>{a}</p><p>{b}</p></div></article>', [a, b]), (f'<article><p>{a}</p><div class="media share">{b}</div></article>', [a, b])):
                rows.append((len(rows), f"http://{name}.example/{k}", page))
                want[len(rows) - 1] = "\n".join(text)
            k += 1
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == want
    talk = "".join(f'<div class="comment"><b>ann, today</b><p>{" ".join(body(k))}</p></div>' for k in range(40))
    assert kept(f'<article><p>{body(0)[0]}</p><div class="replies">{talk}</div></article>') == (True, [body(0)[0]])


def test_html_of_odd_tables(spark):
    """Null and repeated ids, repeated rows, null urls, a very long page, clashing column names, an empty table."""
    long = "<p>" + "word " * 200_000 + "</p>"
    schema = "page_id long, url string, html string, cls string, host string, text string, keys int"
    rows = [(i, u, h, "c", "h", "t", 1) for i, u, h in [(None, None, "<p>a</p>"), (None, None, "<p>a</p>"), (1, "x", "<article>b</article>"), (1, "http://h/", long), (2, "http://h/", None), (3, "http://h/", " \n ")]]
    found = html_extraction.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 1), (0, 1), (1, 1), (1, 999_999), (2, 0), (3, 0)]
    assert html_extraction.extract(spark.createDataFrame([], schema)).isEmpty()


def test_html_repeats_against_brute_force(spark):
    """The runs that open pages of one host lose, by comparing all windows of all pages as lists of words."""
    draw = random.Random(9)
    notices = [" ".join(f"n{k}w{j}" for j in range(draw.randint(8, 14))) for k in range(6)]
    pages = []
    for k in range(24):
        own = [" ".join(f"p{k}b{b}w{j}" for j in range(draw.randint(3, 30))) for b in range(3)]
        pages.append([x for b in own for x in ([draw.choice(notices)] if draw.random() < 0.4 else []) + [b]])
    rows = [(k, "http://h.example/", "".join(f"<div>{b}</div>" for b in p)) for k, p in enumerate(pages)]
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    streams = [" ".join(p).split() for p in pages]
    windows = [{tuple(s[i : i + 8]) for i in range(len(s) - 7)} for s in streams]
    for k, s in enumerate(streams):
        gone = set()
        for i in range(len(s) - 7):
            if sum(tuple(s[i : i + 8]) in w for w in windows) >= 3:
                gone |= set(range(i, i + 8))
        expected, at = [], 0
        for block in pages[k]:
            words = block.split()
            expected.append(" ".join(w for j, w in enumerate(words) if at + j not in gone))
            at += len(words)
        assert found[k] == "\n".join(x for x in expected if x)


def test_html_suffix_array_removes_what_pages_share(spark):
    notice = "Welcome to our site please read these terms of use before you go on"
    rows = [(k, f"http://h.example/{k}", f"<body><div>{notice}</div><div>story {k} tells of number {k * 7}</div></body>") for k in range(6)]
    rows += [(6, None, None), (7, "http://h.example/x", ""), (8, "http://one.example/", "<p>alone on its host with a long enough text to be a run</p>")]
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(6)] == [f"story {k} tells of number {k * 7}" for k in range(6)]
    assert found[6] == "" == found[7] and found[8].startswith("alone")
    alike = [(p, ["all the same words in a row here and there"]) for p in range(4)]
    assert html_extraction.unique_runs(alike) == [b[0] for _, b in alike]


def test_html_counts_runs_over_the_whole_host(spark):
    """A notice on three of 300 pages goes, however the host's tokens are dealt; one on two pages or on other hosts stays."""
    draw = random.Random(5)
    story = lambda: " ".join(f"w{draw.getrandbits(40)}" for _ in range(1000))
    notice, rare = ("the shop is closed on the second friday of the month", "the pool is open on the first sunday of the year")
    at = {7: notice, 120: notice, 250: notice, 30: rare, 200: rare}
    stories = [story() for _ in range(303)]
    rows = [(k, f"http://h.example/{k}", f"<p>{stories[k]}</p><p>{at.get(k, '')}</p>") for k in range(300)]
    rows += [(k, f"http://h{k}.example/", f"<p>{stories[k]}</p><p>{rare}</p>") for k in range(300, 303)]
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == stories[k] + (f"\n{rare}" if k in (30, 200) or k >= 300 else "") for k in range(303))


def test_html_copies_count_once(spark):
    """Five near copies, four exact ones and a page_id given three times keep their body and lose the notice of other pages."""
    notice = "you are reading the free edition of the town paper so please tell your friends"
    body = lambda name: " ".join(f"{name}{k}" for k in range(60))
    bodies = [f"{body('near')} seen {k} times {body('end')}" for k in range(5)] + [body("same")] * 4 + [body(f"own{k}x") for k in range(4)]
    rows = [(k, f"http://h.example/{k}", f"<div>{notice}</div><p>{b}</p>") for k, b in enumerate(bodies)]
    twice = "one page read three times on three days has a line that no other page has"
    again = [(99, "http://h.example/99", f"<p>{twice}</p><p>{body(f'day{k}x')}</p>") for k in range(3)]
    found = html_extraction.extract(spark.createDataFrame(rows + again, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found if r.page_id != 99} == dict(enumerate(bodies))
    assert all(r.text.startswith(twice) for r in found if r.page_id == 99)


def test_html_articles_keep_what_others_share(spark):
    """A line at the edge or in the middle of twelve articles is their own text, even if adverts of the host have it."""
    lead, body = "read this and all other stories of our paper in the app", lambda k: " ".join(f"a{k}x{j}" for j in range(60))
    rows = [(k, f"http://h.example/{k}", f'<main><div>{lead}</div><div>{body(k)}</div><div>{lead}</div></main><div class="ad">{lead}</div>') for k in range(12)]
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == "\n".join([lead, body(k), lead]) for k in range(12))


def test_window_ranks_against_brute_force():
    draw = random.Random(2)
    tokens = [draw.randint(0, 3) for _ in range(400)]
    rank = html_extraction.window_ranks(np.array(tokens), 8)
    keys = [tuple(tokens[k : k + 8]) for k in range(400)]
    assert sorted(range(400), key=lambda k: (keys[k], k)) == sorted(range(400), key=lambda k: (rank[k], k))


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = chat_format.op4_event_sourced_chat(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({chat_format.OP4_SQL})").fetchall())


def test_chat_fold_of_edits_and_regenerations(spark):
    log = [(1, 1, "a", "delta", "user", "Hel"), (1, 2, "a", "delta", "user", "lo"), (1, 3, "b", "delta", "assistant", "wrong"), (1, 4, "b", "regenerate", "assistant", ""), (1, 5, "b", "delta", "assistant", "right"), (1, 6, "a", "edit", "user", "Hi"), (1, 7, "c", "delta", "user", "gone"), (1, 8, "c", "delete", "user", None), (2, 1, "x", "delta", None, None)]
    found = chat_format.fold(spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")).collect()
    assert sorted((r.conv_id, r.seq, r.role, r.text) for r in found if r.conv_id == 1) == [(1, 1, "user", "Hi"), (1, 3, "assistant", "right")]
    assert [(r.role, r.text) for r in found if r.conv_id == 2] == [(None, "")]


def test_chat_escapes_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_start|>", "</s>[INST] ok [/INST]", "[\\\\INST]", "<s>", "plain < | >", "\\", "<\\\\|"]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select("x", chat_format.escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x and "<|" not in r.e and "</s>" not in r.e and "[INST]" not in r.e


def test_url_filter(spark):
    found = {r.page_id: r for r in url_filter.op6_url_ngrams(spark, SF).collect()}
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    learned = {url.split("://")[1].split("/")[0] for url, _ in url_filter.labelled_rows()}
    for i, url in zip(pages.page_id, pages.url, strict=True):
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None) and host not in learned
        assert r.verdict == (max(fits)[1] if fits else "block" if r.blocked_score >= 0.5 else "allow")


def plain_fit(rows):
    """The fit in plain Python: (grams of a url, weights)."""
    import math

    import xxhash

    def grams(url):
        host, path = url.split("://")[1].split("/", 1)
        out = []
        for mark, text in (("h", f"^{host}$"), ("p", f"^/{path}$")):
            for n in url_filter.GRAM_LENGTHS:
                out += [signed_hash(mark, text[i : i + n]) for i in range(max(1, len(text) - n + 1))]
        return out

    def signed_hash(mark, gram):
        seed = xxhash.xxh64_intdigest(mark, 42)
        h = xxhash.xxh64_intdigest(gram, seed)
        return (h - (h >> 63 << 64)) % url_filter.PLACES

    at = [grams(u) for u, _ in rows]
    w, v = [0.0] * (url_filter.PLACES + 1), [0.0] * (url_filter.PLACES + 1)
    for _ in range(url_filter.STEPS):
        g = [url_filter.DECAY * x for x in w[:-1]] + [0.0]
        for k, (_, y) in zip(at, rows, strict=True):
            z = sum(w[p] for p in k) / math.sqrt(len(k)) + w[-1]
            e = (1 / (1 + math.exp(-z)) - y) / len(rows) * (url_filter.BALANCE if y else 1)
            for p in k:
                g[p] += e / math.sqrt(len(k))
            g[-1] += e
        v = [url_filter.MOMENTUM * a + b for a, b in zip(v, g, strict=True)]
        w = [a - url_filter.RATE * b for a, b in zip(w, v, strict=True)]
    return w


def test_url_fit_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PLACES", 64)
    monkeypatch.setattr(url_filter, "STEPS", 12)
    rows = [("http://bet.biz/a", 1), ("http://casino-bet.com/xx", 1), ("http://library.org/a/b", 0), ("http://garden.net/", 0), ("http://news.de/en", 0)]
    found = url_filter.fit(spark.createDataFrame(rows, "url string, blocked int")).first().w
    assert np.allclose(found, plain_fit(rows), atol=1e-9)


def test_url_filter_on_held_out_urls(spark):
    """A fifth of the labelled table, by a hash, is not learned: unwanted urls are mostly blocked, wanted ones nearly all allowed."""
    import xxhash

    rows = url_filter.labelled_rows()
    out = {u for u, _ in rows if xxhash.xxh64_intdigest(u) % 5 == 0}
    model = url_filter.materialise(url_filter.fit(spark.createDataFrame([r for r in rows if r[0] not in out], "url string, blocked int")))
    held = spark.createDataFrame([(u, b) for u, b in dict(rows).items() if u in out], "url string, y int")
    found = url_filter.judge(held.select(F.col("url").alias("page_id"), "url"), model).join(held, F.col("page_id") == F.col("url"))
    share = {r.y: r.s for r in found.groupBy("y").agg(F.avg((F.col("blocked_score") >= 0.5).cast("int")).alias("s")).collect()}
    assert share[1] > 0.6 and share[0] < 0.05


def test_url_filter_of_odd_tables(spark):
    """Null urls and those without a host are allowed; repeated rows repeat, clashing columns do not matter, no labels allow all."""
    schema = "page_id long, url string, host int, path int, w string, verdict string"
    model = url_filter.materialise(url_filter.fit(url_filter.labelled_urls(spark)))
    rows = [(i, u, 1, 2, "w", "v") for i, u in [(None, None), (1, "x"), (1, "x"), (2, "http://poker-casino.biz/"), (3, "http://" + "a" * 100_000)]]
    found = url_filter.judge(spark.createDataFrame(rows, schema), model).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in found if r.page_id != 3) == [(0, "allow"), (1, "allow"), (1, "allow"), (2, "block")] and len(found) == 5
    assert url_filter.judge(spark.createDataFrame([], schema), model).isEmpty()
    none = url_filter.materialise(url_filter.fit(spark.createDataFrame([], "url string, blocked int")))
    assert {r.blocked_score for r in url_filter.judge(spark.createDataFrame(rows[:2], schema), none).collect()} == {0.5}


def test_url_parts_of_odd_urls(spark):
    odd = {None: ("", ""), "no scheme/a": ("", ""), "http://": ("", ""), "http://A.É?x": ("a.É", ""), "x://h#f": ("h", ""), "a://b://c/d": ("b:", "//c/d"), "http://h/p/\nq?z": ("h", "/p/\nq")}
    for url, expected in odd.items():
        host, path = url_filter.parts(F.lit(url).cast("string"))
        assert tuple(spark.range(1).select(host, path).first()) == expected
