"""Near duplicates, neighbours and the classifier against plain versions; the pipeline end to end."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablecloak.llm import ann, html_text, near_dup, packing, quality_rules, queries, secrets, weak_quality
from tablecloak.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(texts, k, percent=80):
    """Components by comparing everything with everything."""
    sets = {i: plain_set(t, k) for i, t in texts.items()}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_documents(spark, k):
    docs = queries.table(spark, SF, "documents")
    want, sizes = plain_components({r.doc_id: r.text for r in docs.collect()}, k)
    for r in near_dup.near_duplicates(docs, shingle_words=k).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_components_of_a_large_loose_group(spark):
    """Near copies of one text around the threshold: bucket representatives do not link them all."""
    pick = random.Random(11)
    base = [f"w{pick.randint(0, 999)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(pick.randint(0, 14)):
            words[pick.randrange(len(words))] = f"x{pick.randint(0, 10**6)}"
        texts[1000 - i] = " ".join(words)
    want, _ = plain_components(texts, 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, shingle_words=2).collect()}
    assert got == want and 1 < len(set(want.values())) < 150


def test_near_duplicates_of_odd_rows(spark):
    texts = [(5, "A b"), (3, "a B"), (9, None), (8, ""), (7, " \n"), (2, "one"), (1, "ONE"), (4, "É x"), (6, "é x"),
             (10, "a b"), (10, "a b"), (None, "a b"), (11, "a b"), (11, "x y z")]
    docs = spark.createDataFrame([(*r, 1) for r in texts], "doc_id bigint, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, shingle_words=2).collect())
    assert got == [(-1, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 3, False), (6, 6, True),
                   (7, 7, True), (8, 8, True), (9, 9, True), (10, 3, False), (10, 3, False),
                   (11, 3, False), (11, 11, True)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_hashes_do_not_depend_on_the_chunk(monkeypatch):
    text = ("some words of a text that is cut into parts " * 50).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = near_dup.shingle_sets(data, offsets, 3)[0]
    monkeypatch.setattr(near_dup, "CHUNK", 100)
    near_dup._powers.cache_clear()
    assert np.array_equal(whole, near_dup.shingle_sets(data, offsets, 3)[0])
    near_dup._powers.cache_clear()


def test_sketches_fill_and_estimate():
    pick = np.random.default_rng(5)
    a, b = (pick.integers(0, 1 << 62, 900).astype(np.uint64) for _ in range(2))
    b[:800] = a[:800]
    value, doc = np.concatenate((a, b, a[:1])), np.repeat([0, 1, 2], [900, 900, 1])
    sketch = near_dup.sketches(value, doc, 4, 252)
    assert (sketch[:3] != ~np.uint64(0)).all() and (sketch[3] == ~np.uint64(0)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 800 / 1000) < 0.12


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101)]
    labels = near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test"))
    assert {r.node: r.label for r in labels.collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# neighbours

def plain_nearest(ids, vectors, query, k):
    order = sorted((-sum(float(x) * float(y) for x, y in zip(vectors[query], v)), i)
                   for i, v in zip(ids, vectors.values()) if i != query)
    return order[:k]


def test_recall_on_the_table(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float32) for r in rows}
    found, hit = queries.op7(spark, "/root/testdata/sf0.01").collect(), 0
    asked = sorted(i for i in vectors if i % 20 == 0)
    for q in asked:
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        want = plain_nearest(list(vectors), vectors, q, 20)
        assert [m[0] for m in mine] == list(range(1, 21))
        for _, i, score in mine:
            assert score == pytest.approx(float(vectors[q].astype(float) @ vectors[i].astype(float)), abs=1e-12)
        hit += len({m[1] for m in mine} & {i for _, i in want})
    assert hit >= 0.9 * 20 * len(asked)


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]),
            (120, [None, 1.0]), (140, [float("inf"), 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [1.0, 2.0, 3.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    mine = lambda q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    assert mine(0) == [(1, 1.0), (2, 1.0), (3, 0.5), (20, 0.0)]
    assert mine(20) == [(3, 1.0), (0, 0.0), (1, 0.0), (2, 0.0)]
    assert {r.query_id for r in got} == {0, 20}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_an_id_with_several_vectors_counts_once(spark):
    rows = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (20, [0.5, 0.0]), (20, [1.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(1, 2, 0.5), (2, 1, 0.0), (3, 3, 0.0)]


def test_many_copies_and_unequal_norms_over_shards(spark):
    pick = np.random.default_rng(2)
    vectors = pick.normal(size=(400, 8)) * pick.uniform(0.1, 5, (400, 1))
    vectors[100:300] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), k=10, shard=50).collect()
    hit = 0
    for q in range(0, 400, 50):
        want = [i for _, i in plain_nearest(range(400), dict(enumerate(vectors)), q, 10)]
        hit += len(set(want) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 80


# classifier

def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    judged = queries.op8(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] >= 0.995 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] >= 0.95 * (counts[0, False] + counts.get((0, True), 0))


def test_classifier_on_odd_rows(spark):
    prose = "Some plain words in a row make a fair sentence, and then another one follows."
    rows = [(0, None), (1, ""), (2, " "), (3, prose), (3, prose), (4, "w " * 30000), (None, prose)] + [(10 + i, prose + f" {i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kept string")
    got = weak_quality.label_quality(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (0, 1, 2, 4)) and kept[3] and kept[None] and kept[20]
    assert weak_quality.label_quality(docs.limit(0)).count() == 0
    # ids that fill a third of the table do not enlarge the sample
    many = docs.union(docs.filter("doc_id IS NOT NULL").limit(1).crossJoin(spark.range(300)).drop("id"))
    assert weak_quality._sample_features(many, "doc_id", "text").groupBy("id").count().filter("count > 1").isEmpty()
    model = weak_quality.fit(docs)
    same = weak_quality.filter_quality(docs, model)
    assert same.columns == docs.columns and same.count() == sum(r.kept for r in got)


def test_label_model_finds_accuracies():
    pick = np.random.default_rng(1)
    junk = pick.random(20000) < 0.2
    votes = np.zeros((20000, len(weak_quality.LABELLERS)), int)
    votes[:, 0] = np.where(junk, pick.random(20000) < 0.9, pick.random(20000) < 0.001)
    votes[:, 1] = np.where(junk, pick.random(20000) < 0.6, pick.random(20000) < 0.002)
    patterns, counts = np.unique(weak_quality.pattern_of(votes), return_counts=True)
    model = weak_quality.fit_labels(patterns, counts.astype(float))
    assert ((model.posterior(votes) > 0.5) == junk).mean() > 0.98


@pytest.mark.parametrize("false_alarms", [0.002, 0.01])
def test_label_model_tells_false_alarms_from_junk(false_alarms):
    """Junk that several labellers see, and good rows that each of them blames now and then."""
    pick, k = np.random.default_rng(5), len(weak_quality.LABELLERS)
    junk = pick.random(40000) < 0.2
    right = np.linspace(0.6, 0.9, k)
    votes = np.where(junk[:, None], pick.random((40000, k)) < right, pick.random((40000, k)) < false_alarms).astype(int)
    patterns, counts = np.unique(weak_quality.pattern_of(votes), return_counts=True)
    model = weak_quality.fit_labels(patterns, counts.astype(float))
    assert max(abs(good - (1 - false_alarms)) for good, _ in model.accuracies().values()) < 0.02
    assert ((model.posterior(votes) > 0.5) == junk).mean() > 0.95


def zipf_text(n):
    pick = random.Random(1)
    known = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(2, 9))) for _ in range(9000)]
    words = pick.choices(known, [1 / (i + 2) for i in range(9000)], k=n)
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words))


def chinese_text():
    pick = random.Random(2)
    return "。\n".join("".join(chr(0x4E00 + int(pick.paretovariate(1) * 40) % 5000) for _ in range(pick.randint(8, 40)))
                       for _ in range(60))


def test_length_and_script_reject_nothing(spark):
    """A long text of a language with finitely many words, and one of a script without spaces, are as clean as others."""
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    both = spark.createDataFrame([(-1, zipf_text(150_000)), (-2, chinese_text())], "doc_id bigint, text string")
    assert all(r.kept and not r.base_failed for r in quality_rules.judge(both).collect())
    judged = weak_quality.classify(both, weak_quality.fit(docs)).collect()
    assert all(r.kept and "j" not in r.votes for r in judged)


def test_blocks_of_words():
    texts = ["a b a b", "x " * 450, " ".join(map(str, range(230))), "", "one"]
    data = "".join(texts).encode()
    m = weak_quality.measure_chunk(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert m["block_words"].tolist() == [4, 450, 230, 0, 1] and m["block_distinct"].tolist() == [2, 3, 230, 0, 1]
    assert m["block_pairs"].tolist() == [2, 3, 229, 0, 0] and m["block_places"].tolist() == [3, 449, 229, 1, 1]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">More</a></ul></nav><!-- ad -->
<div class="ad">Buy this now and never look back.</div><article><h1>The &amp; title</h1><p><b>First paragraph of the text,
with   breaks<br>and more words to make it long enough.<p>Second &eacute; paragraph, also with a <a href="x">link</a> inside it.</p>
<ul><li>point one<li>point two</ul><div class="share"><a href="#">Share</a></div></article><aside>Side bar text.</aside>
<section id="comments"><p>A reader writes a rather long comment about all of this, longer than the text itself was.</p></section>
<form>Sign up<input></form><footer>&copy; site</footer></body></html>"""


BLOCKS = ["The & title", "First paragraph of the text, with breaks and more words to make it long enough.",
          "Second é paragraph, also with a link inside it.", "point one", "point two"]


def test_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == BLOCKS


def test_main_text_without_an_article():
    page = ("<div id=top><a href=1>one</a> <a href=2>two</a></div><div class='wrap has-sidebar'><div>" + "".join(
        f"<p>Paragraph {i} has a number of words in it.</p>" for i in range(9)) + "</div></div><div><a href=3>three</a></div>")
    assert html_text.main_text(page).split("\n\n") == [f"Paragraph {i} has a number of words in it." for i in range(9)]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  ", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a\n\nb"), ("<p>a</b></i>b</p>", "ab"),
    ("<script>if (a < b) x();</script>", ""), ("<p>one<script>never closed", "one"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<table><tr><td>x<td>y</table>", "x\n\ny"), ("<!-- open <p>never", ""), ("<div>" * 3000 + "deep", "deep"), ("<head><p>text", "text"),
    ("<p don't>it's one</p><p>two</p>", "it's one\n\ntwo"), ("<p title='a > b'>kept</p>", "kept"), ("end <a href=1", "end <a href=1"),
    ("<div data-id='nav' data-role=navigation title='class=ad'>kept</div>", "kept"), ("<div id=nav>cut</div><p>kept", "kept"),
    ("<script>x<y =\"</script><p>one</p><p class=\"z\">two</p>", "one\n\ntwo")])
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


BODY = "<h1>Title</h1>" + "".join(f"<p>Sentence {i} of the article has a fair number of words in it.</p>" for i in range(12))


@pytest.mark.parametrize("page", [
    '<div class="layout-with-sidebar"><article>{}</article><div class="sidebar">Links to other things</div></div>',
    '<form id="aspnetForm"><div class="menu">Home</div>{}<input></form>', '<div class="page-search">{}</div><p>c</p>',
    '<div id="main-content" class="post social-post">{}<div class="comments"><p>' + "a reader writes " * 200 + "</p></div></div>",
    '<main><div class="widget-area">{}</div></main>', '<div class="comments-on"><div class="promo-box"><article>{}</article></div></div>',
    '<div role="search"><div class="ad-free">{}</div></div>'])
def test_layouts_named_after_their_parts(page):
    want = html_text.main_text(f"<article>{BODY}</article>").split("\n\n")
    got = html_text.main_text(f"<body><nav>n</nav>{page.format(BODY)}<footer>f</footer></body>").split("\n\n")
    assert [x for x in got if x != "c"] == want and len(want) == 13


@pytest.mark.parametrize("seed", range(40))
def test_generated_layouts(seed):
    """Wrappers of any name around the article, parts of any name beside it: the blocks of the article remain."""
    rng = random.Random(seed)
    names = sorted(html_text.CUT_NAMES - html_text.COMMENTS)
    name = lambda: rng.choice(names) if rng.random() < 0.6 else rng.choice(["wrap", "content", "page", "col-8"])
    body = BODY if rng.random() < 0.5 else f"<article>{BODY}</article>"
    for _ in range(rng.randint(0, 4)):
        side = [f'<div class="{rng.choice(names)}"><a href="#">one</a> <a href="#">two</a> more</div>' for _ in range(rng.randint(0, 2))]
        tag = rng.choice(["div", "div", "section", "form"])
        body = f'{"".join(side)}<{tag} class="{name()}" id="{name()}">{body}</{tag}><ul class="{rng.choice(names)}"><li><a href="#">x</a></ul>'
    page = f'<html><head><title>t</title></head><body class="{name()}"><header>Head</header>{body}<section class="comments">{"A comment of a reader. " * 60}</section></body></html>'
    assert html_text.main_text(page).split("\n\n") == html_text.main_text(f"<article>{BODY}</article>").split("\n\n")


@pytest.mark.parametrize("page", ["<div>" * 20000 + "text", "<div class=ad>" * 20000 + "text", "<div class=reply><div id=nav>" * 9000 + "text", "<b>" * 20000 + "<p>text</p>" * 20000,
                                  "<div>" * 2000 + "text" + "</section>" * 50000, "text<a href=\"x" * 20000, "text<!" * 50000])
def test_broken_pages_take_linear_time(page):
    start = time.time()
    assert html_text.main_text(page).startswith("text") and time.time() - start < 20


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "<p>é</p>" * 9000, "z")],
                                  "page_id bigint, url string, html string, text string")
    got, size = html_text.extract(pages).collect(), len("\n\n".join(BLOCKS))
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, size), (1, size), (2, 0), (3, 9000 * 3 - 2)]
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extract(pages.limit(0)).count() == 0


def test_pages_against_their_articles(spark):
    pages = queries.table(spark, SF, "pages").collect()
    got = {r.page_id: r.text for r in queries.op10(spark, SF).collect()}
    for r in pages:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html_text.clean(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert [" ".join(x.split()) for x in got[r.page_id].split("\n\n") if x] == [x for x in want if x]


# pipeline

def test_pipeline_against_plain_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_classifier"](spark, docs, SF)
    kept = {r.doc_id for r in queries.op8(spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and first.columns == columns
    second = stage["quality_rules"](spark, first, SF)
    kept &= {r.doc_id for r in queries.op1(spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in second.collect()} == kept and second.columns == columns
    third = stage["near_dedup"](spark, second, SF)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    want, _ = plain_components(texts, 5)
    kept = {i for i, top in want.items() if i == top}
    assert {r.doc_id for r in third.collect()} == kept and third.columns == columns
    fourth = stage["secret_scan"](spark, third, SF)
    assert fourth.columns == columns and fourth.count() == len(kept)
    for r in fourth.collect():
        assert not re.search("[0-9a-f]{24}", r.text) and r.n_chars == len(r.text)
        if not re.search(r"[0-9a-f]{24}|token|secret|passw|api_?key|AKIA", texts[r.doc_id], re.I):
            assert r.text == texts[r.doc_id]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == kept


def test_pipeline_on_odd_rows(spark, tmp_path):
    good = "Plain words stand in a row here and make one quite long and honest sentence"
    rows = [(1, good, "en"), (2, good, "en"), (3, None, "en"), (4, "", "en"), (5, "### " * 50, "en"), (None, good + " of its own kind, with more", "en")]
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    docs.write.parquet(path)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, None}
    alike = docs.filter("text IS NOT NULL AND text <> ''")
    left = corpus_pipeline.deduplicate(spark, alike.union(alike.filter("doc_id IS NULL")), str(tmp_path))
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 5] and left.columns == docs.columns
    empty = str(tmp_path / "none" / "documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint").write.parquet(empty)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
