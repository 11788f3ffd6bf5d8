"""Page texts, licences along paths, and the whole pipeline against a brute-force version."""

import re

import corpus_pipeline
from clozemill.llm import html_text, licences, pii, quality

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><div id="cookie-notice">We use cookies.</div><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><aside>Side text that is long enough to count</aside>
<article><h1>Head &amp; line</h1><p><b>First</b> para&shy;graph   with
 a <a href="x">link</a> and text.<br>Next<p>Be.<form><input>Field</form><ul><li>a<li>b</ul>
<table><tr><td>1<td>2</table><section class="comments"><p>Nice post!</section></article>
<div class="ad">Buy this now, it is a long advert text with many words.</div><footer>&copy; me</footer></body></html>"""


def test_article_without_the_rest():
    want = "Head & line First para­graph with a link and text. Next Be. a b 1 2"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("<article>", "<div>").replace("</article>", "</div>")) == want


def test_names_of_containers_are_not_those_of_what_they_lack():
    text = "A long first paragraph with quite a few words in it."
    page = f'<div class="layout with-sidebar"><div id="x"><p>{text}</p><p>{text}</p></div><div class="left sidebar">no</div></div>'
    assert html_text.main_text(page) == f"{text} {text}"


def test_values_of_attributes_are_not_names():
    text = "A long first paragraph with quite a few words in it."
    for tag in ('div style="overflow:hidden"', 'div class="overflow-hidden"', 'div data-hidden="false"', "div data-id='share'",
                'div data-x="a hidden b" title="id=share"', "div data-u=/posts/hidden-costs", 'div "hidden"', 'div aria-hidden="false"'):
        assert html_text.main_text(f"<{tag}><article><p>{text}</p></article></div>") == text, tag
        assert html_text.main_text(f"<article><{tag}><p>{text}</p></div></article>") == text, tag
    link = f'<article><p>{text} <a href="/posts/hidden-costs">more</a></p></article>'
    assert html_text.main_text(link) == f"{text} more"
    for tag in ("div hidden", "div HIDDEN=''", 'div class="x"hidden', 'div aria-hidden="true"', "div id=share", "div class='x ad'",
                'div role="search"'):
        assert html_text.main_text(f"<article><p>{text}</p><{tag}>gone</div></article>") == text, tag


def test_parts_of_an_article_stay_whatever_their_names():
    text = "A long first paragraph with quite a few words in it."
    for tag in ('section id="discussion"', 'h2 id="search"', 'section id="related-work"', 'div class="side-by-side"',
                'section class="discussion"', 'h3 class="notice"', 'p id="share-of-votes"'):
        name = tag.split()[0]
        for top in ("article", "main"):
            page = f"<{top}><p>{text}</p><{tag}>Part.</{name}><p>{text}</p></{top}>"
            assert html_text.main_text(page) == f"{text} Part. {text}", tag


def test_broken_and_odd_pages(spark):
    odd = {"": "", None: "", "plain &lt; text": "plain < text", "<p>a<p>b <i>c</i>d": "a b cd", "<!-- never closed": "",
           "<div><p>cut here</p><a hre": "cut here", "<script>x": "", "<p>one</b></i></p></div>two": "one two",
           "<p>nb&nbsp;sp &#65;&#x42; &am": "nb sp AB &am", "<ul><li>x<ul><li>y</ul><li>z</ul>": "x y z"}
    for page, text in odd.items():
        assert html_text.main_text(page) == text, page
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 3)],
                               "page_id long, url string, html string, n_chars int")
    out = html_text.query(df).collect()
    assert [len(r.text) for r in out] == [r.n_chars for r in out] and len(out) == 3
    assert html_text.query(df.limit(0)).count() == 0


def test_given_pages_equal_their_articles(spark, sf):
    import html
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        inner = re.sub(r"<[^>]*(>|\Z)", " ", re.sub(r"</?b>", "", inner))
        assert html_text.main_text(r.html) == " ".join(html.unescape(inner).split())


def test_given_pages_with_neutral_tags(spark, sf):
    """Without article elements densities alone find the same text."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        neutral = r.html.replace("<article", "<div").replace("</article>", "</div>")
        assert html_text.main_text(neutral) == html_text.main_text(r.html)


def test_densities_decide(monkeypatch):
    text = "A long first paragraph with quite a few words in it, and some more of them."
    noise = "".join(f"<div><span>x{i}</span><i>y</i></div>" for i in range(9))
    page = f"<body><div><div>{noise}</div></div><div id=c><h2>Head</h2><p>{text}</p><p>Short.</p><p>{text}</p></div></body>"
    want = f"Head {text} Short. {text}"
    assert html_text.main_text(page) == want
    linked = f'<body><ul>{"".join(f"<li><a href=x>{text}</a></li>" for _ in range(8))}</ul><div><p>{text}</p><p>{text}</p></div></body>'
    assert html_text.main_text(linked) == f"{text} {text}"
    plain = html_text.measured

    def turned(root):
        order = plain(root)
        for node in order:
            node.density = 1 / (1 + node.density) if node.chars else 0.0
        return order

    monkeypatch.setattr(html_text, "measured", turned)
    assert html_text.main_text(page) != want and html_text.main_text(linked) != f"{text} {text}"


def test_reader_comments_and_slots_inside_an_article():
    text = "A long first paragraph with quite a few words in it."
    for tag in ('section id="comments"', 'ol class="comment-list"', 'div class="comments-area"', 'div id="comment_form"',
                'div class="share-buttons x"', 'div class="ad-slot"', 'ul class="social-links"', 'div id="disqus_thread"',
                'section class="comments-section"'):
        name = tag.split()[0]
        page = f"<article><p>{text}</p><{tag}><p>Nice post!</p></{name}><p>{text}</p></article>"
        assert html_text.main_text(page) == f"{text} {text}", tag
    for tag in ('div class="commentary"', 'div class="ad-hoc"', 'p class="shares-sold"', 'ul class="list"', 'div class="comment-on-law"'):
        name = tag.split()[0]
        assert html_text.main_text(f"<article><p>{text}</p><{tag}>Part.</{name}></article>") == f"{text} Part.", tag


def test_quotes_that_never_close_and_cut_references():
    text = "A long first paragraph with quite a few words in it."
    assert html_text.main_text(f'<p>{text} <a href="x>more</a> text</p><p class=\'a\'>{text}</p>') == f"{text} more text {text}"
    assert html_text.main_text("<p>fish &amp<b>;</b> chips</p>") == "fish &; chips"
    assert html_text.main_text('<head><title>t</title><body><p title="a > b">one</p>') == "one"


def test_long_odd_pages_take_time_in_proportion():
    import time

    def seconds(page):
        t = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - t

    shapes = {
        "nested": lambda n: "<div class=a>" * n + "text" + "</div>" * n,
        "quotes": lambda n: "<a b=\"'>x " * n, "stray": lambda n: "<div><b>" * n + "</i></section>" * n,
        "inline": lambda n: "<b>" * n + "<p>x<hr>" * n, "items": lambda n: "<dt><li><tr><td>" * n,
    }
    for name, shape in shapes.items():
        short, long = seconds(shape(4_000)), seconds(shape(32_000))
        assert long < 24 * short + 0.5, (name, short, long)
    assert seconds("<div>" * 100_000 + "deep" + "</div>" * 100_000) < 20


def test_licences_come_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", f"x\n{mit}"), (2, "a/b/c/f.txt", "prose " * 500), (3, "a/b/COPYING", gpl.upper()),
            (4, "a/b/g.txt", f"text\n*** {mit} ###\nmore"), (5, "a/h.txt", None), (6, "z/i.txt", ""), (7, None, mit),
            (8, None, "x"), (9, "top.txt", "the license of this file is unknown and nothing is said about it here"),
            (4, "a/b/g.txt", f"text\n*** {mit} ###\nmore"), (10, "ab/j.txt", "x"),
            (11, "a/b/k.txt", "Licensed under CC BY-NC 4.0.\n" + "word " * 100_000)]
    df = spark.createDataFrame([(*r, "dir") for r in rows], "file long, path string, text string, dir string")
    out = {r.file: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan(df).collect()}
    assert out == {
        1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "a/b"), 3: ("GPL-3.0", "GPL-3.0", None), 4: ("MIT", "MIT", None),
        5: (None, "MIT", "a"), 6: (None, None, None), 7: ("MIT", "MIT", None), 8: (None, None, None),
        9: (None, None, None), 10: (None, None, None), 11: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)}
    assert licences.scan(df).count() == len(rows)
    assert licences.scan(df.limit(0)).count() == 0


def test_notices_inside_lines_and_over_several_lines(spark):
    mit = next(t for n, t in reversed(licences.TEMPLATES) if n == "MIT")
    wrapped = "".join(" * " + " ".join(mit.split()[i:i + 9]) + "\n" for i in range(0, len(mit.split()), 9))
    rows = {
        "Copyright 2019 Jane Doe and contributors of the widget project. Released under the MIT License. See the manual "
        "for details.": "MIT",
        "A paragraph of words about nothing in particular that goes on. Licensed under CC BY-NC 4.0. And so on it went "
        "for many more words.": "CC-BY-NC-4.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Released under the ISC License.": "ISC", "import os\n" * 30 + "/*\n" + wrapped + " */\n" + "x = 1\n" * 30: "MIT",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "The permission to copy this file was given. It is not free, and the license is unknown to all of us.": None,
        "Ein Satz auf Deutsch. Mit. Und noch ein Satz.": None, "Land ho. Nd! By! And on it went.": None}
    df = spark.createDataFrame([(i, f"{i}/f.txt", t) for i, t in enumerate(rows)], "file long, path string, text string")
    out = {r.file: r.own_licence for r in licences.scan(df).collect()}
    assert [out[i] for i in range(len(rows))] == list(rows.values())


def test_no_line_that_reaches_the_threshold_is_left_out(spark):
    import math
    import random

    model, rng = licences.Model(), random.Random(1)
    parts = [licences.tokens(t) for _, t in licences.TEMPLATES]
    lines = []
    for i in range(600):
        own = list(rng.choice(parts))
        lines.append(" ".join(rng.sample(own, rng.randrange(len(own) + 1)) + ["noise"] * rng.randrange(4)))

    def best(line):
        tf = {w: line.split().count(w) * model.idf.get(w, model.other) for w in line.split()}
        norm = math.sqrt(sum(v * v for v in tf.values())) or 1.0
        return max(sum(tf.get(t, 0) * w for i, _, t, w in model.rows if i == k) / norm for k in range(len(parts)))

    files = spark.createDataFrame([(k, "\n".join(lines[k::6])) for k in range(6)], "file int, text string")
    found = {(r.file, r.line) for r in licences.candidate_lines(files, model).collect()}
    reach = {(i % 6, x) for i, x in enumerate(lines) if best(x) >= model.threshold}
    assert reach and reach <= found and len(found) < 600


def test_windows_against_every_window():
    """Where any window of joined units reaches the threshold, one is found, and it is about as near."""
    import math
    import random

    import numpy as np

    model, rng = licences.Model(), random.Random(5)
    table = licences.term_table(model)
    parts = [t for _, t in licences.TEMPLATES]
    foreign = [f"w{i}" for i in range(60)] + ["the", "of", "and", "is", "to", "mit"]
    hits = 0
    for trial in range(250):
        units = []
        for _ in range(rng.randrange(1, 4)):
            units += [" ".join(rng.choices(foreign, k=rng.randrange(1, 12))) for _ in range(rng.randrange(4))]
            own = rng.choice(parts).split()
            own = [w for w in own if rng.random() < rng.choice((1, 0.9, 0.6))]
            step = rng.choice((1, 3, 9, 40))
            units += [" ".join(own[i:i + step]) for i in range(0, len(own), step)]
        body = "\n".join(units).encode()
        data = np.frombuffer(body, np.uint8)
        value, _, start, _ = licences.words(data, np.array([0, len(data)]), licences.TERM)
        if not len(value):
            continue
        at = np.minimum(np.searchsorted(table[0], value), len(table[0]) - 1)
        unit = licences.Units(body, value, start, at, table[0][at] == value, table, model.other)
        n = len(unit.spans)
        every = [unit.cosine(i, j, k) for i in range(n) for j in range(i, min(n, i + 120)) for k in range(len(parts))] if n < 25 else [
            unit.cosine(i, j, k) for i in range(0, n) for j in range(i, n, 7) for k in range(len(parts))][:60_000]
        best = max((c for c, shared in every if shared > 2), default=0)
        mine = unit.windows(np.arange(len(parts)), model.threshold)
        got = max((c for i, j in mine for k in range(len(parts)) for c, s in [unit.cosine(i, j, k)] if s > 2), default=0)
        if best >= model.threshold + 0.02:
            hits += 1
            assert got >= model.threshold and got >= best - 0.1, (trial, best, got)
        assert not mine or got >= model.threshold - 1e-6
        words_of = model.idf
        tf = {}
        for w in licences.tokens(body.decode()):
            tf[w] = tf.get(w, 0) + 1
        norm = math.sqrt(sum((c * words_of.get(w, model.other)) ** 2 for w, c in tf.items()))
        dot = sum(tf.get(w, 0) * words_of[w] * v for i, _, w, v in model.rows if i == 3)
        assert abs(unit.cosine(0, n - 1, 3)[0] - dot / norm) < 1e-9
    assert hits > 60


def test_a_notice_spread_over_a_hundred_lines(spark):
    mit = next(t for n, t in reversed(licences.TEMPLATES) if n == "MIT")
    text = "plain prose of no kind\n" * 40 + "\n".join(f"# {w}" for w in mit.split()) + "\nmore prose of no kind" * 40
    df = spark.createDataFrame([(1, "a/f.txt", text), (2, "b/f.txt", "prose about nothing. " * 30_000)],
                               "file long, path string, text string")
    assert {r.file: r.own_licence for r in licences.scan(df).collect()} == {1: "MIT", 2: None}


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.query(docs).collect() if r.kept}
    low = {c: c + 32 for c in range(65, 91)}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low))
        return frozenset(zip(*[w[i:] for i in range(5)]))

    sets, gone = {i: shingles(rows[i].text) for i in sorted(kept)}, set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    left = {i for i in sets if root[i] == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(r.text.translate(low))
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))}
    for i in left:
        w = word.findall(rows[i].text.translate(low))
        if any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9)):
            gone.add(i)
    assert {r.doc_id for r in out} == left - gone and len(out) == len(left - gone)
    for r in out:
        text = rows[r.doc_id].text
        assert r.text == pii.redacted_text(text, pii.base_spans(text)) and r.n_chars == len(r.text)
    assert sorted(r.mix_position for r in out) == list(range(len(out)))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "personal_data", "mixing"]


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
