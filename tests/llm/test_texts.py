import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, sample_docs, words
from pyspark.sql import functions as F

from corvane.llm import bpe, html_text, line_dedup, quality, unit_dedup


def brute_quality(text):
    w, found = words(text), {}
    for n in (3, 5, 10):
        seen: dict = {}
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append(i)
        found[n] = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = lambda at: sum(len(w[j]) for j in at)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(later), sum(len(x) for line in later for x in words(line)), len(found[3]), chars(found[5]), chars(found[10])


def test_quality_measures_equal_brute_force(spark):
    texts = [r[1] for r in sample_docs(3)] + ["ab " * 500, "x y z x y z", "\n\n", "a\n" * 4, "é ß\x0bé\tß é ß", "w" * 100_000 + " b", " ".join(map(str, range(40_000)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    measured = quality.measure_texts(df, sizes=(5, 10))
    names = [*quality.MEASURES, "chars_5", "chars_10"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in measured.collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert quality.measure_texts(df.limit(0)).count() == 0


def test_quality_keeps_prose_and_drops_repeats(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(1, prose), (2, "too short"), (3, "same words again " * 40), (4, "\n".join([prose] * 3)), (5, prose + " # # # # # # # # # #"), (6, None), (1, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "n_lines": F.lit(1)})
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1]


def test_bpe_equals_the_library(spark):
    pt = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    texts = [r[1] for r in sample_docs(4)] + ["ΟΔΥΣΣΕΥΣ Σ", "İ <|endoftext|>x<|startoftext|> y<|endoftext", "it's DON'T we've\u0085\x1c 123½ é é ﬁ 😀👩‍👧 한글", "a" * 20_000, "aB" * 5000 + "​", "\x00 \x1f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    coded = bpe.encode_documents(df)
    back = {r.doc_id: r.decoded for r in bpe.decode_documents(coded).collect()}
    for r in coded.collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), struct.pack(f"<{len(ids)}I", *ids))
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == back[r.doc_id]
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_bpe_forgets_words_when_full(monkeypatch):
    pt = pytest.importorskip("public_tokenizers")
    model = bpe.Bpe(pt.path("word_bpe_49k.json"))
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    whole = model.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    model.known.clear()
    assert model.encode(text) == whole and len(model.known) <= 5
    assert np.frombuffer(whole, "<u4").max() < 49_408


def brute_units(rows, run_words=1):
    """(doc_id, text, start, length, first doc_id, words of its run) of each repeated unit; rows that repeat count once."""
    units, first = {}, {}
    for d, t in {(d, t) for d, t in rows if t}:
        at, mine = 0, []
        for line in t.split("\n"):
            pieces, begins = unit_dedup._sentences(line), at
            for p in pieces:
                if words(p):
                    mine.append((begins, len(line) if len(pieces) == 1 else len(p.rstrip(" \t")), len(words(p)), " ".join(words(p.lower()))))
                begins += len(p)
            at += len(line) + 1
        units[d, t] = mine
    rank = lambda d, v, i: (d is not None, d or 0, v, i)
    for (d, t), mine in units.items():
        for i, u in enumerate(mine):
            first[u[3]] = min(first.get(u[3], (9,)), (*rank(d, 0, i)[:2], t, i), key=lambda r: r if len(r) > 1 else (True, 1 << 60))
    out = set()
    for (d, t), mine in units.items():
        later = [first[u[3]] != (*rank(d, 0, i)[:2], t, i) for i, u in enumerate(mine)]
        for i, u in enumerate(mine):
            if later[i]:
                a = b = i
                while a and later[a - 1]:
                    a -= 1
                while b + 1 < len(mine) and later[b + 1]:
                    b += 1
                run = sum(x[2] for x in mine[a : b + 1])
                if run >= run_words:
                    out.add((d, t, u[0], u[1], run))
    return out


@pytest.mark.parametrize("run_words", [1, 6, 15])
def test_units_equal_brute_force(spark, run_words):
    rng = random.Random(4)
    said = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) + rng.choice([". ", "!  ", "? ", ".” "]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(said) if rng.random() < 0.5 else f"own {i} {rng.random()}. " + rng.choice(["", "\n", "\n\n"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(None, "A b c. D e f."), (200, None), (201, ""), (202, " \n "), (203, rows[3][1].upper()), rows[7], rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit("clash"), "version": F.lit("clash")})
    found = unit_dedup.repeated_units(df, run_words)
    texts = df.select("doc_id", F.xxhash64("text").alias("version"), "text").distinct()
    got = {(r.doc_id, r.text, r.start, r.length, r.run_words) for r in found.join(texts.withColumnRenamed("doc_id", "d"), (F.col("doc_id").eqNullSafe(F.col("d"))) & (found["version"] == texts["version"])).collect()}
    assert got == brute_units(rows, run_words) and got
    assert found.count() == len(got)


def test_short_repeated_lines_count(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(i, f"own text number {i}\n{line}\nmore {i}") for i in range(5)], "doc_id long, text string")
    assert sorted(r.doc_id for r in unit_dedup.repeated_units(df).collect()) == [1, 2, 3, 4]
    assert unit_dedup.repeated_units(df, 14).count() == 0


def test_units_are_cut_by_document_and_text(spark):
    said = "One two three four."
    rows = [(1, said), (2, f"{said} mine alone"), (2, "another text with this number"), (None, said), (None, "else"), (3, None), (4, ""), (2, f"{said} mine alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    cut = unit_dedup.without_units(df, unit_dedup.repeated_units(df))
    assert cut.columns == ["doc_id", "text", "start"]
    assert sorted((r.doc_id or 0, r.text or "") for r in cut.collect()) == [(0, said), (0, "else"), (1, ""), (2, " mine alone"), (2, " mine alone"), (2, "another text with this number"), (3, ""), (4, "")]
    assert unit_dedup.repeated_units(df.limit(0)).count() == 0


def test_lines_of_many_sites(spark):
    rows = [(i, f"own text {i}\n all rights \n\nfew", f"s{i % 7}" if i % 8 else None) for i in range(20)]
    rows += [(30, None, "s1"), (31, "", "s1"), (32, "all rights", "s9"), (33, "few sites\nfew sites", "s1"), (0, rows[0][1], rows[0][2])]
    rows = [(a, b.replace("few", f"few{a % 3}") if b and a < 30 and c in ("s1", "s2", "s3", None) else b, c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_removed": F.lit(9), "pos": F.lit(1)})
    sites: dict = {}
    first: dict = {}
    for d, t, s in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip(" \t\r"):
                sites.setdefault(x.strip(" \t\r"), set()).add(s)
                first[x.strip(" \t\r")] = min(first.get(x.strip(" \t\r"), (99, 99)), (d, p))
    wide = {x for x, s in sites.items() if len(s - {None}) >= 5}
    keep = lambda d, t: t and "\n".join(x for p, x in enumerate(t.split("\n")) if x.strip(" \t\r") not in wide or first[x.strip(" \t\r")] == (d, p))
    got = sorted((r.doc_id, str(r.text)) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted((d, str(keep(d, t))) for d, t, _ in rows) and wide
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><div id="cookie-notice"><p>We use cookies, many, many cookies, and more of them.</p></div>
%s<aside><p>Side text, with, commas, and, much, more, text, than, there, should, be, here.</p></aside>
<div class="comments"><p>First, comment, with, a, lot, of, commas, and, words, in, it, for, no, reason.</p></div>
<form><p>Sign up, now, please, for, our, letter.</p><button>Go</button></form><script>var x="<p>no</p>";</script><footer>&copy; us</footer></body></html>"""
ARTICLE = '<h2>Head&amp;line</h2><p>First  <b>pa</b>ra,\n with, some, text &lt;here&gt; that goes on for a while.<p>Second<br>one, no end tag, and a <a href="x">link</a> in it.<ul><li>item one<li>item two</ul><div class="share">Share!</div><!-- c --><p hidden>gone</p>'
TEXT = "Head&line First para, with, some, text <here> that goes on for a while. Second one, no end tag, and a link in it. item one item two"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="content">%s</div>', "<div><div>%s</div></div>", '<section id=story a="b"">%s</section>'])
def test_html_main_text(wrap):
    assert html_text.main_text(PAGE % (wrap % ARTICLE)) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<article><p class='notice'>Gone <b>here</b><p>%s</p></article>",
        "<article><p class='notice'>Gone<div><p>%s</div></article>",
        "<article><p class='notice'>Gone<hr>%s</article>",
        "<article><ul><li class='share'>Gone<li>%s</ul></article>",
        "<article><ul><li class='share'>Gone <a href='x'>too</ul><p>%s</article>",
        "<article><dl><dt class='share'>Gone<dd>%s</dl></article>",
        "<article><table><tr><td class='ad'>Gone<td>%s<tr class='ad'><td>Gone</table></article>",
        "<article><table><tr class='ad'><td>Gone<tr><td>%s</table></article>",
        "<div><aside><div>Gone</aside><p>%s</div>",
        "<div><div><nav><ul><li>Gone</div><p>%s</div>",
        "<article><p><b><span hidden>Gone</b>%s</article>",
        "<article><p><span hidden>Gone <span>and</span> gone <b>too</b></span>%s</article>",
        "<article><p><span hidden>Gone<p>%s</article>",
        "<ul><li><nav><li>Gone</li>Gone</nav>%s</ul>",
        "<html><head><meta name='x'><p>%s",
        "<article><div class='ad'><p>Gone<p>Gone<div>Gone</div>Gone</div><p>%s</article>",
    ],
)
def test_html_dropped_elements_end(page):
    text = "Rails were laid in spring, and the line was opened, late, by autumn."
    assert html_text.main_text(page % text) == text


@pytest.mark.parametrize(
    "start",
    [
        '<article aria-label="The hidden cost of rails">',
        '<article data-note="display: none" title=\'aria-hidden=true\'>',
        '<div title="class=sidebar id=\'ad\'" data-class="ad" data-role="menu">',
        '<div class="content no-sidebar">',
        '<div class="post has-comments">',
        '<div class="page-with-sidebar" id="noShare">',
        '<section class="sidebar-left" id="main">',
        '<div role="main" class="notice">',
    ],
)
def test_html_attributes_that_drop_nothing(start):
    text = "Rails were laid in spring, and the line was opened, late, by autumn."
    end = "</" + start[1:].split()[0] + ">"
    assert html_text.main_text(f"<body>{start}<p>{text}<b title='the hidden one'> Whole.</b></p>{end}</body>") == text + " Whole."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "a=b hidden c", "aria-hidden=true", "style='color:red; display : none'", "class='comment-body'", "class='post-share'", "id=adBox", "class=sidebar", "role=menu"])
def test_html_attributes_that_drop(attributes):
    text = "Rails were laid in spring, and the line was opened, late, by autumn."
    assert html_text.main_text(f"<article><p>{text}</p><div {attributes}><p>Gone, gone.</p></div></article>") == text


def test_quality_covers_all_lengths_of_repeats(spark):
    texts = [r[1] for r in sample_docs(4)] + ["a b c d e f g h " * 9, "p q r s t u v w x y z p q r s t u v w x", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = tuple(range(5, 11))
    got = {r.doc_id: [r[f"chars_{n}"] for n in sizes] for r in quality.measure_texts(df, sizes=sizes).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        for n, chars in zip(sizes, got[i], strict=True):
            at: dict = {}
            for j in range(len(w) - n + 1):
                at.setdefault(tuple(w[j : j + n]), []).append(j)
            inside = {k for js in at.values() if len(js) > 1 for j in js for k in range(j, j + n)}
            assert chars == sum(len(w[k]) for k in inside), (i, n)


def test_html_lists_of_links_in_an_article_are_text():
    items = "".join(f"<li><a href='{i}'>Report {i}</a></li>" for i in range(5))
    assert html_text.main_text(f"<article><p>Rails were laid, late, by autumn.</p><ul>{items}</ul></article>").endswith("Report 0 Report 1 Report 2 Report 3 Report 4")
    long = "".join(f"<li><a href='{i}'>A. Writer, The history of the northern railways, volume {i}, 1901</a></li>" for i in range(4))
    body = "<p>" + "Rails were laid, and the line was opened, late, by autumn. " * 6 + "</p>"
    assert "volume 3" in html_text.main_text(f"<div class='content'>{body}<ul>{long}</ul></div>")
    assert "Report" not in html_text.main_text(f"<div class='content'>{body}<ul>{items}</ul></div>")


def test_html_main_does_not_overrule_the_score():
    text = "<p>" + "Rails were laid, and the line was opened, late, by autumn. " * 6 + "</p>"
    box = "<div class='b7'><a href='x'>Weather today</a> <a href='y'>Match results</a> now</div>"
    got = html_text.main_text(f"<main><div class='a1'>{text}</div>{box}</main>")
    assert got.startswith("Rails") and "Weather" not in got


def test_html_sample_pages_without_article_tags(spark, sf_dir):
    """Recall and precision in words of the sample pages' articles when their tag is a plain div."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = wanted = both = 0
    for p in pages:
        want = html_text.main_text(p.html).split()
        got = html_text.main_text(p.html.replace("<article", "<div").replace("</article", "</div")).split()
        common = sum((Counter(want) & Counter(got)).values())
        found, wanted, both = found + len(got), wanted + len(want), both + common
    assert both >= 0.95 * wanted and both >= 0.95 * found, (both / wanted, both / found)


def test_html_deep_pages_take_linear_time():
    import time

    n = 100_000
    text = "Rails were laid, and the line was opened, late, by autumn. "
    pages = [
        "<div>" * n + text, "<div>" * n + "<p>" + text + "</div>" * n, "".join(f"<div><p>{i}" for i in range(n)), "<ul><li>" * n + text, "<ol>" * n + "<p>x" * n, "<section>" * n + "</div>" * n + text, "<table><tr>" * n + "<td>x" * n,
        "<svg>" * n + text, "<dl><dt>a<dd>b" * n, "<b>" * n + "</i>" * n + text, "<nav>" * n + "</nav>" * n + text, "<article><blockquote>" * n + text,
    ]
    for page in pages:
        began = time.process_time()
        got = html_text.main_text(page)
        assert time.process_time() - began < 15, page[:40]
        assert got


def test_html_lists_of_links_between_paragraphs_are_text():
    body = "<p>" + "Rails were laid, and the line was opened, late, by autumn. " * 6 + "</p>"
    items = "".join(f"<li><a href='#'>{x}</a></li>" for x in ("Smith 2001", "Jones 2003", "Lee 2004"))
    assert "Smith 2001 Jones 2003 Lee 2004" in html_text.main_text(f"<div class='content'>{body}<ul>{items}</ul>{body}</div>")
    assert "Smith" not in html_text.main_text(f"<div class='content'><ul>{items}</ul>{body}{body}</div>")


def test_html_discussions_of_readers_go():
    body = "<p>" + "Rails were laid, and the line was opened, late, by autumn. " * 6 + "</p>"
    assert "Nice" not in html_text.main_text(f"<article>{body}<section class='reader-discussion'><p>Nice, I like it, a lot, really.</p></section></article>")


def test_html_odd_pages(spark):
    rows = [None, "", "no tags, just text", "<p>x", "<script>never closed", "<<<<" * 5000, "<a <a " * 20_000, "<p a='" * 2000, "<div>" * 20_000 + "deep, text", "<nav>only menu</nav>", "<p>" + "word, " * 100_000, "&nbsp;&#x41;&bogus;"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(rows)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert [got[i].text for i in (0, 1, 2, 3, 4, 8, 9)] == ["", "", "no tags, just text", "x", "", "deep, text", ""]
    assert got[10].n_chars == 600_000 - 1 and got[11].text == "A&bogus;"
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_sample_pages_are_whole(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = {p.page_id: " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", re.search("<article>(.*?)</article>", p.html, re.S)[1]))).split()) for p in pages}
    assert {r.page_id: r.text for r in html_text.op9_html_text(spark, sf_dir).collect()} == want
