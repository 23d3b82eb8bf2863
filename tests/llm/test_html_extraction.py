import html
import re

from fluxlake.llm import html_extraction as H


def test_the_labelled_table_is_learned():
    x, y = H.labelled()
    assert ((H.model().predict(x) >= 0.5) == y).all()


def test_articles_of_the_pages(spark, sf_dir):
    def want(page):
        m = re.search(r"(?s)<article>(.*?)</article>", page)
        return " ".join(html.unescape(re.sub(r"<br>|</?p>|</?h1>", " ", m[1]).replace("<b>", "").replace("</b>", "")).split())

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in H.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == want(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(want(r["html"]))


def test_boilerplate_of_other_kinds_goes():
    page = """<html><head><title>t</title></head><body><header><a href=/>Site</a></header><div class="sidebar">side text that is here for all to see</div>
    <article><h1>Head</h1><p>The first&nbsp;paragraph &amp; more<script>var x = "<p>no</p>";</script> of it.</p><!-- <p>not this</p> --><style>p{}</style>
    <form>name <input></form><p>Second &lt;one&gt;.</p></article><section id="comments"><p>A reader wrote that this is a fine text.</p></section><footer>foot</footer></body></html>"""
    assert H.extract(page) == "Head The first paragraph & more of it. Second <one>."


def test_edges(spark):
    rows = [(0, "u", None), (1, None, ""), (2, "u", "<p>"), (3, "u", "<article><p>unclosed <b>text"), (4, "u", "<article>x<!-- open"), (5, "u", "plain < text"), (None, "u", "<script>no end"), (3, "u", "<article><p>unclosed <b>text"), (6, "u", "<article><p>" + "word " * 100_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"]) for r in H.main_text(df).collect())
    assert got[0] == (-1, "") and got[1] == (0, "") and got[2] == (1, "") and got[3] == (2, "")
    assert [t for i, t in got if i == 3] == ["unclosed text"] * 2
    assert next(t for i, t in got if i == 6) == ("word " * 100_000).strip()
    assert H.main_text(df.limit(0)).count() == 0


def test_adverts_within_a_line_go():
    assert H.extract("<article><p>By <span class=ad>buy <b>this</b> now</span> end <em>of</em> it</p><p>More.</p></article>") == "By end of it More."
    assert H.extract("<p>By <span class='x sponsored'>buy this</span> end</p>") == "By end"


def test_pages_without_names_are_judged_by_words_and_links():
    text = " ".join(["lorem"] * 22)
    assert H.extract(f"<table><tr><td><a href=1>Home</a></td><td><a href=2>News</a></td></tr><tr><td>{text}</td></tr><tr><td><a>Next</a></td></tr></table>") == text
    used = set(H.model().feature.tolist())
    assert {0, 1} <= used  # own words and link density


def test_unmatched_end_tags_cost_nothing():
    import time

    def seconds(n):
        began = time.perf_counter()
        H.extract("<div>" * n + "</p>" * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 12 * max(0.02, seconds(10_000))


def test_classes_of_boxes_around_the_article_do_not_empty_the_page(spark, sf_dir):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    around = lambda h, a, b: re.sub(r"(<body[^>]*>)", lambda m: m[1] + a, h, count=1).replace("</body>", b + "</body>")
    changes = [
        lambda h: re.sub(r"<body[^>]*>", "<body class='single search'>", h), lambda h: around(h, "<div class='page login'>", "</div>"), lambda h: around(h, "<div class='has-sidebar sidebar-right'>", "</div>"),
        lambda h: around(h, "<div class=reader>", "</div>"), lambda h: re.sub(r"<article[^>]*>", "<article class='post tags popular'>", h),
    ]
    for h in pages:
        want = H.extract(h)
        assert want and all(H.extract(f(h)) == want for f in changes)


def test_marks_around_some_articles_still_count():
    page = "<article><p>The text of the page itself, which has some words.</p></article><div class=related><article><p>Another text that the reader may like as well.</p></article></div><section class=comments><article><p>I read this text and found it good.</p></article></section>"
    assert H.extract(page) == "The text of the page itself, which has some words."


def test_a_copyright_sign_in_a_long_paragraph_stays():
    long = "The sign \N{COPYRIGHT SIGN} stands for a right that an author has in a text, a picture or a piece of music, and it is older than most who use it today."
    assert H.extract(f"<article><p>First words.</p><p>{long}</p><p>&copy; The site</p></article>") == f"First words. {long}"
