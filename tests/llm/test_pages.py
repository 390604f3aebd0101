"""Operators over pages: URL filters and main text."""

import time

import duckdb
import pytest

from eventloom.llm import html_text, urls

SF = "/root/testdata/sf0.01"
LONG = "A long line of the text that is surely the main one, with many words. " * 3


def test_main_text_of_the_whole_table_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = c.sql(html_text.OP9_SQL).fetchall()
    got = [tuple(r) for r in html_text.op9_html_extraction(spark, SF).collect()]
    assert len(got) == 250 and all(n for *_, n in got) and sorted(got) == sorted(want)


def test_the_sums_decide():
    page = f"<div>home</div><div>about us</div><div>contact</div><div>{LONG}</div><p>short</p><div>{LONG}</div><div>x</div><div>y</div><div>z</div><div>imprint</div><div>terms</div>"
    got = html_text.main_text(page)
    assert "home" not in got and "terms" not in got and "imprint" not in got and f"{LONG.strip()} short {LONG.strip()}" in got
    lines, _, marked = html_text.lines_of(page)
    even = html_text._kept(lines, marked.standing(), sums_of=lambda weights: [1] * len(weights))
    assert even.startswith("home") and even.endswith("terms")
    # teasers in articles don't outweigh the text outside them, and the heavier of two articles is the main text
    assert LONG.strip() in html_text.main_text(f"<div>{LONG * 9}</div><article>teaser</article>")
    assert html_text.main_text(f"<div>{LONG}</div><article>{LONG * 2}</article><div>after</div>") == (LONG * 2).strip()


def test_nothing_of_an_article_is_dropped():
    short = "".join(f"<p>Yes {i}.</p>" for i in range(9))
    want = " ".join(f"Yes {i}." for i in range(9))
    page = f"<nav>menu</nav><article>{short}<p>{LONG * 5}</p>{short}<ul><li>a<li>b</ul></article><footer>end</footer>"
    assert html_text.main_text(page) == f"{want} {(LONG * 5).strip()} {want} a b"


def test_pages_without_an_article():
    assert html_text.main_text("<p>A short page of text.</p>") == "A short page of text."
    assert html_text.main_text(f"<nav>menu</nav><h1>T</h1><p>{LONG}</p><p>The end.</p><footer>f</footer>") == f"T {LONG.strip()} The end."


@pytest.mark.parametrize(("page", "text"), [("tail <b", "tail"), ("a < b and </3 ok", "a < b and </3 ok"), ("<p>x<a title=\"unclosed>y</a> z</p><p>more", "xy z more"), ("x<!-- never closed <p>y", "x"), ("<a b='>'>x</a>", "x"), ("<article><div class='share-price-analysis'>prices</div></article>", "prices"), ("<article>x<div class='share-buttons'>tweet</div></article>", "x"), ("&lt;p&gt; &amp;amp;", "<p> &amp;")])
def test_broken_markup_and_names(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ['<a "x' * 200_000, '<a x="' * 170_000 + ">", "<a b='>'" * 120_000, "<div><p>" * 125_000 + "x", "</p" * 330_000, "<!--" * 250_000, "<" * 1_000_000, "<a '\"x>" * 140_000, "<p class='" + "ad x" * 250_000 + "'>y"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 4  # a page of about 1 MB: under half a second here, minutes if it were quadratic


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://a.com/en/1", "<p>x</p>", 5, "h"), (1, "http://a.com/en/1", "<p>x</p>", 5, "h"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, host string").selectExpr("*", "'t' AS text", "'v' AS verdict", "1 AS rules", "'s' AS short", "2 AS spread")
    assert sorted(map(str, map(tuple, html_text.extract_main_text(pages).collect()))) == sorted(map(str, [(1, "http://a.com/en/1", "x", 1)] * 2 + [(None, None, "", 0)]))
    got = urls.judge_urls(pages).collect()
    assert sorted((r.host, r.rule or "", r.verdict) for r in got) == [("", "", "allow"), ("a.com", "com/en/", "block"), ("a.com", "com/en/", "block")]


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_urls_with_colliding_prefixes_against_a_plain_judge(spark):
    rules = [*urls.RULES, *(("block" if i % 2 else "allow", f"h{i}.com", f"/p{i % 7}") for i in range(40)), ("allow", "h1.com", "/p1"), ("block", "a.h3.com", "")]
    asked = [f"http://{s}h{i}.com/p{i % 5}/x?q#f" for i in range(45) for s in ("", "www.", "A.")]
    asked += ["http://example.com/en/77", "https://x.NET/de/9", "ftp://example.net/de/8a", "no host", "://", "http://a.b.org/es/", "http://com/en/", "http://org?/es/", None, ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(asked * 2)], "page_id long, url string")
    want = sorted(repr((i, *plain_judge(u, rules))) for i, u in enumerate(asked * 2))
    for short in (1, urls.SHORT):  # with one digit nearly every bucket holds rules that the full digest must tell apart
        assert sorted(repr(tuple(r)) for r in urls.judge_urls(pages, rules, short=short).collect()) == want
    with pytest.raises(ValueError, match="host"):
        urls.judge_urls(pages, [("block", "", "/x")])


def test_the_full_digest_is_no_join_key(spark):
    plan = urls.op6_url_filters(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "substring" in joins[0] and joins[0].count(" = ") == 1


def test_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_CHARS", 0)
    want = {tuple(r) for r in duckdb.sql(urls.OP6_SQL.replace("FROM pages", f"FROM '{SF}/pages.parquet'")).fetchall()}
    assert {tuple(r) for r in urls.op6_url_filters(spark, SF).collect()} == want
