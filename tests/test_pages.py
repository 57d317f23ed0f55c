"""Main text by readability, and hosts asked in turn."""

import re
import threading
import time
from collections import defaultdict

import duckdb
import pytest
from conftest import SF, same

from gleaner.functions.extraction import main_text
from gleaner.plans.queries import QUERIES, SQL
from gleaner.sources import fetch

LONG = "We look for an engineer who builds systems, writes well, and likes to work with others on things that last. "
NAV = '<nav><a href="/a">Hybrid jobs</a></nav>'

#: What a page holds, and its main text.
LAYOUTS = {
    "article": (f"{NAV}<article><h1>Dev</h1><p>{LONG}</p></article><footer>On-site footer, with commas, and more of them</footer>", f"Dev\n{LONG.strip()}"),
    "div, navigation within": (f"<div><div>{NAV}<p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG.strip()}\n{LONG.strip()}"),
    "words of a class": (f'<div class="content"><p>{LONG * 5}</p></div><div class="sidebar"><p>{LONG * 12}</p></div>', (LONG * 5).strip()),
    "an id says that it is the text": (f'<div id="job-post"><p>{LONG}</p></div><div><p>{LONG}</p></div>', LONG.strip()),
    "cells of a table": (f"<table><tr><td>Jobs</td><td>{LONG * 4}</td></tr></table>", f"Jobs {(LONG * 4).strip()}"),
    "links": (f'<div><p>{LONG}</p></div><div><p><a href="/b">{LONG * 2}</a></p></div>', LONG.strip()),
    "a list of links in it": (f'<div><p>{LONG}</p><ul><li><a href="/c">Another job, at another firm</a></li></ul></div>', LONG.strip()),
    "a paragraph beside it": (f"<div><div class=entry><p>{LONG * 5}</p><p>{LONG}</p></div><p>Apply by mail.</p><p>Or not</p></div>", f"{(LONG * 5).strip()}\n{LONG.strip()}\nApply by mail."),
    "said not to show": (f'<div><p>{LONG}</p><div style="display: none">on-site, {LONG}</div><p hidden>hybrid</p></div>', LONG.strip()),
    "seldom words, but nothing else": (f'<div class="comments"><p>{LONG * 6}</p></div>', (LONG * 6).strip()),
    "paragraphs that aren't closed": (f"<div><p>{LONG}<p>{LONG}<div>{LONG}</div></div>", "\n".join([LONG.strip()] * 3)),
    "a header of the article": (f"<header>Hybrid firm</header><article><header>Dev wanted</header><p>{LONG}</p></article>", f"Dev wanted\n{LONG.strip()}"),
    "no paragraphs": ("<div>Jobs</div><main>Dev</main>", "Dev"),
    "nothing": ("", ""),
    "elements without end": ("<div>" * 20_000 + LONG, LONG.strip()),
    "ends without beginning": (f"</p></div>{LONG}</b>", LONG.strip()),
}


def test_layouts(spark):
    rows = [(k, html) for k, (html, _) in LAYOUTS.items()] + [("null", None)]
    got = {r.k: r.m.text for r in spark.createDataFrame(rows, "k string, h string").select("k", main_text("h").alias("m")).collect()}
    assert got == {k: text for k, (_, text) in LAYOUTS.items()} | {"null": None}


@pytest.mark.parametrize("name", ["html_body_text", "html_main_text", "title_from_html"])
def test_pages_of_the_table(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["html_body_text", "html_main_text", "title_from_html", "ingest_by_url"])
def test_pages_with_references_and_prose_as_titles(spark, tmp_path, name):
    """References that are cut off, quoted or unknown, and a title that says ` at `: the SQL takes them as they stand."""
    words = "Words of the page, one &amp;&amp; two &lt;three&gt;, &quot;four&quot;&nbsp;five, and on &auml; and&amp"
    titles = ["Cut &amp;&amp; off&amp", "One token = &quot;0b96", "Was at the erhe the was eainat. Enesble", "&am", "&auml; & &#228; &lt;"]
    rows = [(4 * i + 2, "http://ex.com/", f"<html><head><title>{t}</title></head><body><article><p>{words}</p><p>{words} again, at length</p></article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(SQL[name]).df())


class Server:
    """Answers of hosts, with the times at which they were asked."""

    def __init__(self, refuse=()):
        self.asked, self.refuse, self.lock, self.now, self.most = defaultdict(list), set(refuse), threading.Lock(), defaultdict(int), 0

    def __call__(self, url):
        host = re.match("http://([^/]*)", url)[1]
        with self.lock:
            self.now[host] += 1
            self.most = max(self.most, self.now[host])
            self.asked[host].append(time.monotonic())
        time.sleep(0.01)
        with self.lock:
            self.now[host] -= 1
            first = url in self.refuse
            self.refuse.discard(url)
        if url.endswith("/lost"):
            raise OSError("no route")
        return {"status": 429, "retry_after": "31" if url.endswith("/long") else "0"} if first else {"status": 200, "body": url}


def test_hosts_wait_for_none_but_themselves():
    """Twenty hosts of five urls take the time of one, and each host's pauses hold."""
    server, pause = Server(), 0.1
    todo = [(f"h{h}", f"http://h{h}/{i}") for i in range(5) for h in range(20)]
    began = time.monotonic()
    got = dict(fetch.in_turn(todo, server, pause))
    assert time.monotonic() - began < 20 * 5 * pause / 4
    assert {u: a["body"] for u, a in got.items()} == {u: u for _, u in todo}
    assert server.most == 1
    assert all(b - a >= pause for times in server.asked.values() for a, b in zip(times, times[1:], strict=False))


@pytest.mark.parametrize("ahead", [1, 2, 100])
def test_each_url_is_answered_once(ahead):
    urls = [(h, f"http://{h}/{i}") for h, n in (("hot", 40), ("b", 3), ("c", 1)) for i in range(n)] + [("c", "http://c/lost"), ("d", "http://d/long")]
    server = Server(["http://hot/3", "http://b/0", "http://d/long"])
    got = list(fetch.in_turn(urls, server, 0.0, ahead=ahead))
    assert sorted(u for u, _ in got) == sorted(u for _, u in urls)
    wrong = {u: type(a).__name__ for u, a in got if isinstance(a, Exception)}
    assert wrong == {"http://c/lost": "OSError", "http://d/long": "RateLimited"}
    assert len(server.asked["hot"]) == 41 and len(server.asked["b"]) == 4 and len(server.asked["d"]) == 1


def test_nothing_to_ask():
    assert list(fetch.in_turn([], Server(), 0.1)) == []
