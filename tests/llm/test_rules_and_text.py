"""URL rules, extraction and language identification against brute force and literal cases."""
import html
import re

from cohortspark.llm import language, url_filter
from cohortspark.llm.html_text import extract, main_text

SF = "/root/testdata/sf0.001"


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h.split(".")), len(p), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/123", "http://example.org/en/2", "http://notexample.org/es/", "x://com",
            "x://a.com/fr/", "x://a.com/fr", "x://a.com/de/y", "x://Ä.com/de/", "a://b://c.org/", "x://..org/", "x://org.?a", "x://example.org/es/", "x://example.org/es/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, extra string")
    rules = [*url_filter.PAGE_RULES, ("allow", "example.org", "/es/"), ("block", "com", "/f")]
    for size in (url_filter.TRIE_CHARS, 12):  # one trie, then several passes
        monkeypatch.setattr(url_filter, "TRIE_CHARS", size)
        got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
        for i, u in enumerate(urls):
            assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == brute_verdict(u, rules), u
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_extraction_edges(spark):
    assert main_text(None) == main_text("") == ""
    body = "<p>The cat and the dog were in the house of the man that is not at all to be with us for it as was by on.</p>" * 3
    page = f"<html><head><title>x</title></head><body><nav><a href=a>Home</a></nav><aside>More of this and that</aside><article><h1>Short&amp;head</h1>{body}<p>So.</p>" \
           f"<form>Name <input></form></article><section class='comments'><p>I think the text is bad and the author is of no use to us at all, is it not so.</p></section>" \
           f"<div id=cookie-notice>We use the cookies of the site.</div><script>var a='<p>the of</p>'</script><footer>&copy; me</footer></body></html>"
    assert main_text(page).split("\n") == ["Short&head", *[re.sub("<.*?>", "", body[:body.index("</p>")])] * 3, "So."]
    df = spark.createDataFrame([(1, None, "t"), (2, page, "t"), (2, page, "t")], "page_id long, html string, note string")
    rows = extract(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, len(main_text(page)), len(main_text(page))]


def test_extraction_of_whole_table(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        parts = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("</?(?:p|h1)>", "\n", article))).split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert main_text(r["html"]) == want, r["page_id"]


def test_language(spark, make_docs):
    rows = {r["doc_id"]: r for r in language.op6_language_id(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [d for d, r in rows.items() if r["held_out"]]
    assert len(rows) == len(truth) and sum(rows[d]["lang_pred"] == truth[d] for d in held) >= 0.98 * len(held)
    docs = make_docs([None, "", "123 !?", "the cat", "le chat", "le chat", "x" * 300_000], langs=["en", "en", "en", "en", "fr", None, None])
    model = language.fit(docs.where("lang is not null"))
    got = [(r["lang_pred"], r["score"]) for r in language.predict(docs.drop("score"), model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and [g[0] for g in got[3:6]] == ["en", *[got[4][0]] * 2] and all(0 <= g[1] <= 1 for g in got)
    assert {r["lang_pred"] for r in language.predict(docs.drop("score"), language.fit(docs.limit(0))).collect()} == {"und"}
