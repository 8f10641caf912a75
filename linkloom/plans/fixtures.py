"""Inputs for rules that captured test pages do not touch: made-up rows, as (columns, rows), put on sites of each page's own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

_ROUTES = "zgncjj.ajcass.com"
_PORTAL = "gggl.cbpt.cnki.net"
_PLAIN = "h.example"


TABLES: dict[str, tuple[str, list[tuple]]] = {
    "raw_urls": (
        "id int, raw string, base string, host string",
        [
            (1, "http:/h.example/a", None, _PLAIN),
            (2, "/x/http:/other.example/b", None, _PLAIN),
            (3, "http://h.example/x/https:/o.example/b", None, _PLAIN),
            (4, "javascript:void(0)", "http://h.example/", _PLAIN),
            (5, "MAILTO:a@b", None, _PLAIN),
            (6, "https://user:pw@H.Example:443//a//b", None, _PLAIN),
            (7, "http://o.example:8080//a//b", None, _PLAIN),
            (8, "http://o.example:99999/", None, _PLAIN),
            (9, "http://o.example:x/", None, _PLAIN),
            (10, "#/list?a=1", "http://h.example/p", _PLAIN),
            (11, "../c/./d", "http://h.example/a/b/e", _PLAIN),
            (12, "?p=2", "http://h.example/a/b?q=1", _PLAIN),
            (13, "#frag", "http://h.example/a/b?q=1", _PLAIN),
            (14, "//o.example/z", "https://h.example/a", _PLAIN),
            (15, "c d/{x}", "http://h.example/a/b", _PLAIN),
            (16, "ftp://h.example/", None, _PLAIN),
            (17, "blob:http://h.example/1", None, _PLAIN),
            (18, "  ", None, _PLAIN),
            (19, "http://h.example", None, _PLAIN),
            (20, "http://h.example/a/../b?z=1&utm_source=x&a=2#t", None, _PLAIN),
            (21, "/issue?id=3&x=1&title=", "http://zgncjj.ajcass.com/p", _ROUTES),
            (22, "#/other?b=&a=1", None, _ROUTES),
            (23, "relative", None, _PLAIN),
            (24, "..", "http://h.example/a/b/c", _PLAIN),
            (25, None, "http://h.example/a", _PLAIN),
        ],
    ),
    "queries": (
        "id int, query string",
        [(1, "b=2&a=1"), (2, "amp;a=1&AMP;amp;b=2"), (3, "utm_source=x&UTM_SOURCE=y"), (4, "a=&b"), (5, "a=x y&b=~*"), (6, "b=1&b=0&a=%C3%A9"), (7, "=1&&x=%2F"), (8, ""), (9, "a=1=2&from=z")],
    ),
    "seeds": (
        "id int, line string",
        [(1, "h.example"), (2, " HTTP://H.Example:80/a?b=1&a=2#f "), (3, "# note"), (4, ""), (5, "ftp://h.example/"), (6, "https://h.example:8443"), (7, "https://"), (8, "h.example/x?utm_term=1")],
    ),
    "unsafe": (
        "id int, raw string, host string",
        [
            (1, "http://h.example/user/Logout", _PLAIN),
            (2, "http://h.example/a?action=DELETE", _PLAIN),
            (3, "http://h.example/a?delete=1", _PLAIN),
            (4, "http://h.example/a?delete=0", _PLAIN),
            (5, "http://h.example/a?delete=0&op=delete", _PLAIN),
            (6, "http://h.example/a?action=delete&logout=no", _PLAIN),
            (7, "http://h.example/deleted", _PLAIN),
            (8, "http://h.example/a?do=login", _PLAIN),
        ],
    ),
    "kinds": (
        "id int, raw string, host string",
        [
            (1, "http://zgncjj.ajcass.com/home/index", _ROUTES),
            (2, "http://zgncjj.ajcass.com/x/waf_slider_verify.html", _ROUTES),
            (3, "http://zgncjj.ajcass.com/Magazine/MagazinePicList?id=1", _ROUTES),
            (4, "http://zgncjj.ajcass.com/magazine/getissuecontentlist", _ROUTES),
            (5, "http://zgncjj.ajcass.com/a/magazine/show/1", _ROUTES),
            (6, "http://zgncjj.ajcass.com/commonblock/sitecontentlist/2", _ROUTES),
            (7, "http://zgncjj.ajcass.com/commonblock/sitecontentdetail/2", _ROUTES),
            (8, "http://zgncjj.ajcass.com/#/index", _ROUTES),
            (9, "http://zgncjj.ajcass.com/#/search?year=2020", _ROUTES),
            (10, "http://zgncjj.ajcass.com/#/issueDetail?contentId=1", _ROUTES),
            (11, "http://zgncjj.ajcass.com/#/detail?id=1", _ROUTES),
            (12, "http://zgncjj.ajcass.com/#/enIndex", _ROUTES),
            (13, "http://zgncjj.ajcass.com/#/enIssue?contentId=1", _ROUTES),
            (14, "http://zgncjj.ajcass.com/#/people/1", _ROUTES),
            (15, "http://zgncjj.ajcass.com/#anchor", _ROUTES),
            (16, "http://gggl.cbpt.cnki.net/portal", _PORTAL),
            (17, "http://gggl.cbpt.cnki.net/portal/journal/portal/client/paper/1", _PORTAL),
            (18, "http://gggl.cbpt.cnki.net/portal/journal/portal/client/news/1", _PORTAL),
            (19, "http://gggl.cbpt.cnki.net/portal/journal/portal/journal/api/x", _PORTAL),
            (20, "http://gggl.cbpt.cnki.net/portal/journal/portal/client/paper_list/1", _PORTAL),
            (21, "http://gggl.cbpt.cnki.net/portal/other", _PORTAL),
            (22, "http://gggl.cbpt.cnki.net/api/x", _PORTAL),
            (23, "http://gggl.cbpt.cnki.net/Index.aspx?t=1", _PORTAL),
            (24, "http://gggl.cbpt.cnki.net/a/Quit.aspx", _PORTAL),
            (25, "http://gggl.cbpt.cnki.net/EditorB/x", _PORTAL),
            (26, "http://gggl.cbpt.cnki.net/WKB/PaperDigest.aspx?paperID=1", _PORTAL),
            (27, "http://gggl.cbpt.cnki.net/WKB/WKTextContent.aspx?contentID=1", _PORTAL),
            (28, "http://gggl.cbpt.cnki.net/WKB/WKTextContent.aspx?tp=1", _PORTAL),
            (29, "http://gggl.cbpt.cnki.net/WKB/WKTextContent.aspx?q=1", _PORTAL),
            (30, "http://gggl.cbpt.cnki.net/WKB/WKList.aspx?contentID=1", _PORTAL),
            (31, "http://gggl.cbpt.cnki.net/WKB/WKList.aspx", _PORTAL),
            (32, "http://gggl.cbpt.cnki.net/WKA3/error.aspx", _PORTAL),
            (33, "http://gggl.cbpt.cnki.net/WebPublication/index.aspx?mid=1", _PORTAL),
            (34, "http://h.example/", _PLAIN),
            (35, "http://h.example/#x", _PLAIN),
            (36, "http://h.example/article/1", _PLAIN),
            (37, "ftp://h.example/", _PLAIN),
            (38, "http://h.example/a.pdf", _PLAIN),
            (39, "http://h.example/js/a", _PLAIN),
            (40, "http://o.example/a", _PLAIN),
            (41, "http://h.example/cn/reader/view?id=1", _PLAIN),
            (42, "http://h.example/x?paperID=1", _PLAIN),
            (43, "http://h.example/uploadFile/a", _PLAIN),
            (44, "http://h.example/a/exportCitation.do?id=1", _PLAIN),
        ],
    ),
    "methods": ("method string", [(m,) for m in ("seed", "DOM", "api:{n}", "click", "click:{n}", "popup:{n}", "selector:{n}", "response:document", "response:script:{n}", "response:json", "response:xhr", "response:fetch", "download:{n}", "resume{n}", "")]),
    "issue_pages": (
        "source_url string, html string, host string",
        [
            ("http://h.example/cn/index", "<form action='issue_list.aspx?x=1'><a href=\"/cn/issue_list.aspx\">yearid[0]=\"2020\";yearid[1]='2021'; quarternameid[0]=\"2020:01:Q1\";quarternameid[1]=\"2021:2:Q\";quarternameid[2]=\"2019:3:Q\"", _PLAIN),
            ("http://h.example/none", "<a href='issue_list.aspx'>yearid[0]=\"2020\"", _PLAIN),
            ("http://gggl.cbpt.cnki.net/x", "<a href='issue_list.aspx'>yearid[0]=\"2020\";quarternameid[0]=\"2020:1:Q\"", _PORTAL),
        ],
    ),
    "onclicks": (
        "id int, value string, host string",
        [
            (1, "goNewList('c1','News & more')", _PORTAL),
            (2, "goNewList()", _PORTAL),
            (3, "goDownloadList('c2');", _PORTAL),
            (4, "goLinkpostList('c3', '')", _PORTAL),
            (5, "guokanTurnPageList('2020','1','y','i')", _PORTAL),
            (6, "guokanTurnPageList('2020','1','y')", _PORTAL),
            (7, "getChineseHtmlUrl('p1')", _PORTAL),
            (8, "gotoCNKINode('p2')", _PORTAL),
            (9, "tabPage('2020','1','2','client/paper_list','y','i')", _PORTAL),
            (10, "tabPage('2020','1','1','/portal/journal/portal/client/x','y','i')", _PORTAL),
            (11, "lastNextIssue('Last','2020','1','y','i')", _PORTAL),
            (12, "lastNextIssue('Last','2020','1','y')", _PORTAL),
            (13, "goNewList('c1')", _PLAIN),
            (14, "not a call", _PORTAL),
            (15, "other('x')", _PORTAL),
        ],
    ),
    "scripts": (
        "url string, source_url string, body string, host string",
        [
            ("http://zgncjj.ajcass.com/js/app.js", "http://zgncjj.ajcass.com/", "r=[\"/index\",'/search','/nothing',\"/issueDetail\"]", _ROUTES),
            ("http://h.example/js/app.js", "http://h.example/", "window.location.hash; {path:'/a/:id/b'},{path:'/a/:id/b'},{path:\"/\"},{to:'/c?b=2&a=1'}", _PLAIN),
            ("http://h.example/static/r", "http://h.example/", "createWebHistory(); {path:'/x'},{redirect:'/404'},{path:'/js/y'}", _PLAIN),
            ("http://h.example/js/none.js", "http://h.example/", "{path:'/lost'}", _PLAIN),
            ("http://o.example/js/app.js", "http://h.example/", "routes:[{path:'/other'}]", _PLAIN),
        ],
    ),
    "classic_starts": ("root string, url string, host string", [("http://gggl.cbpt.cnki.net/WKB/WKList.aspx", "http://gggl.cbpt.cnki.net/WKB/WKList.aspx?p=1", _PORTAL), ("http://gggl.cbpt.cnki.net/WKB/WKList.aspx", "http://gggl.cbpt.cnki.net/portal", _PORTAL)]),
    "classic_pages": (
        "source_url string, html string, host string",
        [
            ("http://gggl.cbpt.cnki.net/WKB/WKList.aspx?p=1", "<a href='WKList.aspx?p=2'><a href='WKList.aspx?p=3'><a href='/WKB/WKTextContent.aspx?contentID=1'>", _PORTAL),
            ("http://gggl.cbpt.cnki.net/WKB/WKList.aspx?p=2", "<a href='WKList.aspx?p=1'><a href='WKList.aspx?p=4'>", _PORTAL),
            ("http://gggl.cbpt.cnki.net/WKB/WKList.aspx?p=3", "<img src='showValidateCode.aspx'>", _PORTAL),
            ("http://gggl.cbpt.cnki.net/WKB/WKList.aspx?p=4", "", _PORTAL),
        ],
    ),
}

#: Hosts of the made-up sites.
HOSTS = r"(zgncjj\.ajcass\.com|gggl\.cbpt\.cnki\.net|[ho]\.example)"


def cases(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The made-up rows once for each captured page, with its page_id, on sites of its own: a host h is p<page_id>.h there.

    {n} in a text is the page's number. The rows are a constant of fixed size, exploded beside each page's id alone.
    """
    columns, rows = TABLES[name]
    fields = [c.split() for c in columns.split(", ")]
    made = F.from_json(F.lit(json.dumps([dict(zip((f for f, _ in fields), r, strict=True)) for r in rows])), f"array<struct<{', '.join(f'{f}: {t}' for f, t in fields)}>>")
    number = F.col("page_id").cast("string")
    own = lambda c: F.replace(F.regexp_replace(c, f"(?i){HOSTS}", F.concat(F.lit("p"), number, F.lit(".$1"))), F.lit("{n}"), number)
    one = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(made).alias("c"))
    return one.select("page_id", *[(own(F.col(f"c.{f}")) if t == "string" else F.col(f"c.{f}")).alias(f) for f, t in fields])
