"""Results of the made-up inputs, worked out by hand from the rules; sql.keyed puts them on each page's sites."""

from __future__ import annotations

_R = "http://zgncjj.ajcass.com"
_P = "http://gggl.cbpt.cnki.net"
_J = f"{_P}/portal/journal/portal"
_KINDS = (
    "root guard ajcass_cms_archive ajcass_cms_issue ajcass_cms_article ajcass_cms_list ajcass_cms_detail root issue_search issue_detail "
    "detail english_index english_issue spa:people/1 root cbpt_portal_index cbpt_portal_article cbpt_portal_news cbpt_portal_api "
    "cbpt_portal_list cbpt_portal_aux cbpt_aux cbpt_aux cbpt_guard cbpt_aux cbpt_article cbpt_article cbpt_list page cbpt_article "
    "cbpt_list cbpt_guard page root page page unknown page page page page page page page"
).split()
_NOT_QUEUEABLE = {2, 15, 19, 22, 24, 37, 38, 39, 40, 43, 44}
_LEAVES = {10, 11, 13, 17, 21, 22, 23, 24, 25, 26, 27, 30, 32}
_HEAVY = {1, 3, 4, 6, 8, 9, 12, 15, 16, 20, 28, 29, 31, 33, 34, 35, 38, 39, 40, 43, 44}

GOLDEN: dict[str, tuple[str, list[tuple]]] = {
    "url_normalize_cases": (
        "id INTEGER, url VARCHAR",
        [
            (1, "http://h.example/a"),
            (2, "http://other.example/b"),
            (3, "https://o.example/b"),
            (4, None),
            (5, None),
            (6, "http://h.example/a/b"),
            (7, "http://o.example:8080//a//b"),
            (8, None),
            (9, None),
            (10, "http://h.example/#/list?a=1"),
            (11, "http://h.example/a/c/d"),
            (12, "http://h.example/a/b?p=2"),
            (13, "http://h.example/a/b?q=1#frag"),
            (14, "https://o.example/z"),
            (15, "http://h.example/a/c d/{x}"),
            (16, None),
            (17, "blob:http://h.example/1"),
            (18, None),
            (19, "http://h.example/"),
            (20, "http://h.example/a/../b?a=2&z=1#t"),
            (21, f"{_R}/#/issue?id=3"),
            (22, f"{_R}/#/other?a=1&b="),
            (23, None),
            (24, "http://h.example/a/"),
            (25, None),
        ],
    ),
    "page_kind": ("id INTEGER, kind VARCHAR", [(i, k) for i, k in enumerate(_KINDS, 1)]),
    "visit_rules": ("id INTEGER, queueable BOOLEAN, aggressive BOOLEAN, gentle BOOLEAN, with_leaves BOOLEAN", [(i, q := i not in _NOT_QUEUEABLE, q, q and i not in _LEAVES, q) for i in range(1, 45)]),
    "workload_class": ("id INTEGER, gentle VARCHAR, aggressive VARCHAR", [(i, "heavy" if i in _HEAVY else "light", "light" if i in _NOT_QUEUEABLE else "heavy") for i in range(1, 45)]),
    "issue_list_synthesis": (
        "source_url VARCHAR, issue_url VARCHAR",
        [("http://h.example/cn/index", f"http://h.example/cn/issue_list.aspx?year_id={y}&quarter_id={q}") for y, q in ((2020, 1), (2021, 2))],
    ),
    "onclick_urls": (
        "id INTEGER, url VARCHAR, ajax VARCHAR",
        [
            (1, f"{_J}/client/list/c1?title=News+%26+more", None),
            (2, None, None),
            (3, f"{_J}/client/download/c2", None),
            (4, f"{_J}/client/linkpost/c3", None),
            (5, f"{_J}/client/guokan_list?year=2020&issue=1&yearId=y&issueId=i", None),
            (6, None, None),
            (7, f"{_J}/journal/api/getChinesDownloadInfoByEnglishPaper?contentId=p1", None),
            (8, f"{_J}/journal/api/gotoCNKINodeUrl?id=p2", None),
            (9, f"{_J}/client/paper_list?year=2020&issue=1&pageNum=2&yearId=y&issueId=i", "portal:ajax:tabPage:2"),
            (10, f"{_J}/client/x?year=2020&issue=1&pageNum=1&yearId=y&issueId=i", None),
            (11, f"{_J}/journal/api/listPrePaperOrNextPaper/Last?year=2020&issue=1&yearId=y&issueId=i&pageNum=1&pageSize=10", "portal:ajax:lastNextIssue:last"),
            (12, None, None),
            (13, None, None),
            (14, None, None),
            (15, None, None),
        ],
    ),
    "portal_requests": (
        "source_url VARCHAR, raw_url VARCHAR, method VARCHAR",
        [
            (f"{_P}/portal", f"{_J}/client/paper_list", "portal:ajax:tabPage:2"),
            (f"{_P}/portal", f"{_J}/journal/api/listPrePaperOrNextPaper/last", "portal:ajax:lastNextIssue:last"),
            *[(f"{_P}/portal", url, f"portal:ajax:{m}:html") for m in ("tabPage:2", "lastNextIssue:last") for url in ("/portal/x/next", f"{_P}/portal/x/next")],
        ],
    ),
    "script_routes": (
        "url VARCHAR, raw_url VARCHAR, method VARCHAR",
        [
            *[(f"{_R}/js/app.js", f"{_R}/#{route}", "response:script:route") for route in ("/index", "/search", "/issueDetail")],
            ("http://h.example/js/app.js", "http://h.example/#/c?a=1&b=2", "response:script:route"),
            ("http://h.example/static/r", "http://h.example/x", "response:script:route"),
        ],
    ),
    "classic_expansion": ("root VARCHAR, url VARCHAR, depth INTEGER", [(f"{_P}/WKB/WKList.aspx", f"{_P}/WKB/WKList.aspx?p={p}", d) for p, d in ((1, 0), (2, 1), (4, 2))]),
}
