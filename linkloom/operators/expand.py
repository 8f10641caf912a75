"""Links out of captured API answers.

responses has SITE, source_url, url, http_method, post_body, content_type and body. Items of an answer are read as maps of
strings, which keeps apart a key that is missing and one that is null. Every expander gives rows (site…, source_url,
raw_url, method); pages that were requested by further addresses are found by joining responses with themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules
from ..functions.classify import shared_api
from ..functions.urls import part, query_params, starts_with_any, strip, with_query
from .extract import SITE, links_of_strings
from .graph import written
from .json_tree import strings, tree_items

KEYS = [*SITE, "source_url"]
ITEMS = "data array<map<string,string>>"


def _text(value: Column) -> Column:
    """value without white space around it; null counts as empty."""
    return strip(F.coalesce(value, F.lit("")))


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def distinct_responses(responses: DataFrame) -> DataFrame:
    """One row per request (address, method, body) of a site; of repeats the one seen from the first source stays."""
    key = ["site_key", "url", "http_method", "post_body"]
    rows = responses.withColumns({"http_method": F.coalesce("http_method", F.lit("GET")), "post_body": F.coalesce("post_body", F.lit(""))})
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "source_url").alias("r")).select(*key, "r.*")


def is_json(content_type: Column) -> Column:
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    return lowered.contains("application/json") | lowered.contains("+json")


def is_script(content_type: Column, url: Column) -> Column:
    return ~is_json(content_type) & (F.lower(F.coalesce(content_type, F.lit(""))).contains("javascript") | F.lower(url).endswith(".js"))


def known_routes(discoveries: DataFrame) -> DataFrame:
    """Rows (site_key, routes, issue_route) from rows (site_key, route): all routes of a site, whenever they were seen.

    Routes that are none of the fixed ones decide nothing and are left out, so a site has at most that many. The form of
    issue pages is the one the site uses; with both forms, the shorter name.
    """
    return discoveries.filter(F.col("route").isin(rules.ROUTE_PREFIXES)).groupBy("site_key").agg(F.collect_set("route").alias("routes"), F.min(F.when(F.col("route").isin("/issue", "/issueDetail"), F.col("route"))).alias("issue_route"))


def issue_url(item_id: Column, year: Column, issue: Column, title: Column, english: bool) -> Column:
    """The address of an issue's article; null without an id, and in the detailed form without year and issue."""
    base = lambda route: F.concat("site_origin", F.lit(f"/#{route}"))
    if english:
        return F.when(_filled(item_id), with_query(base("/enIssue"), [("contentId", item_id), ("title", title)]))
    route = F.coalesce(F.nullif("issue_route", F.lit("")), F.when(F.col("site_host") == rules.ROUTES_MAIN_HOST, "/issueDetail").otherwise("/issue"))
    detailed = F.when(_filled(year) & _filled(issue), with_query(base("/issueDetail"), [("contentId", item_id), ("issue", issue), ("year", year), ("title", title)]))
    short = with_query(base("/issue"), [("id", item_id), ("issue", issue), ("title", title), ("year", year)])
    return F.when(_filled(item_id), F.when(route == "/issueDetail", detailed).otherwise(short))


def _unpivot(rows: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """One row per (raw_url, method) of pairs that is filled."""
    found = F.array(*[F.struct(u.alias("raw_url"), m.alias("method")) for u, m in pairs])
    return rows.select(*KEYS, F.explode(F.filter(found, lambda p: _filled(p["raw_url"]))).alias("p")).select(*KEYS, "p.*")


def issue_items(rows: DataFrame, english: bool = False) -> DataFrame:
    """Links of article items: rows have KEYS, issue_route, item (map) and method."""
    item = F.col("item")
    first = lambda *names: F.coalesce(*[F.nullif(item[n], F.lit("")) for n in names])
    url = issue_url(first("contentId", "id"), item["year"], item["issue"], _text(first("title", "enTitle")), english)
    files = [(_text(item[k]), F.concat("method", F.lit(f":{k}"))) for k in ("filePath", "filePath2", "otherPath")]
    return _unpivot(rows, [(url, F.col("method")), *files])


def _items(responses: DataFrame, method: str) -> DataFrame:
    parsed = F.from_json("body", ITEMS)["data"]
    return responses.select("*", F.explode(F.coalesce(parsed, F.array().cast("array<map<string,string>>"))).alias("item"), F.lit(method).alias("method"))


def has_route(route: str) -> Column:
    return F.coalesce(F.array_contains("routes", route), F.lit(False))


def site_content(responses: DataFrame) -> DataFrame:
    """Items of a content list: the photo, and one of a channel, a link, or the item's own page."""
    rows = _items(responses, "").withColumn("channel", F.coalesce(F.from_json("post_body", "map<string,string>")["channeID"], F.lit("")))
    item, api = F.col("item"), "api:GetSiteContentPageList"
    link = _text(item["linkUrl"])
    number = link.rlike("^[0-9]+$") & has_route("/detail")
    detail = F.concat("site_origin", F.lit("/#/detail?channelId="))
    placed = F.when(starts_with_any(link, rules.ROUTE_PREFIXES), F.concat("site_origin", F.lit("/#"), link)).otherwise(link)
    own = item["contentID"].isNotNull() & (F.col("channel") != "") & has_route("/detail")
    url = F.when(number, F.concat(detail, link)).when(link != "", placed).when(own, F.concat(detail, "channel", F.lit("&id="), item["contentID"]))
    kind = F.when(number, f"{api}:channel").when(link != "", f"{api}:linkUrl").otherwise(f"{api}:detail")
    return _unpivot(rows, [(_text(item["titlePhoto"]), F.lit(f"{api}:titlePhoto")), (url, kind)])


def _search_url(year: Column, issue: Column) -> Column:
    return F.when(_filled(year) & _filled(issue) & has_route("/search"), F.concat("site_origin", F.lit("/#/search?issue="), issue, F.lit("&year="), year))


def current_issue(responses: DataFrame) -> DataFrame:
    """The current issue: its photo, its search page, its own items and those of all its channels."""
    api = "api:GetCurrentPeriodMutiChannel"
    head = F.from_json("body", "data struct<titlePhoto:string,year:string,issue:string,issueInfoList:array<map<string,string>>>")["data"]
    rows = responses.withColumn("head", head)
    top = _unpivot(rows, [(_text(F.col("head.titlePhoto")), F.lit(f"{api}:titlePhoto")), (_search_url(F.col("head.year"), F.col("head.issue")), F.lit(f"{api}:currentIssue"))])
    own = rows.select("*", F.explode("head.issueInfoList").alias("item"), F.lit("api:GetCurrentPeriod:issueDetail").alias("method"))
    channels = tree_items(responses, "body", [*KEYS, "issue_route"], root="data.channels", children="channels", items="issueInfoList")
    deep = channels.select("*", F.from_json(F.col("item"), "map<string,string>").alias("fields"), F.lit(f"{api}:issueDetail").alias("method")).drop("item").withColumnRenamed("fields", "item")
    return top.unionByName(issue_items(own)).unionByName(issue_items(deep))


def year_volumes(responses: DataFrame) -> DataFrame:
    years = F.from_json("body", "data array<struct<year:string,issueLists:array<struct<issue:string>>>>")["data"]
    rows = responses.select("*", F.explode(years).alias("y")).select("*", F.explode("y.issueLists").alias("i"))
    return _unpivot(rows, [(_search_url(F.col("y.year"), F.col("i.issue")), F.lit("api:GetYearVolumeTree:search"))])


def year_issues(responses: DataFrame) -> DataFrame:
    return _unpivot(_items(responses, ""), [(_search_url(F.col("item")["year"], F.col("item")["issue"]), F.lit("api:GetThatYearIssueList:search"))])


def content_info(responses: DataFrame) -> DataFrame:
    """Fields of up to three results, and whatever links their strings hold."""
    names = ["siteContentInfoResult", "issueContentInfoResult", "bmpVideoCourseResult"]
    results = F.from_json("body", "data map<string,string>")["data"]
    rows = responses.select("*", F.explode(F.array(*[results[n] for n in names])).alias("text")).filter(_filled(F.col("text")))
    rows = rows.withColumn("item", F.from_json("text", "map<string,string>"))
    fields = [(_text(F.col("item")[f]), F.lit(f"api:GetContentInfo:{f}")) for f in ("filePath", "filePath2", "otherPath", "titlePhoto", "linkUrl")]
    inline = links_of_strings(strings(rows, "text", KEYS)).select(*KEYS, "raw_url", F.lit("api:GetContentInfo:inline").alias("method"))
    return _unpivot(rows, fields).unionByName(inline)


def browse_url(year: Column, issue: Column | None = None) -> Column:
    return with_query(F.concat("site_origin", F.lit("/#/browse")), [("year", year)] + ([("issue", issue)] if issue is not None else []))


def browse_detail_url(item_id: Column, year: Column, issue: Column) -> Column:
    return F.when(_filled(item_id), with_query(F.concat("site_origin", F.lit("/#/browse_details")), [("year", year), ("issue", issue), ("issuecid", item_id)]))


def browse_items(responses: DataFrame, method: str) -> DataFrame:
    """Article items of the shared API. Year and issue of the request count only where an item has no such key."""
    rows = _items(responses, method).withColumn("asked", F.from_json("post_body", "map<string,string>"))
    item = F.col("item")
    own = lambda k: F.when(F.map_contains_key(item, k), item[k]).otherwise(F.col("asked")[k])
    item_id = F.coalesce(*[F.nullif(item[k], F.lit("")) for k in ("id", "issuecid", "issueCid")])
    fields = [(_text(item[f]), F.concat("method", F.lit(f":{f}"))) for f in ("filePath", "pdfPath", "htmlPath", "otherPath", "titlePhoto")]
    return _unpivot(rows, [(browse_detail_url(item_id, own("year"), own("issue")), F.col("method")), *fields])


def issue_list(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "").withColumn("year", query_params(part(F.col("url"), 4))["year"])
    issue, api = F.col("item")["issue"], "api:GetThatYearIssueList"
    known = _filled(issue)
    return _unpivot(rows, [(F.when(known, browse_url(F.col("year"), issue)), F.lit(f"{api}:browse")), (F.when(known, _text(F.col("item")["titlePhoto"])), F.lit(f"{api}:titlePhoto"))])


def journal_issues(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "").withColumn("year", query_params(part(F.col("url"), 4))["year"])
    issue = F.col("item")["issue"]
    return _unpivot(rows, [(F.when(_filled(issue), browse_url(F.col("year"), issue)), F.lit("api:GetJournalIssueList:browse"))])


def journal_years(asked: DataFrame) -> DataFrame:
    """Years of a journal: their browse pages. Rows that have no journal are left out."""
    rows = _items(asked, "").withColumn("journal", query_params(part(F.col("url"), 4))["journalId"]).filter("journal is not null")
    year = F.col("item")["year"]
    return _unpivot(rows, [(F.when(_filled(year), browse_url(year)), F.lit("api:GetJournalYear:browse"))])


def _follow(asked: DataFrame, responses: DataFrame, address: Column) -> DataFrame:
    """Captured answers to the distinct requests that asked's items lead to, as seen from asked's pages."""
    wanted = asked.select(*KEYS, address.alias("url")).filter("url is not null").groupBy("site_key", "url").agg(F.min_by(F.struct(*[c for c in KEYS if c != "site_key"]), "source_url").alias("k"))
    return wanted.select("site_key", "k.*", "url").join(responses.select("site_key", "url", "http_method", "post_body", "body"), ["site_key", "url"])


def journal_requests(asked: DataFrame) -> Column:
    q = query_params(part(F.col("url"), 4))
    year = F.col("item")["year"]
    return F.when(_filled(year) & _filled(q["journalId"]), F.concat(F.lit(f"{rules.SHARED_API_PREFIX}GetThatYearIssueList?journalId="), q["journalId"], F.lit("&year="), year))


def gap_requests() -> Column:
    q = query_params(part(F.col("url"), 4))
    year = F.col("item")["year"]
    return F.when(
        _filled(year) & _filled(q["journalId"]),
        F.concat(F.lit(f"{rules.SHARED_API_PREFIX}GetJournalYear?journalId="), q["journalId"], F.lit("&year="), year, F.lit("&gapYear="), F.coalesce(q["gapYear"], F.lit("10"))),
    )


#: The paginated series, as (part of the address, address, part of the key of a request).
SERIES = [
    ("GetSiteContentPageList", rules.SITE_CONTENT_API),
    ("GetIssueNormalSearch", rules.ISSUE_SEARCH_API),
    ("GetIssueSimpleSearch", rules.ISSUE_SIMPLE_API),
    ("GetBackIssueBrowsing", f"{rules.SHARED_API_PREFIX}GetBackIssueBrowsing"),
]


def sorted_payload(payload: Column) -> Column:
    """A payload's JSON in order of its keys, to compare requests by."""
    return F.to_json(F.array_sort(F.map_entries(payload)))


#: Pages are listed in blocks of this many, so that no row holds a long series, however many pages an answer claims.
BLOCK = 10_000


def pagination_plan(responses: DataFrame, max_pages: int = 0) -> DataFrame:
    """Rows (KEYS, url, payload, page, request): the further pages of paginated answers, each request once.

    max_pages limits the pages of one series, 0 does not. A claim that is no int counts as one page. Answers that were themselves further pages plan none anew.
    """
    payload = F.coalesce(F.from_json("post_body", "map<string,string>"), F.create_map().cast("map<string,string>"))
    api = F.lit(None).cast("string")
    for name, address in SERIES:
        api = F.when(F.col("url").contains(name), F.lit(address)).otherwise(api)
    rows = responses.select(*KEYS, api.alias("api"), payload.alias("payload"), F.coalesce(F.from_json("body", "totalpage int")["totalpage"], F.lit(1)).alias("total")).filter("api is not null")
    rows = rows.withColumn("curr", F.coalesce(F.col("payload")["curr"].cast("int"), F.lit(1)))
    last = F.least("total", F.col("curr") + max_pages) if max_pages else F.col("total")
    asked = rows.withColumns({"__from": F.col("curr").cast("long") + 1, "__to": last.cast("long")}).filter("__from <= __to")
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    blocks = asked.select("*", F.explode(F.sequence(block("__from"), block("__to"))).alias("__b"))
    inside = F.sequence(F.greatest("__from", F.col("__b") * BLOCK), F.least("__to", (F.col("__b") + 1) * BLOCK - 1))
    pages = blocks.select("*", F.explode(inside).alias("__page")).withColumn("page", F.col("__page").cast("int")).drop("__from", "__to", "__b", "__page")
    kept = F.map_filter("payload", lambda k, v: k != "curr")
    pages = pages.withColumn("payload", F.map_concat(kept, F.create_map(F.lit("curr"), F.col("page").cast("string"))))
    pages = pages.withColumn("request", F.concat_ws("|", "api", sorted_payload(F.col("payload"))))
    first = Window.partitionBy("site_key", "request").orderBy("source_url", "curr")
    return pages.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*KEYS, F.col("api").alias("url"), "payload", "page", "request")


def links_of_responses(responses: DataFrame, routes: DataFrame) -> DataFrame:
    """Discoveries (KEYS, raw_url, method) of all JSON answers: by the first expander whose name the address has, and of every string.

    routes has (site_key, routes, issue_route), as known_routes gives it. The answers are written once, as each
    expander reads them.
    """
    answers = written(distinct_responses(responses.filter(is_json(F.col("content_type")))).join(routes, "site_key", "left"))
    own = answers.filter(F.col("site_family") == rules.FAMILY_ROUTES)
    shared = answers.filter((F.col("site_family") != rules.FAMILY_ROUTES) & shared_api(F.col("url")))

    def first_match(rows: DataFrame, names: list[tuple[str, ...]]) -> list[DataFrame]:
        which = F.lit(-1)
        for n, parts in reversed([*enumerate(names)]):
            which = F.when(reduce(lambda a, b: a | b, [F.col("url").contains(p) for p in parts]), n).otherwise(which)
        numbered = rows.withColumn("__n", which)
        return [numbered.filter(F.col("__n") == n).drop("__n") for n in range(len(names))]

    tree, current, by_year, content, normal, simple, info, detail = first_match(
        own,
        [("GetYearVolumeTree",), ("GetCurrentPeriodMutiChannel", "GetCurrentPeriod?"), ("GetThatYearIssueList",), ("GetSiteContentPageList",), ("GetIssueNormalSearch",), ("GetIssueSimpleSearch",), ("GetIssueinfoList",), ("GetContentInfo",)],
    )
    gaps, years, issues, journal, back, articles = first_match(shared, [("GetJournalGapYear",), ("GetJournalYear",), ("GetThatYearIssueList",), ("GetJournalIssueList",), ("GetBackIssueBrowsing",), ("GetJournalArticleList",)])
    year_answers = years.select(*KEYS, "url", "http_method", "post_body", "body").unionByName(_follow(_items(gaps, ""), answers, gap_requests()))
    issue_answers = issues.select(*KEYS, "url", "http_method", "post_body", "body").unionByName(_follow(_items(year_answers, ""), answers, journal_requests(year_answers)))
    parts = [
        year_volumes(tree),
        current_issue(current),
        year_issues(by_year),
        site_content(content),
        issue_items(_items(normal, "api:GetIssueNormalSearch:issueDetail")),
        issue_items(_items(simple, "api:GetIssueSimpleSearch:enIssue"), english=True),
        issue_items(_items(info, "api:GetIssueinfoList:issueDetail")),
        content_info(detail),
        journal_years(year_answers),
        issue_list(issue_answers),
        journal_issues(journal),
        browse_items(back, "api:GetBackIssueBrowsing:detail"),
        browse_items(articles, "api:GetJournalArticleList:detail"),
        links_of_strings(strings(answers, "body", KEYS)).select(*KEYS, "raw_url", F.lit("response:json").alias("method")),
    ]
    return reduce(DataFrame.unionByName, parts)
