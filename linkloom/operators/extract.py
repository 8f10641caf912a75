"""Links out of HTML, scripts and onclick handlers: one row in, many rows out, by regular expressions and explode."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions import rules
from ..functions.classify import portal_page, relative_allowed, script_worth_reading, tag_like, urlish
from ..functions.urls import contains_any, encoded, js_call, normalize, spa_route, starts_with_any, strip, with_query

SITE = ["site_key", "site_host", "site_origin", "site_family"]


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else html.unescape(v))


def unescaped(value: Column) -> Column:
    """value with HTML entities undone; only values with an & leave the JVM."""
    return F.when(value.contains("&"), _unescape(F.when(value.contains("&"), value))).otherwise(value)


def clean_link(candidate: Column) -> Column:
    """A link cut out of running text, without what belongs to the text around it; null if nothing useful is left."""
    cut = F.regexp_extract(strip(candidate), "^[^\\s\\x0b\\x1c-\\x1f\"'<>\\x80-\\x{10FFFF}]*", 0)
    cut = F.regexp_replace(cut, "[).,;:!?\\]}]+$", "")
    rejected = cut.rlike(f"(?i)^(?:{rules.PSEUDO_SCHEMES}|blob:)")
    cut = F.regexp_extract(cut, f"(?s)^(.*?)(?:{'|'.join(rules.TEXT_ENTITIES)}|$)", 1)
    bare = F.regexp_replace(cut, "^/+|/+$", "")
    rejected = rejected | cut.rlike("[{}\\[\\]|]") | (cut.startswith("/") & (F.length(cut) <= 4) & bare.rlike("^[0-9]+$")) | tag_like(cut)
    return F.when(~rejected & ~cut.isin("", "/", "//", "?", "./", "../"), cut)


def links_of_text(text: Column, allow_relative: Column | bool, routes_family: Column) -> Column:
    """array of (raw_url, raw_kind) in a text: absolute links, and if allowed relative ones, hash routes, and the text itself."""
    value = strip(F.coalesce(text, F.lit("")))
    relative = F.lit(allow_relative) if isinstance(allow_relative, bool) else allow_relative
    found = lambda pattern, group, kind: F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(group)), lambda m: F.struct(clean_link(m).alias("raw_url"), F.lit(kind).alias("raw_kind")))
    as_is = F.array(F.struct(value.alias("raw_url"), F.lit("value").alias("raw_kind")))
    none = F.array().cast("array<struct<raw_url:string,raw_kind:string>>")
    routes = F.transform(F.regexp_extract_all(value, F.lit(rules.FAMILY_ROUTE), F.lit(1)), lambda m: F.struct(m.alias("raw_url"), F.lit("route").alias("raw_kind")))
    parts = F.concat(
        found(rules.ABSOLUTE_URL, 0, "absolute"),
        F.when(relative, F.concat(found(rules.RELATIVE_URL, 0, "relative"), found(rules.HASH_ROUTE, 0, "hash"))).otherwise(none),
        F.when(relative & starts_with_any(value, ["//", "/", "./", "../", "?", "#/"]), as_is).otherwise(none),
        F.when(routes_family, routes).otherwise(none),
        F.when(routes_family & starts_with_any(value, [*rules.ROUTE_PREFIXES, "#/"]), as_is).otherwise(none),
    )
    refused = (value == "") | value.rlike(f"(?i)^(?:{rules.PSEUDO_SCHEMES}|blob:)")
    return F.when(refused, none).otherwise(F.filter(parts, lambda p: p["raw_url"].isNotNull()))


def attributes(pages: DataFrame, text: str = "html") -> DataFrame:
    """Rows (…, attr, value) of the link attributes and onclick handlers in a column of HTML, entities undone, empty ones left out."""
    whole = F.coalesce(F.col(text), F.lit(""))
    matches = F.arrays_zip(F.regexp_extract_all(whole, F.lit(rules.ATTRIBUTE), F.lit(1)).alias("attr"), F.regexp_extract_all(whole, F.lit(rules.ATTRIBUTE), F.lit(3)).alias("value"))
    rows = pages.select(*[c for c in pages.columns if c != text], F.posexplode(matches).alias("pos", "m"))
    return rows.select("*", F.lower("m.attr").alias("attr"), strip(unescaped(F.col("m.value"))).alias("value")).drop("m").filter("value <> ''")


def _routes_family() -> Column:
    return F.col("site_family") == rules.FAMILY_ROUTES


def links_of_html(pages: DataFrame, text: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (site…, source_url, keep…, raw_url, raw_kind, pos) of every link in HTML.

    pages has SITE, source_url and the HTML. Of an attribute come the links in its value and, if it looks like a URL,
    its normalised form; of onclick the address its call leads to; of the whole text absolute links; of issue lists
    the pages that scripts would build. pos orders a page's rows. A null page has none.
    """
    keys = [*SITE, "source_url", *keep]
    attrs = attributes(pages.select(*keys, text), text)
    # one pass over the attributes: each row's links of all kinds stand in one array
    like_url = (F.col("attr") != "onclick") & urlish(F.col("value"))
    attrs = normalize(attrs.withColumn("urlish", F.when(like_url, F.col("value"))), "urlish", "source_url", "whole")
    link = lambda url, kind: F.array(F.struct(url.alias("raw_url"), F.lit(kind).alias("raw_kind")))
    whole = F.when(F.col("urlish").isNotNull(), link(F.coalesce("whole", "value"), "normalized"))
    click = F.when(F.col("attr") == "onclick", link(onclick_url(F.col("value")), "onclick"))
    none = F.array().cast("array<struct<raw_url:string,raw_kind:string>>")
    every = F.concat(links_of_text(F.col("value"), True, _routes_family()), F.coalesce(whole, none), F.coalesce(click, none))
    in_attributes = attrs.select(*keys, "pos", F.explode(every).alias("l")).select(*keys, "pos", "l.*").filter("raw_url is not null")
    last = F.lit(1 << 30)
    in_text = pages.select(*keys, last.alias("pos"), F.explode(links_of_text(F.col(text), False, _routes_family())).alias("l")).select(*keys, "pos", "l.*")
    lists = issue_list_links(pages.select(*keys, text), text, keep).select(*keys, (last + 1).alias("pos"), F.col("issue_url").alias("raw_url"), F.lit("issue_list").alias("raw_kind"))
    return in_attributes.unionByName(in_text).unionByName(lists)


def links_of_pages(pages: DataFrame, text: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """links_of_html, and each page's own address, as a browser reports it."""
    own = pages.select(*SITE, "source_url", *keep, F.lit(-1).alias("pos"), F.col("source_url").alias("raw_url"), F.lit("location").alias("raw_kind"))
    return links_of_html(pages, text, keep).unionByName(own)


def issue_list_links(pages: DataFrame, text: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (site…, source_url, issue_url): every address of an issue list with each of its years' quarters, distinct.

    Of the quarters only those count whose year the page names as well. A page's addresses and quarters are arrays of
    its own row, so their product never leaves it.
    """
    keys = [*SITE, "source_url", *keep]
    lowered = F.lower(F.col(text))
    mine = pages.filter((F.col("site_family") == rules.FAMILY_GENERIC) & lowered.contains("issue_list.aspx") & lowered.contains("quarternameid"))
    years = F.regexp_extract_all(F.col(text), F.lit(rules.YEAR_ID), F.lit(1))
    quarters = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(rules.QUARTER_ID), F.lit(1)), lambda q: F.struct(F.substring_index(q, ":", 1).alias("year"), F.substring_index(q, ":", -1).cast("int").alias("quarter"))))
    known = F.filter(quarters, lambda q: F.array_contains(years, q["year"]))
    actions = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rules.ISSUE_LIST_ACTION), F.lit(2)))
    rows = mine.select(*keys, known.alias("known"), actions.alias("actions")).select(*keys, "known", F.explode("actions").alias("action")).withColumn("action", strip(unescaped(F.col("action")))).filter("action <> ''")
    based = normalize(rows.withColumn("base", F.coalesce("source_url", F.concat("site_origin", F.lit("/")))), "action", "base", "list")
    host = F.regexp_extract(F.col("list"), "^[^?#]*", 0)
    built = based.filter("list is not null").select(*keys, host.alias("page"), F.explode("known").alias("q"))
    url = F.concat("page", F.lit("?year_id="), "q.year", F.lit("&quarter_id="), F.col("q.quarter").cast("string"))
    return built.select(*keys, url.alias("issue_url")).distinct()


def _portal_path(path: Column) -> Column:
    bare = F.regexp_replace(path, "^/+", "")
    return F.concat(F.lit("/"), F.when(bare.startswith("portal/journal/portal/"), bare).otherwise(F.concat(F.lit("portal/journal/portal/"), bare)))


def onclick_url(value: Column) -> Column:
    """The address that a portal page's onclick call leads to; null for other calls and too few arguments."""
    call = js_call(value)
    name, n = call["name"], F.size(call["args"])
    arg = lambda i: F.get(call["args"], F.lit(i))
    at = lambda path: F.concat("site_origin", F.lit("/portal/journal/portal/"), path)
    titled = lambda folder: with_query(at(F.concat(F.lit(f"client/{folder}/"), arg(0))), [("title", arg(1))])
    tab = with_query(F.concat("site_origin", _portal_path(arg(3))), [("year", arg(0)), ("issue", arg(1)), ("pageNum", arg(2)), ("yearId", arg(4)), ("issueId", arg(5))])
    neighbour = with_query(at(F.concat(F.lit("journal/api/listPrePaperOrNextPaper/"), arg(0))), [("year", arg(1)), ("issue", arg(2)), ("yearId", arg(3)), ("issueId", arg(4)), ("pageNum", F.lit(1)), ("pageSize", F.lit(10))])
    url = (
        F.when((name == "goNewList") & (n >= 1), titled("list"))
        .when((name == "goDownloadList") & (n >= 1), titled("download"))
        .when((name == "goLinkpostList") & (n >= 1), titled("linkpost"))
        .when((name == "guokanTurnPageList") & (n >= 4), with_query(at(F.lit("client/guokan_list")), [("year", arg(0)), ("issue", arg(1)), ("yearId", arg(2)), ("issueId", arg(3))]))
        .when(name.isin("getChineseHtmlUrl", "getSpecialPDFUrl") & (n >= 1), with_query(at(F.lit("journal/api/getChinesDownloadInfoByEnglishPaper")), [("contentId", arg(0))]))
        .when((name == "gotoCNKINode") & (n >= 1), with_query(at(F.lit("journal/api/gotoCNKINodeUrl")), [("id", arg(0))]))
        .when((name == "tabPage") & (n >= 6), tab)
        .when((name == "lastNextIssue") & (n >= 5), neighbour)
    )
    return F.when(F.col("site_family") == rules.FAMILY_PORTAL, url)


def onclick_action(value: Column) -> Column:
    """The request that a portal page's onclick call would send: struct (url, payload map, method); null if none."""
    call = js_call(value)
    name, n = call["name"], F.size(call["args"])
    arg = lambda i: F.get(call["args"], F.lit(i))

    def action(url: Column, values: list[Column], method: Column) -> Column:
        keys = ["yearId", "issueId", "year", "issue", "pageNum", "pageSize", "isSimple"]
        payload = F.create_map(*[x for k, v in zip(keys, values, strict=True) for x in (F.lit(k), v)])
        return F.struct(F.concat("site_origin", url).alias("url"), payload.alias("payload"), F.concat(F.lit("portal:ajax:"), name, F.lit(":"), method).alias("method"))

    page = strip(arg(2))
    direction = F.coalesce(F.nullif(F.lower(strip(arg(0))), F.lit("")), F.lit("next"))
    tab = action(_portal_path(arg(3)), [arg(4), arg(5), arg(0), arg(1), page, F.lit("10"), F.lit("0")], page)
    neighbour = action(F.concat(F.lit("/portal/journal/portal/journal/api/listPrePaperOrNextPaper/"), direction), [arg(3), arg(4), arg(1), arg(2), F.lit("1"), F.lit("10"), F.lit("0")], direction)
    found = F.when((name == "tabPage") & (n >= 6) & ~page.isin("", "1"), tab).when((name == "lastNextIssue") & (n >= 5), neighbour)
    return F.when(F.col("site_family") == rules.FAMILY_PORTAL, found)


def request_key(url: Column, payload: Column) -> Column:
    """A key of a request: its address and its payload in order of the keys."""
    return F.concat_ws("|", url, F.to_json(F.array_sort(F.map_entries(payload))))


def portal_requests(pages: DataFrame, limit: int, text: str = "html") -> DataFrame:
    """Rows (site…, source_url, url, payload, method): the first `limit` distinct requests of each portal page, in order."""
    actions = attributes(pages.select(*SITE, "source_url", text), text).filter("attr = 'onclick'").select(*SITE, "source_url", "pos", onclick_action(F.col("value")).alias("a")).filter("a is not null")
    keyed = actions.withColumn("key", request_key(F.col("a.url"), F.col("a.payload")))
    first = keyed.groupBy(*SITE, "source_url", "key").agg(F.min_by("a", "pos").alias("a"), F.min("pos").alias("pos"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("site_key", "source_url").orderBy("pos")))
    return ranked.filter(F.col("n") <= limit).select(*SITE, "source_url", "a.*", "key")


def expand_portal_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Discoveries (site…, source_url, raw_url, method) of requests: their addresses, and the links in captured answers.

    responses has key (as request_key gives it) and body.
    """
    asked = requests.select(*SITE, "source_url", F.col("url").alias("raw_url"), "method")
    answered = requests.join(responses.select("key", "body"), "key").select(*SITE, "source_url", "method", "body")
    links = links_of_html(answered, "body", ("method",))
    return asked.unionByName(links.select(*SITE, "source_url", "raw_url", F.concat("method", F.lit(":html")).alias("method")).distinct())


def script_routes(scripts: DataFrame) -> DataFrame:
    """Rows (site…, source_url, url, raw_url, method) of the routes in scripts (site…, source_url, url, body), each script once.

    Sites of the route family have a fixed list of routes, of which those count that the script quotes. Of other sites
    come the literals of a router table, as hash or path routes, if the script shows which; hash routes win.
    """
    once = scripts.groupBy(*SITE, "url").agg(F.min("source_url").alias("source_url"), F.min_by("body", "source_url").alias("body"))
    fixed = once.filter(_routes_family()).select("*", F.explode(F.array(*map(F.lit, rules.SCRIPT_ROUTES))).alias("route"))
    fixed = fixed.filter(F.col("body").contains(F.concat(F.lit('"'), "route", F.lit('"'))) | F.col("body").contains(F.concat(F.lit("'"), "route", F.lit("'"))))
    fixed = fixed.select(*SITE, "source_url", "url", F.concat("site_origin", F.lit("/#"), "route").alias("raw_url"))
    other = normalize(once.filter(~_routes_family()), "url", None, "script").filter(script_worth_reading("script"))
    by_hash = F.col("source_url").contains("#/") | contains_any(F.col("body"), rules.HASH_ROUTER_MARKS)
    by_path = ~by_hash & contains_any(F.col("body"), rules.HISTORY_ROUTER_MARKS)
    routes = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.col("body"), F.lit(rules.SCRIPT_ROUTE), F.lit(1)), spa_route), lambda r: r != ""))
    other = other.filter(by_hash | by_path).select(*SITE, "source_url", "url", F.when(by_hash, F.lit("/#")).otherwise(F.lit("")).alias("mark"), F.explode(routes).alias("route"))
    other = other.select(*SITE, "source_url", "url", F.concat("site_origin", "mark", "route").alias("raw_url"))
    return fixed.unionByName(other).withColumn("method", F.lit("response:script:route"))


def links_of_strings(strings: DataFrame) -> DataFrame:
    """Rows (site…, source_url, raw_url) of the links in payload strings (site…, source_url, value): markup as HTML, other text as such."""
    keys = [*SITE, "source_url"]
    trimmed = strings.select(*keys, strip(F.col("value")).alias("value")).filter("value <> ''")
    markup = F.col("value").contains("<") & F.col("value").contains(">")
    in_html = links_of_html(trimmed.filter(markup).withColumnRenamed("value", "html")).select(*keys, "raw_url")
    in_text = trimmed.select(*keys, F.explode(links_of_text(F.col("value"), ~markup & relative_allowed(F.col("value")), _routes_family())).alias("l"))
    return in_html.unionByName(in_text.select(*keys, "l.raw_url"))


__all__ = ["SITE", "attributes", "clean_link", "encoded", "expand_portal_requests", "issue_list_links", "links_of_html", "links_of_pages", "links_of_strings", "links_of_text", "onclick_action", "onclick_url", "portal_page", "portal_requests", "request_key", "script_routes", "unescaped"]
