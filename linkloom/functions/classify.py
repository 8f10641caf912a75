"""Predicates and classes of normalised URLs, as Column expressions over what functions.urls.normalize adds.

Each takes the name of the URL column; its parts and the columns site_host, site_origin and site_family stand beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import rules
from .urls import contains_any, filename, query_pairs, query_params, route_of, segments, settled, starts_with_any


def _lower_path(url: str) -> Column:
    return F.lower(F.col(f"{url}_path"))


def _is(family: str) -> Column:
    return F.col("site_family") == family


def same_site(url: str = "url") -> Column:
    """On the site's own host, whatever the port."""
    return F.coalesce(F.col(f"{url}_scheme").isin("http", "https") & (F.col(f"{url}_host") == F.col("site_host")), F.lit(False)) & F.col(url).isNotNull()


def static_asset(path: Column) -> Column:
    return path.rlike(f"(?i)^/(?:{'|'.join(rules.STATIC_PREFIXES)})(?:/|$)")


def unsafe_action(path: Column, query: Column) -> Column:
    """Whether a visit could log out or delete. The first destructive key decides, whatever pairs come after it."""
    unsafe = [f"{k}={v}" for k, v in rules.UNSAFE_PAIRS]
    pairs = F.transform(query_pairs(query), lambda p: F.struct(F.lower(p["k"]).alias("k"), F.lower(p["v"]).alias("v")))
    decides = lambda p: F.concat_ws("=", p["k"], p["v"]).isin(unsafe) | p["k"].isin(rules.DESTRUCTIVE_KEYS)
    first = F.try_element_at(F.filter(pairs, decides), F.lit(1))
    harmful = F.concat_ws("=", first["k"], first["v"]).isin(unsafe) | ~first["v"].isin(rules.HARMLESS_VALUES)
    return F.exists(segments(path), lambda s: s.isin(rules.UNSAFE_SEGMENTS)) | F.coalesce(harmful, F.lit(False))


def endpoint(path: Column, query: Column) -> Column:
    """An address that answers with no page to read."""
    return F.lower(path).startswith(rules.UPLOAD_PREFIX) | filename(path).isin(rules.ENDPOINT_FILENAMES) | F.lower(query).contains("aspxerrorpath=")


def low_priority(path: Column) -> Column:
    return F.lower(path).startswith(rules.UPLOAD_PREFIX) | filename(path).isin(rules.LOW_PRIORITY_FILENAMES) | F.exists(segments(path), lambda s: s.isin(rules.LOW_PRIORITY_SEGMENTS))


def tag_like(path: Column) -> Column:
    """A single segment that is the name of an HTML tag, as text such as </td> leaves behind."""
    bare = F.regexp_replace(F.trim(path), "^#", "")
    inner = F.regexp_replace(F.regexp_replace(bare, "^(?:\\./|\\.\\./)+", ""), "^/", "")
    inner = F.regexp_replace(F.substring_index(F.substring_index(inner, "?", 1), "#", 1), "^/+|/+$", "")
    return ~bare.startswith("//") & F.lower(inner).isin(rules.HTML_TAGS)


def urlish(value: Column) -> Column:
    lowered = F.lower(value)
    return (value != "") & (starts_with_any(lowered, ["http://", "https://", "//", "/", "./", "../", "?", "#/", "data:", "blob:"]) | contains_any(value, ["/", ".", "?", "="]))


def relative_allowed(text: Column) -> Column:
    """Whether a text of a payload may hold relative links."""
    lowered = F.lower(text)
    return starts_with_any(text, ["//", "/", "./", "../", "?", "#/"]) | contains_any(lowered, rules.LINK_MARKS) | contains_any(lowered, rules.PAGE_MARKS)


def script_worth_reading(url: str = "url") -> Column:
    return same_site(url) & (_lower_path(url).endswith(".js") | static_asset(F.col(f"{url}_path")))


def portal_page(url: str = "url") -> Column:
    path = _lower_path(url)
    return _is(rules.FAMILY_PORTAL) & same_site(url) & ((path == "/portal") | path.startswith("/portal/") | path.contains("/portal/journal/portal/"))


def shared_api(url: Column) -> Column:
    return contains_any(F.lower(url), [f"https://{rules.SHARED_API_HOST}/api/", f"http://{rules.SHARED_API_HOST}/api/"])


def queueable(url: str = "url") -> Column:
    path, query, lowered = F.col(f"{url}_path"), F.col(f"{url}_query"), _lower_path(url)
    portal_api = contains_any(lowered, rules.PORTAL_API_PARTS) | lowered.endswith("/client/paperpage_list")
    portal = lowered.rlike(f"/(?:{'|'.join(rules.PORTAL_UNFOLLOWED_PAGES)})$".replace(".", "\\.")) | lowered.startswith("/api/") | portal_api
    routes = lowered.endswith("/waf_slider_verify.html") | ((F.col(f"{url}_fragment") != "") & (route_of(F.col(f"{url}_fragment")) == ""))
    stopped = (
        lowered.rlike(f"\\.(?:{'|'.join(rules.NON_HTML_SUFFIXES)})$")
        | static_asset(path)
        | unsafe_action(path, query)
        | endpoint(path, query)
        | (_is(rules.FAMILY_PORTAL) & portal)
        | (_is(rules.FAMILY_ROUTES) & routes)
    )
    return same_site(url) & ~F.coalesce(stopped, F.lit(False))


def page_kind(url: str = "url") -> Column:
    """The kind of page that a URL leads to; the first rule that holds decides."""
    path, lowered = F.col(f"{url}_path"), _lower_path(url)
    own = F.col(f"{url}_host") == F.col("site_host")
    routes, portal = _is(rules.FAMILY_ROUTES) & own, _is(rules.FAMILY_PORTAL) & own
    route, params = route_of(F.col(f"{url}_fragment")), query_params(F.col(f"{url}_query"))
    has = lambda *names: F.coalesce(F.arrays_overlap(F.map_keys(params), F.array(*map(F.lit, names))), F.lit(False))
    in_portal = portal & portal_page(url)
    ends = lambda *names: F.lit(False) if not names else lowered.endswith(names[0]) | ends(*names[1:])
    decisions = [
        (F.col(url).isNull(), "unknown"),
        (routes & (lowered == "/home/index"), "root"),
        (routes & ends("/waf_slider_verify.html"), "guard"),
        (routes & lowered.startswith("/magazine/magazinepiclist"), "ajcass_cms_archive"),
        (routes & lowered.startswith("/magazine/getissuecontentlist"), "ajcass_cms_issue"),
        (routes & lowered.contains("/magazine/show/"), "ajcass_cms_article"),
        (routes & lowered.startswith("/commonblock/sitecontentlist"), "ajcass_cms_list"),
        (routes & starts_with_any(lowered, ["/commonblock/getsitedescribedetail", "/commonblock/sitecontentdetail"]), "ajcass_cms_detail"),
        (routes & route.isin("", "/", "/index") & (path == "/"), "root"),
        (routes & (route == "/search"), "issue_search"),
        (routes & route.isin("/issueDetail", "/issue"), "issue_detail"),
        (routes & (route == "/detail"), "detail"),
        (routes & (route == "/enIndex"), "english_index"),
        (routes & (route == "/enIssue"), "english_issue"),
        (routes & route.startswith("/"), F.concat(F.lit("spa:"), F.substring(route, 2, 1 << 30))),
        (in_portal & ((lowered == "/portal") | ends("/client/index")), "cbpt_portal_index"),
        (in_portal & lowered.contains("/portal/journal/portal/client/paper/"), "cbpt_portal_article"),
        (in_portal & lowered.contains("/portal/journal/portal/client/news/"), "cbpt_portal_news"),
        (in_portal & (contains_any(lowered, rules.PORTAL_API_PARTS) | ends("/client/paperpage_list")), "cbpt_portal_api"),
        (in_portal & contains_any(lowered, rules.PORTAL_LIST_PARTS), "cbpt_portal_list"),
        (in_portal, "cbpt_portal_aux"),
        (portal & lowered.startswith("/api/"), "cbpt_aux"),
        (portal & (lowered == "/index.aspx") & has("t"), "cbpt_aux"),
        (portal & ends("/showvalidatecode.aspx", "/validatecode.aspx", "/error.aspx", "/quit.aspx"), "cbpt_guard"),
        (portal & lowered.contains("/editor"), "cbpt_aux"),
        (portal & ends("/paperdigest.aspx"), "cbpt_article"),
        (portal & ends("/wktextcontent.aspx") & has("contentID", "paperID"), "cbpt_article"),
        (portal & ends("/wktextcontent.aspx") & has(*rules.NAVIGATION_PARAMETERS), "cbpt_list"),
        (portal & ends("/wktextcontent.aspx"), "page"),
        (portal & ends("/wklist.aspx") & has("contentID"), "cbpt_article"),
        (portal & ends("/wklist.aspx"), "cbpt_list"),
        (portal & ends("/editora3n/index.aspx", "/wka3/error.aspx"), "cbpt_aux"),
        (portal & ends("/webpublication/index.aspx") & (F.col(f"{url}_query") != ""), "page"),
        ((path == "/") & (F.col(f"{url}_query") == "") & (F.col(f"{url}_fragment") == ""), "root"),
    ]
    out = F.lit("page")
    for condition, kind in reversed(decisions):
        out = F.when(condition, kind).otherwise(out)
    return out


def should_visit(kind: Column, is_queueable: Column, aggressive: Column | bool = True, visit_leaf_pages: Column | bool = False) -> Column:
    leaf = (_is(rules.FAMILY_ROUTES) & kind.isin(rules.ROUTES_LEAF_KINDS)) | (_is(rules.FAMILY_PORTAL) & kind.isin(rules.PORTAL_LEAF_KINDS))
    always = (F.lit(aggressive) if isinstance(aggressive, bool) else aggressive) | (F.lit(visit_leaf_pages) if isinstance(visit_leaf_pages, bool) else visit_leaf_pages)
    return is_queueable & (always | ~leaf)


def workload_class(url: str, kind: Column, is_queueable: Column, aggressive: Column | bool = False) -> Column:
    lowered = F.lower(F.col(url))
    path = _lower_path(url)
    light_page = contains_any(path, rules.LIGHT_PATH_PARTS) | path.rlike("/[a-z]+/reader/(?:view|detail)") | contains_any(lowered, rules.LIGHT_URL_PARTS)
    gentle = F.when(kind.isin(rules.LIGHT_KINDS) | ((kind == "page") & light_page), "light").when(kind.isin(rules.HEAVY_KINDS), "heavy").otherwise("light")
    forced = F.lit(aggressive) if isinstance(aggressive, bool) else aggressive
    return F.when(forced, F.when(is_queueable, "heavy").otherwise("light")).otherwise(gentle)


def method_rank(method: Column) -> Column:
    m = F.lower(F.coalesce(method, F.lit("")))
    ranks = [
        (m == "seed", 0),
        (m == "dom", 1),
        (m.startswith("api:"), 2),
        (starts_with_any(m, ["click", "popup:", "selector:"]), 3),
        (m.startswith("response:document"), 4),
        (m.startswith("response:script"), 5),
        (m.startswith("response:json"), 6),
        (starts_with_any(m, ["response:xhr", "response:fetch"]), 7),
        (m.startswith("download:"), 9),
    ]
    out = F.lit(8)
    for condition, rank in reversed(ranks):
        out = F.when(condition, rank).otherwise(out)
    return out


def kind_rank(kind: Column) -> Column:
    out = F.lit(2)
    for rank, kinds in rules.KIND_RANKS.items():
        out = F.when(kind.isin(kinds), rank).otherwise(out)
    return out


def priority(url: str, kind: Column, method: Column) -> list[Column]:
    """Sort keys, best first: low value last, then kind, method, depth of path, and the URL itself."""
    return [low_priority(F.col(f"{url}_path")).cast("int"), kind_rank(kind), method_rank(method), F.size(segments(F.col(f"{url}_path"))), F.col(url)]


def transport_error(error: Column) -> Column:
    return contains_any(F.lower(F.coalesce(error, F.lit(""))), rules.TRANSPORT_ERRORS)


def response_of_interest(address: Column, url: str) -> Column:
    """Responses worth a look: documents and data requests, JSON, files, and the site's scripts; url is the normalised address."""
    kind, content = F.col("resource_type"), F.lower(F.coalesce("content_type", F.lit("")))
    files = F.lower(address).rlike(f"\\.(?:{'|'.join(rules.NON_HTML_SUFFIXES)})$")
    return F.coalesce(kind.isin("document", "xhr", "fetch") | content.contains("application/json") | files | ((kind == "script") & script_worth_reading(url)), F.lit(False))


def not_blocked(url: Column, resource_type: Column) -> Column:
    return ~F.coalesce(F.lower(resource_type).isin(rules.BLOCKED_RESOURCE_TYPES) | F.lower(url).rlike(f"\\.(?:{'|'.join(rules.BLOCKED_SUFFIXES)})$"), F.lit(False))


def classified(df: DataFrame, url: str = "url", aggressive: bool = True, visit_leaf_pages: bool = False) -> DataFrame:
    """df with same_site, queueable, page_kind (resource unless queueable) and should_visit of url."""
    df = df.withColumns({"same_site": same_site(url), "queueable": queueable(url), "__kind": page_kind(url)})
    visit = should_visit(F.col("__kind"), F.col("queueable"), aggressive, visit_leaf_pages)
    df = df.withColumns({"page_kind": F.when(F.col("queueable"), F.col("__kind")).otherwise("resource"), "should_visit": visit}).drop("__kind")
    return settled(df, "same_site", "queueable", "page_kind", "should_visit")
