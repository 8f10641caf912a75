"""Captured answers that follow from the captured pages' numbers, and, in SQL, the links that the rules find in them.

Each page has an application site j<n>.ajcass.com and a plain site p<n>.h.example, n being its page_id plus one. Which
routes a site has, and what its answers lack, depends on n, so that every branch of the rules is taken. The SQL works
the links out from n and never sees an answer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules, urls
from ..operators.graph import written

_OWN = "http://j{n}.ajcass.com/"
_PLAIN = "http://p{n}.h.example/"
_JSON = "application/json"
_API = "https://api.ajcass.com/api/x/"

#: source_url, url, http_method, post_body, content_type, body; {y} is a year, {y1} the next one, {i} an issue or null.
TEMPLATES = [
    (_OWN, f"{_API}GetYearVolumeTree?j={{n}}", "GET", None, _JSON, '{"data":[{"year":{y},"issueLists":[{issues}{"issue":null}]},{"year":null,"issueLists":[{"issue":1}]}]}'),
    (_OWN, f"{_API}GetCurrentPeriodMutiChannel?j={{n}}", "GET", None, _JSON, '{"data":{"titlePhoto":"/t{n}.jpg","year":{y},"issue":{i},"issueInfoList":[{"id":{n},"year":{y},"issue":{i}}],"channels":{channels}}}'),
    (_OWN, f"{_API}GetThatYearIssueList?j={{n}}", "GET", None, _JSON, '{"data":[{years}{"year":{y},"issue":""}]}'),
    (_OWN, rules.SITE_CONTENT_API, "POST", '{"channeID":{n},"curr":1}', _JSON, '{"totalpage":{k1},"data":[{"linkUrl":"{n}","titlePhoto":"/q{n}.png"},{"linkUrl":"/search?x={n}"},{"linkUrl":"http://o.example/{n}"},{"contentID":{n}},{}]}'),
    (_OWN, rules.ISSUE_SEARCH_API, "POST", "{}", _JSON, '{"totalpage":1,"data":[{"contentId":{n},"year":{y},"issue":{i},"title":"T {n}"}]}'),
    (_OWN, rules.ISSUE_SIMPLE_API, "POST", "{}", _JSON, '{"data":[{"contentId":{n},"enTitle":"E {n}"}]}'),
    (_OWN, f"{_API}GetIssueinfoList?id={{n}}", "GET", None, _JSON, '{"data":[{"id":{n},"year":{y},"issue":{i},"title":"A b","filePath":"/f{n}.pdf"},{"contentId":{n},"year":null,"issue":"","title":null,"enTitle":"E"},{"title":"no id","otherPath":" /o{n} "}]}'),
    (_OWN, f"{_API}GetContentInfo?id={{n}}", "GET", None, _JSON, '{"data":{"siteContentInfoResult":{"filePath":"/c{n}.pdf","linkUrl":"","text":"<a href=\'/in/{n}\'>x</a>"},"bmpVideoCourseResult":null}}'),
    (_PLAIN, f"{rules.SHARED_API_PREFIX}GetJournalGapYear?journalId={{n}}&gapYear=5", "GET", None, _JSON, '{"data":[{"year":{y}},{"year":{y}},{"year":null}]}'),
    (_PLAIN, f"{rules.SHARED_API_PREFIX}GetJournalYear?journalId={{n}}&year={{y}}&gapYear=5", "GET", None, _JSON, '{"data":[{"year":{y1}}]}'),
    (_PLAIN, f"{rules.SHARED_API_PREFIX}GetThatYearIssueList?journalId={{n}}&year={{y1}}", "GET", None, _JSON, '{"data":[{"issue":1,"titlePhoto":"/i{n}.jpg"},{"issue":""}]}'),
    (_PLAIN, f"{rules.SHARED_API_PREFIX}GetJournalIssueList?year={{y}}", "GET", None, _JSON, '{"data":[{"issue":{k1}}]}'),
    (_PLAIN, f"{rules.SHARED_API_PREFIX}GetBackIssueBrowsing", "POST", '{"year":{y},"issue":2}', _JSON, '{"totalpage":{k},"data":[{"id":{n}},{"issuecid":1{n},"year":null,"pdfPath":"/b{n}.pdf"}]}'),
    (_PLAIN, f"{rules.SHARED_API_PREFIX}GetJournalArticleList", "POST", '{"year":{y}}', _JSON, '{"data":[{"issueCid":{n}}]}'),
    (_PLAIN, f"{_PLAIN}data.json", "GET", None, "application/ld+json; charset=utf-8", '{"a":["http://o.example/q{n}).",{"b":"see /page{n}.html now","c":"no link here / at all"}],"d":3}'),
    (_PLAIN, f"{_PLAIN}text", "GET", None, "text/html", '{"a":"/never.html"}'),
]
COLUMNS = ["source_url", "url", "http_method", "post_body", "content_type", "body"]


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 1).alias("n")), F.col("n")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (SITE, source_url, url, http_method, post_body, content_type, body): all templates for each captured page, as a written table."""
    df, n = _numbered(spark, sf_dir)
    text = lambda c: c.cast("string")
    year, k = 2000 + n % 25, (n % 4).cast("int")
    upto = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda m: m <= k)
    listed = lambda head: F.array_join(F.transform(upto, lambda m: F.concat(head, text(m), F.lit("},"))), "")
    issue = F.when(n % 5 == 0, "null").otherwise(text(n % 5))
    item = lambda m: F.concat(F.lit('[{"issueInfoList":[{"id":'), text(m), text(n), F.lit(',"year":'), text(year), F.lit(',"issue":'), issue, F.lit('}],"channels":'))
    values = {
        "channels": F.concat(F.array_join(F.transform(upto, item), ""), F.lit("[]"), F.repeat(F.lit("}]"), k)),
        "issues": listed(F.lit('{"issue":')),
        "years": listed(F.concat(F.lit('{"year":'), text(year), F.lit(',"issue":'))),
        "n": text(n), "y": text(year), "y1": text(year + 1), "i": issue, "k": text(k), "k1": text(k + 1),
    }
    made = F.from_json(F.lit(json.dumps([dict(zip(COLUMNS, t, strict=True)) for t in TEMPLATES])), f"array<struct<{', '.join(f'{c}: string' for c in COLUMNS)}>>")
    df = df.select(*[v.alias(f"__{name}") for name, v in values.items()], F.explode(made).alias("c"))

    def filled(c: str) -> Column:
        out = F.col(f"c.{c}")
        for name in values:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.col(f"__{name}"))
        return out.alias(c)

    host = F.regexp_extract("source_url", "^http://([^/]+)/", 1)
    made = df.select(*map(filled, COLUMNS))
    return written(made.withColumns({"site_key": host, "site_host": host, "site_origin": F.concat(F.lit("http://"), host), "site_family": urls.site_family(host)}))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (site_key, route) of the application sites: none to three of them."""
    df, n = _numbered(spark, sf_dir)
    known = F.array(F.when(n % 2 == 0, "/search"), F.when(n % 7 > 0, "/detail"), F.when(n % 3 == 0, "/issueDetail").when(n % 3 == 1, "/issue"))
    return df.select(F.concat(F.lit("j"), n.cast("string"), F.lit(".ajcass.com")).alias("site_key"), F.explode(F.array_compact(known)).alias("route"))


#: CTE t: the numbers of each page's sites; o and h are their origins.
NUMBERS = """t0 AS (SELECT page_id + 1 AS n FROM pages),
t AS (SELECT n, 2000 + n % 25 AS y, nullif(n % 5, 0) AS i, n % 4 AS k, n % 2 = 0 AS s, n % 7 > 0 AS d, n % 3 = 0 AS full_form, 'http://j' || n || '.ajcass.com' AS o, 'http://p' || n || '.h.example' AS h FROM t0),
tm AS (SELECT t.*, m FROM t, (SELECT unnest(range(1, 4)) AS m) WHERE m <= k)"""


def _issue(item: str, title: str = "", year: bool = True) -> str:
    """The address of an article by the form that the site uses; without year and issue for year = False."""
    named = f"'&title={title}'" if title else "''"
    if not year:
        return f"CASE WHEN NOT full_form THEN o || '/#/issue?id=' || {item} || {named} END"
    return f"CASE WHEN NOT full_form THEN o || '/#/issue?id=' || {item} || coalesce('&issue=' || i, '') || {named} || '&year=' || y WHEN i > 0 THEN o || '/#/issueDetail?contentId=' || {item} || '&issue=' || i || '&year=' || y || {named} END"


def _rows() -> list[tuple[str, str, str, str, str]]:
    """(numbers, origin, link, method, condition) of all links."""
    search = "o || '/#/search?issue=' || {0} || '&year=' || y"
    detail = "o || '/#/detail?channelId=' || n"
    current, content, browse = "api:GetCurrentPeriodMutiChannel", "api:GetSiteContentPageList", "api:GetBackIssueBrowsing:detail"
    own = [
        ("tm", search.format("m"), "api:GetYearVolumeTree:search", "s"),
        ("tm", search.format("m"), "api:GetThatYearIssueList:search", "s"),
        ("t", "'/t' || n || '.jpg'", f"{current}:titlePhoto", "true"),
        ("t", search.format("i"), f"{current}:currentIssue", "s AND i > 0"),
        ("t", _issue("n"), "api:GetCurrentPeriod:issueDetail", "true"),
        ("tm", _issue("m || n"), f"{current}:issueDetail", "true"),
        ("t", "'/q' || n || '.png'", f"{content}:titlePhoto", "true"),
        ("t", detail, f"{content}:channel", "d"),
        ("t", "n::VARCHAR", f"{content}:linkUrl", "NOT d"),
        ("t", "o || '/#/search?x=' || n", f"{content}:linkUrl", "true"),
        ("t", "'http://o.example/' || n", f"{content}:linkUrl", "true"),
        ("t", detail + " || '&id=' || n", f"{content}:detail", "d"),
        ("t", _issue("n", "T+' || n || '"), "api:GetIssueNormalSearch:issueDetail", "true"),
        ("t", "o || '/#/enIssue?contentId=' || n || '&title=E+' || n", "api:GetIssueSimpleSearch:enIssue", "true"),
        ("t", _issue("n", "A+b"), "api:GetIssueinfoList:issueDetail", "true"),
        ("t", _issue("n", "E", year=False), "api:GetIssueinfoList:issueDetail", "true"),
        ("t", "'/f' || n || '.pdf'", "api:GetIssueinfoList:issueDetail:filePath", "true"),
        ("t", "'/o' || n", "api:GetIssueinfoList:issueDetail:otherPath", "true"),
        ("t", "'/c' || n || '.pdf'", "api:GetContentInfo:filePath", "true"),
        *[("t", link, "api:GetContentInfo:inline", "true") for link in ("'/c' || n || '.pdf'", "'/in/' || n", "o || '/in/' || n")],
        *[("t", link, "response:json", "true") for link in ("'/t' || n || '.jpg'", "'/q' || n || '.png'", "'/search?x=' || n", "'http://o.example/' || n", "'/f' || n || '.pdf'", "'/o' || n", "'/c' || n || '.pdf'", "'/in/' || n", "o || '/in/' || n")],
    ]
    plain = [
        ("h || '/#/browse?year=' || (y + 1)", "api:GetJournalYear:browse"),
        ("h || '/#/browse?year=' || (y + 1) || '&issue=1'", "api:GetThatYearIssueList:browse"),
        ("'/i' || n || '.jpg'", "api:GetThatYearIssueList:titlePhoto"),
        ("h || '/#/browse?year=' || y || '&issue=' || (k + 1)", "api:GetJournalIssueList:browse"),
        ("h || '/#/browse_details?year=' || y || '&issue=2&issuecid=' || n", browse),
        ("h || '/#/browse_details?issue=2&issuecid=1' || n", browse),
        ("'/b' || n || '.pdf'", f"{browse}:pdfPath"),
        ("h || '/#/browse_details?year=' || y || '&issuecid=' || n", "api:GetJournalArticleList:detail"),
        *[(link, "response:json") for link in ("'/i' || n || '.jpg'", "'/b' || n || '.pdf'", "'http://o.example/q' || n", "'/page' || n || '.html'")],
    ]
    return [(numbers, "o", *rest) for numbers, *rest in own] + [("t", "h", link, method, "true") for link, method in plain]


#: CTE lk: the distinct links of all answers.
LINKS = f"{NUMBERS},\nlk AS (" + " UNION ".join(f"SELECT {at} || '/' AS source_url, {link} AS raw_url, '{method}' AS method FROM {numbers} WHERE ({link}) IS NOT NULL AND {given}" for numbers, at, link, method, given in _rows()) + ")"


def pagination(limit: int = 0) -> str:
    """The further pages of the two series that have any; limit is the most of a series, 0 is none."""
    last = lambda total, curr: f"least({total}, {curr} + {limit})" if limit else total
    series = [("o", rules.SITE_CONTENT_API, "k + 1"), ("h", f"{rules.SHARED_API_PREFIX}GetBackIssueBrowsing", "k")]
    return f"WITH {NUMBERS} " + " UNION ALL ".join(f"SELECT {at} || '/' AS source_url, '{url}' AS url, unnest(range(2, {last(total, 1)} + 1))::INT AS page FROM t" for at, url, total in series)


#: Coverage of the sites by the nodes that all answers but the late ones give: what is expected, lacking, left out and open.
COVERAGE = f"""WITH {LINKS},
u0 AS (SELECT regexp_extract(source_url, '^http://([^/]+)/', 1) AS site_key, method, regexp_extract(source_url, '^(.*)/$', 1) AS origin,
  regexp_replace(CASE WHEN raw_url LIKE 'http%' THEN raw_url WHEN raw_url LIKE '/search%' THEN regexp_extract(source_url, '^(.*)/$', 1) || '/#' || raw_url WHEN raw_url LIKE '/%' THEN regexp_extract(source_url, '^(.*)/$', 1) || raw_url ELSE source_url || raw_url END, '/#/search\\?x=[0-9]+$', '/#/search') AS u FROM lk),
u AS (SELECT site_key, method, regexp_replace(u, '(issueDetail.*)(&year=[0-9]+)(&title=.*)$', '\\1\\3\\2') AS url, starts_with(u, origin || '/') AND NOT regexp_matches(u, '\\.(jpg|png|pdf)$') AS queueable,
  CASE WHEN contains(u, '.ajcass.com/#/issue') THEN 'issue_detail' WHEN contains(u, '.ajcass.com/#/detail') THEN 'static_detail' WHEN contains(u, '.ajcass.com/#/enIssue') THEN 'en_issue' END AS leaf FROM u0),
known AS (SELECT DISTINCT site_key, url, leaf FROM u WHERE queueable AND NOT regexp_matches(method, '^api:(GetCurrentPeriod|GetIssueNormalSearch|GetIssueSimpleSearch)')),
wanted AS (SELECT DISTINCT site_key, coalesce(leaf, 'issue_search') AS item, url FROM u WHERE leaf IS NOT NULL OR method LIKE '%:search' OR method LIKE '%:currentIssue'),
gone AS (SELECT * FROM wanted WHERE (site_key, url) NOT IN (SELECT (site_key, url) FROM known)),
named AS (SELECT site_key, item, url FROM gone UNION ALL SELECT site_key, CASE WHEN leaf IS NULL THEN 'unvisited_queueable' ELSE 'skipped_leaf' END, url FROM known UNION ALL SELECT site_key, 'frontier', url FROM known WHERE leaf IS NULL),
totals AS (SELECT site_key, item, count(*) AS total, array_to_string(list_sort(list(url))[1:20], ' ') AS sample FROM named GROUP BY ALL),
asked AS (SELECT site_key, item, count(*) AS expected FROM wanted GROUP BY ALL)
SELECT site_key, item, expected, coalesce(total, 0) AS total, coalesce(sample, '') AS sample FROM asked FULL JOIN totals USING (site_key, item)"""
