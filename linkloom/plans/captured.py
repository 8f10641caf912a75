"""Responses beside the answers of plans.answers, which follow from the captured pages' numbers too, and their SQL.

Each page's application site has a script that names the routes which plans.answers gives it; its plain site has scripts
of its own and of others, and responses that are blocked, of no interest, or recorded without being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from . import answers

_TEXT = "text/plain"


def _rows(n: Column) -> list[tuple[Column | str, ...]]:
    """(source, url, type, content type, body) of a page's further responses."""
    text = n.cast("string")
    own, plain, other = (F.concat(F.lit(head), text, F.lit(tail)) for head, tail in (("http://j", ".ajcass.com/"), ("http://p", ".h.example/"), ("http://cdn", ".example/")))
    at = lambda site, *parts: F.concat(site, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    quoted = F.concat_ws(",", F.when(n % 2 == 0, '"/search"'), F.when(n % 7 > 0, "'/detail'"), F.when(n % 3 == 0, '"/issueDetail"').when(n % 3 == 1, "'/issue'"), F.lit('"/nothing"'))
    router = F.concat(F.when(n % 2 == 0, "on('hashchange');").otherwise("createWebHistory();"), F.lit(" {path:'/x"), text, F.lit("'},{redirect:'/404'}"))
    return [
        (own, at(own, "js/app", text, ".js"), "script", "text/javascript", quoted),
        (plain, at(plain, "js/app.js"), "script", None, router),
        (F.when(n % 3 == 0, at(plain, "z")), at(plain, "js/app.js"), "Script", "", "createWebHistory(); {path:'/late'}"),
        (plain, at(other, "a.js"), "script", "application/javascript", "routes:[{path:'/never'}]"),
        (plain, at(other, "lib?v=", text), "script", "application/javascript", "routes:[{path:'/never'}]"),
        (plain, at(plain, "pic", text, ".png"), "image", "image/png", ""),
        (plain, at(plain, "f", text, ".PDF"), "document", "application/pdf", ""),
        (plain, at(plain, "beacon"), "ping", _TEXT, ""),
        (plain, at(plain, "ws"), "other", _TEXT, '{"a":"/never.html"}'),
        (plain, at(plain, "untyped"), None, None, "/never.html"),
        (plain, at(plain, "s", text, ".css"), "stylesheet", "text/css", "/never.html"),
        (plain, at(plain, "d", text), "other", "Application/JSON; charset=utf-8", F.concat(F.lit('{"a":"http://o.example/e'), text, F.lit('"}'))),
        (plain, at(plain, "page?q=", text), "document", "text/html", "<a href='/never.html'>"),
    ]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of all pages, as data requests, and their further responses."""
    asked = answers.answers(spark, sf_dir).withColumn("resource_type", F.when(F.col("content_type") == "text/html", "document").otherwise("xhr"))
    names = ["source_url", "url", "resource_type", "content_type", "body"]
    made = [F.struct(*[(c if isinstance(c, Column) else F.lit(c).cast("string")).alias(name) for name, c in zip(names, row, strict=True)]) for row in _rows(F.col("page_id") + 1)]
    more = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.array(*made)).alias("r")).select("r.*").filter("source_url is not null")
    host = F.regexp_extract("source_url", "^http://([^/]+)/", 1)
    more = more.withColumns({"site_key": host, "site_host": host, "site_origin": F.concat(F.lit("http://"), host), "site_family": urls.site_family(host), "http_method": F.lit("GET"), "post_body": F.lit(None).cast("string")})
    return asked.unionByName(more)


def _routed() -> str:
    """CTE rr: what is kept of all responses, and what it is read as."""
    address = lambda url: "'" + url.replace("{n}", "' || n || '").replace("{y}", "' || y || '").replace("{y1}", "' || (y + 1) || '") + "'"
    parts = [(address(source), address(url), *(("document", "") if kind == "text/html" else ("xhr", "json")), "true") for source, url, _, _, kind, _ in answers.TEMPLATES]
    parts += [
        ("o || '/'", "o || '/js/app' || n || '.js'", "script", "script", "true"),
        ("h || '/'", "h || '/js/app.js'", "script", "script", "true"),
        ("h || '/z'", "h || '/js/app.js'", "script", "script", "n % 3 = 0"),
        ("h || '/'", "'http://cdn' || n || '.example/a.js'", "script", "script", "true"),
        ("h || '/'", "h || '/s' || n || '.css'", "stylesheet", "", "true"),
        ("h || '/'", "h || '/d' || n", "other", "json", "true"),
        ("h || '/'", "h || '/page?q=' || n", "document", "", "true"),
    ]
    return "rr AS (" + " UNION ALL ".join(f"SELECT {source} AS source_url, {url} AS url, '{kind}' AS resource_type, '{route}' AS route FROM t WHERE {given}" for source, url, kind, route, given in parts) + ")"


ROUTING = f"WITH {answers.NUMBERS}, {_routed()} SELECT * FROM rr"
#: Distinct links of all responses: their addresses, routes of scripts, links of answers.
ALL_LINKS = f"""WITH {answers.LINKS}, {_routed()} SELECT * FROM lk
UNION SELECT source_url, url, 'response:' || resource_type FROM rr
UNION SELECT h || '/', 'http://o.example/e' || n, 'response:json' FROM t
UNION SELECT h || '/', h || CASE WHEN n % 2 = 0 THEN '/#/x' ELSE '/x' END || n, 'response:script:route' FROM t
UNION SELECT o || '/', o || '/#' || r, 'response:script:route' FROM (SELECT o, unnest([CASE WHEN s THEN '/search' END, CASE WHEN d THEN '/detail' END, CASE n % 3 WHEN 0 THEN '/issueDetail' WHEN 1 THEN '/issue' END]) AS r FROM t) WHERE r IS NOT NULL"""
