"""Responses seen while pages load: which are of interest, what they are read as, and the links in all of them.

captured has SITE, source_url (the page that was loading), url, resource_type, http_method, post_body, content_type and body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules
from ..functions.classify import not_blocked, response_of_interest
from ..functions.urls import normalize
from .expand import KEYS, is_json, is_script, known_routes, links_of_responses
from .extract import script_routes
from .graph import written

JSON, SCRIPT, UNREAD = "json", "script", ""


def routed(captured: DataFrame, blocking: bool = True) -> DataFrame:
    """The responses that matter, with route: json, script, or empty for what is recorded and not read.

    With blocking, requests for media and for files that are never read were not sent, so they have no response. A null
    type or content type counts as empty, a null url is no response. One pass, nothing is shuffled.
    """
    rows = captured.filter("url is not null").withColumn("resource_type", F.lower(F.coalesce("resource_type", F.lit(""))))
    if blocking:
        rows = rows.filter(not_blocked(F.col("url"), F.col("resource_type")))
    kept = normalize(rows, "url", None, "__target").filter(response_of_interest(F.col("url"), "__target"))
    route = F.when(is_json(F.col("content_type")), JSON).when(is_script(F.col("content_type"), F.col("url")), SCRIPT).otherwise(UNREAD)
    return kept.select(*captured.columns, route.alias("route"))


def routes_of_scripts(found: DataFrame) -> DataFrame:
    """Rows (site_key, route) of the routes that the scripts of application sites name, from what script_routes gives."""
    return found.filter(F.col("site_family") == rules.FAMILY_ROUTES).select("site_key", F.regexp_extract("raw_url", "/#(/.*)$", 1).alias("route")).distinct()


def links_of_captured(captured: DataFrame, routes: DataFrame | None = None, blocking: bool = True) -> DataFrame:
    """Discoveries (KEYS, raw_url, method) of responses: their own addresses, routes in scripts, and links in answers.

    What a site's scripts name as routes decides how its answers are expanded, as do routes (site_key, route) known
    from before. The responses are routed once and written, as all three read them.
    """
    rows = written(routed(captured, blocking))
    own = rows.select(*KEYS, F.col("url").alias("raw_url"), F.concat(F.lit("response:"), "resource_type").alias("method"))
    scripts = written(script_routes(rows.filter(F.col("route") == SCRIPT)))
    named = routes_of_scripts(scripts)
    known = known_routes(named if routes is None else named.unionByName(routes.select("site_key", "route")))
    in_answers = links_of_responses(rows.filter(F.col("route") == JSON).drop("route"), known)
    return own.unionByName(scripts.select(*KEYS, "raw_url", "method")).unionByName(in_answers)
