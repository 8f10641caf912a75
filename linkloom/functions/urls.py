"""URL functions as Column expressions, and normalisation as a few projections.

A URL is split by one RFC 3986 expression rather than by parse_url, which gives null for hosts and paths that are common
in captured pages. Projections name what is used more than once, so Catalyst does not repeat an expression in its copies.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from . import rules

#: White space as str.strip() has it.
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_SPLIT = "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
_PORT = "(?s)^(?:.*@)?(?:\\[([^\\]]*)\\]|([^:]*))(?::(.*))?$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACES}+|{_SPACES}+$", "")


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def part(url: Column, n: int) -> Column:
    """Part n of url: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if missing."""
    return F.regexp_extract(url, _SPLIT, n)


def decoded(text: Column) -> Column:
    """text with + and %xx undone; a % that begins no escape stays."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(text: Column) -> Column:
    """text as a form value: letters, digits and _.-~ stay, a space becomes +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """array of (k, v) in order, decoded; a piece without = has an empty value."""
    pieces = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))


def query_key(key: Column) -> Column:
    return F.regexp_replace(key, "(?i)^(?:amp;)+", "")


def join_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def sort_query(query: Column) -> Column:
    """The query without tracking keys and blank values, sorted by key and value."""
    named = F.transform(query_pairs(query), lambda p: F.struct(query_key(p["k"]).alias("k"), p["v"].alias("v")))
    kept = F.filter(named, lambda p: (p["v"] != "") & (p["k"] != "") & ~p["k"].isin(rules.TRACKING_KEYS))
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit("")).otherwise(join_pairs(F.array_sort(kept)))


def query_params(query: Column) -> Column:
    """map of decoded parameters: the last value of a key counts, blank values do not."""
    filled = F.filter(query_pairs(query), lambda p: p["v"] != "")
    last = F.filter(filled, lambda p, i: ~F.exists(F.slice(filled, i + 2, F.greatest(F.size(filled), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def with_query(base: Column, pairs: list[tuple[str, Column]]) -> Column:
    """base and the parameters, in order, that are neither null nor empty."""
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs]), lambda p: F.coalesce(p["v"], F.lit("")) != "")
    return F.concat(base, F.when(F.size(known) > 0, F.concat(F.lit("?"), join_pairs(known))).otherwise(F.lit("")))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda s: s != "")


def filename(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def site_folder(site_key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(site_key), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def site_family(host: Column) -> Column:
    lowered = F.lower(host)
    routes = (lowered == rules.ROUTES_DOMAIN) | lowered.endswith("." + rules.ROUTES_DOMAIN)
    return F.when(routes, rules.FAMILY_ROUTES).when(host.endswith(rules.PORTAL_SUFFIX), rules.FAMILY_PORTAL).otherwise(rules.FAMILY_GENERIC)


def truncated(text: Column, limit: int = 120) -> Column:
    squeezed = strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{_SPACES}+", " "))
    return F.when(F.length(squeezed) <= limit, squeezed).otherwise(F.concat(F.substring(squeezed, 1, limit - 3), F.lit("...")))


def duration_ms(started: Column, finished: Column) -> Column:
    return ((finished - started) * 1000).cast("long")


def proxy_label(label: Column, server: Column) -> Column:
    filled = F.coalesce(F.nullif(label, F.lit("")), F.nullif(server, F.lit("")), F.lit(""))
    return F.coalesce(F.nullif(strip(filled), F.lit("")), F.lit("<direct>"))


def unescaped_js(text: Column) -> Column:
    return strip(F.replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\")), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')))


def js_call(value: Column) -> Column:
    """struct (name, args) of a call such as f('a', 1, "b"): only its string arguments count. Null if value is no call."""
    trimmed = strip(F.coalesce(value, F.lit("")))
    args = F.transform(F.regexp_extract_all(F.regexp_extract(trimmed, rules.JS_CALL, 2), F.lit(rules.JS_STRING), F.lit(2)), unescaped_js)
    return F.when(trimmed.rlike(rules.JS_CALL), F.struct(F.regexp_extract(trimmed, rules.JS_CALL, 1).alias("name"), args.alias("args")))


def route_fragment(fragment: Column) -> Column:
    """The fragment of a page of the route family: parameters sorted; of known routes only known, filled ones."""
    raw = F.regexp_replace(fragment, "^#", "")
    path = F.substring_index(raw, "?", 1)
    pairs = query_pairs(F.when(raw.contains("?"), F.regexp_replace(raw, "(?s)^[^?]*\\?", "")).otherwise(F.lit("")))
    known = F.lit(None).cast("array<string>")
    for route, names in rules.ROUTE_PARAMETERS.items():
        known = F.when(path == route, F.array(*map(F.lit, names))).otherwise(known)
    kept = F.filter(pairs, lambda p: known.isNull() | (F.array_contains(known, p["k"]) & (p["v"] != "")))
    query = join_pairs(F.array_sort(kept))
    whole = F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))
    return F.when(~raw.startswith("/") | (raw == "/"), raw).otherwise(whole)


def route_of(fragment: Column) -> Column:
    raw = F.regexp_replace(F.coalesce(fragment, F.lit("")), "^#", "")
    return F.when(raw.startswith("/"), F.substring_index(raw, "?", 1)).otherwise(F.lit(""))


def spa_route(route: Column) -> Column:
    """A route literal of a script as a path: without wildcards and :parameters; empty if there is nothing to follow."""
    candidate = strip(F.coalesce(route, F.lit("")))
    parts = F.filter(F.transform(F.split(F.substring_index(candidate, "?", 1), "/"), strip), lambda s: (s != "") & ~s.isin("*", "(.*)") & ~s.startswith(":"))
    path = F.concat(F.lit("/"), F.array_join(parts, "/"))
    query = sort_query(F.when(candidate.contains("?"), F.regexp_replace(candidate, "(?s)^[^?]*\\?", "")).otherwise(F.lit("")))
    dead = ~candidate.startswith("/") | path.isin("/", "/404") | path.rlike(f"(?i)^/(?:{'|'.join(rules.STATIC_PREFIXES)})(?:/|$)")
    return F.when(dead, F.lit("")).when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def _host_and_port(df: DataFrame, authority: Column, scheme: Column, prefix: str) -> DataFrame:
    """Adds prefix_host, prefix_netloc (host and a port that is not the scheme's own) and prefix_port_ok."""
    port = F.regexp_extract(authority, _PORT, 3)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    host = F.lower(F.concat(F.regexp_extract(authority, _PORT, 1), F.regexp_extract(authority, _PORT, 2)))
    df = df.withColumns({f"{prefix}_host": host, f"{prefix}_port": number, f"{prefix}_port_ok": (port == "") | F.coalesce(number <= 65535, F.lit(False))})
    own = ((scheme == "https") & (F.col(f"{prefix}_port") == 443)) | ((scheme == "http") & (F.col(f"{prefix}_port") == 80))
    shown = F.coalesce((F.col(f"{prefix}_port") > 0) & ~own, F.lit(False))
    return df.withColumn(f"{prefix}_netloc", F.when(shown, F.concat(F.col(f"{prefix}_host"), F.lit(":"), F.col(f"{prefix}_port").cast("string"))).otherwise(F.col(f"{prefix}_host")))


def _assembled(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    tail = lambda sign, x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit(sign), x))
    return F.concat(scheme, F.lit("://"), netloc, path, tail("?", query), tail("#", fragment))


def joined(base: Column, ref: Column) -> Column:
    """ref resolved against base; absolute references keep their dot segments."""
    scheme, path = F.lower(part(ref, 1)), part(ref, 3)
    base_scheme, base_path = F.lower(part(base, 1)), part(base, 3)
    web = ["http", "https"]
    rooted = path.startswith("/")
    folder = F.split(F.regexp_replace(base_path, "[^/]*$", ""), "/")
    own = F.split(path, "/")
    # a relative path joins the base's folder; empty segments between first and last go
    loose = F.concat(F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(0))), own)
    loose = F.filter(loose, lambda s, i: (i == 0) | (i == F.size(loose) - 1) | (s != ""))
    pieces = F.when(rooted, own).otherwise(loose)
    resolved = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    closed = F.when(F.element_at(pieces, -1).isin(".", ".."), F.array_append(resolved, F.lit(""))).otherwise(resolved)
    merged = F.array_join(closed, "/")
    query, fragment = part(ref, 4), part(ref, 5)
    full = lambda p, q: _assembled(base_scheme, part(base, 2), F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p), q, fragment)
    same = (scheme == "") | (scheme == base_scheme)
    return (
        F.when(ref == "", base)
        .when(~same | ~base_scheme.isin(web), ref)
        .when(part(ref, 2) != "", _assembled(base_scheme, part(ref, 2), path, query, fragment))
        .when(path == "", full(base_path, F.when(query == "", part(base, 4)).otherwise(query)))
        .otherwise(full(F.when(merged == "", F.lit("/")).otherwise(merged), query))
    )


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed at this point of the plan: a filter on them is not pushed below, into copies of what they are made of."""
    rest = [c for c in df.columns if c not in names]
    made = F.named_struct(*[x for n in names for x in (F.lit(n), F.col(n))])
    return df.select(*rest, F.explode(F.array(made)).alias("__settled")).select(*rest, *[F.col("__settled")[n].alias(n) for n in names])


def normalize(df: DataFrame, raw: str, base: str | None = None, out: str = "url") -> DataFrame:
    """df with the normalised URL of column raw as out, null where there is none, and its parts as out_scheme, out_host, out_path, out_query, out_fragment.

    df has the columns site_origin, site_host and site_family of the site that the URL is seen from. base names the
    column of the page's URL. Steps: repair of http:/x, pseudo-schemes, hash routes and routes of the route family,
    resolution, repair of an absolute URL inside a path, scheme of the own site, default ports and user info, slashes of
    the own site, sorted query, route parameters. A port that is no port number gives null.
    """
    t = {name: f"__{out}_{name}" for name in ("c", "p", "scheme", "authority", "path", "query", "fragment", "inner")}
    c = F.col(t["c"])
    routes = F.col("site_family") == rules.FAMILY_ROUTES
    broken = "(?i)(?:^|/)(https?):/([^/].*)$"
    df = df.withColumn(t["c"], F.nullif(strip(F.col(raw)), F.lit("")))
    repaired = F.concat(F.lower(F.regexp_extract(c, broken, 1)), F.lit("://"), F.regexp_extract(c, broken, 2))
    df = df.withColumn(t["c"], F.when(~c.contains("://") & c.rlike(broken), repaired).otherwise(c))
    placed = F.when(c.startswith("#/"), F.concat(F.col("site_origin"), F.lit("/"), c)).when(routes & starts_with_any(c, rules.ROUTE_PREFIXES), F.concat(F.col("site_origin"), F.lit("/#"), c))
    flat = F.regexp_replace(c, "[\\t\\r\\n]", "")
    placed = placed.otherwise(F.when(F.col(base).isNull(), flat).otherwise(joined(F.col(base), flat)) if base else flat)
    df = df.withColumn(t["c"], F.when(~c.rlike(f"(?i)^(?:{rules.PSEUDO_SCHEMES})"), placed))
    inner = "(?i)/(?:.*?/)?(https?):/([^/].*)$"
    web = F.lower(part(c, 1)).isin("http", "https") & (part(c, 2) != "")
    df = df.withColumn(t["inner"], F.when(web & part(c, 3).rlike(inner), part(c, 3)))
    embedded = F.col(t["inner"])
    df = df.withColumn(t["c"], F.when(embedded.isNotNull(), F.concat(F.lower(F.regexp_extract(embedded, inner, 1)), F.lit("://"), F.regexp_extract(embedded, inner, 2))).otherwise(c))
    df = df.withColumns({t[name]: part(c, n) for n, name in ((2, "authority"), (3, "path"), (4, "query"), (5, "fragment"))} | {t["scheme"]: F.lower(part(c, 1))})
    scheme = F.col(t["scheme"])
    df = _host_and_port(df, F.col(t["authority"]), scheme, t["p"])
    host, own = F.col(f"{t['p']}_host"), F.col(f"{t['p']}_host") == F.col("site_host")
    path = F.when(F.col(t["path"]) == "", F.lit("/")).otherwise(F.col(t["path"]))
    df = df.withColumns(
        {
            f"{out}_scheme": F.when(own & scheme.isin("http", "https"), F.lower(part(F.col("site_origin"), 1))).otherwise(scheme),
            f"{out}_host": host,
            f"{out}_path": F.when(own, F.regexp_replace(path, "/{2,}", "/")).otherwise(path),
            f"{out}_query": sort_query(F.col(t["query"])),
            f"{out}_fragment": F.when(routes & own, route_fragment(F.col(t["fragment"]))).otherwise(F.col(t["fragment"])),
        }
    )
    good = scheme.isin("http", "https") & (host != "") & F.col(f"{t['p']}_port_ok")
    whole = _assembled(F.col(f"{out}_scheme"), F.col(f"{t['p']}_netloc"), F.col(f"{out}_path"), F.col(f"{out}_query"), F.col(f"{out}_fragment"))
    df = df.withColumn(out, F.when(scheme == "blob", c).when(good, whole))
    df = df.drop(*t.values(), *[f"{t['p']}_{x}" for x in ("host", "port", "port_ok", "netloc")])
    return settled(df, out, *[f"{out}_{x}" for x in ("scheme", "host", "path", "query", "fragment")])


def normalize_seed(df: DataFrame, raw: str, out: str = "url") -> DataFrame:
    """df with the normalised seed URL of column raw as out, and out_site_key, out_host, out_origin. Comments and other schemes give null."""
    c = F.col("__seed")
    df = df.withColumn("__seed", strip(F.col(raw)))
    df = df.withColumn("__seed", F.when((c == "") | c.startswith("#"), F.lit(None)).when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c)))
    scheme = F.lower(part(c, 1))
    df = _host_and_port(df.withColumn("__seed_scheme", scheme), part(c, 2), scheme, "__seed_p")
    good = F.col("__seed_scheme").isin("http", "https") & (F.col("__seed_p_host") != "") & F.col("__seed_p_port_ok")
    path = F.when(part(c, 3) == "", F.lit("/")).otherwise(part(c, 3))
    df = df.withColumns(
        {
            out: F.when(good, _assembled(F.col("__seed_scheme"), F.col("__seed_p_netloc"), path, sort_query(part(c, 4)), part(c, 5))),
            f"{out}_site_key": F.when(good, F.col("__seed_p_netloc")),
            f"{out}_host": F.when(good, F.col("__seed_p_host")),
            f"{out}_origin": F.when(good, F.concat(F.col("__seed_scheme"), F.lit("://"), F.col("__seed_p_netloc"))),
        }
    )
    df = df.drop("__seed", "__seed_scheme", *[f"__seed_p_{x}" for x in ("host", "port", "port_ok", "netloc")])
    return settled(df, out, f"{out}_site_key", f"{out}_host", f"{out}_origin")
