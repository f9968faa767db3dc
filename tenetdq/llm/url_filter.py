"""URL allow and block rules with redirect equivalence, in DataFrame functions only.

A url is judged by the longest rule that fits its host (or a parent domain) and its path's beginning. Urls without
a rule are judged by their aliases: pages that redirect (``meta refresh``) or point by a canonical link to
another url form edges between urls, whether or not the target is a page of the table; a connected component is
one resource. If any of its urls is explicitly allowed the component is allowed, else if any is blocked it is
blocked, else it is allowed. A url's own rule always stands.

Links are resolved as RFC 3986 says, against the page's ``<base href>`` (itself resolved against the page's url) or else its url: relative paths,
dot segments, queries and fragments. Links of schemes without a host make no edge.

Urls are the same node when host (lower-cased), path without dot segments, and query agree; scheme and fragment don't matter.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; null html has
no edges; html of any length is searched whole; repeated pages are each judged; of rules of one length that fit, the last one given stands;
columns other than page_id, url and html are ignored, whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetdq.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
SCHEME = "(?i)^[a-z][a-z0-9+.-]*:"
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


# Each step below is a column of its own: nested into one expression, the links' many cases would multiply.
def without_dots(rows: DataFrame, path: str) -> DataFrame:
    """Takes ``.`` and ``..`` segments out of a column of paths (RFC 3986, 5.2.4)."""
    dotted = F.col(path).startswith("/") & F.col(path).contains("/.")
    rows = rows.withColumn("__parts", F.when(dotted, F.split(path, "/")))
    rows = rows.withColumn("__kept", F.aggregate(
        F.slice("__parts", F.lit(2), F.size("__parts")), F.array().cast("array<string>"),
        lambda held, s: F.when(s == ".", held).when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
        .otherwise(F.concat(held, F.array(s)))))
    ended = F.when(F.element_at("__parts", -1).isin(".", ".."), F.concat("__kept", F.array(F.lit("")))).otherwise(F.col("__kept"))
    return rows.withColumn(path, F.when(F.col("__parts").isNotNull(), F.concat(F.lit("/"), F.array_join(ended, "/")))
                           .otherwise(F.col(path))).drop("__parts", "__kept")


def named(rows: DataFrame, url: str, node: str) -> DataFrame:
    """Adds ``node``: host, path and query as one name; null where there is no host."""
    rows = rows.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url)), "__query": F.regexp_extract(url, URL, 3)})
    return without_dots(rows, "__path").withColumn(
        node, F.when(F.col("__host") != "", F.concat("__host", "__path", "__query"))).drop("__host", "__path", "__query")


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule's text. ``rules`` are (verdict, host and path), a short list of parameters."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):               # longer rules are asked first
        at = rule.index("/")
        domain, start = rule[:at], rule[at:]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    said = F.lit(None).cast("string")
    for verdict, text in rules:
        said = F.when(rule == text, F.lit(verdict)).otherwise(said)
    return said


def resolved(rows: DataFrame, link: str, base: str, out: str) -> DataFrame:
    """Adds ``out``: the absolute form of a link found on the page at ``base`` (RFC 3986, 5.2.2), without fragment; null where it has no host."""
    clean = F.regexp_replace(F.replace(F.col(link), F.lit("&amp;"), F.lit("&")), "(?s)#.*$", "")
    rows = rows.withColumns({"__t": clean, "__root": F.concat(F.lit("x://"), host_of(F.col(base))), "__path": path_of(F.col(base))})
    rows = without_dots(rows, "__path").withColumns({
        "__p": F.regexp_extract("__t", r"(?s)^([^?]*)", 1), "__q": F.regexp_extract("__t", r"(?s)(\?.*)$", 1),
        "__folder": F.regexp_extract("__path", r"(?s)^(.*/)", 1)})
    target, path, query = F.col("__t"), F.col("__p"), F.col("__q")
    own = (F.when(F.regexp_like(target, F.lit(f"{SCHEME}//")), target)
           .when(F.regexp_like(target, F.lit(SCHEME)), F.lit(None))
           .when(target.startswith("//"), F.concat(F.lit("x:"), target))
           .when(path == "", F.concat("__root", "__path", F.when(query != "", query).otherwise(F.regexp_extract(base, URL, 3))))
           .when(path.startswith("/"), F.concat("__root", target))
           .otherwise(F.concat(F.col("__root"), F.when(F.col("__folder") == "", F.lit("/")).otherwise(F.col("__folder")), target)))
    return rows.withColumn(out, own).drop("__t", "__root", "__path", "__p", "__q", "__folder")


def alias_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between urls: all canonical links and redirects of each page."""
    has = F.regexp_like("html", F.lit("(?i)canonical|http-equiv"))
    found = pages.select("url", "html").where(has).withColumns({
        "first": F.nullif(F.regexp_extract("html", BASE, 1), F.lit("")),
        "links": F.concat(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH)])}).where(
        (F.size("links") > 0) & (host_of(F.col("url")) != "")).drop("html")
    found = resolved(found, "first", "url", "stated").select("url", F.coalesce("stated", "url").alias("base"), F.explode("links").alias("link"))
    ends = named(named(resolved(found.where("link <> ''"), "link", "base", "to"), "url", "a"), "to", "b")
    return ends.where("a is not null and b is not null and a <> b").select("a", "b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and by (rule, alias or default)."""
    members = components(alias_links(pages)).withColumn("url", F.concat(F.lit("x://"), F.col("node")))
    members = members.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    members = members.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).drop("url", "host", "path")
    said = members.select("node", "label", verdict_of(F.col("rule"), rules).alias("said"))
    decided = said.groupBy("label").agg(
        F.when(F.max((F.col("said") == "allow").cast("int")) == 1, F.lit("allow"))
        .when(F.max((F.col("said") == "block").cast("int")) == 1, F.lit("block")).alias("decided"))
    aliases = members.drop("rule").join(decided.where("decided is not null"), "label").select("node", "decided")
    rows = named(pages.select("page_id", "url"), "url", "node")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = verdict_of(F.col("rule"), rules)
    return rows.join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(own, "decided", F.lit("allow")).alias("verdict"),
        F.when(own.isNotNull(), "rule").when(F.col("decided").isNotNull(), "alias").otherwise("default").alias("by"))
