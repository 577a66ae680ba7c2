"""URL filters with redirect equivalence.

A rule (verdict, host, path) fits a url if the url's host is the rule's host or
a subdomain of it and the url's path starts with the rule's path; the longest
fitting rule wins. A url that no rule fits takes the block decision of its
aliases: pages are joined to the urls that their canonical links, og:url tags
and meta refreshes name, connected components over these edges form alias
classes, and a class that holds a blocked url blocks its unruled pages. An
explicit allow always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.graph import components

# The rules in force.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

_LINK_TAGS = r"(?is)<(?:link|meta)\b[^>]++>"
# What names a target, and where the tag holds it if it is not absolute.
_TARGETS = ((r"(?i)rel\s*=\s*[\"']?canonical", r"(?i)\bhref\s*=\s*[\"']?([^\s\"'>]+)"),
            (r"(?i)property\s*=\s*[\"']?og:url", r"(?i)\bcontent\s*=\s*[\"']?([^\s\"'>]+)"),
            (r"(?i)http-equiv\s*=\s*[\"']?refresh", r"(?i)\bcontent\s*=\s*[\"']?[\d.]+\s*;\s*url\s*=\s*[\"']?([^\s\"'>]+)"))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(_after(url), r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest fitting rule, or null. A rule's text is
    its host and path; equally long ones are ordered by it."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))
    return F.coalesce(*[
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
               F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered])


def node_of(url: Column) -> Column:
    """Identity of a url: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(F.length(host_of(url)) > 0, F.concat(host_of(url), rest))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its segments ``.`` and ``..`` resolved."""
    parts = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(target: Column, page: Column) -> Column:
    """Absolute form of a url without scheme, named by a page; null if it has
    another scheme (``mailto:``), is a fragment, or the page's url has no host."""
    at, base = F.concat(F.lit("x://"), host_of(page)), F.when(path_of(page) == "", "/").otherwise(path_of(page))
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    query = F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.regexp_extract(base, r"(?s)^.*/", 0), path))
    return (F.when((target == "") | F.startswith(target, F.lit("#")) | target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
             .when(F.startswith(target, F.lit("//")), F.concat(F.lit("x:"), target))
             .when(host_of(page) == "", F.lit(None))
             .when(path == "", F.concat(at, base, query)).otherwise(F.concat(at, _without_dots(whole), query)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(page's node, named node) for every url that a page's canonical link,
    og:url or meta refresh names; relative ones belong to the page's url
    (``<base>`` is not read)."""
    tags = pages.select("url", node_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(_LINK_TAGS), F.lit(0))).alias("tag"))
    named = tags.where(F.col("tag").rlike(r"(?i)rel\s*=\s*[\"']?canonical|property\s*=\s*[\"']?og:url|http-equiv\s*=\s*[\"']?refresh"))
    relative = F.coalesce(*[F.when(F.col("tag").rlike(kind), F.regexp_extract("tag", place, 1)) for kind, place in _TARGETS])
    absolute = named.select("url", "a", relative.alias("relative"), F.regexp_extract("tag", r"(?i)(?:href\s*=\s*[\"']?|content\s*=\s*[\"']?(?:[\d.]+\s*;\s*url\s*=\s*[\"']?)?)([a-z][a-z0-9+.-]*://[^\s\"'>]+)", 1).alias("named"))
    return absolute.select("a", node_of(F.when(F.col("named") != "", F.col("named")).otherwise(
        resolved(F.col("relative"), F.col("url")))).alias("b"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    A null url, or one without ``://``, has empty host and path, fits no rule, is
    in no alias class and is allowed. A null html names nothing. Repeated rows
    and urls are judged alike; other columns are not read.
    """
    edges = alias_edges(pages)
    classes = components(edges, "a", "b").select("node", "root")
    url = F.concat(F.lit("x://"), F.col("node"))
    blocked = (classes.where(best_rule(host_of(url), path_of(url), rules)["verdict"] == "block")
                      .select("root").distinct())
    hit = classes.join(blocked, "root").select("node", F.lit(True).alias("alias_blocked"))
    own = pages.select("page_id", F.col("url").alias("u")).select(
        "page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), node_of(F.col("u")).alias("node"))
    own = own.withColumn("r", best_rule(F.col("host"), F.col("path"), rules)).join(hit, "node", "left")
    return own.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(
        "r.verdict", F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"))
