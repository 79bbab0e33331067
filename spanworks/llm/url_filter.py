"""URL filters whose decisions reach aliases by redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_sized, lower_az, staged
from .components import connected_components

#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def with_parts(rows: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds host (A-Z lower-cased) and path of a url; both empty without `://`."""
    known = F.coalesce(F.col(url), F.lit(""))
    rows = rows.withColumn("_rest", F.when(known.contains("://"), F.regexp_replace(known, r"(?s)^.*?://", "")).otherwise(""))
    rows = rows.withColumn("_host", F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0)).withColumn(path, F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
    return rows.withColumn(host, lower_az(F.col("_host"))).drop("_rest", "_host")


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, or null. Rules are a short list, a parameter."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def with_node(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Adds what urls are compared by: host, path and query, without scheme and fragment; null without a host."""
    rows = with_parts(rows, url, "_h", "_p").withColumn("_q", F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1))
    return rows.withColumn(name, F.when(F.col("_h") != "", F.concat("_h", F.when(F.col("_p") == "", "/").otherwise(F.col("_p")), "_q"))).drop("_h", "_p", "_q")


def with_absolute(rows: DataFrame, base: str, link: str, name: str) -> DataFrame:
    """Adds a link as an absolute url, seen from a page, with `.` and `..` in its path folded; a path that would leave the
    root stays there. Each part is made once, in a step of its own."""
    rows = rows.withColumns({
        "_link": F.trim(F.regexp_replace(link, "&amp;", "&")), "_root": F.regexp_extract(base, r"(?s)^([^?#]*?://[^/?#]*)", 1), "_folder": F.regexp_extract(base, r"(?s)^[^?#]*?://[^/?#]*([^?#]*/)", 1),
        "_scheme": F.regexp_extract(base, r"(?s)^([^?#]*?:)//", 1)})
    to, root, folder = F.col("_link"), F.col("_root"), F.col("_folder")
    whole = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat("_scheme", to)).when(to.startswith("/"), F.concat(root, to))
    rows = rows.withColumn("_whole", whole.otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), to)))
    steps = F.split(F.regexp_extract("_whole", r"(?s)^[^?#]*?://[^/?#]*/([^?#]*)", 1), "/", -1)
    path = F.aggregate(steps, F.lit(""), lambda acc, s: F.when(s == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(s == ".", acc).otherwise(F.concat(acc, F.lit("/"), s)))
    rows = rows.withColumn(name, F.concat(F.regexp_extract("_whole", r"(?s)^([^?#]*?://[^/?#]*)", 1), path, F.regexp_extract("_whole", r"(?s)^[^?#]*([?#].*)$", 1)))
    return rows.drop("_link", "_root", "_folder", "_scheme", "_whole")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of the pages and of what they redirect to (meta refresh) or call canonical. A relative link is seen
    from the page's first base href, if it has one."""
    tag = lambda name: F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    either = lambda t, name: F.concat(*[F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i) for i in (1, 2, 3)])
    canonical = F.transform(F.filter(tag("link"), lambda t: F.lower(either(t, "rel")) == "canonical"), lambda t: either(t, "href"))
    refresh = F.transform(F.filter(tag("meta"), lambda t: F.lower(either(t, "http-equiv")) == "refresh"), lambda t: F.regexp_extract(either(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    base = either(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href")
    marked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    links = staged(marked.select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("link")))  # a few, cut out of much html
    links = with_absolute(links, "url", "base", "based").withColumn("seen_from", F.when(F.col("base") == "", F.col("url")).otherwise(F.col("based")))
    links = with_absolute(links, "seen_from", "link", "target")
    return with_node(with_node(links, "url", "a"), "target", "b").select("a", "b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict, alias_of_blocked.

    The longest rule that fits decides. A page that no rule fits is blocked if redirects or canonical links, followed
    both ways and over any number of steps, connect it to a url that a rule blocks; an explicit allow rule keeps its own
    page from that. All else is allowed. redirects: further edges (from_url, to_url).
    Null urls and urls without `://` have an empty host and path, fit no rule and are no one's alias: allowed. Null or
    empty html has no links. Rows that repeat a page_id each get a verdict. An empty table gives no rows. Other columns
    are not read. Edges are shuffled; pages by node, unless the aliases are counted to be few; a hot host is no key.
    """
    judged = with_parts(pages.select("page_id", "url")).withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(with_node(with_node(redirects, "from_url", "a"), "to_url", "b").select("a", "b"))
    found = staged(connected_components(staged(edges.where("a <> b")), "a", "b"))
    node_host, rest = F.regexp_extract("node", r"(?s)^[^/]*", 0), F.regexp_extract("node", r"(?s)^[^/]*(/[^?]*)", 1)
    blocked = found.where(longest_rule(node_host, rest, rules).verdict == "block").select("component").distinct()
    aliases = staged(found.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias")))
    joined = join_sized(with_node(judged, "url", "node"), aliases, "node", "left").withColumn("alias_of_blocked", F.coalesce("alias", F.lit(False)))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("alias_of_blocked"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias_of_blocked")
