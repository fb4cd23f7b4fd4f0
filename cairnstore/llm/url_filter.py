"""URL filters with redirect equivalence.

A page's own rule is the longest that fits its host or a parent domain and
begins its path. Addresses that a redirect or a canonical link ties together are
aliases: connected components over those edges carry decisions to addresses
without a rule. Within a component an allowed member outweighs blocked ones; an
own rule always stands.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import LOWER, UPPER
from .spark_tools import broadcast_if_small, components, materialize

#: Rules that are broadcast at most; more meet the pages by shuffle.
SMALL = 100_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _address(url: Column) -> Column:
    """The address that stands for all spellings of one: scheme and host lower-cased, no fragment; null without a host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(scheme, F.lit("://"), host(url), F.when(rest == "", "/").otherwise(rest)))


def _resolved(link: Column, base: Column) -> Column:
    """A link's address, relative to the page it stands on; null if there is none."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*((?:/[^/?#]*)*/)", 1)
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
    return F.when(F.coalesce(link, F.lit("")) != "", _address(full))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _links(html: Column) -> Column:
    """The targets of all canonical links and refreshes of a page, comments left out."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda tag: _attribute(tag, "rel").rlike(r"(?is)(^|\s)canonical(\s|$)"))
    metas = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    refresh = F.filter(metas, lambda tag: _attribute(tag, "http-equiv").rlike(r"(?is)^\s*refresh\s*$"))
    targets = F.transform(refresh, lambda tag: F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*["']?([^"']*)""", 1))
    return F.concat(F.transform(canonical, lambda tag: _attribute(tag, "href")), targets)


def _rules(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    table = spark.createDataFrame(
        [(r.host, r.path, r.action, r.host + r.path) for r in rules], "rule_host string, rule_path string, action string, rule string"
    )
    return broadcast_if_small(table, len(rules), SMALL)


def ruled(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, rule, action) of the rows (key, host, path) that a rule fits: the longest, of equals that of the longer host."""
    labels = F.split("host", r"\.")
    deepest = max((r.host.count(".") + 1 for r in rules), default=1)
    first = F.greatest(F.lit(1), F.size(labels) - deepest + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(deepest)), "."))
    spread = rows.select(key, "path", F.explode(suffixes).alias("suffix"))
    fit = spread.join(_rules(rows.sparkSession, rules), F.col("suffix") == F.col("rule_host")).where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule"), F.length("rule_host"), "rule", "action"))
    return fit.groupBy(key).agg(best.alias("_best")).select(key, "_best.rule", "_best.action")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per row of pages: page_id, host, path, rule (null without) and verdict.

    redirects: optional (source, target) addresses besides all the pages' own canonical
    links and refreshes. Aliases may be addresses that are no page; their rules count.
    Pages whose url has no host have no aliases. A page without a rule takes allow if
    an alias is allowed by a rule, else block if one is blocked, else `default`. Null
    urls and html are empty; rows with one page_id or url are judged each for itself. If
    a host and path have both an allow and a block rule, the block rule holds. Extra
    columns are ignored.
    """
    spark = pages.sparkSession
    url = F.col("url")
    own = pages.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        host(url).alias("host"),
        path(url).alias("path"),
        _address(url).alias("address"),
        F.transform(_links(F.coalesce("html", F.lit(""))), lambda x: _resolved(x, url)).alias("links"),
    )
    own = materialize(own)
    edges = own.select(F.col("address").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_address(F.col("source")).alias("a"), _address(F.col("target")).alias("b")))
    groups = materialize(components(edges.where("a is not null and b is not null")))
    members = groups.select("node", host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    decided = groups.join(ruled(members, "node", rules), "node").groupBy("component")
    decided = decided.agg(F.max((F.col("action") == "allow").cast("int")).alias("_allowed"))
    aliases = groups.join(decided, "component").select("node", F.when(F.col("_allowed") == 1, "allow").otherwise("block").alias("_by_alias"))
    # Pages without an address get a key of their own that no address has, so that they don't meet in one task.
    key = F.coalesce("address", F.col("row").cast("string"))
    aliases = broadcast_if_small(aliases, aliases.count(), SMALL)
    out = own.drop("links").join(ruled(own, "row", rules), "row", "left").withColumn("_key", key).join(aliases, F.col("_key") == F.col("node"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "_by_alias", F.lit(default)).alias("verdict"))
