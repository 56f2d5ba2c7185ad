"""Url rules, and verdicts that pass along redirects and canonical links.

DataFrame functions only. A page's url is tied to what it stands for: the same url without
fragment and with https, the target of a <link rel="canonical">, and that of a <meta
http-equiv="refresh">. Connected components over these edges are aliases of one resource. A url
that a rule names has the rule's verdict. The others follow their aliases: allow if a rule
allows one of them, else block if a rule blocks one, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .components import components

#: (verdict, host, path): a rule fits the host and its subdomains if the url's path begins with its path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: scheme, authority, path, and all behind the authority up to the fragment
_URL = r"(?s)\A(.*?)://([^/?#]*)([^?#]*)"
_TAIL = r"(?s)\A.*?://[^/?#]*([^#]*)"


def host_of(url: Column) -> Column:
    """Between the first '://' and the next '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 2), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(text, verdict); null if none does."""
    best = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("text"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<text string, verdict string>")


def resource(url: Column) -> Column:
    """The url that a server would be asked for over https: no fragment, scheme and host in lower case."""
    tail = F.regexp_replace(F.regexp_extract(url, _TAIL, 1), r"\A\z", "/")
    scheme = F.regexp_replace(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), r"\Ahttp\z", "https")
    return F.when(url.contains("://"), F.concat(
        scheme, F.lit("://"), F.translate(F.regexp_extract(url, _URL, 2), _UPPER, _LOWER), tail)).otherwise(url)


def _links(html: Column) -> Column:
    """Targets of canonical links and of refreshing meta tags, in any order of attributes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?is)\A<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")),
        lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?is)\A<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh""")),
        lambda t: F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    return F.filter(F.concat(canonical, refresh), lambda t: t != "")


def _absolute(base: Column, target: Column) -> Column:
    """A link's target as seen from a page: with scheme, //host, /path, or relative to the page's folder."""
    root = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    return (F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.substring_index(base, "//", 1), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.rlike(r"\A([#?]|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
            .otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), target)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): urls that are aliases by redirect, canonical link, fragment or scheme."""
    has_url = pages.select("url", "html").where(F.col("url").contains("://"))
    own = has_url.select(F.col("url").alias("a"), resource(F.col("url")).alias("b"))
    tagged = has_url.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    linked = (tagged.select("url", F.explode(_links(F.col("html"))).alias("t"))
              .select("url", _absolute(F.col("url"), F.col("t")).alias("to"))
              .select(F.col("url").alias("a"), resource(F.col("to")).alias("b")))
    return own.union(linked).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def _with_rule(frame: DataFrame, url: str, rules) -> DataFrame:
    """Adds host, path and hit, the struct of rule_of."""
    return (frame.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
            .withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)))


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`.

    pages: page_id, url, html; other columns are ignored. A rule's length is that of host and
    path together; of equally long ones allow goes first. A null url or one without '://' has
    empty host and path, no rule, no alias, and is allowed. Null or empty html gives no links.
    Repeated rows are judged alike. An empty table gives no rows.
    """
    slim = settle(_with_rule(pages.select("page_id", "url"), "url", rules), "judged-urls")
    aliases = components(alias_edges(pages), "aliases")
    # targets that are no page themselves count too if a rule names them
    named = _with_rule(aliases, "node", rules)
    decided = named.where("hit IS NOT NULL").groupBy("root").agg(F.min(F.col("hit.verdict")).alias("decision"))  # allow < block
    inherited = aliases.join(decided, "root").select(F.col("node").alias("url"), "decision")
    open_ = slim.where("hit IS NULL AND contains(url, '://')").join(inherited, "url", "left")
    closed = slim.where("hit IS NOT NULL OR url IS NULL OR NOT contains(url, '://')").withColumn("decision", F.lit(None).cast("string"))
    return open_.unionByName(closed).select(
        "page_id", "host", "path", F.col("hit.text").alias("rule"),
        F.coalesce("hit.verdict", "decision", F.lit("allow")).alias("verdict"))
