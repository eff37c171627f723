"""Operator 1: url filters with path-template trees, with DataFrame functions only.

Rules come first: of those whose host is the url's or a parent of it, and whose path starts the url's path,
the longest decides. What no rule decides, the templates of its host do. They are learned from the urls that
rules decide, as labels:

1. Segments are generalised by form: runs of digits and long hexadecimal runs become placeholders. Urls are
   added up by host and form, so all further tables have a row for each distinct form and not for each url.
2. Level by level from the root, a segment becomes a wildcard where its share of blocked labels is like that of
   its labelled siblings together (a two-proportion test), and where it has no labels and is variable: fewer than
   one in ``fanout`` urls of its parent have it. Segments with labels never join those without unless they pass the test.
3. A template's purity is its share of blocked labels, smoothed by the host's, which is smoothed by the
   share of all. It is rejected if it has ``support`` labels, a purity of ``purity`` and labels for ``cover`` of its
   urls, so that a few ruled urls cannot reject many others.

All criteria are shares or tests, so they say the same for a table of any size. A null url, or one without ``://``,
has empty host and path; long urls are read whole. Urls below ``depth`` segments are generalised in their first
``depth`` ones. Repeated rows are judged alike; a null page_id is kept. Of rules of one length (ties) the later
one holds. Further columns, whatever their names, are ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.storage import materialize

#: (verdict, rule)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url, empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_of(host, path, rules) -> tuple[F.Column, F.Column]:
    """The rule that fits (null if none) and its verdict; rules are a list of a few hundred at most."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}") if "/" in rule else (host == name) | host.endswith(f".{name}")
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, action).otherwise(verdict)
    return found, verdict


def form(path) -> F.Column:
    """The path with long hexadecimal runs and runs of digits as placeholders."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "{h}"), "[0-9]+", "{n}")


def templates(forms: DataFrame, fanout: int = 50, depth: int = 4, z: float = 1.64, least: int = 5) -> DataFrame:
    """host, form and template of a table of host, form, urls, labelled and blocked. The table of a level's branches
    is written once, so plans do not grow with the depth."""
    own = ["host", "form", "urls", "labelled", "blocked"]
    rows = forms.select(*own, F.split(F.regexp_replace("form", "^/", ""), "/", depth).alias("parts"), F.lit("").alias("template"))
    for level in range(depth):
        rows = rows.withColumn("part", F.get("parts", F.lit(level)))
        branch = rows.where("part is not null").groupBy("host", "template", "part").agg(F.sum("urls").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        all_of = branch.groupBy("host", "template").agg(F.sum("n").alias("an"), F.sum("l").alias("al"), F.sum("b").alias("ab"))
        pooled = "(ab / al)"
        like = f"l >= {least} and al - l >= {least} and abs(b / l - (ab - b) / (al - l)) <= {z} * sqrt({pooled} * (1 - {pooled}) * (1 / l + 1 / (al - l)))"
        wild = materialize(branch.join(all_of, ["host", "template"]).where(f"case when l = 0 then n * {fanout} < an else {like} end").select("host", "template", "part", F.lit("*").alias("star")), "branches", small=True)
        rows = rows.join(wild, ["host", "template", "part"], "left").withColumn("template", F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("star", "part"))))
        rows = rows.select(*own, "parts", "template")
    return rows.select("host", "form", "template", "urls", "labelled", "blocked")


def filter_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", purity: float = 0.8, support: int = 5, smooth: float = 4.0, cover: float = 0.2, **options) -> DataFrame:
    """page_id, host, path, rule, template, labelled and verdict of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), form(F.col("path")).alias("form"))
    forms = rows.groupBy("host", "form").agg(F.count("*").alias("urls"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    tree = materialize(templates(materialize(forms, "forms", small=True), **options), "templates", small=True)
    everywhere = tree.agg(F.sum("labelled").alias("gl"), F.sum("blocked").alias("gb")).select((F.coalesce(F.col("gb") / F.nullif("gl", F.lit(0)), F.lit(0.0))).alias("g"))
    share = everywhere.first()[0]  # one number
    hosts = tree.groupBy("host").agg(((F.sum("blocked") + smooth * share) / (F.sum("labelled") + smooth)).alias("prior"))
    own = tree.groupBy("host", "template").agg(F.sum("urls").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    own = own.join(hosts, "host").withColumn("purity", (F.col("blocked") + smooth * F.col("prior")) / (F.col("labelled") + smooth))
    judged = own.select("host", "template", "labelled", ((F.col("labelled") >= support) & (F.col("purity") >= purity) & (F.col("labelled") >= cover * F.col("urls"))).alias("rejected"))
    table = tree.select("host", "form", "template").join(judged, ["host", "template"])
    out = rows.join(table, ["host", "form"], "left")
    return out.select("page_id", "host", "path", "rule", "template", "labelled", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))
