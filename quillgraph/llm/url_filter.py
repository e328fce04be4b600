"""URL filter: explicit host and path rules, and a tree of path templates for every other URL.

Per host, paths are generalised segment by segment: digits and hexadecimal ids become wildcards by their shape. Then, level
by level from the root, the children of a node merge where they are alike:

- Their labelled rates do not differ significantly from that of all their siblings (a child without labels may be alike).
- Rare ones among many siblings become ``{*}``.
- Those whose next segments are spread as all their siblings' are (by the chi-squared statistic) become ``{~}``.

A node's purity is its share of bad labels, smoothed towards what the rest of its parent says, which is smoothed alike, and
the host's towards a prior; so a node with few labels, or none, is judged by what is known around it, and no label counts
twice. A page whose template's purity reaches the threshold is rejected. Labels are the verdicts of the explicit rules, and any (page_id, bad) table given besides.

Only counts per (host, path shape) enter the tree; rows meet it again in one equi-join, which AQE can split where a
host is hot. Nulls: a null url or one without ``://`` has an empty host and path. Repeated rows are judged apart. Urls of
any length are judged whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(r"(?s)^.*?://([^/?#]*)"), upper, upper.lower()), part(r"(?s)^.*?://[^/?#]*([^?#]*)")


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column, depth: int) -> Column:
    """Segments of a path with variable parts replaced by their shape; what is deeper than ``depth`` is one segment."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    folded = F.when(F.size(segments) <= depth, segments).otherwise(F.concat(F.slice(segments, 1, depth - 1), F.array(F.array_join(F.slice(segments, depth, 1 << 30), "/"))))
    plain = lambda s: F.translate(s, "{}", "()")  # noqa: E731  braces mark wildcards
    return F.transform(folded, lambda s: F.when(s.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{id}")).otherwise(F.regexp_replace(plain(s), "[0-9]+", "{n}")))


#: What follows a path's last segment.
END = "{end}"
#: Differences below this are rounding.
CLOSE = 1e-9


def build_tree(leaves: DataFrame, min_children: int, max_share: float, z: float, smoothing: float, prior: float) -> DataFrame:
    """Adds ``template`` and ``purity`` to (host, shape, n, labelled, bad), level by level from the root."""
    root = leaves.groupBy("host").agg(((F.sum("bad") + smoothing * prior) / (F.sum("labelled") + smoothing)).alias("purity"))
    at = written(leaves.join(root, "host").withColumns({"base": F.lit(float(prior)), "template": F.lit("")}), "urltree")
    deepest = at.agg(F.max(F.size("shape"))).first()[0] or 0
    node = ["host", "template"]
    for level in range(deepest):
        here = at.withColumns({"segment": F.get("shape", F.lit(level)), "next": F.coalesce(F.get("shape", F.lit(level + 1)), F.lit(END))})
        inner = here.filter("segment is not null")
        child = inner.groupBy(*node, "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        parent = child.groupBy(*node).agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")))
        pooled = inner.groupBy(*node, "next").agg(F.sum("n").alias("all_next"))
        kinds = pooled.groupBy(*node).agg((F.count("*") - 1).alias("freedom"))
        cells = inner.groupBy(*node, "segment", "next").agg(F.sum("n").alias("cell")).join(pooled, [*node, "next"])
        squares = cells.groupBy(*node, "segment").agg(F.sum(F.col("cell") * F.col("cell") / F.col("all_next")).alias("squares"))
        judged = child.join(parent, node).join(kinds, node).join(squares, [*node, "segment"])
        rate = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        alike = (F.col("labelled") == 0) | (F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - rate) <= z * F.sqrt(rate * (1 - rate) / F.greatest("labelled", F.lit(1))) + CLOSE)
        rare = (F.col("children") >= min_children) & (F.col("n") <= max_share * F.col("all_n"))
        chi = F.col("squares") * F.col("all_n") / F.col("n") - F.col("n")  # of the child's next segments against its siblings'
        spread = chi <= F.col("freedom") + z * F.sqrt(2 * F.greatest("freedom", F.lit(1))) + CLOSE
        branch = F.when(alike & rare, "{*}").when(alike & spread, "{~}")
        judged = written(judged.select(*node, "segment", branch.alias("branch"), "labelled", "bad"), "urltree")
        several = judged.filter("branch is not null").groupBy(*node, "branch").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
        merged = several.withColumn("merged", F.lit(True))
        named = judged.join(merged, [*node, "branch"], "left").select(*node, "segment", F.when(F.col("merged"), F.col("branch")).otherwise(F.col("segment")).alias("branch"), "labelled", "bad")
        known = named.groupBy(*node, "branch").agg(F.sum("labelled").alias("branch_labelled"), F.sum("bad").alias("branch_bad"))
        whole = here.groupBy(*node).agg(F.sum("labelled").alias("whole_labelled"), F.sum("bad").alias("whole_bad"))
        grown = here.join(named.select(*node, "segment", "branch"), [*node, "segment"], "left").join(known, [*node, "branch"], "left").join(whole, node)
        inside = F.col("segment").isNotNull()
        grown = grown.withColumn("rest", (F.col("whole_bad") - F.col("branch_bad") + smoothing * F.col("base")) / (F.col("whole_labelled") - F.col("branch_labelled") + smoothing))
        purity = F.when(inside, (F.col("branch_bad") + smoothing * F.col("rest")) / (F.col("branch_labelled") + smoothing)).otherwise(F.col("purity"))
        template = F.when(inside, F.concat("template", F.lit("/"), "branch")).otherwise(F.col("template"))
        at = written(grown.select("host", "shape", "n", "labelled", "bad", purity.alias("purity"), F.coalesce("rest", "base").alias("base"), template.alias("template")), "urltree")
    return at


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = 8, min_children: int = 16, max_share: float = 0.05, z: float = 2.0, smoothing: float = 4.0, prior: float = 0.25, reject_at: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (see above) of every page."""
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", match_rule(F.col("host"), F.col("path"), rules).alias("fit"), shape(F.col("path"), depth).alias("shape"))
    bad = F.when(F.col("fit.verdict").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    seen = rows.select("page_id", "host", "shape", bad.alias("bad"))
    if labels is not None:
        known = labels.groupBy("page_id").agg(F.max("bad").cast("int").alias("told"))
        seen = seen.join(known, "page_id", "left").withColumn("bad", F.coalesce("bad", "told"))
    leaves = seen.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    verdicts = build_tree(leaves, min_children, max_share, z, smoothing, prior).select("host", "shape", "template", "purity")
    verdict = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(verdicts, ["host", "shape"], "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", verdict).alias("verdict"), "template", "purity")
