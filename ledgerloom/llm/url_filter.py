"""URL filter: a path-template tree per host, judged by smoothed labelled purity (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import attach, stored

#: (host, path, verdict): the rule fits the host and its subdomains when the path starts with the rule's path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Segments that vary by nature: numbers, hex strings, dates and the like, with any file suffix.
VARIABLE = r"^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f-]{32,}|[^.]*[0-9]{3,}[^.]*)(?:\.[a-z0-9]{1,5})?$"


@dataclass(frozen=True)
class TreeParams:
    """children: distinct siblings that make a position variable; rows_per_child: only if each has few rows.
    z: branches within so many standard errors of their siblings are merged; base: bad share of a host without labels;
    prior: rows' worth of the parent's share; reject: purity from which a template is blocked."""

    children: int = 24
    rows_per_child: float = 8.0
    z: float = 2.0
    base: float = 0.1
    prior: float = 4.0
    reject: float = 0.8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _prefix(at) -> Column:
    """What stands before segment `at` of ``_seg``, generalised as far as it is yet, as a hash."""
    return F.xxhash64(F.slice("_seg", F.lit(1), at))


def path_templates(urls: DataFrame, params: TreeParams) -> DataFrame:
    """Adds ``_template`` to rows with ``_host, _path``: segments that vary become ``*``.

    A segment varies by its form, or because its position (host, generalised prefix) has many rare children. The tree is walked
    from the root: where positions of a host's level vary, their children become one branch, and the levels below are
    counted anew under it, so that what varies below a varying segment is found, too. There are as many rounds as levels that
    vary one below another. Distinct paths are counted, after a map-side combine, and only varying positions come back to the rows.
    """
    segment = lambda x: F.when(x.rlike(VARIABLE), F.lit("*")).otherwise(x)
    rows = urls.withColumn("_seg", F.transform(F.split(F.regexp_replace("_path", r"^/|/$", ""), "/"), segment))
    paths = stored(rows.groupBy("_host", "_seg").agg(F.count("*").alias("_n")))
    while True:
        nodes = paths.select("_host", "_n", "_seg", F.posexplode("_seg").alias("_at", "_child")).where(F.col("_child") != "*")
        nodes = nodes.groupBy("_host", "_at", _prefix(F.col("_at")).alias("_prefix"), "_child").agg(F.sum("_n").alias("_n"))
        variable = nodes.groupBy("_host", "_at", "_prefix").agg(F.count("*").alias("_children"), F.sum("_n").alias("_rows"))
        variable = stored(variable.where((F.col("_children") >= params.children) & (F.col("_rows") < params.rows_per_child * F.col("_children"))).select("_host", "_at", "_prefix"))
        if variable.isEmpty():
            break
        level = stored(variable.groupBy("_host").agg(F.min("_at").alias("_at")))
        first = stored(variable.join(level, ["_host", "_at"], "left_semi").select("_host", "_prefix", F.lit(True).alias("_varies")))
        rows = _starred(rows, level, first)
        paths = stored(_starred(attach(paths, level.drop("_at"), ["_host"], "left_semi"), level, first).groupBy("_host", "_seg").agg(F.sum("_n").alias("_n")))
    return rows.withColumn("_template", F.concat(F.lit("/"), F.array_join("_seg", "/"))).drop("_seg")


def _starred(rows: DataFrame, level: DataFrame, first: DataFrame) -> DataFrame:
    """Rows with ``*`` for their segment at their host's level (_host, _at), where its position (_host, _prefix) varies."""
    at = attach(rows, level, ["_host"]).withColumn("_prefix", F.when(F.col("_at") < F.size("_seg"), _prefix(F.col("_at"))))
    star = F.transform("_seg", lambda x, i: F.when(i == F.col("_at"), F.lit("*")).otherwise(x))
    return attach(at, first, ["_host", "_prefix"]).withColumn("_seg", F.when(F.col("_varies"), star).otherwise(F.col("_seg"))).drop("_at", "_prefix", "_varies")


def template_verdicts(rows: DataFrame, params: TreeParams) -> DataFrame:
    """(_host, _template, _verdict) from rows ``_host, _template, _label`` (1 bad, 0 good, null unknown).

    Sibling templates (same host, all but the last literal segment equal) whose bad share lies within z standard
    errors of the siblings' pooled share are merged and judged by the pooled counts; the others keep their own.
    Templates without labelled rows, merged ones included, are allowed. Purity is smoothed towards the host's, which is smoothed towards a base share.
    """
    counts = rows.groupBy("_host", "_template").agg(F.count("_label").alias("_k"), F.coalesce(F.sum("_label"), F.lit(0)).alias("_bad"))
    parent = F.regexp_replace("_template", r"[^/*]+(/\**)*$", "?$1")
    counts = stored(counts.withColumn("_parent", parent))
    family = counts.groupBy("_host", "_parent").agg(F.sum("_k").alias("_fk"), F.sum("_bad").alias("_fb"))
    host = counts.groupBy("_host").agg(F.sum("_k").alias("_hk"), F.sum("_bad").alias("_hb"))
    joined = attach(attach(counts, family, ["_host", "_parent"], "inner"), host, ["_host"], "inner")
    pooled = F.when(F.col("_fk") > 0, F.col("_fb") / F.col("_fk")).otherwise(F.lit(0.0))
    error = F.sqrt(pooled * (1 - pooled) / F.greatest(F.col("_k"), F.lit(1)))
    alike = (F.col("_k") > 0) & (F.abs(F.col("_bad") / F.greatest(F.col("_k"), F.lit(1)) - pooled) <= params.z * error)
    bad, known = F.when(alike, F.col("_fb")).otherwise(F.col("_bad")), F.when(alike, F.col("_fk")).otherwise(F.col("_k"))
    of_host = (F.col("_hb") + params.prior * params.base) / (F.col("_hk") + params.prior)
    purity = (bad + params.prior * of_host) / (known + params.prior)
    return joined.select("_host", "_template", F.when((known > 0) & (purity >= params.reject), "block").otherwise("allow").alias("_verdict"), purity.alias("_purity"))


def filter_urls(pages: DataFrame, url: str = "url", keep: list[str] | None = None, rules: list[tuple[str, str, str]] | None = None, params: TreeParams | None = None) -> DataFrame:
    """Judge every url: kept columns, host, path, template, purity, rule, verdict.

    Rules decide where they fit and are the labels of the tree; templates decide the rest. Null urls and urls without
    ``://`` have empty host and path and are judged like any host. Repeated rows stay; other columns are not read.
    """
    params = params or TreeParams()
    keep = ["page_id"] if keep is None else keep
    named = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = pages.select(*named, host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), RULES if rules is None else rules)
    rows = rows.withColumns({"_rule": rule, "_ruled": verdict})
    rows = path_templates(rows, params)
    judged = template_verdicts(rows.withColumn("_label", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0)), params)
    out = attach(rows, judged, ["_host", "_template"])
    return out.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_template").alias("template"), F.col("_purity").alias("purity"), F.col("_rule").alias("rule"),
        F.coalesce("_ruled", "_verdict", F.lit("allow")).alias("verdict"),
    )
