"""URL filters in Spark SQL functions only: rules, and a tree of path templates for each host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import sealed, unsealed
from attesta.plans.lineage import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: So many rules are tried one by one on every row; more are joined by host and beginning of the path. The verdicts are the same.
IN_PLAN = 200
_ANY = "*"
_FOUND = "struct<size:int,rule:string,verdict:string>"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parts(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.lower(), "/" + path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (``host/path``, verdict) that fits: its host or a subdomain, and a path that begins with its path.

    Of several of one length the last in order of text.
    """
    if not rules:
        return F.lit(None).cast(_FOUND)
    kind = "array<struct<size:int,rule:string,verdict:string,host:string,path:string>>"
    known = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((len(r), r, v, *_parts(r)), ("size", "rule", "verdict", "host", "path"), strict=True)]) for r, v in rules]).cast(kind)
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``_rule``: what :func:`rule_of` finds for ``_host`` and ``_path``, for any number of rules.

    Many rules are a table: each distinct host and path looks up its host and every domain above it, there the lengths that
    rules' paths have, and at last the rules of that host with that beginning of the path.
    """
    if len(rules) <= IN_PLAN:
        return rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    spark = rows.sparkSession
    table = spark.createDataFrame([(len(r), r, v, *_parts(r)) for r, v in rules], "size int, rule string, verdict string, domain string, start string")
    lengths = table.groupBy("domain").agg(F.collect_set(F.length("start")).alias("lengths"))
    urls = rows.select("_host", "_path").distinct()
    labels = F.split("_host", "\\.")
    above = urls.withColumn("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    starts = above.join(lengths, "domain").select("_host", "_path", "domain", F.explode("lengths").alias("n")).where(F.length("_path") >= F.col("n"))
    fits = starts.withColumn("start", F.substring(F.col("_path"), F.lit(1), F.col("n"))).join(table, ["domain", "start"])
    found = fits.groupBy("_host", "_path").agg(F.max(F.struct("size", "rule", "verdict")).alias("_rule"))
    return rows.join(found.withColumnsRenamed({"_host": "_fh", "_path": "_fp"}), (F.col("_host") == F.col("_fh")) & (F.col("_path") == F.col("_fp")), "left").drop("_fh", "_fp")


def shape_of(path: Column) -> Column:
    """The path's segments with variable ones as wildcards: numbers, hex strings and long segments."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = lambda s: F.when(s.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$") & ~s.rlike("^[0-9]+$"), F.lit("<hex>")).when(F.length(s) > 64, F.lit("<long>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))
    return F.transform(segments, plain)


def _level(tree: DataFrame, d: int, max_children: int, min_labels: int, z: float) -> DataFrame:
    """Generalises the segments at depth ``d``: rare children of wide nodes become ``*``; of the others, at most ``max_children``
    a node, labelled branches next to each other in purity merge into one ``~`` branch unless their purities differ by more
    than chance (two proportions at ``z`` deviations)."""
    at = tree.withColumns({"up": F.slice("template", 1, d), "child": F.get("template", F.lit(d))})
    child = at.where("child is not null").groupBy("host", "up", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    node = child.groupBy("host", "up").agg(F.count("*").alias("width"), F.sum("n").alias("all_n"))
    rare = (F.col("width") > max_children) & (F.col("n") * max_children < F.col("all_n"))
    both = child.join(node, ["host", "up"]).withColumn("rare", rare)
    order = Window.partitionBy("host", "up").orderBy("rate", "child")
    ranked = both.where(~F.col("rare") & (F.col("l") >= min_labels)).withColumn("rate", F.col("b") / F.col("l"))
    ranked = ranked.withColumns({"l0": F.lag("l").over(order), "b0": F.lag("b").over(order)})
    rate = (F.col("b") + F.col("b0")) / (F.col("l") + F.col("l0"))
    apart = F.col("l0").isNull() | (F.col("b") / F.col("l") - F.col("b0") / F.col("l0") > z * F.sqrt(rate * (1 - rate) * (1 / F.col("l") + 1 / F.col("l0"))))
    ranked = ranked.withColumn("branch", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    company = Window.partitionBy("host", "up", "branch")
    merged = ranked.withColumn("many", F.count("*").over(company)).where("many > 1").select("host", "up", "child", F.concat(F.lit("~"), "branch").alias("new"))
    changed = merged.union(both.where("rare").select("host", "up", "child", F.lit(_ANY)))
    out = at.join(changed, ["host", "up", "child"], "left")
    return out.withColumn("template", F.when(F.col("new").isNotNull(), F.concat("up", F.array("new"), F.slice("template", d + 2, F.size("template")))).otherwise(F.col("template"))).select(tree.columns)


def template_tree(urls: DataFrame, *, depth: int = 4, max_children: int = 50, min_labels: int = 20, z: float = 1.96) -> DataFrame:
    """Templates of all shapes of ``urls`` (host, shape, bad: 1, 0 or null): host, shape, template, n, labelled, bad.

    Branches are generalised on the first ``depth`` levels; deeper segments stay apart as they are. Counts are aggregated by
    host and shape before anything else, so a host's rows never meet in one task; each level is written once.
    """
    tree = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = cut(tree.withColumn("template", F.col("shape")))
    for d in range(depth):
        tree = cut(_level(tree, d, max_children, min_labels, z))
    return tree


def purities(tree: DataFrame, *, depth: int = 4, weight: float = 10.0) -> DataFrame:
    """host, template, purity: the share of bad ones among a template's labelled urls, with ``weight`` labels of its parent's
    purity added, that again smoothed by its parent's and so on up to the host and to the share of all labels.

    Parents are the beginnings of a template on the first ``depth`` levels; without any label at all shares are one half.
    """
    counted = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    size = F.size("template")
    ups = F.concat(F.transform(F.sequence(F.lit(0), F.least(size, F.lit(depth))), lambda k: F.slice("template", 1, k)), F.when(size > depth, F.array("template")).otherwise(F.array().cast("array<array<string>>")))
    steps = counted.select("host", "template", "l", "b", F.posexplode(ups).alias("at", "node"))
    nodes = steps.groupBy("host", "node").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    way = steps.select("host", "template", "at", "node").join(nodes, ["host", "node"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("at", "l", "b"))).alias("way"))
    overall = tree.agg(F.coalesce(F.sum("bad") / F.sum("labelled"), F.lit(0.5)).alias("share"))
    purity = F.aggregate("way", F.col("share"), lambda p, x: (x["b"] + weight * p) / (x["l"] + weight))
    return way.join(F.broadcast(overall)).select("host", "template", purity.alias("purity"))


def judge(
    urls: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int = 4,
    max_children: int = 50,
    min_labels: int = 20,
    weight: float = 10.0,
    max_purity: float = 0.8,
) -> DataFrame:
    """``urls`` with host, path, rule, verdict (``allow`` or ``block``), template and purity.

    The verdict is that of the longest rule that fits (see :func:`rule_of`), else that of the url's template, which is rejected
    if its purity is ``max_purity`` or more (see :func:`purities`). Labels are the rules' verdicts, and those of ``labels`` (id,
    bad) where there are any. Null urls and urls without ``://`` have an empty host and path. Every row gives one row, repeated
    ones alike; very long urls are read whole; an empty table gives an empty one.
    """
    urls, named = sealed(urls)
    url = F.col(named[url_col])
    rows = with_rules(urls.withColumns({"_host": host_of(url), "_path": path_of(url)}), rules)
    rows = rows.withColumn("_shape", shape_of(F.col("_path")))
    bad = F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int"))
    seen = rows
    if labels is not None:
        own = labels.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(F.col("bad").cast("int")).alias("_bad"))
        seen = rows.join(own, F.col(named[id_col]) == F.col("_label_id"), "left")
        bad = F.coalesce(bad, F.col("_bad"))
    tree = template_tree(seen.select(F.col("_host").alias("host"), F.col("_shape").alias("shape"), bad.alias("bad")), depth=depth, max_children=max_children, min_labels=min_labels)
    of_shape = tree.select("host", "shape", "template").join(purities(tree, depth=depth, weight=weight), ["host", "template"])
    of_shape = of_shape.select(F.col("host").alias("_h"), F.col("shape").alias("_s"), F.array_join("template", "/").alias("_template"), F.col("purity").alias("_purity"), (F.col("purity") >= max_purity).alias("_reject"))
    out = rows.join(of_shape, (F.col("_host") == F.col("_h")) & (F.col("_shape") == F.col("_s")), "left")
    out = out.withColumn("_verdict", F.coalesce("_rule.verdict", F.when(F.col("_reject"), "block").otherwise("allow"))).withColumn("_rule_name", F.col("_rule.rule"))
    return unsealed(out, named, {"host": "_host", "path": "_path", "rule": "_rule_name", "verdict": "_verdict", "template": "_template", "purity": "_purity"})
