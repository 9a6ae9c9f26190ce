"""Operator 1: URL filters by a tree of path templates. DataFrame functions only.

Urls are first reduced to shapes (runs of digits become #, long runs of hexadecimal digits become @) and counted per
host and shape with their labels, so what follows handles shapes and not pages. Level by level, a segment that is a
whole number or hexadecimal run (an extension may follow), or the only one of a frequent node, stays as it is. Of the others, those that are not
frequent below their node (MIN_SUPPORT rows, MIN_SHARE of the node) or have no label are variable and share the branch `*`.
The branches of a node, MIN_SHARE of it each and so a bounded list, are then gone through by their share of bad pages: as long as the next
one does not differ significantly (|z| < Z) from the branches gathered so far it joins them; a `*` without a label stays by itself. Merged branches are `*` if they hold the variable
ones, else `{a|b}`. Levels go on, however deep, while some node has MIN_SUPPORT rows; below that no branch is frequent, so the rest of a path is known at once. A template is rejected if its bad share, smoothed
towards its host's and the host's towards the overall share, reaches MAX_BAD on at least MIN_LABELS labels.
Rules for a host (with its subdomains) and a path prefix come before templates; the longest rule wins.

Counts are partial aggregations and all joins are equi-joins on (host, path so far, segment), which Spark may split for
a hot host. The state is written once per level, so no level is computed twice, and only what goes on below frequent nodes is in the next.

Cases: a null url or one without :// has empty host and path and the template "" (allowed unless its labels
say otherwise); labels repeated for one page count once, as bad if any says so; repeated pages count each; null ids are
kept; a segment that is literally `*` is one of the variable ones; branches of equal share are taken by name; a number too long for an id names no document; without any label every page is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize

#: Segments that stay as they are: a number or hexadecimal run, perhaps with an extension.
LITERAL = "^[#@]([.][a-z]+)?$"
MIN_SUPPORT = 20
MIN_SHARE = 0.01
Z = 2.58
SMOOTHING = 10.0
MAX_BAD = 0.5
MIN_LABELS = 5
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null and what has no :// give empty strings."""
    part = r"^(?s).*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, part, k), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(of(1), upper, upper.lower()), of(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{12,}", "@"), "[0-9]+", "#")


def merged(branches: DataFrame) -> DataFrame:
    """(host, template, branch, part) of rows (host, template, branch, cl, cb): neighbours in bad share that don't differ become one part."""
    group = "array<struct<cl:bigint,cb:bigint,names:array<string>>>"
    # those without labels come last and join nothing
    each = F.struct((F.col("cl") == 0).alias("unknown"), (F.col("cb") / F.greatest(F.col("cl"), F.lit(1))).alias("share"), "branch", "cl", "cb")
    lists = branches.groupBy("host", "template").agg(F.array_sort(F.collect_list(each)).alias("branches"))

    def similar(a: Column, b: Column) -> Column:
        share = (a["cb"] + b["cb"]) / (a["cl"] + b["cl"])
        spread = F.sqrt(share * (1 - share) * (1 / a["cl"] + 1 / b["cl"]))
        return (a["cl"] > 0) & (b["cl"] > 0) & ((spread == 0) | (F.abs(a["cb"] / a["cl"] - b["cb"] / b["cl"]) < Z * spread))

    def step(groups: Column, x: Column) -> Column:
        last, fresh = F.get(groups, F.size(groups) - 1), F.array(x["branch"])
        joined = F.struct((last["cl"] + x["cl"]).alias("cl"), (last["cb"] + x["cb"]).alias("cb"), F.concat(last["names"], fresh).alias("names"))
        alone = F.concat(groups, F.array(F.struct(x["cl"].alias("cl"), x["cb"].alias("cb"), fresh.alias("names"))))
        return F.when(F.coalesce(similar(last, x), F.lit(False)), F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(joined)).cast(group)).otherwise(alone.cast(group))

    found = lists.select("host", "template", F.explode(F.aggregate("branches", F.array().cast(group), step)).alias("g"))
    names = F.col("g.names")
    part = F.when(F.array_contains(names, "*"), F.lit("*")).when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort(names), "|"), F.lit("}")))
    return found.select("host", "template", part.alias("part"), F.explode(names).alias("branch"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, labelled, bad) of rows (host, shape, n, labelled, bad)."""
    rows = shapes.withColumn("segments", F.filter(F.split("shape", "/"), lambda s: s != ""))
    rows = rows.withColumns({"template": F.lit(""), "rest": F.col("segments")})
    out, done, states = ["host", "shape", "template", "labelled", "bad"], None, []
    while True:
        node = rows.filter(F.size("rest") > 0).groupBy("host", "template").agg(F.sum("n").alias("t")).filter(F.col("t") >= MIN_SUPPORT)
        state = materialize(rows.join(node, ["host", "template"], "left"), "level")
        states.append(state)
        # below a node of few rows no branch is frequent
        ends = F.transform("rest", lambda s: F.concat(F.lit("/"), F.when(s.rlike(LITERAL), s).otherwise("*")))
        small = state.filter((F.size("rest") == 0) | F.col("t").isNull()).withColumn("template", F.concat("template", F.array_join(ends, ""))).select(*out)
        done = small if done is None else done.unionByName(small)
        rows = state.filter((F.size("rest") > 0) & F.col("t").isNotNull())
        if rows.isEmpty():
            break
        rows = rows.withColumn("segment", F.get("rest", F.lit(0)))
        child = rows.groupBy("host", "template", "segment", "t").agg(F.sum("n").alias("c"), F.sum("labelled").alias("cl"), F.sum("bad").alias("cb"))
        fixed = F.col("segment").rlike(LITERAL) | ((F.col("c") == F.col("t")) & (F.col("c") >= MIN_SUPPORT))
        frequent = (F.col("c") >= MIN_SUPPORT) & (F.col("c") >= MIN_SHARE * F.col("t")) & (F.col("cl") > 0)
        child = child.withColumn("fixed", fixed).withColumn("branch", F.when(fixed | frequent, F.col("segment")).otherwise(F.lit("*")))
        branches = child.filter("NOT fixed").groupBy("host", "template", "branch").agg(F.sum("cl").alias("cl"), F.sum("cb").alias("cb"))
        parts = merged(branches).withColumn("fixed", F.lit(False))
        kept = child.join(parts, ["host", "template", "branch", "fixed"], "left").select("host", "template", "segment", F.coalesce("part", "segment").alias("part"))
        rows = rows.join(kept, ["host", "template", "segment"]).withColumns({"template": F.concat("template", F.lit("/"), "part"), "rest": F.slice("rest", 2, F.size("rest"))})
        rows = rows.drop("segment", "part", "t")
    done = materialize(done, "templates")
    discard(*states)
    return done


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) and labels (page_id, bad boolean): per page its host, path, rule, verdict, template and bad_share."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("is_bad"))
    shapes = rows.join(known, "page_id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    made = templates(shapes)
    by_template = made.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    overall = by_host.agg(F.coalesce(F.sum("host_bad") / F.sum("host_labelled"), F.lit(0.0)).alias("prior"))
    prior = (F.col("host_bad") + SMOOTHING * F.col("prior")) / (F.col("host_labelled") + SMOOTHING)
    share = (F.col("bad") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)
    judged = by_template.join(by_host, "host").crossJoin(F.broadcast(overall)).select("host", "template", "labelled", share.alias("bad_share"))
    by_shape = made.select("host", "shape", "template").join(judged, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("labelled") >= MIN_LABELS) & (F.col("bad_share") >= MAX_BAD), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(by_shape, ["host", "shape"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "bad_share")


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages by the document that the first number in the path names: bad if toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(orrery_path, '/([0-9]+)', 1) AS BIGINT)")
    named = pages.select("page_id", host_and_path(F.col("url"))[1].alias("orrery_path")).select("page_id", number.alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad")).filter("bad IS NOT NULL")
    return named.join(bad, "doc_id").select("page_id", (F.col("bad") == 1).alias("bad"))
