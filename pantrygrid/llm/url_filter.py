"""URL filter: stated rules, and beyond them a tree of path templates for each host that learns from labelled urls.

Paths are cut into segments, with runs of digits as one sign. Level by level, a segment that fewer than one in
1 / LITERAL of its node's urls have is a wildcard. Then sibling branches are merged where neither their labelled shares
nor what follows below them differ by more than Hoeffding's bound, in order of their share. A template whose smoothed
share of blocked labels reaches PURE is rejected, with all urls it covers. All of it is DataFrame operations: the
tree is tables of nodes with counts, a node has at most 1 / LITERAL + 1 children, and urls meet only the rejected paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Segments that a template tells apart; what is deeper is one more sign. Least share of its node's urls for a literal segment.
DEPTH, LITERAL = 4, 1 / 16
#: Hoeffding's factor sqrt(ln(2 / 0.05) / 2); labels that the common share counts as in smoothing; share from which a template is rejected.
BOUND, WEIGHT, PURE = 1.3581015157406195, 4.0, 0.9
LEVELS = [f"t{k}" for k in range(1, DEPTH + 1)]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return shared.lower_ascii_column(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host/path) that fits, and its verdict; null where none fits. Of equal rules block counts.

    A rule fits its host and all subdomains, where the path starts with the rule's. Rules are a stated list that stands in the plan.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own.lower()) | host.endswith(f".{own.lower()}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> list[Column]:
    """The first DEPTH segments with runs of digits as #, and ** after the last if there are more; empty where there is none."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    out = [F.regexp_replace(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), "[0-9]+", "#") for k in range(DEPTH)]
    out[-1] = F.concat(out[-1], F.when(F.size(parts) > DEPTH, "/**").otherwise(""))
    return out


def _differs(a: str, of_a: str, b: str, of_b: str) -> Column:
    """Whether the shares a of of_a and b of of_b differ by more than Hoeffding's bound; where either has nothing, they do not."""
    a, of_a, b, of_b = (F.col(x).cast("double") for x in (a, of_a, b, of_b))
    return (of_a > 0) & (of_b > 0) & (F.abs(a / of_a - b / of_b) > F.lit(BOUND) * (F.lit(1.0) / F.sqrt(of_a) + F.lit(1.0) / F.sqrt(of_b)))


def _level(state: DataFrame, k: int, common: float) -> DataFrame:
    """The state with the node of level k added to each path's template."""
    at, below = LEVELS[k], LEVELS[k + 1] if k + 1 < DEPTH else None
    node = ["host", "template"]
    each = state.where(F.col(at) != "").groupBy(*node, at).agg(F.sum("urls").alias("own"))
    whole = state.groupBy(*node).agg(F.sum("urls").alias("all"))
    literals = each.join(whole, node).where(F.col("own") >= LITERAL * F.col("all")).select(*node, at, F.lit(True).alias("literal"))
    token = F.when(F.col(at) == "", "").when(F.col("literal"), F.col(at)).otherwise("*")
    named = state.join(literals, [*node, at], "left").withColumn("token", token).drop("literal")
    ends, digits = (F.sum(F.when(F.col(below) == "", F.col("urls")).otherwise(0)), F.sum(F.when(F.col(below).contains("#"), F.col("urls")).otherwise(0))) if below else (F.sum(F.lit(0)), F.sum(F.lit(0)))
    branches = named.where(F.col("token") != "").groupBy(*node, "token").agg(F.sum("urls").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), ends.alias("ends"), digits.alias("digits"))
    branches = branches.withColumn("share", (F.col("blocked") + F.lit(WEIGHT * common)) / (F.col("labelled") + F.lit(WEIGHT)))
    row = Window.partitionBy(*node).orderBy("share", "token")  # at most 1 / LITERAL + 1 branches
    figures = ["urls", "labelled", "blocked", "ends", "digits"]
    branches = branches.select("*", *[F.lag(c).over(row).alias(f"last_{c}") for c in figures])
    apart = F.col("last_urls").isNotNull() & (_differs("blocked", "labelled", "last_blocked", "last_labelled") | _differs("ends", "urls", "last_ends", "last_urls") | _differs("digits", "urls", "last_digits", "last_urls"))
    branches = branches.withColumn("merged", F.sum(apart.cast("int")).over(row))
    name = F.array_join(F.array_sort(F.collect_list("token").over(Window.partitionBy(*node, "merged"))), "|")
    merged = branches.select(*node, "token", name.alias("name"))
    grown = F.concat("template", F.when(F.col("token") == "", "").otherwise(F.concat(F.lit("/"), F.col("name"))))
    return named.join(merged, [*node, "token"], "left").select("host", grown.alias("template"), *LEVELS, "urls", "labelled", "blocked")


def path_templates(urls: DataFrame) -> tuple[DataFrame, float]:
    """(host, t1 ..., template, urls, labelled, blocked) for each different path, and the common share of blocked labels.

    urls: host, path, label (1 to block, 0 to allow, null for none).
    """
    cut = urls.select("host", *[c.alias(t) for c, t in zip(_segments(F.col("path")), LEVELS)], "label")
    counts = cut.groupBy("host", *LEVELS).agg(F.count("*").alias("urls"), F.count("label").alias("labelled"), F.sum(F.coalesce("label", F.lit(0))).cast("long").alias("blocked"))
    state = shared.written(counts.withColumn("template", F.lit("")))
    total = state.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    common = total["blocked"] / total["labelled"] if total["labelled"] else 0.5
    for k in range(DEPTH):
        state = shared.written(_level(state, k, common))
    return state, common


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row its id, host, path, rule and verdict (allow or block: the rule's, else that of the path template).

    Labels that the templates learn from are the rules' own verdicts on pages, and those of labelled (url, label with 1
    to block, 0 to allow; a null label is none) where it is given. A template without labels has the common share, which
    rejects it only if that reaches PURE. Null urls and those without :// have an empty host and path, no rule, and the
    verdict of their template (the host's own path of no segments). Null or repeated ids and repeated urls are kept row
    by row; an empty table gives an empty result; other columns are not read.
    """
    own = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = own.withColumn("rule", rule).withColumn("said", verdict)
    seen = judged.select("host", "path", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int")).alias("label"))
    if labelled is not None:
        seen = seen.unionByName(labelled.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("label").cast("int").alias("label")))
    state, common = path_templates(seen)
    share = (F.sum("blocked") + F.lit(WEIGHT * common)) / (F.sum("labelled") + F.lit(WEIGHT))
    rejected = state.groupBy("host", "template").agg(share.alias("share")).where(F.col("share") >= PURE)
    paths = shared.written(state.join(rejected, ["host", "template"], "left_semi").select("host", *LEVELS, F.lit(True).alias("rejected")))
    cut = judged.select("*", *[c.alias(t) for c, t in zip(_segments(F.col("path")), LEVELS)])
    out = cut.join(paths, ["host", *LEVELS], "left")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("said", method).alias("verdict"))
