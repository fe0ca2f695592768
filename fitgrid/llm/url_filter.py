"""URL filter: rules by host and path, then gradient-boosted trees on lexical features.

DataFrame functions only. A tree is grown level by level: one aggregation gives the
gradient and hessian sums of every (node, feature, bin), a number of rows that is
fixed by depth, features and bins; the driver picks the splits and the tree becomes a
CASE expression. At most ``TRAIN_ROWS`` labelled URLs, of least hash, are fitted on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

TRAIN_ROWS, TREES, DEPTH, BINS = 20_000, 8, 3, 16
RATE, PENALTY, LEAST = 0.3, 1.0, 20.0
#: (host and path, block?) in the contract's order.
RULES = (("com/en/", True), ("example.com/en/7", False), ("net/de/", False), ("example.net/de/8", True), ("org/es/", True))

Tree = tuple  # (feature, bound, left, right), or (value,)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty where url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and whether it blocks."""
    rule, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for text, blocks in sorted(rules, key=lambda r: len(r[0])):
        name, _, below = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + below))
        rule, block = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(blocks)).otherwise(block)
    return rule, block


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` (with host and path) and columns f0, f1, …: counts, ratios and entropy of the URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")

    def count(text: Column, char: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, char, ""))).cast("double")

    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda acc, c: acc - F.when(F.length(c) == 0, 0.0).otherwise((n - F.length(F.replace(u, c, F.lit("")))) / n * F.log2(F.greatest((n - F.length(F.replace(u, c, F.lit("")))) / n, F.lit(1e-12)))))
    features = [n, F.length("host").cast("double"), F.length("path").cast("double"), count(F.col("host"), "."), count(F.col("path"), "/"), digits / n, entropy, count(query, "="), count(F.col("host"), "-"), count(u, "%"), F.startswith(u, F.lit("https")).cast("double")]
    return df.withColumns({f"f{i}": f for i, f in enumerate(features)}).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))


def _tree(node: Tree) -> Column:
    if len(node) == 1:
        return F.lit(node[0])
    name, bound, left, right = node
    return F.when(F.col(name) <= bound, _tree(left)).otherwise(_tree(right))


def _leaf(node: Tree, at: int = 1) -> Column:
    """Number of the node that a row is in: 1 the root, children 2n and 2n+1."""
    if len(node) < 4:
        return F.lit(at)
    name, bound, left, right = node
    return F.when(F.col(name) <= bound, _leaf(left, 2 * at)).otherwise(_leaf(right, 2 * at + 1))


def _grow(node: Tree, sums: dict[int, dict[str, list[tuple[float, float, float]]]], at: int, last: bool) -> Tree:
    """Splits the leaves of ``node`` by the histograms of their rows: (bound, gradient, hessian) by feature."""
    if len(node) == 4:
        return (*node[:2], _grow(node[2], sums, 2 * at, last), _grow(node[3], sums, 2 * at + 1, last))
    if at not in sums:
        return node
    best, gain = None, 1e-6
    for name, bins in sorted(sums[at].items()):
        g, h = sum(b[1] for b in bins), sum(b[2] for b in bins)
        x = y = 0.0
        for bound, bg, bh in sorted(bins)[:-1]:
            x, y = x + bg, y + bh
            if y < LEAST / 4 or h - y < LEAST / 4:
                continue
            won = x * x / (y + PENALTY) + (g - x) ** 2 / (h - y + PENALTY) - g * g / (h + PENALTY)
            if won > gain:
                best, gain = (name, bound, (-RATE * x / (y + PENALTY),), (-RATE * (g - x) / (h - y + PENALTY),)), won
    return best or node


def train_url_trees(labelled: DataFrame, most: int = TRAIN_ROWS) -> dict:
    """Fit on ``labelled`` (url, label: 1 to block). Gives the model for ``url_probability``."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = saved(lexical_features(rows.withColumns({"host": host, "path": path})), "urls")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).collect()[0]
    prior = (positive + 0.5) / (n + 1)
    model = {"bias": math.log(prior / (1 - prior)), "trees": [], "suffixes": [], "prior": prior}
    if not 0 < positive < n:
        model["bias"] = model["bias"] if n else -4.0
        return model
    # statistics of the most frequent suffixes only, so that the model stays bounded; others take the prior
    top = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("s")).orderBy(F.desc("n"), "suffix").limit(200).collect()
    model["suffixes"] = [(r[0], (r[2] + 10 * prior) / (r[1] + 10), math.log1p(r[1] / n)) for r in top]
    rows = _with_suffixes(rows, model)
    names = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    cuts = rows.agg(*(F.array_distinct(F.percentile_approx(c, F.array(*(F.lit(i / BINS) for i in range(1, BINS + 1))), 1000)).alias(c) for c in names)).collect()[0]
    bounds = {c: sorted(cuts[c]) for c in names}
    binned = rows.withColumns({f"b_{c}": F.coalesce(*(F.when(F.col(c) <= b, F.lit(float(b))) for b in bounds[c]), F.lit(float(bounds[c][-1]))) for c in names})
    binned = saved(binned, "bins")
    score = F.lit(model["bias"])
    for _ in range(TREES):
        tree: Tree = (0.0,)
        p = 1 / (1 + F.exp(-score))
        for level in range(DEPTH):
            marked = binned.select(_leaf(tree).alias("node"), (p - F.col("label")).alias("g"), (p * (1 - p)).alias("h"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"b_{c}").alias("bound")) for c in names))).alias("b"))
            sums: dict = {}
            for node, name, bound, g, h in marked.groupBy("node", "b.name", "b.bound").agg(F.sum("g"), F.sum("h")).collect():
                sums.setdefault(node, {}).setdefault(name, []).append((bound, round(g, 9), round(h, 9)))
            new = _grow(tree, sums, 1, level == DEPTH - 1)
            if new == tree:
                break
            tree = new
        if len(tree) == 1:
            break
        model["trees"].append(tree)
        score = score + _tree(tree)
    return model


def _with_suffixes(df: DataFrame, model: dict) -> DataFrame:
    share, often = F.lit(model["prior"]), F.lit(0.0)
    if model["suffixes"]:
        found = F.create_map(*(x for s, a, b in model["suffixes"] for x in (F.lit(s), F.array(F.lit(a), F.lit(b)))))
        both = F.try_element_at(found, F.col("suffix"))
        share, often = F.coalesce(both[0], share), F.coalesce(both[1], often)
    return df.withColumns({"f90": share, "f91": often})


def url_probability(model: dict) -> Column:
    """Probability of block, on rows that have the features."""
    score = F.lit(model["bias"])
    for tree in model["trees"]:
        score = score + _tree(tree)
    return 1 / (1 + F.exp(-score))


def filter_urls(pages: DataFrame, model: dict, rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, probability.

    The longest rule that fits decides, else the model. Null urls and those without
    ``://`` have an empty host and path, fit no rule and are left to the model. Urls of any length are read whole; rules of
    one length cannot both fit, as a rule stands once; repeated rows get equal verdicts, null ids too; other columns, whatever their
    names, are not read; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    df = _with_suffixes(lexical_features(df), model).withColumn("probability", url_probability(model))
    rule, block = rule_verdict(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.coalesce(block, F.col("probability") >= 0.5), "block").otherwise("allow")
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "probability")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs whose document, the number in their path, is labelled: label 1 where its quality is 0."""
    doc = F.regexp_extract("url", r"://[^/]*/[^/]*/(\d{1,18})", 1)
    known = labels.select("doc_id", (1 - F.col("quality")).alias("label")).filter("label IN (0, 1)").dropDuplicates(["doc_id"])
    return pages.select("url", doc.alias("doc")).withColumn("doc_id", F.expr("try_cast(doc AS BIGINT)")).join(known, "doc_id").select("url", "label")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return filter_urls(pages, train_url_trees(labelled_urls(pages, labels)))
