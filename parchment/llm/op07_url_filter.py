"""URL verdicts: the longest matching rule, else logistic regression on hashed character n-grams of host
and path. Training and scoring are SQL expressions: higher-order functions over arrays, no Python code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. rules: (rule, verdict), at most a few hundred."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngram_features(host: Column, path: Column, buckets: int, n: int = 3) -> Column:
    """Distinct buckets, 1 to `buckets`, of the character n-grams of host and path; each part has its own seed."""

    def grams(text: Column, seed: int) -> Column:
        chars = F.split(F.concat(F.lit("^" * (n - 1)), text, F.lit("$")), "")
        bucket = lambda c, i: (F.pmod(F.xxhash64(F.concat(*(F.get(c, i + k) for k in range(n))), F.lit(seed)), F.lit(buckets)) + 1).cast("int")
        # the inner lambda's array is a variable of the outer one: the text is split once, not for each n-gram
        return F.flatten(F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: bucket(c, i))))

    return F.array_distinct(F.concat(grams(host, 1), grams(path, 2)))


def score(features: Column, weights: Column) -> Column:
    """Log-odds: weight 0 is the bias; the others count by one over the root of the number of features."""
    total = F.aggregate(features, F.lit(0.0), lambda s, f: s + F.get(weights, f))
    return F.get(weights, F.lit(0)) + total / F.sqrt(F.greatest(F.size(features), F.lit(1)))


def fit(labelled: DataFrame, buckets: int = 512, epochs: int = 12, rate: float = 0.5, rows: int = 400) -> list[float]:
    """Weights from labelled(host, path, label 0/1). At most `rows` of each label are used, those with the smallest
    hash of host and path: the bound keeps the one array that training folds over small. The fold is stochastic
    gradient descent: an SQL aggregate whose state is the weight vector. Without rows all weights are 0."""
    key = F.xxhash64("host", "path")
    small = None
    for y in (0, 1):
        part = labelled.where(F.col("label") == y).select("host", "path", "label").distinct().orderBy(key, "host", "path").limit(rows)
        small = part if small is None else small.unionByName(part)
    few = small.select(key.alias("k"), F.col("label").cast("double").alias("y"), ngram_features(F.col("host"), F.col("path"), buckets).alias("f"))
    own = 1 / F.sqrt(F.greatest(F.size("f"), F.lit(1)))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets)), lambda i: F.when(i == 0, 1.0).when(F.array_contains("f", i), own).otherwise(0.0))
    few = few.select("k", "y", dense.alias("x"))
    packed = few.agg(F.sort_array(F.collect_list(F.struct("k", "y", "x"))).alias("rows"), F.avg("y").alias("share"))  # in hash order, which mixes the labels
    start = F.array_repeat(F.lit(0.0), buckets + 1)

    def step(w: Column, r: Column) -> Column:
        z = F.aggregate(F.zip_with(w, r.x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        weight = F.when(r.y == 1, 0.5 / F.greatest(F.col("share"), F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("share"), F.lit(1e-9)))
        move = F.lit(rate) * weight * (r.y - 1 / (1 + F.exp(-z)))
        return F.get(F.transform(F.array(move), lambda m: F.zip_with(w, r.x, lambda a, b: a * (1 - rate * 1e-4) + m * b)), F.lit(0))

    many = F.flatten(F.array_repeat(F.col("rows"), epochs))
    got = packed.select(F.aggregate(many, start, step).alias("w")).first()
    return list(got.w) if got and got.w else [0.0] * (buckets + 1)


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", labelled: DataFrame | None = None, block_at: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), p_block double.

    A rule `host/path` fits its host and all subdomains where the url's path starts with the rule's path; the
    longest wins. Urls without a rule get the classifier's verdict. labelled(host, path, label; 1: block) is
    the small table it is trained from; by default the urls which rules decide. Null url or one without "://":
    empty host and path, which the classifier judges from the bias and the boundary n-grams. Null ids stay
    null; repeated pages are judged each by itself, alike; extra columns are ignored; an empty table gives an
    empty table (and zero weights).
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where("hit is not null").select("host", "path", (F.col("hit.verdict") == "block").cast("int").alias("label"))
    weights = fit(labelled)
    z = score(ngram_features(F.col("host"), F.col("path"), len(weights) - 1), F.lit(weights))
    p = 1 / (1 + F.exp(-z))
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), p.alias("p_block"), F.col("hit.verdict").alias("by_rule")).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("p_block") >= block_at, "block").otherwise("allow")).alias("verdict"), "p_block")
