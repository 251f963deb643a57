"""Operator 3: URL filter. Host and path rules first, then a logistic
regression on hashed character n-grams of host and path.

The model is trained on a small labelled URL table: URLs that a rule decides,
labelled by that rule. The sample is bounded by ``TRAIN_ROWS`` per class (the
documented fit bound), drawn by hash order over all distinct (host, path).

Defined results: a null URL or one without ``://`` has empty host and path, no
rule fits it and the model judges the empty strings. With no rows of one class
to learn from, everything undecided gets the verdict of the only class, or
``allow`` if there is none. Repeated URLs get equal verdicts. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import ascii_lower, land, table
from gravis.llm.registry import register

# Fixed values: (verdict, host, path prefix) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRAIN_ROWS = 2000  # labelled URLs per class the model is fitted on, at most
NGRAM_SIZES = (2, 3, 4)
HASH_SLOTS = 1 << 14


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/ ? #`` after the first ``://``, A-Z lowered;
    path up to ``? #``. Both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for action, rhost, rpath in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        rule = F.when(fits, F.lit(rhost + rpath)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _grams(c: Column, tag: str) -> Column:
    """Tagged character n-grams of ``^text$``; short texts give fewer."""
    s = F.concat(F.lit("^"), c, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.concat(F.lit(tag), F.substr(s, i, F.lit(n))))
        return F.when(F.length(s) >= n, grams).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of_size(n) for n in NGRAM_SIZES])


def with_ngrams(df: DataFrame) -> DataFrame:
    grams = df.withColumn("grams", F.array_distinct(F.concat(_grams(F.col("host"), "h:"),
                                                             _grams(F.col("path"), "p:"))))
    return HashingTF(numFeatures=HASH_SLOTS, inputCol="grams", outputCol="features", binary=True).transform(grams)


def training_table(judged: DataFrame, per_class: int = TRAIN_ROWS) -> DataFrame:
    """Bounded labelled table: distinct rule-decided (host, path), by hash order."""
    labelled = judged.where("rule is not null").select("host", "path", F.col("rule_verdict").alias("v")).distinct()
    order = F.xxhash64("host", "path")
    parts = [labelled.where(F.col("v") == v).orderBy(order, "host", "path").limit(per_class)
             for v in ("allow", "block")]
    return parts[0].unionByName(parts[1]).withColumn("label", (F.col("v") == "block").cast("double"))


def filter_urls(df: DataFrame, id_col: str, url_col: str, rules=RULES, per_class: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict."""
    host, path = url_parts(F.col("_url"))
    parts = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select(
        "_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = land(parts.select("_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict")))
    train = land(training_table(judged, per_class).coalesce(1))  # bounded: 2 * per_class rows
    seen = {r["label"] for r in train.select("label").distinct().collect()}  # at most two values
    if len(seen) == 2:
        fitted = LogisticRegression(maxIter=30, regParam=0.01, aggregationDepth=2).fit(with_ngrams(train))
        scored = fitted.transform(with_ngrams(judged)).withColumn(
            "method", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    else:
        scored = judged.withColumn("method", F.lit("block" if seen == {1.0} else "allow"))
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule",
                         F.coalesce("rule_verdict", "method").alias("verdict"))


@register("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), "page_id", "url")
