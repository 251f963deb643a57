"""Operator 4: quality rules by robust multivariate outliers.

Base statistics of every whole text, then per (language, source) a minimum
covariance determinant estimate of the transformed statistic vectors, and
rejection of vectors whose robust Mahalanobis distance is too large. Native
expressions only: one scan, two small aggregates per concentration step.

Concentration: start from the rows nearest to the coordinate-wise median (in
median absolute deviations), then repeat "mean and covariance of the nearest
``H_SHARE`` of the group, new distances". The covariance is regularised with a
fixed least deviation per statistic, so a statistic that is constant in a
group (no symbols at all) gives a finite distance. Distances are scaled so that
their median is the chi-square median, as usual for this estimator.

Groups with fewer than ``MIN_GROUP`` rows use the estimate of their language,
and those of small languages the estimate of all rows.

Defined results: null text has no words (base_failed, not kept); null language
or source is a group of its own; empty input gives no rows; repeated rows are
judged alike; other columns of the input are ignored by ``quality_table`` and
kept by ``keep_good``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import WORD_SPACE, all_columns, land, small, table, words
from gravis.llm.registry import register
from gravis.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
H_SHARE = 0.75
C_STEPS = 4
MIN_GROUP = 100
CHI2_5_MEDIAN = 4.35146
CUTOFF = 50.0  # squared robust distance; chi-square with 5 degrees exceeds it about once in 10^9
# Transformed statistics and the least standard deviation of each.
FEATURES = {"f_words": 0.5, "f_length": 0.35, "f_symbols": 0.08, "f_lines": 0.12, "f_repeat": 0.12}
_STEP_ACCURACY = 1000
SALTS = 32


def base_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """id, ``keep`` columns and the base statistics of each whole text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    d = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    keep = (*keep, "text_hash")
    d = d.withColumn("text_hash", F.xxhash64(text))
    bare = F.translate(text, WORD_SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.translate(s, WORD_SPACE, "") != "")
    d = d.select("_id", *keep, F.length(bare).cast("long").alias("word_chars"),
                 (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 lines.alias("_lines"), words(F.col("_text")).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    # 64-bit hashes of the 3-word windows; within one text a collision has odds below 1e-10
    pair = F.zip_with(w, F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
    wins = F.slice(F.zip_with(pair, F.slice(w, 3, n), lambda p, c: F.xxhash64(p, c)), 1, F.greatest(n - 2, F.lit(0)))
    d = d.select("_id", *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 wins.alias("_h"))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    order = F.when(repeated, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("_o", order)
    o = F.col("_o")
    twins = F.flatten(F.zip_with(
        F.slice(o, 1, F.size(o) - 1), F.slice(o, 2, F.size(o)),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    covered = F.size(F.array_distinct(F.flatten(
        F.transform(F.array_distinct(twins), lambda p: F.array(p, p + 1, p + 2)))))
    return d.select(F.col("_id").alias(id_col), *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
                    F.when(o.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return d.withColumns({
        "f_words": F.log1p(F.col("n_words").cast("double")),
        "f_length": F.col("word_chars") / n,
        "f_symbols": F.sqrt(F.col("n_symbols") / n),
        "f_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        "f_repeat": F.sqrt(F.col("n_repeat_words") / n),
    })


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from columns m_<f> (centre) and l_<f>_<g>
    (lower Cholesky factor) by forward substitution."""
    z: list[Column] = []
    for i, f in enumerate(names):
        s = F.col(f) - F.col(f"m_{f}")
        for j in range(i):
            s = s - F.col(f"l_{f}_{names[j]}") * z[j]
        z.append(s / F.col(f"l_{f}_{f}"))
    return functools.reduce(lambda a, b: a + b, [x * x for x in z])


def _with(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """``rows`` (g, salt, ...) with the columns of their group's one row, listed
    once per salt, so that a group of a third of all rows is spread over tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.join(per_group.select("*", salts), ["g", "salt"])


def _factor(groups: DataFrame, names: list[str], floors: dict[str, float]) -> DataFrame:
    """Centres and Cholesky factors from per-group sums ``n, s_f, p_f_g`` of the
    shifted statistics (shift c_f, so that sums keep their digits)."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    out = groups
    for i, f in enumerate(names):
        for g in names[: i + 1]:
            cov = F.col(f"p_{f}_{g}") / n - (F.col(f"s_{f}") / n) * (F.col(f"s_{g}") / n)
            out = out.withColumn(f"v_{f}_{g}", (cov + floors[f] ** 2) if f == g else cov)
    for i, f in enumerate(names):
        for j, g in enumerate(names[: i + 1]):
            s = F.col(f"v_{f}_{g}")
            for k in range(j):
                s = s - F.col(f"l_{f}_{names[k]}") * F.col(f"l_{g}_{names[k]}")
            if f == g:  # never below the square of the least deviation, but for rounding
                out = out.withColumn(f"l_{f}_{g}", F.sqrt(F.greatest(s, F.lit(floors[f] ** 2 * 0.01))))
            else:
                out = out.withColumn(f"l_{f}_{g}", s / F.col(f"l_{g}_{g}"))
    centres = {f"m_{f}": F.col(f"c_{f}") + F.col(f"s_{f}") / n for f in names}
    factors = [f"l_{f}_{g}" for i, f in enumerate(names) for g in names[: i + 1]]
    return out.withColumns(centres).select("g", *[f"c_{f}" for f in names], *[f"m_{f}" for f in names], *factors)


def mcd(rows: DataFrame, floors: dict[str, float] = FEATURES, h: float = H_SHARE, steps: int = C_STEPS) -> DataFrame:
    """Minimum covariance determinant per group ``g`` of ``rows`` (g, salt, features):
    g, centres m_*, Cholesky factors l_* and ``scale`` of the squared distance."""
    names = list(floors)
    centre = cut_lineage(rows.groupBy("g").agg(
        *[F.percentile_approx(f, 0.5, _STEP_ACCURACY).alias(f"c_{f}") for f in names]))
    spread = _with(rows, centre).groupBy("g").agg(
        *[F.first(f"c_{f}").alias(f"c_{f}") for f in names],
        *[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"c_{f}")), 0.5, _STEP_ACCURACY),
                     F.lit(floors[f])).alias(f"l_{f}_{f}") for f in names])
    params = spread.withColumns({f"m_{f}": F.col(f"c_{f}") for f in names} | {
        f"l_{f}_{g}": F.lit(0.0) for i, f in enumerate(names) for g in names[:i]})
    params = cut_lineage(params)
    for _ in range(steps):
        far = _with(rows, params).withColumn("d2", _distance(names))
        cut = cut_lineage(far.groupBy("g").agg(F.percentile_approx("d2", h, _STEP_ACCURACY).alias("cut")))
        near = _with(rows, params.join(cut, "g")).withColumn("d2", _distance(names)).where("d2 <= cut")
        x = {f: F.col(f) - F.col(f"c_{f}") for f in names}
        sums = near.groupBy("g").agg(
            F.count("*").alias("n"), *[F.first(f"c_{f}").alias(f"c_{f}") for f in names],
            *[F.sum(x[f]).alias(f"s_{f}") for f in names],
            *[F.sum(x[f] * x[g]).alias(f"p_{f}_{g}") for i, f in enumerate(names) for g in names[: i + 1]])
        params = cut_lineage(_factor(sums, names, floors))
    scale = _with(rows, params).withColumn("d2", _distance(names)).groupBy("g").agg(
        F.greatest(F.percentile_approx("d2", 0.5, _STEP_ACCURACY) / CHI2_5_MEDIAN, F.lit(1.0)).alias("scale"))
    return params.join(scale, "g")


def quality_table(df: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, n_words, base statistics, base_failed, kept, distance, text_hash."""
    stats = land(transformed(base_statistics(df, keep=("lang", "source"))).withColumn("base_failed", base_failed()))
    names = list(FEATURES)
    sound = stats.where(~F.col("base_failed"))
    # a group's key, then the key of the estimate it uses: itself, its language, or everything
    key = F.concat(F.lit("s"), F.to_json(F.struct("lang", "source")))
    lkey = F.concat(F.lit("l"), F.to_json(F.struct("lang")))
    sizes = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy(lkey.alias("lk")).agg(F.sum("n").alias("ln"))
    sizes = sizes.select(key.alias("sk"), lkey.alias("lk"), "n").join(by_lang, "lk")
    use = cut_lineage(sizes.select("sk", F.when(F.col("n") >= min_group, F.col("sk")).when(
        F.col("ln") >= min_group, F.col("lk")).otherwise("all").alias("use")))
    small = use.where(F.col("use") != F.col("sk")).select("use").distinct()
    keyed = sound.select("doc_id", key.alias("sk"), lkey.alias("lk"), *names)
    own = keyed.select(F.col("sk").alias("g"), *names)
    wide = keyed.select(F.explode(F.array(F.col("lk"), F.lit("all"))).alias("g"), *names).join(
        small.withColumnRenamed("use", "g"), "g", "left_semi")
    salt = F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int").alias("salt")
    params = mcd(land(own.join(use.where("use = sk").select(F.col("sk").alias("g")), "g", "left_semi")
                      .unionByName(wide).select("*", salt)))
    params = params.withColumnRenamed("g", "use").join(use, "use")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    judged = stats.select("*", key.alias("sk"), salt).join(params.select("*", salts), ["sk", "salt"], "left")
    d2 = _distance(names) / F.col("scale")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cutoff)).alias("kept"),
                         d2.alias("distance"), "text_hash")


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of ``df`` whose text is kept, with all columns. Rows of equal id
    and text go together, and stay if any of them is kept."""
    verdicts = quality_table(df).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"))
    gone = land(verdicts.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")))
    text_hash = F.xxhash64(F.coalesce(df["text"], F.lit("")))
    return df.join(small(gone), df["doc_id"].eqNullSafe(gone["_gone"]) & (text_hash == gone["_gone_hash"]), "left_anti").select(
        *all_columns(df))


@register("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    return quality_table(table(spark, sf_dir, "documents"))
