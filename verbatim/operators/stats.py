"""Statistics: association, correction, correlation, resampling, agreement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """observed, expected and their ratio of every cell of each table, empty cells too."""
    by = list(keys)
    seen = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("observed"))
    left = seen.groupBy(*by, a).agg(F.sum("observed").alias("row_total"))
    right = seen.groupBy(*by, b).agg(F.sum("observed").alias("column_total"))
    total = seen.groupBy(*by).agg(F.sum("observed").alias("total"))
    # Cells are categories times categories of one table, never rows.
    cells = left.join(right, by) if by else left.crossJoin(right)
    cells = (cells.join(total, by) if by else cells.crossJoin(total)).join(seen, [*by, a, b], "left")
    expected = F.col("row_total") * F.col("column_total") / F.col("total")
    return cells.select(*by, a, b, F.coalesce("observed", F.lit(0)).alias("observed"), expected.alias("expected"), (F.coalesce("observed", F.lit(0)) / expected).alias("ratio"), "total")


def upper_gamma(s: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """For each table: chi-square, degrees of freedom, p, Cramer's V, the least expected count, n and fisher_p.

    fisher_p is Fisher's exact two-sided p of a 2x2 table with an expected count below 5, else null;
    chi2, p and cramers_v are null for a table of one row or column.
    """
    cells = contingency(rows, a, b, *keys)
    frame = cells.groupBy(*keys) if keys else cells.groupBy()
    stat = frame.agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"), F.min("expected").alias("least_expected"), F.max("total").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("observed").cast("long").alias("observed")))).alias("cells"))
    df = (F.col("r") - 1) * (F.col("c") - 1)

    @F.pandas_udf("double")
    def p_value(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(d / 2, v / 2) if d > 0 else None for v, d in zip(x, k, strict=True)])

    @F.pandas_udf("double")
    def exact(counts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fisher_exact(*(int(v) for v in x)) for x in counts], dtype="float64")

    small = F.when((F.col("r") == 2) & (F.col("c") == 2) & (F.size("cells") == 4) & (F.col("least_expected") < 5), F.col("cells.observed"))
    v = F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1)))
    return stat.select(*keys, F.when(df > 0, F.col("chi2")).alias("chi2"), df.alias("df"), p_value("chi2", df).alias("p"), F.when(df > 0, v).alias("cramers_v"), "least_expected", "n", exact(small).alias("fisher_p"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: the tables with the same margins that are no likelier."""
    n, r, k = a + b + c + d, a + b, a + c
    log = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(k - x + 1) - math.lgamma(n - r - k + x + 1) - math.lgamma(n + 1) + math.lgamma(k + 1) + math.lgamma(n - k + 1)
    p = [math.exp(log(x)) for x in range(max(0, k - (n - r)), min(r, k) + 1)]
    own = math.exp(log(a))
    return min(1.0, sum(x for x in p if x <= own * (1 + 1e-7)))


def bh_adjust(tests: DataFrame, p: str, *keys: str, order: str | None = None) -> DataFrame:
    """Adds q, the Benjamini-Hochberg adjusted p within keys; null p stays null and isn't counted."""
    some, none = tests.filter(F.col(p).isNotNull()), tests.filter(F.col(p).isNull())
    by = Window.partitionBy(*keys)
    tie = [F.col(order)] if order else []
    ranked = some.withColumn("_r", F.row_number().over(by.orderBy(F.col(p), *tie))).withColumn("_n", F.count(F.lit(1)).over(by))
    down = by.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_r", "_n")
    return out.unionByName(none.withColumn("q", F.lit(None).cast("double")))


def correlations(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """n, Pearson and Spearman (average ranks) of complete pairs; null with fewer than three."""
    full = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str):
        by = Window.partitionBy(*keys)
        return F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = full.withColumn("_rx", rank(x)).withColumn("_ry", rank(y))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    enough = F.col("n") >= 3
    return out.select(*keys, "n", F.when(enough, F.col("pearson")).alias("pearson"), F.when(enough, F.col("spearman")).alias("spearman"))


def hac_trend(series: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Slope of y on x with a Newey-West standard error (Bartlett weights); nulls with fewer than four points."""
    types = ", ".join(f"`{k}` {dict(series.dtypes)[k]}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.dropna(subset=[x, y]).sort_values(x)
        n = len(part)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        if n < 4 or part[x].nunique() < 2:
            return pd.DataFrame(head | {"n": [n], "slope": [None], "se": [None], "lag": [None]})
        design = np.column_stack([np.ones(n), part[x].to_numpy(float)])
        beta, *_ = np.linalg.lstsq(design, part[y].to_numpy(float), rcond=None)
        scores = design * (part[y].to_numpy(float) - design @ beta)[:, None]
        lag = max(1, math.floor(4 * (n / 100) ** (2 / 9)))
        middle = scores.T @ scores
        for k in range(1, min(lag, n - 1) + 1):
            g = scores[k:].T @ scores[:-k]
            middle += (1 - k / (lag + 1)) * (g + g.T)
        bread = np.linalg.inv(design.T @ design)
        return pd.DataFrame(head | {"n": [n], "slope": [beta[1]], "se": [math.sqrt(max(0.0, (bread @ middle @ bread)[1, 1]))], "lag": [lag]})

    return series.groupBy(*keys).applyInPandas(fit, f"{types}, n long, slope double, se double, lag long")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, times: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean, and its interval over resamples of whole clusters.

    Only sums by cluster are resampled. A cluster's weight in a resample is a Poisson draw of a hash of
    the seed, the resample and the cluster, so draws need no order and no place.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    draws = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", F.col(cluster)), F.lit(1 << 40)) / float(1 << 40)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weight = sum((F.when(u >= float(s), 1).otherwise(0) for s in steps), F.lit(0))
    reps = draws.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    low, high = (1 - level) / 2, (1 + level) / 2
    return per.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("n_clusters")).crossJoin(reps.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high")))


def paired_jaccard_bootstrap(rows: DataFrame, cluster: str, truth: str, a: str, b: str, times: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: mean Jaccard measure of ``a`` with ``truth`` less that of ``b``, its interval, the share of resamples not above 0, clusters.

    Whole clusters are resampled as in ``cluster_bootstrap``, both measures with the same draws. Null lists are empty ones; two
    empty lists agree (1). A null cluster is one of its own. All but n_clusters are null without rows.
    """
    def measure(guess: str):
        x, y = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (truth, guess))
        both = F.size(F.array_union(x, y))
        return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)

    per = rows.groupBy(F.col(cluster).alias("_cluster")).agg(F.sum(measure(a) - measure(b)).alias("s"), F.count(F.lit(1)).alias("n"))
    draws = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", "_cluster"), F.lit(1 << 40)) / float(1 << 40)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weight = sum((F.when(u >= float(s), 1).otherwise(0) for s in steps), F.lit(0))
    reps = draws.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("d"))
    low, high = (1 - level) / 2, (1 + level) / 2
    spread = reps.agg(F.percentile("d", low).alias("low"), F.percentile("d", high).alias("high"), F.avg((F.col("d") <= 0).cast("int")).alias("p_not_above"))
    return per.agg((F.sum("s") / F.sum("n")).alias("difference"), F.count(F.lit(1)).alias("n_clusters")).crossJoin(spread)  # one row each


def permutation_test(rows: DataFrame, stratum: str, group: str, value: str, identity: str, times: int, seed: int = 0) -> DataFrame:
    """Difference of two groups' means, and the share of label shuffles inside strata with one as large: (1 + hits) / (times + 1)."""
    reps = rows.select(stratum, F.col(group).cast("int").alias("g"), F.col(value).cast("double").alias("v"), identity).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times))))
    place = F.row_number().over(Window.partitionBy("rep", stratum).orderBy(F.when(F.col("rep") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "rep", identity)), identity))
    ordered = reps.withColumn("at", place)
    labels = ordered.filter("rep = 0").select(stratum, F.col("at").alias("_at"), F.col("g").alias("_g"))
    shuffled = ordered.join(labels.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_at")))
    diff = shuffled.groupBy("rep").agg((F.avg(F.when(F.col("_g") == 1, F.col("v"))) - F.avg(F.when(F.col("_g") == 0, F.col("v")))).alias("d"))
    own = diff.filter("rep = 0").select(F.col("d").alias("difference"))
    return diff.filter("rep > 0").crossJoin(F.broadcast(own)).groupBy("difference").agg(((1 + F.count_if(F.abs("d") >= F.abs("difference") - 1e-12)) / (times + 1.0)).alias("p"))


def label_agreement(rows: DataFrame, truth: str, guess: str, *keys: str) -> DataFrame:
    """By keys: true and false positives and negatives, precision, recall, F1 and Cohen's kappa; null where undefined."""
    t, g = F.coalesce(F.col(truth).cast("boolean"), F.lit(False)), F.coalesce(F.col(guess).cast("boolean"), F.lit(False))
    frame = rows.groupBy(*keys) if keys else rows.groupBy()
    c = frame.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    kappa = F.when((n > 0) & (chance < 1), ((tp + tn) / n - chance) / (1 - chance))
    return c.select(*keys, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), kappa.alias("kappa"))


def count_errors(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    d = F.col(guess) - F.col(truth)
    return rows.agg(F.avg(F.abs(d)).alias("mean_absolute_error"), F.avg(d).alias("bias"))


def normalised_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """NMI of two labelings (arithmetic mean); 1 where both are constant."""
    joint = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    joint = joint.withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(0)))).withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    h = lambda m: -F.sum(F.col("n") / F.col("t") * F.log(F.col(m) / F.col("t")))
    out = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), h("na").alias("ha"), h("nb").alias("hb"))
    return out.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))
