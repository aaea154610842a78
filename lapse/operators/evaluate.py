"""Evaluation operators on a (score, label) table.

Scores are first collapsed to distinct values with per-score positive and
negative counts (an aggregate that combines map-side, so a score shared by a
third of the rows is one row after the partial aggregate).  Cumulative counts
in descending score order come from :func:`running_totals`, never from a
one-partition window; the grand totals ride along from its small bucket
table.  The running totals read the collapsed scores twice (bucket totals, then the
rows); Spark reuses the exchange that collapses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.config import RiskThresholds
from lapse.operators.cumulative import running_totals


def collapse_scores(df: DataFrame, score: str = "churn_probability", label: str = "is_churn") -> DataFrame:
    y = F.col(label).cast("long")
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(score).cast("double").alias("score"))
              .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"), F.count(F.lit(1)).alias("n")))


def threshold_table(df: DataFrame, score: str = "churn_probability", label: str = "is_churn",
                    buckets: int = 4096, score_range: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """One row per distinct score, descending: tp = cum_pos, fp = cum_neg
    (counts at or above the score), ``idx`` = its 1-based position, and the
    totals P, N, G (positives, negatives, distinct scores) on every row.
    ``score_range`` only shapes the buckets (scores outside it stay exact);
    None derives it from the data."""
    g = collapse_scores(df, score, label).withColumn("one", F.lit(1))
    lo, hi = score_range if score_range else (None, None)
    cum = running_totals(g, "score", ["pos", "neg", "one"], descending=True, buckets=buckets, lo=lo, hi=hi,
                         with_totals=True)
    return cum.select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      F.col("cum_one").alias("idx"), F.col("total_pos").alias("P"), F.col("total_neg").alias("N"),
                      F.col("total_one").alias("G"))


def roc_auc(df: DataFrame, score: str = "churn_probability", label: str = "is_churn") -> DataFrame:
    """Area under the ROC curve (trapezoids over distinct scores; ties
    count half).  NULL when one class is absent.  One pass over the
    threshold table."""
    t = threshold_table(df, score, label)
    above = F.col("tp") - F.col("pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / F.lit(2.0)))
    return t.agg(F.try_divide(area, F.max("P").cast("double") * F.max("N").cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "churn_probability", label: str = "is_churn") -> DataFrame:
    """Sum over distinct thresholds of (R_n - R_{n-1}) * P_n (step rule,
    not a trapezoid)."""
    t = threshold_table(df, score, label)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.agg(F.try_divide(F.sum(F.col("pos") * prec), F.max("P").cast("double")).alias("average_precision"))


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "churn_probability",
              label: str = "is_churn") -> DataFrame:
    """E5 + E3 + E4: tn/fp/fn/tp at a threshold, precision, recall, F1 (0 when
    undefined) and the Brier score, in one pass."""
    p, y = F.col(score), F.col(label)
    pred = p >= F.lit(float(threshold))
    c = df.filter(p.isNotNull() & y.isNotNull()).agg(
        F.count(F.when(~pred & (y == 0), 1)).alias("tn"),
        F.count(F.when(pred & (y == 0), 1)).alias("fp"),
        F.count(F.when(~pred & (y == 1), 1)).alias("fn"),
        F.count(F.when(pred & (y == 1), 1)).alias("tp"),
        F.avg(F.pow(p - y.cast("double"), 2)).alias("brier_score"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tn", "fp", "fn", "tp",
                    F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
                    "brier_score")


def summary(df: DataFrame, threshold: float = 0.5, score: str = "churn_probability", label: str = "is_churn") -> DataFrame:
    """E1 + E2 + E5 + E3 + E4 from one threshold table: the columns of :func:`confusion`, then
    ``roc_auc`` and ``pr_auc``.  Brier's sum comes from the counts per distinct score."""
    t = threshold_table(df, score, label)
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    above = F.col("tp") - pos
    hit = s >= F.lit(float(threshold))
    c = t.agg(
        F.sum(F.when(hit, F.lit(0)).otherwise(neg)).alias("tn"), F.sum(F.when(hit, neg).otherwise(F.lit(0))).alias("fp"),
        F.sum(F.when(hit, F.lit(0)).otherwise(pos)).alias("fn"), F.sum(F.when(hit, pos).otherwise(F.lit(0))).alias("tp"),
        F.try_divide(F.sum(pos * F.pow(s - 1.0, 2) + neg * F.pow(s, 2)), F.sum(pos + neg)).alias("brier_score"),
        F.try_divide(F.sum(neg * (above + pos / F.lit(2.0))), F.max("P").cast("double") * F.max("N").cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(pos * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.max("P").cast("double")).alias("pr_auc"))
    tn, fp, fn, tp = (F.coalesce(F.col(x), F.lit(0)) for x in ("tn", "fp", "fn", "tp"))
    return c.select(tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
                    F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
                    "brier_score", "roc_auc", "pr_auc")


def _thinned(points: DataFrame, n_points: int) -> DataFrame:
    """the points (idx, G, ...) at ``floor(linspace(0, G, n_points))``, with ``j``.

    Each point finds the few ``j`` that pick it (several where there are fewer points than
    ``n_points``), so the curve is read once and nothing is joined."""
    last, g, idx = F.lit(n_points - 1), F.col("G"), F.col("idx")
    step = g.cast("double") / F.lit(float(n_points - 1))
    near = F.floor(idx * F.lit(float(n_points - 1)) / g)
    after = F.floor((idx + 1) * F.lit(float(n_points - 1)) / g)
    js = F.sequence(F.greatest(near - 1, F.lit(0)), F.least(after + 1, last))
    picks = F.filter(js, lambda j: F.when(j == last, g).otherwise(F.floor(j.cast("double") * step)) == idx)
    return points.withColumn("j", F.explode(picks)).withColumn("j", F.col("j").cast("int"))


def roc_curve(df: DataFrame, n_points: int = 100, score: str = "churn_probability",
              label: str = "is_churn") -> DataFrame:
    """ROC points (fpr, tpr): (0, 0) then one per distinct score,
    descending, thinned to ``n_points`` by F12.  The origin comes with the first score."""
    t = threshold_table(df, score, label)
    point = F.struct("idx", F.try_divide(F.col("fp"), F.col("N").cast("double")).alias("fpr"),
                     F.try_divide(F.col("tp"), F.col("P").cast("double")).alias("tpr"))
    origin = F.struct(F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = t.select("G", F.inline(F.when(F.col("idx") == 1, F.array(origin, point)).otherwise(F.array(point))))
    return _thinned(pts, n_points).select("j", "idx", "fpr", "tpr")


def pr_curve(df: DataFrame, n_points: int = 100, score: str = "churn_probability",
             label: str = "is_churn") -> DataFrame:
    """(precision, recall) with recall decreasing: distinct thresholds in
    ascending order, then the end point (1, 0); thinned to ``n_points``.
    With no positives, recall is 1 everywhere.  The end comes with the highest score."""
    t = threshold_table(df, score, label)
    point = F.struct((F.col("G") - F.col("idx")).alias("idx"),
                     (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     F.coalesce(F.try_divide(F.col("tp"), F.col("P").cast("double")), F.lit(1.0)).alias("recall"))
    end = F.struct(F.col("G").cast("long").alias("idx"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    pts = t.select("G", F.inline(F.when(F.col("idx") == 1, F.array(point, end)).otherwise(F.array(point))))
    return _thinned(pts, n_points).select("j", "idx", "precision", "recall")


def calibration_curve(df: DataFrame, n_bins: int = 10, score: str = "churn_probability",
                      label: str = "is_churn") -> DataFrame:
    """Uniform bins on [0, 1]; a score's bin is the number of inner edges
    strictly below it (a score on an edge falls left); mean score and observed
    rate of each non-empty bin."""
    edges = F.array(*[F.lit(j * (1.0 / n_bins)) for j in range(1, n_bins)])
    p = F.col(score)
    b = F.size(F.filter(edges, lambda e: e < p))
    return (df.filter(p.isNotNull() & F.col(label).isNotNull())
              .groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("prob_pred"),
                   F.avg(F.col(label).cast("double")).alias("prob_true")))


def _percentile_columns(probs: list[float]) -> list[str]:
    return [f"q_{round(q * 100, 6):g}".replace(".", "_") for q in probs]


def grouped_percentiles(long_df: DataFrame, by: list[str], value: str, probs: list[float],
                        buckets: int = 4096, value_range: tuple[float, float] | None = None) -> DataFrame:
    """A26, per group: exact percentiles with linear interpolation at position
    (n-1)q.  Values collapse to (group, value, count); positions come from
    bucketed running totals; one conditional aggregate per group picks the
    two neighbours of each position.  One row per group, columns q_<100q>."""
    v = F.col(value).cast("double")
    g = (long_df.filter(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("cnt")))
    lo, hi = value_range if value_range else (None, None)
    cum = running_totals(g, "v", ["cnt"], by=by, buckets=buckets, lo=lo, hi=hi, with_totals=True)
    first = F.col("cum_cnt") - F.col("cnt")           # 0-based position of the value's first copy
    h_of = {}
    aggs = []
    for q, name in zip(probs, _percentile_columns(probs)):
        h = (F.col("total_cnt") - F.lit(1)).cast("double") * F.lit(float(q))
        h_of[name] = float(q)
        lo_i, hi_i = F.floor(h), F.ceil(h)
        aggs += [F.max(F.when((first <= lo_i) & (lo_i < F.col("cum_cnt")), F.col("v"))).alias(f"{name}_a"),
                 F.max(F.when((first <= hi_i) & (hi_i < F.col("cum_cnt")), F.col("v"))).alias(f"{name}_b")]
    row = cum.groupBy(*by).agg(F.max("total_cnt").alias("_n"), *aggs)
    out = []
    for name, q in h_of.items():
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        h = (F.col("_n") - F.lit(1)).cast("double") * F.lit(q)
        t = h - F.floor(h)
        out.append(F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t).alias(name))
    return row.select(*by, *out)


def exact_percentiles(df: DataFrame, col: str, probs: list[float], buckets: int = 4096,
                      value_range: tuple[float, float] | None = None) -> DataFrame:
    """Exact percentiles of one column (one row, columns q_<100q>)."""
    # no grouping key: the value range comes from scalar subqueries, not a join
    return grouped_percentiles(df.select(F.col(col).alias("_v")), [], "_v", probs, buckets, value_range)


def tier_thresholds(df: DataFrame, score: str = "churn_probability", high_q: float = 0.95,
                    medium_q: float = 0.85) -> DataFrame:
    """High = p95, Medium = p85 of the scores, as a 3-row table
    (tier, min_prob, max_prob) that :func:`thresholds_from_table` reads."""
    pc = exact_percentiles(df, score, [high_q, medium_q], value_range=(0.0, 1.0))
    hi_name = pc.columns[0]
    md_name = pc.columns[1]
    rows = F.array(
        F.struct(F.lit("High").alias("tier"), F.col(hi_name).alias("min_prob"), F.lit(None).cast("double").alias("max_prob")),
        F.struct(F.lit("Medium").alias("tier"), F.col(md_name).alias("min_prob"), F.col(hi_name).alias("max_prob")),
        F.struct(F.lit("Low").alias("tier"), F.lit(0.0).alias("min_prob"), F.col(md_name).alias("max_prob")),
    )
    return pc.select(F.inline(rows))


def thresholds_from_table(table: DataFrame) -> RiskThresholds:
    """Bring the two cutoffs of a 3-row threshold table to the driver (3 rows)."""
    rows = {r["tier"]: r["min_prob"] for r in table.collect()}
    return RiskThresholds(high=float(rows["High"]), medium=float(rows["Medium"]))


def score_histogram(df: DataFrame, col: str = "churn_probability", bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins over min..max, the last one right-closed;
    every bin listed, empty ones with 0.  A value's bin is found arithmetically
    and then corrected against the bin's own edges (edge k = lo + k * step, the
    last edge exactly hi), so values on an edge land where an edge comparison
    puts them.  A constant column widens the range by 0.5 on both sides.
    Intermediates are staged as columns so no expression is re-embedded."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    mm = mm.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                   F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    lo_s, hi_s = mm.select("lo").scalar(), mm.select("hi").scalar()
    lo, hi = F.col("_lo"), F.col("_hi")
    step = (hi - lo) / F.lit(float(bins))

    def edge(k):
        return F.when(k >= F.lit(bins), hi).otherwise(lo + k.cast("double") * step)

    v = F.col("_x")
    d = df.select(x.alias("_x")).filter(v.isNotNull()).withColumns({"_lo": lo_s, "_hi": hi_s})
    d = d.withColumn("_i", F.least(F.greatest(F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int"),
                                              F.lit(0)), F.lit(bins - 1)))
    d = d.withColumn("_i", F.when(v < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    d = d.withColumn("_i", F.when((v >= edge(F.col("_i") + 1)) & (F.col("_i") != F.lit(bins - 1)),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = d.groupBy(F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = mm.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("lo").alias("_lo"),
                         F.col("hi").alias("_hi"))
    b = F.col("bin")
    return (all_bins.join(counts, "bin", "left")
              .select("bin", edge(b).alias("bin_lo"), edge(b + 1).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).alias("n")))
