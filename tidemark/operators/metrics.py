"""Statistics of labels, scores and clusters as DataFrame aggregates, and exact stratified splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two labelings; 1 where both are trivial."""
    two = lambda c: F.col(c).cast("double") * (F.col(c).cast("double") - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    s = cells.agg(F.sum(two("n")).alias("cells"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("rows"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("cols"))
    e = F.col("rows") * F.col("cols") / two("n")
    d = (F.col("rows") + F.col("cols")) / 2 - e
    one = s.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # of one row each
    return one.select(F.round(F.when(d == 0, 1.0).otherwise((F.col("cells") - e) / d), 6).alias("ari"))


def uplift_summary(df: DataFrame, score: str = "UpliftScore") -> DataFrame:
    """One row: sizes and churn rates of the treated and the others (null without any), mean and population deviation of the uplift."""
    treated, control = F.col("Treatment") == 1, F.col("Treatment") == 0
    rate = lambda p: F.round(F.avg(F.when(p, F.col("Churn"))), 6)
    return df.agg(
        F.count_if(treated).alias("treatment_group_size"), F.count_if(control).alias("control_group_size"), rate(treated).alias("treatment_churn_rate"), rate(control).alias("control_churn_rate"),
        F.round(F.avg(score), 6).alias("mean_uplift"), F.round(F.stddev_pop(score), 6).alias("std_uplift"),
    )


def _by_score(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))


def auc_ap_brier(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, auc, ap, brier): rank-sum AUC with average ties, stepwise average precision, mean squared error; 0.5 and 0 with one class. Without ``by`` one row, with it one for each group with a score.

    Ranks are running sums over ranges of the distinct scores, so a group may hold any share of the rows.
    """
    by = list(by)
    d = running(_by_score(df.filter(F.col(score).isNotNull()), score, label, by), [F.col(c) for c in by], [F.col("s")], {"below": F.col("n"), "hits": F.col("p")}, {"all": F.col("n"), "positives": F.col("p")})
    d = d.withColumn("tp", F.col("positives") - F.col("hits")).withColumn("seen", F.col("all") - F.col("below"))
    t = d.groupBy(*by).agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("precision"))
    neg = F.col("N") - F.col("P")
    both = (F.col("P") > 0) & (neg > 0)
    brier = df.groupBy(*[F.col(c).alias(f"b_{c}") for c in by]).agg(F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"))
    auc = F.when(both, F.try_divide(F.col("ranks") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * neg)).otherwise(0.5)
    ap = F.when(both, F.try_divide(F.col("precision"), F.col("P"))).otherwise(0.0)
    out = t.select(*by, F.round(auc, 6).alias("auc"), F.round(ap, 6).alias("ap"))
    if not by:
        return out.crossJoin(F.broadcast(brier))  # of one row
    return out.join(brier, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in by])).drop(*[f"b_{c}" for c in by])


def davies_bouldin(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """(davies_bouldin): over clusters, the mean of the worst ratio of spreads to the distance of centres."""
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    norm = lambda parts: F.sqrt(reduce(lambda x, y: x + y, parts))
    own = norm([(F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in columns])
    spread = df.join(F.broadcast(centres), cluster).groupBy(cluster).agg(F.avg(own).alias("spread"))  # one row for each cluster
    a = centres.join(spread, cluster)
    b = a.select(F.col(cluster).alias("other"), F.col("spread").alias("o_spread"), *[F.col(f"m_{c}").alias(f"o_{c}") for c in columns])
    far = norm([(F.col(f"m_{c}") - F.col(f"o_{c}")) * (F.col(f"m_{c}") - F.col(f"o_{c}")) for c in columns])
    worst = a.join(F.broadcast(b), F.col(cluster) != F.col("other")).groupBy(cluster).agg(F.max((F.col("spread") + F.col("o_spread")) / far).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def class_weights(df: DataFrame, by: str, label: str) -> DataFrame:
    """Per group the weight of positives: negatives over positives, at least 1; 5 where there is none."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(by).agg(pos.alias("positives"), neg.alias("negatives"), F.round(F.when(pos == 0, 5.0).otherwise(F.greatest(F.lit(1.0), F.try_divide(neg, pos))), 6).alias("weight"))


def stratified_split(df: DataFrame, strata: list[str], order: Column, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: in each stratum exactly the rounded share of rows, first by the order. Strata of any size are ranked by ranges."""
    placed = running(df, [F.col(s) for s in strata], [order], {"is_train": F.lit(1)}, {"_n": F.lit(1)})
    return placed.withColumn("is_train", F.col("is_train") < F.round(F.col("_n") * share)).drop("_n")


def stratified_folds(df: DataFrame, strata: list[str], order: Column, folds: int = 3) -> DataFrame:
    """Adds ``fold``: a stratum's rows are dealt to the folds in turn, by the order."""
    return running(df, [F.col(s) for s in strata], [order], {"fold": F.lit(1)}).withColumn("fold", (F.col("fold") % folds).cast("int"))
