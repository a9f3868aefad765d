"""Classifier evaluation on any (label, score/prediction) columns, fully distributed.

All metrics are aggregations; the ROC curve and AUC are computed over the
table of distinct scores (one row per score value, so a score shared by a
third of the rows is one row) in range partitions (``ranking``) instead of a
single-task sort.  Rows whose label or score is null, or whose score is NaN,
take no part in either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.operators.ranking import PARTITION, exclusive_prefix, range_partitioned

EXACT = "decimal(38,0)"


def _is_pos(label: str):
    return (F.col(label) == 1).cast("bigint")


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Two rows (actual class 0 and 1), columns ``predicted_0`` / ``predicted_1``;
    classes and cells that do not occur are 0.  Rows with a null are not counted."""
    cells = [F.coalesce(F.sum(((F.col(label) == a) & (F.col(prediction) == p)).cast("bigint")), F.lit(0)).alias(f"c{a}{p}")
             for a in (0, 1) for p in (0, 1)]
    rows = F.array(*[F.struct(F.lit(a).alias("actual"), F.col(f"c{a}0").alias("predicted_0"),
                              F.col(f"c{a}1").alias("predicted_1")) for a in (0, 1)])
    return df.agg(*cells).select(F.inline(rows))


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``tn fp fn tp`` (one pass, conditional sums)."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(F.sum((~y & ~p).cast("bigint")).alias("tn"),
                  F.sum((~y & p).cast("bigint")).alias("fp"),
                  F.sum((y & ~p).cast("bigint")).alias("fn"),
                  F.sum((y & p).cast("bigint")).alias("tp"))


def _ratio(a, b):
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str, prediction: str,
                          names: tuple[str, str] = ("Legitimate", "Fraud")) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and
    weighted averages (zero denominators give 0)."""
    c = confusion_counts(df, label, prediction)
    tn, fp, fn, tp = (F.coalesce(F.col(x), F.lit(0)) for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    s0, s1 = tn + fp, tp + fn
    total = s0 + s1

    def f1(p, r):
        return F.when(p + r != 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))

    staged = c.select(p0.alias("p0"), r0.alias("r0"), p1.alias("p1"), r1.alias("r1"),
                      s0.alias("s0"), s1.alias("s1"), total.alias("n"),
                      _ratio(tp + tn, total).alias("acc"))
    staged = staged.withColumn("f0", f1(F.col("p0"), F.col("r0"))).withColumn("f1", f1(F.col("p1"), F.col("r1")))

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_name"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        s.cast("bigint").alias("support"))

    col = F.col
    w = lambda a, b: _ratio(a * col("s0") + b * col("s1"), col("n"))
    rows = F.array(
        row(names[0], col("p0"), col("r0"), col("f0"), col("s0")),
        row(names[1], col("p1"), col("r1"), col("f1"), col("s1")),
        row("accuracy", F.lit(None), F.lit(None), col("acc"), col("n")),
        row("macro avg", (col("p0") + col("p1")) / 2, (col("r0") + col("r1")) / 2,
            (col("f0") + col("f1")) / 2, col("n")),
        row("weighted avg", w(col("p0"), col("p1")), w(col("r0"), col("r1")),
            w(col("f0"), col("f1")), col("n")),
    )
    return staged.select(F.inline(rows))


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    pos, x = _is_pos(label), F.col(score).cast("double")
    return (df.filter(x.isNotNull() & ~F.isnan(x) & F.col(label).isNotNull())
            .groupBy(x.alias("score"))
            .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))


def roc_points(df: DataFrame, label: str, score: str, partitions: int | None = None,
               drop_intermediate: bool = True) -> DataFrame:
    """ROC curve: one point per distinct score threshold, highest first, after an
    origin point (threshold +inf, tp = fp = 0).

    ``tpr``/``fpr`` at threshold ``t`` are the shares of positives/negatives
    with ``score >= t``.  With ``drop_intermediate`` (the usual default) a
    point is dropped when the next threshold adds exactly the same numbers of
    positives and negatives (it lies on the straight line between its
    neighbours); the first and last thresholds are always kept.  The next
    threshold is the next row of the range partition, or the first row of the
    partition after it.
    """
    down = F.col("score").desc()
    st = range_partitioned(score_table(df, label, score), [down], partitions)
    totals = st.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    inside = Window.partitionBy(PARTITION).orderBy(down)
    following = Window.orderBy(PARTITION)  # one row a partition
    firsts = (st.groupBy(PARTITION).agg(F.max(F.struct("score", "pos", "neg")).alias("first"))
              .select(PARTITION, F.lead("first").over(following).alias("after")))
    st = (st.withColumns({"_np": F.lead("pos").over(inside), "_nn": F.lead("neg").over(inside)})
          .join(firsts, PARTITION))
    st = st.withColumns({"_np": F.coalesce("_np", F.col("after.pos")), "_nn": F.coalesce("_nn", F.col("after.neg"))}).drop("after")
    cum = exclusive_prefix(st, [down], ["pos", "neg"], inclusive=True, ranged=True)
    if drop_intermediate:
        first = F.col("pos_upto") + F.col("neg_upto") == F.col("pos") + F.col("neg")
        cum = cum.filter(first | F.col("_np").isNull() | (F.col("_np") != F.col("pos")) | (F.col("_nn") != F.col("neg")))
    n_pos, n_neg = F.lit(int(totals["P"] or 0)), F.lit(int(totals["N"] or 0))
    points = cum.select(F.col("score").alias("threshold"),
                        F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"),
                        _ratio(F.col("pos_upto"), n_pos).alias("tpr"),
                        _ratio(F.col("neg_upto"), n_neg).alias("fpr"))
    # The origin of the curve exists only when the curve does.
    origin = st.limit(1).select(F.lit(float("inf")).alias("threshold"),
                                F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                                F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return origin.unionByName(points).orderBy(F.col("threshold").desc())


def auc(df: DataFrame, label: str, score: str, partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half (rank statistic), one row:
    ``auc, n_pos, n_neg``.

    ``sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N)`` with exact
    decimal sums, so the value does not depend on partitioning.
    """
    st = score_table(df, label, score)
    cum = exclusive_prefix(st, ["score"], ["neg"], partitions=partitions)
    term = F.col("pos").cast(EXACT) * (F.lit(2).cast(EXACT) * F.col("neg_before").cast(EXACT)
                                       + F.col("neg").cast(EXACT))
    agg = cum.agg(F.sum(term).alias("_num"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return agg.select(F.when(den > 0, F.col("_num").cast("double") / den).alias("auc"),
                      F.col("n_pos").cast("bigint").alias("n_pos"),
                      F.col("n_neg").cast("bigint").alias("n_neg"))
