"""Screening eligibility and multi-label evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligibility(*stages: Column) -> Column:
    """NOT_ELIGIBLE if any stage is 0, a missing one counting as 0; unclear (-1) stays eligible."""
    fails = F.lit(False)
    for s in stages:
        fails = fails | (F.coalesce(s.try_cast("int"), F.lit(0)) == 0)
    return F.when(fails, "NOT_ELIGIBLE").otherwise("ELIGIBLE")


def strictly_eligible(*stages: Column) -> Column:
    ok = F.lit(True)
    for s in stages:
        ok = ok & F.coalesce(s == 1, F.lit(False))
    return ok


def first_failing_stage(stages: Sequence[tuple[str, Column]]) -> Column:
    """The first stage that is 0 after stages that are all 1; null otherwise, so an unclear stage hides
    later ones."""
    out, before = F.lit(None).cast("string"), F.lit(True)
    tests = []
    for name, s in stages:
        tests.append((before & (s == 0), name))
        before = before & (s == 1)
    for test, name in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def exclusion_overlap(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Records per combination of stages that are 0, the largest first; records without are left out."""
    flags = [(F.col(s) == 0).alias(s) for s in stages]
    held = df.select(*flags).groupBy(*stages).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws(" & ", *[F.when(F.col(s), s) for s in stages])
    return held.where(" or ".join(stages)).select(name.alias("combination"), "n")


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """(Po - Pe) / (1 - Pe); null if Pe is 1."""
    n = tp + fp + fn + tn
    po = (tp + tn) / n
    pe = ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)
    return F.when(pe != 1, (po - pe) / (1 - pe))


def _ratios(counts: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": F.coalesce(F.try_divide(tp, tp + fp), zero), "recall": F.coalesce(F.try_divide(tp, tp + fn), zero)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero), "kappa": kappa(tp, fp, fn, F.col("tn"))})


def label_metrics(df: DataFrame, truth: str, pred: str, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """label, tp, fp, fn, tn, n, precision, recall, f1, kappa, support per label, and rows _macro,
    _weighted, _micro.

    normalize makes a set of labels (an array) of a cell, such as label_set() or a collapse() of it; without it truth and
    pred are sets; records with an empty truth are not scored, empty predictions are. The
    weighted kappa divides by the whole support, labels without one adding nothing; macro skips them."""
    as_set = (lambda c: F.array_distinct(normalize(F.col(c)))) if normalize else F.col
    scored = df.select(as_set(truth).alias("t"), as_set(pred).alias("p")).where(F.size("t") > 0)
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    hit = scored.select(F.explode(F.array_union("t", "p")).alias("label"), "t", "p").select("label", F.array_contains("t", F.col("label")).alias("t"), F.array_contains("p", F.col("label")).alias("p"))
    counts = hit.groupBy("label").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    counts = counts.crossJoin(F.broadcast(total)).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))  # one number
    per = _ratios(counts).withColumn("support", F.col("tp") + F.col("fn"))
    columns = ["label", "tp", "fp", "fn", "tn", "n", "precision", "recall", "f1", "kappa", "support"]
    none = lambda *names: {c: F.lit(None).cast("long") for c in names}
    macro = per.agg(F.max("n").alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "kappa")], F.sum("support").alias("support")).where("n is not null").withColumns(none("tp", "fp", "fn", "tn")).withColumn("label", F.lit("_macro"))
    over = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("support")) / F.sum("support")
    weighted = per.agg(F.max("n").alias("n"), *[over(c).alias(c) for c in ("precision", "recall", "f1")], F.when(F.count("kappa") > 0, over("kappa")).alias("kappa"), F.sum("support").alias("support")).where("n is not null").withColumns(none("tp", "fp", "fn", "tn")).withColumn("label", F.lit("_weighted"))
    micro = _ratios(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "support")]).where("tp is not null")).withColumn("label", F.lit("_micro")).withColumn("n", F.expr("tp + fp + fn + tn"))
    out = per.select(*columns)
    for rows in (macro, weighted, micro):
        out = out.union(rows.select(*columns))
    return out


def record_confusion(df: DataFrame, truth: str, pred: str, universe: int) -> DataFrame:
    """df with tp, fp, fn, tn of each record over a universe of so many labels."""
    tp, fp, fn = F.size(F.array_intersect(truth, pred)), F.size(F.array_except(pred, truth)), F.size(F.array_except(truth, pred))
    return df.withColumns({"tp": tp, "fp": fp, "fn": fn, "tn": F.lit(universe) - tp - fp - fn})


def binary_metrics(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """One row: the 2 x 2 counts and their ratios."""
    counts = df.select(truth.alias("t"), pred.alias("p")).agg(*[F.count_if(c).cast("long").alias(n) for n, c in (("tp", F.expr("t and p")), ("fp", F.expr("not t and p")), ("fn", F.expr("t and not p")), ("tn", F.expr("not t and not p")))])
    out = _ratios(counts)
    return out.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")))


def unmasked(truth: Column, pred: Column, banned: Sequence[str]) -> Column:
    """Whether neither side holds a placeholder."""
    no = F.array(*[F.lit(b) for b in banned])
    return ~F.arrays_overlap(truth, no) & ~F.arrays_overlap(pred, no)
