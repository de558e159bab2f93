"""Evaluation: per-answer metrics and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import auroc, ranked


def answer_metrics(df: DataFrame, probabilities: str = "probabilities", gold: str = "gold") -> DataFrame:
    """For answers with an array of probabilities and the place of the right one: predicted, p_gold, p_max, correct, nll, brier, valid, strict."""
    p = F.col(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({
        "predicted": (F.array_position(p, F.array_max(p)) - 1).cast("int"),
        "p_gold": F.get(p, F.col(gold)),
        "p_max": F.array_max(p),
        "correct": ((F.array_position(p, F.array_max(p)) - 1) == F.col(gold)).cast("int"),
        "nll": -F.log(F.greatest(F.get(p, F.col(gold)), F.lit(1e-12))),
        "brier": F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == F.col(gold), 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x),
        "valid": F.abs(total - 1) <= 2e-2,
        "strict": F.abs(total - 1) <= 1e-3,
    })


def noul_metrics(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """For statements with P(true) and the truth: correct, confidence, nll, brier (2 (p - y)^2)."""
    q = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.withColumns({
        "correct": ((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("int"),
        "confidence": F.greatest(F.col(p), 1 - F.col(p)),
        "nll": -F.log(F.greatest(q, F.lit(1e-12))),
        "brier": 2 * F.pow(F.col(p) - F.col(y), F.lit(2.0)),
    })


def summary(df: DataFrame, group: str, kind: str) -> DataFrame:
    """n, accuracy, nll and brier by group, by kind, and overall, in one pass over grouping sets."""
    g = df.groupingSets([[F.col(group)], [F.col(kind)], []], F.col(group), F.col(kind))
    return g.agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"))


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def ece(df: DataFrame, keys: list[str], bins: int, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = df.groupBy(*keys, bin_of(F.col(confidence), bins).alias("__b")).agg(F.count("*").alias("__n"), F.sum(correct).alias("__c"), F.sum(confidence).alias("__s"))
    return b.groupBy(*keys).agg((F.sum(F.abs(F.col("__c") - F.col("__s"))) / F.sum("__n")).alias("ece"))


def selective(df: DataFrame, keys: list[str], confidence: str, correct: str, ties: list[str], share: float = 0.5) -> DataFrame:
    """Accuracy of the surest floor(share * n) answers (one at least)."""
    r = ranked(df.withColumn("__doubt", -F.col(confidence)), keys, "__doubt", ties, name="__r")
    top = r.where(F.col("__r") <= F.greatest(F.floor(F.col("__r_of") * share), F.lit(1)))
    return top.groupBy(*keys).agg(F.avg(correct).alias("selective"))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda a, x: a + x)


def stability(df: DataFrame, keys: list[str], predicted: str, p: str) -> DataFrame:
    """Over groups of two or more: whether all answers agree, and the mean absolute deviation of the probability from the group's mean.

    The mean is joined back from a small aggregate, so a hot group never meets in one window."""
    means = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(predicted).alias("__lo"), F.max(predicted).alias("__hi"), F.avg(p).alias("__m")).where("n >= 2")
    spread = df.join(means, keys).groupBy(*keys).agg(F.avg(F.abs(F.col(p) - F.col("__m"))).alias("spread"))
    return means.join(spread, keys).select(*keys, "n", (F.col("__lo") == F.col("__hi")).alias("same"), "spread")


def evaluation(df: DataFrame, group: str, kind: str, ties: list[str]) -> DataFrame:
    """All measures of judged answers by group, by kind and overall: cut (group, kind, all), name, n, accuracy (right and valid), nll, brier, ece10, ece15,
    validity, strict, tvd, mae, selective, auroc (null without both truths).

    df: correct, valid, strict, nll, brier, tvd, mae, confidence, p, y.  The three cuts are three copies of a narrow row, so that one pass serves them all;
    ranks go by bins (see operators.ranking), so the overall cut is no single task."""
    cuts = F.array(*(F.struct(F.lit(n).alias("cut"), F.coalesce(v.cast("string"), F.lit("")).alias("name")) for n, v in (("group", F.col(group)), ("kind", F.col(kind)), ("all", F.lit("")))))
    rows = df.withColumn("correct", (F.col("correct") == 1).cast("int") * F.col("valid").cast("int")).withColumn("__c", F.explode(cuts)).select("*", "__c.*").drop("__c")
    k = ["cut", "name"]
    out = rows.groupBy(*k).agg(
        F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg(F.col("valid").cast("int")).alias("validity"),
        F.avg(F.col("strict").cast("int")).alias("strict"), F.avg("tvd").alias("tvd"), F.avg("mae").alias("mae"),
    )
    for part in (ece(rows, k, 10).withColumnRenamed("ece", "ece10"), ece(rows, k, 15).withColumnRenamed("ece", "ece15"), selective(rows, k, "confidence", "correct", ties), auroc(rows, k, "p", "y")):
        out = out.join(part, k, "left")
    return out


def judged_tasks(tasks: DataFrame, answers: DataFrame, keys: list[str], value: str, gold: str) -> DataFrame:
    """Every task with its answer, if any; a task without one counts as attempted by none and wrong."""
    j = tasks.join(answers.withColumn("__has", F.lit(True)), keys, "left")
    return j.withColumns({"attempted": F.coalesce("__has", F.lit(False)), "correct": F.coalesce((F.col(value) == F.col(gold)).cast("int"), F.lit(0))}).drop("__has")


def intelligence(accuracy: Column, chance: Column) -> Column:
    """How much of the way from chance to certainty, 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (accuracy - chance) / (1 - chance)))


def pair_agreement(df: DataFrame, group: str, predicted: str, correct: str, valid: str) -> DataFrame:
    """One row over the groups of exactly two: pairs, both_valid, agree, both_correct (of the valid ones), and their rates."""
    two = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.min(F.col(valid).cast("int")).alias("ok"), F.min(predicted).alias("lo"), F.max(predicted).alias("hi"), F.min(F.col(correct).cast("int")).alias("right")
    ).where("n = 2")
    ok = F.col("ok") == 1
    c = two.agg(F.count("*").alias("pairs"), F.count_if(ok).alias("both_valid"), F.count_if(ok & (F.col("lo") == F.col("hi"))).alias("agree"), F.count_if(ok & (F.col("right") == 1)).alias("both_correct"))
    return c.withColumns({"agreement": F.try_divide("agree", "both_valid"), "both_correct_rate": F.try_divide("both_correct", "pairs")})


def macro(df: DataFrame, measures: list[str]) -> DataFrame:
    """Unweighted means of a grouped report's measures: each configuration counts once."""
    return df.agg(F.count("*").alias("configs"), *(F.avg(m).alias(f"macro_{m}") for m in measures))


__all__ = ["evaluation", "judged_tasks", "intelligence", "pair_agreement", "macro", "answer_metrics", "noul_metrics", "summary", "ece", "auroc", "selective", "total_variation", "stability"]
