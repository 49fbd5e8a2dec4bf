"""Metrics of scored trials.

Scores are first summed up by distinct value, then swept with running sums that are dealt by ranges of the
score, so that no step puts all trials into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..session import pinned
from .keyed import small


def sweep(trials: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """score, p, n (targets and nontargets of that score), p_upto, n_upto, p_all and n_all, a row a distinct score."""
    y = F.col(target).cast("int")
    points = pinned(trials.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")))
    swept = running_sums(points, [F.col("score")], {"p_upto": F.col("p"), "n_upto": F.col("n")})
    totals = points.agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    return swept.join(F.broadcast(totals))  # one row


def eer(trials: DataFrame, score: str = "score", target: str = "target", points: DataFrame | None = None) -> DataFrame:
    """Equal error rate and its threshold: one row eer, threshold (M2, M3).

    Rows are taken by score, nontargets first on ties; at the first row where the false acceptances are at
    most the false rejections, the nearer of it and the row before gives the mean of the two rates. Without both
    kinds of trials the result is null. points: the sweep of the trials, where it is known.
    """
    points = sweep(trials, score, target) if points is None else points
    # Inside one score the nontargets go one by one, and then the targets; the crossing lies in one of the two.
    fa0, fr0 = F.col("n_all") - (F.col("n_upto") - F.col("n")), F.col("p_upto") - F.col("p")
    n, p = F.col("n_all"), F.col("p_all")
    # Least k of nontargets with (fa0 - k) / n <= fr0 / p; then least m of targets with (fa0 - n') / n <= (fr0 + m) / p.
    k = F.greatest(F.lit(0), F.ceil(fa0 - fr0 * n / p - 1e-9))
    crossing_n = (F.col("n") > 0) & (k <= F.col("n"))
    m = F.greatest(F.lit(1), F.ceil((fa0 - F.col("n")) * p / n - fr0 - 1e-9))
    crossing_p = (F.col("p") > 0) & (m <= F.col("p"))
    k = F.greatest(k, F.lit(1))
    far = F.when(crossing_n, (fa0 - k) / n).otherwise((fa0 - F.col("n")) / n)
    frr = F.when(crossing_n, fr0 / p).otherwise((fr0 + m) / p)
    far_before = F.when(crossing_n, (fa0 - k + 1) / n).otherwise(far)
    frr_before = F.when(crossing_n, frr).otherwise((fr0 + m - 1) / p)
    value = F.when(F.abs(far - frr) <= F.abs(far_before - frr_before), (far + frr) / 2).otherwise((far_before + frr_before) / 2)
    found = points.where((n > 0) & (p > 0) & (crossing_n | crossing_p)).select("score", value.alias("eer"))
    return found.agg(F.min_by("eer", "score").alias("eer"), F.min("score").alias("threshold"))


def min_dcf(trials: DataFrame, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0, score: str = "score", target: str = "target", points: DataFrame | None = None) -> DataFrame:
    """Minimum detection cost over all rows in the order of score (nontargets first on ties), normalised by the better trivial system (M1)."""
    points = sweep(trials, score, target) if points is None else points
    cost = lambda fr, fa: F.try_divide(c_miss * p_target * fr, F.col("p_all")) + F.try_divide(c_fa * (1 - p_target) * fa, F.col("n_all"))
    fa0, fr0 = F.col("n_all") - (F.col("n_upto") - F.col("n")), F.col("p_upto") - F.col("p")
    # The cost falls with each nontarget and rises with each target: its least is after the nontargets of a score, or, if it has only targets, after the first of them.
    after = F.when(F.col("n") > 0, cost(fr0, fa0 - F.col("n"))).otherwise(cost(fr0 + 1, fa0))
    trivial = min(c_miss * p_target, c_fa * (1 - p_target))
    return points.agg((F.min(after) / trivial).alias("min_dcf"))


def det_points(trials: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """False acceptance and rejection rates with each distinct score as the threshold, score >= threshold accepted."""
    points = sweep(trials, score, target)
    return points.select("score", F.try_divide(F.col("n_all") - F.col("n_upto") + F.col("n"), F.col("n_all")).alias("far"), F.try_divide(F.col("p_upto") - F.col("p"), F.col("p_all")).alias("frr"))


def frr_at_far(trials: DataFrame, far: float = 0.0005, score: str = "score", target: str = "target") -> DataFrame:
    """The least false rejection rate whose false acceptance rate is at least `far` (M4)."""
    return det_points(trials, score, target).where(F.col("far") >= far).agg(F.max("frr").alias("frr"))


def cavg(scores: DataFrame, trials: DataFrame, n_thresholds: int = 21, p_target: float = 0.5, open_set: bool = False) -> DataFrame:
    """Average cost over languages at the best of equally spaced thresholds (M5, M6).

    scores: lang, utt, score. trials: utt, utt_lang. Scores of utterances that are not in the trials are skipped;
    with open_set, those whose language is none of the scored ones are the class '' of their own, otherwise they are left out.
    """
    known = scores.join(trials, "utt")
    langs = known.select("lang").distinct()
    other = langs.select(F.col("lang").alias("utt_lang"), F.lit(True).alias("__known"))
    known = known.join(small(other), "utt_lang", "left")
    known = known.withColumn("utt_lang", F.when(F.col("__known"), F.col("utt_lang").cast("string")).otherwise("")) if open_set else known.where("__known")
    known = known.withColumn("lang", F.col("lang").cast("string")).withColumn("utt_lang", F.col("utt_lang").cast("string"))
    spread = known.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.countDistinct("lang").alias("n_langs"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1))).alias("step")
    limits = spread.select("n_langs", "lo", "hi", steps).withColumn("t", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (n_thresholds - 1))
    # A row a score, language and class becomes n_thresholds conditional sums: partial sums before the shuffle.
    by_step = known.join(F.broadcast(limits))  # n_thresholds rows
    rates = by_step.groupBy("step", "n_langs", "lang", "utt_lang").agg(F.avg((F.col("score") < F.col("t")).cast("double")).alias("below"))
    weight = F.try_divide(F.lit(1 - p_target), (F.col("n_langs") - 1) if not open_set else F.col("n_langs"))
    part = F.when(F.col("lang") == F.col("utt_lang"), p_target * F.col("below")).otherwise(weight * (1 - F.col("below")))
    costs = rates.groupBy("step", "n_langs").agg((F.sum(part) / F.first("n_langs")).alias("cost"))
    return costs.agg(F.min("cost").alias("cavg"))


def min_tdcf(asv: DataFrame, cm: DataFrame, priors: tuple[float, float, float] = (0.9405, 0.0095, 0.05), costs: tuple[float, float, float, float] = (1, 10, 1, 10)) -> DataFrame:
    """Minimum tandem detection cost (M7). asv: kind (target, nontarget, spoof), score; cm: target (bona fide), score."""
    p_tar, p_non, p_spoof = priors
    miss_asv, fa_asv, miss_cm, fa_cm = costs
    t = eer(asv.where("kind <> 'spoof'").withColumn("target", F.col("kind") == "target")).select("threshold")
    below = (F.col("score") < F.col("threshold")).cast("double")
    rate = lambda kind, x: F.avg(F.when(F.col("kind") == kind, x))
    rates = asv.join(F.broadcast(t)).agg(rate("target", below).alias("miss"), rate("nontarget", 1 - below).alias("fa"), rate("spoof", below).alias("miss_spoof"))  # t: one row
    c1 = p_tar * (miss_cm - miss_asv * F.col("miss")) - p_non * fa_asv * F.col("fa")
    c2 = fa_cm * p_spoof * (1 - F.col("miss_spoof"))
    beta = rates.select(F.try_divide(c1, c2).alias("beta"))
    curve = det_points(cm).select("far", "frr").unionByName(cm.sparkSession.createDataFrame([(0.0, 1.0)], "far double, frr double"))
    return curve.join(F.broadcast(beta)).agg(F.min(F.col("beta") * F.col("frr") + F.col("far")).alias("min_tdcf"))


def mean_precision(ranking: DataFrame, query: str, rank: str, hit: Column, depth: int = 10, at_hits: bool = False) -> DataFrame:
    """Mean over queries of the precision at each rank up to depth, over depth (M8, W5); with at_hits the usual average precision."""
    seen = F.sum(hit.cast("int")).over(Window.partitionBy(query).orderBy(rank))
    rows = ranking.where(F.col(rank) <= depth).withColumn("__p", seen / F.col(rank)).withColumn("__hit", hit.cast("int"))
    if at_hits:
        per = rows.groupBy(query).agg((F.sum(F.col("__p") * F.col("__hit")) / F.greatest(F.sum("__hit"), F.lit(1))).alias("ap"))
    else:
        per = rows.groupBy(query).agg((F.sum("__p") / depth).alias("ap"))
    return per.agg(F.avg("ap").alias("map"))


def accuracy(rows: DataFrame, predicted: str, actual: str, weight: Column | None = None) -> DataFrame:
    """Share of right predictions, weighted if asked for."""
    w = F.lit(1.0) if weight is None else weight
    right = (F.col(predicted) == F.col(actual)).cast("double")
    return rows.agg((F.sum(right * w) / F.sum(w)).alias("accuracy"))
