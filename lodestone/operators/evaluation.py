"""Evaluation analytics over ranked hits and judged answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fixed
from lodestone.session import materialize

# The sweep of thresholds adds its step again and again, so sums carry their rounding.
FIRST_THRESHOLD, THRESHOLD_STEP, THRESHOLDS = 0.40, 0.02, 21
REFUSED_WELL, ANSWERED_BADLY = "từ chối đúng", "PHẢI từ chối nhưng đã trả lời"


def recall_at(hits: DataFrame, ks: Sequence[int] = (1, 3, 5), acceptable: str = "acceptable") -> DataFrame:
    """k, questions, found, recall: the share of questions with an acceptable hit (qid, rank) among the first k."""
    per = hits.groupBy("qid").agg(F.min(F.when(F.col(acceptable), F.col("rank"))).alias("_first"))
    each = per.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "_first")
    found = F.count_if(F.col("_first") <= F.col("k"))
    return each.groupBy("k").agg(F.count("*").alias("questions"), found.alias("found"), F.try_divide(found, F.count("*")).alias("recall"))


def misses(hits: DataFrame, k: int = 5, acceptable: str = "acceptable") -> DataFrame:
    """Each question without an acceptable hit in the first k, with its first hit."""
    found = hits.where(F.col(acceptable) & (F.col("rank") <= k)).select("qid").distinct()
    return hits.where("rank = 1").join(found, "qid", "left_anti").select("qid", "id", "similarity")


#: Quantiles on both sides of the median are taken so exactly, and so far from it, that only about a thousandth of a group lies between.
NEAR_MEDIAN, ACCURACY = 0.0005, 20_000
#: Groups whose bounds are sent to all tasks at most.
SENT_GROUPS = 100_000


def middle_values(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, least, largest, and the two middle values lower and upper, by rank, of each group's values.

    No group is gathered: approximate quantiles bound the median from both sides in one aggregation, values below the
    bounds are counted, and only distinct values between them, with their numbers, are ordered. The bounds are off by less than
    their distance. They are written, and sent to the rows unless there are more than SENT_GROUPS: few groups would bring all rows to few tasks.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(F.col(group).alias("_g"), v.alias("_v"))
    bounds = rows.groupBy(F.col("_g").alias("_of")).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_largest"), F.percentile_approx("_v", [0.5 - NEAR_MEDIAN, 0.5 + NEAR_MEDIAN], ACCURACY).alias("_q"))
    bounds = materialize(bounds)
    bounds = F.broadcast(bounds) if bounds.count() <= SENT_GROUPS else bounds
    near = rows.join(bounds, F.col("_g").eqNullSafe(F.col("_of"))).select("_g", "_v", "_n", "_least", "_largest", F.get("_q", F.lit(0)).alias("_low"), F.get("_q", F.lit(1)).alias("_high"))
    below = near.groupBy(F.col("_g").alias("_b")).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"))
    inside = near.where("_v between _low and _high").groupBy("_g", "_v", "_n", "_least", "_largest").agg(F.count("*").alias("_c"))
    inside = inside.join(below, F.col("_g").eqNullSafe(F.col("_b")))
    end = F.col("_below") + F.sum("_c").over(Window.partitionBy("_g").orderBy("_v"))
    inside = inside.withColumn("_end", end)
    at = lambda k: F.min(F.when(F.col("_end") > k, F.col("_v")))
    found = inside.groupBy("_g", "_n", "_least", "_largest").agg(at(F.floor((F.col("_n") - 1) / 2)).alias("lower"), at(F.floor(F.col("_n") / 2)).alias("upper"))
    return found.select(F.col("_g").alias(group), F.col("_n").alias("n"), F.col("_least").alias("least"), F.col("_largest").alias("largest"), "lower", "upper")


def score_distribution(scores: DataFrame, group: str = "type", score: str = "top_similarity") -> DataFrame:
    """Number, least, upper median (of an even number the upper one) and largest score of each group."""
    return middle_values(scores, group, score).select(group, "n", "least", F.col("upper").alias("median"), "largest")


def score_gap(scores: DataFrame, inside: Column, outside: Column, score: str = "top_similarity", key: str = "qid") -> DataFrame:
    """One row: least score inside less largest outside, whether they are apart, and the questions that set them."""
    s, k = F.col(score), F.col(key)
    low, high = F.min(F.when(inside, F.struct(s.alias("s"), k.alias("k")))), F.max(F.when(outside, F.struct(s.alias("s"), (-k).alias("k"))))
    row = scores.agg(low.alias("_low"), high.alias("_high"))
    return row.select((F.col("_low.s") - F.col("_high.s")).alias("gap"), (F.col("_low.s") > F.col("_high.s")).alias("apart"), F.col("_low.k").alias("lowest_inside"), (-F.col("_high.k")).alias("highest_outside"))


def thresholds(first: float = FIRST_THRESHOLD, step: float = THRESHOLD_STEP, n: int = THRESHOLDS) -> Column:
    """The thresholds as an array, each the one before plus step."""
    more = F.aggregate(F.sequence(F.lit(2), F.lit(n)), F.array(F.lit(first)), lambda a, _: F.concat(a, F.array(F.get(a, F.size(a) - 1) + F.lit(step))))
    return more


def threshold_sweep(scores: DataFrame, score: str = "top_similarity", answerable: str = "answerable", right: str = "right") -> DataFrame:
    """For each threshold how answerable questions (right hit or not) and others fare, and the accuracy.

    correct, wrong and missed are of answerable questions; good_refusal and bad_answer of the rest. Each question gives a
    row for each of the thresholds, which are combined where it is.
    """
    each = scores.select(F.explode(thresholds()).alias("tau"), F.col(score).alias("_s"), F.col(answerable).alias("_a"), F.col(right).alias("_r"))
    passed = F.col("_s") >= F.col("tau")
    count = lambda c, name: F.count_if(c).alias(name)
    table = each.groupBy("tau").agg(
        count(F.col("_a") & passed & F.col("_r"), "correct"),
        count(F.col("_a") & passed & ~F.col("_r"), "wrong"),
        count(F.col("_a") & ~passed, "missed"),
        count(~F.col("_a") & ~passed, "good_refusal"),
        count(~F.col("_a") & passed, "bad_answer"),
        F.count("*").alias("_n"),
    )
    return table.withColumn("accuracy", (F.col("correct") + F.col("good_refusal")) / F.col("_n")).drop("_n")


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """One row: the first threshold of the best accuracy, and the safe one: no wrong answer, most correct, then the least."""
    best = F.max(F.struct("accuracy", (-F.col("tau")).alias("t")))
    # A bad answer is one that should have been refused; a safe threshold has no wrong answers of either kind.
    safe = F.max(F.when((F.col("wrong") == 0) & (F.col("bad_answer") == 0), F.struct("correct", (-F.col("tau")).alias("t"))))
    row = sweep.agg(best.alias("_b"), safe.alias("_s"))
    return row.select((-F.col("_b.t")).alias("best_tau"), F.col("_b.accuracy").alias("best_accuracy"), (-F.col("_s.t")).alias("safe_tau"), F.col("_s.correct").alias("safe_correct"))


def stratified_sample(rows: DataFrame, limit: int, stratum: str = "type", order: str = "pos") -> DataFrame:
    """limit rows in turn from every stratum, in the strata's order: the first of each, the second of each, and so on."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    # no stratum gives more than limit, which Spark applies in each partition before it shuffles
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= limit).orderBy("_nth", stratum).limit(limit).drop("_nth")


def judge(answers: DataFrame) -> DataFrame:
    """answers with ok and reason, by what their question expects.

    Columns: type, refused, top_similarity, cited_sources (array), expect_source, expect_any_source (array). Out-of-scope
    questions must be refused and no others; ambiguous ones cite one of the expected sources, others the expected one.
    A missing expectation is met.
    """
    none = F.array().cast("array<string>")
    cited, any_of = (F.array_sort(F.array_distinct(F.coalesce(c, none))) for c in ("cited_sources", "expect_any_source"))
    quoted = lambda names: F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))
    joined = F.array_join(cited, ", ")
    outside, ambiguous = F.col("type") == "out_of_scope", F.col("type") == "ambiguous"
    any_ok = (F.size(any_of) == 0) | F.arrays_overlap(cited, any_of)
    one_ok = F.coalesce(F.col("expect_source"), F.lit("")).isin("") | F.array_contains(cited, F.col("expect_source"))
    ok = F.when(outside, F.col("refused")).when(F.col("refused"), F.lit(False)).when(ambiguous, any_ok).otherwise(one_ok)
    reason = (
        F.when(outside & F.col("refused"), F.lit(REFUSED_WELL))
        .when(outside, F.lit(ANSWERED_BADLY))
        .when(F.col("refused"), F.format_string("bỏ sót (điểm cao nhất %s < τ)", fixed(F.col("top_similarity"))))
        .when(ambiguous & any_ok, F.concat(F.lit("trích "), F.when(joined == "", "—").otherwise(joined)))
        .when(ambiguous, F.concat(F.lit("trích "), quoted(cited), F.lit(", kỳ vọng một trong "), quoted(any_of)))
        .when(one_ok, F.concat(F.lit("trích "), joined))
        .otherwise(F.concat(F.lit("trích "), quoted(cited), F.lit(", kỳ vọng "), F.col("expect_source")))
    )
    return answers.withColumns({"ok": F.coalesce(ok, F.lit(False)), "reason": reason})


def pass_summary(judged: DataFrame) -> DataFrame:
    """type, passed, total for each type, and for all under a null type."""
    return judged.rollup("type").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def safety_summary(judged: DataFrame) -> DataFrame:
    """One row: answers to out-of-scope questions, flagged answers, entailment runs, graph-expanded questions."""
    return judged.agg(
        F.count_if((F.col("type") == "out_of_scope") & ~F.col("refused")).alias("fabricated"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
        F.count_if("entailment_ran").alias("entailment_ran"),
        F.count_if(F.col("graph_expanded") > 0).alias("graph_expanded"),
    )


def latency_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, n, median (middle two averaged), least and largest of each metric that isn't zero throughout."""
    long = rows.unpivot([], list(metrics), "metric", "value")
    summary = middle_values(long, "metric", "value").select("metric", "n", ((F.col("lower") + F.col("upper")) / 2).alias("median"), "least", "largest")
    return summary.where("least <> 0 or largest <> 0")
