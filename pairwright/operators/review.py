"""Merging a judge's verdicts into labels, and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions import policy
from pairwright.operators.reports import last_per


def merge_verdicts(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Label rows with the judge's reasons added; a row without a verdict stays as it is.

    ``verdicts``: trace_id, has_hallucinations, has_awkward_language, overall_quality_score, recommendations, red_flags,
    judge_error; one row a trace id. Scores are tested before they are rounded.
    """
    v = verdicts.select("trace_id", "has_hallucinations", "has_awkward_language", "overall_quality_score", F.size("recommendations").alias("n_rec"), F.size("red_flags").alias("n_red"), "judge_error", F.lit(True).alias("judged"))
    joined = labels.join(v, "trace_id", "left")
    fine = F.col("judged") & F.col("judge_error").isNull()
    flagged = F.col("has_hallucinations") | F.col("has_awkward_language") | (F.col("n_red") > 0) | (F.col("overall_quality_score") < policy.JUDGE_FLAG_BELOW)
    wanted = (F.col("n_rec") > 0) & (F.col("overall_quality_score") < policy.JUDGE_RECOMMEND_BELOW)
    more = F.array_compact(F.array(F.when(F.col("judge_error").isNotNull(), "llm_judge_error"), F.when(fine & flagged, "llm_judge_flagged"), F.when(fine & wanted, "llm_judge_recommendation")))
    codes = F.concat("review_reason_codes", more)
    return joined.withColumn("review_reason_codes", codes).withColumn("requires_human_review", F.col("requires_human_review") | (F.size("review_reason_codes") > 0)).select(*labels.columns)


def review_queue(labels: DataFrame, adjudications: DataFrame, verdicts: DataFrame, seq: str = "seq") -> DataFrame:
    """Flagged labels, and verdicts that recommend something for pairs that aren't flagged.

    Labels and adjudications count once for each trace id, the last by ``seq``; flagged labels take the last verdict;
    each recommending verdict of other pairs makes a row, repeats included. Rows without an entry elsewhere have nulls.
    All joins are on trace_id, so one shuffle of each input serves them.
    """
    by = [seq]
    label = last_per(labels, ["trace_id"], by).select("trace_id", "requires_human_review", "review_reason_codes", "computed_fit_label")
    adjudicated = last_per(adjudications, ["trace_id"], by).select("trace_id", "adjudicated_fit_label")
    verdict = verdicts.select("trace_id", seq, F.col("overall_quality_score").alias("judge_overall_quality_score"), F.col("recommendations").alias("judge_recommendations"), F.col("red_flags").alias("judge_red_flags"), "judge_error")
    empty = F.array().cast("array<string>")
    shape = ["trace_id", "queue_reason", "requires_human_review", "review_reason_codes", "computed_fit_label", "adjudicated_fit_label", "judge_overall_quality_score", "judge_recommendations", "judge_red_flags"]
    flagged = label.where("requires_human_review")
    first = flagged.join(adjudicated, "trace_id", "left").join(last_per(verdict, ["trace_id"], by), "trace_id", "left")
    first = first.withColumns({"queue_reason": F.lit("human_review_flag"), "judge_recommendations": F.coalesce("judge_recommendations", empty), "judge_red_flags": F.coalesce("judge_red_flags", empty)}).select(*shape)
    rest = verdict.where(F.col("judge_error").isNull() & (F.size("judge_recommendations") > 0)).join(flagged.select("trace_id"), "trace_id", "left_anti")
    second = rest.join(label, "trace_id", "left").join(adjudicated, "trace_id", "left")
    second = second.withColumns({"queue_reason": F.lit("recommendation_only"), "requires_human_review": F.coalesce("requires_human_review", F.lit(False)), "review_reason_codes": F.coalesce("review_reason_codes", empty)}).select(*shape)
    return first.unionByName(second)


def queue_counts(queue: DataFrame) -> DataFrame:
    """(queue_reason, n, n_review) of the queue."""
    return queue.groupBy("queue_reason").agg(F.count("*").alias("n"), F.count_if(F.col("requires_human_review")).alias("n_review"))


def recommendation_openings(queue: DataFrame, top: int = 5, tracked: int = 10_000, listed: int = 100) -> DataFrame:
    """The most frequent openings of recommendations: up to the first full stop, at most 80 characters; ties by text."""
    each = queue.select(F.explode("judge_recommendations").alias("r")).select(F.regexp_replace("r", r"(?U)^\s+|\s+$", "").alias("r")).where("r <> ''")
    return most_frequent(each.select(F.substring(F.substring_index("r", ".", 1), 1, 80).alias("text")), top, tracked, listed)


def most_frequent(texts: DataFrame, top: int, tracked: int = 10_000, listed: int = 100) -> DataFrame:
    """(text, count) of the most frequent values of ``texts`` (text), exactly; ties by text, nulls left out.

    A sketch of ``tracked`` values names ``listed`` candidates, and only these are counted, so that different texts aren't
    shuffled. The sketch errs by at most 3.5 counts in ``tracked``: where the last of the top isn't above what a text that isn't
    listed may have, all are counted.
    """
    texts = texts.where("text is not null")
    found = texts.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(text, {listed}, {tracked})").alias("k")).collect()[0]
    slack = 3.5 * found["n"] / tracked
    unlisted = slack + (min(x["count"] for x in found["k"]) if len(found["k"]) == listed else 0)
    names = texts.sparkSession.createDataFrame([(x["item"],) for x in found["k"]], "text string")  # as many as are listed
    order = [F.desc("count"), "text"]
    known = texts.join(F.broadcast(names), "text", "left_semi").groupBy("text").count().orderBy(*order).limit(top)
    last = known.agg(F.count("*").alias("n"), F.min("count").alias("c")).collect()[0]
    sure = (last["n"] == top and last["c"] > unlisted) or (found["n"] <= tracked and len(found["k"]) < listed and slack < 1)
    return known if sure else texts.groupBy("text").count().orderBy(*order).limit(top)
