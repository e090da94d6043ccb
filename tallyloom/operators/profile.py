"""Profiles of a scored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.failures import error_kind
from tallyloom.functions.text import half_up

from .cards import score_band


def corpus_stats(summary: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    return summary.agg(
        F.count("*").alias("cards"), F.count("score").alias("scored"), half_up(F.avg("score")).alias("average"),
        F.count_if(F.col("score").isNull() & ~failed).alias("unscored"), F.count_if(failed).alias("failed"), F.count_if("stale").alias("stale"),
    )


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count("*").alias("total"), F.count("score").alias("scored"), half_up(F.avg("score"), 2).alias("mean"), F.count("error").alias("failed"),
        half_up(100.0 * F.count("error") / F.greatest(F.count("score") + F.count("error"), F.lit(1))).alias("failed_percent"),
    )


def score_bands(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(score_band(F.col("score"), F.col("error")).alias("band")).agg(F.count("*").alias("n"))


def score_histogram(summary: DataFrame) -> DataFrame:
    """Ten bins, empty ones kept."""
    bins = summary.where("score IS NOT NULL").groupBy(F.least(F.lit(9), F.greatest(F.lit(0), F.floor("score") - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = summary.sparkSession.range(10).select(F.col("id").alias("bin"))
    return every.join(F.broadcast(bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def failure_groups(ledger: DataFrame) -> DataFrame:
    rows = ledger.where("error IS NOT NULL").groupBy(error_kind(F.col("error")).alias("kind"))
    return rows.agg(F.count("*").alias("n"), F.min_by("error", "id").alias("sample"))


def calibration(gaps: DataFrame) -> DataFrame:
    """Agreement of fast and full scores: mean gap, how many are over 1 apart, a verdict and a warning over a fifth."""
    one = gaps.agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.count_if(F.abs("gap") > 1).alias("far"))
    verdict = F.when(F.abs("mean") < 0.15, "agree").when(F.col("mean") > 0, "full higher").otherwise("full lower")
    return one.select("n", half_up(F.col("mean"), 2).alias("mean_gap"), "far", verdict.alias("verdict"), (F.col("far") > 0.2 * F.col("n")).alias("warn"))


def stale_summary(summary: DataFrame) -> DataFrame:
    return summary.where("stale").groupBy("brief").agg(F.count("*").alias("n"))


def library_inventory(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("library_id").agg(F.count("*").alias("entries"), F.count("score").alias("scored"))


def dry_run(work: DataFrame, cards: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: files, cards to score, how many of them a run would take, their tokens, and of the cards without a full critique how many have a fast score or none."""
    run = work if limit is None else work.orderBy("id").limit(limit)
    has = F.col("score").isNotNull()
    backlog = cards.select("id").join(ledger.select("id", "score", "brief"), "id", "left").agg(
        F.count("*").alias("files"), F.count_if(has & F.col("brief")).alias("fast_scored"), F.count_if(~has).alias("unscored")
    )
    planned = run.agg(F.count("*").alias("running"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return backlog.crossJoin(work.agg(F.count("*").alias("todo"))).crossJoin(planned)


def cull_preview(summary: DataFrame) -> DataFrame:
    """Number, score range, first five names and how many more."""
    first = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("id", "name")))), lambda x: x["name"]), 1, 5), ",")
    ranked = summary.orderBy("id").limit(5).select("id", F.lit(1).alias("rank"))
    rows = summary.join(F.broadcast(ranked), "id", "left")
    return rows.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), first.alias("names"), F.greatest(F.lit(0), F.count("*") - 5).alias("more"))
