"""Estimates of submissions that are not on record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.operators.aggregates import NEGATIVE, accepted, count_if, smoothed_ratio


def _ratios(member: DataFrame, paper: DataFrame) -> DataFrame:
    own = member.join(paper.where("full"), "paper").groupBy("person").agg(F.count(F.lit(1)).alias("submitted"), count_if(accepted()).alias("taken"))
    return own.select("person", smoothed_ratio(F.col("submitted"), F.col("taken")).alias("ratio"))


def project(member: DataFrame, paper: DataFrame, person: DataFrame) -> DataFrame:
    """For each person and year since their move: accepted, known rejections, and the estimated rest, from the person's own ratio where all
    submissions are public. Rejections on record are not estimated a second time."""
    rows = member.join(paper, "paper").join(person.select("person", "since"), "person").where(F.col("since").isNull() | (F.col("year") >= F.col("since")))
    negative = F.col("status").isin(*NEGATIVE)
    year = rows.groupBy("person", "year").agg(
        count_if(accepted()).alias("accepted"), count_if(negative).alias("known"), count_if(negative & ~F.col("full")).alias("other"), count_if(accepted() & ~F.col("full")).alias("elsewhere")
    )
    out = year.join(_ratios(member, paper), "person", "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    estimated = F.greatest(F.col("elsewhere") * (F.col("ratio") - 1) - F.col("other"), F.lit(0.0))
    return out.select("person", "year", "accepted", "known", F.round(estimated, 6).alias("estimated"), F.round(F.col("accepted") + F.col("known") + estimated, 6).alias("total"))


def overview(projected: DataFrame) -> DataFrame:
    """Yearly sums of the persons' figures, each rounded (half to even) before it is summed, as the figures shown are."""
    return projected.groupBy("year").agg(F.sum("accepted").alias("accepted"), F.sum("known").alias("known"), F.sum(F.bround("estimated", 0)).cast("long").alias("estimated"))


def institution_estimate(member: DataFrame, paper: DataFrame, person: DataFrame) -> DataFrame:
    """Each institution's hidden rejections from its own pooled record, over the distinct papers of its people."""
    own = member.join(person.select("person", "institution"), "person").select("institution", "paper").distinct().join(paper, "paper")
    negative = F.col("status").isin(*NEGATIVE)
    sums = own.groupBy("institution").agg(
        count_if(F.col("full")).alias("s"), count_if(F.col("full") & accepted()).alias("a"), count_if(accepted()).alias("accepted"), count_if(negative).alias("known"), count_if(negative & ~F.col("full")).alias("other"), count_if(accepted() & ~F.col("full")).alias("elsewhere")
    )
    estimated = F.greatest(F.col("elsewhere") * (smoothed_ratio(F.col("s"), F.col("a")) - 1) - F.col("other"), F.lit(0.0))
    total = F.col("accepted") + F.col("known") + estimated
    return sums.select("institution", "accepted", "known", F.round(estimated, 6).alias("estimated"), F.round(F.when(total > 0, 100 * F.col("accepted") / total), 6).alias("rate"))


def venue_estimate(member: DataFrame, paper: DataFrame) -> DataFrame:
    """For each venue but the full-record one: rejections hidden behind accepted papers, by the mean ratio of their authors less one."""
    each = member.join(_ratios(member, paper), "person").groupBy("paper").agg(F.avg("ratio").alias("mean"))
    rows = paper.where(~F.col("full")).join(each, "paper", "left")
    sums = rows.groupBy("venue").agg(
        F.coalesce(F.sum(F.when(accepted(), F.col("mean") - 1)), F.lit(0.0)).alias("hidden"), count_if(accepted() & F.col("mean").isNotNull()).alias("a"), count_if(~accepted() & F.col("mean").isNotNull()).alias("r"), count_if(~accepted()).alias("rejected")
    )
    extra = F.greatest(F.col("hidden") - F.col("r"), F.lit(0.0))
    return sums.select("venue", "rejected", F.round(extra, 6).alias("extra"), F.round(F.when(F.col("a") > 0, 100 * F.col("a") / (F.col("a") + F.col("r") + extra)), 6).alias("rate"))


def shrunk_year(member: DataFrame, paper: DataFrame, year: int, k: int = 2) -> DataFrame:
    """Projected accepted and rejected papers of a year under review. A withdrawn paper stands for one over the withdrawal share of its known
    authors (three years before), taken at their acceptance rate (year before); both are pulled to the pool by k papers. The pool counts papers once,
    the records once for each author."""
    full = paper.where("full")
    past = (F.col("year") >= year - 3) & (F.col("year") < year)
    pool = full.agg(
        (count_if(past & (F.col("status") == "withdrawn")) / count_if(past)).alias("f0"), (count_if((F.col("year") == year - 1) & accepted()) / count_if(F.col("year") == year - 1)).alias("a0")
    )
    rows = member.join(full, "paper")
    own = rows.groupBy("person").agg(
        count_if(past).alias("ws"), count_if(past & (F.col("status") == "withdrawn")).alias("w"), count_if(F.col("year") == year - 1).alias("s"), count_if((F.col("year") == year - 1) & accepted()).alias("a")
    )
    record = own.where("s > 0").crossJoin(F.broadcast(pool))  # the pool is one row
    record = record.select("person", ((F.col("w") + k * F.col("f0")) / (F.col("ws") + k)).alias("share"), ((F.col("a") + k * F.col("a0")) / (F.col("s") + k)).alias("rate"))
    due = full.where((F.col("year") == year) & F.col("status").isin(*NEGATIVE))
    known = member.join(record, "person").groupBy("paper").agg(F.avg("share").alias("share"), F.avg("rate").alias("rate"))
    met = due.join(known, "paper", "left").withColumn("counts", (F.col("status") == "withdrawn") & F.col("share").isNotNull())
    return met.agg(
        F.round(F.coalesce(F.sum(F.when(F.col("counts"), F.col("rate") / F.col("share"))), F.lit(0.0)), 6).alias("accepted"),
        F.round(F.coalesce(F.sum(F.when(F.col("counts"), (1 - F.col("rate")) / F.col("share")).otherwise(1.0)), F.lit(0.0)), 6).alias("rejected"),
    )
