"""Joins that resolve which records belong together."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions.runtime import spread


def later_acceptance(member: DataFrame, paper: DataFrame) -> DataFrame:
    """For each person and paper that was not accepted: the person's earliest accepted paper of the same holder in the same or a later year (ties: venue,
    then id)."""
    hit = F.when(F.col("status") == "accepted", F.struct("year", "venue", F.col("paper").alias("id")))
    # The least acceptance of this year or a later one: a running minimum from the last year back, so that no pairs are made.
    since = Window.partitionBy("person", "holder").orderBy(F.desc("year")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = member.join(paper, "paper").withColumn("hit", F.min(hit).over(since))
    return met.where("status <> 'accepted' and hit is not null").select("person", "paper", F.col("hit.id").alias("later"), F.col("hit.year").alias("later_year"))


def lookup(records: DataFrame, by_id: DataFrame, by_key: DataFrame) -> DataFrame:
    """Each record's official entry: the one with its id if venue and year agree, else the one with its key. records: record, id, key, venue, year;
    by_id: id, venue, year, entry; by_key: key, entry."""
    first = by_id.select("id", F.col("venue").alias("v"), F.col("year").alias("y"), F.col("entry").alias("entry_by_id"))
    second = by_key.select("key", F.col("entry").alias("entry_by_key"))
    met = records.join(first, "id", "left").join(second, "key", "left")
    agrees = (F.col("v") == F.col("venue")) & (F.col("y") == F.col("year"))
    return met.select("record", F.coalesce(F.when(agrees, F.col("entry_by_id")), F.col("entry_by_key")).alias("entry"))


def fill_sequences(target: DataFrame, source: DataFrame) -> DataFrame:
    """Fill a paper's missing values from another list, only where both name the same people in the same order. Both: paper, position, name, value."""
    people = lambda f, name: f.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias(name))
    bare = target.groupBy("paper").agg(F.max("value").alias("m")).where("m is null").select("paper")
    same = people(target, "a").join(people(source, "b"), "paper").where(F.col("a") == F.col("b")).select("paper").join(bare, "paper")
    value = source.join(same, "paper", "left_semi").select("paper", "position", F.col("value").alias("filled"))
    return target.join(value, ["paper", "position"], "left").select("paper", "position", "name", F.coalesce("value", "filled").alias("value"))


def subset_overlap(people: DataFrame, directory: DataFrame) -> DataFrame:
    """The first directory entry (by entry) whose name tokens all occur in the person's and whose place shares a word with theirs. people: person, tokens,
    places; directory: entry, tokens, places. Matches need a common token and a common place, so candidates meet by both: a frequent first name is no group of all who bear it."""
    token = directory.withColumn("token", F.col("tokens")[0]).withColumn("place", F.explode(F.array_distinct("places"))).select("entry", F.col("tokens").alias("t"), "token", "place")
    # People who are alike in both are one, however many they are.
    alike = people.select("tokens", "places").distinct()
    met = alike.withColumn("token", F.explode(F.array_distinct("tokens"))).withColumn("place", F.explode(F.array_distinct("places"))).join(token, ["token", "place"])
    found = met.where(F.size(F.array_except("t", "tokens")) == 0).groupBy("tokens", "places").agg(F.min("entry").alias("entry"))
    return people.join(found, ["tokens", "places"]).groupBy("person").agg(F.min("entry").alias("entry"))


def title_candidates(titles: DataFrame, reach: int = 14, size: int = 1000, threshold: float = 0.9) -> DataFrame:
    """Pairs (title < other) of distinct titles of a block that agree in their first or last `reach` characters, and whose lengths allow the ratio. titles: block, title.

    Titles that share a key are dealt into parts of about `size`, and each two parts meet on their own, so that a common beginning is no group of all its titles. A pair that
    shares both keys comes from the first one only."""
    own = titles.distinct().withColumn("key", F.explode(F.array(F.concat(F.lit("l"), F.left("title", F.lit(reach))), F.concat(F.lit("r"), F.right("title", F.lit(reach))))))
    parts = own.groupBy("block", "key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")).where("parts > 0")
    dealt = own.join(parts, ["block", "key"]).withColumn("part", F.pmod(F.xxhash64("title"), F.col("parts")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "key", "title", "part", "with")
    left = met.select("block", "key", "title", F.col("part").alias("a"), F.col("with").alias("b"))
    right = met.select("block", "key", F.col("title").alias("other"), F.col("with").alias("a"), F.col("part").alias("b"))
    pairs = left.join(right, ["block", "key", "a", "b"]).where("title < other")
    x, y = F.char_length("title"), F.char_length("other")
    both = F.startswith("key", F.lit("r")) & (F.left("title", F.lit(reach)) == F.left("other", F.lit(reach)))
    return pairs.where(~both & (2 * F.least(x, y) >= threshold * (x + y) - 1e-9)).select("block", "title", "other")


def most_ratio(a: pd.Series, b: pd.Series) -> np.ndarray:
    """The greatest similarity ratio that the letters of two texts allow in any order. Bytes beyond ASCII share a place, which can only raise it."""
    codes, texts = pd.factorize(pd.concat([a, b], ignore_index=True))
    counts = np.stack([np.bincount(np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 128), minlength=129) for t in texts]).astype(np.int32) if len(texts) else np.zeros((0, 129), np.int32)
    x, y = counts[codes[: len(a)]], counts[codes[len(a) :]]
    return 2 * np.minimum(x, y).sum(axis=1) / np.maximum(x.sum(axis=1) + y.sum(axis=1), 1)


def similar_titles(titles: DataFrame, threshold: float = 0.9, reach: int = 14) -> DataFrame:
    """The title_candidates() whose similarity ratio reaches the threshold. Pairs whose letters cannot reach it in any order go first, a batch at a time; the ratios of the others are dealt out by
    pairs, as they take longest."""
    pairs = title_candidates(titles, reach, threshold=threshold)

    @F.pandas_udf("boolean")
    def reachable(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(most_ratio(a, b) >= threshold - 1e-6)

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    pairs = spread(pairs.where(reachable("title", "other")), "title", "other")
    return pairs.withColumn("ratio", F.round(ratio("title", "other"), 6)).where(F.col("ratio") >= threshold)


def merge_best(rows: DataFrame, key: list[str], rank: str, seq: str) -> DataFrame:
    """One row per key: the best rank, the first of equals by seq (a number), with how many there were. Rows are combined before they are shuffled."""
    row = F.struct(*(c for c in rows.columns if c not in key))
    best = rows.groupBy(*key).agg(F.max_by(row, F.struct(F.col(rank).alias("rank"), (-F.col(seq)).alias("seq"))).alias("r"), F.count(F.lit(1)).alias("n_merged"))
    return best.select(*key, "r.*", "n_merged")
