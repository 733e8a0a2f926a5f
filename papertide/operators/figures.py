"""Figures of people and institutions from printed authors: who was judged, with whom they write, scores by field, and the orders of tables.

printed: paper, position, person or name, aff (null where the paper prints none), places and said (see places.with_institutions)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.functions import labels, places
from papertide.functions.runtime import kept, spread
from papertide.operators.aggregates import NEGATIVE, accepted, count_if
from papertide.operators.people import histogram
from papertide.operators.spellings import distinct_people


def full_tally(record: DataFrame, people: DataFrame, venue: DataFrame) -> DataFrame:
    """Counts for each person and venue, zero where there is no record. record: person, venue, status, unofficial. people: person; venue: venue, few."""
    states = [count_if(F.col("status") == s).alias(s) for s in ("accepted", *NEGATIVE)]
    sums = record.groupBy("person", "venue").agg(
        *states, count_if(F.col("status").isin(*NEGATIVE)).alias("not_accepted"), F.count(F.lit(1)).alias("submitted"),
        count_if(accepted() & F.col("unofficial")).alias("own_page"), count_if(accepted() & ~F.col("unofficial")).alias("official"),
    )
    grid = people.select("person").distinct().crossJoin(venue.select("venue").distinct())  # venues are a dozen
    return grid.join(sums, ["person", "venue"], "left").fillna(0)


def flagged_summary(record: DataFrame, coverage: DataFrame, counts_from: int) -> DataFrame:
    """Every year and venue with counts and whether its list is available and provisional, the venue is held, and the year counts. record: venue, year, status, unofficial.
    coverage: venue, year, papers, provisional."""
    grid = coverage.select("year").distinct().crossJoin(coverage.select("venue").distinct())  # years times venues: two small domains
    sums = record.groupBy("venue", "year").agg(count_if(accepted()).alias("accepted"), count_if(accepted() & F.col("unofficial")).alias("own_page"), F.count(F.lit(1)).alias("submitted"))
    out = grid.join(coverage, ["venue", "year"], "left").join(sums, ["venue", "year"], "left").fillna(0, ["accepted", "own_page", "submitted"])
    return out.select(
        "venue", "year", "accepted", "own_page", (F.col("accepted") - F.col("own_page")).alias("official"), "submitted",
        (F.coalesce("papers", F.lit(0)) > 0).alias("available"), labels.held(F.col("venue"), F.col("year")).alias("held"), F.coalesce("provisional", F.lit(False)).alias("provisional"), (F.col("year") >= counts_from).alias("counts"),
    )


def judged(printed: DataFrame, owned: DataFrame) -> DataFrame:
    """paper, short, known, majority and first_author of each paper of an institution: whether it prints any affiliation, most authors are at the institution, and the first one is.
    owned: paper, institution, named (see places.with_names), short."""
    # What an affiliation is to an institution is found once for both, so that authors do not meet all institutions of their paper.
    own, said = owned.select("institution", "named", "short").distinct(), printed.where("aff is not null").groupBy("aff").agg(F.first("places").alias("places"), F.first("said").alias("said"))
    same = kept(said.crossJoin(own).where(places.same_institution(*map(F.col, ("places", "said", "institution", "named", "short")))).select("aff", "institution", "short"))  # different affiliations times institutions
    size = printed.groupBy("paper").agg((F.count("aff") > 0).alias("known"), F.count(F.lit(1)).alias("n"))
    home = printed.select("paper", "position", "aff").join(same, "aff").select("paper", "institution", "short", F.lit(0).alias("own"), F.lit(1).alias("home"), (F.col("position") == 1).cast("int").alias("first"))
    rows = owned.select("paper", "institution", "short", F.lit(1).alias("own"), F.lit(0).alias("home"), F.lit(0).alias("first")).union(home)
    # Names of institutions take few bytes in a shuffle and many in memory. Both groupings are parts of a paper's rows.
    each = spread(rows, "paper").groupBy("paper", "institution", "short").agg(*(F.sum(c).alias(c) for c in ("own", "home", "first"))).where("own > 0")
    # Several institutions of one short name count together.
    sums = each.groupBy("paper", "short").agg(F.sum(F.col("own") * F.col("home")).alias("home"), F.sum(F.col("own") * F.col("first")).alias("first"), F.sum("own").alias("times"))
    return sums.join(size, "paper").select("paper", "short", "known", (2 * F.col("home") > F.col("n") * F.col("times")).alias("majority"), (F.col("first") > 0).alias("first_author"))


def authorship(judgement: DataFrame, paper: DataFrame, *keys: str) -> DataFrame:
    """Accepted papers, those judged and unknown, and of those judged the ones written mostly, and first, at home."""
    rows = paper.where(accepted()).join(judgement, "paper")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("accepted"), count_if(F.col("known")).alias("judged"), count_if(~F.col("known")).alias("unknown"),
        count_if(F.col("known") & F.col("majority")).alias("majority"), count_if(F.col("known") & F.col("first_author")).alias("first_author"),
    )


def collaboration(own: DataFrame, roster: DataFrame, printed: DataFrame, known: DataFrame, paper: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """Co-author figures of each person over their papers.

    own: person, paper, position (null where they are not found). roster: person, institution, named (see places.with_names), short. printed: paper, position, name (normalised), seq and aff of
    each author, read several times. known: see places.known_institutions. key: gives the key of the column of names. A paper without the person counts one author less. Means by
    institution use papers on which the person is found and some affiliation is printed; the minimum is over accepted papers. Spellings of a co-author are one person (see
    spellings.distinct_people), and a paper's affiliations are those of whichever spelling it prints.
    """
    # Names, affiliations and institutions are numbered, and what an affiliation is to an institution is found once for both: pairs of authors are many times more than all of these.
    number = lambda frame, into: kept(frame.withColumn(into, F.monotonically_increasing_id()))
    form = number(printed.where("name is not null").select("name").distinct().withColumn("key", key("name")), "form")
    kind, at = number(known, "kind"), number(roster.select("institution", "named", "short").distinct(), "at")
    same = kind.crossJoin(at).withColumn("same", places.same_institution(*map(F.col, ("places", "said", "institution", "named", "short"))))
    same = kept(same.where("same or same is null").select("kind", "at", "same", F.lit(True).alias("met")))
    of = at.withColumnsRenamed({c: f"of_{c}" for c in ("institution", "named", "short")})
    place = roster.join(of, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("institution", "named", "short")))).select("person", "at")
    size = printed.groupBy("paper").agg(F.count(F.lit(1)).alias("n"), (F.count("aff") > 0).alias("known"))
    each = kept(own.select("person", "paper", "position").join(place, "person").join(size, "paper").join(paper.select("paper", "status"), "paper").withColumn("others", F.greatest(F.col("n") - 1, F.lit(0))))
    sizes = each.groupBy("person").agg(
        F.count(F.lit(1)).alias("papers"), F.round(F.avg("others"), 6).alias("mean_coauthors"), F.min(F.when(accepted(), F.col("others"))).alias("min_coauthors"), F.max("others").alias("max_coauthors"),
        count_if(F.col("known") & F.col("position").isNotNull()).alias("with_affiliations"),
    )
    line = printed.join(form.select("name", "form"), "name").join(kind.select("aff", "kind", (F.size("places") > 0).alias("home")), "aff", "left").select("paper", "position", "form", "seq", "kind", F.coalesce("home", F.lit(False)).alias("home"))
    pair = each.where("position is not null").select("person", "paper", "known", "at", F.col("position").alias("me")).join(line, "paper").where("position <> me").join(same, ["kind", "at"], "left")
    home, said, same_ = F.col("home"), F.col("kind").isNotNull(), F.when(F.col("met").isNull(), F.lit(False)).otherwise(F.col("same"))
    flags = {"foreign": said & ~home, "same": said & same_, "elsewhere": said & ~same_, "domestic": home, "other_home": home & ~same_}
    pair = pair.select("person", "form", "seq", "known", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))
    # What a person's papers say of a spelling is counted before anything else: one row for each, however many papers they share.
    spelled = kept(pair.groupBy("person", "form").agg(
        F.min("seq").alias("seq"), *(count_if(F.col("known") & F.col(k)).alias(f"n_{k}") for k in flags), F.max(F.col("known") & F.col("foreign")).alias("abroad"), F.max(F.col("known") & F.col("elsewhere")).alias("away"),
    ))
    sums = spelled.groupBy("person").agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in flags))
    people = distinct_people(spelled.join(form, "form").select("person", "name", "key", "seq"), "person").join(form.select("name", "form"), "name").select("person", "form", "who")
    who = spelled.join(people, ["person", "form"]).groupBy("person", "who").agg(F.max("abroad").alias("abroad"), F.max("away").alias("away"))
    sets = who.groupBy("person").agg(F.count(F.lit(1)).alias("distinct_coauthors"), count_if(F.col("away")).alias("elsewhere"), count_if(F.col("away") & F.col("abroad")).alias("elsewhere_abroad"), count_if(F.col("away") & ~F.col("abroad")).alias("elsewhere_home"))
    out = sizes.join(sums, "person", "left").join(sets, "person", "left")
    means = [F.round(F.coalesce(f"n_{k}", F.lit(0)) / F.nullif("with_affiliations", F.lit(0)), 6).alias(f"mean_{k}") for k in flags]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("distinct_coauthors", "elsewhere", "elsewhere_abroad", "elsewhere_home")]
    return out.select("person", "papers", "mean_coauthors", "min_coauthors", "max_coauthors", "with_affiliations", *counts, *means)


def field_credit(credit: DataFrame, fields: int) -> DataFrame:
    """institution and score: credits of people by field rounded to 4 places, their sums to 2, and the geometric mean of (sum + 1) over all fields to 2. A field without credit
    contributes 1. credit: institution, person, field, x."""
    one = credit.groupBy("institution", "person", "field").agg(F.bround(F.sum("x"), 4).alias("x"))
    area = one.groupBy("institution", "field").agg(F.bround(F.sum("x"), 2).alias("x"))
    return area.groupBy("institution").agg(F.bround(F.pow(F.product(F.col("x") + 1), F.lit(1 / fields)), 2).alias("score"))


def text_shares(record: DataFrame, score: DataFrame) -> DataFrame:
    """slug, average share (one decimal) and number of a person's scanned papers, each once. record: slug, key. score: key, pct."""
    return record.select("slug", "key").distinct().join(score, "key").groupBy("slug").agg(F.bround(F.avg("pct"), 1).alias("avg_share"), F.count(F.lit(1)).alias("scanned"))


def flagged_share(token: DataFrame, threshold: float, least: int = 8) -> DataFrame:
    """doc_id, sentences judged, flagged ones and their share (one decimal): a sentence is judged with at least so many tokens, and flagged where their mean score is above the
    threshold. token: doc_id, sentence, score."""
    each = token.groupBy("doc_id", "sentence").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    sums = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), count_if(F.col("mean") > threshold).alias("flagged"))
    return sums.withColumn("pct", F.bround(100 * F.col("flagged") / F.col("sentences"), 1))


def person_totals(projected: DataFrame) -> DataFrame:
    """person, accepted, recorded and estimated rejections, total and rate that agree when rounded: the estimate is what the rounded sum leaves. projected: person, accepted, known,
    estimated of each year that counts."""
    sums = projected.groupBy("person").agg(F.sum("accepted").alias("accepted"), F.sum("known").alias("recorded"), F.sum(F.col("known") + F.bround("estimated", 0)).alias("r"))
    whole = F.bround("r", 0).cast("long")
    total = F.col("accepted") + whole
    return sums.select("person", "accepted", "recorded", (whole - F.col("recorded")).alias("estimated"), whole.alias("rejected_estimated"), total.alias("total"), F.when(total > 0, F.bround(100 * F.col("accepted") / total, 0)).cast("long").alias("rate"))


def institution_totals(paper: DataFrame) -> DataFrame:
    """institution, accepted, rejected_estimated, rate and trivial from its own pooled record. paper: institution, paper (each once), status, full."""
    taken, full = accepted(), F.col("full")
    s = paper.groupBy("institution").agg(
        count_if(taken).alias("accepted"), count_if(full).alias("s"), count_if(full & taken).alias("a"), count_if(full & ~taken).alias("na"), count_if(~full & ~taken).alias("other"), count_if(~full & taken).alias("elsewhere")
    )
    hidden = F.greatest(F.col("elsewhere") * ((F.col("s") + 1) / (F.col("a") + 1) - 1) - F.col("other"), F.lit(0.0))
    some = (F.col("accepted") > 0) | (F.col("s") > 0) | (F.col("other") > 0)
    out = s.withColumn("rejected_estimated", F.when(some, F.bround(F.col("na") + F.col("other") + hidden, 0)).cast("long"))
    total = F.col("accepted") + F.coalesce("rejected_estimated", F.lit(0))
    return out.select("institution", "accepted", "rejected_estimated", F.when(F.col("rejected_estimated").isNotNull() & (total > 0), F.bround(100 * F.col("accepted") / total, 0)).cast("long").alias("rate"), (F.col("s") == 0).alias("trivial"))


def foreign_coauthors(printed: DataFrame, owner: DataFrame, roster: DataFrame, above: int = 4, shown: int = 5) -> DataFrame:
    """People who print affiliations, none of them at home, on more than `above` papers: name, commonest affiliation, papers, people they write with and the first few of these.

    printed as above, with name, key and seq. owner: paper, who. roster: name. Names are those first seen for a key; commonest first, ties by what is seen first."""
    rows = printed.where(F.col("aff").isNotNull() & (F.size("places") == 0)).join(roster.select("name").distinct(), "name", "left_anti")
    figures = rows.groupBy("key").agg(F.count(F.lit(1)).alias("papers"), F.min_by("name", "seq").alias("name")).where(F.col("papers") > above)
    partner = rows.join(figures.select("key"), "key", "left_semi").join(owner, "paper").withColumn("at", F.struct("seq", "who"))
    partners = histogram(partner, "key", "who", "at", "partners")
    out = figures.join(histogram(rows, "key", "aff", "seq", "affs"), "key").join(partners, "key", "left")
    few = F.array_join(F.transform(F.slice("partners", 1, shown), lambda x: x["value"]), ", ")
    return out.select(
        "name", F.col("affs")[0]["value"].alias("affiliation"), "papers", F.coalesce(F.size("partners"), F.lit(0)).cast("long").alias("partners"),
        F.coalesce(F.when(F.size("partners") > shown, F.concat(few, F.lit(", ..."))).otherwise(few), F.lit("")).alias("with_names"),
    )
