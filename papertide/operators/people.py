"""Whose papers are whose: indexes of the lists, notes and pages that name several people, links of authors to people, and people found or missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions.runtime import kept

#: Qualities of a match with a faculty page, best first.
QUALITY = ("exact", "likely", "possible")


def title_index(entry: DataFrame) -> DataFrame:
    """venue, year, title_key and the entry that stands for them: the last one of the main track, else the first. entry: entry (in list order), venue, year, track, title_key."""
    main = F.max(F.when(F.col("track") == "main", F.col("entry")))
    return entry.groupBy("venue", "year", "title_key").agg(F.coalesce(main, F.min("entry")).alias("entry"))


def forum_index(entry: DataFrame) -> DataFrame:
    """forum, venue, year and the last entry of each forum."""
    return entry.where("forum <> ''").groupBy("forum").agg(F.max_by(F.struct("entry", "venue", "year"), "entry").alias("r")).select("forum", "r.*")


def official(records: DataFrame, entry: DataFrame) -> DataFrame:
    """The records with the list entry of their forum where it is of their venue and year, else that of their title. records: venue, year, title_key, forum."""
    by_forum = forum_index(entry).select("forum", "venue", "year", F.col("entry").alias("of_forum"))
    by_title = title_index(entry).withColumnRenamed("entry", "of_title")
    found = records.join(by_forum, ["forum", "venue", "year"], "left").join(by_title, ["venue", "year", "title_key"], "left")
    return found.withColumn("entry", F.coalesce("of_forum", "of_title")).drop("of_forum", "of_title")


def by_author(author: DataFrame, person: DataFrame) -> DataFrame:
    """slug, entry and position of the list authors whose name is one of a person's. author: entry, position, name_norm; person: slug, variants."""
    named = person.select("slug", F.explode("variants").alias("name_norm")).distinct()
    return author.join(named, "name_norm").select("slug", "entry", "position")


def shared_notes(note: DataFrame, person: DataFrame) -> DataFrame:
    """slug, note, owner and exact of submissions in one person's record that list another: by id (exact), or by name where not both sides have ids.

    note: owner, note, ids and names (arrays; names normalised). person: slug, ids, variants. Ids and names meet in equal joins, so nobody is compared with everybody.
    """
    known = person.select("slug", F.explode("ids").alias("id")).distinct()
    exact = note.select("note", "owner", F.explode("ids").alias("id")).join(known, "id").where("slug <> owner").select("slug", "note", "owner", F.lit(True).alias("exact"))
    called = person.select("slug", (F.size("ids") > 0).alias("has_ids"), F.explode("variants").alias("name")).distinct()
    named = note.select("note", "owner", (F.size("ids") > 0).alias("note_ids"), F.explode("names").alias("name")).join(called, "name").where("slug <> owner")
    loose = named.where("not (has_ids and note_ids)").select("slug", "note", "owner", F.lit(False).alias("exact"))
    return exact.union(loose).groupBy("slug", "note", "owner").agg(F.max("exact").alias("exact"))


def self_reported(page: DataFrame, person: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers from people's own pages, and totals that pages announce without titles.

    Papers: slug, owner, row, venue, year, title, track, role: under the page's owner, and under every other approved person whom it names as co-author. page: row,
    professor, venue, year (text), title, track, coauthors (array of normalised names), announced (text). person: slug, approved, variants. Rows of unknown people, and those
    whose year is no number, are left out.
    """
    rows = page.where(F.col("year").rlike("^[0-9]+$")).join(person.select(F.col("slug").alias("professor")), "professor", "left_semi")
    rows = rows.withColumn("year", F.col("year").cast("int")).withColumn("track", F.coalesce(F.nullif(F.trim("track"), F.lit("")), F.lit("main")))
    titled = rows.where(F.coalesce(F.trim("title"), F.lit("")) != "")
    own = titled.select(F.col("professor").alias("slug"), F.col("professor").alias("owner"), "row", "venue", "year", "title", "track", F.lit("own").alias("role"))
    # One variant means one person: the last of the roster's order, here the greatest slug.
    named = person.where("approved").select("slug", F.explode("variants").alias("coauthor")).groupBy("coauthor").agg(F.max("slug").alias("slug"))
    others = titled.select(F.col("professor").alias("owner"), "row", "venue", "year", "title", "track", F.explode("coauthors").alias("coauthor")).join(named, "coauthor").where("slug <> owner")
    others = others.select("slug", "owner", "row", "venue", "year", "title", "track", F.lit("coauthor").alias("role")).distinct()
    bare = rows.where((F.coalesce(F.trim("title"), F.lit("")) == "") & F.trim("announced").rlike("^[0-9]+$"))
    totals = bare.groupBy(F.col("professor").alias("slug"), "venue", "year").agg(F.max_by(F.trim("announced").cast("int"), "row").alias("announced"))
    return own.union(others), totals


def short_of_announced(totals: DataFrame, accepted: DataFrame) -> DataFrame:
    """slug, venue, year, announced and identified where a page announces more papers than are identified. accepted: slug, venue, year, one row for each paper."""
    counted = accepted.groupBy("slug", "venue", "year").agg(F.count(F.lit(1)).alias("n"))
    both = totals.join(counted, ["slug", "venue", "year"], "left").select("slug", "venue", "year", F.col("announced").cast("long").alias("announced"), F.coalesce("n", F.lit(0)).cast("long").alias("identified"))
    return both.where("announced > identified")


def holders(author: DataFrame, holder: DataFrame) -> DataFrame:
    """paper, position and slug of the person behind an author's name, among those who have the paper in their own record.

    A person one of whose names it is (the least slug of several); else the only one whose name has all its words, of which there must be two. author: paper, position, name
    (normalised). holder: paper, slug, variants.
    """
    words = F.array_distinct(F.split("name", " "))
    met = author.join(holder, "paper").withColumn("exact", F.array_contains("variants", F.col("name")))
    loose = (F.size(words) >= 2) & F.exists("variants", lambda v: F.size(F.array_except(words, F.split(v, " "))) == 0)
    met = met.withColumn("loose", loose).where("exact or loose").groupBy("paper", "position").agg(F.min(F.when(F.col("exact"), F.col("slug"))).alias("named"), F.collect_set("slug").alias("all"))
    return met.select("paper", "position", F.coalesce("named", F.when(F.size("all") == 1, F.col("all")[0])).alias("slug")).where("slug is not null")


def faculty_match(candidate: DataFrame, page: DataFrame) -> DataFrame:
    """candidate, entry and quality of the best fitting faculty-page entry. candidate: candidate, forms (array of normalised names), institutions (array of short names).
    page: entry, name (normalised, family name first), institution_short.

    Both sides meet at the institution, or at the university above it ("X" for "X-Y"), and at the listed family name: nobody is compared with everybody.
    """
    listed = F.split("name", " ")
    above = F.expr("transform(filter(sequence(1, length(institution_short)), i -> substring(institution_short, i, 1) = '-'), i -> left(institution_short, i - 1))")
    entries = page.select("entry", listed.alias("listed"), F.explode(F.array_distinct(F.concat(F.array("institution_short"), above))).alias("place")).withColumn("family", F.col("listed")[0])
    form = candidate.select("candidate", F.explode("institutions").alias("place"), "forms").select("candidate", "place", F.explode("forms").alias("form"))
    words = F.split("form", " ")
    full, initials = F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), F.filter(words, lambda w: F.length(w) == 1)
    form = form.select("candidate", "place", full.alias("full"), F.size(F.filter(words, lambda w: F.length(w) > 1)).alias("n"), initials.alias("initials")).where("n >= 2")
    met = form.withColumn("family", F.explode("full")).join(entries, ["place", "family"])
    rest = F.filter("listed", lambda w: ~F.array_contains("full", w))
    fits = (F.size(F.array_except("full", "listed")) == 0) & F.array_contains("full", F.element_at("listed", -1)) & F.forall("initials", lambda i: F.exists(rest, lambda r: F.startswith(r, i)))
    whole = F.size(F.array_except("listed", "full")) == 0
    quality = F.when(whole, 0).when((F.size("initials") > 0) | (F.col("n") >= 3), 1).otherwise(2)
    best = met.where(fits).groupBy("candidate").agg(F.min(F.struct(quality.alias("quality"), "entry")).alias("b"))
    return best.select("candidate", "b.entry", F.element_at(F.array(*map(F.lit, QUALITY)), F.col("b.quality") + 1).alias("quality"))


def histogram(rows: DataFrame, key: str, value: str, order: str, into: str) -> DataFrame:
    """key and an array of (value, n): commonest first, ties by what is seen first. Counted before it is gathered, so the array holds each value once."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "seen", F.col(value).alias("value"))))
    return counted.groupBy(key).agg(F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n"))).alias(into))


def candidate_evidence(row: DataFrame, known: DataFrame) -> DataFrame:
    """People named in the lists at an institution, who are not on the roster, with what speaks for them.

    row: key (of the name), name, full, short, university, aff, paper, venue, year, senior (last of several authors), seq. known: key. One row for each key: names, institutions and
    affiliations, commonest first; distinct papers, those as senior author, first and last year, papers by venue, the first and the last paper, and whether the commonest
    institution is a university.
    """
    rows = kept(row.join(known, "key", "left_anti"))  # read five times
    papers = rows.groupBy("key", "paper", "venue", "year").agg(F.max("senior").alias("senior"))
    figures = papers.groupBy("key").agg(
        F.count(F.lit(1)).alias("papers"), F.count(F.when(F.col("senior"), 1)).alias("senior_author"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min(F.struct("year", "paper"))["paper"].alias("first_paper"), F.max(F.struct("year", "paper"))["paper"].alias("sample_paper"),
    )
    venues = papers.groupBy("key", "venue").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("venue", "n"))).alias("venues"))
    place = rows.withColumn("place", F.struct("full", "short", "university"))
    out = figures.join(venues, "key")
    for frame, value, into in ((rows, "name", "names"), (place, "place", "places"), (rows, "aff", "affiliations")):
        out = out.join(histogram(frame, "key", value, "seq", into), "key")
    return out.withColumn("at_university", F.col("places")[0]["value"]["university"])


def parted(candidate: DataFrame, venue: str, year: int) -> Column:
    """Which list a candidate goes to: 'unconfirmed' where one list of one venue and year is all there is, 'university', else 'company'."""
    only = (F.col("first_year") == year) & (F.col("last_year") == year) & (F.size("venues") == 1) & (F.col("venues")[0]["venue"] == venue)
    return F.when(~F.col("at_university"), "company").when(only, "unconfirmed").otherwise("university")


def residual(mail: DataFrame, row: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors known by their mail address only. They join the row of their name where there is one, go where the name is known, and are new rows otherwise.

    mail: key, paper. row: person, key. known: key. Returns (person, paper) to add, and (key, papers) of the new ones."""
    one = row.groupBy("key").agg(F.min("person").alias("person"))
    add = mail.join(one, "key").select("person", "paper").distinct()
    rest = mail.join(one, "key", "left_anti").join(known, "key", "left_anti")
    return add, rest.groupBy("key").agg(F.countDistinct("paper").alias("papers"))


def to_read(wanted: DataFrame, scanned: DataFrame, done: DataFrame) -> DataFrame:
    """paper and why: papers whose PDF is to be read for affiliations: wanted ones, then scanned ones with at least two authors with a family name of the country, both without
    printed affiliations and with an address; those done are left out. wanted, scanned: paper, pdf, n_aff (and in scanned, families)."""
    open_ = lambda f: f.where("pdf is not null and n_aff = 0").join(done, "paper", "left_anti")
    first = open_(wanted).select("paper").distinct()
    more = open_(scanned).where("families >= 2").select("paper").distinct().join(first, "paper", "left_anti")
    return first.withColumn("why", F.lit("record")).union(more.withColumn("why", F.lit("scan")))


def ranked(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The rows with their place in the order, within each value of `by`."""
    return rows.withColumn("shown", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
