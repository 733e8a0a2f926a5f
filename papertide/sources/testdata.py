"""The domain's silver tables, read from the order tables that stand in for them.

An order is a paper (priority: venue, status: decision), a line an authorship (supplier: person), a nation an institution, and region 2 is home.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions.runtime import table

FULL_RECORD = "1-URGENT"  # the venue whose submissions are all public


@dataclass
class Domain:
    """paper(paper, venue, year, status, field, holder, worth), authorship(paper, person, position), member(paper, person), person(person, name,
    institution, nation, home, since, approved)."""

    paper: DataFrame
    authorship: DataFrame
    member: DataFrame
    person: DataFrame
    folder: str


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("withdrawn")
    venue = F.col("o_orderpriority")
    field = F.when(F.substring(venue, 1, 1).isin("1", "2"), "AI").when(F.substring(venue, 1, 1) == "3", "ML").when(F.substring(venue, 1, 1) == "4", "CV").otherwise("NLP")
    paper = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), venue.alias("venue"), F.year("o_orderdate").alias("year"), status.alias("status"), field.alias("field"), F.col("o_custkey").alias("holder"), F.col("o_totalprice").alias("worth"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem")
    authorship = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("person"), F.row_number().over(order).alias("position"))
    member = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("person")).distinct()
    since = F.when(F.col("s_suppkey") % 7 != 0, 1995 + F.col("s_suppkey") % 5)
    nations = table(spark, sf_dir, "nation")
    person = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"), F.col("n_name").alias("institution"), F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") == 2).alias("home"), since.cast("int").alias("since"), (F.col("s_suppkey") % 4 != 0).alias("approved")
    )
    return Domain(paper, authorship, member, person, sf_dir)
