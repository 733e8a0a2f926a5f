"""From texts to scores of their tokens and sentences: windows of a model's length, scores stitched by position, and tokens met with the sentences that they lie in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions.manuscript import SENTENCE_END
from papertide.functions.runtime import kept
from papertide.operators.figures import flagged_share

#: Tokens of a model's window, less the two that open and close it; tokens read of a text; characters of a bin in which tokens and sentences meet.
WINDOW, CAP, BIN = 2046, 16_384, 1024
WORD = re.compile(r"[^ \t\n\r\f\v]+")


class Windows:
    """Table function: the windows of a text, each as soon as it is full, so that no more than one is held. `truncated` says that tokens beyond the cap were left out."""

    def eval(self, text: str | None, size: int, cap: int) -> Iterator[tuple]:
        starts: list[int] = []
        ends: list[int] = []
        n = 0
        for found in WORD.finditer(text or ""):
            if n == cap:
                # The last window is held back until it is known whether anything follows it.
                yield n - len(starts), starts, ends, True
                return
            if len(starts) == size:
                yield n - size, starts, ends, False
                starts, ends = [], []
            starts.append(found.start())
            ends.append(found.end())
            n += 1
        if starts:
            yield n - len(starts), starts, ends, False


def windows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, cap: int = CAP) -> DataFrame:
    """doc_id, first (the place of the window's first token), starts and ends (characters of each token) and truncated of each window of the words of a text. Texts without words have no window."""
    table = F.udtf(Windows, returnType="first int, starts array<int>, ends array<int>, truncated boolean")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.lateralJoin(table(F.col("text").outer(), F.lit(size), F.lit(cap))).drop("text")


def token_scores(window: DataFrame, scorer: Callable[[DataFrame], Column]) -> DataFrame:
    """doc_id, position, start, end and score of each token. scorer: a column of one score for each token of a window, of the columns of window."""
    scored = window.withColumn("scores", scorer(window))
    each = F.posexplode(F.arrays_zip("starts", "ends", "scores")).alias("place", "t")
    return scored.select("doc_id", "first", each).select("doc_id", (F.col("first") + F.col("place")).alias("position"), F.col("t.starts").alias("start"), F.col("t.ends").alias("end"), F.col("t.scores").alias("score"))


def sentence_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence, start and end (characters): a text cut after each sign that ends a sentence, with the space behind it, and after each empty line."""
    marked = F.regexp_replace(F.translate(F.col(text), "\u0001", " "), f"({SENTENCE_END})", "$1\u0001")
    pieces = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(marked, "\u0001")).alias("sentence", "piece"))
    ends = F.sum(F.char_length("piece")).over(Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("end", ends).select("doc_id", "sentence", (F.col("end") - F.char_length("piece")).alias("start"), "end").where("start < end")


def within(token: DataFrame, sentence: DataFrame, size: int = BIN) -> DataFrame:
    """The tokens with the sentence that holds their middle; tokens without width, and those in no sentence, are left out.

    token: doc_id, start, end and others. sentence: doc_id, sentence, start, end. A sentence is laid out in all bins of `size` characters that it reaches, and a token in the one of its middle, so they
    meet in an equal join, each pair once, and the parts of a long text in different tasks.
    """
    middle = F.col("start") + F.col("end")  # twice the middle, which may lie between two characters
    at = token.where("end > start").withColumn("bin", F.floor(middle / (2 * size)).cast("long")).withColumn("middle", middle)
    reach = F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long"))
    laid = sentence.where("end > start").select("doc_id", "sentence", F.col("start").alias("from"), F.col("end").alias("to"), F.explode(reach).alias("bin"))
    return at.join(laid, ["doc_id", "bin"]).where("2 * from <= middle and middle < 2 * to").drop("bin", "middle", "from", "to")


def text_figures(documents: DataFrame, scorer: Callable[[DataFrame], Column], threshold: float, share: float = 0.25, size: int = WINDOW, cap: int = CAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens, truncated, score (the mean of the largest scores, a share of them), sentences judged, flagged ones and their share of each text with words."""
    window = kept(windows(documents, doc_id, text, size, cap))  # read three times
    token = token_scores(window, scorer)
    # Ranks within a text of at most `cap` tokens.
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "position"))
    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    top = token.select("doc_id", "score", rank.alias("rank"), count.alias("tokens")).where(F.col("rank") <= F.greatest(F.ceil(F.col("tokens") * share), F.lit(1)))
    whole = top.groupBy("doc_id").agg(F.max("tokens").alias("tokens"), F.avg("score").alias("score")).join(window.groupBy("doc_id").agg(F.max("truncated").alias("truncated")), "doc_id")
    flagged = flagged_share(within(token.select("doc_id", "start", "end", "score"), sentence_spans(documents, doc_id, text)), threshold)
    return whole.join(flagged, "doc_id", "left").select("doc_id", "tokens", "truncated", "score", F.coalesce("sentences", F.lit(0)).alias("sentences"), F.coalesce("flagged", F.lit(0)).alias("flagged"), "pct")
