"""The corpus pipeline: junk goes, one document of each group of near copies stays, repeated passages are cut, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller writes that and reads it again as the next one's docs. All but the last return
the columns of documents, whatever these are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.functions.runtime import remove, shared_folder, table
from papertide.llm import ngram_jaccard, packing, quality, suffix_dedup

#: SQL has no logistic regression trained by updates in sequence, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. Labels come from the label table, and training texts from the whole documents table."""
    weights = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), "text")  # whatever the other columns are called
    return quality.score(rows, weights, threshold=0.3).where("quality_predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of documents that links connect, the one with the smallest id stays. Rows with a null id stay, and
    repeated rows of a document that stays do."""
    classes = ngram_jaccard.jaccard_classes(docs, n=5, threshold=0.8)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of 50-byte strings that also start in an earlier document are cut from the texts; a character of which only a part
    would be left goes with them, and n_chars, where there is one, is the new length."""
    others = F.struct(*(F.col(c) for c in docs.columns if c != "text"))
    rows = docs.select("doc_id", "text", F.struct(others.alias("row"), F.col("text").isNull().alias("none")).alias("carried"))
    cut, changed, row = suffix_dedup.repeats(rows, carried="carried"), F.size("spans") > 0, F.col("carried").getField("row")
    new = F.when(~F.col("carried").getField("none"), F.when(changed, F.col("kept_text")).otherwise(F.col("kept").cast("string")))
    fresh = {"text": new}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(row.getField("n_chars"))
    return cut.select(*(fresh[c].alias(c) if c in fresh else row.getField(c).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), room=4096, end=1)


STAGES = [("quality classifier", drop_junk), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet in the shared folder and read again. A stage's input goes once its output is written, so that
    one copy of the corpus is there at the end, which the result is read from."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            remove(spark, f"{folder}/{k - 1}")
    return docs
