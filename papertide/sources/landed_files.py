"""Folders of landed files as tables: whole files with what their path and first bytes tell, and bibliography volumes read a line at a time.

Files are read by Spark, so any store that it knows works, and each file, or each block of a volume, is a task's own.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.functions.text import bib_fields

#: The end of the name of a file that says: this was asked for, and not found.
MISSING = ".missing"
_MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_HEAD = re.compile(r"\s*@\w+\s*\{")
_BRACE = re.compile(r"\\.|[{}]")


def decoded(data: bytes) -> str | None:
    """The text of a file: unpacked where it is gzip, in the coding that its first bytes mark, else UTF-8; bytes that are no text become replacement signs. Null for broken archives."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            return None
    for mark, coding in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(coding, "replace")
    return data.decode("utf-8", "replace")


def _bodies(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: decoded(bytes(x)) if x is not None else None).astype(object)


def _plain(path: Column) -> Column:
    """A path as it was written, where Spark gives it as an address."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _of_path(path: Column) -> dict[str, Column]:
    """venue and year from a path: <venue>/<year>/<file>, where each may be written as venue=... and year=..."""
    found = lambda k: F.nullif(F.regexp_extract(path, r"/(?:venue=)?([^/=]+)/(?:year=)?(\d{4})/[^/]*$", k), F.lit(""))
    return {"venue": found(1), "year": found(2).cast("int")}


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the marks of missing files, which are empty, so that Spark's readers of tables pass them over."""
    context, pattern = spark.sparkContext, f"{folder}/*/*/*{MISSING}"
    path = context._jvm.org.apache.hadoop.fs.Path(pattern)
    if not path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path):
        return spark.createDataFrame([], "path string")
    return context.binaryFiles(pattern).keys().map(lambda p: (p,)).toDF("path string")


def landed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, venue, year, missing, landed_at and body of each file under a folder whose name fits the pattern, and of each mark of a missing file, which has no body and no time.
    A body is null where it cannot be unpacked. Other empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    found = files.select(_plain(F.col("path")).alias("path"), F.lit(False).alias("missing"), F.col("modificationTime").alias("landed_at"), F.pandas_udf(_bodies, "string")("content").alias("body"))
    found = found.where(~F.endswith("path", F.lit(MISSING))).unionByName(marks(spark, folder).select(_plain(F.col("path")).alias("path"), F.lit(True).alias("missing")), allowMissingColumns=True)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.gz)?(\.missing)?$", "")
    return found.select("path", name.alias("name"), *(c.alias(k) for k, c in _of_path(F.col("path")).items()), "missing", "landed_at", "body")


class Entries:
    """Table function: the entries of a bibliography volume, each as soon as its braces are closed, so that no more than one is held. A line that begins an entry ends one
    that was never closed, which is left out, as is all text between entries."""

    def __init__(self) -> None:
        self.text, self.depth, self.seq = [], 0, 0

    def eval(self, row) -> Iterator[tuple]:
        line = row.line or ""
        if _HEAD.match(line):
            self.text, self.depth = [], 0
        while line:
            if not self.text:
                begins = line.find("@")
                if begins < 0 or not _HEAD.match(line[begins:]):
                    return
                line = line[begins:]
            end = None
            for found in _BRACE.finditer(line):
                self.depth += {"{": 1, "}": -1}.get(found[0], 0)
                if found[0] == "}" and self.depth == 0:
                    end = found.end()
                    break
            self.text.append(line if end is None else line[:end])
            if end is None:
                return
            fields = bib_fields("\n".join(self.text))
            if fields:
                yield row.path, row.venue, row.year, self.seq, fields.pop("type"), fields.pop("key"), fields
                self.seq += 1
            self.text, line = [], line[end:]


def bib_entries(lines: DataFrame) -> DataFrame:
    """path, venue, year, seq, kind, key and fields (a map) of the entries of volumes. lines: path, venue, year, place (of the line in its volume) and line."""
    table = F.udtf(Entries, returnType="path string, venue string, year int, seq int, kind string, key string, fields map<string,string>")
    return table(lines.select("path", "venue", "year", "place", "line").asTable().partitionBy("path", "venue", "year").orderBy("place"))


def volume_lines(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The lines of the text files under a folder, for bib_entries(). A large file is read in blocks, by as many tasks, and its lines are put in order by Spark's sort, which spills."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    rows = read.select(_plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return rows.select("path", *(c.alias(k) for k, c in _of_path(F.col("path")).items()), F.struct("block", "n").alias("place"), "line")
