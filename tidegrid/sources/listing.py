"""Recording and annotation file listings.

Listings come from the ``binaryFile`` source without reading contents; content is only read by the
decoders. All results are DataFrames, so existence checks are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings of recordings (fixed values).
AUDIO_ENDINGS = (".wav", ".WAV", ".flac", ".aif", ".mp3")

SELMAP = T.StructType([T.StructField("audio_path", T.StringType()), T.StructField("annot_path", T.StringType())])


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, whatever the scheme in front of it."""
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^[a-z0-9]+:/*", "/")
    return F.regexp_replace(plain, "^" + _escaped(root.rstrip("/")) + "/", "")


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def list_files(spark: SparkSession, root: str, endings: tuple[str, ...] = AUDIO_ENDINGS, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files below ``root`` with one of the endings; path is relative.

    Files without content are not listed.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")
    rows = rows.select(relative_to(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.filter(" or ".join(f"endswith(path, '{e}')" for e in endings)) if endings else rows


def files_of_classes(files: DataFrame, class_dirs: list[str] | None = None) -> DataFrame:
    """Files with the class that their first directory names; optionally only some classes."""
    out = files.withColumn("label", F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)))
    return out.filter(F.col("label").isin(class_dirs)) if class_dirs is not None else out.filter("label is not null")


def read_selmap(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Pairs (audio_path, annot_path) of a CSV; further columns are ignored."""
    rows = spark.read.csv(path, header=header, quote='"', escape='"')
    a, b = rows.columns[:2]
    return rows.select(F.trim(F.col(a)).alias("audio_path"), F.trim(F.col(b)).alias("annot_path"))


def valid_pairs(selmap: DataFrame, audio: DataFrame, annots: DataFrame) -> DataFrame:
    """Pairs of which both sides exist. An audio path may also name a directory of recordings."""
    parents = audio.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("audio_path")).distinct()
    return selmap.join(parents, "audio_path", "left_semi").join(annots.select(F.col("path").alias("annot_path")).distinct(), "annot_path", "left_semi").select("audio_path", "annot_path")


def broken_pairs(selmap: DataFrame, audio: DataFrame, annots: DataFrame) -> DataFrame:
    """Pairs of which a side is missing: the error report."""
    good = valid_pairs(selmap, audio, annots)
    return selmap.join(good, ["audio_path", "annot_path"], "left_anti")


def annotated_files(selmap: DataFrame, annotations: DataFrame, audio: DataFrame, keep_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Annotations with the recording they belong to, and those whose recording is missing.

    ``annotations`` has ``annot_path`` and ``source_file`` (null where a table is about one file). A
    pair whose audio path is a file gives all rows of its table to it; where it is a directory, the
    source file is looked up below it. With ``keep_empty`` recordings without rows come once, with
    nulls.
    """
    files = audio.select(F.col("path").alias("file")).distinct()
    pairs = selmap.distinct()
    single = pairs.join(files, pairs["audio_path"] == files["file"]).join(annotations, "annot_path", "left" if keep_empty else "inner")
    folder = pairs.join(files, pairs["audio_path"] == files["file"], "left_anti").join(annotations, "annot_path")
    folder = folder.withColumn("file", F.when(F.col("source_file").isNotNull(), F.concat_ws("/", F.when(F.col("audio_path") != "", F.rtrim(F.col("audio_path"), F.lit("/"))), F.col("source_file"))))
    found = folder.join(files, "file", "left_semi")
    missing = folder.join(files, "file", "left_anti")
    columns = ["file", *[c for c in annotations.columns]]
    return single.select(*columns).unionByName(found.select(*columns)), missing.select("audio_path", *columns)


def whitelisted(rows: DataFrame, spark: SparkSession, path: str, column: str = "label") -> DataFrame:
    """Rows whose label is a line of a text file; blank lines and blanks around names don't count."""
    names = spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "").distinct()
    return rows.join(names, column, "left_semi")
