"""Sinks: prepared clips and raw scores as Parquet, detections as selection tables and label tracks.

Text files are written by the tasks: rows are grouped by output file, sorted within partitions, and
streamed to files in the target folder, so no file passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIX = ".selections.txt"


def write_prepared(clips: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prepared clips (16-bit) as a dataset; rows of one file lie together for later pruning."""
    clips.repartition("file").sortWithinPartitions("file", "channel", "clip_start").write.mode(mode).option("compression", "zstd").parquet(path)


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    scores.repartition("file").sortWithinPartitions("file", "channel", "clip_idx", "class_idx").write.mode(mode).option("compression", "zstd").parquet(path)


def selection_fields(frequencies: bool = False, channel: bool = True, score: bool = False, offset: bool = False, extras: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """Titles and texts of a selection table's columns, in their order."""
    text = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    fields = [("Selection", F.col("selection").cast("string"))]
    if channel:
        fields.append(("Channel", F.coalesce(F.col("channel") + 1, F.lit(1)).cast("string")))
    fields += [("Begin Time (s)", text("begin_s", 6)), ("End Time (s)", text("end_s", 6))]
    if frequencies:
        fields += [("Low Freq (Hz)", text("low_hz", 2)), ("High Freq (Hz)", text("high_hz", 2))]
    fields.append(("Tags", F.coalesce("label", F.lit(""))))
    if score:
        fields.append(("Score", text("score", 2)))
    if offset:
        fields += [("File Offset (s)", text("file_offset_s", 6)), ("Begin File", F.col("file"))]
    return [*fields, *((e, F.coalesce(F.col(e).cast("string"), F.lit(""))) for e in extras)]


def selection_lines(found: DataFrame, **options) -> tuple[str, DataFrame]:
    """Header line, and (out_file, line_no, line) of detections that carry ``out_file`` and ``selection``."""
    fields = selection_fields(**options)
    line = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for _, c in fields])
    return "\t".join(t for t, _ in fields), found.select("out_file", F.col("selection").cast("bigint").alias("line_no"), line.alias("line"))


def numbered(found: DataFrame) -> DataFrame:
    """Detections with their selection number within ``out_file``, by start."""
    return found.withColumn("selection", F.row_number().over(W.partitionBy("out_file").orderBy("begin_s", "channel", "label", "end_s")))


def combined(found: DataFrame, durations: DataFrame) -> DataFrame:
    """Detections of the files of one directory as one table.

    ``durations`` has (file, duration_s). Times are shifted by the durations of the files before,
    numbers run on, and the unshifted begin stays as the file offset.
    """
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise("results")
    files = durations.select("file", "duration_s").withColumn("out_file", folder)
    before = W.partitionBy("out_file").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("shift", F.coalesce(F.sum("duration_s").over(before), F.lit(0.0))).select("file", "out_file", "shift")
    rows = found.drop("out_file").join(files, "file").withColumn("file_offset_s", F.col("begin_s"))
    rows = rows.withColumns({"begin_s": F.col("begin_s") + F.col("shift"), "end_s": F.col("end_s") + F.col("shift")}).drop("shift")
    number = F.row_number().over(W.partitionBy("out_file").orderBy("file", "begin_s", "channel", "label", "end_s"))
    return rows.withColumn("selection", number)


def track_lines(found: DataFrame, frequencies: bool = False) -> DataFrame:
    """(out_file, line_no, line) of a label track; unknown frequencies are written as -1."""
    text = lambda c: F.format_string("%.6f", F.coalesce(F.col(c).cast("double"), F.lit(-1.0)))
    main = F.concat_ws("\t", text("begin_s"), text("end_s"), F.coalesce("label", F.lit("")))
    lines = F.array(main, F.concat_ws("\t", F.lit("\\"), text("low_hz"), text("high_hz"))) if frequencies else F.array(main)
    rows = found.select("out_file", "selection", F.posexplode(lines).alias("part", "line"))
    return rows.select("out_file", (F.col("selection") * 2 + F.col("part")).cast("bigint").alias("line_no"), "line")


def write_lines(lines: DataFrame, folder: str, header: str | None = None, suffix: str = SUFFIX) -> DataFrame:
    """Write every ``out_file`` below ``folder``: returns (out_file, n_lines).

    ``folder`` must be visible to all executors. A task that is tried again writes its files anew.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, out, n = None, None, 0
        for batch in batches:
            for name, line in zip(batch["out_file"], batch["line"], strict=True):
                if name != current:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame({"out_file": [current], "n_lines": [n]})
                    path = Path(folder, name + suffix)
                    path.parent.mkdir(parents=True, exist_ok=True)
                    current, out, n = name, path.open("w", encoding="utf-8"), 0
                    if header is not None:
                        out.write(header + "\n")
                out.write(line + "\n")
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"out_file": [current], "n_lines": [n]})

    return lines.repartition("out_file").sortWithinPartitions("out_file", "line_no").mapInPandas(run, "out_file string, n_lines bigint")
