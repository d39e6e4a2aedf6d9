"""Readers of annotation files: selection tables, label tracks, layer XML.

Every reader returns rows (annot_path, row_no, begin_s, end_s, low_hz, high_hz, label, channel,
source_file, status). Channels count from 0. A file that cannot be read gives one row with its
error in ``status`` and no row besides, so one bad file never stops a job. Files are read whole per
task (they are small); the rows keep the order of their file.
"""

from __future__ import annotations

import csv
import io
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "annot_path string, row_no int, begin_s double, end_s double, low_hz double, high_hz double, label string, channel int, source_file string, status string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

#: Column titles of selection tables (fixed values): field, accepted titles.
TITLES = {
    "begin": ("Begin Time (s)",),
    "end": ("End Time (s)",),
    "low": ("Low Freq (Hz)", "Low Frequency (Hz)"),
    "high": ("High Freq (Hz)", "High Frequency (Hz)"),
    "channel": ("Channel",),
    "file": ("Begin File",),
    "offset": ("File Offset (s)",),
}
DEFAULT_LABEL_TITLE = "Tags"
_REQUIRED = object()


def _number(text: str | None):
    return None if text is None or not text.strip() else float(text)


def convert(header: list[str], row: list[str], titles, kind=None, default=_REQUIRED):
    """One field of a table row.

    Present with a type: blank takes the default, or fails without one. Present without a type: as
    it stands. Absent: the default, or ``LookupError`` without one.
    """
    for title in (titles,) if isinstance(titles, str) else titles:
        if title in header:
            at = header.index(title)
            value = row[at] if at < len(row) else ""
            if kind is None:
                return value
            if not value.strip() and default is not _REQUIRED:
                return default
            return kind(value)
    if default is _REQUIRED:
        raise LookupError(f"no column {titles!r}")
    return default


def selection_rows(text: str, label_title: str = DEFAULT_LABEL_TITLE, multi_file: bool = False, keep: Callable[[dict], bool] | None = None) -> Iterator[dict]:
    """Rows of a tab-separated selection table.

    In a table about several files, times count from the named file's beginning: the begin is the
    file offset and the end adds the selection's length.
    """
    table = list(csv.reader(io.StringIO(text), delimiter="\t", quoting=csv.QUOTE_NONE))
    if not table:
        return
    header = [t.strip() for t in table[0]]
    for row in table[1:]:
        if not any(v.strip() for v in row):
            continue
        begin, end = convert(header, row, TITLES["begin"], float), convert(header, row, TITLES["end"], float)
        source = None
        if multi_file:
            offset = convert(header, row, TITLES["offset"], float)
            begin, end = offset, offset + (end - begin)
            source = convert(header, row, TITLES["file"])
        if keep is not None and not keep(dict(zip(header, row, strict=False))):
            continue
        yield {
            "begin_s": begin, "end_s": end, "low_hz": convert(header, row, TITLES["low"], _number, None), "high_hz": convert(header, row, TITLES["high"], _number, None),
            "label": convert(header, row, label_title, None, None), "channel": convert(header, row, TITLES["channel"], int, 1) - 1, "source_file": source,
        }


def track_rows(text: str) -> Iterator[dict]:
    """Rows of a label track: begin, end, label; a line that begins with a backslash holds frequencies."""
    pending = None
    for line in text.splitlines():
        cells = line.split("\t")
        if cells[0] == "\\":
            if pending is not None:
                low, high = (float(c) for c in cells[1:3])
                pending |= {"low_hz": low if low >= 0 else None, "high_hz": high if high >= 0 else None}
            continue
        if pending is not None:
            yield pending
            pending = None
        if line.strip():
            pending = {"begin_s": float(cells[0]), "end_s": float(cells[1]), "low_hz": None, "high_hz": None, "label": cells[2] if len(cells) > 2 else "", "channel": 0, "source_file": None}
    if pending is not None:
        yield pending


def layer_rows(text: str) -> Iterator[dict]:
    """Rows of an annotation layer in XML: frames by the model's rate to seconds."""
    root = ElementTree.fromstring(text)
    model = root.find(".//model")
    rate = float(model.get("sampleRate"))
    for point in root.iter("point"):
        begin = float(point.get("frame")) / rate
        value, extent = point.get("value"), point.get("extent")
        low = float(value) if value is not None else None
        yield {
            "begin_s": begin, "end_s": begin + float(point.get("duration", 0)) / rate, "low_hz": low, "high_hz": low + float(extent) if low is not None and extent is not None else None,
            "label": point.get("label"), "channel": 0, "source_file": None,
        }


def read_annotations(spark: SparkSession, root: str, rows_of: Callable[[str], Iterator[dict]], glob: str = "*", relative: str | None = None) -> DataFrame:
    """All annotation files below ``root`` that match ``glob``, parsed by ``rows_of``; see SCHEMA."""
    from tidegrid.sources.listing import relative_to

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.select(relative_to(F.col("path"), relative or root).alias("path"), "content")
    columns = COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    own = [{"annot_path": path, "row_no": i, "status": None} | r for i, r in enumerate(rows_of(bytes(content).decode("utf-8-sig")))]
                except Exception as x:  # a bad file is reported, not raised
                    own = [{"annot_path": path, "status": f"{type(x).__name__}: {x}"}]
                if own:
                    yield pd.DataFrame({c: pd.Series([r.get(c) for r in own], dtype=object) for c in columns})

    return files.mapInPandas(run, SCHEMA)


def read_selection_tables(spark: SparkSession, root: str, glob: str = "*.txt", label_title: str = DEFAULT_LABEL_TITLE, multi_file: bool = False, keep=None) -> DataFrame:
    return read_annotations(spark, root, lambda text: selection_rows(text, label_title, multi_file, keep), glob)


def read_label_tracks(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    return read_annotations(spark, root, track_rows, glob)


def read_layers(spark: SparkSession, root: str, glob: str = "*.svl") -> DataFrame:
    return read_annotations(spark, root, layer_rows, glob)


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("status is null").drop("status")


def bad_files(rows: DataFrame) -> DataFrame:
    return rows.filter("status is not null").select("annot_path", "status")
