"""Annotation files as a registered Spark data source.

    spark.dataSource.register(AnnotationSource)
    spark.read.format("annotations").option("kind", "selections").load("/data/tables")

Options: ``kind`` is selections, tracks or layers; ``glob`` picks files; ``label`` and ``multi_file``
are those of selection tables. One partition per file. Readers of other formats subclass it and
extend ``PARSERS``. The path must be visible to all executors; rows follow
``tidegrid.sources.annotations.SCHEMA``.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidegrid.sources import annotations

PARSERS = {
    "selections": lambda text, o: annotations.selection_rows(text, o.get("label", annotations.DEFAULT_LABEL_TITLE), o.get("multi_file", "false").lower() == "true"),
    "tracks": lambda text, o: annotations.track_rows(text),
    "layers": lambda text, o: annotations.layer_rows(text),
}
DEFAULT_GLOBS = {"selections": "*.txt", "tracks": "*.txt", "layers": "*.svl"}


class FilePartition(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class AnnotationReader(DataSourceReader):
    def __init__(self, options: dict, parsers: dict):
        self.root, self.kind = options["path"], options.get("kind", "selections")
        self.options, self.parse = dict(options), parsers[self.kind]
        self.glob = options.get("glob", DEFAULT_GLOBS.get(self.kind, "*"))

    def partitions(self) -> list[InputPartition]:
        root = Path(self.root)
        return [FilePartition(str(p), str(p.relative_to(root))) for p in sorted(root.rglob(self.glob)) if p.is_file()]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        names = annotations.COLUMNS
        try:
            text = Path(partition.path).read_bytes().decode("utf-8-sig")
            rows = [{"annot_path": partition.name, "row_no": i} | r for i, r in enumerate(self.parse(text, self.options))]
        except Exception as x:  # a bad file is reported, not raised
            rows = [{"annot_path": partition.name, "status": f"{type(x).__name__}: {x}"}]
        for r in rows:
            yield tuple(r.get(c) for c in names)


class AnnotationSource(DataSource):
    """The data source ``annotations``."""

    parsers = PARSERS

    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return annotations.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AnnotationReader(self.options, self.parsers)
