"""``spark.read.format("pdf")``: tables of PDF files under a path, a partition for a group of files."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pdf.cos import PdfError
from .pdf.scan import TABLES, rows


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class PdfReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self):
        root, size = self.options["path"].removeprefix("file://"), int(self.options.get("filesPerPartition", "16"))
        found = [root] if os.path.isfile(root) else sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.lower().endswith(".pdf"))
        return [Files(found[i : i + size]) for i in range(0, len(found), size)] or [Files([])]

    def read(self, partition):
        table, names = self.options.get("table", "paragraphs"), self.schema.fieldNames()
        for path in partition.value:
            with open(path, "rb") as f:
                data = f.read()
            try:
                for r in rows(data, table, self.options.get("password", "")):
                    full = {"doc_id": path, **r, "status": "OK"}
                    yield tuple(_plain(full.get(n)) for n in names)
            except PdfError as e:
                full = {"doc_id": path, "status": e.code}
                yield tuple(full.get(n) for n in names)


def _plain(v):
    if isinstance(v, dict):
        return tuple(v.values())
    return v


class PdfSource(DataSource):
    """Options: path (a folder that every executor mounts), table, password, filesPerPartition. Other stores: ``pdf.scan.read_files`` and ``scan``."""

    @classmethod
    def name(cls):
        return "pdf"

    def schema(self):
        return f"doc_id string, {TABLES[self.options.get('table', 'paragraphs')]}, status string"

    def reader(self, schema):
        return PdfReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
