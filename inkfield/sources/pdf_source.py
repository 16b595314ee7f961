"""PDF pages as a data source: spark.read.format("pdf_pages").load(path). A filter on page is taken over by the reader,
which then interprets only these pages; long files can be dealt over several partitions (option splits)."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from inkfield.sources.pdf import PAGE, read_pages


@dataclass
class Pages:
    """The page numbers that a partition reads: every `of`-th from `part`, and of these the wanted, if any are named."""

    part: int
    of: int
    wanted: frozenset[int] | None

    def __contains__(self, page: int) -> bool:
        return page % self.of == self.part and (self.wanted is None or page in self.wanted)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return f"doc_id string, {PAGE}"

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options["path"], int(self.options.get("splits", "1")))


class PdfReader(DataSourceReader):
    def __init__(self, path: str, splits: int):
        self.path, self.splits, self.wanted = path, splits, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("page",):
                named = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = sorted(f.path for f in found if f.is_file and posixpath.splitext(f.path)[1].lower() == ".pdf")
        return [InputPartition((f, part)) for f in files for part in range(self.splits)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as fs

        path, part = partition.value
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(path) as f:
            data = f.read()
        for page in read_pages(data, Pages(part, self.splits, self.wanted)):
            yield (path, *page)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
