"""A Spark data source for paginated catalogs: one partition per page.

Pages come from a folder that a fetcher fills (``<domain>/<page>.json``); another
place of pages needs only another reader. Use it as
``spark.read.format("catalog_pages").option("path", folder).load()``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftline.sources.catalog import LANDING


class CatalogPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return LANDING

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.crawl_id = options["path"], options.get("crawlId", "0")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        store, root = self._store()
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(f.path) for f in files if f.path.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self._store()
        with store.open_input_stream(partition.value) as stream:
            body = stream.read().decode("utf-8", "replace")
        domain, page = partition.value.rsplit("/", 2)[-2:]
        yield domain, self.crawl_id, int(page.removesuffix(".json")), 200, body, None
