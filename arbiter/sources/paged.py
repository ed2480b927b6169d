"""A source of stored response pages, as batch and as stream, and a sink that takes each batch once.

Pages are files ``<path>/<series>/page-<number>.json`` that hold one JSON array of records, or an object with the
array under a name; a crawler writes them in order and a series ends where the next number is missing. The
stream's offset is the number of pages read of each series, so a query that stops goes on after the last
committed page. Paths may be in any store that Arrow knows by its URI.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_PAGE = re.compile(r"(?:^|.*/)([^/]+)/page-(\d+)\.json$")


class Page(InputPartition):
    def __init__(self, series: str, number: int, file: str):
        self.series, self.number, self.file = series, number, file


class _Pages:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the folder of the series is the option path")
        self.path, self.items = options["path"], options.get("items")
        self.most = int(options.get("maxPagesPerBatch", 0))

    def _store(self):
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def listed(self) -> dict[str, dict[int, str]]:
        """The pages of each series, from number 1 up to the first that is missing."""
        store, root = self._store()
        found: dict[str, dict[int, str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and (m := _PAGE.match(info.path)):
                found.setdefault(m[1], {})[int(m[2])] = info.path
        whole = {}
        for series, pages in found.items():
            n = 1
            while n in pages:
                n += 1
            whole[series] = {k: pages[k] for k in range(1, n)}
        return whole

    def read(self, page: Page) -> Iterator[tuple]:
        """Each record as JSON, with where it stood."""
        with self._store()[0].open_input_stream(page.file) as f:
            records = json.loads(f.read().decode())
        if isinstance(records, dict):
            records = records.get(self.items or "items") or []
        for place, record in enumerate(records):
            yield page.series, page.number, place, json.dumps(record, ensure_ascii=False)


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(s, n, f) for s, pages in sorted(self.listed().items()) for n, f in sorted(pages.items())]


class _Stream(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All whole series, or ``maxPagesPerBatch`` pages more of each than the last time."""
        there = {s: len(pages) for s, pages in self.listed().items()}
        if self.most:
            before = self.at or {}
            there = {s: min(n, before.get(s, 0) + self.most) for s, n in there.items()}
        self.at = there
        return there

    def partitions(self, start: dict, end: dict) -> list[Page]:
        # After a restart the first call has the committed offsets, from which the next batch goes on.
        self.at = {**end}
        listed = self.listed()
        return [Page(s, n, listed[s][n]) for s, last in sorted(end.items()) for n in range(start.get(s, 0) + 1, last + 1)]

    def commit(self, end: dict) -> None:
        self.at = {**end}


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``format("stored_pages")``: rows ``series, page, place, record``."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "series string, page int, place int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def write_once(batch: DataFrame, batch_id: int, path: str) -> bool:
    """Writes a batch below ``path`` unless its id has been committed; whether it was.

    The rows are staged aside and become ``<path>/committed/batch_id=<id>`` by one rename, which fails if that is
    there. So a batch that is replayed, or written by two drivers, adds its rows once; a stopped write adds
    none, and what it staged is removed when the batch comes again. For ``foreachBatch``.
    """
    spark = batch.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    goal = hadoop.Path(f"{path}/committed/batch_id={batch_id}")
    store = goal.getFileSystem(conf)
    staged = hadoop.Path(f"{path}/staged/{batch_id}")
    if store.exists(goal):
        store.delete(staged, True)
        return False
    mine = hadoop.Path(staged, uuid.uuid4().hex)
    batch.write.parquet(mine.toString())
    store.mkdirs(goal.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(goal.toUri(), conf) if goal.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)
    try:
        context.rename(mine, goal, options)
    except Exception:
        if store.exists(goal):  # another writer was first
            return False
        raise
    finally:
        store.delete(staged, True)
    return True


def committed(spark, path: str) -> DataFrame:
    """All committed batches, with ``batch_id``."""
    return spark.read.option("basePath", f"{path}/committed").parquet(f"{path}/committed")
