"""Landed scans of paged sources as a Spark data source, and a content-addressed store as a sink.

A scan is cut into slices (of time or operation); each slice's responses lie as page-00001.json and so on in a
folder slice=<name>. A slice is a partition. Files are reached through Arrow's file systems, so that the folder
may be local or in a store that all executors see.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

_PAGE = "page-{:05d}.json"
_SCHEMA = "slice string, page int, position int, total long, item string"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _slices(path: str) -> list[str]:
    fs, root = _located(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name.removeprefix("slice=") for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("slice="))


def _page(path: str, name: str, page: int) -> tuple[list[dict], int] | None:
    """(items, total) of a page, None if it hasn't landed; an answer that is an error is one here."""
    fs, root = _located(path)
    where = f"{root}/slice={name}/{_PAGE.format(page)}"
    if fs.get_file_info(where).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(where) as f:
        response = json.loads(f.read()).get("response") or {}
    code = str((response.get("header") or {}).get("resultCode", "00"))
    if code not in ("00", "0"):
        raise ValueError(f"{where}: result code {code}")
    body = response.get("body") or {}
    items = body.get("items") or []
    items = items.get("item") or [] if isinstance(items, dict) else items
    items = [items] if isinstance(items, dict) else items
    return items, int(body.get("totalCount") or len(items))


def _batch(name: str, page: int, items: Sequence[dict], total: int) -> pa.RecordBatch:
    n = len(items)
    columns = [[name] * n, [page] * n, range(n), [total] * n, [json.dumps(x, ensure_ascii=False) for x in items]]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slice", "page", "position", "total", "item"])


@dataclass
class Slice(InputPartition):
    """Pages first to last of a slice; last is None for all that the source says there are."""

    name: str
    first: int = 1
    last: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", 100))

    def partitions(self) -> list[Slice]:
        return [Slice(x) for x in _slices(self.path)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """Pages in order, until they have given the total or one is empty. A page that is missing before is an error."""
        if partition is None:  # no slice has landed
            return
        page = partition.first
        while partition.last is None or page <= partition.last:
            found = _page(self.path, partition.name, page)
            if found is None:
                raise FileNotFoundError(f"{self.path}: slice {partition.name} lacks page {page}")
            items, total = found
            if items:
                yield _batch(partition.name, page, items, total)
            if partition.last is None and (page * self.rows >= total or not items):
                return
            page += 1


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the number of pages of each slice that have landed without a gap."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = _located(self.path)
        out = {}
        for name in _slices(self.path):
            there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/slice={name}"))}
            out[name] = next(k for k in range(len(there) + 1) if _PAGE.format(k + 1) not in there)
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(x, start.get(x, 0) + 1, n) for x, n in end.items() if n > start.get(x, 0)]

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    """spark.read.format("landed_pages").option("path", folder).option("rows", items a page).load(): (slice, page, position,
    total, item as JSON). As a stream it gives each page once, as it lands."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)


@dataclass
class Stored(WriterCommitMessage):
    """Where a task staged contents, by key, and its rows of the manifest."""

    staged: dict[str, str]
    rows: list[dict]


class _StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.run = options["path"], options.get("run", "manifest")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        """Stages each different content of (source, external_id, content) once, in a folder of this attempt's own."""
        from pyspark import TaskContext

        fs, root = _located(self.path)
        context, staged, rows = TaskContext.get(), {}, []
        folder = f"{root}/_staging/{self.run}/{context.partitionId()}-{context.taskAttemptId()}"
        for batch in iterator:
            for source, external_id, content in zip(*(batch.column(c).to_pylist() for c in ("source", "external_id", "content")), strict=True):
                digest = hashlib.sha256(content or b"").hexdigest()
                key = f"{source}/{digest[:2]}/{digest}.bin"
                if key not in staged:
                    fs.create_dir(folder)
                    staged[key] = f"{folder}/{len(staged)}"
                    with fs.open_output_stream(staged[key]) as f:
                        f.write(content or b"")
                rows.append({"source": source, "external_id": external_id, "key": key, "bytes": len(content or b"")})
        return Stored(staged, rows)

    def commit(self, messages: list[Stored | None]) -> None:
        """Moves what isn't there yet to its key, then writes the manifest of this run: a run that is repeated leaves one."""
        fs, root = _located(self.path)
        done = [m for m in messages if m is not None]
        for staged in (m.staged for m in done):
            for key, where in staged.items():
                if fs.get_file_info(f"{root}/{key}").type == pafs.FileType.NotFound:
                    fs.create_dir(f"{root}/{key}".rpartition("/")[0])
                    fs.move(where, f"{root}/{key}")
        fs.create_dir(f"{root}/_manifests")
        with fs.open_output_stream(f"{root}/_manifests/{self.run}.tmp") as f:
            for m in done:
                for row in m.rows:
                    f.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
        fs.move(f"{root}/_manifests/{self.run}.tmp", f"{root}/_manifests/{self.run}.jsonl")
        self._cleared()

    def abort(self, messages: list[Stored | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        fs, root = _located(self.path)
        if fs.get_file_info(f"{root}/_staging/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_staging/{self.run}")


class ContentStore(DataSource):
    """df.write.format("content_store").option("path", folder).option("run", name).mode("append").save(): contents of rows
    (source, external_id, content) under the hash of their bytes, each once; _manifests/<run>.jsonl tells which row has
    which. Nothing can be read under its key before the whole run is written; a run that breaks off leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "content_store"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _StoreWriter(self.options, overwrite)
