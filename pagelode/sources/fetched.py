"""Saved fetches as a Spark data source, read as a table or as a stream.

A crawl saves what it fetched as JSON lines, a folder per save, named by the
save's number; Spark's mark of success in a folder says that it is whole.

    spark.dataSource.register(SavedFetches)
    spark.read.format("saved_fetches").load(folder)
    spark.readStream.format("saved_fetches").load(folder)

A file is one partition. The stream's offset is the last whole save, so a save
is read once however often the stream restarts; saves whose numbers lie behind
the offset are not looked at again. Lines that aren't JSON objects, and fields
of another type, read as a row of nulls and as null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FETCHES = "save long, url string, status int, content_type string, body string, headers map<string,string>, final_url string"
ROWS = 500


def save_fetches(rows: DataFrame, folder: str, save: int) -> None:
    """Write fetches (url, status, body, headers, final_url) as save number ``save``; a repeated save replaces itself."""
    line = F.to_json(F.struct("url", "status", "body", "headers", "final_url"))
    rows.select(line.alias("value")).write.mode("overwrite").text(f"{folder.rstrip('/')}/{save:012d}")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Fetches(InputPartition):
    def __init__(self, folder: str, path: str, save: int):
        self.folder, self.path, self.save = folder, path, save


def saves(folder: str, after: int = -1, upto: int | None = None) -> list[Fetches]:
    """Files of the whole saves with numbers in (after, upto], in order."""
    files, root = store(folder)
    out = []
    for kept in sorted(files.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda f: f.path):
        name = kept.base_name
        if kept.type == fs.FileType.Directory and name.isdigit() and after < int(name) and (upto is None or int(name) <= upto):
            inside = files.get_file_info(fs.FileSelector(kept.path))
            if any(f.base_name == "_SUCCESS" for f in inside):
                out += [Fetches(folder, f.path, int(name)) for f in sorted(inside, key=lambda f: f.path) if f.base_name[0] not in "._" and f.size]
    return out


def _row(line: bytes, save: int) -> dict:
    try:
        x = json.loads(line)
    except ValueError:
        x = None
    x = x if isinstance(x, dict) else {}
    text = lambda name: x[name] if isinstance(x.get(name), str) else None
    headers = {k: v for k, v in x["headers"].items() if isinstance(v, str)} if isinstance(x.get("headers"), dict) else None
    kind = next((v for k, v in (headers or {}).items() if k.lower() == "content-type"), None)
    status = x.get("status") if isinstance(x.get("status"), int) and not isinstance(x.get("status"), bool) else None
    return {"save": save, "url": text("url"), "status": status, "content_type": kind, "body": text("body"), "headers": list(headers.items()) if headers is not None else None, "final_url": text("final_url") or text("url")}


def read_file(part: Fetches) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("save", pa.int64()), ("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("final_url", pa.string())])
    files, _ = store(part.folder)
    rows = []
    with files.open_input_stream(part.path) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                rows.append(_row(line, part.save))
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
        if rest:
            rows.append(_row(rest, part.save))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kinds)


class FetchReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Fetches]:
        return saves(self.folder)

    def read(self, partition: Fetches) -> Iterator[pa.RecordBatch]:
        return read_file(partition) if partition is not None else iter(())


class FetchStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"save": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"save": max((p.save for p in saves(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Fetches]:
        return saves(self.folder, start["save"], end["save"])

    def read(self, partition: Fetches) -> Iterator[pa.RecordBatch]:
        return read_file(partition)


class SavedFetches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_fetches"

    def schema(self) -> str:
        return FETCHES

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options["path"])

    def streamReader(self, schema) -> FetchStream:  # noqa: N802
        return FetchStream(self.options["path"])


def fetched(spark, folder: str, stream: bool = False) -> DataFrame:
    """The fetches saved below ``folder``, as a table or a stream."""
    spark.dataSource.register(SavedFetches)
    return (spark.readStream if stream else spark.read).format("saved_fetches").load(folder)
