"""ZIP archives as a Spark source: a partition a member, decoded as a stream.

The directory of each archive is read once, for the partitions; a task opens its archive,
seeks its member, and decodes it from there, so an archive of twenty members is twenty
tasks, and no member is held as a whole. Archives lie in any store that Arrow's file
systems reach (a local or mounted path, hdfs://, s3://, gs://).

    register(spark)
    spark.read.format("zip_members").load("/data/archives/")       # what is in each member
    spark.read.format("zip_features").load("/data/a.zip")          # a row a segment and time set

Members of other kinds, encrypted ones and broken ones have a kind and sizes, and null
counts with the reason in `problem`. Folders are left out. An archive without members
gives no rows; a path without archives is an error. CSV rows are records (quoted line
breaks don't count), without the header; columns are those of the header. Of JSON
documents rows are the features, the items of an array, or one; columns are the distinct
keys of the properties, or of the items that are objects.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "archive string, member string, kind string, compressed long, size long, rows long, columns long, problem string"
FEATURES = "archive string, member string, segment_id long, frc int, street string, speed_limit double, distance double, geometry string, time_set int, date_range string, probes long"
TEXT_KINDS = ("csv", "json", "geojson")


class Member(InputPartition):
    def __init__(self, archive: str, name: str) -> None:
        self.archive, self.name = archive, name


def opened(archive: str):
    """A seekable stream of the file at a path or URI."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(archive) if "://" in archive or archive.startswith("file:") else (fs.LocalFileSystem(), archive)
    return store.open_input_file(path)


def listed(path: str) -> list[str]:
    """The archives at a path: itself, or those in a folder."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else []
    archives = sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
    if not archives:
        raise FileNotFoundError(f"no archive at {path}")
    return archives


def kind_of(name: str) -> str:
    last = name.rpartition("/")[2]
    return last.rpartition(".")[2].lower() if "." in last else ""


def json_items(text: io.TextIOBase, block: int = 1 << 16) -> Iterator[tuple[str, object]]:
    """("feature" | "item" | "document", value) of a JSON text: features of a collection, items of an array, else the document; decoded one after the other."""
    decoder, buffer = json.JSONDecoder(), ""
    more = True

    def fill() -> bool:
        nonlocal buffer, more
        part = text.read(block) if more else ""
        more = bool(part)
        buffer += part
        return more

    while not buffer.strip() and fill():
        pass
    buffer = buffer.lstrip("﻿ \t\r\n")
    what = "item" if buffer[:1] == "[" else "document"
    if buffer[:1] == "{":
        # Keys before the features are passed over value by value.
        buffer = buffer[1:]
        head = {}
        while True:
            buffer = buffer.lstrip(" \t\r\n,")
            if buffer[:1] == "}":
                yield "document", head
                return
            try:
                key, end = decoder.raw_decode(buffer)
                rest = buffer[end:].lstrip(" \t\r\n")
                if not rest.startswith(":"):
                    raise ValueError
                rest = rest[1:].lstrip(" \t\r\n")
                if key == "features" and rest[:1] == "[":
                    buffer, what = rest, "feature"
                    break
                value, end = decoder.raw_decode(rest)
                if end == len(rest):
                    raise ValueError  # a number may go on
                head[key], buffer = value, rest[end:]
            except ValueError:
                if not fill():
                    raise ValueError("the document breaks off") from None
    elif what == "document":
        while fill():
            pass
        yield what, decoder.raw_decode(buffer)[0]
        return
    buffer = buffer[1:]
    while True:
        buffer = buffer.lstrip(" \t\r\n,")
        if buffer[:1] == "]":
            return
        try:
            value, end = decoder.raw_decode(buffer)
            if end == len(buffer) and fill():
                continue
        except ValueError:
            if not fill():
                raise ValueError("the document breaks off") from None
            continue
        yield what, value
        buffer = buffer[end:]


def shape(stream: io.BufferedIOBase, kind: str) -> tuple[int, int]:
    """Rows and columns of a member, in one pass."""
    text = io.TextIOWrapper(stream, "utf-8-sig", newline="" if kind == "csv" else None)
    if kind == "csv":
        rows = csv.reader(text)
        head = next(rows, [])
        return sum(1 for _ in rows), len(head)
    n, names = 0, set()
    for what, value in json_items(text):
        n += 1
        fields = (value.get("properties") if what == "feature" else value) if isinstance(value, dict) else None
        names.update(fields if isinstance(fields, dict) else ())
    return n, len(names)


class MembersReader(DataSourceReader):
    """What is in each member."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Member]:
        out = []
        for archive in listed(self.path):
            with opened(archive) as f, zipfile.ZipFile(f) as z:
                out += [Member(archive, i.filename) for i in z.infolist() if not i.is_dir()]
        return out

    def read(self, partition: Member) -> Iterator[tuple]:
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            yield from self.rows(partition, z, z.getinfo(partition.name))

    def rows(self, partition: Member, z: zipfile.ZipFile, i: zipfile.ZipInfo) -> Iterator[tuple]:
        kind, n, width, problem = kind_of(i.filename), None, None, None
        if kind in TEXT_KINDS:
            try:
                with z.open(i) as stream:
                    n, width = shape(stream, kind)
            except (ValueError, RuntimeError, zipfile.BadZipFile, EOFError) as e:
                problem = f"{type(e).__name__}: {e}"[:200]
        yield partition.archive, i.filename, kind, i.compress_size, i.file_size, n, width, problem


class FeaturesReader(MembersReader):
    """A row for each segment and time set of the GeoJSON members."""

    def partitions(self) -> list[Member]:
        return [m for m in super().partitions() if kind_of(m.name) in ("json", "geojson")]

    def rows(self, partition: Member, z: zipfile.ZipFile, i: zipfile.ZipInfo) -> Iterator[tuple]:
        number = lambda x: None if x is None else float(x)
        with z.open(i) as stream:
            for what, f in json_items(io.TextIOWrapper(stream, "utf-8-sig")):
                q = f.get("properties") or {} if what == "feature" and isinstance(f, dict) else {}
                if q.get("segmentId") is None:
                    continue
                line = json.dumps((f.get("geometry") or {}).get("coordinates"))
                for c in q.get("segmentProbeCounts") or []:
                    yield partition.archive, i.filename, q["segmentId"], q.get("frc"), q.get("streetName"), number(q.get("speedLimit")), number(q.get("distance")), line, c.get("timeSet"), str(c.get("dateRange")), c.get("probeCount")


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options["path"])


class ZipFeatures(ZipMembers):
    @classmethod
    def name(cls) -> str:
        return "zip_features"

    def schema(self) -> str:
        return FEATURES

    def reader(self, schema) -> FeaturesReader:
        return FeaturesReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (ZipMembers, ZipFeatures):
        spark.dataSource.register(source)
