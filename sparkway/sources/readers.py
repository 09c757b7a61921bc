"""Sources and sinks: Parquet, CSV, GraphML, nested GeoJSON in ZIP files, JSON, cached tables, run exports."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archives


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header and a given schema; no inference pass."""
    return spark.read.csv(path, header=True, schema=schema)


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: attributes as columns, by the names that the keys declare."""
    def read(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    keys = {r["_id"]: r["_attr.name"] for r in read("key", "`_id` string, `_attr.name` string, `_for` string").select("_id", "`_attr.name`").collect()}  # one a declared attribute
    data = "data array<struct<_VALUE: string, _key: string>>"

    def spread(df: DataFrame, base: dict[str, str]) -> DataFrame:
        m = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(d["_key"], d["_VALUE"])))
        return df.select(*(F.col(f"`{a}`").alias(b) for a, b in base.items()), *(m[k].alias(n) for k, n in keys.items()))

    nodes = spread(read("node", f"`_id` string, {data}"), {"_id": "id"})
    edges = spread(read("edge", f"`_source` string, `_target` string, `_id` string, {data}"), {"_source": "u", "_target": "v", "_id": "key"})
    return nodes, edges


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """What is in each member of the archives at a path: see `archives`."""
    archives.register(spark)
    return spark.read.format("zip_members").load(path)


def zipped_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each segment and time set of the GeoJSON members of the archives at a path."""
    archives.register(spark)
    return spark.read.format("zip_features").load(path)


def write_archives(members: DataFrame, path: str, place: str | None = None, frames: dict[str, tuple[str, str, str]] | None = None) -> int:
    """Texts (archive, member, text) as ZIP files <path>/<archive>.zip, each written by a task as a stream; how many there are.

    With `place`, rows of one member are its pieces, in that order. `frames`: ending of a
    member's name -> what stands before its first piece, between two, and after the last.
    A task holds a batch of rows; a file gets its name when it is done. Names that are null
    are left out.
    """
    from pyspark import TaskContext

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        part = f".{TaskContext.get().taskAttemptId()}.part"
        at, f, z, m, after = (None, None), None, None, None, ""

        def close_member():
            if m is not None:
                m.write(after.encode())
                m.close()

        def close_archive() -> pa.RecordBatch:
            z.close()
            f.close()
            done = f"{inner}/{at[0]}.zip"
            if store.get_file_info(done).type != fs.FileType.NotFound:
                store.delete_file(done)
            store.move(f"{inner}/{at[0]}{part}", done)
            return pa.RecordBatch.from_arrays([pa.array([at[0]])], names=["archive"])

        for batch in batches:
            for archive, member, text in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "text")), strict=True):
                text = text or ""
                if (archive, member) == at and place:
                    m.write((between + text).encode())
                    continue
                close_member()
                if archive != at[0]:
                    if z is not None:
                        yield close_archive()
                    store.create_dir(inner, recursive=True)
                    f = store.open_output_stream(f"{inner}/{archive}{part}")
                    z = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED)
                at = (archive, member)
                before, between, after = next((v for ending, v in (frames or {}).items() if member.endswith(ending)), ("", "", ""))
                m = z.open(member, "w", force_zip64=True)
                m.write((before + text).encode())
        close_member()
        if z is not None:
            yield close_archive()

    order = ["archive", "member", place or "text"]
    named = members.where("archive is not null and member is not null").select(*order, *(["text"] if place else []))
    return named.repartition("archive").sortWithinPartitions(*order).mapInArrow(write, "archive string").count()


KINDS = ("feature", "feature_collection", "facilities", "object", "list", "value", "broken")


def json_kind(column: str) -> Column:
    """What a JSON text is, by its VARIANT: a feature, a collection of features, a document with facilities, another object, a list, another value; broken if it is none."""
    v = F.try_parse_json(column)
    top = F.schema_of_variant(v)
    kind = F.try_variant_get(v, "$.type", "string")
    has = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    is_object = top.startswith("OBJECT")
    return F.when(F.col(column).isNull(), None).when(v.isNull(), "broken").when(is_object & has("features"), "feature_collection").when(is_object & (kind == "Feature"), "feature").when(is_object & has("facilities"), "facilities").when(is_object, "object").when(top.startswith("ARRAY"), "list").otherwise("value")


def json_shapes(df: DataFrame, column: str) -> DataFrame:
    """kind, n and schema of the JSON texts in a column: documents of one kind are merged to one schema. Null texts are left out."""
    rows = df.where(F.col(column).isNotNull()).select(json_kind(column).alias("kind"), F.try_parse_json(column).alias("_v"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.schema_of_variant_agg("_v").alias("schema"))


def documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON."""
    return spark.read.schema(schema).json(path, multiLine=True)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at `path`; computed and written first if it isn't there, or if asked again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if again or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """For small results: one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json_summary(df: DataFrame, path: str) -> None:
    """Rows as one JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_run(df: DataFrame, path: str, run_id: str, kind: str = "parquet") -> None:
    """Appends a run's rows as a partition, as parquet, csv (with a header) or json."""
    options = {"header": True} if kind == "csv" else {}
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(kind).options(**options).save(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, kind, bytes, modified of every file under a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), F.element_at(F.split(name, r"\."), -1).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, in any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_graphml(edges: DataFrame, path: str) -> None:
    """Edges (u, v, key, attributes) as one GraphML file, for networks of a size that one file suits."""
    attributes = [c for c in edges.columns if c not in ("u", "v", "key")]
    text = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = [F.concat(F.lit(f'<data key="d{i}">'), text(c), F.lit("</data>")) for i, c in enumerate(attributes)]
    edge = F.concat(F.lit('<edge source="'), text("u"), F.lit('" target="'), text("v"), F.lit('" id="'), text("key"), F.lit('">'), *data, F.lit("</edge>"))
    node = F.concat(F.lit('<node id="'), text("id"), F.lit('"/>'))
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    head = "".join(f'<key id="d{i}" for="edge" attr.name="{c}" attr.type="string"/>' for i, c in enumerate(attributes))
    lines = nodes.select(F.lit(1).alias("o"), node.alias("value")).union(edges.select(F.lit(2), edge))
    ends = edges.sparkSession.createDataFrame([(0, f'<graphml>{head}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "o int, value string")
    lines.union(ends).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
