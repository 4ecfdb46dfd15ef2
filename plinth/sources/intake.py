"""Intake of downloaded files and payloads: a manifest of digests that is resumed, and findings instead of silent nulls."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.sources.io import ContractError

MANIFEST = "path string, length long, modified timestamp, sha256 string, status string"


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length and modified of the files below a folder; contents are not read.

    Spark's scan of binary files passes over empty ones, which a broken download leaves; they are added from the same listing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    full = files.select("path", "length", F.col("modificationTime").alias("modified"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    empty, paths = [], (jvm.org.apache.hadoop.fs.Path(p) for p in files.inputFiles())
    for path in paths:  # file names and sizes only, as Spark's own index of a folder holds
        status = path.getFileSystem(conf).getFileStatus(path)
        if status.getLen() == 0:
            empty.append((status.getPath().toString(), 0, status.getModificationTime()))
    rest = spark.createDataFrame(empty, "path string, length long, at long").select("path", "length", F.timestamp_millis("at").alias("modified"))
    return full.unionByName(rest)


def with_digests(files: DataFrame, part: int = 8 << 20) -> DataFrame:
    """`files` plus the sha-256 of each, streamed in parts of `part` bytes; each file is one task's, of any size."""
    fields = [f for f in files.schema.fields]
    at = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(at).to_pylist():
                fs, name = pafs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path)) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)
                digest = hashlib.sha256()
                with fs.open_input_stream(name) as stream:
                    while chunk := stream.read(part):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha256"])

    spread = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "path").mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "sha256 string"]))


def manifest(spark: SparkSession, folder: str, known: DataFrame | None = None, least_bytes: int = 1, glob: str = "*") -> DataFrame:
    """path, length, modified, sha256 and status of each file: kept (as `known` has it), read (new or changed), short (under `least_bytes`).

    Only files that are new or changed in length or time are read; a short file has no digest and is looked at again
    next time. Files that have gone are left out.
    """
    now = listed(spark, folder, glob)
    if known is None:
        known = spark.createDataFrame([], MANIFEST)
    good = known.where("status <> 'short'").select("path", "length", "modified", "sha256")
    kept = now.join(good, ["path", "length", "modified"]).withColumn("status", F.lit("kept"))
    rest = now.join(good, ["path", "length", "modified"], "left_anti")
    read = with_digests(rest.where(F.col("length") >= least_bytes)).withColumn("status", F.lit("read"))
    short = rest.where(F.col("length") < least_bytes).withColumns({"sha256": F.lit(None).cast("string"), "status": F.lit("short")})
    columns = ["path", "length", "modified", "sha256", "status"]
    return kept.select(columns).unionByName(read.select(columns)).unionByName(short.select(columns))


def manifest_gate(files: DataFrame) -> None:
    """Stops on files under the size floor, naming some."""
    short = [r["path"] for r in files.where("status = 'short'").orderBy("path").limit(5).collect()]
    if short:
        raise ContractError(f"files under the size floor, half written or error pages: {short}")


def payload_kind(payload: Column) -> Column:
    """What a payload is: missing, empty, html, not_json, error, wrong_shape (no object or list of objects) or ok."""
    value = F.try_parse_json(payload)
    # The kind of the value itself, not of what it holds.
    kind = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    items = F.regexp_extract(F.schema_of_variant(value), r"^ARRAY<(\w+)", 1)
    failed = F.try_variant_get(value, "$.error", "string").isNotNull()
    return (
        F.when(payload.isNull(), "missing").when(payload.rlike(r"^\s*$"), "empty").when(payload.rlike(r"^\s*<"), "html")
        .when(value.isNull(), "not_json").when((kind == "OBJECT") & failed, "error")
        .when((kind == "OBJECT") | ((kind == "ARRAY") & items.isin("OBJECT", "VOID")), "ok").otherwise("wrong_shape")
    )


def payload_findings(payloads: DataFrame, payload: str, fields: dict[str, str], key: str) -> DataFrame:
    """key, finding, detail: one row for each thing that is wrong with a payload; good payloads give none.

    `fields` are JSON paths and types that each object (or each object of a list) must have.
    """
    checked = payloads.select(F.col(key).alias("key"), F.col(payload).alias("_p"), payload_kind(F.col(payload)).alias("_kind"))
    bad = checked.where("_kind <> 'ok'").select("key", F.col("_kind").alias("finding"), F.substring("_p", 1, 80).alias("detail"))
    value = F.try_parse_json("_p")
    is_list = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1) == "ARRAY"
    rows = checked.where("_kind = 'ok'").select("key", F.when(is_list, F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value)).alias("_items"))
    each = rows.select("key", F.posexplode("_items").alias("_i", "_v"))
    found = F.array(*[
        F.when(F.try_variant_get("_v", path, kind).isNull(), F.struct(F.when(F.try_variant_get("_v", path, "string").isNull(), "missing_field").otherwise("wrong_type").alias("finding"), F.concat(F.lit(f"{path} of item "), F.col("_i")).alias("detail")))
        for path, kind in fields.items()
    ])
    return bad.unionByName(each.select("key", F.inline(F.array_compact(found))))


def payload_schema(payloads: DataFrame, payload: str) -> str | None:
    """The merged schema of all good payloads, as Spark writes it; None without any."""
    good = payloads.where(payload_kind(F.col(payload)) == "ok").select(F.try_parse_json(payload).alias("v"))
    return good.agg(F.schema_of_variant_agg("v")).first()[0] if not good.isEmpty() else None
