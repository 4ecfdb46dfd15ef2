"""A partitioned source of recorded registry responses, with the state filter pushed down and a nationwide fallback.

A snapshot is a folder `state=<XX>/` with files of one JSON response a line, as
the registry gives them: `{"result_count": n, "results": [...]}` with nested
basic, addresses and taxonomies. Each file is a partition of the source; an
equality on `state` (or a list) leaves out the files of other states before any
task starts. Files are read by pyarrow's file systems, so a snapshot can lie
wherever pyarrow can read. A response that holds `Errors` or is no JSON object
is an error that names the file (`onError=skip` leaves it out).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "state string, number string, first_name string, last_name string, credential string, sex string, city string, taxonomy string, is_primary boolean"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


class ResponseFile(InputPartition):
    def __init__(self, state: str, path: str):
        self.state, self.path = state, path


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.skip = options["path"].rstrip("/"), options.get("onerror", "fail") == "skip"
        self.states: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = None
            if isinstance(f, EqualTo) and f.attribute == ("state",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("state",):
                wanted = set(f.value)
            if wanted is None:
                yield f
            else:
                self.states = wanted if self.states is None else self.states & wanted

    def partitions(self) -> Sequence[InputPartition]:
        fs, folder = _located(self.folder)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(folder, recursive=True)):
            found = re.search(r"/state=([^/]+)/([^/]+)$", info.path)
            if info.type == pafs.FileType.File and found and not found[2].startswith(("_", ".")) and (self.states is None or found[1] in self.states):
                out.append(ResponseFile(found[1], info.path))
        return sorted(out, key=lambda p: p.path) or [ResponseFile("", "")]

    def read(self, partition: ResponseFile) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = _located(self.folder)
        with fs.open_input_stream(partition.path) as lines:
            for raw in _lines(lines):
                yield from self.rows(raw, partition)

    def rows(self, raw: bytes, partition: ResponseFile) -> Iterator[tuple]:
        try:
            response = json.loads(raw)
            wrong = not isinstance(response, dict) or "Errors" in response or not isinstance(response.get("results", []), list)
        except ValueError:
            wrong = True
        if wrong:
            if self.skip:
                return
            raise ValueError(f"{partition.path}: not a registry response: {raw[:200]!r}")
        for hit in response.get("results", []):
            basic, kinds = hit.get("basic") or {}, hit.get("taxonomies") or []
            kind = next((k for k in kinds if k.get("primary")), kinds[0] if kinds else {})
            home = next((a for a in hit.get("addresses") or [] if a.get("address_purpose") == "LOCATION"), {})
            yield (partition.state, hit.get("number"), basic.get("first_name"), basic.get("last_name"), basic.get("credential"), basic.get("sex"), home.get("city"), kind.get("code"), kind.get("primary"))


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream, read in parts."""
    rest = b""
    while part := stream.read(size):
        *whole, rest = (rest + part).split(b"\n")
        yield from (line for line in whole if line.strip())
    if rest.strip():
        yield rest


class RegistrySnapshot(DataSource):
    """`spark.read.format("registry_snapshot").load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "registry_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RegistryReader:
        return RegistryReader(self.options)


def read_snapshot(spark: SparkSession, folder: str, on_error: str = "fail") -> DataFrame:
    """The records of a snapshot; registers the source where that has not been done."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySnapshot)
    return spark.read.format("registry_snapshot").option("onError", on_error).load(folder)


def write_snapshot(records: DataFrame, folder: str, state: str, record: Column, key: str, page: int = 200, pages: int = 16) -> None:
    """Responses of about `page` records a line, one folder for each state; `pages` is a bound on lines that a hash of the key deals a state into."""
    sized = records.groupBy(state).agg(F.least(F.ceil(F.count("*") / page), F.lit(pages)).alias("_pages"))
    dealt = records.join(sized, state).withColumn("_page", F.pmod(F.xxhash64(key), F.col("_pages")))
    lines = dealt.groupBy(F.col(state).cast("string").alias("state"), "_page").agg(F.count("*").alias("result_count"), F.array_sort(F.collect_list(F.to_json(record))).alias("_r"))
    text = F.concat(F.lit('{"result_count":'), F.col("result_count"), F.lit(',"results":['), F.array_join("_r", ","), F.lit("]}"))
    lines.select("state", text.alias("value")).write.partitionBy("state").text(folder)


def looked_up(providers: DataFrame, registry: DataFrame, names: Sequence[str], state: str = "state") -> DataFrame:
    """Each provider's columns plus scope, n_hits and number (the least): hits of its name in its state, else of its name anywhere.

    `names` are columns of both; a null state is looked up nationwide, a null name finds nothing. Two joins on equal
    keys over one aggregate of the registry: no pairs of providers and records are made.
    """
    by_state = registry.groupBy(*names, state).agg(F.count_distinct("number").alias("_n1"), F.min("number").alias("_first1"))
    anywhere = registry.groupBy(*names).agg(F.count_distinct("number").alias("_n2"), F.min("number").alias("_first2"))
    out = providers.join(by_state, [*names, state], "left").join(anywhere, list(names), "left")
    scope = F.when(F.col("_n1") > 0, "state").when(F.col("_n2") > 0, "nationwide").otherwise("none")
    return out.select(*providers.columns, scope.alias("scope"), F.coalesce("_n1", "_n2", F.lit(0)).alias("n_hits"), F.coalesce("_first1", "_first2").alias("number"))
