"""Typed scans and guarded sinks.

Scans are declared: every column a string unless a schema says otherwise,
missing values by token, and required tables checked before any work.
"""

from __future__ import annotations

import glob
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.keys import NULL_TOKENS, null_if_blank


class ContractError(ValueError):
    """A declared requirement on data does not hold."""


# scans ---------------------------------------------------------------------


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A parquet table, pruned to `columns` where given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", header: bool = True, quote: str = '"', null_value: str = "") -> DataFrame:
    """Delimited text under a declared schema; a bad row stops the scan."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("quote", quote).option("nullValue", null_value).option("mode", "FAILFAST").option("enforceSchema", False if header else True)
    return reader.csv(path)


def read_csv_strings(spark: SparkSession, path: str, names: Sequence[str] | None = None, sep: str = ",", quote: str = '"') -> DataFrame:
    """Every column a string with its literal text: `NA` stays, an empty field is the empty string."""
    reader = spark.read.option("header", names is None).option("sep", sep).option("quote", quote).option("nullValue", "\x00").option("emptyValue", "").option("inferSchema", False)
    if names is not None:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    df = reader.csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_headless(spark: SparkSession, path: str, names: Sequence[str], is_title: Column | None = None, sep: str = ",") -> DataFrame:
    """A file without a header whose title rows, recognised by a predicate, go."""
    df = read_csv_strings(spark, path, names, sep)
    return df.where(~is_title) if is_title is not None else df


def with_null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, columns: Iterable[str] | None = None) -> DataFrame:
    """String columns with blank tokens as nulls."""
    chosen = set(columns if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*[null_if_blank(F.col(f"`{c}`"), tokens).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts that give null where the text doesn't fit."""
    return df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """`file`, and `value`, a line or the whole text."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_name").alias("file"), "value")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of `key = value` lines; comments and blank lines go."""
    line = F.btrim(F.col("value"))
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#") & line.contains("="))
    pair = F.split(F.col("value"), "=", 2)
    return rows.select(F.btrim(pair[0]).alias("key"), F.btrim(pair[1]).alias("value"))


def read_records(spark: SparkSession, path: str, fields: Sequence[str], sep: str = r"\s+", comment: str = "#") -> DataFrame:
    """One record for each line (a lockfile, say): fields parted by a pattern; comments and blank lines go, a line with too few fields is an error."""
    line = F.btrim(F.col("value"))
    rows = spark.read.text(path).where((line != "") & ~line.startswith(comment))
    parts = F.split(line, sep, len(fields))
    bad = F.raise_error(F.concat(F.lit(f"{len(fields)} fields needed: "), line)).cast("array<string>")
    checked = F.when(F.size(parts) < len(fields), bad).otherwise(parts)
    return rows.select(*[F.get(checked, F.lit(i)).alias(n) for i, n in enumerate(fields)])


def require_tables(spark: SparkSession, folder: str, tables: Mapping[str, int]) -> None:
    """Tables that must be there with at least so many rows; counts come from one small aggregate each."""
    for name, least in tables.items():
        try:
            found = read_table(spark, folder, name).limit(max(least, 1)).count()
        except Exception as e:
            raise ContractError(f"table {name} can't be read in {folder}") from e
        if found < max(least, 1):
            raise ContractError(f"table {name} has {found} rows, {max(least, 1)} needed")


def require_input(name: str, value: str | None, what: str = "input") -> str:
    """A setting that must be given; nothing stands in for it."""
    if not value:
        raise ContractError(f"{what} {name} is not set")
    return value


def resolve_one(pattern: str, spark: SparkSession | None = None) -> str:
    """The one path that fits a pattern; none or several are an error. With a session, in any store that Spark reads."""
    if spark is None:
        found = sorted(glob.glob(pattern))
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = sorted(s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])
    if len(found) != 1:
        raise ContractError(f"{pattern}: {len(found)} paths fit, one needed")
    return found[0]


def parameters(args: Sequence[str], **defaults: str | bool) -> dict[str, str | bool]:
    """`--key=value` and `--flag` arguments over defaults; an unknown one is an error."""
    out: dict[str, str | bool] = dict(defaults)
    for arg in args:
        key, eq, value = arg.removeprefix("--").partition("=")
        key = key.replace("-", "_")
        if not arg.startswith("--") or key not in out:
            raise ContractError(f"unknown argument {arg}")
        out[key] = value if eq else True
    return out


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the sink yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def column_named(df: DataFrame, name: str) -> str | None:
    """The column of that name in any case, null if absent; two are an error."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) > 1:
        raise ContractError(f"{name} fits {found}")
    return found[0] if found else None


# sinks ---------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, fields: Sequence[str] = (), null_value: str = "", mode: str = "errorifexists") -> None:
    (df.select(*fields) if fields else df).write.mode(mode).option("header", True).option("nullValue", null_value).csv(path)


def write_cells(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV whose cells can hold quotes (doubled), separators, line ends and blanks at their ends; `read_cells` gives them back."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)


def read_cells(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What `write_cells` wrote: a record can go over several lines. An empty text comes back as null, as in all CSV here."""
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "FAILFAST", "lineSep": "\n"}
    return spark.read.schema(schema).options(**options).csv(path)


def write_sorted(df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str]) -> None:
    """Declared columns in a total order, by range partitions; refuses to overwrite."""
    df.select(*fields).orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_bundle(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One parquet table for each result."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose keys are not in `new`, and all of `new`."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_table(df: DataFrame, path: str, apply: bool = False, backup: bool | str = True) -> dict[str, object]:
    """Write beside, then swap by renames; without `apply` only says what would happen.

    The old table is kept under a new name, so a reader never meets half a table. With `backup="once"` the first
    state is kept as `<path>.original` and later ones are not.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    exists = bool(fs.exists(target))
    plan: dict[str, object] = {"path": path, "replaces": exists, "columns": df.columns, "applied": apply}
    if not apply:
        return plan
    mark = uuid.uuid4().hex
    df.write.parquet(f"{path}.new-{mark}")
    if exists:
        name = f"{path}.old-{mark}"
        if backup == "once":
            first = f"{path}.original"
            backup, name = (False, name) if fs.exists(jvm.org.apache.hadoop.fs.Path(first)) else (True, first)
        kept = jvm.org.apache.hadoop.fs.Path(name)
        fs.rename(target, kept)
        plan["backup"] = name if backup else None
        if not backup:
            fs.delete(kept, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.new-{mark}"), target)
    return plan


def content_digest(df: DataFrame) -> Column:
    """Aggregate: sha-256 of the rows' count, hash sum and column names, whatever their order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.lit(",".join(sorted(df.columns)))), 256)


def provenance(df: DataFrame, output: str, sources: Sequence[str] | Mapping[str, DataFrame], stamp: str) -> DataFrame:
    """Rows of a sidecar: output, role, name, run stamp, rows and digest of the result and of each source given as a table; the stamp stays out of the data."""
    tables = {("output", output): df}
    if isinstance(sources, Mapping):
        tables.update({("source", k): v for k, v in sources.items()})
    out = None
    for (role, name), part in tables.items():
        one = part.agg(F.count("*").alias("n_rows"), content_digest(part).alias("digest"))
        one = one.select(F.lit(output).alias("output"), F.lit(role).alias("role"), F.lit(name).alias("name"), F.lit(stamp).alias("run_stamp"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    if not isinstance(sources, Mapping):
        named = df.sparkSession.createDataFrame([(output, "source", s, stamp, None, None) for s in sources], "output string, role string, name string, run_stamp string, n_rows long, digest string")
        out = out.unionByName(named)
    return out


def choice_list(df: DataFrame, code: str, label: str) -> DataFrame:
    """One row: `code, label` joined by ` | ` in code order; a choice list is small by its nature."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), F.col(label).cast("string").alias("l"))))
    lines = F.transform(pairs, lambda x: F.concat(x["c"].cast("string"), F.lit(", "), x["l"]))
    return df.agg(F.array_join(lines, " | ").alias("choices"))


def titled_sheet(df: DataFrame, titles: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`pos`, `line`: title lines, then the rows as CSV lines in order."""
    from plinth.operators.ranges import number

    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields])
    body = number(df.select(*dict.fromkeys([*fields, *order])), order, "pos", len(titles) + 1).select("pos", line.alias("line"))
    head = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(titles)], "pos long, line string")
    return head.unionByName(body)


def edit_dictionary(df: DataFrame, pos: str, key: str, replace: Mapping[str, Mapping[str, str]] | None = None, drop: Sequence[str] = (), insert_after: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Ordered dictionary rows with cells replaced, rows dropped, and rows put after named ones; `pos` is numbered anew."""
    from plinth.operators.ranges import number

    out = df.where(~F.col(key).isin(*drop)) if drop else df
    for name, cells in (replace or {}).items():
        out = out.withColumns({c: F.when(F.col(key) == name, F.lit(v)).otherwise(F.col(c)) for c, v in cells.items()})
    out = out.withColumn("_sub", F.lit(0))
    for after, cells in (insert_after or {}).items():
        made = out.where(F.col(key) == after).select(F.col(pos), F.lit(1).alias("_sub"), *[F.lit(cells.get(c)).cast(out.schema[c].dataType).alias(c) for c in df.columns if c != pos])
        out = out.unionByName(made)
    kept = out.withColumnRenamed(pos, "_old")
    return number(kept, ["_old", "_sub"], pos, 1).select(*[F.col(c).cast("int") if c == pos else F.col(c) for c in df.columns])


def report_lines(findings: DataFrame, title: str) -> str:
    """Markdown of a small findings table; at most a thousand rows are rendered and the rest counted."""
    rows = findings.limit(1001).collect()
    head = "| " + " | ".join(findings.columns) + " |"
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:1000]]
    more = ["", "and more rows"] if len(rows) > 1000 else []
    return "\n".join([f"# {title}", "", head, "|" + "---|" * len(findings.columns), *body, *more, ""])


