"""Activity sources: yearly files, all-string CSV scans, pruned scans, null sentinels, typed scans.

The landed form is Parquet partitioned by year (see ``sinks.write_by_year``):
reading it with a year list is plain partition pruning. CSV readers exist for
the yearly downloads and for files exchanged with other tools.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens._compat import ColumnOrName, as_col, qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.sources import csv_records
from spendlens.sources.evolve import collate, read_landed

# Strings that a default pandas CSV read turns into missing values.
NA_SENTINELS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# CSV dialect of the exchanged files: RFC-4180 quotes, quotes doubled inside
# fields, fields may hold newlines.
CSV_READ_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "inferSchema": "false",
    "mode": "FAILFAST",  # a row with more cells than the header is an error, not cut off
    "columnPruning": "false",  # so that such a row is seen whatever columns are read
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# Headers asked for at a time: each is a small job that reads one line.
HEADERS_AT_ONCE = 16

# Bytes of CSV files that are not worth a task of their own.
SMALL_SPLIT = 8 << 20

# Name Spark gives to a blank header cell, i.e. a leaked row-index column.
LEAKED_INDEX_COLUMNS = ("_c0", "Unnamed: 0")


def _files(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, int]]:
    """The data files under the paths or patterns, by name: path → address, as a scan's
    ``_metadata.file_path`` gives it, and bytes. Only the listing is read."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", F.col("_metadata.file_path").alias("address"), "length").collect() for p in paths]
    return {path: (address, length) for rows in found for path, address, length in sorted(map(tuple, rows))}


def _by_header(spark: SparkSession, files: Sequence[str], options: dict[str, str]) -> dict[tuple[str, ...], list[str]]:
    """The files grouped by their header: a reader takes one header for all its files."""
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda f: tuple(spark.read.options(**options).csv(f).columns), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files, strict=True):
        out.setdefault(header, []).append(file)
    return out


def _without_index(df: DataFrame, drop_index: bool) -> DataFrame:
    leaked = [c for c in df.columns if c in LEAKED_INDEX_COLUMNS] if drop_index else []
    return df.drop(*leaked) if leaked else df


def read_csv_records(spark: SparkSession, paths: str | Sequence[str], drop_index: bool = True) -> DataFrame:
    """Every record of the files, all columns as strings, aligned by header name, and
    ``csv_records.RECORD``: where the record stands in file order, its raw form, and whether
    it has surplus cells (``csv_records.sound`` and ``rejected`` tell them apart). Quoted
    line breaks are read right, and each file is still read by many tasks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = _files(spark, paths)
    groups = _by_header(spark, list(files), CSV_READ_OPTIONS)
    if not groups:
        raise ValueError(f"no CSV files at {paths}")
    parsed = [csv_records.parse(spark, group, header, CSV_READ_OPTIONS, [address for address, _ in files.values()]) for header, group in groups.items()]
    # splits below this size are read one after another in a task
    tasks = max(1, -(-sum(length for _, length in files.values()) // SMALL_SPLIT))
    return _without_index(collate(parsed), drop_index).coalesce(tasks)


def read_csv_strings(spark: SparkSession, paths: str | Sequence[str], drop_index: bool = True, multi_line: bool = True) -> DataFrame:
    """Every column as a string, header names kept, files aligned by name; a leaked index
    column is dropped. A row with more cells than its header is an error.

    ``multi_line`` (default) reads quoted fields that contain newlines, in parallel (see
    ``csv_records``). Files known to hold none can pass ``multi_line=False``, which saves
    the shuffles that put records together.
    """
    if multi_line:
        df = read_csv_records(spark, paths, drop_index)
        r = F.col(csv_records.RECORD)
        fail = F.raise_error(F.concat(F.lit("more cells than the header in "), r["file"], F.lit(": "), F.substring(r["record"], 1, 200)))
        return df.where(F.when(r["surplus"], fail.cast("boolean")).otherwise(F.lit(True))).drop(csv_records.RECORD)
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {**CSV_READ_OPTIONS, "multiLine": "false"}
    groups = _by_header(spark, list(_files(spark, paths)), options)
    frames = [spark.read.options(**options).csv(files) for files in groups.values()]
    return _without_index(collate(frames) if frames else spark.read.options(**options).csv(paths), drop_index)


def normalize_nulls(df: DataFrame, columns: Iterable[str] | None = None, sentinels: Sequence[str] = NA_SENTINELS) -> DataFrame:
    """Exact sentinel strings become NULL in the given (default: all string) columns."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(columns) if columns is not None else string_cols
    values = list(sentinels)
    return df.select(
        *[
            F.when(qcol(c).isin(values), F.lit(None).cast("string")).otherwise(qcol(c)).alias(c)
            if c in targets and c in string_cols
            else qcol(c)
            for c in df.columns
        ]
    )


def with_default_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add each missing column as a typed NULL (``name -> spark type``)."""
    for name, dtype in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def scan_pruned(df: DataFrame, columns: Sequence[str], dtype: str = "string") -> DataFrame:
    """Keep ``columns`` only; a column the source lacks is added as a typed NULL
    instead of failing the read. Catalyst prunes the scan to these columns."""
    return with_default_columns(df, {c: dtype for c in columns}).select(*[qcol(c) for c in columns])


def to_number(c: ColumnOrName, dtype: str = "int") -> Column:
    """Numeric value of a code held as text (``' 2024 '``, ``'2024.0'``); NULL if not a number."""
    return _to_number(F.trim(as_col(c).cast("string")), dtype)


def _to_number(s: Column, dtype: str) -> Column:
    d = s.try_cast("double")
    if dtype == "double":
        return d
    # exact integer text first (no detour through double, which rounds above 2^53);
    # then integral decimals such as '2024.0'; '2024.5' or 'abc' give NULL, never an error
    return F.coalesce(s.try_cast(dtype), F.when(d == F.floor(d), d).try_cast(dtype))


def to_boolean(c: ColumnOrName) -> Column:
    """Text flag → boolean (``True``/``False``/``1``/``0``…, any case); empty or unknown → NULL."""
    return F.trim(as_col(c).cast("string")).try_cast("boolean")


def scan_typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named string columns with ``try_cast`` (bad value → NULL, never an error);
    other columns pass through untouched."""
    out = []
    for c in df.columns:
        t = types.get(c)
        if t is None:
            out.append(qcol(c))
        elif t == "boolean":
            out.append(to_boolean(qcol(c)).alias(c))
        elif t in ("int", "integer", "long", "bigint", "double"):
            out.append(_to_number(F.trim(qcol(c).cast("string")), t).alias(c))
        else:
            out.append(qcol(c).try_cast(t).alias(c))
    return df.select(*out)


def read_years(
    spark: SparkSession,
    location: str,
    years: Iterable[int] | None,
    fmt: str = "parquet",
    fields: Fields = DEFAULT,
    multi_line: bool = True,
) -> DataFrame:
    """Activities of the given years.

    ``location`` is either a year-partitioned table root (``.../Year=2024/``
    layout, read with partition pruning and the columns of all its years, see
    ``evolve.read_landed``) or a path pattern with a ``{year}`` slot, one file or folder
    per year, collated by name.
    """
    if "{year}" not in location:
        if fmt == "parquet":
            return read_landed(spark, location, years, fields)
        df = spark.read.format(fmt).load(location) if fmt != "csv" else read_csv_strings(spark, location, multi_line=multi_line)
        if years is None:
            return df
        return df.where(F.col(fields.year).isin(sorted({int(y) for y in years})))
    if years is None:
        raise ValueError("a {year} path pattern needs an explicit year list")
    years = sorted({int(y) for y in years})
    frames = []
    for y in years:
        path = location.format(year=y)
        part = read_csv_strings(spark, path, multi_line=multi_line) if fmt == "csv" else spark.read.format(fmt).load(path)
        if fields.year not in part.columns:
            part = part.withColumn(fields.year, F.lit(y).cast("int"))
        frames.append(part)
    return collate(frames)


def positive_amount(df: DataFrame, amount: str | None = None, fields: Fields = DEFAULT) -> DataFrame:
    """Rows with a strictly positive amount (NULL, zero, negative and text that is no number
    dropped); on a numeric column the filter is pushed into the scan."""
    col = amount or fields.amount
    text = isinstance(df.schema[col].dataType, T.StringType)
    return df.where((to_number(qcol(col), "double") if text else qcol(col).cast("double")) > 0)


def add_ordinal(df: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """Attach an ingest ordinal once, at landing time, so first-wins dedup has a
    stable order afterwards; it is persisted with the landed table and never recomputed.
    Rows read from CSV files have one already, in file order (``csv_records.ordinal``);
    for any other input it is the order of Spark's partitions."""
    if fields.ordinal in df.columns:
        return df
    return df.withColumn(fields.ordinal, F.monotonically_increasing_id())
