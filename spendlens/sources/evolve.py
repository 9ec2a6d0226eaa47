"""Tables whose years were landed at different times, and with different columns.

Each year's folder is written by one job and has one schema. Reading asks one file a
year for it, groups the years by schema, and collates one scan a group: a column that
only some years have is NULL elsewhere, and a column whose type changed gets a type that
holds all its values. The scans keep partition pruning and column pruning.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens._compat import qcol
from spendlens.fields import DEFAULT, Fields

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
_MOMENT = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Schemas asked for at a time: each is a small job that reads one footer.
ASKED_AT_ONCE = 8


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: the wider whole number, double for other
    numbers, the moment for dates and moments, else text. Nested types have to agree."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, _NUMBER) and isinstance(b, _NUMBER):
        return T.DoubleType()
    if isinstance(a, _MOMENT) and isinstance(b, _MOMENT):
        return T.TimestampNTZType() if T.TimestampNTZType() in (a, b) and T.TimestampType() not in (a, b) else T.TimestampType()
    if any(isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for t in (a, b)):
        raise ValueError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def reconcile(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns of the schemas, in the order of their first appearance, each with a type
    that holds its values in all of them. Names are matched as Spark does, without case."""
    found: dict[str, tuple[str, T.DataType]] = {}
    for schema in schemas:
        for f in schema.fields:
            name, known = found.get(f.name.lower(), (f.name, f.dataType))
            found[f.name.lower()] = name, common_type(known, f.dataType)
    return T.StructType([T.StructField(name, kind) for name, kind in found.values()])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast, and NULL where it has none."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in schema.fields:
        own = have.get(f.name.lower())
        if own is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append((qcol(own.name) if own.dataType == f.dataType else qcol(own.name).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def collate(frames: Sequence[DataFrame]) -> DataFrame:
    """Union-all by column name; a column missing from some frames is NULL there, and one
    with several types gets a common one."""
    if not frames:
        raise ValueError("nothing to collate")
    if len(frames) == 1:
        return frames[0]
    schema = reconcile([f.schema for f in frames])
    return reduce(lambda a, b: a.union(b), [conform(f, schema) for f in frames])


def partition_folders(spark: SparkSession, root: str, column: str) -> dict[str, str]:
    """Partition value (as in the folder's name, decoded) → folder, of a table's first level."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return {unquote(n.split("=", 1)[1]): f"{root.rstrip('/')}/{n}" for n in sorted(names) if n.startswith(f"{column}=")}


def drop_partitions(spark: SparkSession, root: str, column: str, values: Iterable) -> None:
    """Remove the folders of these partition values, if there."""
    folders = partition_folders(spark, root, column)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for v in values:
        if str(v) in folders:
            path = jvm.org.apache.hadoop.fs.Path(folders[str(v)])
            path.getFileSystem(conf).delete(path, True)


def read_landed(spark: SparkSession, root: str, years: Iterable[int] | None = None, fields: Fields = DEFAULT) -> DataFrame:
    """The year-partitioned Parquet table at ``root`` with the columns of all years that are
    asked for (all by default). A table without year folders is read as it is."""
    folders = partition_folders(spark, root, fields.year)
    wanted = None if years is None else sorted({int(y) for y in years})
    if wanted is not None:
        chosen = {v: p for v, p in folders.items() if v.isdigit() and int(v) in wanted}
        folders = chosen or dict(list(folders.items())[:1])  # no such year: the columns of one, and no rows
    if not folders:
        df = spark.read.parquet(root)
    else:
        with ThreadPoolExecutor(ASKED_AT_ONCE) as pool:
            schemas = list(pool.map(lambda p: spark.read.parquet(p).schema, folders.values()))
        groups: dict[str, tuple[T.StructType, list[str]]] = {}
        for schema, folder in zip(schemas, folders.values(), strict=True):
            kind = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
            groups.setdefault(kind.json(), (kind, []))[1].append(folder)
        year = T.StructField(fields.year, T.IntegerType())
        scans = [spark.read.schema(T.StructType([*kind.fields, year])).option("basePath", root).parquet(*paths) for kind, paths in groups.values()]
        df = collate(scans)
        # the partition column comes last, as in a plain read
        df = df.select(*[qcol(c) for c in df.columns if c != fields.year], qcol(fields.year))
    return df if wanted is None else df.where(F.col(fields.year).isin(wanted))
