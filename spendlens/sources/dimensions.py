"""Small dimensions: purpose-code names, finance category groups, taxonomy classes.

Dimensions with a fixed, tiny domain are applied as literal map lookups (no join
at all); a user-supplied sector list is an ordinary left join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens._compat import ColumnOrName, as_col
from spendlens.taxonomy import Taxonomy

# Purpose-code names used by the housing marker and the checks.
# The complete purpose-code list (about 300 codes) is a parameter: pass it to
# ``sector_lookup`` as a mapping, a DataFrame or a two-column CSV (code, name).
DEFAULT_SECTOR_NAMES = {
    "11110": "Education policy and administrative management",
    "16030": "Housing policy and administrative management",
    "16040": "Low-cost housing",
    "43030": "Urban development and management",
}

# Finance category codes, their names, and the report groups.
CATEGORY_NAMES = {
    "10": "ODA",
    "21": "Non-export credit OOF",
    "22": "Officially supported export credits",
    "30": "Private Development Finance",
    "36": "Private Foreign Direct Investment",
    "37": "Other Private flows at market terms",
    "40": "Non flow",
    "50": "Other flows",
    "60": "PSI",
}
CATEGORY_GROUPS = {
    "ODA": "ODA",
    "Non-export credit OOF": "OOF",
    "Private Development Finance": "Private",
    "PSI": "Private",
}
GROUP_ORDER = ("ODA", "OOF", "Private")
UNMAPPED = "unmapped"


def _literal_map(mapping: Mapping[str, str]) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(str(k)), F.lit(v)]
    return F.create_map(*items)


def category_code_to_group() -> dict[str, str]:
    """Composed map: category code → group (codes whose name has no group are absent)."""
    return {code: CATEGORY_GROUPS[name] for code, name in CATEGORY_NAMES.items() if name in CATEGORY_GROUPS}


def category_group(code: ColumnOrName) -> Column:
    """Finance group of a category code; NULL for unmapped or NULL codes."""
    return F.try_element_at(_literal_map(category_code_to_group()), F.trim(as_col(code).cast("string")))


def sector_dim(spark: SparkSession, source: Mapping[str, str] | DataFrame | str | None = None) -> DataFrame:
    """Purpose code → name as a DataFrame (``code``, ``name``)."""
    if source is None:
        source = DEFAULT_SECTOR_NAMES
    if isinstance(source, DataFrame):
        return source.select(F.trim(F.col("code").cast("string")).alias("code"), F.col("name"))
    if isinstance(source, str):
        df = spark.read.options(header="true", quote='"', escape='"').csv(source)
        return df.select(F.trim(F.col(df.columns[0])).alias("code"), F.col(df.columns[1]).alias("name"))
    return spark.createDataFrame([(str(k), v) for k, v in source.items()], "code string, name string")


def sector_lookup(
    df: DataFrame,
    code_col: str,
    out_col: str = "sector_name",
    source: Mapping[str, str] | DataFrame | str | None = None,
    default: str = "",
) -> DataFrame:
    """Attach the purpose-code name (``default`` when the code is unknown or NULL).

    A mapping is applied as a literal map (no join). A DataFrame or CSV list is
    left-joined; AQE broadcasts it while it measures small. Of a code listed
    more than once the least name counts.
    """
    code = F.trim(F.col(code_col).cast("string"))
    if source is None or isinstance(source, Mapping):
        mapping = DEFAULT_SECTOR_NAMES if source is None else source
        return df.withColumn(out_col, F.coalesce(F.try_element_at(_literal_map(mapping), code), F.lit(default)))
    dim = sector_dim(df.sparkSession, source).groupBy(F.col("code").alias("__code")).agg(F.min("name").alias("__name"))
    joined = df.withColumn("__jcode", code).join(dim, F.col("__jcode") == F.col("__code"), "left")
    return joined.withColumn(out_col, F.coalesce(F.col("__name"), F.lit(default))).drop("__jcode", "__code", "__name")


def taxonomy_dim(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """One row per label: position in the vocabulary, kind, definition text."""
    rows = []
    for i, c in enumerate(taxonomy.vocabulary):
        kind = "location" if c in taxonomy.locations else ("residual" if c == taxonomy.residual else "thematic")
        rows.append((i, c, kind, taxonomy.definitions.get(c)))
    return spark.createDataFrame(rows, "position int, class string, kind string, definition string")
