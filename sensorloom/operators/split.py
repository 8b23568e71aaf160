"""Chronological train / validation / test split, its manifest, and leakage removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..spec import PanelSpec
from .ordered import Skew, with_position

SPLIT = "split"
GAP = "is_boundary_gap"


def check_fractions(train: float, validation: float) -> None:
    if not 0 < train < 1:
        raise ValueError(f"train is {train}, which is no share between 0 and 1")
    if not 0 < validation < 1:
        raise ValueError(f"validation is {validation}, which is no share between 0 and 1")
    if train + validation >= 1:
        raise ValueError(f"train and validation leave no rows for the test split ({train} + {validation})")


def with_splits(
    df: DataFrame,
    spec: PanelSpec,
    train: float = 0.70,
    validation: float = 0.15,
    gap_rows: int = 72,
    skew: Skew | None = None,
) -> DataFrame:
    """The table with ``split`` and ``is_boundary_gap`` added, without a manifest join.

    Positions count rows per entity in time order. Rows up to ``gap_rows`` on either
    side of a boundary are marked. Rows without an entity are left out.
    """
    check_fractions(train, validation)
    position, size = F.col("_row"), F.col("_rows")
    first = F.floor(size * F.lit(float(train)))
    second = F.floor(size * F.lit(float(train + validation)))

    def near(boundary: Column) -> Column:
        return (position >= boundary - gap_rows) & (position < boundary + gap_rows)

    split = (
        F.when(position < first, F.lit("train"))
        .when(position < second, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return with_position(df, spec, skew).select(
        *df.columns, split.alias(SPLIT), (near(first) | near(second)).alias(GAP)
    )


def chronological_split(
    df: DataFrame,
    spec: PanelSpec,
    train: float = 0.70,
    validation: float = 0.15,
    gap_rows: int = 72,
    skew: Skew | None = None,
) -> DataFrame:
    """The split manifest: the keys with ``split`` and ``is_boundary_gap``."""
    return with_splits(df.select(*spec.keys), spec, train, validation, gap_rows, skew)


def join_manifest(df: DataFrame, manifest: DataFrame, spec: PanelSpec, check: bool = True) -> DataFrame:
    """The manifest's columns beside the table's, one row to one row; missing keys match each other.

    Both sides are laid into one exchange on (entity, timestamp) and looked at once: a window over
    the key counts the rows of either side, which ``check`` wants to be one at most (the job fails
    otherwise), and carries the manifest's columns over. Keys are unique, so none can be hot, and
    nothing is broadcast.
    """
    extra = [field for field in manifest.schema if field.name not in spec.keys]
    own = [field for field in df.schema if field.name not in spec.keys]
    rows = df.select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra], F.lit(1).alias("_table"))
    entries = manifest.select(
        *spec.keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in own], *[f.name for f in extra], F.lit(0).alias("_table")
    )
    key = Window.partitionBy(*spec.keys)
    laid = rows.unionByName(entries).withColumns(
        {
            "_in_table": F.sum("_table").over(key),
            "_in_manifest": F.sum(1 - F.col("_table")).over(key),
            **{f.name: F.first(f.name, ignorenulls=True).over(key) for f in extra},
        }
    )
    wanted = F.col("_table") == 1
    if check:
        twice = lambda side: F.raise_error(F.lit(f"The {side} holds a key more than once.")).cast("boolean")
        wanted = F.when(F.col("_in_table") > 1, twice("table")).when(F.col("_in_manifest") > 1, twice("manifest")).otherwise(wanted)
    return laid.filter(wanted).select(*df.columns, *[f.name for f in extra])


def drop_boundary_gap(df: DataFrame) -> DataFrame:
    """Remove rows reserved around split boundaries.

    A row without a manifest entry fails the job; a plain filter would drop it silently.
    """
    if GAP not in df.columns:
        raise ValueError(f"No column {GAP}: the table has no splits yet.")
    unmatched = F.raise_error(F.lit("There are rows without a split.")).cast("boolean")
    return df.filter(F.when(F.col(GAP).isNull(), unmatched).otherwise(~F.col(GAP)))
