"""Preparing features for models: statistics fitted on training rows only, parity of features
between training and serving, and oversampling after the split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch_micros, known
from ..settings import checkpoint
from ..sources.files import write_panel
from ..spec import PanelSpec
from .quantiles import column_quantiles
from .ranking import with_positions
from .split import GAP, SPLIT

TRAIN = "train"


def train_rows(df: DataFrame) -> DataFrame:
    """Rows of the training split outside boundary gaps; a table without a split is refused."""
    if SPLIT not in df.columns:
        raise ValueError("The table has no split yet: fit and oversample after the split only.")
    rows = df.filter(F.col(SPLIT) == TRAIN)
    return rows.filter(~F.coalesce(F.col(GAP), F.lit(False))) if GAP in df.columns else rows


def split_fingerprint(df: DataFrame, spec: PanelSpec) -> str:
    """A fingerprint of which keys the training rows have, whatever their order and partitions."""
    key = F.xxhash64(*[F.col(k).cast("string") for k in spec.keys])
    mixed = F.xxhash64(F.lit(1), *[F.col(k).cast("string") for k in spec.keys])
    sum_ = lambda c: F.sum(c.cast("decimal(20,0)"))
    row = train_rows(df).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(key).alias("x"), sum_(key).alias("s"), sum_(mixed).alias("m")).first()
    return f"{row['n']}-{row['x'] or 0}-{row['s'] or 0}-{row['m'] or 0}"


def fit_scaling(df: DataFrame, spec: PanelSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics of the training rows, one row per column: position, column, type, count, mean, std, min, max and the
    fingerprint of the split. Missing values (NaN too) do not count; a column without values has nulls."""
    names = list(columns or spec.sensors)
    _require(df, names)
    mark = split_fingerprint(df, spec)
    kinds = dict(df.dtypes)
    cells = []
    for i, name in enumerate(names):
        value = known(df, name).cast("double")
        cells += [F.struct(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).alias(f"c{i}")]
    one = train_rows(df).agg(*cells)
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(kinds[n]).alias("type"), F.col(f"c{i}").alias("s")) for i, n in enumerate(names)])
    rows = one.select(F.explode(listed).alias("r")).select("r.position", "r.column", "r.type", "r.s.*", F.lit(mark).alias("fingerprint"))
    return checkpoint(rows)


def apply_scaling(df: DataFrame, state: DataFrame, spec: PanelSpec, suffix: str = "_scaled") -> DataFrame:
    """The table with ``{column}{suffix}``: (value - mean) / std of the training rows (0 where they do not vary).

    Refused if the columns or their types differ from those fitted, or if the table has a split whose
    training rows are not the fitted ones: then rows of another split could have leaked into the statistics.
    """
    fitted = state.orderBy("position").collect()  # one row a column
    _require(df, [row["column"] for row in fitted])
    kinds = dict(df.dtypes)
    wrong = [f"{r['column']} is {kinds[r['column']]}, was {r['type']}" for r in fitted if kinds[r["column"]] != r["type"]]
    if wrong:
        raise ValueError("Columns differ from the fitted ones: " + "; ".join(wrong))
    if SPLIT in df.columns and fitted and split_fingerprint(df, spec) != fitted[0]["fingerprint"]:
        raise ValueError("The statistics were fitted on other training rows than this split has.")

    def scaled(row) -> Column:
        value = known(df, row["column"]).cast("double")
        if row["mean"] is None:
            return F.lit(None).cast("double")
        return (value - F.lit(row["mean"])) / F.lit(row["std"]) if row["std"] else value * 0.0

    return df.select("*", *[scaled(row).alias(f"{row['column']}{suffix}") for row in fitted])


def save_state(state: DataFrame, path: str) -> None:
    write_panel(state, path, mode="errorifexists")


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _require(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"Missing columns: {', '.join(absent)}")


# --- feature parity ---------------------------------------------------------------------


def feature_contract(df: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """What serving must give: one row per feature with position, feature, type, edges (inner quantiles of the known
    values, repeated ones once) and shares of rows per bin, the last one that of missing values."""
    _require(df, list(features))
    kinds = dict(df.dtypes)
    fractions = [i / bins for i in range(1, bins)]
    quantiles = column_quantiles(df, list(features), fractions).collect()  # one row a feature
    edges = {row["column"]: sorted(set(q for q in row["quantiles"] or [] if q is not None)) for row in quantiles}
    rows = [(i, name, kinds[name], edges[name]) for i, name in enumerate(features)]
    contract = df.sparkSession.createDataFrame(rows, "position int, feature string, type string, edges array<double>")
    shares = _shares(df, {name: edges[name] for name in features})
    return checkpoint(contract.join(shares, "feature", "left"))


def _shares(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, shares): bin b holds values from edge b-1 (inclusive) to edge b, the last one missing values. One pass."""

    def bin_of(name: str, cuts: list[float]) -> Column:
        value = known(df, name).cast("double")
        below = reduce(lambda found, cut: found + F.when(value >= cut, 1).otherwise(0), cuts, F.lit(0))
        return F.when(value.isNull(), len(cuts) + 1).otherwise(below)

    cells = []
    for i, (name, cuts) in enumerate(edges.items()):
        number = bin_of(name, cuts)
        cells += [F.count(F.when(number == b, 1)).alias(f"c{i}_{b}") for b in range(len(cuts) + 2)]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *cells)
    listed = [
        F.struct(F.lit(name).alias("feature"), F.array(*[F.try_divide(F.col(f"c{i}_{b}"), F.col("n")) for b in range(len(cuts) + 2)]).alias("shares"))
        for i, (name, cuts) in enumerate(edges.items())
    ]
    return counts.select(F.explode(F.array(*listed)).alias("f")).select("f.*")


def feature_parity(served: DataFrame, contract: DataFrame, limit: float = 0.2, floor: float = 1e-4) -> DataFrame:
    """One row per feature of the contract or the served table: feature, status and shift.

    ``status`` is ``missing``, ``extra``, ``type``, ``shifted`` (population stability index of the binned values above
    ``limit``, shares below ``floor`` raised to it) or ``ok``; ``shift`` is that index, null where nothing can be compared.
    """
    wanted = contract.orderBy("position").collect()  # one row a feature
    kinds = dict(served.dtypes)
    comparable = {r["feature"]: list(r["edges"]) for r in wanted if kinds.get(r["feature"]) == r["type"]}
    known_ = [(r["feature"], "missing" if r["feature"] not in kinds else "type" if r["feature"] not in comparable else "ok") for r in wanted]
    extra = [(name, "extra") for name in served.columns if name not in {r["feature"] for r in wanted}]
    listed = served.sparkSession.createDataFrame(known_ + extra, "feature string, status string")
    if not comparable:
        return listed.withColumn("shift", F.lit(None).cast("double"))
    now = _shares(served, comparable).withColumnRenamed("shares", "now")
    at_least = lambda c: F.greatest(c, F.lit(floor))
    both = contract.select("feature", "shares").join(now, "feature")
    parts = F.zip_with("shares", "now", lambda p, q: (at_least(q) - at_least(p)) * F.log(at_least(q) / at_least(p)))
    shifts = both.select("feature", F.aggregate(parts, F.lit(0.0), lambda t, x: t + x).alias("shift"))
    found = listed.join(shifts, "feature", "left")
    return found.select("feature", F.when((F.col("status") == "ok") & (F.col("shift") > limit), "shifted").otherwise(F.col("status")).alias("status"), "shift")


def serve(df: DataFrame, contract: DataFrame) -> DataFrame:
    """The features of the contract in its order and nothing else; refused if one is missing or of another type."""
    wanted = contract.orderBy("position").collect()  # one row a feature
    _require(df, [r["feature"] for r in wanted])
    kinds = dict(df.dtypes)
    wrong = [r["feature"] for r in wanted if kinds[r["feature"]] != r["type"]]
    if wrong:
        raise ValueError(f"Other types than in training: {', '.join(wrong)}")
    return df.select(*[r["feature"] for r in wanted])


# --- oversampling -------------------------------------------------------------------------


def oversample(df: DataFrame, spec: PanelSpec, label: str, share: float, output: str = "copy") -> DataFrame:
    """The table with rare positives of the training rows repeated, until they are ``share`` of the rows used for training.

    With p positives and q others, round(q * share / (1 - share)) positives are wanted (never fewer than p). Each gets
    the whole quotient by p, and the remainder goes to the first by a hash of their keys, ties by the keys. ``output`` numbers the copies
    from 0. Rows of other splits and of boundary gaps stay as they are; a table without a split is refused.
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    own = train_rows(df)  # refuses
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    sizes = own.agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("q")).first()
    p, wanted = sizes["p"], max(sizes["p"], round(sizes["q"] * share / (1 - share)))
    if not p:
        return df.withColumn(output, F.lit(0).cast("long"))
    chosen = (F.col(SPLIT) == TRAIN) & positive
    if GAP in df.columns:
        chosen = chosen & ~F.coalesce(F.col(GAP), F.lit(False))
    chosen = F.coalesce(chosen, F.lit(False))
    order = [F.md5(F.concat_ws("|", F.col(spec.entity).cast("string"), epoch_micros(F.col(spec.timestamp)).cast("string"))), *[F.col(k) for k in spec.keys]]
    ranked = with_positions(df.filter(chosen), order, "_rank")
    copies = F.lit(wanted // p) + F.when(F.col("_rank") <= wanted % p, 1).otherwise(0)
    repeated = ranked.withColumn(output, F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))).drop("_rank")
    return df.filter(~chosen).withColumn(output, F.lit(0).cast("long")).unionByName(repeated)
