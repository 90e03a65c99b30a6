"""Fitting and applying feature preparation: imputation, scaling, one-hot and ordinal codes.

Everything is fitted for several row sets (cross-validation folds) in the same passes: each statistic
is taken over rows that satisfy a condition, so that the data is read once, not once per fold."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import ref
from ..functions.staging import stage
from .quantiles import AGGREGATE_WIDTH, exact_quantiles
from .ranking import sorted_codes

#: Levels of a code table that may be broadcast.
BROADCAST_LEVELS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Share of rows from which a level is looked up in the plan instead of being shuffled.
HOT_SHARE = 0.001


@dataclass(frozen=True)
class NumberCoding:
    """Impute with `fill`, then (x - centre) / scale."""

    fill: float
    centre: float = 0.0
    scale: float = 1.0


@dataclass(frozen=True)
class OneHotCoding:
    """One column per frequent level, then one shared by all others if there are rare ones."""

    fill: str
    levels: tuple[str, ...]
    has_rare: bool

    @property
    def width(self) -> int:
        return len(self.levels) + self.has_rare


@dataclass(frozen=True)
class OrdinalCoding:
    """Position among the sorted training levels; -1 for others. `table` is (level, cnt, code): `small`
    enough to broadcast, or with its frequent levels also kept in `hot`."""

    fill: str | None
    table: DataFrame
    n_levels: int
    small: bool
    hot: dict[str, int]


Coding = NumberCoding | OneHotCoding | OrdinalCoding


@dataclass(frozen=True)
class PrepModel:
    """Fitted preparation. Columns without any training value are left out, as nothing is known of them."""

    numbers: dict[str, NumberCoding]
    categories: dict[str, OneHotCoding | OrdinalCoding]

    def unscaled(self) -> PrepModel:
        return replace(self, numbers={n: NumberCoding(c.fill) for n, c in self.numbers.items()})

    @property
    def feature_names(self) -> list[str]:
        return [f for f, _ in self._slots()]

    @property
    def feature_sources(self) -> list[str]:
        """The input column behind every encoded feature."""
        return [s for _, s in self._slots()]

    def _slots(self) -> list[tuple[str, str]]:
        out = [(n, n) for n in self.numbers]
        for n, c in self.categories.items():
            if isinstance(c, OrdinalCoding):
                out.append((n, n))
            else:
                out += [(f"{n}={level}", n) for level in c.levels] + ([(f"{n}=(rare)", n)] if c.has_rare else [])
        return out

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the feature vector: numbers, then categories, each in their order."""
        coded = df
        for k, (n, c) in enumerate(self.categories.items()):
            coded = with_code(coded, n, c, f"_code{k}")
        slots = [number_feature(ref(n), c) for n, c in self.numbers.items()]
        for k, c in enumerate(self.categories.values()):
            code = F.col(f"_code{k}")
            if isinstance(c, OrdinalCoding):
                slots.append(code.cast("double"))
            else:
                slots += [F.when(code == i, 1.0).otherwise(0.0) for i in range(c.width)]
        vector = array_to_vector(F.array(*slots)).alias(output)
        return coded.select(*[ref(c) for c in df.columns], vector)


# -- applying ----------------------------------------------------------------------------------------
def number_feature(x: Column, c: NumberCoding) -> Column:
    filled = F.coalesce(x, F.lit(c.fill))
    return filled if (c.centre, c.scale) == (0.0, 1.0) else (filled - F.lit(c.centre)) / F.lit(c.scale)


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for item in values.items() for v in item])


def with_code(df: DataFrame, name: str, c: OneHotCoding | OrdinalCoding, output: str) -> DataFrame:
    """Add the level number of a category: one-hot position (rare levels share the last one, unknown
    ones too, else -1) or sorted position (unknown -1)."""
    value = ref(name) if c.fill is None else F.coalesce(ref(name), F.lit(c.fill))
    if isinstance(c, OneHotCoding):
        other = F.lit(len(c.levels) if c.has_rare else -1)
        known = _literal_map({level: i for i, level in enumerate(c.levels)}) if c.levels else None
        code = other if known is None else F.coalesce(F.try_element_at(known, value), other)
        return df.withColumn(output, code)
    keys = c.table.select(F.col("level").alias(f"{output}_key"), F.col("code").alias(output))
    if c.small:
        joined = df.withColumn(f"{output}_v", value).join(
            F.broadcast(keys), F.col(f"{output}_v") == F.col(f"{output}_key"), "left")
        return joined.select(*[ref(x) for x in df.columns], F.coalesce(output, F.lit(-1)).alias(output))
    # Too many levels to broadcast: frequent ones come from the plan and are spread over all tasks, so
    # that the shuffle only groups infrequent ones.
    hot = F.try_element_at(_literal_map(c.hot), value) if c.hot else F.lit(None).cast("int")
    spread = F.concat(F.lit("\0"), F.xxhash64(*[ref(x) for x in df.columns]).cast("string"))
    keyed = df.withColumn(f"{output}_hot", hot).withColumn(
        f"{output}_v", F.when(F.col(f"{output}_hot").isNull(), value).otherwise(spread))
    joined = keyed.join(keys, F.col(f"{output}_v") == F.col(f"{output}_key"), "left")
    return joined.select(
        *[ref(x) for x in df.columns], F.coalesce(f"{output}_hot", output, F.lit(-1)).alias(output))


# -- fitting -----------------------------------------------------------------------------------------
def fit_prep(
    df: DataFrame, numeric: list[str], categorical: list[str], config: C.AnalysisConfig,
    where: dict[str, Column] | None = None, numeric_levels: frozenset[str] = frozenset(),
) -> dict[str, PrepModel]:
    """One fitted (and scaled) preparation per named row set; without `where` one over all rows."""
    where = where or {"all": F.lit(True)}
    numbers = fit_numbers(df, numeric, config.numeric_impute, config.scaling, where)
    categories = fit_categories(df, categorical, config.categorical_impute, where, numeric_levels)
    return {w: PrepModel(numbers[w], categories[w]) for w in where}


def fit_numbers(
    df: DataFrame, names: list[str], impute: str, scaling: str, where: dict[str, Column]
) -> dict[str, dict[str, NumberCoding]]:
    """Imputation values and scaling of numeric columns. Scaling describes the imputed column, which
    follows from the moments of the present values and the number of gaps."""
    out: dict[str, dict[str, NumberCoding]] = {w: {} for w in where}
    if not names:
        return out
    cells = {(w, n): F.when(cond, ref(n)) for w, cond in where.items() for n in names}
    stats: dict[tuple[str, str], dict] = {}
    keys = list(cells)
    per_chunk = AGGREGATE_WIDTH // 5
    totals = dict(zip(where, df.agg(*[F.count_if(c) for c in where.values()]).first()))
    for i in range(0, len(keys), per_chunk):
        chunk = keys[i : i + per_chunk]
        row = df.agg(*[
            a.alias(f"{k}|{s}") for k, key in enumerate(chunk)
            for s, a in (("n", F.count(cells[key])), ("mean", F.avg(cells[key])), ("var", F.var_pop(cells[key])),
                         ("lo", F.min(cells[key])), ("hi", F.max(cells[key])))
        ]).first()
        for k, key in enumerate(chunk):
            stats[key] = {s: row[f"{k}|{s}"] for s in ("n", "mean", "var", "lo", "hi")}
    medians = {}
    if impute == "median":
        found = exact_quantiles(df, {repr(k): cells[k] for k in keys}, {repr(k): stats[k]["n"] for k in keys}, probs=(0.5,))
        medians = {k: found[repr(k)][0] for k in keys}
    for (w, n), s in stats.items():
        if s["n"] == 0 and impute != "constant":
            continue
        fill = {"median": medians.get((w, n)), "mean": s["mean"], "constant": 0.0}[impute]
        out[w][n] = _scaled(float(fill), s, totals[w] - s["n"], scaling)
    return out


def _scaled(fill: float, s: dict, gaps: int, scaling: str) -> NumberCoding:
    n = s["n"] + gaps
    if scaling == "none" or n == 0:
        return NumberCoding(fill)
    if s["n"] == 0:
        return NumberCoding(fill, fill, 1.0)
    if scaling == "minmax":
        low = min(s["lo"], fill) if gaps else s["lo"]
        high = max(s["hi"], fill) if gaps else s["hi"]
        return NumberCoding(fill, low, (high - low) or 1.0)
    mean = (s["n"] * s["mean"] + gaps * fill) / n
    var = (s["n"] * (s["var"] + (s["mean"] - mean) ** 2) + gaps * (fill - mean) ** 2) / n
    return NumberCoding(fill, mean, math.sqrt(var) or 1.0)


def fit_categories(
    df: DataFrame, names: list[str], impute: str, where: dict[str, Column],
    numeric_levels: frozenset[str] = frozenset(),
) -> dict[str, dict[str, OneHotCoding | OrdinalCoding]]:
    """Level codes of categorical columns. Few levels become one-hot columns, many one ordinal column."""
    out: dict[str, dict[str, OneHotCoding | OrdinalCoding]] = {w: {} for w in where}
    if not names:
        return out
    sets = list(where)
    levels = level_counts(df, names, list(where.values())).persist()
    try:
        found = {r["col"]: r for r in levels.groupBy("col").agg(*[
            a.alias(f"{k}|{s}") for k in range(len(sets)) for s, a in (
                ("levels", F.count_if(F.col("level").isNotNull() & (F.col(f"w{k}") > 0))),
                ("rows", F.sum(f"w{k}")),
                ("gaps", F.sum(F.when(F.col("level").isNull(), F.col(f"w{k}")).otherwise(0))),
                ("mode", F.min(F.when(F.col("level").isNotNull() & (F.col(f"w{k}") > 0),
                                      F.struct((-F.col(f"w{k}")).alias("neg"), "level")))["level"]),
            )
        ]).collect()}  # one row per column
        short = [c for c, r in found.items()
                 if any(0 < r[f"{k}|levels"] <= C.ONEHOT_MAX_LEVELS for k in range(len(sets)))]
        few = {}
        if short:
            # Levels of columns that are one-hot in some row set: a bounded number per set.
            wanted = F.lit(False)
            for c in short:
                for k in range(len(sets)):
                    if 0 < found[c][f"{k}|levels"] <= C.ONEHOT_MAX_LEVELS:
                        wanted = wanted | ((F.col("col") == c) & (F.col(f"w{k}") > 0))
            for r in levels.where(wanted & F.col("level").isNotNull()).collect():
                few.setdefault(r["col"], []).append(r)
        for c, r in sorted(found.items()):
            n = names[c]
            for k, w in enumerate(sets):
                n_levels, fill = r[f"{k}|levels"], r[f"{k}|mode"]
                if n_levels == 0 and impute != "constant":
                    continue
                if n_levels <= C.ONEHOT_MAX_LEVELS:
                    if impute == "constant":
                        fill = C.MISSING_LABEL
                    counts = {x["level"]: x[f"w{k}"] for x in few.get(c, []) if x[f"w{k}"] > 0}
                    out[w][n] = _onehot(counts, fill, r[f"{k}|gaps"], r[f"{k}|rows"], n in numeric_levels)
                else:
                    out[w][n] = _ordinal(levels, c, k, fill, n_levels, r[f"{k}|rows"], n in numeric_levels)
    finally:
        levels.unpersist()
    return out


def level_counts(df: DataFrame, names: list[str], conditions: list[Column]) -> DataFrame:
    """(col, level, w0, w1, ...): occurrences of every level, NULL included, per condition."""
    flags = [c.cast("int").alias(f"w{k}") for k, c in enumerate(conditions)]
    cells = df.select(*flags, *[ref(n).cast("string").alias(f"c{k}") for k, n in enumerate(names)])
    weights = [f"w{k}" for k in range(len(conditions))]
    long = cells.unpivot(weights, [f"c{k}" for k in range(len(names))], "col", "level")
    return (
        long.groupBy(F.substring("col", 2, 10).cast("int").alias("col"), "level")
        .agg(*[F.sum(w).alias(w) for w in weights])
    )


def _onehot(counts: dict[str, int], fill: str, gaps: int, rows: int, as_number: bool) -> OneHotCoding:
    filled = dict(counts)
    if gaps:
        filled[fill] = filled.get(fill, 0) + gaps
    rare = {v for v, cnt in filled.items() if cnt < C.RARE_LEVEL_SHARE * rows}
    kept = sorted((v for v in filled if v not in rare), key=(lambda v: (float(v), v)) if as_number else None)
    return OneHotCoding(fill, tuple(kept), bool(rare))


def _ordinal(levels: DataFrame, col: int, k: int, fill: str, n_levels: int, rows: int, as_number: bool) -> OrdinalCoding:
    sizes = levels.where((F.col("col") == col) & F.col("level").isNotNull() & (F.col(f"w{k}") > 0)).select(
        "level", F.col(f"w{k}").alias("cnt"))
    return code_levels(sizes, fill, n_levels, rows, as_number)


def code_levels(sizes: DataFrame, fill: str | None, n_levels: int, rows: int, as_number: bool = False) -> OrdinalCoding:
    """Sorted codes for (level, cnt). The code table is staged, as every fold and model reads it."""
    codes = sorted_codes(sizes.select("level"), "level", n_levels, as_number=as_number)
    table = stage(sizes.join(codes, "level"))
    small, hot = n_levels <= BROADCAST_LEVELS, {}
    if small:
        n_bytes = table.agg(F.sum(F.octet_length("level"))).first()[0] or 0
        small = n_bytes <= BROADCAST_BYTES
    if not small:
        # At most 1 / HOT_SHARE levels can be that frequent.
        hot = {r["level"]: r["code"] for r in table.where(F.col("cnt") >= HOT_SHARE * rows).collect()}
    return OrdinalCoding(fill, table, n_levels, small, hot)


# -- pyspark.ml face ---------------------------------------------------------------------------------
class TablePrep(Estimator):
    """Preparation as a pipeline stage: fits on a cleaned table and adds a feature vector."""

    def __init__(self, numeric: list[str], categorical: list[str], config: C.AnalysisConfig, *,
                 scale: bool = True, numeric_levels: frozenset[str] = frozenset(), output: str = "features"):
        super().__init__()
        self.numeric, self.categorical, self.config = list(numeric), list(categorical), config
        self.scale, self.numeric_levels, self.output = scale, numeric_levels, output

    def _fit(self, dataset: DataFrame) -> TablePrepModel:
        prep = fit_prep(dataset, self.numeric, self.categorical, self.config, numeric_levels=self.numeric_levels)["all"]
        return TablePrepModel(prep if self.scale else prep.unscaled(), self.output)


class TablePrepModel(Model):
    def __init__(self, prep: PrepModel, output: str = "features"):
        super().__init__()
        self.prep, self.output = prep, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.prep.transform(dataset, self.output)


# -- targets -----------------------------------------------------------------------------------------
def fit_labels(df: DataFrame, target: str) -> OrdinalCoding:
    """Codes of the classes in sorted text order; the table is (level, cnt, code)."""
    sizes = (
        df.select(ref(target).cast("string").alias("level")).where(F.col("level").isNotNull())
        .groupBy("level").agg(F.count("*").alias("cnt"))
    )
    total = sizes.agg(F.count("*").alias("n"), F.sum("cnt").alias("rows")).first()
    return code_levels(sizes, None, total["n"], total["rows"] or 0)


def label_encode(df: DataFrame, target: str, labels: OrdinalCoding, output: str = "y") -> DataFrame:
    """Add the class code as a double; rows without a known class are dropped."""
    text = df.withColumn("_label", ref(target).cast("string"))
    coded = with_code(text, "_label", labels, output).where(F.col(output) >= 0)
    return coded.withColumn(output, F.col(output).cast("double")).drop("_label")
