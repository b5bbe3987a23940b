"""The annotated matrix as a small set of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantell.plans.shared import settled

#: Comparisons of a column with a value, for subsets.
COMPARISONS = {">=": "__ge__", ">": "__gt__", "==": "__eq__", "<": "__lt__", "<=": "__le__", "!=": "__ne__"}


class InputError(ValueError):
    """Arguments that don't fit each other or the data."""


def as_list(x: Any) -> list:
    """None is an empty list, a scalar a list of one."""
    if x is None:
        return []
    return [x] if isinstance(x, (str, int, float, bool)) else list(x)


@dataclass(frozen=True)
class Experiment:
    """Cells × features with metadata, all lazy.

    ``obs``: a row per ``cell_id``; ``var``: a row per ``gene_id``; ``layers``: named long matrices
    ``(cell_id, gene_id, value)`` without zero or NaN values, the one named ``X`` the default; ``obsm``: vectors
    ``(cell_id, vec)``; ``obsp``: graphs ``(src, dst, weight)``; ``uns``: anything else. A cell without a value is a cell
    of zeros and counts wherever cells are counted.
    """

    obs: DataFrame
    var: DataFrame
    layers: Mapping[str, DataFrame]
    obsm: Mapping[str, DataFrame] = field(default_factory=dict)
    obsp: Mapping[str, DataFrame] = field(default_factory=dict)
    uns: Mapping[str, Any] = field(default_factory=dict)

    def layer(self, name: str | None = None) -> DataFrame:
        name = name or "X"
        if name not in self.layers:
            raise InputError(f"no layer {name}; there are {sorted(self.layers)}")
        return self.layers[name].select("cell_id", "gene_id", "value")

    def require(self, obs: Sequence[str] = (), var: Sequence[str] = ()) -> None:
        """Raises if a metadata column is missing."""
        missing = [c for c in obs if c not in self.obs.columns] + [c for c in var if c not in self.var.columns]
        if missing:
            raise InputError(f"missing columns: {missing}")

    def with_layer(self, name: str, values: DataFrame) -> Experiment:
        return replace(self, layers={**self.layers, name: values})

    def settled(self, *layers: str | None) -> Experiment:
        """``obs`` and the layers in a form that may be read more than once; see :func:`quantell.plans.shared.settled`."""
        return replace(self, obs=settled(self.obs), layers={**self.layers, **{n or "X": settled(self.layer(n)) for n in layers}})

    def swap(self, layer_key: str, x_key: str = "X_before") -> Experiment:
        """The named layer as ``X``, what was ``X`` kept as ``x_key``. No job runs."""
        return replace(self, layers={**self.layers, x_key: self.layer(), "X": self.layer(layer_key)})

    def genes(self, features: Sequence[str] | None = None) -> DataFrame:
        """``gene_id`` of the features, all if None. An empty list raises."""
        ids = self.var.select("gene_id")
        if features is None:
            return ids
        features = as_list(features)
        if not features:
            raise InputError("features is empty")
        return ids.where(F.col("gene_id").isin(features))

    def keep(self, cells: DataFrame | None = None, genes: DataFrame | None = None) -> Experiment:
        """Only the cells and genes whose ids the tables hold."""
        obs, var, layers, obsm, obsp = self.obs, self.var, dict(self.layers), dict(self.obsm), dict(self.obsp)
        if cells is not None:
            ids = cells.select("cell_id")
            obs = obs.join(ids, "cell_id", "left_semi")
            layers = {k: v.join(ids, "cell_id", "left_semi") for k, v in layers.items()}
            obsm = {k: v.join(ids, "cell_id", "left_semi") for k, v in obsm.items()}
            src, dst = ids.withColumnRenamed("cell_id", "src"), ids.withColumnRenamed("cell_id", "dst")
            obsp = {k: v.join(src, "src", "left_semi").join(dst, "dst", "left_semi") for k, v in obsp.items()}
        if genes is not None:
            ids = genes.select("gene_id")
            var = var.join(ids, "gene_id", "left_semi")
            layers = {k: v.join(ids, "gene_id", "left_semi") for k, v in layers.items()}
        return replace(self, obs=obs, var=var, layers=layers, obsm=obsm, obsp=obsp)


def compare(col: Column, comparison: str, values: Any) -> Column:
    """The condition of a subset. ``include`` and ``exclude`` take one value or several; excluding keeps nulls."""
    if comparison == "include":
        return F.coalesce(col.isin(as_list(values)), F.lit(False))
    if comparison == "exclude":
        return F.coalesce(~col.isin(as_list(values)), F.lit(True))
    if comparison not in COMPARISONS:
        raise InputError(f"comparison is one of include, exclude, {', '.join(COMPARISONS)}")
    if isinstance(values, (list, tuple)):
        if len(values) != 1:
            raise InputError(f"{comparison} takes one value")
        values = values[0]
    return F.coalesce(getattr(col, COMPARISONS[comparison])(F.lit(values)), F.lit(comparison == "!="))


def subset(
    exp: Experiment, *, obs_key: str | None = None, obs_groups: Any = None, var_key: str | None = None, var_groups: Any = None, comparison: str = "include",
) -> Experiment:
    """Cells by one condition on ``obs`` and genes by one on ``var``, both with the same comparison."""
    exp.require([obs_key] if obs_key else [], [var_key] if var_key else [])
    cells = exp.obs.where(compare(F.col(obs_key), comparison, obs_groups)) if obs_key else None
    genes = exp.var.where(compare(F.col(var_key), comparison, var_groups)) if var_key else None
    return exp.keep(cells, genes)


def subset_df(df: DataFrame, *, col: Any, col_groups: Any, comparison: Any = "include") -> DataFrame:
    """Rows that meet a condition on each column; one comparison for all columns or one for each."""
    cols = as_list(col)
    groups = [col_groups] if len(cols) == 1 and not (isinstance(col_groups, list) and len(col_groups) == 1 and isinstance(col_groups[0], list)) else list(col_groups)
    how = as_list(comparison) * (len(cols) if isinstance(comparison, str) else 1)
    if not len(cols) == len(groups) == len(how):
        raise InputError("col, col_groups and comparison differ in length")
    for c, g, h in zip(cols, groups, how, strict=True):
        df = df.where(compare(F.col(c), h, g))
    return df


def transfer_labels(original: DataFrame, part: DataFrame, original_key: str, subset_key: str, labels: Any, id_col: str = "cell_id") -> DataFrame:
    """``original`` with the part's labels where its own is one of ``labels``; null for cells that the part lacks."""
    new = part.select(F.col(id_col), F.col(subset_key).alias("__new")).dropDuplicates([id_col])
    hit = F.coalesce(F.col(original_key).isin(as_list(labels)), F.lit(False))
    return original.join(new, id_col, "left").withColumn(original_key, F.when(hit, F.col("__new")).otherwise(F.col(original_key))).drop("__new")


def update_labels(obs: DataFrame, key: str, mapping: Mapping[str, str], key_added: str | None = None) -> DataFrame:
    """Labels by a mapping; those it lacks stay."""
    if not mapping:
        return obs.withColumn(key_added or key, F.col(key))
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return obs.withColumn(key_added or key, F.coalesce(pairs[F.col(key)], F.col(key)))


def add_gene_metadata(df: DataFrame, metadata: DataFrame, gene_key: str, add_gene_id: bool = False) -> DataFrame:
    """Biotype and locations of each gene from ``metadata`` (gene, biotype, locations array, gene_id); ``NaN`` if unknown."""
    cols = {"biotype": F.col("__biotype"), "locations": F.concat_ws(",", "__locations")} | ({"gene_id": F.col("__gene_id")} if add_gene_id else {})
    m = metadata.select(F.col("gene").alias(gene_key), F.col("biotype").alias("__biotype"), F.col("locations").alias("__locations"), F.col("gene_id").alias("__gene_id"), F.lit(True).alias("__known"))
    out = df.join(m.dropDuplicates([gene_key]), gene_key, "left")
    return out.withColumns({k: F.coalesce(F.when(F.col("__known"), v), F.lit("NaN")) for k, v in cols.items()}).drop("__biotype", "__locations", "__gene_id", "__known")


def concat(parts: Mapping[str, Experiment], batch_key: str = "batch") -> Experiment:
    """Experiments on top of each other; cell ids get ``-<name>``, genes are united, what a part lacks is 0 or null."""

    def named(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.withColumns({c: F.concat_ws("-", F.col(c).cast("string"), F.lit(name)) for c in cols})

    def union(dfs: list[DataFrame]) -> DataFrame:
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d, allowMissingColumns=True)
        return out

    obs = union([named(e.obs, n, "cell_id").withColumn(batch_key, F.lit(n)) for n, e in parts.items()])
    var = union([e.var.select("gene_id") for e in parts.values()]).distinct()
    names = sorted({k for e in parts.values() for k in e.layers})
    layers = {k: union([named(e.layers[k].select("cell_id", "gene_id", "value"), n, "cell_id") for n, e in parts.items() if k in e.layers]) for k in names}
    vecs = sorted(set.intersection(*[set(e.obsm) for e in parts.values()])) if parts else []
    obsm = {k: union([named(e.obsm[k], n, "cell_id") for n, e in parts.items()]) for k in vecs}
    return Experiment(obs, var, layers, obsm)


def select_slide(exp: Experiment, s: str, s_col: str = "sample") -> Experiment:
    """The cells of one slide."""
    return subset(exp, obs_key=s_col, obs_groups=s)


def feature_groups(groups: Mapping[str, Sequence[str]]) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """All features of the named groups one after the other, and each group's first and last place."""
    flat: list[str] = []
    places: dict[str, tuple[int, int]] = {}
    for name, features in groups.items():
        places[name] = (len(flat), len(flat) + len(features) - 1)
        flat += features
    return flat, places


def categories(df: DataFrame, col: str) -> DataFrame:
    """The levels of a column in order."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def difference(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key isn't in ``other``; repeated rows stay, and so do rows with a null key."""
    on = as_list(on)
    return df.join(other.select(*on), on, "left_anti")


def unpivot(df: DataFrame, keys: str | Sequence[str], name: str, value: str) -> DataFrame:
    """A row per key and further column: its name and its value; nulls stay. The columns must be of one kind."""
    keys = as_list(keys)
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def matrix_state(exp: Experiment, layer: str | None = None) -> DataFrame:
    """One row about a layer's values: how many, NaN, negative, not whole; what raw counts and tests require."""
    v = F.col("value")
    return exp.layer(layer).agg(
        F.count("*").alias("n_values"),
        F.count(F.when(v.isNull() | F.isnan(v), 1)).alias("n_nan"),
        F.count(F.when(v < 0, 1)).alias("n_negative"),
        F.count(F.when(v != F.floor(v), 1)).alias("n_fractional"),
    )


def require_counts(exp: Experiment, layer: str | None = None, inverse: bool = False) -> None:
    """Raises unless the layer holds raw counts: whole, not negative, no NaN. ``inverse``: unless it doesn't."""
    r = matrix_state(exp, layer).first()
    raw = not (r.n_nan or r.n_negative or r.n_fractional)
    if raw == inverse:
        raise InputError("the layer holds raw counts" if inverse else "the layer doesn't hold raw counts")
