"""Queries of the core operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantell import experiment as ex
from quantell.functions.vectors import usable
from quantell.operators import expression as e
from quantell.operators import integration_quality as iq
from quantell.operators import neighbours as nb
from quantell.operators import models, ora, plot_tests, quality, reduction, testing, views
from quantell.operators.communities import leiden
from quantell.plans import adapters as ad
from quantell.plans import pipelines
from quantell.plans.shared import written
from quantell.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BRANDS = ["Brand#1", "Brand#2", "Brand#13"]
IN_BRANDS = "('Brand#1', 'Brand#2', 'Brand#13')"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def s6(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


O = ad.ORDERS  # noqa: E741


def grid_sql(keys: str, layer: str, v: str = "value", where: str = "") -> str:
    """Stats of every group and gene: n, t (sum of v), q (of squares), nz."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"g.{k} = s.{k}" for k in ks)
    return f"""st AS (SELECT {', '.join('g.' + k for k in ks)}, g.gene_id, g.n, coalesce(s.t, 0) AS t, coalesce(s.q, 0) AS q, coalesce(s.nz, 0) AS nz
 FROM (SELECT * FROM (SELECT {keys}, count(*) AS n FROM obs GROUP BY ALL), var {where}) g
 LEFT JOIN (SELECT {keys}, gene_id, sum({v}) AS t, sum(({v}) * ({v})) AS q, count(*) AS nz FROM {layer} JOIN obs USING (cell_id) GROUP BY ALL) s ON {on} AND g.gene_id = s.gene_id)"""


def area_sql(f: str, a: str, b: str, steps: int = 400) -> str:
    """Simpson's rule: the integral of ``f``, in which ``u`` is the variable, from a to b."""
    u = f"(({a}) + (({b}) - ({a})) * i / {steps}.0)"
    w = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: ({w}) * ({f.replace('§', u)}))) * (({b}) - ({a})) / {3 * steps}.0)"


def norm_p(z: str) -> str:
    """Two-sided normal p-value, to about 1e-9."""
    return f"greatest(1 - 2 * {area_sql('exp(-§ * § / 2) / 2.5066282746310002', '0', f'least(abs({z}), 12)')}, 0)"


def t_p(t: str, df: str) -> str:
    """Two-sided p-value of t, to about 1e-9: with t = sqrt(df) tan(u) its density is a power of the cosine."""
    c = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / 1.7724538509055159"
    return f"greatest(1 - 2 * ({c}) * {area_sql(f'pow(cos(§), ({df}) - 1)', '0', f'atan(abs({t}) / sqrt({df}))')}, 0)"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail of F: the beta integral over an angle, cut off where nothing is left of it."""
    lo, hi = f"atan(sqrt(({d1}) * ({f}) / ({d2})))", f"least(1.5707963267948966, 14 / sqrt({d2}))"
    c = f"2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0))"
    tail = area_sql(f"pow(cos(§), ({d2}) - 1) * pow(sin(§), ({d1}) - 1)", lo, hi, 2000)
    return f"CASE WHEN {lo} < {hi} THEN {c} * {tail} ELSE 0 END"


def bh_sql(table: str, keys: str, p: str = "pval", out: str = "padj") -> str:
    """Common table ``adj``: the table with Benjamini and Hochberg's p-values within the keys."""
    raw = f"SELECT *, {p} * count(*) OVER (PARTITION BY {keys}) / count(*) OVER (PARTITION BY {keys} ORDER BY {p}) AS q FROM {table}"
    return f"adj AS (SELECT * EXCLUDE (q), least(min(q) OVER (PARTITION BY {keys} ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS {out} FROM ({raw}))"


# Selection and metadata


@query(f"WITH {O} SELECT cell_id, condition, gene_id AS genes, {s6('coalesce(value, 0)')} AS expr FROM (SELECT * FROM obs, var WHERE gene_id IN {IN_BRANDS}) LEFT JOIN logc USING (cell_id, gene_id)")
def expr_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.expr(ad.orders(spark, d), features=BRANDS, groups="condition"), "expr")


@query(f"""WITH {O} SELECT cell_id, {', '.join(f"coalesce(max(CASE WHEN gene_id = '{b}' THEN value END), 0) AS \"{b}\"" for b in BRANDS)} FROM obs LEFT JOIN counts USING (cell_id) GROUP BY cell_id""")
def expr_wide(spark: SparkSession, d: str) -> DataFrame:
    return e.expr(ad.orders(spark, d), features=BRANDS, out_format="wide", layer="counts")


@query(f"WITH {O} SELECT cell_id, gene_id, value FROM counts JOIN obs USING (cell_id) WHERE condition IN ('F', 'P') AND annotation IS NOT NULL")
def subset_obs(spark: SparkSession, d: str) -> DataFrame:
    return ex.subset(ad.orders(spark, d), obs_key="condition", obs_groups=["F", "P"]).layer("counts")


@query(f"WITH {O} SELECT cell_id, gene_id, value FROM counts JOIN obs USING (cell_id) WHERE condition NOT IN ('F') AND gene_id NOT IN ('Brand#1')")
def subset_exclude(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    exp = replace(exp, var=exp.var.withColumn("name", F.col("gene_id")))
    return ex.subset(exp, obs_key="condition", obs_groups="F", var_key="name", var_groups="Brand#1", comparison="exclude").layer("counts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F') AND o_totalprice >= 100000 AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def subset_df_multi(spark: SparkSession, d: str) -> DataFrame:
    df = ad.table(spark, d, "orders")
    out = ex.subset_df(df, col=["o_orderstatus", "o_totalprice", "o_orderpriority"], col_groups=["F", 100000.0, ["1-URGENT", "5-LOW"]], comparison=["include", ">=", "exclude"])
    return out.select("o_orderkey", "o_totalprice")


@query(f"""WITH {ad.CELLS} SELECT c.cell_id, CASE WHEN c.annotation IN ('t_cells', 'unknown') THEN p.new ELSE c.annotation END AS annotation
FROM cells c LEFT JOIN (SELECT cell_id, autoannot AS new FROM cells WHERE celltypist_conf_score > 0.5 AND NOT isnan(celltypist_conf_score)) p USING (cell_id)""")
def transfer_labels(spark: SparkSession, d: str) -> DataFrame:
    c = ad.cells(spark, d)
    part = c.where("celltypist_conf_score > 0.5 AND NOT isnan(celltypist_conf_score)").select("cell_id", "autoannot")
    return ex.transfer_labels(c.select("cell_id", "annotation"), part, "annotation", "autoannot", ["t_cells", "unknown"])


@query(f"WITH {ad.CELLS} SELECT cell_id, CASE annotation WHEN 't_cells' THEN 'T' WHEN 'b_cells' THEN 'B' ELSE annotation END AS annotation FROM cells")
def update_labels(spark: SparkSession, d: str) -> DataFrame:
    return ex.update_labels(ad.cells(spark, d).select("cell_id", "annotation"), "annotation", {"t_cells": "T", "b_cells": "B"})


@query("""SELECT p_partkey, p_brand, coalesce(b, 'NaN') AS biotype, coalesce(l, 'NaN') AS locations FROM part LEFT JOIN
(SELECT p_brand, 'brand' AS b, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) AS l FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 10) GROUP BY p_brand HAVING count(*) < 9) USING (p_brand)""")
def gene_metadata_join(spark: SparkSession, d: str) -> DataFrame:
    part = ad.table(spark, d, "part")
    m = part.where("p_size < 10").groupBy(F.col("p_brand").alias("gene")).agg(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")).alias("locations")).where(F.size("locations") < 9)
    m = m.withColumns({"biotype": F.lit("brand"), "gene_id": F.lit("")})
    return ex.add_gene_metadata(part.select("p_partkey", "p_brand"), m, "p_brand")


@query(f"""WITH {O} SELECT CAST(cell_id AS VARCHAR) || '-' || condition AS cell_id, gene_id, value FROM counts JOIN obs USING (cell_id)""")
def concat_batches(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    return ex.concat({c: ex.subset(exp, obs_key="condition", obs_groups=c) for c in ("F", "O", "P")}).layer("counts")


@query(f"""WITH {ad.CELLS}, n AS (SELECT leiden, autoannot, count(*) AS n FROM cells WHERE autoannot IS NOT NULL GROUP BY ALL),
m AS (SELECT leiden, autoannot AS majority FROM n QUALIFY row_number() OVER (PARTITION BY leiden ORDER BY n DESC, autoannot) = 1) SELECT cell_id, leiden, majority FROM cells LEFT JOIN m USING (leiden)""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return nb.majority_labels(ad.cells(spark, d).select("cell_id", "leiden", "autoannot"), "leiden", "autoannot").select("cell_id", "leiden", "majority")


@query(f"WITH {O} SELECT cell_id, gene_id, value FROM counts JOIN obs USING (cell_id) WHERE batch = 'BUILDING'")
def slide_counts(spark: SparkSession, d: str) -> DataFrame:
    """The cells of one slide, here a batch."""
    return ex.select_slide(ad.orders(spark, d), "BUILDING", "batch").layer("counts")


@query(f"WITH {O} SELECT DISTINCT condition FROM obs WHERE condition IS NOT NULL")
def condition_levels(spark: SparkSession, d: str) -> DataFrame:
    return ex.categories(ad.orders(spark, d).obs, "condition")


@query(f"WITH {O} SELECT name, n_values, n_nan, n_negative, n_fractional FROM (SELECT 'counts' AS name, count(*) AS n_values, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value <> floor(value)) AS n_fractional FROM counts UNION ALL SELECT 'X', count(*), count(*) FILTER (isnan(value)), count(*) FILTER (value < 0), count(*) FILTER (value <> floor(value)) FROM logc)")
def matrix_states(spark: SparkSession, d: str) -> DataFrame:
    """What tells raw counts from other layers."""
    exp = ad.orders(spark, d)
    return ex.matrix_state(exp, "counts").withColumn("name", F.lit("counts")).union(ex.matrix_state(exp).withColumn("name", F.lit("X")))


@query("SELECT DISTINCT p_brand AS gene_id, lower(p_brand) LIKE 'brand#1%' AS one, lower(p_brand) LIKE 'brand#2%' OR lower(p_brand) LIKE 'brand#3%' AS others FROM part")
def gene_families(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_genes(ad.orders(spark, d).var, {"one": "Brand#1", "others": ("brand#2", "BRAND#3")})


@query("SELECT o_orderkey AS cell_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def row_difference(spark: SparkSession, d: str) -> DataFrame:
    """Cells that aren't among those of another table."""
    line = ad.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("cell_id"))
    return ex.difference(ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), line, "cell_id")


@query(f"WITH {O}, {grid_sql('condition', 'logc', 'exp(value) - 1')} SELECT gene_id AS gene, condition, {s6('ln(1 + t / n)')} AS expr FROM st")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """A table of a column per group brought back to a row per group."""
    return rounded(ex.unpivot(e.mean_expr(ad.orders(spark, d), group_by="condition", out_format="wide"), "gene", "condition", "expr"), "expr")


# Grouped aggregation


@query(f"WITH {O}, {grid_sql('condition, annotation', 'counts')} SELECT gene_id AS gene, condition, annotation, {s6('t / n')} AS expr FROM st")
def mean_expr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.mean_expr(ad.orders(spark, d), group_by=["condition", "annotation"], layer="counts", logcounts=False), "expr")


@query(f"WITH {O}, {grid_sql('condition, annotation', 'logc', 'exp(value) - 1')} SELECT gene_id AS gene, condition, annotation, {s6('ln(1 + t / n)')} AS expr FROM st")
def mean_expr_logcounts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.mean_expr(ad.orders(spark, d), group_by=["condition", "annotation"]), "expr")


@query(f"""WITH {O}, {grid_sql('condition', 'logc', 'exp(value) - 1')} SELECT gene_id AS gene, {', '.join(f"{s6(f'''max(CASE WHEN condition = '{c}' THEN ln(1 + t / n) END)''')} AS \"{c}\"" for c in 'FOP')} FROM st GROUP BY gene_id""")
def mean_expr_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.mean_expr(ad.orders(spark, d), group_by="condition", out_format="wide"), "F", "O", "P")


@query("""WITH obs AS (SELECT DISTINCT user_id AS cell_id, 'c' || CAST(user_id % 2 AS VARCHAR) AS condition FROM events), x AS (SELECT user_id AS cell_id, event_type AS gene_id, sum(value) AS value FROM events GROUP BY ALL),
var AS (SELECT DISTINCT event_type AS gene_id FROM events) SELECT gene_id AS gene, condition, round(sum(coalesce(value, 0)) / count(*) + 1e-7, 4) AS expr FROM (SELECT * FROM obs, var) LEFT JOIN x USING (cell_id, gene_id) GROUP BY ALL""")
def mean_expr_events(spark: SparkSession, d: str) -> DataFrame:
    ev = ad.table(spark, d, "events")
    x = ev.groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id")).agg(F.sum("value").alias("value"))
    obs = ev.select(F.col("user_id").alias("cell_id"), F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("condition")).distinct()
    exp = ex.Experiment(obs, ev.select(F.col("event_type").alias("gene_id")).distinct(), {"X": x})
    out = e.mean_expr(exp, group_by="condition", logcounts=False)
    return out.withColumn("expr", F.round(F.col("expr") + 1e-7, 4))  # means of cents may end in a 5


@query(f"""WITH {O}, {grid_sql('condition', 'logc', 'exp(value) - 1')} SELECT a.gene_id AS genes, a.condition AS "group", {s6('log2((a.t / a.n + 1e-9) / (b.t / b.n + 1e-9))')} AS log2fc
FROM st a JOIN st b ON a.gene_id = b.gene_id AND b.condition = 'F' WHERE a.condition <> 'F'""")
def log2fc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.log2fc(ad.orders(spark, d), group_by="condition", reference="F", out_format="long"), "log2fc")


@query(f"""WITH {O}, {grid_sql('condition', 'counts')} SELECT gene_id AS genes, {', '.join(f"max(CASE WHEN condition = '{c}' THEN round_even(nz / n, 4) END) AS \"{c}\"" for c in 'FOP')} FROM st GROUP BY gene_id""")
def pcts_cells(spark: SparkSession, d: str) -> DataFrame:
    return e.pcts_cells(ad.orders(spark, d), group_by="condition")


@query(f"WITH {O}, {grid_sql('condition, annotation', 'counts')} SELECT gene_id AS genes, condition, annotation, round_even(nz / n, 4) AS pct FROM st")
def pcts_cells_two_groups(spark: SparkSession, d: str) -> DataFrame:
    return e.pcts_cells(ad.orders(spark, d), group_by=["condition", "annotation"], out_format="long")


BULK = f"""WITH {O}, {grid_sql('annotation, batch', 'counts')}, b AS (SELECT annotation, batch, n AS n_cells, gene_id AS gene, {{v}} AS expr FROM st WHERE n >= 10)
SELECT annotation, batch, n_cells, gene, {s6('expr')} AS expr FROM b WHERE gene IN (SELECT gene FROM b GROUP BY gene HAVING sum(expr) > 10)"""


@query(BULK.format(v="t"))
def pseudobulk_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.pseudobulk(ad.orders(spark, d), batch_key="batch", cluster_key="annotation", layer="counts"), "expr")


@query(BULK.format(v="t / n"))
def pseudobulk_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.pseudobulk(ad.orders(spark, d), batch_key="batch", cluster_key="annotation", layer="counts", approach="mean"), "expr")


HASH = "CAST('0x' || substr(md5('0:' || CAST(cell_id AS VARCHAR)), 1, 12) AS BIGINT)"
PLACED = f"p AS (SELECT *, row_number() OVER (PARTITION BY annotation, batch ORDER BY {HASH} >> 38, {HASH}, cell_id) - 1 AS place, count(*) OVER (PARTITION BY annotation, batch) AS ng FROM obs)"


@query(f"""WITH {O}, {PLACED}, r AS (SELECT cell_id, annotation, batch || '_' || CAST(CASE WHEN place < (ng % 3) * (ng // 3 + 1) THEN place // (ng // 3 + 1) ELSE ng % 3 + (place - (ng % 3) * (ng // 3 + 1)) // (ng // 3) END AS VARCHAR) AS batch FROM p WHERE ng >= 10),
g AS (SELECT annotation, batch, count(*) AS n_cells FROM r GROUP BY ALL), s AS (SELECT annotation, batch, gene_id, sum(value) AS t FROM r JOIN counts USING (cell_id) GROUP BY ALL)
SELECT annotation, batch, n_cells, gene_id AS gene, coalesce(t, 0) AS expr FROM (SELECT * FROM g, var) LEFT JOIN s USING (annotation, batch, gene_id) WHERE gene_id IN (SELECT gene_id FROM s GROUP BY 1 HAVING sum(t) > 10)""")
def pseudobulk_replicates(spark: SparkSession, d: str) -> DataFrame:
    return e.pseudobulk(ad.orders(spark, d), batch_key="batch", cluster_key="annotation", layer="counts", technical_replicates=3)


META = f"""WITH {O}, {PLACED}, k AS (SELECT annotation, batch, ng // 10 AS blocks, sum(ng // 10) OVER (ORDER BY annotation, batch) - ng // 10 AS start FROM (SELECT DISTINCT annotation, batch, ng FROM p WHERE ng >= 50)),
m AS (SELECT cell_id, annotation, batch, 'Metacell-' || CAST(CAST(start + place // 10 AS BIGINT) AS VARCHAR) AS metacell FROM p JOIN k USING (annotation, batch) WHERE (place // 10 + 1) * 10 <= ng)"""


@query(META + " SELECT cell_id, annotation, batch, metacell FROM m")
def metacell_members(spark: SparkSession, d: str) -> DataFrame:
    return e.metacell_members(ad.orders(spark, d), batch_key="batch", annotation_key="annotation")


@query(META + " SELECT metacell, batch, annotation, gene_id AS gene, sum(coalesce(value, 0)) AS expr FROM (SELECT * FROM m, var) LEFT JOIN counts USING (cell_id, gene_id) GROUP BY ALL")
def metacells_sum(spark: SparkSession, d: str) -> DataFrame:
    return e.metacells(ad.orders(spark, d), batch_key="batch", annotation_key="annotation")


@query(META + " SELECT metacell, batch, annotation, gene_id AS gene, median(coalesce(value, 0)) AS expr FROM (SELECT * FROM m, var) LEFT JOIN counts USING (cell_id, gene_id) GROUP BY ALL")
def metacells_median(spark: SparkSession, d: str) -> DataFrame:
    return e.metacells(ad.orders(spark, d), batch_key="batch", annotation_key="annotation", agg_fx="median")


@query(META + f" SELECT metacell, batch, annotation, gene_id AS gene, {s6('avg(coalesce(value, 0))')} AS expr FROM (SELECT * FROM m, var) LEFT JOIN counts USING (cell_id, gene_id) GROUP BY ALL")
def metacells_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.metacells(ad.orders(spark, d), batch_key="batch", annotation_key="annotation", agg_fx="mean"), "expr")


@query(META + " SELECT metacell, batch, annotation, gene_id AS gene, CAST(count(*) FILTER (value <> 0) AS DOUBLE) AS expr FROM (SELECT * FROM m, var) LEFT JOIN counts USING (cell_id, gene_id) GROUP BY ALL")
def metacells_nonzero(spark: SparkSession, d: str) -> DataFrame:
    out = e.metacells(ad.orders(spark, d), batch_key="batch", annotation_key="annotation", agg_fx="count_nonzero")
    return out.withColumn("expr", F.col("expr").cast("double"))


@query(f"""WITH {O}, {grid_sql('condition', 'logc', 'exp(value) - 1')} SELECT gene_id AS gene, condition, n AS n_cells, {s6('ln(1 + t / n)')} AS logmean,
 {s6('ln(1 + sqrt(greatest((q - t * t / n) / (n - 1), 0) / n))', 5)} AS logsem FROM st""")
def lineplot_sem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(views.lineplot(ad.orders(spark, d), x_axis="condition", features=None), "logmean"), "logsem", digits=5)


@query(f"""WITH {O} SELECT gene_id AS gene, {s6('avg(c)')} AS cap FROM (SELECT gene_id, condition, quantile_cont(coalesce(value, 0), 0.992) AS c FROM (SELECT * FROM obs, var WHERE gene_id IN {IN_BRANDS}) LEFT JOIN logc USING (cell_id, gene_id) GROUP BY ALL) GROUP BY gene_id""")
def p992_cap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(e.colour_cap(ad.orders(spark, d), features=BRANDS, group="condition"), "cap")


@query(f"WITH {ad.VECTORS} SELECT annotation, {s6('quantile_cont(vec[1], 0.5)')} AS c0, {s6('quantile_cont(vec[2], 0.5)')} AS c1 FROM vecs GROUP BY annotation")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    return rounded(e.centroids(exp.obsm["X_emb"], exp.obs, "annotation"), "c0", "c1")


# Quality and normalisation

PATTERN = {"one": "brand#1"}


@query(f"""WITH {O}, c AS (SELECT cell_id, count(*) AS g, sum(value) AS t, sum(CASE WHEN lower(gene_id) LIKE 'brand#1%' THEN value ELSE 0 END) AS o FROM counts GROUP BY 1)
SELECT cell_id, coalesce(g, 0) AS n_genes_by_counts, coalesce(t, 0) AS total_counts, coalesce(o, 0) AS total_counts_one, {s6('ln(1 + coalesce(t, 0))')} AS log1p_total_counts, {s6('coalesce(100 * o / nullif(t, 0), 0)')} AS pct_counts_one FROM obs LEFT JOIN c USING (cell_id)""")
def qc_metrics_cells(spark: SparkSession, d: str) -> DataFrame:
    m = quality.cell_metrics(ad.orders(spark, d), PATTERN, "counts")
    return rounded(m, "log1p_total_counts", "pct_counts_one").select("cell_id", "n_genes_by_counts", "total_counts", "total_counts_one", "log1p_total_counts", "pct_counts_one")


@query(f"""WITH {O}, c AS (SELECT gene_id, count(*) AS k, sum(value) AS t FROM counts GROUP BY 1), n AS (SELECT count(*) AS n FROM obs)
SELECT gene_id, k AS n_cells_by_counts, t AS total_counts, {s6('t / n')} AS mean_counts, {s6('100 * (1 - k / n)')} AS pct_dropout_by_counts FROM c, n""")
def qc_metrics_genes(spark: SparkSession, d: str) -> DataFrame:
    m = quality.gene_metrics(ad.orders(spark, d), "counts")
    return rounded(m, "mean_counts", "pct_dropout_by_counts").select("gene_id", "n_cells_by_counts", "total_counts", "mean_counts", "pct_dropout_by_counts")


FILTERED = f"""WITH {O}, c AS (SELECT cell_id, count(*) AS g, sum(value) AS t, 100 * sum(CASE WHEN lower(gene_id) LIKE 'brand#1%' THEN value ELSE 0 END) / sum(value) AS p FROM counts GROUP BY 1),
c1 AS (SELECT * FROM c WHERE g >= 2), v1 AS (SELECT gene_id FROM counts JOIN c1 USING (cell_id) GROUP BY 1 HAVING count(*) >= 5), c2 AS (SELECT * FROM c1 WHERE p < 90 AND g <= 6),
b AS (SELECT quantile_cont(t, 0.05) AS lo, quantile_cont(t, 0.95) AS hi FROM c2), c3 AS (SELECT c2.* FROM c2, b WHERE t > lo AND t < hi)"""


@query(FILTERED + " SELECT cell_id, gene_id, value FROM counts JOIN c3 USING (cell_id) JOIN v1 USING (gene_id)")
def filter_cells_genes(spark: SparkSession, d: str) -> DataFrame:
    out = quality.filter_cells_genes(ad.orders(spark, d), min_genes_in_cell=2, min_cells_with_genes=5, cut_mt=90, max_genes=6, low_quantile=5, high_quantile=95, patterns=PATTERN, mt_family="one", layer="counts")
    return out.layer("counts")


@query(FILTERED + """ SELECT 'Input' AS "QC_Step", (SELECT count(*) FROM obs) AS "nCells", (SELECT count(*) FROM var) AS "nFeatures" UNION ALL SELECT 'Filtered', (SELECT count(*) FROM c3), (SELECT count(*) FROM v1)""")
def qc_history(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    kept = quality.filter_cells_genes(exp, min_genes_in_cell=2, min_cells_with_genes=5, cut_mt=90, max_genes=6, low_quantile=5, high_quantile=95, patterns=PATTERN, mt_family="one", layer="counts")
    return quality.history([("Input", exp, ""), ("Filtered", kept, "")]).drop("Comments")


@query(f"""WITH {ad.CELLS}, v AS (SELECT * FROM cells WHERE isfinite(total_counts) AND total_counts >= 0), b AS (SELECT quantile_cont(total_counts, 0.05) AS lo, quantile_cont(total_counts, 0.9) AS hi FROM v)
SELECT cell_id, total_counts FROM v, b WHERE total_counts > lo AND total_counts < hi""")
def filter_quantiles(spark: SparkSession, d: str) -> DataFrame:
    c = ad.cells(spark, d).where("total_counts >= 0 AND total_counts < double('infinity') AND NOT isnan(total_counts)")
    return quality.filter_quantiles(c, 5, 90).select("cell_id", "total_counts")


@query(f"WITH {ad.CELLS} SELECT annotation, CAST(floor(quantile_cont(n_genes_by_counts, 0.5)) AS BIGINT) AS n_genes_by_counts FROM cells WHERE n_genes_by_counts IS NOT NULL GROUP BY annotation")
def qc_medians(spark: SparkSession, d: str) -> DataFrame:
    return quality.qc_medians(ad.cells(spark, d).where("n_genes_by_counts IS NOT NULL"), ["n_genes_by_counts"], "annotation")


@query(f"WITH {O} SELECT cell_id, gene_id, {s6('value')} AS value FROM logc")
def log_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ad.orders(spark, d).layer(), "value")


@query(f"""WITH {O}, j AS (SELECT * FROM counts JOIN obs USING (cell_id)), r AS (SELECT cell_id, sum(value) AS r FROM j GROUP BY 1), c AS (SELECT batch, gene_id, sum(value) AS c FROM j GROUP BY 1, 2), t AS (SELECT batch, sum(value) AS t FROM j GROUP BY 1),
n AS (SELECT batch, count(*) AS n FROM obs GROUP BY 1), g AS (SELECT o.cell_id, o.batch, c.gene_id, coalesce(r.r, 0) * c.c / t.t AS mu, n.n, coalesce(x.value, 0) AS x FROM obs o JOIN n USING (batch) JOIN t USING (batch) JOIN c USING (batch) LEFT JOIN r ON r.cell_id = o.cell_id LEFT JOIN counts x ON x.cell_id = o.cell_id AND x.gene_id = c.gene_id)
SELECT cell_id, batch, gene_id, {s6('greatest(least(coalesce((x - mu) / nullif(sqrt(mu + mu * mu / 100), 0), 0), sqrt(n)), -sqrt(n))')} AS value FROM g""")
def pearson_residuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.pearson_residuals(ad.orders(spark, d), batch_key="batch", layer="counts"), "value")


@query(f"WITH {O}, t AS (SELECT sum(value) AS total_counts FROM counts GROUP BY cell_id), u AS (SELECT total_counts, count(*) AS n_cells FROM t GROUP BY 1) SELECT total_counts, n_cells, CAST(sum(n_cells) OVER (ORDER BY total_counts DESC) AS BIGINT) AS rank FROM u")
def barcode_ranks(spark: SparkSession, d: str) -> DataFrame:
    return quality.barcode_ranks(ad.orders(spark, d), "counts")


@query(f"""WITH {O}, {grid_sql('one', 'logc', 'exp(value) - 1').replace('FROM obs GROUP BY ALL', 'FROM (SELECT *, 0 AS one FROM obs) GROUP BY ALL').replace('JOIN obs USING (cell_id)', 'JOIN (SELECT *, 0 AS one FROM obs) USING (cell_id)')},
x AS (SELECT gene_id, ln(1 + t / n) AS means, CASE WHEN q - t * t / n > 0 AND t > 0 THEN ln((q - t * t / n) / (n - 1) / (t / n)) END AS dispersions FROM st),
y AS (SELECT *, least(floor((means - min(means) OVER ()) / nullif(max(means) OVER () - min(means) OVER (), 0) * 5), 4) AS b FROM x),
z AS (SELECT gene_id, means, dispersions, CASE WHEN count(dispersions) OVER w < 2 THEN 1.0 ELSE (dispersions - avg(dispersions) OVER w) / nullif(stddev_samp(dispersions) OVER w, 0) END AS norm FROM y WINDOW w AS (PARTITION BY b))
SELECT gene_id, {s6('means')} AS means, {s6('dispersions')} AS dispersions, {s6('norm', 4)} AS dispersions_norm FROM z""")
def highly_variable(spark: SparkSession, d: str) -> DataFrame:
    h = quality.highly_variable(ad.orders(spark, d), n_top=10, bins=5)
    return rounded(rounded(h, "means", "dispersions"), "dispersions_norm", digits=4).select("gene_id", "means", "dispersions", "dispersions_norm")


@query()
def doublet_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.doublet_scores(ad.orders(spark, d), layer="counts")


# Tests

REST = f"""{grid_sql('condition', 'logc', 'exp(value) - 1')}, rs AS (SELECT condition, gene_id, n, t, q, nz, sum(n) OVER (PARTITION BY gene_id) - n AS n2, sum(t) OVER (PARTITION BY gene_id) - t AS t2, sum(q) OVER (PARTITION BY gene_id) - q AS q2, sum(nz) OVER (PARTITION BY gene_id) - nz AS nz2 FROM st),
ss AS (SELECT condition AS "group", gene_id AS gene, CAST(n AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, ln(1 + t / n) AS mean1, ln(1 + t2 / n2) AS mean2, (q - t * t / n) / (n - 1) AS var1, (q2 - t2 * t2 / n2) / (n2 - 1) AS var2, nz / n AS pts1, nz2 / n2 AS pts2, log2((t / n + 1e-9) / (t2 / n2 + 1e-9)) AS log2fc FROM rs)"""


@query(f"WITH {O}, {REST} SELECT \"group\", gene, n1, n2, {s6('mean1')} AS mean1, {s6('mean2')} AS mean2, {s6('var1', 2)} AS var1, {s6('var2', 2)} AS var2, {s6('pts1')} AS pts1, {s6('pts2')} AS pts2, {s6('log2fc')} AS log2fc FROM ss")
def basic_stats_rest(spark: SparkSession, d: str) -> DataFrame:
    s = testing.two_sample_stats(ad.orders(spark, d), "condition")
    return rounded(rounded(s, "mean1", "mean2", "pts1", "pts2", "log2fc"), "var1", "var2", digits=2)


T_SQL = f"""SELECT "group", gene, {s6('(mean1 - mean2) / sqrt(var1 / n1 + var2 / {m})')} AS score, {s6('pow(var1 / n1 + var2 / {m}, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / {m}, 2) / ({m} - 1))', 3)} AS df FROM ss"""


@query(f"WITH {O}, {REST} " + T_SQL.replace("{m}", "n2"))
def ttest_rest(spark: SparkSession, d: str) -> DataFrame:
    t = testing.with_t(testing.two_sample_stats(ad.orders(spark, d), "condition"))
    return rounded(rounded(t, "score"), "df", digits=3).select("group", "gene", "score", "df")


@query(f"WITH {O}, {REST} " + T_SQL.replace("{m}", "n1"))
def ttest_overestim(spark: SparkSession, d: str) -> DataFrame:
    t = testing.with_t(testing.two_sample_stats(ad.orders(spark, d), "condition"), True)
    return rounded(rounded(t, "score"), "df", digits=3).select("group", "gene", "score", "df")


REF = f"""{grid_sql('condition', 'logc', 'exp(value) - 1')}, ss AS (SELECT a.condition AS "group", a.gene_id AS gene, a.n AS n1, b.n AS n2, ln(1 + a.t / a.n) AS mean1, ln(1 + b.t / b.n) AS mean2, (a.q - a.t * a.t / a.n) / (a.n - 1) AS var1, (b.q - b.t * b.t / b.n) / (b.n - 1) AS var2
 FROM st a JOIN st b ON a.gene_id = b.gene_id AND b.condition = 'F' WHERE a.condition <> 'F')"""


@query(f"WITH {O}, {REF} " + T_SQL.replace("{m}", "n2"))
def ttest_ref(spark: SparkSession, d: str) -> DataFrame:
    t = testing.with_t(testing.two_sample_stats(ad.orders(spark, d), "condition", reference="F"))
    return rounded(rounded(t, "score"), "df", digits=3).select("group", "gene", "score", "df")


def wilcoxon_sql(by: str, cells: str) -> str:
    """z of the condition ``grp`` of table ``cells`` (cell_id, by…, cmp, grp), all zeros filled in, by plain ranks."""
    b = f"{by}, " if by else ""
    return f"""f AS (SELECT {b}cmp, grp, gene_id, round(coalesce(value, 0), 9) AS v FROM (SELECT * FROM {cells}, var) LEFT JOIN logc USING (cell_id, gene_id)),
k AS (SELECT *, rank() OVER (PARTITION BY {b}cmp, gene_id ORDER BY v) + (count(*) OVER (PARTITION BY {b}cmp, gene_id, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY {b}cmp, gene_id, v) AS c, count(*) OVER (PARTITION BY {b}cmp, gene_id) AS n FROM f),
u AS (SELECT {b}cmp, gene_id, max(n) AS n, sum(CAST(c AS DOUBLE) * c - 1) AS tie FROM k GROUP BY ALL), w AS (SELECT {b}cmp, grp, gene_id, sum(r) AS r, count(*) AS m FROM k GROUP BY ALL),
z AS (SELECT {b}cmp, grp, gene_id AS gene, coalesce((r - m * (n + 1) / 2) / nullif(sqrt((1 - tie / (CAST(n AS DOUBLE) * n * n - n)) * m * (n - m) * (n + 1) / 12), 0), 0) AS score, m AS n1, n - m AS n2 FROM w JOIN u USING ({b}cmp, gene_id))"""


@query(f"WITH {O}, a AS (SELECT cell_id, '' AS cmp, condition AS grp FROM obs), {wilcoxon_sql('', 'a')} SELECT grp AS \"group\", gene, {s6('score')} AS score FROM z")
def wilcoxon_rest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(testing.rank_genes_groups(ad.orders(spark, d), "condition"), "score").select("group", "gene", "score")


@query(f"WITH {O}, a AS (SELECT cell_id, c.cmp, condition AS grp FROM obs, (SELECT DISTINCT condition AS cmp FROM obs WHERE condition <> 'F') c WHERE condition IN ('F', c.cmp)), {wilcoxon_sql('', 'a')} SELECT grp AS \"group\", gene, {s6('score')} AS score FROM z WHERE grp = cmp")
def wilcoxon_ref(spark: SparkSession, d: str) -> DataFrame:
    return rounded(testing.rank_genes_groups(ad.orders(spark, d), "condition", reference="F"), "score").select("group", "gene", "score")


RANKED_GENES = f"""WITH {O}, a AS (SELECT cell_id, annotation, c.cmp, condition AS grp FROM obs, (SELECT DISTINCT condition AS cmp FROM obs WHERE condition <> 'F') c WHERE condition IN ('F', c.cmp)), {wilcoxon_sql('annotation', 'a')},
{grid_sql('annotation, condition', 'logc', 'exp(value) - 1')}, rk AS (SELECT z.annotation, grp AS "group", gene, score, {norm_p('score')} AS pval, log2((x.t / x.n + 1e-9) / (y.t / y.n + 1e-9)) AS log2fc, x.nz / x.n AS pts, y.nz / y.n AS pts_rest
FROM z JOIN st x ON x.annotation = z.annotation AND x.condition = grp AND x.gene_id = gene JOIN st y ON y.annotation = z.annotation AND y.condition = 'F' AND y.gene_id = gene WHERE grp = cmp AND n1 >= 2 AND n2 >= 2), {bh_sql('rk', 'annotation, "group"')}"""
P_DIGITS = 5


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return testing.rank_genes_groups(ad.orders(spark, d), "condition", by="annotation", reference="F")


@query(f"""{RANKED_GENES} SELECT annotation, "group", gene, {', '.join(f'{s6(c)} AS {c}' for c in ('score', 'log2fc', 'pts', 'pts_rest'))}, {', '.join(f'{s6(c, P_DIGITS)} AS {c}' for c in ('pval', 'padj'))} FROM adj""")
def rank_genes_condition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_ranked(spark, d), "score", "log2fc", "pts", "pts_rest"), "pval", "padj", digits=P_DIGITS)


@query(f"""{RANKED_GENES} SELECT annotation, "group", gene AS "GeneName", {s6('score')} AS statistic, {s6('pval', P_DIGITS)} AS pvals, {s6('padj', P_DIGITS)} AS padj, {s6('log2fc')} AS log2fc, {s6('pts')} AS pts_group, {s6('pts_rest')} AS pts_ref
FROM adj WHERE log2fc >= -0.1 AND padj <= 0.75""")
def rank_genes_pvalues(spark: SparkSession, d: str) -> DataFrame:
    """The ranking under the names of result tables, filtered."""
    t = testing.dge_results(_ranked(spark, d), min_log2fc=-0.1, padj_cutoff=0.75)
    return rounded(rounded(t, "statistic", "log2fc", "pts_group", "pts_ref"), "pvals", "padj", digits=P_DIGITS)


DGE = "d AS (SELECT annotation, groups, genename, pvals, log2fc, padj, pts_group, pts_ref FROM dge_results WHERE groups IS NOT NULL AND genename IS NOT NULL AND isfinite(pvals) AND isfinite(log2fc) AND isfinite(padj))"


def _dge(spark: SparkSession, d: str) -> DataFrame:
    inf = F.lit(float("inf"))
    t = ad.table(spark, d, "dge_results").where("groups IS NOT NULL AND genename IS NOT NULL")
    for c in ("pvals", "log2fc", "padj"):
        t = t.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    return t.select("annotation", "groups", "genename", "pvals", "log2fc", "padj", "pts_group", "pts_ref")


@query(f"""WITH {DGE}, b AS (SELECT groups, genename, min(pvals) AS p FROM d GROUP BY ALL), q AS (SELECT *, p * count(*) OVER (PARTITION BY groups) / count(*) OVER (PARTITION BY groups ORDER BY p) AS q FROM b)
SELECT groups, genename, p, round(least(min(q) OVER (PARTITION BY groups ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS adjusted FROM q""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    b = _dge(spark, d).groupBy("groups", "genename").agg(F.min("pvals").alias("p"))
    return testing.adjust(b, "p", ["groups"], out="adjusted").withColumn("adjusted", F.round("adjusted", 9))


@query(f"WITH {DGE}, b AS (SELECT groups, genename, min(pvals) AS p FROM d GROUP BY ALL) SELECT groups, genename, round(least(p * count(*) OVER (PARTITION BY groups), 1), 9) AS adjusted FROM b")
def bonferroni_adjust(spark: SparkSession, d: str) -> DataFrame:
    b = _dge(spark, d).groupBy("groups", "genename").agg(F.min("pvals").alias("p"))
    return testing.adjust(b, "p", ["groups"], "bonferroni", "adjusted").select("groups", "genename", F.round("adjusted", 9).alias("adjusted"))


@query(f"WITH {DGE} SELECT groups, CASE WHEN pts_group > 0.25 AND pts_ref < 0.5 AND log2fc > 1 THEN genename END AS gene, log2fc FROM d")
def filter_rank_genes(spark: SparkSession, d: str) -> DataFrame:
    t = _dge(spark, d).withColumnsRenamed({"genename": "gene", "pts_group": "pts", "pts_ref": "pts_rest"})
    return testing.filter_rank_genes(t).select("groups", "gene", "log2fc")


@query(f"WITH {DGE} SELECT groups, genename, 'up' AS state FROM d WHERE padj < 0.05 AND log2fc > 0.25 UNION ALL SELECT groups, genename, 'down' FROM d WHERE padj < 0.05 AND log2fc < -0.25")
def up_and_down(spark: SparkSession, d: str) -> DataFrame:
    up, down = testing.up_and_down(_dge(spark, d))
    return up.withColumn("state", F.lit("up")).union(down.withColumn("state", F.lit("down"))).select("groups", "genename", "state")


@query(f"""WITH {O}, {grid_sql('annotation, condition, batch', 'logc', 'exp(value) - 1')}, m AS (SELECT annotation, condition, gene_id AS gene, count(*) AS n, avg(ln(1 + t / n)) AS m, var_samp(ln(1 + t / n)) AS v FROM st GROUP BY ALL)
SELECT gene, annotation, c1 || '-Vs-' || c2 AS condition, {s6('t', 5)} AS statistic, {s6(t_p('t', 'df'), 5)} AS pval FROM (SELECT a.gene, a.annotation, a.condition AS c1, b.condition AS c2, a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t
 FROM m a JOIN m b ON a.gene = b.gene AND a.annotation = b.annotation AND a.condition < b.condition)""")
def grouped_ttest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(testing.grouped_ttest(ad.orders(spark, d)), "statistic", "pval", digits=5)


@query("""WITH g AS (SELECT o_orderpriority AS k, o_orderstatus AS g, count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q FROM orders GROUP BY ALL), t AS (SELECT k AS p, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g GROUP BY 1)
SELECT o_orderpriority, round(f, 5) AS statistic, df1, df2, """ + s6(f_p("f", "df1", "df2"), 5) + """ AS pval FROM (SELECT p AS o_orderpriority, (b - s * s / n) / (k - 1) / ((q - b) / (n - k)) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM t)""")
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    return rounded(testing.anova(ad.table(spark, d, "orders"), "o_totalprice", "o_orderstatus", ["o_orderpriority"]), "statistic", "pval", digits=5)


RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY p) + (count(*) OVER (PARTITION BY o_orderpriority, p) - 1) / 2 AS r, CAST(count(*) OVER (PARTITION BY o_orderpriority, p) AS DOUBLE) AS c FROM o)"


@query(f"""WITH o AS (SELECT o_orderpriority, o_orderstatus AS g, round(o_totalprice, -3) AS p FROM orders), {RANKED}, g AS (SELECT o_orderpriority, g, count(*) AS n, sum(r) AS r, sum(c * c - 1) AS t FROM r GROUP BY ALL), t AS (SELECT o_orderpriority, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS s, sum(t) AS t FROM g GROUP BY 1)
SELECT o_orderpriority, round(h, 5) AS statistic, df, CASE df WHEN 2 THEN {s6('exp(-h / 2)', 5)} WHEN 1 THEN {s6(norm_p('sqrt(h)'), 5)} END AS pval FROM (SELECT o_orderpriority, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, k - 1 AS df FROM t)""")
def kruskal_h(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders").withColumn("p", F.round("o_totalprice", -3))
    return rounded(testing.kruskal(o, "p", "o_orderstatus", ["o_orderpriority"]), "statistic", "pval", digits=5)


@query(f"""WITH o AS (SELECT o_orderpriority, o_orderstatus AS g, round(o_totalprice, -3) AS p FROM orders WHERE o_orderstatus IN ('F', 'P')), {RANKED}, t AS (SELECT o_orderpriority, CAST(count(*) FILTER (g = 'F') AS DOUBLE) AS a, CAST(count(*) FILTER (g = 'P') AS DOUBLE) AS b, sum(r) FILTER (g = 'F') AS r, sum(c * c - 1) AS t FROM r GROUP BY 1),
u AS (SELECT *, r - a * (a + 1) / 2 AS u FROM t) SELECT o_orderpriority, u AS statistic, round(greatest((greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))), 0), 6) AS z, {s6(norm_p('z'), 5)} AS pval FROM u""")
def mannwhitney_u(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders").withColumn("p", F.round("o_totalprice", -3))
    return rounded(testing.mann_whitney(o, "p", "o_orderstatus", "F", "P", ["o_orderpriority"]), "z").withColumn("pval", r6("pval", 5))


# Views

DOT = f"{O}, {grid_sql('condition', 'logc', 'exp(value) - 1')}"


@query(f"WITH {DOT} SELECT gene_id AS gene, condition, {s6('coalesce((ln(1 + t / n) - min(ln(1 + t / n)) OVER w) / nullif(max(ln(1 + t / n)) OVER w - min(ln(1 + t / n)) OVER w, 0), 0)')} AS expr, {s6('nz / n')} AS pct FROM st WINDOW w AS (PARTITION BY gene_id)")
def dotplot_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.dotplot(ad.orders(spark, d), x_axis="condition", features=None, standard_scale="var"), "expr", "pct")


@query(f"WITH {DOT} SELECT gene_id AS gene, condition, {s6('coalesce(ln(1 + t / nullif(nz, 0)), 0)')} AS expr, {s6('nz / n')} AS pct FROM st")
def dotplot_expressing_only(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.dotplot(ad.orders(spark, d), x_axis="condition", features=None, mean_only_expressed=True), "expr", "pct")


@query(f"WITH {O}, {grid_sql('condition, annotation', 'logc', 'exp(value) - 1')}, m AS (SELECT *, ln(1 + t / n) AS m FROM st) SELECT gene_id AS gene, condition, annotation, {s6('coalesce((m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0), 0)', 5)} AS expr, {s6('nz / n')} AS pct FROM m WINDOW w AS (PARTITION BY gene_id, condition)")
def dotplot_two_axes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(views.dotplot(ad.orders(spark, d), x_axis="condition", y_axis="annotation", features=None, z_score="x"), "pct"), "expr", digits=5)


@query(f"WITH {DOT}, m AS (SELECT *, ln(1 + t / n) AS m FROM st) SELECT gene_id AS gene, condition, {s6('coalesce((m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0), 0)', 5)} AS expr FROM m WINDOW w AS (PARTITION BY gene_id)")
def heatmap_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.heatmap(ad.orders(spark, d), keys="condition", z_score="var"), "expr", digits=5)


@query(f"""WITH {O}, {grid_sql('annotation, condition', 'logc', 'exp(value) - 1')} SELECT a.gene_id AS genes, a.annotation AS "group", a.condition, {s6('log2((a.t / a.n + 1e-9) / (b.t / b.n + 1e-9))')} AS log2fc FROM st a JOIN st b ON a.gene_id = b.gene_id AND a.annotation = b.annotation AND b.condition = 'F' WHERE a.condition <> 'F'""")
def heatmap_foldchange(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.heatmap_foldchange(ad.orders(spark, d), group_by="annotation", condition_key="condition", reference="F"), "log2fc")


@query(f"""WITH {DGE}, c AS (SELECT genename AS gene, greatest(least(log2fc, 6), -6) AS log2fc, greatest(padj, 2e-10) AS padj FROM d) SELECT gene, log2fc, {s6('padj', 9)} AS padj, {s6('-log10(padj)')} AS y, CASE WHEN padj < 0.05 AND log2fc > 0.25 THEN 'Up' WHEN padj < 0.05 AND log2fc < -0.25 THEN 'Down' WHEN padj < 0.05 THEN 'P' WHEN abs(log2fc) > 0.25 THEN 'LFC' ELSE 'NS' END AS class, class IN ('Up', 'Down') AND rank() OVER (PARTITION BY class ORDER BY abs(log2fc) DESC, gene) <= 10 AS label
FROM c WHERE c.padj < 1 AND c.padj > 2e-10 AND c.log2fc > -6 AND c.log2fc < 6""")
def volcano_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(views.volcano(_dge(spark, d), gene="genename"), "y"), "padj", digits=9)


PROFILE = f"{O}, {grid_sql('annotation', 'logc', 'exp(value) - 1')}, m AS (SELECT annotation AS g, gene_id, ln(1 + t / n) AS m FROM st)"


@query(f"WITH {PROFILE} SELECT a.g AS a, b.g AS b, {s6('corr(a.m, b.m)', 5)} AS r FROM m a JOIN m b USING (gene_id) GROUP BY ALL")
def correlation_pearson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.correlation(ad.orders(spark, d), group_by="annotation"), "r", digits=5)


@query(f"WITH {PROFILE}, k AS (SELECT g, gene_id, rank() OVER (PARTITION BY g ORDER BY round(m, 9)) + (count(*) OVER (PARTITION BY g, round(m, 9)) - 1) / 2 AS m FROM m) SELECT a.g AS a, b.g AS b, {s6('corr(a.m, b.m)', 5)} AS r FROM k a JOIN k b USING (gene_id) GROUP BY ALL")
def correlation_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.correlation(ad.orders(spark, d), group_by="annotation", method="spearman"), "r", digits=5)


@query(f"""WITH {PROFILE}, k AS (SELECT g, gene_id, round(m, 9) AS m FROM m), p AS (SELECT a.g AS a, b.g AS b, sign(a.m - c.m) AS dx, sign(b.m - e.m) AS dy FROM k a JOIN k b ON a.gene_id = b.gene_id JOIN k c ON c.g = a.g AND c.gene_id > a.gene_id JOIN k e ON e.g = b.g AND e.gene_id = c.gene_id)
SELECT a, b, {s6('sum(dx * dy) / sqrt(CAST(sum(dx * dx) AS DOUBLE) * sum(dy * dy))')} AS r FROM p GROUP BY ALL""")
def correlation_kendall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.correlation(ad.orders(spark, d), group_by="annotation", method="kendall"), "r")


COMPOSED = f"""{ad.CELLS}, k AS (SELECT * FROM cells WHERE batch IS NOT NULL AND condition IS NOT NULL AND annotation IS NOT NULL), n AS (SELECT batch, condition, annotation, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT batch, condition, sum(n) AS t FROM n GROUP BY ALL),
g AS (SELECT t.batch, t.condition, a.annotation, t.t, coalesce(n.n, 0) AS n FROM t CROSS JOIN (SELECT DISTINCT annotation FROM n) a LEFT JOIN n ON n.batch = t.batch AND n.condition = t.condition AND n.annotation = a.annotation)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    return ad.cells(spark, d).where("batch IS NOT NULL AND condition IS NOT NULL AND annotation IS NOT NULL")


@query(f"WITH {COMPOSED} SELECT condition, annotation, {s6('avg(n / t)')} AS mean_prop, {s6('stddev_samp(n / t)')} AS sd_prop, count(*) AS n_batches FROM g GROUP BY ALL")
def cell_composition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.cell_composition(_known(spark, d), annot_key="annotation", condition_key="condition", batch_key="batch"), "mean_prop", "sd_prop")


@query(f"""WITH {COMPOSED}, v AS (SELECT annotation, condition, ln(((n + 0.5) / (t + 1)) / (1 - (n + 0.5) / (t + 1))) AS v FROM g), s AS (SELECT annotation, condition, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM v GROUP BY ALL), z AS (SELECT annotation, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM s GROUP BY 1)
SELECT annotation, {s6('f', 5)} AS statistic, df1, df2, {s6(f_p('f', 'df1', 'df2'), 5)} AS pval FROM (SELECT annotation, (b - s * s / n) / (k - 1) / ((q - b) / (n - k)) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM z)""")
def composition_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.composition_test(_known(spark, d), annot_key="annotation", condition_key="condition", batch_key="batch"), "statistic", "pval", digits=5)


@query(f"""WITH {ad.SETS}, t AS (SELECT term, avg(padj) AS p, regexp_extract(term, '[^:]*$') AS c FROM sets GROUP BY term), v AS (SELECT upper(term[1]) || lower(term[2:]) AS term, c AS condition, CASE WHEN c = 'disease' THEN 1 ELSE -1 END * -log10(greatest(p, 1e-300)) AS v FROM t)
SELECT term, condition, {s6('v')} AS value, CAST(row_number() OVER (PARTITION BY condition = 'disease' ORDER BY abs(v) DESC, term) AS INTEGER) AS place FROM v QUALIFY place <= 10""")
def split_bar(spark: SparkSession, d: str) -> DataFrame:
    t = ad.sets(spark, d).groupBy("term").agg(F.avg("padj").alias("p")).withColumn("c", F.regexp_extract("term", "[^:]*$", 0))
    return rounded(views.split_bar(t, term="term", split="p", cond="c", pos_cond="disease"), "value")


@query("""WITH q AS (SELECT o_orderstatus, count(o_totalprice) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderstatus, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(o_totalprice) AS low, max(o_totalprice) AS high FROM q JOIN orders USING (o_orderstatus) WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.box_stats(ad.table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"]), "q1", "median", "q3")


@query("""WITH v AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL), s AS (SELECT g, sum(w) AS n, pow(sum(w), -0.2) * 0.5 * sqrt((sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)) / (sum(w) - 1)) AS h FROM v GROUP BY g),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM v), x AS (SELECT lo + (hi - lo) * i / 499 AS x FROM e, range(500) r(i)) SELECT g AS l_returnflag, round(x, 6) AS x, round(sum(w * exp(-pow((x - v) / h, 2) / 2) / (n * h * 2.5066282746310002)), 8) AS density FROM v JOIN s USING (g), x GROUP BY ALL""")
def kde_1d(spark: SparkSession, d: str) -> DataFrame:
    out = views.kde_1d(ad.table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return out.select("l_returnflag", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(f"""WITH {ad.VECTORS}, p AS (SELECT annotation AS g, vec[1] AS x, vec[2] AS y FROM vecs), s AS (SELECT g, count(*) AS n, pow(count(*), -1.0 / 6) * 0.5 * sqrt(greatest(var_samp(x), 1e-10)) AS hx, pow(count(*), -1.0 / 6) * 0.5 * sqrt(greatest(var_samp(y), 1e-10)) AS hy FROM p GROUP BY g),
e AS (SELECT min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy FROM p), c AS (SELECT CAST(i AS INTEGER) AS gx, CAST(j AS INTEGER) AS gy, lx + (ux - lx) * i / 49 AS x, ly + (uy - ly) * j / 49 AS y FROM e, range(50) a(i), range(50) b(j))
SELECT g AS annotation, gx, gy, round(c.x, 6) + 0.0 AS x, round(c.y, 6) + 0.0 AS y, round(sum(exp(-pow((c.x - p.x) / hx, 2) / 2 - pow((c.y - p.y) / hy, 2) / 2)) / any_value(n * hx * hy * 6.283185307179586), 7) + 0.0 AS density FROM p JOIN s USING (g), c GROUP BY g, gx, gy, c.x, c.y""")
def density_2d(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    p = exp.obsm["X_emb"].select("cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")).join(exp.obs, "cell_id")
    return rounded(rounded(views.density_2d(p, x="x", y="y", by="annotation"), "x", "y"), "density", digits=7)


# Gene sets

SIZED = f"{ad.SETS}, m AS (SELECT DISTINCT term, gene FROM sets), z AS (SELECT term, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY 1), k AS (SELECT a.term AS a, b.term AS b, CAST(count(*) AS DOUBLE) AS k FROM m a JOIN m b USING (gene) WHERE a.term < b.term GROUP BY ALL), pr AS (SELECT x.term AS a, y.term AS b, x.n AS na, y.n AS nb, coalesce(k.k, 0) AS k FROM z x JOIN z y ON x.term < y.term LEFT JOIN k ON k.a = x.term AND k.b = y.term)"
JACCARD = f"{SIZED}, sim AS (SELECT a, b, k / (na + nb - k) AS s FROM pr)"


def _sims(spark: SparkSession, d: str, how: str) -> DataFrame:
    return ora.similarities(ad.sets(spark, d), how)


@query(f"WITH {SIZED} SELECT a, b, round(k / least(na, nb), 9) AS s FROM pr")
def ora_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sims(spark, d, "overlap"), "s", digits=9)


@query(f"WITH {JACCARD} SELECT a, b, round(s, 9) AS s FROM sim")
def ora_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sims(spark, d, "jaccard"), "s", digits=9)


@query(f"WITH {SIZED}, u AS (SELECT CAST(count(DISTINCT gene) AS DOUBLE) AS u FROM m), e AS (SELECT a, b, (k + u - na - nb + k) / u AS po, (na * nb + (u - na) * (u - nb)) / (u * u) AS pe FROM pr, u) SELECT a, b, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / nullif(1 - pe, 0) END, 8) + 0.0 AS s FROM e")
def ora_kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sims(spark, d, "kappa"), "s", digits=8)


THRESHOLD = 0.02
GRAPH = f"{JACCARD}, bo AS (SELECT a, b, s FROM sim WHERE s >= {THRESHOLD} UNION ALL SELECT b, a, s FROM sim WHERE s >= {THRESHOLD}), nn AS (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b DESC) <= 5), gr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, s FROM nn)"


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return ora.similarity_graph(ora.similarities(ad.sets(spark, d), "jaccard", all_pairs=False), 5, THRESHOLD)


@query(f"WITH {GRAPH} SELECT a, b, round(s, 9) AS s FROM gr")
def ora_knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_graph(spark, d), "s", digits=9)


COMPONENTS = f"""WITH RECURSIVE {GRAPH}, un AS (SELECT a, b FROM gr UNION ALL SELECT b, a FROM gr), cc(term, root) AS (SELECT DISTINCT term, term FROM sets UNION SELECT un.b, cc.root FROM cc JOIN un ON un.a = cc.term WHERE cc.root < un.b),
co AS (SELECT term, min(root) AS component FROM cc GROUP BY term)"""


@query(f"{COMPONENTS} SELECT term, component FROM co WHERE component IN (SELECT component FROM co GROUP BY 1 HAVING count(*) >= 3)")
def ora_components(spark: SparkSession, d: str) -> DataFrame:
    return ora.drop_small(_graph(spark, d), ad.sets(spark, d).select("term").distinct(), 3)


@query(f"""{COMPONENTS}, p AS (SELECT term, round(avg(padj), 12) AS padj FROM sets GROUP BY term), dg AS (SELECT term, sum(s) AS degree FROM (SELECT a AS term, s FROM gr UNION ALL SELECT b, s FROM gr) GROUP BY 1)
SELECT component AS cluster, term, padj, {s6('coalesce(degree, 0)')} AS degree FROM co JOIN p USING (term) LEFT JOIN dg USING (term) QUALIFY row_number() OVER (PARTITION BY component ORDER BY padj, term) = 1""")
def ora_representatives(spark: SparkSession, d: str) -> DataFrame:
    sets = ad.sets(spark, d)
    g = _graph(spark, d)
    clusters = ora.cluster_terms(g, sets, "components", graph=g)
    return rounded(ora.representatives(clusters, g, sets.groupBy("term").agg(F.round(F.avg("padj"), 12).alias("padj"))), "degree")


@query(f"""{COMPONENTS}, p AS (SELECT term, round(avg(padj), 12) AS padj FROM sets GROUP BY term), dg AS (SELECT term, sum(s) AS degree FROM (SELECT a AS term, s FROM gr UNION ALL SELECT b, s FROM gr) GROUP BY 1)
SELECT component AS cluster, term, padj, {s6('coalesce(degree, 0)')} AS degree FROM co JOIN p USING (term) LEFT JOIN dg USING (term) QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(coalesce(degree, 0), 9) DESC, term) = 1""")
def ora_central_terms(spark: SparkSession, d: str) -> DataFrame:
    """Representatives by weighted degree."""
    sets = ad.sets(spark, d)
    g = _graph(spark, d)
    clusters = ora.cluster_terms(g, sets, "components", graph=g)
    return rounded(ora.representatives(clusters, g, sets.groupBy("term").agg(F.round(F.avg("padj"), 12).alias("padj")), "degree"), "degree")


@query()
def ora_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return ora.cluster_terms(_sims(spark, d, "jaccard"), ad.sets(spark, d))


@query(f"""WITH {ad.SETS}, m AS (SELECT DISTINCT term, gene FROM sets), g AS (SELECT DISTINCT genename AS gene FROM dge_results WHERE log2fc > 2 AND NOT isnan(log2fc) AND genename IS NOT NULL),
e AS (SELECT term, CAST(count(g.gene) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n_set, CAST((SELECT count(*) FROM g) AS DOUBLE) AS n_genes, CAST((SELECT count(*) FROM (SELECT gene FROM m UNION SELECT gene FROM g)) AS DOUBLE) AS universe FROM m LEFT JOIN g USING (gene) GROUP BY term HAVING count(g.gene) > 0)
SELECT *, round(least(list_sum(list_transform(range(CAST(k AS BIGINT), CAST(least(n_set, n_genes) AS BIGINT) + 1), lambda i: exp(lgamma(n_set + 1) - lgamma(i + 1) - lgamma(n_set - i + 1) + CASE WHEN n_genes - i > universe - n_set THEN -1e9
 ELSE lgamma(universe - n_set + 1) - lgamma(n_genes - i + 1) - lgamma(greatest(universe - n_set - n_genes + i, 0) + 1) END - lgamma(universe + 1) + lgamma(n_genes + 1) + lgamma(universe - n_genes + 1)))), 1), 5) + 0.0 AS pval FROM e""")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    genes = ad.table(spark, d, "dge_results").where("log2fc > 2 AND NOT isnan(log2fc) AND genename IS NOT NULL").select(F.col("genename").alias("gene"))
    return rounded(ora.enrichment(genes, ad.sets(spark, d)), "pval", digits=5)


# Neighbours and integration

PAIRS = f"{ad.VECTORS}, dd AS (SELECT a.cell_id AS src, b.cell_id AS dst, a.annotation AS la, b.annotation AS lb, a.batch AS ba, b.batch AS bb, list_distance(a.vec, b.vec) AS d FROM vecs a, vecs b)"


@query(f"WITH {PAIRS} SELECT src, dst, {s6('d')} AS dist, CAST(row_number() OVER (PARTITION BY src ORDER BY round(d, 6), dst) AS INTEGER) AS place FROM dd WHERE src <> dst QUALIFY place <= 15")
def knn(spark: SparkSession, d: str) -> DataFrame:
    return nb.knn(ad.vectors(spark, d).obsm["X_emb"])


@query(f"WITH {PAIRS} SELECT src, dst, {s6('d')} AS dist, CAST(row_number() OVER (PARTITION BY src ORDER BY round(d, 6), dst) AS INTEGER) AS place FROM dd WHERE src <> dst AND la = lb QUALIFY place <= 15")
def knn_within(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the same label, as reclustering links them."""
    exp = ad.vectors(spark, d)
    return nb.knn(exp.obsm["X_emb"].join(exp.obs.select("cell_id", "annotation"), "cell_id"), within="annotation")


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Batch b0, and all other batches: every vector is in one of both sets."""
    exp = ad.vectors(spark, d)
    v = written(exp.obsm["X_emb"].join(exp.obs, "cell_id"))
    return v.where("batch = 'b0'").select("cell_id", "vec"), v.where("batch <> 'b0'").select("cell_id", "vec")


SIDES = f"{ad.VECTORS}, sv AS MATERIALIZED (SELECT cell_id, batch = 'b0' AS a, vec FROM vecs)"
CROSS = f"""{SIDES}, cr AS MATERIALIZED (SELECT x.cell_id AS cell_a, y.cell_id AS cell_b, round(list_distance(x.vec, y.vec), 6) AS dist FROM sv x JOIN sv y ON x.a AND NOT y.a),
an AS MATERIALIZED (SELECT cell_a, cell_b, dist FROM (SELECT *, row_number() OVER (PARTITION BY cell_a ORDER BY dist, cell_b) AS p, row_number() OVER (PARTITION BY cell_b ORDER BY dist, cell_a) AS q FROM cr) WHERE p <= 5 AND q <= 5)"""
SCORED = f"""{CROSS}, ne AS MATERIALIZED (SELECT src, dst FROM (SELECT x.cell_id AS src, y.cell_id AS dst, row_number() OVER (PARTITION BY x.cell_id, y.a ORDER BY round(list_distance(x.vec, y.vec), 6), y.cell_id) AS p FROM sv x, sv y) WHERE p <= 30),
sh AS (SELECT cell_a, cell_b, count(y.dst) AS shared FROM an JOIN ne x ON x.src = cell_a LEFT JOIN ne y ON y.src = cell_b AND y.dst = x.dst GROUP BY ALL), qs AS (SELECT quantile_cont(shared, 0.01) AS lo, quantile_cont(shared, 0.9) AS hi FROM sh),
sc AS MATERIALIZED (SELECT cell_a, cell_b, shared, greatest(least(coalesce((shared - lo) / nullif(hi - lo, 0), 0), 1), 0) AS score FROM sh, qs)"""


@query(f"WITH {CROSS} SELECT cell_a, cell_b, dist + 0.0 AS dist FROM an")
def mnn_anchors(spark: SparkSession, d: str) -> DataFrame:
    return nb.mutual_neighbours(*_two(spark, d), 5)


@query(f"WITH {SCORED} SELECT cell_a, cell_b, CAST(shared AS INTEGER) AS shared, {s6('score')} AS score FROM sc")
def anchor_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return rounded(nb.score_anchors(nb.mutual_neighbours(a, b, 5), a, b), "score").drop("dist")


@query(f"""WITH {CROSS}, ln AS (SELECT cell_id, list_transform(vec, lambda v: v / sqrt(list_sum(list_transform(vec, lambda w: w * w)))) AS u, a FROM sv), nr AS (SELECT x.cell_id AS cell_a, y.cell_id AS cell_b FROM ln x JOIN ln y ON x.a AND NOT y.a
 QUALIFY row_number() OVER (PARTITION BY x.cell_id ORDER BY round(greatest(list_sum(list_transform(list_zip(x.u, y.u), lambda p: pow(p[1] - p[2], 2))), 0) / 2, 6), y.cell_id) <= 20) SELECT cell_a, cell_b, dist + 0.0 AS dist FROM an JOIN nr USING (cell_a, cell_b)""")
def anchors_filtered(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return nb.filter_anchors(nb.mutual_neighbours(a, b, 5), a, b, 20)


@query(f"""WITH {SCORED}, ends AS (SELECT DISTINCT cell_a FROM an), kn AS MATERIALIZED (SELECT src, cell_a, d, max(d) OVER (PARTITION BY src) AS far FROM (SELECT x.cell_id AS src, y.cell_id AS cell_a, round(list_distance(x.vec, y.vec), 6) AS d FROM sv x JOIN sv y ON x.a AND y.a AND y.cell_id IN (SELECT cell_a FROM ends)
 QUALIFY row_number() OVER (PARTITION BY x.cell_id ORDER BY d, y.cell_id) <= 100)),
wt AS (SELECT src, x.vec AS va, y.vec AS vb, 1 - exp(-(1 - coalesce(d / nullif(far, 0), 0)) * score / 4) AS w FROM kn JOIN sc USING (cell_a) JOIN sv x ON x.cell_id = sc.cell_a JOIN sv y ON y.cell_id = sc.cell_b),
mv AS (SELECT src, i, sum(w * (vb[i] - va[i])) / nullif(sum(w), 0) AS b FROM wt, (SELECT unnest(range(1, (SELECT len(any_value(vec)) FROM sv) + 1)) AS i) GROUP BY ALL)
SELECT cell_id, CAST(i - 1 AS INTEGER) AS place, {s6('vec[i] + coalesce(b, 0)', 5)} AS value FROM sv JOIN mv ON src = cell_id WHERE a""")
def anchor_correction(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    moved = nb.correct_by_anchors(a, b, nb.score_anchors(nb.mutual_neighbours(a, b, 5), a, b))
    return rounded(moved.select("cell_id", F.posexplode("vec").alias("place", "value")), "value", digits=5)


EDGES = f"{PAIRS}, ed AS (SELECT src, dst, la, lb FROM dd WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(d, 6), dst) <= 5), un AS (SELECT src, dst, la, lb FROM ed UNION SELECT dst, src, lb, la FROM ed)"


def _edges(spark: SparkSession, d: str, k: int = 5) -> tuple:
    exp = ad.vectors(spark, d)
    near = nb.knn(exp.obsm["X_emb"], None, k).select("src", "dst", F.lit(1.0).alias("weight"))
    return exp, near.union(near.select("dst", "src", "weight")).distinct()


@query(f"""WITH RECURSIVE {EDGES}, cc(id, root) AS (SELECT cell_id, cell_id FROM vecs UNION SELECT un.dst, cc.root FROM cc JOIN un ON un.src = cc.id WHERE un.la = un.lb AND cc.root < un.dst), co AS (SELECT id, min(root) AS root FROM cc GROUP BY id),
p AS (SELECT annotation, root, count(*) AS n FROM co JOIN vecs ON id = cell_id GROUP BY ALL) SELECT annotation AS label, CAST(sum(n) AS BIGINT) AS size, max(n) AS largest FROM p GROUP BY 1""")
def graph_connectivity(spark: SparkSession, d: str) -> DataFrame:
    exp, g = _edges(spark, d)
    return iq.connectivity_by_label(g, exp.obs, "annotation")


SIL = "se AS (SELECT src, {c} AS c, {o} AS o, {w} AS w, sum(d) AS s, count(*) AS n FROM dd WHERE {w} = {w2} GROUP BY ALL), sj AS (SELECT src, c, w, max(CASE WHEN o = c THEN s / nullif(n - 1, 0) END) AS a, max(CASE WHEN o = c THEN n END) AS n, min(CASE WHEN o <> c THEN s / n END) AS b FROM se GROUP BY ALL)"
SIL_LABEL = SIL.format(c="la", o="lb", w="''", w2="''")
SIL_BATCH = SIL.format(c="ba", o="bb", w="la", w2="lb")


@query(f"WITH {PAIRS}, {SIL_LABEL} SELECT src AS cell_id, c AS cluster, {s6('CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END', 5)} AS silhouette FROM sj")
def silhouette_cells(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    return rounded(iq.silhouettes(exp.obsm["X_emb"], exp.obs, "annotation"), "silhouette", digits=5).select("cell_id", "cluster", "silhouette")


@query(f"WITH {PAIRS}, {SIL_LABEL} SELECT {s6('(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) + 1) / 2', 5)} AS score FROM sj")
def silhouette_label(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    return rounded(iq.silhouette_label(exp.obsm["X_emb"], exp.obs, "annotation"), "score", digits=5)


@query(f"WITH {PAIRS}, {SIL_BATCH} SELECT w AS label, {s6('avg(1 - abs(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END))', 5)} AS score FROM sj GROUP BY w")
def silhouette_batch(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    return rounded(iq.silhouette_batch(exp.obsm["X_emb"], exp.obs, "batch", "annotation"), "score", digits=5)


@query()
def kbet(spark: SparkSession, d: str) -> DataFrame:
    exp, g = _edges(spark, d, 15)
    return iq.kbet(g, exp.obs, "batch", "annotation")


@query()
def pcr(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    v = exp.obsm["X_emb"]
    return spark.createDataFrame([(reduction.pcr(v, exp.obs, "annotation"), reduction.pcr(v, exp.obs, "batch"))], "by_annotation double, by_batch double")


@query(f"""WITH {O}, r AS (SELECT cell_id, sum(value) AS r FROM counts GROUP BY 1), c AS (SELECT gene_id, sum(value) AS c FROM counts GROUP BY 1), n AS (SELECT count(*) AS n FROM obs)
SELECT cell_id, gene_id, {s6('ln(1 + value / (r + 1e-5) * 1e5) * ln(1 + n / (c + 1e-5))')} AS value FROM counts JOIN r USING (cell_id) JOIN c USING (gene_id), n""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    return rounded(reduction.tf_idf(exp.layer("counts"), exp.obs.count()), "value")


@query()
def pca_embedding(spark: SparkSession, d: str) -> DataFrame:
    return reduction.pca(ad.vectors(spark, d).obsm["X_emb"], 10)[0]


@query()
def cca_embedding(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = reduction.cca(*_two(spark, d), 10)
    return a.union(b)


@query()
def lsi_embedding(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    genes = [r.gene_id for r in exp.var.orderBy("gene_id").collect()]
    return reduction.lsi(exp.layer("counts"), exp.obs, genes, 10)[0]


@query()
def harmony_embedding(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    return reduction.harmony(exp.obsm["X_emb"], exp.obs, "batch")


@query(f"""WITH RECURSIVE {ad.VECTORS}, ne AS MATERIALIZED (SELECT src, dst, d FROM (SELECT a.cell_id AS src, b.cell_id AS dst, round(list_distance(a.vec, b.vec), 6) AS d FROM vecs a JOIN vecs b ON a.cell_id <> b.cell_id) QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 14),
rh AS (SELECT src, coalesce(min(CASE WHEN d > 0 THEN d END), 0) AS rho, avg(d) AS own FROM ne GROUP BY 1), ov AS MATERIALIZED (SELECT ne.*, greatest(d - rho, 0) AS o, rho, own FROM ne JOIN rh USING (src)), li AS MATERIALIZED (SELECT src, list(o) AS o FROM ov GROUP BY 1),
bi(src, it, lo, hi, mid) AS (SELECT src, 0, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE FROM li UNION ALL SELECT src, it + 1, CASE WHEN s > log2(15) THEN lo ELSE mid END, CASE WHEN s > log2(15) THEN mid ELSE hi END, CASE WHEN s > log2(15) THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END
 FROM (SELECT bi.*, list_sum(list_transform(o, lambda v: exp(-v / mid))) AS s FROM bi JOIN li USING (src)) WHERE it < 64),
we AS (SELECT src, dst, exp(-o / greatest(mid, 1e-3 * CASE WHEN rho > 0 THEN own ELSE (SELECT avg(d) FROM ne) END)) AS w FROM ov JOIN bi USING (src) WHERE it = 64), bo AS (SELECT src, dst, w FROM we UNION ALL SELECT dst, src, w FROM we)
SELECT src, dst, {s6('CASE WHEN count(*) = 2 THEN sum(w) - product(w) ELSE max(w) END', 5)} AS weight FROM bo GROUP BY ALL""")
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nb.neighbour_graph(ad.vectors(spark, d).obsm["X_emb"]), "weight", digits=5)


@query()
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Leiden communities of the fuzzy graph."""
    return leiden(nb.neighbour_graph(ad.vectors(spark, d).obsm["X_emb"]))


@query()
def label_spread(spark: SparkSession, d: str) -> DataFrame:
    """Communities by label propagation."""
    return nb.spread_labels(nb.neighbour_graph(ad.vectors(spark, d).obsm["X_emb"]))


@query()
def ora_leiden(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return ora.cluster_terms(g, ad.sets(spark, d), "leiden", graph=g)


@query(f"""WITH sp AS (SELECT o_orderkey AS cell_id, CAST(o_custkey AS DOUBLE) AS x, CAST(epoch(o_orderdate) // 86400 AS DOUBLE) / 5 AS y FROM orders), ed AS (SELECT a.cell_id AS src, b.cell_id AS dst, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 8) AS weight FROM sp a JOIN sp b ON abs(a.x - b.x) < 5 AND abs(a.y - b.y) < 5)
SELECT src, dst, {s6('weight')} AS weight FROM ed WHERE weight >= 0.1 OR src = dst""")
def spatial_graph(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    days = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("double") / 5
    spots = o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").cast("double").alias("x"), days.alias("y"))
    return rounded(nb.spatial_graph(spots, 2.0), "weight")


# Models

BULKS = f"{O}, bk AS (SELECT annotation, batch || '-' || condition AS sample, condition AS cond, gene_id AS gene, sum(value) AS expr FROM counts JOIN obs USING (cell_id) GROUP BY ALL)"


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    j = exp.layer("counts").join(exp.obs, "cell_id")
    return j.groupBy("annotation", F.concat_ws("-", "batch", "condition").alias("sample"), F.col("condition").alias("cond"), F.col("gene_id").alias("gene")).agg(F.sum("value").alias("expr"))


@query(f"""WITH {BULKS}, ns AS (SELECT annotation, count(DISTINCT sample) AS s FROM bk GROUP BY 1), gm AS (SELECT annotation, gene, avg(ln(expr)) AS m FROM bk GROUP BY ALL), ra AS (SELECT annotation, sample, exp(quantile_cont(ln(expr) - m, 0.5)) AS size FROM bk JOIN gm USING (annotation, gene) GROUP BY ALL)
SELECT annotation, sample, {s6('size')} AS size FROM ra""")
def size_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.size_factors(_bulk(spark, d), ["annotation"]), "size")


@query(f"""WITH {BULKS}, b AS (SELECT sample, cond, gene, sum(expr) AS expr FROM bk GROUP BY ALL), l AS (SELECT sample, cond, sum(expr) AS lib FROM b GROUP BY ALL), r AS (SELECT 10.0 / (SELECT quantile_cont(lib, 0.5) FROM l) * 1e6 AS cpm, (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY cond)) AS n)
SELECT gene FROM b JOIN l USING (sample), r GROUP BY gene, n HAVING count(*) FILTER (expr / lib * 1e6 >= cpm) >= CASE WHEN n > 10 THEN 10 + (n - 10) * 0.7 ELSE n END - 1e-14 AND sum(expr) >= 15""")
def filter_by_expr(spark: SparkSession, d: str) -> DataFrame:
    b = _bulk(spark, d).groupBy("sample", "cond", "gene").agg(F.sum("expr").alias("expr"))
    return models.filter_by_expr(b, "cond")


@query(f"""WITH {BULKS}, n AS (SELECT *, ln(1 + expr * 1e4 / sum(expr) OVER (PARTITION BY annotation, sample)) AS v FROM bk), s AS (SELECT annotation, gene, cond, count(*) AS n, avg(v) AS m, var_samp(v) AS q FROM n GROUP BY ALL), ct AS (SELECT a.annotation AS "group", a.gene AS "GeneName", a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.q + (b.n - 1) * b.q) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS statistic, log2((exp(a.m) - 1 + 1e-9) / (exp(b.m) - 1 + 1e-9)) AS log2fc
FROM s a JOIN s b ON a.annotation = b.annotation AND a.gene = b.gene AND a.cond = 'O' AND b.cond = 'F' WHERE a.n > 1 AND b.n > 1), cp AS (SELECT * EXCLUDE (df), {t_p('statistic', 'df')} AS pvals FROM ct), {bh_sql('cp', '"group"', 'pvals')}
SELECT "group", "GeneName", {s6('statistic', 5)} AS statistic, {s6('log2fc')} AS log2fc, {s6('pvals', 5)} AS pvals, {s6('padj', 5)} AS padj FROM adj""")
def cluster_ttest(spark: SparkSession, d: str) -> DataFrame:
    t = models.cluster_ttest(_bulk(spark, d).withColumnRenamed("annotation", "group"), ctrl="F", disease="O")
    return rounded(rounded(t, "statistic", "pvals", "padj", digits=5), "log2fc")


@query()
def logreg_scores(spark: SparkSession, d: str) -> DataFrame:
    return models.logreg_scores(ad.orders(spark, d), "condition")


@query()
def hurdle_test(spark: SparkSession, d: str) -> DataFrame:
    return models.hurdle_test(ad.orders(spark, d), cond_key="condition", reference="F", disease="O", covariates=["annotation"])


@query()
def pseudobulk_wald(spark: SparkSession, d: str) -> DataFrame:
    return models.pseudobulk_test(ad.orders(spark, d), ctrl_cond="F", disease_cond="O", cluster_key="annotation")


@query()
def pseudobulk_quasi(spark: SparkSession, d: str) -> DataFrame:
    return models.pseudobulk_test(ad.orders(spark, d), ctrl_cond="F", disease_cond="O", cluster_key="annotation", method="edger")


@query()
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return models.consensus(ad.orders(spark, d), ctrl_cond="F", disease_cond="O", cluster_key="annotation")


PLOTTED = " UNION ALL ".join(f"""SELECT o_orderpriority, '{g}' AS "group", a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t FROM s a JOIN s b USING (o_orderpriority) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = '{g}'""" for g in "OP")


@query(f"""WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY ALL), p AS ({PLOTTED})
SELECT o_orderpriority, "group", {s6('t', 5)} AS statistic, {s6(t_p('t', 'df'), 5)} AS pval FROM p""")
def plot_pvalues(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    t = plot_tests.compare_groups(o, value="o_totalprice", group="o_orderstatus", ctrl="F", groups=["O", "P"], test="t-test", category="o_orderpriority")
    return rounded(t, "statistic", "pval", digits=5)


@query("""SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value) + 1e-7, 4) AS mean FROM events GROUP BY ALL""")
def windowed_stats(spark: SparkSession, d: str) -> DataFrame:
    w = windows.windowed_stats(ad.table(spark, d, "events"), at="ts", keys=["event_type"], value="value", window="1 hour")
    w = w.withColumn("mean", F.round(F.col("mean") + 1e-7, 4)).withColumn("total", F.round("total", 4)).drop("logmean")
    return w.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(f"""WITH {ad.CELLS} SELECT CAST(cell_id AS VARCHAR) AS cell_id, '[' || annotation || ']' AS color FROM cells WHERE annotation IS NOT NULL AND cell_id IN (SELECT cell_id FROM cell_scvi WHERE x_scvi IS NOT NULL AND len(x_scvi) >= 2)""")
def embedding_colors(spark: SparkSession, d: str) -> DataFrame:
    v = ad.table(spark, d, "cell_scvi").where("x_scvi IS NOT NULL AND size(x_scvi) >= 2").dropDuplicates(["cell_id"]).select("cell_id", F.col("x_scvi").alias("vec"))
    exp = ex.Experiment(ad.cells(spark, d), spark.createDataFrame([], "gene_id string"), {}, {"X_scVI": v})
    e_ = views.embedding(exp, basis="X_scVI", color="annotation").where("color IS NOT NULL")
    return e_.select(F.col("cell_id").cast("string").alias("cell_id"), F.concat(F.lit("["), "color", F.lit("]")).alias("color"))


@query()
def cells_search(spark: SparkSession, d: str) -> DataFrame:
    """The 15 nearest of all cells to every cell whose id is divisible by 50, by inverted lists."""
    v = ad.table(spark, d, "cell_scvi").where("cell_id IS NOT NULL").where(usable(F.col("x_scvi"), 30)).groupBy("cell_id").agg(F.min("x_scvi").alias("vec"))
    v = written(v)
    lists = max(64, math.isqrt(v.count()) // 4)  # lists grow in number and in size as the table does
    index = nb.fit_lists(v, n_lists=lists)
    return nb.search_lists(v.where("cell_id % 50 = 0"), written(nb.listed(v, index)), index, 15, probes=max(8, math.isqrt(lists)))


@query()
def integration(spark: SparkSession, d: str) -> DataFrame:
    """Clusters after batch correction of the orders' brands."""
    return pipelines.integrate(ad.orders(spark, d), batch_key="batch", n_top=25, n_components=10, k=10).obs.select("cell_id", "cluster")


@query()
def integration_scores(spark: SparkSession, d: str) -> DataFrame:
    exp, g = _edges(spark, d, 15)
    v = exp.obsm["X_emb"]
    reps = {"raw": v, "harmony": written(reduction.harmony(v, exp.obs, "batch"))}
    return iq.eval_integration(v, reps, g, exp.obs, "batch", "annotation", ("graph_connectivity", "silhouette_batch", "pcr"))


@query(f"WITH {O} SELECT cell_id, gene_id, value FROM counts")
def layer_swap(spark: SparkSession, d: str) -> DataFrame:
    return ad.orders(spark, d).swap("counts").layer()


@query(f"""WITH {O}, sp AS (SELECT o_orderkey AS cell_id, CAST(o_custkey AS DOUBLE) AS x, CAST(epoch(o_orderdate) // 86400 AS DOUBLE) / 5 AS y FROM orders), ed AS (SELECT a.cell_id AS src, b.cell_id AS dst, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 8) AS w FROM sp a JOIN sp b ON abs(a.x - b.x) < 5 AND abs(a.y - b.y) < 5),
k AS (SELECT * FROM ed WHERE w >= 0.1 OR src = dst), t AS (SELECT src, sum(w) AS t FROM k GROUP BY 1) SELECT k.src AS cell_id, gene_id, {s6('sum(w * value) / any_value(t)')} AS value FROM k JOIN counts ON counts.cell_id = k.dst JOIN t ON t.src = k.src GROUP BY ALL""")
def smooth_kernel(spark: SparkSession, d: str) -> DataFrame:
    o = ad.table(spark, d, "orders")
    days = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("double") / 5
    spots = o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").cast("double").alias("x"), days.alias("y"))
    return rounded(nb.smooth(ad.orders(spark, d).layer("counts"), nb.spatial_graph(spots, 2.0)), "value")


@query(f"WITH {EDGES}, w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM un) SELECT a.src, b.dst, {s6('sum(a.w * b.w)')} AS weight FROM w a JOIN w b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL")
def diffusion_two_steps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nb.diffuse(_edges(spark, d)[1], 2), "weight")


@query()
def recluster(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.vectors(spark, d)
    return nb.recluster(exp.obs, exp.obsm["X_emb"], "annotation").select("cell_id", "annotation", "recluster")


ONE_BRAND = "WHERE gene_id = 'Brand#1'"


@query(f"WITH {O}, {grid_sql('condition, batch', 'logc', 'exp(value) - 1', ONE_BRAND)} SELECT condition, batch, {s6('ln(1 + t / n)')} AS expr FROM st")
def barplot_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.barplot(ad.orders(spark, d), x_axis="condition", feature="Brand#1", batch_key="batch"), "expr")


@query(f"""WITH {O}, {REST}, a AS (SELECT cell_id, '' AS cmp, condition AS grp FROM obs), {wilcoxon_sql('', 'a')}, rk AS (SELECT grp AS condition, z.gene, log2fc, {norm_p('score')} AS pval FROM z JOIN ss ON ss."group" = grp AND ss.gene = z.gene), {bh_sql('rk', 'condition')},
kp AS (SELECT * FROM adj WHERE padj < 0.05 AND log2fc > 0) SELECT g.gene_id AS gene, g.condition, {s6('ln(1 + g.t / g.n)')} AS expr, {s6('g.nz / g.n')} AS pct, {s6('coalesce(kp.padj, 1)', 5)} AS padj, CASE WHEN kp.padj < 0.05 THEN '*' ELSE '' END AS star
FROM st g LEFT JOIN kp ON kp.gene = g.gene_id AND kp.condition = g.condition""")
def dotplot_stars(spark: SparkSession, d: str) -> DataFrame:
    exp = ad.orders(spark, d)
    r = testing.rank_genes_groups(exp, "condition").withColumnRenamed("group", "condition")
    grid = testing.significance_grid(r, views.dotplot(exp, x_axis="condition", features=None), ["gene", "condition"])
    return rounded(rounded(grid, "expr", "pct"), "padj", digits=5)
