"""The driver's tables as experiments, in Spark and as DuckDB CTEs.

``orders``: a cell per order, a gene per brand, counts the quantities ordered. ``cells``: the latest row of every cell.
``vectors``: the embeddings with their label, batch the id modulo 3. ``sets``: per annotation and comparison the
significant genes of the result table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantell.experiment import Experiment
from quantell.functions.labels import clean_label, clean_label_sql
from quantell.operators.quality import normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Experiment:
    """Cells of orders, ``X`` log-normalised, ``counts`` raw."""
    line, part, order, customer = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    lines = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), "l_quantity")
    # by cell once: sums, cells and what follows per cell need no further shuffle of all lines
    counts = lines.repartition("cell_id").groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))
    obs = order.join(customer, order["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("cell_id"), F.col("c_mktsegment").alias("batch"), F.col("o_orderstatus").alias("condition"), F.col("o_orderpriority").alias("annotation"),
    )
    var = part.select(F.col("p_brand").alias("gene_id")).distinct()
    counts = counts.join(obs.select("cell_id"), "cell_id", "left_semi")
    exp = Experiment(obs, var, {"counts": counts})
    return exp.with_layer("X", normalise(exp, layer="counts"))


ORDERS = """counts AS (SELECT l_orderkey AS cell_id, p_brand AS gene_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
obs AS (SELECT o_orderkey AS cell_id, c_mktsegment AS batch, o_orderstatus AS condition, o_orderpriority AS annotation FROM orders JOIN customer ON o_custkey = c_custkey),
var AS (SELECT DISTINCT p_brand AS gene_id FROM part),
logc AS (SELECT cell_id, gene_id, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell_id)) AS value FROM counts)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of every cell, labels cleaned up."""
    df = table(spark, sf_dir, "cell_obs")
    cols = [c for c in df.columns if c != "cell_id"]
    last = df.where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.max(F.struct("loaded_at", *[c for c in cols if c != "loaded_at"])).alias("r")).select("cell_id", "r.*")
    return last.withColumns({c: clean_label(F.col(c)) for c in ("batch", "condition", "annotation", "autoannot")})


CELLS = f"""cells AS (SELECT * REPLACE ({', '.join(f'{clean_label_sql(c)} AS {c}' for c in ('batch', 'condition', 'annotation', 'autoannot'))})
  FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS r FROM cell_obs WHERE cell_id IS NOT NULL) WHERE r = 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> Experiment:
    df = table(spark, sf_dir, "embeddings")
    obs = df.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("annotation"), F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("batch"))
    vec = df.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return Experiment(obs, spark.createDataFrame([], "gene_id string"), {}, {"X_emb": vec})


VECTORS = """vecs AS (SELECT vec_id AS cell_id, CAST(label AS VARCHAR) AS annotation, 'b' || CAST(vec_id % 3 AS VARCHAR) AS batch, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term, gene, padj`` of the significant rows."""
    d = table(spark, sf_dir, "dge_results").where("padj < 0.05 AND NOT isnan(padj) AND genename IS NOT NULL AND groups IS NOT NULL")
    term = F.concat_ws(":", F.coalesce(clean_label(F.col("annotation")), F.lit("none")), F.regexp_extract("groups", "[^:]*$", 0))
    return d.select(term.alias("term"), F.col("genename").alias("gene"), "padj")


SETS = f"""sets AS (SELECT coalesce({clean_label_sql('annotation')}, 'none') || ':' || regexp_extract(groups, '[^:]*$') AS term, genename AS gene, padj
  FROM dge_results WHERE padj < 0.05 AND NOT isnan(padj) AND genename IS NOT NULL AND groups IS NOT NULL)"""
