"""Queries of problem 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantell.functions.labels import clean_label_sql
from quantell.operators.skew import cell_summaries


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/cell_obs.parquet")
    return cell_summaries(cells).where("dominant").select("annotation", "batch")


def p7_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/cell_obs.parquet")
    out = cell_summaries(cells).withColumns({"dominant": F.col("dominant").cast("int"), "share": F.round("share", 9)})
    for v in ("total_counts", "pct_counts_mt", "n_genes"):  # a mean that ends in a 5 is rounded up whatever the order of its sum
        out = out.withColumns({f"{v}_mean": F.round(F.col(f"{v}_mean") + 1e-7, 4), f"{v}_sd": F.round(F.col(f"{v}_sd") + 1e-7, 3)})
    return out


_KEYED = f"""SELECT {clean_label_sql('annotation')} AS annotation, {clean_label_sql('batch')} AS batch,
  CASE WHEN isfinite(total_counts) AND total_counts >= 0 THEN total_counts END AS tc,
  CASE WHEN isfinite(pct_counts_mt) AND pct_counts_mt BETWEEN 0 AND 100 THEN pct_counts_mt END AS mt,
  CASE WHEN n_genes_by_counts >= 0 THEN CAST(n_genes_by_counts AS DOUBLE) END AS ng FROM cell_obs"""


def _figures(v: str, name: str) -> str:
    return f"""count({v}) AS {name}_valid, round(avg({v}) + 1e-7, 4) AS {name}_mean, round(stddev_samp({v}) + 1e-7, 3) AS {name}_sd,
  min({v}) AS {name}_min, max({v}) AS {name}_max"""


SQL = {
    "p7_found": f"""WITH k AS ({_KEYED}) SELECT annotation, batch FROM k WHERE annotation IS NOT NULL AND batch IS NOT NULL
GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM cell_obs)""",
    "p7_summaries": f"""WITH k AS ({_KEYED}) SELECT annotation, batch, count(*) AS n_rows,
  round(count(*) / (SELECT count(*) FROM cell_obs), 9) AS share, {_figures('tc', 'total_counts')}, {_figures('mt', 'pct_counts_mt')},
  {_figures('ng', 'n_genes')}, CAST(annotation IS NOT NULL AND batch IS NOT NULL
  AND count(*) >= 0.05 * (SELECT count(*) FROM cell_obs) AS INTEGER) AS dominant FROM k GROUP BY annotation, batch""",
}

QUERIES = {"p7_found": p7_found, "p7_summaries": p7_summaries}
