"""Queries of the operators of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantell.functions.labels import clean_label, clean_label_sql, clean_source, clean_source_sql
from quantell.llm.density import density_clusters, describe_clusters
from quantell.llm.latest import latest_rows
from quantell.llm.leaks import leaked_pairs, leaked_spans
from quantell.llm.mixing import in_order, mixture
from quantell.llm.mixing import reached as mixed
from quantell.llm.quota import quota_sample, reached
from quantell.llm.ranks import merge_summaries, percentiles, rank_summaries
from quantell.llm.splitting import split_texts
from quantell.llm.stable import RANGE, key_hash_sql, stable_sample
from quantell.llm.subset import varied_subset
from quantell.llm.tokens import token_count, token_count_sql
from quantell.llm.topn import top_n

#: Production parameters.
SUBSET_SIZE = 256
SAMPLE_RATE, SAMPLE_FLOOR = 0.1, 5
TOP_GENES = 5
RANK_ERROR = 0.0005
ALIKE = 1.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(_table(spark, sf_dir, "cell_obs"), "cell_id", "loaded_at", annotation=clean_label(F.col("annotation")))


def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_subset(_table(spark, sf_dir, "cell_scvi"), _annotations(spark, sf_dir), SUBSET_SIZE)


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _table(spark, sf_dir, "cell_obs")
    strata = [clean_label(F.col("batch")), clean_label(F.col("annotation"))]
    return stable_sample(cells, "cell_id", "loaded_at", strata, SAMPLE_RATE, SAMPLE_FLOOR).select("cell_id", "by_floor")


def _quota(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, c = clean_label(F.col("annotation")), clean_label(F.col("condition"))
    return quota_sample(_table(spark, sf_dir, "cell_obs"), _table(spark, sf_dir, "sample_targets"), "cell_id", "loaded_at", a, c, a, c)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached(*_quota(spark, sf_dir)).where("short").select(F.col("r").alias("annotation"), F.col("c").alias("condition"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, _ = _quota(spark, sf_dir)
    return sample.select("cell_id", F.col("r").alias("annotation"), F.col("c").alias("condition"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached(*_quota(spark, sf_dir)).withColumnsRenamed({"r": "annotation", "c": "condition"})


def _top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dge = _table(spark, sf_dir, "dge_results")
    return top_n(dge, F.col("groups"), F.col("genename"), [F.col("padj"), -F.abs("log2fc")], TOP_GENES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_genes(spark, sf_dir).select(F.col("group").alias("groups"), F.col("item").alias("genename"))


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col("group").alias("groups"), F.col("item").alias("genename"), F.col("s0").alias("padj"), (-F.col("s1")).alias("abs_log2fc"), "place"]
    return _top_genes(spark, sf_dir).select(*cols)


def _batch_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    cells = _table(spark, sf_dir, "cell_obs")
    last = latest_rows(cells, "cell_id", "loaded_at", batch=clean_label(F.col("batch")), total=F.col("total_counts"), mt=F.col("pct_counts_mt"))
    return last, {"total_counts": F.when(F.col("total") >= 0, F.col("total")), "pct_counts_mt": F.when(F.col("mt").between(0, 100), F.col("mt"))}


def _batch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, values = _batch_values(spark, sf_dir)
    return percentiles(merge_summaries(rank_summaries(last, F.col("batch"), values, RANK_ERROR), RANK_ERROR), {"median": 0.5, "p95": 0.95})


def _per_batch(per: DataFrame) -> DataFrame:
    """A row per batch; ``within``: whether the tracked error keeps to the ranks permitted."""
    per = per.withColumn("permitted", F.floor(F.col("n") * RANK_ERROR)).withColumn("within", F.col("err") <= F.col("permitted"))
    per = per.withColumns({c: F.round(c, 6) for c in ("median", "p95")})
    cols = []
    for m in ("total_counts", "pct_counts_mt"):
        cols += [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for c in ("n", "permitted", "within", "median", "p95")]
    return per.groupBy(F.col("key").alias("batch")).agg(*cols)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.col("metric") == "total_counts") & (F.col("median") < 1000)
    high = (F.col("metric") == "pct_counts_mt") & (F.col("p95") > 15)
    return _batch_percentiles(spark, sf_dir).where(low | high).select(F.col("key").alias("batch")).distinct()


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_batch(_batch_percentiles(spark, sf_dir))


def p5_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two loads, even and odd days of loading, each summarised by itself and then merged."""
    cells = _table(spark, sf_dir, "cell_obs")
    odd = F.pmod(F.datediff(F.col("loaded_at").cast("date"), F.lit("2000-01-01").cast("date")), F.lit(2))
    last = latest_rows(cells, "cell_id", "loaded_at", batch=clean_label(F.col("batch")), total=F.col("total_counts"), mt=F.col("pct_counts_mt"), odd=F.coalesce(odd, F.lit(0)))
    _, values = _batch_values(spark, sf_dir)
    days = [merge_summaries(rank_summaries(last.where(F.col("odd") == d), F.col("batch"), values, RANK_ERROR), RANK_ERROR) for d in (0, 1)]
    return _per_batch(percentiles(merge_summaries(days[0].union(days[1]), RANK_ERROR), {"median": 0.5, "p95": 0.95}))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters(_table(spark, sf_dir, "cell_scvi"), "cell_id", "x_scvi", ALIKE)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).where("id <> cluster").select(F.col("cluster").alias("lead_cell"), F.col("id").alias("cell_id"))


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select(F.col("id").alias("cell_id"), F.col("cluster").alias("lead_cell"))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_clusters(_clusters(spark, sf_dir), _annotations(spark, sf_dir), "cell_id", "annotation", least=1)


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and main annotation of every cluster."""
    return p6_clusters(spark, sf_dir).select("lead_cell", "size", "main_label", "main_share")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(_spans(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str, schedules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    docs, targets = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_targets")
    return mixture(docs, targets, "doc_id", clean_source(F.col("source")), token_count(F.col("text")), clean_source(F.col("source")), schedules)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(*_mixture(spark, sf_dir)).where("short").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares planned, and those of the copies that are made."""
    out = mixed(*_mixture(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("share", "made_share")})
    return out.select("source", "tokens", "target_share", "share", "short", "repeats", "made", "copies", "made_share")


def p9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is trained on."""
    copies, _ = _mixture(spark, sf_dir)
    return copies.groupBy("doc_id").agg(F.count("*").alias("repeats"))


#: A curriculum that lets one source fade and another grow in its second half: source, time, weight.
SCHEDULE = [("hearthboard", 0.0, 1.5), ("hearthboard", 1.0, 0.5), ("kiln_notes", 0.0, 0.25), ("kiln_notes", 0.5, 0.25), ("kiln_notes", 1.0, 2.0)]


def p9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training order under the curriculum."""
    copies, _ = _mixture(spark, sf_dir, spark.createDataFrame(SCHEDULE, "source string, t double, weight double"))
    return in_order(copies, "doc_id")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(_table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece = 2").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        p1_subset, p2_sample, p3_found, p3_sample, p3_report, p4_found, p4_top, p5_found, p5_percentiles, p5_loads, p6_found, p6_members, p6_clusters, p6_sizes, p8_found,
        p8_leaks, p9_found, p9_shares, p9_repeats, p9_order, p10_found, p10_pieces,
    )
}

_BEST = """SELECT groups, genename, padj, abs(log2fc) AS abs_log2fc, row_number() OVER (PARTITION BY groups, genename ORDER BY padj, abs(log2fc) DESC) AS r
  FROM dge_results WHERE groups IS NOT NULL AND genename IS NOT NULL AND isfinite(padj) AND isfinite(log2fc)"""
_TOP = f"""WITH b AS ({_BEST}), p AS (SELECT groups, genename, padj, abs_log2fc,
  row_number() OVER (PARTITION BY groups ORDER BY padj, abs_log2fc DESC, genename COLLATE "binary") AS place FROM b WHERE r = 1)"""
_TOP = _TOP.replace(' COLLATE "binary"', "")

_LAST = f"""last AS (SELECT * FROM (SELECT cell_id, {clean_label_sql('annotation')} AS a, {clean_label_sql('condition')} AS c, {clean_label_sql('batch')} AS b,
  total_counts, pct_counts_mt, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS r FROM cell_obs WHERE cell_id IS NOT NULL) WHERE r = 1)"""

_CLUSTERS = """WITH RECURSIVE v AS (SELECT cell_id AS id, CAST(min(x_scvi) AS DOUBLE[30]) AS x FROM cell_scvi
  WHERE cell_id IS NOT NULL AND len(x_scvi) = 30 AND list_bool_and(list_transform(x_scvi, lambda z: coalesce(isfinite(z), false))) AND list_bool_or(list_transform(x_scvi, lambda z: z <> 0)) GROUP BY 1),
 e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON abs(a.x[1] - b.x[1]) <= 1.5 AND a.id <> b.id AND array_distance(a.x, b.x) <= 1.5),
 r(id, root) AS (SELECT id, id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
 c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""

_VALID = {"total_counts": "isfinite(total_counts) AND total_counts >= 0", "pct_counts_mt": "isfinite(pct_counts_mt) AND pct_counts_mt BETWEEN 0 AND 100"}
_PERCENTILES = f"""WITH {_LAST}, x AS (SELECT b, {', '.join(f'CASE WHEN {ok} THEN {m} END AS {m}' for m, ok in _VALID.items())} FROM last WHERE b IS NOT NULL)
SELECT b AS batch, {', '.join(f"nullif(count({m}), 0) AS {m}_n, CAST(floor(nullif(count({m}), 0) * {RANK_ERROR}) AS BIGINT) AS {m}_permitted, CASE WHEN count({m}) > 0 THEN true END AS {m}_within, round(quantile_cont({m}, 0.5), 6) AS {m}_median, round(quantile_cont({m}, 0.95), 6) AS {m}_p95" for m in _VALID)}
FROM x GROUP BY b HAVING count(total_counts) + count(pct_counts_mt) > 0"""

def _words_sql(text: str) -> str:
    """The words of a text as a list; of character references those that occur."""
    parting = r"</?(br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|pre|hr)\b[^<>]*>|\[/?(quote|list|table|tr|td|img|code)\b[^\[\]]*\]"
    out = rf"regexp_replace(regexp_replace({text}, '{parting}', ' ', 'gi'), '</?[A-Za-z!?][^<>]*>|\[[^\[\]]*\]', '', 'g')"
    for ref, c in (("&nbsp;", " "), ("&#32;", " "), ("&shy;", ""), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{c}')"
    return rf"regexp_extract_all(regexp_replace(replace(strip_accents(lower({out})), 'ß', 'ss'), '\p{{Cf}}|\p{{Mn}}|\p{{Me}}', '', 'g'), '[\p{{L}}\p{{N}}]+')"


_LEAKS = f"""WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
 i AS (SELECT item_id, {_words_sql('text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
 dr AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
 ir AS (SELECT item_id, n, p AS q, array_to_string(w[p:p + 7], ' ') AS run FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 6)) AS p FROM i)),
 hit AS (SELECT doc_id, item_id, n, p, q FROM dr JOIN ir USING (run)),
 span AS (SELECT doc_id, item_id, n, min(q) AS q, count(*) + 7 AS words FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM hit) GROUP BY doc_id, item_id, n, p - q, run),
 own AS (SELECT doc_id, item_id, n, count(DISTINCT w) AS covered FROM (SELECT doc_id, item_id, n, unnest(range(q, q + words)) AS w FROM span) GROUP BY ALL)"""

_MIX = f"""WITH x AS (SELECT doc_id, {clean_source_sql('source')} AS source, {token_count_sql('text')} AS n, {key_hash_sql('doc_id', 'mix')} AS h FROM documents WHERE doc_id IS NOT NULL),
 y AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS own FROM x WHERE source IS NOT NULL),
 t AS (SELECT {clean_source_sql('source')} AS source, sum(coalesce(target_share, 0)) AS target_share, max(coalesce(max_repeats, 0)) AS cap FROM source_targets GROUP BY 1 HAVING {clean_source_sql('source')} IS NOT NULL),
 p AS (SELECT t.source, target_share, coalesce(s.n, 0) AS tokens, target_share * (SELECT sum(n) FROM y) AS wanted, least(target_share * (SELECT sum(n) FROM y), cap * coalesce(s.n, 0)) AS used
  FROM t LEFT JOIN (SELECT source, sum(n) AS n FROM y GROUP BY 1) s USING (source)),
 r AS (SELECT *, CAST(coalesce(floor(used / nullif(tokens, 0)), 0) AS BIGINT) AS repeats FROM p),
 k AS (SELECT doc_id, source, n, own, tokens, used, unnest(range(1, repeats + CASE WHEN n > 0 AND own < used - repeats * tokens THEN 1 ELSE 0 END + 1)) AS copy FROM y JOIN r USING (source))"""
_POINTS = ", ".join(f"('{s}', {t}, {w})" for s, t, w in SCHEDULE)

SQL = {
    "p9_shares": f"""{_MIX}, m AS (SELECT source, sum(n) AS made, count(*) AS copies FROM k GROUP BY 1)
SELECT source, CAST(tokens AS BIGINT) AS tokens, target_share, round(used / (SELECT sum(used) FROM r), 9) AS share, coalesce(made, 0) < wanted AS short, repeats, CAST(coalesce(made, 0) AS BIGINT) AS made, coalesce(copies, 0) AS copies,
 round(coalesce(made, 0) / (SELECT sum(made) FROM m), 9) AS made_share FROM r LEFT JOIN m USING (source)""",
    "p9_repeats": f"{_MIX} SELECT doc_id, count(*) AS repeats FROM k GROUP BY 1",
    "p9_order": f"""{_MIX}, pt(source, t, w) AS (VALUES {_POINTS}), l0 AS (SELECT source, lag(t) OVER o AS t0, t AS t1, lag(w) OVER o AS w0, w AS w1 FROM pt WINDOW o AS (PARTITION BY source ORDER BY t)),
 l1 AS (SELECT * FROM l0 WHERE t0 IS NOT NULL UNION ALL SELECT source, 0.0, 1.0, 1.0, 1.0 FROM r WHERE source NOT IN (SELECT source FROM pt)), l2 AS (SELECT source, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1, CAST(w0 AS DOUBLE) AS w0, CAST(w1 AS DOUBLE) AS w1 FROM l1),
 l AS (SELECT *, coalesce(sum((t1 - t0) * (w0 + w1) / 2) OVER (PARTITION BY source ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum((t1 - t0) * (w0 + w1) / 2) OVER (PARTITION BY source) AS area FROM l2),
 z AS (SELECT doc_id, copy, k.source, n AS tokens, l.*, ((copy - 1) * k.tokens + own) / used * area AS part FROM k JOIN l ON l.source = k.source WHERE before <= ((copy - 1) * k.tokens + own) / used * area
  QUALIFY row_number() OVER (PARTITION BY doc_id, copy ORDER BY before DESC) = 1)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, source, CAST(tokens AS BIGINT) AS tokens, round(t0 + 2 * (part - before) / (w0 + sqrt(w0 * w0 + (w1 - w0) / (t1 - t0) * 2 * (part - before))), 9) AS position FROM z""",
    "p8_found": f"{_LEAKS} SELECT DISTINCT doc_id, item_id FROM hit",
    "p8_leaks": f"""{_LEAKS} SELECT doc_id, item_id, count(*) AS n_spans, CAST(max(words) AS INTEGER) AS longest, round(any_value(covered) / any_value(own.n), 6) AS share
FROM span JOIN own USING (doc_id, item_id) GROUP BY ALL""",
    "p5_percentiles": _PERCENTILES,
    "p5_loads": _PERCENTILES,
    "p2_sample": f"""WITH f AS (SELECT * FROM (SELECT cell_id, loaded_at, coalesce({clean_label_sql('batch')}, '') || chr(31) || coalesce({clean_label_sql('annotation')}, '') AS stratum,
  {key_hash_sql('cell_id', 'sample')} AS h FROM cell_obs WHERE cell_id IS NOT NULL AND loaded_at IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at, stratum) = 1),
 g AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY loaded_at, h, CAST(cell_id AS VARCHAR)) AS arrived FROM f)
SELECT cell_id, CAST(h >= {int(SAMPLE_RATE * RANGE)} AS INTEGER) AS by_floor FROM g WHERE h < {int(SAMPLE_RATE * RANGE)} OR arrived <= {SAMPLE_FLOOR}""",
    "p3_found": f"""WITH {_LAST}, t AS (SELECT {clean_label_sql('annotation')} AS a, {clean_label_sql('condition')} AS c, target_share, min_cells FROM sample_targets),
 n AS (SELECT t.a, t.c, t.target_share, t.min_cells, count(last.cell_id) AS available FROM t LEFT JOIN last USING (a, c) GROUP BY ALL)
SELECT a AS annotation, c AS condition FROM n WHERE available < greatest(min_cells, target_share * 0.2 * (SELECT sum(available) FROM n))""",
    "p4_found": _TOP + " SELECT groups, genename FROM p WHERE place <= 5",
    "p4_top": _TOP + " SELECT groups, genename, padj, abs_log2fc, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5",
    "p5_found": f"""WITH {_LAST} SELECT b AS batch FROM last WHERE b IS NOT NULL GROUP BY b
HAVING quantile_cont(CASE WHEN isfinite(total_counts) AND total_counts >= 0 THEN total_counts END, 0.5) < 1000
 OR quantile_cont(CASE WHEN isfinite(pct_counts_mt) AND pct_counts_mt BETWEEN 0 AND 100 THEN pct_counts_mt END, 0.95) > 15""",
    "p6_found": f"{_CLUSTERS} SELECT root AS lead_cell, id AS cell_id FROM c WHERE root <> id",
    "p6_members": f"{_CLUSTERS} SELECT id AS cell_id, root AS lead_cell FROM c",
    "p6_sizes": f"""{_CLUSTERS}, {_LAST}, l AS (SELECT root, a, count(*) AS n FROM c LEFT JOIN last ON cell_id = id GROUP BY ALL)
SELECT root AS lead_cell, CAST(sum(n) OVER (PARTITION BY root) AS BIGINT) AS size, a AS main_label, round(n / sum(n) OVER (PARTITION BY root), 6) AS main_share FROM l
QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, a NULLS FIRST) = 1""",
    "p9_found": f"""WITH d AS (SELECT {clean_source_sql('source')} AS source, sum({token_count_sql('text')}) AS n FROM documents GROUP BY 1),
 t AS (SELECT {clean_source_sql('source')} AS source, target_share, max_repeats FROM source_targets)
SELECT t.source FROM t LEFT JOIN d USING (source)
WHERE max_repeats * coalesce(n, 0) < target_share * (SELECT sum(n) FROM d WHERE source IS NOT NULL)""",
    "p10_found": f"SELECT doc_id FROM documents WHERE {token_count_sql('text')} > 512",
}
