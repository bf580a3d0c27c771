"""Registered queries on the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import dim_subset, predicate, round6, search
from ..operators import cube as C
from ..operators import ranktest, rasters, records
from ..operators import report as R
from ..sources import sinks
from ..streaming.incremental import IncrementalCube, completed, ingest_cube, latest
from ..streaming.ingest import running_snapshot, stream_timeline
from . import views as V

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = "WITH " + sql if sql.lstrip()[:6].upper() != "SELECT" else sql
        return f

    return add


def rounded(df, *keep):
    """Doubles to six digits, so that both sides add up in any order."""
    return df.select(*(round6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


LEAF = """leaf AS (SELECT l_orderkey AS rec, l_linenumber AS dim_z, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS dim_c, l_quantity AS v, 1::BIGINT AS num_pixels, l_linestatus AS grp FROM lineitem),
act AS (SELECT rec, min(dim_z) < max(dim_z) AS az, min(dim_c) < max(dim_c) AS ac FROM leaf GROUP BY rec),
m AS (SELECT l.rec, CASE WHEN az THEN dim_z END AS dim_z, CASE WHEN ac THEN dim_c END AS dim_c, v, num_pixels FROM leaf l JOIN act USING (rec)),
cube AS (SELECT rec, dim_z, dim_c, (2 - GROUPING(dim_z) - GROUPING(dim_c))::INTEGER AS obs_level, sum(num_pixels)::BIGINT AS num_pixels, sum(v) AS v_sum, min(v) AS v_min, max(v) AS v_max, avg(v) AS v_mean
  FROM m GROUP BY GROUPING SETS ((rec), (rec, dim_z), (rec, dim_c), (rec, dim_z, dim_c)) HAVING NOT (GROUPING(dim_z) = 0 AND dim_z IS NULL) AND NOT (GROUPING(dim_c) = 0 AND dim_c IS NULL))"""
INV = "inv AS (SELECT source || '/' || lang || '/' || doc_id AS path, doc_id::VARCHAR AS name, lang AS file_extension, n_chars AS size_bytes, source AS grp FROM documents)"
SIDE = INV + ", side AS (SELECT inv.*, quality, toxic FROM inv LEFT JOIN labels ON inv.name = labels.doc_id::VARCHAR)"
OBS = "obs AS (SELECT event_id AS id, ts, event_type AS grp, value AS v FROM events)"
PX = "px AS (SELECT vec_id AS record_id, label AS grp, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
NB = PX + """, nb AS (SELECT a.record_id, a.y, a.x, any_value(a.p) AS p, avg(b.p) AS mu, max(b.p) - min(b.p) AS rng, sqrt(greatest(avg(b.p * b.p) - avg(b.p) * avg(b.p), 0)) AS sd,
  sum(CASE WHEN abs(a.y - b.y) + abs(a.x - b.x) = 1 THEN b.p ELSE 0 END) - 4 * any_value(a.p) AS lap
  FROM px a JOIN px b ON a.record_id = b.record_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY a.record_id, a.y, a.x),
al AS (SELECT record_id, stddev_pop(p) AS sd_all, max(p) - min(p) AS span FROM px GROUP BY record_id)"""
STACK = "st AS (SELECT vec_id // 10 AS record_id, ((vec_id % 10) // 2)::INTEGER AS dim_t, (vec_id % 2)::INTEGER AS dim_c, vec_id, embedding FROM embeddings)"


# -- rasters ------------------------------------------------------------------------------------------------------


@query("raster_basic", PX + " SELECT record_id, grp, round(min(p), 6) AS min_intensity, round(max(p), 6) AS max_intensity, round(avg(p), 6) AS mean_intensity, round(stddev_pop(p), 6) AS std_intensity, count(*) AS finite_pixel_count FROM px GROUP BY ALL")
def _(s, d):
    return rounded(V.raster8(s, d).select("record_id", "grp", *rasters.basic_columns("values")))


HIST = PX + ", b AS (SELECT record_id, min(p) AS lo, max(p) AS hi FROM px GROUP BY 1), h AS (SELECT record_id, any_value(grp) AS grp, lo, hi, least(greatest(floor((p - lo) / ((hi - lo) / 256)), 0), 255)::INTEGER AS bin, count(*) AS n FROM px JOIN b USING (record_id) GROUP BY record_id, lo, hi, 5)"


@query("raster_hist", HIST + " SELECT record_id, round(lo, 6) AS lo, round(hi, 6) AS hi, 0::BIGINT AS nan_count, bin, n FROM h")
def _(s, d):
    return rounded(rasters.block_histograms(V.raster8(s, d), ["record_id"]))


def _kernel(name):
    return lambda s, d: rounded(rasters.measure(V.raster8(s, d), ["image"]).select("record_id", name))


for _key, _name, _expr in (
    ("raster_contrast", "michelson_contrast", "avg(rng) / any_value(sd_all)"),
    ("raster_mscn", "mscn_variance", "var_pop((p - mu) / (sd + greatest(span * 1e-3, 1e-10)))"),
    ("raster_texture", "texture_heterogeneity", "stddev_pop(sd) / avg(sd)"),
    ("raster_ringing", "ringing_index", "var_pop(p - mu)"),
    ("raster_laplacian", "laplacian_variance", "var_pop(lap)"),
):
    query(_key, NB + f" SELECT record_id, round({_expr}, 6) AS {_name} FROM nb JOIN al USING (record_id) GROUP BY record_id")(_kernel(_name))


@query("raster_blocking", """q AS (SELECT vec_id // 4 AS record_id, ((vec_id % 4) // 2) * 8 + (i - 1) // 8 AS y, (vec_id % 2) * 8 + (i - 1) % 8 AS x, embedding[i]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
f AS (SELECT record_id FROM q GROUP BY 1 HAVING count(*) = 256)
SELECT a.record_id, round((avg(abs(a.p - b.p)) FILTER (a.x = 7 AND b.x = 8 AND a.y = b.y) + avg(abs(a.p - b.p)) FILTER (a.y = 7 AND b.y = 8 AND a.x = b.x)) / 2, 6) AS blocking_index
FROM q a JOIN q b ON a.record_id = b.record_id AND ((a.x = 7 AND b.x = 8 AND a.y = b.y) OR (a.y = 7 AND b.y = 8 AND a.x = b.x)) WHERE a.record_id IN (SELECT record_id FROM f) GROUP BY a.record_id""")
def _(s, d):
    return rounded(rasters.measure(V.raster16(s, d), ["image"]).select("record_id", "blocking_index"))


@query("nodata_bins", PX + """, c AS (SELECT record_id, grp::VARCHAR AS grp, 100.0::DOUBLE * count(*) FILTER (round(p, 1) = 0) / count(*) AS pct FROM px GROUP BY ALL)
SELECT grp, CASE WHEN pct = 0 THEN 0 ELSE least(ceil(pct / 10), 10) END::INTEGER AS bin, count(*) AS n FROM c GROUP BY ALL""")
def _(s, d):
    r = V.raster8(s, d).withColumn("values", F.transform("values", lambda x: F.round(x, 1) + 0.0)).withColumn("nodata", F.lit(0.0))
    r = r.select("grp", "record_id", rasters.nodata_count("values", "nodata").alias("nodata_count"), F.size("values").alias("num_pixels"))
    return R.percent_bins(r, F.col("nodata_count") * 100.0 / F.col("num_pixels"), "grp")


@query("nonfinite_bins", "SELECT label::VARCHAR AS grp, 0 AS bin, count(*) AS n FROM embeddings GROUP BY 1")
def _(s, d):
    r = V.raster8(s, d).select("grp", F.size("values").alias("num_pixels"), rasters.basic_columns("values")[4])
    return R.percent_bins(r, (F.col("num_pixels") - F.col("finite_pixel_count")) * 100.0 / F.col("num_pixels"), "grp")


@query("thumbnails", "SELECT vec_id AS record_id, round(least(list_min(embedding), 0)::DOUBLE, 6) AS norm_min, round(list_max(embedding)::DOUBLE, 6) AS norm_max, 16384 AS n_bytes FROM embeddings")
def _(s, d):
    return rounded(rasters.thumbnails(V.raster8(s, d), ["record_id"]).select("record_id", "norm_min", "norm_max", F.length("thumbnail").alias("n_bytes")))


@query("tiles", PX + " SELECT record_id, ((y // 3) * 3)::INTEGER AS dim_y, ((x // 5) * 5)::INTEGER AS dim_x, count(*) AS num_pixels, round(sum(p), 6) AS total FROM px GROUP BY ALL")
def _(s, d):
    t = rasters.tile_records(V.raster8(s, d), {"Y": 3, "X": 5})
    return rounded(t.select("record_id", "dim_y", "dim_x", "num_pixels", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


# -- cube ---------------------------------------------------------------------------------------------------------


@query("cube_sum", LEAF + " SELECT rec, dim_z, dim_c, obs_level, num_pixels, v_sum, v_min, v_max FROM cube")
def _(s, d):
    return V.leaf_cube(s, d).select("rec", "dim_z", "dim_c", "obs_level", "num_pixels", "v_sum", "v_min", "v_max")


@query("cube_weighted_mean", LEAF + " SELECT rec, dim_z, dim_c, obs_level, round(v_mean, 6) AS v_mean FROM cube")
def _(s, d):
    return rounded(V.leaf_cube(s, d).select("rec", "dim_z", "dim_c", "obs_level", "v_mean"))


@query("cube_pooled_std", STACK + """, p AS (SELECT record_id, dim_t, dim_c, unnest(embedding)::DOUBLE AS p FROM st), a AS (SELECT record_id, min(dim_t) < max(dim_t) AS t, min(dim_c) < max(dim_c) AS c FROM p GROUP BY 1),
m AS (SELECT p.record_id, CASE WHEN t THEN dim_t END AS dim_t, CASE WHEN c THEN dim_c END AS dim_c, p FROM p JOIN a USING (record_id))
SELECT record_id, dim_t, dim_c, (2 - GROUPING(dim_t) - GROUPING(dim_c))::INTEGER AS obs_level, round(avg(p), 6) AS mean_intensity, round(stddev_pop(p), 6) AS std_intensity FROM m
GROUP BY GROUPING SETS ((record_id), (record_id, dim_t), (record_id, dim_c), (record_id, dim_t, dim_c)) HAVING NOT (GROUPING(dim_t) = 0 AND dim_t IS NULL) AND NOT (GROUPING(dim_c) = 0 AND dim_c IS NULL)""")
def _(s, d):
    x = V.stack(s, d).select("record_id", "dim_t", "dim_c", *rasters.basic_columns("values"))
    cube = C.observation_cube(x, ["record_id"], ["dim_t", "dim_c"], {"mean_intensity": "mean", "std_intensity": "std:mean_intensity"}, weight="finite_pixel_count")
    return rounded(cube.select("record_id", "dim_t", "dim_c", "obs_level", "mean_intensity", "std_intensity"))


@query("cube_hist", STACK + ", v AS (SELECT record_id, vec_id, unnest(embedding)::DOUBLE AS p FROM st), b AS (SELECT vec_id, min(p) AS lo, max(p) AS hi FROM v GROUP BY 1), h AS (SELECT record_id, vec_id, lo, hi, least(greatest(floor((p - lo) / ((hi - lo) / 256)), 0), 255)::INTEGER AS bin, count(*) AS n FROM v JOIN b USING (vec_id) GROUP BY ALL), g AS (SELECT record_id, min(lo) AS glo, max(hi) AS ghi FROM h GROUP BY 1) SELECT record_id, round(glo, 6) AS lo, round(ghi, 6) AS hi, least(greatest(ceil((lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 256) - glo) / ((ghi - glo) / 256)) - 1, 0), 255)::INTEGER AS bin, sum(n)::BIGINT AS n FROM h JOIN g USING (record_id) GROUP BY ALL")
def _(s, d):
    h = rasters.block_histograms(V.stack(s, d), ["record_id", "dim_t", "dim_c"])
    return rounded(C.merge_histograms(h, ["record_id"]))


@query("subset_whole", LEAF + " SELECT rec, v_sum FROM cube WHERE obs_level = 0")
def _(s, d):
    return V.leaf_cube(s, d).where(dim_subset(["dim_z", "dim_c"])).select("rec", "v_sum")


@query("subset_fixed", LEAF + " SELECT rec, dim_z, v_sum FROM cube WHERE obs_level = 1 AND dim_z = 2 AND dim_c IS NULL")
def _(s, d):
    return V.leaf_cube(s, d).where(dim_subset(["dim_z", "dim_c"], {"dim_z": 2})).select("rec", "dim_z", "v_sum")


@query("subset_split", LEAF + " SELECT rec, dim_z, dim_c, v_sum FROM cube WHERE obs_level = 2 AND dim_z = 1 AND dim_c IS NOT NULL")
def _(s, d):
    return V.leaf_cube(s, d).where(dim_subset(["dim_z", "dim_c"], {"dim_z": 1}, ["dim_c"])).select("rec", "dim_z", "dim_c", "v_sum")


@query("cohort_semi", LEAF.replace("cube AS (", "cube AS MATERIALIZED (") + " SELECT rec, v_sum FROM cube WHERE obs_level = 0 AND rec IN (SELECT rec FROM cube WHERE dim_z = 3 AND dim_c = 1)")
def _(s, d):
    hit = R.leaf_cohort(V.leaf(s, d), "rec", {"dim_z": 3, "dim_c": 1})
    return V.leaf_cube(s, d).where("obs_level = 0").join(hit, "rec", "left_semi").select("rec", "v_sum")


ACROSS = LEAF + ", x AS (SELECT 'all' AS grp, dim_z AS slice, unnest(['v_mean', 'v_sum']) AS metric, unnest([v_mean, v_sum]) AS value FROM cube WHERE obs_level = 1 AND dim_z IS NOT NULL AND dim_c IS NULL), y AS (SELECT grp, slice, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(value) AS n FROM x GROUP BY ALL)"


@query("across_dims", ACROSS + " SELECT * FROM y")
def _(s, d):
    return rounded(C.across_dims(V.leaf_cube(s, d), ["dim_z", "dim_c"], "dim_z", ["v_mean", "v_sum"]).drop("retention"))


@query("retention", ACROSS + " SELECT grp, slice, metric, round(n / max(n) OVER (PARTITION BY grp, metric) * 100, 6) AS retention FROM y")
def _(s, d):
    return rounded(C.across_dims(V.leaf_cube(s, d), ["dim_z", "dim_c"], "dim_z", ["v_mean", "v_sum"]).select("grp", "slice", "metric", "retention"))


@query("dim_domain", LEAF + " SELECT 'dim_z' AS \"column\", array_to_string(list_sort(list(DISTINCT dim_z)), ',') AS domain, count(DISTINCT dim_z) AS n FROM cube UNION ALL SELECT 'dim_c', array_to_string(list_sort(list(DISTINCT dim_c)), ','), count(DISTINCT dim_c) FROM cube")
def _(s, d):
    return R.dim_domain(V.leaf_cube(s, d), ["dim_z", "dim_c"])


# -- filters ------------------------------------------------------------------------------------------------------

for _key, _args, _where in (
    ("filter_contains", ("path", "contains", "src1/"), "path LIKE '%src1/%'"),
    ("filter_not_contains", ("path", "not_contains", "src1"), "path NOT LIKE '%src1%'"),
    ("filter_eq", ("file_extension", "eq", "en"), "file_extension = 'en'"),
    ("filter_cmp", ("size_bytes", "ge", "2500"), "size_bytes >= 2500"),
    ("filter_cmp_text", ("name", "lt", "150"), "TRY_CAST(name AS DOUBLE) < 150"),
    ("filter_in", ("file_extension", "in", "de, fr"), "file_extension IN ('de', 'fr')"),
    ("filter_empty", ("file_extension", "in", ""), "true"),
):
    query(_key, INV + f" SELECT path, size_bytes FROM inv WHERE {_where}")(lambda s, d, a=_args: V.inv(s, d).where(predicate(*a)).select("path", "size_bytes"))


@query("search_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%AR%' OR p_type ILIKE '%AR%'")
def _(s, d):
    return V.table(s, d, "part").where(search(["p_name", "p_type"], "AR")).select("p_partkey", "p_name")


@query("text_search", "SELECT r_regionkey, r_name FROM region WHERE r_name ILIKE '%a%'")
def _(s, d):
    return R.text_search(V.table(s, d, "region").select("r_regionkey", "r_name"), "a", ["r_name"])


# -- report -------------------------------------------------------------------------------------------------------


@query("summary_by_group", INV + " SELECT grp, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes, array_to_string(list_sort(list(DISTINCT file_extension)), ',') AS extensions, count(*) AS n_images, count(DISTINCT path) AS n_paths FROM inv GROUP BY GROUPING SETS ((grp), ())")
def _(s, d):
    return R.summary(V.inv(s, d), "grp")


@query("uneven_groups", INV + ", n AS (SELECT file_extension, count(*) AS n FROM inv GROUP BY 1) SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS ratio, max(n) / min(n) >= 1.5 AS flagged FROM n")
def _(s, d):
    return rounded(R.uneven_groups(V.inv(s, d), "file_extension"))


@query("ext_counts", INV + " SELECT file_extension, grp, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM inv GROUP BY ALL")
def _(s, d):
    return R.extension_counts(V.inv(s, d), "grp")


@query("size_bins_linear", "b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, least(count(DISTINCT p_retailprice), 20) AS k FROM part), x AS (SELECT least(floor(round((p_retailprice - lo) / (hi - lo) * k, 9)), k - 1)::INTEGER AS bin, lo, hi, k FROM part, b) SELECT bin, round(lo + (hi - lo) * bin / k, 6) AS lo_edge, round(lo + (hi - lo) * (bin + 1) / k, 6) AS hi_edge, 'all' AS grp, count(*) AS n FROM x GROUP BY ALL")
def _(s, d):
    return rounded(R.size_histogram(V.table(s, d, "part"), "p_retailprice"))


@query("size_bins_log", INV + ", b AS (SELECT min(size_bytes) FILTER (size_bytes > 0) AS lo, max(size_bytes) AS hi, least(count(DISTINCT size_bytes), 20) AS k FROM inv), x AS (SELECT grp, least(floor(round(CASE WHEN size_bytes <= lo THEN 0 ELSE (log10(size_bytes) - log10(lo)) / (log10(hi) - log10(lo)) * k END, 9)), k - 1)::INTEGER AS bin, lo, hi, k FROM inv, b) SELECT bin, round(pow(10, log10(lo) + (log10(hi) - log10(lo)) * bin / k), 6) AS lo_edge, round(pow(10, log10(lo) + (log10(hi) - log10(lo)) * (bin + 1) / k), 6) AS hi_edge, grp, count(*) AS n FROM x GROUP BY ALL")
def _(s, d):
    return rounded(R.size_histogram(V.inv(s, d), "size_bytes", "grp"))


@query("timeline_day", OBS + " SELECT 'day' AS unit, strftime(ts, '%Y-%m-%d') AS bucket, grp, count(*) AS n FROM obs GROUP BY ALL")
def _(s, d):
    return R.timeline(V.obs(s, d), "ts", "grp", "day")


@query("timeline_day_all", OBS + " SELECT 'day' AS unit, strftime(ts, '%Y-%m-%d') AS bucket, grp, count(*) AS n FROM obs GROUP BY ALL")
def _(s, d):
    return R.timeline(V.obs(s, d), "ts", "grp", "day")


@query("timeline_month", "SELECT 'month' AS unit, strftime(o_orderdate, '%Y-%m') AS bucket, o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    return R.timeline(V.table(s, d, "orders"), "o_orderdate", "o_orderpriority")


@query("cat_distribution", SIDE + " SELECT coalesce(quality::VARCHAR, '(missing)') AS category, grp, count(*) AS n FROM side GROUP BY ALL")
def _(s, d):
    return R.category_counts(V.inv_side(s, d), "quality", "grp")


@query("category_kind", INV + " SELECT count(DISTINCT file_extension) AS n_values, CASE count(DISTINCT file_extension) WHEN 0 THEN 'empty' WHEN 1 THEN 'invariant' ELSE 'chart' END AS kind FROM inv")
def _(s, d):
    return R.category_kind(V.inv(s, d), "file_extension")


@query("inconsistency", INV + " SELECT 'file_extension' AS \"column\", count(DISTINCT file_extension) AS n_distinct, count(DISTINCT file_extension) > 1 AS flagged FROM inv UNION ALL SELECT 'grp', count(DISTINCT grp), count(DISTINCT grp) > 1 FROM inv")
def _(s, d):
    return R.inconsistencies(V.inv(s, d), ["file_extension", "grp"])


@query("constants", """c AS (SELECT substr(c_name, 1, 9) AS prefix, c_mktsegment AS segment, c_nationkey AS nation FROM customer), a AS (SELECT 'prefix' AS "column", min(prefix) AS value, min(prefix) = max(prefix) AS one FROM c
UNION ALL SELECT 'segment', min(segment), min(segment) = max(segment) FROM c UNION ALL SELECT 'nation', min(nation)::VARCHAR, min(nation) = max(nation) FROM c) SELECT "column", value FROM a WHERE one""")
def _(s, d):
    c = V.table(s, d, "customer").select(F.substring("c_name", 1, 9).alias("prefix"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return R.constants(c, c.columns)


@query("availability", SIDE + " SELECT 'quality' AS \"column\", count(quality) AS present, count(*) AS total, round(100 * count(quality) / count(*), 6) AS pct FROM side UNION ALL SELECT 'toxic', count(toxic), count(*), round(100 * count(toxic) / count(*), 6) FROM side")
def _(s, d):
    return rounded(R.availability(V.inv_side(s, d), ["quality", "toxic"]))


@query("size_availability", "SELECT 'p_size' AS \"column\", count(*) FILTER (p_size > 1) AS n_over_one FROM part UNION ALL SELECT 'p_partkey', count(*) FILTER (p_partkey > 1) FROM part")
def _(s, d):
    return R.size_availability(V.table(s, d, "part"), ["p_size", "p_partkey"])


@query("size_bubble", "SELECT p_size AS x, floor(p_retailprice / 100)::BIGINT AS y, p_brand AS grp, count(*) AS n FROM part WHERE p_size > 1 AND floor(p_retailprice / 100) > 1 GROUP BY ALL")
def _(s, d):
    return R.bubble(V.table(s, d, "part").withColumn("y", F.floor(F.col("p_retailprice") / 100)), "p_size", "y", "p_brand")


@query("size_heatmap", "b AS (SELECT min(p_size) AS lx, greatest(1, ceil((max(p_size) - min(p_size)) / 70)) AS sx, min(p_retailprice) AS ly, greatest(1, ceil((max(p_retailprice) - min(p_retailprice)) / 70)) AS sy FROM part) SELECT (floor((p_size - lx) / sx) * sx + lx)::DOUBLE AS x, round(floor((p_retailprice - ly) / sy) * sy + ly, 6) AS y, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM part, b GROUP BY 1, 2")
def _(s, d):
    return rounded(R.heatmap(V.table(s, d, "part"), "p_size", "p_retailprice"))


@query("dim_varies", "SELECT 'p_size' AS \"column\", count(DISTINCT p_size) AS n_distinct, min(p_size)::DOUBLE AS least, count(DISTINCT p_size) > 1 AS varies, count(*) FILTER (p_size > 1) BETWEEN 1 AND count(*) - 1 AS ragged FROM part")
def _(s, d):
    return R.varying_dims(V.table(s, d, "part"), ["p_size"])


BOX = "count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75"


@query("box_stats_exact", OBS + f" SELECT grp, 'v' AS metric, {BOX} FROM obs GROUP BY grp")
def _(s, d):
    return rounded(R.box_stats(V.obs(s, d), ["v"], "grp"))


@query("box_stats_raster", PX + f", m AS (SELECT record_id, grp, avg(p) AS v FROM px GROUP BY ALL) SELECT grp::VARCHAR AS grp, 'mean_intensity' AS metric, {BOX} FROM m GROUP BY grp")
def _(s, d):
    return rounded(R.box_stats(V.raster8(s, d).select("grp", *rasters.basic_columns("values")), ["mean_intensity"], "grp"))


@query("box_stats_category", f"SELECT o_orderstatus AS grp, o_orderpriority AS category, 'o_totalprice' AS metric, {BOX} FROM (SELECT *, o_totalprice AS v FROM orders) GROUP BY ALL")
def _(s, d):
    return rounded(R.box_stats(V.table(s, d, "orders"), ["o_totalprice"], "o_orderstatus", category="o_orderpriority"))


@query("distribution_mode", OBS + " SELECT grp, 'v' AS metric, count(v) AS n, CASE WHEN (SELECT min(v) = max(v) FROM obs) THEN 'invariant' WHEN (SELECT count(v) FROM obs) <= 5000 THEN 'points' ELSE 'box' END AS mode FROM obs GROUP BY grp")
def _(s, d):
    return R.distribution(V.obs(s, d), ["v"], "grp").select("grp", "metric", "n", "mode")


MEAN = HIST + """, a AS (SELECT *, n / sum(n) OVER (PARTITION BY record_id) AS share FROM h), g AS (SELECT grp, min(lo) AS glo, max(hi) AS ghi, count(DISTINCT record_id) AS k FROM h GROUP BY 1),
p AS (SELECT grp, glo, ghi, k, record_id, CASE WHEN ghi <= glo THEN 0 ELSE least(greatest(floor((lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 256) - glo) / ((ghi - glo) / 256)), 0), 255) END::INTEGER AS bin, sum(share) AS v FROM a JOIN g USING (grp) GROUP BY ALL),
o AS (SELECT grp, glo, ghi, k, bin, sum(v) / k AS mean, sum(v * v) / k AS sq FROM p GROUP BY grp, glo, ghi, k, bin)"""


@query("group_mean_hist", MEAN + " SELECT grp, round(glo, 6) AS lo, round(ghi, 6) AS hi, bin, round(mean, 6) AS mean, k AS n_histograms FROM o")
def _(s, d):
    h = rasters.block_histograms(V.raster8(s, d), ["record_id", "grp"])
    return rounded(R.group_mean_histogram(h, ["record_id"]).drop("spread_lo", "spread_hi"))


@query("hist_spread", MEAN + " SELECT grp, bin, CASE WHEN k >= 2 THEN round(greatest(0, mean - sqrt(greatest(0, sq - mean * mean))), 6) END AS spread_lo, CASE WHEN k >= 2 THEN round(mean + sqrt(greatest(0, sq - mean * mean)), 6) END AS spread_hi FROM o")
def _(s, d):
    h = rasters.block_histograms(V.raster8(s, d), ["record_id", "grp"])
    return rounded(R.group_mean_histogram(h, ["record_id"]).select("grp", "bin", "spread_lo", "spread_hi"))


@query("populated_extent", HIST + " SELECT record_id, round(min(lo + bin * ((hi - lo) / 256)), 6) AS \"from\", round(max(lo + (bin + 1) * ((hi - lo) / 256)), 6) AS \"to\" FROM h GROUP BY record_id")
def _(s, d):
    return rounded(R.populated_extent(rasters.block_histograms(V.raster8(s, d), ["record_id"]), ["record_id"]))


@query("rank_test", OBS + """, g AS (SELECT DISTINCT grp FROM obs), pr AS (SELECT x.grp AS a, y.grp AS b FROM g x JOIN g y ON x.grp < y.grp),
l AS (SELECT a, b, grp, v FROM pr JOIN obs ON grp IN (a, b)), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY v) AS rn FROM l), r AS (SELECT *, avg(rn) OVER (PARTITION BY a, b, v) AS rk FROM k),
u AS (SELECT a, b, count(*) FILTER (grp = a) AS n_a, count(*) FILTER (grp = b) AS n_b, sum(rk) FILTER (grp = a) AS ra FROM r GROUP BY a, b),
z AS (SELECT *, ra - n_a::DOUBLE * (n_a + 1) / 2 AS u, (ra - n_a::DOUBLE * (n_a + 1) / 2 - n_a::DOUBLE * n_b / 2) / sqrt(n_a::DOUBLE * n_b * (n_a + n_b + 1) / 12) AS z FROM u),
t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t FROM z),
p AS (SELECT *, CASE WHEN n_a < 3 OR n_b < 3 THEN 1 ELSE least(1, (((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t) + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-z * z / 2)) END AS p FROM t),
f AS (SELECT *, least(1, p * (SELECT count(*) FROM pr)) AS q FROM p)
SELECT a, b, n_a, n_b, u, round(z, 6) AS z, round(p, 6)::DOUBLE AS p, round(q, 6)::DOUBLE AS p_adj, CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END AS sign FROM f""")
def _(s, d):
    return rounded(ranktest.mann_whitney(V.obs(s, d), "v", "grp"))


@query("average_ranks", OBS + ", k AS (SELECT v, row_number() OVER (ORDER BY v) AS rn FROM obs WHERE v IS NOT NULL) SELECT v AS value, avg(rn) AS rank FROM k GROUP BY v")
def _(s, d):
    return ranktest.average_ranks(V.obs(s, d), "v")


@query("topk_two_step", "SELECT o_orderkey, o_totalprice, ord::INTEGER AS ord, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS ord FROM orders) WHERE ord <= 256")
def _(s, d):
    o = V.table(s, d, "orders")
    return R.fetch(R.top_k(o, "o_totalprice", "o_orderkey"), o, "o_orderkey", ["o_orderdate", "o_orderpriority"])


@query("page_rows", INV + " SELECT path, size_bytes FROM inv ORDER BY size_bytes DESC NULLS LAST, path LIMIT 10 OFFSET 20")
def _(s, d):
    return R.page(V.inv(s, d), "size_bytes", "path", 2, descending=True).select("path", "size_bytes")


@query("groups_list", INV + " SELECT DISTINCT grp FROM inv ORDER BY grp LIMIT 50")
def _(s, d):
    return R.groups_list(V.inv(s, d), "grp", 50)


@query("category_order", SIDE + ", c AS (SELECT DISTINCT coalesce(quality::VARCHAR, '(missing)') AS category FROM side) SELECT category, row_number() OVER (ORDER BY category = '(missing)', category)::INTEGER AS ord FROM c")
def _(s, d):
    return R.category_order(V.inv_side(s, d), "quality")


@query("capped_groups", OBS + " SELECT grp, count(*) AS n FROM obs GROUP BY grp HAVING count(*) >= 1000")
def _(s, d):
    return R.capped_groups(V.obs(s, d), "grp", 1000)


TREE = ", e AS (SELECT grp, size_bytes, unnest(list_concat([''], list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/')))) AS node FROM t) SELECT node, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, CASE WHEN min(grp) = max(grp) THEN min(grp) ELSE 'mixed' END AS label, CASE WHEN node = '' THEN 0 ELSE len(string_split(node, '/')) END::INTEGER AS depth FROM e GROUP BY node"


@query("hierarchy_counts", INV + ", t AS (SELECT grp, size_bytes, string_split(path, '/')[1:2] AS parts FROM inv)" + TREE)
def _(s, d):
    return R.hierarchy(V.inv(s, d), size="size_bytes", group="grp", folders_only=True)


@query("hierarchy_bytes", "t AS (SELECT 'all' AS grp, length(html) AS size_bytes, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages)" + TREE)
def _(s, d):
    return R.hierarchy(V.tree(s, d), size="size_bytes")


@query("folder_sizes", INV + " SELECT string_split(path, '/')[1] AS path, sum(size_bytes)::BIGINT AS size_bytes FROM inv GROUP BY 1 UNION ALL SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], sum(size_bytes)::BIGINT FROM inv GROUP BY 1")
def _(s, d):
    from ..sources.inventory import folder_sizes, with_folders

    files = V.inv(s, d).withColumn("type", F.lit("file"))
    return folder_sizes(with_folders(files)).select("path", "size_bytes")


@query("count_bar", "SELECT o_orderpriority AS category, o_orderstatus AS grp, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    return R.category_counts(V.table(s, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("cat_heatmap", SIDE + ", c AS (SELECT coalesce(quality::VARCHAR, '(missing)') AS x, coalesce(grp, '(missing)') AS y, count(*) AS n FROM side GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT x FROM c), (SELECT DISTINCT y FROM c)) SELECT x, y, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (x, y)")
def _(s, d):
    return R.category_heatmap(V.inv_side(s, d), "quality", "grp")


@query("cat_num", SIDE + " SELECT file_extension AS category, count(quality) AS n, count(*) - count(quality) AS n_null, round(avg(quality), 6) AS mean, round(stddev_samp(quality), 6) AS std, min(quality)::DOUBLE AS min, max(quality)::DOUBLE AS max FROM side GROUP BY 1")
def _(s, d):
    return rounded(R.category_numbers(V.inv_side(s, d), "file_extension", "quality"))


@query("num_num", SIDE + " SELECT toxic AS y, count(*) AS n, count(*) - count(size_bytes) AS n_null, min(size_bytes) AS min, max(size_bytes) AS max FROM side GROUP BY 1")
def _(s, d):
    return R.number_by_constant(V.inv_side(s, d), "size_bytes", "toxic")


@query("null_counts", SIDE + " SELECT 'quality' AS \"column\", count(*) - count(quality) AS n_null FROM side UNION ALL SELECT 'path', count(*) - count(path) FROM side")
def _(s, d):
    return R.null_counts(V.inv_side(s, d), ["quality", "path"])


@query("pair_profile", "SELECT count(DISTINCT o_orderpriority) AS n_x, count(DISTINCT o_totalprice) AS n_y, count(DISTINCT o_orderpriority) AS n_x_missing, count(DISTINCT o_totalprice) AS n_y_missing, 0::BIGINT AS n_null, 'box' AS kind FROM orders")
def _(s, d):
    return R.pair_profile(V.table(s, d, "orders"), "o_orderpriority", "o_totalprice")


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, '{r}' AS role FROM orders" for c, r in (("o_orderkey", "metric"), ("o_custkey", "metric"), ("o_orderstatus", "group"), ("o_totalprice", "metric"), ("o_orderdate", "date"), ("o_orderpriority", "group"))))
def _(s, d):
    return R.column_profile(V.table(s, d, "orders"))


@query("group_candidates", INV + ", c AS (SELECT 'file_extension' AS \"column\", count(DISTINCT file_extension) AS n_distinct FROM inv UNION ALL SELECT 'grp', count(DISTINCT grp) FROM inv UNION ALL SELECT 'name', count(DISTINCT name) FROM inv) SELECT * FROM c WHERE n_distinct BETWEEN 2 AND 12")
def _(s, d):
    return R.group_candidates(V.inv(s, d), ["file_extension", "grp", "name"])


@query("quality_checks", INV + ", n AS (SELECT grp, count(*) AS n FROM inv GROUP BY 1), r AS (SELECT max(n) / min(n) AS r FROM n) SELECT 'extensions' AS \"check\", count(DISTINCT file_extension)::DOUBLE AS value, 1.0::DOUBLE AS threshold, count(DISTINCT file_extension) > 1 AS flagged FROM inv UNION ALL SELECT 'group_imbalance', round(r, 6), 1.5, r >= 1.5 FROM r UNION ALL SELECT 'mixed_file_extension', count(DISTINCT file_extension), 1.0, count(DISTINCT file_extension) > 1 FROM inv UNION ALL SELECT 'mixed_size_bytes', count(DISTINCT size_bytes), 1.0, count(DISTINCT size_bytes) > 1 FROM inv")
def _(s, d):
    return rounded(R.quality_checks(V.inv(s, d), "grp", ["file_extension"], ["size_bytes"]))


@query("child_rows", "SELECT conv_id::VARCHAR AS path, turn::VARCHAR AS child_id, role AS grp, 'sub_file' AS type FROM conversations")
def _(s, d):
    return records.sub_file_type(V.child(s, d))


@query("container_expansion", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::VARCHAR AS child_id, turn, 'sub_file' AS type FROM conversations")
def _(s, d):
    rows = V.table(s, d, "conversations").select("conv_id", "turn", "text")
    return records.numbered_children(rows, "conv_id", "turn", ["text"]).select("conv_id", "child_id", "turn", "type")


@query("sidecar_join", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    return records.sidecar(V.table(s, d, "documents").select("doc_id", "n_chars"), V.table(s, d, "labels"), "doc_id")


@query("diag_union", "SELECT conv_id::VARCHAR AS path, turn::VARCHAR AS child_id, role AS grp, NULL::BIGINT AS size_bytes FROM conversations UNION ALL SELECT source || '/' || lang || '/' || doc_id, NULL, source, n_chars FROM documents")
def _(s, d):
    return records.diagonal_union(V.child(s, d), V.inv(s, d).select("path", "size_bytes", "grp"))


@query("file_metadata", LEAF + " SELECT rec, obs_level, v_sum, o_orderstatus, o_totalprice FROM cube JOIN orders ON rec = o_orderkey WHERE obs_level < 2")
def _(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("rec"), "o_orderstatus", "o_totalprice")
    return records.file_metadata(V.leaf_cube(s, d).where("obs_level < 2"), o, "rec").select("rec", "obs_level", "v_sum", "o_orderstatus", "o_totalprice")


@query("colocated", "SELECT s_nationkey AS lat, (s_nationkey % 5) AS lon, count(*) AS n, array_to_string(list_sort(list(s_suppkey::VARCHAR)), ',') AS members FROM supplier GROUP BY ALL")
def _(s, d):
    return R.colocated(V.table(s, d, "supplier").withColumn("lon", F.col("s_nationkey") % 5), "s_nationkey", "lon", "s_suppkey")


@query("nodata_values", SIDE + " SELECT coalesce(quality::VARCHAR, 'not set') AS value, grp, count(*) AS n FROM side GROUP BY ALL")
def _(s, d):
    return R.nodata_values(V.inv_side(s, d), "quality", "grp")


@query("embed_export", "SELECT c_name, c_mktsegment, (c_custkey + c_nationkey + coalesce(c_acctbal, 0))::DOUBLE AS total FROM customer")
def _(s, d):
    vectors, _ = sinks.embedding_tables(V.table(s, d, "customer"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("c_name", "c_mktsegment", total.alias("total"))


@query("stream_timeline", OBS + " SELECT strftime(ts, '%Y-%m-%d') AS bucket, grp, count(*) AS n FROM obs GROUP BY ALL")
def _(s, d):
    """The batch form of the streaming query: the same plan without its source."""
    return stream_timeline(V.obs(s, d), "ts", "grp")


def _arriving(s, df, folder: str, first, then):
    """``df`` in two parts, one after the other: each call writes a part and gives the stream of all that is there."""
    for k, part in enumerate((first, then)):
        df.where(part).write.parquet(f"{folder}/in/{k}")
        yield s.readStream.schema(df.schema).parquet(f"{folder}/in/*")


@query("incremental_cube", STACK + """, p AS (SELECT record_id, dim_t, dim_c, unnest(embedding)::DOUBLE AS p FROM st), a AS (SELECT record_id, min(dim_t) < max(dim_t) AS t, min(dim_c) < max(dim_c) AS c FROM p GROUP BY 1),
m AS (SELECT p.record_id, CASE WHEN t THEN dim_t END AS dim_t, CASE WHEN c THEN dim_c END AS dim_c, p FROM p JOIN a USING (record_id))
SELECT record_id, dim_t, dim_c, (2 - GROUPING(dim_t) - GROUPING(dim_c))::INTEGER AS obs_level, round(avg(p), 6) AS mean_intensity, round(stddev_pop(p), 6) AS std_intensity, round(min(p), 6) AS min_intensity, round(max(p), 6) AS max_intensity, count(*)::BIGINT AS finite_pixel_count FROM m
GROUP BY GROUPING SETS ((record_id), (record_id, dim_t), (record_id, dim_c), (record_id, dim_t, dim_c)) HAVING NOT (GROUPING(dim_t) = 0 AND dim_t IS NULL) AND NOT (GROUPING(dim_c) = 0 AND dim_c IS NULL)""")
def _(s, d):
    """Planes of one channel arrive first, then the others; the second batch comes twice, before and after both are merged."""
    folder = sinks.scratch(s, "stream")
    how = rasters.REGISTRY["basic"].aggregates
    cube = IncrementalCube(f"{folder}/cube", ["record_id"], ["dim_t", "dim_c"], how, "finite_pixel_count")
    kernels = lambda df: df.select("record_id", "dim_t", "dim_c", *rasters.basic_columns("values"))
    for stream in _arriving(s, V.stack(s, d).drop("dtype"), folder, "dim_c = 0", "dim_c <> 0"):
        ingest_cube(stream, cube, f"{folder}/checkpoint", kernels).awaitTermination()
    again = kernels(s.read.parquet(f"{folder}/in/1"))
    cube.add(again, 1)
    cube.compact(s)
    cube.add(again, 1)
    return rounded(cube.snapshot(s))


@query("stream_timeline_run", OBS + " SELECT strftime(ts, '%Y-%m-%d') AS bucket, grp, count(*) AS n FROM obs GROUP BY ALL")
def _(s, d):
    """Events arriving in two parts, the late ones of them within the watermark."""
    folder = sinks.scratch(s, "stream")
    for stream in _arriving(s, V.obs(s, d).withColumn("ts", F.col("ts").cast("timestamp")), folder, "id % 2 = 0", "id % 2 <> 0"):
        completed(stream_timeline(stream, "ts", "grp", late="3650 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return latest(s, f"{folder}/out")


@query("stream_snapshot", OBS + " SELECT grp, count(*) AS n, round(avg(v), 6) AS mean FROM obs GROUP BY grp")
def _(s, d):
    folder = sinks.scratch(s, "stream")
    for stream in _arriving(s, V.obs(s, d), folder, "id % 3 = 0", "id % 3 <> 0"):
        completed(running_snapshot(stream, "grp", "v"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return rounded(latest(s, f"{folder}/out"))
