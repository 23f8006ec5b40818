"""The library's operators applied to the test tables, each with the SQL that DuckDB can run.

An embedding of 64 elements stands for an 8 by 8 image, or for a stack of 4 by 4 planes; line items
stand for objects of three channels and two compartments, orders for cells, customers for samples
and nations and regions for folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.config import Config
from lumenframe.functions import calibration, display, geometry
from lumenframe.operators import compartments, doublets, features, hull, metrics, outliers, segmentation, spatial, surface
from lumenframe.operators.quantiles import with_median
from lumenframe.sources import discovery, pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LOW, HIGH, CELL_LOW = 140, 255, 150


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def intensity():
    return F.floor((F.col("e").cast("double") + 1) * 127.5).cast("long")


def flat(spark: SparkSession, d: str) -> DataFrame:
    return pixels.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", 8, scale=intensity())


def stack(spark: SparkSession, d: str) -> DataFrame:
    return pixels.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", 4, 4, scale=intensity())


PX = """flat AS (SELECT vec_id AS sample_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT) AS v
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings) WHERE e IS NOT NULL)"""
PZ = """stack AS (SELECT vec_id AS sample_id, CAST(pos // 16 AS INT) AS z, CAST((pos // 4) % 4 AS INT) AS y, CAST(pos % 4 AS INT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT) AS v
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings) WHERE e IS NOT NULL)"""


#: Orientation of second moments a, b, c.
ANGLE = "CASE WHEN abs(a-c) <= 1e-12*(a+c) AND abs(b) <= 1e-12*(a+c) THEN -pi()/4 ELSE 0.5*atan2(2*b, a-c) END"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""WITH {PX} SELECT sample_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(median(CAST(v AS DOUBLE)), 6) AS median,
  round(quantile_cont(CAST(v AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(v AS DOUBLE), 0.9), 6) AS p90, CAST(sum(v) AS BIGINT) AS total FROM flat WHERE v BETWEEN 140 AND 255 GROUP BY sample_id""")
def threshold_intensity_stats(spark, d):
    band = flat(spark, d).where(features.in_band(F.col("v"), LOW, HIGH))
    return features.intensity(band, ["sample_id"]).select("sample_id", "n", *r6("mean", "sd", "median", "p10", "p90"), "total")


@query(f"""WITH {PX}, m AS (SELECT sample_id, count(*) AS area, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM flat WHERE v BETWEEN 140 AND 255 GROUP BY sample_id),
 e AS (SELECT *, greatest((a+c)/2 + sqrt(greatest(((a-c)/2)*((a-c)/2) + b*b, 0)), 0) AS big, greatest((a+c)/2 - sqrt(greatest(((a-c)/2)*((a-c)/2) + b*b, 0)), 0) AS small FROM m)
 SELECT sample_id, area, round(cy, 5) AS cy, round(cx, 5) AS cx, round(4*sqrt(big), 5) AS major, round(4*sqrt(small), 5) AS minor, round(sqrt(greatest(1 - small/nullif(big, 0), 0)), 5) AS eccentricity FROM e""")
def moment_axes(spark, d):
    band = flat(spark, d).where(features.in_band(F.col("v"), LOW, HIGH))
    names = ("cy", "cx", "major", "minor", "eccentricity")
    return features.ellipse(band, ["sample_id"]).select("sample_id", "area", *[F.round(n, 5).alias(n) for n in names])


@query(f"""WITH {PX}, m AS (SELECT sample_id, label, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM (SELECT *, CASE WHEN y < 4 THEN 1 ELSE 2 END AS label FROM flat WHERE v BETWEEN 140 AND 255) GROUP BY sample_id, label),
 t AS (SELECT sample_id, {ANGLE} AS theta FROM m)
 SELECT sample_id, round(CASE WHEN count(*) > 1 THEN sqrt(pow(avg(cos(2*theta)), 2) + pow(avg(sin(2*theta)), 2)) END, 4) AS alignment FROM t GROUP BY sample_id""")
def alignment_axial(spark, d):
    halves = flat(spark, d).where(features.in_band(F.col("v"), LOW, HIGH)).withColumn("label", F.when(F.col("y") < 4, 1).otherwise(2))
    axes = features.ellipse(halves, ["sample_id", "label"])
    return axes.groupBy("sample_id").agg(F.round(geometry.axial_order(F.col("orientation")), 4).alias("alignment"))


@query(f"""WITH {PZ}, m AS (SELECT sample_id, count(*) AS voxels, var_pop(z*2e0) AS zz, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(z*2e0, y) AS zy, covar_pop(z*2e0, x) AS zx, covar_pop(y, x) AS yx FROM stack WHERE v BETWEEN 120 AND 255 GROUP BY sample_id),
 q AS (SELECT *, (zz+yy+xx)/3 AS q FROM m), p AS (SELECT *, sqrt(greatest(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(yx*yx+zx*zx+zy*zy))/6, 0)) AS p FROM q),
 s AS (SELECT *, CASE WHEN p < 1e-12 THEN 1e0 ELSE p END AS s FROM p),
 r AS (SELECT *, (((xx-q)/s)*(((yy-q)/s)*((zz-q)/s)-(zy/s)*(zy/s)) - (yx/s)*((yx/s)*((zz-q)/s)-(zy/s)*(zx/s)) + (zx/s)*((yx/s)*(zy/s)-((yy-q)/s)*(zx/s)))/2 AS r FROM s),
 l AS (SELECT sample_id, voxels, q, p, acos(least(greatest(r, -1e0), 1e0))/3 AS f FROM r),
 e AS (SELECT sample_id, voxels, CASE WHEN p < 1e-12 THEN q ELSE q+2*p*cos(f) END AS a, CASE WHEN p < 1e-12 THEN q ELSE q+2*p*cos(f+2*pi()/3) END AS c, q FROM l)
 SELECT sample_id, voxels, round(2*sqrt(5*greatest(a, 0)), 4) AS major, round(2*sqrt(5*greatest(3*q-a-c, 0)), 4) AS mid, round(2*sqrt(5*greatest(c, 0)), 4) AS minor FROM e""")
def ellipsoid_axes(spark, d):
    band = stack(spark, d).where(features.in_band(F.col("v"), 120, HIGH))
    return features.ellipsoid(band, ["sample_id"], aniso=2.0).select("sample_id", "voxels", *[F.round(n, 4).alias(n) for n in ("major", "mid", "minor")])


@query(f"""WITH {PX} SELECT sample_id, count(*) AS size FROM (SELECT *, 1 AS label FROM flat WHERE v BETWEEN 150 AND 255) GROUP BY sample_id HAVING count(*) >= 3 AND min(y) >= 1 AND min(x) >= 1 AND max(y) < 7 AND max(x) < 7""")
def border_and_size_filter(spark, d):
    frame = flat(spark, d)
    labels = frame.where(features.in_band(F.col("v"), CELL_LOW, HIGH)).withColumn("label", F.lit(1))
    return segmentation.kept_objects(labels, frame, 3, 1).select("sample_id", "size")


@query(f"""WITH {PX} SELECT sample_id, round(avg(v), 6) AS mean, round(1e2*avg(CASE WHEN v >= 180 THEN 1e0 ELSE 0 END), 6) AS saturated_pct, round(1e2*avg(CASE WHEN v BETWEEN 140 AND 255 THEN 1e0 ELSE 0 END), 6) AS in_band_pct FROM flat GROUP BY sample_id""")
def channel_qc(spark, d):
    return metrics.channel_qc(flat(spark, d), LOW, HIGH, 180).select("sample_id", *r6("mean", "saturated_pct", "in_band_pct"))


@query(f"""WITH {PX} SELECT CAST(least(floor(v/2.55e2*128), 127) AS INT) AS bin, count(*) AS n FROM flat WHERE v BETWEEN 0 AND 255 GROUP BY 1""")
def histogram_128(spark, d):
    return metrics.histogram(flat(spark, d), "v", [], 255.0).select("bin", "n")


@query(f"""WITH {PX}, b AS (SELECT sample_id, min(v) AS lo, max(v) AS hi FROM flat GROUP BY sample_id), q AS (SELECT sample_id, y, x, CAST(floor((v-lo)/CAST(hi-lo AS DOUBLE)*255) AS BIGINT) AS g FROM flat JOIN b USING (sample_id) WHERE hi > lo),
 o AS (SELECT * FROM (VALUES (0,0,1),(1,-1,1),(2,-1,0),(3,-1,-1)) AS t(k, dy, dx)), p AS (SELECT l.sample_id, k, l.g AS i, r.g AS j FROM q l, o, q r WHERE r.sample_id = l.sample_id AND r.y = l.y+dy AND r.x = l.x+dx),
 n AS (SELECT sample_id, k, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT sample_id, k, j, i FROM p) GROUP BY ALL),
 s AS (SELECT sample_id, k, CAST(sum(n) AS BIGINT) AS t, CAST(sum(n*(i-j)*(i-j)) AS BIGINT) AS c, sum(n/(1e0+(i-j)*(i-j))) AS h, CAST(sum(n*n) AS BIGINT) AS e FROM n GROUP BY ALL)
 SELECT sample_id, round(avg(c/CAST(t AS DOUBLE)), 3) AS contrast, round(avg(h/t), 5) AS homogeneity, round(avg(sqrt(CAST(e AS DOUBLE))/t), 5) AS energy FROM s GROUP BY sample_id""")
def glcm_texture(spark, d):
    t = features.texture(flat(spark, d), ["sample_id"])
    return t.select("sample_id", F.round("contrast", 3).alias("contrast"), F.round("homogeneity", 5).alias("homogeneity"), F.round("energy", 5).alias("energy"))


def hull_sql(o: str) -> str:
    """CTEs hp_o (the hull's points by doubled row) and hr_o (first and last column a, b of each row) of the objects o(sample_id, label, y, x): the ends of all chords between points."""
    at = lambda e: f"CASE WHEN i.t = j.t THEN i.{e}/2e0 ELSE (i.{e}*(j.t-i.t) + (j.{e}-i.{e})*(2*k.y-i.t))/(2e0*(j.t-i.t)) END"
    return f"""hp_{o} AS (SELECT sample_id, label, t, min(l) AS l, max(r) AS r FROM (SELECT sample_id, label, unnest([2*y-1, 2*y, 2*y+1]) AS t, unnest([2*a, 2*a-1, 2*a]) AS l, unnest([2*b, 2*b+1, 2*b]) AS r FROM (SELECT sample_id, label, y, min(x) AS a, max(x) AS b FROM {o} GROUP BY ALL)) GROUP BY ALL),
 hr_{o} AS (SELECT k.sample_id, k.label, k.y, CAST(min(ceil({at("l")})) AS INT) AS a, CAST(max(floor({at("r")})) AS INT) AS b FROM (SELECT sample_id, label, unnest(range(y0, y1+1)) AS y FROM (SELECT sample_id, label, min(y) AS y0, max(y) AS y1 FROM {o} GROUP BY ALL)) k JOIN hp_{o} i ON i.sample_id = k.sample_id AND i.label = k.label AND i.t <= 2*k.y JOIN hp_{o} j ON j.sample_id = k.sample_id AND j.label = k.label AND j.t >= 2*k.y GROUP BY ALL)"""


def shape_sql(o: str) -> str:
    """CTE sh_o(sample_id, label, area, circ, ecc, solidity) of the objects o(sample_id, label, y, x)."""
    same = "n.sample_id = a.sample_id AND n.label = a.label"
    return f"""{hull_sql(o)}, eb_{o} AS (SELECT * FROM {o} a WHERE (SELECT count(*) FROM {o} n WHERE {same} AND abs(n.y-a.y)+abs(n.x-a.x) = 1) < 4),
 ec_{o} AS (SELECT a.sample_id, a.label, a.y, a.x, 1 + coalesce(sum(CASE WHEN abs(n.y-a.y)+abs(n.x-a.x) = 1 THEN 2 WHEN n.y IS NOT NULL THEN 10 END), 0) AS code FROM eb_{o} a LEFT JOIN eb_{o} n ON {same} AND abs(n.y-a.y) <= 1 AND abs(n.x-a.x) <= 1 AND (n.y <> a.y OR n.x <> a.x) GROUP BY ALL),
 pe_{o} AS (SELECT sample_id, label, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1 WHEN code IN (21,33) THEN sqrt(2e0) WHEN code IN (13,23) THEN (1+sqrt(2e0))/2 ELSE 0 END) AS perimeter FROM ec_{o} GROUP BY ALL),
 mo_{o} AS (SELECT sample_id, label, count(*) AS area, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM {o} GROUP BY ALL),
 ei_{o} AS (SELECT *, (a+c)/2 + sqrt(greatest(((a-c)/2)*((a-c)/2) + b*b, 0)) AS big, (a+c)/2 - sqrt(greatest(((a-c)/2)*((a-c)/2) + b*b, 0)) AS small FROM mo_{o}),
 sh_{o} AS (SELECT sample_id, label, area, coalesce(4*pi()*area/nullif(perimeter*perimeter, 0), 0) AS circ, sqrt(greatest(1 - greatest(small, 0)/nullif(big, 0), 0)) AS ecc, area/CAST(hull AS DOUBLE) AS solidity
  FROM ei_{o} JOIN pe_{o} USING (sample_id, label) JOIN (SELECT sample_id, label, sum(b-a+1) AS hull FROM hr_{o} GROUP BY ALL) USING (sample_id, label))"""


SCORE = "least(((1-circ) + (1-solidity) + ecc + least(greatest(area/median(area) OVER (PARTITION BY {by}) - 1, 0), 1))/4, 1)"

RIM = f"""{PX}, m AS (SELECT DISTINCT sample_id, y, x FROM flat WHERE v BETWEEN 130 AND 255), b AS (SELECT * FROM m a WHERE (SELECT count(*) FROM m n WHERE n.sample_id = a.sample_id AND abs(n.y-a.y)+abs(n.x-a.x) = 1) < 4),
 c AS (SELECT a.sample_id, a.y, a.x, 1 + coalesce(sum(CASE WHEN abs(n.y-a.y)+abs(n.x-a.x) = 1 THEN 2 WHEN n.y IS NOT NULL THEN 10 END), 0) AS code FROM b a LEFT JOIN b n ON n.sample_id = a.sample_id AND abs(n.y-a.y) <= 1 AND abs(n.x-a.x) <= 1 AND (n.y <> a.y OR n.x <> a.x) GROUP BY ALL),
 rim AS (SELECT sample_id, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1 WHEN code IN (21,33) THEN sqrt(2e0) WHEN code IN (13,23) THEN (1+sqrt(2e0))/2 ELSE 0 END) AS perimeter FROM c GROUP BY sample_id),
 mom AS (SELECT sample_id, count(*) AS area, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM m GROUP BY sample_id),
 eig AS (SELECT sample_id, area, (a+c)/2 + sqrt(greatest(((a-c)/2)*((a-c)/2) + b*b, 0)) AS big, (a+c)/2 - sqrt(greatest(((a-c)/2)*((a-c)/2) + b*b, 0)) AS small FROM mom),
 shape AS (SELECT sample_id, area, sqrt(greatest(1 - greatest(small, 0)/nullif(big, 0), 0)) AS ecc, coalesce(4*pi()*area/nullif(perimeter*perimeter, 0), 0) AS circ FROM eig JOIN rim USING (sample_id))"""


@query(f"WITH {RIM} SELECT sample_id, round(perimeter, 6) AS perimeter FROM rim")
def perimeter(spark, d):
    return features.perimeter(flat(spark, d).where(features.in_band(F.col("v"), 130, HIGH)), ["sample_id"]).select("sample_id", *r6("perimeter"))


@query(f"WITH {PX}, o AS (SELECT sample_id, 1 AS label, y, x FROM flat WHERE v BETWEEN 130 AND 255), {shape_sql('o')} SELECT sample_id, round(circ, 5) AS circularity, round({SCORE.format(by='1')}, 5) AS doublet_score FROM sh_o")
def doublet_scores(spark, d):
    band = flat(spark, d).where(features.in_band(F.col("v"), 130, HIGH)).withColumn("label", F.lit(1))
    shape = features.ellipse(band, ["sample_id", "label"]).join(features.perimeter(band, ["sample_id", "label"]), ["sample_id", "label"]).join(hull.convexity(band), ["sample_id", "label"])
    circ = features.circularity(F.col("area"), F.col("perimeter"))
    score = features.doublet_score(circ, F.col("solidity"), F.col("eccentricity"), F.col("area"), F.col("median_area"))
    return with_median(shape, [], F.col("area"), "median_area").select("sample_id", F.round(circ, 5).alias("circularity"), F.round(score, 5).alias("doublet_score"))


@query(f"""WITH {PX}, o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy*dy+dx*dx <= 4) SELECT sample_id, count(*) AS px FROM (SELECT DISTINCT sample_id, y+dy AS y, x+dx AS x FROM flat, o WHERE v >= 150) GROUP BY sample_id""")
def dilated_area(spark, d):
    labels = flat(spark, d).where("v >= 150").withColumn("label", F.lit(1))
    return segmentation.dilated(labels, 2).groupBy("sample_id").agg(F.count("*").alias("px"))


def peaks_sql(p: str, by: str) -> str:
    """CTE pk(by, n_peaks, frequency) of the positions p(by, p): bins of one, means of three (profiles are short), plateaus as one."""
    w = f"PARTITION BY {by} ORDER BY bin"
    return f"""z AS (SELECT {by}, count(*) AS n, min(p) AS lo, max(p)-min(p) AS span FROM {p} GROUP BY ALL),
 g AS (SELECT *, unnest(range(CAST(ceil(span) AS BIGINT)+1)) AS bin FROM z WHERE n >= 3 AND span >= 2),
 c AS (SELECT {', '.join('g.' + c.strip() for c in by.split(','))}, span, bin, count(p) AS c FROM g LEFT JOIN {p} q ON {' AND '.join(f'q.{c.strip()} = g.{c.strip()}' for c in by.split(','))} AND p >= lo-5e-1+bin AND p < lo-5e-1+bin+1 GROUP BY ALL),
 s AS (SELECT {by}, span, bin, coalesce(lag(c) OVER w, c) + c + coalesce(lead(c) OVER w, c) AS s FROM c WINDOW w AS ({w})),
 r AS (SELECT *, s IS DISTINCT FROM lag(s) OVER w AS new FROM s WINDOW w AS ({w})), runs AS (SELECT {by}, span, bin, s FROM r WHERE new),
 t AS (SELECT {by}, span, coalesce(s >= 1.5 AND lag(s) OVER w < s AND lead(s) OVER w < s, false) AS peak FROM runs WINDOW w AS ({w})),
 f AS (SELECT {by}, span, CAST(sum(CASE WHEN peak THEN 1 ELSE 0 END) AS INT) AS n_peaks FROM t GROUP BY ALL),
 pk AS (SELECT {by}, coalesce(n_peaks, 0) AS n_peaks, n_peaks/CAST(f.span AS DOUBLE) AS frequency FROM z LEFT JOIN f USING ({by}))"""


@query(f"""WITH {PX}, b AS (SELECT sample_id, x*9e-1+y*3.5e-1 AS p FROM flat WHERE v BETWEEN 140 AND 255), {peaks_sql('b', 'sample_id')} SELECT sample_id, n_peaks, round(frequency, 6) AS frequency FROM pk""")
def axis_peaks(spark, d):
    band = flat(spark, d).where(features.in_band(F.col("v"), LOW, HIGH))
    return spatial.axis_profile_peaks(band, ["sample_id"], F.col("x") * 0.9 + F.col("y") * 0.35).withColumn("frequency", F.round("frequency", 6))


@query("""SELECT c_nationkey AS sample_id, count(*) AS n, round(avg(CASE WHEN c_acctbal > 0 THEN 1e0 ELSE 0 END), 6) AS complete FROM customer GROUP BY 1""")
def completeness(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "sample_id")
    return metrics.completeness(c, ["sample_id"], F.col("c_acctbal") > 0).withColumn("complete", F.round("complete", 6))


@query(f"""WITH {PZ} SELECT sample_id, z, round(z*2e0, 4) AS z_um, 'intensity:c0' AS series, round(avg(v), 3) AS value FROM stack GROUP BY sample_id, z UNION ALL
 SELECT sample_id, z, round(z*2e0, 4), 'stain_coverage', round(avg(CASE WHEN v BETWEEN 140 AND 255 THEN 1e0 ELSE 0 END), 6) FROM stack GROUP BY sample_id, z""")
def depth_profile(spark, d):
    px = stack(spark, d)
    scale = px.select("sample_id").distinct().withColumns({"px": F.lit(1.0), "pz": F.lit(2.0)})
    return features.depth_profiles(px, {"stain_coverage": px.where(features.in_band(F.col("v"), LOW, HIGH))}, scale)


@query(f"""WITH {PZ}, c AS (SELECT sample_id, z, avg(v) AS mean FROM stack GROUP BY ALL) SELECT sample_id, z, round(mean / nullif(max(mean) OVER (PARTITION BY sample_id), 0), 6) AS relative FROM c""")
def depth_curve_relative(spark, d):
    from pyspark.sql import Window

    c = features.depth_profile(stack(spark, d))
    return c.select("sample_id", "z", F.round(geometry.ratio(F.col("mean"), F.max("mean").over(Window.partitionBy("sample_id", "channel"))), 6).alias("relative"))


@query(f"""WITH {PZ}, o AS (SELECT sample_id, CASE WHEN v >= 150 THEN 2 ELSE 1 END AS label, min(z) AS a, max(z) AS b FROM stack WHERE v >= 140 GROUP BY ALL) SELECT sample_id, count(*) AS n, CAST(sum(CASE WHEN a = 0 OR b = 3 THEN 1 ELSE 0 END) AS BIGINT) AS truncated FROM o GROUP BY sample_id""")
def truncated_objects(spark, d):
    px = stack(spark, d)
    labels = px.where("v >= 140").withColumn("label", F.when(F.col("v") >= 150, 2).otherwise(1))
    return features.truncated(labels, px.groupBy("sample_id").agg(F.max("z").alias("z_max")))


SCREEN = """objects AS (SELECT l_orderkey, l_linenumber, l_returnflag AS channel, l_extendedprice AS size FROM lineitem),
 m AS (SELECT *, CASE WHEN size > 0 THEN log10(size) END AS lg FROM objects), n AS (SELECT *, median(lg) OVER (PARTITION BY channel) AS med FROM m), a AS (SELECT *, median(abs(lg-med)) OVER (PARTITION BY channel) AS mad FROM n),
 s AS (SELECT *, 0.6745e0*(lg-med)/nullif(mad, 0) AS z FROM a), f AS (SELECT *, coalesce(abs(z) > 3, false) AS flagged FROM s)"""


def screen(spark, d) -> DataFrame:
    objects = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("size"))
    return outliers.screened(objects, ["channel"], 3.0)


@query(f"""WITH {SCREEN} SELECT channel, count(*) AS n_objects, CAST(sum(CASE WHEN flagged THEN 1 ELSE 0 END) AS BIGINT) AS n_objects_flagged, round(avg(CASE WHEN flagged THEN 1e0 ELSE 0 END), 6) AS flag_rate, count(DISTINCT CASE WHEN flagged THEN l_orderkey END) AS n_cells_flagged,
 round(pow(1e1, any_value(med)), 3) AS median_size, round(any_value(mad), 6) AS mad_log10, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM f GROUP BY channel""")
def outlier_screen(spark, d):
    s = outliers.screen_summary(screen(spark, d), ["channel"], "l_orderkey")
    return s.select("channel", "n_objects", "n_objects_flagged", F.round("flag_rate", 6).alias("flag_rate"), "n_cells_flagged", F.round("median_size", 3).alias("median_size"), *r6("mad_log10", "z_min", "z_max"))


@query(f"""WITH {SCREEN} SELECT DISTINCT l_orderkey FROM f WHERE flagged""")
def outlier_votes(spark, d):
    return outliers.votes(screen(spark, d), ["l_orderkey"])


@query(f"""WITH {SCREEN} SELECT o_orderkey FROM orders WHERE o_totalprice > 1e5 AND o_orderkey NOT IN (SELECT l_orderkey FROM f WHERE flagged)""")
def outlier_tier(spark, d):
    kept = table(spark, d, "orders").where("o_totalprice > 1e5").select(F.col("o_orderkey").alias("l_orderkey"))
    return outliers.outlier_tier(kept, screen(spark, d), ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"))


@query(f"""WITH {SCREEN} SELECT channel, count(DISTINCT o_orderkey) AS n FROM f JOIN orders ON o_orderkey = l_orderkey WHERE flagged AND o_totalprice > 1e5 GROUP BY channel""")
def outlier_removed_by_channel(spark, d):
    kept = table(spark, d, "orders").where("o_totalprice > 1e5").select(F.col("o_orderkey").alias("l_orderkey"))
    return outliers.removed_by_channel(kept, screen(spark, d), ["channel"], ["l_orderkey"])


CELLS = """cells AS (SELECT o_custkey AS sample_id, o_orderkey AS nuc_id, o_totalprice/1e3 AS nuc_size, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey // 2 END AS cyto_id FROM orders),
 cyto AS (SELECT sample_id, cyto_id, max(nuc_size)*2 AS cyto_size FROM cells WHERE cyto_id IS NOT NULL GROUP BY ALL),
 st AS (SELECT o_custkey AS sample_id, o_orderkey AS nuc_id, o_orderkey // 2 AS cyto_id, l_linestatus AS layer, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
 sn AS (SELECT sample_id, nuc_id, sum(q)/1e1 AS n_size, count(*) AS n_count, CAST(sum(q) AS BIGINT) AS n_px FROM st WHERE layer = 'O' GROUP BY ALL),
 sc AS (SELECT sample_id, cyto_id, sum(q)/1e1 AS c_size, count(*) AS c_count, CAST(sum(q) AS BIGINT) AS c_px FROM st WHERE layer = 'F' GROUP BY ALL),
 j AS (SELECT c.sample_id, c.nuc_id, c.nuc_size, c.cyto_id, cyto_size, CASE WHEN cyto_size IS NOT NULL THEN count(*) OVER (PARTITION BY c.sample_id, c.cyto_id) END AS nuclei_in_cell, coalesce(n_size, 0) AS n_size, coalesce(n_count, 0) AS n_count, coalesce(n_px, 0) AS n_px, coalesce(c_size, 0) AS c_size, coalesce(c_count, 0) AS c_count, coalesce(c_px, 0) AS c_px
  FROM cells c LEFT JOIN cyto USING (sample_id, cyto_id) LEFT JOIN sn ON sn.sample_id = c.sample_id AND sn.nuc_id = c.nuc_id LEFT JOIN sc ON sc.sample_id = c.sample_id AND sc.cyto_id = c.cyto_id)"""


def cell_table(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    nuclei = orders.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e3).alias("size"))
    half = F.floor(F.col("o_orderkey") / 2).cast("long")
    mapping = orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("nuc_id"), half.alias("cyto_id"))
    cyto = mapping.join(nuclei.withColumnRenamed("id", "nuc_id"), ["sample_id", "nuc_id"]).groupBy("sample_id", F.col("cyto_id").alias("id")).agg((F.max("size") * 2).alias("size"))
    st = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    measured = lambda layer, i: st.where(F.col("l_linestatus") == layer).groupBy(F.col("o_custkey").alias("sample_id"), i.alias("id")).agg((F.sum("l_quantity") / 10).alias("size"), F.count("*").alias("count"), F.sum("l_quantity").cast("long").alias("px"))
    least = nuclei.select("sample_id", F.lit(40.0).alias("mean_area")).distinct()
    return compartments.cells(nuclei, cyto, mapping, {"r": (measured("O", F.col("o_orderkey")), measured("F", half))}, {"r": least})


@query(f"""WITH {CELLS} SELECT sample_id, nuc_id, cyto_id, nuclei_in_cell, round(n_size, 6) AS nuc_stain, round(CASE WHEN cyto_size IS NOT NULL THEN c_size END, 6) AS cyto_stain, round(CASE WHEN cyto_size IS NOT NULL THEN n_size+c_size END, 6) AS cell_stain,
 CASE WHEN cyto_size IS NOT NULL THEN n_count+c_count END AS particles, round(coalesce(n_size/nullif(n_count, 0), 0), 6) AS avg_nuc, round(CASE WHEN cyto_size IS NOT NULL THEN coalesce((n_size+c_size)/nullif(n_count+c_count, 0), 0) END, 6) AS avg_cell,
 round(n_size/nullif(nuc_size, 0), 6) AS cov_nuc, round(CASE WHEN cyto_size IS NOT NULL THEN c_size/nullif(cyto_size, 0) END, 6) AS cov_cyto, round(CASE WHEN cyto_size IS NOT NULL THEN (n_size+c_size)/nullif(nuc_size+cyto_size, 0) END, 6) AS cov_cell, n_size > 0 AS nuc_has, n_px+c_px >= 40 AS cell_has FROM j""")
def cells_wide(spark, d):
    c = cell_table(spark, d)
    p = "stain_r_"
    named = {"nuc_stain": "area_nuc_um2", "cyto_stain": "area_cyto_um2", "cell_stain": "area_cell_um2", "avg_nuc": "particle_avg_area_nuc_um2", "avg_cell": "particle_avg_area_cell_um2", "cov_nuc": "coverage_fraction_nuc", "cov_cyto": "coverage_fraction_cyto", "cov_cell": "coverage_fraction_cell"}
    return c.select("sample_id", "nuc_id", "cyto_id", "nuclei_in_cell", F.col(f"{p}particle_count_cell").alias("particles"), *[F.round(p + v, 6).alias(k) for k, v in named.items()], F.col(f"{p}nuc_has_stain").alias("nuc_has"), F.col(f"{p}cell_has_stain").alias("cell_has"))


@query(f"""WITH {CELLS} SELECT sample_id, nuc_id FROM j WHERE n_px+c_px >= 40""")
def cell_filter_contains(spark, d):
    return compartments.filtered(cell_table(spark, d), "r").select("sample_id", "nuc_id")


@query(f"""WITH {CELLS} SELECT sample_id, nuc_id FROM j WHERE NOT n_px+c_px >= 40""")
def cell_filter_not(spark, d):
    return compartments.filtered(cell_table(spark, d), "r", "does not contain").select("sample_id", "nuc_id")


@query("""SELECT sample_id, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS mono, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS poly, round(sum(CASE WHEN n > 1 THEN 1e0 ELSE 0 END)/count(*), 6) AS poly_fraction
 FROM (SELECT o_custkey AS sample_id, o_orderkey // 8 AS c, count(*) AS n FROM orders GROUP BY ALL) GROUP BY sample_id""")
def nucleation_counts(spark, d):
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.floor(F.col("o_orderkey") / 8).alias("cyto_id"))
    return metrics.nucleation(m).select("sample_id", "mono", "poly", F.round("poly_fraction", 6).alias("poly_fraction"))


METRICS = """m AS (SELECT o_custkey AS sample_id, CAST(count(*) AS DOUBLE) AS cell_count, avg(o_totalprice) AS price_mean, stddev_samp(o_totalprice)/sqrt(count(o_totalprice)) AS price_sem, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0 END) AS done_fraction FROM orders GROUP BY 1)"""


def order_metrics(spark, d) -> DataFrame:
    cells = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("done"))
    return metrics.cell_metrics(cells, ["sample_id"], ["price"], ["done"])


@query(f"""WITH {METRICS} SELECT sample_id, 'cell_count' AS metric, cell_count AS value FROM m UNION ALL SELECT sample_id, 'price_mean', round(price_mean, 6) FROM m UNION ALL SELECT sample_id, 'price_sem', round(price_sem, 6) FROM m UNION ALL SELECT sample_id, 'done_fraction', round(done_fraction, 6) FROM m""")
def sample_metrics_long(spark, d):
    return order_metrics(spark, d).withColumn("value", F.round("value", 6))


@query(f"""WITH {METRICS} SELECT sample_id, cell_count, round(price_mean, 6) AS price_mean, round(price_sem, 6) AS price_sem, round(done_fraction, 6) AS done_fraction FROM m""")
def sample_metrics_wide(spark, d):
    names = ["cell_count", "price_mean", "price_sem", "done_fraction"]
    wide = metrics.wide_metrics(order_metrics(spark, d), ["sample_id"], names)
    return wide.select("sample_id", *r6(*names))


@query("""WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier)
 SELECT * FROM t UNION ALL SELECT 'MEAN', round(avg(balance), 6), round(avg(nation), 6) FROM t UNION ALL SELECT 'SEM', round(stddev_samp(balance)/sqrt(count(balance)), 6), round(stddev_samp(nation)/sqrt(count(nation)), 6) FROM t""")
def mean_sem_rows(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return metrics.with_summary_rows(t, "id", True).select("id", *r6("balance", "nation"))


ROLLUP = """p AS (SELECT r_name || '/' || n_name AS path, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 l AS (SELECT 'all' AS level, value FROM p UNION ALL SELECT 'all/' || split_part(path, '/', 1), value FROM p UNION ALL SELECT 'all/' || path, value FROM p)"""


@query(f"""WITH {ROLLUP} SELECT level, 'balance' AS metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value)/sqrt(count(value)), 6) AS sem FROM l GROUP BY level""")
def folder_rollup(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    m = c.select(F.concat_ws("/", F.lit("all"), "r_name", "n_name").alias("path"), F.lit("balance").alias("metric"), F.col("c_acctbal").alias("value"))
    return metrics.folder_rollup(m).select("level", "metric", "n", *r6("mean", "sem"))


@query("""SELECT n_regionkey, n_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def nation_rollup(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


RATES = """r AS (SELECT c_custkey AS sample_id, 1e2*count(CASE WHEN o_orderstatus = 'P' THEN 1 END)/count(*) AS rate FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)"""


@query(f"""WITH {RATES}, a AS (SELECT *, median(rate) OVER () AS med, count(rate) OVER () AS k FROM r), b AS (SELECT *, median(abs(rate-med)) OVER () AS mad FROM a)
 SELECT sample_id, round(rate, 6) AS rate, round(CASE WHEN k >= 3 AND mad > 0 THEN med+3*1.4826e0*mad END, 6) AS "limit", coalesce(rate > CASE WHEN k >= 3 AND mad > 0 THEN med+3*1.4826e0*mad END, false) AS high FROM b""")
def batch_rate_flag(spark, d):
    rate = 100.0 * F.sum((F.col("o_orderstatus") == "P").cast("int")) / F.count("*")
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(rate.alias("rate"))
    return outliers.batch_flags(r).select("sample_id", *r6("rate", "limit"), "high")


@query("""WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
 SELECT c_nationkey, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer JOIN q USING (c_nationkey) WHERE c_acctbal BETWEEN q1-1.5e0*(q3-q1) AND q3+1.5e0*(q3-q1) GROUP BY ALL""")
def box_stats(spark, d):
    b = metrics.box(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal")
    return b.select("c_nationkey", *[F.round(n, 4).alias(n) for n in ("q1", "median", "q3")], "low", "high")


@query("""SELECT p_type AS dims, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, dims LIMIT 5""")
def dims_top(spark, d):
    return metrics.top_values(table(spark, d, "part").withColumnRenamed("p_type", "dims"), "dims", 5)


NUC = "nuc AS (SELECT sample_id, y, x, CAST(y // 4 * 2 + x // 4 AS BIGINT) + 1 AS nuc FROM flat WHERE v >= 150), cyt AS (SELECT sample_id, y, x, CAST(y // 2 AS BIGINT) + 1 AS cyto FROM flat WHERE v BETWEEN 128 AND 149)"


def layers(spark, d) -> tuple[DataFrame, DataFrame]:
    px = flat(spark, d)
    block = (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4) + 1).cast("long")
    nuclei = px.where("v >= 150").select(*segmentation.PLACE, block.alias("label"))
    cyto = px.where("v between 128 and 149").select(*segmentation.PLACE, (F.floor(F.col("y") / 2) + 1).cast("long").alias("label"))
    return nuclei, cyto


ADJ = f"""{PX}, {NUC}, o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy*dy+dx*dx <= 4),
 ring AS (SELECT DISTINCT sample_id, nuc, y+dy AS y, x+dx AS x FROM nuc, o), own AS (SELECT r.* FROM ring r WHERE NOT EXISTS (SELECT 1 FROM nuc n WHERE n.sample_id = r.sample_id AND n.nuc = r.nuc AND n.y = r.y AND n.x = r.x)),
 votes AS (SELECT sample_id, nuc, cyto, count(*) AS n FROM own JOIN cyt USING (sample_id, y, x) GROUP BY ALL),
 adj AS (SELECT sample_id, nuc AS nuc_id, cyto AS cyto_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, nuc ORDER BY n DESC, cyto) AS r FROM votes) WHERE r = 1)"""


@query(f"""WITH {ADJ} SELECT * FROM adj""")
def adjacency_majority(spark, d):
    return compartments.adjacent_cytoplasm(*layers(spark, d))


@query(f"""WITH {ADJ}, last AS (SELECT sample_id, cyto_id, max(nuc_id) AS cell_id FROM adj GROUP BY ALL), t AS (SELECT sample_id, y, x, nuc AS cell_id FROM nuc UNION ALL SELECT c.sample_id, y, x, cell_id FROM cyt c JOIN last l ON l.sample_id = c.sample_id AND l.cyto_id = c.cyto)
 SELECT sample_id, cell_id, count(*) AS px FROM t GROUP BY ALL""")
def cell_territories(spark, d):
    nuclei, cyto = layers(spark, d)
    t = compartments.territories(nuclei, cyto, compartments.adjacent_cytoplasm(nuclei, cyto))
    return t.groupBy("sample_id", "cell_id").agg(F.count("*").alias("px"))


def components_sql(name: str, mask: str, apart: str) -> str:
    """CTEs that label ``mask(sample_id, y, x)`` by the least place reachable; for WITH RECURSIVE."""
    return f"""p_{name} AS (SELECT *, y*8+x AS id FROM ({mask})), w_{name} AS (SELECT sample_id, id AS root, id FROM p_{name} UNION SELECT w.sample_id, w.root, b.id FROM w_{name} w JOIN p_{name} a ON a.sample_id = w.sample_id AND a.id = w.id JOIN p_{name} b ON b.sample_id = a.sample_id AND {apart}),
 {name} AS (SELECT p.sample_id, p.y, p.x, min(root) AS label FROM w_{name} w JOIN p_{name} p ON p.sample_id = w.sample_id AND p.id = w.id GROUP BY ALL)"""


EIGHT = "abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1"
FOUR = "abs(a.y-b.y)+abs(a.x-b.x) <= 1"
BAND = "SELECT sample_id, y, x FROM flat WHERE v >= 140"


@query(f"""WITH RECURSIVE {PX}, {components_sql('lab', BAND, EIGHT)} SELECT sample_id, CAST(label AS BIGINT) AS label, count(*) AS size FROM lab GROUP BY ALL""")
def connected_components(spark, d):
    labels = segmentation.components(flat(spark, d).where("v >= 140"), 2)
    return labels.groupBy("sample_id", "label").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {PX}, {components_sql('bg', "SELECT sample_id, y, x FROM flat WHERE NOT v BETWEEN 140 AND 255", FOUR)}, outside AS (SELECT DISTINCT sample_id, label FROM bg WHERE y IN (0, 7) OR x IN (0, 7)),
 filled AS ({BAND} UNION SELECT sample_id, y, x FROM bg WHERE (sample_id, label) NOT IN (SELECT (sample_id, label) FROM outside)), {components_sql('lab', "SELECT * FROM filled", EIGHT)},
 k AS (SELECT sample_id, label, count(*) AS size FROM lab GROUP BY ALL HAVING count(*) >= 3 AND min(y) >= 1 AND min(x) >= 1 AND max(y) < 7 AND max(x) < 7) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY label) AS label, size FROM k""")
def segment_objects(spark, d):
    labels = segmentation.segment(flat(spark, d), LOW, HIGH, 2, min_size=3, margin=1)
    return labels.groupBy("sample_id", "label").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {PX}, {components_sql('lab', BAND, EIGHT + " AND (a.y < 4) = (b.y < 4)")}, k AS (SELECT sample_id, CASE WHEN y < 4 THEN 1 ELSE 2 END AS region, count(*) AS stain_px, count(DISTINCT label) AS pieces FROM lab GROUP BY ALL),
 r AS (SELECT sample_id, CASE WHEN y < 4 THEN 1 ELSE 2 END AS region, count(*) AS region_px FROM flat GROUP BY ALL) SELECT sample_id, region, region_px, region_px*0.25e0 AS area, coalesce(stain_px, 0) AS stain_px, coalesce(stain_px, 0)*0.25e0 AS stain_area, coalesce(pieces, 0) AS pieces, round(coalesce(stain_px, 0)/CAST(region_px AS DOUBLE), 6) AS coverage FROM r LEFT JOIN k USING (sample_id, region)""")
def stain_by_region(spark, d):
    px = flat(spark, d)
    regions = px.select(*segmentation.PLACE, F.when(F.col("y") < 4, 1).otherwise(2).alias("label"))
    return compartments.stain_by_region(px.where("v >= 140"), regions, 0.25).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH RECURSIVE {PX}, {components_sql('lab', BAND, EIGHT)}, n AS (SELECT sample_id, label, y // 2 + 1 AS owner, count(*) AS n FROM lab WHERE x < 6 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, label ORDER BY n DESC, owner) AS r FROM n)
 SELECT l.sample_id, CAST(l.label AS BIGINT) AS label, count(*) AS size, CAST(any_value(owner) AS BIGINT) AS owner FROM lab l JOIN o ON o.sample_id = l.sample_id AND o.label = l.label AND r = 1 GROUP BY l.sample_id, l.label""")
def particle_owners(spark, d):
    px = flat(spark, d)
    territory = px.where("x < 6").select(*segmentation.PLACE, (F.floor(F.col("y") / 2) + 1).cast("long").alias("cell_id"))
    return compartments.particles(px.where("v >= 140"), territory)


@query(f"""WITH RECURSIVE {PX}, {components_sql('lab', BAND, EIGHT)} SELECT f.sample_id, coalesce(any_value(m), 0) AS mean_area FROM flat f LEFT JOIN (SELECT sample_id, count(*)/count(DISTINCT label) AS m FROM lab GROUP BY 1) USING (sample_id) GROUP BY 1""")
def mean_particle_area(spark, d):
    px = flat(spark, d)
    return compartments.mean_particle_area(segmentation.components(px.where("v >= 140"), 2), px)


@query(None)
def watershed_regions(spark, d):
    px = flat(spark, d)
    markers = px.where("(y = 1 and x = 1) or (y = 6 and x = 6)").select(*segmentation.PLACE, F.when(F.col("y") == 1, 1).otherwise(2).alias("label"))
    out = segmentation.flooded(markers, px.withColumn("e", F.col("v").cast("double")), "e")
    return out.groupBy("sample_id", "label").agg(F.count("*").alias("size"))


@query(None)
def doublet_parts(spark, d):
    px = flat(spark, d)
    out = segmentation.split_doublets(segmentation.components(px.where("v >= 120"), 1), px, 2)
    return out.groupBy("sample_id", "label", "part").agg(F.count("*").alias("size"))


@query(f"""WITH {PX}, on_ AS (SELECT * FROM flat WHERE v >= 120), off AS (SELECT * FROM flat WHERE v < 120) SELECT a.sample_id, a.y, a.x, CAST(min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS BIGINT) AS d2 FROM on_ a JOIN off b ON a.sample_id = b.sample_id GROUP BY ALL""")
def distance_transform(spark, d):
    px = flat(spark, d)
    out = segmentation.distance(px.where("v >= 120"), px)
    return out.where("d2 is not null").select("sample_id", "y", "x", "d2")


@query(f"""WITH {PX} SELECT a.sample_id, a.y, a.x, a.v FROM flat a JOIN flat b ON a.sample_id = b.sample_id AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL HAVING max(b.v) = a.v""")
def local_peaks(spark, d):
    return segmentation.peaks(flat(spark, d), 1, "v").select("sample_id", "y", "x", "v")


@query(f"""WITH {PX} SELECT sample_id, y, x, CAST(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) * 255 // (max(v) OVER w - min(v) OVER w) ELSE 0 END AS INT) AS grey FROM flat WINDOW w AS (PARTITION BY sample_id)""")
def display_normalised(spark, d):
    return display.normalised(flat(spark, d)).select("sample_id", "y", "x", "grey")


@query("""SELECT o_orderkey AS label, CAST(CASE WHEN o_orderkey = 0 THEN 0 ELSE o_orderkey % 255 + 1 END AS INT) AS colour FROM orders""")
def label_colours(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("label"), display.colour(F.col("o_orderkey")).alias("colour"))


@query("""WITH c AS (SELECT doc_id, unnest(range(length(text))) AS pos, text FROM documents WHERE length(text) > 0) SELECT doc_id AS sample_id, CAST(pos // 64 AS INT) AS y, count(*) AS n, CAST(sum(unicode(substr(text, CAST(pos + 1 AS INT), 1))) AS BIGINT) AS total FROM c GROUP BY ALL""")
def document_raster(spark, d):
    px = pixels.from_text(table(spark, d, "documents"), "doc_id", "text", 64)
    return px.groupBy("sample_id", "y").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("""SELECT s_suppkey AS sample_id, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 0 END, 0), nullif(s_nationkey/1e1, 0), 1e0) AS pixel_um, CASE WHEN s_suppkey % 3 = 0 THEN 'config' WHEN s_nationkey <> 0 THEN 'file' ELSE 'fallback' END AS source FROM supplier""")
def calibration_precedence(spark, d):
    s = table(spark, d, "supplier")
    configured, of_file = F.when(F.col("s_suppkey") % 3 == 0, 0.5).otherwise(0.0), F.col("s_nationkey") / 10
    return s.select(F.col("s_suppkey").alias("sample_id"), calibration.pixel_size(configured, of_file).alias("pixel_um"), calibration.source(configured, of_file).alias("source"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def sidecar_json(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cell_id, l_returnflag AS stain, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS label_id FROM lineitem""")
def particle_ids(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("stain"), *TIES)
    return metrics.numbered(rows, ["sample_id"], TIES, "stain").select("sample_id", "cell_id", "stain", "label_id")


@query(f"""WITH RECURSIVE {PX}, {components_sql('lab', BAND, EIGHT)}, o AS (SELECT sample_id, label, count(*) AS n FROM lab GROUP BY ALL), i AS (SELECT sample_id, count(*) AS image_px FROM flat GROUP BY ALL),
 k AS (SELECT sample_id, count(*) AS particle_count, sum(n)*0.25e0 AS total, avg(n)*0.25e0 AS mean, stddev_samp(n*0.25e0)/sqrt(count(*)) AS sem, sum(n) AS px FROM o GROUP BY ALL)
 SELECT i.sample_id, 'c0' AS stain, coalesce(particle_count, 0) AS particle_count, coalesce(total, 0) AS total, round(mean, 6) AS mean, round(sem, 6) AS sem, round(coalesce(CAST(px AS BIGINT), 0)/CAST(image_px AS DOUBLE), 6) AS coverage FROM i LEFT JOIN k USING (sample_id)""")
def particle_measures(spark, d):
    px = flat(spark, d)
    objects = segmentation.components(px.where("v >= 140"), 2).groupBy("sample_id", "label").agg(F.count("*").alias("n_px"))
    images = px.groupBy("sample_id", F.col("channel").alias("stain")).agg(F.count("*").alias("image_px"))
    out = metrics.particle_measures(objects.withColumns({"stain": F.lit("c0"), "size": F.col("n_px") * 0.25}), images, "size")
    return out.select("sample_id", "stain", "particle_count", "total", *r6("mean", "sem", "coverage"))


@query(f"""WITH {PX}, c AS (SELECT sample_id, 'c0' AS channel, v FROM flat UNION ALL SELECT sample_id, 'c1', 255 - v FROM flat)
 SELECT sample_id, channel, round(avg(v), 6) AS mean, CASE WHEN channel = 'c1' THEN round(100e0*avg(CASE WHEN v >= 150 THEN 1e0 ELSE 0 END), 6) END AS saturated_pct, CASE WHEN channel = 'c0' THEN 140e0 END AS threshold_min_used,
 CASE WHEN channel = 'c0' THEN 160e0 END AS threshold_max_used, CASE WHEN channel = 'c0' THEN round(100e0*avg(CASE WHEN v BETWEEN 140 AND 160 THEN 1e0 ELSE 0 END), 6) END AS in_band_pct FROM c GROUP BY sample_id, channel""")
def channel_qc_bands(spark, d):
    px = flat(spark, d)
    both = px.unionByName(px.withColumns({"channel": F.lit("c1"), "v": 255 - F.col("v")}))
    out = metrics.channel_qc_bands(both, {"c0": (140, 160)}, {"c1": 150})
    return out.select("sample_id", "channel", "threshold_min_used", "threshold_max_used", *r6("mean", "saturated_pct", "in_band_pct"))


BOTH = f"""{PX}, both_ AS (SELECT sample_id, y, x, 'c0' AS channel, v FROM flat UNION ALL SELECT sample_id, y, x, 'c1', 255 - v FROM flat)"""


def two_channels(spark, d) -> DataFrame:
    px = flat(spark, d)
    return px.unionByName(px.withColumns({"channel": F.lit("c1"), "v": 255 - F.col("v")}))


@query(f"""WITH {BOTH}, o AS (SELECT *, CASE WHEN y < 4 THEN 1 ELSE 2 END AS label FROM both_ WHERE x > 1)
 SELECT sample_id, label, round(avg(v) FILTER (channel = 'c0'), 6) AS c0_mean, CAST(sum(v) FILTER (channel = 'c0') AS BIGINT) AS c0_integrated, round(avg(v) FILTER (channel = 'c1'), 6) AS c1_mean,
 CAST(sum(v) FILTER (channel = 'c1') AS BIGINT) AS c1_integrated FROM o GROUP BY ALL""")
def channel_means(spark, d):
    objects = two_channels(spark, d).where("x > 1").withColumn("label", F.when(F.col("y") < 4, 1).otherwise(2))
    out = features.channel_means(objects, ["c0", "c1"])
    return out.select("sample_id", "label", "c0_integrated", "c1_integrated", *r6("c0_mean", "c1_mean"))


@query(f"""WITH {BOTH}, q AS (SELECT sample_id, channel, avg(v) AS mean, 1e2*avg(CASE WHEN v >= 180 THEN 1e0 ELSE 0 END) AS full_, 1e2*avg(CASE WHEN v BETWEEN 140 AND 160 THEN 1e0 ELSE 0 END) AS band FROM both_ GROUP BY ALL)
 SELECT sample_id, 'qc_' || channel || '_intensity_mean' AS metric, round(mean, 6) AS value FROM q UNION ALL SELECT sample_id, 'qc_' || channel || '_pct_saturated', round(CASE WHEN channel = 'c1' THEN full_ END, 6) FROM q
 UNION ALL SELECT sample_id, 'qc_c0_threshold_min_used', 140 FROM q WHERE channel = 'c0' UNION ALL SELECT sample_id, 'qc_c0_threshold_max_used', 160 FROM q WHERE channel = 'c0'
 UNION ALL SELECT sample_id, 'qc_c0_pct_in_threshold_band', round(band, 6) FROM q WHERE channel = 'c0'""")
def quality_metrics(spark, d):
    out = metrics.qc_rows(metrics.channel_qc_bands(two_channels(spark, d), {"c0": (140, 160)}, {"c1": 180}))
    return out.select("sample_id", "metric", *r6("value"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS balance FROM supplier""")
def summary_rows_stripped(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return metrics.without_summary_rows(metrics.with_summary_rows(t, "id", True), "id")


@query("""WITH v AS (SELECT vec_id % 10 AS sample_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
 u AS (SELECT sample_id, a/n AS x, b/n AS y, c/n AS z FROM (SELECT *, sqrt(a*a+b*b+c*c) AS n FROM v) WHERE n > 0),
 m AS (SELECT sample_id, count(*) AS k, 1.5e0*avg(x*x)-0.5e0 AS xx, 1.5e0*avg(y*y)-0.5e0 AS yy, 1.5e0*avg(z*z)-0.5e0 AS zz, 1.5e0*avg(x*y) AS xy, 1.5e0*avg(x*z) AS xz, 1.5e0*avg(y*z) AS yz FROM u GROUP BY 1),
 q AS (SELECT *, (xx+yy+zz)/3 AS q FROM m), p AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
 r AS (SELECT *, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz))/(2*p*p*p) AS r FROM p)
 SELECT sample_id, round(CASE WHEN k > 1 THEN q+2*p*cos(acos(least(greatest(r, -1e0), 1e0))/3) END, 5) AS "order" FROM r""")
def nematic_order(spark, d):
    part = lambda i: F.col("embedding")[i].cast("double")
    norm = F.sqrt(part(0) * part(0) + part(1) * part(1) + part(2) * part(2))
    directors = table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("sample_id"), *[F.when(norm > 0, part(i) / norm).alias(n) for i, n in enumerate(("nx", "ny", "nz"))])
    return spatial.nematic_order(directors, ["sample_id"]).select("sample_id", F.round("order", 5).alias("order"))


FILES = """files AS (SELECT '/run/n' || c_nationkey || CASE WHEN c_custkey % 5 = 0 THEN '/Analysis' ELSE '' END AS dir, 'c' || (c_custkey % 7) AS stem,
  CASE c_custkey % 4 WHEN 0 THEN 'tif' WHEN 1 THEN 'tiff' WHEN 2 THEN 'TIF' ELSE 'png' END AS suffix FROM customer),
 images AS (SELECT DISTINCT dir, stem, stem || '.' || suffix AS name, lower(suffix) AS ext FROM files WHERE suffix <> 'png')"""


def files(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    folder = F.concat(F.lit("/run/n"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 5 == 0, "/Analysis").otherwise(""))
    suffix = F.element_at(F.array(*map(F.lit, (".tif", ".tiff", ".TIF", ".png"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.concat(folder, F.lit("/c"), F.col("c_custkey") % 7, suffix).alias("path"))


@query(f"""WITH {FILES} SELECT dir, stem, name, ext FROM images QUALIFY row_number() OVER (PARTITION BY dir, stem ORDER BY ext <> 'tif', name) = 1""")
def image_channels(spark, d):
    return discovery.channels(files(spark, d)).select("dir", "stem", "name", "ext")


@query(f"""WITH {FILES} SELECT DISTINCT split_part(dir, '/', 3) AS sample_id, dir FROM images WHERE stem = 'c0' AND dir NOT LIKE '%/Analysis'""")
def folder_samples(spark, d):
    return discovery.samples(files(spark, d), Config(channel_roles={"c0": "nuclear"}))


@query(f"""WITH {FILES} SELECT DISTINCT stem AS sample_id, dir || '/' || stem AS dir FROM images WHERE dir NOT LIKE '%/Analysis'""")
def file_samples(spark, d):
    return discovery.samples(files(spark, d), Config(input_mode="file_per_sample")).select("sample_id", "dir")


HOLES = f"""box AS (SELECT sample_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM o GROUP BY 1), bgm AS (SELECT f.sample_id, f.y, f.x FROM flat f JOIN box USING (sample_id) WHERE f.y BETWEEN y0 AND y1 AND f.x BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.sample_id = f.sample_id AND o.y = f.y AND o.x = f.x)),
 {components_sql('bg', "SELECT * FROM bgm", FOUR)}, ou AS (SELECT DISTINCT b.sample_id, b.label FROM bg b JOIN box USING (sample_id) WHERE y IN (y0, y1) OR x IN (x0, x1)), hol AS (SELECT sample_id, y, x FROM bg WHERE (sample_id, label) NOT IN (SELECT (sample_id, label) FROM ou))"""


@query(f"""WITH RECURSIVE {PX}, o AS (SELECT sample_id, 1 AS label, y, x FROM flat WHERE v BETWEEN 140 AND 255), {HOLES}, {hull_sql('o')}, hx AS (SELECT sample_id, y, unnest(range(a, b+1)) AS x FROM hr_o),
 dm AS (SELECT sample_id, y, x FROM hx EXCEPT SELECT sample_id, y, x FROM o EXCEPT SELECT sample_id, y, x FROM hol), {components_sql('dc', "SELECT * FROM dm", EIGHT)},
 n AS (SELECT sample_id, count(DISTINCT label) AS n FROM dc GROUP BY 1), a AS (SELECT sample_id, count(*) AS area FROM o GROUP BY 1), h AS (SELECT sample_id, count(*) AS hull FROM hx GROUP BY 1)
 SELECT sample_id, hull AS area_convex, round(area/CAST(hull AS DOUBLE), 6) AS solidity, coalesce(n, 0) AS convexity_defects FROM h JOIN a USING (sample_id) LEFT JOIN n USING (sample_id)""")
def convexity(spark, d):
    band = flat(spark, d).where(features.in_band(F.col("v"), LOW, HIGH)).withColumn("label", F.lit(1))
    return hull.convexity(band).select("sample_id", "area_convex", *r6("solidity"), "convexity_defects")


@query(f"""WITH RECURSIVE {PX}, {components_sql('bk', "SELECT sample_id, y, x FROM flat WHERE NOT v BETWEEN 140 AND 255", FOUR)}, outside AS (SELECT DISTINCT sample_id, label FROM bk WHERE y IN (0, 7) OR x IN (0, 7)),
 filled AS ({BAND} UNION SELECT sample_id, y, x FROM bk WHERE (sample_id, label) NOT IN (SELECT (sample_id, label) FROM outside)), {components_sql('lab', "SELECT * FROM filled", EIGHT)},
 o AS (SELECT sample_id, label, y, x FROM lab WHERE (sample_id, label) IN (SELECT (sample_id, label) FROM lab GROUP BY sample_id, label HAVING count(*) >= 3)), {shape_sql('o')},
 d AS (SELECT sample_id, label, area, {SCORE.format(by='sample_id')} > 4.5e-1 AS twin FROM sh_o) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY twin, label) AS label, area AS size FROM d""")
def segment_doublets(spark, d):
    labels = doublets.segment(flat(spark, d), LOW, HIGH, 2, min_size=3, threshold=0.45)
    return labels.groupBy("sample_id", "label").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {PX}, {components_sql('pc', "SELECT sample_id, y, x FROM flat WHERE v BETWEEN 150 AND 255", EIGHT + " AND (a.y < 4) = (b.y < 4)")}, nu AS (SELECT sample_id, CASE WHEN y < 4 THEN 1 ELSE 2 END AS label, y, x FROM flat WHERE v BETWEEN 140 AND 255),
 st AS (SELECT sample_id, CASE WHEN y < 4 THEN 1 ELSE 2 END AS label, label AS piece, y, x FROM pc),
 pm AS (SELECT sample_id, label, piece, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM st GROUP BY ALL), pt AS (SELECT *, {ANGLE} AS theta FROM pm),
 pa AS (SELECT sample_id, label, count(*) AS n, CASE WHEN count(*) > 1 THEN sqrt(pow(avg(cos(2*theta)), 2) + pow(avg(sin(2*theta)), 2)) END AS al FROM pt GROUP BY ALL),
 nm AS (SELECT sample_id, label, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS a, var_pop(x) AS c, covar_pop(y, x) AS b FROM nu GROUP BY ALL), na AS (SELECT sample_id, label, cy, cx, {ANGLE} AS theta FROM nm),
 pr AS (SELECT sample_id, label, unnest(['major', 'minor']) AS axis, unnest([round((x-cx)*cos(theta)-(y-cy)*sin(theta), 9), round((y-cy)*cos(theta)+(x-cx)*sin(theta), 9)]) AS p FROM st JOIN na USING (sample_id, label)), {peaks_sql('pr', 'sample_id, label, axis')},
 e AS (SELECT sample_id, label, max(CASE WHEN axis = 'major' THEN n_peaks END) AS j, max(CASE WHEN axis = 'major' THEN frequency END) AS fj, max(CASE WHEN axis = 'minor' THEN n_peaks END) AS i, max(CASE WHEN axis = 'minor' THEN frequency END) AS fi FROM pk GROUP BY ALL)
 SELECT sample_id, label, coalesce(pa.n, 0) AS n_stain_particles, round(al, 6) AS particle_alignment, coalesce(j, 0) AS peak_count_major, round(fj/5e-1, 6) AS freq_major_axis, coalesce(i, 0) AS peak_count_minor, round(fi/5e-1, 6) AS freq_minor_axis FROM na LEFT JOIN pa USING (sample_id, label) LEFT JOIN e USING (sample_id, label)""")
def stain_spatial(spark, d):
    px = flat(spark, d)
    nuclei = px.where(features.in_band(F.col("v"), LOW, HIGH)).withColumn("label", F.when(F.col("y") < 4, 1).otherwise(2))
    out = spatial.stain_spatial(px.where(features.in_band(F.col("v"), CELL_LOW, HIGH)), nuclei, 0.5)
    return out.select("sample_id", "label", "n_stain_particles", *r6("particle_alignment"), "peak_count_major", *r6("freq_major_axis"), "peak_count_minor", *r6("freq_minor_axis"))


def top3_sql(name: str, source: str, keep: str) -> str:
    """CTE name(keep, zz ... yx, top): the largest eigenvalue of the moments of source."""
    return f"""{name}_q AS (SELECT *, (zz+yy+xx)/3 AS q FROM {source}), {name}_p AS (SELECT *, sqrt(((zz-q)*(zz-q)+(yy-q)*(yy-q)+(xx-q)*(xx-q)+2*(zy*zy+zx*zx+yx*yx))/6) AS p FROM {name}_q),
 {name} AS (SELECT {keep}, zz, yy, xx, zy, zx, yx, CASE WHEN p < 1e-12 THEN q ELSE q+2*p*cos(acos(least(greatest((((zz-q)/p)*(((yy-q)/p)*((xx-q)/p)-(yx/p)*(yx/p)) - (zy/p)*((zy/p)*((xx-q)/p)-(yx/p)*(zx/p)) + (zx/p)*((zy/p)*(yx/p)-((yy-q)/p)*(zx/p)))/2, -1e0), 1e0))/3) END AS top FROM {name}_p)"""


@query(f"""WITH {PZ}, m AS (SELECT sample_id, var_pop(z*2e0) AS zz, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(z*2e0, y) AS zy, covar_pop(z*2e0, x) AS zx, covar_pop(y, x) AS yx FROM stack WHERE v BETWEEN 120 AND 255 GROUP BY ALL),
 {top3_sql('e', 'm', 'sample_id')}, r AS (SELECT sample_id, [zz-top, zy, zx] AS a, [zy, yy-top, yx] AS b, [zx, yx, xx-top] AS c FROM e),
 k AS (SELECT sample_id, unnest([[a[2]*b[3]-a[3]*b[2], a[3]*b[1]-a[1]*b[3], a[1]*b[2]-a[2]*b[1]], [a[2]*c[3]-a[3]*c[2], a[3]*c[1]-a[1]*c[3], a[1]*c[2]-a[2]*c[1]], [b[2]*c[3]-b[3]*c[2], b[3]*c[1]-b[1]*c[3], b[1]*c[2]-b[2]*c[1]]]) AS n FROM r),
 u AS (SELECT sample_id, n, sqrt(n[1]*n[1]+n[2]*n[2]+n[3]*n[3]) AS l FROM k QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY l DESC) = 1),
 o AS (SELECT g.label, avg(n[1]*n[1]/l/l)*1.5-0.5 AS zz, avg(n[2]*n[2]/l/l)*1.5-0.5 AS yy, avg(n[3]*n[3]/l/l)*1.5-0.5 AS xx, avg(n[1]*n[2]/l/l)*1.5 AS zy, avg(n[1]*n[3]/l/l)*1.5 AS zx, avg(n[2]*n[3]/l/l)*1.5 AS yx, count(*) AS k FROM u JOIN embeddings g ON g.vec_id = u.sample_id GROUP BY ALL),
 {top3_sql('t', 'o', 'label, k')} SELECT label, round(CASE WHEN k > 1 THEN top END, 5) AS alignment FROM t""")
def stack_alignment(spark, d):
    band = stack(spark, d).where(features.in_band(F.col("v"), 120, HIGH)).withColumn("label", F.lit(1))
    scale = band.select("sample_id").distinct().withColumns({"px": F.lit(1.0), "pz": F.lit(2.0)})
    axes = spatial.axes(band, False, scale).drop("label").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label"), "sample_id")
    return spatial.order(axes, False, ("label",)).select("label", F.round("nuclear_alignment", 5).alias("alignment"))


@query(f"""WITH {PZ}, c AS (SELECT sample_id, z-dz AS cz, y-dy AS cy, x-dx AS cx, CAST(sum(1 << (dz*4+dy*2+dx)) AS INT) AS code FROM stack, (SELECT unnest([0, 1]) AS dz), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx) WHERE v BETWEEN 140 AND 255 GROUP BY ALL),
 t(code, u, w, n) AS (VALUES {', '.join(str(r) for r in surface.patterns())}), a AS (SELECT sample_id, sum(n*sqrt(u+w*4e0)/2*0.25e0) AS area FROM c LEFT JOIN t USING (code) GROUP BY 1), v AS (SELECT sample_id, count(*)*0.25e0 AS volume FROM stack WHERE v BETWEEN 140 AND 255 GROUP BY 1)
 SELECT sample_id, round(area, 5) AS surface_area, round(pow(pi(), 1e0/3)*pow(6*volume, 2e0/3)/area, 5) AS sphericity FROM a JOIN v USING (sample_id)""")
def surface_area(spark, d):
    band = stack(spark, d).where(features.in_band(F.col("v"), LOW, HIGH)).withColumn("label", F.lit(1))
    scale = band.select("sample_id").distinct().withColumns({"px": F.lit(0.5), "pz": F.lit(1.0)})
    both = surface.surface_area(band, scale).join(band.groupBy("sample_id").agg((F.count("*") * 0.25).alias("volume")), "sample_id")
    return both.select("sample_id", F.round("surface_area", 5).alias("surface_area"), F.round(surface.sphericity(F.col("volume"), F.col("surface_area")), 5).alias("sphericity"))


@query(f"""WITH RECURSIVE {PX}, o AS (SELECT sample_id, 1 AS label, y, x FROM flat WHERE v BETWEEN 125 AND 255), {HOLES}, fo AS (SELECT sample_id, y, x FROM o UNION SELECT * FROM hol),
 fv AS (SELECT fo.*, v FROM fo JOIN flat USING (sample_id, y, x)), b AS (SELECT sample_id, min(v) AS lo, max(v) AS hi, CAST(trunc(avg(v)) AS BIGINT) AS fill, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM fv GROUP BY 1),
 q AS (SELECT f.sample_id, f.y, f.x, CAST(floor((coalesce(fv.v, fill)-lo)/CAST(hi-lo AS DOUBLE)*255) AS BIGINT) AS g FROM flat f JOIN b ON b.sample_id = f.sample_id AND f.y BETWEEN y0 AND y1 AND f.x BETWEEN x0 AND x1 LEFT JOIN fv ON fv.sample_id = f.sample_id AND fv.y = f.y AND fv.x = f.x WHERE hi > lo AND y1 > y0 AND x1 > x0),
 ofs AS (SELECT * FROM (VALUES (0,0,1),(1,-1,1),(2,-1,0),(3,-1,-1)) AS t(k, dy, dx)), p AS (SELECT l.sample_id, k, l.g AS i, r.g AS j FROM q l, ofs, q r WHERE r.sample_id = l.sample_id AND r.y = l.y+dy AND r.x = l.x+dx),
 n AS (SELECT sample_id, k, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT sample_id, k, j, i FROM p) GROUP BY ALL),
 s AS (SELECT sample_id, k, CAST(sum(n) AS BIGINT) AS t, CAST(sum(n*(i-j)*(i-j)) AS BIGINT) AS c, sum(n/(1e0+(i-j)*(i-j))) AS h, CAST(sum(n*n) AS BIGINT) AS e FROM n GROUP BY ALL),
 x AS (SELECT sample_id, avg(c/CAST(t AS DOUBLE)) AS contrast, avg(h/t) AS homogeneity, avg(sqrt(CAST(e AS DOUBLE))/t) AS energy FROM s GROUP BY sample_id)
 SELECT sample_id, round(contrast, 3) AS contrast, round(homogeneity, 5) AS homogeneity, round(energy, 5) AS energy FROM b LEFT JOIN x USING (sample_id)""")
def object_texture(spark, d):
    px = flat(spark, d)
    t = features.object_texture(px.where(features.in_band(F.col("v"), 125, HIGH)).withColumn("label", F.lit(1)), px)
    return t.select("sample_id", F.round("contrast", 3).alias("contrast"), F.round("homogeneity", 5).alias("homogeneity"), F.round("energy", 5).alias("energy"))


@query("""WITH p AS (SELECT r_name || '/' || n_name AS path, c_acctbal, CAST(c_custkey AS DOUBLE) AS c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), l AS (SELECT 'all' AS level, * FROM p UNION ALL SELECT 'all/' || split_part(path, '/', 1), * FROM p UNION ALL SELECT 'all/' || path, * FROM p)
 SELECT level, 'c_acctbal' AS "column", count(c_acctbal) AS n, round(avg(c_acctbal), 5) AS mean FROM l GROUP BY level UNION ALL SELECT level, 'c_custkey', count(c_custkey), round(avg(c_custkey), 5) FROM l GROUP BY level""")
def pooled_folders(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select(F.concat_ws("/", F.lit("all"), "r_name", "n_name").alias("path"), "c_acctbal", "c_custkey")
    return metrics.pooled(rows, "path", ["c_acctbal", "c_custkey"]).withColumn("mean", F.round("mean", 5))
