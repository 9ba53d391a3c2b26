"""All queries of the layout operators, by name, each with DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import pagetext as T
from quirefold.operators import datasets as D
from quirefold.operators import evaluate as E
from quirefold.operators import masks, model, raster, taxonomy, vectorize
from quirefold.sources import carriers as S
from quirefold.sources import pagexml
from quirefold.streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The tables of quirefold.sources.carriers in DuckDB.
_R = "region_ AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey % 800 AS x, (l_suppkey * 37 + l_linenumber * 113) % 1200 AS y, CAST(20 + CAST(l_quantity AS INT) AS INT) AS w, CAST(10 + l_linenumber * 5 AS INT) AS h, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'marginalia' WHEN l_returnflag = 'N' THEN 'paragraph' WHEN l_returnflag = 'R' THEN 'heading' END AS rtype FROM lineitem)"
_P = "page_ AS (SELECT o_orderkey AS page_id, 1000 + o_custkey % 1000 AS w, 1400 + o_orderkey % 600 AS h FROM orders)"
_C = _R + ", custom_ AS (SELECT page_id, seq, 'readingOrder {index:' || seq || ';}' || CASE WHEN rtype IS NULL THEN '' ELSE ' structure {type:' || rtype || ';}' END AS custom FROM region_)"
_L = "line_ AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS BIGINT) AS x, CAST(floor(value) AS BIGINT) AS y FROM events)"
_Q = "request_ AS (SELECT event_id, user_id, ts AS queued_at, ts + to_seconds(event_id % 50) AS process_start, ts + to_seconds(event_id % 50 + event_id % 300) AS process_end, event_type AS status FROM events)"


def query(name: str, sql: str | None = None):
    """Registers a query under name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as four-cornered polygons."""
    r = S.box(spark, sf_dir)
    return r.select("page_id", "line", "x", "y", "w", "h", G.rectangle(F.col("x").cast("int"), F.col("y").cast("int"), F.col("w"), F.col("h")).alias("pts"))


_CORNERS = "x || ',' || y || ' ' || x || ',' || (y + h) || ' ' || (x + w) || ',' || (y + h) || ' ' || (x + w) || ',' || y"


def _text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).withColumn("text", G.point_text(F.col("pts")))


def _at(pts, k: int, axis: str):
    return F.element_at(pts, k)[axis]


def _corner_columns(pts, cast: str = "bigint"):
    return [_at(F.col(pts), k, a).cast(cast).alias(f"{a}{k}") for k in (1, 3) for a in ("x", "y")]


_B = "box_ AS (SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 800 AS x, (l_suppkey * 37 + l_linenumber * 113) % 1200 AS y, CAST(20 + CAST(l_quantity AS INT) AS INT) AS w, CAST(10 + l_linenumber * 5 AS INT) AS h FROM lineitem)"


# --- page model ---


@query("p06_points_parse", f"WITH {_B} SELECT page_id, line, CAST(x AS BIGINT) AS x1, CAST(y AS BIGINT) AS y1, CAST(x + w AS BIGINT) AS x3, CAST(y + h AS BIGINT) AS y3 FROM box_")
def p06(spark, sf_dir):
    return _text_boxes(spark, sf_dir).select("page_id", "line", G.points(F.col("text")).alias("p")).select("page_id", "line", *_corner_columns("p"))


@query("p07_points_format", f"WITH {_B} SELECT page_id, line, {_CORNERS} AS points FROM box_")
def p07(spark, sf_dir):
    return _text_boxes(spark, sf_dir).select("page_id", "line", F.col("text").alias("points"))


@query("p02_region_type", f"WITH {_C} SELECT page_id, seq, nullif(regexp_extract(custom, '^.*structure \\{{.*type:(.*);.*\\}}', 1), '') AS rtype FROM custom_")
def p02(spark, sf_dir):
    return S.custom(spark, sf_dir).select("page_id", "seq", T.region_type(F.col("custom")).alias("rtype"))


@query("p03_reading_order", f"WITH {_R} SELECT page_id, seq, CAST(seq AS INT) AS reading_order FROM region_")
def p03(spark, sf_dir):
    return S.custom(spark, sf_dir).select("page_id", "seq", T.reading_order(F.col("custom")).alias("reading_order"))


@query("p04_set_custom", f"WITH {_R} SELECT page_id, seq, CASE WHEN rtype IS NULL THEN 'readingOrder {{index:' || seq || ';}}' ELSE 'structure {{type:' || rtype || ';}}' END AS custom FROM region_")
def p04(spark, sf_dir):
    return S.region(spark, sf_dir).select("page_id", "seq", F.coalesce(T.type_custom(F.col("rtype")), T.order_custom(F.col("seq"))).alias("custom"))


@query("p05_element_id", "SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '_' || event_id END, 'None') AS id FROM events")
def p05(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return model.element_id(e.select("event_id", F.when(F.col("event_type") != "error", F.concat_ws("_", "event_type", "event_id")).alias("id")))


@query("p01_page_size", "SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 1400 + o_orderkey % 600 END AS h, CASE WHEN o_orderkey % 5 = 0 THEN 800 ELSE 1000 + o_custkey % 1000 END AS w FROM orders")
def p01(spark, sf_dir):
    p = S.page(spark, sf_dir).withColumn("override", F.when(F.col("page_id") % 5 == 0, F.struct(F.lit(1000).cast("long").alias("h"), F.lit(800).cast("long").alias("w"))))
    return model.page_size(p)


_DIM = "dim AS (SELECT * FROM (VALUES ('heading', 1), ('marginalia', 2)) AS t(rtype, class_id))"


def _dim(spark):
    return taxonomy.classes(spark, ["heading", "marginalia", "paragraph"], merged="heading:paragraph")


@query("p08_region_iter", f"WITH {_R} SELECT page_id, seq, CASE rtype WHEN 'heading' THEN 1 WHEN 'marginalia' THEN 2 ELSE 1 END AS class_id, {_CORNERS} AS points FROM region_ WHERE rtype IS NOT NULL")
def p08(spark, sf_dir):
    r = S.region(spark, sf_dir).select("page_id", "seq", "rtype", G.rectangle(F.col("x").cast("int"), F.col("y").cast("int"), F.col("w"), F.col("h")).alias("pts"))
    return model.class_regions(r, _dim(spark)).select("page_id", "seq", "class_id", G.point_text(F.col("pts")).alias("points"))


@query("p09_baseline_iter", f"WITH {_L}, g AS (SELECT user_id, (i - 1) // 4 AS line, list(x || ',' || y ORDER BY i) AS ps FROM line_ GROUP BY ALL) SELECT user_id, CAST(line AS BIGINT) AS line, CAST(greatest(len(ps), 2) AS INT) AS n_points, CASE WHEN len(ps) = 1 THEN ps[1] || ' ' || ps[1] ELSE array_to_string(ps, ' ') END AS points FROM g")
def p09(spark, sf_dir):
    line = S.polyline(spark, sf_dir).withColumn("line", F.floor((F.col("i") - 1) / 4).cast("long"))
    of = line.groupBy("user_id", "line").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("ps"))
    pts = of.select("user_id", "line", G.point_text(F.transform("ps", lambda p: F.struct(p["x"], p["y"]))).alias("points"))
    return model.baselines(pts).select("user_id", "line", F.size("pts").alias("n_points"), G.point_text(F.col("pts")).alias("points"))


@query("p12_zones", f"WITH {_R} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS idx, rtype, {_CORNERS} AS points FROM region_ WHERE rtype IN ('heading', 'paragraph')")
def p12(spark, sf_dir):
    r = S.region(spark, sf_dir).withColumn("pts", G.rectangle(F.col("x").cast("int"), F.col("y").cast("int"), F.col("w"), F.col("h")))
    z = model.zones(r, ["heading", "paragraph"])
    return z.select("page_id", F.col("idx").cast("long").alias("idx"), "rtype", G.point_text(F.col("pts")).alias("points"))


@query("p14_transcription", "SELECT key, text FROM (SELECT conv_id || '_' || role AS key, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def p14(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    return model.transcription(c.select(F.col("conv_id").alias("region_id"), F.col("role").alias("line_id"), F.col("turn").alias("place"), "text"))


@query("p16_class_ids", "SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS class_id FROM nation UNION ALL SELECT 'background', 0")
def p16(spark, sf_dir):
    names = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return taxonomy.class_ids(names)


@query("p17_merge_regions", "SELECT n.n_name AS name, CAST(p.class_id AS INT) AS class_id FROM nation n JOIN (SELECT n_regionkey, min(n_nationkey) + 1 AS class_id FROM nation GROUP BY n_regionkey) p USING (n_regionkey) UNION ALL SELECT 'background', 0")
def p17(spark, sf_dir):
    n = S.table(spark, sf_dir, "nation")
    parent = n.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("parent"))
    names = taxonomy.class_ids(n.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")))
    pairs = n.join(parent, "n_regionkey").filter("n_name <> parent").select("parent", F.col("n_name").alias("child"))
    return taxonomy.merged(names, pairs)


@query("p18_region_tags", "SELECT n_name AS name, CASE n_regionkey WHEN 0 THEN 'ImageRegion' WHEN 1 THEN 'TableRegion' ELSE 'TextRegion' END AS tag FROM nation UNION ALL SELECT 'full_page', 'TextRegion'")
def p18(spark, sf_dir):
    n = S.table(spark, sf_dir, "nation")
    given = n.filter("n_regionkey < 2").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "ImageRegion").otherwise("TableRegion").alias("tag"))
    return taxonomy.tags(n.select(F.col("n_name").alias("name")), given)


@query("p22_id2rgb", "SELECT l_orderkey AS id, l_orderkey * 977 % 256 AS r, (l_orderkey * 977 // 256) % 256 AS g, (l_orderkey * 977 // 65536) % 256 AS b FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def p22(spark, sf_dir):
    k = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return k.select("id", G.packed_id(F.col("id") * 977).alias("c")).select("id", "c.r", "c.g", "c.b")


@query("p19_stem_pairing", "WITH s AS (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages) SELECT a.page_id AS page_id, b.page_id AS other_id, stem FROM s a JOIN s b USING (stem) WHERE a.page_id < b.page_id")
def p19(spark, sf_dir):
    s = S.table(spark, sf_dir, "pages").select("page_id", T.stem(F.col("url")).alias("stem"))
    o = s.withColumnRenamed("page_id", "other_id")
    return s.join(o, "stem").filter("page_id < other_id").select("page_id", "other_id", "stem")


@query("p23_uuid_repair", "SELECT event_id, 'region_u' || event_id || '_1_a_' || CASE WHEN event_id % 3 = 0 THEN 'u' || event_id || '_2' ELSE '&lt;module ''os'' from ''x''>' END AS text FROM events")
def p23(spark, sf_dir):
    """Ids that were written as the name of a module, whatever its path, once or twice a text; other names stay."""
    path = F.concat(F.lit("&lt;module 'uuid' from '/opt/env"), (F.col("event_id") % 5).cast("string"), F.lit("/lib/uuid.py'>"))
    other = F.when(F.col("event_id") % 3 == 0, path).otherwise("&lt;module 'os' from 'x'>")
    e = S.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("region_"), path, F.lit("_a_"), other).alias("t"))
    return e.select("event_id", T.repaired_uuid(F.col("t"), F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("text"))


@query("s12_pagexml_roundtrip", f"WITH {_R}, {_P} SELECT p.page_id, p.w AS page_w, p.h AS page_h, r.seq, r.rtype, CAST(r.x AS BIGINT) AS x0, CAST(r.y AS BIGINT) AS y0, CAST(r.x + r.w AS BIGINT) AS x1, CAST(r.y + r.h AS BIGINT) AS y1 FROM page_ p JOIN region_ r USING (page_id)")
def s12(spark, sf_dir):
    """Pages are written as XML text, read again, and boxed."""
    r = S.region(spark, sf_dir).select("page_id", "seq", "rtype", G.rectangle(F.col("x").cast("int"), F.col("y").cast("int"), F.col("w"), F.col("h")).alias("pts"))
    text = pagexml.written(S.page(spark, sf_dir), r)
    got = pagexml.regions_of(pagexml.elements(text))
    b = G.box(F.col("pts"))
    return got.select("page_id", F.col("page_w").cast("long").alias("page_w"), F.col("page_h").cast("long").alias("page_h"), F.col("reading_order").cast("long").alias("seq"), "rtype", b.alias("b")).select("page_id", "page_w", "page_h", "seq", "rtype", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("s03_format_filter", "SELECT page_id, url FROM pages WHERE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]+)$', 1)) IN ('.html', '.com', '.org')")
def s03(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    return p.filter(T.suffix(F.regexp_replace("url", r"[?#].*$", "")).isin(".html", ".com", ".org")).select("page_id", "url")


@query("s04_natsort", "SELECT url, page_id, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(url), '(\\d+|[^\\d]+)', 1), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN '0' || length(CAST(length(regexp_replace(p, '^0+(\\d)', '\\1')) AS VARCHAR)) || length(regexp_replace(p, '^0+(\\d)', '\\1')) || regexp_replace(p, '^0+(\\d)', '\\1') ELSE p END), ''), page_id) AS place FROM pages")
def s04(spark, sf_dir):
    return D.placed(S.table(spark, sf_dir, "pages").select("url", "page_id", T.natural_key(F.col("url")).alias("k")), "k", "page_id").select("url", "page_id", "place")


# --- geometry ---


@query("g01_scale", f"WITH {_B} SELECT page_id, line, CAST(x * (511.0::DOUBLE / 1999.0) AS FLOAT) AS x1, CAST(y * (767.0::DOUBLE / 1499.0) AS FLOAT) AS y1, CAST((x + w) * (511.0::DOUBLE / 1999.0) AS FLOAT) AS x3, CAST((y + h) * (767.0::DOUBLE / 1499.0) AS FLOAT) AS y3 FROM box_")
def g01(spark, sf_dir):
    n = lambda v: F.lit(v)
    return _boxes(spark, sf_dir).select("page_id", "line", G.scaled(F.col("pts"), n(768), n(512), n(1500), n(2000)).alias("p")).select("page_id", "line", *_corner_columns("p", "float"))


@query("g02_bbox", f"WITH {_B} SELECT page_id, line, CAST(x AS BIGINT) AS x0, CAST(y AS BIGINT) AS y0, CAST(x + w AS BIGINT) AS x1, CAST(y + h AS BIGINT) AS y1 FROM box_")
def g02(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page_id", "line", G.box(F.col("pts")).alias("b")).select("page_id", "line", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("g03_bbox_center", f"WITH {_B} SELECT page_id, line, (x + x + w) / 2.0::DOUBLE AS cx, (y + y + h) / 2.0::DOUBLE AS cy, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM box_")
def g03(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("page_id", "line", G.centre_box(G.box(F.col("pts"))).alias("b"))
    return b.select("page_id", "line", F.col("b.cx").alias("cx"), F.col("b.cy").alias("cy"), F.col("b.w").cast("long").alias("w"), F.col("b.h").cast("long").alias("h"))


@query("g04_normalize", f"WITH {_B} SELECT page_id, line, CAST(x / 1999.0::DOUBLE AS FLOAT) AS x1, CAST(y / 1499.0::DOUBLE AS FLOAT) AS y1, CAST((x + w) / 1999.0::DOUBLE AS FLOAT) AS x3, CAST((y + h) / 1499.0::DOUBLE AS FLOAT) AS y3 FROM box_")
def g04(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page_id", "line", G.normalised(F.col("pts"), F.lit(1500), F.lit(2000)).alias("p")).select("page_id", "line", *_corner_columns("p", "float"))


_SEG = f"{_L}, seg AS (SELECT user_id, i, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM line_ WINDOW w AS (PARTITION BY user_id ORDER BY i))"
_PROBE = "probe AS (SELECT user_id, user_id * 7 % 1000 AS px, user_id * 13 % 60 AS py FROM (SELECT DISTINCT user_id FROM events))"
_DIST = "CASE WHEN (px-ax)*(bx-ax)+(py-ay)*(by_-ay) <= 0 THEN sqrt(CAST((px-ax)*(px-ax)+(py-ay)*(py-ay) AS DOUBLE)) WHEN (px-ax)*(bx-ax)+(py-ay)*(by_-ay) >= (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) THEN sqrt(CAST((px-bx)*(px-bx)+(py-by_)*(py-by_) AS DOUBLE)) ELSE CAST(abs((px-ax)*(by_-ay)-(py-ay)*(bx-ax)) AS DOUBLE) / sqrt(CAST((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS DOUBLE)) END"


def _segments(spark, sf_dir):
    """Segments of each user's line with the user's point (px, py)."""
    w = Window.partitionBy("user_id").orderBy("i")
    line = S.polyline(spark, sf_dir)
    seg = line.select("user_id", "i", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    return seg.filter("bx IS NOT NULL").select("*", (F.col("user_id") * 7 % 1000).alias("px"), (F.col("user_id") * 13 % 60).alias("py"))


def _six():
    return [F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]


@query("g05_segment_distance", f"WITH {_SEG}, {_PROBE} SELECT user_id, i, round({_DIST}, 6) AS d FROM seg JOIN probe USING (user_id) WHERE bx IS NOT NULL")
def g05(spark, sf_dir):
    return _segments(spark, sf_dir).select("user_id", "i", F.round(G.segment_distance(*_six()), 6).alias("d"))


@query("g06_nearest_segment", f"WITH {_SEG}, {_PROBE}, d AS (SELECT user_id, i, round({_DIST}, 6) AS d FROM seg JOIN probe USING (user_id) WHERE bx IS NOT NULL) SELECT user_id, i, d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, i) AS r FROM d) WHERE r = 1")
def g06(spark, sf_dir):
    d = _segments(spark, sf_dir).select("user_id", "i", F.round(G.segment_distance(*_six()), 6).alias("d"))
    return d.groupBy("user_id").agg(F.min(F.struct("d", "i")).alias("m")).select("user_id", "m.i", "m.d")


@query("g07_side", f"WITH {_SEG}, {_PROBE} SELECT user_id, i, CAST(sign((px-ax)*(by_-ay)-(py-ay)*(bx-ax)) AS INT) AS side FROM seg JOIN probe USING (user_id) WHERE bx IS NOT NULL")
def g07(spark, sf_dir):
    return _segments(spark, sf_dir).select("user_id", "i", F.signum(G.cross(*_six()).cast("double")).cast("int").alias("side"))


@query("g08_top_bottom", f"WITH {_SEG}, {_PROBE}, d AS (SELECT user_id, i, round({_DIST}, 6) AS d, (px-ax)*(by_-ay)-(py-ay)*(bx-ax) AS c FROM seg JOIN probe USING (user_id) WHERE bx IS NOT NULL) SELECT user_id, CASE WHEN c >= 0 THEN 1 ELSE 0 END AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, i) AS r FROM d) WHERE r = 1")
def g08(spark, sf_dir):
    return vectorize.top_or_bottom(_segments(spark, sf_dir), "user_id")


@query("g09_caps", f"WITH {_SEG}, {_PROBE}, d AS (SELECT user_id, i, round({_DIST}, 6) AS d, (px-ax)*(bx-ax)+(py-ay)*(by_-ay) AS t, (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS l FROM seg JOIN probe USING (user_id) WHERE bx IS NOT NULL), e AS (SELECT *, min(d) OVER (PARTITION BY user_id) AS md, min(i) FILTER (l > 0) OVER (PARTITION BY user_id) AS i0, max(i) FILTER (l > 0) OVER (PARTITION BY user_id) AS i1, sum(sqrt(CAST(l AS DOUBLE))) OVER (PARTITION BY user_id) AS total FROM d) SELECT user_id, max(CASE WHEN total >= 2 AND l > 0 AND d = md AND ((i = i0 AND t <= 0) OR (i = i1 AND t >= l)) THEN 1 ELSE 0 END) AS cap FROM e GROUP BY user_id")
def g09(spark, sf_dir):
    return vectorize.at_caps(_segments(spark, sf_dir), "user_id")


@query("g10_consecutive", f"WITH {_L}, b AS (SELECT user_id, i, y % 2 = 0 AS v FROM line_) SELECT user_id, i, coalesce(v AND lead(v) OVER (PARTITION BY user_id ORDER BY i), FALSE) AS both FROM b")
def g10(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    b = S.polyline(spark, sf_dir).select("user_id", "i", (F.col("y") % 2 == 0).alias("v"))
    return b.select("user_id", "i", F.coalesce(F.col("v") & F.lead("v").over(w), F.lit(False)).alias("both"))


_MEET = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"


@query("g11_rect_overlap", f"WITH {_R} SELECT a.page_id, a.seq AS seq_a, b.seq AS seq_b FROM region_ a JOIN region_ b ON a.page_id = b.page_id AND a.seq < b.seq AND {_MEET}")
def g11(spark, sf_dir):
    return vectorize.meeting(S.region(spark, sf_dir))


@query("g12_rect_union", f"WITH {_B} SELECT page_id, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x + w) - min(x) AS BIGINT) AS w, CAST(max(y + h) - min(y) AS BIGINT) AS h FROM box_ GROUP BY page_id")
def g12(spark, sf_dir):
    return vectorize.around(S.box(spark, sf_dir), "page_id")


@query("g14_output_shape", f"WITH {_P}, s AS (SELECT page_id, h, w, 1024.0::DOUBLE / least(h, w) AS a, 1024.0::DOUBLE / greatest(h, w) AS b FROM page_), t AS (SELECT page_id, h, w, b, h * a AS ha, w * a AS wa FROM s), u AS (SELECT *, CASE WHEN greatest(ha, wa) > 1600 THEN 1600.0::DOUBLE / greatest(ha, wa) ELSE 1.0::DOUBLE END AS m FROM t) SELECT page_id, CAST(floor(ha * m + 0.5) AS INT) AS short_h, CAST(floor(wa * m + 0.5) AS INT) AS short_w, CAST(floor(h * b + 0.5) AS INT) AS long_h, CAST(floor(w * b + 0.5) AS INT) AS long_w, CAST(floor(h * 0.5::DOUBLE + 0.5) AS INT) AS scale_h, CAST(floor(w * 0.5::DOUBLE + 0.5) AS INT) AS scale_w FROM u")
def g14(spark, sf_dir):
    h, w = F.col("h"), F.col("w")
    short, long, scale = G.size_by_edge(h, w, 1024, False, 1600), G.size_by_edge(h, w, 1024, True), G.size_by_scale(h, w, 0.5)
    return S.page(spark, sf_dir).select("page_id", short[0].alias("short_h"), short[1].alias("short_w"), long[0].alias("long_h"), long[1].alias("long_w"), scale[0].alias("scale_h"), scale[1].alias("scale_w"))


@query("g15_dpi", "SELECT p_partkey AS image, CAST(CASE WHEN p_partkey % 2 = 0 THEN 250 ELSE coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 10 END, 300) END AS INT) AS dpi FROM part")
def g15(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 10).alias("found"), (F.col("p_partkey") % 2 == 1).alias("auto"))
    return p.select("image", model.resolution(F.col("auto"), F.col("found"), 300, 250).cast("int").alias("dpi"))


_RGB = "rgb AS (SELECT p_partkey AS k, p_partkey % 256 AS r, p_partkey * 3 % 256 AS g, p_partkey * 7 % 256 AS b FROM part)"


@query("g16_color_distance", f"WITH {_RGB} SELECT k, (2 + ((r + 10) / 2.0::DOUBLE) / 256.0::DOUBLE) * ((r - 10) * (r - 10)) + ((g - 200) * (g - 200)) * 4 + (2 - (255 - (r + 10) / 2.0::DOUBLE) / 256.0::DOUBLE) * ((b - 90) * (b - 90)) AS d FROM rgb")
def g16(spark, sf_dir):
    k = F.col("p_partkey")
    return S.table(spark, sf_dir, "part").select(k.alias("k"), G.colour_distance((k % 256, k * 3 % 256, k * 7 % 256), (F.lit(10), F.lit(200), F.lit(90))).alias("d"))


@query("g19_rescale", "WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey AS k, round((p_retailprice - lo) * 255.0::DOUBLE / (hi - lo), 6) AS v FROM part, m")
def g19(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_retailprice")
    of = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.crossJoin(F.broadcast(of)).select("k", F.round(G.rescaled(F.col("p_retailprice"), F.col("lo"), F.col("hi"), 0.0, 255.0), 6).alias("v"))


@query("g20_round_up", "SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS v FROM events")
def g20(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select("event_id", G.rounded_up(F.col("value")).cast("long").alias("v"))


@query("g18_class_colors")
def g18(spark, sf_dir):
    """Classes with colours far from one another (2 classes: black and white)."""
    n = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return taxonomy.coloured(taxonomy.class_ids(n))


# --- coordinates under transforms ---


def _transformed(spark, sf_dir, f):
    p = S.page(spark, sf_dir).select("page_id", F.col("w").alias("pw"), F.col("h").alias("ph"))
    return _boxes(spark, sf_dir).join(p, "page_id").select("page_id", "line", f(F.col("pts"), F.col("ph"), F.col("pw")).alias("p"))


def _corner_sql(x, y, kind="BIGINT"):
    of = lambda e, a, b: e.replace("X", a).replace("Y", b)
    (x1, y1), (x3, y3) = [(of(x, a, b), of(y, a, b)) for a, b in (("(b.x)", "(b.y)"), ("(b.x + b.w)", "(b.y + b.h)"))]
    return f"WITH {_B}, {_P} SELECT b.page_id, b.line, CAST({x1} AS {kind}) AS x1, CAST({y1} AS {kind}) AS y1, CAST({x3} AS {kind}) AS x3, CAST({y3} AS {kind}) AS y3 FROM box_ b JOIN page_ p USING (page_id)"


@query("t01_resize_coords", _corner_sql("round(X * 512 / CAST(p.w AS DOUBLE), 6)", "round(Y * 768 / CAST(p.h AS DOUBLE), 6)", "DOUBLE"))
def t01(spark, sf_dir):
    t = _transformed(spark, sf_dir, lambda p, h, w: G.resized(p, F.lit(768), F.lit(512), h, w))
    return t.select("page_id", "line", *[F.round(_at(F.col("p"), k, a), 6).alias(f"{a}{k}") for k in (1, 3) for a in ("x", "y")])


@query("t02_hflip", _corner_sql("p.w - X", "Y"))
def t02(spark, sf_dir):
    return _transformed(spark, sf_dir, lambda p, h, w: G.flipped_x(p, w)).select("page_id", "line", *_corner_columns("p"))


@query("t03_vflip", _corner_sql("X", "p.h - Y"))
def t03(spark, sf_dir):
    return _transformed(spark, sf_dir, lambda p, h, w: G.flipped_y(p, h)).select("page_id", "line", *_corner_columns("p"))


@query("t05_affine", _corner_sql("X * 2.0::DOUBLE + Y * 0.5::DOUBLE + 10.0::DOUBLE", "X * -0.25::DOUBLE + Y * 1.5::DOUBLE + -3.0::DOUBLE", "DOUBLE"))
def t05(spark, sf_dir):
    return _transformed(spark, sf_dir, lambda p, h, w: G.affine(p, ((2.0, 0.5, 10.0), (-0.25, 1.5, -3.0)))).select("page_id", "line", *_corner_columns("p", "double"))


@query("t11_orientation", _corner_sql("CASE b.page_id % 4 WHEN 0 THEN X WHEN 1 THEN Y WHEN 2 THEN p.w - X ELSE p.h - Y END", "CASE b.page_id % 4 WHEN 0 THEN Y WHEN 1 THEN p.w - X WHEN 2 THEN p.h - Y ELSE X END"))
def t11(spark, sf_dir):
    return _transformed(spark, sf_dir, lambda p, h, w: G.turned(p, F.col("page_id") % 4, h, w)).select("page_id", "line", *_corner_columns("p"))


@query("t13_crop", f"WITH {_B} SELECT page_id, line, greatest(x, 100) - 100 AS x0, greatest(y, 200) - 200 AS y0, least(x + w, 600) - 100 AS x1, least(y + h, 900) - 200 AS y1 FROM box_ WHERE least(x + w, 600) > greatest(x, 100) AND least(y + h, 900) > greatest(y, 200)")
def t13(spark, sf_dir):
    b = S.box(spark, sf_dir)
    return vectorize.cropped(b, 100, 200, 500, 700).select("page_id", "line", "x0", "y0", "x1", "y1")


@query("t14_pad", _corner_sql("X + 13", "Y + 29"))
def t14(spark, sf_dir):
    return _transformed(spark, sf_dir, lambda p, h, w: G.shifted(p, F.lit(13), F.lit(29))).select("page_id", "line", *_corner_columns("p"))


@query("t20_random_apply", "SELECT doc_id, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) < 2147483648 AS applied FROM documents")
def t20(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", model.chance(F.col("doc_id"), 0.5, seed=7).alias("applied"))


@query("t29_class_share", f"WITH {_R}, c AS (SELECT page_id, coalesce(rtype, 'none') AS k, sum(w * h) AS a FROM region_ GROUP BY ALL) SELECT page_id, round(CAST(max(a) AS DOUBLE) / CAST(sum(a) AS DOUBLE), 6) AS share FROM c GROUP BY page_id")
def t29(spark, sf_dir):
    a = S.region(spark, sf_dir).groupBy("page_id", F.coalesce("rtype", F.lit("none")).alias("k")).agg(F.sum(F.col("w") * F.col("h")).alias("a"))
    return a.groupBy("page_id").agg(F.round(F.max("a").cast("double") / F.sum("a").cast("double"), 6).alias("share"))


# --- evaluation ---

_PAIR = "pair_ AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pred, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS gt FROM lineitem), m AS (SELECT pred, gt, count(*) AS n FROM pair_ GROUP BY ALL)"
_SUPPORT = _PAIR + ", s AS (SELECT c AS cls, CAST(coalesce(sum(n) FILTER (gt = c AND pred = c), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (gt = c), 0) AS BIGINT) AS pos_gt, CAST(coalesce(sum(n) FILTER (pred = c), 0) AS BIGINT) AS pos_pred FROM (SELECT CAST(unnest([0, 1, 2]) AS INT) AS c), m GROUP BY c)"
_SCORES = _SUPPORT + ", k AS (SELECT *, CASE WHEN pos_gt > 0 THEN 100.0::DOUBLE * tp / pos_gt END AS acc, CASE WHEN pos_gt > 0 AND pos_gt + pos_pred - tp > 0 THEN 100.0::DOUBLE * tp / (pos_gt + pos_pred - tp) END AS iou FROM s)"


def _pairs(spark, sf_dir):
    line = S.table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return line.select(F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("pred"), F.when(status == "O", 0).otherwise(1).alias("gt"))


@query("e01_confusion", f"WITH {_PAIR} SELECT * FROM m")
def e01(spark, sf_dir):
    return E.confusion(_pairs(spark, sf_dir))


@query("e02_ignored", "SELECT quality AS pred, CASE WHEN toxic = 1 THEN 2 ELSE toxic END AS gt, count(*) AS n FROM labels GROUP BY ALL")
def e02(spark, sf_dir):
    of = S.table(spark, sf_dir, "labels").select(F.col("quality").alias("pred"), E.with_ignored(F.col("toxic"), 1, 2).alias("gt"))
    return E.confusion(of)


@query("e04_support", f"WITH {_SUPPORT} SELECT * FROM s")
def e04(spark, sf_dir):
    return E.support(E.confusion(_pairs(spark, sf_dir)), 3)


@query("e01_class_iou", f"WITH {_SCORES} SELECT cls, tp, pos_gt, pos_pred, round(acc, 6) AS acc, round(iou, 6) AS iou FROM k")
def e05(spark, sf_dir):
    k = E.class_scores(E.support(E.confusion(_pairs(spark, sf_dir)), 3))
    return k.select("cls", "tp", "pos_gt", "pos_pred", F.round("acc", 6).alias("acc"), F.round("iou", 6).alias("iou"))


_LABEL = "pair_ AS (SELECT CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INT) AS pred, label AS gt FROM embeddings)"


@query("e05_iou", f"WITH {_LABEL} SELECT CAST(c AS INT) AS cls, round(CASE WHEN count(*) FILTER (gt = c) > 0 THEN 100.0::DOUBLE * count(*) FILTER (gt = c AND pred = c) / count(*) FILTER (gt = c OR pred = c) END, 6) AS iou FROM pair_, (SELECT unnest(range(10)) AS c) GROUP BY c")
def e05_iou(spark, sf_dir):
    """The class of each vector's greatest of ten numbers against its label."""
    first = F.slice("embedding", 1, 10)
    of = S.table(spark, sf_dir, "embeddings").select((F.array_position(first, F.array_max(first)) - 1).cast("int").alias("pred"), F.col("label").alias("gt"))
    return E.class_scores(E.support(E.confusion(of), 10)).select("cls", F.round("iou", 6).alias("iou"))


@query("e06_metrics", f"WITH {_SCORES} SELECT round(avg(iou), 6) AS miou, round(sum(iou * pos_gt) / sum(pos_gt), 6) AS fwiou, round(avg(acc), 6) AS macc, round(100.0::DOUBLE * sum(tp) / sum(pos_gt), 6) AS pacc FROM k")
def e06(spark, sf_dir):
    t = E.totals(E.class_scores(E.support(E.confusion(_pairs(spark, sf_dir)), 3)))
    return t.select(*[F.round(c, 6).alias(c) for c in ("miou", "fwiou", "macc", "pacc")])


@query("e03_merged_partials", "SELECT toxic AS pred, quality AS gt, count(*) AS n FROM labels GROUP BY ALL")
def e03(spark, sf_dir):
    """Matrices of parts, then their sum."""
    of = S.table(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("part"), F.col("toxic").alias("pred"), F.col("quality").alias("gt"))
    return E.confusion(E.confusion(of, "part").select("pred", "gt", "n"))


@query("e11_pair_check", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(a.n, 0) = 1 AND coalesce(b.n, 0) = 1 AS paired FROM (SELECT doc_id AS k, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id AS k, count(*) AS n FROM labels GROUP BY 1) b ON a.k = b.k")
def e11(spark, sf_dir):
    k = lambda n: S.table(spark, sf_dir, n).select(F.col("doc_id").alias("k"))
    return E.paired(k("documents"), k("labels"), "k")


@query("e14_confidence", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) FILTER (value IS NULL) AS n_missing FROM events GROUP BY event_type")
def e14(spark, sf_dir):
    return S.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count_if(F.col("value").isNull()).alias("n_missing"))


@query("e15_best_metric", "SELECT event_id, k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE k IS NOT NULL ORDER BY k DESC, event_id LIMIT 1")
def e15(spark, sf_dir):
    rows = pagexml.metric_lines(S.table(spark, sf_dir, "events"), "props", ["k"]).select("event_id", F.col("k").cast("int").alias("k"))
    return E.best_row(rows, "k", "event_id")


@query("e16_checkpoints", "WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) SELECT user_id, event_id, value FROM b WHERE m IS NULL OR value > m")
def e16(spark, sf_dir):
    return E.running_best(S.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", "user_id")


@query("e18_timing", "SELECT event_type AS label, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type")
def e18(spark, sf_dir):
    return S.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


# --- masks to shapes ---

_VECTOR = "z AS (SELECT vec_id, embedding AS e, label FROM embeddings), q AS (SELECT vec_id, label, list_transform(e, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(e) AS DOUBLE))) AS p, CAST(list_position(e, list_max(e)) - 1 AS INT) AS cls FROM z), c AS (SELECT vec_id, label, cls, (1.0::DOUBLE / list_sum(p) - 0.015625::DOUBLE) / 0.984375::DOUBLE AS confidence FROM q)"


def _classes(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", vectorize.class_and_confidence(F.col("embedding"), 64).alias("c")).select("vec_id", "label", "c.cls", "c.confidence")


@query("v01_softmax_argmax", f"WITH {_VECTOR} SELECT vec_id, cls, round(confidence, 6) AS confidence FROM c")
def v01(spark, sf_dir):
    return _classes(spark, sf_dir).select("vec_id", "cls", F.round("confidence", 6).alias("confidence"))


@query("v02_mean_confidence", f"WITH {_VECTOR} SELECT label, round(avg(confidence), 6) AS mean FROM c GROUP BY label")
def v02(spark, sf_dir):
    return _classes(spark, sf_dir).groupBy("label").agg(F.round(F.avg("confidence"), 6).alias("mean"))


@query("v05_components", f"WITH RECURSIVE {_R}, e AS (SELECT a.page_id, a.seq AS u, b.seq AS v FROM region_ a JOIN region_ b ON a.page_id = b.page_id AND a.seq <> b.seq AND {_MEET}), t AS (SELECT page_id, seq, seq AS root FROM region_ UNION SELECT t.page_id, e.v, t.root FROM t JOIN e ON e.page_id = t.page_id AND e.u = t.seq AND t.root < e.v) SELECT page_id, seq, min(root) AS root FROM t GROUP BY page_id, seq")
def v05(spark, sf_dir):
    return vectorize.components(S.region(spark, sf_dir))


@query("v07_baseline_sample", f"WITH {_L}, c AS (SELECT user_id, x, avg(y) AS y FROM line_ GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM c) SELECT user_id, x, round(y, 6) AS y FROM r WHERE k % 5 = 0 OR k = n - 1")
def v07(spark, sf_dir):
    return vectorize.column_means(S.polyline(spark, sf_dir), ["user_id"], 5).select("user_id", "x", F.round("y", 6).alias("y"))


@query("v14_boxes_to_regions", f"WITH {_P}, b AS (SELECT event_id, event_id % (SELECT count(*) FROM orders) AS page_id, (event_id % 97) / 97.0::DOUBLE AS cx, (event_id % 89) / 89.0::DOUBLE AS cy FROM events) SELECT event_id, CAST(floor((cx - 0.05::DOUBLE) * p.w + 0.5) AS BIGINT) AS x0, CAST(floor((cy - 0.025::DOUBLE) * p.h + 0.5) AS BIGINT) AS y0 FROM b JOIN page_ p USING (page_id)")
def v14(spark, sf_dir):
    p = S.page(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    b = S.table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("page_id"), ((F.col("event_id") % 97) / 97.0).alias("cx"), ((F.col("event_id") % 89) / 89.0).alias("cy"))
    at = lambda c, size, half: G.rounded_up((F.col(c) - half) * F.col(size)).cast("long")
    return b.join(p, "page_id").select("event_id", at("cx", "w", 0.05).alias("x0"), at("cy", "h", 0.025).alias("y0"))


@query("r07_disc", f"WITH {_L}, p AS (SELECT user_id, i, x, y FROM line_) SELECT user_id, i, y + dy AS y, x - CAST(floor(sqrt(CAST(25 - dy * dy AS DOUBLE))) AS BIGINT) AS x0, x + CAST(floor(sqrt(CAST(25 - dy * dy AS DOUBLE))) AS BIGINT) AS x1 FROM (SELECT *, unnest(range(-5, 6)) AS dy FROM p)")
def r07(spark, sf_dir):
    return raster.discs(S.polyline(spark, sf_dir), ["user_id", "i"], 5)


@query("r12_panoptic_ids", f"WITH {_R} SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY rtype, seq) AS id FROM region_ WHERE rtype IS NOT NULL")
def r12(spark, sf_dir):
    return raster.panoptic_ids(S.region(spark, sf_dir).filter("rtype IS NOT NULL"), "page_id", "rtype", "seq")


@query("r13_yolo_rows", f"WITH {_R}, {_P} SELECT r.page_id, r.seq, (CASE rtype WHEN 'marginalia' THEN 2 ELSE 1 END - 1) AS category, (r.x + r.w / 2.0::DOUBLE) / (p.w - 1) AS cx, (r.y + r.h / 2.0::DOUBLE) / (p.h - 1) AS cy FROM region_ r JOIN page_ p USING (page_id) WHERE rtype IS NOT NULL")
def r13(spark, sf_dir):
    p = S.page(spark, sf_dir).select("page_id", F.col("w").alias("pw"), F.col("h").alias("ph"))
    r = S.region(spark, sf_dir).join(F.broadcast(_dim(spark).select(F.col("name").alias("rtype"), "class_id")), "rtype").join(p, "page_id")
    return r.select("page_id", "seq", (F.col("class_id") - 1).alias("category"), ((F.col("x") + F.col("w") / 2) / (F.col("pw") - 1)).alias("cx"), ((F.col("y") + F.col("h") / 2) / (F.col("ph") - 1)).alias("cy"))


# --- data sets ---


@query("d01_region_histogram", f"WITH {_R} SELECT page_id, coalesce(rtype, 'None') AS rtype, count(*) AS n FROM region_ GROUP BY page_id, coalesce(rtype, 'None') UNION ALL SELECT page_id, NULL, count(*) FROM region_ GROUP BY page_id UNION ALL SELECT NULL, NULL, count(*) FROM region_")
def d01(spark, sf_dir):
    return D.histogram(S.region(spark, sf_dir).select("page_id", "rtype"))


@query("d02_remaining_pages", f"WITH {_R}, b AS (SELECT page_id, bool_or(rtype IS NULL OR rtype = 'heading') AS bad FROM region_ GROUP BY page_id) SELECT o_orderkey AS page_id, CASE WHEN bad IS NULL THEN 'empty' WHEN bad THEN 'bad' ELSE 'remaining' END AS state FROM orders LEFT JOIN b ON o_orderkey = page_id")
def d02(spark, sf_dir):
    return D.remaining(S.page(spark, sf_dir), S.region(spark, sf_dir), ["heading"])


_NAMES = "names_ AS (SELECT p_name AS name, p_brand AS dir FROM part)"


def _names(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("dir"))


@query("d03_duplicates", f"WITH {_NAMES} SELECT name, count(*) AS n, count(DISTINCT dir) AS n_places FROM names_ GROUP BY name HAVING count(*) > 1")
def d03(spark, sf_dir):
    return D.duplicates(_names(spark, sf_dir), "name", "dir")


@query("d03_shared_dirs", f"WITH {_NAMES}, u AS (SELECT DISTINCT name, dir FROM names_) SELECT x.dir AS a, y.dir AS b, count(*) AS n FROM u x JOIN u y ON x.name = y.name AND x.dir < y.dir GROUP BY ALL")
def d03b(spark, sf_dir):
    return D.shared_places(_names(spark, sf_dir), "name", "dir")


@query("d04_dup_stems", "WITH s AS (SELECT regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages) SELECT stem, count(*) AS n FROM s GROUP BY stem HAVING count(*) > 1")
def d04(spark, sf_dir):
    s = S.table(spark, sf_dir, "pages").select(T.stem(F.col("url")).alias("stem"))
    return s.groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1")


@query("d05_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM r")
def d05(spark, sf_dir):
    return D.split(S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("d06_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def d06(spark, sf_dir):
    return D.sample(S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("d12_incremental", f"WITH {_P}, done AS (SELECT page_id, w, CASE WHEN page_id % 3 = 0 THEN h + 1 ELSE h END AS h FROM page_ WHERE page_id % 2 = 0) SELECT p.page_id, p.w, p.h FROM page_ p LEFT JOIN done d ON p.page_id = d.page_id AND p.w = d.w AND p.h = d.h WHERE d.page_id IS NULL")
def d12(spark, sf_dir):
    p = S.page(spark, sf_dir)
    done = p.filter("page_id % 2 = 0").withColumn("h", F.when(F.col("page_id") % 3 == 0, F.col("h") + 1).otherwise(F.col("h")))
    return D.to_do(p, done, ["page_id", "w", "h"])


@query("d14_transpose", "SELECT doc_id % 50 AS g, list(doc_id ORDER BY doc_id)[1] AS first_id, CAST(count(*) AS INT) AS n FROM documents GROUP BY 1")
def d14(spark, sf_dir):
    """Rows to columns of lists by group, and the first of each."""
    of = S.table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 50).alias("g")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return of.select("g", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("n"))


@query("d15_class_metadata", "SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS class_id, TRUE AS thing FROM nation UNION ALL SELECT 'background', 0, FALSE")
def d15(spark, sf_dir):
    n = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return taxonomy.class_ids(n).withColumn("thing", F.col("class_id") > 0)


# --- requests ---


@query("q01_admission", f"WITH {_Q}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY queued_at, event_id) AS r FROM request_) SELECT event_id, CASE WHEN status = 'error' THEN 400 WHEN r > 64 THEN 429 WHEN event_id % 97 = 0 THEN 500 ELSE 202 END AS status_code FROM a")
def q01(spark, sf_dir):
    r = S.request(spark, sf_dir).withColumn("valid", F.col("status") != "error").withColumn("readable", F.col("event_id") % 97 != 0)
    return ledger.admitted(r, "user_id", 64).select("event_id", "status_code")


@query("q03_ledger_topk", f"WITH {_Q} SELECT user_id, event_id FROM (SELECT user_id, event_id, queued_at, row_number() OVER (PARTITION BY user_id ORDER BY queued_at DESC, event_id DESC) AS r FROM request_) WHERE r = 1 ORDER BY queued_at DESC, event_id DESC LIMIT 20")
def q03(spark, sf_dir):
    """The newest entry of each identifier, and of these the newest 20."""
    return ledger.newest(S.request(spark, sf_dir), "user_id", ["queued_at", "event_id"], 20).select("user_id", "event_id")


@query("q04_status_lookup", f"WITH {_Q}, k AS (SELECT unnest([1, 5, 7, 999999999]) AS id) SELECT CAST(k.id AS BIGINT) AS id, r.status, CASE WHEN r.event_id IS NULL THEN 404 ELSE 200 END AS code FROM k LEFT JOIN request_ r ON r.event_id = k.id")
def q04(spark, sf_dir):
    k = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 5, 7, 999999999)])).alias("id"))
    return ledger.looked_up(k, S.request(spark, sf_dir))


@query("q05_durations", f"WITH {_Q} SELECT event_id, CAST(event_id % 50 AS DOUBLE) AS queue_s, CAST(event_id % 300 AS DOUBLE) AS process_s, CAST(event_id % 50 + event_id % 300 AS DOUBLE) AS total_s FROM request_")
def q05(spark, sf_dir):
    return ledger.durations(S.request(spark, sf_dir)).select("event_id", "queue_s", "process_s", "total_s")


@query("q06_window_metrics", f"WITH {_Q} SELECT CAST((epoch_us(queued_at) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (status = 'error') AS n_error, CAST(sum(event_id % 300) AS DOUBLE) AS process_s FROM request_ GROUP BY 1")
def q06(spark, sf_dir):
    return ledger.hourly(ledger.durations(S.request(spark, sf_dir)))


@query("q06_session", f"WITH {_Q}, g AS (SELECT user_id, queued_at, sum(CASE WHEN queued_at < prior + INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY queued_at, event_id) AS s FROM (SELECT *, lag(queued_at) OVER (PARTITION BY user_id ORDER BY queued_at, event_id) AS prior FROM request_)) SELECT user_id, count(*) AS n, (epoch_us(max(queued_at)) - epoch_us(min(queued_at))) // 1000000 AS seconds FROM g GROUP BY user_id, s")
def q06_session(spark, sf_dir):
    """Sessions of a user's requests, apart by more than an hour, as a stream over the files would give them in complete mode."""
    return ledger.sessions(S.request(spark, sf_dir), "1 hour")


@query("q10_response", "SELECT event_id, '{\"identifier\":' || event_id || CASE WHEN event_type = 'error' THEN '' ELSE ',\"status\":\"' || event_type || '\"' END || '}' AS body FROM events")
def q10(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("identifier"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"), F.col("value").alias("internal"))
    return ledger.response(e, ["identifier", "status"], "event_id")


@query("s17_instances_json", f"WITH {_R}, i AS (SELECT page_id, seq, '{{\"bbox\":[' || x || '.0,' || y || '.0,' || (x + w) || '.0,' || (y + h) || '.0],\"bbox_mode\":0,\"category_id\":' || (CASE rtype WHEN 'marginalia' THEN 2 ELSE 1 END - 1) || ',\"segmentation\":[[' || x || '.0,' || y || '.0,' || x || '.0,' || (y + h) || '.0,' || (x + w) || '.0,' || (y + h) || '.0,' || (x + w) || '.0,' || y || '.0]],\"iscrowd\":false}}' AS t FROM region_ WHERE rtype IS NOT NULL) SELECT page_id, '[' || string_agg(t, ',' ORDER BY seq) || ']' AS instances FROM i GROUP BY page_id")
def s17(spark, sf_dir):
    """One JSON list of instances per page."""
    return raster.instances_json(S.region(spark, sf_dir).filter("rtype IS NOT NULL"), _dim(spark))


@query("r01_stroke")
def r01(spark, sf_dir):
    """Cells under the thick line of each user, whole, an hour and forty minutes a cell."""
    line = S.polyline(spark, sf_dir).withColumn("x", F.floor(F.col("x") / 100))
    most = line.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    ps = line.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")))).alias("ps"))
    shapes = ps.crossJoin(F.broadcast(most)).select(F.col("user_id").alias("page_id"), (F.col("my") + 3).cast("int").alias("h"), (F.col("mx") + 3).cast("int").alias("w"), F.lit("").alias("tag"), F.lit(1).alias("place"), F.lit("stroke").alias("kind"), F.lit(5.0).alias("size"), F.lit(1).alias("v"), F.transform("ps", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    return masks.cells_by_value(masks.painted(shapes)).select(F.col("page_id").alias("user_id"), "n")


from quirefold.plans import layouts  # noqa: E402, F401  adds its queries
