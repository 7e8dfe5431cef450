"""Queries of geometry, regions, page-level finders, scores and dates, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, mrz
from ..functions import geometry as G
from ..functions import validators as V
from ..operators import finders, metrics, page, regions
from ..sources import ingest
from ..sources.shared import spread_by
from .queries import _BOXES, _CANDIDATES, _SPANS, boxes_of, candidates_of, dealt, dealt_sql, query, spans_of

_IOU = "(greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0))"
_SIZE = "((x.r - x.l) * (x.b - x.t) + (y.r - y.l) * (y.b - y.t))"
_PAIR = f"{_BOXES} x JOIN {_BOXES} y ON x.page_id = y.page_id AND x.line_no <> y.line_no"


def _quad():
    return G.of_box(F.col("l"), F.col("t"), F.col("r"), F.col("b"))


@query(f"""SELECT page_id, line_no, abs(l * (t + k) - r * t + r * (b + k) - (r + k) * (t + k) + (r + k) * b - l * (b + k) + l * t - l * b) / 2.0 AS area, l::DOUBLE AS l, t::DOUBLE AS t, (r + k)::DOUBLE AS r, (b + k)::DOUBLE AS b,
 (2 * l + 2 * r + k) / 4.0 AS cx, round(least(sqrt((r - l) * (r - l) + k * k), sqrt(k * k + (b - t) * (b - t)), sqrt((r + k - l) * (r + k - l) + k * k), (b - t)), 6) AS short
 FROM (SELECT *, line_no AS k FROM {_BOXES})""")
def quad_measures(spark, sf_dir):
    x = boxes_of(spark, sf_dir).select("*", *[F.col(c).cast("double").alias(c + "d") for c in "ltrb"]).withColumn("k", F.col("line_no").cast("double"))
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    c = F.col
    q = F.array(p(c("ld"), c("td")), p(c("rd"), c("td") + c("k")), p(c("rd") + c("k"), c("bd") + c("k")), p(c("ld"), c("bd")))
    out = x.select("page_id", "line_no", q.alias("q")).withColumn("o", G.bounds(F.col("q")))
    return out.select("page_id", "line_no", G.area(F.col("q")).alias("area"), "o.*", G.center(F.col("q"))["x"].alias("cx"), F.round(G.short_edge(F.col("q")), 6).alias("short"))


@query(f"SELECT x.page_id, x.line_no, y.line_no AS other, round({_IOU} / ({_SIZE} - {_IOU})::DOUBLE, 6) AS iou FROM {_PAIR} WHERE x.line_no < y.line_no AND {_IOU} > 0")
def quad_iou(spark, sf_dir):
    own = boxes_of(spark, sf_dir).select("page_id", "line_no", _quad().alias("q"))
    pairs = own.join(own.select("page_id", F.col("line_no").alias("other"), F.col("q").alias("q2")), "page_id").where("line_no < other").where(G.may_meet(F.col("q"), F.col("q2")))
    return pairs.select("page_id", "line_no", "other", F.round(G.iou("q", "q2"), 6).alias("iou")).where("iou > 0")


@query(f"SELECT page_id, line_no, round((r - l + 6) * (b - t + 6)::DOUBLE, 3) AS area, round((r - l) * (b - t)::DOUBLE, 3) AS hull FROM {_BOXES}")
def quad_hulls(spark, sf_dir):
    own = boxes_of(spark, sf_dir).select("page_id", "line_no", _quad().alias("q"))
    middle = F.concat("q", F.array(G.center(F.col("q"))))
    out = own.select("page_id", "line_no", G.expanded("q", F.lit(3.0)).alias("e"), G.bounding_quad(middle).alias("h"))
    return out.select("page_id", "line_no", F.round(G.area(F.col("e")), 3).alias("area"), F.round(G.area(F.col("h")), 3).alias("hull"))


@query(f"SELECT DISTINCT x.page_id, x.line_no FROM {_PAIR} WHERE y.line_no % 2 = 0 AND (x.l + x.r) / 2.0 BETWEEN y.l AND y.r AND (x.t + x.b) / 2.0 BETWEEN y.t AND y.b")
def covered_glyphs(spark, sf_dir):
    x = boxes_of(spark, sf_dir)
    glyphs = x.where("line_no % 2 = 1").select("page_id", "line_no", ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"))
    even = page.covered_glyphs(glyphs, x.where("line_no % 2 = 0").select("page_id", _quad().alias("quad")))
    others = x.where("line_no % 2 = 0").select("page_id", "line_no", ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"))
    pairs = others.alias("g").join(x.where("line_no % 2 = 0").select("page_id", F.col("line_no").alias("k"), _quad().alias("quad")).alias("m"), "page_id").where("line_no <> k")
    return even.select("page_id", "line_no").union(pairs.where(G.contains(F.col("quad"), F.col("x"), F.col("y"))).select("page_id", "line_no").distinct())


@query(f"""WITH g AS (SELECT page_id, l % 3 AS line_no, line_no AS i, (l + r) / 2.0 AS x, (t + b) / 2.0 AS y, chr((64 + line_no)::INT) AS c FROM {_BOXES}),
h AS (SELECT g.page_id, m.line_no AS id, g.line_no, min(g.i) AS lo, max(g.i) AS hi FROM g JOIN {_BOXES} m ON g.page_id = m.page_id AND g.x BETWEEN m.l AND m.r AND g.y BETWEEN m.t AND m.b GROUP BY ALL),
p AS (SELECT g.page_id, id, g.line_no, string_agg(c, '' ORDER BY i) AS part FROM g JOIN h ON g.page_id = h.page_id AND g.line_no = h.line_no AND g.i BETWEEN lo AND hi GROUP BY ALL)
SELECT page_id, id, string_agg(part, ' / ' ORDER BY line_no) AS text FROM p GROUP BY ALL""")
def text_under_masks(spark, sf_dir):
    x = boxes_of(spark, sf_dir, by_page=True)
    glyphs = x.select("page_id", (F.col("l") % 3).alias("line_no"), F.col("line_no").alias("i"), ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"), F.char(F.lit(64) + F.col("line_no")).alias("c"))
    return page.text_under(glyphs, x.select("page_id", F.col("line_no").alias("id"), _quad().alias("quad")))


@query(f"""SELECT x.page_id * 10 + x.line_no AS touch_id, arg_max(y.line_no, y.line_no) AS id FROM {_BOXES} x LEFT JOIN {_BOXES} y ON x.page_id = y.page_id AND (x.l + 5) BETWEEN y.l AND y.r AND (x.t + 5) BETWEEN y.t AND y.b AND y.line_no <> 1 GROUP BY 1""")
def tapped_masks(spark, sf_dir):
    x = boxes_of(spark, sf_dir)
    touches = x.select((F.col("page_id") * 10 + F.col("line_no")).alias("touch_id"), "page_id", (F.col("l") + 5).alias("x"), (F.col("t") + 5).alias("y"))
    return page.tapped(touches, x.where("line_no <> 1").withColumn("id", F.col("line_no")).withColumn("draw", F.col("line_no")))


@query(f"SELECT x.page_id, x.line_no FROM {_BOXES} x WHERE x.line_no % 2 = 1 AND NOT EXISTS (SELECT 1 FROM {_BOXES} y WHERE y.line_no % 2 = 0 AND x.page_id = y.page_id AND {_IOU} > 0.1 * ({_SIZE} - {_IOU}))")
def dismissed_boxes(spark, sf_dir):
    x = boxes_of(spark, sf_dir)
    return page.dismissed(x.where("line_no % 2 = 1"), x.where("line_no % 2 = 0"), 0.1).select("page_id", "line_no")


@query(f"""SELECT page_id, id, source FROM {_CANDIDATES} WHERE source = 'MANUAL' OR page_id % 2 = 1 UNION ALL SELECT page_id, 'n' || id, source FROM {_CANDIDATES} WHERE page_id % 2 = 0 AND source <> 'MANUAL'""")
def rerun_plan(spark, sf_dir):
    plan = candidates_of(spark, sf_dir)
    again = plan.where("page_id % 2 = 0").withColumn("id", F.concat(F.lit("n"), "id"))
    return page.rerun(plan, again).select("page_id", "id", "source")


@query(f"""SELECT page_id, line_no, greatest(l - k, 0.0) AS l, greatest(t - 1.4 * k, 0.0) AS t, least(r + k, 600.0) AS r, least(b + k, 320.0) AS b FROM (SELECT *, least(r - l, b - t) * 0.18::DOUBLE AS k FROM {_BOXES})""")
def face_boxes(spark, sf_dir):
    own = boxes_of(spark, sf_dir).withColumns({"width": F.lit(600), "height": F.lit(320)})
    return regions.faces(own).select("page_id", "line_no", *"ltrb")


@query(f"""SELECT page_id, line_no, CASE line_no % 4 WHEN 1 THEN t WHEN 2 THEN 700 - r WHEN 3 THEN 700 - b ELSE l END AS l, CASE line_no % 4 WHEN 1 THEN 400 - r WHEN 2 THEN 400 - b WHEN 3 THEN l ELSE t END AS t,
 CASE line_no % 4 WHEN 1 THEN b WHEN 2 THEN 700 - l WHEN 3 THEN 700 - t ELSE r END AS r, CASE line_no % 4 WHEN 1 THEN 400 - l WHEN 2 THEN 400 - t WHEN 3 THEN r ELSE b END AS b FROM {_BOXES}""")
def unturned_boxes(spark, sf_dir):
    own = boxes_of(spark, sf_dir).withColumns({"width": F.lit(700), "height": F.lit(400), "turns": F.col("line_no")})
    return regions.unturned(own).select("page_id", "line_no", *"ltrb")


_CODES = f"""(SELECT *, line_no AS id, CASE WHEN line_no = 6 THEN 'ITF' ELSE 'QR_CODE' END AS format, line_no % 2 = 0 AS decoded, l % 3 = 0 AS printed FROM {_BOXES})"""
_BESIDE = """EXISTS (SELECT 1 FROM c d WHERE d.decoded AND d.page_id = u.page_id AND greatest(greatest(u.r - u.l, u.b - u.t), greatest(d.r - d.l, d.b - d.t)) <= 1.5 * least(greatest(u.r - u.l, u.b - u.t), greatest(d.r - d.l, d.b - d.t))
 AND greatest(greatest(u.l, d.l) - least(u.r, d.r), greatest(u.t, d.t) - least(u.b, d.b), 0) <= greatest(u.r - u.l, u.b - u.t, d.r - d.l, d.b - d.t))"""


def _codes_of(spark, sf_dir):
    x = boxes_of(spark, sf_dir)
    return x.select("*", F.col("line_no").alias("id"), F.when(F.col("line_no") == 6, "ITF").otherwise("QR_CODE").alias("format"), (F.col("line_no") % 2 == 0).alias("decoded"), (F.col("l") % 3 == 0).alias("printed"))


@query(f"""WITH c AS (SELECT * FROM {_CODES} WHERE format <> 'ITF') SELECT page_id, id, round(l - 3 - 0.02 * least(r - l, b - t)::DOUBLE, 6) AS l, CASE WHEN decoded THEN 0.98 ELSE 0.5 END::DOUBLE AS confidence FROM c u WHERE decoded OR {_BESIDE}""")
def codes_strict(spark, sf_dir):
    return regions.codes(_codes_of(spark, sf_dir)).select("page_id", "id", F.round("l", 6).alias("l"), "confidence")


@query(f"""WITH c AS (SELECT * FROM {_CODES} WHERE format <> 'ITF') SELECT page_id, id, decoded FROM c u WHERE decoded OR printed OR {_BESIDE}""")
def codes_loose(spark, sf_dir):
    return regions.codes(_codes_of(spark, sf_dir), strict=False).select("page_id", "id", "decoded")


@query(f"""SELECT page_id, unnest(kept).id AS id FROM (SELECT page_id, list_reduce(list({{'id': id, 'decoded': decoded, 'l': l, 't': t, 'r': r, 'b': b}} ORDER BY NOT decoded, (r - l) * (b - t) DESC, id),
 lambda a, x: CASE WHEN len(list_filter(a.k, lambda y: CASE WHEN y.decoded THEN {_IOU} > 0.5 * least((x.r - x.l) * (x.b - x.t), (y.r - y.l) * (y.b - y.t)) ELSE {_IOU} > 0.5 * ({_SIZE} - {_IOU}) END)) > 0 THEN a ELSE {{'k': list_append(a.k, x)}} END,
 {{'k': []::STRUCT(id BIGINT, decoded BOOLEAN, l BIGINT, t BIGINT, r BIGINT, b BIGINT)[]}}).k AS kept FROM (SELECT page_id, line_no::BIGINT AS id, decoded, l::BIGINT AS l, t::BIGINT AS t, r::BIGINT AS r, b::BIGINT AS b FROM {_CODES}) GROUP BY page_id)""")
def distinct_codes(spark, sf_dir):
    return regions.distinct_codes(_codes_of(spark, sf_dir)).select("page_id", F.col("id").cast("long").alias("id"))


@query("""WITH p AS (SELECT o_orderkey AS page_id, (o_orderkey % 900 + 100)::INT AS height FROM orders), s AS (SELECT page_id, height, unnest(list_sort(list_distinct(list_append(range(0, greatest(height - 256, 0) + 1, 192), greatest(height - 256, 0))))) AS top FROM p)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY top) - 1)::INT AS k, top::INT AS top, least(top + 256, height)::INT AS bottom FROM s""")
def sliding_bands(spark, sf_dir):
    pages = ingest.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 900 + 100).cast("int").alias("height"))
    return regions.bands(pages)


@query(f"SELECT page_id, line_no, t + (line_no % 3) * 500 AS t, b + (line_no % 3) * 500 AS b FROM {_BOXES}")
def merged_tiles(spark, sf_dir):
    return regions.merged_tiles(boxes_of(spark, sf_dir).withColumn("tile", F.col("line_no") % 3), 500).select("page_id", "line_no", "t", "b")


@query("""WITH p AS (SELECT n_nationkey AS page_id, 300 + 40 * n_nationkey AS w, 900 - 20 * n_nationkey AS h FROM nation), s AS (SELECT *, ceil(sqrt(w * w + h * h) / 2 / 120)::INT AS nr, ceil(sqrt(w * w + h * h) / 2 / 200)::INT + 1 AS nc FROM p),
g AS (SELECT page_id, w, h, nc, unnest(range(-nr, nr + 1)) AS "row" FROM s), k AS (SELECT *, unnest(range(-nc, nc + 1)) AS col FROM g)
SELECT page_id, "row"::INT AS "row", col::INT AS col, w / 2.0 + col * 200 + CASE WHEN "row" % 2 <> 0 THEN 100.0 ELSE 0 END AS x, h / 2.0 + "row" * 120 AS y FROM k""")
def watermark_grid(spark, sf_dir):
    k = F.col("n_nationkey")
    pages = ingest.table(spark, sf_dir, "nation").select(k.alias("page_id"), (300 + 40 * k).alias("width"), (900 - 20 * k).alias("height"))
    return regions.watermark_grid(pages, 200, 120)


@query(f"""WITH p AS (SELECT DISTINCT page_id, 3000 + page_id % 9 * 1000 AS w FROM {_BOXES}), s AS (SELECT page_id, greatest(ceil(sqrt(w * 6000 / 32000000.0)), 1)::INT AS down FROM p)
SELECT page_id, line_no, down, round(l / (0.5 * down), 6) AS l, round(b / (0.5 * down), 6) AS b FROM {_BOXES} JOIN s USING (page_id)""")
def export_plan(spark, sf_dir):
    x = boxes_of(spark, sf_dir)
    pages = x.select("page_id").distinct().select("page_id", (3000 + F.col("page_id") % 9 * 1000).alias("width"), F.lit(6000).alias("height"), F.lit(0.5).alias("analysis_scale"))
    return regions.export_plan(x, pages).select("page_id", "line_no", "down", F.round("l", 6).alias("l"), F.round("b", 6).alias("b"))


_PLACED = f"(SELECT s.page_id, s.line_no, s.kind, s.id, s.start, s.\"end\", x.l, x.t, x.r, x.b FROM (SELECT l_orderkey AS page_id, l_linenumber AS line_no, l_returnflag AS kind, l_linenumber AS id, l_partkey % 40 AS start, l_partkey % 40 + 5 AS \"end\" FROM lineitem) s JOIN {_BOXES} x ON s.page_id = x.page_id AND s.line_no = x.line_no)"
_LOW = "least(g.b - g.t, a.b - a.t)"


@query(f"""SELECT g.page_id, g.line_no, g.start FROM {_PLACED} g WHERE g.kind = 'N' AND EXISTS (SELECT 1 FROM {_PLACED} a WHERE a.kind = 'A' AND a.page_id = g.page_id AND (
 (g.line_no = a.line_no AND NOT (g.start < a."end" AND a.start < g."end")) OR (g.line_no <> a.line_no AND (least(g.b, a.b) - greatest(g.t, a.t) >= 0.5 * {_LOW}
 OR (greatest(greatest(g.t, a.t) - least(g.b, a.b), 0) <= 1.5 * {_LOW} AND greatest(greatest(g.l, a.l) - least(g.r, a.r), 0) <= 2 * {_LOW})))))""")
def near_anchors(spark, sf_dir):
    s = ingest.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + 5).alias("end"))
    placed = s.join(boxes_of(spark, sf_dir), ["page_id", "line_no"])
    return page.near_anchors(placed.where("kind = 'N'"), placed.where("kind = 'A'")).select("page_id", "line_no", "start")


@query(f"""WITH b AS (SELECT page_id, line_no, l % 60 AS l, t % 90 AS t, l % 60 + r - l AS r, t % 90 + 20 AS b FROM {_BOXES}),
a AS (SELECT page_id, line_no AS cur, next_no FROM (SELECT x.page_id, x.line_no, y.line_no AS next_no, row_number() OVER (PARTITION BY x.page_id, x.line_no ORDER BY y.t, abs(y.l - x.l), y.line_no) AS n
  FROM b x JOIN b y ON x.page_id = y.page_id AND x.line_no <> y.line_no WHERE y.t >= x.b - 10 AND y.t > x.t AND y.t - x.b <= 20 AND abs(y.l - x.l) <= 20) WHERE n = 1)
SELECT page_id, cur AS line_no, 1 AS step, next_no FROM a UNION ALL SELECT x.page_id, x.cur, 2, y.next_no FROM a x JOIN a y ON x.page_id = y.page_id AND x.next_no = y.cur
UNION ALL SELECT x.page_id, x.cur, 3, z.next_no FROM a x JOIN a y ON x.page_id = y.page_id AND x.next_no = y.cur JOIN a z ON y.page_id = z.page_id AND y.next_no = z.cur""")
def following_lines(spark, sf_dir):
    x = boxes_of(spark, sf_dir)
    near = x.select("page_id", "line_no", (F.col("l") % 60).alias("l"), (F.col("t") % 90).alias("t"), (F.col("l") % 60 + F.col("r") - F.col("l")).alias("r"), (F.col("t") % 90 + 20).alias("b"))
    return page.following_lines(near, near)


_WORDED = f"(SELECT *, CASE line_no % 3 WHEN 0 THEN 'order no' WHEN 1 THEN '12345678' ELSE 'plain' END AS text FROM {_BOXES})"


@query(f"""WITH x AS (SELECT * FROM {_WORDED}), lft AS (SELECT x.page_id, x.line_no, y.text, row_number() OVER (PARTITION BY x.page_id, x.line_no ORDER BY x.l - y.r, y.line_no) AS n FROM x JOIN x y ON x.page_id = y.page_id AND x.line_no <> y.line_no
  WHERE least(x.b, y.b) - greatest(x.t, y.t) >= 0.5 * least(x.b - x.t, y.b - y.t) AND y.r <= x.l AND x.l - y.r <= 10 * (x.b - x.t)),
abv AS (SELECT x.page_id, x.line_no, y.text, row_number() OVER (PARTITION BY x.page_id, x.line_no ORDER BY x.t - y.b, y.line_no) AS n FROM x JOIN x y ON x.page_id = y.page_id AND x.line_no <> y.line_no
  WHERE y.b <= x.t AND x.t - y.b <= 1.5 * (x.b - x.t) AND least(x.r, y.r) > greatest(x.l, y.l)),
bad AS (SELECT page_id, line_no FROM lft WHERE n = 1 AND text LIKE 'order%' UNION SELECT page_id, line_no FROM abv WHERE n = 1 AND text LIKE 'order%')
SELECT page_id, line_no FROM x WHERE text = '12345678' AND (page_id, line_no) NOT IN (SELECT (page_id, line_no) FROM bad)""")
def not_order_numbers(spark, sf_dir):
    x = boxes_of(spark, sf_dir).withColumn("text", F.when(F.col("line_no") % 3 == 0, "order no").when(F.col("line_no") % 3 == 1, "12345678").otherwise("plain"))
    return page.not_order_numbers(x.where("text = '12345678'").select("page_id", "line_no"), x, "order")


_TALLY = f"(SELECT * FROM {_CANDIDATES})"


@query(f"""WITH f AS (SELECT * FROM {_TALLY} WHERE line_no % 2 = 0), t AS (SELECT * FROM {_TALLY} WHERE line_no % 2 = 1),
p AS (SELECT y.page_id, y.kind, {_IOU} / ({_SIZE} - {_IOU}) AS o, y.id AS ti, x.id AS fi FROM f x JOIN t y ON x.page_id = y.page_id AND x.kind = y.kind WHERE {_IOU} >= 0.5 * ({_SIZE} - {_IOU}) OR {_IOU} >= 0.7 * least((x.r - x.l) * (x.b - x.t), (y.r - y.l) * (y.b - y.t))),
h AS (SELECT page_id, kind, len(list_reduce(list({{'t': ti, 'f': fi}} ORDER BY o DESC, ti, fi), lambda a, z: CASE WHEN len(list_filter(a.k, lambda w: w.t = z.t OR w.f = z.f)) > 0 THEN a ELSE {{'k': list_append(a.k, z)}} END, {{'k': []::STRUCT(t VARCHAR, f VARCHAR)[]}}).k) AS hit FROM p GROUP BY ALL),
n AS (SELECT page_id, kind, count(*) FILTER (line_no % 2 = 1) AS wanted, count(*) FILTER (line_no % 2 = 0) AS all_found FROM {_TALLY} GROUP BY ALL)
SELECT n.page_id, n.kind, wanted, coalesce(hit, 0) AS hit, all_found - coalesce(hit, 0) AS extra FROM n LEFT JOIN h ON n.page_id = h.page_id AND n.kind = h.kind""")
def one_to_one_tally(spark, sf_dir):
    x = candidates_of(spark, sf_dir)
    odd = F.substring("id", 2, 9).cast("int") % 2
    return metrics.tally(x.where(odd == 0), x.where(odd == 1))


@query(f"""WITH o AS (SELECT x.page_id, x.line_no, y.line_no AS other, y.line_no % 5 / 5.0 AS c, row_number() OVER (PARTITION BY x.page_id, x.line_no ORDER BY {_IOU} / ({_SIZE} - {_IOU})::DOUBLE DESC, y.line_no) AS n FROM {_PAIR} WHERE x.line_no % 2 = 0 AND y.line_no % 2 = 1 AND {_IOU} >= 0.1 * ({_SIZE} - {_IOU}))
SELECT x.page_id, x.line_no, CASE WHEN o.c > x.line_no % 5 / 5.0 THEN 'o' || o.other ELSE 'x' || x.line_no END AS text FROM {_BOXES} x LEFT JOIN o ON x.page_id = o.page_id AND x.line_no = o.line_no AND o.n = 1 WHERE x.line_no % 2 = 0""")
def ensemble_text(spark, sf_dir):
    x = boxes_of(spark, sf_dir).withColumn("confidence", F.col("line_no") % 5 / 5.0)
    one = x.where("line_no % 2 = 0").withColumn("text", F.concat(F.lit("x"), "line_no"))
    return metrics.ensemble(one, x.where("line_no % 2 = 1").withColumn("text", F.concat(F.lit("o"), "line_no")), 0.1).select("page_id", "line_no", "text")


@query(f"""WITH s AS (SELECT page_id, line_no, kind, start, max("end") AS "end" FROM {_SPANS} GROUP BY page_id, line_no, kind, start), m AS (SELECT *, max("end") OVER (PARTITION BY page_id, line_no, kind ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN start - reach <= 0 OR (start - reach = 1 AND reach % 2 = 0) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, line_no, kind ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT page_id, line_no, kind, min(start) AS start, max("end") AS "end" FROM g GROUP BY page_id, line_no, kind, run""")
def joined_model_spans(spark, sf_dir):
    """Texts of the form ' a a a': a blank at every even place."""
    spans = spans_of(spark, sf_dir)
    lines = spans.select("page_id", "line_no").distinct().withColumn("text", F.repeat(F.lit(" a"), F.lit(60)))
    return metrics.joined_spans(spans.groupBy("page_id", "line_no", "kind", "start").agg(F.max("end").alias("end")), lines)


_SIGNED = (("【Shop】 your code 1234", 12, 16, True), ("【Shop】 your code 1234", 1, 5, False), ("call Bob [Shop Inc]", 5, 8, True), ("call Bob [Shop Inc]", 10, 14, False), ("no [mark] inside", 4, 8, True))


@query(f"SELECT page_id, s AS start, e AS \"end\" FROM {dealt_sql(_SIGNED, 't, s, e, ok')} WHERE ok")
def signature_hits(spark, sf_dir):
    """A hit in a line for each customer, within a signature or not."""
    both = dealt(spark, sf_dir, [x[:3] for x in _SIGNED], "text string, start int, end int").withColumn("line_no", F.lit(0))
    return page.signature_free(both.select("page_id", "line_no", "start", "end"), both.select("page_id", "line_no", "text")).select("page_id", "start", "end")


_QUOTES = (("PERSON_NAME", "Vera Lindqvist", True), ("PERSON_NAME", "妈妈", False), ("PERSON_NAME", "room 12", False), ("PHONE", "555 2671", True), ("PHONE", "none", False), ("EMAIL", "a@b.c", True), ("EMAIL", "a.b", False), ("PAYMENT_CARD", "4111", True), ("PAYMENT_CARD", "41", False), ("POSTAL_ADDRESS", "1 Road", True), ("OTHER", "x", False))


@query(f"SELECT page_id, kind, quote, ok FROM {dealt_sql(_QUOTES, 'kind, quote, ok')}")
def plausible_quotes(spark, sf_dir):
    """A quote for each customer, of the shape of its kind or not."""
    return dealt(spark, sf_dir, [x[:2] for x in _QUOTES], "kind string, quote string").select("page_id", "kind", "quote", page.plausible(F.col("kind"), F.col("quote")).alias("ok"))


_DAY = "(SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders)"
_HAN = "['一','二','三','四','五','六','七','八','九','十','十一','十二','十三','十四','十五','十六','十七','十八','十九','二十','二十一','二十二','二十三','二十四','二十五','二十六','二十七','二十八','二十九','三十','三十一']"


@query(f"""WITH d AS (SELECT *, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM {_DAY}), s AS (SELECT *, unnest(range(6)) AS style FROM d)
SELECT o_orderkey, style::INT AS style, CASE WHEN style = 1 AND d <= 12 AND d <> m THEN 2 ELSE 1 END AS n, y::INT AS y, CASE WHEN style = 1 AND d <= 12 THEN least(m, d) ELSE m END::INT AS m FROM s""")
def date_readings(spark, sf_dir):
    """Order dates written in six ways, found and read again; of two readings the one of the lower month is shown."""
    d = F.col("d")
    han = F.array(*[F.lit(x.strip("'")) for x in _HAN.strip("[]").split(",")])
    year = F.translate(F.year(d).cast("string"), "0123456789", "〇一二三四五六七八九")
    styles = F.array(
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.concat_ws("", F.lit("平成"), F.year(d) - 1988, F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日")),
        F.concat_ws("", year, F.lit("年"), F.get(han, F.month(d) - 1), F.lit("月"), F.get(han, F.dayofmonth(d) - 1), F.lit("日")), F.date_format(d, "d MMM yyyy"), F.concat_ws("", F.lit("民国"), F.year(d) - 1911, F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日")),
    )
    orders = spread_by(ingest.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    lines = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).select("o_orderkey", F.posexplode(styles).alias("style", "text"))
    read = lines.select("o_orderkey", "style", F.explode(dates.read(F.concat(F.lit("on "), "text", F.lit(" it was")))).alias("x")).select("o_orderkey", "style", F.col("x.readings").alias("r"))
    first = F.array_sort("r", lambda a, b: a["m"] - b["m"])
    return read.select("o_orderkey", "style", F.size("r").alias("n"), first[0]["y"].alias("y"), first[0]["m"].alias("m"))


@query("""SELECT c_custkey AS page_id, 'N' || lpad(c_custkey::VARCHAR, 8, '0') AS number, lpad((c_custkey * 7 % 99 + 1)::VARCHAR, 2, '0') || '0203' AS birth, '31' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '15' AS expiry, 'MILLER, ' || (['ANNA','OMAR','VERA'])[(c_custkey % 3 + 1)::INT] AS names FROM customer""")
def document_pages(spark, sf_dir):
    """Passport pages made from customers, read again: fields and names."""
    k = F.col("c_custkey")
    check = lambda x: V.mrz_check(x).cast("string")
    c = spread_by(ingest.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("page_id"), F.concat(F.lit("N"), F.lpad(k.cast("string"), 8, "0")).alias("number"), F.concat(F.lpad((k * 7 % 99 + 1).cast("string"), 2, "0"), F.lit("0203")).alias("birth"), F.concat(F.lit("31"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("15")).alias("expiry"), F.get(F.array(F.lit("ANNA"), F.lit("OMAR"), F.lit("VERA")), (k % 3).cast("int")).alias("given"))
    upper = F.rpad(F.concat(F.lit("P<UTOMILLER<<"), "given"), 44, "<")
    lower = F.rpad(F.concat("number", check(F.col("number")), F.lit("UTO"), "birth", check(F.col("birth")), F.lit("F"), "expiry", check(F.col("expiry"))), 43, "<")
    lines = c.select("page_id", F.posexplode(F.array(upper, F.concat(lower, F.lit("0")), F.lit("other text"))).alias("line_no", "text"))
    return mrz.read(lines).select("page_id", "number", "birth", "expiry", "names")


@query(f"""WITH b AS (SELECT *, CASE line_no WHEN 1 THEN 'AB' WHEN 2 THEN '1234' WHEN 3 THEN '7ABC123' ELSE 'text here' END AS text FROM {_BOXES})
SELECT x.page_id, x.line_no, '7ABC123' AS token FROM b x WHERE x.line_no = 3 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.page_id = x.page_id AND y.line_no <> 3 AND y.t - x.b < 30 AND x.t - y.b < 30)
UNION ALL SELECT x.page_id, x.line_no, x.text || ' ' || y.text FROM b x JOIN b y ON x.page_id = y.page_id AND x.line_no <= 2 AND y.line_no = 3 - x.line_no WHERE y.t >= x.b - 6 AND y.t - x.b <= 20 AND y.t > x.t AND least(x.r, y.r) > greatest(x.l, y.l)""")
def plates_on_pages(spark, sf_dir):
    n = F.col("line_no")
    x = boxes_of(spark, sf_dir).withColumn("text", F.when(n == 1, "AB").when(n == 2, "1234").when(n == 3, "7ABC123").otherwise("text here"))
    return page.lone_plates(x).select("page_id", "line_no", "token").union(page.two_row_plates(x).select("page_id", "upper_no", "token"))


@query("""SELECT c_custkey AS page_id, 1 AS line_no FROM customer WHERE c_custkey % 2 = 0""")
def birth_echoes(spark, sf_dir):
    """Resident numbers made from customers; every second page repeats the birth date, the others give another day."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("11010519491231"), F.lpad((k % 1000).cast("string"), 3, "0"))
    weights = sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(V.CN_WEIGHTS)), F.lit(0)) % 11
    number = F.concat(body, F.substring(F.lit(V.CN_CHECK), weights + 1, F.lit(1)))
    day = F.when(k % 2 == 0, "1949年12月31日").otherwise("1949年12月30日")
    lines = spread_by(ingest.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("page_id"), F.posexplode(F.array(number, day, F.concat(F.lit("签发 "), day))).alias("line_no", "text"))
    ids = lines.select("page_id", F.explode(finders.resident_ids(F.col("text"))).alias("x")).select("page_id", "x.token")
    return page.birth_echoes(ids, lines).select("page_id", "line_no")
