"""Queries of the pixel operators, metrics of images and small record functions, each with its SQL.

The pixel table is made of ``events``: frames of 20 x 20 pixels, 400 events each, with four channels, a label and a value.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evalm, ordering, pixels as P, quality, regions
from .catalogue import query, r, t

PX = """px as (select event_id // 400 as frame, event_id % 400 // 20 as y, event_id % 20 as x, event_id * 37 % 256 as r, event_id * 91 % 256 as g, event_id * 151 % 256 as b,
 event_id * 53 % 256 as a, user_id % 7 as lbl, value, event_id from events)"""


def _px(spark, d):
    e = F.col("event_id")
    place = F.floor(e / 400).cast("long").alias("frame"), F.floor(e % 400 / 20).cast("long").alias("y"), (e % 20).alias("x")
    return t(spark, d, "events").select(*place, *[(e * k % 256).alias(c) for c, k in zip("rgba", (37, 91, 151, 53))], (F.col("user_id") % 7).alias("lbl"), "value", "event_id")


# --- predicates and masks ---------------------------------------------------------------------------------------


@query(f"with {PX} select event_id, case when r > 220 then 255 else 0 end as bin, round((r + g + b) / 3e0, 6) as mean, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 6) as gray from px")
def binarise(spark, d):
    c = [F.col(x) for x in "rgb"]
    return _px(spark, d).select("event_id", P.binarise(c[0]).alias("bin"), r((c[0] + c[1] + c[2]) / 3).alias("mean"), r(P.gray(*c)).alias("gray"))


@query(f"""with {PX}, m as (select event_id, a < 127 as fill, r % 4 = 0 and g % 4 = 3 and b < 200 as line from px)
 select event_id, fill, line, fill and line as both_of, fill or line as any_of, not fill as rest, fill and not line as marked from m""")
def mask_algebra(spark, d):
    m = _px(spark, d).select("event_id", P.fillable(F.col("a")).alias("fill"), ((F.col("r") % 4 == 0) & (F.col("g") % 4 == 3) & (F.col("b") < 200)).alias("line"))
    fill, line = F.col("fill"), F.col("line")
    return m.select("event_id", "fill", "line", (fill & line).alias("both_of"), (fill | line).alias("any_of"), (~fill).alias("rest"), (fill & ~line).alias("marked"))


@query(f"""with {PX}, q as (select event_id, case when r < 128 then 0 else 255 end as r, case when g < 128 then 0 else 255 end as g, case when b < 128 then 0 else 255 end as b, case when a < 128 then 0 else 255 end as a from px)
 select event_id, r = 0 and g = 0 and b = 0 and a = 255 as black, case when least(r, g, b) = 255 then 0 else 255 end as alpha from q""")
def exact_colors(spark, d):
    q = _px(spark, d).select("event_id", *[F.when(F.col(c) < 128, 0).otherwise(255).alias(c) for c in "rgba"])
    c = [F.col(x) for x in "rgba"]
    return q.select("event_id", P.is_black(*c).alias("black"), P.background_alpha(*c[:3]).alias("alpha"))


@query(f"""with {PX}, m as (select *, greatest(r, g, b) > 100 as bright from px)
 select event_id, case when bright then 255 else r end as r, case when bright then 255 else g end as g, case when bright then 255 else b end as b, case when bright then 0 else a end as a from m""")
def black_line_extract(spark, d):
    p = _px(spark, d)
    return p.select("event_id", *[c.alias(n) for n, c in zip("rgba", P.black_line(*[F.col(x) for x in "rgba"]))])


@query(f"with {PX} select frame, y, lbl, count(*) as npix from px where lbl <> 0 group by all having count(*) > 1")
def scored_regions(spark, d):
    return P.scored_regions(_px(spark, d), ["frame", "y"], "lbl")


@query("""with n as (select p_partkey, case p_partkey % 5 when 0 then 'hair_red' when 1 then 'hair_skin' when 2 then 'sky_blue_2' when 3 then 'line' else 'red_hair' end as name from part)
 select p_partkey, name, coalesce(split_part(name, '_', 2) in ('red', 'green', 'blue'), false) as color_line from n""")
def color_line_names(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "hair_red").when(k == 1, "hair_skin").when(k == 2, "sky_blue_2").when(k == 3, "line").otherwise("red_hair")
    return t(spark, d, "part").select("p_partkey", name.alias("name"), P.is_color_line(name).alias("color_line"))


# --- geometry ---------------------------------------------------------------------------------------------------


@query(f"""with {PX}, box as (select frame, greatest(min(y) - 2, 0) as y0, least(max(y) + 2, 19) as y1, greatest(min(x) - 2, 0) as x0, least(max(x) + 2, 19) as x1 from px where value > 99 group by frame),
 s as (select frame, y0, y1, x0, x1, y1 - y0 + 1 as nh, x1 - x0 + 1 as nw, abs(y1 - y0 - x1 + x0) // 2 as pad from box)
 select event_id, greatest(nh, nw) as side, y - y0 + case when nh > nw then 0 else pad end as y, x - x0 + case when nh > nw then pad else 0 end as x from px join s using (frame) where y between y0 and y1 and x between x0 and x1""")
def crop_square(spark, d):
    return P.crop_to_square(_px(spark, d), ["frame"], F.col("value") > 99, 20, 20, border=2).select("event_id", "side", "y", "x")


@query(f"with {PX} select frame, count(*) as n, sum(r)::bigint as total from px where y between 3 and 16 and x between 3 and 16 group by frame")
def crop_border(spark, d):
    return P.crop_border(_px(spark, d), 20, 20, 3).groupBy("frame").agg(F.count("*").alias("n"), F.sum("r").alias("total"))


@query(f"""with {PX} select frame, y + 1 as y, 1 + 19 - x as flipped, (x + 5) % 20 as rolled, y * 20 + x as place, (y + 20) * 40 + x as tiled from px
 union all select f.frame, e.y, -1, -1, -1, -1 from (select distinct frame from px) f, (select unnest([0, 21]) as y) e""")
def coordinate_ops(spark, d):
    p = _px(spark, d)
    moved = p.select("frame", (F.col("y") + 1).alias("y"), (20 - F.col("x")).alias("flipped"), ((F.col("x") + 5) % 20).alias("rolled"), (F.col("y") * 20 + F.col("x")).alias("place"), ((F.col("y") + 20) * 40 + F.col("x")).alias("tiled"))
    none = F.lit(-1).cast("long")
    padded = p.select("frame").distinct().select("frame", F.explode(F.array(F.lit(0).cast("long"), F.lit(21).cast("long"))).alias("y"), *[none.alias(c) for c in ("flipped", "rolled", "place", "tiled")])
    return moved.unionByName(padded)


@query(f"with {PX} select frame, lbl, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from px group by all")
def mean_color(spark, d):
    return _px(spark, d).groupBy("frame", "lbl").agg(*[r(F.avg(c)).alias(c) for c in "rgb"])


@query(f"with {PX} select frame, count(distinct lbl) as labels, min(lbl) as least, max(lbl) as most, count(distinct r) as colors from px group by frame")
def label_range(spark, d):
    return _px(spark, d).groupBy("frame").agg(F.countDistinct("lbl").alias("labels"), F.min("lbl").alias("least"), F.max("lbl").alias("most"), F.countDistinct("r").alias("colors"))


@query(f"""with {PX}, l as (select frame, lbl, min(y * 20 + x) as top from px where lbl <> 0 group by all)
 select frame, lbl as label, row_number() over (partition by frame order by top, lbl) as new_label from l""")
def relabel_first_pixel(spark, d):
    return regions.relabel_by_first_pixel(_px(spark, d).withColumnRenamed("lbl", "label"), ["frame"]).select("frame", "label", F.col("new_label").cast("long").alias("new_label"))


@query(f"""with {PX}, s as (select frame, y, sum(case when nxt > v then (1::bigint << (18 - x)::int) else 0 end)::bigint as bits from (select *, r as v, lead(r) over (partition by frame, y order by x) as nxt from px) where x < 19 group by all) select * from s""")
def dhash(spark, d):
    whole = _px(spark, d)
    return P.dhash_rows(whole, ["frame"], "r").select("frame", "y", "bits")


# --- colour -----------------------------------------------------------------------------------------------------


@query(f"""with {PX}, c as (select n_nationkey % 7 as lbl, min(n_nationkey) * 9 % 256 as red from nation where n_nationkey % 7 not in (0, 3) group by 1)
 select event_id, case when px.lbl = 0 then 0 else coalesce(red, 255) end as r, px.lbl = 0 as line from px left join c on px.lbl = c.lbl""")
def paint_by_label(spark, d):
    c = t(spark, d, "nation").groupBy((F.col("n_nationkey") % 7).cast("long").alias("lbl")).agg((F.min("n_nationkey") * 9 % 256).alias("red")).where("lbl not in (0, 3)")
    met = _px(spark, d).join(c, "lbl", "left")
    return met.select("event_id", F.when(F.col("lbl") == 0, 0).otherwise(F.coalesce("red", F.lit(255))).alias("r"), (F.col("lbl") == 0).alias("line"))


@query(f"""with {PX}, m as (select distinct r as old, r * 7 % 256 as new from px where r % 3 = 0) select event_id, coalesce(new, r) as r from px left join m on r = old""")
def recolor(spark, d):
    p = _px(spark, d)
    m = p.select(F.col("r").alias("old"), (F.col("r") * 7 % 256).alias("new")).where("old % 3 = 0").distinct()
    return p.join(m, F.col("r") == F.col("old"), "left").select("event_id", F.coalesce("new", "r").alias("r"))


@query(f"""with {PX} select event_id, round((0.00456621e0 * r + 0.00625893e0 * b) * 255 - 222.921e0, 6) as red, round((0.00456621e0 * r - 0.00153632e0 * g - 0.00318811e0 * b) * 255 + 135.576e0, 6) as green,
 round((0.00456621e0 * r + 0.00791071e0 * g) * 255 - 276.836e0, 6) as blue, round(((r / 255e0) * 65.481e0 + (g / 255e0) * 128.553e0 + (b / 255e0) * 24.966e0 + 16) / 255e0, 6) as luma from px""")
def ycbcr_inverse(spark, d):
    c = P.from_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    luma = (F.col("r") / 255 * 65.481 + F.col("g") / 255 * 128.553 + F.col("b") / 255 * 24.966 + 16) / 255
    return _px(spark, d).select("event_id", r(c["r"]).alias("red"), r(c["g"]).alias("green"), r(c["b"]).alias("blue"), r(luma).alias("luma"))


def _wheel_sql() -> str:
    shape = {"RY": "255, {u}, 0", "YG": "{d}, 255, 0", "GC": "0, 255, {u}", "CB": "0, {d}, 255", "BM": "{u}, 0, 255", "MR": "255, 0, {d}"}
    parts, at = [], 0
    for name, n in P.WHEEL:
        up = f"floor(255e0 * k / {n})"
        parts.append(f"select {at} + k as i, {shape[name].format(u=up, d=f'255 - {up}')} from range({n}) s(k)")
        at += n
    return "wheel(i, r, g, b) as (" + " union all ".join(parts) + ")"


@query(f"""with {PX}, {_wheel_sql()}, v as (select event_id, (r - 128) / 150e0 as u, (g - 128) / 150e0 as v from px),
 p as (select event_id, sqrt(u * u + v * v) as rad, (atan2(-v, -u) / {math.pi!r}::double + 1) / 2 * 54 as turn from v), q as (select *, floor(turn)::int as k, turn - floor(turn)::int as f from p),
 m as (select event_id, rad, (1 - f) * lo.r / 255e0 + f * hi.r / 255e0 as r, (1 - f) * lo.g / 255e0 + f * hi.g / 255e0 as g, (1 - f) * lo.b / 255e0 + f * hi.b / 255e0 as b from q join wheel lo on lo.i = k join wheel hi on hi.i = (k + 1) % 55)
 select event_id, floor(255 * case when rad <= 1 then 1 - rad * (1 - r) else r * 0.75e0 end + 1e-9)::int as r, floor(255 * case when rad <= 1 then 1 - rad * (1 - g) else g * 0.75e0 end + 1e-9)::int as g,
 floor(255 * case when rad <= 1 then 1 - rad * (1 - b) else b * 0.75e0 end + 1e-9)::int as b from m""")
def flow_wheel(spark, d):
    v = _px(spark, d).select("event_id", ((F.col("r") - 128) / 150.0).alias("u"), ((F.col("g") - 128) / 150.0).alias("v"))
    return v.select("event_id", *[c.alias(n) for n, c in zip("rgb", P.flow_color(F.col("u"), F.col("v")))])


@query(f"""with {PX}, v as (select event_id, (r - 128) * 9e0 as u, (g - 128) * 9e0 as v from px) select event_id, abs(u) < 1000 and abs(v) < 1000 as valid,
 cast(least(floor((least(greatest(u / 20 / 2000, -0.02e0), 0.02e0) + 0.02e0) * 255 / 0.04e0), 254) as bigint) as qu, cast(least(floor((least(greatest(v / 20 / 2000, -0.02e0), 0.02e0) + 0.02e0) * 255 / 0.04e0), 254) as bigint) as qv from v""")
def flow_quantise(spark, d):
    v = _px(spark, d).select("event_id", ((F.col("r") - 128) * 9.0).alias("u"), ((F.col("g") - 128) * 9.0).alias("v"))
    q = lambda c: S.quantize(F.col(c) / 20 / 2000, -0.02, 0.02, 255)
    return v.select("event_id", P.flow_valid(F.col("u"), F.col("v")).alias("valid"), q("u").alias("qu"), q("v").alias("qv"))


@query("select event_id, cast(round_even((least(greatest(value / 60e0, 0e0), 1e0) - 0e0) / (1e0 - 0e0) * 255, 0) as int) as byte from events")
def tensor_to_image(spark, d):
    return t(spark, d, "events").select("event_id", P.to_image(F.col("value") / 60.0).alias("byte"))


@query("""with c as (select n_name as name, n_nationkey as k, s as slot, case when (n_nationkey + s) % 4 <> 0 then [n_nationkey * 3 % 256, s * 60, n_nationkey * 11 % 256] end as color from nation, (select unnest([0, 1, 2, 3]) as s)),
 l as (select name, name || ': [' || string_agg(coalesce('[' || color[1] || ' ' || color[2] || ' ' || color[3] || ']', 'null'), ',' order by slot) || ']' as line, count(color) as colors, coalesce(max(case when slot = 1 then color[1] end), -1) as normal from c group by name)
 select name, line, colors, normal from l""")
def color_book(spark, d):
    """Lines of a colour book, written and read again."""
    slot = lambda s: F.when((F.col("n_nationkey") + s) % 4 != 0, F.array(F.col("n_nationkey") * 3 % 256, F.lit(s * 60), F.col("n_nationkey") * 11 % 256))
    lines = t(spark, d, "nation").select(P.book_line(F.col("n_name"), F.array(*[slot(s) for s in range(4)])).alias("line"))
    read = P.parse_book_line(F.col("line"))
    return lines.select("line", *[c.alias(n) for n, c in read.items()]).select("name", "line", F.size(F.filter("slots", lambda c: c.isNotNull())).cast("long").alias("colors"), F.coalesce(F.col("slots")[1][0], F.lit(-1)).alias("normal"))


@query("""with g as (select n_name as name, s as slot, 62 + (n_nationkey % 16) * 24 as y, 30 + (s + 4 * (n_nationkey // 16)::int) * 44 as x from nation, (select unnest([0, 1, 2, 3]) as s))
 select name, slot, case when (y * x) % 5 > 0 then (y * 3 % 256) || ' ' || (x * 7 % 256) || ' ' || ((y + x) % 256) end as color from g""")
def color_book_grid(spark, d):
    """Swatches read off a screenshot at fixed places; white ones are empty."""
    grid = P.book_grid(spark, t(spark, d, "nation").select("n_name", "n_nationkey"), "n_name", "n_nationkey")
    y, x = F.col("y"), F.col("x")
    shot = spark.range(62, 62 + 16 * 24).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(400))).alias("x"))
    shot = shot.select("y", "x", F.when(y * x % 5 > 0, F.concat_ws(" ", y * 3 % 256, x * 7 % 256, (y + x) % 256)).alias("color"))
    return grid.join(shot, ["y", "x"], "left").select(F.col("n_name").alias("name"), "slot", "color")


@query("with c as (select p_partkey, p_partkey * 7 % 500 as color from part) select color, count(*) as names, min(p_partkey) as first from c group by color having count(*) > 1")
def duplicate_colors(spark, d):
    """Colours under more than one name, for which a colour book is rejected."""
    c = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 500).alias("color"))
    return c.groupBy("color").agg(F.count("*").alias("names"), F.min("p_partkey").alias("first")).where("names > 1")


# --- windows over pixels ----------------------------------------------------------------------------------------

_MIRROR = "case when {0} < 0 then -({0}) when {0} > 19 then 38 - ({0}) else {0} end"
_NEAR = f"""near as (select t.frame, t.y, t.x, dy, dx, {_MIRROR.format("t.y + dy")} as sy, {_MIRROR.format("t.x + dx")} as sx from px t, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx))"""


@query(f"""with {PX}, {_NEAR}, e as (select *, abs(r - g) / 255e0 as res, abs(r - b) / 255e0 as ema from px),
 l as (select n.frame, n.y, n.x, var_samp(e.res) as local from near n join e on e.frame = n.frame and e.y = n.sy and e.x = n.sx group by all), w as (select frame, var_samp(res) as whole from e group by frame)
 select e.event_id, round(case when e.res < e.ema then 0 else power(whole, 0.2e0) * local end, 6) as weight from e join l using (frame, y, x) join w using (frame) where (select count(*) from px p where p.frame = e.frame) = 400""")
def artifact_map(spark, d):
    p = _px(spark, d).withColumns({"residual": F.abs(F.col("r") - F.col("g")) / 255.0, "residual_ema": F.abs(F.col("r") - F.col("b")) / 255.0})
    full = p.groupBy("frame").count().where("count = 400").select("frame")
    m = P.artifact_map(p.join(full, "frame", "left_semi"), ["frame"], 20, 20, size=3)
    return m.select((F.col("frame") * 400 + F.col("y") * 20 + F.col("x")).alias("event_id"), r("weight").alias("weight"))


@query(f"""with {PX}, {_NEAR}, k as (select *, (case when dy = 0 then 0.5e0 else 0.25e0 end) * (case when dx = 0 then 0.5e0 else 0.25e0 end) as w from near),
 v as (select frame, y, x, event_id, r / 255e0 as v from px where frame in (select frame from px group by 1 having count(*) = 400)),
 b as (select k.frame, k.y, k.x, sum(v * w) as blur from k join v on v.frame = k.frame and v.y = k.sy and v.x = k.sx group by all),
 m as (select v.*, v - blur as res, (abs(v - blur) * 255 > 10)::int::double as mask from v join b using (frame, y, x)),
 s as (select k.frame, k.y, k.x, sum(mask * w) as soft from k join m on m.frame = k.frame and m.y = k.sy and m.x = k.sx group by all)
 select event_id, round(soft * least(greatest(v + 0.5e0 * res, 0), 1) + (1 - soft) * v, 6) as value from m join s using (frame, y, x)""")
def unsharp_mask(spark, d):
    p = _px(spark, d).withColumn("value", F.col("r") / 255.0)
    full = p.groupBy("frame").count().where("count = 400").select("frame")
    out = P.sharpen(p.join(full, "frame", "left_semi").select("frame", "y", "x", "value"), ["frame"], 20, 20)
    return out.select((F.col("frame") * 400 + F.col("y") * 20 + F.col("x")).alias("event_id"), r("value").alias("value"))


@query(f"""with {PX}, g as (select k, exp(-(k - 5) * (k - 5) / 4.5e0) as g from range(11) s(k)), n as (select k, g / (select sum(g) from g) as g from g),
 w as (select a.k as i, b.k as j, a.g * b.g as w from n a, n b), o as (select distinct frame, u.k as y, v.k as x from px, n u, n v where u.k < 10 and v.k < 10),
 m as (select o.frame, o.y, o.x, sum(w * r) as ma, sum(w * g) as mb, sum(w * r * r) as aa, sum(w * g * g) as bb, sum(w * r * g) as ab from o, w join px on px.frame = o.frame and px.y = o.y + w.i and px.x = o.x + w.j group by all)
 select frame, round(avg((2 * ma * mb + 6.5025e0) * (2 * (ab - ma * mb) + 58.5225e0) / ((ma * ma + mb * mb + 6.5025e0) * (aa - ma * ma + bb - mb * mb + 58.5225e0))), 5) as ssim from m group by frame""")
def ssim_frames(spark, d):
    """SSIM of two channels with the 11 x 11 Gaussian window."""
    return P.ssim_frames(_px(spark, d), ["frame"], "r", "g", 20, 20).select("frame", r("ssim", 5).alias("ssim"))


@query(f"""with e as (select event_id // 64 as block, event_id % 64 // 8 as y, event_id % 8 as x, (event_id * 37 % 256) - 128e0 as v from events), k as (select u::int as u, v::int as v from range(8) a(u), range(8) b(v)),
 q(v, u, step) as (values {", ".join(f"({i // 8}, {i % 8}, {x}e0)" for i, x in enumerate(P.LUMINANCE))}),
 c as (select block, k.v, k.u, sum(e.v * cos((2 * x + 1) * k.u * {math.pi!r}::double / 16) * cos((2 * y + 1) * k.v * {math.pi!r}::double / 16) / 4 * case when k.u = 0 then sqrt(0.5e0) else 1 end * case when k.v = 0 then sqrt(0.5e0) else 1 end) as c from e, k group by all)
 select block, v, u, round(c, 4) + 0e0 as coefficient, round(c / (step * 0.5e0), 4) + 0e0 as quantised from c join q using (v, u)""")
def jpeg_dct(spark, d):
    e = F.col("event_id")
    cells = t(spark, d, "events").select(F.floor(e / 64).cast("long").alias("block"), F.floor(e % 64 / 8).alias("y"), (e % 8).alias("x"), (e * 37 % 256).alias("value"))
    return P.dct_blocks(cells, ["block"], F.col("value"), quality=75).select("block", "v", "u", (r("coefficient", 4) + 0.0).alias("coefficient"), (r("quantised", 4) + 0.0).alias("quantised"))


_CUBIC = "case when abs({0}) <= 1 then 1.5e0 * pow(abs({0}), 3) - 2.5e0 * pow(abs({0}), 2) + 1 when abs({0}) <= 2 then -0.5e0 * pow(abs({0}), 3) + 2.5e0 * pow(abs({0}), 2) - 4 * abs({0}) + 2 else 0e0 end"


@query(f"""with {PX}, o as (select k, (k + 1) / 0.5e0 + 0.5e0 * (1 - 1 / 0.5e0) as u from range(10) s(k)), i as (select k, u, floor(u - 4) + j as i from o, range(10) s(j)),
 w as (select k, i, {_CUBIC.format("((u - i) * 0.5e0)")} as w from i), n as (select k, i, w / sum(w) over (partition by k) as w from w),
 m as (select k, case when i < 1 then 1 - i when i > 20 then 41 - i else i end - 1 as x, w from n)
 select frame, y, m.k as k, round(sum(px.r * w), 4) as value from px join m on px.x = m.x where w <> 0 group by all""")
def cubic_resize(spark, d):
    """Rows of 20 pixels resized to 10."""
    return P.resize_rows(_px(spark, d).select("frame", "y", "x", F.col("r").alias("value")), ["frame", "y"], "value", 20, 0.5).select("frame", "y", "k", r("value", 4).alias("value"))


@query(f"""with {PX}, f as (select unnest([0, 1, 2, 3]) as k), z as (select frame, y, 2 * x + 2 - k as place, r * [1, 3, 3, 1][k + 1] / 8e0 as part from px, f)
 select frame, y, place, round(sum(part), 6) as value from z where place between 0 and 39 group by all""")
def up_fir_down(spark, d):
    p = _px(spark, d).select("frame", "y", "x", F.col("r").alias("value"))
    out = P.up_fir_down(p, ["frame", "y"], "x", "value", 20, 2, 1, (0.125, 0.375, 0.375, 0.125), (2, 1))
    return out.select("frame", "y", F.col("at").alias("place"), r("value").alias("value"))


@query("select event_id, round((case when value - 50 + event_id % 7 > 0 then value - 50 + event_id % 7 else (value - 50 + event_id % 7) * 0.2e0 end) * sqrt(2e0), 6) as value from events")
def fused_leaky_relu(spark, d):
    return t(spark, d, "events").select("event_id", r(P.fused_leaky_relu(F.col("value") - 50, F.col("event_id") % 7)).alias("value"))


@query("""with x as (select event_type, (value - 50) / 25e0 as x from events) select event_type, round(avg(greatest(1 - x, 0)), 6) as hinge_real, round(avg(greatest(1 + x, 0)), 6) as hinge_fake, round(-avg(x), 6) as wgan_real, round(avg(x), 6) as wgan_fake,
 round(avg(ln(1 + exp(-x))), 6) as softplus_real, round(avg(ln(1 + exp(x))), 6) as softplus_fake, round(avg((x - 1) * (x - 1)), 6) as lsgan_real, round(avg(x * x), 6) as lsgan_fake from x group by 1""")
def gan_losses(spark, d):
    m = P.gan_losses(t(spark, d, "events"), ["event_type"], (F.col("value") - 50) / 25)
    return m.select("event_type", *[r(c).alias(c) for c in m.columns[1:]])


@query()
def covar_fid(spark, d):
    """Frechet distance with full covariances of two labels' vectors."""
    return quality.frechet(t(spark, d, "embeddings"), "label", "embedding", 0, 1)


# --- joins of frames --------------------------------------------------------------------------------------------


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, d.doc_id is not null as predicted, l.doc_id is not null as labelled, (select count(*) from documents) = (select count(*) from labels) as complete from documents d full join labels l on d.doc_id = l.doc_id""")
def frame_guard(spark, d):
    """Predictions against ground truth by id: what either side misses, and whether the counts agree."""
    p, g = t(spark, d, "documents").select("doc_id", F.lit(True).alias("p")), t(spark, d, "labels").select("doc_id", F.lit(True).alias("g"))
    complete = p.agg(F.count("*").alias("n")).scalar() == g.agg(F.count("*").alias("n")).scalar()
    return p.join(g, "doc_id", "full").select("doc_id", F.col("p").isNotNull().alias("predicted"), F.col("g").isNotNull().alias("labelled"), complete.alias("complete"))


_URL = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9_+.-]*:)?//[^/?#]*([^?#]*)', 1)"


@query(f"""with p as (select page_id, {_URL} as path from pages), o as (select path, min(page_id) as other from p group by path)
 select p.page_id, replace(p.path, '/en/', '/fr/') as rewritten, coalesce(other, -1) as other from p left join o on o.path = replace(p.path, '/en/', '/fr/')""")
def path_rewrite(spark, d):
    p = t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9_+.-]*:)?//[^/?#]*([^?#]*)", 1).alias("path"))
    o = p.groupBy(F.col("path").alias("rewritten")).agg(F.min("page_id").alias("other"))
    return p.select("page_id", F.replace("path", F.lit("/en/"), F.lit("/fr/")).alias("rewritten")).join(o, "rewritten", "left").select("page_id", "rewritten", F.coalesce("other", F.lit(-1)).alias("other"))


@query("""with e as (select event_type as folder, event_id // 2 as base, event_id, event_id % 2 as side from events)
 select p.folder, p.base, p.event_id as result, g.event_id as truth from e p join e g on p.folder = g.folder and p.base = g.base where p.side = 0 and g.side = 1""")
def folder_pairs(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("folder"), F.floor(F.col("event_id") / 2).cast("long").alias("base"), "event_id")
    one, two = e.where("event_id % 2 = 0").withColumnRenamed("event_id", "result"), e.where("event_id % 2 = 1").withColumnRenamed("event_id", "truth")
    return one.join(two, ["folder", "base"]).select("folder", "base", "result", "truth")


@query(f"""with {PX}, l as (select distinct frame, y, lbl from px), k as (select frame, y, lbl, row_number() over (partition by frame, y order by lbl) - 1 as i from l)
 select a.frame, a.y, a.lbl, coalesce(k.i, -1) as "match" from l a left join k on k.frame = a.frame and k.y = a.y - 1 and k.lbl = a.lbl""")
def match_index(spark, d):
    """The place of each label in the sorted labels of the row above, -1 where it is absent."""
    l = _px(spark, d).select("frame", "y", "lbl").distinct()
    above = l.groupBy("frame", (F.col("y") + 1).alias("y")).agg(F.array_sort(F.collect_list("lbl")).alias("labels"))
    return l.join(above, ["frame", "y"], "left").select("frame", "y", "lbl", F.coalesce(F.nullif(F.array_position("labels", F.col("lbl")), F.lit(0)) - 1, F.lit(-1)).cast("long").alias("match"))


# --- records ----------------------------------------------------------------------------------------------------


@query("""with k as (select md5(text) as digest, min(doc_id) as doc_id from documents group by 1), n as (select doc_id, row_number() over (order by doc_id) - 1 as frame_no from k)
 select doc_id, frame_no, lpad(frame_no::varchar, 6, '0') || '.png' as name from n""")
def rename_key_frames(spark, d):
    """Key frames numbered in the order of their names, without gathering them in one task."""
    k = t(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    n = ordering.numbered(k, ["doc_id"], "frame_no")
    return n.select("doc_id", "frame_no", F.concat(F.lpad(F.col("frame_no").cast("string"), 6, "0"), F.lit(".png")).alias("name"))


@query(f"""with {PX}, c as (select frame, lbl, min(r) as r, max(g) as g from px group by all)
 select frame, '{{' || string_agg('"' || lbl || '":[' || r || ',' || g || ',255]', ',' order by lbl) || '}}' as json from c group by frame""")
def json_dict(spark, d):
    """One JSON dictionary a frame, keys in order."""
    c = _px(spark, d).groupBy("frame", "lbl").agg(F.min("r").alias("r"), F.max("g").alias("g"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("lbl"), F.array("r", "g", F.lit(255).cast("long")).alias("c"))))
    entries = F.transform(entries, lambda e: F.struct(e["lbl"].cast("string").alias("key"), e["c"].alias("value")))
    return c.groupBy("frame").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


@query("""with m as (select event_type, printf('%.4f', avg(value)) as score from events group by 1), h as (select hour(ts) as h, printf('%.4f', avg(value)) as score from events group by 1)
 select 0 as section, 'Scenario,score' as line union all select 1, 'AVG,' || printf('%.4f', avg(value)) from events union all select 2, ',' union all select 3, event_type || ',' || score from m union all select 4, ','
 union all select 5, lpad(h::varchar, 2, '0') || ',' || score from h""")
def csv_lines(spark, d):
    """The lines of the metrics file: header, average, blank, cameras, blank, folders."""
    e = t(spark, d, "events")
    line = lambda name, df: df.select(F.concat_ws(",", name, F.format_string("%.4f", "score")).alias("line"))
    one = lambda s: spark.range(1).select(F.lit(s).alias("line"))
    by = lambda c: e.groupBy(c.alias("name")).agg(F.avg("value").alias("score"))
    return evalm.report([
        (0, one("Scenario,score")), (1, line(F.lit("AVG"), e.agg(F.avg("value").alias("score")))), (2, one(",")), (3, line(F.col("name"), by(F.col("event_type")))),
        (4, one(",")), (5, line(F.lpad(F.col("name").cast("string"), 2, "0"), by(F.hour("ts")))),
    ])


@query("""with v as (select event_type, event_id // 1000 as step, user_id % 4 as rank, avg(value) as v from events group by all) select event_type, step, round(avg(v), 6) as loss, count(*) as ranks from v group by all""")
def rank_mean(spark, d):
    v = t(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 1000).cast("long").alias("step"), F.col("user_id") % 4).agg(F.avg("value").alias("v"))
    return v.groupBy("event_type", "step").agg(r(F.avg("v")).alias("loss"), F.count("*").alias("ranks"))


@query("select user_id, count(*) as calls, round(sum(value), 6) as total from events group by user_id order by sum(value) desc, user_id limit 20")
def profile_top(spark, d):
    p = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("value").alias("s"))
    return p.orderBy(F.desc("s"), "user_id").limit(20).select("user_id", "calls", r("s").alias("total"))


@query("""with s as (select event_id, ts, floor(value * 7200)::bigint as s from events) select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, 'run_archived_' || strftime(ts, '%Y%m%d_%H%M%S') as archived,
 case when s >= 172800 then (s // 86400) || ' days, ' when s >= 86400 then '1 day, ' else '' end || (s % 86400 // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as took from s""")
def time_strings(spark, d):
    e = t(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.floor(F.col("value") * 7200).cast("long").alias("s"))
    return e.select("event_id", "stamp", F.concat(F.lit("run_archived_"), "stamp").alias("archived"), S.duration(F.col("s")).alias("took"))


@query("""with n as (select user_id, count(*) as n from events group by 1) select user_id, least(50, 1000 // n) as duration, abs(n - 20) // 2 as pad_before, abs(n - 20) - abs(n - 20) // 2 as pad_after, least(20, n) as ball, least(10, n // 2) as small_ball from n""")
def frame_params(spark, d):
    n = F.col("n")
    diff = F.abs(n - 20)
    half = F.floor(diff / 2).cast("long")
    p = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return p.select("user_id", F.least(F.lit(50), F.floor(1000 / n)).cast("long").alias("duration"), half.alias("pad_before"), (diff - half).alias("pad_after"), F.least(F.lit(20), n).alias("ball"), F.least(F.lit(10), F.floor(n / 2)).cast("long").alias("small_ball"))


@query("""select event_id, coalesce(json_extract_string(p, '$.params_ema'), json_extract_string(p, '$.params'), json_extract_string(p, '$.k')) as chosen
 from (select event_id, case event_id % 3 when 0 then replace(props, '"k"', '"params_ema"') when 1 then replace(props, '"k"', '"params"') else props end as p from events)""")
def checkpoint_choice(spark, d):
    k = F.col("event_id") % 3
    p = F.when(k == 0, F.replace("props", F.lit('"k"'), F.lit('"params_ema"'))).when(k == 1, F.replace("props", F.lit('"k"'), F.lit('"params"'))).otherwise(F.col("props"))
    return t(spark, d, "events").select("event_id", F.coalesce(*[F.get_json_object(p, f"$.{n}") for n in ("params_ema", "params", "k")]).alias("chosen"))


# --- evaluation in sequences ------------------------------------------------------------------------------------

_SEQ = "seq as (select event_type, row_number() over (partition by event_type order by event_id) - 1 as i, value from events)"


@query(f"""with {_SEQ} select event_type, round(sum(case when i % 20 > 0 then value end) / 19 / nullif(count(*) // 20, 0), 6) as mean from seq group by 1""")
def eval_split(spark, d):
    """Mean of a folder of sequences of 20 frames, the first of each left out."""
    s = ordering.numbered(t(spark, d, "events").select("event_type", "event_id", "value"), ["event_id"], "i", within=["event_type"])
    return evalm.split_means(s, ["event_type"], "i", "value", 20).select("event_type", r("mean").alias("mean"))


@query(f"""with {_SEQ}, c as (select event_type, i // 300 as clip, i % 300 // 100 as camera, sum(case when i % 20 > 0 then value end) / 19 / nullif(count(*) // 20, 0) as mean from seq group by all)
 select event_type, clip, case camera when 0 then 'far' when 1 then 'near' else 'close' end as camera, round(mean, 6) as mean, round(avg(mean) over (partition by event_type, clip), 6) as overall from c""")
def eval_cameras(spark, d):
    """Clips of three cameras of 100 frames, sequences of 20 inside each camera, the first of each left out."""
    s = ordering.numbered(t(spark, d, "events").select("event_type", "event_id", "value"), ["event_id"], "i", within=["event_type"]).withColumn("clip", F.floor(F.col("i") / 300).cast("long"))
    m = evalm.camera_means(s, ["event_type", "clip"], F.col("i") % 300, "value", [("far", 100), ("near", 100), ("close", 100)], 20)
    return m.select("event_type", "clip", "camera", r("mean").alias("mean"), r("overall").alias("overall"))


@query("""with b as (select event_type, event_id, value, min(value) over (partition by event_type order by event_id rows unbounded preceding) best from events)
 select event_type, event_id, best, max(case when value = best then event_id end) over (partition by event_type order by event_id rows unbounded preceding) best_at from b""")
def best_so_far_low(spark, d):
    e = t(spark, d, "events").select("event_type", "event_id", "value")
    return evalm.best_so_far(e, ["event_type"], "event_id", "value", higher=False).select("event_type", "event_id", "best", "best_at")


@query("""with x as (select d.lang, d.n_chars as npix, (l.quality = case when d.n_chars > 1500 then 1 else 0 end) as hit from labels l join documents d on l.doc_id = d.doc_id)
 select lang, round(sum(case when hit and npix > 500 then 1e0 else 0e0 end) / nullif(sum(case when npix > 500 then 1e0 else 0e0 end) + case when max(npix) - 3000 > 500 then 0 else -1 end, 0), 6) as acc_thres from x group by lang""")
def eval_line_label(spark, d):
    """acc_thres where the line label counts as a region and is taken off again."""
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("npix")), "doc_id")
    x = x.withColumn("line", F.max("npix").over(Window.partitionBy("lang")) - 3000)
    bg = F.lit(False)
    m = evalm.region_metrics(x, ["lang"], F.col("quality") == F.when(F.col("npix") > 1500, 1).otherwise(0), bg, bg, "npix", 500, F.col("line"))
    return m.select("lang", r("acc_thres").alias("acc_thres"))


@query("""with g as (select user_id, ts, event_id, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as nth from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as began, count(*) as n, round(sum(value), 6) as total from s group by user_id, nth""")
def session_windows(spark, d):
    """Sessions of a user's events with less than six hours between two."""
    w = t(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n", r("s").alias("total"))


@query()
def thin_stable(spark, d):
    """Thinning until nothing changes; tests hold it against a literal loop."""
    cells = _px(spark, d).select("frame", "y", "x", F.when(F.col("lbl") < 4, 0).otherwise(F.col("lbl")).alias("label"))
    return regions.thin(cells, ["frame"])


@query()
def redistribute_colors(spark, d):
    """Colours pushed apart; tests hold it against a literal simulation."""
    from ..operators.kernels import spread_colors

    c = _px(spark, d).where("y = 0").groupBy("frame", "lbl").agg(F.array(F.min("r"), F.min("g"), F.min("b")).alias("rgb"))
    return spread_colors(c.select(F.col("frame"), F.col("lbl").alias("k"), "rgb", (F.col("lbl") == 0).alias("fixed")))


# --- labels, lines and logs -------------------------------------------------------------------------------------


@query("""with l as (select event_id, case when event_id % 11 = 0 then -1 else event_id * 37 end as label from events), c as (select event_id, label, (greatest(label, 0) >> 16) & 255 as r, (greatest(label, 0) >> 8) & 255 as g, greatest(label, 0) & 255 as b, case when label < 0 then 0 else 255 end as a from l)
 select event_id, r, g, b, a, case when a = 0 then -1 else r * 65536 + g * 256 + b end as label from c""")
def label_rgba(spark, d):
    """Labels written as colours and read again; -1 is transparent."""
    from ..sources.files import channels_label, label_channels

    e = F.col("event_id")
    c = t(spark, d, "events").select("event_id", *[x.alias(n) for n, x in zip("rgba", label_channels(F.when(e % 11 == 0, -1).otherwise(e * 37)))])
    return c.select("event_id", *"rgba", channels_label(*[F.col(n) for n in "rgba"]).cast("long").alias("label"))


@query(f"""with {PX} select event_id, a > 100 as line_alpha, (r + g + b) / 3e0 < 150 as line_mean, cast(round_even((r * a + g * (255 - a)) / 255e0, 0) as int) as over from px""")
def line_blend(spark, d):
    c = [F.col(x) for x in "rgba"]
    return _px(spark, d).select("event_id", S.is_line(*c).alias("line_alpha"), S.is_line(*c[:3]).alias("line_mean"), S.blend(c[0], c[3], c[1]).alias("over"))


@query("select event_id, round((event_id * 13 % 65536 - 32768) / 64e0, 6) as flow from events")
def flow_from_png(spark, d):
    return t(spark, d, "events").select("event_id", r(S.flow_from_png(F.col("event_id") * 13 % 65536)).alias("flow"))


@query("select event_id, 'clip_' || event_id as key, cast(event_id % 700 + 1 as int) as h, cast(event_id % 900 + 1 as int) as w, 3 as c, 1 as level from events where event_id % 5 > 0")
def kv_meta(spark, d):
    """The index lines of a key-value store of images; lines of another shape are left out."""
    from ..sources import logs

    e = F.col("event_id")
    size = F.format_string("(%d,%d,3) 1", e % 700 + 1, e % 900 + 1)
    lines = t(spark, d, "events").select("event_id", F.concat(F.lit("clip_"), e.cast("string"), F.when(e % 5 == 0, " broken").otherwise(F.concat(F.lit(".png "), size))).alias("value"))
    return logs.kv_meta(lines.select("value")).select(F.regexp_extract("key", r"(\d+)$", 1).cast("long").alias("event_id"), "key", "h", "w", "c", "level")


@query("select event_id, round(value / (event_id - 0 + 1) * (200000 - event_id - 1), 4) as eta from events")
def eta(spark, d):
    from ..operators import series

    return t(spark, d, "events").select("event_id", r(series.eta(F.col("value"), F.lit(0), F.col("event_id"), F.lit(200_000)), 4).alias("eta"))


@query("select doc_id, md5(text) as digest, min(doc_id) over (partition by md5(text)) as key from documents")
def exact_keys(spark, d):
    from ..operators import dedup

    return dedup.exact_keys(t(spark, d, "documents").select("doc_id", "text"), F.md5("text"), "doc_id").select("doc_id", "digest", "key")


@query("""select l_returnflag, round(avg(abs(l_discount - l_tax)), 8) as l1, round(sum((l_discount - l_tax) * (l_discount - l_tax) * l_quantity) / sum(l_quantity), 8) as weighted_mse, round(sum(sqrt((l_discount - l_tax) * (l_discount - l_tax) + 1e-6)), 4) as charbonnier,
 round(10 * log10(1 / avg((l_discount - l_tax) * (l_discount - l_tax))), 6) as psnr, round(avg((l_discount = l_tax)::int::double), 6) as same from lineitem group by 1""")
def named_metrics(spark, d):
    """Losses with weights and reductions, and metrics by their names, in one aggregation."""
    from ..functions import named

    l = t(spark, d, "lineitem")
    a, b = F.col("l_discount"), F.col("l_tax")
    losses = l.groupBy("l_returnflag").agg(
        r(named.LOSSES.find("l1")(a, b), 8).alias("l1"), r(named.LOSSES.find("mse")(a, b, F.col("l_quantity")), 8).alias("weighted_mse"), r(named.LOSSES.find("charbonnier")(a, b, reduction="sum", eps=1e-6), 4).alias("charbonnier")
    )
    pair = {"a": "l_discount", "b": "l_tax"}
    metrics = named.measure(l, ["l_returnflag"], {"type": "psnr", "peak": 1.0, **pair}, {"type": "accuracy", "as": "same", **pair})
    return losses.join(metrics.select("l_returnflag", r("psnr").alias("psnr"), r("same").alias("same")), "l_returnflag")
