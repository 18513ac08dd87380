"""Queries over image, track, physics and streaming kernels, on planes made from embeddings and launches made from parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions import colour as C
from chronotrack.functions.numeric import normalise_hue, tidy
from chronotrack.operators import images as I
from chronotrack.operators import modes as Y
from chronotrack.operators import physics as B
from chronotrack.operators import timing as G
from chronotrack.operators import track as T
from chronotrack.plans import pipelines as Q
from chronotrack.plans.catalog import query, table
from chronotrack.plans.queries_timing import EV, events
from chronotrack.streaming import impact as M
from chronotrack.streaming import workflow as S

_PIX = "with p as (select vec_id, vec_id//10 as clip, vec_id%10 as frame, unnest(embedding) as v, generate_subscripts(embedding,1)-1 as pos from embeddings), q as (select vec_id, clip, frame, cast(floor((v::double+1)*127.5) as int) as luma, (pos%8)::int as px, (pos//8)::int as py from p)"
_BACK = _PIX + ", b as (select clip, px, py, list_sort(list(luma))[count(*)//2+1] as background from q group by 1,2,3)"
_FORE = _BACK + ", f as (select q.*, background from q join b using (clip,px,py) where abs(luma-background)>=24)"


def planes(spark, d):
    """vec_id, clip, frame, luma: embeddings as 8 x 8 planes, ten to a clip."""
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).alias("clip"), (F.col("vec_id") % 10).alias("frame"), v.alias("luma"))


def pixels(spark, d):
    return I.explode_pixels(planes(spark, d), ["vec_id", "clip", "frame"], "luma", 8)


def frames(spark, d):
    """Clips of luma frames in the shape that the detectors take."""
    p = planes(spark, d)
    return p.select(F.col("clip").cast("string").alias("clip_id"), F.col("frame").cast("int").alias("frame_index"), (F.col("frame") / 120.0).alias("t_s"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("luma").alias("pixels"))


def colour_frames(spark, d):
    """The same as packed colours: red where luma is high."""
    f = frames(spark, d)
    return f.withColumn("pixels", F.transform("pixels", lambda v: F.when(v >= 150, -65536).otherwise(-16777216)))


@query("pixel_median_background", _BACK + " select * from b")
def pixel_median_background(spark, d):
    return I.median_background(pixels(spark, d), "clip")


@query("foreground_mask", _FORE + " select vec_id, px, py, luma, background from f")
def foreground_mask(spark, d):
    p = pixels(spark, d)
    return I.foreground(p, I.median_background(p, "clip"), "clip", 24).select("vec_id", "px", "py", "luma", "background")


@query("persistent_pixels", _FORE + ", n as (select clip, count(*) as n from embeddings e, (select vec_id, vec_id//10 as clip from embeddings) c where e.vec_id=c.vec_id group by 1) select clip, px, py, count(*) as hits from f join n using (clip) group by clip, px, py, n having count(*)>=greatest(3,ceil(n*0.3))")
def persistent_pixels(spark, d):
    p = pixels(spark, d)
    fg = I.foreground(p, I.median_background(p, "clip"), "clip", 24)
    return I.persistent_pixels(fg, planes(spark, d), "clip", 3, 0.3)


@query("shift_grid_argmin", _PIX + """, s as (select a.vec_id, dx, dy, avg(abs(a.luma-b.luma)) as cost from q a, generate_series(-2,2) x(dx), generate_series(-2,2) y(dy), q b where b.clip=a.clip and b.vec_id=a.vec_id+1 and b.px=a.px+dx and b.py=a.py+dy group by 1,2,3), r as (select *, row_number() over (partition by vec_id order by cost, abs(dx)+abs(dy), dy, dx) as rn from s)
select vec_id, dx::int as dx, dy::int as dy, round(cost,6)+0.0 as cost from r where rn=1""")
def shift_grid_argmin(spark, d):
    """Every frame against the next one of its clip."""
    p = pixels(spark, d)
    s = I.shift_scores(p, p.where("frame > 0").withColumn("vec_id", F.col("vec_id") - 1), "vec_id", 2)
    return s.select("vec_id", "dx", "dy", tidy("cost").alias("cost"))


@query("component_stats", _PIX + """, l as (select vec_id, luma//40 as lab, px, py from q), g as (select vec_id, lab, count(*) as area, avg(px) as cx, avg(py) as cy, min(px) as l, max(px) as r, min(py) as t, max(py) as b, var_pop(px) as vx, var_pop(py) as vy, covar_pop(px,py) as cv from l group by 1,2)
select vec_id, lab, area, round(cx,6)+0.0 as cx, round(cy,6)+0.0 as cy, round(area/((r-l+1)*(b-t+1)::double),6)+0.0 as compactness, round(greatest(1.0,sqrt(greatest((vx+vy)/2+sqrt(((vx-vy)/2)*((vx-vy)/2)+cv*cv),1e-6)/greatest((vx+vy)/2-sqrt(((vx-vy)/2)*((vx-vy)/2)+cv*cv),1e-6))),4)+0.0 as axis_ratio from g""")
def component_stats(spark, d):
    s = I.component_stats(pixels(spark, d).withColumn("lab", F.floor(F.col("luma") / 40)), ["vec_id", "lab"])
    return s.select("vec_id", "lab", "area", tidy("cx").alias("cx"), tidy("cy").alias("cy"), tidy("compactness").alias("compactness"), tidy("axis_ratio", 4).alias("axis_ratio"))


@query("plane_aggregates", _PIX + """ select vec_id, round(stddev_pop(luma),6)+0.0 as sd, round(((degrees(atan2(avg(sin(radians(luma*1.0))),avg(cos(radians(luma*1.0)))))%360)+360)%360,4)+0.0 as circular, round(avg(case when luma>=150 then 1.0 else 0.0 end),6)+0.0 as share from q group by 1""")
def plane_aggregates(spark, d):
    a = F.radians(F.col("luma").cast("double"))
    g = pixels(spark, d).groupBy("vec_id")
    return g.agg(tidy(F.stddev_pop("luma")).alias("sd"), tidy(normalise_hue(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))))), 4).alias("circular"), tidy(F.avg((F.col("luma") >= 150).cast("double"))).alias("share"))


@query("source_validity", _PIX + ", f as (select clip, frame, sum(luma) as s, count(*) as n, count(*) filter (luma>=150) as b from q group by 1,2) select clip, round(sum(s)/sum(n)::double,9)+0.0 as mean_luma, round(sum(b)/sum(n)::double,9)+0.0 as bright_share, round(max(s/n::double),9)+0.0 as brightest_frame, case when max(s/n::double)<4 then 'BLACK_FRAMES' else 'VALID' end as verdict from f group by 1")
def source_validity(spark, d):
    v = I.source_validity(pixels(spark, d), "clip", "frame", 150)
    return v.select("clip", *[tidy(c, 9).alias(c) for c in ("mean_luma", "bright_share", "brightest_frame")], "verdict")


@query("structure_pixels", _PIX + ", n as (select vec_id, px, py, greatest(abs(luma-lag(luma) over h), abs(luma-lead(luma) over h), abs(luma-lag(luma) over v), abs(luma-lead(luma) over v)) as top from q window h as (partition by vec_id, py order by px), v as (partition by vec_id, px order by py)) select vec_id, count(*) filter (top>=24) as structure from n group by 1")
def structure_pixels(spark, d):
    h, v = W.partitionBy("vec_id", "py").orderBy("px"), W.partitionBy("vec_id", "px").orderBy("py")
    top = F.greatest(*[F.abs(F.col("luma") - f("luma").over(w)) for w in (h, v) for f in (F.lag, F.lead)])
    return pixels(spark, d).withColumn("top", top).groupBy("vec_id").agg(F.count_if(F.col("top") >= 24).alias("structure"))


@query("plane_downscale", "with p as (select vec_id, [cast(floor((x::double+1)*127.5) as int) for x in embedding] as l from embeddings) select vec_id, array_to_string([l[(i//4*8//4)*8+(i%4*8//4)+1] for i in range(0,16)],',') as small from p")
def plane_downscale(spark, d):
    return planes(spark, d).select("vec_id", F.array_join(C.downscale("luma", F.lit(8), F.lit(8), 4, 4), ",").alias("small"))


@query("sequence_sha256", "with r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)-1 as o, concat_ws(',', l_partkey, l_suppkey) as s from lineitem) select l_orderkey, count(*)::int as rows, sha256(string_agg(s, ';' order by o)) as identity from r group by 1")
def sequence_sha256(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("o"))
    return I.sequence_identity(li, "l_orderkey", "o", "l_partkey", "l_suppkey")


@query("pixel_signatures")
def pixel_signatures(spark, d):
    return I.signatures(colour_frames(spark, d), ["clip_id", "frame_index"], "pixels")


@query("signature_verdict")
def signature_verdict(spark, d):
    return I.signature_verdict(I.signatures(frames(spark, d), ["clip_id", "frame_index"], "pixels"), "clip_id", "frame_index", 10)


@query("level_reference", EV + """, g as (select user_id, count(*) as n, avg(x/100.0) as x, avg(9.5+y*0) as y, avg(y*0+0.5) as z from e group by 1) select user_id, n, case when n<12 then 'TOO_FEW_SAMPLES' when not sqrt(x*x+y*y+z*z) between 6 and 13 then 'BAD_GRAVITY' end as reason, case when n>=12 then round(degrees(atan2(x,y)),4)+0.0 end as roll, case when n>=12 then round(degrees(atan2(z,sqrt(x*x+y*y))),4)+0.0 end as pitch from g""")
def level_reference(spark, d):
    g = events(spark, d).withColumns({"gx": F.col("x") / 100.0, "gy": 9.5 + F.col("y") * 0, "gz": F.col("y") * 0 + 0.5})
    s = I.level_snapshot(g, "user_id", "gx", "gy", "gz", None)
    return s.select("user_id", "n", "reason", tidy("roll", 4).alias("roll"), tidy("pitch", 4).alias("pitch"))


@query("rolling_level", EV + " select user_id, event_id, round(degrees(atan2(avg(x) over w, avg(y+1) over w)),4)+0.0 as roll from e window w as (partition by user_id order by us rows between 29 preceding and current row)")
def rolling_level(spark, d):
    r = I.rolling_level(events(spark, d).withColumn("y1", F.col("y") + 1), "user_id", "us", "x", "y1")
    return r.select("user_id", "event_id", tidy("roll", 4).alias("roll"))


@query("throttled_level", EV + ", n as (select user_id, event_id, us, row_number() over (partition by user_id order by us) as n, (us-min(us) over (partition by user_id))//86400000000 as slot from e), k as (select *, row_number() over (partition by user_id, slot order by us) as rn from n where n>=30) select user_id, event_id from k where rn=1")
def throttled_level(spark, d):
    return S.throttle(events(spark, d), "user_id", "us", "us", 86_400_000_000).select("user_id", "event_id")


# --- blobs and tracks


def blob_rows(spark, d):
    """All events as blob rows for the native line search: two to a frame, twelve frames to a clip, a user's events in as many clips as they fill."""
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("us")) - 1
    e = events(spark, d).withColumn("rn", rn)
    clip, frame = F.concat_ws("-", "user_id", F.floor(F.col("rn") / 24)), F.floor(F.col("rn") % 24 / 2)
    return e.select(clip.alias("clip"), frame.alias("frame_order"), F.col("event_id").alias("blob_id"), (frame / 120.0).alias("t"), "x", "y")


_BL = EV + ", b as (select concat_ws('-', user_id, rn//24) as clip, rn%24//2 as frame_order, event_id as blob_id, (rn%24//2)/120.0 as t, x, y from (select *, row_number() over (partition by user_id order by us)-1 as rn from e))"
_HY = _BL + ", h as (select a.clip, a.blob_id as a_id, b.blob_id as b_id, a.frame_order as fa, b.frame_order as fb, a.x as ax, a.y as ay, b.x as bx, b.y as by_, abs(b.x-a.x) as travel, sign(b.x-a.x) as dir, sqrt(power(b.x-a.x,2)+power(b.y-a.y,2)) as span from b a join b b on a.clip=b.clip and a.frame_order<b.frame_order where abs(b.x-a.x)>=9 and abs(b.x-a.x)/(b.t-a.t)>=240)"


@query("pair_hypotheses", _HY + " select clip, a_id as a_blob_id, b_id as b_blob_id, round(travel,6)+0.0 as travel, dir as direction, round(span,6)+0.0 as span from h")
def pair_hypotheses(spark, d):
    h = T.line_hypotheses(blob_rows(spark, d), "clip")
    return h.select("clip", "a_blob_id", "b_blob_id", tidy("travel").alias("travel"), "direction", tidy("span").alias("span"))


@query("best_inlier_per_frame", _HY + """, i as (select h.clip, a_id, b_id, b.frame_order, b.blob_id, abs((by_-ay)*b.x-(bx-ax)*b.y+bx*ay-by_*ax)/span as dist, (b.x-ax)*dir as along, travel from h join b on b.clip=h.clip and b.frame_order between fa and fb), k as (select *, row_number() over (partition by clip, a_id, b_id, frame_order order by dist, blob_id) as rn from i where dist<=8 and along between -1 and travel+1)
select clip, a_id as a_blob_id, b_id as b_blob_id, count(*) as inliers, round(sum(dist),4)+0.0 as dist from k where rn=1 group by 1,2,3 having count(*)>=4""")
def best_inlier_per_frame(spark, d):
    b = blob_rows(spark, d)
    i = T.best_inliers(T.line_hypotheses(b, "clip"), b, "clip")
    g = i.groupBy("clip", "a_blob_id", "b_blob_id").agg(F.count(F.lit(1)).alias("inliers"), tidy(F.sum("distance"), 4).alias("dist"))
    return g.where("inliers >= 4")


@query("subwindow_scores", _BL + """, o as (select clip, frame_order as f, avg(x) as x from b group by 1,2), s as (select *, x-lag(x) over (partition by clip order by f) as dx from o), w as (select a.clip, a.f as f0, b.f as f1, b.x-a.x as travel from o a join o b on a.clip=b.clip and b.f between a.f+3 and a.f+23)
select w.clip, f0, f1, round(travel,6)+0.0 as travel, round(max(abs(dx)),6)+0.0 as biggest from w join s on s.clip=w.clip and s.f>f0 and s.f<=f1 group by 1,2,3,4""")
def subwindow_scores(spark, d):
    o = blob_rows(spark, d).groupBy("clip", F.col("frame_order").alias("f")).agg(F.avg("x").alias("x"))
    return T.subwindows(o, "clip", "f", "x").select("clip", F.col("first").alias("f0"), F.col("last").alias("f1"), tidy("travel").alias("travel"), tidy("biggest").alias("biggest"))


@query("scout_sessions", EV + """, h as (select user_id, us//3600000000 as f, x, y from e), r as (select *, sum(case when f-p<=24 then 0 else 1 end) over (partition by user_id order by f, x rows unbounded preceding) as run from (select *, lag(f) over (partition by user_id order by f, x) as p from h)), g as (select user_id, run, min(f) as first, max(f) as last, count(*) as rows, avg(y) as ma from r group by 1,2),
k as (select *, row_number() over (partition by user_id order by last-first desc, rows desc, ma desc, run) as rn from g where rows>=3) select user_id, run, first, last, rows, last-first as travel from k where rn=1""")
def scout_sessions(spark, d):
    h = events(spark, d).select("user_id", F.floor(F.col("us") / 3_600_000_000).alias("f"), "x", "y")
    r = T.gap_runs(h, "user_id", "f", 24)
    return T.best_run(r.withColumn("z", F.col("f")), "user_id", "f", "z", "y")


@query("scout_runs_by_gap", EV + ", h as (select user_id, us//3600000000 as f, count(*) as n from e group by 1,2), g as (select *, case when f-lag(f) over (partition by user_id order by f)<=24 then 0 else 1 end as new from h) select user_id, f, sum(new) over (partition by user_id order by f) as run from g")
def scout_runs_by_gap(spark, d):
    h = events(spark, d).select("user_id", F.floor(F.col("us") / 3_600_000_000).alias("f")).distinct()
    return T.gap_runs(h, "user_id", "f", 24)


@query("topk_per_group", EV + ", r as (select user_id, event_id, row_number() over (partition by user_id order by x desc, event_id) as rank from e) select * from r where rank<=6")
def topk_per_group(spark, d):
    return T.top_k(events(spark, d).select("user_id", "event_id", "x"), ["user_id"], 6, F.desc("x"), F.col("event_id")).drop("x")


@query("budget_gate", "with f as (select l_orderkey%500 as clip, l_suppkey as frame, count(*) as n from lineitem group by 1,2) select clip, max(n) as most, sum(n)::bigint as all_blobs, case when max(n)>2 then 'FRAME_BUDGET' when sum(n)>12 then 'WINDOW_BUDGET' end as reason from f group by 1")
def budget_gate(spark, d):
    b = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("clip"), "l_suppkey").agg(F.collect_list("l_linenumber").alias("blobs"))
    return T.budget_reason(b, "clip", 2, 12).select("clip", F.col("most").cast("long").alias("most"), F.col("all").alias("all_blobs"), "reason")


@query("shape_penalty", "select l_orderkey, l_linenumber, round(greatest(0.0, greatest(l_quantity%9+1,l_linenumber)/greatest(least(l_quantity%9+1,l_linenumber),1)-4.0)+2*greatest(0.0,0.35-l_discount*5),6)+0.0 as penalty from lineitem")
def shape_penalty(spark, d):
    li = table(spark, d, "lineitem").withColumns({"z": F.lit(0), "r": F.col("l_quantity") % 9, "b": F.col("l_linenumber") - 1, "c": F.col("l_discount") * 5})
    return li.select("l_orderkey", "l_linenumber", tidy(T.shape_penalty("z", "z", "r", "b", "c")).alias("penalty"))


@query("track_consistency", EV + ", s as (select user_id, (x+10)/lag(x+10) over w as r, abs(y*10-lag(y*10) over w) as h from e window w as (partition by user_id order by us)), m as (select user_id, max(greatest(r,1.0/r)) as a, max(least(h,360.0-h)) as b from s group by 1) select user_id, round(a,6)+0.0 as size_swing, round(b,6)+0.0 as hue_swing, a<=2.0 and b<=40.0 as consistent from m")
def track_consistency(spark, d):
    e = events(spark, d).withColumns({"a": F.col("x") + 10, "h": F.col("y") * 10})
    c = T.consistency(e, "user_id", "us", "a", "h")
    return c.select("user_id", tidy("size_swing").alias("size_swing"), tidy("hue_swing").alias("hue_swing"), "consistent")


@query("blob_detection")
def blob_detection(spark, d):
    b = I.detect_blobs(colour_frames(spark, d), I.BlobConfig())
    return b.select("clip_id", "frame_index", "kind", F.size("blobs").alias("n"), F.aggregate("blobs", F.lit(0), lambda a, x: a + x.area).alias("area"))


@query("single_blob_track")
def single_blob_track(spark, d):
    return T.extract_track(I.single_blob(I.detect_blobs(colour_frames(spark, d), I.BlobConfig(min_area=2))))


@query("motion_detector")
def motion_detector(spark, d):
    b = I.detect_in_clips(frames(spark, d), "motion", I.MotionConfig(max_shift=9.0))
    return b.select("clip_id", "frame_index", "kind", F.size("blobs").alias("n"))


@query("physical_detector")
def physical_detector(spark, d):
    b = I.detect_in_clips(frames(spark, d), "physical", I.MotionConfig(), 150)
    return b.select("clip_id", "frame_index", "kind", F.size("blobs").alias("n"))


@query("candidate_reduction")
def candidate_reduction(spark, d):
    b = I.detect_in_clips(frames(spark, d), "motion", I.MotionConfig(max_shift=9.0, foreground=12))
    r = T.reduce_candidates(b, T.TrackConfig(jump=8.0))
    return r.groupBy("clip_id").agg(F.min("reason").alias("reason"), F.count("x").alias("rows"))


@query("motion_scout")
def motion_scout(spark, d):
    p = pixels(spark, d)
    fg = I.foreground(p, I.median_background(p, "clip"), "clip", 24)
    hits = fg.groupBy(F.col("clip").alias("clip_id"), F.col("frame").cast("int").alias("frame_index")).agg(F.avg("px").alias("x"), F.avg("py").alias("y"), F.count(F.lit(1)).cast("double").alias("area"))
    return Q.motion_scout(hits, least_travel=0.5).select("clip_id", "first", "last", "rows")


@query("frames_to_estimate")
def frames_to_estimate(spark, d):
    f = colour_frames(spark, d)
    cal = f.select("clip_id").distinct().withColumns({"pixels": F.lit(3.0), "feet": F.lit(1.0)})
    return Q.estimate_from_frames(f, cal, I.BlobConfig()).select("clip_id", "status", "reason", tidy("mph", 4).alias("mph"))


@query("recorded_estimate")
def recorded_estimate(spark, d):
    f = frames(spark, d)
    cal = f.select("clip_id").distinct().withColumns({"pixels": F.lit(3.0), "feet": F.lit(1.0)})
    return Q.recorded_estimate(f, cal, "motion", motion=I.MotionConfig(max_shift=9.0, foreground=12)).select("clip_id", "status", "reason", tidy("mph", 4).alias("mph"))


@query("import_estimate")
def import_estimate(spark, d):
    f = colour_frames(spark, d)
    cal = f.select("clip_id").distinct().withColumns({"pixels": F.lit(3.0), "feet": F.lit(1.0)})
    t = G.nominal_times(f.where("clip_id <> '3' or frame_index < 5").select("clip_id", "frame_index"), "clip_id", "frame_index", F.lit(1 / 120)).select("clip_id", "t")
    return Q.import_estimate(f, t, cal, I.BlobConfig()).select("clip_id", "status", "reason", "provenance")


@query("direct_proof")
def direct_proof(spark, d):
    f = frames(spark, d)
    direct = f.select("clip_id", (F.col("frame_index") * 8_333_333).cast("long").alias("a"))
    sensor = f.select("clip_id", (F.col("frame_index") * 8_333_333 + F.when(F.col("clip_id").cast("int") % 2 == 0, 0).otherwise(5000)).cast("long").alias("b"))
    return Q.direct_proof(direct, sensor, f, "clip_id", "a", "b", 8_333_333, 10)


@query("proof_document")
def proof_document(spark, d):
    f = frames(spark, d)
    return Q.proof_frames(f, f.where("frame_index % 4 = 1"), "clip_id", 6)


@query("detector_trace")
def detector_trace(spark, d):
    b = I.detect_blobs(colour_frames(spark, d), I.BlobConfig())
    return Q.detector_trace(b, b.where(F.size("blobs") == 1))


# --- flight


def launches(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_retailprice") / 50).alias("speed"), (F.col("p_size").cast("double") * 2.5 - 15).alias("angle"), (F.col("p_partkey") % 3 * 0.6).alias("height"), (F.col("p_partkey") % 5 * 600.0 - 600).alias("rpm"))


@query("trajectory_summary")
def trajectory_summary(spark, d):
    t = B.trajectory_summary(launches(spark, d), "p_partkey", "speed", "angle", "height", "rpm")
    return t.select("p_partkey", "status", "reason", tidy("carry_m", 4).alias("carry_m"), tidy("apex_m", 4).alias("apex_m"), tidy("hang_s", 4).alias("hang_s"))


@query("trajectory_samples")
def trajectory_samples(spark, d):
    t = B.trajectory_samples(launches(spark, d), "p_partkey", "speed", "angle", "height", "rpm", every=200)
    return t.select("p_partkey", "step", tidy("t", 4).alias("t"), tidy("x", 4).alias("x"), tidy("y", 4).alias("y"))


@query("carry_range")
def carry_range(spark, d):
    m = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 30).alias("mph"), (F.col("p_size").cast("double")).alias("angle"))
    return B.carry_range(m, "p_partkey", "mph", "angle").select("p_partkey", "line")


# --- folds that also run as streams


@query("import_workflow")
def import_workflow(spark, d):
    names = F.array(*[F.lit(x) for x in S.IMPORT_RULES])
    e = events(spark, d)
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 10 + 1).cast("int")).alias("event"), F.when(F.col("event_id") % 3 == 0, "NO_READ").otherwise(F.col("event_type")).alias("payload"))
    return S.fold(rows, "import")


@query("delivery_once", "with r as (select o_custkey, o_orderkey, o_custkey%3 as gen, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) select o_custkey, o_orderkey from r where rn=1")
def delivery_once(spark, d):
    o = table(spark, d, "orders").withColumn("gen", F.col("o_custkey") % 3)
    return S.accept_once(o, "o_custkey", "gen", "o_orderkey").select("o_custkey", "o_orderkey")


@query("impact_chunks")
def impact_chunks(spark, d):
    from chronotrack.operators.audio import TriggerConfig

    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", (F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1).alias("i"))
    amp = F.when(F.col("l_quantity") == 50, 900).otherwise(F.col("l_quantity")).cast("short")
    c = li.groupBy(F.col("l_suppkey").cast("string").alias("session_id"), F.floor(F.col("i") / 32).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("i", amp.alias("a")))).alias("s"))
    rows = c.select("session_id", "seq", F.lit("samples").alias("kind"), F.transform("s", lambda x: x.a).alias("amps"), F.lit(None).cast("long").alias("ready"), F.lit(None).cast("long").alias("accept"))
    return M.detect_batch(rows, TriggerConfig(baseline=20, window=4, peak_delta=100, floor_rms=25.0, ready=100, accept=120, longest=20_000, actionable=5_000))


# --- modes and contracts


_MO = "with r as (select l_suppkey%9 as cam, [1280,1920,640][1+l_partkey%3] as w, [720,1080,480][1+l_partkey%3] as h, case when l_linenumber%2=0 then 120 else 240 end as high, case when l_orderkey%4=0 then (case when l_linenumber%2=0 then 120 else 240 end) else (l_orderkey%90)::int end as low, l_orderkey*10000+l_partkey as seq from lineitem)"


def _ranges(spark, d):
    li = table(spark, d, "lineitem")
    high = F.when(F.col("l_linenumber") % 2 == 0, 120).otherwise(240)
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("l_partkey") % 3).cast("int"))
    return li.select((F.col("l_suppkey") % 9).alias("cam"), pick(1280, 1920, 640).alias("w"), pick(720, 1080, 480).alias("h"), high.alias("high"), F.when(F.col("l_orderkey") % 4 == 0, high).otherwise(F.col("l_orderkey") % 90).cast("int").alias("low"), (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("seq"))


@query("mode_mapping", _MO + ", m as (select cam, w, h, high as fps, min_by(low, row(case when low<>high then 1 else 0 end, abs(low-high), seq)) as low from r where w in (1280,1920) group by 1,2,3,4) select cam, w, h, fps, low, low=fps as recordable from m")
def mode_mapping(spark, d):
    return Y.map_modes(_ranges(spark, d), ["cam"]).select("cam", "w", "h", "fps", "low", "recordable")


@query("default_mode", _MO + ", m as (select cam, w, h, high as fps, bool_or(low=high) as fixed from r where w in (1280,1920) and high=120 group by 1,2,3,4) select cam, min(w) as w from m where fixed group by 1")
def default_mode(spark, d):
    return Y.default_mode(Y.map_modes(_ranges(spark, d), ["cam"]), "cam").select("cam", "w")


@query("capture_start", "select o_orderkey, case when o_orderstatus='O' then 'CAPTURE_BUSY' when not (o_custkey%2=0 and o_custkey%3=0) then 'UNSUPPORTED_MODE' end as reason from orders")
def capture_start(spark, d):
    o = table(spark, d, "orders")
    req = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "BUSY").otherwise("IDLE").alias("state"), F.lit(1).alias("cam"), F.lit(1280).alias("w"), F.lit(720).alias("h"), F.when(F.col("o_custkey") % 2 == 0, 120).otherwise(240).alias("fps"), F.when(F.col("o_custkey") % 3 == 0, 120).otherwise(60).alias("low"))
    modes = spark.createDataFrame([(1, 1280, 720, 120, 120, True)], "cam int, w int, h int, fps int, low int, recordable boolean")
    return Y.start_reason(req, modes, ["cam"]).select("o_orderkey", "reason")


@query("range_flatten", "select s_suppkey, w, h, low, high from supplier, (values (1280,720),(1920,1080)) z(w,h), (values (30,120),(120,120),(60,240)) r(low,high)")
def range_flatten(spark, d):
    z = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in Y.SIZES])
    r = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ((30, 120), (120, 120), (60, 240))])
    return Y.flatten_ranges(table(spark, d, "supplier").select("s_suppkey", z.alias("z"), r.alias("r2")), "s_suppkey", "z", "r2")


@query("proof_variants", "select id, surfaces, case when contains(surfaces,'COMPANION')<>starts_with(shape,'COMPANION') then 'SHAPE_MISMATCH' end as reason from (values ('companion-gl','COMPANION_ENCODER','COMPANION_ENCODER,DIRECT_GL_READBACK'),('direct-gl-first','COMPANION_ENCODER_REVERSED','DIRECT_GL_READBACK,COMPANION_ENCODER'),('pbo-gl-readback','COMPANION_ENCODER_REVERSED','DIRECT_GL_READBACK,COMPANION_ENCODER'),('direct-gl-only','DIRECT_ONLY','DIRECT_GL_READBACK'),('constrained-image-reader','CONSTRAINED_IMAGE_READER','IMAGE_READER'),('constrained-private-image-reader','CONSTRAINED_PRIVATE_IMAGE_READER','IMAGE_READER'),('standard-image-reader','STANDARD_IMAGE_READER','IMAGE_READER')) v(id,shape,surfaces)")
def proof_variants(spark, d):
    v = Y.variants(spark)
    return v.select("id", "surfaces", Y.variant_reason(F.col("shape"), F.col("constrained"), F.col("surfaces")).alias("reason"))


@query("workflow_readiness", "select c_custkey, case when c_custkey%2=0 then 'PERMISSION' when c_custkey%3=0 then 'GEOMETRY' when c_custkey%5=0 then 'SCALE' when c_custkey%7=0 then 'LEVEL' when c_custkey%11=0 then 'COLOUR' end as missing, case when c_nationkey=0 then 'NO_FRAME' when c_acctbal<0 then 'INVALID_SAMPLE' when c_nationkey<5 then 'REGION_OUTSIDE' end as colour from customer")
def workflow_readiness(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    a = Y.readiness(k % 2 != 0, k % 3 != 0, k % 5 != 0, k % 7 != 0, k % 11 != 0)
    b = Y.colour_readiness(n, n, F.when(F.col("c_acctbal") < 0, 400.0).otherwise(20.0), F.lit(0.5), F.lit(0.5), F.lit(4), F.lit(9))
    return table(spark, d, "customer").select("c_custkey", a.alias("missing"), b.alias("colour"))


@query("success_contract", """select event_id, case when event_id%17=0 then 'NON_FINITE_RESULT' when event_id%13=0 then 'INSUFFICIENT_DETECTIONS' when event_id%11=0 then 'BAD_TIMESTAMPS' when event_id%7=0 then 'EXCESSIVE_RESIDUAL' when event_id%5=0 then 'AMBIGUOUS_TRACK' when event_id%3=0 then 'PLANAR_ASSUMPTION_VIOLATED' when event_id%2=0 then 'BAD_CALIBRATION' end as reason from events""")
def success_contract(spark, d):
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("Motion in the Calibrated image plane")))
    r = Y.success_reason(
        F.when(e % 17 == 0, float("nan")).otherwise(60.0), F.lit(10.0), F.lit(4.0), F.lit(9), F.when(e % 13 == 0, 0).otherwise(6), F.when(e % 11 == 0, F.lit(None).cast("double")).otherwise(0.01), F.lit(0.02), F.when(e % 7 == 0, -1.0).otherwise(0.5),
        F.when(e % 5 != 0, "HIGH"), said, F.lit("REAL"), F.when(e % 2 == 0, "BALL_DIAMETER_SELF_CALIBRATION").otherwise("DISTANCE_CALIBRATION"),
    )
    return table(spark, d, "events").select("event_id", r.alias("reason"))


@query("reason_tables", "with t as (select user_id, event_id, case when user_id%3=1 then null when event_id%4=0 then 'MANY_TO_ONE_MAPPING' when event_id%4=1 then 'RESIDUAL_TOO_LARGE' when event_id%4=2 then 'NON_MONOTONIC_MAPPING' end as r from events) select user_id, case when bool_or(r='RESIDUAL_TOO_LARGE') then 'RESIDUAL_TOO_LARGE' when bool_or(r='MANY_TO_ONE_MAPPING') then 'MANY_TO_ONE_MAPPING' when bool_or(r='NON_MONOTONIC_MAPPING') then 'NON_MONOTONIC_MAPPING' else 'NO_CANDIDATE' end as worst from t group by 1")
def reason_tables(spark, d):
    m = F.col("event_id") % 4
    r = F.when(F.col("user_id") % 3 == 1, None).when(m == 0, "MANY_TO_ONE_MAPPING").when(m == 1, "RESIDUAL_TOO_LARGE").when(m == 2, "NON_MONOTONIC_MAPPING")
    return table(spark, d, "events").groupBy("user_id").agg(Y.most_specific(r).alias("worst"))


@query("reason_translation", "select event_id, case event_id%3 when 0 then 'BAD_TIMESTAMPS' when 1 then 'EXCESSIVE_RESIDUAL' end as reason from events")
def reason_translation(spark, d):
    r = F.when(F.col("event_id") % 3 == 0, "BAD_TIMESTAMP").when(F.col("event_id") % 3 == 1, "EXCESSIVE_RESIDUAL")
    return table(spark, d, "events").select("event_id", Y.translate(r, Y.ESTIMATE_REASONS, "UNKNOWN").alias("reason"))


@query("patch_colour", _PIX + ", n as (select vec_id, floor(avg(luma))::int as m from q where abs(px-2)<=1 and abs(py-5)<=1 group by 1) select vec_id, 0.0 as hue, 0.0 as saturation, round(m/255.0,6)+0.0 as value from n")
def patch_colour(spark, d):
    p = pixels(spark, d).withColumn("argb", C.pack(F.lit(255), "luma", "luma", "luma"))
    c = Y.patch_colour(p, ["vec_id"], F.lit(0.25), F.lit(0.7), 8, 8, 1)
    return c.select("vec_id", tidy("hue").alias("hue"), tidy("saturation").alias("saturation"), tidy("value").alias("value"))


@query("yuv_planes")
def yuv_planes(spark, d):
    from chronotrack.sources.media import decode_yuv

    grey = F.expr("repeat('80', 32)")
    data = F.unhex(F.concat(F.aggregate(F.transform("luma", lambda v: F.lpad(F.hex(v), 2, "0")), F.lit(""), lambda a, b: F.concat(a, b)), grey))
    raw = planes(spark, d).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(8).alias("stride"), F.lit(8).alias("slice_height"), F.lit("NV12").alias("layout"), data.alias("data"))
    y = decode_yuv(raw, ["vec_id"], to=(4, 4), luma_only=True).select("vec_id", F.array_join("pixels", ",").alias("luma"))
    return y.join(decode_yuv(raw, ["vec_id"]).select("vec_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("argb_sum")), "vec_id")
