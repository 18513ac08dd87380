"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrack.functions import colour as C
from chronotrack.functions import numeric as N
from chronotrack.functions import text as T
from chronotrack.plans.catalog import query, table


def _r(e, d=6):
    return N.tidy(e, d)


@query("units", "select p_partkey, round(p_retailprice/12.0,6)+0.0 as feet_in, round(p_retailprice/30.48,6)+0.0 as feet_cm, round(p_retailprice*0.6818182,6)+0.0 as mph, case when p_size>5 then round(p_retailprice/(p_size-5),6)+0.0 end as fps, round(p_retailprice*2.2369362920544,6)+0.0 as mph_m, round(p_retailprice/3.280839895013123,6)+0.0 as mps from part")
def units(spark, d):
    p = F.col("p_retailprice")
    fps = N.pixels_to_feet_per_second(p, F.col("p_size") - 5)
    return table(spark, d, "part").select("p_partkey", _r(N.inches_to_feet(p)).alias("feet_in"), _r(N.centimetres_to_feet(p)).alias("feet_cm"), _r(N.feet_per_second_to_mph(p)).alias("mph"), _r(fps).alias("fps"), _r(N.metres_per_second_to_mph(p)).alias("mph_m"), _r(N.feet_per_second_to_metres(p)).alias("mps"))


@query("calibration", """select c_custkey, case when c_acctbal<=0 then 'INVALID_PIXEL_DISTANCE' when c_nationkey-3<=0 then 'INVALID_REAL_DISTANCE' end as reason, case when c_acctbal>0 and c_nationkey>3 then round(c_acctbal/(c_nationkey-3),6)+0.0 end as scale,
case when sqrt(c_acctbal*c_acctbal+9)>0 and c_nationkey>0 then round(sqrt(c_acctbal*c_acctbal+9)/c_nationkey,6)+0.0 end as from_points from customer""")
def calibration(spark, d):
    a, f = F.col("c_acctbal"), (F.col("c_nationkey") - 3).cast("double")
    known, _ = N.known_distance_scale(F.lit(0.0), F.lit(0.0), a, F.lit(3.0), F.col("c_nationkey").cast("double"))
    return table(spark, d, "customer").select("c_custkey", N.calibration_reason(a, f).alias("reason"), _r(N.pixels_per_foot(a, f)).alias("scale"), _r(known).alias("from_points"))


@query("depth_scale", """select p_partkey, case when (p_size/10.0)>=0.1 and (p_size/10.0)<=10 then round(p_retailprice*(p_size/10.0),6)+0.0 end as scale, (p_size/10.0)<0.5 or (p_size/10.0)>2.0 as warn from part""")
def depth_scale(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", _r(N.depth_scale("p_retailprice", F.lit(10.0), s)[0]).alias("scale"), N.depth_warning(F.lit(10.0), s).alias("warn"))


_MOD = "((({x}) % 360.0) + 360.0) % 360.0"


@query("angle_normalise", f"""with a as (select event_id, value*50-700 as v from events) select event_id, case when abs(180.0-{_MOD.format(x='180.0-v')})<1e-9 then 0.0 else round(180.0-{_MOD.format(x='180.0-v')},6)+0.0 end as signed, round({_MOD.format(x='v')},6)+0.0 as hue,
round(least(abs({_MOD.format(x='v')}-90.0),360.0-abs({_MOD.format(x='v')}-90.0)),6)+0.0 as distance, case when (event_id%7*45)%90=0 then (event_id%7*45)%360 end as turn from a""")
def angle_normalise(spark, d):
    v = F.col("value") * 50 - 700
    return table(spark, d, "events").select("event_id", _r(N.normalise_signed_degrees(v)).alias("signed"), _r(N.normalise_hue(v)).alias("hue"), _r(N.circular_distance(v, F.lit(90.0))).alias("distance"), N.right_angle(F.col("event_id") % 7 * 45).alias("turn"))


@query("launch_angle", "select event_id, round(degrees(atan2(-(value-5), abs(value-20))),6)+0.0 as angle, round(180.0-((180.0-(degrees(atan2(-(value-5), abs(value-20)))-10.0))%360.0),6)+0.0 as corrected from events")
def launch_angle(spark, d):
    a = N.launch_angle(F.col("value") - 20, F.col("value") - 5)
    return table(spark, d, "events").select("event_id", _r(a).alias("angle"), _r(N.correct_for_roll(a, F.lit(10.0))).alias("corrected"))


@query("clock_map", """select event_id, cast(floor(1e9/(event_id%200+30)+0.5) as bigint) as gap, case when event_id>=500 then 1000000000 + cast(trunc((event_id-500)*1000000000.0/48000) as bigint) end as ns,
case when event_id>=100 and event_id*10<=50000 then 7 + cast(floor((event_id*10-1000)::double*48000/1e9) as bigint) end as sample, cast(ceil((event_id%9)*(event_id%200+30)) as bigint)+greatest(event_id%200+30,30) as budget from events""")
def clock_map(spark, d):
    e, fps = F.col("event_id"), F.col("event_id") % 200 + 30
    sample = N.elapsed_ns_to_sample(e * 10, F.lit(7), F.lit(1000), F.lit(48000), F.lit(49000))
    return table(spark, d, "events").select("event_id", N.expected_gap_ns(fps).alias("gap"), N.sample_to_elapsed_ns(e, F.lit(500), F.lit(1000000000), F.lit(48000)).alias("ns"), sample.alias("sample"), N.sample_budget(e % 9, fps).alias("budget"))


@query("impact_windows", """select event_id, greatest(event_id*997-1000000,0) as lo, event_id*997+1000000 as hi, cast(floor(event_id*997*120/1e6) as bigint) as frame, least(cast(ceil((event_id%500*1000000)/(1e9/120)) as bigint),12) as margin from events""")
def impact_windows(spark, d):
    lo, hi, frame, margin = N.impact_window(F.col("event_id") * 997, F.lit(120), F.col("event_id") % 500 * 1000000)
    return table(spark, d, "events").select("event_id", lo.cast("long").alias("lo"), hi.alias("hi"), frame.alias("frame"), margin.alias("margin"))


@query("clamps", "select event_id, case when event_id-500<=0 then 2500 else least(event_id-500,8000) end as burst, least(350*pow(2,least(greatest(event_id%12,1),20)-1),2800)::bigint as backoff, least(greatest(ceil(120*(event_id%5000)/1000.0),1),240)::bigint as cap, abs(event_id%5-event_id%3) as mismatch, list_aggregate(generate_series(-(case when abs(event_id%5-event_id%3)<=1 then 1 else abs(event_id%5-event_id%3)+2 end), case when abs(event_id%5-event_id%3)<=1 then 1 else abs(event_id%5-event_id%3)+2 end),'count') as shifts from events")
def clamps(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", N.burst_ms(e - 500).alias("burst"), N.backoff_ms(e % 12).alias("backoff"), N.frame_cap(F.lit(120), e % 5000).alias("cap"), F.abs(e % 5 - e % 3).alias("mismatch"), F.size(N.shift_range(e % 5, e % 3)).cast("long").alias("shifts"))


@query("coord_transform", """with s as (select p_partkey, (p_size*7)%400 as x, (p_size*13)%300 as y, least(400/640.0,300/360.0) as k from part), t as (select *, (x-(400-640*k)/2.0)/(640*k) as nx, (y-(300-360*k)/2.0)/(360*k) as ny from s)
select p_partkey, case when nx between 0 and 1 and ny between 0 and 1 then round(nx,6)+0.0 end as nx, case when nx between 0 and 1 and ny between 0 and 1 then round(ny,6)+0.0 end as ny, round(1.0-y/300.0,6)+0.0 as rx, round(x/400.0,6)+0.0 as ry, least(greatest(cast(floor(x/400.0*640) as bigint),0),639) as px,
round((400-640*k)/2.0+(x/400.0)*640*k,6)+0.0 as vx from t""")
def coord_transform(spark, d):
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 % 400).alias("x"), (F.col("p_size") * 13 % 300).alias("y"))
    size = (F.lit(400), F.lit(300), F.lit(640), F.lit(360))
    nx, ny = N.view_to_normalised("x", "y", *size)
    u, v = F.col("x") / 400.0, F.col("y") / 300.0
    rx, ry = N.rotate_normalised(u, v, F.lit(90))
    return s.select("p_partkey", _r(nx).alias("nx"), _r(ny).alias("ny"), _r(rx).alias("rx"), _r(ry).alias("ry"), N.normalised_to_pixel(u, F.lit(640)).alias("px"), _r(N.normalised_to_view(u, v, *size)[0]).alias("vx"))


@query("working_size", """with s as (select p_partkey, p_size*97+1 as w, p_size*61+1 as h from part), k as (select *, least(1.0, 640.0/w, 360.0/h) as k from s) select p_partkey, greatest(cast(round_even(w*k,0) as bigint),1) as ww, greatest(cast(round_even(h*k,0) as bigint),1) as wh from k""")
def working_size(spark, d):
    w, h = F.col("p_size") * 97 + 1, F.col("p_size") * 61 + 1
    a, b = N.working_size(w, h)
    return table(spark, d, "part").select("p_partkey", a.alias("ww"), b.alias("wh"))


@query("padded_range", """with s as (select p_partkey, p_size%20 as f, p_size%20+3 as l, 60 as n from part), a as (select *, greatest(f-10,0) as a, least(l+10,n-1) as b from s), m as (select *, greatest(32-(b-a+1),0) as miss from a), q as (select *, least(a, cast(ceil(miss/2.0) as int)) as l0 from m), z as (select *, least(n-1-b, miss-l0) as r from q)
select p_partkey, (a-least(a,miss-r))::bigint as lo, (b+r)::bigint as hi from z""")
def padded_range(spark, d):
    f = F.col("p_size") % 20
    lo, hi = N.padded_range(f, f + 3, F.lit(60))
    return table(spark, d, "part").select("p_partkey", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


@query("even_sampling", "select p_partkey, array_to_string(case when 5>=p_size then range(0,p_size) else list_distinct_ordered end,',') as at from (select p_partkey, p_size, [cast(floor(o*(p_size-1)/4.0+0.5) as bigint) for o in range(0,5)] as list_distinct_ordered from part)")
def even_sampling(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(N.even_positions("p_size", F.lit(5)), ",").alias("at"))


@query("interior_sampling", "select p_partkey, case when p_size<=2 then '' when p_size<=5 then array_to_string(range(1,p_size-1),',') else array_to_string(list_sort(list_distinct([1+(p_size-3)//4, 1+(p_size-3)*2//4, 1+(p_size-3)*3//4])),',') end as at from part")
def interior_sampling(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(N.interior_positions("p_size"), ",").alias("at"))


@query("frame_predicates", "select event_id, value/100.0 between 0 and 1 as inside, not isnan(value) and not isinf(value) as finite, cast(cast(value as float)*cast(cast(640 as float)/cast(360 as float) as float) as double) as scaled from events")
def frame_predicates(spark, d):
    return table(spark, d, "events").select("event_id", N.in_frame(F.col("value") / 100.0).alias("inside"), N.is_finite("value").alias("finite"), N.scale_float("value", F.lit(360), F.lit(640)).cast("double").alias("scaled"))


_RGB = "(l_partkey%256) as r, (l_suppkey*3%256) as g, (l_orderkey%256) as b"
_L = f"with c as (select l_orderkey, l_linenumber, {_RGB} from lineitem)"


def _argb(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.pack(F.lit(255), F.col("l_partkey") % 256, F.col("l_suppkey") * 3 % 256, F.col("l_orderkey") % 256).alias("argb"))


@query("argb_pack", _L + " select l_orderkey, l_linenumber, (r*65536+g*256+b-16777216)::int as argb from c")
def argb_pack(spark, d):
    return _argb(spark, d)


@query("luma", _L + " select l_orderkey, l_linenumber, ((299*r+587*g+114*b)//1000)::int as a, ((77*r+150*g+29*b)//256)::int as b from c")
def luma(spark, d):
    return _argb(spark, d).select("l_orderkey", "l_linenumber", C.luma_thousandths("argb").alias("a"), C.luma_shift("argb").alias("b"))


_HSV = _L + """, f as (select l_orderkey, l_linenumber, r/255.0 as r, g/255.0 as g, b/255.0 as b, greatest(r,g,b)/255.0 as t, greatest(r,g,b)/255.0-least(r,g,b)/255.0 as d, greatest(r,g,b) as ti, r as ri, g as gi from c),
h as (select l_orderkey, l_linenumber, case when d=0 then 0.0 when ti=ri then (((g-b)/d+6.0)%6.0)*60 when ti=gi then ((b-r)/d+2)*60 else ((r-g)/d+4)*60 end as h, case when t=0 then 0.0 else d/t end as s, t as v from f)"""


@query("argb_to_hsv", _HSV + " select l_orderkey, l_linenumber, round(h,6)+0.0 as h, round(s,6)+0.0 as s, round(v,6)+0.0 as v, cast(trunc(greatest(0.0,least(1.0,s))*100) as int) as q from h")
def argb_to_hsv(spark, d):
    h, s, v = C.hsv("argb")
    return _argb(spark, d).select("l_orderkey", "l_linenumber", _r(h).alias("h"), _r(s).alias("s"), _r(v).alias("v"), C.quantise(s).alias("q"))


@query("hsv_threshold", _HSV + " select l_orderkey, l_linenumber, least(abs(h-350.0),360.0-abs(h-350.0))<=40.25 and abs(s-0.8)<=0.3003 and abs(v-0.7)<=0.3003 as hit from h")
def hsv_threshold(spark, d):
    h, s, v = C.hsv("argb")
    return _argb(spark, d).select("l_orderkey", "l_linenumber", C.hsv_matches(h, s, v, 350.0, 0.8, 0.7, 40.25, 0.3003, 0.3003).alias("hit"))


_POLY = ((2.0, 1.0), (9.0, 3.0), (7.0, 9.0), (1.0, 6.0))


def _poly():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _POLY])


def _poly_sql(x, y):
    t = []
    for (ax, ay), (bx, by) in zip(_POLY, [*_POLY[1:], _POLY[0]]):
        t.append(f"(case when (({ay}>{y})<>({by}>{y})) and {x}<({bx}-{ax})*({y}-{ay})/({by}-{ay})+{ax} then 1 else 0 end)")
    return "(" + "+".join(t) + ")%2=1"


@query("point_in_polygon", f"with s as (select event_id, event_id%11 as x, event_id//11%11 as y from events) select event_id, {_poly_sql('(x+0.5)', '(y+0.5)')} as inside, 1 as lft, 10 as rgt from s")
def point_in_polygon(spark, d):
    s = table(spark, d, "events").select("event_id", (F.col("event_id") % 11).alias("x"), (F.floor(F.col("event_id") / 11) % 11).alias("y"))
    box = C.polygon_region(_poly(), F.lit(64), F.lit(64))
    return s.select("event_id", C.in_polygon(_poly(), "x", "y").alias("inside"), box.left.alias("lft"), box.right.alias("rgt"))


@query("roi_clip", "select event_id, case when greatest(event_id%90-20,0)<least(event_id%90+10,50) and greatest(event_id%70-9,0)<least(event_id%70+4,40) then greatest(event_id%90-20,0) end as l, case when greatest(event_id%90-20,0)<least(event_id%90+10,50) and greatest(event_id%70-9,0)<least(event_id%70+4,40) then least(event_id%70+4,40) end as b from events")
def roi_clip(spark, d):
    e = F.col("event_id")
    r = C.clip_region(e % 90 - 20, e % 70 - 9, e % 90 + 10, e % 70 + 4, F.lit(50), F.lit(40))
    return table(spark, d, "events").select("event_id", r.left.alias("l"), r.bottom.alias("b"))


@query("move_corner")
def move_corner(spark, d):
    m = C.move_nearest_corner(_poly(), F.col("value") / 10, F.lit(4.0))
    return table(spark, d, "events").select("event_id", F.transform(m, lambda p: F.concat_ws(":", F.round(p.x, 3), F.round(p.y, 3))).alias("corners"), C.polygon_in_frame(m).alias("inside"))


@query("text_compact", r"""select page_id, regexp_extract(url,'[^/]*$') as base, regexp_replace(url,'[^A-Za-z0-9._-]','_','g') as token, regexp_extract(url,'^([A-Za-z][A-Za-z0-9+.-]*):',1) as scheme from pages""")
def text_compact(spark, d):
    return table(spark, d, "pages").select("page_id", T.base_name("url").alias("base"), T.log_token("url").alias("token"), T.scheme("url").alias("scheme"))


@query("evidence_compact", r"select conv_id, turn, substr(trim(regexp_replace(text,'[ \t\r\n]+',' ','g')),1,180) as line from conversations")
def evidence_compact(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.compact("text").alias("line"))


@query("command_match", r"select conv_id, turn, list_has_any(regexp_split_to_array(lower(text),'[^a-z]+'),['the','go','fire']) as command from conversations")
def command_match(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_command("text", ("the", "go", "fire")).alias("command"))


@query("evidence_lines", """select o_orderkey, concat_ws(chr(10), 'file=o'||o_orderkey, case when o_orderstatus<>'F' then 'timing='||o_orderstatus end, case when o_totalprice>150000 then 'band=high' end) as lines from orders""")
def evidence_lines(spark, d):
    s = F.col("o_orderstatus")
    lines = T.key_value_lines([("file", F.concat(F.lit("o"), F.col("o_orderkey"))), ("timing", F.when(s != "F", s)), ("band", F.when(F.col("o_totalprice") > 150000, F.lit("high")))])
    return table(spark, d, "orders").select("o_orderkey", lines.alias("lines"))


@query("strict_parsing", r"""select c_custkey, case when try_cast(substr(c_name,10) as double)>0 then try_cast(substr(c_name,10) as double) end as feet, case when regexp_full_match(substr(c_name,10),'[+-]?[0-9]+') then try_cast(substr(c_name,10) as bigint) end as id, try_cast(c_mktsegment as double) as none from customer""")
def strict_parsing(spark, d):
    n = F.substring("c_name", 10, 100)
    return table(spark, d, "customer").select("c_custkey", T.positive_feet(F.concat(F.lit(" "), n, F.lit(" "))).alias("feet"), T.strict_long(n).alias("id"), T.strict_double("c_mktsegment").alias("none"))


@query("recording_names", "select event_id, case when event_id%3=0 then 'recording-'||event_id||'.mp4' else 'n/a' end as name from events")
def recording_names(spark, d):
    e = F.col("event_id")
    path = F.concat(F.lit("/data/"), F.when(e % 3 == 0, "recording-").otherwise("clip-"), e.cast("string"), F.lit(".mp4"))
    return table(spark, d, "events").select("event_id", T.recording_name(path).alias("name"))


@query("content_gate", "select event_id, case when event_id%2=0 then 'NOT_USER_SELECTED' when event_id%3=0 then 'UNSUPPORTED_URI' when event_id%5=0 then 'GRANT_NOT_PERSISTABLE' end as reason from events")
def content_gate(spark, d):
    e = F.col("event_id")
    uri = F.when(e % 3 == 0, "file:///x").otherwise("content://media/1")
    return table(spark, d, "events").select("event_id", T.content_reason(uri, e % 2 != 0, e % 5 == 0, F.lit(False)).alias("reason"))


@query("merge_assumptions", "select s_suppkey, array_to_string(list_distinct_first,',') as merged from (select s_suppkey, case when s_nationkey%2=0 then ['planar','level','timing'] else ['planar','level'] end as list_distinct_first from supplier)")
def merge_assumptions(spark, d):
    b = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("planar"), F.lit("timing"))).otherwise(F.array(F.lit("level")))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(T.merge_distinct(F.array(F.lit("planar"), F.lit("level")), b), ",").alias("merged"))


@query("disclosure_check", "select doc_id, contains(lower(text),'the') as mentions from documents")
def disclosure_check(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mentions(F.array("text"), "THE").alias("mentions"))


@query("source_labels", "select s_suppkey, case s_nationkey%3 when 0 then 'UNKNOWN' when 1 then 'REALTIME' else 'OTHER' end as label, format('{:.1f}',round(s_acctbal/100)) as shown from supplier")
def source_labels(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.format_label(F.col("s_nationkey") % 3, {0: "UNKNOWN", 1: "REALTIME"}, "OTHER").alias("label"), T.one_decimal(N.half_away(F.col("s_acctbal") / 100)).alias("shown"))


@query("rounding_rules", "select event_id, cast(floor(value*4/2.0+0.5) as bigint) as half_up, cast(round_even(event_id/2.0,0) as bigint) as half_even from events")
def rounding_rules(spark, d):
    return table(spark, d, "events").select("event_id", N.half_up(F.col("value") * 4 / 2.0).alias("half_up"), N.half_even(F.col("event_id") / 2.0).alias("half_even"))


@query("metadata_gate", """select o_orderkey, case when o_orderstatus='P' then 'NOT_VIDEO' when o_custkey%9=0 then 'BAD_SIZE' when o_custkey%7=0 then 'BAD_DURATION' when o_custkey%5<2 then 'TOO_FEW_SAMPLES' when o_custkey%4=0 then 'BAD_TIMESTAMPS' end as reason from orders""")
def metadata_gate(spark, d):
    from chronotrack.sources.frames import metadata_reason

    k = F.col("o_custkey")
    r = metadata_reason(F.when(F.col("o_orderstatus") == "P", "audio/wav").otherwise("video/mp4"), k % 9, F.lit(9), k % 7, k % 5, k % 4 != 0)
    return table(spark, d, "orders").select("o_orderkey", r.alias("reason"))


@query("capture_gates", """select o_orderkey, case when o_custkey%6<>3 then 'COUNT_MISMATCH' when o_custkey%20+90 not between 85 and 115 then 'BAD_CADENCE' when o_custkey%4=0 then 'BAD_DURATION' end as capture, case when o_custkey%50 not between 5 and 45 then 'COUNT_OUT_OF_BOUNDS' when o_custkey%3=0 then 'OUTSIDE_WINDOW' when o_orderstatus='P' then 'SOURCE_INVALID' when o_custkey%11=0 then 'PROOF_MISSING' end as win from orders""")
def capture_gates(spark, d):
    from chronotrack.sources.frames import capture_reason, window_reason

    k = F.col("o_custkey")
    a = capture_reason(k % 6, F.lit(3), F.lit(3), k % 20 + 90, F.lit(100.0), k % 4)
    b = window_reason(k % 50, 5, 45, k % 3 != 0, F.when(F.col("o_orderstatus") == "P", "BLACK_FRAMES").otherwise("VALID"), k % 11 != 0)
    return table(spark, d, "orders").select("o_orderkey", a.alias("capture"), b.alias("win"))


@query("reason_precedence", """select o_custkey, coalesce(min(case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 end),9) as worst, coalesce(max(case when o_orderstatus='F' then 'PRIMARY' end),'RELEASE') as terminal from orders group by o_custkey""")
def reason_precedence(spark, d):
    p = F.col("o_orderpriority")
    rank = T.format_label(F.lit(0), {}, "9").cast("int")
    rank = F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 3)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.min(rank), F.lit(9)).alias("worst"), F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", "PRIMARY")), F.lit("RELEASE")).alias("terminal"))


@query("mode_ranking", """with r as (select l_suppkey%5 as w, l_quantity%4 as fps, l_partkey%3=0 as fixed, l_linenumber*10 as low from lineitem) select w, cast(fps as int) as fps, bool_or(fixed) as fixed, min(case when fixed then abs(low-30) end) as near_fixed, min(abs(low-30)) as near from r group by w, fps""")
def mode_ranking(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("w"), (F.col("l_quantity") % 4).cast("int").alias("fps"), (F.col("l_partkey") % 3 == 0).alias("fixed"), (F.col("l_linenumber") * 10).alias("low"))
    far = F.abs(F.col("low") - 30)
    best = F.min(F.struct((~F.col("fixed")).alias("x"), far.alias("far")))
    g = r.groupBy("w", "fps").agg(best.alias("b"), F.min(far).alias("near"))
    return g.select("w", "fps", (~F.col("b.x")).alias("fixed"), F.when(~F.col("b.x"), F.col("b.far")).alias("near_fixed"), "near")
