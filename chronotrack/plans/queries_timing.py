"""Queries over timestamp diagnostics, pairing and fits, on the events table and its like."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrack.functions.numeric import tidy
from chronotrack.operators import audio as A
from chronotrack.operators import estimate as E
from chronotrack.operators import fit as V
from chronotrack.operators import pairing as P
from chronotrack.operators import timing as G
from chronotrack.plans.catalog import query, table
from chronotrack.sources import frames as S
from chronotrack.sources import results as R

HOUR = 3_600_000_000
_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def events(spark, d):
    """user_id, event_id, us, x (value), y (k of the properties), event_type."""
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.expr(_US.format("ts")).alias("us"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type")


EV = "with e as (select user_id, event_id, epoch_us(ts) as us, value as x, cast(json_extract(props, '$.k') as double) as y, event_type from events)"
GAP = EV + ", g as (select *, us - lag(us) over (partition by user_id order by us, event_id) as gap, row_number() over (partition by user_id order by us, event_id) as rn from e)"
TR = EV + ", t as (select *, (us - min(us) over (partition by user_id))/1e6 as t from e)"


def tracks(spark, d):
    from pyspark.sql import Window as W

    e = events(spark, d)
    return e.withColumn("t", (F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / 1e6)


@query("ols_velocity_fit", TR + """, m as (select *, t-avg(t) over w as ct, x-avg(x) over w as cx, y-avg(y) over w as cy, avg(t) over w as mt, avg(x) over w as mx, avg(y) over w as my from t window w as (partition by user_id)),
f as (select user_id, count(*) as n, sum(ct*cx)/sum(ct*ct) as vx, sum(ct*cy)/sum(ct*ct) as vy, max(mt) as mt, max(mx) as mx, max(my) as my, sum(cx*cx) as xx, sum(cy*cy) as yy from m group by 1),
r as (select m.user_id, sum(power(cx-vx*ct,2)) as sx, sum(power(cy-vy*ct,2)) as sy from m join f using (user_id) group by 1)
select user_id, n, round(vx*1e6,4)+0.0 as vx, round(vy*1e6,4)+0.0 as vy, round(sqrt(vx*vx+vy*vy)*1e6,4)+0.0 as speed, round(degrees(atan2(-vy,abs(vx))),4)+0.0 as angle, round(mx-vx*mt,6)+0.0 as x0, round(1-sx/xx,6)+0.0 as r2_x, round(1-sy/yy,6)+0.0 as r2_y, round(sqrt((sx+sy)/n),6)+0.0 as rms from f join r using (user_id)""")
def ols_velocity_fit(spark, d):
    f = V.velocity_fit(tracks(spark, d), "user_id", "us", "t", "x", "y")
    r = lambda n, k=4, s=1.0: tidy(F.col(n) * s, k).alias(n)
    return f.select("user_id", "n", r("vx", 4, 1e6), r("vy", 4, 1e6), r("speed", 4, 1e6), r("angle"), r("x0", 6), r("r2_x", 6), r("r2_y", 6), r("rms", 6))


@query("detection_gates", EV + """, z as (select user_id%40 as k, event_id, case when event_id%97=0 then 'nan'::double else x end as x, us, lag(us) over (partition by user_id%40 order by event_id) as p from e)
select k, count(*) as n, case when count(*)<3 then 'INSUFFICIENT_DETECTIONS' when bool_or(isnan(x)) then 'INVALID_DETECTION' when bool_or(us<=p) then 'BAD_TIMESTAMP' end as reason from z group by k""")
def detection_gates(spark, d):
    e = events(spark, d).select((F.col("user_id") % 40).alias("k"), "event_id", F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.col("x")).alias("x"), F.col("us").cast("double").alias("t"))
    return V.detection_reason(e, "k", "event_id", "t", "x", "x")


@query("loo_outlier_pass1")
def loo_outlier_pass1(spark, d):
    f = V.velocity_fit(tracks(spark, d), "user_id", "us", "t", "x", "y", passes=1, min_gain=0.0)
    return f.select("user_id", "n", "used_count", tidy("rms").alias("rms"))


@query("loo_outlier_three_passes")
def loo_outlier_three_passes(spark, d):
    f = V.velocity_fit(tracks(spark, d), "user_id", "us", "t", "x", "y", passes=3, min_gain=0.01)
    return f.select("user_id", "n", "used_count", tidy("rms").alias("rms"))


@query("measurement", TR + """, m as (select *, t-avg(t) over w as ct, x-avg(x) over w as cx, y-avg(y) over w as cy from t window w as (partition by user_id)), f as (select user_id, count(*) as n, sum(ct*cx)/sum(ct*ct) as vx, sum(ct*cy)/sum(ct*ct) as vy from m group by 1),
r as (select m.user_id, sqrt(avg(power(cx-vx*ct,2)+power(cy-vy*ct,2))) as rms from m join f using (user_id) group by 1)
select user_id, case when rms>40 then 'EXCESSIVE_RESIDUAL' end as reason, case when rms<=40 then round(sqrt(vx*vx+vy*vy)/(user_id%7+1)*0.6818182*1e6,4)+0.0 end as mph from f join r using (user_id)""")
def measurement(spark, d):
    f = V.velocity_fit(tracks(spark, d), "user_id", "us", "t", "x", "y")
    m = V.measurement(f, (F.col("user_id") % 7 + 1).cast("double"), 40.0)
    return m.select("user_id", "reason", tidy(F.col("mph") * 1e6, 4).alias("mph"))


@query("gap_diagnostics", EV + f""", u as (select distinct user_id, us from e where us>0), g as (select user_id, us-lag(us) over (partition by user_id order by us) as gap from u), p as (select user_id, count(*) as positive_count from e where us>0 group by 1)
select user_id, count(*) as kept_count, median(gap) as median_gap, max(gap) as max_gap, any_value(positive_count) as positive_count, coalesce(median(gap) between 8*{HOUR}*0.85 and 8*{HOUR}*1.15,false) as in_band, coalesce(max(gap)<=8*{HOUR}*1.5,true) as no_drop from g join p using (user_id) group by user_id""")
def gap_diagnostics(spark, d):
    return G.gap_diagnostics(events(spark, d), "user_id", "us", F.lit(float(8 * HOUR)))


@query("ordered_gap_diagnostics", EV + f""", g as (select user_id, us-lag(us) over (partition by user_id order by event_id) as gap from e) select user_id, count(*) as kept_count, median(gap) as median_gap, max(gap) as max_gap, count(*) as positive_count, coalesce(median(gap) between 8*{HOUR}*0.85 and 8*{HOUR}*1.15,false) as in_band, coalesce(max(gap)<=8*{HOUR}*1.5,true) as no_drop from g group by user_id""")
def ordered_gap_diagnostics(spark, d):
    return G.gap_diagnostics(events(spark, d), "user_id", "us", F.lit(float(8 * HOUR)), distinct=False, order="event_id")


@query("normalised_timestamps", EV + ", p as (select user_id, us from e where us>0), n as (select user_id, count(*) as positive_count from p group by 1) select user_id, us, positive_count, row_number() over (partition by user_id order by us)-1 as seq from (select distinct * from p) join n using (user_id)")
def normalised_timestamps(spark, d):
    return G.normalise(events(spark, d), "user_id", "us")


@query("near_duplicate_groups", EV + f""", g as (select user_id, us, us-lag(us) over (partition by user_id order by us) as gap from e), n as (select *, coalesce(gap between 1 and {HOUR}-1, false) as near, row_number() over (partition by user_id, coalesce(gap between 1 and {HOUR}-1,false) order by us) as k from g), i as (select *, sum(case when near then 0 else 1 end) over (partition by user_id order by us) as island from n),
s as (select user_id, island, count(*) as n from i group by 1,2), a as (select user_id, count(*) filter (n>1) as group_count, count(*) as collapsed_count from s group by 1), f as (select user_id, string_agg(gap::varchar, ',' order by us) as first_gaps from n where near and k<=16 group by 1)
select user_id, group_count, collapsed_count, coalesce(first_gaps,'') as first_gaps from a left join f using (user_id)""")
def near_duplicate_groups(spark, d):
    return G.near_duplicate_groups(events(spark, d), "user_id", "us", HOUR)


@query("strictly_increasing_check", EV + f""", g as (select user_id, event_id, us-lag(us) over (partition by user_id order by event_id) as gap from e) select user_id, coalesce(bool_and(gap>0),true) as strictly_increasing, coalesce(bool_or(gap between 1 and {HOUR}-1),false) as has_near_duplicate, min_by(gap, event_id) filter (gap between 1 and {HOUR}-1) as first_near_gap from g group by 1""")
def strictly_increasing_check(spark, d):
    return G.increasing(events(spark, d), "user_id", "us", "event_id", HOUR)


@query("gap_summary_upper_median", GAP + ", v as (select user_id, list_sort(list(gap)) as l from g where gap is not null group by 1) select user_id, len(l) as interval_count, l[1] as min_gap, l[len(l)//2+1]::double as median_gap, l[len(l)] as max_gap, round(l[len(l)]/l[len(l)//2+1]::double,6)+0.0 as max_to_median from v")
def gap_summary_upper_median(spark, d):
    s = G.gap_summary(events(spark, d), "user_id", "us", upper=True)
    return s.withColumn("max_to_median", tidy("max_to_median"))


@query("gap_summary", GAP + " select user_id, count(gap) as interval_count, min(gap) as min_gap, median(gap) as median_gap, max(gap) as max_gap, round(max(gap)/median(gap),6)+0.0 as max_to_median from g where gap is not null group by 1")
def gap_summary(spark, d):
    s = G.gap_summary(events(spark, d), "user_id", "us")
    return s.withColumn("max_to_median", tidy("max_to_median"))


@query("median_long_truncated", GAP + " select user_id, cast(trunc(median(gap)) as bigint) as m, round(median(x),6)+0.0 as mx from g group by 1")
def median_long_truncated(spark, d):
    return G.gaps(events(spark, d), "user_id", "us").groupBy("user_id").agg(G.median_long("gap").alias("m"), tidy(F.median("x")).alias("mx"))


@query("dropped_holes", GAP + f" select user_id, us, gap, greatest(2, cast(floor(gap/(8.0*{HOUR})+0.5) as bigint)) as multiple from g where gap>8.0*{HOUR}*1.5")
def dropped_holes(spark, d):
    return G.dropped_holes(events(spark, d), "user_id", "us", "us", F.lit(8.0 * HOUR))


@query("hole_agreement", EV + f""", h as (select event_type='click' as c, user_id, row_number() over (partition by user_id, event_type order by us) as rn, us-lag(us) over (partition by user_id, event_type order by us) as gap from e where event_type in ('click','view')), q as (select c, user_id, rn, greatest(2,cast(floor(gap/(40.0*{HOUR})+0.5) as bigint)) as m from h where gap>40.0*{HOUR}*1.5)
select user_id, bool_and(a.m is not distinct from b.m) as holes_agree, count(*) as hole_count from (select user_id, rn, m from q where c) a full join (select user_id, rn, m from q where not c) b using (user_id, rn) group by user_id""")
def hole_agreement(spark, d):
    e = events(spark, d)
    one = lambda kind: G.dropped_holes(P.numbered(e.where(F.col("event_type") == kind), "user_id", "us"), "user_id", "us", "rn", F.lit(40.0 * HOUR))
    return G.hole_agreement(one("click"), one("view"), "user_id", "rn")


@query("longest_run", EV + ", r as (select user_id, us, event_type<>'click' as ok, row_number() over (partition by user_id order by us) as i from e), g as (select user_id, i - row_number() over (partition by user_id order by i) as k from r where ok) select user_id, max(n) as longest_run from (select user_id, k, count(*) as n from g group by 1,2) group by 1")
def longest_run(spark, d):
    e = P.numbered(events(spark, d), "user_id", "us", "i").withColumn("ok", F.col("event_type") != "click")
    return G.longest_run(e, "user_id", "i", "ok")


@query("offset_summary", EV + " select user_id, min(us-event_id) as min_offset, max(us-event_id) as max_offset, max(us-event_id)-min(us-event_id) as offset_spread from e group by 1")
def offset_summary(spark, d):
    return G.offset_summary(events(spark, d).withColumn("o", F.col("us") - F.col("event_id")), "user_id", "o")


@query("synthetic_clock", "with g as (select l_orderkey, l_linenumber*(l_orderkey%2+1) as ts from lineitem), d as (select l_orderkey, ts-lag(ts) over (partition by l_orderkey order by ts) as gap from g) select l_orderkey, count(gap) as gap_count, max(gap)-min(gap) as gap_spread, case when count(gap)<2 then 'UNKNOWN' when max(gap)-min(gap)<=1 then 'SYNTHETIC' else 'VARIABLE' end as clock from d group by 1")
def synthetic_clock(spark, d):
    return G.synthetic_clock(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * (F.col("l_orderkey") % 2 + 1)).alias("ts")), "l_orderkey", "ts")


@query("burst_summary", EV + " select user_id, count(*) as callbacks, count(distinct us) as unique_count, max(us)-min(us) as span, min(x) as min_exposure, median(x) as median_exposure, max(x) as max_exposure, 60::bigint as expected_count, 48::bigint as minimum_count, count(distinct us)>=48 as proven from e group by 1")
def burst_summary(spark, d):
    return G.burst_summary(events(spark, d), "user_id", "us", "x", F.lit(60))


@query("exposure_gate", EV + " select user_id, median(x)>50 as blurred, median(x) as m from e group by 1")
def exposure_gate(spark, d):
    return events(spark, d).groupBy("user_id").agg((F.median("x") > 50).alias("blurred"), F.median("x").alias("m"))


@query("cadence_gate", GAP + " select user_id, median(gap)/1e6 between 8333333*0.75 and 8333333*1.25 as in_band from g group by 1")
def cadence_gate(spark, d):
    return G.gaps(events(spark, d), "user_id", "us").groupBy("user_id").agg(G.cadence_gate(F.median("gap") / 1e6, F.lit(120)).alias("in_band"))


@query("frame_delta_timing", GAP + """, m as (select *, sqrt(power(x-lag(x) over w,2)+power(y-lag(y) over w,2)) as d from g window w as (partition by user_id order by us)), u as (select *, min(case when d>1 then d end) over (partition by user_id) as unit from m)
select user_id, us, case when d is null then 0 else greatest(1, cast(floor(d/unit+0.5) as bigint)) end as steps, round(sum(case when d is null then 0 else greatest(1, cast(floor(d/unit+0.5) as bigint)) end) over (partition by user_id order by us)*0.01,6)+0.0 as t from u""")
def frame_delta_timing(spark, d):
    f = G.frame_delta_times(events(spark, d), "user_id", "us", "x", "y", F.lit(0.01), least=1.0)
    return f.select("user_id", "us", "steps", tidy("t").alias("t"))


@query("index_and_pts_timing", GAP + " select user_id, us, round((rn-1)*0.5,6)+0.0 as nominal, round((us-min(us) over (partition by user_id))/1e9,6)+0.0 as rebased, round(us/1e9,6)+0.0 as absolute, round((event_id-min(event_id) over (partition by user_id))*0.25,6)+0.0 as by_index from g")
def index_and_pts_timing(spark, d):
    e = events(spark, d)
    a = G.nominal_times(e, "user_id", "us", F.lit(0.5)).withColumnRenamed("t", "nominal")
    b = G.times_from_pts(a, "user_id", "us").withColumnRenamed("t", "rebased")
    b = G.times_from_pts(b, "user_id", "us", rebase=False).withColumnRenamed("t", "absolute")
    b = G.times_from_indexes(b, "user_id", "event_id", F.lit(0.25)).withColumnRenamed("t", "by_index")
    return b.select("user_id", "us", *[tidy(c).alias(c) for c in ("nominal", "rebased", "absolute", "by_index")])


@query("partial_timestamp_timing")
def partial_timestamp_timing(spark, d):
    e = events(spark, d).withColumn("pts", F.when(F.col("event_id") % 5 != 0, F.col("us") * 1000))
    p = G.partial_times(e, "user_id", "us", "x", "y", "pts", F.lit(0.01))
    return p.select("user_id", "us", "steps", tidy("t").alias("t"), "all_timed")


# --- pairing


def _two(spark, d):
    e = events(spark, d)
    one = lambda kind, n: e.where(F.col("event_type") == kind).select("user_id", F.floor(F.col("us") / HOUR).alias(n))
    return one("click", "a_h"), one("view", "b_h")


TWO = EV + f", a as (select user_id, us//{HOUR} as a_h from e where event_type='click'), b as (select user_id, us//{HOUR} as b_h from e where event_type='view')"


@query("positional_pairing", TWO + ", x as (select *, row_number() over (partition by user_id order by a_h) as rn, count(*) over (partition by user_id) as n from a), y as (select *, row_number() over (partition by user_id order by b_h) as rn, count(*) over (partition by user_id) as n from b) select user_id, rn, a_h as a_ts, b_h as b_ts, b_h-min(b_h) over (partition by user_id) as rel from x join y using (user_id, rn, n)")
def positional_pairing(spark, d):
    a, b = _two(spark, d)
    return P.positional(a, b, "user_id", "a_h", "b_h")


@query("membership_semi", TWO + " select user_id, a_h from a semi join b on a.user_id=b.user_id and a.a_h=b.b_h")
def membership_semi(spark, d):
    a, b = _two(spark, d)
    return P.membership(a, b, "user_id", "a_h", "b_h").where("matched").select("user_id", "a_h")


@query("membership_anti", TWO + " select user_id, a_h from a anti join b on a.user_id=b.user_id and a.a_h=b.b_h")
def membership_anti(spark, d):
    a, b = _two(spark, d)
    return P.membership(a, b, "user_id", "a_h", "b_h").where("not matched").select("user_id", "a_h")


@query("unmatched_edges", TWO + """, m as (select user_id, a_h, exists(select 1 from b where b.user_id=a.user_id and b.b_h//24=a.a_h//24) as hit from (select user_id, a_h from a) a), r as (select *, row_number() over (partition by user_id order by a_h, hit) as rn from m), f as (select *, min(case when hit then rn end) over w as f, max(case when hit then rn end) over w as l from r window w as (partition by user_id)),
c as (select user_id, count(*) filter (hit) as matched_count, count(*) filter (f is null or rn<f) as "leading", count(*) filter (rn>l) as "trailing", count(*) filter (not hit and rn between f and l) as interior from f group by 1)
select *, case when matched_count=0 then 'NO_MATCH' when interior>0 then 'INTERIOR_UNMATCHED' when "leading">1 or "trailing">1 then 'EDGE_UNMATCHED' else 'PAIRED' end as verdict from c""")
def unmatched_edges(spark, d):
    a, b = _two(spark, d)
    day = lambda x, n: x.withColumn(n, F.floor(F.col(n) / 24))
    return P.unmatched_edges(day(a, "a_h"), day(b, "b_h"), "user_id", "a_h", "b_h")


@query("constant_offset_pairing", """with a as (select l_orderkey, l_linenumber as a from lineitem), b as (select l_orderkey, l_linenumber+(l_orderkey%3) + (case when l_orderkey%5=0 and l_linenumber=2 then 1 else 0 end) as b from lineitem), x as (select *, row_number() over (partition by l_orderkey order by a) as rn from a), y as (select *, row_number() over (partition by l_orderkey order by b) as rn from b), p as (select l_orderkey, count(*) as pairs, min(b-a) as o, max(b-a) as m from x join y using (l_orderkey, rn) group by 1)
select l_orderkey, pairs, o as "offset", case when o<>m then 'VARIABLE' when o=0 then 'EXACT' when o<2 then 'EQUIVALENT' else 'TOO_FAR' end as verdict from p""")
def constant_offset_pairing(spark, d):
    li = table(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    a, b = li.select("l_orderkey", n.alias("a")), li.select("l_orderkey", (n + k % 3 + F.when((k % 5 == 0) & (n == 2), 1).otherwise(0)).alias("b"))
    return P.constant_offset(a, b, "l_orderkey", "a", "b", 2, 1_000_000_000)


@query("nearest_asof", EV + """, a as (select user_id, event_id, us from e where event_type='click'), b as (select user_id, us as bu from e where event_type='view'), c as (select a.*, bu, row_number() over (partition by a.user_id, a.event_id order by abs(bu-us), bu) as rn from a left join b using (user_id)) select user_id, event_id, us, bu as nearest, abs(bu-us) as distance from c where rn=1""")
def nearest_asof(spark, d):
    e = events(spark, d)
    a, b = e.where("event_type = 'click'").select("user_id", "event_id", "us"), e.where("event_type = 'view'").select("user_id", F.col("us").alias("bu"))
    return P.nearest(a, b, "user_id", "us", "bu")


@query("tolerance_candidates", TWO + " select a.user_id, a_h, b_h as b_ts from a join b on a.user_id=b.user_id and abs(b_h-a_h)<=6")
def tolerance_candidates(spark, d):
    a, b = _two(spark, d)
    return P.tolerance_candidates(a, b, "user_id", "a_h", "b_h", 6).select("user_id", "a_h", "b_ts")


@query("offset_candidates", TWO + ' select distinct user_id, b_h-a_h as "offset" from a join b using (user_id)')
def offset_candidates(spark, d):
    a, b = _two(spark, d)
    return P.offset_candidates(a, b, "user_id", "a_h", "b_h")


@query("base_and_shifted_offsets", TWO + """, fa as (select user_id, min(a_h) as lo, max(a_h) as hi from a group by 1), rb as (select *, row_number() over (partition by user_id order by b_h) as up, row_number() over (partition by user_id order by b_h desc) as down from b),
o as (select distinct user_id, b_h-lo as o, 'first' as s from fa join rb using (user_id) where up<=3 union select distinct user_id, b_h-hi, 'last' from fa join rb using (user_id) where down<=3), x as (select user_id, o+k*7 as "offset", s||(case when k>=0 then '+' else '' end)||k as s from o, generate_series(-1,1) g(k))
select user_id, "offset", string_agg(distinct s, '|' order by s) as sources from x group by 1,2""")
def base_and_shifted_offsets(spark, d):
    a, b = _two(spark, d)
    return P.expand_offsets(P.base_offsets(a, b, "user_id", "a_h", "b_h"), "user_id", (-1, 1), 7)


@query("interval_join_window", "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey=l_orderkey where l_shipdate between o_orderdate and o_orderdate + interval 60 day")
def interval_join_window(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate")
    j = P.interval_join(o, li, "k", F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 60 days"), "l_shipdate")
    return j.select(F.col("k").alias("o_orderkey"), "l_linenumber")


@query("hash_lookup", EV + " , v as (select user_id, x as last_x, row_number() over (partition by user_id order by event_id desc) as rn from e where event_type='view') select user_id, event_id, last_x from e join v using (user_id) where rn=1 and event_type='click'")
def hash_lookup(spark, d):
    e = events(spark, d)
    return P.lookup(e.where("event_type = 'click'").select("user_id", "event_id"), e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("o"), F.col("x").alias("last_x")), "user_id", "o")


@query("verified_zip", "with a as (select l_orderkey, l_linenumber, l_quantity as q from lineitem), b as (select l_orderkey, l_linenumber, case when l_partkey%50=0 then l_quantity+1 else l_quantity end as q from lineitem where l_suppkey%40<>0) select l_orderkey, count(*) as rows, bool_and(b.q is not null and abs(a.q-coalesce(b.q,-9))<=1e-9) as verified from a full join b using (l_orderkey, l_linenumber) group by 1")
def verified_zip(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    b = li.where(F.col("l_suppkey") % 40 != 0).select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("q"))
    return P.verified_zip(a, b, "l_orderkey", "l_linenumber", F.abs(F.col("a_q") - F.col("b_q")) <= 1e-9)


@query("value_match")
def value_match(spark, d):
    a, b = _two(spark, d)
    return P.value_match(a, b, "user_id", "a_h", "b_h", 3, 4)


@query("anchor_analysis")
def anchor_analysis(spark, d):
    a, b = _two(spark, d)
    off = P.expand_offsets(P.base_offsets(a, b, "user_id", "a_h", "b_h"), "user_id", (-1, 1), 7)
    return P.surviving_mappings(P.anchor_mappings(a, b, off, "user_id", "a_h", "b_h", 200, 100), "user_id")


# --- windows over tracks


@query("stationary_prefix_trim", EV + """, q as (select user_id, us, case when row_number() over w<=3 and user_id%2=0 then 1.0 else x end as x, y*0 as y from e window w as (partition by user_id order by us)), r as (select *, row_number() over w as rn, count(*) over (partition by user_id) as n, abs(x-first_value(x) over w) as dd from q window w as (partition by user_id order by us)), m as (select *, min(case when dd>=1 then rn end) over (partition by user_id) as mv from r)
select user_id, us from m where not (n>=4 and coalesce(mv,0)>2 and n-coalesce(mv,0)+1>=4) or rn>=mv""")
def stationary_prefix_trim(spark, d):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("user_id").orderBy("us"))
    e = events(spark, d).withColumn("rn0", rn).select("user_id", "us", F.when((F.col("rn0") <= 3) & (F.col("user_id") % 2 == 0), 1.0).otherwise(F.col("x")).alias("x"), (F.col("y") * 0).alias("y"))
    return E.trim_stationary(e, "user_id", "us", "x", "y").select("user_id", "us")


@query("interval_coherence", TR + """, g as (select user_id, t-lag(t) over w as g, sqrt(power(x-lag(x) over w,2)+power(y-lag(y) over w,2)) as d from t window w as (partition by user_id order by us)), m as (select user_id, count(g) as gaps, min(g) as min_gap, median(g) as median_gap, max(g) as max_gap, median(d) as md from g where g is not null group by 1), a as (select g.user_id, bool_and(abs(g/median_gap-d/md)<=greatest(0.5,g/median_gap*0.35)) as ok from g join m using (user_id) where g is not null group by 1)
select user_id, gaps, round(max_gap/median_gap,6)+0.0 as gap_ratio, case when max_gap/median_gap<=3.5 then 'PLAIN' when md>0 and ok then 'COALESCED' else 'INCOHERENT' end as coherence from m join a using (user_id)""")
def interval_coherence(spark, d):
    c = E.interval_coherence(tracks(spark, d), "user_id", "us", "t", "x", "y", 3.5, 0.35)
    return c.select("user_id", "gaps", tidy("gap_ratio").alias("gap_ratio"), "coherence")


@query("size_change", EV + " select user_id, count(x) as sizes, bool_and(x>0) as sizes_ok, round(median(case when x>0 then x end),6)+0.0 as median_size, round(max(x)/min(case when x>0 then x end),6)+0.0 as size_ratio from e group by 1")
def size_change(spark, d):
    s = E.size_change(events(spark, d), "user_id", "x")
    return s.select("user_id", "sizes", "sizes_ok", tidy("median_size").alias("median_size"), tidy("size_ratio").alias("size_ratio"))


@query("direction_reversal", EV + ", s as (select user_id, x-lag(x) over (partition by user_id order by us) as dx from e), t as (select user_id, max_by(x,us)-min_by(x,us) as tot from e group by 1) select user_id, coalesce(bool_or(abs(dx)>=30 and sign(dx)=-sign(tot) and tot<>0),false) as reverses from s join t using (user_id) group by 1")
def direction_reversal(spark, d):
    return E.direction_reversal(events(spark, d), "user_id", "us", "x", 30.0)


@query("path_progression")
def path_progression(spark, d):
    t = tracks(spark, d).withColumn("x", F.col("t") + F.col("x") * 100)
    return E.progression(t, V.velocity_fit(t, "user_id", "us", "t", "x", "y"), "user_id", "us", "x", "y")


@query("estimate_pipeline")
def estimate_pipeline(spark, d):
    t = tracks(spark, d).withColumn("x", F.col("t") / 1e4 + F.col("x") / 1e3)
    cal = t.select("user_id").distinct().withColumns({"pixels": F.lit(10.0), "feet": F.col("user_id") % 5})
    e = E.estimate(t, "user_id", "us", "t", "x", "y", None, cal, "pixels", "feet", E.EstimateConfig(gap_ratio=50.0, max_rms=500.0))
    return e.select("user_id", "status", "reason", "frame_count", "detection_count", tidy("mph").alias("mph"), tidy("angle", 4).alias("angle"), "confidence", "basis")


@query("estimate_frame_deltas")
def estimate_frame_deltas(spark, d):
    t = tracks(spark, d)
    cal = t.select("user_id").distinct().withColumns({"pixels": F.lit(3.0), "feet": F.lit(1.0)})
    e = E.estimate(t, "user_id", "us", None, "x", "y", "x", cal, "pixels", "feet", E.RECORDED, frame_interval=1 / 120)
    return e.select("user_id", "status", "reason", "frame_count", tidy("mph", 4).alias("mph"), "confidence", F.array_join("warnings", "; ").alias("warnings"))


@query("confidence_bucket", "select event_id, case when event_id%13=0 then 'LOW' when event_id%10>=6 and value/40<=1.25 and event_id%8<=4 then 'HIGH' when event_id%10>=5 and value/40<=1.75 and event_id%8<=6 then 'MEDIUM' else 'LOW' end as c from events")
def confidence_bucket(spark, d):
    e = F.col("event_id")
    c = E.confidence(e % 10, F.col("value") / 40, (e % 8).cast("double"), F.lit(8.0), F.when(e % 13 == 0, "COALESCED").otherwise("PLAIN"), F.lit(False))
    return table(spark, d, "events").select("event_id", c.alias("c"))


@query("sliding_baseline_trigger", """with w as (select l_suppkey, l_orderkey, l_linenumber, l_quantity as a, count(*) over b as nb, count(*) over f as nf, sqrt(avg(l_quantity*l_quantity) over b) as br, sqrt(avg(l_quantity*l_quantity) over f) as wr, max(abs(l_quantity)) over f as pk from lineitem window b as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between 20 preceding and 1 preceding), f as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between current row and 3 following))
select l_suppkey, l_orderkey, l_linenumber, round(br,6)+0.0 as baseline_rms, pk as peak, round(wr/greatest(br,25.0),6)+0.0 as trigger_ratio, wr/greatest(br,25.0)>=1.5 and pk-br>=15 as triggered from w where nb=20 and nf=4""")
def sliding_baseline_trigger(spark, d):
    t = A.trigger_windows(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", 20, 4, 1.5, 15.0, 25.0)
    return t.select("l_suppkey", "l_orderkey", "l_linenumber", tidy("baseline_rms").alias("baseline_rms"), "peak", tidy("trigger_ratio").alias("trigger_ratio"), "triggered")


@query("impact_detector")
def impact_detector(spark, d):
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem")
    s = li.select("l_suppkey", (F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1).cast("long").alias("i"), F.when(F.col("l_quantity") == 50, 900).otherwise(F.col("l_quantity")).cast("short").alias("amp"))
    c = A.TriggerConfig(baseline=20, window=4, ratio=2.5, peak_delta=100, floor_rms=25.0, ready=100, accept=120, longest=20_000, actionable=5_000)
    return A.detect(s, "l_suppkey", "i", "amp", c)


# --- scans and stored results


@query("sample_window", EV + ", r as (select user_id, us, row_number() over (partition by user_id order by us) as rn from e) select * from r where rn between 4 and 10")
def sample_window(spark, d):
    return S.sample_window(events(spark, d).select("user_id", "us"), "user_id", "us", 3, 7)


@query("time_window_scan", EV + ", r as (select user_id, us, row_number() over (partition by user_id order by us) as rn from e where us between 1704500000000000 and 1705500000000000) select * from r where rn<=20")
def time_window_scan(spark, d):
    return S.time_window(events(spark, d).select("user_id", "us"), "user_id", "us", 1704500000000000, 1705500000000000, 20)


@query("bounded_extract", EV + " select user_id, count(*) as frames, case when count(*)>60 then 'FRAME_LIMIT' end as reason from e group by 1")
def bounded_extract(spark, d):
    return S.bounded_extract(events(spark, d), "user_id", 60)


@query("first_last_sample", EV + " select user_id, min_by(x,us) as first_value, max_by(x,us) as last_value, count(*) as frames from e group by 1")
def first_last_sample(spark, d):
    return S.first_last(events(spark, d), "user_id", "us", "x")


@query("every_nth", EV + ", r as (select user_id, us, row_number() over (partition by user_id order by us)-1 as rn from e) select * from r where rn%5=0")
def every_nth(spark, d):
    return S.every_nth(events(spark, d).select("user_id", "us"), "user_id", "us", 5)


@query("strided_sampling", EV + ", r as (select user_id, us, row_number() over (partition by user_id order by us)-1 as rn, count(*) over (partition by user_id) as n from e) select user_id, us, rn from r where rn%greatest(1,cast(ceil(n/10.0) as bigint))=0")
def strided_sampling(spark, d):
    return S.strided(events(spark, d).select("user_id", "us"), "user_id", "us", 10)


@query("upsert_latest", "select o_orderkey, o_totalprice from orders where o_orderkey%3<>0 union all select o_orderkey, o_totalprice*2 from orders where o_orderkey%3=0 and o_orderstatus<>'P'")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where(F.col("o_orderkey") % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    out = R.delete(R.upsert(o, new, "o_orderkey"), o.where("o_orderkey % 3 = 0 and o_orderstatus = 'P'"), "o_orderkey")
    return out.select("o_orderkey", "o_totalprice")


@query("retention_window", "with f as (select o_custkey, o_orderkey, row_number() over w as rank, sum(o_totalprice) over (partition by o_custkey order by o_orderdate desc, o_orderkey rows unbounded preceding) as total from orders window w as (partition by o_custkey order by o_orderdate desc, o_orderkey)) select o_custkey, o_orderkey, rank, rank<=3 and (rank=1 or total<=300000) as kept from f")
def retention_window(spark, d):
    f = R.retained(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 3, 300000.0)
    return f.select("o_custkey", "o_orderkey", "rank", "kept")


@query("diagnostic_lines", EV + ", p as (select user_id, event_id, row_number() over (partition by user_id order by event_id)-1 as pos from e) select user_id, pos//8 as line, string_agg(event_id::varchar, ',' order by pos) as text from p group by 1,2")
def diagnostic_lines(spark, d):
    v = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return R.chunked_lines(v, "user_id", "ids", 8)


@query("history_newest_first", "select o_orderkey from orders order by o_orderdate desc, o_orderkey")
def history_newest_first(spark, d):
    return R.newest_first(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey")
