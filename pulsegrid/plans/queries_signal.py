"""Queries of the sample-level operators: windows, cleaning, time, motion, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import alignment, cleaning, motion, resample, smoothing, windows
from ..operators.quantiles import exact_quantiles
from ..operators.segments import dense_index, join_stats
from ..session import materialise
from ..sources.readers import first_match, header_start, path_epoch
from .registry import K, SIG, query, r6, recording, rounded, sq, sql_windows, table

# ---- row windows -----------------------------------------------------------------


@query("sliding_features", f"""WITH {SIG}, {sql_windows(16, 4)},
c AS (SELECT *, avg(red) OVER (PARTITION BY session_id, k) AS m FROM win)
SELECT session_id, k AS window_id, {sq('min(time)', 't0')}, {sq('max(time)', 't1')},
  {sq('max(CASE WHEN pos = 8 THEN time END)', 'time_center')}, {sq('avg(spo2)', 'spo2')},
  {sq('stddev_samp(red)', 'ac')}, {sq('greatest(max(CASE WHEN pos = 8 THEN ir END), 1)', 'dc')},
  {sq('avg((red - m) ** 3) / nullif(var_pop(red), 0) ** 1.5', 'skewness')},
  {sq('avg((red - m) ** 4) / nullif(var_pop(red), 0) ** 2 - 3', 'kurtosis')}
FROM c GROUP BY session_id, k""")
def sliding_features(spark, sf):
    sig = recording(spark, sf, "red", "ir", "spo2", "time")
    out = windows.sliding(sig, K, 16, 4).groupBy(*K, "window_id").agg(
        *windows.base_stats("time", "spo2", 16), F.stddev_samp("red").alias("ac"),
        F.greatest(windows.at_middle("ir", 16), F.lit(1.0)).alias("dc"),
        F.skewness("red").alias("skewness"), F.kurtosis("red").alias("kurtosis"),
    )
    return rounded(out, "t0", "t1", "time_center", "spo2", "ac", "dc", "skewness", "kurtosis")


@query("window_motion", f"""WITH {SIG}, {sql_windows(16, 4)}
SELECT session_id, k AS window_id, {sq('avg(CASE WHEN accx > 10 THEN 1 ELSE 0 END)', 'motion_frac')},
  {sq('sqrt(avg(accy * accy))', 'motion_rms')}, {sq('avg(accz)', 'acc_mag_mean')},
  CAST(avg(CASE WHEN accx > 10 THEN 1 ELSE 0 END) > 0.5 AS INTEGER) AS high_motion_window
FROM win GROUP BY session_id, k""")
def window_motion(spark, sf):
    sig = recording(spark, sf, "accx", "accy", "accz").withColumn("flag", (F.col("accx") > 10).cast("int"))
    out = windows.sliding(sig, K, 16, 4).groupBy(*K, "window_id").agg(*windows.motion_stats("flag", "accy", "accz"))
    return rounded(out, "motion_frac", "motion_rms", "acc_mag_mean")


@query("trailing_ratio", f"""WITH {SIG}, {sql_windows(20, 5, 1)}
SELECT session_id, k AS window_id, {sq('(stddev_pop(red) / avg(red)) / (stddev_pop(ir) / avg(ir))', 'r')}
FROM win GROUP BY session_id, k""")
def trailing_ratio(spark, sf):
    return rounded(windows.trailing_ratio(recording(spark, sf, "red", "ir"), K, "red", "red", "ir", "ir", 20, 5), "r")


@query("tumbling_mean", f"""WITH {SIG} SELECT session_id, i // 10 AS sec_idx, {sq('avg(spo2)', 'mean')} FROM sig GROUP BY 1, 2 HAVING count(*) = 10""")
def tumbling_mean(spark, sf):
    return rounded(windows.tumbling_mean(recording(spark, sf, "spo2"), K, "spo2", 10), "mean")


@query("double_window_mean", f"""WITH {SIG}, w AS (SELECT session_id, unnest(range(10, n, 10)) AS x FROM cnt WHERE n > 10)
SELECT w.session_id, x // 10 - 1 AS window_id, {sq('avg(spo2)', 'mean')}
FROM w JOIN sig s ON s.session_id = w.session_id AND i >= x - 10 AND i < x + 10 GROUP BY w.session_id, x""")
def double_window_mean(spark, sf):
    return rounded(windows.double_window_mean(recording(spark, sf, "spo2"), K, "spo2", 10), "mean")


@query("pair_decimate", f"""WITH {SIG}, w AS (SELECT session_id, unnest(range(2, n, 2)) AS x FROM cnt WHERE n > 2)
SELECT w.session_id, x // 2 - 1 AS pair_idx, {sq('avg(red)', 'red')}, {sq('avg(spo2)', 'spo2')}
FROM w JOIN sig s ON s.session_id = w.session_id AND i >= x - 2 AND i < x GROUP BY w.session_id, x""")
def pair_decimate(spark, sf):
    return rounded(windows.pair_mean(recording(spark, sf, "red", "spo2"), K, ["red", "spo2"]), "red", "spo2")


@query("stride_sample", f"WITH {SIG} SELECT session_id, i // 5 AS sec_idx, {sq('spo2', 'spo2')} FROM sig WHERE i % 5 = 0")
def stride_sample(spark, sf):
    out = windows.stride(recording(spark, sf, "spo2"), 5)
    return out.select("session_id", "sec_idx", r6("spo2", "spo2"))


@query("robust_ac", f"""WITH {SIG}, {sql_windows(20, 10)}
SELECT session_id, k AS window_id, {sq('(quantile_cont(red, 0.95) - quantile_cont(red, 0.05)) / 2', 'ac')}
FROM win GROUP BY session_id, k""")
def robust_ac(spark, sf):
    win = windows.sliding(recording(spark, sf, "red"), K, 20, 10)
    out = win.groupBy(*K, "window_id").agg(windows.robust_amplitude("red").alias("ac"))
    return rounded(out, "ac")


@query("perfusion_index", f"""WITH {SIG}, {sql_windows(20, 10)}
SELECT session_id, k AS window_id, {sq('stddev_pop(red) / nullif(avg(ir), 0)', 'perfusion')} FROM win GROUP BY session_id, k""")
def perfusion_index(spark, sf):
    win = windows.sliding(recording(spark, sf, "red", "ir"), K, 20, 10)
    out = win.groupBy(*K, "window_id").agg(windows.perfusion("red", "ir").alias("perfusion"))
    return rounded(out, "perfusion")


@query("acc_band_reject", f"""WITH {SIG}, {sql_windows(8, 8, 1)},
a AS (SELECT session_id, k, sqrt(avg(accx) ** 2 + avg(accy) ** 2 + avg(accz) ** 2) AS acc FROM win GROUP BY 1, 2)
SELECT session_id, k AS window_id, {sq('acc', 'acc')}, acc < 103 OR acc > 109 AS rejected FROM a""")
def acc_band_reject(spark, sf):
    return rounded(windows.acc_band(recording(spark, sf, "accx", "accy", "accz"), K, ["accx", "accy", "accz"], 8, 103, 109), "acc")


@query("acc_square_reject", f"""WITH {SIG}, {sql_windows(8, 8, 1)},
a AS (SELECT session_id, k, avg(accx) ** 2 + avg(accy) ** 2 + avg(accz) ** 2 AS acc FROM win GROUP BY 1, 2)
SELECT session_id, k AS window_id, {sq('acc', 'acc')}, acc < 11000 AS rejected FROM a""")
def acc_square_reject(spark, sf):
    return rounded(windows.acc_band(recording(spark, sf, "accx", "accy", "accz"), K, ["accx", "accy", "accz"], 8, 11000, None, squared=True), "acc")


@query("index_delete", f"""WITH {SIG}, {sql_windows(8, 8, 1)},
a AS (SELECT session_id, k, sqrt(avg(accx) ** 2 + avg(accy) ** 2 + avg(accz) ** 2) AS acc, avg(spo2) AS spo2 FROM win GROUP BY 1, 2)
SELECT session_id, k AS window_id, {sq('spo2', 'spo2')} FROM a WHERE NOT (acc < 103 OR acc > 109)""")
def index_delete(spark, sf):
    sig = recording(spark, sf, "accx", "accy", "accz", "spo2")
    bad = windows.acc_band(sig, K, ["accx", "accy", "accz"], 8, 103, 109).where("rejected")
    means = windows.sliding(sig, K, 8, 8, drop_tail=1).groupBy(*K, "window_id").agg(F.avg("spo2").alias("spo2"))
    return rounded(means.join(bad, [*K, "window_id"], "left_anti"), "spo2")


# ---- cleaning ---------------------------------------------------------------------

JUMP = """rng AS (SELECT session_id, i, CASE WHEN spo2 BETWEEN 92 AND 100 THEN spo2 END AS x FROM sig),
loop AS (
  SELECT session_id, i, x FROM rng WHERE i = 0
  UNION ALL
  SELECT r.session_id, r.i, CASE WHEN abs(r.x - l.x) > 1 THEN NULL ELSE r.x END
  FROM loop l JOIN rng r ON r.session_id = l.session_id AND r.i = l.i + 1)"""


def sql_fill(src: str, col: str, name: str) -> str:
    """CTE that fills nulls of ``col`` linearly by ``i`` with held ends."""
    up = "PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    dn = "PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""{name}_e AS (SELECT *,
  last_value({col} IGNORE NULLS) OVER ({up}) AS pv, last_value(CASE WHEN {col} IS NOT NULL THEN i END IGNORE NULLS) OVER ({up}) AS pi,
  first_value({col} IGNORE NULLS) OVER ({dn}) AS nv, first_value(CASE WHEN {col} IS NOT NULL THEN i END IGNORE NULLS) OVER ({dn}) AS ni
  FROM {src}),
{name} AS (SELECT *, CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL OR ni = pi THEN pv ELSE pv + (nv - pv) / (ni - pi) * (i - pi) END AS filled FROM {name}_e)"""


@query("range_jump_filter", f"WITH RECURSIVE {SIG}, {JUMP} SELECT session_id, i AS sample_idx, {sq('x', 'spo2')} FROM loop")
def range_jump_filter(spark, sf):
    out = cleaning.jump_filter(recording(spark, sf, "spo2"), K, "spo2", 92, 100, 1.0)
    return out.select("session_id", "sample_idx", r6("spo2", "spo2"))


GAPS = "CASE WHEN red BETWEEN 5 AND 60 THEN red END"


@query("gap_interpolate", f"""WITH {SIG}, g AS (SELECT session_id, i, {GAPS} AS x FROM sig), {sql_fill('g', 'x', 'f')}
SELECT session_id, i AS sample_idx, {sq('filled', 'red')} FROM f""")
def gap_interpolate(spark, sf):
    out = cleaning.interpolate(recording(spark, sf, "red"), K, {"red": F.when(F.col("red").between(5, 60), F.col("red"))})
    return out.select("session_id", "sample_idx", r6("red", "red"))


@query("rolling_median5", f"""WITH {SIG}
SELECT session_id, i AS sample_idx, {sq('median(red) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'red')} FROM sig""")
def rolling_median5(spark, sf):
    out = cleaning.moving_median(recording(spark, sf, "red"), K, "red")
    return out.select("session_id", "sample_idx", r6("red", "red"))


@query("sanitize_spo2", f"""WITH RECURSIVE {SIG}, {JUMP}, {sql_fill('loop', 'x', 'f')}
SELECT session_id, i AS sample_idx, {sq('median(filled) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'spo2')} FROM f""")
def sanitize_spo2(spark, sf):
    out = cleaning.sanitize(recording(spark, sf, "spo2"), K, "spo2", 92, 100, 1.0)
    return out.select("session_id", "sample_idx", r6("spo2", "spo2"))


_W = "OVER (PARTITION BY session_id ORDER BY i)"
_NEAR = ", ".join(f"coalesce({'lag' if j <= 0 else 'lead'}(red, {abs(j)}) {_W}, 0)" for j in range(-5, 6))
SPIKES = f"""b AS (SELECT session_id, i, red AS x, list_sort([{_NEAR}])[6] AS base, red - coalesce(lag(red) {_W}, red) AS dx FROM sig),
m1 AS (SELECT session_id, count(*) AS n, median(x - base) AS mr, median(dx) AS md, quantile_cont(x, 0.999) AS hi, quantile_cont(x, 1.0 - 0.999) AS lo FROM b GROUP BY 1),
m2 AS (SELECT b.session_id, median(abs(x - base - mr)) AS ar, median(abs(dx - md)) AS ad FROM b JOIN m1 USING (session_id) GROUP BY 1),
raw AS (SELECT b.*, n, abs(0.6745e0 * (x - base) / (ar + 1e-12)) > 6 OR abs(0.6745e0 * dx / (ad + 1e-12)) > 6 OR x >= hi OR x <= lo AS m
  FROM b JOIN m1 USING (session_id) JOIN m2 USING (session_id)),
mask AS (SELECT *, i > 0 AND i < n - 1 AND (m OR coalesce(lag(m) {_W}, false) OR coalesce(lead(m) {_W}, false)) AS spike FROM raw)"""


@query("median_filter11", f"WITH {SIG} SELECT session_id, i AS sample_idx, {sq(f'list_sort([{_NEAR}])[6]', 'base')} FROM sig")
def median_filter11(spark, sf):
    out = cleaning.median_filter(recording(spark, sf, "red"), K, {"red": "base"}, 11)
    return out.select("session_id", "sample_idx", r6("base", "base"))


@query("spike_mask", f"WITH {SIG}, {SPIKES} SELECT session_id, i AS sample_idx, {sq('base', 'base')}, spike FROM mask")
def spike_mask(spark, sf):
    out = cleaning.mark_spikes(recording(spark, sf, "red"), K, ["red"])
    return out.select("session_id", "sample_idx", r6("red_base", "base"), F.col("red_spike").alias("spike"))


@query("spike_fill", f"""WITH {SIG}, {SPIKES}, g AS (SELECT *, CASE WHEN NOT spike THEN x END AS good, sum(CASE WHEN spike THEN 0 ELSE 1 END) OVER (PARTITION BY session_id) AS ng FROM mask),
{sql_fill('g', 'good', 'f')}
SELECT session_id, i AS sample_idx, {sq('CASE WHEN ng < greatest(3, n // 10) THEN base ELSE filled END', 'red')} FROM f""")
def spike_fill(spark, sf):
    out = cleaning.fill_spikes(recording(spark, sf, "red"), K, ["red"])
    return out.select("session_id", "sample_idx", r6("red_raw", "red"))


def sql_mirror(half: int) -> str:
    """CTE ``ext``: rows of ``sig`` with ``half`` mirrored rows at both ends."""
    return f"""ext AS (
  SELECT session_id, i AS p, red AS x FROM sig
  UNION ALL SELECT session_id, -i - 1, red FROM sig WHERE i < {half}
  UNION ALL SELECT session_id, 2 * n - 1 - i, red FROM sig JOIN cnt USING (session_id) WHERE i >= n - {half})"""


def sql_box(src: str, col: str, half: int) -> str:
    return f"(SELECT session_id, p, x, avg({col}) OVER (PARTITION BY session_id ORDER BY p ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS y FROM {src})"


@query("box_rolling_dc", f"""WITH {SIG}, {sql_mirror(3)}, b AS {sql_box('ext', 'x', 3)}
SELECT session_id, p AS sample_idx, {sq('y', 'dc')} FROM b JOIN cnt USING (session_id) WHERE p >= 0 AND p < n""")
def box_rolling_dc(spark, sf):
    out = smoothing.rolling_dc(recording(spark, sf, "red"), K, {"red": "dc"}, 50.0, 0.15)
    return out.select("session_id", "sample_idx", r6("dc", "dc"))


@query("baseline_wander", f"""WITH {SIG}, {sql_mirror(6)}, b1 AS {sql_box('ext', 'x', 2)}, b2 AS {sql_box('b1', 'y', 2)}, b3 AS {sql_box('b2', 'y', 2)}
SELECT session_id, p AS sample_idx, {sq('x - y', 'red')} FROM b3 JOIN cnt USING (session_id) WHERE p >= 0 AND p < n""")
def baseline_wander(spark, sf):
    out = smoothing.remove_wander(recording(spark, sf, "red"), K, {"red": "flat"}, 50.0, 0.1)
    return out.select("session_id", "sample_idx", r6("flat", "red"))


@query("signal_quantiles", f"""WITH {SIG}, m AS (SELECT session_id, median(red) AS med FROM sig GROUP BY 1)
SELECT session_id, {sq('quantile_cont(red, 0.05)', 'p05')}, {sq('any_value(med)', 'p50')}, {sq('quantile_cont(red, 0.95)', 'p95')},
  {sq('median(abs(red - med))', 'mad')} FROM sig JOIN m USING (session_id) GROUP BY 1""")
def signal_quantiles(spark, sf):
    sig = recording(spark, sf, "red")
    q = materialise(exact_quantiles(sig, K, {"p": (F.col("red"), [0.05, 0.5, 0.95])}), "quantiles")
    mad = exact_quantiles(join_stats(sig, q, K), K, {"mad": (F.abs(F.col("red") - F.col("p_1")), [0.5])})
    return q.join(mad, K).select("session_id", r6("p_0", "p05"), r6("p_1", "p50"), r6("p_2", "p95"), r6("mad", "mad"))


# ---- scalars and time ----------------------------------------------------------------


@query("znorm", f"""WITH {SIG}, s AS (SELECT session_id, avg(red) AS m, stddev_pop(red) AS d FROM sig GROUP BY 1)
SELECT session_id, i AS sample_idx, {sq('(red - m) / (d + 1e-12)', 'z')} FROM sig JOIN s USING (session_id)""")
def znorm(spark, sf):
    out = scalars.znorm(recording(spark, sf, "red"), K, ["red"])
    return out.select("session_id", "sample_idx", r6("red_z", "z"))


@query("vector_magnitude", f"SELECT event_id, {sq('sqrt(accx ** 2 + accy ** 2 + accz ** 2)', 'acc_mag')} FROM (WITH {SIG} SELECT * FROM sig)")
def vector_magnitude(spark, sf):
    from .registry import CHANNELS

    ev = table(spark, sf, "events").select("event_id", *[F.expr(CHANNELS[c]).alias(c) for c in ("accx", "accy", "accz")])
    return ev.select("event_id", r6(motion.magnitude(F.col("accx"), F.col("accy"), F.col("accz")), "acc_mag"))


@query("relative_time", f"""WITH {SIG}, e AS (SELECT *, CASE WHEN session_id % 2 = 0 THEN epoch_us(ts) / 1e6 ELSE clock END AS t FROM sig),
z AS (SELECT session_id, CASE WHEN median(t) > 1e8 THEN arg_min(t, i) ELSE min(t) END AS zero FROM e GROUP BY 1)
SELECT session_id, i AS sample_idx, {sq('t - zero', 'time')} FROM e JOIN z USING (session_id)""")
def relative_time(spark, sf):
    sig = recording(spark, sf, "ts", "clock").withColumn(
        "t", F.when(F.col("session_id") % 2 == 0, scalars.wall_micros(F.col("ts")) / 1e6).otherwise(F.col("clock"))
    )
    return scalars.relative_time(sig, K, "t").select("session_id", "sample_idx", r6("time", "time"))


@query("rebase_millis", f"""WITH {SIG}, e AS (SELECT *, CASE WHEN session_id % 2 = 0 THEN (epoch_us(ts) // 1000)::DOUBLE ELSE clock END AS t FROM sig),
z AS (SELECT session_id, min(t) AS zero, CASE WHEN median(abs(t)) > 1e6 THEN 1000 ELSE 1 END AS scale FROM e GROUP BY 1)
SELECT session_id, i AS sample_idx, {sq('t / scale - zero / scale', 'time')} FROM e JOIN z USING (session_id)""")
def rebase_millis(spark, sf):
    sig = recording(spark, sf, "ts", "clock").withColumn(
        "t", F.when(F.col("session_id") % 2 == 0, F.floor(scalars.wall_micros(F.col("ts")) / 1000).cast("double")).otherwise(F.col("clock"))
    )
    return scalars.rebase_millis(sig, K, "t").select("session_id", "sample_idx", r6("time", "time"))


@query("time_parse", f"""SELECT event_id, {sq('''CASE event_id % 7
  WHEN 0 THEN CASE WHEN event_id % 24 >= 1 THEN (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59
    ELSE (event_id % 60) + (event_id % 59) / 1000 END
  WHEN 1 THEN (event_id % 90) * 60 + 7 + (event_id % 60 + 60) / 1000
  WHEN 2 THEN (event_id % 60) * 60 + 5.5
  WHEN 3 THEN epoch_us(date_trunc('second', ts)) / 1e6
  WHEN 4 THEN event_id + 0.25
  ELSE NULL END''', 'seconds')} FROM events""")
def time_parse(spark, sf):
    e = F.col("event_id")
    text = (
        F.when(e % 7 == 0, F.concat_ws(":", e % 24, e % 60, e % 59))
        .when(e % 7 == 1, F.concat_ws(":", e % 90, F.lit("7"), e % 60 + 60))
        .when(e % 7 == 2, F.concat(F.lit(" "), e % 60, F.lit(":5.5")))
        .when(e % 7 == 3, F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss"))
        .when(e % 7 == 4, F.concat(e, F.lit(".25")))
        .when(e % 7 == 5, F.lit("  "))
        .otherwise(F.lit("not a time"))
    )
    return table(spark, sf, "events").select("event_id", r6(scalars.parse_time(text), "seconds"))


@query("epoch_seconds", f"SELECT event_id, {sq('CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) / 1e3 ELSE event_id END', 'seconds')} FROM events")
def epoch_seconds(spark, sf):
    t = F.when(F.col("event_id") % 2 == 0, F.floor(scalars.wall_micros(F.col("ts")) / 1000).cast("double")).otherwise(F.col("event_id").cast("double"))
    return table(spark, sf, "events").select("event_id", r6(scalars.epoch_or_seconds(t), "seconds"))


@query("numeric_coerce", f"""SELECT event_id, {sq('''CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN event_id ELSE NULL END''', 'number')} FROM events""")
def numeric_coerce(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.col("value").cast("string")).when(e % 4 == 1, F.lit("n/a")).when(e % 4 == 2, F.concat(F.lit(" "), e, F.lit(" "))).otherwise(F.lit("NaN"))
    return table(spark, sf, "events").select("event_id", r6(scalars.to_number(text), "number"))


@query("empirical_spo2", f"WITH {SIG} SELECT event_id, {sq('110 - 25 * (red / ir)', 'spo2_estimated')}, {sq('98.3 - 0.255 * (red / ir) - spo2', 'error')} FROM sig")
def empirical_spo2(spark, sf):
    from .registry import CHANNELS

    ev = table(spark, sf, "events").select("event_id", *[F.expr(CHANNELS[c]).alias(c) for c in ("red", "ir", "spo2")])
    r = scalars.safe_ratio(F.col("red"), F.col("ir"))
    return ev.select("event_id", r6(scalars.empirical_spo2(r), "spo2_estimated"), r6(scalars.empirical_spo2(r, 98.3, 0.255) - F.col("spo2"), "error"))


@query("header_json", """SELECT event_id, 'dev' || user_id AS device, date_trunc('millisecond', ts) AS started FROM events""")
def header_json(spark, sf):
    line = F.concat(
        F.lit('# {"dev'), "user_id", F.lit('": {"date": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('", "time": "'),
        F.date_format("ts", "HH:mm:ss.SSS"), F.lit('", "rate": 100}}'),
    )
    return table(spark, sf, "events").select("event_id", F.inline(F.array(header_start(line))))


@query("recording_offset", f"""SELECT event_id, {sq('(event_id % 4000 - 2000) / 1000e0 + 10', 'diff_sec')} FROM events""")
def recording_offset(spark, sf):
    path = F.concat(F.lit("/data/rec/"), F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp"))) + F.col("event_id") % 4000 - 2000, F.lit(".txt"))
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    diff = (F.unix_micros(path_epoch(path)) - F.unix_micros(start)) / 1e6 + 10
    return table(spark, sf, "events").select("event_id", r6(diff, "diff_sec"))


@query("day_offset", f"""SELECT event_id, {sq("epoch_us(ts) % 86400000000 // 10000 / 1e2", 'seconds')} FROM events""")
def day_offset(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SS")
    return table(spark, sf, "events").select("event_id", r6(scalars.seconds_of_day(F.substring(stamp, 12, 20)), "seconds"))


@query("format_dispatch", """SELECT ext, CASE ext WHEN 'h5' THEN 'h5' WHEN 'HDF5' THEN 'h5' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'txt' WHEN 'txt' THEN 'txt' ELSE lower(ext) END AS format, count(*) AS files
FROM (SELECT ['h5', 'HDF5', 'csv', 'tsv', 'txt', 'Dat'][1 + event_id % 6] AS ext FROM events) GROUP BY ext""")
def format_dispatch(spark, sf):
    from ..sources.readers import format_of

    ext = F.get(F.array(*[F.lit(x) for x in ("h5", "HDF5", "csv", "tsv", "txt", "Dat")]), (F.col("event_id") % 6).cast("int"))
    return (
        table(spark, sf, "events").select(ext.alias("ext"), format_of(F.concat(F.lit("/a.b/"), "event_id", F.lit("."), ext)).alias("format"))
        .groupBy("ext", "format").agg(F.count("*").alias("files"))
    )


# ---- motion ------------------------------------------------------------------------------

_FLAG = "f AS (SELECT *, CASE WHEN abs(accx) > q THEN 1 ELSE 0 END AS high_motion FROM sig JOIN (SELECT session_id, quantile_cont(accx, 0.7) AS q FROM sig GROUP BY 1) USING (session_id))"


@query("motion_flag", f"WITH {SIG}, {_FLAG} SELECT session_id, i AS sample_idx, high_motion FROM f")
def motion_flag(spark, sf):
    out = motion.flag_motion(recording(spark, sf, "accx"), K, "accx", 0.7)
    return out.select("session_id", "sample_idx", "high_motion")


@query("motion_intervals", f"""WITH {SIG}, {_FLAG}, g AS (SELECT *, i - sum(high_motion) OVER (PARTITION BY session_id ORDER BY i) AS grp, max(time) OVER (PARTITION BY session_id) AS t_last,
  lead(time) OVER (PARTITION BY session_id ORDER BY i) AS t_next FROM f)
SELECT session_id, {sq('min(time)', 't_start')}, {sq('coalesce(arg_max(t_next, i), any_value(t_last))', 't_end')} FROM
  (SELECT session_id, time, i, grp, t_last, coalesce(t_next, t_last) AS t_next FROM g WHERE high_motion = 1) GROUP BY session_id, grp""")
def motion_intervals(spark, sf):
    flagged = motion.flag_motion(recording(spark, sf, "accx", "time"), K, "accx", 0.7)
    return rounded(motion.motion_intervals(flagged, K), "t_start", "t_end")


@query("motion_share", f"""WITH {SIG}, {_FLAG} SELECT session_id, count(*) AS samples, CAST(sum(high_motion) AS BIGINT) AS flagged, {sq('100 * avg(high_motion)', 'share_pct')} FROM f GROUP BY 1""")
def motion_share(spark, sf):
    flagged = motion.flag_motion(recording(spark, sf, "accx"), K, "accx", 0.7)
    return rounded(motion.motion_counts(flagged, K), "share_pct")


_REQ = "CASE WHEN red < 200 THEN red END"


@query("required_nonnull", f"WITH {SIG} SELECT session_id, i AS sample_idx, {sq('red', 'red')} FROM sig WHERE {_REQ} IS NOT NULL")
def required_nonnull(spark, sf):
    sig = recording(spark, sf, "red", "spo2").withColumn("red", F.when(F.col("red") < 200, F.col("red")))
    return sig.dropna(subset=["red", "spo2"]).select("session_id", "sample_idx", r6("red", "red"))


@query("warmup_discard", f"""WITH {SIG}, q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS j, min(time) OVER (PARTITION BY session_id) AS t0 FROM sig WHERE red > 3),
w AS (SELECT session_id, i, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS new_idx FROM q WHERE time >= t0 + 0.5)
SELECT session_id, i AS sample_idx, new_idx FROM w""")
def warmup_discard(spark, sf):
    sig = recording(spark, sf, "red", "time").where("red > 3")
    kept = windows.discard_warmup(sig, K, 0.5)
    return dense_index(kept, K, "sample_idx", "new_idx").select("session_id", "sample_idx", "new_idx")


@query("head_seconds", f"WITH {SIG} SELECT session_id, i AS sample_idx FROM (SELECT *, min(clock) OVER (PARTITION BY session_id) AS t0 FROM sig) WHERE clock <= t0 + 60")
def head_seconds(spark, sf):
    return windows.head_seconds(recording(spark, sf, "ts", "clock"), K, 60.0, "clock").select("session_id", "sample_idx")


@query("spo2_floor", f"WITH {SIG} SELECT session_id, i AS sample_idx, {sq('red / ir', 'r')}, {sq('spo2', 'spo2')} FROM sig WHERE spo2 >= 96 AND red > 2")
def spo2_floor(spark, sf):
    sig = recording(spark, sf, "red", "ir", "spo2").where("spo2 >= 96")
    r = F.when(F.col("red") > 2, scalars.safe_ratio(F.col("red"), F.col("ir")))
    return sig.withColumn("r", r).dropna(subset=["r", "spo2"]).select("session_id", "sample_idx", r6("r", "r"), r6("spo2", "spo2"))


# ---- joins, grids, lags --------------------------------------------------------------------

GRID = """grid AS (SELECT session_id, t0, g AS grid_idx, t0 + g / 2e0 AS t FROM
  (SELECT session_id, min(clock) - 1 AS t0, greatest(0, ceil((max(clock) + 1 - (min(clock) - 1)) / (1 / 2e0)))::BIGINT AS ng FROM sig GROUP BY 1), unnest(range(0, ng)) AS u(g)),
pos AS (SELECT g.session_id, g.grid_idx, g.t, greatest(1, least(coalesce(s.i, -1) + 1, n - 1)) AS k
  FROM grid g JOIN cnt USING (session_id) ASOF LEFT JOIN sig s ON s.session_id = g.session_id AND s.clock < g.t)"""


def _grid(sig):
    span = resample.time_span(sig, K, "clock").select(*K, (F.col("t_min") - 1).alias("t_min"), (F.col("t_max") + 1).alias("t_max"))
    return resample.time_grid([span, span], K, 2.0)


def sql_lerp(c: str) -> str:
    return f"a.{c} + (b.{c} - a.{c}) * ((p.t - a.clock) / (b.clock - a.clock))"


@query("resample_linear", f"""WITH {SIG}, {GRID}
SELECT p.session_id, p.grid_idx, {sq('p.t', 'time')}, {sq(sql_lerp('red'), 'red')}, {sq(sql_lerp('ir'), 'ir')}
FROM pos p JOIN sig a ON a.session_id = p.session_id AND a.i = p.k - 1 JOIN sig b ON b.session_id = p.session_id AND b.i = p.k""")
def resample_linear(spark, sf):
    sig = recording(spark, sf, "ts", "clock", "red", "ir")
    return rounded(resample.resample_linear(sig, K, ["red", "ir"], _grid(sig), 2.0, "clock"), "time", "red", "ir")


# Neighbours swap their times (and values go with them), so row order is not time order.
@query("resample_unordered", f"""WITH {SIG}, {GRID}
SELECT p.session_id, p.grid_idx, {sq('p.t', 'time')}, {sq(sql_lerp('red'), 'red')}
FROM pos p JOIN sig a ON a.session_id = p.session_id AND a.i = p.k - 1 JOIN sig b ON b.session_id = p.session_id AND b.i = p.k""")
def resample_unordered(spark, sf):
    sig = recording(spark, sf, "ts", "clock", "red")
    grid = _grid(sig)
    mixed = sig.withColumn("sample_idx", F.expr("sample_idx div 8 * 8 + (7 - sample_idx % 8)"))
    return rounded(resample.resample_linear(mixed, K, ["red"], grid, 2.0, "clock"), "time", "red")


@query("positional_merge", f"""WITH {SIG}, {GRID},
g2 AS (SELECT session_id, grid_idx, t FROM grid)
SELECT p.session_id, p.grid_idx, {sq(sql_lerp('spo2'), 'spo2')}, {sq(sql_lerp('green'), 'green')}
FROM pos p JOIN g2 USING (session_id, grid_idx) JOIN sig a ON a.session_id = p.session_id AND a.i = p.k - 1 JOIN sig b ON b.session_id = p.session_id AND b.i = p.k""")
def positional_merge(spark, sf):
    sig = recording(spark, sf, "ts", "clock", "green", "spo2")
    grid = _grid(sig)
    a = resample.resample_linear(sig, K, ["spo2"], grid, 2.0, "clock")
    b = resample.resample_linear(sig, K, ["green"], grid, 2.0, "clock").drop("time")
    return rounded(a.join(b, [*K, "grid_idx"]).drop("time"), "spo2", "green")


@query("resample_sparse", f"""WITH {SIG}, okr AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS i, clock, red FROM sig WHERE red > 5),
nk AS (SELECT session_id, count(*) AS n FROM okr GROUP BY 1),
grid AS (SELECT session_id, t0, g AS grid_idx, t0 + g / 2e0 AS t FROM
  (SELECT session_id, min(clock) - 1 AS t0, greatest(0, ceil((max(clock) + 1 - (min(clock) - 1)) / (1 / 2e0)))::BIGINT AS ng FROM sig GROUP BY 1), unnest(range(0, ng)) AS u(g)),
pos AS (SELECT g.session_id, g.grid_idx, g.t, greatest(1, least(coalesce(s.i, -1) + 1, n - 1)) AS k
  FROM grid g LEFT JOIN nk USING (session_id) ASOF LEFT JOIN okr s ON s.session_id = g.session_id AND s.clock < g.t)
SELECT p.session_id, p.grid_idx, {sq(sql_lerp('red'), 'red')}
FROM pos p LEFT JOIN okr a ON a.session_id = p.session_id AND a.i = p.k - 1 LEFT JOIN okr b ON b.session_id = p.session_id AND b.i = p.k""")
def resample_sparse(spark, sf):
    sig = recording(spark, sf, "ts", "clock", "red")
    sparse = sig.withColumn("red", F.when(F.col("red") > 5, F.col("red")))
    return resample.resample_sparse(sparse, K, ["red"], _grid(sig), 2.0, "clock").select("session_id", "grid_idx", r6("red", "red"))


@query("lag_xcorr", f"""WITH {SIG}, z AS (SELECT s.session_id, i, (red - ma) / (sa + 1e-12) AS a, (ir - mb) / (sb + 1e-12) AS b FROM sig s JOIN
  (SELECT session_id, avg(red) AS ma, stddev_pop(red) AS sa, avg(ir) AS mb, stddev_pop(ir) AS sb FROM sig GROUP BY 1) USING (session_id)),
c AS (SELECT x.session_id, l AS lag, sum(x.a * y.b) AS corr FROM z x, unnest(range(-8, 9)) AS u(l) JOIN z y ON y.session_id = x.session_id AND y.i = x.i - l GROUP BY 1, 2)
SELECT session_id, CAST(arg_max(lag, corr) AS INTEGER) AS lag, {sq('max(corr)', 'corr')} FROM c GROUP BY 1""")
def lag_xcorr(spark, sf):
    corr = alignment.cross_correlation(recording(spark, sf, "red", "ir"), K, "red", "ir", 8)
    best = alignment.best_lag(corr, K)
    return best.join(corr, [*K, "lag"]).select("session_id", "lag", r6("corr", "corr"))


@query("shift_resample", f"""WITH {SIG}, m AS (SELECT s.session_id, n, i, red, (s.session_id % 9 - 4) AS lag FROM sig s JOIN cnt USING (session_id)),
g AS (SELECT DISTINCT session_id, n, lag, unnest(range(0, n)) AS j FROM m),
p AS (SELECT *, greatest(1, least(j - lag, n - 1)) AS k FROM g)
SELECT p.session_id, p.j AS grid_idx, {sq('a.red + (b.red - a.red) * (p.j - p.lag - p.k + 1)', 'red')}
FROM p JOIN sig a ON a.session_id = p.session_id AND a.i = p.k - 1 JOIN sig b ON b.session_id = p.session_id AND b.i = p.k""")
def shift_resample(spark, sf):
    sig = recording(spark, sf, "red").withColumnRenamed("sample_idx", "grid_idx")
    grid = sig.groupBy(*K).agg(F.lit(0.0).alias("t0"), (F.max("grid_idx") + 1).alias("n_grid"))
    lags = grid.select(*K, (F.col("session_id") % 9 - 4).alias("lag"))
    return resample.shift_grid(sig, K, ["red"], lags, grid, 50.0).select("session_id", "grid_idx", r6("red", "red"))


@query("time_shift", f"WITH {SIG} SELECT session_id, i AS sample_idx, {sq('time + (session_id % 9 - 4) / 50e0', 'time')} FROM sig")
def time_shift(spark, sf):
    sig = recording(spark, sf, "time")
    lags = sig.select(*K).distinct().withColumn("lag", F.col("session_id") % 9 - 4)
    return rounded(resample.shift_time(sig, K, lags, 50.0).select("session_id", "sample_idx", "time"), "time")


@query("time_sync_join", f"""WITH {SIG}, d AS (SELECT session_id, (session_id % 7 - 3) * 1400000 AS us FROM cnt)
SELECT a.session_id, {sq('a.red / a.ir', 'r')}, {sq('b.spo2', 'spo2')} FROM sig a JOIN d USING (session_id)
JOIN sig b ON b.session_id = a.session_id AND a.i - greatest(0, us // 1000000) = b.i - greatest(0, (-us) // 1000000)
WHERE a.i >= greatest(0, us // 1000000) AND b.i >= greatest(0, (-us) // 1000000) AND a.red > 1""")
def time_sync_join(spark, sf):
    sig = recording(spark, sf, "red", "ir", "spo2").withColumnRenamed("sample_idx", "sec_idx")
    r = sig.select(*K, "sec_idx", F.when(F.col("red") > 1, F.col("red") / F.col("ir")).alias("r"))
    base = F.timestamp_seconds(F.lit(1767225600))
    starts = sig.select(*K).distinct().select(
        *K, base.alias("ratio_start"), F.timestamp_micros(F.unix_micros(base) + (F.col("session_id") % 7 - 3) * 1400000).alias("spo2_start")
    )
    return alignment.sync_by_second(r, sig.select(*K, "sec_idx", "spo2"), K, starts).select("session_id", r6("r", "r"), r6("spo2", "spo2"))


@query("head_trim", f"""WITH {SIG}, d AS (SELECT session_id, (session_id % 11 - 5) / 10e0 AS diff FROM cnt)
SELECT a.session_id, a.i - CASE WHEN diff > 0 THEN 0 ELSE round_even(-diff * 20, 0)::BIGINT END AS sample_idx, {sq('a.red', 'red')}, {sq('b.spo2', 'spo2')}
FROM sig a JOIN d USING (session_id) JOIN sig b ON b.session_id = a.session_id
 AND a.i - CASE WHEN diff > 0 THEN 0 ELSE round_even(-diff * 20, 0)::BIGINT END = b.i - CASE WHEN diff > 0 THEN round_even(diff * 20, 0)::BIGINT ELSE 0 END
WHERE a.i >= CASE WHEN diff > 0 THEN 0 ELSE round_even(-diff * 20, 0)::BIGINT END AND b.i >= CASE WHEN diff > 0 THEN round_even(diff * 20, 0)::BIGINT ELSE 0 END""")
def head_trim(spark, sf):
    sig = recording(spark, sf, "red", "spo2")
    offset = sig.select(*K).distinct().withColumn("diff_sec", (F.col("session_id") % 11 - 5) / 10)
    a, b = alignment.trim_heads(sig.select(*K, "sample_idx", "red"), sig.select(*K, "sample_idx", "spo2"), K, offset, 20.0, 20.0)
    return rounded(a.join(b, [*K, "sample_idx"]), "red", "spo2")


@query("dim_lookup", """SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def dim_lookup(spark, sf):
    facts = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    dim = first_match(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], "n_name")
    return facts.join(dim, "c_nationkey", "left").select("c_custkey", "c_nationkey", "n_name", "n_regionkey")


@query("semi_sidecar", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_sidecar(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("anti_train", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_train(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("site_classify", """SELECT c_custkey, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 IN (1, 4) THEN 'fingers' WHEN k % 5 = 2 THEN 'ear'
  ELSE CASE WHEN k % 2 = 0 THEN 'chest' END END AS site FROM (SELECT c_custkey, c_custkey AS k FROM customer)""")
def site_classify(spark, sf):
    k = F.col("c_custkey")
    filled = {
        "right_ear_device": k % 5 == 2, "left_ear_device": k % 5 == 3, "forehead_device": (k % 5 == 4) | ((k % 5 == 3) & (k % 2 == 0)),
        "finger_r2_device": k % 5 == 1,
    }
    devices = [F.when(filled[d], F.lit(1.0)) if d in filled else F.lit(None).cast("double") for d in scalars.DEVICES]
    return table(spark, sf, "customer").select("c_custkey", scalars.site_of(devices).alias("site"))


@query("stack_files", f"""SELECT 'orders' AS source, o_custkey AS id, {sq('o_totalprice', 'v')} FROM orders UNION ALL SELECT 'customer', c_custkey, {sq('c_acctbal', 'v')} FROM customer""")
def stack_files(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("id"), r6("o_totalprice", "v"))
    b = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), r6("c_acctbal", "v"))
    return a.unionByName(b)
