"""Queries of the filter, feature, spectral, split and model operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ..operators.cleaning import Plausible
from ..operators.features import Pairing
from ..operators.filtering import Band, Canceller
from ..operators.motion import Movement
from ..operators.smoothing import Baseline
from ..operators.windows import Span
from ..functions import filters, fits
from ..operators import features, filtering, models, motion, spectra, splits
from ..operators.segments import dense_index, join_stats
from ..session import materialise
from ..config import PAIRS_MAIN
from . import calibration, dataset, views
from .registry import K, SIG, query, r6, recording, rounded, sq, sql_windows, table

# ---- recursive filters --------------------------------------------------------------


def coefficients(flt: filters.Filter) -> tuple[list[float], list[float]]:
    b = flt.gain * np.real(np.poly(np.array(flt.zeros)))
    a = np.real(np.poly(np.array(flt.poles)))
    return [float(v) for v in b], [float(v) for v in a]


def sql_recursion(src: str, order_by: str, flt, name: str, level: str | None) -> str:
    """CTEs that run the difference equation over ``src(session_id, q, x)``.

    Before the first sample the input is constant (``level`` times it was the
    output) or, without ``level``, zero."""
    b, a = coefficients(flt)
    k = len(a) - 1
    f = "first_value(x) OVER w" if level else "0e0"
    xs = ", ".join(["x"] + [f"coalesce(lag(x, {j}) OVER w, {f})" for j in range(1, k + 1)])
    past = f"[f * {level} for z in range({k})]" if level else f"[0e0 for z in range({k})]"
    feed = f"list_dot_product({b}::DOUBLE[], [{xs}]::DOUBLE[])"
    return f"""{name}_u AS (SELECT session_id, p, row_number() OVER w - 1 AS q, {feed} AS u, {f} AS f FROM {src} WINDOW w AS (PARTITION BY session_id ORDER BY {order_by})),
{name}_r AS (
  SELECT session_id, q, p, list_prepend(u - list_dot_product({a[1:]}::DOUBLE[], {past}::DOUBLE[]), {past}::DOUBLE[])[1:{k}] AS ys FROM {name}_u WHERE q = 0
  UNION ALL
  SELECT u.session_id, u.q, u.p, list_prepend(u.u - list_dot_product({a[1:]}::DOUBLE[], r.ys), r.ys)[1:{k}]
  FROM {name}_r r JOIN {name}_u u ON u.session_id = r.session_id AND u.q = r.q + 1),
{name} AS (SELECT session_id, p, ys[1] AS x FROM {name}_r)"""


def sql_zero_phase(col: str, flt, level: str) -> str:
    """CTE ``zp(session_id, p, x)``: forward-backward filter of ``sig.col``."""
    pad = 3 * (len(flt.poles) + 1)
    return f"""ext AS (
  SELECT session_id, i AS p, {col} AS x FROM sig JOIN cnt USING (session_id) WHERE n > {pad}
  UNION ALL SELECT a.session_id, -b.i, 2 * a.{col} - b.{col} FROM sig a JOIN cnt USING (session_id) JOIN sig b ON b.session_id = a.session_id AND b.i BETWEEN 1 AND {pad} WHERE a.i = 0 AND n > {pad}
  UNION ALL SELECT a.session_id, 2 * (n - 1) - b.i, 2 * a.{col} - b.{col} FROM sig a JOIN cnt USING (session_id) JOIN sig b ON b.session_id = a.session_id AND b.i BETWEEN n - 1 - {pad} AND n - 2 WHERE a.i = n - 1 AND n > {pad}),
{sql_recursion('ext', 'p', flt, 'fw', level)},
{sql_recursion('fw', '-p', flt, 'zp', level)}"""


def sections(flt: filters.Filter) -> list[filters.Filter]:
    """The filter as a cascade of first and second orders, each with conjugate poles and, where it passes a level, unit gain there."""
    poles = sorted(flt.poles, key=lambda p: (abs(p), p.real, p.imag))
    zeros = sorted(np.real(np.array(flt.zeros)).tolist())
    real, upper = [p for p in poles if abs(p.imag) < 1e-14], [p for p in poles if p.imag >= 1e-14]
    groups = [(p, p.conjugate()) for p in upper] + [tuple(real[k : k + 2]) for k in range(0, len(real), 2)]
    out, gain = [], flt.gain
    for k, g in enumerate(groups):
        own = [zeros.pop(0) if j % 2 == 0 else zeros.pop() for j in range(len(g))]
        level = abs(np.prod([1 - z for z in own]))
        size = float(np.real(np.prod([1 - p for p in g]))) / level if level > 1e-9 else 1.0
        size = gain if k == len(groups) - 1 else size
        gain /= size
        out.append(filters.Filter(tuple(own), tuple(g), size))
    return out


def sql_cascade(src: str, order_by: str, flt, name: str, level: str | None) -> str:
    """``sql_recursion`` section by section: polynomials of high order would lose most digits."""
    parts = sections(flt)
    names = [f"{name}_s{k}" for k in range(len(parts) - 1)] + [name]
    return ",\n".join(sql_recursion(a, order_by, f, b, level) for a, f, b in zip([src, *names], parts, names))


def sql_zero_cascade(col: str, flt, level: str, tag: str) -> str:
    """CTE ``zp<tag>(session_id, p, x)``: ``sql_zero_phase`` by sections."""
    plain = sql_zero_phase(col, flt, level)
    ext = plain[: plain.index(",\nfw_u AS")]
    ext = re.sub(r"\bext\b", f"ext{tag}", ext)
    return f"{ext},\n{sql_cascade(f'ext{tag}', 'p', flt, f'fw{tag}', level)},\n{sql_cascade(f'fw{tag}', '-p', flt, f'zp{tag}', level)}"


BAND2 = filters.butterworth(2, 0.5, 5.0, 50.0)
LOW2 = filters.butterworth(2, None, 1.0, 50.0)


@query("bandpass", f"WITH RECURSIVE {SIG}, {sql_zero_phase('red', BAND2, '0e0')} SELECT session_id, i AS sample_idx, {sq('x', 'red')} FROM sig LEFT JOIN zp USING (session_id) WHERE p = i")
def bandpass(spark, sf):
    out = filtering.zero_phase(recording(spark, sf, "red"), K, {"red": "f"}, 50.0, 0.5, 5.0, 2)
    return out.select("session_id", "sample_idx", r6("f", "red")).where("red is not null")


@query("lowpass", f"WITH RECURSIVE {SIG}, {sql_zero_phase('ir', LOW2, '1e0')} SELECT session_id, p AS sample_idx, {sq('x', 'ir')} FROM zp JOIN cnt USING (session_id) WHERE p >= 0 AND p < n")
def lowpass(spark, sf):
    out = filtering.zero_phase(recording(spark, sf, "ir"), K, {"ir": "f"}, 50.0, None, 1.0, 2)
    return out.select("session_id", "sample_idx", r6("f", "ir")).where("ir is not null")


BAND5 = filters.butterworth(5, 0.5, 5.0, 50.0)


@query("bandpass_order5", f"""WITH RECURSIVE {SIG}, {sql_zero_cascade('red', BAND5, '0e0', 'r')}, {sql_zero_cascade('ir', BAND5, '0e0', 'i')}
SELECT session_id, i AS sample_idx, {sq('zpr.x', 'red')}, {sq('zpi.x', 'ir')} FROM sig LEFT JOIN zpr ON zpr.session_id = sig.session_id AND zpr.p = i LEFT JOIN zpi ON zpi.session_id = sig.session_id AND zpi.p = i""".replace("SELECT session_id, i AS sample_idx", "SELECT sig.session_id, i AS sample_idx"))
def bandpass_order5(spark, sf):
    out = filtering.zero_phase(recording(spark, sf, "red", "ir"), K, {"red": "red", "ir": "ir"}, 50.0, 0.5, 5.0, 5)
    return rounded(out.drop("event_id"), "red", "ir")


for _name, _args in (("causal_lowpass", (None, 0.5)), ("causal_bandpass", (0.5, 5.0)), ("causal_highpass", (5.0, None))):
    _flt = filters.butterworth(2, _args[0], _args[1], 50.0)

    def _causal(spark, sf, args=_args):
        out = filtering.causal(recording(spark, sf, "red"), K, {"red": "f"}, 50.0, args[0], args[1], 2)
        return out.select("session_id", "sample_idx", r6("f", "red"))

    query(_name, f"WITH RECURSIVE {SIG}, src AS (SELECT session_id, i AS p, red AS x FROM sig), {sql_recursion('src', 'p', _flt, 'lf', None)} SELECT session_id, p AS sample_idx, {sq('x', 'red')} FROM lf")(_causal)


@query("motion_energy", f"WITH RECURSIVE {SIG}, sigm AS (SELECT session_id, i, sqrt(accx ** 2 + accy ** 2 + accz ** 2) AS m FROM sig), {sql_zero_cascade('m', filters.butterworth(4, 0.5, 10.0, 50.0), '0e0', 'm').replace('sig ', 'sigm ')} SELECT session_id, p AS sample_idx, {sq('abs(x)', 'motion_energy')} FROM zpm JOIN cnt USING (session_id) WHERE p >= 0 AND p < n")
def motion_energy(spark, sf):
    sig = recording(spark, sf, "accx", "accy", "accz")
    mag = sig.withColumn("m", motion.magnitude(F.col("accx"), F.col("accy"), F.col("accz")))
    out = motion.motion_energy(mag, K, "m", 50.0).where("motion_energy is not null")
    return out.select("session_id", "sample_idx", r6("motion_energy", "motion_energy"))


# ---- adaptive filters ---------------------------------------------------------------


def sql_adaptive(xs: str, taps: int, step: str, warm: int, first: str) -> str:
    """CTE ``lms(session_id, i, e)``; ``xs`` lists the tap inputs, ``step`` is the
    factor of ``e * x``, the first ``warm`` outputs are ``first``."""
    zero = f"[0e0 for z in range({taps})]"
    e = "(a.p - list_dot_product(l.w, a.x))"
    return f"""taps AS (SELECT session_id, i, red AS p, [{xs}]::DOUBLE[] AS x FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY i)),
lms AS (
  SELECT session_id, CAST(-1 AS BIGINT) AS i, 0e0 AS e, {zero}::DOUBLE[] AS w FROM cnt
  UNION ALL
  SELECT a.session_id, a.i, CASE WHEN a.i < {warm} THEN {first} ELSE {e} END,
    CASE WHEN a.i < {warm} THEN l.w ELSE [l.w[j] + {step} * {e} * a.x[j] for j in range(1, {taps + 1})] END
  FROM lms l JOIN taps a ON a.session_id = l.session_id AND a.i = l.i + 1)"""


def _lags(col: str, first: int, taps: int) -> str:
    return ", ".join(f"coalesce(lag({col} / 50e0, {j}) OVER w, 0)" if j else f"{col} / 50e0" for j in range(first, first + taps))


def _adaptive(spark, sf, refs, taps, mu, style):
    sig = recording(spark, sf, "red", *refs)
    scaled = sig.select(*K, "sample_idx", "red", *[(F.col(c) / 50.0).alias(c) for c in refs])
    out = filtering.adaptive_cancel(scaled, K, {"red": "e"}, refs, taps, mu, style)
    return out.select("session_id", "sample_idx", r6("e", "red"))


_LMS = "SELECT session_id, i AS sample_idx, " + sq("e", "red") + " FROM lms WHERE i >= 0"


@query("lms_anc", f"WITH RECURSIVE {SIG}, {sql_adaptive(_lags('accx', 1, 4), 4, '2 * 5e-3', 4, 'a.p')} {_LMS}")
def lms_anc(spark, sf):
    return _adaptive(spark, sf, ["accx"], 4, 0.005, "delayed")


@query("multi_lms", f"WITH RECURSIVE {SIG}, {sql_adaptive(_lags('accx', 0, 3) + ', ' + _lags('accy', 0, 3), 6, '2 * 5e-3', 0, '0')} {_LMS}")
def multi_lms(spark, sf):
    return _adaptive(spark, sf, ["accx", "accy"], 3, 0.005, "current")


@query("nlms", f"WITH RECURSIVE {SIG}, {sql_adaptive(_lags('accx', 1, 4), 4, '(2e-1 / (list_dot_product(a.x, a.x) + 1e-6))', 4, '0')} {_LMS}")
def nlms(spark, sf):
    return _adaptive(spark, sf, ["accx"], 4, 0.2, "normalised")


@query("polyphase", f"""WITH {SIG}, m AS (SELECT session_id, unnest(range(0, (n + 1) // 2)) AS m FROM cnt)
SELECT m.session_id, m AS sample_idx, {sq(f'sum(red * ({[float(v) for v in filters.kaiser_taps(1, 2)]}::DOUBLE[])[2 * m + 20 - i + 1])', 'red')}
FROM m JOIN sig s ON s.session_id = m.session_id AND s.i BETWEEN 2 * m - 20 AND 2 * m + 20 GROUP BY 1, 2""")
def polyphase(spark, sf):
    return rounded(filtering.resample_poly(recording(spark, sf, "red"), K, ["red"], 50, 100), "red")


# ---- window features ------------------------------------------------------------------

PAIRS = [("red", "ir"), ("ir", "red"), ("green", "ir")]
GATE = 0.03


def _features(spark, sf):
    sig = recording(spark, sf, "red", "ir", "green", "spo2", "time", "accx", "accy")
    sig = sig.select(
        *K, "sample_idx", "time", "spo2", "red", "ir", "green", *[(F.col(c) + 100.0).alias(f"{c}_raw") for c in ("red", "ir", "green")],
        F.abs("accx").alias("motion_energy"), (F.col("accy") > 1).cast("int").alias("high_motion"), F.abs("accy").alias("acc_mag"),
    )
    return features.window_features(sig, K, PAIRS, 50.0, 32, 8, reach=4, min_sqi=GATE)


FEATS = f"""{sql_windows(32, 8)},
base AS (SELECT session_id, k, min(time) AS t0, max(time) AS t1, max(CASE WHEN pos = 16 THEN time END) AS tc, avg(spo2) AS spo2, avg(CASE WHEN accy > 1 THEN 1 ELSE 0 END) AS mf,
  sqrt(avg(accx * accx)) AS mr, avg(abs(accy)) AS am FROM win GROUP BY 1, 2),
ch AS (SELECT session_id, k, pos, c, x, avg(x) OVER v AS m FROM (
  SELECT session_id, k, pos, 'red' AS c, red AS x FROM win UNION ALL SELECT session_id, k, pos, 'ir', ir FROM win UNION ALL SELECT session_id, k, pos, 'green', green FROM win) WINDOW v AS (PARTITION BY session_id, k, c)),
st AS (SELECT session_id, k, c, stddev_samp(x) AS ac, greatest(max(CASE WHEN pos = 16 THEN x + 100 END), 1) AS dc,
  avg((x - m) ** 3) / nullif(var_pop(x), 0) ** 1.5 AS skew, avg((x - m) ** 4) / nullif(var_pop(x), 0) ** 2 - 3 AS kurt FROM ch GROUP BY 1, 2, 3),
psd AS (SELECT session_id, k, c, b, (sum((x - m) * h * cos(2 * pi() * b * pos / 32)) ** 2 + sum((x - m) * h * sin(2 * pi() * b * pos / 32)) ** 2) * CASE WHEN b IN (0, 16) THEN 1 ELSE 2 END AS p
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * pos / 32) AS h FROM ch), unnest(range(0, 17)) AS u(b) GROUP BY 1, 2, 3, 4),
trap AS (SELECT session_id, k, c, b, (p + lead(p) OVER (PARTITION BY session_id, k, c ORDER BY b)) / 2 AS t FROM psd),
q AS (SELECT session_id, k, c, sum(CASE WHEN b = 1 THEN t ELSE 0 END) / sum(t) AS sqi FROM trap WHERE b < 16 GROUP BY 1, 2, 3),
pr AS (SELECT * FROM (VALUES (0, 'red', 'ir'), (1, 'ir', 'red'), (2, 'green', 'ir')) AS v(o, a, b)),
cc AS (SELECT o, x.session_id, x.k, l, sum((x.x - x.m) * (y.x - y.m)) AS s FROM pr JOIN ch x ON x.c = a JOIN ch y ON y.c = b AND y.session_id = x.session_id AND y.k = x.k
  JOIN unnest(range(-4, 5)) AS u(l) ON y.pos = x.pos - l GROUP BY 1, 2, 3, 4),
lg AS (SELECT o, session_id, k, arg_max(l, s) AS lag FROM cc GROUP BY 1, 2, 3),
mv AS (SELECT lg.o, lg.session_id, lg.k, u.pos, x FROM lg JOIN pr USING (o) JOIN unnest(range(0, 32)) AS u(pos) ON true
  JOIN ch ON ch.c = b AND ch.session_id = lg.session_id AND ch.k = lg.k AND ch.pos = greatest(0, least(31, u.pos - lag))),
mm AS (SELECT o, session_id, k, avg(x) AS m, stddev_samp(x) AS ac FROM mv GROUP BY 1, 2, 3),
fc AS (SELECT pr.o, x.session_id, x.k, x.pos - y.pos AS l, sum((x.x - x.m) * (y.x - mm.m)) AS s FROM pr JOIN ch x ON x.c = a JOIN mv y ON y.o = pr.o AND y.session_id = x.session_id AND y.k = x.k
  JOIN mm ON mm.o = pr.o AND mm.session_id = x.session_id AND mm.k = x.k GROUP BY 1, 2, 3, 4),
fr AS (SELECT o, session_id, k, min(CASE WHEN s >= top - 1e-12 * abs(top) THEN l END) AS res FROM (SELECT *, max(s) OVER (PARTITION BY o, session_id, k) AS top FROM fc) GROUP BY 1, 2, 3),
pairs AS (SELECT lg.session_id, lg.k, pr.o, a, b, qa.sqi < {GATE} OR qb.sqi < {GATE} AS gated, lag, res, sa.ac AS ac_a, sa.dc AS dc_a, mm.ac AS ac_b, sb.dc AS dc_b,
  (sa.ac / (sa.dc + 1e-12)) / (mm.ac / (sb.dc + 1e-12) + 1e-12) AS r
  FROM lg JOIN pr USING (o) JOIN mm USING (o, session_id, k) JOIN fr USING (o, session_id, k)
  JOIN st sa ON sa.session_id = lg.session_id AND sa.k = lg.k AND sa.c = a JOIN st sb ON sb.session_id = lg.session_id AND sb.k = lg.k AND sb.c = b
  JOIN q qa ON qa.session_id = lg.session_id AND qa.k = lg.k AND qa.c = a JOIN q qb ON qb.session_id = lg.session_id AND qb.k = lg.k AND qb.c = b)"""


def _gated(e: str, name: str) -> str:
    return sq(f"CASE WHEN NOT gated THEN {e} END", name)


@query("ratio_of_ratios", f"""WITH {SIG}, {FEATS} SELECT session_id, k AS window_id, a, b, {_gated('r', 'r')}, {_gated('ac_a', 'ac_a')}, {_gated('dc_a', 'dc_a')}, {_gated('ac_b', 'ac_b')}, {_gated('dc_b', 'dc_b')},
CAST(CASE WHEN gated THEN 0 ELSE lag END AS INTEGER) AS lag_applied, CAST(CASE WHEN gated THEN 0 ELSE res END AS INTEGER) AS lag_residual FROM pairs""")
def ratio_of_ratios(spark, sf):
    return rounded(features.per_pair(_features(spark, sf), K).drop("combo_ord"), "r", "ac_a", "dc_a", "ac_b", "dc_b")


@query("window_quality", f"WITH {SIG}, {FEATS} SELECT session_id, k AS window_id, c AS channel, {sq('sqi', 'sqi')}, {sq('skew', 'skewness')}, {sq('kurt', 'kurtosis')} FROM q JOIN st USING (session_id, k, c)")
def window_quality(spark, sf):
    return rounded(features.per_channel(_features(spark, sf), K), "sqi", "skewness", "kurtosis")


@query("sqi_gate", f"WITH {SIG}, {FEATS} SELECT a, b, count(*) AS windows, CAST(sum(CASE WHEN gated THEN 1 ELSE 0 END) AS BIGINT) AS gated FROM pairs GROUP BY a, b")
def sqi_gate(spark, sf):
    return features.per_pair(_features(spark, sf), K).groupBy("a", "b").agg(F.count("*").alias("windows"), F.count_if(F.col("r").isNull()).alias("gated"))


_BASE = f"session_id, k AS window_id, {sq('t0', 't0')}, {sq('t1', 't1')}, {sq('tc', 'time_center')}, {sq('spo2', 'spo2')}, {sq('mf', 'motion_frac')}, {sq('mr', 'motion_rms')}, {sq('am', 'acc_mag_mean')}, CAST(mf > 0.5 AS INTEGER) AS high_motion_window"


@query("all_r_nonnull", f"WITH {SIG}, {FEATS} SELECT {_BASE} FROM base WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.session_id = base.session_id AND p.k = base.k AND gated)")
def all_r_nonnull(spark, sf):
    out = features.require_all_ratios(_features(spark, sf)).drop("channels", "combos")
    return rounded(out, *features.BASE)


@query("motion_gate", f"WITH {SIG}, {FEATS} SELECT {_BASE} FROM base WHERE mf <= 0.5")
def motion_gate(spark, sf):
    return rounded(features.gate_motion(_features(spark, sf)).drop("channels", "combos"), *features.BASE)


_WIDE = ", ".join(
    [f"max(CASE WHEN o = {o} AND NOT gated THEN round(r::DOUBLE, 6) END) + 0 AS R_{a}_{b}, CAST(max(CASE WHEN o = {o} THEN CASE WHEN gated THEN 0 ELSE res END END) AS INTEGER) AS lag_{a}_{b}" for o, (a, b) in enumerate(PAIRS)]
    + [f"max(CASE WHEN o = {o} AND NOT gated THEN round(ac_{s}::DOUBLE, 6) END) + 0 AS AC_{c}, max(CASE WHEN o = {o} AND NOT gated THEN round(dc_{s}::DOUBLE, 6) END) + 0 AS DC_{c}" for c, o, s in (("red", 1, "b"), ("ir", 2, "b"), ("green", 2, "a"))]
)


@query("wide_features", f"WITH {SIG}, {FEATS} SELECT session_id, k AS window_id, {_WIDE} FROM pairs GROUP BY 1, 2")
def wide_features(spark, sf):
    out = features.wide(_features(spark, sf), K, PAIRS)
    keep = [c for c in out.columns if c.startswith(("R_", "AC_", "DC_"))]
    return out.select("session_id", "window_id", *[r6(c, c) for c in keep], *[c for c in out.columns if c.startswith("lag_")])


# ---- spectra of stored windows ----------------------------------------------------------

DFT = """e AS (SELECT vec_id, j, embedding[j + 1]::DOUBLE AS x FROM embeddings, unnest(range(0, 64)) AS u(j)),
d AS (SELECT *, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS t FROM e),
psd AS (SELECT vec_id, b, (sum(t * cos(2 * pi() * b * j / 64)) ** 2 + sum(t * sin(2 * pi() * b * j / 64)) ** 2) * CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END AS p,
  sqrt(sum(x * cos(2 * pi() * b * j / 64)) ** 2 + sum(x * sin(2 * pi() * b * j / 64)) ** 2) AS mag FROM d, unnest(range(0, 33)) AS v(b) GROUP BY 1, 2)"""
# bin width 50 / 64 Hz: the band 0.5..4 Hz holds bins 1 to 5
_SPECTRA = {
    "welch_sqi": ("sqi", "sum(CASE WHEN b BETWEEN 1 AND 4 THEN t END) / sum(t)"),
    "snr": ("snr", "sum(CASE WHEN b BETWEEN 1 AND 5 THEN p ELSE 0 END) / sum(CASE WHEN b BETWEEN 1 AND 5 THEN 0 ELSE p END)"),
    "relative_power": ("relative_power", "sum(CASE WHEN b BETWEEN 1 AND 5 THEN p ELSE 0 END) / sum(p)"),
    "spectral_entropy": ("entropy", "-sum(p / s * log2(p / s + 1e-12))"),
    "spectral_sqi_array": ("magnitude_share", "sum(CASE WHEN b BETWEEN 1 AND 5 THEN mag ELSE 0 END) / sum(mag)"),
}
for _name, (_metric, _expr) in _SPECTRA.items():

    def _spectrum(spark, sf, m=_metric):
        e = table(spark, sf, "embeddings")
        return e.select("vec_id", r6(spectra.metric(m, F.col("embedding"), 50.0), "v"))

    query(_name, f"""WITH {DFT}, s AS (SELECT *, sum(p) OVER (PARTITION BY vec_id) AS s, CASE WHEN b < 32 THEN (p + lead(p) OVER (PARTITION BY vec_id ORDER BY b)) / 2 END AS t FROM psd)
SELECT vec_id, {sq(_expr, 'v')} FROM s GROUP BY vec_id""")(_spectrum)

def sql_pulses(fs: float, half: int, tag: str = "") -> str:
    """CTEs ``beats(vec_id, kept)``, peaks by greedy suppression, and ``shape(vec_id, c)``, the mean correlation of inner pulses."""
    gap = int(np.ceil(fs * 0.4))
    return f"""lev AS (SELECT vec_id, j, embedding[j + 1]::DOUBLE AS x, lag(embedding[j + 1]) OVER w AS a, lead(embedding[j + 1]) OVER w AS b FROM embeddings, unnest(range(0, 64)) AS u(j) WINDOW w AS (PARTITION BY vec_id ORDER BY j)),
cand AS (SELECT vec_id, list_reverse_sort(list({{'h': x, 'p': j}}) FILTER (WHERE x > a AND x > b)) AS todo FROM lev GROUP BY 1),
greedy AS (SELECT vec_id, coalesce(todo, []) AS todo, []::BIGINT[] AS kept FROM cand
  UNION ALL SELECT vec_id, list_filter(todo[2:], lambda q: abs(q.p - todo[1].p) >= {gap}), list_append(kept, todo[1].p) FROM greedy WHERE len(todo) > 0),
beats AS (SELECT vec_id, list_sort(kept) AS kept FROM greedy WHERE len(todo) = 0),
inner_p AS (SELECT vec_id, unnest(kept[2:-2]) AS p FROM beats WHERE len(kept) >= 3),
pulse AS (SELECT vec_id, p, j, embedding[p - {half} + j + 1]::DOUBLE AS v FROM inner_p JOIN embeddings USING (vec_id), unnest(range(0, {2 * half})) AS u(j) WHERE p >= {half} AND p + {half} <= 64),
form AS (SELECT vec_id, p, j, v - avg(v) OVER (PARTITION BY vec_id, p) AS d, avg(v) OVER (PARTITION BY vec_id, j) - avg(v) OVER (PARTITION BY vec_id) AS m FROM pulse),
shape AS (SELECT vec_id, avg(c) AS c FROM (SELECT vec_id, p, sum(d * m) / sqrt(sum(d * d) * sum(m * m)) AS c FROM form GROUP BY 1, 2) GROUP BY 1)"""


_RATE = "CASE WHEN len(kept) >= 2 THEN 60e0 / ((kept[-1] - kept[1]) / (len(kept) - 1) / {fs}e0) END"
_CONSISTENCY = "CASE WHEN len(kept) < 3 THEN 0e0 ELSE c END"
for _name, _metric, _expr in (("heart_rate", "heart_rate", _RATE.format(fs=20)), ("pulse_consistency", "consistency", _CONSISTENCY)):

    def _morph(spark, sf, m=_metric):
        return table(spark, sf, "embeddings").select("vec_id", r6(spectra.metric(m, F.col("embedding"), 20.0), "v"))

    query(_name, f"WITH RECURSIVE {sql_pulses(20.0, 6)} SELECT vec_id, {sq(_expr, 'v')} FROM beats LEFT JOIN shape USING (vec_id)")(_morph)


_MOMENT = {k: f"list_avg(list_transform(x, lambda v: (v - m) ** {k}))" for k in (2, 3, 4)}
_Q = {
    "perfusion": "s / (m + 10)", "skewness": f"{_MOMENT[3]} / {_MOMENT[2]} ** 1.5e0", "kurtosis": f"{_MOMENT[4]} / {_MOMENT[2]} ** 2 - 3", "snr": "snr", "entropy": "ent",
    "relative_power": "rel", "heart_rate": _RATE.format(fs=50), "consistency": _CONSISTENCY, "sqi": "share",
}
_STRICT = " AND ".join(
    f"coalesce({' AND '.join([f'{n} >= {low}'] * (low is not None) + [f'{n} <= {high}'] * (high is not None))}, {str(n != 'heart_rate').lower()})" for n, (low, high) in spectra.LIMITS.items()
)


@query("quality_vector", f"""WITH RECURSIVE {DFT}, {sql_pulses(50.0, 15)},
spec AS (SELECT vec_id, {_SPECTRA['snr'][1]} AS snr, {_SPECTRA['relative_power'][1]} AS rel, {_SPECTRA['spectral_entropy'][1]} AS ent, {_SPECTRA['spectral_sqi_array'][1]} AS share FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id) AS s FROM psd) GROUP BY 1),
vec AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), st AS (SELECT vec_id, x, list_avg(x) AS m, list_stddev_pop(x) AS s FROM vec),
q AS (SELECT vec_id, {', '.join(f'{e} AS {n}' for n, e in _Q.items())} FROM st JOIN spec USING (vec_id) JOIN beats USING (vec_id) LEFT JOIN shape USING (vec_id))
SELECT vec_id, {', '.join(sq(n, n) for n in _Q)}, {_STRICT} AS strict, true AS accepted FROM q""")
def quality_vector(spark, sf):
    e = table(spark, sf, "embeddings")
    raw = F.transform("embedding", lambda v: v.cast("double") + 10.0)
    q = e.select("vec_id", spectra.quality_vector(raw, F.col("embedding"), 50.0).alias("q"))
    return q.select("vec_id", *[r6(F.col(f"q.{n}"), n) for n in spectra.QUALITY], spectra.passes(F.col("q"), spectra.LIMITS).alias("strict"), spectra.passes(F.col("q")).alias("accepted"))


_WIN_FLT, _WIN_FLT4 = filters.butterworth(2, 0.5, 3.0, 8.0), filters.butterworth(4, 0.5, 3.0, 8.0)
_WIN_ROWS = f"""{SIG.replace('sig AS (', 'sig0 AS (', 1).replace('cnt AS (SELECT session_id, count(*) AS n FROM sig ', 'cnt0 AS (SELECT session_id, count(*) AS n FROM sig0 ')},
wk AS (SELECT session_id, unnest(range(0, n // 8 - 5)) AS k FROM cnt0 WHERE n // 8 > 5),
sig AS (SELECT s.session_id * 1000 + k AS session_id, s.i - k * 8 AS i, red, ir FROM wk JOIN sig0 s ON s.session_id = wk.session_id AND s.i >= k * 8 AND s.i < k * 8 + 32),
cnt AS (SELECT session_id, count(*) AS n FROM sig GROUP BY 1)"""
_WIN_STATS = """dcs AS (SELECT session_id, avg(red) AS dr, avg(ir) AS di FROM sig GROUP BY 1),
acs AS (SELECT session_id, stddev_pop(zp.x) AS ar, stddev_pop(zq.x) AS ai FROM zp JOIN zq USING (session_id, p) WHERE p >= 0 AND p < 32 GROUP BY 1)"""
_WIN = f"""{_WIN_ROWS},
{sql_zero_phase('red', _WIN_FLT, '0e0')},
{sql_zero_phase('ir', _WIN_FLT, '0e0').replace('ext', 'exu').replace('fw', 'fx').replace('zp', 'zq')},
{_WIN_STATS}"""
_WIN4 = f"""{_WIN_ROWS},
{sql_zero_cascade('red', _WIN_FLT4, '0e0', 'a')},
{sql_zero_cascade('ir', _WIN_FLT4, '0e0', 'b')},
{_WIN_STATS.replace('zp', 'zpa').replace('zq', 'zpb')}"""


@query("ratio_windows", f"WITH RECURSIVE {_WIN4} SELECT session_id // 1000 AS session_id, session_id % 1000 AS sec_idx, {sq('(ar / dr) / (ai / di)', 'r')} FROM dcs JOIN acs USING (session_id)")
def ratio_windows(spark, sf):
    sig = recording(spark, sf, "red", "ir")
    return rounded(spectra.ratio_windows(sig, K, "red", "ir", 8, 4, 0.5, 3.0, 4), "r")


@query("ratio_windows_order2", f"WITH RECURSIVE {_WIN} SELECT session_id // 1000 AS session_id, session_id % 1000 AS sec_idx, {sq('(ar / dr) / (ai / di)', 'r')} FROM dcs JOIN acs USING (session_id)")
def ratio_windows_order2(spark, sf):
    sig = recording(spark, sf, "red", "ir")
    return rounded(spectra.ratio_windows(sig, K, "red", "ir", 8, 4, 0.5, 3.0, 2), "r")


@query("cancelled_ratio_windows")
def cancelled_ratio_windows(spark, sf):
    sig = recording(spark, sf, "red", "ir", "accx", "accy", "accz")
    scaled = sig.select(*K, "sample_idx", "red", "ir", *[(F.col(c) / 50.0).alias(c) for c in ("accx", "accy", "accz")])
    out = spectra.cancelled_ratio_windows(scaled, K, "red", "ir", ["accx", "accy", "accz"], 50.0, 20, 5)
    return rounded(out, "r")


# ---- calibration samples ------------------------------------------------------------------

SMP = """smp AS (SELECT session_id, combo, i AS row, n, time AS time_center, CAST(event_id % 5 = 0 AS INTEGER) AS motion, x, spo2 AS y, greatest(0.05, ((event_id * 11) % 100) / 100e0) AS w FROM (
  SELECT *, 'red_ir' AS combo, red / ir AS x FROM sig UNION ALL SELECT *, 'green_blue', green / blue FROM sig) JOIN cnt USING (session_id))"""


# All pairs; a ratio to nothing is no sample.
SMP_ALL = """smp AS (SELECT session_id, combo, i AS row, n, time AS time_center, CAST(event_id % 5 = 0 AS INTEGER) AS motion, x, spo2 AS y, greatest(0.05, ((event_id * 11) % 100) / 100e0) AS w FROM (
  """ + " UNION ALL ".join(f"SELECT *, '{a}_{b}' AS combo, {a} / {b} AS x FROM sig WHERE {b} <> 0" for a, b in PAIRS_MAIN) + ") JOIN cnt USING (session_id))"


def _samples(spark, sf, *combos, pairs=(("red", "ir"), ("green", "blue"))):
    pairs = [p for p in pairs if not combos or "_".join(p) in combos]
    long = F.filter(F.array(*[F.struct(F.lit(c).alias("combo"), x.alias("x")) for c, x in _ratios(pairs).items()]), lambda p: p["x"].isNotNull())
    return _wide_samples(spark, sf).select(*K, "row", "n", "time_center", "motion", F.inline(long), "y", "w")


def _ratios(pairs=PAIRS_MAIN):
    return {f"{a}_{b}": F.try_divide(F.col(a), F.col(b)) for a, b in pairs}


def _wide_samples(spark, sf):
    sig = recording(spark, sf, "red", "ir", "green", "blue", "spo2", "time", "n")
    return sig.select(
        *K, F.col("sample_idx").alias("row"), "n", F.col("time").alias("time_center"), (F.col("event_id") % 5 == 0).cast("int").alias("motion"),
        "red", "ir", "green", "blue", F.col("spo2").alias("y"), F.greatest(F.lit(0.05), (F.col("event_id") * 11 % 100) / 100).alias("w"),
    )


def sql_fits(src: str, by: str, w: str = "w", tag: str = "") -> str:
    """CTE ``fit(by, model, p0, p1, p2)`` of the closed-form models; ``tag`` ends the names."""
    text = f"""mo AS (SELECT {by}, sum({w}) AS s0, sum({w} * x) / sum({w}) AS mx, sum({w} * y) / sum({w}) AS my, stddev_pop(x) AS sd FROM {src} GROUP BY {by}),
cv AS (SELECT {by}, any_value(mx) AS mx, any_value(my) AS my, any_value(sd) AS sd, sum({w} * (x - mx) ** 2) / any_value(s0) AS vu, sum({w} * (x - mx) * (y - my)) / any_value(s0) AS cuv,
  sum({w} * (x - mx) ** 3) / any_value(s0) AS c12, sum({w} * (x - mx) ** 4) / any_value(s0) AS m4, sum({w} * (x - mx) ** 2 * (y - my)) / any_value(s0) AS c2v FROM {src} JOIN mo USING ({by}) GROUP BY {by}),
qd AS (SELECT *, (cuv * (m4 - vu * vu) - c2v * c12) / (vu * (m4 - vu * vu) - c12 * c12) AS q1, (c2v * vu - cuv * c12) / (vu * (m4 - vu * vu) - c12 * c12) AS q2, cuv / vu AS b,
  sign(cuv) * greatest(abs(cuv / sd) - 0.5, 0) / (vu / sd ** 2 + 0.5) / sd AS eb FROM cv),
fit AS (SELECT {by}, 'linear' AS model, my - b * mx AS p0, b AS p1, 0e0 AS p2 FROM qd UNION ALL SELECT {by}, 'elasticnet', my - eb * mx, eb, 0e0 FROM qd
  UNION ALL SELECT {by}, 'quadratic', my - q1 * mx + q2 * (mx * mx - vu), q1 - 2 * q2 * mx, q2 FROM qd)"""
    return re.sub(r"\b(mo|cv|qd|fit)\b", rf"\1{tag}", text)


for _name, _model, _w in (("ols_fit", "linear", False), ("weighted_ols", "linear", True), ("quadratic_fit", "quadratic", True), ("elasticnet_1d", "elasticnet", True)):

    def _fit(spark, sf, m=_model, weighted=_w):
        rows = _samples(spark, sf)
        rows = rows if weighted else rows.withColumn("w", F.lit(1.0))
        out = models.fit_closed(rows, [*K, "combo"], [m])
        return rounded(out.drop("model"), "p0", "p1", "p2")

    query(_name, f"WITH {SIG}, {SMP}, {sql_fits('smp', 'session_id, combo', 'w' if _w else '1')} SELECT session_id, combo, {sq('p0', 'p0')}, {sq('p1', 'p1')}, {sq('p2', 'p2')} FROM fit WHERE model = '{_model}'")(_fit)


@query("standard_scaler", f"WITH {SIG}, {SMP} SELECT session_id, combo, row, {sq('(x - avg(x) OVER v) / stddev_pop(x) OVER v', 'z')} FROM smp WINDOW v AS (PARTITION BY session_id, combo)")
def standard_scaler(spark, sf):
    return models.standardise(_samples(spark, sf), [*K, "combo"]).select(*K, "combo", "row", r6("z", "z"))


@query("sqi_weights", f"WITH {SIG}, {FEATS} SELECT pr.o AS combo_ord, qa.session_id, qa.k AS window_id, {sq('greatest(0.05, least(1, (qa.sqi + qb.sqi) / 2))', 'w')} FROM pr JOIN q qa ON qa.c = a JOIN q qb ON qb.c = b AND qb.session_id = qa.session_id AND qb.k = qa.k")
def sqi_weights(spark, sf):
    long = features.per_pair(_features(spark, sf), K, "channels")
    w = models.quality_weight(models.channel_quality(F.col("channels"), F.col("a")), models.channel_quality(F.col("channels"), F.col("b")))
    return long.select("combo_ord", "session_id", "window_id", r6(w, "w"))


CV = f"""tr AS (SELECT s.*, f AS fold FROM smp s, unnest(range(1, 6)) AS u(f) WHERE row < n - (6 - f) * (n // 6)),
te AS (SELECT s.*, f AS fold FROM smp s, unnest(range(1, 6)) AS u(f) WHERE row >= n - (6 - f) * (n // 6) AND row < n - (5 - f) * (n // 6)),
{sql_fits('tr', 'session_id, combo, fold')},
pred AS (SELECT te.session_id, te.combo, fit.model, te.fold, row, time_center, motion, y AS y_true, p0 + p1 * x + p2 * x * x AS y_pred FROM te JOIN fit USING (session_id, combo, fold))"""


def sql_metrics(flt: str = "", suffix: str = "") -> str:
    f = f" FILTER (WHERE {flt})" if flt else ""
    e = "(y_pred - y_true)"
    guard = (lambda x: f"CASE WHEN count(*){f} > 1 THEN {x} END") if flt else (lambda x: x)
    parts = {
        "RMSE": f"sqrt(avg({e} ** 2){f})", "MAE": f"avg(abs{e}){f}", "Bias": f"avg({e}){f}", "SD_error": f"stddev_samp({e}){f}",
        "R2": f"1 - sum({e} ** 2){f} / (var_pop(y_true){f} * count(*){f})", "MAPE_pct": f"avg(abs{e} / greatest(abs(y_true), 1e-6)){f} * 100",
    }
    return ", ".join(f"{guard(v)} AS {k}{suffix}" for k, v in parts.items())


METRICS = f"met AS (SELECT session_id, combo, model, fold, {sql_metrics()}, {sql_metrics('motion = 0', '_lo')}, {sql_metrics('motion = 1', '_hi')} FROM pred GROUP BY 1, 2, 3, 4)"
_NAMES = [f"{m}{s}" for s in ("", "_lo", "_hi") for m in models.METRICS]
SUMMARY = "summ AS (SELECT session_id, combo, model, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in _NAMES) + " FROM met GROUP BY 1, 2, 3)"
BEST = "best AS (SELECT * FROM (SELECT session_id, combo, model, RMSE_mean AS cv_rmse, row_number() OVER (PARTITION BY session_id ORDER BY RMSE_mean, combo, model) AS rk FROM summ) WHERE rk = 1)"
_CV = f"WITH {SIG}, {SMP}, {CV}"


def _pred(spark, sf):
    return models.cross_validate(_samples(spark, sf), K, 5, models.CLOSED)


@query("ts_cv_folds", f"WITH {SIG}, {SMP}, {CV} SELECT session_id, combo, fold, count(*) AS test_rows, min(row) AS first_test FROM te GROUP BY 1, 2, 3")
def ts_cv_folds(spark, sf):
    b = models.add_blocks(_samples(spark, sf)).where("block > 0")
    return b.groupBy(*K, "combo", F.col("block").cast("bigint").alias("fold")).agg(F.count("*").alias("test_rows"), F.min("row").alias("first_test"))


@query("cv_predictions", f"{_CV} SELECT session_id, combo, model, CAST(fold AS INTEGER) AS fold, row, {sq('time_center', 'time_center')}, motion, {sq('y_true', 'y_true')}, {sq('y_pred', 'y_pred')} FROM pred")
def cv_predictions(spark, sf):
    return rounded(_pred(spark, sf), "time_center", "y_true", "y_pred")


@query("cv_metrics", f"{_CV}, {METRICS} SELECT session_id, combo, model, CAST(fold AS INTEGER) AS fold, {', '.join(sq(m, m) for m in _NAMES)} FROM met")
def cv_metrics(spark, sf):
    return rounded(models.fold_metrics(_pred(spark, sf), K), *_NAMES)


@query("cv_summary", f"{_CV}, {METRICS}, {SUMMARY} SELECT session_id, combo, model, {', '.join(sq(f'{m}_{s}', f'{m}_{s}') for m in _NAMES for s in ('mean', 'std'))} FROM summ")
def cv_summary(spark, sf):
    out = models.cv_summary(models.fold_metrics(_pred(spark, sf), K), K)
    return rounded(out, *[f"{m}_{s}" for m in _NAMES for s in ("mean", "std")])


@query("best_model", f"{_CV}, {METRICS}, {SUMMARY}, {BEST} SELECT session_id, combo, model, {sq('cv_rmse', 'cv_rmse')} FROM best")
def best_model(spark, sf):
    summary = models.cv_summary(models.fold_metrics(_pred(spark, sf), K, by_motion=False), K)
    return rounded(models.best_models(summary, K), "cv_rmse")


@query("top_results", f"{_CV}, {METRICS}, {SUMMARY} SELECT session_id, combo, model, {sq('RMSE_mean', 'RMSE_mean')} FROM summ ORDER BY RMSE_mean, combo, model LIMIT 10")
def top_results(spark, sf):
    summary = models.cv_summary(models.fold_metrics(_pred(spark, sf), K, by_motion=False), K)
    return views.top_results(summary).select("session_id", "combo", "model", r6("RMSE_mean", "RMSE_mean"))


@query("metrics_view", f"{_CV}, {METRICS}, {SUMMARY} SELECT session_id, combo || ' | ' || model AS label, {sq('RMSE_mean', 'RMSE_mean')}, {sq('RMSE_std', 'RMSE_std')} FROM summ")
def metrics_view(spark, sf):
    summary = models.cv_summary(models.fold_metrics(_pred(spark, sf), K, by_motion=False), K)
    return rounded(views.summary_view(summary, K), "RMSE_mean", "RMSE_std")


@query("fold_detail_view", f"{_CV}, {METRICS}, {SUMMARY}, {BEST} SELECT session_id, combo, model, row, {sq('y_true', 'y_true')}, {sq('y_pred', 'y_pred')} FROM pred JOIN best USING (session_id, combo, model) WHERE fold = 5")
def fold_detail_view(spark, sf):
    pred = materialise(_pred(spark, sf), "pred")
    best = models.best_models(models.cv_summary(models.fold_metrics(pred, K, by_motion=False), K), K)
    return views.best_folds(pred, best, K, 5).select("session_id", "combo", "model", "row", r6("y_true", "y_true"), r6("y_pred", "y_pred"))


@query("scatter_view", f"""{_CV}, {METRICS}, {SUMMARY}, {BEST} SELECT session_id, CAST(fold AS INTEGER) AS fold, row, motion, {sq('y_true', 'y_true')}, {sq('y_pred', 'y_pred')},
{sq('least(min(y_true) OVER v, min(y_pred) OVER v)', 'low')}, {sq('greatest(max(y_true) OVER v, max(y_pred) OVER v)', 'high')} FROM pred JOIN best USING (session_id, combo, model) WINDOW v AS (PARTITION BY session_id)""")
def scatter_view(spark, sf):
    pred = materialise(_pred(spark, sf), "pred")
    best = models.best_models(models.cv_summary(models.fold_metrics(pred, K, by_motion=False), K), K)
    return rounded(views.scatter_view(pred, best, K), "y_true", "y_pred", "low", "high")


# ---- views of signals ------------------------------------------------------------------------


@query("signal_view", f"""WITH {SIG}, h AS (SELECT * FROM (SELECT *, min(clock) OVER (PARTITION BY session_id) AS t0 FROM sig) WHERE clock <= t0 + 200)
SELECT session_id, i AS sample_idx, {sq('(red - avg(red) OVER v) / (stddev_pop(red) OVER v + 1e-12)', 'red_z')}, {sq('(ir - avg(ir) OVER v) / (stddev_pop(ir) OVER v + 1e-12)', 'ir_z')} FROM h WINDOW v AS (PARTITION BY session_id)""")
def signal_view(spark, sf):
    sig = recording(spark, sf, "ts", "clock", "red", "ir").withColumn("time", F.col("clock"))
    return views.signal_view(sig, K, ["red", "ir"], 200.0).select("session_id", "sample_idx", r6("red_z", "red_z"), r6("ir_z", "ir_z"))


@query("motion_view", f"""WITH {SIG}, h AS (SELECT * FROM (SELECT *, min(clock) OVER (PARTITION BY session_id) AS t0 FROM sig) WHERE clock <= t0 + 200)
SELECT session_id, i AS sample_idx, {sq('abs(accx)', 'motion_energy')}, {sq('min(abs(accx)) FILTER (WHERE abs(accx) > 40) OVER (PARTITION BY session_id)', 'threshold')} FROM h""")
def motion_view(spark, sf):
    sig = recording(spark, sf, "ts", "clock", "accx").withColumn("time", F.col("clock")).withColumn("motion_energy", F.abs("accx"))
    sig = sig.withColumn("high_motion", (F.col("motion_energy") > 40).cast("int"))
    return views.motion_view(sig, K, 200.0).select("session_id", "sample_idx", r6("motion_energy", "motion_energy"), r6("threshold", "threshold"))


# ---- training and transfer --------------------------------------------------------------------

# Each session's best pair and model of all, fitted again on its rows; every odd session reads the model of the one before.
TRAINED = f"""{SMP_ALL}, {CV}, {METRICS}, {SUMMARY}, {BEST.replace("ORDER BY RMSE_mean,", "ORDER BY round(RMSE_mean, 9),")},
trn AS (SELECT session_id, x, y FROM smp JOIN best USING (session_id, combo)), {sql_fits('trn', 'session_id', '1', '_t')},
trained AS (SELECT b.session_id, combo, b.model, p0, p1, p2, cv_rmse FROM best b JOIN fit_t f ON f.session_id = b.session_id AND f.model = b.model)"""
TRANSFER = f"""{TRAINED},
tp AS (SELECT o.session_id, row, time_center, y AS spo2_reference, p0 + p1 * x + p2 * x * x AS spo2_estimated, cv_rmse FROM smp o JOIN trained t ON t.session_id = o.session_id - 1 AND t.combo = o.combo WHERE o.session_id % 2 = 1)"""


def _trained(rows):
    """The model table of all sessions in the wide ``rows``."""
    best = materialise(models.best_models(models.validate_pairs(rows, _ratios(), K, 5, models.CLOSED), K, digits=9), "best")
    return models.fit_selected(models.pick_pairs(rows, _ratios(), best, K), best, K)


def _transfer(spark, sf):
    rows = materialise(_wide_samples(spark, sf), "samples")
    trained = materialise(_trained(rows.where("session_id % 2 = 0")), "trained")
    new = models.pick_pairs(rows.where("session_id % 2 = 1"), _ratios(), trained.withColumn("session_id", F.col("session_id") + 1), K)
    return models.transfer(trained.withColumnRenamed("session_id", "subject"), new.withColumn("subject", F.col("session_id") - 1), K, ["subject"])


@query("train_best", f"WITH {SIG}, {TRAINED} SELECT session_id, combo, model, {sq('any_value(p0)', 'p0')}, {sq('any_value(p1)', 'p1')}, {sq('any_value(p2)', 'p2')}, {sq('sqrt(avg((y - p0 - p1 * x - p2 * x * x) ** 2))', 'train_rmse')}, {sq('any_value(cv_rmse)', 'cv_rmse')} FROM trn JOIN trained USING (session_id) GROUP BY 1, 2, 3")
def train_best(spark, sf):
    t = _trained(materialise(_wide_samples(spark, sf), "samples"))
    return t.select("session_id", "combo", "model", *[r6(F.col("params")[i], f"p{i}") for i in range(3)], r6("train_rmse", "train_rmse"), r6("cv_rmse", "cv_rmse"))


@query("transfer_apply", f"WITH {SIG}, {TRANSFER} SELECT session_id, {sq('time_center', 'time_center')}, {sq('spo2_reference', 'spo2_reference')}, {sq('spo2_estimated', 'spo2_estimated')}, {sq('spo2_estimated - spo2_reference', 'residual')} FROM tp")
def transfer_apply(spark, sf):
    return rounded(_transfer(spark, sf).drop("cv_rmse"), "time_center", "spo2_reference", "spo2_estimated", "residual")


@query("transfer_metrics", f"WITH {SIG}, {TRANSFER}, t2 AS (SELECT session_id, spo2_reference AS y_true, spo2_estimated AS y_pred FROM tp), m AS (SELECT session_id, {sql_metrics()} FROM t2 GROUP BY 1) SELECT session_id, {', '.join(sq(m, m) for m in models.METRICS)} FROM m")
def transfer_metrics(spark, sf):
    return rounded(views.transfer_metrics(_transfer(spark, sf), K), *models.METRICS)


@query("bland_altman", f"""WITH {SIG}, {TRANSFER}, d AS (SELECT *, spo2_estimated - spo2_reference AS d FROM tp)
SELECT session_id, {sq('time_center', 'time_center')}, {sq('(spo2_estimated + spo2_reference) / 2', 'mean')}, {sq('d', 'diff')}, {sq('avg(d) OVER v', 'bias')}, {sq('avg(d) OVER v + 1.96 * stddev_samp(d) OVER v', 'loa_high')}, {sq('avg(d) OVER v - 1.96 * stddev_samp(d) OVER v', 'loa_low')}
FROM d WINDOW v AS (PARTITION BY session_id)""")
def bland_altman(spark, sf):
    return rounded(views.bland_altman(_transfer(spark, sf), K), "time_center", "mean", "diff", "bias", "loa_high", "loa_low")


@query("error_summary", f"""WITH {SIG}, {TRANSFER}, t2 AS (SELECT session_id, spo2_reference AS y_true, spo2_estimated AS y_pred FROM tp), m AS (SELECT session_id, {sql_metrics()} FROM t2 GROUP BY 1)
SELECT session_id, ord, measure, {sq('value', 'value')}, {sq('cv_rmse', 'cv_rmse')} FROM (SELECT session_id, any_value(cv_rmse) AS cv_rmse FROM tp GROUP BY 1) JOIN (SELECT session_id, 0 AS ord, 'RMSE' AS measure, RMSE AS value FROM m UNION ALL SELECT session_id, 1, 'MAE', MAE FROM m UNION ALL SELECT session_id, 2, 'abs_Bias', abs(Bias) FROM m UNION ALL SELECT session_id, 3, 'SD_error', SD_error FROM m) USING (session_id)""")
def error_summary(spark, sf):
    pred = _transfer(spark, sf)
    return rounded(views.error_summary(pred, K, pred.groupBy(*K).agg(F.first("cv_rmse").alias("cv_rmse"))), "value", "cv_rmse")


@query("error_hist", f"""WITH {SIG}, {TRANSFER}, e AS (SELECT session_id, spo2_estimated - spo2_reference AS e FROM tp), s AS (SELECT session_id, min(e) AS a, max(e) AS z, stddev_pop(e) AS spread FROM e GROUP BY 1)
SELECT session_id, bin, {sq('any_value(a + bin * ((z - a) / 30))', 'low')}, count(*) AS count, {sq('any_value(spread)', 'spread')} FROM (SELECT *, CAST(least(floor((e - a) / ((z - a) / 30)), 29) AS INTEGER) AS bin FROM e JOIN s USING (session_id)) GROUP BY 1, 2""")
def error_hist(spark, sf):
    return rounded(views.error_histogram(_transfer(spark, sf), K, F.col("residual")), "low", "spread")


# ---- splits -----------------------------------------------------------------------------------


@query("purged_split", f"""WITH {SIG}, s AS (SELECT session_id, i, n, session_id % 30 AS st, floor(n * (1e0 - 8e-1))::BIGINT AS sz FROM sig JOIN cnt USING (session_id))
SELECT session_id, i AS row, 'test' AS part FROM s WHERE i >= st AND i <= st + sz UNION ALL SELECT session_id, i, 'train' FROM s WHERE i >= st + sz + 6 OR (st >= 6 AND i < st - 6)""")
def purged_split(spark, sf):
    sig = recording(spark, sf).withColumnRenamed("sample_idx", "row")
    return splits.purged_split(sig, K, 0.8, 6, F.col("session_id") % 30).select("session_id", "row", "part")


@query("block_shuffle", f"""WITH {SIG}, b AS (SELECT session_id, i, i // 7 AS b FROM sig JOIN cnt USING (session_id) WHERE i // 7 < n // 7),
o AS (SELECT session_id, b, row_number() OVER (PARTITION BY session_id ORDER BY (b * 7 + 3) % 11, b) - 1 AS t FROM (SELECT DISTINCT session_id, b FROM b))
SELECT session_id, i AS row, t * 7 + i % 7 AS new_row FROM b JOIN o USING (session_id, b)""")
def block_shuffle(spark, sf):
    sig = recording(spark, sf).withColumnRenamed("sample_idx", "row")
    return splits.block_shuffle(sig, K, 7, (F.col("_block") * 7 + 3) % 11).select("session_id", "row", "new_row")


@query("head_tail_split", f"WITH {SIG} SELECT session_id, i AS row, CASE WHEN i < floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM sig JOIN cnt USING (session_id) WHERE i <> floor(n * 0.7)")
def head_tail_split(spark, sf):
    return splits.head_tail_split(recording(spark, sf).withColumnRenamed("sample_idx", "row"), K, 0.7).select("session_id", "row", "part")


@query("repeated_holdout", f"""WITH {SIG}, s AS (SELECT session_id, rep, i, n, red / ir AS x, spo2 AS y, (session_id + rep * 13) % 40 AS st, floor(n * (1e0 - 8e-1))::BIGINT AS sz FROM sig JOIN cnt USING (session_id), unnest(range(0, 4)) AS u(rep)),
t AS (SELECT *, row_number() OVER v - 1 AS j, count(*) OVER (PARTITION BY session_id, rep) AS m FROM s WHERE i >= st + sz + 5 OR (st >= 5 AND i < st - 5) WINDOW v AS (PARTITION BY session_id, rep ORDER BY i)),
f AS (SELECT session_id, rep, regr_intercept(y, x) AS a, -regr_slope(y, x) AS b FROM t WHERE j < m - m % 5 GROUP BY 1, 2)
SELECT session_id, {sq('avg(a)', 'a')}, {sq('avg(b)', 'b')} FROM f GROUP BY 1""")
def repeated_holdout(spark, sf):
    rows = _samples(spark, sf, "red_ir").select(*K, "row", "x", "y")
    return rounded(splits.repeated_holdout(rows, K, 4, 0.8, 5, start=(F.col("session_id") + F.col("rep") * 13) % 40), "a", "b")


# ---- robust, kernel and tree models -------------------------------------------------------------


@query("huber_fit")
def huber_fit(spark, sf):
    return rounded(models.fit_huber(_samples(spark, sf), [*K, "combo"]), "p0", "p1", "p2")


@query("ransac_fit")
def ransac_fit(spark, sf):
    return rounded(models.fit_ransac(_samples(spark, sf), [*K, "combo"]), "p0", "p1", "p2")


def sql_margin_line(src: str, by: str) -> str:
    """CTE ``line(by, a, b)`` of the linear support-vector fit of ``src(by, x, y)``: bisection of the derivative over the slope."""
    c, eps = f"{fits.SVR_C}e0", f"{fits.SVR_EPS}e0"
    return f"""std AS (SELECT {by}, avg(x) AS mx, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd, avg(y) AS my, count(*) AS n FROM {src} GROUP BY {by}),
edge AS (SELECT {by}, (x - mx) / sd AS z, y - my + u.e AS e FROM {src} JOIN std USING ({by}), unnest([{eps}, -{eps}]) AS u(e)),
half AS (
  SELECT {by}, -{c} * n - 1 AS lo, {c} * n + 1 AS hi, 0 AS k FROM std
  UNION ALL
  SELECT {by}, CASE WHEN g > 0 THEN lo ELSE mid END, CASE WHEN g > 0 THEN mid ELSE hi END, k + 1 FROM (
    SELECT {by}, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, any_value(k) AS k,
      any_value(mid) - {c} / 2 * (sum(CASE WHEN on_it THEN 0 ELSE sign(d) * z END) + greatest(-1, least(1, coalesce(-sum(CASE WHEN on_it THEN 0 ELSE sign(d) END) / nullif(count(*) FILTER (WHERE on_it), 0), 0))) * coalesce(sum(z) FILTER (WHERE on_it), 0)) AS g
    FROM (SELECT *, abs(d) <= 1e-12 * (1 + abs(m)) AS on_it FROM (SELECT *, r - m AS d FROM (SELECT *, median(r) OVER (PARTITION BY {by}) AS m FROM (
      SELECT h.*, z, e - mid * z AS r FROM (SELECT *, (lo + hi) / 2 AS mid FROM half WHERE k < 62) h JOIN edge USING ({by})))))
    GROUP BY {by})),
line AS (SELECT {by}, any_value(my) + median(e - (lo + hi) / 2 * z) - any_value((lo + hi) / 2 * mx / sd) AS a, -any_value((lo + hi) / 2 / sd) AS b FROM half JOIN std USING ({by}) JOIN edge USING ({by}) WHERE k = 62 GROUP BY {by})"""


@query("svr_line_fit", f"WITH RECURSIVE {SIG}, {SMP}, {sql_margin_line('smp', 'session_id, combo')} SELECT session_id, combo, {sq('a', 'a')}, {sq('b', 'b')}, true AS converged FROM line")
def svr_line_fit(spark, sf):
    return rounded(models.fit_svr_line(_samples(spark, sf), [*K, "combo"]), "a", "b")


for _name, _model in (("svr_rbf_cv", "svr_rbf"), ("gbr_cv", "gbr")):

    def _kernel(spark, sf, m=_model):
        return rounded(models.cross_validate(_samples(spark, sf), K, models=(m,)), "time_center", "y_true", "y_pred")

    query(_name)(_kernel)


@query("cv_all_models")
def cv_all_models(spark, sf):
    pred = models.cross_validate(_samples(spark, sf), K)
    return rounded(models.fold_metrics(pred, K, by_motion=False), *models.METRICS)


# ---- whole jobs -----------------------------------------------------------------------------------

JOB = calibration.Job(
    reference_rate=100.0, windows=Span(0.64, 0.48), saturation=Plausible(85.0, 100.0, 4.0), warmup=0.1, cancel=None, lag=0.1,
    pairing=Pairing(4, 0.0), movement=Movement(quantile=0.8), pulse=Band(0.5, 5.0, 2), baseline=Baseline(0.2, 0.1),
)


def _recordings(spark, sf):
    # Users share recordings here, so that each is long enough for windows and folds.
    sig = recording(spark, sf, "red", "ir", "green", "spo2", "accx", "accy", "accz").drop("sample_idx")
    sig = dense_index(sig.withColumn("session_id", F.col("session_id") % 3), K, "event_id").withColumn("time", F.col("sample_idx") / F.lit(50.0))
    # The reference runs at twice the rate, over half the time.
    ref = sig.select(*K, "sample_idx", (F.col("sample_idx") / F.lit(100.0)).alias("time"), "red", "ir", "spo2")
    proto = sig.select(*K, "sample_idx", "time", *[(F.col(c) + 500.0).alias(c) for c in ("red", "ir", "green")], "accx", "accy", "accz")
    return ref, proto


@query("merged_grid")
def merged_grid(spark, sf):
    out = calibration.merge_recordings(*_recordings(spark, sf), JOB)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query("merged_grid_anc")
def merged_grid_anc(spark, sf):
    out = calibration.merge_recordings(*_recordings(spark, sf), JOB.but(cancel=Canceller(4, 0.001)))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


# Every third session is cut to its first rows, every seventh has none.
@query("calibration_status", f"""WITH {SIG}, f AS (SELECT session_id, count(*) FILTER (WHERE session_id % 7 <> 1 AND (session_id % 3 <> 0 OR i < 6)) AS windows FROM sig GROUP BY 1)
SELECT session_id, windows, CASE WHEN windows = 0 THEN 'no windows' WHEN windows < 10 THEN 'too short' ELSE 'validated' END AS status FROM f""")
def calibration_status(spark, sf):
    every = _samples(spark, sf, "red_ir")
    rows = every.where("session_id % 7 <> 1 and (session_id % 3 <> 0 or row < 6)").drop("n")
    rows = join_stats(rows, rows.groupBy(*K).agg(F.count("*").alias("n")), K)
    pred = models.cross_validate(rows, K, models=models.CLOSED)
    return calibration.outcomes(every, rows, pred, calibration.Validation(models=models.CLOSED))


@query("calibration_run")
def calibration_run(spark, sf):
    merged = calibration.merge_recordings(*_recordings(spark, sf), JOB)
    feat = calibration.extract_features(merged, JOB.but(movement=Movement(quantile=0.8, drop=False)), PAIRS)
    _, _, summary = calibration.calibrate(feat, calibration.Validation(pairs=tuple(PAIRS)))
    return rounded(summary.select("session_id", "combo", "model", "RMSE_mean", "MAE_mean", "Bias_mean"), "RMSE_mean", "MAE_mean", "Bias_mean")


_LEGACY = {"b": filters.butterworth(5, 0.5, 5.0, 50.0), "l": filters.butterworth(5, None, 0.5, 50.0)}
_LEGACY_CTES = ", ".join(
    [f"in_{c} AS (SELECT session_id, i AS p, {c} AS x FROM sig)" for c in ("red", "ir", "green")]
    + [sql_cascade(f"in_{c}", "p", flt, f"{k}_{c}", None) for c in ("red", "ir", "green") for k, flt in _LEGACY.items()]
)
_LEGACY_RATIO = {c: f"stddev_pop(b_{c}.x) / nullif(avg(l_{c}.x), 0)" for c in ("red", "ir", "green")}


@query("legacy_ratios", f"""WITH RECURSIVE {SIG}, {_LEGACY_CTES}, {sql_windows(20, 5, 1)},
rel AS (SELECT win.session_id, k, {', '.join(f'{e} AS {c}' for c, e in _LEGACY_RATIO.items())} FROM win
  {' '.join(f'JOIN {k}_{c} ON {k}_{c}.session_id = win.session_id AND {k}_{c}.p = win.i' for c in ('red', 'ir', 'green') for k in 'bl')} GROUP BY 1, 2)
SELECT session_id, k AS window_id, {sq('red / nullif(ir, 0)', 'r_red_ir')}, {sq('green / nullif(ir, 0)', 'r_green_ir')} FROM rel""")
def legacy_ratios(spark, sf):
    sig = recording(spark, sf, "red", "ir", "green")
    out = dataset.legacy_ratios(sig.select(*K, "sample_idx", "red", "ir", "green"), K, [("red", "ir"), ("green", "ir")], 20, 5, 50.0)
    return rounded(out, "r_red_ir", "r_green_ir")


@query("dataset_errors")
def dataset_errors(spark, sf):
    sig = recording(spark, sf, "red", "ir", "spo2")
    clocks = sig.select(*K).distinct().select(*K, F.lit("10:00:00").alias("wave_clock"), F.lit("10:00:02.50").alias("spo2_clock"))
    pairs = dataset.paired_samples(sig, sig.select(*K, "sample_idx", "spo2"), clocks, 4, 8, 2)
    line = dataset.fit_dataset(pairs.where("session_id % 2 = 0"), 3)
    records = sig.select(*K).distinct().withColumn("patient_id", F.col("session_id") % 10)
    errors, _ = dataset.validate_dataset(pairs, line, records, records.where("patient_id % 2 = 0"))
    return rounded(errors, "error")
