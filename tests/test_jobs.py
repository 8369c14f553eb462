import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import PAIRS_MAIN
from pulsegrid.operators import filtering, models, smoothing
from pulsegrid.operators.filtering import Canceller
from pulsegrid.operators.motion import Movement
from pulsegrid.operators.windows import Span
from pulsegrid.plans import calibration, dataset
from pulsegrid.sources import readers, sinks, wfdb
from pulsegrid.streaming.live import score_stream

from . import reference_fits as ref

K = ["session_id"]


def synth(session, seconds, seed, delay=0.4):
    """Two recordings of one finger: SpO2 falls, R follows SpO2 = 110 - 25 R."""
    g = np.random.default_rng(seed)
    tr = np.arange(int(seconds * 100)) / 100
    tp = np.arange(int(seconds * 50)) / 50
    level = lambda t: 96.5 + 2 * np.sin(2 * np.pi * t / 70 + seed)
    beat = lambda t: np.sin(2 * np.pi * 1.2 * t) + 0.5 * np.sin(2 * np.pi * 0.9 * t * (1 + 0.002 * t))
    ratio = lambda t: (110 - level(t)) / 25
    ref = pd.DataFrame({"session_id": session, "sample_idx": np.arange(len(tr)), "time": tr,
                        "red": 5e4 + 500 * ratio(tr) * beat(tr), "ir": 6e4 + 600 * beat(tr), "spo2": level(tr) + 0.02 * g.normal(size=len(tr))})
    t = tp - delay
    proto = {"session_id": session, "sample_idx": np.arange(len(tp)), "time": 1.7e12 + tp * 1000}
    for c, dc, f in (("red", 4e4, ratio(t)), ("ir", 5e4, 1.0), ("green", 3e4, 0.6 + 0.4 * ratio(t)), ("blue", 2e4, 1.4 - 0.3 * ratio(t))):
        proto[c] = dc * (1 + 0.01 * f * beat(t)) + g.normal(size=len(t))
    proto["red"][[200, 1500]] += 8000
    for i, c in enumerate(("accx", "accy", "accz")):
        proto[c] = 100.0 * (i + 1) + g.normal(size=len(t))
    return ref, pd.DataFrame(proto)


@pytest.fixture(scope="module")
def recordings(spark):
    parts = [synth("s5", 150, 1), synth("s6", 130, 2, -0.3)]
    ref, proto = (spark.createDataFrame(pd.concat(x)).repartition(4) for x in zip(*parts))
    holes = F.when(F.col("sample_idx") % 997 != 5, F.col("ir"))
    return ref, proto.withColumn("ir", holes).withColumn("time", F.col("time") / 1000)


CFG = calibration.Job(warmup=10.0, windows=Span(5.0, 4.0), cancel=None, movement=Movement(quantile=0.95))


def test_merge_and_calibrate(spark, recordings, tmp_path):
    ref, proto = recordings
    model = calibration.Validation(pairs=PAIRS_MAIN[:4], models=("linear", "quadratic", "huber", "elasticnet"))
    only = lambda d, s: d.where(F.col("session_id") == s)
    feat, summary, trained = calibration.run(only(ref, "s5"), only(proto, "s5"), CFG, model, str(tmp_path / "out"), size=3000)
    merged = spark.read.parquet(str(tmp_path / "out/merged_signals")).toPandas()
    assert len(merged) > 50 * 130 and merged.sample_idx.max() == len(merged) - 1
    # the delay was found: reference and prototype pulses run together
    assert np.corrcoef(merged.ref_red, merged.red)[0, 1] > 0.98
    assert merged.high_motion.mean() < 0.06 and merged.red_raw.max() < 4.3e4
    assert feat.count() > 100
    assert summary.count() == 4 * 4 and trained.combo in {f"{a}_{b}" for a, b in PAIRS_MAIN[:4]}
    line = models.train(models.samples(feat, K), "red_ir", "linear", 0.0)
    # prototype R is 0.01 r / 0.01, so the drawn line comes back
    assert abs(line.params[0] - 110) < 0.8 and abs(line.params[1] + 25) < 1.5
    again = sinks.load_model(spark, str(tmp_path / "out/trained_model"))
    assert again == trained
    pred, metrics = calibration.apply_to_subject(line, only(ref, "s6"), only(proto, "s6"), CFG, model, str(tmp_path / "out"), "s6", size=3000)
    row = metrics.first()
    assert row.RMSE < 0.3 and row.R2 > 0.9 and pred.count() > 80
    for name in ("bland_altman", "error_summary"):
        assert spark.read.parquet(str(tmp_path / f"out/subject=s6/{name}")).count() > 0
    wide = spark.read.option("header", True).csv(str(tmp_path / "out/window_features_export"))
    assert {"R_red_ir", "AC_green", "sqi_blue"} <= set(wide.columns)


def test_two_sessions_and_noise_cancelling(recordings):
    ref, proto = recordings
    cfg = CFG.but(cancel=Canceller(8, 0.0005))
    both = calibration.merge_recordings(ref, proto, cfg, size=4000)
    counts = {r.session_id: r["count"] for r in both.groupBy("session_id").count().collect()}
    assert counts["s5"] > 50 * 130 and counts["s6"] > 50 * 110


def test_every_session_has_an_outcome(recordings):
    ref, proto = recordings
    plan = calibration.Validation(pairs=PAIRS_MAIN[:1], models=("linear",))
    merged = calibration.merge_recordings(ref, proto, CFG)
    feat = calibration.extract_features(merged, CFG, PAIRS_MAIN[:1])
    few = feat.where("session_id = 's5' or window_id < 7")
    pred, _, _ = calibration.calibrate(few, plan)
    got = {r.session_id: r.status for r in calibration.outcomes(ref.unionByName(ref.withColumn("session_id", F.lit("lost"))), few, pred, plan).collect()}
    assert got == {"s5": "validated", "s6": "too short", "lost": "no windows"}
    with pytest.raises(RuntimeError):
        calibration.train_best(few, models.cv_summary(models.fold_metrics(pred.limit(0), K), K))


def test_condition_equals_its_parts(spark, recordings):
    _, proto = recordings
    df = proto.select("session_id", "sample_idx", F.col("red").alias("red_raw"), "accx")
    got = filtering.condition(df, K, ["red"], 50.0, 0.5, 5.0, 4, 2.0, 0.6, ("accx", 0.5, 10.0), size=2500)
    dc = smoothing.rolling_dc(df, K, {"red_raw": "dc"}, 50.0, 2.0, size=2500)
    flat = smoothing.remove_wander(df, K, {"red_raw": "flat"}, 50.0, 0.6, size=2500)
    ac = filtering.zero_phase(flat, K, {"flat": "ac"}, 50.0, 0.5, 5.0, 4, size=2500)
    both = got.join(dc.select(*K, "sample_idx", "dc"), [*K, "sample_idx"]).join(ac.select(*K, "sample_idx", "ac"), [*K, "sample_idx"]).toPandas()
    assert len(both) == df.count()
    assert np.allclose(both.red_rolling_dc, both.dc, atol=1e-6) and np.allclose(both.red, both.ac, atol=1e-5)


def test_text_readers(spark, tmp_path):
    for s, ms in (("subject5", 1767225600123), ("subject6", 1767225700000)):
        d = tmp_path / s
        d.mkdir()
        rows = [f"{ms + 20 * i}\t{100 + i}\t{5 + i}\t{7 if i != 3 else 'x'}\t{i * 0.5}" for i in range(50)]
        (d / f"{ms}.txt").write_text("timestamp\tIR\tRed\tGreen\tACCx\n" + "\n".join(rows) + "\n")
        head = json.dumps({"84:2E": {"date": "2026-01-01", "time": "00:00:10.500", "rate": 100}})
        body = "\n".join(f"{i} 0 {i * 2} {i * 3} {95 + i % 3}" for i in range(40))
        (d / "ref.mat").write_text(f"# OpenFile\n# {head}\n# EndOfHeader\n{body}\n")
    mapping = {"timestamp": "timestamp", "ir": "IR", "red": "Red", "green": "Green", "accx": "ACCx", "accy": "ACCy"}
    got = readers.read_prototype(spark, str(tmp_path / "*/*.txt"), mapping, fmt="txt").toPandas().sort_values(["session_id", "sample_idx"])
    assert len(got) == 100 and list(got.columns) == ["session_id", "sample_idx", "time", "red", "ir", "green", "accx"]
    one = got[got.session_id == "subject5"]
    assert np.allclose(one.time, np.arange(50) * 0.02) and np.isnan(one.green.iloc[3]) and one.ir.iloc[49] == 149
    with pytest.raises(KeyError):
        readers.read_prototype(spark, str(tmp_path / "*/*.txt"), {"blue": "Blue"}, fmt="txt")
    m = readers.reference_from_matrix(readers.read_matrix(spark, str(tmp_path / "*/*.mat"))).toPandas().sort_values(["session_id", "sample_idx"])
    assert len(m) == 80 and m.spo2.iloc[1] == 96 and m.red.iloc[39] == 117 and m.ir.iloc[39] == 78 and np.isclose(m.time.iloc[39], 0.39)
    h = readers.read_headers(spark, str(tmp_path / "*/*.mat")).collect()
    assert {(r.device, str(r.started)) for r in h} == {("84:2E", "2026-01-01 00:00:10.500000")} and len(h) == 2
    files = readers.list_files(spark, str(tmp_path)).orderBy("session_id", "role").collect()
    assert [(r.session_id, r.role, os.path.basename(r.path)[-3:]) for r in files][:2] == [("subject5", 0, "txt"), ("subject5", 1, "mat")]
    assert readers.infer_format("a/b.H5") == "h5" and readers.infer_format("x.dat") == "dat"
    with pytest.raises(ValueError):
        readers.infer_format("x.dat", strict=True)
    with pytest.raises(ValueError):
        readers.read_reference(spark, "x.csv", {})


def write_record(folder, name, red, ir, clock, names=("Red Signal", "IR Signal")):
    raw = np.stack([ir, red], axis=1).astype("<i2")
    raw.tofile(folder / f"{name}_ppg.dat")
    (folder / f"{name}_ppg.hea").write_text(
        f"{name}_ppg 2 86 {len(red)} {clock}\n{name}_ppg.dat 16 2(10)/mV 16 0 0 0 0 {names[1]}\n{name}_ppg.dat 16 4/mV 16 0 0 0 0 {names[0]}\n"
    )


def test_waveform_dataset(spark, tmp_path):
    g = np.random.default_rng(3)
    truth = {}
    for k, name in enumerate(("e1", "e2", "e3")):
        n = 86 * 60
        t = np.arange(n) / 86
        spo2 = 97 - 5 * np.abs(np.sin(t / 20 + k))
        r = (110 - spo2) / 25
        beat = np.sin(2 * np.pi * 1.3 * t)
        red, ir = 8000 * (1 + 0.03 * r * beat), 6000 * (1 + 0.03 * beat)
        write_record(tmp_path, name, red, ir, f"10:00:0{k}", ("RED", "IR") if k == 1 else ("Red Signal", "IR Signal"))
        truth[name] = spo2
        stamps = pd.date_range("2026-01-01 10:00:05.50", periods=110, freq="500ms").strftime("%Y-%m-%d %H:%M:%S.%f").str[:-4] + "Z"
        at = np.clip(((5.5 - k + np.arange(110) / 2) * 86).astype(int), 0, n - 1)
        # the trailing ten-second window sees the mean of its span
        mean = np.array([spo2[max(0, i - 860) : i].mean() if i else spo2[0] for i in at])
        pd.DataFrame({"Timestamp": stamps, "ScalcO2": mean + 0.05 * g.normal(size=110)}).to_csv(tmp_path / f"{name}_2hz.csv", index=False)
    waves = wfdb.read_waves(spark, str(tmp_path / "*_ppg.hea"))
    pdf = waves.toPandas()
    assert len(pdf) == 3 * 86 * 60 and pdf.red.notna().all()
    e2 = pdf[pdf.session_id == "e2_ppg"].sort_values("sample_idx")
    assert abs(e2.red.mean() - 2000) < 2 and abs(e2.ir.mean() - (6000 - 10) / 2) < 2
    files = readers.list_files(spark, str(tmp_path))
    assert readers.with_sidecar(files, files).count() == 3
    waves = waves.withColumn("session_id", F.regexp_replace("session_id", "_ppg$", ""))
    spo2, stamps = readers.read_side_table(spark, str(tmp_path / "*_2hz.csv"))
    assert {r.clock for r in stamps.collect()} == {"10:00:05.50"}
    clocks = stamps.withColumnRenamed("clock", "spo2_clock").join(
        waves.where("sample_idx = 0").select("session_id", F.col("clock").alias("wave_clock")), "session_id"
    )
    pairs = dataset.paired_samples(waves, spo2, clocks, size=1500)
    assert pairs.groupBy("session_id").count().count() == 3
    table = spark.createDataFrame([(e, p, *[1.0 if i == 4 else None for i in range(13)]) for e, p in (("e1", "p1"), ("e2", "p2"), ("e3", "p1"))],
                                  ", ".join(["encounter_id string", "patient_id string"] + [f"{d} double" for d in dataset.DEVICES]))
    rec = dataset.encounters(waves.select("session_id").distinct(), table)
    assert {(r.session_id, r.patient_id, r.site) for r in rec.collect()} == {("e1", "p1", "fingers"), ("e2", "p2", "fingers"), ("e3", "p1", "fingers")}
    line = dataset.fit_dataset(pairs.where("session_id = 'e1'"), block=1)
    r, mine = line.first(), pairs.where("session_id = 'e1'").toPandas()
    a, slope = ref.svr_line(mine.r.to_numpy(), mine.spo2.to_numpy())
    assert np.isclose(r.a, a, atol=1e-6) and np.isclose(r.b, -slope, atol=1e-6)
    # the fit prefers the flattest line inside its half-percent margin
    assert 15 < r.b < 26 and (mine.spo2 - r.a + r.b * mine.r).abs().max() < 1
    errors, hist = dataset.validate_dataset(pairs, line, rec, rec.where("session_id = 'e1'"))
    e = errors.toPandas()
    assert set(e.session_id) == {"e2"} and e.error.std() < 1.0
    h = hist.toPandas()
    assert h["count"].sum() == len(e) and h.bin.between(0, 29).all() and np.allclose(h.spread, e.error.std(ddof=0))


def test_stream_scoring(spark, tmp_path):
    rows = spark.createDataFrame([("a", float(i), "red_ir" if i % 2 else "ir_red", 0.5 + i / 10) for i in range(10)], "session_id string, time_center double, combo string, x double")
    rows.write.parquet(str(tmp_path / "in"))
    trained = models.TrainedModel("red_ir", "linear", (110.0, -25.0, 0.0), 1.0, 1.0)
    stream = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), trained)
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.time_center, round(r.spo2_estimated, 6)) for r in spark.sql("select * from scored").collect())
    assert got == [(float(i), round(110 - 25 * (0.5 + i / 10), 6)) for i in range(1, 10, 2)]


def test_legacy_ratios(recordings):
    _, proto = recordings
    out = dataset.legacy_ratios(proto.na.drop(subset=["ir"]).select(*K, "sample_idx", "red", "green"), K, [("red", "green"), ("green", "red")], 500, 50, 50.0).toPandas()
    assert np.allclose(out.r_red_green * out.r_green_red, 1)
