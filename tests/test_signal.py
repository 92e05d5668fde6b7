import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import arrow, denoise
from pulsegrid.functions import kernels as k
from pulsegrid.operators import plotdata
from pulsegrid.operators import signal as sg


def beats(bpm=72, fs=500, seconds=10, wander=0.05):
    t = np.arange(fs * seconds)
    x = wander * np.sin(2 * np.pi * 0.3 * t / fs)
    for i in np.arange(0, fs * seconds, fs * 60 / bpm):
        x = x + np.exp(-0.5 * ((t - int(i)) / (0.01 * fs)) ** 2)
    return x


def direct(sos, x):
    """The recursion written out, section by section."""
    for b0, b1, b2, _, a1, a2 in sos:
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = b0 * x[i] + (b1 * x[i - 1] - a1 * y[i - 1] if i else 0) + (b2 * x[i - 2] - a2 * y[i - 2] if i > 1 else 0)
        x = y
    return x


@pytest.mark.parametrize(("kind", "order", "cut"), [("low", 4, (40.0,)), ("high", 2, (0.5,)), ("band", 4, (0.5, 40.0)), ("low", 1, (43.0,)), ("low", 3, (43.0,))])
def test_butterworth(kind, order, cut):
    sos = k.butterworth(kind, order, cut, 500.0)
    gain = lambda f: np.abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in sos for z in [np.exp(2j * np.pi * f / 500)]]))
    assert all(abs(gain(c) - 2**-0.5) < 1e-6 for c in cut)
    # far from its start, filtering from a steady state is the plain recursion
    x = np.concatenate([np.zeros(50), np.random.default_rng(0).normal(size=200)])
    assert np.allclose(k._run_sections(sos, x[:, None], x[:1])[:, 0], direct(sos, x))


def test_filters_and_spectra():
    t = np.arange(1000) / 500
    x = (np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 200 * t))[None]
    f, p = k.welch(k.lowpass(x, 500, 50.0), 500)
    assert p[0][np.argmin(abs(f - 200))] < 0.01 * p[0][np.argmin(abs(f - 10))]
    assert np.allclose(k.highpass(np.ones((1, 100)), 500, 0.5, 2), 0, atol=1e-9)
    assert np.abs(k.notch(np.sin(2 * np.pi * 50 * t)[None], 500)[0, 300:700]).max() < 0.05
    n = 64
    y = np.random.default_rng(1).normal(size=(2, n))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    d = (y - y.mean(1, keepdims=True)) * w
    ref = np.array([[abs(sum(r[i] * np.exp(-2j * np.pi * q * i / n) for i in range(n))) ** 2 for q in range(33)] for r in d]) / (500 * (w**2).sum())
    ref[:, 1:32] *= 2
    assert np.allclose(k.welch(y, 500)[1], ref)
    with pytest.raises(ValueError, match="more than 27 samples"):
        k.bandpass(np.ones((1, 27)), 500, 1, 40)
    with pytest.raises(ValueError, match="cut-off"):
        k.lowpass(x, 500, 250.0)


def test_resample():
    t = np.arange(500) / 500
    x = np.sin(2 * np.pi * 5 * t)[None]
    y = k.resample(x, 500, 250)
    assert y.shape == (1, 250) and np.allclose(y[0, 30:-30], x[0, ::2][30:-30], atol=0.01)
    assert k.resample(x, 500, 360).shape == (1, 360) and np.array_equal(k.resample(x, 500, 500), x)
    with pytest.raises(ValueError, match="positive"):
        k.resample(x, 500, 0)


@pytest.mark.parametrize("bpm", [60, 72])
def test_peaks(bpm):
    x = beats(bpm)
    expected = np.arange(0, 5000, 500 * 60 / bpm)
    p = k.peaks_pan_tompkins(x[None], 500)[0]
    assert abs(len(p) - len(expected)) <= 2 and all(min(abs(expected - q)) < 25 for q in p)
    assert abs(len(k.peaks_shannon(x[None], 500)[0]) - len(expected)) <= 3
    assert k.peaks_shannon(np.zeros((1, 5000)), 500)[0] == []


def test_adaptive_peaks_looks_back():
    e = np.zeros(4000)
    for at, h in ((200, 1.0), (700, 1.0), (1200, 1.0), (1700, 0.15), (2200, 1.0), (2700, 1.0)):
        e[at - 5 : at + 6] = h * np.hanning(11)
    assert 1700 in k.adaptive_peaks(e, 500)


def test_quality():
    rng = np.random.default_rng(123)
    good, bad = (k.quality_scores(v[None], 500)["sqi"][0] for v in (beats(wander=0), rng.normal(size=5000)))
    assert good > 0.4 and bad < 0.7 and good > bad
    assert k.quality_scores(np.ones((1, 500)), 500)["sqi"][0] < 0.5


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=5, max_size=12), st.lists(st.floats(0.1, 2), min_size=4, max_size=11))
def test_spline_is_exact_for_cubics(coefs, steps):
    xs = np.concatenate([[0], np.cumsum(steps)])
    poly = np.polynomial.Polynomial(coefs[:4])
    at = np.linspace(0, xs[-1], 17)
    assert np.allclose(k.cubic_spline(xs, poly(xs), at), poly(at), atol=1e-6 * (1 + np.abs(poly(at)).max()))


def test_hrv_frequency():
    assert set(k.hrv_frequency(np.array([800.0])).values()) == {0.0}
    r = k.hrv_frequency(800 + 50 * np.sin(np.arange(300) * 0.8 * 2 * np.pi * 0.1))
    assert r["lf_power"] > 10 * r["hf_power"] and r["total_power"] >= r["lf_power"]


RR = {"a": [800, 850, 780, 820, 900, 770, 830, 810], "b": [800], "c": [1000, 1000, 1000], "d": [800, 810], "e": []}


def test_hrv(spark):
    rows = [(key, i + 1, float(v)) for key, vs in RR.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "u string, beat_no int, rr_ms double")
    got = {r.u: r for r in sg.hrv_time_domain(df, "u").collect()}
    v = np.array(RR["a"], float)
    d = np.diff(v)
    assert abs(got["a"].sdnn - v.std(ddof=1)) < 1e-9 and abs(got["a"].rmssd - np.sqrt((d**2).mean())) < 1e-9 and abs(got["a"].sdsd - d.std(ddof=1)) < 1e-9
    assert got["a"].nn50_count == int((abs(d) > 50).sum()) and abs(got["a"].pnn20 - 100 * (abs(d) > 20).mean()) < 1e-9
    assert (got["b"].mean_rr, got["b"].sdnn, got["b"].hr_mean, got["b"].pnn50) == (800, 0, 75, 0) and got["c"].rmssd == 0 and np.isnan(got["d"].sdsd) and "e" not in got
    p = {r.u: r for r in sg.hrv_poincare(df, "u").collect()}
    assert abs(p["a"].sd1 - d.std(ddof=1) / 2**0.5) < 1e-9 and p["b"].sd1 == 0 and p["b"].sd1_sd2_ratio == 0 and p["d"].sd1_sd2_ratio == 0
    assert sg.heart_rate(df, "u").where("u = 'c'").first().heart_rate == 60


def lead_rows(spark, rows):
    return spark.createDataFrame(rows, "record_id string, lead_no int, label string, samples array<double>, sampling_rate int, resolution double, offset_value double, resolution_unit string, units string, is_raw boolean")


def test_scaling(spark):
    df = lead_rows(spark, [("r", 0, "I", [1.0, 2.0], 500, 2.5, 1.0, "uV", "", True), ("r", 1, "II", [1.0], 500, 1.0, 0.0, "mV", "mV", False), ("r", 2, "V1", None, 500, 1.0, 0.0, "", "", False)])
    p = {r.label: r for r in sg.to_physical(df).collect()}
    assert p["I"].samples == [3.5, 6.0] and p["I"].units == "uV" and not p["I"].is_raw and p["II"].samples == [1.0] and p["V1"].samples is None
    a = {r.label: r for r in sg.auto_scale(df, "uV").collect()}
    assert a["I"].samples == [3.5, 6.0] and a["II"].samples == [1000.0] and a["V1"].unscaled and not a["II"].unscaled
    with pytest.raises(ValueError, match="unknown target"):
        sg.convert_units(df, "kV")
    with pytest.raises(Exception, match="raw samples"):  # the third lead would fail for its unit
        sg.convert_units(df.where("is_raw"), "uV").collect()
    with pytest.raises(Exception, match="no voltage unit|raw samples"):
        sg.convert_units(df, "uV").collect()
    with pytest.raises(Exception, match="resolution is 0"):
        sg.to_physical(df.withColumn("resolution", F.lit(0.0))).collect()
    with pytest.raises(Exception, match="no voltage unit"):
        sg.convert_units(df.withColumns({"is_raw": F.lit(False), "units": F.lit("MV")}), "uV").collect()


def test_normalise(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0],), ([2.0, 2.0],), ([],), (None,)], "samples array<double>")
    m = [r[0] for r in df.select(sg.normalize_minmax(F.col("samples"))).collect()]
    assert m == [[-1, 0, 1], [0, 0], [], None]
    z = [r[0] for r in df.select(sg.normalize_zscore(F.col("samples"))).collect()]
    assert np.allclose(z[0], [-1.5**0.5, 0, 1.5**0.5]) and z[1:] == [[0, 0], [], None]
    a = [r[0] for r in df.select(sg.normalize_amplitude(F.col("samples"), 2.0)).collect()]
    assert np.allclose(a[0], [0.4, 1.2, 2]) and a[2:] == [[], None]


def test_leads_and_beats(spark):
    rows = [("r", 0, "i", [1.0, 2.0], 500), ("r", 1, "II", [3.0, 5.0], 500), ("r", 2, "V1", [9.0], 500), ("q", 0, "I", [1.0], 500)]
    df = spark.createDataFrame(rows, "record_id string, lead_no int, label string, samples array<double>, sampling_rate int")
    got = {r.label: r.samples for r in sg.derive_leads(df, sg.STANDARD_12).collect()}
    assert got == {"I": [1, 2], "II": [3, 5], "III": [2, 3], "aVR": [-2, -3.5], "aVL": [-0.5, -0.5], "aVF": [2.5, 4], "V1": [9]}
    with pytest.raises(Exception, match="differ in rate or length"):
        sg.derive_leads(df.withColumn("sampling_rate", F.when(F.col("label") == "II", 250).otherwise(500)), ["III"]).collect()
    s = spark.createDataFrame([("k", [float(i) for i in range(20)], 10, [1, 5, 10, 17]), ("n", [], 10, [])], "k string, samples array<double>, sampling_rate int, peaks array<int>")
    b = sg.segment_beats(s, "k")
    assert [(r.beat_no, r.samples[0]) for r in b.orderBy("beat_no").collect()] == [(1, 3), (2, 8)]
    r = sg.average_beat(b, "k").where("i = 0").first()
    assert (r["mean"], r.sd, r.n) == (5.5, 2.5, 2)
    assert [len(x) for x in s.select(sg.fixed_segments(F.col("samples"), 8)).first()[0]] == [8, 8, 8]
    assert s.select(sg.intervals_of_peaks(F.col("peaks"), F.col("sampling_rate"))).collect()[0][0] == [400, 500, 700]
    assert plotdata.sheet_12(df).where("record_id = 'r'").count() == 13 and plotdata.peak_markers(s, "k").count() == 4


def test_report(spark):
    fields = (
        "record_id string, patient struct<patient_id string, last_name string, first_name string, sex string, age int>, recording struct<date timestamp_ntz, device struct<manufacturer string, model string>, acquisition struct<signal struct<sampling_rate int>>>, "
        "measurements struct<heart_rate int, pr_interval int, qrs_duration int, qt_interval int, qtc_bazett int, qrs_axis int>, interpretation struct<severity string, source string, statements array<struct<left_text string, right_text string>>>"
    )
    full = ("r", ("P1", "Doe", "Jane", "F", 40), (dt.datetime(2024, 5, 1, 9, 5), ("Acme", ""), ((500,),)), (72, None, 88, None, None, -10), ("ABNORMAL", "", [("Sinus", "rate 70"), ("b", ""), ("c", ""), ("d", "")]))
    records = spark.createDataFrame([full, ("e", (None,) * 5, (None, (None, None), ((None,),)), (None,) * 6, (None, None, []))], fields)
    head = {r.record_id: r.header for r in plotdata.record_header(records).collect()}
    assert head["r"] == "Name: Jane Doe\nID: P1\nAge: 40  Sex: F\nDate: 2024-05-01 09:05\nSample rate: 500 Hz\nDevice: Acme\nHR: 72 bpm  |  QRS: 88 ms  |  Axis: -10°\nInterpretation: Sinus rate 70; b; c" and head["e"] == "ECG report"
    x = beats().tolist() * 2
    leads = spark.createDataFrame([("r", 0, "rhythm", "I", x, 500), ("r", 1, "rhythm", "II", x, 500), ("r", 2, "median", "II", [1.0], 500), ("other", 0, "rhythm", "I", x, 500)], "record_id string, lead_no int, kind string, label string, samples array<double>, sampling_rate int")
    rows = plotdata.report(records, leads).collect()
    parts = {(r.record_id, r.part, r.row, r.col): r for r in rows}
    assert len(rows) == len(parts) and {r.record_id for r in rows} == {"r", "e"} and sum(r.part == "grid" and r.record_id == "r" for r in rows) == 12
    assert len(parts["r", "grid", 2, 0].samples) == min(len(x), 5000) and len(parts["r", "rhythm", 4, 0].samples) == len(x) and parts["r", "rhythm", 4, 0].colour == "#ff7f0e"
    assert parts["r", "quality", 5, 0].text.split("\n")[1].startswith("   II: 0.") and parts["r", "interpretation", 5, 2].text.endswith("- c\n- d") and parts["e", "interpretation", 5, 2].text == "No interpretation available"
    axes = spark.range(1).select(plotdata.paper_steps(F.lit(10.0), "x").alias("x"), plotdata.paper_steps(F.lit(4000.0), "y").alias("y"), plotdata.sample_axis(F.array(F.lit(5.0), F.lit(6.0))).alias("a"), plotdata.lead_colour(F.lit("?")).alias("c")).first()
    assert tuple(axes.x) == (0.2, 0.04) and tuple(axes.y) == (500.0, 100.0) and axes.a == [1, 2] and axes.c == "#333333"
    rr = spark.createDataFrame([("k", k, float(800.0 + 40 * np.sin(2 * np.pi * 0.1 * 0.8 * k))) for k in range(300)], "k string, beat_no int, rr_ms double")
    power = {r.band: r.power for r in plotdata.hrv_bands(rr, "k").collect()}
    assert power["lf"] > 20 * max(power["vlf"], power["hf"])


def test_udfs(spark):
    x = beats().tolist()
    df = spark.createDataFrame([(1, x, 500), (2, None, 500), (3, [], 500), (4, x, None), (5, x, 500)], "id int, samples array<double>, fs int")
    got = {r.id: r.p for r in df.select("id", arrow.r_peaks(F.col("samples"), F.col("fs")).alias("p")).collect()}
    assert got[1] == got[5] and len(got[1]) >= 11 and got[2] is None and got[3] is None and got[4] is None
    q = {r.id: r.q for r in df.select("id", arrow.quality(F.col("samples"), F.col("fs")).alias("q")).collect()}
    assert q[1].sqi > 0.4 and q[2].sqi is None
    assert "ecg_r_peaks" in arrow.register(spark)
    df.createOrReplaceTempView("leads_v")
    assert spark.sql("SELECT size(ecg_r_peaks(samples, fs)) AS n FROM leads_v WHERE id = 1").first().n == len(got[1])
    with pytest.raises(ValueError, match="weights"):
        arrow.clean(F.col("samples"), F.col("fs"), "deepfade")
    with pytest.raises(ValueError, match="unknown"):
        arrow.r_peaks(F.col("samples"), F.col("fs"), "x")


def test_differences(spark):
    v = np.random.default_rng(2).integers(-50, 50, 40).cumsum()
    d2 = np.concatenate([v[:2], np.diff(v, 2)])
    df = spark.createDataFrame([("a", i, int(x)) for i, x in enumerate(d2)], "k string, i int, d long")
    assert [r.decoded for r in sg.second_difference(df, "k", "i", "d").orderBy("i").collect()] == v.tolist()


def test_leads_from_arrays(spark):
    assert sg.leads_from_arrays(spark, np.ones(3), 500).count() == 1 and sg.leads_from_arrays(spark, [[1, 2], [3, 4]], 500, ["I", "II"]).count() == 2
    assert sg.leads_from_arrays(spark, np.ones((2, 3, 4)), 500).select("record_id").distinct().count() == 2
    with pytest.raises(TypeError):
        sg.leads_from_arrays(spark, np.ones(3), None)


def test_bad_leads_give_null_and_a_reason(spark):
    df = spark.createDataFrame([(1, [1.0] * 5, 500), (2, [float(k % 7) for k in range(400)], 500), (3, [1.0] * 400, 60), (4, [], 500), (5, None, 500), (6, [1.0] * 99 + [float("nan")], 500)], "id int, samples array<double>, fs int")
    got = {r.id: r.o for r in df.select("id", arrow.outcome(lambda m, f: k.lowpass(m, f, 40.0))("samples", "fs").alias("o")).collect()}
    assert got[1].samples is None and "more than 15 samples" in got[1].error and got[3].samples is None and "cut-off" in got[3].error and "no samples" in got[4].error
    assert got[6].samples is None and "finite" in got[6].error
    assert len(got[2].samples) == 400 and got[2].error is None and got[5].samples is None
    assert [r.n for r in df.select("id", F.size(arrow.lowpass(F.col("samples"), F.col("fs"), 40.0)).alias("n")).orderBy("id").collect()][1] == 400
    # cleaners of absent libraries leave the lead as it is
    assert df.where("id = 2").select(arrow.clean(F.col("samples"), F.col("fs"), "combined").alias("c"), "samples").where("c = samples").count() == 1


def test_kernels_from_sql(spark):
    names = arrow.register(spark)
    spark.createDataFrame([([float(k % 9) for k in range(600)], 500, 20.0), ([float(k % 5) for k in range(600)], 500, 45.0)], "s array<double>, fs int, c double").createOrReplaceTempView("sql_leads")
    got = spark.sql("SELECT ecg_lowpass(s, fs, c) AS a, ecg_bandpass(s, fs, 5.0, 40.0, 2) AS b, ecg_resample(s, fs, 250) AS r, ecg_quality(s, fs).sqi AS q, ecg_notch(s, fs) AS n, ecg_power_spectrum(s, fs).psd AS p, s FROM sql_leads ORDER BY c").collect()
    for row, c in zip(got, (20.0, 45.0), strict=True):
        x = np.array([row.s])
        assert np.allclose(row.a, k.lowpass(x, 500, c)[0]) and np.allclose(row.b, k.bandpass(x, 500, 5.0, 40.0, 2)[0]) and len(row.r) == 300 and 0 <= row.q <= 1 and len(row.p) == 129
    assert len(names) == 16


def test_denoiser(tmp_path, spark):
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(2, 3, 20)), rng.normal(size=(4, 3, 3)), rng.normal(size=4)
    pad = np.pad(x, ((0, 0), (0, 0), (1, 1)))
    naive = np.array([[[(pad[i, :, t : t + 3] * w[o]).sum() + b[o] for t in range(0, 20, 2)] for o in range(4)] for i in range(2)])
    assert np.allclose(denoise.convolve(x, w, b, 2), naive)
    v = rng.normal(size=(3, 2, 3))
    full = np.zeros((2, 2, 20 * 5 + 3))
    for t in range(20):
        for q in range(3):
            full[:, :, t * 5 + q] += np.einsum("bi,io->bo", x[:, :, t], v[:, :, q])
    assert np.allclose(denoise.spread(x, v, b[:2], 5), full[:, :, 1:101] + b[:2, None])
    weights = {k.replace("_blocks.0.", "DenseBlock_0.").replace("_trunk.", "_dense_trunk."): a for k, a in denoise.random_weights().items()}
    np.savez(tmp_path / "w.npz", **{f"module.{k}": a for k, a in weights.items()})
    net = denoise.load(str(tmp_path / "w.npz"))
    leads = rng.normal(size=(1, 6000))
    out = denoise.denoised(leads, 500, net)
    assert out.shape == (1, 6000) and np.allclose(out[0, 5000:], net(np.pad(leads[:, 5000:], ((0, 0), (0, 4000))))[0][0, :1000])
    signal, baseline = net(leads[:, :5000])
    assert signal.shape == baseline.shape == (1, 5000) and np.allclose(signal[0], out[0, :5000])
    with pytest.raises(ValueError, match="lack"):
        denoise.Network({})


def test_smoothing_wider_than_the_signal():
    rng = np.random.default_rng(3)
    for n, sigma in ((5, 20.0), (12, 3.1), (40, 10.0), (1, 2.0)):
        x = rng.normal(size=n)
        radius = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        assert np.allclose(k.gaussian_smooth(x, sigma), np.convolve(np.pad(x, radius, "symmetric"), w / w.sum(), "valid"))
