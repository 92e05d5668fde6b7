import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import faults, nested, timestamps, units

SITES = "site_id string, tz string, date_order string, measure_system string, town string"


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([("B", "Europe/Berlin", "DMY", "metric", "x"), ("N", "America/New_York", "MDY", "imperial", "y"), ("W", "Europe/Warsaw", "YMD", "metric", "z")], SITES)


def values(spark, rows):
    at = dt.datetime(2024, 6, 1)
    return spark.createDataFrame([(f"r{i}", site, "d", field, raw, rec, at, "extra") for i, (site, field, raw, rec) in enumerate(rows)], "record_id string, site_id string, serial string, field_name string, raw string, rec_raw string, ingested_at timestamp, layout string")


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())


CASES = [
    ("B", "date", "2021-03-28 01:30:00", utc(2021, 3, 28, 0, 30)),
    ("B", "date", "2021-03-28 02:30:00", utc(2021, 3, 28, 1, 30)),  # skipped: the offset before the change
    ("B", "date", "2021-10-31 02:30:00", utc(2021, 10, 31, 0, 30)),  # twice: the first
    ("N", "date", "03/04/2021 1:02:03 PM", utc(2021, 3, 4, 18, 2, 3)),
    ("B", "date", "03/04/2021 12:05 a.m.", utc(2021, 4, 2, 22, 5)),
    ("W", "birth_date", "13/04/07", utc(2013, 4, 7)),
    ("B", "birth_date", "05/01/25", utc(1925, 1, 5)),  # 2025 is after the recording
    ("B", "birth_date", "11-AUG-08", utc(2008, 8, 11)),
    ("B", "birth_date", "2013-09-19T00:00:00+14:00", utc(2013, 9, 19)),
    ("B", "birth_date", "7. März 1998", utc(1998, 3, 7)),
    ("B", "date", "1657915520", 1657915520),
    ("B", "date", "1657915520999", 1657915520),
    ("B", "date", "20240824101200-0330", utc(2024, 8, 24, 13, 42)),
    ("B", "date", "2019-01-01 00:00:00 MSK", utc(2018, 12, 31, 21)),
    ("B", "date", "Tue, 19 Feb 2019 18:36:22 +0100", utc(2019, 2, 19, 17, 36, 22)),
    ("B", "date", "2025-10-31T00:35:23-05:00[America/Bogota]", utc(2025, 10, 31, 5, 35, 23)),
    ("B", "date", "2025-01-31T00:35:23[America/Bogota]", utc(2025, 1, 31, 5, 35, 23)),
    ("B", "date", "26 de diciembre de 2019, 12:07", utc(2019, 12, 26, 11, 7)),
    ("B", "date", "17 mai 2024 05h23", utc(2024, 5, 17, 3, 23)),
    ("B", "date", "November 30, 2019, 12:49", utc(2019, 11, 30, 11, 49)),
    ("B", "date", "2020-08-18T05:51:44,937610Z", utc(2020, 8, 18, 5, 51, 44)),
    ("B", "date", "2021-02-30 08:15:00", None), ("B", "date", "yesterday", None), ("B", "date", "2022-13-40T99:00:00Z", None), ("B", "date", "0000-00-00", None), ("B", "date", "2021-02-03 24:00:00", None),
    ("B", "date", "2021-02-03 10:00 XYZ", None), ("X", "date", "2021-02-03 10:00", None), ("B", "date", "2021-02-03 10:00[No/Where]", None), ("B", "date", "1" * 4000, None),
]


def test_timestamps(spark, sites):
    rows = [(s, f, raw, "2024-05-01 10:00:00") for s, f, raw, _ in CASES]
    got = {r.record_id: r.epoch_s for r in timestamps.normalise(values(spark, [*rows, ("B", "date", "", None), ("B", "date", None, None)]), sites).collect()}
    bad = [(c[2], got[f"r{i}"], c[3]) for i, c in enumerate(CASES) if got[f"r{i}"] != c[3]]
    assert not bad and len(got) == len(CASES)


def test_mixture_learns_an_unknown_site():
    import pandas as pd

    # most values of this source can only be month first, so the doubtful ones are read so
    g = pd.DataFrame({"site_id": "q", "serial": "s", "question": "sep_y4", "mask": [3, 2, 1], "stated": None, "n": [40, 60, 1]})
    out = timestamps.mixture_posteriors(g).set_index("mask")
    assert out.loc[3, "reading"] == "MDY" and out.loc[1, "reading"] == "DMY" and out.loc[3, "posterior"] > timestamps.SURE
    assert timestamps.mixture_posteriors(g.iloc[:1]).posterior[0] < timestamps.SURE
    # a stated order decides where values are silent, and is outvoted by many that contradict it
    few = timestamps.mixture_posteriors(g.iloc[:1].assign(stated="DMY"))
    assert few.reading[0] == "DMY" and few.posterior[0] > timestamps.SURE
    many = timestamps.mixture_posteriors(g.assign(stated="DMY", n=[10, 1000, 0])).set_index("mask")
    assert many.loc[3, "reading"] == "MDY" and many.loc[3, "posterior"] > timestamps.SURE
    zone = pd.DataFrame({"site_id": "q", "serial": "s", "question": "cst", "mask": [3], "stated": "480,480", "n": [4]})
    assert timestamps.mixture_posteriors(zone).reading[0] == "480" and timestamps.mixture_posteriors(zone.assign(stated="60,120")).reading[0] == "-360"


def test_readings_mark_ambiguity(spark):
    sites = spark.createDataFrame([("C", "Asia/Shanghai", "DMY", "metric", "x"), ("I", "Asia/Jerusalem", "DMY", "metric", "x"), ("B", "America/Bogota", None, "metric", "x")], SITES)
    rows = [("C", "date", "2021-06-01 12:00 CST", None), ("I", "date", "2021-01-01 12:00 IST", None), ("B", "date", "2021-01-01 12:00 IST", None), ("B", "date", "03/04/2021 10:00", None), ("C", "date", "03/04/2021 10:00", None)]
    got = {r.record_id: r for r in timestamps.normalise(values(spark, rows), sites).collect()}
    assert [got[f"r{k}"].epoch_s for k in range(3)] == [utc(2021, 6, 1, 4), utc(2021, 1, 1, 10), utc(2021, 1, 1, 6, 30)]
    assert [got[f"r{k}"].ambiguous for k in range(5)] == [False, False, True, True, False]


def records(spark, rows):
    schema = (
        "record_id string, site_id string, patient struct<patient_id string, first_name string, last_name string, birth_date string, sex string, race string, weight string, height string, clinical_history string>, "
        "recording struct<date string, device struct<serial_number string, institution string>>, interpretation struct<interpretation_date string, interpreter string>, ingested_at timestamp, text string, n int"
    )
    return spark.createDataFrame(rows, schema)


def record(i, site="B", weight=None, height=None, pid="p", date=None, **p):
    person = (pid, p.get("first"), p.get("last"), p.get("birth"), p.get("sex"), p.get("race"), weight, height, p.get("history"))
    return (f"r{i}", site, person, (date, ("dev", p.get("institution"))), (None, p.get("interpreter")), dt.datetime(2024, 1, 1), "clash", 1)


LEADS = (
    "record_id string, lead_no int, label string, kind string, samples array<double>, sampling_rate int, resolution double, resolution_unit string, offset_value double, units string, is_raw boolean, "
    "adc_resolution double, adc_resolution_unit string, annotations map<string,string>, serial_number string, x string"
)


def lead(i, samples=(1.0, 2.0), unit="", res=1.0, units="", raw=True, adc=0.0, adc_unit="", notes=None, rate=500, device="d"):
    return (f"r{i}", 0, "I", "rhythm", [None if v is None else float(v) for v in samples] if samples is not None else None, rate, res, unit, 0.0, units, raw, adc, adc_unit, notes, device, "clash")


def test_units(spark, sites):
    texts = [("80", "N", 36287), ("80", "B", 80000), ("10st 3lb", "B", 64864), ("67,6kg", "B", 67600), ("153#", "B", 69400), ("86400 g", "N", 86400), ("heavy", "B", None), ("", "B", None), (None, "B", None), ("80", None, None), ("80 blips", "B", None)]
    rows = [record(i, s, weight=w) for i, (w, s, _) in enumerate(texts)]
    tall = [("5' 11", 1803), ("1,79 m", 1790), ('71"', 1803), ("174.0 cm", 1740), ("1740 mm", 1740), ("6′4″", 1930), ("5ft 10", 1778), ("63 in", 1600)]
    rows += [record(100 + i, "B", height=h) for i, (h, _) in enumerate(tall)]
    leads = [lead(0, unit="uV", res=2.5), lead(1, unit="counts/mV", res=400.0), lead(2, unit="", adc=5000.0, adc_unit="nV/count"), lead(3, units="MV", raw=False), lead(4, unit="arb"), lead(5, raw=False, notes={"note": "values: millivolt"}), lead(6, unit="micro-volt per LSB", res=0.5), lead(7, None, unit="nV", res=39000.0), lead(8, unit="volt", res=1.22e-6), lead(9, units=None, raw=None, unit=None)]
    r, d = records(spark, rows), spark.createDataFrame(leads, LEADS)
    out = units.common_units(r.union(r), d.union(d), sites).collect()
    assert len(out) == len(set(out))
    got = {(x.record_id, x.quantity): x.amount for x in out}
    assert [got.get((f"r{i}", "weight")) for i in range(len(texts))] == [t[2] for t in texts]
    assert [got.get((f"r{100 + i}", "height")) for i in range(len(tall))] == [t[1] for t in tall]
    assert [got.get((f"r{i}", "sample_step")) for i in range(10)] == [2500, 2500, 5000, 1_000_000, None, 1_000_000, 500, 39000, 1220, None]
    empty = units.common_units(r.limit(0), d.limit(0), sites)
    assert empty.count() == 0 and empty.columns == ["record_id", "lead_no", "quantity", "amount"]


def test_units_named_in_notes(spark, sites):
    notes = [("weight in pounds", 45359, 800), ("Scale set to LBS; ht unit: in", 45359, 2032), ("kg scale", 100000, 800), ("height in inches", 100000, 2032), ("seen in clinic", 100000, 800), (None, 100000, 800)]
    rows = [(f"r{k}", "B", ("p", "100", "80"), {"remark": n} if n else None) for k, (n, _, _) in enumerate(notes)] + [("x", "B", ("p", "100 g", "80 mm"), {"remark": "weight in pounds"})]
    df = spark.createDataFrame(rows, "record_id string, site_id string, patient struct<patient_id string, weight string, height string>, annotations map<string,string>")
    got = {(r.record_id, r.quantity): r.amount for r in units.common_units(df, spark.createDataFrame([], LEADS), sites).collect()}
    assert [(got[f"r{k}", "weight"], got[f"r{k}", "height"]) for k in range(6)] == [n[1:] for n in notes]
    assert (got["x", "weight"], got["x", "height"]) == (100, 80)


def test_units_learn_an_unknown_word(spark):
    # every entity has a weight in kg and one in a word nobody declared, which must turn out to be pounds
    rows = [("weight", f"e{i}", w, x) for i in range(30) for w, x in (("kg", 50.0 + i), ("bushes", (50.0 + i) / 0.45359237 * (1 + 0.01 * (i % 3 - 1))))]
    got = {r.notation: r.scale for r in units.notation_scales(spark.createDataFrame(rows, "quantity string, entity string, notation string, x double")).collect()}
    assert got == {"kg": 1000.0, "bushes": 453.59237}


def test_units_refuse_a_scale_with_an_offset(spark):
    # a word that runs with kilograms but from another zero is no unit of weight, however many entities link it
    rows = [("weight", f"e{i}", w, x) for i in range(400) for w, x in (("kg", 40.0 + i / 4), ("grades", (40.0 + i / 4) * 0.9 + 130), ("stones", (40.0 + i / 4) / 6.35029318))]
    df = spark.createDataFrame(rows, "quantity string, entity string, notation string, x double")
    links = {(r.a, r.b): r.offset for r in units.pairwise_links(units.representatives(df)).collect()}
    assert abs(links["kg", "stones"]) < 0.05 and abs(links["grades", "kg"]) > 0.5
    got = {r.notation: r.scale for r in units.notation_scales(df).collect()}
    assert got["kg"] == 1000.0 and got["stones"] == 6350.29318 and got["grades"] is None


PAYLOADS = {
    "a": ({"leads": [{"annotations": {"x": "1", "y": None}}, 5, {"annotations": [{"name": "n", "value": ""}, {"value": 1}]}], "measurements": {"hr": 60, "pr": None}, "annotations": [{"name": "q", "value": "1"}], "raw_metadata": {"a": [1, {"b": ""}], "c": {}, "d": [], "e": None}}),
    "b": ({"leads": {"annotations": None}, "raw_metadata": json.dumps({"k\"\\/": {"é": [[True]]}})}),
    "c": ({"leads": None, "annotations": [], "raw_metadata": "no json"}),
}
EXPECTED = {
    ("a", "lead", "", "0"), ("a", "lead", "", "1"), ("a", "lead", "", "2"), ("a", "lead_annotation", "0", "x"), ("a", "lead_annotation", "0", "y"), ("a", "lead_annotation", "2", "n"), ("a", "measurement", "", "hr"),
    ("a", "annotation", "", "q"), ("a", "metadata", "a", "a/0"), ("a", "metadata", "a/1", "a/1/b"), ("a", "metadata", "", "e"), ("b", "lead", "", "0"), ("b", "metadata", 'k"\\//é/0', 'k"\\//é/0/0'),
}


def test_nested(spark):
    rows = [(k, json.dumps(v)) for k, v in PAYLOADS.items()] * 2 + [("d", json.dumps(PAYLOADS["a"])[:-9]), ("e", None), ("f", ""), ("g", "[1]"), ("h", '{"leads": [1,]}')]
    df = spark.createDataFrame([(r, p, "c") for r, p in rows], "record_id string, payload string, child string")
    got = [tuple(r) for r in nested.flatten_payloads(df).collect()]
    assert set(got) == EXPECTED and len(got) == len(EXPECTED)
    assert nested.flatten_payloads(df.limit(0)).count() == 0


def _plain(index, t=None):
    t = index.items(-1)[0] if t is None else t
    if index.is_object(t):
        return {k: _plain(index, v) for k, v in index.members(t).items()}
    return [_plain(index, v) for v in index.items(t)] if index.is_array(t) else json.loads(index.text(t), strict=False)


def test_related_tables(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in PAYLOADS.items()], "record_id string, payload string")
    got = {n: {tuple(r) for r in t.collect()} for n, t in nested.related_tables(df).items()}
    assert got["measurement"] == {("a", "hr", "60")} and got["annotation"] == {("a", "q", "1")} and got["lead_annotation"] == {("a", 0, "x", "1"), ("a", 0, "y", None), ("a", 2, "n", "")}
    assert got["metadata"] == {("a", "a", "a/0", "1"), ("a", "a/1", "a/1/b", ""), ("a", "", "e", None), ("b", 'k"\\//é/0', 'k"\\//é/0/0', "true")}
    assert {(r, n, json.dumps(json.loads(b))) for r, n, b in got["lead"]} == {("a", k, json.dumps(x)) for k, x in enumerate(PAYLOADS["a"]["leads"])} | {("b", 0, json.dumps(PAYLOADS["b"]["leads"]))}


def test_structural_index_against_the_standard_parser():
    rng = np.random.default_rng(5)

    def make(depth):
        kind = rng.integers(0, 7 if depth < 5 else 5)
        if kind == 5:
            return [make(depth + 1) for _ in range(rng.integers(0, 4))]
        if kind == 6:
            return {f"k{j}\"\\": make(depth + 1) for j in range(rng.integers(0, 4))}
        return [None, True, -1.5e3, 'a"\\\\"{[:,é', ""][kind]

    for _ in range(300):
        text = json.dumps(make(0), ensure_ascii=bool(rng.integers(0, 2)), indent=[None, 1][rng.integers(0, 2)])
        assert _plain(nested.Index(text.encode())) == json.loads(text)
        cut = text[: rng.integers(0, len(text) + 1)]
        for t in (cut, text + "]", text.replace(",", ";", 1), text.replace('"', "", 1)):
            try:
                expected = json.loads(t)
            except ValueError:
                with pytest.raises(ValueError):  # noqa: PT011
                    nested.Index(t.encode())
            else:
                assert _plain(nested.Index(t.encode())) == expected
    deep = "[" * 20_000 + "]" * 20_000
    assert nested.children('{"raw_metadata":' + deep + "}") == []


def test_faults(spark):
    rng = np.random.default_rng(3)
    t = np.arange(128)
    wave = lambda: 0.8 * np.exp(-0.5 * ((t - rng.integers(20, 100)) / 4.0) ** 2) + rng.normal(size=128) * 0.01
    rows, expected = [], set()

    def add(i, x, fault=None, **more):
        rows.append(lead(i, x, units="mV", raw=False, unit="mV", **more))
        if fault:
            expected.add((f"r{i}", 0, fault))

    for i in range(80):
        add(i, wave())
    for i in range(80, 84):
        x = wave()
        x[50:53] += 6
        add(i, x, "spike")
    x = wave()
    x[30:100] = 0.2
    add(90, x, "stuck")
    add(91, np.append(wave(), np.nan), "impossible")
    add(92, wave() + np.where(t == 9, 990.0, 0), "impossible")
    add(93, wave(), "rate", rate=5)
    add(94, None)
    add(95, [])
    add(96, [1.0])
    add(97, np.append(wave()[:5], [float("inf")]), "impossible")
    df = spark.createDataFrame(rows, LEADS)
    got = {tuple(r) for r in faults.lead_faults(df.union(df)).collect()}
    assert got == expected
    # samples in a unit that is nowhere stated are judged at the device's usual size
    other = spark.createDataFrame([*rows[:80], lead(200, wave() * 1000, units="", raw=False, unit=""), lead(201, np.where(t == 60, 6000, wave() * 1000), units="", raw=False, unit="")], LEADS)
    assert {tuple(r) for r in faults.lead_faults(other).collect()} == {("r201", 0, "spike")}
    assert faults.lead_faults(df.limit(0)).count() == 0


def test_null_sample_is_no_number(spark):
    df = spark.createDataFrame([lead(1, [1.0, None, 3.0] * 10, units="mV", raw=False)], LEADS)
    assert [r.fault for r in faults.lead_faults(df).collect()] == ["impossible"]


def test_queries_of_the_entry_point(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert {"p1_found", "p2_found", "p6_found", "p7_found"} <= set(q) and set(sql) <= set(q)
    assert entry.entry(spark).columns == ["record_id", "field_name", "epoch_s"]
    leads = spark.createDataFrame([lead(1)], LEADS)
    assert leads.select(F.col("x")).count() == 1
