import files as mk
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import binary as b
from pulsegrid.sources import dicom, reader, xmltree
from pulsegrid.sources import xmlformats as x
from pulsegrid.sources.schema import CorruptFile, MissingElement, Unsupported, lead


def test_edf():
    r = b.decode_edf(mk.edf(annotate=True))
    assert r["source_format"] == "edf_plus" and [v["label"] for v in r["leads"]] == ["EDF ECG I", "EDF ECG II"]
    assert r["leads"][0]["sampling_rate"] == 500 and len(r["leads"][1]["samples"]) == 1000
    assert r["leads"][1]["samples"][:2].tolist() == [1000, 1001] and r["leads"][0]["samples"][500] == 1
    assert r["patient"]["sex"] == "M" and r["patient"]["last_name"] == "Doe" and r["recording"]["duration_seconds"] == 2
    assert r["raw_metadata"]["edf_annotations"][0] == {"onset": 0.5, "duration": 0.1, "text": "beat"}
    assert r["recording"]["acquisition"]["filters"] == {"highpass": 0.05, "lowpass": 150.0, "notch": 50.0, "notch_active": True}
    multi = b.decode_edf(mk.edf(rates=[500, 250]))
    assert [len(v["samples"]) for v in multi["leads"]] == [1000, 500] and multi["leads"][1]["samples"][0] == 1000
    for bad in (mk.edf(cut=1), mk.edf(blocks=-1), b"0       "):
        with pytest.raises(CorruptFile):
            b.decode_edf(bad)


def test_ishne():
    r = b.decode_ishne(mk.ishne())
    assert [v["label"] for v in r["leads"]] == ["I", "II"] and not r["leads"][0]["is_raw"]
    assert r["leads"][1]["samples"][:3].tolist() == [200, 201, 202] and r["recording"]["date"].year == 2023 and r["patient"]["birth_date"].month == 6
    with pytest.raises(CorruptFile):
        b.decode_ishne(b"ISHNE1.0")


@pytest.mark.parametrize("form", [16, 212])
def test_wfdb(form):
    hea, dat, v = mk.wfdb(form)
    r = b.decode_wfdb(hea, {"rec.dat": dat})
    assert [q["samples"].tolist() for q in r["leads"]] == v.T.tolist()
    assert r["leads"][1]["resolution"] == 0.005 and r["leads"][1]["offset_value"] == -0.05 and r["patient"]["age"] == 43
    assert b.decode_wfdb(hea, {})["leads"] == []


def test_wfdb_header_lines():
    text = "r/1 2 360.5/10(3) 7200 1:02:03.5 01/02/1999\nx.dat 212 1e2(-5)/uV 11 1024 3 -4 0 MLII lead\nx.dat 16 bad\n#Patient ID: P7\n# medications: a\n# Drugs: b\n# height: 170.5\n# weight: x\n# Equipment: one\n# device: two\n# nonsense\n"
    h = b.wfdb_header(text)
    assert h["rate"] == 360 and h["recording"]["date"].isoformat() == "1999-02-01T01:02:03" and h["recording"]["duration_seconds"] == 20
    one, two = h["specs"]
    assert (one["gain"], one["baseline"], one["units"], one["adc_zero"], one["description"], one["checksum"]) == (100, -5, "uV", 1024, "MLII lead", -4)
    assert (two["format"], two["gain"], two["units"]) == (16, 200, "mV")
    assert h["patient"] == {"patient_id": "P7", "height": 170.5, "medications": ["a", "b"]} and h["recording"]["device"] == {"model": "one"}
    assert b.edf_filters("HP: 0.05 Hz, lp:100HZ N60Hz") == {"highpass": 0.05, "lowpass": 100.0, "notch": 60.0, "notch_active": True} and b.edf_filters("HP:DC") == {}
    with pytest.raises(CorruptFile):
        b.wfdb_header("# only a note")


def test_mfer():
    r = b.decode_mfer(mk.mfer())
    assert [v["label"] for v in r["leads"]] == ["I", "II"] and r["leads"][0]["sampling_rate"] == 500 and r["leads"][1]["samples"][1] == 201
    assert r["recording"]["device"]["department"] == "ER" and r["recording"]["date"].hour == 10 and r["patient"]["first_name"] == "Jane"


@pytest.mark.parametrize(("second", "huffman"), [(False, False), (True, False), (False, True), (True, True)])
def test_scp(second, huffman):
    r = b.decode_scp(mk.scp(second=second, huffman=huffman))
    assert r["leads"][0]["samples"].tolist() == (np.arange(500) % 40).tolist() and r["leads"][1]["label"] == "II"
    assert r["measurements"] == {"qrs_count": 12, "rr_interval": 800, "heart_rate": 75, "pr_interval": 160, "qt_interval": 400, "qtc_bazett": 420, "p_axis": 10, "t_axis": 30}
    assert [s["left_text"] for s in r["interpretation"]["statements"]] == ["Sinus rhythm", "Normal", "Extra"] and r["recording"]["date"].second == 5


def test_hl7():
    r = x.decode_hl7(mk.hl7())
    assert [v["label"] for v in r["leads"]] == ["I", "aVR"] and r["leads"][0]["sampling_rate"] == 500 and r["leads"][0]["resolution"] == 2.5 and r["leads"][0]["is_raw"]
    assert r["recording"]["duration_seconds"] == 10 and r["patient"]["last_name"] == "Doe" and r["measurements"]["heart_rate"] == 72
    assert len(x.decode_hl7(mk.hl7(series=2))["leads"]) == 4 and not x.decode_hl7(mk.hl7(scale=False))["leads"][0]["is_raw"]


def test_vendor_xml():
    m = x.decode_mortara(mk.mortara())
    assert m["leads"][0]["resolution"] == 0.005 and m["recording"]["duration_seconds"] == 10 and m["measurements"]["heart_rate"] == 75 and len(m["median_beats"]) == 1 and m["raw_metadata"]["age_at_ecg"] == 33
    g = x.decode_muse(mk.muse())
    assert g["leads"][1]["samples"].tolist() == [100, 50] and g["interpretation"]["severity"] == "NORMAL" and g["measurements"] == {"heart_rate": 72, "qrs_duration": 88} and len(g["median_beats"]) == 2 and g["patient"]["birth_date"].day == 20
    c = x.decode_mac2000(mk.mac2000())
    assert c["leads"][0]["resolution"] == 2.5 and c["measurements"]["heart_rate"] == 68 and c["patient"]["age"] == 45
    h = x.decode_beneheart(mk.beneheart())
    assert h["leads"][0]["units"] == "uV" and not h["leads"][0]["is_raw"] and h["patient"]["sex"] == "F" and h["recording"]["device"]["manufacturer"] == "Mindray"


@pytest.mark.parametrize("packing", ["Uncompressed", "XLI"])
def test_sierra(packing):
    rng = np.random.default_rng(1)
    stored = [np.cumsum(rng.integers(-20, 21, 300)) for _ in range(12)]
    r = x.decode_sierra(mk.sierra(stored, packing))
    one, two, three = stored[0], stored[1], stored[1] - stored[0] - stored[2]
    assert [v["label"] for v in r["leads"]][:4] == ["I", "II", "III", "aVR"] and len(r["leads"]) == 12
    assert r["leads"][2]["samples"].tolist() == three.tolist() and r["leads"][5]["samples"].tolist() == (np.floor((two + three) / 2) - stored[5]).tolist()
    assert r["leads"][3]["samples"].tolist() == (-stored[3] - np.floor((one + two) / 2)).tolist() and r["leads"][11]["samples"].tolist() == stored[11].tolist()
    assert r["patient"]["weight"] == 68.0 and r["interpretation"]["severity"] == "ABNORMAL" and r["interpretation"]["source"] == "confirmed"
    assert r["raw_metadata"]["patient_details"] == {"pace_status": "none", "mrn": "M9"} and r["raw_metadata"]["stat_flag"] is True
    with pytest.raises(Unsupported):
        x.decode_sierra(mk.sierra(stored, packing, "9.9"))
    with pytest.raises(MissingElement):
        x.decode_sierra(mk.sierra(stored, packing).replace(b"parsedwaveforms", b"otherwaveforms"))


def test_dicom():
    r = dicom.decode_dicom(mk.dicom())
    assert [v["label"] for v in r["leads"]] == ["I", "II"] and r["leads"][0]["resolution"] == 2 and r["leads"][0]["offset_value"] == -2 and r["leads"][1]["samples"][1] == 201
    assert r["patient"]["height"] == 180 and r["measurements"]["heart_rate"] == 72 and r["recording"]["date"].minute == 30


def test_unsafe_xml():
    with pytest.raises(CorruptFile):
        xmltree.parse(b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>')


ALL = {
    "a.edf": ("edf", mk.edf()), "b.ecg": ("ishne_holter", mk.ishne()), "c.hea": ("wfdb", mk.wfdb()[0]), "d.mfer": ("mfer", mk.mfer()), "e.scp": ("scp_ecg", mk.scp()), "f.xml": ("hl7_aecg", mk.hl7()), "g.xml": ("mortara_el250", mk.mortara()),
    "h.xml": ("ge_muse_xml", mk.muse()), "i.xml": ("ge_mac2000", mk.mac2000()), "j.xml": ("beneheart_r12", mk.beneheart()), "k.xml": ("sierra_xml", mk.sierra([np.arange(50)] * 2)), "l.dcm": ("dicom_waveform", mk.dicom()), "m.txt": (None, b"hello"), "n.bin": (None, b""),
}


def test_read_folder(spark, tmp_path):
    for name, (_, data) in ALL.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "rec.dat").write_bytes(mk.wfdb()[1])
    (tmp_path / "bad.edf").write_bytes(mk.edf(cut=1))
    found = reader.files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r.source_format for r in reader.detect(found).select("path", "source_format").collect()}
    assert {k: got.get(k) for k in ALL} == {k: v[0] for k, v in ALL.items()}  # an empty file may be left out of the scan
    d = reader.decode(found, "PERMISSIVE").cache()
    plain = F.regexp_extract("record_id", r"([^/]*)$", 1).alias("record_id")
    rows = {r.record_id.rpartition("/")[2]: r for r in reader.records_of(d).collect()}
    assert rows["bad.edf"].error and not rows["a.edf"].error and rows["a.edf"].source_format == "edf_plus" and len(rows) == 13
    leads = reader.leads_of(d, "uV")
    n = {r.record_id: r["count"] for r in leads.groupBy(plain).count().collect()}
    assert n["c.hea"] == 2 and n["h.xml"] == 4 and "bad.edf" not in n
    first = leads.where("record_id LIKE '%/g.xml' AND lead_no = 0").first()
    assert first.units == "uV" and first.samples == [500.0, 250.0]
    text = d.where("record_id LIKE '%/a.edf'").select(reader.to_json(d, False).alias("j")).first().j
    assert '"sample_count":1000' in text and '"samples"' not in text
    text = reader.describe(d).where("record_id LIKE '%/a.edf'").first().text
    assert "patient:\n  patient_id: P001\n" in text and "duration_seconds: 0:00:02" in text and "leads: EDF ECG I (1000), EDF ECG II (1000)" in text and "\n  race" not in text
    with pytest.raises(Exception, match="bad.edf|EDF data"):
        reader.decode(found.where("path LIKE '%.edf'")).collect()
    assert reader.decode(found, formats=["edf"], mode="PERMISSIVE", include_samples=False).where(F.size("leads") > 0).count() == 1


def test_same_names_in_two_folders(spark, tmp_path):
    for k, form in enumerate((16, 212)):
        (tmp_path / f"d{k}").mkdir()
        hea, dat, _ = mk.wfdb(form)
        (tmp_path / f"d{k}" / "rec.hea").write_bytes(hea)
        (tmp_path / f"d{k}" / "rec.dat").write_bytes(dat if k else dat[:8])
    d = reader.decode(reader.files(spark, str(tmp_path)))
    assert sorted((r.record_id, r.n) for r in d.select("record_id", F.size(d.leads[0].samples).alias("n")).collect()) == [(f"{tmp_path}/d0/rec.hea", 2), (f"{tmp_path}/d1/rec.hea", 4)]
    plan = reader.decode(reader.files(spark, str(tmp_path), glob="*.edf"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # without headers no join, and no byte is shuffled


def test_list_keeps_order(spark, tmp_path):
    names = ["b.ecg", "a.edf", "d.mfer"]
    for n in names:
        (tmp_path / n).write_bytes(ALL[n][1])
    out = reader.decode_list(spark, [str(tmp_path / n) for n in names])
    assert [r.record_id for r in out.collect()] == [str(tmp_path / n) for n in names]


def test_plugin(spark, tmp_path):
    (tmp_path / "x.own").write_bytes(b"OWN1 2 3")
    own = reader.Plugin("own", lambda content, path: F.decode(F.substring(content, 1, 3), "US-ASCII") == "OWN", lambda data: {"source_format": "own", "leads": [lead([float(v) for v in data[3:].split()], "I", 100)]})
    d = reader.decode(reader.files(spark, str(tmp_path)), plugins=[own])
    assert reader.leads_of(d).first().samples == [1.0, 2.0, 3.0] and d.first().source_format == "own"


def test_stream(spark, tmp_path):
    from pulsegrid.streaming.ingest import arriving_files, heart_rate_windows

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.edf").write_bytes(mk.edf())
    q = reader.detect(arriving_files(spark, str(tmp_path / "in"))).drop("content").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert spark.table("arrived").first().source_format == "edf"
    beats = spark.range(0, 61).selectExpr("1 AS user_id", "timestamp_seconds(id) AS ts")
    rows = heart_rate_windows(beats).orderBy("start").collect()
    assert rows[0].mean_hr == 60.0 and rows[0].beats == 60 and rows[1].mean_hr is None
