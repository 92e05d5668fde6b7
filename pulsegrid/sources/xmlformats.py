"""Decoders of the XML formats. What a format holds where is stated in tables; one reader fills records from them."""

from __future__ import annotations

import base64
import datetime as dt
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np

from pulsegrid.sources import xmltree as X
from pulsegrid.sources.schema import CorruptFile, MissingElement, Unsupported, lead, signal, with_duration

Record = dict[str, Any]


def number(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def whole(s: str) -> int | None:
    v = number(s)
    return int(v) if v is not None and v == v and abs(v) < 1e18 else None


def sex(s: str, male: str = "M MALE", female: str = "F FEMALE") -> str:
    return "" if not s else "M" if s.upper() in male.split() else "F" if s.upper() in female.split() else "U"


def day(s: str, formats: Iterable[str]) -> dt.datetime | None:
    for f in formats:
        try:
            return dt.datetime.strptime(s.strip(), f)
        except ValueError:
            continue
    return None


def day_and_time(d: str, t: str, formats: Iterable[str]) -> dt.datetime | None:
    when = day(d, formats)
    clock = re.fullmatch(r"(\d{1,2}):(\d\d):(\d\d)", t.strip())
    try:
        return when.replace(hour=int(clock[1]), minute=int(clock[2]), second=int(clock[3])) if when and clock else when
    except ValueError:
        return when


def i16(text: str) -> np.ndarray:
    """Little-endian numbers in Base64."""
    raw = base64.b64decode(text)
    return np.frombuffer(raw, "<i2", len(raw) // 2).astype(float)


def i16_or_list(text: str) -> np.ndarray:
    """Numbers in Base64, or as text between commas or blanks. Base64 is tried first, also where digits alone would do."""
    text = text.strip()
    if not text:
        return np.empty(0)
    try:
        raw = base64.b64decode(text)
        if len(raw) >= 2 and len(raw) % 2 == 0:
            return np.frombuffer(raw, "<i2").astype(float)
    except ValueError:
        pass
    try:
        return np.array([int(v) for v in re.split(r"[,\s]+", text) if v], float)
    except ValueError:
        return np.empty(0)


def take(node: ET.Element | None, table: dict[str, tuple[str, ...]], convert: Callable[[str], Any] = str) -> Record:
    """field -> value of the first of its tags that has text."""
    found = {f: X.text(node, *tags) for f, tags in table.items()}
    return {f: v for f, s in found.items() if s and (v := convert(s)) is not None}


def filters_of(node: ET.Element | None, high: tuple[str, ...], low: tuple[str, ...], notch: tuple[str, ...]) -> Record:
    out = take(node, {"highpass": high, "lowpass": low, "notch": notch}, number)
    return out | ({"notch_active": True} if out.get("notch") else {})


def statements_of(nodes: Iterable[ET.Element], *tags: str) -> list[Record]:
    """Texts of statement nodes: in one of the tags inside, an attribute, or the node itself; one a line."""
    out = []
    for n in nodes:
        s = X.text(n, *tags) or X.attr(n, "TEXT", "DESCRIPTION") or X.text(n)
        out += [{"left_text": x.strip(), "right_text": ""} for x in s.split("\n") if x.strip()]
    return out


# --- HL7 aECG ---------------------------------------------------------------------------------------------------------------

# Lead codes after their common prefix, and measurement codes.
HL7_LEADS = "I II III AVR AVL AVF V1 V2 V3 V4 V5 V6 IIc".split()
MDC_MEASUREMENTS = {
    "MDC_ECG_HEART_RATE": "heart_rate", "MDC_ECG_TIME_PD_RR": "rr_interval", "MDC_ECG_TIME_PD_PR": "pr_interval", "MDC_ECG_TIME_PD_QRS": "qrs_duration", "MDC_ECG_TIME_PD_QT": "qt_interval",
    "MDC_ECG_TIME_PD_QTc": "qtc_bazett", "MDC_ECG_TIME_PD_QTcb": "qtc_bazett", "MDC_ECG_TIME_PD_QTcf": "qtc_fridericia", "MDC_ECG_ANGLE_P_FRONT": "p_axis", "MDC_ECG_ANGLE_QRS_FRONT": "qrs_axis",
    "MDC_ECG_ANGLE_T_FRONT": "t_axis", "MDC_ECG_QRS_COUNT": "qrs_count",
}


def hl7_rate(node: ET.Element | None) -> int:
    """Samples a second from an increment; without a unit, values under one are seconds, others microseconds."""
    v = number(X.attr(node, "value") or X.attr(X.path(node, "value"), "value"))
    if not v or v <= 0:
        return 0
    unit = (X.attr(node, "unit") or X.attr(X.path(node, "value"), "unit")).strip().lower()
    return round({"s": 1, "ms": 1e3, "us": 1e6, "µs": 1e6}.get(unit, 1 if v < 1 else 1e6) / v)


def _hl7_annotation(node: ET.Element, measured: Record, found: Record) -> None:
    code = X.attr(X.path(node, "code"), "code")
    value_node = X.path(node, "value")
    value = X.attr(value_node, "value") or X.text(value_node)
    # severity is read before the broader test for an interpretation, which its code would also meet
    if code in ("MDC_ECG_INTERPRETATION_SEVERITY", "MDC_ECG_RESULT"):
        found["severity"] = value.upper()
    elif "INTERPRETATION" in code.upper():
        if said := value or X.attr(X.path(node, "code"), "displayName"):
            found["statements"].append({"left_text": said, "right_text": ""})
            found["source"] = "machine"
        for inner in (a for c in node if c.tag == "component" for a in X.find_all(c, "annotation")):
            v = X.path(inner, "value")
            row = {"left_text": X.attr(v, "value") or X.text(v), "right_text": ""}
            if row["left_text"] and X.attr(X.path(inner, "code"), "code") not in MDC_MEASUREMENTS and row not in found["statements"]:
                found["statements"].append(row)
        return
    elif code in MDC_MEASUREMENTS and (v := number(value)) is not None:
        measured[MDC_MEASUREMENTS[code]] = round(v)
    for c in node:
        if c.tag == "component":
            for inner in X.find_all(c, "annotation"):
                _hl7_annotation(inner, measured, found)


def decode_hl7(data: bytes) -> Record:
    """All series are read. Their common rate is kept on the record as well."""
    root = X.parse(data)
    if root.tag != "AnnotatedECG":
        raise CorruptFile("no AnnotatedECG root")
    subject, author = X.find(root, "subject"), X.find(X.find(root, "author"), "assignedAuthor")
    device_node = X.find(author, "assignedAuthoringDevice")
    gender = X.find(subject, "administrativeGenderCode")
    race = X.find(subject, "raceCode")
    patient = {
        "patient_id": X.attr(X.find(subject, "id"), "extension", "root"), "last_name": X.text(subject, "family"), "first_name": X.text(subject, "given"), "race": X.attr(race, "displayName", "code"),
        "sex": sex(X.attr(gender, "code") or "U") if gender is not None else "", "birth_date": day(X.attr(X.find(subject, "birthTime"), "value")[:8], ["%Y%m%d"]),
    }
    when = lambda end: day(X.attr(X.path(root, "effectiveTime", end), "value").split(".")[0], ["%Y%m%d%H%M%S"])
    start, stop = when("low"), when("high")
    device = {
        "model": X.text(device_node, "manufacturerModelName"), "software_version": X.text(device_node, "softwareName"), "manufacturer": X.text(X.find(author, "representedOrganization"), "name"),
        "serial_number": X.attr(X.find(author, "id"), "extension"), "institution": X.text(X.find(root, "custodian"), "name"),
    }
    leads = []
    for series in X.find_all(root, "series"):
        for part in (c for c in series if c.tag == "component"):
            nodes = [n for s in part if s.tag == "sequenceSet" for n in s if n.tag == "component"]
            code = lambda n: X.attr(X.path(n, "sequence", "code"), "code")
            shared = next((r for n in nodes if code(n) == "TIME_RELATIVE" and (r := hl7_rate(X.find(n, "increment")))), 0)
            for n in nodes:
                name = code(n).removeprefix("MDC_ECG_LEAD_")
                digits = X.text(X.path(n, "sequence", "value", "digits"))
                if name == code(n) or name not in HL7_LEADS or not digits:
                    continue
                scale, origin = X.find(n, "scale"), X.find(n, "origin")
                k, o = number(X.attr(scale, "value")), number(X.attr(origin, "value"))
                leads.append(lead(np.trunc(np.array(digits.split(), float)), name.replace("AV", "aV"), hl7_rate(X.find(n, "increment")) or shared, 1.0 if k is None else k, X.attr(scale, "unit"), o or 0.0))
    measured: Record = {}
    found: Record = {"statements": []}
    for holder in X.find_all(root, "subjectOf"):
        for a in X.find_all(holder, "annotation"):
            _hl7_annotation(a, measured, found)
    rate = leads[0]["sampling_rate"] if leads else hl7_rate(X.find(root, "increment"))
    recording = {"date": start, "end_date": stop, "duration_seconds": (stop - start).total_seconds() if start and stop else None, "device": device, "acquisition": {"signal": signal(rate, None, "decimal", len(leads), len(leads), signed=None)}}
    return {"source_format": "hl7_aecg", "patient": patient, "recording": recording, "leads": leads, "measurements": measured, "interpretation": found}


# --- Mortara ----------------------------------------------------------------------------------------------------------------

# Labels of demographic fields, and names of measurements.
MORTARA_LABELS = {
    "First:": "first_name", "FName:&,": "first_name", "Name:": "last_name", "Last:": "last_name", "ID&ID:": "patient_id", "ID:": "patient_id", "DOB:": "birth_date", "Age&yr": "age", "Age:": "age",
    "Sex": "sex", "Sex:": "sex", "Height:": "height", "Weight:": "weight", "Race:": "race",
}
MORTARA_MEASURES = {
    "VENT_RATE": "heart_rate", "QRS_DURATION": "qrs_duration", "QT_INT": "qt_interval", "PR_INT": "pr_interval", "P_AXIS": "p_axis", "QRS_AXIS": "qrs_axis", "T_AXIS": "t_axis", "NUM_QRS": "qrs_count",
    "RR_INT": "rr_interval", "RR_INTERVAL": "rr_interval", "QTC_INT": "qtc_bazett", "QT_CORRECTED": "qtc_bazett", "QTC_INTERVAL": "qtc_bazett",
}
# Attributes of a cycle that describe its form.
MORTARA_FORMAL = {"BITS", "FORMAT", "UNITS_PER_MV", "DURATION", "SAMPLE_FREQ", "ENCODING"}


def decode_mortara(data: bytes) -> Record:
    root = X.parse(data)
    if root.tag != "ECG":
        raise CorruptFile("no ECG root")
    cycle, source = X.path(root, "TYPICAL_CYCLE"), X.path(root, "SOURCE")
    steps = whole(X.attr(cycle, "UNITS_PER_MV") or X.attr(root, "UNITS_PER_MV")) or 0
    res, unit = (1 / steps, "mV") if steps > 0 else (1.0, "")
    channels = list(X.find_all(root, "CHANNEL"))
    leads = [lead(i16(X.attr(c, "DATA")), X.attr(c, "NAME"), whole(X.attr(c, "SAMPLE_FREQ")) or 0, res, unit) for c in channels]
    rate = leads[-1]["sampling_rate"] if leads else 0
    beats = [lead(i16(X.attr(c, "DATA")), X.attr(c, "NAME"), whole(X.attr(cycle, "SAMPLE_FREQ")) or rate, res, unit) for c in X.find_all(root, "TYPICAL_CYCLE_CHANNEL")]
    demo: Record = {}
    for f in X.find_all(X.path(root, "DEMOGRAPHIC_FIELDS"), "DEMOGRAPHIC_FIELD"):
        if f.get("LABEL", "") in MORTARA_LABELS:
            demo[MORTARA_LABELS[f.get("LABEL", "")]] = re.sub("['\"]", "", f.get("VALUE", ""))
    if demo:
        demo = {"sex": "U", **demo, "age": int(demo["age"]) if demo.get("age", "").isdigit() else None, "height": number(demo.get("height", "")), "weight": number(demo.get("weight", "")), "birth_date": day(demo.get("birth_date", ""), ["%Y%m%d", "%m/%d/%Y", "%Y-%m-%d", "%d-%b-%Y", "%d %b %Y"])}
    start = day(X.attr(root, "ACQUISITION_TIME"), ["%Y%m%d%H%M%S"])
    count = whole(X.attr(channels[-1], "DURATION")) if channels else 0  # in samples
    seconds = count / rate if count and rate else None
    measured_from = {**{k: v for k, v in root.attrib.items()}, **(cycle.attrib if cycle is not None else {})}
    notes = {"num_qrs": X.attr(root, "NUM_QRS"), "vent_rate": X.attr(root, "VENT_RATE")} | {k.lower(): v for k, v in (cycle.attrib if cycle is not None else {}).items() if k.upper() not in MORTARA_FORMAL}
    said = statements_of(n for tag in ("DIAGNOSIS", "INTERPRETATION", "DIAGNOSIS_STATEMENT") for n in X.find_all(root, tag))
    cut = {k: number(X.attr(source, f"{n}_FILTER")) for k, n in (("lowpass", "LOW_PASS"), ("highpass", "HIGH_PASS"), ("notch", "NOTCH"))}
    device = {"manufacturer": X.attr(source, "MANUFACTURER"), "model": X.attr(source, "MODEL"), "serial_number": X.attr(source, "ACQUIRING_DEVICE_SERIAL_NUMBER"), "software_version": X.attr(source, "SOFTWARE_VERSION"), "acquisition_type": X.attr(source, "TYPE")}
    meta: Record = {"representative_beats": {b["label"]: b["samples"].tolist() for b in beats}}
    if demo.get("birth_date") and start:
        born = demo["birth_date"]
        meta["age_at_ecg"] = start.year - born.year - ((start.month, start.day) < (born.month, born.day))
    return {
        "source_format": "mortara_el250", "patient": demo, "leads": leads, "median_beats": beats, "annotations": {k: v for k, v in notes.items() if v},
        "recording": {"date": start, "end_date": start + dt.timedelta(seconds=seconds) if start and seconds else None, "duration_seconds": seconds, "device": device, "acquisition": {"filters": cut | ({"notch_active": True} if cut["notch"] else {}), "signal": signal(rate, 16, "base64_int16le", len(channels), len(leads))}},
        "measurements": {f: v for k, f in MORTARA_MEASURES.items() if (v := whole(measured_from.get(k, ""))) is not None},
        "interpretation": {"statements": said, "source": "machine", "severity": X.attr(root, "SEVERITY", "DIAGNOSIS_SEVERITY").strip().upper()} if said else {}, "raw_metadata": meta,
    }


# --- GE MUSE, GE MAC 2000, BeneHeart: one reader, three tables ------------------------------------------------------------------

US_DAYS = ("%m/%d/%Y", "%Y-%m-%d", "%m-%d-%Y", "%Y%m%d", "%d-%b-%Y")
ISO_DAYS = ("%Y%m%d", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y")
# Where the three vendors' exports keep things.
GE_MEASURES = {
    "heart_rate": ("VentricularRate",), "pr_interval": ("PRInterval",), "qrs_duration": ("QRSDuration",), "qt_interval": ("QTInterval",), "qtc_bazett": ("QTCorrected",), "qtc_fridericia": ("QTCFredericia",),
    "p_axis": ("PAxis",), "qrs_axis": ("RAxis",), "t_axis": ("TAxis",), "rr_interval": ("RRInterval",), "qrs_count": ("QRSCount", "NumQRS"),
}
MINDRAY_MEASURES = GE_MEASURES | {"heart_rate": ("VentricularRate", "HeartRate"), "qtc_bazett": ("QTCorrected", "QTcBazett"), "qrs_axis": ("QRSAxis", "RAxis"), "rr_interval": ("RRInterval", "RR"), "qtc_fridericia": ()}


def _patient(node: ET.Element | None, days: Iterable[str], male: str = "M MALE", female: str = "F FEMALE") -> Record:
    if node is None:
        return {}
    names = {"patient_id": ("PatientID", "ID"), "first_name": ("PatientFirstName", "FirstName", "GivenName"), "last_name": ("PatientLastName", "LastName", "FamilyName"), "race": ("Race", "Ethnicity")}
    sizes = {"height": ("PatientHeightCM", "Height", "PatientHeight"), "weight": ("PatientWeightKG", "Weight", "PatientWeight")}
    age = X.text(node, "PatientAge", "Age")
    born = X.text(node, "DateofBirth", "BirthDate", "DOB")
    return {**take(node, names), **take(node, sizes, number), "sex": sex(X.text(node, "Gender", "Sex"), male, female), "age": int(age) if age.isdigit() else None, "birth_date": day(born, days) if born else None}


def _acquisition(node: ET.Element | None, days: Iterable[str]) -> Record:
    if node is None:
        return {}
    names = {"location": ("Location", "SiteName"), "room": ("Room",), "technician": ("TechnicianID", "OperatorID", "Technician"), "referring_physician": ("ReferringPhysician", "OrderingPhysician", "AttendingPhysician")}
    return {**take(node, names), "date": day_and_time(X.text(node, "AcquisitionDate", "Date"), X.text(node, "AcquisitionTime", "Time"), days)}


def _severity(statements: list[Record]) -> str:
    """By the words of the statements; the last that says anything counts."""
    out = ""
    for s in statements:
        up = s["left_text"].upper()
        out = "ABNORMAL" if "ABNORMAL" in up else "NORMAL" if "NORMAL" in up else "BORDERLINE" if "BORDERLINE" in up else out
    return out


def decode_muse(data: bytes) -> Record:
    root = X.parse(data)
    if root.tag.lower() != "restingecg":
        raise CorruptFile("no RestingECG root")
    test = X.find(root, "TestDemographics")
    kinds: dict[str, list[Record]] = {}
    count = 0
    for wave in X.find_all(root, "Waveform"):
        base = X.text(wave, "SampleBase")
        own = []
        for n in X.find_all(wave, "LeadData"):
            count += 1
            label, coded = X.text(n, "LeadID"), X.text(n, "WaveFormData")
            try:
                samples = i16(coded) if label and coded else None
            except ValueError:
                samples = None
            if samples is not None:
                step = number(X.text(n, "LeadAmplitudeUnitsPerBit"))
                step = 1.0 if step is None else step
                own.append(lead(samples, label, int(base) if base.isdigit() else 500, step, "uV" if step != 1 else ""))
        kind = X.text(wave, "WaveformType").lower()
        if kind in ("rhythm", "median"):
            kinds[kind] = own
        elif not kinds.get("rhythm"):
            kinds["rhythm"] = own
    leads = kinds.get("rhythm", [])
    read = lambda *tags: statements_of((s for n in X.find_all(root, *tags) for s in X.find_all(n, "DiagnosisStatement")), "StmtText")
    over_node = X.find(root, "OverreadDiagnosis", "OverreadConfirmation")
    over, original = read("OverreadDiagnosis") or read("OverreadConfirmation"), read("Diagnosis")
    said = over or original
    notes: Record = {"diagnosis": "; ".join(s["left_text"] for s in said)} if said else {}
    if over and original:
        notes["original_diagnosis"] = "; ".join(s["left_text"] for s in original)
    reader = X.text(over_node, "OverreaderLastName", "EditorLastName") if over else ""
    measures = X.find(root, "OriginalRestingECGMeasurements", "RestingECGMeasurements")
    notes |= {tags[0].lower(): v for tags in GE_MEASURES.values() if (v := X.text(measures, *tags))}
    order_node = X.find(root, "OrderInfo")
    order = take(order_node, {"ordering_physician": ("OrderingPhysician",), "order_number": ("OrderNumber",), "reason": ("Reason",), "priority": ("OrderPriority",), "referring_physician": ("ReferringPhysician",)})
    wave = next((w for w in X.find_all(root, "Waveform") if X.text(w, "HighPassFilter", "LowPassFilter", "NotchFilterFrequency", "FilterSetting")), None)
    filters = filters_of(wave, ("HighPassFilter",), ("LowPassFilter",), ("NotchFilterFrequency",))
    artifact = {"on": True, "true": True, "yes": True, "off": False, "false": False, "no": False}.get(X.text(wave, "FilterSetting").lower())
    device = take(test, {"model": ("AcquisitionDevice",), "software_version": ("AcquisitionSoftwareVersion",), "manufacturer": ("ManufacturerID",)})
    recording = _acquisition(test, US_DAYS)
    recording["referring_physician"] = order.get("referring_physician", "")
    rate = leads[0]["sampling_rate"] if leads else 0
    recording |= {"device": device, "acquisition": {"filters": filters | ({"artifact_filter": artifact} if artifact is not None else {}), "signal": signal(rate, 16, "base64_int16le", count or len(leads), len(leads))}}
    return {
        "source_format": "ge_muse_xml", "patient": _patient(X.find(root, "PatientDemographics"), US_DAYS), "recording": recording, "leads": leads, "median_beats": kinds.get("median", []), "annotations": notes,
        "measurements": take(measures, GE_MEASURES, whole), "raw_metadata": {"order_info": order} if order else {},
        "interpretation": {"statements": said, "source": "overread" if over else "machine" if said else "", "severity": _severity(said), "interpreter": f"{X.text(over_node, 'OverreaderFirstName', 'EditorFirstName')} {reader}".strip() if reader else ""},
    }


def decode_mac2000(data: bytes) -> Record:
    root = X.parse(data)
    if root.tag.lower() not in ("mac2000", "mac_2000", "ge_mac", "macexport"):
        raise CorruptFile(f"unknown root {root.tag}")
    rate = whole(X.text(root, "SampleRate", "SampleBase")) or 500
    wave = X.find(root, "Waveform", "WaveformData", "Leads")
    common = number(X.text(wave, "LeadAmplitudeUnitsPerBit", "AcquiredAmplitudeResolution", "AmplitudeResolution"))
    leads = []
    nodes = next((found for t in ("LeadData", "Lead", "Channel") if (found := list(X.find_all(wave, t)))), [])
    for n in nodes:
        samples = i16_or_list(X.text(n, "WaveFormData", "Data") or X.attr(n, "Data") or X.text(n))
        step = number(X.text(n, "LeadAmplitudeUnitsPerBit"))
        step = step if step is not None else common if common is not None else 1.0
        if len(samples):
            leads.append(lead(samples, X.text(n, "LeadID") or X.attr(n, "Name") or X.text(n, "Name") or "?", rate, step, "uV" if step != 1 else ""))
    measures = X.find(root, "Measurements", "RestingECGMeasurements")
    notes = {t.lower(): v for tags in GE_MEASURES.values() for t in tags if t != "QTCFredericia" and (v := X.text(measures, t))}
    interpretation: Record = {}
    for tag, source in (("OverreadDiagnosis", "overread"), ("OriginalDiagnosis", "machine"), ("Diagnosis", "machine"), ("Interpretation", "machine")):
        node = X.find(root, tag)
        inner = next((found for t in ("Statement", "DiagnosisStatement") if (found := list(X.find_all(node, t)))), [node] if node is not None else [])
        if said := statements_of(inner, "StmtText", "Text"):
            interpretation = {"statements": said, "source": source}
            break
    if said := X.text(X.find(root, "Diagnosis", "Interpretation"), "Statement", "Text") or X.text(X.find(root, "Diagnosis", "Interpretation")):
        notes["diagnosis"] = said
    device = {"manufacturer": "GE", "model": X.text(root, "DeviceModel", "AcquisitionDevice") or "MAC 2000", "software_version": X.text(root, "SoftwareVersion", "AcquisitionSoftwareVersion"), "serial_number": X.text(root, "SerialNumber", "DeviceSerialNumber")}
    test = X.find(root, "TestDemographics", "AcquisitionInfo", "RecordingInfo")
    cut = X.find(root, "FilterSettings")
    filters = filters_of(cut if cut is not None else root, ("HighPassFilter",), ("LowPassFilter",), ("NotchFilter",))
    recording = {**_acquisition(test, US_DAYS), "device": device, "acquisition": {"filters": filters, "signal": signal(whole(X.text(test, "SampleRate", "SampleBase")) or (leads[0]["sampling_rate"] if leads else 0), None, "base64_int16le", len(nodes), len(leads))}}
    measured = take(measures, {k: v for k, v in GE_MEASURES.items() if k != "qtc_fridericia"}, whole)
    return {"source_format": "ge_mac2000", "patient": _patient(X.find(root, "PatientDemographics", "PatientInfo", "Patient"), US_DAYS), "recording": with_duration(recording, leads), "leads": leads, "annotations": notes, "measurements": measured, "interpretation": interpretation}


def decode_beneheart(data: bytes) -> Record:
    root = X.parse(data)
    if root.tag.lower() not in ("beneheartr12", "mindrayecg", "ecgdata"):
        raise CorruptFile(f"unknown root {root.tag}")
    rate = whole(X.text(root, "SampleRate", "SamplingRate")) or 500
    holder = X.find(root, "Leads", "WaveformData", "Channels")
    nodes = next((found for t in ("Lead", "Channel") if (found := list(X.find_all(holder, t)))), [])
    leads = []
    for n in nodes:
        res = number(X.text(n, "Resolution", "AmplitudeResolution"))
        samples = i16_or_list(X.attr(n, "Data") or X.text(n) or X.text(n, "Data", "Samples"))
        if len(samples):
            leads.append(lead(samples, X.attr(n, "Name", "Label") or X.text(n, "Name", "Label") or "?", rate, 1.0 if res is None else res, "uV"))
    if not nodes and holder is not None:
        for label in "I II III aVR aVL aVF V1 V2 V3 V4 V5 V6".split():
            if len(samples := i16_or_list(X.text(holder, label))):
                leads.append(lead(samples, label, rate, 1.0, "uV"))
    said: list[Record] = []
    for tag in ("Diagnosis", "Interpretation", "AnalysisResult", "MachineInterpretation"):
        for n in X.find_all(root, tag):
            inner = [m for t in ("DiagnosisStatement", "Statement", "StmtText", "Text", "Description") for m in X.find_all(n, t) if X.text(m)]
            said += statements_of(inner or ([n] if not said or X.text(n) else []))
    acq = X.find(root, "AcquisitionInfo", "RecordingInfo", "TestInfo")
    get = lambda *tags: X.text(acq, *tags) or X.text(root, *tags)
    device = {"model": get("DeviceName", "DeviceModel", "Device", "Model") or "BeneHeart R12", "manufacturer": get("Manufacturer") or "Mindray", "serial_number": get("SerialNumber"), "software_version": get("SoftwareVersion", "FirmwareVersion")}
    cut = X.find(root, "FilterSettings")
    filters = filters_of(cut if cut is not None else root, ("HighPass", "HighPassFilter"), ("LowPass", "LowPassFilter"), ("NotchFilter", "Notch"))
    rate_said = whole(X.text(acq, "SampleRate", "SamplingRate")) or (leads[0]["sampling_rate"] if leads else 0)
    recording = {"date": day_and_time(X.text(acq, "AcquisitionDate", "Date"), X.text(acq, "AcquisitionTime", "Time"), ISO_DAYS[:3]), "device": device, "acquisition": {"filters": filters, "signal": signal(rate_said, None, "base64_int16le", len(leads), len(leads))}}
    clinical = {c.tag: X.text(c) for t in ("ClinicalInfo", "OrderInfo", "Indication") for n in X.find_all(root, t) for c in (list(n) or [n]) if X.text(c)}
    patient = _patient(X.find(root, "PatientInfo", "Patient", "Demographics"), ISO_DAYS, "M MALE 1", "F FEMALE 2")
    measured = take(X.find(root, "Measurements", "GlobalMeasurements", "RestingECGMeasurements", "OriginalRestingECGMeasurements"), MINDRAY_MEASURES, whole)
    return {"source_format": "beneheart_r12", "patient": patient, "recording": with_duration(recording, leads), "leads": leads, "measurements": measured, "interpretation": {"statements": said, "source": "machine", "severity": X.text(root, "Severity", "DiagnosisSeverity").upper()}, "raw_metadata": {"clinical_info": clinical} if clinical else {}}


# --- Philips Sierra -----------------------------------------------------------------------------------------------------------


def lzw(data: bytes, width: int = 10) -> bytes:
    """LZW with codes of one width, high bits first; the table stops growing two codes before its end."""
    most = (1 << width) - 2
    words: list[bytes] = [bytes([k]) for k in range(256)]
    out, before, held, bits = bytearray(), b"", 0, 0
    for b in data:
        held, bits = (held << 8 | b) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code > most:
            break
        word = words[code] if code < len(words) else before + before[:1]
        if before and len(words) <= most:
            words.append(before + word[:1])
        out += word
        before = word
    return bytes(out)


def xli(data: bytes) -> list[np.ndarray]:
    """Leads from chunks of size, first value and LZW-packed byte planes of second differences."""
    out, at = [], 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little", signed=True)
        first = int.from_bytes(data[at + 6 : at + 8], "little", signed=True)
        if size < 0:
            raise CorruptFile("a chunk of negative size")
        raw = lzw(data[at + 8 : at + 8 + size])
        at += 8 + size
        raw += b"\0" * (len(raw) % 2)
        half = len(raw) // 2
        if half < 2:
            raise CorruptFile("a chunk of under two samples")
        v = np.frombuffer(raw[:half], np.uint8).astype(np.int64) << 8 | np.frombuffer(raw[half:], np.uint8)
        v = np.where(v >= 32768, v - 65536, v)
        e = np.zeros(half, np.int64)
        e[1] = v[1] - v[0]
        if half > 2:
            e[2] = -first
            e[3:] = 64 - v[2:-1]
        samples = v[0] + np.cumsum(np.cumsum(e))
        if np.abs(samples).max() > 32768:
            raise CorruptFile("samples beyond 16 bits")
        out.append(samples.astype(float))
    return out


# Document types and versions, severities by code, and tags of measurements.
SIERRA_TYPES, SIERRA_VERSIONS = {"SierraECG", "PhilipsECG"}, {"1.03", "1.04", "1.04.01", "1.04.02"}
SEVERITY = {"NM": "NORMAL", "ON": "OTHERWISE NORMAL", "BL": "BORDERLINE", "AB": "ABNORMAL"}
SIERRA_MEASURES = {
    "heart_rate": ("heartrate",), "rr_interval": ("rrint",), "pr_interval": ("print",), "qrs_duration": ("qrsdur",), "qt_interval": ("qtint",), "qtc_bazett": ("qtcb",), "qtc_fridericia": ("qtcf",),
    "p_axis": ("pfrontaxis",), "qrs_axis": ("qrsfrontaxis",), "t_axis": ("tfrontaxis",),
}


def _flag(s: str) -> bool | None:
    return s.lower() in ("yes", "true", "t", "1") if s else None


def _sierra_wave(details: ET.Element | None, wave: ET.Element) -> tuple[list[str], list[np.ndarray]]:
    rate, ms = whole(X.text(details, "samplingrate")) or 0, whole(X.attr(wave, "durationperchannel")) or 0
    if X.attr(wave, "leadlabels"):
        labels = X.attr(wave, "leadlabels").split(" ")[: whole(X.attr(wave, "numberofleads"))]
    else:
        standard = X.text(details, "acquisitiontype") in ("STD-12", "10-WIRE")
        names = "I II III aVR aVL aVF V1 V2 V3 V4 V5 V6".split()
        count = whole(X.text(details, "numberchannelsallocated")) or 0
        labels = [names[k] if standard and k < 12 else f"Channel {k + 1}" for k in range(count)]
    if X.attr(wave, "dataencoding") != "Base64":
        raise Unsupported(f"encoding {X.attr(wave, 'dataencoding')!r}")
    raw = base64.b64decode("".join(wave.itertext()))
    packing = X.attr(wave, "compressmethod", "compression") or "Uncompressed"
    if packing == "XLI":
        return labels, xli(raw)
    if packing != "Uncompressed":
        raise Unsupported(f"compression {packing!r}")
    n = int(ms * (rate / 1000))
    flat = np.frombuffer(raw, "<i2", len(raw) // 2).astype(float)
    return labels, [flat[k * n : (k + 1) * n] for k in range(len(labels))]


def undo_limb_prediction(leads: list[np.ndarray]) -> list[np.ndarray]:
    """The six limb leads from I, II and what was stored of the other four; the new III serves aVL and aVF."""
    if len(leads) < 6 or len({len(x) for x in leads[:6]}) > 1:
        return leads
    one, two, three, avr, avl, avf = leads[:6]
    three = two - one - three
    fixed = [three, -avr - np.floor((one + two) / 2), np.floor((one - three) / 2) - avl, np.floor((two + three) / 2) - avf]
    if max(np.abs(x).max(initial=0) for x in fixed) > 32768:
        raise CorruptFile("limb leads beyond 16 bits")
    return [one, two, *fixed, *leads[6:]]


def _as_dict(node: ET.Element) -> Any:
    """A node as nested dictionaries and texts; repeated children become lists."""
    out: Record = {f"@{k}": v for k, v in node.attrib.items()}
    for c in node:
        v = _as_dict(c)
        out[c.tag] = [*(out[c.tag] if isinstance(out[c.tag], list) else [out[c.tag]]), v] if c.tag in out else v
    s = (node.text or "").strip()
    return {**out, "#text": s} if out and s else out or s


def decode_sierra(data: bytes) -> Record:
    root = X.parse(data)
    if root.tag != "restingecgdata":
        raise MissingElement("no restingecgdata root")
    info = X.find(root, "documentinfo")
    kind, version = X.text(info, "documenttype"), X.text(info, "documentversion")
    if kind not in SIERRA_TYPES or version not in SIERRA_VERSIONS:
        raise Unsupported(f"{kind} {version}")
    acquired = X.find(root, "dataacquisition")
    details, wave = X.find(acquired, "signalcharacteristics"), X.find(root, "parsedwaveforms")
    if details is None or wave is None:
        raise MissingElement("no signalcharacteristics or parsedwaveforms")
    rate, step = whole(X.text(details, "samplingrate")) or 0, float(whole(X.text(details, "resolution")) or 1)
    labels, samples = _sierra_wave(details, wave)
    leads = [lead(x, name, rate, step, "uV") for name, x in zip(labels, undo_limb_prediction(samples), strict=False)]
    beats: list[Record] = []
    if (rep := X.find(root, "repbeats")) is not None:
        try:
            names, own = _sierra_wave(details, rep)
            beats = [lead(x, name, whole(X.attr(rep, "samplespersecond")) or rate or 500, step, "uV") for name, x in zip(names, own, strict=False)]
        except ValueError:
            beats = []  # beats are extra; a record without readable ones still counts
    person = X.find(root, "generalpatientdata")
    patient: Record = take(person, {"patient_id": ("patientid",), "first_name": ("firstname",), "last_name": ("lastname",), "sex": ("sex",), "race": ("race",)})
    patient["birth_date"] = day(X.text(person, "dateofbirth"), ["%Y-%m-%d"])
    age = X.find(person, "age")
    years = whole(X.text(age, "years"))
    patient["age"] = years if years is not None else whole(X.attr(age, "defaultage"))
    for field, metric, other, factor in (("weight", "kg", "lb", 0.453592), ("height", "cm", "inch", 2.54)):
        v, w = number(X.text(person, metric)), number(X.text(person, other))
        patient[field] = v if v is not None else round(w * factor, 1) if w is not None else None
    start = day_and_time(X.attr(acquired, "date"), X.attr(acquired, "time"), ["%Y-%m-%d"]) if X.attr(acquired, "time") else None
    ms = whole(X.attr(wave, "durationperchannel"))
    seconds = ms // 1000 if ms is not None else None
    site, machine, order = X.find(root, "acquirer"), X.find(acquired, "machine"), X.find(root, "orderinfo")
    detail = X.attr(machine, "detaildescription")
    device = {
        "model": X.text(machine), "name": X.attr(machine, "machineid"), "serial_number": detail, "manufacturer": detail.split(":")[0].strip() or X.attr(machine, "manufacturer", "manufacturercode") or X.text(machine, "manufacturer", "manufacturercode"),
        "software_version": version, "acquisition_type": X.text(details, "acquisitiontype"), "institution": X.text(site, "institutionname"), "department": X.text(site, "departmentname"),
    }
    both = lambda tag, at: X.text(details, tag) or X.attr(wave, at)
    band = X.find(root, "reportbandwidth")
    filters = {
        "highpass": number(both("hipass", "hipass") or X.text(band, "highpassfiltersetting")), "lowpass": number(both("lowpass", "lowpass") or X.text(band, "lowpassfiltersetting")),
        "notch": number(both("notchfilterfreqs", "notchfilterfreqs") or X.text(band, "notchfiltersetting")), "notch_active": _flag(both("notchfiltered", "notchfiltered")),
        "artifact_filter": _flag(X.attr(wave, "artfiltered") or X.text(band, "artifactfilterflag")),
    }
    sig = signal(
        rate, whole(both("bitspersample", "bitspersample")), X.attr(wave, "dataencoding"), whole(X.text(details, "numberchannelsallocated")) or len(labels), whole(X.text(details, "numberchannelsvalid")) or len(leads), X.attr(wave, "compression", "compressmethod"), _flag(both("signalsigned", "signalsigned")),
        resolution=step, signal_offset=whole(both("signaloffset", "signaloffset")), electrode_placement=X.text(details, "electrodeplacement"), acsetting=whole(X.text(details, "acsetting")), upsampled=_flag(X.attr(wave, "upsampled")),
        downsampled=_flag(X.attr(wave, "downsampled")), waveform_modified=_flag(X.attr(wave, "waveformmodified")), upsampling_method=X.attr(wave, "upsamplemethod"),
    )
    recording = {
        "date": start, "duration_seconds": seconds, "end_date": start + dt.timedelta(seconds=seconds) if start and seconds is not None else None, "device": device, "acquisition": {"filters": filters, "signal": sig},
        "technician": X.attr(X.find(site, "operator"), "id"), "room": X.text(site, "room") or X.text(order, "room"), "location": X.text(site, "facilityname"), "referring_physician": X.text(order, "referringphysician", "orderingphysician"),
    }
    globals_, severity, read = X.find(root, "globalmeasurements"), X.find(root, "severity"), X.find(root, "interpretation")
    said, notes = [], {c.tag: X.text(c) for c in (globals_ if globals_ is not None else []) if X.text(c)}
    for s in X.find_all(root, "statement"):
        left, right = X.text(s, "leftstatement"), X.text(s, "rightstatement")
        notes |= {f"statement_{X.text(s, 'statementcode')}_left": left, f"statement_{X.text(s, 'statementcode')}_right": right}
        if left or right:
            said.append({"left_text": left, "right_text": right})
    notes |= {k: v for k, v in (("severity_code", X.attr(severity, "code")), ("severity_text", X.text(severity)), ("interpretation_date", X.attr(read, "date")), ("interpretation_time", X.attr(read, "time")), ("severity_id", X.attr(severity, "id")), ("criteria_version", X.attr(read, "criteriaversion")), ("criteria_version_date", X.attr(read, "criteriaversiondate"))) if v}
    confirming = X.find(root, "confirmingclinician")
    code = X.attr(severity, "code").strip().upper()
    interpretation = {
        "statements": said, "severity": SEVERITY.get(code, code) or X.text(severity).strip("- "), "interpretation_date": day_and_time(X.attr(read, "date"), X.attr(read, "time"), ["%Y-%m-%d"]) if X.attr(read, "time") else None,
        "source": "confirmed" if confirming is not None or X.attr(root, "status").strip().lower() == "confirmed" else "machine", "interpreter": X.text(read, "mdsignatureline") or X.text(confirming),
    }
    measured = take(globals_, SIERRA_MEASURES, whole)
    if (count := whole(X.text(X.find(root, "crossleadmeasurements"), "numberofcomplexes"))) is not None:
        measured["qrs_count"] = count
    meta: Record = {}
    details_of = {
        "patient_details": take(person, {"pace_status": ("pacestatus",), "unique_patient_id": ("uniquepatientid",), "mrn": ("MRN",)}),
        "acquirer_details": take(site, {"department_id": ("departmentid",), "institution_id": ("institutionid",), "facility_id": ("facilityid",), "bed": ("bed",), "encounter": ("encounter",)}),
    }
    meta |= {name: found for name, values in details_of.items() if (found := {k: v for k, v in values.items() if v})}
    if X.attr(acquired, "statflag"):
        meta["stat_flag"] = _flag(X.attr(acquired, "statflag"))
    per_lead = {X.attr(n, "leadname", "label"): {c.tag: X.text(c) for c in n if X.text(c)} for n in X.find_all(root, "leadmeasurement")}
    if per_lead:
        meta["lead_measurements"] = per_lead
        for x in leads:
            x["annotations"] = per_lead.get(x["label"], {})
    for name, tag in (("order_info", "orderinfo"), ("cross_lead_measurements", "crossleadmeasurements"), ("group_measurements", "groupmeasurements"), ("config_settings", "configsettings"), ("user_defines", "userdefines"), ("report_info", "reportinfo"), ("document_info", "documentinfo")):
        if (n := X.find(root, tag)) is not None:
            meta[name] = _as_dict(n)
    return {"source_format": "sierra_xml", "patient": patient, "recording": recording, "leads": leads, "median_beats": beats, "annotations": notes, "measurements": measured, "interpretation": interpretation, "raw_metadata": meta}


DECODERS: dict[str, Callable[[bytes], Record]] = {"hl7_aecg": decode_hl7, "mortara_el250": decode_mortara, "ge_muse_xml": decode_muse, "ge_mac2000": decode_mac2000, "beneheart_r12": decode_beneheart, "sierra_xml": decode_sierra}
