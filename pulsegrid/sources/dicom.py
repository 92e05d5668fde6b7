"""DICOM waveforms, read without a DICOM library: explicit types in either byte order, and implicit ones."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

from pulsegrid.sources.binary import Record, moment
from pulsegrid.sources.schema import CorruptFile, Unsupported, lead, signal, with_duration
from pulsegrid.sources.xmlformats import MDC_MEASUREMENTS, number

_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UN", b"UR", b"UT"}
_NUMBERS = {b"US": "u2", b"SS": "i2", b"UL": "u4", b"SL": "i4", b"FL": "f4", b"FD": "f8"}
_ITEM, _ITEM_END, _LIST_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
# Tags in use, and codes of measurements beside those all formats share.
TAGS = {
    "sop_class": 0x00080016, "study_date": 0x00080020, "acq_date": 0x00080022, "study_time": 0x00080030, "acq_time": 0x00080032, "modality": 0x00080060, "manufacturer": 0x00080070, "institution": 0x00080080,
    "referrer": 0x00080090, "code_value": 0x00080100, "code_meaning": 0x00080104, "study": 0x00081030, "department": 0x00081040, "operator": 0x00081070, "model": 0x00081090, "name": 0x00100010, "id": 0x00100020,
    "birth": 0x00100030, "sex": 0x00100040, "age": 0x00101010, "size": 0x00101020, "weight": 0x00101030, "serial": 0x00181000, "software": 0x00181020, "channels": 0x003A0005, "samples": 0x003A0010, "frequency": 0x003A001A,
    "channel_defs": 0x003A0200, "source": 0x003A0208, "sensitivity": 0x003A0210, "sensitivity_units": 0x003A0211, "correction": 0x003A0212, "baseline": 0x003A0213, "low": 0x003A0220, "high": 0x003A0221, "notch": 0x003A0222,
    "concept": 0x0040A043, "numeric": 0x0040A30A, "annotations": 0x0040B020, "text": 0x00700006, "waveforms": 0x54000100, "bits": 0x54001004, "interpretation": 0x54001006, "data": 0x54001010,
}
CODES = MDC_MEASUREMENTS | {
    "MDC_ECG_TIME_PD_QTcB": "qtc_bazett", "MDC_ECG_TIME_PD_QTcF": "qtc_fridericia", "5.10.2.1-1": "heart_rate", "5.10.3-1": "rr_interval", "5.10.3-2": "pr_interval", "5.10.3-3": "qrs_duration", "5.10.3-4": "qt_interval", "5.10.3-5": "qtc_bazett",
}
# Transfer syntaxes with their byte order and whether types are spelled out.
SYNTAXES = {"1.2.840.10008.1.2": ("<", False), "1.2.840.10008.1.2.1": ("<", True), "1.2.840.10008.1.2.2": (">", True)}
#: Types of the tags in use that are no text, for files that do not spell types out.
_KNOWN = {
    **{TAGS[n]: b"SQ" for n in ("channel_defs", "source", "sensitivity_units", "concept", "annotations", "waveforms")},
    **{TAGS[n]: t for n, t in (("channels", b"US"), ("samples", b"UL"), ("bits", b"US"), ("data", b"OW"))},
}
_OPEN = 0xFFFFFFFF


class Reader:
    """Elements of one transfer syntax."""

    def __init__(self, data: bytes, order: str, explicit: bool) -> None:
        self.data, self.order, self.explicit = data, order, explicit

    def _tag(self, at: int) -> int:
        group, element = struct.unpack_from(f"{self.order}HH", self.data, at)
        return group << 16 | element

    def _size(self, at: int, wide: bool = True) -> int:
        return struct.unpack_from(self.order + ("I" if wide else "H"), self.data, at)[0]

    def _head(self, at: int, tag: int) -> tuple[bytes, int, int]:
        """(type, size, place of the value) of the element at a place."""
        if not self.explicit:
            size = self._size(at + 4)
            return _KNOWN.get(tag, b"SQ" if size == _OPEN else b"UN"), size, at + 8
        vr = self.data[at + 4 : at + 6]
        return (vr, self._size(at + 8), at + 12) if vr in _LONG else (vr, self._size(at + 6, False), at + 8)

    def _items(self, at: int, end: int) -> tuple[list[dict[int, Any]], int]:
        """The items of a sequence up to ``end`` or its closing tag."""
        items = []
        while at + 8 <= end:
            mark, size = self._tag(at), self._size(at + 4)
            at += 8
            if mark != _ITEM:
                break
            inner, after = self.elements(at, end if size == _OPEN else at + size)
            at = after if size == _OPEN else at + size
            items.append(inner)
        return items, at

    def elements(self, at: int, end: int, group: int | None = None) -> tuple[dict[int, Any], int]:
        """Elements up to ``end``, a closing tag or another group: sequences as lists of such tables, numbers as lists, the rest as bytes."""
        out: dict[int, Any] = {}
        while at + 8 <= end:
            tag = self._tag(at)
            if tag in (_ITEM_END, _LIST_END):
                return out, at + 8
            if group is not None and tag >> 16 != group:
                break
            vr, size, at = self._head(at, tag)
            if vr == b"SQ" or (size == _OPEN and vr == b"UN"):
                stop = end if size == _OPEN else at + size
                out[tag], after = self._items(at, stop)
                at = after if size == _OPEN else stop
                continue
            if at + size > end:
                raise CorruptFile("a DICOM element is cut off")
            raw, at = self.data[at : at + size], at + size
            form = _NUMBERS.get(vr)
            out[tag] = np.frombuffer(raw, self.order + form, size // np.dtype(form).itemsize).tolist() if form else raw
        return out, at


def _text(table: dict[int, Any], name: str) -> str:
    v = table.get(TAGS[name], b"")
    return v.decode("utf-8", "replace").strip("\0 ") if isinstance(v, bytes) else str(v[0]) if v else ""


def _number(table: dict[int, Any], name: str, default: float | None = None) -> float | None:
    v = number(_text(table, name))
    return default if v is None else v


def _stamp(d: str, t: str) -> Any:
    digits = d[:8] + (t[:6] if len(t) >= 6 else "")
    if not digits.isdigit() or len(d) < 8:
        return None
    return moment(int(digits[:4]), int(digits[4:6]), int(digits[6:8]), *(int(digits[k : k + 2]) for k in range(8, len(digits), 2)))


def decode_dicom(data: bytes) -> Record:
    """The first waveform group that has leads."""
    if len(data) < 132 or data[128:132] != b"DICM":
        raise CorruptFile("no DICOM preamble")
    about, at = Reader(data, "<", True).elements(132, len(data), 2)
    syntax = about.get(0x00020010, b"").decode("ascii", "replace").strip("\0 ") or "1.2.840.10008.1.2.1"
    if syntax not in SYNTAXES:
        raise Unsupported(f"transfer syntax {syntax}")
    order, explicit = SYNTAXES[syntax]
    table, _ = Reader(data, order, explicit).elements(at, len(data))
    leads: list[Record] = []
    cut: dict[str, float] = {}
    sig = signal(0, None, "pcm", 0, 0, signed=None)
    for wave in table.get(TAGS["waveforms"], []):
        count, n = int(_number(wave, "channels", 0)), int(_number(wave, "samples", 0))
        rate, bits = int(_number(wave, "frequency", 0)), int(_number(wave, "bits", 16))
        kind = _text(wave, "interpretation")
        sig = signal(rate, bits, "pcm", count, 0, signed={"SB": True, "SS": True, "UB": False, "US": False}.get(kind))
        raw = wave.get(TAGS["data"], b"")
        if not raw or not count:
            continue
        flat = np.frombuffer(raw, order + ("i4" if bits == 32 else "i2"), len(raw) // (4 if bits == 32 else 2))
        n = min(n, len(flat) // count) if len(flat) < count * n else n
        frames = flat[: n * count].reshape(n, count).astype(float)
        defs = wave.get(TAGS["channel_defs"], [])
        for k in range(count if n else 0):
            d = defs[k] if k < len(defs) else {}
            first = lambda name, d=d: (d.get(TAGS[name]) or [{}])[0]
            label = _text(first("source"), "code_meaning").replace("Lead ", "").replace("lead ", "") or f"Ch{k}"
            step = _number(d, "sensitivity", 1.0) * _number(d, "correction", 1.0)
            for field, name in (("highpass", "low"), ("lowpass", "high"), ("notch", "notch")):
                if (v := _number(d, name)) is not None:
                    cut.setdefault(field, v)
            leads.append(lead(frames[:, k], label, rate, step, _text(first("sensitivity_units"), "code_meaning"), -_number(d, "baseline", 0.0) * step + 0.0))
        if leads:
            break
    sig["number_channels_valid"] = len(leads)
    measured: Record = {}
    said = []
    for note in [*table.get(TAGS["annotations"], []), *(a for w in table.get(TAGS["waveforms"], []) for a in w.get(TAGS["annotations"], []))]:
        concept = (note.get(TAGS["concept"]) or [{}])[0]
        code, meaning, value = _text(concept, "code_value"), _text(concept, "code_meaning"), _number(note, "numeric")
        if value is not None and (field := CODES.get(code) or CODES.get(meaning)):
            measured[field] = int(value)
        if text := _text(note, "text") or (meaning if value is None else ""):
            said.append({"left_text": text, "right_text": ""})
    last, _, given = _text(table, "name").partition("^")
    age, size = _text(table, "age").upper().replace("Y", "").strip(), _number(table, "size")
    patient = {
        "patient_id": _text(table, "id"), "last_name": last.strip(), "first_name": given.split("^")[0].strip(), "sex": {"M": "M", "F": "F"}.get(_text(table, "sex"), "U"), "birth_date": _stamp(_text(table, "birth"), ""),
        "age": int(age) if age.isdigit() else None, "weight": _number(table, "weight"), "height": size * 100 if size is not None else None,
    }
    device = {k: _text(table, n) for k, n in (("manufacturer", "manufacturer"), ("model", "model"), ("software_version", "software"), ("institution", "institution"), ("serial_number", "serial"), ("department", "department"))}
    recording = {
        "date": _stamp(_text(table, "acq_date") or _text(table, "study_date"), _text(table, "acq_time") or _text(table, "study_time")), "referring_physician": _text(table, "referrer"), "technician": _text(table, "operator"),
        "device": device, "acquisition": {"filters": cut | ({"notch_active": True} if cut.get("notch") else {}), "signal": sig},
    }
    meta = {"sop_class_uid": _text(table, "sop_class"), "modality": _text(table, "modality")} | ({"study_description": _text(table, "study")} if _text(table, "study") else {})
    return {"source_format": "dicom_waveform", "patient": patient, "recording": with_duration(recording, leads), "leads": leads, "measurements": measured, "interpretation": {"statements": said, "source": "machine"} if said else {}, "raw_metadata": meta}
