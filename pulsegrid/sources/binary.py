"""Decoders of the binary formats: bytes in, a sparse record out. Samples are read as whole blocks."""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

from pulsegrid.sources.schema import CorruptFile, lead, signal, with_duration

Record = dict[str, Any]


def ascii_text(raw: bytes) -> str:
    """ASCII up to padding."""
    return raw.decode("ascii", "replace").replace("\0", "").strip()


def utf8_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").strip("\0 ")


def moment(*parts: int) -> dt.datetime | None:
    """A datetime, or None where the numbers are no date."""
    try:
        return dt.datetime(*parts)
    except ValueError:
        return None


SEX_CODES = {1: "M", 2: "F"}

# --- EDF and EDF+ ---------------------------------------------------------------------------------------------------------

# The per-signal header fields and their widths.
EDF_FIELDS = {"label": 16, "transducer": 80, "unit": 8, "pmin": 8, "pmax": 8, "dmin": 8, "dmax": 8, "prefilter": 80, "n": 8, "reserved": 32}


def edf_patient(text: str) -> Record:
    """EDF+ patient field: code, sex, birth date, name; X stands for unknown."""
    parts = (text.split() + ["X"] * 4)[:4] if text else []
    if not parts:
        return {}
    given = text.split()
    out: Record = {"patient_id": "" if parts[0] == "X" else parts[0]}
    if len(given) > 1:
        out["sex"] = parts[1].upper() if parts[1].upper() in ("M", "F") else "U"
    try:
        out["birth_date"] = dt.datetime.strptime(parts[2], "%d-%b-%Y")
    except ValueError:
        pass
    if parts[3] != "X":
        out["last_name"], _, out["first_name"] = parts[3].partition("_")
    return out


def edf_recording(text: str) -> Record:
    """EDF+ recording field: Startdate, date, investigator, equipment, technician."""
    parts = text.split()
    if len(parts) < 2 or parts[0] != "Startdate":
        return {}
    return {k: v for k, v in zip(("referring_physician", "equipment", "technician"), parts[2:], strict=False) if v != "X"}


# The marks of cut-offs in a prefiltering text.
EDF_CUTOFFS = {"HP": "highpass", "LP": "lowpass", "N": "notch", "NOTCH": "notch"}


def edf_filters(text: str) -> Record:
    """Cut-offs in a prefiltering text such as ``HP:0.05Hz LP:150Hz N:50Hz``; of a repeated mark the first counts."""
    out: Record = {}
    words = re.findall(r"[A-Z]+|[0-9.]+", text.upper())
    for mark, value, unit in zip(words, words[1:], words[2:], strict=False):
        if mark in EDF_CUTOFFS and unit == "HZ" and (v := decimal(value)) is not None:
            out.setdefault(EDF_CUTOFFS[mark], v)
    return out | ({"notch_active": True} if "notch" in out else {})


def decimal(text: str) -> float | None:
    """The number a text spells, or None."""
    try:
        return float(text)
    except ValueError:
        return None


def edf_annotations(raw: bytes) -> list[Record]:
    """Onset, duration and text of time-stamped annotation lists."""
    out = []
    for block in raw.decode("latin-1").split("\0"):
        head, *texts = block.split("\x14")
        onset, _, duration = head.partition("\x15")
        if re.fullmatch(r"[+-]\d+(\.\d*)?", onset) and re.fullmatch(r"(\d+(\.\d*)?)?", duration):
            out += [{"onset": float(onset), "duration": float(duration or 0), "text": t.strip()} for t in texts if t.strip()]
    return out


def decode_edf(data: bytes) -> Record:
    """A truncated file and an unknown number of blocks are errors, so no sample is made up."""
    if len(data) < 256:
        raise CorruptFile("shorter than an EDF header")
    cut = lambda a, b: ascii_text(data[a:b])
    try:
        start, blocks, seconds, ns = int(cut(184, 192)), int(cut(236, 244)), float(cut(244, 252)), int(cut(252, 256))
    except ValueError as e:
        raise CorruptFile(f"EDF header: {e}") from e
    if ns <= 0 or blocks < 0:
        raise CorruptFile(f"{ns} signals in {blocks} blocks")
    fields, at = {}, 256
    for name, width in EDF_FIELDS.items():
        fields[name] = [cut(at + k * width, at + (k + 1) * width) for k in range(ns)]
        at += ns * width
    try:
        n = np.array([int(v) for v in fields["n"]])
        ranges = {k: [float(v) for v in fields[k]] for k in ("pmin", "pmax", "dmin", "dmax")}
    except ValueError as e:
        raise CorruptFile(f"EDF signal header: {e}") from e
    size = int(n.sum())
    if start + blocks * size * 2 > len(data):
        raise CorruptFile("EDF data end early")
    matrix = np.frombuffer(data, "<i2", blocks * size, start).reshape(blocks, size)
    edges = np.append(0, np.cumsum(n))
    plus = cut(192, 236).startswith("EDF+")
    notes = [k for k in range(ns) if "annotation" in fields["label"][k].lower()]
    leads = []
    for k in range(ns):
        if k in notes:
            continue
        span = ranges["dmax"][k] - ranges["dmin"][k]
        gain = (ranges["pmax"][k] - ranges["pmin"][k]) / span if span else 1.0
        offset = ranges["pmin"][k] - gain * ranges["dmin"][k] if span else 0.0
        samples = matrix[:, edges[k] : edges[k + 1]].ravel().astype(float)
        leads.append(lead(samples, fields["label"][k], int(n[k] / seconds) if seconds > 0 else 0, gain, fields["unit"][k], offset, transducer=fields["transducer"][k], prefiltering=fields["prefilter"][k]))
    day, clock = cut(168, 176).split("."), cut(176, 184).split(".")
    when = None
    if len(day) == 3 and len(clock) == 3 and all(x.isdigit() for x in day + clock):
        year = int(day[2])
        when = moment(year + (1900 if year >= 85 else 2000), int(day[1]), int(day[0]), *map(int, clock))
    total = blocks * seconds
    recording: Record = {"date": when, "duration_seconds": total or None, "end_date": when + dt.timedelta(seconds=total) if when and total else None}
    meta: Record = {"recording_id": cut(88, 168), "num_records": blocks, "record_duration": seconds, "is_edfplus": plus}
    if plus:
        found = edf_recording(cut(88, 168))
        recording |= {k: v for k, v in found.items() if k != "equipment"} | {"device": {"model": found.get("equipment")}}
        texts = [a for k in notes for a in edf_annotations(matrix[:, edges[k] : edges[k + 1]].tobytes())]
        if texts:
            meta["edf_annotations"] = texts
    filters = [edf_filters(x["prefiltering"]) for x in leads if x["prefiltering"]]
    same = filters and all(f == filters[0] for f in filters)
    rates = [int(v / seconds) if seconds > 0 else 0 for v in n]
    recording["acquisition"] = {"filters": filters[0] if same else {}, "signal": signal(rates[0], 16, "int16", ns, len(leads))}
    return {"source_format": "edf_plus" if plus else "edf", "patient": edf_patient(cut(8, 88)) if plus else {"patient_id": cut(8, 88)}, "recording": recording, "leads": leads, "raw_metadata": meta}


# --- ISHNE ----------------------------------------------------------------------------------------------------------------

# Lead names by code.
ISHNE_LEADS = {-9: "absent", **dict(enumerate("unknown generic X Y Z I II III aVR aVL aVF V1 V2 V3 V4 V5 V6 ES AS AI".split()))}


def decode_ishne(data: bytes) -> Record:
    if len(data) < 522:
        raise CorruptFile("shorter than an ISHNE header")
    short = lambda at, n=1: struct.unpack_from(f"<{n}h", data, at)
    text = lambda at, n: data[at : at + n].split(b"\0")[0].decode("ascii", "replace")
    (checksum,) = struct.unpack_from("<H", data, 8)
    var_size, ecg_size, var_at, ecg_at = struct.unpack_from("<4i", data, 10)
    (count,), (rate,) = short(156), short(272)
    if not 1 <= count <= 12:
        raise CorruptFile(f"{count} leads")
    spec, quality, steps = short(158, 12), short(182, 12), short(206, 12)
    per = max(0, len(data) - ecg_at) // 2 // count
    frames = np.frombuffer(data, "<i2", per * count, ecg_at).reshape(per, count)
    leads = []
    for k in range(count):
        known = steps[k] > 0
        leads.append(
            lead(frames[:, k].astype(float), ISHNE_LEADS.get(spec[k], f"Lead {k + 1}"), rate, steps[k] / 1000 if known else 1.0, "uV" if known else "", adc_resolution=float(steps[k]), adc_resolution_unit="nV" if known else "", quality=quality[k])
        )
    d, m, y = short(138, 3)
    bd, bm, by = short(132, 3)
    recording = {"date": moment(y, m, d, *short(150, 3)), "device": {"model": text(232, 40)}, "acquisition": {"signal": signal(rate, 16, "int16", count, count)}}
    meta = {"var_block_size": var_size, "ecg_size": ecg_size, "checksum": checksum, "is_annfile": data[:8] == b"ANN  1.0", "lead_quality": list(quality[:count]), "pacemaker_code": short(274)[0], "recorder_type": short(276)[0]}
    if var_size > 0:
        meta["variable_block"] = data[var_at : var_at + var_size].hex()
    patient = {"first_name": text(28, 40), "last_name": text(68, 40), "patient_id": text(108, 20), "sex": SEX_CODES.get(short(128)[0], "U"), "birth_date": moment(by, bm, bd)}
    return {"source_format": "ishne_holter", "patient": patient, "recording": with_duration(recording, leads), "leads": leads, "raw_metadata": meta}


# --- WFDB -----------------------------------------------------------------------------------------------------------------

def unpack_212(data: bytes) -> np.ndarray:
    """Two 12-bit numbers in three bytes."""
    b = np.frombuffer(data, np.uint8, len(data) // 3 * 3).reshape(-1, 3).astype(np.int32)
    pairs = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 1] >> 4 | b[:, 2] << 4], 1).ravel()
    return pairs - (pairs >= 2048) * 4096


def wfdb_gain(text: str) -> Record:
    """``gain(baseline)/unit``, of which the last two may be missing."""
    body, _, unit = text.partition("/")
    value, _, base = body.partition("(")
    base = base.rstrip(")")
    if (gain := decimal(value)) is None:
        return {}
    return {"gain": gain, "baseline": int(base) if base.lstrip("-").isdigit() else 0, "units": unit or "mV"}


def wfdb_signal(line: str) -> Record:
    """One signal line: file, format, gain, resolution, zero, first value, checksum, block size, description."""
    name, form, gain, *rest = [*line.split(), "", ""][: max(3, len(line.split()))]
    digits = re.match(r"\d+", form)
    out: Record = {"filename": name, "format": int(digits[0]) if digits else 16, "gain": 200.0, "baseline": 0, "units": "mV", "adc_resolution": 12, "adc_zero": 0, "description": " ".join(rest[5:])}
    out |= wfdb_gain(gain)
    numbers = zip(("adc_resolution", "adc_zero", "initial_value", "checksum", "block_size"), rest[:5], strict=False)
    return out | {k: int(v) for k, v in numbers if v.lstrip("-").isdigit()}


def _sex_word(text: str) -> str:
    return {"M": "M", "MALE": "M", "F": "F", "FEMALE": "F"}.get(text.upper(), "U")


def _whole(text: str) -> int | None:
    return int(text) if text.isdigit() else None


# Names of header comments, the part and field they fill, and how they are read; fields marked * keep their first value.
WFDB_NOTES: dict[str, tuple[str, str, Callable[[str], Any]]] = {
    name: (part, field, read)
    for names, part, field, read in (
        ("id", "patient", "patient_id", str), ("race, ethnicity", "patient", "race", str), ("history, clinical history, clinical_history", "patient", "clinical_history", str),
        ("age", "patient", "age", _whole), ("sex, gender", "patient", "sex", _sex_word), ("height", "patient", "height", decimal), ("weight", "patient", "weight", decimal),
        ("technician", "recording", "technician*", str), ("institution, hospital", "device", "institution*", str), ("device, equipment", "device", "model*", str),
        ("dx, diagnosis, diagnoses", "lists", "statements", str), ("drugs, medication, medications", "lists", "medications", str), ("name", "lists", "names", str),
    )
    for name in names.split(", ")
}


def wfdb_notes(rows: list[str]) -> dict[str, Record]:
    """What the comment lines ``# name: value`` of a header say, by part."""
    out: dict[str, Record] = {"patient": {}, "recording": {}, "device": {}, "lists": {"statements": [], "medications": [], "names": []}}
    for row in rows:
        name, colon, text = row.lstrip("#").partition(":")
        part, field, read = WFDB_NOTES.get(name.strip().lower().removeprefix("patient "), ("", "", str))
        value = read(text.strip()) if text.strip() else None
        if not part or value is None:
            continue
        if part == "lists":
            out[part][field].append(value)
        elif field.endswith("*"):
            out[part].setdefault(field[:-1], value)
        else:
            out[part][field] = value
    return out


def wfdb_header(text: str) -> Record:
    """The header as a sparse record without samples, with ``specs`` for the signals."""
    rows = [x.strip() for x in text.splitlines() if x.strip()]
    lines = [x for x in rows if not x.startswith("#")]
    head = lines[0].split() if lines else []
    if len(head) < 2 or not (count := re.match(r"\d+", head[1])):
        raise CorruptFile("no WFDB record line")
    head += [""] * (6 - len(head))
    rate, n = int(decimal(head[2].split("/")[0]) or 250), int(decimal(head[3]) or 0)
    specs = [wfdb_signal(x) for x in lines[1 : int(count[0]) + 1]]
    clock, day = head[4].split(".")[0].split(":"), head[5].split("/")
    dated = len(day) == 3 and all(x.isdigit() for x in day)
    timed = len(clock) == 3 and all(x.isdigit() for x in clock)
    when = moment(int(day[2]), int(day[1]), int(day[0]), *(map(int, clock) if timed else ())) if dated else None
    notes = wfdb_notes([x for x in rows if x.startswith("#")])
    patient, lists = notes["patient"], notes["lists"]
    if lists["medications"]:
        patient["medications"] = lists["medications"]
    for name in lists["names"]:
        patient["first_name"], _, patient["last_name"] = name.partition(" ")
    first = specs[0] if specs else {"format": 16, "adc_resolution": 12, "adc_zero": 0}
    sig = signal(rate, first["adc_resolution"], f"format_{first['format']}", int(count[0]), 0, signal_offset=first["adc_zero"] or None)
    recording = {**notes["recording"], "date": when, "duration_seconds": n / rate if n and rate else None, "device": notes["device"], "acquisition": {"signal": sig}}
    statements = [{"left_text": x, "right_text": ""} for x in lists["statements"]]
    return {"source_format": "wfdb", "patient": patient, "recording": recording, "interpretation": {"statements": statements}, "specs": specs, "rate": rate, "leads": [], "raw_metadata": {"record_name": head[0], "signal_specs": specs}}


def decode_wfdb(header: bytes, files: dict[str, bytes]) -> Record:
    """``files``: the signal files by name; missing files and other formats than 16 and 212 give no leads."""
    record = wfdb_header(header.decode("ascii", "replace"))
    by_file: dict[str, list[int]] = {}
    for k, s in enumerate(record["specs"]):
        by_file.setdefault(s["filename"], []).append(k)
    for name, own in by_file.items():
        form = record["specs"][own[0]]["format"]
        if name not in files or form not in (16, 212):
            continue
        flat = np.frombuffer(files[name], "<i2", len(files[name]) // 2) if form == 16 else unpack_212(files[name])
        frames = flat[: len(flat) // len(own) * len(own)].reshape(-1, len(own))
        for column, k in enumerate(own):
            s = record["specs"][k]
            gain = s["gain"] or 200.0
            record["leads"].append(lead(frames[:, column].astype(float), s["description"] or f"Ch{k}", record["rate"], 1 / gain, s["units"], -s["baseline"] / gain + 0.0))
    record["recording"]["acquisition"]["signal"]["number_channels_valid"] = len(record["leads"])
    return record


# --- MFER -----------------------------------------------------------------------------------------------------------------


def ber_length(data: bytes, at: int) -> tuple[int, int]:
    """(length, bytes it takes); nothing to read takes 0 bytes."""
    if at >= len(data):
        return 0, 0
    n = data[at] & 0x7F
    if data[at] < 0x80:
        return n, 1
    if n == 0 or at + 1 + n > len(data):
        return 0, 1
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), 1 + n


def mfer_items(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Tags and their values up to the end, a foreign tag or a value that is cut off."""
    at = 0
    while at < len(data) and 0 < data[at] <= 0x7F:
        size, taken = ber_length(data, at + 1)
        at, tag = at + 1 + taken, data[at]
        if at + size > len(data):
            return
        yield tag, data[at : at + size]
        at += size


def _mfer_number(v: bytes, wide: str) -> float:
    return struct.unpack(wide, v[:4])[0] if len(v) >= 4 else struct.unpack(">h", v[:2])[0] if len(v) >= 2 else v[0]


def _mfer_filters(v: bytes) -> Record:
    f = struct.unpack(f">{min(3, len(v) // 4)}f", v[: min(3, len(v) // 4) * 4])
    if len(f) >= 2:
        out = {"highpass": f[0], "lowpass": f[1]}
        return out | ({"notch": f[2], "notch_active": True} if len(f) == 3 and f[2] > 0 else {})
    return {"lowpass": f[0]} if f else {"lowpass": float(struct.unpack(">H", v[:2])[0])} if len(v) >= 2 else {}


# Sample types by code, with their bits and signedness.
MFER_TYPES = {0: ("i2", 16, True, "int16"), 1: ("u2", 16, False, "uint16"), 2: ("i4", 32, True, "int32")}


def decode_mfer(data: bytes) -> Record:
    if len(data) < 4:
        raise CorruptFile("shorter than an MFER item")
    patient: Record = {}
    recording: Record = {"device": {}}
    filters: Record = {}
    meta: Record = {}
    many: dict[str, list] = {"labels": [], "units": [], "comments": [], "events": []}
    big, kind, channels, count, interval, step, block = True, 0, 1, 0, 1000, 1.0, None
    for tag, v in mfer_items(data):
        if tag == 0x09:
            block = v
        if not v:
            continue
        number = int.from_bytes(v, "big")
        match tag:
            case 0x01:
                big = v[0] == 0
            case 0x02:
                kind = v[0]
            case 0x03:
                meta["waveform_type"] = number
            case 0x04:
                interval = _mfer_number(v, ">i")
                interval = interval if interval > 0 else 1000
            case 0x05:
                channels = number or 1
            case 0x06:
                count = number
            case 0x07:
                meta["comment"] = utf8_text(v)
            case 0x08:
                filters |= _mfer_filters(v)
            case 0x0A | 0x0D:
                if text := ascii_text(v):
                    many["labels" if tag == 0x0A else "units"].append(text)
            case 0x0B:
                step = float(_mfer_number(v, ">f"))
            case 0x0C:
                meta["block_info"] = v.hex()
            case 0x31:
                patient["patient_id"] = ascii_text(v)
            case 0x32:
                last, caret, rest = utf8_text(v).partition("^")
                patient["last_name"] = last.strip()
                if caret:
                    patient["first_name"] = rest.split("^")[0].strip()
            case 0x33:
                if len(v) >= 4 and (born := moment(number_at(v), v[2], v[3])):
                    patient["birth_date"] = born
            case 0x34:
                patient["sex"] = SEX_CODES.get(v[0], "U")
            case 0x3F:
                if text := utf8_text(v):
                    many["comments"].append(text)
            case 0x40:
                recording["device"]["institution"] = utf8_text(v)
            case 0x41:
                # one tag for two things: a time where it reads as one, else a department
                when = moment(number_at(v), v[2], v[3], *(v[4:7] if len(v) >= 7 else ())) if len(v) >= 4 and 1900 <= number_at(v) <= 2100 else None
                if when:
                    recording["date"] = when
                elif text := utf8_text(v):
                    recording["device"]["department"] = text
            case 0x44:
                recording["technician"] = utf8_text(v)
            case 0x45:
                many["events"].append({"raw": v.hex(), "description": utf8_text(v)})
    rate = int(1_000_000 / interval)
    form, bits, signed, name = MFER_TYPES.get(kind, MFER_TYPES[0])
    leads = []
    if block is not None:
        items = np.frombuffer(block, (">" if big else "<") + form, len(block) // int(form[1]))
        count = count or len(items) // channels
        if count and len(items) >= count * channels:
            frames = items[: count * channels].reshape(count, channels).astype(float)
            pick = lambda values, k, default: values[k] if k < len(values) else default
            leads = [lead(frames[:, k], pick(many["labels"], k, f"Ch{k + 1}"), rate, step, pick(many["units"], k, "")) for k in range(channels)]
    meta |= {k: many[k] for k in ("comments", "events") if many[k]} | {"big_endian": big, "data_type": kind}
    recording["acquisition"] = {"filters": filters, "signal": signal(rate, bits, name, channels, len(leads), signed=signed)}
    return {"source_format": "mfer", "patient": patient, "recording": with_duration(recording, leads), "leads": leads, "raw_metadata": meta}


def number_at(v: bytes, form: str = ">H") -> int:
    return struct.unpack_from(form, v)[0]


# --- SCP-ECG ----------------------------------------------------------------------------------------------------------------

# Lead names by code.
SCP_LEADS = dict(enumerate("I II V1 V2 V3 V4 V5 V6 III aVR aVL aVF".split()))


def _scp_codes() -> dict[tuple[int, int], int]:
    """The default prefix codes as (width, bits), by rule: n ones, a nil and a sign bit stand for n; a single nil for 0. Fixed values."""
    codes = {(1, 0): 0}
    for n in range(1, 9):
        ones = (1 << n) - 1
        codes[n + 2, ones << 2], codes[n + 2, ones << 2 | 1] = n, -n
    return codes


def _scp_table() -> tuple[np.ndarray, np.ndarray]:
    """Of every ten bits: the width of the code they begin with (0 where there is none), and its number."""
    width, number = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for (w, bits), v in _scp_codes().items():
        lo = bits << (10 - w)
        width[lo : lo + (1 << (10 - w))], number[lo : lo + (1 << (10 - w))] = w, v
    return width, number


def scp_huffman(data: bytes, count: int) -> list[int]:
    """Numbers in the default prefix code; a bit that begins no code is skipped.

    Which code would begin at each bit is looked up for all bits at once; the walk over the codes then only adds widths.
    """
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    total = len(bits)
    ahead = np.concatenate([bits, np.ones(40, np.uint8)]).astype(np.int64)
    ten = np.zeros(total, np.int64)
    for k in range(10):
        ten = ten << 1 | ahead[k : k + total]
    widths, numbers = _scp_table()
    width, number = widths[ten].tolist(), numbers[ten].tolist()
    out, at = [], 0
    while len(out) < count and at < total:
        if (w := width[at]) and at + w <= total:
            out.append(number[at])
            at += w
        elif at + 34 <= total and ten[at] == 1022 and not bits[at + 9 : at + 18].any():
            v = int(np.packbits(bits[at + 18 : at + 34]).view(">u2")[0])
            out.append(v - 65536 if v >= 32768 else v)
            at += 34
        else:
            at += 1
    return out


def undo_differences(values: np.ndarray, order: int) -> np.ndarray:
    """Samples from first or second differences, as running sums; the first values stand as they are."""
    v = np.asarray(values, float)
    if order == 1 or len(v) < 2:
        return np.cumsum(v)
    e = v.copy()
    e[0], e[1] = 0, v[1] - v[0]
    return v[0] + np.cumsum(np.cumsum(e))


def _scp_leads(body: bytes, defs: list[Record], default_codes: bool, median: bool) -> list[Record]:
    if len(body) < 6:
        return []
    step, micros, second, plain = struct.unpack_from("<HHBB", body)
    rate = int(1_000_000 / micros) if micros else 500
    count = len(defs) or 1
    sizes = struct.unpack_from(f"<{min(count, (len(body) - 6) // 2)}H", body, 6)
    at, out = 6 + 2 * len(sizes), []
    for k, size in enumerate(sizes):
        piece = body[at : at + size]
        at += size
        if not piece:
            continue
        n = len(piece) * 4 if median and default_codes else defs[k]["end"] - defs[k]["start"] + 1 if not median and k < len(defs) else len(piece) // 2
        coded = scp_huffman(piece, n) if default_codes and plain == 0 else np.frombuffer(piece, "<i2", min(n, len(piece) // 2))
        nv = float(step) if step > 0 else 1.0
        out.append(lead(undo_differences(coded, 2 if second == 1 else 1), defs[k]["label"] if k < len(defs) else f"Lead{k}", rate, nv / 1000, "uV", adc_resolution=nv, adc_resolution_unit="nV"))
    return out


def _scp_day(v: bytes) -> dt.datetime | None:
    return moment(number_at(v, "<H"), v[2], v[3]) if len(v) >= 4 else None


# Tags of the demographic section that are plain text, with where they go.
SCP_TEXTS = {
    0: ("patient", "last_name"), 1: ("patient", "first_name"), 2: ("patient", "patient_id"), 3: ("meta", "second_last_name"), 13: ("recording", "referring_physician"),
    14: ("interpretation", "interpreter"), 15: ("recording", "technician"), 16: ("recording", "room"), 25: ("patient", "clinical_history"),
}
# Tags that are small numbers, with their exclusive upper bound.
SCP_NUMBERS = {7: ("height", 300), 11: ("age", 200), 12: ("weight", 500)}


def _scp_header(body: bytes) -> Record:
    out: Record = {"patient": {}, "recording": {}, "interpretation": {}, "meta": {}, "device": {}, "filters": {}}
    at, clock = 0, None
    while at + 3 <= len(body):
        tag, size = body[at], number_at(body[at + 1 : at + 3], "<H")
        v = body[at + 3 : at + 3 + size]
        if len(v) < size or tag == 255:
            break
        at += 3 + size
        if not v:
            continue
        text = v.decode("ascii", "replace").strip("\0 ")
        parts = [p.strip() for p in text.split("\0")]
        if tag in SCP_TEXTS:
            group, name = SCP_TEXTS[tag]
            out[group][name] = text
        elif tag in SCP_NUMBERS and size >= 2:
            name, most = SCP_NUMBERS[tag]
            if 0 < number_at(v, "<H") < most:
                out["patient"][name] = number_at(v, "<H")
        elif tag == 5 and (d := _scp_day(v)):
            out["recording"]["date"] = d
        elif tag == 6 and size >= 3:
            clock = v[:3]
        elif tag == 8 and (d := _scp_day(v)):
            out["patient"]["birth_date"] = d
        elif tag == 9:
            out["patient"]["sex"] = SEX_CODES.get(v[0], "U")
        elif tag == 10:
            out["patient"]["medications"] = [p for p in parts if p]
        elif tag == 20:
            out["device"] |= dict(zip(("institution", "department", "serial_number"), parts, strict=False))
        elif tag == 21:
            out["meta"]["analyzing_device"] = dict(zip(("institution", "department", "device_id"), [*parts, "", "", ""], strict=False))
        elif tag == 30:
            if size >= 2:
                out["filters"]["lowpass"] = float(number_at(v, "<H"))
            if size >= 4:
                out["filters"]["highpass"] = number_at(v[2:], "<H") / 100
            if size >= 5 and v[4] in (0, 1, 2):
                out["filters"] |= {"notch": {1: 60.0, 2: 50.0}.get(v[4]), "notch_active": v[4] != 0}
        elif tag == 35:
            out["interpretation"]["statements"] = [{"left_text": p, "right_text": ""} for p in parts if p]
    if clock and out["recording"].get("date"):
        try:
            out["recording"]["date"] = out["recording"]["date"].replace(hour=clock[0], minute=clock[1], second=clock[2])
        except ValueError:
            pass
    return out


def decode_scp(data: bytes) -> Record:
    if len(data) < 16 or data[6] != 0:
        raise CorruptFile("no SCP section 0")
    crc, size = struct.unpack_from("<HI", data)
    (pointers,) = struct.unpack_from("<I", data, 10)
    sections: dict[int, bytes] = {}
    for at in range(22, min(6 + pointers, len(data)) - 9, 10):
        number, length, index = struct.unpack_from("<HII", data, at)
        if length and index:
            sections[number] = data[index - 1 + 16 : index - 1 + length]  # without the section's own header
    head = _scp_header(sections.get(1, b""))
    defs = []
    if body := sections.get(3, b""):
        for k in range(body[0]):
            if 2 + 9 * k + 9 > len(body):
                break
            first, last, code = struct.unpack_from("<IIB", body, 2 + 9 * k)
            defs.append({"start": first, "end": last, "label": SCP_LEADS.get(code, f"Lead{code}")})
    tables = sections.get(2, b"")
    default_codes = number_at(tables, "<H") == 19999 if len(tables) >= 2 else True
    leads = _scp_leads(sections.get(6, b""), defs, default_codes, False)
    meta: Record = {**head["meta"], "crc": crc, "file_size": size, "sections_found": list(sections)}
    if body := sections.get(4, b""):
        n = min(number_at(body, "<H"), (len(body) - 2) // 8) if len(body) >= 2 else 0
        meta["qrs_locations"] = np.frombuffer(body, "<u4", 2 * n, 2).reshape(-1, 2).tolist()
    measured: Record = {}
    if len(body := sections.get(7, b"")) >= 6:
        names = "qrs_count rr_interval heart_rate pr_interval qrs_duration qt_interval qtc_bazett p_axis qrs_axis t_axis".split()
        n = min(10, len(body) // 2)
        for name, v in zip(names, struct.unpack_from("<7H3h"[:3] if n == 7 else "<" + "H" * min(n, 7) + "h" * max(0, n - 7), body), strict=False):
            if name in names[:3] or v not in (0xFFFF, -32768):
                measured[name] = v
    statements = head["interpretation"].get("statements", [])
    if body := sections.get(8, b""):
        own = [{"left_text": s.strip(), "right_text": ""} for s in body[1:].decode("ascii", "replace").split("\0") if s.strip()]
        head["interpretation"]["statements"] = statements + [s for s in own if s not in statements]
        head["interpretation"]["source"] = {1: "confirmed", 0: "machine"}.get(body[0], "")
    form = sections.get(6, b"")
    compression = "huffman" if len(form) >= 6 and form[5] == 0 else "none"
    encoding = {0: "first_difference", 1: "second_difference"}.get(form[4], "raw") if len(form) >= 6 else "raw"
    rate = leads[0]["sampling_rate"] if leads else 0
    recording = {**head["recording"], "device": head["device"], "acquisition": {"filters": head["filters"], "signal": signal(rate, None, encoding, sections.get(3, b"\0")[0], len(leads), compression)}}
    return {
        "source_format": "scp_ecg", "patient": head["patient"], "recording": with_duration(recording, leads), "interpretation": head["interpretation"], "measurements": measured, "leads": leads,
        "median_beats": _scp_leads(sections.get(5, b""), defs, default_codes, True), "raw_metadata": meta,
    }


DECODERS: dict[str, Callable[[bytes], Record]] = {"edf": decode_edf, "ishne_holter": decode_ishne, "mfer": decode_mfer, "scp_ecg": decode_scp}
