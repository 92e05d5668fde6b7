"""Files of every format made from tables, so that queries can decode them and SQL can say what must come out.

A file holds the whole numbers of some leads. Only what the queries compare is written besides: labels, rates and scales.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.common import table

RATE = 500
Leads = list[np.ndarray]


def _padded(text: object, width: int) -> bytes:
    return str(text).ljust(width).encode()


def edf(leads: Leads, rec: int) -> dict[str, bytes]:
    """A tenth of a microvolt a step, set off by one; one block."""
    ns, n = len(leads), len(leads[0])
    columns = [(["EDF I", "EDF II"], 16), ([""] * ns, 80), (["uV"] * ns, 8), (["-3275.8"] * ns, 8), (["3277.7"] * ns, 8), (["-32768"] * ns, 8), (["32767"] * ns, 8), ([""] * ns, 80), ([n] * ns, 8), ([""] * ns, 32)]
    head = _padded(0, 8) + _padded(f"P{rec}", 80) + _padded("", 80) + b"01.12.2310.30.00" + _padded(256 * (ns + 1), 8) + _padded("", 44) + _padded(1, 8) + _padded(n / RATE, 8) + _padded(ns, 4)
    return {"edf": head + b"".join(_padded(v, w) for values, w in columns for v in values) + b"".join(x.astype("<i2").tobytes() for x in leads)}


def ishne(leads: Leads, rec: int) -> dict[str, bytes]:
    """2.5 microvolts a step."""
    h = bytearray(522)
    h[:8] = b"ISHNE1.0"
    struct.pack_into("<H4i", h, 8, 0, 0, leads[0].size * len(leads), 522, 522)
    struct.pack_into("<h", h, 156, len(leads))
    struct.pack_into("<2h", h, 158, 5, 6)
    struct.pack_into("<2h", h, 206, 2500, 2500)
    struct.pack_into("<h", h, 272, RATE)
    return {"ecg": bytes(h) + np.stack(leads, 1).astype("<i2").tobytes()}


def wfdb(leads: Leads, rec: int) -> dict[str, bytes]:
    """Two microvolts a step from a baseline of ten; every other record in 12 bits."""
    form = 16 if rec % 2 else 212
    lines = [f"r{rec} {len(leads)} {RATE} {leads[0].size}"] + [f"r{rec}.dat {form} 500(10)/mV 12 0 0 0 0 {x}" for x in ("I", "II")]
    flat = np.stack(leads, 1).ravel().astype(np.int64)
    if form == 16:
        data = flat.astype("<i2").tobytes()
    else:
        a, b = flat[::2] & 0xFFF, flat[1::2] & 0xFFF
        data = np.stack([a & 255, a >> 8 | (b & 15) << 4, b >> 4], 1).astype(np.uint8).tobytes()
    return {"hea": "\n".join(lines).encode(), "dat": data}


def mfer(leads: Leads, rec: int) -> dict[str, bytes]:
    """Half a microvolt a step; every other record little-endian."""
    little = rec % 2
    data = np.stack(leads, 1).astype("<i2" if little else ">i2").tobytes()
    size = lambda n: bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    items = [(1, bytes([little])), (2, b"\0"), (4, struct.pack(">i", 2000)), (5, bytes([len(leads)])), (6, struct.pack(">H", leads[0].size)), (10, b"I"), (10, b"II"), (11, struct.pack(">f", 0.5)), (13, b"uV"), (13, b"uV"), (9, data)]
    return {"mfer": b"".join(bytes([t]) + size(len(v)) + v for t, v in items)}


def _prefix_coded(numbers: list[int]) -> bytes:
    """Numbers in the default code: n ones, a nil and a sign bit for n up to 8, else nine ones, nine nils and 16 bits."""
    words = ["0" if v == 0 else "1" * abs(v) + ("00" if v > 0 else "01") if abs(v) <= 8 else "1" * 9 + "0" * 9 + f"{v & 0xFFFF:016b}" for v in numbers]
    bits = "".join(words)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def scp(leads: Leads, rec: int) -> dict[str, bytes]:
    """A microvolt a step; by turns first differences, second differences, and either in the prefix code."""
    second, coded = rec % 4 in (1, 3), rec % 4 > 1
    steps = [np.concatenate([x[:2], np.diff(x, 2)]) if second else np.diff(x, prepend=0) for x in leads]
    pieces = [_prefix_coded(d.tolist()) if coded else d.astype("<i2").tobytes() for d in steps]
    three = bytes([len(leads), 0]) + b"".join(struct.pack("<IIB", 0, x.size - 1, k) for k, x in enumerate(leads))
    six = struct.pack("<HHBB", 1000, 2000, int(second), 0 if coded else 1) + b"".join(struct.pack("<H", len(p)) for p in pieces) + b"".join(pieces)
    bodies = {1: b"\xff\0\0", 3: three, 6: six}
    at, pointers = 22 + 10 * len(bodies), b""
    for k, body in bodies.items():
        pointers += struct.pack("<HII", k, 16 + len(body), at + 1)
        at += 16 + len(body)
    zero = bytes([0, 0, 1, 0]) + struct.pack("<I", 16 + len(pointers)) + bytes(8) + pointers
    return {"scp": struct.pack("<HI", 0x2000, at) + zero + b"".join(bytes(16) + b for b in bodies.values())}


def dicom(leads: Leads, rec: int) -> dict[str, bytes]:
    """Two microvolts a step from a baseline of three; by turns with explicit and implicit types, little- and big-endian."""
    kind = rec % 3
    order, explicit = (">" if kind == 2 else "<"), kind != 1

    def element(tag: int, vr: str, value: bytes, plain: bool = False) -> bytes:
        o, typed = ("<", True) if plain else (order, explicit)
        value += (b"\0" if vr in ("OW", "UI", "SQ", "UL", "US") else b" ") * (len(value) % 2)
        head = struct.pack(f"{o}HH", tag >> 16, tag & 0xFFFF)
        if not typed:
            return head + struct.pack(f"{o}I", len(value)) + value
        return head + vr.encode() + (b"\0\0" + struct.pack(f"{o}I", len(value)) if vr in ("OW", "SQ") else struct.pack(f"{o}H", len(value))) + value

    def sequence(tag: int, items: list[bytes]) -> bytes:
        return element(tag, "SQ", b"".join(struct.pack(f"{order}HHI", 0xFFFE, 0xE000, len(i)) + i for i in items))

    syntax = b"1.2.840.10008.1.2" + (b".1", b"", b".2")[kind]
    channels = [sequence(0x003A0208, [element(0x00080104, "LO", x)]) + element(0x003A0210, "DS", b"2") + sequence(0x003A0211, [element(0x00080104, "LO", b"uV")]) + element(0x003A0213, "DS", b"3") for x in (b"Lead I", b"Lead II")]
    wave = element(0x003A0005, "US", struct.pack(f"{order}H", len(leads))) + element(0x003A0010, "UL", struct.pack(f"{order}I", leads[0].size)) + element(0x003A001A, "DS", str(RATE).encode())
    wave += sequence(0x003A0200, channels) + element(0x54001004, "US", struct.pack(f"{order}H", 16)) + element(0x54001006, "CS", b"SS") + element(0x54001010, "OW", np.stack(leads, 1).astype(f"{order}i2").tobytes())
    return {"dcm": bytes(128) + b"DICM" + element(0x00020010, "UI", syntax, True) + element(0x00100020, "LO", f"D{rec}".encode()) + sequence(0x54000100, [wave])}


def _b64(x: np.ndarray) -> str:
    return base64.b64encode(x.astype("<i2").tobytes()).decode()


def hl7(leads: Leads, rec: int) -> dict[str, bytes]:
    """2.5 microvolts a step from an origin of four."""
    rows = "".join(f'<component><sequence><code code="MDC_ECG_LEAD_{x}"/><value><origin value="4" unit="uV"/><scale value="2.5" unit="uV"/><digits>{" ".join(map(str, v.tolist()))}</digits></value></sequence></component>' for x, v in zip(("I", "II"), leads, strict=True))
    time = '<component><sequence><code code="TIME_RELATIVE"/><value><head value="0"/><increment value="0.002" unit="s"/></value></sequence></component>'
    return {"xml": f"<AnnotatedECG><component><series><component><sequenceSet>{time}{rows}</sequenceSet></component></series></component></AnnotatedECG>".encode()}


def mortara(leads: Leads, rec: int) -> dict[str, bytes]:
    """200 steps a millivolt."""
    rows = "".join(f'<CHANNEL NAME="{x}" DURATION="{v.size}" SAMPLE_FREQ="{RATE}" DATA="{_b64(v)}"/>' for x, v in zip(("I", "II"), leads, strict=True))
    return {"xml": f'<ECG><SOURCE MANUFACTURER="MORTARA"/>{rows}<TYPICAL_CYCLE UNITS_PER_MV="200" SAMPLE_FREQ="{RATE}"/></ECG>'.encode()}


def muse(leads: Leads, rec: int) -> dict[str, bytes]:
    """4.88 microvolts a step."""
    rows = "".join(f"<LeadData><LeadID>{x}</LeadID><LeadAmplitudeUnitsPerBit>4.88</LeadAmplitudeUnitsPerBit><WaveFormData>{_b64(v)}</WaveFormData></LeadData>" for x, v in zip(("I", "II"), leads, strict=True))
    return {"xml": f"<RestingECG><Waveform><WaveformType>Rhythm</WaveformType><SampleBase>{RATE}</SampleBase>{rows}</Waveform></RestingECG>".encode()}


def mac2000(leads: Leads, rec: int) -> dict[str, bytes]:
    """2.5 microvolts a step."""
    rows = "".join(f"<LeadData><LeadID>{x}</LeadID><WaveFormData>{_b64(v)}</WaveFormData></LeadData>" for x, v in zip(("I", "II"), leads, strict=True))
    return {"xml": f"<MAC2000><Waveform><SampleBase>{RATE}</SampleBase><LeadAmplitudeUnitsPerBit>2.5</LeadAmplitudeUnitsPerBit>{rows}</Waveform></MAC2000>".encode()}


def beneheart(leads: Leads, rec: int) -> dict[str, bytes]:
    """A microvolt a step."""
    rows = "".join(f'<Lead Name="{x}" Data="{_b64(v)}"/>' for x, v in zip(("I", "II"), leads, strict=True))
    return {"xml": f"<BeneHeartR12><AcquisitionInfo><SampleRate>{RATE}</SampleRate></AcquisitionInfo><Leads>{rows}</Leads></BeneHeartR12>".encode()}


def _packed(raw: bytes, width: int = 10) -> bytes:
    """LZW with codes of fixed width, the most significant bit first; the table is frozen when full."""
    known: dict[bytes, int] = {bytes([k]): k for k in range(256)}
    codes, word = [], b""
    for k in range(len(raw)):
        more = word + raw[k : k + 1]
        if more in known:
            word = more
            continue
        codes.append(known[word])
        if len(known) <= (1 << width) - 2:
            known[more] = len(known)
        word = raw[k : k + 1]
    codes += [known[word]] if word else []
    bits = "".join(f"{c:0{width}b}" for c in codes)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def _xli(x: np.ndarray) -> bytes:
    """A lead as a chunk: what is left of a straight-line prediction, in planes of high and low bytes, packed."""
    left = np.zeros(len(x), np.int64)
    left[:2] = x[:2]
    left[2:-1] = 64 - (x[3:] - 2 * x[2:-1] + x[1:-2])
    planes = left & 0xFFFF
    packed = _packed(bytes((planes >> 8).tolist()) + bytes((planes & 255).tolist()))
    return struct.pack("<ihh", len(packed), 0, int(2 * x[1] - x[0] - x[2])) + packed


def sierra(leads: Leads, rec: int) -> dict[str, bytes]:
    """Limb leads beyond the second are stored as differences; five microvolts a step; every other record packed."""
    packed = rec % 2
    data = b"".join(map(_xli, leads)) if packed else np.concatenate(leads).astype("<i2").tobytes()
    kind, n = "XLI" if packed else "Uncompressed", len(leads)
    signal = f"<signalcharacteristics><samplingrate>{RATE}</samplingrate><resolution>5</resolution><numberchannelsallocated>{len(leads)}</numberchannelsallocated><acquisitiontype>STD-12</acquisitiontype></signalcharacteristics>"
    wave = f'<parsedwaveforms dataencoding="Base64" compression="{kind}" durationperchannel="{leads[0].size * 2}" numberofleads="{n}">{base64.b64encode(data).decode()}</parsedwaveforms>'
    head = "<documentinfo><documenttype>SierraECG</documenttype><documentversion>1.04</documentversion></documentinfo>"
    return {"xml": f"<restingecgdata>{head}<dataacquisition>{signal}</dataacquisition><waveforms>{wave}</waveforms></restingecgdata>".encode()}


#: By format: the writer and how many leads a file has.
WRITERS: dict[str, tuple[Callable[[Leads, int], dict[str, bytes]], int]] = {
    "beneheart_r12": (beneheart, 2), "dicom_waveform": (dicom, 2), "edf": (edf, 2), "ge_mac2000": (mac2000, 2), "ge_muse_xml": (muse, 2), "hl7_aecg": (hl7, 2), "ishne_holter": (ishne, 2), "mfer": (mfer, 2),
    "mortara_el250": (mortara, 2), "scp_ecg": (scp, 2), "sierra_xml": (sierra, 6), "wfdb": (wfdb, 2),
}


def files(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """(path, content): all embeddings as files of a format, each of two (or six) in order of their number."""
    writer, count = WRITERS[form]
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(-2000), F.least(F.lit(2000), F.round(x.cast("double") * 200).cast("int")))).alias("v"))
    e = e.groupBy(F.floor(F.col("vec_id") / count).alias("rec")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("rows")).where(F.size("rows") == count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(rec, writer([np.asarray(r["v"], np.int64) for r in rows], int(rec))) for rec, rows in zip(b.rec, b["rows"], strict=True)]
            yield pd.DataFrame([(f"/made/r{rec}.{ext}", data) for rec, parts in made for ext, data in parts.items()], columns=["path", "content"])

    return e.mapInPandas(run, "path string, content binary")
