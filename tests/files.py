"""Builders of small files in each format."""

import base64
import struct

import numpy as np


def edf(signals=2, blocks=2, n=500, rates=None, annotate=False, cut=0):
    rates = rates or [n] * signals
    labels = [f"EDF ECG {k}" for k in ("I", "II", "III")[:signals]]
    if annotate:
        labels.append("EDF Annotations")
        rates = [*rates, 30]
    ns = len(labels)
    pad = lambda s, w: str(s).ljust(w).encode()
    head = pad("0", 8) + pad("P001 M 15-JUN-1980 Doe_Jane", 80) + pad("Startdate 01-DEC-2023 INV EQ TECH", 80) + b"01.12.23" + b"10.30.00" + pad(256 * (ns + 1), 8) + pad("EDF+C", 44) + pad(blocks, 8) + pad(1, 8) + pad(ns, 4)
    for values, w in ((labels, 16), (["AgCl"] * ns, 80), (["mV"] * ns, 8), ([-3.2] * ns, 8), ([3.2] * ns, 8), ([-32768] * ns, 8), ([32767] * ns, 8), (["HP:0.05Hz LP:150Hz N:50Hz"] * ns, 80), (rates, 8), ([""] * ns, 32)):
        head += b"".join(pad(v, w) for v in values)
    body = b""
    for b in range(blocks):
        for k in range(ns):
            if annotate and k == ns - 1:
                body += b"+0.5\x150.1\x14beat\x14\0".ljust(60, b"\0")
            else:
                body += (np.arange(rates[k]) + 1000 * k + b).astype("<i2").tobytes()
    data = head + body
    return data[: len(data) - cut]


def ishne(count=2, rate=200, n=400):
    h = bytearray(522)
    h[:8] = b"ISHNE1.0"
    struct.pack_into("<H4i", h, 8, 77, 0, count * n, 522, 522)
    h[28:32], h[68:71], h[108:114] = b"Jane", b"Doe", b"ISH001"
    struct.pack_into("<h", h, 128, 2)
    struct.pack_into("<3h", h, 132, 15, 6, 1980)
    struct.pack_into("<3h", h, 138, 1, 12, 2023)
    struct.pack_into("<3h", h, 150, 10, 30, 0)
    struct.pack_into("<h", h, 156, count)
    struct.pack_into("<12h", h, 158, *[5, 6, 7, *[0] * 9])
    struct.pack_into("<12h", h, 206, *[1000] * count, *[0] * (12 - count))
    h[232:236] = b"HOLT"
    struct.pack_into("<h", h, 272, rate)
    s = np.arange(n)
    return bytes(h) + np.stack([(k + 1) * 100 + s % 50 for k in range(count)], 1).astype("<i2").tobytes()


def wfdb(form=16):
    hea = f"rec 2 500 4 10:30:00 01/12/2023\nrec.dat {form} 200(0)/mV 16 0 0 0 0 I\nrec.dat {form} 200(10)/mV 16 0 0 0 0 II\n# Age: 43\n# Sex: M\n# Dx: Sinus rhythm\n# Name: Jane Doe\n"
    v = np.array([[1, -2], [3, 4], [-5, 600], [7, -800]])
    if form == 16:
        return hea.encode(), v.astype("<i2").tobytes(), v
    u = v.ravel() & 0xFFF
    out = bytearray()
    for a, b in zip(u[::2], u[1::2], strict=True):
        out += bytes([int(a) & 255, (int(a) >> 8) | ((int(b) & 15) << 4), int(b) >> 4])
    return hea.encode(), bytes(out), v


def _tlv(tag, value):
    n = len(value)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + value


def mfer(channels=2, n=500):
    s = np.arange(n)
    data = np.stack([(k + 1) * 100 + s % 50 for k in range(channels)], 1).astype(">i2").tobytes()
    items = [(1, b"\0"), (2, b"\0"), (4, struct.pack(">i", 2000)), (5, bytes([channels])), (6, struct.pack(">H", n)), (0x0A, b"I"), (0x0A, b"II"), (0x0D, b"uV"), (0x0D, b"uV")]
    items += [(0x31, b"MFER001"), (0x32, b"Doe^Jane"), (0x33, struct.pack(">HBB", 1980, 6, 15)), (0x34, b"\x02"), (0x41, struct.pack(">HBBBBB", 2023, 12, 1, 10, 30, 0)), (0x41, b"ER"), (9, data)]
    return b"".join(_tlv(t, v) for t, v in items)


def scp(samples=None, second=False, huffman=False, n=500):
    v = samples if samples is not None else [np.arange(n) % 40, np.arange(n) % 25]
    pieces = []
    for x in v:
        d = np.concatenate([x[:1], np.diff(x)]) if not second else np.concatenate([x[:2], np.diff(x, 2)])
        if huffman:
            bits = ""
            for k in d.tolist():
                bits += "0" if k == 0 else ("1" * abs(k) + ("00" if k > 0 else "01")) if abs(k) <= 8 else "1" * 9 + "0" * 9 + f"{k & 0xFFFF:016b}"
            bits += "0" * (-len(bits) % 8)
            pieces.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
        else:
            pieces.append(d.astype("<i2").tobytes())
    text = lambda tag, s: bytes([tag]) + struct.pack("<H", len(s)) + s
    one = text(0, b"TestSCP") + text(2, b"SCP001") + text(9, b"\x01") + text(8, struct.pack("<HBB", 1980, 6, 15)) + text(5, struct.pack("<HBB", 2023, 12, 1)) + text(6, bytes([10, 30, 5])) + text(35, b"Sinus rhythm\0Normal") + text(255, b"")
    three = bytes([len(v), 0]) + b"".join(struct.pack("<IIB", 0, len(x) - 1, k) for k, x in enumerate(v))
    six = struct.pack("<HHBB", 1000, 2000, 1 if second else 0, 0 if huffman else 1) + b"".join(struct.pack("<H", len(p)) for p in pieces) + b"".join(pieces)
    bodies = {1: one, 3: three, 6: six, 7: struct.pack("<7H3h", 12, 800, 75, 160, 0xFFFF, 400, 420, 10, -32768, 30), 8: b"\x01Sinus rhythm\0Extra\0"}
    at = 6 + 16 + 10 * len(bodies)
    pointers, out = b"", b""
    for k, b in bodies.items():
        pointers += struct.pack("<HII", k, 16 + len(b), at + 1)
        out += bytes(16) + b
        at += 16 + len(b)
    zero = b"\0\0" + struct.pack("<HI", 0, 16 + len(pointers)) + bytes(8) + pointers
    zero = bytes([0, 0]) + struct.pack("<I", 16 + len(pointers))[:0] + zero[2:]
    size = 6 + 16 + len(pointers) + len(out)
    section0 = bytes([0, 0, 1, 0]) + struct.pack("<I", 16 + len(pointers)) + bytes(8) + pointers
    return struct.pack("<HI", 0x2000, size) + section0 + out


def b64(values):
    return base64.b64encode(np.array(values, "<i2").tobytes()).decode()


def hl7(series=1, scale=True):
    seq = lambda code, body: f'<component><sequence><code code="{code}"/>{body}</sequence></component>'
    sc = '<origin value="0" unit="uV"/><scale value="2.5" unit="uV"/>' if scale else ""
    parts = seq("TIME_RELATIVE", '<value><head value="0"/><increment value="0.002" unit="s"/></value>') + seq("MDC_ECG_LEAD_I", f"<value>{sc}<digits>100 200 300</digits></value>") + seq("MDC_ECG_LEAD_AVR", f"<value>{sc}<digits>110 210 310</digits></value>") + seq("MDC_OTHER", "<value><digits>1</digits></value>")
    one = f"<component><series><component><sequenceSet>{parts}</sequenceSet></component></series></component>"
    note = '<subjectOf><annotationSet><component><annotation><code code="MDC_ECG_HEART_RATE"/><value value="71.6"/></annotation></component></annotationSet></subjectOf>'
    person = '<subject><trialSubject><id extension="HL7001"/><subjectDemographicPerson><name><family>Doe</family><given>Jane</given></name><administrativeGenderCode code="F"/><birthTime value="19800101"/></subjectDemographicPerson></trialSubject></subject>'
    return f'<?xml version="1.0"?><AnnotatedECG xmlns="urn:hl7-org:v3"><effectiveTime><low value="20230615103000"/><high value="20230615103010"/></effectiveTime>{person}{one * series}{note}</AnnotatedECG>'.encode()


def mortara():
    ch = "".join(f'<CHANNEL NAME="{n}" DURATION="5000" SAMPLE_FREQ="500" DATA="{b64([100, 50])}"/>' for n in ("I", "II"))
    return f'<ECG ACQUISITION_TIME="20231201103000" VENT_RATE="75" NUM_QRS="12"><SOURCE MANUFACTURER="MORTARA" MODEL="EL250" LOW_PASS_FILTER="150"/><DEMOGRAPHIC_FIELDS><DEMOGRAPHIC_FIELD LABEL="Last:" VALUE="Doe"/><DEMOGRAPHIC_FIELD LABEL="ID:" VALUE="PAT001"/><DEMOGRAPHIC_FIELD LABEL="Age:" VALUE="33"/><DEMOGRAPHIC_FIELD LABEL="Sex:" VALUE="M"/><DEMOGRAPHIC_FIELD LABEL="DOB:" VALUE="19900515"/></DEMOGRAPHIC_FIELDS>{ch}<TYPICAL_CYCLE UNITS_PER_MV="200" SAMPLE_FREQ="500" QRS_DURATION="90"><TYPICAL_CYCLE_CHANNEL NAME="I" DATA="{b64([1, 2])}"/></TYPICAL_CYCLE></ECG>'.encode()


def muse():
    ld = "".join(f"<LeadData><LeadID>{n}</LeadID><LeadAmplitudeUnitsPerBit>4.88</LeadAmplitudeUnitsPerBit><WaveFormData>{b64([100, 50])}</WaveFormData></LeadData>" for n in ("I", "II"))
    return f"<RestingECG><PatientDemographics><PatientID>MUSE001</PatientID><PatientLastName>Smith</PatientLastName><Gender>FEMALE</Gender><PatientAge>38</PatientAge><DateofBirth>03-20-1985</DateofBirth></PatientDemographics><TestDemographics><AcquisitionDate>12-01-2023</AcquisitionDate><AcquisitionTime>10:30:00</AcquisitionTime></TestDemographics><RestingECGMeasurements><VentricularRate>72</VentricularRate><QRSDuration>88</QRSDuration></RestingECGMeasurements><Diagnosis><DiagnosisStatement><StmtText>Normal sinus rhythm</StmtText></DiagnosisStatement></Diagnosis><Waveform><WaveformType>Rhythm</WaveformType><SampleBase>500</SampleBase>{ld}</Waveform><Waveform><WaveformType>Median</WaveformType>{ld}</Waveform></RestingECG>".encode()


def mac2000():
    ld = "".join(f"<LeadData><LeadID>{n}</LeadID><WaveFormData>{b64([100, 50])}</WaveFormData></LeadData>" for n in ("I", "II"))
    return f"<MAC2000><PatientDemographics><PatientID>MAC001</PatientID><PatientLastName>Builder</PatientLastName><Gender>M</Gender><PatientAge>45</PatientAge><DateofBirth>07/22/1978</DateofBirth></PatientDemographics><Waveform><SampleBase>500</SampleBase><LeadAmplitudeUnitsPerBit>2.5</LeadAmplitudeUnitsPerBit>{ld}</Waveform><Measurements><VentricularRate>68</VentricularRate><QRSDuration>92</QRSDuration></Measurements></MAC2000>".encode()


def beneheart():
    ld = "".join(f'<Lead Name="{n}" Data="{b64([100, 50])}"/>' for n in ("I", "II"))
    return f"<BeneHeartR12><PatientInfo><PatientID>BH001</PatientID><LastName>Wonder</LastName><FirstName>Alice</FirstName><Sex>F</Sex><Age>31</Age><DateOfBirth>19920320</DateOfBirth></PatientInfo><AcquisitionInfo><SampleRate>500</SampleRate></AcquisitionInfo><Leads>{ld}</Leads></BeneHeartR12>".encode()


def _lzw_pack(raw, width=10):
    table, word, codes = {bytes([k]): k for k in range(256)}, b"", []
    for b in raw:
        if word + bytes([b]) in table:
            word += bytes([b])
        else:
            codes.append(table[word])
            if len(table) <= (1 << width) - 2:
                table[word + bytes([b])] = len(table)
            word = bytes([b])
    codes.append(table[word])
    bits = "".join(f"{c:0{width}b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def xli_chunk(x):
    """One lead as its packed chunk: the inverse of the recurrence of the decoder."""
    x = np.asarray(x, int)
    d = np.zeros(len(x), int)
    d[:2] = x[:2]
    first = int(2 * x[1] - x[0] - x[2])
    last = 2 * x[2:] * 0
    for i in range(3, len(x)):
        d[i - 1] = 2 * x[i - 1] - x[i - 2] - x[i] + 64
    del last
    u = d & 0xFFFF
    packed = _lzw_pack(bytes((u >> 8).tolist()) + bytes((u & 255).tolist()))
    return struct.pack("<ihh", len(packed), 0, first) + packed


def sierra(leads, packing="Uncompressed", version="1.03"):
    data = b"".join(xli_chunk(x) for x in leads) if packing == "XLI" else np.concatenate(leads).astype("<i2").tobytes()
    n = len(leads[0])
    return (
        f'<?xml version="1.0"?><restingecgdata status="confirmed"><documentinfo><documenttype>SierraECG</documenttype><documentversion>{version}</documentversion></documentinfo>'
        f'<patient><generalpatientdata><patientid>S001</patientid><MRN>M9</MRN><pacestatus>none</pacestatus><lastname>Doe</lastname><age><years>40</years></age><sex>F</sex><lb>150</lb></generalpatientdata></patient>'
        f'<dataacquisition date="2023-12-01" time="10:30:00" statflag="true"><machine machineid="M1" detaildescription="Philips:123:1">PageWriter</machine><signalcharacteristics><samplingrate>500</samplingrate><resolution>5</resolution><numberchannelsallocated>{len(leads)}</numberchannelsallocated><acquisitiontype>STD-12</acquisitiontype></signalcharacteristics></dataacquisition>'
        f'<interpretations><interpretation date="2023-12-01" time="10:31:00"><severity code="AB">- ABNORMAL ECG -</severity><statement><statementcode>SR</statementcode><leftstatement>Sinus</leftstatement><rightstatement>rate 70</rightstatement></statement></interpretation></interpretations>'
        f'<waveforms><parsedwaveforms dataencoding="Base64" compression="{packing}" durationperchannel="{n * 2}" numberofleads="{len(leads)}">{base64.b64encode(data).decode()}</parsedwaveforms></waveforms></restingecgdata>'
    ).encode()


def dicom(channels=2, n=100):
    def el(tag, vr, value):
        value += b"\0" * (len(value) % 2) if vr in ("OW", "UI", "OB") else b" " * (len(value) % 2)
        head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode()
        return head + (b"\0\0" + struct.pack("<I", len(value)) if vr in ("OB", "OW", "SQ", "UT", "UN") else struct.pack("<H", len(value))) + value

    def seq(tag, items):
        return el(tag, "SQ", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items))

    s = np.arange(n)
    data = np.stack([(k + 1) * 100 + s % 50 for k in range(channels)], 1).astype("<i2").tobytes()
    defs = [seq(0x003A0208, [el(0x00080104, "LO", f"Lead {x}".encode())]) + el(0x003A0210, "DS", b"2.0") + seq(0x003A0211, [el(0x00080104, "LO", b"uV")]) + el(0x003A0213, "DS", b"1") for x in ("I", "II")[:channels]]
    wave = el(0x003A0005, "US", struct.pack("<H", channels)) + el(0x003A0010, "UL", struct.pack("<I", n)) + el(0x003A001A, "DS", b"500") + seq(0x003A0200, defs) + el(0x54001004, "US", struct.pack("<H", 16)) + el(0x54001006, "CS", b"SS") + el(0x54001010, "OW", data)
    body = el(0x00020010, "UI", b"1.2.840.10008.1.2.1") + el(0x00080020, "DA", b"20231201") + el(0x00080030, "TM", b"103000") + el(0x00100010, "PN", b"Doe^John") + el(0x00100020, "LO", b"DCM001") + el(0x00100040, "CS", b"M") + el(0x00101020, "DS", b"1.8")
    note = seq(0x0040A043, [el(0x00080100, "SH", b"MDC_ECG_HEART_RATE")]) + el(0x0040A30A, "DS", b"72")
    return bytes(128) + b"DICM" + body + seq(0x0040B020, [note]) + seq(0x54000100, [wave])
