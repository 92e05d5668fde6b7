"""Which format a file has, as one Catalyst expression over its first 4096 bytes, in a fixed order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a test may look at.
HEAD = 4096
# Names, descriptions and file extensions of the formats, in order of precedence.
FORMATS = [
    ("beneheart_r12", "Mindray BeneHeart R12", "Mindray BeneHeart R12 XML", [".xml"]),
    ("dicom_waveform", "DICOM Waveform", "DICOM waveform ECG, part 10", [".dcm", ".dicom"]),
    ("edf", "EDF/EDF+", "European Data Format (EDF and EDF+)", [".edf"]),
    ("ge_mac2000", "GE MAC 2000", "GE MAC 2000 XML", [".xml"]),
    ("ge_muse_xml", "GE MUSE XML", "GE MUSE XML export", [".xml"]),
    ("hl7_aecg", "HL7 aECG", "HL7 annotated ECG XML", [".xml"]),
    ("ishne_holter", "ISHNE Holter", "ISHNE Holter binary", [".ecg", ".ann"]),
    ("mfer", "MFER", "Medical waveform Format Encoding Rules", [".mfer", ".mfr"]),
    ("mortara_el250", "Mortara EL250", "Mortara EL250 XML", [".xml"]),
    ("scp_ecg", "SCP-ECG", "Standard Communications Protocol for ECG", [".scp", ".ecg"]),
    ("sierra_xml", "Philips Sierra XML", "Philips Sierra ECG XML", [".xml"]),
    ("wfdb", "WFDB", "WaveForm DataBase header with signal files", [".hea", ".dat"]),
]


def supported_formats(spark: SparkSession) -> DataFrame:
    """(source_format, name, description, extensions)"""
    return spark.createDataFrame(FORMATS, "source_format string, name string, description string, extensions array<string>")


def _byte(head: Column, at: Column | int) -> Column:
    """The unsigned byte at a 0-based place; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    s = F.substring(head, at + 1, F.lit(1))
    return F.when((at >= 0) & (F.length(s) == 1), F.conv(F.hex(s), 16, 10).cast("long"))


def _u32(head: Column, at: int) -> Column:
    return sum((_byte(head, at + k) * (1 << 8 * k) for k in range(1, 4)), _byte(head, at))


def _ber(head: Column, at: Column) -> tuple[Column, Column]:
    """(length, bytes it takes) of a BER length; lengths of over four bytes are too long to be true."""
    first = _byte(head, at)
    n = first - 128
    value = F.conv(F.hex(F.substring(head, (at + 2).cast("int"), F.least(n, F.lit(4)).cast("int"))), 16, 10).cast("long")
    fits = at + 1 + n <= F.length(head)
    length = F.when(first < 128, first).when((first == 128) | ~fits, 0).when(n > 4, 1 << 40).otherwise(value)
    return length, F.when(first.isNull(), 0).when(first < 128, 1).when((first == 128) | ~fits, 1).otherwise(1 + n).cast("long")


def source_format(content: Column, path: Column) -> Column:
    """The format of a file, or null."""
    head = F.substring(content, 1, HEAD)
    text = F.decode(head, "ISO-8859-1")  # tags are ASCII, and every byte is a character
    low = F.lower(text)
    has = lambda *marks: F.lit(False) if not marks else sum((low.contains(m).cast("int") for m in marks), F.lit(0)) > 0
    number = lambda a, n: F.expr("0").cast("int") if n == 0 else F.trim(F.substring(text, a + 1, n))
    integer = lambda s: F.when(s.rlike(r"^[+-]?\d{1,9}$"), s.cast("int"))
    length1, taken1 = _ber(head, F.lit(1).cast("long"))
    second = 1 + taken1 + length1
    length2, taken2 = _ber(head, second + 1)
    tag1, tag2 = _byte(head, 0), _byte(head, F.when(second < HEAD, second).otherwise(-1))
    sure = lambda c: F.coalesce(c, F.lit(False))
    tests = {
        "beneheart_r12": has("<beneheartr12", "<mindrayecg") | (has("<ecgdata") & has("mindray")),
        "dicom_waveform": F.substring(text, 129, 4) == "DICM",
        "edf": (F.length(head) >= 256) & (F.substring(text, 1, 8) == "0       ") & (integer(number(236, 8)) >= -1) & (integer(number(252, 4)) > 0),
        "ge_mac2000": has("<mac2000", "<mac_2000", "<ge_mac", "<macexport"),
        "ge_muse_xml": (has("<restingecg>", "<restingecg ") & ~has("<restingecgdata")) | has("<museinfo"),
        "hl7_aecg": text.contains("<AnnotatedECG"),
        "ishne_holter": F.substring(text, 1, 8).isin("ISHNE1.0", "ANN  1.0"),
        "mfer": (F.length(head) >= 6) & tag1.between(1, 0x1F) & (length1 <= 100_000_000) & (taken1 > 0) & tag2.between(1, 0x7F) & (taken2 > 0) & (length2 <= 100_000_000),
        "mortara_el250": text.contains("<ECG") & (has("mortara") | text.contains("<CHANNEL")),
        "scp_ecg": (F.length(head) >= 16) & _u32(head, 2).between(16, 50_000_000) & (_byte(head, 6) == 0) & (_u32(head, 8) >= 8),
        "sierra_xml": has("<restingecgdata"),
        "wfdb": F.lower(path).endswith(".hea") & text.rlike(r"^\s*\S+[ \t]+\d+"),
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, *_ in FORMATS:
        out = out.when(sure(tests[name]), name)
    return out
