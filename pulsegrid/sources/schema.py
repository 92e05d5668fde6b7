"""The record and lead schemas, and how a decoder's sparse result fills them."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import types as T

_STR = ("patient_id", "first_name", "last_name", "sex", "race", "clinical_history")
PATIENT = T.StructType([
    *[T.StructField(c, T.StringType()) for c in _STR], T.StructField("birth_date", T.TimestampNTZType()), T.StructField("age", T.IntegerType()),
    T.StructField("weight", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("medications", T.ArrayType(T.StringType())),
])
DEVICE = T.StructType([T.StructField(c, T.StringType()) for c in "manufacturer model name serial_number software_version institution department acquisition_type".split()])
SIGNAL = T.StructType([
    T.StructField("sampling_rate", T.IntegerType()), T.StructField("resolution", T.DoubleType()), T.StructField("bits_per_sample", T.IntegerType()), T.StructField("signal_offset", T.IntegerType()),
    T.StructField("signal_signed", T.BooleanType()), T.StructField("number_channels_allocated", T.IntegerType()), T.StructField("number_channels_valid", T.IntegerType()),
    T.StructField("electrode_placement", T.StringType()), T.StructField("compression", T.StringType()), T.StructField("data_encoding", T.StringType()), T.StructField("acsetting", T.IntegerType()),
    T.StructField("filtered", T.BooleanType()), T.StructField("downsampled", T.BooleanType()), T.StructField("upsampled", T.BooleanType()), T.StructField("waveform_modified", T.BooleanType()),
    T.StructField("downsampling_method", T.StringType()), T.StructField("upsampling_method", T.StringType()),
])
FILTERS = T.StructType([
    T.StructField("highpass", T.DoubleType()), T.StructField("lowpass", T.DoubleType()), T.StructField("notch", T.DoubleType()),
    T.StructField("notch_active", T.BooleanType()), T.StructField("artifact_filter", T.BooleanType()),
])
RECORDING = T.StructType([
    T.StructField("date", T.TimestampNTZType()), T.StructField("end_date", T.TimestampNTZType()), T.StructField("duration_seconds", T.DoubleType()), T.StructField("technician", T.StringType()),
    T.StructField("referring_physician", T.StringType()), T.StructField("room", T.StringType()), T.StructField("location", T.StringType()), T.StructField("device", DEVICE),
    T.StructField("acquisition", T.StructType([T.StructField("signal", SIGNAL), T.StructField("filters", FILTERS)])),
])
INTERPRETATION = T.StructType([
    T.StructField("statements", T.ArrayType(T.StructType([T.StructField("left_text", T.StringType()), T.StructField("right_text", T.StringType())]))),
    T.StructField("severity", T.StringType()), T.StructField("source", T.StringType()), T.StructField("interpreter", T.StringType()), T.StructField("interpretation_date", T.TimestampNTZType()),
])
MEASUREMENT_NAMES = "heart_rate rr_interval pr_interval qrs_duration qt_interval qtc_bazett qtc_fridericia p_axis qrs_axis t_axis qrs_count".split()
MEASUREMENTS = T.StructType([T.StructField(c, T.IntegerType()) for c in MEASUREMENT_NAMES])
LEAD = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("lead_no", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("samples", T.ArrayType(T.DoubleType())),
    T.StructField("sampling_rate", T.IntegerType()), T.StructField("resolution", T.DoubleType()), T.StructField("resolution_unit", T.StringType()), T.StructField("offset_value", T.DoubleType()),
    T.StructField("units", T.StringType()), T.StructField("is_raw", T.BooleanType()), T.StructField("adc_resolution", T.DoubleType()), T.StructField("adc_resolution_unit", T.StringType()),
    T.StructField("quality", T.IntegerType()), T.StructField("transducer", T.StringType()), T.StructField("prefiltering", T.StringType()), T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
])
DECODED = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("source_format", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("patient", PATIENT), T.StructField("recording", RECORDING), T.StructField("interpretation", INTERPRETATION), T.StructField("measurements", MEASUREMENTS),
    T.StructField("annotations", T.MapType(T.StringType(), T.StringType())), T.StructField("raw_metadata", T.StringType()), T.StructField("leads", T.ArrayType(LEAD)),
])

_LEAD_DEFAULTS = {"resolution": 1.0, "offset_value": 0.0, "adc_resolution": 0.0, "is_raw": False, "sampling_rate": 0}


class FileError(ValueError):
    """A file that cannot be read."""


class CorruptFile(FileError):
    """The bytes are no complete file of their format."""


class Unsupported(FileError):
    """A variant of the format that is not read."""


class MissingElement(CorruptFile):
    """An element the format requires is not there."""


class ChecksumMismatch(CorruptFile):
    """The bytes do not have the checksum the file states."""


def fill(schema: T.StructType, values: dict[str, Any] | None) -> dict[str, Any]:
    """All fields of a struct: what a decoder found, empty text and empty lists for what it did not, else null."""
    values = values or {}
    out = {}
    for f in schema:
        v = values.get(f.name)
        if isinstance(f.dataType, T.StructType):
            v = fill(f.dataType, v)
        elif v is None and isinstance(f.dataType, T.StringType):
            v = ""
        elif v is None and isinstance(f.dataType, T.ArrayType):
            v = []
        elif v is None and isinstance(f.dataType, T.MapType):
            v = {}
        elif v is not None and isinstance(f.dataType, T.IntegerType):
            v = int(v)
        elif v is not None and isinstance(f.dataType, T.DoubleType):
            v = float(v)
        out[f.name] = v
    return out


def lead(samples: Any, label: str, rate: int, resolution: float = 1.0, unit: str = "", offset: float = 0.0, raw: bool | None = None, kind: str = "rhythm", **more: Any) -> dict[str, Any]:
    """A lead; it is raw unless its resolution is 1 and its offset nil, and a physical one carries its unit."""
    raw = not (resolution == 1.0 and offset == 0.0) if raw is None else raw
    return {"label": label, "samples": samples, "sampling_rate": rate, "resolution": resolution, "resolution_unit": unit, "offset_value": offset, "units": "" if raw else unit, "is_raw": raw, "kind": kind, **more}


def to_row(record_id: str, path: str, found: dict[str, Any], include_samples: bool = True) -> dict[str, Any]:
    """A row of DECODED from a decoder's result."""
    leads = []
    for k, x in enumerate([*found.get("leads", []), *[{**b, "kind": "median"} for b in found.get("median_beats", [])]]):
        row = fill(LEAD, {**_LEAD_DEFAULTS, **x, "lead_no": k, "samples": None})
        row["samples"] = [float(v) for v in x["samples"]] if include_samples else []
        leads.append(row)
    meta = json.dumps(found.get("raw_metadata", {}), default=lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else str(v))
    return {
        "record_id": record_id, "path": path, "source_format": found["source_format"], "error": None, "patient": fill(PATIENT, found.get("patient")), "recording": fill(RECORDING, found.get("recording")),
        "interpretation": fill(INTERPRETATION, found.get("interpretation")), "measurements": fill(MEASUREMENTS, found.get("measurements")),
        "annotations": {k: str(v) for k, v in found.get("annotations", {}).items()}, "raw_metadata": meta, "leads": leads,
    }


def failed_row(record_id: str, path: str, source_format: str | None, error: str) -> dict[str, Any]:
    """A row for a file that could not be decoded."""
    return {**{f.name: None for f in DECODED}, "record_id": record_id, "path": path, "source_format": source_format, "error": error, "leads": [], "annotations": {}}


def with_duration(recording: dict[str, Any], leads: list[dict[str, Any]]) -> dict[str, Any]:
    """Adds the duration of the first lead."""
    if leads and leads[0]["sampling_rate"] > 0:
        recording["duration_seconds"] = len(leads[0]["samples"]) / leads[0]["sampling_rate"]
    return recording


def signal(rate: int, bits: int | None, encoding: str, allocated: int, valid: int, compression: str = "none", signed: bool | None = True, **more: Any) -> dict[str, Any]:
    return {"sampling_rate": rate, "bits_per_sample": bits, "data_encoding": encoding, "number_channels_allocated": allocated, "number_channels_valid": valid, "compression": compression, "signal_signed": signed, **more}
