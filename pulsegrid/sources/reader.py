"""ECG files into records and leads: ``binaryFile`` scan, detection in the JVM, decoders over Arrow batches.

Only files whose format is known reach a decoder, and only the wanted formats are decoded (`formats=` filters before it). A file
is decoded in the task that read it, to a nested row; records and leads are projections of it. Only WFDB needs a join, of
headers with the signal files they name: names meet paths first, so no other file's bytes are read for it, let alone shuffled.
A record is named after its whole path, so files of one name in several folders stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import signal as sg
from pulsegrid.sources import binary, dicom, schema, xmlformats
from pulsegrid.sources.detect import source_format

DECODERS = {**binary.DECODERS, **xmlformats.DECODERS, "dicom_waveform": dicom.decode_dicom}


def files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(path, content) of all files under the paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(paths)).select("path", "content")


class Plugin(NamedTuple):
    """A further format: its name, a test over the columns content and path, and a decoder of its bytes."""

    name: str
    test: Callable[[Column, Column], Column]
    decode: Callable[[bytes], dict[str, Any]]


def detect(found: DataFrame, plugins: Sequence[Plugin] = ()) -> DataFrame:
    """(path, content, source_format); further formats come after the built-in ones."""
    content, path = F.col("content"), F.col("path")
    more = [F.when(p.test(content, path), F.lit(p.name)) for p in plugins]
    return found.withColumn("source_format", F.coalesce(source_format(content, path), *more))


#: Samples decoded before a task hands its rows on.
HANDED_ON = 2_000_000


def _signal_parts(found: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` (path, content) of WFDB with ``parts``: the signal files they name in their own folder, where these exist."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    lines = F.filter(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n"), lambda x: x.rlike(r"^\S+\s+\d+"))
    wanted = heads.select("path", F.explode(F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r"^(\S+)", 1)))).alias("name")).withColumn("at", F.concat(folder, "name"))
    parts = wanted.join(found.select(F.col("path").alias("at"), F.col("content").alias("part")), "at").groupBy("path").agg(F.collect_list(F.struct("name", "part")).alias("parts"))
    return heads.join(parts, "path", "left")


def record_name(path: str) -> str:
    """The record of a file: its path without the scheme of a local one."""
    return re.sub(r"^file:/+", "/", path)


def decode(found: DataFrame, mode: str = "FAILFAST", include_samples: bool = True, formats: list[str] | None = None, plugins: Sequence[Plugin] = ()) -> DataFrame:
    """Nested rows of :data:`schema.DECODED` from (path, content).

    FAILFAST raises at the first file that has no known format or is corrupt, PERMISSIVE keeps it as a row with an ``error``.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    known = detect(found, plugins)
    decoders = {**DECODERS, **{p.name: p.decode for p in plugins}}
    # data files are read through the headers that name them, whatever their first bytes look like
    known = known.where("NOT lower(path) LIKE '%.dat'")
    if mode == "PERMISSIVE" or formats:
        known = known.where("source_format IS NOT NULL")
    if formats:
        known = known.where(F.col("source_format").isin(formats))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, content, form, parts in zip(batch.path, batch.content, batch.source_format, batch.parts, strict=True):
                record_id = record_name(path)
                try:
                    if form is None:
                        raise ValueError(f"no known format: {path}")
                    result = binary.decode_wfdb(content, {p["name"]: p["part"] for p in parts} if parts is not None else {}) if form == "wfdb" else decoders[form](content)
                    result.setdefault("raw_metadata", {})["filepath"] = path
                    row = schema.to_row(record_id, path, result, include_samples)
                except Exception as e:
                    if mode == "FAILFAST":
                        raise
                    row = schema.failed_row(record_id, path, form, f"{type(e).__name__}: {e}")
                rows.append(row)
                held += sum(len(x["samples"]) for x in row["leads"])
                if held > HANDED_ON:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows)

    none = F.lit(None).cast("array<struct<name:string,part:binary>>").alias("parts")
    # paths alone are listed without reading a file, so folders without WFDB headers have one scan and no join
    if found.where("lower(path) LIKE '%.hea'").select("path").isEmpty() or (formats and "wfdb" not in formats):
        return known.select("path", "content", "source_format", none).mapInPandas(run, schema.DECODED)
    heads = _signal_parts(found, known.where("source_format = 'wfdb'")).select("path", "content", "source_format", "parts")
    rest = known.where("source_format IS NULL OR source_format <> 'wfdb'").select("path", "content", "source_format", none)
    return rest.mapInPandas(run, schema.DECODED).union(heads.mapInPandas(run, schema.DECODED))


def decode_list(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """The files of a list, with their place in it as ``input_pos`` and in that order."""
    order = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "input_pos int, _p string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    decoded = decode(files(spark, *paths), **options)
    return decoded.join(order, plain(F.col("path")) == plain(F.col("_p"))).drop("_p").orderBy("input_pos")


def records_of(decoded: DataFrame) -> DataFrame:
    return decoded.drop("leads")


def leads_of(decoded: DataFrame, target: str | None = None) -> DataFrame:
    """One row per lead, rhythm leads before median beats; with ``target``, scaled to that voltage unit where possible."""
    leads = decoded.select("record_id", F.inline("leads"))
    return leads if target is None else sg.auto_scale(leads, target)


def to_json(decoded: DataFrame, include_samples: bool = True) -> Column:
    """The record as JSON text without raw metadata; without samples, their counts stay."""
    leads = F.transform("leads", lambda x: x.withField("sample_count", F.size(x["samples"])) if include_samples else x.withField("sample_count", F.size(x["samples"])).dropFields("samples"))
    head = [F.col(c) for c in decoded.columns if c not in ("leads", "raw_metadata", "error", "path")]
    part = lambda kind: F.filter(leads, lambda x: x["kind"] == kind)
    return F.to_json(F.struct(*head, part("rhythm").alias("leads"), part("median").alias("median_beats")))


def _shown(value: Column, kind: T.DataType, depth: int) -> Column:
    """The lines of a value under its name: null where it is empty; structs one step further in, lists in one line."""
    if isinstance(kind, T.StructType):
        lines = [(f.name, _shown(value[f.name], f.dataType, depth + 1), f.dataType) for f in kind]
        body = F.concat_ws("\n", *[F.concat(F.lit("  " * depth + f"{n}:" + ("\n" if isinstance(t, T.StructType) else " ")), x) for n, x, t in lines])
        return F.nullif(body, F.lit(""))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.nullif(F.array_join(F.transform(value, lambda x: F.concat_ws(" / ", *[F.nullif(x[f.name].cast("string"), F.lit("")) for f in kind.elementType])), "; "), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.nullif(F.array_join(value, ", "), F.lit(""))
    if isinstance(kind, T.MapType):
        return F.nullif(F.array_join(F.transform(F.map_entries(value), lambda e: F.concat_ws("=", e["key"], e["value"])), ", "), F.lit(""))
    return F.nullif(value.cast("string"), F.lit(""))


def _clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss, with a fraction only where there is one."""
    whole = F.floor(seconds)
    parts = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.concat(parts, F.when(seconds > whole, F.regexp_replace(F.format_string("%.3f", seconds - whole), "^0|0+$", "")).otherwise(""))


def describe(decoded: DataFrame) -> DataFrame:
    """(record_id, text): a readable description with indented groups; empty fields are left out, durations are clock times."""
    names = ["source_format", "patient", "recording", "interpretation", "measurements", "annotations"]
    parts = []
    for name in names:
        kind = decoded.schema[name].dataType
        value = F.col(name)
        if name == "recording":
            value = value.withField("duration_seconds", _clock(F.col("recording.duration_seconds")))
            kind = T.StructType([T.StructField(f.name, T.StringType() if f.name == "duration_seconds" else f.dataType) for f in kind])
        parts.append(F.concat(F.lit(f"{name}:" + ("\n" if isinstance(kind, T.StructType) else " ")), _shown(value, kind, 1)))
    if "leads" in decoded.columns:
        of = lambda k: F.filter("leads", lambda x: x["kind"] == k)
        for name, k in (("leads", "rhythm"), ("median_beats", "median")):
            parts.append(F.when(F.size(of(k)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.transform(of(k), lambda x: F.concat(x["label"], F.lit(" ("), F.size(x["samples"]).cast("string"), F.lit(")"))), ", "))))
    return decoded.select("record_id", F.concat_ws("\n", *parts).alias("text"))
