"""What the plots show, as rows: placement, markers, ellipses, summaries and a report. Drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import arrow
from pulsegrid.operators import signal as sg

# Rows and columns of the printed 12-lead sheet, paper speed and gain.
SHEET = [["I", "aVR", "V1", "V4"], ["II", "aVL", "V2", "V5"], ["III", "aVF", "V3", "V6"]]
MM_PER_SECOND, MM_PER_MILLIVOLT = 25.0, 10.0
# Colours of the leads and of any other, and the paper's steps (large and small) in seconds and millivolts.
LEAD_COLOURS = dict(zip(sg.STANDARD_12, "#1f77b4 #ff7f0e #2ca02c #d62728 #9467bd #8c564b #e377c2 #7f7f7f #bcbd22 #17becf #1a9850 #d73027".split(), strict=True))
OTHER_COLOUR = "#333333"
PAPER_STEPS = {"x": (0.2, 0.04), "y": (0.5, 0.1)}
#: Small steps of an axis from which the paper grid gives way to round steps; peaks, statements and leads that a sheet has room for.
MOST_STEPS, SHOWN_PEAKS, SHOWN_STATEMENTS, SHOWN_LEADS = 500, 20, 3, 12


def lead_grid(leads: DataFrame, columns: int) -> DataFrame:
    """Leads in their order, in ``row`` and ``col`` of a grid so many columns wide."""
    k = F.row_number().over(W.partitionBy("record_id").orderBy("lead_no")) - 1
    return leads.withColumn("_k", k).withColumns({"row": F.floor(F.col("_k") / columns).cast("int"), "col": (F.col("_k") % columns).cast("int")}).drop("_k")


def sheet_12(leads: DataFrame, seconds: float = 10.0) -> DataFrame:
    """(record_id, row, col, label, samples, sampling_rate): every slot of the sheet, empty where the record has no such lead.

    Samples are cut to the first ``seconds``; a rhythm strip of lead II is row 3.
    """
    slots = [(r, c, x) for r, row in enumerate(SHEET) for c, x in enumerate(row)] + [(3, 0, "II")]
    by = leads.groupBy("record_id").agg(*[F.min_by(F.when(F.lower("label") == x.lower(), F.struct("samples", "sampling_rate")), F.when(F.lower("label") == x.lower(), F.col("lead_no"))).alias(x) for x in sg.STANDARD_12])
    cut = lambda x: F.slice(F.col(f"{x}.samples"), 1, F.greatest(F.lit(0), (F.col(f"{x}.sampling_rate") * seconds).cast("int")))
    rows = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(x).alias("label"), F.when(F.col(x).isNotNull(), cut(x)).alias("samples"), F.col(f"{x}.sampling_rate").alias("sampling_rate")) for r, c, x in slots]
    return by.select("record_id", F.inline(F.array(*rows)))


def on_paper(t: Column, v_mv: Column) -> tuple[Column, Column]:
    """Seconds and millivolts as millimetres on paper."""
    return t * MM_PER_SECOND, v_mv * MM_PER_MILLIVOLT


def lead_colour(label: Column) -> Column:
    """The colour of a lead by its label."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEAD_COLOURS.items() for x in kv]), label), F.lit(OTHER_COLOUR))


def sample_axis(samples: Column) -> Column:
    """Sample numbers from 1, for leads without a rate; empty for empty leads."""
    n = F.size(samples)
    return F.when(n > 0, F.sequence(F.lit(1), n)).when(samples.isNotNull(), F.array().cast("array<int>"))


def paper_steps(span: Column, axis: str) -> Column:
    """struct<major, minor>: grid steps of an axis (``x`` seconds, ``y`` millivolts) of some span.

    These are the paper's, unless its small steps would be MOST_STEPS or more, as with samples in steps of a converter; then
    the large step is the power of ten, or twice or five times it, that parts the span into at most ten, with a fifth as the
    small one.
    """
    large, small = PAPER_STEPS[axis]
    tenth = span / 10
    power = F.pow(F.lit(10.0), F.floor(F.log10(tenth)))
    round_ = F.when(tenth <= power, power).when(tenth <= 2 * power, 2 * power).when(tenth <= 5 * power, 5 * power).otherwise(10 * power)
    own = F.struct(F.lit(large).alias("major"), F.lit(small).alias("minor"))
    return F.when(span / small < MOST_STEPS, own).when(span.isNotNull(), F.struct(round_.alias("major"), (round_ / 5).alias("minor")))


def peak_markers(leads: DataFrame, *keys: str) -> DataFrame:
    """(keys, beat_no, t, v, rr_ms, hr): peaks with the interval and rate that end there, from samples, sampling_rate and peaks.

    A sheet labels the first SHOWN_PEAKS: those of a lower ``beat_no``.
    """
    df = leads.select(*keys, "samples", "sampling_rate", F.posexplode("peaks").alias("beat_no", "p"))
    df = df.withColumns({"t": F.col("p") / F.col("sampling_rate"), "v": F.get("samples", F.col("p"))})
    rr = (F.col("p") - F.lag("p").over(W.partitionBy(*keys).orderBy("beat_no"))) * (F.lit(1000.0) / F.col("sampling_rate"))
    return df.withColumn("rr_ms", rr).select(*keys, "beat_no", "t", "v", "rr_ms", F.try_divide(F.lit(60000.0), F.col("rr_ms")).alias("hr"))


def poincare_ellipse(measures: DataFrame, key: str, centre: str = "mean_rr", points: int = 100) -> DataFrame:
    """(key, i, x, y): the ellipse of sd1 and sd2 around the mean, turned by 45 degrees."""
    a = F.col("i") * (2 * math.pi / (points - 1))
    df = measures.select(key, centre, "sd1", "sd2", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    u, v = F.col("sd2") * F.cos(a), F.col("sd1") * F.sin(a)
    return df.select(key, "i", (F.col(centre) + (u - v) / math.sqrt(2)).alias("x"), (F.col(centre) + (u + v) / math.sqrt(2)).alias("y"))


def hrv_summary(rr: DataFrame, key: str) -> DataFrame:
    """One row per key with the measures of the summary sheet; one shuffle serves both, as they share their key."""
    return sg.hrv_time_domain(rr, key).join(sg.hrv_poincare(rr, key), key).select(key, "mean_rr", "sdnn", "rmssd", "pnn50", "hr_mean", "sd1", "sd2")


def hrv_bands(rr: DataFrame, key: str) -> DataFrame:
    """(key, band, low, high, power): the bands of the summary sheet's spectrum, from all intervals of each key in order.

    The intervals of one key are one array: those of one recording.
    """
    series = rr.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("beat_no", "rr_ms"))), lambda x: x["rr_ms"]).alias("rr"))
    edges = [("vlf", 0.0, 0.04), ("lf", 0.04, 0.15), ("hf", 0.15, 0.4)]
    h = series.select(key, arrow.hrv_frequency(F.col("rr")).alias("h"))
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"h.{n}_power").alias("power")) for n, a, b in edges])
    return h.select(key, F.inline(bands))


def _filled(c: str) -> Column:
    """A text field, null where it is empty."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def _statements(most: int | None = None) -> Column:
    """The statements as texts, each its left and right part with a blank between."""
    s = F.col("interpretation.statements")
    texts = F.transform(s if most is None else F.slice(s, 1, most), lambda x: F.trim(F.concat_ws(" ", x["left_text"], F.nullif(x["right_text"], F.lit("")))))
    return F.when(F.size(s) > 0, texts)


def record_header(records: DataFrame) -> DataFrame:
    """(record_id, header): the sheet's lines on patient, recording, device, measurements and the first statements.

    What is null or empty is left out; a record without any of it is headed ``ECG report``.
    """
    named = lambda label, c: F.concat(F.lit(label), c)
    line = lambda by, *parts: F.nullif(F.concat_ws(by, *parts), F.lit(""))
    date = F.date_format("recording.date", "yyyy-MM-dd HH:mm") if isinstance(records.schema["recording"].dataType["date"].dataType, T.TimestampNTZType | T.TimestampType) else _filled("recording.date")
    rate = F.col("recording.acquisition.signal.sampling_rate")
    measured = [("HR: ", "heart_rate", " bpm"), ("PR: ", "pr_interval", " ms"), ("QRS: ", "qrs_duration", " ms"), ("QT: ", "qt_interval", " ms"), ("QTc: ", "qtc_bazett", " ms"), ("Axis: ", "qrs_axis", "\u00b0")]
    lines = [
        named("Name: ", line(" ", _filled("patient.first_name"), _filled("patient.last_name"))), named("ID: ", _filled("patient.patient_id")),
        line("  ", named("Age: ", F.col("patient.age").cast("string")), named("Sex: ", _filled("patient.sex"))), named("Date: ", date),
        F.when(rate != 0, F.concat(F.lit("Sample rate: "), rate.cast("string"), F.lit(" Hz"))), named("Device: ", line(" ", _filled("recording.device.manufacturer"), _filled("recording.device.model"))),
        line("  |  ", *[F.concat(F.lit(a), F.col(f"measurements.{c}").cast("string"), F.lit(b)) for a, c, b in measured]), named("Interpretation: ", F.array_join(_statements(SHOWN_STATEMENTS), "; ")),
    ]
    return records.select("record_id", F.coalesce(line("\n", *lines), F.lit("ECG report")).alias("header"))


def interpretation_text(records: DataFrame) -> DataFrame:
    """(record_id, text): severity, source and all statements, a line each."""
    lines = F.concat_ws("\n", F.concat(F.lit("Severity: "), _filled("interpretation.severity")), F.concat(F.lit("Source: "), _filled("interpretation.source")), F.array_join(F.transform(_statements(), lambda x: F.concat(F.lit("- "), x)), "\n"))
    some = _filled("interpretation.severity").isNotNull() | (F.coalesce(F.size("interpretation.statements"), F.lit(0)) > 0)
    return records.select("record_id", F.when(some, lines).otherwise(F.concat_ws("\n", F.nullif(lines, F.lit("")), F.lit("No interpretation available"))).alias("text"))


def quality_text(leads: DataFrame) -> DataFrame:
    """(record_id, text): score and class of the first SHOWN_LEADS rhythm leads of each record, a line each."""
    n = F.row_number().over(W.partitionBy("record_id").orderBy("lead_no"))
    rows = leads.select("record_id", "lead_no", "label", "samples", "sampling_rate").withColumn("n", n).where(F.col("n") <= SHOWN_LEADS)
    sqi = rows.select("record_id", "n", "label", arrow.quality(F.col("samples"), F.col("sampling_rate"))["sqi"].alias("sqi"))
    text = F.concat(F.lpad(F.coalesce("label", F.lit("")), 5, " "), F.lit(": "), F.format_string("%.2f", "sqi"), F.lit(" ("), sg.quality_class(F.col("sqi")), F.lit(")"))
    return sqi.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("a")).select("record_id", F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("text"))


def report(records: DataFrame, leads: DataFrame) -> DataFrame:
    """The report sheet of each record, a row for each of its parts.

    (record_id, part, row, col, label, colour, text, samples, sampling_rate): the header; the twelve slots of the grid with
    the first ten seconds; the whole of lead II as the rhythm strip; the quality of the leads; the interpretation. Parts a
    record has nothing for are there with nulls.
    """
    nothing = {"label": F.lit(None).cast("string"), "colour": F.lit(None).cast("string"), "samples": F.lit(None).cast("array<double>"), "sampling_rate": F.lit(None).cast("int")}
    columns = ["record_id", "part", "row", "col", "label", "colour", "text", "samples", "sampling_rate"]
    rhythm = leads.where("kind = 'rhythm'") if "kind" in leads.columns else leads
    ids = records.select("record_id").distinct()

    def said(df: DataFrame, part: str, row: int, col: int) -> DataFrame:
        own = ids.join(df.toDF("record_id", "text"), "record_id", "left")
        return own.withColumns({"part": F.lit(part), "row": F.lit(row), "col": F.lit(col), **nothing}).select(*columns)

    grid = sheet_12(rhythm).where("row < 3").withColumns({"part": F.lit("grid"), "row": F.col("row") + 1})
    strip = sg.find_lead(rhythm, "II").select("record_id", F.lit("rhythm").alias("part"), F.lit(4).alias("row"), F.lit(0).alias("col"), F.lit("II").alias("label"), "samples", "sampling_rate")
    drawn = grid.select("record_id", "part", "row", "col", "label", "samples", "sampling_rate").unionByName(strip)
    drawn = drawn.join(ids, "record_id", "left_semi").withColumns({"text": F.lit(None).cast("string"), "colour": lead_colour(F.col("label"))}).select(*columns)
    parts = said(record_header(records), "header", 0, 0).unionByName(drawn)
    return parts.unionByName(said(quality_text(rhythm), "quality", 5, 0)).unionByName(said(interpretation_text(records), "interpretation", 5, 2))
