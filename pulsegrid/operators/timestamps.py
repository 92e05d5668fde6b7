"""Mixed timestamp notations into one UTC moment (problem 1).

Every value is split by a closed set of layouts. A layout whose parts can be read in more than one way (``03/04/2021``,
``05/06/07``) has several candidate formats, and so has a zone word that stands for several zones (``IST``, ``CST``); a value
supports each reading under which it is a real day. Per source (site and device) and question, expectation maximisation over
the mixture of readings turns these supports into posteriors. What is stated about the site, its day and month order and its
zone, is a prior worth STATED values, so the values decide where they say otherwise. Only counts by (source, question, set of
valid readings) enter the EM, so its input is as small as the number of sources, whatever the number of rows. The winning
reading comes back by a join on the same columns, with its posterior and a mark where that is no better than SURE.

Defined results: null, blank, wordy and impossible values give no moment; two values of one row are independent; repeated
rows count once in :func:`moments`; a row without a known site has no zone, so a local time there is unresolved; an ambiguous
value gives its likeliest moment, and :func:`readings` marks it.
"""

from __future__ import annotations

import re
import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import Memo, blank, cut, local_if_small, need, settle

# Month names by language, in order.
MONTHS = [
    "january jan januar jänner enero ene janvier janv styczeń stycznia января янв",
    "february feb februar febrero février févr fev luty lutego февраля фев",
    "march mar märz marzo mars marzec marca марта мар",
    "april apr abril abr avril avr kwiecień kwietnia апреля апр",
    "may mai mayo maj maja мая май",
    "june jun juni junio juin czerwiec czerwca июня июн",
    "july jul juli julio juillet juil lipiec lipca июля июл",
    "august aug agosto ago août aout sierpień sierpnia августа авг",
    "september sep sept septiembre set septembre wrzesień września сентября сен",
    "october oct oktober okt octubre octobre październik października октября окт",
    "november nov noviembre novembre listopad listopada ноября ноя",
    "december dec dezember dez diciembre dic décembre déc grudzień grudnia декабря дек",
]
# Minutes east of UTC of zone abbreviations.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "cot": -300,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "jst": 540, "sgt": 480, "hkt": 480, "nzst": 720, "nzdt": 780,
}
#: Candidate formats of each layout that can be read in several ways. Bit k of a mask stands for the k-th format.
FORMATS = {"sep_y4": ["DMY", "MDY"], "sep_y2": ["DMY", "MDY", "YMD"]}
# Zone words that stand for several zones, each in minutes east of UTC, the commonest first.
ZONE_READINGS = {"ist": [330, 120, 60], "cst": [-360, 480], "bst": [60, 360], "ast": [-240, 180], "mst": [-420, 480], "pst": [-480, 480]}
#: Values that a statement about the site is worth, and the posterior from which a reading is no longer ambiguous.
STATED, SURE = 25.0, 0.95
#: Sources times questions up to which the posteriors are broadcast.
POSTERIOR_BOUND = 50_000


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _real_day(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce(y.between(1800, 2199) & m.between(1, 12) & (d >= 1) & (d <= _days_in_month(y, m)), F.lit(False))


_MONTH = {w: k + 1 for k, words in enumerate(MONTHS) for w in words.split()}
# layout, and a pattern with its parts; the first that fits counts
_LAYOUTS = [
    (name, re.compile(pattern))
    for name, pattern in (
        ("epoch13", r"(\d{13})()()$"),
        ("epoch16", r"(\d{16})()()$"),
        ("epoch10", r"(\d{10})()()$"),
        ("compact", r"((?:18|19|20|21)\d{2})(\d{2})(\d{2})(?=$|t?\d{4}|[ z+\-])"),
        ("sep_y4", r"(\d{2})(\d{2})((?:18|19|20|21)\d{2})(?=$|t\d|[ z+\-])"),
        ("ymd", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"),
        ("sep_y4", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"),
        ("sep_y2", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(?!\d)"),
        ("dmon", r"(\d{1,2})(?:st|nd|rd|th)?[-./ ]+([^\W\d_]{3,12})\.?[-/, ]+(\d{4}|\d{2})(?!\d)"),
        ("mond", r"([^\W\d_]{3,12})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?!\d)"),
    )
]
_ZONE = r" ?(?:(?:utc|gmt)? ?([+-]\d{2}):?(\d{2})?|([^\W\d_]{1,5}))? ?(?:\[([^\]]+)\])?$"
_CLOCK = re.compile(r"[t, ]*(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)? ?(?:([ap])\.? ?m\.?)?" + _ZONE)
_NO_CLOCK = re.compile(_ZONE)
_BLANKS, _WEEKDAY, _OF, _UHR = re.compile(r"[\u00a0\s]+"), re.compile(r"[^\W\d_]{2,12}\.?, ?(?=\d)"), re.compile(r" (?:de|del|of) "), re.compile(r" ?\buhr\b")
_RUN_ON = re.compile(r"t?(\d{2})(\d{2})(\d{2})?(?=\D|$)")

#: What :func:`read_notation` finds: the layout; its three numbers, being year, month and day except in the layouts of
#: FORMATS, where they stand as written; whether the year has two digits; seconds of the day; minutes east; a named region;
#: whether a zone that stands there is known; an epoch number; a zone word of several zones.
NOTATION = "layout string, n1 int, n2 int, n3 int, short boolean, sec int, off int, region string, zone_ok boolean, number bigint, word string"
_NOTHING = (None, None, None, None, False, None, None, None, True, None, None)


@Memo
def _regions() -> dict[str, str]:
    """Names of time zones by their lower-case spelling."""
    return {z.lower(): z for z in zoneinfo.available_timezones()}


@Memo
def read_notation(raw: str) -> tuple:
    """The parts of a timestamp text, without deciding what ambiguous numbers mean."""
    s = _BLANKS.sub(" ", raw).strip().lower()
    s = _UHR.sub("", _OF.sub(" ", _WEEKDAY.sub("", s, count=1) if s[:1].isalpha() else s))
    for layout, pattern in _LAYOUTS:
        if m := pattern.match(s):
            break
    else:
        return _NOTHING
    if layout.startswith("epoch"):
        return (layout, None, None, None, False, None, None, None, True, int(m[1]), None)
    if layout == "dmon":
        numbers = (int(m[3]), _MONTH.get(m[2]), int(m[1]))
    elif layout == "mond":
        numbers = (int(m[3]), _MONTH.get(m[1]), int(m[2]))
    else:
        numbers = (int(m[1]), int(m[2]), int(m[3]))
    short = layout == "sep_y2" or (layout == "dmon" and len(m[3]) == 2)
    rest = s[m.end() :]
    if layout == "compact":
        rest = _RUN_ON.sub(lambda r: f" {r[1]}:{r[2]}" + (f":{r[3]}" if r[3] else ""), rest, count=1) if _RUN_ON.match(rest) else rest
    sec, zone = None, None
    if c := _CLOCK.match(rest):
        hour, minute, second, half = int(c[1]), int(c[2]), int(c[3] or 0), c[4]
        if half:
            hour = hour % 12 + (12 if half == "p" else 0) if 1 <= hour <= 12 else 99
        if hour < 24 and minute < 60 and second < 60:
            sec = hour * 3600 + minute * 60 + second
        zone = c.groups()[4:]
    elif c := _NO_CLOCK.match(rest):
        sec, zone = 0, c.groups()
    off, region, ok, word = None, None, True, None
    if zone:
        if zone[0]:
            off = (abs(int(zone[0])) * 60 + int(zone[1] or 0)) * (-1 if zone[0][0] == "-" else 1)
        elif zone[2]:
            off = ZONES.get(zone[2])
            ok, word = off is not None, zone[2] if zone[2] in ZONE_READINGS else None
        elif zone[3]:
            region = _regions().get(zone[3])
            ok = region is not None
    return (layout, *numbers, short, sec, off, region, ok, None, word)


def split_notation(df: DataFrame, raw: str) -> DataFrame:
    """Adds the columns of NOTATION. Text rules of this number outgrow generated code, so they run over Arrow batches."""

    @F.pandas_udf(NOTATION)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [read_notation(t) if t is not None else _NOTHING for t in texts]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in NOTATION.split(", ")])
        return out.astype({c: "Int64" for c in ("n1", "n2", "n3", "sec", "off", "number")})

    return df.withColumn("_n", read(F.col(raw))).select("*", "_n.*").drop("_n")


def _full_year(y: Column) -> Column:
    """A two-digit year as the latest such year not after ``late_year``."""
    full = F.col("_late") + y
    return F.when(F.col("short"), F.when(full > F.col("late_year"), full - 100).otherwise(full)).otherwise(y)


def _civil(fmt: str) -> tuple[Column, Column, Column]:
    """Year, month and day of an ambiguous layout under a format."""
    at = {"DMY": "n3 n2 n1", "MDY": "n3 n1 n2", "YMD": "n1 n2 n3"}[fmt].split()
    return F.col(f"_y_{at[0]}"), F.col(at[1]), F.col(at[2])


def with_valid_formats(df: DataFrame) -> DataFrame:
    """Adds ``mask``: the formats under which the value is a real day (bit 0 for layouts with one format)."""
    df = settle(df.withColumn("_late", F.floor(F.col("late_year") / 100).cast("int") * 100))
    df = df.withColumns({f"_y_{c}": _full_year(F.col(c)) for c in ("n1", "n3")})
    df = settle(df).withColumns({f"_ok_{fmt}": F.when(_real_day(*_civil(fmt)), 1).otherwise(0) for fmt in ("DMY", "MDY", "YMD")})
    mask = F.when(F.col("layout").isNull(), 0).when(F.col("layout").startswith("epoch"), 1)
    for layout, formats in FORMATS.items():
        mask = mask.when(F.col("layout") == layout, sum((F.col(f"_ok_{fmt}") * (1 << k) for k, fmt in enumerate(formats)), F.lit(0)))
    return settle(settle(df).withColumn("mask", mask.otherwise(F.col("_ok_YMD"))).drop("_ok_DMY", "_ok_MDY", "_ok_YMD"))


def mixture_posteriors(counts: pd.DataFrame, steps: int = 50) -> pd.DataFrame:
    """EM over the mixture of readings of one source and question.

    ``counts`` has site_id, serial, question (a layout or a zone word), stated, mask, n. Each value contributes its
    likelihood, one over the readings under which it is valid; a reading that is stated about the site is worth STATED
    values beforehand, and every reading half a value.
    """
    counts = counts.reset_index(drop=True)
    question, stated = counts.question[0], str(counts.stated[0]).split(",")
    readings = [str(z) for z in ZONE_READINGS[question]] if question in ZONE_READINGS else FORMATS.get(question, ["only"])
    masks, n = counts["mask"].to_numpy(), counts.n.to_numpy(float)
    valid = (masks[:, None] >> np.arange(len(readings))) & 1
    prior = np.full(len(readings), 0.5)
    told = [r in stated for r in readings]
    if any(told):
        prior[told] += STATED
    else:
        prior[0] += 1  # nothing fits what is stated: the commoner reading (day first where the year stands last)
    share = prior / prior.sum()

    def responsibilities() -> np.ndarray:
        support = valid * share
        total = support.sum(1, keepdims=True)
        return np.divide(support, total, out=np.zeros_like(support), where=total > 0)

    for _ in range(steps):
        new = prior + (responsibilities() * n[:, None]).sum(0)
        new /= new.sum()
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-12:
            break
    resp = responsibilities()
    out = counts[["site_id", "serial", "question", "mask"]].copy()
    out["reading"] = [readings[k] if r[k] > 0 else None for k, r in zip(resp.argmax(1), resp, strict=True)]
    out["posterior"] = resp.max(1)
    return out


def _posteriors(df: DataFrame, question: str, mask: Column, stated: Column) -> DataFrame:
    """(s_, d_, q_, m_, reading, posterior) of the values that pose a question."""
    counts = df.where(f"{question} IS NOT NULL").groupBy("site_id", "serial", F.col(question).alias("question"), mask.alias("mask")).agg(F.max(stated).alias("stated"), F.count("*").alias("n"))
    out = counts.groupBy("site_id", "serial", "question").applyInPandas(lambda g: mixture_posteriors(g), "site_id string, serial string, question string, mask int, reading string, posterior double")
    return local_if_small(out, POSTERIOR_BOUND).withColumnsRenamed({"site_id": "s_", "serial": "d_", "question": "q_", "mask": "m_"})


def _answered(df: DataFrame, posterior: DataFrame, question: str, mask: Column, reading: str, share: str) -> DataFrame:
    """Adds the winning reading of a question and its posterior."""
    on = F.col("site_id").eqNullSafe(F.col("s_")) & F.col("serial").eqNullSafe(F.col("d_")) & (F.col(question) == F.col("q_")) & (mask == F.col("m_"))
    return df.join(posterior.withColumnsRenamed({"reading": reading, "posterior": share}), on, "left").drop("s_", "d_", "q_", "m_")


def _own_offset(tz: Column, month: int) -> Column:
    """Minutes east of UTC of a zone at the first of a month."""
    seconds = 1_577_836_800 + (month - 1) * 2_629_746
    return ((F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.lit(seconds)), tz)) - seconds) / 60).cast("int")


def normalise(values: DataFrame, sites: DataFrame) -> DataFrame:
    """UTC moments of timestamp texts.

    ``values``: record_id, site_id, serial, field_name, raw, rec_raw (the recording's own date text), ingested_at.
    Returns these and ``layout``, ``format``, ``zone`` (minutes east read from an ambiguous zone word), ``posterior`` (of
    both), ``ambiguous``, ``epoch_s`` (null where unresolved). The texts are parsed once and the parse is kept.
    """
    values = need(values, "record_id", "site_id", "serial", "field_name", "raw", "rec_raw", "ingested_at").where(~blank(F.col("raw")))
    s = need(sites, "site_id", "tz", "date_order").dropDuplicates(["site_id"])
    s = s.withColumn("own_zone", F.concat_ws(",", _own_offset(F.col("tz"), 1), _own_offset(F.col("tz"), 7)))
    df = values.join(local_if_small(s, 100_000), "site_id", "left")
    rec = F.coalesce(F.trim("rec_raw"), F.lit(""))
    rec_year = F.coalesce(
        F.when(rec.rlike(r"^\d{10}$"), F.year(F.timestamp_seconds(F.expr("try_cast(trim(rec_raw) as bigint)")))),
        F.when(rec.rlike(r"^\d{13}$"), F.year(F.timestamp_millis(F.expr("try_cast(trim(rec_raw) as bigint)")))),
        _int(F.regexp_extract(rec, r"(?<!\d)((?:19|20)\d\d)(?:(?!\d)|(?=\d{4}))", 1)),
        F.year("ingested_at"),
    )
    df = df.withColumn("late_year", F.when(F.col("field_name") == "birth_date", rec_year).otherwise(F.coalesce(F.year("ingested_at"), rec_year)))
    df = cut(with_valid_formats(split_notation(df.drop("rec_raw", "ingested_at"), "raw")))
    every = F.lit(1)
    for word, zones in ZONE_READINGS.items():
        every = F.when(F.col("word") == word, (1 << len(zones)) - 1).otherwise(every)
    df = _answered(df, _posteriors(df, "layout", F.col("mask"), F.col("date_order")), "layout", F.col("mask"), "format", "p_format")
    df = _answered(df, _posteriors(df, "word", every, F.col("own_zone")), "word", every, "_zone", "p_zone")
    df = df.withColumns({"zone": F.col("_zone").cast("int"), "posterior": F.col("p_format") * F.coalesce("p_zone", F.lit(1.0))}).withColumn("off", F.coalesce("zone", "off"))
    several = (F.col("mask").bitwiseAND(F.col("mask") - 1) != 0) | F.col("word").isNotNull()
    df = df.withColumn("ambiguous", F.coalesce(several & (F.col("posterior") < SURE), F.lit(False)))

    civil = {fmt: _civil(fmt) for fmt in ("DMY", "MDY", "YMD")}
    pick = lambda k: F.when(F.col("format") == "DMY", civil["DMY"][k]).when(F.col("format") == "MDY", civil["MDY"][k]).otherwise(civil["YMD"][k])
    df = settle(df.withColumns({"_y": pick(0), "_mo": pick(1), "_d": pick(2)}))
    y, m, d = F.col("_y"), F.col("_mo"), F.col("_d")
    real = (F.col("mask") > 0) & ~F.col("layout").startswith("epoch") & _real_day(y, m, d)
    df = settle(df.withColumn("_real", real))
    day = F.when(F.col("_real"), F.unix_date(F.make_date(F.when(F.col("_real"), y), F.when(F.col("_real"), m), F.when(F.col("_real"), d)))).cast("long")
    df = settle(df.withColumn("day", day))
    wall = F.col("day") * 86400 + F.col("sec")
    zone = F.coalesce("region", "tz")
    local = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), zone))
    moment = F.when(F.col("zone_ok"), F.when(F.col("off").isNotNull(), wall - F.col("off") * 60).when(zone.isNotNull(), local))
    number = F.col("number")
    epoch = (
        F.when((F.col("field_name") == "birth_date") & F.col("day").isNotNull(), F.col("day") * 86400)
        .when(F.col("field_name") == "birth_date", F.lit(None))
        .when(F.col("layout") == "epoch10", number)
        .when(F.col("layout") == "epoch13", F.floor(number / 1000))
        .when(F.col("layout") == "epoch16", F.floor(number / 1_000_000))
        .otherwise(moment)
    )
    return df.select("record_id", "field_name", "raw", "site_id", "serial", "layout", "format", "zone", "posterior", "ambiguous", epoch.cast("long").alias("epoch_s"))


def record_timestamps(records: DataFrame) -> DataFrame:
    """The three timestamp texts of each record, one row each."""
    r = need(records, "record_id", "site_id", "recording", "interpretation", "patient", "ingested_at")
    fields = [("date", "recording.date"), ("interpretation_date", "interpretation.interpretation_date"), ("birth_date", "patient.birth_date")]
    return r.select(
        "record_id", "site_id", F.col("recording.device.serial_number").alias("serial"), F.col("recording.date").alias("rec_raw"), "ingested_at",
        F.inline(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(c).alias("raw")) for n, c in fields])),
    )


def moments(records: DataFrame, sites: DataFrame) -> DataFrame:
    """(record_id, field_name, epoch_s) of every readable timestamp; repeated rows once."""
    return normalise(record_timestamps(records), sites).where("epoch_s IS NOT NULL").select("record_id", "field_name", "epoch_s").distinct()


def readings(records: DataFrame, sites: DataFrame) -> DataFrame:
    """(record_id, field_name, raw, format, zone, posterior, ambiguous, epoch_s) of every value that has a layout, distinct."""
    return normalise(record_timestamps(records), sites).where("layout IS NOT NULL").select("record_id", "field_name", "raw", "format", "zone", "posterior", "ambiguous", "epoch_s").distinct()
