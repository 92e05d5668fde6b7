"""Native lead, interval and beat operators: Catalyst expressions and window aggregates only.

Samples are one array per lead. Expressions work on the array where they can, so no row leaves its task; only aggregates
across leads or events shuffle, once, on their key. Defined results: null samples stay null, empty arrays stay empty; a
constant lead normalises to zeros; ratios with a nil denominator are nil, as noted on each function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Accepted voltage spellings with their canonical unit, and units in microvolts.
VOLT_NAMES = {
    "uV": "uV", "uv": "uV", "µV": "uV", "µv": "uV", "microvolt": "uV", "microvolts": "uV", "mV": "mV", "mv": "mV", "millivolt": "mV", "millivolts": "mV",
    "V": "V", "v": "V", "volt": "V", "volts": "V",
}
MICROVOLTS = {"uV": 1.0, "mV": 1e3, "V": 1e6}
STANDARD_12 = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]


def leads_from_arrays(spark: SparkSession, arrays: Any, fs: int | None, labels: Sequence[str] | None = None) -> DataFrame:
    """(record_id, lead_no, label, samples, sampling_rate) from one signal, a list or matrix of signals, or records of matrices.

    Arrays carry no rate, so ``fs`` must be given. For data that are already on the driver; files are read by the reader.
    """
    if fs is None:
        raise TypeError("arrays have no sampling rate; give fs")
    depth = np.ndim(arrays[0]) + 1 if isinstance(arrays, list) and len(arrays) else np.ndim(arrays)
    if depth not in (1, 2, 3):
        raise ValueError(f"arrays of {depth} dimensions")
    records = arrays if depth == 3 else [arrays] if depth == 2 else [[arrays]]
    name = lambda k: labels[k] if labels is not None and k < len(labels) else f"Lead {k + 1}"
    rows = [(str(r), k, name(k), [float(v) for v in x], int(fs)) for r, leads in enumerate(records) for k, x in enumerate(leads)]
    return spark.createDataFrame(rows, "record_id string, lead_no int, label string, samples array<double>, sampling_rate int")


def canonical_unit(unit: Column) -> Column:
    """The canonical voltage unit of a spelling, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in VOLT_NAMES.items() for x in kv]), unit)


def _microvolts(unit: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MICROVOLTS.items() for x in kv]), unit)


def to_physical(leads: DataFrame) -> DataFrame:
    """Raw samples times resolution plus offset, in the resolution's unit; physical leads stay. A raw lead of resolution 0 raises."""
    bad = F.raise_error(F.concat(F.lit("resolution is 0 on raw lead "), F.coalesce("label", F.lit("?")))).cast("array<double>")
    scaled = F.when(F.col("resolution") == 0, bad).otherwise(F.transform("samples", lambda x: x * F.col("resolution") + F.col("offset_value")))
    return leads.withColumns({
        "samples": F.when(F.col("is_raw"), scaled).otherwise(F.col("samples")),
        "units": F.when(F.col("is_raw"), F.col("resolution_unit")).otherwise(F.col("units")), "is_raw": F.lit(False),
    })


def convert_units(leads: DataFrame, target: str) -> DataFrame:
    """Physical samples in another voltage unit. An unknown target fails at once; raw leads and unknown units raise."""
    if target not in VOLT_NAMES:
        raise ValueError(f"unknown target unit {target!r}; accepted: uV, mV, V and their spellings")
    to = VOLT_NAMES[target]
    now = canonical_unit(F.col("units"))
    raw = F.raise_error(F.lit("raw samples have no unit; call to_physical first")).cast("array<double>")
    unknown = F.raise_error(F.concat(F.lit("no voltage unit: "), F.coalesce("units", F.lit("null")))).cast("array<double>")
    factor = _microvolts(now) / MICROVOLTS[to]
    scaled = F.when(F.col("is_raw"), raw).when(now.isNull(), unknown).when(now == to, F.col("samples")).otherwise(F.transform("samples", lambda x: x * factor))
    return leads.withColumns({"samples": scaled, "units": F.when(now == to, F.col("units")).otherwise(F.lit(to))})


def auto_scale(leads: DataFrame, target: str = "mV") -> DataFrame:
    """Scale what has scaling and convert what has a known voltage; ``unscaled`` marks leads without any."""
    to = VOLT_NAMES[target]
    unscaled = (F.col("resolution") == 1) & (F.col("offset_value") == 0) & (F.coalesce("resolution_unit", F.lit("")) == "")
    unit = F.when(F.col("is_raw"), F.col("resolution_unit")).otherwise(F.col("units"))
    now = canonical_unit(unit)
    factor = F.coalesce(_microvolts(now) / MICROVOLTS[to], F.lit(1.0))
    res, off = F.when(F.col("is_raw"), F.col("resolution")).otherwise(1.0), F.when(F.col("is_raw"), F.col("offset_value")).otherwise(0.0)
    return leads.withColumns({
        "unscaled": unscaled,
        "samples": F.when(unscaled, F.col("samples")).otherwise(F.transform("samples", lambda x: (x * res + off) * factor)),
        "units": F.when(unscaled, F.col("units")).when(now.isNotNull(), F.lit(to)).otherwise(unit), "is_raw": F.col("is_raw") & unscaled,
    })


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside a lambda, plain expressions are worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _zeros(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(0.0))


def normalize_minmax(samples: Column) -> Column:
    """To [-1, 1]."""
    ends = F.struct(samples.alias("a"), F.array_min(samples).alias("lo"), F.array_max(samples).alias("hi"))
    return _let(ends, lambda s: F.when(s["hi"] == s["lo"], _zeros(s["a"])).otherwise(F.transform(s["a"], lambda x: 2 * (x - s["lo"]) / (s["hi"] - s["lo"]) - 1)))


def normalize_zscore(samples: Column) -> Column:
    """To mean 0 and population deviation 1."""
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = F.struct(samples.alias("a"), (total(samples, lambda x: x) / F.nullif(F.size(samples), F.lit(0))).alias("m"))
    both = lambda s: F.struct(s["a"].alias("a"), s["m"].alias("m"), F.sqrt(total(s["a"], lambda x: (x - s["m"]) * (x - s["m"])) / F.nullif(F.size(s["a"]), F.lit(0))).alias("d"))
    scaled = lambda s: F.when(s["d"] == 0, _zeros(s["a"])).otherwise(F.transform(s["a"], lambda x: (x - s["m"]) / s["d"]))
    return _let(mean, lambda s: _let(both(s), scaled))


def normalize_amplitude(samples: Column, target: float = 1.0) -> Column:
    """So that the largest deviation from nil is ``target``."""
    top = F.struct(samples.alias("a"), F.greatest(F.array_max(samples), -F.array_min(samples)).alias("t"))
    return _let(top, lambda s: F.when(s["t"] == 0, _zeros(s["a"])).otherwise(F.transform(s["a"], lambda x: x * (F.lit(target) / s["t"]))))


def find_lead(leads: DataFrame, label: str) -> DataFrame:
    """The first lead of each record with this label, whatever its case."""
    hit = leads.where(F.lower("label") == label.lower())
    cols = [c for c in leads.columns if c != "record_id"]
    return hit.groupBy("record_id").agg(F.min_by(F.struct(*cols), "lead_no").alias("r")).select("record_id", "r.*")


def _by_label(leads: DataFrame, labels: list[str]) -> DataFrame:
    """One row per record with the samples of each label; one shuffle on the record."""
    first = [F.min_by(F.when(F.lower("label") == x.lower(), F.struct("samples", "sampling_rate")), F.when(F.lower("label") == x.lower(), F.col("lead_no"))).alias(x) for x in labels]
    return leads.groupBy("record_id").agg(*first)


def _pair(df: DataFrame) -> DataFrame:
    """Records with leads I and II of equal rate and length."""
    same = (F.col("I.sampling_rate") == F.col("II.sampling_rate")) & (F.size("I.samples") == F.size("II.samples"))
    return df.where(F.col("I").isNotNull() & F.col("II").isNotNull()).withColumn("_same", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("leads I and II differ in rate or length")).cast("boolean"))).where("_same").drop("_same")


_LIMB = {
    "III": lambda a, b: b - a,
    "aVR": lambda a, b: -(a + b) / 2,
    "aVL": lambda a, b: a - b / 2,
    "aVF": lambda a, b: b - a / 2,
}


def derive_leads(leads: DataFrame, wanted: list[str]) -> DataFrame:
    """(record_id, label, samples, sampling_rate) of leads that follow from I and II, with those given where they are wanted.

    Records without both are left out; differing rates or lengths raise. V leads are passed on unchecked.
    """
    given = ["I", "II", *[x for x in wanted if x.startswith("V")]]
    df = _pair(_by_label(leads, given))
    rows = []
    for k, name in enumerate(wanted):
        samples = F.zip_with("I.samples", "II.samples", _LIMB[name]) if name in _LIMB else F.col(f"{name}.samples")
        rows.append(F.struct(F.lit(k).alias("lead_no"), F.lit(name).alias("label"), samples.alias("samples"), F.col("I.sampling_rate").alias("sampling_rate")))
    return df.select("record_id", F.inline(F.array(*rows))).where("samples IS NOT NULL")


def points(leads: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, t, v): the samples as plot points, with 0-based number and time in seconds."""
    return leads.select(*keys, F.col("sampling_rate"), F.posexplode("samples").alias("i", "v")).select(*keys, "i", (F.col("i") / F.col("sampling_rate")).alias("t"), "v")


# --- intervals and heart rate -------------------------------------------------------------------------------------------


def intervals(beats: DataFrame, key: str, at: str) -> DataFrame:
    """(key, beat_no, rr_ms, hr) from beat times in milliseconds; a key with one beat gives none."""
    w = W.partitionBy(key).orderBy(at)
    rr = F.col(at) - F.lag(at).over(w)
    df = beats.select(key, F.row_number().over(w).alias("beat_no"), rr.alias("rr_ms")).where("rr_ms IS NOT NULL")
    return df.withColumn("hr", F.try_divide(F.lit(60000.0), F.col("rr_ms")))


def intervals_of_peaks(peaks: Column, fs: Column) -> Column:
    """RR intervals in milliseconds of an array of sample numbers; under two peaks an empty array."""
    n = F.size(peaks)
    empty = F.array().cast("array<double>")
    diff = F.zip_with(F.slice(peaks, 2, F.greatest(n - 1, F.lit(0))), F.slice(peaks, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: (b - a) * (F.lit(1000.0) / fs))
    return F.when(peaks.isNotNull(), F.when(n < 2, empty).otherwise(diff))


def heart_rate(rr: DataFrame, key: str) -> DataFrame:
    """(key, heart_rate): 60000 over the mean interval; nil where that is not positive."""
    return rr.groupBy(key).agg(F.when(F.avg("rr_ms") > 0, F.try_divide(F.lit(60000.0), F.avg("rr_ms"))).otherwise(0.0).alias("heart_rate"))


def hrv_time_domain(rr: DataFrame, key: str) -> DataFrame:
    """The ten time-domain measures of each key. One interval gives its mean and rate and nil otherwise; the sample deviation of one difference is NaN."""
    w = W.partitionBy(key).orderBy("beat_no")
    d = F.col("rr_ms") - F.lag("rr_ms").over(w)
    df = rr.withColumns({"_d": d, "_hr": F.lit(60000.0) / F.col("rr_ms")})
    n = F.count("*")
    many = lambda c: F.when(n > 1, c).otherwise(0.0)
    nan1 = lambda c: F.coalesce(c, F.lit(float("nan")))
    share = lambda ms: F.coalesce(F.lit(100.0) * F.count_if(F.abs("_d") > ms) / F.nullif(F.count("_d"), F.lit(0)), F.lit(0.0))
    return df.groupBy(key).agg(
        F.avg("rr_ms").alias("mean_rr"), many(F.stddev_samp("rr_ms")).alias("sdnn"), many(F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmssd"),
        many(nan1(F.stddev_samp("_d"))).alias("sdsd"), F.count_if(F.abs("_d") > 50).alias("nn50_count"), share(50).alias("pnn50"),
        F.count_if(F.abs("_d") > 20).alias("nn20_count"), share(20).alias("pnn20"), F.avg("_hr").alias("hr_mean"), many(F.stddev_samp("_hr")).alias("hr_std"),
    )


def hrv_poincare(rr: DataFrame, key: str) -> DataFrame:
    """Deviations across and along the diagonal of successive intervals; the ratio is nil where the second is."""
    w = W.partitionBy(key).orderBy("beat_no")
    df = rr.withColumn("_p", F.lag("rr_ms").over(w))
    one, two = F.stddev_samp(F.col("rr_ms") - F.col("_p")) / F.sqrt(F.lit(2.0)), F.stddev_samp(F.col("rr_ms") + F.col("_p")) / F.sqrt(F.lit(2.0))
    df = df.groupBy(key).agg(one.alias("sd1"), two.alias("sd2"), F.count("_p").alias("_n"))
    nan = F.lit(float("nan"))
    df = df.withColumns({c: F.when(F.col("_n") == 0, 0.0).otherwise(F.coalesce(c, nan)) for c in ("sd1", "sd2")})
    return df.select(key, "sd1", "sd2", F.when((F.col("sd2") > 0) & ~F.isnan("sd2"), F.col("sd1") / F.col("sd2")).otherwise(0.0).alias("sd1_sd2_ratio"))


def rr_tachogram(rr: DataFrame, key: str) -> DataFrame:
    """Each interval with its key's mean and the band of one population deviation."""
    w = W.partitionBy(key)
    m, s = F.avg("rr_ms").over(w), F.stddev_pop("rr_ms").over(w)
    return rr.select(key, "beat_no", "rr_ms", m.alias("mean_rr"), (m - s).alias("low"), (m + s).alias("high"))


# --- beats --------------------------------------------------------------------------------------------------------------


def segment_beats(leads: DataFrame, key: str, before: float = 0.2, after: float = 0.4) -> DataFrame:
    """(key, beat_no, r_sample, samples) of whole frames around each peak (key, samples, sampling_rate, peaks); beat_no counts all peaks."""
    pre, post = F.bround(F.lit(before) * F.col("sampling_rate")).cast("int"), F.bround(F.lit(after) * F.col("sampling_rate")).cast("int")
    df = leads.select(key, "samples", "sampling_rate", F.posexplode("peaks").alias("beat_no", "r_sample"))
    whole = (F.col("r_sample") - pre >= 0) & (F.col("r_sample") + post <= F.size("samples"))
    return df.where(whole).select(key, "beat_no", "r_sample", F.slice("samples", F.col("r_sample") - pre + 1, pre + post).alias("samples"))


def average_beat(beats: DataFrame, key: str) -> DataFrame:
    """(key, i, mean, sd, n): element-wise mean and population deviation of a key's beats."""
    return beats.select(key, F.posexplode("samples").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))


def beat_waterfall(beats: DataFrame, key: str) -> DataFrame:
    """(key, beat_no, i, v): beats set off downwards by 1.3 times the span of the first."""
    w = W.partitionBy(key)
    span = F.min_by(F.array_max("samples") - F.array_min("samples"), "beat_no").over(w)
    order = F.row_number().over(w.orderBy("beat_no")) - 1
    placed = beats.withColumn("_off", order * -1.3 * span)  # the windows are over beats, so before their samples are exploded
    return placed.select(key, "beat_no", "_off", F.posexplode("samples").alias("i", "v")).select(key, "beat_no", "i", (F.col("v") + F.col("_off")).alias("v"))


def fixed_segments(samples: Column, size: int) -> Column:
    """Consecutive stretches of ``size`` samples, the last filled up with zeros."""
    n = F.size(samples)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(size)).cast("int") - 1, F.lit(0)))
    padded = F.concat(samples, F.array_repeat(F.lit(0.0), size))
    return F.when(n > 0, F.transform(starts, lambda k: F.slice(padded, k * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def first_difference(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Values from their first differences: a running sum."""
    return df.withColumn("decoded", F.sum(value).over(W.partitionBy(key).orderBy(at)))


def second_difference(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Values from their second differences, the first two being the value and its successor: two running sums."""
    w = W.partitionBy(key).orderBy(at)
    n, first = F.row_number().over(w), F.first(value).over(w)
    e = F.when(n == 1, 0).when(n == 2, F.col(value) - first).otherwise(F.col(value))
    df = df.withColumns({"_first": first, "_e": e}).withColumn("_s", F.sum("_e").over(w))
    return df.withColumn("decoded", F.col("_first") + F.sum("_s").over(w)).drop("_first", "_e", "_s")


# --- quality from spectra -----------------------------------------------------------------------------------------------


def kurtosis_score(k: Column, n: Column) -> Column:
    """The kurtosis score of a population excess kurtosis; null or under four samples is nil."""
    score = F.when(k < 0, 0.0).when(k < 3, k / 3).when(k <= 20, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (k - 20) / 30))
    return F.when((n < 4) | k.isNull() | F.isnan(k), 0.0).otherwise(score)


def quality_class(sqi: Column) -> Column:
    return F.when(sqi > 0.8, "excellent").when(sqi >= 0.5, "acceptable").otherwise("unacceptable")


def kurtosis_of(samples: Column) -> Column:
    """The population excess kurtosis of an array, within its row; null where it is constant or empty."""
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = F.struct(samples.alias("a"), (total(samples, lambda x: x) / F.nullif(F.size(samples), F.lit(0))).alias("m"))
    power = lambda s, k: total(s["a"], lambda x: F.pow(x - s["m"], F.lit(k)))
    return _let(mean, lambda s: _let(F.struct(power(s, 2).alias("two"), power(s, 4).alias("four"), F.size(s["a"]).alias("n")), lambda q: F.when(q["two"] > 0, q["n"] * q["four"] / (q["two"] * q["two"]) - 3)))


def band_scores(spectrum: Column) -> Column:
    """struct<power_ratio_sqi, baseline_sqi, snr_db> of a spectrum struct<freqs, psd>, within its row: no sample is exploded or shuffled."""
    bins = F.arrays_zip(spectrum["freqs"].alias("f"), spectrum["psd"].alias("p"))
    step = F.get(spectrum["freqs"], F.lit(1))
    power = lambda keep: F.aggregate(bins, F.lit(0.0), lambda acc, x: acc + F.when(keep(x["f"]), x["p"]).otherwise(0.0)) * step
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    sums = F.struct(
        power(lambda f: f.between(1, 40)).alias("heart"), power(lambda f: F.lit(True)).alias("all"), power(lambda f: f < 1).alias("slow"), power(lambda f: f >= 100).alias("noise"),
    )
    scores = lambda s: F.struct(
        F.when(s["all"] > 0, clip(F.try_divide(s["heart"], s["all"]) / 0.7)).otherwise(0.0).alias("power_ratio_sqi"),
        F.when(s["heart"] > 0, clip(1 - F.try_divide(s["slow"], s["heart"]))).otherwise(0.0).alias("baseline_sqi"),
        F.when(s["noise"] > 0, F.when(s["heart"] > 0, 10 * F.log10(F.try_divide(s["heart"], s["noise"]))).otherwise(float("-inf"))).otherwise(60.0).alias("snr_db"),
    )
    return F.when(spectrum.isNotNull(), _let(sums, scores))


def spectrum_db(psd: Column) -> Column:
    return 10 * F.log10(F.greatest(psd, F.lit(1e-20)))
