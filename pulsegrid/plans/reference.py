"""Queries of the signal operators over carrier signals, with their SQL.

Carriers: ``embeddings`` as leads of 64 samples at 500 Hz, ``events`` per user as beat times and as a series of values. Every
query runs over the whole table; floating-point results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.common import table
from pulsegrid.functions import arrow
from pulsegrid.operators import plotdata
from pulsegrid.operators import signal as sg
from pulsegrid.plans import filter_sql
from pulsegrid.sources.detect import FORMATS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- carriers -----------------------------------------------------------------------------------------------------------


def leads64(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """Embeddings as leads; ``raw`` with a resolution and an offset by label."""
    e = table(spark, sf_dir, "embeddings")
    res, off = ((F.col("label") + 1) * 0.5, F.col("label") * 0.25) if raw else (F.lit(1.0), F.lit(0.0))
    return e.select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("samples"), F.lit(500).alias("sampling_rate"),
        res.cast("double").alias("resolution"), off.cast("double").alias("offset_value"), F.lit("mV").alias("resolution_unit"), F.lit("" if raw else "mV").alias("units"), F.lit(raw).alias("is_raw"),
    )


def lead_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as eight-lead records: within a label by rank of vec_id, I, II, V1 .. V6."""
    names = F.array(*[F.lit(x) for x in ("I", "II", "V1", "V2", "V3", "V4", "V5", "V6")])
    e = leads64(spark, sf_dir).withColumn("rk", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    return e.select(
        F.concat_ws("-", "label", F.floor(F.col("rk") / 8).cast("string")).alias("record_id"), (F.col("rk") % 8).alias("lead_no"),
        F.get(names, (F.col("rk") % 8).cast("int")).alias("label"), "samples", "sampling_rate",
    )


def beat_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, at): event times in milliseconds."""
    return table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.to_timestamp("ts")) / 1000).alias("at"))


def value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, samples, sampling_rate, peaks): a user's values in order of time; every seventh is a peak, the fourth first."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("s"))
    samples = F.transform("s", lambda x: x["value"])
    return e.select("user_id", samples.alias("samples"), F.lit(10).alias("sampling_rate"), F.filter(F.sequence(F.lit(3), F.size("s") + 2, F.lit(7)), lambda p: p < F.size("s")).alias("peaks"))


_LEADS = "WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings), p AS (SELECT vec_id, label, s, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM e)"
_RR = (
    "WITH b AS (SELECT user_id, epoch_us(ts) / 1000.0 AS ms FROM events), r0 AS (SELECT user_id, row_number() OVER w AS beat_no, ms - lag(ms) OVER w AS rr_ms FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ms)), "
    "r AS (SELECT user_id, beat_no, rr_ms, 60000.0 / rr_ms AS hr FROM r0 WHERE rr_ms IS NOT NULL), d AS (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id ORDER BY beat_no) AS d, lag(rr_ms) OVER (PARTITION BY user_id ORDER BY beat_no) AS prev FROM r)"
)
_GROUPS = (
    "WITH k AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rk, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings), "
    "g AS (SELECT CAST(label AS VARCHAR) || '-' || CAST(rk // 8 AS VARCHAR) AS record_id, rk % 8 AS lead_no, ['I','II','V1','V2','V3','V4','V5','V6'][CAST(rk % 8 + 1 AS BIGINT)] AS label, s FROM k), "
    "gp AS (SELECT record_id, label, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM g), "
    "two AS (SELECT a.record_id, a.i, a.x AS a, b.x AS b FROM gp a JOIN gp b ON a.record_id = b.record_id AND a.i = b.i AND a.label = 'I' AND b.label = 'II')"
)
_DFT = (
    _LEADS + ", m AS (SELECT vec_id, avg(x) AS mu FROM p GROUP BY vec_id), w AS (SELECT p.vec_id, p.i, p.x, (p.x - m.mu) * (0.5 - 0.5 * cos(2 * pi() * p.i / 64)) AS y FROM p JOIN m USING (vec_id)), "
    "f AS (SELECT vec_id, k, sum(y * cos(2 * pi() * k * i / 64)) AS re, sum(y * sin(2 * pi() * k * i / 64)) AS im, sum(x * cos(2 * pi() * k * i / 64)) AS xre, sum(x * sin(2 * pi() * k * i / 64)) AS xim "
    "FROM w CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY vec_id, k), "
    "h AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * n / 64)) ^ 2) AS u FROM (SELECT unnest(range(0, 64)) AS n)), "
    "s AS (SELECT vec_id, k, k * 500.0 / 64 AS freq, (re * re + im * im) / (500 * u) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS psd, 2.0 / 64 * sqrt(xre * xre + xim * xim) AS mag FROM f, h)"
)
_SERIES = (
    "WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), "
    "pk AS (SELECT user_id, n, i AS r_sample, (i - 3) // 7 AS beat_no FROM v WHERE i >= 3 AND (i - 3) % 7 = 0), wh AS (SELECT * FROM pk WHERE r_sample - 2 >= 0 AND r_sample + 4 <= n), "
    "bt AS (SELECT wh.user_id, beat_no, r_sample, v.i - (r_sample - 2) AS i, value AS x FROM wh JOIN v ON v.user_id = wh.user_id AND v.i >= r_sample - 2 AND v.i < r_sample + 4)"
)


def _r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + 0.0  # no negative zero


def _exploded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode("samples").alias("i", "v")).select(*keys, F.col("i").cast("long").alias("i"), _r("v", digits).alias("v"))


# --- scaling, normalising, leads ----------------------------------------------------------------------------------------


@query(_LEADS + " SELECT vec_id, CAST(i AS BIGINT) AS i, round(x * ((label + 1) * 0.5) + label * 0.25, 6) + 0.0 AS v FROM p")
def to_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(sg.to_physical(leads64(spark, sf_dir, raw=True)), "vec_id")


@query(_LEADS + " SELECT vec_id, 'uV' AS units, CAST(i AS BIGINT) AS i, round(x * 1000.0, 4) + 0.0 AS v FROM p")
def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(sg.convert_units(leads64(spark, sf_dir), "uV"), "vec_id", "units", digits=4)


@query(_LEADS + " SELECT vec_id, CAST(i AS BIGINT) AS i, round((x * ((label + 1) * 0.5) + label * 0.25) * 1000.0, 3) + 0.0 AS v FROM p")
def auto_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(sg.auto_scale(leads64(spark, sf_dir, raw=True), "uV"), "vec_id", digits=3)


@query(_LEADS + ", q AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM p GROUP BY vec_id) SELECT vec_id, CAST(i AS BIGINT) AS i, round(CASE WHEN hi = lo THEN 0.0 ELSE 2 * (x - lo) / (hi - lo) - 1 END, 6) + 0.0 AS v FROM p JOIN q USING (vec_id)")
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(leads64(spark, sf_dir).withColumn("samples", sg.normalize_minmax(F.col("samples"))), "vec_id")


@query(_LEADS + ", q AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM p GROUP BY vec_id) SELECT vec_id, CAST(i AS BIGINT) AS i, round(CASE WHEN sd = 0 THEN 0.0 ELSE (x - m) / sd END, 6) + 0.0 AS v FROM p JOIN q USING (vec_id)")
def normalize_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(leads64(spark, sf_dir).withColumn("samples", sg.normalize_zscore(F.col("samples"))), "vec_id")


@query(_LEADS + ", q AS (SELECT vec_id, max(abs(x)) AS t FROM p GROUP BY vec_id) SELECT vec_id, CAST(i AS BIGINT) AS i, round(CASE WHEN t = 0 THEN 0.0 ELSE x * (1.5 / t) END, 6) + 0.0 AS v FROM p JOIN q USING (vec_id)")
def normalize_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(leads64(spark, sf_dir).withColumn("samples", sg.normalize_amplitude(F.col("samples"), 1.5)), "vec_id")


@query(_GROUPS + " SELECT record_id, 'III' AS label, CAST(i AS BIGINT) AS i, round(b - a, 6) + 0.0 AS v FROM two")
def derive_lead_iii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(sg.derive_leads(lead_groups(spark, sf_dir), ["III"]), "record_id", "label")


_AUG = "SELECT record_id, 'aVR' AS label, i, -(a + b) / 2 AS v FROM two UNION ALL SELECT record_id, 'aVL', i, a - b / 2 FROM two UNION ALL SELECT record_id, 'aVF', i, b - a / 2 FROM two"


@query(_GROUPS + f" SELECT record_id, label, CAST(i AS BIGINT) AS i, round(v, 6) + 0.0 AS v FROM ({_AUG})")
def derive_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(sg.derive_leads(lead_groups(spark, sf_dir), ["aVR", "aVL", "aVF"]), "record_id", "label")


@query(
    _GROUPS + f", al AS ({_AUG} UNION ALL SELECT record_id, 'III', i, b - a FROM two UNION ALL SELECT record_id, label, i, x FROM gp WHERE record_id IN (SELECT record_id FROM two)) "
    "SELECT record_id, CAST(list_position(['I','II','III','aVR','aVL','aVF','V1','V2','V3','V4','V5','V6'], label) - 1 AS BIGINT) AS lead_no, label, CAST(i AS BIGINT) AS i, round(v, 6) + 0.0 AS v FROM al"
)
def derive_standard_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sg.derive_leads(lead_groups(spark, sf_dir), sg.STANDARD_12)
    return _exploded(df.withColumn("lead_no", F.col("lead_no").cast("long")), "record_id", "lead_no", "label")


@query(_GROUPS + " SELECT record_id, label, CAST(i AS BIGINT) AS i, round(x, 6) + 0.0 AS v FROM gp WHERE label = 'V2'")
def find_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(sg.find_lead(lead_groups(spark, sf_dir), "v2"), "record_id", "label")


@query(_LEADS + " SELECT vec_id, CAST(i AS BIGINT) AS i, round(i / 500.0, 6) AS t, round(x, 6) + 0.0 AS v FROM p")
def lead_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.points(leads64(spark, sf_dir), "vec_id").select("vec_id", F.col("i").cast("long").alias("i"), F.round("t", 6).alias("t"), _r("v").alias("v"))


@query(_LEADS + " SELECT vec_id, max(i / 500.0) AS last_t, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY vec_id")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.transform(F.sequence(F.lit(0), F.size("samples") - 1), lambda i: i / F.col("sampling_rate"))
    return leads64(spark, sf_dir).select("vec_id", F.array_max(t).alias("last_t"), F.size(t).cast("long").alias("n"))


# --- intervals ----------------------------------------------------------------------------------------------------------


def rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.intervals(beat_times(spark, sf_dir), "user_id", "at")


@query(_RR + " SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, round(rr_ms, 3) AS rr_ms FROM r")
def rr_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(spark, sf_dir).select("user_id", F.col("beat_no").cast("long").alias("beat_no"), F.round("rr_ms", 3).alias("rr_ms"))


@query(_RR + " SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, round(hr, 6) AS hr FROM r")
def instantaneous_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(spark, sf_dir).select("user_id", F.col("beat_no").cast("long").alias("beat_no"), F.round("hr", 6).alias("hr"))


@query(_RR + " SELECT user_id, round(60000.0 / avg(rr_ms), 8) AS heart_rate FROM r GROUP BY user_id")
def heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.heart_rate(rr(spark, sf_dir), "user_id").select("user_id", F.round("heart_rate", 8).alias("heart_rate"))


@query(
    _RR + " SELECT user_id, round(avg(rr_ms), 3) AS mean_rr, round(stddev_samp(rr_ms), 3) AS sdnn, round(sqrt(avg(d * d)), 3) AS rmssd, round(stddev_samp(d), 3) AS sdsd, CAST(count(*) FILTER (abs(d) > 50) AS BIGINT) AS nn50_count, "
    "round(100.0 * count(*) FILTER (abs(d) > 50) / count(d), 6) AS pnn50, CAST(count(*) FILTER (abs(d) > 20) AS BIGINT) AS nn20_count, round(100.0 * count(*) FILTER (abs(d) > 20) / count(d), 6) AS pnn20, "
    "round(avg(hr), 6) AS hr_mean, round(stddev_samp(hr), 6) AS hr_std FROM d GROUP BY user_id"
)
def hrv_time_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sg.hrv_time_domain(rr(spark, sf_dir), "user_id")
    return df.select("user_id", *[F.round(c, 6 if c in ("pnn50", "pnn20", "hr_mean", "hr_std") else 3).alias(c) if not c.endswith("count") else F.col(c) for c in df.columns[1:]])


@query(_RR + ", q AS (SELECT user_id, stddev_samp(rr_ms - prev) / sqrt(2) AS sd1, stddev_samp(rr_ms + prev) / sqrt(2) AS sd2 FROM d WHERE prev IS NOT NULL GROUP BY user_id) SELECT user_id, round(sd1, 3) AS sd1, round(sd2, 3) AS sd2, round(sd1 / sd2, 8) AS sd1_sd2_ratio FROM q")
def hrv_poincare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.hrv_poincare(rr(spark, sf_dir), "user_id").select("user_id", F.round("sd1", 3).alias("sd1"), F.round("sd2", 3).alias("sd2"), F.round("sd1_sd2_ratio", 8).alias("sd1_sd2_ratio"))


@query(_RR + ", q AS (SELECT *, avg(rr_ms) OVER w AS m, stddev_pop(rr_ms) OVER w AS s FROM r WINDOW w AS (PARTITION BY user_id)) SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, round(rr_ms, 3) AS rr_ms, round(m, 3) AS mean_rr, round(m - s, 3) AS low, round(m + s, 3) AS high FROM q")
def rr_tachogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sg.rr_tachogram(rr(spark, sf_dir), "user_id")
    return df.select("user_id", F.col("beat_no").cast("long").alias("beat_no"), *[F.round(c, 3).alias(c) for c in ("rr_ms", "mean_rr", "low", "high")])


@query(_RR + " SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, round(prev, 3) AS rr_before, round(rr_ms, 3) AS rr_ms FROM d WHERE prev IS NOT NULL")
def poincare_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("beat_no")
    df = rr(spark, sf_dir).withColumn("rr_before", F.lag("rr_ms").over(w)).where("rr_before IS NOT NULL")
    return df.select("user_id", F.col("beat_no").cast("long").alias("beat_no"), F.round("rr_before", 3).alias("rr_before"), F.round("rr_ms", 3).alias("rr_ms"))


# --- beats --------------------------------------------------------------------------------------------------------------


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.segment_beats(value_series(spark, sf_dir), "user_id")


@query(_SERIES + " SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, CAST(r_sample AS BIGINT) AS r_sample, CAST(i AS BIGINT) AS i, round(x, 6) + 0.0 AS v FROM bt")
def segment_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beats(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("beat_no", "r_sample")})
    return _exploded(b, "user_id", "beat_no", "r_sample")


@query(_SERIES + " SELECT user_id, CAST(i AS BIGINT) AS i, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS sd, CAST(count(*) AS BIGINT) AS n FROM bt GROUP BY user_id, i")
def average_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sg.average_beat(beats(spark, sf_dir), "user_id")
    return df.select("user_id", F.col("i").cast("long").alias("i"), _r("mean").alias("mean"), _r("sd").alias("sd"), "n")


@query(
    _SERIES + ", sp AS (SELECT user_id, beat_no, max(x) - min(x) AS span FROM bt GROUP BY user_id, beat_no), o AS (SELECT user_id, beat_no, row_number() OVER w - 1 AS k, first_value(span) OVER w AS span0 FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY beat_no)) "
    "SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, CAST(i AS BIGINT) AS i, round(x + k * -1.3 * span0, 5) + 0.0 AS v FROM bt JOIN o USING (user_id, beat_no)"
)
def beat_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sg.beat_waterfall(beats(spark, sf_dir), "user_id")
    return df.select("user_id", F.col("beat_no").cast("long").alias("beat_no"), F.col("i").cast("long").alias("i"), _r("v", 5).alias("v"))


@query(_SERIES + ", z AS (SELECT user_id, n, unnest(range(0, CAST((n + 15) // 16 * 16 AS BIGINT))) AS j FROM (SELECT DISTINCT user_id, n FROM v)) SELECT z.user_id, CAST(j // 16 AS BIGINT) AS segment, CAST(j % 16 AS BIGINT) AS i, round(coalesce(value, 0.0), 6) + 0.0 AS v FROM z LEFT JOIN v ON v.user_id = z.user_id AND v.i = j")
def fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = value_series(spark, sf_dir).select("user_id", F.posexplode(sg.fixed_segments(F.col("samples"), 16)).alias("segment", "samples"))
    return _exploded(df.withColumn("segment", F.col("segment").cast("long")), "user_id", "segment")


_INTS = "WITH v AS (SELECT user_id, ts, CAST(floor(value) AS BIGINT) % 97 - 48 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", (F.floor("value").cast("long") % 97 - 48).alias("d"))


def _numbered(df: DataFrame) -> DataFrame:
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts")).cast("long")
    return df.select("user_id", i.alias("i"), F.col("decoded").cast("long").alias("decoded"))


@query(_INTS + " SELECT user_id, CAST(i AS BIGINT) AS i, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS decoded FROM v")
def first_difference_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(sg.first_difference(_codes(spark, sf_dir), "user_id", "ts", "d"))


@query(
    _INTS + ", a AS (SELECT *, first_value(d) OVER (PARTITION BY user_id ORDER BY i) AS d0 FROM v), b AS (SELECT *, CASE i WHEN 1 THEN 0 WHEN 2 THEN d - d0 ELSE d END AS e FROM a), c AS (SELECT *, sum(e) OVER (PARTITION BY user_id ORDER BY i) AS s FROM b) "
    "SELECT user_id, CAST(i AS BIGINT) AS i, CAST(d0 + sum(s) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS decoded FROM c"
)
def second_difference_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(sg.second_difference(_codes(spark, sf_dir), "user_id", "ts", "d"))


# --- spectra and quality ------------------------------------------------------------------------------------------------


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, freq, psd)"""
    df = leads64(spark, sf_dir).select("vec_id", arrow.power_spectrum(F.col("samples"), F.col("sampling_rate")).alias("s"))
    return df.select("vec_id", F.inline(F.arrays_zip("s.freqs", "s.psd")).alias("freq", "psd"))


@query(_DFT + " SELECT vec_id, round(freq, 6) AS freq, round(mag, 6) + 0.0 AS mag FROM s")
def fft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = leads64(spark, sf_dir).select("vec_id", arrow.magnitude_spectrum(F.col("samples"), F.col("sampling_rate")).alias("s"))
    return df.select("vec_id", F.inline(F.arrays_zip("s.freqs", "s.mags")).alias("freq", "mag")).select("vec_id", F.round("freq", 6).alias("freq"), _r("mag").alias("mag"))


@query(_DFT + " SELECT vec_id, round(freq, 6) AS freq, round(psd * 1000, 6) + 0.0 AS psd_milli FROM s")
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).select("vec_id", F.round("freq", 6).alias("freq"), _r(F.col("psd") * 1000).alias("psd_milli"))


@query(_DFT + " SELECT vec_id, round(freq, 6) AS freq, round(10 * log10(greatest(psd, 1e-20)), 3) + 0.0 AS db FROM s WHERE k > 0")
def spectrum_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the bin at 0 Hz is rounding noise once the mean is taken off
    return spectra(spark, sf_dir).where("freq > 0").select("vec_id", F.round("freq", 6).alias("freq"), _r(sg.spectrum_db(F.col("psd")), 3).alias("db"))


@query(
    _LEADS + ", q AS (SELECT vec_id, kurtosis_pop(x) AS k, count(*) AS n FROM p GROUP BY vec_id) SELECT vec_id, round(CASE WHEN n < 4 OR k IS NULL THEN 0.0 WHEN k < 0 THEN 0.0 WHEN k < 3 THEN k / 3 WHEN k <= 20 THEN 1.0 ELSE greatest(0.0, 1 - (k - 20) / 30) END, 6) AS kurtosis_sqi FROM q"
)
def kurtosis_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads64(spark, sf_dir).select("vec_id", F.round(sg.kurtosis_score(sg.kurtosis_of(F.col("samples")), F.size("samples")), 6).alias("kurtosis_sqi"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, power_ratio_sqi, baseline_sqi, snr_db)"""
    spectrum = leads64(spark, sf_dir).select("vec_id", arrow.power_spectrum(F.col("samples"), F.col("sampling_rate")).alias("s"))
    return spectrum.select("vec_id", sg.band_scores(F.col("s")).alias("b")).select("vec_id", "b.*")


_BANDS = _DFT + ", g AS (SELECT vec_id, coalesce(sum(psd) FILTER (freq BETWEEN 1 AND 40), 0) AS e, sum(psd) AS t, coalesce(sum(psd) FILTER (freq < 1), 0) AS b, coalesce(sum(psd) FILTER (freq >= 100), 0) AS n FROM s GROUP BY vec_id)"


@query(_BANDS + " SELECT vec_id, round(CASE WHEN t > 0 THEN greatest(0.0, least(1.0, e / t / 0.7)) ELSE 0.0 END, 6) + 0.0 AS power_ratio_sqi FROM g")
def power_ratio_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("vec_id", _r("power_ratio_sqi").alias("power_ratio_sqi"))


@query(_BANDS + " SELECT vec_id, round(CASE WHEN e > 0 THEN greatest(0.0, least(1.0, 1 - b / e)) ELSE 0.0 END, 6) + 0.0 AS baseline_sqi FROM g")
def baseline_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("vec_id", _r("baseline_sqi").alias("baseline_sqi"))


@query(_BANDS + " SELECT vec_id, round(CASE WHEN n <= 0 THEN 60.0 ELSE 10 * log10(e / n) END, 4) + 0.0 AS snr_db FROM g")
def snr_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("vec_id", _r("snr_db", 4).alias("snr_db"))


# --- recursive filters: in SQL as recursions over time, their sections by closed formulas ------------------------------------


def _filtered(name: str, f: Callable[[Column, Column], Column], steps: list[filter_sql.Step], digits: int = 4) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _exploded(leads64(spark, sf_dir).withColumn("samples", f(F.col("samples"), F.col("sampling_rate"))), "vec_id", digits=digits)

    run.__name__ = name
    query(filter_sql.zero_phase_sql(steps, 500, digits))(run)


_NOTCH = ("notch", 50.0, 30.0)
_filtered("lowpass", lambda s, fs: arrow.lowpass(s, fs, 40.0), [("low", 40.0, 4)])
_filtered("highpass", lambda s, fs: arrow.highpass(s, fs, 5.0), [("high", 5.0, 4)])
_filtered("bandpass", lambda s, fs: arrow.bandpass(s, fs, 5.0, 100.0), [("band", 5.0, 100.0, 4)])
_filtered("notch", arrow.notch, [_NOTCH])
_filtered("remove_baseline", arrow.remove_baseline, [("high", 0.5, 2)])
_filtered("diagnostic_filter", arrow.diagnostic_filter, [("band", 0.05, 150.0, 4), _NOTCH], 3)
_filtered("monitoring_filter", arrow.monitoring_filter, [("band", 0.67, 40.0, 4), _NOTCH])
_filtered("clean_default", arrow.clean, [("band", 0.5, 40.0, 4), _NOTCH])


@query(filter_sql.resample_sql(500, 250, 64))
def resample_250(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(leads64(spark, sf_dir).withColumn("samples", arrow.resample(F.col("samples"), F.col("sampling_rate"), 250)), "vec_id")


@query(filter_sql.resample_sql(500, 360, 64))
def resample_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(leads64(spark, sf_dir).withColumn("samples", arrow.resample(F.col("samples"), F.col("sampling_rate"), 360)), "vec_id")


# --- peaks and combined quality ----------------------------------------------------------------------------------------------


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leads as they are; those a kernel cannot take give nulls."""
    return table(spark, sf_dir, "leads").select("record_id", F.col("lead_no").cast("long").alias("lead_no"), "samples", "sampling_rate").distinct()


def _peaks(name: str, method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strips(spark, sf_dir).select("record_id", "lead_no", arrow.r_peaks(F.col("samples"), F.col("sampling_rate"), method).alias("p")).select("record_id", "lead_no", F.explode("p").alias("r_sample"))

    run.__name__ = name
    query()(run)


_peaks("r_peaks_pan_tompkins", "pan_tompkins")
_peaks("r_peaks_shannon", "shannon_energy")


@query()
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = strips(spark, sf_dir).select("record_id", "lead_no", arrow.quality(F.col("samples"), F.col("sampling_rate")).alias("q")).select("record_id", "lead_no", "q.*")
    return df.withColumn("quality", sg.quality_class(F.col("sqi")))


@query()
def hrv_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # intervals of hours, read as seconds: 4 Hz over a user's weeks would be millions of points
    arrays = rr(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("beat_no", "rr_ms"))), lambda x: F.lit(400.0) + F.pmod(x["rr_ms"], F.lit(800.0))).alias("rr"))
    return arrays.select("user_id", arrow.hrv_frequency(F.col("rr")).alias("h")).select("user_id", "h.*")


@query(filter_sql.segments_sql(16, 14, "tukey") + " SELECT vec_id, round((g * 14 + 8) / 500.0, 6) AS t, round(k * 500.0 / 16, 6) AS freq, round(10 * log10(greatest(psd, 1e-20)), 3) + 0.0 AS db FROM d WHERE k > 0")
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # segments of 16 samples, so that leads of 64 have several; the bin at 0 Hz is rounding noise once the mean is taken off
    df = leads64(spark, sf_dir).select("vec_id", arrow.spectrogram(F.col("samples"), F.col("sampling_rate"), 16).alias("s"))
    df = df.select("vec_id", "s.freqs", F.inline(F.arrays_zip("s.times", "s.db")).alias("t", "db"))
    df = df.select("vec_id", "t", F.inline(F.arrays_zip("freqs", "db")).alias("freq", "db")).where("freq > 0")
    return df.select("vec_id", F.round("t", 6).alias("t"), F.round("freq", 6).alias("freq"), _r("db", 3).alias("db"))


@query(filter_sql.segments_sql(24, 12, "hann") + " SELECT vec_id, round(k * 500.0 / 24, 6) AS freq, round(1000 * avg(psd), 6) + 0.0 AS psd_milli FROM d GROUP BY vec_id, k")
def welch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra over half-overlapping segments of 24 samples; the tail of the lead is dropped."""
    df = leads64(spark, sf_dir).select("vec_id", arrow.power_spectrum(F.col("samples"), F.col("sampling_rate"), 24).alias("s"))
    return df.select("vec_id", F.inline(F.arrays_zip("s.freqs", "s.psd")).alias("freq", "psd")).select("vec_id", F.round("freq", 6).alias("freq"), _r(F.col("psd") * 1000).alias("psd_milli"))


# --- plots as rows, detection ---------------------------------------------------------------------------------------------


@query(_GROUPS + " SELECT record_id, label, CAST((row_number() OVER w - 1) // 3 AS INTEGER) AS row, CAST((row_number() OVER w - 1) % 3 AS INTEGER) AS col FROM g WINDOW w AS (PARTITION BY record_id ORDER BY lead_no)")
def lead_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.lead_grid(lead_groups(spark, sf_dir), 3).select("record_id", "label", "row", "col")


@query(
    _GROUPS + ", sl AS (SELECT unnest([0,1,2,0,1,2,0,1,2,0,1,2,3]) AS row, unnest([0,0,0,1,1,1,2,2,2,3,3,3,0]) AS col, unnest(['I','II','III','aVR','aVL','aVF','V1','V2','V3','V4','V5','V6','II']) AS label), "
    "ids AS (SELECT DISTINCT record_id FROM g) SELECT ids.record_id, CAST(sl.row AS INTEGER) AS row, CAST(sl.col AS INTEGER) AS col, sl.label, CAST(coalesce(len(g.s), 0) AS BIGINT) AS n FROM ids CROSS JOIN sl LEFT JOIN g ON g.record_id = ids.record_id AND g.label = sl.label"
)
def sheet_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plotdata.sheet_12(lead_groups(spark, sf_dir))
    return df.select("record_id", "row", "col", "label", F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@query(
    _RR + ", a AS (SELECT user_id, avg(rr_ms) AS mean_rr, stddev_samp(rr_ms) AS sdnn, sqrt(avg(d * d)) AS rmssd, 100.0 * count(*) FILTER (abs(d) > 50) / count(d) AS pnn50, avg(hr) AS hr_mean, stddev_samp(d) / sqrt(2) AS sd1, stddev_samp(rr_ms + prev) / sqrt(2) AS sd2 FROM d GROUP BY user_id) "
    "SELECT user_id, round(mean_rr, 3) AS mean_rr, round(sdnn, 3) AS sdnn, round(rmssd, 3) AS rmssd, round(pnn50, 6) AS pnn50, round(hr_mean, 6) AS hr_mean, round(sd1, 3) AS sd1, round(sd2, 3) AS sd2 FROM a"
)
def hrv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plotdata.hrv_summary(rr(spark, sf_dir), "user_id")
    return df.select("user_id", *[F.round(c, 6 if c in ("pnn50", "hr_mean") else 3).alias(c) for c in df.columns[1:]])


@query(
    _RR + ", a AS (SELECT user_id, avg(rr_ms) AS m, stddev_samp(d) / sqrt(2) AS sd1, stddev_samp(rr_ms + prev) / sqrt(2) AS sd2 FROM d GROUP BY user_id), i AS (SELECT unnest(range(0, 100)) AS i) "
    "SELECT user_id, CAST(i AS BIGINT) AS i, round(m + (sd2 * cos(i * 2 * pi() / 99) - sd1 * sin(i * 2 * pi() / 99)) / sqrt(2), 2) AS x, round(m + (sd2 * cos(i * 2 * pi() / 99) + sd1 * sin(i * 2 * pi() / 99)) / sqrt(2), 2) AS y FROM a CROSS JOIN i"
)
def poincare_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plotdata.poincare_ellipse(plotdata.hrv_summary(rr(spark, sf_dir), "user_id"), "user_id")
    return df.select("user_id", F.col("i").cast("long").alias("i"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(
    _SERIES + ", m AS (SELECT pk.user_id, beat_no, r_sample / 10.0 AS t, value AS v, (r_sample - lag(r_sample) OVER (PARTITION BY pk.user_id ORDER BY beat_no)) * 100.0 AS rr_ms FROM pk JOIN v ON v.user_id = pk.user_id AND v.i = r_sample) "
    "SELECT user_id, CAST(beat_no AS BIGINT) AS beat_no, round(t, 6) AS t, round(v, 6) AS v, round(rr_ms, 6) AS rr_ms, round(60000.0 / rr_ms, 6) AS hr FROM m"
)
def peak_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plotdata.peak_markers(value_series(spark, sf_dir), "user_id")
    return df.select("user_id", F.col("beat_no").cast("long").alias("beat_no"), *[F.round(c, 6).alias(c) for c in ("t", "v", "rr_ms", "hr")])


_SAID = "list_transform({s}, lambda x: trim(concat_ws(' ', x.left_text, nullif(x.right_text, ''))))"
_ONCE = "WITH r AS (SELECT DISTINCT ON (record_id) * FROM records ORDER BY record_id, ingested_at)"


def _first_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as it was first sent."""
    r = table(spark, sf_dir, "records")
    return r.groupBy("record_id").agg(F.min_by(F.struct(*[c for c in r.columns if c != "record_id"]), "ingested_at").alias("r")).select("record_id", "r.*")


@query(
    _ONCE + " SELECT record_id, coalesce(nullif(concat_ws(chr(10), 'Name: ' || nullif(concat_ws(' ', nullif(trim(patient.first_name), ''), nullif(trim(patient.last_name), '')), ''), 'ID: ' || nullif(trim(patient.patient_id), ''), "
    "nullif(concat_ws('  ', 'Age: ' || patient.age, 'Sex: ' || nullif(trim(patient.sex), '')), ''), 'Date: ' || nullif(trim(recording.date), ''), CASE WHEN recording.acquisition.signal.sampling_rate <> 0 THEN 'Sample rate: ' || recording.acquisition.signal.sampling_rate || ' Hz' END, "
    "'Device: ' || nullif(concat_ws(' ', nullif(trim(recording.device.manufacturer), ''), nullif(trim(recording.device.model), '')), ''), nullif(concat_ws('  |  ', 'HR: ' || measurements.heart_rate || ' bpm', 'PR: ' || measurements.pr_interval || ' ms', "
    "'QRS: ' || measurements.qrs_duration || ' ms', 'QT: ' || measurements.qt_interval || ' ms', 'QTc: ' || measurements.qtc_bazett || ' ms', 'Axis: ' || measurements.qrs_axis || '\u00b0'), ''), "
    "'Interpretation: ' || CASE WHEN len(interpretation.statements) > 0 THEN array_to_string(" + _SAID.format(s="interpretation.statements[1:3]") + ", '; ') END), ''), 'ECG report') AS header FROM r"
)
def record_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.record_header(_first_sent(spark, sf_dir))


@query(
    _ONCE + ", s AS (SELECT record_id, nullif(trim(interpretation.severity), '') AS severity, nullif(trim(interpretation.source), '') AS source, coalesce(len(interpretation.statements), 0) AS n, " + _SAID.format(s="interpretation.statements") + " AS said FROM r) "
    "SELECT record_id, concat_ws(chr(10), 'Severity: ' || severity, 'Source: ' || source, CASE WHEN n > 0 THEN array_to_string(list_transform(said, lambda x: '- ' || x), chr(10)) WHEN severity IS NULL THEN 'No interpretation available' END) AS text FROM s"
)
def interpretation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.interpretation_text(_first_sent(spark, sf_dir))


# --- decoders: the tables written as files of each format, detected and decoded again -------------------------------------------


_FILES = (
    "WITH e AS (SELECT vec_id, [greatest(-2000, least(2000, CAST(round(CAST(x AS DOUBLE) * 200) AS BIGINT))) FOR x IN embedding] AS v FROM embeddings), "
    "w AS (SELECT vec_id // {n} AS rec, vec_id % {n} AS k, v, count(*) OVER (PARTITION BY vec_id // {n}) AS m FROM e), p AS (SELECT rec, k, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM w WHERE m = {n}) "
)
# steps to values, by what each format says of its own
_SCALED = {
    "beneheart_r12": "x * 1.0", "dicom_waveform": "x * 2.0 - 6.0", "edf": "x * 0.1 + 1.0", "ge_mac2000": "x * 2.5", "ge_muse_xml": "x * 4.88", "hl7_aecg": "x * 2.5 + 4.0", "ishne_holter": "x * 2.5", "mfer": "x * 0.5",
    "mortara_el250": "x / 200.0", "scp_ecg": "x * 1.0", "wfdb": "x / 500.0 - 10 / 500.0",
}
# the limb leads of one format follow from the first two and what is stored
_LIMBS = (
    ", q AS (SELECT rec, i, max(x) FILTER (k = 0) AS a, max(x) FILTER (k = 1) AS b, max(x) FILTER (k = 2) AS c, max(x) FILTER (k = 3) AS r, max(x) FILTER (k = 4) AS l, max(x) FILTER (k = 5) AS f FROM p GROUP BY rec, i), "
    "t AS (SELECT *, b - a - c AS three FROM q), u AS (SELECT rec, i, unnest(range(0, 6)) AS k, unnest([CAST(a AS DOUBLE), b, three, -r - floor((a + b) / 2), floor((a - three) / 2) - l, floor((b + three) / 2) - f]) AS x FROM t) "
)


def _decoder(form: str) -> None:
    from pulsegrid.plans import carriers
    from pulsegrid.sources import reader

    count = carriers.WRITERS[form][1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        decoded = reader.decode(carriers.files(spark, sf_dir, form))
        leads = sg.to_physical(reader.leads_of(decoded))
        return leads.select(
            F.regexp_extract("record_id", r"r(\d+)\.", 1).cast("long").alias("rec"), F.regexp_replace("label", "^EDF ", "").alias("label"), "units", F.col("sampling_rate").cast("long").alias("rate"), F.posexplode("samples").alias("i", "v")
        ).select("rec", "label", "units", "rate", F.col("i").cast("long").alias("i"), _r("v").alias("v"))

    unit = "mV" if form in ("mortara_el250", "wfdb") else "uV"
    label = "['I', 'II', 'III', 'aVR', 'aVL', 'aVF'][CAST(k + 1 AS BIGINT)]"
    rows, value = (_LIMBS, "x * 5.0") if form == "sierra_xml" else ("", _SCALED[form])
    run.__name__ = f"decode_{form}"
    query(_FILES.format(n=count) + f"{rows}SELECT CAST(rec AS BIGINT) AS rec, {label} AS label, '{unit}' AS units, CAST(500 AS BIGINT) AS rate, CAST(i AS BIGINT) AS i, round({value}, 6) + 0.0 AS v FROM {'u' if rows else 'p'}")(run)


for _form, *_ in FORMATS:
    _decoder(_form)


@query(
    "WITH n AS (SELECT " + ", ".join(f"count(*) // {n} AS n{n}" for n in (2, 6)) + " FROM embeddings), f AS (SELECT unnest(["
    + ", ".join(f"'{f}'" for f, *_ in FORMATS) + "]) AS form) SELECT form AS written, form AS detected, CAST(CASE form WHEN 'sierra_xml' THEN n6 ELSE n2 END AS BIGINT) AS files FROM f, n"
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all formats, by the format they were written in and the one that is detected; WFDB data files are left out."""
    from pulsegrid.plans import carriers
    from pulsegrid.sources import reader

    every = None
    for form in carriers.WRITERS:
        df = carriers.files(spark, sf_dir, form).where("path NOT LIKE '%.dat'").withColumn("written", F.lit(form))
        every = df if every is None else every.unionByName(df)
    return reader.detect(every).groupBy("written", F.col("source_format").alias("detected")).agg(F.count("*").alias("files"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{n}', '{d}', {len(e)})" for f, n, d, e in FORMATS) + ") AS v(source_format, name, description, n_extensions)")
def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(FORMATS, "source_format string, name string, description string, extensions array<string>").select("source_format", "name", "description", F.size("extensions").alias("n_extensions"))
