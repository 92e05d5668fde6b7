"""Implausible readings, judged against what the same device normally delivers (problem 6).

Normal behaviour of a device is low-rank: its leads are cut into windows of equal length, the rows of a profile matrix, and
robust principal components of that matrix (the rows centred and scaled robustly, then winsorised, so that spikes cannot
bend them) span what it usually shows. What a lead has outside that span is its sparse part; a lead is a spike where the
largest part of it, in millivolts, exceeds by far what the device's leads normally have. Constant runs, ranges and sampling
rates are tested on their own.

Work: one pass gathers per-lead figures and, per device, the second moments of its windows, summed in each task before the
shuffle (their number does not grow with the rows); a second pass projects the windows. Reference values are quantiles over
all leads of the device. No lead is sampled.

Defined results: null or empty samples have no reading faults but may have a wrong rate; a null sample is no finite number;
a lead without a known unit takes the power of a thousand that brings it nearest to the device's usual amplitude; a null
device counts as one source; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import cut, local_if_small
from pulsegrid.operators.units import lead_scales, lead_values

#: Samples of a window, and the components that count as normal.
WINDOW, RANK = 16, 6
#: Readings beyond this many millivolts either way are impossible.
LIMIT_MV = 50.0
#: A spike has this many times the 90 % quantile of its device, outside the normal span and as a deviation from the median.
SPARSE_FACTOR, RANGE_FACTOR = 1.8, 1.8
#: A stuck stretch is this many times the device's 90 % quantile of longest constant runs, and so many samples at least.
RUN_FACTOR, RUN_LEAST = 3.0, 24
#: A device runs at each rate that at least this share of its leads have, and its commonest.
RATE_SHARE, RATE_LEAST = 0.08, 3
#: Devices up to which their references are broadcast.
DEVICE_BOUND = 20_000

_FIGURES = "record_id string, lead_no int, device string, rate int, n int, finite boolean, level double, spread double, deviation double, top double, run int, x double, scale double"
_UPPER = np.triu_indices(WINDOW)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their samples as one matrix, for each length in the batch."""
    col = batch.column("samples")
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.diff(offsets)
    if col.null_count:
        sizes = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def _longest_run(m: np.ndarray) -> np.ndarray:
    """Longest stretch of one unchanging value in each row."""
    rows, n = m.shape
    change = np.ones((rows, n + 1), bool)
    change[:, 1:n] = m[:, 1:] != m[:, :-1]
    at = np.where(change, np.arange(n + 1), 0)
    start = np.maximum.accumulate(at[:, :-1], axis=1)
    return (np.arange(n) - start + 1).max(1)


def _robust(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with medians in place of what is not finite, their medians, and the 80 % quantile of their deviations."""
    bad = ~np.isfinite(m)
    if bad.any():
        m = np.where(bad, np.nan, m)
        empty = bad.all(1)
        m[empty] = 0.0
        level = np.nanmedian(m, axis=1)
        m = np.where(np.isnan(m), level[:, None], m)
    else:
        level = np.median(m, axis=1)
    dev = np.abs(m - level[:, None])
    k = int(0.8 * (m.shape[1] - 1))
    return m, level, np.partition(dev, k, axis=1)[:, k]


def _windows(m: np.ndarray, level: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """(row, window, sample) of the scaled leads; the last window of a lead ends at its last sample."""
    n = m.shape[1]
    if n < WINDOW:
        return np.empty((len(m), 0, WINDOW))
    starts = np.unique(np.append(np.arange(0, n - WINDOW + 1, WINDOW), n - WINDOW))
    z = (m - level[:, None]) / np.where(spread > 0, spread, 1.0)[:, None]
    return z[:, starts[:, None] + np.arange(WINDOW)]


def lead_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per-lead figures, and as rows with a null record_id the second moments of each device's windows in this task."""
    moments: dict[str, np.ndarray] = {}
    for batch in batches:
        size = batch.num_rows
        x = batch.column("x").to_numpy(zero_copy_only=False).astype(float)
        off = batch.column("off").to_numpy(zero_copy_only=False).astype(float)
        device = batch.column("device").to_pylist()
        n, run = np.zeros(size, np.int32), np.zeros(size, np.int32)
        finite = np.ones(size, bool)
        level, spread, deviation, top = (np.zeros(size) for _ in range(4))
        for rows, m in _by_length(batch):
            n[rows], run[rows] = m.shape[1], _longest_run(m)
            ok = np.isfinite(m)
            finite[rows] = ok.all(1)
            with np.errstate(invalid="ignore", over="ignore"):
                top[rows] = np.where(ok, np.abs(m * x[rows][:, None] + off[rows][:, None]), 0).max(1)
            m, lv, sp = _robust(m)
            level[rows], spread[rows] = lv, sp * x[rows]
            deviation[rows] = np.abs(m - lv[:, None]).max(1) * x[rows]
            w = np.clip(_windows(m, lv, sp), -4, 4)
            dev = np.array([device[r] for r in rows], object)
            for d in set(dev):
                own = w[dev == d].reshape(-1, WINDOW)
                moments[d] = moments.get(d, 0) + own.T @ own
        out = {c: batch.column(c) for c in ("record_id", "lead_no", "device", "rate")}
        out |= {"n": n, "finite": finite, "level": level, "spread": spread, "deviation": deviation, "top": top, "run": run, "x": x, "scale": batch.column("scale")}
        yield pa.RecordBatch.from_pydict({**out, "cell": pa.nulls(size, pa.int32()), "moment": pa.nulls(size, pa.float64())})
    rows = [(d, k, float(v)) for d, g in moments.items() for k, v in enumerate(g[_UPPER])]
    if rows:
        d, k, v = zip(*rows, strict=True)
        none = len(rows)
        blank = {"record_id": pa.nulls(none, pa.string()), "lead_no": pa.nulls(none, pa.int32()), "device": pa.array(d), "rate": pa.nulls(none, pa.int32())}
        blank |= {"n": pa.nulls(none, pa.int32()), "finite": pa.nulls(none, pa.bool_())} | {c: pa.nulls(none, pa.float64()) for c in ("level", "spread", "deviation", "top")}
        yield pa.RecordBatch.from_pydict({**blank, "run": pa.nulls(none, pa.int32()), "x": pa.nulls(none, pa.float64()), "scale": pa.nulls(none, pa.float64()), "cell": pa.array(k, pa.int32()), "moment": pa.array(v)})


def principal_components(cells: pd.DataFrame) -> list[float]:
    """The leading components of a device, row by row, from the summed second moments of its windows."""
    g = np.zeros((WINDOW, WINDOW))
    c = cells.sort_values("cell")
    g[_UPPER] = 0.0
    k = c["cell"].to_numpy()
    g[_UPPER[0][k], _UPPER[1][k]] = c["moment"].to_numpy()
    g = np.triu(g) + np.triu(g, 1).T
    _, vectors = np.linalg.eigh(g)
    return vectors[:, ::-1][:, :RANK].T.ravel().tolist()


def sparse_part(batches: Iterator[pa.RecordBatch], bases: dict[str, list[float]]) -> Iterator[pa.RecordBatch]:
    """(record_id, lead_no, sparse): the largest part of each lead outside its device's normal span, in its unit times x."""
    mats = {d: np.array(b).reshape(RANK, WINDOW) for d, b in bases.items()}
    for batch in batches:
        x = batch.column("x").to_numpy(zero_copy_only=False).astype(float)
        device = batch.column("device").to_pylist()
        sparse = np.zeros(batch.num_rows)
        for rows, m in _by_length(batch):
            m, lv, sp = _robust(m)
            w = _windows(m, lv, sp)
            if not w.shape[1]:
                sparse[rows] = np.abs(m - lv[:, None]).max(1) * x[rows]
                continue
            dev = np.array([device[r] for r in rows], object)
            for d in set(dev):
                own, at = w[dev == d], rows[dev == d]
                b = mats[d]
                # the span is met with winsorised coordinates, so a spike cannot be explained by its own size
                part = own - (np.clip(own, -4, 4) @ b.T) @ b
                sparse[at] = np.abs(part).max((1, 2)) * np.where(sp[dev == d] > 0, sp[dev == d], 1.0) * x[at]
        yield pa.RecordBatch.from_pydict({"record_id": batch.column("record_id"), "lead_no": batch.column("lead_no"), "sparse": sparse})


def lead_faults(leads: DataFrame) -> DataFrame:
    """(record_id, lead_no, fault) with fault one of spike, stuck, impossible, rate; distinct."""
    spark = leads.sparkSession
    rows = lead_values(leads, extra=("samples", "sampling_rate", "offset_value"), unknown=True).join(lead_scales(leads), "notation", "left")
    rows = rows.select(
        "record_id", "lead_no", F.coalesce("entity", F.lit("")).alias("device"), F.col("sampling_rate").cast("int").alias("rate"),
        F.coalesce("samples", F.array().cast("array<double>")).alias("samples"), "x", F.when(F.col("inverse"), 0.0).otherwise(F.coalesce("offset_value", F.lit(0.0))).alias("off"), "scale",
    )
    figures = cut(rows.mapInArrow(lead_figures, _FIGURES + ", cell int, moment double"))
    cells = figures.where("cell IS NOT NULL").groupBy("device", "cell").agg(F.sum("moment").alias("moment"))
    bases = cells.groupBy("device").applyInPandas(lambda key, g: pd.DataFrame({"device": [key[0]], "basis": [principal_components(g)]}), "device string, basis array<double>")
    # one basis a device: RANK * WINDOW numbers; devices are equipment, not data, and their number is checked
    if bases.limit(DEVICE_BOUND + 1).count() > DEVICE_BOUND:
        raise ValueError(f"more than {DEVICE_BOUND} devices; raise DEVICE_BOUND with the memory of the executors")
    table = spark.sparkContext.broadcast({r.device: list(r.basis) for r in bases.collect()})
    sparse = rows.mapInArrow(lambda b: sparse_part(b, table.value), "record_id string, lead_no int, sparse double")

    f = figures.where("cell IS NULL").drop("cell", "moment")
    # what a device usually shows, from leads whose unit is known
    usual = f.where("scale IS NOT NULL AND spread > 0 AND finite").groupBy("device").agg(F.percentile_approx(F.log(F.col("spread") * F.col("scale")), 0.5, 1000).alias("usual"))
    f = f.join(local_if_small(usual, DEVICE_BOUND), "device", "left")
    nearest = F.pow(F.lit(1000.0), F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.round((F.col("usual") - F.log("spread")) / F.log(F.lit(1000.0))))))
    f = f.withColumn("to_mv", F.coalesce("scale", F.when(F.col("spread") > 0, nearest)) / 1e6)
    sparse = sparse.groupBy("record_id", "lead_no").agg(F.max("sparse").alias("sparse"))
    f = f.join(sparse, ["record_id", "lead_no"], "left").withColumns({k: F.col(k) * F.col("to_mv") for k in ("sparse", "deviation", "top")})
    f = f.withColumn("impossible", (F.col("n") > 0) & (~F.col("finite") | (F.col("top") > LIMIT_MV)))
    f = cut(f)
    normal = ~F.col("impossible") & (F.col("n") > 0)
    reference = f.groupBy("device").agg(
        *[F.percentile_approx(F.when(normal, F.col(c)), 0.9, 1000).alias(f"{c}_q") for c in ("sparse", "deviation", "run")]
    )
    rates = f.groupBy("device", "rate").count()
    totals = rates.groupBy("device").agg(F.sum("count").alias("total"), F.max("count").alias("most"))
    legal = rates.join(totals, "device").where((F.col("rate") > 0) & ((F.col("count") == F.col("most")) | ((F.col("count") >= RATE_SHARE * F.col("total")) & (F.col("count") >= RATE_LEAST))))
    reference = reference.join(legal.groupBy("device").agg(F.collect_set("rate").alias("rates")), "device", "left")
    f = f.join(local_if_small(reference, DEVICE_BOUND), "device", "left")
    stuck = (F.col("run") >= F.greatest(F.lit(RUN_LEAST), F.col("run_q") * RUN_FACTOR)) | ((F.col("run") == F.col("n")) & (F.col("n") >= RUN_LEAST))
    spike = (F.col("sparse") > SPARSE_FACTOR * F.col("sparse_q")) & (F.col("deviation") > RANGE_FACTOR * F.col("deviation_q"))
    reading = F.when(F.col("n") > 0, F.when(F.col("impossible"), "impossible").when(stuck, "stuck").when(spike, "spike"))
    rate = F.when(F.col("rate").isNotNull() & ~F.coalesce(F.array_contains("rates", F.col("rate")), F.lit(False)), "rate")
    found = f.select("record_id", F.col("lead_no").cast("long").alias("lead_no"), F.explode(F.array(reading, rate)).alias("fault"))
    return found.where("fault IS NOT NULL").distinct()
