"""The kernels as Arrow UDFs on columns of samples; leads of equal length and rate in a batch are one matrix."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as k

METHODS = {"pan_tompkins": k.peaks_pan_tompkins, "shannon_energy": k.peaks_shannon}


def by_shape(samples: pd.Series, fs: pd.Series, kernel: Callable[[np.ndarray, int], object], errors: list | None = None) -> list:
    """The kernel's result for each row; null, empty and rateless rows give None. ``kernel`` gives one result a row.

    Rows the kernel cannot take (too short for a filter, a cut-off beyond half their rate, a sample that is no finite number)
    give None as well, so one bad lead fails no job; what it said goes to the same place of ``errors``.
    """
    out: list = [None] * len(samples)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (s, f) in enumerate(zip(samples, fs, strict=True)):
        if s is not None and len(s) and f is not None and f == f and f > 0:
            groups.setdefault((len(s), int(f)), []).append(i)
        elif errors is not None and s is not None:
            errors[i] = "no samples or no sampling rate"
    for (_, f), rows in groups.items():
        m = np.array([np.asarray(samples.iloc[i], float) for i in rows])
        finite = np.isfinite(m).all(1)
        if not finite.all():
            for i in np.array(rows)[~finite].tolist() if errors is not None else ():
                errors[i] = "a sample is no finite number"
            rows, m = np.array(rows)[finite].tolist(), m[finite]
            if not rows:
                continue
        try:
            results = kernel(m, f)
        except ValueError as e:
            if errors is not None:
                for i in rows:
                    errors[i] = str(e)
            continue
        for i, r in zip(rows, results, strict=True):
            out[i] = r
    return out


def _udf(kernel: Callable, schema: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(schema)
    def run(samples: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series(by_shape(samples, fs, kernel))

    @F.pandas_udf(schema)
    def run_struct(samples: pd.Series, fs: pd.Series) -> pd.DataFrame:
        rows = by_shape(samples, fs, kernel)
        names = [p.split()[0] for p in schema.split(", ")]
        return pd.DataFrame([r if r is not None else dict.fromkeys(names) for r in rows], columns=names)

    return run_struct if "," in schema else run


def outcome(kernel: Callable[[np.ndarray, int], object]) -> Callable[[Column, Column], Column]:
    """A filter kernel as struct<samples, error>: the filtered lead, or why there is none."""

    @F.pandas_udf("samples array<double>, error string")
    def run(samples: pd.Series, fs: pd.Series) -> pd.DataFrame:
        errors: list = [None] * len(samples)
        return pd.DataFrame({"samples": by_shape(samples, fs, kernel, errors), "error": errors})

    return run


def lowpass(samples: Column, fs: Column, cutoff: float, order: int = 4) -> Column:
    return _udf(partial(k.lowpass, cutoff=cutoff, order=order), "array<double>")(samples, fs)


def highpass(samples: Column, fs: Column, cutoff: float, order: int = 4) -> Column:
    return _udf(partial(k.highpass, cutoff=cutoff, order=order), "array<double>")(samples, fs)


def bandpass(samples: Column, fs: Column, low: float, high: float, order: int = 4) -> Column:
    return _udf(partial(k.bandpass, low=low, high=high, order=order), "array<double>")(samples, fs)


def notch(samples: Column, fs: Column, freq: float = 50.0, quality: float = 30.0) -> Column:
    return _udf(partial(k.notch, freq=freq, quality=quality), "array<double>")(samples, fs)


def remove_baseline(samples: Column, fs: Column, cutoff: float = 0.5, order: int = 2) -> Column:
    return highpass(samples, fs, cutoff, order)


def _band_then_notch(low: float, high: float, freq: float) -> Callable[[Column, Column], Column]:
    # one UDF for both steps: the lead crosses to Python once
    return _udf(lambda m, f: k.notch(k.bandpass(m, f, low, high), f, freq), "array<double>")


def diagnostic_filter(samples: Column, fs: Column, notch_freq: float = 50.0) -> Column:
    return _band_then_notch(0.05, 150.0, notch_freq)(samples, fs)


def monitoring_filter(samples: Column, fs: Column, notch_freq: float = 50.0) -> Column:
    return _band_then_notch(0.67, 40.0, notch_freq)(samples, fs)


def _third_party(library: str, call: Callable[[object, np.ndarray, int], np.ndarray]) -> Callable[[np.ndarray, int], np.ndarray]:
    """A cleaner of another library, row by row; where the library is absent or fails, the lead comes back as it was."""

    def run(m: np.ndarray, f: int) -> np.ndarray:
        out = m.copy()
        for k, x in enumerate(m):
            try:
                out[k] = call(importlib.import_module(library), x, f)
            except Exception:  # noqa: BLE001  whatever it raises, the lead stays
                out[k] = x
        return out

    return run


def _biosppy(lib: object, x: np.ndarray, f: int) -> np.ndarray:
    return lib.ecg.ecg(signal=x, sampling_rate=f, show=False)["filtered"]


def _neurokit(lib: object, x: np.ndarray, f: int) -> np.ndarray:
    return lib.ecg_clean(x, sampling_rate=f, method="neurokit")


_CLEANERS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "default": lambda m, f: k.notch(k.bandpass(m, f, 0.5, 40.0), f, 50.0),
    "biosppy": _third_party("biosppy.signals", _biosppy),
    "neurokit2": _third_party("neurokit2", _neurokit),
}
_CLEANERS["combined"] = lambda m, f: _CLEANERS["neurokit2"](_CLEANERS["biosppy"](m, f), f)


def clean(samples: Column, fs: Column, method: str = "default", weights: str | None = None) -> Column:
    """Cleaning by name: ``default``, ``biosppy``, ``neurokit2``, ``combined`` or ``deepfade``.

    The second to fourth call a library of that name; without it the lead is not filtered. The last is the neural denoiser of
    :mod:`pulsegrid.functions.denoise` and needs a file of weights.
    """
    if method == "deepfade":
        from pulsegrid.functions.denoise import denoise

        return denoise(samples, fs, weights)
    if method not in _CLEANERS:
        raise ValueError(f"unknown cleaning method {method!r}; choose from {sorted([*_CLEANERS, 'deepfade'])}")
    return _udf(_CLEANERS[method], "array<double>")(samples, fs)


def resample(samples: Column, fs: Column, target: int) -> Column:
    if target <= 0:
        raise ValueError("the target rate must be positive")
    return _udf(lambda m, f: k.resample(m, f, target), "array<double>")(samples, fs)


def r_peaks(samples: Column, fs: Column, method: str = "pan_tompkins") -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose from {sorted(METHODS)}")
    return _udf(METHODS[method], "array<int>")(samples, fs)


def _spectrum_udf(nperseg: int | None) -> Callable:
    def run(m: np.ndarray, f: int) -> list[dict]:
        freqs, psd = k.welch(m, f, nperseg)
        return [{"freqs": freqs, "psd": p} for p in psd]

    return _udf(run, "freqs array<double>, psd array<double>")


def power_spectrum(samples: Column, fs: Column, nperseg: int | None = None) -> Column:
    """struct<freqs, psd>"""
    return _spectrum_udf(nperseg)(samples, fs)


def _magnitude_udf() -> Callable:
    def run(m: np.ndarray, f: int) -> list[dict]:
        freqs, mags = k.magnitude_spectrum(m, f)
        return [{"freqs": freqs, "mags": p} for p in mags]

    return _udf(run, "freqs array<double>, mags array<double>")


def magnitude_spectrum(samples: Column, fs: Column) -> Column:
    """struct<freqs, mags>"""
    return _magnitude_udf()(samples, fs)


def _spectrogram_udf(nperseg: int | None = None) -> Callable:
    def run(m: np.ndarray, f: int) -> list[dict]:
        return [dict(zip(("times", "freqs", "db"), (t, q, [*d]), strict=True)) for t, q, d in (k.spectrogram(x, f, nperseg) for x in m)]

    return _udf(run, "times array<double>, freqs array<double>, db array<array<double>>")


def spectrogram(samples: Column, fs: Column, nperseg: int | None = None) -> Column:
    """struct<times, freqs, db>, db by time and frequency."""
    return _spectrogram_udf(nperseg)(samples, fs)


def _quality_udf() -> Callable:
    def run(m: np.ndarray, f: int) -> list[dict]:
        scores = k.quality_scores(m, f)
        return [{c: float(v[i]) for c, v in scores.items()} for i in range(len(m))]

    return _udf(run, "kurtosis_sqi double, power_ratio_sqi double, regularity_sqi double, baseline_sqi double, sqi double, snr_db double")


def quality(samples: Column, fs: Column) -> Column:
    """struct of the four quality scores, their mean ``sqi`` and ``snr_db``; one spectrum and one peak search serve all."""
    return _quality_udf()(samples, fs)


def _hrv_udf(rate: float) -> Callable:
    @F.pandas_udf("vlf_power double, lf_power double, hf_power double, total_power double, lf_hf_ratio double")
    def run(rr: pd.Series) -> pd.DataFrame:
        names = ["vlf_power", "lf_power", "hf_power", "total_power", "lf_hf_ratio"]
        return pd.DataFrame([k.hrv_frequency(np.asarray(r, float), rate) if r is not None else dict.fromkeys(names) for r in rr], columns=names)

    return run


def hrv_frequency(rr_ms: Column, rate: float = 4.0) -> Column:
    """struct of band powers of an array of RR intervals."""
    return _hrv_udf(rate)(rr_ms)


def register(spark: SparkSession) -> list[str]:
    """Makes the kernels callable from SQL as ecg_<name>(samples, fs, parameters..); returns the names.

    Parameters of a filter (cut-offs, order, target rate) are arguments of the call and may differ by row.
    """
    array = "array<double>"

    def with_parameters(kernel: Callable, casts: tuple[type, ...], least: int) -> Callable:
        @F.pandas_udf(array)
        def run(samples: pd.Series, fs: pd.Series, *given: pd.Series) -> pd.Series:
            if len(given) < least:
                raise ValueError(f"needs {least} parameters")
            out: list = [None] * len(samples)
            rows = list(zip(*given, strict=True)) if given else [()] * len(samples)
            for values in dict.fromkeys(r for r in rows if all(v is not None and v == v for v in r)):
                own = [i for i, r in enumerate(rows) if r == values]
                part = by_shape(samples.iloc[own], fs.iloc[own], lambda m, f, v=values: kernel(m, f, *[c(x) for c, x in zip(casts, v, strict=False)]))
                for i, r in zip(own, part, strict=True):
                    out[i] = r
            return pd.Series(out)

        return run

    filters = {
        "lowpass": (k.lowpass, (float, int), 1), "highpass": (k.highpass, (float, int), 1), "bandpass": (k.bandpass, (float, float, int), 2), "notch": (k.notch, (float, float), 0),
        "remove_baseline": (lambda m, f, cutoff=0.5, order=2: k.highpass(m, f, cutoff, order), (float, int), 0), "resample": (k.resample, (int,), 1),
        "monitoring_filter": (lambda m, f, freq=50.0: k.notch(k.bandpass(m, f, 0.67, 40.0), f, freq), (float,), 0), "diagnostic_filter": (lambda m, f, freq=50.0: k.notch(k.bandpass(m, f, 0.05, 150.0), f, freq), (float,), 0),
        "clean": (_CLEANERS["default"], (), 0),
    }
    for name, (kernel, casts, least) in filters.items():
        spark.udf.register(f"ecg_{name}", with_parameters(kernel, casts, least))
    others = {
        "r_peaks": _udf(k.peaks_pan_tompkins, "array<int>"), "r_peaks_shannon": _udf(k.peaks_shannon, "array<int>"), "power_spectrum": _spectrum_udf(None), "magnitude_spectrum": _magnitude_udf(),
        "spectrogram": _spectrogram_udf(), "quality": _quality_udf(), "hrv_frequency": _hrv_udf(4.0),
    }
    for name, udf in others.items():
        spark.udf.register(f"ecg_{name}", udf)
    return [f"ecg_{n}" for n in (*filters, *others)]
