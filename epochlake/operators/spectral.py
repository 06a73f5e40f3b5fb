"""Spectral kernels: NumPy on whole traces in Arrow batches, and direct Fourier sums as column expressions.

A trace is a row (keys..., w array<double>).  Wavelets (and, up to CACHED_BYTES, their transforms) are made once per
Python process and each trace's transform once, whatever the number of frequencies; no shuffle takes place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cycles(freqs: np.ndarray, method: str = "custom", fixed: float = 5.0, factor: float = 1.0, least: float = 6.0) -> np.ndarray:
    f = np.asarray(freqs, dtype=float)
    if method == "fixed":
        return np.full_like(f, fixed)
    if method == "adaptive":
        return f * factor
    if method == "hybrid":
        return np.maximum(least, f * factor)
    if method == "custom":
        return np.where((f >= 3) & (f <= 7), 3 + (f - 3) / 4, 3.0)
    raise ValueError(f"unknown cycles policy {method!r}")


def morlet(f: float, fs: float, n_cycles: float) -> np.ndarray:
    """Zero-mean complex Morlet wavelet of five standard deviations each side, norm sqrt(2)."""
    sigma = n_cycles / (2 * np.pi * f)
    half = np.arange(0, 5 * sigma, 1 / fs)
    t = np.concatenate([-half[:0:-1], half])
    w = (np.exp(2j * np.pi * f * t) - np.exp(-2 * (np.pi * f * sigma) ** 2)) * np.exp(-(t**2) / (2 * sigma**2))
    return w * np.sqrt(2) / np.linalg.norm(w)


def same_convolution(x: np.ndarray, kernels: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Centred convolution of one trace with each kernel, as long as the trace, one after the other; the trace is transformed
    once."""
    n = len(x) + max(map(len, kernels)) - 1
    size = 1 << max(n - 1, 1).bit_length()
    fx = np.fft.fft(x, size)
    for k in kernels:
        start = (len(k) - 1) // 2
        yield np.fft.ifft(fx * np.fft.fft(k, size))[start : start + len(x)]


#: Kernels of more bytes are transformed anew for each trace.
CACHED_BYTES = 64 << 20


@lru_cache(maxsize=4)
def _bank(kind: str, freqs: tuple, fs: float, n_cycles: tuple) -> list[np.ndarray]:
    """The wavelets of a grid, made once a process."""
    if kind == "unit":
        return unit_wavelets(np.array(freqs), fs, np.array(n_cycles))
    return [morlet(f, fs, c) for f, c in zip(freqs, n_cycles, strict=True)]


@lru_cache(maxsize=4)
def _bank_spectra(kind: str, freqs: tuple, fs: float, n_cycles: tuple, size: int) -> np.ndarray:
    return np.array([np.fft.fft(k, size) for k in _bank(kind, freqs, fs, n_cycles)])


def wavelet_rows(kind: str, x: np.ndarray, freqs: np.ndarray, fs: float, n_cycles: np.ndarray) -> Iterator[np.ndarray]:
    """|x * W|**2 of one frequency after the other: the trace is transformed once, the kernels once for all traces of a length
    (beyond CACHED_BYTES one at a time).  Only the caller keeps what it has seen."""
    key = (kind, tuple(np.asarray(freqs, dtype=float).tolist()), float(fs), tuple(np.asarray(n_cycles, dtype=float).tolist()))
    kernels = _bank(*key)
    size = 1 << max(len(x) + max(map(len, kernels)) - 2, 1).bit_length()
    if len(kernels) * size * 16 > CACHED_BYTES:
        for c in same_convolution(x, kernels):
            yield c.real**2 + c.imag**2
        return
    both = np.fft.ifft(np.fft.fft(x, size) * _bank_spectra(*key, size))
    for c, k in zip(both, kernels, strict=True):
        c = c[(len(k) - 1) // 2 : (len(k) - 1) // 2 + len(x)]
        yield c.real**2 + c.imag**2


def wavelet_power(kind: str, x: np.ndarray, freqs: np.ndarray, fs: float, n_cycles: np.ndarray) -> np.ndarray:
    """wavelet_rows as an array [frequency, sample]."""
    out = np.empty((len(freqs), len(x)))
    for i, row in enumerate(wavelet_rows(kind, x, freqs, fs, n_cycles)):
        out[i] = row
    return out


def morlet_power(x: np.ndarray, freqs: np.ndarray, fs: float, n_cycles: np.ndarray) -> np.ndarray:
    return wavelet_power("morlet", x, freqs, fs, n_cycles)


def unit_wavelets(freqs: np.ndarray, fs: float, n_cycles: np.ndarray) -> list[np.ndarray]:
    """Complex Morlet wavelets of unit energy (by trapezoids) on one time axis of six of the largest standard deviations."""
    sigma = n_cycles / (2 * np.pi * freqs)
    n = int(6 * sigma.max() * fs) | 1
    t = np.arange(-((n + 1) // 2), n // 2 + 1) / fs
    w = np.pi**-0.25 * np.exp(2j * np.pi * freqs[:, None] * t - 0.5 * (t / sigma[:, None]) ** 2)
    energy = np.abs(w) ** 2
    return list(w / np.sqrt((energy[:, 1:] + energy[:, :-1]).sum(axis=1, keepdims=True) / 2 / fs))


def bank_power(x: np.ndarray, freqs: np.ndarray, fs: float, n_cycles: np.ndarray) -> np.ndarray:
    """Power by convolution with unit_wavelets, as long as the trace; a trace shorter than the wavelets is an error."""
    if len(x) < len(_bank("unit", tuple(freqs.tolist()), float(fs), tuple(n_cycles.tolist()))[0]):
        raise ValueError("trace shorter than the wavelets")
    return wavelet_power("unit", x, freqs, fs, n_cycles)


def centre_wavelet(n: int, f: float, fs: float, n_cycles: float) -> np.ndarray:
    """Complex Gaussian wavelet about sample n // 2 of n, its weights adding up to one."""
    angle = 2 * np.pi * f / fs * (np.arange(n) - n // 2)
    weight = np.exp(-0.5 * (angle / n_cycles) ** 2)  # time over spread is angle over cycles
    return weight / weight.sum() * np.exp(-1j * angle)


@lru_cache(maxsize=8)
def _centre_bank(n: int, freqs: tuple, fs: float, n_cycles: tuple) -> np.ndarray:
    return np.array([centre_wavelet(n, f, fs, c) for f, c in zip(freqs, n_cycles, strict=True)])


def centre_power(x: np.ndarray, freqs: np.ndarray, fs: float, n_cycles: np.ndarray) -> np.ndarray:
    """Power of each frequency at the middle sample of x alone: one product, no transform of the rest.  For event windows."""
    if 16 * len(x) * len(freqs) <= CACHED_BYTES:
        return np.abs(_centre_bank(len(x), tuple(freqs), fs, tuple(n_cycles)) @ x) ** 2
    return np.array([abs(centre_wavelet(len(x), f, fs, c) @ x) ** 2 for f, c in zip(freqs, n_cycles, strict=True)])


def morlet_by_scale(scale: float, n: int, w: float = 5.0) -> np.ndarray:
    """Complex Morlet wavelet by scale, on min(10 scale, n) samples."""
    size = min(10 * scale, n)
    x = np.arange(0, size) - (size - 1.0) / 2
    return np.exp(1j * w * x / scale) * np.exp(-0.5 * (x / scale) ** 2) * np.pi**-0.25 * np.sqrt(1 / scale)


def cwt_power(x: np.ndarray, freqs: np.ndarray, fs: float) -> np.ndarray:
    """|CWT|**2 at scales fs / f with centre parameter 5: an approximate scale, so the analysed frequency is about 0.8 f."""
    kernels = [np.conj(morlet_by_scale(fs / f, len(x)))[::-1] for f in freqs]
    return np.array([np.abs(c) ** 2 for c in same_convolution(x, kernels)])


def segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    size = min(size, len(x))
    step = max(size - min(overlap, size - 1), 1)
    return np.stack([x[i : i + size] for i in range(0, len(x) - size + 1, step)])


def segment_power(x: np.ndarray, fs: float, size: int, overlap: int, window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, [segment, frequency]) one-sided power density of mean-free, windowed segments."""
    s = segments(x, size, overlap)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.shape[1]) / s.shape[1]) if window is None else window
    p = np.abs(np.fft.rfft((s - s.mean(axis=1, keepdims=True)) * w)) ** 2 / (fs * (w**2).sum())
    p[:, 1 : None if s.shape[1] % 2 else -1] *= 2
    return np.fft.rfftfreq(s.shape[1], 1 / fs), p


def welch(x: np.ndarray, fs: float, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    f, p = segment_power(x, fs, size, min(size, len(x)) // 2)
    return f, p.mean(axis=0)


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    k = np.arange(n)
    edge = share * n / 2
    ramp = np.minimum(1, np.minimum(k, n - k) / edge) if edge else np.ones(n)
    return 0.5 * (1 - np.cos(np.pi * ramp))


def stft(x: np.ndarray, fs: float, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f, p = segment_power(x, fs, size, overlap, tukey(min(size, len(x))))
    step = min(size, len(x)) - min(overlap, min(size, len(x)) - 1)
    return f, (np.arange(len(p)) * step + min(size, len(x)) / 2) / fs, p.T


def _below(diagonal: list[float], squares: list[float], x: float) -> int:
    """Eigenvalues below x of a symmetric tridiagonal matrix (squares: of its off-diagonal, the first 0): negative pivots."""
    count, q = 0, 1.0
    for d, e in zip(diagonal, squares, strict=True):
        q = d - x - e / q
        if q < 0.0:
            count += 1
        elif q == 0.0:
            q = 1e-300
    return count


def _solve(diagonal: list[float], off: list[float], shift: float, b: list[float]) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges; off[k] lies between k - 1 and k."""
    n = len(diagonal)
    tiny = 1e-300 + 1e-16 * abs(shift)
    first, second, third, right = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    p, q, r = diagonal[0] - shift, off[1] if n > 1 else 0.0, b[0]
    for k in range(1, n):
        low, mid, up = off[k], diagonal[k] - shift, off[k + 1] if k + 1 < n else 0.0
        if abs(low) > abs(p):
            first[k - 1], second[k - 1], third[k - 1], right[k - 1] = low, mid, up, b[k]
            m = p / low
            p, q, r = q - m * mid, -m * up, r - m * b[k]
        else:
            first[k - 1], second[k - 1], right[k - 1] = p or tiny, q, r
            m = low / first[k - 1]
            p, q, r = mid - m * q, up, b[k] - m * r
    first[n - 1], right[n - 1] = p if abs(p) > tiny else tiny, r
    x = [0.0] * (n + 2)
    for k in range(n - 1, -1, -1):
        x[k] = (right[k] - second[k] * x[k + 1] - third[k] * x[k + 2]) / first[k]
    return np.array(x[:n])


def leading_eigenvectors(diagonal: np.ndarray, off: np.ndarray, count: int) -> list[np.ndarray]:
    """Unit eigenvectors of the greatest eigenvalues of a symmetric tridiagonal matrix (off[k] between k - 1 and k, off[0] 0),
    the greatest first: bisection until an eigenvalue is alone, then inverse iteration.  Memory grows with its length."""
    n = len(diagonal)
    d, e = diagonal.tolist(), off.tolist()
    squares = (off**2).tolist()
    reach = np.abs(off) + np.abs(np.append(off[1:], 0.0))
    top, bottom = float((diagonal + reach).max()), float((diagonal - reach).min())
    top, bottom = top + 1e-9 * (abs(top) + 1), bottom - 1e-9 * (abs(bottom) + 1)
    counts = {bottom: 0, top: n}  # what bisection has found, shared by the eigenvalues

    def below(x: float) -> int:
        if x not in counts:
            counts[x] = _below(d, squares, x)
        return counts[x]

    out = []
    for i in range(count):
        want = n - 1 - i  # eigenvalues below this one
        lo = max(x for x, c in counts.items() if c <= want)
        hi = min(x for x, c in counts.items() if c > want)
        more = 5
        while more and hi - lo > 4e-15 * max(abs(lo), abs(hi), 1e-300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if below(mid) <= want else (lo, mid)
            more -= counts[hi] - counts[lo] == 1
        shift = (lo + hi) / 2
        v = np.ones(n) / np.sqrt(n)
        for _ in range(30):
            w = _solve(d, e, shift, v.tolist())
            w /= np.abs(w).max()
            w /= np.sqrt(w @ w)
            if abs(w @ v) > 1 - 1e-15:
                v = w
                break
            v = w
            value = float(v @ (diagonal * v) + 2 * (off[1:] * v[1:]) @ v[:-1])
            if lo < value < hi:  # the Rayleigh quotient is the better shift once it is in the eigenvalue's own interval
                shift = value
        out.append(v)
    return out


def concentration(taper: np.ndarray, w: float) -> float:
    """Share of a unit taper's energy within [-w, w] cycles a sample, from its autocorrelation by a Fourier transform."""
    n = len(taper)
    size = 1 << max(2 * n - 1, 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(taper, size)) ** 2, size)[:n]
    lag = np.arange(1, n)
    return float(2 * w * r[0] + 2 * (r[1:] * np.sin(2 * np.pi * w * lag) / (np.pi * lag)).sum())


@lru_cache(maxsize=8)
def slepian(n: int, half_bandwidth: float = 4.0, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tapers, concentrations): discrete prolate spheroidal sequences of n samples from their tridiagonal eigenproblem, the
    most concentrated first; no matrix is made.

    The matrix is the same read from either end, so even and odd sequences are the eigenvectors of two problems of half the
    size: the even ones in turn with the odd ones."""
    count = min(count or max(int(2 * half_bandwidth) - 1, 1), n)
    w = half_bandwidth / n
    k = np.arange(n)
    diagonal = ((n - 1 - 2 * k) / 2.0) ** 2 * np.cos(2 * np.pi * w)
    off = k * (n - k) / 2.0
    m = n // 2
    tapers = np.zeros((count, n))
    for odd in range(2):
        here = tapers[odd::2]
        if not len(here):
            continue
        size = m + n % 2 * (1 - odd)
        d, e = diagonal[:size].copy(), off[:size].copy()
        if n % 2 == 0:
            d[-1] += -off[m] if odd else off[m]
        elif not odd and m:
            e[-1] *= np.sqrt(2)  # the middle sample is its own mirror image
        for t, v in zip(here, leading_eigenvectors(d, e, len(here)), strict=True):
            t[:m] = v[:m] / np.sqrt(2)
            t[n - m :] = (-1 if odd else 1) * t[:m][::-1]
            if n % 2 and not odd:
                t[m] = v[m]
    for i, t in enumerate(tapers):
        if (t.sum() if i % 2 == 0 else t[1]) < 0:
            tapers[i] = -t
    return tapers, np.array([concentration(t, w) for t in tapers])


def multitaper(x: np.ndarray, fs: float, half_bandwidth: float = 4.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Adaptively weighted multitaper power density (Thomson, 1982), one-sided, per Hz."""
    tapers, lam = slepian(len(x), half_bandwidth)
    keep = lam > 0.9
    tapers, lam = tapers[keep], lam[keep]
    p = np.abs(np.fft.rfft((x - x.mean()) * tapers)) ** 2
    var = np.var(x)
    s = p[:2].mean(axis=0)
    for _ in range(rounds):
        d = np.sqrt(lam)[:, None] * s / (lam[:, None] * s + (1 - lam)[:, None] * var + 1e-300)
        new = (d**2 * p).sum(axis=0) / (d**2).sum(axis=0)
        if np.max(np.abs(new - s)) <= 1e-10 * max(np.max(s), 1e-300):
            s = new
            break
        s = new
    s = s / fs
    s[1 : None if len(x) % 2 else -1] *= 2
    return np.fft.rfftfreq(len(x), 1 / fs), s


# -- Arrow operators -----------------------------------------------------------


#: Values of power that a task gathers before it sends rows on.
SENT_VALUES = 1 << 20


def spectra(traces: DataFrame, kernel: Callable[..., tuple[np.ndarray, Iterable[np.ndarray]]], keys: list[str], out: str = "power", freq: str = "freq", more: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, f_idx, freq, power array<double>) of each trace (keys, w): kernel gives frequencies and their rows of power, which
    may be made one at a time.  The kernel gets the trace and the row's columns `more`.

    A trace whose kernel fails gives a row with error and no power instead of failing the task; rows sent before that stay.
    """
    schema = T.StructType([*[traces.schema[k] for k in keys], T.StructField("f_idx", T.IntegerType()), T.StructField(freq, T.DoubleType()), T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def run(batches):
        for b in batches:
            names = [*keys, "f_idx", freq, out, "error"]

            def sent(rows, b=b, names=names):
                """Rows (trace, f_idx, freq, power) as one batch."""
                at, j, f, p = zip(*rows, strict=True)
                ends = np.cumsum([0, *map(len, p)]).astype("i4")
                power = pa.ListArray.from_arrays(ends, np.concatenate(p))
                own = [b.column(k).take(pa.array(at, pa.int32())) for k in keys]
                return pa.RecordBatch.from_arrays([*own, pa.array(j, pa.int32()), pa.array(f, pa.float64()), power, pa.nulls(len(rows), pa.string())], names=names)

            rows, size = [], 0
            for i, w in enumerate(b.column("w")):
                try:
                    x = np.asarray(w.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                    if not len(x):
                        raise ValueError("empty trace")
                    f, p = kernel(x, *[b.column(c)[i].as_py() for c in more])
                    for j, (fj, pj) in enumerate(zip(f, p, strict=True)):
                        rows.append((i, j, float(fj), np.atleast_1d(np.asarray(pj, dtype=np.float64))))
                        size += len(rows[-1][3])
                        if size > SENT_VALUES:
                            yield sent(rows)
                            rows, size = [], 0
                except Exception as e:  # noqa: BLE001  a bad trace is a row
                    own = [b.column(k).slice(i, 1) for k in keys]
                    values = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([f"{type(e).__name__}: {e}"])]
                    yield pa.RecordBatch.from_arrays([*own, *values], names=names)
            if rows:
                yield sent(rows)

    return traces.select(*keys, "w", *more).mapInArrow(run, schema)


def row_z(p: np.ndarray) -> np.ndarray:
    return (p - p.mean(axis=1, keepdims=True)) / np.maximum(p.std(axis=1, keepdims=True), 1e-12)


def morlet_spectra(traces: DataFrame, keys: list[str], freqs: list[float], fs: float, method: str = "custom", zscored: bool = False, chunk: int | None = None) -> DataFrame:
    """Morlet power of each trace, as z over the whole trace per frequency if zscored.

    With chunk, the trace is cut into pieces of that many samples, each transformed and z-scored by itself: other numbers
    than over the whole trace, for results made that way.
    """
    f = np.asarray(freqs, dtype=float)
    c = cycles(f, method)

    def kernel(x):
        parts = [x] if chunk is None else [x[i : i + chunk] for i in range(0, len(x), chunk)]
        rows = zip(*[wavelet_rows("morlet", part, f, fs, c) for part in parts], strict=True)
        return f, (np.concatenate([row_z(p[None, :])[0] if zscored else p for p in row]) for row in rows)

    return spectra(traces, kernel, keys)


def bank_spectra(traces: DataFrame, keys: list[str], freqs: list[float], fs: float, method: str = "custom") -> DataFrame:
    """Power by the unit-energy wavelet bank: other values than morlet_spectra."""
    f = np.asarray(freqs, dtype=float)
    c = cycles(f, method)
    return spectra(traces, lambda x: (f, bank_power(x, f, fs, c)), keys)


def centre_spectra(traces: DataFrame, keys: list[str], freqs: list[float], fs: float, methods: list[str]) -> DataFrame:
    """Power at the middle sample of each trace: rows of spectra whose power has a value for each cycles policy of methods."""
    f = np.asarray(freqs, dtype=float)
    c = [cycles(f, m) for m in methods]
    return spectra(traces, lambda x: (f, np.stack([centre_power(x, f, fs, one) for one in c], axis=1)), keys)


def vectorized_spectra(traces: DataFrame, keys: list[str], freqs: list[float], fs: float, how: str = "cwt", method: str = "custom") -> DataFrame:
    """"cwt": cwt_spectra, "manual": bank_spectra; ValueError for anything else."""
    if how not in ("cwt", "manual"):
        raise ValueError(f"unknown method {how!r}")
    return cwt_spectra(traces, keys, freqs, fs) if how == "cwt" else bank_spectra(traces, keys, freqs, fs, method)


def cwt_spectra(traces: DataFrame, keys: list[str], freqs: list[float], fs: float) -> DataFrame:
    f = np.asarray(freqs, dtype=float)
    return spectra(traces, lambda x: (f, cwt_power(x, f, fs)), keys)


def welch_psd(traces: DataFrame, keys: list[str], fs: float, size: int = 1024) -> DataFrame:
    """(keys, f_idx, freq, p)."""
    out = spectra(traces, lambda x: welch(x, fs, size), keys)
    return out.where("error IS NULL").select(*keys, "f_idx", "freq", F.col("power")[0].alias("p"))


def multitaper_psd(traces: DataFrame, keys: list[str], fs: float, half_bandwidth: float = 4.0) -> DataFrame:
    out = spectra(traces, lambda x: multitaper(x, fs, half_bandwidth), keys)
    return out.where("error IS NULL").select(*keys, "f_idx", "freq", F.col("power")[0].alias("p"))


def stft_mean(traces: DataFrame, keys: list[str], fs: float, size: int, overlap: int, clip: float | None = None) -> DataFrame:
    """(keys, f_idx, freq, p): STFT power averaged over the segments centred within clip of the middle (all if None)."""

    def kernel(x):
        f, t, p = stft(x, fs, size, overlap)
        mid = len(x) / fs / 2
        keep = np.abs(t - mid) <= clip if clip is not None else np.ones(len(t), dtype=bool)
        return f, p[:, keep].mean(axis=1)

    return spectra(traces, kernel, keys).where("error IS NULL").select(*keys, "f_idx", "freq", F.col("power")[0].alias("p"))


def stft_at_events(traces: DataFrame, keys: list[str], fs: float, size: int, overlap: int, seconds: float, whole: bool = True) -> DataFrame:
    """(keys, f_idx, freq, power array, error): STFT power in `seconds` around each event, averaged over the events of a trace
    (keys, w, events array<double> in seconds).

    whole: the STFT of the whole trace is cut at its columns around each event; otherwise twice `seconds` of the trace are
    cut first, transformed, and the middle half of the columns kept.  Events whose window is not whole are left out; a trace
    without any is a row with error.
    """

    def kernel(x, events):
        parts, f = [], None
        if whole:
            f, t, p = stft(x, fs, size, overlap)
            rate = len(t) / (len(x) / fs)
            half = int(seconds * rate) // 2
            at = [int(e * rate) for e in events]
            parts = [p[:, a - half : a + half] for a in at if a >= half and a + half <= p.shape[1]]
        else:
            n = int(2 * seconds * fs)
            for a in (int(e * fs) - n // 2 for e in events):
                if a >= 0 and a + n <= len(x):
                    f, t, p = stft(x[a : a + n], fs, size, overlap)
                    half = int(n // 2 * len(t) / n) // 2
                    parts.append(p[:, len(t) // 2 - half : len(t) // 2 + half])
        if not parts:
            raise ValueError("no event with a whole window")
        return f, np.mean(parts, axis=0)

    return spectra(traces, kernel, keys, more=["events"])


def failures(spectra_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error) of the traces that failed."""
    return spectra_rows.where("error IS NOT NULL").select(*keys, "error").distinct()


def fourier_power(w: Column, f: float, fs: float, n: int) -> Column:
    """|sum w[k] exp(-2 pi i f k / fs)|**2 of an array of n values, within whole-stage expressions."""
    dot = lambda wave: F.aggregate(F.zip_with(w, F.array(*[F.lit(x) for x in wave]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    c, s = dot([math.cos(2 * math.pi * f * k / fs) for k in range(n)]), dot([math.sin(2 * math.pi * f * k / fs) for k in range(n)])
    return c * c + s * s


def fourier_power_at(w: Column, f: Column, fs: float) -> Column:
    """fourier_power at a frequency of the row: arrays of any length, f a column (of an exploded grid)."""
    step = F.lit(2 * math.pi / fs) * f
    dot = lambda wave: F.aggregate(F.transform(w, lambda x, k: x * wave(step * k)), F.lit(0.0), lambda s, x: s + x)
    c, s = dot(F.cos), dot(F.sin)
    return c * c + s * s


def region_mean(spectra_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over channels of (keys, f_idx, freq, power): (keys, f_idx, freq, k, p)."""
    long = spectra_rows.where("error IS NULL").select(*keys, "f_idx", "freq", F.posexplode("power").alias("k", "p"))
    return long.groupBy(*keys, "f_idx", "freq", "k").agg(F.avg("p").alias("p"))


def band_mean(spectra_rows: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """(keys, k, p): mean over the frequencies of a closed band, a time series per key."""
    long = spectra_rows.where("error IS NULL").where(F.col("freq").between(lo, hi)).select(*keys, F.posexplode("power").alias("k", "p"))
    return long.groupBy(*keys, "k").agg(F.avg("p").alias("p"))


def overlay_psd(traces: DataFrame, keys: list[str], fs: float, lo: float = 1.0, hi: float = 90.0, size: int = 1024, scale: float = 1e-6) -> DataFrame:
    """Welch power density of traces in microvolts, per volt squared, within [lo, hi]."""
    scaled = traces.withColumn("w", F.transform("w", lambda x: x * scale))
    return welch_psd(scaled, keys, fs, size).where(F.col("freq").between(lo, hi))


def log_power(p: Column) -> Column:
    return F.log10(p + 1e-12)
