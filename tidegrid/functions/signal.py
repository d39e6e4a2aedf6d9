"""Array-valued scalar functions on waveforms.

Normalising and PCM conversion are native column expressions. Filtering and resampling are NumPy
kernels behind Arrow pandas UDFs. Null arrays stay null, empty arrays stay empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guard of the peak when a clip is silent.
SILENCE = 1e-24


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_clip(clip: Column) -> Column:
    """Mean removed, then divided by the largest magnitude (guarded).

    Not to be an argument of a Python kernel, where Spark may fail to plan it; use ``normalizer``.
    """
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    peak = lambda x: F.greatest(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(SILENCE))
    scaled = lambda c: let(peak(c), lambda p: F.transform(c, lambda v: v / p))
    whole = lambda x: let(mean(x), lambda m: let(F.transform(x, lambda v: v - m), scaled))
    as_double = F.transform(clip, lambda v: v.cast("double"))
    return F.when(F.size(clip) > 0, let(as_double, whole)).otherwise(as_double)


def float_to_pcm(clip: Column, bits: int = 16) -> Column:
    """Floats to integers: scaled, clipped to the range, truncated toward zero."""
    top = float(1 << (bits - 1))
    kind = {16: "smallint", 32: "int"}[bits]
    return F.transform(clip, lambda v: F.least(F.greatest(v.cast("double") * top, F.lit(-top)), F.lit(top - 1)).cast(kind))


def pcm_to_float(clip: Column, bits: int = 16) -> Column:
    return F.transform(clip, lambda v: (v / float(1 << (bits - 1))).cast("double"))


def butterworth(order: int, edges: float | tuple[float, float], kind: str, fs: float) -> np.ndarray:
    """Butterworth filter as second-order sections (rows b0 b1 b2 a0 a1 a2), by the bilinear transform.

    ``kind`` is lowpass, highpass, bandpass or bandstop; ``edges`` in Hz.
    """
    warped = 2 * np.tan(np.pi * np.atleast_1d(np.asarray(edges, float)) / fs)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, gain = proto * warped[0], np.array([]), warped[0] ** order
    elif kind == "highpass":
        poles, zeros, gain = warped[0] / proto, np.zeros(order), np.real(1 / np.prod(-proto))
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = proto * width / 2 if kind == "bandpass" else width / 2 / proto
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.r_[half + root, half - root]
        if kind == "bandpass":
            zeros, gain = np.zeros(order), width**order
        elif kind == "bandstop":
            zeros, gain = np.r_[np.full(order, 1j * centre), np.full(order, -1j * centre)], np.real(1 / np.prod(-proto))
        else:
            raise ValueError(f"unknown kind {kind!r}")
    digital_poles = (2 + poles) / (2 - poles)
    digital_zeros = np.r_[(2 + zeros) / (2 - zeros), np.full(len(poles) - len(zeros), -1.0)]
    gain = gain * np.real(np.prod(2 - zeros) / np.prod(2 - poles))
    return _sections(digital_zeros, digital_poles, gain)


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Zeros and poles in conjugate pairs, the poles nearest the unit circle last."""

    def pairs(roots):
        upper = sorted((r for r in roots if r.imag > 1e-9), key=abs)
        real = sorted((r.real for r in roots if abs(r.imag) <= 1e-9), key=abs)
        out = [np.array([1.0, -2 * r.real, abs(r) ** 2]) for r in upper]
        while len(real) > 1:
            a, b = real.pop(0), real.pop(0 if len(set(np.sign(real))) == 1 else -1)
            out.append(np.array([1.0, -(a + b), a * b]))
        return out + [np.array([1.0, -r, 0.0]) for r in real]

    b, a = pairs(zeros.astype(complex)), pairs(poles.astype(complex))
    a = sorted(a, key=lambda s: abs(s[2]))
    b += [np.array([1.0, 0, 0])] * (len(a) - len(b))
    sections = np.array([np.r_[x, y] for x, y in zip(b, a, strict=True)])
    sections[0, :3] *= gain
    return sections


#: Samples that a section takes in one step.
FILTER_BLOCK = 256


def _block_matrices(a1: float, a2: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Answer of ``1 / (1 + a1 z^-1 + a2 z^-2)``: to ``n`` inputs (Toeplitz) and to the two outputs before."""
    h = np.zeros(n + 2)
    h[2] = 1.0
    past = np.zeros((n + 2, 2))
    past[0, 1], past[1, 0] = 1.0, 1.0  # columns: the output one and two samples before
    for i in range(2, n + 2):
        if i > 2:
            h[i] = -a1 * h[i - 1] - a2 * h[i - 2]
        past[i] = -a1 * past[i - 1] - a2 * past[i - 2]
    at = np.arange(n)
    lower = at[:, None] - at[None]
    return np.where(lower >= 0, h[2:][np.clip(lower, 0, None)], 0.0), past[2:]


def _run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sections over the last axis, starting in the steady state of the first sample; rows at once.

    Each section is run in blocks of ``FILTER_BLOCK`` samples: the moving-average part is a sum of
    shifted inputs, the recursive part a product with the block's answer and the two outputs before.
    """
    y = x.astype(float).copy()
    for b0, b1, b2, _, a1, a2 in sos:
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        first = y[:, :1]
        ext = np.concatenate([first, first, y], axis=1)
        drive = b0 * ext[:, 2:] + b1 * ext[:, 1:-1] + b2 * ext[:, :-2]
        step = min(FILTER_BLOCK, y.shape[1])
        answer, past = _block_matrices(a1, a2, step)
        last = dc * np.repeat(first, 2, axis=1)
        for i in range(0, y.shape[1], step):
            own = drive[:, i : i + step]
            n = own.shape[1]
            out = own @ answer[:n, :n].T + last @ past[:n].T
            y[:, i : i + n] = out
            last = out[:, [-1, -2]] if n > 1 else np.stack([out[:, 0], last[:, 0]], 1)
    return y


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward-backward filtering of rows, with odd extension at both ends."""
    length = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = int(min(3 * length, x.shape[1] - 1))
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad else x
    y = _run_sections(sos, ext)
    y = _run_sections(sos, y[:, ::-1])[:, ::-1]
    return y[:, pad : pad + x.shape[1]]


def by_length(arrays: pd.Series, kernel) -> pd.Series:
    """Apply a row-batch kernel to the arrays of each length; nulls and empty arrays pass through."""
    out: list = [None if a is None else [] for a in arrays]
    groups: dict[int, list[int]] = {}
    for i, a in enumerate(arrays):
        if a is not None and len(a):
            groups.setdefault(len(a), []).append(i)
    for at in groups.values():
        for i, y in zip(at, kernel(np.stack([np.asarray(arrays.iloc[i], float) for i in at])), strict=True):
            out[i] = y
    return pd.Series(out)


def normalize_batch(x: np.ndarray) -> np.ndarray:
    """``normalize_clip`` for rows of samples."""
    x = x - x.mean(1, keepdims=True)
    return x / np.maximum(np.abs(x).max(1, keepdims=True), SILENCE)


def normalizer():
    """Column function like ``normalize_clip``, to be chained with other Python kernels in one pass."""

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series) -> pd.Series:
        return by_length(clips, normalize_batch)

    return run


def zero_phase_filter(order: int, edges, kind: str, fs: float):
    """Column function: zero-phase Butterworth filter of array<double>."""
    sos = butterworth(order, edges, kind, fs)

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series) -> pd.Series:
        return by_length(clips, lambda x: zero_phase(sos, x))

    return run


#: Output samples that are computed at a time.
RESAMPLE_BLOCK = 4096


def resample(x: np.ndarray, old: int, new: int, half_width: int = 64, beta: float = 14.77) -> np.ndarray:
    """Band-limited resampling by a Kaiser-windowed sinc; ``ceil(n * new / old)`` samples.

    Output positions repeat their phase every ``new / gcd`` samples, so one kernel per phase is made,
    and blocks of outputs of a phase are products of strided input windows with its kernel.
    """
    if old == new or not x.shape[-1]:
        return x
    g = math.gcd(old, new)
    up, down = new // g, old // g
    n = -(-x.shape[-1] * new // old)
    cutoff = min(1.0, new / old)
    width = half_width / cutoff
    reach = int(np.ceil(width))
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(reach, reach + down)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach, axis=-1)
    out = np.empty((*x.shape[:-1], n))
    taps = np.arange(2 * reach) - reach + 1
    for phase in range(min(up, n)):
        whole, rest = divmod(phase * down, up)
        d = rest / up - taps
        kernel = cutoff * np.sinc(cutoff * d) * np.i0(beta * np.sqrt(np.clip(1 - (d / width) ** 2, 0, None))) / np.i0(beta) * (np.abs(d) <= width)
        at = whole + 1 + down * np.arange(len(range(phase, n, up)))
        for k in range(0, len(at), RESAMPLE_BLOCK):
            some = at[k : k + RESAMPLE_BLOCK]
            out[..., phase + k * up : phase + (k + len(some)) * up : up] = frames[..., some[0] : some[-1] + 1 : down, :] @ kernel
    return out


def resample_to(old: int, new: int):
    """Column function: resample array<double> from one rate to another."""

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series) -> pd.Series:
        return by_length(clips, lambda x: resample(x, old, new))

    return run


def resampler(new: int):
    """Column function (rate, samples): each row from its own rate to ``new``; a null rate gives null."""

    @F.pandas_udf("array<double>")
    def run(rates: pd.Series, clips: pd.Series) -> pd.Series:
        out: list = [None] * len(clips)
        for rate in rates.dropna().unique():
            at = np.flatnonzero((rates == rate).to_numpy())
            for i, y in zip(at, by_length(clips.iloc[at].reset_index(drop=True), lambda x, old=int(rate): resample(x, old, new)), strict=True):
                out[i] = y
        return pd.Series(out)

    return run
