"""Spectra of clips: density, decibels, mel banks, PCEN, blurring, scale-space filters, palettes.

One NumPy kernel turns a batch of equally long clips into spectrograms [clip, frequency, time]; it
runs behind an Arrow pandas UDF. Clips shorter than a window give an empty spectrogram, null clips
null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.functions.signal import by_length, normalize_batch

KINDS = ("spec", "spec_db", "spec_dbfs", "spec_pcen", "melspec", "melspec_db", "melspec_dbfs", "melspec_pcen")


@dataclass(frozen=True)
class SpectralSettings:
    """Window and overlap (seconds, fraction), band, representation and its parameters."""

    fs: float
    win_len_s: float
    overlap: float
    nfft_is_window: bool = True
    band: tuple[float, float] | None = None
    kind: str = "spec_db"
    eps: float = 1e-10
    n_mels: int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown representation {self.kind!r}")
        if self.kind.startswith("mel") and not self.n_mels:
            raise ValueError("mel representations need n_mels")

    @property
    def window(self) -> int:
        return int(round(self.win_len_s * self.fs))

    @property
    def hop(self) -> int:
        return self.window - int(round(self.win_len_s * self.overlap * self.fs))

    @property
    def nfft(self) -> int:
        return self.window if self.nfft_is_window else 1 << (self.window - 1).bit_length()

    @property
    def frequencies(self) -> np.ndarray:
        return np.fft.rfftfreq(self.nfft, 1 / self.fs)

    @property
    def bins(self) -> slice:
        """First bin at or above the lower, to the last at or below the upper bound."""
        lo, hi = self.band or (0.0, self.fs / 2)
        f = self.frequencies
        return slice(int(np.searchsorted(f, lo, "left")), int(np.searchsorted(f, hi, "right")))


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)


def power_density(x: np.ndarray, s: SpectralSettings) -> np.ndarray:
    """One-sided power spectral density [clip, frequency, time] of clips [clip, sample]."""
    if x.shape[1] < s.window:
        return np.empty((len(x), len(s.frequencies[s.bins]), 0))
    frames = np.lib.stride_tricks.sliding_window_view(x, s.window, axis=1)[:, :: s.hop]
    w = hann(s.window)
    p = np.abs(np.fft.rfft(frames * w, s.nfft)) ** 2 / (s.fs * (w**2).sum())
    p[..., 1 : None if s.nfft % 2 else -1] *= 2
    return np.swapaxes(p[..., s.bins], 1, 2)


def mel_bank(n_mels: int, band: tuple[float, float], frequencies: np.ndarray) -> np.ndarray:
    """Triangles over bin frequencies with evenly spaced mel edges; columns add up to 1."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(*mel(band), n_mels + 2) / 2595) - 1)
    f = frequencies[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    bank = np.clip(np.minimum(rise, fall), 0, None)
    total = bank.sum(0)
    return np.divide(bank, total, out=bank, where=total > 0)


def mel_bank_snapped(n_mels: int, band: tuple[float, float], nfft: int, fs: float) -> np.ndarray:
    """Triangles whose edges are snapped down to bins (not normalised)."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    at = np.floor((nfft + 1) * 700 * (10 ** (np.linspace(*mel(band), n_mels + 2) / 2595) - 1) / fs).astype(int)
    i = np.arange(nfft // 2 + 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        rise, fall = (i - at[:-2]) / (at[1:-1] - at[:-2]), (at[2:] - i) / (at[2:] - at[1:-1])
    return np.where((i >= at[:-2]) & (i < at[1:-1]), rise, np.where((i >= at[1:-1]) & (i < at[2:]), fall, 0.0))


def decibels(p: np.ndarray, eps: float = 1e-10, full_scale: bool = False) -> np.ndarray:
    """10 log10(p + eps); at full scale stretched so that eps is 0 and 1 is 1."""
    db = 10 * np.log10(p + eps)
    floor = 10 * np.log10(eps)
    return (db - floor) / (0 - floor) if full_scale else db


def pcen(e: np.ndarray, alpha: float = 0.98, delta: float = 2.0, r: float = 0.5, s: float = 0.025, eps: float = 1e-6) -> np.ndarray:
    """Per-channel energy normalisation along the last axis (time)."""
    smooth, level = np.empty_like(e), np.zeros(e.shape[:-1])
    for t in range(e.shape[-1]):
        level = (1 - s) * level + s * e[..., t]
        smooth[..., t] = level
    return (e * (eps + smooth) ** -alpha + delta) ** r - delta**r


def represent(x: np.ndarray, s: SpectralSettings) -> np.ndarray:
    """Clips to the representation of the settings."""
    p = power_density(x, s)
    if s.kind.startswith("mel"):
        bank = mel_bank(s.n_mels, s.band or (0.0, s.fs / 2), s.frequencies[s.bins])
        p = np.einsum("cft,fm->cmt", p, bank)
    if s.kind.endswith("_db"):
        return decibels(p, s.eps)
    if s.kind.endswith("_dbfs"):
        return decibels(p, s.eps, True)
    return pcen(p) if s.kind.endswith("_pcen") else p


def gauss_kernel(sigma: float) -> np.ndarray:
    """Gaussian of half-width ceil(4 sigma) that adds up to 1."""
    n = int(np.ceil(4 * sigma))
    k = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * sigma**2))
    return k / k.sum()


def log_kernel(sigma: float) -> tuple[np.ndarray, float]:
    """Scale-normalised Laplacian of a Gaussian, divided by its sum within one sigma; and that sum."""
    g = gauss_kernel(sigma)
    n = len(g) // 2
    k = g * (1 - np.arange(-n, n + 1) ** 2 / sigma**2)
    factor = k.sum() - 2 * k[: int(np.ceil(2 * sigma))].sum()
    return k / factor, factor


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    n = len(kernel) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (n, n)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="symmetric"), len(kernel), axis=axis)
    return view @ kernel[::-1]


def gaussian_blur(x: np.ndarray, sigma: float, time_too: bool = False) -> np.ndarray:
    """Blur [.., frequency, time] along frequency, and time if asked, with symmetric padding."""
    y = _along(x, gauss_kernel(sigma), -2)
    return _along(y, gauss_kernel(sigma), -1) if time_too else y


def log_filter(x: np.ndarray, sigmas=(4.0,), offsets=None) -> np.ndarray:
    """Laplacian of Gaussian along frequency at each scale: [scale, .., frequency, time]."""
    own = sorted(sigmas)
    return np.stack([_along(x, log_kernel(s)[0], -2) + (offsets[i] if offsets is not None else 0.0) for i, s in enumerate(own)])


def palette_index(x: np.ndarray, n_colours: int, vmin: float | None = None, vmax: float | None = None) -> np.ndarray:
    """Values of each spectrogram to palette entries (half-even), scaled to its own or a given range."""
    if vmin is None or vmax is None:
        x = x - x.min(axis=(-2, -1), keepdims=True)
        top = x.max(axis=(-2, -1), keepdims=True)
        x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)
    else:
        if vmin >= vmax:
            raise ValueError("vmin must be below vmax")
        x = (np.clip(x, vmin, vmax) - vmin) / (vmax - vmin)
    return np.rint(x * (n_colours - 1)).astype(np.int32)


def resize(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Bilinear resizing of [.., row, column] with sample centres aligned, no antialiasing."""

    def weights(old: int, new: int) -> np.ndarray:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, old - 1)
        m = np.zeros((new, old))
        m[np.arange(new), lo] += 1 - (at - lo)
        m[np.arange(new), hi] += at - lo
        return m

    return weights(x.shape[-2], rows) @ x @ weights(x.shape[-1], columns).T


def to_image(x: np.ndarray, palette: np.ndarray, vmin=None, vmax=None, size: tuple[int, int] | None = None) -> np.ndarray:
    """Spectrograms to colours [.., row, column, 3]."""
    image = palette[palette_index(x, len(palette), vmin, vmax)]
    if size is not None:
        image = np.moveaxis(resize(np.moveaxis(image.astype(float), -1, 0), *size), 0, -1)
    return image


def spectrogram(s: SpectralSettings, normalize: bool = False):
    """Column function: array<double> clip to array<array<double>> [frequency][time].

    With ``normalize`` clips first lose their mean and are divided by their (guarded) peak.
    """

    def prepared(x: np.ndarray) -> np.ndarray:
        return represent(normalize_batch(x) if normalize else x, s)

    @F.pandas_udf("array<array<double>>")
    def run(clips: pd.Series) -> pd.Series:
        return by_length(clips, lambda x: [[row for row in clip] for clip in prepared(x)])

    return run


def on_spectrograms(kernel, kind: str = "array<array<double>>"):
    """Column function that applies a [frequency, time] kernel to array<array<double>>."""

    @F.pandas_udf(kind)
    def run(specs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [] if not len(x) else [row for row in kernel(np.array([np.asarray(r, float) for r in x]))] for x in specs])

    return run
