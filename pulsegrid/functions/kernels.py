"""Numeric kernels for what has no relational form: filters, peaks, entropies, fluctuation analysis, spectra.

Each works on one NumPy array per signal. Executors call them through `mapInArrow` or pandas UDFs on array columns,
so a signal crosses to Python once and everything about it is computed there. Missing is NaN inside a kernel.
"""

from __future__ import annotations

import numpy as np

# Rules of the feature definitions.
FS = 4
FHR_RANGE = (50.0, 240.0)
UC_RANGE = (0.0, 150.0)
EVENT_BPM, EVENT_S = 15.0, 15.0
BASELINE_S = (15, 120)
LTV_BLOCK_S, LTV_VALID, LTV_DECEL = 60, 0.80, 0.10
UC_SMOOTH_S, UC_DISTANCE_S, UC_MIN_HEIGHT, UC_MIN_PROMINENCE = 10, 60, 10.0, 5.0
EARLY_S, LATE_S = 15.0, 90.0
ENTROPY_MAX, ENTROPY_ORDER, ENTROPY_R = 1200, 2, 0.2
DFA_SCALES = (4, 8, 16, 32, 64, 128)


def clean(x: np.ndarray, low: float, high: float, zero_missing: bool) -> tuple[np.ndarray, float]:
    """The signal with all gaps filled (linearly, nearest value at the ends), and the percent that was missing."""
    x = np.asarray(x, np.float64)
    ok = np.isfinite(x) & (x >= low) & (x <= high)
    if zero_missing:
        ok &= x != 0
    missing = 100.0 * (1 - ok.mean()) if len(x) else 100.0
    if not ok.any():
        return np.full(len(x), np.nan), missing
    at = np.arange(len(x))
    return np.interp(at, at[ok], x[ok]), missing


def median_filter(x: np.ndarray, size: int) -> np.ndarray:
    """Centred running median of odd size, the ends held at the nearest sample."""
    half = size // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), size)
    out = np.empty(len(x))
    for i in range(0, len(x), 1024):  # bounds the memory of the partition
        out[i : i + 1024] = np.partition(view[i : i + 1024], half, axis=1)[:, half]
    return out


def baseline(fhr: np.ndarray, fs: int = FS) -> np.ndarray:
    """Two median filters, a short and a long one."""
    if not len(fhr) or np.isnan(fhr).all():
        return np.full(len(fhr), np.nan)
    for s in BASELINE_S:
        fhr = median_filter(fhr, s * fs + 1 - (s * fs) % 2)
    return fhr


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    """Running mean; an even size reaches one sample further back than ahead. The ends are held."""
    back = size // 2
    padded = np.pad(x, (back, size - 1 - back), mode="edge")
    total = np.cumsum(np.concatenate([[0.0], padded]))
    return (total[size:] - total[:-size]) / size


def slope(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Least-squares slope and intercept over finite y; NaN with fewer than two."""
    ok = np.isfinite(y)
    if ok.sum() < 2:
        return np.nan, np.nan
    x, y = x[ok], y[ok]
    d = x - x.mean()
    if not (d @ d) > 0:
        return np.nan, np.nan
    b = float(d @ (y - y.mean()) / (d @ d))
    return b, float(y.mean() - b * x.mean())


def sustained(delta: np.ndarray, above: bool, fs: int = FS, bpm: float = EVENT_BPM, seconds: float = EVENT_S) -> list[tuple[int, int, int, float]]:
    """Runs at or beyond the threshold that last: (start, end, peak, amplitude), the peak being the first extreme."""
    x = delta if above else -delta
    edge = np.flatnonzero(np.diff(np.concatenate([[False], x >= bpm, [False]]).astype(np.int8)))
    out = []
    for a, b in edge.reshape(-1, 2).tolist():
        if b - a >= round(seconds * fs):
            peak = a + int(np.argmax(x[a:b]))
            out.append((a, b, peak, float(x[peak])))
    return out


def peaks(x: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (a plateau counts at its middle), at least so high, at least so far apart (the higher of two stays), at least so prominent."""
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64)
    run = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    end = np.concatenate([run[1:], [n]])
    inner = (run > 0) & (end < n)
    run, end = run[inner], end[inner]
    top = (x[run - 1] < x[run]) & (x[end % n] < x[run])
    at = (run[top] + end[top] - 1) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep &= ~near
    at = at[keep]

    def rise(p: int) -> float:
        higher = np.flatnonzero(x > x[p])
        left = higher[higher < p]
        right = higher[higher > p]
        lo = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        hi = x[p : (right[0] if len(right) else n)].min()
        return x[p] - max(lo, hi)

    return np.array([p for p in at.tolist() if rise(p) >= prominence], np.int64)


def contractions(uc: np.ndarray, fs: int = FS) -> np.ndarray:
    """Peaks of the smoothed contraction signal, with height and prominence taken from the signal."""
    if not len(uc) or np.isnan(uc).all():
        return np.zeros(0, np.int64)
    s = moving_average(uc, max(1, UC_SMOOTH_S * fs))
    ok = s[np.isfinite(s)]
    return peaks(s, max(np.percentile(ok, 60), UC_MIN_HEIGHT), UC_DISTANCE_S * fs, max(0.4 * ok.std(), UC_MIN_PROMINENCE))


def classify(nadirs: list[int], tops: np.ndarray, fs: int = FS) -> dict[str, float]:
    """Early, late and variable decelerations by the signed lag to the nearest peak (the earlier of two), and that lag's mean and median."""
    out = {"decelerations_early_count": 0.0, "decelerations_late_count": 0.0, "decelerations_variable_count": float(len(nadirs)), "deceleration_uc_lag_mean_s": np.nan, "deceleration_uc_lag_median_s": np.nan}
    if not len(tops) or not nadirs:
        return out
    p = np.array(nadirs)
    nearest = tops[np.argmin(np.abs(tops[None, :] - p[:, None]), axis=1)]
    lag = (p - nearest) / fs
    early, late = np.abs(lag) <= EARLY_S, (lag > EARLY_S) & (lag <= LATE_S)
    return {"decelerations_early_count": float(early.sum()), "decelerations_late_count": float(late.sum()), "decelerations_variable_count": float((~early & ~late).sum()), "deceleration_uc_lag_mean_s": float(lag.mean()), "deceleration_uc_lag_median_s": float(np.median(lag))}


def variability(fhr: np.ndarray, base: np.ndarray, fs: int = FS) -> dict[str, float]:
    """Amplitude p95 - p5 of the residual in blocks of a minute that are valid enough and free of decelerations."""
    block = LTV_BLOCK_S * fs
    rows = (fhr - base)[: len(fhr) // block * block].reshape(-1, block)
    ok = np.isfinite(rows)
    use = (ok.mean(axis=1) >= LTV_VALID) & (((rows <= -EVENT_BPM) & ok).mean(axis=1) < LTV_DECEL) if len(rows) else np.zeros(0, bool)
    if not use.any():
        return {"ltv_mean_amp_bpm": np.nan, "ltv_median_amp_bpm": np.nan, "ltv_valid_windows": 0.0}
    low, high = np.nanpercentile(rows[use], [5, 95], axis=1)
    return {"ltv_mean_amp_bpm": float((high - low).mean()), "ltv_median_amp_bpm": float(np.median(high - low)), "ltv_valid_windows": float(use.sum())}


def coarse(x: np.ndarray, fs: int = FS) -> np.ndarray:
    """Block means at 1 Hz; a last part block is dropped."""
    n = len(x) // fs * fs
    return x[:n].reshape(-1, fs).mean(axis=1) if n and fs > 1 else x


def limited(x: np.ndarray, most: int = ENTROPY_MAX) -> np.ndarray:
    """Finite values, evenly thinned to `most` at most: this bounds the entropies' pairs."""
    x = x[np.isfinite(x)]
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(np.int64)]


def _within(x: np.ndarray, m: int, r: float, rows: int = 128) -> np.ndarray:
    """For each run of m samples, how many runs differ by r at most in every place, itself included.

    Runs are put in order of their first sample and compared `rows` at a time with those alone whose first sample is near
    enough, so memory is that of `rows` runs against all, not of all pairs.
    """
    runs = np.lib.stride_tricks.sliding_window_view(x, m)
    order = np.argsort(runs[:, 0], kind="stable")
    runs = np.ascontiguousarray(runs[order].T)
    first, out = runs[0], np.empty(len(order), np.int64)
    # a little wider than r, for rounding: the comparison itself decides
    reach = r * (1 + 1e-9) + 1e-12 * np.abs(first).max(initial=0.0)
    for at in range(0, len(order), rows):
        to = min(at + rows, len(order))
        lo, hi = np.searchsorted(first, first[at] - reach, "left"), np.searchsorted(first, first[to - 1] + reach, "right")
        near = np.abs(runs[0, at:to, None] - runs[0, None, lo:hi]) <= r
        for j in range(1, m):
            near &= np.abs(runs[j, at:to, None] - runs[j, None, lo:hi]) <= r
        out[order[at:to]] = near.sum(axis=1)
    return out


def entropies(x: np.ndarray, m: int = ENTROPY_ORDER, share: float = ENTROPY_R, most: int | None = ENTROPY_MAX) -> tuple[float, float]:
    """Approximate entropy (self-matches in) and sample entropy (without; each order with its own number of runs), of `most` samples evenly spread; most=None takes all."""
    x = np.asarray(x, np.float64)
    x = limited(x, len(x) if most is None else most)
    r = share * x.std() if len(x) else 0.0
    if len(x) < m + 2 or not r > 0:
        return np.nan, np.nan
    low, high = _within(x, m, r), _within(x, m + 1, r)
    apen = np.log(low / len(low)).mean() - np.log(high / len(high)).mean()
    b, a = (low - 1).sum() / 2, (high - 1).sum() / 2
    return float(apen), float(-np.log(a / b)) if a > 0 and b > 0 else np.nan


def fluctuation(x: np.ndarray, scales: tuple = DFA_SCALES) -> dict[str, float]:
    """Detrended fluctuation analysis: slope and intercept of log fluctuation over log scale, and the slopes of both halves."""
    out = dict.fromkeys(("dfa_alpha", "dfa_intercept", "dfa_alpha_short", "dfa_alpha_long"), np.nan)
    x = np.asarray(x, np.float64)
    x = x[np.isfinite(x)]
    if len(x) < 2 * max(scales) or not x.std() > 0:
        return out
    profile, points = np.cumsum(x - x.mean()), []
    for s in scales:
        rows = profile[: len(x) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        rows = rows - rows.mean(axis=1, keepdims=True)
        rest = rows - (rows @ t / (t @ t))[:, None] * t
        f = np.sqrt((rest**2).mean())
        if f > 0:
            points.append((np.log(s), np.log(f)))
    if len(points) < 2:
        return out
    u, v = np.array(points).T
    half = max(2, len(points) // 2)
    out["dfa_alpha"], out["dfa_intercept"] = slope(v, u)
    out["dfa_alpha_short"] = slope(v[:half], u[:half])[0]
    if len(points) - half >= 2:
        out["dfa_alpha_long"] = slope(v[half:], u[half:])[0]
    return out


def features(fhr: np.ndarray, uc: np.ndarray, fs: int = FS) -> dict[str, float]:
    """The 28 features of one window of both channels."""
    fhr, fhr_gone = clean(fhr, *FHR_RANGE, zero_missing=True)
    uc, uc_gone = clean(uc, *UC_RANGE, zero_missing=True)
    base = baseline(fhr, fs)
    some = len(base) and not np.isnan(base).all()
    up, down = (sustained(fhr - base, True, fs), sustained(fhr - base, False, fs)) if some else ([], [])
    # entropies and fluctuation analysis look at the same thinned signal
    tops, slow = contractions(uc, fs), limited(coarse(fhr, fs))
    apen, sampen = entropies(slow)
    mean = lambda v: float(np.mean(v)) if v else 0.0
    out = {"signal_duration_min": len(fhr) / (fs * 60.0), "fhr_invalid_pct": fhr_gone, "uc_invalid_pct": uc_gone}
    out |= {"fhr_baseline_mean_bpm": float(base.mean()) if some else np.nan, "fhr_baseline_median_bpm": float(np.median(base)) if some else np.nan, "fhr_baseline_std_bpm": float(base.std()) if some else np.nan}
    out["fhr_baseline_slope_bpm_min"] = slope(base, np.arange(len(base)) / (fs * 60.0))[0]
    for name, events in (("accelerations", up), ("decelerations", down)):
        out |= {f"{name}_count": float(len(events)), f"{name}_mean_amp_bpm": mean([e[3] for e in events]), f"{name}_mean_duration_s": mean([(e[1] - e[0]) / fs for e in events])}
    out |= {"uc_contractions_count": float(len(tops)), "fhr_apen": apen, "fhr_sampen": sampen}
    return out | variability(fhr, base, fs) | classify([e[2] for e in down], tops, fs) | fluctuation(slow)


#: Names of the features, in order.
FEATURES = tuple(features(np.full(8, np.nan), np.full(8, np.nan)))


def autocorrelation(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Autocorrelation of the finite samples at lags 0..max_lag, by way of the spectrum: the mean product at each lag over that at lag 0.

    Lags that the series doesn't reach are 0, and so are all of a constant series. An empty series has none.
    """
    x = x[np.isfinite(x)]
    out = np.zeros(max_lag + 1)
    if not len(x):
        return np.full(max_lag + 1, np.nan)
    # a deviation of rounding alone counts as none
    d = x - x.mean()
    if not np.abs(d).max() > 1e-12 * max(1.0, np.abs(x).max()):
        return out
    n = min(max_lag + 1, len(d))
    c = np.fft.irfft(np.abs(np.fft.rfft(d, 2 * len(d))) ** 2, 2 * len(d))[:n] / (len(d) - np.arange(n))
    out[:n] = c / c[0]
    return out


def lag_sums(v: np.ndarray, size: int, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the products at lags 0..max_lag of each of the first `size` samples with later ones of `v`, which goes on for max_lag samples more unless the series ends. Missing samples (NaN) give no product."""
    own, wide = v[:size], np.full(min(len(v), size) + max_lag, np.nan)
    wide[: min(len(v), len(wide))] = v[: len(wide)]
    good = ~np.isnan(wide)
    sums = np.correlate(np.where(good, wide, 0.0), np.nan_to_num(own), "valid")
    return sums, np.rint(np.correlate(good.astype(np.float64), good[: len(own)].astype(np.float64), "valid")).astype(np.int64)


def welch(x: np.ndarray, fs: float = FS, least: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and density: Hann windows of min(256, n / 4) samples, half overlapping, each less its mean. A series of fewer than `least` samples has none."""
    x = x[np.isfinite(x)]
    n = min(256, len(x) // 4)
    if n < 2 or len(x) < least:
        return np.zeros(0), np.zeros(0)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    rows = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    p = np.abs(np.fft.rfft((rows - rows.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w @ w))
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p.mean(axis=0)


def cross_correlation(x: np.ndarray, y: np.ndarray, max_lag: int = 200) -> np.ndarray:
    """Correlation at lags -max_lag..max_lag, over the product of length and both deviations; NaN if one is constant, or of fewer than 2 max_lag + 1 pairs."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok] - x[ok].mean() if ok.any() else x[:0], y[ok] - y[ok].mean() if ok.any() else y[:0]
    n, out = len(x), np.full(2 * max_lag + 1, np.nan)
    if n >= 2 * max_lag + 1 and x.std() * y.std() > 0:
        lags = range(-min(max_lag, n - 1), min(max_lag, n - 1) + 1)
        for k in lags:
            out[k + max_lag] = (x[max(0, k) : n + min(0, k)] @ y[max(0, -k) : n - max(0, k)]) / (n * x.std() * y.std())
    return out


def jitter_warp(x: np.ndarray, length: int, seed: int, jitter: float = 1.5, warp: float = 0.05) -> np.ndarray:
    """The series with noise, read along a distorted time, then cut or repeated to `length`. Depends on the seed and the series alone.

    Time is bent at evenly spaced anchors, ten at least or one per 50 samples: each is moved by a normal offset of
    `warp` times the series' length and held within it, and the moved anchors are put in order.
    """
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 2:
        return np.full(length, x[0] if n else np.nan)
    rng = np.random.Generator(np.random.Philox(seed))
    noisy = x + jitter * rng.standard_normal(n)
    count = max(10, n // 50)
    anchors = np.linspace(0, n - 1, count)
    moved = np.sort(np.clip(anchors + warp * n * rng.standard_normal(count), 0, n - 1))
    at = np.arange(n)
    return np.resize(np.interp(np.interp(at, anchors, moved), at, noisy), length)
