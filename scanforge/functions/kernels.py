"""Numpy kernels for what has no relational form: peak shapes, non-negative sparse coding, isotope patterns.

They take and return arrays and know nothing of Spark.
"""

from __future__ import annotations

import math

import numpy as np

from scanforge.functions import coding

ALGORITHMS = ("threshold", "lasso_cd", "lasso_lars", "lars", "omp")


def local_peaks(y: np.ndarray) -> np.ndarray:
    """Interior maxima; a plateau counts as its middle, the lower of two, and not if it meets an end."""
    y = np.asarray(y, float)
    if len(y) < 3:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    stop = np.append(start[1:], len(y)) - 1
    level = y[start]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (start[top] + stop[top]) // 2


def prominences(y: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height of each peak over the higher of the lowest points on its two sides, and where those lie.

    A side reaches to the first higher value or the end of the series; of equal lowest
    points the one nearest to the peak counts.
    """
    prom, left, right = np.zeros(len(peaks)), np.zeros(len(peaks), np.int64), np.zeros(len(peaks), np.int64)
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(y[:p] > y[p])
        a = higher[-1] + 1 if len(higher) else 0
        higher = np.flatnonzero(y[p + 1 :] > y[p])
        b = p + higher[0] if len(higher) else len(y) - 1
        back = y[a : p + 1][::-1]
        left[k], right[k] = p - back.argmin(), p + y[p : b + 1].argmin()
        prom[k] = y[p] - max(y[left[k]], y[right[k]])
    return prom, left, right


def widths(y: np.ndarray, peaks: np.ndarray, rel_height: float, shape=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Width, evaluation height, and interpolated left and right crossing of each peak. shape: its prominences, if known."""
    prom, left_base, right_base = shape or prominences(y, peaks)
    height = y[peaks] - prom * rel_height
    left, right = np.zeros(len(peaks)), np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        i = p
        while i > left_base[k] and y[i] > height[k]:
            i -= 1
        left[k] = i + (height[k] - y[i]) / (y[i + 1] - y[i]) if y[i] < height[k] else i
        i = p
        while i < right_base[k] and y[i] > height[k]:
            i += 1
        right[k] = i - (height[k] - y[i]) / (y[i - 1] - y[i]) if y[i] < height[k] else i
    return right - left, height, left, right


def find_peaks(y, height: float | None = None, prominence: float | None = None, distance: int | None = None, width: tuple[float | None, float | None] | None = None, rel_height: float = 0.5) -> dict[str, np.ndarray]:
    """Peaks that meet all conditions, with their shape. Bounds are inclusive.

    Conditions apply in the order height, distance (higher peaks win), prominence, width.
    """
    y = np.asarray(y, float)
    peaks = local_peaks(y)
    if height is not None:
        peaks = peaks[y[peaks] >= height]
    if distance is not None and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(y[peaks], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < math.ceil(distance)
                near[k] = False
                keep[near] = False
        peaks = peaks[keep]
    prom, left_base, right_base = prominences(y, peaks)
    if prominence is not None:
        ok = prom >= prominence
        peaks, prom, left_base, right_base = peaks[ok], prom[ok], left_base[ok], right_base[ok]
    w, h, left, right = widths(y, peaks, rel_height, (prom, left_base, right_base))
    if width is not None:
        ok = np.ones(len(peaks), bool)
        if width[0] is not None:
            ok &= w >= width[0]
        if width[1] is not None:
            ok &= w <= width[1]
        peaks, prom, left_base, right_base = peaks[ok], prom[ok], left_base[ok], right_base[ok]
        w, h, left, right = w[ok], h[ok], left[ok], right[ok]
    return {"peaks": peaks, "prominences": prom, "left_bases": left_base, "right_bases": right_base, "widths": w, "width_heights": h, "left_ips": left, "right_ips": right}


def spectrum_peaks(x, y, rel_height: float = 0.75, distance: int | None = None, prominence: float | None = None) -> dict[str, np.ndarray]:
    """Peaks of a spectrum: apex, bounds rounded half to even, width in m/z, summed intensity with both ends."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    found = find_peaks(y, height=0, prominence=prominence, distance=distance, rel_height=rel_height)
    start, end = np.rint(found["left_ips"]).astype(np.int64), np.rint(found["right_ips"]).astype(np.int64)
    total = np.concatenate([[0.0], np.cumsum(y)])
    return {
        "apex_mzidx": found["peaks"], "apex_mz": x[found["peaks"]], "start_mzidx": start, "start_mz": x[start], "end_mzidx": end, "end_mz": x[end],
        "peak_width": x[end] - x[start], "peak_height": found["width_heights"],
        "peak_intensity_sum": np.array([y[a : b + 1].sum() for a, b in zip(start, end, strict=True)], float) if len(start) else total[:0],
    }


def gaussian(t: np.ndarray, v: np.ndarray, bandwidth: float, at: np.ndarray | None = None) -> np.ndarray:
    """Values of a series in order of time, at the places ``at`` (all), smoothed by a normalised
    Gaussian kernel, each weighted term rounded half to even.

    Only points whose weight is more than 0 in double precision are looked at.
    """
    at = np.arange(len(t)) if at is None else at
    low = np.searchsorted(t, t[at] - 39 * bandwidth)
    high = np.searchsorted(t, t[at] + 39 * bandwidth, side="right")
    out = np.empty(len(at))
    for k, (i, a, b) in enumerate(zip(at.tolist(), low.tolist(), high.tolist(), strict=True)):
        w = np.exp(-((t[a:b] - t[i]) ** 2) / (2 * bandwidth * bandwidth))
        out[k] = np.rint(v[a:b] * w / w.sum()).sum()
    return out


def trapezoid(y, t) -> float:
    y, t = np.asarray(y, float), np.asarray(t, float)
    return float((np.diff(t) * (y[1:] + y[:-1]) / 2).sum())


def elution_peaks(act, times, center: float, n_peaks: int = 1, width=(2, None), height=(None, None)) -> dict[str, np.ndarray]:
    """Peaks of an activation series at their full prominence, with area and distance to ``center``.

    The area runs from one scan before the start to the end; at the first scan it starts there.
    """
    act, times = np.asarray(act, float), np.asarray(times, float)
    found = find_peaks(act, height=height[0], width=width, rel_height=1.0)
    if height[1] is not None:
        ok = act[found["peaks"]] <= height[1]
        found = {k: v[ok] for k, v in found.items()}
    apex = found["peaks"]
    start, end = np.rint(found["left_ips"]).astype(np.int64), np.rint(found["right_ips"]).astype(np.int64)
    area = np.array([trapezoid(act[max(a - 1, 0) : b + 1], times[max(a - 1, 0) : b + 1]) for a, b in zip(start, end, strict=True)], float)
    gap = np.abs(times[apex] - center)
    closest = np.zeros(len(apex), bool)
    closest[np.argsort(gap, kind="stable")[:n_peaks]] = True
    return {
        "apex": apex, "apex_time": times[apex], "start": start, "start_time": times[start], "end": end, "end_time": times[end], "peak_width": (end - start).astype(float),
        "peak_height": found["width_heights"], "peak_intensity_auc": area, "rt_search_center_diff": gap, "closest_to_search_center": closest,
    }


def repair_minima(act, minima_width: float = 3, prominence: float = 10000) -> np.ndarray:
    """Narrow deep minima replaced by the mean of the values at their edges, nearer ones counting more.

    Minima are found on the input and repaired in order, so a later one sees earlier repairs.
    """
    act = np.asarray(act, float)
    found = find_peaks(-act, prominence=prominence, rel_height=1.0)
    out = act.copy()
    for p, w, left, right in zip(found["peaks"], found["widths"], found["left_ips"], found["right_ips"], strict=True):
        if w <= minima_width:
            a, b = math.floor(left), math.ceil(right)
            near_a, near_b = 1 / max(p - a, 1), 1 / max(b - p, 1)
            out[p] = (out[a] * near_a + out[b] * near_b) / (near_a + near_b)
    return out


def nonnegative_lasso(gram, projection, alpha: float = 0.0, most: int = 1000, tol: float = 1e-8, start=None) -> np.ndarray:
    """a >= 0 with the least a'Ga/2 - c'a + alpha * sum(a), by cyclic coordinate descent.

    It ends when no coordinate of a sweep moves the objective's gradient by more than ``tol``
    of the largest projection. Columns that are nearly alike would take thousands of sweeps, so
    after 1, 2, 4, ... sweeps the minimum is also sought by active sets from where the sweeps are.
    """
    g, c = np.asarray(gram, float), np.asarray(projection, float)
    a = np.zeros(len(c)) if start is None else np.array(start, float)
    slope, diag = c - alpha - g @ a, np.diag(g).tolist()
    places = [j for j, x in enumerate(diag) if x > 0]
    enough = tol * max(1.0, float(np.abs(c).max(initial=0.0)))
    for sweep in range(1, most + 1):
        moved = 0.0
        for j in places:
            step = max(-a[j], slope[j] / diag[j])
            if step:
                a[j] += step
                slope -= step * g[j]
                moved = max(moved, abs(step) * diag[j])
        if moved <= enough:
            break
        if sweep & (sweep - 1) == 0 and (exact := _active_set(g, c - alpha, a, enough)) is not None:
            return exact
    return a


def _active_set(g: np.ndarray, b: np.ndarray, start: np.ndarray, enough: float) -> np.ndarray | None:
    """a >= 0 with the least a'Ga/2 - b'a, from the columns that are active in ``start``; None if they depend on each other.

    The active columns are solved for. Where one would turn negative, the step ends as the first
    of them reaches 0 and leaves; else the column of the steepest slope over ``enough`` joins.
    """
    a, on, usable = start.copy(), start > 0, np.diag(g) > 0
    for _ in range(3 * len(b) + 10):
        own = np.flatnonzero(on)
        try:
            x = np.linalg.solve(g[np.ix_(own, own)], b[own])
        except np.linalg.LinAlgError:
            return None
        down = ~(x > 0)
        if down.any():
            share = a[own[down]] / np.maximum(a[own[down]] - x[down], 1e-300)
            step = float(share.min())
            a[own] = a[own] + step * (x - a[own])
            gone = own[down][share <= step * (1 + 1e-12)]
            a[gone], on[gone] = 0.0, False
            continue
        a[own] = x
        slope = b - g[:, own] @ x
        if not np.abs(slope[own]).max(initial=0.0) <= enough:
            return None
        slope[on | ~usable] = -np.inf
        if slope.max(initial=-np.inf) <= enough:
            return a
        on[int(slope.argmax())] = True
    return None


def soft_threshold(projection, alpha: float = 0.0) -> np.ndarray:
    return np.maximum(np.asarray(projection, float) - alpha, 0.0)


def cosine_distance(y, fit) -> float:
    y, fit = np.asarray(y, float), np.asarray(fit, float)
    size = math.sqrt((y @ y) * (fit @ fit))
    return 1 - float(y @ fit) / size if size > 0 else float("nan")


def encode(y, d, alpha: float = 0.0, algorithm: str = "threshold", loss: str = "lasso") -> np.ndarray:
    """Non-negative activations of dictionary columns ``d`` for the observation ``y``.

    ``threshold`` soft-thresholds the projection; ``lasso_cd`` (coordinate descent) and ``lasso_lars`` (its path) solve the lasso
    of squared error over 2. For ``lars`` and ``omp`` alpha is the most columns that may be active, 0 for any number: ``lars`` takes the last knot of
    the non-negative path with no more, ``omp`` the non-negative pursuit. With ``loss="sqrt_lasso"`` the mean squared error is meant, so
    alpha is scaled by half the number of rows.
    """
    y, d = np.asarray(y, float), np.asarray(d, float)
    if loss == "sqrt_lasso":
        return nonnegative_lasso(d.T @ d, d.T @ y, alpha * len(y) / 2)
    return Encoder(y, d, algorithm)(alpha)


class Encoder:
    """Activations of one observation at any alpha; what does not depend on alpha is made once."""

    def __init__(self, y, d, algorithm: str):
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm}; one of {', '.join(ALGORITHMS)}")
        self.algorithm, self.projection = algorithm, d.T @ y
        self.gram = None if algorithm == "threshold" else d.T @ d
        self.path = coding.lasso_path(self.gram, self.projection) if algorithm in ("lars", "lasso_lars") else None

    def __call__(self, alpha: float) -> np.ndarray:
        if self.algorithm == "threshold":
            return soft_threshold(self.projection, alpha)
        if self.algorithm == "lasso_cd":
            return nonnegative_lasso(self.gram, self.projection, alpha)
        if self.algorithm == "lasso_lars":
            return coding.read_path(*self.path, alpha)
        if self.algorithm == "lars":
            return coding.read_steps(self.path[1], int(alpha))
        return coding.nonnegative_pursuit(self.gram, self.projection, int(alpha))


def choose_alpha(y, d, alphas: list[float], algorithm: str = "threshold", loss: str = "lasso", criteria: str = "min", metric: str = "cos_dist", eps: float = 1e-4) -> tuple[float, np.ndarray, float]:
    """The alpha, activations and metric of the best fit on the path 0, then ``alphas``.

    ``min`` takes the least metric, the first of equals. ``convergence`` stops where the metric
    falls by ``eps`` or less, or takes the alpha before where it rises.
    """
    y, d = np.asarray(y, float), np.asarray(d, float)
    at = Encoder(y, d, algorithm) if loss == "lasso" else lambda alpha: encode(y, d, alpha, algorithm, loss)

    def measure(a):
        return cosine_distance(y, d @ a) if metric == "cos_dist" else math.sqrt(float(np.mean((y - d @ a) ** 2)))

    tried = []
    for alpha in [0.0, *alphas]:
        a = at(alpha)
        tried.append((measure(a), alpha, a))
        if criteria == "convergence" and len(tried) > 1:
            fall = tried[-2][0] - tried[-1][0]
            if 0 < fall <= eps:
                return tried[-1][1], tried[-1][2], tried[-1][0]
            if fall < 0:
                return tried[-2][1], tried[-2][2], tried[-2][0]
    scores = np.array([t[0] for t in tried])
    best = int(np.nanargmin(scores)) if np.isfinite(scores).any() else 0
    return tried[best][1], tried[best][2], tried[best][0]


def cross_validate(y, d, alphas: list[float], folds: int = 10, algorithm: str = "lasso_cd", seed: int = 0) -> tuple[float, np.ndarray]:
    """The alpha with the least mean squared error over held-out rows, and the error of each."""
    y, d = np.asarray(y, float), np.asarray(d, float)
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    errors = np.zeros(len(alphas))
    for k in range(folds):
        out = fold == k
        for i, alpha in enumerate(alphas):
            a = encode(y[~out], d[~out], alpha, algorithm)
            errors[i] += float(((y[out] - d[out] @ a) ** 2).sum())
    errors /= max(len(y), 1)
    return alphas[int(errors.argmin())], errors


# Natural isotopes of C, H, N, O and S, as (mass, abundance); monoisotopic residue formulas.
ISOTOPES = {
    "C": ((12.0, 0.9893), (13.00335483507, 0.0107)),
    "H": ((1.00782503223, 0.999885), (2.01410177812, 0.000115)),
    "N": ((14.00307400443, 0.99636), (15.00010889888, 0.00364)),
    "O": ((15.99491461957, 0.99757), (16.9991317565, 0.00038), (17.99915961286, 0.00205)),
    "S": ((31.9720711744, 0.9499), (32.9714589098, 0.0075), (33.967867004, 0.0425), (35.96708071, 0.0001)),
}
RESIDUES = {
    "A": (3, 5, 1, 1, 0), "R": (6, 12, 4, 1, 0), "N": (4, 6, 2, 2, 0), "D": (4, 5, 1, 3, 0), "C": (3, 5, 1, 1, 1), "E": (5, 7, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "G": (2, 3, 1, 1, 0),
    "H": (6, 7, 3, 1, 0), "I": (6, 11, 1, 1, 0), "L": (6, 11, 1, 1, 0), "K": (6, 12, 2, 1, 0), "M": (5, 9, 1, 1, 1), "F": (9, 9, 1, 1, 0), "P": (5, 7, 1, 1, 0), "S": (3, 5, 1, 2, 0),
    "T": (4, 7, 1, 2, 0), "W": (11, 10, 2, 1, 0), "Y": (9, 9, 1, 2, 0), "V": (5, 9, 1, 1, 0),
}


def composition(sequence: str, charge: int, carbamidomethyl: bool = True) -> dict[str, int]:
    """Atoms of a modified peptide: water, ``charge`` hydrogens, oxidations ``M(ox)`` and acetyl groups ``(ac)``."""
    bare = sequence.strip("_")
    ox, ac = bare.count("M(ox)"), bare.count("(ac)")
    bare = bare.replace("(ox)", "").replace("(ac)", "")
    c, h, n, o, s = (sum(RESIDUES[r][i] for r in bare) for i in range(5))
    cam = bare.count("C") if carbamidomethyl else 0
    return {"C": c + 2 * cam + 2 * ac, "H": h + 3 * cam + 2 + charge + 2 * ac, "N": n + cam, "O": o + cam + 1 + ac + ox, "S": s}


def isotope_pattern(sequence: str, charge: int, threshold: float = 0.005, carbamidomethyl: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """m/z and probability of the isotopologues whose absolute probability is over ``threshold``, by mass.

    Elements are combined one at a time; partial isotopologues under the threshold cannot
    rise over it again and are dropped at once.
    """
    mass, prob = np.zeros(1), np.ones(1)
    for element, atoms in composition(sequence, charge, carbamidomethyl).items():
        own = _element_isotopologues(ISOTOPES[element], atoms, threshold)
        mass, prob = (mass[:, None] + own[0][None, :]).ravel(), (prob[:, None] * own[1][None, :]).ravel()
        mass, prob = mass[prob > threshold], prob[prob > threshold]
    order = np.argsort(mass, kind="stable")
    return mass[order] / charge, prob[order]


def _element_isotopologues(isotopes, atoms: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts of heavy isotopes by the multinomial, grown one isotope at a time."""
    partial = [(atoms, 0.0, math.lgamma(atoms + 1))]
    for m, p in isotopes[1:]:
        grown = []
        for left, mass, logp in partial:
            for k in range(left + 1):
                add = logp + k * math.log(p) - math.lgamma(k + 1)
                rest = add + (left - k) * math.log(isotopes[0][1]) - math.lgamma(left - k + 1)
                if rest <= math.log(threshold) - 4 and k > left * p:
                    break
                grown.append((left - k, mass + k * m, add))
        partial = grown
    final = [(mass + left * isotopes[0][0], math.exp(logp + left * math.log(isotopes[0][1]) - math.lgamma(left + 1))) for left, mass, logp in partial]
    kept = [(m, p) for m, p in final if p > threshold]
    return np.array([m for m, _ in kept]), np.array([p for _, p in kept])
