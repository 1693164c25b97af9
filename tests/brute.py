"""Row-by-row textbook formulas on Python lists, for comparison."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

Z = 1.96


def missing(x):
    return x is None or (isinstance(x, float) and math.isnan(x))


def ratio_ci(rows, z=Z):
    """rows: (y, w, stratum, psu). Rows without weight are left out, rows without design key count in R only."""
    rows = [r for r in rows if not missing(r[1])]
    total = sum(w for _, w, _, _ in rows)
    ratio = sum(w * y for y, w, _, _ in rows) / total
    psus = defaultdict(float)
    for y, w, h, a in rows:
        if not missing(h) and not missing(a):
            psus[h, a] += w * (y - ratio)
    strata = defaultdict(list)
    for (h, _), value in psus.items():
        strata[h].append(value)
    spread = 0.0
    for values in strata.values():
        n = len(values)
        if n > 1:
            center = sum(values) / n
            spread += n / (n - 1) * sum((v - center) ** 2 for v in values)
    se = math.sqrt(spread) / total
    return {"estimate": ratio, "se": se, "lci": ratio - z * se, "uci": ratio + z * se, "n": len(rows),
            "n_psu": len(psus), "n_strata": len(strata), "denominator_weighted": total}


def curve(rows):
    pairs = sorted((y, w) for y, w, *_ in rows if not missing(w) and w > 0)
    y = np.array([p[0] for p in pairs], float)
    w = np.array([p[1] for p in pairs], float)
    return y, (np.cumsum(w) - 0.5 * w) / w.sum()


def quantile(rows, q):
    y, k = curve(rows)
    return float(np.interp(q, k, y))


def quantile_ci(rows, q, z=Z):
    point = quantile(rows, q)
    found = ratio_ci([(1.0 if y <= point else 0.0, w, h, a) for y, w, h, a in rows], z)
    y, k = curve(rows)
    low, high = max(0.0, q - z * found["se"]), min(1.0, q + z * found["se"])
    return {"estimate": point, "se": found["se"], "lci": float(np.interp(low, k, y)),
            "uci": float(np.interp(high, k, y)), "n": found["n"]}
