"""The search in plain Python, one candidate after the other, for small inputs."""

from fractions import Fraction


def distance(values, q, h, width, d):
    """Exact distance, or None when the two windows share no observed slot."""
    def at(i):
        return values[i] if 0 <= i < len(values) and i != q else None

    num = den = Fraction(0)
    for side in (-1, 1):
        kept = [j for j in range(1, width + 1)
                if at(q + side * j) is not None and at(h + side * j) is not None][:d]
        for j in kept:
            weight = kept[0] + kept[-1] - j
            num += weight * abs(Fraction(at(q + side * j)) - Fraction(at(h + side * j)))
            den += weight
    return num / den if den else None


def candidates(values, q, period, width, v):
    n = len(values) // period
    for shift in sorted(range(-v, v + 1), key=lambda s: (abs(s), s > 0)):
        for season in range(1, n - 1):
            h = season * period + q % period + shift
            if h - width >= 0 and h + width <= len(values) - 1:
                yield h, shift, season


def predictions(values, q, period, width, ks, ds, vs, sentinel=None):
    """{(k, d, v): prediction}; with a sentinel unusable candidates fill up."""
    out = {}
    for d in ds:
        for v in vs:
            found = []
            for h, _, _ in candidates(values, q, period, width, v):
                value = values[h] if h != q else None
                dist = None if value is None else distance(values, q, h, width, d)
                if dist is None:
                    if sentinel is None:
                        continue
                    dist = Fraction(999)
                    value = -2 if h == q else sentinel if value is None else value
                found.append((dist, value))
            found.sort(key=lambda c: c[0])
            for k in ks:
                near = [value for _, value in found[:k]]
                out[k, d, v] = sum(near) / len(near) if near else None
    return out
