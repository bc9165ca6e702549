"""Nearest neighbours tile by tile, for wide windows.

Spark cuts queries and history into tiles (:mod:`tidegap.operators.season_blocks`),
deals them to tasks by their cost and streams them; a small NumPy function compares the
seasons of one tile and hands back only what can still be among the nearest ``max(k)``.
A tile is bounded by the :class:`Shape`, whatever the length of the series.

Within a tile a query season and a history season are compared once for each shift. The
windows of all queries of the season are ranges of that one row of differences: its joint
slots are numbered, and running sums over them give the ``d`` nearest joint slots of any
query on either side, with their weighted differences, by looking up the ends of a range.
Comparisons for a larger ``d`` stop where the sums of a smaller one already show that the
candidate is farther than the ``max(k)`` nearest met so far. Decimal fractions are compared as whole numbers, so running sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tidegap.operators.neighbours import MAX_DISTANCE, OWN_SLOT, PLACES
from tidegap.operators.season_blocks import OWN, Shape, dealt_tiles

_SCHEMA = (
    "series_id string, q_idx bigint, d int, v int, "
    "near array<struct<dist:double,shift_rank:int,season:int,h_value:double>>"
)
# Array elements compared at a time; small enough for a processor cache.
_BATCH = 1 << 16
# Distances kept at a time while the nearest are chosen.
_DISTANCES = 1 << 23
# Decimal places up to which values are compared as whole numbers.
_DECIMALS = 6


def _may_enter(low, den, bound):
    """Which candidates can still be among the nearest: their distance is at least ``low / den``."""
    return low <= bound * den


def _range_distances(diff, centre, reach: int, d: list[int], unit: float, bound=None):
    """Distances for each ``d``, row and query, infinite where no slot is joint.

    ``diff`` holds a row of absolute differences for each pair of seasons and shift, NaN
    where a slot is not joint; ``centre`` the column of each query. Also tells where fewer
    than ``max(d)`` joint slots lie within ``reach`` on a side.

    ``bound`` holds distances beyond which a candidate is not wanted. The offsets of a
    smaller ``d`` are among those of a larger one, so their part of its sum is a lower
    bound; where that is beyond, the rest is not looked up, and the distance is infinite.
    """
    import numpy as np

    joint = ~np.isnan(diff)
    flat = np.flatnonzero(joint)
    x = diff.ravel()[flat]
    place = (flat % diff.shape[1]).astype(diff.dtype)
    before = np.zeros((3, len(x) + 1), dtype=diff.dtype)
    np.cumsum(x, out=before[0, 1:])
    np.cumsum(x * place, out=before[1, 1:])
    np.cumsum(place, out=before[2, 1:])
    place = np.append(place, 0)
    upto = joint.cumsum(axis=1, dtype=np.int32)
    start = (np.append(0, upto[:-1, -1].cumsum(dtype=np.int64)) if len(upto) else np.empty(0, np.int64))[:, None]
    lowest = np.where(centre - reach >= 1, centre - reach - 1, -1)
    found_right = upto[:, np.minimum(centre + reach, diff.shape[1] - 1)] - upto[:, centre]
    left_end = upto[:, np.maximum(centre - 1, 0)] * (centre >= 1)
    found_left = left_end - upto[:, np.maximum(lowest, 0)] * (lowest >= 0)
    few = np.minimum(found_left, found_right) < d[-1]
    sides = []
    for sign, found, edge in ((1, found_right, start + upto[:, centre]), (-1, found_left, start + left_end)):
        # The nearest joint slot of a side, and the sums up to it, serve every ``d``.
        first = place[edge] if sign > 0 else place[np.maximum(edge - 1, 0)]
        sides.append((sign, found, edge, first, [b[edge] for b in before], [0.0, 0.0]))
    dist = np.empty((len(d), *found_left.shape))
    for i, one in enumerate(d):
        den, low, fars = 0, 0, []
        for sign, found, edge, first, at_edge, known in sides:
            n = np.minimum(found, one)
            far = edge + sign * n
            last = place[np.maximum(far - 1, 0)] if sign > 0 else place[far]
            # Offsets are distances of places from the centre.
            ends = sign * (first + last - 2 * centre)
            den = den + ends * n - (before[2][far] - at_edge[2] - sign * centre * n)
            low = low + ends * known[0] - known[1]
            fars.append((ends, far))
        look = slice(None)
        if bound is not None and i:
            look = np.nonzero(few | _may_enter(low, den * (unit or 1.0), bound[i]))
        num = 0
        for (sign, _, _, _, at_edge, known), (ends, far) in zip(sides, fars):
            total = sign * (before[0][far[look]] - at_edge[0][look])
            by_offset = before[1][far[look]] - at_edge[1][look] - np.broadcast_to(centre, far.shape)[look] * (sign * total)
            if look == slice(None):
                known[0], known[1] = total, by_offset
            else:
                known[0][look], known[1][look] = total, by_offset
            num = num + ends[look] * total - by_offset
        dist[i] = np.inf
        with np.errstate(invalid="ignore", divide="ignore"):
            found = num / (den[look] * (unit or 1.0))
        dist[i][look] = np.where(den[look] > 0, found, np.inf)
    return dist, few


def _unit(*tables, power: int = 1) -> float:
    """Power of ten that makes all values whole and keeps running sums of their powers exact, or 0."""
    import numpy as np

    largest = max((float(np.nanmax(np.abs(t), initial=0)) for t in tables if t.size), default=0.0)
    for places in range(_DECIMALS + 1):
        unit = 10.0**places
        if (2 * largest * unit) ** power * _BATCH * max(t.shape[-1] for t in tables) >= 2**53:
            break
        if all(np.array_equal(np.rint(t * unit) / unit, t, equal_nan=True) for t in tables):
            return unit
    return 0.0


def _tile_function(shape: Shape, k: list[int], d: list[int], v: list[int], sentinel: float | None):
    """The function for one tile. With parameters in the rows, ``k``, ``d`` and ``v`` are theirs."""
    period, margin = shape.period, shape.margin

    def neighbours(q_season, slots, q_vals, vals, season, n_slots, unit, reach, width, v_max, k_max, d, rings):
        """The nearest candidates of some queries of a season for each ``d`` and number of rings.

        Yields the number of rings less one, query, ``d`` and number of its candidates for
        each list, and the columns of the candidates, list after list.
        """
        import numpy as np

        max_shift = v_max[-1]
        shifts = np.arange(-max_shift, max_shift + 1)
        q_idx = q_season * period + slots
        h_idx = season[:, None] * period + (slots[:, None] + shifts)[:, None, :]
        lag = h_idx - q_idx[:, None, None]
        value = np.moveaxis(vals[:, slots[:, None] + shifts + margin], 0, 1)
        value = np.where(lag == 0, np.nan, value)
        inside = (h_idx >= width) & (h_idx + width <= n_slots - 1)
        usable = inside & ~np.isnan(value)
        scaled = (np.rint(vals * unit), np.rint(q_vals * unit)) if unit else (
            vals.astype(np.longdouble), q_vals.astype(np.longdouble))
        dist = np.full((len(d), len(slots), len(season), len(shifts)), np.inf)

        def compare(history, of, wanted, reach):
            """Distances of the queries ``of`` to ``wanted`` (query, season, shift) of ``history``."""
            centre = slots[of] + margin
            lo = max(0, centre.min() - reach)
            query = scaled[1][lo:centre.max() + reach + 1]
            windows = np.lib.stride_tricks.sliding_window_view(history, len(query), axis=1)
            b, s = wanted.any(axis=0).nonzero()
            step = max(1, _BATCH // len(query))
            for at in range(0, len(b), step):
                bs, ss = b[at:at + step], s[at:at + step]
                diff = np.abs(windows[bs, lo + shifts[ss]] - query)
                beyond = None
                if bound is not None:
                    beyond = bound[:, of[:, None], ring_of[ss]].transpose(0, 2, 1)
                found, few = _range_distances(diff, centre - lo, reach, d, unit, beyond)
                asked = wanted[:, bs, ss]
                place = (slice(None), of[:, None], bs, ss)
                dist[place] = np.where(asked, found.transpose(0, 2, 1), dist[place])
                if reach < width and (few := few.T & asked).any():
                    further = np.zeros_like(wanted)
                    further[:, bs, ss] = few
                    compare(history, of, further, min(width, 4 * reach))

        # Where windows may meet the query's own slot, which counts as missing for it alone.
        close = np.abs(season - q_season) * period <= width + max_shift
        every = np.arange(len(slots))
        ring_of = np.searchsorted(v_max, np.abs(shifts))
        bound = None
        # Some of the history first: its nearest bound what the rest has to be compared for.
        for wave in (np.arange(len(season)) % 8 == 0, np.arange(len(season)) % 8 == 4,
                     np.arange(len(season)) % 4 == 2, np.arange(len(season)) % 2 == 1):
            compare(scaled[0], every, usable & (wave & ~close)[None, :, None], reach)
            if sentinel is None and len(d) > 1:
                by_ring = [dist.reshape(len(d), len(slots), -1)[:, :, order] for order in rings]
                bound = np.stack([np.partition(x, k_max - 1, axis=2)[:, :, k_max - 1] if x.shape[2] > k_max
                                  else np.full(x.shape[:2], np.inf) for x in by_ring], axis=2) + 2 * 10.0**-PLACES
                bound = bound if np.isfinite(bound).any() else None
        for q in every if close.any() else ():
            own = np.where(close, (q_season - season) * period + slots[q] + margin, -1)
            rows = np.flatnonzero((own >= 0) & (own < vals.shape[1]))
            history = scaled[0].copy() if len(rows) else scaled[0]
            history[rows, own[rows]] = np.nan
            compare(history, every[q:q + 1], usable[q:q + 1] & close[None, :, None], reach)

        if sentinel is not None:
            dist[np.broadcast_to(inside, dist.shape) & np.isinf(dist[:1])] = MAX_DISTANCE
            value = np.where(lag == 0, OWN_SLOT, np.where(np.isnan(value), sentinel, value))
        dist = np.floor(dist * 10.0**PLACES + 0.5) / 10.0**PLACES
        by_d = dist.reshape(len(d) * len(slots), -1)
        rank = np.where(shifts < 0, -2 * shifts - 1, 2 * shifts)
        kept = []
        for ring, order in enumerate(rings):
            far = by_d[:, order]
            keep = np.isfinite(far)
            if far.shape[1] > k_max:
                last = np.partition(far, k_max - 1, axis=1)[:, k_max - 1:k_max]
                keep &= far <= last
                over = np.flatnonzero(keep.sum(axis=1) > k_max)
                # Ties at the end: the first in the order of shifts and seasons stay.
                ties, less = far[over] == last[over], far[over] < last[over]
                keep[over] = less | (ties & (ties.cumsum(axis=1) <= k_max - less.sum(axis=1, keepdims=True)))
            row, at = keep.nonzero()
            kept.append((row, far[row, at], order[at], np.full(len(at), ring)))
        row, far, at, ring = map(np.concatenate, zip(*kept))
        b, s = np.divmod(at, len(shifts))
        sort = np.lexsort((season[b], rank[s], far, row))
        for upto in range(len(rings)):
            own = sort[ring[sort] <= upto]
            n = np.bincount(row[own], minlength=len(by_d))
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            own, n = own[place < k_max], np.minimum(n, k_max)
            which_d, asked = np.divmod(np.flatnonzero(n), len(slots))
            yield ((np.full(len(asked), upto), q_idx[asked], np.array(d)[which_d], n[n > 0]),
                   (far[own], rank[s[own]], season[b[own]], value[row[own] % len(slots), b[own], s[own]]))

    def tile(asked, blocks):
        """The rows of one tile; ``asked`` holds query seasons, ``blocks`` history seasons."""
        import numpy as np
        import pyarrow as pa

        # One empty part gives the columns their types when nothing is found.
        lists = [[np.empty(0, t) for t in ("int32", "int64", "int32", "int64")]]
        found = [[np.empty(0, t) for t in ("float64", "int32", "int32", "float64")]]
        vs = sorted(v)
        if asked.num_rows and blocks.num_rows:
            ks, ds, width = k, sorted(d), shape.width
            if not ks:
                ks, ds, vs, width = ([[asked[name][0].as_py()] for name in OWN[:3]] + [asked[OWN[3]][0].as_py()])
            max_shift = vs[-1]
            vals, season = _matrix(blocks, "vals"), blocks["season"].to_numpy().astype("int64")
            q_all = _matrix(asked, "vals")
            n_slots = blocks["n_slots"][0].as_py()
            # Most candidates share ``d`` offsets this near; the others look further.
            joint = max(0.01, np.mean(~np.isnan(vals)) ** 2)
            reach = min(width, int(1.2 * ds[-1] / joint) + 6)
            # Candidates of each ring in the order that settles ties: rank of the shift, then season.
            shifts = np.arange(-max_shift, max_shift + 1)
            rank = np.where(shifts < 0, -2 * shifts - 1, 2 * shifts)
            rings = []
            for below, upto in zip([-1, *vs], vs):
                near = np.flatnonzero((np.abs(shifts) > below) & (np.abs(shifts) <= upto))
                b, s = (x.ravel() for x in np.meshgrid(np.arange(len(season)), near, indexing="ij"))
                rings.append((b * len(shifts) + s)[np.lexsort((season[b], rank[s]))])
            together = max(1, _DISTANCES // (len(vals) * len(shifts) * len(ds)))
            unit = _unit(vals, q_all)
            for at, slots, q_vals in zip(asked["season"].to_pylist(), asked["slots"].to_pylist(), q_all):
                for lo in range(0, len(slots), together):
                    for one, columns in neighbours(at, np.array(slots[lo:lo + together]), q_vals, vals, season, n_slots,
                                                   unit, reach, width, vs, max(ks), ds, rings):
                        lists.append(one)
                        found.append(columns)
        flat = lambda parts: [np.concatenate(c).astype(c[0].dtype) for c in zip(*parts)]
        (upto, q_idx, which_d, n), columns = flat(lists), flat(found)
        near = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["dist", "shift_rank", "season", "h_value"])
        ends = pa.array(np.append(0, n.cumsum()).astype(np.int32))
        series = asked["series_id"][0].as_py() if asked.num_rows else None
        own_v = np.array(vs, dtype=np.int32)[upto] if vs else upto
        return pa.RecordBatch.from_arrays(
            [pa.array([series] * len(n), pa.string()), pa.array(q_idx), pa.array(which_d), pa.array(own_v),
             pa.ListArray.from_arrays(ends, near)], names=["series_id", "q_idx", "d", "v", "near"])

    return _streamed(tile)


def _streamed(tile):
    """Cut the sorted rows of a task into tiles, history last, and hand them to ``tile`` one at a time."""
    def tiles(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, now = [], None

        def done():
            rows = pa.Table.from_batches(held)
            history = rows["history"].to_numpy(zero_copy_only=False).astype(bool)
            return tile(rows.filter(pa.array(~history)), rows.filter(pa.array(history)))

        for batch in batches:
            own = list(zip(*(batch[name].to_pylist() for name in ("series_id", "qc", "hc"))))
            cuts = [i for i in range(1, len(own)) if own[i] != own[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(own)]):
                if hi > lo:
                    if held and own[lo] != now:
                        yield done()
                        held = []
                    now = own[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return tiles


def _matrix(table, name):
    flat = table[name].combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def nearest_lists(queries: DataFrame, series: DataFrame, shape: Shape, k: list[int] | None = None,
                  d: list[int] | None = None, v: list[int] | None = None, sentinel: float | None = None) -> DataFrame:
    """``series_id, q_idx, d, v, near``: the nearest ``max(k)`` candidates of each tile, nearest first.

    Without ``k, d, v`` the queries bring their own in the columns ``OWN``, equal within a
    series; ``shape`` is then as wide as the widest of them. With a ``sentinel`` unusable
    candidates stay, as in :func:`tidegap.operators.neighbours.reference_distances`.
    """
    return dealt_tiles(queries, series, shape).mapInArrow(
        _tile_function(shape, k or [], d or [], v or [], sentinel), _SCHEMA)


def nearest_per_tile(queries: DataFrame, series: DataFrame, shape: Shape, k: list[int],
                     d: list[int], v: list[int], sentinel: float | None = None) -> DataFrame:
    """The candidates of :func:`nearest_lists` as rows: at most ``max(k)`` per query, ``d``, ``v`` and tile."""
    lists = nearest_lists(queries, series, shape, k, d, v, sentinel)
    return lists.select("series_id", "q_idx", "d", "v", F.inline("near"))


_L2_SCHEMA = "series_id string, q_idx bigint, h_idx bigint, shift int, shift_rank int, season int, h_value double, dist double"


def _l2_function(shape: Shape):
    """The function that gives each candidate of a tile its Euclidean distance.

    One row of squared differences for each pair of seasons and shift, summed along, serves
    the windows of all queries: each is the difference of two sums. Slots that are not
    joint add nothing.
    """
    period, margin, width, max_shift = shape.period, shape.margin, shape.width, shape.max_shift
    shifts = range(-max_shift, max_shift + 1)

    def tile(asked, blocks):
        import numpy as np
        import pyarrow as pa

        parts = [[np.empty(0, t) for t in ("int64", "int64", "int32", "int32", "int32", "float64", "float64")]]
        if asked.num_rows and blocks.num_rows:
            vals, q_all = _matrix(blocks, "vals"), _matrix(asked, "vals")
            season, n_slots = blocks["season"].to_numpy().astype("int64"), blocks["n_slots"][0].as_py()
            unit = _unit(vals, q_all, power=2)
            # Without whole numbers, sums that are wide enough to take differences of.
            history, wanted = (np.rint(x * unit) if unit else x.astype(np.longdouble) for x in (vals, q_all))
            for q_season, slots, query in zip(asked["season"].to_pylist(), asked["slots"].to_pylist(), wanted):
                slots = np.array(slots)
                q_idx = q_season * period + slots
                for shift in shifts:
                    # Slots of the query's block that have a counterpart, whatever the shift.
                    far = history[:, max_shift + shift:history.shape[1] - max_shift + shift]
                    gap = far - query[max_shift:len(query) - max_shift]
                    joint = ~np.isnan(gap)
                    gap[~joint] = 0
                    square = gap * gap
                    ends = slots + width  # the centre of each window
                    h_idx = season[:, None] * period + slots + shift
                    lag = h_idx - q_idx
                    value = vals[:, slots + margin + shift]
                    inside = (h_idx >= width) & (h_idx + width <= n_slots - 1) & (lag != 0) & ~np.isnan(value)
                    sums = np.zeros((len(gap), gap.shape[1] + 1), dtype=square.dtype)
                    found = np.zeros(sums.shape, dtype=np.int32)
                    np.cumsum(square, axis=1, out=sums[:, 1:])
                    np.cumsum(joint, axis=1, out=found[:, 1:])
                    total = sums[:, ends + width + 1] - sums[:, ends - width] - square[:, ends]
                    n = found[:, ends + width + 1] - found[:, ends - width] - joint[:, ends]
                    # Where the window meets the query's own slot, which counts as missing.
                    own = np.where((np.abs(lag) <= width) & (lag != 0), ends - lag, 0)
                    met = np.take_along_axis(joint, own, axis=1) & (np.abs(lag) <= width) & (lag != 0)
                    total = total - np.where(met, np.take_along_axis(square, own, axis=1), 0)
                    b, q = (inside & (n - met > 0)).nonzero()
                    dist = (np.sqrt(total[b, q].astype(np.float64)) / (unit or 1.0))
                    parts.append([q_idx[q], h_idx[b, q], np.full(len(b), shift), np.full(len(b), -2 * shift - 1 if shift < 0 else 2 * shift),
                                  season[b], value[b, q], dist])
        names = ["q_idx", "h_idx", "shift", "shift_rank", "season", "h_value", "dist"]
        columns = [np.concatenate(c).astype(c[0].dtype) for c in zip(*parts)]
        series = asked["series_id"][0].as_py() if asked.num_rows else None
        return pa.RecordBatch.from_arrays([pa.array([series] * len(columns[0]), pa.string()), *map(pa.array, columns)],
                                          names=["series_id", *names])

    return _streamed(tile)


def l2_tiles(queries: DataFrame, series: DataFrame, shape: Shape) -> DataFrame:
    """Plain Euclidean distance of every candidate that shares a slot with its query."""
    return dealt_tiles(queries, series, shape).mapInArrow(_l2_function(shape), _L2_SCHEMA)
