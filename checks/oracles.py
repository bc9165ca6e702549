"""Plain SQL for every registered query, built from shared common table expressions."""

from __future__ import annotations

HOUR, MINUTE5, DAY = 3_600_000_000, 300_000_000, 86_400_000_000
SEED = 2017


def counts(table: str, ts: str, step: int, series: str = "'all'") -> list[str]:
    return [f"""counts AS (
  SELECT {series} AS series_id, epoch_us({ts}) // {step} AS slot, CAST(count(*) AS DOUBLE) AS value
  FROM {table} WHERE {ts} IS NOT NULL GROUP BY 1, 2)"""]


def raw(period: int, source: str = "counts") -> list[str]:
    return [
        f"""bounds AS (
  SELECT series_id, min(slot) AS lo, max(slot) AS hi, min(slot) - min(slot) % {period} AS origin
  FROM {source} GROUP BY 1)""",
        "grid AS (SELECT series_id, origin, unnest(generate_series(lo, hi)) AS slot FROM bounds)",
        f"""raw AS (
  SELECT g.series_id, g.slot - g.origin AS idx, g.slot, c.value
  FROM grid g LEFT JOIN {source} c USING (series_id, slot))""",
    ]


def trimmed(period: int, name: str = "series") -> list[str]:
    return [
        f"""ends AS (
  SELECT series_id, CAST(ceil(min(idx) / {period}.0) * {period} AS BIGINT) AS start, max(idx) AS last
  FROM raw WHERE value IS NOT NULL GROUP BY 1)""",
        f"""{name} AS (
  SELECT r.series_id, r.idx - e.start AS idx, r.slot, r.value FROM raw r JOIN ends e USING (series_id)
  WHERE r.idx BETWEEN e.start AND e.last)""",
    ]


def masked(ratio: float, source: str, name: str = "series", series_id: str = "series_id") -> list[str]:
    return [
        f"""{name}_n AS (
  SELECT series_id, count(*) AS n, count(value) AS seen FROM {source} GROUP BY 1)""",
        f"""{name}_pick AS (
  SELECT s.series_id, s.idx,
         row_number() OVER (PARTITION BY s.series_id ORDER BY md5('{SEED}:' || s.series_id || ':' || s.idx), s.idx)
           <= floor({ratio}::DOUBLE * n) - (n - seen) AS picked
  FROM {source} s JOIN {name}_n USING (series_id) WHERE s.value IS NOT NULL)""",
        f"""{name} AS (
  SELECT {series_id} AS series_id, s.idx, s.slot,
         CASE WHEN p.picked THEN NULL ELSE s.value END AS value
  FROM {source} s LEFT JOIN {name}_pick p USING (series_id, idx))""",
    ]


def stats(period: int) -> list[str]:
    return [f"""stats AS (
  SELECT series_id, max(idx) + 1 AS n_slots, count(value) AS n_observed,
         (max(idx) + 1) // {period} AS n_seasons FROM series GROUP BY 1)"""]


def holdout(period: int) -> list[str]:
    return [
        f"""pool AS (
  SELECT s.series_id, s.idx, s.value, n_slots,
         row_number() OVER (PARTITION BY s.series_id ORDER BY md5('{SEED}:' || s.series_id || ':' || s.idx), s.idx) AS rn
  FROM series s JOIN stats t USING (series_id)
  WHERE s.value IS NOT NULL AND n_seasons >= 3
    AND s.idx BETWEEN {period} AND {period} * (n_seasons - 1) - 1)""",
        """queries AS (
  SELECT series_id, idx AS q_idx, value AS truth FROM pool WHERE rn <= floor(0.05::DOUBLE * n_slots))""",
    ]


MISSING_AS_QUERIES = ["""queries AS (
  SELECT series_id, idx AS q_idx, CAST(NULL AS DOUBLE) AS truth FROM series WHERE value IS NULL)"""]


def candidates(period: int, width: int, v: int) -> list[str]:
    return [
        """seasons AS (
  SELECT series_id, n_slots, unnest(generate_series(1, n_seasons - 2)) AS season FROM stats WHERE n_seasons >= 3)""",
        f"shifts AS (SELECT unnest(generate_series(-{v}, {v})) AS shift)",
        f"""cands AS (
  SELECT q.series_id, q.q_idx, q.truth, s.season * {period} + q.q_idx % {period} + f.shift AS h_idx,
         CAST(f.shift AS INTEGER) AS shift,
         CAST(CASE WHEN f.shift < 0 THEN -2 * f.shift - 1 ELSE 2 * f.shift END AS INTEGER) AS shift_rank,
         CAST(s.season AS INTEGER) AS season
  FROM queries q JOIN seasons s USING (series_id) CROSS JOIN shifts f
  WHERE s.season * {period} + q.q_idx % {period} + f.shift >= {width}
    AND s.season * {period} + q.q_idx % {period} + f.shift + {width} <= s.n_slots - 1)""",
        """pivots AS (
  SELECT c.*, CASE WHEN c.h_idx <> c.q_idx THEN h.value END AS h_value
  FROM cands c JOIN series h ON h.series_id = c.series_id AND h.idx = c.h_idx)""",
    ]


def offsets(width: int) -> list[str]:
    return [
        f"""sides AS (
  SELECT s.side, o.j FROM (SELECT unnest([-1, 1]) AS side) s,
         (SELECT unnest(generate_series(1, {width})) AS j) o)""",
        """joint AS (
  SELECT p.series_id, p.q_idx, p.h_idx, p.shift, p.shift_rank, p.season, p.h_value, o.side, o.j,
         abs(a.value - b.value) AS diff
  FROM pivots p CROSS JOIN sides o
  JOIN series a ON a.series_id = p.series_id AND a.idx = p.q_idx + o.side * o.j
  JOIN series b ON b.series_id = p.series_id AND b.idx = p.h_idx + o.side * o.j
  WHERE p.h_value IS NOT NULL AND a.value IS NOT NULL AND b.value IS NOT NULL
    AND p.h_idx + o.side * o.j <> p.q_idx)""",
    ]


def distances(width: int, d: list[int]) -> list[str]:
    return offsets(width) + [
        """near AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, q_idx, h_idx, shift, side ORDER BY j) AS rn FROM joint)""",
        f"ds AS (SELECT CAST(unnest({d}) AS INTEGER) AS d)",
        """per_side AS (
  SELECT series_id, q_idx, h_idx, shift, shift_rank, season, h_value, side, ds.d,
         max(j) + min(j) AS ends, count(*) AS n, sum(j) AS sj, sum(diff) AS sd, sum(j * diff) AS sjd
  FROM near JOIN ds ON near.rn <= ds.d GROUP BY ALL)""",
        """dist AS (
  SELECT series_id, q_idx, h_idx, shift, shift_rank, season, h_value, d,
         CAST(sum(ends * sd - sjd) AS DOUBLE) / CAST(sum(ends * n - sj) AS DOUBLE) AS dist
  FROM per_side GROUP BY ALL)""",
    ]


def reference_dist(d: list[int], sentinel: float) -> list[str]:
    return [f"""all_dist AS (
  SELECT p.series_id, p.q_idx, p.h_idx, p.shift, p.shift_rank, p.season, x.d,
         coalesce(t.dist, 999.0) AS dist,
         coalesce(p.h_value, CASE WHEN p.h_idx = p.q_idx THEN -2.0 ELSE {sentinel} END) AS h_value
  FROM pivots p CROSS JOIN ds x
  LEFT JOIN dist t ON t.series_id = p.series_id AND t.q_idx = p.q_idx AND t.h_idx = p.h_idx
    AND t.shift = p.shift AND t.d = x.d)"""]


def predictions(k: list[int], d: list[int], v: list[int], dist: str = "dist") -> list[str]:
    return [
        f"vs AS (SELECT CAST(unnest({v}) AS INTEGER) AS v)",
        f"ks AS (SELECT CAST(unnest({k}) AS INTEGER) AS k)",
        f"""ranked AS (
  SELECT series_id, q_idx, d, v, h_value,
         row_number() OVER (PARTITION BY series_id, q_idx, d, v ORDER BY round(dist, 9), shift_rank, season) AS rn
  FROM {dist} JOIN vs ON abs(shift) <= vs.v)""",
        f"""means AS (
  SELECT series_id, q_idx, k, d, v, avg(h_value) AS prediction
  FROM ranked JOIN ks ON ranked.rn <= ks.k GROUP BY ALL)""",
        f"""predictions AS (
  SELECT q.series_id, q.q_idx, q.truth, ks.k, x.d, vs.v, m.prediction
  FROM queries q CROSS JOIN ks CROSS JOIN (SELECT CAST(unnest({d}) AS INTEGER) AS d) x CROSS JOIN vs
  LEFT JOIN means m ON m.series_id = q.series_id AND m.q_idx = q.q_idx AND m.k = ks.k
    AND m.d = x.d AND m.v = vs.v)""",
        """results AS (
  SELECT series_id, q_idx AS train_index, k, d, v, prediction, prediction - truth AS err FROM predictions)""",
    ]


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


TYPE_HOUR = counts("events", "ts", HOUR, "event_type") + raw(24)
TYPE_SERIES = TYPE_HOUR + trimmed(24)
TYPE_QUERIES = TYPE_SERIES + stats(24) + holdout(24)
K, D, V, WIDTH = [2, 4, 8], [2, 4, 8], [0, 2, 4], 20
TYPE_CANDS = TYPE_QUERIES + candidates(24, WIDTH, max(V))
TYPE_RESULTS = TYPE_CANDS + distances(WIDTH, D) + predictions(K, D, V)
HOUR_RESULTS = (counts("events", "ts", HOUR) + raw(24) + trimmed(24) + stats(24) + holdout(24)
                + candidates(24, WIDTH, max(V)) + distances(WIDTH, D) + predictions(K, D, V))


def _impute(source: list[str], period: int, k: int, d: int, v: int) -> list[str]:
    width = d + period // 2
    return (source + stats(period) + MISSING_AS_QUERIES + candidates(period, width, v)
            + distances(width, [d]) + predictions([k], [d], [v]) + ["""filled AS (
  SELECT s.series_id, s.idx, s.slot, coalesce(s.value, p.prediction) AS value, p.prediction AS imputed,
         s.value IS NULL AND p.prediction IS NOT NULL AS is_imputed
  FROM series s LEFT JOIN predictions p ON p.series_id = s.series_id AND p.q_idx = s.idx)"""])


def _variants(ratios: list[float]) -> list[str]:
    """Masked copies of the daily order counts, one series per ratio."""
    out = counts("orders", "o_orderdate", DAY) + raw(7) + trimmed(7, "plain")
    names = []
    for i, ratio in enumerate(ratios):
        out += masked(ratio, "plain", f"m{i}", f"s.series_id || '@' || '{ratio}'")
        names.append(f"m{i}")
    return out + ["series AS (" + " UNION ALL ".join(
        f"SELECT series_id, idx, slot, value FROM {n}" for n in names) + ")"]


LI_MASKED = counts("lineitem", "l_shipdate", DAY) + raw(7) + trimmed(7, "plain")
RATIOS = [0.1, 0.5, 0.9]
ROBUST = ([2, 8], [2, 4], [0, 2])
ROBUST_SQL = (_variants(RATIOS) + stats(7) + holdout(7) + candidates(7, 7, 2)
              + distances(7, ROBUST[1]) + predictions(*ROBUST))
IMPUTE_TYPE = _impute(TYPE_SERIES, 24, 4, 4, 2)
DAY_GRID = (counts("orders", "o_orderdate", DAY) + raw(7) + trimmed(7) + stats(7) + holdout(7)
            + candidates(7, 7, 4) + distances(7, [4]))

SCORES = "SELECT k, d, v, round(sqrt(avg(err * err)), 6) AS rmse FROM results GROUP BY ALL"
BEST = """best AS (
  SELECT k, d, v, sqrt(avg(err * err)) AS rmse FROM results GROUP BY ALL
  ORDER BY rmse NULLS LAST, k, d, v LIMIT 1)"""
BEST_BY_SERIES = """best AS (
  SELECT * FROM (SELECT series_id, k, d, v, sqrt(avg(err * err)) AS rmse FROM results GROUP BY ALL)
  WHERE rmse IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, k, d, v) = 1)"""
DESCRIBE = ", ".join(
    f"""count({c}) AS {c}_count, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std,
  min({c}) AS {c}_min, max({c}) AS {c}_max, round(quantile_cont({c}, 0.25), 6) AS {c}_p25,
  round(quantile_cont({c}, 0.5), 6) AS {c}_p50, round(quantile_cont({c}, 0.75), 6) AS {c}_p75"""
    for c in ("train_index", "err"))
BEST_ROWS = """best_rows AS (
  SELECT r.series_id, r.train_index, r.err, p.truth AS ground_truth, r.prediction AS imputed_prediction
  FROM results r JOIN best b USING (k, d, v)
  JOIN queries p ON p.series_id = r.series_id AND p.q_idx = r.train_index)"""

ORACLES = {
    "series_build": sql(TYPE_HOUR, f"""
SELECT series_id, idx, slot * {HOUR // 1_000_000} AS epoch_sec, value FROM raw"""),
    "trim_series": sql(TYPE_SERIES, f"""
SELECT series_id, idx, slot * {HOUR // 1_000_000} AS epoch_sec, value FROM series"""),
    "missing_slots": sql(counts("events", "ts", MINUTE5) + raw(288) + trimmed(288), """
SELECT series_id, idx FROM series WHERE value IS NULL"""),
    "missing_ratio": sql(TYPE_SERIES, """
SELECT series_id, count(*) AS n_slots, count(*) - count(value) AS n_missing,
       round((count(*) - count(value)) / count(*), 9) AS missing_ratio,
       round(0.9 - (count(*) - count(value)) / count(*), 9) AS added_missing_ratio
FROM series GROUP BY 1"""),
    "season_stats": sql(TYPE_SERIES + stats(24), """
SELECT series_id, n_slots, n_observed, n_seasons, CAST((n_slots - 1) % 24 AS INTEGER) AS last_slot, CAST(24 AS BIGINT) AS train_min_idx,
       24 * (n_seasons - 1) - 1 AS train_max_idx FROM stats"""),
    "exp_ranges": sql(TYPE_SERIES + stats(24) + [
        "powers AS (SELECT unnest(generate_series(0, 40)) AS i)",
        """e AS (SELECT series_id, i, CAST(4 * pow(2, i) AS BIGINT) AS value, n_seasons // 2 AS stop
  FROM stats CROSS JOIN powers)"""], """
SELECT series_id, 'exclusive' AS kind, CAST(i AS INTEGER) AS position, value FROM e WHERE value < stop
UNION ALL
SELECT series_id, 'inclusive', CAST(i AS INTEGER), value FROM e WHERE value <= stop
UNION ALL
SELECT series_id, 'covering', CAST(i AS INTEGER), value FROM e WHERE i = 0 OR value / 2 < stop"""),
    "param_grid": sql(TYPE_SERIES + stats(24) + [
        "powers AS (SELECT CAST(4 * pow(2, unnest(generate_series(0, 40))) AS BIGINT) AS p)",
        "kk AS (SELECT series_id, p AS k FROM stats, powers WHERE p = 4 OR p / 2 < n_seasons // 2)",
        "dd AS (SELECT p AS d FROM powers WHERE p = 4 OR p / 2 < 24 // 4)",
        "vv AS (SELECT 0 AS v UNION ALL SELECT p FROM powers WHERE p = 4 OR p / 2 < sqrt(24))"], """
SELECT series_id, CAST(k AS INTEGER) AS k, CAST(d AS INTEGER) AS d, CAST(v AS INTEGER) AS v
FROM kk CROSS JOIN dd CROSS JOIN vv"""),
    "holdout_sample": sql(TYPE_QUERIES, "SELECT series_id, q_idx, truth FROM queries"),
    "mask_to_ratio": sql(LI_MASKED + masked(0.6, "plain"), """
SELECT series_id, idx, value FROM series"""),
    "knn_candidates": sql(TYPE_CANDS, """
SELECT series_id, q_idx, h_idx, shift, shift_rank, season, h_value FROM pivots"""),
    "gap_distance": sql(TYPE_CANDS + distances(WIDTH, D), """
SELECT series_id, q_idx, h_idx, shift, shift_rank, season, h_value, d, round(dist, 9) AS dist FROM dist"""),
    "l2_distance": sql(TYPE_CANDS + offsets(WIDTH), """
SELECT series_id, q_idx, h_idx, shift, shift_rank, season, h_value, round(sqrt(sum(diff * diff)), 9) AS dist
FROM joint GROUP BY ALL"""),
    "knn_predict": sql(TYPE_RESULTS, """
SELECT series_id, q_idx, k, d, v, round(prediction, 9) AS prediction FROM predictions"""),
    "knn_errors": sql(TYPE_RESULTS, """
SELECT series_id, train_index, k, d, v, round(prediction, 9) AS prediction, round(err, 9) AS err FROM results"""),
    "knn_grid": sql(DAY_GRID + predictions([4, 8, 16, 32, 64, 128, 256], [4], [0, 4]) + [
        "half AS (SELECT max(n_seasons) // 2 AS stop FROM stats)"], """
SELECT series_id, train_index, k, d, v, round(prediction, 9) AS prediction, round(err, 9) AS err
FROM results CROSS JOIN half WHERE k = 4 OR k / 2 < stop"""),
    "knn_predict_reference": sql(
        counts("orders", "o_orderdate", DAY) + raw(7) + trimmed(7, "plain") + masked(0.9, "plain")
        + stats(7) + holdout(7) + candidates(7, 5, 2) + distances(5, [2])
        + reference_dist([2], -1.0) + predictions([16, 256], [2], [0, 2], "all_dist"), """
SELECT series_id, q_idx, k, d, v, round(prediction, 9) AS prediction FROM predictions"""),
    "rmse_total": sql(TYPE_RESULTS, "SELECT round(sqrt(avg(err * err)), 6) AS rmse FROM results"),
    "rmse_by_k": sql(TYPE_RESULTS, """
SELECT k, round(sqrt(avg(err * err)), 6) AS rmse FROM results GROUP BY k"""),
    "rmse_by_d": sql(TYPE_RESULTS, """
SELECT d, round(sqrt(avg(err * err)), 6) AS rmse FROM results GROUP BY d"""),
    "rmse_by_v": sql(TYPE_RESULTS, """
SELECT v, round(sqrt(avg(err * err)), 6) AS rmse FROM results GROUP BY v"""),
    "rmse_by_kdv": sql(TYPE_RESULTS, SCORES),
    "mae_by_kdv": sql(TYPE_RESULTS, """
SELECT k, d, v, round(avg(abs(err)), 6) AS mae FROM results GROUP BY ALL"""),
    "rmse_grouping_sets": sql(TYPE_RESULTS, """
SELECT k, d, v, CAST(grouping(k, d, v) AS INTEGER) AS level, round(sqrt(avg(err * err)), 6) AS rmse
FROM results GROUP BY GROUPING SETS ((k), (d), (v), (k, d, v), ())"""),
    "describe_by_kdv": sql(TYPE_RESULTS, f"SELECT k, d, v, {DESCRIBE} FROM results GROUP BY k, d, v"),
    "best_params": sql(TYPE_RESULTS + [BEST], "SELECT k, d, v, round(rmse, 6) AS rmse FROM best"),
    "best_param_rows": sql(TYPE_RESULTS + [BEST, BEST_ROWS], """
SELECT series_id, train_index, round(err, 9) AS err, ground_truth,
       round(imputed_prediction, 9) AS imputed_prediction FROM best_rows"""),
    "results_union": None,
    "impute_series": sql(IMPUTE_TYPE, """
SELECT series_id, idx, round(value, 9) AS value, round(imputed, 9) AS imputed, is_imputed FROM filled"""),
    "write_back": sql(IMPUTE_TYPE, """
SELECT r.series_id, r.idx, round(coalesce(r.value, f.value), 9) AS value,
       coalesce(f.is_imputed, false) AS is_imputed
FROM raw r LEFT JOIN filled f USING (series_id, slot)"""),
    "remaining_missing": sql(IMPUTE_TYPE + ["""after_fill AS (
  SELECT r.series_id, r.value AS old, coalesce(r.value, f.value) AS new
  FROM raw r LEFT JOIN filled f USING (series_id, slot))"""], """
SELECT series_id, count(*) - count(old) AS missing_before, count(*) - count(new) AS missing_after
FROM after_fill GROUP BY 1"""),
    "rmse_by_missing_ratio": sql(ROBUST_SQL, """
SELECT CAST(split_part(series_id, '@', 2) AS DOUBLE) AS missing_ratio, k, d, v,
       round(sqrt(avg(err * err)), 6) AS rmse FROM results GROUP BY ALL"""),
    "csv_round_trip": sql(TYPE_SERIES, f"""
SELECT series_id, idx, slot * {HOUR // 1_000_000} AS epoch_sec, value FROM series"""),
    "csv_rejects": sql(TYPE_HOUR + [f"""cells AS (
  SELECT series_id, strftime(make_timestamp(slot * {HOUR}), '%Y-%m-%d %H:%M:%S') AS time, idx % 13 AS kind,
    CAST(CAST(coalesce(value, -1) AS DECIMAL(20, 1)) AS VARCHAR) AS n FROM raw)"""], """
SELECT CASE kind WHEN 3 THEN 'time' WHEN 4 THEN 'time' WHEN 5 THEN 'count' WHEN 7 THEN 'columns' WHEN 8 THEN 'columns'
         ELSE '' END AS reason,
  CASE kind WHEN 3 THEN series_id || ',yesterday,n/a' WHEN 4 THEN series_id || ',,' || n
    WHEN 5 THEN series_id || ',' || time || ',n/a' WHEN 6 THEN series_id || '|' || time || '|'
    WHEN 7 THEN series_id || ',' || time || ',' || n || ',more' WHEN 8 THEN series_id
    ELSE series_id || '|' || time || '|' || n END AS line
FROM cells"""),
    "variant_source": sql(LI_MASKED + masked(0.25, "plain"), """
SELECT series_id, idx, value FROM series"""),
    "results_tagged": sql(ROBUST_SQL, """
SELECT rpad(replace(split_part(series_id, '@', 2), '0.', ''), 2, '0') AS ratio_tag,
       CAST(split_part(series_id, '@', 2) AS DOUBLE) AS missing_ratio, 'gap' AS distance,
       count(*) AS n_rows, round(sqrt(avg(err * err)), 6) AS rmse
FROM results GROUP BY ALL"""),
    "table_hand_over": sql(IMPUTE_TYPE, """
SELECT series_id, idx, round(value, 9) AS value FROM filled"""),
    "score_table": sql(TYPE_RESULTS, """
SELECT k, d, v, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(abs(err)), 6) AS mae,
       count(err) AS n, count(*) - count(err) AS n_null
FROM results GROUP BY ALL"""),
    "knn_predict_fractional": sql(
        [f"""counts AS (
  SELECT 'all' AS series_id, epoch_us(ts) // {HOUR} AS slot,
    floor((sum(round(value * 100)::BIGINT) * 2 + count(value) * 10) / (count(value) * 20)) / 10 AS value
  FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"""] + raw(24) + trimmed(24) + stats(24) + holdout(24)
        + candidates(24, WIDTH, max(V)) + distances(WIDTH, D) + predictions(K, D, V), """
SELECT series_id, q_idx, k, d, v, round(prediction, 6) AS prediction FROM predictions"""),
    "best_params_masked": sql(
        counts("orders", "o_orderdate", DAY) + raw(7) + trimmed(7, "plain") + masked(0.97, "plain")
        + stats(7) + holdout(7) + candidates(7, 2, 2) + distances(2, [1, 2])
        + predictions([2, 8], [1, 2], [0, 2]) + [BEST], """
SELECT k, d, v, round(rmse, 6) AS rmse FROM best"""),
    "best_params_by_series": sql(TYPE_RESULTS + [BEST_BY_SERIES], """
SELECT series_id, k, d, v, round(rmse, 6) AS rmse FROM best"""),
}


def _union() -> str:
    def one(ctes: list[str]) -> str:
        return "(WITH " + ",\n".join(ctes) + """
SELECT series_id, train_index, k, d, v, round(prediction, 9) AS prediction, round(err, 9) AS err FROM results)"""

    return "SELECT * FROM " + one(TYPE_RESULTS) + " UNION ALL SELECT * FROM " + one(HOUR_RESULTS)


def _by_best() -> str:
    """Tune on a hold-out, then ask all gaps with the winner of each series."""
    tuned = (TYPE_HOUR + trimmed(24, "plain") + masked(0.3, "plain") + stats(24) + holdout(24)
             + candidates(24, 16, 4) + distances(16, [4]) + predictions([2, 8], [4], [0, 4]) + [BEST_BY_SERIES])
    asked = MISSING_AS_QUERIES + candidates(24, 16, 4) + distances(16, [4]) + predictions([2, 8], [4], [0, 4])
    given = ["series AS (SELECT * FROM tuned_series)", "best AS (SELECT * FROM tuned_best)"]
    inner = ["tuned_series AS (WITH " + ",\n".join(tuned) + "\nSELECT * FROM series)",
             "tuned_best AS (WITH " + ",\n".join(tuned) + "\nSELECT * FROM best)"]
    return sql(inner + given + stats(24) + asked, """
SELECT s.series_id, s.idx, round(coalesce(s.value, p.prediction), 6) AS value,
       s.value IS NULL AND p.prediction IS NOT NULL AS is_imputed
FROM series s LEFT JOIN best b USING (series_id)
LEFT JOIN predictions p ON p.series_id = s.series_id AND p.q_idx = s.idx AND p.k = b.k AND p.d = b.d AND p.v = b.v""")


def wide(width: int, d: list[int]) -> list[str]:
    """``dist`` for wide windows: one row per candidate, joint offsets as list slices.

    ``w`` holds for each slot the values of its window; a candidate's joint offsets on a
    side are those where neither is NULL, nearest first.
    """
    sides = []
    for side, at in (("l", f"{width} - j + 1"), ("r", f"{width} + j + 1")):
        own = "p.q_idx - p.h_idx" if side == "r" else "p.h_idx - p.q_idx"
        sides.append(f"""list_filter(range(1, {width + 1}), lambda j: a.w[{at}] IS NOT NULL
    AND b.w[{at}] IS NOT NULL AND j <> {own}) AS j{side}""")
    sums = []
    for side, at in (("l", f"{width} - j + 1"), ("r", f"{width} + j + 1")):
        sums += [f"list_transform(k{side}, lambda j: abs(qw[{at}] - hw[{at}])) AS x{side}"]
    part = lambda s: (f"coalesce(list_sum(list_transform(range(1, len(k{s}) + 1), "  # noqa: E731
                      f"lambda i: (k{s}[1] + k{s}[-1] - k{s}[i]) * x{s}[i])), 0)")
    weight = lambda s: f"coalesce(list_sum(list_transform(k{s}, lambda j: k{s}[1] + k{s}[-1] - j)), 0)"
    return [
        f"""places AS (
  SELECT series_id, idx, list(value) OVER (PARTITION BY series_id ORDER BY idx
    ROWS BETWEEN {width} PRECEDING AND {width} FOLLOWING) AS part,
    row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS before FROM series)""",
        f"""wins AS (
  SELECT series_id, idx, list_concat(list_transform(range(0, greatest({width} - before, 0)), lambda x: NULL::DOUBLE), part) AS w
  FROM places)""",
        f"""joints AS (
  SELECT p.*, a.w AS qw, b.w AS hw, {", ".join(sides)}
  FROM pivots p JOIN wins a ON a.series_id = p.series_id AND a.idx = p.q_idx
  JOIN wins b ON b.series_id = p.series_id AND b.idx = p.h_idx WHERE p.h_value IS NOT NULL)""",
        f"""kept AS (
  SELECT * EXCLUDE (jl, jr), jl[1:x.d] AS kl, jr[1:x.d] AS kr
  FROM joints CROSS JOIN (SELECT CAST(unnest({d}) AS INTEGER) AS d) x)""",
        f"summed AS (SELECT *, {', '.join(sums)} FROM kept)",
        f"""dist AS (
  SELECT series_id, q_idx, h_idx, shift, shift_rank, season, h_value, d,
    CAST({part("l")} + {part("r")} AS DOUBLE) / CAST({weight("l")} + {weight("r")} AS DOUBLE) AS dist
  FROM summed WHERE len(kl) + len(kr) > 0)""",
    ]


EV_5MIN = counts("events", "ts", MINUTE5) + raw(288)
ORACLES["impute_by_best"] = _by_best()
ORACLES["impute_5min"] = sql(
    EV_5MIN + trimmed(288, "plain") + masked(0.4, "plain") + stats(288) + MISSING_AS_QUERIES
    + candidates(288, 148, 8) + wide(148, [4]) + predictions([32], [4], [8]), """
SELECT s.series_id, s.idx, round(coalesce(s.value, p.prediction), 9) AS value, round(p.prediction, 9) AS imputed,
       s.value IS NULL AND p.prediction IS NOT NULL AS is_imputed
FROM series s LEFT JOIN predictions p ON p.series_id = s.series_id AND p.q_idx = s.idx""")
# Every offset of the 90 triples of the default grid: some tens of seconds at sf0.01.
ORACLES["grid_5min"] = sql(
    EV_5MIN + trimmed(288) + stats(288) + holdout(288) + candidates(288, 272, 32) + wide(272, [4, 8, 16, 32, 64, 128])
    + predictions([4, 8, 16], [4, 8, 16, 32, 64, 128], [0, 4, 8, 16, 32]), SCORES)
ORACLES["results_union"] = _union()
ORACLES["gap_distance_hof"] = ORACLES["gap_distance_joins"] = ORACLES["gap_distance"]
