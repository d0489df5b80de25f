"""DuckDB SQL of the registered queries, written from their definitions. Nothing is taken from the engine."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

H = 3_600_000_000
DAY_US = 24 * H


def _us(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


class _Failure(NamedTuple):
    failure_id: str
    start: int
    end: int
    maintenance: int | None


#: The known events of the sensor view, and the columns that are scored and filled.
FAILURES = (
    _Failure("F1", _us("2024-01-08 00:00"), _us("2024-01-08 23:59"), None),
    _Failure("F2", _us("2024-01-14 23:30"), _us("2024-01-15 06:00"), _us("2024-01-10 12:00")),
    _Failure("F3", _us("2024-01-19 10:00"), _us("2024-01-21 14:30"), _us("2024-01-22 16:00")),
    _Failure("F4", _us("2024-01-26 14:30"), _us("2024-01-26 19:00"), _us("2024-01-27 00:00")),
)
DEGRADED = ((_us("2024-01-08 00:00"), _us("2024-01-12 00:00")),)
INVALID = ((_us("2024-01-09 04:45"), _us("2024-01-10 01:30")),)
SCORED = (
    "duty", "frac_off", "frac_offloaded", "tp3_decay_slope", "cycles_per_hour", "oil_median", "oil_trend", "oil_std", "tp3_std",
    "duty_std", "cycle_dur_cv", "cycle_dur_trend", "longest_load_stretch", "antiphase_share", "oil_residual",
)
FILLED = (
    "duty", "frac_off", "frac_offloaded", "frac_loaded", "tp3_decay_slope", "oil_median", "oil_trend", "oil_std", "tp3_std",
    "duty_std", "cycle_dur_cv", "cycle_dur_trend", "frac_continuous_load", "antiphase_share", "oil_residual",
)
_FAULT = """CASE driver WHEN 'tp3_decay_slope' THEN 'air leak (pressure decaying during idle)'
 WHEN 'oil_median' THEN 'overwork heating (compensating for a leak)' WHEN 'oil_std' THEN 'unstable thermal behavior'
 WHEN 'oil_trend' THEN 'rising oil temperature' WHEN 'duty' THEN 'abnormal load (compressor overworking)'
 WHEN 'cycles_per_hour' THEN 'abnormal cycling rate' WHEN 'cycle_dur_cv' THEN 'erratic cycling (short-cycling)'
 WHEN 'longest_load_stretch' THEN 'sustained load without rest' WHEN 'antiphase_share' THEN 'valve/pressure signal anomaly'
 ELSE 'abnormal behavior' END"""
_PASSED = f"passed AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - {H} AS wm FROM events)"
_MANY = f"""many AS (SELECT CAST(key AS VARCHAR) AS failure_id, s, e, CASE WHEN k % 3 = 0 THEN e + {H} END AS m FROM (SELECT *, s + CASE WHEN key % 5000 = 0 THEN {6 * H} ELSE key * 7919 % 20000000 END AS e
 FROM (SELECT k, event_id * 30 + k AS key, epoch_us(ts) + k * 3000000 AS s FROM events, (SELECT unnest(range(30)) AS k))))"""
_W = "OVER (ORDER BY us, event_id)"


def _label(us: str) -> str:
    parts = [f"WHEN {us} BETWEEN {lo} AND {hi} THEN 'invalid'" for lo, hi in INVALID] + [f"WHEN {us} BETWEEN {lo} AND {hi} THEN 'degraded'" for lo, hi in DEGRADED]
    for f in FAILURES:
        a = f.end if f.maintenance is None else f.maintenance
        parts.append(f"WHEN {us} > {a} AND {us} <= {a + 24 * H} THEN 'postrepair'")
    parts += [f"WHEN {us} BETWEEN {f.start} AND {f.end} THEN 'infail'" for f in FAILURES] + [f"WHEN {us} >= {f.start - 48 * H} AND {us} < {f.start} THEN 'prefail'" for f in FAILURES]
    return f"CASE {' '.join(parts)} ELSE 'healthy' END"


_V = """v AS (SELECT 'S1' AS series_id, event_id, ts, epoch_us(ts) AS us, value AS a1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS a2,
 CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS dv,
 CASE WHEN event_type IN ('error', 'click', 'purchase') THEN 0 ELSE 1 END AS comp, event_type FROM events)"""
_L = f"""{_V}, l AS (SELECT *, lag(us) {_W} AS prev_us, us - lag(us) {_W} AS dus FROM v),
 med AS (SELECT quantile_cont(dus, 0.5) AS m FROM l)"""
_GAPS = f"{_L}, gaps AS (SELECT prev_us AS gap_start, us AS gap_end, dus / 60e6 AS gap_minutes FROM l, med WHERE dus > 6 * m)"
_SEG = f"""{_L}, rows_ AS (SELECT l.*, CAST(sum(CASE WHEN dus > 10 * m THEN 1 ELSE 0 END) {_W} AS BIGINT) AS seg FROM l, med),
 segs AS (SELECT seg, min(us) AS seg_start, max(us) AS seg_end, count(*) AS n FROM rows_ GROUP BY seg),
 grid AS (SELECT seg, CAST(w AS INTEGER) AS win, seg_start + w * {H} AS ws, seg_start + (w + 1) * {H} AS we
 FROM (SELECT *, unnest(range((seg_end - seg_start) // {H})) AS w FROM segs)),
 wr AS (SELECT r.*, CAST((r.us - s.seg_start) // {H} AS INTEGER) AS win, s.seg_start + ((r.us - s.seg_start) // {H}) * {H} AS ws, {_label('r.us')} AS lab
  FROM rows_ r JOIN segs s USING (seg) WHERE s.seg_start + ((r.us - s.seg_start) // {H} + 1) * {H} <= s.seg_end)"""
_K = "PARTITION BY seg, win ORDER BY us, event_id"
_CYC = """, {p}up AS (SELECT {k}, us, event_id FROM (SELECT *, dv - lag(dv) OVER (PARTITION BY {k} ORDER BY us, event_id) AS e
 FROM {src}) WHERE e = 1),
 {p}dur AS (SELECT {k}, (us - lag(us) OVER (PARTITION BY {k}
 ORDER BY us, event_id)) / 1e6 AS dur, row_number() OVER (PARTITION BY {k} ORDER BY us, event_id) - 2 AS idx FROM {p}up),
 {p}cyc AS (SELECT {k}, count(*) AS rising_edges, CASE WHEN count(dur) >= 3 THEN stddev_samp(dur) / avg(dur) END AS cv,
 CASE WHEN count(dur) >= 3 THEN regr_slope(dur, idx) END AS tr FROM {p}dur GROUP BY ALL)"""
_FEAT = f"""{_SEG},
 simple AS (SELECT seg, win, count(*) AS n_samples, sum(dv) AS cycles_per_hour, avg(dv) AS duty, avg(CASE WHEN a2 < 20 THEN 1 ELSE 0 END) AS frac_off,
  avg(CASE WHEN a2 >= 20 AND a2 < 60 THEN 1 ELSE 0 END) AS frac_offloaded, avg(CASE WHEN a2 >= 60 THEN 1 ELSE 0 END) AS frac_loaded, quantile_cont(a1, 0.5) AS oil_median,
  CASE WHEN count(a1) >= 10 THEN regr_slope(a1, (us - ws) / 1e6) END AS oil_trend,
 CASE WHEN count(*) > 1 THEN stddev_samp(a1) END AS oil_std, CASE WHEN count(*) > 1 THEN stddev_samp(a2) END AS tp3_std,
 CASE WHEN count(*) > 1 THEN stddev_samp(dv) END AS duty_std,
  avg(CASE WHEN comp + dv = 1 THEN 1 ELSE 0 END) AS antiphase_share, coalesce(var_samp(a2) < 1e-6, false) AS frozen, max(CASE WHEN lab = 'invalid' THEN 1 ELSE 0 END) AS bad
 FROM wr GROUP BY seg, win),
 lm AS (SELECT seg, win, lab FROM (SELECT seg, win, lab, row_number() OVER (PARTITION BY seg, win
 ORDER BY count(*) DESC, lab) AS k FROM wr GROUP BY seg, win, lab) WHERE k = 1),
 ir AS (SELECT *, sum(nw) OVER ({_K}) AS run FROM (SELECT *, CASE WHEN comp = lag(comp) OVER ({_K}) THEN 0 ELSE 1 END AS nw FROM wr)),
 dec AS (SELECT seg, win, quantile_cont(slope, 0.5) AS tp3_decay_slope
 FROM (SELECT seg, win, run, regr_slope(a2, (us - ws) / 1e6) AS slope FROM ir WHERE comp = 1 GROUP BY seg, win, run
 HAVING count(*) >= 5) GROUP BY seg, win),
 lr AS (SELECT *, sum(nw) OVER ({_K}) AS run FROM (SELECT *, CASE WHEN dv = lag(dv) OVER ({_K}) THEN 0 ELSE 1 END AS nw FROM wr)),
 str_ AS (SELECT seg, win, max(c) * 10.0 / 60 AS longest FROM (SELECT seg, win, run, count(*) AS c FROM lr WHERE dv = 1
 GROUP BY seg, win, run) GROUP BY seg, win)
 {_CYC.format(p='c_', k='seg, win', src='wr')},
 f0 AS (SELECT g.seg, g.win, g.ws, g.we, coalesce(n_samples, 0) AS n_samples, CAST(coalesce(cycles_per_hour, 0) AS BIGINT) AS cycles_per_hour, duty, frac_off, frac_offloaded, frac_loaded, duty AS frac_continuous_load, oil_median, oil_trend, oil_std, tp3_std, duty_std, antiphase_share,
  coalesce(frozen, false) AS motor_frozen, coalesce(frozen, false) AS tp3_frozen,
 CASE WHEN s.n_samples IS NULL THEN 'empty' WHEN bad = 1 THEN 'invalid' ELSE lab END AS label,
  tp3_decay_slope, coalesce(rising_edges, 0) AS rising_edges, cv AS cycle_dur_cv, tr AS cycle_dur_trend, CAST(coalesce(longest, 0) AS DOUBLE) AS longest_load_stretch
  FROM grid g LEFT JOIN simple s USING (seg, win) LEFT JOIN lm USING (seg, win) LEFT JOIN dec USING (seg, win) LEFT
 JOIN c_cyc USING (seg, win) LEFT JOIN str_ USING (seg, win)),
 used AS (SELECT duty, oil_median, avg(duty) OVER () AS mx FROM f0 WHERE label = 'healthy' AND duty IS NOT NULL AND oil_median IS NOT NULL),
 s AS (SELECT count(*) AS n, sum(d) AS s1, sum(d*d) AS s2, sum(d*d*d) AS s3, sum(d*d*d*d) AS s4, sum(o) AS t0, sum(d*o) AS t1, sum(d*d*o) AS t2, max(mx) AS mx
 FROM (SELECT duty - mx AS d, oil_median AS o, mx FROM used)),
 q AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s),
 fit AS (SELECT (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / nullif(det, 0) AS b0, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / nullif(det, 0) AS b1,
  (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / nullif(det, 0) AS b2, mx FROM q),
 f AS (SELECT f0.*, oil_median - (b0 + b1*(duty-mx) + b2*(duty-mx)*(duty-mx)) AS oil_residual,
  CASE WHEN duty > 0.8 OR cycles_per_hour < 3 THEN 'locked' WHEN duty < 0.05 THEN 'idle' ELSE 'cycling' END AS cycling_regime
 FROM f0, fit)"""
_PREP = f"""{_FEAT}, md AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in FILLED)} FROM f WHERE label = 'healthy'),
 p AS (SELECT seg, win, ws, we, n_samples, cycles_per_hour, rising_edges, longest_load_stretch, motor_frozen, tp3_frozen, label, cycling_regime, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FILLED)}, {', '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing' for c in FILLED)}
 FROM f, md)"""


def _split(src: str) -> str:
    return f"""sp AS (SELECT *, label = 'healthy' AND rk < floor(nh * CAST(0.6 AS DOUBLE)) AS is_train, label = 'healthy' AND NOT rk < floor(nh * CAST(0.6 AS DOUBLE)) AS is_val, label IN ('prefail', 'infail') AS is_eval_fail, label = 'degraded' AS is_eval_degr
 FROM (SELECT *, row_number() OVER (PARTITION BY label = 'healthy'
 ORDER BY ws, seg, win) - 1 AS rk, count(*) OVER (PARTITION BY label = 'healthy') AS nh FROM {src}))"""


_PLAIN = tuple(c for c in SCORED if not c.startswith("cycle"))
_SCORE = f"""{_PREP}, {_split('p')},
 sc AS (SELECT {', '.join(f'avg({c}) AS mu_{c}, CASE WHEN stddev_samp({c}) = 0 THEN 1.0 ELSE coalesce(stddev_samp({c}), 1.0) END AS sd_{c}' for c in SCORED)}
 FROM sp WHERE is_train),
 z AS (SELECT sp.*, {', '.join(f'({c} - mu_{c}) / sd_{c} AS z_{c}' for c in SCORED)} FROM sp, sc),
 zm AS (SELECT *, greatest({', '.join(f'abs(z_{c})' for c in SCORED)}) AS zmax, greatest({', '.join(f'abs(z_{c})' for c in _PLAIN)}) AS zmax_plain
 FROM z),
 thr AS (SELECT quantile_cont(zmax, CAST(0.99 AS DOUBLE)) AS thr FROM zm WHERE is_val),
 scored AS (SELECT zm.*, thr, zmax > thr AS alert, motor_frozen OR tp3_frozen AS quality_bad,
 CASE {' '.join(f"WHEN abs(z_{c}) = zmax THEN '{c}'" for c in SCORED)} END AS driver FROM zm, thr)"""
_TARGETS = [(f.failure_id, f.start - 48 * H, f.end, f.start) for f in FAILURES]


def _long(models: tuple[str, ...] = ("zmax",)) -> str:
    parts = []
    for m in models:
        for n, lo, hi, st in _TARGETS:
            parts.append(f"SELECT '{m}' AS model, '{n}' AS target, {m} AS score, 1 AS y, ws, {st} AS start FROM scored WHERE ws BETWEEN {lo} AND {hi}")
            parts.append(f"SELECT '{m}', '{n}', {m}, 0, ws, {st} FROM scored WHERE is_val")
        parts.append(f"SELECT '{m}', 'degraded', {m}, 1, ws, NULL FROM scored WHERE is_eval_degr")
        parts.append(f"SELECT '{m}', 'degraded', {m}, 0, ws, NULL FROM scored WHERE is_val")
    return f"{_SCORE}, long AS ({' UNION ALL '.join(parts)}), bs AS (SELECT model, target, round(score, 9) AS score, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY ALL)"


_ROC = """,
 roc AS (SELECT model, target, sum(pos * (under + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM
 (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, target
 ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM bs) GROUP BY model, target)"""
_AP = """, ap AS (SELECT model, target, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS pr_auc FROM
 (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp FROM bs
 WINDOW w AS (PARTITION BY model, target ORDER BY score DESC)) GROUP BY model, target)"""
_STATUS = f"""{_SCORE}, st0 AS (SELECT *, CASE WHEN zmax >= thr * 0.8::DOUBLE THEN 1 ELSE 0 END AS high, thr * 0.6::DOUBLE AS tw
 FROM scored),
 st AS (SELECT *,
 CASE WHEN quality_bad THEN 'untrusted' WHEN min(high) OVER w3 = 1 AND count(*) OVER w3 = 3 THEN 'critical' WHEN high = 1 THEN 'alert' WHEN zmax >= tw THEN 'watch' ELSE 'healthy' END AS status
 FROM st0 WINDOW w3 AS (ORDER BY ws, seg, win ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 sv AS (SELECT *, row_number() OVER (ORDER BY ws, seg, win) - 1 AS idx,
 CASE status WHEN 'watch' THEN 1 WHEN 'alert' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END AS sev FROM st),
 al AS (SELECT idx, ws, status AS level, driver FROM (SELECT *, lag(sev, 1, 0) OVER (ORDER BY idx) AS sb FROM sv) WHERE sev > sb)"""


def _even(x: str, n: int) -> str:
    return f"round_even({x}, {n})"


def _nearest(at: str) -> str:
    ev = []
    for k, col in enumerate(("start", "end", "maintenance")):
        kind = ("failure_start", "failure_end", "maintenance")[k]
        ev += [f"({getattr(f, col)}, {k}, '{f.failure_id}', '{f.failure_id}-{kind}')" for f in FAILURES if getattr(f, col) is not None]
    return f"(SELECT arg_min({{'n': name, 'd': abs(t - {at})}}, (abs(t - {at}), k, fid)) FROM (VALUES {', '.join(ev)}) e(t, k, fid, name))"


def _spans(rows: str, hours: int, healthy_wins: bool, at: str, label: str) -> str:
    case = lambda s: f"CASE WHEN {label} = 'healthy' THEN 'healthy' WHEN {at} >= {s - hours * H} AND {at} < {s} THEN 'prefail' END" if healthy_wins else f"CASE WHEN {at} >= {s - hours * H} AND {at} < {s} THEN 'prefail' WHEN {label} = 'healthy' THEN 'healthy' END"
    return " UNION ALL ".join(f"SELECT '{f.failure_id}' AS failure, {case(f.start)} AS g, * FROM {rows}" for f in FAILURES)


def _effects(src: str, features: list[str], digital: list[str], other: str, extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    long = " UNION ALL ".join(f"SELECT {e}g, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {src}" for c in features)
    binary = f"feature IN ({', '.join(repr(x) for x in digital)})" if digital else "false"
    return f"""SELECT {e}feature,
 CASE WHEN {binary} THEN round_even(mg - mr, 3) WHEN q3 - q1 <> 0 THEN round_even((qg - q2) / (q3 - q1), 2) END AS effect,
 CASE WHEN {binary} AND mr <> 0 THEN round_even(mg / mr, 2) END AS ratio FROM
 (SELECT {e}feature, avg(x) FILTER (g = 'healthy') AS mr, avg(x) FILTER (g = '{other}') AS mg, quantile_cont(x, 0.25) FILTER (g = 'healthy') AS q1, quantile_cont(x, 0.5) FILTER (g = 'healthy') AS q2, quantile_cont(x, 0.75) FILTER (g = 'healthy') AS q3, quantile_cont(x, 0.5) FILTER (g = '{other}') AS qg
 FROM ({long}) GROUP BY {e}feature)"""


_R = lambda c, n=6: f"round({c}, {n}) AS {c}"
_LAB = f"{_V}, lb AS (SELECT *, {_label('us')} AS label FROM v)"
_INSIDE = " OR ".join(f"us BETWEEN {f.start} AND {f.end}" for f in FAILURES)
_MODAL = """modal AS (SELECT dus AS modal_us, n / CAST((SELECT count(dus) FROM l) AS DOUBLE) AS modal_share
 FROM (SELECT dus, count(*) AS n FROM l WHERE dus IS NOT NULL GROUP BY dus) ORDER BY n DESC, dus LIMIT 1)"""
_F6 = "SELECT seg, win, "
_R4 = lambda c: _R(c, 4)


def _pairs(columns: list[str], src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {src}" for i, a in enumerate(columns) for b in columns[i:])


ORACLES: dict[str, str] = {
    "p2_range_scan": f"""WITH {_V} SELECT event_id, us, a1, a2, dv, comp FROM v
 WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-09'""",
    "p3_closed_range": f"WITH {_V} SELECT event_id, us, a1 FROM v WHERE us BETWEEN {FAILURES[2].start} AND {FAILURES[2].end}",
    "p11_around_peak": f"""WITH {_V}, n AS (SELECT *, row_number() {_W} AS rn FROM v), k AS (SELECT rn AS p FROM n
 ORDER BY a1 DESC, us LIMIT 1) SELECT event_id, us, a1 FROM n, k WHERE rn BETWEEN p - 3 AND p + 3""",
    "p12_distinct_states": f"WITH {_V} SELECT DISTINCT event_type, dv, comp FROM v",
    "a1_profile": f"""WITH {_L}, {_MODAL}
 SELECT n_rows, first_us, last_us, n_types, modal_us, round(modal_share, 6) AS modal_share
 FROM (SELECT count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, count(DISTINCT event_type) AS n_types FROM v), modal""",
    "a2_interval_histogram": f"WITH {_L} SELECT dus // 60000000 AS dus, count(*) AS n FROM l WHERE dus IS NOT NULL GROUP BY 1",
    "a4_describe": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM v" for c in ("a1", "a2")),
    "a5_null_counts": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM v" for c in ("a1", "a2", "dv", "comp")),
    "a6_digital_summary": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, count(*) FILTER ({c} = 0) AS n_zeros, count(*) FILTER ({c} = 1) AS n_ones, count(*) FILTER ({c} NOT IN (0, 1)) AS n_other, round_even(avg(CASE WHEN {c} = 1 THEN 1 ELSE 0 END), 4) AS frac_active FROM v" for c in ("dv", "comp")),
    "a7_duty_and_antiphase": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{f.failure_id}' AS span, count(*) AS n, round(avg(dv), 6) AS duty, round(avg(CASE WHEN dv + comp = 1 THEN 1 ELSE 0 END), 6) AS antiphase, round(avg(a2) FILTER (dv = 1), 6) AS motor_loaded FROM v WHERE us >= {f.start - 2 * DAY_US} AND us < {f.end} HAVING count(*) > 0" for f in FAILURES),
    "a9_toggles": f"""WITH {_V}, t AS (SELECT *, lag(dv) {_W} AS pv FROM v
 WHERE us >= {FAILURES[0].start} AND us < {FAILURES[0].start + 7 * DAY_US})
 SELECT round(sum(CASE WHEN pv = dv THEN 0 ELSE 1 END) / ((max(us) - min(us)) / {H}.0::DOUBLE), 6) AS toggles_per_hour FROM t""",
    "a10_label_stats": f"""WITH {_LAB}
 SELECT label, round(quantile_cont(a1, 0.5), 6) AS a1_median, round(quantile_cont(a2, 0.5), 6) AS a2_median, round(avg(dv), 6) AS duty, count(*) AS n
 FROM lb GROUP BY label""",
    "a11_duty_by_hour": f"WITH {_V} SELECT CAST(hour(ts) AS INTEGER) AS hour, round(avg(dv), 6) AS duty, count(*) AS n FROM v GROUP BY 1",
    "a11_duty_by_weekday": f"""WITH {_V}, w AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, avg(dv) AS duty FROM v GROUP BY 1)
 SELECT dow, round(duty, 6) AS duty, round(max(duty) OVER () - min(duty) OVER (), 6) AS spread FROM w""",
    "a16_window_labels": f"WITH {_FEAT} SELECT seg, win, ws, label, n_samples AS n FROM f0",
    "a17_run_summary": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, count(*) AS n_runs, round_even(quantile_cont(m, 0.5), 2) AS median_min, round_even(quantile_cont(m, 0.9), 2) AS p90_min, round_even(max(m), 1) AS max_min, round_even(sum(m), 1) AS total_min, count(*) FILTER (m > 60) AS n_runs_over_1h FROM (SELECT count(*) * 10 / 60.0::DOUBLE AS m FROM (SELECT {c}, sum(nw) {_W} AS run FROM (SELECT *, CASE WHEN {c} = lag({c}) {_W} THEN 0 ELSE 1 END AS nw FROM v)) GROUP BY run HAVING min({c}) = 0)" for c in ("dv", "comp")),
    "a18_episode_stats": f"""WITH {_V}
 SELECT ({_INSIDE}) AS inside, count(*) AS n, round_even(avg(dv), 3) AS duty, round_even(avg(a2), 3) AS motor_mean, round_even(avg(CASE WHEN a2 < 20 THEN 1 ELSE 0 END), 3) AS share_low
 FROM v GROUP BY 1""",
    "a19_gap_context": f"""WITH {_GAPS},
 g AS (SELECT *, ({' OR '.join(f'(gap_end >= {f.start - 3 * DAY_US} AND gap_start <= {f.end + 3 * DAY_US})' for f in FAILURES)}) AS near
 FROM gaps)
 SELECT count(*) FILTER (near) AS n_near, count(*) FILTER (NOT near) AS n_far, round_even(quantile_cont(gap_minutes, 0.5) FILTER (near), 1) AS median_near_min, round_even(quantile_cont(gap_minutes, 0.5) FILTER (NOT near), 1) AS median_far_min, round_even(max(gap_minutes) FILTER (near), 1) AS max_near_min, (SELECT round_even(avg(CASE WHEN near THEN 1 ELSE 0 END), 2)
 FROM (SELECT near FROM g ORDER BY gap_minutes DESC, gap_start LIMIT 20)) AS share_of_top20_near FROM g""",
    "a20_effect_sizes": f"""WITH {_LAB}, e AS (SELECT *, label AS g
 FROM lb) {_effects('e', ['a1', 'a2', 'dv', 'comp'], ['dv', 'comp'], 'prefail')}""",
    "a21_effect_by_failure": f"""WITH {_LAB}, e AS ({_spans('lb', 168, True, 'us', 'label')}) {_effects('e', ['a1', 'a2', 'dv', 'comp'], ['dv', 'comp'], 'prefail', 'failure')}""",
    "a22_feature_effects": f"""WITH {_FEAT}, e AS ({_spans('f', 48, False, 'ws', 'label')}) {_effects('e', ['duty', 'oil_median', 'oil_std', 'antiphase_share'], [], 'prefail', 'failure')}""",
    "a24_base_rates": f"""WITH {_GAPS}, g AS (SELECT round_even({_nearest('gap_start')}.d / {DAY_US}.0::DOUBLE, 1) AS days_away
 FROM gaps)
 SELECT round(avg(CASE WHEN days_away <= 3 THEN 1 ELSE 0 END), 6) AS share_within_3d, round(quantile_cont(days_away, 0.5), 6) AS median_days, round(least(1.0::DOUBLE, {6.0 * (3 * len(FAILURES) - 1)} / (SELECT (max(us) - min(us)) / {DAY_US}.0::DOUBLE
 FROM v)), 6) AS chance FROM g""",
    "a25_pearson": f"WITH {_V} {_pairs(['a1', 'a2', 'dv', 'comp'], 'v')}",
    "a26_spearman": f"""WITH {_V},
 k AS (SELECT rank() OVER (ORDER BY a1) + (count(*) OVER (PARTITION BY a1) - 1) / 2.0::DOUBLE AS a1, rank() OVER (ORDER BY a2) + (count(*) OVER (PARTITION BY a2) - 1) / 2.0::DOUBLE AS a2
 FROM v) {_pairs(['a1', 'a2'], 'k')}""",
    "a27_histogram": f"""WITH {_V}, m AS (SELECT min(a1) AS lo, max(a1) AS hi FROM v)
 SELECT CAST(least(floor((a1 - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM v, m GROUP BY 1""",
    "a28_box_stats": f"""WITH {_V},
 q AS (SELECT quantile_cont(a1, 0.25) AS q1, quantile_cont(a1, 0.5) AS median, quantile_cont(a1, 0.75) AS q3 FROM v)
 SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(a1) FILTER (a1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_lo, round(max(a1) FILTER (a1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi, count(*) FILTER (NOT a1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
 FROM v, q GROUP BY q1, median, q3""",
    "a29_distinct_counts": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM v" for c in ("a1", "a2", "dv", "comp")),
    "a30_pivot": f"""WITH {_long()}{_ROC}
 SELECT 'zmax' AS model, {', '.join(f'round(max(roc_auc) FILTER (target = {t!r}), 6) AS {t}' for t in ('F1', 'F2', 'F3', 'F4', 'degraded'))}
 FROM roc""",
    "a31_label_counts": f"WITH {_LAB} SELECT label, count(*) AS n FROM lb GROUP BY label",
    "a32_no_cycle_windows": f"""WITH {_FEAT}
 SELECT count(*) FILTER (duty < 0.05 AND cycles_per_hour < 3) AS idle, count(*) FILTER (duty > 0.8 AND cycles_per_hour < 3) AS locked, count(*) FILTER (cycles_per_hour >= 3) AS cyclable, count(*) FILTER (n_samples < 5) AS thin
 FROM f""",
    "a34_health_by_label": f"""WITH {_FEAT}
 SELECT label, round(avg(antiphase_share), 6) AS antiphase, round(avg(CASE WHEN motor_frozen THEN 1 ELSE 0 END), 6) AS motor_frozen, count(*) AS n
 FROM f GROUP BY label""",
    "a35_missing_rates": f"WITH {_PREP} " + " UNION ALL ".join(f"SELECT '{c}_missing' AS \"column\", round(avg({c}_missing), 6) AS rate FROM p" for c in ("tp3_decay_slope", "oil_trend", "cycle_dur_cv", "duty")),
    "a36_hourly_probe": f"""WITH {_V}
 SELECT us // {H} * {H} AS hour_us, round(CASE WHEN count(*) > 1 THEN var_samp(a2) END, 6) AS motor_var, round(avg(CASE WHEN dv + comp = 1 THEN 1 ELSE 0 END), 6) AS antiphase
 FROM v GROUP BY 1""",
    "a39_score_summary": f"""WITH {_SCORE}
 SELECT {', '.join(f'round(avg(zmax) FILTER ({c}), 6) AS mean_{c}' for c in ('is_train', 'is_val', 'is_eval_fail', 'is_eval_degr'))}, round(quantile_cont(zmax, 0.5), 6) AS median_all
 FROM scored""",
    "a40_antiphase_sums": f"WITH {_V} SELECT dv + comp AS total, count(*) AS n FROM v GROUP BY 1",
    "a41_label_month_rollup": f"""WITH {_LAB} SELECT label, month, count(*) AS n, round(avg(a1), 6) AS a1_mean
 FROM (SELECT label, CAST(month(ts) AS INTEGER) AS month, a1 FROM lb) GROUP BY ROLLUP (label, month)""",
    "q7_checks": f"""WITH {_L}, {_MODAL}, bs AS (SELECT count(*) FILTER (us <= p) AS n
 FROM (SELECT us, lag(us) OVER (ORDER BY event_id) AS p FROM v)),
 rg AS (SELECT count(*) FILTER (a1 < 0 OR a1 > 90) + count(*) FILTER (a2 < 0 OR a2 > 100) AS n FROM v)
 SELECT 'timestamps_increasing' AS "check", n = 0 AS passed, CAST(n AS DOUBLE) AS detail FROM bs UNION ALL
 SELECT 'modal_interval', modal_us = 10000000, round(modal_us / 1e6, 6) FROM modal 
 UNION ALL SELECT 'digitals_binary', n = 0, CAST(n AS DOUBLE)
 FROM (SELECT count(*) FILTER (dv NOT IN (0, 1)) + count(*) FILTER (comp NOT IN (0, 1)) AS n FROM v)
 UNION ALL SELECT 'twin_sensors', avg(d) < 0.01 AND max(d) < 0.5, round(avg(d), 6) FROM (SELECT abs(comp - (1 - dv)) AS d FROM v)
 UNION ALL SELECT 'valve_antiphase', abs(avg(comp + dv) - 1) < 0.02, round(avg(comp + dv), 6) FROM v UNION ALL
 SELECT 'analog_ranges', n = 0, CAST(n AS DOUBLE) FROM rg""",
    "w1_lag": f"WITH {_L} SELECT event_id, us, prev_us, dus FROM l",
    "w2_gap_inventory": f"WITH {_GAPS} SELECT gap_start, gap_end, round(gap_minutes, 6) AS gap_minutes FROM gaps",
    "w3_segments": f"WITH {_SEG} SELECT seg, seg_start, seg_end, n FROM segs",
    "w4_window_grid": f"WITH {_SEG} SELECT seg, win, ws, we FROM grid",
    "w5_runs": f"""WITH {_V} SELECT state, n, count(*) AS n_runs FROM (SELECT min(dv) AS state, count(*) AS n
 FROM (SELECT dv, sum(nw) {_W} AS run FROM (SELECT *, CASE WHEN dv = lag(dv) {_W} THEN 0 ELSE 1 END AS nw FROM v)) GROUP BY run)
 GROUP BY ALL""",
    "e4_run_episodes": f"""WITH {_V} SELECT min(us) AS episode_start, max(us) AS episode_end, count(*) AS n
 FROM (SELECT *, sum(nw) {_W} AS run FROM (SELECT *, CASE WHEN dv = lag(dv) {_W} THEN 0 ELSE 1 END AS nw FROM v)) GROUP BY run
 HAVING min(dv) = 0 AND max(us) - min(us) >= {H // 4}""",
    "j1_asof": f"""WITH {_SEG}, g AS (SELECT *, ws + 90000000 AS at FROM grid) SELECT g.seg, g.win, g.at, v.a1, v.us AS right_us
 FROM g ASOF LEFT JOIN v ON g.at >= v.us""",
    "j2_gaps_near_failures": f"WITH {_GAPS} " + " UNION ALL ".join(f"SELECT '{f.failure_id}' AS failure_id, gap_start, gap_end, round_even(gap_minutes, 1) AS gap_minutes, round_even((gap_start - {f.end}) / {H}.0::DOUBLE, 1) AS start_vs_window_end_h, {f'round_even((gap_end - {f.maintenance}) / {H}.0::DOUBLE, 1)' if f.maintenance else 'CAST(NULL AS DOUBLE)'} AS end_vs_maint_h FROM gaps WHERE gap_end >= {f.start - 3 * DAY_US} AND gap_start <= {f.end + 3 * DAY_US}" for f in FAILURES),
    "j3_gaps_nearest_event": f"""WITH {_GAPS}, t AS (SELECT * FROM gaps ORDER BY gap_minutes DESC, gap_start LIMIT 15),
 n AS (SELECT *, {_nearest('gap_start')} AS e FROM t)
 SELECT gap_start, gap_end, round(gap_minutes, 6) AS gap_minutes, e.n AS nearest_event, round_even(e.d / {DAY_US}.0::DOUBLE, 1) AS days_away
 FROM n""",
    "j4_episode_nearest": f"""WITH {_V}, t AS (SELECT min(us) AS episode_start FROM (SELECT *, sum(nw) {_W} AS run FROM (SELECT *,
 CASE WHEN dv = lag(dv) {_W} THEN 0 ELSE 1 END AS nw FROM v)) GROUP BY run HAVING min(dv) = 0 AND max(us) - min(us) >= {H // 2}),
 n AS (SELECT *, {_nearest('episode_start')} AS e FROM t)
 SELECT episode_start, e.n AS nearest_event, round_even(e.d / {DAY_US}.0::DOUBLE, 1) AS days_away FROM n""",
    "j5_failure_rows": f"WITH {_SEG}, n AS (SELECT ws, row_number() OVER (ORDER BY ws, seg, win) - 1 AS idx FROM grid) " + " UNION ALL ".join(f"SELECT '{f.failure_id}' AS failure_id, (SELECT idx FROM n ORDER BY abs(ws - {f.start}), idx LIMIT 1) AS idx" for f in FAILURES),
    "j6_inside_outside": f"""WITH {_V} SELECT 'left_semi' AS side, count(*) AS n, round(avg(a1), 6) AS a1_mean FROM v
 WHERE {_INSIDE} UNION ALL SELECT 'left_anti', count(*), round(avg(a1), 6) FROM v WHERE NOT ({_INSIDE})""",
    "j2_gaps_near_many": f"""WITH {_GAPS}, {_MANY} SELECT failure_id, gap_start, gap_end, round_even(gap_minutes, 1) AS gap_minutes, round_even((gap_start - e) / {H}.0::DOUBLE, 1) AS start_vs_window_end_h,
 round_even((gap_end - m) / {H}.0::DOUBLE, 1) AS end_vs_maint_h FROM gaps JOIN many ON gap_end >= s AND gap_start <= e""",
    "j3_nearest_of_many": f"""WITH {_MANY}, ev AS (SELECT s AS t, 0 AS k, failure_id AS f, failure_id || '-failure_start' AS name FROM many UNION ALL SELECT e, 1, failure_id, failure_id || '-failure_end' FROM many UNION ALL SELECT m, 2, failure_id, failure_id || '-maintenance' FROM many WHERE m IS NOT NULL),
 u AS (SELECT t, k, f, name FROM ev QUALIFY row_number() OVER (PARTITION BY t ORDER BY k, f) = 1), r AS (SELECT event_id, epoch_us(ts) + 130000000 AS a FROM events),
 c AS (SELECT event_id, a - u.t AS away, k, f, name FROM r ASOF JOIN u ON a >= u.t UNION ALL SELECT event_id, u.t - a, k, f, name FROM r ASOF JOIN u ON a <= u.t)
 SELECT event_id, name AS nearest_event, round_even(away / {DAY_US}.0::DOUBLE, 1) AS days_away FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY away, k, f) = 1""",
    "j5_rows_of_many": f"""WITH {_MANY}, u AS (SELECT epoch_us(ts) AS t, min(event_id) AS i FROM events GROUP BY ALL),
 c AS (SELECT failure_id, s - t AS away, i FROM many ASOF JOIN u ON s >= t UNION ALL SELECT failure_id, t - s, i FROM many ASOF JOIN u ON s <= t) SELECT failure_id, i AS idx FROM c QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY away, i) = 1""",
    "j6_members_of_many": f"""WITH {_MANY}, b AS (SELECT t, sum(n) OVER (ORDER BY t) AS begun FROM (SELECT s AS t, count(*) AS n FROM many GROUP BY s)), o AS (SELECT t, sum(n) OVER (ORDER BY t) AS over FROM (SELECT e AS t, count(*) AS n FROM many GROUP BY e)),
 r AS (SELECT event_id, epoch_us(ts) + 130000000 AS a FROM events), x AS (SELECT event_id, a, coalesce(begun, 0) AS begun FROM r ASOF LEFT JOIN b ON a >= b.t) SELECT event_id, begun > coalesce(over, 0) AS inside FROM x ASOF LEFT JOIN o ON a > o.t""",
    "st1_tumbling": f"""WITH {_V}, {_PASSED} SELECT series_id, ws, ws + {H} AS we, count(*) AS n, round(avg(dv), 6) AS duty, round(quantile_cont(a1, 0.5), 6) AS oil_median, round(CASE WHEN count(*) > 1 THEN stddev_samp(a1) END, 6) AS oil_std,
 round(CASE WHEN count(*) > 1 THEN regr_slope(a1, (us - ws) / 1e6) END, 6) AS oil_trend, round(avg(CASE WHEN comp + dv = 1 THEN 1 ELSE 0 END), 6) AS antiphase_share FROM (SELECT *, us // {H} * {H} AS ws FROM v), passed WHERE ws + {H} <= wm GROUP BY series_id, ws""",
    "st2_sliding": f"""WITH {_V}, {_PASSED} SELECT ws, ws + {H} AS we, count(*) AS n, round(avg(dv), 6) AS duty, round(CASE WHEN count(*) > 1 THEN regr_slope(a1, (us - ws) / 1e6) END, 6) AS oil_trend
 FROM (SELECT *, us // {H // 3} * {H // 3} - unnest([0, {H // 3}, {2 * (H // 3)}]) AS ws FROM v), passed WHERE ws + {H} <= wm GROUP BY ws""",
    "st3_gap_sessions": f"""WITH {_SEG}, {_PASSED} SELECT 'S1' AS series_id, seg_start, seg_end, n FROM segs, med, passed WHERE seg_end + CAST(floor(10 * m) AS BIGINT) <= wm""",
    "st4_coverage": f"""WITH {_L}, {_PASSED}, x AS (SELECT greatest(1, CAST(round_even({H} / m, 0) AS BIGINT)) AS e FROM med), w AS (SELECT us // {H} * {H} AS ws, count(*) AS n FROM v GROUP BY ALL)
 SELECT ws, n, round(n / e, 6) AS coverage FROM w, x, passed WHERE ws + {H} <= wm AND n / e >= 0.9""",
    "st5_segment_windows": f"""WITH {_FEAT}, {_PASSED}, far AS (SELECT seg, max(us) AS last FROM rows_, passed WHERE us <= wm GROUP BY seg)
 SELECT seg, win, ws, we, n_samples, label, rising_edges, {', '.join(map(_R4, ('duty', 'oil_median', 'oil_std', 'tp3_decay_slope', 'longest_load_stretch')))} FROM f JOIN far USING (seg) WHERE we <= last""",
    "w14_range_frames": f"""WITH {_V} SELECT event_id, count(*) OVER w AS n, sum(a2) OVER w AS a2_sum, min(a1) OVER w AS a1_low, max(a1) OVER w AS a1_high FROM v
 WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL {6 * H - 1} MICROSECONDS PRECEDING AND CURRENT ROW)""",
    "k1_sketched_spans": """WITH s AS (SELECT * FROM (VALUES ('week', DATE '2024-01-01', DATE '2024-01-07'), ('month', DATE '2024-01-01', DATE '2024-01-31'), ('day', DATE '2024-01-08', DATE '2024-01-08')) x(span, lo, hi))
 SELECT span, 'S1' AS series_id, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, count(DISTINCT user_id) AS users, true AS ranks_near, true AS hll_near, true AS theta_near FROM s JOIN events ON CAST(ts AS DATE) BETWEEN lo AND hi GROUP BY span""",
    "t1_alarms_with_subqueries": f"""WITH {_STATUS} SELECT al.idx, al.ws, al.level, count(s.ws) AS n_above, any_value(coalesce(al.ws - p.before <= {6 * H}, false)) AS follows
 FROM al JOIN scored w ON w.ws = al.ws LEFT JOIN scored s ON s.seg = w.seg AND s.zmax > w.zmax JOIN (SELECT ws, lag(ws) OVER (ORDER BY ws) AS before FROM al) p ON p.ws = al.ws GROUP BY al.idx, al.ws, al.level""",
    "t2_alarm_chains": f"""WITH {_STATUS} SELECT min(ws) AS chain_start, max(ws) AS chain_end, count(*) AS n_alarms FROM (SELECT ws, sum(nw) OVER (ORDER BY ws) AS chain
 FROM (SELECT ws, CASE WHEN ws - lag(ws) OVER (ORDER BY ws) <= {6 * H} THEN 0 ELSE 1 END AS nw FROM al)) GROUP BY chain""",
    "t3_windows_of_leaders": f"""WITH {_STATUS}, c AS (SELECT driver, avg(zmax) AS mean, row_number() OVER (ORDER BY count(*) DESC, driver) AS k FROM scored WHERE alert GROUP BY driver)
 SELECT ws, driver, round(zmax - mean, 5) AS above FROM scored JOIN c USING (driver) WHERE alert AND k <= 3""",
    "u1_runs_of_users": """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) AS us, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS state FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us) - row_number() OVER (PARTITION BY series, state ORDER BY us) AS g FROM o)
 SELECT series, state, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM r GROUP BY series, state, g""",
    "j8_lookback_cycles": f"""WITH {_SEG}, lk AS (SELECT g.seg, g.win, v.us, v.event_id, v.dv FROM grid g
 JOIN v ON v.us > g.we - {6 * H} AND v.us <= g.we){_CYC.format(p='k_', k='seg, win', src='lk')}
 SELECT g.seg, g.win, round(cv, 4) AS cycle_dur_cv_6h, round(tr, 4) AS cycle_dur_trend_6h FROM grid g LEFT
 JOIN k_cyc USING (seg, win)""",
    "l1_labels": f"WITH {_LAB} SELECT event_id, label FROM lb",
    "l2_relabelled": f"""WITH {_LAB} SELECT
 CASE WHEN label = 'healthy' AND ({' OR '.join(f'(us >= {f.start - 168 * H} AND us < {f.start})' for f in FAILURES)}) THEN 'prefail' ELSE label END AS label, count(*) AS n
 FROM lb GROUP BY 1""",
    "fe1_duty": f"WITH {_FEAT} {_F6}{', '.join(map(_R4, ('duty', 'frac_off', 'frac_offloaded', 'frac_loaded')))} FROM f",
    "fe2_pressure": f"WITH {_FEAT} {_F6}{_R4('tp3_decay_slope')}, cycles_per_hour, rising_edges FROM f",
    "fe3_thermal": f"WITH {_FEAT} {_F6}{_R4('oil_median')}, {_R4('oil_trend')} FROM f",
    "fe4_residual": f"WITH {_FEAT} {_F6}{_R4('oil_residual')} FROM f",
    "fe5_variability": f"""WITH {_FEAT} {_F6}{', '.join(map(_R4, ('oil_std', 'tp3_std', 'duty_std', 'cycle_dur_cv', 'cycle_dur_trend', 'longest_load_stretch')))}
 FROM f""",
    "fe7_instrument": f"WITH {_FEAT} {_F6}{_R4('antiphase_share')}, motor_frozen, tp3_frozen FROM f",
    "fe10_regime": f"WITH {_FEAT} {_F6}cycling_regime FROM f",
    "fe9_features": f"""WITH {_FEAT} {_F6}ws, we, n_samples, label, cycling_regime, {', '.join(c if c == 'cycles_per_hour' else _R4(c) for c in SCORED)}
 FROM f""",
    "fe11_prepared": f"""WITH {_PREP} {_F6}{', '.join(map(_R4, FILLED))}, tp3_decay_slope_missing, oil_trend_missing, cycle_dur_cv_missing
 FROM p""",
    "m2_split": f"WITH {_FEAT}, {_split('f')} {_F6}is_train, is_val, is_eval_fail, is_eval_degr FROM sp",
    "m3_scaler": f"""WITH {_SCORE}
 SELECT round(mu_duty, 6) AS mu_duty, round(sd_duty, 6) AS sd_duty, round(mu_oil_std, 6) AS mu_oil_std, round(sd_oil_std, 6) AS sd_oil_std
 FROM sc""",
    "m5_zmax": f"WITH {_SCORE} {_F6}ws, we, label, {_R('zmax', 5)}, alert, quality_bad FROM scored",
    "m13_driver_frequency": f"WITH {_SCORE} SELECT driver, count(*) AS n FROM scored WHERE is_eval_fail GROUP BY driver",
    "m14_ablation": f"WITH {_long(('zmax', 'zmax_plain'))}{_ROC} SELECT model, target, {_R('roc_auc')}, n_pos, n_neg FROM roc",
    "o4_top_drivers": f"""WITH {_SCORE}, u AS ({' UNION ALL '.join(f'SELECT seg, win, {i} AS i, {c!r} AS col, abs(z_{c}) AS m FROM scored' for i, c in enumerate(SCORED))})
 SELECT col AS "column", count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY seg, win ORDER BY m DESC, i) AS k FROM u)
 WHERE k <= 3 GROUP BY col""",
    "o5_driver": f"WITH {_SCORE} {_F6}driver FROM scored",
    "o3_recent_alerts": f"""WITH {_SCORE}, n AS (SELECT *, row_number() OVER (ORDER BY ws, seg, win) - 1 AS idx FROM scored)
 SELECT idx, ws, {_R('zmax', 5)} FROM n WHERE idx <= 600 AND zmax >= thr ORDER BY idx DESC LIMIT 8""",
    "ev2_evaluation": f"""WITH {_long()}{_ROC}{_AP},
 per_target AS (SELECT model, target, coalesce(sum(y * hit) / CAST(nullif(sum(hit), 0) AS DOUBLE), 0) AS precision, sum(y * hit) / CAST(nullif(sum(y), 0) AS DOUBLE) AS recall,

 CASE WHEN target <> 'degraded' THEN coalesce(round_even((max(start) - min(ws) FILTER (y = 1 AND hit = 1 AND ws < start)) / {H}.0::DOUBLE, 1), 0) END AS lead_h, avg(hit) FILTER (y = 0) * 24 AS fa_per_day
 FROM (SELECT long.*, CASE WHEN score > thr THEN 1 ELSE 0 END AS hit FROM long, thr) GROUP BY model, target)

 SELECT model, target, {', '.join(map(_R, ('precision', 'recall', 'lead_h', 'fa_per_day', 'roc_auc')))}, n_pos, n_neg, {_R('pr_auc')}
 FROM per_target LEFT JOIN roc USING (model, target) LEFT JOIN ap USING (model, target)""",
    "ev3_roc": f"WITH {_long()}{_ROC} SELECT model, target, {_R('roc_auc')}, n_pos, n_neg FROM roc",
    "ev4_ap": f"WITH {_long()}{_AP} SELECT model, target, {_R('pr_auc')} FROM ap",
    "ev8_sweep": f"""WITH {_SCORE}, qs AS ({' UNION ALL '.join(f'SELECT {q}::DOUBLE AS quantile, quantile_cont(zmax, {q}::DOUBLE) AS t FROM scored WHERE is_val' for q in (0.9, 0.95, 0.99, 0.995, 0.999))}),
 fl AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, {lo}, {st})' for n, lo, _, st in _TARGETS)}) x(failure, lo, start))
 SELECT quantile, failure, round((SELECT avg(CASE WHEN zmax > t THEN 1 ELSE 0 END) * 24 FROM scored
 WHERE is_val), 6) AS fa_per_day, coalesce(round_even((start - (SELECT min(ws) FROM scored
 WHERE ws >= lo AND ws < start AND zmax > t)) / {H}.0::DOUBLE, 1), 0) AS lead_h FROM qs, fl""",
    "ev10_false_alarms": f"""WITH {_SCORE} SELECT CAST(month(make_timestamp(ws)) AS INTEGER) AS month, count(*) AS n FROM scored
 WHERE is_val AND alert GROUP BY 1""",
    "ev11_descriptive": f"""WITH {_SCORE} SELECT label, round(quantile_cont(zmax, 0.5), 5) AS median_z, count(*) AS n FROM scored
 WHERE label IN ('healthy', 'prefail', 'infail') GROUP BY label""",
    "d1_status": f"WITH {_STATUS} {_F6}status FROM st",
    "d2_alarms": f"WITH {_STATUS} SELECT idx, ws, level FROM al",
    "d3_alarm_groups": f"""WITH {_STATUS} SELECT
 CASE {' '.join(f'WHEN ws BETWEEN {f.start - 14 * DAY_US} AND {f.end} THEN {f.failure_id!r}' for f in FAILURES)} ELSE 'other' END AS failure, level, count(*) AS n
 FROM al GROUP BY ALL""",
    "d4_suspected_faults": f"WITH {_STATUS} SELECT {_FAULT} AS fault, count(*) AS n FROM al GROUP BY 1",
    "d5_alarm_counts": f"""WITH {_STATUS}
 SELECT idx, count(*) OVER (ORDER BY idx) AS n_events, CAST(sum(CASE WHEN level IN ('alert', 'critical') THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS BIGINT) AS n_alerts
 FROM al""",
    "d7_failure_timeline": f"""WITH {_SCORE} SELECT ws, {_R('zmax', 5)}, alert FROM scored
 WHERE ws BETWEEN {FAILURES[3].start - 3 * DAY_US} AND {FAILURES[3].end + 6 * H}""",
    "r1_hash_join_rollup": """SELECT n_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS n_customers
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""",
    "r2_semi_anti": """SELECT c_mktsegment, count(*) AS n, 'left_semi' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders
 WHERE o_custkey = c_custkey) GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 'left_anti' FROM customer
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1""",
    "r3_outer_joins": """WITH a AS (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1),
 b AS (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
 SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, n_suppliers, n_customers FROM a FULL JOIN b ON s_nationkey = c_nationkey""",
    "r4_ranks": """SELECT *
 FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(10) OVER w AS tile, lead(o_orderkey) OVER w AS next_key
 FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn <= 20""",
    "r5_set_operations": """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders
 WHERE o_totalprice > 300000) SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS s, 'intersect' AS op FROM (SELECT k FROM a INTERSECT
 SELECT k FROM b) UNION ALL SELECT count(*), CAST(sum(k) AS BIGINT), 'except' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
 UNION ALL SELECT count(*), CAST(sum(k) AS BIGINT), 'union' FROM (SELECT k FROM a UNION SELECT k FROM b)""",
    "r6_cube": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 4) AS disc
 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "r7_top_parts": """SELECT p_partkey, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
 JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY revenue DESC, p_partkey LIMIT 50""",
}


def _describe(columns: dict[str, str], src: str, digits: int) -> str:
    one = """SELECT '{n}' AS signal, count({c}) AS n, round(avg({c}), {k}) AS mean, round(stddev_samp({c}), {k}) AS std, round(min({c}), {k}) AS min,
 round(quantile_cont({c}, 0.25), {k}) AS p25, round(quantile_cont({c}, 0.5), {k}) AS p50, round(quantile_cont({c}, 0.75), {k}) AS p75,
 round(max({c}), {k}) AS max FROM {src}"""
    return " UNION ALL ".join(one.format(n=n, c=c, src=src, k=digits) for n, c in columns.items())


def _rows(names: str, values: list[tuple]) -> str:
    return f"(VALUES {', '.join(str(v) for v in values)}) x({names})"


_AT = "make_timestamp(ws)"
_IDX = f"{_SCORE}, n AS (SELECT *, row_number() OVER (ORDER BY ws, seg, win) - 1 AS idx FROM scored)"
_FAMILY = ("duty", "tp3_decay_slope", "oil_residual", "cycle_dur_cv", "antiphase_share")
_CIRCLE = ", ".join(
    f"round({f}(2 * pi() / {n} * {c}), 5) AS {name}_{f}" for name, c, n in (("hour", "hour(t)", 24), ("dow", "(isodow(t) - 1)", 7)) for f in ("sin", "cos")
)
ORACLES |= {
    "a11_healthy_hours": f"""WITH {_LAB}, h AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, avg(dv) AS duty, count(*) AS n FROM lb
 WHERE label = 'healthy' GROUP BY 1)
 SELECT hour, round(duty, 6) AS duty, n, round(max(duty) OVER () - min(duty) OVER (), 6) AS spread FROM h""",
    "a23_effect_matrix": f"""WITH {_FEAT}, u AS ({" UNION ALL ".join(f"SELECT ws, label, '{c}' AS feature, {c} AS x FROM f" for c in _FAMILY)}),
 b AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM u
 WHERE label = 'healthy' AND x IS NOT NULL GROUP BY feature),
 p AS (SELECT failure, feature, quantile_cont(u.x, 0.5) AS m
 FROM u, {_rows("failure, lo, hi", [(f.failure_id, f.start - 48 * H, f.start) for f in FAILURES])}
  WHERE ws >= lo AND ws < hi AND u.x IS NOT NULL GROUP BY failure, feature)
 SELECT failure, feature, round((m - q2) / CASE WHEN q3 = q1 THEN 1.0 ELSE q3 - q1 END, 5) AS shift FROM p JOIN b USING (feature)""",
    "a27_density": f"""WITH {_V}, m AS (SELECT min(a1) AS lo, max(a1) AS hi, count(a1) AS a FROM v),
 h AS (SELECT CAST(least(floor((a1 - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM v, m GROUP BY 1)
 SELECT bin, n, round(n / (a * ((hi - lo) / 50)), 8) AS density, round(log10(n), 8) AS log10_n FROM h, m""",
    "a38_span_details": f"""WITH {_GAPS}, s AS (SELECT failure, avg(a2) FILTER (dv = 1) AS motor, min(us) AS a, max(us) AS b FROM v,
  {_rows("failure, lo, hi", [(f.failure_id, f.start - DAY_US, f.end + DAY_US) for f in FAILURES])} WHERE us >= lo AND us < hi
 GROUP BY failure)
 SELECT failure, round(motor, 6) AS motor_loaded, (SELECT count(*) FROM gaps WHERE gap_start >= a AND gap_end <= b) AS gaps_inside
 FROM s""",
    "a39_describe_scores": f"WITH {_SCORE} {_describe({'zmax': 'zmax', 'zmax_plain': 'zmax_plain'}, 'scored', 5)}",
    "a40_twin_difference": f"WITH {_V} SELECT abs(comp - (1 - dv)) AS difference, count(*) AS n, round(avg(abs(a1 - a2)), 6) AS apart_mean, round(max(abs(a1 - a2)), 6) AS apart_most FROM v GROUP BY ALL",
    "d6_gauge": f"""WITH {_STATUS}, g AS (SELECT *, greatest(1.6 * (thr * 0.8::DOUBLE), 1.25 * zmax, 15.0) AS top FROM sv WHERE idx = 400)

 SELECT ws, status, round(least(zmax, top), 5) AS value, round(top, 5) AS vmax, round(tw, 5) AS watch_from, round(thr * 0.8::DOUBLE, 5) AS alert_from
 FROM g""",
    "d6_timeline": f"""WITH {_STATUS}, t AS (SELECT * FROM sv WHERE idx BETWEEN {600 - 14 * 24} AND 600)

 SELECT t.idx, t.ws, round(t.zmax, 5) AS zmax, t.idx = 600 AS is_now, al.level AS alarm, round(greatest(max(t.zmax) OVER (), max(t.thr * 0.8::DOUBLE) OVER ()) * 1.15::DOUBLE, 5) AS top
 FROM t LEFT JOIN al USING (idx)""",
    "d6_driver_bars": f"""WITH {_SCORE}, w AS (SELECT * FROM scored WHERE ws = (SELECT min(ws) FROM scored
 WHERE ws >= {FAILURES[2].start})),
 u AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS col, abs(z_{c}) AS z FROM w" for i, c in enumerate(SCORED))})
 SELECT col AS "column", round(z, 5) AS z, CASE WHEN z >= 3 THEN 3 WHEN z >= 2 THEN 2 WHEN z >= 1 THEN 1 ELSE 0 END AS band FROM u
 ORDER BY z DESC NULLS LAST, i LIMIT 6""",
    "d7_first_crossings": f"""WITH {_SCORE}
 SELECT failure, count(*) AS n, round(max(zmax), 5) AS peak, min(ws) FILTER (alert AND ws < s) AS first_alert,
 round((max(s) - min(ws) FILTER (alert AND ws < s)) / {H}.0::DOUBLE, 5) AS lead_h FROM scored,
 {_rows("failure, s, e", [(f.failure_id, f.start, f.end) for f in FAILURES])} WHERE ws >= s - {3 * DAY_US} AND ws <= e + {6 * H}
 GROUP BY failure""",
    "ev10_false_alarm_list": f"WITH {_SCORE} SELECT ws, {_R('zmax', 5)}, driver FROM scored WHERE is_val AND alert",
    "ev10_high_healthy": f"""WITH {_SCORE} SELECT CAST(month({_AT}) AS INTEGER) AS month, count(*) AS n, min(ws) AS first_ws
 FROM scored WHERE is_val AND zmax > thr * 0.75::DOUBLE GROUP BY 1""",
    "j10_window_of_key": f"""WITH {_STATUS} SELECT f.ws, round(f.duty, 4) AS duty, round(f.oil_median, 4) AS oil_median, f.label
 FROM f JOIN al ON f.ws = al.ws""",
    "w12_tail": f"WITH {_IDX} SELECT idx, ws, {_R('zmax', 5)} FROM n WHERE idx BETWEEN {500 - 14 * 24} AND 500",
    "m1_matrix": f"""WITH {_FEAT} SELECT seg, win, CAST(motor_frozen AS INTEGER) AS motor_frozen, CAST(tp3_frozen AS INTEGER) AS tp3_frozen,
 {", ".join(f"CAST(cycling_regime = '{r}' AS INTEGER) AS regime_{r}" for r in ("cycling", "idle", "locked"))}, rising_edges, round(duty, 4) AS duty
 FROM f""",
    "fe12_calendar": f"""WITH {_FEAT}, c AS (SELECT *, {_AT} AS t FROM f), b AS (SELECT hour(t) AS h, avg(duty) AS base FROM c
 WHERE label = 'healthy' GROUP BY 1)
 SELECT seg, win, {_CIRCLE}, round(duty - base, 5) AS duty_residual FROM c LEFT JOIN b ON hour(t) = h""",
    "o8_without_second": f"""WITH {_SCORE},
 k AS (SELECT driver, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, driver NULLS FIRST) AS INTEGER) AS k
 FROM scored GROUP BY driver)
 SELECT driver, n, k FROM k WHERE k <> 2 ORDER BY k LIMIT 3""",
    "s1_series_gaps": f"""WITH l AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id
 ORDER BY ts, event_id) AS dus FROM events)

 SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS n, count(*) FILTER (dus > {DAY_US}) + 1 AS n_segments, max(dus) AS longest_us
 FROM l GROUP BY user_id""",
    "r8_strings": """SELECT upper(substr(c_mktsegment, 1, 4)) AS segment, suffix(c_name, '7') AS ends_with_7, count(*) AS n, max(lower(c_mktsegment) || '/' || c_name) AS last
 FROM customer GROUP BY 1, 2""",
}


# --- episodes from slices, spectra, matrices


def _state_episodes(state: str, lo: int, hi: int, coarse: int = 6 * H, fine: int = H // 4) -> str:
    def slices(name: str, step: int) -> str:
        return f"""{name} AS (SELECT k, coalesce(state, false) AS state FROM (SELECT unnest(range({-(-(hi - lo) // step)})) AS k)
 LEFT JOIN (SELECT (us - {lo}) // {step} AS k, {state} AS state FROM v WHERE us >= {lo} AND us < {hi} GROUP BY 1) USING (k))"""

    return f"""WITH {_V}, {slices("co", coarse)}, {slices("fi", fine)},
 fl AS (SELECT k, state FROM (SELECT *, coalesce(lag(state) OVER (ORDER BY k), false) AS was FROM co) WHERE state <> was),
 pl AS (SELECT fl.k, fl.state, coalesce({lo} + min(fi.k) * {fine}, {lo} + fl.k * {coarse}) AS t FROM fl
 LEFT JOIN fi ON fi.k // {coarse // fine} BETWEEN fl.k - 1 AND fl.k AND fi.state = fl.state GROUP BY fl.k, fl.state),
 cl AS (SELECT k, state, max(t) OVER (ORDER BY k) AS t FROM pl),
 nx AS (SELECT *, coalesce(lead(t) OVER (ORDER BY k), {hi}) AS u FROM cl)
 SELECT t AS episode_start, u AS episode_end FROM nx WHERE state AND u > t"""


def _eliminated(name: str, p: int) -> str:
    """Gauss-Jordan steps on the table {name}0 (i, j, v) of p rows; the last table is {name}{p}."""
    return ",\n ".join(
        f"""{name}{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / d.v ELSE a.v - c.v * r.v / d.v END AS v
 FROM {name}{k} a JOIN {name}{k} r ON r.i = {k} AND r.j = a.j JOIN {name}{k} c ON c.i = a.i AND c.j = {k}
 JOIN {name}{k} d ON d.i = {k} AND d.j = {k})"""
        for k in range(p)
    )


_P = len(SCORED)
#: Shrunk covariance sh, its inverse inv, and the distances mh of all windows of sp.
_MAHALANOBIS = f"""cx AS (SELECT seg, win, is_train, unnest(range({_P})) AS i,
 unnest([{", ".join(f"coalesce({c} - avg({c}) FILTER (is_train) OVER (), 0)" for c in SCORED)}]) AS x FROM sp),
 q4 AS (SELECT avg(q * q) AS q4, count(*) AS n FROM (SELECT sum(x * x) AS q FROM cx WHERE is_train GROUP BY seg, win)),
 cv AS MATERIALIZED (SELECT a.i, b.i AS j, avg(a.x * b.x) AS v FROM cx a JOIN cx b USING (seg, win) WHERE a.is_train GROUP BY a.i, b.i),
 mm AS (SELECT sum(v) / {_P} AS m FROM cv WHERE i = j),
 dl AS (SELECT sum((v - CASE WHEN i = j THEN m ELSE 0 END) ** 2) / {_P} AS d, sum(v * v) AS fro FROM cv, mm),
 wt AS (SELECT CASE WHEN d > 0 THEN least((q4 - fro) / (n * {_P}), d) / d ELSE 0 END AS w FROM dl, q4),
 sh AS MATERIALIZED (SELECT i, j, (1 - w) * v + CASE WHEN i = j THEN w * m ELSE 0 END AS v FROM cv, mm, wt),
 ge0 AS MATERIALIZED (SELECT * FROM sh UNION ALL SELECT i, i2 + {_P}, CASE WHEN i = i2 THEN 1.0::DOUBLE ELSE 0 END
 FROM (SELECT unnest(range({_P})) AS i), (SELECT unnest(range({_P})) AS i2)),
 {_eliminated("ge", _P)},
 inv AS MATERIALIZED (SELECT i, j - {_P} AS j, v FROM ge{_P} WHERE j >= {_P}),
 mh AS (SELECT a.seg, a.win, sqrt(greatest(sum(a.x * v * b.x), 0)) AS mahalanobis FROM cx a JOIN cx b USING (seg, win)
 JOIN inv ON inv.i = a.i AND inv.j = b.i GROUP BY a.seg, a.win)"""
_LAGS = 6
#: Distances fr of all windows of p from a ridge regression on the last ones of their segment.
_FORECAST = f"""lg AS (SELECT *, coalesce(s{_LAGS} = seg AND y IS NOT NULL AND {" AND ".join(f"y{k} IS NOT NULL" for k in range(1, _LAGS + 1))}, false) AS usable FROM
 (SELECT seg, win, label, oil_median AS y, lag(seg, {_LAGS}) OVER o AS s{_LAGS}, {", ".join(f"lag(oil_median, {k}) OVER o AS y{k}" for k in range(1, _LAGS + 1))}
 FROM p WINDOW o AS (ORDER BY ws, win))),
 fx AS (SELECT *, usable AND label = 'healthy' AS fits FROM lg),
 rx AS (SELECT seg, win, fits, unnest(range({_LAGS + 1})) AS i,
 unnest([{", ".join(f"{c} - avg({c}) FILTER (fits) OVER ()" for c in [*[f"y{k}" for k in range(1, _LAGS + 1)], "y"])}]) AS x FROM fx),
 rg0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) + CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0 END AS v FROM rx a
 JOIN rx b USING (seg, win) WHERE a.fits AND a.i < {_LAGS} GROUP BY a.i, b.i),
 {_eliminated("rg", _LAGS)},
 fr AS (SELECT seg, win, CASE WHEN usable THEN abs(e) ELSE 0 END AS forecast_residual FROM fx JOIN
 (SELECT seg, win, sum(CASE WHEN rx.i = {_LAGS} THEN x ELSE -v * x END) AS e FROM rx
 LEFT JOIN rg{_LAGS} b ON b.i = rx.i AND b.j = {_LAGS} GROUP BY seg, win) USING (seg, win))"""


def _top_eigenvalue(name: str, src: str, squarings: int = 24) -> str:
    """{name} (v): the largest eigenvalue of the positive table src (i, j, v), by squaring it until one direction is left."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {src} WHERE i = j) AS v FROM {src})"]
    for k in range(squarings):
        steps.append(f"{name}_s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b ON a.j = b.i GROUP BY a.i, b.j)")
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_s{k} WHERE i = j) AS v FROM {name}_s{k})")
    return ",\n ".join(steps) + f",\n {name} AS (SELECT sum(a.v * b.v) AS v FROM {src} a JOIN {name}_{squarings} b ON a.i = b.j AND a.j = b.i)"


_SPECTRUM = f"""WITH {_SEG}, c AS (SELECT seg, win, us / 1e6 - min(us / 1e6) OVER w AS t, dv - avg(dv) OVER w AS y, count(*) OVER w AS n
 FROM wr WINDOW w AS (PARTITION BY seg, win)),
 u AS (SELECT seg, win, any_value(n) AS n, sum(y * y) AS yy FROM c GROUP BY seg, win),
 fq AS (SELECT 1 / 3600::DOUBLE + k * ((1 / 60::DOUBLE - 1 / 3600::DOUBLE) / 199) AS f FROM (SELECT unnest(range(200)) AS k)),
 a AS (SELECT seg, win, f, y, cos(2 * pi() * f * t) AS co, sin(2 * pi() * f * t) AS si FROM c JOIN u USING (seg, win), fq WHERE u.n >= 10 AND yy > 0),
 g AS (SELECT seg, win, f, sum(co * co) - sum(co) ** 2 / count(*) AS cc, sum(si * si) - sum(si) ** 2 / count(*) AS ss,
 sum(co * si) - sum(co) * sum(si) / count(*) AS cs, sum(y * co) - sum(y) * avg(co) AS yc, sum(y * si) - sum(y) * avg(si) AS ys FROM a GROUP BY seg, win, f),
 w AS (SELECT seg, win, f, (ss * yc ** 2 - 2 * cs * yc * ys + cc * ys ** 2) / (cc * ss - cs ** 2) AS power FROM g),
 x AS (SELECT seg, win, arg_max(f, power) AS best, -sum(p * ln(p + 1e-12)) AS entropy FROM
 (SELECT *, power / sum(power) OVER (PARTITION BY seg, win) AS p FROM w) GROUP BY seg, win)
 SELECT seg, win, round(best, 6) AS dominant_freq, round(entropy, 6) AS spectral_entropy FROM u LEFT JOIN x USING (seg, win)"""
_MONTH = (_us("2024-01-01 00:00"), _us("2024-01-31 00:00"))


def _lookback_rocs() -> str:
    """ROC-AUC with cycle columns of the window and of the six hours up to its end."""
    six = f"""lk AS (SELECT g.seg, g.win, v.us, v.event_id, v.dv FROM grid g JOIN v ON v.us > g.we - {6 * H} AND v.us <= g.we){_CYC.format(p="k_", k="seg, win", src="lk")},
 f6 AS (SELECT f.* REPLACE (k.cv AS cycle_dur_cv, k.tr AS cycle_dur_trend) FROM f LEFT JOIN k_cyc k USING (seg, win))"""
    one = f"WITH {_long()}{_ROC} SELECT 'zmax_1h' AS model, target, {_R('roc_auc')}, n_pos, n_neg FROM roc"
    medians, filled = _PREP.removeprefix(_FEAT), f"WITH {_long()}{_ROC} SELECT 'zmax_6h' AS model, target, {_R('roc_auc')}, n_pos, n_neg FROM roc"
    swapped = f", {six}{medians.replace('FROM f WHERE', 'FROM f6 WHERE').replace('FROM f, md', 'FROM f6, md')}"
    return f"SELECT * FROM ({one}) UNION ALL SELECT * FROM ({filled.replace(medians, swapped)})"


_THREE = ("zmax", "mahalanobis", "forecast_residual")
_ALL_SCORES = _long(_THREE).replace(_SCORE, f"{_SCORE.replace(' scored AS (', ' scored0 AS (')}, {_MAHALANOBIS},\n {_FORECAST},\n scored AS (SELECT * FROM scored0 LEFT JOIN mh USING (seg, win) LEFT JOIN fr USING (seg, win))")
ORACLES |= {
    "e1_state_episodes": _state_episodes("avg(CASE WHEN dv = 0 THEN 1 ELSE 0 END) > 0.6::DOUBLE", *_MONTH),
    "e2_stuck_instrument": _state_episodes("var_samp(a2) < 800 AND avg(CASE WHEN comp + dv = 1 THEN 1 ELSE 0 END) < 0.8::DOUBLE", *_MONTH),
    "fe6_spectral": _SPECTRUM,
    "m6_mahalanobis": f"WITH {_PREP}, {_split('p')}, {_MAHALANOBIS} SELECT seg, win, {_R4('mahalanobis')} FROM mh",
    "m8_forecast_residual": f"WITH {_PREP}, {_FORECAST} SELECT seg, win, {_R4('forecast_residual')} FROM fr",
    "m14_lookback": _lookback_rocs(),
    "m16_condition": f"""WITH {_PREP}, {_split('p')}, {_MAHALANOBIS}, {_top_eigenvalue('big', 'sh')}, {_top_eigenvalue('low', 'inv')}
 SELECT round(big.v * low.v, 2) AS condition FROM big, low""",
    "d2_alarms_replayed": f"WITH {_STATUS} SELECT idx, ws, level FROM al WHERE idx <= 400",
    "ev12_scorers": f"""WITH {_ALL_SCORES}{_ROC}{_AP},
 cut AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, quantile_cont({m}, CAST(0.99 AS DOUBLE)) AS cut FROM scored WHERE is_val" for m in _THREE)}),
 per_target AS (SELECT model, target, coalesce(sum(y * hit) / CAST(nullif(sum(hit), 0) AS DOUBLE), 0) AS precision, sum(y * hit) / CAST(nullif(sum(y), 0) AS DOUBLE) AS recall,
 CASE WHEN target <> 'degraded' THEN coalesce(round_even((max(start) - min(ws) FILTER (y = 1 AND hit = 1 AND ws < start)) / {H}.0::DOUBLE, 1), 0) END AS lead_h, avg(hit) FILTER (y = 0) * 24 AS fa_per_day
 FROM (SELECT long.*, CASE WHEN score > cut THEN 1 ELSE 0 END AS hit FROM long JOIN cut USING (model)) GROUP BY model, target)
 SELECT model, target, {", ".join(map(_R, ("precision", "recall", "lead_h", "fa_per_day", "roc_auc")))}, n_pos, n_neg, {_R("pr_auc")}
 FROM per_target LEFT JOIN roc USING (model, target) LEFT JOIN ap USING (model, target) WHERE recall IS NOT NULL""",
    "s3_typed_csv": f"WITH {_V} SELECT us, a1, a2, dv, comp FROM v",
    "s5_parquet_by_date": f"""WITH {_V} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, round(avg(a1), 6) AS a1_mean, CAST(sum(dv) AS BIGINT) AS loaded
 FROM v WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1""",
}
ORACLES["s10_report"] = f"SELECT model, target, precision, recall, roc_auc, n_pos FROM ({ORACLES['ev2_evaluation']})"
