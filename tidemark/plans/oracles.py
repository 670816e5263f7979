"""DuckDB SQL of the queries."""

from __future__ import annotations

import math

HS = (1, 5, 10, 20)
SPANS = (5, 10, 20, 63, 126)

BARS = """bars AS (SELECT 'ORDERS' AS symbol, row_number() OVER (ORDER BY d) - 1 AS row_id, d AS date, o AS open, h AS high, l AS low, c AS close, v AS volume
 FROM (SELECT CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1))"""
PANEL = """li AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_quantity,
  row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS a,
  row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS z
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity > 0),
panel AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS row_id, * EXCLUDE (symbol) FROM (SELECT symbol, date, max(CASE WHEN a = 1 THEN p END) AS open, max(p) AS high, min(p) AS low, max(CASE WHEN z = 1 THEN p END) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM li GROUP BY 1, 2))"""
BASE = BARS + """,
b0 AS (SELECT *, ln(close) AS lp, ln(1 + volume) AS lv, ln(open) AS lo FROM bars),
b AS (SELECT *, lp - lag(lp) OVER (ORDER BY row_id) AS r FROM b0)"""


def w(n: int, lag: int = 0) -> str:
    return f"(ORDER BY row_id ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"


def over(f: str, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {w(n, lag)} >= {n if least is None else least} THEN {f} OVER {w(n, lag)} END"


def shift(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (ORDER BY row_id)" if k else x


def z(x: str, n: int, least: int | None = None) -> str:
    return f"({x} - ({over(f'avg({x})', x, n, least)})) / nullif({over(f'stddev_samp({x})', x, n, least)}, 0)"


def q(cols: dict[str, str], source: str = "b", with_: str = BASE, digits: int = 6) -> str:
    return f"WITH {with_} SELECT row_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS {n}" for n, e in cols.items()) + f" FROM {source}"


def entropy(n: int) -> str:
    p = over("avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END)", "r", n)
    part = lambda x: f"CASE WHEN {x} > 0 THEN -({x}) * log2({x}) ELSE 0 END"
    return f"CASE WHEN ({p}) IS NOT NULL THEN {part(f'({p})')} + {part(f'(1 - ({p}))')} END"


def labels_sql(h: int) -> str:
    thr = f"greatest({0.35 * math.sqrt(h)!r} * sigma, {math.log1p(8 / 1e4)!r}, {math.log1p(7 / 1e4)!r})"
    return f"""SELECT *, {h} AS horizon, lead(lp, {h}) OVER o - lp AS s_ret, lead(lo, {1 + h}) OVER o - lead(lo, 1) OVER o AS e_ret, CASE WHEN sigma IS NOT NULL THEN {thr} END AS thr, lead(date, {1 + h}) OVER o AS exit_ts, lead(date, 1) OVER o AS entry_ts, lead(date, 1) OVER o AS avail_ts FROM sig3 WINDOW o AS (ORDER BY row_id)"""


SIG = BASE + f", sig AS (SELECT *, {over('stddev_samp(r)', 'r', 63, 40)} AS sigma, {z('lp', 20)} AS z20, lp - {shift('lp', 20)} AS m20, {over('stddev_samp(r)', 'r', 20)} AS vol20 FROM b), sig2 AS (SELECT *, lag(vol20) OVER (ORDER BY row_id) AS lv20 FROM sig), sig3 AS (SELECT *, {z('lv20', 63)} AS vz FROM sig2)"
LABELS = SIG + ", lab AS (" + " UNION ALL ".join(labels_sql(h) for h in HS) + """),
labels AS (SELECT *, CAST(s_ret > 0 AS INT) AS s_dir, CAST(e_ret > 0 AS INT) AS e_dir, coalesce(abs(e_ret) > thr, false) AS act, s_ret IS NOT NULL AND e_ret IS NOT NULL AND thr IS NOT NULL AND exit_ts IS NOT NULL AS eligible FROM lab)"""
SCORED = LABELS + ", sc AS (SELECT *, 1 / (1 + exp(-z20 / 4)) AS p, e_dir AS y FROM labels WHERE eligible AND z20 IS NOT NULL)"
EVENTS = LABELS + ", ev AS (SELECT row_id, row_id + 6 AS e FROM labels WHERE horizon = 5 AND eligible)"


def conf(t: str = "0.5") -> str:
    return f"count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp, count(*) FILTER (WHERE p < {t} AND y = 0) AS tn, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn"


def dz(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


RATES = {"recall_up": dz("tp", "tp + fn"), "recall_down": dz("tn", "tn + fp"), "precision_up": dz("tp", "tp + fp"), "precision_down": dz("tn", "tn + fn"), "accuracy": dz("tp + tn", "tp + tn + fp + fn"), "balanced_accuracy": f"({dz('tp', 'tp + fn')} + {dz('tn', 'tn + fp')}) / 2", "macro_f1": f"({dz('2 * tp', '2 * tp + fp + fn')} + {dz('2 * tn', '2 * tn + fp + fn')}) / 2", "mcc": dz("tp * tn - fp * fn", "sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))")}
AUC = "SELECT horizon, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS roc_auc FROM (SELECT horizon, y, rank() OVER (PARTITION BY horizon ORDER BY p) + (count(*) OVER (PARTITION BY horizon, p) - 1) / 2.0::DOUBLE AS rk, CAST(count(*) FILTER (WHERE y = 1) OVER (PARTITION BY horizon) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE y = 0) OVER (PARTITION BY horizon) AS DOUBLE) AS n0 FROM sc) GROUP BY horizon, n1, n0"
BIN = lambda op: " + ".join(f"CAST(p {op} {i / 10!r}::DOUBLE AS INT)" for i in range(1, 10))
BINS = lambda op: f"SELECT horizon, {BIN(op)} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM sc GROUP BY 1, 2"
ECE = f"SELECT a.horizon, ece_weighted, ece_unweighted FROM (SELECT horizon, sum(n * abs(mean_y - mean_p)) / sum(n) AS ece_weighted FROM ({BINS('>=')}) GROUP BY 1) a JOIN (SELECT horizon, avg(abs(mean_y - mean_p)) AS ece_unweighted FROM ({BINS('>')}) GROUP BY 1) c USING (horizon)"
GRID_T = [0.35 + (0.65 - 0.35) * i / 60 for i in range(61)]
GRID = SCORED + f", g AS (SELECT horizon, t AS threshold, {conf('t')} FROM sc CROSS JOIN (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in GRID_T)}]) AS t) GROUP BY 1, 2)"


def greedy(start: str, end: str, wanted: str) -> str:
    """Recursive selection; cand must be a CTE of the scored rows."""
    return SCORED.replace("WITH ", "") + f""", cand AS MATERIALIZED (SELECT *, {start} AS st, {end} AS en FROM sc WHERE {wanted}),
nxt AS MATERIALIZED (SELECT c.horizon, c.row_id, (SELECT min(d.row_id) FROM cand d WHERE d.horizon = c.horizon AND d.st >= c.en AND d.row_id > c.row_id) AS nx FROM cand c),
walk AS (SELECT horizon, min(row_id) AS row_id FROM cand GROUP BY 1 UNION ALL SELECT walk.horizon, nxt.nx FROM walk JOIN nxt USING (horizon, row_id) WHERE nxt.nx IS NOT NULL),
taken AS (SELECT cand.* FROM cand JOIN walk USING (horizon, row_id))"""


ONE = greedy("row_id + 1", "row_id + 1 + horizon", "abs(p - 0.5) > 0.05 + 1e-12")
R6 = lambda e, n: f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}"
COST = repr(math.log1p(5 / 1e4))
LEDGER = ONE + f""", book AS (SELECT s.horizon, s.row_id, t.row_id IS NOT NULL AS active, CASE WHEN t.row_id IS NULL THEN 0 WHEN s.p > 0.5 THEN 1 ELSE -1 END AS signal,
 CASE WHEN t.row_id IS NULL THEN '' ELSE 'row' || s.row_id || '_entry' || (s.row_id + 1) || '_exit' || (s.row_id + 1 + s.horizon) END AS signal_id, s.e_ret, s.r, s.m20, s.vz FROM sc s LEFT JOIN taken t USING (horizon, row_id)),
led AS (SELECT horizon, row_id, active, signal, signal_id, CASE WHEN active THEN signal * e_ret - {COST} ELSE 0e0 END AS candidate, 0e0 AS cash, CASE WHEN active THEN e_ret - {COST} ELSE 0e0 END AS always_long, CASE WHEN active THEN -e_ret - {COST} ELSE 0e0 END AS always_short,
 CASE WHEN active THEN (CASE WHEN r >= 0 THEN 1 ELSE -1 END) * e_ret - {COST} ELSE 0e0 END AS momentum, CASE WHEN active THEN (CASE WHEN m20 >= 0 THEN 1 ELSE -1 END) * e_ret - {COST} ELSE 0e0 END AS trend, CASE WHEN active AND vz <= 0 THEN (CASE WHEN m20 >= 0 THEN 1 ELSE -1 END) * e_ret - {COST} ELSE 0e0 END AS volatility_filtered, active AND coalesce(vz <= 0, false) AS calm FROM book)"""
STRATEGIES = ["candidate", "cash", "always_long", "always_short", "momentum", "trend", "volatility_filtered"]
FAULTS = ["missing", "unexpected", "repeated", "wrong_direction", "wrong_time", "bad_exit", "bad_price", "bad_cost", "bad_ticket", "repeated_order_id", "repeated_deal_id"]
ASOF = """e AS (SELECT event_id, user_id, event_type, ts, value FROM events),
d AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'purchase'),
s AS (SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM e WHERE event_type = 'view') WHERE n = 1),
j AS (SELECT d.event_id, d.user_id, s.value AS v, s.ts IS NOT NULL AS m, CAST(epoch_us(d.ts) - epoch_us(s.ts) AS DOUBLE) / 1e6 AS age FROM d ASOF LEFT JOIN s ON d.user_id = s.user_id AND d.ts >= s.ts)"""


def asof(stale: str) -> str:
    return f"WITH {ASOF}, k AS (SELECT *, {stale} AS st FROM j) SELECT event_id, user_id, round(CASE WHEN m AND NOT st THEN v END, 6) + 0.0 AS value, round(age, 6) + 0.0 AS staleness_seconds, m AS availability_matched, st AS is_stale, CASE WHEN m AND NOT st AND v IS NOT NULL THEN 1e0 ELSE 0e0 END AS feature_coverage FROM k"


SUS = BASE + f""", m AS (SELECT median(r) AS med FROM b), m2 AS (SELECT med, median(abs(r - med)) AS mad FROM b, m GROUP BY med),
i0 AS (SELECT b.*, CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (r - med) / nullif(mad, 0) ELSE 0e0 END AS rz, date_diff('day', lag(date) OVER (ORDER BY row_id), date) AS gap, {over('quantile_cont(volume, 0.5)', 'volume', 63)} AS vm, {over('avg(close)', 'close', 252, None, 1)} AS mean_close FROM b, m2),
i AS (SELECT *, volume / nullif(vm, 0) AS vr, vm / nullif(lag(vm, 63) OVER (ORDER BY row_id), 0) AS sr, CASE WHEN mean_close IS NULL THEN 'unclassified' WHEN close >= mean_close THEN 'bull' ELSE 'bear' END AS regime FROM i0),
wd AS (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b),
sus AS (SELECT row_id, date, 'weekend_row' AS issue_type, CAST(isodow(date) - 1 AS DOUBLE) AS value, 5e0 AS threshold FROM i WHERE isodow(date) >= 6
 UNION ALL SELECT row_id, date, 'long_calendar_gap_days', CAST(gap AS DOUBLE), 4e0 FROM i WHERE gap > 4
 UNION ALL SELECT row_id, date, 'zero_volume', volume, 0e0 FROM i WHERE volume = 0
 UNION ALL SELECT row_id, date, 'outlier_return_robust_z', rz, 6e0 FROM i WHERE abs(rz) >= 6
 UNION ALL SELECT row_id, date, 'flash_move_log_return', r, 0.05::DOUBLE FROM i WHERE abs(r) >= 0.05
 UNION ALL SELECT row_id, date, 'volume_regime_ratio', vr, 3e0 FROM i WHERE vr >= 3 OR vr <= 1 / 3e0
 UNION ALL SELECT row_id, date, 'volume_scale_shift_ratio', sr, 5e0 FROM i WHERE sr >= 5 OR sr <= 1 / 5e0
 UNION ALL SELECT NULL, day, 'potential_missing_weekday', NULL, NULL FROM wd WHERE isodow(day) < 6 AND day NOT IN (SELECT date FROM b))"""
TRIALS = SCORED + ", tr AS (" + " UNION ALL ".join(f"SELECT horizon * 10 + {i} AS trial_id, row_id, (CASE WHEN {x} >= 0 THEN 1 ELSE -1 END) * e_ret AS ret FROM sc" for i, x in ((1, "z20"), (2, "r"), (3, "m20"))) + "), com AS (SELECT row_id FROM tr GROUP BY 1 HAVING count(DISTINCT trial_id) = (SELECT count(DISTINCT trial_id) FROM tr)), al AS (SELECT tr.* FROM tr JOIN com USING (row_id))"
SR = lambda s, qq, n: f"({s} / {n}) / nullif(sqrt(greatest(0, ({qq} - {n} * ({s} / {n}) * ({s} / {n})) / ({n} - 1))), 0)"
PBO = TRIALS + f""", pt AS (SELECT trial_id, ntile(8) OVER (PARTITION BY trial_id ORDER BY row_id) - 1 AS part, ret FROM al),
sm AS (SELECT trial_id, part, CAST(count(*) AS DOUBLE) AS n, sum(ret) AS s, sum(ret * ret) AS qq FROM pt GROUP BY 1, 2),
mk AS (SELECT m FROM range(256) t(m) WHERE bit_count(CAST(m AS INT)) = 4),
io AS (SELECT m, trial_id, sum(n) FILTER (WHERE (m >> part) & 1 = 1) AS n1, sum(s) FILTER (WHERE (m >> part) & 1 = 1) AS s1, sum(qq) FILTER (WHERE (m >> part) & 1 = 1) AS q1, sum(n) FILTER (WHERE (m >> part) & 1 = 0) AS n0, sum(s) FILTER (WHERE (m >> part) & 1 = 0) AS s0, sum(qq) FILTER (WHERE (m >> part) & 1 = 0) AS q0 FROM sm CROSS JOIN mk GROUP BY 1, 2),
sh AS (SELECT m, trial_id, {SR('s1', 'q1', 'n1')} AS i, {SR('s0', 'q0', 'n0')} AS o FROM io),
rk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY i DESC, trial_id) AS rn FROM sh),
lg AS (SELECT a.m, (sum(CASE WHEN c.o < a.o THEN 1 ELSE 0 END) + 0.5::DOUBLE * sum(CASE WHEN c.o = a.o THEN 1 ELSE 0 END)) / count(*) AS sha FROM rk a JOIN sh c USING (m) WHERE a.rn = 1 GROUP BY 1),
lo2 AS (SELECT ln(least(greatest(sha, 1e-6), 1 - 1e-6) / (1 - least(greatest(sha, 1e-6), 1 - 1e-6))) AS logit FROM lg)"""


def ewm(x: str, alpha: str) -> str:
    return f"(1 - {alpha}) * e.{x} + {alpha} * s.{x}"


EWM = BASE + """, x0 AS (SELECT row_id, lp, greatest(r, 0) AS g, greatest(-r, 0) AS l, CASE WHEN r IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (ORDER BY row_id)), abs(low - lag(close) OVER (ORDER BY row_id))) END AS tr, close, r FROM b),
e AS (SELECT row_id, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, tr, lp AS f, lp AS s, CAST(NULL AS DOUBLE) AS sg FROM x0 WHERE row_id = 0
 UNION ALL SELECT x.row_id, CASE WHEN e.g IS NULL THEN x.g ELSE e.g * 13 / 14 + x.g / 14 END, CASE WHEN e.l IS NULL THEN x.l ELSE e.l * 13 / 14 + x.l / 14 END, e.tr * 13 / 14 + x.tr / 14, e.f * 11 / 13 + x.lp * 2 / 13, e.s * 25 / 27 + x.lp * 2 / 27,
 CASE WHEN x.row_id < 25 THEN NULL WHEN x.row_id = 25 THEN (e.f * 11 / 13 + x.lp * 2 / 13) - (e.s * 25 / 27 + x.lp * 2 / 27) ELSE e.sg * 0.8 + ((e.f * 11 / 13 + x.lp * 2 / 13) - (e.s * 25 / 27 + x.lp * 2 / 27)) * 0.2 END
 FROM e JOIN x0 x ON x.row_id = e.row_id + 1)"""
A20, A63 = repr(2 / 21), repr(2 / 64)
EWV = BASE + f""", v AS (SELECT row_id, r AS m20, 0e0 AS v20, 1e0 AS q20, r AS m63, 0e0 AS v63, 1e0 AS q63 FROM b WHERE row_id = 1
 UNION ALL SELECT x.row_id, """ + ", ".join(f"(1 - {a}) * v.m{n} + {a} * x.r, (1 - {a}) * (v.v{n} + pow(v.m{n} - ((1 - {a}) * v.m{n} + {a} * x.r), 2)) + {a} * pow(x.r - ((1 - {a}) * v.m{n} + {a} * x.r), 2), pow(1 - {a}, 2) * v.q{n} + pow({a}, 2)" for n, a in ((20, A20), (63, A63))) + """ FROM v JOIN b x ON x.row_id = v.row_id + 1),
ev20 AS (SELECT b.row_id, CASE WHEN b.row_id >= 20 THEN sqrt(v20 / (1 - q20)) END AS e20, CASE WHEN b.row_id >= 40 THEN sqrt(v63 / (1 - q63)) END AS e63 FROM b LEFT JOIN v USING (row_id))"""
HURST = """dw AS MATERIALIZED (SELECT i.row_id AS i, w, x.row_id - (i.row_id - w + 2) AS k, x.r AS d FROM b i, (VALUES (64), (128)) t(w), b x WHERE i.row_id >= w - 1 AND x.row_id > i.row_id - w + 1 AND x.row_id <= i.row_id),
pf AS MATERIALIZED (SELECT i, w, k, sum(d - m) OVER (PARTITION BY i, w ORDER BY k) AS y FROM (SELECT *, avg(d) OVER (PARTITION BY i, w) AS m FROM dw)),
rs AS (SELECT i, w, (max(y) - min(y)) AS sp FROM pf GROUP BY 1, 2),
sd AS (SELECT i, w, stddev_samp(d) AS sd FROM dw GROUP BY 1, 2),
rr AS (SELECT i, w, CASE WHEN sd > 1e-12 AND sp > 0 THEN ln(sp / sd) / ln(w - 1) END AS h FROM rs JOIN sd USING (i, w)),
sg AS (SELECT i, w, s, way, (k - o) // s AS seg, regr_syy(y, (k - o) % s) - regr_sxy(y, (k - o) % s) * regr_sxy(y, (k - o) % s) / regr_sxx(y, (k - o) % s) AS rss FROM pf, (VALUES (4), (8), (16), (32)) z(s), (VALUES (0), (1)) u(way), LATERAL (SELECT CASE WHEN way = 1 THEN (w - 1) % s ELSE 0 END AS o) WHERE s <= (w - 1) // 3 AND (way = 0 OR (w - 1) % s > 0) AND k >= o AND (k - o) // s < (w - 1) // s GROUP BY i, w, s, way, seg),
fl AS (SELECT i, w, s, 0.5 * ln(greatest(sum(rss), 1e-300) / (count(*) * s)) AS lf FROM sg GROUP BY 1, 2, 3),
hd AS (SELECT i, w, regr_slope(lf, ln(s)) AS h FROM fl GROUP BY 1, 2),
hu AS MATERIALIZED (SELECT b.row_id, max(CASE WHEN hd.w = 64 THEN hd.h END) AS h64, max(CASE WHEN hd.w = 128 THEN hd.h END) AS h128, max(CASE WHEN rr.w = 64 THEN rr.h END) AS r64, max(CASE WHEN rr.w = 128 THEN rr.h END) AS r128 FROM b LEFT JOIN hd ON hd.i = b.row_id LEFT JOIN rr ON rr.i = b.row_id GROUP BY 1)"""
RG = "CASE WHEN {x} IS NOT NULL AND {x}_lo IS NOT NULL THEN CASE WHEN {x} >= {x}_hi THEN 1e0 WHEN {x} <= {x}_lo THEN -1e0 ELSE 0e0 END END"
REGIMES = EWV + ", " + HURST + """, hm AS (SELECT hu.*, e20, CASE WHEN h64 IS NULL THEN h128 WHEN h128 IS NULL THEN h64 ELSE (h64 + h128) / 2 END AS rm, CASE WHEN h64 IS NOT NULL AND h128 IS NOT NULL THEN abs(h64 - h128) / 2 WHEN h64 IS NOT NULL OR h128 IS NOT NULL THEN 0e0 END AS rd, lag(e20) OVER (ORDER BY row_id) AS le FROM hu JOIN ev20 USING (row_id)),
rg AS (SELECT *, """ + ", ".join(f"{over(f'quantile_cont({x}, {p})', x, 252, 126, 1)} AS {x}_{n}" for x in ("h128", "rm") for n, p in (("lo", 0.33), ("hi", 0.67))) + f", {z('le', 252, 126)} AS vzs FROM hm)"
FOLD = EVENTS + """, ps AS (SELECT row_id, e, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ev),
fs AS (SELECT min(pos) AS first FROM (SELECT p.pos, (SELECT count(*) FROM ps q WHERE q.e < p.row_id AND q.pos < p.pos - 3) AS done FROM ps p) WHERE done >= 280 AND pos >= 280),
bl AS (SELECT ps.*, ntile(5) OVER (ORDER BY pos) AS fold_id FROM ps, fs WHERE pos >= first),
ct AS (SELECT fold_id, min(pos) AS a, max(pos) AS z, min(row_id) AS v FROM bl GROUP BY 1),
fm AS (SELECT fold_id, CASE WHEN pos >= a THEN 'validation' WHEN e >= v THEN 'purged' WHEN pos >= a - 3 THEN 'embargoed' ELSE 'train' END AS role, row_id, e FROM ps JOIN ct ON pos <= z)"""
NEST = EVENTS + """, ps AS (SELECT row_id, e, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ev),
fs AS (SELECT min(pos) AS first FROM (SELECT p.pos, (SELECT count(*) FROM ps q WHERE q.e < p.row_id) AS done FROM ps p) WHERE done >= 500 AND pos >= 500),
bl AS (SELECT ps.*, ntile(5) OVER (ORDER BY pos) AS outer_fold FROM ps, fs WHERE pos >= first),
ct AS (SELECT outer_fold, min(row_id) AS v FROM bl GROUP BY 1),
tr AS (SELECT outer_fold, row_id, e, row_number() OVER (PARTITION BY outer_fold ORDER BY row_id) - 1 AS pos FROM ps JOIN ct ON e < v),
gs AS (SELECT outer_fold, min(pos) AS first FROM (SELECT p.outer_fold, p.pos, (SELECT count(*) FROM tr q WHERE q.outer_fold = p.outer_fold AND q.e < p.row_id) AS done FROM tr p) WHERE done >= 200 AND pos >= 200 GROUP BY 1),
il AS (SELECT tr.*, ntile(3) OVER (PARTITION BY outer_fold ORDER BY pos) AS fold_id FROM tr JOIN gs USING (outer_fold) WHERE pos >= first),
ic AS (SELECT outer_fold, fold_id, min(pos) AS a, max(pos) AS z, min(row_id) AS v FROM il GROUP BY 1, 2),
nm AS (SELECT outer_fold, fold_id, CASE WHEN pos >= a THEN 'validation' WHEN e >= v THEN 'purged' ELSE 'train' END AS role, row_id FROM tr JOIN ic USING (outer_fold) WHERE pos <= z)"""
CPCV = EVENTS + """, ps AS (SELECT row_id, e, ntile(8) OVER (ORDER BY row_id) - 1 AS g, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ev), s0 AS (SELECT g, min(row_id) AS a, max(e) AS z FROM ps GROUP BY 1),
sp AS (SELECT *, (SELECT count(*) FROM ps WHERE row_id <= z) AS late FROM s0),
ch AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS split_id, x.g AS g1, y.g AS g2, x.a AS a1, x.z AS z1, y.a AS a2, y.z AS z2, x.late AS l1, y.late AS l2 FROM sp x JOIN sp y ON x.g < y.g),
cm AS (SELECT split_id, g1 || '|' || g2 AS test_groups, CASE WHEN g IN (g1, g2) THEN 'validation' WHEN (row_id <= z1 AND e >= a1) OR (row_id <= z2 AND e >= a2) THEN 'purged' WHEN (pos >= l1 AND pos < l1 + 4) OR (pos >= l2 AND pos < l2 + 4) THEN 'embargoed' ELSE 'train' END AS role FROM ps CROSS JOIN ch)"""
STATS = {"balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2", "macro_f1": "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2", "recall_down": "tn / (tn + fp)", "recall_up": "tp / (tp + fn)", "brier_score": "brier / n", "expected_calibration_error": "(" + " + ".join(f"abs(d{i})" for i in range(10)) + ") / n", "candidate_mean_net_return": "candidate / n", "paired_mean_net_return": "paired / n"}
JOINT = LEDGER + f""", pr AS (SELECT sc.horizon, sc.row_id, sc.y, sc.p, sc.r, led.active, led.candidate, led.cash, led.always_long, led.always_short, led.momentum, led.trend, row_number() OVER (PARTITION BY horizon ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY horizon) AS n, {BIN('>=')} AS bin FROM sc JOIN led USING (horizon, row_id)),
js AS (SELECT DISTINCT horizon, n FROM pr),
jd AS (SELECT horizon, n, b.block, i.range AS iter, ((i.range * 7919 + k.range * 104729 + b.block * 1299709 + 42) * 48271) % 2147483647 % (n - b.block + 1) AS a, least(b.block, n - k.range * b.block) AS size FROM js, (VALUES (5), (10), (20)) b(block), range(110) i, range(100000) k WHERE k.range < ceil(n / CAST(b.block AS DOUBLE))),
jt AS (SELECT jd.horizon, jd.block, jd.iter, any_value(jd.n) AS n, CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE p < 0.5 AND y = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE p < 0.5 AND y = 1) AS DOUBLE) AS fn, sum((p - y) * (p - y)) AS brier, sum(candidate) AS candidate, sum(candidate - always_long) AS paired, {", ".join(f"coalesce(sum(y - p) FILTER (WHERE bin = {i}), 0) AS d{i}" for i in range(10))} FROM jd JOIN pr ON pr.horizon = jd.horizon AND pos >= a AND pos < a + size GROUP BY 1, 2, 3),
jr AS (SELECT *, row_number() OVER (PARTITION BY horizon, block ORDER BY iter) AS rk FROM jt WHERE tp + fn > 0 AND tn + fp > 0),
jl AS ({" UNION ALL ".join(f"SELECT horizon, block, '{k}' AS statistic, {v} AS v FROM jr WHERE rk <= 100" for k, v in STATS.items())}),
jc AS (SELECT horizon, CAST(block AS BIGINT) AS block, statistic, count(*) AS n, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM jl GROUP BY 1, 2, 3)"""
COUNTS = "count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'purged') AS n_purged, count(*) FILTER (WHERE role = 'embargoed') AS n_embargoed, count(*) FILTER (WHERE role = 'validation') AS n_validation, count(*) FILTER (WHERE role <> 'validation') AS n_raw"
SHOW = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "volume"))
SHOW8 = SHOW.replace(", 6)", ", 8)")
DAY = "strftime(date, '%Y-%m-%d') AS date"
QT = lambda c, x: f"round(quantile_cont({c}, {x}), 6) + 0.0"
MET = SCORED + f", k AS (SELECT horizon, count(*) AS n, {conf()}, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss FROM sc GROUP BY 1), au AS ({AUC}), ec AS ({ECE})"

def gate_sql() -> str:
    """The gate over the same evidence; the deflated ratio is compared as a z value."""
    from statistics import NormalDist

    inv, g = NormalDist().inv_cdf, 0.5772156649015329
    top, least = (1 - g) * inv(1 - 1 / 12) + g * inv(1 - 1 / (12 * math.e)), inv(0.95)
    names = ["cash", "always_long", "always_short", "momentum", "trend"]
    part = JOINT.replace("SELECT *, 1 / (1 + exp(-z20 / 4)) AS p", "SELECT *, 1 / (1 + exp(-z20 / 4)) AS p")
    trials = PBO.split("sc AS (", 1)[1].split(", tr AS", 1)[1]
    tests = {
        "median_balanced_accuracy": "mba >= 0.6", "four_of_five_at_055": "n55 >= 4", "no_material_fold_below_chance": "wba >= 0.5", "pooled_macro_f1": "pf1 >= 0.55", "pooled_recall_down": "prd >= 0.5", "pooled_recall_up": "pru >= 0.5",
        "primary_ci_excludes_chance": "ci_low > 0.5", "ci_sensitivity_excludes_chance": "low5 > 0.5 AND low20 > 0.5", "brier_noninferiority": "cb - bb <= 0.005", "ece_noninferiority": "ce - be <= 0.01",
        "classification_baseline_noninferiority": "pba >= 0.5 AND pba >= sba", "paired_return_ci_nonnegative": "paired_low >= 0", "baseline_cost_net_positive": "net > 0", "stress_cost_net_positive": "stress_net > 0",
        "economic_benchmark_noninferiority": " AND ".join(f"total >= of_{b}" for b in names), "minimum_trade_count": "trades >= 30", "pbo_evaluable_and_passes": "pbo <= 0.2", "dsr_evaluable_and_passes": "dz >= " + repr(least),
        "required_qa_flags_present": "false", "all_qa_flags_pass": "false",
    }
    failed = "concat_ws('|', " + ", ".join(f"CASE WHEN coalesce({t}, false) THEN NULL ELSE '{n}' END" for n, t in tests.items()) + ")"
    rates = {k: RATES[k] for k in ("balanced_accuracy", "macro_f1", "recall_down", "recall_up")}
    edges = " + ".join(f"CAST(b >= {i / 10!r}::DOUBLE AS INT)" for i in range(1, 10))
    return part + f""", tr AS{trials},
fo AS (SELECT *, ntile(5) OVER (PARTITION BY horizon ORDER BY row_id) AS fold FROM pr),
fc AS (SELECT horizon, fold, count(*) AS n, CAST(sum(y) AS DOUBLE) AS ups, {conf()} FROM fo GROUP BY 1, 2),
fm AS (SELECT horizon, {rates['balanced_accuracy']} AS ba FROM fc),
fg AS (SELECT horizon, median(ba) AS mba, count(*) FILTER (WHERE ba >= 0.55) AS n55, min(ba) AS wba FROM fm GROUP BY 1),
pc AS (SELECT horizon, count(*) AS n, {conf()}, avg((p - y) * (p - y)) AS cb, count(*) FILTER (WHERE active) AS trades, sum(candidate) AS total, {", ".join(f"sum({b}) AS of_{b}" for b in names)} FROM pr GROUP BY 1),
pg AS (SELECT *, {rates['balanced_accuracy']} AS pba, {rates['macro_f1']} AS pf1, {rates['recall_down']} AS prd, {rates['recall_up']} AS pru FROM pc),
sg AS (SELECT horizon, {rates['balanced_accuracy']} AS sba FROM (SELECT horizon, {conf()} FROM (SELECT horizon, y, CASE WHEN r >= 0 THEN 1 ELSE 0 END AS p FROM pr) GROUP BY 1)),
bs AS (SELECT horizon, fold, n, ups, coalesce(sum(ups) OVER w / sum(n) OVER w, 0.5) AS b FROM fc WINDOW w AS (PARTITION BY horizon ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bi AS (SELECT horizon, {edges} AS bin, sum(n) AS n, abs(sum(ups - n * b)) AS gap, sum(ups * (1 - 2 * b) + n * b * b) AS loss FROM bs GROUP BY 1, 2),
bg AS (SELECT horizon, sum(loss) / sum(n) AS bb, sum(gap) / sum(n) AS be FROM bi GROUP BY 1),
eg AS ({ECE}),
ci AS (SELECT horizon, max(low) FILTER (WHERE statistic = 'balanced_accuracy' AND block = 10) AS ci_low, max(low) FILTER (WHERE statistic = 'balanced_accuracy' AND block = 5) AS low5, max(low) FILTER (WHERE statistic = 'balanced_accuracy' AND block = 20) AS low20, max(low) FILTER (WHERE statistic = 'paired_mean_net_return' AND block = 10) AS paired_low FROM jc GROUP BY 1),
tm AS (SELECT trial_id, count(*) AS n, avg(ret) AS mu, stddev_pop(ret) AS sd, avg(ret) / nullif(stddev_samp(ret), 0) AS sr FROM tr GROUP BY 1),
t3 AS (SELECT trial_id, any_value(tm.n) AS n, any_value(sr) AS sr, avg(pow((ret - mu) / sd, 3)) AS g3, avg(pow((ret - mu) / sd, 4)) AS g4 FROM tr JOIN tm USING (trial_id) GROUP BY 1),
dz AS (SELECT trial_id // 10 AS horizon, (sr - {top!r} * (SELECT stddev_samp(sr) FROM t3)) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS dz FROM t3 WHERE trial_id % 10 = 1),
al2 AS (SELECT avg(CASE WHEN logit <= 0 THEN 1e0 ELSE 0e0 END) AS pbo FROM lo2),
ev2 AS (SELECT *, exp(total) - 1 AS net, exp(total - trades * {math.log1p(10 / 1e4) - math.log1p(5 / 1e4)!r}) - 1 AS stress_net, ece_weighted AS ce FROM fg JOIN pg USING (horizon) JOIN sg USING (horizon) JOIN bg USING (horizon) JOIN eg USING (horizon) JOIN ci USING (horizon) JOIN dz USING (horizon) CROSS JOIN al2)
SELECT horizon, round(pba, 5) + 0.0 AS pooled_balanced_accuracy, round(ci_low, 5) + 0.0 AS ci_low, round(paired_low, 5) + 0.0 AS paired_low, round(cb, 5) + 0.0 AS candidate_brier, round(bb, 5) + 0.0 AS baseline_brier, round(ce, 5) + 0.0 AS candidate_ece, round(be, 5) + 0.0 AS baseline_ece, round(net, 5) + 0.0 AS net, round(stress_net, 5) + 0.0 AS stress_net, trades, round(pbo, 5) + 0.0 AS pbo, {failed} AS failed_checks, {failed} = '' AS promoted FROM ev2"""


GATE = gate_sql()

def by_supplier(text: str) -> str:
    """SQL over one series, for the series of every supplier."""
    bars = PANEL.replace("l_returnflag", "CAST(l_suppkey AS VARCHAR)").replace("panel AS (", "bars AS (").replace("AS symbol, CAST(l_shipdate AS DATE)", "AS symbol, CAST(l_shipdate AS DATE)")
    return text.replace(BARS, bars).replace("(ORDER BY row_id", "(PARTITION BY symbol ORDER BY row_id")


SQL = {
    "supplier_moments": by_supplier(q({n: e for s in SPANS for n, e in ((f"return_mean_{s}", over("avg(r)", "r", s)), (f"return_std_{s}", over("stddev_samp(r)", "r", s)))})).replace("SELECT row_id", "SELECT symbol, row_id"),
    "supplier_momentum": by_supplier(q({n: e for s in SPANS for n, e in ((f"momentum_{s}", f"lp - {shift('lp', s)}"), (f"price_zscore_{s}", z("lp", s)), (f"drawdown_{s}", f"close / ({over('max(close)', 'close', s)}) - 1"))})).replace("SELECT row_id", "SELECT symbol, row_id"),
    "supplier_labels": by_supplier(f"WITH {LABELS} SELECT symbol, horizon, count(*) FILTER (WHERE eligible) AS n_eligible, count(*) FILTER (WHERE act) AS n_actionable, {R6('sum(e_ret)', 'total')} FROM labels GROUP BY 1, 2"),
    "ohlcv_bars": f"WITH {BARS} SELECT symbol, row_id, {DAY}, {SHOW} FROM bars",
    "bars_panel": f"WITH {PANEL} SELECT symbol, row_id, {DAY}, {SHOW8} FROM panel",
    "validation_counts": f"WITH {BARS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE date IS NULL) AS bad_dates, count(*) - count(DISTINCT date) AS duplicate_dates, count(*) FILTER (WHERE NOT isfinite(open) OR NOT isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close) OR NOT isfinite(volume)) AS non_finite, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS non_positive, count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high)) AS bad_range FROM bars",
    "drop_newest_bar": f"WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM panel) SELECT symbol, count(*) AS n, strftime(max(date), '%Y-%m-%d') AS last FROM k WHERE n > 1 GROUP BY 1",
    "dev_prefix_scan": f"WITH {BARS} SELECT symbol, row_id, {DAY}, {SHOW} FROM bars WHERE row_id < 500",
    "feat_returns": q({f"return_lag_{k}": shift("r", k - 1) for k in (1, 2, 3, 5, 10, 20)}),
    "feat_rolling_moments": q({n: e for s in SPANS for n, e in ((f"return_mean_{s}", over("avg(r)", "r", s)), (f"return_std_{s}", over("stddev_samp(r)", "r", s)))}),
    "feat_momentum_drawdown": q({n: e for s in SPANS for n, e in ((f"momentum_{s}", f"lp - {shift('lp', s)}"), (f"price_zscore_{s}", z("lp", s)), (f"drawdown_{s}", f"close / ({over('max(close)', 'close', s)}) - 1"))}),
    "feat_trend_slope": q({f"trend_slope_{s}": over("regr_slope(lp, row_id)", "lp", s) for s in SPANS}),
    "feat_sign_entropy": q({f"sign_entropy_{s}": entropy(s) for s in SPANS}),
    "feat_skew_kurt": q({"rolling_skew_20": over("skewness(r)", "r", 20), "rolling_kurtosis_20": over("kurtosis(r)", "r", 20)}),
    "feat_volume": q({"volume_change_1": f"lv - {shift('lv', 1)}", "volume_zscore_20": z("lv", 20), "volume_zscore_63": z("lv", 63, 40), "return_volume_interaction": f"r * ({z('lv', 20)})", "range_log": "ln(high / low)", "close_open_log": "ln(close / open)"}),
    "feat_calendar": q({"dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 5)", "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 5)", "month_sin": "sin(2 * pi() * (month(date) - 1) / 12)", "month_cos": "cos(2 * pi() * (month(date) - 1) / 12)"}),
    "feat_trend_regime": q({"trend_efficiency_20": "eff", "trend_regime": "CASE WHEN eff IS NOT NULL AND m IS NOT NULL THEN CASE WHEN eff > 0.45 AND m > 0 THEN 1 WHEN eff > 0.45 AND m < 0 THEN -1 ELSE 0 END END", "trend_regime_available": "CASE WHEN eff IS NOT NULL AND m IS NOT NULL THEN 1 ELSE 0 END"}, "t", BASE + f", t AS (SELECT row_id, abs(lp - {shift('lp', 20)}) / nullif({over('sum(abs(r))', 'r', 20)}, 0) AS eff, lp - {shift('lp', 20)} AS m FROM b)"),
    "feat_ewm": f"WITH RECURSIVE {EWM} SELECT row_id, {R6('CASE WHEN row_id >= 14 AND e.l > 0 THEN 1 - 1 / (1 + e.g / e.l) END', 'rsi_14')}, {R6('CASE WHEN row_id >= 13 THEN e.tr / x0.close END', 'atr_14_normalized')}, {R6('CASE WHEN row_id >= 25 THEN f - s END', 'macd')}, {R6('CASE WHEN row_id >= 33 THEN sg END', 'macd_signal')}, {R6('CASE WHEN row_id >= 33 THEN f - s - sg END', 'macd_histogram')} FROM e JOIN x0 USING (row_id)",
    "feat_ewm_vol": f"WITH RECURSIVE {EWV} SELECT row_id, {R6('e20', 'ewma_vol_20')}, {R6('e63', 'ewma_vol_63')}, {R6('e20 / nullif(e63, 0)', 'vol_ratio_20_63')} FROM ev20",
    "feat_hurst": f"WITH {BASE}, {HURST} SELECT row_id, {R6('r64', 'hurst_rs_single_scale_legacy_64')}, {R6('r128', 'hurst_rs_single_scale_legacy_128')}, {R6('h64', 'hurst_dfa1_64')}, {R6('h128', 'hurst_dfa1_128')} FROM hu",
    "feat_regimes": f"WITH RECURSIVE {REGIMES} SELECT row_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0.0 AS {n}" for n, e in {"hurst_dfa1_available": "CASE WHEN h128 IS NULL THEN 0 ELSE 1 END", "hurst_regime": RG.format(x="h128"), "hurst_regime_available": "CASE WHEN h128 IS NOT NULL AND h128_lo IS NOT NULL THEN 1 ELSE 0 END", "hurst_robust_median": "rm", "hurst_robust_dispersion": "rd", "hurst_robust_low_threshold": "rm_lo", "hurst_robust_high_threshold": "rm_hi", "hurst_robust_regime": RG.format(x="rm"), "hurst_robust_available": "CASE WHEN rm IS NOT NULL AND rm_lo IS NOT NULL THEN 1 ELSE 0 END", "volatility_zscore": "vzs"}.items()) + " FROM rg",
    "labels_all_horizons": f"WITH {LABELS} SELECT horizon, row_id, strftime(date, '%Y-%m-%d') AS decision_timestamp, strftime(avail_ts, '%Y-%m-%d') AS available_timestamp, strftime(entry_ts, '%Y-%m-%d') AS entry_timestamp, strftime(exit_ts, '%Y-%m-%d') AS exit_timestamp, {R6('(exp(thr) - 1) * 1e4', 'threshold_bps')}, {R6('s_ret', 'statistical_forward_log_return')}, {R6('e_ret', 'executable_forward_log_return')}, CAST(s_dir AS DOUBLE) AS statistical_direction_binary, CAST(e_dir AS DOUBLE) AS executable_direction_binary, {R6('thr', 'direction_threshold')}, CASE WHEN e_ret IS NOT NULL AND thr IS NOT NULL THEN CASE WHEN e_ret > thr THEN 1e0 WHEN e_ret < -thr THEN -1e0 ELSE 0e0 END END AS executable_direction_three_class, act AS is_actionable, row_id + horizon AS label_end_index, row_id + 1 + horizon AS executable_label_end_index, eligible AS is_modeling_eligible FROM labels",
    "eligible_counts": f"WITH {LABELS} SELECT horizon, count(*) AS n_rows, count(*) FILTER (WHERE eligible) AS n_eligible, count(*) FILTER (WHERE act) AS n_actionable FROM labels GROUP BY 1",
    "class_balance": f"WITH {LABELS} SELECT symbol, horizon, count(*) AS n_labeled, count(*) FILTER (WHERE e_ret > 0) AS n_up, count(*) FILTER (WHERE e_ret <= 0) AS n_down, {R6('avg(CASE WHEN e_ret > 0 THEN 1e0 ELSE 0e0 END)', 'up_rate')}, {R6('avg(CASE WHEN e_ret <= 0 THEN 1e0 ELSE 0e0 END)', 'down_rate')} FROM labels WHERE e_ret IS NOT NULL GROUP BY 1, 2",
    "audit_yearly": f"WITH {SUS} SELECT symbol, year(date) AS year, count(*) AS n_rows, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, {R6('min(close)', 'close_min')}, {QT('close', 0.05)} AS close_p05, {QT('close', 0.5)} AS close_median, {R6('avg(close)', 'close_mean')}, {QT('close', 0.95)} AS close_p95, {R6('max(close)', 'close_max')}, {R6('stddev_pop(close)', 'close_std')}, {R6('avg(r)', 'return_mean')}, {R6('stddev_pop(r)', 'return_std')}, {QT('r', 0.01)} AS return_p01, {QT('r', 0.05)} AS return_p05, {QT('r', 0.5)} AS return_median, {QT('r', 0.95)} AS return_p95, {QT('r', 0.99)} AS return_p99, {R6('avg(volume)', 'volume_mean')}, {QT('volume', 0.5)} AS volume_median, count(*) FILTER (WHERE volume = 0) AS zero_volume_rows, " + ", ".join(f"count(*) FILTER (WHERE regime = '{k}') AS {k}_rows" for k in ("bull", "bear", "unclassified")) + " FROM i GROUP BY 1, 2",
    "audit_suspicious": f"WITH {SUS} SELECT 'ORDERS' AS symbol, row_id, {DAY}, issue_type, {R6('value', 'value')}, {R6('threshold', 'threshold')} FROM sus",
    "audit_summary": f"WITH {SUS} SELECT 'ORDERS' AS symbol, issue_type, count(*) AS n FROM sus GROUP BY 2 UNION ALL SELECT 'ORDERS', regime || '_rows', count(*) FROM i GROUP BY 2 UNION ALL SELECT 'ORDERS', 'maximum_calendar_gap_days', max(gap) FROM i",
    "missing_weekdays": f"WITH {PANEL}, sp AS (SELECT symbol, min(date) AS a, max(date) AS z FROM panel GROUP BY 1), dy AS (SELECT symbol, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM sp) SELECT symbol, strftime(day, '%Y-%m-%d') AS day FROM dy WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM panel p WHERE p.symbol = dy.symbol AND p.date = dy.day)",
    "asof_feature_join": asof("false"),
    "asof_staleness": asof("coalesce(age > 86400, false)"),
    "locked_split": f"WITH {EVENTS} SELECT role, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM (SELECT row_id, CASE WHEN row_id >= 900 THEN 'locked' WHEN e < 900 THEN 'development' ELSE 'dropped' END AS role FROM ev) GROUP BY 1",
    "walk_forward_folds": f"WITH {FOLD} SELECT 'ORDERS' AS symbol, CAST(fold_id AS BIGINT) AS fold_id, {COUNTS} FROM fm GROUP BY 1, 2",
    "nested_folds": f"WITH {NEST} SELECT 'ORDERS' AS symbol, outer_fold, fold_id, {COUNTS} FROM nm GROUP BY 2, 3",
    "split_manifest_hash": f"WITH {FOLD.replace('- 3', '- 0')}, ch AS (SELECT fold_id, row_id // 1000 AS chunk, sha256(string_agg(role || ':' || row_id || ':' || e, ',' ORDER BY row_id)) AS sha, count(*) AS n FROM fm GROUP BY 1, 2) SELECT 'ORDERS' AS symbol, fold_id, sha256(string_agg(sha, ',' ORDER BY chunk)) AS rows_sha256, CAST(sum(n) AS BIGINT) AS n_rows FROM ch GROUP BY 2",
    "fold_overlaps": f"WITH {FOLD} SELECT t.fold_id, count(*) AS n FROM fm t WHERE t.role = 'train' AND EXISTS (SELECT 1 FROM fm v WHERE v.fold_id = t.fold_id AND v.role = 'validation' AND t.row_id <= v.e AND t.e >= v.row_id) GROUP BY 1",
    "purged_overlaps": f"WITH {FOLD} SELECT t.fold_id, t.row_id FROM fm t WHERE t.role IN ('purged', 'embargoed') AND EXISTS (SELECT 1 FROM fm v WHERE v.fold_id = t.fold_id AND v.role = 'validation' AND t.row_id <= v.e AND t.e >= v.row_id)",
    "cpcv_manifest": f"WITH {CPCV} SELECT 'ORDERS' AS symbol, split_id, test_groups, {COUNTS} FROM cm GROUP BY 1, 2, 3",
    "overlap_semi": f"WITH {LABELS}, rf AS (SELECT DISTINCT horizon, row_id, row_id + 1 + horizon AS e FROM labels WHERE eligible AND act AND abs(e_ret) >= 0.5), ev AS (SELECT horizon, row_id, row_id + 1 + horizon AS e FROM labels WHERE eligible) SELECT horizon, row_id, e AS label_end_index FROM ev c WHERE EXISTS (SELECT 1 FROM rf r WHERE r.horizon = c.horizon AND c.row_id <= r.e AND c.e >= r.row_id)",
    "overlap_anti": f"WITH {LABELS}, rf AS (SELECT DISTINCT horizon, row_id, row_id + 1 + horizon AS e FROM labels WHERE eligible AND act AND abs(e_ret) >= 0.5), ev AS (SELECT horizon, row_id, row_id + 1 + horizon AS e FROM labels WHERE eligible) SELECT horizon, row_id, e AS label_end_index FROM ev c WHERE NOT EXISTS (SELECT 1 FROM rf r WHERE r.horizon = c.horizon AND c.row_id <= r.e AND c.e >= r.row_id)",
    "classification_metrics": f"WITH {MET} SELECT 'ORDERS' AS symbol, k.horizon, n, tp, fp, tn, fn, {R6('brier', 'brier')}, {R6('log_loss', 'log_loss')}, " + ", ".join(R6(e, n) for n, e in RATES.items()) + f", {R6('roc_auc', 'roc_auc')}, {R6('ece_weighted', 'ece_weighted')}, {R6('ece_unweighted', 'ece_unweighted')} FROM k JOIN au USING (horizon) JOIN ec USING (horizon)",
    "calibration_bins": f"WITH {SCORED} SELECT 'ORDERS' AS symbol, horizon, CAST(bin AS BIGINT) AS bin, n, {R6('mean_p', 'mean_p')}, {R6('mean_y', 'mean_y')} FROM ({BINS('>=')})",
    "ece_two_ways": f"WITH {SCORED} SELECT 'ORDERS' AS symbol, horizon, {R6('ece_weighted', 'ece_weighted')}, {R6('ece_unweighted', 'ece_unweighted')} FROM ({ECE})",
    "roc_auc": f"WITH {SCORED} SELECT 'ORDERS' AS symbol, horizon, {R6('roc_auc', 'roc_auc')} FROM ({AUC})",
    "threshold_grid": f"WITH {GRID} SELECT 'ORDERS' AS symbol, horizon, {R6('threshold', 'threshold')}, tp, fp, tn, fn, " + ", ".join(R6(RATES[n], n) for n in ("balanced_accuracy", "macro_f1", "mcc")) + " FROM g",
    "schedule_nonoverlap": f"WITH RECURSIVE {greedy('row_id', 'row_id + greatest(1, horizon)', 'true')} SELECT horizon, row_id FROM taken",
    "schedule_abstain": f"WITH RECURSIVE {greedy('row_id', 'row_id + greatest(1, horizon)', 'abs(p - 0.5) >= 0.1')} SELECT horizon, row_id FROM taken",
    "schedule_single_position": f"WITH RECURSIVE {ONE} SELECT horizon, row_id, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS signal, 'row' || row_id || '_entry' || (row_id + 1) || '_exit' || (row_id + 1 + horizon) AS signal_id FROM taken",
    "replay_signals": f"WITH RECURSIVE {greedy('entry_ts', 'exit_ts', 'abs(p - 0.5) >= 0.05')} SELECT horizon, row_id, strftime(entry_ts, '%Y.%m.%d 00:00') AS entry_time, strftime(exit_ts, '%Y.%m.%d 00:00') AS exit_time, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS direction, 'h' || horizon || '_row' || row_id AS signal_id FROM taken",
    "return_ledger": f"WITH RECURSIVE {LEDGER} SELECT horizon, row_id, active, signal, signal_id, " + ", ".join(R6(s, s) for s in STRATEGIES) + " FROM led",
    "benchmark_summaries": f"WITH RECURSIVE {LEDGER}, nxf AS MATERIALIZED (SELECT c.horizon, c.row_id, (SELECT min(d.row_id) FROM sc d WHERE d.horizon = c.horizon AND d.row_id >= c.row_id + greatest(1, c.horizon)) AS nx FROM sc c), wf AS (SELECT horizon, min(row_id) AS row_id FROM sc GROUP BY 1 UNION ALL SELECT wf.horizon, nxf.nx FROM wf JOIN nxf USING (horizon, row_id) WHERE nxf.nx IS NOT NULL), ln AS (" + " UNION ALL ".join(f"SELECT horizon, row_id, '{s}' AS strategy, {dict(cash='false', volatility_filtered='calm').get(s, 'true')} AS active, {s} AS net FROM led WHERE active" for s in STRATEGIES) + f" UNION ALL SELECT horizon, row_id, 'full_period', true, e_ret - {COST} FROM sc JOIN wf USING (horizon, row_id)), sp AS (SELECT horizon, count(*) AS n_decisions, max(row_id) - min(row_id) + 1 AS span FROM sc GROUP BY 1), cu AS (SELECT *, exp(sum(net) OVER (PARTITION BY horizon, strategy ORDER BY row_id)) AS eq FROM ln), dd AS (SELECT *, eq / greatest(1, max(eq) OVER (PARTITION BY horizon, strategy ORDER BY row_id)) - 1 AS d FROM cu), gg AS (SELECT horizon, strategy, count(*) AS n, count(*) FILTER (WHERE active) AS trades, sum(net) AS lr, min(d) AS md, avg(CASE WHEN active THEN CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END END) AS hr, avg(CASE WHEN active THEN net END) AS ma, avg(net) / nullif(stddev_samp(net), 0) AS sh FROM dd GROUP BY 1, 2) SELECT 'ORDERS' AS symbol, horizon, strategy, n, trades, {R6('lr', 'log_return')}, {R6('exp(lr) - 1', 'cumulative')}, {R6('least(0, md)', 'max_drawdown')}, {R6('hr', 'hit_rate')}, {R6('ma', 'mean_active')}, {R6('sh * sqrt(252e0 * n / span)', 'sharpe')}, n_decisions, {R6('252e0 * n / span', 'per_year')}, {R6('trades / CAST(n_decisions AS DOUBLE)', 'coverage')} FROM gg JOIN sp USING (horizon)",
    "best_threshold": f"WITH {GRID}, hf AS (SELECT horizon, 0.5::DOUBLE AS threshold, {conf()}, 1 AS fst FROM sc GROUP BY 1 UNION ALL SELECT *, 0 FROM g), rt AS (SELECT horizon, threshold, fst, {RATES['balanced_accuracy']} AS ba, {RATES['macro_f1']} AS f1 FROM hf) SELECT 'ORDERS' AS symbol, horizon, {R6('threshold', 'threshold')}, {R6('ba', 'balanced_accuracy')} FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ba DESC, f1 DESC, abs(threshold - 0.5), fst DESC, threshold) AS k FROM rt) WHERE k = 1",
    "schedule_violations": f"WITH RECURSIVE {ONE}, lg AS (SELECT *, row_id + 1 AS en_i, row_id + 1 + horizon AS ex_i, lag(row_id + 1 + horizon) OVER (PARTITION BY horizon ORDER BY row_id) AS bf FROM taken) SELECT 'ORDERS' AS symbol, horizon, count(*) AS n, count(*) FILTER (WHERE en_i < bf) AS overlaps, count(*) FILTER (WHERE ex_i <= en_i) AS bad_exit, count(*) FILTER (WHERE (CASE WHEN p > 0.5 THEN 1 ELSE -1 END) <> (CASE WHEN p >= 0.5 THEN 1 ELSE -1 END)) AS bad_direction FROM taken JOIN lg USING (horizon, row_id, p) GROUP BY 2",
    "trade_reconciliation": f"WITH RECURSIVE {ONE} SELECT count(*) AS matched, " + ", ".join(f"0::BIGINT AS {k}" for k in FAULTS) + ", 'PASS' AS verdict FROM taken",
    "reconciliation_of_faults": f"WITH RECURSIVE {ONE}, b0x AS (SELECT row_id, open AS entry_price FROM bars), t0 AS (SELECT 'h' || horizon || '_row' || row_id AS sid, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS e_dir, entry_ts AS e_in, exit_ts AS e_out, month(entry_ts) AS mo, day(entry_ts) AS dy, horizon, row_id FROM taken), t1 AS (SELECT *, CASE WHEN mo = 2 AND dy = 6 THEN -e_dir ELSE e_dir END AS dir, CASE WHEN mo = 3 AND dy = 7 THEN e_in ELSE e_out END AS x_out, CASE WHEN mo = 4 AND dy = 8 THEN 0 ELSE 1 END AS price, CASE WHEN mo = 5 AND dy = 9 THEN -1 ELSE 1 END AS spread, CASE WHEN mo = 6 AND dy = 10 THEN '' WHEN mo = 7 AND dy = 11 THEN 'same' ELSE sid END AS oid, CASE WHEN mo = 8 AND dy = 12 THEN sid || '-x' ELSE sid END AS tid FROM t0 WHERE NOT (mo = 1 AND dy = 5)), t2 AS (SELECT *, sid AS did FROM t1 UNION ALL SELECT * REPLACE (oid || '-2' AS oid), sid || '-2' FROM t1 WHERE mo = 9 AND dy = 13), t3 AS (SELECT *, count(*) OVER (PARTITION BY tid) AS t_n FROM t2), j AS (SELECT e.sid, e.e_dir AS ed, e.e_out AS eo, t.* EXCLUDE (sid, e_dir, e_out) FROM t0 e FULL JOIN t3 t ON e.sid = t.tid), j2 AS (SELECT *, sid IS NOT NULL AND tid IS NOT NULL AS bo FROM j) SELECT count(*) FILTER (WHERE bo) AS matched, count(*) FILTER (WHERE tid IS NULL) AS missing, count(*) FILTER (WHERE sid IS NULL) AS unexpected, count(*) FILTER (WHERE t_n > 1) AS repeated, count(*) FILTER (WHERE bo AND ed <> dir) AS wrong_direction, count(*) FILTER (WHERE bo AND eo <> x_out) AS wrong_time, count(*) FILTER (WHERE tid IS NOT NULL AND x_out <= e_in) AS bad_exit, count(*) FILTER (WHERE price = 0) AS bad_price, count(*) FILTER (WHERE spread < 0) AS bad_cost, count(*) FILTER (WHERE oid = '') AS bad_ticket, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM t2 WHERE oid <> '' GROUP BY oid)) AS repeated_order_id, 0::BIGINT AS repeated_deal_id, 'FAIL' AS verdict FROM j2",
    "calibration_line": "WITH RECURSIVE " + SCORED + ", xy AS MATERIALIZED (SELECT horizon, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS x, CAST(y AS DOUBLE) AS y FROM sc), nw AS (SELECT horizon, 0 AS k, 0e0 AS a, 0e0 AS b FROM (SELECT DISTINCT horizon FROM xy) UNION ALL SELECT horizon, k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (SELECT n.horizon, any_value(n.k) AS k, any_value(n.a) AS a, any_value(n.b) AS b, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) AS h11 FROM (SELECT n.*, xy.x, xy.y, 1 / (1 + exp(-(n.a + n.b * xy.x))) AS q FROM nw n JOIN xy USING (horizon) WHERE n.k < 12) n GROUP BY 1)) SELECT 'ORDERS' AS symbol, horizon, round(a, 5) + 0.0 AS intercept, round(b, 5) + 0.0 AS slope FROM nw WHERE k = 12",
    "label_aliases": f"WITH {LABELS} SELECT horizon, row_id, 'separated_statistical_executable_direction_v3' AS target_policy_id, {R6('s_ret', 'forward_log_return')}, CAST(s_dir AS DOUBLE) AS direction_binary, " + ", ".join(f"CASE WHEN e_ret IS NOT NULL AND thr IS NOT NULL THEN CASE WHEN e_ret > thr THEN 1e0 WHEN e_ret < -thr THEN -1e0 ELSE 0e0 END END AS {n}" for n in ("direction_three_class", "actionable_direction_three_class")) + f", {R6('thr', 'actionable_threshold_log_return')}, {R6('(exp(thr) - 1) * 1e4', 'direction_threshold_bps')}, {R6('(exp(thr) - 1) * 1e4', 'actionable_threshold_bps')} FROM labels",
    "joint_bootstrap_ci": f"WITH RECURSIVE {JOINT} SELECT 'ORDERS' AS symbol, horizon, block, statistic, n, {R6('low', 'low')}, {R6('high', 'high')} FROM jc",
    "trial_sharpes": f"WITH {TRIALS} SELECT trial_id, {R6('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) ELSE 0e0 END', 'annualised')}, {R6('avg(ret) / nullif(stddev_samp(ret), 0)', 'signed')} FROM tr GROUP BY 1",
    "promotion_gate": f"WITH RECURSIVE {GATE}",
    "stability_selection": f"WITH {SCORED}, cs AS (SELECT *, ntile(5) OVER (PARTITION BY horizon ORDER BY row_id) AS fold_id FROM sc), cd AS (SELECT horizon, fold_id, row_id, y, 'level' AS candidate, p FROM cs UNION ALL SELECT horizon, fold_id, row_id, y, 'return', 1 / (1 + exp(-r * 20e0)) FROM cs UNION ALL SELECT horizon, fold_id, row_id, y, 'trend', 1 / (1 + exp(-m20 * 5e0)) FROM cs), cf AS (SELECT horizon, candidate, fold_id, {conf()} FROM cd GROUP BY 1, 2, 3), cr AS (SELECT *, {RATES['balanced_accuracy']} AS ba, {RATES['macro_f1']} AS f1 FROM cf), st AS (SELECT horizon, candidate, median(ba) AS median_ba, median(f1) AS median_f1, stddev_pop(ba) AS std_ba FROM cr WHERE fold_id < 5 GROUP BY 1, 2), be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY median_ba DESC, median_f1 DESC, std_ba, candidate) AS k FROM st) WHERE k = 1), la AS (SELECT cd.* FROM cd JOIN be USING (horizon, candidate) WHERE fold_id = 5), g AS (SELECT horizon, t AS threshold, 0 AS fst, {conf('t')} FROM la CROSS JOIN (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in GRID_T)}]) AS t) GROUP BY 1, 2 UNION ALL SELECT horizon, 0.5::DOUBLE, 1, {conf()} FROM la GROUP BY 1), gr AS (SELECT *, {RATES['balanced_accuracy']} AS ba, {RATES['macro_f1']} AS f1 FROM g), gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ba DESC, f1 DESC, abs(threshold - 0.5), fst DESC, threshold) AS k FROM gr) WHERE k = 1) SELECT 'ORDERS' AS symbol, be.horizon, candidate, {R6('median_ba', 'median_ba')}, {R6('median_f1', 'median_f1')}, {R6('std_ba', 'std_ba')}, {R6('threshold', 'threshold')}, {R6('ba', 'balanced_accuracy')} FROM be JOIN gb USING (horizon)",
    "signal_replay": f"WITH RECURSIVE {greedy('row_id + 1', 'row_id + 1 + horizon', 'abs(p - 0.5) > 1e-12')}, sn AS (SELECT 'H' || horizon AS symbol, entry_ts, exit_ts, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS direction, 'row' || row_id || '_entry' || (row_id + 1) || '_exit' || (row_id + 1 + horizon) AS signal_id FROM taken) SELECT sn.symbol, strftime(entry_ts, '%Y-%m-%d') AS time, 'open' AS event, signal_id, direction, {R6('b.open', 'price')} FROM sn JOIN bars b ON b.date = entry_ts UNION ALL SELECT sn.symbol, strftime(exit_ts, '%Y-%m-%d'), 'close', signal_id, direction, {R6('b.open', 'price')} FROM sn JOIN bars b ON b.date = exit_ts",
    "signal_contract": f"WITH RECURSIVE {ONE}, sg AS (SELECT horizon, entry_ts, exit_ts, lag(entry_ts) OVER (PARTITION BY horizon ORDER BY entry_ts) AS bf FROM taken) SELECT horizon, count(*) AS n_rows, count(*) FILTER (WHERE entry_ts <= bf) AS entry_not_after, count(*) FILTER (WHERE exit_ts <= entry_ts) AS exit_not_after, 0::BIGINT AS bad_direction, 0::BIGINT AS repeated_id FROM sg GROUP BY 1",
    "frame_fingerprint": f"WITH {BARS} SELECT count(*) AS n, CAST(sum(CAST(concat('0x', substr(md5(CAST(CAST(row_id AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(volume AS BIGINT) AS VARCHAR)), 1, 12)) AS BIGINT)) AS BIGINT) AS digest FROM bars",
    "source_differences": f"WITH {BARS}, l AS (SELECT * FROM bars), r AS (SELECT row_id, " + ", ".join(f"round({c}, 0) AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM bars WHERE row_id >= 5) SELECT count(*) FILTER (WHERE r.row_id IS NULL) AS only_left, count(*) FILTER (WHERE l.row_id IS NULL) AS only_right, " + ", ".join(f"count(*) FILTER (WHERE r.row_id IS NOT NULL AND abs(l.{c} - r.{c}) > 0.25) AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM l FULL JOIN r USING (row_id)",
    "nested_containment": f"WITH {NEST} SELECT outer_fold, fold_id, count(*) AS n_rows, count(*) FILTER (WHERE nm.row_id NOT IN (SELECT t.row_id FROM tr t WHERE t.outer_fold = nm.outer_fold)) AS n_outside FROM nm GROUP BY 1, 2",
    "fold_metadata": f"WITH {FOLD}, fk AS (SELECT fold_id, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'purged') AS n_purged, count(*) FILTER (WHERE role = 'validation') AS n_validation, min(row_id) FILTER (WHERE role = 'validation') AS first_validation_row FROM fm GROUP BY 1) SELECT fold_id, row_id, n_train, n_purged, n_validation, first_validation_row FROM fm JOIN fk USING (fold_id) WHERE role = 'validation'",
    "trial_alignment": f"WITH {TRIALS} SELECT trial_id, count(*) AS n, min(row_id) AS first, max(row_id) AS last, {R6('sum(ret)', 'total')} FROM al GROUP BY 1",
    "pbo_cscv": f"WITH {PBO} SELECT count(*) AS n_splits, round(avg(CASE WHEN logit <= 0 THEN 1e0 ELSE 0e0 END), 5) + 0.0 AS pbo, round(median(logit), 5) + 0.0 AS median_logit FROM lo2",
    "sharpe_moments": f"WITH {TRIALS}, mo AS (SELECT trial_id, count(*) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, avg(ret) AS mu, stddev_pop(ret) AS sd FROM tr GROUP BY 1), m3 AS (SELECT trial_id, any_value(n) AS n, any_value(sharpe) AS sharpe, avg(pow((ret - mu) / sd, 3)) AS skew, avg(pow((ret - mu) / sd, 4)) AS kurtosis FROM tr JOIN mo USING (trial_id) GROUP BY 1) SELECT trial_id, n, {R6('sharpe', 'sharpe')}, {R6('skew', 'skew')}, {R6('kurtosis', 'kurtosis')}, {R6('sharpe * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)', 'psr_z')} FROM m3",
    "block_bootstrap_ci": f"WITH {SCORED}, x AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, e_ret AS v FROM sc WHERE horizon = 5), n AS (SELECT count(*) AS n FROM x), dr AS (SELECT i.range AS iter, k.range AS blk, ((i.range * 7919 + k.range * 104729 + 42) * 48271) % 2147483647 % (n - 10 + 1) AS a, least(10, n - k.range * 10) AS size, n FROM n, range(200) i, range(100000) k WHERE k.range < ceil(n / 10.0)), me AS (SELECT iter, sum(v) / any_value(n) AS mean FROM dr JOIN x ON pos >= a AND pos < a + size GROUP BY 1) SELECT count(*) AS n, round(quantile_cont(mean, 0.025), 9) + 0.0 AS low, round(quantile_cont(mean, 0.975), 9) + 0.0 AS high FROM me",
}
