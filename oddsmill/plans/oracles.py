"""DuckDB SQL with the results of the registered queries, written from the operators' definitions."""
from __future__ import annotations

from oddsmill.functions.grid import DISTANCE_EDGES, PRICE_EDGES, RATE_EDGES, TAU_EDGES
from oddsmill.functions.normal import CENTRE, HART, MIDDLE, TAIL
from oddsmill.operators.variance import POISSON


def _poly(coefficients, x: str) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _probit(p: str) -> str:
    q, t = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    r = f"(0.180625::DOUBLE - {q} * {q})"
    mid, far = f"({t} - 1.6::DOUBLE)", f"({t} - 5.0::DOUBLE)"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(CENTRE[0], r)} / {_poly(CENTRE[1], r)} ELSE (CASE WHEN {q} < 0 THEN -1 ELSE 1 END) * CASE WHEN {t} <= 5 THEN {_poly(MIDDLE[0], mid)} / {_poly(MIDDLE[1], mid)} ELSE {_poly(TAIL[0], far)} / {_poly(TAIL[1], far)} END END END"


def _cdf(x: str) -> str:
    """Of |x| under 7."""
    a = f"abs({x})"
    low = f"exp(-{a} * {a} / 2) * {_poly(HART[0][::-1], a)} / {_poly(HART[1][::-1], a)}"
    return f"CASE WHEN {x} > 0 THEN 1 - {low} ELSE {low} END"


def _any_cdf(x: str) -> str:
    """Of any x."""
    a = f"abs({x})"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / sqrt(2 * pi())"
    near = f"exp(-{a} * {a} / 2) * {_poly(HART[0][::-1], a)} / {_poly(HART[1][::-1], a)}"
    low = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({low}) ELSE {low} END)"


def _steps(x: str, edges) -> str:
    return "(" + " + ".join(f"CAST({x} >= {e!r}::DOUBLE AS INTEGER)" for e in edges) + ")"


BUCKET, BAND = _steps("p", PRICE_EDGES[1:-1]), _steps("tau", TAU_EDGES[1:])
PRICE_LABELS = [f"[{a:.2f},{b:.2f})" for a, b in zip(PRICE_EDGES, PRICE_EDGES[1:], strict=False)]
TAU_LABELS = [f"[{a:g},{b:g})d" for a, b in zip(TAU_EDGES, (*TAU_EDGES[1:], float("inf")), strict=True)]
PDF = "exp(-z0 * z0 / 2) / sqrt(2 * pi())"

BASE = f"""
ev AS (SELECT CAST(user_id AS VARCHAR) AS key, user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value,
       least(greatest(round(value / (value + 20.0), 2), 0.01::DOUBLE), 0.99::DOUBLE) AS close FROM events),
daily AS (SELECT key, user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, close FROM ev
          QUALIFY row_number() OVER (PARTITION BY key, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1),
hourly AS (SELECT key, user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, close FROM ev
           QUALIFY row_number() OVER (PARTITION BY key, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1),
cat AS (SELECT key, user_id % 2 AS venue, min(ts) AS t_start, max(ts) AS t_end, user_id % 5 <> 4 AS closed,
        CAST(user_id % 3 = 0 AS DOUBLE) AS final_price, round(sum(value), 4) AS volume FROM ev GROUP BY key, user_id),
mk0 AS (SELECT d.key, CAST(date_diff('day', min(day) OVER w, day) AS DOUBLE) AS ts_days, d.close, c.final_price AS final, count(*) OVER w AS n
        FROM daily d JOIN cat c ON c.key = d.key AND c.closed WINDOW w AS (PARTITION BY d.key)),
mk AS (SELECT key, ts_days, close, final, max(ts_days) OVER (PARTITION BY key) AS t_res FROM mk0 WHERE n >= 5),
raw0 AS (SELECT *, lead(close) OVER w AS nx, lead(ts_days) OVER w AS af FROM mk WINDOW w AS (PARTITION BY key ORDER BY ts_days)),
raw AS (SELECT key, ts_days, close AS p, nx - close AS dp, (nx - close) * (nx - close) AS dp2, af - ts_days AS dt, t_res - ts_days AS tau FROM raw0 WHERE af IS NOT NULL),
mv0 AS (SELECT * REPLACE (greatest(tau, 1.0::DOUBLE) AS tau) FROM raw WHERE p > 0.005 AND p < 0.995 AND dt > 0),
mv1 AS (SELECT *, {_probit("p")} AS z0 FROM mv0),
mv2 AS (SELECT * EXCLUDE z0, p * (1 - p) / tau * dt AS v_binom, pow({PDF}, 2) / tau * dt AS v_gauss, p * (1 - p) * dt AS v_wf FROM mv1),
mv3 AS (SELECT *, dp / sqrt(greatest(v_gauss, 1e-12)) AS z FROM mv2),
mv AS (SELECT *, z * z AS lam, {BUCKET} AS pi, {BAND} AS ti FROM mv3),
bud0 AS (SELECT key, sum(coalesce((nx - close) * (nx - close), 0)) AS rv, pow(max(final) - arg_max(close, ts_days), 2) AS jump, arg_min(close, ts_days) AS p0 FROM raw0 GROUP BY key),
bud1 AS (SELECT key, p0, rv + jump AS rv, p0 * (1 - p0) AS iv, p0 AS p FROM bud0),
bud AS (SELECT key, p0, rv, iv, {BUCKET} AS bucket FROM bud1),
hp0 AS (SELECT key, hour AS ts, close, ((close - 0.01::DOUBLE) + (close + 0.01::DOUBLE)) / 2 AS mid FROM hourly),
hp1 AS (SELECT *, close - lag(close) OVER w AS dp, mid - lag(mid) OVER w AS dm, lag(close) OVER w AS p_prev,
        coalesce(epoch(ts) - epoch(lag(ts) OVER w) = 3600, false) AS ok FROM hp0 WINDOW w AS (PARTITION BY key ORDER BY ts)),
hp2 AS (SELECT *, lead(dp) OVER w AS dp_next, lead(dm) OVER w AS dm_next, lead(ok) OVER w AS ok_next FROM hp1 WINDOW w AS (PARTITION BY key ORDER BY ts)),
hp AS (SELECT key, ts, dp, dm, p_prev, dp_next, dm_next, coalesce(ok_next, false) AS ok_next FROM hp2 WHERE ok),
al0 AS (SELECT a.user_id // 2 AS pair_id, a.day + INTERVAL 1 DAY AS ts, a.close AS p_k, b.close AS p_pm FROM daily a JOIN daily b ON a.user_id % 2 = 0 AND b.user_id = a.user_id + 1 AND a.day + INTERVAL 1 DAY = b.day),
al AS (SELECT * FROM al0 QUALIFY count(*) OVER (PARTITION BY pair_id) >= 3),
alm AS (SELECT pair_id, ts, p_k - lag(p_k) OVER w AS dk, p_pm - lag(p_pm) OVER w AS dm FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY ts)),
st AS (SELECT event_type AS event, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, k.k AS k, avg(CASE WHEN close > k.k THEN 1.0::DOUBLE ELSE 0 END) AS p
       FROM ev, (SELECT i / 10.0::DOUBLE AS k FROM range(1, 10) r(i)) k GROUP BY ALL),
lad0 AS (SELECT *, min(p) OVER (PARTITION BY event, ts ORDER BY k ROWS UNBOUNDED PRECEDING) AS s, k - lag(k) OVER (PARTITION BY event, ts ORDER BY k) AS width FROM st),
lad1 AS (SELECT *, median(width) OVER (PARTITION BY event, ts) AS tail, lag(s) OVER w AS s0, lag(k) OVER w AS k0, max(k) OVER (PARTITION BY event, ts) AS kx FROM lad0 WINDOW w AS (PARTITION BY event, ts ORDER BY k)),
lad AS (SELECT event, ts, coalesce(k0, k - tail) AS lo, k AS hi, coalesce(s0, 1) - s AS prob FROM lad1
        UNION ALL SELECT event, ts, k, k + tail, s FROM lad1 WHERE k = kx),
sp0 AS (SELECT event_type AS typ, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, close, form, i, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM ev, range(0, 3) f(form), range(0, 10) r(i) WHERE form <> 2 OR i <= 3),
sp1 AS (SELECT typ || '-' || form AS event, ts, typ, CASE WHEN form = 0 AND i BETWEEN 2 AND 7 THEN 'between' WHEN form = 0 AND i < 2 THEN 'less' WHEN i % 2 = 0 THEN 'greater' ELSE 'greater_or_equal' END AS kind, lo, hi, close FROM sp0),
sp AS (SELECT event, ts, typ, kind, CASE WHEN kind <> 'less' THEN lo END AS fs, CASE kind WHEN 'between' THEN hi WHEN 'less' THEN lo END AS cs,
       round(avg(CASE WHEN kind = 'between' THEN CASE WHEN close > lo AND close <= hi THEN 1.0::DOUBLE ELSE 0 END WHEN kind = 'less' THEN CASE WHEN close > lo THEN 0.0::DOUBLE ELSE 1 END WHEN close > lo THEN 1.0::DOUBLE ELSE 0 END), 4) AS close FROM sp1 GROUP BY ALL),
sb0 AS (SELECT event, ts, count(*) FILTER (kind = 'between') AS nb, count(fs) FILTER (kind LIKE 'greater%') AS na, median(cs - fs) FILTER (kind = 'between') AS width, max(fs) FILTER (kind LIKE 'greater%') AS top,
        arg_max(close, fs) FILTER (kind LIKE 'greater%') AS top_p, min(cs) FILTER (kind LIKE 'less%') AS low, arg_min(close, cs) FILTER (kind LIKE 'less%') AS low_p FROM sp GROUP BY ALL),
sb1 AS (SELECT event, ts, fs AS k, min(close) OVER w AS s, fs - lag(fs) OVER (PARTITION BY event, ts ORDER BY fs) AS step FROM sp JOIN sb0 USING (event, ts) WHERE nb < 3 AND na >= 5 AND kind LIKE 'greater%' AND fs IS NOT NULL WINDOW w AS (PARTITION BY event, ts ORDER BY fs ROWS UNBOUNDED PRECEDING)),
sb2 AS (SELECT *, median(step) OVER (PARTITION BY event, ts) AS tail, lag(s) OVER w AS s0, lag(k) OVER w AS k0, max(k) OVER (PARTITION BY event, ts) AS kx FROM sb1 WINDOW w AS (PARTITION BY event, ts ORDER BY k)),
sb AS (SELECT event, ts, fs AS lo, cs AS hi, close AS prob FROM sp JOIN sb0 USING (event, ts) WHERE nb >= 3 AND kind = 'between'
       UNION ALL (select event, ts, top, top + width, top_p FROM sb0 WHERE nb >= 3 AND top_p IS NOT NULL) UNION ALL (select event, ts, low - width, low, low_p FROM sb0 WHERE nb >= 3 AND low_p IS NOT NULL)
       UNION ALL (select event, ts, coalesce(k0, k - tail), k, coalesce(s0, 1) - s FROM sb2) UNION ALL (select event, ts, k, k + tail, s FROM sb2 WHERE k = kx)),
sm0 AS (SELECT event, ts, sum(prob) AS total, sum(prob * (lo + hi) / 2) / sum(prob) AS mean FROM sb GROUP BY ALL),
sm1 AS (SELECT sb.event, sb.ts, any_value(total) AS total, any_value(mean) AS mean, sum(prob / total * pow((lo + hi) / 2 - mean, 2)) AS var FROM sb JOIN sm0 ON sb.event = sm0.event AND sb.ts = sm0.ts GROUP BY ALL),
sm2 AS (SELECT event, ts, any_value(typ) AS series, count(*) AS n_strikes FROM sp GROUP BY ALL),
sm3 AS (SELECT event, max(ts) AS t_end FROM sp GROUP BY event),
sm4 AS (SELECT *, date_diff('second', ts, t_end) / 86400.0::DOUBLE AS tau_days FROM sm1 JOIN sm2 USING (event, ts) JOIN sm3 USING (event)),
sm AS (SELECT event, ts, series, n_strikes, total, mean, sqrt(var) AS std, tau_days, sqrt(var) / nullif(abs(mean), 0) / sqrt(tau_days / 365.25) AS iv_prop, sqrt(var) / sqrt(tau_days / 365.25) AS iv_norm
       FROM sm4 WHERE total BETWEEN 0.7 AND 1.3 AND var > 1e-15 AND tau_days >= 2),
iv AS (SELECT *, CASE series WHEN 'click' THEN 'prop' WHEN 'view' THEN 'norm' WHEN 'purchase' THEN 'norm' END AS kind, CASE WHEN series = 'click' THEN iv_prop ELSE iv_norm END AS iv FROM sm),
fp0 AS (SELECT key, greatest(max(t_res), 1.0::DOUBLE) AS life, arg_min(close, ts_days) AS p0 FROM mk GROUP BY key),
fp1 AS (SELECT raw.*, life, p0, least(greatest(p, 0.005::DOUBLE), 0.995::DOUBLE) AS pc, (life - tau) / life AS frac FROM raw JOIN fp0 USING (key)),
fp2 AS (SELECT *, {_probit("pc")} AS z0 FROM fp1),
fp3 AS (SELECT *, sqrt(greatest(pow({PDF}, 2) / greatest(tau, 1) * dt, 1e-12)) AS sig FROM fp2),
fp4 AS (SELECT *, dp / sig AS z, CASE WHEN abs(dp) < 0.005 THEN 1.0::DOUBLE ELSE 0 END AS still, CASE WHEN 0.005 / sig < 7 THEN 2 * ({_cdf("least(0.005::DOUBLE / sig, 7)")}) - 1 ELSE 1 END AS sx, least(greatest(floor(5 * frac), 0), 4) AS f FROM fp3),
fp5 AS (SELECT *, lead(dp) OVER w AS dn, lead(z) OVER w AS zn FROM fp4 WINDOW w AS (PARTITION BY key ORDER BY ts_days)),
fp AS (SELECT key, count(*) AS n_moves, sum(dp2) AS tot2, max(dp2) AS max2, any_value(life) AS t_res, any_value(p0) AS p0, avg(still - sx) AS xstill, ln(avg(z * z) + 1e-9) AS lam,
       ln(3 + greatest(avg(z * z * z * z) / pow(greatest(avg(z * z), 1e-12), 2) - 3, -2.9)) AS kz, coalesce(ln(avg(z * z) FILTER (frac > 0.5) + 1e-9) - ln(avg(z * z) FILTER (frac <= 0.5) + 1e-9), 0) AS dlam,
       {{ar1z}} AS ar1z, ln(count(*)) AS log_moves, ln(any_value(life)) AS log_tres, ln(avg(dt) + 1e-12) AS log_mdt, avg(still) AS still, avg(abs(p - 0.5::DOUBLE)) AS p_ext, max(p) - min(p) AS p_range,
       ln((sum(dp2) + 1e-12) / (any_value(p0) * (1 - any_value(p0)) + 1e-12)) AS spend_lr, {", ".join(f"coalesce(sum(dp2) FILTER (f = {k}), 0) / (sum(dp2) + 1e-12) AS f{k + 1}" for k in range(4))}, ln((max(dp2) + 1e-12) / (sum(dp2) / count(*) + 1e-12)) AS lump, {{ar1}} AS ar1 FROM fp5 GROUP BY key)
"""


def _lag_one(x: str, n: str) -> str:
    a, b = f"avg({x}) FILTER ({n} IS NOT NULL)", f"avg({n})"
    return f"CASE WHEN count({n}) >= 4 THEN least(greatest((avg({x} * {n}) - {a} * {b}) / (sqrt(var_pop({x}) FILTER ({n} IS NOT NULL) * var_pop({n})) + 1e-12), -1), 1) ELSE 0 END"


BASE = BASE.format(ar1=_lag_one("dp", "dn"), ar1z=_lag_one("z", "zn"))
FEATURES = "xstill lam kz dlam ar1z log_moves log_tres log_mdt still p_ext p_range spend_lr f1 f2 f3 f4 lump ar1"



def _power(rows: str, least: int = 10, bins: int = 14, p: str = "pw", by: str = "") -> str:
    """Cells of the power fit as CTE {p}c."""
    g, on = (f"{by}, ", f" USING ({by})") if by else ("", "")
    return f"""
{p}0 AS (SELECT *, p * (1 - p) AS pq, dp2 / dt AS y FROM {rows}),
{p}e AS (SELECT {g}list_distinct(quantile_cont(pq, [{", ".join(f"{k}/{bins}.0" for k in range(bins + 1))}])) AS e, min(tau) AS t0, max(tau) AS t1 FROM {p}0 {f"GROUP BY {by}" if by else ""}),
{p}1 AS (SELECT {p}0.*, len(list_filter(e, lambda x: x <= pq)) - 1 AS qi, CAST(floor((ln(tau) - ln(t0)) / (ln(t1 + 1) - ln(t0)) * 6 + 1e-9) AS INTEGER) AS tq FROM {p}0 {"JOIN" if by else ","} {p}e{on}),
{p}c AS (SELECT {g}qi, tq AS ti, count(*) AS n, avg(y) AS my, avg(pq) AS mpq, avg(tau) AS mtau FROM {p}1 GROUP BY ALL HAVING count(*) >= {least} AND avg(y) > 0)"""


def _fitted(p: str = "pw", f: str = "f", least: int = 8, by: str = "") -> str:
    """The fit as CTE {f}: weighted least squares by centred moments, unlike the operator's Cramer form."""
    g, on = (f"{by}, ", f"JOIN {f}1 USING ({by})") if by else ("", f", {f}1")
    u = f"USING ({by})" if by else ""
    return f""",
{f}0 AS (SELECT {g}n::DOUBLE AS w, ln(mpq) AS a, ln(mtau) AS b, ln(my) AS y FROM {p}c),
{f}1 AS (SELECT {g}sum(w * a) / sum(w) AS am, sum(w * b) / sum(w) AS bm, sum(w * y) / sum(w) AS ym, count(*) AS cells FROM {f}0 {f"GROUP BY {by}" if by else ""}),
{f}2 AS (SELECT {g}sum(w * (a - am) * (a - am)) AS saa, sum(w * (a - am) * (b - bm)) AS sab, sum(w * (b - bm) * (b - bm)) AS sbb, sum(w * (a - am) * (y - ym)) AS say, sum(w * (b - bm) * (y - ym)) AS sby FROM {f}0 {on} {f"GROUP BY {by}" if by else ""}),
{f}3 AS (SELECT {g}(say * sbb - sby * sab) / (saa * sbb - sab * sab) AS g, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS t FROM {f}2),
{f} AS (SELECT {g}cells, CASE WHEN cells >= {least} THEN exp(ym - g * am - t * bm) END AS c, CASE WHEN cells >= {least} THEN g END AS gamma, CASE WHEN cells >= {least} THEN -t END AS alpha FROM {f}1 {"JOIN" if by else ","} {f}3 {u})"""


def _fit(least: int = 8) -> str:
    return _fitted(least=least) + "\nSELECT * FROM f"


BULK_ROWS = "(SELECT * FROM mv WHERE p >= 0.15::DOUBLE AND p < 0.85::DOUBLE)"
CELLS = _power(BULK_ROWS) + _fitted() + f""",
cells0 AS (SELECT *, lead(dp) OVER w AS dpn, lead(dt) OVER w AS dtn, 2 * ({_cdf("(0.005::DOUBLE / sqrt(greatest(v_gauss, 1e-12)))")}) - 1 AS sx FROM mv WINDOW w AS (PARTITION BY key ORDER BY ts_days)),
cells1 AS (SELECT *, dt BETWEEN 0.9 AND 1.1 AND coalesce(dtn BETWEEN 0.9 AND 1.1, false) AS pr FROM cells0),
cells2 AS (SELECT pi, ti, count(*) AS n, count(DISTINCT key) AS n_mkts, avg(CASE WHEN abs(dp) < 0.005 THEN 1.0::DOUBLE ELSE 0 END) AS still_frac, avg(sx) AS sx,
           kurtosis_pop(z) AS kurt_z, sum(dp2) AS s, avg(dp2 / dt) AS my, avg(p * (1 - p)) AS mpq, avg(tau) AS mtau, count(*) FILTER (pr) AS np, sum(abs(dp * dpn)) FILTER (pr) AS bp, sum(dp2) FILTER (pr) AS p2
           FROM cells1 GROUP BY pi, ti HAVING count(*) >= 20),
cells3 AS (SELECT cells2.*, still_frac - sx AS excess_still, CASE WHEN np >= 10 AND p2 > 0 THEN greatest(0, 1 - pi() / 2 * bp / p2) END AS jump_share,
           my / nullif(c * pow(mpq, gamma) / pow(mtau, alpha), 0) AS ratio_fit, s / nullif(sum(s) OVER (), 0) AS budget_share FROM cells2, f),
cells AS (SELECT pi, ti, n, n_mkts, still_frac, excess_still, kurt_z, jump_share, ratio_fit, budget_share,
          CASE WHEN excess_still >= 0.3 THEN 2 WHEN kurt_z >= 30 THEN 3 ELSE 1 END AS regime FROM cells3)"""

def _slope(x: str, y: str = "dp2") -> str:
    b = f"(sum({x} * {y}) / nullif(sum({x} * {x}), 0))"
    return b, f"sqrt(greatest(sum({x}*{x}*{y}*{y}) - 2 * {b} * sum({x}*{x}*{x}*{y}) + {b} * {b} * sum({x}*{x}*{x}*{x}), 0)) / nullif(sum({x} * {x}), 0)"


def _mixed(source: str, x: str, out: str, names: str) -> str:
    """CTEs that mix an integer x of a source as the operator does; the last one has it as {out}."""
    return f"""{names}a AS (SELECT *, xor({x}, {x} >> 16) * 569420461 % 2147483648 AS xa FROM {source}),
{names}b AS (SELECT *, xor(xa, xa >> 15) * 899864957 % 2147483648 AS xb FROM {names}a),
{names} AS (SELECT * EXCLUDE (xa, xb), xor(xb, xb >> 15) AS {out} FROM {names}b)"""


def _boot(units: str, b: int = 1000, name: str = "boot") -> str:
    return f"""
u0 AS (SELECT *, (ord + 9097963) % 2147483648 AS x FROM ({units})),
{_mixed("u0", "x", "m", "u1")},
u2 AS (SELECT u1.*, r, m + r * 40503 AS y FROM u1, range(1, {b + 1}) t(r)),
{_mixed("u2", "y", "h", "u3")},
u4 AS (SELECT bucket, r, num, den, {_steps("(h / 2147483648.0::DOUBLE)", POISSON)} AS w FROM u3),
u5 AS (SELECT bucket, r, sum(w * num) / nullif(sum(w * den), 0) AS ratio FROM u4 GROUP BY ALL),
{name} AS (SELECT bucket, quantile_cont(ratio, 0.025) AS ci_lo, quantile_cont(ratio, 0.975) AS ci_hi FROM u5 GROUP BY bucket)"""


def _query(body: str, doubles: str = "") -> str:
    """The base, then ctes and a select; `doubles` are rounded as the queries round them."""
    *ctes, select = body.rsplit("\nSELECT", 1) if body.lstrip().startswith(("pw0", "u0", "f0", "x0", "al2")) else ["", body]
    head = f"WITH {BASE}" + (f", {ctes[0]}" if ctes[0] else "")
    select = f"SELECT{select}" if ctes[0] else select
    if not doubles:
        return f"{head} {select}"
    return f"{head} SELECT * REPLACE ({', '.join(f'round({d}, 6) + 0.0 AS {d}' for d in doubles.split())}) FROM ({select}) q"


def _label(x: str, names: list[str]) -> str:
    return f"[{', '.join(repr(n) for n in names)}][{x} + 1]"


_b = {c: _slope(c) for c in ("v_binom", "v_gauss", "v_wf")}
_iv = _slope("iv", "rv")
SEGMENTS = """x0 AS (SELECT *, greatest(t_res - ts_days, 1.0::DOUBLE) AS tau, least(greatest(close, 0.005::DOUBLE), 0.995::DOUBLE) AS pc, ts_days - lag(ts_days) OVER (PARTITION BY key ORDER BY ts_days) AS step FROM mk),
x1 AS (SELECT *, close >= 0.30::DOUBLE AND close < 0.85::DOUBLE AND tau >= 1 AS ok FROM x0),
x2 AS (SELECT *, CAST(sum(CASE WHEN NOT ok OR coalesce(step > 3, false) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts_days ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM x1),
x3 AS (SELECT * FROM x2 WHERE ok QUALIFY count(*) OVER (PARTITION BY key, run) >= 8)"""
UNITS = "SELECT CAST(bucket AS BIGINT) AS bucket, rv AS num, iv AS den, CAST(key AS BIGINT) AS ord FROM bud"
CLIPPED = """x0 AS (SELECT quantile_cont(z, 0.005) AS z0, quantile_cont(z, 0.995) AS z1, quantile_cont(lam, 0.99) AS l1 FROM mv),
wv AS (SELECT key, ts_days, least(greatest(z, z0), z1) AS z, least(lam, l1) AS lam FROM mv, x0)"""


def _acf(rows: str, lags: int = 5, name: str = "acf") -> str:
    own = "(PARTITION BY key)"
    return f""",
ac0 AS (SELECT key, ts_days, z - avg(z) OVER {own} AS z, lam - avg(lam) OVER {own} AS lam FROM {rows}),
ac1 AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER (PARTITION BY key ORDER BY ts_days) AS {c}{k}" for c in ("z", "lam") for k in range(1, lags + 1))} FROM ac0),
{name} AS ({" UNION ALL ".join(f"(select {k}::BIGINT AS lag, sum(z * z{k}) / nullif(sum(z * z), 0) AS acf_z, sum(lam * lam{k}) / nullif(sum(lam * lam), 0) AS acf_lam FROM ac1)" for k in range(1, lags + 1))})"""


def _edge(values) -> str:
    return "[" + ", ".join(f"{e!r}::DOUBLE" for e in values) + "]"


BOX = f""",
x0 AS (SELECT pi FROM cells WHERE ti >= 2 GROUP BY pi HAVING avg(CASE WHEN regime = 1 THEN 1.0::DOUBLE ELSE 0 END) > 0.5),
x1 AS (SELECT ti FROM cells JOIN x0 USING (pi) GROUP BY ti HAVING avg(CASE WHEN regime = 1 THEN 1.0::DOUBLE ELSE 0 END) > 0.5),
x2 AS (SELECT {_edge(PRICE_EDGES)}[min(pi) + 1] AS p_lo, {_edge(PRICE_EDGES)}[max(pi) + 2] AS p_hi, coalesce(string_agg(pi, ',' ORDER BY pi), '') AS p_buckets FROM x0),
x3 AS (SELECT {_edge(TAU_EDGES)}[min(ti) + 1] AS tau_lo, coalesce(string_agg(ti, ',' ORDER BY ti), '') AS tau_bands FROM x1)"""
RESTLESS = """x0r AS (SELECT *, CASE WHEN p < 0.3::DOUBLE AND CAST(ts_days AS BIGINT) % 3 <> 0 THEN 0.0::DOUBLE WHEN p >= 0.7::DOUBLE THEN CASE WHEN CAST(ts_days AS BIGINT) % 13 = 1 THEN 10.0::DOUBLE ELSE 0.1::DOUBLE END ELSE 1.0::DOUBLE END AS f FROM mv),
mr AS (SELECT * EXCLUDE f REPLACE (dp * f AS dp, dp * f * (dp * f) AS dp2, z * f AS z, z * f * (z * f) AS lam) FROM x0r),"""
MAP_ROWS = """
SELECT CAST(cells.pi AS BIGINT) AS pi, CAST(cells.ti AS BIGINT) AS ti, n, CAST(regime AS BIGINT) AS regime, count(*) OVER (PARTITION BY regime) AS cells, sum(budget_share) OVER (PARTITION BY regime) AS share,
       list_contains(string_split(p_buckets, ','), CAST(cells.pi AS VARCHAR)) AND list_contains(string_split(tau_bands, ','), CAST(cells.ti AS VARCHAR)) AS inside, p_lo, p_hi, tau_lo FROM cells, x2, x3"""


RATES = f"SELECT CAST({_steps('p', RATE_EDGES)} AS BIGINT) AS bin, count(*) AS n, avg(p) AS p, avg(dp2 / dt * sqrt(tau)) AS rate, 1.96 * stddev_samp(dp2 / dt * sqrt(tau)) / sqrt(count(*)) AS half FROM mv GROUP BY 1 HAVING count(*) >= 20"
ENDGAME = f"""x0 AS (SELECT *, p * (1 - p) AS pq, CASE WHEN abs(round_even(dp / 0.01::DOUBLE, 0)) >= 2 THEN 1.0::DOUBLE ELSE 0 END AS m FROM raw WHERE tau <= 30 AND dt <= 1.5 AND dt > 0),
x1 AS (SELECT list_distinct(quantile_cont(pq, [{", ".join(f"{k}/10.0" for k in range(11))}])) AS e FROM x0),
x2 AS (SELECT x0.*, len(list_filter(e, lambda x: x <= pq)) - 1 AS qi, {_steps("tau", (1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0))} - 1 AS tj FROM x0, x1),
eg AS (SELECT CAST(qi AS BIGINT) AS qi, CAST(tj AS BIGINT) AS tj, count(*) AS n, avg(pq) AS mpq, avg(tau) AS mtau, avg(m) AS move_rate, avg(dp2 / dt) AS tot FROM x2 GROUP BY ALL HAVING count(*) >= 20)"""
STARTS = """x0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_days) - 1 AS idx, count(*) OVER (PARTITION BY key) - 1 AS last, t_res - ts_days AS tau FROM mk),
x1 AS (SELECT x0.*, band FROM x0, (VALUES (30.0::DOUBLE), (14.0::DOUBLE), (7.0::DOUBLE), (3.0::DOUBLE)) b(band)),
x2 AS (SELECT * FROM x1 QUALIFY row_number() OVER (PARTITION BY key, band ORDER BY abs(tau - band), idx) = 1),
x3 AS (SELECT key, band, idx, tau, close AS p0 FROM x2 WHERE abs(tau - band) <= 0.4 * band AND idx < last AND close BETWEEN 0.05 AND 0.95)"""
TEXTS = "x0 AS (SELECT user_id AS i, min(ts) AS t0, max(ts) AS t1, round(sum(value), 2) AS v FROM ev GROUP BY user_id)"
LISTING2 = TEXTS + """,
l2 AS (SELECT 'S' || (i % 5) || '-' || i AS key, 'T' || i AS question, CAST(date_trunc('second', t0) AS TIMESTAMP) AS start, CASE WHEN i % 4 <> 0 THEN CAST(date_trunc('second', t1) AS TIMESTAMP) END AS "end",
       coalesce(i % 3 = 1 OR i % 5 < 2, false) AS closed, CASE i % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 END AS final_price, CASE i % 3 WHEN 0 THEN v WHEN 2 THEN floor(v) END AS volume, 'S' || (i % 5) AS series_ticker, 'E' || (i % 9) AS event_ticker,
       CASE i % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'settled' ELSE '' END AS status, CASE i % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS result, (i % 11)::DOUBLE AS floor_strike, NULL::DOUBLE AS cap_strike, 'greater' AS strike_type,
       CASE WHEN i % 2 = 0 THEN (i * 3)::DOUBLE END AS open_interest, CASE WHEN i % 3 = 0 THEN CAST(date_trunc('second', t1) AS TIMESTAMP) END AS settlement_ts FROM x0),
sr AS (SELECT 'S' || i AS ticker, 'c' || (i % 3) AS category, (['annual', 'hourly', 'weekly', 'monthly', 'one_off', 'unknown'])[i % 7 + 1] AS frequency, CASE WHEN i % 4 <> 0 THEN strftime(t1, '%Y-%m-%dT%H:%M:%SZ') END AS upd, i % 7 AS f FROM x0 WHERE i < 12 AND i <> 4)"""
MONTHS = "['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC']"

TICKS = f"x0 AS (SELECT CAST({_steps('least(p, 1 - p)', DISTANCE_EDGES[1:-1])} AS BIGINT) AS di, CAST({BAND} AS BIGINT) AS ti, CAST(round_even(CASE WHEN p <= 0.5 THEN dp ELSE -dp END / 0.01::DOUBLE, 0) AS BIGINT) AS k, count(*) AS n FROM raw WHERE dt <= 1.5 GROUP BY ALL)"
SCORES = CELLS + f""",
sc0 AS (SELECT key, ts_days, lag(close) OVER w AS p, close - lag(close) OVER w AS dp, lag(greatest(t_res - ts_days, 1.0::DOUBLE)) OVER w AS tau FROM mk WINDOW w AS (PARTITION BY key ORDER BY ts_days)),
sc1 AS (SELECT *, CAST(round_even(dp / 0.01::DOUBLE, 0) AS BIGINT) AS k, {BUCKET} AS pi, {BAND} AS ti FROM sc0 WHERE p IS NOT NULL),
sc2 AS (SELECT {BUCKET} AS pi, {BAND} AS ti, CASE WHEN var_samp(dp) = 0 THEN 1e-4::DOUBLE ELSE var_samp(dp) END AS var FROM raw GROUP BY 1, 2),
sc3 AS (SELECT sc1.*, coalesce(regime, 1) AS regime, (select var_samp(dp) FROM raw) AS fv, coalesce(var, (select var_samp(dp) FROM raw)) AS cv FROM sc1 LEFT JOIN sc2 USING (pi, ti) LEFT JOIN cells ON cells.pi = sc1.pi AND cells.ti = sc1.ti),
sc4 AS (SELECT *, greatest(sqrt(cv), 1e-9) AS sb, greatest(sqrt(fv), 1e-9) AS sf FROM sc3),
sc5 AS (SELECT *, (k + 0.5::DOUBLE) * 0.01::DOUBLE / sb AS b1, (k - 0.5::DOUBLE) * 0.01::DOUBLE / sb AS b0, (k + 0.5::DOUBLE) * 0.01::DOUBLE / sf AS f1, (k - 0.5::DOUBLE) * 0.01::DOUBLE / sf AS f0 FROM sc4),
sc AS (SELECT key, ts_days, k, CAST(regime AS BIGINT) AS regime, ln(greatest({_any_cdf("b1")} - {_any_cdf("b0")}, 1e-12)) AS bucket, ln(greatest({_any_cdf("f1")} - {_any_cdf("f0")}, 1e-12)) AS flat FROM sc5)"""
_sum = lambda rho, power: f"list_sum(list_transform(range(2, 2001), lambda j: (1 - {rho}) * pow({rho}::DOUBLE, j - 2) * pow(j, {power})))"


def _normal2(w: float, mu, cov, a: str = "xstill", b: str = "lam") -> str:
    det = cov[0][0] * cov[1][1] - cov[0][1] * cov[1][0]
    x, y = f"({a} - {mu[0]}::DOUBLE)", f"({b} - {mu[1]}::DOUBLE)"
    return f"(ln({w}::DOUBLE) - ln(2 * pi()) - ln({det}::DOUBLE) / 2 - ({cov[1][1]}::DOUBLE * {x} * {x} - 2 * {cov[0][1]}::DOUBLE * {x} * {y} + {cov[0][0]}::DOUBLE * {y} * {y}) / {det}::DOUBLE / 2)"


#: Hourly bars of the raw replies, by key; their markets are those that no list of finished ones holds.
REPLIES = """x0 AS (SELECT key, hour AS ts, CAST(epoch(hour) AS BIGINT) // 3600 % 3 <> 0 AS traded, CAST(round(close * 100) AS BIGINT) AS c FROM hourly WHERE user_id % 4 = 0 AND user_id % 6 <> 0),
x1 AS (SELECT key, ts, (c - 1) / 100.0::DOUBLE AS bid, (c + 1) / 100.0::DOUBLE AS ask, traded, c / 100.0::DOUBLE AS p FROM x0),
x2 AS (SELECT key, epoch_us(ts) // 1000000 AS t, min(close) AS p FROM ev WHERE user_id % 4 <> 0 AND user_id % 6 <> 0 AND user_id % 10 NOT IN (5, 7) AND NOT (user_id % 10 = 3 AND day(ts) % 7 = 0) GROUP BY ALL),
x3 AS (SELECT key, ts, CASE WHEN traded THEN p ELSE (bid + ask) / 2 END AS open, CASE WHEN traded THEN ask ELSE (bid + ask) / 2 END AS high, CASE WHEN traded THEN bid ELSE (bid + ask) / 2 END AS low, CASE WHEN traded THEN p ELSE (bid + ask) / 2 END AS close, bid, ask FROM x1
       UNION ALL SELECT key, make_timestamp((t + 3599) // 3600 * 3600 * 1000000) AS ts, arg_min(p, t), max(p), min(p), arg_max(p, t), NULL, NULL FROM x2 GROUP BY ALL)"""
SQL = {
    "a05_catalog_upsert": _query("SELECT key, venue, round(CASE WHEN venue = 1 THEN volume + 1 ELSE volume END, 6) AS volume, CASE WHEN venue = 1 THEN 'x' END AS slug FROM cat"),
    "a07_bars_upsert": _query("SELECT key, day AS ts, CASE WHEN close > 0.5 THEN close + 0.001::DOUBLE ELSE close END AS close FROM daily", "close"),
    "a35_backfill_bars": _query(REPLIES + "\nSELECT * FROM x3", "open high low close bid ask"),
    "a35_backfill_outcomes": _query(REPLIES + """,
x4 AS (SELECT key, user_id AS i, count(*) FILTER (user_id % 10 = 3 AND day(ts) % 7 = 0) AS broken FROM ev WHERE user_id % 6 <> 0 GROUP BY ALL),
x5 AS (SELECT key, i, CASE WHEN i % 10 = 7 THEN 'no payload' WHEN i % 10 = 5 THEN 'unknown kind' WHEN broken > 0 THEN 'malformed' END AS error, (SELECT count(*) FROM x3 WHERE x3.key = x4.key) AS n_bars FROM x4)
SELECT key, n_bars, CASE WHEN error IS NOT NULL THEN 'failed' WHEN i % 5 <> 4 AND n_bars > 0 THEN 'done' ELSE 'open' END AS status, error, CASE WHEN error IS NULL THEN 0 WHEN i % 20 = 3 THEN 3 ELSE 1 END::BIGINT AS attempts FROM x5"""),
    "a36_universe": _query(LISTING2 + """\nSELECT key, question, start, "end", closed, final_price, volume FROM l2 WHERE closed AND volume >= 50 AND epoch_us("end") - epoch_us(start) >= 20 * 86400000000""", "volume"),
    "a37_appended_store": _query("SELECT key, day AS ts, CASE WHEN close > 0.5 THEN close + 0.001::DOUBLE ELSE close END AS close FROM daily", "close"),
    "a08_safe_names": _query("SELECT DISTINCT event_type, user_id, event_type || '_x_y_' || user_id AS name FROM ev"),
    "a09_done_set": _query("SELECT DISTINCT key FROM cat WHERE venue = 0 OR closed"),
    "a12_final_markets": _query("SELECT key, volume FROM cat WHERE closed ORDER BY volume DESC, key LIMIT 20", "volume"),
    "a14_union_catalogs": _query("SELECT key, CASE WHEN venue = 0 THEN volume + 5 ELSE volume END AS volume FROM cat", "volume"),
    "a15_series": _query(LISTING2 + "\nSELECT key, series_ticker, category, frequency FROM l2 LEFT JOIN sr ON ticker = series_ticker"),
    "a16_volume_floor": _query(TEXTS + "\nSELECT 'm' || i AS key, v AS volume FROM x0 WHERE i % 5 <> 4 AND i % 7 NOT IN (1, 3) AND v >= 50", "volume"),
    "a18_market_rows": _query(LISTING2 + "\nSELECT * FROM l2", "volume"),
    "a24_scan_order": _query(LISTING2 + "\nSELECT ticker, CAST(coalesce(CASE f WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 2 END, 4) AS BIGINT) AS rank FROM sr ORDER BY rank, coalesce(upd, '') DESC, ticker LIMIT 6"),
    "a28_event_tags": "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 10 >= 8 THEN '[]' ELSE '[\"' || event_type || '\",\"k' || (event_id % 7) || '\"]' END AS tags FROM events",
    "a30_alarms": _query("""x0 AS (SELECT key, max(close) AS top, count(*) FILTER (close NOT BETWEEN 0 AND 1) AS o FROM daily GROUP BY key)
SELECT CAST(sum(o) AS BIGINT) AS out_of_range, median(top) AS median_top, (SELECT count(*) FROM cat WHERE final_price NOT IN (0, 1)) AS bad_finals, median(top) < 0.2 AS scale_alarm FROM x0""", "median_top"),
    "a33_top_up": _query(LISTING2 + """\nSELECT key, start AS "from", greatest("end", settlement_ts) + INTERVAL 1 DAY AS "to" FROM l2 WHERE series_ticker <> 'S1'"""),
    "a10_select_markets": _query("SELECT key, volume FROM cat WHERE closed AND volume >= 100 ORDER BY volume DESC, key LIMIT 50", "volume"),
    "a11_todo": _query("SELECT key, volume FROM cat WHERE closed AND venue <> 0", "volume"),
    "a13_long_lived": _query("SELECT key, (epoch_us(t_end) - epoch_us(date_trunc('second', t_start))) / 86400e6 AS days FROM cat WHERE volume >= 50 AND (epoch_us(t_end) - epoch_us(date_trunc('second', t_start))) / 86400e6 >= 27.5 ORDER BY volume DESC, key LIMIT 1000", "days"),
    "a17_parse_markets": _query(TEXTS + """,
x1 AS (SELECT *, i % 7 = 1 AS second, i % 6 NOT IN (0, 5) AS closed FROM x0 WHERE i % 7 <> 2 AND i % 11 NOT IN (3, 4)),
x2 AS (SELECT *, CASE WHEN second THEN CASE i % 5 WHEN 0 THEN 0 WHEN 1 THEN 0.997 WHEN 2 THEN 0.6 WHEN 3 THEN 0 END ELSE CASE i % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.003 WHEN 2 THEN 0.4 END END AS price FROM x1)
SELECT CASE WHEN second THEN '8' ELSE '7' END || i AS key, CASE WHEN i % 7 = 0 THEN 'Alpha' WHEN second THEN 'YES' ELSE 'Yes' END AS outcome, 'Q' || i AS question, CAST(date_trunc('second', t0) AS TIMESTAMP) AS start, CASE WHEN i % 4 <> 0 THEN CAST(date_trunc('second', t1) AS TIMESTAMP) END AS "end",
       closed, CASE WHEN closed AND price <= 0.005 THEN 0.0::DOUBLE WHEN closed AND price >= 0.995 THEN 1.0 END AS final_price, CASE WHEN i % 3 = 0 THEN v ELSE v + 1 END AS volume, '0x' || i AS condition_id, 'q-' || i AS slug, CASE WHEN i % 3 = 0 THEN 'e' || i END AS event_id, CASE WHEN i % 3 = 0 THEN 's' || i END AS event_slug,
       i % 2 = 0 AS neg_risk, CAST(i AS VARCHAR) AS gamma_id FROM x2""", "volume"),
    "a19_numbers": "SELECT event_id, round(CASE WHEN event_id % 5 = 2 THEN floor(value * 100) / 100 WHEN event_id % 5 < 4 AND event_id % 16 >= 2 THEN value END, 6) AS value FROM events",
    "a20_candles": _query("""x0 AS (SELECT *, CAST(epoch(hour) AS BIGINT) // 3600 AS h, close - 0.01::DOUBLE AS bid, close + 0.01::DOUBLE AS ask FROM hourly)
SELECT key, hour AS ts, CASE WHEN h % 3 = 0 THEN (bid + ask) / 2 ELSE close - 0.01::DOUBLE END AS open, CASE WHEN h % 3 = 0 THEN (bid + ask) / 2 ELSE close + 0.02::DOUBLE END AS high, CASE WHEN h % 3 = 0 THEN (bid + ask) / 2 ELSE close - 0.02::DOUBLE END AS low,
       CASE WHEN h % 3 = 0 THEN (bid + ask) / 2 ELSE close END AS close, bid, CASE WHEN h % 6 <> 0 THEN ask END AS ask FROM x0 WHERE h % 6 <> 0""", "open high low close bid ask"),
    "a21_resample": _query("""x0 AS (SELECT key, epoch_us(ts) // 1000000 AS t, close AS p FROM ev QUALIFY row_number() OVER (PARTITION BY key, epoch_us(ts) // 1000000 ORDER BY event_id) = 1),
x1 AS (SELECT *, (t + 14399) // 14400 * 14400 AS e FROM x0)
SELECT key, make_timestamp(e * 1000000) AS ts, arg_min(p, t) AS open, max(p) AS high, min(p) AS low, arg_max(p, t) AS close FROM x1 GROUP BY key, e"""),
    "a22_chunks": _query("""x0 AS (SELECT key, CAST(date_trunc('day', t_start) AS TIMESTAMP) AS t0, CAST(date_trunc('day', t_end) AS TIMESTAMP) AS t1 FROM cat),
x1 AS (SELECT *, unnest(range(t0, t1, INTERVAL 7 DAY)) AS f FROM x0)
SELECT key, f AS "from", least(f + INTERVAL 7 DAY, t1) AS "to" FROM x1"""),
    "a31_vintage_diff": _query("""x0 AS (SELECT key, max(abs(close - CASE WHEN close > 0.5 THEN close + 0.001::DOUBLE ELSE close END)) AS d FROM daily GROUP BY key)
SELECT count(*) AS keys, median(d) AS p50, quantile_cont(d, 0.95) AS p95, max(d) AS most FROM x0""", "p50 p95 most"),
    "a32_violations": _query("""x0 AS (SELECT key, max(close) AS top, count(*) FILTER (close NOT BETWEEN 0 AND 1) AS o FROM daily GROUP BY key)
SELECT CAST(sum(o) AS BIGINT) AS out_of_range, median(top) AS median_top, (SELECT count(*) FROM cat WHERE final_price NOT IN (0, 1)) AS bad_finals FROM x0""", "median_top"),
    "a26_series_markets": _query("SELECT 'S' || (user_id % 3) || '-' || key AS key, 'S' || (user_id % 3) AS series, round(sum(value), 4) AS volume FROM ev GROUP BY key, user_id HAVING round(sum(value), 4) >= 100 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 5 * 86400000000", "volume"),
    "a38_window_end": _query("SELECT key, t_end + CASE WHEN venue = 1 THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END AS until FROM cat"),
    "a39_utc": _query("SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) END AS TIMESTAMP) AS ts FROM ev"),
    "a40_tier": _query("SELECT key, CASE WHEN closed AND t_end + CASE WHEN venue = 1 THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END < TIMESTAMP '2024-01-20 00:00:00' THEN 'historical' ELSE 'live' END AS tier FROM cat"),
    "b01_grid": _query(f"SELECT key, ts_days, CAST({BUCKET} AS BIGINT) AS bucket, {_label(BUCKET, PRICE_LABELS)} AS label, CAST({BAND} AS BIGINT) AS band, {_label(BAND, TAU_LABELS)} AS tau_label, CAST({_steps('least(p, 1 - p)', DISTANCE_EDGES[1:-1])} AS BIGINT) AS di, CAST(round_even(CASE WHEN p <= 0.5 THEN dp ELSE -dp END / 0.01::DOUBLE, 0) AS BIGINT) AS ticks FROM raw"),
    "b07_normal": _query(f"x0 AS (SELECT DISTINCT close, close * 4 - 2 AS x FROM ev)\nSELECT close, {_probit('close')} AS z, {_cdf('x')} AS cdf, exp(-close * close / 2) / sqrt(2 * pi()) AS pdf FROM x0", "z cdf pdf"),
    "c01_markets": _query("SELECT key, ts_days, close, final, t_res FROM mk"),
    "c02_raw_panel": _query("SELECT key, ts_days, p, dp, dp2, dt, tau FROM raw", "dp dp2"),
    "c03_move_panel": _query("SELECT key, ts_days, p, dp, dt, tau, v_binom, v_gauss, v_wf, z, lam FROM mv", "dp v_binom v_gauss v_wf z lam"),
    "c04_hourly_pairs": _query("SELECT * FROM hp", "dp dm dp_next dm_next"),
    "c05_segments": _query(SEGMENTS + f"""
SELECT key, run, row_number() OVER w - 1 AS pos, {_probit("pc")} AS z, ts_days - lag(ts_days) OVER w AS dt, lag(tau) OVER w AS taup, {_probit("least(greatest(pc - 0.01::DOUBLE / 2, 1e-4), 1 - 1e-4)")} AS zlo, {_probit("least(greatest(pc + 0.01::DOUBLE / 2, 1e-4), 1 - 1e-4)")} AS zhi,
coalesce(round_even((close - lag(close) OVER w) / 0.01::DOUBLE, 0) = 0, false) AS isz FROM x3 WINDOW w AS (PARTITION BY key, run ORDER BY ts_days)""", "z zlo zhi"),
    "c08_subsample": _query(SEGMENTS + """,
x4 AS (SELECT key, run, count(*) AS n, md5('7:' || key || ':' || run) AS u FROM x3 GROUP BY ALL),
x5 AS (SELECT *, sum(n - 1) OVER (ORDER BY u, key, run ROWS UNBOUNDED PRECEDING) - (n - 1) AS before FROM x4)
SELECT key, run, n FROM x5 WHERE before < 300"""),
    "c09_start_states": _query(STARTS + "\nSELECT * FROM x3"),
    "c10_remaining_variance": _query(STARTS + """,
x4 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_days) - 1 AS i FROM raw0)
SELECT x3.key, band, p0, sum(CASE WHEN abs(nx - close) < 0.02::DOUBLE THEN (nx - close) * (nx - close) ELSE 0 END) AS small, sum(CASE WHEN abs(nx - close) >= 0.02::DOUBLE THEN (nx - close) * (nx - close) ELSE 0 END) AS jumps, pow(max(final) - arg_max(close, i), 2) AS terminal FROM x3 JOIN x4 ON x3.key = x4.key AND i >= idx GROUP BY ALL""", "small jumps terminal"),
    "c12_folds": _query("""x0 AS (SELECT key, row_number() OVER (ORDER BY t_end NULLS FIRST, key) - 1 AS i, count(*) OVER () AS n FROM cat),
x1 AS (SELECT key, fold, CASE WHEN i < floor(lo * n) THEN 'train' WHEN i < floor(hi * n) THEN 'test' END AS part FROM x0, (VALUES (0::BIGINT, 0.5::DOUBLE, 0.75::DOUBLE), (1, 0.75, 1.0)) b(fold, lo, hi))
SELECT * FROM x1 WHERE part IS NOT NULL QUALIFY part = 'train' OR row_number() OVER (PARTITION BY fold, part ORDER BY md5('7:' || key), key) <= 7"""),
    "c13_random_split": _query("SELECT key, CAST('0x' || substr(md5('7:' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3::DOUBLE AS is_test FROM cat"),
    "d01_budget_slope": _query(f"SELECT {_iv[0]} AS slope, {_iv[1]} AS se, count(*) AS n FROM bud", "slope se"),
    "d02_lifetime_budget": _query("SELECT key, p0, rv, iv FROM bud", "rv iv"),
    "d03_budget_by_bucket": _query(f"SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, sum(rv) / nullif(sum(iv), 0) AS ratio, {_label('bucket', PRICE_LABELS)} AS label FROM bud GROUP BY bucket", "ratio"),
    "d04_budget_bootstrap": _query(_boot(UNITS) + "\nSELECT * FROM boot", "ci_lo ci_hi"),
    "d05_local_slopes": _query("SELECT " + ", ".join(f"{b} AS {c}_slope, {se} AS {c}_se" for c, (b, se) in _b.items()) + ", count(*) AS n FROM mv", " ".join(f"{c}_slope {c}_se" for c in _b)),
    "d06_local_ratios": _query("SELECT CAST(pi AS BIGINT) AS bucket, count(*) AS n, sum(dp2) / nullif(sum(v_binom), 0) AS ratio_binom, sum(dp2) / nullif(sum(v_gauss), 0) AS ratio_gauss, sum(dp2) / nullif(sum(v_wf) * (SELECT sum(v_wf * dp2) / sum(v_wf * v_wf) FROM mv), 0) AS ratio_wf FROM mv GROUP BY pi", "ratio_binom ratio_gauss ratio_wf"),
    "d07_clustered_bootstrap": _query(_boot("SELECT CAST(pi AS BIGINT) AS bucket, CAST(key AS BIGINT) AS ord, sum(dp2) AS num, sum(v_gauss) AS den FROM mv GROUP BY ALL") + "\nSELECT * FROM boot", "ci_lo ci_hi"),
    "d08_power_cells": _query(_power("mv") + "\nSELECT CAST(qi AS BIGINT) AS qi, CAST(ti AS BIGINT) AS ti, n, my, mpq, mtau FROM pwc", "my mpq mtau"),
    "d08_power_fit": _query(_power("mv") + _fit(), "c gamma alpha"),
    "d09_power_fit_bulk": _query(_power(BULK_ROWS) + _fit(), "c gamma alpha"),
    "d10_kurtosis": _query("SELECT CAST(pi AS BIGINT) AS bucket, count(*) AS n, kurtosis_pop(z) AS kurt FROM mv GROUP BY pi HAVING count(*) >= 30", "kurt"),
    "b13_winsorised": _query(CLIPPED + "\nSELECT * FROM wv", "z lam"),
    "d11_acf": _query("x0 AS (SELECT 1 AS one)" + _acf("mv") + "\nSELECT * FROM acf", "acf_z acf_lam"),
    "d12_acf_winsorised": _query(CLIPPED + _acf("wv") + "\nSELECT * FROM acf", "acf_z acf_lam"),
    "d15_ratios_with_floor": _query(_boot(UNITS, 2000) + f""",
u6 AS (SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, sum(rv) / nullif(sum(iv), 0) AS ratio FROM bud GROUP BY ALL)
SELECT bucket, n, CASE WHEN n >= 10 THEN ratio END AS ratio, CASE WHEN n >= 10 THEN ci_lo END AS ci_lo, CASE WHEN n >= 10 THEN ci_hi END AS ci_hi FROM u6 LEFT JOIN boot USING (bucket)""", "ratio ci_lo ci_hi"),
    "d17_scalars": _query(CLIPPED + _acf("wv", 1) + "," + _power("mv", p="pa") + _fitted("pa", "fa") + "," + _power(BULK_ROWS, p="pb") + _fitted("pb", "fb") + f""",
x7 AS (SELECT {_iv[0]} AS budget_slope, {_iv[1]} AS budget_se, count(*) AS budget_n FROM bud),
x8 AS (SELECT {", ".join(f"{b} AS local_{c}_slope, {se} AS local_{c}_se" for c, (b, se) in _b.items())}, count(*) AS local_n FROM mv)
SELECT x7.*, x8.*, fa.cells AS power_cells, fa.c AS power_c, fa.gamma AS power_gamma, fa.alpha AS power_alpha, fb.cells AS bulk_cells, fb.c AS bulk_c, fb.gamma AS bulk_gamma, fb.alpha AS bulk_alpha, acf_z AS lag1_acf_z, acf_lam AS lag1_acf_lam FROM x7, x8, fa, fb, acf""",
        "budget_slope budget_se power_c power_gamma power_alpha bulk_c bulk_gamma bulk_alpha lag1_acf_z lag1_acf_lam " + " ".join(f"local_{c}_slope local_{c}_se" for c in _b)),
    "d18_level_match": _query(f"""x0 AS ({RATES.replace("SELECT", "select")}),
x1 AS (SELECT *, p * (1 - p) AS pq, {_probit("p")} AS z0 FROM x0 WHERE rate > 0),
x2 AS (SELECT exp(avg(ln(rate) - ln(pq))) AS a, exp(avg(ln(rate) - ln(pq * pq))) AS b, exp(avg(ln(rate) - ln(pow({PDF}, 2)))) AS c, exp(avg(ln(rate) - ln(pow(pq, 1.3::DOUBLE)))) AS d FROM x1)
SELECT * FROM (select 'arcsin' AS curve, a AS level FROM x2 UNION ALL select 'logit', b FROM x2 UNION ALL select 'probit', c FROM x2 UNION ALL select 'power', d FROM x2) q""", "level"),
    "d14_rate_by_price": _query(RATES, "p rate half"),
    "e01_map_cells": _query(CELLS + "\nSELECT * REPLACE (CAST(pi AS BIGINT) AS pi, CAST(ti AS BIGINT) AS ti, CAST(regime AS BIGINT) AS regime) FROM cells", "still_frac excess_still kurt_z jump_share ratio_fit budget_share"),
    "e04_rectangle": _query(CELLS + BOX + "\nSELECT p_lo, p_hi, tau_lo, p_buckets, tau_bands FROM x2, x3"),
    "e05_regime_shares": _query(CELLS + "\nSELECT CAST(regime AS BIGINT) AS regime, count(*) AS cells, sum(budget_share) AS share FROM cells GROUP BY regime", "share"),
    "e08_map_driver": _query(CELLS + BOX + MAP_ROWS, "share"),
    "e03_regimes": _query(RESTLESS + (CELLS + BOX).replace("FROM mv ", "FROM mr ") + MAP_ROWS, "share"),
    "e07_pivot": _query(CELLS + "\nSELECT CAST(ti AS BIGINT) AS ti, " + ", ".join(f"max(CASE WHEN pi = {k} THEN n END) AS p{k}" for k in range(9)) + " FROM cells GROUP BY ti"),
    "h01_regime_ticks": _query(CELLS + f""",
x0 AS (SELECT *, CAST({BUCKET} AS BIGINT) AS pi, CAST({BAND} AS BIGINT) AS ti FROM raw WHERE dt <= 1.5)
SELECT CAST({_steps('least(p, 1 - p)', DISTANCE_EDGES[1:-1])} AS BIGINT) AS di, ti, CAST(round_even(CASE WHEN p <= 0.5 THEN dp ELSE -dp END / 0.01::DOUBLE, 0) AS BIGINT) AS k, count(*) AS n FROM x0 WHERE (pi, ti) IN (select (pi, ti) FROM cells WHERE regime = 1 AND pi % 2 = 0) GROUP BY ALL"""),
    "h02_tick_histogram": _query(f"SELECT CAST({_steps('least(p, 1 - p)', DISTANCE_EDGES[1:-1])} AS BIGINT) AS di, CAST({BAND} AS BIGINT) AS ti, CAST(round_even(CASE WHEN p <= 0.5 THEN dp ELSE -dp END / 0.01::DOUBLE, 0) AS BIGINT) AS k, count(*) AS n FROM raw WHERE dt <= 1.5 GROUP BY ALL"),
    "h03_tick_masses": _query(TICKS + f""",
x1 AS (SELECT *, (k + 0.5::DOUBLE) / 1.3::DOUBLE AS a, (k - 0.5::DOUBLE) / 1.3::DOUBLE AS b FROM x0)
SELECT di, ti, k, 0.5::DOUBLE * ({_any_cdf("a")} - {_any_cdf("b")}) + CASE WHEN k = 0 THEN 0.4::DOUBLE ELSE 0 END + 0.1::DOUBLE * CASE WHEN k >= 2 THEN 0.7 * 0.4 * pow(0.6::DOUBLE, k - 2) WHEN k <= -2 THEN 0.3 * 0.5 * pow(0.5::DOUBLE, -k - 2) ELSE 0 END AS mass FROM x1""", "mass"),
    "h05_hazard_summary": _query(TICKS + f""",
x1 AS (SELECT di, ti, CAST(sum(n) AS BIGINT) AS n, sum(n * k * k) / sum(n) AS emp FROM x0 GROUP BY di, ti),
x2 AS (SELECT *, 0.7::DOUBLE * {_sum("0.6", 1)} + 0.3::DOUBLE * {_sum("0.5", 1)} AS size, 0.1::DOUBLE * (0.7::DOUBLE * {_sum("0.6", 2)} + 0.3::DOUBLE * {_sum("0.5", 2)}) AS sq FROM x1)
SELECT di, ti, n, 0.4::DOUBLE AS pi0, 0.1::DOUBLE AS h_day, 1.3::DOUBLE AS sigma_tk, size AS gap_mean_tk, 0.7::DOUBLE AS w_away, sq / (0.5::DOUBLE * 1.3 * 1.3 + sq) AS gap_var_share, (0.5::DOUBLE * 1.3 * 1.3 + sq) / nullif(emp, 0) AS var_model_emp, -1.0::DOUBLE AS ll_per_obs FROM x2""", "gap_mean_tk gap_var_share var_model_emp"),
    "h08_arrival": _query(ENDGAME + f""",
x3 AS (SELECT *, CAST(round(move_rate * n) AS BIGINT) AS movers, 2.0::DOUBLE + qi / 4.0::DOUBLE AS s FROM eg),
x4 AS (SELECT *, 1.5::DOUBLE / s AS t FROM x3)
SELECT qi, tj, movers, CASE WHEN movers >= 25 THEN pow(s * 0.01::DOUBLE, 2) END AS size, CASE WHEN movers >= 25 THEN least(move_rate / (2 * (1 - {_any_cdf("t")})), 1) END AS nu FROM x4""", "size nu"),
    "i05_cell_scores": _query(SCORES + "\nSELECT * FROM sc", "bucket flat"),
    "i07_summary": _query(SCORES + "\nSELECT * FROM (select 'bucket' AS model, avg(bucket) AS ll_per_obs, avg(bucket) - avg(flat) AS delta FROM sc UNION ALL select 'flat', avg(flat), 0.0 FROM sc) q", "ll_per_obs delta"),
    "i07_by_regime": _query(SCORES + "\nSELECT regime, count(*) AS n, avg(bucket) AS bucket, avg(flat) AS flat FROM sc GROUP BY regime", "bucket flat"),
    "i08_delta_intervals": _query(SCORES + "," + _boot("select 'bucket' AS bucket, CAST(key AS BIGINT) AS ord, sum(flat - bucket) AS num, CAST(count(*) AS DOUBLE) AS den FROM sc GROUP BY key") + "\nSELECT bucket AS model, ci_lo, ci_hi FROM boot", "ci_lo ci_hi"),
    "i11_budget_integration": _query(STARTS + """,
x4 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_days) - 1 AS i FROM raw0),
x5 AS (SELECT x3.key, band, p0, sum(CASE WHEN abs(nx - close) < 0.02::DOUBLE THEN (nx - close) * (nx - close) ELSE 0 END) AS small, sum(CASE WHEN abs(nx - close) >= 0.02::DOUBLE THEN (nx - close) * (nx - close) ELSE 0 END) + pow(max(final) - arg_max(close, i), 2) AS jumps FROM x3 JOIN x4 ON x3.key = x4.key AND i >= idx GROUP BY ALL)
SELECT band, count(*) AS n, sum(small + jumps) / sum(p0 * (1 - p0)) AS real_ratio, sum(jumps) / sum(small + jumps) AS real_jump_share FROM x5 GROUP BY band""", "real_ratio real_jump_share"),
    "k05_selection": _query("""x0 AS (SELECT n_moves AS k, max(lam) AS heldout_ll FROM fp GROUP BY n_moves)
SELECT k, heldout_ll, k = (select min(k) FROM x0 WHERE heldout_ll >= (select max(heldout_ll) FROM x0) - 0.5) AS chosen FROM x0""", "heldout_ll"),
    "k06_labels": _query(f"""x0 AS (SELECT key, {_normal2(0.4, [0.0, 1.0], [[0.5, 0.1], [0.1, 2.0]])} AS a, {_normal2(0.6, [0.3, 4.0], [[0.2, -0.1], [-0.1, 3.0]])} AS b FROM fp)
SELECT key, ln(exp(a) + exp(b)) AS ll, CASE WHEN a >= b THEN 0 ELSE 1 END::BIGINT AS cluster FROM x0""", "ll"),
    "h06_endgame_cells": _query(ENDGAME + "\nSELECT * FROM eg", "mpq mtau move_rate tot"),
    "h09_wls": _query(ENDGAME + ",\npwc AS (SELECT n, mpq, mtau, tot AS my FROM eg WHERE tot > 0)" + _fit(6), "c gamma alpha"),
    "h10_spend_profile": _query("""x0 AS (SELECT CASE WHEN tau > 0 AND tau <= 1 THEN '(0,1]' WHEN tau > 1 AND tau <= 3 THEN '(1,3]' WHEN tau > 3 AND tau <= 7 THEN '(3,7]' WHEN tau > 7 AND tau <= 30 THEN '(7,30]' WHEN tau > 30 THEN '>30' END AS band, dp2 AS s FROM raw
 UNION ALL (select 'terminal', jump FROM bud0) UNION ALL (select b, 0 FROM (VALUES ('(0,1]'), ('(1,3]'), ('(3,7]'), ('(7,30]'), ('>30')) v(b))),
x1 AS (SELECT band, sum(s) AS s FROM x0 WHERE band IS NOT NULL GROUP BY band)
SELECT band, s / nullif(sum(s) OVER (), 0) AS share FROM x1""", "share"),
    "i03_garch_likelihood": "WITH RECURSIVE " + BASE.strip() + """,
x0 AS (SELECT key, dp * dp AS y, row_number() OVER (PARTITION BY key ORDER BY ts_days) AS i FROM raw),
given(k, w, a, b) AS (VALUES (0, 0.0004::DOUBLE, 0.1::DOUBLE, 0.6::DOUBLE), (1, 0.002::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE)),
path AS (SELECT k, key, i, y, w, a, b, w / greatest(1 - a - b, 1e-6) AS var FROM x0 CROSS JOIN given WHERE i = 1
         UNION ALL (select p.k, p.key, x0.i, x0.y, p.w, p.a, p.b, p.w + p.a * p.y + p.b * p.var FROM path p JOIN x0 ON x0.key = p.key AND x0.i = p.i + 1))
SELECT k::BIGINT AS k, round(-0.5 * sum(ln(var) + y / var + ln(2 * pi())), 6) + 0.0 AS ll, count(*) AS n FROM path GROUP BY k""",
    "i02_cell_variances": _query(f"SELECT CAST({BUCKET} AS BIGINT) AS pi, CAST({BAND} AS BIGINT) AS ti, count(*) AS n, CASE WHEN var_samp(dp) = 0 THEN 0.01::DOUBLE * 0.01::DOUBLE ELSE var_samp(dp) END AS var FROM raw GROUP BY 1, 2 UNION ALL (select -1, -1, count(*), var_samp(dp) FROM raw)", "var"),
    "j03_aligned_hourly": _query("""x0 AS (SELECT a.user_id // 2 AS pair_id, a.hour + INTERVAL 1 HOUR AS ts, a.close AS p_k, b.close AS p_pm FROM hourly a JOIN hourly b ON a.user_id % 2 = 0 AND b.user_id = a.user_id + 1 AND a.hour + INTERVAL 1 HOUR = b.hour)
SELECT * FROM x0 QUALIFY count(*) OVER (PARTITION BY pair_id) >= 3"""),
    "j04_gap_by_domain": _query("SELECT 'd' || (pair_id % 3) AS domain, count(*) AS n, avg(abs(p_pm - p_k)) AS mean_abs FROM al GROUP BY 1", "mean_abs"),
    "j04_gap_by_quality": _query("SELECT CASE WHEN pair_id % 4 = 0 THEN 'approx' ELSE 'exact' END AS quality, count(*) AS n, avg(abs(p_pm - p_k)) AS mean_abs FROM al GROUP BY 1", "mean_abs"),
    "j01_bar_backed": _query("SELECT key, volume FROM cat WHERE key IN (select key FROM daily WHERE close > 0.5)", "volume"),
    "j02_pairs": _query(TEXTS + f""",
x1 AS (SELECT *, i % 5 AS kind, i % 12 AS m, i // 60 % 4 AS b, (i // 5 % 4 + 9) * 10000 AS strike, {MONTHS}[i % 12 + 1] AS mon FROM x0),
kf AS (SELECT m, b, mon, max(v) AS v FROM x1 WHERE kind = 0 GROUP BY ALL),
x2 AS (SELECT 'fed_decision' AS domain, x1.mon || '25-' || (['H0', 'C25', 'C26', 'H25PLUS'])[x1.b + 1] AS unit, 'KXFEDDECISION-25' || x1.mon || '-' || (['H0', 'C25', 'C26', 'H25'])[x1.b + 1] AS k_key, 'p' || i AS pm_key, kf.v AS k_vol, x1.v + i % 3 AS pm_vol, CASE WHEN x1.b = 3 THEN 'approx' ELSE 'exact' END AS quality FROM x1 JOIN kf ON x1.m = kf.m AND x1.b = kf.b WHERE kind = 0
 UNION ALL (select 'fed_chair_nom', 'Person ' || (p.i // 10), 'NOM-' || k.i, 'p' || p.i, k.v, p.v + p.i % 3, 'exact' FROM x1 p JOIN x1 k ON p.kind = 1 AND k.kind = 1 AND p.i // 10 = k.i // 10)
 UNION ALL (select 'btc_monthly', p.mon || '25-' || (p.strike // 10 * 10), 'KXBTCMAXMON-BTC-25' || p.mon || '31-' || p.strike, 'p' || p.i, k.v, p.v + p.i % 3, 'exact' FROM x1 p JOIN (select m, strike, max(v) AS v FROM x1 WHERE kind = 2 GROUP BY ALL) k ON p.kind = 2 AND p.m = k.m AND p.strike = k.strike)
 UNION ALL (select 'btc_yearly', 'Y25-' || p.strike, 'KXBTCMAXY-25-DEC31-' || k.i, 'p' || p.i, k.v, p.v + p.i % 3, 'approx' FROM x1 p JOIN x1 k ON p.kind = 3 AND k.kind = 3 AND p.strike = k.strike)
 UNION ALL (select 'election', (['PRES24-Harris', 'PRES24-Trump', 'POPVOTE24-D', 'POPVOTE24-R', 'NYC25-Mamdani/D', 'NYC25-Cuomo', 'NYC25-Sliwa/R'])[h + 1], (['PRES-2024-KH', 'PRES-2024-DJT', 'POPVOTE-24-D', 'POPVOTE-24-R', 'KXMAYORNYCPARTY-25-D', 'KXMAYORNYCPARTY-25-AC', 'KXMAYORNYCPARTY-25-R'])[h + 1],
   arg_min('p' || i, (-(v + i % 3), 'p' || i)), max(v), max(v + i % 3), CASE WHEN h < 4 THEN 'exact' ELSE 'approx' END FROM (select *, i // 5 % 7 AS h FROM x1 WHERE kind = 4) GROUP BY h))
SELECT row_number() OVER (ORDER BY domain, unit, k_key, pm_key) - 1 AS pair_id, * FROM x2""", "k_vol pm_vol"),
    "j03_aligned": _query("SELECT pair_id, ts, p_k, p_pm FROM al"),
    "j04_gap_stats": _query("""x0 AS (SELECT *, p_k - p_pm AS g FROM al),
x1 AS (SELECT *, g - avg(g) OVER (PARTITION BY pair_id) AS d FROM x0),
x2 AS (SELECT *, lag(d) OVER (PARTITION BY pair_id ORDER BY ts) AS d1 FROM x1),
x3 AS (SELECT count(*) AS n, avg(abs(g)) AS mean_abs, median(abs(g)) AS median_abs, sqrt(avg(g * g)) AS rms, avg(CASE WHEN abs(g) > 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS share_wide, sum(d * d1) / nullif(sum(d1 * d1), 0) AS ar1 FROM x2)
SELECT *, CASE WHEN abs(ar1) < 1 AND ar1 <> 0 THEN ln(0.5::DOUBLE) / ln(abs(ar1)) END AS half_life FROM x3""", "mean_abs median_abs rms share_wide ar1 half_life"),
    "j06_paired_budget": _query("""x0 AS (SELECT *, p_k - lag(p_k) OVER w AS dk, p_pm - lag(p_pm) OVER w AS dm FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY ts)),
x1 AS (SELECT pair_id, sum(dk * dk) AS ss_k, sum(dm * dm) AS ss_pm, arg_min(p_k, ts) AS p0_k, arg_min(p_pm, ts) AS p0_pm, count(*) AS n FROM x0 GROUP BY pair_id),
x2 AS (SELECT *, p0_k * (1 - p0_k) AS bud_k, p0_pm * (1 - p0_pm) AS bud_pm FROM x1)
SELECT *, ss_k / bud_k AS ratio_k, ss_pm / bud_pm AS ratio_pm, ss_k / bud_k / nullif(ss_pm / bud_pm, 0) AS ratio_of_ratios FROM x2 WHERE bud_k > 1e-4 AND bud_pm > 1e-4""", "ss_k ss_pm bud_k bud_pm ratio_k ratio_pm ratio_of_ratios"),
    "j06_paired_summary": _query("""x0 AS (SELECT *, p_k - lag(p_k) OVER w AS dk, p_pm - lag(p_pm) OVER w AS dm FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY ts)),
x1 AS (SELECT sum(dk * dk) / (arg_min(p_k, ts) * (1 - arg_min(p_k, ts))) / nullif(sum(dm * dm) / (arg_min(p_pm, ts) * (1 - arg_min(p_pm, ts))), 0) AS r FROM x0 GROUP BY pair_id)
SELECT count(*) AS n, median(r) AS median_ratio, avg(CASE WHEN r > 1 THEN 1.0::DOUBLE WHEN r <= 1 THEN 0 END) AS share_above FROM x1""", "median_ratio share_above"),
    **{f"j07_paired_power{name}": _query(f"""x0 AS (SELECT {c} * (1 - {c}) AS pq, lead({c}) OVER (PARTITION BY pair_id ORDER BY ts) - {c} AS dp FROM al),
x1 AS (SELECT * FROM x0 WHERE dp IS NOT NULL AND pq > 1e-6),
x2 AS (SELECT list_distinct(quantile_cont(pq, [{", ".join(f"{k}/14.0" for k in range(15))}])) AS e FROM x1),
x3 AS (SELECT pq, dp, least(len(list_filter(e, lambda x: x <= pq)) - 1, len(e) - 2) AS qi FROM x1, x2),
x4 AS (SELECT avg(pq) AS level, avg(dp * dp) AS m, count(*) AS n FROM x3 GROUP BY qi)
SELECT CAST(sum(n) AS BIGINT) AS n_obs, count(*) FILTER (m > 0) AS bins, regr_slope(ln(m), ln(level)) FILTER (m > 0) AS gamma FROM x4""", "gamma") for name, c in (("", "p_k"), ("_pm", "p_pm"))},
    "j08_cross_correlation": _query("x0 AS (SELECT * FROM alm WHERE dk IS NOT NULL),\nx1 AS (SELECT *, " + ", ".join(f"lag(dm, {k}) OVER w AS m{k}, lag(dk, {k}) OVER w AS k{k}" for k in (1, 2, 3)) + " FROM x0 WINDOW w AS (PARTITION BY pair_id ORDER BY ts))\nSELECT * FROM (" + " UNION ALL ".join(f"(select {k}::BIGINT AS lag, corr({f'k{-k}' if k < 0 else 'dk'}, {f'm{k}' if k > 0 else 'dm'}) AS corr FROM x1)" for k in range(-3, 4)) + ")", "corr"),
    "j09_predictive": _query("""x0 AS (SELECT dm AS y, lag(dm) OVER w AS a, lag(dk) OVER w AS b FROM alm WHERE dk IS NOT NULL WINDOW w AS (PARTITION BY pair_id ORDER BY ts)),
x1 AS (SELECT * FROM x0 WHERE a IS NOT NULL AND b IS NOT NULL),
x2 AS (SELECT count(*) AS n, avg(a) AS am, avg(b) AS bm, avg(y) AS ym, covar_pop(a, a) AS saa, covar_pop(a, b) AS sab, covar_pop(b, b) AS sbb, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, covar_pop(y, y) AS syy FROM x1),
x3 AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS own, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cross_ FROM x2)
SELECT n, ym - own * am - cross_ * bm AS const, own, cross_ AS "cross", cross_ / sqrt((syy - own * say - cross_ * sby) / (n - 3) * saa / (saa * sbb - sab * sab)) AS t_cross FROM x3""", 'const own "cross" t_cross'),
    "k01_fingerprints": _query("SELECT * FROM fp", "tot2 max2 p0 " + FEATURES),
    "k03_standardised": _query("SELECT key, " + ", ".join(f"({c} - avg({c}) OVER ()) / greatest(stddev_pop({c}) OVER (), 1e-9) AS {c}" for c in FEATURES.split()[:5]) + " FROM fp", " ".join(FEATURES.split()[:5])),
    "k09_cluster_cards": _query(f"""x0 AS (SELECT key, pow(max(final) - arg_max(close, ts_days), 2) AS term FROM mk GROUP BY key),
x1 AS (SELECT fp.*, term, CAST(key AS BIGINT) % 3 AS cluster, 'c' || (CAST(key AS BIGINT) % 4) AS category, p0 * (1 - p0) AS x, tot2 + term AS y FROM fp JOIN x0 USING (key)),
x2 AS (SELECT cluster, category, count(*) AS n FROM x1 GROUP BY ALL),
x3 AS (SELECT cluster, max(n) / sum(n) AS top_cat_frac FROM x2 GROUP BY cluster),
x4 AS (SELECT cluster, category AS top_cat FROM x2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) = 1),
x5 AS (SELECT cluster, count(*) AS n_mkts, {", ".join(f"avg({c}) AS {c}" for c in FEATURES.split())}, {_slope("x", "y")[0]} AS budget_slope, {_slope("x", "y")[1]} AS budget_se, sum(term) / (sum(tot2) + sum(term) + 1e-12) AS term_share FROM x1 GROUP BY cluster)
SELECT x5.*, n_mkts / sum(n_mkts) OVER () AS share, top_cat, top_cat_frac FROM x5 JOIN x3 USING (cluster) JOIN x4 USING (cluster)""", FEATURES + " budget_slope budget_se term_share share top_cat_frac"),
    "k10_power_by_cluster": _query(_power("(SELECT *, CAST(key AS BIGINT) % 3 AS cluster FROM mv)", 5, by="cluster") + _fitted(by="cluster") + "\nSELECT * FROM f", "c gamma alpha"),
    "k07_adjusted_rand": _query("""x0 AS (SELECT CAST(key AS BIGINT) % 4 AS a, CAST(key AS BIGINT) % 6 AS b, count(*) AS n FROM cat GROUP BY ALL),
x1 AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x0) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM x0 GROUP BY a)) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM x0 GROUP BY b)) AS j, (SELECT sum(n) * (sum(n) - 1) / 2 FROM x0) AS t)
SELECT (ij - i * j / t) / nullif((i + j) / 2 - i * j / t, 0) AS ari FROM x1""", "ari"),
    "k08_categories": _query("""x0 AS (SELECT event_id AS event, event_type AS tag, 0 AS pos FROM events UNION ALL (select event_id, 'k' || (CAST(props::JSON->>'$.k' AS INTEGER) % 7), 1 FROM events)),
x1 AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n FROM x0),
x2 AS (SELECT event, tag FROM x1 QUALIFY row_number() OVER (PARTITION BY event ORDER BY n DESC, pos) = 1),
x3 AS (SELECT tag FROM x2 GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 4)
SELECT event, CASE WHEN tag IN (FROM x3) THEN tag ELSE 'other' END AS category FROM x2"""),
    "k12_intraday": _query(f"""x0 AS (SELECT *, {BUCKET.replace("p >=", "p_prev >=")} AS b FROM hp)
SELECT CAST(coalesce(b, -1) AS BIGINT) AS bucket, count(*) AS n, (sum(dp * dp) - sum(dm * dm)) / nullif(sum(dp * dp), 0) AS bounce_quote, -2 * (sum(dp * dp_next) FILTER (ok_next) / nullif(count(*) FILTER (ok_next), 0)) * count(*) / nullif(sum(dp * dp), 0) AS bounce_roll, 1 - pi() / 2 * sum(abs(dm * dm_next)) FILTER (ok_next) / nullif(sum(dm * dm) FILTER (ok_next), 0) AS jump_share_mid, avg(CASE WHEN dp = 0 THEN 1.0::DOUBLE ELSE 0 END) AS frac_zero FROM x0 GROUP BY ROLLUP (b)""", "bounce_quote bounce_roll jump_share_mid frac_zero"),
    "k13_signature": _query("""x0 AS (SELECT key, min(hour) AS t0, max(hour) AS t1 FROM hourly GROUP BY key),
x1 AS (SELECT key, sum(d * d) AS rv FROM (SELECT key, close - lag(close) OVER (PARTITION BY key ORDER BY hour) AS d FROM hourly) GROUP BY key),
x2 AS (SELECT key, close - lag(close) OVER (PARTITION BY key ORDER BY day) AS d FROM daily JOIN x0 USING (key) WHERE day BETWEEN t0 - INTERVAL 1 HOUR AND t1 + INTERVAL 1 HOUR),
x3 AS (SELECT key, sum(d * d) AS rv FROM x2 GROUP BY key)
SELECT key, x1.rv / x3.rv AS signature FROM x1 JOIN x3 USING (key) WHERE x3.rv > 0""", "signature"),
    "k14_daily_variance": _query("x0 AS (SELECT key, close - lag(close) OVER (PARTITION BY key ORDER BY day) AS m FROM daily)\nSELECT key, coalesce(sum(m * m), 0) AS rv FROM x0 GROUP BY key", "rv"),
    "k15_signature_quartiles": _query("""x0 AS (SELECT * FROM hourly QUALIFY count(*) OVER (PARTITION BY key) >= 8),
x1 AS (SELECT key, sum(d * d) AS rv, min(hour) AS t0, max(hour) AS t1 FROM (select *, close - lag(close) OVER (PARTITION BY key ORDER BY hour) AS d FROM x0) GROUP BY key),
x2 AS (SELECT key, close - lag(close) OVER (PARTITION BY key ORDER BY day) AS d FROM daily JOIN x1 USING (key) WHERE day BETWEEN t0 - INTERVAL 1 HOUR AND t1 + INTERVAL 1 HOUR),
x3 AS (SELECT key, x1.rv / q.rv AS s FROM x1 JOIN (select key, sum(d * d) AS rv FROM x2 GROUP BY key) q USING (key) WHERE q.rv > 0)
SELECT count(*) AS n, quantile_cont(s, 0.25) AS q25, median(s) AS med, quantile_cont(s, 0.75) AS q75 FROM x3""", "q25 med q75"),
    "k17_strip_bins": _query("SELECT * FROM sb", "lo hi prob"),
    "k20_iv_terms": _query(f"""x0 AS (SELECT series, list_distinct(quantile_cont(tau_days, [{", ".join(f"{k}/12.0" for k in range(13))}])) AS e FROM iv GROUP BY series),
x1 AS (SELECT iv.*, len(list_filter(e, lambda x: x <= tau_days)) AS bin FROM iv JOIN x0 USING (series))
SELECT series, bin, count(*) AS n, median(tau_days) AS tau, median(iv) AS med, quantile_cont(iv, 0.25) AS q25, quantile_cont(iv, 0.75) AS q75 FROM x1 GROUP BY ALL""", "tau med q25 q75"),
    "k26_iv_summary": _query("SELECT series, any_value(kind) AS kind, count(DISTINCT event) AS events, count(*) AS days, median(iv) AS med_iv, quantile_cont(iv, 0.25) AS q25, quantile_cont(iv, 0.75) AS q75, median(tau_days) AS med_tau, median(total) AS med_total_prob FROM iv GROUP BY series", "med_iv q25 q75 med_tau med_total_prob"),
    "k19_summary": _query("SELECT event, count(DISTINCT ts) AS units, count(*) AS n, quantile_cont(prob, 0.5) AS med, quantile_cont(prob, 0.25) AS q25, quantile_cont(prob, 0.75) AS q75 FROM lad GROUP BY event", "med q25 q75"),
    "k16_load_strips": _query("""x0 AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 <> 0 THEN (user_id % 11) / 2.0::DOUBLE END AS fs, CASE WHEN user_id % 8 = 0 THEN 1.5::DOUBLE END AS cs FROM ev WHERE user_id % 3 <> 1),
x1 AS (SELECT * FROM x0 WHERE fs IS NOT NULL OR cs IS NOT NULL),
x2 AS (SELECT user_id % 9 AS e FROM x1 GROUP BY 1 HAVING count(*) >= 5)
SELECT 'E' || e AS event, 'S' || (user_id % 3) AS series, 'S' || (user_id % 3) || '-' || key AS key, CASE WHEN user_id % 2 = 0 THEN 'greater' ELSE 'between' END AS strike_type, t_end AS "end", day AS ts, close, fs, cs FROM daily JOIN x1 USING (user_id) JOIN x2 ON e = user_id % 9 JOIN (select key AS k2, t_end FROM cat) c ON k2 = key""", "close fs cs"),
    "k22_claims": _query("SELECT name, quoted, value, coalesce(abs(value - quoted) <= tol, false) AS ok FROM (VALUES ('markets of venue 0', 5.0::DOUBLE, 1e9), ('markets of venue 1', -5.0::DOUBLE, 1.0), ('markets of venue 2', 0.0::DOUBLE, 1.0)) q(name, quoted, tol) LEFT JOIN (SELECT 'markets of venue ' || venue AS name, CAST(count(*) AS DOUBLE) AS value FROM cat GROUP BY venue) c USING (name)"),
    "k17_ladder_bins": _query("SELECT * FROM lad", "lo hi prob"),
    "k18_strip_moments": _query("SELECT * FROM sm", "total mean std tau_days iv_prop iv_norm"),
}
SQL["a36_universe_by_outcomes"] = f"""SELECT key, question, start, "end", closed, final_price, volume FROM ({SQL['a17_parse_markets']}) q WHERE NOT closed"""
