"""DuckDB SQL for the results of the catalog's queries."""

from __future__ import annotations

R = 6371000.0
#: Added before rounding, so that halves round alike in both engines.
TIE = 2.5e-10
FIX = """fix AS (SELECT event_id, user_id AS session_id, epoch_us(ts) // 1000 AS t_ms, event_type, value::DOUBLE AS value,
    48.0::DOUBLE + ((event_id * 37) % 1000)::DOUBLE / 100000.0::DOUBLE AS lat, 11.0::DOUBLE + ((event_id * 91) % 1000)::DOUBLE / 100000.0::DOUBLE AS lon,
    json_extract_string(props, '$.k')::DOUBLE * 3.6::DOUBLE AS heading FROM events)"""
W = "PARTITION BY session_id ORDER BY t_ms, event_id"
GATE = 3600000


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE + {TIE}::DOUBLE, 6) + 0.0::DOUBLE"


def hav(a: str, b: str, c: str, d: str) -> str:
    inner = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * {R}::DOUBLE * asin(sqrt(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {inner})))) END"


def east(lat: str, lon: str, radius: float = R) -> str:
    return f"radians({lon} - 11.0::DOUBLE) * {radius}::DOUBLE * cos(radians(48.0::DOUBLE))"


def north(lat: str, radius: float = R) -> str:
    return f"radians({lat} - 48.0::DOUBLE) * {radius}::DOUBLE"


NAN = "'nan'::DOUBLE"
MATCH = f"""pairs AS (SELECT g.event_id, g.session_id, g.t_ms, g.lat, g.lon, d.t_ms AS m_t_ms, d.lat AS m_lat, d.lon AS m_lon,
        row_number() OVER (PARTITION BY g.event_id ORDER BY abs(g.t_ms - d.t_ms), d.t_ms, d.event_id) AS r
    FROM fix g JOIN fix d ON g.session_id = d.session_id AND abs(g.t_ms - d.t_ms) <= {GATE} WHERE g.event_type = 'click' AND d.event_type = 'view'),
    matched AS (SELECT *, {hav('lat', 'lon', 'm_lat', 'm_lon')} AS error_m FROM pairs WHERE r = 1)"""
STEP = f"coalesce({hav(f'lag(lat) OVER ({W})', f'lag(lon) OVER ({W})', 'lat', 'lon')}, 0.0::DOUBLE)"
TAIL = "PARTITION BY session_id ORDER BY t_ms DESC, event_id DESC"


def decimated(source: str, most: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER ({W}) - 1 AS i, CASE WHEN s > 1 THEN greatest(greatest(1, n // {most}), floor(n::DOUBLE / (s * 5.0::DOUBLE))::BIGINT) ELSE greatest(1, n // {most}) END AS k
        FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, (max(t_ms) OVER (PARTITION BY session_id) - min(t_ms) OVER (PARTITION BY session_id))::DOUBLE / 1000 AS s FROM {source})) WHERE i % k = 0"""


def fold(columns: str, first: str, nxt: str, out: str) -> str:
    """A fold as a recursive walk over the row numbers of all sessions."""
    return f"""WITH RECURSIVE {FIX}, numbered AS (SELECT *, row_number() OVER ({W}) AS n FROM ({columns})),
    walk AS (SELECT session_id, n, event_id, {first} FROM numbered x WHERE n = 1
        UNION ALL SELECT x.session_id, x.n, x.event_id, {nxt} FROM walk w JOIN numbered x ON x.session_id = w.session_id AND x.n = w.n + 1)
    SELECT session_id, event_id, {out} FROM walk"""


PARTS = """parts AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) >= 32),
    cut AS (SELECT vec_id, v[1] AS a0, v[2] AS a1, v[3] AS a2, v[4] AS b0, v[5] AS b1, v[6] AS b2,
        v[7] / s AS x, v[8] / s AS y, v[9] / s AS z, v[10] / s AS w, v[11:19] AS m
        FROM (SELECT *, sqrt(v[7] * v[7] + v[8] * v[8] + v[9] * v[9] + v[10] * v[10]) AS s FROM parts))"""
ROT = ["1 - 2 * (y * y + z * z)", "2 * (x * y - z * w)", "2 * (x * z + y * w)", "2 * (x * y + z * w)", "1 - 2 * (x * x + z * z)", "2 * (y * z - x * w)", "2 * (x * z - y * w)", "2 * (y * z + x * w)", "1 - 2 * (x * x + y * y)"]


def product(a: list[str], b: list[str], i: int) -> str:
    r, c = divmod(i, 3)
    return " + ".join(f"({a[3 * r + k]}) * ({b[3 * k + c]})" for k in range(3))


K = ["0.0", "-a2", "a1", "a2", "0.0", "-a0", "-a1", "a0", "0.0"]
EXP = [f"{1.0 if i % 4 == 0 else 0.0}::DOUBLE + sin(t) / t * ({K[i]}) + (1 - cos(t)) / (t * t) * ({product(K, K, i)})" for i in range(9)]
CROSS = ["a1 * b2 - a2 * b1", "a2 * b0 - a0 * b2", "a0 * b1 - a1 * b0"]
# East is field (b) x gravity (a).
EAST = ["b1 * a2 - b2 * a1", "b2 * a0 - b0 * a2", "b0 * a1 - b1 * a0"]
NODES = "nodes AS (SELECT n_nationkey::BIGINT AS k, ((n_nationkey * 37) % 100)::DOUBLE AS east, ((n_nationkey * 53) % 90)::DOUBLE AS north FROM nation)"
EDGES = f"""{NODES}, links AS (SELECT k AS a, (k + h) % 25 AS b, k % 3 = 0 AS one FROM nodes, (VALUES (1), (7)) t(h)),
    edges AS (SELECT l.a, l.b, sqrt(pow(p.east - q.east, 2) + pow(p.north - q.north, 2)) AS cost, p.east AS ax, p.north AS ay, q.east AS bx, q.north AS by_
        FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links WHERE NOT one) l JOIN nodes p ON p.k = l.a JOIN nodes q ON q.k = l.b)"""
POINTS = "points AS (SELECT s_suppkey::BIGINT AS point_id, ((s_suppkey * 17) % 110)::DOUBLE AS east, ((s_suppkey * 29) % 95)::DOUBLE AS north, ((s_suppkey * 7) % 360)::DOUBLE AS heading FROM supplier)"
SEGMENTS = f"""line AS (SELECT session_id AS route_id, seg_no, {east('lat', 'lon')} AS ax, {north('lat')} AS ay FROM (SELECT *, (row_number() OVER ({W}))::INTEGER AS seg_no FROM fix WHERE event_type = 'click')),
    two AS (SELECT *, lead(ax) OVER (PARTITION BY route_id ORDER BY seg_no) AS bx, lead(ay) OVER (PARTITION BY route_id ORDER BY seg_no) AS by_ FROM line),
    seg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY route_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cum_s FROM (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM two WHERE bx IS NOT NULL))"""
TURN = "2 * pi()"
_USED, _FIRST, _JUMP = "x.accuracy <= 30", "w.e IS NULL", "(CASE WHEN w.e IS NULL THEN 0.0::DOUBLE ELSE sqrt(pow(x.e - w.e, 2) + pow(x.m - w.m, 2)) END)"
_OK = f"({_USED} AND ({_FIRST} OR {_JUMP} <= 3 * x.accuracy + 15 OR w.rejected >= 5))"
_K = "greatest(0.15::DOUBLE, least(1.0::DOUBLE, 5 / x.accuracy))"
GATED = [f"CASE WHEN NOT {_OK} THEN w.e WHEN {_FIRST} THEN x.e ELSE w.e + {_K} * (x.e - w.e) END, CASE WHEN NOT {_OK} THEN w.m WHEN {_FIRST} THEN x.m ELSE w.m + {_K} * (x.m - w.m) END, CASE WHEN {_OK} THEN 0 WHEN {_USED} THEN w.rejected + 1 ELSE w.rejected END, {_OK}, {_JUMP}"]
_AWAKE = "(x.t_ms - w.checked >= 7200000 AND x.t_ms >= w.until_)"
_MOVES = f"({_AWAKE} AND x.speed >= 1)"
_REF = f"(CASE WHEN {_MOVES} AND (w.ref IS NULL OR x.t_ms - w.ref_t >= 36000000) THEN x.heading ELSE w.ref END)"
_REF_T = f"(CASE WHEN {_MOVES} AND (w.ref IS NULL OR x.t_ms - w.ref_t >= 36000000) THEN x.t_ms ELSE w.ref_t END)"
_TURNED = f"(CASE WHEN {_MOVES} THEN abs(((x.heading - {_REF} + 180) % 360 + 360) % 360 - 180) ELSE 0.0::DOUBLE END)"
_FIRE = f"({_MOVES} AND x.value > 200 AND (w.cnt >= 3 OR {_TURNED} >= 30))"
OFF_ROUTE = f"""CASE WHEN x.t_ms - w.checked >= 7200000 THEN x.t_ms ELSE w.checked END, CASE WHEN {_FIRE} THEN x.t_ms + 72000000 ELSE w.until_ END,
    CASE WHEN {_FIRE} OR ({_AWAKE} AND x.speed < 1) OR ({_MOVES} AND x.value < 100) THEN 0 WHEN {_MOVES} AND x.value > 200 THEN w.cnt + 1 ELSE w.cnt END, {_REF}, {_REF_T}, {_FIRE}, {_TURNED}"""

SQL = {
    "session_stats": f"""WITH {FIX}, {MATCH}, errors AS (SELECT session_id, max_by(error_m, (t_ms, event_id)) AS final, max(error_m) AS worst, avg(error_m) AS mean, count(*) AS n FROM matched GROUP BY session_id),
        paths AS (SELECT session_id, sum(step) AS d FROM (SELECT session_id, {STEP} AS step FROM fix WHERE event_type = 'click') GROUP BY session_id)
        SELECT p.session_id, coalesce(n, 0)::BIGINT AS matches, {r6(f'coalesce(final, {NAN})')} AS current_error_m, {r6(f'coalesce(final, {NAN})')} AS final_error_m, {r6(f'coalesce(worst, {NAN})')} AS max_error_m,
        {r6(f'coalesce(mean, {NAN})')} AS mean_error_m, {r6('d')} AS distance_travelled_m, {r6(f'CASE WHEN final IS NULL OR d < 1e-6 THEN {NAN} ELSE final / d * 100 END')} AS drift_pct FROM paths p LEFT JOIN errors e USING (session_id)""",
    "nearest_match_error": f"WITH {FIX}, {MATCH} SELECT event_id, session_id, t_ms, m_t_ms, {r6('error_m')} AS error_m FROM matched",
    "running_distance": f"WITH {FIX}, s AS (SELECT *, {STEP} AS step FROM fix) SELECT event_id, {r6('step')} AS step_m, {r6(f'sum(step) OVER ({W})')} AS distance_m FROM s",
    "nav_export": f"""WITH {FIX}, {MATCH}, g AS (SELECT *, sum(step) OVER ({W}) AS d FROM (SELECT *, {STEP} AS step FROM fix WHERE event_type = 'click')), views AS (SELECT * FROM fix WHERE event_type = 'view'),
        dr AS (SELECT *, sum(step) OVER ({W}) AS d FROM (SELECT *, {STEP} AS step FROM ({decimated('views', 20000)})))
        SELECT g.session_id, 'gps' AS row_kind, g.t_ms, g.event_id, {r6('g.lat')} AS gps_lat, {r6('g.lon')} AS gps_lon, {r6('m_lat')} AS dr_lat, {r6('m_lon')} AS dr_lon, {r6(f'coalesce(error_m, {NAN})')} AS position_error_m, {r6('d')} AS distance_m,
        {r6(f'CASE WHEN error_m IS NULL OR d < 1e-6 THEN {NAN} ELSE error_m / d * 100 END')} AS drift_pct FROM g LEFT JOIN matched m USING (event_id)
        UNION ALL SELECT session_id, 'dr', t_ms, event_id, NULL, NULL, {r6('lat')}, {r6('lon')}, NULL, {r6('d')}, NULL FROM dr""",
    "zoh_align": f"""WITH {FIX}, h AS (SELECT *, {', '.join(f"last_value(CASE WHEN event_type = '{k}' THEN value END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h_{k}" for k in ('click', 'view', 'purchase'))} FROM fix)
        SELECT event_id, session_id, t_ms, h_click, h_view, h_purchase FROM h WHERE event_type IN ('click', 'view') AND h_click IS NOT NULL AND h_view IS NOT NULL""",
    "pose_resolution": f"""WITH {FIX}, asked AS (SELECT * FROM fix WHERE event_type NOT IN ('click', 'view')),
        g AS (SELECT a.event_id, f.lat, f.lon, f.heading, f.value, row_number() OVER (PARTITION BY a.event_id ORDER BY f.t_ms DESC, f.event_id) AS r FROM asked a JOIN fix f ON f.session_id = a.session_id AND f.event_type = 'click' AND f.t_ms > a.t_ms - {GATE} AND f.t_ms <= a.t_ms),
        d AS (SELECT a.event_id, f.lat, f.lon, f.heading, f.value, row_number() OVER (PARTITION BY a.event_id ORDER BY f.t_ms DESC, f.event_id) AS r FROM asked a JOIN fix f ON f.session_id = a.session_id AND f.event_type = 'view' AND f.t_ms <= a.t_ms)
        SELECT a.event_id, {r6('coalesce(g.lat, d.lat)')} AS pose_lat, {r6('coalesce(g.lon, d.lon)')} AS pose_lon, {r6('coalesce(d.heading, g.heading)')} AS pose_heading, {r6('coalesce(d.value, g.value, 0.0::DOUBLE)')} AS pose_speed, CASE WHEN g.lat IS NOT NULL THEN 'GPS' ELSE 'DR' END AS source
        FROM asked a LEFT JOIN (SELECT * FROM g WHERE r = 1) g USING (event_id) LEFT JOIN (SELECT * FROM d WHERE r = 1) d USING (event_id) WHERE coalesce(g.lat, d.lat) IS NOT NULL AND coalesce(d.heading, g.heading) IS NOT NULL""",
    "step_detect": f"""WITH {FIX}, m AS (SELECT *, avg(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean FROM fix), e AS (SELECT *, CASE WHEN value > mean + 20 THEN 1 WHEN value < mean - 20 THEN 0 END AS edge FROM m)
        SELECT event_id, coalesce(edge = 1 AND coalesce(last_value(edge IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0, false) AS is_step FROM e""",
    "stride_decimate": f"WITH {FIX} SELECT event_id, session_id, t_ms FROM ({decimated('fix', 20)})",
    "tail_points": f"WITH {FIX} SELECT event_id, session_id, t_ms FROM (SELECT *, row_number() OVER ({TAIL}) AS r FROM fix) WHERE r <= 10",
    "chunk_retention": f"WITH {FIX} SELECT event_id, session_id FROM (SELECT *, row_number() OVER ({TAIL}) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM fix) WHERE r <= CASE WHEN n <= 50 THEN n ELSE 50 + 1 - 7 + (n - 51) % 7 END",
    "greedy_throttle": fold("SELECT * FROM fix", "x.t_ms AS taken, true AS accepted", f"CASE WHEN x.t_ms - w.taken >= {12 * GATE} THEN x.t_ms ELSE w.taken END, x.t_ms - w.taken >= {12 * GATE}", "accepted"),
    "iir_lowpass": fold("SELECT * FROM fix", "x.value AS state", "w.state + 0.25::DOUBLE * (x.value - w.state)", f"{r6('state')} AS y"),
    "gnss_gate": fold(
        f"SELECT *, {east('lat', 'lon')} AS e, {north('lat')} AS m, greatest(1 + heading / 4, 1) AS accuracy FROM fix",
        "CASE WHEN x.accuracy <= 30 THEN x.e END AS e, CASE WHEN x.accuracy <= 30 THEN x.m END AS m, 0 AS rejected, x.accuracy <= 30 AS accepted, 0.0::DOUBLE AS jump",
        *GATED, f"accepted, {r6('jump')} AS jump_m, {r6(f'coalesce(e, {NAN})')} AS east, {r6(f'coalesce(m, {NAN})')} AS north"),
    "off_route_events": fold("SELECT *, value / 10 AS speed FROM fix",
        "x.t_ms AS checked, -1::BIGINT AS until_, CASE WHEN x.speed >= 1 AND x.value > 200 THEN 1 ELSE 0 END AS cnt, CASE WHEN x.speed >= 1 THEN x.heading END AS ref, CASE WHEN x.speed >= 1 THEN x.t_ms ELSE 0 END AS ref_t, false AS fire, 0.0::DOUBLE AS turn",
        OFF_ROUTE, f"CASE WHEN fire THEN 'RECALCULATE' ELSE 'HOLD' END AS decision, {r6('turn')} AS turn_deg"),
    "step_throttle": fold("SELECT *, value > 450 AS is_step FROM fix", "x.t_ms AS taken, true AS accepted", f"CASE WHEN x.is_step OR x.t_ms - w.taken >= {12 * GATE} THEN x.t_ms ELSE w.taken END, x.is_step OR x.t_ms - w.taken >= {12 * GATE}", "accepted"),
    "distance_decimate": fold(f"SELECT *, {east('lat', 'lon')} AS e, {north('lat')} AS m FROM fix", "CASE WHEN x.value >= 100 THEN x.e END AS e, CASE WHEN x.value >= 100 THEN x.m END AS m, x.value >= 100 AS kept",
        *[(lambda ok: f"CASE WHEN {ok} THEN x.e ELSE w.e END, CASE WHEN {ok} THEN x.m ELSE w.m END, {ok}")("(x.value >= 100 AND (w.e IS NULL OR sqrt(pow(x.e - w.e, 2) + pow(x.m - w.m, 2)) >= 300))")], "kept"),
    "rate_windows": fold("SELECT * FROM fix", f"x.t_ms AS began, 1 AS cnt, {NAN} AS hz", f"CASE WHEN x.t_ms - w.began >= 86400000 THEN x.t_ms ELSE w.began END, CASE WHEN x.t_ms - w.began >= 86400000 THEN 0 ELSE w.cnt + 1 END, CASE WHEN x.t_ms - w.began >= 86400000 THEN (w.cnt + 1) * 1000.0::DOUBLE / (x.t_ms - w.began) ELSE {NAN} END", f"{r6('hz')} AS hz"),
    "time_constant": fold(f"SELECT *, coalesce(greatest(0.001::DOUBLE, least(0.2::DOUBLE, (t_ms - lag(t_ms) OVER ({W}))::DOUBLE / 1e9)), 0.01::DOUBLE) AS dt FROM fix", "x.value AS state", "w.state + x.dt / (0.4::DOUBLE + x.dt) * (x.value - w.state)", f"{r6('state')} AS y"),
    "still_time": f"""WITH {FIX}, c AS (SELECT *, sum(CASE WHEN value < 250 THEN 0 ELSE 1 END) OVER ({W}) AS run_no FROM fix), r AS (SELECT *, sum(CASE WHEN value < 250 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY session_id, run_no ORDER BY t_ms, event_id) AS s FROM c)
        SELECT event_id, {r6('s')} AS still_s, s >= 1.2::DOUBLE AND (heading / 100 < 1.2::DOUBLE OR s >= 2.5::DOUBLE) AS stationary FROM r""",
    "nearest_gate": f"""WITH {FIX}, f AS (SELECT * REPLACE ((row_number() OVER ({W})) * 500 AS t_ms) FROM fix), p AS (SELECT g.event_id, g.t_ms, g.lat, g.lon, d.t_ms AS m_t_ms, d.lat AS m_lat, d.lon AS m_lon, row_number() OVER (PARTITION BY g.event_id ORDER BY abs(g.t_ms - d.t_ms), d.t_ms) AS r
        FROM f g JOIN f d ON g.session_id = d.session_id AND abs(g.t_ms - d.t_ms) <= 2000 WHERE g.event_type = 'click' AND d.event_type = 'view') SELECT event_id, t_ms, m_t_ms, {r6(hav('lat', 'lon', 'm_lat', 'm_lon'))} AS error_m FROM p WHERE r = 1""",
    "session_seed": f"""WITH {FIX}, {', '.join(f"{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_ms DESC, event_id DESC) AS r FROM fix WHERE event_type = '{k}') WHERE r = 1)" for n, k in (('p', 'purchase'), ('c', 'click')))},
        h AS (SELECT s.session_id, p.lat AS plat, p.lon AS plon, c.lat AS clat, c.lon AS clon, coalesce(CASE WHEN p.heading > 90 THEN p.heading END, (s.session_id % 360)::DOUBLE) AS heading, coalesce(p.value, 0) AS v FROM (SELECT DISTINCT session_id FROM fix) s LEFT JOIN p USING (session_id) LEFT JOIN c USING (session_id))
        SELECT session_id, {r6('coalesce(plat, clat, 16.3067)')} AS lat, {r6('coalesce(plon, clon, 80.4365)')} AS lon, {r6('heading')} AS heading, {r6('v * sin(radians(heading))')} AS vel_east, {r6('v * cos(radians(heading))')} AS vel_north, CASE WHEN plat IS NOT NULL THEN 'last' WHEN clat IS NOT NULL THEN 'cached' ELSE 'default' END AS seed_source FROM h""",
    "matrix_functions": f"""WITH {PARTS}, a AS (SELECT *, sqrt(m[1] * m[1] + m[2] * m[2] + m[3] * m[3]) AS n1 FROM cut), b AS (SELECT *, m[1] / n1 AS u1, m[2] / n1 AS u2, m[3] / n1 AS u3 FROM a), c AS (SELECT *, m[4] * u1 + m[5] * u2 + m[6] * u3 AS d FROM b), e AS (SELECT *, m[4] - d * u1 AS w1, m[5] - d * u2 AS w2, m[6] - d * u3 AS w3 FROM c), g AS (SELECT *, sqrt(w1 * w1 + w2 * w2 + w3 * w3) AS n2 FROM e)
        SELECT vec_id, {r6('m[4]')} AS t1, {r6('m[7]')} AS t2, {r6('m[8]')} AS t5, {', '.join(f"{r6(f'u{i + 1}')} AS o{i}" for i in range(3))}, {', '.join(f"{r6(f'w{i + 1} / n2')} AS o{i + 3}" for i in range(3))},
        {r6(f'degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {ROT[7]}))))')} AS pitch, {r6(f'degrees(atan2(-({ROT[6]}), {ROT[8]}))')} AS roll FROM g""",
    "filter_functions": f"""WITH {FIX}, g AS (SELECT *, (t_ms - lag(t_ms) OVER ({W}))::DOUBLE / 1e7 AS gap, first_value(heading) OVER ({W}) AS h0, greatest(coalesce(CASE WHEN heading > 20 THEN heading / 5 END, 5.0::DOUBLE), 1.0::DOUBLE) AS acc FROM fix)
        SELECT event_id, {r6('CASE WHEN gap IS NULL OR gap <= 0 OR gap > 0.2::DOUBLE THEN 0.01::DOUBLE ELSE gap END')} AS glitch, {r6('CASE WHEN gap IS NULL THEN 0.01::DOUBLE ELSE greatest(0.001::DOUBLE, least(0.2::DOUBLE, gap)) END')} AS clamp, {r6('CASE WHEN gap > 0 AND gap < 5 THEN gap ELSE 0.0::DOUBLE END')} AS elapsed,
        {r6('((heading - h0) % 360 + 360) % 360')} AS mount, {r6('CASE WHEN acc <= 30 THEN acc END')} AS accuracy, event_type <> 'view' OR value <= 200 AS may, t_ms // 1000 AS whole_s FROM g""",
    "rate_hz": f"WITH {FIX} SELECT session_id, (t_ms // 86400000) * 86400000 AS window_ms, count(*) AS n, {r6('count(*) * 1000.0::DOUBLE / 86400000')} AS hz FROM fix GROUP BY 1, 2",
    "session_counts": f"WITH {FIX} SELECT session_id, count(*) AS n_rows, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM fix GROUP BY 1",
    "geo_functions": f"""WITH {FIX}, moved AS (SELECT *, lat + degrees(value / 2 / {R}::DOUBLE) AS mlat, lon + degrees(value / ({R}::DOUBLE * cos(radians(lat)))) AS mlon, (heading - value) % 360 AS d FROM fix),
        t AS (SELECT *, CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS turn_ FROM moved)
        SELECT event_id, {r6(hav('lat', 'lon', '48.0::DOUBLE', '11.0::DOUBLE'))} AS hav_m, {r6('mlat')} AS moved_lat, {r6('mlon')} AS moved_lon, {r6(f'radians(mlon - lon) * {R}::DOUBLE * cos(radians(lat))')} AS back_east, {r6(f'radians(mlat - lat) * {R}::DOUBLE')} AS back_north,
        {r6(east('lat', 'lon', 6378137.0))} AS wide_east, {r6('(lat - 48.0::DOUBLE) * 110540.0::DOUBLE')} AS flat_north, {r6('((heading - 500) % 360 + 360) % 360')} AS normal, {r6('turn_')} AS turn, {r6('abs(turn_)')} AS abs_turn,
        {r6('(degrees(atan2(value - 250, heading - 180)) + 360) % 360')} AS bearing, {r6(f'CASE WHEN heading < 1e-6 THEN {NAN} ELSE value / heading * 100 END')} AS drift, {r6('((90 - degrees(value / 100)) % 360 + 360) % 360')} AS compass, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid FROM t""",
    "rotation_functions": f"""WITH {PARTS} SELECT vec_id, {', '.join(f"{r6(' + '.join(f'({ROT[3 * i + c]}) * a{c}' for c in range(3)))} AS turned{i}" for i in range(3))}, {', '.join(f"{r6(' + '.join(f'({ROT[3 * c + i]}) * a{c}' for c in range(3)))} AS back{i}" for i in range(3))},
        {', '.join(f"{r6(f'-9.80665::DOUBLE * ({ROT[6 + i]})')} AS down{i}" for i in range(3))}, {r6(f'(degrees(atan2({ROT[1]}, {ROT[4]})) + 360) % 360')} AS yaw, {r6('sqrt(a0 * a0 + a1 * a1 + a2 * a2)')} AS length FROM cut""",
    "vector_functions": f"""WITH {PARTS}, k AS (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS t FROM cut), e AS (SELECT *, {', '.join(f'{x} AS e{i}' for i, x in enumerate(EXP))} FROM k)
        SELECT vec_id, {', '.join(f'{r6(x)} AS cross{i}' for i, x in enumerate(CROSS))}, {', '.join(f"{r6(f'CASE WHEN t > 0.1::DOUBLE THEN a{i} * 0.1::DOUBLE / t ELSE a{i} END')} AS short{i}" for i in range(3))}, {', '.join(f"{r6(f'e{i}')} AS exp{i}" for i in range(9))},
        {', '.join(f"{r6(product([f'e{j}' for j in range(9)], [f'm[{j + 1}]' for j in range(9)], i))} AS prod{i}" for i in (0, 4, 8))}, {r6('a0 * b0 + a1 * b1 + a2 * b2')} AS dot FROM e""",
    "heading_functions": f"""WITH {PARTS}, h AS (SELECT *, {', '.join(f'{x} AS h{i}' for i, x in enumerate(EAST))}, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS g, a0 * 20 AS p, b0 * 20 AS q FROM cut), n AS (SELECT *, sqrt(h0 * h0 + h1 * h1 + h2 * h2) AS s FROM h),
        f AS (SELECT *, 0.02::DOUBLE * (CASE WHEN p < 0 THEN p % ({TURN}) ELSE p END) + 0.98::DOUBLE * (CASE WHEN q < 0 THEN q % ({TURN}) ELSE q END) AS mix FROM n)
        SELECT vec_id, {r6(f'CASE WHEN s < 1e-6 OR g < 1e-6 THEN {NAN} ELSE atan2((a2 * h0 - a0 * h2) / (g * s), h1 / s) END')} AS mag, {r6('CASE WHEN mix > pi() THEN mix % pi() - pi() ELSE mix END')} AS fused FROM f""",
    "gyro_chain": f"""WITH {FIX}, b AS (SELECT *, value / 1000 AS rate, row_number() OVER ({W}) AS n, (t_ms - lag(t_ms) OVER ({W}))::DOUBLE / 1e9 AS gap FROM fix), c AS (SELECT *, avg(CASE WHEN n <= 20 THEN rate END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bias, CASE WHEN gap <= 0 OR gap > 0.2::DOUBLE THEN 0.01::DOUBLE ELSE gap END AS dt FROM b)
        SELECT event_id, {r6('bias')} AS bias, {r6('dt')} AS dt, {r6('coalesce((CASE WHEN abs(rate - bias) <= 0.0025::DOUBLE THEN 0.0::DOUBLE ELSE rate - bias END) * dt, 0.0::DOUBLE)')} AS delta FROM c""",
    "standstill_runs": f"""WITH {FIX}, c AS (SELECT *, (sum(CASE WHEN value < 250 THEN 0 ELSE 1 END) OVER ({W}))::BIGINT AS run_no FROM fix), r AS (SELECT *, (sum(CASE WHEN value < 250 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, run_no ORDER BY t_ms, event_id))::BIGINT AS run_rows FROM c)
        SELECT event_id, run_no, run_rows, run_rows >= 3 AS still FROM r""",
    "baseline_dr": f"""WITH {FIX}, a AS (SELECT *, sum(value / 100 * sin(radians(heading)) * 0.01::DOUBLE) OVER ({W}) AS ve, sum(value / 100 * cos(radians(heading)) * 0.01::DOUBLE) OVER ({W}) AS vn, count(*) OVER ({W}) AS n FROM fix)
        SELECT event_id, {r6('ve')} AS vel_east, {r6('vn')} AS vel_north, {r6(f'sum(ve * 0.01::DOUBLE) OVER ({W})')} AS x_east, {r6(f'sum(vn * 0.01::DOUBLE) OVER ({W})')} AS y_north, {r6('2 + 0.5::DOUBLE * n * 0.01::DOUBLE')} AS confidence_m FROM a""",
    "arc_length": f"WITH {FIX}, {SEGMENTS} SELECT route_id, seg_no, {r6('len')} AS len, {r6('cum_s')} AS cum_s FROM seg",
    "polyline_match": f"""WITH {FIX}, {SEGMENTS}, p AS (SELECT event_id, session_id AS route_id, {east('lat', 'lon')} AS e, {north('lat')} AS n FROM fix WHERE event_type = 'view'),
        j AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN len = 0 THEN 0.0::DOUBLE ELSE ((e - ax) * (bx - ax) + (n - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)) END)) AS t FROM p JOIN seg USING (route_id)),
        k AS (SELECT *, sqrt(pow(e - ax - t * (bx - ax), 2) + pow(n - ay - t * (by_ - ay), 2)) AS off FROM j), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(off, 6), seg_no) AS r FROM k)
        SELECT event_id, seg_no, {r6('round(off, 6)')} AS distance_m, {r6('(degrees(atan2(bx - ax, by_ - ay)) + 360) % 360')} AS bearing, {r6('cum_s + t * len')} AS route_s FROM b WHERE r = 1""",
    "graph_edges": f"WITH {EDGES} SELECT a, b, {r6('cost')} AS cost FROM edges",
    "road_snap": f"""WITH {EDGES}, {POINTS}, j AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((east - ax) * (bx - ax) + (north - ay) * (by_ - ay)) / (cost * cost))) AS t FROM points, edges WHERE sqrt(pow(ax - east, 2) + pow(ay - north, 2)) <= 30 AND cost > 1e-6),
        k AS (SELECT *, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py FROM j), s AS (SELECT *, sqrt(pow(east - px, 2) + pow(north - py, 2)) AS off, ((bx - ax) * sin(radians(heading)) + (by_ - ay) * cos(radians(heading))) / cost AS align FROM k),
        b AS (SELECT *, off - 150 * align AS score, row_number() OVER (PARTITION BY point_id ORDER BY off - 150 * align, a, b) AS r FROM s WHERE off <= 30) SELECT point_id, a, b, {r6('score')} AS score, {r6('px')} AS px, {r6('py')} AS py FROM b WHERE r = 1""",
    "nearest_node": f"""WITH {NODES}, {POINTS}, j AS (SELECT point_id, k AS node_id, sqrt(pow(p.east - n.east, 2) + pow(p.north - n.north, 2)) AS off FROM points p, nodes n), b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY off, node_id) AS r FROM j WHERE off <= 40)
        SELECT point_id, node_id, {r6('off')} AS off FROM b WHERE r = 1""",
    "shortest_path": f"""WITH RECURSIVE {EDGES}, walk AS (SELECT k AS source, k AS node, 0.0::DOUBLE AS dist, 0 AS hops FROM nodes
        UNION ALL SELECT source, node, min(dist), hops FROM (SELECT w.source, e.b AS node, w.dist + e.cost AS dist, w.hops + 1 AS hops FROM walk w JOIN edges e ON e.a = w.node WHERE w.hops < 12) GROUP BY source, node, hops)
        SELECT source, node, {r6('min(dist)')} AS dist FROM walk GROUP BY source, node""",
    "heading_route": f"""WITH RECURSIVE {EDGES}, {POINTS}, j AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((east - ax) * (bx - ax) + (north - ay) * (by_ - ay)) / (cost * cost))) AS t FROM points, edges WHERE sqrt(pow(ax - east, 2) + pow(ay - north, 2)) <= 30 AND cost > 1e-6),
        k AS (SELECT *, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py FROM j), s AS (SELECT *, sqrt(pow(east - px, 2) + pow(north - py, 2)) AS off, ((bx - ax) * sin(radians(heading)) + (by_ - ay) * cos(radians(heading))) / cost AS align FROM k),
        snap AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY off - 150 * align, a, b) AS r FROM s WHERE off <= 30), ahead AS (SELECT point_id, b, px, py FROM snap WHERE r = 1 AND align >= -0.3::DOUBLE),
        near AS (SELECT point_id, k AS node_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(pow(p.east - n.east, 2) + pow(p.north - n.north, 2)), k) AS r FROM points p, nodes n),
        goal AS (SELECT k AS g FROM nodes ORDER BY sqrt(pow(east - 50, 2) + pow(north - 45, 2)), k LIMIT 1), pick AS (SELECT point_id, coalesce(b, node_id) AS source, px, py FROM near LEFT JOIN ahead USING (point_id) WHERE r = 1),
        walk AS (SELECT k AS source, k AS node, 0.0::DOUBLE AS dist, 0 AS hops FROM nodes
        UNION ALL SELECT source, node, min(dist), hops FROM (SELECT w.source, e.b AS node, w.dist + e.cost AS dist, w.hops + 1 AS hops FROM walk w JOIN edges e ON e.a = w.node WHERE w.hops < 12) GROUP BY source, node, hops),
        far AS (SELECT source, node, min(dist) AS dist FROM walk GROUP BY source, node)
        SELECT point_id, source, {r6('px')} AS px, {r6('py')} AS py, g AS node, {r6('dist')} AS dist, false AS fallback FROM pick JOIN goal ON true JOIN far USING (source) WHERE node = g""",
    "route_points": f"""WITH RECURSIVE {EDGES}, {POINTS}, j AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((east - ax) * (bx - ax) + (north - ay) * (by_ - ay)) / (cost * cost))) AS t FROM points, edges WHERE sqrt(pow(ax - east, 2) + pow(ay - north, 2)) <= 30 AND cost > 1e-6),
        k AS (SELECT *, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py FROM j), s AS (SELECT *, sqrt(pow(east - px, 2) + pow(north - py, 2)) AS off, ((bx - ax) * sin(radians(heading)) + (by_ - ay) * cos(radians(heading))) / cost AS align FROM k),
        snap AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY off - 150 * align, a, b) AS r FROM s WHERE off <= 30), ahead AS (SELECT point_id, b, px, py FROM snap WHERE r = 1 AND align >= -0.3::DOUBLE),
        near AS (SELECT point_id, k AS node_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(pow(p.east - n.east, 2) + pow(p.north - n.north, 2)), k) AS r FROM points p, nodes n),
        goal AS (SELECT k AS g FROM nodes ORDER BY sqrt(pow(east - 50, 2) + pow(north - 45, 2)), k LIMIT 1), pick AS (SELECT point_id, coalesce(b, node_id) AS source, px, py FROM near LEFT JOIN ahead USING (point_id) WHERE r = 1),
        walk AS (SELECT k AS source, k AS node, 0.0::DOUBLE AS dist, 0 AS hops FROM nodes
        UNION ALL SELECT source, node, min(dist), hops FROM (SELECT w.source, e.b AS node, w.dist + e.cost AS dist, w.hops + 1 AS hops FROM walk w JOIN edges e ON e.a = w.node WHERE w.hops < 12) GROUP BY source, node, hops),
        far AS (SELECT source, node, min(dist) AS dist FROM walk GROUP BY source, node),
        prev AS (SELECT t.source, t.node, min(e.a) AS prev FROM far t JOIN edges e ON e.b = t.node JOIN far f ON f.source = t.source AND f.node = e.a WHERE t.node <> t.source AND abs(f.dist + e.cost - t.dist) < 1e-9 GROUP BY 1, 2),
        back AS (SELECT point_id, source, g AS node, 0 AS k FROM pick JOIN goal ON true UNION ALL SELECT b.point_id, b.source, p.prev, b.k + 1 FROM back b JOIN prev p ON p.source = b.source AND p.node = b.node),
        lone AS (SELECT b.point_id, (max(b.k) OVER (PARTITION BY b.point_id) - b.k + CASE WHEN p.px IS NULL THEN 0 ELSE 1 END)::INTEGER AS i, n.east, n.north FROM back b JOIN nodes n ON n.k = b.node JOIN pick p ON p.point_id = b.point_id)
        SELECT point_id, i, {r6('east')} AS east, {r6('north')} AS north FROM (SELECT * FROM lone UNION ALL SELECT point_id, 0, px, py FROM pick WHERE px IS NOT NULL)""",
    "live_snapshot": f"""WITH {FIX}, {MATCH}, errors AS (SELECT session_id, max_by(error_m, (t_ms, event_id)) AS final FROM matched GROUP BY session_id), paths AS (SELECT session_id, sum(step) AS d FROM (SELECT session_id, {STEP} AS step FROM fix WHERE event_type = 'click') GROUP BY session_id),
        {', '.join(f"{n} AS (SELECT session_id, count(*) AS n, max_by(lat, (t_ms, event_id)) AS lat, max_by(lon, (t_ms, event_id)) AS lon FROM fix WHERE event_type = '{k}' GROUP BY session_id)" for n, k in (('g', 'click'), ('d', 'view')))}
        SELECT coalesce(g.session_id, d.session_id) AS session_id, coalesce(g.n, 0) AS n_gps, coalesce(d.n, 0) AS n_dr, {r6('g.lat')} AS gps_lat, {r6('g.lon')} AS gps_lon, {r6('d.lat')} AS dr_lat, {r6('d.lon')} AS dr_lon, {r6('coalesce(g.lat, d.lat)')} AS follow_lat, {r6('coalesce(g.lon, d.lon)')} AS follow_lon,
        {r6(f'CASE WHEN p.d IS NOT NULL THEN coalesce(final, {NAN}) END')} AS current_error_m, {r6('p.d')} AS distance_travelled_m FROM g FULL JOIN d ON g.session_id = d.session_id LEFT JOIN paths p ON p.session_id = coalesce(g.session_id, d.session_id) LEFT JOIN errors e ON e.session_id = p.session_id""",
    "route_synthesis": f"""WITH p AS (SELECT s_suppkey::BIGINT AS point_id, ((s_suppkey * 17) % 1100)::DOUBLE AS e, ((s_suppkey * 29) % 950)::DOUBLE AS n FROM supplier), s AS (SELECT *, greatest(2, least(2000, floor(sqrt(pow(500 - e, 2) + pow(500 - n, 2)) / 10)))::INTEGER AS steps FROM p),
        x AS (SELECT *, unnest(range(0, steps + 1))::INTEGER AS i FROM s) SELECT point_id, i, {r6('e + (500 - e) * i / steps')} AS east, {r6('n + (500 - n) * i / steps')} AS north FROM x""",
    "health_text": f"""WITH {FIX}, s AS (SELECT session_id, count(*) AS n, round(max(value), 1) AS top, count(*) FILTER (heading > 180) AS back FROM fix GROUP BY 1), t AS (SELECT *, concat_ws(' | ', 'rows ' || n, CASE WHEN back > 0 THEN 'turned ' || back END, CASE WHEN top > 480 THEN 'FAST @ limit' END) AS health FROM s)
        SELECT session_id, health, split_part(health, ' @', 1) AS short, trunc(top)::INTEGER AS top_whole FROM t""",
    "json_roundtrip": f"WITH {FIX} SELECT event_id, CASE WHEN abs(lat - 48.005::DOUBLE) <= 0.01::DOUBLE AND abs(lon - 11.005::DOUBLE) <= 0.01::DOUBLE THEN 1 ELSE 0 END AS n_points, t_ms AS stored_ms FROM fix",
}
_STATS = SQL["session_stats"]
SQL["status_texts"] = f"""WITH s AS ({_STATS}), b AS (WITH {FIX} SELECT session_id, min(t_ms) AS start_ms FROM fix GROUP BY 1)
    SELECT session_id, CASE WHEN isnan(max_error_m) THEN '—' ELSE printf('%.1f m', max_error_m) END AS worst, CASE WHEN isnan(drift_pct) THEN '—' ELSE printf('%.2f%%', drift_pct) END AS drift,
    concat_ws(' · ', 'waiting for GNSS', 'snap=FREE', CASE WHEN matches = 0 THEN 'ZUPT active' END, CASE WHEN matches > 1 THEN 'mount aligned' END) AS health, 'session_' || strftime(make_timestamp(start_ms * 1000), '%Y%m%d_%H%M%S') || '_nav.csv' AS file FROM s JOIN b USING (session_id)"""
#: Skew matrix of a sample's small rotation.
SMALL = ["0.0::DOUBLE", "-dz", "-dx", "dz", "0.0::DOUBLE", "dy", "dx", "-dy", "0.0::DOUBLE"]
SQL |= {
    "imu_export": f"""WITH {FIX}, m AS (SELECT *, (row_number() OVER ({W})) * 10000000 AS timestamp_nanos, (value - 250) / 100 AS push FROM fix)
        SELECT session_id, timestamp_nanos, {r6('push * sin(radians(heading))')} AS accel_x, {r6('push * cos(radians(heading))')} AS accel_y, {r6('9.80665::DOUBLE + (heading - 180) / 60')} AS accel_z,
        {r6('push / 100')} AS gyro_x, {r6('-push / 200')} AS gyro_y, {r6('(heading - 180) / 1000')} AS gyro_z, {r6('20 * cos(radians(heading))')} AS mag_x, {r6('20 * sin(radians(heading))')} AS mag_y, {r6('-40.0')} AS mag_z,
        {', '.join(f'NULL::DOUBLE AS {n}' for n in ('quat_x', 'quat_y', 'quat_z', 'quat_w', *(f'{s}_{x}' for s in ('linear', 'gravity') for x in 'xyz')))} FROM m""",
    "recorded_samples": f"""WITH {FIX}, v AS (SELECT session_id, t_ms, event_id, (['START', 'START', 'STOP', 'RESET', 'ENGINE_ON', 'START', 'ENGINE_ON', 'STOP', 'ENGINE_OFF', 'START'])[event_id % 10 + 1] AS verb FROM fix WHERE event_type = 'error'),
        a AS (SELECT *, coalesce(last_value(CASE WHEN verb = 'START' THEN 1 WHEN verb IN ('STOP', 'RESET') THEN 0 END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS is_on FROM v),
        b AS (SELECT *, is_on = 1 AND coalesce(lag(is_on) OVER ({W}), 0) = 0 AS begins FROM a),
        c AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS no, last_value(CASE WHEN begins THEN t_ms END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS began,
            coalesce(last_value(CASE WHEN verb = 'ENGINE_ON' AND is_on = 1 THEN true WHEN verb IN ('ENGINE_OFF', 'STOP', 'RESET') THEN false END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), false) AS engine FROM b),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, t_ms ORDER BY event_id DESC) AS r FROM c) WHERE r = 1),
        e AS (SELECT x.event_id, x.session_id, x.t_ms, d.no, d.began, d.engine FROM fix x ASOF JOIN d ON x.session_id = d.session_id AND x.t_ms >= d.t_ms WHERE x.event_type <> 'error' AND d.is_on = 1)
        SELECT event_id, no::BIGINT AS recording_no, row_number() OVER (PARTITION BY session_id, no ORDER BY t_ms, event_id) AS sample_no, t_ms - began AS since_ms, engine AS engine_on FROM e""",
    "route_choice": f"""WITH {FIX}, dest AS (SELECT session_id, t_ms, CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS dest FROM (SELECT *, row_number() OVER (PARTITION BY session_id, t_ms ORDER BY event_id DESC) AS r FROM fix WHERE event_type = 'purchase') WHERE r = 1),
        ask AS (SELECT session_id, t_ms, t_ms // 259200000 AS request_id, 1 + (t_ms // 259200000) % 3 AS dest, CASE WHEN event_id % 2 = 0 THEN 'online' ELSE 'offline' END AS source, event_id % 5 AS n_points FROM fix WHERE event_type = 'signup'),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, request_id ORDER BY source = 'offline', t_ms) AS r FROM ask) WHERE r = 1),
        told AS (SELECT o.session_id, o.t_ms, o.dest, o.source, o.request_id FROM one o ASOF JOIN dest d ON o.session_id = d.session_id AND o.t_ms >= d.t_ms WHERE o.n_points >= 2 AND d.dest = o.dest),
        line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, t_ms ORDER BY coalesce(request_id, -1) DESC) AS r FROM (SELECT * FROM told UNION ALL SELECT session_id, t_ms, dest, CASE WHEN dest IS NOT NULL THEN 'preview' END, NULL FROM dest)) WHERE r = 1)
        SELECT x.event_id, l.dest, l.source, l.request_id FROM fix x ASOF LEFT JOIN line l ON x.session_id = l.session_id AND x.t_ms >= l.t_ms WHERE x.event_type NOT IN ('purchase', 'signup')""",
    "road_catalog": f"""WITH {EDGES}, origins(graph_id, lat0, lon0) AS (VALUES (0, 48.0::DOUBLE, 11.0::DOUBLE), (1, 48.0005::DOUBLE, 11.0005::DOUBLE)),
        two AS (SELECT graph_id, lat0, lon0, a, b, cost, CASE WHEN graph_id = 0 THEN ax ELSE 100 - ax END AS ax, ay, CASE WHEN graph_id = 0 THEN bx ELSE 100 - bx END AS bx, by_ FROM edges, origins),
        points AS (SELECT s_suppkey::BIGINT AS point_id, 48.0::DOUBLE + ((s_suppkey * 29) % 150)::DOUBLE / 100000 AS lat, 11.0::DOUBLE + ((s_suppkey * 17) % 210)::DOUBLE / 100000 AS lon, ((s_suppkey * 7) % 360)::DOUBLE AS heading FROM supplier),
        i AS (SELECT *, radians(lon - lon0) * 6378137.0::DOUBLE * cos(radians(lat0)) AS east, radians(lat - lat0) * 6378137.0::DOUBLE AS north FROM points, two),
        j AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((east - ax) * (bx - ax) + (north - ay) * (by_ - ay)) / (cost * cost))) AS t FROM i WHERE sqrt(pow(ax - east, 2) + pow(ay - north, 2)) <= 30 AND cost > 1e-6),
        k AS (SELECT *, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py FROM j), s AS (SELECT *, sqrt(pow(east - px, 2) + pow(north - py, 2)) AS dist, ((bx - ax) * sin(radians(heading)) + (by_ - ay) * cos(radians(heading))) / cost AS align FROM k),
        b AS (SELECT *, dist - 150 * align AS score, row_number() OVER (PARTITION BY point_id ORDER BY dist - 150 * align, graph_id, a, b) AS r FROM s WHERE dist <= 30)
        SELECT point_id, graph_id::INTEGER AS graph_id, a, b, {r6('score')} AS score, {r6('dist')} AS off, {r6('lat0 + degrees(py / 6378137.0::DOUBLE)')} AS lat, {r6('lon0 + degrees(px / (6378137.0::DOUBLE * cos(radians(lat0))))')} AS lon FROM b WHERE r = 1""",
    "long_session": f"""WITH RECURSIVE {FIX.replace('fix AS', 'every AS')}, fix AS (SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN -1 ELSE session_id END AS session_id) FROM every),
        s AS (SELECT *, {STEP} AS step, avg(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS mean, value / 100 * sin(radians(heading)) AS ae, value / 100 * cos(radians(heading)) AS an, row_number() OVER ({W}) AS n FROM fix),
        e AS (SELECT *, CASE WHEN value > mean + 20 THEN 1 WHEN value < mean - 20 THEN 0 END AS edge, sum(ae * 0.01::DOUBLE) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ve, sum(an * 0.01::DOUBLE) OVER ({W} ROWS UNBOUNDED PRECEDING) AS vn FROM s),
        w AS (SELECT session_id, n, event_id, value AS y FROM s WHERE n = 1 UNION ALL SELECT x.session_id, x.n, x.event_id, w.y + 0.25::DOUBLE * (x.value - w.y) FROM w JOIN s x ON x.session_id = w.session_id AND x.n = w.n + 1),
        d AS (SELECT *, sum(step) OVER ({W} ROWS UNBOUNDED PRECEDING) AS dist, coalesce(last_value(edge IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latched,
            sum(ve * 0.01::DOUBLE) OVER ({W} ROWS UNBOUNDED PRECEDING) AS xe, sum(vn * 0.01::DOUBLE) OVER ({W} ROWS UNBOUNDED PRECEDING) AS yn FROM e)
        SELECT d.event_id, d.session_id, {r6('dist')} AS distance_m, coalesce(edge = 1 AND latched = 0, false) AS is_step, {r6('ve')} AS vel_east, {r6('vn')} AS vel_north, {r6('xe')} AS x_east, {r6('yn')} AS y_north, {r6('2 + 0.5::DOUBLE * n * 0.01::DOUBLE')} AS confidence_m, {r6('w.y')} AS y
        FROM d JOIN w USING (event_id, n)""",
    "imu_merge": f"""WITH {FIX}, v AS (SELECT *, value / 500 AS a, heading / 1000 AS b, lat - 48 AS c, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS k FROM fix),
        x AS (SELECT session_id, t_ms, k, CASE k WHEN 4 THEN [a, b, c] WHEN 5 THEN [b, c, a] WHEN 0 THEN [c, a, b] WHEN 1 THEN [a, c, b] WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN [a / 2, b, c, sqrt(greatest(0.0::DOUBLE, 1 - a / 2 * a / 2 - b * b - c * c))] ELSE [a, b, c, a] END END AS v FROM v),
        h AS (SELECT *, {', '.join(f"last_value(CASE WHEN k = {k} THEN v END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t_ms, k ROWS UNBOUNDED PRECEDING) AS {n}" for n, k in (("accel", 4), ("gyro", 5), ("mag", 0), ("quat", 3), ("linear", 1)))} FROM x)
        SELECT session_id, t_ms * 1000000 AS timestamp_nanos, CASE WHEN k = 4 THEN 'accel' ELSE 'gyro' END AS sensor, {', '.join(f"{r6(f'{n}[{i + 1}]')} AS {n}_{x}" for n in ("accel", "gyro", "mag", "quat", "linear") for i, x in enumerate("xyzw" if n == "quat" else "xyz"))}
        FROM h WHERE k >= 4 AND accel IS NOT NULL AND gyro IS NOT NULL""",
    "trail_match": f"""WITH RECURSIVE {FIX}, n AS (SELECT *, {east('lat', 'lon')} AS e, {north('lat')} AS m, row_number() OVER ({W}) AS n FROM fix),
        walk AS (SELECT session_id, n, CASE WHEN value >= 50 THEN e END AS e, CASE WHEN value >= 50 THEN m END AS m, value >= 50 AS kept FROM n WHERE n = 1
            UNION ALL SELECT x.session_id, x.n, CASE WHEN t THEN x.e ELSE w.e END, CASE WHEN t THEN x.m ELSE w.m END, t FROM (SELECT w.session_id, w.n, w.e, w.m, x.value >= 50 AND (w.e IS NULL OR sqrt(pow(x.e - w.e, 2) + pow(x.m - w.m, 2)) >= 60) AS t FROM walk w JOIN n x ON x.session_id = w.session_id AND x.n = w.n + 1) w JOIN n x ON x.session_id = w.session_id AND x.n = w.n + 1),
        r AS (SELECT n.*, k.kept, coalesce(sum(CASE WHEN k.kept THEN 1 ELSE 0 END) OVER (PARTITION BY n.session_id ORDER BY n.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, e - lag(e) OVER (PARTITION BY n.session_id ORDER BY n.n) AS we, m - lag(m) OVER (PARTITION BY n.session_id ORDER BY n.n) AS wn FROM n JOIN (SELECT session_id, n, kept FROM walk) k USING (session_id, n)),
        ed AS (SELECT * FROM (SELECT session_id, before + 1 AS edge, e AS bx, m AS by_, lag(e) OVER (PARTITION BY session_id ORDER BY n) AS ax, lag(m) OVER (PARTITION BY session_id ORDER BY n) AS ay FROM r WHERE kept) WHERE ax IS NOT NULL AND sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) >= 1e-6),
        j AS (SELECT r.session_id, r.n, r.e, r.m, r.heading, r.we, r.wn, ed.*, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM r JOIN ed ON r.session_id = ed.session_id AND ed.edge <= r.before AND ed.edge > r.before - 1999),
        k AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((e - ax) * (bx - ax) + (m - ay) * (by_ - ay)) / (len * len))) AS t, (bx - ax) / len AS ux, (by_ - ay) / len AS uy FROM j),
        s AS (SELECT *, sqrt(pow(e - ax - t * (bx - ax), 2) + pow(m - ay - t * (by_ - ay), 2)) AS dist, ux * sin(radians(heading)) + uy * cos(radians(heading)) AS align FROM k),
        b AS (SELECT *, row_number() OVER (PARTITION BY session_id, n ORDER BY round(dist - 10 * abs(align), 9), edge) AS r FROM s WHERE dist <= 50 AND abs(align) >= 0.5
            AND (we IS NULL OR sqrt(we * we + wn * wn) < 300 OR abs((ux * we + uy * wn) / sqrt(we * we + wn * wn)) >= 0.5))
        SELECT session_id, n::INTEGER AS row_no, edge::BIGINT AS edge_no, {r6('dist')} AS off, align < 0 AS reversed FROM b WHERE r = 1""",
    "route_windowed": f"""WITH RECURSIVE {FIX}, {SEGMENTS}, p AS (SELECT session_id AS route_id, row_number() OVER ({W}) AS n, {east('lat', 'lon')} AS e, {north('lat')} AS m FROM fix WHERE event_type = 'view'),
        j AS (SELECT p.route_id, n, e, m, seg_no, ax, ay, bx, by_, cum_s, len, ((e - ax) * (bx - ax) + (m - ay) * (by_ - ay)) / (len * len) AS raw FROM p JOIN seg USING (route_id) WHERE len >= 1e-6),
        k AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)) AS t FROM j WHERE raw BETWEEN -0.05 AND 1.05),
        c AS (SELECT *, round(sqrt(pow(e - ax - t * (bx - ax), 2) + pow(m - ay - t * (by_ - ay), 2)), 9) AS dist, cum_s + t * len AS s FROM k),
        l AS (SELECT route_id, n, list_sort(list({{'d': dist, 'g': seg_no, 's': s}})) AS ways FROM c WHERE dist <= 60 GROUP BY ALL),
        r AS (SELECT p.route_id, p.n, coalesce(l.ways, []) AS ways FROM p LEFT JOIN l USING (route_id, n)),
        walk AS (SELECT route_id, 0::BIGINT AS n, 0.0::DOUBLE AS at_, NULL::STRUCT(d DOUBLE, g INTEGER, s DOUBLE) AS way FROM r WHERE n = 1
            UNION ALL SELECT route_id, n, coalesce(way.s, at_), way FROM (SELECT r.route_id, r.n, w.at_, list_filter(r.ways, lambda x: x.s + 300 >= w.at_ AND x.s <= w.at_ + 2000)[1] AS way FROM walk w JOIN r ON r.route_id = w.route_id AND r.n = w.n + 1))
        SELECT route_id, n::INTEGER AS row_no, way.g AS seg_no, {r6('way.s')} AS route_s, {r6('way.d')} AS off FROM walk WHERE n > 0""",
    "pdr_dr": f"""WITH RECURSIVE {FIX}, m AS (SELECT session_id, t_ms, event_id, row_number() OVER ({W}) AS n, value, heading, (value - 250) / 100 AS push FROM fix),
        g AS (SELECT *, push * sin(radians(heading)) AS ax, push * cos(radians(heading)) AS ay, 9.80665::DOUBLE + (heading - 180) / 60 AS az, push / 100 AS wx, -push / 200 AS wy, (heading - 180) / 1000 AS wz, 20 * cos(radians(heading)) AS mx, 20 * sin(radians(heading)) AS my, -40.0::DOUBLE AS mz FROM m),
        b AS (SELECT *, {', '.join(f"w{x} - avg(CASE WHEN n <= 199 THEN w{x} END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS r{x}" for x in "xyz")} FROM g),
        d AS (SELECT *, {', '.join(f"CASE WHEN n = 1 OR abs(r{x}) <= 0.0025::DOUBLE THEN 0.0::DOUBLE ELSE r{x} * 0.01::DOUBLE END AS d{x}" for x in "xyz")} FROM b),
        q AS (SELECT *, dx * dx + dy * dy + dz * dz AS sq FROM d),
        s AS (SELECT *, 1 - sq / 6 + sq * sq / 120 AS k1, 0.5::DOUBLE - sq / 24 + sq * sq / 720 AS k2 FROM q),
        t AS (SELECT *, {', '.join(f"{1.0 if i % 4 == 0 else 0.0}::DOUBLE + k1 * ({SMALL[i]}) + k2 * ({product(SMALL, SMALL, i)}) AS t{i}" for i in range(9))} FROM s),
        walk AS (SELECT session_id, n, {', '.join(f"t{i} AS c{i}" for i in range(6))}, {', '.join(f"a{x} AS f{x}, a{x} AS l{x}" for x in "xyz")} FROM t WHERE n = 1
            UNION ALL SELECT session_id, n, {', '.join(f"c{3 * r} * t{c} + c{3 * r + 1} * t{3 + c} + c{3 * r + 2} * t{6 + c}" for r in range(2) for c in range(3))}, {', '.join(f"f{x}, f{x} + 0.05::DOUBLE * (a{x} - f{x})" for x in "xyz")}
            FROM (SELECT t.*, {', '.join(f"w.c{i}" for i in range(6))}, {', '.join(f"w.l{x} + 0.05::DOUBLE * (t.a{x} - w.l{x}) AS f{x}" for x in "xyz")} FROM walk w JOIN t ON t.session_id = w.session_id AND t.n = w.n + 1)),
        j AS (SELECT t.session_id, t.t_ms, t.event_id, t.n, atan2(c3, c0) AS turned, sqrt(pow(ax - fx, 2) + pow(ay - fy, 2) + pow(az - fz, 2)) AS acc, my * lz - mz * ly AS h0, mz * lx - mx * lz AS h1, mx * ly - my * lx AS h2, sqrt(lx * lx + ly * ly + lz * lz) AS down, lx, lz FROM t JOIN walk USING (session_id, n)),
        h AS (SELECT *, sqrt(h0 * h0 + h1 * h1 + h2 * h2) AS size, avg(acc) OVER ({W} ROWS UNBOUNDED PRECEDING) AS mean FROM j),
        i AS (SELECT *, CASE WHEN size < 1e-6 OR down < 1e-6 THEN NULL ELSE atan2((lz * h0 - lx * h2) / (down * size), h1 / size) END AS mag, CASE WHEN acc > mean + 1 THEN 1 WHEN acc < mean - 1 THEN 0 END AS edge FROM h),
        k AS (SELECT *, last_value(mag IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS last_mag, first_value(mag IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS first_mag, coalesce(last_value(edge IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latched FROM i),
        l AS (SELECT *, turned + coalesce(first_mag, 0.0::DOUBLE) AS gyro, coalesce(edge = 1 AND latched = 0, false) AS step FROM k),
        o AS (SELECT *, 0.02::DOUBLE * (CASE WHEN last_mag < 0 THEN last_mag % ({TURN}) ELSE last_mag END) + 0.98::DOUBLE * (CASE WHEN gyro < 0 THEN gyro % ({TURN}) ELSE gyro END) AS mix FROM l),
        p AS (SELECT *, CASE WHEN last_mag IS NULL THEN gyro WHEN mix > pi() THEN mix % pi() - pi() ELSE mix END AS fused FROM o),
        e AS (SELECT *, coalesce(sum(CASE WHEN step THEN 0.75::DOUBLE * cos(fused) END) OVER ({W} ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS e, coalesce(sum(CASE WHEN step THEN 0.75::DOUBLE * sin(fused) END) OVER ({W} ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS u FROM p)
        SELECT session_id, n * 10000000 AS timestamp_nanos, {r6('acc')} AS acc_mag, step::INTEGER AS step_detected, 0.75::DOUBLE AS stride_length, {r6('gyro')} AS gyro_heading_rad, {r6(f'coalesce(last_mag, {NAN})')} AS mag_heading_rad, {r6('fused')} AS fused_heading_rad,
        {r6('e')} AS dr_x_east, {r6('u')} AS dr_y_north, {r6(f'48.0::DOUBLE + degrees(u / {R}::DOUBLE)')} AS dr_lat, {r6(f'11.0::DOUBLE + degrees(e / ({R}::DOUBLE * cos(radians(48.0::DOUBLE))))')} AS dr_lon,
        {', '.join(f"{NAN} AS {x}" for x in ("forward_speed_mps", "yaw_rate_deg_s", "lateral_vel_mps", "bias_omega_mag", "bias_acc_mag", "nhc_residual_lat"))}, 'PDR' AS snap_mode FROM e""",
    "attitude_dr": f"""WITH {FIX}, m AS (SELECT *, row_number() OVER ({W}) AS n, (value - 250) / 100 AS push, value / 4000 AS tilt, CASE WHEN event_type IN ('click', 'view') THEN sqrt(1 + value / 4000 * value / 4000) END AS s FROM fix),
        q AS (SELECT *, push * sin(radians(heading)) AS ax, push * cos(radians(heading)) AS ay, 9.80665::DOUBLE + (heading - 180) / 60 AS az,
            last_value(CASE WHEN s IS NOT NULL THEN {{'x': tilt / s, 'z': sin(radians(heading) / 2) / s, 'w': cos(radians(heading) / 2) / s}} END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS q FROM m),
        r AS (SELECT *, q.x AS x, 0.0::DOUBLE AS y, q.z AS z, q.w AS w FROM q),
        o AS (SELECT *, {', '.join(f"{c} AS m{i}" for i, c in enumerate(ROT))} FROM r),
        l AS (SELECT *, {', '.join(f"a{x} + 9.80665::DOUBLE * m{6 + i} AS l{x}" for i, x in enumerate("xyz"))}, (degrees(atan2(m1, m4)) + 360) % 360 AS yaw FROM o),
        p AS (SELECT *, coalesce(m0 * lx + m1 * ly + m2 * lz, 0.0::DOUBLE) * 0.01::DOUBLE AS pe, coalesce(m3 * lx + m4 * ly + m5 * lz, 0.0::DOUBLE) * 0.01::DOUBLE AS pn, first_value(CASE WHEN s IS NOT NULL THEN yaw END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS mount FROM l),
        v AS (SELECT *, 3.0::DOUBLE + sum(pe) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ve, 4.0::DOUBLE + sum(pn) OVER ({W} ROWS UNBOUNDED PRECEDING) AS vn FROM p),
        a AS (SELECT *, degrees(vn * 0.01::DOUBLE / {R}::DOUBLE) AS up FROM v), b AS (SELECT *, 48.0::DOUBLE + sum(up) OVER ({W} ROWS UNBOUNDED PRECEDING) AS la FROM a),
        c AS (SELECT *, 11.0::DOUBLE + sum(degrees(ve * 0.01::DOUBLE / ({R}::DOUBLE * cos(radians(la - up))))) OVER ({W} ROWS UNBOUNDED PRECEDING) AS lo, CASE WHEN sqrt(ve * ve + vn * vn) > 0.5::DOUBLE THEN ((degrees(atan2(ve, vn)) - coalesce(mount, 0.0::DOUBLE)) % 360 + 360) % 360 END AS h FROM b)
        SELECT event_id, {r6('ve')} AS vel_east, {r6('vn')} AS vel_north, {r6('la')} AS lat, {r6('lo')} AS lon, {r6(f'coalesce(last_value(h IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 30.0::DOUBLE)')} AS heading, {r6('2 + 0.5::DOUBLE * (n * 0.01::DOUBLE)')} AS confidence_m FROM c""",
}
SQL["session_counters"] = f"""SELECT * FROM (SELECT session_id, count(*) FILTER (NOT accepted) AS rejects FROM ({SQL['gnss_gate']}) GROUP BY 1)
    JOIN (SELECT session_id, count(*) FILTER (decision = 'RECALCULATE') AS recalculations FROM ({SQL['off_route_events']}) GROUP BY 1) USING (session_id)
    JOIN (SELECT user_id AS session_id, count(*) FILTER (is_step) AS steps FROM ({SQL['step_detect']}) JOIN events USING (event_id) GROUP BY 1) USING (session_id)
    JOIN (SELECT user_id AS session_id, count(*) FILTER (stationary) AS zupts FROM ({SQL['still_time']}) JOIN events USING (event_id) GROUP BY 1) USING (session_id)"""
SQL["route_readback"] = f"""WITH {FIX}, s AS (SELECT *, first_value(lat) OVER ({W}) AS lat0, first_value(lon) OVER ({W}) AS lon0 FROM fix WHERE event_type = 'click'),
    e AS (SELECT *, radians(lon - lon0) * 6378137.0::DOUBLE * cos(radians(lat0)) AS e, radians(lat - lat0) * 6378137.0::DOUBLE AS n FROM s)
    SELECT event_id, session_id, {r6('e')} AS east, {r6('n')} AS north, {r6(f'lat0 + degrees(n / {R}::DOUBLE)')} AS lat, {r6(f'lon0 + degrees(e / ({R}::DOUBLE * cos(radians(lat0))))')} AS lon FROM e"""
SQL["exports_joined"] = f"""SELECT session_id, timestamp_nanos, accel_x, accel_z, gyro_z, acc_mag, step_detected, dr_x_east, dr_y_north
    FROM ({SQL['imu_export']}) JOIN ({SQL['pdr_dr']}) USING (session_id, timestamp_nanos)"""
