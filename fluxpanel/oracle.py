"""The queries once more, as SQL for DuckDB, written from the rules and not from the plans."""

from __future__ import annotations

PARTS = {
    "obs": "SELECT c_nationkey AS px, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS v, count(*) AS n, avg(l_extendedprice) AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "cal": "SELECT n_nationkey AS px, CAST(d AS DATE) AS day FROM nation, generate_series(DATE '1995-01-01', DATE '2001-11-04', INTERVAL 1 DAY) AS g(d)",
    "dense": "SELECT px, day, v, n, u, CAST(275.15 AS DOUBLE) + u / CAST(7001.3 AS DOUBLE) AS t FROM cal LEFT JOIN obs USING (px, day)",
    "clim": "SELECT a.px, strftime(a.day, '%m-%d') AS md, avg(b.v) AS clim_mean, CASE WHEN stddev_pop(b.v) > 1e-7 THEN stddev_pop(b.v) END AS clim_std FROM dense a JOIN dense b ON a.px = b.px AND b.day BETWEEN a.day - 3 AND a.day + 3 GROUP BY ALL",
    "climu": "SELECT a.px, strftime(a.day, '%m-%d') AS md, avg(b.u) AS mu, CASE WHEN stddev_pop(b.u) > 1e-7 THEN stddev_pop(b.u) END AS su FROM dense a JOIN dense b ON a.px = b.px AND b.day BETWEEN a.day - 3 AND a.day + 3 GROUP BY ALL",
    "anom": "SELECT d.*, clim_mean, clim_std, (v - clim_mean) / clim_std AS z FROM dense d JOIN clim c ON c.px = d.px AND c.md = strftime(day, '%m-%d')",
    "zz": "SELECT a.*, (u - mu) / su AS zu FROM anom a JOIN climu c ON c.px = a.px AND c.md = strftime(day, '%m-%d')",
    "f1": """SELECT px, day, CASE WHEN count(z) OVER c5 >= 2 THEN round(avg(z) OVER c5, 9) END AS p, CASE WHEN count(z) OVER t30 >= 5 THEN round(avg(z) OVER t30, 9) END AS b,
        CASE WHEN count(t) OVER c5 >= 1 THEN round(avg(t) OVER c5, 9) END AS tp FROM anom
        WINDOW c5 AS (PARTITION BY px ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), t30 AS (PARTITION BY px ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "feat": """SELECT px, day, p, b, min(p) OVER (PARTITION BY px ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS a,
        min(tp) OVER (PARTITION BY px ORDER BY day ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS c FROM f1""",
    "st": "SELECT px, day FROM feat WHERE b > -0.25 AND a < -0.5 AND NOT coalesce(c < 278.15, false)",
    "nx": """SELECT px, day, min(CASE WHEN p < -0.5 THEN day END) OVER w AS r, min(CASE WHEN NOT coalesce(p < -0.5, false) THEN day END) OVER w AS o FROM feat
        WINDOW w AS (PARTITION BY px ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "iv": "SELECT DISTINCT s.px, x.r, y.o FROM st s JOIN nx x ON x.px = s.px AND x.day = s.day JOIN nx y ON y.px = s.px AND y.day = x.r WHERE y.o - x.r >= 7",
    "ev": "SELECT px, min(r) AS start, o AS \"end\" FROM iv GROUP BY px, o",
    "cat": "SELECT e.px, e.start, e.\"end\", CAST(e.\"end\" - e.start AS INTEGER) AS length, min(p) AS max_intensity FROM ev e JOIN feat f ON f.px = e.px AND f.day >= e.start AND f.day < e.\"end\" GROUP BY ALL",
    "peakm": "SELECT px, CAST(m AS INTEGER) AS peak_month FROM (SELECT px, month(day) AS m, round(avg(u), 9) AS v FROM dense GROUP BY ALL) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY px ORDER BY v DESC, m) = 1",
    "lc": "SELECT n_nationkey AS px, CAST(y AS INTEGER) AS year, [10, 11, 120, 130, 150][(n_regionkey + y + n_nationkey) % 5 + 1] AS class FROM nation, range(1995, 2001) AS g(y)",
    "lags": "SELECT e.*, CAST(k AS INTEGER) AS lag, e.start + CAST(k AS INTEGER) AS day FROM ev e, range(-30, 31) AS g(k)",
    "al": "SELECT l.px, l.start, l.lag, b.zu, b.n FROM lags l LEFT JOIN zz b ON b.px = l.px AND b.day = l.day",
    "comp": "SELECT lag, avg(zu) AS m, count(zu) AS composite_n FROM al GROUP BY lag",
    "pk": """SELECT px, day, CASE WHEN count(x) OVER w >= 2 THEN max(x) OVER w END AS peak FROM (SELECT px, day, CASE WHEN n >= 2 THEN u END AS x FROM dense)
        WINDOW w AS (PARTITION BY px ORDER BY day ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)""",
    "evp": "SELECT e.*, peak FROM ev e LEFT JOIN pk ON pk.px = e.px AND pk.day = e.start",
    "pq": "SELECT quantile_cont(peak, [0.25, 0.5, 0.75]) AS q FROM evp",
    "evq": "SELECT e.*, CASE WHEN peak IS NULL THEN 0 ELSE 1 + (peak > q[1])::INT + (peak > q[2])::INT + (peak > q[3])::INT END AS quartile FROM evp e, pq",
    "rq": """SELECT *, 1 + (predictor > q[1])::INT + (predictor > q[2])::INT + (predictor > q[3])::INT AS quartile FROM enr,
        (SELECT quantile_cont(predictor, [0.25, 0.5, 0.75]) AS q FROM enr WHERE response IS NOT NULL AND predictor IS NOT NULL) WHERE response IS NOT NULL AND predictor IS NOT NULL""",
    "enr": """SELECT e.px, e.start, e."end", round(max(CASE WHEN b.day >= e.start AND e.start + 21 <= DATE '2001-11-04' THEN zu END), 9) AS response,
        round(avg(CASE WHEN b.day < e.start AND e.start - 30 >= DATE '1995-01-01' THEN z END), 9) AS predictor
        FROM ev e LEFT JOIN zz b ON b.px = e.px AND b.day BETWEEN e.start - 30 AND e.start + 20 GROUP BY ALL""",
    "ky": "SELECT *, CAST(start - DATE '1995-01-01' AS BIGINT) * 100 + px AS key, px // 5 AS i, px % 5 AS j FROM ev",
}
NEEDS = {
    "dense": ["cal", "obs"], "clim": ["dense"], "climu": ["dense"], "anom": ["dense", "clim"], "zz": ["anom", "climu"], "f1": ["anom"], "feat": ["f1"], "st": ["feat"], "nx": ["feat"],
    "iv": ["st", "nx"], "ev": ["iv"], "cat": ["ev", "feat"], "peakm": ["dense"], "lags": ["ev"], "al": ["lags", "zz"], "comp": ["al"], "pk": ["dense"], "evp": ["ev", "pk"], "pq": ["evp"],
    "evq": ["evp", "pq"], "enr": ["ev", "zz"], "rq": ["enr"], "ky": ["ev"],
}


def sql(needs: str, final: str, recursive: bool = False, **more: str) -> str:
    """A statement with the parts it needs, each after those that it needs itself."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {final}" if parts else final


def _frame(col: str, fn: str, lo: str, hi: str, least: int, name: str) -> str:
    w = f"(PARTITION BY px ORDER BY day ROWS BETWEEN {lo} AND {hi})"
    return sql("dense", f"SELECT px, day, CASE WHEN count({col}) OVER {w} >= {least} THEN round({fn}({col}) OVER {w}, 6) END AS {name} FROM dense")


def _enrich(fn: str, first: int, last: int) -> str:
    return sql("ev zz", f"""SELECT e.px, e.start, e."end", round(CASE WHEN any_value(e.start) + ({first}) >= DATE '1995-01-01' AND any_value(e.start) + ({last} + 1) <= DATE '2001-11-04' THEN {fn} END, 6) AS value
        FROM ev e LEFT JOIN zz b ON b.px = e.px AND b.day BETWEEN e.start + ({first}) AND e.start + ({last}) GROUP BY ALL""")


SMOOTH = """SELECT px, day, CASE WHEN count(zu) OVER w >= 2 THEN avg(zu) OVER w END AS zu, CASE WHEN count(n) OVER w >= 2 THEN avg(n) OVER w END AS n FROM zz
    WINDOW w AS (PARTITION BY px ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


def _weighted(kind: str, source: str = "SELECT px, day, zu, n FROM zz") -> str:
    value, obs = {
        "mean": ("sum(x * n) / sum(CASE WHEN x IS NOT NULL THEN n END)", "CASE WHEN count(x) > 0 THEN sum(n) ELSE 0 END"),
        "min": ("arg_min(x, (x, day)) FILTER (x IS NOT NULL)", "arg_min(n, (x, day)) FILTER (x IS NOT NULL)"),
        "max": ("arg_max(x, (x, DATE '2100-01-01' - day)) FILTER (x IS NOT NULL)", "arg_max(n, (x, DATE '2100-01-01' - day)) FILTER (x IS NOT NULL)"),
    }[kind]
    return sql("ev zz", f"""SELECT e.px, e.start, e."end", round({value}, 6) AS value, round(CAST(coalesce({obs}, 0) AS DOUBLE), 6) AS obs
        FROM ev e LEFT JOIN wx b ON b.px = e.px AND b.day BETWEEN e.start AND e.start + 20 AND e.start + 21 <= DATE '2001-11-04' GROUP BY ALL""",
               sm=source, wx="SELECT px, day, n, CASE WHEN n >= 2 THEN zu END AS x FROM sm")


_COVER_YEAR = "least(greatest(CASE WHEN day < make_date(year(day), 7, 2) THEN CASE WHEN day - make_date(year(day) - 1, 7, 2) <= make_date(year(day), 7, 2) - day THEN year(day) - 1 ELSE year(day) END ELSE CASE WHEN make_date(year(day) + 1, 7, 2) - day < day - make_date(year(day), 7, 2) THEN year(day) + 1 ELSE year(day) END END, 1995), 2000)"
_START_YEAR = _COVER_YEAR.replace("day(", "DAY_").replace("day", "start").replace("DAY_", "day(")
_GROUP = "CASE WHEN class IN (10, 11) THEN 'all_cropland_rainfed' WHEN class = 120 THEN 'all_shrubland' WHEN class = 130 THEN 'grassland' WHEN class = 150 THEN 'all_sparse_vegetation' END"


def _corners(source: str) -> dict[str, str]:
    """Each cell of a full grid of rows i and columns j with its neighbours below (d), right (r) and both (dr)."""
    return {
        "g": source,
        "h": "SELECT *, lead(v) OVER (PARTITION BY day, i ORDER BY j) AS r FROM g",
        "corner": "SELECT *, lead(v) OVER (PARTITION BY day, j ORDER BY i) AS d, lead(r) OVER (PARTITION BY day, j ORDER BY i) AS dr FROM h",
    }


_CLUSTERS = {
    "ln": "SELECT a.key AS a, b.key AS b FROM ky a JOIN ky b ON a.key <> b.key AND abs(a.i - b.i) <= {reach} AND abs(a.j - b.j) <= {reach} AND a.start <= b.\"end\" AND b.start <= a.\"end\"",
    "rc": "SELECT key AS k, key AS m FROM ky UNION SELECT ln.b, rc.m FROM rc JOIN ln ON ln.a = rc.k WHERE rc.m < ln.b",
    "cl": "SELECT k, min(m) AS cluster_id FROM rc GROUP BY k",
}
_BOOT = {
    **{k: q.format(reach=0) for k, q in _CLUSTERS.items()},
    "rw": "SELECT response, predictor, cluster_id FROM enr e JOIN ky USING (px, start) JOIN cl ON k = key WHERE response IS NOT NULL AND predictor IS NOT NULL",
    "nb": "SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS k FROM (SELECT DISTINCT cluster_id FROM rw)",
    "dr": "SELECT CAST(i AS INTEGER) AS iter, ('0x' || substr(md5(i || '-' || s), 1, 15))::BIGINT % (SELECT count(*) FROM nb) AS k FROM range(1000) a(i), range((SELECT count(*) FROM nb)) b(s)",
    "tk": "SELECT iter, response, predictor FROM dr JOIN nb USING (k) JOIN rw USING (cluster_id)",
    "bq": "SELECT iter, quantile_cont(predictor, [0.25, 0.75]) AS q FROM tk GROUP BY iter",
    "rk": "SELECT iter, predictor <= q[1] AS one, avg_rank FROM (SELECT iter, predictor, q, rank() OVER (PARTITION BY iter ORDER BY response) + (count(*) OVER (PARTITION BY iter, response) - 1) / 2 AS avg_rank FROM tk JOIN bq USING (iter) WHERE predictor <= q[1] OR predictor > q[2])",
    "bp": "SELECT iter, (sum(CASE WHEN one THEN avg_rank END) - count(*) FILTER (one) * (count(*) FILTER (one) + 1) / 2) / (count(*) FILTER (one) * count(*) FILTER (NOT one)) AS p FROM rk GROUP BY iter",
}

def _sensitivity(final: str) -> str:
    return sql("ev zz", final,
        g="SELECT CAST(e.px // 5 // 2 AS INTEGER) AS bi, CAST(e.px % 5 // 2 AS INTEGER) AS bj, CAST(k AS INTEGER) AS lag, z, zu FROM (SELECT *, unnest(range(-60, 61)) AS k FROM ev) e LEFT JOIN zz b ON b.px = e.px AND b.day = e.start + CAST(k AS INTEGER)",
        cp="SELECT bi, bj, lag, avg(z) AS m, count(z) AS mn, avg(zu) AS x, count(zu) AS xn FROM g GROUP BY ALL",
        sm="SELECT *, avg(m) OVER w AS ms, sum(mn) OVER w AS mns, avg(x) OVER w AS xs, sum(xn) OVER w AS xns FROM cp WINDOW w AS (PARTITION BY bi, bj ORDER BY lag ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
        sens="""SELECT bi AS box_i, bj AS box_j, CASE WHEN ok THEN round((xa - xb) / nullif(ma - mb, 0), 6) END AS sensitivity, CASE WHEN ok THEN n END AS n FROM
        (SELECT bi, bj, avg(m) FILTER (lag BETWEEN -60 AND -30) AS mb, avg(x) FILTER (lag BETWEEN -60 AND -30) AS xb, min(ms) FILTER (lag >= 0 AND mns >= 20) AS ma, min(xs) FILTER (lag >= 0 AND xns >= 20) AS xa,
            CAST(arg_min(xns, (xs, lag)) FILTER (lag >= 0 AND xns >= 20 AND xs IS NOT NULL) AS BIGINT) AS n,
            sum(mn) FILTER (lag BETWEEN -60 AND -30) > 20 AND sum(xn) FILTER (lag BETWEEN -60 AND -30) > 20 AND max(mns) FILTER (lag >= 0) > 20 AND max(xns) FILTER (lag >= 0) > 20 AS ok FROM sm GROUP BY bi, bj)""")


ORACLE_SQL = {
    "panel_daily": sql("dense", "SELECT px, day, round(v, 9) AS v, n, round(u, 6) AS u, round(t, 9) AS t FROM dense"),
    "rolling_centred_mean": _frame("v", "avg", "2 PRECEDING", "2 FOLLOWING", 2, "mean_5d"),
    "rolling_trailing_mean": _frame("v", "avg", "29 PRECEDING", "CURRENT ROW", 5, "mean_30d"),
    "rolling_leading_min": _frame("v", "min", "1 FOLLOWING", "20 FOLLOWING", 1, "min_next_20d"),
    "rolling_leading_max": _frame("v", "max", "CURRENT ROW", "19 FOLLOWING", 2, "max_20d"),
    "rolling_centred_min": _frame("t", "min", "30 PRECEDING", "30 FOLLOWING", 1, "min_61d"),
    "climatology": sql("clim", "SELECT px, md, round(clim_mean, 9) AS clim_mean, round(clim_std, 6) AS clim_std FROM clim"),
    "climatology_by_parts": sql("clim", "SELECT px, md, round(clim_mean, 9) AS clim_mean, round(clim_std, 6) AS clim_std FROM clim"),
    "std_anomaly": sql("anom", "SELECT px, day, round(z, 6) AS z FROM anom"),
    "anomaly_mean_only": sql("anom", "SELECT px, day, round(v - clim_mean, 9) + 0.0::DOUBLE AS d FROM anom"),
    "climatology_observed": sql("anom", "SELECT px, day, CASE WHEN v <> 0 THEN round(clim_mean, 9) END AS clim_mean, CASE WHEN v <> 0 THEN round(clim_std, 6) END AS clim_std FROM anom"),
    "detrend": sql("dense", """SELECT px, day, round(v - (b + m * x), 6) AS detrended FROM (SELECT px, day, v, CAST(day - DATE '1995-01-01' AS DOUBLE) AS x FROM dense)
        JOIN (SELECT px, regr_slope(v, x) AS m, regr_intercept(v, x) AS b FROM (SELECT px, v, CAST(day - DATE '1995-01-01' AS DOUBLE) AS x FROM dense) GROUP BY px) USING (px)"""),
    "detection_features": sql("anom", "SELECT px, day, p, b, a, c FROM y", x=PARTS["f1"].replace(", 9)", ", 6)"), y=PARTS["feat"].replace("f1", "x")),
    "drought_mask": sql("ev", "SELECT DISTINCT px, CAST(d AS DATE) AS day FROM (SELECT px, unnest(generate_series(start, \"end\" - 1, INTERVAL 1 DAY)) AS d FROM ev)"),
    "event_catalogue": sql("cat", "SELECT px, start, \"end\", length, round(max_intensity, 6) AS max_intensity FROM cat"),
    "event_catalogue_growing_season": sql("iv feat peakm", "SELECT e.px, start, \"end\", CAST(\"end\" - start AS INTEGER) AS length, round(min(p), 6) AS max_intensity FROM gs e JOIN feat f ON f.px = e.px AND f.day >= start AND f.day < \"end\" GROUP BY ALL",
        gs="SELECT px, min(r) AS start, o AS \"end\" FROM iv JOIN peakm USING (px) WHERE abs(month(r) - peak_month) <= 1 OR abs(month(r) - peak_month) = 11 GROUP BY px, o"),
    "runs_of_mask": sql("dense", """SELECT px, min(day) AS start, max(day) + 1 AS "end" FROM g WHERE f GROUP BY px, k HAVING min(day) > DATE '1995-01-01' AND max(day) < DATE '2001-11-04'""",
        m="SELECT px, day, coalesce(v < 20, false) AS f FROM dense", g="SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY px ORDER BY day) AS k FROM m"),
    "onset_count_map": sql("ev", "SELECT n_nationkey AS px, n_events FROM nation LEFT JOIN (SELECT px, count(*) AS n_events FROM ev GROUP BY px) ON px = n_nationkey"),
    "places_without_events": sql("feat", "SELECT n_nationkey AS px FROM nation WHERE n_nationkey NOT IN (SELECT s.px FROM s2 s JOIN n2 x ON x.px = s.px AND x.day = s.day JOIN n2 y ON y.px = s.px AND y.day = x.r WHERE y.o - x.r >= 6)",
        s2="SELECT px, day FROM feat WHERE b > -0.25 AND a < -1.0 AND NOT coalesce(c < 278.15, false)",
        n2="SELECT px, day, min(CASE WHEN p < -1.0 THEN day END) OVER w AS r, min(CASE WHEN NOT coalesce(p < -1.0, false) THEN day END) OVER w AS o FROM feat WINDOW w AS (PARTITION BY px ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"),
    "peak_month": sql("peakm", "SELECT px, peak_month FROM peakm"),
    "land_cover_daily": sql("cal lc", f"SELECT k.px, k.day, class FROM (SELECT px, day, {_COVER_YEAR} AS y FROM cal) k LEFT JOIN lc ON lc.px = k.px AND lc.year = y"),
    "land_cover_nearest": sql("cal lc", "SELECT c.px, c.day, CASE WHEN a.stamp IS NULL OR c.day - b.stamp <= a.stamp - c.day THEN b.class ELSE a.class END AS class FROM cal c ASOF LEFT JOIN s b ON b.px = c.px AND b.stamp <= c.day ASOF LEFT JOIN s a ON a.px = c.px AND a.stamp >= c.day",
        s="SELECT px, class, make_date(year, CAST(1 + (px * 5 + year * 3) % 12 AS INTEGER), CAST(1 + (px * 7 + year) % 28 AS INTEGER)) AS stamp FROM lc"),
    "top_land_cover_map": sql("lc ev", "SELECT px, CAST(CASE WHEN class // 10 * 10 IN (10, 120, 130) AND px IN (SELECT px FROM ev) THEN class // 10 * 10 ELSE 0 END AS INTEGER) AS coarse FROM lc WHERE year = 1998"),
    "composite": sql("comp", "SELECT lag, round(m, 6) AS composite_mean, composite_n FROM comp"),
    "composite_spread": sql("al", "SELECT lag, round(avg(zu), 6) AS composite_mean, count(zu) AS composite_n, round(stddev_pop(zu), 6) AS composite_std FROM al GROUP BY lag"),
    "composite_land_cover": sql("al ev lc", "SELECT land_cover, lag, round(avg(zu), 6) AS composite_mean, count(zu) AS composite_n FROM al JOIN g USING (px, start) WHERE land_cover IS NOT NULL GROUP BY ALL",
        g=f"SELECT e.px, e.start, {_GROUP} AS land_cover FROM (SELECT px, start, {_START_YEAR} AS y FROM ev) e JOIN lc ON lc.px = e.px AND lc.year = y"),
    "composite_one_group": sql("al ev lc", "SELECT lag, round(avg(zu), 6) AS composite_mean, count(zu) AS composite_n FROM al JOIN g USING (px, start) WHERE land_cover = 'all_cropland_rainfed' GROUP BY ALL",
        g=f"SELECT e.px, e.start, {_GROUP} AS land_cover FROM (SELECT px, start, {_START_YEAR} AS y FROM ev) e JOIN lc ON lc.px = e.px AND lc.year = y"),
    "composite_weighted": sql("al", "SELECT lag, round(sum(x * w) / sum(w), 6) AS composite_mean, count(x) AS composite_n, round(CAST(coalesce(sum(w), 0) AS DOUBLE), 6) AS composite_total_obs FROM (SELECT lag, CASE WHEN n >= 2 THEN zu END AS x, CASE WHEN n >= 2 AND zu IS NOT NULL THEN n END AS w FROM al) GROUP BY lag"),
    "event_percentiles": sql("evp", "SELECT CAST(k AS INTEGER) AS percentile, round(q[i], 6) AS value FROM (SELECT unnest([0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]) AS k, unnest(range(1, 12)) AS i), (SELECT quantile_cont(peak, [0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]) AS q FROM evp)"),
    "event_quartiles": sql("evq", "SELECT px, start, round(peak, 6) AS peak, CAST(quartile AS INTEGER) AS quartile FROM evq"),
    "composite_quartile": sql("al evq", "SELECT CAST(quartile AS INTEGER) AS quartile, lag, round(avg(zu), 6) AS composite_mean, count(zu) AS composite_n FROM al JOIN evq USING (px, start) WHERE quartile > 0 GROUP BY ALL"),
    "composite_weighted_quartile": sql("al evq", "SELECT CAST(quartile AS INTEGER) AS quartile, lag, round(sum(x * w) / sum(w), 6) AS composite_mean, count(x) AS composite_n, round(CAST(coalesce(sum(w), 0) AS DOUBLE), 6) AS composite_total_obs FROM (SELECT quartile, lag, CASE WHEN n >= 2 THEN zu END AS x, CASE WHEN n >= 2 AND zu IS NOT NULL THEN n END AS w FROM al JOIN (SELECT px, start, quartile FROM evq) USING (px, start) WHERE quartile > 0) GROUP BY ALL"),
    "composite_smoothed": sql("comp", "SELECT lag, round(m, 6) AS composite_mean, composite_n, round(avg(m) OVER (ORDER BY lag ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS composite_smooth FROM comp"),
    "enrich_mean": _enrich("avg(zu)", -30, -1),
    "enrich_min": _enrich("min(zu)", 0, 20),
    "enrich_max": _enrich("max(zu)", 0, 20),
    "enrich_sum": _enrich("coalesce(sum(zu), 0)", 0, 20),
    "enrich_smooth": sql("ev zz", "SELECT e.px, e.start, e.\"end\", round(CASE WHEN any_value(e.start) + 21 <= DATE '2001-11-04' THEN max(zu) END, 6) AS value FROM ev e LEFT JOIN sm b ON b.px = e.px AND b.day BETWEEN e.start AND e.start + 20 GROUP BY ALL", sm=SMOOTH),
    "enrich_mean_sums": _enrich("avg(zu)", -30, -1),
    "enrich_min_sums": _enrich("min(zu)", 0, 20),
    "enrich_sum_sums": _enrich("coalesce(sum(zu), 0)", 0, 20),
    "enrich_smooth_sums": sql("ev zz", "SELECT e.px, e.start, e.\"end\", round(CASE WHEN any_value(e.start) + 21 <= DATE '2001-11-04' THEN max(zu) END, 6) AS value FROM ev e LEFT JOIN sm b ON b.px = e.px AND b.day BETWEEN e.start AND e.start + 20 GROUP BY ALL", sm=SMOOTH),
    "enrich_named": sql("ev zz", """SELECT e.px, e.start, e."end", round(max(CASE WHEN b.day >= e.start AND e.start + 21 <= DATE '2001-11-04' THEN zu END), 6) AS std_anom_u_max_0_20,
        round(avg(CASE WHEN b.day < e.start AND e.start - 30 >= DATE '1995-01-01' THEN zs END), 6) AS "std_anom_v_mean_-30_-1_smooth5"
        FROM ev e LEFT JOIN sz b ON b.px = e.px AND b.day BETWEEN e.start - 30 AND e.start + 20 GROUP BY ALL""",
        sz="SELECT px, day, zu, CASE WHEN count(z) OVER w >= 2 THEN avg(z) OVER w END AS zs FROM zz WINDOW w AS (PARTITION BY px ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "enrich_weighted_mean": _weighted("mean"),
    "enrich_weighted_min": _weighted("min"),
    "enrich_weighted_max": _weighted("max", SMOOTH),
    "enrich_weighted_compat": _weighted("min"),
    "regional_catalogue": sql("cat", "SELECT px, start, \"end\", length, round(max_intensity, 6) AS max_intensity, CAST(4 + px // 5 * 4 AS DOUBLE) AS lat, CAST(-18 + px % 5 * 7 AS DOUBLE) AS lon FROM cat WHERE px // 5 BETWEEN 1 AND 3 AND px % 5 BETWEEN 1 AND 3 AND month(start) BETWEEN 5 AND 9"),
    "regional_count_grid": sql("ev", "SELECT CAST(4 + px // 5 * 4 AS DOUBLE) AS lat, CAST(-18 + px % 5 * 7 AS DOUBLE) AS lon, count(*) AS n FROM ev WHERE px // 5 BETWEEN 1 AND 3 AND px % 5 BETWEEN 1 AND 3 GROUP BY ALL"),
    "catalogue_bands": sql("ev", "SELECT px, start, lat, band, CAST(list_position(['north1', 'north2', 'north3', 'north4', 'north5', 'north6', 'south1', 'south2'], band) - 1 AS INTEGER) AS band_order FROM (SELECT px, start, lat, CASE WHEN lat < -30 THEN 'south1' WHEN lat < 0 THEN 'south2' WHEN lat < 20 THEN 'north1' WHEN lat < 40 THEN 'north2' WHEN lat < 50 THEN 'north3' WHEN lat < 60 THEN 'north4' WHEN lat < 70 THEN 'north5' ELSE 'north6' END AS band FROM (SELECT px, start, CAST(-50 + px * 5 AS DOUBLE) AS lat FROM ev))"),
    "exceedance_report": sql("rq", "SELECT CAST(quartile AS INTEGER) AS quartile, CAST(sum((response > 1.5)::INT) AS BIGINT) AS n_above, count(*) AS n_total, round(sum((response > 1.5)::INT) * 100.0 / count(*), 6) AS percent FROM rq GROUP BY quartile"),
    "kde_by_quartile": sql("rq", "SELECT CAST(r.quartile AS INTEGER) AS quartile, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - response) / h) ** 2)) / (any_value(h) * sqrt(2 * pi()) * any_value(total)), 6) AS density FROM rq r JOIN bw USING (quartile), xs GROUP BY r.quartile, x",
        bw="SELECT quartile, stddev_samp(response) * count(*) ** -0.2 AS h, (SELECT count(*) FROM rq) AS total FROM rq GROUP BY quartile", xs="SELECT CAST(-4.0 + i * 0.2 AS DOUBLE) AS x FROM range(51) g(i)"),
    "response_histogram": sql("enr", "SELECT CAST(bin AS INTEGER) AS bin, round(any_value(lo + bin * w), 6) AS low, round(any_value(lo + (bin + 1) * w), 6) AS high, count(*) AS n FROM (SELECT lo, (hi - lo) / 20 AS w, least(floor((response - lo) / ((hi - lo) / 20)), 19) AS bin FROM enr, (SELECT min(response) AS lo, max(response) AS hi FROM enr) WHERE response IS NOT NULL) GROUP BY bin"),
    "mann_whitney": sql("rq", "SELECT round(u, 6) AS u, n1, n2, round(u / (n1 * n2), 6) AS p FROM (SELECT sum(CASE WHEN quartile = 1 THEN r END) - count(*) FILTER (quartile = 1) * (count(*) FILTER (quartile = 1) + 1) / 2 AS u, count(*) FILTER (quartile = 1) AS n1, count(*) FILTER (quartile = 4) AS n2 FROM (SELECT quartile, rank() OVER (ORDER BY response) + (count(*) OVER (PARTITION BY response) - 1) / 2 AS r FROM rq WHERE quartile IN (1, 4)))"),
    "sensitivity": _sensitivity("SELECT * FROM sens"),
    "event_clusters": sql("ky", "SELECT px, start, cluster_id FROM ky JOIN cl ON k = key", True, **{k: q.format(reach=1) for k, q in _CLUSTERS.items()}),
    "bootstrap_samples": sql("ky enr", "SELECT iter, round(p, 6) AS p FROM bp", True, **_BOOT),
    "bootstrap_bound": sql("ky enr", "SELECT round(quantile_cont(p, 0.05), 6) AS bound, count(p) AS n FROM bp", True, **_BOOT),
    "ingest_mask_shift_crop": "SELECT o_orderkey, CAST(o_orderdate - INTERVAL 12 HOUR AS DATE) AS day, lat, lon, round(CAST(CAST(CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS FLOAT) AS DOUBLE), 2) AS value FROM (SELECT *, CAST(-70 + o_custkey % 160 AS DOUBLE) AS lat, CAST(-180 + o_custkey % 360 AS DOUBLE) AS lon FROM orders) WHERE lat BETWEEN -60 AND 80 AND lon BETWEEN -180 AND 180",
    "regrid_half_cell": sql("dense", "SELECT day, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, round((v + d + r + dr) / 4, 6) AS value FROM corner WHERE i < 4 AND j < 4", **_corners("SELECT day, px // 5 AS i, px % 5 AS j, v FROM dense")),
    "regrid_linear": sql("dense", """SELECT day, a.k AS row, b.k AS col, CASE WHEN count(v) = count(*) THEN round(sum(v * (1 - abs(px // 5 - a.x)) * (1 - abs(px % 5 - b.x))), 6) END AS value
        FROM dense, (VALUES (0, 0.5::DOUBLE), (1, 2), (2, 3.25)) a(k, x), (VALUES (0, 4.5::DOUBLE), (1, 2.75), (2, 0.25)) b(k, x) WHERE abs(px // 5 - a.x) < 1 AND abs(px % 5 - b.x) < 1 AND b.x <= 4 GROUP BY ALL"""),
    "merged_files": sql("dense", "SELECT px, day, round(v, 9) AS v FROM dense"),
    "land_fraction_mask": sql("dense", "SELECT day, CAST(px // 5 AS INTEGER) AS row, CAST(px % 5 AS INTEGER) AS col, round(CASE WHEN n_regionkey / 4.0 >= 0.5 THEN v END, 6) AS value FROM dense JOIN nation ON n_nationkey = px"),
    "quality_threshold": sql("dense", "SELECT px, day, CASE WHEN n >= 2 THEN round(v, 9) END AS v, CASE WHEN n >= 2 THEN n ELSE 0 END AS n FROM dense"),
    "tile_counts": sql("dense", "SELECT CAST(least(px // 5 // 3, 1) AS INTEGER) AS tile_i, CAST(least(px % 5 // 2, 2) AS INTEGER) AS tile_j, count(v) AS observed FROM dense GROUP BY ALL"),
    "event_type_daily": """WITH e AS (SELECT user_id AS px, CAST(ts AS DATE) AS day, round(avg(value), 9) AS value, count(*) AS n FROM events GROUP BY ALL),
        d AS (SELECT px, CAST(g AS DATE) AS day FROM (SELECT DISTINCT px FROM e), generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS s(g))
        SELECT px, day, n, CASE WHEN count(value) OVER w >= 2 THEN round(avg(value) OVER w, 6) END AS mean_5d FROM d LEFT JOIN e USING (px, day) WINDOW w AS (PARTITION BY px ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "catalogue_csv": sql("cat", "SELECT CAST(4 + px // 5 * 4 AS DOUBLE) AS lat, CAST(-18 + px % 5 * 7 AS DOUBLE) AS lon, start, \"end\", length, round(max_intensity, 6) AS max_intensity FROM cat"),
    "enriched_csv": "SELECT CAST(4 + px // 5 * 4 AS DOUBLE) AS lat, CAST(-18 + px % 5 * 7 AS DOUBLE) AS lon, start, \"end\", CAST(\"end\" - start AS INTEGER) AS length, value FROM (" + _enrich("max(zu)", 0, 20) + ")",
    "numbers_text": sql("dense", "SELECT round(v, 9) AS value, count(*) AS n FROM dense WHERE v IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, count(*) FROM dense WHERE v IS NULL HAVING count(*) > 0"),
    "count_map_npy": sql("ev", "SELECT CAST(n_nationkey // 5 AS INTEGER) AS i, CAST(n_nationkey % 5 AS INTEGER) AS j, CAST(n AS DOUBLE) AS value FROM nation LEFT JOIN (SELECT px, count(*) AS n FROM ev GROUP BY px) ON px = n_nationkey"),
    "year_tables": sql("dense", "SELECT px, day, round(v, 9) AS v FROM dense WHERE year(day) BETWEEN 1996 AND 1998"),
    "files_by_name": sql("dense", "SELECT px, count(*) AS days, count(v) AS observed FROM dense WHERE year(day) IN (1997, 1998) GROUP BY px"),
    "netcdf_years": sql("dense", "SELECT CAST(px // 5 + 0.5 AS DOUBLE) AS lat, CAST(px % 5 + 0.5 AS DOUBLE) AS lon, day, CAST(CAST(v AS FLOAT) AS DOUBLE) AS value FROM dense WHERE day BETWEEN DATE '1996-07-01' AND DATE '1998-02-28' AND px // 5 < 3"),
    "rolling_job": "SELECT * FROM (" + ") JOIN (".join([_frame("v", "avg", "2 PRECEDING", "2 FOLLOWING", 2, "mean_5d"), _frame("v", "min", "30 PRECEDING", "30 FOLLOWING", 1, "min_61d") + ") USING (px, day", _frame("v", "avg", "29 PRECEDING", "CURRENT ROW", 5, "mean_30d") + ") USING (px, day",
        _frame("v", "min", "1 FOLLOWING", "20 FOLLOWING", 1, "min_next_20d") + ") USING (px, day", _frame("v", "max", "CURRENT ROW", "19 FOLLOWING", 2, "max_20d") + ") USING (px, day"]) + ") WHERE year(day) BETWEEN 1996 AND 1998",
    "composite_bucketed": sql("comp", "SELECT lag, round(m, 6) AS composite_mean, composite_n FROM comp"),
    "anomaly_job": sql("dense", """SELECT a.px, a.day, round(a.value, 5) AS value, round((a.value - m) / s, 5) AS z FROM job a JOIN jc c ON c.px = a.px AND c.md = strftime(a.day, '%m-%d')""",
        **_corners("SELECT CAST(day - 1 AS DATE) AS day, px // 5 AS i, px % 5 AS j, CASE WHEN v < 45 THEN v END AS v FROM dense WHERE year(day - 1) BETWEEN 1996 AND 1999"),
        jv="SELECT day, CAST(i * 5 + j AS INTEGER) AS px, CAST(CAST((v + d + r + dr) / 4 AS FLOAT) AS DOUBLE) AS value FROM corner JOIN nation ON n_nationkey = i * 5 + j WHERE i < 3 AND j < 4 AND n_regionkey / 4.0 >= 0.5",
        job="SELECT c.px, c.day, value FROM cal c LEFT JOIN jv USING (px, day) WHERE c.px // 5 < 4 AND c.px % 5 < 4 AND year(c.day) BETWEEN 1996 AND 1999",
        jc="SELECT a.px, strftime(a.day, '%m-%d') AS md, avg(b.value) AS m, CASE WHEN stddev_pop(b.value) > 1e-7 THEN stddev_pop(b.value) END AS s FROM job a JOIN job b ON a.px = b.px AND b.day BETWEEN a.day - 3 AND a.day + 3 GROUP BY ALL"),
    "composites_all": sql("evq lc zz", "SELECT variable, land_cover, CAST(quartile AS INTEGER) AS quartile, lag, round(avg(x), 6) AS composite_mean, count(x) AS composite_n FROM wide WHERE land_cover IS NOT NULL AND quartile > 0 GROUP BY ALL HAVING count(x) > 0",
        gq=f"SELECT e.px, e.start, quartile, {_GROUP} AS land_cover FROM (SELECT px, start, quartile, {_START_YEAR} AS y FROM evq) e JOIN lc ON lc.px = e.px AND lc.year = y",
        sp="SELECT *, CAST(k AS INTEGER) AS lag, start + CAST(k AS INTEGER) AS day FROM gq, range(-120, 121) AS g(k)",
        two="SELECT 'v' AS variable, px, day, z AS x FROM zz UNION ALL SELECT 'u', px, day, zu FROM zz",
        wide="SELECT variable, land_cover, quartile, lag, x FROM sp JOIN two USING (px, day)"),
    "composite_wide": sql("ev zz", "SELECT lag, round(avg(zu), 6) AS composite_mean, count(zu) AS composite_n FROM sp LEFT JOIN zz USING (px, day) GROUP BY lag", sp="SELECT px, CAST(k AS INTEGER) AS lag, start + CAST(k AS INTEGER) AS day FROM ev, range(-240, 241) AS g(k)"),
    "common_span": sql("obs", "SELECT px, min(day) AS first, count(*) AS n, max(day) AS last FROM obs, (SELECT min(day) FILTER (day >= DATE '1996-02-10') AS lo, max(day) FILTER (day <= DATE '1999-10-20') AS hi FROM obs) WHERE day BETWEEN lo AND hi GROUP BY px"),
    "valid_places": "SELECT n_nationkey AS px FROM nation WHERE n_regionkey > 0 AND (n_nationkey % 3 = 0 OR n_nationkey % 2 = 0)",
    "nearest_pixels": "SELECT c_custkey, round(lat, 3) AS lat, round(lon, 3) AS lon, CAST(round((lat + 59.875) / 0.25) * 1440 + round((lon + 179.875) / 0.25) AS INTEGER) AS pixel FROM (SELECT c_custkey, -59.95::DOUBLE + c_custkey % 1000 * 0.1370001::DOUBLE AS lat, -179.9::DOUBLE + c_custkey % 700 * 0.5110003::DOUBLE AS lon FROM customer)",
    "sensitivity_map": _sensitivity("SELECT CAST(i AS INTEGER) AS box_i, CAST(j AS INTEGER) AS box_j, sensitivity, n FROM range(4) a(i), range(4) b(j) LEFT JOIN sens ON box_i = i AND box_j = j"),
    "event_clusters_wide": sql("ky", "SELECT px, start, cluster_id FROM ky JOIN cl ON k = key", True, **{k: q.format(reach=7) for k, q in _CLUSTERS.items()}),
    "cluster_sizes": sql("ky", "SELECT cluster_id, count(*) AS n FROM ky JOIN cl ON k = key GROUP BY cluster_id", True, **{k: q.format(reach=1) for k, q in _CLUSTERS.items()}),
}
