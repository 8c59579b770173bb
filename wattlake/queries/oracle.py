"""Shared SQL table expressions of the oracles (DuckDB dialect).

They restate the feeds and facts independently of the Spark plans, mostly in
the plain relational way: windows, correlated joins and ``FILTER`` clauses.
"""

from __future__ import annotations

import re

from wattlake.operators import stats

def regimes_sql(moves: str, key: str) -> str:
    """Regime of each row of ``moves`` (``key``, ``date_local``, ``d_t``): the same mixture as recursive SQL."""
    each = lambda text: ", ".join(text.replace("#", str(i)) for i in range(3))
    starts = " UNION ALL ".join(
        f"SELECT {key}, {r} AS restart, 0 AS it, {each('1.0::DOUBLE / 3 AS w#')}, "
        + ", ".join(f"quantile_cont(z, {p!r}) AS m{i}" for i, p in enumerate(means)) + ", "
        + ", ".join(f"{v!r}::DOUBLE AS v{i}" for i, v in enumerate(variances))
        + f", 0.0::DOUBLE AS likelihood FROM z GROUP BY {key}"
        for r, (means, variances) in enumerate(stats.STARTS)
    )
    return f"""
    WITH RECURSIVE z AS MATERIALIZED (
        SELECT *, (d_t - avg(d_t) OVER (PARTITION BY {key})) / stddev_pop(d_t) OVER (PARTITION BY {key}) AS z FROM ({moves}) WHERE d_t IS NOT NULL),
    em AS ({starts}
        UNION ALL
        SELECT {key}, restart, it + 1, {each('s# / (s0 + s1 + s2)')}, {each('a# / s#')},
               {each(f'greatest(b# / s# - (a# / s#) * (a# / s#), 0.0::DOUBLE) + {stats.VARIANCE_FLOOR!r}::DOUBLE')}, likelihood
        FROM (SELECT {key}, restart, it, {each('sum(p# / (p0 + p1 + p2)) + 1e-12::DOUBLE AS s#')},
                     {each('sum(p# / (p0 + p1 + p2) * z) AS a#')}, {each('sum(p# / (p0 + p1 + p2) * z * z) AS b#')},
                     sum(ln(p0 + p1 + p2)) AS likelihood
              FROM (SELECT {key}, restart, it, z, {each('w# / sqrt(v#) * exp(-0.5::DOUBLE * (z - m#) * (z - m#) / v#) AS p#')}
                    FROM em JOIN z USING ({key}) WHERE it < {stats.EM_ITERATIONS})
              GROUP BY 1, 2, 3)),
    fit AS (SELECT {key}, list_sort([{{'v': v0, 'm': m0, 'w': w0}}, {{'v': v1, 'm': m1, 'w': w1}}, {{'v': v2, 'm': m2, 'w': w2}}]) AS c
            FROM em WHERE it = {stats.EM_ITERATIONS}
            QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY likelihood DESC, restart) = 1),
    density AS (SELECT z.*, [ln(x.w) - 0.5::DOUBLE * (ln(x.v) + (z - x.m) * (z - x.m) / x.v) for x in c] AS d FROM z JOIN fit USING ({key}))
    SELECT *, ['calm', 'elevated', 'crisis'][list_position(d, list_max(d))] AS regime FROM density"""


def checksum_sql(digest: str) -> str:
    """Sums of both halves of a column of md5 digests."""
    half = lambda at: f"sum(('0x' || substr({digest}, {at}, 16))::UBIGINT)::VARCHAR"
    return f"{half(1)} || ':' || {half(17)}"


def garch_sql(moves: str) -> str:
    """GARCH(1,1) grid of each ``zone`` of ``moves`` as a recursion over its days."""
    return f"""
    WITH RECURSIVE x AS MATERIALIZED (SELECT zone, d_t, row_number() OVER (PARTITION BY zone ORDER BY date_local) AS i,
               avg(d_t) OVER (PARTITION BY zone) AS mu, var_pop(d_t) OVER (PARTITION BY zone) AS v, count(*) OVER (PARTITION BY zone) AS n_obs
        FROM ({moves}) WHERE d_t IS NOT NULL),
    g AS (SELECT alpha::DOUBLE AS alpha, beta::DOUBLE AS beta FROM (SELECT unnest({list(stats.GARCH_ALPHAS)}) AS alpha), (SELECT unnest({list(stats.GARCH_BETAS)}) AS beta)
          WHERE alpha + beta < 1),
    f AS (SELECT zone, alpha, beta, i, v AS h, -0.5 * (ln(v) + (d_t - mu) * (d_t - mu) / v) AS ll, d_t, mu, v FROM x, g WHERE i = 1
          UNION ALL
          SELECT f.zone, alpha, beta, x.i, nh, ll - 0.5 * (ln(nh) + (x.d_t - x.mu) * (x.d_t - x.mu) / nh), x.d_t, x.mu, x.v
          FROM (SELECT *, v * (1.0 - alpha - beta) + alpha * (d_t - mu) * (d_t - mu) + beta * h AS nh FROM f) f JOIN x ON x.zone = f.zone AND x.i = f.i + 1)
    SELECT f.zone, n_obs, alpha, beta, f.v * (1.0 - alpha - beta) AS omega, ll AS log_likelihood,
           sqrt(f.v * (1.0 - alpha - beta) + alpha * (f.d_t - f.mu) * (f.d_t - f.mu) + beta * h) AS next_vol, alpha + beta AS persistence
    FROM f JOIN x ON x.zone = f.zone AND x.i = f.i WHERE f.i = n_obs
    QUALIFY row_number() OVER (PARTITION BY f.zone ORDER BY ll DESC) = 1"""


EXPRESSIONS: dict[str, str] = {
    "raw_at": """
        SELECT o_orderdate + to_hours((o_orderkey * 7) % 24) + to_minutes(15 * q) AS ts_utc,
               (o_totalprice - 60000.0::DOUBLE) / 2477.0::DOUBLE + q * 0.37::DOUBLE AS price_eur_mwh,
               CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'PT15M' ELSE 'PT60M' END AS resolution,
               'AT' AS zone,
               strftime(o_orderdate + to_days((o_custkey % 30 + 1)::INT), '%Y-%m-%dT%H:%M:%S+00:00') AS ingested_at_utc
        FROM (SELECT *, unnest(CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN [0, 1, 2, 3] ELSE [0] END) AS q
              FROM orders)""",
    "raw_delu": """
        SELECT l_shipdate + to_hours((l_orderkey * 5 + l_linenumber * 13) % 24) AS ts_utc,
               (l_extendedprice - 12000.0::DOUBLE) / 523.0::DOUBLE AS price_eur_mwh,
               'PT60M' AS resolution, 'DE_LU' AS zone,
               strftime(l_shipdate + to_days((l_partkey % 30 + 1)::INT), '%Y-%m-%dT%H:%M:%S+00:00') AS ingested_at_utc
        FROM lineitem""",
    "raw_prices": "SELECT * FROM raw_at UNION ALL SELECT * FROM raw_delu",
    "raw_load": """
        SELECT l_shipdate + to_minutes(15 * ((l_orderkey * 11 + l_suppkey) % 96)) AS ts_utc,
               3000.0::DOUBLE + l_quantity * 181.3::DOUBLE + l_discount * 1000.0::DOUBLE AS load_mw
        FROM lineitem""",
    "psr": """
        SELECT * FROM (VALUES ('B01','Biomass'), ('B02','Fossil Brown coal/Lignite'), ('B03','Fossil Coal-derived gas'),
            ('B04','Fossil Gas'), ('B05','Fossil Hard coal'), ('B06','Fossil Oil'), ('B09','Geothermal'),
            ('B10','Hydro Pumped Storage'), ('B11','Hydro Run-of-river and poundage'), ('B12','Hydro Water Reservoir'),
            ('B13','Marine'), ('B14','Nuclear'), ('B15','Other renewable'), ('B16','Solar'), ('B17','Waste'),
            ('B18','Wind Offshore'), ('B19','Wind Onshore'), ('B20','Other')) AS t(psr_type, psr_name)""",
    "raw_gen": """
        SELECT g.ts_utc, g.psr_type, coalesce(p.psr_name, 'UNKNOWN(' || g.psr_type || ')') AS psr_name, g.kind, g.value_mw
        FROM (SELECT l_shipdate + to_hours((l_orderkey * 3 + l_linenumber) % 24) AS ts_utc,
                     'B' || lpad((l_partkey % 24 + 1)::VARCHAR, 2, '0') AS psr_type,
                     CASE WHEN l_partkey % 24 + 1 = 10 AND l_linestatus = 'O' THEN 'consumption' ELSE 'aggregated' END AS kind,
                     l_extendedprice / 97.0::DOUBLE AS value_mw
              FROM lineitem) g LEFT JOIN psr p ON g.psr_type = p.psr_type""",
    "weather": """
        SELECT o_orderdate::DATE AS date_local,
               round(10.0::DOUBLE - 12.0::DOUBLE * cos(2.0::DOUBLE * pi() * (dayofyear(o_orderdate::DATE) - 15) / 365.0::DOUBLE)
                     + (avg(o_totalprice) - 250000.0::DOUBLE) / 40000.0::DOUBLE, 1) + 0.0::DOUBLE AS tavg_c
        FROM orders GROUP BY 1""",
    "idx": """
        SELECT date_trunc('month', l_shipdate)::DATE AS month_local,
               coalesce(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), avg(l_extendedprice)) / 521.0::DOUBLE AS oespi_base,
               coalesce(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), avg(l_extendedprice)) / 617.0::DOUBLE AS oespi_peak
        FROM lineitem GROUP BY 1""",
    "native": """
        SELECT zone, ts_utc, price_eur_mwh, resolution FROM raw_prices
        QUALIFY row_number() OVER (PARTITION BY zone, ts_utc
            ORDER BY ingested_at_utc::TIMESTAMPTZ DESC, resolution, price_eur_mwh) = 1""",
    "prices": """
        SELECT zone, date_trunc('hour', ts_utc) AS ts_utc, avg(price_eur_mwh) AS price_eur_mwh, count(*) AS n_subhours
        FROM native GROUP BY 1, 2""",
    "sysload": "SELECT date_trunc('hour', ts_utc) AS ts_utc, avg(load_mw) AS load_mw FROM raw_load GROUP BY 1",
    "gen": """
        SELECT date_trunc('hour', ts_utc) AS ts_utc, psr_type, psr_name, avg(value_mw) AS gen_mw
        FROM raw_gen WHERE kind = 'aggregated' GROUP BY 1, 2, 3""",
    "calbounds": """
        SELECT min(o_orderdate)::DATE AS d0, last_day((max(o_orderdate) + INTERVAL 18 MONTH)::DATE) AS d1 FROM orders""",
    "easter": """
        SELECT y, make_date(y::INT, ((h + l - 7 * m + 114) // 31)::INT, ((h + l - 7 * m + 114) % 31 + 1)::INT) AS easter
        FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m
        FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l
        FROM (SELECT *, (19 * a + b - d - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k
        FROM (SELECT *, (b - (b + 8) // 25 + 1) // 3 AS g
        FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) // 4 AS d, (y // 100) % 4 AS e
              FROM (SELECT unnest(generate_series(year(d0) - 1, year(d1) + 1)) AS y FROM calbounds))))))""",
    "hol": """
        SELECT y, make_date(y::INT, md // 100, md % 100) AS d
        FROM easter, (SELECT unnest([101, 106, 501, 815, 1026, 1101, 1208, 1225, 1226]) AS md)
        UNION ALL SELECT y, (easter + o)::DATE FROM easter, (SELECT unnest([1, 39, 50, 60]) AS o)""",
    "hours0": """
        SELECT unnest(generate_series((d0::TIMESTAMP AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC',
                 ((d1 + 1)::TIMESTAMP AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' - INTERVAL 1 HOUR,
                 INTERVAL 1 HOUR)) AS ts_utc FROM calbounds""",
    "cal": """
        SELECT ts_utc, loc::DATE AS date_local, hour(loc)::INT AS hour_local, (isodow(loc) - 1)::INT AS dow_local,
               isodow(loc) >= 6 AS is_weekend, h.d IS NOT NULL AS is_holiday_at,
               isodow(loc) < 6 AND hour(loc) >= 8 AND hour(loc) < 20 AND h.d IS NULL AS is_peak_hour,
               year(loc)::INT AS year_local, month(loc)::INT AS month_local
        FROM (SELECT ts_utc, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS loc FROM hours0) s
        LEFT JOIN hol h ON h.d = s.loc::DATE""",
    "dimcal": """
        SELECT c.*, CASE WHEN month_local IN (11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END AS season,
               CASE WHEN tavg_c IS NOT NULL THEN greatest(0.0::DOUBLE, 18.0::DOUBLE - tavg_c) END AS hdd_18,
               CASE WHEN tavg_c IS NOT NULL THEN greatest(0.0::DOUBLE, tavg_c - 22.0::DOUBLE) END AS cdd_22
        FROM cal c LEFT JOIN weather w ON c.date_local = w.date_local""",
    "hourly": """
        SELECT c.ts_utc, a.price_eur_mwh AS price_at_eur_mwh, d.price_eur_mwh AS price_delu_eur_mwh,
               a.price_eur_mwh - d.price_eur_mwh AS spread_at_delu_eur_mwh, l.load_mw AS load_at_mw,
               a.price_eur_mwh < 0 AS is_negative_price, c.date_local, c.year_local, c.month_local, c.hour_local,
               c.dow_local, c.is_weekend, c.is_holiday_at, c.is_peak_hour, c.season, c.hdd_18, c.cdd_22
        FROM dimcal c
        LEFT JOIN (SELECT * FROM prices WHERE zone = 'AT') a ON c.ts_utc = a.ts_utc
        LEFT JOIN (SELECT * FROM prices WHERE zone = 'DE_LU') d ON c.ts_utc = d.ts_utc
        LEFT JOIN sysload l ON c.ts_utc = l.ts_utc""",
    "daily": """
        SELECT h.*, w.tavg_c FROM (
            SELECT date_local, avg(price_at_eur_mwh) AS price_base_eur_mwh,
                   avg(price_at_eur_mwh) FILTER (WHERE is_peak_hour) AS price_peak_eur_mwh,
                   min(price_at_eur_mwh) AS price_min, max(price_at_eur_mwh) AS price_max,
                   stddev_samp(price_at_eur_mwh) AS price_std,
                   count(*) FILTER (WHERE is_negative_price) AS n_negative_hours,
                   max(hdd_18) AS hdd_18, max(cdd_22) AS cdd_22
            FROM hourly GROUP BY date_local) h LEFT JOIN weather w ON h.date_local = w.date_local""",
    "pricewindow": """
        SELECT min(make_date(year_local, month_local, 1)) AS first_month, max(make_date(year_local, month_local, 1)) AS last_month
        FROM hourly WHERE price_at_eur_mwh IS NOT NULL""",
    "monthly": """
        SELECT m.*, i.oespi_base, i.oespi_peak FROM (
            SELECT year_local, month_local, avg(price_at_eur_mwh) AS price_base_eur_mwh,
                   avg(price_at_eur_mwh) FILTER (WHERE is_peak_hour) AS price_peak_eur_mwh,
                   avg(price_at_eur_mwh) FILTER (WHERE NOT is_peak_hour) AS price_offpeak_eur_mwh,
                   count(*) FILTER (WHERE is_negative_price) AS n_negative_hours
            FROM hourly GROUP BY 1, 2) m CROSS JOIN pricewindow
        LEFT JOIN idx i ON i.month_local = make_date(m.year_local, m.month_local, 1)
        WHERE make_date(m.year_local, m.month_local, 1) BETWEEN first_month AND last_month""",
    "generation": """
        SELECT *, gen_gwh / sum(gen_gwh) OVER (PARTITION BY year_local, month_local) AS share_of_total FROM (
            SELECT c.year_local, c.month_local, g.psr_type, max(g.psr_name) AS psr_name, sum(g.gen_mw) / 1000.0::DOUBLE AS gen_gwh
            FROM gen g JOIN dimcal c ON g.ts_utc = c.ts_utc GROUP BY 1, 2, 3)""",
    "dq": """
        SELECT cm.year_local, cm.month_local, expected_hours, coalesce(priced_hours_at, 0) AS priced_hours_at,
               coalesce(priced_hours_delu, 0) AS priced_hours_delu, coalesce(load_hours, 0) AS load_hours,
               coalesce(weather_days, 0) AS weather_days, days_in_month,
               round(100.0::DOUBLE * coalesce(priced_hours_at, 0) / expected_hours, 3) AS coverage_at_pct,
               coalesce(n_dst_days, 0) AS n_dst_days, coalesce(n_hours_from_pt15m, 0) AS n_hours_from_pt15m,
               CASE WHEN coalesce(n_hours_from_pt15m, 0) = 0 THEN 'PT60M'
                    WHEN n_hours_from_pt15m = priced_hours_at THEN 'PT15M' ELSE 'mixed' END AS resolution,
               coalesce(h.n_negative_hours, 0) AS n_negative_hours, m.oespi_base IS NOT NULL AS has_oespi
        FROM (SELECT year_local, month_local, count(*) AS expected_hours, count(DISTINCT date_local) AS days_in_month
              FROM dimcal GROUP BY 1, 2) cm CROSS JOIN pricewindow
        LEFT JOIN (SELECT f.year_local, f.month_local, count(f.price_at_eur_mwh) AS priced_hours_at,
                          count(f.price_delu_eur_mwh) AS priced_hours_delu, count(f.load_at_mw) AS load_hours,
                          count(*) FILTER (WHERE f.is_negative_price) AS n_negative_hours,
                          count(*) FILTER (WHERE s.n_subhours = 4) AS n_hours_from_pt15m
                   FROM hourly f LEFT JOIN (SELECT * FROM prices WHERE zone = 'AT') s ON f.ts_utc = s.ts_utc
                   GROUP BY 1, 2) h ON cm.year_local = h.year_local AND cm.month_local = h.month_local
        LEFT JOIN (SELECT year_local, month_local, count(*) AS n_dst_days FROM (
                       SELECT year_local, month_local, date_local FROM dimcal GROUP BY 1, 2, 3 HAVING count(*) <> 24)
                   GROUP BY 1, 2) d ON cm.year_local = d.year_local AND cm.month_local = d.month_local
        LEFT JOIN (SELECT year(date_local) AS y, month(date_local) AS m, count(tavg_c) AS weather_days FROM weather GROUP BY 1, 2) w
            ON cm.year_local = w.y AND cm.month_local = w.m
        LEFT JOIN monthly m ON cm.year_local = m.year_local AND cm.month_local = m.month_local
        WHERE make_date(cm.year_local, cm.month_local, 1) BETWEEN first_month AND last_month""",
    "spreadmonthly": """
        SELECT year_local, month_local, avg(spread_at_delu_eur_mwh) AS spread_mean_eur_mwh,
               100.0::DOUBLE * avg(CASE WHEN spread_at_delu_eur_mwh > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_at_above_de_pct
        FROM hourly WHERE spread_at_delu_eur_mwh IS NOT NULL GROUP BY 1, 2""",
    "shape": """
        SELECT [0.65,0.65,0.65,0.65,0.65,0.75,0.95,1.00,1.00,1.00,1.00,1.00,
                0.95,1.00,1.00,1.00,1.00,0.95,0.85,0.80,0.75,0.70,0.65,0.65]::DOUBLE[] AS weekday,
               [0.30,0.30,0.30,0.30,0.30,0.30,0.32,0.35,0.35,0.35,0.35,0.35,
                0.35,0.35,0.35,0.35,0.35,0.33,0.32,0.30,0.30,0.30,0.30,0.30]::DOUBLE[] AS weekend,
               [1.06,1.05,1.02,1.00,0.98,0.96,0.95,0.95,0.98,1.01,1.04,1.05]::DOUBLE[] AS seasonal""",
    "fullcal": """
        SELECT date_local, hour_local, dow_local, month_local, year_local, hd.d IS NOT NULL AS is_holiday_at FROM (
            SELECT loc::DATE AS date_local, hour(loc) AS hour_local, isodow(loc) - 1 AS dow_local,
                   month(loc) AS month_local, year(loc)::INT AS year_local
            FROM (SELECT (t AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Vienna' AS loc FROM (
                SELECT unnest(generate_series((make_date(year(d0)::INT, 1, 1)::TIMESTAMP AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC',
                    (make_date(year(d1)::INT + 1, 1, 1)::TIMESTAMP AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' - INTERVAL 1 HOUR,
                    INTERVAL 1 HOUR)) AS t FROM calbounds)))
        LEFT JOIN hol hd ON hd.d = date_local""",
    "monday": """
        SELECT y::INT AS y, make_date(y::INT, 8, 1) + ((8 - isodow(make_date(y::INT, 8, 1))) % 7)::INT AS m FROM easter""",
    "fullweight": """
        SELECT c.year_local, count(*) AS n_year,
               sum(CASE WHEN strftime(date_local, '%m-%d') >= '12-24' OR strftime(date_local, '%m-%d') <= '01-01' THEN 0.18::DOUBLE
                        WHEN is_holiday_at OR dow_local >= 5 THEN weekend[hour_local + 1] ELSE weekday[hour_local + 1] END
                   * seasonal[month_local]
                   * CASE WHEN date_local BETWEEN m AND m + 6 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) AS w_year
        FROM fullcal c JOIN monday ON y = c.year_local CROSS JOIN shape GROUP BY 1""",
    "conload": """
        SELECT 'main' AS profile, c.ts_utc, 50000.0::DOUBLE * (
               CASE WHEN strftime(date_local, '%m-%d') >= '12-24' OR strftime(date_local, '%m-%d') <= '01-01' THEN 0.18::DOUBLE
                    WHEN is_holiday_at OR dow_local >= 5 THEN weekend[hour_local + 1] ELSE weekday[hour_local + 1] END
               * seasonal[c.month_local]
               * CASE WHEN date_local BETWEEN m AND m + 6 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) / w_year AS load_mwh,
               c.date_local, c.year_local, c.month_local, c.hour_local, c.is_weekend, c.is_holiday_at, c.is_peak_hour
        FROM cal c JOIN monday ON y = c.year_local JOIN fullweight f ON f.year_local = c.year_local CROSS JOIN shape
        UNION ALL
        SELECT 'flat_baseload', c.ts_utc, 50000.0::DOUBLE / n_year, c.date_local, c.year_local, c.month_local, c.hour_local,
               c.is_weekend, c.is_holiday_at, c.is_peak_hour
        FROM cal c JOIN fullweight f ON f.year_local = c.year_local""",
    "spot": """
        SELECT profile, c.year_local, c.month_local,
               sum(load_mwh) FILTER (WHERE price_at_eur_mwh IS NOT NULL) AS volume_mwh,
               sum(load_mwh * price_at_eur_mwh) AS spot_cost_eur,
               count(*) FILTER (WHERE price_at_eur_mwh IS NULL) AS dropped_hours,
               count(*) FILTER (WHERE price_at_eur_mwh IS NOT NULL) AS priced_hours
        FROM conload l JOIN dimcal c ON l.ts_utc = c.ts_utc JOIN hourly p ON l.ts_utc = p.ts_utc
        GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE price_at_eur_mwh IS NOT NULL) > 0""",
    "obs": "SELECT year_local, month_local, oespi_base, oespi_peak FROM monthly WHERE oespi_base IS NOT NULL",
    "refstats": """
        SELECT profile, sum(load_mwh * price_at_eur_mwh) AS consumer_cost_eur, sum(load_mwh) AS consumer_volume_mwh,
               avg(price_at_eur_mwh) AS mean_price_all_hours_eur_mwh,
               avg(price_at_eur_mwh) FILTER (WHERE c.is_peak_hour) AS mean_price_peak_eur_mwh
        FROM conload l JOIN dimcal c ON l.ts_utc = c.ts_utc JOIN hourly p ON l.ts_utc = p.ts_utc
        WHERE c.year_local = 1995 AND price_at_eur_mwh IS NOT NULL GROUP BY 1""",
    "anc": """
        SELECT profile, consumer_cost_eur / consumer_volume_mwh AS p_ref_base,
               mean_price_peak_eur_mwh * ((consumer_cost_eur / consumer_volume_mwh) / mean_price_all_hours_eur_mwh) AS p_ref_peak,
               (SELECT avg(oespi_base) FROM obs WHERE year_local = 1995) AS oespi_base_ref,
               (SELECT avg(oespi_peak) FROM obs WHERE year_local = 1995) AS oespi_peak_ref
        FROM refstats""",
    "peakshare": """
        SELECT profile, sum(load_mwh) FILTER (WHERE is_peak_hour) / sum(load_mwh) AS peak_share
        FROM conload l JOIN (SELECT c.year_local FROM cal c JOIN fullweight f ON f.year_local = c.year_local
                             GROUP BY c.year_local, f.n_year HAVING count(*) = f.n_year) y ON l.year_local = y.year_local
        GROUP BY 1""",
    "scen": """
        SELECT scenario, a.profile, premium, lock_months, p_ref_base, p_ref_peak, oespi_base_ref, oespi_peak_ref, peak_share AS w_peak
        FROM (VALUES ('base', 'main', 5.0::DOUBLE, [7,8,9,10,11,12]), ('premium_0', 'main', 0.0::DOUBLE, [7,8,9,10,11,12]),
                     ('premium_10', 'main', 10.0::DOUBLE, [7,8,9,10,11,12]),
                     ('flat_baseload', 'flat_baseload', 5.0::DOUBLE, [7,8,9,10,11,12]),
                     ('lock_full_prior_year', 'main', 5.0::DOUBLE, [1,2,3,4,5,6,7,8,9,10,11,12])) s(scenario, profile, premium, lock_months)
        JOIN anc a ON a.profile = s.profile JOIN peakshare p ON p.profile = s.profile""",
    "locks": """
        SELECT profile, scenario, year_local + 1 AS year_local,
               any_value(p_ref_base) * avg(oespi_base) / any_value(oespi_base_ref) * (1 - any_value(w_peak))
               + any_value(p_ref_peak) * avg(oespi_peak) / any_value(oespi_peak_ref) * any_value(w_peak) + any_value(premium) AS lock_price
        FROM scen JOIN obs ON list_contains(lock_months, month_local)
        WHERE year_local + 1 BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3""",
    "scencosts": """
        SELECT profile, scenario, year_local, month_local, kv.k AS strategy_id, volume_mwh, kv.v AS cost_eur,
               kv.v / volume_mwh AS unit_cost_eur_mwh FROM (
            SELECT *, unnest([{'k': 'S1', 'v': s1}, {'k': 'S2', 'v': s2}, {'k': 'S3', 'v': s3},
                              {'k': 'S4_30', 'v': 0.3::DOUBLE * s3 + 0.7::DOUBLE * s1},
                              {'k': 'S4_50', 'v': 0.5::DOUBLE * s3 + 0.5::DOUBLE * s1},
                              {'k': 'S4_70', 'v': 0.7::DOUBLE * s3 + (1.0::DOUBLE - 0.7::DOUBLE) * s1}]) AS kv
            FROM (SELECT p.profile, s.scenario, p.year_local, p.month_local, p.volume_mwh, p.spot_cost_eur AS s1,
                         p.volume_mwh * (p_ref_base * oespi_base / oespi_base_ref * (1 - w_peak)
                                         + p_ref_peak * oespi_peak / oespi_peak_ref * w_peak) AS s2,
                         p.volume_mwh * lock_price AS s3
                  FROM spot p JOIN scen s ON p.profile = s.profile
                  LEFT JOIN obs o ON o.year_local = p.year_local AND o.month_local = p.month_local
                  LEFT JOIN locks l ON l.scenario = s.scenario AND l.year_local = p.year_local
                  WHERE p.year_local BETWEEN 1996 AND 2000))""",
    "costs": "SELECT * EXCLUDE (scenario, profile) FROM scencosts WHERE scenario = 'base'",
    "annual": """
        SELECT year, strategy_id, volume_mwh, cost_eur, cost_eur / volume_mwh AS unit_cost_eur_mwh,
               cost_eur - min(cost_eur) OVER (PARTITION BY year) AS delta_vs_min_eur,
               (rank() OVER (PARTITION BY year ORDER BY cost_eur))::INT AS rank
        FROM (SELECT year_local AS year, strategy_id, sum(volume_mwh) AS volume_mwh, sum(cost_eur) AS cost_eur
              FROM costs GROUP BY 1, 2)""",
    "diffs": """
        SELECT * FROM (
            SELECT date_local, price_base_eur_mwh, d_t,
                   CASE WHEN count(d_t) OVER r = 30 THEN stddev_samp(d_t) OVER r END AS realized_vol
            FROM (SELECT date_local, price_base_eur_mwh,
                         price_base_eur_mwh - lag(price_base_eur_mwh) OVER (ORDER BY date_local) AS d_t
                  FROM daily WHERE price_base_eur_mwh IS NOT NULL)
            WINDOW r AS (ORDER BY date_local ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
        WHERE d_t IS NOT NULL""",
    "labelled": f"""
        SELECT * EXCLUDE (series, z, d) FROM ({regimes_sql("SELECT *, 'AT' AS series FROM diffs", "series")})""",
    "decregimes": """
        SELECT y AS year_local, regime FROM (
            SELECT year(date_local)::INT AS y, regime, row_number() OVER (PARTITION BY year(date_local) ORDER BY count(*) DESC, regime) AS rn
            FROM labelled WHERE month(date_local) = 12 GROUP BY 1, 2, year(date_local)) WHERE rn = 1""",
    "lastmonth": """
        SELECT max(make_date(year_local, month_local, 1)) AS last_month FROM monthly WHERE price_base_eur_mwh IS NOT NULL""",
    "targets": """
        SELECT i::INT AS target_idx, year(m)::INT AS year_local, month(m)::INT AS month_local
        FROM (SELECT i, last_month + to_months((i + 1)::INT) AS m FROM lastmonth, (SELECT unnest(range(12)) AS i))""",
    "pool": """
        SELECT variant, month_local, year_local AS pool_year,
               (row_number() OVER (PARTITION BY variant, month_local ORDER BY year_local) - 1)::INT AS pool_idx,
               (count(*) OVER (PARTITION BY variant, month_local))::INT AS n_pool
        FROM (SELECT 'unconditional' AS variant, month_local, year_local FROM obs
              UNION ALL SELECT 'no_crisis', month_local, year_local FROM obs
              WHERE year_local NOT IN (SELECT year_local FROM decregimes WHERE regime = 'crisis'))""",
    "drawnhours": """
        SELECT year_local AS pool_year, month_local, day(date_local) AS d, hour_local, avg(price_at_eur_mwh) AS price
        FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "drawnshape": """
        SELECT year_local AS pool_year, month_local, max(day(date_local)) AS n_days,
               coalesce(max(day(date_local)) FILTER (WHERE is_weekend OR is_holiday_at), max(day(date_local))) AS last_free,
               coalesce(max(day(date_local)) FILTER (WHERE NOT (is_weekend OR is_holiday_at)), max(day(date_local))) AS last_work
        FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY 1, 2""",
    "aligned": """
        SELECT target_idx, delivery_year, month_local, pool_year, ts_utc, hour_local, day_local, src_day, load_mwh,
               coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY target_idx, pool_year ORDER BY ts_utc
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        first_value(price IGNORE NULLS) OVER (PARTITION BY target_idx, pool_year ORDER BY ts_utc
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price
        FROM (SELECT k.*, x.price FROM (
                SELECT t.target_idx, l.year_local AS delivery_year, l.month_local, s.pool_year, l.ts_utc, l.hour_local,
                       day(l.date_local)::INT AS day_local, l.load_mwh,
                       (CASE WHEN day(l.date_local) <= n_days THEN day(l.date_local)
                            WHEN l.is_weekend OR l.is_holiday_at THEN last_free ELSE last_work END)::INT AS src_day
                FROM conload l JOIN targets t ON l.year_local = t.year_local AND l.month_local = t.month_local
                JOIN (SELECT DISTINCT month_local, pool_year FROM pool) p ON p.month_local = l.month_local
                JOIN drawnshape s ON s.pool_year = p.pool_year AND s.month_local = l.month_local
                WHERE l.profile = 'main') k
              LEFT JOIN drawnhours x ON x.pool_year = k.pool_year AND x.month_local = k.month_local
                   AND x.d = k.src_day AND x.hour_local = k.hour_local)""",
    "cells": """
        SELECT variant, target_idx, delivery_year, c.month_local, c.pool_year, pool_idx, n_pool, spot_cost_eur, volume_mwh,
               oespi_base, oespi_peak
        FROM (SELECT target_idx, delivery_year, month_local, pool_year, sum(load_mwh * price) AS spot_cost_eur,
                     sum(load_mwh) AS volume_mwh FROM aligned GROUP BY 1, 2, 3, 4) c
        JOIN obs o ON o.year_local = c.pool_year AND o.month_local = c.month_local
        JOIN pool p ON p.pool_year = c.pool_year AND p.month_local = c.month_local""",
    "draws": """
        SELECT c_custkey AS path, variant, target_idx, n_pool,
               (('0x' || substr(md5('42|' || c_custkey || '|' || target_idx), 1, 8))::BIGINT % n_pool)::INT AS pool_idx
        FROM customer, (SELECT DISTINCT variant, target_idx, n_pool FROM cells)""",
    "locksource": """
        SELECT y.delivery_year::INT AS delivery_year, (y.delivery_year - 1)::INT AS year_local, m::INT AS month_local, o.oespi_base AS obs_base, o.oespi_peak AS obs_peak,
               t.target_idx, lb.oespi_base AS last_base, lb.oespi_peak AS last_peak
        FROM (SELECT DISTINCT year_local AS delivery_year FROM targets) y
        CROSS JOIN (SELECT unnest([7,8,9,10,11,12]) AS m)
        CROSS JOIN (SELECT * FROM obs ORDER BY year_local DESC, month_local DESC LIMIT 1) lb
        LEFT JOIN obs o ON o.year_local = y.delivery_year - 1 AND o.month_local = m
        LEFT JOIN targets t ON t.year_local = y.delivery_year - 1 AND t.month_local = m""",
    "pathlock": """
        SELECT p.path, p.variant, s.delivery_year,
               any_value(p_ref_base) * avg(coalesce(obs_base, c.oespi_base, last_base)) / any_value(oespi_base_ref) * (1 - any_value(w_peak))
               + any_value(p_ref_peak) * avg(coalesce(obs_peak, c.oespi_peak, last_peak)) / any_value(oespi_peak_ref) * any_value(w_peak)
               + any_value(premium) AS lock_price
        FROM (SELECT DISTINCT path, variant FROM draws) p CROSS JOIN locksource s
        CROSS JOIN (SELECT * FROM scen WHERE scenario = 'base')
        LEFT JOIN draws d ON d.path = p.path AND d.variant = p.variant AND d.target_idx = s.target_idx
        LEFT JOIN cells c ON c.variant = d.variant AND c.target_idx = d.target_idx AND c.pool_idx = d.pool_idx
        GROUP BY 1, 2, 3""",
    "pathcosts": """
        SELECT variant, path, kv.k AS strategy_id, kv.v AS cost_eur FROM (
            SELECT variant, path, unnest([{'k': 'S1', 'v': s1}, {'k': 'S2', 'v': s2}, {'k': 'S3', 'v': s3},
                       {'k': 'S4_30', 'v': 0.3::DOUBLE * s3 + 0.7::DOUBLE * s1}, {'k': 'S4_50', 'v': 0.5::DOUBLE * s3 + 0.5::DOUBLE * s1},
                       {'k': 'S4_70', 'v': 0.7::DOUBLE * s3 + (1.0::DOUBLE - 0.7::DOUBLE) * s1}]) AS kv
            FROM (SELECT d.variant, d.path, sum(c.spot_cost_eur) AS s1,
                         sum(c.volume_mwh * (p_ref_base * oespi_base / oespi_base_ref * (1 - w_peak)
                                             + p_ref_peak * oespi_peak / oespi_peak_ref * w_peak)) AS s2,
                         sum(c.volume_mwh * lock_price) AS s3
                  FROM draws d JOIN cells c ON c.variant = d.variant AND c.target_idx = d.target_idx AND c.pool_idx = d.pool_idx
                  JOIN pathlock l ON l.path = d.path AND l.variant = d.variant AND l.delivery_year = c.delivery_year
                  CROSS JOIN (SELECT * FROM scen WHERE scenario = 'base') GROUP BY 1, 2))""",
    "risksum": """
        SELECT variant, strategy_id, avg(cost_eur) AS mean, stddev_samp(cost_eur) AS std, quantile_cont(cost_eur, 0.05) AS p5,
               quantile_cont(cost_eur, 0.5) AS p50, quantile_cont(cost_eur, 0.95) AS p95,
               avg(cost_eur) FILTER (WHERE worst <= ceil(0.05 * n)) AS cvar95
        FROM (SELECT *, row_number() OVER (PARTITION BY variant, strategy_id ORDER BY cost_eur DESC) AS worst,
                     count(*) OVER (PARTITION BY variant, strategy_id) AS n FROM pathcosts)
        GROUP BY 1, 2""",
    "dimstrategy": """
        SELECT * FROM (VALUES ('S1', 'FULL_SPOT', 'All volume at AT day-ahead hourly price', 1),
            ('S2', 'OESPI_INDEXED', 'Monthly price indexed to OESPI (base/peak blended)', 2),
            ('S3', 'FIXED_ANNUAL', 'Single annual price locked pre-year via OESPI proxy', 3),
            ('S4_30', 'HYBRID_30', '30% hedged at S3 price + 70% spot', 4),
            ('S4_50', 'HYBRID_50', '50% hedged + 50% spot', 5),
            ('S4_70', 'HYBRID_70', '70% hedged + 30% spot', 6)) t(strategy_id, strategy_name, description, sort_order)""",
    "fullyears": """
        SELECT year_local FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY 1
        HAVING count(*) >= 0.9 * (SELECT max(n) FROM (SELECT count(*) AS n FROM hourly WHERE price_at_eur_mwh IS NOT NULL GROUP BY year_local))""",
    "garchfit": f"""
        SELECT * FROM ({garch_sql("SELECT 'AT' AS zone, date_local, d_t FROM diffs")})""",
    "published": """
        SELECT 'wrong_strategy_cost_' || year AS key, printf('%.2f', max(cost_eur) - min(cost_eur)) AS value, 'EUR' AS unit,
               'CALIBRATED' AS tag, 'strategies/retrospective' AS produced_by FROM annual GROUP BY year
        UNION ALL SELECT 'wrong_strategy_cost_total', printf('%.2f', sum(w)), 'EUR', 'CALIBRATED', 'strategies/retrospective'
        FROM (SELECT max(cost_eur) - min(cost_eur) AS w FROM annual GROUP BY year)
        UNION ALL SELECT 'cost_' || strategy_id || '_' || year, printf('%.2f', cost_eur), 'EUR', 'CALIBRATED', 'strategies/retrospective' FROM annual
        UNION ALL SELECT 'unit_cost_' || strategy_id || '_' || year, printf('%.4f', unit_cost_eur_mwh), 'EUR/MWh', 'CALIBRATED', 'strategies/retrospective' FROM annual
        UNION ALL SELECT 'cost5yr_' || strategy_id, printf('%.2f', sum(cost_eur)), 'EUR', 'CALIBRATED', 'strategies/retrospective' FROM annual GROUP BY strategy_id
        UNION ALL SELECT 'best_strategy_5yr', arg_min(strategy_id, c), 'strategy_id', 'CALIBRATED', 'strategies/retrospective'
        FROM (SELECT strategy_id, sum(cost_eur) AS c FROM annual GROUP BY 1)
        UNION ALL SELECT kv.k, printf('%.4f', kv.v), kv.u, 'CALIBRATED', 'strategies/retrospective' FROM (
            SELECT unnest([{'k': 'p_ref_base', 'v': p_ref_base, 'u': 'EUR/MWh'}, {'k': 'p_ref_peak', 'v': p_ref_peak, 'u': 'EUR/MWh'},
                           {'k': 'oespi_base_ref', 'v': oespi_base_ref, 'u': 'index'}, {'k': 'oespi_peak_ref', 'v': oespi_peak_ref, 'u': 'index'}]) AS kv
            FROM scen WHERE scenario = 'base')
        UNION ALL SELECT 'consumer_peak_share' || CASE profile WHEN 'main' THEN '' ELSE '_' || profile END, printf('%.4f', peak_share), 'share',
               'CALIBRATED', 'consumer/profile' FROM peakshare
        UNION ALL SELECT kv.k || '_next12m' || CASE variant WHEN 'unconditional' THEN '' ELSE '_nocrisis' END || '_' || strategy_id,
               printf('%.2f', kv.v), 'EUR', 'SIMULATED', 'strategies/forward_risk' FROM (
            SELECT variant, strategy_id, unnest([{'k': 'mean', 'v': mean}, {'k': 'p5', 'v': p5}, {'k': 'p50', 'v': p50}, {'k': 'p95', 'v': p95},
                                                 {'k': 'cvar95', 'v': cvar95}]) AS kv FROM risksum)
        UNION ALL SELECT 'annual_mean_price_' || year_local, printf('%.2f', avg(price_at_eur_mwh)), 'EUR/MWh', 'VERIFIED', 'analytics/descriptive'
        FROM hourly WHERE price_at_eur_mwh IS NOT NULL AND year_local IN (SELECT year_local FROM fullyears) GROUP BY year_local
        UNION ALL SELECT 'neg_hours_' || year_local, (sum(n_negative_hours)::BIGINT)::VARCHAR, 'hours', 'VERIFIED', 'analytics/descriptive'
        FROM monthly WHERE year_local IN (SELECT year_local FROM fullyears) GROUP BY year_local
        UNION ALL SELECT 'spread_mean_' || year_local, printf('%.2f', avg(spread_at_delu_eur_mwh)), 'EUR/MWh', 'VERIFIED', 'analytics/spread'
        FROM hourly WHERE spread_at_delu_eur_mwh IS NOT NULL AND year_local IN (SELECT year_local FROM fullyears) GROUP BY year_local
        UNION ALL SELECT 'garch_persistence', printf('%.4f', persistence), 'ratio', 'VERIFIED', 'analytics/volatility' FROM garchfit
        UNION ALL SELECT 'data_last_month', strftime(last_month, '%Y-%m'), 'month', 'VERIFIED', 'analytics/descriptive' FROM lastmonth""",
}


def _used(sql: str) -> list[str]:
    """Names of shared expressions in ``sql``, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in EXPRESSIONS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b|\b{name}\s*,\s*\(", text):
                visit(EXPRESSIONS[name])
                order.append(name)

    visit(sql)
    return order


def with_expressions(sql: str, digits: dict[str, int]) -> str:
    """Prefix the needed table expressions and round the floating columns."""
    names = _used(sql)
    head = ",\n".join(f"{n} AS MATERIALIZED ({EXPRESSIONS[n]})" for n in names)
    body = f"SELECT * FROM ({sql})"
    if digits:
        rounded = ", ".join(f"round({c}, {d}) + 0.0::DOUBLE AS {c}" for c, d in digits.items())
        body = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
    return f"WITH {head}\n{body}" if names else body
