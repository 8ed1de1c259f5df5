"""Shared SQL views (common table expressions) for the oracle side of each query."""

from __future__ import annotations

from weekloom.constants import CLIMATE_VARIABLES, DISEASES, ROLLING_WINDOWS, TARGET_LAGS, WEEKLY_CLIMATE

_AGG = ", ".join(f"{f}({v}) AS {v}_{n}" for v in CLIMATE_VARIABLES for f, n in (("max", "max"), ("min", "min"), ("avg", "avg")))
_SERIES_W = "PARTITION BY disease, district ORDER BY week_start"


def climate_agg() -> str:
    return _AGG


def rounded(columns, digits: int = 6, cast: str = "DOUBLE") -> str:
    return ", ".join(f"round(CAST({c} AS {cast}), {digits}) AS {c}" for c in columns)


def _features_sql() -> str:
    w = _SERIES_W
    lags = ", ".join(f"lag(target, {k}) OVER ({w}) AS target_lag_{k}" for k in TARGET_LAGS)
    roll = ", ".join(
        f"{f}(target) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS target_roll_{s}_{n}"
        for n in ROLLING_WINDOWS
        for f, s in (("avg", "mean"), ("stddev_samp", "std"), ("max", "max"), ("min", "min"))
    )
    clags = ", ".join(
        f"lag({c}, {k}) OVER ({w}) AS {c}_lag_{k}"
        for c in ("PRECTOTCORR_avg", "T2M_avg", "RH2M_avg") for k in range(1, 7)
    )
    rain = lambda n: " + ".join(f"coalesce(PRECTOTCORR_avg_lag_{k}, 0)" for k in range(1, n + 1))
    return f"""
SELECT f3.*, target_trend_4 - lag(target_trend_4) OVER ({w}) AS target_accel,
  T2M_avg * RH2M_avg AS heat_humidity, PRECTOTCORR_avg * RH2M_avg AS rain_humidity,
  PRECTOTCORR_avg * T2M_avg AS rain_temp, T2M_max - T2M_min AS temp_range,
  PRECTOTCORR_avg_lag_1 * RH2M_avg_lag_1 AS rain_hum_lag1, PRECTOTCORR_avg_lag_2 * RH2M_avg_lag_2 AS rain_hum_lag2,
  {rain(4)} AS cum_rain_4w, {rain(6)} AS cum_rain_8w,
  target_roll_mean_4 - district_week_mean AS excess_over_seasonal,
  target_roll_mean_4 / (district_week_mean + 0.5) AS ratio_to_seasonal
FROM (SELECT f2.*, target_roll_mean_4 - lag(target_roll_mean_4) OVER ({w}) AS target_trend_4,
             target_roll_mean_8 - lag(target_roll_mean_8) OVER ({w}) AS target_trend_8
      FROM (SELECT p.*, {lags}, {roll}, {clags}, coalesce(m.m, dm.m) AS district_week_mean,
                   coalesce(lm.m, dm.m) AS late_dist_mean, e.code AS district_enc
            FROM panel p
            LEFT JOIN (SELECT disease, district, week_number, avg(target) AS m FROM panel WHERE split = 'train' GROUP BY ALL) m
              USING (disease, district, week_number)
            LEFT JOIN (SELECT disease, district, avg(target) AS m FROM panel WHERE split = 'train' GROUP BY ALL) dm
              USING (disease, district)
            LEFT JOIN (SELECT disease, district, avg(target) AS m FROM panel WHERE split = 'train'
                         AND week_index >= (SELECT max(week_index) - 52 FROM panel WHERE split = 'train') GROUP BY ALL) lm
              USING (disease, district)
            JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS code FROM nation) e ON e.n_name = p.district) f2) f3
"""


_FINISH = """coalesce(target, 0) AS target, CAST(weekofyear(week_start) AS BIGINT) AS week_number,
  CASE WHEN week_index < cut THEN 'train' WHEN (week_index - cut) % 2 = 1 THEN 'val' ELSE 'test' END AS split"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cases_daily": ((), """
SELECT n_name AS district, CAST(o_orderdate AS DATE) AS d,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'leptospirosis' WHEN '2-HIGH' THEN 'typhus'
       WHEN '3-MEDIUM' THEN 'hepatitis_a' WHEN '5-LOW' THEN 'chickenpox' END AS disease
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority <> '4-NOT SPECIFIED'"""),
    "cases_weekly": (("cases_daily",), """
SELECT district, CAST(date_trunc('week', d) AS DATE) AS week_start, disease, CAST(count(*) AS BIGINT) AS target
FROM cases_daily GROUP BY district, CAST(date_trunc('week', d) AS DATE), disease"""),
    "cases_wide": (("cases_daily",), "SELECT district, CAST(date_trunc('week', d) AS DATE) AS week_start, " + ", ".join(
        f"CAST(nullif(count(*) FILTER (WHERE disease = '{d}'), 0) AS BIGINT) AS {d}" for d in DISEASES) + """
FROM cases_daily GROUP BY district, CAST(date_trunc('week', d) AS DATE)"""),
    "climate_daily": ((), """
SELECT n_name AS district, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS T2M, max(l_quantity) AS T2M_MAX,
  min(l_quantity) AS T2M_MIN, avg(l_discount) * 1000 AS RH2M, avg(l_extendedprice) / 9973 AS PRECTOTCORR
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, CAST(l_shipdate AS DATE)"""),
    "climate_weekly": (("climate_daily",), f"""
SELECT district, CAST(date_trunc('week', d) AS DATE) AS week_start, {_AGG}
FROM climate_daily GROUP BY district, CAST(date_trunc('week', d) AS DATE)"""),
    "span": ((), """
SELECT CAST(date_trunc('week', min(o_orderdate)) AS DATE) AS lo, CAST(date_trunc('week', max(o_orderdate)) AS DATE) AS hi FROM orders"""),
    "split_cut": (("span",), "SELECT CAST(floor(((hi - lo) // 7 + 1) * 4 / 5) AS BIGINT) AS cut FROM span"),
    "calendar": (("span",), """
SELECT n_name AS district, CAST(w AS DATE) AS week_start, CAST((CAST(w AS DATE) - lo) // 7 AS BIGINT) AS week_index
FROM nation, (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS w FROM span)"""),
    "panel_cases": (("calendar", "cases_wide"), "SELECT * FROM calendar LEFT JOIN cases_wide USING (district, week_start)"),
    "panel_wide": (("panel_cases", "climate_weekly"),
                   "SELECT * FROM panel_cases LEFT JOIN climate_weekly USING (district, week_start)"),
    "series": (("panel_cases", "split_cut"), "SELECT disease, district, week_start, week_index, " + _FINISH + " FROM (" + " UNION ALL ".join(
        f"SELECT '{d}' AS disease, district, week_start, week_index, {d} AS target FROM panel_cases" for d in DISEASES) + "), split_cut"),
    "panel": (("panel_wide", "split_cut"), "SELECT * EXCLUDE (target, cut), " + _FINISH + """,
  CAST(month(week_start) AS BIGINT) AS month, month(week_start) IN (10, 11) AS monsoon_IM2,
  month(week_start) IN (12, 1, 2) AS monsoon_NE, month(week_start) IN (5, 6, 7, 8, 9) AS monsoon_SW,
  sin(2 * pi() * weekofyear(week_start) / 52) AS sin_week, cos(2 * pi() * weekofyear(week_start) / 52) AS cos_week
FROM (""" + " UNION ALL ".join(
        f"SELECT '{d}' AS disease, * EXCLUDE ({', '.join(DISEASES)}), {d} AS target FROM panel_wide" for d in DISEASES) + "), split_cut"),
    "features": (("panel",), _features_sql()),
    "forecasts": (("series",), f"""
SELECT s.disease, s.district, week_start, week_index, s.week_number, split, target,
  coalesce(avg(target) OVER (PARTITION BY s.disease, s.district ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS a,
  coalesce(m.m, dm.m) AS b
FROM series s
LEFT JOIN (SELECT disease, district, week_number, avg(target) AS m FROM series WHERE split = 'train' GROUP BY ALL) m
  ON s.disease = m.disease AND s.district = m.district AND s.week_number = m.week_number
LEFT JOIN (SELECT disease, district, avg(target) AS m FROM series WHERE split = 'train' GROUP BY ALL) dm
  ON s.disease = dm.disease AND s.district = dm.district"""),
    "readings": ((), """
SELECT event_id, ts, 'D' || CAST(user_id % 25 AS VARCHAR) AS district, event_type, v AS T2M, v + 1 AS T2M_MAX,
  v - 1 AS T2M_MIN, (v * 3) % 101 AS RH2M, v / 3 AS PRECTOTCORR FROM (SELECT *, value / 7.31 AS v FROM events)"""),
}


def view(needs: str | tuple[str, ...], body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` prefixed with the views it needs, in dependency order, then local ``extra`` views."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in VIEWS[name][0]:
            add(dep)
        done.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in done] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


WEEKLY_COLUMNS = list(WEEKLY_CLIMATE)
