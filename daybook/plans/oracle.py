"""The same questions as plain SQL, for checking results with another engine.

Written from the meaning of each operator and, where there is a choice, in a
different shape than the Spark plan (joins instead of lags, nested aggregates
instead of grouping sets), so that a shared mistake is unlikely.
"""

from __future__ import annotations

from daybook.functions.distributions import UNIT_ROOT_ABOVE, UNIT_ROOT_BELOW, UNIT_ROOT_BEND, UNIT_ROOT_LEAST, UNIT_ROOT_MOST
from daybook.operators import marts, quality
from daybook.plans import bindings as b
from daybook.sources.lookups import CITY_CENTRE, POSTAL_AREAS

SLOTS = {
    "day": "CAST(CAST(l_shipdate AS DATE) + INTERVAL 24 YEAR AS DATE)",
    "order_day": "CAST(CAST(o_orderdate AS DATE) + INTERVAL 24 YEAR AS DATE)",
    "fmt_us": "strftime(d, '%m/%d/%Y')",
    "fmt_iso_t": "concat(strftime(d, '%Y-%m-%d'), 'T00:00:00')",
    "fmt_short_t": "concat(strftime(d, '%y-%m-%d'), 'T00:00:00')",
    "fmt_short": "strftime(d, '%y-%m-%d')",
    "fmt_iso": "strftime(d, '%Y-%m-%d')",
}


def cols(exprs: dict[str, str]) -> str:
    return ", ".join(f'{e.format(**SLOTS)} AS "{name}"' for name, e in exprs.items())


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def month(d: str) -> str:
    return f"CAST(date_trunc('month', {d}) AS DATE)"


def week(d: str) -> str:
    return f"CAST(date_trunc('week', {d}) AS DATE)"


def mean(value: str, digits: int, out: int) -> str:
    """Rounded mean of a value with ``digits`` decimals, divided in units of the output digit."""
    k = 10**digits
    unit = f"CAST(sum(CAST(round({value} * {k}) AS BIGINT)) AS DOUBLE) / (count({value}) * {float(10 ** (digits - out))})"
    return f"(sign({unit}) * floor(abs({unit}) + 0.5) / {float(10**out)} + 0.0)"


def rate(a: str, c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN round(CAST({a} AS DOUBLE) / {c} * 100, 2) END"


ITEM_RAW = f"SELECT {cols(b.ITEM)} FROM lineitem"
DATE_PARTS = """
    CAST(year(date_day) AS INT) AS year_number, CAST(month(date_day) AS INT) AS month_number,
    CAST(day(date_day) AS INT) AS day_of_month, CAST(weekofyear(date_day) AS INT) AS week_of_year,
    CAST(dayofweek(date_day) AS INT) AS day_of_week, dayname(date_day) AS day_name,
    monthname(date_day) AS month_name, CAST(quarter(date_day) AS INT) AS quarter_number,
    'Q' || quarter(date_day) AS quarter_label,
    CASE WHEN month(date_day) IN (12, 1, 2) THEN 'Winter' WHEN month(date_day) IN (3, 4, 5) THEN 'Spring'
         WHEN month(date_day) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
    CAST(year(date_day) AS INT) AS fiscal_year, dayofweek(date_day) IN (0, 6) AS is_weekend,
    day(date_day) = 1 AS is_month_start, date_day = last_day(date_day) AS is_month_end
"""
WEATHER_NUMBERS = ", ".join(f'try_cast("{c}" AS DOUBLE) AS {name}' for c, name in b.WEATHER_COLUMNS.items())


def _ints(names) -> str:
    return ", ".join(f"try_cast({c} AS INTEGER) AS {c.lower()}" for c in names)


def _trims(names) -> str:
    return ", ".join(f"trim({c}) AS {c.lower()}" for c in names)


_BED_OR_ROOM = {
    "occupancy": ("occupied_beds", "occupied_rooms"),
    "capacity_actual": ("capacity_actual_bed", "capacity_actual_room"),
    "capacity_funding": ("capacity_funding_bed", "capacity_funding_room"),
}

# name -> (tables it reads from this dictionary, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), ITEM_RAW),
    "locations": (
        (),
        f"SELECT {cols(b.LOCATION)} FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey "
        "LEFT JOIN region ON n_regionkey = r_regionkey",
    ),
    "panel0": (("items",), f"SELECT {cols(b.PANEL)} FROM items"),
    "panel": (("panel0",), f"SELECT *, {rate('occupancy', 'capacity_actual')} AS occupancy_rate FROM panel0"),
    "fact": (
        ("panel",),
        "SELECT *, occupancy_rate >= 95 AS is_effectively_full, occupancy > capacity_actual AS is_over_capacity, "
        "CAST(year(occupancy_date) AS INT) AS year_number, CAST(month(occupancy_date) AS INT) AS month_number FROM panel",
    ),
    "calendar": (
        ("items",),
        f"SELECT date_day, {DATE_PARTS} FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(d)), last_day(max(d)), "
        "INTERVAL 1 DAY)) AS DATE) AS date_day FROM items)",
    ),
    "raw_legacy": (
        ("items", "locations"),
        f"SELECT {cols(b.RAW_LEGACY)} FROM items LEFT JOIN locations USING (location_id) WHERE year(d) < {b.SPLIT}",
    ),
    "raw_current0": (
        ("items", "locations"),
        f"SELECT {cols(b.RAW_CURRENT)} FROM items LEFT JOIN locations USING (location_id) WHERE year(d) >= {b.SPLIT}",
    ),
    "raw_current": (
        ("raw_current0",),
        "SELECT * REPLACE (_id * 2 AS _id) FROM raw_current0 UNION ALL "
        "SELECT * REPLACE (_id * 2 + 1 AS _id) FROM raw_current0 WHERE PROGRAM_ID = '1'",
    ),
    "repaired": (
        ("raw_current",),
        "SELECT DISTINCT * EXCLUDE (_id) REPLACE (CASE WHEN regexp_matches(trim(OCCUPANCY_DATE), '^\\d{2}-\\d{2}-\\d{2}') "
        "THEN '20' || substr(trim(OCCUPANCY_DATE), 1, 8) ELSE trim(OCCUPANCY_DATE) END AS OCCUPANCY_DATE) FROM raw_current",
    ),
    # Dates are put together from their digits, numbers are read once and rounded where a column is whole.
    "legacy_parts": (
        ("raw_legacy",),
        "SELECT *, regexp_extract(OCCUPANCY_DATE, '(\\d+)/(\\d+)/(\\d+)', ['m', 'd', 'y']) AS us, "
        "regexp_extract(OCCUPANCY_DATE, '(\\d{4})-(\\d\\d)-(\\d\\d)', ['y', 'm', 'd']) AS iso, "
        "try_cast(OCCUPANCY AS DOUBLE) AS used, try_cast(CAPACITY AS DOUBLE) AS beds FROM raw_legacy "
        "WHERE regexp_matches(OCCUPANCY_DATE, '[^ ]')",
    ),
    "stg_legacy": (
        ("legacy_parts",),
        "SELECT make_date(CAST(us.y || iso.y AS INT), CAST(us.m || iso.m AS INT), CAST(us.d || iso.d AS INT)) AS occupancy_date, "
        + _trims(["ORGANIZATION_NAME", "SHELTER_NAME", "SHELTER_ADDRESS", "SHELTER_CITY", "SHELTER_POSTAL_CODE",
                  "FACILITY_NAME", "PROGRAM_NAME"])
        + ", trim(upper(SECTOR)) AS sector, CAST(round(used) AS INT) AS occupancy, CAST(round(beds) AS INT) AS capacity_funding, "
        "CAST(NULL AS INTEGER) AS capacity_actual, round(used / CASE WHEN round(beds) > 0 THEN beds END * 100, 2) AS occupancy_rate, "
        "'legacy' AS data_schema_version, _source_year AS source_year FROM legacy_parts",
    ),
    "stg_current0": (
        ("repaired",),
        "SELECT make_date(CAST(left(OCCUPANCY_DATE, 4) AS INT), CAST(substr(OCCUPANCY_DATE, 6, 2) AS INT), "
        "CAST(substr(OCCUPANCY_DATE, 9, 2) AS INT)) AS occupancy_date, "
        + _ints(["ORGANIZATION_ID", "SHELTER_ID", "LOCATION_ID", "PROGRAM_ID", "CAPACITY_ACTUAL_BED", "CAPACITY_FUNDING_BED",
                 "OCCUPIED_BEDS", "UNOCCUPIED_BEDS", "CAPACITY_ACTUAL_ROOM", "CAPACITY_FUNDING_ROOM", "OCCUPIED_ROOMS",
                 "UNOCCUPIED_ROOMS", "SERVICE_USER_COUNT"])
        + ", "
        + _trims(["ORGANIZATION_NAME", "SHELTER_GROUP", "LOCATION_NAME", "LOCATION_ADDRESS", "LOCATION_POSTAL_CODE",
                  "LOCATION_CITY", "LOCATION_PROVINCE", "PROGRAM_NAME", "PROGRAM_MODEL", "OVERNIGHT_SERVICE_TYPE",
                  "PROGRAM_AREA", "CAPACITY_TYPE"])
        + ", upper(trim(SECTOR)) AS sector FROM repaired WHERE OCCUPANCY_DATE IS NOT NULL",
    ),
    "stg_current": (
        ("stg_current0",),
        "SELECT *, " + rate("occupancy", "capacity_actual") + " AS occupancy_rate, 'current' AS data_schema_version, "
        "CAST(year(occupancy_date) AS INT) AS source_year FROM (SELECT *, "
        + ", ".join(f"CASE WHEN {bed} IS NULL THEN {room} ELSE {bed} END AS {name}" for name, (bed, room) in _BED_OR_ROOM.items())
        + " FROM stg_current0)",
    ),
    "stg_unified": (
        ("stg_legacy", "stg_current"),
        "SELECT occupancy_date, organization_name, shelter_name AS location_name, shelter_address AS location_address, "
        "shelter_postal_code AS location_postal_code, program_name, sector, occupancy, capacity_funding AS capacity_actual, "
        "capacity_funding, occupancy_rate, CAST(NULL AS VARCHAR) AS capacity_type, "
        "CAST(NULL AS VARCHAR) AS overnight_service_type, data_schema_version, source_year, false AS has_actual_capacity "
        "FROM stg_legacy UNION ALL SELECT occupancy_date, organization_name, location_name, location_address, "
        "location_postal_code, program_name, sector, occupancy, capacity_actual, capacity_funding, occupancy_rate, "
        "capacity_type, overnight_service_type, data_schema_version, source_year, true FROM stg_current",
    ),
    "rate_days0": ((), f"SELECT {cols(b.RATE_DAY)} FROM orders"),
    "rate_days": (("rate_days0",), f"SELECT d, {big('sum(cents)')} AS total, count(*) AS cnt FROM rate_days0 GROUP BY d"),
    "raw_rates": (("rate_days",), f"SELECT strftime(d, '%Y-%m-%d') AS date, {b.RATE_TEXT} AS v FROM rate_days"),
    "rates": (("raw_rates",), "SELECT CAST(date AS DATE) AS date, CAST(v AS DOUBLE) AS policy_rate FROM raw_rates WHERE v IS NOT NULL"),
    "stg_rates": (
        ("rates",),
        "SELECT date AS rate_date, policy_rate, CAST(year(date) AS INT) AS rate_year, CAST(month(date) AS INT) AS rate_month, "
        "policy_rate <> lag(policy_rate) OVER (ORDER BY date) AS is_rate_change_day FROM rates",
    ),
    "weather_days0": (
        ("items",),
        f"SELECT d, {big('sum(disc)')} AS disc_sum, {big('sum(tax)')} AS tax_sum, count(*) AS cnt FROM items GROUP BY d",
    ),
    "weather_days": (("weather_days0",), f"SELECT d, {cols(b.WEATHER_DAY)} FROM weather_days0"),
    "raw_weather0": (("weather_days",), f"SELECT {cols(b.RAW_WEATHER)} FROM weather_days"),
    "raw_weather": (
        ("raw_weather0",),
        f"SELECT * FROM raw_weather0 UNION ALL SELECT {', '.join(repr(c) for c in [b.WEATHER_DATE, *b.WEATHER_COLUMNS])}, "
        f"_source_year FROM raw_weather0 WHERE \"{b.WEATHER_DATE}\" LIKE '%-01-01'",
    ),
    "stg_weather0": (
        ("raw_weather",),
        f'SELECT CAST("{b.WEATHER_DATE}" AS DATE) AS weather_date, {WEATHER_NUMBERS}, _source_year FROM raw_weather '
        f"WHERE \"{b.WEATHER_DATE}\" IS NOT NULL AND \"{b.WEATHER_DATE}\" <> '{b.WEATHER_DATE}'",
    ),
    "stg_weather": (
        ("stg_weather0",),
        "SELECT weather_date, temp_max_c, temp_min_c, temp_mean_c, precip_total_mm, precip_rain_mm, snow_total_cm, "
        "temp_mean_c < 0 AS is_cold_day, snow_total_cm > 0 AS is_snow_day, temp_mean_c < -10 AS is_extreme_cold, "
        "CAST(year(weather_date) AS INT) AS weather_year, CAST(month(weather_date) AS INT) AS weather_month, "
        "CAST(dayofweek(weather_date) AS INT) AS day_of_week, _source_year FROM stg_weather0",
    ),
    "unified": (("panel", "locations"), "SELECT * FROM panel LEFT JOIN locations USING (location_id)"),
    "fact_daily": (
        ("unified", "calendar"),
        "SELECT md5(concat_ws('-', coalesce(CAST(occupancy_date AS VARCHAR), '_dbt_utils_surrogate_key_null_'), "
        "coalesce(location_name, '_dbt_utils_surrogate_key_null_'), coalesce(program_name, '_dbt_utils_surrogate_key_null_'))) "
        "AS fact_id, occupancy_date, organization_name, location_name, location_address, location_postal_code, program_name, "
        "sector, overnight_service_type, capacity_type, occupancy, capacity_actual, capacity_funding, occupancy_rate, "
        "occupancy_rate >= 95 AS is_effectively_full, occupancy > capacity_actual AS is_over_capacity, has_actual_capacity, "
        "year_number, month_number, month_name, quarter_number, season, week_of_year, is_weekend, data_schema_version "
        "FROM unified LEFT JOIN calendar ON occupancy_date = date_day",
    ),
}


def monthly_of(fact: str) -> str:
    sectors = ", ".join(
        f"{big(f'sum(occupancy) FILTER (WHERE sector = {s!r})')} AS {name}" for name, s in marts.SECTOR_COLUMNS.items()
    )
    return (
        f"SELECT {month('occupancy_date')} AS month_start, year_number, month_number, "
        f"{mean('occupancy_rate', 2, 2)} AS avg_occupancy_rate, {big('sum(occupancy)')} AS total_occupied, "
        f"{big('sum(capacity_actual)')} AS total_capacity, "
        "round(CAST(sum(occupancy) AS DOUBLE) / nullif(sum(capacity_actual), 0) * 100, 2) AS system_occupancy_rate, "
        "count(*) FILTER (WHERE is_effectively_full) AS programs_effectively_full, count(*) AS total_programs, "
        "round(CAST(count(*) FILTER (WHERE is_effectively_full) AS DOUBLE) / nullif(count(*), 0) * 100, 2) AS pct_programs_full, "
        f"{sectors} FROM {fact} GROUP BY 1, 2, 3"
    )


CTES["panel_monthly"] = (("fact",), monthly_of("fact"))
CTES["raw_fact"] = (
    ("stg_unified",),
    "SELECT *, occupancy_rate >= 95 AS is_effectively_full, CAST(year(occupancy_date) AS INT) AS year_number, "
    "CAST(month(occupancy_date) AS INT) AS month_number FROM stg_unified",
)
CTES["raw_monthly"] = (("raw_fact",), monthly_of("raw_fact"))
CTES["rates_monthly"] = (
    ("stg_rates",),
    f"SELECT {month('rate_date')} AS month_start, {mean('policy_rate', 8, 4)} AS avg_policy_rate, "
    "max(policy_rate) - min(policy_rate) > 0 AS rate_changed_this_month FROM stg_rates GROUP BY 1",
)
CTES["weather_monthly"] = (
    ("stg_weather",),
    f"SELECT {month('weather_date')} AS month_start, {mean('temp_mean_c', 8, 2)} AS avg_temp_c, "
    "round(min(temp_min_c), 2) AS min_temp_c, round(sum(snow_total_cm), 6) AS total_snow_cm, "
    "count(*) FILTER (WHERE is_cold_day) AS cold_days, count(*) FILTER (WHERE is_extreme_cold) AS extreme_cold_days "
    "FROM stg_weather GROUP BY 1",
)
CTES["monthly"] = (
    ("panel_monthly", "rates_monthly", "weather_monthly"),
    "SELECT * FROM panel_monthly LEFT JOIN rates_monthly USING (month_start) LEFT JOIN weather_monthly USING (month_start)",
)
CTES["sites"] = (
    ("fact", "locations"),
    f"SELECT * EXCLUDE (location_name, location_address), {', '.join(f'{e} AS {name}' for name, e in b.SITE.items())} "
    "FROM fact LEFT JOIN locations USING (location_id) WHERE year_number >= 2023 AND occupancy_rate IS NOT NULL",
)
_STRESS = (
    f"{mean('occupancy_rate', 2, 1)} AS avg_occupancy_rate, "
    f"{mean('occupancy', 0, 0)} AS avg_daily_occupied, {mean('capacity_actual', 0, 0)} AS avg_capacity, "
    "count(*) FILTER (WHERE is_effectively_full) AS days_full, count(*) AS total_days, "
    "round(CAST(count(*) FILTER (WHERE is_effectively_full) AS DOUBLE) / nullif(count(*), 0) * 100, 1) AS pct_days_full"
)
CTES["stress"] = (
    ("sites",),
    f"SELECT location_name, location_address, location_postal_code, sector, organization_name, {_STRESS} "
    "FROM sites WHERE location_address IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 30",
)
CTES["stress_names"] = (("sites",), f"SELECT location_name, sector, {_STRESS} FROM sites GROUP BY 1, 2 HAVING count(*) > 100")
CTES["areas"] = (
    (),
    "SELECT * FROM (VALUES "
    + ", ".join("('{}', CAST({} AS DOUBLE), CAST({} AS DOUBLE))".format(*r) for r in POSTAL_AREAS)
    + ") AS t(prefix, a_lat, a_lon)",
)
CTES["map_rows"] = (
    ("stress", "areas"),
    "SELECT location_name AS name, organization_name AS org, location_address AS address, sector, "
    "avg_occupancy_rate AS occ_rate, CAST(avg_daily_occupied AS INT) AS avg_occupied, CAST(avg_capacity AS INT) AS avg_capacity, "
    f"pct_days_full AS pct_full, coalesce(a_lat, {CITY_CENTRE[0]}::DOUBLE) AS lat, coalesce(a_lon, {CITY_CENTRE[1]}::DOUBLE) AS lon, "
    "CASE WHEN avg_occupancy_rate >= 98 THEN 'Critical' WHEN avg_occupancy_rate >= 95 THEN 'Effectively full' "
    "WHEN avg_occupancy_rate >= 85 THEN 'High' ELSE 'Moderate' END AS band, "
    "CASE WHEN avg_occupancy_rate >= 98 THEN '#e63946' WHEN avg_occupancy_rate >= 95 THEN '#f4a261' "
    "WHEN avg_occupancy_rate >= 85 THEN '#e9c46a' ELSE '#2a9d8f' END AS color, "
    "CASE WHEN avg_capacity > 0 THEN greatest(6.0::DOUBLE, least(22.0::DOUBLE, 6 + sqrt(avg_capacity / 5))) ELSE 7.0::DOUBLE END AS radius "
    "FROM stress LEFT JOIN areas ON upper(substr(trim(location_postal_code), 1, 3)) = prefix",
)


def _series(period: str, name: str, min_days: int, where: str) -> str:
    both = []
    for series in ("'ALL'", "sector"):
        both.append(
            f"SELECT {series} AS series, {period} AS {name}, "
            "round(CAST(sum(occupancy) AS DOUBLE) / nullif(sum(capacity_actual), 0) * 100, 2) AS occupancy_rate, "
            f"{big('sum(occupancy)')} AS total_occupied, {big('sum(capacity_actual)')} AS total_capacity, "
            f"count(DISTINCT occupancy_date) AS n_days FROM fact WHERE {where} GROUP BY 1, 2 "
            f"HAVING count(DISTINCT occupancy_date) >= {min_days}"
        )
    return " UNION ALL ".join(both)


CTES["weekly"] = (
    ("fact",),
    _series(week("occupancy_date"), "week_start", 5,
            "occupancy IS NOT NULL AND capacity_actual > 0"),
)
CTES["rate_panel"] = (
    (),
    f"SELECT series, d AS date, {b.RATE} AS policy_rate FROM (SELECT series, d, {big('sum(cents)')} AS total, count(*) AS cnt FROM "
    f"(SELECT o_orderpriority AS series, {cols(b.RATE_DAY)} FROM orders) GROUP BY 1, 2) WHERE cnt <> 2",
)
CTES["full_months"] = (("fact",), _series(month("occupancy_date"), "month_start", 28, "true"))
# gaps filled from a grid per series, then interpolated between the nearest known neighbours
CTES["weekly_grid"] = (
    ("weekly",),
    "SELECT series, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start "
    "FROM weekly GROUP BY series",
)
CTES["weekly_regular"] = (
    ("weekly", "weekly_grid"),
    "SELECT g.series, g.week_start, w.occupancy_rate, w.total_occupied, w.total_capacity, w.n_days "
    "FROM weekly_grid g LEFT JOIN weekly w ON w.series = g.series AND w.week_start = g.week_start",
)
CTES["weekly_filled"] = (
    ("weekly_regular", "weekly"),
    "SELECT r.series, r.week_start, CASE WHEN r.occupancy_rate IS NOT NULL THEN r.occupancy_rate "
    "WHEN hi.week_start IS NULL THEN lo.occupancy_rate ELSE lo.occupancy_rate + (hi.occupancy_rate - lo.occupancy_rate) * "
    "(CAST((r.week_start - lo.week_start) // 7 AS DOUBLE) / ((hi.week_start - lo.week_start) // 7)) END AS y "
    "FROM weekly_regular r ASOF LEFT JOIN weekly lo ON r.series = lo.series AND r.week_start >= lo.week_start "
    "ASOF LEFT JOIN weekly hi ON r.series = hi.series AND r.week_start <= hi.week_start",
)


def folds_of(source: str, ts: str, y: str, keys: str, min_train: int, horizon: int, step: int, season: int | None, drift: bool) -> str:
    """Fold rows by joins: every origin against the series, then the rows at fixed distances from it."""
    on = " AND ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    i = f"(SELECT {keys}, {ts} AS ts, {y} AS y, row_number() OVER (PARTITION BY {keys} ORDER BY {ts}) - 1 AS t FROM {source})"
    ks = ", ".join(f"o.{k}" for k in keys.split(", "))
    out = (
        f"WITH i AS {i}, n AS (SELECT {keys}, count(*) AS n FROM i GROUP BY {keys}), "
        f"o AS (SELECT {keys}, n, unnest(range({min_train}, n - {horizon} + 1, {step})) AS e FROM n), "
        f"f AS (SELECT {ks}, o.e, unnest(range(1, {horizon + 1})) AS k FROM o)"
    )
    sel = (
        f"SELECT {', '.join('f.' + k for k in keys.split(', '))}, CAST((f.e - {min_train}) // {step} + 1 AS INT) AS fold, "
        "a.ts AS origin, x.ts AS target, CAST(f.k AS INT) AS step, x.y AS actual, a.y AS naive"
    )
    joins = (
        f" FROM f JOIN i x ON {on.format(a='x', b='f')} AND x.t = f.e + f.k - 1 "
        f"JOIN i a ON {on.format(a='a', b='f')} AND a.t = f.e - 1"
    )
    if season:
        sel += ", coalesce(s.y, a.y) AS seasonal_naive"
        joins += f" LEFT JOIN i s ON {on.format(a='s', b='f')} AND s.t = f.e - {season} + ((f.k - 1) % {season})"
    if drift:
        sel += ", round((l.a + l.b * x.t) / 1e6::DOUBLE, 6) AS drift"
        joins += (
            f" LEFT JOIN (SELECT *, (sy - b * st) / n AS a FROM (SELECT *, (n * sty - st * sy) / (n * stt - st * st) AS b FROM "
            "(SELECT *, n * (n - 1) / 2 AS st, (n - 1) * n * (2 * n - 1) / 6 AS stt FROM "
            f"(SELECT {ks}, o.e, CAST(o.e AS DOUBLE) AS n, CAST(sum(CAST(round(i.y * 1000000) AS BIGINT)) AS DOUBLE) AS sy, "
            "CAST(sum(CAST(round(i.y * 1000000) AS BIGINT) * i.t) AS DOUBLE) AS sty FROM o JOIN i ON "
            f"{on.format(a='i', b='o')} AND i.t < o.e GROUP BY ALL)))) l ON {on.format(a='l', b='f')} AND l.e = f.e"
        )
    return out + " " + sel + joins


def whole(v: str) -> str:
    """A number in units of 10^-6, for exact products."""
    return f"CAST(round({v} * 1000000) AS HUGEINT)"


def running_sums(source: str, keys: str, ts: str, xs, y: str, least: int, ridge=None) -> str:
    """Sums of all products of predictors and target over the complete rows so far, as a{i}_{j}; none before ``least`` of them."""
    names = [*xs, y]
    some = " AND ".join(f"{c} IS NOT NULL" for c in names)
    cells = ", ".join(
        f"CAST(sum(CASE WHEN {some} THEN {whole(names[i])} * {whole(names[j])} END) OVER w AS DOUBLE) / 1e12::DOUBLE"
        + (f" + {ridge[i]}" if ridge and i == j and ridge[i] else "")
        + f" AS a{i}_{j}"
        for i in range(len(xs))
        for j in range(len(names))
    )
    return (
        f"SELECT {keys}, {ts}, {cells} FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {ts} ROWS UNBOUNDED PRECEDING) "
        f"QUALIFY sum(CASE WHEN {some} THEN 1 ELSE 0 END) OVER w >= {least}"
    )


def eliminated(name: str, first: str, carry: str, k: int, sides: int = 1) -> str:
    """Common tables that solve ``first``'s a{i}_{j} pivot by pivot; the last, whose name is returned, has a{i}_{k} as solutions."""
    diag = ", ".join(f"a{i}_{i} AS q{i}" for i in range(k))
    cells = ", ".join(f"a{i}_{j}" for i in range(k) for j in range(k + sides))
    CTES[f"{name}_0"] = ((first,), f"SELECT {carry}, {diag}, {cells} FROM {first}")
    for p in range(k):
        out = []
        for i in range(k):
            for j in range(p + 1, k + sides):
                row = f"CASE WHEN a{p}_{p} > 1e-9 * q{p} THEN a{p}_{j} / a{p}_{p} ELSE 0 END"
                out.append(f"{row if i == p else f'a{i}_{j} - a{i}_{p} * ({row})'} AS a{i}_{j}")
        kept = ", ".join(f"q{i}" for i in range(p + 1, k))
        CTES[f"{name}_{p + 1}"] = ((f"{name}_{p}",), f"SELECT {carry}, {kept + ', ' if kept else ''}{', '.join(out)} FROM {name}_{p}")
    return f"{name}_{k}"


def surprises(name: str, source: str, keys: str, ts: str, order: int) -> str:
    """Common tables over ``source`` (keys, ts, dy, ...) with steps d1, surprises e and e1; the last one's name."""
    w = f"PARTITION BY {keys} ORDER BY {ts}"
    lags = ", ".join(f"lag(dy, {j}) OVER w AS d{j}" for j in range(1, order + 1))
    CTES[f"{name}_l"] = ((source,), f"SELECT *, {lags} FROM {source} WINDOW w AS ({w})")
    CTES[f"{name}_long_sums"] = ((f"{name}_l",), running_sums(f"{name}_l", keys, ts, [f"d{j}" for j in range(1, order + 1)], "dy", 2 * order + 2))
    last = eliminated(f"{name}_long", f"{name}_long_sums", f"{keys}, {ts}", order)
    seen = " + ".join(f"lag(f.a{j - 1}_{order}) OVER w * d{j}" for j in range(1, order + 1))
    CTES[f"{name}_e"] = (
        (f"{name}_l", last),
        f"SELECT l.*, dy - ({seen}) AS e FROM {name}_l l LEFT JOIN {last} f USING ({keys}, {ts}) WINDOW w AS ({w})",
    )
    CTES[f"{name}_e1"] = ((f"{name}_e",), f"SELECT *, lag(e) OVER ({w}) AS e1 FROM {name}_e")
    CTES[f"{name}_arma_sums"] = ((f"{name}_e1",), running_sums(f"{name}_e1", keys, ts, ["d1", "e1"], "dy", 8))
    return f"{name}_e1"


def _season_columns(period: float = 52.1775, waves: int = 2, every: int = 52, length: int = 366) -> dict[str, str]:
    xs = {"c": "1.0::DOUBLE", "tt": f"t / {period}"}
    xs |= {f"h{i}": f"greatest(t - {at}, 0) / {period}" for i, at in enumerate(range(every, length, every))}
    for n in range(1, waves + 1):
        xs |= {f"s{n}": f"sin(t * (2.0::DOUBLE * pi() * {n} / {period}))", f"k{n}": f"cos(t * (2.0::DOUBLE * pi() * {n} / {period}))"}
    return xs


def _trend_season(penalty: float = 2.0) -> None:
    xs = _season_columns()
    shown = ", ".join(f"{e} AS {c}" for c, e in xs.items())
    CTES["season_rows"] = (
        ("weekly_filled",),
        f"SELECT series, week_start, t, y, {shown} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY week_start) - 1 AS DOUBLE) AS t FROM weekly_filled)",
    )
    ridge = [0 if c in ("c", "tt") else penalty if c[0] == "h" else penalty / 10 for c in xs]
    CTES["season_sums"] = (("season_rows",), running_sums("season_rows", "series", "week_start", list(xs), "y", len(xs) + 2, ridge))
    last = eliminated("season_fit", "season_sums", "series, week_start", len(xs))
    value = " + ".join(f"f.a{i}_{len(xs)} * x.{c}" for i, c in enumerate(xs))
    CTES["weekly_folds"] = (
        ("baseline_folds", last, "season_rows"),
        f"SELECT b.*, round({value}, 6) AS trend_season FROM baseline_folds b "
        f"LEFT JOIN {last} f ON f.series = b.series AND f.week_start = b.origin JOIN season_rows x ON x.series = b.series AND x.week_start = b.target",
    )


CTES["baseline_folds"] = (("weekly_filled",), folds_of("weekly_filled", "week_start", "y", "series", 104, 12, 4, 52, True))
_trend_season()
CTES["outside_folds"] = (("weekly_filled",), folds_of("weekly_filled", "week_start", "y", "series", 100, 12, 4, None, True))
CTES["rate_series"] = (
    ("full_months", "rates_monthly"),
    "SELECT series, month_start, occupancy_rate, avg_policy_rate FROM full_months JOIN rates_monthly USING (month_start)",
)
CTES["lag_frame"] = (
    ("rate_series",),
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT series, month_start, occupancy_rate, {k} AS lag_months, lag(avg_policy_rate, {k}) OVER "
        "(PARTITION BY series ORDER BY month_start) AS exog_lag FROM rate_series"
        for k in (3, 6, 9, 12)
    )
    + ") WHERE occupancy_rate IS NOT NULL AND exog_lag IS NOT NULL",
)
CTES["rate_base"] = (
    ("lag_frame",),
    folds_of("lag_frame", "month_start", "occupancy_rate", "series, lag_months", 48, 3, 1, None, True),
)


def _rate_models(order: int = 4) -> None:
    """The monthly models fit by fit: running sums, elimination, forecasts by joins of origin and target rows."""
    keys, part = "series, lag_months", "PARTITION BY series, lag_months ORDER BY month_start"
    CTES["rm_y"] = (
        ("lag_frame",),
        "SELECT series, lag_months, month_start, exog_lag AS x, CASE WHEN month_start NOT BETWEEN DATE '2020-03-01' AND DATE '2020-12-01' "
        "THEN occupancy_rate END AS y FROM lag_frame",
    )
    CTES["rm_d"] = (("rm_y",), f"SELECT *, row_number() OVER w AS t, y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx FROM rm_y WINDOW w AS ({part})")
    both = "dx IS NOT NULL AND dy IS NOT NULL"
    CTES["rm_b"] = (
        ("rm_d",),
        "SELECT *, last_value(y IGNORE NULLS) OVER g AS y0, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER g AS x0, "
        f"CAST(sum(CASE WHEN {both} THEN {whole('dx')} * {whole('dy')} END) OVER g AS DOUBLE) AS xy, "
        f"CAST(sum(CASE WHEN {both} THEN {whole('dx')} * {whole('dx')} END) OVER g AS DOUBLE) AS xx FROM rm_d "
        f"WINDOW g AS ({part} ROWS UNBOUNDED PRECEDING)",
    )
    surprises("rm", "rm_b", keys, "month_start", order)
    CTES["rm_armax_sums"] = (("rm_e1",), running_sums("rm_e1", keys, "month_start", ["d1", "e1", "dx"], "dy", 10))
    one = eliminated("rm_arma", "rm_arma_sums", f"{keys}, month_start", 2)
    two = eliminated("rm_armax", "rm_armax_sums", f"{keys}, month_start", 3)
    CTES["rm_fits"] = (
        ("rm_e1", one, two),
        "SELECT l.*, coalesce(xy / nullif(xx, 0), 0) AS beta, coalesce(dy, 0) AS dy0, coalesce(e, 0) AS e0, p.a0_2 AS p1, p.a1_2 AS p2, "
        f"q.a0_3 AS q1, q.a1_3 AS q2, q.a2_3 AS q3 FROM rm_e1 l LEFT JOIN {one} p USING (series, lag_months, month_start) "
        f"LEFT JOIN {two} q USING (series, lag_months, month_start)",
    )
    # steps one to three from the origin; a later one counts only if the target lies that far
    s1, r1 = "(o.p1 * o.dy0 + o.p2 * o.e0)", "(o.q1 * o.dy0 + o.q2 * o.e0 + o.q3 * coalesce(x1.dx, 0))"
    r2 = f"(o.q1 * {r1} + o.q3 * coalesce(x2.dx, 0))"
    r3 = f"(o.q1 * {r2} + o.q3 * coalesce(x3.dx, 0))"
    arma = f"{s1} + CASE WHEN step > 1 THEN o.p1 * {s1} ELSE 0 END + CASE WHEN step > 2 THEN o.p1 * o.p1 * {s1} ELSE 0 END"
    armax = f"{r1} + CASE WHEN step > 1 THEN {r2} ELSE 0 END + CASE WHEN step > 2 THEN {r3} ELSE 0 END"
    on = "{0}.series = b.series AND {0}.lag_months = b.lag_months"
    ahead = " ".join(f"LEFT JOIN rm_d x{j} ON {on.format(f'x{j}')} AND x{j}.t = o.t + {j}" for j in (1, 2, 3))
    CTES["rate_folds"] = (
        ("rate_base", "rm_fits", "rm_d"),
        f"SELECT b.*, round(o.y0 + o.beta * (z.x - o.x0), 6) AS rate_lag, round(o.y0 + coalesce({arma}, 0), 6) AS arma, "
        f"round(o.y0 + coalesce({armax}, 0), 6) AS arma_rate FROM rate_base b JOIN rm_fits o ON {on.format('o')} AND o.month_start = b.origin "
        f"JOIN rm_d z ON {on.format('z')} AND z.month_start = b.target {ahead}",
    )


_rate_models()


def _ahead(horizon: int = 12, season: int = 52, order: int = 4) -> None:
    """Forecasts past the last week, each model from its closed form."""
    CTES["wk_d"] = (
        ("season_rows",),
        "SELECT *, y - lag(y) OVER (PARTITION BY series ORDER BY week_start) AS dy, max(week_start) OVER (PARTITION BY series) AS origin FROM season_rows",
    )
    ends = surprises("wk", "wk_d", "series", "week_start", order)
    arma = eliminated("wk_arma", "wk_arma_sums", "series, week_start", 2)
    xs = _season_columns()
    k = len(xs)
    trend = " + ".join(f"s.a{i}_{k} * ({e.replace('t ', 'z.t ')})" for i, e in enumerate(xs.values()))
    moved = " + ".join(f"CASE WHEN step > {j} THEN pow(m.a0_2, {j}) ELSE 0 END" for j in range(horizon))
    CTES["ahead_ends"] = ((ends,), f"SELECT series, origin, t AS t0, y AS y0, dy, e FROM {ends} WHERE week_start = origin")
    CTES["ahead_line"] = (
        ("season_rows",),
        "SELECT series, (sy - b * st) / n AS a, b FROM (SELECT *, (n * sty - st * sy) / (n * stt - st * st) AS b FROM (SELECT series, "
        "CAST(count(*) AS DOUBLE) AS n, CAST(sum(t) AS DOUBLE) AS st, CAST(sum(t * t) AS DOUBLE) AS stt, "
        "CAST(sum(CAST(round(y * 1000000) AS HUGEINT)) AS DOUBLE) AS sy, CAST(sum(CAST(round(y * 1000000) AS HUGEINT) * CAST(t AS HUGEINT)) AS DOUBLE) AS sty "
        "FROM season_rows GROUP BY 1))",
    )
    CTES["ahead"] = (
        ("ahead_ends", "season_rows", "ahead_line", arma, f"season_fit_{k}"),
        "SELECT z.series, z.origin, CAST(z.origin + INTERVAL (7 * step) DAY AS DATE) AS target, CAST(step AS INT) AS step, z.y0 AS naive, "
        "coalesce(b.y, z.y0) AS seasonal_naive, round((l.a + l.b * z.t) / 1e6::DOUBLE, 6) AS drift, "
        f"round(coalesce({trend}, z.y0), 6) AS trend_season, "
        f"round(coalesce(z.y0 + (m.a0_2 * z.dy + m.a1_2 * z.e) * ({moved}), z.y0), 6) AS arma "
        f"FROM (SELECT *, t0 + step AS t FROM (SELECT *, unnest(range(1, {horizon + 1})) AS step FROM ahead_ends)) z JOIN ahead_line l ON l.series = z.series "
        f"LEFT JOIN season_rows b ON b.series = z.series AND b.t = z.t - {season} "
        f"LEFT JOIN {arma} m ON m.series = z.series AND m.week_start = z.origin "
        f"LEFT JOIN season_fit_{k} s ON s.series = z.series AND s.week_start = z.origin",
    )


_ahead()


def _unit_root(most: int = 4) -> None:
    """The test of every weekly series and of its steps, by elimination order by order."""
    keys, k = "series, variable", most + 1
    CTES["ur_y"] = (
        ("weekly_filled",),
        "SELECT series, 'level' AS variable, week_start, y FROM weekly_filled WHERE y IS NOT NULL UNION ALL SELECT * FROM (SELECT series, 'difference', week_start, "
        "y - lag(y) OVER (PARTITION BY series ORDER BY week_start) AS y FROM weekly_filled) WHERE y IS NOT NULL",
    )
    CTES["ur_d"] = (
        ("ur_y",),
        f"SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS size, lag(y) OVER w AS x0, y - lag(y) OVER w AS d "
        f"FROM ur_y WINDOW w AS (PARTITION BY {keys} ORDER BY week_start)",
    )
    lags = ", ".join(f"lag(d, {j}) OVER (PARTITION BY {keys} ORDER BY week_start) AS x{j}" for j in range(1, k))
    own = f"greatest(0, least({most}, ceil(12 * pow(size / 100.0, 0.25)), size // 2 - 2))"
    CTES["ur_x"] = (("ur_d",), f"SELECT *, {own} AS own, {lags} FROM ur_d")

    def sums(source: str, lag: str) -> str:
        """Centred sums over the rows that ``lag`` leaves, later steps as zeros."""
        xs = ["x0", *[f"CASE WHEN {lag} >= {j} THEN x{j} ELSE 0 END" for j in range(1, k)]]
        shown = ", ".join(f"{x} AS z{i}" for i, x in enumerate(xs))
        means = ", ".join(f"avg(z{i}) OVER w AS m{i}" for i in range(k))
        cells = [f"sum((z{i} - m{i}) * (z{j} - m{j})) AS a{i}_{j}" for i in range(k) for j in range(k)]
        cells += [f"sum((z{i} - m{i}) * (d - md)) AS a{i}_{k}, {int(i == 0)}::DOUBLE AS a{i}_{k + 1}, sum((z{i} - m{i}) * (d - md)) AS r{i}" for i in range(k)]
        return (
            f"SELECT {keys}, {lag} AS lags, count(*) AS n, sum((d - md) * (d - md)) AS syy, {', '.join(cells)} FROM (SELECT *, {means}, avg(d) OVER w AS md "
            f"FROM (SELECT *, {shown} FROM {source} WHERE i > {lag}) WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}, {lag}"
        )

    carry = f"{keys}, lags, n, syy, " + ", ".join(f"r{i}" for i in range(k))
    CTES["ur_first"] = (("ur_x",), sums("ur_x", "own"))
    eliminated("ur1", "ur_first", carry, k)
    # what the first p + 1 predictors leave unexplained
    tries = []
    for p in range(k):
        explained = " + ".join(f"a{i}_{k} * r{i}" for i in range(p + 1))
        tries.append(f"SELECT {keys}, {p} AS p, n * ln((syy - ({explained})) / n) + {2 * (p + 2)} AS aic FROM ur1_{p + 1} WHERE {p} <= lags")
    CTES["ur_best"] = (tuple(f"ur1_{p + 1}" for p in range(k)), f"SELECT {keys}, arg_min(p, aic) AS p FROM ({' UNION ALL '.join(tries)}) GROUP BY {keys}")
    CTES["ur_rest"] = (("ur_x", "ur_best"), "SELECT * FROM ur_x JOIN ur_best USING (series, variable)")
    CTES["ur_second"] = (("ur_rest",), sums("ur_rest", "p"))
    last = eliminated("ur2", "ur_second", carry, k, 2)
    error = f"(syy - ({' + '.join(f'a{i}_{k} * r{i}' for i in range(k))}))"
    CTES["ur_t"] = ((last,), f"SELECT {keys}, CAST(lags AS INT) AS lags, n, a0_{k} / sqrt({error} / (n - lags - 2) * a0_{k + 1}) AS t FROM {last}")
    low, high = (" + ".join(f"{c} * pow(t, {i})" for i, c in enumerate(surface)) for surface in (UNIT_ROOT_BELOW, UNIT_ROOT_ABOVE))
    CTES["unit_root"] = (
        ("ur_t",),
        f"SELECT {keys}, lags, n, round(t, 6) AS statistic, abs(round(p, 6)) AS p_value, p < 0.05 AS stationary FROM (SELECT *, CASE WHEN t > {UNIT_ROOT_MOST} THEN 1.0 "
        f"WHEN t < {UNIT_ROOT_LEAST} THEN 0.0 ELSE 0.5 + {simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', '0.0', 'z', 'u')} END AS p FROM (SELECT *, "
        f"CASE WHEN t <= {UNIT_ROOT_BEND} THEN {low} ELSE {high} END AS z FROM ur_t))",
    )


def maes(models, keys: str, scopes: bool = True) -> str:
    parts = []
    for scope, cond in (("validation", "target < DATE '2024-01-01'"), ("test", "target >= DATE '2024-01-01'"), ("all", "true")):
        vals = ", ".join(
            f"floor(CAST(sum(CAST(round(abs(actual - {m}) * 1000000) AS BIGINT)) AS DOUBLE) / (count(*) * 1000.0) + 0.5) / 1000.0 AS mae_{m}"
            for m in models
        )
        parts.append(f"SELECT {keys}, '{scope}' AS scope, count(*) AS n_forecasts, {vals} FROM {{src}} WHERE {cond} GROUP BY {keys}")
    return " UNION ALL ".join(parts)


CTES["rate_errors"] = (("rate_folds",), maes(("naive", "drift", "rate_lag", "arma", "arma_rate"), "series, lag_months").format(src="rate_folds"))
CTES["fold_long"] = (
    ("weekly_folds",),
    " UNION ALL ".join(
        f"SELECT series, fold, '{m}' AS model, actual, {m} AS forecast FROM weekly_folds" for m in ("naive", "seasonal_naive", "drift", "trend_season")
    ),
)
CTES["fold_metrics"] = (
    ("fold_long",),
    "SELECT series, model, fold, floor(CAST(sum(CAST(round(abs(actual - forecast) * 1000000) AS BIGINT)) AS DOUBLE) / "
    "(count(*) * 1000.0) + 0.5) / 1000.0 AS mae, floor(CAST(sum(CAST(round(abs((actual - forecast) / nullif(actual, 0)) * 100 "
    "* 1000000) AS BIGINT)) AS DOUBLE) / (count(nullif(actual, 0)) * 10000.0) + 0.5) / 100.0 AS mape FROM fold_long GROUP BY 1, 2, 3",
)
CTES["fold_ints"] = (
    ("fold_metrics",),
    "SELECT series, model, CAST(round(mae * 1000) AS BIGINT) AS m, CAST(round(mape * 100) AS BIGINT) AS p FROM fold_metrics",
)
CTES["model_summary"] = (
    ("fold_ints",),
    "SELECT series, model, floor(CAST(sum(m) AS DOUBLE) / count(*) + 0.5) / 1000.0 AS mean_mae, "
    "floor(CAST(sum(p) AS DOUBLE) / count(*) + 0.5) / 100.0 AS mean_mape, "
    "floor(sqrt(CAST(count(*) * sum(m * m) - sum(m) * sum(m) AS DOUBLE)) / count(*) + 0.5) / 1000.0 AS std_mae, "
    "count(*) AS n_folds FROM fold_ints GROUP BY 1, 2",
)
CTES["all_months"] = (("fact",), _series(month("occupancy_date"), "month_start", 1, "true"))
CTES["regression"] = (
    ("all_months", "rates_monthly", "weather_monthly", "calendar"),
    "SELECT * FROM (SELECT series, month_start, a.year_number, occupancy_rate AS system_occupancy_rate, avg_policy_rate, avg_temp_c, "
    "season, CAST(row_number() OVER w - 1 AS INT) AS time_trend, lag(avg_policy_rate, 6) OVER w AS policy_rate_lag, "
    "CAST(a.year_number = 2020 AS INT) AS is_covid, CAST(a.year_number >= 2021 AS INT) AS post_2021, "
    "CAST(season = 'Spring' AS INT) AS is_spring, CAST(season = 'Summer' AS INT) AS is_summer, CAST(season = 'Fall' AS INT) AS is_fall "
    "FROM (SELECT *, CAST(year(month_start) AS INT) AS year_number FROM all_months JOIN rates_monthly USING (month_start) "
    "JOIN weather_monthly USING (month_start)) a JOIN calendar ON month_start = date_day "
    "WHERE a.year_number BETWEEN 2017 AND 2025 AND occupancy_rate IS NOT NULL AND avg_policy_rate IS NOT NULL "
    "AND avg_temp_c IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY month_start)) WHERE policy_rate_lag IS NOT NULL",
)
PREDICTORS = ("avg_temp_c", "policy_rate_lag", "time_trend", "is_covid", "is_spring", "is_summer", "is_fall")


def _least_squares() -> None:
    """Normal equations by elimination, one common table per pivot: [S | Sxy | I] to [I | slope | S^-1]."""
    k = len(PREDICTORS)
    CTES["reg_means"] = (
        ("regression",),
        "SELECT series, count(*) AS n, avg(system_occupancy_rate) AS my, "
        + ", ".join(f"avg(CAST({x} AS DOUBLE)) AS m{i}" for i, x in enumerate(PREDICTORS))
        + " FROM regression GROUP BY 1",
    )
    cells = [f"sum(({x} - m{i}) * ({z} - m{j})) AS a{i}_{j}" for i, x in enumerate(PREDICTORS) for j, z in enumerate(PREDICTORS)]
    cells += [f"sum(({x} - m{i}) * (system_occupancy_rate - my)) AS a{i}_{k}" for i, x in enumerate(PREDICTORS)]
    cells += [f"CAST({int(i == j)} AS DOUBLE) AS a{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    cells += ["sum((system_occupancy_rate - my) * (system_occupancy_rate - my)) AS syy"]
    cells += [f"sum(({x} - m{i}) * ({x} - m{i})) AS d{i}" for i, x in enumerate(PREDICTORS)]
    cells += [f"sum(({x} - m{i}) * (system_occupancy_rate - my)) AS r{i}" for i, x in enumerate(PREDICTORS)]
    CTES["reg_0"] = (("reg_means",), f"SELECT series, {', '.join(cells)} FROM regression JOIN reg_means USING (series) GROUP BY series")
    extra = ", ".join(["syy"] + [f"d{i}, r{i}" for i in range(k)])
    for p in range(k):
        out = []
        for i in range(k):
            for j in range(2 * k + 1):
                pivot = f"a{p}_{j} / a{p}_{p}"
                out.append(f"{pivot if i == p else f'a{i}_{j} - a{i}_{p} * ({pivot})'} AS a{i}_{j}")
        CTES[f"reg_{p + 1}"] = ((f"reg_{p}",), f"SELECT series, {extra}, {', '.join(out)} FROM reg_{p}")
    explained = " + ".join(f"a{i}_{k} * r{i}" for i in range(k))
    CTES["reg_fit"] = (
        (f"reg_{k}", "reg_means"),
        f"SELECT *, syy - ({explained}) AS ssr, n - {k + 1} AS dof FROM reg_{k} JOIN reg_means USING (series)",
    )
    level = "my - (" + " + ".join(f"a{i}_{k} * m{i}" for i in range(k)) + ")"
    spread = "1.0 / n + " + " + ".join(f"m{i} * m{j} * a{i}_{k + 1 + j}" for i in range(k) for j in range(k))
    rows = [f"SELECT series, 'Intercept' AS term, {level} AS coef, sqrt(ssr / dof * ({spread})) AS std_err, NULL::DOUBLE AS vif FROM reg_fit"]
    rows += [
        f"SELECT series, '{x}', a{i}_{k}, sqrt(ssr / dof * a{i}_{k + 1 + i}), a{i}_{k + 1 + i} * d{i} FROM reg_fit"
        for i, x in enumerate(PREDICTORS)
    ]
    CTES["reg_terms"] = (("reg_fit",), " UNION ALL ".join(rows))
    fitted = f"{level} + " + " + ".join(f"a{i}_{k} * {x}" for i, x in enumerate(PREDICTORS))
    CTES["reg_rows"] = (
        ("reg_fit", "regression"),
        f"SELECT series, month_start, system_occupancy_rate, {fitted} AS fitted FROM regression JOIN reg_fit USING (series)",
    )


_least_squares()


def simpson(f: str, lo: str, hi: str, x: str, n: int = 2000) -> str:
    """The integral of ``f`` (an expression over ``{x}``) from ``lo`` to ``hi`` by Simpson's rule."""
    at = f"({lo} + ({hi} - ({lo})) * {x}i / {n}.0)"
    weight = f"CASE WHEN {x}i IN (0, {n}) THEN 1 WHEN {x}i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({hi}) - ({lo})) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda {x}i: {weight} * {f.format(x=at)}))"


def t_inside(t: str, dof: str, x: str = "u") -> str:
    """The probability that a t variable lies between -t and t."""
    scale = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return f"(2 * {scale} * {simpson(f'pow(1 + {{x}} * {{x}} / {dof}, -({dof} + 1) / 2.0)', '0.0', t, x)})"


def f_above(f: str, d1: str, d2: str) -> str:
    """The probability of an F value above ``f``, as an incomplete beta integral."""
    a, c = f"({d2} / 2.0)", f"({d1} / 2.0)"
    scale = f"exp(lgamma({a} + {c}) - lgamma({a}) - lgamma({c}))"
    body = f"pow({{x}}, {a} - 1) * pow(1 - {{x}}, {c} - 1)"
    return f"({scale} * {simpson(body, '0.0', f'{d2} / ({d2} + {d1} * ({f}))', 'v')})"


# Half-width of the 95 % interval in standard errors, by halving an interval that holds it.
_HALVE = (
    "list_reduce(list_transform(range(0, 50), lambda k: {{'lo': 0.0::DOUBLE, 'hi': 64.0::DOUBLE}}), lambda s, z: CASE WHEN "
    + t_inside("((s.lo + s.hi) / 2)", "dof", "w")
    + " < 0.95 THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END)"
).replace("{{", "{").replace("}}", "}")
CTES["reg_width"] = (("reg_fit",), f"SELECT series, dof, (({_HALVE}).lo + ({_HALVE}).hi) / 2 AS width FROM reg_fit")
CTES["reg_tests"] = (
    ("reg_terms", "reg_width"),
    f"SELECT series, term, coef, std_err, coef / std_err AS t, width, 1 - {t_inside('abs(coef / std_err)', 'dof')} AS p "
    "FROM reg_terms JOIN reg_width USING (series)",
)


_unit_root()


def sql(body: str, *needs: str) -> str:
    """A statement with the common tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head} {body}" if order else body


def table(name: str, columns: str = "*") -> str:
    return sql(f"SELECT {columns} FROM {name}", name)
