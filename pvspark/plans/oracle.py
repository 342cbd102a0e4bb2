"""DuckDB statements which must give the same rows as the registered queries."""

from __future__ import annotations

from itertools import product

# Spelled out here, not taken from the operators that are compared with these statements.
HISTORY = [
    "irradiation_lag_1", "irradiation_lag_2", "ambient_temp_lag_1", "module_temp_lag_1", "irradiation_roll_mean_1h", "irradiation_roll_std_1h",
]
WEATHER_COLS = [
    "om_temperature_2m", "om_relative_humidity_2m", "om_dew_point_2m", "om_apparent_temperature", "om_pressure_msl", "om_surface_pressure",
    "om_precipitation", "om_cloud_cover", "om_wind_speed_10m", "om_wind_direction_10m", "om_shortwave_radiation", "om_direct_radiation",
    "om_diffuse_radiation", "om_direct_normal_irradiance", "om_sunshine_duration",
]
CORR_SENSOR = ["ac_power", "dc_power", "ambient_temperature", "module_temperature", "irradiation"]
CORR_SELECTED = [*CORR_SENSOR, "om_temperature_2m", "om_relative_humidity_2m", "om_cloud_cover", "om_wind_speed_10m"]
CORR_EXTENDED = [
    "ac_power", "dc_power", "daily_yield", "ambient_temperature", "module_temperature", "irradiation", "temp_diff", "om_temperature_2m",
    "om_relative_humidity_2m", "om_cloud_cover", "om_wind_speed_10m", "om_shortwave_radiation", "om_direct_radiation",
    "om_diffuse_radiation", "om_sunshine_duration",
]
SENSOR = ["ambient_temperature", "module_temperature", "irradiation"]
NARROW = ["om_temperature_2m", "om_relative_humidity_2m"]
CORR_9_OM = [c for c in CORR_SELECTED if c.startswith("om_")]
CORR_15_OM = [c for c in CORR_EXTENDED if c.startswith("om_")]
CLOUD = ["om_cloud_cover", "om_direct_radiation", "om_diffuse_radiation"]
WIND = ["om_wind_speed_10m"]
BACK = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
AHEAD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The rounding of `queries.rounded`: ties and what float noise makes of them go up."""
    return f"floor(({expr}) * 1e{digits} + 0.5001) / 1e{digits} AS {name or expr}"


def rs(cols, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in cols)


BASE = """
ev AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS date_time, date_trunc('hour', ts) AS hr,
              CAST(user_id % 2 + 1 AS INT) AS plant_id, user_id AS source_key, event_type, value,
              CAST(props->>'$.k' AS INT) AS k FROM events),
generation AS (SELECT date_time, plant_id, source_key, round(sum(value)*10,4) AS dc_power, round(sum(value),4) AS ac_power
               FROM ev WHERE event_type IN ('click','purchase','view') GROUP BY ALL),
sensor AS (SELECT date_time, plant_id, round(avg(value)/4,8) AS ambient_temperature,
                  round(avg(value)/4+avg(k)/5,8) AS module_temperature,
                  round(greatest(0.0, sin(pi()*(hour(date_time)-6)/12.0))*avg(k)/100,8) AS irradiation
           FROM ev WHERE event_type='error' GROUP BY date_time, plant_id),
om_base AS (SELECT hr AS date_time, plant_id, avg(value) AS v, avg(k) AS k, CAST(max(k) AS DOUBLE) AS m,
                   greatest(0.0, sin(pi()*(hour(hr)-6)/12.0)) * avg(value) * 10 AS s
            FROM ev WHERE event_type='signup' GROUP BY hr, plant_id),
om AS (SELECT date_time, plant_id, round(v,8) AS om_temperature_2m, round(k,8) AS om_relative_humidity_2m,
              round(v - k/5,8) AS om_dew_point_2m, round(v + k/50,8) AS om_apparent_temperature,
              round(1000 + k/10,8) AS om_pressure_msl, round(950 + k/10,8) AS om_surface_pressure,
              round(greatest(0.0, k-60)/10,8) AS om_precipitation, m AS om_cloud_cover,
              round(abs(k-50)/2,8) AS om_wind_speed_10m, round(k*3.6,8) AS om_wind_direction_10m,
              round(s,8) AS om_shortwave_radiation, round(s*(100-m)/100,8) AS om_direct_radiation,
              round(s*m/100,8) AS om_diffuse_radiation, round(s*(100-m)/90,8) AS om_direct_normal_irradiance,
              round(36*(100-m),8) AS om_sunshine_duration FROM om_base),
span AS (SELECT plant_id, min(date_time) AS start_time, max(date_time) AS end_time
         FROM (SELECT plant_id, date_time FROM generation UNION ALL SELECT plant_id, date_time FROM sensor) GROUP BY plant_id),
grid AS (SELECT plant_id, unnest(generate_series(start_time, end_time, INTERVAL 15 MINUTE)) AS date_time FROM span),
instants AS (SELECT DISTINCT plant_id, date_time FROM generation)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def filled(name: str, source: str, cols, at: str, keep: str) -> str:
    """Linear fill of `cols` over `source` per plant, ordered and weighed by the column `at`."""
    found, values = [], []
    for c in cols:
        p = f"CASE WHEN {c} IS NOT NULL THEN {at} END"
        found += [
            f"last_value({c} IGNORE NULLS) OVER b AS pv_{c}", f"last_value({p} IGNORE NULLS) OVER b AS pp_{c}",
            f"first_value({c} IGNORE NULLS) OVER a AS nv_{c}", f"first_value({p} IGNORE NULLS) OVER a AS np_{c}",
        ]
        line = f"CASE WHEN pp_{c} IS NOT NULL AND np_{c} IS NOT NULL THEN pv_{c}+(nv_{c}-pv_{c})*({at}-pp_{c})/(np_{c}-pp_{c}) END"
        values.append(f"coalesce({c}, {line}, pv_{c}, nv_{c}) AS {c}")
    return f"""{name}_near AS (SELECT *, {', '.join(found)} FROM {source}
  WINDOW b AS (PARTITION BY plant_id ORDER BY {at} {BACK}), a AS (PARTITION BY plant_id ORDER BY {at} {AHEAD})),
{name} AS (SELECT {keep}, {', '.join(values)} FROM {name}_near)"""


def side(name: str, table: str, cols) -> str:
    """A weather table filled at its own instants and those of generation."""
    listed = ", ".join(f"t.{c}" for c in cols)
    return f"""{name}_all AS (SELECT plant_id, date_time, {listed}, CAST(epoch(date_time) AS DOUBLE) AS sec
  FROM instants FULL JOIN (SELECT plant_id, date_time, {', '.join(cols)} FROM {table}) t USING (plant_id, date_time)),
""" + filled(name, f"{name}_all", cols, "sec", "plant_id, date_time")


def cleaned(om_cols=()) -> str:
    parts = [side("sensor_f", "sensor", SENSOR)]
    joins, cols = "LEFT JOIN sensor_f USING (plant_id, date_time)", SENSOR
    if om_cols:
        parts.append(side("om_f", "om", om_cols))
        joins, cols = joins + " LEFT JOIN om_f USING (plant_id, date_time)", [*SENSOR, *om_cols]
    parts.append(f"""cleaned AS (SELECT date_time, plant_id, source_key, dc_power, ac_power, {', '.join(cols)}
  FROM generation {joins})""")
    return ",\n".join(parts)


JOINED = f"""joined AS (SELECT date_time, plant_id, source_key, dc_power, ac_power, {', '.join(SENSOR + NARROW)}
  FROM generation LEFT JOIN sensor USING (plant_id, date_time) LEFT JOIN om USING (plant_id, date_time))"""


def history(source: str) -> str:
    return f"""history AS (SELECT plant_id, source_key, date_time,
    lag(irradiation, 1) OVER w AS irradiation_lag_1, lag(irradiation, 2) OVER w AS irradiation_lag_2,
    lag(ambient_temperature, 1) OVER w AS ambient_temp_lag_1, lag(module_temperature, 1) OVER w AS module_temp_lag_1,
    CASE WHEN count(irradiation) OVER f = 4 THEN avg(irradiation) OVER f END AS irradiation_roll_mean_1h,
    CASE WHEN count(irradiation) OVER f = 4 THEN stddev_samp(irradiation) OVER f END AS irradiation_roll_std_1h
  FROM {source}
  WINDOW w AS (PARTITION BY plant_id, source_key ORDER BY date_time),
         f AS (PARTITION BY plant_id, source_key ORDER BY date_time ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""


HISTORY_FILLED = "history_b AS (SELECT plant_id, source_key, date_time, " + ", ".join(
    f"first_value({c} IGNORE NULLS) OVER a AS {c}" for c in HISTORY
) + f""" FROM history WINDOW a AS (PARTITION BY plant_id, source_key ORDER BY date_time {AHEAD}))"""


def history_forward(partition: str, order: str) -> str:
    cols = ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS {c}" for c in HISTORY)
    return f"""history_f AS (SELECT plant_id, source_key, date_time, {cols} FROM history_b
  WINDOW b AS (PARTITION BY {partition} ORDER BY {order} {BACK}))"""


SPLIT = """CASE WHEN date_time < start_time + INTERVAL 20 DAY THEN 'train'
       WHEN date_time < start_time + INTERVAL 27 DAY THEN 'val' ELSE 'test' END AS split"""
GEN_SPLIT = f"""gen_split AS (SELECT g.*, {SPLIT}
  FROM generation g JOIN (SELECT plant_id, min(date_time) AS start_time FROM generation GROUP BY plant_id) USING (plant_id))"""
CAPPED = f"""flagged AS (SELECT *, CAST(coalesce(irradiation > 1e-4, false) AS INT) AS is_day,
    module_temperature - ambient_temperature AS temp_diff FROM cleaned),
capped AS (SELECT f.* REPLACE (CASE WHEN is_day = 0 THEN 0.0 ELSE ac_power END AS ac_power,
                               CASE WHEN is_day = 0 THEN 0.0 ELSE dc_power END AS dc_power), {SPLIT}
  FROM flagged f JOIN (SELECT plant_id, min(date_time) AS start_time FROM generation GROUP BY plant_id) USING (plant_id)),
previous AS (SELECT *, coalesce(lag(ac_power) OVER w, 0.0) AS last_reading, coalesce(avg(ac_power) OVER f, 0.0) AS mean_reading
  FROM capped WINDOW w AS (PARTITION BY plant_id, source_key ORDER BY date_time),
    f AS (PARTITION BY plant_id, source_key ORDER BY date_time ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""
SCORED = """raw_scored AS (SELECT plant_id, source_key, date_time, split, is_day, ac_power, last_reading,
    'Last Reading' AS model, last_reading - 20 AS prediction FROM previous
  UNION ALL SELECT plant_id, source_key, date_time, split, is_day, ac_power, last_reading,
    'Mean Reading', mean_reading - 10 FROM previous WHERE plant_id = 1),
scored AS (SELECT * REPLACE (CASE WHEN is_day = 0 THEN 0.0 ELSE greatest(prediction, 0.0) END AS prediction) FROM raw_scored)"""


def scores(where: str = "true", prefix: str = "", y: str = "ac_power", p: str = "prediction") -> str:
    f = f"FILTER (WHERE {where})"
    sse = f"sum(({y}-{p})*({y}-{p})) {f}"
    return f"""CASE WHEN count(*) {f} < 2 THEN NULL
      WHEN max({y}) {f} = min({y}) {f} THEN CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END
      ELSE 1 - {sse} / (var_pop({y}) {f} * count(*) {f}) END AS {prefix}r2,
    avg(abs({y}-{p})) {f} AS {prefix}mae, sqrt(avg(({y}-{p})*({y}-{p})) {f}) AS {prefix}rmse,
    100 * coalesce(avg(abs(({y}-{p})/nullif({y}, 0))) FILTER (WHERE {where} AND {y} > 5), 0.0) AS {prefix}mape"""


METRICS = ["r2", "mae", "rmse", "mape"]
BOARD_METRICS = [f"{s}_{m}" for s in ("val", "test") for m in METRICS]


def board(name: str, source: str) -> str:
    return f"""{name} AS (SELECT 'Plant ' || plant_id AS plant, model,
    {scores("split = 'val'", 'val_')}, {scores("split = 'test'", 'test_')}
  FROM {source} WHERE split IN ('val', 'test') GROUP BY plant_id, model)"""


BOARD = (cleaned(), CAPPED, SCORED, board("board", "scored"))


def correlation(cols, source: str, a: str = "a", b: str = "b", names=None) -> str:
    names = names or {c: c for c in cols}
    rows = []
    for x, y in product(cols, cols):
        value = f"CASE WHEN var_pop({x}) > 0 THEN 1.0 END" if x == y else f"corr({x}, {y})"
        if x != y:
            value = f"CASE WHEN isnan({value}) THEN NULL ELSE {value} END"
        rows.append(f"SELECT plant_id, '{names[x]}' AS {a}, '{names[y]}' AS {b}, {r(value, 'r')} FROM {source} GROUP BY plant_id")
    return "\nUNION ALL ".join(rows)


LABELS = {
    "ac_power": "Ac Power", "dc_power": "Dc Power", "ambient_temperature": "Ambient Temperature", "module_temperature": "Module Temperature",
    "irradiation": "Irradiation", "om_temperature_2m": "Temperature 2M", "om_relative_humidity_2m": "Relative Humidity 2M",
    "om_cloud_cover": "Cloud Cover", "om_wind_speed_10m": "Wind Speed 10M",
}


def histogram(col: str, bins: int) -> str:
    return sql(
        f"""SELECT plant_id, CAST(bin AS INT) AS bin, {r(f'lo + w * bin', 'left_edge')}, {r('lo + w * (bin + 1)', 'right_edge')},
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT plant_id, lo, w, unnest(range({bins})) AS bin FROM spans) LEFT JOIN counts USING (plant_id, bin)""",
        "day AS (SELECT * FROM generation WHERE ac_power > 0.5)",
        f"""spans AS (SELECT plant_id, min({col}) AS lo, (max({col}) - min({col})) / {bins} AS w FROM day GROUP BY plant_id)""",
        f"""counts AS (SELECT plant_id, bin, count(*) AS n FROM (
    SELECT plant_id, CASE WHEN x < lo + w * g THEN g - 1 WHEN g < {bins - 1} AND x >= lo + w * (g + 1) THEN g + 1 ELSE g END AS bin
    FROM (SELECT plant_id, lo, w, {col} AS x, CAST(least(floor(({col} - lo) / w), {bins - 1}) AS BIGINT) AS g
          FROM day JOIN spans USING (plant_id))) GROUP BY plant_id, bin)""",
    )


def density(col: str) -> str:
    return sql(
        f"""SELECT plant_id, CAST(point AS INT) AS point, {r('lo + step * point', 'x', 8)},
    {r(f'sum(exp(-0.5 * pow((lo + step * point - {col}) / h, 2))) / (h * sqrt(2 * pi()) * n)', 'density', 8)}
FROM day JOIN (SELECT *, unnest(range(200)) AS point FROM stats) USING (plant_id) GROUP BY plant_id, point, lo, step, h, n""",
        "day AS (SELECT * FROM generation WHERE ac_power > 0.5)",
        f"""stats AS (SELECT plant_id, count(*) AS n, min({col}) AS lo, (max({col}) - min({col})) / 199 AS step,
    stddev_samp({col}) * pow(count(*), -0.2) AS h FROM day GROUP BY plant_id)""",
    )


def trend(x: str, y: str, source: str) -> str:
    return f"""SELECT plant_id, {r(f'regr_slope({y}, {x})', 'slope')}, {r(f'regr_intercept({y}, {x})', 'intercept')},
       {r(f'regr_r2({y}, {x})', 'r2')}, CAST(regr_count({y}, {x}) AS BIGINT) AS n FROM {source} GROUP BY plant_id"""


def binned(x: str, y: str, source: str, bins: int = 20) -> tuple[str, str]:
    cte = f"""centres AS (SELECT plant_id, quantile_cont({x}, [{', '.join(repr(i / (bins + 1)) for i in range(1, bins + 1))}]) AS cs
  FROM {source} WHERE {x} IS NOT NULL GROUP BY plant_id),
nearest AS (SELECT plant_id, {y} AS y, list_min([struct_pack(d := abs({x} - c), i := i, c := c) FOR c, i IN cs]).c AS centre
  FROM {source} JOIN centres USING (plant_id) WHERE {x} IS NOT NULL)"""
    body = f"""SELECT plant_id, {r('centre')}, {r('avg(y)', 'mean_y')}, {r('stddev_samp(y) / sqrt(count(y))', 'std_error')},
       count(*) AS n FROM nearest GROUP BY plant_id, centre"""
    return cte, body


SUNNY = """sunny AS (SELECT *, module_temperature - ambient_temperature AS temp_diff FROM cleaned WHERE irradiation > 0.1)"""
PEAK = "peak AS (SELECT * FROM cleaned WHERE hour(date_time) BETWEEN 10 AND 15)"
K3 = "plant_id, source_key, date_time"

PLANT_SERIES = (
    """grid_sensor AS (SELECT g.plant_id, g.date_time, ambient_temperature, module_temperature, irradiation,
    CAST(epoch(date_time) AS DOUBLE) AS sec FROM grid g LEFT JOIN sensor USING (plant_id, date_time))""",
    filled("grid_f", "grid_sensor", SENSOR, "sec", "plant_id, date_time"),
    """plant_series AS (SELECT plant_id, date_time, ambient_temperature, module_temperature, irradiation,
    module_temperature - ambient_temperature AS temp_diff, coalesce(p.ac_power, 0.0) AS ac_power
  FROM grid_f LEFT JOIN (SELECT plant_id, date_time, sum(ac_power) AS ac_power FROM generation GROUP BY ALL) p
  USING (plant_id, date_time))""",
)


def windows(source: str, keys: str, lookback: int, horizon: int) -> str:
    sums = ", ".join(r(f"sum({c}) OVER x", f"sum_{c}") for c in ("ac_power", "irradiation", "module_temperature", "temp_diff"))
    return f"""SELECT {keys}, start_time, {', '.join(f"sum_{c}" for c in ("ac_power", "irradiation", "module_temperature", "temp_diff"))},
       sum_y, last_x, first_y, CAST({lookback} AS INT) AS n_x, CAST({horizon} AS INT) AS n_y
FROM (SELECT {keys}, date_time AS start_time, {sums}, {r('sum(ac_power) OVER y', 'sum_y')},
        {r('last_value(ac_power) OVER x', 'last_x')}, {r('first_value(ac_power) OVER y', 'first_y')}, count(*) OVER xy AS full_len
      FROM {source} WINDOW
        x AS (PARTITION BY {keys} ORDER BY date_time ROWS BETWEEN CURRENT ROW AND {lookback - 1} FOLLOWING),
        y AS (PARTITION BY {keys} ORDER BY date_time ROWS BETWEEN {lookback} FOLLOWING AND {lookback + horizon - 1} FOLLOWING),
        xy AS (PARTITION BY {keys} ORDER BY date_time ROWS BETWEEN CURRENT ROW AND {lookback + horizon - 1} FOLLOWING))
WHERE full_len = {lookback + horizon}"""


def order_times(fmt: str) -> str:
    return f"""WITH texts AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'bad'
    ELSE strftime(o_orderdate, '{fmt}') END AS time_text FROM orders),
parsed AS (SELECT *, CAST(try_strptime(time_text, '{fmt}') AS TIMESTAMP) AS date_time FROM texts)
"""


def scaled(shift: str, scale: str) -> str:
    cols = ["ambient_temperature", "module_temperature", "irradiation", "temp_diff"]
    params = ", ".join(
        f"{shift.format(c=c)} AS a_{c}, CASE WHEN {scale.format(c=c)} > 0 THEN {scale.format(c=c)} ELSE 1.0 END AS b_{c}" for c in cols
    )
    return sql(
        f"SELECT {K3}, split, {', '.join(r(f'({c} - a_{c}) / b_{c}', c) for c in cols)} FROM capped JOIN params USING (plant_id)",
        cleaned(), CAPPED, f"params AS (SELECT plant_id, {params} FROM capped WHERE split = 'train' GROUP BY plant_id)",
    )


MODEL_FEATURES = [
    "ambient_temperature", "module_temperature", "irradiation", "temp_diff", "hour_sin", "hour_cos", "day_of_year_sin", "day_of_year_cos",
    *HISTORY, "om_temperature_2m", "om_relative_humidity_2m",
]
LINEAR_FEATURES = ["ambient_temperature", "module_temperature", "irradiation", "om_temperature_2m"]


def least_squares(names: list[str], alpha: float) -> tuple[str, ...]:
    """Statements up to `solved` (w0, w1, ..., b per plant): normal equations of scaled features, solved by elimination."""
    p = len(names)
    known = " AND ".join(f"x{i} IS NOT NULL" for i in range(p))
    places = [(i, j) for i in range(p) for j in range(i, p)]
    first = [f"n * covar_{i}_{j} + {alpha if i == j else 0.0} AS a{i}_{j}" for i, j in places]
    first += [f"n * covar_{i}_{j} AS a{j}_{i}" for i, j in places if i != j] + [f"n * covar_{i}_y AS a{i}_{p}" for i in range(p)]
    means = ", ".join(["my", *[f"m{i}" for i in range(p)]])
    steps = []
    for k in range(p):
        row = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" for j in range(k + 1, p + 1)]
        row += [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(p) if i != k for j in range(k + 1, p + 1)]
        steps.append(f"step{k + 1} AS MATERIALIZED (SELECT plant_id, {means}, {', '.join(row)} FROM step{k})")
    return (
        cleaned(NARROW), CAPPED, history("cleaned"), HISTORY_FILLED, history_forward("plant_id, source_key", "date_time"),
        f"""model_rows AS MATERIALIZED (SELECT *, sin(2*pi()*hour(date_time)/24.0) AS hour_sin, cos(2*pi()*hour(date_time)/24.0) AS hour_cos,
    sin(2*pi()*dayofyear(date_time)/365.25) AS day_of_year_sin, cos(2*pi()*dayofyear(date_time)/365.25) AS day_of_year_cos
  FROM capped JOIN history_f USING ({K3}))""",
        f"""model_params AS (SELECT plant_id, {', '.join(f"avg({c}) AS s{i}, CASE WHEN max({c}) > min({c}) THEN stddev_pop({c}) ELSE 1.0 END AS d{i}" for i, c in enumerate(names))}
  FROM model_rows WHERE split = 'train' GROUP BY plant_id)""",
        f"""xs AS MATERIALIZED (SELECT plant_id, split, is_day, ac_power, {', '.join(f"({c} - s{i}) / d{i} AS x{i}" for i, c in enumerate(names))}
  FROM model_rows JOIN model_params USING (plant_id))""",
        f"""moments AS MATERIALIZED (SELECT plant_id, count(*) AS n, avg(ac_power) AS my, {', '.join(f"avg(x{i}) AS m{i}" for i in range(p))},
    {', '.join(f"covar_pop(x{i}, x{j}) AS covar_{i}_{j}" for i, j in places)}, {', '.join(f"covar_pop(x{i}, ac_power) AS covar_{i}_y" for i in range(p))}
  FROM xs WHERE split = 'train' AND {known} AND ac_power IS NOT NULL GROUP BY plant_id)""",
        f"step0 AS MATERIALIZED (SELECT plant_id, {means}, {', '.join(first)} FROM moments)",
        *steps,
        f"""solved AS (SELECT plant_id, {', '.join(f"a{i}_{p} AS w{i}" for i in range(p))}, my - ({' + '.join(f"a{i}_{p} * m{i}" for i in range(p))}) AS b FROM step{p})""",
    )


def weights(names: list[str], alpha: float) -> str:
    rows = [f"SELECT plant_id, '{c}' AS feature, {r(f'w{i}', 'weight', 5)} FROM solved" for i, c in enumerate(names)]
    rows.append(f"SELECT plant_id, 'intercept' AS feature, {r('b', 'weight', 5)} FROM solved")
    return sql("\nUNION ALL ".join(rows), *least_squares(names, alpha))


NUMBERED_SERIES = f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plant_id, split ORDER BY date_time) AS i,
    count(*) OVER (PARTITION BY plant_id, split) AS n FROM (
    SELECT p.*, {SPLIT} FROM plant_series p JOIN (SELECT plant_id, min(date_time) AS start_time FROM plant_series GROUP BY plant_id) USING (plant_id)))"""

def day_ahead_weights(lookback: int = 2, horizon: int = 3) -> str:
    """Linear models of the next steps by elimination; inputs reading by reading."""
    names = ["ac_power", "irradiation", "module_temperature", "temp_diff"]
    p = lookback * len(names)
    xs = [f"lead({c}, {k}) OVER w AS x{k * len(names) + j}" for k in range(lookback) for j, c in enumerate(names)]
    ys = [f"lead(ac_power, {lookback + k}) OVER w AS y{k}" for k in range(horizon)]
    places = [(i, j) for i in range(p) for j in range(i, p)]
    moments = [f"covar_pop(x{i}, x{j}) AS a{i}_{j}" for i, j in places] + [f"covar_pop(x{i}, x{j}) AS a{j}_{i}" for i, j in places if i != j]
    moments += [f"covar_pop(x{i}, y{k}) AS a{i}_{p + k}" for i in range(p) for k in range(horizon)]
    means = [f"m{i}" for i in range(p)] + [f"my{k}" for k in range(horizon)]
    steps = []
    for k in range(p):
        row = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" for j in range(k + 1, p + horizon)]
        row += [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(p) if i != k for j in range(k + 1, p + horizon)]
        steps.append(f"step{k + 1} AS MATERIALIZED (SELECT plant_id, n, {', '.join(means)}, {', '.join(row)} FROM step{k})")
    rows = []
    for k in range(horizon):
        head = f"SELECT plant_id, CAST({k + 1} AS INT) AS step, n"
        rows += [f"{head}, 'x{i}' AS input, {r(f'a{i}_{p + k}', 'weight', 4)} FROM step{p}" for i in range(p)]
        rows.append(f"{head}, 'intercept' AS input, {r(f'my{k} - (' + ' + '.join(f'a{i}_{p + k} * m{i}' for i in range(p)) + ')', 'weight', 4)} FROM step{p}")
    return sql(
        "\nUNION ALL ".join(rows), *PLANT_SERIES, NUMBERED_SERIES,
        f"""xs AS MATERIALIZED (SELECT plant_id, {', '.join(xs + ys)} FROM numbered WHERE split = 'train'
    WINDOW w AS (PARTITION BY plant_id ORDER BY date_time) QUALIFY i + {lookback + horizon - 1} <= n)""",
        f"""step0 AS MATERIALIZED (SELECT plant_id, count(*) AS n, {', '.join(f"avg(x{i}) AS m{i}" for i in range(p))}, {', '.join(f"avg(y{k}) AS my{k}" for k in range(horizon))},
    {', '.join(moments)} FROM xs GROUP BY plant_id)""",
        *steps,
    )


WIND_BINNED = binned("om_wind_speed_10m", "temp_diff", "sunny")
CLOUD_BINNED = binned("om_cloud_cover", "om_direct_radiation", "peak")

ORACLE: dict[str, str] = {
    "src_generation": sql("SELECT * FROM generation"),
    "src_sensor": sql("SELECT * FROM sensor"),
    "src_weather": sql("SELECT * FROM om"),
    "weather_json": sql(
        f"""SELECT plant_id AS plant_no, date_time, {', '.join(WEATHER_COLS)},
    CASE plant_id WHEN 1 THEN 14.815 ELSE 19.997 END::DOUBLE AS latitude,
    CASE plant_id WHEN 1 THEN 78.287 ELSE 73.79 END::DOUBLE AS longitude,
    'Asia/Kolkata' AS open_meteo_timezone, CAST(19800 AS INT) AS open_meteo_utc_offset_seconds FROM om"""
    ),
    "weather_json_bad": sql(
        """SELECT DISTINCT plant_id AS plant_no, CAST(date_time AS DATE) AS day,
    CASE day(date_time) % 7 WHEN 0 THEN 'daily limit exceeded' WHEN 1 THEN 'missing variable: wind_speed_10m'
      ELSE 'no hourly time' END AS fault FROM om WHERE day(date_time) % 7 < 3"""
    ),
    "parse_dmy": order_times("%d-%m-%Y %H:%M") + "SELECT * FROM parsed WHERE date_time IS NOT NULL",
    "parse_iso": order_times("%Y-%m-%d %H:%M:%S") + "SELECT * FROM parsed",
    "bad_time_count": order_times("%d-%m-%Y %H:%M")
    + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE date_time IS NULL) AS n_bad FROM parsed",
    "date_span": sql("SELECT *, strftime(start_time, '%Y-%m-%d') AS start_date, strftime(end_time, '%Y-%m-%d') AS end_date FROM span"),
    "time_grid": sql("SELECT * FROM grid"),
    "weather_grid": sql(
        f"""SELECT plant_id, date_time, {rs(WEATHER_COLS)}, plant_id AS plant_no, 'Asia/Kolkata' AS open_meteo_timezone FROM grid_f""",
        f"""grid_om AS (SELECT g.plant_id, g.date_time, CAST(epoch(date_time) AS DOUBLE) AS sec, {', '.join(WEATHER_COLS)}
  FROM grid g LEFT JOIN om USING (plant_id, date_time))""",
        filled("grid_f", "grid_om", WEATHER_COLS, "sec", "plant_id, date_time"),
    ),
    "clean_join": sql("SELECT * FROM joined", JOINED),
    "clean_fill_time": sql(
        f"SELECT {K3}, {rs(['dc_power', 'ac_power', *SENSOR, *NARROW])} FROM cleaned", cleaned(NARROW)
    ),
    "clean_fill_row": sql(
        f"SELECT {K3}, {rs(['dc_power', 'ac_power', *SENSOR, *NARROW])} FROM row_f", JOINED,
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY date_time, source_key) AS rk FROM joined)",
        filled("row_f", "numbered", [*SENSOR, *NARROW], "rk", f"{K3}, dc_power, ac_power"),
    ),
    "table_profile": sql(
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, {r(f'min({c})', 'min_value')},
       {r(f'max({c})', 'max_value')} FROM joined"""
            for c in ["dc_power", "ac_power", *SENSOR, *NARROW]
        ),
        JOINED,
    ),
    "preview": sql("SELECT * FROM generation ORDER BY date_time, plant_id, source_key LIMIT 3"),
    "daylight_rows": sql("SELECT * FROM generation WHERE ac_power > 0.5"),
    "peak_hours": sql("SELECT * FROM generation WHERE hour(date_time) BETWEEN 10 AND 15"),
    "feat_basic": sql(
        f"""SELECT {K3}, CAST(coalesce(irradiation > 1e-4, false) AS INT) AS is_day,
    {r('module_temperature - ambient_temperature', 'temp_diff')} FROM joined""",
        JOINED,
    ),
    "feat_calendar": sql(
        f"""SELECT {K3}, CAST(hour(date_time) AS INT) AS hour, CAST(minute(date_time) AS INT) AS minute,
    CAST(dayofyear(date_time) AS INT) AS day_of_year FROM generation"""
    ),
    "feat_cyclic": sql(
        f"""SELECT {K3}, {r('sin(2*pi()*hour(date_time)/24.0)', 'hour_sin')}, {r('cos(2*pi()*hour(date_time)/24.0)', 'hour_cos')},
    {r('sin(2*pi()*dayofyear(date_time)/365.25)', 'day_of_year_sin')},
    {r('cos(2*pi()*dayofyear(date_time)/365.25)', 'day_of_year_cos')} FROM generation"""
    ),
    "feat_lags": sql(f"SELECT {K3}, {rs(HISTORY[:4])} FROM history", cleaned(), history("cleaned")),
    "feat_rolling": sql(f"SELECT {K3}, {rs(HISTORY[4:])} FROM history", cleaned(), history("cleaned")),
    "feat_filled": sql(
        f"SELECT {K3}, {rs(HISTORY)} FROM history_f", JOINED, history("joined"), HISTORY_FILLED,
        history_forward("plant_id, source_key", "date_time"),
    ),
    "feat_filled_carry": sql(
        f"SELECT {K3}, {rs(HISTORY)} FROM history_f", JOINED, history("joined"), HISTORY_FILLED,
        history_forward("plant_id", "source_key, date_time"),
    ),
    "night_cap": sql(
        f"""SELECT {K3}, is_day, {r('c.ac_power', 'ac_power')}, {r('c.dc_power', 'dc_power')},
    {r('g.ac_power', 'ac_power_raw')}, {r('g.dc_power', 'dc_power_raw')} FROM capped c JOIN generation g USING ({K3})""",
        cleaned(), CAPPED,
    ),
    "hourly_profile": sql(
        f"""SELECT plant_id, CAST(hour(date_time) AS INT) AS hour,
    {', '.join(r(f'avg({c})', c) for c in ['ac_power', 'irradiation', 'module_temperature', 'ambient_temperature'])}
FROM cleaned GROUP BY plant_id, hour(date_time)""",
        cleaned(),
    ),
    "inverter_yield": sql(
        f"""SELECT plant_id, source_key, {r('sum(ac_power)', 'ac_power_sum', 8)}, {r('sum(ac_power)/4.0/1000.0', 'yield_mwh', 8)}
FROM generation GROUP BY ALL"""
    ),
    "yield_rank": sql(
        f"""SELECT plant_id, source_key, {r('s', 'ac_power_sum', 8)}, {r('s/4.0/1000.0', 'yield_mwh', 8)},
    row_number() OVER (PARTITION BY plant_id ORDER BY s, source_key) AS rank
FROM (SELECT plant_id, source_key, sum(ac_power) AS s FROM generation GROUP BY ALL)"""
    ),
    "yield_gap": sql(
        f"""SELECT plant_id, source_key, {r('s', 'ac_power_sum', 8)}, {r('s/4.0/1000.0', 'yield_mwh', 8)},
    {r('max(s/4.0/1000.0) OVER p', 'best_mwh', 8)}, {r('1 - s/max(s) OVER p', 'gap', 8)}
FROM (SELECT plant_id, source_key, sum(ac_power) AS s FROM generation GROUP BY ALL) WINDOW p AS (PARTITION BY plant_id)"""
    ),
    "zero_power": sql(
        f"""SELECT plant_id, source_key, count(*) AS n_bright, count(*) FILTER (WHERE ac_power = 0) AS n_zero,
    {r('(count(*) FILTER (WHERE ac_power = 0)) / count(*)', 'zero_rate')} FROM cleaned WHERE irradiation > 0.2
GROUP BY plant_id, source_key""",
        cleaned(),
    ),
    "corr_matrix_5": sql(correlation(CORR_SENSOR, "cleaned", "col_a", "col_b"), cleaned()),
    "corr_matrix_9": sql(correlation(CORR_SELECTED, "cleaned", "col_a", "col_b"), cleaned(CORR_9_OM)),
    "corr_labels": sql(
        correlation(CORR_SELECTED, "cleaned", "label_a", "label_b", LABELS), cleaned(CORR_9_OM)
    ),
    "corr_matrix_15": sql(
        correlation(CORR_EXTENDED, "wide", "col_a", "col_b"), cleaned(CORR_15_OM),
        """wide AS (SELECT *, module_temperature - ambient_temperature AS temp_diff, round(sum(ac_power) OVER (
    PARTITION BY plant_id, source_key, CAST(date_time AS DATE) ORDER BY date_time) / 4, 4) AS daily_yield FROM cleaned)""",
    ),
    "hist_ac": histogram("ac_power", 30),
    "hist_dc": histogram("dc_power", 30),
    "hist_ac_35": histogram("ac_power", 35),
    "kde_ac": density("ac_power"),
    "kde_dc": density("dc_power"),
    "wind_trend": sql(trend("om_wind_speed_10m", "temp_diff", "sunny"), cleaned(WIND), SUNNY),
    "wind_binned": sql(WIND_BINNED[1], cleaned(WIND), SUNNY, WIND_BINNED[0]),
    "cloud_trend": sql(trend("om_cloud_cover", "om_direct_radiation", "peak"), cleaned(CLOUD), PEAK),
    "cloud_diffuse_trend": sql(trend("om_cloud_cover", "om_diffuse_radiation", "peak"), cleaned(CLOUD), PEAK),
    "cloud_binned": sql(CLOUD_BINNED[1], cleaned(CLOUD), PEAK, CLOUD_BINNED[0]),
    "humidity_trend": sql(trend("om_relative_humidity_2m", "ac_power", "sunny"), cleaned(NARROW), SUNNY),
    "scatter_density": sql(
        """SELECT plant_id, CAST(least(floor((irradiation - x0) / ((x1 - x0) / 40)), 39) AS INT) AS x_bin,
    CAST(least(floor((ac_power - y0) / ((y1 - y0) / 40)), 39) AS INT) AS y_bin, count(*) AS n
FROM cleaned JOIN (SELECT plant_id, min(irradiation) AS x0, max(irradiation) AS x1, min(ac_power) AS y0, max(ac_power) AS y1
                   FROM cleaned GROUP BY plant_id) USING (plant_id) GROUP BY ALL""",
        cleaned(),
    ),
    "chrono_split": sql(f"SELECT {K3}, split FROM gen_split", GEN_SPLIT),
    "split_report": sql(
        "SELECT plant_id, split, min(date_time) AS start_time, max(date_time) AS end_time, count(*) AS n_rows FROM gen_split GROUP BY ALL",
        GEN_SPLIT,
    ),
    "scale_standard": scaled("avg({c})", "stddev_pop({c})"),
    "scale_minmax": scaled("min({c})", "(max({c}) - min({c}))"),
    "unscale": sql(
        f"""SELECT {K3}, {r('greatest((last_reading - 20 - a) / b, 0.0) * b + a', 'prediction')} FROM previous JOIN params USING (plant_id)""",
        cleaned(), CAPPED,
        """params AS (SELECT plant_id, min(ac_power) AS a, max(ac_power) - min(ac_power) AS b
  FROM capped WHERE split = 'train' GROUP BY plant_id)""",
    ),
    "pred_limits": sql(f"SELECT {K3}, model, is_day, {r('prediction')} FROM scored", cleaned(), CAPPED, SCORED),
    "eval_metrics": sql(
        f"SELECT plant_id, model, split, {rs(METRICS)} FROM (SELECT plant_id, model, split, {scores()} FROM scored GROUP BY ALL)",
        cleaned(), CAPPED, SCORED,
    ),
    "metrics_report": sql(f"SELECT plant, model, {rs(BOARD_METRICS)} FROM board", *BOARD),
    "metrics_text": sql(
        """SELECT 1 AS line_no, 'SOLAR POWER MODELS: METRICS REPORT' AS line
UNION ALL SELECT 1 + row_number() OVER (ORDER BY number, plant, block, kind, model), line FROM (
  SELECT plant, number, 0 AS block, 0 AS kind, '' AS model, '--- ' || upper(plant) || ' ---' AS line FROM plants
  UNION ALL SELECT plant, number, 1, 0, '', '[EVALUATION ON VALIDATION SET]' FROM plants
  UNION ALL SELECT plant, number, 2, 0, '', '[EVALUATION ON TEST SET (HOLDOUT FUTURE)]' FROM plants
  UNION ALL SELECT plant, number, unnest([1, 2]), 1, '', 'Model                  |         R2 |   MAE (kW) |   RMSE (kW) |   MAPE (%)' FROM plants
  UNION ALL SELECT plant, number, 1, 2, model, printf('%-22s | %10.4f | %10.2f | %11.2f | %9.2f%%', model, val_r2, val_mae, val_rmse, val_mape) FROM renamed
  UNION ALL SELECT plant, number, 2, 2, model, printf('%-22s | %10.4f | %10.2f | %11.2f | %9.2f%%', model, test_r2, test_mae, test_rmse, test_mape) FROM renamed)""",
        *BOARD,
        """renamed AS (
  SELECT plant, CAST(regexp_extract(plant, '([0-9]+)$', 1) AS BIGINT) AS number, model, val_r2, val_mae, val_rmse, val_mape, test_r2, test_mae, test_rmse, test_mape FROM board
  UNION ALL SELECT 'Plant 10', 10, model || ' with Optimized Parameters', val_r2, val_mae * 1e9, val_rmse * 1e9, val_mape, test_r2 * 1e9, test_mae * 1e9, test_rmse * 1e9, test_mape
  FROM board WHERE plant = 'Plant 1')""",
        "plants AS (SELECT DISTINCT plant, number FROM renamed)",
    ),
    "leaderboard_upsert": sql(
        f"""SELECT plant, model, CAST(NULL AS VARCHAR) AS author, {rs(BOARD_METRICS)} FROM board WHERE model <> 'Last Reading'
UNION ALL SELECT plant, model, 'team', {rs(BOARD_METRICS)} FROM renewed""",
        *BOARD,
        """again AS (SELECT * REPLACE (CASE WHEN is_day = 0 THEN 0.0 ELSE greatest(last_reading, 0.0) END AS prediction)
  FROM raw_scored WHERE model = 'Last Reading')""",
        board("renewed", "again"),
    ),
    "preferred_model": sql(
        """SELECT plant, CASE WHEN bool_or(model = 'Mean Reading') THEN 'Mean Reading' ELSE 'Last Reading' END AS model
FROM board GROUP BY plant""",
        *BOARD,
    ),
    "model_slug": sql(f"SELECT plant, model, replace(lower(model), ' ', '_') AS slug, {r('test_r2')} FROM board", *BOARD),
    "skipped_rows": sql(
        f"""SELECT plant_id, split, count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in [*SENSOR, *NARROW, *HISTORY])}) AS n_skipped,
    count(*) AS n_rows FROM history JOIN joined USING ({K3}) JOIN gen_split USING ({K3}) GROUP BY plant_id, split""",
        JOINED, history("joined"), GEN_SPLIT,
    ),
    "forecast_curve": sql(
        f"""SELECT plant_id, source_key, date_time, {r('ac_power', 'actual')}, {r('prediction', 'predicted')}
FROM test JOIN (SELECT plant_id, date_time AS t0, source_key FROM test
                QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY date_time, source_key) = 1) USING (plant_id, source_key)
WHERE date_time BETWEEN t0 AND t0 + INTERVAL 3 DAY""",
        cleaned(), CAPPED, SCORED, "test AS (SELECT * FROM scored WHERE split = 'test' AND model = 'Last Reading')",
    ),
    "linear_weights": weights(LINEAR_FEATURES, 0.0),
    "ridge_weights": weights(MODEL_FEATURES, 1.0),
    "fit_ridge": sql(
        f"SELECT plant, model, {rs(BOARD_METRICS, 5)} FROM board", *least_squares(MODEL_FEATURES, 1.0),
        f"""ridge AS (SELECT plant_id, split, ac_power, 'Ridge' AS model, CASE WHEN is_day = 0 THEN 0.0 ELSE greatest(
    b + {' + '.join(f'w{i} * x{i}' for i in range(len(MODEL_FEATURES)))}, 0.0) END AS prediction FROM xs JOIN solved USING (plant_id))""",
        "known AS (SELECT * FROM ridge WHERE prediction IS NOT NULL AND ac_power IS NOT NULL)", board("board", "known"),
    ),
    "cv_folds": sql(
        f"""SELECT {K3}, CAST(CASE WHEN i < (n // 5 + 1) * (n % 5) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY date_time, source_key) - 1 AS i, count(*) OVER (PARTITION BY plant_id) AS n
  FROM capped WHERE split = 'train')""",
        cleaned(), CAPPED,
    ),
    "day_ahead_inputs": sql(
        f"""SELECT w.plant_id, w.split, CAST(t.i - w.i - 191 AS INT) AS step, count(*) AS n, {r('avg(w.last_value)', 'last_value')},
    {r('avg(w.mean_value)', 'mean_value')}, {r('avg(d.ac_power)', 'day_before')}, {r('avg(t.ac_power)', 'y')}, {r('avg(d.ac_power * t.ac_power)', 'product')}
FROM starts w JOIN numbered t ON t.plant_id = w.plant_id AND t.split = w.split AND t.i BETWEEN w.i + 192 AND w.i + 287
JOIN numbered d ON d.plant_id = w.plant_id AND d.split = w.split AND d.i = t.i - 96
GROUP BY ALL""",
        *PLANT_SERIES,
        f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plant_id, split ORDER BY date_time) AS i FROM (
    SELECT p.*, {SPLIT} FROM plant_series p JOIN (SELECT plant_id, min(date_time) AS start_time FROM plant_series GROUP BY plant_id) USING (plant_id)))""",
        """starts AS MATERIALIZED (SELECT *, lead(ac_power, 191) OVER w AS last_value, avg(ac_power) OVER h AS mean_value, count(*) OVER (PARTITION BY plant_id, split) AS n
  FROM numbered WINDOW w AS (PARTITION BY plant_id, split ORDER BY date_time), h AS (PARTITION BY plant_id, split ORDER BY date_time ROWS BETWEEN CURRENT ROW AND 191 FOLLOWING)
  QUALIFY i + 287 <= n)""",
    ),
    "seq_windows": sql(windows("plant_series", "plant_id", 192, 96), *PLANT_SERIES),
    "seq_windows_device": sql(windows("capped", "plant_id, split, source_key", 8, 4), cleaned(), CAPPED),
    "seq_sample": sql(
        f"""SELECT s.plant_id, s.date_time, CAST(s.i - c.i - 191 AS INT) AS step, {r('s.ac_power', 'actual')}, {r('d.ac_power', 'predicted')}
FROM numbered s JOIN numbered d ON d.plant_id = s.plant_id AND d.i = s.i - 96
JOIN (SELECT plant_id, i FROM numbered WHERE n - i + 1 >= 288 ORDER BY plant_id, date_time LIMIT 1 OFFSET 100) c ON c.plant_id = s.plant_id
WHERE s.i BETWEEN c.i + 192 AND c.i + 287""",
        *PLANT_SERIES,
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY date_time) AS i,
    count(*) OVER (PARTITION BY plant_id) AS n FROM plant_series)""",
    ),
    "eval_multistep": sql(
        f"SELECT plant_id, split, {rs(METRICS)} FROM (SELECT plant_id, split, {scores('true', '', 'y', 'p')} FROM flat GROUP BY ALL)",
        cleaned(), CAPPED,
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY plant_id, split, source_key ORDER BY date_time) AS i,
    count(*) OVER (PARTITION BY plant_id, split, source_key) AS n FROM capped)""",
        """flat AS (SELECT t.plant_id, t.split, t.ac_power AS y, h.ac_power AS p FROM numbered h JOIN numbered t
  ON t.plant_id = h.plant_id AND t.split = h.split AND t.source_key = h.source_key AND t.i BETWEEN h.i + 1 AND h.i + 4
  WHERE h.i >= 8 AND h.i + 4 <= h.n)""",
    ),
    "day_ahead_weights": day_ahead_weights(),
    "eval_multistep_day": sql(
        f"SELECT plant_id, split, {rs(METRICS)} FROM (SELECT plant_id, split, {scores('true', '', 'y', 'p')} FROM flat GROUP BY ALL)",
        *PLANT_SERIES, NUMBERED_SERIES,
        """flat AS (SELECT t.plant_id, t.split, t.ac_power AS y, d.ac_power AS p FROM numbered h JOIN numbered t
  ON t.plant_id = h.plant_id AND t.split = h.split AND t.i BETWEEN h.i + 1 AND h.i + 96
  JOIN numbered d ON d.plant_id = t.plant_id AND d.split = t.split AND d.i = t.i - 96
  WHERE h.i >= 192 AND h.i + 96 <= h.n)""",
    ),
}
# The same rows after they have been written to files and read back.
for again, name in {
    "files_generation": "src_generation", "files_sensor": "src_sensor", "files_weather": "src_weather", "stage_table": "chrono_split",
    "leaderboard_files": "leaderboard_upsert", "report_file": "metrics_report",
}.items():
    ORACLE[again] = ORACLE[name]
