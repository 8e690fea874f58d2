"""DuckDB SQL for the registered queries, on whole tables, written without the library's blocks and buckets."""

from __future__ import annotations

# Results made of short decimals: at six digits they would be rounding ties.
NINE_DIGITS = ["walk_forward_by_source", "site_status", "forecast_persistence", "forecast_mean_expanding",
               "residual_quantiles", "interval_u0_static", "interval_u2_regime"]
HORIZONS = [1, 6, 12, 24, 48, 72, 168]
ORDER = ("event_time, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, "
         "l_returnflag, l_linestatus")
H_LIST = "(SELECT unnest([1,6,12,24,48,72,168])::INT AS horizon)"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


WEIGHTS = {5: "0.075", 10: "0.075", 20: "0.2", 50: "0.4", 100: "0.25"}


def theta_ctes(source: str, depths: list[int], out: str = "st") -> str:
    """weight_fraction and theta_rz of ``source`` as CTE ``out``, summed in depth order."""
    wf = " + ".join(["0.0::DOUBLE"] + [f"(CASE WHEN d{d} IS NOT NULL THEN {WEIGHTS[d]}::DOUBLE ELSE 0.0::DOUBLE END)" for d in depths])
    th = " + ".join(["0.0::DOUBLE"] + [f"coalesce(({WEIGHTS[d]}::DOUBLE / nullif(wf, 0)) * d{d}, 0.0::DOUBLE)" for d in depths])
    return f"{out}_w AS (SELECT *, {wf} AS wf FROM {source}), {out} AS (SELECT *, CASE WHEN wf > 0 THEN {th} END AS theta, wf >= 0.5 AND wf > 0 AS is_valid FROM {out}_w)"


SS = """ss AS (SELECT l_suppkey AS source_id, l_shipdate AS event_time, l_orderkey, l_linenumber, l_partkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  l_quantity / 100 AS d5, 0.10::DOUBLE + 2.5::DOUBLE * l_discount AS d10, 0.10::DOUBLE + 3.0::DOUBLE * l_tax AS d20,
  0.10::DOUBLE + (l_orderkey % 300) / 1000.0::DOUBLE AS d50,
  CASE WHEN l_returnflag <> 'R' THEN 0.10::DOUBLE + (l_partkey % 300) / 1000.0::DOUBLE END AS d100,
  CASE WHEN l_linestatus = 'O' AND l_quantity > 40 THEN l_linenumber::DOUBLE ELSE 0.0::DOUBLE END AS rain,
  l_extendedprice % 1000 AS solar,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice % 40 - 5 END AS air
  FROM lineitem)"""

STATES = SS + ", " + theta_ctes("ss", [5, 10, 20, 50, 100])

SITES = """sites AS (SELECT s_suppkey AS source_id, 0.30::DOUBLE + 0.01::DOUBLE * n_regionkey AS fc,
  0.10::DOUBLE + 0.005::DOUBLE * n_regionkey AS wp FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SPLIT = STATES + f""", ix AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {ORDER}) AS step,
  count(*) OVER (PARTITION BY source_id) AS n_all FROM st WHERE is_valid),
  se AS (SELECT *, CASE WHEN step <= floor(n_all * 0.5) THEN 'train' ELSE 'test' END AS split,
    (CASE WHEN step <= floor(n_all * 0.5) THEN step ELSE step - floor(n_all * 0.5) END)::BIGINT AS rn,
    (CASE WHEN step <= floor(n_all * 0.5) THEN floor(n_all * 0.5) ELSE n_all - floor(n_all * 0.5) END)::BIGINT AS n,
    theta AS y FROM ix WHERE n_all >= 218)"""

SPLIT_ALL = SPLIT.replace(" FROM ix WHERE n_all >= 218)", " FROM ix)")


def pairs(source: str, more: str = "") -> str:
    """CTE pr: each row of ``source`` with its value every horizon ahead in the same series."""
    ahead = ", ".join(f"lead(y, {h}) OVER w" for h in HORIZONS)
    return f"""pr AS (SELECT *, y_ahead - y AS e FROM (SELECT source_id, split, rn, y{more}, unnest({HORIZONS})::INT AS horizon, unnest(ahead) AS y_ahead
      FROM (SELECT *, [{ahead}] AS ahead FROM {source} WINDOW w AS (PARTITION BY source_id, split ORDER BY rn))) WHERE y_ahead IS NOT NULL)"""


PAIRS = SPLIT + ", " + pairs("se")

CLIP = "greatest(0.0::DOUBLE, least(0.6::DOUBLE, {}))"
TIE = "5e-10::DOUBLE"


def inside(y: str, lo: str, hi: str) -> str:
    return f"({y} >= {lo} - {TIE} AND {y} <= {hi} + {TIE})"


def walk_forward(by: str) -> str:
    join = ", ".join(f"s.{c}" for c in by.split(", "))
    return f"""WITH {PAIRS},
  q AS (SELECT source_id, horizon, quantile_cont(e, 0.1) AS q10, quantile_cont(e, 0.9) AS q90 FROM pr WHERE split = 'train' GROUP BY ALL),
  m AS (SELECT source_id, avg(y) AS tm FROM se WHERE split = 'train' GROUP BY ALL),
  s AS (SELECT p.*, {CLIP.format('p.y + q10')} AS lo, {CLIP.format('p.y + q90')} AS hi, p.y_ahead - tm AS me
    FROM pr p JOIN q USING (source_id, horizon) JOIN m USING (source_id) WHERE p.split = 'test')
  SELECT {join}, count(*) AS samples, {r('avg(abs(e))', 'mae')}, {r('avg(e * e)', 'mse')}, {r('sqrt(avg(e * e))', 'rmse')},
    {r('avg(e)', 'mbe')}, {r(f"avg({inside('y_ahead', 'lo', 'hi')}::INT)", 'coverage')}, {r('avg(hi - lo)', 'width')},
    {r('CASE WHEN avg(me * me) > 0 THEN 1 - avg(e * e) / avg(me * me) ELSE 0 END', 'skill_vs_mean')}
  FROM s GROUP BY {join}"""


_FEATURES = """, ft AS (SELECT source_id, split, rn, n, event_time, y, rain, solar, """ + ", ".join(
    ["y AS lag_0"] + [f"coalesce(lag(y, {k}) OVER w, first_value(y) OVER w) AS lag_{k}" for k in (1, 2, 6, 12, 24, 48)]
) + """, CASE WHEN rn <= 24 THEN 0 ELSE y - lag(y, 24) OVER w END AS delta_24, """ + ", ".join(
    [f"sum(rain) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS rain_{k}" for k in (1, 6, 24, 72)]
) + """, coalesce(last_value(air IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(air IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temp_now,
  solar AS solar_now, sum(solar) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS solar_sum_24,
  sin(hour(event_time) * 2.0 * pi() / 24.0) AS hour_sin, cos(hour(event_time) * 2.0 * pi() / 24.0) AS hour_cos
  FROM se WINDOW w AS (PARTITION BY source_id, split ORDER BY rn)),
  fx AS (SELECT *, avg(temp_now) OVER (PARTITION BY source_id, split ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS temp_mean_24,
    CASE WHEN rain_24 > 1.0 THEN 'WET_ANTECEDENT' WHEN solar_now >= 200.0 THEN 'HIGH_EVAP' ELSE 'DRY_QUIESCENT' END AS regime FROM ft)"""

FEATURES, FEATURES_ALL = SPLIT + _FEATURES, SPLIT_ALL + _FEATURES

FPAIRS = FEATURES + ", " + pairs("fx", ", regime")

AR = ["lag_0", "lag_1", "lag_2", "lag_6", "lag_12", "lag_24", "lag_48", "delta_24"]
ARX = AR + ["rain_1", "rain_6", "rain_24", "rain_72", "temp_now", "temp_mean_24", "solar_now", "solar_sum_24", "hour_sin", "hour_cos"]


def shift(f: str) -> str:
    return {"temp_now": "15", "temp_mean_24": "15", "solar_now": "200", "solar_sum_24": "4800"}.get(f, "0.25" if f.startswith("lag") else "0")


def scale(f: str) -> str:
    return {"solar_now": "100", "solar_sum_24": "1000", "temp_now": "10", "temp_mean_24": "10", "rain_72": "10"}.get(f, "1")


def gram(features: list[str]) -> str:
    """Mean products of the shifted features, in units that keep them small."""
    cols = ", ".join(f"(f.{x} - {shift(x)}::DOUBLE) / {scale(x)}::DOUBLE AS x{i}" for i, x in enumerate(features))
    means = [r("avg(t)", "s_t")] + [r(f"avg(x{i})", f"s_{i}") for i in range(len(features))]
    means += [r(f"avg(x{i} * t)", f"t_{i}") for i in range(len(features))]
    means += [r(f"avg(x{i} * x{j})", f"c_{i}_{j}") for i in range(len(features)) for j in range(len(features)) if i <= j]
    return f"""WITH {FPAIRS}, g AS (SELECT p.source_id, p.horizon, p.y_ahead - 0.25::DOUBLE AS t, {cols}
      FROM pr p JOIN fx f USING (source_id, split, rn) WHERE p.split = 'train' AND f.n > p.horizon + 50)
      SELECT horizon, count(*) AS rows, {', '.join(means)} FROM g GROUP BY horizon"""


def _z(c: str) -> str:
    return "1.28155" if c == "80" else "1.64485"


INTERVALS = FPAIRS + """, tr AS (SELECT * FROM pr WHERE split = 'train'),
  u0 AS (SELECT source_id, horizon, quantile_cont(e, 0.1) AS lo_80, quantile_cont(e, 0.9) AS hi_80, quantile_cont(e, 0.05) AS lo_90, quantile_cont(e, 0.95) AS hi_90 FROM tr GROUP BY ALL),
  md AS (SELECT source_id, horizon, quantile_cont(e, 0.5) AS bias FROM tr GROUP BY ALL),
  u1 AS (SELECT source_id, horizon, any_value(bias) AS bias, greatest(1e-5, 1.4826::DOUBLE * quantile_cont(abs(e - bias), 0.5)) AS scale FROM tr JOIN md USING (source_id, horizon) GROUP BY ALL),
  u2 AS (SELECT source_id, horizon, regime, quantile_cont(e, 0.1) AS lo_80, quantile_cont(e, 0.9) AS hi_80, quantile_cont(e, 0.05) AS lo_90, quantile_cont(e, 0.95) AS hi_90 FROM tr GROUP BY ALL HAVING count(*) >= 20),
  sd AS (SELECT source_id, horizon, greatest(1e-5, stddev_pop(e)) AS s FROM tr GROUP BY ALL HAVING count(*) > 20),
  u3 AS (SELECT source_id, CASE WHEN count(*) >= 3 THEN exp(regr_intercept(ln(s), ln(horizon))) ELSE 0.0018 END AS sigma_1,
         CASE WHEN count(*) >= 3 THEN regr_slope(ln(s), ln(horizon)) ELSE 0.45 END AS nu FROM sd GROUP BY ALL)"""


def _bench() -> str:
    rows = []
    for c in ("80", "90"):
        z = _z(c) + "::DOUBLE"
        ends = {
            "U0_STATIC_QUANTILES": (f"p.y + u0.lo_{c}", f"p.y + u0.hi_{c}"),
            "U1_HORIZON_DISPERSION_MAD": (f"p.y + u1.bias - {z} * u1.scale", f"p.y + u1.bias + {z} * u1.scale"),
            "U2_REGIME_CONDITIONED": (f"p.y + coalesce(u2.lo_{c}, u0.lo_{c})", f"p.y + coalesce(u2.hi_{c}, u0.hi_{c})"),
            "U3_POWER_LAW_DISPERSION": (f"p.y - {z} * (u3.sigma_1 * pow(p.horizon, u3.nu))", f"p.y + {z} * (u3.sigma_1 * pow(p.horizon, u3.nu))"),
        }
        for m, (lo, hi) in ends.items():
            rows.append(f"SELECT '{m}' AS method, 0.{c[0]} AS nominal, p.horizon, p.regime, p.y_ahead, {CLIP.format(lo)} AS lo, {CLIP.format(hi)} AS hi FROM te p "
                        "JOIN u0 USING (source_id, horizon) JOIN u1 USING (source_id, horizon) LEFT JOIN u2 USING (source_id, horizon, regime) JOIN u3 USING (source_id)")
    return f"""WITH {INTERVALS}, te AS (SELECT * FROM pr WHERE split = 'test'), al AS ({' UNION ALL '.join(rows)})
      SELECT method, nominal::DOUBLE AS nominal, horizon, regime, count(*) AS samples, {r(f"avg({inside('y_ahead', 'lo', 'hi')}::INT)", 'coverage')},
      {r('avg(greatest(0, hi - lo))', 'width')} FROM al GROUP BY GROUPING SETS ((method, nominal, horizon), (method, nominal, horizon, regime))"""


RD = """rd AS (SELECT l_suppkey AS source_id, l_shipdate AS event_time, l_orderkey, l_linenumber, l_partkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  CASE WHEN l_quantity >= 49 THEN l_quantity / 80 ELSE l_quantity / 250 END AS soil_moisture_5cm,
  CASE WHEN l_linenumber <> 3 THEN 0.2::DOUBLE + l_discount END AS soil_moisture_10cm,
  0.2::DOUBLE + (l_partkey % 160) / 1000.0::DOUBLE AS soil_moisture_50cm,
  CASE WHEN month(l_shipdate) = 2 THEN 4.5::DOUBLE ELSE l_extendedprice % 30 END AS soil_temp_10cm,
  CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN l_linenumber::DOUBLE ELSE 0.0::DOUBLE END AS precip_mm,
  CASE WHEN month(l_shipdate) < 7 THEN l_extendedprice % 1505 ELSE 0.0::DOUBLE END AS solar_rad_wm2
  FROM lineitem)"""

# column, sensor, lower limit, upper limit, spike rule, exempt at zero, exempt by depth, unit
QC_CHANNELS = [
    ("soil_moisture_5cm", "SOIL_VWC_5CM", 0, 0.6, True, False, False, "m3/m3"),
    ("soil_moisture_10cm", "SOIL_VWC_10CM", 0, 0.6, True, False, False, "m3/m3"),
    ("soil_moisture_50cm", "SOIL_VWC_50CM", 0, 0.6, True, False, True, "m3/m3"),
    ("soil_temp_10cm", "SOIL_TEMP_10CM", -30, 60, False, False, False, "degC"),
    ("precip_mm", "MET_PRECIP_GAUGE", 0, 300, False, True, False, "mm"),
    ("solar_rad_wm2", "MET_SOLAR_RAD", 0, 1500, False, True, False, "W/m2"),
]
QC_COLUMNS = [c[0] for c in QC_CHANNELS]


def _flag(c) -> str:
    col, _, lo, hi, spike, zero, deep, _ = c
    parts = [f"WHEN {col} IS NULL THEN 'MISSING'", f"WHEN {col} < {lo} OR {col} > {hi}::DOUBLE THEN 'OUT_OF_RANGE'"]
    if spike:
        parts.append(f"WHEN abs({col} - lag({col}) OVER w) > 0.15::DOUBLE AND NOT precip_mm > 0.2::DOUBLE THEN 'SUSPECT_SPIKE'")
    if not deep:
        test = f"count({col}) OVER f = 12 AND max({col}) OVER f - first_value({col}) OVER f <= 1e-5::DOUBLE AND first_value({col}) OVER f - min({col}) OVER f <= 1e-5::DOUBLE"
        test += f" AND first_value({col}) OVER f <> 0" if zero else ""
        parts.append(f"WHEN {test} THEN 'SUSPECT_STUCK'")
    return f"CASE {' '.join(parts)} ELSE 'VALID' END AS flag_{col}"


HARD = "('OUT_OF_RANGE','SUSPECT_SPIKE','SUSPECT_STUCK','SYNTHETIC_CORRUPTED')"


def qc_ctes(rows: str, part: str = "source_id", out: str = "qc") -> str:
    flags = ", ".join(_flag(c) for c in QC_CHANNELS)
    hard = " OR ".join(f"flag_{c} IN {HARD}" for c in QC_COLUMNS)
    count = " + ".join(f"(flag_{c} <> 'VALID')::INT" for c in QC_COLUMNS)
    stuck = " OR ".join(f"flag_{c} = 'SUSPECT_STUCK'" for c in QC_COLUMNS)
    value = "CASE " + " ".join(f"WHEN flag_{c} IN {HARD} THEN {c}" for c in QC_COLUMNS) + " END"
    unit = "CASE " + " ".join(f"WHEN flag_{c[0]} IN {HARD} THEN '{c[7]}'" for c in QC_CHANNELS) + " END"
    order = f"PARTITION BY {part} ORDER BY {ORDER}"
    return f"""{out}_f AS (SELECT *, row_number() OVER w AS step, {flags} FROM {rows}
      WINDOW w AS ({order}), f AS ({order} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
      {out} AS (SELECT *, ({hard}) AS quarantined, {count} AS flag_count, ({stuck}) AS any_stuck,
        coalesce({value}, 0.0) AS trigger_value, coalesce({unit}, 'unitless') AS trigger_unit FROM {out}_f)"""


def reason_sql(steps: int = 12) -> str:
    parts = []
    for col, sensor, *_, unit in QC_CHANNELS:
        parts.append(f"""CASE flag_{col} WHEN 'OUT_OF_RANGE' THEN 'outside physical limits: {sensor} = ' || printf('%.4f', {col}) || ' {unit}'
          WHEN 'SUSPECT_SPIKE' THEN 'dry jump above 0.15 on {sensor}' WHEN 'SUSPECT_STUCK' THEN 'flat for {steps} steps: {sensor}' END""")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


QC = RD + ", " + qc_ctes("rd")
QC_LONG = QC + ", ql AS (" + " UNION ALL ".join(
    f"SELECT source_id, step, '{c[1]}' AS sensor_id, {c[0]} AS value, flag_{c[0]} AS qc_flag FROM qc" for c in QC_CHANNELS) + ")"

DECISION = QC + ", " + SITES + """, u AS (SELECT source_id, step, event_time, precip_mm,
    CASE WHEN flag_soil_moisture_5cm = 'VALID' THEN soil_moisture_5cm END AS d5,
    CASE WHEN flag_soil_moisture_10cm = 'VALID' THEN soil_moisture_10cm END AS d10,
    CASE WHEN flag_soil_moisture_50cm = 'VALID' THEN soil_moisture_50cm END AS d50 FROM qc WHERE NOT quarantined), """ + theta_ctes(
    "u", [5, 10, 50], "ds") + """, dv AS (SELECT ds.*, (fc - theta) / (fc - wp) AS dr, lag(theta) OVER w AS pt, lag(d5) OVER w AS p5, lag(d10) OVER w AS p10,
    lag(d50) OVER w AS p50 FROM ds JOIN sites USING (source_id) WHERE is_valid WINDOW w AS (PARTITION BY source_id ORDER BY step)),
  dd AS (SELECT *, theta - pt AS delta, greatest(d5 - coalesce(p5, d5), d10 - coalesce(p10, d10)) AS shallow, d50 - coalesce(p50, d50) AS deep FROM dv),
  ca AS (
    SELECT source_id, step, event_time, 0 AS ord, 'DATA_QUALITY_ALERT' AS category, 'CRITICAL' AS severity,
      CASE WHEN any_stuck THEN 'SENSOR_STUCK_VALUE' ELSE 'SENSOR_OUT_OF_RANGE' END AS threshold_type, trigger_value AS predicted_value FROM qc WHERE quarantined
    UNION ALL SELECT source_id, step, event_time, 1, 'PHYSICAL_DEVIATION', 'WARNING', 'MASS_BALANCE_RESIDUAL', abs(delta) FROM dd WHERE abs(delta) > 0.020::DOUBLE
    UNION ALL SELECT source_id, step, event_time, 2, 'PHYSICAL_DEVIATION', 'WARNING', 'MASS_BALANCE_RESIDUAL', abs(delta) FROM dd WHERE delta < -0.025::DOUBLE AND theta < 0.45::DOUBLE
    UNION ALL SELECT source_id, step, event_time, 3, 'PHYSICAL_DEVIATION', 'INFO', 'MASS_BALANCE_RESIDUAL', delta FROM dd WHERE delta > 0.015::DOUBLE AND precip_mm <= 0.2::DOUBLE
    UNION ALL SELECT source_id, step, event_time, 4, 'PHYSICAL_DEVIATION', 'INFO', 'MASS_BALANCE_RESIDUAL', deep FROM dd WHERE pt IS NOT NULL AND deep > 0.015::DOUBLE AND shallow < 0.005::DOUBLE
    UNION ALL SELECT source_id, step, event_time, 10, 'AGRONOMIC_RISK', CASE WHEN dr >= 0.85::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END,
      CASE WHEN dr >= 0.85::DOUBLE THEN 'CRITICAL_WILTING_PROXIMITY' ELSE 'MANAGEMENT_ALLOWABLE_DEPLETION' END, dr FROM dd WHERE dr >= 0.5::DOUBLE)"""

RUNS = DECISION + """, ts AS (SELECT DISTINCT source_id, category, threshold_type, step FROM ca),
  il AS (SELECT *, step - row_number() OVER (PARTITION BY source_id, category, threshold_type ORDER BY step) AS grp FROM ts),
  cs AS (SELECT ca.*, sum((severity <> 'CRITICAL')::INT) OVER (PARTITION BY source_id, category, threshold_type, grp ORDER BY step, ord) AS seen
    FROM ca JOIN il USING (source_id, category, threshold_type, step))"""

EARLY = DECISION + ", rx AS (SELECT source_id, step, event_time, dr AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY source_id) AS n FROM dv WINDOW w AS (PARTITION BY source_id ORDER BY step))" + """,
  rs AS (SELECT *, CASE WHEN i <= floor(n * 0.5) THEN 'train' ELSE 'test' END AS split, (CASE WHEN i <= floor(n * 0.5) THEN i ELSE i - floor(n * 0.5) END)::BIGINT AS rn FROM rx), """ + pairs("rs") + f""",
  un AS (SELECT source_id, horizon, round(e, 12) AS v, 1 AS known, NULL AS step, NULL AS y FROM pr WHERE split = 'train'
    UNION ALL SELECT source_id, h.horizon, round(0.5::DOUBLE - y, 12), 0, step, y FROM rs CROSS JOIN {H_LIST} h WHERE split = 'test'),
  ex AS (SELECT source_id, step, horizon, y, CASE WHEN total > 0 THEN above / total::DOUBLE WHEN y >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM (SELECT *,
    sum(known) OVER (PARTITION BY source_id, horizon ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above, sum(known) OVER (PARTITION BY source_id, horizon) AS total FROM un) WHERE known = 0),
  qq AS (SELECT source_id, horizon, quantile_cont(e, 0.1) AS q10, quantile_cont(e, 0.9) AS q90 FROM pr WHERE split = 'train' GROUP BY ALL),
  iv AS (SELECT ex.*, CASE WHEN q10 IS NOT NULL THEN greatest(-0.5::DOUBLE, least(1.5::DOUBLE, y + q10)) END AS lo, CASE WHEN q90 IS NOT NULL THEN greatest(-0.5::DOUBLE, least(1.5::DOUBLE, y + q90)) END AS hi
    FROM ex LEFT JOIN qq USING (source_id, horizon)),
  ce AS (SELECT *, CASE WHEN lo IS NULL THEN (CASE WHEN p < 0.2 THEN 'DEFINITELY_NOT_REACHED' WHEN p < 0.7 THEN 'PLAUSIBLY_REACHED' ELSE 'LIKELY_REACHED' END)
    WHEN horizon > 48 AND ((lo <= 0.5 AND 0.5 <= hi) OR y >= 0.5) THEN 'HIGHLY_UNCERTAIN' WHEN hi < 0.5 THEN 'DEFINITELY_NOT_REACHED'
    WHEN y < 0.5 AND 0.5 <= hi THEN 'PLAUSIBLY_REACHED' ELSE 'LIKELY_REACHED' END AS certainty FROM iv),
  er AS (SELECT source_id, step, min(horizon) AS horizon, arg_min(p, horizon) AS p FROM ce WHERE y < 0.5 AND (p >= 0.7::DOUBLE OR (certainty IN ('LIKELY_REACHED', 'PLAUSIBLY_REACHED') AND y >= 0.5::DOUBLE * 0.95::DOUBLE)) GROUP BY ALL),
  cb AS (SELECT *, CASE WHEN ord = 1 THEN 1 END AS horizon, NULL::DOUBLE AS exceedance FROM ca
    UNION ALL SELECT source_id, step, event_time, 10, 'AGRONOMIC_RISK', 'WARNING', 'MANAGEMENT_ALLOWABLE_DEPLETION', dr, er.horizon, round(er.p, 4) FROM dd JOIN er USING (source_id, step) WHERE dr < 0.5)"""

EARLY_RUNS = EARLY + RUNS[len(DECISION):].replace(" FROM ca)", " FROM cb)").replace("SELECT ca.*", "SELECT cb.*").replace("FROM ca JOIN", "FROM cb JOIN")

N_OF_M = DECISION + """, ts AS (SELECT DISTINCT source_id, category, threshold_type, step FROM ca),
  sp AS (SELECT source_id, category, threshold_type, min(step) AS a, max(step) AS b FROM ts GROUP BY ALL),
  gr AS (SELECT source_id, category, threshold_type, unnest(generate_series(a, b)) AS step FROM sp),
  en AS (SELECT source_id, category, threshold_type, step, -1 AS ord, 0 AS hit FROM gr ANTI JOIN ts USING (source_id, category, threshold_type, step)
    UNION ALL SELECT source_id, category, threshold_type, step, ord, 1 FROM ca WHERE severity <> 'CRITICAL'),
  rw AS (SELECT *, sum(hit) OVER (PARTITION BY source_id, category, threshold_type ORDER BY step, ord ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS seen FROM en),
  nm AS (SELECT ca.*, coalesce(rw.seen, 0) AS seen FROM ca LEFT JOIN rw USING (source_id, category, threshold_type, step, ord))"""


def episodes(gap: int) -> str:
    return DECISION + f""", eg AS (SELECT *, CASE WHEN step - lag(step) OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM ca
      WINDOW w AS (PARTITION BY source_id, category, threshold_type ORDER BY step, ord)),
      ei AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, category, threshold_type ORDER BY step, ord) AS episode FROM eg),
      ep AS (SELECT source_id, category, threshold_type, episode, min(step) AS start_step, max(step) AS end_step, min(event_time) AS start_time,
        max(event_time) AS end_time, max(step) - min(step) + 1 AS duration_steps, count(*) AS alert_count,
        array_to_string(list_sort(list(DISTINCT severity)), ',') AS severities FROM ei GROUP BY ALL)"""


DRAW = "('0x' || substr(md5(concat_ws('|', {}, '42')), 1, 8))::BIGINT::DOUBLE / 4294967296.0"
HOURLY = """eh AS (SELECT event_type AS source_id, date_trunc('hour', ts)::TIMESTAMP AS event_time, avg(value) AS value, count(*) AS readings FROM events GROUP BY ALL)"""
KEYS = "source_id, category, threshold_type"
STATUS = "CASE WHEN severity = 'CRITICAL' OR seen >= {} THEN 'CONFIRMED' ELSE 'PENDING_CONFIRMATION' END AS status"


def _stats(table: str, columns: list[str]) -> str:
    one = "SELECT source_id, '{0}' AS variable, count({0}) AS non_null, count(*) - count({0}) AS nulls, round((count(*) - count({0})) * 100.0::DOUBLE / count(*), 6) AS null_pct, " \
          "round(min({0}), 6) AS min_value, round(max({0}), 6) AS max_value, round(avg({0}), 6) AS mean_value, CASE WHEN count({0}) > 0 THEN round(coalesce(stddev_samp({0}), 0.0), 6) END AS std_value FROM {1} GROUP BY source_id"
    return " UNION ALL ".join(one.format(c, table) for c in columns)


def _loss() -> str:
    rates = ["0.0", "0.05", "0.1", "0.2", "0.35", "0.5"]
    keep = " UNION ALL ".join(
        f"SELECT *, {x}::DOUBLE AS loss FROM rd WHERE {DRAW.format(f'l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, {chr(39)}{float(x):.2f}{chr(39)}')} >= {x}::DOUBLE"
        for x in rates)
    return f"""WITH {RD}, lo AS ({keep}), {qc_ctes('lo', 'source_id, loss')},
      u AS (SELECT *, CASE WHEN flag_soil_moisture_5cm = 'VALID' THEN soil_moisture_5cm END AS d5, CASE WHEN flag_soil_moisture_10cm = 'VALID' THEN soil_moisture_10cm END AS d10,
        CASE WHEN flag_soil_moisture_50cm = 'VALID' THEN soil_moisture_50cm END AS d50 FROM qc), {theta_ctes('u', [5, 10, 50], 'ds')},
      gd AS (SELECT *, NOT quarantined AND is_valid AS good FROM ds),
      tr AS (SELECT source_id, {ORDER}, max(theta) AS truth FROM gd WHERE good AND loss = 0 GROUP BY ALL)
      SELECT loss, count(*) AS received, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (good) AS states,
        round(coalesce(avg(CASE WHEN good THEN abs(theta - truth) END), 0.0), 6) AS state_mae
      FROM gd LEFT JOIN tr USING (source_id, {ORDER}) GROUP BY loss"""


EXCEED = FPAIRS.replace("theta AS y FROM ix", "(0.32::DOUBLE - theta) / (0.32::DOUBLE - 0.14::DOUBLE) AS y FROM ix") + f""", qs AS (SELECT source_id, rn, h.horizon, y, round(0.5::DOUBLE - y, 12) AS gap FROM fx CROSS JOIN {H_LIST} h WHERE split = 'test'),
  un AS (SELECT source_id, horizon, round(e, 12) AS v, 1 AS known, NULL AS rn, NULL AS y FROM pr WHERE split = 'train' UNION ALL SELECT source_id, horizon, gap, 0, rn, y FROM qs),
  ex AS (SELECT source_id, rn, horizon, y, above / total::DOUBLE AS p FROM (SELECT *, sum(known) OVER (PARTITION BY source_id, horizon ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above,
    sum(known) OVER (PARTITION BY source_id, horizon) AS total FROM un) WHERE known = 0 AND total > 0),
  qq AS (SELECT source_id, horizon, quantile_cont(e, 0.1) AS q10, quantile_cont(e, 0.9) AS q90 FROM pr WHERE split = 'train' GROUP BY ALL),
  er AS (SELECT ex.*, greatest(-0.5::DOUBLE, least(1.5::DOUBLE, y + q10)) AS lo, greatest(-0.5::DOUBLE, least(1.5::DOUBLE, y + q90)) AS hi FROM ex JOIN qq USING (source_id, horizon)),
  ce AS (SELECT *, CASE WHEN horizon > 48 AND ((lo <= 0.5 AND 0.5 <= hi) OR y >= 0.5) THEN 'HIGHLY_UNCERTAIN' WHEN hi < 0.5 THEN 'DEFINITELY_NOT_REACHED'
    WHEN y < 0.5 AND 0.5 <= hi THEN 'PLAUSIBLY_REACHED' ELSE 'LIKELY_REACHED' END AS certainty FROM er)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "walk_forward_persistence": walk_forward("horizon"),
        "walk_forward_by_source": walk_forward("source_id, horizon"),
        "root_zone_state": f"""WITH {STATES}, {SITES} SELECT source_id, event_time, {r('theta', 'theta_rz')}, {r('(fc - theta) / (fc - wp)', 'depletion_fraction')},
          {r('1 - (fc - theta) / (fc - wp)', 'available_water_fraction')}, {r('10.0 * 100.0 * theta', 'storage_mm')}, {r('10.0 * 100.0 * greatest(0, fc - theta)', 'deficit_mm')},
          {r('wf', 'weight_fraction')}, is_valid FROM st JOIN sites USING (source_id) WHERE theta IS NOT NULL""",
        "topsoil_series": f"WITH {STATES} SELECT source_id, event_time, {r('coalesce(d10, theta)', 'theta_10')} FROM st WHERE is_valid",
        "site_parameters": f"WITH {SITES} SELECT source_id, round(fc, 6) AS theta_fc, round(wp, 6) AS theta_wp, {r('10.0 * 100.0 * (fc - wp)', 'taw_mm')}, {r('fc - 0.5 * (fc - wp)', 'theta_mad')}, 0 AS broken_rules FROM sites",
        "audit_coverage": f"""WITH {HOURLY} SELECT source_id, min(event_time) AS start_time, max(event_time) AS end_time, count(*) AS records,
          count(*) - count(DISTINCT event_time) AS duplicate_timestamps, (epoch(max(event_time)) - epoch(min(event_time)))::BIGINT // 3600 + 1 AS expected_steps,
          (epoch(max(event_time)) - epoch(min(event_time)))::BIGINT // 3600 + 1 - count(DISTINCT event_time) AS missing_steps FROM eh GROUP BY source_id""",
        "audit_missing_steps": f"""WITH {HOURLY}, b AS (SELECT source_id, min(event_time) AS a, max(event_time) AS z FROM eh GROUP BY ALL),
          g AS (SELECT source_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS event_time FROM b) SELECT source_id, event_time FROM g ANTI JOIN eh USING (source_id, event_time)""",
        "audit_variable_stats": f"WITH {RD} {_stats('rd', QC_COLUMNS)}",
        "audit_completeness": f"""WITH {RD}, lg AS ({' UNION ALL '.join(f"SELECT source_id, '{c}' AS variable, {c} AS value FROM rd" for c in QC_COLUMNS)})
          SELECT source_id, variable, round(count(value) * 100.0::DOUBLE / count(*), 6) AS present_pct FROM lg GROUP BY GROUPING SETS ((source_id), (source_id, variable))""",
        "store_counts": f"WITH {QC} SELECT 'events' AS \"table\", count(*) AS rows, count(*) FILTER (quarantined) AS quarantined FROM qc UNION ALL SELECT 'readings', count(*) * 6, 0 FROM qc",
        "site_status": f"""WITH {SPLIT_ALL}, k AS (SELECT source_id, count(*) AS ingested FROM ss GROUP BY ALL), l AS (SELECT *, (0.32::DOUBLE - theta) / (0.32::DOUBLE - 0.14::DOUBLE) AS dr FROM ix WHERE step = n_all),
          w AS (SELECT source_id, count(*) AS recent_states, avg(theta) AS rt FROM ix WHERE step > n_all - 48 GROUP BY ALL)
          SELECT l.source_id, l.event_time, {r('l.theta', 'theta_rz')}, {r('dr', 'depletion_fraction')}, recent_states, {r('rt', 'recent_theta')}, ingested FROM l JOIN w USING (source_id) JOIN k USING (source_id)""",
        "qc_flags_wide": f"WITH {QC_LONG} SELECT source_id, sensor_id, qc_flag, count(*) AS readings, {r('sum(value)', 'total')} FROM ql GROUP BY ALL",
        "qc_flags_long": f"WITH {QC_LONG} SELECT source_id, sensor_id, qc_flag, count(*) AS readings, {r('sum(value)', 'total')} FROM ql GROUP BY ALL",
        "qc_event_summary": f"WITH {QC} SELECT source_id, step AS event_rn, flag_count, quarantined, flag_count = 0 AS all_valid, {reason_sql()} AS failure_reason FROM qc",
        "qc_quarantine_alerts": f"""WITH {QC} SELECT source_id, step AS event_rn, 'DATA_QUALITY_ALERT' AS category, 'CRITICAL' AS severity, CASE WHEN any_stuck THEN 'SENSOR_STUCK_VALUE' ELSE 'SENSOR_OUT_OF_RANGE' END AS threshold_type,
          {r('trigger_value', 'threshold_value')}, trigger_unit AS threshold_unit, {reason_sql()} AS reason FROM qc WHERE quarantined""",
        "normalise_long": f"WITH {QC_LONG} SELECT sensor_id, CASE WHEN value IS NULL THEN 'MISSING' ELSE 'VALID' END AS qc_flag, count(*) AS readings, {r('sum(value)', 'total')} FROM ql GROUP BY ALL",
        "natural_keys": "SELECT event_id, sha256(concat_ws('|', user_id::VARCHAR, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'OBSERVED', '1.0.0')) AS natural_key, sha256(concat_ws(':', user_id::VARCHAR, 'FIELD_DEFAULT', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'))) AS ingress_key FROM events",
        "dedup_first": "SELECT user_id AS source_id, event_type AS sensor_id, event_time, event_id, round(value, 6) AS value FROM (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS event_time, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
        "events_json_decode": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
        "device_packets": """SELECT device_id, count(*) FILTER (reason IS NULL) AS good, count(*) FILTER (reason = 'device_id, timestamp_utc or sensors object is missing') AS incomplete,
          count(*) FILTER (reason = 'no sensor reading in the packet') AS empty, sum(CASE WHEN reason IS NULL THEN has_vwc + has_rain END)::BIGINT AS readings, round(sum(CASE WHEN reason IS NULL THEN vwc END), 6) AS total_vwc
          FROM (SELECT user_id AS device_id, (event_type <> 'signup')::INT AS has_vwc, (event_type = 'purchase')::INT AS has_rain, CASE WHEN event_type <> 'signup' AND event_type <> 'error' THEN value / 1000 END AS vwc,
            CASE WHEN event_id % 11 = 0 THEN 'device_id, timestamp_utc or sensors object is missing' WHEN event_type = 'signup' THEN 'no sensor reading in the packet' END AS reason FROM events) GROUP BY device_id""",
        "contract_report": """SELECT violation, count(*) AS events FROM (SELECT unnest(list_filter([
            CASE WHEN event_type = 'signup' THEN '[root] ''site_id'' is required' END,
            CASE WHEN event_type = 'error' THEN '[root] unknown field' END,
            CASE WHEN event_id % 7 = 0 THEN '[schema_version] is not a version' END,
            CASE WHEN event_type = 'click' THEN '[provenance.data_class] is not allowed' END,
            CASE WHEN event_id % 5 = 0 THEN '[provenance] ''network'' is required' END,
            CASE WHEN event_id % 13 = 0 THEN '[provenance] unknown field' END,
            CASE WHEN value > 100 THEN '[measurements.depth_cm] is negative' END], lambda x: x IS NOT NULL)) AS violation FROM events) GROUP BY violation""",
        "features_causal": f"WITH {FEATURES_ALL} SELECT source_id, split, rn, {', '.join(r(f, f) for f in ARX)}, regime FROM fx",
        "regime_counts": f"WITH {FEATURES_ALL} SELECT source_id, split, regime, count(*) AS rows, {r('sum(rain_72)', 'rain_72')} FROM fx GROUP BY ALL",
        "oracle_future_rain": f"WITH {FEATURES_ALL} SELECT source_id, split, rn, " + ", ".join(
            f"round(sum(rain) OVER (PARTITION BY source_id, split ORDER BY rn ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING), 6) AS oracle_rain_{h}" for h in HORIZONS) + " FROM fx",
        "weather_aligned": """WITH s AS (SELECT user_id AS source_id, date_trunc('hour', ts)::TIMESTAMP AS event_time, event_id FROM events WHERE event_type <> 'view'),
          w AS (SELECT user_id AS source_id, date_trunc('hour', ts)::TIMESTAMP AS event_time, arg_min(value, (ts, event_id)) AS rain FROM events WHERE event_type = 'view' GROUP BY ALL)
          SELECT source_id, event_time, event_id, round(rain, 6) AS rain FROM s LEFT JOIN w USING (source_id, event_time)""",
        "forecast_persistence": f"""WITH {PAIRS}, q AS (SELECT source_id, horizon, quantile_cont(e, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM pr WHERE split = 'train' GROUP BY ALL)
          SELECT source_id, step, horizon, event_time + to_hours(horizon) AS valid_time, CASE WHEN horizon <= 48 THEN 'SUPPORTED' ELSE 'RESEARCH' END AS support, {r('y', 'point')}, """ + ", ".join(
            r(CLIP.format(f"y + q[{i}]"), n) for i, n in enumerate(("q10", "q25", "q50", "q75", "q90"), 1)) + " FROM se JOIN q USING (source_id) WHERE split = 'test'",
        "skipped_series": """SELECT user_id AS source_id, count(*) AS readings, 'fewer than 218 readings' AS reason FROM events GROUP BY user_id HAVING count(*) < 218""",
        "run_summary": f"""SELECT 'RUN-CHECK' AS run_id, total_records, quarantined, mae AS mae_24, rmse AS rmse_24, skill_vs_mean AS skill_vs_mean_24, coverage AS coverage_24
          FROM (WITH {QC} SELECT count(*) AS total_records, count(*) FILTER (quarantined) AS quarantined FROM qc), ({walk_forward('horizon')}) WHERE horizon = 24""",
        "forecast_events": f"""WITH {SPLIT} SELECT sha256(concat_ws('|', source_id::VARCHAR, event_time::VARCHAR, rn::VARCHAR, 'PERSISTENCE_BASELINE')) AS forecast_id, source_id,
          event_time AS origin_time, 'volumetric_water_content' AS target_variable, 7 AS horizons, round(y::VARCHAR::DECIMAL(38,20), 4)::DOUBLE AS point FROM se WHERE split = 'test'""",
        "fallback_routing": f"""WITH {FEATURES} SELECT source_id, source_id % 7 = 0 AS used_fallback, count(*) AS forecasts,
          {r('avg(CASE WHEN source_id % 7 = 0 THEN lag_0 ELSE 0.5::DOUBLE * lag_0 + 0.5::DOUBLE * lag_24 END)', 'mean_point')} FROM fx WHERE split = 'test' GROUP BY ALL""",
        "forecast_mean_expanding": f"WITH {SPLIT_ALL} SELECT source_id, split, rn, {r(CLIP.format('avg(y) OVER (PARTITION BY source_id, split ORDER BY rn)'), 'point')} FROM se",
        "forecast_ewma": f"""WITH {SPLIT_ALL}, l AS (SELECT source_id, split, rn, list(y) OVER (PARTITION BY source_id, split ORDER BY rn) AS ys FROM se)
          SELECT source_id, split, rn, {r(CLIP.format('list_reduce(ys, lambda a, x: 0.2::DOUBLE * x + 0.8::DOUBLE * a)'), 'point')} FROM l""",
        "ridge_gram_ar": gram(AR),
        "ridge_gram_arx": gram(ARX),
        "residual_quantiles": f"""WITH {PAIRS} SELECT source_id, horizon, count(*) AS samples, {r('avg(e)', 'mean')}, {r('stddev_pop(e)', 'std')}, """ + ", ".join(
            r(f"quantile_cont(e, {p})", n) for n, p in (("q10", 0.1), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9))) + " FROM pr WHERE split = 'train' GROUP BY ALL",
        "interval_u0_static": f"WITH {INTERVALS} SELECT source_id, horizon, {r('lo_80', 'lo_80')}, {r('hi_80', 'hi_80')}, {r('lo_90', 'lo_90')}, {r('hi_90', 'hi_90')} FROM u0",
        "interval_u1_mad": f"WITH {INTERVALS} SELECT source_id, horizon, {r('bias', 'bias')}, {r('scale', 'scale')} FROM u1",
        "interval_u2_regime": f"WITH {INTERVALS} SELECT source_id, horizon, regime, {r('lo_80', 'lo_80')}, {r('hi_80', 'hi_80')} FROM u2 UNION ALL SELECT source_id, horizon, 'ALL', {r('lo_80', 'lo_80')}, {r('hi_80', 'hi_80')} FROM u0",
        "interval_u3_power": f"WITH {INTERVALS} SELECT source_id, {r('sigma_1', 'sigma_1')}, {r('nu', 'nu')} FROM u3",
        "interval_benchmark": _bench(),
        "exceedance_probability": f"WITH {EXCEED} SELECT source_id, rn, horizon, {r('p', 'exceedance')} FROM ex",
        "risk_certainty": f"WITH {EXCEED} SELECT horizon, certainty, count(*) AS origins FROM ce GROUP BY ALL",
        "early_risk": f"""WITH {EXCEED}, hit AS (SELECT * FROM ce WHERE y < 0.5 AND (p >= 0.7 OR (certainty IN ('LIKELY_REACHED', 'PLAUSIBLY_REACHED') AND y >= 0.5::DOUBLE * 0.95::DOUBLE)))
          SELECT source_id, rn, min(horizon) AS horizon, round(arg_min(p, horizon), 6) AS exceedance, arg_min(certainty, horizon) AS certainty FROM hit GROUP BY ALL""",
        "baseline_risk": f"WITH {EXCEED} SELECT source_id, rn, min(horizon) AS horizon, round(arg_min(p, horizon), 6) AS exceedance FROM ex WHERE y < 0.5 AND p >= 0.75 GROUP BY ALL",
        "physical_deviations": f"WITH {DECISION} SELECT source_id, step, ord, severity, threshold_type, round(predicted_value, 4) AS predicted_value FROM ca WHERE category = 'PHYSICAL_DEVIATION'",
        "decision_candidates": f"WITH {DECISION} SELECT source_id, step, event_time, ord, category, severity, threshold_type, round(predicted_value, 4) AS predicted_value FROM ca",
        "alerts_consecutive": f"WITH {RUNS} SELECT {KEYS}, step, ord, severity, seen::BIGINT AS seen, {STATUS.format(2)} FROM cs",
        "alerts_n_of_m": f"WITH {N_OF_M} SELECT {KEYS}, step, ord, severity, (CASE WHEN severity = 'CRITICAL' THEN 0 ELSE seen END)::BIGINT AS seen, {STATUS.format(3)} FROM nm",
        "suppression_table": f"""WITH {RUNS}, {N_OF_M.replace(DECISION + ', ', '').replace('ts AS', 'ts2 AS').replace(' ts ', ' ts2 ').replace('FROM ts GROUP', 'FROM ts2 GROUP')},
          f AS (SELECT 'raw' AS "filter", count(*) AS emitted FROM ca UNION ALL SELECT 'k2', count(*) FROM cs WHERE severity = 'CRITICAL' OR seen >= 2
            UNION ALL SELECT 'k3', count(*) FROM cs WHERE severity = 'CRITICAL' OR seen >= 3 UNION ALL SELECT '3_of_5', count(*) FROM nm WHERE severity = 'CRITICAL' OR seen >= 3)
          SELECT (SELECT count(*) FROM ca) AS candidates, "filter", emitted, round(((SELECT count(*) FROM ca) - emitted) * 100.0::DOUBLE / (SELECT count(*) FROM ca), 6) AS suppressed_pct FROM f""",
        "decision_cycle": f"""WITH {RUNS}, cf AS (SELECT source_id, step, bool_or(category = 'AGRONOMIC_RISK') AS risk, bool_or(category = 'PHYSICAL_DEVIATION') AS dev, count(*) AS confirmed FROM cs WHERE severity = 'CRITICAL' OR seen >= 2 GROUP BY ALL)
          SELECT source_id, step, event_time, quarantined, coalesce(confirmed, 0) AS confirmed, CASE WHEN quarantined THEN 'DATA_QUALITY_ANOMALY' WHEN risk THEN 'OPERATIONAL_WATER_RISK' WHEN dev THEN 'PHYSICAL_DEVIATION' ELSE 'NORMAL_OPERATION' END AS classification
          FROM qc LEFT JOIN cf USING (source_id, step)""",
        "decision_cycle_forecast": f"""WITH {EARLY_RUNS}, cf AS (SELECT source_id, step, bool_or(category = 'AGRONOMIC_RISK') AS risk, bool_or(category = 'PHYSICAL_DEVIATION') AS dev, count(*) AS confirmed FROM cs WHERE severity = 'CRITICAL' OR seen >= 2 GROUP BY ALL)
          SELECT source_id, step, event_time, quarantined, coalesce(confirmed, 0) AS confirmed, CASE WHEN quarantined THEN 'DATA_QUALITY_ANOMALY' WHEN risk THEN 'OPERATIONAL_WATER_RISK' WHEN dev THEN 'PHYSICAL_DEVIATION' ELSE 'NORMAL_OPERATION' END AS classification
          FROM qc LEFT JOIN cf USING (source_id, step)""",
        "alerts_forecast": f"WITH {EARLY_RUNS} SELECT {KEYS}, step, ord, severity, seen::BIGINT AS seen, {STATUS.format(2)}, horizon, exceedance FROM cs",
        "operations_alerts": f"""WITH {EARLY_RUNS} SELECT count(*) AS ingested, count(*) FILTER (quarantined) AS quarantined, round(count(*) FILTER (quarantined) * 100.0::DOUBLE / count(*), 6) AS quarantined_pct,
          (SELECT count(*) FROM cs) AS alerts, (SELECT count(*) FROM cs WHERE severity = 'INFO') AS alerts_info, (SELECT count(*) FROM cs WHERE severity = 'WARNING') AS alerts_warning,
          (SELECT count(*) FROM cs WHERE severity = 'CRITICAL') AS alerts_critical FROM qc""",
        "early_risk_baseline": f"WITH {EXCEED} SELECT source_id, rn, min(horizon) AS horizon, round(arg_min(p, horizon), 6) AS exceedance FROM ex WHERE y < 0.5 AND p >= 0.2::DOUBLE GROUP BY ALL",
        "episodes_site": f"""WITH {DECISION}, hr AS (SELECT source_id, event_time, count(*) AS k FROM ca GROUP BY ALL),
          fr AS (SELECT *, CASE WHEN epoch(event_time) - lag(epoch(event_time)) OVER (PARTITION BY source_id ORDER BY event_time) <= 21600 THEN 0 ELSE 1 END AS fresh FROM hr)
          SELECT source_id, sum(k)::BIGINT AS raw_alerts, count(*) AS alert_hours, sum(fresh)::BIGINT AS episodes, round((1 - sum(fresh) / sum(k)::DOUBLE) * 100, 6) AS compression_pct FROM fr GROUP BY source_id""",
        "episodes_by_type": f"WITH {episodes(6)} SELECT source_id, category, threshold_type, episode::BIGINT AS episode, start_step, end_step, start_time, end_time, duration_steps, alert_count, severities FROM ep",
        "episode_summary": f"""WITH {episodes(1)} SELECT category, count(*) AS episodes, sum(alert_count)::BIGINT AS alerts, {r('avg(alert_count)', 'mean_alerts')}, max(alert_count) AS max_alerts, {r('avg(duration_steps)', 'mean_duration')},
          max(duration_steps) AS max_duration, round(quantile_cont(alert_count, 0.5), 6) AS median_alerts FROM ep GROUP BY category""",
        "top_episodes": f"WITH {episodes(6)} SELECT source_id, category, threshold_type, start_step, duration_steps, alert_count FROM ep ORDER BY duration_steps DESC, source_id, category, threshold_type, start_step LIMIT 8",
        "alert_cube": f"WITH {DECISION} SELECT coalesce(category, 'ALL') AS category, coalesce(severity, 'ALL') AS severity, count(*) AS alerts FROM ca GROUP BY CUBE (category, severity)",
        "alert_breakdown": f"WITH {DECISION}, b AS (SELECT unnest(['category', 'severity', 'threshold_type', 'horizon']) AS dimension, unnest([category, severity, threshold_type, CASE WHEN ord = 1 THEN '1' ELSE 'Real-Time' END]) AS value FROM ca) SELECT dimension, value, count(*) AS alerts FROM b GROUP BY ALL",
        "alert_schema_pass": f"WITH {DECISION} SELECT count(*) AS records, 1.0::DOUBLE AS pass_rate FROM ca",
        "seasonal_slices": f"""WITH {STATES}, sn AS (SELECT source_id, {ORDER}, theta, CASE WHEN month(event_time) IN (1, 2) THEN 'Winter (Jan-Feb)' WHEN month(event_time) IN (4, 5) THEN 'Spring (Apr-May)'
            WHEN month(event_time) IN (7, 8) THEN 'Summer (Jul-Aug)' WHEN month(event_time) IN (10, 11) THEN 'Fall (Oct-Nov)' END AS season, air AS soil FROM st WHERE is_valid),
          sr AS (SELECT *, lead(theta, 24) OVER (PARTITION BY source_id, season ORDER BY {ORDER}) - theta AS e, count(*) OVER (PARTITION BY source_id, season) AS n FROM sn WHERE season IS NOT NULL)
          SELECT source_id, season, count(*) AS samples, round(avg(CASE WHEN soil <= 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS frozen_pct, round(coalesce(avg(abs(e)), 0), 6) AS mae, round(coalesce(avg(e * e), 0), 6) AS mse FROM sr WHERE n >= 50 GROUP BY ALL""",
        "fault_injection": """SELECT sensor_id, qc_flag, synthetic_fault_type, count(*) AS readings, round(sum(v), 6) AS total FROM (
          SELECT sensor_id, k, CASE WHEN k = 'PACKET_DROP' THEN NULL WHEN k = 'NON_PHYSICAL_RANGE' THEN 1.85::DOUBLE WHEN k = 'VALUE_SPIKE' THEN value + 0.35::DOUBLE WHEN k = 'SENSOR_STUCK' THEN 0.2222::DOUBLE ELSE value END AS v,
            CASE WHEN k IS NULL THEN 'VALID' WHEN k = 'PACKET_DROP' THEN 'MISSING' ELSE 'SYNTHETIC_CORRUPTED' END AS qc_flag, k AS synthetic_fault_type FROM (
            SELECT event_type AS sensor_id, value, CASE WHEN event_type = 'view' AND i >= 8 AND i < 13 THEN 'PACKET_DROP' WHEN event_type = 'view' AND i >= 3 AND i < 10 THEN 'SENSOR_STUCK'
              WHEN event_type = 'click' AND i >= 5 AND i < 7 THEN 'NON_PHYSICAL_RANGE' WHEN event_type = 'error' AND i >= 20 AND i < 40 THEN 'VALUE_SPIKE' END AS k
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events))) GROUP BY ALL""",
        "packet_loss_table": _loss(),
        "resequence_inversions": f"""WITH o AS (SELECT user_id AS source_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
          d AS (SELECT *, {DRAW.format("source_id::VARCHAR, ((rn - 1) // 2)::VARCHAR")} < 0.2::DOUBLE AND NOT (rn = n AND n % 2 = 1) AS swapped FROM o),
          a AS (SELECT *, CASE WHEN swapped THEN CASE WHEN rn % 2 = 1 THEN rn + 1 ELSE rn - 1 END ELSE rn END AS arrival FROM d),
          i AS (SELECT source_id, swapped, ts > lead(ts) OVER (PARTITION BY source_id ORDER BY arrival) AS inv, ts > lead(ts) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS inv2 FROM a)
          SELECT source_id, count(*) AS packets, count(*) FILTER (swapped) // 2 AS swaps, count(*) FILTER (inv) AS inversions, count(*) FILTER (inv2) AS residual FROM i GROUP BY source_id""",
        "reproducibility_diff": f"WITH {SPLIT} SELECT count(*) * 7 AS rows, 0 AS unmatched, 0.0::DOUBLE AS max_diff_mae, 0.0::DOUBLE AS max_diff_rmse FROM (SELECT DISTINCT source_id FROM se)",
        "stream_dedup": "SELECT DISTINCT user_id AS source_id, event_type AS sensor_id, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events",
        "stream_hourly": "SELECT event_type AS source_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS readings, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
        "stream_sessions": """WITH f AS (SELECT user_id AS source_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          s AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY ts) AS k FROM f) SELECT source_id, min(ts) AS start_time, max(ts) + INTERVAL 6 HOUR AS end_time, count(*) AS alerts FROM s GROUP BY source_id, k""",
        "stream_resequence": "SELECT user_id AS source_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events",
        "stream_qc": f"WITH {QC_LONG} SELECT source_id, sensor_id, qc_flag, count(*) AS readings FROM ql GROUP BY ALL",
        "stream_worker": f"""WITH {RUNS}, k AS (SELECT source_id, step, concat_ws('-', lpad(l_orderkey::VARCHAR, 14, '0'), lpad(l_linenumber::VARCHAR, 14, '0'),
            lpad(l_partkey::VARCHAR, 14, '0')) AS shipment FROM qc)
          SELECT source_id, event_time, shipment, ord, category, severity, threshold_type, seen::BIGINT AS seen, round(predicted_value, 4) AS predicted_value
          FROM cs JOIN k USING (source_id, step) WHERE severity = 'CRITICAL' OR seen >= 2""",
        "stream_worker_quality": f"WITH {QC} SELECT source_id, quarantined, flag_soil_moisture_5cm AS qc_flag, count(*) AS events FROM qc GROUP BY ALL",
        "asof_weather": """WITH s AS (SELECT user_id AS source_id, ts AS event_time, event_id FROM events WHERE event_type <> 'view'),
          w AS (SELECT user_id AS source_id, ts, event_id AS weather_id, value AS rain FROM events WHERE event_type = 'view'),
          j AS (SELECT s.*, w.ts AS t, w.weather_id AS i, w.rain AS v FROM s ASOF LEFT JOIN w ON s.source_id = w.source_id AND s.event_time >= w.ts)
          SELECT source_id, event_time, event_id, CASE WHEN near THEN t END AS weather_time, round(CASE WHEN near THEN v END, 6) AS rain, CASE WHEN near THEN i END AS weather_id
          FROM (SELECT *, event_time - t <= INTERVAL 1 DAY AS near FROM j)""",
        "asof_nearest_weather": """WITH s AS (SELECT user_id AS source_id, ts AS event_time, event_id FROM events WHERE event_type <> 'view'),
          w AS (SELECT user_id AS source_id, ts, value FROM events WHERE event_type = 'view'),
          b AS (SELECT s.*, w.ts AS bt, w.value AS bv FROM s ASOF LEFT JOIN w ON s.source_id = w.source_id AND s.event_time >= w.ts),
          a AS (SELECT b.*, w.ts AS nt, w.value AS nv FROM b ASOF LEFT JOIN w ON b.source_id = w.source_id AND b.event_time <= w.ts)
          SELECT source_id, event_id, round(CASE WHEN bt IS NULL OR nt - event_time < event_time - bt THEN nv ELSE bv END, 6) AS rain FROM a""",
        "forecast_contract": f"""WITH {SPLIT}, v AS (SELECT source_id, round(y::VARCHAR::DECIMAL(38,20), 4) AS p, concat_ws('; ',
            CASE WHEN rn % 11 = 0 THEN '[predictions.quantiles] quantiles are not ordered' END, CASE WHEN rn % 7 = 0 THEN '[root] ''site_id'' is required' END) AS violations
            FROM se WHERE split = 'test')
          SELECT source_id, violations, 24 AS horizon, count(*) AS forecasts, sum(p)::DOUBLE AS points FROM v GROUP BY ALL""",
        "alert_json": f"""WITH {DECISION} SELECT source_id::VARCHAR AS source_id, category, threshold_type, category = 'AGRONOMIC_RISK' AS has_depletion,
          CASE WHEN ord = 1 THEN 1 END AS horizon, count(*) AS alerts, count(*) AS valid, sum(round(predicted_value::VARCHAR::DECIMAL(38,20), 4))::DOUBLE AS predicted, count(*) AS ids
          FROM ca GROUP BY ALL""",
        "stream_operations": f"""WITH {RUNS}, n AS (SELECT count(*) AS n, count(*) FILTER (quarantined) AS q FROM qc), f AS (SELECT * FROM cs WHERE severity = 'CRITICAL' OR seen >= 2)
          SELECT 'ingested' AS metric, NULL AS label, n::DOUBLE AS value FROM n UNION ALL SELECT 'quarantined', NULL, q::DOUBLE FROM n
          UNION ALL SELECT 'quarantined_pct', NULL, round(CASE WHEN n > 0 THEN q * 100.0::DOUBLE / n ELSE 0 END, 6) FROM n
          UNION ALL SELECT 'alerts_by_category', category, count(*)::DOUBLE FROM f GROUP BY category UNION ALL SELECT 'alerts_by_severity', severity, count(*)::DOUBLE FROM f GROUP BY severity
          UNION ALL SELECT 'latest_depletion', source_id::VARCHAR, {r('arg_max(dr, step)', 'value')} FROM dv GROUP BY source_id""",
        "latency_sketch": """WITH g AS (SELECT ln(1.01::DOUBLE / 0.99::DOUBLE) AS lg, 1.01::DOUBLE / 0.99::DOUBLE AS g),
          q AS (SELECT event_type AS sensor_id, count(*) AS samples, quantile_disc(value, [0.5, 0.9, 0.95, 0.99]) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
          SELECT sensor_id, samples, """ + ", ".join(
            r(f"CASE WHEN v[{i}] <= 0 THEN 0 ELSE 2.0::DOUBLE / (g + 1.0::DOUBLE) * pow(g, ceil(ln(v[{i}]) / lg)) END", n) for i, n in enumerate(("p50", "p90", "p95", "p99"), 1)) + " FROM q, g",
        "station_status": f"""WITH {RUNS}, ix AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY step DESC) AS back FROM dv),
          w AS (SELECT source_id, count(*) AS recent_states, avg(theta) AS rt FROM ix WHERE back <= 48 GROUP BY ALL), l AS (SELECT * FROM ix WHERE back = 1),
          f AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END AS k FROM cs WHERE severity = 'CRITICAL' OR seen >= 2),
          t AS (SELECT source_id, count(*) AS alerts, arg_max({{'s': severity, 't': threshold_type, 'e': event_time}}, (k, event_time, -ord)) AS top FROM f GROUP BY ALL)
          SELECT l.source_id, l.event_time, {r('l.theta', 'theta_rz')}, {r('l.dr', 'depletion_fraction')}, recent_states, {r('rt', 'recent_theta')}, l.event_time AS forecast_origin,
            {r('l.theta', 'point_168')}, 7 AS horizons, coalesce(alerts, 0) AS alerts, top.s AS top_severity, top.t AS top_type, top.e AS top_time
          FROM l JOIN w USING (source_id) LEFT JOIN t USING (source_id)""",
        "stream_replay": "SELECT event_id % 4 AS batch, event_type AS sensor_id, count(*) AS events, round(sum(value::DECIMAL(20,6))::DOUBLE, 6) AS total FROM events WHERE event_id % 4 IN (1, 2) GROUP BY ALL",
        "stream_rain_24h": """SELECT source_id, until, round(sum(value), 6) AS rain_mm FROM (SELECT event_type AS source_id, value,
            unnest(generate_series(date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until FROM events) GROUP BY ALL""",
        "alert_key_status": f"""WITH {RUNS}, st AS (SELECT *, {STATUS.format(2)} FROM cs), k AS (SELECT {KEYS}, arg_max(status, (step, ord)) AS s, max(step) AS last_alert_step FROM st GROUP BY ALL),
          l AS (SELECT source_id, max(step) AS last_step FROM qc GROUP BY ALL)
          SELECT {KEYS}, last_alert_step, CASE WHEN s = 'CONFIRMED' AND last_alert_step < last_step THEN 'RESOLVED' ELSE s END AS status FROM k JOIN l USING (source_id)""",
        "alert_filter_stats": f"WITH {RUNS}, st AS (SELECT {STATUS.format(2)} FROM cs) SELECT count(*) AS candidates, count(*) FILTER (status <> 'CONFIRMED') AS suppressed, count(*) FILTER (status = 'CONFIRMED') AS emitted FROM st",
        "assessment_classes": f"""WITH {DECISION} SELECT CASE category WHEN 'DATA_QUALITY_ALERT' THEN 'DATA_QUALITY_ANOMALY' WHEN 'AGRONOMIC_RISK' THEN 'OPERATIONAL_WATER_RISK' ELSE category END AS classification,
          category = 'DATA_QUALITY_ALERT' AS is_quarantined, true AS requires_operator_review, count(*) AS assessments, count(*) AS with_reason FROM ca GROUP BY ALL""",
        "alert_cross_table": f"""WITH {DECISION} SELECT threshold_type, """ + ", ".join(
            f"""nullif(count(*) FILTER (severity = '{x}'), 0) AS "{x}" """ for x in ("INFO", "WARNING", "CRITICAL")) + " FROM ca GROUP BY threshold_type",
        "targets_by_time": f"WITH {HOURLY} SELECT e.source_id, e.event_time, round(e.value, 6) AS value, " + ", ".join(f"round(t{h}.value, 6) AS y_{h}" for h in HORIZONS) + " FROM eh e " + " ".join(
            f"LEFT JOIN eh t{h} ON t{h}.source_id = e.source_id AND t{h}.event_time = e.event_time + to_hours({h})" for h in HORIZONS),
        "forecast_targets": f"""WITH {STATES}, {SITES}, v AS (SELECT source_id, theta, (fc - theta) / (fc - wp) AS dr FROM st JOIN sites USING (source_id) WHERE is_valid),
          u AS (SELECT source_id, unnest(['volumetric_water_content', 'root_zone_depletion_fraction', 'root_zone_storage_mm', 'fraction_of_available_water']) AS target,
            unnest(['m3/m3', 'fraction', 'mm', 'fraction']) AS unit, unnest([theta, dr, 10.0::DOUBLE * 100.0::DOUBLE * theta, 1.0::DOUBLE - dr]) AS y FROM v)
          SELECT source_id, target, unit, count(*) AS rows, {r('avg(y)', 'mean_y')}, {r('min(y)', 'least')}, {r('max(y)', 'most')} FROM u GROUP BY ALL""",
        "latest_reading": """SELECT user_id::VARCHAR || '/' || event_type AS station, max(ts) AS event_time, arg_max(event_id, (ts, event_id, value)) AS event_id, round(arg_max(value, (ts, event_id, value)), 6) AS value
          FROM events GROUP BY ALL""",
        "experiment_manifest": f"""WITH {SPLIT}, s AS ({walk_forward('source_id, horizon').replace('SELECT s.source_id, s.horizon', 'SELECT s.source_id AS source_id, s.horizon AS horizon')}),
          w AS (SELECT source_id, count(*) FILTER (split = 'train') AS train_rows, max(event_time) FILTER (split = 'train') AS train_end, count(*) FILTER (split = 'test') AS test_rows,
            min(event_time) FILTER (split = 'test') AS test_start FROM se GROUP BY ALL)
          SELECT sha256(concat_ws('|', 'RUN-CHECK', w.source_id::VARCHAR)) AS manifest_id, w.source_id, train_rows, train_end, test_rows, test_start, 7 AS horizons, mae AS mae_24, rmse AS rmse_24, coverage AS coverage_24,
            1 AS artifacts, '0.5' AS fraction FROM w JOIN s ON s.source_id = w.source_id AND s.horizon = 24""",
        "interval_ranking": f"""WITH b AS ({_bench()}), m AS (SELECT nominal, horizon, method, round(abs(coverage - nominal), 6) AS miss FROM b WHERE regime IS NULL)
          SELECT nominal, horizon, method, rank() OVER (PARTITION BY nominal, horizon ORDER BY miss) AS rank, miss = min(miss) OVER (PARTITION BY nominal, horizon) AS best, miss,
            round(abs(miss - min(miss) OVER (PARTITION BY nominal, horizon)), 6) AS gap FROM m""",
        "features_compiled": f"""WITH {SPLIT} SELECT source_id, split, rn, round(coalesce(lag(y, 3) OVER w, first_value(y) OVER w), 6) AS theta_3, round(CASE WHEN rn <= 12 THEN 0 ELSE y - lag(y, 12) OVER w END, 6) AS change_12,
          round(min(y) OVER (w ROWS 6 PRECEDING), 6) AS least_7, round(max(y) OVER (w ROWS 6 PRECEDING), 6) AS most_7, round(max(coalesce(rain, 0)) OVER (w ROWS 9 PRECEDING), 6) AS rain_max_10,
          round(avg(air) OVER (w ROWS 4 PRECEDING), 6) AS air_mean_5, round(coalesce(solar, 0), 6) AS sun FROM se WINDOW w AS (PARTITION BY source_id, split ORDER BY rn)""",
        "unplaced_rows": """WITH d AS (SELECT CASE WHEN event_id % 17 <> 0 THEN user_id END AS s, CASE WHEN event_id % 19 <> 0 THEN ts END AS t, event_id FROM events),
          p AS (SELECT row_number() OVER (PARTITION BY s ORDER BY t, event_id) AS rn FROM d WHERE s IS NOT NULL AND t IS NOT NULL)
          SELECT 'placed' AS outcome, count(*) AS readings, sum(rn)::BIGINT AS positions FROM p
          UNION ALL SELECT CASE WHEN s IS NULL THEN 'source_id is missing' ELSE 'event_time is missing' END, count(*), NULL FROM d WHERE s IS NULL OR t IS NULL GROUP BY 1""",
        "event_json_read": """WITH f AS (SELECT user_id::VARCHAR AS source_id, value, date_trunc('second', ts)::TIMESTAMP AS t, event_type IN ('signup', 'error', 'click') OR event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0
            OR value > 100 AS bad FROM events)
          SELECT source_id, 'read' AS outcome, count(*) AS rows, round(sum(value::DECIMAL(20,6))::DOUBLE, 6) AS total, max(t) AS latest FROM f WHERE NOT coalesce(bad, false) GROUP BY source_id
          UNION ALL SELECT source_id, 'rejected', count(*), NULL, NULL FROM f WHERE coalesce(bad, false) GROUP BY source_id""",
        "stream_late_split": "SELECT (event_id % 5 = 0) AS late, count(*) AS events FROM events GROUP BY ALL",
        "operations_counters": f"WITH {QC} SELECT count(*) AS ingested, count(*) FILTER (quarantined) AS quarantined, round(count(*) FILTER (quarantined) * 100.0::DOUBLE / count(*), 6) AS quarantined_pct FROM qc",
    }
    for name in NINE_DIGITS:
        out[name] = out[name].replace(", 6) AS", ", 9) AS")
    return {k: " ".join(v.split()) for k, v in out.items()}
