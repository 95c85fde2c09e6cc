"""Equivalent SQL for the registered queries, as one library of table expressions.

Written directly from the definitions, with plain self-joins and windows over whole series.
"""

from sitecast.operators.orders import BLOCK, PRIME, round_keys
from sitecast.schema import ENCODER, SCALED, TARGET, TIME, WEATHER

PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0e0 AS {name or expr}"


def rs(cols: list[str]) -> str:
    return ", ".join(r(c) for c in cols)


def sql(needs: str, final: str) -> str:
    """Put the needed table expressions in front, each once and after its own needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in PARTS[name][0].split():
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" + final


def uniform(seed: str, *keys: str) -> str:
    text = f"concat_ws(':', '{seed}', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296e0)"


def closed(a: str, b: str, seed: str, n: str) -> str:
    return (
        f"(pow({b}, {n}) * {seed} + CASE WHEN abs(1 - {b}) < 1e-9 THEN {a} * ({n}) "
        f"ELSE {a} * (1 - pow({b}, {n})) / (1 - {b}) END)"
    )


# ---- readings --------------------------------------------------------------------------

part("ev", "", """
  SELECT CAST(user_id // 30 + 1 AS INTEGER) AS campus_key, event_id, ts, epoch_us(ts) AS us,
         epoch_us(ts) // 900000000 AS slot, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k
  FROM events""")
part("bounds", "ev", """
  SELECT campus_key, min(slot) // 96 * 96 AS s0, (max(slot) // 96 + 1) * 96 AS s1
  FROM ev GROUP BY campus_key""")
part("grid", "bounds", """
  SELECT campus_key, slot, slot - s0 AS row_idx, s1 - s0 AS n_rows,
         make_timestamp(slot * 900000000) AS ts
  FROM (SELECT campus_key, s0, s1, unnest(range(s0, s1)) AS slot FROM bounds)""")
part("slots", "ev", f"""
  SELECT campus_key, slot, avg(value) AS {TARGET},
         avg(k) FILTER (WHERE event_type = 'view') AS AirTemperature,
         avg(k) FILTER (WHERE event_type = 'click') AS RelativeHumidity
  FROM ev GROUP BY campus_key, slot""")
part("station", "grid slots", f"""
  SELECT g.*, s.{TARGET}, s.AirTemperature, s.RelativeHumidity
  FROM grid g LEFT JOIN slots s ON s.campus_key = g.campus_key AND s.slot = g.slot""")
part("ghi", "ev", """
  SELECT campus_key, us, arg_max(value, event_id) AS v FROM ev
  WHERE event_type = 'purchase' GROUP BY campus_key, us""")
part("cloud", "ev", """
  SELECT campus_key, us, arg_max(k, event_id) AS v FROM ev
  WHERE event_type = 'signup' GROUP BY campus_key, us""")
part("weather", "station ghi cloud", """
  SELECT s.*, g.v AS Ghi_hourly, c.v AS CloudOpacity_hourly,
         CAST((s.slot * 900000000 - g.us) // 60000000 AS DOUBLE) AS minutes_since_last_update
  FROM station s
  ASOF LEFT JOIN ghi g ON s.campus_key = g.campus_key AND s.slot * 900000000 >= g.us
  ASOF LEFT JOIN cloud c ON s.campus_key = c.campus_key AND s.slot * 900000000 >= c.us""")
part("sun0", "grid", """
  SELECT campus_key, row_idx, radians(-10e0 - campus_key * 7 % 30) AS phi,
         110e0 + campus_key * 11 % 45 AS lon, slot % 96 * 15 AS minutes,
         2 * pi() / 365 * (dayofyear(ts) - 1 + (slot % 96 * 15 / 60e0 - 12) / 24) AS g
  FROM grid""")
part("sun1", "sun0", """
  SELECT *, 0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g)
            + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS decl,
         radians((minutes + 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g)
            - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) + 4 * lon) / 4 - 180) AS ha
  FROM sun0""")
part("sun", "sun1", """
  SELECT campus_key, row_idx,
         degrees(acos(sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha))) AS zenith,
         degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180 AS azimuth
  FROM sun1""")
part("cycles", "grid", """
  SELECT campus_key, row_idx, sin(2 * pi() * (slot % 96 * 900) / 86400) AS day_sin,
         sin(2 * pi() * dayofyear(ts) / 365.25e0) AS year_sin
  FROM grid""")
part("readings", "weather sun cycles", """
  SELECT w.*, sin(radians(zenith)) AS zenith_sin, sin(radians(azimuth)) AS azimuth_sin,
         day_sin, year_sin
  FROM weather w JOIN sun USING (campus_key, row_idx) JOIN cycles USING (campus_key, row_idx)""")

# ---- statistics and scaling ------------------------------------------------------------

part("stats", "weather", "SELECT campus_key, " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in SCALED
) + " FROM weather WHERE row_idx < n_rows * 70 // 100 GROUP BY campus_key")
part("stats_long", "stats", " UNION ALL ".join(
    f"SELECT campus_key, '{c}' AS feature, {c}_mean AS mean, {c}_std AS std FROM stats" for c in SCALED
))
part("scaled_all", "readings stats", "SELECT r.campus_key, r.row_idx, r.n_rows, " + ", ".join(
    [f"CASE WHEN {c}_std > 1e-6 THEN (coalesce(r.{c}, 0) - {c}_mean) / {c}_std ELSE coalesce(r.{c}, 0) END AS {c}" for c in WEATHER]
    + [f"r.{c}" for c in TIME]
    + [f"CASE WHEN {TARGET}_std > 1e-6 THEN (r.{TARGET} - {TARGET}_mean) / {TARGET}_std ELSE r.{TARGET} END AS {TARGET}"]
) + " FROM readings r JOIN stats s ON s.campus_key = r.campus_key")
part("tstats", "station", f"""
  SELECT campus_key, avg({TARGET}) AS m, stddev_samp({TARGET}) AS s FROM station
  WHERE row_idx < n_rows * 70 // 100 GROUP BY campus_key""")
part("scaled", "station tstats", f"""
  SELECT campus_key, row_idx, n_rows, CASE WHEN s > 1e-6 THEN ({TARGET} - m) / s ELSE {TARGET} END AS z
  FROM station JOIN tstats USING (campus_key)""")
part("lagged", "scaled", """
  SELECT *, lag(z) OVER (PARTITION BY campus_key ORDER BY row_idx) AS before FROM scaled""")
part("model", "lagged", """
  SELECT campus_key, coalesce(regr_intercept(z, before), avg(z), 0) AS a,
         coalesce(regr_slope(z, before), 0) AS b, CAST(regr_count(z, before) AS BIGINT) AS n_pairs
  FROM lagged WHERE row_idx < n_rows * 70 // 100 GROUP BY campus_key""")

# ---- samples and cells -----------------------------------------------------------------

part("starts", "scaled", """
  SELECT campus_key, row_idx AS start_idx, n_rows FROM scaled WHERE row_idx + 115 < n_rows""")
part("counts", "grid", """
  SELECT campus_key, max(n_rows) AS n_rows, greatest(max(n_rows) - 115, 0) AS n_sequences
  FROM grid GROUP BY campus_key""")
part("offsets", "counts", """
  SELECT campus_key, CAST(coalesce(sum(n_sequences) OVER (
    ORDER BY campus_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_it
  FROM counts""")
part("numbers", "starts offsets", """
  SELECT campus_key, start_idx, before_it + start_idx AS sample_id,
         (before_it + start_idx) // 32 AS batch_id
  FROM starts JOIN offsets USING (campus_key)""")
part("steps", "", "SELECT CAST(unnest(range(20)) AS INTEGER) AS step")
part("places", "starts steps", """
  SELECT campus_key, start_idx, step, start_idx + 95 AS seed_idx, start_idx + 96 + step AS row_idx
  FROM starts CROSS JOIN steps""")
part("cells", "places lagged scaled model", """
  SELECT c.campus_key, c.start_idx, c.step, t.z AS y, coalesce(t.before, 0) AS prev,
         coalesce(q.z, 0) AS seed, m.a, m.b, c.row_idx
  FROM places c
  JOIN lagged t ON t.campus_key = c.campus_key AND t.row_idx = c.row_idx
  JOIN scaled q ON q.campus_key = c.campus_key AND q.row_idx = c.seed_idx
  JOIN model m ON m.campus_key = c.campus_key""")
part("fc", "cells", f"""
  SELECT *, a + b * prev AS guided, {closed('a', 'b', 'seed', '(step + 1)')} AS ar,
         CASE WHEN step < 5 THEN a + b * prev ELSE {closed('a', 'b', 'seed', '(step + 1)')} END AS hybrid
  FROM cells""")

part("dstarts", "scaled", """
  SELECT dataset, campus_key, row_idx AS begins, row_idx - lo AS start_idx
  FROM (SELECT DISTINCT campus_key, n_rows FROM scaled) n,
       LATERAL (SELECT 'train' AS dataset, 0 AS lo, n_rows * 70 // 100 AS hi
                UNION ALL SELECT 'validation', n_rows * 70 // 100, n_rows * 85 // 100
                UNION ALL SELECT 'test', n_rows * 85 // 100, n_rows) d
  JOIN (SELECT campus_key AS ck, row_idx FROM scaled) s ON s.ck = campus_key
  WHERE row_idx >= lo AND row_idx + 115 < hi""")
part("dnumbers", "dstarts", """
  SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY campus_key, start_idx) - 1) // 32 AS batch_id
  FROM dstarts""")
part("dplaces", "dnumbers steps", """
  SELECT d.*, step, begins + 95 AS seed_idx, begins + 96 + step AS row_idx FROM dnumbers d CROSS JOIN steps""")
part("dcells", "dplaces lagged scaled model tstats", """
  SELECT c.dataset, c.batch_id, c.campus_key, c.start_idx, c.step, t.z AS y,
         coalesce(t.before, 0) AS prev, coalesce(q.z, 0) AS seed, m.a, m.b, st.m, st.s
  FROM dplaces c
  JOIN lagged t ON t.campus_key = c.campus_key AND t.row_idx = c.row_idx
  JOIN scaled q ON q.campus_key = c.campus_key AND q.row_idx = c.seed_idx
  JOIN model m ON m.campus_key = c.campus_key
  JOIN tstats st ON st.campus_key = c.campus_key""")
part("dfc", "dcells", f"""
  SELECT *, a + b * prev AS guided, {closed('a', 'b', 'seed', '(step + 1)')} AS ar,
         CASE WHEN step < 5 THEN a + b * prev ELSE {closed('a', 'b', 'seed', '(step + 1)')} END AS hybrid
  FROM dcells""")
part("kw", "dfc", """
  SELECT dataset, campus_key, start_idx, step, y * s + m AS y,
         CASE WHEN ar IS NOT NULL THEN greatest(ar * s + m, 0) END AS yhat
  FROM dfc""")

SCORES = """CAST(count(y) AS BIGINT) AS n_valid, round(sqrt(avg(pow(yhat - y, 2))), 6) + 0e0 AS rmse,
  round(CASE WHEN count(y) < 2 THEN NULL
       WHEN var_pop(y) = 0 THEN CASE WHEN sum(pow(yhat - y, 2)) = 0 THEN 1 ELSE 0 END
       ELSE 1 - sum(pow(yhat - y, 2)) / (count(y) * var_pop(y)) END, 6) + 0e0 AS r2"""

# ---- supplier series -------------------------------------------------------------------

part("sdays", "", """
  SELECT CAST(l_suppkey AS INTEGER) AS campus_key, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS slot,
         sum(l_extendedprice) AS y
  FROM lineitem GROUP BY 1, 2""")
part("sgrid", "sdays", """
  SELECT campus_key, s0, unnest(range(s0, s1 + 1)) AS slot
  FROM (SELECT campus_key, min(slot) AS s0, max(slot) AS s1 FROM sdays GROUP BY campus_key)""")
part("sseries", "sgrid sdays", """
  SELECT g.campus_key, g.slot - g.s0 AS row_idx, d.y / max(d.y) OVER (PARTITION BY g.campus_key) * 20 AS y
  FROM sgrid g LEFT JOIN sdays d ON d.campus_key = g.campus_key AND d.slot = g.slot""")
part("spairs", "sseries", """
  SELECT s_nationkey AS city, campus_key, y, x FROM (
    SELECT campus_key, y, lag(y) OVER (PARTITION BY campus_key ORDER BY row_idx) AS x FROM sseries)
  JOIN supplier ON s_suppkey = campus_key""")
part("smodel", "spairs", """
  SELECT city, campus_key, coalesce(regr_intercept(y, x), avg(y), 0) AS a, coalesce(regr_slope(y, x), 0) AS b,
         count(*) OVER (PARTITION BY city) AS n_sites
  FROM spairs GROUP BY city, campus_key""")
part("scross", "smodel spairs", """
  SELECT m.city, m.campus_key, m.n_sites, m.a, m.b, p.campus_key = m.campus_key AS own, p.y, m.a + m.b * p.x AS yhat
  FROM smodel m JOIN spairs p ON p.city = m.city WHERE p.y IS NOT NULL AND p.x IS NOT NULL""")
part("sacross", "smodel spairs", """
  SELECT m.city, m.campus_key, m.n_sites, m.a, m.b, p.campus_key = m.campus_key AS own, p.y, m.a + m.b * p.x AS yhat
  FROM smodel m JOIN spairs p ON p.city <> m.city OR p.campus_key = m.campus_key
  WHERE p.y IS NOT NULL AND p.x IS NOT NULL""")
_SITE_SCORES = """
  SELECT city, campus_key, CAST(any_value(n_sites) AS BIGINT) AS n_sites,
         CAST(count(*) FILTER (WHERE NOT own) AS BIGINT) AS n_cross, any_value(a) AS a, any_value(b) AS b,
         sqrt(avg(pow(y - yhat, 2)) FILTER (WHERE own)) AS own_rmse,
         1 - sum(pow(y - yhat, 2)) FILTER (WHERE own) / (count(*) FILTER (WHERE own) * var_pop(y) FILTER (WHERE own)) AS own_r2,
         sqrt(avg(pow(y - yhat, 2)) FILTER (WHERE NOT own)) AS cross_rmse,
         1 - sum(pow(y - yhat, 2)) FILTER (WHERE NOT own) / nullif(count(*) FILTER (WHERE NOT own) * var_pop(y) FILTER (WHERE NOT own), 0) AS cross_r2
  FROM {} GROUP BY city, campus_key"""
part("sscores", "scross", _SITE_SCORES.format("scross"))
part("sascores", "sacross", _SITE_SCORES.format("sacross"))

# ---- gaps and segments -----------------------------------------------------------------

part("gaps", "cells", """
  SELECT *, CAST(sum(CAST(y IS NULL AS INTEGER)) OVER (PARTITION BY campus_key, start_idx ORDER BY step) AS BIGINT) AS running,
         CAST(sum(CAST(y IS NULL AS INTEGER)) OVER (PARTITION BY campus_key, start_idx) AS BIGINT) AS gap_count
  FROM cells""")
part("rounds", "gaps numbers", """
  SELECT batch_id, count(*) // 20 AS n_samples, max(gap_count) AS rounds
  FROM gaps JOIN numbers USING (campus_key, start_idx) GROUP BY batch_id""")
part("runs", "station", f"""
  SELECT campus_key, row_idx, {TARGET} IS NOT NULL AS valid, row_idx - row_number() OVER (
           PARTITION BY campus_key, {TARGET} IS NULL ORDER BY row_idx) AS island
  FROM station""")
part("in_runs", "runs", """
  SELECT campus_key, row_idx, valid, count(*) OVER (PARTITION BY campus_key, valid, island) AS length,
         row_number() OVER (PARTITION BY campus_key, valid, island ORDER BY row_idx) AS place
  FROM runs""")

ORACLES: dict[str, str] = {}

ORACLES["readings_clean"] = sql("ev", f"""
SELECT event_id, campus_key, ts, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS {TARGET},
       CASE WHEN event_type = 'view' THEN k END AS AirTemperature FROM ev""")
ORACLES["readings_rejected"] = sql("ev", f"""
SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'number of fields'
    WHEN event_type = 'error' THEN 'CampusKey;{TARGET}' ELSE '' END AS reasons,
  CASE WHEN event_type NOT IN ('signup', 'purchase', 'error') THEN k + 0e0 END AS {TARGET}
FROM ev""")
ORACLES["stats_table"] = sql("stats_long", f"""
SELECT CAST(campus_key AS VARCHAR) AS campus_key, feature, {rs(['mean', 'std'])} FROM stats_long""")
ORACLES["fit_stats"] = sql("stats_long", f"SELECT campus_key, feature, {rs(['mean', 'std'])} FROM stats_long")
_INC = [TARGET, "AirTemperature", "RelativeHumidity"]
ORACLES["incremental_stats"] = sql("slots", """
, paired AS (
  SELECT t.*, b.{y} AS x FROM slots t LEFT JOIN slots b ON b.campus_key = t.campus_key AND b.slot = t.slot - 1)
SELECT campus_key, {stats}, {a}, {b}, CAST(regr_count({y}, x) AS BIGINT) AS n_pairs FROM paired GROUP BY campus_key""".format(
    y=TARGET,
    stats=", ".join(f"CAST(count({c}) AS BIGINT) AS {c}_n, " + r(f"avg({c})", f"{c}_mean") + ", " + r(f"stddev_samp({c})", f"{c}_std") for c in _INC),
    a=r(f"coalesce(regr_intercept({TARGET}, x), avg({TARGET}), 0)", "a"),
    b=r(f"coalesce(regr_slope({TARGET}, x), 0)", "b")))
ORACLES["feature_vectors"] = sql("readings", "SELECT campus_key, row_idx, "
    + ", ".join(r(c, f"enc_{i}") for i, c in enumerate(ENCODER)) + ", "
    + ", ".join(r(c, f"dec_{i}") for i, c in enumerate(TIME + [TARGET])) + " FROM readings")
ORACLES["scaled_readings"] = sql("scaled_all", f"SELECT campus_key, row_idx, {rs(ENCODER)} FROM scaled_all")
ORACLES["weather_filled"] = sql("weather", "SELECT campus_key, row_idx, "
    + ", ".join(r(f"coalesce({c}, 0)", c) for c in WEATHER) + f", {r(TARGET)} FROM weather")
ORACLES["unscaled_forecast"] = sql("lagged model tstats", f"""
SELECT l.campus_key, row_idx,
       {r('greatest((a + b * coalesce(before, 0)) * coalesce(s, 1) + coalesce(m, 0), 0)', 'yhat')}
FROM lagged l JOIN model USING (campus_key)
LEFT JOIN tstats t ON t.campus_key = l.campus_key AND t.campus_key % 5 <> 0""")
ORACLES["missing_mask_profile"] = sql("starts scaled", """
SELECT campus_key, count(*) AS n_sequences, CAST(sum(src) AS BIGINT) AS src_masked,
       CAST(sum(tgt) AS BIGINT) AS tgt_masked, CAST(sum(CAST(tgt = 20 AS INTEGER)) AS BIGINT) AS no_truth
FROM (SELECT s.campus_key, s.start_idx,
             count(*) FILTER (WHERE z IS NULL AND row_idx < start_idx + 96) AS src,
             count(*) FILTER (WHERE z IS NULL AND row_idx >= start_idx + 96) AS tgt
      FROM starts s JOIN scaled t ON t.campus_key = s.campus_key AND row_idx BETWEEN start_idx AND start_idx + 115
      GROUP BY s.campus_key, s.start_idx)
GROUP BY campus_key""")
ORACLES["sentinel_roundtrip"] = sql("station", f"""
SELECT campus_key, row_idx, {r(f'coalesce({TARGET}, -999)', 'coded')}, {r(TARGET, 'decoded')} FROM station""")
ORACLES["night_filled"] = sql("station sun", f"""
SELECT campus_key, row_idx, {r(f'CASE WHEN {TARGET} IS NULL AND zenith >= 90 THEN 0 ELSE {TARGET} END', TARGET)}
FROM station JOIN sun USING (campus_key, row_idx)""")
ORACLES["asof_weather"] = sql("weather", f"""
SELECT campus_key, row_idx, ts, {rs(['Ghi_hourly', 'CloudOpacity_hourly'])} FROM weather""")
ORACLES["minutes_since_update"] = sql("weather", "SELECT campus_key, row_idx, minutes_since_last_update FROM weather")
ORACLES["decoder_inputs"] = sql("scaled_all", f"""
SELECT campus_key, row_idx, {rs(TIME)}, {r(f'coalesce(lag({TARGET}) OVER (PARTITION BY campus_key ORDER BY row_idx), 0)', 'prev')}
FROM scaled_all""")
ORACLES["forecast_truth"] = sql("kw", f"SELECT dataset, campus_key, start_idx, step, {rs(['y', 'yhat'])} FROM kw")
ORACLES["cross_site_scores"] = sql("sscores", f"""
SELECT city, campus_key, n_sites, n_cross, {rs(['a', 'b', 'own_rmse', 'own_r2', 'cross_rmse', 'cross_r2'])} FROM sscores""")
ORACLES["cross_city_scores"] = sql("sascores", f"""
SELECT city, campus_key, n_sites, n_cross, {rs(['a', 'b', 'own_rmse', 'own_r2', 'cross_rmse', 'cross_r2'])} FROM sascores""")
ORACLES["champion_sites"] = sql("sscores", f"""
SELECT city, campus_key, {rs(['cross_r2', 'cross_rmse'])} FROM sscores
QUALIFY row_number() OVER (PARTITION BY city ORDER BY sscores.cross_r2 DESC NULLS LAST, sscores.cross_rmse NULLS LAST, campus_key) = 1""")
ORACLES["sequence_index"] = sql("starts scaled grid", """
SELECT s.campus_key, s.start_idx, min(g.ts) AS start_ts,
       min(g.ts) FILTER (WHERE g.row_idx = start_idx + 96) AS horizon_ts,
       count(*) FILTER (WHERE z IS NULL AND t.row_idx < start_idx + 96) AS n_src_missing,
       count(*) FILTER (WHERE z IS NULL AND t.row_idx >= start_idx + 96) AS n_tgt_missing
FROM starts s JOIN scaled t ON t.campus_key = s.campus_key AND t.row_idx BETWEEN start_idx AND start_idx + 115
JOIN grid g ON g.campus_key = t.campus_key AND g.row_idx = t.row_idx
GROUP BY s.campus_key, s.start_idx""")
ORACLES["sequence_counts"] = sql("counts", """
SELECT campus_key, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_sequences) AS BIGINT) AS n_sequences
FROM counts GROUP BY ROLLUP (campus_key)""")
ORACLES["sample_numbering"] = sql("starts", """
SELECT campus_key, start_idx, row_number() OVER (ORDER BY campus_key, start_idx) - 1 AS sample_id FROM starts""")
ORACLES["batch_sizes"] = sql("starts", """
SELECT batch_id, count(*) AS n_samples
FROM (SELECT (row_number() OVER (ORDER BY campus_key, start_idx) - 1) // 32 AS batch_id FROM starts)
GROUP BY batch_id""")
ORACLES["encoder_window_summary"] = sql("scaled_all", "SELECT campus_key, row_idx, "
    + ", ".join(r(f"{f}(coalesce({c}, 0)) OVER w", f"{c}_{n}") for c in ENCODER for f, n in (("avg", "avg"), ("min", "min"), ("max", "max")))
    + ", " + ", ".join(r(f"coalesce({c}, 0)", f"{c}_last") for c in ENCODER)
    + ", " + ", ".join(f"count({c}) OVER w AS {c}_valid" for c in ENCODER)
    + """ FROM scaled_all
WINDOW w AS (PARTITION BY campus_key ORDER BY row_idx ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)
QUALIFY row_idx >= 95""")
ORACLES["sequence_export"] = sql("starts scaled_all", "SELECT s.campus_key, start_idx, 96 AS n_src, 20 AS n_tgt, "
    + ", ".join(r(f"sum(coalesce({c}, 0) * (row_idx - start_idx + 1)) FILTER (WHERE row_idx < start_idx + 96)", f"src_{c}") for c in ENCODER) + ", "
    + r(f"sum(coalesce({TARGET}, 0) * (row_idx - start_idx - 94)) FILTER (WHERE row_idx BETWEEN start_idx + 95 AND start_idx + 114)", "tgt_in_prev") + ", "
    + r(f"sum(coalesce({TARGET}, -999) * (row_idx - start_idx - 95)) FILTER (WHERE row_idx >= start_idx + 96)", "tgt_out_sum") + f""",
  CAST(coalesce(sum(row_idx - start_idx + 1) FILTER (WHERE {TARGET} IS NULL AND row_idx < start_idx + 96), 0) AS INTEGER) AS src_masked,
  CAST(coalesce(sum(row_idx - start_idx - 95) FILTER (WHERE {TARGET} IS NULL AND row_idx >= start_idx + 96), 0) AS INTEGER) AS tgt_masked
FROM starts s JOIN scaled_all t ON t.campus_key = s.campus_key AND row_idx BETWEEN start_idx AND start_idx + 115
GROUP BY s.campus_key, start_idx""")
ORACLES["segments_reference"] = sql("in_runs", """
SELECT t.campus_key, t.row_idx, t.valid AND coalesce(bool_or(e.place >= 3), false) AS in_segment
FROM in_runs t LEFT JOIN in_runs e ON e.campus_key = t.campus_key AND e.valid AND e.row_idx BETWEEN t.row_idx - 2 AND t.row_idx
GROUP BY t.campus_key, t.row_idx, t.valid""")
ORACLES["segments_run"] = sql("in_runs", "SELECT campus_key, row_idx, valid AND length >= 3 AS in_segment FROM in_runs")
ORACLES["gap_ordinals"] = sql("gaps", """
SELECT campus_key, start_idx, step, running AS ordinal, gap_count FROM gaps WHERE y IS NULL""")
ORACLES["fill_rounds"] = sql("rounds", "SELECT * FROM rounds")
ORACLES["metric_stall"] = sql("lagged model", """
, daily AS (
  SELECT campus_key, row_idx // 96 AS epoch, sqrt(avg(pow(a + b * coalesce(before, 0) - z, 2))) AS rmse
  FROM lagged JOIN model USING (campus_key) GROUP BY ALL),
best AS (
  SELECT *, min(rmse) OVER (PARTITION BY campus_key ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
         min(rmse) OVER (PARTITION BY campus_key ORDER BY epoch) AS best FROM daily),
marks AS (SELECT *, rmse IS NOT NULL AND (earlier IS NULL OR rmse < earlier) AS improved FROM best),
since AS (
  SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY campus_key ORDER BY epoch) AS epochs_since_best
  FROM marks)
SELECT campus_key, epoch, round(rmse, 6) + 0e0 AS rmse, round(best, 6) + 0e0 AS best, improved, epochs_since_best,
       coalesce(bool_or(epochs_since_best >= 3) OVER (PARTITION BY campus_key ORDER BY epoch), false) AS stopped
FROM since""")
ORACLES["power_rescaled"] = sql("sseries", f"SELECT campus_key, row_idx, {r('y', TARGET)} FROM sseries")
ORACLES["metrics_overall"] = sql("kw", f"SELECT dataset, {SCORES} FROM kw GROUP BY dataset")
ORACLES["metrics_by_step"] = sql("kw", f"""
SELECT dataset, step + 1 AS step, (step + 1) * 15 AS minutes_ahead, {SCORES} FROM kw GROUP BY dataset, step""")
ORACLES["evaluation_report"] = sql("kw", f"""
SELECT dataset, 'step' AS scope, step + 1 AS step, (step + 1) * 15 AS minutes_ahead, {SCORES} FROM kw GROUP BY dataset, step
UNION ALL
SELECT dataset, 'overall', NULL, NULL, {SCORES} FROM kw GROUP BY dataset""")
ORACLES["masked_mse"] = sql("fc", f"""
SELECT campus_key, start_idx, {r('coalesce(avg(pow(ar - y, 2)), 0)', 'mse')} FROM fc GROUP BY campus_key, start_idx""")
ORACLES["batch_mean_rmse"] = sql("dfc", f"""
SELECT dataset, count(*) AS n_batches, {r('avg(e)', 'rmse')}
FROM (SELECT dataset, batch_id, sqrt(coalesce(avg(pow(ar - y, 2)), 0)) AS e FROM dfc GROUP BY dataset, batch_id)
GROUP BY dataset""")
LOSSES = f"""count(*) AS n_batches, count(loss) AS n_defined, {r('sum(coalesce(loss, 0)) / count(*)', 'loss_lenient')},
       {r('CASE WHEN count(loss) = count(*) THEN sum(loss) / count(*) END', 'loss_strict')}"""
ORACLES["epoch_loss"] = sql("dfc", f"""
SELECT dataset, {LOSSES}
FROM (SELECT dataset, batch_id, CASE WHEN NOT (dataset = 'test' AND batch_id % 7 = 3) THEN avg(pow(guided - y, 2)) END AS loss
      FROM dfc GROUP BY dataset, batch_id)
GROUP BY dataset""")
ORACLES["epoch_loss_ar"] = sql("dfc", f"""
SELECT dataset, {LOSSES}
FROM (SELECT dataset, batch_id, avg(pow(ar - y, 2)) AS loss FROM dfc GROUP BY dataset, batch_id)
GROUP BY dataset""")
ORACLES["blended_loss"] = sql("fc numbers", f"""
, valid AS (
  SELECT *, row_number() OVER (PARTITION BY campus_key, start_idx, y IS NULL ORDER BY step) - step AS island FROM fc),
placed AS (
  SELECT *, CASE WHEN y IS NOT NULL THEN row_number() OVER (
      PARTITION BY campus_key, start_idx, y IS NULL, island ORDER BY step) END AS place FROM valid),
flagged AS (
  SELECT *, y IS NOT NULL AND coalesce(max(CASE WHEN place >= 5 THEN 1 ELSE 0 END) OVER (
      PARTITION BY campus_key, start_idx ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) = 1 AS marked FROM placed),
losses AS (
  SELECT batch_id, avg(pow(guided - y, 2)) AS base_loss, avg(pow(guided - y, 2)) FILTER (WHERE marked) AS segment_loss
  FROM flagged JOIN numbers USING (campus_key, start_idx) GROUP BY batch_id)
SELECT batch_id, {rs(['base_loss', 'segment_loss'])},
       {r('coalesce(base_loss * 0.8e0 + segment_loss * 0.2e0, base_loss, 0)', 'loss')} FROM losses""")
ORACLES["validation_modes"] = sql("dfc", f"""
, e AS (SELECT dataset, batch_id, sqrt(coalesce(avg(pow(guided - y, 2)), 0)) AS guided,
        sqrt(coalesce(avg(pow(hybrid - y, 2)), 0)) AS hybrid, sqrt(coalesce(avg(pow(ar - y, 2)), 0)) AS ar
        FROM dfc GROUP BY dataset, batch_id)
""" + " UNION ALL ".join(
    f"SELECT dataset, '{name}' AS mode, count(*) AS n_batches, {r(f'avg({col})', 'rmse')} FROM e GROUP BY dataset"
    for name, col in (("guided", "guided"), ("hybrid", "hybrid"), ("autoregressive", "ar"))))
_draw = ["CASE WHEN {u} < 0.7e0 THEN 'train' WHEN {u} < 0.85e0 THEN 'validation' ELSE 'test' END".format(
    u=uniform("s1", "campus_key", block)) for block in ("start_idx // 480", "(start_idx + 115) // 480")]
ORACLES["hash_split"] = sql("starts", f"""
SELECT campus_key, start_idx, CASE WHEN {_draw[0]} = {_draw[1]} THEN {_draw[0]} ELSE 'purged' END AS split FROM starts""")
ORACLES["shuffle_order"] = sql("starts", f"""
SELECT campus_key, start_idx, {uniform('s1', 'campus_key', 'start_idx')} AS order_key FROM starts""")
ORACLES["forecast_samples"] = sql("dstarts kw", f"""
, picks AS (
  SELECT dataset, campus_key, start_idx, CAST(row_number() OVER (
    PARTITION BY dataset ORDER BY {uniform('s1', 'campus_key', 'start_idx')}, campus_key, start_idx) AS INTEGER) AS pick FROM dstarts
  QUALIFY pick <= 50)
SELECT dataset, pick, campus_key, start_idx, (step + 1) * 15 AS minutes_ahead, {rs(['y', 'yhat'])}
FROM kw JOIN picks USING (dataset, campus_key, start_idx)""")
_u = uniform("s1:4", "campus_key", "start_idx", "step")
ORACLES["scheduled_mix"] = sql("fc starts", f"""
SELECT campus_key, start_idx, step, (y IS NULL OR {_u} < 0.1e0 + 0.9e0 * 4 / 9) AS taken,
       {r(f'CASE WHEN y IS NULL OR {_u} < 0.1e0 + 0.9e0 * 4 / 9 THEN ar ELSE prev END', 'mixed')}
FROM fc JOIN starts USING (campus_key, start_idx) WHERE start_idx + 116 <= n_rows * 70 // 100""")
ORACLES["cycle_features"] = sql("cycles", f"SELECT campus_key, row_idx, {rs(['day_sin', 'year_sin'])} FROM cycles")
ORACLES["solar_position"] = sql("sun", f"""
SELECT campus_key, row_idx, {r('zenith')}, {r('sin(radians(zenith))', 'zenith_sin')},
       {r('sin(radians(azimuth))', 'azimuth_sin')} FROM sun""")
ORACLES["grid_readings"] = sql("station", f"""
SELECT campus_key, row_idx, n_rows, ts, {rs([TARGET, 'AirTemperature', 'RelativeHumidity'])} FROM station""")
ORACLES["ar1_coefficients"] = sql("model", f"SELECT campus_key, {rs(['a', 'b'])}, n_pairs FROM model")
ORACLES["direct_forecast"] = sql("dcells", f"""
, direct AS (
  SELECT campus_key, step, coalesce(regr_intercept(y, seed), avg(y), 0) AS a, coalesce(regr_slope(y, seed), 0) AS b
  FROM dcells WHERE dataset = 'train' GROUP BY campus_key, step),
applied AS (
  SELECT c.dataset, c.campus_key, c.step, c.y, d.a + d.b * c.seed AS yhat
  FROM dcells c JOIN direct d ON d.campus_key = c.campus_key AND d.step = c.step)
SELECT dataset, campus_key, step + 1 AS step, (step + 1) * 15 AS minutes_ahead, {SCORES}
FROM applied GROUP BY dataset, campus_key, step""")

# Least squares by taking one feature after the other out of those that follow, then solving
# backwards.
_STEP = ["prev", *TIME]
_WINDOW = [f"{c}_level" for c in WEATHER] + ["window_avg", "window_share"]
_X = _STEP + _WINDOW


def _windows(first: str, last: str) -> str:
    over = f"OVER (PARTITION BY campus_key ORDER BY row_idx ROWS BETWEEN {first} AND {last})"
    parts = [f"avg(coalesce({c}, 0)) {over} AS {c}_level" for c in WEATHER]
    parts += [f"avg(coalesce({TARGET}, 0)) {over} AS window_avg", f"count({TARGET}) {over} / 96e0 AS window_share"]
    return ", ".join(parts)


part("arx_rows", "scaled_all", f"""
  SELECT * FROM (
    SELECT row_idx, n_rows, {TARGET} AS y, {", ".join(TIME)}, {_windows("96 PRECEDING", "1 PRECEDING")},
           coalesce(lag({TARGET}) OVER (PARTITION BY campus_key ORDER BY row_idx), 0) AS prev
    FROM scaled_all)
  WHERE row_idx >= 96 AND row_idx < n_rows * 70 // 100 AND y IS NOT NULL""")
part("arx_means", "arx_rows", "SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in [*_X, "y"]) + " FROM arx_rows")
part("arx_g0", "arx_rows arx_means", "SELECT " + ", ".join(f"{c} - m_{c} AS {c}" for c in [*_X, "y"]) + " FROM arx_rows, arx_means")
for _k, _x in enumerate(_X):
    _later = [*_X[_k + 1 :], "y"]
    part(f"arx_s{_k}", f"arx_g{_k}", "SELECT " + ", ".join(f"sum({_x} * {c}) / sum({_x} * {_x}) AS s{_k}_{c}" for c in _later) + f" FROM arx_g{_k}")
    part(f"arx_g{_k + 1}", f"arx_g{_k} arx_s{_k}", "SELECT " + ", ".join(f"{c} - s{_k}_{c} * {_x} AS {c}" for c in _later) + f" FROM arx_g{_k}, arx_s{_k}")
part(f"arx_b{len(_X)}", "arx_means", "SELECT * FROM arx_means")
for _k in reversed(range(len(_X))):
    _less = "".join(f" - s{_k}_{c} * b_{c}" for c in _X[_k + 1 :])
    part(f"arx_b{_k}", f"arx_s{_k} arx_b{_k + 1}", f"SELECT t.*, s{_k}_y{_less} AS b_{_X[_k]} FROM arx_b{_k + 1} t, arx_s{_k}")
part("arx_beta", "arx_b0", "SELECT *, m_y" + "".join(f" - b_{c} * m_{c}" for c in _X) + " AS b_0 FROM arx_b0")
part("arx_seed", "scaled_all arx_beta", f"""
  SELECT campus_key, row_idx, coalesce({TARGET}, 0) AS seed, b_prev, b_0{"".join(f" + b_{c} * {c}" for c in _WINDOW)} AS level
  FROM (SELECT campus_key, row_idx, {TARGET}, {_windows("95 PRECEDING", "CURRENT ROW")} FROM scaled_all), arx_beta""")
part("arx_known", "scaled_all arx_beta", f"""
  SELECT campus_key, row_idx, {TARGET} AS y, {" + ".join(f"b_{c} * {c}" for c in TIME)} AS known FROM scaled_all, arx_beta""")
part("arx_cells", "places arx_seed arx_known", """
  SELECT p.campus_key, p.start_idx, p.step, k.y, s.seed, s.b_prev, s.level + k.known AS gain
  FROM places p
  JOIN arx_seed s ON s.campus_key = p.campus_key AND s.row_idx = p.seed_idx
  JOIN arx_known k ON k.campus_key = p.campus_key AND k.row_idx = p.row_idx""")
ORACLES["arx_forecast"] = sql("arx_cells", f"""
, rolled AS (
  SELECT c.campus_key, c.start_idx, c.step, any_value(c.y) AS y,
         any_value(pow(c.b_prev, c.step + 1) * c.seed) + sum(pow(c.b_prev, c.step - i.step) * i.gain) AS yhat
  FROM arx_cells c JOIN arx_cells i ON i.campus_key = c.campus_key AND i.start_idx = c.start_idx AND i.step <= c.step
  GROUP BY c.campus_key, c.start_idx, c.step)
SELECT campus_key, step + 1 AS step, (step + 1) * 15 AS minutes_ahead, {{SCORES}} FROM rolled GROUP BY campus_key, step""".replace("{SCORES}", SCORES))

# The same elimination per step for the joint forecast.
_J = ["seed", *_WINDOW, *TIME]
part("jx", "scaled_all", f"""
  SELECT campus_key, row_idx, {TARGET} AS y, coalesce({TARGET}, 0) AS seed, {", ".join(TIME)},
         {_windows("95 PRECEDING", "CURRENT ROW")} FROM scaled_all""")
part("jcells", "dplaces jx", f"""
  SELECT p.dataset, p.step, t.y, {", ".join(f"s.{c}" for c in _J)}
  FROM dplaces p
  JOIN jx s ON s.campus_key = p.campus_key AND s.row_idx = p.seed_idx
  JOIN jx t ON t.campus_key = p.campus_key AND t.row_idx = p.row_idx""")
part("j_means", "jcells", "SELECT step, " + ", ".join(f"avg({c}) AS m_{c}" for c in [*_J, "y"])
     + " FROM jcells WHERE dataset = 'train' AND y IS NOT NULL GROUP BY step")
part("j_g0", "jcells j_means", "SELECT step, " + ", ".join(f"{c} - m_{c} AS {c}" for c in [*_J, "y"])
     + " FROM jcells JOIN j_means USING (step) WHERE dataset = 'train' AND y IS NOT NULL")
for _k, _x in enumerate(_J):
    _later = [*_J[_k + 1 :], "y"]
    part(f"j_s{_k}", f"j_g{_k}", "SELECT step, " + ", ".join(f"sum({_x} * {c}) / sum({_x} * {_x}) AS s{_k}_{c}" for c in _later) + f" FROM j_g{_k} GROUP BY step")
    part(f"j_g{_k + 1}", f"j_g{_k} j_s{_k}", "SELECT step, " + ", ".join(f"{c} - s{_k}_{c} * {_x} AS {c}" for c in _later) + f" FROM j_g{_k} JOIN j_s{_k} USING (step)")
part(f"j_b{len(_J)}", "j_means", "SELECT * FROM j_means")
for _k in reversed(range(len(_J))):
    _less = "".join(f" - s{_k}_{c} * b_{c}" for c in _J[_k + 1 :])
    part(f"j_b{_k}", f"j_s{_k} j_b{_k + 1}", f"SELECT t.*, s{_k}_y{_less} AS b_{_J[_k]} FROM j_b{_k + 1} t JOIN j_s{_k} USING (step)")
part("j_beta", "j_b0", "SELECT *, m_y" + "".join(f" - b_{c} * m_{c}" for c in _J) + " AS b_intercept FROM j_b0")
ORACLES["joint_weights"] = sql("j_beta", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT step + 1 AS step, '{c}' AS input, {r(f'b_{c}', 'weight')} FROM j_beta" for c in ["intercept", *_J]) + ")")
ORACLES["joint_forecast"] = sql("jcells j_beta", f"""
SELECT dataset, step + 1 AS step, (step + 1) * 15 AS minutes_ahead, {SCORES}
FROM (SELECT c.dataset, c.step, c.y, b_intercept{"".join(f" + b_{c} * c.{c}" for c in _J)} AS yhat
      FROM jcells c JOIN j_beta USING (step))
GROUP BY dataset, step""")
for _name, _col in (("guided", "guided"), ("ar", "ar"), ("hybrid", "hybrid")):
    ORACLES[f"forecast_{_name}"] = sql("fc", f"SELECT campus_key, start_idx, step, {r(_col, 'yhat')} FROM fc")
ORACLES["prediction_cache"] = ORACLES["forecast_ar"]
part("filled", "gaps numbers", """
  SELECT *, CASE WHEN y IS NULL AND running < rounds THEN a + b * prev ELSE prev END AS filled
  FROM (SELECT *, max(gap_count) OVER (PARTITION BY batch_id) AS rounds
        FROM gaps JOIN numbers USING (campus_key, start_idx))""")
ORACLES["gap_fill_reference"] = sql("filled", f"""
SELECT campus_key, start_idx, step, running AS ordinal, rounds, {r('filled')} FROM filled WHERE y IS NULL""")
ORACLES["gap_fill_loss"] = sql("filled", f"""
SELECT {LOSSES} FROM (SELECT batch_id, avg(pow(a + b * filled - y, 2)) AS loss FROM filled GROUP BY batch_id)""")
ORACLES["gap_fill_aligned"] = sql("cells", f"""
, newest AS (
  SELECT *, last_value(CASE WHEN y IS NOT NULL THEN step END IGNORE NULLS) OVER w AS place,
         last_value(y IGNORE NULLS) OVER w AS known
  FROM cells WINDOW w AS (PARTITION BY campus_key, start_idx ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT campus_key, start_idx, step, step - coalesce(place, -1) AS gap_length,
       {r(closed('a', 'b', 'coalesce(known, seed)', '(step - coalesce(place, -1))'), 'filled')}
FROM newest WHERE y IS NULL""")

# Ten epochs of refinement, one after the other; the history ends where three did not improve.
_chain, _model = "", "model"
for _e in range(10):
    _rate = f"(0.1e0 + 0.9e0 * {_e} / 9)"
    _draw_e = uniform(f"s1:{_e}", "c.campus_key", "c.start_idx", "c.step")
    _chain += f"""
, mix{_e} AS (
  SELECT c.campus_key, c.y, CASE WHEN c.y IS NULL OR {_draw_e} < {_rate}
      THEN {closed('m.a', 'm.b', 'c.seed', '(c.step + 1)')} ELSE c.prev END AS x
  FROM dcells c JOIN {_model} m ON m.campus_key = c.campus_key WHERE c.dataset = 'train'),
model{_e} AS (
  SELECT campus_key, coalesce(regr_intercept(y, x), avg(y), 0) AS a, coalesce(regr_slope(y, x), 0) AS b
  FROM mix{_e} GROUP BY campus_key),
err{_e} AS (
  SELECT {_e} AS epoch, {_rate} AS rate, avg(e) AS ar_rmse FROM (
    SELECT c.batch_id, sqrt(coalesce(avg(pow({closed('m.a', 'm.b', 'c.seed', '(c.step + 1)')} - c.y, 2)), 0)) AS e
    FROM dcells c JOIN model{_e} m ON m.campus_key = c.campus_key WHERE c.dataset = 'validation' GROUP BY c.batch_id))"""
    _model = f"model{_e}"
ORACLES["refine_history"] = sql("dcells", _chain + f"""
, errs AS ({' UNION ALL '.join(f'SELECT * FROM err{e}' for e in range(10))}),
marks AS (
  SELECT *, min(ar_rmse) OVER (ORDER BY epoch) AS best,
         coalesce(ar_rmse < min(ar_rmse) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
  FROM errs),
since AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM marks)
SELECT epoch, {r('rate')}, {r('ar_rmse')}, {r('best')}, improved FROM since
WHERE epoch <= coalesce((SELECT min(epoch) FROM since WHERE waited >= 3), 9)""")

# Two levels of Feistel networks, a table expression per round: blocks, then places inside.
def _shuffle(last: str, prefix: str, x: str, of: str, keys: list) -> str:
    """Permutes column x (below `size`, with `h` and `low`) of the table expression `last`."""
    for i, rounds in enumerate(keys):
        begin = "size - h" if i % 2 else "0"
        part(f"{prefix}{i}", last, f"""
          SELECT * EXCLUDE (y), greatest(y, 0) // low AS upper_half, greatest(y, 0) % low AS lower_half, y >= 0 AND y < h AS moves
          FROM (SELECT *, {x} - ({begin}) AS y FROM {last})""")
        last = f"{prefix}{i}"
        for j, (m, a, c) in enumerate(rounds):
            half, other, mask = ("upper_half", "lower_half", "h // low - 1") if j % 2 == 0 else ("lower_half", "upper_half", "low - 1")
            part(f"{prefix}{i}_{j}", last, f"""
              SELECT * EXCLUDE ({half}, f), xor({half}, (f * f % {PRIME} >> 9) & ({mask})) AS {half}
              FROM (SELECT *, (({other} + {of} % {PRIME} * {m} % {PRIME}) % {PRIME} * {a} % {PRIME} + {c}) % {PRIME} AS f FROM {last})""")
            last = f"{prefix}{i}_{j}"
        part(f"{prefix}{i}_end", last, f"""
          SELECT * EXCLUDE ({x}, upper_half, lower_half, moves),
            CASE WHEN moves THEN {begin} + upper_half * low + lower_half ELSE {x} END AS {x} FROM {last}""")
        last = f"{prefix}{i}_end"
    return last


def _powers(n: str) -> str:
    bits = f"CAST(floor(log2(greatest({n}, 1)) + 1e-9) AS BIGINT)"
    return f"{n} AS size, CAST(1 AS BIGINT) << {bits} AS h, CAST(1 AS BIGINT) << (({bits} + 1) // 2) AS low"


part("ord_start", "numbers", f"""
  SELECT campus_key, start_idx, sample_id, sample_id // {BLOCK} AS block, sample_id % {BLOCK} AS inside,
    count(*) OVER () // {BLOCK} AS full_blocks, count(*) OVER () % {BLOCK} AS tail FROM numbers""")
part("ord_blocks", "ord_start", f"""
  SELECT block, block AS moved, {_powers("full_blocks")} FROM (SELECT DISTINCT block, full_blocks FROM ord_start)
  WHERE block < full_blocks""")
_moved = _shuffle("ord_blocks", "ord_b", "moved", "0", round_keys("s1", 4, "blocks"))
part("ord_inside", f"ord_start {_moved}", f"""
  SELECT s.*, coalesce(b.moved, s.block) AS moved,
    {_powers(f"CASE WHEN s.block < s.full_blocks THEN {BLOCK} ELSE tail END")}
  FROM ord_start s LEFT JOIN {_moved} b ON b.block = s.block""")
_last = _shuffle("ord_inside", "ord_i", "inside", "block", round_keys("s1", 4, "inside"))
ORACLES["epoch_order"] = sql(_last, f"""
SELECT campus_key, start_idx, sample_id, CAST(moved * {BLOCK} + inside AS BIGINT) AS position, sample_id AS found FROM {_last}""")
ORACLES["trainer_shards"] = sql("numbers scaled_all", f"""
SELECT batch_id, min(sample_id) AS first_sample, max(sample_id) AS last_sample, count(DISTINCT sample_id) AS n_samples,
  {r(f"sum(coalesce({TARGET}, -999))", "tgt_out_sum")}, true AS in_order
FROM numbers n JOIN scaled_all t ON t.campus_key = n.campus_key AND t.row_idx BETWEEN n.start_idx + 96 AND n.start_idx + 115
GROUP BY batch_id""")
