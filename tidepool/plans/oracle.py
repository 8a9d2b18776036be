"""Plain SQL statements of each catalogued query (DuckDB dialect), run by the
checker against the same tables.  They state the semantics directly with
ordinary windows, joins and aggregates."""

from __future__ import annotations


def R(x: str) -> str:
    """Rounding used on both sides of the comparison."""
    return f"round(({x}) + 3.3e-8, 6)"


READINGS = """readings AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS device_id,
         CAST(event_id % 3 AS VARCHAR) AS gateway_id,
         event_type AS data_type, CAST(value AS DOUBLE) AS value, ts, event_id AS seq
  FROM events)"""

READINGS_NAN = """readings AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS device_id,
         CAST(event_id % 3 AS VARCHAR) AS gateway_id,
         event_type AS data_type,
         CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS value,
         ts, event_id AS seq
  FROM events)"""

RULES = """rules(data_type, min_value, max_value) AS (
  VALUES ('signup', CAST(1 AS DOUBLE), CAST(150 AS DOUBLE)), ('purchase', CAST(1 AS DOUBLE), CAST(150 AS DOUBLE)),
         ('error', CAST(0 AS DOUBLE), CAST(150 AS DOUBLE)), ('view', CAST(0 AS DOUBLE), CAST(140 AS DOUBLE)))"""

ORACLE: dict[str, str] = {}

ROLLING = f"""
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts, seq) AS DOUBLE) AS rn
      FROM readings),
m AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS a, var_pop(value) OVER w AS vp,
             regr_slope(value, rn) OVER w AS sl
      FROM p WINDOW w AS (PARTITION BY device_id, data_type ORDER BY ts, seq
                          ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN n > 1 THEN vp ELSE 0.0 END AS var FROM m),
g AS (SELECT *, CASE WHEN n > 1 AND var > 0 THEN (value - a) / sqrt(var) ELSE 0.0 END AS z,
             CASE WHEN n > 2 THEN coalesce(sl, 0.0) ELSE 0.0 END AS trend
      FROM f)"""

ORACLE["rolling_metrics"] = f"""
WITH {READINGS}, {ROLLING}
SELECT device_id, data_type, seq, ts, value AS original_value, n AS history_size,
       {R('a')} AS average_value, {R('var')} AS variance, {R('sqrt(var)')} AS std_dev,
       {R('trend')} AS trend_coefficient, {R('z')} AS normalized_value, {R('abs(z)')} AS anomaly_score
FROM g"""


def _bound_text(c: str) -> str:
    return (f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({c} AS VARCHAR) END")


CLEAN = f"""
c AS (SELECT r.*, ru.min_value, ru.max_value, (isnan(r.value) OR isinf(r.value)) AS nonfinite
      FROM readings r LEFT JOIN rules ru ON r.data_type = ru.data_type),
c2 AS (SELECT *,
         CASE WHEN nonfinite THEN 'nonfinite' WHEN value < min_value THEN 'below'
              WHEN value > max_value THEN 'above' ELSE 'ok' END AS verdict
       FROM c),
c3 AS (SELECT *, verdict <> 'ok' AS modified,
         CASE verdict WHEN 'nonfinite' THEN 'Invalid value (NaN or Infinity), replaced with average'
                      WHEN 'below' THEN 'Value below minimum (' || {_bound_text('min_value')} || '), set to minimum'
                      WHEN 'above' THEN 'Value above maximum (' || {_bound_text('max_value')} || '), set to maximum'
                      ELSE 'Valid data' END AS message,
         CASE verdict WHEN 'nonfinite' THEN NULL WHEN 'below' THEN min_value
                      WHEN 'above' THEN max_value ELSE value END AS clamped
       FROM c2)"""

ORACLE["clean_readings"] = f"""
WITH {READINGS_NAN}, {RULES}, {CLEAN}
SELECT device_id, data_type, seq, value AS original_value, min_value, max_value,
       clamped AS cleaned_value, modified AS was_modified, message AS validation_message
FROM c3"""

# History before each reading: the last k unmodified values, k = c below 100,
# else 100 after an unmodified reading and 99 after a modified one.
HISTORY = f"""
o AS (SELECT *,
        coalesce(sum(CASE WHEN modified THEN 0 ELSE 1 END) OVER (
          PARTITION BY device_id, data_type ORDER BY ts, seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cnt,
        lag(modified) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq) AS prev_mod
      FROM c3),
h AS (SELECT device_id AS hd, data_type AS ht,
        row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts, seq) AS vn,
        avg(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                         ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m100,
        stddev_pop(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                                ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s100,
        avg(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                         ROWS BETWEEN 98 PRECEDING AND CURRENT ROW) AS m99,
        stddev_pop(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                                ROWS BETWEEN 98 PRECEDING AND CURRENT ROW) AS s99,
        first_value(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                                 ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS oldest,
        list(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                          ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l100,
        list(value) OVER (PARTITION BY device_id, data_type ORDER BY ts, seq
                          ROWS BETWEEN 98 PRECEDING AND CURRENT ROW) AS l99
      FROM c3 WHERE NOT modified),
k AS (SELECT o.*, h.*, CASE WHEN cnt < 100 THEN cnt WHEN prev_mod THEN 99 ELSE 100 END AS hk
      FROM o LEFT JOIN h ON h.hd = o.device_id AND h.ht = o.data_type AND h.vn = o.cnt),
s AS (SELECT *,
        CASE WHEN hk = 0 THEN NULL WHEN cnt >= 100 AND hk = 99 THEN m99 ELSE m100 END AS hmean,
        CASE WHEN hk = 0 THEN NULL WHEN cnt >= 100 AND hk = 99 THEN s99 ELSE s100 END AS hstd,
        CASE WHEN hk = 0 THEN NULL WHEN cnt >= 100 AND hk = 99 THEN l99 ELSE l100 END AS hlist,
        (CASE WHEN modified THEN 0.0 ELSE value END) - (CASE WHEN hk = 100 THEN oldest ELSE 0.0 END) AS dsum,
        (CASE WHEN modified THEN 0 ELSE 1 END) - (CASE WHEN hk = 100 THEN 1 ELSE 0 END) AS dn
      FROM k),
a AS (SELECT *, coalesce(hk >= 5 AND NOT isnan(value) AND abs(value - hmean) > 3 * hstd, false) AS anomaly,
        sum(dsum) OVER (PARTITION BY data_type ORDER BY ts, seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS psum,
        sum(dn) OVER (PARTITION BY data_type ORDER BY ts, seq
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn
      FROM s),
va AS (SELECT *, CASE WHEN pn > 0 THEN psum / pn END AS tavg,
         -- the message states mean and sigma as the service computes them:
         -- a left-to-right sum over the history, then a two-pass variance
         list_reduce(hlist, lambda x, y: x + y) / len(hlist) AS seq_mean
       FROM a),
vm AS (SELECT *, sqrt(list_reduce(list_transform(hlist, lambda x: (x - seq_mean) * (x - seq_mean)),
                                   lambda x, y: x + y) / len(hlist)) AS seq_std
       FROM va)"""

ORACLE["history_anomaly"] = f"""
WITH {READINGS_NAN}, {RULES}, {CLEAN}, {HISTORY}
SELECT device_id, data_type, seq, modified AS was_modified, CAST(hk AS BIGINT) AS history_size,
       {R('hmean')} AS history_mean, {R('hstd')} AS history_std, anomaly AS is_anomaly,
       CASE WHEN anomaly THEN 'Possible anomaly: value deviates significantly from history (mean: '
            || printf('%.2f', seq_mean) || ', stddev: ' || printf('%.2f', seq_std) || ')' END AS anomaly_message
FROM vm"""

ORACLE["replace_nonfinite"] = f"""
WITH {READINGS_NAN}, {RULES}, {CLEAN}, {HISTORY}
SELECT device_id, data_type, seq, value AS original_value,
       {R("CASE WHEN nonfinite THEN coalesce(tavg, 0.0) ELSE clamped END")} AS cleaned_value,
       modified AS was_modified, message AS validation_message, {R('tavg')} AS type_average
FROM va"""

# End state of every history: size after the last reading of the key, then
# the last `size` unmodified values.
ORACLE["history_pool"] = f"""
WITH {READINGS_NAN}, {RULES}, {CLEAN}, {HISTORY},
last AS (SELECT device_id, data_type,
           cnt + (CASE WHEN modified THEN 0 ELSE 1 END) AS cnt_after,
           hk - (CASE WHEN hk = 100 THEN 1 ELSE 0 END) + (CASE WHEN modified THEN 0 ELSE 1 END) AS size_after
         FROM (SELECT *, row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts DESC, seq DESC) AS rk
               FROM va) WHERE rk = 1),
kept AS (SELECT device_id, data_type, value,
           row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts, seq) AS vn
         FROM c3 WHERE NOT modified),
pool AS (SELECT kept.data_type, kept.value FROM kept JOIN last
           ON kept.device_id = last.device_id AND kept.data_type = last.data_type
          AND kept.vn > last.cnt_after - last.size_after)
SELECT t.data_type, CAST(count(pool.value) AS BIGINT) AS pool_values, {R('sum(pool.value)')} AS pool_sum,
       {R('avg(pool.value)')} AS type_average
FROM (SELECT DISTINCT data_type FROM readings) t LEFT JOIN pool ON pool.data_type = t.data_type
GROUP BY t.data_type"""

BATCHES = f"""
bi AS (SELECT CAST(seq // 8 AS BIGINT) AS batch_id, modified FROM va),
bs AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS total_items,
              CAST(count(*) FILTER (WHERE modified) AS BIGINT) AS modified_items
       FROM bi GROUP BY batch_id
       UNION ALL SELECT -1, 0, 0),
st AS (SELECT *, CASE WHEN total_items = 0 THEN 'INVALID' WHEN modified_items > 0 THEN 'PARTIALLY_VALID'
                      ELSE 'OK' END AS status,
              CAST(CASE WHEN total_items = 0 THEN 1 WHEN modified_items > 0 THEN 2 ELSE 0 END AS BIGINT) AS status_code,
              CASE WHEN total_items = 0 THEN 'Invalid data detected'
                   WHEN modified_items > 0 THEN 'Some data items required correction'
                   ELSE 'All data valid' END AS status_message
       FROM bs)"""

ORACLE["batch_status"] = f"""
WITH {READINGS_NAN}, {RULES}, {CLEAN}, {HISTORY}, {BATCHES}
SELECT batch_id, total_items, modified_items, status, status_code, status_message FROM st"""

ORACLE["batch_summary"] = f"""
WITH {READINGS_NAN}, {RULES}, {CLEAN}, {HISTORY}, {BATCHES}
SELECT status, CAST(count(*) AS BIGINT) AS batches, CAST(sum(total_items) AS BIGINT) AS total_items,
       CAST(sum(modified_items) AS BIGINT) AS modified_items,
       CAST(sum(CASE WHEN status = 'INVALID' THEN 0 ELSE total_items END) AS BIGINT) AS kept_items
FROM st GROUP BY status"""

ROLLING_REG = f"""
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts, seq) AS DOUBLE) AS rn
      FROM readings),
m AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS a, var_pop(value) OVER w AS vp,
             regr_slope(value, rn) OVER w AS sl, regr_intercept(value, rn) OVER w AS ic,
             regr_r2(value, rn) OVER w AS r2, min(rn) OVER w AS x0, min(ts) OVER w AS wstart
      FROM p WINDOW w AS (PARTITION BY device_id, data_type ORDER BY ts, seq
                          ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN n > 1 THEN vp ELSE 0.0 END AS var FROM m),
g AS (SELECT *, CASE WHEN n > 1 AND var > 0 THEN (value - a) / sqrt(var) ELSE 0.0 END AS z,
             CASE WHEN n > 2 THEN coalesce(sl, 0.0) ELSE 0.0 END AS trend,
             CASE WHEN n > 2 THEN ic + sl * x0 ELSE a END AS icpt,
             CASE WHEN n > 2 THEN coalesce(r2, 0.0) ELSE 0.0 END AS rsq
      FROM f)"""

ORACLE["rolling_regression"] = f"""
WITH {READINGS}, {ROLLING_REG}
SELECT device_id, data_type, seq, n AS history_size, {R('trend')} AS slope, {R('icpt')} AS intercept,
       {R('rsq')} AS r2
FROM g"""

ORACLE["metrics_long"] = f"""
WITH {READINGS}, {ROLLING_REG}
SELECT device_id, data_type, seq, wstart AS window_start, ts AS window_end, metric_type,
       {R('metric_value')} AS metric_value
FROM (
  SELECT device_id, data_type, seq, wstart, ts, 'average_value' AS metric_type, a AS metric_value FROM g
  UNION ALL SELECT device_id, data_type, seq, wstart, ts, 'variance', var FROM g
  UNION ALL SELECT device_id, data_type, seq, wstart, ts, 'std_dev', sqrt(var) FROM g
  UNION ALL SELECT device_id, data_type, seq, wstart, ts, 'trend_coefficient', trend FROM g
  UNION ALL SELECT device_id, data_type, seq, wstart, ts, 'normalized_value', z FROM g
  UNION ALL SELECT device_id, data_type, seq, wstart, ts, 'anomaly_score', abs(z) FROM g)"""

ORACLE["anomaly_class"] = f"""
WITH {READINGS}, {ROLLING}
SELECT device_id, data_type, seq, {R('abs(z)')} AS anomaly_score,
       CASE WHEN abs(z) > 3 THEN 'anomaly' WHEN abs(z) > 2 THEN 'warning' ELSE 'normal' END AS anomaly_class
FROM g"""

ORACLE["contextual_anomaly"] = f"""
WITH {READINGS},
d AS (SELECT *, date_trunc('day', ts) AS period_start FROM readings),
st AS (SELECT device_id, data_type, period_start + INTERVAL 1 DAY AS next_start,
              count(value) AS pn, avg(value) AS pm, stddev_pop(value) AS ps
       FROM d GROUP BY device_id, data_type, period_start)
SELECT d.device_id, d.data_type, d.seq, d.period_start, CAST(coalesce(st.pn, 0) AS BIGINT) AS prev_n,
       {R('st.pm')} AS prev_mean, {R('st.ps')} AS prev_std,
       coalesce(coalesce(st.pn, 0) >= 5 AND NOT isnan(d.value) AND abs(d.value - st.pm) > 3 * st.ps, false)
         AS contextual_anomaly
FROM d LEFT JOIN st ON st.device_id = d.device_id AND st.data_type = d.data_type
                   AND st.next_start = d.period_start"""

ORACLE["last_100"] = f"""
WITH {READINGS}
SELECT device_id, data_type, seq, ts, value, recency_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts DESC, seq DESC) AS recency_rank
  FROM readings) WHERE recency_rank <= 100"""

ORACLE["metrics_with_fallback"] = f"""
WITH {READINGS_NAN},
ok AS (SELECT * FROM readings WHERE NOT isnan(value) AND NOT isinf(value)),
m AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS a, var_pop(value) OVER w AS vp
      FROM ok WINDOW w AS (PARTITION BY device_id, data_type ORDER BY ts, seq
                           ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN n > 1 THEN vp ELSE 0.0 END AS var FROM m)
SELECT device_id, gateway_id, data_type, seq, value AS original_value, n AS history_size,
       {R('a')} AS average_value, {R('var')} AS variance,
       {R('abs(CASE WHEN n > 1 AND var > 0 THEN (value - a) / sqrt(var) ELSE 0.0 END)')} AS anomaly_score,
       true AS metrics_ok
FROM f
UNION ALL
SELECT device_id, gateway_id, data_type, seq, value, NULL, NULL, NULL, NULL, false
FROM readings WHERE isnan(value) OR isinf(value)"""

ORACLE["interval_sum"] = f"""
WITH {READINGS}
SELECT device_id, data_type, time_bucket(INTERVAL 1 HOUR, ts) AS interval_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS interval_end,
       CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS items
FROM readings GROUP BY ALL"""

ORACLE["batch_by_type"] = f"""
WITH {READINGS}
SELECT gateway_id, time_bucket(INTERVAL 30 SECOND, ts) AS flush_start, data_type,
       CAST(count(*) AS BIGINT) AS items, {R('sum(value)')} AS value_sum
FROM readings GROUP BY ALL"""

ORACLE["type_counts"] = f"""
WITH {READINGS}
SELECT data_type, CAST(count(*) AS BIGINT) AS readings FROM readings GROUP BY data_type"""

ORACLE["type_sample"] = f"""
WITH {READINGS}
SELECT data_type, seq, value, sample_rank, CAST(greatest(n - 5, 0) AS BIGINT) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY ts, seq) AS sample_rank,
         count(*) OVER (PARTITION BY data_type) AS n
  FROM readings) WHERE sample_rank <= 5"""

ORACLE["registry_upsert"] = f"""
WITH {READINGS}
SELECT 'gateway' AS entity, gateway_id AS id, arg_max(ts, seq) AS last_seen, max(seq) AS last_seq
FROM readings GROUP BY gateway_id
UNION ALL
SELECT 'device', device_id, arg_max(ts, seq), max(seq) FROM readings GROUP BY device_id"""

ORACLE["mapping_upsert"] = f"""
WITH {READINGS}
SELECT device_id, gateway_id, arg_min(ts, seq) AS first_connected, min(seq) AS first_seq,
       arg_max(ts, seq) AS last_connected, max(seq) AS last_seq
FROM readings GROUP BY device_id, gateway_id"""

PRESENCE = f"""
pe AS (SELECT *, CASE data_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' END AS kind
       FROM readings WHERE data_type IN ('signup', 'error')),
pr AS (SELECT device_id, arg_max(kind, (ts, seq)) AS state, arg_max(ts, (ts, seq)) AS since
       FROM pe GROUP BY device_id)"""

ORACLE["presence"] = f"""
WITH {READINGS}, {PRESENCE}
SELECT device_id, state, since, state = 'connect' AS connected FROM pr"""

ORACLE["connected_for"] = f"""
WITH {READINGS}, {PRESENCE},
e AS (SELECT device_id, since,
             CAST(floor((epoch_us((SELECT max(ts) FROM readings)) - epoch_us(since)) / 1000000) AS BIGINT) AS s
      FROM pr WHERE state = 'connect')
SELECT device_id, since, s AS elapsed_seconds,
       printf('%dh %dm %ds', (s % 86400) // 3600, (s % 3600) // 60, s % 60) AS elapsed_text
FROM e"""

REGS = f"""
dv AS (SELECT device_id, arg_max(ts, seq) AS last_seen FROM readings GROUP BY device_id),
gw AS (SELECT gateway_id, arg_max(ts, seq) AS last_seen FROM readings GROUP BY gateway_id),
mp AS (SELECT DISTINCT device_id, gateway_id FROM readings),
nowt AS (SELECT max(ts) - INTERVAL 1 HOUR AS t FROM readings),
dead_d AS (SELECT device_id FROM dv WHERE last_seen < (SELECT t FROM nowt)),
dead_g AS (SELECT gateway_id FROM gw WHERE last_seen < (SELECT t FROM nowt))"""

ORACLE["inactive_counts"] = f"""
WITH {READINGS}, {REGS}
SELECT 'device' AS entity, CAST(count(*) AS BIGINT) AS inactive FROM dead_d
UNION ALL SELECT 'gateway', CAST(count(*) AS BIGINT) FROM dead_g"""

ORACLE["retention"] = f"""
WITH {READINGS}, {REGS}
SELECT seq, device_id, gateway_id, data_type FROM readings
WHERE device_id NOT IN (SELECT device_id FROM dead_d) AND gateway_id NOT IN (SELECT gateway_id FROM dead_g)"""

ORACLE["retention_report"] = f"""
WITH {READINGS}, {REGS},
c AS (
  SELECT 'measurements' AS table_name, (SELECT count(*) FROM readings) AS b,
         (SELECT count(*) FROM readings WHERE device_id NOT IN (SELECT device_id FROM dead_d)
                                          AND gateway_id NOT IN (SELECT gateway_id FROM dead_g)) AS a
  UNION ALL SELECT 'mappings', (SELECT count(*) FROM mp),
         (SELECT count(*) FROM mp WHERE device_id NOT IN (SELECT device_id FROM dead_d)
                                    AND gateway_id NOT IN (SELECT gateway_id FROM dead_g))
  UNION ALL SELECT 'devices', (SELECT count(*) FROM dv), (SELECT count(*) FROM dv) - (SELECT count(*) FROM dead_d)
  UNION ALL SELECT 'gateways', (SELECT count(*) FROM gw), (SELECT count(*) FROM gw) - (SELECT count(*) FROM dead_g))
SELECT table_name, CAST(b AS BIGINT) AS before_rows, CAST(a AS BIGINT) AS after_rows,
       CAST(b - a AS BIGINT) AS removed_rows FROM c"""

CONTROL = """control_ AS (
  SELECT ['click', 'view', 'purchase', 'signup', 'error'][1 + user_id % 5] AS data_type, ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'subscribe' ELSE 'unsubscribe' END AS action
  FROM events WHERE event_type IN ('signup', 'error')),
control AS (SELECT data_type, ts, arg_max(action, seq) AS action FROM control_ GROUP BY data_type, ts),
subs AS (
  SELECT coalesce(l.data_type, t.data_type) AS data_type
  FROM (SELECT 'signup' AS data_type) t
  FULL JOIN (SELECT data_type, arg_max(action, ts) AS last_action FROM control GROUP BY data_type) l
    ON l.data_type = t.data_type
  WHERE coalesce(l.last_action = 'subscribe', true))"""

ORACLE["current_subscriptions"] = f"""
WITH {READINGS}, {CONTROL}
SELECT data_type FROM subs"""

ORACLE["subscribed_readings"] = f"""
WITH {READINGS}, {CONTROL}
SELECT seq, data_type AS topic,
       'JSON:{{"DataType":"' || data_type || '","Value":' || CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR)
         || ',"WavyId":"' || device_id || '"}}' AS message
FROM readings WHERE data_type IN (SELECT data_type FROM subs)"""

ORACLE["subscription_gate"] = f"""
WITH {READINGS}, {CONTROL}
SELECT r.seq, r.data_type, c.action AS gate_action,
       coalesce(c.action = 'subscribe', r.data_type IN ('signup')) AS subscribed
FROM readings r ASOF LEFT JOIN control c ON r.data_type = c.data_type AND r.ts >= c.ts"""

VTEXT = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
JSON_READING = ("""'{"DataType":"' || data_type || '","Value":' || CAST(value AS VARCHAR) || ',"WavyId":"' """
                """|| device_id || '"}'""")
XML_READING = (f"""'<?xml version="1.0" encoding="utf-16"?>' || chr(10) || '<SensorData WavyId="' || device_id """
               f"""|| '">' || chr(10) || '  <DataType>' || data_type || '</DataType>' || chr(10) || '  <Value>' """
               f"""|| {VTEXT} || '</Value>' || chr(10) || '</SensorData>'""")
DEVICE_ITEM = ("""'{"WavyId":"' || device_id || '","Data":[{"DataType":"' || data_type || '","Value":' """
               """|| CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || '}]}'""")

ORACLE["decode_frames"] = f"""
WITH {READINGS},
f AS (SELECT *, CASE data_type WHEN 'signup' THEN 101 WHEN 'error' THEN 501 ELSE 201 END AS code FROM readings)
SELECT seq, CAST(code AS BIGINT) AS code,
       CASE WHEN code = 201 THEN {DEVICE_ITEM} ELSE device_id END AS payload,
       CAST(NULL AS VARCHAR) AS reject_reason
FROM f
UNION ALL SELECT -1, NULL, NULL, 'malformed frame'
UNION ALL SELECT -2, 999, 'x', NULL
UNION ALL SELECT -3, 101, 'a' || chr(65533) || 'b', NULL"""

ORACLE["route_messages"] = f"""
WITH {READINGS}
SELECT seq, CASE data_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect'
                 ELSE 'device_data' END AS kind, CAST(NULL AS VARCHAR) AS reject_reason
FROM readings
UNION ALL SELECT -1, NULL, 'malformed frame'
UNION ALL SELECT -2, NULL, 'unknown code'
UNION ALL SELECT -3, 'connect', NULL"""

ORACLE["parse_device_batch"] = f"""
WITH {READINGS}
SELECT seq // 8 AS batch_id, device_id, data_type, value, CAST(NULL AS VARCHAR) AS reject_reason FROM readings
UNION ALL SELECT -1, NULL, NULL, NULL, 'missing WavyId or Data'
UNION ALL SELECT -2, 'x', NULL, NULL, 'missing WavyId or Data'
UNION ALL SELECT -3, 'x', NULL, 1, 'missing DataType'
UNION ALL SELECT -3, 'x', 'view', NULL, NULL
UNION ALL SELECT -3, 'x', 'view', NULL, 'Value is not a number'
UNION ALL SELECT -3, 'x', NULL, NULL, 'DataType is not text'
UNION ALL SELECT -4, NULL, NULL, NULL, 'malformed json'
UNION ALL SELECT -5, NULL, NULL, NULL, 'malformed json'"""

ORACLE["parse_optional_batch"] = f"""
WITH {READINGS}
SELECT seq // 8 AS batch_id, CASE WHEN (seq // 8) % 5 = 0 THEN 'item-own' ELSE device_id END AS device_id,
       data_type, value, CAST(NULL AS VARCHAR) AS reject_reason
FROM readings
UNION ALL SELECT -1, NULL, NULL, NULL, 'missing DataType'
UNION ALL SELECT -2, NULL, 'view', NULL, 'Value is not a number'
UNION ALL SELECT -3, NULL, NULL, NULL, 'malformed json'
UNION ALL SELECT -4, NULL, 'view', NULL, NULL"""

ORACLE["parse_gateway_batch"] = f"""
WITH {READINGS}
SELECT gateway_id AS aggregator_id, min(ts) OVER (PARTITION BY gateway_id, seq // 8) AS batch_time,
       data_type, device_id, value, CAST(NULL AS VARCHAR) AS reject_reason
FROM readings
UNION ALL SELECT '9', TIMESTAMP '2024-01-01 00:00:00', 'view', NULL, NULL, 'missing Data'
UNION ALL SELECT '9', TIMESTAMP '2024-01-01 00:00:00', 'view', 'Unknown', NULL, 'item is not an object'
UNION ALL SELECT '9', TIMESTAMP '2024-01-01 00:00:00', 'view', 'd', NULL, 'no valid value'
UNION ALL SELECT '9', TIMESTAMP '2024-01-01 00:00:00', 'view', 'Unknown', CAST(2.5 AS DOUBLE), NULL
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'malformed json'
UNION ALL SELECT '9', NULL, 'view', NULL, NULL, 'bad Timestamp'"""

ORACLE["detect_format"] = f"""
WITH {READINGS}
SELECT seq, CASE WHEN seq % 3 = 0 THEN 'XML' ELSE 'JSON' END AS format,
       CASE WHEN seq % 3 = 0 THEN {XML_READING} ELSE {JSON_READING} END AS content
FROM readings
UNION ALL SELECT -1, 'JSON', '{{not json'"""

ORACLE["decode_xml"] = f"""
WITH {READINGS}
SELECT seq, device_id, data_type, value FROM readings WHERE seq % 3 = 0"""

ORACLE["decode_json"] = f"""
WITH {READINGS}
SELECT r.seq, r.device_id, r.data_type, r.value, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k
FROM readings r JOIN events e ON e.event_id = r.seq WHERE r.seq % 3 <> 0"""

ORACLE["encode_json"] = f"""
WITH {READINGS}
SELECT seq, {JSON_READING} AS payload FROM readings"""

ORACLE["encode_xml"] = f"""
WITH {READINGS}
SELECT seq, {XML_READING} AS payload FROM readings"""

ORACLE["extract_strict"] = f"""
WITH {READINGS}
SELECT seq,
       CASE seq % 6 WHEN 0 THEN device_id WHEN 1 THEN device_id WHEN 3 THEN device_id ELSE 'Unknown' END AS device_id,
       CASE WHEN seq % 6 IN (3, 4) THEN NULL ELSE value END AS value
FROM readings"""

ORACLE["extract_lenient"] = f"""
WITH {READINGS}
SELECT seq,
       CASE seq % 6 WHEN 0 THEN device_id WHEN 1 THEN 'Unknown' WHEN 2 THEN '' WHEN 3 THEN device_id
                    WHEN 4 THEN 'Unknown' ELSE NULL END AS device_id,
       CASE WHEN seq % 6 IN (2, 3, 4) THEN 0.0 ELSE value END AS value
FROM readings"""

ORACLE["table_counts"] = """
SELECT 'region' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM region
UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'part', count(*) FROM part
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'embeddings', count(*) FROM embeddings
UNION ALL SELECT 'pages', count(*) FROM pages
UNION ALL SELECT 'benchmark', count(*) FROM benchmark
UNION ALL SELECT 'labels', count(*) FROM labels
UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'measurements', -1"""

ORACLE["history_range"] = f"""
WITH {READINGS}
SELECT seq, device_id, data_type, value, epoch_us(ts) // 1000 AS ts_ms,
       epoch_ms(epoch_us(ts) // 1000) AS ts_roundtrip
FROM readings
WHERE device_id = '3' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"""

ORACLE["resend_dedupe"] = f"""
WITH {READINGS}
SELECT DISTINCT seq // 8 AS batch_id, device_id,
       CAST(CASE WHEN (seq // 8) % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies, CAST(201 AS BIGINT) AS kept_code
FROM readings"""

# Streams: the same statements as the batch twins.
ORACLE["stream_flush"] = ORACLE["batch_by_type"]
ORACLE["stream_interval_sum"] = ORACLE["interval_sum"]
ORACLE["stream_publish"] = "SELECT topic, message FROM (" + ORACLE["subscribed_readings"] + ")"
ORACLE["stream_ingest"] = f"""
WITH {READINGS},
e AS (SELECT *, seq // 8 * 3 + CAST(gateway_id AS BIGINT) AS envelope_id, min(ts) OVER (PARTITION BY seq // 8, gateway_id) AS sent FROM readings)
SELECT envelope_id, device_id, gateway_id, data_type, value, count(*) OVER w AS history_size, {R('avg(value) OVER w')} AS average_value
FROM e WINDOW w AS (PARTITION BY device_id, data_type ORDER BY sent, envelope_id, seq ROWS 99 PRECEDING)"""
ORACLE["stream_upsert"] = ORACLE["registry_upsert"]
ORACLE["stored_mapping"] = ORACLE["mapping_upsert"]
ORACLE["retention_delete"] = ORACLE["retention_report"]
ORACLE["stream_late"] = f"""
WITH {READINGS},
w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS interval_start FROM readings),
newest AS (SELECT max(ts) AS t FROM readings WHERE seq % 7 <> 0)
SELECT device_id, data_type, interval_start, interval_start + INTERVAL 1 HOUR AS interval_end,
       CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS items,
       count(*) FILTER (seq % 7 = 0 AND interval_start + INTERVAL 1 HOUR <= t - INTERVAL 1 MINUTE) AS late_items
FROM w, newest GROUP BY device_id, data_type, interval_start"""
ORACLE["stream_presence"] = ORACLE["presence"]
ORACLE["stream_metrics"] = ORACLE["rolling_metrics"]
ORACLE["stream_validate"] = ORACLE["replace_nonfinite"]
ORACLE["stream_type_average"] = ORACLE["history_pool"]

ORACLE["stream_gate"] = f"""
WITH {READINGS}, {CONTROL}
SELECT seq, data_type, device_id FROM readings WHERE data_type IN (SELECT data_type FROM subs)"""

# An inactivity period is reported once: the next reading comes more than an
# hour later, or there is none and the final watermark passed last + 1 h.
ORACLE["stream_inactivity"] = f"""
WITH {READINGS},
d AS (SELECT device_id, ts, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS nxt FROM readings)
SELECT device_id, ts AS inactive_since FROM d
WHERE (nxt IS NOT NULL AND nxt - ts > INTERVAL 1 HOUR)
   OR (nxt IS NULL AND epoch_us(ts) // 1000 + 3600000
       < (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM readings))"""

ORACLE["stream_atomic_write"] = f"""
WITH {READINGS}
SELECT seq // 8 AS batch_id, device_id, data_type, value FROM readings"""

ORACLE["metrics_table"] = ORACLE["rolling_metrics"]

ORACLE["subscription_file"] = f"""
WITH {READINGS}, {CONTROL}
SELECT 'default' AS stage, 'signup' AS data_type
UNION ALL SELECT 'saved', data_type FROM subs"""

ORACLE["topic_prefix_gate"] = f"""
WITH {READINGS}, {CONTROL},
topics AS (SELECT substr(data_type, 1, 1) AS t FROM subs UNION ALL SELECT 'v')
SELECT seq, data_type FROM readings r
WHERE EXISTS (SELECT 1 FROM topics WHERE starts_with(r.data_type, topics.t))"""
ORACLE["stream_metrics_batched"] = ORACLE["rolling_metrics"]

GAPS = """readings AS (
  SELECT CASE WHEN event_id % 11 <> 0 THEN CAST(user_id % 10 AS VARCHAR) END AS device_id,
         CAST(event_id % 3 AS VARCHAR) AS gateway_id,
         CASE WHEN event_id % 17 <> 0 THEN event_type END AS data_type, CAST(value AS DOUBLE) AS value,
         CASE WHEN event_id % 13 <> 0 THEN ts END AS ts, event_id AS seq
  FROM events)"""

ORACLE["rolling_metrics_gaps"] = f"""
WITH {GAPS}
SELECT device_id, data_type, seq, count(value) OVER w AS history_size, {R('avg(value) OVER w')} AS average_value,
       {R('CASE WHEN count(value) OVER w > 1 THEN var_pop(value) OVER w ELSE 0.0 END')} AS variance
FROM readings WINDOW w AS (PARTITION BY device_id, data_type ORDER BY ts NULLS FIRST, seq
                           ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""

GAP_HISTORY = HISTORY.replace("ORDER BY ts, seq", "ORDER BY ts NULLS FIRST, seq").replace(
    "ON h.hd = o.device_id AND h.ht = o.data_type", "ON h.hd IS NOT DISTINCT FROM o.device_id AND h.ht IS NOT DISTINCT FROM o.data_type")

ORACLE["validate_gaps"] = f"""
WITH {GAPS}, {RULES}, {CLEAN}, {GAP_HISTORY},
last AS (SELECT seq, row_number() OVER (PARTITION BY device_id, data_type ORDER BY ts DESC NULLS LAST, seq DESC) AS recency_rank
         FROM readings)
SELECT va.seq, CAST(hk AS BIGINT) AS history_size, {R('hmean')} AS history_mean,
       CASE WHEN recency_rank <= 100 THEN recency_rank END AS recency_rank
FROM va JOIN last ON last.seq = va.seq"""

ORACLE["tag_reading"] = f"""
WITH {GAPS}
SELECT seq, data_type, value, device_id, coalesce(ts, (SELECT max(ts) FROM events)) AS ts FROM readings"""

ORACLE["slim_items"] = f"""
WITH {READINGS}
SELECT seq, '{{"Value":' || CAST(value AS VARCHAR) || ',"WavyId":"' || device_id || '"}}' AS item FROM readings"""

ORACLE["batch_envelopes"] = f"""
WITH {READINGS},
t AS (SELECT gateway_id, time_bucket(INTERVAL 30 SECOND, ts) AS flush_start, data_type,
             string_agg('{{"Value":' || CAST(value AS VARCHAR) || ',"WavyId":"' || device_id || '"}}', ',' ORDER BY ts, seq) AS items
      FROM readings GROUP BY ALL)
SELECT gateway_id, flush_start,
       '[' || string_agg('{{"DataType":"' || data_type || '","Data":[' || items || ']}}', ',' ORDER BY data_type) || ']' AS payload
FROM t GROUP BY gateway_id, flush_start"""

ORACLE["decode_xml_general"] = f"""
WITH {READINGS}
SELECT seq, CAST(CASE seq % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 0 END AS BIGINT) AS fields,
       CASE WHEN seq % 4 < 2 THEN device_id END AS device_id, CASE WHEN seq % 4 = 0 THEN '1 & "2"' END AS a,
       CASE seq % 4 WHEN 0 THEN '<m&' WHEN 1 THEN 'x' END AS unit, CASE WHEN seq % 4 < 2 THEN value END AS value
FROM readings"""

ORACLE["stream_envelopes"] = ORACLE["batch_envelopes"]
