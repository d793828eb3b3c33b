"""Independent SQL for the queries of `registry`, written from the definitions by brute force (DuckDB)."""

from __future__ import annotations

LINES = """
l AS (SELECT event_id AS seq, 't' || (user_id % 2) AS tenant_id, event_type AS device_key, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  length(props) + length(event_type) AS byte_len, 'u' || user_id AS usr, json_extract_string(props, '$.k') AS k FROM events),
lw AS (SELECT *, ts - ((ts % 3600) + 3600) % 3600 AS ws FROM l)"""

ROWS = (
    LINES
    + """,
r AS (SELECT tenant_id, device_key, ws, ws + 3600 AS we,
  CAST((CASE WHEN dayofweek(make_timestamp(ws * 1000000)) IN (0, 6) THEN 24 ELSE 0 END) + hour(make_timestamp(ws * 1000000)) AS INTEGER) AS bucket,
  count(*) AS lines, CAST(sum(byte_len) AS BIGINT) AS bytes FROM lw GROUP BY ALL),
e AS (SELECT tenant_id, device_key, ws, seq, ts, unnest([{f: 'w=' || device_key, o: 4, w: 0.3}, {f: 'User=' || usr, o: 0, w: 1.0}, {f: 'k=k', o: 2, w: 0.5},
  {f: 'canon=User', o: 3, w: 0.5}, {f: 'SourceIp_net@10.0.' || k || '.0/24', o: 1, w: 0.8}]) AS x FROM lw),
rf AS (SELECT tenant_id, device_key, ws, x.f AS feature, CAST(x.w AS DOUBLE) AS w, count(*) AS n FROM e GROUP BY ALL)"""
)

# position of every row, and the day each slot holds before it
RING = (
    ROWS
    + """,
p AS (SELECT *, CAST(floor(ws / 86400) AS BIGINT) AS day, row_number() OVER (PARTITION BY tenant_id ORDER BY ws, device_key) AS pos FROM r),
h AS (SELECT p.*, s.slot, max(CASE WHEN day % 7 = s.slot THEN day END) OVER (PARTITION BY tenant_id, s.slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
  FROM p, (SELECT unnest(range(7)) AS slot) s),
seen AS (SELECT h.tenant_id, h.device_key, h.ws, q.device_key AS qd, q.ws AS qw FROM h JOIN p q ON q.tenant_id = h.tenant_id AND q.bucket = h.bucket AND q.day = h.held AND q.pos < h.pos),
nb AS (SELECT r.tenant_id, r.device_key, r.ws, count(s.ws) AS n_bucket FROM r LEFT JOIN seen s USING (tenant_id, device_key, ws) GROUP BY ALL),
dfs AS (SELECT s.tenant_id, s.device_key, s.ws, f.feature, count(*) AS df FROM seen s JOIN rf f ON f.tenant_id = s.tenant_id AND f.device_key = s.qd AND f.ws = s.qw GROUP BY ALL),
fx AS (SELECT rf.*, nb.n_bucket, coalesce(dfs.df, 0) AS df, CAST(CAST(rf.w * ln(1 + rf.n) AS FLOAT) AS DOUBLE) AS tf,
  ln((nb.n_bucket + 1.0) / (coalesce(dfs.df, 0) + 1.0)) + 1 AS idf FROM rf JOIN nb USING (tenant_id, device_key, ws) LEFT JOIN dfs USING (tenant_id, device_key, ws, feature)),
ra AS (SELECT tenant_id, device_key, ws, 1 - exp(-sum(tf * idf) / sum(tf)) AS rarity FROM fx GROUP BY ALL)"""
)

STATS = """,
st AS (SELECT r.*, count(q.ws) AS stats_n, coalesce(avg(q.lines), 0) AS lines_mean, coalesce(var_samp(q.lines), 0) AS lines_var, coalesce(avg(q.bytes), 0) AS bytes_mean,
  coalesce(var_samp(q.bytes), 0) AS bytes_var, coalesce(stddev_samp(q.lines), 0) AS sd_lines
  FROM r LEFT JOIN r q ON q.tenant_id = r.tenant_id AND q.device_key = r.device_key AND q.bucket = r.bucket AND q.ws < r.ws GROUP BY ALL)"""

CENTROID = """,
nr AS (SELECT r.*, row_number() OVER (PARTITION BY tenant_id, device_key, bucket ORDER BY ws) AS i FROM r),
nf AS (SELECT nr.tenant_id, nr.device_key, nr.bucket, nr.ws, nr.i, rf.feature, CAST(CAST(rf.w * ln(1 + rf.n) AS FLOAT) AS DOUBLE) AS x FROM nr JOIN rf USING (tenant_id, device_key, ws)),
cen AS (SELECT nr.tenant_id, nr.device_key, nr.ws, g.feature, sum(0.5 * pow(0.5, nr.i - 1 - g.i) * g.x) AS c FROM nr JOIN nf g ON g.tenant_id = nr.tenant_id AND g.device_key = nr.device_key
  AND g.bucket = nr.bucket AND g.i < nr.i GROUP BY ALL),
cn AS (SELECT tenant_id, device_key, ws, sum(c * c) AS centroid_norm2 FROM cen GROUP BY ALL),
dt AS (SELECT nf.tenant_id, nf.device_key, nf.ws, sum(nf.x * coalesce(cen.c, 0)) AS dot, sum(nf.x * nf.x) AS row_norm2 FROM nf LEFT JOIN cen USING (tenant_id, device_key, ws, feature) GROUP BY ALL),
dr AS (SELECT r.tenant_id, r.device_key, r.ws, dt.dot, dt.row_norm2, coalesce(cn.centroid_norm2, 0) AS centroid_norm2 FROM r JOIN dt USING (tenant_id, device_key, ws) LEFT JOIN cn USING (tenant_id, device_key, ws))"""

SCORES = """,
z AS (SELECT tenant_id, device_key, ws, least(1, greatest(0, greatest(
  CASE WHEN stats_n < 2 OR lines_var <= 1e-12 THEN 0 ELSE greatest(0, (lines - lines_mean) / sqrt(lines_var)) END,
  CASE WHEN stats_n < 2 OR bytes_var <= 1e-12 THEN 0 ELSE greatest(0, (bytes - bytes_mean) / sqrt(bytes_var)) END) / 6)) AS volume FROM st),
sc AS (SELECT r.*, nb.n_bucket, ra.rarity, CASE WHEN dr.row_norm2 <= 1e-24 OR dr.centroid_norm2 <= 1e-24 THEN 0 ELSE 1 - least(1, greatest(0, dr.dot / (sqrt(dr.row_norm2) * sqrt(dr.centroid_norm2)))) END AS drift,
  z.volume, sqrt(dr.centroid_norm2) AS centroid_norm, dr.centroid_norm2 <= 0 OR nb.n_bucket < 2 AS cold_start
  FROM r JOIN nb USING (tenant_id, device_key, ws) JOIN ra USING (tenant_id, device_key, ws) JOIN dr USING (tenant_id, device_key, ws) JOIN z USING (tenant_id, device_key, ws)),
tot AS (SELECT *, 0.45 * rarity + 0.40 * drift + 0.15 * volume AS total FROM sc)"""

ALERTS = """,
rk AS (SELECT *, CAST(tf * idf AS FLOAT) AS contrib, row_number() OVER (PARTITION BY tenant_id, device_key, ws ORDER BY CAST(tf * idf AS FLOAT) DESC, feature) AS rank FROM fx),
tf AS (SELECT tenant_id, device_key, ws, bool_or(df = 0) AS fresh, bool_or(df > 0 AND df / n_bucket < 0.001) AS rare,
  bool_or(feature LIKE 'User=%' OR feature = 'canon=User' OR feature LIKE 'SourceIp%') AS entity_focus FROM rk WHERE rank <= 25 GROUP BY ALL),
lb AS (SELECT tot.*, tf.*, CASE WHEN NOT cold_start AND total >= 0.75 AND (entity_focus OR drift >= 0.25) THEN 'outlier'
  WHEN total >= 0.5 OR (cold_start AND volume >= 0.9) THEN 'info' END AS label FROM tot JOIN tf USING (tenant_id, device_key, ws)),
al AS (SELECT *, list_filter([CASE WHEN fresh THEN 'R_NEW_FEATURE' END, CASE WHEN n_bucket > 0 AND rare THEN 'R_RARE_FEATURE' END,
  CASE WHEN drift > 0.35 THEN 'D_HIGH_DRIFT' WHEN drift > 0.25 THEN 'D_MED_DRIFT' END, CASE WHEN volume > 0.9 THEN 'V_EXTREME' WHEN volume > 0.7 THEN 'V_SPIKE' END,
  CASE WHEN label = 'outlier' AND entity_focus THEN 'O_ENTITY_FOCUSED' END], lambda c: c IS NOT NULL) AS codes FROM lb WHERE label IS NOT NULL),
alerts AS (SELECT *, CASE WHEN NOT cold_start AND label = 'outlier' AND len(codes) >= 2 AND entity_focus THEN 'high' WHEN NOT cold_start AND total >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM al)"""

STATE = """,
dl AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_key ORDER BY we DESC, ws DESC) AS k FROM r),
tl AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY we DESC, ws DESC, device_key DESC) AS k FROM r),
es AS (SELECT 1 AS subject_kind, tenant_id, device_key AS subject_key, 3600::BIGINT AS window_size_s, count(*) AS observed_windows, count(*) FILTER (lines >= 2) AS mature_windows,
  max(ws) FILTER (k = 1) AS last_ws, max(we) FILTER (k = 1) AS last_we, max(lines) FILTER (k = 1) AS last_lines, max(bytes) FILTER (k = 1) AS last_bytes, max(bucket) FILTER (k = 1) AS last_bucket, max(we) AS last_update_ts FROM dl GROUP BY ALL
  UNION ALL SELECT 2, tenant_id, tenant_id, 3600::BIGINT, count(*), count(*) FILTER (lines >= 2), max(ws) FILTER (k = 1), max(we) FILTER (k = 1), max(lines) FILTER (k = 1), max(bytes) FILTER (k = 1), max(bucket) FILTER (k = 1), max(we) FROM tl GROUP BY ALL),
hs AS (SELECT *, CAST(floor((1706745600 - last_we) / 3600) AS BIGINT) AS m FROM es),
hv AS (SELECT *, CASE WHEN mature_windows < 5 THEN 'NotMature' WHEN 1706745600 <= last_we THEN 'NotSilent' WHEN m < 3 THEN 'NotEnoughMissedWindows' WHEN last_lines * m < 10 THEN 'BelowExpectedLineFloor' END AS suppression FROM hs)"""


def _drop(maturity: int) -> str:
    return f"""CASE WHEN mean_lines <= 0 THEN 'InvalidExpectedVolume' WHEN maturity < {maturity} THEN 'NotMature' WHEN mean_lines < 2 THEN 'BelowExpectedLineFloor'
  WHEN lines = 0 THEN 'HardSilencePriority' WHEN mean_lines - lines < 1 THEN 'AbsoluteDropBelowFloor' WHEN CAST(lines / mean_lines AS FLOAT) > CAST(0.6 AS FLOAT) THEN 'ObservedRatioAboveThreshold'
  WHEN CAST(1 - lines / mean_lines AS FLOAT) < CAST(0.4 AS FLOAT) THEN 'DropRatioBelowThreshold' WHEN sd_lines > 1e-12 AND CAST((mean_lines - lines) / sd_lines AS FLOAT) < CAST(0.5 AS FLOAT) THEN 'VarianceGateNotMet' END"""


DROPS = (
    STATS
    + f""",
dv AS (SELECT *, {_drop(3)} AS suppression FROM (SELECT tenant_id, device_key, ws, we, bucket, lines, bytes, stats_n AS maturity, lines_mean AS mean_lines, bytes_mean AS mean_bytes, sd_lines FROM st))"""
)

# rendered lines and what they say, from the columns
RAW = """
c AS (SELECT event_id AS seq, event_id % 5 AS form, 't' || (user_id % 2) AS tenant_id, event_type AS device_key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'host' || (user_id % 8) AS host,
  CAST(1000 + user_id % 50 AS VARCHAR) AS pid, 'ID' || (event_id % 10000) AS mid, 10 AS a, user_id % 4 AS b, user_id % 250 AS c3, 1 + event_id % 200 AS d, 'u' || user_id AS usr, CAST(trunc(value) AS BIGINT) AS amount,
  json_extract_string(props, '$.k') AS k FROM events),
c2 AS (SELECT *, '10.' || b || '.' || c3 || '.' || d AS ip, '10.' || b || '.' || c3 || '.0' AS net,
  'src_ip=10.' || b || '.' || c3 || '.' || d || ' user=' || usr || ' action=' || device_key || ' bytes=' || amount || ' path=/obj/' || k AS pairs, CASE WHEN form = 2 THEN 0 ELSE ts END AS t FROM c),
c4 AS (SELECT *, t - t % 3600 AS ws FROM c2)"""

FEATURES = (
    RAW
    + """,
pf AS (SELECT tenant_id, device_key, ws, unnest(CASE
  WHEN form IN (0, 3) THEN list_concat(['k=src_ip', 'k=user', 'k=action', 'k=bytes', 'k=path', 'canon=SourceIp', 'canon=User', 'canon=Path', 'SourceIp=<IPV4>', 'SourceIp_net@' || net || '/24', 'User=' || usr, 'Path=<UNIX_PATH>',
    'syslog_app=' || device_key], CASE WHEN form = 0 THEN ['syslog_pri=34', 'syslog_ver=1'] ELSE ['syslog_pri=13'] END)
  WHEN form = 1 THEN ['k=src_ip', 'k=user', 'k=action', 'k=n_bytes', 'canon=SourceIp', 'canon=User', 'SourceIp=<IPV4>', 'SourceIp_net@' || net || '/24', 'User=' || usr]
  WHEN form = 2 THEN list_concat(['k=src_ip', 'k=suser', 'k=msg', 'canon=SourceIp', 'SourceIp=<IPV4>', 'SourceIp_net@' || net || '/24'],
    ['w=' || x FOR x IN ['version', 'device_vendor', 'acme', 'device_product', 'gate', 'device_version', '1.0', 'signature_id', '100', 'name', device_key, 'severity']])
  ELSE ['syslog_app=' || device_key, 'w=user', 'w=' || usr, 'w=came', 'w=from', 'w=' || ip, 'w=today', 'shape=<IPV4>'] END) AS feature FROM c4)"""
)

SQL = {
    "rarity": f"WITH {RING} SELECT tenant_id, device_key, ws, n_bucket, round(rarity, 6) AS rarity FROM ra JOIN nb USING (tenant_id, device_key, ws)",
    "window_rows": f"WITH {ROWS} SELECT * FROM r",
    "row_features": f"""WITH {ROWS} SELECT tenant_id, device_key, ws, feature, n, w AS weight, CASE WHEN feature LIKE 'w=%' THEN 'Word' WHEN feature LIKE 'User=%' THEN 'Shape' WHEN feature LIKE 'k=%' THEN 'KeyPres'
        WHEN feature LIKE 'canon=%' THEN 'Canon' ELSE 'Bucket' END AS family FROM rf""",
    "entity_topk": f"""WITH {LINES}, d AS (SELECT tenant_id, device_key, ts - ts % 86400 AS ws, unnest([{{kind: 'UserId', value: usr}}, {{kind: 'SourceIp', value: '10.0.' || k || '.1'}}], recursive := true) FROM l),
        c AS (SELECT *, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_key, ws, kind ORDER BY n DESC, value) AS rank FROM c)
        SELECT * FROM t WHERE rank <= CASE kind WHEN 'UserId' THEN 5 ELSE 3 END""",
    "feature_caps": f"""WITH {ROWS}, g AS (SELECT tenant_id, device_key, ts - ts % 86400 AS d, x.f AS feature, x.o AS o, count(*) AS n, min(seq) AS s FROM e GROUP BY ALL),
        k AS (SELECT *, o IN (0, 4) AND row_number() OVER (PARTITION BY tenant_id, device_key, d, o ORDER BY s, feature) > CASE o WHEN 0 THEN 6 ELSE 1 END AS full_ FROM g),
        m AS (SELECT *, NOT full_ AND row_number() OVER (PARTITION BY tenant_id, device_key, d, full_ ORDER BY s, o, feature) <= 12 AS kept FROM k)
        SELECT tenant_id, device_key, d AS ws, count(*) FILTER (kept) AS features, CAST(sum(n) FILTER (kept) AS BIGINT) AS uses, CAST(coalesce(sum(n) FILTER (NOT kept AND o <> 4), 0) AS BIGINT) AS dropped_features,
        CAST(coalesce(sum(n) FILTER (NOT kept AND o = 4), 0) AS BIGINT) AS dropped_words, 0::BIGINT AS dropped_shapes FROM m GROUP BY ALL""",
    "df_ring": f"WITH {RING} SELECT tenant_id, device_key, ws, feature, df FROM fx",
    "df_ring_windows": f"WITH {RING} SELECT * FROM nb",
    "drift": f"WITH {ROWS}{CENTROID} SELECT tenant_id, device_key, ws, round(dot, 5) AS dot, round(row_norm2, 5) AS row_norm2, round(centroid_norm2, 5) AS centroid_norm2 FROM dr",
    "scores": f"""WITH {RING}{STATS}{CENTROID}{SCORES} SELECT tenant_id, device_key, ws, round(rarity, 5) AS rarity, round(drift, 5) AS drift, round(volume, 5) AS volume, round(total, 5) AS total, cold_start,
        round(centroid_norm, 5) AS centroid_norm FROM tot""",
    "resumed_scores": f"""WITH {RING}{STATS}{CENTROID}{SCORES} SELECT tot.tenant_id, tot.device_key, tot.ws, st.stats_n, round(tot.rarity, 5) AS rarity, round(tot.drift, 5) AS drift, round(tot.volume, 5) AS volume, round(tot.total, 5) AS total,
        tot.cold_start, round(tot.centroid_norm, 5) AS centroid_norm FROM tot JOIN st ON st.tenant_id = tot.tenant_id AND st.device_key = tot.device_key AND st.ws = tot.ws""",
    "baseline_groups": f"""WITH {ROWS} SELECT tenant_id, device_key, bucket, count(*) AS n, max(ws) AS last_ws, round(avg(lines), 4) AS lines_mean, round(var_pop(lines) * count(*), 4) AS lines_m2,
        round(avg(bytes), 4) AS bytes_mean, round(var_pop(bytes) * count(*), 4) AS bytes_m2 FROM r GROUP BY ALL""",
    "volume_stats": f"WITH {ROWS}{STATS} SELECT tenant_id, device_key, ws, stats_n, round(lines_mean, 6) AS lines_mean, round(lines_var, 6) AS lines_var, round(bytes_mean, 6) AS bytes_mean, round(bytes_var, 6) AS bytes_var FROM st",
    "final_stats": f"""WITH {ROWS} SELECT tenant_id, device_key, bucket, count(*) AS n, max(ws) AS last_ws, round(avg(lines), 4) AS lines_mean, round(sum(lines * lines) - count(*) * avg(lines) * avg(lines), 4) AS lines_m2,
        round(avg(bytes), 4) AS bytes_mean, round(var_pop(bytes) * count(*), 4) AS bytes_m2 FROM r GROUP BY ALL""",
    "row_alerts": f"WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT tenant_id, device_key, ws, label, confidence, entity_focus, cold_start, array_to_string(codes, ',') AS reasons, lines, bytes FROM alerts",
    "top_features": f"WITH {RING}{ALERTS.split('tf AS')[0].rstrip().rstrip(',')} SELECT tenant_id, device_key, ws, rank, n, df, round(CAST(contrib AS DOUBLE), 4) AS contrib FROM rk WHERE rank <= 3",
    "alert_filter": f"""WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT DISTINCT a.tenant_id, a.device_key, a.ws AS window_start_ts, a.label FROM alerts a JOIN lw ON lw.tenant_id = a.tenant_id AND lw.device_key = a.device_key AND lw.ws = a.ws
        WHERE lw.usr = 'u7' AND a.ws >= 1704672000 AND a.ws < 1705881600""",
    "alert_search": f"""WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT tenant_id, device_key, label, count(*) AS n FROM alerts a
        WHERE EXISTS (SELECT 1 FROM rk WHERE rk.tenant_id = a.tenant_id AND rk.device_key = a.device_key AND rk.ws = a.ws AND rank <= 25 AND contains(lower(feature), 'user=u1')) GROUP BY ALL""",
    "alert_counts": f"WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT tenant_id, label, confidence, count(*) AS n, count(*) AS ids FROM alerts GROUP BY ALL",
    "expected_sources": f"WITH {ROWS}{STATE} SELECT * FROM es",
    "hard_silence": f"""WITH {ROWS}{STATE} SELECT subject_kind, tenant_id, subject_key, suppression, CASE WHEN suppression IS NULL THEN m END AS missed, CASE WHEN suppression IS NULL THEN last_lines * m END AS expected_lines,
        CASE WHEN suppression IS NULL THEN last_we END AS window_start_ts, CASE WHEN suppression IS NULL THEN last_we + m * 3600 END AS window_end_ts FROM hv""",
    "sharp_drop": f"""WITH {ROWS}{DROPS} SELECT tenant_id, device_key, ws, suppression, CASE WHEN suppression IS NULL THEN round(lines / mean_lines, 5) END AS ratio, CASE WHEN suppression IS NULL THEN round(1 - lines / mean_lines, 5) END AS drop_ratio,
        CASE WHEN suppression IS NULL THEN round(mean_lines - lines, 5) END AS absolute_drop, CASE WHEN suppression IS NULL AND sd_lines > 1e-12 THEN round((mean_lines - lines) / sd_lines, 5) END AS z_drop FROM dv""",
    "tenant_sharp_drop": f"""WITH {ROWS}{DROPS}, tw AS (SELECT tenant_id, ws, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS maturity, sum(mean_lines) AS mean_lines, sqrt(sum(sd_lines * sd_lines)) AS sd_lines FROM dv
        WHERE maturity >= 3 AND mean_lines >= 2 GROUP BY ALL HAVING count(*) >= 2), tv AS (SELECT *, {_drop(2)} AS suppression FROM tw)
        SELECT tenant_id, ws, maturity, lines, round(mean_lines, 5) AS mean_lines, round(sd_lines, 5) AS sd_lines, suppression, CASE WHEN suppression IS NULL THEN round(1 - lines / mean_lines, 5) END AS drop_ratio FROM tv""",
    "open_drops": f"""WITH {ROWS}{DROPS}, m AS (SELECT *, CASE WHEN suppression IS NULL THEN 1 WHEN suppression IN ('AbsoluteDropBelowFloor', 'ObservedRatioAboveThreshold', 'DropRatioBelowThreshold') THEN 0 END AS mark FROM dv)
        SELECT tenant_id, device_key, ws, lines FROM m WHERE mark = 1 AND coalesce((SELECT arg_max(q.mark, q.ws) FROM m q WHERE q.tenant_id = m.tenant_id AND q.device_key = m.device_key AND q.ws < m.ws AND q.mark IS NOT NULL), 0) = 0""",
    "drop_diagnostics": f"""WITH {ROWS}{STATE}{DROPS}, b AS (SELECT 'silence' AS what, tenant_id, suppression FROM hv UNION ALL SELECT 'sharp_drop', tenant_id, suppression FROM dv)
        SELECT what, tenant_id, count(*) AS evaluated, count(*) FILTER (suppression IS NULL) AS candidates, count(suppression) AS suppressed FROM b GROUP BY GROUPING SETS ((what, tenant_id), (what))""",
    "supplier_volume": """WITH l AS (SELECT l_returnflag AS tenant_id, CAST(l_suppkey AS VARCHAR) AS subject_key, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) * 86400 AS ws FROM lineitem),
        r AS (SELECT *, ws + 86400 AS we, count(*) AS lines FROM l GROUP BY ALL), s AS (SELECT tenant_id, subject_key, count(*) AS observed_windows, max(we) AS last_we, arg_max(lines, we) AS last_lines FROM r GROUP BY ALL),
        m AS (SELECT *, CAST(floor((915148800 - last_we) / 86400) AS BIGINT) AS m FROM s), v AS (SELECT *, CASE WHEN observed_windows < 10 THEN 'NotMature' WHEN 915148800 <= last_we THEN 'NotSilent' WHEN m < 30 THEN 'NotEnoughMissedWindows'
        WHEN last_lines * m < 20 THEN 'BelowExpectedLineFloor' END AS suppression FROM m)
        SELECT tenant_id, subject_key, observed_windows, last_we, last_lines, suppression, CASE WHEN suppression IS NULL THEN m END AS missed, CASE WHEN suppression IS NULL THEN last_lines * m END AS expected_lines FROM v""",
    "envelope": f"""WITH {RAW} SELECT seq, CASE form WHEN 0 THEN 34 WHEN 3 THEN 13 END::BIGINT AS pri, CASE WHEN form = 0 THEN 1 END::BIGINT AS version, CASE WHEN form <> 2 THEN ts END AS ts, CASE WHEN form IN (0, 3, 4) THEN host END AS host,
        CASE WHEN form IN (0, 3, 4) THEN device_key END AS app, CASE WHEN form IN (0, 3) THEN pid END AS procid, CASE WHEN form = 0 THEN mid END AS msgid,
        CASE form WHEN 1 THEN '{{"src_ip":"' || ip || '","user":"' || usr || '","action":"' || device_key || '","n":{{"bytes":' || amount || '}}}}'
          WHEN 2 THEN 'CEF:0|acme|gate|1.0|100|' || device_key || '|5|src_ip=' || ip || ' suser=' || usr || ' msg=took ' || amount || ' units'
          WHEN 4 THEN 'user ' || usr || ' came from ' || ip || ' today' ELSE pairs END AS msg FROM c2""",
    "tokens": f"""WITH {RAW}, t AS (SELECT unnest(CASE WHEN form IN (0, 3) THEN [{{kind: 'kv', key: 'src_ip', value: ip}}, {{kind: 'kv', key: 'user', value: usr}}, {{kind: 'kv', key: 'action', value: device_key}},
          {{kind: 'kv', key: 'bytes', value: amount::VARCHAR}}, {{kind: 'kv', key: 'path', value: '/obj/' || k}}]
        WHEN form = 1 THEN [{{kind: 'json', key: 'src_ip', value: ip}}, {{kind: 'json', key: 'user', value: usr}}, {{kind: 'json', key: 'action', value: device_key}}, {{kind: 'json', key: 'n_bytes', value: amount::VARCHAR}}]
        WHEN form = 2 THEN [{{kind: 'kv', key: 'src_ip', value: ip}}, {{kind: 'kv', key: 'suser', value: usr}}, {{kind: 'kv', key: 'msg', value: 'took ' || amount || ' units'}}, {{kind: 'cef', key: 'version', value: '0'}},
          {{kind: 'cef', key: 'device_vendor', value: 'acme'}}, {{kind: 'cef', key: 'device_product', value: 'gate'}}, {{kind: 'cef', key: 'device_version', value: '1.0'}}, {{kind: 'cef', key: 'signature_id', value: '100'}},
          {{kind: 'cef', key: 'name', value: device_key}}, {{kind: 'cef', key: 'severity', value: '5'}}]
        ELSE [{{kind: 'word', key: NULL::VARCHAR, value: x}} FOR x IN ['user', usr, 'came', 'from', ip, 'today']] END, recursive := true) FROM c2)
        SELECT kind, key, count(*) AS n, count(DISTINCT value) AS distinct_values FROM t GROUP BY ALL""",
    "parsed_features": f"WITH {FEATURES} SELECT tenant_id, device_key, ws, feature, count(*) AS n FROM pf GROUP BY ALL",
    "parsed_entities": f"""WITH {RAW}, e AS (SELECT tenant_id, device_key, ws, 'SourceIp' AS kind, ip AS value FROM c4 WHERE form <> 4 UNION ALL SELECT tenant_id, device_key, ws, 'UserId', usr FROM c4 WHERE form IN (0, 1, 3)),
        n AS (SELECT *, count(*) AS n FROM e GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tenant_id, device_key, ws, kind ORDER BY n DESC, value) <= CASE kind WHEN 'SourceIp' THEN 64 ELSE 128 END""",
    "document_words": r"""WITH w AS (SELECT lang AS tenant_id, lower(left(unnest(regexp_extract_all(text, '[A-Za-z0-9_./:@\\-]{2,}')), 64)) AS x FROM documents)
        SELECT tenant_id, 'w=' || x AS feature, count(*) AS n FROM w WHERE regexp_matches(x, '[a-z0-9]') GROUP BY ALL""",
    "feature_dictionary": f"""WITH {ROWS}, g AS (SELECT tenant_id, x.f AS feature, min(seq) AS s, min(x.o) AS o FROM e GROUP BY ALL)
        SELECT tenant_id, feature, row_number() OVER (PARTITION BY tenant_id ORDER BY s, o, feature) AS feature_id FROM g""",
    "stream_windows": f"WITH {LINES} SELECT tenant_id, device_key, 'logs/' || (seq % 3) || '.log' AS source_path, min(ws) AS first_seen_ts, max(ws) + 3600 AS last_seen_ts FROM lw GROUP BY ALL",
}
