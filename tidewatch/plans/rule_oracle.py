"""Independent SQL for `rule_queries` (DuckDB): what was rendered into the lines, or the rule by brute force."""

from __future__ import annotations

from .oracle import ALERTS, CENTROID, LINES, RAW, RING, ROWS, SCORES, STATE, STATS

SAID = """
e AS (SELECT event_id AS seq, 't' || (user_id % 2) AS tenant_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(event_id AS VARCHAR) AS s, 'u' || user_id AS usr, CAST(user_id % 9 AS VARCHAR) AS d,
  strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM events)"""

BUCKET = "CAST((CASE WHEN dayofweek(make_timestamp(ws * 1000000)) IN (0, 6) THEN 24 ELSE 0 END) + hour(make_timestamp(ws * 1000000)) AS INTEGER)"

STREAMS = f"""{LINES}, r AS (SELECT tenant_id, device_key, 'logs/' || (seq % 3) || '.log' AS source_path, ws, ws + 3600 AS we, {BUCKET} AS bucket, count(*) AS lines FROM lw GROUP BY ALL)"""

OFFSETS = f"""{LINES}, o AS (SELECT tenant_id, device_key, ws, 'f' || (seq % 2) || '.log' AS file_rel, byte_len, CAST(sum(byte_len) OVER (PARTITION BY tenant_id, device_key, seq % 2 ORDER BY seq) AS BIGINT) AS b FROM lw),
o2 AS (SELECT *, b - byte_len AS a, coalesce(b - byte_len > max(b) OVER (PARTITION BY tenant_id, device_key, ws, file_rel ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM o),
o3 AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY tenant_id, device_key, ws, file_rel ORDER BY b) AS run FROM o2),
o4 AS (SELECT tenant_id, device_key, ws, file_rel, run, min(a) AS a, max(b) AS b FROM o3 GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_key, ws ORDER BY file_rel, a) - 1 AS k FROM o4 QUALIFY k < 8)"""

#: The lines that inputs.raw_lines renders.
WRITTEN = f"""WITH {RAW}, x AS (SELECT *, make_timestamp(ts * 1000000) AS m, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM c2), t AS (SELECT tenant_id, device_key, seq % 2 = 1 AS is_gzip, CASE form
          WHEN 0 THEN '<34>1 ' || iso || ' ' || host || ' ' || device_key || ' ' || pid || ' ' || mid || ' - ' || pairs WHEN 1 THEN iso || ' {{"src_ip":"' || ip || '","user":"' || usr || '","action":"' || device_key || '","n":{{"bytes":' || amount || '}}}}'
          WHEN 2 THEN 'CEF:0|acme|gate|1.0|100|' || device_key || '|5|src_ip=' || ip || ' suser=' || usr || ' msg=took ' || amount || ' units'
          WHEN 3 THEN '<13>' || strftime(m, '%b %-d %H:%M:%S') || ' ' || host || ' ' || device_key || '[' || pid || ']: ' || pairs ELSE iso || ' ' || host || ' ' || device_key || ': user ' || usr || ' came from ' || ip || ' today' END AS line FROM x)"""

SQL = {
    "envelope_formats": f"""WITH {SAID} SELECT seq, CASE seq % 6 WHEN 0 THEN 165 WHEN 3 THEN 13 END::BIGINT AS pri, CASE seq % 6 WHEN 0 THEN t - 7200 WHEN 5 THEN NULL ELSE t END AS ts,
        CASE seq % 6 WHEN 0 THEN 'edge' WHEN 1 THEN 'host' WHEN 3 THEN 'box' WHEN 4 THEN 'box' END AS host, CASE WHEN seq % 6 < 3 THEN 'app' WHEN seq % 6 < 5 THEN 'fw' END AS app, CASE WHEN seq % 6 = 0 THEN d END AS procid,
        CASE WHEN seq % 6 = 0 THEN '[a@1 x="y]z" n="' || s || '"][b]' END AS structured_data, CASE WHEN seq % 6 = 3 THEN t END AS embedded_ts, CASE seq % 6 WHEN 3 THEN iso || 'Z' WHEN 4 THEN 'alpha' ELSE '' END AS peeled,
        CASE seq % 6 WHEN 0 THEN 'sd text' WHEN 1 THEN 'said ' || s WHEN 2 THEN 'fraction ' || s WHEN 3 THEN '%ASA-6-1: built ' || s WHEN 4 THEN '%X-1: two ' || s ELSE 'no header ' || s END AS msg FROM e""",
    "token_rules": f"""WITH {SAID}, x AS (SELECT unnest(CASE seq % 6
        WHEN 0 THEN [{{kind: 'kv', key: 'k1', value: 'two words'}}, {{kind: 'kv', key: 'c', value: '[x (y)]'}}, {{kind: 'word', key: NULL, value: 'tail-' || s}}, {{kind: 'word', key: NULL, value: 'two'}}, {{kind: 'word', key: NULL, value: 'words'}}]
        WHEN 1 THEN [{{kind: 'json', key: 'a', value: 'null'}}, {{kind: 'json', key: 'b_c', value: '1'}}, {{kind: 'json', key: 'b_c', value: 'true'}}, {{kind: 'json', key: 's', value: usr}}]
        WHEN 2 THEN [{{kind: 'kv', key: 'src', value: '1.2.3.4'}}, {{kind: 'kv', key: 'msg', value: 'a b=' || s}}, {{kind: 'cef', key: 'version', value: '0'}}, {{kind: 'cef', key: 'device_vendor', value: 'v'}},
          {{kind: 'cef', key: 'device_product', value: 'p'}}, {{kind: 'cef', key: 'device_version', value: '1'}}, {{kind: 'cef', key: 'signature_id', value: '9'}}, {{kind: 'cef', key: 'name', value: 'n'}}, {{kind: 'cef', key: 'severity', value: '5'}}]
        WHEN 3 THEN [{{kind: 'word', key: NULL, value: y}} FOR y IN ['CEF:0', 'broken', usr]]
        WHEN 4 THEN list_concat([{{kind: 'kv', key: 'k', value: 'v'}}], [{{kind: 'word', key: NULL, value: y}} FOR y IN ['see', 'http://x/' || usr, 'then', 'C:\\tmp', '12:30']])
        ELSE [{{kind: 'kv', key: 'a', value: '1'}}, {{kind: 'kv', key: 'b', value: 'x'}}, {{kind: 'kv', key: 'c', value: '(p q)'}}, {{kind: 'kv', key: 'd', value: s}}] END, recursive := true) FROM e)
        SELECT kind, key, value, count(*) AS n FROM x GROUP BY ALL""",
    "csv_tokens": f"""WITH {SAID} SELECT 'csv' AS kind, unnest(['src_ip', 'user', 'n']) AS key, unnest([count(*), count(*), count(*)]) AS n, unnest([count(DISTINCT d), count(DISTINCT usr), count(DISTINCT s)]) AS distinct_values FROM e""",
    "token_caps": """WITH c AS (SELECT c_custkey, least(64, 60 + c_custkey % 10) AS pairs, c_custkey % 300 AS w FROM customer)
        SELECT c_custkey, pairs::BIGINT AS pairs, least(w, 256 - pairs)::BIGINT AS words, (c_custkey % 10 > 4)::BIGINT AS kv_cap, (w > 256 - pairs)::BIGINT AS token_cap, (w > 256 - pairs)::BIGINT AS word_cap FROM c""",
    "key_rules": f"""WITH {SAID}, x AS (SELECT tenant_id, unnest(list_concat(
        [{{kind: 'feature', value: y}} FOR y IN ['k=src_ip', 'canon=SourceIp', 'SourceIp=<IPV6>', 'k=sha_256', 'k=dport', 'canon=DestPort', 'DestPort=<PORT>', 'k=sport', 'canon=SourcePort', 'k=user', 'canon=User', 'User=bob.' || d, 'k=acct', 'canon=User', 'User=eve',
          'k=dst_host', 'canon=DestHost', 'DestHost=<HOSTNAME>', 'k=url', 'canon=Url', 'Url=<URL>', 'k=file', 'canon=Path', 'Path=<WIN_PATH>', 'k=event_time', 'canon=Timestamp', 'Timestamp=<RFC3339_TS>', 'k=proc', 'canon=Process', 'k=cmd', 'canon=Command',
          'k=src_to_dst_port', 'k=dest_address', 'canon=DestIp', 'DestIp=<IPV4>', 'DestIp_net@10.0.0.0/24']],
        [{{kind: 'SourceIp', value: '2001:db8::' || d}}, {{kind: 'UserRaw', value: 'CORP\\Bob.' || d}}, {{kind: 'UserId', value: 'bob.' || d}}, {{kind: 'Domain', value: 'corp'}}, {{kind: 'UserRaw', value: 'eve@Example.COM'}}, {{kind: 'UserId', value: 'eve'}},
         {{kind: 'Domain', value: 'example.com'}}, {{kind: 'Host', value: 'web-' || d || '.local'}}, {{kind: 'DestIp', value: '10.0.0.' || d}}]), recursive := true) FROM e)
        SELECT tenant_id, kind, value, count(*) AS n FROM x GROUP BY ALL""",
    "df_caps": f"""WITH {ROWS}, f AS (SELECT *, dense_rank() OVER (PARTITION BY tenant_id ORDER BY feature) AS id FROM rf), g AS (SELECT tenant_id, CAST(floor(ws / 86400) AS BIGINT) AS day, {BUCKET} AS bucket, feature, id, count(*) AS df FROM f GROUP BY ALL)
        SELECT tenant_id, day, bucket, feature, df FROM g QUALIFY row_number() OVER (PARTITION BY tenant_id, day, bucket ORDER BY df DESC, id) <= 4""",
    "centroid_caps": f"""WITH {ROWS}, f AS (SELECT *, dense_rank() OVER (PARTITION BY tenant_id ORDER BY feature) AS id FROM rf), g AS (SELECT tenant_id, device_key, {BUCKET} AS bucket, id AS feature_id, CAST(sum(CASE WHEN id % 2 = 0 THEN -n ELSE n END) AS BIGINT) AS value FROM f GROUP BY ALL)
        SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY tenant_id, device_key, bucket ORDER BY abs(value) DESC, feature_id) <= 3""",
    "noise_labels": f"""WITH {LINES}, w AS (SELECT tenant_id, device_key, ws, {BUCKET} AS bucket, count(*) AS lines FROM lw GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_key, bucket ORDER BY ws) AS i FROM w),
        f AS (SELECT tenant_id, device_key, ws, unnest(list_concat([{{f: 'w', w: 0.3}}, {{f: 'k', w: 0.5}}], CASE WHEN seq % 3 = 0 THEN [{{f: 'b', w: 1.0}}] ELSE [] END), recursive := true) FROM lw),
        n AS (SELECT tenant_id, device_key, ws, f, CAST(CAST(CAST(max(w) AS DOUBLE) * ln(1 + count(*)) AS FLOAT) AS DOUBLE) AS tf FROM f GROUP BY ALL), b AS (SELECT tenant_id, device_key, ws, coalesce(sum(tf) FILTER (f = 'b'), 0) / sum(tf) AS blob FROM n GROUP BY ALL)
        SELECT tenant_id, device_key, ws, round(blob, 5) AS blob_ratio, CASE WHEN lines >= 2 AND i > 1 AND blob >= 0.31 THEN 'noise_suspect' END AS label, blob > 0.31 AS noisy FROM b JOIN i USING (tenant_id, device_key, ws)""",
    "signature_texts": f"""WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS}, g AS (SELECT tenant_id, device_key, ws, md5(string_agg(feature || chr(9) || n || chr(10), '' ORDER BY rank)) AS signature_md5 FROM rk WHERE rank <= 25 GROUP BY ALL)
        SELECT a.tenant_id, a.device_key, a.ws, signature_md5, CASE WHEN fresh THEN 'R_NEW_FEATURE' || chr(10) || 'n_bucket' || chr(9) || n_bucket || chr(10) END AS reason FROM alerts a JOIN g ON g.tenant_id = a.tenant_id AND g.device_key = a.device_key AND g.ws = a.ws""",
    "provenance_spans": f"WITH {OFFSETS} SELECT tenant_id, device_key, ws, k, file_rel, a AS offset_start, b AS offset_end FROM sp",
    "span_lines": f"""WITH {OFFSETS} SELECT o2.tenant_id, o2.device_key, o2.ws, count(*) AS lines, CAST(sum(byte_len) AS BIGINT) AS bytes FROM o2
        JOIN sp ON sp.tenant_id = o2.tenant_id AND sp.device_key = o2.device_key AND sp.ws = o2.ws AND sp.file_rel = o2.file_rel AND o2.a >= sp.a AND o2.b <= sp.b GROUP BY ALL""",
    "silence_policy": f"""WITH {ROWS}{STATE}, v AS (SELECT *, CASE WHEN mature_windows < 5 THEN 'NotMature' WHEN 1706745600 <= last_we THEN 'NotSilent' WHEN m < CASE tenant_id WHEN 't0' THEN 200 ELSE 3 END THEN 'NotEnoughMissedWindows'
        WHEN last_lines * m < CASE tenant_id WHEN 't0' THEN 4 ELSE 10 END THEN 'BelowExpectedLineFloor' END AS s FROM hs WHERE subject_kind = 1) SELECT tenant_id, subject_key, s AS suppression, CASE WHEN s IS NULL THEN m END AS missed FROM v""",
    "silence_lifecycle": f"""WITH {ROWS} SELECT tenant_id, device_key, we AS window_start_ts, we + 10800 AS eval_ts FROM r QUALIFY coalesce(lead(ws) OVER (PARTITION BY tenant_id, device_key ORDER BY ws) >= we + 10800, true)""",
    "loss_alerts": f"""WITH {ROWS}, q AS (SELECT * FROM r WHERE device_key <> 'click' OR ws < 1706000400), dl AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_key ORDER BY we DESC) AS k FROM q),
        s AS (SELECT tenant_id, device_key, count(*) FILTER (lines >= 2) AS mature, max(we) AS last_we, max(lines) FILTER (k = 1) AS last_lines, CAST(floor((1706140800 - max(we)) / 3600) AS BIGINT) AS m FROM dl GROUP BY ALL),
        quiet AS (SELECT * FROM s WHERE mature >= 5 AND 1706140800 > last_we AND m >= 3 AND last_lines * m >= 2),
        h AS (SELECT *, count(*) OVER w AS n, coalesce(avg(lines) OVER w, 0) AS mean, coalesce(stddev_samp(lines) OVER w, 0) AS sd FROM q ANTI JOIN quiet USING (tenant_id, device_key)
          WINDOW w AS (PARTITION BY tenant_id, device_key, bucket ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT *, CASE WHEN mean <= 0 OR n < 5 OR mean < 2 THEN NULL WHEN mean - lines < 2 OR lines / mean > 0.25 OR 1 - lines / mean < 0.75 THEN 0 WHEN sd > 1e-12 AND CAST((mean - lines) / sd AS FLOAT) < 3 THEN NULL ELSE 1 END AS mark FROM h),
        o AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY tenant_id, device_key ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM v)
        SELECT tenant_id, 'device' AS subject_kind, device_key AS subject_key, device_key, last_we AS window_start_ts, last_we + m * 3600 AS window_end_ts, 'info' AS label, 'medium' AS confidence, 0::BIGINT AS lines, CAST(m AS VARCHAR) AS missed FROM quiet
        UNION ALL SELECT tenant_id, 'device', device_key, device_key, ws, we, 'info', 'medium', lines, NULL FROM o WHERE mark = 1 AND was = 0""",
    "stream_volume": f"""WITH {STREAMS} SELECT tenant_id, device_key, source_path, ws, count(*) OVER w AS maturity, round(coalesce(avg(lines) OVER w, 0), 5) AS mean_lines, round(coalesce(stddev_samp(lines) OVER w, 0), 5) AS sd_lines FROM r
        WINDOW w AS (PARTITION BY tenant_id, device_key, source_path, bucket ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "stream_silence": f"""WITH {STREAMS}, s AS (SELECT tenant_id, device_key, source_path, count(*) AS n, max(we) AS last_we, arg_max(lines, we) AS last_lines FROM r GROUP BY ALL), v AS (SELECT *, CAST(floor((1706745600 - last_we) / 3600) AS BIGINT) AS m FROM s)
        SELECT tenant_id, 'source_stream' AS subject_kind, device_key, source_path, last_we AS window_start_ts, last_we + m * 3600 AS window_end_ts, 'subject_kind=source_stream;tenant_id=' || tenant_id || ';device_key=' || device_key || ';source_stream_id=' ||
          tenant_id || '|' || device_key || '|' || source_path || ';source_path=' || source_path AS details FROM v WHERE n >= 5 AND 1706745600 > last_we AND m >= 3 AND last_lines * m >= 3""",
    "alert_category": f"WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT tenant_id, device_key, ws AS window_start_ts, label FROM alerts WHERE label = 'outlier'",
    "alert_upsert": "SELECT CAST(o_custkey AS VARCHAR) AS alert_id, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "alert_lookup": f"""WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS}, o AS (SELECT * FROM alerts ORDER BY ws, tenant_id, device_key LIMIT 1) SELECT 'id' AS found_by, tenant_id, device_key, ws AS window_start_ts, label FROM o
        UNION ALL SELECT DISTINCT 'entity', a.tenant_id, a.device_key, a.ws, a.label FROM alerts a JOIN lw ON lw.tenant_id = a.tenant_id AND lw.device_key = a.device_key AND lw.ws = a.ws WHERE lw.usr = 'u7' AND a.ws >= 1704672000 AND a.ws < 1705881600""",
    "alert_show": f"WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT tenant_id, device_key, ws AS window_start_ts FROM alerts ORDER BY ws, tenant_id, device_key LIMIT 1",
    "file_lines": f"""{WRITTEN} SELECT tenant_id, device_key, is_gzip, count(*) AS lines, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, 0::BIGINT AS least_gap FROM t GROUP BY ALL""",
    "archived_lines": f"""{WRITTEN} SELECT tenant_id, device_key, count(*) AS lines, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, count(*) AS numbered FROM t GROUP BY ALL""",
    "tailed_lines": f"""{WRITTEN} SELECT tenant_id, device_key, is_gzip, count(*) AS lines, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, 0::BIGINT AS errors FROM t GROUP BY ALL""",
    "alert_files_rows": f"WITH {RING}{STATS}{CENTROID}{SCORES}{ALERTS} SELECT tenant_id, device_key, strftime(make_timestamp(ws * 1000000), '%Y%m%d') AS day, count(*) AS n, count(*) AS ids, true AS placed FROM alerts GROUP BY ALL",
    "cursor_decisions": """WITH p AS (SELECT p_partkey AS k, p_size * 10 AS size FROM part), f AS (SELECT *, CAST(k AS VARCHAR) || CASE WHEN k % 5 = 0 THEN '.zlg' ELSE '.log' END AS file_rel, k % 4 = 1 AS gz, k % 4 = 1 OR k % 5 = 0 AS packed,
          size - CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END AS was, size - 5 + CASE WHEN k % 9 = 0 THEN 10 ELSE 0 END AS off FROM p),
        d AS (SELECT file_rel, off, CASE WHEN k % 6 = 0 THEN 'new' WHEN gz <> (k % 8 = 1) THEN 'type' WHEN k % 11 = 0 THEN 'inode' WHEN packed AND size <> was THEN 'size' WHEN NOT packed AND size < off THEN 'truncated' ELSE 'resume' END AS reason FROM f)
        SELECT file_rel, reason, CASE WHEN reason = 'resume' THEN off ELSE 0 END::BIGINT AS "offset" FROM d""",
    "cursor_progress": """SELECT CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN '.zlg' ELSE '.log' END AS file_rel, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN p_size * 10 ELSE least(7, p_size * 10) END::BIGINT AS "offset", 9::BIGINT AS last_read_ts FROM part""",
    "streamed_rows": f"""WITH {LINES}, r AS (SELECT tenant_id, device_key, ws, ws + 3600 AS we, {BUCKET} AS bucket, count(*) AS lines, CAST(sum(byte_len - length(device_key)) AS BIGINT) AS bytes FROM lw GROUP BY ALL)
        SELECT * FROM r WHERE we <= (SELECT max(ts) FROM l) - 120""",
    "streamed_scores": f"""WITH {RING}{STATS}{CENTROID}{SCORES} SELECT tenant_id, device_key, ws, cold_start, round(rarity, 5) AS rarity, round(drift, 5) AS drift, round(volume, 5) AS volume, round(total, 5) AS total,
        round(centroid_norm, 5) AS centroid_norm FROM tot WHERE ws + 3600 <= (SELECT max(ts) FROM e) - 120""",
    "streamed_silences": f"""WITH {ROWS}, n AS (SELECT *, lead(ws) OVER (PARTITION BY tenant_id, device_key ORDER BY ws) AS later FROM r)
        SELECT tenant_id, device_key, we AS window_start_ts, we + 3 * 3600 AS eval_ts FROM n WHERE (later IS NULL OR later >= we + 3 * 3600) AND we + 3 * 3600 <= (SELECT max(ts) FROM e) - 120""",
    "idle_windows": f"WITH {ROWS} SELECT tenant_id, device_key, ws, ws + 3600 AS we, bucket, lines, bytes FROM r",
}
