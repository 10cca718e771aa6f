"""Shared SQL for the oracles: the same arithmetic, straight from the tables."""

BASE = """WITH a AS (
 SELECT event_id AS eid, user_id, event_type, value, ts, event_id % 12 AS family, event_id // 12 AS k,
  event_id % 254 + 1 AS tail,
  CASE event_type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'drop' ELSE 'allow' END AS verb,
  event_type IN ('error','signup') AS blocked,
  (CASE WHEN event_type IN ('purchase','view','error') THEN '203.0.113.' ELSE '192.168.1.' END) || (event_id % 254 + 1) AS dst0,
  CASE WHEN event_id % 97 = 0 THEN '198.51.100.' || (event_id % 254 + 1)
   ELSE '10.' || (user_id % 256) || '.' || ((event_id // 256) % 256) || '.' || (event_id % 254 + 1) END AS src0,
  1024 + event_id % 60000 AS sport,
  CAST([443,53,22,3389,445,8080,50000,21][CAST((event_id // 12) % 8 + 1 AS INT)] AS BIGINT) AS dport,
  CASE WHEN (event_id // 12) % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto,
  CASE WHEN (event_id // 12) % 2 = 0 THEN 6 ELSE 17 END AS num,
  CAST(round(value * 100) AS BIGINT) AS bytes_out
 FROM events),
b AS (
 SELECT *, CASE WHEN event_type = 'error' THEN dst0 ELSE src0 END AS src,
  CASE WHEN event_type = 'error' THEN src0 ELSE dst0 END AS dst, bytes_out * 2 AS bytes_in,
  CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS secs,
  strftime(ts, '%b %d %H:%M:%S') AS bsd, strftime(ts, '%b %d %Y %H:%M:%S') AS bsd_year
 FROM a),
c AS (
 SELECT *, (src LIKE '10.%' OR src LIKE '192.168.%') AS src_int, (dst LIKE '10.%' OR dst LIKE '192.168.%') AS dst_int,
  CASE family WHEN 0 THEN 'pfsense' WHEN 1 THEN 'pfsense' WHEN 2 THEN 'suricata' WHEN 3 THEN 'suricata_eve'
   WHEN 4 THEN 'squid' WHEN 5 THEN 'cisco_asa' WHEN 6 THEN 'fortigate' WHEN 7 THEN 'paloalto'
   WHEN 8 THEN CASE WHEN k % 5 = 0 THEN 'generic_cef_base' ELSE 'generic_cef' END WHEN 9 THEN 'generic_leef' END AS sid,
  CASE WHEN family IN (2,3) OR (family = 10 AND k % 4 = 2) THEN 'http' WHEN family = 4 THEN 'file:squid' ELSE 'udp:5514' END AS channel,
  CASE WHEN family = 10 THEN CASE WHEN k % 4 = 3 THEN 'tokenize_failed' ELSE 'no_parser_match' END
   WHEN family = 11 THEN CASE WHEN k % 2 = 0 THEN 'no_parser_match' ELSE 'tokenize_failed' END END AS reason
 FROM b),
d AS (
 SELECT *, CASE WHEN src_int AND dst_int THEN 3 WHEN src_int THEN 2 WHEN dst_int THEN 1 ELSE 0 END AS dir_id,
  CASE WHEN src_int AND dst_int THEN 'Lateral' WHEN src_int THEN 'Outbound' WHEN dst_int THEN 'Inbound' ELSE 'Unknown' END AS dir,
  CASE dport WHEN 443 THEN 'https' WHEN 53 THEN 'dns' WHEN 22 THEN 'ssh' WHEN 3389 THEN 'rdp' WHEN 445 THEN 'smb'
   WHEN 8080 THEN 'http-alt' WHEN 21 THEN 'ftp' END AS svc
 FROM c)
"""

# per-family expectations of a fully normalized event (families 0..9)
EVENT = BASE + """, e AS (
 SELECT *,
  CASE WHEN family = 4 THEN 4002 WHEN family = 2 THEN 2004 WHEN sid = 'generic_cef_base' THEN 0 ELSE 4001 END AS class_uid,
  CASE family WHEN 2 THEN CASE WHEN blocked THEN 'Blocked' ELSE 'Detected' END WHEN 3 THEN NULL
   WHEN 8 THEN CASE WHEN k % 5 = 0 THEN NULL WHEN verb = 'deny' THEN 'Blocked' WHEN verb = 'drop' THEN 'Dropped' ELSE 'Allowed' END
   WHEN 9 THEN CASE verb WHEN 'deny' THEN 'Blocked' WHEN 'drop' THEN 'Dropped' ELSE 'Allowed' END
   ELSE CASE WHEN blocked THEN 'Blocked' ELSE 'Allowed' END END AS disposition,
  CASE family WHEN 0 THEN CASE WHEN blocked THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN blocked THEN 2 ELSE 1 END
   WHEN 2 THEN CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END
   WHEN 5 THEN CASE WHEN blocked THEN 3 ELSE 1 END WHEN 6 THEN CASE WHEN blocked THEN 3 ELSE 1 END
   WHEN 8 THEN CASE WHEN k % 11 <= 2 THEN 1 WHEN k % 11 <= 4 THEN 2 WHEN k % 11 <= 6 THEN 3 WHEN k % 11 <= 8 THEN 4 ELSE 5 END
   WHEN 9 THEN CASE WHEN k % 10 + 1 <= 2 THEN 1 WHEN k % 10 + 1 <= 4 THEN 2 WHEN k % 10 + 1 <= 6 THEN 3 WHEN k % 10 + 1 <= 8 THEN 4 ELSE 5 END
   ELSE 1 END AS severity_id,
  CASE family WHEN 2 THEN 'Create' WHEN 3 THEN 'Close' WHEN 4 THEN CASE WHEN k % 3 = 0 THEN 'Post' ELSE 'Get' END
   WHEN 5 THEN CASE WHEN blocked THEN 'Refuse' ELSE 'Open' END
   WHEN 7 THEN CASE WHEN blocked THEN 'Refuse' ELSE 'Close' END
   WHEN 8 THEN CASE WHEN k % 5 = 0 THEN 'Other' WHEN blocked THEN 'Refuse' ELSE 'Traffic' END
   ELSE CASE WHEN blocked THEN 'Refuse' ELSE 'Traffic' END END AS activity_name,
  CASE WHEN family IN (2,3,4,8,9) THEN ms ELSE secs * 1000 END AS time_ms,
  CASE WHEN family = 8 AND k % 5 = 0 THEN NULL ELSE src END AS e_src,
  CASE WHEN family = 4 OR (family = 8 AND k % 5 = 0) THEN NULL ELSE dst END AS e_dst,
  CASE WHEN family IN (1,4) OR (family = 8 AND k % 5 = 0) THEN NULL ELSE sport END AS e_sport,
  CASE WHEN family IN (1,4) OR (family = 8 AND k % 5 = 0) THEN NULL ELSE dport END AS e_dport,
  CASE WHEN family = 4 OR (family = 8 AND k % 5 = 0) THEN NULL WHEN family = 8 THEN 'tcp' ELSE proto END AS e_proto,
  CASE WHEN family = 4 OR (family = 8 AND k % 5 = 0) THEN NULL WHEN family = 8 THEN 6 ELSE num END AS e_num,
  CASE WHEN family = 4 OR (family = 8 AND k % 5 = 0) THEN NULL ELSE dir END AS e_dir,
  CASE WHEN family = 4 OR (family = 8 AND k % 5 = 0) THEN NULL ELSE dir_id END AS e_dir_id,
  CASE WHEN family IN (3,6,7) THEN bytes_out END AS e_out, CASE WHEN family IN (3,6,7) THEN bytes_in END AS e_in
 FROM d WHERE family <= 9),
f AS (
 SELECT *, CASE disposition WHEN 'Allowed' THEN 1 WHEN 'Blocked' THEN 2 WHEN 'Dropped' THEN 6 WHEN 'Detected' THEN 15 END AS disposition_id,
  CASE WHEN disposition IN ('Allowed','Detected') THEN 1 WHEN disposition IN ('Blocked','Dropped') THEN 2 END AS action_id,
  CASE WHEN disposition IN ('Allowed','Detected') THEN 'Allowed' WHEN disposition IN ('Blocked','Dropped') THEN 'Denied' END AS action,
  CASE severity_id WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low' WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' ELSE 'Critical' END AS severity,
  CASE WHEN class_uid = 4002 THEN CASE activity_name WHEN 'Post' THEN 6 ELSE 3 END WHEN class_uid = 2004 THEN 1 WHEN class_uid = 0 THEN 99
   ELSE CASE activity_name WHEN 'Open' THEN 1 WHEN 'Close' THEN 2 WHEN 'Refuse' THEN 5 ELSE 6 END END AS activity_id,
  CASE class_uid WHEN 0 THEN 'Base Event' WHEN 2004 THEN 'Detection Finding' WHEN 4001 THEN 'Network Activity' ELSE 'HTTP Activity' END AS class_name,
  CASE sid WHEN 'suricata' THEN 'OISF' WHEN 'suricata_eve' THEN 'OISF' WHEN 'pfsense' THEN 'Netgate' WHEN 'squid' THEN 'Squid Cache'
   WHEN 'cisco_asa' THEN 'Cisco' WHEN 'fortigate' THEN 'Fortinet' WHEN 'paloalto' THEN 'Palo Alto Networks'
   WHEN 'generic_leef' THEN 'V' ELSE 'Ven|dor' END AS vendor
 FROM e)
"""
