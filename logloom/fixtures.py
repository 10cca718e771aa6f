"""Raw line tables projected from the ``events`` table by plain arithmetic.

Every row of ``events`` becomes one raw log line of one of twelve families
(``event_id % 12``), so the number of lines grows with the table and the
expected result of a parse can be computed from the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.pipeline import prepare_session
from .sources.ingest import mint_ids, spread

FAMILIES = {
    0: "pfsense", 1: "pfsense", 2: "suricata", 3: "suricata_eve", 4: "squid", 5: "cisco_asa", 6: "fortigate",
    7: "paloalto", 8: "generic_cef", 9: "generic_leef",
}

_BASE = (
    "event_id AS eid", "user_id", "event_type", "value", "CAST(ts AS TIMESTAMP) AS ts",
    "CAST(event_id % 12 AS INT) AS family", "event_id DIV 12 AS k", "event_id % 254 + 1 AS tail",
    "CASE event_type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'drop' ELSE 'allow' END AS verb",
    "event_type IN ('error', 'signup') AS blocked",
    "concat(CASE WHEN event_type IN ('purchase', 'view', 'error') THEN '203.0.113.' ELSE '192.168.1.' END,"
    " event_id % 254 + 1) AS dst0",
    "CASE WHEN event_id % 97 = 0 THEN concat('198.51.100.', event_id % 254 + 1) ELSE concat('10.', user_id % 256, '.',"
    " (event_id DIV 256) % 256, '.', event_id % 254 + 1) END AS src0",
    "1024 + event_id % 60000 AS sport",
    "element_at(array(443, 53, 22, 3389, 445, 8080, 50000, 21), CAST((event_id DIV 12) % 8 + 1 AS INT)) AS dport",
    "CASE WHEN (event_id DIV 12) % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto",
    "CASE WHEN (event_id DIV 12) % 2 = 0 THEN 6 ELSE 17 END AS num",
    "CAST(round(value * 100) AS BIGINT) AS bytes_out",
)

_LINES = {
    0: "concat('<134>', bsd, ' fw01 filterlog[88]: 5,,,1000000103,igb1,match,', if(blocked, 'block', 'pass'),"
       " ',in,4,0x0,,64,0,0,DF,', num, ',', proto, ',60,', src, ',', dst, ',', sport, ',', dport, ',0')",
    1: "concat(bsd, ' fw01 filterlog: rule 12 ', if(blocked, 'block', 'pass'), ' in on em0 src=', src, ' dst=', dst,"
       " ' proto=', proto)",
    2: "concat('{\"timestamp\":\"', iso, '+0000\",\"event_type\":\"alert\",\"src_ip\":\"', src, '\",\"src_port\":', sport,"
       " ',\"dest_ip\":\"', dst, '\",\"dest_port\":', dport, ',\"proto\":\"', upper(proto), '\",\"alert\":{\"action\":\"',"
       " if(blocked, 'blocked', 'allowed'), '\",\"gid\":1,\"signature_id\":', 2000000 + eid % 40000,"
       " ',\"signature\":\"ET RULE ', eid % 7, '\",\"category\":\"Cat ', user_id % 5, '\",\"severity\":', k % 4 + 1, '}}')",
    3: "concat('{\"timestamp\":\"', iso, '+0000\",\"event_type\":\"flow\",\"src_ip\":\"', src, '\",\"src_port\":', sport,"
       " ',\"dest_ip\":\"', dst, '\",\"dest_port\":', dport, ',\"proto\":\"', upper(proto), '\",\"app_proto\":\"tls\",\"flow\":{',"
       " '\"bytes_toserver\":', bytes_out, ',\"bytes_toclient\":', bytes_in, '}}')",
    4: "concat(secs, '.', lpad(CAST(ms % 1000 AS STRING), 3, '0'), '    12 ', src, ' ',"
       " if(blocked, 'TCP_DENIED/403', 'TCP_MISS/200'), ' ', bytes_out, ' ', if(k % 3 = 0, 'POST', 'GET'), ' http://h',"
       " user_id, '/p ', if(user_id % 5 = 0, '-', concat('u', user_id)), ' HIER_DIRECT/', dst, ' text/html')",
    5: "concat('<166>', bsd_year, ' asa : ', if(blocked, concat('%ASA-4-106023: Deny ', proto, ' src outside:', src, '/',"
       " sport, ' dst inside:', dst, '/', dport, ' by access-group \"acl1\" [0x0, 0x0]'), concat('%ASA-6-302013: Built outbound ',"
       " upper(proto), ' connection ', eid, ' for outside:', src, '/', sport, ' (', src, '/', sport, ') to inside:', dst, '/',"
       " dport, ' (', dst, '/', dport, ')')))",
    6: "concat('<189>date=', day, ' time=', clock, ' devname=\"FGT\" devid=\"F1\" type=\"traffic\" subtype=\"forward\" level=\"',"
       " if(blocked, 'warning', 'notice'), '\" srcip=', src, ' srcport=', sport, ' dstip=', dst, ' dstport=', dport, ' proto=', num,"
       " ' action=\"', if(blocked, 'deny', 'accept'), '\" sentbyte=', bytes_out, ' rcvdbyte=', bytes_in, ' custom=\"k', user_id, '\"')",
    7: "concat('<14>', bsd, ' PA 1,', slash, ',012801000001,TRAFFIC,', if(blocked, 'drop', 'end'), ',2561,', slash, ',', src, ',',"
       " dst, ',0.0.0.0,0.0.0.0,rule', k % 5, ',u', user_id, ',,ssl,vsys1,trust,untrust,ethernet1/1,ethernet1/2,default,,', eid,"
       " ',1,', sport, ',', dport, ',0,0,0x0,', proto, ',', if(blocked, 'deny', 'allow'), ',', bytes_out + bytes_in, ',',"
       " bytes_out, ',', bytes_in, ',3,', slash, ',0,any,,7101,0x0,US,US,,1,1,aged-out')",
    8: "concat('CEF:0|Ven\\\\|dor|Prod|1|100|Name|', k % 11, '|', if(k % 5 = 0, concat('suser=u', user_id), concat('src=', src,"
       " ' spt=', sport, ' dst=', dst, ' dpt=', dport, ' proto=TCP act=', CASE verb WHEN 'allow' THEN 'accept' ELSE verb END)),"
       " ' rt=', ms, ' msg=a\\\\=b c')",
    9: "concat('LEEF:2.0|V|P|1|EVT|^|src=', src, '^dst=', dst, '^srcPort=', sport, '^dstPort=', dport, '^proto=', num,"
       " '^action=', CASE verb WHEN 'allow' THEN 'permit' ELSE verb END, '^sev=', k % 10 + 1, '^devTime=', ms)",
    10: "CASE k % 4"
        " WHEN 0 THEN concat('<134>', bsd, ' swall id=firewall sn=0017C5 time=\"', day, ' ', clock, ' UTC\" fw=203.0.113.1 pri=',"
        " k % 3 + 4, ' c=32 m=36 msg=\"Connection\" src=', src, ':', sport, ':X1 dst=', dst, ':', dport,"
        " ':X0 proto=tcp/https fw_action=\"', if(blocked, 'drop', 'forward'), '\"')"
        " WHEN 1 THEN concat('<14>', bsd, ' srx RT_FLOW: RT_FLOW_SESSION_DENY: session denied ', src, '/', sport, '->', dst, '/',"
        " dport, ' 0x0 junos-ssh 6(0) default-deny untrust trust UNKNOWN policy deny')"
        " WHEN 2 THEN concat('{\"vendor\":\"edr_agent\",\"event_simpleName\":\"ProcessRollup2\",\"aid\":\"a', user_id % 7,"
        " '\",\"timestamp\":\"', ms, '\",\"ComputerName\":\"WS-', user_id % 9, '\",\"UserName\":\"u', user_id,"
        " '\",\"ImageFileName\":\"C:/x/p.exe\",\"CommandLine\":\"p.exe -n ', eid, '\",\"RawProcessId\":\"', 1000 + eid % 8000, '\"}')"
        " ELSE concat('<134>', bsd, ' fw01 filterlog[88]: 5,,,1000000103,igb0,match,', if(blocked, 'block', 'pass'),"
        " ',in,6,0x00,0x00000,64,tcp,6,40,2001:db8:', user_id % 9 + 1, '::', tail, ',2001:db8::1,', sport, ',', dport,"
        " ',0,S,1,,64240,,mss') END",
    11: "CASE WHEN k % 2 = 0 THEN concat('###UNKNOWN### code=', user_id, ' x~~y')"
        " ELSE concat(bsd, ' fw01 filterlog: SOMETHING_NEW code=', user_id) END",
}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    df = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").selectExpr(*_BASE)
    df = df.selectExpr(
        "*", "CASE WHEN event_type = 'error' THEN dst0 ELSE src0 END AS src",
        "CASE WHEN event_type = 'error' THEN src0 ELSE dst0 END AS dst", "bytes_out * 2 AS bytes_in",
        "unix_millis(ts) AS ms", "unix_millis(ts) DIV 1000 AS secs", "date_format(ts, 'MMM dd HH:mm:ss') AS bsd",
        "date_format(ts, 'MMM dd yyyy HH:mm:ss') AS bsd_year", "date_format(ts, 'yyyy-MM-dd') AS day",
        "date_format(ts, 'HH:mm:ss') AS clock", "date_format(ts, 'yyyy/MM/dd HH:mm:ss') AS slash",
        "date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS') AS iso", "ts + INTERVAL 1 SECOND AS ingest_time",
        "CASE WHEN family IN (2, 3) OR (family = 10 AND k % 4 = 2) THEN 'http' WHEN family = 4 THEN 'file:squid'"
        " ELSE 'udp:5514' END AS channel")
    return df


def lines(spark: SparkSession, sf_dir: str, *families: int) -> DataFrame:
    """(eid, family, k, text, channel, ingest_time, ...) for all or some families."""
    df = base(spark, sf_dir)
    wanted = families or tuple(_LINES)
    if families:
        df = df.filter("family IN (" + ", ".join(map(str, families)) + ")")
    body = "CASE family " + " ".join(f"WHEN {f} THEN {_LINES[f]}" for f in wanted) + " END" if len(wanted) > 1 \
        else _LINES[wanted[0]]
    return df.selectExpr("eid", "family", "k", "user_id", "event_type", "ts", "ms", "channel", "ingest_time",
                         f"{body} AS text")


def raw_events(spark: SparkSession, sf_dir: str, *families: int) -> DataFrame:
    """The same lines as raw events with minted ids (row key: the event id)."""
    df = lines(spark, sf_dir, *families).selectExpr(
        "eid", "family", "k", "user_id", "event_type", "ts", "ms", "text", "CAST(text AS BINARY) AS raw", "channel",
        "CAST(NULL AS STRING) AS source_hint", "ingest_time")
    return mint_ids(df, "eid")
