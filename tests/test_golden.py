"""Golden lines of every device family: one frame, one parse, then field checks."""

import pytest
from pyspark.sql import functions as F

from logloom.plans.pipeline import parse_flat, to_events_with
from logloom.plans.registry import Registry

U = "udp:5514"
GOLDEN = [
    (U, "Jan 03 10:22:01 fw9 filterlog: rule 7 block in on em0 src=10.9.2.3 dst=192.168.7.5 proto=tcp",
     {"metadata.source_id": "pfsense", "class_uid": 4001, "activity_name": "Refuse", "disposition": "Blocked", "action": "Denied",
      "connection_info.protocol_num": 6, "connection_info.direction": "Lateral", "device.hostname": "fw9", "severity_id": 2}),
    (U, "<134>Jan 03 10:22:01 fw9 filterlog[12]: 5,,,1000000103,igb1,match,pass,in,4,0x0,,64,0,0,DF,17,udp,60,10.9.2.3,9.9.9.9,53001,53,0",
     {"metadata.source_id": "pfsense", "activity_name": "Traffic", "dst_endpoint.port": 53, "dst_endpoint.svc_name": "dns",
      "connection_info.direction": "Outbound", "metadata.envelope.procid": "12"}),
    ("file:squid", "1704277321.456    195 10.9.2.32 TCP_DENIED/403 4120 CONNECT bad.example:443 alice HIER_NONE/- text/html",
     {"metadata.source_id": "squid", "class_uid": 4002, "activity_name": "Connect", "http_response.code": 403,
      "actor.user.name": "alice", "disposition": "Blocked", "time": 1704277321456}),
    ("http", '{"timestamp":"2024-01-03T10:22:04.123456+0000","event_type":"alert","src_ip":"203.0.113.9","src_port":51820,"dest_ip":"10.9.2.15",'
             '"dest_port":445,"proto":"TCP","alert":{"action":"blocked","signature_id":7,"signature":"SIG","category":"C","severity":1}}',
     {"metadata.source_id": "suricata", "class_uid": 2004, "activity_name": "Create", "finding_info.title": "SIG", "severity": "High",
      "disposition": "Blocked", "time_dt": "2024-01-03T10:22:04.123456+00:00", "enrichments.dst_port_risky": True}),
    (U, '<166>Jan 03 2024 10:22:01 asa9 : %ASA-4-106023: Deny tcp src outside:203.0.113.9/51820 dst inside:10.9.2.15/443 by access-group "acl_out"',
     {"metadata.source_id": "cisco_asa", "activity_name": "Refuse", "src_endpoint.port": 51820, "firewall_rule.name": "acl_out",
      "severity": "Medium", "time_dt": "2024-01-03T10:22:01+00:00"}),
    ("tcp:9999", "%ASA-6-302014: Teardown TCP connection 77 for outside:198.51.100.2/5 to inside:10.9.2.15/443 duration 0:00:07 bytes 5230 x",
     {"metadata.source_id": "cisco_asa", "activity_name": "Close", "traffic.bytes": 5230, "connection_info.uid": "77"}),
    (U, 'date=2024-01-03 time=10:22:01 devname="FG9" type="traffic" level="notice" srcip=10.9.2.3 srcport=51820 dstip=9.9.9.9 dstport=443 '
        'proto=6 action="accept" sentbyte=1234 vd="root" custom="keep me"',
     {"metadata.source_id": "fortigate", "connection_info.protocol_name": "tcp", "traffic.bytes_out": 1234, "device.hostname": "FG9",
      "time_dt": "2024-01-03T10:22:01+00:00", "unmapped.custom": "keep me", "unmapped.vd": "root"}),
    (U, "<14>Jan 03 10:22:02 PA9 1,2024/01/03 10:22:02,0128,TRAFFIC,drop,2561,2024/01/03 10:22:02,203.0.113.9,10.9.2.15,0.0.0.0,0.0.0.0,block-in,,,"
        "none,vsys1,untrust,trust,ethernet1/1,,default,,0,1,4444,445,0,0,0x0,tcp,deny,60,60,0,1,2024/01/03 10:22:02,0,any,,7102,0x0,DE,US,,1,0,policy-deny",
     {"metadata.source_id": "paloalto", "activity_name": "Refuse", "src_endpoint.zone": "untrust", "firewall_rule.name": "block-in",
      "disposition": "Blocked", "dst_endpoint.port": 445}),
    (U, "CEF:0|Some Vendor|Wall & Gate|R81|Drop|Drop|5|src=203.0.113.9 spt=51820 dst=10.9.2.15 dpt=22 proto=TCP act=Drop rt=1704277321000",
     {"metadata.source_id": "generic_cef", "metadata.product.vendor_name": "Some Vendor", "disposition": "Dropped", "severity": "Medium"}),
    (U, "CEF:0|Acme|Audit|1.0|100|Admin login|3|suser=bob rt=Jan 03 2024 10:22:01",
     {"metadata.source_id": "generic_cef_base", "class_uid": 0, "actor.user.name": "bob", "time_dt": "2024-01-03T10:22:01+00:00"}),
    (U, "LEEF:2.0|Vend|SRX|21.2|FLOW_DENY|^|src=10.9.2.3^dst=9.9.9.9^srcPort=51234^dstPort=53^proto=17^action=deny^sev=5",
     {"metadata.source_id": "generic_leef", "metadata.product.vendor_name": "Vend", "connection_info.protocol_name": "udp"}),
    (U, "LEEF:1.0|Imp|WAF|14.7|Blocked\tsrc=203.0.113.9\tdst=10.9.2.88\tsrcPort=51820\tdstPort=443\tproto=TCP\taction=block\tsev=8",
     {"metadata.source_id": "generic_leef", "dst_endpoint.port": 443, "disposition": "Blocked", "metadata.event_code": "Blocked"}),
]
BAD = [
    ("###UNKNOWN### code=1 weird~~value", "no_parser_match", None),
    ("Jan 03 10:22:01 fw9 filterlog: SOMETHING_NEW code=1", "tokenize_failed", "pfsense"),
    ("Jan 03 10:22:01 fw9 filterlog: rule 7 block in on em0 src=not-an-ip dst=192.168.7.5 proto=tcp", "schema_violation", "pfsense"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, c, t) for i, (c, t, _) in enumerate(GOLDEN)] + [(100 + i, U, t) for i, (t, _, _) in enumerate(BAD)]
    df = spark.createDataFrame(rows, "n INT, channel STRING, text STRING").selectExpr(
        "*", "'11111111-1111-4111-8111-111111111111' AS event_id", "repeat('a', 64) AS sha256", "'local://t/x' AS raw_ref",
        "1L AS size_bytes", "timestamp'2024-01-03 10:22:05' AS ingest_time")
    flat = parse_flat(df, Registry.load())
    good = {r["n"]: r.asDict(True) for r in to_events_with(flat, "n").collect()}
    bad = {r["n"]: r for r in flat.filter("reason IS NOT NULL").select("n", "reason", "parser_id").collect()}
    return good, bad


@pytest.mark.parametrize("n", range(len(GOLDEN)))
def test_golden(parsed, n):
    event = parsed[0][n]
    for path, want in GOLDEN[n][2].items():
        got = event
        for part in path.split("."):
            got = got[part]
        assert got == want, path
    assert event["type_uid"] == event["class_uid"] * 100 + event["activity_id"]


@pytest.mark.parametrize("n", range(len(BAD)))
def test_quarantined(parsed, n):
    row = parsed[1][100 + n]
    assert (row["reason"], row["parser_id"]) == BAD[n][1:]
    assert set(parsed[1]) == {100 + i for i in range(len(BAD))}
