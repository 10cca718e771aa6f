"""Queries over the inference of parser definitions, from the drift families."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import heal, infer
from ..operators import registry_log as rl
from ..plans import interpreted as ip
from ..plans.lineage import cut
from .operations import corpus
from .oracle import BASE
from .parsing import reg

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# sub-family of a drift line; the cluster id is its name
_SUB = "concat('c', k % 4)"


def samples(spark, sf, k: int = 25) -> DataFrame:
    """Newest 25 lines (the sample size of a proposal) of each drift sub-family."""
    df = fx.lines(spark, sf, 10).selectExpr("eid AS event_id", "eid", f"{_SUB} AS cluster_id", "text", "channel", "ts", "ingest_time")
    return cut(infer.select_samples(df, k))


def tokens_of(s: DataFrame) -> DataFrame:
    return cut(infer.infer_tokens(s))


_S = BASE + """, n AS (SELECT *, k % 4 AS sub, 'c' || (k % 4) AS cluster_id, row_number() OVER (PARTITION BY k % 4 ORDER BY ts DESC, eid DESC) AS rn FROM d WHERE family = 10),
 s AS (SELECT * FROM n WHERE rn <= 25), tot AS (SELECT cluster_id, any_value(sub) AS sub, count(*) AS n FROM s GROUP BY 1) """


@query("infer_format", _S + "SELECT cluster_id, CASE sub WHEN 0 THEN 'kv' WHEN 1 THEN 'text' WHEN 2 THEN 'json' ELSE 'csv' END AS format, CAST(n AS BIGINT) AS votes FROM tot")
def infer_format(spark, sf):
    return infer.infer_format(samples(spark, sf))


@query("infer_delimiter", "SELECT user_id, CASE user_id % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ';' END AS delimiter FROM (SELECT DISTINCT user_id FROM events)")
def infer_delimiter(spark, sf):
    """One separated layout per user, over all of the user's rows."""
    df = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id AS cluster_id", "array_join(array(CAST(event_id AS STRING), event_type, CAST(value AS STRING), 'a', 'b'),"
        " element_at(array(',', '\\t', '|', ';'), CAST(user_id % 4 + 1 AS INT))) AS payload")
    return infer.infer_delimiter(df).withColumnRenamed("cluster_id", "user_id")


@query("infer_tokens", _S + "SELECT cluster_id, eid, token, value FROM (SELECT cluster_id, eid, sub, unnest([{'t': 'src', 'v': src || ':' || sport || ':X1'}, {'t': 'fw_action', 'v': CASE WHEN blocked THEN 'drop' ELSE 'forward' END}]) AS u FROM s WHERE sub = 0 "
       "UNION ALL SELECT cluster_id, eid, sub, unnest([{'t': 'CommandLine', 'v': 'p.exe -n ' || eid}, {'t': 'UserName', 'v': 'u' || user_id}]) FROM s WHERE sub = 2 "
       "UNION ALL SELECT cluster_id, eid, sub, unnest([{'t': 'col16', 'v': '2001:db8:' || (user_id % 9 + 1) || '::' || tail}, {'t': 'col18', 'v': CAST(sport AS VARCHAR)}]) FROM s WHERE sub = 3 "
       "UNION ALL SELECT cluster_id, eid, sub, unnest([{'t': 'src_ip', 'v': src}, {'t': 'dst_port', 'v': CAST(dport AS VARCHAR)}]) FROM s WHERE sub = 1) q, LATERAL (SELECT u.t AS token, u.v AS value)")
def infer_tokens(spark, sf):
    s = samples(spark, sf)
    ids = s.select("cluster_id", "sample", "eid")
    wanted = ["src", "fw_action", "CommandLine", "UserName", "col16", "col18", "src_ip", "dst_port"]
    return tokens_of(s).filter(F.col("token").isin(wanted)).join(ids, ["cluster_id", "sample"]).select(
        "cluster_id", "eid", "token", "value")


@query("infer_key_profile", _S + "SELECT cluster_id, token, CAST(count(*) AS BIGINT) AS present, CAST(count(DISTINCT v) AS BIGINT) AS kinds, token IN ('col16') AS all_ip, token = 'src' AS all_ip_port, token IN ('col18', 'RawProcessId') AS all_int FROM ("
       "SELECT cluster_id, 'src' AS token, src || ':' || sport AS v FROM s WHERE sub = 0 UNION ALL SELECT cluster_id, 'col16', (user_id % 9) || '.' || tail FROM s WHERE sub = 3 UNION ALL SELECT cluster_id, 'col18', CAST(sport AS VARCHAR) FROM s WHERE sub = 3 "
       "UNION ALL SELECT cluster_id, 'RawProcessId', CAST(1000 + eid % 8000 AS VARCHAR) FROM s WHERE sub = 2) GROUP BY 1, 2")
def infer_key_profile(spark, sf):
    p = infer.key_profile(tokens_of(samples(spark, sf)))
    return p.filter(F.col("token").isin("src", "col16", "col18", "RawProcessId")).selectExpr(
        "cluster_id", "token", "present", "kinds", "all_ip", "all_ip_port", "all_int")


@query("infer_const_keys", _S + "SELECT tot.cluster_id, t.token, t.value, CAST(tot.n AS BIGINT) AS total FROM tot JOIN (VALUES (0, 'id', 'firewall'), (0, 'sn', '0017C5'), (0, 'fw', '203.0.113.1'), (0, 'c', '32'), (0, 'm', '36'), (0, 'msg', 'Connection'), (0, 'proto', 'tcp/https')) t(sub, token, value) ON t.sub = tot.sub")
def infer_const_keys(spark, sf):
    s = samples(spark, sf)
    return infer.const_keys(infer.key_profile(tokens_of(s)), s).filter("cluster_id = 'c0'").select(
        "cluster_id", "token", "value", "total")


@query("infer_columns", _S + "SELECT 'c1' AS cluster_id, CAST(pos AS BIGINT) AS pos, constant, kind FROM (VALUES (0, TRUE, NULL), (1, TRUE, NULL), (2, TRUE, NULL), (3, FALSE, 'flow'), (4, TRUE, NULL), (5, TRUE, NULL), (6, TRUE, NULL), (7, TRUE, NULL), (8, TRUE, NULL), (9, TRUE, NULL), (10, TRUE, NULL), (11, TRUE, NULL), (12, TRUE, NULL)) v(pos, constant, kind) "
       "WHERE (SELECT count(*) FROM s WHERE sub = 1) > 1")
def infer_columns(spark, sf):
    s = samples(spark, sf).filter("cluster_id = 'c1'")
    return infer.infer_columns(s).selectExpr("cluster_id", "CAST(pos AS BIGINT) AS pos", "constant", "kind")


def _mapping(spark, sf) -> DataFrame:
    return infer.infer_mapping(infer.key_profile(tokens_of(samples(spark, sf))))


_MAP = """(VALUES (0, 'src_ip', 'src_endpoint.ip'), (0, 'src_port', 'src_endpoint.port'), (0, 'dst_ip', 'dst_endpoint.ip'), (0, 'dst_port', 'dst_endpoint.port'),
 (0, 'proto', 'connection_info.protocol_name'), (0, 'fw_action', 'disposition'), (0, 'pri', 'severity_id'), (0, 'msg', 'message'), (0, 'fw', 'device.hostname'),
 (0, 'sn', 'device.uid'), (0, 'id', 'metadata.event_code'),
 (1, 'src_ip', 'src_endpoint.ip'), (1, 'src_port', 'src_endpoint.port'), (1, 'dst_ip', 'dst_endpoint.ip'), (1, 'dst_port', 'dst_endpoint.port'),
 (2, 'CommandLine', 'process.cmd_line'), (2, 'ComputerName', 'src_endpoint.hostname'), (2, 'ImageFileName', 'process.file.path'), (2, 'UserName', 'actor.user.name'),
 (2, 'aid', 'device.uid')) t(sub, token, path)"""


@query("infer_assign", _S + f"SELECT cluster_id, t.token, t.path FROM tot JOIN {_MAP} ON t.sub = tot.sub")
def infer_assign(spark, sf):
    return _mapping(spark, sf).filter("cluster_id <> 'c3'").select("cluster_id", "token", "path")


@query("infer_shape_assign", _S + "SELECT 'c3' AS cluster_id, token, path FROM (VALUES ('col16', 'src_endpoint.ip'), ('col17', 'dst_endpoint.ip'), ('col18', 'src_endpoint.port'), ('col19', 'dst_endpoint.port'), ('col13', 'connection_info.protocol_name'), ('col7', 'disposition')) t(token, path) WHERE (SELECT count(*) FROM s WHERE sub = 3) > 0")
def infer_shape_assign(spark, sf):
    return _mapping(spark, sf).filter("cluster_id = 'c3'").select("cluster_id", "token", "path")


@query("infer_dispositions", _S + "SELECT DISTINCT cluster_id, verb, CASE verb WHEN 'drop' THEN 'Dropped' WHEN 'block' THEN 'Blocked' ELSE 'Allowed' END AS disposition, CASE WHEN verb IN ('drop', 'block') THEN 'Refuse' ELSE 'Traffic' END AS activity FROM ("
       "SELECT cluster_id, CASE sub WHEN 0 THEN CASE WHEN blocked THEN 'drop' ELSE 'forward' END ELSE CASE WHEN blocked THEN 'block' ELSE 'pass' END END AS verb FROM s WHERE sub IN (0, 3))")
def infer_dispositions(spark, sf):
    tokens = tokens_of(samples(spark, sf))
    return infer.infer_dispositions(tokens, infer.infer_mapping(infer.key_profile(tokens))).select("cluster_id", "verb", "disposition", "activity")


@query("infer_class", _S + "SELECT cluster_id, CAST(CASE sub WHEN 2 THEN 1007 ELSE 4001 END AS BIGINT) AS class_uid, CASE sub WHEN 2 THEN 'Launch' ELSE 'Traffic' END AS activity FROM tot")
def infer_class(spark, sf):
    return infer.infer_class(_mapping(spark, sf)).selectExpr("cluster_id", "CAST(class_uid AS BIGINT) AS class_uid", "activity")


@query("infer_timestamp", _S + "SELECT cluster_id, CASE sub WHEN 0 THEN 'time' WHEN 2 THEN 'timestamp' ELSE 'envelope' END AS source, CASE sub WHEN 0 THEN '%Y-%m-%d %H:%M:%S UTC' WHEN 2 THEN 'epoch_ms' END AS format FROM tot")
def infer_timestamp(spark, sf):
    s = samples(spark, sf)
    return infer.infer_timestamp(tokens_of(s), s).select("cluster_id", "source", "format")


@query("infer_fingerprint", _S + "SELECT cluster_id, CASE sub WHEN 2 THEN 'json_key' ELSE 'contains' END AS type, CASE sub WHEN 0 THEN 'id=firewall' WHEN 1 THEN 'RT_FLOW_SESSION_DENY:' WHEN 2 THEN 'edr_agent' ELSE ',igb0,' END AS pattern FROM tot")
def infer_fingerprint(spark, sf):
    s = samples(spark, sf)
    return infer.infer_fingerprint(tokens_of(s), s).select("cluster_id", "type", "pattern")


@query("set_common_tokens", "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z%_][A-Za-z0-9_%:.\\-]{4,}')) AS literal FROM conversations), n AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY 1) "
       "SELECT w.conv_id, literal FROM w JOIN n ON n.conv_id = w.conv_id GROUP BY w.conv_id, literal, total HAVING count(*) = total")
def set_common_tokens(spark, sf):
    """Literals found in every turn of a conversation."""
    df = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id AS cluster_id", "turn AS sample", "text")
    return infer.common_tokens(df).withColumnRenamed("cluster_id", "conv_id")


@query("infer_source_id", _S + "SELECT cluster_id, CASE sub WHEN 0 THEN 'swall' WHEN 1 THEN 'rt_flow_2' WHEN 2 THEN 'edr_agent_3' ELSE 'filterlog' END AS source_id FROM tot")
def infer_source_id(spark, sf):
    """Names already taken come from the data: two of the names, one of them twice."""
    s = samples(spark, sf)
    taken = s.selectExpr("CASE cluster_id WHEN 'c1' THEN 'rt_flow' WHEN 'c2' THEN if(sample % 2 = 0, 'edr_agent', 'edr_agent_2') ELSE 'other' END AS source_id")
    return infer.suggest_source_id(s, taken)


@query("aware_conflicts", _S + f" SELECT cluster_id, token, proposed_path, live_path, live_source FROM (SELECT cluster_id, t.token, t.path AS proposed_path FROM tot JOIN {_MAP} ON t.sub = tot.sub) p "
       "JOIN (VALUES ('src_ip', 'src_endpoint.ip', 'suricata'), ('src_ip', 'src_endpoint.ip', 'suricata_eve'), ('src_port', 'src_endpoint.port', 'suricata'), ('proto', 'connection_info.protocol_num', 'fortigate')) v(token, live_path, live_source) USING (token) WHERE proposed_path <> live_path")
def aware_conflicts(spark, sf):
    return rl.mapping_conflicts(_mapping(spark, sf).select("cluster_id", "token", "path"), reg().fields_frame(spark)).select(
        "cluster_id", "token", "proposed_path", "live_path", "live_source")


def _js_of(verb_sql: str, sub: int, pairs: dict) -> str:
    """JSON members of the verbs that a sub-family's samples show, in order."""
    cases = " ".join(f"WHEN '{k}' THEN '\"{k}\":\"{v}\"'" for k, v in pairs.items())
    return f"(SELECT string_agg(CASE v {cases} END, ',' ORDER BY v) FROM (SELECT DISTINCT {verb_sql} AS v FROM s WHERE sub = {sub}))"


_KV_VERB, _CSV_VERB = "CASE WHEN blocked THEN 'drop' ELSE 'forward' END", "CASE WHEN blocked THEN 'block' ELSE 'pass' END"
_IPV4 = r"(?:\\d{1,3}\\.){3}\\d{1,3}"
_PARTS = f"""
 parts AS (
  SELECT cluster_id, 'swall' AS source_id, 'udp:5514' AS channel, 'kv' AS format, 7 AS mapped_fields, 'swall' AS product_name,
   '{{"type":"contains","pattern":"id=firewall"}}' AS fingerprint, '{{"type":"kv"}}' AS tokenize, '{{"class_uid":4001,"activity":"Traffic"}}' AS ocsf,
   '{{"fields":{{"dst_ip":"dst_endpoint.ip","dst_port":"dst_endpoint.port","fw":"device.hostname","fw_action":"disposition","id":"metadata.event_code","msg":"message",'
   || '"pri":"severity_id","proto":"connection_info.protocol_name","sn":"device.uid","src_ip":"src_endpoint.ip","src_port":"src_endpoint.port"}},'
   || '"extract":[{{"from":"dst","pattern":"^(?P<dst_ip>{_IPV4})[:/](?P<dst_port>\\\\d+)"}},{{"from":"src","pattern":"^(?P<src_ip>{_IPV4})[:/](?P<src_port>\\\\d+)"}}],"values":{{"fw_action":{{'
   || {_js_of(_KV_VERB, 0, {"drop": "Dropped", "forward": "Allowed"})} || '}},"pri":{{"0":"6","1":"5","2":"5","3":"4","4":"3","5":"2","6":"1","7":"1"}}}},"lookups":[{{"from":"fw_action","to":"activity_name","map":{{'
   || {_js_of(_KV_VERB, 0, {"drop": "Refuse", "forward": "Traffic"})} || '}},"default":"Traffic"}}],"timestamp":{{"source":"time","format":"%Y-%m-%d %H:%M:%S UTC","fallback":"envelope"}}}}' AS mapping
  FROM tot WHERE sub = 0
  UNION ALL SELECT cluster_id, 'rt_flow', 'udp:5514', 'text', 4, 'RT_FLOW', '{{"type":"contains","pattern":"RT_FLOW_SESSION_DENY:"}}',
   '{{"type":"regex","pattern":"RT_FLOW_SESSION_DENY\\\\:\\\\s+session\\\\s+denied\\\\s+(?P<src_ip>{_IPV4})[:/](?P<src_port>\\\\d+)\\\\s*-+>\\\\s*(?P<dst_ip>{_IPV4})[:/](?P<dst_port>\\\\d+)'
   || '\\\\s+\\\\S+\\\\s+junos\\\\-ssh\\\\s+\\\\S+\\\\s+default\\\\-deny\\\\s+untrust\\\\s+trust\\\\s+UNKNOWN\\\\s+policy\\\\s+deny"}}',
   '{{"class_uid":4001,"activity":"Refuse","static":{{"disposition":"Blocked"}}}}',
   '{{"fields":{{"dst_ip":"dst_endpoint.ip","dst_port":"dst_endpoint.port","src_ip":"src_endpoint.ip","src_port":"src_endpoint.port"}},"timestamp":{{"source":"envelope"}}}}' FROM tot WHERE sub = 1
  UNION ALL SELECT cluster_id, 'edr_agent', 'http', 'json', 3, 'edr_agent', '{{"type":"json_key","key":"vendor","value":"edr_agent"}}', '{{"type":"json"}}', '{{"class_uid":1007,"activity":"Launch"}}',
   '{{"fields":{{"CommandLine":"process.cmd_line","ComputerName":"device.hostname","ImageFileName":"process.file.path","UserName":"actor.user.name","aid":"device.uid"}},"timestamp":{{"source":"timestamp","format":"epoch_ms"}}}}'
  FROM tot WHERE sub = 2
  UNION ALL SELECT cluster_id, 'filterlog', 'udp:5514', 'csv', 6, 'filterlog', '{{"type":"contains","pattern":",igb0,"}}',
   '{{"type":"csv","delimiter":",","fields":[' || (SELECT string_agg('"col' || i || '"', ',' ORDER BY i) FROM range(1, 27) r(i)) || '],"min_columns":24}}', '{{"class_uid":4001,"activity":"Traffic"}}',
   '{{"fields":{{"col13":"connection_info.protocol_name","col16":"src_endpoint.ip","col17":"dst_endpoint.ip","col18":"src_endpoint.port","col19":"dst_endpoint.port","col7":"disposition"}},"values":{{"col7":{{'
   || {_js_of(_CSV_VERB, 3, {"block": "Blocked", "pass": "Allowed"})} || '}}}},"lookups":[{{"from":"col7","to":"activity_name","map":{{' || {_js_of(_CSV_VERB, 3, {"block": "Refuse", "pass": "Traffic"})}
   || '}},"default":"Traffic"}}],"timestamp":{{"source":"envelope"}}}}' FROM tot WHERE sub = 3),
 whole AS (SELECT *, '{{"name":"' || product_name || '","vendor_name":"unknown"}}' AS product FROM parts)"""


@functools.lru_cache(maxsize=8)
def proposed(spark, sf) -> DataFrame:
    """Proposals of every drift sub-family, written out once per session and table folder."""
    s = samples(spark, sf)
    return cut(infer.propose(s, s.selectExpr("'other' AS source_id")))


@query("heal_propose", _S + "," + _PARTS + """ SELECT cluster_id, source_id, format, CAST(mapped_fields AS BIGINT) AS mapped_fields, product, fingerprint, tokenize, ocsf, mapping,
 '{"source_id":"' || source_id || '","version":"v1","log_name":"' || source_id || '","product":' || product || ',"channels":["' || channel || '"],"priority":55,"fingerprint":' || fingerprint
 || ',"tokenize":' || tokenize || ',"ocsf":' || ocsf || ',"mapping":' || mapping || '}' AS definition FROM whole""")
def heal_propose(spark, sf):
    """Definitions inferred for every drift sub-family, as JSON text, part by part and whole."""
    return proposed(spark, sf)


# What an operator could hand in besides: a parser that takes what isn't its own, and one that is no definition.
_GREEDY = {"source_id": "greedy", "channels": ["udp:5514"], "priority": 99, "fingerprint": {"type": "contains", "pattern": " src="}, "tokenize": {"type": "kv"},
           "ocsf": {"class_uid": 4001}, "mapping": {"fields": {"src": "src_endpoint.ip"}}}
_BROKEN = {"source_id": "edr_agent", "fingerprint": {"type": "json_key", "key": "vendor"}, "tokenize": {"type": "yaml"}, "mapping": {}}


def drift_lines(spark, sf) -> DataFrame:
    return fx.raw_events(spark, sf, 10).withColumn("cluster_id", F.expr(_SUB))


@functools.lru_cache(maxsize=8)
def candidates(spark, sf) -> DataFrame:
    """Inferred and drift candidates of all sub-families; the csv lines failed in a live parser."""
    live = ip.live_definitions(spark, reg())
    failed = drift_lines(spark, sf).selectExpr(
        "cluster_id", "CASE WHEN k % 4 = 3 THEN 'pfsense' END AS parser_id", "CASE WHEN k % 4 = 3 THEN 'tokenize_failed' ELSE 'no_parser_match' END AS reason", "event_id")
    inferred = proposed(spark, sf).select("cluster_id", "definition")
    found = heal.all_candidates(inferred, heal.drift_candidates(heal.drift_parents(failed), inferred, live))
    own = spark.createDataFrame([("c1", "c1:greedy", 9, json.dumps(_GREEDY)), ("c2", "c2:broken", 9, json.dumps(_BROKEN))], found.schema)
    return cut(found.unionByName(own))


@functools.lru_cache(maxsize=8)
def scores(spark, sf) -> DataFrame:
    """All candidates on all lines of their sub-family, and with all other lines of the table as the corpus."""
    lines, exp = corpus(spark, sf)
    keep = "file <> 'f10'"
    # the gate's corpus has a wrong class on purpose; here the live set must pass
    exp = exp.filter(keep).withColumn("class_uid", F.expr("CASE WHEN file = 'f6' THEN 4001 ELSE class_uid END"))
    return cut(heal.score(candidates(spark, sf), drift_lines(spark, sf), ip.live_definitions(spark, reg()), lines.filter(keep), exp))


_ALL = BASE + """, fam AS (SELECT 'c' || (k % 4) AS cluster_id, count(*) AS n FROM d WHERE family = 10 GROUP BY 1),
 rest AS (SELECT count(*) AS lines, count(*) FILTER (family = 1) AS taken FROM d WHERE family <> 10),
 cand(cluster_id, kind, valid, mapped, position) AS (VALUES ('c0', 'inferred', TRUE, 7, 2), ('c1', 'inferred', TRUE, 4, 2), ('c2', 'inferred', TRUE, 3, 2), ('c3', 'inferred', TRUE, 6, 2),
  ('c3', 'variant', TRUE, 6, 1), ('c1', 'greedy', TRUE, 1, 9), ('c2', 'broken', FALSE, 0, 9)),
 scored AS (SELECT c.cluster_id, c.cluster_id || ':' || kind AS candidate, valid AS valid_config, CASE WHEN kind IN ('greedy', 'broken') THEN 0 ELSE n END AS parsed, n AS total,
  CASE WHEN kind IN ('greedy', 'broken') THEN 0.0 ELSE 1.0 END AS match_rate, CASE WHEN valid THEN lines END AS regression_total,
  CASE WHEN valid THEN CASE kind WHEN 'greedy' THEN taken ELSE 0 END END AS regression_failed, valid AND (kind <> 'greedy' OR taken = 0) AS regression_passed, mapped AS mapped_fields
  FROM cand c JOIN fam USING (cluster_id), rest)"""


@query("heal_score", _ALL + " SELECT cluster_id, candidate, valid_config, CAST(parsed AS BIGINT) AS parsed, CAST(total AS BIGINT) AS total, CAST(match_rate AS DOUBLE) AS match_rate, regression_total, regression_failed, "
       "regression_passed, CAST(mapped_fields AS BIGINT) AS mapped_fields FROM scored")
def heal_score(spark, sf):
    """Every candidate of every cluster on the whole table, in one job."""
    return scores(spark, sf).select("cluster_id", "candidate", "valid_config", "parsed", "total", "match_rate", "regression_total", "regression_failed",
                                    "regression_passed", "mapped_fields")


def user_scores(spark, sf) -> DataFrame:
    """Scores counted from the whole table: a candidate for each type of event that a user has."""
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("position")).selectExpr(
        "user_id", "event_type AS candidate", "event_type <> 'signup' AS valid_config", "n % 2 = 0 AS regression_passed",
        "round(n % 10 / 10, 3) AS match_rate", "n % 4 AS mapped_fields", "position")


@query("heal_best_candidate", "WITH a AS (SELECT 'c' || (event_id // 12 % 4) AS cluster_id FROM events WHERE event_id % 12 = 10), "
       "s AS (SELECT user_id, event_type AS candidate, count(*) AS n, min(event_id) AS position FROM events GROUP BY 1, 2) "
       "SELECT CAST(NULL AS VARCHAR) AS cluster_id, user_id, candidate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY candidate <> 'signup' DESC, n % 2 = 0 DESC, n % 10 DESC, n % 4 DESC, position) AS rn FROM s) WHERE rn = 1 "
       "UNION ALL (SELECT DISTINCT cluster_id, CAST(NULL AS BIGINT), cluster_id || CASE cluster_id WHEN 'c3' THEN ':variant' ELSE ':inferred' END FROM a)")
def heal_best_candidate(spark, sf):
    """What the scores choose: of every user's candidates, and of every drift sub-family's, where the drift variant comes
    before an equal inferred definition."""
    users = heal.best_candidate(user_scores(spark, sf), "user_id").select(F.lit(None).cast("string").alias("cluster_id"), "user_id", "candidate")
    return users.unionByName(heal.best_candidate(scores(spark, sf)).select("cluster_id", F.lit(None).cast("long").alias("user_id"), "candidate"))


@query("heal_promotable", _ALL + " SELECT cluster_id, candidate, CASE WHEN cluster_id = 'c0' THEN 'proposal is superseded, not open' WHEN NOT valid_config THEN 'invalid parser config' "
       "WHEN NOT regression_passed THEN 'regression corpus failed' END AS refused FROM scored")
def heal_promotable(spark, sf):
    status = "CASE WHEN cluster_id = 'c0' THEN 'superseded' ELSE 'open' END"
    return heal.promotable(scores(spark, sf).withColumn("status", F.expr(status))).select("cluster_id", "candidate", "refused")


@query("heal_drift_definitions", _S + "," + _PARTS + """ SELECT 'pfsense' AS parent, 'pfsense_variant' AS source_id, CAST(59 AS BIGINT) AS priority, 'pfSense' AS product, 'filterlog' AS log_name, 'filterlog' AS own, ',igb0,' AS added,
 CAST(26 AS BIGINT) AS width, 'activity_name' AS looked_up, 'envelope' AS clock, regexp_extract(mapping, '"fields":([^}]*})', 1) AS fields, '{' || regexp_extract(mapping, '"values":{([^}]*}})', 1) AS verbs
 FROM whole WHERE source_id = 'filterlog'""")
def heal_drift_definitions(spark, sf):
    """The whole definition that follows the changed format of a live parser: the parent's identity, all that was inferred."""
    rows = candidates(spark, sf).filter("endswith(candidate, ':variant')").selectExpr("parse_json(definition) AS d")
    text = lambda path: f"variant_get(d, '$.{path}', 'string')"
    return rows.selectExpr(
        "'pfsense' AS parent", f"{text('source_id')} AS source_id", "variant_get(d, '$.priority', 'bigint') AS priority", f"{text('product.name')} AS product",
        f"{text('log_name')} AS log_name", f"{text('fingerprint.rules[0].pattern')} AS own", f"{text('fingerprint.rules[1].pattern')} AS added",
        "CAST(size(variant_get(d, '$.tokenize.fields', 'array<string>')) AS BIGINT) AS width", f"{text('mapping.lookups[0].to')} AS looked_up",
        f"{text('mapping.timestamp.source')} AS clock", "to_json(variant_get(d, '$.mapping.fields', 'variant')) AS fields",
        "to_json(variant_get(d, '$.mapping.values', 'variant')) AS verbs")
