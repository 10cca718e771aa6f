"""Enrichment: zones, direction, service names, feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..functions.sqltext import lookup
from ..schema import DIRECTION, INTERNAL_NETWORKS, RISKY_PORTS, WELL_KNOWN_PORTS


def ip_in_cidrs(col: str, cidrs=INTERNAL_NETWORKS) -> Column:
    """BOOLEAN membership of an address text in a fixed list; NULL for a bad address."""
    return F.expr(ipf.in_cidrs(f"({ipf.ipv4_num(col)})", f"({ipf.ipv6_hex(col)})", cidrs))


def zone_sql(internal: str) -> str:
    return f"CASE WHEN {internal} THEN 'internal' WHEN NOT {internal} THEN 'external' END"


def direction_sql(src: str, dst: str) -> str:
    return (f"CASE WHEN {src} AND {dst} THEN 3 WHEN {src} AND NOT {dst} THEN 2"
            f" WHEN NOT {src} AND {dst} THEN 1 WHEN NOT {src} AND NOT {dst} THEN 0 END")


def service_sql(port: str) -> str:
    return lookup(WELL_KNOWN_PORTS, f"CAST({port} AS STRING)")


def port_class_sql(port: str) -> str:
    return (f"CASE WHEN {port} < 1024 THEN 'well_known' WHEN {port} < 49152 THEN 'registered'"
            f" WHEN {port} IS NOT NULL THEN 'dynamic' END")


def risky_sql(port: str) -> str:
    return f"{port} IN ({', '.join(map(str, RISKY_PORTS))})"


def severity_score_sql(sev: str) -> str:
    return f"CASE WHEN {sev} = 99 THEN 0 ELSE {sev} END"


def enrich_leaves(cidrs) -> list:
    """Stages over the flat event leaves (see plans.normalizer)."""

    def numbers(r):
        return {f"{s}_{n}": fn(r(f"{s}_endpoint__ip"))
                for s in ("src", "dst") for n, fn in (("num4", ipf.ipv4_num), ("hex6", ipf.ipv6_hex))}

    def inside(r):
        return {f"enrichments__{s}_is_internal": ipf.in_cidrs(r(f"{s}_num4"), r(f"{s}_hex6"), cidrs)
                for s in ("src", "dst")}

    def finish(r):
        src, dst = r("enrichments__src_is_internal"), r("enrichments__dst_is_internal")
        port = r("dst_endpoint__port")
        given = r("connection_info__direction_id")
        direction_id = f"coalesce({given}, {direction_sql(src, dst)})"
        derived = f"CASE WHEN {src} IS NOT NULL AND {dst} IS NOT NULL THEN" \
                  f" {lookup(DIRECTION, f'CAST({direction_id} AS STRING)')} END"
        return {
            "src_endpoint__zone": f"coalesce({r('src_endpoint__zone')}, {zone_sql(src)})",
            "dst_endpoint__zone": f"coalesce({r('dst_endpoint__zone')}, {zone_sql(dst)})",
            "dst_endpoint__svc_name": f"coalesce({r('dst_endpoint__svc_name')}, {service_sql(port)})",
            "connection_info__direction_id": direction_id,
            "connection_info__direction": f"coalesce({r('connection_info__direction')}, {derived})",
            "enrichments__dst_port_class": port_class_sql(port),
            "enrichments__dst_port_risky": risky_sql(port),
            "enrichments__is_blocked": f"coalesce({r('action_id')} = 2, false)",
            "enrichments__is_finding": f"coalesce({r('class_uid')} = 2004, false)",
            "enrichments__severity_score": severity_score_sql(r("severity_id")),
        }

    return [numbers, inside, finish]


# ---------------------------------------------------------------- table operators
def enrich_endpoints(df: DataFrame, src_ip: str = "src_ip", dst_ip: str = "dst_ip", dst_port: str = "dst_port",
                     cidrs=INTERNAL_NETWORKS) -> DataFrame:
    """Adds zone, direction, service and port features to a table of flows."""
    keep = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*keep, f"{ipf.ipv4_num(src_ip)} AS _s4", f"{ipf.ipv6_hex(src_ip)} AS _s6",
                       f"{ipf.ipv4_num(dst_ip)} AS _d4", f"{ipf.ipv6_hex(dst_ip)} AS _d6",
                       f"try_cast({dst_port} AS INT) AS _port")
    df = df.selectExpr(*keep, "_port", f"{ipf.in_cidrs('_s4', '_s6', cidrs)} AS src_is_internal",
                       f"{ipf.in_cidrs('_d4', '_d6', cidrs)} AS dst_is_internal")
    direction = direction_sql("src_is_internal", "dst_is_internal")
    return df.selectExpr(
        *keep, "src_is_internal", "dst_is_internal",
        f"{zone_sql('src_is_internal')} AS src_zone", f"{zone_sql('dst_is_internal')} AS dst_zone",
        f"{direction} AS direction_id", f"{lookup(DIRECTION, f'CAST({direction} AS STRING)')} AS direction",
        f"{service_sql('_port')} AS svc_name", f"{port_class_sql('_port')} AS dst_port_class",
        f"{risky_sql('_port')} AS dst_port_risky",
    )


def cidr_table(spark, cidrs) -> DataFrame:
    """Networks as rows: (cidr, version, low4, high4, low6, high6)."""
    rows = []
    for c in cidrs:
        version, low, high = ipf.cidr_bounds(c)
        rows.append((c, version, low, high, None, None) if version == 4 else (c, version, None, None, low, high))
    return spark.createDataFrame(
        rows, "cidr STRING, version INT, low4 BIGINT, high4 BIGINT, low6 STRING, high6 STRING")


def network_bounds(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """A column of network texts -> (cidr, low4, high4, low6, high6), each network once; host bits are cleared
    and texts that are no network are left out."""
    size = "try_cast(split(cidr, '/')[1] AS INT)"
    df = networks.select(F.col(cidr).alias("cidr")).filter("cidr IS NOT NULL").distinct().selectExpr(
        "cidr", "split(cidr, '/')[0] AS _ip", f"CASE WHEN contains(cidr, '/') THEN {size} WHEN contains(cidr, ':') THEN 128 ELSE 32 END AS _p")
    df = df.selectExpr("cidr", "_p", f"{ipf.ipv4_num('_ip')} AS _n4", f"{ipf.ipv6_hex('_ip')} AS _n6")
    df = df.filter("(_n4 IS NOT NULL AND _p BETWEEN 0 AND 32) OR (_n6 IS NOT NULL AND _p BETWEEN 0 AND 128)")
    host = "(shiftleft(1L, 32 - _p) - 1)"
    nibble = "CAST(conv(substr(_n6, _p DIV 4 + 1, 1), 16, 10) AS INT)"
    free = "(shiftright(15, _p % 4))"  # host bits of the digit that the prefix ends in
    digit = "lower(hex({}))"
    low = digit.format(f"{nibble} & ~{free}")
    high = digit.format(f"{nibble} | {free}")
    ends = "CASE WHEN _n6 IS NULL THEN NULL WHEN _p = 128 THEN _n6 ELSE concat(left(_n6, _p DIV 4), {}, repeat('{}', 31 - _p DIV 4)) END"
    return df.selectExpr("cidr", f"CASE WHEN _n4 IS NOT NULL THEN _n4 & ~{host} END AS low4", f"CASE WHEN _n4 IS NOT NULL THEN _n4 | {host} END AS high4",
                         f"{ends.format(low, '0')} AS low6", f"{ends.format(high, 'f')} AS high6")


def join_cidrs(df: DataFrame, ip: str, networks: DataFrame, bucket_bits: int = 16) -> DataFrame:
    """Every (row, network) pair whose address lies in the network, for a network TABLE.

    Range join as an equi-join.  An IPv4 network is listed under each 2^(32-bucket_bits)
    block it covers (65536 at most) and an address under its own block.  An IPv6 network is
    listed once, under the whole digits of its prefix; an address is looked up at each
    prefix length that the table has (33 at most; the set of lengths is read first).  The
    range test finishes the match, no side is assumed small, and AQE splits a hot block.
    """
    shift = 32 - bucket_bits
    keep = [f"`{c}`" for c in df.columns]
    # leading digits that the ends of a network share
    depth = "CASE WHEN low6 = high6 THEN 32 ELSE array_min(filter(sequence(0, 31), i -> substr(low6, i + 1, 1) <> substr(high6, i + 1, 1))) END"
    found = networks.filter("low6 IS NOT NULL").select(F.expr(depth).alias("d")).distinct().collect()
    depths = ", ".join(str(d) for d in sorted(r["d"] for r in found))
    left = df.selectExpr(*keep, f"{ipf.ipv4_num(ip)} AS _n4", f"{ipf.ipv6_hex(ip)} AS _n6")
    left = left.selectExpr(
        *keep, "_n4", "_n6", f"explode(CASE WHEN _n4 IS NOT NULL THEN array(concat('4:', shiftright(_n4, {shift})))"
        + (f" WHEN _n6 IS NOT NULL THEN transform(array({depths}), d -> concat('6:', d, ':', left(_n6, d)))" if found else "")
        + " END) AS _block")
    right = networks.selectExpr(
        "cidr", "low4", "high4", "low6", "high6",
        f"explode(CASE WHEN low4 IS NOT NULL THEN transform(sequence(shiftright(low4, {shift}),"
        f" shiftright(high4, {shift})), b -> concat('4:', b)) ELSE array(concat('6:', {depth}, ':', left(low6, {depth}))) END) AS _block")
    hit = F.expr("coalesce(_n4 BETWEEN low4 AND high4, false) OR coalesce(_n6 BETWEEN low6 AND high6, false)")
    joined = left.join(right, "_block").filter(hit)
    return joined.select(*df.columns, "cidr")
