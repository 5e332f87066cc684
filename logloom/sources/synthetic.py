"""A corpus of vendor lines with its truth, for tests and measurements: the same for the same seed, at any size.

A line's family and values come from hashes of its number and the seed, so tasks make their lines on their own. Layouts
follow the vendors' documentation; addresses are of documentation ranges and private nets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of each source in hundredths, and its line. Names in braces are the columns of `_VALUES`.
SOURCES: dict[str, tuple[int, str]] = {
    "panos.traffic": (22, "concat('<14>', {bsd}, ' fw-', {d}, ' 1,', {slashed}, ',77', {d}, ',TRAFFIC,end,1,', {slashed}, ',', {src}, ',', {dst}, ',,,\"Web, ', {d}, '\",', {user}, ',,', {app}, ',vs1,trust,untrust,e1,e2,fwd,1,', {n}, ',1,', {sport}, ',', {dport}, ',0,0,0x1,tcp,', {act}, ',', {bytes}, ',', {out}, ',', {bytes} - {out}, ',9,', {slashed}, ',4,any')"),
    "fortigate.traffic": (18, "concat('<189>date=', {day}, ' devname=\"fgt-', {d}, '\" devid=\"F', {d}, '\" type=\"traffic\" subtype=forward eventtime=', {t}, ' srcip=', {src}, ' srcport=', {sport}, ' dstip=', {dst}, ' dstport=', {dport}, ' sessionid=', {n}, ' action=\"', {act}, '\" policyname=\"Rule ', {d}, '\" app=\"', {app}, '\" srcuser=\"', {user}, '\" sentbyte=', {out}, ' rcvdbyte=', {bytes} - {out})"),
    "checkpoint.firewall": (9, "concat('<134>', {bsd}, ' cp-', {d}, ' time=', {t}, '|action=', {act}, '|origin=cp-', {d}, '|src=', {src}, '|s_port=', {sport}, '|dst=', {dst}, '|service=', {dport}, '|proto=tcp|bytes=', {bytes}, '|rule_name=Rule ', {d})"),
    "suricata.alert": (10, "concat('{{\"timestamp\":\"', {iso}, '+0000\",\"event_type\":\"alert\",\"src_ip\":\"', {src}, '\",\"src_port\":', {sport}, ',\"dest_ip\":\"', {dst}, '\",\"dest_port\":', {dport}, ',\"proto\":\"TCP\",\"alert\":{{\"action\":\"', {act}, '\",\"signature_id\":', {n}, ',\"signature\":\"SIG ', {d}, '\",\"severity\":2}}}}')"),
    "zeek.conn": (9, "concat('{{\"ts\":', {t}, '.5,\"uid\":\"C', {n}, '\",\"id.orig_h\":\"', {src}, '\",\"id.orig_p\":', {sport}, ',\"id.resp_h\":\"', {dst}, '\",\"id.resp_p\":', {dport}, ',\"proto\":\"tcp\",\"orig_bytes\":', {out}, ',\"resp_bytes\":', {bytes} - {out}, ',\"conn_state\":\"', {act}, '\"}}')"),
    "cisco.asa": (8, "concat('<166>', {bsd}, ' asa-', {d}, ' %ASA-6-302013: ', {act}, ' outbound TCP connection ', {n}, ' for outside:', {dst}, '/', {dport}, ' (', {dst}, '/', {dport}, ') to inside:', {src}, '/', {sport}, ' (', {src}, '/', {sport}, ')')"),
    "squid.access": (8, "concat({t}, '.250   ', {d}, ' ', {src}, ' ', {act}, ' ', {bytes}, ' GET http://h', {d}, '/', {n}, ' ', {user}, ' DIRECT/', {dst}, ' text/html')"),
    "generic.cef": (6, "concat('<134>', {bsd}, ' waf-', {d}, ' CEF:0|Acme|Wall|1|', {d}, '|Found|5|src=', {src}, ' spt=', {sport}, ' dst=', {dst}, ' dpt=', {dport}, ' act=', {act}, ' msg=Words of ', {user})"),
    "generic.leef": (4, "concat('<134>', {bsd}, ' q-', {d}, ' LEEF:2.0|Acme|Wall|1|', {d}, '|src=', {src}, '\\tsrcPort=', {sport}, '\\tdst=', {dst}, '\\tdstPort=', {dport}, '\\taction=', {act})"),
    "pfsense.filterlog": (4, "concat('<134>', {bsd}, ' pf-', {d}, ' filterlog[9]: 5,,,1000,igb0,match,', {act}, ',in,4,0x0,,64,1,0,DF,6,tcp,', {bytes}, ',', {src}, ',', {dst}, ',', {sport}, ',', {dport})"),
    "unknown": (2, "concat('[', {iso}, '] NEWBOX/7 :: peer=', {src}, ' verdict=PERMIT octets=', {bytes}, ' who=', {user})"),
}
#: The words of an allowed and of a refused event, by source.
ACTIONS = {
    "panos.traffic": ("allow", "deny"), "fortigate.traffic": ("accept", "deny"), "checkpoint.firewall": ("accept", "reject"), "suricata.alert": ("allowed", "blocked"),
    "zeek.conn": ("SF", "REJ"), "cisco.asa": ("Built", "Denied"), "squid.access": ("TCP_MISS/200", "TCP_DENIED/403"), "generic.cef": ("allow", "deny"),
    "generic.leef": ("accept", "deny"), "pfsense.filterlog": ("pass", "block"), "unknown": ("", ""),
}
START = 1_780_000_000


def corpus(spark: SparkSession, count: int, seed: int = 1, messy: bool = True) -> DataFrame:
    """n, payload, source, truth (map of src_ip, src_port, dst_ip, dst_port, disposition_id as the source tells them), sound.

    With messy one line in 211 holds bytes that are no UTF-8, and one in 331 is cut in its middle; `sound` is false for
    both and for lines of unknown layout, which no grammar is to claim."""
    drawn = lambda k, most: f"pmod(xxhash64(id, {seed}, {k}), {most})"
    at = f"timestamp_seconds({START} + id)"
    values = {
        "n": "id", "t": f"({START} + id)", "d": drawn(1, 90), "src": f"concat('10.', {drawn(2, 4)}, '.', {drawn(3, 250)}, '.', 1 + {drawn(4, 250)})",
        "dst": f"concat('198.51.100.', 1 + {drawn(5, 250)})", "sport": f"(1024 + {drawn(6, 60000)})", "dport": f"element_at(array(22, 53, 80, 443, 8443), cast(1 + {drawn(7, 5)} AS int))",
        "bytes": f"(2000 + {drawn(8, 900000)})", "out": f"(100 + {drawn(9, 1900)})", "user": f"concat('u', {drawn(10, 40)})",
        "app": f"element_at(array('ssl', 'dns', 'ssh'), cast(1 + {drawn(11, 3)} AS int))", "iso": f"date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss\")",
        "day": f"date_format({at}, 'yyyy-MM-dd')", "slashed": f"date_format({at}, 'yyyy/MM/dd HH:mm:ss')", "bsd": f"date_format({at}, 'MMM dd HH:mm:ss')",
    }
    good = f"({drawn(12, 10)} < 7)"
    line = source = disposition = None
    below = 0
    for name, (share, template) in SOURCES.items():
        below += share
        test = F.col("pick") < below
        act = f"if({good}, '{ACTIONS[name][0]}', '{ACTIONS[name][1]}')"
        text = F.expr(template.format(**values, act=act))
        line = F.when(test, text) if line is None else line.when(test, text)
        source = F.when(test, name) if source is None else source.when(test, name)
    rows = spark.range(count).withColumn("pick", F.expr(drawn(13, 100))).withColumns({"line": line, "source": source})
    told = {
        "src_ip": F.expr(values["src"]), "src_port": F.when(F.col("source") != "squid.access", F.expr(values["sport"]).cast("string")),
        "dst_ip": F.when(F.col("source") != "squid.access", F.expr(values["dst"])), "dst_port": F.when(F.col("source") != "squid.access", F.expr(values["dport"]).cast("string")),
        "disposition_id": F.when(F.expr(good), "1").otherwise("2"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in told.items()]), lambda e: e["v"].isNotNull())
    wrong, cut = F.lit(messy) & (F.col("id") % 211 == 210), F.lit(messy) & (F.col("id") % 331 == 330)
    data = F.col("line").cast("binary")
    payload = F.when(cut, F.substring(data, 1, F.floor(F.octet_length(data) / 2).cast("int"))).when(wrong, F.concat(data, F.lit(b" \xff\xfe\x81"))).otherwise(data)
    unknown = F.col("source") == "unknown"
    return rows.select(
        F.col("id").alias("n"), payload.alias("payload"), "source", F.when(unknown, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(entries)).alias("truth"),
        (~cut & ~wrong & ~unknown).alias("sound"),
    )
