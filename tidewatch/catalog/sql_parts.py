"""The checking side: what the operators must compute, written independently as DuckDB SQL parts."""

from __future__ import annotations

from tidewatch.catalog.views import VIEWS
from tidewatch.functions.fixed_values import (
    BLOCKLIST_DEFAULT_FAMILY,
    CURATED_THREATS,
    FEATURE_NAMES,
    JA3_BLOCKLIST,
    NO_TLS_FINGERPRINT,
    NO_TLS_THREAT,
    SUSPICIOUS_TLDS,
    TLS_VERSION_SCORES,
    WEAK_CIPHERS,
)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_curated = [tuple(line.split("|")) for line in CURATED_THREATS.strip().splitlines()]
_blocked = [
    (h, fam or BLOCKLIST_DEFAULT_FAMILY) for h, _, fam in (ln.partition(" ") for ln in JA3_BLOCKLIST.strip().splitlines())
]

_versions = " ".join(f"when '{k}' then cast({v} as double)" for k, v in TLS_VERSION_SCORES.items())
_weak = " ".join(f"when contains(upper(tls_cipher), '{w.upper()}') then '{w}'" for w in WEAK_CIPHERS)
_tlds = " or ".join(f"ends_with(tls_server_name, '{t}')" for t in SUSPICIOUS_TLDS)
_octet = r"\+?0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _flag(cls: str) -> str:
    letters = {"F": "F", "S": "S", "R": "R", "PD": "PD", "A": "A", "U": "U"}
    bits = {"F": 1, "S": 2, "R": 4, "PD": 8, "A": 16, "U": 32}
    terms = []
    for k in letters:
        span = {"both": k + k.lower(), "client": k, "server": k.lower()}[cls]
        terms.append(f"case when regexp_matches(h, '[{span}]') then {bits[k]} else 0 end")
    return "(" + "+".join(terms) + ")"


_feature_sql = {
    "PROTOCOL": "case lower(proto) when 'icmp' then 1 when 'tcp' then 6 when 'udp' then 17 else 0 end",
    "L7_PROTO": "case lower(service) when 'http' then 7 when 'ssl' then 91 when 'tls' then 91 when 'dns' then 5 when 'ssh' then 22 when 'ftp' then 1 else 0 end",
    "IN_BYTES": "ib", "IN_PKTS": "ip", "OUT_BYTES": "ob", "OUT_PKTS": "op",
    "TCP_FLAGS": _flag("both"), "CLIENT_TCP_FLAGS": _flag("client"), "SERVER_TCP_FLAGS": _flag("server"),
    "FLOW_DURATION_MILLISECONDS": "d*1000",
    "DURATION_IN": "case when ip>0 then d*1000/2 else 0 end",
    "DURATION_OUT": "case when op>0 then d*1000/2 else 0 end",
    "MIN_TTL": "case when ip>0 then 64 else 0 end", "MAX_TTL": "case when ip>0 then 64 else 0 end",
    "LONGEST_FLOW_PKT": "1.5e0*greatest(ai,ao)", "SHORTEST_FLOW_PKT": "case when ip>0 then 40 else 0 end",
    "MIN_IP_PKT_LEN": "case when ip>0 then 40 else 0 end", "MAX_IP_PKT_LEN": "1.5e0*greatest(ai,ao)",
    "SRC_TO_DST_SECOND_BYTES": "ib/sd", "DST_TO_SRC_SECOND_BYTES": "ob/sd",
    "RETRANSMITTED_IN_PKTS": "length(regexp_replace(h,'[^cCtT]','','g'))",
    "RETRANSMITTED_OUT_PKTS": "length(regexp_replace(h,'[^cCtT]','','g'))",
    "SRC_TO_DST_AVG_THROUGHPUT": "ib*8/sd", "DST_TO_SRC_AVG_THROUGHPUT": "ob*8/sd",
    "NUM_PKTS_UP_TO_128_BYTES": "case when ai<128 then ip+op else 0 end",
    "NUM_PKTS_128_TO_256_BYTES": "case when ai>=128 and ai<256 then ip+op else 0 end",
    "NUM_PKTS_256_TO_512_BYTES": "case when ai>=256 and ai<512 then ip+op else 0 end",
    "NUM_PKTS_512_TO_1024_BYTES": "case when ai>=512 and ai<1024 then ip+op else 0 end",
    "NUM_PKTS_1024_TO_1514_BYTES": "case when ai>=1024 then ip+op else 0 end",
}

_features = ",\n".join(f"cast({_feature_sql.get(n, '0')} as double) as {n}" for n in FEATURE_NAMES)

_ALPHA, _Q = "cast(0.05 as double)", "cast(0.95 as double)"
_unpivot = " union all ".join(f"select rn, '{n}' as feature, {n} as x from ewma_rows" for n in FEATURE_NAMES)


PARTS: dict[str, str] = {
    **VIEWS,
    "curated": f"select * from (values {_values(_curated)}) t(ja3, malware, severity, description)",
    "blocklist": f"select * from (values {_values(_blocked)}) t(ja3, malware)",
    "threat_db": """
select ja3, malware, severity, description from (
 select *, row_number() over (partition by ja3 order by prio) as rn from (
  select 0 as prio, ja3, malware, severity, description from {curated}
  union all select 1, ja3, malware, 'critical', 'Matched abuse.ch SSLBL — ' || malware from {blocklist}) u) r
where rn = 1""",
    "flows": """
select c.*, s.ts as ssl_ts, s.version as ssl_version, s.cipher as ssl_cipher, s.server_name as ssl_server_name,
 s.ja3 as ssl_ja3, s.ja3s as ssl_ja3s, s.resumed as ssl_resumed, s.established as ssl_established
from {conn} c left join {ssl} s on c.uid = s.uid""",
    "measured": """
select *, coalesce(history,'') as h,
 case when ip>0 then ib/ip else 0 end as ai, case when op>0 then ob/op else 0 end as ao, greatest(d, cast(0.001 as double)) as sd
from (select *, cast(coalesce(nullif(orig_ip_bytes,0), orig_bytes, 0) as double) as ib,
 cast(coalesce(nullif(resp_ip_bytes,0), resp_bytes, 0) as double) as ob,
 cast(coalesce(orig_pkts,0) as double) as ip, cast(coalesce(resp_pkts,0) as double) as op,
 coalesce(duration, cast(0 as double)) as d from {conn}) c""",
    "features": f"select uid, ts, {_features} from {{measured}}",
    "netflow": """
select f.*, l.attack as Attack, l.label as Label from {features} f join {train_labels} l on f.uid = l.uid""",
    "fields": """
select *, case when ssl_ja3 not in ('','-') then ssl_ja3 end as raw_ja3,
 case when ssl_ja3s not in ('','-') then ssl_ja3s end as ja3s,
 case when ssl_version not in ('','-') then ssl_version end as tls_version,
 case when ssl_cipher not in ('','-') then ssl_cipher end as tls_cipher,
 case when ssl_server_name not in ('','-') then ssl_server_name end as tls_server_name
from {flows}""",
    "printed": f"""
select *, coalesce(raw_ja3, meta, '{NO_TLS_FINGERPRINT}') as ja3, raw_ja3 is null and meta is not null as is_pseudohash,
 coalesce(raw_ja3, meta) is not null as has_tls
from (select *, case when tls_version is not null or tls_cipher is not null then
 md5(coalesce(tls_version,'unknown') || ',' || coalesce(tls_cipher,'unknown') || ',' || coalesce(tls_server_name,'unknown')) end as meta
 from {{fields}}) m""",
    "labels_of_names": "select distinct split_part(tls_server_name, '.', 1) as lab from {fields} where tls_server_name is not null",
    "entropies": """
select lab, 0 - sum(n/len * log2(n/len)) as ent from (
 select lab, ch, cast(count(*) as double) as n, cast(length(lab) as double) as len
 from (select lab, unnest(string_split(lower(lab), '')) as ch from {labels_of_names} where lab <> '') c group by lab, ch) g
group by lab""",
    "judged": f"""
select p.*, t.malware as ja3_malware, u.malware as ja3s_malware,
 case when tls_version is not null then case tls_version {_versions} else cast(0.3 as double) end end as version_score,
 case {_weak} end as weak_cipher,
 case when tls_server_name is not null then greatest(
  case when regexp_matches(tls_server_name, '^{_octet}(\\.{_octet}){{3}}$') then cast(0.3 as double) else 0 end,
  case when length(tls_server_name) > 50 then cast(0.35 as double) else 0 end,
  case when length(e.lab) > 20 and e.ent > 3.5 then cast(0.4 as double) else 0 end,
  case when len(string_split(tls_server_name, '.')) > 5 then cast(0.25 as double) else 0 end,
  case when {_tlds} then cast(0.2 as double) else 0 end) end as name_risk,
 row_number() over (partition by p.ja3 order by p.ts, p.uid) = 1 as first_seen
from {{printed}} p left join {{threat_db}} t on p.ja3 = t.ja3 left join {{threat_db}} u on p.ja3s = u.ja3
left join {{entropies}} e on split_part(p.tls_server_name, '.', 1) = e.lab""",
    "tls": f"""
select *, ja3_malware is not null or ja3s_malware is not null as tls_malicious,
 case when ja3s_malware is not null
  then coalesce(ja3_malware, case when not has_tls then '{NO_TLS_THREAT}' end, '') || ' + ' || ja3s_malware || ' (server)'
  else coalesce(ja3_malware, case when not has_tls then '{NO_TLS_THREAT}' end) end as tls_threat,
 greatest(0,
  case when ja3_malware is not null then cast(1 as double) else 0 end,
  case when ja3s_malware is not null then cast(0.95 as double) else 0 end,
  case when version_score > cast(0.3 as double) then version_score * cast(0.7 as double) else 0 end,
  case when weak_cipher is not null then cast(0.5 as double) else 0 end,
  coalesce(name_risk, 0),
  case when first_seen and ja3_malware is null and ja3s_malware is null then cast(0.15 as double) else 0 end) as tls_risk,
 list_filter_nulls as tls_factors
from (select *, list_concat(
  case when ja3_malware is not null then ['JA3 matches known malware: ' || ja3_malware] else [] end,
  case when ja3s_malware is not null then ['JA3S server fingerprint matches: ' || ja3s_malware] else [] end,
  case when version_score > cast(0.3 as double) then ['Deprecated TLS version: ' || tls_version] else [] end,
  case when weak_cipher is not null then ['Weak cipher detected: ' || weak_cipher || ' in ' || tls_cipher] else [] end,
  case when name_risk > 0 then ['Suspicious SNI pattern: ' || tls_server_name] else [] end,
  case when first_seen and ja3_malware is null and ja3s_malware is null
   then ['First-time JA3 fingerprint observed: ' || substr(ja3,1,12) || '...'] else [] end) as list_filter_nulls from {{judged}}) j""",
    "risk": """
select *, case when risk_score >= 85 then 'critical' when risk_score >= 70 then 'high' when risk_score >= 65 then 'medium' else 'low' end as severity,
 case when label = 'Benign' and risk_score >= 65 then alt_label else label end as attack_type,
 risk_score >= 75 as should_block
from (select t.*, s.iso, s.rf, s.seq, s.stat, s.label, s.alt_label,
 cast(floor(least(100, greatest(0, (cast(0.05 as double)*iso + cast(0.55 as double)*rf + cast(0.35 as double)*seq + cast(0.05 as double)*stat)*100))) as integer) as base_score,
 case when tls_malicious then 100 else cast(least(100,
  floor(least(100, greatest(0, (cast(0.05 as double)*iso + cast(0.55 as double)*rf + cast(0.35 as double)*seq + cast(0.05 as double)*stat)*100)))
  + floor(tls_risk*30)) as integer) end as risk_score
 from {tls} t join {scores} s on t.uid = s.uid) r""",
    "traffic": """
select uid, epoch_us(ts)/1e6 as timestamp, id_orig_h || ':' || id_orig_p as src, id_resp_h || ':' || id_resp_p as dst, proto,
 cast(coalesce(nullif(orig_ip_bytes,0), orig_bytes, 0) as bigint) as bytes_in,
 cast(coalesce(nullif(resp_ip_bytes,0), resp_bytes, 0) as bigint) as bytes_out,
 coalesce(orig_pkts,0) as packets_in, coalesce(resp_pkts,0) as packets_out,
 round_even(coalesce(duration,0)*1000, 1) as duration_ms, attack_type, risk_score, severity,
 attack_type <> 'Benign' and risk_score >= 65 as is_malicious
from {risk}""",
    "blocking": """
select id_orig_h as ip, epoch_us(ts) as t, uid, risk_score as score from {risk} where should_block""",
    # closed form of the recurrences by running sums; the weights fit a double up to about 13,000 rows
    "ewma_rows": "select row_number() over (order by ts, uid) - 1 as rn, * from {features}",
    "ewma_long": _unpivot.replace("ewma_rows", "{ewma_rows}"),
    "ewma_mean": f"""
select *, pow({_Q}, rn) * sum(case when rn = 0 then x else {_ALPHA} * x * pow({_Q}, -rn) end)
 over (partition by feature order by rn rows unbounded preceding) as mean_after from {{ewma_long}}""",
    "ewma_delta": """
select *, x - lag(mean_after) over (partition by feature order by rn) as delta from {ewma_mean}""",
    "ewma_var": f"""
select *, pow({_Q}, rn + 1) * sum(case when rn = 0 then 0 else {_ALPHA} * delta * delta * pow({_Q}, -rn) end)
 over (partition by feature order by rn rows unbounded preceding) as var_after from {{ewma_delta}}""",
    "ewma_z": """
select rn, abs(delta) / sqrt(lag(var_after) over (partition by feature order by rn) + 1e-8) as z from {ewma_var}""",
    "ewma_score": """
select rn, case when rn < 30 then 0 else least(1, greatest(0,
 cast(0.6 as double) * avg(case when z > 3.5 then 1 else 0 end) + cast(0.4 as double) * least(1, greatest(0, max(z) / 10.5)))) end as score
from {ewma_z} group by rn""",
}

# the same recurrences with a baseline for each service (protocol and destination port)
_OVER = "partition by feature"
PARTS["service_rows"] = """
select row_number() over (partition by entity order by ts, uid) - 1 as rn, * from (
 select f.*, c.proto || ':' || cast(c.id_resp_p as varchar) as entity from {features} f join {conn} c on c.uid = f.uid) t"""
PARTS["service_long"] = " union all ".join(f"select rn, entity, '{n}' as feature, {n} as x from {{service_rows}}" for n in FEATURE_NAMES)
for _part, _source in (("mean", "long"), ("delta", "mean"), ("var", "delta"), ("z", "var")):
    _text = PARTS[f"ewma_{_part}"].replace(_OVER, "partition by entity, feature").replace(f"{{ewma_{_source}}}", f"{{service_{_source}}}")
    PARTS[f"service_{_part}"] = _text.replace("select rn,", "select rn, entity,")
PARTS["service_score"] = PARTS["ewma_score"].replace("{ewma_z}", "{service_z}").replace("select rn,", "select rn, entity,").replace("group by rn", "group by rn, entity")
