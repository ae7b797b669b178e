"""Input views of the registered queries: projections of the ``events`` table onto the sensor logs.

One SQL text serves both engines. ``{name}`` stands for another view or table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import pin_utc

_K = "(select *, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from {events}) e"

VIEWS: dict[str, str] = {
    "conn": f"""
select concat('C', cast(event_id as string)) as uid, ts,
 concat('10.0.', cast(cast(floor(user_id/256) as bigint) as string), '.', cast(user_id%256 as string)) as id_orig_h,
 cast(1024 + event_id%60000 as int) as id_orig_p,
 concat('192.168.', cast(k%4 as string), '.', cast((event_id*7)%254+1 as string)) as id_resp_h,
 case k%5 when 0 then 443 when 1 then 80 when 2 then 53 when 3 then 22 else 8443 end as id_resp_p,
 case event_type when 'view' then 'udp' when 'error' then 'icmp' else 'tcp' end as proto,
 case k%5 when 0 then 'ssl' when 1 then 'http' when 2 then 'dns' when 3 then 'ssh' end as service,
 case when event_id%50=0 then null else value/10.0 end as duration,
 cast(floor(value*100) as bigint) as orig_bytes,
 cast(floor(value*k) as bigint) as resp_bytes,
 event_id%9 as orig_pkts, cast(k%8 as bigint) as resp_pkts,
 case when event_id%7=0 then 0 else cast(floor(value*100) as bigint)+40*(event_id%9) end as orig_ip_bytes,
 case when event_id%13=0 then null else cast(floor(value*k) as bigint)+40*(k%8) end as resp_ip_bytes,
 'SF' as conn_state,
 case event_id%6 when 0 then 'ShADadFf' when 1 then 'S' when 2 then 'ShR' when 3 then 'ShADadtTcCF' when 4 then 'Dd' end as history,
 cast(0 as bigint) as missed_bytes
from {_K}""",
    "ssl": f"""
select concat('C', cast(event_id as string)) as uid,
 ts + (case when event_id%17=0 then 200 else event_id%5 end) * interval '1' second as ts,
 case event_id%8 when 0 then 'SSLv3' when 1 then 'TLSv10' when 2 then 'TLSv11' when 3 then '-' when 4 then 'TLSv99' when 5 then 'TLSv13' else 'TLSv12' end as version,
 case event_id%6 when 0 then 'TLS_RSA_WITH_RC4_128_MD5' when 1 then 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' when 2 then null else 'TLS_AES_128_GCM_SHA256' end as cipher,
 case event_id%7 when 0 then concat('h', cast(k as string), '.example.com') when 1 then '10.1.2.3'
  when 2 then concat(substr(md5(cast(event_id as string)),1,26), '.example.com')
  when 3 then 'a.b.c.d.e.example.com' when 4 then concat('promo', cast(k%10 as string), '.xyz')
  when 5 then concat(md5(cast(k as string)), '.', md5(cast(k+1 as string)), '.net') end as server_name,
 case when event_id%97=0 then 'b386946a5a44d1ddcc843bc75336dfce' when event_id%3=0 then null else md5(concat('client-', cast(k as string))) end as ja3,
 case when event_id%101=0 then 'e7d705a3286e19ea42f587b344ee6865' when event_id%4=0 then '-' else md5(concat('server-', cast(k%5 as string))) end as ja3s,
 event_id%2=0 as resumed, event_id%19<>0 as established
from {_K} where k%5 in (0,4) and event_id%11<>0""",
    "ssl_dup": "select * from {ssl} union all select * from {ssl} where cast(substr(uid,2) as bigint)%211=0",
    "dns": f"""
select concat('C', cast(event_id as string)) as uid, ts + (event_id%3) * interval '1' second as ts,
 concat('q', cast(k as string), '.example.com') as query, case when event_id%2=0 then 'A' else 'AAAA' end as qtype_name,
 case when event_id%10=0 then 'NXDOMAIN' else 'NOERROR' end as rcode_name
from {_K} where k%5=2""",
    "weird": """
select concat('C', cast(event_id as string)) as uid, ts, case when event_id%80=0 then 'bad_TCP_checksum' else 'data_before_established' end as name,
 cast(null as string) as addl, event_id%3=0 as notice from {events} where event_id%40=0""",
    "actions": """
select ts, concat('10.0.', cast(cast(floor(user_id/256) as bigint) as string), '.', cast(user_id%256 as string)) as ip,
 case when event_id%2=0 then 'block' else 'unblock' end as action from {events} where event_id%333=0""",
    "train_labels": """
select uid, attack, case when attack='Benign' then 0 else 1 end as label from (
 select uid, case when orig_bytes>12000 then 'DDoS' when history='S' and orig_pkts<4 then 'Reconnaissance'
  when id_resp_p=22 and orig_bytes>6000 then 'Brute Force' when proto='icmp' and resp_bytes>5000 then 'DoS' else 'Benign' end as attack from {conn}) t""",
    "scores": """
select concat('C', cast(event_id as string)) as uid, cast(event_id%11 as double)/10 as iso, cast(event_id%101 as double)/100 as rf,
 cast(event_id%21 as double)/20 as seq, cast(event_id%7 as double)/10 as stat,
 case when event_id%101>=60 then 'DDoS' else 'Benign' end as label,
 case event_id%3 when 0 then 'DoS' when 1 then 'Bot' else 'Exploits' end as alt_label from {events}""",
}

_NAME = re.compile(r"\{([a-z]\w*)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or base table) as a DataFrame, read straight from the given files."""
    if name not in VIEWS:
        return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})


def _ordered_needs(text: str, parts: dict[str, str], seen: dict[str, str]) -> None:
    for n in dict.fromkeys(_NAME.findall(text)):
        if n in parts and n not in seen:
            _ordered_needs(parts[n], parts, seen)
            seen[n] = parts[n]


def as_oracle(sql: str, parts: dict[str, str]) -> str:
    """Self-contained SQL: the query preceded by the parts it needs, as common table expressions."""
    needs: dict[str, str] = {}
    _ordered_needs(sql, parts, needs)
    plain = {n: _NAME.sub(r"\1", t) for n, t in needs.items()}
    ctes = ",\n".join(f"{n} as ({t.strip()})" for n, t in plain.items())
    body = _NAME.sub(r"\1", sql).strip()
    if not ctes:
        return body
    return f"with recursive {ctes}\n{body}" if "with recursive" not in body else body.replace("with recursive", f"with recursive {ctes},", 1)
