"""The queries of this package: name -> (query, checking SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.alignment import align_tokens
from tidewatch.llm.embeddings import cosine_links
from tidewatch.llm.fingerprint import edited_next
from tidewatch.llm.language import judged, train
from tidewatch.llm.licenses import scan
from tidewatch.llm.mixing import assigned
from tidewatch.llm.neardup import jaccard_join
from tidewatch.llm.packing import pack
from tidewatch.llm.scoring import score_texts, tenth_held_out
from tidewatch.llm.tokenfiles import digests, write_token_ids
from tidewatch.llm.urls import filter_urls
from tidewatch.llm.variants import spelling_variants
from tidewatch.llm.warc import archived
from tidewatch.session import pin_utc
from tidewatch.sources.storage import scratch_path

Build = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(common.documents(spark, sf_dir)).drop("passes")


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as turn
  from documents
), s as (
  select source, row_number() over (order by source nulls last) - 1 as place, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [3, 1, 2][place % 3 + 1] as weight, 2.0::double * source_size as cap from s
), l as (
  select *, (1.5::double * sum(source_size) over ()
      - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level
  from w
), t as (
  select source, place, source_size, coalesce(least(cap, weight * (select arg_min(level, (cap / weight, place)) from l where cap / weight > level)), cap) as target
  from l
), p as (
  select d.doc_id, d.size, t.source_size, t.target, t.place, round(t.target)::bigint as stop,
    coalesce(sum(d.size) over (partition by d.source order by d.turn, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as beg
  from d join t on d.source is not distinct from t.source
), u as (
  select *, greatest(0, least(size, stop - beg))::bigint as one, greatest(0, least(size, stop - beg - source_size))::bigint as two,
    case when target > 0 then beg / target else 1.0::double end as u
  from p
)
select doc_id, size, source_size, target, one + two as taken,
  case when one > 0 then case place % 3
    when 0 then case when u * 1.125::double < 0.75 then 2 * (u * 1.125::double) / (2 + sqrt(4 + 2 * -2.0::double * (u * 1.125::double)))
      else 0.5::double + 2 * (u * 1.125::double - 0.75::double) / (1 + sqrt(1 + 2 * -1.0::double * (u * 1.125::double - 0.75::double))) end
    when 1 then case when u * 1.125::double < 0.375 then 2 * (u * 1.125::double) / (0.5::double + sqrt(0.25::double + 2 * 1.0::double * (u * 1.125::double)))
      else 0.5::double + 2 * (u * 1.125::double - 0.375::double) / (1 + sqrt(1 + 2 * 2.0::double * (u * 1.125::double - 0.375::double))) end
    else 2 * u / (1 + sqrt(1::double)) end end as first_due
from u
"""


def op2_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.documents(spark, sf_dir), tenth_held_out())


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(common.table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), u as (
  select vec_id, label, e from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(e, lambda x: x * x)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), c(id, low) as (
  select vec_id, vec_id from v
  union
  select l.a, c.low from c join l on l.b = c.id where c.low < l.a
)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, m.low as component_id, v.vec_id = m.low as kept
from v join (select id, min(low) as low from c group by id) m on m.id = v.vec_id
  left join (select a, count(*) as n from l group by a) n on n.a = v.vec_id
"""


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_next(common.documents(spark, sf_dir))


OP4_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents
), x as (
  select *, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc rows between unbounded preceding and unbounded following)) as after,
    coalesce(lead(doc_id) over (order by doc_id desc), first_value(doc_id) over (order by doc_id desc rows between unbounded preceding and unbounded following)) as next_id
  from d
), e as (
  select doc_id, next_id, n, text, substr(text, 1, n - n // 2) || substr(after, 1, n // 2) as edited from x
), v as (
  select doc_id, 0 as version, text from e union all select doc_id, 1, edited from e
), p as (
  select doc_id, version, md5(unnest(string_split(replace(replace(replace(text, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10)))) as h from v
), w as (
  select doc_id, version, [('0x' || substr(h, 1, 8))::bigint, ('0x' || substr(h, 9, 8))::bigint, ('0x' || substr(h, 17, 8))::bigint, ('0x' || substr(h, 25, 8))::bigint] as w from p
), sums as (
  select doc_id, version, count(*) as n, [sum(w[1]) % 4294967296, sum(w[2]) % 4294967296, sum(w[3]) % 4294967296, sum(w[4]) % 4294967296] as e from w group by all
), lanes as (
  -- lane 2 * i + j of word pair k is bit i of word 2 * k + j
  select doc_id, version, 64 * k + 2 * i + j as lane, sum((w[2 * k + j + 1] >> i) & 1)::bigint as c
  from w, (select unnest(range(2)) as k), (select unnest(range(32)) as i), (select unnest(range(2)) as j) group by all
), f as (
  select s.doc_id, s.version, any_value(s.n) as n,
    lpad(printf('%x', any_value(s.n)::bigint), 8, '0')
      || any_value(lpad(printf('%x', e[1]::bigint), 8, '0') || lpad(printf('%x', e[2]::bigint), 8, '0') || lpad(printf('%x', e[3]::bigint), 8, '0') || lpad(printf('%x', e[4]::bigint), 8, '0'))
      || string_agg(lpad(printf('%x', c % 65536), 4, '0'), '' order by lane) as fp,
    list(2 * c - s.n order by lane) as signs
  from sums s join lanes l on s.doc_id = l.doc_id and s.version = l.version group by s.doc_id, s.version
), a as (
  select e.doc_id, e.n, e.edited, o.fp as fp, t.fp as efp, o.signs as s0, t.signs as s1, z.signs as s2
  from e join f o on o.doc_id = e.doc_id and o.version = 0 join f t on t.doc_id = e.doc_id and t.version = 1
    join f z on z.doc_id = e.next_id and z.version = 0
)
select doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256, fp as fingerprint, efp as edited_fingerprint,
  case when s0 = s1 then 1.0::double else greatest(0.0::double, least(1.0::double, 2.0::double * list_dot_product(s0::double[], s1::double[])
    / (list_dot_product(s0::double[], s0::double[]) + list_dot_product(s1::double[], s1::double[])))) end as near_edited,
  case when s0 = s2 then 1.0::double else greatest(0.0::double, least(1.0::double, 2.0::double * list_dot_product(s0::double[], s2::double[])
    / (list_dot_product(s0::double[], s0::double[]) + list_dot_product(s2::double[], s2::double[])))) end as near_next
from a
"""


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), tokenizer(), with_ids=False)


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("paragraph_text")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"), URL_RULES)


def op8_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(common.table(spark, sf_dir, "pages"))


OP8_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as bytes, sha1(coalesce(html, '')) as digest from pages
), k as (
  select digest, bytes, max(page_id) as keeper from p where bytes >= 1000 group by all having count(*) > 1
)
select p.page_id, p.bytes::bigint as payload_bytes, p.digest as payload_digest,
  case when keeper is null or keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from p left join k on k.digest = p.digest and k.bytes = p.bytes
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, third = common.documents(spark, sf_dir), common.remainder(F.col("doc_id"), 3)
    model = train(docs, third != 1)
    return judged(docs, model).select("doc_id", (third == 1).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.documents(spark, sf_dir))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_token_ids(common.documents(spark, sf_dir), path, tokenizer())
    return digests(spark, path)


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.documents(spark, sf_dir))


_ALL: list[tuple[Build, str | None]] = [
    (op1_mix_sources, OP1_SQL),
    (op2_maxent_scores, None),
    (op3_embedding_near_dedup, OP3_SQL),
    (op4_multiset_fingerprints, OP4_SQL),
    (op5_pack_sequences, None),
    (op6_license_scan, None),
    (op7_url_filter, None),
    (op8_warc_captures, OP8_SQL),
    (op9_language_id, None),
    (op10_ngram_jaccard_join, None),
    (op11_token_files, None),
    (op12_align_tokenizers, None),
    (op13_spelling_variants, None),
]


def llm_queries() -> dict[str, tuple[Build, str | None]]:
    def pinned(build: Build) -> Build:
        return lambda spark, sf_dir: build(common.small_batches(pin_utc(spark)), sf_dir)

    return {build.__name__: (pinned(build), sql) for build, sql in _ALL}
