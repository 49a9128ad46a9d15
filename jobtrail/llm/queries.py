"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobtrail.llm.bpe_codec import bpe_codec
from jobtrail.llm.byte_bpe import byte_bpe
from jobtrail.llm.common import table
from jobtrail.llm.conversation_repair import damaged, repair
from jobtrail.llm.decontaminate import decontaminate
from jobtrail.llm.filter_audit import filter_audit
from jobtrail.llm.fingerprints import fingerprints
from jobtrail.llm.html_extract import main_text
from jobtrail.llm.near_dedup import near_dedup
from jobtrail.llm.quality import quality
from jobtrail.llm.sharding import shard
from jobtrail.llm.token_counts import token_counts
from jobtrail.llm.token_output import token_output
from jobtrail.llm.toxicity import toxicity


#: Runs over all words of all documents.
DECONTAMINATE_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), win as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') t
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from item where len(w) > 0)
), sizes as (select distinct n from win
), hit as (
  select p.doc_id, p.i, p.n, win.item_id
  from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') t
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from doc, sizes where len(w) >= n)) p
  join win on win.t = p.t and win.n = p.n
), covered as (
  select doc_id, count(distinct k)::bigint n_hit from (select doc_id, unnest(range(i, i + n)) k from hit) group by doc_id
), named as (
  select doc_id, count(*)::bigint n_items, string_agg(item, ',' order by item) items
  from (select distinct doc_id, item_id::varchar item from hit) group by doc_id
)
select doc.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join covered using (doc_id) left join named using (doc_id)
"""

#: Signatures of failed filters are counted per part, then every order goes over them.
FILTER_AUDIT_SQL = r"""
with recursive label as (
  select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels where doc_id is not null group by doc_id
), doc as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), judged as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int fails
  from doc left join label using (doc_id)
), signature as (
  select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from judged group by part, fails
), paths(filter_order, used) as (
  select '', 0 union all
  select filter_order || chr((65 + k)::int), used + (1 << k)::int from paths, range(5) f(k) where used & (1 << k) = 0
), steps as (
  select filter_order, s::int step, 1 << (ascii(filter_order[s]) - 65) own,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::bigint earlier
  from paths, range(1, 6) t(s) where used = 31
), counted as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (fails & (earlier | own) = 0), 0)::bigint kept,
    coalesce(sum(n) filter (fails & own > 0 and fails & earlier = 0), 0)::bigint removed,
    coalesce(sum(n) filter (fails & own > 0 and fails & earlier > 0), 0)::bigint redundant,
    coalesce(sum(n) filter (fails = own), 0)::bigint unique_fails,
    coalesce(sum(good) filter (fails & own > 0 and fails & earlier = 0), 0)::bigint good_lost,
    coalesce(sum(toxic) filter (fails & own > 0 and fails & earlier = 0), 0)::bigint toxic_lost
  from signature, steps group by all
)
select * exclude (own), sum(removed) over (partition by part, own)::bigint shapley from counted
"""

#: The cheapest edits from each state (0 nothing so far, 1 after system, 2 after user, 3 after assistant), from the last turn back.
CONVERSATION_REPAIR_SQL = r"""
with recursive crc as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) t from range(256) r(i)
), said as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) bytes from conversations
), drawn as (
  select conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 kind from said, crc
), copied as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from drawn
), numbered as (
  select *, dense_rank() over (order by conv_id nulls first) conv, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) t from copied
), faults as (
  select *, role[1] initial, not regexp_matches(text, '[^ 	-
]') blank, row_number() over (partition by conv, role, text order by t) > 1 again, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) not in ('.', '!', '?') cut,
    lag(role[1]) over (partition by conv order by t) || role[1] pair, count(*) over (partition by conv) n
  from numbered
), turns as (
  select conv, t, n, conv_id, role, text, initial, blank or again gone, (cut and not blank and not again)::int cut from faults
), counts as (
  select conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (blank) blank, count(*) filter (again and not blank) duplicate, count(*) filter (cut and not blank and not again) truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) illegal
  from faults group by conv_id, conv
), best(conv, t, s0, s1, s2, s3) as (
  select distinct conv, n + 1, {'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''} from turns
  union all
  select conv, t, list_min([r0, {'c': 2 + e2.c, 'a': 'I' || e2.a}]), list_min([r1, {'c': 2 + e2.c, 'a': 'I' || e2.a}]), e2, e3
  from (select *, list_min([r2, {'c': 2 + r3.c, 'a': 'I' || r3.a}]) e2, list_min([r3, {'c': 2 + r2.c, 'a': 'I' || r2.a}]) e3
    from (select x.conv, x.t,
        list_min([{'c': 3 + s0.c, 'a': 'D' || s0.a}, {'c': case when gone then 99999999 when initial = 's' then cut + s1.c when initial = 'u' then cut + s2.c else 99999999 end, 'a': 'K' || case initial when 's' then s1.a else s2.a end}, {'c': case when gone then 99999999 else 2 + cut + s2.c end, 'a': 'R' || s2.a}]) r0,
        list_min([{'c': 3 + s1.c, 'a': 'D' || s1.a}, {'c': case when not gone and initial = 'u' then cut + s2.c else 99999999 end, 'a': 'K' || s2.a}, {'c': case when gone then 99999999 else 2 + cut + s2.c end, 'a': 'R' || s2.a}]) r1,
        list_min([{'c': 3 + s2.c, 'a': 'D' || s2.a}, {'c': case when not gone and initial = 'a' then cut + s3.c else 99999999 end, 'a': 'K' || s3.a}, {'c': case when gone then 99999999 else 2 + cut + s3.c end, 'a': 'R' || s3.a}]) r2,
        list_min([{'c': 3 + s3.c, 'a': 'D' || s3.a}, {'c': case when not gone and initial = 'u' then cut + s2.c else 99999999 end, 'a': 'K' || s2.a}, {'c': case when gone then 99999999 else 2 + cut + s2.c end, 'a': 'R' || s2.a}]) r3
      from best join turns x on x.conv = best.conv and x.t = best.t - 1))
), cheapest as (
  select conv, s0.c::bigint as cost, s0.a audit from best where t = 1
), letters as (
  select conv, i, audit[i] e, i - len(replace(audit[:i], 'I', ''))::bigint inserted, len(replace(audit[:i], 'D', ''))::bigint k from cheapest, unnest(range(1, len(audit) + 1)) u(i)
), placed as (
  select l.conv, l.i, l.e, l.k, x.role, case when l.e = 'I' then '' else x.text end as text, bool_or(l.k = 1 and l.e = 'K' and x.initial = 's') over (partition by l.conv) has_system
  from letters l left join turns x on x.conv = l.conv and x.t = l.i - l.inserted where l.e <> 'D'
), written as (
  select conv, string_agg(case when e = 'K' then role when (k + has_system::int) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) body from placed group by conv
)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') audit, sha256(coalesce(body, '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counts on counts.conv_id is not distinct from o.conv_id left join cheapest on cheapest.conv = counts.conv left join written on written.conv = counts.conv
"""


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), 85)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_token_counts, op3_toxicity, op4_token_output, op5_near_dedup, op6_html_extract, op7_sharding, op8_decontaminate, op9_bpe_codec, op10_quality, op11_byte_bpe, op12_filter_audit, op13_conversation_repair)
} | {"pipeline": corpus_pipeline.run}

#: Shards depend on the schedule, models on training, digests on the tokenizers library: SQL has none of these.
ORACLE_SQL: dict[str, str] = {"op8_decontaminate": DECONTAMINATE_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_conversation_repair": CONVERSATION_REPAIR_SQL}
