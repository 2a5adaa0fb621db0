"""Registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, jaccard, language, licenses, merkle, mixture, packing, phrases, quality, search, tokens, toxicity
from .common import is_held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf, "documents"))


def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf, "documents"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = toxicity.learn(docs, labels.where(~is_held_out()))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", is_held_out().alias("held_out"), "score", "predicted", "worst", "sentence")


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf, "documents"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    dictionaries = language.learn_dictionaries(docs.where(~is_held_out()))
    found = language.identify(docs, dictionaries)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_chat_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    return chat.perspectives(table(spark, sf, "conversations"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(table(spark, sf, "documents"))


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_fingerprints, op3_toxicity, op4_decontamination, op5_license_scan,
        op6_jaccard_join, op7_language_id, op8_packing, op9_chat_perspectives, op10_quality,
        op11_ranked_search, op12_mixture, op13_phrases,
    )
}

_MERKLE = """
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, length(text) as n_chars,
             coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text from d),
e as (select *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) as edited from n),
p as (select *, list_distinct(regexp_extract_all(text, $re$([^.!?]{1,24}[.!?]*|[.!?]+)$re$, 1)) as own,
             list_distinct(regexp_extract_all(edited, $re$([^.!?]{1,24}[.!?]*|[.!?]+)$re$, 1)) as other,
             list_distinct(regexp_extract_all(next_text, $re$([^.!?]{1,24}[.!?]*|[.!?]+)$re$, 1)) as following from e)
select doc_id, n_chars, sha256(edited) as edited_sha256,
       sha256(array_to_string([sha256(array_to_string([sha256(x) for x in string_split(s, chr(10))], ','))
              for s in string_split_regex(text, '\\n[ \\t]*\\n')], ';')) as fingerprint,
       sha256(array_to_string([sha256(array_to_string([sha256(x) for x in string_split(s, chr(10))], ','))
              for s in string_split_regex(edited, '\\n[ \\t]*\\n')], ';')) as edited_fingerprint,
       case when len(own) + len(other) = 0 then 1.0
            else 2.0 * len(list_intersect(own, other))::double / (len(own) + len(other)) end::double as near_edited,
       case when len(own) + len(following) = 0 then 1.0
            else 2.0 * len(list_intersect(own, following))::double / (len(own) + len(following)) end::double as near_next
from p
"""

_CHAT = """
with t as (select distinct conv_id, turn::bigint as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as content from conversations),
k as (select *, coalesce(floor(turn / 512)::bigint, 0) as part, coalesce(turn, -4611686018427387904) as place from t),
s as (select distinct conv_id, role as speaker from k where role <> 'system'),
r as (select k.conv_id, k.part, s.speaker, k.place, k.role, k.content, k.role = s.speaker as own,
             '<|im_start|>' || case when k.role = s.speaker then 'assistant' when k.role = 'system' then k.role
                                    else 'user name=' || k.role end || chr(10) as head
      from s join k on k.conv_id is not distinct from s.conv_id),
l as (select *, head || content || '<|im_end|>' || chr(10) as line from r),
o as (select *, sum(length(line)) over (partition by conv_id, speaker order by part, place, role, content rows unbounded preceding) as upto from l)
select conv_id, part, speaker, string_agg(line, '' order by place, role, content) as text,
       coalesce(string_agg((upto - length(line) + length(head))::bigint || ':' || (upto - 1)::bigint, ',' order by place, role, content) filter (own), '') as mask,
       count(*) as n_turns, sum(case when own then length(line) - length(head) - 1 else 0 end)::bigint as n_masked
from o group by conv_id, part, speaker
"""

_SEARCH = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
s as (select count(*) filter (len(terms) > 0) as nd, coalesce(sum(len(terms)), 0)::bigint as l from d),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
p as (select doc_id, row_id, n, term, count(*)::bigint as tf from (select doc_id, row_number() over () as row_id, len(terms)::bigint as n, terms from d) x, unnest(terms) u(term) group by all),
w as (select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term),
r as (select item_id, doc_id, row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::bigint as score
      from q join p using (term) join w using (term), s group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from r where score > 0) where rank <= 50
"""

_MIXTURE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select *, [3, 1, 2][(number % 3)::int + 1]::bigint as weight
      from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as number from d group by source)),
z as (select sum(source_size)::bigint as total, sum(weight)::bigint as parts from s),
-- Sources meet their limit in the order of size by weight; the level is the first at which no further one is above it.
o as (select source_size, weight, row_number() over (order by source_size::double / weight, number) as place from s),
p as (select 0 as place, 0::bigint as size, 0::bigint as weight union all
      select place, sum(source_size) over (order by place), sum(weight) over (order by place) from o),
v as (select p.place, 150 * total - 200 * p.size as share, 100 * (parts - p.weight) as parts from p, z where p.weight < parts),
l as (select share::bigint as share, parts::bigint as parts from v
      where not exists (select 1 from o where o.place > v.place and o.weight * v.share > o.source_size * 2 * v.parts) order by place limit 1),
t as (select s.*, case when weight * share > source_size * 2 * parts then (2 * source_size)::double
                       else (weight * share)::double / parts::double end as target from s, l),
m as (select ((150 * total + 1600) // 3200)::bigint as seats from z),
a as (select number, count(*) as seats from (
        select number, target, row_number() over (order by target / (2 * i + 1) desc, number, i) as place, seats
        from t, m, unnest(range(0, m.seats)) u(i)) where place <= seats and target > 0 group by number),
h as (select d.*, number, source_size, target, ('0x' || md5(concat_ws(':', 'shard', '7', doc_id::varchar))[1:8])::bigint
             % greatest(ceil(source_size / 4000000), 1)::bigint as shard from d join t on t.source is not distinct from d.source),
n as (select number, shard, sum(size)::bigint as shard_size from h group by all),
q as (select number, shard, count(*) as quota from (
        select n.number, shard, row_number() over (partition by n.number order by shard_size / (2 * i + 1) desc, shard, i) as place, seats
        from n join a on a.number = n.number, unnest(range(0, seats)) u(i) where shard_size > 0) where place <= seats group by all),
b as (select h.*, shard_size, least(coalesce(quota, 0), 2 * ceil(shard_size / 32)::bigint) as quota, ceil(shard_size / 32)::bigint as blocks,
             row_number() over w as row, coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from h join n on n.number = h.number and n.shard = h.shard left join q on q.number = h.number and q.shard = h.shard
      window w as (partition by h.number, h.shard order by doc_id nulls last, size)),
x as (select *, dense_rank() over (partition by number, shard order by md5(concat_ws(':', 'block', '7', number::varchar, shard::varchar, block::varchar)), block) as place
      from (select *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) as block from b where size > 0)),
k as (select number, shard, row, sum((least(start + size, 32 * (block + 1)) - greatest(start, 32 * block)) * (quota // blocks + (place <= quota % blocks)::int))::bigint as taken
      from x group by all)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from b left join k on k.number = b.number and k.shard = b.shard and k.row = b.row
"""

_PHRASES = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
t as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase
      from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from w, range(1, 6) s(size))),
f as (select lang, size, phrase, count(*) as f from g group by all having count(*) >= 100),
c as (select *, string_split(phrase, ' ') as ws from f where size > 1),
k as (select lang, phrase, ws, c.f as a, unnest(range(1, size)) as k from c),
s as (select k.lang, k.phrase, a, k, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
      from k join t on t.lang = k.lang
      join f x on x.lang = k.lang and x.phrase = array_to_string(ws[1:k], ' ')
      join f y on y.lang = k.lang and y.phrase = array_to_string(ws[k + 1:], ' ')),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select distinct lang, array_to_string(ws[b:b + len - 1], ' ') as phrase, f from (
        select lang, ws, f, len, unnest(range(1, size - len + 2)) as b from (select *, unnest(range(2, size)) as len from c))),
d as (select distinct m.lang, m.phrase from m join i on i.lang = m.lang and i.phrase = m.phrase where 100 * i.f >= 100 * m.a)
select lang, rank, phrase, a, l, r, n, score from (
  select m.*, row_number() over (partition by m.lang order by score desc, a desc, m.phrase) as rank
  from m left join d on d.lang = m.lang and d.phrase = m.phrase where d.phrase is null) where rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_fingerprints": _MERKLE, "op9_chat_perspectives": _CHAT, "op11_ranked_search": _SEARCH, "op12_mixture": _MIXTURE,
    "op13_phrases": _PHRASES,
}
