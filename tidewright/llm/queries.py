"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import chat, decontaminate, embeddings, fim, licenses, lm, mixing, neardup, quality, repair, tokens, toxicity, warc
from tidewright.session import load


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table's first turns hardly repeat, so neighbouring ids are taken as pairs too.
    return chat.preferences(load(spark, sf_dir, "conversations"), neighbours=True)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), size=4, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(load(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(load(spark, sf_dir, "pages")))
    return warc.resolved(read)


def op10_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(load(spark, sf_dir, "documents"), path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(load(spark, sf_dir, "documents")))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sums of logarithms in another order differ in their last digits.
    return lm.lm_scores(load(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_audit(repair.damaged(load(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality, op3_preferences, op4_near_duplicates, op5_toxicity, op6_mixing, op7_near_vectors, op8_licenses, op9_warc, op10_tokens,
        op11_fill_in_middle, op12_lm_scores, op13_conversation_repair,
    )
}

SQL: dict[str, str] = {
    "op3_preferences": r"""
with c as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
           from conversations where conv_id is not null group by conv_id),
d as (select conv_id, turns, list_filter(turns, lambda t: t.role = 'user')[1].text as request,
             coalesce(list_sum(list_transform(turns, lambda t: case when t.role = 'assistant' then length(t.text) else 0 end)), 0) as said from c),
e as (select *, row_number() over (partition by request order by said, conv_id) as k from d where request is not null),
f as (select a.conv_id as chosen_id, b.conv_id as rejected_id from e a join e b on a.request = b.request and b.k = 1 and a.k > 1
      union select case when a.said >= b.said then a.conv_id else b.conv_id end, case when a.said >= b.said then b.conv_id else a.conv_id end from d a join d b on a.conv_id % 2 = 0 and b.conv_id = a.conv_id + 1),
p as (select a.conv_id as chosen_id, b.conv_id as rejected_id, a.turns as x, b.turns as y,
             coalesce(list_min(list_filter(range(1, least(len(a.turns), len(b.turns)) + 1), lambda i: a.turns[i] <> b.turns[i])) - 1, least(len(a.turns), len(b.turns))) as n_common
      from f join d a on a.conv_id = f.chosen_id join d b on b.conv_id = f.rejected_id),
q as (select *, x[1:n_common] as common, x[n_common + 1:] as good, y[n_common + 1:] as bad from p)
select chosen_id, rejected_id, n_common,
  coalesce(list_aggregate(list_transform(common, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') as prompt,
  coalesce(list_aggregate(list_transform(good, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') as chosen,
  coalesce(list_aggregate(list_transform(bad, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') as rejected,
  flatten(list_transform(good, lambda t: [{'text': '<|im_start|>' || t.role || chr(10), 'train': false}, {'text': t.text || '<|im_end|>' || chr(10), 'train': t.role = 'assistant'}])) as chosen_pieces,
  flatten(list_transform(bad, lambda t: [{'text': '<|im_start|>' || t.role || chr(10), 'train': false}, {'text': t.text || '<|im_end|>' || chr(10), 'train': t.role = 'assistant'}])) as rejected_pieces,
  (len(good) = 0 and len(bad) = 0) as identical from q""",
    "op6_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, 13))::bigint as place from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source collate "C" nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as full_size from s),
l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(full_size) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
      from w window before as (order by full_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
m as (select *, first_value(case when level * weight <= full_size then level end ignore nulls) over (order by full_size / weight, source nulls last rows between unbounded preceding and unbounded following) as lv from l),
t as (select source, source_size, coalesce(least(full_size, lv * weight), full_size) as target from m),
o as (select d.*, source_size, target, sum(size) over (partition by d.source order by place, doc_id, size rows unbounded preceding) as sent
      from d join t on d.source is not distinct from t.source),
u as (select doc_id, place, size, (sent + source_size * k) / target as finish from o, (values (0), (1)) x(k) where size > 0),
v as (select *, sum(size) over (order by finish, place, doc_id rows unbounded preceding) as upto from u),
g as (select doc_id, sum(size) as taken from v where upto <= (select sum(source_size) * 1.5::double from t) group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from o left join g using (doc_id)""",
    "op9_warc": r"""
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
q as (select *, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes::bigint as payload_bytes, sha1(html) as payload_digest,
  case when payload_bytes >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and last <> page_id then last end as refers_to from q""",
    "op1_decontamination": r"""
with recursive b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
g as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as gram from b, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i) where len(w) > 0),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
h as (select distinct doc_id, i, n, gram from d, lateral (select unnest(range(1, len(w) + 1)) as i), (select distinct n from g) x, lateral (select array_to_string(w[i:i + n - 1], ' ') as gram) where i + n - 1 <= len(w) and gram in (select gram from g)),
c as (select doc_id, count(distinct p) as n_hit from h, lateral (select unnest(range(i, i + n)) as p) group by doc_id),
k as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h join g using (n, gram) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated from d left join c using (doc_id) left join k using (doc_id)""",
    "op4_near_duplicates": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') as g from d, lateral (select unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
f as (select x, y from e union select y, x from e),
r(doc_id, far) as (select distinct x, x from f union select r.doc_id, f.y from r join f on f.x = r.far),
m as (select doc_id, min(far) as low from r group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(low, doc_id) as component_id, coalesce(low, doc_id) = doc_id as kept from documents left join n using (doc_id) left join m using (doc_id)""",
    "op7_near_vectors": r"""
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
f as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, far) as (select distinct x, x from f union select r.vec_id, f.y from r join f on f.x = r.far),
m as (select vec_id, min(far) as low from r group by vec_id), n as (select x as vec_id, count(*) as n from f group by x)
select vec_id, coalesce(n, 0) as n_links, coalesce(low, vec_id) as component_id, coalesce(low, vec_id) = vec_id as kept from embeddings left join n using (vec_id) left join m using (vec_id)""",
    "op11_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents),
e as (select *, len(u) as n, [('0x' || substr(h, 1 + 8 * k, 8))::bigint for k in [0, 1, 2, 3]] as r from d),
f as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from e),
g as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256 from g""",
    "op12_lm_scores": r"""
with d as (select row_number() over () as row, doc_id, coalesce(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295) as c,
  list_concat(coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []), [chr(10)]) as t from documents),
e as (select row, doc_id, doc_id is not null and xor(c, 4294967295) % 7 = 2 as held_out, t from d),
p as (select row, doc_id, held_out, unnest(t) as w, unnest(list_concat([' '], t)[1:len(t)]) as h from e),
u as (select w, count(*) as c from p where not held_out group by w), b as (select h, w, count(*) as c from p where not held_out group by h, w), f as (select h, count(*) as c from p where not held_out group by h),
n as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from u),
s as (select row, doc_id, held_out, coalesce(u.c, 0) as c, (coalesce(u.c, 0) + 1)::double / (n + v + 1) as p1, coalesce(b.c, 0) as c2, coalesce(f.c, 0) as ch
  from p cross join n left join u using (w) left join b using (h, w) left join f using (h))
select doc_id, held_out, count(*) as n_tokens, count(*) filter (c > 0) as n_known, (select n from n) as train_tokens, round(sum(log10(p1)), 6) as base_score,
  round(sum(log10((c2 + 2000.0::double * p1) / (ch + 2000.0::double))), 6) as score from s group by row, doc_id, held_out""",
    "op13_conversation_repair": r"""
with recursive q as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295) % 20 as fate from conversations),
d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when fate = 3 then [1, 2] else [1] end) as copy from q where fate <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i from d),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault,
  lag(role[1]) over (partition by conv_id order by i) as prior from o),
g as (select conv_id, list({'role': role, 'text': text, 'fault': fault} order by i) as rows, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
  count(*) filter (prior is not null and prior || role[1] not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from f group by conv_id),
w(conv_id, i, s) as (select conv_id, 0, [{'c': 0, 'p': '', 'o': ''}, null, null, null] from g
  union all
  select w.conv_id, i + 1, [
    list_min(list_filter([d0, case when keep and n = 's' then null end], lambda x: x is not null)),
    list_min(list_filter([d1, case when keep and n = 's' and l0 is not null then {'c': l0.c + kc, 'p': l0.p || 'K', 'o': l0.o || 's'} end], lambda x: x is not null)),
    list_min(list_filter([d2, case when stay and lu is not null then {'c': lu.c + case when keep and n = 'u' then kc else 3 + kc end, 'p': lu.p || case when keep and n = 'u' then 'K' else 'R' end, 'o': lu.o || 'u'} end], lambda x: x is not null)),
    list_min(list_filter([d3, case when stay and l2 is not null then {'c': l2.c + case when n = 'a' then kc else 3 + kc end, 'p': l2.p || case when n = 'a' then 'K' else 'R' end, 'o': l2.o || 'a'} end], lambda x: x is not null))]
  from (select *, case when l0 is not null then {'c': l0.c + 4, 'p': l0.p || 'D', 'o': l0.o} end as d0, case when l1 is not null then {'c': l1.c + 4, 'p': l1.p || 'D', 'o': l1.o} end as d1,
      case when l2 is not null then {'c': l2.c + 4, 'p': l2.p || 'D', 'o': l2.o} end as d2, case when l3 is not null then {'c': l3.c + 4, 'p': l3.p || 'D', 'o': l3.o} end as d3,
      list_min(list_filter([l0, l1, l3], lambda x: x is not null)) as lu
    from (select *, list_min(list_filter([s[4], case when l2 is not null then {'c': l2.c + 3, 'p': l2.p || 'I', 'o': l2.o || 'a'} end], lambda x: x is not null)) as l3
      from (select w.conv_id, w.i, s, s[1] as l0, s[2] as l1, g.rows[w.i + 1].role[1] as n, g.rows[w.i + 1].fault in ('', 't') as stay, g.rows[w.i + 1].fault in ('', 't') as keep, case when g.rows[w.i + 1].fault = 't' then 3 else 0 end as kc,
          list_min(list_filter([s[3], case when s[1] is not null then {'c': s[1].c + 3, 'p': s[1].p || 'I', 'o': s[1].o || 'u'} end, case when s[2] is not null then {'c': s[2].c + 3, 'p': s[2].p || 'I', 'o': s[2].o || 'u'} end,
            case when s[4] is not null then {'c': s[4].c + 3, 'p': s[4].p || 'I', 'o': s[4].o || 'u'} end], lambda x: x is not null)) as l2
        from w join g on w.conv_id is not distinct from g.conv_id where w.i < len(g.rows)) x) y) w),
e as (select g.*, list_min(list_filter([s[1], s[4], case when l2 is not null then {'c': l2.c + 3, 'p': l2.p || 'I', 'o': l2.o || 'a'} end], lambda x: x is not null)) as best
  from (select w.conv_id, w.i, s, list_min(list_filter([s[3], case when s[2] is not null then {'c': s[2].c + 3, 'p': s[2].p || 'I', 'o': s[2].o || 'u'} end], lambda x: x is not null)) as l2 from w) v
  join g on v.conv_id is not distinct from g.conv_id and v.i = len(g.rows)),
p as (select conv_id, rows, best, unnest(range(1, len(best.p) + 1)) as j from e),
t as (select conv_id, j, best.p[j] as edit, best.o[(len(replace(best.p[1:j], 'D', '')))::int] as given, rows[len(replace(best.p[1:j], 'I', ''))] as row from p),
r as (select conv_id, string_agg(case edit when 'K' then row.role || ':' || row.text when 'R' then case given when 'u' then 'user' else 'assistant' end || ':' || row.text else case given when 'u' then 'user' else 'assistant' end || ':' end, chr(10) order by j) as said
  from t where edit <> 'D' group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.p, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join e on a.conv_id is not distinct from e.conv_id left join r on a.conv_id is not distinct from r.conv_id""",
}
