"""Registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm.archive import archived
from weftline.llm.common import table
from weftline.llm.conversation_repair import conversation_repair
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.hard_negatives import hard_negatives
from weftline.llm.hilbert import hilbert_shards
from weftline.llm.line_dedup import line_dedup
from weftline.llm.ngram_join import ngram_join
from weftline.llm.packing import best_fit_packing
from weftline.llm.pieces_codec import piece_digests
from weftline.llm.quality_rules import quality_rules
from weftline.llm.substring_dedup import substring_dedup
from weftline.llm.token_counts import token_counts
from weftline.llm.token_files import token_digests


def op1_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links", "n_shingles")


def op2_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hilbert_shards(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


def op4_content_archive(spark, sf_dir):
    found = archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("payload", 256).alias("payload_sha256"), F.md5("record").alias("record_md5"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_pieces_codec(spark, sf_dir):
    return piece_digests(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.md5(F.array_join("kept", ",").cast("binary")).alias("kept_md5"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair(table(spark, sf_dir, "conversations")).drop("n_blocks")


def op12_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_quality_rules, op3_hilbert_shards, op4_content_archive, op5_exact_dedup, op6_pieces_codec, op7_token_files, op8_best_fit_packing, op9_line_dedup, op10_substring_dedup, op11_conversation_repair, op12_token_counts, op13_hard_negatives)}

ORACLES = {
    "op1_ngram_join": r"""
        with recursive
        w as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as words from documents),
        s as (select doc_id, list_sort(list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
                else [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] end)) as grams from w),
        c as (select doc_id, grams, len(grams) as n, min(doc_id) over g as class_id, count(*) over g as size from s window g as (partition by grams)),
        k as (select class_id as id, grams, n, size from c where doc_id = class_id and n > 0),
        e as (select id, n, size, unnest(grams) as gram from k),
        p as (select a.id as x, b.id as y, b.size as ysize, count(*) as shared, any_value(a.n) as xn, any_value(b.n) as yn from e a join e b on a.gram = b.gram and a.id <> b.id
              group by all),
        l as (select x, y, ysize from p where shared >= 0.8 * (xn + yn - shared) - 1e-9),
        r as (select id as node, id as reached from k union select r.node, l.y from r join l on r.reached = l.x),
        g as (select node, min(reached) as group_id from r group by node),
        t as (select x, sum(ysize) as links from l group by x)
        select doc_id, case when n = 0 then doc_id else class_id end as class_id, coalesce(group_id, doc_id) as group_id,
               (case when n = 0 then 0 else size - 1 + coalesce(links, 0) end)::bigint as n_links, n::bigint as n_shingles
        from c left join g on c.class_id = g.node and n > 0 left join t on c.class_id = t.x and n > 0""",
    "op4_content_archive": r"""
        with p as (select page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', '', 'g') as url, coalesce(html, '') as html, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, url, html, body, octet_length(body) as n, sha1(body) as h, max(page_id) over (partition by body) as response from p),
        e as (select *, page_id <> response as again, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1, 1)
                                for i in range(32)], '') as sha1, chr(13) || chr(10) as z from d),
        u as (select *, '<urn:uuid:' || regexp_replace(md5(page_id::varchar), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '>' as own,
                     '<urn:uuid:' || regexp_replace(md5(response::varchar), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '>' as other from e)
        select page_id, n::bigint as payload_bytes, sha1 as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then response end as refers_to,
               sha256(body) as payload_sha256,
               md5('WARC/1.1' || z || 'WARC-Type: ' || case when again then 'revisit' else 'response' end || z || 'WARC-Record-ID: ' || own || z || 'WARC-Date: 2024-01-01T00:00:00Z' || z || 'WARC-Target-URI: ' || url || z
                   || 'WARC-Payload-Digest: sha1:' || sha1 || z
                   || case when again then 'WARC-Refers-To: ' || other || z || 'WARC-Refers-To-Page: ' || response || z || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || z else '' end
                   || 'WARC-Page-ID: ' || page_id || z || 'Content-Type: text/html; charset=utf-8' || z || 'Content-Length: ' || n || z || z || case when again then '' else html end || z || z) as record_md5
        from u""",
    "op5_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(body) as text_sha256
        from d window w as (partition by body)""",
    "op9_line_dedup": r"""
        with l as (select doc_id, i - 1 as line, [x for x in regexp_split_to_array(parts[i], '[\x20\x09-\x0D]+') if x <> ''] as words
                   from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) as t(i)),
        w as (select *, len(words) as n from l where len(words) > 0),
        f as (select *, row_number() over (partition by words order by doc_id, line) as copy from w),
        d as (select doc_id, line, words, n, row_number() over (order by doc_id, line) as place from f where copy = 1),
        p as (select x.place, x.words as a, y.words as b, x.n as an, y.n as bn from d x join d y
              on y.place < x.place and x.n >= 8 and y.n >= 8 and x.n = y.n and (x.words[1] = y.words[1] or x.words[x.n] = y.words[y.n])
              union all
              select case when x.place > y.place then x.place else y.place end, x.words, y.words, x.n, y.n from d x join d y
              on x.n = y.n + 1 and y.n >= 8 and (x.words[1] = y.words[1] or x.words[x.n] = y.words[y.n])),
        late as (select distinct place from p where case when an = bn then len([i for i in range(1, an + 1) if a[i] <> b[i]]) = 1
                 else len([i for i in range(1, an + 1) if list_concat(a[1:i - 1], a[i + 1:an]) = b]) > 0 end),
        k as (select doc_id, count(*) as n_kept, string_agg(line::varchar, ',' order by line) as kept from d where place not in (select place from late) group by doc_id),
        c as (select doc_id, count(*) as n_lines from w group by doc_id)
        select t.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_kept, 0) as n_kept, md5(coalesce(kept, '')) as kept_md5
        from documents t left join c on t.doc_id = c.doc_id left join k on t.doc_id = k.doc_id""",
    "op10_substring_dedup": r"""
        with w as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as words from documents),
        p as (select doc_id, q, md5(array_to_string(words[q:q + 34], ' ')) as run from w, unnest(range(1, len(words) - 33)) as t(q)),
        r as (select doc_id, q, count(*) over (partition by run) as n from p),
        g as (select distinct doc_id, q + d as place from r, unnest(range(35)) as t(d) where n > 1),
        gone as (select doc_id, list(place) as places, count(*) as n from g group by doc_id),
        k as (select w.doc_id, words, coalesce(n, 0) as n, [words[i] for i in range(1, len(words) + 1) if not list_contains(coalesce(places, []), i)] as kept
              from w left join gone on w.doc_id = gone.doc_id)
        select doc_id, len(words)::bigint as n_words, n::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k""",
    "op11_conversation_repair": r"""
        with recursive
        crc as (select [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for i in range(256)] as t),
        o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                     xor(list_reduce(list_concat([4294967295::bigint], [ord(x)::bigint for x in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as hit from conversations, crc),
        d as (select conv_id, turn, case when hit = 4 then 'user' else role end as role,
                     case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
              from o, unnest(case when hit = 3 then [1, 2] else [1] end) where hit <> 0),
        n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from d),
        f as (select *, i > min(i) over (partition by conv_id, role, text) as again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
                     lag(role) over (partition by conv_id order by i) as before from n),
        g as (select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from f),
        ins(p, q, n) as (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
        writes(role, p, q) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
        edits as (select 'D' as e, p, p as q, 4 as cost, null::varchar as role from range(4) t(p)
                  union all select 'R', p, q, 3, null::varchar from writes where role <> 's' union all select 'K', p, q, 0, role from writes),
        steps as (select ins.p, edits.q, ins.n * 3 + edits.cost as cost, repeat('I', ins.n) || e as letters, e, role from ins join edits on ins.q = edits.p),
        walk as (select conv_id, 0::bigint as i, 0 as q, {'cost': 0, 'audit': ''} as best from (select distinct conv_id from g)
                 union all
                 select w.conv_id, w.i + 1, s.q, min({'cost': w.best.cost + s.cost + case when s.e <> 'D' and g.fault = 'truncated' then 3 else 0 end, 'audit': w.best.audit || s.letters})
                 from walk w join g on g.conv_id is not distinct from w.conv_id and g.i = w.i + 1 join steps s on s.p = w.q
                 where s.e = 'D' or g.fault not in ('blank', 'duplicate') and (s.role is null or s.role = left(g.role, 1))
                 group by w.conv_id, w.i, s.q),
        ends as (select conv_id, min({'cost': w.best.cost + n * 3, 'audit': w.best.audit || repeat('I', n)}) as best
                 from walk w join ins on ins.p = w.q and ins.q in (0, 3) where i = (select max(i) from g where g.conv_id is not distinct from w.conv_id) group by conv_id),
        counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
                          count_if(fault = 'truncated') as truncated, count_if(i > 1 and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal from g group by conv_id),
        edit as (select conv_id, u as spot, substr(best.audit, u::int, 1) as e from ends, unnest(range(1, length(best.audit) + 1)) as t(u)),
        place as (select *, count_if(e <> 'I') over (partition by conv_id order by spot) as i, count_if(e <> 'D') over (partition by conv_id order by spot) as w from edit),
        rows_ as (select p.conv_id, p.spot, p.w, p.e, g.role, case when p.e = 'I' then '' else g.text end as text,
                         bool_or(p.w = 1 and p.e = 'K' and left(g.role, 1) = 's') over (partition by p.conv_id) as led
                  from place p left join g on g.conv_id is not distinct from p.conv_id and g.i = p.i and p.e <> 'I' where p.e <> 'D'),
        told as (select conv_id, string_agg(case when e = 'K' then role when (w - case when coalesce(led, false) then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by spot) as body from rows_ group by conv_id)
        select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
               coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
        from (select distinct conv_id from conversations) c left join counts on counts.conv_id is not distinct from c.conv_id
        left join ends on ends.conv_id is not distinct from c.conv_id left join told on told.conv_id is not distinct from c.conv_id""",
    "op13_hard_negatives": """
        with q as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
        p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
        n as (select p.a, p.b as p, p.score as ps, s.b as n, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
              from p join s on p.a = s.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
        select a as anchor_id, p as positive_id, rank::int as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 3""",
}
