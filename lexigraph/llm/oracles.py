"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others rest on fitted models, library tokenizers, container bytes or hashes
that SQL hasn't; tests hold them against brute force or round trips.
"""

ORACLES: dict[str, str] = {}

_CONTROLS = "<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>|<\\|begin_of_text\\|>|<\\|end_of_text\\|>|<\\|eot_id\\|>|<\\|start_header_id\\|>|<\\|end_header_id\\|>"


def _escaped(x: str) -> str:
    """Length of a text in which backslashes are doubled and controls broken."""
    return f"(len({x}) + len(regexp_extract_all({x}, '\\\\')) + len(regexp_extract_all({x}, '{_CONTROLS}')))"


ORACLES["op1_chat_formatting"] = f"""with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(len('<|im_start|>') + {_escaped('role')} + 1 + {_escaped('text')} + len('<|im_end|>') + 1)::bigint as formatted_chars
from turns group by conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(x: str) -> str:
    return f"regexp_extract_all(translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


ORACLES["op7_benchmark_decontamination"] = f"""with item as (select item_id, {_words('text')} as w from benchmark),
windows as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as words
  from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)),
doc as (select doc_id, {_words('text')} as w from documents),
places as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as words from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, (select distinct k from windows) where len(w) >= k)),
met as (select doc_id, p.i, p.k, item_id from places p join windows using (k, words)),
hit as (select doc_id, count(distinct place)::bigint as n_hit from (select doc_id, unnest(range(i, i + k)) as place from (select distinct doc_id, i, k from met)) group by doc_id),
own as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from met) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join own using (doc_id)"""

ORACLES["op5_ngram_jaccard_join"] = f"""with recursive doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingle as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as words, len(w) < 5 as short from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from doc where len(w) > 0)),
size as (select doc_id, count(*)::bigint as n from shingle group by doc_id),
shared as (select words, short from shingle group by all having count(*) > 1),
kept as materialized (select doc_id, words, short from shingle semi join shared using (words, short)),
links as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as met from kept x join kept y on x.words = y.words and x.short = y.short and x.doc_id < y.doc_id group by all) p
  join size s on s.doc_id = a join size t on t.doc_id = b where 100 * met >= 75 * (s.n + t.n - met)),
ways as materialized (select a as src, b as dst from links union all select b, a from links),
step as (select 0 as turn, doc_id as id, doc_id as label from doc union all
  select turn + 1, id, least(label, coalesce(other, label)) from (select s.turn, s.id, s.label, min(o.label) as other from step s left join ways on src = s.id left join step o on o.id = dst group by all) where turn < 24)
select doc_id, coalesce(n, 0) as n_shingles, label as component_id from doc left join size using (doc_id) join step on id = doc_id and turn = 24"""

# CRC-32 by its table, which a rule gives: eight steps of the reflected polynomial for each byte.
_CRC = """crc as materialized (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as t)"""


def _crc32(data: str) -> str:
    """CRC-32 of a blob, with crc in reach."""
    octets = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295::bigint)"


ORACLES["op8_sharding"] = f"""with {_CRC}, base as (select doc_id, source, coalesce(octet_length(encode(text)), 0)::bigint + 8 as size, {_crc32("encode(coalesce(text, ''))")} as text_crc32 from documents, crc),
hashed as (select *, ('0x' || substr(md5(concat('11|', coalesce(doc_id::varchar, '-'), '|', text_crc32, '|', size)), 1, 13))::bigint as h from base),
ranked as (select *, (row_number() over (partition by source order by h, doc_id nulls first, size, text_crc32) - 0.5::double) / count(*) over (partition by source) as fraction from hashed),
placed as (select *, row_number() over (order by fraction, source nulls first, h, doc_id nulls first, size, text_crc32) - 1 as place, count(*) over () as n from ranked),
cut as (select *, place * 24 // n as shard from placed)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, (place - (shard * n + 23) // 24)::bigint as slot, null::int as grown_shard, source, fraction from cut"""
