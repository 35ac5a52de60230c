"""DuckDB SQL for the registered queries that SQL can express, written from their definitions and not from the operators.

The others are compared with brute force, exact round trips or held-out labels in the tests.
"""

WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"

OP1 = """
with t as (select *, coalesce(role = 'assistant', false) as mine from conversations),
c as (select conv_id, turn, 't' || turn as call_id, role, text from t where not mine),
r as (select conv_id, turn, 't' || (turn - 1) as call_id, text from t where mine),
-- a call refers to the one two turns before it: its level is its place in an unbroken run of such turns
ids as (select distinct conv_id, turn, call_id from c),
runs as (select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from ids),
levels as (select conv_id, call_id, cast(row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as int) as level from runs),
first as (select conv_id, call_id, min(turn) as result_turn from r group by all)
select c.conv_id, l.level, cast(c.turn as bigint) as turn, 0 as step, c.call_id, f.result_turn is not null as linked,
  coalesce(c.role in ('user', 'system'), false) and c.text is not null as valid,
  '{"arguments":{"after":{"$ref":"t' || (c.turn - 2) || '"},' || case when c.text is null then '' else '"text":' || cast(to_json(c.text) as varchar) || ',' end
    || '"turn":' || c.turn || '},"id":"' || c.call_id || '","name":' || coalesce(cast(to_json(c.role) as varchar), 'null') || ',"type":"call"}' as record
from c join levels l using (conv_id, call_id) left join first f using (conv_id, call_id)
union all
select r.conv_id, l.level, cast(r.turn as bigint), 1, r.call_id, l.level is not null, true,
  '{"content":' || coalesce(cast(to_json(r.text) as varchar), 'null') || ',"id":"' || r.call_id || '","type":"result"}'
from r left join levels l using (conv_id, call_id)
"""

OP5 = """
with docs as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from documents where text is not null),
items as (select distinct item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from benchmark where text is not null),
dw as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from docs),
iw as (select item_id, unnest(ws) as w, unnest(range(len(ws))) as q from items),
sized as (select item_id, ws, len(ws) as n, case when len(ws) < 10 then len(ws) else least(12, (len(ws) + 1) // 2) end as need from items),
-- a stretch scores no more than the equal words of its alignment
equal as (select doc_id, item_id, p - q as shift, count(*) as n from dw join iw using (w) group by 1, 2, 3),
lines as (select doc_id, item_id, shift from equal join (select item_id, min(need) as need from sized group by 1) x using (item_id) where n >= need),
steps as (select l.doc_id, l.item_id, l.shift, s.n, s.need, q, s.ws[q + 1] = d.ws[q + l.shift + 1] as e
  from lines l join sized s using (item_id) join docs d using (doc_id), unnest(range(greatest(0, -l.shift), least(s.n, len(d.ws) - l.shift))) as u(q)),
sums as (select *, sum(case when e then 1 else -2 end) over (partition by doc_id, item_id, shift order by q) as s from steps),
bests as (select *, s - least(0, min(s) over (partition by doc_id, item_id, shift order by q)) as cur from sums),
scored as (select doc_id, item_id, shift, n, max(cur) as best, count(*) filter (e) as hits from bests group by doc_id, item_id, shift, n, need having max(cur) >= need),
ranked as (select *, row_number() over (partition by doc_id, item_id order by best desc, hits desc, shift) as k from scored)
select doc_id, item_id, cast(best as int) as score, cast(hits as int) as matched, cast(n as int) as item_words, cast(shift as int) as start from ranked where k = 1
"""

OP7 = f"""
with d as (select row_number() over () as row, doc_id, {WORDS.format('text')} as ws from documents),
w as (select row, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d),
starts as (select row, i, array_to_string(ws[i:i + 34], ' ') as run from d, unnest(range(1, len(ws) - 33)) as u(i) where len(ws) >= 35),
twice as (select row, i, count(*) over (partition by run) > 1 as dup from starts),
marked as (select w.row, w.i, word, coalesce(max(coalesce(dup, false)) over (partition by w.row order by w.i rows between 34 preceding and current row), false) as gone
  from w left join twice t on t.row = w.row and t.i = w.i),
per as (select row, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from marked group by row)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join per using (row)
"""

OP9 = f"""
with recursive d as (select doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
sh as (select distinct doc_id, s from (
  select doc_id, unnest(case when len(ws) = 1 then ws else list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as s from d) x),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as common from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id
  group by 1, 2),
links as (select u, v from pairs p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * common >= 80 * (a.n + b.n - common)),
near as (select u, v from links union all select v, u from links),
reach as (select doc_id, doc_id as least from d union select r.doc_id, v from reach r join near on u = r.least)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d left join n using (doc_id) join (select doc_id, min(least) as component_id from reach group by 1) c using (doc_id)
"""

#: By name of the query.
ORACLES: dict[str, str] = {"op1_chat_format": OP1, "op5_decontamination": OP5, "op7_substring_dedup": OP7, "op9_minhash_neardup": OP9}
