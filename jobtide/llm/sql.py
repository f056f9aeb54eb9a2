"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

BLANKS = r"[\x20\x09-\x0D]+"
AFTER = "coalesce(case when strpos({0}, '://') > 0 then substr({0}, strpos({0}, '://') + 3) end, '')"
HOST = "translate(regexp_extract({0}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filter(allow: Sequence[str], block: Sequence[str], damping: float = 0.85, waves: int = 200, threshold: float = 0.5) -> str:
    rules = "".join(
        f"when (host = {quoted(h)} or ends_with(host, {quoted('.' + h)})) and starts_with(path, {quoted(p)}) then {quoted(r)} "
        for r in sorted({*allow, *block}, key=lambda r: (-len(r), r)) for h, p in [(r.partition('/')[0], r[r.index('/'):])])
    blocked = ", ".join(map(quoted, block))
    steps = []
    for name, seed, src, dst in (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        steps.append(f"{name}_share as (select {src} as src, {dst} as dst, n / sum(n) over (partition by {src}) as share from links)")
        steps.append(
            f"{name}_wave(k, host, score) as (select 0, host, cast({seed} as double) from hosts where {seed} > 0 union all "
            f"select k + 1, e.dst, {damping} * sum(p.score * e.share) from {name}_wave p join {name}_share e on p.host = e.src where k < {waves} group by k, e.dst)")
        steps.append(f"{name} as (select h.host, coalesce(sum(w.score), 0) as score from hosts h left join {name}_wave w on w.host = h.host group by 1)")
    link = r"""(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)"""
    return f"""
with recursive cut as (select page_id, html, {AFTER.format('url')} as rest from pages),
parts as (select page_id, html, {HOST.format('rest')} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, case {rules} end as rule from parts),
judged as (select *, case when rule in ({blocked}) then 'block' when rule is not null then 'allow' end as said from ruled),
hrefs as (select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as link from parts),
targets as (select src, {HOST.format(AFTER.format("(case when starts_with(link, '//') then 'x:' || link else link end)"))} as dst from hrefs),
links as materialized (select src, dst, count(*) as n from targets where src <> dst and src <> '' and dst <> '' group by 1, 2),
own as (select host, avg(case when said = 'allow' then 1.0 else 0.0 end) as allowed,
        avg(case when said = 'block' then 1.0 else 0.0 end) as blocked from judged where host <> '' group by 1),
hosts as materialized (select * from own union all
        select distinct dst, 0.0, 0.0 from links where dst not in (select host from own)),
{', '.join(steps)},
scored as (select t.host, round(t.score, 6) as trust, round(d.score, 6) as distrust from trust t join distrust d using (host))
select j.page_id, j.host, j.path, j.rule,
  coalesce(j.said, case when s.distrust >= {threshold} and s.distrust > s.trust then 'block' end, 'allow') as verdict, s.trust, s.distrust
from judged j left join scored s on j.host = s.host"""


QUALITY_RULES = rf"""
with base as materialized (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
words as (select rid, list_filter(regexp_split_to_array(t, '{BLANKS}'), lambda x: x <> '') as w from base),
runs as (select rid, unnest(range(1, len(w) - 3)) as i, w from words where len(w) >= 5),
keyed as (select rid, i, w[i:i+4] as run from runs),
twice as (select rid, run from keyed group by 1, 2 having count(*) > 1),
covered as (select distinct k.rid, unnest(range(k.i, k.i + 5)) as p from keyed k join twice using (rid, run)),
repeats as (select rid, count(*) as n from covered group by 1),
lines as (select rid, unnest(string_split(t, chr(10))) as line from base),
full_lines as (select rid, line from lines where regexp_replace(line, '{BLANKS}', '', 'g') <> ''),
line_counts as (select rid, count(*) as n, count(*) - count(distinct line) as dup from full_lines group by 1),
measured as (
  select b.doc_id, cast(len(w.w) as bigint) as n_words,
    cast(length(regexp_replace(b.t, '{BLANKS}', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(b.t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(l.dup, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words, coalesce(l.n, 0) as n_lines,
    length(regexp_replace(b.t, '[^!]', '', 'g')) as marks, length(regexp_replace(b.t, '[^A-Z]', '', 'g')) as upper,
    length(regexp_replace(b.t, '[^a-z]', '', 'g')) as lower
  from base b join words w using (rid) left join line_counts l using (rid) left join repeats r using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 30 * n_words or 100 * marks > 30 * n_words
    or upper > lower or 100 * n_dup_lines > 30 * n_lines or word_chars > 25 * n_words) as kept
from measured"""

DECONTAMINATE = r"""
with items as (
  select w, min(item_id) as item_id from (
    select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') as w from benchmark)
  where len(w) > 0 group by 1),
sized as (select *, len(w) as size, least(5, len(w)) as k from items),
docs as materialized (
  select row_number() over () as rid, doc_id, hash(text) as tag,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') as w from documents),
item_runs as (select w, size, k, unnest(range(1, size - k + 2)) as i from sized),
item_grams as (select w, size, k, i, array_to_string(w[i:i+k-1], ' ') as g from item_runs),
places as (select distinct k, g, i, size from item_grams),
doc_runs as (select d.rid, d.w, s.k, unnest(range(1, len(d.w) - s.k + 2)) as i from docs d, (select distinct k from sized) s where len(d.w) >= s.k),
doc_grams as (select rid, k, i, array_to_string(w[i:i+k-1], ' ') as g from doc_runs),
starts as (select distinct d.rid, p.size, p.k, d.i - p.i as start from doc_grams d join places p on d.k = p.k and d.g = p.g),
clipped as (select distinct s.rid, s.size, s.k, greatest(0, least(s.start, len(d.w) - s.size)) as start from starts s join docs d using (rid)),
gaps as (select *, lead(start) over (partition by rid, size, k order by start) - start as gap from clipped),
cut as (select rid, size, k, unnest(range(start, start + case when gap <= greatest(size - 1, 2 * (size - k)) then gap else 1 end)) as start from gaps),
win as materialized (select row_number() over () as wid, c.*, d.w[c.start + 1 : c.start + c.size] as words from cut c join docs d using (rid)),
win_runs as (select wid, size, k, words, unnest(range(1, len(words) - k + 2)) as i from win),
win_grams as (select wid, size, k, array_to_string(words[i:i+k-1], ' ') as g, count(*) as n from win_runs group by all),
item_counts as (select w, size, k, g, count(*) as n from item_grams group by all),
common as (select a.wid, b.w, sum(least(a.n, b.n)) as n from win_grams a join item_counts b on a.size = b.size and a.k = b.k and a.g = b.g group by all),
scored as (
  select x.rid, s.item_id, s.w, x.start, len(x.words) as n_words,
    c.n / (len(x.words) - s.k + 1 + s.size - s.k + 1 - c.n) as similarity
  from common c join win x using (wid) join sized s on s.w = c.w),
ranked as (
  select d.doc_id, d.tag, r.*, row_number() over (partition by d.doc_id, d.tag, r.w order by similarity desc, start, r.n_words) as nth
  from scored r join docs d using (rid) where similarity >= 0.8)
select doc_id, item_id, cast(start as integer) as start, cast(n_words as integer) as n_words, round(similarity, 6) as similarity
from ranked where nth = 1"""

def remainder(n: int) -> int:
    """CRC-32 remainder of half a byte (fixed value: the reflected polynomial)."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: The checksum takes the text's bytes half by half, the lower half first.
SHARDING = f"""
with rows_ as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, hex(encode(coalesce(text, ''))) as h from documents),
nibbles as (
  select doc_id, size, list_transform(range(length(h)), lambda i: cast(strpos('0123456789ABCDEF', h[cast(i + 2 - 2 * (i % 2) as integer)]) - 1 as bigint)) as x
  from rows_),
summed as (
  select doc_id, size, xor(list_reduce(list_prepend(cast(4294967295 as bigint), x), lambda crc, v:
      xor(crc >> 4, [{', '.join(f'{remainder(n)}::bigint' for n in range(16))}][cast((xor(crc, v) & 15) + 1 as integer)])), 4294967295) as text_crc32
  from nibbles),
ordered as (
  select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and current row) - size as ahead,
    sum(size) over () as total from summed),
cut as (select *, cast((ahead * 8) // total as integer) as shard from ordered)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard,
  cast(row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as bigint) as slot,
  cast(null as integer) as grown_shard
from cut"""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
counts as materialized (
  select lang, phrase, n_words, count(*) as f from (
    select lang, size as n_words, array_to_string(w[i:i+size-1], ' ') as phrase from (
      select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from worded, (values (1), (2), (3)) sizes(size) where len(w) >= size))
  group by all),
totals as (select lang, sum(f) as n from counts where n_words = 1 group by 1),
candidates as (select lang, phrase, n_words, f as a, string_split(phrase, ' ') as w from counts where n_words > 1 and f >= 10),
cut as materialized (
  select lang, phrase, n_words, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k+1:n_words], ' ') as tail
  from (select *, unnest(range(1, n_words)) as k from candidates)),
parted as (
  select c.lang, c.phrase, c.n_words, c.a, c.k, l.f as l, r.f as r,
    1000000 * c.a::hugeint * c.a::hugeint // (l.f::hugeint * r.f::hugeint) as score
  from cut c join counts l on l.lang = c.lang and l.phrase = c.head join counts r on r.lang = c.lang and r.phrase = c.tail),
lowest as (select * from parted qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, inner_phrase, max(a) as a from (
    select lang, a, array_to_string(w[i:i+1], ' ') as inner_phrase from (select lang, a, w, unnest(range(1, n_words)) as i from candidates where n_words = 3))
  group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
  from lowest s left join longer g on g.lang = s.lang and g.inner_phrase = s.phrase where g.a is null or 100 * g.a < 50 * s.a)
select r.lang, r.rank, r.phrase, cast(r.a as bigint) as a, cast(r.l as bigint) as l, cast(r.r as bigint) as r, cast(t.n as bigint) as n,
  cast(r.score as bigint) as score
from ranked r join totals t using (lang) where r.rank <= 2000"""


def crc32(data: str) -> str:
    """The checksum of a hexadecimal string's bytes, half by half, the lower half first."""
    digits = f"list_transform(range(length({data})), lambda i: cast(strpos('0123456789ABCDEF', {data}[cast(i + 2 - 2 * (i % 2) as integer)]) - 1 as bigint))"
    return f"""xor(list_reduce(list_prepend(cast(4294967295 as bigint), {digits}), lambda crc, v:
      xor(crc >> 4, [{', '.join(f'{remainder(n)}::bigint' for n in range(16))}][cast((xor(crc, v) & 15) + 1 as integer)])), 4294967295)"""


RESAMPLING = rf"""
with texts as (
  select row_number() over () as rid, doc_id, 'd' as side, text from documents union all select row_number() over (), null, 't', text from benchmark),
worded as materialized (
  select rid, side, doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
features as materialized (
  select rid, side, array_to_string(w[i:i+size-1], ' ') as feature, count(*) as times from (
    select rid, side, w, size, unnest(range(1, len(w) - size + 2)) as i from worded, (values (1), (2), (3)) sizes(size) where len(w) >= size)
  group by all),
named as (select feature, hex(encode(feature)) as h from (select distinct feature from features)),
bucketed as materialized (select feature, {crc32('h')} % 10000 as bucket from named),
sums as (select b.bucket, sum(f.times) filter (f.side = 'd') as s, sum(f.times) filter (f.side = 't') as t from features f join bucketed b using (feature) group by 1),
whole as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from sums),
gains as (
  select bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * (s_all + 10000) as double) / cast((coalesce(s, 0) + 1) * (t_all + 10000) as double))) as bigint) as gain
  from sums, whole),
weights as (
  select f.rid, sum(f.times) as n_features, sum(f.times * g.gain) as weight
  from features f join bucketed b using (feature) join gains g using (bucket) where f.side = 'd' group by 1),
noised as (
  select w.rid, w.doc_id, len(w.w) as n_words, cast(coalesce(x.n_features, 0) as bigint) as n_features, cast(coalesce(x.weight, 0) as bigint) as weight,
    cast(('0x' || substr(sha256('42:' || coalesce(cast(w.doc_id as varchar), '')), 1, 8)) as bigint) as h
  from worded w left join weights x using (rid) where w.side = 'd'),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) as bigint) as score from noised),
ranked as (
  select *, row_number() over (order by n_words < 20, score desc, doc_id nulls first, weight, n_features) as place,
    count(*) filter (n_words >= 20) over () as able from scored)
select doc_id, n_features, weight, score, cast(case when place <= able * 5 // 100 then place end as bigint) as rank from ranked"""

LINE_DEDUP = rf"""
with rows_ as materialized (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents),
lines as materialized (
  select rid, i, w[i] as line, {LOWER.format("trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key
  from (select rid, w, unnest(range(1, len(w) + 1)) as i from rows_)),
frequent as (select key from lines where length(key) >= 1 group by 1 having count(distinct rid) >= 10),
kept as (select l.rid, string_agg(l.line, chr(10) order by l.i) as text, count(*) as n from lines l where l.key not in (select key from frequent) group by 1)
select r.doc_id, cast(len(r.w) as bigint) as n_lines, cast(len(r.w) - coalesce(k.n, 0) as bigint) as n_dropped, sha256(coalesce(k.text, '')) as kept_sha256
from rows_ r left join kept k using (rid)"""
