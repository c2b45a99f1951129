"""SQL twins of the queries, for DuckDB."""

from crossover.llm.line_quality import ENDS, MIN_WORDS, PHRASES, REPEAT_WINDOW, SEPARATORS, SHORT_LINE

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all(coalesce(" + LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select doc_id, {ALNUM_WORDS.format('text')} as w from documents),
b as (select item_id, {ALNUM_WORDS.format('text')} as w from benchmark),
bw as (select distinct item_id, w[i:i + 9] as g, least(len(w), 10) as n
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, w[i:i + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.g = bw.g),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from m)) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
          from (select distinct doc_id, cast(item_id as varchar) as item from m) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on hits.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

LINE_DEDUP = r"""
with l as (select doc_id, t.line, t.n from documents, unnest(string_split(coalesce(text, ''), chr(10))) with ordinality as t(line, n)),
k as (select *, """ + LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))") + r""" as key from l),
hot as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.doc_id, k.line, k.n, hot.key is not null and k.doc_id <> hot.keeper as gone from k left join hot on k.key = hot.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from j group by doc_id"""

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {WORDS.format('text')} as w from documents),
s as (select doc_id, i, w[i:i + 19] as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
r as (select doc_id, i, row_number() over (partition by g order by doc_id, i) > 1 as again from s),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from r where again),
k as (select d.doc_id, t.word, t.p, gone.p is not null as removed
      from d, unnest(d.w) with ordinality as t(word, p) left join gone on gone.doc_id = d.doc_id and gone.p = t.p),
a as (select doc_id, count(*) filter (where removed) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (where not removed), '') as kept from k group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join a on a.doc_id = d.doc_id"""

NEAR_DEDUP = f"""
with recursive d as (select doc_id, {WORDS.format(LOWER.format('text'))} as w from documents),
s as (select distinct doc_id, w[i:least(i + 3, len(w))] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)),
r as (select doc_id as node, doc_id as root from d union select e.y, r.root from r join e on e.x = r.node where r.root < e.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id join (select node, min(root) as component_id from r group by 1) c on c.node = d.doc_id"""

_SQL = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
LINE_QUALITY = rf"""
with t as (select doc_id, coalesce(text, '') as text, {WORDS.format('text')} as w from documents),
win as (select doc_id, i, w[i:i + {REPEAT_WINDOW - 1}] as g from (select doc_id, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) as i from t where len(w) >= {REPEAT_WINDOW})),
again as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {REPEAT_WINDOW})) as p from again) group by 1),
l as (select doc_id, x.line, x.n, {WORDS.format('x.line')} as w from t, unnest(string_split(text, chr(10))) with ordinality as x(line, n)),
f as (select *, length(array_to_string(w, '')) as chars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as symbols,
             len(list_filter(w, lambda x: x in ({_SQL(SEPARATORS)}))) as seps,
             row_number() over (partition by doc_id, line order by n) > 1 as dup
      from l where len(w) > 0),
j as (select *, 10 * symbols > chars or (seps >= 2 and 4 * seps >= len(w))
             or (len(w) <= {SHORT_LINE} and regexp_matches({LOWER.format('line')}, '{"|".join(PHRASES)}'))
             or right(w[-1], 1) not in ({_SQL(ENDS)}) as bad from f),
a as (select doc_id, sum(chars) as word_chars, count(*) filter (where dup) as n_dup_lines, count(*) filter (where bad) as n_failed_lines,
             coalesce(sum(chars) filter (where bad), 0) as lost_chars from j group by 1),
o as (select t.doc_id, cast(len(t.w) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
             coalesce(rep.n, 0) as n_repeat_words, coalesce(n_failed_lines, 0) as n_failed_lines, cast(coalesce(lost_chars, 0) as bigint) as lost_chars
      from t left join a on a.doc_id = t.doc_id left join rep on rep.doc_id = t.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 20 * n_words as base_failed from o)
select *, not base_failed and 2 * lost_chars <= word_chars as kept from b"""

_NORMAL = r"trim(regexp_replace(lower({0}), '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_MARKED = r"'{1}' || replace({0}, chr(10), chr(10) || '{1}')"
QUOTES = rf"""
with recursive c as (select conv_id, turn, min(text) as text from conversations where conv_id is not null and turn is not null group by all),
q as (select a.conv_id * 1000 + a.turn as id, coalesce(a.text, '') as text, (a.conv_id + a.turn) % 3 as kind,
             case when b.turn is not null then coalesce(b.text, '') end as q1, case when d.turn is not null then coalesce(d.text, '') end as q2
      from c a left join c b on b.conv_id = a.conv_id and b.turn = a.turn - 1 left join c d on d.conv_id = a.conv_id and d.turn = a.turn - 2),
q3 as (select id, text, q2, case kind when 0 then q1 when 1 then replace(translate(q1, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', '  ') else string_split(q1, chr(10))[1] end as q1 from q),
m as (select id, concat_ws(chr(10), {_MARKED.format('q2', '>> ')}, {_MARKED.format('q1', '> ')}, text) as text from q3),
l as (select id, x.n as pos, length(regexp_replace(regexp_extract(x.line, '^((?:[ \t]*>)+) ?', 1), '[^>]', '', 'g')) as level,
             regexp_replace(x.line, '^((?:[ \t]*>)+) ?', '') as line
      from m, unnest(string_split(text, chr(10))) with ordinality as x(line, n)),
t as (select *, coalesce(cast(lag(level) over w <> level as int), 1) as turned from l window w as (partition by id order by pos)),
r as (select *, sum(turned) over (partition by id order by pos) as run from t),
p as (select id, run, any_value(level) as level, string_agg(line, chr(10) order by pos) as body from r group by id, run),
own as (select id, string_agg(body, chr(10) order by run) as body from p where level = 0 group by id),
pieces as (select id, {_NORMAL.format('body')} as s from p where level = 0 union all select id, {_NORMAL.format('body')} from own
           union all select id, {_NORMAL.format('line')} from r where level = 0 and length({_NORMAL.format('line')}) >= 12),
o as (select s, min(id) as original from pieces where s <> '' group by s),
votes as (select id, run, level, {_NORMAL.format('body')} as s, 1 as entire from p where level > 0
          union all select id, run, level, {_NORMAL.format('line')}, 0 from r where level > 0 and length({_NORMAL.format('line')}) >= 12),
f as (select v.id, v.run, v.level, o.original, max(entire) as entire, count(*) as n from votes v join o on o.s = v.s where v.s <> '' and o.original < v.id group by all),
links as (select id, run, level, original from f qualify row_number() over (partition by id, run order by entire desc, n desc, original) = 1),
parent as (select id, original as parent from links qualify row_number() over (partition by id order by level, original desc) = 1),
tree as (select m.id, cast(null as bigint) as parent, m.id as conversation, 0 as depth from m anti join parent on parent.id = m.id
         union all select x.id, x.parent, t.conversation, t.depth + 1 from tree t join parent x on x.parent = t.id),
n as (select id, count(*) as n_links from links group by id)
select tree.id, conversation, parent, depth, coalesce(n_links, 0) as n_links, trim(coalesce(body, '')) as text
from tree left join n on n.id = tree.id left join own on own.id = tree.id"""

_RECORD = r"""concat_ws(chr(13) || chr(10), 'WARC/1.0', 'WARC-Type: response', 'WARC-Target-URI: ' || url, 'WARC-Payload-Digest: sha256:' || sha256(html),
    'Content-Length: ' || cast(strlen(html) as varchar)) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""
FIXITY = rf"""
with copy as (select page_id, case when page_id % 503 = 11 then url || '#' else url end as url,
                     case when page_id % 97 = 5 then translate(html, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when page_id % 97 = 6 then substr(html, 2) else html end as html
              from pages where page_id % 211 <> 7
              union all select page_id, url, html from pages where page_id % 601 = 13),
ra as (select page_id as k, {_RECORD} as r from pages),
rb as (select page_id as k, {_RECORD} as r from copy),
ga as (select k, count(*) as n, sum(strlen(r)) as size, list_sort(list(r)) as rs from ra group by k),
gb as (select k, count(*) as n, sum(strlen(r)) as size, list_sort(list(r)) as rs from rb group by k),
a as (select *, coalesce(sum(size) over (partition by k >> 8 order by k rows between unbounded preceding and 1 preceding), 0) as start from ga),
b as (select *, coalesce(sum(size) over (partition by k >> 8 order by k rows between unbounded preceding and 1 preceding), 0) as start from gb)
select coalesce(a.k, b.k) as page_id, case when a.k is null then 'extra' when b.k is null then 'missing' when a.n <> b.n then 'count' else 'corrupt' end as kind,
       cast(a.start as bigint) as offset_a, cast(a.size as bigint) as size_a, cast(b.start as bigint) as offset_b, cast(b.size as bigint) as size_b
from a full join b on a.k = b.k where a.rs is distinct from b.rs"""

PHRASE_MINING = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY 1),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) AS ks(k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
held AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS g
         FROM candidates, range(2, 5) AS ms(m), range(1, 5) AS ss(s) WHERE m < k AND s + m - 1 <= k GROUP BY 1, 2),
kept AS (SELECT c.* FROM candidates c LEFT JOIN held USING (lang, phrase) WHERE g IS NULL OR 100 * g < 100 * a),
cuts AS (SELECT kept.lang, kept.phrase, a, n, c AS cut, h.f AS l, t.f AS r, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score
         FROM kept JOIN range(1, 5) AS cs(c) ON c < kept.k JOIN totals ON totals.lang = kept.lang
         JOIN counted h ON h.lang = kept.lang AND h.phrase = array_to_string(w[1:c], ' ')
         JOIN counted t ON t.lang = kept.lang AND t.phrase = array_to_string(w[c + 1:], ' ')),
lowest AS (SELECT lang, phrase, a, n, min(struct_pack(score := score, cut := cut, l := l, r := r)) AS m FROM cuts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, m.l AS l, m.r AS r, n::BIGINT AS n, m.score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
