"""DuckDB twins of the registered queries."""

from pricebook.llm import mixing as m
from pricebook.llm import quality_rules as q
from pricebook.llm import secret_scan as ss

ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def _alnum(col):
    lower = f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({lower}, '{ALNUM}'), lambda x: x <> '')"


OP4 = f"""
with b as materialized (select item_id, {_alnum('text')} w from benchmark),
g as materialized (
  select distinct item_id, least(len(w), 10) m, w[i:i + 9] gram
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
d as materialized (select row_number() over () rid, doc_id, {_alnum('text')} w from documents),
p as materialized (
  select rid, i, m, w[i:i + m - 1] gram
  from (select rid, w, unnest(generate_series(1, len(w))) i from d), (select distinct m from g)
  where i + m - 1 <= len(w)),
h as materialized (select rid, i, m, gram from p where (m, gram) in (select m, gram from g)),
n as (select rid, count(distinct x) n_hit from (select rid, unnest(generate_series(i, i + m - 1)) x from h) group by 1),
o as (select rid, count(*) n_items, string_agg(item, ',' order by item) items
      from (select distinct rid, cast(item_id as varchar) item from h join g using (m, gram)) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (rid) left join o using (rid)
"""


def _op10():
    strata_rules = "(select count(*) from per) * " + str(len(q.RULES))
    p = q.ALPHA / len(q.RULES)
    sums, cuts = [], []
    ratio = {r: "case when {1} > 0 then {0} / {1} else 0 end".format(*x.split(" / ")) for r, (x, _) in q.RULES.items()}
    for r, (_, grid) in q.RULES.items():
        sums += [f"count(*) filter ({ratio[r]} > {x}) {r}_{i}" for i, x in enumerate(grid)]
        cdf = (lambda k: f"case when {k} >= n_good * {p} then 1 else list_sum(list_transform(generate_series(0, {k}), "
               f"lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({p}) + (n_good - i) * ln(1 - {p})))) end")
        cuts.append("coalesce(" + ", ".join(f"case when {cdf(f'{r}_{i}')} <= {q.DELTA} / ({strata_rules}) then {x} end"
                                            for i, x in reversed(list(enumerate(grid)))) + f") {r}")
    bad = " or ".join(f"coalesce({ratio[r]} > cut.{r}, false)" for r in q.RULES)
    return f"""
with d as materialized (
  select row_number() over () rid, doc_id, lang, coalesce(text, '') t,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '{SPACE}', '', 'g')) > 0) l
  from documents),
win as materialized (select rid, i, g, count(*) over (partition by rid, g) n from (
  select rid, i, w[i:i + 2] g from (select rid, w, unnest(generate_series(1, len(w) - 2)) i from d where len(w) > 2))),
rep as (select rid, count(distinct x) n from (select rid, unnest(generate_series(i, i + 2)) x from win where n > 1) group by 1),
c as materialized (
  select rid, doc_id, lang, len(w) n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
    coalesce(rep.n, 0) n_repeat_words, len(l) n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) n_upper,
    len(w) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(w) base_failed
  from d left join rep using (rid)),
good as (select doc_id from labels where quality is not null and doc_id is not null group by 1 having min(quality) = 1),
per as materialized (
  select lang, count(*) n_good, {', '.join(sums)}
  from c where not base_failed and doc_id in (select doc_id from good) group by 1),
cut as materialized (select lang, {', '.join(cuts)} from per)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars,
  cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, base_failed, not base_failed and not ({bad}) kept
from c left join cut on c.lang is not distinct from cut.lang
"""


def _places(kind, pattern):
    """Matches with their places in DuckDB: the pieces between matches give the starts."""
    p = pattern.replace("'", "''")
    return f"""(select rid, unnest(generate_series(1, len(m))) i, m, s, '{kind}' kind, {ss.KINDS.index(kind)} ko from (
      select rid, regexp_extract_all(t, '{p}') m, string_split_regex(t, '{p}') s from d))"""


OP1 = f"""
with d as materialized (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
f as materialized (
  select rid, kind, ko, m[i] v, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) st
  from ({' union all '.join('select * from ' + _places(k, p) for k, p in zip(ss.KINDS, (ss.ASSIGN, ss.ACCESS, ss.HEX, ss.MIXED)))})),
c0 as materialized (
  select rid, kind, ko, cast(st as bigint) st, cast(st + length(v) as bigint) en,
    case when kind = 'assign' then regexp_extract(v, '{ss.ASSIGN.replace("'", "''")}', 2) else v end v from f),
c1 as materialized (
  select *, len(list_distinct(string_split(v, ''))) >= {ss.LEAST_CHARACTERS} and regexp_matches(v, '[0-9]') random
  from c0 where kind <> 'assign' or length(v) >= 6),
c as materialized (
  select * from c1 where kind <> 'mixed' or random and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')
    and not exists (select 1 from c1 b where b.rid = c1.rid and b.kind <> 'mixed' and b.st < c1.en and c1.st < b.en)),
o as (select v, count(distinct coalesce(source, '')) n, count(distinct (coalesce(source, ''), coalesce(doc_id::varchar, ''))) r
      from c join d using (rid) group by 1),
j as materialized (
  select c.*, case when n >= {ss.COPIED_OWNERS} or r >= {ss.COPIED_REPOS} then 'copied' when random then 'live' else 'plain' end verdict
  from c join o using (v)),
b as (select rid, string_agg(kind || ':' || st || ':' || en, ',' order by st, ko) x, count(*) filter (kind = 'assign') a,
        count(*) filter (kind = 'access') k, count(*) filter (kind = 'hex') h from j where kind <> 'mixed' group by 1),
a as (select rid, string_agg(kind || ':' || st || ':' || en, ',' order by st, ko) x, count(*) filter (verdict = 'live') l,
        count(*) filter (verdict = 'copied') cp from j where kind <> 'mixed' or verdict = 'live' group by 1)
select doc_id, coalesce(b.a, 0) n_assign, coalesce(b.k, 0) n_access, coalesce(b.h, 0) n_hex, sha256(coalesce(b.x, '')) base_sha256,
  coalesce(a.x, '') spans, coalesce(a.l, 0) n_live, coalesce(a.cp, 0) n_copied
from d left join b using (rid) left join a using (rid)
"""


OP8 = f"""
with d0 as materialized (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')) tokens,
    md5(concat_ws('|', {', '.join(f"case when {c} is null then 'n' else length({c}::varchar) || ':' || {c}::varchar end" for c in ('doc_id', 'source', 'text'))})) k
  from documents),
d as materialized (select doc_id, source, tokens, k || '.' || row_number() over (partition by k) k from d0),
s as materialized (select source, sum(tokens) t from d group by 1 having sum(tokens) > 0),
x as materialized (
  select max(t) top, round(greatest(0, case when max(t) = min(t) then 0 else 1 - ln({m.MAX_REPEATS}) / ln(max(t) / min(t)) end), 6) x from s),
q as materialized (select source, t, cast(floor(t * exp((x - 1) * ln(t / top)) + 1e-6) as bigint) quota from s, x),
e as materialized (
  select doc_id, d.source, tokens, k, cast(coalesce(quota // t, 1) as bigint) whole, coalesce(quota % t, 0) rest
  from d left join q on d.source is not distinct from q.source),
part as (
  select *, coalesce(sum(tokens) over (partition by source order by md5('{m.SEED}|' || whole || '|' || k)
    rows between unbounded preceding and 1 preceding), 0) ahead from e where rest > 0),
r as (select doc_id, source, tokens, k, unnest(generate_series(0, whole - 1)) block from e where whole > 0
      union all select doc_id, source, tokens, k, whole from part where ahead < rest)
select doc_id, source, cast(tokens as bigint) tokens, cast(block as bigint) block, md5('{m.SEED}|' || block || '|' || k) place from r
"""


OP12 = f"""
with d as (select row_number() over () rid, doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') b
           from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by b) group_size, row_number() over w = 1 kept,
  sha256(b) text_sha256
from d window w as (partition by b order by n desc, doc_id nulls last, rid)
"""

# crc32 of a decimal number: the byte table from its polynomial, then one step per digit
OP13 = """
with tab as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
                         order by i) v from range(256) r(i)),
t as (select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) k,
        strlen(coalesce(text, '')) b from conversations where conv_id is not null),
c as materialized (select conv_id, list({'k': k, 'b': b} order by turn nulls first, k) seq from t group by 1),
hashed as (select conv_id, seq, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''),
             lambda x: cast(ord(x) as bigint))), lambda a, x: xor(a >> 8, v[(xor(a, x) & 255) + 1])), 4294967295) % 9 h from c, tab),
r as materialized (select x.conv_id, list_concat(coalesce(y.seq[1:x.h], []), x.seq[x.h + 1:]) seq
  from hashed x left join c y on y.conv_id = x.conv_id - x.conv_id % 5),
p as materialized (select conv_id, len(seq) n, d, md5(array_to_string(list_transform(seq[1:d], lambda s: s.k), ',')) key,
    case when d > 0 then md5(array_to_string(list_transform(seq[1:d - 1], lambda s: s.k), ',')) end up, coalesce(seq[d].b, 0) b
  from (select conv_id, seq, unnest(generate_series(0, len(seq))) d from r)),
nodes as materialized (select key, any_value(up) up, any_value(d) as depth, any_value(b) b, min(conv_id) conv_id, count(*) n_convs,
    sha256(coalesce(string_agg(case when d = n then cast(conv_id as varchar) end, ',' order by conv_id), '')) ends_sha256
  from p group by key),
kids as (select up, count(*) n from nodes where up is not null group by 1),
full_ as materialized (select nodes.*, coalesce(kids.n, 0) n_children from nodes left join kids on kids.up = nodes.key),
above as (select distinct l.key as node, a.key as over_ from p l join p a on a.conv_id = l.conv_id and a.d <= l.d),
sums as (select over_, sum(case when n_children = 0 then 1 else 0 end) n_leaves, sum((n_convs - 1) * b) saved_tokens
  from above join full_ on full_.key = above.node group by 1)
select f.conv_id, cast(f.depth as bigint) as depth, u.conv_id parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) n_leaves,
  cast(saved_tokens as bigint) saved_tokens, f.ends_sha256
from full_ f join sums on sums.over_ = f.key left join full_ u on u.key = f.up
"""

ORACLE_SQL = {"op1_secret_scan": OP1, "op8_temperature_mixing": OP8, "op4_decontaminate": OP4, "op10_quality_rules": _op10(),
              "op12_exact_dedup": OP12, "op13_prefix_trie": OP13}
