"""Registered queries: grid layout, lot, client and project (G1-G20)."""

import re

from pyspark.sql import functions as F

from pricebook.functions import patterns as P
from pricebook.functions import vocab as V
from pricebook.operators import grid as G
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_identify import NUMC
from pricebook.plans.q_scalars import alt, blanks, lst, parse_sql, title, trade, words

PLANS = {}


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def q(p):
    return p.replace("'", "''")


def m(e, p, flags="(?i)"):
    return f"regexp_matches({e}, '{flags}{q(p)}')"


def x(e, p, g=1, flags="(?i)"):
    return f"regexp_extract({e}, '{flags}{q(p)}', {g})"


def anyp(ps, whole=False):
    b = "|".join(f"(?:{p})" for p in ps)
    return f"^(?:{b})$" if whole else b


LOW = "list_transform(cells, lambda c: lower(trim(c)))"


def hits_sql(profile):
    _, width, _, _, by_row = P.HEADER_RULES[profile]
    low = f"{LOW}[1:{width}]" if width else LOW
    out = []
    for role in P.ROLES:
        ps = P.HEADER[profile][role]
        cell = f"len(list_filter({low}, lambda c: {m('c', anyp(ps, by_row))})) > 0"
        row = m("array_to_string(" + low + ", ' ')", anyp(ps))
        out.append(f"case when {row + ' or ' + cell if by_row else cell} then 1 else 0 end")
    return " + ".join(out)


def header_sql(profile, name="hd"):
    depth, _, least, stop, _ = P.HEADER_RULES[profile]
    return f"""{name}_s as (select file_id, sheet, row, cells, {hits_sql(profile)} as score from rows where row < {depth}),
        {name}_r as (select *, row_number() over (partition by file_id, sheet order by case when score >= {stop} then 0 else 1 end,
            case when score >= {stop} then row else -score end, row) as k from {name}_s where score >= {least}),
        {name} as (select file_id, sheet, row as header_row, score as header_score, cells as headers from {name}_r where k = 1)"""


reg("g01_find_header_row", lambda t: G.find_header_row(t.rows).drop("headers"),
    f"with {header_sql('main')} select file_id, sheet, header_row, header_score from hd", "rows")
for prof in ("service", "improved", "shared"):
    reg(f"g02_find_header_row_{prof}", lambda t, p=prof: G.find_header_row(t.rows, p).drop("headers"),
        f"with {header_sql(prof)} select file_id, sheet, header_row, header_score from hd", "rows")
HL = "list_transform(headers, lambda c: lower(trim(c)))"


def map_sql(strategy, profile, src="hd", name="mp"):
    cols = []
    for role in P.ROLES:
        ps = P.COLUMNS["scored" if strategy == "scored" else profile][role]
        if strategy == "scored":
            pts = "case " + " ".join(
                f"when c <> '' and {m('c', p)} then case when {m('c', '^(?:' + p + ')$')} then 10 when contains(c, '{q(p)}') then 7 else 5 end"
                for p in ps) + " else 0 end"
            arr = f"list_transform({HL}, lambda c: {pts})"
            e = f"case when list_max({arr}) > 0 then list_position({arr}, list_max({arr})) - 1 end"
        else:
            arr = f"list_transform({HL}, lambda c: {m('c', anyp(ps))})"
            if strategy == "last":
                e = f"case when list_contains({arr}, true) then len(headers) - list_position(list_reverse({arr}), true) end"
            else:
                e = f"case when list_contains({arr}, true) then list_position({arr}, true) - 1 end"
        cols.append(f"({e})::int as {role}")
    return f"{name} as (select file_id, sheet, header_row, headers, {', '.join(cols)} from {src})"


ROLES_SEL = ", ".join(f"coalesce({r}, -1) as {r}" for r in P.ROLES)


def roles(df, *extra):
    return df.select("file_id", "sheet", *extra, *[F.coalesce(r, F.lit(-1)).alias(r) for r in P.ROLES])


for name, strategy, prof in (("g03_map_columns_first", "first", "main"), ("g03_map_columns_shared_header", "first", "shared"),
                             ("g04_map_columns_last", "last", "service"), ("g05_map_columns_scored", "scored", "main")):
    hp = prof if prof in ("service", "shared") else "main"
    reg(name, lambda t, s=strategy, p=prof, h=hp: roles(G.map_columns(G.find_header_row(t.rows, h), s, p)),
        f"with {header_sql(hp)}, {map_sql(strategy, prof)} select file_id, sheet, {ROLES_SEL} from mp", "rows")
# one column hidden per sheet number, so that every inference rule is used
HIDE = [("prix_total", "Lot 01"), ("prix_unitaire", "Lot 02"), ("quantite", "Lot 03"), ("unite", "Lot 04")]


def _hidden(t):
    mp = G.map_columns(G.find_header_row(t.rows))
    for r, s in HIDE:
        mp = mp.withColumn(r, F.when(F.col("sheet") != s, F.col(r)))
    return mp.withColumn("unite", F.when(F.col("sheet") != "Lot 03", F.col("unite")))


HID = "hm as (select * replace ({}) from mp)".format(", ".join(
    [f"case when sheet <> '{s}' then {r} end as {r}" for r, s in HIDE[:3]] + ["case when sheet not in ('Lot 03', 'Lot 04') then unite end as unite"]))
INFER = """i1 as (select * replace (case when prix_unitaire is not null and quantite is not null and prix_total is null and prix_unitaire + 1 < len(headers) then prix_unitaire + 1 else prix_total end as prix_total) from hm),
    i2 as (select * replace (case when prix_total is not null and quantite is not null and prix_unitaire is null and prix_total >= 1 then prix_total - 1 else prix_unitaire end as prix_unitaire) from i1),
    i3 as (select * replace (case when prix_unitaire is not null and quantite is null and (designation is null or unite is null) and prix_unitaire >= 1 then prix_unitaire - 1 else quantite end as quantite) from i2),
    i4 as (select * replace (case when unite is null and designation is not null and quantite > designation + 1 then quantite - 1 else unite end as unite) from i3)"""
reg("g06_infer_positions", lambda t: roles(G.infer_positions(_hidden(t))),
    f"with {header_sql('main')}, {map_sql('first', 'main')}, {HID}, {INFER} select file_id, sheet, {ROLES_SEL} from i4", "rows")
_ts = ", ".join(f"sum(case when length(coalesce(cells[{i + 1}], '')) > 10 then length(cells[{i + 1}]) else 0 end)" for i in range(5))
reg("g07_text_column", lambda t: G.text_column(t.rows, G.find_header_row(t.rows)), f"""with {header_sql('main')},
    s as (select r.file_id, r.sheet, list_value({_ts}) as a from rows r join hd on r.file_id = hd.file_id and r.sheet = hd.sheet
      where row > header_row and row < header_row + 10 group by all)
    select file_id, sheet, (list_position(a, list_max(a)) - 1)::int as designation from s""", "rows")


def ranked_sql(lo, hi, c0, c1, least):
    return f"""nc as (select file_id, sheet, col, count(*) as n from cells where row between {lo} and {hi} and col between {c0} and {c1} and {NUMC.format(c='text')} group by all),
    rk as (select file_id, sheet, list(col order by n desc, col) as r from nc where n > {least} group by all),
    al as (select a.file_id, a.sheet, coalesce(r, []) as r from (select distinct file_id, sheet from rows) a left join rk on a.file_id = rk.file_id and a.sheet = rk.sheet)"""


reg("g08_numeric_columns", lambda t: roles(G.numeric_columns(t.rows)), f"""with {ranked_sql(5, 19, 1, 9, 3)}
    select file_id, sheet, 0 as designation, case when len(r) >= 3 then 1 else -1 end as unite, case when len(r) >= 2 then r[1] else -1 end as quantite,
    case when len(r) >= 2 then r[2] else -1 end as prix_unitaire, case when len(r) >= 3 then r[3] else -1 end as prix_total from al where
    file_id || sheet in (select file_id || sheet from rows where row < 20)""", "rows", "cells")
_v = parse_sql("text", "permissive")
reg("g09_map_columns_by_content", lambda t: roles(G.map_columns_by_content(t.rows)), rf"""
    with c as (select file_id, sheet, row, col, trim(text) as text, {_v} as v from cells where row < 50 and trim(text) <> ''),
    p as (select file_id, sheet, col,
        count(*) filter (where row < 30 and length(text) > 5 and not regexp_matches(regexp_replace(text, '[., ]', '', 'g'), '^\d+$')) as tx,
        avg(length(text)) filter (where row < 30 and length(text) > 5 and not regexp_matches(regexp_replace(text, '[., ]', '', 'g'), '^\d+$')) as ln,
        count(*) filter (where v >= 0) as n, avg(v) filter (where v > 0) as av, median(v) filter (where v > 0) as md, max(v) filter (where v > 0) as mx,
        count(*) filter (where row < 40 and length(text) <= 15) as sh,
        count(*) filter (where row < 40 and length(text) <= 15 and regexp_matches(lower(text), '{alt(P.UNIT_LIKE)}')) as un from c group by all),
    d as (select file_id, sheet, min(col) filter (where col < 8 and tx > 5 and ln > 20) as des from p group by all),
    nm as (select p.*, row_number() over (partition by p.file_id, p.sheet order by col) as k, count(*) over (partition by p.file_id, p.sheet) as cnt
        from p join d on p.file_id = d.file_id and p.sheet = d.sheet where n > 5 and av is not null and (des is null or col <> des)),
    ag as (select file_id, sheet, max(cnt) as cnt, min(col) filter (where av < 1000 and md < 100) as q3, arg_max(col, (av, -col)) filter (where av > 100 and mx > 1000) as t3,
        max(col) filter (where k = 1) as c1, max(col) filter (where k = 2) as c2, max(av) filter (where k = 1) as a1, max(av) filter (where k = 2) as a2 from nm group by all),
    pu3 as (select nm.file_id, nm.sheet, min(col) as p3 from nm join ag on nm.file_id = ag.file_id and nm.sheet = ag.sheet where col is distinct from q3 and col is distinct from t3 group by all),
    un as (select p.file_id, p.sheet, min(p.col) as u from p join d on p.file_id = d.file_id and p.sheet = d.sheet
        left join nm on nm.file_id = p.file_id and nm.sheet = p.sheet and nm.col = p.col
        where p.col > des and p.col < des + 5 and nm.col is null and p.sh > 5 and p.un / p.sh > 0.3 group by all)
    select d.file_id, d.sheet, coalesce(des, -1) as designation, coalesce(u, -1) as unite,
      coalesce(case when cnt >= 3 then q3 when cnt = 2 and (a1 < a2 / 10 or a2 < a1 / 10) then case when a1 < a2 then c1 else c2 end end, -1) as quantite,
      coalesce(case when cnt >= 3 then p3 when cnt = 2 and not (a1 < a2 / 10 or a2 < a1 / 10) then case when a1 < a2 then c1 else c2 end when cnt = 1 and a1 <= 100 then c1 end, -1) as prix_unitaire,
      coalesce(case when cnt >= 3 then t3 when cnt = 2 then case when a1 < a2 then c2 else c1 end when cnt = 1 and a1 > 100 then c1 end, -1) as prix_total
    from d left join ag on d.file_id = ag.file_id and d.sheet = ag.sheet left join pu3 on d.file_id = pu3.file_id and d.sheet = pu3.sheet
    left join un on d.file_id = un.file_id and d.sheet = un.sheet""", "cells")
reg("g09_fill_unit_by_content", lambda t: roles(G.fill_unit_by_content(t.rows, _hidden(t))), f"""
    with {header_sql('main')}, {map_sql('first', 'main')}, {HID},
    k as (select c.file_id, c.sheet, col, count(*) filter (where trim(text) <> '' and length(trim(text)) <= 15) as n,
        count(*) filter (where trim(text) <> '' and length(trim(text)) <= 15 and regexp_matches(lower(text), '{alt(P.UNIT_LIKE)}')) as u
      from cells c join hm on c.file_id = hm.file_id and c.sheet = hm.sheet where unite is null and row > header_row and row <= header_row + 30 group by all),
    f as (select file_id, sheet, min(col) as u from k where n > 5 and u / n > 0.4 group by all)
    select hm.file_id, hm.sheet, coalesce(designation, -1) as designation, coalesce(unite, u, -1) as unite, coalesce(quantite, -1) as quantite,
      coalesce(prix_unitaire, -1) as prix_unitaire, coalesce(prix_total, -1) as prix_total
    from hm left join f on hm.file_id = f.file_id and hm.sheet = f.sheet""", "rows", "cells")
reg("g10_map_columns_shared", lambda t: roles(G.map_columns_shared(t.rows)), rf"""with {ranked_sql(0, 29, 0, 14, 5)},
    c as (select file_id, sheet, col, count(*) filter (where regexp_matches(text, '^\d+\.\d+(?:\.\d+)?$')) as ns,
        count(*) filter (where not regexp_matches(text, '^\d+\.\d+(?:\.\d+)?$') and length(text) > 15) as nt from cells where row < 30 and col < 10 group by all),
    w as (select file_id, sheet, max(len(cells)) as w from rows where row < 30 group by all),
    d as (select c.file_id, c.sheet, arg_min(case when ns > 3 then col + 1 else col end, col) as des from c join w on c.file_id = w.file_id and c.sheet = w.sheet
        where (ns > 3 and col + 1 < w) or (ns <= 3 and nt > 5) group by all)
    select al.file_id, al.sheet, coalesce(des, -1) as designation, -1 as unite, case when len(r) >= 3 then r[1] else -1 end as quantite,
      case when len(r) >= 3 then r[2] when len(r) = 2 then r[1] else -1 end as prix_unitaire, case when len(r) >= 3 then r[3] when len(r) = 2 then r[2] else -1 end as prix_total
    from al left join d on al.file_id = d.file_id and al.sheet = d.sheet""", "rows", "cells")


def _conf(t):
    out = None
    for s in ("main", "header", "content"):
        d = G.mapping_confidence(_hidden(t), s).select("file_id", "sheet", F.lit(s).alias("scorer"), "points", "level")
        out = d if out is None else out.unionByName(d)
    return out


def nn(r):
    return f"case when {r} is not null then 1 else 0 end"


reg("g11_mapping_confidence", _conf, f"""with {header_sql('main')}, {map_sql('first', 'main')}, {HID},
    p as (select file_id, sheet, 'main' as scorer, {nn('designation')} + {nn('unite')} + {nn('prix_unitaire')} + greatest({nn('quantite')}, {nn('prix_total')})
        + case when regexp_matches(lower(coalesce(headers[designation + 1], '')), 'designation|description|libelle|article') then 1 else 0 end as points from hm
      union all select file_id, sheet, 'header', least(5, 2 * {nn('designation')} + 2 * {nn('prix_unitaire')} + {nn('unite')} + {nn('quantite')} + {nn('prix_total')}) from hm
      union all select file_id, sheet, 'content', least(5, 2 * {nn('designation')} + {nn('prix_unitaire')} + {nn('unite')} + {nn('quantite')} + {nn('prix_total')}) from hm)
    select *, case when scorer <> 'content' and points >= 4 then 'high' when scorer = 'main' and points >= 2 then 'medium' when scorer <> 'main' and points >= 3 then 'medium' else 'low' end as level from p""", "rows")
SIG = r"substr(md5(array_to_string(list_filter(list_transform(headers, lambda h: lower(trim(h))), lambda h: h <> ''), '|')), 1, 8) || '_' || regexp_replace(lower(regexp_replace(name, '\.[^.]*$', '')), '\d+', 'X', 'g')"


def _saved(t):
    """Mappings saved earlier: those of the first sheet of the even workbooks."""
    m1 = G.map_columns(G.find_header_row(t.rows)).filter("sheet = 'Lot 01'").join(t.workbooks, "file_id").filter("name like 'BPU%'")
    sig = F.expr("1")
    from pricebook.functions.scalars import layout_signature
    return (m1.withColumn("signature", layout_signature("headers", F.regexp_replace("name", r"\.[^.]*$", "")))
            .groupBy("signature").agg(F.lit(0).alias("designation"), F.lit(2).alias("unite"), F.lit(1).alias("quantite"),
                                      F.lit(3).alias("prix_unitaire"), F.lit(4).alias("prix_total")))


def _apply(t):
    return G.apply_saved_mappings(G.map_columns(G.find_header_row(t.rows)), t.workbooks, _saved(t))


APPLY = f"""{header_sql('main')}, {map_sql('first', 'main')}, sg as (select mp.*, name, {SIG} as signature from mp join workbooks w on mp.file_id = w.file_id),
    sv as (select distinct signature from sg where sheet = 'Lot 01' and name like 'BPU%'), ap as (select sg.*, sv.signature is not null as manual from sg left join sv on sg.signature = sv.signature)"""
reg("g12_apply_saved_mappings", lambda t: roles(_apply(t), "signature", "manual"), f"""with {APPLY}
    select file_id, sheet, signature, manual, case when manual then 0 else designation end as designation, case when manual then 2 else unite end as unite,
    case when manual then 1 else quantite end as quantite, case when manual then 3 else prix_unitaire end as prix_unitaire, case when manual then 4 else prix_total end as prix_total from ap""", "rows", "workbooks")
reg("g12_new_saved_mappings", lambda t: G.new_saved_mappings(_apply(t), _saved(t)),
    f"""with {APPLY}, k as (select *, row_number() over (partition by signature order by file_id, sheet) as k from ap where not manual)
    select signature, {', '.join(P.ROLES)} from k where k = 1""", "rows", "workbooks")

STEM = r"regexp_replace(name, '\.[^.\\/]*$', '')"


def clean_lot_sql(e):
    return title(f"array_to_string(list_filter({words(blanks(e, '[_.-]+'))}, lambda w: lower(w) not in {lst(V.LOT_NOISE)}), ' ')")


def fb_sql(num, s):
    w = (f"list_transform(list_filter(regexp_extract_all({s}, '[A-Za-z]{{3,}}'), lambda w: lower(w) not in {lst(V.FALLBACK_IGNORE)} and length(w) > 3)[1:3], "
         "lambda w: upper(w[1]) || lower(substr(w, 2)))")
    return f"'Lot ' || {num} || ' - ' || case when len({w}) = 0 then 'Travaux' else array_to_string({w}, ' ') end"


def lot_name_sql(profile, src="workbooks"):
    ps = P.LOT_FILE[profile]
    when = []
    for i, p in enumerate(ps):
        ok = m("s", p) + (f" and try_cast({x('s', p)} as int) between 1 and 99" if profile == "main" else "")
        raw = f"trim({x('s', p, 2)})" if re.compile(p).groups > 1 else "''"
        when.append(f"when {ok} then {{'num': trim({x('s', p)}), 'raw': {raw}, 'pattern': {i}}}")
    small = f"array_to_string(list_filter({words(blanks('m.raw', '[_.-]+'))}, lambda w: lower(w) not in {lst(V.LOT_NOISE_SMALL)} and length(w) > 1), ' ')"
    nom = {"main": f"case when length(c) < 3 then {fb_sql('m.num', 's')} else c end",
           "number": "case when m.raw = '' then 'Lot ' || m.num else m.raw end"}.get(profile)
    return f"""lf_{profile} as (select file_id, name, m.num as numero_lot, case when m is not null then {nom or "m.raw"} end as nom_lot, m.pattern as pattern, s, m
        from (select *, {clean_lot_sql('m.raw')} as c from (select *, case {' '.join(when)} end as m from (select *, {STEM} as s from {src}))))"""


def lotsel(df):
    return df.select("file_id", F.coalesce("numero_lot", F.lit("")).alias("numero_lot"), F.coalesce("nom_lot", F.lit("")).alias("nom_lot"))


LOTCOLS = "file_id, coalesce(numero_lot, '') as numero_lot, coalesce(nom_lot, '') as nom_lot"
reg("g13_lot_from_filename", lambda t: lotsel(G.lot_from_filename(t.workbooks)), f"with {lot_name_sql('main')} select {LOTCOLS} from lf_main", "workbooks")
reg("g13_lot_from_filename_number", lambda t: lotsel(G.lot_from_filename(t.files, "number")),
    f"with {lot_name_sql('number', 'files')} select {LOTCOLS} from lf_number", "files")
reg("g13_lot_from_filename_service", lambda t: lotsel(G.lot_from_filename(t.files, "service")), f"""with {lot_name_sql('service', 'files')}
    select file_id, coalesce(numero_lot, case when {m('s', 'dpgf')} then '1' end, '') as numero_lot,
      coalesce(case when m is not null then case when m.raw = '' then 'Lot ' || m.num else m.raw end when {m('s', 'dpgf')} then 'Lot issu de ' || s end, '') as nom_lot from lf_service""", "files")
reg("g13_lot_from_filename_enhanced", lambda t: G.lot_from_filename(t.files, "enhanced").select("file_id", "numero_lot", "pattern"),
    f"with {lot_name_sql('enhanced', 'files')} select file_id, numero_lot, pattern from lf_enhanced", "files")
INF = f"""li as (select file_id, coalesce(n, p) as numero_lot, case when n is not null then coalesce({trade('name', V.TRADES)}, 'Travaux') || ' - Lot ' || n
      when p is not null then case when pr = '' then 'Lot ' || p else pr end end as nom_lot from
      (select *, case when regexp_matches(lower(name), '{alt(P.LOT_WORDS)}') then list_filter(regexp_extract_all({STEM}, '\\d{{1,2}}'), lambda d: d::int between 1 and 99)[1] end as n,
        case when {m('path', P.LOT_PATH)} then {x('path', P.LOT_PATH)} end as p, {clean_lot_sql(x('path', P.LOT_PATH, 2))} as pr from ff))"""


def _ff(t):
    return t.workbooks.withColumn("path", F.concat(F.lit("/src/Lot "), (F.col("file_id") % 3 + 1).cast("string"), F.lit(" peinture/"), F.col("name")))


FF = "ff as (select *, concat('/src/Lot ', cast(file_id % 3 + 1 as string), ' peinture/', name) as path from workbooks)"
reg("g14_lot_inferred", lambda t: lotsel(G.lot_inferred(_ff(t))), f"with {FF}, {INF} select {LOTCOLS} from li", "workbooks")
CONT = f"""lc as (select file_id, sheet, row, col, trim({x('text', P.LOT_CELL[0])}) as numero_lot, trim({x('text', P.LOT_CELL[0], 2)}) as nom_lot
    from cells where row < 15 and {m('text', P.LOT_CELL[0])})"""
reg("g15_lot_from_content", lambda t: G.lot_from_content(t.rows), f"with {CONT} select * from lc", "cells")
_svc = " union all ".join(f"select file_id, sheet, row, col, {i} as k, trim({x('text', p, 1, '')}) as n, trim({x('text', p, 2, '')}) as t from cells where row < 20 and col < 10 and {m('text', p, '')}"
                          for i, p in enumerate(P.LOT_CELL_SERVICE))
reg("g15_lot_from_content_service", lambda t: G.lot_from_content(t.rows, "service"), rf"""with a as ({_svc}),
    b as (select *, case when regexp_replace(n, '[^\d.]', '', 'g') = '' then n else regexp_replace(n, '[^\d.]', '', 'g') end as numero_lot, case when t = '' then 'Lot ' || n else t end as nom_lot from a)
    select file_id, sheet, row, col, numero_lot, nom_lot from (select *, row_number() over (partition by file_id, numero_lot order by sheet, row, col, k) as r from b) where r = 1""", "cells")
reg("g16_detect_lot", lambda t: lotsel(G.detect_lot(_ff(t), t.rows)), f"""with {FF}, {lot_name_sql('main', 'ff')}, {INF}, {CONT},
    c1 as (select * from (select *, row_number() over (partition by file_id order by sheet, row, col) as k from lc) where k = 1)
    select ff.file_id, coalesce(a.numero_lot, b.numero_lot, c1.numero_lot, '00') as numero_lot,
      case when a.numero_lot is not null then a.nom_lot when b.numero_lot is not null then b.nom_lot when c1.numero_lot is not null then c1.nom_lot else 'Lot par défaut - ' || {STEM.replace('name', 'ff.name')} end as nom_lot
    from ff left join lf_main a on ff.file_id = a.file_id left join li b on ff.file_id = b.file_id left join c1 on ff.file_id = c1.file_id""", "workbooks", "cells")


def clean_client_sql(e):
    return f"array_to_string(list_filter({words(blanks(e, '[_.-]+'))}, lambda w: upper(w) not in {lst(V.CLIENT_IGNORE)}), ' ')"


def pick_sql(e, ps, least, flags="(?i)", more=""):
    out = []
    for p in ps:
        c = clean_client_sql(x(e, p, 1, flags))
        out.append(f"case when {m(e, p, flags)} and length({c}) >= {least}{more.format(c=c)} then {c} end")
    return "coalesce(" + ", ".join(out) + ")"


CF = f"cf as (select file_id, name, {pick_sql('s', P.CLIENT_FILE, 4)} as client from (select *, {STEM} as s from workbooks))"
reg("g17_client_from_filename", lambda t: G.client_from_filename(t.workbooks).fillna(""),
    f"with {CF} select file_id, name, coalesce(client, '') as client from cf", "workbooks")
_known = "case " + " ".join("when contains(upper({e}), '" + c + "') then '" + c + "'" for c in P.COMPANIES) + " end"
CELLC = f"coalesce({pick_sql('trim(text)', P.CLIENT_CELL, 3, '', ' and regexp_matches({c}, ' + chr(39) + chr(92) + 'p{{L}}' + chr(39) + ') and regexp_matches({c}, ' + chr(39) + '[^ ]{{2,}}' + chr(39) + ')')}, {_known.format(e='text')})"
CC = f"""er as (select file_id, sheet, row, array_to_string(list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> ''), ' ') as tx from rows where row < 15),
    c1 as (select file_id, arg_min(c, (sheet, row)) filter (where c is not null) as one, arg_min(k, (sheet, row)) filter (where k is not null) as three
      from (select *, {pick_sql('tx', P.CLIENT_ROW, 3)} as c, {_known.format(e='tx')} as k from er) group by 1),
    c2 as (select file_id, arg_min(c, (sheet, row, col)) filter (where c is not null) as two from (select *, {CELLC} as c from cells where row < 15 and col < 8) group by 1),
    cc as (select c1.file_id, coalesce(one, two, three) as client from c1 left join c2 on c1.file_id = c2.file_id where coalesce(one, two, three) is not null)"""
reg("g18_client_from_content", lambda t: G.client_from_content(t.rows), f"with {CC} select * from cc", "rows", "cells")
_lab = "coalesce(" + ", ".join(f"case when {m('lower(c)', p)} then {x('lower(c)', p)} end" for p in P.CLIENT_LABEL) + ")"
reg("g18_client_from_content_service", lambda t: G.client_from_content(t.rows, "service"), f"""
    with a as (select file_id, sheet, row, list_filter(list_transform(cells[1:5], lambda c: {_lab}), lambda z: z is not null)[1] as c from rows where row < 15)
    select file_id, arg_min(trim(c), (sheet, row)) as client from a where c is not null group by 1""", "rows")
DC = f"""{CF}, {CC}, w0 as (select cf.file_id, name, coalesce(cc.client, cf.client) as found, {STEM} as s,
      list_filter(regexp_extract_all({STEM}, '[A-Za-z]{{4,}}'), lambda w: upper(w) not in {lst(V.CLIENT_IGNORE)}) as ws from cf left join cc on cf.file_id = cc.file_id),
    w1 as (select *, case when length(s) > 5 then ws[1] end as word, case when {m('s', 'Lot' + chr(92) + 's*(' + chr(92) + 'd+)')} then 'Lot' || {x('s', 'Lot' + chr(92) + 's*(' + chr(92) + 'd+)')} end as lm from w0),
    w2 as (select *, coalesce(lm, substr(word, 1, 8), substr(string_split(s, ' ')[1], 1, 8)) as mark from w1),
    dc as (select file_id, name, case when found is null then {title('word')} when contains(upper(found), upper(mark)) then found else found || ' (' || mark || ')' end as client from w2)"""
reg("g19_detect_client", lambda t: G.detect_client(t.workbooks, t.rows), f"with {DC} select * from dc", "workbooks", "rows", "cells")
reg("g20_project_name", lambda t: G.project_name(t.workbooks, t.rows, G.detect_client(t.workbooks, t.rows)), f"""with {DC},
    lg as (select file_id, arg_min(trim(text), (-length(trim(text)), sheet, row, col)) as best from cells where row < 5 and col < 3 and length(trim(text)) > 5
        and not regexp_matches(upper(text), '{alt(P.PROJECT_SKIP)}') group by 1),
    a as (select dc.file_id, dc.name, {STEM.replace('name', 'dc.name')} as s, case when length(client) > 2 then client end as c, substr(best, 1, 50) as b from dc left join lg on dc.file_id = lg.file_id),
    b as (select *, case when {m('s', P.PROJECT_LOT)} then case when trim({x('s', P.PROJECT_LOT, 2)}) = '' then 'Lot ' || {x('s', P.PROJECT_LOT)}
        else 'Lot ' || {x('s', P.PROJECT_LOT)} || ' - ' || trim({x('s', P.PROJECT_LOT, 2)}) end end as l,
        case when coalesce(contains(lower(c), lower(b)), false) then null else b end as b2 from a),
    d as (select *, case when coalesce(contains(lower(c), lower(l)), false) or coalesce(contains(lower(b2), lower(l)), false) then null else l end as l2 from b)
    select file_id, name, case when length(concat_ws(' - ', c, b2, l2)) < 10 then s else concat_ws(' - ', c, b2, l2) end as project from d""", "workbooks", "rows", "cells")
