"""Registered queries: sections, elements and items of the grid (G21-G34)."""

from pyspark.sql import functions as F

from pricebook.functions import item_rules as R
from pricebook.functions import vocab as V
from pricebook.operators import grid as G
from pricebook.operators import items as I
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_grid import header_sql, m, map_sql, q, x
from pricebook.plans.q_scalars import _kind, alt, parse_sql, unit_sql, words

PLANS = {}
HEAD = f"{header_sql('main')}, {map_sql('first', 'main')}"
W = "over (partition by file_id, sheet order by row)"


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def mapping(t):
    return G.infer_positions(G.map_columns(G.find_header_row(t.rows)))


def cell(role):
    return f"trim(coalesce(cells[{role} + 1], ''))"


LINES = f"""li as (select r.file_id, r.sheet, row, cells, {cell('designation')} as text, {cell('unite')} as unit_cell, {cell('quantite')} as q_cell,
    {cell('prix_unitaire')} as pu_cell, {cell('prix_total')} as pt_cell from rows r join mp on r.file_id = mp.file_id and r.sheet = mp.sheet
    where row > header_row and len(list_filter(cells, lambda c: c <> '')) > 0)"""


def sections_sql(profile):
    rules = R.PROFILES[profile]
    det = "case " + " ".join(f"when {m('text', p, '(?i)' if ci else '')} then '{n}'" for n, p, ci, _, _ in rules) + " end"
    nums, titles, lv = [], [], []
    for n, p, ci, rule, level in rules:
        def g(i):
            return f"trim({x('text', p, i, '(?i)' if ci else '')})"
        if rule == "number":
            num, title = g(1), f"case when {g(2)} = '' then 'Section ' || {g(1)} else {g(2)} end"
        elif rule == "prefix":
            num = f"{g(1)} || ' ' || {g(2)}"
            title = f"case when {g(3)} = '' then {num} else {g(3)} end"
        elif rule == "total":
            num, title = g(1), f"case when {g(2)} = '' then {g(1)} else {g(2)} end"
        elif rule == "title":
            num = title = "text"
        else:
            title = g(2) if rule == "hash_TITLE" else g(1)
            pre, dg = {"hash_S": ("S", 4), "hash_SEC": ("SEC_", 3), "hash_TITLE": ("TITLE_", 3)}[rule]
            num = f"'{pre}' || lpad((cast('0x' || substr(md5({title}), 1, 8) as bigint) % {10 ** dg})::varchar, {dg}, '0')"
        nums.append(f"when '{n}' then {num}")
        titles.append(f"when '{n}' then {title}")
        cnt = "(length(num) - length(regexp_replace(num, '[{}]', '', 'g')))"
        lv.append(f"when '{n}' then " + {
            "1": "1", "2": "2", "separators": cnt.format(".,") + " + 1",
            "dots_or_code": rf"case when regexp_matches(num, '^[A-Z]\d+$') then 1 else {cnt.format('.')} + 1 end",
            "dotted": r"case when regexp_matches(num, '\d+\.\d+') then 3 else 2 end",
            "dashes": cnt.format("-") + " + 1", "commas": cnt.format(",") + " + 1",
            "digit": r"case when regexp_matches(num, '^\d+$') and coalesce(try_cast(num as bigint), 9) <= 5 then try_cast(num as int) else 2 end",
            "fraction": "least(coalesce(try_cast(string_split(num, '/')[1] as int), 5), 5)", "total": "null"}[level])

    def cut(c, n):
        return f"case when length({c}) > {n} then substr({c}, 1, {n - 3}) || '...' else {c} end"

    return f"""s1 as (select *, {det} as pattern from li),
        s2 as (select *, case pattern {' '.join(nums)} end as num, case pattern {' '.join(titles)} end as title from s1),
        s3 as (select *, (case pattern {' '.join(lv)} end)::int as lvl, {cut('num', 50)} as numero_section, {cut('title', 255)} as titre_section from s2),
        se as (select *, case when pattern is not null then coalesce(lvl, greatest(2, coalesce(last_value(lvl ignore nulls) {W}, 0))) end as niveau_hierarchique from s3)"""


SECS = ["file_id", "sheet", "row", "pattern", "numero_section", "titre_section", "niveau_hierarchique"]


def _sections(t, profile):
    d = I.section_level(I.section_fields(I.detect_sections(I.lines(t.rows, mapping(t)), profile), profile))
    return d.filter("pattern is not null").select(*SECS)


for prof in ("main", "enhanced", "service", "shared"):
    reg("g21_detect_sections" + ("" if prof == "main" else f"_{prof}"), lambda t, p=prof: _sections(t, p),
        f"with {HEAD}, {LINES}, {sections_sql(prof)} select {', '.join(SECS)} from se where pattern is not null", "rows")


def _doc_sections(t):
    """Section rules over the lines of the documents, as one text column."""
    d = t.texts.select(F.col("doc_id").alias("file_id"), F.lit("doc").alias("sheet"), F.col("line_no").alias("row"), F.trim("text").alias("text"))
    return I.section_level(I.section_fields(I.detect_sections(d))).filter("pattern is not null").select(
        "file_id", "row", "pattern", F.md5("numero_section").alias("num"), F.md5("titre_section").alias("titre"), "niveau_hierarchique")


reg("g22_section_fields_documents", _doc_sections,
    f"""with li as (select doc_id as file_id, 'doc' as sheet, line_no as row, trim(text) as text from texts), {sections_sql('main')}
    select file_id, row, pattern, md5(numero_section) as num, md5(titre_section) as titre, niveau_hierarchique from se where pattern is not null""", "texts")
reg("g23_section_level", lambda t: _sections(t, "main").groupBy("pattern", "niveau_hierarchique").agg(F.count("*").alias("n")),
    f"with {HEAD}, {LINES}, {sections_sql('main')} select pattern, niveau_hierarchique, count(*) as n from se where pattern is not null group by all", "rows")
reg("g24_section_parents", lambda t: I.section_parents(_sections(t, "main")).select(
    "file_id", "sheet", "row", F.coalesce("parent_row", F.lit(-1)).alias("parent_row"), F.coalesce("parent_numero", F.lit("")).alias("parent_numero")),
    f"""with {HEAD}, {LINES}, {sections_sql('main')}, z as (select * from se where pattern is not null),
    p as (select a.file_id, a.sheet, a.row, max(b.row) as pr from z a left join z b on a.file_id = b.file_id and a.sheet = b.sheet and b.row < a.row
      and b.niveau_hierarchique < a.niveau_hierarchique group by all)
    select p.file_id, p.sheet, p.row, coalesce(pr, -1) as parent_row, coalesce(z.numero_section, '') as parent_numero
    from p left join z on z.file_id = p.file_id and z.sheet = p.sheet and z.row = p.pr""", "rows")


def pts(cond, p):
    return f"case when {cond} then {p} else 0 end"


def has(col, ws):
    return f"regexp_matches({col}, '{alt(ws)}')"


KINDX = _kind
CODE = "(" + " or ".join(m("fw", p) for p in V.ARTICLE_EVIDENCE) + ")"


def score_sql(profile="main"):
    v = "standard" if profile != "enhanced" else "permissive"
    base = f"""e1 as (select *, {parse_sql('q_cell', v)} as vq, {parse_sql('pu_cell', v)} as vu, {parse_sql('pt_cell', v)} as vt, lower(text) as low, lower(unit_cell) as un,
        length(text) as n, string_split_regex(text, ' +')[1] as fw,
        case when lead(row) {W} = row + 1 then lead(text) {W} end as nt from se)"""
    if profile == "main":
        hu = "un not in ('', '0', 'nan', '-')"
        coded = r"(length(fw) >= 3 and regexp_matches(fw, '\d') and n > length(fw) + 5)"
        sc = " + ".join([pts("n > 2", 1), pts(f"n > 2 and {has('low', R.TECHNICAL)}", 2), pts(f"n > 2 and {has('low', V.FORFAIT_WORDS)}", 1),
                         pts(f"n > 2 and {has('low', V.VARIABLE_WORDS)}", 1), pts(CODE, 2), pts(coded, 1), pts(hu, 1),
                         f"case when {hu} and {has('un', R.KNOWN_UNITS)} then 2 when {hu} and length(un) <= 5 and regexp_matches(un, '^\\p{{L}}+$') then 1 else 0 end",
                         pts("vq > 0", 1), pts("vq between 0.01 and 10000", 1), pts("vu > 0", 2), pts("vu between 0.01 and 100000", 1), pts("vt > 0", 2),
                         pts("vt between 1 and 1000000", 1), pts("nc", 1), pts(has("low", R.CONTEXT), 1),
                         "-1 * " + pts(f"{has('low', R.FALSE_POSITIVE)} and n < 50", 2)])
        ok = f"n >= 5 and (vq > 0 or vu > 0 or vt > 0 or {hu} or has_article or {has('low', R.TECHNICAL)}) and score >= case when kind = 'forfait' then 2 else 3 end"
        art, kind = f"{CODE} or {coded}", KINDX
    elif profile == "enhanced":
        hu = "un not in ('', '0', 'nan')"
        sc = " + ".join([pts("n > 3", 1), pts(f"n > 3 and {has('low', R.WORK_WORDS)}", 2), pts(hu, 1), pts(f"{hu} and {has('un', R.SMALL_UNITS)}", 1),
                         pts("vt > 0", 2), pts("vu > 0", 2), pts("vq > 0", 1), pts(r"regexp_matches(fw, '^[A-Z]?\d+(?:\.\d+)*$')", 1), pts(has("low", R.PHRASES), 1)])
        ok = f"n > 3 and (vq > 0 or vu > 0 or vt > 0 or {hu} or has_article) and score >= 2"
        art, kind = r"regexp_matches(fw, '^[A-Z]?\d+(?:\.\d+)*$')", "'standard'"
    else:
        priced = "(pt_cell <> '' or (pu_cell <> '' and q_cell <> ''))"
        if profile == "service":
            priced = f"({priced} or {has('low', R.SERVICE_UNITS)} or n > 30)"
        sc, art, kind = pts(priced, 1), "false", "'standard'"
        ok = f"score = 1 and last_value(case when pattern is not null then row end ignore nulls) {W} is not null"
    return f"""{base}, e2 as (select *, coalesce(regexp_matches(nt, '{R.CONTINUATION}'), false) as nc from e1),
        e3 as (select *, {kind} as kind, {art} as has_article, {sc} as score from e2),
        el as (select *, coalesce(pattern is null and text <> '' and {ok}, false) as is_element from e3)"""


def _scored(t, profile):
    return I.score_elements(I.section_level(I.section_fields(I.detect_sections(I.lines(t.rows, mapping(t)), profile), profile)), profile)


for name, prof in (("g25_score_elements", "main"), ("g25_score_elements_enhanced", "enhanced"),
                   ("g26_score_elements_service", "service"), ("g27_score_elements_improved", "improved")):
    reg(name, lambda t, p=prof: _scored(t, p).select("file_id", "sheet", "row", "score", "kind", "has_article", "is_element"),
        f"with {HEAD}, {LINES}, {sections_sql(prof)}, {score_sql(prof)} select file_id, sheet, row, score, kind, has_article, is_element from el", "rows")


def colsw(ws):
    return f"list_filter(range(1, len(headers) + 1), lambda i: regexp_matches(lower(headers[i]), '{alt(ws)}'))"


def fnum(cols):
    return f"list_filter(list_transform({cols}, lambda i: {parse_sql(chr(99) + 'ells[i]', 'digits')}), lambda v: v is not null)[1]"


_ls = "case " + " ".join(f"when {m('tx', p)} then {i}" for i, p in enumerate(R.LOOSE_SECTIONS)) + " end"
_ln = "case k " + " ".join(f"when {i} then {x('tx', p)}" for i, p in enumerate(R.LOOSE_SECTIONS)) + " end"
_lt = "case k " + " ".join(f"when {i} then trim({x('tx', p, 2)})" for i, p in enumerate(R.LOOSE_SECTIONS)) + " end"
reg("g28_classify_rows_simple", lambda t: I.classify_rows_simple(t.rows, G.find_header_row(t.rows)).select(
    "file_id", "sheet", "row", "type", *[F.coalesce(c, F.lit("")).alias(c) for c in ("numero_section", "titre_section", "designation", "unite")],
    F.coalesce("niveau", F.lit(0)).alias("niveau"), *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("quantite", "prix_unitaire", "prix_total")]), f"""
    with {header_sql('main')}, h as (select *, {colsw(('prix', 'p.u', 'pu', '€'))} as pc, {colsw(('quant', 'qté', 'qty'))} as qc0 from hd),
    h2 as (select *, list_filter(qc0, lambda i: not list_contains(pc, i)) as qc from h),
    a as (select r.*, pc, qc, trim(array_to_string(r.cells, ' ')) as tx from rows r join h2 on r.file_id = h2.file_id and r.sheet = h2.sheet where row > header_row),
    b as (select *, {_ls} as k, {fnum('pc')} as u, {fnum('qc')} as qq,
        list_filter(list_transform(cells[1:coalesce(list_min(qc) - 1, len(cells))], lambda c: upper(trim(c))), lambda c: c in ({', '.join("'" + z + "'" for z in R.LOOSE_UNITS)}))[1] as un,
        list_filter(list_transform(range(1, len(cells) + 1), lambda i: case when not list_contains(pc, i) and not list_contains(qc, i) and length(cells[i]) > 3
            and not regexp_matches(cells[i], '^\\d+(\\.\\d+)*$') then trim(cells[i]) end), lambda c: c is not null)[1] as de from a),
    c as (select *, {_ln} as num, {_lt} as tit, k is null and (de is not null or u is not null or qq is not null) as el from b)
    select file_id, sheet, row, case when k is not null then 'section' when el then 'element' else 'ignore' end as type, coalesce(num, '') as numero_section,
      coalesce(tit, '') as titre_section, case when el then coalesce(de, 'Description manquante') else '' end as designation, case when el then coalesce(un, '') else '' end as unite,
      case when k is not null then length(num) - length(replace(num, '.', '')) + 1 else 0 end as niveau,
      case when el then coalesce(qq, -1) else -1 end as quantite, case when el then coalesce(u, -1) else -1 end as prix_unitaire, case when el then coalesce(u * qq, -1) else -1 end as prix_total from c""", "rows")


def merge_sql(compat=False):
    fl = "(?i)" if compat else ""
    go, parts = [], ["text"]
    for k in range(1, 5):
        go.append(f"coalesce(lead(c, {k}) {W}, false)")
        parts.append(f"case when {' and '.join(go)} then lead(text, {k}) {W} end")
    head = "is_element" if compat else "(is_element and not c)"
    eaten = "false" if compat else "(c and coalesce(be, false) and row - br <= 4)"
    bare = "" if compat else "and unit_cell || q_cell || pu_cell || pt_cell = ''"
    return f"""m1 as (select *, coalesce(pattern is null and lag(row) {W} = row - 1 {bare} and regexp_matches(text, '{fl}{R.CONTINUATION}'), false) as c from el),
        m2 as (select *, concat_ws(' ', {', '.join(parts)}) as mt, last_value(case when not c then row end ignore nulls) {W} as br,
            last_value(case when not c then is_element end ignore nulls) {W} as be from m1),
        mg as (select * replace (is_element and not {eaten} as is_element), {head} and mt <> text as multiligne, case when {head} then mt else text end as designation,
            {eaten} as consumed from m2)"""


FULL = f"{HEAD}, {LINES}, {sections_sql('main')}, {score_sql('main')}, {merge_sql()}"
PROF = ["file_id", "sheet", "row", "designation", "multiligne", "consumed", "is_element"]
reg("g30_merge_continuations", lambda t: I.merge_continuations(_scored(t, "main")).select(*PROF), f"with {FULL} select {', '.join(PROF)} from mg", "rows")
reg("g30_merge_continuations_compat", lambda t: I.merge_continuations(_scored(t, "main"), compat=True).select(*PROF),
    f"with {HEAD}, {LINES}, {sections_sql('main')}, {score_sql('main')}, {merge_sql(True)} select {', '.join(PROF)} from mg", "rows")
_isart = "(" + " or ".join(m("w[1]", p) for p in V.ARTICLE_SPLIT) + ")"
BUILD = f"""b1 as (select *, abs(vq) as q0, abs(vu) as u0, abs(vt) as t0 from mg where is_element),
    b2 as (select *, case when q0 = 0 and u0 > 0 and t0 > 0 then t0 / u0 else q0 end as q1, case when u0 = 0 and q0 > 0 and t0 > 0 then t0 / q0 else u0 end as u1,
        case when t0 = 0 and q0 > 0 and u0 > 0 then q0 * u0 else t0 end as t1 from b1),
    b3 as (select *, case when kind = 'forfait' and q1 = 0 then 1.0::double else q1 end as q2, case when kind = 'forfait' and q1 = 0 and t1 > 0 then t1 else u1 end as u2,
        case when kind = 'variable' and not contains(lower(designation), 'variable') then designation || ' (Prix variable)' else designation end as d2 from b2),
    b4 as (select *, case when q2 > 0 and u2 > 0 and t1 > 0 and abs(q2 * u2 - t1) > 0.02 then t1 / q2 else u2 end as u3, {words('d2')} as w from b3),
    b5 as (select *, has_article and {_isart} as sp from b4),
    be as (select file_id, sheet, row, substr(case when sp then array_to_string(w[2:], ' ') else d2 end, 1, 500) as designation,
        case when sp then substr(w[1], 1, 20) else '' end as numero_article, case when unit_cell = '' then '' else substr({unit_sql('unit_cell')}, 1, 10) end as unite,
        round_even(q2 * 10000, 0) / 10000 as quantite, round_even(u3 * 10000, 0) / 10000 as prix_unitaire, round_even(t1 * 100, 0) / 100 as prix_total, kind, multiligne from b5)"""
reg("g29_build_elements", lambda t: I.build_elements(I.merge_continuations(_scored(t, "main")).filter("is_element")), f"with {FULL}, {BUILD} select * from be", "rows")
ATT = f"""ats as (select *, coalesce(last_value(case when pattern is not null then row end ignore nulls) {W}, -1) as section_row,
    coalesce(last_value(numero_section ignore nulls) {W}, '1') as section_numero, coalesce(last_value(titre_section ignore nulls) {W}, 'Éléments du bordereau') as section_titre,
    coalesce(last_value(niveau_hierarchique ignore nulls) {W}, 1) as section_niveau from mg)"""
ITEMS = f"""it as (select file_id, sheet, row, 'element' as type, section_row, section_numero, section_titre, section_niveau from ats where is_element
    union all select file_id, sheet, row, 'section', row, numero_section, titre_section, niveau_hierarchique from ats where pattern is not null
    union all select file_id, sheet, min(row), 'section', -1, '1', 'Éléments du bordereau', 1 from ats where is_element and section_row = -1 group by file_id, sheet)"""
SEL = ["file_id", "sheet", "row", "type", "section_row", "section_numero", "section_titre", "section_niveau"]


def items(t, profile="main"):
    return I.parse_items(t.rows, mapping(t), profile)


reg("g31_attach_sections", lambda t: items(t).select(*SEL), f"with {FULL}, {ATT}, {ITEMS} select {', '.join(SEL)} from it", "rows")
reg("g32_annotate_rows", lambda t: I.annotate_rows(t.rows, G.find_header_row(t.rows), items(t)), f"""with {FULL}, {ATT}, {ITEMS},
    k as (select file_id, sheet, row, max(case type when 'element' then 3 else 2 end) as k from it group by all),
    c as (select r.file_id, r.sheet, r.row, case when r.row = header_row then 1 else coalesce(k, 0) end as code from rows r left join hd on r.file_id = hd.file_id and r.sheet = hd.sheet
      left join k on r.file_id = k.file_id and r.sheet = k.sheet and r.row = k.row)
    select *, ['other', 'header', 'section', 'element'][code + 1] as kind from c""", "rows")
reg("g33_parse_profile", lambda t: I.parse_profile(mapping(t), items(t)), f"""with {FULL}, {ATT}, {ITEMS},
    h as (select file_id, count(*) as headers, max({' + '.join(f'case when {r} is not null then 1 else 0 end' for r in ('designation', 'unite', 'quantite', 'prix_unitaire', 'prix_total'))}) as columns from mp group by 1),
    i as (select file_id, count(*) as items, count(*) filter (where type = 'section') as sections, count(*) filter (where type = 'element') as elements from it group by 1)
    select h.file_id, headers, columns, items, sections, elements from h left join i on h.file_id = i.file_id""", "rows")
_bl = r"""bl as (select file_id, sheet, (row // 20)::int as block, md5(string_agg(regexp_replace(lower(array_to_string(list_filter(cells, lambda c: c <> ''), ' ')), '\s+', '', 'g'), '|' order by row)) as fingerprint
    from rows group by all)"""


def _cache(t):
    return I.text_blocks(t.rows).filter("block = 0").groupBy("fingerprint").agg(F.lit("bordereau").alias("label"))


reg("g34_apply_label_cache", lambda t: I.apply_label_cache(I.text_blocks(t.rows), _cache(t)).fillna("", ["label"]),
    f"with {_bl}, c as (select distinct fingerprint as f from bl where block = 0) select file_id, sheet, block, fingerprint, case when f is null then '' else 'bordereau' end as label, f is not null as hit from bl left join c on fingerprint = f", "rows")
reg("g34_cache_misses", lambda t: I.cache_misses(I.text_blocks(t.rows), _cache(t)),
    f"with {_bl} select distinct fingerprint from bl where fingerprint not in (select fingerprint from bl where block = 0)", "rows")
