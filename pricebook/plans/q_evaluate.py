"""Registered queries: evaluation of detectors (J)."""

from pyspark.sql import functions as F

from pricebook.operators import evaluate as E
from pricebook.operators import grid as G
from pricebook.operators.scale import staged
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_grid import header_sql, m
from pricebook.plans.q_items import ATT, BUILD, FULL, ITEMS, items

PLANS = {}


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def _files(t):
    """Workbooks, and the order files under their own numbers with the lot wording cut from some."""
    other = t.files.select((F.col("file_id") + 1000000).alias("file_id"), F.when(F.col("file_id") % 3 == 0, F.replace("name", F.lit("Lot"), F.lit("Tranche"))).otherwise(F.col("name")).alias("name"))
    return t.workbooks.select("file_id", "name").unionByName(other)


FILES = "fl as (select file_id, name from workbooks union all select file_id + 1000000, case when file_id % 3 = 0 then replace(name, 'Lot', 'Tranche') else name end from files)"
_u = "case " + " ".join(f"when {m('st', p)} then 'filename:{n}'" for n, p in E.LOT_USED) + " end"
EV = f"""{FILES}, ct as (select distinct file_id from rows where row < 10 and len(list_filter(cells[1:5], lambda c: regexp_matches(lower(c), 'lot\\s*\\d+'))) > 0),
    ev as (select fs.file_id, name, st, coalesce({_u}, case when ct.file_id is not null then 'content' end) as pattern
      from (select *, regexp_replace(name, '\\.[^.]*$', '') as st from fl) fs left join ct on fs.file_id = ct.file_id)"""
JOIN = "array_to_string(list_filter(cells, lambda c: c <> ''), ' ')"
ML = f"""ml as (select file_id, 'filename' as type, st as text from ev where pattern is null or pattern = 'content' union all
    select file_id, 'content', {JOIN} from rows where row < 20 and file_id in (select file_id from ev where pattern is null) and regexp_matches(lower({JOIN}), 'lot|devis|dpgf'))"""
_s = "case " + " ".join(f"when {m('text', p, '')} then '{n}'" for n, p in E.SECTION_USED) + " end"
ES = f"""sr as (select distinct file_id, sheet, row from it where type = 'section'), es as (select *, {_s} as pattern from
    (select r.file_id, r.sheet, r.row, {JOIN.replace('cells', 'r.cells')} as text from rows r join sr on r.file_id = sr.file_id and r.sheet = sr.sheet and r.row = sr.row))"""
MS = rf"""ms as (select file_id, sheet, row, text from (select r.file_id, r.sheet, r.row, {JOIN.replace('cells', 'r.cells')} as text from rows r join hd on r.file_id = hd.file_id and r.sheet = hd.sheet
      left join sr on r.file_id = sr.file_id and r.sheet = sr.sheet and r.row = sr.row where r.row > header_row and r.row <= header_row + 30 and sr.row is null)
    where length(text) > 5 and ((upper(text) = text and lower(text) <> text) or regexp_matches(text, '^\s*\d+\.\d+') or regexp_matches(text, '^\s*[A-Z]\s*[-\.]\s+') or regexp_matches(text, '^\s*[IVX]{{1,4}}\s*[-\.]\s+')))"""


def _weaker(it):
    return it.filter("pattern is null or pattern like 'numbered%'")


def _loose(t):
    """A weaker parse whose sections are the numbered ones only, so that some rows are missed."""
    return _weaker(items(t))


def _compared(t):
    """The parse, run once and written with the columns compared, against the weaker one."""
    it = staged(items(t).select("file_id", "sheet", "row", "type", "pattern", "prix_total"), "parsed")
    return E.compare_profiles(it, _weaker(it))


LOOSE = "it0 as ({}), it as (select * exclude (pattern) from it0 where type = 'element' or pattern like 'numbered%')"
ITP = """select file_id, sheet, row, 'element' as type, null as pattern from ats where is_element union all select file_id, sheet, row, 'section', pattern from ats where pattern is not null
    union all select file_id, sheet, min(row), 'section', 'default' from ats where is_element and section_row = -1 group by file_id, sheet"""
L = LOOSE.format(ITP)
reg("j01_evaluate_lots", lambda t: E.evaluate_lots(_files(t), t.rows).fillna("", ["pattern"]), f"with {EV} select file_id, name, coalesce(pattern, '') as pattern from ev", "rows", "workbooks", "files")
reg("j01_missed_lots", lambda t: E.missed_lots(_files(t), t.rows, E.evaluate_lots(_files(t), t.rows)), f"with {EV}, {ML} select * from ml", "rows", "workbooks", "files")
reg("j02_evaluate_sections", lambda t: E.evaluate_sections(items(t), t.rows).fillna("", ["pattern"]),
    f"with {FULL}, {ATT}, {ITEMS}, {ES} select file_id, sheet, row, text, coalesce(pattern, '') as pattern from es", "rows")
reg("j03_missed_sections", lambda t: E.missed_sections(t.rows, G.find_header_row(t.rows), _loose(t)),
    f"with {FULL}, {ATT}, {L}, {ES}, {MS} select * from ms", "rows")
reg("j04_evaluation_summary", lambda t: E.evaluation_summary(E.evaluate_lots(_files(t), t.rows), E.evaluate_sections(_loose(t), t.rows), E.missed_sections(t.rows, G.find_header_row(t.rows), _loose(t))),
    f"""with {FULL}, {ATT}, {L}, {ES}, {MS}, {EV}, u as (select 'lot' as detector, pattern from ev union all select 'section', pattern from es union all select 'section', null from ms),
    tt as (select detector, count(*) as total, count(pattern) as found from u group by 1)
    select u.detector, coalesce(pattern, '(aucun)') as pattern, count(*) as n, total, found, found / total as success_rate from u join tt on u.detector = tt.detector group by all""", "rows", "workbooks", "files")


def _missed(t):
    """Missed lot names, and the document lines as section candidates."""
    ml = E.missed_lots(_files(t), t.rows, E.evaluate_lots(_files(t), t.rows)).select("type", "text")
    odd = t.workbooks.select(F.lit("filename").alias("type"), F.concat(F.lit("lot n° "), "file_id", F.lit(" "), "name").alias("text"))
    sec = t.cells.select(F.lit("potential_section").alias("type"), F.concat(F.lit("brand."), F.col("row"), F.lit(" "), "text").alias("text"))
    return ml.unionByName(odd).unionByName(sec)


_low = "case when type = 'potential_section' then text else lower(text) end"
_i = "case " + " ".join(f"when type = '{k}' and regexp_matches({_low}, '{p}') then {i}" for i, (k, p, _, _) in enumerate(E.SUGGESTIONS)) + " end"
_tab = " union all ".join(f"select {i} as i, '{'section' if k == 'potential_section' else k}' as type, '{s}' as pattern, '{d}' as description" for i, (k, _, s, d) in enumerate(E.SUGGESTIONS))
SG = f"""{EV}, {ML}, mm as (select type, text from ml union all select 'filename', 'lot n° ' || file_id || ' ' || name from workbooks union all select 'potential_section', 'brand.' || row || ' ' || text from cells),
    si as (select i, min(text) as example, count(*) as n from (select *, {_i} as i from mm) where i is not null group by 1), sg as (select tb.type, pattern, description, example, n from si join ({_tab}) tb on si.i = tb.i)"""
reg("j05_suggest_patterns", lambda t: E.suggest_patterns(_missed(t)), f"with {SG} select * from sg", "rows", "workbooks", "files", "cells")


def _patterns(t):
    return E.suggest_patterns(_missed(t).filter("type = 'filename'")).select("type", "pattern", F.lit("connu").alias("description"))


reg("j06_merge_patterns", lambda t: E.merge_patterns(_patterns(t), E.suggest_patterns(_missed(t))),
    f"with {SG} select type, pattern, case when type = 'filename' then 'connu' else description end as description from sg", "rows", "workbooks", "files", "cells")
reg("j07_compare_profiles", _compared, f"""with {FULL}, {ATT}, {BUILD}, a0 as ({ITP}),
    a as (select a0.*, coalesce(be.prix_total, 0)::decimal(18,2) as tot from a0 left join be on a0.type = 'element' and be.file_id = a0.file_id and be.sheet = a0.sheet and be.row = a0.row),
    b as (select * from a where type = 'element' or pattern like 'numbered%'),
    sa as (select file_id, sheet, row, max(type) as ty, count(*) filter (where type = 'section') as s, count(*) filter (where type = 'element') as e, sum(tot) as t from a group by all),
    sb as (select file_id, sheet, row, max(type) as ty, count(*) filter (where type = 'section') as s, count(*) filter (where type = 'element') as e, sum(tot) as t from b group by all)
    select sa.file_id, sum(sa.s)::bigint as sections_a, sum(sa.e)::bigint as elements_a, coalesce(sum(sb.s), 0)::bigint as sections_b, coalesce(sum(sb.e), 0)::bigint as elements_b,
      sum(sa.t)::double as total_a, coalesce(sum(sb.t), 0)::double as total_b, count(*) filter (where sa.ty is distinct from sb.ty) as differences
    from sa left join sb on sa.file_id = sb.file_id and sa.sheet = sb.sheet and sa.row = sb.row group by 1""", "rows")
