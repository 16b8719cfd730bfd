"""Registered queries: corrections (I)."""

from pyspark.sql import functions as F

from pricebook.operators import correct as C
from pricebook.operators import grid as G
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_grid import lot_name_sql
from pricebook.plans.q_load import bucket, placed

PLANS = {}
V = ("dpgf", "lots", "sections", "elements")


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


LI = """li as (select d.id_dpgf, nom_projet, fichier_source, count(id_lot) as lots from dpgf d left join lots l on d.id_dpgf = l.id_dpgf group by all
    having count(id_lot) = 0 or (count(id_lot) = 1 and max(numero_lot) = '00'))"""
SI = """ec as (select id_lot, count(*) as o from elements where id_section is null group by 1), scn as (select id_lot, count(*) as n, max(numero_section) as m from sections group by 1),
    si as (select l.id_dpgf, l.id_lot, numero_lot, coalesce(n, 0) as sections_count, coalesce(o, 0) as elements_sans_section from lots l left join ec on l.id_lot = ec.id_lot
      left join scn on l.id_lot = scn.id_lot where coalesce(o, 0) > 0 or coalesce(n, 0) = 0 or (n = 1 and m = '00'))"""
reg("i01_lot_issues", lambda t: C.lot_issues(t.dpgf, t.lots), f"with {LI} select * from li", *V)
reg("i02_section_issues", lambda t: C.section_issues(t.lots, t.sections, t.elements), f"with {SI} select * from si", *V)


def _redetected(t):
    """Lots read again from the file names of the flagged documents."""
    docs = C.lot_issues(t.dpgf, t.lots).select(F.col("id_dpgf").alias("file_id"), F.col("fichier_source").alias("name"))
    return G.lot_from_filename(docs).filter("numero_lot is not null").select(F.col("file_id").alias("id_dpgf"), "numero_lot", "nom_lot")


RED = f"{LI}, src as (select id_dpgf as file_id, fichier_source as name from li), {lot_name_sql('main', 'src')}, red as (select file_id as id_dpgf, numero_lot, nom_lot from lf_main where numero_lot is not null)"
CL = f"""{RED}, fr as (select * from red where (id_dpgf, numero_lot) not in (select (id_dpgf, numero_lot) from lots)),
    nw as (select (select max(id_lot) from lots) + row_number() over (order by {bucket("id_dpgf::varchar || '|' || numero_lot")}, id_dpgf, numero_lot) as id_lot, id_dpgf, numero_lot, nom_lot from fr),
    sg as (select id_dpgf from red group by 1 having count(*) = 1),
    mv as (select l.id_lot, nw.id_lot as to_lot from lots l join nw on l.id_dpgf = nw.id_dpgf where l.numero_lot = '00' and l.id_dpgf in (select id_dpgf from sg)),
    cl as (select l.id_lot, l.id_dpgf, l.numero_lot, coalesce(red.nom_lot, l.nom_lot) as nom_lot from lots l left join red on l.id_dpgf = red.id_dpgf and l.numero_lot = red.numero_lot
      where l.id_lot not in (select id_lot from mv) union all select * from nw)"""
reg("i03_correct_lots", lambda t: C.correct_lots(t.lots, t.sections, t.elements, _redetected(t))[0], f"with {CL} select * from cl", *V)


def _resections(t):
    """Sections read again for the flagged lots: a known one and a new one."""
    flagged = C.section_issues(t.lots, t.sections, t.elements).select("id_lot")
    known = t.sections.filter("niveau_hierarchique = 1").join(flagged, "id_lot", "left_semi").select("id_lot", "numero_section", "titre_section", "niveau_hierarchique")
    return known.unionByName(flagged.select("id_lot", F.lit("9.9").alias("numero_section"), F.lit("Divers").alias("titre_section"), F.lit(2).alias("niveau_hierarchique")))


def _elements(t):
    return t.elements


RS = f"""{SI}, rs as (select id_lot, numero_section, titre_section, niveau_hierarchique from sections where niveau_hierarchique = 1 and id_lot in (select id_lot from si)
      union all select id_lot, '9.9', 'Divers', 2 from si),
    fs as (select * from rs where (id_lot, numero_section, titre_section) not in (select (id_lot, numero_section, titre_section) from sections)),
    ns as (select (select max(id_section) from sections) + row_number() over (order by {bucket("id_lot::varchar || '|' || numero_section || '|' || titre_section")}, id_lot, numero_section, titre_section) as id_section, * from fs),
    al as (select id_section, id_lot, numero_section, titre_section from sections union all select id_section, id_lot, numero_section, titre_section from ns),
    f1 as (select id_lot, min(id_section) as f from al where id_lot in (select id_lot from rs) group by 1),
    em as (select id_element, e.id_lot, case when id_section is null and f is not null then f else id_section end as id_section, id_section is null and f is not null as moved
      from elements e left join f1 on e.id_lot = f1.id_lot)"""
reg("i04_correct_sections", lambda t: C.correct_sections(t.sections, t.elements, _resections(t))[0].select("id_section", "id_lot", "numero_section", "titre_section"),
    f"with {RS} select * from al", *V)
reg("i04_correct_sections_elements", lambda t: C.correct_sections(t.sections, t.elements, _resections(t))[1].select("id_element", "id_lot", F.coalesce("id_section", F.lit(-1).cast("bigint")).alias("id_section")),
    f"with {RS} select id_element, id_lot, coalesce(id_section, -1) as id_section from em", *V)


def _log(t):
    s, e, moved = C.correct_sections(t.sections, t.elements, _resections(t))
    return C.correction_log(t.sections, s, moved, "id_lot")


reg("i05_correction_log", _log, f"""with {RS}, b as (select id_lot, count(*) as n from sections group by 1), a as (select id_lot, count(*) as n from al group by 1),
    m as (select id_lot, count(*) as n from em where moved group by 1)
    select a.id_lot, coalesce(b.n, 0) as before, a.n as after, coalesce(m.n, 0) as moved from a left join b on a.id_lot = b.id_lot left join m on a.id_lot = m.id_lot
    where coalesce(b.n, 0) <> a.n or coalesce(m.n, 0) > 0""", *V)
PLANS["i06_redetect_lots"] = (lambda t: C.redetect(t.workbooks.filter("name like 'BPU%'"), placed(t), t.rows)[0], None)
PLANS["i06_redetect_sections"] = (lambda t: C.redetect(t.workbooks.filter("name like 'BPU%'"), placed(t), t.rows)[1], None)
