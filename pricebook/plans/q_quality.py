"""Registered queries: data quality (D10-D14)."""

from pyspark.sql import functions as F

from pricebook.operators import quality as Q
from pricebook.plans.fixtures import oracle

PLANS = {}
V = ("dpgf", "lots", "sections", "elements")


def args(t):
    return t.dpgf, t.lots, t.sections, t.elements


CTE = """
    le as (select l.id_lot, id_dpgf, numero_lot, count(id_element) as ne, count(*) filter (where id_element is not null and id_section is null) as no
           from lots l left join elements e on l.id_lot = e.id_lot group by all),
    ls as (select id_lot, count(*) as ns from sections group by 1),
    lc as (select le.*, coalesce(ns, 0) as ns from le left join ls on le.id_lot = ls.id_lot),
    dc as (select d.id_dpgf, nom_projet, id_client, count(id_lot) as nl, coalesce(sum(ne), 0) as ne, coalesce(sum(ns), 0) as ns
           from dpgf d left join lc on d.id_dpgf = lc.id_dpgf group by all),
    iss as (
      select id_dpgf, null::bigint as id_lot, null::bigint as id_section, 'dpgf_sans_lots' as type, 'high' as severity, 'DPGF sans aucun lot' as description from dc where nl = 0
      union all select id_dpgf, null, null, 'dpgf_avec_lots_vides', 'high', 'DPGF avec ' || nl || ' lots mais aucun élément d''ouvrage' from dc where nl > 0 and ne = 0
      union all select id_dpgf, id_lot, null, 'lot_sans_sections', 'medium', 'Lot sans aucune section' from lc where ns = 0
      union all select id_dpgf, id_lot, null, 'lot_sans_elements', 'high', 'Lot sans aucun élément d''ouvrage' from lc where ne = 0
      union all select id_dpgf, id_lot, null, 'elements_sans_section', 'low', no || ' éléments sans section assignée' from lc where no > 0
      union all select id_dpgf, l.id_lot, id_section, 'section_sans_elements', 'medium', 'Section ''' || titre_section || ''' sans aucun élément d''ouvrage'
        from sections s join lots l on s.id_lot = l.id_lot where id_section not in (select id_section from elements where id_section is not null))"""

PLANS["d10_quality_issues"] = (
    lambda t: Q.quality_issues(*args(t)).fillna(-1, ["id_lot", "id_section"]),
    oracle(f"with {CTE} select id_dpgf, coalesce(id_lot, -1) as id_lot, coalesce(id_section, -1) as id_section, type, severity, description from iss", *V))
PLANS["d11_quality_summary"] = (
    lambda t: Q.quality_summary(*args(t)),
    oracle(f"""with {CTE} select count(*) as total_dpgfs, sum(nl)::bigint as total_lots, sum(ns)::bigint as total_sections, sum(ne)::bigint as total_elements,
        {', '.join(f"(select count(*) from iss where type = '{k}') as {k}" for k in Q.SEVERITY)} from dc""", *V))
PLANS["d12_quality_ratios"] = (
    lambda t: Q.quality_ratios(*args(t)),
    oracle(f"""with {CTE} select sum(nl)::double / count(*) as avg_lots_per_dpgf, sum(ns)::double / sum(nl) as avg_sections_per_lot,
        sum(ne)::double / sum(nl) as avg_elements_per_lot,
        ((select count(distinct id_dpgf) from iss) * 100.0)::double / count(*)::double as dpgfs_with_problems_percentage from dc""", *V))
PLANS["d13_quality_classes"] = (
    lambda t: Q.quality_classes(Q.quality_issues(*args(t)), t.dpgf),
    oracle(f"""with {CTE}, n as (select id_dpgf, count(*) as n from iss group by 1)
        select case when n is null then 'excellent' when n <= 2 then 'bon' when n <= 5 then 'moyen' else 'mauvais' end as classe, count(*) as documents
        from dc left join n on dc.id_dpgf = n.id_dpgf group by 1""", *V))
PLANS["d14_quality_report"] = (
    lambda t: Q.quality_report(*args(t), t.clients).withColumn("problems", F.array_join(F.transform("problems", lambda p: F.concat_ws(
        ":", p["id_lot"].cast("string"), p["type"], p["id_section"].cast("string"))), ",")),
    oracle(f"""with {CTE} select dc.id_dpgf, nom_projet, dc.id_client, nom_client, nl as n_lots, ns::bigint as n_sections, ne::bigint as n_elements,
        count(distinct id_lot) as problematic_lots, 0 as part,
        string_agg(coalesce(id_lot, 0) || ':' || type || ':' || coalesce(id_section, 0), ',' order by coalesce(id_lot, 0), type, coalesce(id_section, 0)) as problems
        from dc join iss on dc.id_dpgf = iss.id_dpgf left join clients c on dc.id_client = c.id_client group by all""", *V, "clients"))
