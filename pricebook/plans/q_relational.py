"""Registered queries: relational reads (B) and entity scans (A12)."""

from pyspark.sql import functions as F

from pricebook.operators import pages
from pricebook.operators import relational as R
from pricebook.operators.scale import scratch_path
from pricebook.plans.fixtures import oracle

PLANS = {}
BUCKET = "cast('0x' || substr(md5({k}), 1, 8) as bigint) % 1024"
E_COLS = ["id_element", "designation_exacte", "unite"]


def dbl(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


def flat(t):
    return R.elements_flat(t.elements, t.lots, t.sections, t.dpgf, t.clients)


PLANS["a12_scan"] = (
    lambda t: dbl(t.elements, "quantite", "prix_unitaire_ht", "prix_total_ht")
    .withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))
    .withColumn("id_section", F.coalesce("id_section", F.lit(-1).cast("bigint"))),
    oracle("""select id_element, coalesce(id_section, -1) as id_section, id_lot, designation_exacte, description, unite,
              quantite::double as quantite, prix_unitaire_ht::double as prix_unitaire_ht,
              prix_total_ht::double as prix_total_ht, offre_acceptee,
              strftime(created_at, '%Y-%m-%d') as created_at from elements""", "elements"))


def _by_id(t):
    out = None
    for name, key in (("clients", "id_client"), ("dpgf", "id_dpgf"), ("lots", "id_lot"), ("sections", "id_section")):
        df = getattr(t, name)
        v = {"id_client": 7, "id_dpgf": 7, "id_lot": 71, "id_section": 7100}[key]
        row = R.get_by_id(df, key, v).select(F.lit(name).alias("entity"), F.col(key).cast("bigint").alias("id"),
                                             F.col(df.columns[1]).cast("string").alias("second"))
        out = row if out is None else out.unionByName(row)
    return out


PLANS["b01_get_by_id"] = (_by_id, oracle("""
    select 'clients' as entity, id_client as id, nom_client as second from clients where id_client = 7
    union all select 'dpgf', id_dpgf, id_client::varchar from dpgf where id_dpgf = 7
    union all select 'lots', id_lot, id_dpgf::varchar from lots where id_lot = 71
    union all select 'sections', id_section, id_lot::varchar from sections where id_section = 7100""",
    "clients", "dpgf", "lots", "sections"))
PLANS["b02_page"] = (
    lambda t: R.page(t.elements, ["id_element"], 200, 100).select(*E_COLS),
    oracle("select id_element, designation_exacte, unite from elements order by id_element limit 100 offset 200", "elements"))


def _deep_page(t, skip, limit):
    """Page of the price order from its stored index, far from the start."""
    order = [F.desc("prix_unitaire_ht"), F.asc("id_element")]
    path = scratch_path(t.spark, "order-index")
    pages.write_order_index(t.elements, path, order)
    return pages.page_at(t.spark, path, order, skip, limit).select("id_element", "designation_exacte", "unite")


PLANS["b02_page_at"] = (
    lambda t: _deep_page(t, 5000, 100),
    oracle("select id_element, designation_exacte, unite from elements order by prix_unitaire_ht desc nulls last, id_element limit 100 offset 5000", "elements"))
PLANS["b03_insert_rows"] = (
    lambda t: R.insert_rows(t.clients, t.supplier.select(F.col("s_name").alias("nom_client")), "id_client", ["nom_client"]),
    oracle(f"""select id_client, nom_client from clients union all
        select (select max(id_client) from clients) + row_number() over (order by {BUCKET.format(k='s_name')}, s_name), s_name
        from supplier""", "clients"))
PLANS["b04_delete_rows"] = (
    lambda t: R.delete_rows(t.clients, t.dpgf.filter("statut_offre = 'refusee'").select("id_client").distinct(), "id_client"),
    oracle("select * from clients where id_client not in (select id_client from dpgf where statut_offre = 'refusee')",
           "clients", "dpgf"))
S_COLS = "id_section, id_lot, numero_section, titre_section, niveau_hierarchique"
PLANS["b05_sections_by_lot"] = (
    lambda t: R.sections_by_lot(t.sections, 71).select(*S_COLS.split(", ")),
    oracle(f"select {S_COLS} from sections where id_lot = 71", "sections"))
PLANS["b06_sections_by_dpgf"] = (
    lambda t: R.sections_by_dpgf(t.sections, t.lots).select(*S_COLS.split(", "), "id_dpgf", "numero_lot"),
    oracle("""select s.id_section, s.id_lot, numero_section, titre_section, niveau_hierarchique, id_dpgf, numero_lot
        from sections s join lots l on s.id_lot = l.id_lot""", "sections", "lots"))
PLANS["b07_sections_with_hierarchy"] = (
    lambda t: R.sections_with_hierarchy(t.sections, t.lots, t.dpgf)
    .select("id_section", "numero_section", "numero_lot", "nom_lot", "id_dpgf", "nom_projet", "id_client"),
    oracle("""select id_section, numero_section, numero_lot, nom_lot, d.id_dpgf, nom_projet, id_client
        from sections s left join lots l on s.id_lot = l.id_lot left join dpgf d on l.id_dpgf = d.id_dpgf""",
           "sections", "lots", "dpgf"))
PLANS["b08_elements_with_section"] = (
    lambda t: R.elements_with_section(t.elements, t.sections).select(*E_COLS, "id_section", "numero_section", "titre_section"),
    oracle("""select id_element, designation_exacte, unite, s.id_section, numero_section, titre_section
        from elements e join sections s on e.id_section = s.id_section""", "elements", "sections"))
PLANS["b09_elements_with_hierarchy"] = (
    lambda t: R.elements_with_hierarchy(t.elements, t.sections, t.lots, t.dpgf)
    .select(*E_COLS, "numero_section", "numero_lot", "id_dpgf", "nom_projet"),
    oracle("""select id_element, designation_exacte, unite, numero_section, numero_lot, d.id_dpgf, nom_projet
        from elements e join sections s on e.id_section = s.id_section join lots l on s.id_lot = l.id_lot
        join dpgf d on l.id_dpgf = d.id_dpgf""", "elements", "sections", "lots", "dpgf"))


def _by(t):
    a = R.elements_by(t.elements, t.sections, t.lots, section_id=7101).select("id_element", F.lit("section").alias("par"))
    b = R.elements_by(t.elements, t.sections, t.lots, lot_id=71).select("id_element", F.lit("lot").alias("par"))
    c = R.elements_by(t.elements, t.sections, t.lots).select("id_element", F.lit("dpgf").alias("par"))
    return a.unionByName(b).unionByName(c)


PLANS["b10_elements_by"] = (_by, oracle("""
    with j as (select id_element, s.id_section, s.id_lot, id_dpgf from elements e join sections s on e.id_section = s.id_section
               join lots l on s.id_lot = l.id_lot)
    select id_element, 'section' as par from j where id_section = 7101
    union all select id_element, 'lot' from j where id_lot = 71
    union all select id_element, 'dpgf' from j""", "elements", "sections", "lots"))
PLANS["b11_sections_with_element_count"] = (
    lambda t: R.sections_with_element_count(t.sections, t.elements).select("id_section", "numero_section", "elements_count"),
    oracle("""select s.id_section, any_value(numero_section) as numero_section, count(id_element) as elements_count
        from sections s left join elements e on s.id_section = e.id_section group by s.id_section""", "sections", "elements"))
PLANS["b12_section_tree"] = (
    lambda t: R.section_tree(t.sections, t.lots).select("id_dpgf", "id_section", "depth", "sort_path", "children", "is_orphan"),
    oracle("""with recursive s as (select s.*, id_dpgf from sections s join lots l on s.id_lot = l.id_lot),
        tr as (select id_dpgf, id_section, 1 as depth, numero_section as sort_path from s where section_parent_id is null
               union all select s.id_dpgf, s.id_section, tr.depth + 1, tr.sort_path || '/' || s.numero_section
               from s join tr on s.section_parent_id = tr.id_section),
        k as (select section_parent_id as p, count(*) as children from s group by 1)
        select id_dpgf, id_section, depth, sort_path, coalesce(children, 0) as children, false as is_orphan
        from tr left join k on p = id_section""", "sections", "lots"))
PLANS["b13_section_path"] = (
    lambda t: R.section_path(t.sections),
    oracle("""with recursive tr as (select id_section, titre_section as chemin from sections where section_parent_id is null
        union all select s.id_section, chemin || ' → ' || titre_section from sections s join tr on s.section_parent_id = tr.id_section)
        select id_section, chemin, true as complete from tr""", "sections"))
_DEEP = """with recursive t as (select s.*, s.section_parent_id is not null and p.id_section is null as lost
          from deep_sections s left join (select id_section from deep_sections) p on p.id_section = s.section_parent_id),
        tr as (select id_section, 1 as depth, numero_section as sort_path, titre_section as chemin, lost from t where section_parent_id is null or lost
          union all select t.id_section, depth + 1, sort_path || '/' || numero_section, chemin || ' → ' || titre_section, tr.lost
          from t join tr on t.section_parent_id = tr.id_section),
        al as (select id_section, depth, sort_path, chemin, lost, false as in_cycle from tr
          union all select id_section, 1, numero_section, titre_section, false, true from t where id_section not in (select id_section from tr))"""
PLANS["b12_section_tree_deep"] = (
    lambda t: R.section_tree(t.deep_sections, t.lots.limit(1).withColumn("id_lot", F.lit(1).cast("bigint"))).select(
        "id_section", "depth", "sort_path", "children", "is_orphan", "in_cycle"),
    oracle(f"""{_DEEP}, k as (select section_parent_id as p, count(*) as children from deep_sections group by 1)
        select id_section, depth, sort_path, coalesce(children, 0) as children, lost as is_orphan, in_cycle
        from al left join k on p = id_section""", "deep_sections"))
PLANS["b13_section_path_deep"] = (
    lambda t: R.section_path(t.deep_sections),
    oracle(f"{_DEEP} select id_section, chemin, not lost and not in_cycle as complete from al", "deep_sections"))
PLANS["b14_dpgf_structure"] = (
    lambda t: R.dpgf_structure(t.dpgf, t.lots, t.sections, t.elements).select(
        "id_dpgf", F.coalesce("numero_lot", F.lit("")).alias("numero_lot"),
        F.coalesce("numero_section", F.lit("")).alias("numero_section"), "part",
        F.coalesce(F.array_join(F.transform("elements", lambda e: F.concat_ws(
            ":", e["id_element"].cast("string"), e["designation_exacte"], e["unite"])), ","), F.lit("")).alias("contenu")),
    oracle("""select d.id_dpgf, coalesce(numero_lot, '') as numero_lot, coalesce(numero_section, '') as numero_section, 0 as part,
        coalesce(string_agg(id_element || ':' || designation_exacte || ':' || unite, ',' order by id_element), '') as contenu
        from dpgf d left join lots l on d.id_dpgf = l.id_dpgf left join sections s on l.id_lot = s.id_lot
        left join elements e on e.id_section = s.id_section
        group by d.id_dpgf, l.id_lot, numero_lot, s.id_section, numero_section""", "dpgf", "lots", "sections", "elements"))
FLAT_COLS = ["id_element", "id_dpgf", "id_client", "numero_lot", "nom_lot", "designation", "nom_projet", "nom_client", "prix_total"]
PLANS["b15_elements_flat"] = (
    lambda t: dbl(flat(t).select(*FLAT_COLS, F.coalesce("numero_section", F.lit("")).alias("numero_section")), "prix_total"),
    oracle(f"""select {', '.join(FLAT_COLS[:-1])}, prix_total::double as prix_total,
        coalesce(numero_section, '') as numero_section from elements_flat""", "elements_flat"))
