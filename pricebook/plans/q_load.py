"""Registered queries: entity resolution and load (H), schema rules (A9)."""

from pyspark.sql import functions as F

from pricebook.operators import grid as G
from pricebook.operators import identify as I
from pricebook.operators import items as T
from pricebook.operators import load as L
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_items import ATT, FULL, mapping
from pricebook.plans.q_relational import dbl
from pricebook.schema import enforce_schema

PLANS = {}


def placed(t):
    """Workbooks with their folder path."""
    return t.workbooks.withColumn("path", F.concat(F.lit("/src/"), F.col("name")))


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def bucket(k):
    return f"cast('0x' || substr(md5({k}), 1, 8) as bigint) % 1024"


def resolve_sql(inc, ex, keys, id_col, payload, order, key_order):
    """Reused and new ids, numbered like the operator does: by hash bucket, then key."""
    on = " and ".join(f"f.{k} = k.{k}" for k in keys)
    kt = " || '|' || ".join(f"{k}::varchar" for k in keys)
    return f"""f as (select {', '.join(keys)}, {', '.join(f'arg_min({p}, {order}) as {p}' for p in payload)} from ({inc}) group by all),
        k as (select {', '.join(keys)}, min({id_col}) as {id_col} from ({ex}) group by all),
        j as (select f.*, k.{id_col} as known from f left join k on {on}),
        r as (select * exclude (known), known as {id_col}, false as created from j where known is not null
          union all select * exclude (known), (select max({id_col}) from ({ex})) + row_number() over (order by {bucket(kt)}, {key_order}), true from j where known is null)"""


def _names(t):
    return t.customer.select(F.lower("c_name").alias("nom_client")).unionByName(t.supplier.select(F.col("s_name").alias("nom_client")))


reg("h01_resolve_clients", lambda t: L.resolve_clients(_names(t), t.clients.filter("nom_client like '%5'")).select("client_key", "nom_client", "id_client", "created"),
    "with " + resolve_sql("select upper(n) as client_key, n as nom_client from (select lower(c_name) as n from customer union all select s_name from supplier)",
                          "select upper(nom_client) as client_key, id_client from clients where nom_client like '%5'", ["client_key"], "id_client", ["nom_client"], "nom_client", "client_key")
    + " select client_key, nom_client, id_client, created from r", "clients")
reg("h02_resolve_dpgf", lambda t: L.resolve_dpgf(t.dpgf.select("id_client", "fichier_source", "nom_projet"), t.dpgf.filter("statut_offre = 'acceptee'"), "2025-07-01")
    .select("id_client", "fichier_source", "nom_projet", "id_dpgf", "created", "statut_offre", F.col("date_dpgf").cast("string").alias("date_dpgf")),
    "with " + resolve_sql("select * from dpgf", "select * from dpgf where statut_offre = 'acceptee'", ["id_client", "fichier_source"], "id_dpgf", ["nom_projet"], "nom_projet", "id_client, fichier_source")
    + " select id_client, fichier_source, nom_projet, id_dpgf, created, 'en_cours' as statut_offre, '2025-07-01' as date_dpgf from r", "dpgf")
_blank = "case when numero_lot = '03' then ' ' else numero_lot end"
_bname = "case when numero_lot in ('03', '04') then '' else nom_lot end"
reg("h03_resolve_lots", lambda t: L.resolve_lots(t.lots.select("id_dpgf", F.expr(_blank).alias("numero_lot"), F.expr(_bname).alias("nom_lot")),
                                                 t.lots.filter("numero_lot in ('01', '04')")).select("id_dpgf", "numero_lot", "nom_lot", "id_lot", "created"),
    "with i as (select id_dpgf, case when n = ' ' then '1' else n end as numero_lot, case when m = '' then 'Lot ' || case when n = ' ' then '1' else n end else m end as nom_lot from "
    f"(select id_dpgf, {_blank} as n, {_bname} as m from lots)), "
    + resolve_sql("select * from i", "select * from lots where numero_lot in ('01', '04')", ["id_dpgf", "numero_lot"], "id_lot", ["nom_lot"], "nom_lot", "id_dpgf, numero_lot")
    + " select id_dpgf, numero_lot, nom_lot, id_lot, created from r", "lots")
reg("h04_resolve_sections", lambda t: L.resolve_sections(
    t.sections.select("id_lot", F.substring("numero_section", 1, 3).alias("numero_section"), "titre_section", "niveau_hierarchique", F.col("id_section").alias("row")),
    t.sections.filter("niveau_hierarchique = 1")).select("id_lot", "numero_section", "titre_section", "niveau_hierarchique", "id_section", "created"),
    "with " + resolve_sql("select id_lot, substr(numero_section, 1, 3) as numero_section, titre_section, niveau_hierarchique, id_section as row from sections",
                          "select * from sections where niveau_hierarchique = 1", ["id_lot", "numero_section"], "id_section",
                          ["titre_section", "niveau_hierarchique"], "(row, titre_section)", "id_lot, numero_section")
    + " select id_lot, numero_section, titre_section, niveau_hierarchique, id_section, created from r", "sections")
reg("h05_load_elements", lambda t: dbl(L.load_elements(t.lines.select(
    F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id_element"), F.lit(1).alias("id_section"), (F.col("l_orderkey") * 10 + F.col("rang")).alias("id_lot"),
    F.col("l_orderkey").alias("id_dpgf"), F.when(F.col("l_returnflag") != "R", F.col("p_name")).alias("designation"), F.concat("unite", F.lit(" par intervention")).alias("unite"),
    F.col("qty").cast("double").alias("quantite"), (F.col("pu_cents") / F.lit(100.0)).alias("prix_unitaire"),
    F.when(F.col("l_linestatus") == "O", 0.0).otherwise(F.col("cents") / F.lit(100.0)).alias("prix_total"))), "quantite", "prix_unitaire_ht", "prix_total_ht"),
    """select concat_ws('-', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar) as id_element, 1 as id_section, l_orderkey * 10 + rang as id_lot, l_orderkey as id_dpgf,
        case when l_returnflag <> 'R' then p_name else 'Description manquante' end as designation_exacte, substr(unite || ' par intervention', 1, 10) as unite, qty::double as quantite,
        pu_cents / 100.0::double as prix_unitaire_ht, case when l_linestatus = 'O' then (pu_cents * qty) / 100.0::double else cents / 100.0::double end as prix_total_ht, false as offre_acceptee from lines""", "lines")


def _stats(t):
    c = L.resolve_clients(_names(t), t.clients.filter("nom_client like '%5'"))
    d = L.resolve_dpgf(t.dpgf.select("id_client", "fichier_source", "nom_projet"), t.dpgf.filter("statut_offre = 'acceptee'"))
    return L.import_stats(t.rows, {"clients": c, "dpgf": d}, t.elements, t.files.filter("size > 4000000"))


reg("h06_import_stats", _stats, """with c as (select distinct upper(n) as k from (select c_name as n from customer union all select s_name from supplier)),
    ck as (select count(*) as n, count(*) filter (where k in (select upper(nom_client) from clients where nom_client like '%5')) as o from c),
    d as (select distinct id_client, fichier_source from dpgf), dk as (select count(*) as n, count(*) filter (where (id_client, fichier_source) in
      (select (id_client, fichier_source) from dpgf where statut_offre = 'acceptee')) as o from d)
    select 'rows' as counter, count(*) as n from rows union all select 'clients_created', n - o from ck union all select 'clients_reused', o from ck
    union all select 'dpgf_created', n - o from dk union all select 'dpgf_reused', o from dk union all select 'elements_created', count(*) from elements
    union all select 'errors', count(*) from files where size > 4000000""", "rows", "clients", "dpgf", "elements", "files")
PLANS["h07_extract_document"] = (lambda t: L.extract_document(t.rows, placed(t))[1].groupBy("file_id", "type").agg(F.count("*").alias("n")), None)
PLANS["h07_extract_facts"] = (lambda t: L.extract_document(t.rows, placed(t))[0], None)


def _schema(t):
    raw = t.files.select(F.col("file_id").alias("id_dpgf"), F.col("file_id").alias("id_client"), F.concat(F.repeat(F.lit("Projet "), 40), F.col("name")).alias("nom_projet"),
                         F.col("modified").cast("date").alias("date_dpgf"), F.when(F.col("file_id") % 3 == 0, "perdue").otherwise("en_cours").alias("statut_offre"),
                         F.when(F.col("size") > 1000000, F.col("name")).alias("fichier_source"))
    good, bad = enforce_schema(raw, "dpgf")
    cols = ["id_dpgf", F.length("nom_projet").alias("n")]
    return good.select(*cols, F.lit("").alias("reason")).unionByName(bad.select(*cols, "reason"))


reg("a09_enforce_schema", _schema, """with r as (select file_id as id_dpgf, concat_ws('; ', case when size <= 1000000 then null end, case when file_id % 3 = 0 then 'statut_offre: unknown status' end,
      case when size <= 1000000 then 'fichier_source: missing or not string' end) as reason, least(255, length(repeat('Projet ', 40) || name)) as n from files)
    select id_dpgf, n, reason from r""", "files")
