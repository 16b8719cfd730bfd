"""Registered queries: search and matching (C)."""

from pyspark.sql import functions as F

from pricebook.functions import text as T
from pricebook.operators import relational as R
from pricebook.operators import search as S
from pricebook.operators import text_index as X
from pricebook.operators.scale import scratch_path, staged
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_relational import dbl, flat

PLANS = {}
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tok_sql(e):
    return (f"list_filter(string_split_regex(regexp_replace(lower(coalesce({e}, '')), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +'), "
            f"lambda t: length(t) > 1 and t not in ({STOPS}))")


def has_sql(c, t):
    return f"coalesce(contains(lower({c}), '{t}'), false)"


def rel_sql(terms):
    return " + ".join(f"(case when {has_sql(c, t)} then {w} else 0 end)" for t in terms for c, w in S.WEIGHTS)


def any_sql(t):
    return "(" + " or ".join(has_sql(c, t) for c, _ in S.WEIGHTS) + ")"


def tri_sql(e):
    return (f"list_distinct(flatten(list_transform(list_transform(list_filter(string_split_regex(regexp_replace(lower({e}), "
            f"'[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: '  ' || w || ' '), "
            f"lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))")


def sim_sql(a, b):
    a, b = tri_sql(a), tri_sql(b)
    inter = f"len(list_intersect({a}, {b}))"
    return f"({inter}::double / (len({a}) + len({b}) - {inter}))"


PLANS["c01_tokenize"] = (
    lambda t: t.documents.select("doc_id", F.explode(T.tokenize("text")).alias("token")).groupBy("doc_id", "token")
    .agg(F.count("*").alias("n")),
    f"select doc_id, token, count(*) as n from (select doc_id, unnest({tok_sql('text')}) as token from documents) group by 1, 2")


def texts(t):
    return t.elements.select(F.col("designation_exacte").alias("designation"))


PLANS["c02_apply_filters"] = (
    lambda t: S.apply_filters(flat(t), lot_numero="03", min_price=100, max_price=5000).select("id_element"),
    oracle("select id_element from elements_flat where numero_lot = '03' and prix_unitaire between 100 and 5000", "elements_flat"))
PLANS["c03_text_condition"] = (
    lambda t: flat(t).filter(S.text_condition(["red", "brand#1"])).select("id_element"),
    oracle(f"select id_element from elements_flat where {any_sql('red')} and {any_sql('brand#1')}", "elements_flat"))
PLANS["c04_relevance"] = (
    lambda t: flat(t).select("id_element", S.relevance(["red", "economy", "brand"]).alias("score")).filter("score > 0"),
    oracle(f"select * from (select id_element, {rel_sql(['red', 'economy', 'brand'])} as score from elements_flat) where score > 0", "elements_flat"))


def _sorts(t):
    keys = [c for mode in ("price", "date", "designation", "dpgf", "lot", "section") for c in S.SORTS[mode]]
    out, f = None, staged(flat(t).select("id_element", *dict.fromkeys(keys + ["designation"])), "sort-keys")    # read by every order
    for mode in ("price", "date", "designation", "dpgf", "lot", "section"):
        top = S.apply_sort(f, mode, mode in ("price", "date")).limit(50).select(F.lit(mode).alias("mode"), "id_element")
        out = top if out is None else out.unionByName(top)
    return out


def _sort_sql():
    parts = []
    for mode in ("price", "date", "designation", "dpgf", "lot", "section"):
        keys = [f"{k} {'desc nulls last' if mode in ('price', 'date') else 'asc nulls first'}" for k in S.SORTS[mode]]
        if mode != "designation":
            keys.append("designation")
        parts.append(f"(select '{mode}' as mode, id_element from elements_flat order by {', '.join(keys)}, id_element limit 50)")
    return " union all ".join(parts)


PLANS["c05_apply_sort"] = (_sorts, oracle(_sort_sql(), "elements_flat"))
PLANS["c06_designation_hits"] = (
    lambda t: flat(t).groupBy(S.designation_hits(["red", "ring", "bolt"]).alias("hits")).agg(F.count("*").alias("n")),
    oracle(f"select {' + '.join('(case when ' + has_sql('designation', x) + ' then 1 else 0 end)' for x in ('red', 'ring', 'bolt'))} as hits, count(*) as n from elements_flat group by 1", "elements_flat"))
PLANS["c07_search_elements"] = (
    lambda t: dbl(S.search_elements(flat(t), "red widget", limit=100, min_price=1000, max_price=2000)[0]
                  .select("id_element", "designation", "prix_unitaire", "relevance_score", "nom_client", "nom_projet"), "prix_unitaire"),
    oracle(f"""select id_element, designation, prix_unitaire::double as prix_unitaire, {rel_sql(['red', 'widget'])} as relevance_score,
        nom_client, nom_projet from elements_flat where {any_sql('red')} and {any_sql('widget')} and prix_unitaire between 1000 and 2000
        order by relevance_score desc, designation, id_element limit 100""", "elements_flat"))
def accented(t):
    """The flat view with accents in its designations."""
    return flat(t).withColumn("designation", F.translate("designation", "eo", "éö"))


_PLAIN = "strip_accents(lower(translate(designation, 'eo', 'éö')))"
PLANS["c07_search_elements_ci_ai"] = (
    lambda t: S.search_elements(accented(t), "RÉD widget", limit=100, collation=T.CI_AI)[0].select("id_element", "designation", "relevance_score"),
    oracle(f"""select id_element, translate(designation, 'eo', 'éö') as designation, {rel_sql(['red', 'widget'])} as relevance_score
        from elements_flat where {any_sql('red')} and {any_sql('widget')}
        order by relevance_score desc, translate(designation, 'eo', 'éö'), id_element limit 100""".replace("lower(designation)", _PLAIN), "elements_flat"))
PLANS["c08_suggest_ci_ai"] = (
    lambda t: S.suggest(accented(t), t.sections.join(t.lots, "id_lot").join(t.dpgf, "id_dpgf"), "ÈD", 200, collation=T.CI_AI).drop("len"),
    oracle(f"""with a as (select 1 as stage, translate(designation, 'eo', 'éö') as text, min(id_element) as id, length(designation) as len, 'designation' as type
          from elements_flat where contains({_PLAIN}, 'ed') group by designation),
        b as (select 2, translate(designation, 'eo', 'éö'), min(id_element), min(length(description)), 'description' from elements_flat
          where contains(lower(description), 'ed') and not contains({_PLAIN}, 'ed') group by designation),
        c as (select 3, 'Section ' || numero_section || ': ' || titre_section, id_section, 0, 'section' from sections s
          join lots l on s.id_lot = l.id_lot where contains(lower(titre_section), 'ed'))
        select stage, text, id, type from (select * from a union all select * from b union all select * from c)
        order by stage, len, text, id limit 200""", "elements_flat", "sections", "lots"))
PLANS["c07_search_total"] = (
    lambda t: S.search_elements(flat(t), "red widget", min_price=1000, max_price=2000)[1],
    oracle(f"select count(*) as total from elements_flat where {any_sql('red')} and {any_sql('widget')} and prix_unitaire between 1000 and 2000", "elements_flat"))
PLANS["c08_suggest"] = (
    lambda t: S.suggest(flat(t), t.sections.join(t.lots, "id_lot").join(t.dpgf, "id_dpgf"), "ri", 200).drop("len"),
    oracle("""with a as (select 1 as stage, designation as text, min(id_element) as id, length(designation) as len, 'designation' as type
          from elements_flat where contains(lower(designation), 'ri') group by designation),
        b as (select 2, designation, min(id_element), min(length(description)), 'description' from elements_flat
          where contains(lower(description), 'ri') and not contains(lower(designation), 'ri') group by designation),
        c as (select 3, 'Section ' || numero_section || ': ' || titre_section, id_section, 0, 'section' from sections s
          join lots l on s.id_lot = l.id_lot where contains(lower(titre_section), 'ri'))
        select stage, text, id, type from (select * from a union all select * from b union all select * from c)
        order by stage, len, text, id limit 200""", "elements_flat", "sections", "lots"))
PLANS["c09_similar_elements"] = (
    lambda t: S.similar_elements(flat(t), flat(t).orderBy("id_element").limit(1), 100, with_ratio=False)
    .select("id_element", "similarity_score"),
    oracle(f"""with r as (select id_element as i, id_lot as lo, id_section as se,
            list_filter(list_concat({tok_sql('designation')}, {tok_sql('description')}), lambda t: length(t) >= 3) as terms
          from elements_flat order by id_element limit 1)
        select id_element, case when id_lot = lo and coalesce(id_section = se, false) then 30 when id_lot = lo then 20
            when coalesce(id_section = se, false) then 10 else 0 end as similarity_score
        from elements_flat, r where id_element <> i
          and (len(terms) = 0 or len(list_filter(terms, lambda t: contains(lower(designation), t) or contains(lower(description), t))) > 0)
        order by similarity_score desc, id_element limit 100""", "elements_flat"))
PLANS["c10_match_text"] = (
    lambda t: S.match_text(flat(t), "Fourniture et pose de red ring, promo ou brand#7", 100)
    .select("id_element", "match_confidence", "confidence_level"),
    oracle(f"""with s as (select id_element, ({rel_sql(['fourniture', 'pose', 'red', 'ring', 'promo', 'brand'])})::double / 60.0 * 100.0 as raw
          from elements_flat where {' or '.join(any_sql(x) for x in ('fourniture', 'pose', 'red', 'ring', 'promo', 'brand'))}),
        k as (select id_element, raw, least(100.0, greatest(0.0, round_even(raw, 0))) as m from s)
        select id_element, m::int as match_confidence, case when m >= 80 then 'élevée' when m >= 50 then 'moyenne' else 'faible' end as confidence_level
        from k order by raw desc, id_element limit 100""", "elements_flat"))
PLANS["c11_confidence_level"] = (
    lambda t: t.events.groupBy(T.confidence_level(F.col("value")).alias("niveau")).agg(F.count("*").alias("n")),
    "select case when value >= 80 then 'élevée' when value >= 50 then 'moyenne' else 'faible' end as niveau, count(*) as n from events group by 1")
PLANS["c12_sequence_ratio"] = (
    lambda t: t.part.groupBy("p_name", "p_type").agg(F.count("*").alias("n"))
    .withColumn("ratio", T.sequence_ratio("p_name", "p_type")), None)
PLANS["c13_search_similar"] = (
    lambda t: S.search_similar(flat(t), "red widgets", 0.5, 200, texts=texts(t)).select("id_element", "similarity"),
    oracle(f"""select * from (select id_element, {sim_sql('designation', "'red widgets'")} as similarity from elements_flat)
        where similarity > 0.5 order by similarity desc, id_element limit 200""", "elements_flat"))
PLANS["c14_fuzzy_search"] = (
    lambda t: S.fuzzy_search(flat(t), R.section_path(t.sections), "cold rod", 70.0, texts=texts(t)).select(
        "id_element", "score", "dpgf_source", "lot", "section"),
    oracle(f"""with recursive tr as (select id_section, titre_section as chemin from sections where section_parent_id is null
          union all select s.id_section, chemin || ' → ' || titre_section from sections s join tr on s.section_parent_id = tr.id_section),
        h as (select *, {sim_sql('designation', "'cold rod'")} as sim from elements_flat)
        select id_element, sim * 100 as score, nom_projet as dpgf_source, nom_lot as lot, coalesce(chemin, 'Inconnue') as section
        from h left join tr on h.id_section = tr.id_section where sim > 0.7""", "elements_flat", "sections"))
PLANS["c15_fuzzy_match_document"] = (
    lambda t: dbl(S.fuzzy_match_summary(t.rows.select(F.lower(F.col("cells")[0]).alias("text")), flat(t), 50.0), "min_price", "max_price"),
    oracle(f"""with l as (select distinct lower(cells[1]) as ltext from rows where cells[1] <> ''),
        lt as (select ltext, {tri_sql('ltext')} as lg from l),
        b as (select lower(designation) as rtext, count(*) as elements, min(prix_unitaire)::double as min_price, max(prix_unitaire)::double as max_price
          from elements_flat group by 1),
        rt as (select *, {tri_sql('rtext')} as rg from b),
        p as (select ltext, rtext, elements, min_price, max_price, len(list_intersect(lg, rg)) as i, len(lg) as n, len(rg) as m from lt, rt)
        select ltext, rtext, elements, min_price, max_price, i::double / (n + m - i) * 100 as score from p where i::double / (n + m - i) > 0.5""",
           "rows", "elements_flat"))
PLANS["c15_fuzzy_match_report"] = (
    lambda t: S.fuzzy_match_report(t.part.select(F.col("p_partkey").alias("id_item"), F.col("p_name").alias("designation")), flat(t),
                                   R.section_path(t.sections), 90.0).select("id_item", "id_element", "score", "dpgf_source", "lot", "section"),
    oracle(f"""with recursive tr as (select id_section, titre_section as chemin from sections where section_parent_id is null
          union all select s.id_section, chemin || ' → ' || titre_section from sections s join tr on s.section_parent_id = tr.id_section),
        lt as (select ltext, {tri_sql('ltext')} as lg from (select distinct lower(p_name) as ltext from part where p_name <> '')),
        rt as (select rtext, {tri_sql('rtext')} as rg from (select distinct lower(designation) as rtext from elements_flat where designation <> '')),
        p as (select ltext, rtext, len(list_intersect(lg, rg)) as i, len(lg) as n, len(rg) as m from lt, rt)
        select p_partkey as id_item, id_element, i::double / (n + m - i) * 100 as score, nom_projet as dpgf_source, nom_lot as lot,
        coalesce(chemin, 'Inconnue') as section from p join part on lower(p_name) = ltext join elements_flat e on lower(designation) = rtext
        left join tr on e.id_section = tr.id_section where i::double / (n + m - i) > 0.9""", "elements_flat", "sections"))
PLANS["c16_similar_price"] = (
    lambda t: S.similar_price(flat(t), 1500.0, "m2", 20.0, 100).select("id_element", "ecart"),
    oracle("""select id_element, abs(prix_unitaire::double - 1500.0) as ecart from elements_flat
        where prix_unitaire::double between 1200.0 and 1800.0 and unite = 'm2' order by ecart, id_element limit 100""", "elements_flat"))
PLANS["c17_price_history"] = (
    lambda t: dbl(S.price_history(flat(t), "old gear", 60, texts(t)), "min_price", "max_price").withColumn("annee", F.coalesce("annee", F.lit(0))),
    oracle(f"""with h as (select *, {sim_sql('designation', "'old gear'")} as sim from elements_flat)
        select coalesce(year(date_dpgf), 0) as annee, count(*) as elements, sum(prix_unitaire)::double / count(prix_unitaire) as average_price,
        min(prix_unitaire)::double as min_price, max(prix_unitaire)::double as max_price from h where sim > 0.6 group by rollup(year(date_dpgf))""",
           "elements_flat"))
PLANS["c18_fuzzy_listing"] = (
    lambda t: S.fuzzy_listing(flat(t), "hot plates", 50, 200, texts(t)).select("id_element", "nom_projet", "annee", "score"),
    oracle(f"""with h as (select *, {sim_sql('designation', "'hot plates'")} as sim from elements_flat)
        select id_element, nom_projet, year(date_dpgf) as annee, sim * 100 as score from h where sim > 0.5 order by sim desc, id_element limit 200""",
           "elements_flat"))


# ---- the same searches on the stored index --------------------------------------------------------------

_built = {}


def index(t):
    """The index of the flat view, built once per application and data folder."""
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _built:
        _built[key] = X.build(flat(t), scratch_path(t.spark, "index"), "id_lot", t.elements.count())
    return _built[key]


PLANS["c07_search_elements_indexed"] = (
    lambda t: dbl(X.search_elements(index(t), "red widget", limit=100, min_price=1000, max_price=2000)[0]
                  .select("id_element", "designation", "prix_unitaire", "relevance_score", "nom_client", "nom_projet"), "prix_unitaire"),
    PLANS["c07_search_elements"][1])
PLANS["c10_match_text_indexed"] = (
    lambda t: X.match_text(index(t), "Fourniture et pose de red ring, promo ou brand#7", 100).select("id_element", "match_confidence", "confidence_level"),
    PLANS["c10_match_text"][1])
PLANS["c13_search_similar_indexed"] = (
    lambda t: X.search_similar(index(t), "red widgets", 0.5, 200).select("id_element", "similarity"), PLANS["c13_search_similar"][1])
