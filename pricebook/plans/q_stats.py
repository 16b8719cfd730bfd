"""Registered queries: statistics and groupings (D1-D9)."""

from pyspark.sql import functions as F

from pricebook.operators import stats as S
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_relational import dbl, flat
from pricebook.plans.q_search import tok_sql

PLANS = {}
AVG = "sum(prix_unitaire)::double / count(prix_unitaire)"
EX = "array_join(transform(elements, e -> cast(e.id_element as string)), ',')"


def ids(df):
    return df.withColumn("elements", F.coalesce(F.expr(EX), F.lit("")))


def words(ws):
    return ", ".join(f"'{w}'" for w in ws)


PLANS["d01_statistics"] = (lambda t: S.statistics(flat(t)), oracle(f"""
    select count(*) as total_elements, min(prix_unitaire)::double as min_price, max(prix_unitaire)::double as max_price,
    {AVG} as avg_price, sum(prix_total)::double as total_amount from elements_flat""", "elements_flat"))
PLANS["d02_unit_counts"] = (lambda t: S.unit_counts(flat(t)), oracle(
    "select unite, count(*) as n from elements_flat where unite <> '' group by 1", "elements_flat"))
PLANS["d03_section_coverage"] = (lambda t: S.section_coverage(flat(t)), oracle("""
    select count(id_section) as with_section, count(*) - count(id_section) as without_section,
    round_even(count(id_section) * 100.0 / count(*)::double, 2)::double as percent from elements_flat""", "elements_flat"))
PLANS["d04_group_by_lot"] = (
    lambda t: S.group_by_lot(flat(t), t.lots).fillna(-1.0, ["min_price", "max_price"]), oracle(f"""
    with g as (select id_lot, count(*) as n, min(prix_unitaire) as lo, max(prix_unitaire) as hi, {AVG} as av, sum(prix_total) as tot
      from elements_flat group by 1)
    select l.id_lot, numero_lot, nom_lot, coalesce(n, 0) as elements_count, coalesce(lo::double, -1) as min_price,
      coalesce(hi::double, -1) as max_price, coalesce(av, 0) as avg_price, coalesce(tot::double, 0) as total
    from lots l left join g on l.id_lot = g.id_lot""", "elements_flat", "lots"))
TOPN = "string_agg(id_element::varchar, ',' order by id_element) filter (where rn <= {n})"
PLANS["d05_group_by_section"] = (lambda t: ids(S.group_by_section(flat(t))), oracle(f"""
    select id_lot, id_section, numero_section, titre_section, count(*) as elements_count, {TOPN.format(n=10)} as elements
    from (select *, row_number() over (partition by id_section order by id_element) as rn from elements_flat where id_section is not null)
    group by all""", "elements_flat"))
PLANS["d06_without_section"] = (lambda t: ids(S.without_section(flat(t))), oracle(f"""
    select id_lot, count(*) as elements_count, {TOPN.format(n=10)} as elements
    from (select *, row_number() over (partition by id_lot order by id_element) as rn from elements_flat where id_section is null)
    group by all""", "elements_flat"))
PLANS["d07_group_by_unit"] = (lambda t: S.group_by_unit(flat(t)), oracle(f"""
    select unite, count(*) as n, min(prix_unitaire)::double as min_price, max(prix_unitaire)::double as max_price, {AVG} as avg_price
    from elements_flat group by 1""", "elements_flat"))


def _bands_sql(price, compat):
    edges = ["lo"] + [f"mu + {c} * sd" for c in S.CUTS] + ["hi"]
    rows = " union all ".join(f"select {i} as rang, '{b}' as band, {edges[i]} as bmin, {edges[i + 1]} as bmax from s"
                              for i, b in enumerate(S.BANDS))
    hit = ("x between bmin and bmax" if compat else
           "((rang = 0 or x >= bmin) and (rang = 4 or x < bmax))")
    return f"""with p as (select id_element, {price}::double as x from elements_flat),
        s as (select min(x) as lo, max(x) as hi, avg(x) as mu, stddev_pop(x) as sd from p), b as ({rows}),
        h as (select band, id_element, row_number() over (partition by band order by id_element) as rn from p join b on {hit}),
        g as (select band, count(*) as n, {TOPN.format(n=20)} as elements from h group by 1)
        select rang, b.band, round_even(bmin, 4) as min, round_even(bmax, 4) as max, coalesce(n, 0) as elements_count,
        coalesce(elements, '') as elements from b left join g on b.band = g.band"""


def _bands(t, price, compat):
    df = ids(S.price_bands(flat(t), price, compat))
    return df.withColumn("min", F.bround("min", 4)).withColumn("max", F.bround("max", 4))


PLANS["d08_price_bands"] = (lambda t: _bands(t, "prix_unitaire", False), oracle(_bands_sql("prix_unitaire", False), "elements_flat"))
PLANS["d08_price_bands_total"] = (lambda t: _bands(t, "prix_total", False), oracle(_bands_sql("prix_total", False), "elements_flat"))
PLANS["d08_price_bands_compat"] = (lambda t: _bands(t, "prix_total", True), oracle(_bands_sql("prix_total", True), "elements_flat"))


def _kw_frame(t):
    """Loaded elements plus the lines of the documents, so that the vocabularies have hits."""
    return t.elements.select("unite", F.col("designation_exacte").alias("designation"), "description").unionByName(
        t.rows.select(F.col("cells")[1].alias("unite"), F.col("cells")[0].alias("designation"), F.lit("").alias("description")))


PLANS["d09_extract_keywords"] = (lambda t: S.extract_keywords(_kw_frame(t)), oracle(f"""
    with e as (select unite, designation_exacte as designation, description from elements
               union all select cells[2], cells[1], '' from rows),
    k as (select 'unites' as category, unite as keyword from e where unite <> ''
      union all select 'dimensions', regexp_replace(unnest(list_concat(regexp_extract_all(lower(designation), '{S.DIMENSION}'),
          regexp_extract_all(lower(description), '{S.DIMENSION}'))), '[xX*]', 'x') from e
      union all select case when w in ({words(S.TECHNIQUES)}) then 'techniques' else 'materiaux' end, w
        from (select unnest(list_distinct({tok_sql("designation || ' ' || description")})) as w from e)
        where w in ({words(S.TECHNIQUES + S.MATERIALS)})),
    c as (select category, keyword, count(*) as n from k group by all),
    r as (select *, row_number() over (partition by category order by n desc, keyword) as rank from c)
    select category, keyword, n, rank, round_even(n * 100.0 / (select count(*) from e)::double, 0)::int as percentage
    from r where rank <= 20""", "elements", "rows"))
