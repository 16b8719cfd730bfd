"""Registered queries: scalar functions (E) over texts, cells and prices of the driver tables."""

from pyspark.sql import functions as F

from pricebook.functions import scalars as S
from pricebook.functions import vocab as V
from pricebook.plans.fixtures import oracle

PLANS = {}


def lst(ws):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"


def alt(ws):
    return "(" + "|".join(w.replace(".", r"\.").replace("'", "''") for w in ws) + ")"


def sub(e, pat, to="", opt="g"):
    return f"regexp_replace({e}, '{pat}', '{to}', '{opt}')"


def blanks(e, chars):
    return f"trim({sub(sub(e, chars, ' '), chr(92) + 's+', ' ')})"


def words(e):
    return f"list_filter(string_split_regex({e}, ' +'), lambda w: w <> '')"


def title(e):
    return (f"array_to_string(list_transform(string_split({e}, ' '), "
            "lambda w: upper(w[1]) || lower(substr(w, 2))), ' ')")


def trade(e, table):
    return "case " + " ".join(f"when regexp_matches(lower({e}), '{alt(ws)}') then '{n}'" for n, ws in table) + " end"


NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def num_sql(e):
    return f"case when regexp_matches({e}, '{NUM}') then try_cast({e} as double) end"


def parse_sql(e, variant="standard"):
    if variant == "digits":
        return num_sql(f"replace({sub(e, '[^0-9.,]')}, ',', '.')")
    s = sub(e, r"[€$£\s]" if variant == "standard" else r"[€$£¥\s]")
    if variant == "permissive":
        return f"coalesce({num_sql(sub(f'replace({s}, chr(44), chr(46))', '[^0-9.-]'))}, 0.0)"
    t = (f"(case when contains({s}, ',') and not contains({s}, '.') then replace({s}, ',', '.') "
         f"when contains({s}, ',') and contains({s}, '.') and instr({s}, '.') < instr({s}, ',') "
         f"then replace(replace({s}, '.', ''), ',', '.') else {s} end)")
    return f"coalesce({num_sql(t)}, 0.0)"


def unit_sql(e):
    exact = " ".join(f"when '{k}' then '{v}'" for k, v in V.UNITS)
    part = " ".join(f"when contains(lower(trim({e})), '{k}') then '{v}'" for k, v in V.UNITS)
    return f"coalesce(case lower(trim({e})) {exact} end, case {part} end, substr(trim({e}), 1, 10))"


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def cell_texts(t):
    return t.cells.select("text").distinct()


reg("e01_normalize_text", lambda t: t.documents.select("doc_id", F.md5(S.normalize_text("text")).alias("h")),
    "select doc_id, md5(" + "trim(" + sub(f"translate(lower(text), '{V.ACCENTS[0]}', '{V.ACCENTS[1]}')", r"[^a-z0-9\s]")
    + ", e' \\t\\r\\n')) as h from documents")
_moji = "text"
for bad, good in V.MOJIBAKE:
    _moji = f"replace({_moji}, '{bad}', '{good}')"
reg("e02_repair_mojibake", lambda t: t.documents.select("doc_id", F.md5(S.repair_mojibake("text")).alias("h")),
    f"select doc_id, md5({_moji}) as h from documents")
_safe = "rtrim(" + sub(f"translate(name, '{V.ALL_ACCENTS[0]}', '{V.ALL_ACCENTS[1]}')", r"[^\p{L}\p{N} \-_.()&''°+=,;]") + ")"
reg("e03_safe_filename", lambda t: t.workbooks.unionByName(t.pages.select(
    F.col("page_id").alias("file_id"), F.col("url").alias("name"), F.lit("").alias("pays")))
    .select("file_id", S.safe_filename("name").alias("safe")),
    f"""select file_id, case when ends_with(s, '.xlsx') then s else s || '.xlsx' end as safe from
        (select file_id, {_safe} as s from (select file_id, name from workbooks union all select page_id, url from pages))""", "workbooks")
reg("e04_clean_client", lambda t: t.workbooks.select("file_id", S.clean_client("name").alias("client")),
    f"""select file_id, array_to_string(list_filter({words(blanks('name', '[_.-]+'))}, lambda w: upper(w) not in {lst(V.CLIENT_IGNORE)}), ' ') as client
        from workbooks""", "workbooks")
_small = words(blanks(sub("name", r"(?i)\.(xlsx?|xls|csv)$"), "[_.-]+"))
reg("e05_clean_lot_name", lambda t: t.workbooks.select(
    "file_id", S.clean_lot_name("name").alias("a"), S.clean_lot_name("name", "small").alias("b")),
    f"""select file_id, {title("array_to_string(list_filter(" + words(blanks('name', '[_.-]+')) + f", lambda w: lower(w) not in {lst(V.LOT_NOISE)}), ' ')")} as a,
        case when length(n) < 5 and len(sp) > 0 then {title('sp[1]')} else n end as b from (
          select file_id, name, array_to_string(list_filter({_small}, lambda w: lower(w) not in {lst(V.LOT_NOISE_SMALL)} and length(w) > 1), ' ') as n,
          list_filter({_small}, lambda w: length(w) > 2 and lower(w) not in {lst(V.LOT_FALLBACK_SKIP)}) as sp from workbooks)""", "workbooks")
_fb = (f"list_transform(list_filter(regexp_extract_all(name, '[A-Za-z]{{3,}}'), lambda w: lower(w) not in {lst(V.FALLBACK_IGNORE)} "
       "and length(w) > 3)[1:3], lambda w: upper(w[1]) || lower(substr(w, 2)))")
_fs = (f"list_transform(list_filter({words(blanks(chr(39).join(['replace(replace(lower(name), ', 'lot ', ' || num, ', '', '), ', 'lot', ' || num, ', '', ')']), '[_.()-]'))}, "
       f"lambda w: length(w) > 3 and w not in {lst(V.FALLBACK_IGNORE_SMALL)} and not regexp_matches(w, '^\\d+$'))[1:2], lambda w: upper(w[1]) || lower(substr(w, 2)))")
reg("e06_fallback_lot_name", lambda t: t.workbooks.withColumn("num", (F.col("file_id") % 20 + 1).cast("string")).select(
    "file_id", S.fallback_lot_name("num", "name").alias("a"), S.fallback_lot_name("num", "name", "small").alias("b")),
    f"""select file_id, 'Lot ' || num || ' - ' || case when len({_fb}) = 0 then 'Travaux' else array_to_string({_fb}, ' ') end as a,
        coalesce({trade('name', V.TRADES_SMALL)}, nullif(array_to_string({_fs}, ' '), ''), 'Lot ' || num) as b
        from (select *, (file_id % 20 + 1)::varchar as num from workbooks)""", "workbooks")
for i, v in ((7, "standard"), (8, "permissive"), (9, "digits")):
    reg(f"e{i:02d}_parse_number_{v}", lambda t, v=v: cell_texts(t).select("text", F.coalesce(S.parse_number("text", v), F.lit(-1.0)).alias("value")),
        f"select text, coalesce({parse_sql('text', v)}, -1.0) as value from (select distinct text from cells)", "cells")
reg("e10_normalize_unit", lambda t: t.cells.filter("col = 1").select("text").distinct().unionByName(
    t.texts.select("text").distinct()).distinct().select(F.md5("text").alias("k"), S.normalize_unit("text").alias("unite")),
    f"""select md5(text) as k, {unit_sql('text')} as unite from
        (select text from cells where col = 1 union select text from texts)""", "cells", "texts")
reg("e11_complete_prices", lambda t: t.lineitem.select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    S.complete_prices(F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity")),
                      F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_tax") + 1),
                      F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_extendedprice"))).alias("p")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*"),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        case l_returnflag when 'A' then l_extendedprice / (l_tax + 1) else l_quantity end as quantite,
        case l_returnflag when 'N' then l_extendedprice / l_quantity else l_tax + 1 end as prix_unitaire,
        case l_returnflag when 'R' then l_quantity * (l_tax + 1) else l_extendedprice end as prix_total from lineitem""")
reg("e12_reconcile_prices", lambda t: t.lines.select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.reconcile_prices(
        "qty", -F.col("pu_cents") / F.lit(100.0), F.col("cents") / F.lit(100.0)).alias("p"))
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*"),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, q as quantite, case when off then t / q else u end as prix_unitaire,
        t as prix_total, off as corrige from (select *, abs(q * u - t) > 0.02 as off from
        (select *, qty::double as q, pu_cents / 100.0::double as u, cents / 100.0::double as t from lines))""", "lines")
reg("e13_round_prices", lambda t: t.lineitem.select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.round_prices(
        F.col("l_quantity") / 7, F.col("l_extendedprice") / 7, F.col("l_extendedprice") / 7).alias("p"))
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*"),
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 7 * 10000, 0) / 10000 as quantite,
        round_even(l_extendedprice / 7 * 10000, 0) / 10000 as prix_unitaire, round_even(l_extendedprice / 7 * 100, 0) / 100 as prix_total from lineitem""")


def prefixed(sql):
    """Part names behind marks of every form."""
    return ("case p_partkey % 5 when 0 then concat('1.2.3 ', p_name) when 1 then concat('a) ', p_name) "
            "when 2 then concat('- ', p_name) when 3 then concat('A12.3 ', p_name) else p_name end" )


def _mx(p, g=1):
    return f"case when regexp_matches(x, '{p}') then regexp_extract(x, '{p}', {g}) end"


reg("e14_strip_prefix", lambda t: t.part.select("p_partkey", S.strip_prefix(F.expr(prefixed(0))).alias("texte")),
    rf"""select p_partkey, trim(coalesce({_mx(r'^\d+(?:\.\d+)*\s+(.+)')}, {_mx(r'^[a-z]\)\s+(.+)')}, {_mx(r'^[\-\*•]\s+(.+)')}, x)) as texte
        from (select p_partkey, {prefixed(1)} as x from part)""")
reg("e15_split_article", lambda t: t.part.select("p_partkey", S.split_article(F.expr(prefixed(0))).alias("s")).select("p_partkey", "s.*"),
    f"""select p_partkey, case when c then substr(w[1], 1, 20) else '' end as numero_article,
        case when c then array_to_string(w[2:], ' ') else x end as designation from (
          select *, {' or '.join(f"regexp_matches(w[1], '(?i){p}')" for p in V.ARTICLE_SPLIT)} as c from
            (select p_partkey, x, {words('x')} as w from (select p_partkey, {prefixed(1)} as x from part)))""")
reg("e16_block_fingerprint", lambda t: t.rows.select("file_id", "sheet", "row", S.block_fingerprint("cells").alias("h")),
    r"select file_id, sheet, row, md5(array_to_string(list_transform(cells, lambda x: regexp_replace(lower(x), '\s+', '', 'g')), '|')) as h from rows", "rows")
reg("e17_layout_signature", lambda t: t.rows.filter("row = 2").join(t.workbooks, "file_id").select(
    "file_id", "sheet", S.layout_signature("cells", "name").alias("sig")),
    r"""select r.file_id, sheet, substr(md5(array_to_string(list_filter(list_transform(cells, lambda h: lower(trim(h))), lambda h: h <> ''), '|')), 1, 8)
        || '_' || regexp_replace(lower(name), '\d+', 'X', 'g') as sig from rows r join workbooks w on r.file_id = w.file_id where row = 2""", "rows", "workbooks")
_kind = (f"case when regexp_matches(lower(text), '{alt(V.VARIABLE_WORDS)}') then 'variable' "
         f"when regexp_matches(lower(text), '{alt(V.FORFAIT_WORDS)}') then 'forfait' else 'standard' end")
reg("e18_element_kind", lambda t: t.texts.select("doc_id", "line_no", S.element_kind("text").alias("kind")),
    f"select doc_id, line_no, {_kind} as kind from texts", "texts")
reg("e19_trade_from_text", lambda t: t.texts.select(
    "doc_id", "line_no", F.coalesce(S.trade_from_text("text"), F.lit("")).alias("a"), F.coalesce(S.trade_from_text("text", "small"), F.lit("")).alias("b")),
    f"select doc_id, line_no, coalesce({trade('text', V.TRADES)}, '') as a, coalesce({trade('text', V.TRADES_SMALL)}, '') as b from texts", "texts")
reg("e20_column_letter", lambda t: t.part.select("p_partkey", S.column_letter((F.col("p_partkey") % 702).cast("int")).alias("lettre")),
    """select p_partkey, case when c < 26 then chr(65 + c) else chr(64 + c // 26) || chr(65 + c % 26) end as lettre
        from (select p_partkey, (p_partkey % 702)::int as c from part)""")
