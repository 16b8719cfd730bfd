"""Registered queries: document identification (F)."""

from pyspark.sql import functions as F

from pricebook.operators import identify as I
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_scalars import alt

PLANS = {}
ACC = ("éèêëàâäùûüîïôöç", "eeeeaaauuuiiooc")


def norm(e):
    return rf"trim(regexp_replace(translate(lower({e}), '{ACC[0]}', '{ACC[1]}'), '[^a-z0-9\s]', '', 'g'))"


def hit(e, words, p):
    return f"case when regexp_matches({e}, '{alt(words)}') then {p} else 0 end"


ROWTEXT = "lower(array_to_string(list_filter(cells, lambda c: c <> ''), ' '))"
NUMC = r"regexp_matches(replace({c}, ',', '.'), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


NAME_SQL = ", ".join(
    f"({hit('lower(name)', I.KEYWORDS[t], 0.5)} + case when regexp_matches(lower(name), '{I.NAME_PATTERNS[t]}') then 0.5 else 0 end)::double as name_{t}"
    for t in I.TYPES)
reg("f01_filename_scores", lambda t: I.filename_scores(t.workbooks).drop("pays"),
    f"select file_id, name, {NAME_SQL} from workbooks", "workbooks")


def conf_sql(kind):
    def share(p):
        return "(" + " + ".join(f"case when len(list_filter(h, lambda x: contains({norm('x')}, '{w}'))) > 0 then 1.0::double else 0.0::double end"
                                for w in p) + f") / {len(p)}"
    return "greatest(" + ", ".join(share(p) for p in I.HEADERS[kind]) + ")"


reg("f02_column_confidence", lambda t: t.rows.filter("row = 2").select(
    "file_id", "sheet", *[I.column_confidence(F.col("cells"), k).alias(f"conf_{k}") for k in I.TYPES]),
    f"select file_id, sheet, {', '.join(conf_sql(k) + ' as conf_' + k for k in I.TYPES)} from (select file_id, sheet, cells as h from rows where row = 2)", "rows")
CONTENT = f"""cs as (select file_id, sheet, {', '.join(f"coalesce({conf_sql(k)}, 0) * 0.7::double + case when k{k} then 0.3::double else 0.0::double end as content_{k}" for k in I.TYPES)}
    from (select file_id, sheet, max(cells) filter (where row = 2) as h, {', '.join(f"coalesce(bool_or(row > 2 and regexp_matches({ROWTEXT}, '{alt(I.KEYWORDS[k])}')), false) as k{k}" for k in I.TYPES)}
      from rows where row <= 12 group by all))"""
reg("f03_content_scores", lambda t: I.content_scores(t.rows, 2), f"with {CONTENT} select * from cs", "rows")
BONUS = f"""bc as (select file_id, sheet, col, count(*) filter (where row > 2 and {NUMC.format(c='text')}) as n,
        count(*) filter (where row > 2 and text <> '' and not {NUMC.format(c='text')}) as x, max({norm('text')}) filter (where row = 2) as hd from cells group by all),
    bo as (select file_id, sheet, count(*) filter (where n > 0 and x = 0) as nc, coalesce(bool_or(regexp_matches(hd, 'montant|total')), false) as mt,
        coalesce(bool_or(contains(hd, 'prix')), false) as px from bc group by all),
    bb as (select file_id, sheet, nc::int as numeric_columns, case when nc >= 3 and mt then 0.2 else 0.0 end::double as bonus_DPGF,
        case when nc <= 2 and px then 0.2 else 0.0 end::double as bonus_BPU, case when nc >= 3 and mt then 0.2 else 0.0 end::double as bonus_DQE from bo)"""
reg("f04_deep_bonus", lambda t: I.deep_bonus(t.rows, 2), f"with {BONUS} select * from bb", "cells")


def classify_sql(mode, deep):
    pf = (f"select cs.file_id, {', '.join(f'max(content_{k} + bonus_{k}) as c{k}' for k in I.TYPES)} from cs join bb on cs.file_id = bb.file_id and cs.sheet = bb.sheet group by 1"
          if deep else f"select file_id, {', '.join(f'max(content_{k}) as c{k}' for k in I.TYPES)} from cs where file_id in (select file_id from nm where greatest(name_DPGF, name_BPU, name_DQE) >= 0.15) group by 1")
    sc = ", ".join((f"coalesce(c{k}, 0) * 0.6::double + name_{k} * 0.4::double" if mode == "local" else f"coalesce(c{k}, 0) + name_{k}") + f" as score_{k}" for k in I.TYPES)
    return f"""with {CONTENT}, {BONUS}, nm as (select file_id, name, pays, {NAME_SQL} from workbooks), pf as ({pf}),
        s as (select nm.*, {sc} from nm left join pf on nm.file_id = pf.file_id),
        cl as (select *, greatest(score_DPGF, score_BPU, score_DQE) as confidence, case when greatest(score_DPGF, score_BPU, score_DQE) < 0.3 then 'UNKNOWN'
          when score_DPGF = greatest(score_DPGF, score_BPU, score_DQE) then 'DPGF' when score_BPU = greatest(score_DPGF, score_BPU, score_DQE) then 'BPU' else 'DQE' end as doc_type from s)"""


CL = ["file_id", "score_DPGF", "score_BPU", "score_DQE", "confidence", "doc_type"]
reg("f05_classify_files", lambda t: I.classify_files(t.workbooks, t.rows, "local", 0.3, 2).select(*CL),
    classify_sql("local", True) + f" select {', '.join(CL)} from cl", "workbooks", "rows", "cells")
reg("f06_classify_shared", lambda t: I.classify_files(t.workbooks, t.rows, "shared", 0.3, 2, deep=False).select(*CL),
    classify_sql("shared", False) + f" select {', '.join(CL)} from cl", "workbooks", "rows", "cells")
reg("f07_identification_summary", lambda t: I.identification_summary(I.classify_files(t.workbooks, t.rows, "local", 0.3, 2), "pays"),
    classify_sql("local", True) + " select doc_type, pays, count(*) as files, sum(round_even(confidence, 4)::decimal(18,4))::double / count(*) as mean_confidence from cl group by 1, 2",
    "workbooks", "rows", "cells")
reg("f08_file_lot_info", lambda t: I.file_lot_info(t.rows, t.workbooks).fillna(""), r"""
    with m as (select file_id, sheet, row, list_filter(cells, lambda c: regexp_matches(c, '(?i)lot\s+([^\s–-]+)\s*[–-]\s*(.+)'))[1] as c from rows where row < 15),
    f as (select file_id, arg_min(c, (sheet, row)) as c from m where c is not null group by 1)
    select w.file_id, name, coalesce(trim(case when c is not null then regexp_extract(c, '(?i)lot\s+([^\s–-]+)\s*[–-]\s*(.+)', 1)
        else regexp_extract(name, '(?i)lot\s*(\d+)[^a-zA-Z0-9]*(.*?)\.', 1) end), '') as numero_lot,
      coalesce(trim(case when c is not null then regexp_extract(c, '(?i)lot\s+([^\s–-]+)\s*[–-]\s*(.+)', 2)
        else regexp_extract(name, '(?i)lot\s*(\d+)[^a-zA-Z0-9]*(.*?)\.', 2) end), '') as nom_lot
    from workbooks w left join f on w.file_id = f.file_id""", "rows", "workbooks")
_main = " + ".join([f"(case when contains({ROWTEXT}, '{w}') then {p} else 0 end)" for ws, p in
                    ((I.SHEET_WORDS, 8), (I.SHEET_UNITS, 2), (I.SHEET_TRADES, 3)) for w in ws])
SCORE = rf"""ns as (select file_id, sheet, 3 * count(*) as k from (select file_id, sheet, col, count(*) as n from cells where row < 20 and col < 10 and {NUMC.format(c='text')} group by all) where n > 5 group by all),
    rs as (select file_id, sheet, sum(case when row < 20 then 3 * len(list_filter(cells, lambda c: regexp_matches(c, '^([A-Z])?\d+(\.\d+)*$'))) + {_main} else 0 end) as p,
        max(row) + 1 as r, max(len(cells)) as c from rows group by all),
    sc as (select rs.file_id, rs.sheet, greatest(0, p + coalesce(k, 0) + case when r > 20 then 10 when r > 10 then 5 else 0 end + case when c between 4 and 15 then 5 when c > 15 then -2 else 0 end
        - {hit('lower(rs.sheet)', I.SHEET_INFO, 15)} - case when r < 10 then 10 else 0 end + case when regexp_matches(lower(rs.sheet), 'lot\s*\d+') then 15 else 0 end)::int as score
        from rs left join ns on rs.file_id = ns.file_id and rs.sheet = ns.sheet)"""
reg("f09_score_sheets", lambda t: I.score_sheets(t.rows), f"with {SCORE} select * from sc", "rows", "cells")
reg("f09_score_sheets_small", lambda t: I.score_sheets(t.rows, "small"), rf"""
    select file_id, sheet, (sum(case when row < 10 then {hit(ROWTEXT, I.SMALL_WORDS, 5)} + case when len(list_filter(cells, lambda c: regexp_matches(c, '^\d+(\.\d+)*$'))) > 0 then 2 else 0 end
      + {hit(ROWTEXT, I.SMALL_UNITS, 1)} else 0 end) + case when max(row) + 1 between 10 and 1000 and max(len(cells)) between 3 and 20 then 3 else 0 end)::int as score from rows group by all""", "rows")
reg("f09_best_sheet", lambda t: I.best_sheet(t.rows), f"""with {SCORE}, o as (select *, not regexp_matches(lower(sheet), '{alt(I.SHEET_SKIP)}') and score > 0 as ok from sc),
    rk as (select *, row_number() over (partition by file_id order by ok desc, case when ok then -score else 0 end, sheet) as k from o)
    select file_id, sheet, score from rk where k = 1""", "rows", "cells")
_sw = " + ".join(f"coalesce(max(case when row between 1 and 10 and contains({ROWTEXT}, '{w}') then 1 else 0 end), 0)" for w in I.SHARED_WORDS)
_sn = " + ".join([f"case when contains(lower(sheet), '{w}') then 2 else 0 end" for w in I.SHARED_NAME]
                 + [f"case when contains(lower(sheet), '{w}') then -3 else 0 end" for w in I.SHARED_NEGATIVE])
reg("f10_score_sheets_shared", lambda t: I.score_sheets(t.rows, "shared"), rf"""
    select file_id, sheet, (case when contains(lower(sheet), 'lot') then 5 else 0 end + case when regexp_matches(lower(sheet), 'lot\s*\d+') then 3 else 0 end + {_sn}
      + least(max(len(cells)), 5) + {_sw} + max(case when row between 1 and 10 and regexp_matches({ROWTEXT}, '\d+\.\d+') then 3 else 0 end)
      + least(sum(case when row between 1 and 10 then len(list_filter(cells, lambda c: c <> '')) else 0 end)::int // 10, 5))::int as score from rows group by file_id, sheet""", "rows")
reg("f10_is_multi_sheet_form", lambda t: I.is_multi_sheet_form(t.rows), rf"""
    select file_id, count(distinct sheet) >= 3 or bool_or(regexp_matches(lower(sheet), '{alt(I.SHARED_FORM)}')) as multi_sheet_form from rows group by 1""", "rows")


def pick(texts):
    q = [t.replace("'", "''") for t in texts]
    return "[" + ", ".join(f"case when {p} = 0 then '{x}' end" for p, x in zip(("lots", "sections", "price_columns", "unit_columns", "elements"), q)) + "]"


def heads(words):
    return f"sum(case when row < 10 then len(list_filter(cells[1:19], lambda c: regexp_matches(lower(c), '{alt(words)}'))) else 0 end)::bigint"


_t = "lower(array_to_string(cells[1:19], ' '))"
reg("f11_structure_score", lambda t: I.structure_score(t.rows).withColumn("missing", F.array_join("missing", "|"))
    .withColumn("advice", F.array_join("advice", "|")), rf"""
    with s as (select file_id, sheet, count(*) filter (where length({_t}) < 200 and regexp_matches({_t}, '{alt(I.LOT_WORDS)}')) as lots,
        count(*) filter (where length({_t}) < 200 and regexp_matches({_t}, '{alt(I.SECTION_WORDS)}')) as sections,
        {heads(I.PRICE_WORDS)} as price_columns, {heads(I.UNIT_WORDS)} as unit_columns,
        count(*) filter (where length({_t}) > 10 and len(list_filter(cells[1:19], lambda c: regexp_matches(regexp_replace(c, '[ €]', '', 'g'), '^\d+$'))) >= 2) as elements
      from rows where row < 199 and len(list_filter(cells[1:19], lambda c: c <> '')) > 0 group by 1, 2),
    p as (select *, case when lots > 0 then 25 else 0 end + case when sections > 0 then 20 else 0 end + case when price_columns > 0 then 20 else 0 end
        + case when unit_columns > 0 then 15 else 0 end + case when elements >= 10 then 20 when elements >= 5 then 10 when elements > 0 then 5 else 0 end as pts from s),
    b as (select *, pts / 100.0::double as score from (select *, row_number() over (partition by file_id order by pts desc, sheet) as k from p) where k = 1)
    select file_id, sheet, lots, sections, price_columns, unit_columns, elements, score,
      case when score >= 0.8 then 'Structure DPGF bien définie' when score >= 0.5 then 'Structure DPGF partielle' else 'Structure DPGF faible ou absente' end as reason,
      array_to_string({pick(I.MISSING)}, '|') as missing,
      array_to_string(list_concat(list_concat([case when score < 0.3 then 'Examiner manuellement le contenu du fichier' end], {pick(I.ADVICE)}),
        [case when score >= 0.6 then 'Vérifier les détails de l''import' when score >= 0.3 then 'Fichier partiellement compatible - Améliorer la structure' end]), '|') as advice
    from b""", "rows")
PROF = "sh as (select file_id, sheet, max(row) + 1 as r, max(len(cells)) as c, sum(len(list_filter(cells, lambda x: x <> ''))) as f from rows group by 1, 2)"
reg("f12_workbook_profile", lambda t: I.workbook_profile(t.rows), f"""with {PROF}
    select file_id, count(*) as sheets, max(r) as max_rows, max(c)::int as max_cols, sum(r * c)::bigint as cells, arg_min(sheet, (-r * c, sheet)) as largest_sheet,
    count(*) filter (where f = 0) as empty_sheets from sh group by 1""", "rows")
CPX = f"""{PROF}, k as (select *, row_number() over (partition by file_id order by sheet) as k from sh),
    p as (select file_id, count(*) as n, sum(case when k <= 3 then (r - 1) * c else 0 end) as cl, count(*) filter (where k <= 3 and r > 1001) as lo,
        count(*) filter (where k <= 3 and c > 20) as wi from k group by 1),
    cx as (select w.file_id, case when n is null then 1.5::double else least(10 + case when n > 5 then 3 else 0 end + 2 * lo + 2 * wi + case when cl > 50000 then 5 when cl > 10000 then 3 else 0 end
        + {hit('lower(name)', I.COMPLEX_NAMES, 2)}, 30) / 10.0::double end as complexity from workbooks w left join p on w.file_id = p.file_id)"""
reg("f13_complexity", lambda t: I.complexity(t.rows, t.workbooks), f"with {CPX} select * from cx", "rows", "workbooks")
reg("f14_time_budget", lambda t: t.files.select("file_id", I.time_budget(F.col("size") / F.lit(1048576.0), F.lit(1.5)).alias("seconds")),
    "select file_id, least(1800.0::double, greatest(180.0::double, 60.0::double + size / 1048576.0::double * 30.0::double + 1.5::double * 120.0::double)) as seconds from files", "files")
