"""Registered queries: import-run analytics (K)."""

from pyspark.sql import functions as F

from pricebook.operators import runs as R
from pricebook.plans.fixtures import oracle
from pricebook.plans.q_grid import m, x
from pricebook.plans.q_scalars import alt

PLANS = {}


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def has(t):
    return f"contains(text, '{t}')"


W = "over (partition by file order by line_no)"
CUR = r"""cu as (select * from (select *, last_value(case when contains(regexp_extract(text, '\[(.*?)\]', 1), '.xls') then regexp_extract(text, '\[(.*?)\]', 1) end ignore nulls) """ + W + """ as current_file from log_lines)
    where current_file is not null)"""
reg("k01_import_log_stats", lambda t: R.import_log_stats(t.log_lines), f"""with {CUR} select file, count(distinct current_file) as files_processed, count(*) filter (where {has('LOT NON DÉTECTÉ')}) as files_with_lot_issues,
    count(*) filter (where {has('Aucune section détectée')}) as files_with_section_issues,
    {', '.join(f"count(*) filter (where {has('LOT DÉTECTÉ - Méthode:')} and {has('Méthode: ' + k)}) as method_{k}" for k in R.METHODS)},
    count(*) filter (where {has('LOT PAR DÉFAUT CRÉÉ')}) as default_lots_created, count(*) filter (where {has('SECTION PAR DÉFAUT CRÉÉE')}) as default_sections_created from cu group by 1""", "log_lines")
reg("k01_import_log_problems", lambda t: R.import_log_problems(t.log_lines), f"""with {CUR}, p as (select *, case when {has('LOT NON DÉTECTÉ')} then 'Lot non détecté' when {has('LOT PAR DÉFAUT CRÉÉ')} then 'Lot par défaut créé'
    when {has('SECTION PAR DÉFAUT CRÉÉE')} then 'Section par défaut créée' when {has('Aucune section détectée')} then 'Problème de section' end as problem_type from cu)
    select current_file as file, problem_type, trim(text) as description, file as log, line_no from p where problem_type is not null""", "log_lines")



reg("k02_latest_logs", lambda t: R.latest_logs(t.log_lines.groupBy("file").agg(F.max("ts").alias("modified")).select(
    F.concat(F.lit("wb_"), (F.regexp_extract("file", r"\d", 0).cast("int") % 3).cast("string")).alias("file_name"), "file", "modified")),
    r"""with l as (select file, max(ts) as modified, 'wb_' || (regexp_extract(file, '\d')::int % 3) as file_name from log_lines group by 1)
    select file_name, arg_max(file, (modified, file)) as file, count(*) as imports from l group by 1""", "log_lines")
reg("k02_file_log_events", lambda t: R.file_log_events(t.log_lines), f"""with a as (select *, case when {has('==== DÉTECTION DE LOT ====')} then 'lot' when {has('==== DÉTECTION DES SECTIONS ET ÉLÉMENTS ====')} then 'section' end as p from log_lines),
    b as (select *, last_value(p ignore nulls) {W} as phase from a),
    c as (select *, case when phase = 'lot' and {has('LOT DÉTECTÉ')} then 'detected' when phase = 'lot' and {has('LOT NON DÉTECTÉ')} then 'not_detected' when phase = 'lot' and {has('ÉCHEC DE DÉTECTION')} then 'failed'
      when phase = 'section' and {has('SECTION DÉTECTÉE')} then 'detected' when phase = 'section' and {has('SECTION NON DÉTECTÉE')} then 'not_detected' when phase = 'section' and {has('SECTION PAR DÉFAUT CRÉÉE')} then 'default_created' end as event
      from b where p is null and phase is not null)
    select file, line_no, phase, event, (phase = 'lot' and event in ('not_detected', 'failed')) or (phase = 'section' and event = 'default_created') as is_problem, text from c where event is not null""", "log_lines")
FAM = "fm as (select file, family, n from (unpivot (select file, " + ", ".join(
    "sum(" + " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in ps) + f")::bigint as {f}" for f, ps in R.FAMILIES.items()) + \
    f" from log_lines group by 1) on {', '.join(R.FAMILIES)} into name family value n) where n > 0)"
FIL = f"fi as (select distinct file, unnest(regexp_extract_all(text, '(?i){R.FILE_NAMED}', 1)) as file_name from log_lines)"
reg("k03_error_family_counts", lambda t: R.error_family_counts(t.log_lines), f"with {FAM} select * from fm", "log_lines")
reg("k04_files_in_logs", lambda t: R.files_in_logs(t.log_lines), f"with {FIL} select * from fi", "log_lines")
reg("k04_import_totals", lambda t: R.import_totals(R.error_family_counts(t.log_lines), R.files_in_logs(t.log_lines)), f"""with {FAM}, {FIL}, f as (select file, count(*) as total_files from fi group by 1),
    k as (select file, coalesce(sum(n) filter (where family = 'succes_import'), 0)::bigint as s, coalesce(sum(n) filter (where family = 'import_technique'), 0)::bigint as te from fm group by 1)
    select coalesce(f.file, k.file) as file, coalesce(total_files, 0) as total_files, coalesce(s, 0) as successful_imports, coalesce(te, 0) as technical_imports,
      coalesce(total_files, 0) - coalesce(s, 0) - coalesce(te, 0) as failed_raw, greatest(0, coalesce(total_files, 0) - coalesce(s, 0) - coalesce(te, 0)) as failed_imports
    from f full join k on f.file = k.file""", "log_lines")
reg("k05_report_success", lambda t: R.report_success(t.report_files).fillna("", ["folder"]), """
    select report_file, coalesce(folder, '') as folder, count(*) as files, count(*) filter (where import_status = 'success') as successful,
    (count(*) filter (where import_status = 'success') * 100.0)::double / count(*)::double as success_rate from report_files group by rollup (report_file, folder) having report_file is not null""", "report_files")
reg("k06_error_distribution", lambda t: R.error_distribution(R.error_family_counts(t.log_lines)), f"with {FAM} select family, sum(n)::bigint as n from fm group by 1 order by n desc, family limit 5", "log_lines")
reg("k06_problem_files", lambda t: R.problem_files(R.error_family_counts(t.log_lines), R.files_in_logs(t.log_lines)),
    f"with {FAM}, {FIL} select file_name, count(*) as logs from fi where file in (select file from fm where family in ('erreur_excel', 'erreur_structure')) group by 1", "log_lines")
reg("k07_analysis_period", lambda t: R.analysis_period(t.log_lines).select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start_date", "end_date")], "duration_days"),
    """select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as end_date,
    floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400)::bigint as duration_days from log_lines""", "log_lines")


def _metrics(t):
    m1 = R.error_family_counts(t.log_lines).groupBy(F.col("family").alias("metric")).agg(F.sum("n").cast("double").alias("value"))
    m2 = R.run_totals(t.report_files).select(F.lit("success_rate").alias("metric"), F.col("success_rate").alias("value"))
    m3 = R.timing_report(t.report_files).select(F.lit("processing_time").alias("metric"), F.col("mean_seconds").alias("value"))
    return m1.unionByName(m2).unionByName(m3)


_rules = " union all ".join(f"select '{a}' as metric, '{o}' as op, {b} as bound, '{c}' as type, '{p}' as priority, '{t}' as title" for a, o, b, c, p, t in R.RECOMMENDATIONS)
reg("k08_recommend", lambda t: R.recommend(_metrics(t)), f"""with {FAM}, mt as (select family as metric, sum(n)::double as value from fm group by 1
    union all select 'success_rate', count(*) filter (where import_status = 'success') / count(*) from report_files union all select 'processing_time', sum(seconds)::double / count(*) from report_files)
    select type, priority, title, mt.metric, value from mt join ({_rules}) r on mt.metric = r.metric where case when op = '>' then value > bound else value < bound end""", "log_lines", "report_files")
EVT = "ev as (" + " union all ".join(
    f"select file, line_no, '{t}' as type, '{s}' as severity, {'f' if n else 'null'} as file_name, trim(text) as message from (select *, unnest(regexp_extract_all(text, '(?i){p}', 1)) as f from log_lines)"
    for t, p, s, n in R.RUN_EVENTS) + ")"
reg("k09_run_log_events", lambda t: R.run_log_events(t.log_lines).drop("ts").fillna("", ["file_name"]),
    f"with {EVT} select file, line_no, type, severity, coalesce(file_name, '') as file_name, message from ev", "log_lines")
CNT = f"""cx as (select *, lag(text, 1) {W} as t1, lag(text, 2) {W} as t2, lag(text, 3) {W} as t3 from log_lines),
    cy as (select *, regexp_extract(concat_ws(chr(10), t3, t2, t1, text), '(?i){R.WORKBOOK}', 1) as file_name from cx where {m('text', R.COUNTS)}),
    ct as (select file_name, arg_max({{'l': {x('text', R.COUNTS, 1)}::bigint, 's': {x('text', R.COUNTS, 2)}::bigint, 'e': {x('text', R.COUNTS, 3)}::bigint}}, (file, line_no)) as c from cy where file_name <> '' group by 1)"""
reg("k10_run_log_counts", lambda t: R.run_log_counts(t.log_lines), f"with {CNT} select file_name, c.l as lots, c.s as sections, c.e as elements from ct", "log_lines")
_st = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in R.STATUS.items()) + " end"
STA = f"""{EVT}, {CNT}, s1 as (select file_name, arg_max({_st}, (file, line_no)) as status from ev where {_st} is not null and file_name is not null group by 1),
    fs as (select coalesce(s1.file_name, ct.file_name) as file_name, coalesce(status, 'unknown') as status, coalesce(c.l, 0) as lots, coalesce(c.s, 0) as sections, coalesce(c.e, 0) as elements
      from s1 full join ct on s1.file_name = ct.file_name),
    fp as (select *, status = 'import_technique' or (lots = 0 and sections = 0 and status <> 'echec') as is_problem from fs)"""


def _status(t):
    return R.run_file_status(R.run_log_events(t.log_lines), R.run_log_counts(t.log_lines))


reg("k11_run_file_status", _status, f"with {STA} select * from fp", "log_lines")
reg("k11_files_by_status", lambda t: R.files_by_status(_status(t)), f"with {STA} select status, count(*) as files, count(*) filter (where is_problem) as problems from fp group by 1", "log_lines")
reg("k12_top_issues", lambda t: R.top_issues(R.run_log_events(t.log_lines).filter("severity in ('warning', 'error')")),
    f"with {EVT} select type, count(*) as n from ev where severity in ('warning', 'error') group by 1 order by n desc, type limit 10", "log_lines")
reg("k13_relevant_logs", lambda t: R.relevant_logs(t.log_lines), f"select file, bool_or(regexp_matches(lower(text), '{alt(R.RELEVANT)}')) as relevant from log_lines where line_no < 10 group by 1", "log_lines")
RI = """ri as (select report_file, folder, path, name as file_name, confidence, case when import_status = 'success' and lots_imported = 0 and sections_imported = 0 and elements_imported = 0 then 'import_technique_sans_donnees'
    when import_status = 'failed' then 'import_echec' when import_status in ('unknown', 'not_attempted') then 'import_non_tente' end as type from report_files where type = 'DPGF')"""
reg("k14_report_issues", lambda t: R.report_issues(t.report_files).withColumn("confidence", F.col("confidence").cast("double")),
    f"with {RI} select report_file, folder, path, file_name, confidence::double as confidence, type from ri where type is not null", "report_files")
reg("k15_report_issue_summary", lambda t: R.report_issue_summary(R.report_issues(t.report_files)), f"""with {RI}, i as (select * from ri where type is not null)
    (select 'file' as level, file_name as key, count(*) as n from i group by 2 order by n desc, key limit 10) union all select 'type', type, count(*) from i group by 2""", "report_files")
FR = """count(*) as files_found, count(*) filter (where regexp_matches(lower(name), '\\.(xlsx|xlsm|xls)$')) as excel_files, count(*) filter (where type in ('DPGF', 'BPU', 'DQE')) as identified,
    count(*) filter (where import_status = 'success') as imported, count(*) filter (where import_status = 'failed') as errors from report_files"""
reg("k16_folder_run_totals", lambda t: R.folder_run_totals(t.report_files).fillna("", ["folder"]), f"select coalesce(folder, '') as folder, {FR} group by rollup (folder)", "report_files")
reg("k17_run_totals", lambda t: R.run_totals(t.report_files), """select count(*) as total, count(*) filter (where import_status = 'success') as successful, count(*) filter (where import_status = 'failed') as failed,
    sum(lots_imported) filter (where import_status = 'success')::bigint as lots, sum(sections_imported) filter (where import_status = 'success')::bigint as sections,
    sum(elements_imported) filter (where import_status = 'success')::bigint as elements, count(*) filter (where import_status = 'success') / count(*) as success_rate from report_files""", "report_files")
reg("k18_timing_report", lambda t: R.timing_report(t.report_files), """select count(*) as files, sum(seconds)::double / count(*) as mean_seconds, sum(size)::double / count(*) as mean_bytes,
    count(*) filter (where seconds > 30) as slow_files, count(*) filter (where import_status = 'failed') as failed_files from report_files""", "report_files")
reg("k19_time_saved", lambda t: R.time_saved(t.report_files), """select sum(case when import_status = 'success' and seconds < 600 then 600 - seconds else 0 end)::bigint as time_saved,
    count(*) filter (where import_status = 'success' and attempts > 1) as retried from report_files""", "report_files")
PLANS["k20_pack_batches"] = (lambda t: R.pack_batches(t.files, 10).groupBy("folder", "batch").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")), None)
reg("k20_fixed_slices", lambda t: R.fixed_slices(t.files, ["folder"], "file_id").select("folder", "file_id", "batch"),
    "select folder, file_id, (row_number() over (partition by folder order by file_id) - 1) // 10 as batch from files", "files")


def _batches(t):
    """Batches of ten files per folder as they ran."""
    f = t.report_files.select("folder", F.col("seq"), "import_status", "seconds")
    s = R.fixed_slices(f, ["folder"], "seq")
    return s.groupBy(F.col("folder").alias("run"), "batch").agg(F.count("*").alias("files"), F.count_if(F.col("import_status") == "success").alias("imported"),
                                                                F.count_if(F.col("import_status") == "failed").alias("failed"), F.sum("seconds").alias("seconds"))


reg("k21_batch_progress", lambda t: R.batch_progress(_batches(t)), """with s as (select folder as run, (row_number() over (partition by folder order by seq) - 1) // 10 as batch, * from report_files),
    b as (select run, batch, count(*) as files, count(*) filter (where import_status = 'success') as imported, count(*) filter (where import_status = 'failed') as failed, sum(seconds) as seconds from s group by 1, 2),
    c as (select *, row_number() over w as k, count(*) over (partition by run) as n, sum(files) over w as f, sum(imported) over w as i, sum(failed) over w as x, sum(seconds) over w as sec from b window w as (partition by run order by batch))
    select run, batch, f::bigint as cum_files, i::bigint as cum_imported, x::bigint as cum_failed, sec::bigint as cum_seconds, case when k > 1 then sec::double / k * (n - k) else 0.0 end::double as estimated_remaining from c""", "report_files")
_exp = "(select name, path, size, modified from files union all select file, file, length(text) * 1000, ts from log_lines union all select report_file, path, size, run_at from report_files)"


def _kept(t):
    return (t.files.select("name", "path", "size", "modified").unionByName(t.log_lines.select(F.col("file").alias("name"), F.col("file").alias("path"), (F.length("text") * 1000).cast("bigint").alias("size"), F.col("ts").alias("modified")))
            .unionByName(t.report_files.select(F.col("report_file").alias("name"), "path", "size", F.col("run_at").alias("modified"))))


reg("k22_expired_files", lambda t: R.expired_files(_kept(t), "2024-02-05").groupBy("class").agg(F.count("*").alias("files"), F.sum("size").alias("space_freed")), f"""
    with f as (select *, case when ends_with(lower(name), '.log') then 'log' when ends_with(lower(name), '.json') then 'report' end as class from {_exp})
    select class, count(*) as files, sum(size)::bigint as space_freed from f where class is not null
      and modified < timestamp '2024-02-05' - case class when 'log' then interval 30 day else interval 90 day end group by 1""", "files", "log_lines", "report_files")
reg("k23_critical_errors", lambda t: R.critical_errors(t.log_lines), f"select trim(text) as message, count(*) as n from log_lines where {has('mapping_confidence')} and {has('CRITICAL_ERROR')} group by 1", "log_lines")
reg("k24_recent_error_density", lambda t: R.recent_error_density(t.log_lines), f"""with a as (select *, row_number() over (partition by file order by line_no desc) as rn, count(*) over (partition by file) as n from log_lines)
    select file, count(*) filter (where {has('ERROR')} or {has('ERREUR')}) as errors, count(*) filter (where {has('ERROR')} or {has('ERREUR')}) > 5 as many from a where rn <= 100 and n > 1000 group by 1""", "log_lines")
reg("k25_parse_listing", lambda t: R.parse_listing(t.log_lines), r"""
    with a as (select file, line_no, list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '\.(xlsx|xls|xlsm)$')) as w, replace(regexp_extract(text, '(?i)confidence:\S*\s+(\S+)', 1), ')', '') as c
      from log_lines where contains(lower(text), 'confidence:') and contains(lower(text), '.xls'))
    select file, line_no, w[-1] as name, coalesce(try_cast(c as double), 0) as confidence from a where len(w) > 0 and coalesce(try_cast(c as double), 0) >= 0.3""", "log_lines")
