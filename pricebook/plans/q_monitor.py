"""Registered queries: monitoring in batch form (L); streaming forms are tested against these."""

from pyspark.sql import functions as F

from pricebook.plans.fixtures import oracle
from pricebook.plans.q_runs import m
from pricebook.streaming import monitor as M

PLANS = {}


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


def day(df, c="ts"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


LM = f"""lm as (select file as source_file, line_no, ts, 'processing_time' as name, unnest(regexp_extract_all(text, '(?i){M.PROCESSING}', 1))::double as value from log_lines
    union all select file, line_no, ts, 'success_rate', try_cast(regexp_extract(text, '(?i){M.SUCCESS}', 1) as double) / try_cast(regexp_extract(text, '(?i){M.TOTAL}', 1) as double) from log_lines
      where try_cast(regexp_extract(text, '(?i){M.TOTAL}', 1) as double) > 0 and regexp_matches(text, '(?i){M.SUCCESS}')
    union all select file, line_no, ts, 'error_count', len(regexp_extract_all(text, '(?i){M.ERRORS}'))::double from log_lines where len(regexp_extract_all(text, '(?i){M.ERRORS}')) > 0)"""
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts"
reg("l01_extract_metrics", lambda t: day(M.extract_metrics(t.log_lines)), f"with {LM} select name, value, {TS}, source_file, line_no from lm", "log_lines")
reg("l01_file_success_rate", lambda t: M.file_success_rate(t.log_lines), f"""with a as (select file, line_no, case when {m('text', M.SUCCESS)} then regexp_extract_all(text, '(?i){M.SUCCESS}', 1)[-1] end as s,
    case when {m('text', M.TOTAL)} then regexp_extract_all(text, '(?i){M.TOTAL}', 1)[-1] end as t from log_lines),
    b as (select file, (arg_max(s, line_no) filter (where s is not null))::double as s, (arg_max(t, line_no) filter (where t is not null))::double as t from a group by 1)
    select file as source_file, s / t as success_rate from b where t > 0 and s is not null""", "log_lines")
AH = "ah as (" + " union all ".join(f"select file, line_no, ts, text, '{f}' as error_type, " + " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in ps) + " as n from log_lines"
                                    for f, ps in M.ALERT_FAMILIES.items()) + ")"
EA = f"""{AH}, ea as (select file as source_file, error_type, sum(n)::bigint as occurrences, max(ts) as ts, string_agg(text, '|' order by line_no) filter (where rn <= 5) as matches
    from (select *, row_number() over (partition by file, error_type order by line_no) as rn from ah where n > 0) group by 1, 2)"""
reg("l02_error_alerts", lambda t: day(M.error_alerts(t.log_lines)).withColumn("matches", F.array_join("matches", "|")),
    f"with {EA} select 'warning' as level, 'Erreur détectée: ' || error_type as title, error_type, occurrences, matches, source_file, {TS} from ea", "log_lines")
reg("l02_error_alerts_window", lambda t: day(day(M.error_alerts_stream(t.log_lines), "start"), "end").withColumn("matches", F.array_join("matches", "|")),
    f"""with {AH}, w as (select *, time_bucket(interval 5 minutes, ts) as s from ah where n > 0 and ts is not null),
    r as (select *, row_number() over (partition by s, file, error_type order by line_no, text) as rn from w)
    select strftime(s, '%Y-%m-%d %H:%M:%S') as "start", strftime(s + interval 5 minutes, '%Y-%m-%d %H:%M:%S') as "end", error_type,
    sum(n)::bigint as occurrences, string_agg(text, '|' order by line_no, text) filter (where rn <= 5) as matches, file as source_file
    from r group by s, file, error_type""", "log_lines")
_b = " union all ".join(f"select '{n}' as name, '{o}' as op, {b}::double as bound, '{lv}' as level, '{t}' as title" for n, o, b, lv, t in M.BOUNDS)
TA = f"{LM}, ta as (select level, title, lm.name, value, bound, ts, source_file from lm join ({_b}) b on lm.name = b.name where case when op = '>' then value > bound else value < bound end)"
reg("l03_threshold_alerts", lambda t: day(M.threshold_alerts(M.extract_metrics(t.log_lines))), f"with {TA} select level, title, name, value, bound, {TS}, source_file from ta", "log_lines")
reg("l04_metric_history", lambda t: M.metric_history(t.metrics, 1000).select("name", "seq", "value", "rank"),
    "select name, seq, value, rank::int as rank from (select *, row_number() over (partition by name order by ts desc, seq desc) as rank from metrics) where rank <= 1000", "metrics")
NOW = "2024-01-15 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


MS = """ms as (select name, count(*) as total_count, count(*) filter (where ts > now - interval 1 hour) as recent_count, coalesce(sum(value::decimal(18,4))::double / count(*), 0) as average,
    coalesce(sum(value::decimal(18,4)) filter (where ts > now - interval 1 hour)::double / nullif(count(*) filter (where ts > now - interval 1 hour), 0), 0) as recent_average,
    min(value) as min, max(value) as max, arg_max(value, (ts, seq)) as last_value from (select *, timestamp '{n}' as now from {src}) group by name)"""
reg("l05_metric_summary", lambda t: M.metric_summary(t.metrics, now()), f"with {MS.format(n=NOW, src='metrics')} select * from ms", "metrics")


def _alerts(t):
    a = M.error_alerts(t.log_lines).select("level", "title", "error_type", "ts")
    return a.unionByName(M.threshold_alerts(M.extract_metrics(t.log_lines)).select("level", "title", F.lit(None).cast("string").alias("error_type"), "ts"))


AL = f"{TA}, {EA}, al as (select 'warning' as level, 'Erreur détectée: ' || error_type as title, error_type, ts from ea union all select level, title, null, ts from ta)"
reg("l07_recent_alerts", lambda t: day(M.recent_alerts(_alerts(t), now(), 24)).fillna("unknown", ["error_type"]),
    f"with {AL} select level, title, coalesce(error_type, 'unknown') as error_type, {TS} from al where ts > timestamp '{NOW}' - interval 24 hour", "log_lines")
reg("l07_commonest_family", lambda t: M.commonest_family(M.recent_alerts(_alerts(t), now(), 24)),
    f"with {AL} select coalesce(error_type, 'unknown') as error_type, count(*) as n from al where ts > timestamp '{NOW}' - interval 24 hour group by 1 order by n desc, error_type limit 1", "log_lines")


def _health(t):
    lm = M.extract_metrics(t.log_lines).withColumn("seq", F.col("line_no"))
    return M.health(M.metric_summary(lm, now()), M.recent_alerts(_alerts(t), now(), 1))


HE = f"""{AL}, sm as (select *, line_no as seq from lm), {MS.format(n=NOW, src='sm')},
    e as (select count(*) filter (where level in ('error', 'critical')) as errors from al where ts > timestamp '{NOW}' - interval 1 hour),
    s as (select max(recent_average) filter (where name = 'processing_time') as t, max(recent_average) filter (where name = 'success_rate') as r from ms),
    h as (select errors, 100 - 10 * errors - case when t > 300 then 20 else 0 end - case when r < 0.8 then 30 else 0 end as score from e, s),
    he as (select *, case when score >= 80 then 'healthy' when score >= 60 then 'warning' else 'critical' end as status from h)"""
reg("l08_health", _health, f"with {HE} select * from he", "log_lines")
reg("l09_health_alerts", lambda t: M.health_alerts(_health(t)), f"""with {HE} select case status when 'critical' then 'critical' else 'warning' end as level,
    case status when 'critical' then 'Santé du système critique' else 'Santé du système dégradée' end as title, score from he where status <> 'healthy'""", "log_lines")
reg("l10_dedupe_lines", lambda t: M.dedupe_lines(t.log_lines.unionByName(t.log_lines)).groupBy("file").agg(F.count("*").alias("lines")),
    "select file, count(*) as lines from log_lines group by 1", "log_lines")
