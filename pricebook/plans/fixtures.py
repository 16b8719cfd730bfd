"""Canonical views over the driver tables.

Each view is written once, in the SQL both Spark and DuckDB accept; the few
spots where the dialects differ go through ``_D``. Spark queries start from
these frames, oracle queries from the same text as CTEs.
"""

import re
import zlib

from pyspark.sql import functions as F

from pricebook.operators.scale import freed_shuffles, write_step
from pricebook.session import checkpoint_dir

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()


class _D:
    """Dialect differences between Spark SQL and DuckDB."""

    def __init__(self, name):
        self.spark = name == "spark"

    def hid(self, e):
        """60-bit id of a text key, equal in both engines."""
        if self.spark:
            return f"cast(conv(substr(md5({e}), 1, 15), 16, 10) as bigint)"
        return f"cast('0x' || substr(md5({e}), 1, 15) as bigint)"

    def idiv(self, a, b):
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def arr(self, *e):
        return ("array(" if self.spark else "list_value(") + ", ".join(e) + ")"

    def explode_pos(self, src, arr, pos, val):
        """FROM item giving one row per array entry with its 0-based position."""
        if self.spark:
            return f"{src} lateral view posexplode({arr}) _pe as {pos}, {val}"
        return (f"(select *, unnest({arr}) as {val}, unnest(range(len({arr}))) as {pos} from {src})")

    def lines(self, e):
        return f"split({e}, '\\n')" if self.spark else f"string_split({e}, chr(10))"


def _views(d):
    rank = ("case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 "
            "when 'PROMO' then 4 when 'SMALL' then 5 else 6 end")
    brand = "cast(substr(p_brand, 7) as int)"
    unit = ("case p_size % 6 when 0 then 'u' when 1 then 'm2' when 2 then 'ml' "
            "when 3 then 'm3' when 4 then 'kg' else 'ens' end")
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    qty = "cast(l_quantity as bigint)"
    pu = d.idiv("(2 * cents + qty)", "(2 * qty)")

    def comma(c):
        return f"concat(cast({d.idiv(c, '100')} as string), ',', lpad(cast({c} % 100 as string), 2, '0'))"

    v = {}
    v["clients"] = "select c_custkey as id_client, c_name as nom_client from customer"
    v["dpgf"] = """
        select o_orderkey as id_dpgf, o_custkey as id_client,
               concat('Projet ', cast(o_orderkey as string)) as nom_projet,
               cast(o_orderdate as date) as date_dpgf,
               case o_orderstatus when 'P' then 'en_cours' when 'F' then 'acceptee' else 'refusee' end as statut_offre,
               concat('DPGF Lot ', lpad(cast(o_orderkey % 20 + 1 as string), 2, '0'), ' - ',
                      o_orderpriority, '.xlsx') as fichier_source
        from orders"""
    v["lines"] = f"""
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, {qty} as qty, {cents} as cents,
               {d.idiv(f'(2 * {cents} + {qty})', f'(2 * {qty})')} as pu_cents,
               l_returnflag, l_linestatus, l_shipdate,
               p_name, p_type, p_brand, p_size, {rank} as rang, {brand} as marque, {unit} as unite
        from lineitem join part on l_partkey = p_partkey"""
    v["lots"] = """
        select l_orderkey * 10 + rang as id_lot, l_orderkey as id_dpgf,
               lpad(cast(rang as string), 2, '0') as numero_lot, p_type as nom_lot
        from lines group by l_orderkey, rang, p_type
        union all
        select o_orderkey * 10, o_orderkey, '00', 'Lot vide'
        from orders where o_orderpriority = '1-URGENT'"""
    v["sections"] = """
        select (l_orderkey * 10 + rang) * 100 as id_section, l_orderkey * 10 + rang as id_lot,
               cast(null as bigint) as section_parent_id, cast(rang as string) as numero_section,
               p_type as titre_section, 1 as niveau_hierarchique
        from lines group by l_orderkey, rang, p_type
        union all
        select (l_orderkey * 10 + rang) * 100 + marque, l_orderkey * 10 + rang,
               (l_orderkey * 10 + rang) * 100,
               concat(cast(rang as string), '.', cast(marque as string)), p_brand, 2
        from lines group by l_orderkey, rang, marque, p_brand"""
    v["elements"] = f"""
        select {d.hid("concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cents as string), cast(qty as string), cast(cast(l_shipdate as date) as string))")} as id_element,
               case when l_returnflag = 'R' and l_linestatus = 'O' then null
                    else (l_orderkey * 10 + rang) * 100 + marque end as id_section,
               l_orderkey * 10 + rang as id_lot, p_name as designation_exacte,
               concat(p_type, ' ', cast(p_size as string), 'x', cast(l_linenumber as string)) as description,
               unite, cast(qty as decimal(12,3)) as quantite,
               cast(pu_cents * 0.01 as decimal(15,2)) as prix_unitaire_ht,
               cast(cents * 0.01 as decimal(18,2)) as prix_total_ht,
               l_linestatus = 'F' as offre_acceptee, cast(l_shipdate as timestamp) as created_at
        from lines"""
    # chains of 16 sections; some start at a lost parent, some close to a cycle
    v["deep_sections"] = """
        select p_partkey as id_section, cast(1 as bigint) as id_lot,
               case when p_partkey % 16 <> 0 then p_partkey - 1
                    when p_partkey % 160 = 0 then -1 - p_partkey
                    when p_partkey % 160 = 16 then p_partkey + 15 end as section_parent_id,
               cast(p_partkey as string) as numero_section, p_brand as titre_section, 1 as niveau_hierarchique
        from part"""
    v["elements_flat"] = """
        select e.id_element, e.id_lot, e.id_section, e.designation_exacte as designation, e.description,
               e.unite, e.quantite, e.prix_unitaire_ht as prix_unitaire, e.prix_total_ht as prix_total,
               e.created_at, e.offre_acceptee, l.numero_lot, l.nom_lot, s.numero_section, s.titre_section,
               d.id_dpgf, d.nom_projet, d.date_dpgf, d.fichier_source, c.id_client, c.nom_client
        from elements e join lots l on e.id_lot = l.id_lot
        left join sections s on e.id_section = s.id_section
        join dpgf d on l.id_dpgf = d.id_dpgf
        join clients c on d.id_client = c.id_client"""
    v["files"] = """
        select concat('/src/', cast(o_orderkey % 10 as string), '/', fichier_source) as path,
               fichier_source as name, cast(round(o_totalprice * 10) as bigint) as size,
               cast(o_orderdate as timestamp) as modified, o_orderkey as file_id,
               concat('/src/', cast(o_orderkey % 10 as string)) as folder
        from orders join dpgf on o_orderkey = id_dpgf"""
    # one workbook per supplier, one sheet per part type plus a cover sheet
    v["workbooks"] = """
        select s_suppkey as file_id,
               case when s_suppkey % 7 = 0 then concat('BPU Mairie de ', n_name, '.xlsx')
                    when s_suppkey % 7 = 1 then concat('DQE_lot_', cast(s_suppkey % 20 + 1 as string), '_', lower(n_name), '.xlsx')
                    else concat('DPGF Lot ', lpad(cast(s_suppkey % 20 + 1 as string), 2, '0'), ' - Gros oeuvre ', n_name, '.xlsx') end as name,
               n_name as pays
        from supplier join nation on s_nationkey = n_nationkey"""
    sec_txt = """case marque % 6
                 when 0 then concat(cast(rang as string), '.', cast(marque as string), ' Fourniture ', p_brand)
                 when 1 then concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', marque, 1), '. Ouvrages ', p_brand)
                 when 2 then concat('TRAVAUX DE ', p_type, ' ', translate(cast(marque as string), '0123456789', 'ABCDEFGHIJ'))
                 when 3 then concat('II - Prestations ', p_brand)
                 when 4 then concat('Chapitre ', cast(marque as string), ' : ', lower(p_type))
                 else concat(cast(rang as string), '.', cast(marque as string), '.1 Pose ', p_brand) end"""
    body_order = "marque, ord, l_orderkey, l_linenumber, l_partkey, cents, qty"
    line_cells = f"""concat(p_name, ' ', cast(p_size as string), 'x', cast(l_linenumber as string)),
               case when l_linestatus = 'F' then unite when l_returnflag = 'A' then upper(unite) else '' end,
               cast(qty as string),
               case when l_returnflag = 'R' then '' else {comma('pu_cents')} end,
               concat({comma('cents')}, case when l_returnflag = 'N' then ' €' else '' end)"""
    more_cells = "'y compris pose et fixation', '', '', '', ''"
    v["body"] = f"""
        select l_suppkey as file_id, rang, p_type, marque, 0 as ord, cast(0 as bigint) as l_orderkey, 0 as l_linenumber,
               cast(0 as bigint) as l_partkey, cast(0 as bigint) as cents, cast(0 as bigint) as qty, {sec_txt} as c0, '' as c1, '' as c2, '' as c3, '' as c4
        from lines group by l_suppkey, rang, p_type, marque, p_brand
        union all
        select l_suppkey, rang, p_type, marque, 1, l_orderkey, l_linenumber, l_partkey, cents, qty,
               {line_cells}
        from lines
        union all
        select l_suppkey, rang, p_type, marque, 2, l_orderkey, l_linenumber, l_partkey, cents, qty,
               {more_cells}
        from lines where l_linenumber = 7"""
    v["body_rows"] = f"""
        select file_id, rang, p_type, c0, c1, c2, c3, c4, cents, ord,
               cast(3 + row_number() over (partition by file_id, rang order by {body_order}) as int) as rn
        from body"""
    covers = f"""select file_id, 'Page de garde', cast(k as int),
               case k when 0 then {d.arr("concat('Mairie de ', pays)", "''", "''", "''", "''")}
                      when 1 then {d.arr("concat('Projet : construction du groupe scolaire ', pays)", "''", "''", "''", "''")}
                      else {d.arr("concat('Maître d''ouvrage : Ville de ', pays)", "''", "''", "''", "''")} end
        from workbooks cross join (select 0 as k union all select 1 union all select 2) ks"""
    v["rows"] = f"""
        select file_id, concat('Lot ', lpad(cast(rang as string), 2, '0')) as sheet, rn as row,
               {d.arr('c0', 'c1', 'c2', 'c3', 'c4')} as cells
        from body_rows
        union all
        select file_id, concat('Lot ', lpad(cast(rang as string), 2, '0')), cast(k as int),
               case k when 0 then {d.arr("concat('LOT ', lpad(cast(rang as string), 2, '0'), ' - ', p_type)", "''", "''", "''", "''")}
                      when 2 then {d.arr("'Désignation'", "'Unité'", "'Quantité'", "'P.U. HT'", "'Montant HT'")}
                      else {d.arr("''", "''", "''", "''", "''")} end
        from (select distinct file_id, rang, p_type from body_rows) s
        cross join (select 0 as k union all select 1 union all select 2) ks
        union all
        select file_id, concat('Lot ', lpad(cast(rang as string), 2, '0')), max(rn) + 1,
               {d.arr("concat('TOTAL LOT ', lpad(cast(rang as string), 2, '0'))", "''", "''", "''", comma('cast(sum(case when ord = 1 then cents else 0 end) as bigint)'))}
        from body_rows group by file_id, rang
        union all
        {covers}"""
    if d.spark:
        # the rows of ``body`` numbered after one shuffle of the lines by sheet (``placed``): each line gives its row, its
        # section the row above its first line, a seventh line the row below it; order as in ``body_order``, then type and brand
        v["grid_lines"] = """
            select l_suppkey as file_id, concat('Lot ', lpad(cast(rang as string), 2, '0')) as sheet, rang, p_type, marque, p_brand,
                   p_name, p_size, l_orderkey, l_linenumber, l_partkey, cents, qty, l_returnflag, l_linestatus from lines"""
        v["grid_sections"] = """
            select *, row_number() over (partition by file_id, sheet, p_type, marque, p_brand order by l_orderkey) = 1 as opens from placed"""
        v["grid_marks"] = """
            select *, explode(array_compact(array(case when opens then 0 end, 1, case when l_linenumber = 7 then 2 end))) as ord from grid_sections"""
        keys = ", ".join(f"case when ord = 0 then 0 else {k} end" for k in ("l_orderkey", "l_linenumber", "l_partkey", "cents", "qty"))
        v["grid_numbered"] = f"""
            select *, {unit} as unite, {pu} as pu_cents,
                   cast(3 + row_number() over (partition by file_id, sheet order by marque, ord, {keys}, p_type desc, p_brand) as int) as rn
            from grid_marks"""
        v["grid_body"] = f"""
            select file_id, sheet, rn as row,
                   case ord when 0 then array({sec_txt}, '', '', '', '') when 1 then array({line_cells}) else array({more_cells}) end as cells,
                   rang, p_type, case when ord = 1 then cents else 0 end as cents
            from grid_numbered"""
        # the rows that ``rows`` adds to the body: heads and totals of the sheets (from the stored body), covers
        v["grid_sheets"] = """
            select file_id, sheet, rang, collect_list(struct(p_type)) as types, max(n) as n, cast(sum(cents) as bigint) as cents
            from (select file_id, sheet, rang, p_type, max(row) as n, sum(cents) as cents from grid group by file_id, sheet, rang, p_type)
            group by file_id, sheet, rang"""
        v["grid_rest"] = f"""
            select file_id, sheet, x.row, x.cells from (
              select file_id, sheet, explode(concat(flatten(transform(types, t -> array(
                struct(0 as row, array(concat('LOT ', lpad(cast(rang as string), 2, '0'), ' - ', t.p_type), '', '', '', '') as cells),
                struct(1 as row, array('', '', '', '', '') as cells),
                struct(2 as row, array('Désignation', 'Unité', 'Quantité', 'P.U. HT', 'Montant HT') as cells)))),
                array(struct(n + 1 as row, array(concat('TOTAL LOT ', lpad(cast(rang as string), 2, '0')), '', '', '', {comma('cents')}) as cells)))) as x
              from grid_sheets)
            union all {covers}"""
    v["cells"] = f"""
        select file_id, sheet, row, cast(c as int) as col, txt as text
        from {d.explode_pos('rows', 'cells', 'c', 'txt')}"""
    ev = d.idiv("event_id", "8")
    name = "concat('DPGF_', cast(user_id as string), '.xlsx')"
    v["log_lines"] = f"""
        select concat('run_', cast(event_id % 8 as string), '.log') as file, {ev} as line_no,
               case event_type
                 when 'error' then case user_id % 4
                   when 0 then concat('2024-01-01 10:00:00 ERROR Erreur Excel: openpyxl error fichier ', {name})
                   when 1 then concat('Échec import du fichier ', {name}, ' : database error')
                   when 2 then 'timeout sharepoint, connection error' else 'WARNING mapping_confidence CRITICAL_ERROR' end
                 when 'purchase' then case user_id % 3
                   when 0 then concat('Import réussi ', {name})
                   when 1 then concat('Import technique réussi mais AUCUNE DONNÉE ', {name})
                   else concat('Fichier identifié ', {name}, ' (confidence: 0.', cast(event_id % 10 as string), ')') end
                 when 'view' then concat(cast(event_id % 5 as string), ' lots, ', cast(event_id % 7 as string), ' sections, ', cast(event_id % 11 as string), ' éléments')
                 when 'signup' then case user_id % 2
                   when 0 then concat('traitement terminé en ', cast(cast(round(value * 100) as bigint) as string), ' secondes')
                   else concat(cast(event_id % 9 as string), ' fichiers traités avec succès, total de ', cast(event_id % 9 + event_id % 3 as string), ' fichiers') end
                 else case user_id % 6
                   when 0 then concat('[', {name}, '] LOT DÉTECTÉ - Méthode: filename')
                   when 1 then '==== DÉTECTION DE LOT ====' when 2 then 'LOT NON DÉTECTÉ - Méthode: content'
                   when 3 then '==== DÉTECTION DES SECTIONS ET ÉLÉMENTS ====' when 4 then 'SECTION PAR DÉFAUT CRÉÉE - Numéro: 1'
                   else concat('[', {name}, '] LOT DÉTECTÉ - Méthode: content') end end as text,
               cast(ts as timestamp) as ts
        from events"""
    # identified files of run reports: one report per order month, one folder per order digit
    v["report_files"] = """
        select concat('workflow_', substr(cast(cast(o_orderdate as date) as string), 1, 7), '.json') as report_file,
               concat('/src/', cast(o_orderkey % 10 as string)) as folder, path, name,
               case when o_orderpriority like '1%' then 'BPU' when o_orderpriority like '2%' then 'DQE' else 'DPGF' end as type,
               cast(o_orderkey % 7 + 3 as double) / cast(10 as double) as confidence,
               case o_orderstatus when 'F' then 'success' when 'P' then 'failed' else case o_orderkey % 2 when 0 then 'unknown' else 'not_attempted' end end as import_status,
               o_orderkey % 3 as lots_imported, o_orderkey % 3 * 4 as sections_imported, o_orderkey % 3 * 20 as elements_imported,
               size, o_orderkey as seq, cast(o_orderdate as timestamp) as run_at,
               cast(cast(round(o_totalprice) as bigint) % 900 as bigint) as seconds, cast(o_orderkey % 3 + 1 as int) as attempts
        from orders join files on o_orderkey = file_id"""
    v["metrics"] = """
        select event_type as name, cast(round(value * 100) as bigint) as value_cents, value, cast(ts as timestamp) as ts,
               event_id as seq, concat('run_', cast(user_id % 8 as string), '.log') as source_file
        from events"""
    v["texts"] = f"""
        select doc_id, cast(p as int) as line_no, line as text, lang, source
        from {d.explode_pos('documents', d.lines('text'), 'p', 'line')}"""
    return v


_SPARK, _DUCK = _views(_D("spark")), _views(_D("duckdb"))


def _closure(views, names, stop=()):
    """The named views and all they read, in order of definition; ``stop`` views are not expanded."""
    want, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n in views and n not in want:
            want.add(n)
            if n not in stop:
                todo += [m for m in views if m != n and re.search(rf"\b(from|join)\s+\(?(select \*.*\bfrom\s+)?{m}\b|\bfrom {m}\b", views[n], re.S)]
    return [n for n in views if n in want]


def oracle(sql, *names):
    """DuckDB text: the named views as CTEs in front of ``sql``."""
    ctes = ", ".join(f"{n} as materialized ({_DUCK[n]})" for n in _closure(_DUCK, names))
    sql = sql.strip()
    if not ctes:
        return sql
    if sql[:5].lower() == "with ":
        rec = sql[5:].strip()
        if rec[:10].lower() == "recursive ":
            return f"with recursive {ctes}, {rec[10:]}"
        return f"with {ctes}, {rec}"
    return f"with {ctes} {sql}"


# Entity tables and grids a deployment keeps in storage: written once per
# application to the shared folder, then read by every query.
STORED = ("lots", "sections", "elements", "rows")
SHEET = ("file_id", "sheet")
BUCKET_LINES = 400_000      # so many lines a bucket of the stored grid, at most: sorted in memory
_written = {}


class Tables:
    """Driver tables and canonical views of one data folder as DataFrames."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def base(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name):
        if name in BASE:
            return self.base(name)
        if name not in _SPARK:
            raise AttributeError(name)
        return self._stored(name) if name in STORED else self._view(name)

    def _view(self, name):
        stop = [n for n in STORED if n != name]
        used = _closure(_SPARK, [name], stop)
        inputs = {n: self._stored(n) for n in used if n in stop}
        text = ", ".join(f"{n} as ({_SPARK[n]})" for n in used if n not in stop)
        inputs.update({b: self.base(b) for b in BASE if re.search(rf"\b{b}\b", text)})
        ctes = [f"{n} as (select * from {{{n}}})" for n in inputs]
        return self.spark.sql(f"with {', '.join(ctes)}, {text} select * from {name}", **inputs)

    def _stored(self, name):
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _written:
            path = f"{checkpoint_dir(self.spark)}/canonical-{key[0]}-{zlib.crc32(self.dir.encode()):08x}/{name}"
            if name == "rows":
                table = re.sub(r"\W", "_", f"canonical_{'_'.join(path.split('/')[-2:])}")
                self._write_rows(path, table)
                _written[key] = table
            else:
                write_step(self._view(name), path, "overwrite")
                _written[key] = path
        if name == "rows":
            return self.spark.table(_written[key]).select("file_id", "sheet", "row", "cells")
        return self.spark.read.parquet(_written[key])

    def _write_rows(self, path, table):
        """The view ``rows`` as a table in buckets of whole sheets, so that work by sheet needs no shuffle.

        Lines are joined, shuffled and sorted once; what a sheet has besides is read off the written body.
        """
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.lineitem.count() // BUCKET_LINES)

        def put(df, mode):
            with freed_shuffles(self.spark):
                df.write.bucketBy(n, *SHEET).option("path", path).option("compression", "zstd").mode(mode).saveAsTable(table)

        def sql(name, **inputs):
            used = [v for v in _closure(_SPARK, [name], inputs) if v not in inputs]
            ctes = [f"{i} as (select * from {{{i}}})" for i in inputs] + [f"{v} as ({_SPARK[v]})" for v in used]
            return self.spark.sql(f"with {', '.join(ctes)} select * from {name}", **inputs)

        put(sql("grid_body", placed=self.grid_lines.repartition(n, *SHEET)), "overwrite")
        grid = self.spark.table(table)
        rest = sql("grid_rest", grid=grid, workbooks=self.workbooks).repartition(n, *SHEET)
        put(rest.select("*", *[F.lit(None).cast(t).alias(c) for c, t in grid.dtypes[4:]]), "append")
