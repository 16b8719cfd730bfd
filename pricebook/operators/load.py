"""Entity resolution and the import job over many workbooks."""

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.functions.text import any_word
from pricebook.operators import grid as G
from pricebook.operators import identify as I
from pricebook.operators import items as T
from pricebook.operators.scale import dense_ids, hash_id
from pricebook.schema import ENTITIES, enforce_schema
from pricebook.session import checkpoint_dir
from pricebook.sources import versions
from pricebook.sources.files import base_name
from pricebook.sources.reports import ERROR_SCHEMA
from pricebook.sources.workbooks import read_workbook_rows

BUCKETS = 256


def _resolve(incoming, existing, keys, id_col, payload, order):
    """One row per key: known ids reused, new keys numbered after the largest id; first payload wins."""
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("_p")).select(*keys, "_p.*")
    known = existing.groupBy(*keys).agg(F.min(id_col).alias(id_col))
    top = existing.agg(F.max(id_col).alias("max_id"))
    joined = first.join(known, list(keys), "left")
    old = joined.filter(F.col(id_col).isNotNull()).withColumn("created", F.lit(False))
    new = dense_ids(joined.filter(F.col(id_col).isNull()).drop(id_col), list(keys), top, id_col).withColumn("created", F.lit(True))
    return old.unionByName(new)


def resolve_clients(names: DataFrame, clients: DataFrame, exact_case=False) -> DataFrame:
    """Client per name, ignoring case; blank names are dropped (a client name is required)."""
    key = F.col("nom_client") if exact_case else F.upper("nom_client")
    return _resolve(names.filter(F.trim("nom_client") != "").withColumn("client_key", key),
                    clients.withColumn("client_key", key), ["client_key"], "id_client", ["nom_client"], F.col("nom_client"))


def resolve_dpgf(files: DataFrame, dpgf: DataFrame, today=None, keys=("id_client", "fichier_source"), payload=("nom_projet",)) -> DataFrame:
    """Document per (client, source file), or per other keys; new ones are open and dated today."""
    r = _resolve(files, dpgf, list(keys), "id_dpgf", list(payload), F.struct(*payload))
    return r.withColumn("date_dpgf", F.lit(today).cast("date") if today else F.current_date()).withColumn("statut_offre", F.lit("en_cours"))


def unique_project(project, source):
    """Project name that tells files apart: the file name is added where it is not part of it."""
    return F.when(F.instr(project, source) > 0, project).otherwise(F.concat(project, F.lit(" - "), source))


def lot_number():
    return F.when(F.trim(F.coalesce("numero_lot", F.lit(""))) == "", "1").otherwise(F.trim("numero_lot"))


def resolve_lots(lots_in: DataFrame, lots: DataFrame) -> DataFrame:
    """Lot per (document, number); a blank number is 1, a blank name is "Lot n"."""
    num = lot_number()
    df = lots_in.withColumn("nom_lot", F.when(
        F.trim(F.coalesce("nom_lot", F.lit(""))) == "", F.concat(F.lit("Lot "), num)).otherwise(F.col("nom_lot"))).withColumn("numero_lot", num)
    return _resolve(df, lots, ["id_dpgf", "numero_lot"], "id_lot", ["nom_lot"], F.col("nom_lot"))


def resolve_sections(sections_in: DataFrame, sections: DataFrame, order="row") -> DataFrame:
    """Section per (lot, number); the first title wins."""
    return _resolve(sections_in, sections, ["id_lot", "numero_section"], "id_section",
                    ["titre_section", "niveau_hierarchique"], F.struct(order, "titre_section"))


def load_elements(items: DataFrame) -> DataFrame:
    """Element rows in storage types; a missing total is quantity x unit price."""
    q, pu, pt = (F.coalesce(c, F.lit(0.0)) for c in ("quantite", "prix_unitaire", "prix_total"))
    total = F.when((pt == 0) & (pu > 0) & (q > 0), pu * q).otherwise(pt)
    return items.select(
        "id_element", "id_section", "id_lot", "id_dpgf",
        F.substring(F.coalesce("designation", F.lit("Description manquante")), 1, 500).alias("designation_exacte"),
        F.substring(F.coalesce("unite", F.lit("")), 1, 10).alias("unite"), q.try_cast("decimal(12,3)").alias("quantite"),
        pu.try_cast("decimal(15,2)").alias("prix_unitaire_ht"), total.try_cast("decimal(18,2)").alias("prix_total_ht"),
        F.lit(False).alias("offre_acceptee"))


def import_stats(rows, resolved: dict, elements, errors) -> DataFrame:
    """Counters of one import: rows read, created and reused per entity, elements, errors."""
    out = rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("counter"), "n")
    for name, df in resolved.items():
        for flag, label in ((True, "created"), (False, "reused")):
            out = out.unionByName(df.filter(F.col("created") == flag).agg(F.count("*").alias("n"))
                                  .select(F.lit(f"{name}_{label}").alias("counter"), "n"))
    out = out.unionByName(elements.agg(F.count("*").alias("n")).select(F.lit("elements_created").alias("counter"), "n"))
    return out.unionByName(errors.agg(F.count("*").alias("n")).select(F.lit("errors").alias("counter"), "n"))


def layout(rows: DataFrame, files: DataFrame | None = None, saved: DataFrame | None = None) -> DataFrame:
    """Column mapping per sheet: saved for its signature, by header wording with inferred neighbours, or without a header.

    Sheets without a header are mapped by content; those of shared forms (several sheets per workbook) by their numbering
    column first. ``saved`` needs the ``files`` for the signatures.
    """
    heads = G.find_header_row(rows)
    m = G.infer_positions(G.map_columns(heads))
    guess = G.text_column(rows, heads).select(*I.SHEET, F.col("designation").alias("_d"))
    m = m.join(guess, I.SHEET, "left").withColumn("designation", F.coalesce("designation", "_d")).drop("_d", "header_score")
    if saved is not None:
        m = G.apply_saved_mappings(m, files, saved).drop("signature")
    m = m.withColumn("manual", F.lit(False)) if saved is None else m
    bare = rows.join(heads.select(*I.SHEET), I.SHEET, "left_anti")
    forms = I.is_multi_sheet_form(rows).filter("multi_sheet_form").select("file_id", F.lit(True).alias("_form"))
    shared = G.map_columns_shared(bare.join(forms, "file_id", "left_semi")).filter(
        "designation is not null and coalesce(quantite, prix_unitaire, prix_total) is not null")
    blind = G.numeric_columns(bare).drop("ranked").join(shared.select(*I.SHEET), I.SHEET, "left_anti")
    other = shared.unionByName(blind.select(*shared.columns))
    other = other.withColumn("header_row", F.lit(None).cast("int")).withColumn("headers", F.lit(None).cast("array<string>"))
    return m.unionByName(other.withColumn("manual", F.lit(False)).select(*m.columns))


def schedule_sheets(rows: DataFrame, mapping: DataFrame, sheets="best") -> DataFrame:
    """(file_id, sheet) to load: the best sheet of each workbook, or all that are laid out as a price schedule.

    With ``all`` a sheet counts if it is no cover and its mapping names the text and a price or quantity column; a
    workbook without such a sheet keeps its best one.
    """
    best = I.best_sheet(rows).select("file_id", "sheet")
    if sheets == "best":
        return best
    if sheets != "all":
        raise ValueError(sheets)
    priced = F.coalesce("prix_unitaire", "prix_total", "quantite").isNotNull() & F.col("designation").isNotNull()
    some = mapping.filter(priced & ~F.lower("sheet").rlike(any_word(I.SHEET_SKIP))).select("file_id", "sheet").distinct()
    return some.unionByName(best.join(some, "file_id", "left_anti"))


def sheet_lots(rows: DataFrame, chosen: DataFrame, lots: DataFrame) -> DataFrame:
    """Lot per chosen sheet: its own title rows, then its name, then the lot of the workbook.

    In a workbook of which one sheet is chosen, the lot of the workbook comes first.
    """
    titles = G.lot_from_content(rows).groupBy(*I.SHEET).agg(F.min_by(F.struct("numero_lot", "nom_lot"), F.struct("row", "col")).alias("t"))
    named = G.lot_from_filename(chosen.select(F.struct("file_id", "sheet").alias("file_id"), F.col("sheet").alias("name")))
    named = named.filter("numero_lot is not null").select("file_id.*", F.struct("numero_lot", "nom_lot").alias("s"))
    count = chosen.groupBy("file_id").agg(F.count("*").alias("_n"))
    df = (chosen.join(count, "file_id").join(titles, I.SHEET, "left").join(named, I.SHEET, "left")
          .join(lots.select("file_id", F.struct("numero_lot", "nom_lot").alias("w")), "file_id"))
    return df.select(*I.SHEET, F.when(F.col("_n") == 1, F.col("w")).otherwise(F.coalesce("t", "s", "w")).alias("l")).select(*I.SHEET, "l.*")


def extract_document(rows: DataFrame, files: DataFrame, profile="main", sheets="best", saved=None, external=None, stage=None):
    """Everything an import would load, without loading: facts per file and sheet, and the item stream.

    ``external`` holds lots known from elsewhere (file_id, numero_lot, nom_lot). ``level`` and ``manual`` tell how far
    the columns of the sheet can be trusted. ``stage(df, name)`` may write what is read more than once.
    """
    stage = stage or (lambda df, name: df)
    mapping = stage(layout(rows, files, saved), "mapping")
    chosen = stage(schedule_sheets(rows, mapping, sheets), "chosen")
    body = rows.join(chosen, I.SHEET, "left_semi")
    client = stage(G.detect_client(files, rows), "client")
    lots = sheet_lots(body, chosen, stage(G.detect_lot(files, body, external), "lot"))
    sure = G.mapping_confidence(mapping).select(*I.SHEET, F.col("level").alias("_l"), F.col("manual").alias("_m"))
    facts = (client.join(G.project_name(files, rows, client).select("file_id", "project"), "file_id")
             .join(lots, "file_id").join(sure, I.SHEET, "left")
             .withColumn("level", F.coalesce("_l", F.lit("low"))).withColumn("manual", F.coalesce("_m", F.lit(False))).drop("_l", "_m"))
    return facts, T.parse_items(body, mapping.drop("headers", "manual").join(chosen, I.SHEET, "left_semi"), profile)


# ---- the job ----------------------------------------------------------------------------------------

DOCUMENTS = "source_path string, id_client bigint, id_dpgf bigint"
STORED_ELEMENTS = ("id_element bigint, id_section bigint, id_lot bigint, id_dpgf bigint, designation_exacte string, unite string, "
                   "quantite decimal(12,3), prix_unitaire_ht decimal(15,2), prix_total_ht decimal(18,2), offre_acceptee boolean")
SCHEMAS = {name: ", ".join(f"{c} {t}" for c, t, _, _ in cols) for name, cols in ENTITIES.items()}
SCHEMAS |= {"documents": DOCUMENTS, "elements": STORED_ELEMENTS, "errors": ERROR_SCHEMA}


def stored(spark, warehouse, name, number=None) -> DataFrame:
    """A stored table, as of the newest commit or of a given one."""
    return versions.read(spark, warehouse, versions.version(spark, warehouse, number), name, SCHEMAS[name])


def stored_elements(spark, warehouse) -> DataFrame:
    """The elements loaded so far."""
    return stored(spark, warehouse, "elements")


def _stage(spark, df, base, name):
    """Write a step to the shared folder and go on from the files: short lineage, no recomputation."""
    path = f"{base}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Found(NamedTuple):
    """What an import has found in workbooks, written to the shared folder."""

    rows: DataFrame
    facts: DataFrame
    items: DataFrame
    damaged: DataFrame
    base: str


def detect_workbooks(spark, grid, run_id, profile="main", sheets="best", saved=None, external=None) -> Found:
    """Decoded workbook rows -> documents, lots and items; a workbook with a damaged part is left out whole."""
    base = f"{checkpoint_dir(spark)}/import-{run_id}-{uuid.uuid4().hex}"
    grid = _stage(spark, grid, base, "grid")
    damaged = grid.filter("error is not null").select("path", "error")
    rows = (grid.filter("error is null").select("file_id", "path", "sheet", "row", "cells")
            .join(damaged.select("path").distinct(), "path", "left_anti"))
    files = rows.select("file_id", "path").distinct().withColumn("name", base_name())
    facts, items = extract_document(rows.drop("path"), files, profile, sheets, saved, external, lambda df, name: _stage(spark, df, base, name))
    facts = facts.withColumn("client", F.coalesce("client", F.concat(F.lit("Client du "), G.stem("name")))).join(files.select("file_id", "path"), "file_id")
    return Found(rows, _stage(spark, facts, base, "facts"), _stage(spark, items, base, "items"), damaged, base)


def import_documents(spark, path, warehouse, run_id, on_existing="replace", today=None, **how) -> DataFrame:
    """Import every workbook below ``path``: decode, detect, resolve, load; returns the counters.

    ``how`` goes to ``detect_workbooks``: the item ``profile``, ``sheets`` ("best" or "all"), ``saved`` mappings, ``external`` lots.
    """
    found = detect_workbooks(spark, read_workbook_rows(spark, path), run_id, **how)
    return load_found(spark, found, warehouse, run_id, on_existing, today)


def loaded_before(v, batch):
    return batch is not None and v.batches.get(batch[0], -1) >= batch[1]


def load_found(spark, found: Found, warehouse, run_id, on_existing="replace", today=None, batch=None, tries=20) -> DataFrame:
    """Resolve what was found against the stored tables and load it; returns the counters.

    All tables of an import are published by one commit (``versions``): a reader sees all of it or nothing, and an import
    that stops midway leaves only folders that no version names. Where another import was first, resolving and writing are
    done again on its version, so ids stay distinct.

    A document is its path: files of one name in two folders are two documents, and a path that is imported again keeps
    its id and has its elements replaced (``on_existing="append"`` keeps the old ones too). Damaged workbooks and sheets
    whose columns are not sure leave a row in the error table.

    ``batch`` is (stream, number): a batch that was committed before is not loaded again.
    """
    facts, items, errors = found.facts, found.items, found.damaged
    unsure = facts.filter("level = 'low' and not manual").select("path", F.concat(F.lit("LowConfidence: columns of sheet "), "sheet").alias("error"))
    errors = errors.unionByName(unsure).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("path").alias("filename"),
        F.lit(0).alias("line_number"), F.split_part(F.col("error"), F.lit(":"), F.lit(1)).alias("error_type"),
        F.col("error").alias("error_message"), F.lit("").alias("raw_data"))
    for attempt in range(tries):
        v, tag = versions.version(spark, warehouse), f"{run_id}-{uuid.uuid4().hex}"
        if loaded_before(v, batch):
            return spark.createDataFrame([("batches_skipped", 1)], "counter string, n bigint")
        new, counted, loaded = _resolved(spark, facts, items, warehouse, v, f"{found.base}/{tag}", tag, on_existing, today)
        new["errors"] = _appended(spark, warehouse, v, "errors", errors, tag)
        if versions.commit(spark, warehouse, v, new, None if batch is None else {batch[0]: batch[1]}):
            return import_stats(found.rows, counted, loaded, found.damaged)
    raise RuntimeError(f"{warehouse}: other imports were first {tries} times")


def _appended(spark, warehouse, v, name, df, tag):
    """Folders of a table with rows added; a table of many folders is put together in the same commit."""
    old = v.tables.get(name, {}).get("", [])
    if len(old) >= versions.MANY:
        df, old = df.unionByName(versions.read(spark, warehouse, v, name, SCHEMAS[name])), []
    df.write.parquet(f"{warehouse}/{name}/{tag}")
    return {"": [*old, f"{name}/{tag}"]}


def _resolved(spark, facts, items, warehouse, v, base, tag, on_existing, today):
    """Write what an import adds to a version; (folders by table, resolved entities, loaded elements)."""
    have = lambda name: versions.read(spark, warehouse, v, name, SCHEMAS[name])
    new = {}

    def append(name, resolved):
        rows, _ = enforce_schema(resolved.filter("created").withColumn("section_parent_id", F.lit(None).cast("bigint")), name)
        new[name] = _appended(spark, warehouse, v, name, rows, tag)

    clients = _stage(spark, resolve_clients(facts.select(F.col("client").alias("nom_client")), have("clients")), base, "clients")
    append("clients", clients)
    placed = facts.withColumn("client_key", F.upper("client")).join(clients.select("client_key", "id_client"), "client_key")
    docs = placed.select("file_id", "sheet", "id_client", F.col("path").alias("source_path"), F.col("name").alias("fichier_source"),
                         unique_project(F.col("project"), F.col("name")).alias("nom_projet"), "numero_lot", "nom_lot")
    known = have("documents")
    dpgf = _stage(spark, resolve_dpgf(docs, known, today, ("id_client", "source_path"), ("nom_projet", "fichier_source")), base, "dpgf")
    append("dpgf", dpgf)
    new["documents"] = _appended(spark, warehouse, v, "documents", dpgf.filter("created").select("source_path", "id_client", "id_dpgf"), tag)
    docs = docs.join(dpgf.select("id_client", "source_path", "id_dpgf"), ["id_client", "source_path"])
    lots = _stage(spark, resolve_lots(docs.select("id_dpgf", "numero_lot", "nom_lot"), have("lots")), base, "lots")
    append("lots", lots)
    docs = _stage(spark, docs.withColumn("numero_lot", lot_number()).select("file_id", "sheet", "source_path", "id_dpgf", "numero_lot")
                  .join(lots.select("id_dpgf", "numero_lot", "id_lot"), ["id_dpgf", "numero_lot"]), base, "docs")
    found = items.join(docs, ["file_id", "sheet"])
    sections = _stage(spark, resolve_sections(
        found.filter("type = 'section'").select("id_lot", F.col("section_numero").alias("numero_section"), F.col("section_titre").alias("titre_section"),
                                                F.col("section_niveau").alias("niveau_hierarchique"), "row"),
        have("sections")), base, "sections")
    append("sections", sections)
    el = found.filter("type = 'element'").join(
        sections.select("id_lot", F.col("numero_section").alias("section_numero"), "id_section"), ["id_lot", "section_numero"], "left")
    loaded = _stage(spark, load_elements(el.withColumn("id_element", hash_id("file_id", "sheet", "row"))), base, "elements")
    # a path keeps one document per client: what stood under another client goes as well
    gone = known.join(docs.select("source_path").distinct(), "source_path", "left_semi").select("id_dpgf").unionByName(docs.select("id_dpgf")).distinct()
    new["elements"] = _elements(spark, loaded, _stage(spark, gone, base, "replaced"), warehouse, v, tag, on_existing)
    return new, {"clients": clients, "dpgf": dpgf, "lots": lots, "sections": sections}, loaded


def _elements(spark, loaded, documents, warehouse, v, tag, on_existing="replace"):
    """Folders per bucket (hash of the document) with the loaded elements; with ``replace`` without the old ones of all
    imported ``documents``. Only buckets that an imported document falls in are written."""
    b = F.pmod(F.xxhash64("id_dpgf"), F.lit(BUCKETS)).cast("int")
    out = dict(v.tables.get("elements", {}))
    touched = [str(r["bucket"]) for r in documents.select(b.alias("bucket")).distinct().collect()]       # at most BUCKETS
    fresh = loaded.withColumn("bucket", b)
    if on_existing != "append":
        old = versions.read(spark, warehouse, v, "elements", STORED_ELEMENTS, [k for k in touched if k in out])
        fresh = fresh.unionByName(old.join(documents, "id_dpgf", "left_anti").withColumn("bucket", b))
    path = f"elements/{tag}"
    fresh.repartition("bucket", F.pmod("id_element", F.lit(8))).write.partitionBy("bucket").parquet(f"{warehouse}/{path}")
    filled = {str(r["bucket"]) for r in spark.read.parquet(f"{warehouse}/{path}").select("bucket").distinct().collect()} if not fresh.isEmpty() else set()
    for k in touched:
        before = out.get(k, []) if on_existing == "append" else []
        out[k] = before + ([f"{path}/bucket={k}"] if k in filled else [])
    return out
