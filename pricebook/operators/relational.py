"""Relational reads over the entity tables: lookups, pages, joins, trees, nesting."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.operators.scale import chunked_lists, staged, dense_ids


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def page(df: DataFrame, order, skip=0, limit=100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def insert_rows(table: DataFrame, new: DataFrame, id_col: str, keys) -> DataFrame:
    """The table plus the new rows under fresh ids."""
    top = table.agg(F.max(id_col).alias("max_id"))
    return table.unionByName(dense_ids(new, keys, top, id_col), allowMissingColumns=True)


def delete_rows(table: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return table.join(ids.select(id_col), id_col, "left_anti")


def sections_by_lot(sections, lot_id):
    return sections.filter(F.col("id_lot") == lot_id).orderBy("numero_section", "id_section")


def sections_by_dpgf(sections, lots, dpgf_id=None):
    if dpgf_id is not None:
        lots = lots.filter(F.col("id_dpgf") == dpgf_id)
    return (sections.join(lots.select("id_lot", "id_dpgf", "numero_lot", "nom_lot"), "id_lot")
            .orderBy("id_dpgf", "numero_lot", "numero_section", "id_section"))


def sections_with_hierarchy(sections, lots, dpgf):
    return (sections.join(lots, "id_lot", "left")
            .join(dpgf.select("id_dpgf", "nom_projet", "id_client"), "id_dpgf", "left")
            .orderBy("numero_section", "id_section"))


def elements_with_section(elements, sections):
    s = sections.select("id_section", "numero_section", "titre_section", "niveau_hierarchique")
    return elements.join(s, "id_section").orderBy("numero_section", "id_element")


def elements_with_hierarchy(elements, sections, lots, dpgf):
    """Elements through their section up to the document (rows without section drop out)."""
    s = sections.select("id_section", "id_lot", "numero_section", "titre_section")
    return (elements.drop("id_lot").join(s, "id_section").join(lots, "id_lot")
            .join(dpgf.select("id_dpgf", "nom_projet", "id_client"), "id_dpgf")
            .orderBy("nom_projet", "numero_lot", "numero_section", "id_element"))


def elements_by(elements, sections, lots, section_id=None, lot_id=None, dpgf_id=None):
    """Elements of a section, else of a lot, else of a document."""
    s = sections.select("id_section", "id_lot", "numero_section")
    if section_id is not None:
        return elements.filter(F.col("id_section") == section_id).orderBy("id_element")
    e = elements.drop("id_lot").join(s, "id_section")
    if lot_id is not None:
        return e.filter(F.col("id_lot") == lot_id).orderBy("numero_section", "id_element")
    e = e.join(lots.select("id_lot", "id_dpgf", "numero_lot"), "id_lot")
    if dpgf_id is not None:
        e = e.filter(F.col("id_dpgf") == dpgf_id)
    return e.orderBy("numero_lot", "numero_section", "id_element")


def sections_with_element_count(sections, elements, lots=None, dpgf_id=None):
    """Sections with their number of elements; counted before the join."""
    if dpgf_id is not None:
        sections = sections.join(lots.filter(F.col("id_dpgf") == dpgf_id).select("id_lot"), "id_lot", "left_semi")
    n = (elements.filter(F.col("id_section").isNotNull())
         .groupBy("id_section").agg(F.count("*").alias("elements_count")))
    return (sections.join(n, "id_section", "left")
            .withColumn("elements_count", F.coalesce("elements_count", F.lit(0).cast("bigint"))))


PLAIN_ROUNDS = 6        # 64 levels; only then is it worth telling deep chains from cycles


def _jump(cur, sep=None):
    """One doubling: every open row follows its pointer to where that one points."""
    more = [] if sep is None else ["path"]
    above = cur.select(F.col("id_section").alias("up"), F.col("up").alias("up2"), F.col("lost").alias("lost2"),
                       F.col("depth").alias("depth2"), *[F.col(c).alias(f"{c}2") for c in more])
    done, open_ = cur.filter("up is null or lost"), cur.filter("up is not null and not lost")
    open_ = open_.join(above, "up", "left")
    gone = F.col("lost2").isNull()                      # the parent does not exist
    path = [F.when(gone, F.col("path")).otherwise(F.concat("path2", F.lit(sep), "path")).alias("path") for _ in more]
    open_ = open_.select("id_section", F.when(gone, F.col("up")).otherwise(F.col("up2")).alias("up"), *path,
                         (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                         (gone | F.col("lost2")).alias("lost"))
    return done.unionByName(open_)


def _open(cur):
    return not cur.filter("up is not null and not lost").isEmpty()


def _in_cycles(sections):
    """Sections that never reach a root or a lost parent: still open when pointers span all rows."""
    cur = staged(sections.select("id_section", F.col("section_parent_id").alias("up"),
                                 F.lit(1).cast("double").alias("depth"), F.lit(False).alias("lost")), "cycles")
    for _ in range(math.ceil(math.log2(max(2, cur.count()))) + 1):
        if not _open(cur):
            break
        cur = staged(_jump(cur), "cycles")
    return cur.filter("up is not null and not lost").select("id_section")


def _climb(sections, label, sep):
    """Labels of all ancestors joined, by pointer doubling: log2(depth) joins for all rows at once, at any depth.

    ``up`` is left null below a root; it names the missing parent where ``lost``. Sections in or below a cycle keep
    their own label and are marked.
    """
    cur = staged(sections.select("id_section", F.col("section_parent_id").alias("up"), label.alias("path"),
                                 F.lit(1).alias("depth"), F.lit(False).alias("lost")), "climb")
    stuck, rounds = None, 0
    while _open(cur):
        if rounds == PLAIN_ROUNDS:
            loops = staged(_in_cycles(sections), "loops")
            stuck = sections.join(loops, "id_section", "left_semi").select(
                "id_section", F.col("section_parent_id").alias("up"), label.alias("path"), F.lit(1).alias("depth"), F.lit(False).alias("lost"))
            cur = cur.join(loops, "id_section", "left_anti")
        cur = staged(_jump(cur, sep), "climb")
        rounds += 1
    cur = cur.withColumn("in_cycle", F.lit(False))
    return cur if stuck is None else cur.unionByName(stuck.withColumn("in_cycle", F.lit(True)))


def section_path(sections):
    """Path of titles from the root; ``complete`` is false below a missing parent or a cycle."""
    label = F.when(F.coalesce("titre_section", F.lit("")) != "", F.col("titre_section")).otherwise(
        F.concat(F.lit("Section "), F.col("numero_section")))
    return _climb(sections, label, " → ").select(
        "id_section", F.col("path").alias("chemin"), F.col("up").isNull().alias("complete"))


def lookup_paths(ids, sections):
    """Paths for a list of section ids, with the fixed text for unknown ones."""
    return (ids.join(section_path(sections), "id_section", "left")
            .withColumn("chemin", F.coalesce("chemin", F.lit("Section inconnue"))))


def section_tree(sections, lots, dpgf_id=None):
    """Flat tree: depth, sort path and number of children; lost parents and cycles are kept and marked."""
    s = sections.join(lots.select("id_lot", "id_dpgf", "numero_lot"), "id_lot")
    if dpgf_id is not None:
        s = s.filter(F.col("id_dpgf") == dpgf_id)
    climbed = _climb(s, F.col("numero_section"), "/").select("id_section", "lost", "in_cycle", "depth", "path")
    kids = (s.filter("section_parent_id is not null").groupBy(F.col("section_parent_id").alias("id_section"))
            .agg(F.count("*").alias("children")))
    return (s.join(climbed, "id_section").join(kids, "id_section", "left")
            .select("id_dpgf", "numero_lot", "id_lot", "id_section", "section_parent_id", "numero_section",
                    "titre_section", F.col("depth").cast("int").alias("depth"), F.col("path").alias("sort_path"),
                    F.coalesce("children", F.lit(0).cast("bigint")).alias("children"),
                    F.col("lost").alias("is_orphan"), "in_cycle"))


def dpgf_structure(dpgf, lots, sections, elements, dpgf_id=None, part_rows=10000):
    """Nested document: one row per section (or empty lot) with its elements in bounded arrays.

    A section above ``part_rows`` elements spans several rows (``part``), so a
    hot document never becomes one giant row; ordering by the leading columns
    gives the reading order.
    """
    if dpgf_id is not None:
        dpgf = dpgf.filter(F.col("id_dpgf") == dpgf_id)
    item = F.struct("id_element", "designation_exacte", "unite", "quantite", "prix_unitaire_ht",
                    "prix_total_ht", "offre_acceptee")
    lists = chunked_lists(elements.filter("id_section is not null"), ["id_section"], item, F.col("id_element"), part_rows)
    return (dpgf.select("id_dpgf", "nom_projet", "statut_offre").join(lots, "id_dpgf", "left")
            .join(sections.select("id_lot", "id_section", "numero_section", "titre_section", "niveau_hierarchique"),
                  "id_lot", "left")
            .join(lists, "id_section", "left")
            .select("id_dpgf", "nom_projet", "statut_offre", "id_lot", "numero_lot", "nom_lot", "id_section",
                    "numero_section", "titre_section", "niveau_hierarchique",
                    F.coalesce("part", F.lit(0)).alias("part"), F.col("items").alias("elements")))


def elements_flat(elements, lots, sections, dpgf, clients):
    """The search view: every element with its lot, section, document and client columns.

    Documents and clients are joined to the lots, so that an element moves twice: to its section and to its lot.
    No join hint: the optimizer broadcasts a parent table only when its size
    is known to be below the session threshold, else it shuffles both sides.
    """
    e = elements.select("id_element", "id_lot", "id_section", F.col("designation_exacte").alias("designation"),
                        "description", "unite", "quantite", F.col("prix_unitaire_ht").alias("prix_unitaire"),
                        F.col("prix_total_ht").alias("prix_total"), "created_at", "offre_acceptee")
    parents = (lots.select("id_lot", "id_dpgf", "numero_lot", "nom_lot")
               .join(dpgf.select("id_dpgf", "id_client", "nom_projet", "date_dpgf", "fichier_source"), "id_dpgf")
               .join(clients.select("id_client", "nom_client"), "id_client"))
    return (e.join(sections.select("id_section", "numero_section", "titre_section"), "id_section", "left")
            .join(parents, "id_lot")
            .select("id_client", "id_dpgf", "id_section", "id_lot", "id_element", *e.columns[3:], "numero_lot", "nom_lot",
                    "numero_section", "titre_section", "nom_projet", "date_dpgf", "fichier_source", "nom_client"))
