"""Correction of loaded documents whose lots or sections were not detected."""

from pyspark.sql import functions as F

from pricebook.operators import grid as G
from pricebook.operators import identify as I
from pricebook.operators import items as T
from pricebook.operators.load import layout
from pricebook.operators.scale import dense_ids

DEFAULT = "00"


def lot_issues(dpgf, lots):
    """Documents without a lot, or whose only lot is the default one."""
    n = lots.groupBy("id_dpgf").agg(F.count("*").alias("n"), F.max("numero_lot").alias("numero"))
    j = dpgf.select("id_dpgf", "nom_projet", "fichier_source").join(n, "id_dpgf", "left")
    return j.filter("n is null or (n = 1 and numero = '00')").select(
        "id_dpgf", "nom_projet", "fichier_source", F.coalesce("n", F.lit(0).cast("bigint")).alias("lots"))


def section_issues(lots, sections, elements):
    """Lots with elements outside any section, or with at most one default section."""
    e = elements.filter("id_section is null").groupBy("id_lot").agg(F.count("*").alias("elements_sans_section"))
    s = sections.groupBy("id_lot").agg(F.count("*").alias("sections_count"), F.max(F.coalesce("numero_section", F.lit(""))).alias("numero"))
    j = lots.join(s, "id_lot", "left").join(e, "id_lot", "left")
    zero = F.lit(0).cast("bigint")
    orphans, n = F.coalesce("elements_sans_section", zero), F.coalesce("sections_count", zero)
    return j.filter((orphans > 0) | (n == 0) | ((n == 1) & (F.col("numero") == DEFAULT))).select(
        "id_dpgf", "id_lot", "numero_lot", n.alias("sections_count"), orphans.alias("elements_sans_section"))


def correct_lots(lots, sections, elements, redetected):
    """Rename, create and drop lots from ``redetected(id_dpgf, numero_lot, nom_lot)``.

    When a document gets exactly one lot and that lot is new, what hangs on its
    default lots moves to it and the default lots go.
    """
    red = redetected.groupBy("id_dpgf", "numero_lot").agg(F.min("nom_lot").alias("new_nom"))
    renamed = lots.join(red, ["id_dpgf", "numero_lot"], "left").select(
        "id_lot", "id_dpgf", "numero_lot", F.coalesce("new_nom", "nom_lot").alias("nom_lot"))
    fresh = red.join(lots.select("id_dpgf", "numero_lot"), ["id_dpgf", "numero_lot"], "left_anti").withColumnRenamed("new_nom", "nom_lot")
    new = dense_ids(fresh, ["id_dpgf", "numero_lot"], lots.agg(F.max("id_lot").alias("max_id")), "id_lot")
    single = red.groupBy("id_dpgf").agg(F.count("*").alias("n")).filter("n = 1").select("id_dpgf")
    target = new.join(single, "id_dpgf", "left_semi").select("id_dpgf", F.col("id_lot").alias("to_lot"))
    moves = lots.filter(F.col("numero_lot") == DEFAULT).join(target, "id_dpgf").select("id_lot", "to_lot")
    kept = renamed.join(moves.select("id_lot"), "id_lot", "left_anti")

    def remap(df):
        return df.join(moves, "id_lot", "left").withColumn("id_lot", F.coalesce("to_lot", "id_lot")).drop("to_lot")

    return kept.unionByName(new), remap(sections), remap(elements), moves


def correct_sections(sections, elements, redetected):
    """Create missing sections, move orphans to the first real section of their lot, drop empty defaults.

    ``redetected(id_lot, numero_section, titre_section, niveau_hierarchique)``
    names the lots to correct.
    """
    keys = ["id_lot", "numero_section", "titre_section"]
    red = redetected.groupBy(*keys).agg(F.min("niveau_hierarchique").alias("niveau_hierarchique"))
    fresh = red.join(sections.select(*keys), keys, "left_anti")
    new = dense_ids(fresh, keys, sections.agg(F.max("id_section").alias("max_id")), "id_section")
    everything = sections.unionByName(new, allowMissingColumns=True)
    fixed_lots = red.select("id_lot").distinct()
    is_default = F.coalesce(F.col("numero_section").isin(DEFAULT, ""), F.lit(True))
    first = (everything.filter(~is_default).join(fixed_lots, "id_lot", "left_semi")
             .groupBy("id_lot").agg(F.min("id_section").alias("first_section")))
    defaults = sections.filter(is_default).join(fixed_lots, "id_lot", "left_semi").select("id_section", F.lit(True).alias("_default"))
    e = elements.join(first, "id_lot", "left").join(defaults, "id_section", "left")
    orphan = F.col("first_section").isNotNull() & (F.col("id_section").isNull() | F.coalesce("_default", F.lit(False)))
    moved = e.withColumn("moved", orphan).withColumn("id_section", F.when(orphan, F.col("first_section")).otherwise(F.col("id_section")))
    moved = moved.drop("first_section", "_default")
    used = moved.select("id_section").distinct()
    empty = defaults.join(used, "id_section", "left_anti").select("id_section")
    return everything.join(empty, "id_section", "left_anti"), moved.drop("moved"), moved.filter("moved")


def correction_log(before, after, moved, key="id_dpgf"):
    """Per document or lot: number of entries before and after, and elements moved."""
    b = before.groupBy(key).agg(F.count("*").alias("before"))
    a = after.groupBy(key).agg(F.count("*").alias("after"))
    m = moved.groupBy(key).agg(F.count("*").alias("moved"))
    zero = F.lit(0).cast("bigint")
    j = b.join(a, key, "full").join(m, key, "left")
    return j.select(key, *[F.coalesce(c, zero).alias(c) for c in ("before", "after", "moved")]).filter(
        (F.col("before") != F.col("after")) | (F.col("moved") > 0))


def redetect(issues, files, rows):
    """Lots and sections found again in the flagged files only: the sheet and the columns that an import takes."""
    flagged = issues.select("file_id").distinct()
    f, r = files.join(flagged, "file_id", "left_semi"), rows.join(flagged, "file_id", "left_semi")
    body = r.join(I.best_sheet(r).select("file_id", "sheet"), I.SHEET, "left_semi")
    lots = G.detect_lot(f, body).select("file_id", "numero_lot", "nom_lot")
    items = T.parse_items(body, layout(body))
    sections = items.filter("type = 'section'").select(
        "file_id", "sheet", "row", F.col("section_numero").alias("numero_section"),
        F.col("section_titre").alias("titre_section"), F.col("section_niveau").alias("niveau_hierarchique"))
    return lots, sections
