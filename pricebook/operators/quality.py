"""Structural quality of loaded documents: rules, totals, ratios, classes, report rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.operators.scale import chunked_lists, staged

# Severity of each rule.
SEVERITY = {
    "dpgf_sans_lots": "high", "dpgf_avec_lots_vides": "high", "lot_sans_elements": "high",
    "lot_sans_sections": "medium", "section_sans_elements": "medium", "elements_sans_section": "low",
}


def _counts(dpgf, lots, sections, elements):
    """Per document and per lot counts, each table aggregated once before joining; written, as every rule reads them."""
    per_lot_e = elements.groupBy("id_lot").agg(
        F.count("*").alias("n_elements"), F.count_if(F.col("id_section").isNull()).alias("n_orphans"))
    per_lot_s = sections.groupBy("id_lot").agg(F.count("*").alias("n_sections"))
    zero = F.lit(0).cast("bigint")
    lot = (lots.join(per_lot_e, "id_lot", "left").join(per_lot_s, "id_lot", "left")
           .select("id_lot", "id_dpgf", *[F.coalesce(c, zero).alias(c) for c in ("n_elements", "n_orphans", "n_sections")]))
    lot = staged(lot, "lot-counts")
    per_doc = lot.groupBy("id_dpgf").agg(F.count("*").alias("n_lots"), F.sum("n_elements").alias("n_elements"),
                                         F.sum("n_sections").alias("n_sections"))
    doc = dpgf.join(per_doc, "id_dpgf", "left").select(
        "id_dpgf", "nom_projet", "id_client",
        *[F.coalesce(c, zero).alias(c) for c in ("n_lots", "n_sections", "n_elements")])
    return staged(doc, "document-counts"), lot


def quality_issues(dpgf, lots, sections, elements) -> DataFrame:
    return _issues(*_counts(dpgf, lots, sections, elements), lots, sections, elements)


def _issues(doc, lot, lots, sections, elements):
    """What the rules find; the rules of a document, and those of a lot, are tested in one reading of the counts."""
    none = F.lit(None).cast("bigint")

    def s(c):
        return F.col(c).cast("string")

    def rules(df, lot_id, sec_id, *each):
        hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(SEVERITY[kind]).alias("severity"), text.alias("description")))
                                         for kind, cond, text in each]))
        return df.select("id_dpgf", lot_id.alias("id_lot"), sec_id.alias("id_section"), F.explode(hits).alias("h")).select(
            "id_dpgf", "id_lot", "id_section", "h.*")

    empty_sections = (sections.join(elements.select("id_section").filter("id_section is not null"), "id_section", "left_anti")
                      .select("id_section", "id_lot", "titre_section").join(lots.select("id_lot", "id_dpgf"), "id_lot"))
    return rules(
        doc, none, none,
        ("dpgf_sans_lots", F.col("n_lots") == 0, F.lit("DPGF sans aucun lot")),
        ("dpgf_avec_lots_vides", (F.col("n_lots") > 0) & (F.col("n_elements") == 0),
         F.concat(F.lit("DPGF avec "), s("n_lots"), F.lit(" lots mais aucun élément d'ouvrage"))),
    ).unionByName(rules(
        lot, F.col("id_lot"), none,
        ("lot_sans_sections", F.col("n_sections") == 0, F.lit("Lot sans aucune section")),
        ("lot_sans_elements", F.col("n_elements") == 0, F.lit("Lot sans aucun élément d'ouvrage")),
        ("elements_sans_section", F.col("n_orphans") > 0, F.concat(s("n_orphans"), F.lit(" éléments sans section assignée"))),
    )).unionByName(rules(
        empty_sections, F.col("id_lot"), F.col("id_section"),
        ("section_sans_elements", F.lit(True), F.concat(F.lit("Section '"), F.col("titre_section"), F.lit("' sans aucun élément d'ouvrage"))),
    ))


def quality_summary(dpgf, lots, sections, elements):
    """Entity totals and number of issues per rule in one row."""
    doc, lot = _counts(dpgf, lots, sections, elements)
    totals = doc.agg(F.count("*").alias("total_dpgfs"), F.sum("n_lots").alias("total_lots"),
                     F.sum("n_sections").alias("total_sections"), F.sum("n_elements").alias("total_elements"))
    issues = _issues(doc, lot, lots, sections, elements).agg(
        *[F.count_if(F.col("type") == k).alias(k) for k in SEVERITY])
    return totals.crossJoin(F.broadcast(issues))   # both are single aggregate rows


def quality_ratios(dpgf, lots, sections, elements):
    doc, lot = _counts(dpgf, lots, sections, elements)
    bad = (_issues(doc, lot, lots, sections, elements).agg(F.count_distinct("id_dpgf").alias("bad")))
    t = doc.agg(F.count("*").alias("d"), F.sum("n_lots").alias("l"), F.sum("n_sections").alias("s"),
                F.sum("n_elements").alias("e")).crossJoin(F.broadcast(bad))

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return t.select(ratio("l", "d").alias("avg_lots_per_dpgf"), ratio("s", "l").alias("avg_sections_per_lot"),
                    ratio("e", "l").alias("avg_elements_per_lot"),
                    F.coalesce(F.try_divide(F.col("bad") * 100.0, F.col("d").cast("double")), F.lit(0.0)).cast("double")
                    .alias("dpgfs_with_problems_percentage"))


def quality_classes(issues, dpgf):
    """Number of documents per class by how many issues they have."""
    n = issues.groupBy("id_dpgf").agg(F.count("*").alias("n"))
    k = F.coalesce("n", F.lit(0))
    return (dpgf.select("id_dpgf").join(n, "id_dpgf", "left")
            .groupBy(F.when(k == 0, "excellent").when(k <= 2, "bon").when(k <= 5, "moyen").otherwise("mauvais").alias("classe"))
            .agg(F.count("*").alias("documents")))


def quality_report(dpgf, lots, sections, elements, clients, part_rows=10000):
    """Problem documents with counts and nested issues (lot level inside); long lists span parts."""
    doc, lot = _counts(dpgf, lots, sections, elements)
    issues = staged(_issues(doc, lot, lots, sections, elements), "issues")      # read by the ranges, the lists and the counts
    item = F.struct(F.coalesce("id_lot", F.lit(0).cast("bigint")).alias("id_lot"), "type",
                    F.coalesce("id_section", F.lit(0).cast("bigint")).alias("id_section"), "severity", "description")
    lists = chunked_lists(issues, ["id_dpgf"], item, F.struct("id_lot", "id_section", "type"), part_rows)
    lot_n = (issues.filter("id_lot is not null").groupBy("id_dpgf")
             .agg(F.count_distinct("id_lot").alias("problematic_lots")))
    # the names of clients come to the documents before the lists do
    return (doc.join(clients, "id_client", "left").join(lists, "id_dpgf").join(lot_n, "id_dpgf", "left")
            .select("id_dpgf", "nom_projet", "id_client", "nom_client", "n_lots", "n_sections", "n_elements",
                    F.coalesce("problematic_lots", F.lit(0).cast("bigint")).alias("problematic_lots"), "part",
                    F.col("items").alias("problems")))
