"""Entity schemas and the rules loaded rows must satisfy."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column, Spark type, text limit, nullable.
ENTITIES = {
    "clients": (("id_client", "bigint", None, False), ("nom_client", "string", 255, False)),
    "dpgf": (("id_dpgf", "bigint", None, False), ("id_client", "bigint", None, False), ("nom_projet", "string", 255, False),
             ("date_dpgf", "date", None, False), ("statut_offre", "string", None, False), ("fichier_source", "string", 255, False)),
    "lots": (("id_lot", "bigint", None, False), ("id_dpgf", "bigint", None, False), ("numero_lot", "string", 50, False),
             ("nom_lot", "string", 255, False)),
    "sections": (("id_section", "bigint", None, False), ("id_lot", "bigint", None, False), ("section_parent_id", "bigint", None, True),
                 ("numero_section", "string", 50, False), ("titre_section", "string", 255, False), ("niveau_hierarchique", "int", None, False)),
    "elements": (("id_element", "bigint", None, False), ("id_section", "bigint", None, True), ("id_lot", "bigint", None, False),
                 ("designation_exacte", "string", 500, False), ("unite", "string", 10, False), ("quantite", "decimal(12,3)", None, False),
                 ("prix_unitaire_ht", "decimal(15,2)", None, False), ("prix_total_ht", "decimal(18,2)", None, False),
                 ("offre_acceptee", "boolean", None, False)),
}
STATUSES = ("en_cours", "acceptee", "refusee")


def enforce_schema(df: DataFrame, entity, mode="truncate"):
    """Good and rejected rows. ``truncate`` cuts long texts, ``reject`` refuses them."""
    problems, cols = [], []
    for name, typ, limit, nullable in ENTITIES[entity]:
        raw = F.col(name)
        value = raw if typ == "string" else raw.try_cast(typ)
        if not nullable:
            problems.append(F.when(value.isNull(), F.lit(f"{name}: missing or not {typ}")))
        elif typ != "string":
            problems.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{name}: not {typ}")))
        if limit:
            if mode == "truncate":
                value = F.substring(value, 1, limit)
            else:
                problems.append(F.when(F.length(raw) > limit, F.lit(f"{name}: longer than {limit}")))
        if name == "statut_offre":
            problems.append(F.when(~raw.isin(*STATUSES), F.lit("statut_offre: unknown status")))
        cols.append(value.alias(name))
    checked = df.select(*cols, F.array_compact(F.array(*problems)).alias("_problems"))
    good = checked.filter(F.size("_problems") == 0).drop("_problems")
    bad = checked.filter(F.size("_problems") > 0).withColumn("reason", F.array_join("_problems", "; ")).drop("_problems")
    return good, bad
