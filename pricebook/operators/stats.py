"""Price statistics, groupings, price bands and keyword extraction over the flat view."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.functions.text import tokenize
from pricebook.operators.scale import staged

# Vocabularies of the keyword report.
TECHNIQUES = (
    "pose installation montage démontage assemblage fixation scellement soudure vissage chevillage "
    "étanchéité isolation revêtement finition peinture découpe perçage forage sciage traitement"
).split()
MATERIALS = (
    "bois acier inox aluminium pvc béton pierre carrelage ciment plâtre brique verre métal "
    "plastique cuivre zinc plomb caoutchouc composite"
).split()
DIMENSION = r"[0-9]+(?:[,.][0-9]+)?[xX*][0-9]+(?:[,.][0-9]+)?"

# Price bands, cut at mean -1.5, -0.5, +0.5, +1.5 deviations.
BANDS = ("très_bas", "bas", "moyen", "élevé", "très_élevé")
CUTS = (-1.5, -0.5, 0.5, 1.5)


def mean(col):
    """Average from an exact decimal sum, so that the value does not depend on row order."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def statistics(flat: DataFrame) -> DataFrame:
    return flat.agg(
        F.count("*").alias("total_elements"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in (
            ("min_price", F.min("prix_unitaire")), ("max_price", F.max("prix_unitaire")),
            ("avg_price", mean("prix_unitaire")), ("total_amount", F.sum("prix_total")))])


def unit_counts(flat):
    return flat.filter("unite is not null and unite <> ''").groupBy("unite").agg(F.count("*").alias("n"))


def section_coverage(flat):
    out = flat.agg(F.count("id_section").alias("with_section"), F.count("*").alias("_n"))
    return out.select("with_section", (F.col("_n") - F.col("with_section")).alias("without_section"),
                      F.coalesce(F.bround(F.try_divide(F.col("with_section") * 100.0, F.col("_n")), 2),
                                 F.lit(0.0)).cast("double").alias("percent"))


def group_by_lot(flat, lots):
    """Counts and prices per lot; lots without elements are kept."""
    agg = flat.groupBy("id_lot").agg(
        F.count("*").alias("_n"), F.min("prix_unitaire").alias("min_price"), F.max("prix_unitaire").alias("max_price"),
        mean("prix_unitaire").alias("_avg"), F.sum("prix_total").alias("_total"))
    return lots.join(agg, "id_lot", "left").select(
        "id_lot", "numero_lot", "nom_lot", F.coalesce("_n", F.lit(0).cast("bigint")).alias("elements_count"),
        F.col("min_price").cast("double").alias("min_price"), F.col("max_price").cast("double").alias("max_price"),
        F.coalesce("_avg", F.lit(0.0)).alias("avg_price"), F.coalesce(F.col("_total").cast("double"), F.lit(0.0)).alias("total"))


def first_per_group(df, keys, n):
    """First ``n`` rows by id per group; Spark trims each map task to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy("id_element")
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def group_with_examples(flat, keys, n=10):
    """Count per group and its first ``n`` elements."""
    item = F.struct("id_element", "designation", "unite", "prix_unitaire", "prix_total")
    examples = (first_per_group(flat, keys, n).groupBy(*keys)
                .agg(F.array_sort(F.collect_list(item)).alias("elements")))
    counts = flat.groupBy(*keys).agg(F.count("*").alias("elements_count"))
    return counts.join(examples, list(keys))


def group_by_section(flat, n=10):
    return group_with_examples(flat.filter("id_section is not null"),
                               ["id_lot", "id_section", "numero_section", "titre_section"], n)


def without_section(flat, n=10):
    return group_with_examples(flat.filter("id_section is null"), ["id_lot"], n)


def group_by_unit(flat):
    return flat.filter("unite is not null").groupBy("unite").agg(
        F.count("*").alias("n"), F.min("prix_unitaire").cast("double").alias("min_price"),
        F.max("prix_unitaire").cast("double").alias("max_price"), mean("prix_unitaire").alias("avg_price"))


def price_bands(flat, price="prix_unitaire", compat=False, n=20):
    """Five bands around the mean: bounds, count, first ``n`` elements.

    Each item falls in one band (half-open); ``compat`` counts both edges, so
    an item on a cut is in two bands. Nothing comes out without deviation.
    The columns used are written once, as bounds, counts and first elements each read all rows.
    """
    flat = staged(flat.select(*dict.fromkeys(["id_element", "designation", "unite", "prix_unitaire", "prix_total", price])), "band-rows")
    x = F.col(price).cast("double")
    stats = flat.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_mu"),
                     F.stddev_pop(x).alias("_sd")).filter("_sd > 0")
    cuts = [F.col("_mu") + c * F.col("_sd") for c in CUTS]
    edges = [F.col("_lo"), *cuts, F.col("_hi")]
    bounds = stats.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("rang"), F.lit(b).alias("band"), edges[i].alias("min"), edges[i + 1].alias("max"))
        for i, b in enumerate(BANDS)])).alias("b")).select("b.*")
    with_stats = flat.filter(x.isNotNull()).crossJoin(F.broadcast(stats))   # stats is one aggregate row
    if compat:
        hit = F.array_compact(F.array(*[F.when(x.between(edges[i], edges[i + 1]), F.lit(b))
                                        for i, b in enumerate(BANDS)]))
        rows = with_stats.withColumn("band", F.explode(hit))
    else:
        band = F.when(x < cuts[0], BANDS[0])
        for c, b in zip(cuts[1:], BANDS[1:]):
            band = band.when(x < c, b)
        rows = with_stats.withColumn("band", band.otherwise(BANDS[-1]))
    rows = rows.drop("_lo", "_hi", "_mu", "_sd")
    out = group_with_examples(rows, ["band"], n)
    return bounds.join(F.broadcast(out), "band", "left").withColumn(
        "elements_count", F.coalesce("elements_count", F.lit(0).cast("bigint")))


def extract_keywords(flat, limit=20):
    """Top units, dimensions, techniques and materials with their share of the elements."""
    texts = flat.select(F.coalesce("unite", F.lit("")).alias("unite"),
                        F.lower(F.coalesce("designation", F.lit(""))).alias("a"),
                        F.lower(F.coalesce("description", F.lit(""))).alias("b"))
    units = texts.filter("unite <> ''").select(F.lit("unites").alias("category"), F.col("unite").alias("keyword"))
    dims = texts.select(F.lit("dimensions").alias("category"), F.explode(F.concat(
        F.regexp_extract_all("a", F.lit(DIMENSION), 0), F.regexp_extract_all("b", F.lit(DIMENSION), 0))).alias("k")
    ).select("category", F.regexp_replace("k", "[xX*]", "x").alias("keyword"))
    tokens = texts.select(F.explode(F.array_distinct(tokenize(F.concat_ws(" ", "a", "b")))).alias("keyword"))
    known = tokens.filter(F.col("keyword").isin(TECHNIQUES + MATERIALS)).select(
        F.when(F.col("keyword").isin(TECHNIQUES), "techniques").otherwise("materiaux").alias("category"), "keyword")
    counts = units.unionAll(dims).unionAll(known).groupBy("category", "keyword").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "keyword")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    total = flat.agg(F.greatest(F.count("*"), F.lit(1)).alias("_total"))
    return top.crossJoin(F.broadcast(total)).select(
        "category", "keyword", "n", "rank", F.bround(F.col("n") * 100.0 / F.col("_total")).cast("int").alias("percentage"))
