"""How well the detectors did: patterns used, misses, suggestions, profile comparison."""

from functools import reduce

from pyspark.sql import functions as F

from pricebook.functions.text import first_rule, rx
from pricebook.operators.identify import SHEET

# Lot patterns of the evaluation, in order.
LOT_USED = (
    ("LOT XX - DPGF - NOM", r"lot\s*(\d{1,2})\s*-\s*(?:dpgf|devis|bpu|dqe)\s*-\s*([\w\s\-&°]+)"),
    ("DPGF-Lot XX NOM", r"dpgf\s*[-_]?\s*lot\s*(\d{1,2})\s+([\w\s\-&°]+)"),
    ("LOT XX - NOM", r"lot\s*(\d{1,2})\s*-\s*([\w\s\-&°]+)"),
    ("XXX DPGF Lot X - NOM", r"^\d+\s+dpgf\s+lot\s*(\d{1,2})\s*-\s*([\w\s\-&°]+)"),
    ("DPGF Lot X - NOM", r"dpgf\s+lot\s*(\d{1,2})\s*-\s*([\w\s\-&°]+)"),
    ("LotXX_NOM", r"lot\s*(\d{1,2})[_\-\s]+([\w\s\-&°]+)"),
    ("XXX - DPGF -LotX", r"-\s*dpgf\s*-?\s*lot\s*(\d{1,2})"),
    ("LotX", r"lot\s*(\d{1,2})(?:\D|$)"),
)
# Section patterns of the evaluation, in order (case-sensitive).
SECTION_USED = (
    ("Décimal", r"^\s*(\d+\.\d+(?:\.\d+)*)\s+(.+)$"), ("Numéro", r"^\s*(\d+)\s+(.+)$"),
    ("Romain", r"^\s*(I{1,3}|IV|VI{1,3}|IX|X)\s*[-\.]\s*(.+)$"), ("Lettre", r"^\s*([A-Z])\s*[-\.]\s*(.+)$"),
    ("Majuscule", r"^([A-Z][A-Z\s\-':]+[A-Z])$"), ("Tiret", r"^\s*[-•]\s+(.+)$"), ("Capitalisé", r"^([A-Z][a-z].{5,})$"),
)
# Suggestions: kind, test, suggested pattern, description.
SUGGESTIONS = (
    ("filename", r"lot.*n[o°]?\s*\d+", r"lot.*n[o°]?\s*(\d+)", "Lot n° X ou Lot no X"),
    ("filename", r"lot.*[\[\(]?\s*\d+\s*[\]\)]?", r"lot.*[\[\(]?\s*(\d+)\s*[\]\)]?", "Lot [X] ou Lot (X)"),
    ("content", r"lot.*n[o°]?\s*\d+", r"lot.*n[o°]?\s*(\d+)", "Lot n° X ou Lot no X dans le contenu"),
    ("potential_section", r"^\s*\d+\s*\-\s*\d+\s*\-\s*\d+", r"^\s*(\d+\s*\-\s*\d+\s*\-\s*\d+)\s+(.+)$", "Format X-X-X Titre (ex: 1-2-3 Installation)"),
    ("potential_section", r"^\s*[A-Za-z]+\.\d+", r"^\s*([A-Za-z]+\.\d+)\s+(.+)$", "Format Alpha.Num (ex: A.1 Installation)"),
)


def joined(cells="cells"):
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")


def evaluate_lots(files, rows):
    """Pattern that finds the lot of each file: a file name pattern, the content, or none."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    used = first_rule([(stem.rlike(rx(p)), f"filename:{n}") for n, p in LOT_USED])
    spoken = F.exists(F.slice("cells", 1, 5), lambda c: F.lower(c).rlike(r"lot\s*\d+"))
    content = rows.filter((F.col("row") < 10) & spoken).select("file_id").distinct().withColumn("_c", F.lit(True))
    return files.join(content, "file_id", "left").select(
        "file_id", "name", F.coalesce(used, F.when(F.col("_c"), "content")).alias("pattern"))


def missed_lots(files, rows, evaluated):
    """Texts to learn from: names without a pattern, and early rows of files without any lot."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    names = evaluated.filter("pattern is null or pattern = 'content'").select("file_id", F.lit("filename").alias("type"), stem.alias("text"))
    lost = evaluated.filter("pattern is null").select("file_id")
    text = joined()
    early = (rows.join(lost, "file_id", "left_semi").filter(F.col("row") < 20).withColumn("text", text)
             .filter(F.lower("text").rlike("lot|devis|dpgf")).select("file_id", F.lit("content").alias("type"), "text"))
    return names.unionByName(early)


def evaluate_sections(items, rows):
    """Pattern of each detected section row, NULL when none of the known forms fits."""
    s = items.filter("type = 'section'").select(*SHEET, "row").distinct()
    text = F.col("text")
    return (rows.select(*SHEET, "row", joined().alias("text")).join(s, [*SHEET, "row"], "left_semi")
            .withColumn("pattern", first_rule([(text.rlike(rx(p, case=True)), n) for n, p in SECTION_USED])))


def missed_sections(rows, headers, items, depth=30):
    """Rows under the header that look like a section but were not taken as one."""
    s = items.filter("type = 'section'").select(*SHEET, "row").distinct()
    t = F.col("text")
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    looks = upper | t.rlike(r"^\s*\d+\.\d+") | t.rlike(r"^\s*[A-Z]\s*[-\.]\s+") | t.rlike(r"^\s*[IVX]{1,4}\s*[-\.]\s+")
    return (rows.join(headers.select(*SHEET, "header_row"), SHEET)
            .filter((F.col("row") > F.col("header_row")) & (F.col("row") <= F.col("header_row") + depth))
            .join(s, [*SHEET, "row"], "left_anti").withColumn("text", joined())
            .filter((F.length("text") > 5) & looks).select(*SHEET, "row", "text"))


def evaluation_summary(lots, sections, missed):
    """Success rates and how often each pattern was used."""
    usage = (lots.select(F.lit("lot").alias("detector"), "pattern")
             .unionByName(sections.select(F.lit("section").alias("detector"), "pattern"))
             .unionByName(missed.select(F.lit("section").alias("detector"), F.lit(None).cast("string").alias("pattern"))))
    c = usage.groupBy("detector", F.coalesce("pattern", F.lit("(aucun)")).alias("pattern")).agg(F.count("*").alias("n"))
    total = usage.groupBy("detector").agg(F.count("*").alias("total"), F.count("pattern").alias("found"))
    return c.join(total, "detector").withColumn("success_rate", F.col("found") / F.col("total"))


def suggest_patterns(missed):
    """Distinct patterns worth adding, from missed examples ``(type, text)``."""
    low = F.when(F.col("type") == "potential_section", F.col("text")).otherwise(F.lower("text"))
    idx = first_rule([((F.col("type") == k) & low.rlike(p), i) for i, (k, p, _, _) in enumerate(SUGGESTIONS)])
    table = F.array(*[F.struct(F.lit("section" if k == "potential_section" else k).alias("type"), F.lit(s).alias("pattern"),
                               F.lit(d).alias("description")) for k, _, s, d in SUGGESTIONS])
    return (missed.withColumn("_i", idx).filter("_i is not null").groupBy("_i").agg(F.min("text").alias("example"), F.count("*").alias("n"))
            .withColumn("_s", F.get(table, F.col("_i"))).select("_s.*", "example", "n"))


def merge_patterns(patterns, suggested):
    """Pattern table with the new suggestions behind the known ones."""
    new = suggested.select("type", "pattern", "description").distinct().join(patterns.select("type", "pattern"), ["type", "pattern"], "left_anti")
    return patterns.unionByName(new)


def compare_profiles(a, b):
    """Two parses (of sections and elements) of the same files: counts, totals and rows seen differently."""
    key = [*SHEET, "row"]
    lost = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in key])

    def side(df, s):
        return df.select(*key, F.lit(s).alias("_s"), "type", F.coalesce(F.col("prix_total").cast("decimal(18,2)"), F.lit(0)).alias("_tot"))

    def seen(s):
        """What a parse made of a row: a section wins over an element."""
        return F.when(F.col(f"sec_{s}") > 0, "section").when(F.col(f"el_{s}") > 0, "element")

    # both parses meet in one grouping by row; a row without a place stands alone in its parse
    each = side(a, "a").unionByName(side(b, "b")).withColumn("_alone", F.when(lost, F.col("_s")))
    j = each.groupBy(*key, "_alone").agg(*[x for s in ("a", "b") for x in (
        F.count_if((F.col("_s") == s) & (F.col("type") == "section")).alias(f"sec_{s}"),
        F.count_if((F.col("_s") == s) & (F.col("type") == "element")).alias(f"el_{s}"),
        F.sum(F.when(F.col("_s") == s, F.col("_tot"))).alias(f"tot_{s}"))])
    aggs = [F.sum(f"{n}_{s}").cast("bigint").alias(f"{label}_{s}")
            for s in ("a", "b") for n, label in (("sec", "sections"), ("el", "elements"))]
    return j.groupBy("file_id").agg(
        *aggs, *[F.coalesce(F.sum(f"tot_{s}").cast("double"), F.lit(0.0)).alias(f"total_{s}") for s in ("a", "b")],
        F.count_if(~seen("a").eqNullSafe(seen("b"))).alias("differences"))
