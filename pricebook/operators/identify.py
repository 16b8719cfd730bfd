"""Which files and sheets are price schedules: name, header, content and structure scores.

Grids come as ``rows(file_id, sheet, row, cells ARRAY<STRING>)``; an empty
string is an empty cell. All tests of one sheet are conditional aggregates of
one pass, so a grid is shuffled once by (file, sheet).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.functions.scalars import normalize_text, to_double
from pricebook.functions.text import any_word, extract, matches, rx

TYPES = ("DPGF", "BPU", "DQE")

# Words and name patterns of each document type.
KEYWORDS = {
    "DPGF": ("dpgf", "décomposition du prix global", "decomposition du prix global", "prix global et forfaitaire",
             "forfaitaire", "décomposition des prix", "dpgf lot", "dpgf-lot"),
    "BPU": ("bpu", "bordereau des prix", "bordereau de prix", "prix unitaires", "bordereau prix unitaires"),
    "DQE": ("dqe", "détail quantitatif", "detail quantitatif", "quantitatif estimatif", "détail estimatif",
            "detail estimatif"),
}
NAME_PATTERNS = {
    "DPGF": r"dpgf[-_ ]lot[_ ]?\d+|lot[_ ]?\d+[-_ ]dpgf|dpgf.*\d{2,4}",
    "BPU": r"bpu[-_ ]lot[_ ]?\d+|lot[_ ]?\d+[-_ ]bpu|bpu.*\d{2,4}",
    "DQE": r"dqe[-_ ]lot[_ ]?\d+|lot[_ ]?\d+[-_ ]dqe|dqe.*\d{2,4}",
}
# Expected header words of each document type.
HEADERS = {
    "DPGF": (("designation", "quantite", "prix", "montant"), ("designation", "unite", "quantite", "pu", "montant"),
             ("description", "quantite", "prix", "total")),
    "BPU": (("designation", "unite", "prix"), ("description", "unite", "pu"), ("reference", "libelle", "unite", "prix")),
    "DQE": (("designation", "quantite", "prix", "montant"), ("designation", "unite", "quantite", "pu", "total"),
            ("reference", "description", "quantite", "pu", "montant")),
}

# Words of the sheet scores.
SHEET_WORDS = ("designation", "désignation", "quantité", "quantite", "prix unitaire", "prix total", "montant",
               "unitaire", "p.u.", "pu", "unité", "unite")
SHEET_UNITS = ("ens", "u", "ml", "m2", "m²", "m3", "m³", "kg", "h", "j", "forfait", "ft")
SHEET_TRADES = ("fourniture", "pose", "installation", "montage", "maçonnerie", "maconnerie", "charpente",
                "couverture", "menuiserie", "plomberie", "électricité", "electricite")
SHEET_INFO = ("info", "infos", "garde", "page", "cover", "sommaire", "recap")
SHEET_SKIP = ("garde", "page", "cover", "sommaire")
SMALL_WORDS = ("designation", "désignation", "quantité", "prix", "unitaire", "montant")
SMALL_UNITS = ("ens", "u", "ml", "m2", "m3", "kg")
SHARED_NAME = ("dpgf", "prix", "quantitatif", "detail", "détail", "chiffrage")
SHARED_NEGATIVE = ("info", "garde", "sommaire", "récap")
SHARED_WORDS = ("désignation", "unité", "quantité", "prix", "total", "ht", "ttc")
SHARED_FORM = ("infos", "page de garde", "lot", "récap", "sommaire")

# Words of the structure test.
LOT_WORDS = ("lot", "tranche", "phase", "ouvrage", "corps", "état", "travaux", "marché", "sous-traitance")
SECTION_WORDS = ("chapitre", "sous-chapitre", "section", "sous-section", "titre", "sous-titre", "poste", "sous-poste")
PRICE_WORDS = ("prix", "montant", "coût", "tarif", "pu", "p.u", "unitaire", "total", "ht", "ttc")
UNIT_WORDS = ("unité", "u", "unite", "mesure", "ml", "m²", "m3", "kg", "tonnes", "forfait", "ens", "nb", "pcs")
COMPLEX_NAMES = ("metallerie", "serrurerie", "menuiserie", "annexe", "complex")

SHEET = ["file_id", "sheet"]


def hit(col, words, points=1):
    return F.when(col.rlike(any_word(words)), points).otherwise(0)


def row_text(cells="cells", sep=" "):
    return F.lower(F.array_join(F.filter(cells, lambda c: c != ""), sep))


def cell_number(c):
    return to_double(F.replace(c, F.lit(","), F.lit(".")))


def filename_scores(files: DataFrame, name="name") -> DataFrame:
    """0.5 for a type word plus 0.5 for a name pattern, per type."""
    low = F.lower(F.col(name))
    for t in TYPES:
        files = files.withColumn(f"name_{t}", hit(low, KEYWORDS[t], 0.5).cast("double")
                                 + F.when(low.rlike(NAME_PATTERNS[t]), 0.5).otherwise(0.0))
    return files


def column_confidence(headers, kind):
    """Best share of expected header words found in the normalized headers."""
    norm = F.transform(headers, normalize_text)

    def seen(word):
        return F.when(F.exists(norm, lambda h: h.contains(word)), 1.0).otherwise(0.0)

    def share(pattern):
        found = [seen(w) for w in pattern]
        return sum(found[1:], found[0]) / len(pattern)

    return F.greatest(*[share(p) for p in HEADERS[kind]])


def deep_bonus(rows: DataFrame, header_row=0) -> DataFrame:
    """Bonus per type from the number of numeric columns and the price or amount headers."""
    c = rows.select(*SHEET, "row", F.posexplode("cells").alias("col", "text"))
    body = (F.col("row") > header_row) & (F.col("text") != "")
    number = body & cell_number(F.col("text")).isNotNull()
    per = c.groupBy(*SHEET, "col").agg(
        F.count_if(number).alias("n"), F.count_if(body).alias("filled"),
        F.max(F.when(F.col("row") == header_row, normalize_text("text"))).alias("h"))
    s = per.groupBy(*SHEET).agg(
        F.count_if((F.col("n") > 0) & (F.col("n") == F.col("filled"))).cast("int").alias("n"),
        F.coalesce(F.bool_or(F.col("h").rlike("montant|total")), F.lit(False)).alias("_mt"),
        F.coalesce(F.bool_or(F.col("h").contains("prix")), F.lit(False)).alias("_px"))
    amount = F.when((F.col("n") >= 3) & F.col("_mt"), 0.2).otherwise(0.0)
    price = F.when((F.col("n") <= 2) & F.col("_px"), 0.2).otherwise(0.0)
    return s.select(*SHEET, F.col("n").alias("numeric_columns"), amount.alias("bonus_DPGF"),
                    price.alias("bonus_BPU"), amount.alias("bonus_DQE"))


def content_scores(rows: DataFrame, header_row=0, sample=10, deep=False) -> DataFrame:
    """0.7 x header fit + 0.3 for a type word in the sample, per sheet and type."""
    near = (F.col("row") > header_row) & (F.col("row") <= header_row + sample)
    text = row_text()
    aggs = [F.max_by("cells", F.when(F.col("row") == header_row, 1)).alias("_h")]
    for t in TYPES:
        if deep:
            seen = ((F.col("row") == header_row) | near) & normalize_text(text).rlike(any_word(KEYWORDS[t]))
        else:
            seen = near & text.rlike(any_word(KEYWORDS[t]))
        aggs.append(F.coalesce(F.bool_or(seen), F.lit(False)).alias(f"_k{t}"))
    last = header_row + sample
    s = rows.filter(F.col("row") <= last).groupBy(*SHEET).agg(*aggs)
    return s.select(*SHEET, *[
        (F.coalesce(column_confidence(F.col("_h"), t), F.lit(0.0)) * 0.7
         + F.when(F.col(f"_k{t}"), 0.3).otherwise(0.0)).alias(f"content_{t}") for t in TYPES])


def classify_files(files, rows, mode="local", min_conf=0.3, header_row=0, deep=True):
    """Document type and confidence per file.

    ``local`` weighs content 0.6 and name 0.4; ``shared`` adds them. Without
    ``deep`` only files whose name already reaches half the threshold have
    their content scored: the semi join cuts the grid before any cell work.
    """
    named = filename_scores(files)
    if not deep:
        likely = named.filter(F.greatest(*[F.col(f"name_{t}") for t in TYPES]) >= min_conf * 0.5).select("file_id")
        rows = rows.join(likely, "file_id", "left_semi")
    s = content_scores(rows, header_row)
    bonus = deep_bonus(rows, header_row) if deep else None
    if bonus is not None:
        s = s.join(bonus, SHEET)
        for t in TYPES:
            s = s.withColumn(f"content_{t}", F.col(f"content_{t}") + F.col(f"bonus_{t}"))
    per_file = s.groupBy("file_id").agg(*[F.max(f"content_{t}").alias(f"content_{t}") for t in TYPES])
    df = named.join(per_file, "file_id", "left")
    for t in TYPES:
        c, n = F.coalesce(F.col(f"content_{t}"), F.lit(0.0)), F.col(f"name_{t}")
        df = df.withColumn(f"score_{t}", c * 0.6 + n * 0.4 if mode == "local" else c + n)
    top = F.greatest(*[F.col(f"score_{t}") for t in TYPES])
    kind = F.when(F.col("score_DPGF") == top, "DPGF").when(F.col("score_BPU") == top, "BPU").otherwise("DQE")
    return (df.withColumn("confidence", top)
            .withColumn("doc_type", F.when(top >= min_conf, kind).otherwise("UNKNOWN"))
            .drop(*[f"content_{t}" for t in TYPES]))


def identification_summary(classified: DataFrame, source=None) -> DataFrame:
    """Files and mean confidence by type (and source); the mean is exact to 4 digits per file."""
    keys = ["doc_type"] + ([source] if source else [])
    return classified.groupBy(*keys).agg(
        F.count("*").alias("files"),
        (F.sum(F.bround("confidence", 4).cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean_confidence"))


LOT_CELL = r"lot\s+([^\s–-]+)\s*[–-]\s*(.+)"
LOT_NAME = r"lot\s*(\d+)[^a-zA-Z0-9]*(.*?)\."


def file_lot_info(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Lot number and name: first matching early cell, else the file name."""
    cell = F.get(F.filter("cells", lambda c: c.rlike(rx(LOT_CELL))), F.lit(0))
    found = (rows.filter(F.col("row") < 15).withColumn("_c", cell).filter("_c is not null")
             .groupBy("file_id").agg(F.min_by("_c", F.struct("sheet", "row")).alias("_c")))
    df = files.join(found, "file_id", "left")
    in_cell = F.col("_c").isNotNull()
    num = F.when(in_cell, F.regexp_extract("_c", rx(LOT_CELL), 1)).otherwise(extract("name", LOT_NAME, 1))
    nom = F.when(in_cell, F.regexp_extract("_c", rx(LOT_CELL), 2)).otherwise(
        F.nullif(extract("name", LOT_NAME, 2), F.lit("")))
    return df.select("file_id", "name", F.trim(num).alias("numero_lot"), F.trim(nom).alias("nom_lot"))


def _shape():
    return [(F.max("row") + 1).alias("n_rows"), F.max(F.size("cells")).alias("n_cols")]


def score_sheets(rows: DataFrame, variant="main") -> DataFrame:
    """Points per sheet for looking like a price schedule."""
    text, name = row_text(), F.lower("sheet")
    if variant == "small":
        early = F.col("row") < 10
        num = F.exists("cells", lambda c: c.rlike(r"^\d+(\.\d+)*$"))
        pts = hit(text, SMALL_WORDS, 5) + F.when(num, 2).otherwise(0) + hit(text, SMALL_UNITS, 1)
        s = rows.groupBy(*SHEET).agg(F.sum(F.when(early, pts).otherwise(0)).alias("_p"), *_shape())
        size = F.when(F.col("n_rows").between(10, 1000) & F.col("n_cols").between(3, 20), 3).otherwise(0)
        return s.select(*SHEET, (F.col("_p") + size).cast("int").alias("score"))
    if variant == "shared":
        early = F.col("row").between(1, 10)
        words = [F.max(F.when(early, hit(text, (w,)))) for w in SHARED_WORDS]
        s = rows.groupBy(*SHEET).agg(
            F.coalesce(sum(words[1:], words[0]), F.lit(0)).alias("_w"),
            F.coalesce(F.max(F.when(early & text.rlike(r"\d+\.\d+(?:\.\d+)?"), 3)), F.lit(0)).alias("_n"),
            F.sum(F.when(early, F.size(F.filter("cells", lambda c: c != ""))).otherwise(0)).alias("_c"), *_shape())
        by_name = F.when(name.contains("lot"), 5).otherwise(0) + F.when(name.rlike(r"lot\s*\d+"), 3).otherwise(0)
        for w in SHARED_NAME:
            by_name = by_name + F.when(name.contains(w), 2).otherwise(0)
        for w in SHARED_NEGATIVE:
            by_name = by_name - F.when(name.contains(w), 3).otherwise(0)
        score = by_name + F.least("n_cols", F.lit(5)) + F.col("_w") + F.col("_n") + F.least(F.floor(F.col("_c") / 10), F.lit(5))
        return s.select(*SHEET, score.cast("int").alias("score"))
    early = F.col("row") < 20
    pts = F.size(F.filter("cells", lambda c: c.rlike(r"^([A-Z])?\d+(\.\d+)*$"))) * 3
    for words, p in ((SHEET_WORDS, 8), (SHEET_UNITS, 2), (SHEET_TRADES, 3)):
        for w in words:
            pts = pts + F.when(text.contains(w), p).otherwise(0)
    numeric = [F.when(F.count_if(early & cell_number(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).isNotNull()) > 5, 3)
               .otherwise(0) for i in range(10)]
    s = rows.groupBy(*SHEET).agg(F.sum(F.when(early, pts).otherwise(0)).alias("_p"),
                                 sum(numeric[1:], numeric[0]).alias("_n"), *_shape())
    r, c = F.col("n_rows"), F.col("n_cols")
    score = (F.col("_p") + F.col("_n") + F.when(r > 20, 10).when(r > 10, 5).otherwise(0)
             + F.when(c.between(4, 15), 5).when(c > 15, -2).otherwise(0)
             - hit(name, SHEET_INFO, 15) - F.when(r < 10, 10).otherwise(0)
             + F.when(name.rlike(r"lot\s*\d+"), 15).otherwise(0))
    return s.select(*SHEET, F.greatest(F.lit(0), score).cast("int").alias("score"))


def best_sheet(rows: DataFrame) -> DataFrame:
    """Sheet to parse per workbook: best score above 0 among non-cover sheets, else the first sheet."""
    s = score_sheets(rows)
    ok = ~F.lower("sheet").rlike(any_word(SHEET_SKIP)) & (F.col("score") > 0)
    n = F.struct(F.when(ok, 0).otherwise(1), F.when(ok, -F.col("score")).otherwise(0), F.col("sheet"))
    return s.groupBy("file_id").agg(F.min_by(F.struct("sheet", "score"), n).alias("b")).select("file_id", "b.*")


def is_multi_sheet_form(rows: DataFrame) -> DataFrame:
    name = F.lower("sheet")
    return rows.groupBy("file_id").agg(
        ((F.count_distinct("sheet") >= 3) | F.bool_or(name.rlike(any_word(SHARED_FORM))) | F.bool_or(name.rlike(r"lot\s*\d+")))
        .alias("multi_sheet_form"))


MISSING = ("Aucun lot détecté", "Aucune section détectée", "Aucune colonne de prix détectée",
           "Aucune colonne d'unité détectée", "Aucun élément détecté")
# First advice given for each missing part.
ADVICE = ("Ajouter une ligne de lot explicite (ex: 'LOT 1 - Description')",
          "Structurer le fichier avec des sections/chapitres",
          "Ajouter une colonne 'Prix Unitaire' ou 'P.U.'",
          "Ajouter une colonne 'Unité' avec les unités de mesure",
          "Vérifier que chaque ligne d'élément a une désignation et un prix")


def structure_score(rows: DataFrame) -> DataFrame:
    """Score 0-1 per workbook (best sheet), what is missing on that sheet, and advice."""
    cells = F.slice("cells", 1, 19)
    text = F.lower(F.array_join(cells, " "))
    short = F.length(text) < 200
    head = F.col("row") < 10

    def heads(words):
        return F.sum(F.when(head, F.size(F.filter(cells, lambda c: F.lower(c).rlike(any_word(words))))).otherwise(0))

    digits = F.size(F.filter(cells, lambda c: F.regexp_replace(c, "[ €]", "").rlike(r"^\d+$")))
    s = rows.filter((F.col("row") < 199) & F.exists(cells, lambda c: c != "")).groupBy(*SHEET).agg(
        F.count_if(short & text.rlike(any_word(LOT_WORDS))).alias("lots"),
        F.count_if(short & text.rlike(any_word(SECTION_WORDS))).alias("sections"),
        heads(PRICE_WORDS).alias("price_columns"), heads(UNIT_WORDS).alias("unit_columns"),
        F.count_if((digits >= 2) & (F.length(text) > 10)).alias("elements"))
    e = F.col("elements")
    pts = (F.when(F.col("lots") > 0, 25).otherwise(0) + F.when(F.col("sections") > 0, 20).otherwise(0)
           + F.when(F.col("price_columns") > 0, 20).otherwise(0) + F.when(F.col("unit_columns") > 0, 15).otherwise(0)
           + F.when(e >= 10, 20).when(e >= 5, 10).when(e > 0, 5).otherwise(0))
    s = s.withColumn("points", pts)
    best = s.groupBy("file_id").agg(F.min_by(F.struct("*"), F.struct(-F.col("points"), "sheet")).alias("b")).select("b.*")
    parts = ("lots", "sections", "price_columns", "unit_columns", "elements")
    score = F.col("points") / 100.0

    def pick(texts):
        return F.array_compact(F.array(*[F.when(F.col(p) == 0, t) for p, t in zip(parts, texts)]))

    return best.select(
        *SHEET, *parts, score.cast("double").alias("score"),
        F.when(score >= 0.8, "Structure DPGF bien définie").when(score >= 0.5, "Structure DPGF partielle")
        .otherwise("Structure DPGF faible ou absente").alias("reason"),
        pick(MISSING).alias("missing"),
        F.concat(F.when(score < 0.3, F.array(F.lit("Examiner manuellement le contenu du fichier"))).otherwise(F.array().cast("array<string>")),
                 pick(ADVICE),
                 F.when(score >= 0.6, F.array(F.lit("Vérifier les détails de l'import")))
                 .when(score >= 0.3, F.array(F.lit("Fichier partiellement compatible - Améliorer la structure")))
                 .otherwise(F.array().cast("array<string>"))).alias("advice"))


def workbook_profile(rows: DataFrame) -> DataFrame:
    """Sheets, rows, columns, cells, largest sheet and number of empty sheets."""
    filled = F.sum(F.size(F.filter("cells", lambda c: c != "")))
    s = rows.groupBy(*SHEET).agg(*_shape(), filled.alias("_f"))
    area = F.col("n_rows").cast("bigint") * F.col("n_cols")
    return s.groupBy("file_id").agg(
        F.count("*").alias("sheets"), F.max("n_rows").alias("max_rows"), F.max("n_cols").alias("max_cols"),
        F.sum(area).alias("cells"), F.min_by("sheet", F.struct(-area, "sheet")).alias("largest_sheet"),
        F.count_if(F.col("_f") == 0).alias("empty_sheets"))


def complexity(rows: DataFrame, files: DataFrame, first_sheets=3) -> DataFrame:
    """1.0-3.0 from the number of sheets, the size of the first sheets and the file name."""
    s = rows.groupBy(*SHEET).agg(*_shape())
    w = Window.partitionBy("file_id").orderBy("sheet")
    s = s.withColumn("_k", F.row_number().over(w))
    first, data_rows = F.col("_k") <= first_sheets, F.col("n_rows") - 1
    p = s.groupBy("file_id").agg(
        F.count("*").alias("sheets"),
        F.sum(F.when(first, data_rows.cast("bigint") * F.col("n_cols")).otherwise(0)).alias("_cells"),
        F.count_if(first & (data_rows > 1000)).alias("_long"), F.count_if(first & (F.col("n_cols") > 20)).alias("_wide"))
    score = (10 + F.when(F.col("sheets") > 5, 3).otherwise(0) + 2 * F.col("_long") + 2 * F.col("_wide")
             + F.when(F.col("_cells") > 50000, 5).when(F.col("_cells") > 10000, 3).otherwise(0)
             + F.when(F.lower("name").rlike(any_word(COMPLEX_NAMES)), 2).otherwise(0))
    df = files.join(p, "file_id", "left")
    return df.select("file_id", F.when(F.col("sheets").isNull(), 1.5)
                     .otherwise(F.least(score, F.lit(30)) / 10.0).cast("double").alias("complexity"))


def time_budget(size_mb, level):
    """Seconds allowed for one import."""
    return F.least(F.lit(1800.0), F.greatest(F.lit(180.0), F.lit(60.0) + size_mb * 30.0 + level * 120.0))
