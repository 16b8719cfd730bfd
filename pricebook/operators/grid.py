"""Layout of a sheet and facts of a workbook: header, columns, lot, client, project.

Input grids are ``rows(file_id, sheet, row, cells)``. A sheet cannot exceed
the 1,048,576 rows of its file format, so per-sheet work is bounded; every
step here reduces a sheet to one row with conditional aggregates.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.functions import patterns as P
from pricebook.functions.scalars import (clean_client, clean_lot_name, fallback_lot_name, layout_signature,
                                         parse_number, trade_from_text)
from pricebook.functions.text import any_pattern, any_word, extract, first_rule, rx
from pricebook.functions.vocab import CLIENT_IGNORE
from pricebook.operators.identify import SHEET, cell_number

ROLES = P.ROLES
UNITS = P.UNIT_LIKE


def anyrx(patterns, whole=False):
    return rx("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$" if whole else any_pattern(patterns))


def _lower_cells(cells, n=None):
    c = F.slice(cells, 1, n) if n else F.col(cells)
    return F.transform(c, lambda x: F.lower(F.trim(x)))


# ---- header and columns -------------------------------------------------------------------------

def header_hits(low, text, profile="main"):
    """Number of column roles whose wording appears in a row, given as its lower-case cells and their joined text."""
    by_row = P.HEADER_RULES[profile][4]
    low, text, hits = F.col(low), F.col(text), []
    for role in ROLES:
        pats = P.HEADER[profile][role]
        if by_row:
            # a whole-cell match matters only for anchored wording: all else already shows in the row text
            anchored = [p for p in pats if p[0] == "^" or p[-1] == "$"]
            found = text.rlike(anyrx(pats))
            if anchored:
                found = found | F.exists(low, _matcher(anyrx(anchored, True)))
        else:
            found = F.exists(low, _matcher(anyrx(pats)))
        hits.append(F.when(found, 1).otherwise(0))
    return sum(hits[1:], hits[0])


def _matcher(pattern):
    return lambda c: c.rlike(pattern)


def find_header_row(rows: DataFrame, profile="main") -> DataFrame:
    """Header row per sheet: first row that reaches the stopping score, else the best one."""
    depth, width, least, stop, _ = P.HEADER_RULES[profile]
    s = rows.filter(F.col("row") < depth).select(*SHEET, "row", "cells", _lower_cells("cells", width).alias("_low"))
    s = s.withColumn("_text", F.array_join("_low", " ")).withColumn("score", header_hits("_low", "_text", profile))
    # rows below the least score have no rank; a filter on the score would be moved before it and count it twice
    sure, enough = F.col("score") >= stop, F.col("score") >= least
    rank = F.struct(F.when(sure, 0).otherwise(1), F.when(sure, F.col("row")).otherwise(-F.col("score")), F.col("row"))
    s = s.select(*SHEET, F.when(enough, rank).alias("_rank"), F.when(enough, F.struct(
        F.col("row").alias("header_row"), F.col("score").alias("header_score"), F.col("cells").alias("headers"))).alias("_row"))
    return (s.groupBy(*SHEET).agg(F.min_by("_row", "_rank").alias("h")).filter("h is not null").select(*SHEET, "h.*"))


def _index_of(flags):
    pos = F.array_position(flags, True)
    return F.when(pos > 0, (pos - 1).cast("int"))


def map_columns(headers: DataFrame, strategy="first", profile="main") -> DataFrame:
    """Column index per role from the header cells: first, last or best scored match."""
    low = _lower_cells("headers")
    out = []
    for role in ROLES:
        pats = P.COLUMNS["scored" if strategy == "scored" else profile][role]
        if strategy == "scored":
            scores = F.transform(low, _header_points(pats))
            best = F.array_max(scores)
            idx = F.when(best > 0, (F.array_position(scores, best) - 1).cast("int"))
        else:
            flags = F.transform(low, _matcher(anyrx(pats)))
            if strategy == "last":
                back = _index_of(F.reverse(flags))
                idx = F.size(flags) - 1 - back
            else:
                idx = _index_of(flags)
        out.append(idx.alias(role))
    return headers.select(*SHEET, "header_row", "headers", *out)


def _header_points(patterns):
    """10 for the whole cell, 7 when the wording is literally inside, 5 otherwise; first pattern that matches."""
    def points(c):
        return first_rule([(c.rlike(rx(p)) & (c != ""), F.when(c.rlike(rx(f"^(?:{p})$")), 10).when(c.contains(p), 7).otherwise(5))
                           for p in patterns], 0)
    return points


def infer_positions(mapping: DataFrame) -> DataFrame:
    """Missing columns from the place of their neighbours; unit-price lists keep no quantity."""
    d, u, q, pu, pt = (F.col(r) for r in ROLES)
    n = F.size("headers")
    pt2 = F.when(pu.isNotNull() & q.isNotNull() & pt.isNull() & (pu + 1 < n), pu + 1).otherwise(pt)
    m = mapping.withColumn("prix_total", pt2)
    pu2 = F.when(pt.isNotNull() & q.isNotNull() & pu.isNull() & (pt - 1 >= 0), pt - 1).otherwise(pu)
    m = m.withColumn("prix_unitaire", pu2)
    price_list = d.isNotNull() & u.isNotNull()
    q2 = F.when(pu.isNotNull() & q.isNull() & ~price_list & (pu - 1 >= 0), pu - 1).otherwise(q)
    m = m.withColumn("quantite", q2)
    u2 = F.when(u.isNull() & d.isNotNull() & q.isNotNull() & (q > d + 1), q - 1).otherwise(u)
    return m.withColumn("unite", u2)


def _cell(i):
    return F.coalesce(F.get("cells", F.lit(i) if isinstance(i, int) else i), F.lit(""))


def text_column(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Column with most long text among the first five, in the rows below the header."""
    near = (F.col("row") > F.col("header_row")) & (F.col("row") < F.col("header_row") + 10)
    sums = [F.sum(F.when(near & (F.length(_cell(i)) > 10), F.length(_cell(i))).otherwise(0)).alias(f"s{i}") for i in range(5)]
    s = rows.filter(F.col("row") < 60).join(headers.select(*SHEET, "header_row"), SHEET).groupBy(*SHEET).agg(*sums)
    arr = F.array(*[F.col(f"s{i}") for i in range(5)])
    return s.select(*SHEET, (F.array_position(arr, F.array_max(arr)) - 1).cast("int").alias("designation"))


def numeric_columns(rows: DataFrame, first_row=5, last_row=20, cols=range(1, 10), least=3) -> DataFrame:
    """Columns with more than ``least`` numbers, most numbers first; the roles they get without a header."""
    counts = [F.struct((-F.count_if(F.col("row").between(first_row, last_row - 1) & cell_number(_cell(i)).isNotNull())).alias("n"),
                       F.lit(i).alias("col")) for i in cols]
    s = rows.filter(F.col("row") < last_row).groupBy(*SHEET).agg(F.array_sort(F.array(*counts)).alias("a"))
    ranked = F.transform(F.filter("a", lambda x: x["n"] < -least), lambda x: x["col"])
    s = s.withColumn("ranked", ranked)
    k = F.size("ranked")
    return s.select(*SHEET, "ranked", F.lit(0).alias("designation"), F.when(k >= 3, 1).alias("unite"),
                    F.when(k >= 2, F.get("ranked", F.lit(0))).alias("quantite"),
                    F.when(k >= 2, F.get("ranked", F.lit(1))).alias("prix_unitaire"),
                    F.when(k >= 3, F.get("ranked", F.lit(2))).alias("prix_total"))


def map_columns_by_content(rows: DataFrame) -> DataFrame:
    """Roles from the content alone: text length, value ranges and unit-like cells per column."""
    c = (rows.filter(F.col("row") < 50).select(*SHEET, "row", F.posexplode("cells").alias("col", "text"))
         .withColumn("text", F.trim("text")).filter("text <> ''"))
    v = parse_number("text", "permissive")
    wordy = (F.col("row") < 30) & (F.length("text") > 5) & ~F.regexp_replace("text", "[., ]", "").rlike(r"^\d+$")
    short = (F.col("row") < 40) & (F.length("text") <= 15)
    pos = F.when(v > 0, v)
    per = c.groupBy(*SHEET, "col").agg(
        F.count_if(wordy).alias("texts"), F.avg(F.when(wordy, F.length("text"))).alias("len"),
        F.count_if(v >= 0).alias("vals"), F.avg(pos).alias("avg"), F.median(pos).alias("med"),
        F.max(pos).alias("max"), F.count_if(short).alias("short"),
        F.count_if(short & F.lower("text").rlike(any_word(UNITS))).alias("units"))
    per = per.withColumn("is_text", (F.col("col") < 8) & (F.col("texts") > 5) & (F.col("len") > 20))
    s = per.groupBy(*SHEET).agg(
        F.min(F.when(F.col("is_text"), F.col("col"))).alias("designation"),
        F.array_sort(F.collect_list(F.struct("col", "vals", "avg", "med", "max", "short", "units"))).alias("cols"))
    num = F.filter("cols", lambda x: (x["vals"] > 5) & x["avg"].isNotNull()
                   & (F.col("designation").isNull() | (x["col"] != F.col("designation"))))
    s = s.withColumn("num", num)

    def col_of(arr, i=0):
        return F.get(F.transform(arr, lambda x: x["col"]), F.lit(i))

    n = F.size("num")
    qty3 = col_of(F.filter("num", lambda x: (x["avg"] < 1000) & (x["med"] < 100)))
    totals = F.filter("num", lambda x: (x["avg"] > 100) & (x["max"] > 1000))
    tot3 = F.get(F.transform(F.array_sort(F.transform(totals, lambda x: F.struct((-x["avg"]).alias("a"), x["col"].alias("col")))),
                             lambda x: x["col"]), F.lit(0))
    s = s.withColumn("_q", qty3).withColumn("_t", tot3)
    rest = col_of(F.filter("num", lambda x: ~(F.coalesce(x["col"] == F.col("_q"), F.lit(False))
                                              | F.coalesce(x["col"] == F.col("_t"), F.lit(False)))))
    a, b = F.get("num", F.lit(0)), F.get("num", F.lit(1))
    lo, hi = F.when(a["avg"] < b["avg"], a["col"]).otherwise(b["col"]), F.when(a["avg"] < b["avg"], b["col"]).otherwise(a["col"])
    far = (a["avg"] < b["avg"] / 10) | (b["avg"] < a["avg"] / 10)
    s = s.select(
        *SHEET, "designation", "cols", "num",
        F.when(n >= 3, F.col("_q")).when((n == 2) & far, lo).alias("quantite"),
        F.when(n >= 3, rest).when((n == 2) & ~far, lo).when((n == 1) & (a["avg"] <= 100), a["col"]).alias("prix_unitaire"),
        F.when(n >= 3, F.col("_t")).when(n == 2, hi).when((n == 1) & (a["avg"] > 100), a["col"]).alias("prix_total"))
    d = F.col("designation")
    numeric_cols = F.transform("num", lambda x: x["col"])
    unit = col_of(F.filter("cols", lambda x: (x["col"] > d) & (x["col"] < d + 5) & ~F.array_contains(numeric_cols, x["col"])
                           & (x["short"] > 5) & (x["units"] / x["short"] > 0.3)))
    return s.select(*SHEET, "designation", unit.alias("unite"), "quantite", "prix_unitaire", "prix_total")


def fill_unit_by_content(rows, mapping):
    """Unit column of a header mapping that lacks one: first column with over 40 % unit-like short cells."""
    c = (rows.join(mapping.filter("unite is null").select(*SHEET, "header_row"), SHEET)
         .filter((F.col("row") > F.col("header_row")) & (F.col("row") <= F.col("header_row") + 30))
         .select(*SHEET, F.posexplode("cells").alias("col", "text")))
    low = F.lower(F.trim("text"))
    short = (low != "") & (F.length(low) <= 15)
    found = (c.groupBy(*SHEET, "col").agg(F.count_if(short).alias("n"), F.count_if(short & low.rlike(any_word(UNITS))).alias("u"))
             .filter((F.col("n") > 5) & (F.col("u") / F.col("n") > 0.4)).groupBy(*SHEET).agg(F.min("col").alias("_u")))
    return mapping.join(found, SHEET, "left").withColumn("unite", F.coalesce("unite", "_u")).drop("_u")


def map_columns_shared(rows: DataFrame) -> DataFrame:
    """Shared forms without header: numbering column then text column; numeric columns by count."""
    early = F.col("row") < 30
    width = F.max(F.size("cells"))
    cands = []
    for i in range(10):
        num = F.count_if(early & _cell(i).rlike(r"^\d+\.\d+(?:\.\d+)?$"))
        txt = F.count_if(early & ~_cell(i).rlike(r"^\d+\.\d+(?:\.\d+)?$") & (F.length(_cell(i)) > 15))
        cands.append(F.when(num > 3, F.when(F.lit(i + 1) < width, i + 1)).when(txt > 5, i))
    counts = [F.struct((-F.count_if(early & cell_number(_cell(i)).isNotNull())).alias("n"), F.lit(i).alias("col")) for i in range(15)]
    s = rows.filter(early).groupBy(*SHEET).agg(F.coalesce(*cands).alias("designation"), F.array_sort(F.array(*counts)).alias("a"))
    s = s.withColumn("r", F.transform(F.filter("a", lambda x: x["n"] < -5), lambda x: x["col"]))
    k = F.size("r")

    def at(i):
        return F.get("r", F.lit(i))

    return s.select(*SHEET, "designation", F.lit(None).cast("int").alias("unite"), F.when(k >= 3, at(0)).alias("quantite"),
                    F.when(k >= 3, at(1)).when(k == 2, at(0)).alias("prix_unitaire"),
                    F.when(k >= 3, at(2)).when(k == 2, at(1)).alias("prix_total"))


def mapping_confidence(mapping: DataFrame, scorer="main") -> DataFrame:
    """Points and level of a column mapping."""
    has = {r: F.when(F.col(r).isNotNull(), 1).otherwise(0) for r in ROLES}
    if scorer == "main":
        head = F.lower(F.get("headers", F.col("designation")))
        named = F.when(F.coalesce(head.rlike("designation|description|libelle|article"), F.lit(False)), 1).otherwise(0)
        pts = (has["designation"] + has["unite"] + has["prix_unitaire"]
               + F.greatest(has["quantite"], has["prix_total"]) + named)
        level = F.when(pts >= 4, "high").when(pts >= 2, "medium").otherwise("low")
    elif scorer == "header":
        pts = F.least(F.lit(5), has["designation"] * 2 + has["prix_unitaire"] * 2 + has["unite"] + has["quantite"] + has["prix_total"])
        level = F.when(pts >= 4, "high").when(pts >= 3, "medium").otherwise("low")
    else:
        pts = F.least(F.lit(5), has["designation"] * 2 + has["unite"] + has["quantite"] + has["prix_unitaire"] + has["prix_total"])
        level = F.when(pts >= 3, "medium").otherwise("low")
    return mapping.withColumn("points", pts).withColumn("level", level)


def apply_saved_mappings(mapping: DataFrame, files: DataFrame, saved: DataFrame) -> DataFrame:
    """Mappings known for the layout signature replace the detected ones."""
    m = (mapping.join(files.select("file_id", "name"), "file_id")
         .withColumn("signature", layout_signature("headers", F.regexp_replace("name", r"\.[^.]*$", ""))))
    s = saved.select("signature", *[F.col(r).alias(f"_{r}") for r in ROLES], F.lit(True).alias("_hit"))
    m = m.join(s, "signature", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return m.select(*SHEET, "header_row", "headers", "signature",
                    *[F.when(hit, F.col(f"_{r}")).otherwise(F.col(r)).alias(r) for r in ROLES], hit.alias("manual"))


def new_saved_mappings(mapping: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows to append to the saved mappings: one per signature not yet known."""
    fresh = mapping.join(saved.select("signature"), "signature", "left_anti")
    return fresh.groupBy("signature").agg(*[F.min_by(r, F.struct("file_id", "sheet")).alias(r) for r in ROLES])


# ---- lot ------------------------------------------------------------------------------------------

def stem(name):
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.[^.\\/]*$", "")


def lot_from_filename(files: DataFrame, profile="main") -> DataFrame:
    """Lot number and name from the file name; the first pattern with a valid number wins."""
    f = files.withColumn("_s", stem("name"))
    s = F.col("_s")
    cands = []
    for i, p in enumerate(P.LOT_FILE[profile]):
        num = F.regexp_extract(s, rx(p), 1)
        raw = F.regexp_extract(s, rx(p), 2) if re.compile(p).groups > 1 else F.lit("")
        ok = s.rlike(rx(p))
        if profile == "main":
            ok = ok & num.try_cast("int").between(1, 99)
        cands.append(F.when(ok, F.struct(F.trim(num).alias("num"), F.trim(raw).alias("raw"), F.lit(i).alias("pattern"))))
    f = f.withColumn("_m", F.coalesce(*cands))
    num, raw = F.col("_m.num"), F.col("_m.raw")
    if profile == "main":
        clean = clean_lot_name(raw)
        nom = F.when(F.length(clean) < 3, fallback_lot_name(num, s)).otherwise(clean)
    elif profile == "enhanced":
        clean = clean_lot_name(raw, "small")
        nom = F.when(raw == "", fallback_lot_name(num, s, "small")).otherwise(
            F.when(clean == "", F.concat(F.lit("Lot "), num)).otherwise(clean))
    else:
        nom = F.when(raw == "", F.concat(F.lit("Lot "), num)).otherwise(raw)
    if profile == "service":
        only = F.col("_m").isNull() & s.rlike(rx(r"\bdpgf\b"))
        num, nom = F.when(only, "1").otherwise(num), F.when(only, F.concat(F.lit("Lot issu de "), s)).otherwise(nom)
    return f.select("file_id", "name", num.alias("numero_lot"), nom.alias("nom_lot"),
                    F.col("_m.pattern").alias("pattern"))


def lot_inferred(files: DataFrame) -> DataFrame:
    """Last resort: a number 1-99 in a name that speaks of a lot, with its trade; else the folder."""
    low = F.lower("name")
    nums = F.filter(F.regexp_extract_all(stem("name"), F.lit(r"\d{1,2}"), 0), lambda d: d.try_cast("int").between(1, 99))
    num = F.when(low.rlike(any_word(P.LOT_WORDS)), F.get(nums, F.lit(0)))
    nom = F.concat(F.coalesce(trade_from_text(low), F.lit("Travaux")), F.lit(" - Lot "), num)
    pnum = extract("path", P.LOT_PATH, 1)
    praw = clean_lot_name(F.coalesce(extract("path", P.LOT_PATH, 2), F.lit("")))
    pnom = F.when(praw == "", F.concat(F.lit("Lot "), pnum)).otherwise(praw)
    return files.select("file_id", "name", F.coalesce(num, pnum).alias("numero_lot"),
                        F.when(num.isNotNull(), nom).otherwise(pnom).alias("nom_lot"))


def lot_from_content(rows: DataFrame, variant="main") -> DataFrame:
    """Lot titles in the first rows; the service variant keeps one per cleaned number."""
    depth, width = (15, None) if variant == "main" else (20, 10)
    cells = F.slice("cells", 1, width) if width else F.col("cells")
    c = (rows.filter(F.col("row") < depth).select(*SHEET, "row", F.posexplode(cells).alias("col", "text"))
         .withColumn("text", F.trim("text")).filter("text <> ''"))
    if variant == "main":
        p = P.LOT_CELL[0]
        hit = F.when(F.col("text").rlike(rx(p)), F.struct(F.regexp_extract("text", rx(p), 1).alias("num"),
                                                         F.regexp_extract("text", rx(p), 2).alias("nom")))
        c = c.withColumn("_m", hit).filter("_m is not null")
        return c.select(*SHEET, "row", "col", F.trim("_m.num").alias("numero_lot"), F.trim("_m.nom").alias("nom_lot"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?U)" + p), F.struct(
        F.lit(i).alias("k"), F.trim(F.regexp_extract("text", "(?U)" + p, 1)).alias("num"),
        F.trim(F.regexp_extract("text", "(?U)" + p, 2)).alias("nom"))) for i, p in enumerate(P.LOT_CELL_SERVICE)]))
    c = c.select(*SHEET, "row", "col", F.explode(hits).alias("m"))
    digits = F.regexp_replace("m.num", r"[^\d.]", "")
    c = c.select(*SHEET, "row", "col", F.col("m.k").alias("k"), F.when(digits == "", F.col("m.num")).otherwise(digits).alias("numero_lot"),
                 F.when(F.col("m.nom") == "", F.concat(F.lit("Lot "), F.col("m.num"))).otherwise(F.col("m.nom")).alias("nom_lot"))
    return (c.groupBy("file_id", "numero_lot").agg(F.min_by(F.struct("sheet", "row", "col", "nom_lot"), F.struct("sheet", "row", "col", "k")).alias("m"))
            .select("file_id", "numero_lot", "m.*"))


def detect_lot(files: DataFrame, rows: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Lot per file: name, then inferred from name or folder, then external labels, then content, then default."""
    by_name = lot_from_filename(files).select("file_id", F.struct("numero_lot", "nom_lot").alias("a")).filter("a.numero_lot is not null")
    inferred = lot_inferred(files).select("file_id", F.struct("numero_lot", "nom_lot").alias("b")).filter("b.numero_lot is not null")
    content = lot_from_content(rows).groupBy("file_id").agg(
        F.min_by(F.struct("numero_lot", "nom_lot"), F.struct("sheet", "row", "col")).alias("c"))
    df = files.join(by_name, "file_id", "left").join(inferred, "file_id", "left").join(content, "file_id", "left")
    picks = [F.col("a"), F.col("b"), F.col("c")]
    sources = [(F.col("a").isNotNull(), "name"), (F.col("b").isNotNull(), "inferred"), (F.col("c").isNotNull(), "content")]
    if external is not None:
        df = df.join(external.select("file_id", F.struct("numero_lot", "nom_lot").alias("x")), "file_id", "left")
        picks.insert(2, F.col("x"))
        sources.insert(2, (F.col("x").isNotNull(), "external"))
    default = F.struct(F.lit("00").alias("numero_lot"), F.concat(F.lit("Lot par défaut - "), stem("name")).alias("nom_lot"))
    return df.withColumn("l", F.coalesce(*picks, default)).select(
        "file_id", "name", "l.numero_lot", "l.nom_lot", first_rule(sources, "default").alias("source"))


# ---- client and project ---------------------------------------------------------------------------

def client_from_filename(files: DataFrame) -> DataFrame:
    s = stem("name")
    cands = [clean_client(F.regexp_extract(s, rx(p), 1)) for p in P.CLIENT_FILE]
    return files.select("file_id", "name", F.coalesce(*[F.when(F.length(c) > 3, c) for c in cands]).alias("client"))


def _known(text):
    return first_rule([(F.upper(text).contains(c), c) for c in P.COMPANIES])


def _cell_client(text):
    cands = []
    for p in P.CLIENT_CELL:
        c = clean_client(F.regexp_extract(text, p, 1))
        ok = (F.length(c) >= 3) & c.rlike(r"\p{L}") & c.rlike(r"[^ ]{2,}")
        cands.append(F.when(text.rlike(p) & ok, c))
    return F.coalesce(*cands, _known(text))


def client_from_content(rows: DataFrame, variant="main") -> DataFrame:
    """Client in the first 15 rows: labelled phrases, then single cells, then known companies."""
    early = rows.filter(F.col("row") < 15)
    if variant == "service":
        c = F.slice("cells", 1, 5)
        label = F.get(F.filter(F.transform(c, lambda x: F.coalesce(*[extract(F.lower(x), p, 1) for p in P.CLIENT_LABEL])),
                               lambda x: x.isNotNull()), F.lit(0))
        return (early.withColumn("client", F.trim(label)).filter("client is not null").groupBy("file_id")
                .agg(F.min_by("client", F.struct("sheet", "row")).alias("client")))
    text = F.array_join(F.filter(F.transform("cells", lambda x: F.trim(x)), lambda c: c != ""), " ")
    phrase = [clean_client(F.regexp_extract(text, rx(p), 1)) for p in P.CLIENT_ROW]
    one = F.coalesce(*[F.when(F.length(c) > 2, c) for c in phrase])
    two = F.get(F.filter(F.transform(F.slice("cells", 1, 8), lambda x: _cell_client(F.trim(x))), lambda x: x.isNotNull()), F.lit(0))
    s = early.select("file_id", "sheet", "row", one.alias("one"), two.alias("two"), _known(text).alias("three"))
    pos = F.struct("sheet", "row")
    return (s.groupBy("file_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), pos)).alias(c) for c in ("one", "two", "three")])
            .select("file_id", F.coalesce("one", "two", "three").alias("client")).filter("client is not null"))


def detect_client(files: DataFrame, rows: DataFrame, suffix=True, content_first=True) -> DataFrame:
    """Client per file: content before name (or the reverse), made unique by lot or word; default from the name."""
    df = (files.join(client_from_content(rows), "file_id", "left")
          .join(client_from_filename(files).select("file_id", F.col("client").alias("by_name")), "file_id", "left"))
    s = stem("name")
    found = F.coalesce("client", "by_name") if content_first else F.coalesce("by_name", "client")
    words = F.filter(F.regexp_extract_all(s, F.lit("[A-Za-z]{4,}"), 0), lambda w: ~F.upper(w).isin(CLIENT_IGNORE))
    word = F.when(F.length(s) > 5, F.get(words, F.lit(0)))
    lot = extract(s, r"Lot\s*(\d+)", 1)
    mark = F.coalesce(F.concat(F.lit("Lot"), lot), F.substring(word, 1, 8), F.substring(F.get(F.split(s, " +"), F.lit(0)), 1, 8))
    unique = F.when(F.upper(found).contains(F.upper(mark)), found).otherwise(F.concat(found, F.lit(" ("), mark, F.lit(")")))
    return df.select("file_id", "name", F.when(found.isNull(), F.initcap(word)).otherwise(unique if suffix else found).alias("client"))


def project_name(files: DataFrame, rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Client, longest early text and lot of the file name, joined; the file name when too short."""
    c = (rows.filter(F.col("row") < 5).select("file_id", "sheet", "row", F.posexplode(F.slice("cells", 1, 3)).alias("col", "text"))
         .withColumn("text", F.trim("text"))
         .filter((F.length("text") > 5) & ~F.upper("text").rlike(any_word(P.PROJECT_SKIP))))
    longest = c.groupBy("file_id").agg(F.min_by("text", F.struct(-F.length("text"), "sheet", "row", "col")).alias("best"))
    df = files.join(longest, "file_id", "left").join(clients.select("file_id", "client"), "file_id", "left")
    s = stem("name")
    num, nom = extract(s, P.PROJECT_LOT, 1), F.trim(extract(s, P.PROJECT_LOT, 2))
    lot = F.when(nom == "", F.concat(F.lit("Lot "), num)).otherwise(F.concat(F.lit("Lot "), num, F.lit(" - "), nom))
    client = F.when(F.length("client") > 2, F.col("client"))
    best = F.substring("best", 1, 50)

    def inside(a, b):
        return F.coalesce(F.lower(b).contains(F.lower(a)), F.lit(False))

    best = F.when(~inside(best, client), best)
    lot = F.when(~inside(lot, client) & ~inside(lot, best), lot)
    full = F.concat_ws(" - ", client, best, lot)
    return df.select("file_id", "name", F.when(F.length(full) < 10, s).otherwise(full).alias("project"))
