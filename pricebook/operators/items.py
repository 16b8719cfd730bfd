"""Rows of a sheet to sections and priced elements.

All ordered work is per (file, sheet), whose size the file format bounds at
1,048,576 rows; every window below uses the same partitioning and order, so a
whole corpus is shuffled and sorted once.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.functions import item_rules as R
from pricebook.functions import scalars as S
from pricebook.functions import vocab as V
from pricebook.functions.text import any_word, apart, first_rule, rx
from pricebook.operators.identify import SHEET
from pricebook.operators.scale import key_text

LEVEL_BASE, LEVEL_DIGITS = 8, 5       # 8 ** 5 levels: one for each of the 32,767 characters of a cell


def by_row():
    return Window.partitionBy(*SHEET).orderBy("row")


def lines(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows below the header as text, unit, quantity, unit price and total cells."""
    def cell(role, default=None):
        idx = F.col(role) if default is None else F.coalesce(role, F.lit(default))
        return F.coalesce(F.trim(F.get("cells", idx)), F.lit(""))

    m = mapping.select(*SHEET, "header_row", "designation", "unite", "quantite", "prix_unitaire", "prix_total")
    return (rows.join(m, SHEET).filter(F.col("header_row").isNull() | (F.col("row") > F.col("header_row")))
            .filter(F.exists("cells", lambda c: c != ""))
            .select(*SHEET, "row", "cells", cell("designation", 0).alias("text"), cell("unite").alias("unit_cell"),
                    cell("quantite").alias("q_cell"), cell("prix_unitaire").alias("pu_cell"), cell("prix_total").alias("pt_cell")))


# ---- sections -------------------------------------------------------------------------------------

def _pattern(p, any_case):
    return rx(p, case=not any_case)


def detect_sections(df: DataFrame, profile="main") -> DataFrame:
    """Name of the first section pattern a text matches, NULL for other rows.

    No pattern starts with a small letter, but for the two that ignore case
    (LOT, ART): one cheap test spares most element rows the cascade.
    """
    def cascade(t):
        return first_rule([(t.rlike(_pattern(p, ci)), name) for name, p, ci, _, _ in R.PROFILES[profile]])

    return df.withColumn("pattern", F.when(F.col("text").rlike(r"^(?:\P{Ll}|[la])"), apart("text", cascade)))


def stable_number(title, prefix, digits):
    """Number for an unnumbered title, the same in every run."""
    n = F.conv(F.substring(F.md5(title), 1, 8), 16, 10).cast("bigint") % (10 ** digits)
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0"))


def section_fields(df: DataFrame, profile="main") -> DataFrame:
    """Number, title and level of the rows that matched; the level of totals is still open (NULL)."""
    def texts(s):
        t, found = s["text"], []
        for n, p, ci, rule, _ in R.PROFILES[profile]:
            def g(i, p=p, ci=ci):
                return F.trim(F.regexp_extract(t, _pattern(p, ci), i))
            if rule == "number":
                num, title = g(1), F.when(g(2) == "", F.concat(F.lit("Section "), g(1))).otherwise(g(2))
            elif rule == "prefix":
                num = F.concat_ws(" ", g(1), g(2))
                title = F.when(g(3) == "", num).otherwise(g(3))
            elif rule == "total":
                num, title = g(1), F.when(g(2) == "", g(1)).otherwise(g(2))
            elif rule == "title":
                num, title = t, t
            else:
                title = g(2) if rule == "hash_TITLE" else g(1)
                num = stable_number(title, {"hash_S": "S", "hash_SEC": "SEC_", "hash_TITLE": "TITLE_"}[rule],
                                    4 if rule == "hash_S" else 3)
            found.append((s["pattern"] == n, F.struct(num.alias("num"), title.alias("title"))))
        return first_rule(found)

    def levels(s):
        return first_rule([(s["pattern"] == n, _level(level, s["_num"])) for n, _, _, _, level in R.PROFILES[profile]]).cast("int")

    is_sec = F.col("pattern").isNotNull()           # spares other rows the chains of comparisons
    df = df.withColumn("_f", F.when(is_sec, apart(F.struct("text", "pattern"), texts)))
    df = df.withColumn("_num", F.col("_f.num")).withColumn("_title", F.col("_f.title")).drop("_f")

    def cut(c, limit):
        return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)

    return (df.withColumn("_level", F.when(is_sec, apart(F.struct("pattern", "_num"), levels)))
            .withColumn("numero_section", cut(F.col("_num"), 50)).withColumn("titre_section", cut(F.col("_title"), 255))
            .drop("_num", "_title"))


def _level(rule, num):
    def count(chars):
        return F.length(num) - F.length(F.regexp_replace(num, f"[{chars}]", ""))

    if rule in ("1", "2"):
        return F.lit(int(rule))
    return {
        "separators": lambda: count(".,") + 1,
        "dots_or_code": lambda: F.when(num.rlike(r"^[A-Z]\d+$"), 1).otherwise(count(".") + 1),
        "dotted": lambda: F.when(num.rlike(r"\d+\.\d+"), 3).otherwise(2),
        "dashes": lambda: count("-") + 1,
        "commas": lambda: count(",") + 1,
        "digit": lambda: F.when(num.rlike(r"^\d+$") & (F.coalesce(num.try_cast("bigint"), F.lit(9)) <= 5), num.try_cast("int")).otherwise(2),
        "fraction": lambda: F.least(F.coalesce(F.split(num, "/")[0].try_cast("int"), F.lit(5)), F.lit(5)),
        "total": lambda: F.lit(None).cast("int"),
    }[rule]()


def section_level(df: DataFrame) -> DataFrame:
    """Closed levels: a total takes the level of the section before it, at least 2."""
    known = F.last("_level", ignorenulls=True).over(by_row())
    is_sec = F.col("pattern").isNotNull()
    return df.withColumn("niveau_hierarchique", F.when(is_sec, F.coalesce(
        "_level", F.greatest(F.lit(2), F.coalesce(known, F.lit(0)))))).drop("_level")


def section_parents(sections: DataFrame) -> DataFrame:
    """Row and number of the nearest earlier section of a smaller level, at any level.

    The levels smaller than a level are, digit by digit in base ``LEVEL_BASE``, those with the same higher digits and a
    smaller one here. So each digit is one window per (sheet, higher digits) that carries the last section of every
    digit value: all windows share one shuffle by sheet, and a sheet of n sections costs ``LEVEL_DIGITS`` sorts of n
    rows whatever its levels are. The digits hold every level that the text of a cell can have.
    """
    lvl, here = F.col("niveau_hierarchique"), F.struct("row", "numero_section")
    s, cands = sections, []
    for d in range(LEVEL_DIGITS):
        unit = LEVEL_BASE ** d
        digit = F.pmod(F.floor(lvl / unit), F.lit(LEVEL_BASE))
        before = (Window.partitionBy(*SHEET, F.floor(lvl / (unit * LEVEL_BASE))).orderBy("row")
                  .rowsBetween(Window.unboundedPreceding, -1))
        last = {f"_a{d}_{k}": F.last(F.when(digit == k, here), ignorenulls=True).over(before) for k in range(LEVEL_BASE - 1)}
        near = F.array(*[F.when(digit > k, F.col(f"_a{d}_{k}")) for k in range(LEVEL_BASE - 1)])
        s = s.withColumns(last).withColumn(f"_d{d}", F.array_max(F.array_compact(near))).drop(*last)
        cands.append(f"_d{d}")
    best = F.greatest(*cands)                           # structs compare by row first
    return (s.withColumn("_p", best).withColumn("parent_row", F.col("_p.row"))
            .withColumn("parent_numero", F.col("_p.numero_section")).drop("_p", *cands))


# ---- elements -------------------------------------------------------------------------------------

def _pts(cond, p):
    return F.when(cond, p).otherwise(0)


def score_elements(df: DataFrame, profile="main", compat=False) -> DataFrame:
    """Evidence points and decision per row; rows with a section pattern are never elements."""
    t = F.col("text")
    low, n = F.lower(t), F.length(t)
    q, pu, pt = (S.parse_number(c, "standard" if profile != "enhanced" else "permissive") for c in ("q_cell", "pu_cell", "pt_cell"))
    df = df.withColumn("_q", q).withColumn("_pu", pu).withColumn("_pt", pt)
    q, pu, pt = F.col("_q"), F.col("_pu"), F.col("_pt")
    unit = F.lower("unit_cell")
    next_text = F.when(F.lead("row").over(by_row()) == F.col("row") + 1, F.lead("text").over(by_row()))
    cont = F.coalesce(next_text.rlike(("(?i)" if compat else "") + R.CONTINUATION), F.lit(False))
    around = {"next_continues": cont}
    if profile == "main":
        around["_prev_row"] = F.lag("row").over(by_row())           # for the merge of continuation lines
    first = F.coalesce(F.get(F.split(t, " +"), F.lit(0)), F.lit(""))
    plain = F.col("pattern").isNull() & (t != "")
    has_unit = ~unit.isin("", "0", "nan", "-")
    number = (q > 0) | (pu > 0) | (pt > 0)
    df = df.withColumns(around)
    if profile == "main":
        # each word list is tried once a row, though points, kind and decision all ask for it
        df = df.withColumns({
            "_tech": low.rlike(any_word(R.TECHNICAL)), "_lump": low.rlike(any_word(V.FORFAIT_WORDS)),
            "_open": low.rlike(any_word(V.VARIABLE_WORDS)), "_code": first.rlike("|".join(f"(?:{rx(p)})" for p in V.ARTICLE_EVIDENCE)),
            "_coded": (F.length(first) >= 3) & first.rlike(r"\d") & (n > F.length(first) + 5)})
        tech, code, coded = F.col("_tech"), F.col("_code"), F.col("_coded")
        article = code | coded
        kind = F.when(F.col("_open"), "variable").when(F.col("_lump"), "forfait").otherwise("standard")
        pts = (_pts(n > 2, 1) + _pts((n > 2) & tech, 2) + _pts((n > 2) & F.col("_lump"), 1)
               + _pts((n > 2) & F.col("_open"), 1) + _pts(code, 2) + _pts(coded, 1)
               + _pts(has_unit, 1) + F.when(has_unit & unit.rlike(any_word(R.KNOWN_UNITS)), 2)
               .when(has_unit & (F.length(unit) <= 5) & unit.rlike(r"^\p{L}+$"), 1).otherwise(0)
               + _pts(q > 0, 1) + _pts(q.between(0.01, 10000), 1) + _pts(pu > 0, 2) + _pts(pu.between(0.01, 100000), 1)
               + _pts(pt > 0, 2) + _pts(pt.between(1, 1000000), 1) + _pts(F.col("next_continues"), 1)
               + _pts(low.rlike(any_word(R.CONTEXT)), 1) - _pts(low.rlike(any_word(R.FALSE_POSITIVE)) & (n < 50), 2))
        df = df.withColumn("kind", kind).withColumn("has_article", article).withColumn("score", pts)
        least = F.when(F.col("kind") == "forfait", 2).otherwise(3)
        ok = (n >= 5) & (number | has_unit | F.col("has_article") | tech) & (F.col("score") >= least)
    elif profile == "enhanced":
        article = first.rlike(r"^[A-Z]?\d+(?:\.\d+)*$")
        has_unit = ~unit.isin("", "0", "nan")
        pts = (_pts(n > 3, 1) + _pts((n > 3) & low.rlike(any_word(R.WORK_WORDS)), 2) + _pts(has_unit, 1)
               + _pts(has_unit & unit.rlike(any_word(R.SMALL_UNITS)), 1) + _pts(pt > 0, 2) + _pts(pu > 0, 2) + _pts(q > 0, 1)
               + _pts(article, 1) + _pts(low.rlike(any_word(R.PHRASES)), 1))
        df = df.withColumn("kind", F.lit("standard")).withColumn("has_article", article).withColumn("score", pts)
        ok = (n > 3) & (number | has_unit | F.col("has_article")) & (F.col("score") >= 2)
    else:
        priced = (F.col("pt_cell") != "") | ((F.col("pu_cell") != "") & (F.col("q_cell") != ""))
        after = F.last(F.when(F.col("pattern").isNotNull(), F.col("row")), ignorenulls=True).over(by_row()).isNotNull()
        df = df.withColumn("_after", after).withColumn("kind", F.lit("standard")).withColumn("has_article", F.lit(False))
        if profile == "service":
            priced = priced | low.rlike(any_word(R.SERVICE_UNITS)) | (n > 30)
        df = df.withColumn("score", _pts(priced, 1))
        ok = F.col("_after") & priced
    return df.withColumn("is_element", F.coalesce(plain & ok, F.lit(False))).drop("_after", "_tech", "_lump", "_open", "_code", "_coded")


def merge_continuations(df: DataFrame, limit=4, compat=False, attach=False) -> DataFrame:
    """Append up to ``limit`` continuation lines to the element above them.

    By default a continuation has text only (a row with its own unit or figures
    is an item of its own) and is consumed; ``compat`` goes by the text alone
    and leaves the appended rows as rows. ``attach`` finds the current section
    in the same pass over a sheet, for ``attach_sections``.
    """
    if "_prev_row" not in df.columns:
        df = df.withColumn("_prev_row", F.lag("row").over(by_row()))
    prev_adjacent = F.col("_prev_row") == F.col("row") - 1
    if not compat:
        prev_adjacent = prev_adjacent & (F.concat("unit_cell", "q_cell", "pu_cell", "pt_cell") == "")
    cont = F.coalesce(F.col("pattern").isNull() & prev_adjacent & F.col("text").rlike(("(?i)" if compat else "") + R.CONTINUATION), F.lit(False))
    df = df.withColumn("_c", cont)
    parts, go = [F.col("text")], F.lit(True)
    for k in range(1, limit + 1):
        go = go & F.coalesce(F.lead("_c", k).over(by_row()), F.lit(False))
        parts.append(F.when(go, F.lead("text", k).over(by_row())))
    base = F.last(F.when(~F.col("_c"), F.struct("row", "is_element")), ignorenulls=True).over(by_row())
    seen = {"_merged": F.concat_ws(" ", *parts), "_base": base}
    df = df.withColumns(seen | {"_s": _last_section()} if attach else seen)
    eaten = F.col("_c") & F.coalesce(F.col("_base.is_element"), F.lit(False)) & (F.col("row") - F.col("_base.row") <= limit)
    if compat:
        eaten = F.lit(False)
    head = F.col("is_element") if compat else F.col("is_element") & ~F.col("_c")
    return (df.withColumn("multiligne", head & (F.col("_merged") != F.col("text")))
            .withColumn("designation", F.when(head, F.col("_merged")).otherwise(F.col("text")))
            .withColumn("consumed", F.coalesce(eaten, F.lit(False)))
            .withColumn("is_element", F.col("is_element") & ~F.col("consumed")).drop("_c", "_merged", "_base", "_prev_row"))


def build_elements(df: DataFrame, variant="main", keep=()) -> DataFrame:
    """Element columns: designation, article, unit and the completed, reconciled, rounded prices.

    Works on the parsed numbers the scoring step left; ``keep`` names further columns to carry.
    """
    if variant == "enhanced":
        e = df.withColumn("_p", S.complete_prices("_q", "_pu", "_pt"))
        return e.select(*SHEET, "row", "designation", F.lit("").alias("numero_article"),
                        F.substring("unit_cell", 1, 10).alias("unite"), "_p.quantite", "_p.prix_unitaire", "_p.prix_total",
                        "kind", "multiligne", *keep)
    e = df.withColumn("_p", S.complete_prices(F.abs("_q"), F.abs("_pu"), F.abs("_pt")))
    e = e.withColumn("_k", S.apply_kind("kind", "designation", "_p.quantite", "_p.prix_unitaire", "_p.prix_total"))
    e = e.withColumn("_r", S.reconcile_prices("_k.quantite", "_k.prix_unitaire", "_k.prix_total"))
    e = e.withColumn("_n", S.round_prices("_r.quantite", "_r.prix_unitaire", "_r.prix_total"))
    e = e.withColumn("_a", S.split_article("_k.designation"))
    art = F.col("has_article") & (F.col("_a.numero_article") != "")
    return e.select(
        *SHEET, "row", F.substring(F.when(art, F.col("_a.designation")).otherwise(F.col("_k.designation")), 1, 500).alias("designation"),
        F.when(art, F.col("_a.numero_article")).otherwise("").alias("numero_article"),
        F.when(F.col("unit_cell") == "", "").otherwise(F.substring(S.normalize_unit("unit_cell"), 1, 10)).alias("unite"),
        "_n.quantite", "_n.prix_unitaire", "_n.prix_total", "kind", "multiligne", *keep)


def _last_section():
    here = F.when(F.col("pattern").isNotNull(), F.struct(F.col("row").alias("r"), "numero_section", "titre_section", "niveau_hierarchique"))
    return F.last(here, ignorenulls=True).over(by_row())


def attach_sections(df: DataFrame) -> DataFrame:
    """Current section of each row; elements before the first section get the default one."""
    num, title, level = R.DEFAULT_SECTION
    if "_s" not in df.columns:
        df = df.withColumn("_s", _last_section())
    return (df.withColumn("section_row", F.coalesce("_s.r", F.lit(-1)))
            .withColumn("section_numero", F.coalesce("_s.numero_section", F.lit(num)))
            .withColumn("section_titre", F.coalesce("_s.titre_section", F.lit(title)))
            .withColumn("section_niveau", F.coalesce("_s.niveau_hierarchique", F.lit(level))).drop("_s"))


def classify(rows, mapping, profile="main", compat=False) -> DataFrame:
    """Every row below the header with its section pattern, evidence, merge state and current section."""
    df = lines(rows, mapping)
    if profile in ("main", "enhanced", "service", "improved", "shared"):
        df = section_level(section_fields(detect_sections(df, profile), profile))
    elements = {"shared": "main"}.get(profile, profile)
    df = merge_continuations(score_elements(df, elements, compat), compat=compat, attach=True) if profile == "main" else (
        score_elements(df, elements).withColumn("designation", F.col("text"))
        .withColumn("multiligne", F.lit(False)).withColumn("consumed", F.lit(False)))
    return attach_sections(df)


RECORD = ("designation", "numero_article", "unite", "quantite", "prix_unitaire", "prix_total", "kind", "multiligne")


def parse_items(rows, mapping, profile="main", compat=False) -> DataFrame:
    """Ordered stream of sections and elements of every sheet, default sections included.

    One pass: the grid is shuffled once, every kept row becomes its item, and
    the first element without a section also yields the default section.
    """
    c = classify(rows, mapping, profile, compat).filter(F.col("pattern").isNotNull() | F.col("is_element"))
    homeless = F.when(F.col("is_element") & (F.col("section_row") == -1), F.col("row"))
    c = c.withColumn("_first", F.min(homeless).over(Window.partitionBy(*SHEET)))
    keep = ("pattern", "section_row", "section_numero", "section_titre", "section_niveau", "_first")
    e = build_elements(c, "main" if profile == "main" else "enhanced", keep)
    kinds = F.when(F.col("pattern").isNotNull(), F.array(F.lit("section"))).when(
        F.col("row") == F.col("_first"), F.array(F.lit("default"), F.lit("element"))).otherwise(F.array(F.lit("element")))
    e = e.withColumn("type", F.explode(kinds))
    return e.select(
        *SHEET, "row", F.when(F.col("type") == "default", "section").otherwise(F.col("type")).alias("type"),
        F.when(F.col("type") == "default", "default").otherwise(F.col("pattern")).alias("pattern"),
        "section_row", "section_numero", "section_titre", "section_niveau",
        *[F.when(F.col("type") == "element", F.col(x)).alias(x) for x in RECORD])


def classify_rows_simple(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Loose classifier: section by row text, else any price, quantity or first text makes an element."""
    def cols_with(words):
        return F.filter(F.transform("headers", lambda h, i: F.when(F.lower(h).rlike(any_word(words)), i)), lambda i: i.isNotNull())

    h = headers.select(*SHEET, "header_row", cols_with(("prix", "p.u", "pu", "€")).alias("pc"),
                       cols_with(("quant", "qté", "qty")).alias("qc0"))
    h = h.withColumn("qc", F.array_except("qc0", "pc")).drop("qc0")
    df = rows.join(h, SHEET).filter(F.col("row") > F.col("header_row"))
    text = F.trim(F.array_join("cells", " "))
    df = df.withColumn("text", text).withColumn("k", first_rule([(text.rlike(rx(p)), i) for i, p in enumerate(R.LOOSE_SECTIONS)]))

    def first_number(cols):
        return F.get(F.filter(F.transform(cols, lambda i: S.parse_number(F.coalesce(F.get("cells", i), F.lit("")), "digits")),
                              lambda v: v.isNotNull()), F.lit(0))

    pu, q = first_number("pc"), first_number("qc")
    until = F.coalesce(F.array_min("qc"), F.size("cells"))
    unit = F.get(F.filter(F.transform(F.slice("cells", F.lit(1), until), lambda c: F.upper(F.trim(c))),
                          lambda c: c.isin(*R.LOOSE_UNITS)), F.lit(0))
    used = F.array_union("pc", "qc")
    desig = F.get(F.filter(F.transform("cells", lambda c, i: F.when(
        ~F.array_contains(used, i) & (F.length(c) > 3) & ~c.rlike(r"^\d+(\.\d+)*$"), F.trim(c))), lambda c: c.isNotNull()), F.lit(0))
    df = df.withColumn("_pu", pu).withColumn("_q", q).withColumn("_d", desig).withColumn("_u", unit)
    is_sec = F.col("k").isNotNull()
    elem = ~is_sec & (F.col("_d").isNotNull() | F.col("_pu").isNotNull() | F.col("_q").isNotNull())
    num = first_rule([(F.col("k") == i, F.regexp_extract("text", rx(p), 1)) for i, p in enumerate(R.LOOSE_SECTIONS)])
    title = first_rule([(F.col("k") == i, F.trim(F.regexp_extract("text", rx(p), 2))) for i, p in enumerate(R.LOOSE_SECTIONS)])
    return df.select(
        *SHEET, "row", F.when(is_sec, "section").when(elem, "element").otherwise("ignore").alias("type"),
        num.alias("numero_section"), title.alias("titre_section"),
        F.when(is_sec, F.length(num) - F.length(F.replace(num, F.lit("."), F.lit(""))) + 1).alias("niveau"),
        F.when(elem, F.coalesce("_d", F.lit("Description manquante"))).alias("designation"),
        F.when(elem, F.coalesce("_u", F.lit(""))).alias("unite"), F.when(elem, F.col("_q")).alias("quantite"),
        F.when(elem, F.col("_pu")).alias("prix_unitaire"), F.when(elem, F.col("_pu") * F.col("_q")).alias("prix_total"))


def annotate_rows(rows, headers, items) -> DataFrame:
    """Kind and code of every row: other 0, header 1, section 2, element 3."""
    kinds = items.groupBy(*SHEET, "row").agg(F.max(F.when(F.col("type") == "element", 3).otherwise(2)).alias("_k"))
    df = (rows.select(*SHEET, "row").join(headers.select(*SHEET, "header_row"), SHEET, "left")
          .join(kinds, [*SHEET, "row"], "left"))
    code = F.when(F.col("row") == F.col("header_row"), 1).otherwise(F.coalesce("_k", F.lit(0)))
    return df.select(*SHEET, "row", code.alias("code"),
                     F.element_at(F.array(*[F.lit(x) for x in ("other", "header", "section", "element")]), code + 1).alias("kind"))


def parse_profile(mapping, items) -> DataFrame:
    """Per file: sheets with a header, columns found, items, sections and elements."""
    cols = sum([F.when(F.col(r).isNotNull(), 1).otherwise(0) for r in ("unite", "quantite", "prix_unitaire", "prix_total")],
               F.when(F.col("designation").isNotNull(), 1).otherwise(0))
    m = mapping.groupBy("file_id").agg(F.count("header_row").alias("headers"), F.max(cols).alias("columns"))
    i = items.groupBy("file_id").agg(F.count("*").alias("items"), F.count_if(F.col("type") == "section").alias("sections"),
                                     F.count_if(F.col("type") == "element").alias("elements"))
    zero = F.lit(0).cast("bigint")
    return m.join(i, "file_id", "full").select("file_id", *[F.coalesce(c, zero).alias(c) for c in (
        "headers", "columns", "items", "sections", "elements")])


def text_blocks(rows: DataFrame, size=20) -> DataFrame:
    """Fixed blocks of row texts with their fingerprint."""
    text = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    b = rows.withColumn("block", F.floor(F.col("row") / size).cast("int")).groupBy(*SHEET, "block").agg(
        F.array_sort(F.collect_list(F.struct("row", text.alias("t")))).alias("a"))
    return b.select(*SHEET, "block", S.block_fingerprint(F.transform("a", lambda x: x["t"])).alias("fingerprint"))


def apply_label_cache(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks with their cached label (the least of several); ``hit`` tells which still need labelling."""
    c = cache.groupBy("fingerprint").agg(F.min("label").alias("label")).withColumn("_h", F.lit(True))
    return blocks.join(c, "fingerprint", "left").withColumn("hit", F.coalesce("_h", F.lit(False))).drop("_h")


def cache_misses(blocks, cache):
    """One row per fingerprint to label."""
    return blocks.join(cache.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint").distinct()
