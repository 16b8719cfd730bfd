"""Literal tables for scalars, patterns and section rules, with near misses."""

import random
import re
from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricebook.functions import item_rules as R
from pricebook.functions import scalars as S
from pricebook.functions import text as T
from pricebook.operators import grid as G
from pricebook.operators import items as I


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_numbers(spark):
    raw = ["1 234,56 €", "1.234,56", "1,234.56", "12d", "", "1 234,5", "1 000", "-5,5", "1e3", "abc"]
    assert col(spark, raw, S.parse_number("x")) == [1234.56, 1234.56, 0.0, 0.0, 0.0, 1234.5, 1000.0, -5.5, 1000.0, 0.0]
    assert col(spark, raw, S.parse_number("x", "permissive")) == [1234.56, 0.0, 0.0, 12.0, 0.0, 1234.5, 1000.0, -5.5, 13.0, 0.0]
    assert col(spark, ["12,5 m", "x", "1.2.3"], S.parse_number("x", "digits")) == [12.5, None, None]


def python_number(s):
    s = re.sub(r"[€$£\s]", "", s.strip())
    if "," in s and "." not in s:
        s = s.replace(",", ".")
    elif "," in s and s.find(".") < s.find(","):
        s = s.replace(".", "").replace(",", ".")
    return float(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789,. €-e", max_size=10), min_size=50, max_size=50))
def test_number_model(spark, values):
    assert col(spark, values, S.parse_number("x")) == [python_number(v) for v in values]


def test_units(spark):
    assert col(spark, ["M²", "Mètre linéaire", "u", "Forfait global", "pce", "palette de douze"], S.normalize_unit("x")) == [
        "m2", "ml", "u", "ft", "u", "palette de"]


def test_names(spark):
    assert col(spark, ["LOT_06-DPGF.Métallerie.xlsx"], S.clean_lot_name("x")) == ["06 Métallerie Xlsx"]
    assert col(spark, ["CDC_HABITAT - DPGF  Travaux"], S.clean_client("x")) == ["CDC HABITAT"]
    assert col(spark, ["Métrés été?.xls", "???"], S.safe_filename("x"))[0] == "Metres ete.xls.xlsx"
    assert col(spark, ["Ã©tÃ©"], S.repair_mojibake("x")) == ["été"]
    assert col(spark, ["Peinture et sols", "rien"], S.trade_from_text("x")) == ["Peinture", None]


def test_prices(spark):
    df = spark.sql("select S.* from values (2d, 0d, 10d), (0d, 5d, 10d), (2d, 5d, 0d), (2d, 4d, 10d) as S(q, u, t)")
    got = [tuple(r[0]) for r in df.select(S.complete_prices("q", "u", "t")).collect()]
    assert got == [(2.0, 5.0, 10.0), (2.0, 5.0, 10.0), (2.0, 5.0, 10.0), (2.0, 4.0, 10.0)]
    assert tuple(df.filter("u = 4").select(S.reconcile_prices("q", "u", "t")).first()[0]) == (2.0, 5.0, 10.0, True)


def test_any_word_means_contains(spark):
    words = R.TECHNICAL + R.FALSE_POSITIVE
    texts = list(words) + ["zzz", "pos", "re nard", "le sol gelé", "note"]
    want = [any(w in x for w in words) for x in texts]
    assert col(spark, texts, F.col("x").rlike(T.any_word(words))) == want


def test_ratio_and_trigrams(spark):
    pairs = [("Cloison", "cloisons"), ("", "a"), ("béton armé", "beton arme")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]
    assert col(spark, ["abc"], F.array_sort(T.trigrams("x")))[0] == ["  a", " ab", "abc", "bc "]


SECTIONS = [
    ("1.2 Cloisons", "numbered_standard", "1.2", "Cloisons", 2), ("3.1- Portes", "numbered_punctuated", "3.1", "Portes", 2),
    ("A1.2 Murs", "hierarchical_complex", "A1.2", "Murs", 2), ("B12 Portes", "letter_number", "B12", "Portes", 2),
    ("Lot 06.1 Serrures", "lot_subsection", "Lot 06.1", "Serrures", 3), ("ART. 12 Pose", "article_numbered", "ART. 12", "Pose", 2),
    ("ESCALIERS METALLIQUES", "uppercase_title", None, "ESCALIERS METALLIQUES", 1), ("=== Divers ===", "underlined_title", None, "Divers", 1),
    ("IV - Toiture", "roman_numeral", "IV", "- Toiture", 1), ("A. Portes", "letter_numeral", "A", "Portes", 2),
    ("CHAPITRE 3 : murs", "prefixed_section", "CHAPITRE 3", "murs", 1), ("POSTE 2.1 : tôles", "technical_prefix", "POSTE 2.1", "tôles", 1),
    ("TOTAL : général", "total_section", "TOTAL", "général", 2), ("(A) Portes", "parentheses_numbered", "A", "Portes", 2),
    ("[3] Portes", "brackets_numbered", "3", "Portes", 3), ("- Menuiseries bois", "dash_section", None, "Menuiseries bois", 2),
    ("◦ Menuiseries bois", "bullet_section", None, "Menuiseries bois", 2), ("1,2 Murs", "decimal_french", "1,2", "Murs", 2),
    ("2ème tranche", "ordinal_french", "2ème", "tranche", 1), ("PHASE 2 : gros travaux", "phase_step", "PHASE 2", "gros travaux", 1),
    ("ZONE A - nord", "zone_sector", "ZONE A", "nord", 1), ("ABC123 Portes", "complex_codes", "ABC123", "Portes", 2),
    ("2/10 suite", "fraction_numbered", "2/10", "suite", 2), ("REV.3 initiale", "version_numbered", "REV.3", "initiale", 1),
    ("5-1-2 Murs", "numbered_punctuated", "5", "1-2 Murs", 1), ("porte en bois", None, None, None, None), ("métallerie", None, None, None, None),
]


def test_sections(spark):
    df = spark.createDataFrame([(1, "s", i, x[0]) for i, x in enumerate(SECTIONS)], "file_id int, sheet string, row int, text string")
    got = I.section_level(I.section_fields(I.detect_sections(df))).orderBy("row").collect()
    for r, (text, name, num, title, level) in zip(got, SECTIONS):
        assert r["pattern"] == name, text
        if name in ("total_section",):
            assert r["niveau_hierarchique"] >= 2
            continue
        assert (r["titre_section"], r["niveau_hierarchique"]) == (title, level), text
        if num:
            assert r["numero_section"] == num, text


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=60))
def test_parents_equal_a_stack(spark, levels):
    df = spark.createDataFrame([(1, "s", i, str(i), l) for i, l in enumerate(levels)],
                               "file_id int, sheet string, row int, numero_section string, niveau_hierarchique int")
    got = {r["row"]: r["parent_row"] for r in I.section_parents(df).collect()}
    stack = []
    for i, l in enumerate(levels):
        while stack and stack[-1][1] >= l:
            stack.pop()
        assert got[i] == (stack[-1][0] if stack else None)
        stack.append((i, l))


@pytest.mark.parametrize("name,num,nom", [
    ("DPGF Lot 06 - Métallerie.xlsx", "06", "Métallerie"), ("LOT 12 - DPGF - Peinture.xlsx", "12", "Peinture"),
    ("Lot4.xlsx", "4", "Lot 4 - Travaux"), ("annexe.xlsx", None, None)])
def test_lot_names(spark, name, num, nom):
    r = G.lot_from_filename(spark.createDataFrame([(1, name)], "file_id int, name string")).first()
    assert (r["numero_lot"], r["nom_lot"]) == (num, nom)


def test_parents_of_one_large_sheet(spark):
    """10^5 sections of levels 1 to 40 in one sheet, and levels far beyond: equal to a plain stack."""
    r = random.Random(24)
    levels = [r.randint(1, 40) for _ in range(100_000)] + [1, 32_767, 4_096, 32_767, 511, 512, 7, 8, 63, 64, 9]
    df = spark.createDataFrame(pd.DataFrame({"row": range(len(levels)), "niveau_hierarchique": levels})).select(
        F.lit(1).alias("file_id"), F.lit("s").alias("sheet"), F.col("row").cast("int"),
        F.col("row").cast("string").alias("numero_section"), F.col("niveau_hierarchique").cast("int"))
    got = {x["row"]: (x["parent_row"], x["parent_numero"]) for x in I.section_parents(df).collect()}
    stack = []
    for i, l in enumerate(levels):
        while stack and stack[-1][1] >= l:
            stack.pop()
        assert got[i] == ((stack[-1][0], str(stack[-1][0])) if stack else (None, None))
        stack.append((i, l))
