"""One pass over a sheet for its items: few windows, word lists tried once, section cascades out of the long methods."""

import random
import re

from pyspark.sql import functions as F

from pricebook.functions import patterns as P
from pricebook.functions.text import any_pattern, rx
from pricebook.operators import grid as G
from pricebook.operators import items as I

CELLS = [["Désignation", "U", "Qté", "P.U. HT", "Montant HT"], ["1.1 Sols", "", "", "", ""], ["A. Murs", "", "", "", ""],
         ["Fourniture et pose de carrelage", "m2", "12", "10,5", "126"], ["- y compris joints", "", "", "", ""],
         ["peinture selon dtu", "ens", "", "", "300"], ["TOTAL LOT", "", "", "", "426"], ["", "", "", "", ""]]


def _rows(spark):
    data = [(1, s, r, CELLS[(r + (r > 0) * k) % len(CELLS)] if r else CELLS[0]) for k, s in enumerate("abc") for r in range(40)]
    return spark.createDataFrame(data, "file_id long, sheet string, row int, cells array<string>")


def test_items_in_three_windows(spark):
    rows = _rows(spark)
    items = I.parse_items(rows, G.infer_positions(G.map_columns(G.find_header_row(rows))))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3
    assert len([x for x in plan.split("\n") if "Filter" in x and "RLIKE" in x]) == 0       # the score of a header row is counted once
    assert items.filter("type = 'element'").count() > 0 and items.filter("type = 'section'").count() > 0


def test_sections_attached_in_the_merging_pass(spark):
    rows = _rows(spark)
    mapping = G.infer_positions(G.map_columns(G.find_header_row(rows)))
    d = I.score_elements(I.section_level(I.section_fields(I.detect_sections(I.lines(rows, mapping)))))
    one, two = (I.attach_sections(I.merge_continuations(d, attach=a)) for a in (True, False))
    assert sorted(one.columns) == sorted(two.columns)
    keep = ["file_id", "sheet", "row", "pattern", "section_row", "section_numero", "section_titre", "section_niveau", "is_element", "consumed", "designation"]
    assert sorted(map(repr, one.select(keep).collect())) == sorted(map(repr, two.select(keep).collect()))


def test_any_pattern_finds_what_the_alternatives_find(spark):
    lists = [ps for rules in (P.HEADER, P.COLUMNS) for roles in rules.values() for ps in roles.values()] + [("a|b", "ab?c", "x", "")]
    rnd, texts = random.Random(7), ["", "u", "un", "un.", "q.", "prix ht", "pu h.t.", "ſomme", "DÉSIGNATION", "coût x unit", "a", "c"]
    for ps in lists:
        for p in ps:
            plain = re.sub(r"\(\?:|[\\^$().?*+]", "", p)
            cut = rnd.randrange(len(plain) + 1)
            texts += [plain, "n " + plain, plain + "s x", plain[:cut], plain[:cut] + "z" + plain[cut:], plain.upper()]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    wrong = [F.count_if(F.col("t").rlike(rx(any_pattern(ps))) != F.col("t").rlike(rx("|".join(f"(?:{p})" for p in ps)))).alias(f"n{i}")
             for i, ps in enumerate(lists)]
    assert set(df.agg(*wrong).first()) == {0}
