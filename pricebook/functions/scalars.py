"""Column functions for names, numbers, units, prices and fingerprints."""

import functools
import operator

from pyspark.sql import functions as F

from pricebook.functions import vocab as V
from pricebook.functions.text import any_word, extract, first_rule, matches, rx

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def _words(col):
    return F.filter(F.split(col, " +"), lambda w: w != "")


def normalize_text(col):
    """Lower case without accents, letters, digits and blanks only, trimmed."""
    plain = F.translate(F.lower(F.coalesce(_c(col), F.lit(""))), *V.ACCENTS)
    return F.btrim(F.regexp_replace(plain, r"[^a-z0-9\s]", ""), F.lit(" \t\r\n"))


def repair_mojibake(col):
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), V.MOJIBAKE, _c(col))


def safe_filename(col):
    """File name of plain characters with the workbook extension; a stable name when nothing is left."""
    kept = F.rtrim(F.regexp_replace(F.translate(_c(col), *V.ALL_ACCENTS), r"[^\p{L}\p{N} \-_.()&'°+=,;]", ""))
    empty = F.concat(F.lit("file_"), (F.crc32(_c(col)) % 10000).cast("string"), F.lit(".xlsx"))
    return F.when(F.trim(kept) == "", empty).when(kept.endswith(".xlsx"), kept).otherwise(F.concat(kept, F.lit(".xlsx")))


def _blanks(col, chars):
    return F.trim(F.regexp_replace(F.regexp_replace(col, chars, " "), rx(r"\s+"), " "))


def clean_client(col):
    return F.array_join(F.filter(_words(_blanks(_c(col), r"[_\-\.]+")), lambda w: ~F.upper(w).isin(V.CLIENT_IGNORE)), " ")


def clean_lot_name(col, variant="main"):
    """Lot name without separators, extension and noise words."""
    c = F.coalesce(_c(col), F.lit(""))
    if variant == "main":
        flat = F.regexp_replace(_blanks(c, r"[_\-\.]+"), rx(r"\.(xlsx?|pdf|docx?)$"), "")
        return F.initcap(F.array_join(F.filter(_words(flat), lambda w: ~F.lower(w).isin(V.LOT_NOISE)), " "))
    words = _words(_blanks(F.regexp_replace(c, rx(r"\.(xlsx?|xls|csv)$"), ""), r"[_\-\.]+"))
    name = F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(V.LOT_NOISE_SMALL) & (F.length(w) > 1)), " ")
    spare = F.get(F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(V.LOT_FALLBACK_SKIP)), F.lit(0))
    return F.when((F.length(name) < 5) & spare.isNotNull(), F.initcap(spare)).otherwise(name)


def fallback_lot_name(numero, filename, variant="main"):
    """Name from the first meaningful words of the file name, else a default."""
    num = _c(numero)
    if variant == "main":
        words = F.filter(F.regexp_extract_all(_c(filename), F.lit("[A-Za-z]{3,}"), 0),
                         lambda w: ~F.lower(w).isin(V.FALLBACK_IGNORE) & (F.length(w) > 3))
        tail = F.array_join(F.slice(F.transform(words, F.initcap), 1, 3), " ")
        return F.concat(F.lit("Lot "), num, F.lit(" - "), F.when(tail == "", "Travaux").otherwise(tail))
    low = F.lower(_c(filename))
    rest = F.replace(F.replace(low, F.concat(F.lit("lot "), num), F.lit("")), F.concat(F.lit("lot"), num), F.lit(""))
    words = F.filter(_words(_blanks(rest, r"[_\-\.\(\)]")),
                     lambda w: (F.length(w) > 3) & ~w.isin(V.FALLBACK_IGNORE_SMALL) & ~w.rlike(r"^\d+$"))
    tail = F.array_join(F.slice(F.transform(words, F.initcap), 1, 2), " ")
    trade = trade_from_text(filename, "small")
    return F.coalesce(trade, F.when(tail != "", tail), F.concat(F.lit("Lot "), num))


def to_double(text):
    """Guarded cast: only plain decimal notation counts as a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_number(col, variant="standard"):
    """European numbers. ``standard``/``permissive`` give 0.0 on failure, ``digits`` gives NULL."""
    c = _c(col)
    if variant == "digits":
        return to_double(F.replace(F.regexp_replace(c, r"[^0-9.,]", ""), F.lit(","), F.lit(".")))
    s = F.regexp_replace(c, rx(r"[€$£\s]" if variant == "standard" else r"[€$£¥\s]"), "")
    if variant == "permissive":
        s = F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"[^0-9.\-]", "")
    else:
        comma, dot = F.instr(s, ","), F.instr(s, ".")
        as_dot = F.replace(s, F.lit(","), F.lit("."))
        s = F.when((comma > 0) & (dot == 0), as_dot).when(
            (comma > 0) & (dot > 0) & (dot < comma), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        ).otherwise(s)
    return F.coalesce(to_double(s), F.lit(0.0))


def normalize_unit(col):
    """Exact spelling, then the first spelling contained, else the raw text cut at 10."""
    raw = F.trim(_c(col))
    low = F.lower(raw)
    exact = F.create_map(*[F.lit(x) for pair in V.UNITS for x in pair])
    return F.coalesce(F.try_element_at(exact, low),
                      first_rule([(low.contains(k), v) for k, v in V.UNITS]), F.substring(raw, 1, 10))


def complete_prices(q, pu, pt):
    """(quantity, unit price, total) with the missing third computed from the two others."""
    q, pu, pt = (F.coalesce(_c(x).cast("double"), F.lit(0.0)) for x in (q, pu, pt))
    no_total = (pt == 0) & (q > 0) & (pu > 0)
    no_unit = (pu == 0) & (q > 0) & (pt > 0)
    no_qty = (q == 0) & (pu > 0) & (pt > 0)
    return F.struct(F.when(no_qty, F.try_divide(pt, pu)).otherwise(q).alias("quantite"),
                    F.when(no_unit, F.try_divide(pt, q)).otherwise(pu).alias("prix_unitaire"),
                    F.when(no_total, q * pu).otherwise(pt).alias("prix_total"))


def reconcile_prices(q, pu, pt, tolerance=0.02):
    """Absolute values; when quantity x unit price is off the total, the total wins."""
    q, pu, pt = (F.abs(F.coalesce(_c(x).cast("double"), F.lit(0.0))) for x in (q, pu, pt))
    off = (q > 0) & (pu > 0) & (pt > 0) & (F.abs(q * pu - pt) > tolerance)
    return F.struct(q.alias("quantite"), F.when(off, F.try_divide(pt, q)).otherwise(pu).alias("prix_unitaire"),
                    pt.alias("prix_total"), off.alias("corrige"))


def round_prices(q, pu, pt):
    def half_even(c, scale):
        return F.rint(_c(c) * float(scale)) / F.lit(float(scale))

    return F.struct(half_even(q, 10000).alias("quantite"), half_even(pu, 10000).alias("prix_unitaire"),
                    half_even(pt, 100).alias("prix_total"))


def strip_prefix(col):
    """Text behind a leading number, letter mark or bullet."""
    c = _c(col)
    out = F.coalesce(*[extract(c, p, 1, case=True) for p in (
        r"^\d+(?:\.\d+)*\s+(.+)", r"^[a-z]\)\s+(.+)", r"^[\-\*•]\s+(.+)")], c)
    return F.when(F.trim(out) == "", F.when(F.trim(c) == "", "Description manquante").otherwise(c)).otherwise(F.trim(out))


def split_article(col):
    """(article number, designation without it) when the first word is an article code."""
    words = _words(_c(col))
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    is_code = functools.reduce(operator.or_, [first.rlike(rx(p)) for p in V.ARTICLE_SPLIT])
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(F.when(is_code, F.substring(first, 1, 20)).otherwise("").alias("numero_article"),
                    F.when(is_code, rest).otherwise(_c(col)).alias("designation"))


def block_fingerprint(texts):
    """md5 of the lower-case texts without blanks, joined by a bar."""
    return F.md5(F.array_join(F.transform(_c(texts), lambda x: F.regexp_replace(F.lower(x), rx(r"\s+"), "")), "|"))


def layout_signature(headers, filename):
    """Short md5 of the header texts plus the file name with its numbers masked."""
    cells = F.filter(F.transform(_c(headers), lambda h: F.lower(F.trim(h))), lambda h: h != "")
    sig = F.substring(F.md5(F.array_join(cells, "|")), 1, 8)
    return F.concat(sig, F.lit("_"), F.regexp_replace(F.lower(_c(filename)), r"\d+", "X"))


def element_kind(col):
    low = F.lower(_c(col))
    return (F.when(low.rlike(any_word(V.VARIABLE_WORDS)), "variable")
            .when(low.rlike(any_word(V.FORFAIT_WORDS)), "forfait").otherwise("standard"))


def apply_kind(kind, designation, q, pu, pt):
    """Lump sums get quantity 1, open prices a note in the text."""
    kind, q, pu, pt, text = _c(kind), _c(q), _c(pu), _c(pt), _c(designation)
    lump = (kind == "forfait") & (q == 0)
    note = (kind == "variable") & ~F.lower(text).contains("variable")
    return F.struct(F.when(note, F.concat(text, F.lit(" (Prix variable)"))).otherwise(text).alias("designation"),
                    F.when(lump, 1.0).otherwise(q).alias("quantite"),
                    F.when(lump & (pt > 0), pt).otherwise(pu).alias("prix_unitaire"), pt.alias("prix_total"))


def trade_from_text(col, variant="main"):
    low = F.lower(_c(col))
    return first_rule([(low.rlike(any_word(ws)), name) for name, ws in
                       (V.TRADES if variant == "main" else V.TRADES_SMALL)])


def column_letter(col):
    c = _c(col)
    return F.when(c < 26, F.char(c + 65)).otherwise(F.concat(F.char(F.floor(c / 26) + 64), F.char(c % 26 + 65)))
