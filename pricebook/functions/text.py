"""Column expressions for text: patterns, tokens, trigrams, similarity."""

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# French stop words of the search tokenizer.
STOP_WORDS = (
    "le la les un une des du de à au aux et ou pour par en sur sous dans avec sans "
    "ce ces cet cette mon ton son nos vos leurs"
).split()

# Character classes spelled out so that Java, RE2 and Python agree on Unicode text.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def rx(pattern, case=False):
    """A pattern with Unicode classes, ignoring case unless ``case``."""
    return ("(?U)" if case else "(?iuU)") + pattern


def matches(col, pattern, case=False):
    return F.coalesce(F.col(col).rlike(rx(pattern, case)) if isinstance(col, str)
                      else col.rlike(rx(pattern, case)), F.lit(False))


def extract(col, pattern, group=1, case=False):
    """Group of the first match, NULL when the pattern does not match."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(rx(pattern, case)), F.regexp_extract(c, rx(pattern, case), group))


def _quote(ch):
    return "\\" + ch if ch in r"\.+*?()[]{}^$|-&" else ch


def one_of(words):
    """Plain alternation over a literal word list, for anchored use."""
    return "(" + "|".join("".join(_quote(c) for c in w) for w in words) + ")"


def any_word(words):
    """Pattern for "contains one of the words".

    Words that contain another listed word are dropped and common beginnings
    shared, so that each text position is tried once per first letter instead
    of once per word.
    """
    words = sorted(set(words), key=len)
    least = [w for i, w in enumerate(words) if not any(v in w for v in words[:i])]

    def branch(rest):
        heads = {}
        for w in rest:
            heads.setdefault(w[0], []).append(w[1:])
        parts = [_quote(c) + ("" if "" in tails else branch(tails)) for c, tails in sorted(heads.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return branch(least)


def any_pattern(patterns):
    """Pattern for "one of the patterns is found".

    Common literal beginnings are shared, as in ``any_word``, and patterns dropped that a literal one decides, so that
    each text position is tried once per first letter instead of once per pattern.
    """
    def parts(p):
        depth = 0
        for c in re.sub(r"\\.|\[[^]]*\]", "", p):
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                return "", f"(?:{p})"
        head = re.match(r"[^\\.\[\](){}^$|?*+]*", p).group()
        if p[len(head):len(head) + 1] in tuple("?*+{"):
            head = head[:-1]
        return head, p[len(head):]

    def branch(rest):
        if ("", "") in rest:
            return ""
        heads, others = {}, []
        for head, tail in rest:
            if head:
                heads.setdefault(head[0], []).append((head[1:], tail))
            else:
                others.append(tail)
        found = [_quote(c) + branch(tails) for c, tails in heads.items()] + others
        return found[0] if len(found) == 1 else "(?:" + "|".join(found) + ")"

    return branch([parts(p) for p in patterns])


def apart(value, f):
    """``f`` of a value, as a lambda of an array function.

    For cascades of many patterns: they stay out of the code made for the whole stage, whose methods are interpreted
    when they get too long to be compiled.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def contains_any(col, words):
    """True when one of the words is a substring of the (lower-case) column."""
    return F.coalesce(col.rlike(any_word(words)), F.lit(False))


def first_rule(rules, default=None):
    """First rule ``(condition, value)`` that holds, in order."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def tokenize(col):
    """Significant lower-case tokens of a text, in order."""
    c = F.col(col) if isinstance(col, str) else col
    flat = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD}]", " ")
    return F.filter(F.split(flat, " +"),
                    lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def query_terms(text):
    """The same tokens for a query given by the user, on the driver."""
    words = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text.lower()).split()
    return [w for w in words if len(w) > 1 and w not in STOP_WORDS]


CI_AI = "UNICODE_CI_AI"


def has(col, term, collation=None):
    """Substring test ignoring case; under ``CI_AI`` accents are ignored too."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.lower(c).contains(term) if collation is None else F.collate(c, collation).contains(F.lit(term))
    return F.coalesce(found, F.lit(False))


def trigrams(col):
    """Distinct padded three-letter grams of the words of a text."""
    c = F.col(col) if isinstance(col, str) else col
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", " "), " +"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a, b):
    """Shared over all grams of two gram sets; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def trigram_similarity(a, b):
    return jaccard(trigrams(a), trigrams(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two trimmed lower-case texts, 0 when one is empty."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        out.append(SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio() if x and y else 0.0)
    return pd.Series(out, dtype="float64")


def confidence_level(score):
    return F.when(score >= 80, "élevée").when(score >= 50, "moyenne").otherwise("faible")
