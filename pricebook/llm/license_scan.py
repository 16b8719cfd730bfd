"""License scans by a positional rare-token index.

Two passes over the texts. The first counts in how many documents each word of the licence templates occurs; the
result has one row per template word and goes to the driver. From it each template gets its highest-IDF words. The
second pass looks those words up in each document: an occurrence at word i of a word that stands at word j of a
template is a posting for the template at place i - j. Base phrases are verified word by word at every place their
rarest word votes for. A longer template needs ``VOTES`` of its rare words at one place (``SLACK`` words of drift
are allowed), and all its key phrases inside the span of the template there.

score: 1 where a base phrase stands; else the IDF share of the best template's words that stand at their place.

Only positions of the rare words are kept, inside one document. Defined cases: a null or empty text has no words,
no label and score 0; an empty table has no rows; repeated rows are reported each time; other columns are not read.
"""

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# fixed values: base phrases and labels
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# fixed values: opening words of well-known licence notices, their labels and mandatory key phrases
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ("licensed under the apache license", "in compliance with the license")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("hereby granted free of charge", "obtaining a copy of this software")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     ("redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
     ("redistribute it and or modify it", "gnu lesser general public license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("source and binary forms", "following conditions are met")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("subject to the terms of the mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("unencumbered software released into the public domain",)),
    ("cc-by", "this work is licensed under a creative commons attribution",
     ("licensed under a creative commons attribution",)),
    ("spdx", "spdx license identifier", ("spdx license identifier",)),
)
RARE, VOTES, SLACK = 4, 2, 3
OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def vocabulary():
    return sorted({w for text in [p for p, _ in BASE] + [t[1] for t in TEMPLATES] for w in text.split()})


def document_frequency(docs: DataFrame) -> tuple[int, dict]:
    """(documents, {template word: documents with it}); a row per template word and one for the total."""
    words = frozenset(vocabulary())

    def count(batches):
        n, seen = 0, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                if text:
                    seen.update(words.intersection(WORD.findall(text.translate(LOWER))))
        rows = [("", n), *seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["w", "n"])

    found = docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {r["w"]: r["n"] for r in found}
    return df.pop("", 0), df


class Index:
    """Postings of each template's highest-IDF words."""

    def __init__(self, total, df):
        self.idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary()}
        self.base = [(p.split(), label) for p, label in BASE]
        self.templates = [(label, t.split(), [k.split() for k in keys]) for label, t, keys in TEMPLATES]
        self.postings = defaultdict(list)                                # word: (template number, word of the template)
        self.anchor = defaultdict(list)                                  # word: (base phrase, word of the phrase)
        for i, (p, _) in enumerate(self.base):
            at = max(range(len(p)), key=lambda j: (self.idf[p[j]], -j))
            self.anchor[p[at]].append((i, at))
        for i, (_, t, _) in enumerate(self.templates):
            for w in sorted(set(t), key=lambda w: (-self.idf[w], w))[:RARE]:
                self.postings[w] += [(i, j) for j, x in enumerate(t) if x == w]
        self.rare = frozenset(self.anchor) | frozenset(self.postings)
        self.weight = [sum(self.idf[w] for w in t) for _, t, _ in self.templates]

    def scan(self, text):
        w = WORD.findall(text.translate(LOWER)) if text else []
        if not self.rare.intersection(w):
            return len(w), 0, None, None, "", "", 0.0
        starts, base, votes = [], set(), defaultdict(list)
        for i, x in enumerate(w):
            if x in self.rare:
                for p, j in self.anchor.get(x, ()):
                    phrase, label = self.base[p]
                    if i >= j and w[i - j:i - j + len(phrase)] == phrase:
                        starts.append(i - j)
                        base.add(label)
                for t, j in self.postings.get(x, ()):
                    votes[t].append((i - j, x))
        labels, score = set(base), 1.0 if base else 0.0
        for t, found in votes.items():
            label, words, keys = self.templates[t]
            found.sort()
            places = [p for p, _ in found]
            for at in sorted(set(places)):
                near = found[bisect_left(places, at):bisect_left(places, at + SLACK + 1)]
                if len({x for _, x in near}) < min(VOTES, len(set(words))):
                    continue
                span = w[max(at, 0):max(at + len(words) + SLACK, 0)]
                if not base:
                    stands = sum(self.idf[x] for j, x in enumerate(words) if 0 <= at + j < len(w) and w[at + j] == x)
                    score = max(score, stands / self.weight[t])
                if label not in labels and all(self._stands(k, span) for k in keys):
                    labels.add(label)
        text_of = lambda s: ",".join(sorted(s))
        return (len(w), len(starts), min(starts, default=None), max(starts, default=None), text_of(base), text_of(labels),
                round(score, 6))

    @staticmethod
    def _stands(phrase, words):
        return any(words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1) if words[i] == phrase[0])


def scan(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = Index(*document_frequency(docs))
    types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [index.scan(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, types)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
