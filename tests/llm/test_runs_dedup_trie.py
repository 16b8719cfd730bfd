"""Periodic runs, exact dedup and the prefix trie against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricebook.llm import exact_dedup, periodic_runs, prefix_trie, queries
from pricebook.llm.parentheses import Parentheses
from tests.llm import plain

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
DOCS = "doc_id long, text string, k string, _doc int, digest int, path int"


# ---- periodic runs

@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(0, 59))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_row(x, p, a):
    x = x[:a] + [x[a + (i - a) % p] if a + p <= len(x) else x[i] for i in range(a, len(x))]
    assert periodic_runs.find_runs(np.array(x + [-1], np.int64)) == plain.runs(x)


def test_runs_end_at_separators():
    x = np.array([7] * 9 + [-1] + [7] * 6 + [-2, -3] + [7] * 5 + [-4], np.int64)
    assert periodic_runs.find_runs(x) == [(0, 9, 1), (10, 6, 1)]


@pytest.mark.parametrize("size", (1, 2, 8, 64))
def test_zero_sums_are_the_occurrences(size):
    r = np.random.default_rng(size)
    for top in (2, 10 ** 9):                                    # the second asks for new numbers
        block = r.integers(0, 2, (5, size)) * top
        window = r.integers(0, 2, (5, 2 * size - 1)) * top
        want = np.array([[(w[d:d + size] == b).all() for d in range(size)] for b, w in zip(block, window)])
        assert (periodic_runs.occurrences(block, window) == want).all()


def test_several_primes(monkeypatch):
    r = np.random.default_rng(1)
    block, window = r.integers(0, 3, (4, 8)), r.integers(0, 3, (4, 15))
    window[0, 2:10] = block[0]
    monkeypatch.setattr(periodic_runs, "PRIMES", (17, 257))         # one is too small
    want = np.array([[(w[d:d + 8] == b).all() for d in range(8)] for b, w in zip(block, window)])
    assert (periodic_runs.occurrences(block, window) == want).all()


def test_long_periodic_texts_stay_fast():
    n = 1 << 16
    for x in ([0] * n, [0, 1] * (n // 2), ([0] * 700 + [1]) * (n // 701), list(range(n // 5)) * 5):
        got = periodic_runs.find_runs(np.array(x + [-1], np.int64))
        assert max(got, key=lambda r: r[1])[:2] == (0, len(x))


def _texts():
    r = random.Random(3)
    prose = lambda n: [r.choice("an the lo ré ßu ker IN mo".split()) + str(r.randrange(30)) for _ in range(n)]
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "x " + "ab cd\n" * 5 + "y", " ".join(prose(400)), "a\x0bb\x0ca b " * 30]
    for n in (30, 90, 3000):
        w = prose(n)
        for p in (1, 3, n // 7):
            a = r.randrange(n // 3)
            out.append(" ".join([w[a + (i - a) % p] if a <= i < a + 5 * p else x for i, x in enumerate(w)]))
    return out


def test_periodic_runs(spark):
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(_texts())] + [(4, "a a a a a a", "x", 1, 2, 3), (None, "b " * 9, "x", 1, 2, 3)]
    d = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in periodic_runs.report(d).collect()]
    want = [(i, *plain.periodic(plain.SPACE.findall(t or ""))) for i, t, *_ in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    found = sorted((tuple(r) for r in periodic_runs.runs(d).collect()), key=key)
    assert found == sorted(((i, s, n, q) for i, t, *_ in rows for s, n, q in plain.runs(plain.SPACE.findall(t or ""))), key=key)
    left = periodic_runs.collapse(d)
    assert left.schema == d.schema
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[5] == "a" and texts[0] is None and texts[2] == " \n\t " and texts[6] == "x ab cd y"
    assert periodic_runs.report(d.limit(0)).count() == 0 and periodic_runs.collapse(d.limit(0)).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 1, 2, 7, 40, 200] * 40)] + [(None, "a b")]
    got = {r.doc_id: r.text for r in queries.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain.planted(i, t) for i, t in rows}


# ---- exact dedup

def _copies():
    r = random.Random(8)
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i // 2}", str(i), 1, 2, 3) for i in range(300)]
    rows += [(400, "hot text      ", "a", 1, 2, 3), (399, "hot text      ", "a", 1, 2, 3), (None, "hot text      ", "a", 1, 2, 3),
             (500, None, "a", 1, 2, 3), (501, "", "a", 1, 2, 3), (502, " \n", "b", 1, 2, 3), (503, "é e", "c", 1, 2, 3), (504, "ée", "c", 1, 2, 3),
             (505, "twice", "c", 1, 2, 3), (505, "twice", "c", 1, 2, 3), (505, "tw ice", "c", 1, 2, 3), (506, "x" * 50000, "c", 1, 2, 3),
             (507, "two rows", "p", 1, 2, 3), (507, "two rows", "q", 1, 2, 3)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("counters", (8, exact_dedup.COUNTERS))
def test_exact_dedup(spark, counters):
    rows = _copies()
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.report(d, counters).collect())))
    assert got == sorted(map(str, plain.copies([r[:2] for r in rows])))
    left = exact_dedup.dedup(d, counters)
    assert left.columns == d.columns
    groups = {}
    for r in left.collect():
        groups.setdefault(plain.bare(r.text), []).append(r)
    assert all(len(v) == 1 for v in groups.values()) and set(groups) == {plain.bare(r[1]) for r in rows}
    assert groups["hottext"][0].doc_id == 399 and groups["twice"][0].text == "tw ice" and groups[""][0].doc_id == 502
    assert groups["tworows"][0].k == exact_dedup.dedup(d.repartition(3), counters).where("doc_id = 507").first().k


def test_exact_dedup_finds_what_is_frequent(spark):
    d = spark.createDataFrame(_copies(), DOCS).repartition(4)
    w = exact_dedup.winners(exact_dedup.digests(d)).collect()
    assert [r.keep_id for r in w if r.group_size > 50] == [399] and all(r.group_size > 1 for r in w)


def test_exact_dedup_without_rows_and_with_maps(spark):
    assert exact_dedup.report(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(1, "a"), (2, "a ")], "doc_id long, text string").withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    assert [r.doc_id for r in exact_dedup.dedup(d).collect()] == [2]


# ---- prefix trie

@given(st.lists(st.integers(0, 3), max_size=300))
@settings(max_examples=200, deadline=None)
def test_parentheses(steps):
    """Every step opens a child of the node so many levels above the last one."""
    closes, opens, depth, parents, stack = [0], [1], 1, [-1], [0]
    for up in steps:
        up = min(up, depth - 1)
        closes.append(up)
        opens.append(1)
        depth += 1 - up
        del stack[len(stack) - up:]
        parents.append(stack[-1])
        stack.append(len(parents) - 1)
    p = Parentheses.of_steps(np.array(closes), np.array(opens))
    size, leaves = p.subtrees()
    want = [1] * len(parents)
    leaf = [0 if i in set(parents) else 1 for i in range(len(parents))]
    for i in range(len(parents) - 1, 0, -1):
        want[parents[i]] += want[i]
        leaf[parents[i]] += leaf[i]
    assert size.tolist() == want and leaves.tolist() == leaf


def _conversations():
    r = random.Random(4)
    turns = lambda n: [(("user", "assistant")[i % 2], f"t{r.randrange(2)}") for i in range(n)]
    out = []
    for c in range(120):
        seq = [("user", "hello")] * (c % 3) + turns(r.randrange(1, 12)) if c % 4 else [("user", "same"), ("assistant", "answer é")]
        out += [(c * 3, i, role, text, 0, 0) for i, (role, text) in enumerate(seq)]
    out += [(5, None, "user", "first of all", 0, 0), (5, 1, None, None, 0, 0), (5, 1, None, None, 0, 0), (None, 1, "user", "lost", 0, 0), (7, 0, "", "", 0, 0),
            (1001, 0, "user", "only", 0, 0)] + [(2000, i, "user", "long", 0, 0) for i in range(500)] + [(2001, i, "user", "long", 0, 0) for i in range(400)]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, path int, key int"


@pytest.mark.parametrize("most, fan, chunk", ((1 << 18, 64, 4096), (5, 2, 2), (1, 64, 1)))
def test_prefix_trie(spark, most, fan, chunk, monkeypatch):
    rows = _conversations()
    d = spark.createDataFrame(rows, CONVERSATIONS).repartition(6)
    got = prefix_trie.trie(prefix_trie.paths(d), most, fan)
    names = got.columns
    key = lambda r: tuple(str(x) for x in r)
    want = plain.trie(plain.conversations([r[:4] for r in rows]))
    assert names == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    again = prefix_trie.trie(queries.rebuilt_paths(d), most, fan)
    want = plain.trie(plain.rebuilt(plain.conversations([r[:4] for r in rows])))
    assert sorted(map(tuple, again.collect()), key=key) == sorted(want, key=key)


def test_prefix_trie_without_turns(spark):
    assert prefix_trie.trie(prefix_trie.paths(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    d = spark.createDataFrame([(10 ** 12 + 1, 0, "user", "a", 0, 0)], CONVERSATIONS)
    h = zlib.crc32(str(10 ** 12 + 1).encode()) % 9
    assert h > 0        # its one turn goes and nothing comes: the root alone
    root = prefix_trie.trie(queries.rebuilt_paths(d)).collect()
    assert [tuple(r) for r in root] == [(10 ** 12 + 1, 0, None, 1, 0, 1, 0, sha(str(10 ** 12 + 1)))]


def test_digest_strings_are_bounded(spark):
    """Ids of one path in more strings than one, over more tasks than one, give the digest of all in order."""
    p = spark.range(0, 20000, 1, 7).select((F.col("id") * 7).alias("conv_id"), F.array(F.struct(F.lit(b"k" * 16).alias("k"), F.lit(3).alias("b"))).alias("path"))
    r = prefix_trie.distinct_paths(p).collect()
    assert [(x.n, x.conv_id, x.ends) for x in r] == [(20000, 0, sha(",".join(str(7 * i) for i in range(20000))))]
