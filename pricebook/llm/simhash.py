"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits. The Manhattan distance of two
such vectors never exceeds the number of differing bits, so all links lie within Manhattan distance 3. The vectors
are joined on a grid: the segments form six bands, and a pair within distance 3 has at least three bands in which
it does not differ at all; a cell is the counts of three bands, and each vector lies in the 20 cells of the 20
triples. Inside a cell pairs are range-filtered by the full Manhattan distance and then verified on the bits.

Counts are kept in unary (0, 1, 2 as 00, 01, 11), so that a vector is one long, a cell is a mask of it, and a
Manhattan distance is one xor and bit count.

No pairs of a group of copies are made. Equal fingerprints are one node. Of each cell, members are first linked with
its least member; after those links are contracted, cells whose members already share a component are dropped, and
the rest only compare members of different components.

Shingle hashes are Spark's own (XXH64, seed 42); the majority of their bits is taken in Arrow batches, one document
at a time in memory.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other;
fewer than three words are one shingle; a null doc_id takes part but never names a component unless all its members
are null; repeated rows are one group; empty tables give empty results; other columns pass through ``keep_one``.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import ascii_lower, row_key, space_words, stored
from pricebook.llm.components import connected

BITS, BANDS = 3, 6
LOW = 0x5555555555555555
# bit k of a byte in byte k of a word: sums of up to 255 such words do not carry
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: a bit is 1 if it is set in over half of them; an empty run gives zero."""
    full = np.flatnonzero(sizes > 0)
    counts = np.zeros((len(sizes), 64), np.int64)
    if len(full):
        s, n = starts[full], sizes[full]
        pieces = (n + 254) // 255
        doc = np.repeat(np.arange(len(full)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = s[doc] + 255 * nth
        first = np.cumsum(pieces) - pieces
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums = np.add.reduceat(SPREAD[lanes[:, k]], cut)
            each = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts[full, 8 * k:8 * k + 8] = np.add.reduceat(each, first, axis=0)
    bits = 2 * counts > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(batches):
    for batch in batches:
        lists = batch.column("h")
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view(np.uint64)
        fp = majority(values, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, ident, kind: str) -> DataFrame:
    """(id, fp): ``ident`` is a column of ``docs`` and ``kind`` its type."""
    w = docs.select(ident.alias("id"), space_words(ascii_lower(F.col("text"))).alias("w"))
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3),
                        lambda i: F.xxhash64(F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2])))
    h = (F.when(F.size("w") >= 3, three).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " "))))
         .otherwise(F.array().cast("array<bigint>")))
    return w.select("id", h.alias("h")).mapInArrow(_fingerprints, f"id {kind}, fp long")


def embedding(fp):
    """Bit counts of the 32 two-bit segments, in unary."""
    half = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(half), fp.bitwiseOR(half)
    low = F.lit(LOW)
    return F.shiftleft(both.bitwiseAND(low), 1).bitwiseOR(any_.bitwiseAND(low))


def _cells(vectors: DataFrame, bits, bands) -> DataFrame:
    """A row for each fingerprint and grid cell: (g, cell, fp, v)."""
    edge = [32 * i // bands for i in range(bands + 1)]
    mask = [sum(3 << (2 * s) for s in range(edge[i], edge[i + 1])) for i in range(bands)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    triples = [signed(sum(mask[i] for i in c)) for c in combinations(range(bands), bands - bits)]
    at = F.array(*[F.struct(F.lit(i).alias("g"), F.col("v").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(triples)])
    return vectors.select("fp", "v", F.inline(at)).select("g", "cell", "fp", "v")


def _apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def link_roots(prints: DataFrame, bits=BITS, bands=BANDS) -> DataFrame:
    """(fp, root) of the fingerprints that have a link to another one, from distinct fingerprints."""
    points = _cells(prints.select("fp", embedding(F.col("fp")).alias("v")), bits, bands)
    shared = points.groupBy("g", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("head")).where("n > 1")
    near = stored(points.join(shared.select("g", "cell", "head"), ["g", "cell"]), "simhash-cells")
    star = (near.where(F.col("fp") != F.col("head"))
            .where((_apart(F.col("v"), embedding(F.col("head"))) <= bits) & (_apart(F.col("fp"), F.col("head")) <= bits))
            .select(F.col("fp").alias("a"), F.col("head").alias("b")))
    first = stored(connected(star), "simhash-first")
    named = near.join(first.select(F.col("id").alias("fp"), "root"), "fp", "left")
    named = stored(named.select("g", "cell", "fp", "v", F.coalesce("root", "fp").alias("root")), "simhash-named")
    mixed = named.groupBy("g", "cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    open_ = named.join(mixed.select("g", "cell"), ["g", "cell"])
    a, b = open_.alias("a"), open_.alias("b")
    pairs = stored(a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.cell") == F.col("b.cell"))
                          & (F.col("a.root") < F.col("b.root"))
                          & (_apart(F.col("a.v"), F.col("b.v")) <= bits) & (_apart(F.col("a.fp"), F.col("b.fp")) <= bits))
                   .select(F.col("a.root").alias("a"), F.col("b.root").alias("b")).distinct(), "simhash-pairs")
    second = connected(pairs)
    return (first.select(F.col("id").alias("fp"), "root")
            .union(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
                   .join(first.select(F.col("id").alias("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("root")))
            .join(second.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("fp", F.coalesce("top", "root").alias("root")))


def components(found: DataFrame, bits=BITS, bands=BANDS) -> DataFrame:
    """(fp, least): the least id of the component of every distinct fingerprint, from (id, fp)."""
    prints = stored(found.groupBy("fp").agg(F.min("id").alias("least")), "simhash-prints")
    roots = prints.join(link_roots(prints, bits, bands), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "simhash-roots")
    least = roots.groupBy("root").agg(F.min("least").alias("least"))
    return roots.select("fp", "root").join(least, "root").select("fp", "least")


def cluster(docs: DataFrame, bits=BITS, bands=BANDS) -> DataFrame:
    """Per document row: doc_id, fp (long), component_id (least doc_id reachable)."""
    found = stored(fingerprints(docs, F.col("doc_id"), "long"), "simhash-docs")
    groups = components(found, bits, bands)
    return found.join(groups, "fp").select(F.col("id").alias("doc_id"), "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, bits=BITS, bands=BANDS) -> DataFrame:
    """One document of each group: the one with the least (doc_id, content key); null doc_ids come last."""
    key = row_key("doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), key.alias("k"))
    kind = "struct<none:boolean,doc:long,k:struct<a:long,b:long>>"
    found = stored(fingerprints(docs, order, kind), "simhash-docs")
    keep = components(found, bits, bands).select(F.col("least.k").alias("_k")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), key.alias("_k"))
    return rows.join(keep, "_k", "left_semi").dropDuplicates(["_k"]).select("_doc.*")
