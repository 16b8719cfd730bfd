"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch of words with smallest period q, at least max(6, 4 q) words long, that no neighbouring word extends.
The words of many documents are numbered and laid end to end, with a separator of its own between them. For every
scale B = 1, 2, 4, ... the row is cut into blocks of B words. A run of a period d in [B, 2 B) repeats every block in its
first 3 d words at distance d, and at least ``(3 d - B + 1) // B`` such blocks follow each other. So the distances d at
which a block stands again in the 2 B - 1 words after it are all that is needed. They are the zeros of the sum of squared
differences of the word numbers, computed for all d at once by a convolution in exact integers (number theoretic
transforms modulo as many primes as the largest possible sum asks for). Blocks with a word that does not return within
2 B words cannot match and are left out before. Consecutive blocks with one distance are a seed; it is verified word by
word and extended by less than a block to either side. Seeds inside a run whose period divides the distance are skipped.

Cost: a scale touches each word a bounded number of times, seeds with three repetitions or more are O(n / B) of at most
O(n) words together, so a document of n words costs O(n log^2 n). Documents stay where they are: no shuffle. Arrow
batches are worked off in slices of ``STEP`` bytes; one longer text is a slice of its own and is kept whole.

Defined cases: a null or empty text has no words and no run; repeated rows are reported each; an empty table gives no
rows; other columns, whatever their names, are not read by ``runs`` and ``report`` and pass through ``collapse`` untouched.
"""

import hashlib
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PRIMES = (998244353, 469762049, 167772161)      # fixed values: primes k * 2^m + 1 with 3 as a primitive root
POINTS = 1 << 19            # transform points at once
STEP = 4 << 20              # bytes of text at once, if no single document is longer
LEAST, TIMES = 6, 4         # a run has at least LEAST words and TIMES periods
NEVER = np.iinfo(np.int64).max
RUNS = "doc_id long, start long, length long, period long"
REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


@lru_cache(maxsize=64)
def _roots(p, n, inverse):
    """Powers 0 .. n/2 - 1 of an n-th root of unity."""
    root = pow(3, (p - 1) // n, p)
    root = pow(root, p - 2, p) if inverse else root
    out = np.ones(1, np.uint64)
    while 2 * len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), p)) % np.uint64(p)])
    return out


def _transform(a, p):
    """Forward transform of each row in place; the result is in bit-reversed order."""
    n, p = a.shape[1], np.uint64(p)
    half, roots = n // 2, _roots(int(p), n, False)
    while half:
        v = a.reshape(-1, 2, half)
        low, high = v[:, 0], v[:, 1]
        turned = (low + (p - high)) * roots[::n // (2 * half)] % p
        v[:, 0] = (low + high) % p
        v[:, 1] = turned
        half //= 2


def _back(a, p):
    """Inverse transform of each row in place, from bit-reversed order."""
    n, q = a.shape[1], np.uint64(p)
    half, roots = 1, _roots(p, n, True)
    while half < n:
        v = a.reshape(-1, 2, half)
        turned = v[:, 1] * roots[::n // (2 * half)] % q
        v[:, 1] = (v[:, 0] + (q - turned)) % q
        v[:, 0] = (v[:, 0] + turned) % q
        half *= 2
    a *= np.uint64(pow(n, p - 2, p))
    a %= q


def occurrences(block, window):
    """For rows of B words and the 2 B - 1 words to look in: true where the block stands at that offset (B offsets)."""
    size = block.shape[1]
    top = int(max(block.max(), window.max()))
    if size * top * top >= PRIMES[0]:                           # number anew what stands here, for smaller sums
        names, flat = np.unique(np.concatenate([block.ravel(), window.ravel()]), return_inverse=True)
        block, window = flat[:block.size].reshape(block.shape), flat[block.size:].reshape(window.shape)
        top = len(names)
    zero, product = None, 1
    for p in PRIMES:
        if zero is not None and product > size * top * top:
            break
        if 2 * size > (p - 1) & -(p - 1):                       # no root of that order
            continue
        q = np.uint64(p)
        x, y = np.zeros((len(block), 2 * size), np.uint64), np.zeros((len(block), 2 * size), np.uint64)
        x[:, :size], y[:, :-1] = block[:, ::-1], window
        x %= q
        y %= q
        own = (x * x % q).sum(axis=1, keepdims=True)
        sums = np.cumsum(y * y % q, axis=1)
        there = sums[:, size - 1:2 * size - 1].copy()           # sums over B words from each offset
        there[:, 1:] -= sums[:, :size - 1]
        _transform(x, p)
        _transform(y, p)
        x *= y
        x %= q
        _back(x, p)
        both = x[:, size - 1:2 * size - 1]
        here = (own + there + 2 * (q - both)) % q == 0
        zero, product = here if zero is None else zero & here, product * p
    return zero


def _seeds(x, blocks, size):
    """(block, distance) of every occurrence of the given blocks at a distance in [size, 2 size)."""
    found_b, found_d = [], []
    step = max(1, POINTS // (2 * size))
    top = int(x.max(initial=0)) + 1
    padded = np.concatenate([np.where(x < 0, top, x), np.full(2 * size, top, x.dtype)])
    for i in range(0, len(blocks), step):
        some = blocks[i:i + step]
        at = some[:, None] * size
        b, d = np.nonzero(occurrences(padded[at + np.arange(size)], padded[at + size + np.arange(2 * size - 1)]))
        found_b.append(some[b])
        found_d.append(d + size)
    return np.concatenate(found_b), np.concatenate(found_d)


def _equal_from(x, i, d, step, way):
    """How many words from i on (way 1) or before i (way -1) equal those at distance d."""
    n = 0
    while True:
        a, b = (i + n, min(i + n + step, len(x) - d)) if way > 0 else (max(i - n - step, 0), i - n)
        if a >= b:
            return n
        same = x[a:b] == x[a + d:b + d]
        same = same if way > 0 else same[::-1]
        if not same.all():
            return n + int(same.argmin())
        n += b - a


def find_runs(x):
    """(start, length, period) of all runs of a row of word numbers, by start and period.

    Negative numbers stand once each and so end every run.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    far = np.full(n, NEVER)                                     # distance to the next place of the same word
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    far[order[same]] = order[same + 1] - order[same]
    ends = np.flatnonzero(np.concatenate([[True], x < 0, [True]]))
    longest = int(np.diff(ends).max())                          # words between two separators, and one
    known, size = {}, 1                                         # period -> (starts, ends), sorted
    while TIMES * size < longest:
        alive = far < 2 * size
        near = np.zeros(len(alive) + 2, bool)
        near[1:-1] = alive
        blocks = np.flatnonzero(alive & (near[:-2] | near[2:]))
        if len(blocks):
            _scale(x, blocks, size, known)
        size *= 2
        far = np.maximum(far[0:len(far) // 2 * 2:2], far[1::2])
    out = [(int(s), int(e - s), q) for q, (starts, stops) in known.items() for s, e in zip(starts, stops)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _scale(x, blocks, size, known):
    """Add the runs with a period in [size, 2 size) to the known ones."""
    b, d = _seeds(x, blocks, size)
    order = np.lexsort((b, d))
    b, d = b[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1] + 1)]) if len(b) else np.zeros(0, bool))
    count = np.diff(np.append(first, len(b)))
    d, left = d[first], b[first] * size
    right = left + count * size
    keep = count >= (3 * d - size + 1) // size
    d, left, right = d[keep], left[keep], right[keep]
    inside = np.zeros(len(d), bool)
    for q, (starts, stops) in known.items():
        i = np.searchsorted(starts, left, "right") - 1
        inside |= (d % q == 0) & (i >= 0) & (stops[i] >= right + d)
    new = {}
    for q, s, e in zip(d[~inside].tolist(), left[~inside].tolist(), right[~inside].tolist()):
        if not np.array_equal(x[s:e], x[s + q:e + q]):
            continue                                            # only where no product of primes was large enough
        s -= _equal_from(x, s, q, size, -1)
        e += _equal_from(x, e, q, size, 1) + q
        if e - s >= max(LEAST, TIMES * q):
            new.setdefault(q, set()).add((s, e))
    for q, runs in new.items():
        known[q] = tuple(np.array(sorted(runs)).T)


def _slices(batch, size):
    """Slices of a batch of about ``size`` bytes of text, of at least one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(lengths)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _analysed(piece):
    """Words of each text, the runs of each, and for texts with runs which words stay."""
    # bytes.split() without a separator cuts at exactly the ASCII white space
    words = [t.as_py().split() if t.is_valid else [] for t in piece.column("text").cast(pa.binary())]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.empty(int((sizes + 1).sum()), np.int64)
    ends = starts + sizes
    x[ends] = -1 - np.arange(len(ends))
    flat = np.ones(len(x), bool)
    flat[ends] = False
    coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    x[flat] = coded.indices.to_numpy()
    runs, stays = [[] for _ in words], [None] * len(words)
    for s, length, q in find_runs(x):
        i = int(np.searchsorted(starts, s, "right")) - 1
        runs[i].append((s - int(starts[i]), length, q))
    for i, own in enumerate(runs):
        if own:
            step = np.zeros(len(words[i]) + 1, np.int64)
            for s, length, q in own:
                step[s + q] += 1
                step[s + length] -= 1
            stays[i] = np.cumsum(step[:-1]) == 0
    return words, runs, stays


def _collapsed(words, stays):
    return b" ".join(words if stays is None else compress(words, stays.tolist()))


def _report(batches):
    for batch in batches:
        for piece in _slices(batch, STEP):
            out = []
            for name, ws, own, left in zip(piece.column("doc_id").to_pylist(), *_analysed(piece)):
                best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in own)
                out.append((name, len(own), *best, 1000 * best[1] // best[2] if own else None,
                            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_collapsed(ws, left)).hexdigest()))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             [c.split(" ")[0] for c in REPORT.split(", ")])


def _runs(batches):
    for batch in batches:
        for piece in _slices(batch, STEP):
            _, runs, _ = _analysed(piece)
            rows = [(d, *r) for d, own in zip(piece.column("doc_id").to_pylist(), runs) for r in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)],
                                             ["doc_id", "start", "length", "period"])


def _collapse(batches):
    for batch in batches:
        for piece in _slices(batch, STEP):
            words, _, stays = _analysed(piece)
            i = piece.schema.get_field_index("text")
            old = piece.column(i)
            new = pa.array([old[j].as_py() if left is None else _collapsed(ws, left).decode()
                            for j, (ws, left) in enumerate(zip(words, stays))], old.type)
            yield piece.set_column(i, piece.schema.field(i), new)


def report(docs: DataFrame) -> DataFrame:
    """Per document row: number of runs, the longest one (ties: least start, then period) and digests.

    ``runs_sha256`` is over the lines ``start,length,period`` of all runs, ``collapsed_sha256`` over the words that stay,
    joined by one space. A word goes if a run contains it after the run's first period.
    """
    return docs.select("doc_id", "text").mapInArrow(_report, REPORT)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): every run of every document row, in words from 0."""
    return docs.select("doc_id", "text").mapInArrow(_runs, RUNS)


def collapse(docs: DataFrame) -> DataFrame:
    """The documents with every run cut to its first period; texts without a run stay as they are."""
    return docs.mapInArrow(_collapse, docs.schema)
