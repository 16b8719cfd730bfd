"""Token ids in wavelet-matrix shards.

Documents are sorted by (doc_id, content hash) over range partitions and encoded in Arrow batches; a task cuts its
stream into shards at the first document end after ``SHARD`` tokens and emits one row per shard: its place, the
documents in it, and the wavelet matrix as one compressed byte string. Spark writes the rows as Parquet in the shared
folder, so a repeated task replaces its own files. Reading decodes one shard at a time.

Encoding: the tokenizer drops white space and never joins what it separates, so ids are made once per distinct
stretch between white space and kept in the worker (``CACHE`` stretches; beyond that the store starts anew). The
distinct ones are encoded by the library ``AT_ONCE`` at a time, with a control character between them whose own id marks
the cuts; stretches that hold it, or a count of marks that is not as it must be, are encoded one by one.

Defined cases: a null or empty text has no ids but the end id; null doc_ids come first; repeated rows follow each
other and count each; an empty table gives no shard and no row; other columns are not read.
"""

import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.llm.common import scratch
from pricebook.llm.wavelet import WaveletMatrix

VOCABULARY, MARK, END = "word_bpe_49k.json", "\x01", 1
SHARD = 1 << 20
CACHE = 1_500_000
AT_ONCE = 128                # the library takes longer a stretch on long joins
STEP = 4 << 20              # bytes of text handled at once, if no single document is longer
SHARDS = "part int, shard int, n long, doc_ids array<long>, sizes array<int>, matrix binary"
DOCS = "part int, shard int, nth int, doc_id long, at long, n_tokens long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts, by distinct stretches between white space."""

    def __init__(self, path):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._one(MARK)
        self._clear()

    def _clear(self):
        self.place = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 1
        self.ids[0] = END                               # stretch 0 is the end of a document
        self.starts, self.sizes, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 1
        self.sizes[0] = 1

    def _add(self, words, ids, sizes):
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if self.n + len(words) > len(self.starts):
            more = max(len(self.starts), len(words))
            self.starts = np.concatenate([self.starts, np.zeros(more, np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.sizes[self.n:self.n + len(words)] = sizes
        self.starts[self.n:self.n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.place.update(zip(words, range(self.n, self.n + len(words))))
        self.n, self.used = self.n + len(words), self.used + len(ids)

    def _one(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _some(self, words):
        """(ids, sizes) of a few stretches, by one call between marks where the marks can be told apart."""
        text = f" {MARK} ".join(words)
        if len(self.mark) == 1 and text.count(MARK) == len(words) - 1:
            ids = self._one(text)
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1
        lists = [self._one(w) for w in words]
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))

    def _learn(self, words):
        """Store new stretches; they are numbered in their order."""
        for i in range(0, len(words), 32 * AT_ONCE):
            some = words[i:i + 32 * AT_ONCE]
            ids, sizes = zip(*(self._some(some[j:j + AT_ONCE]) for j in range(0, len(some), AT_ONCE)))
            self._add(some, np.concatenate(ids), np.concatenate(sizes))

    def encode(self, texts: pa.Array):
        """(ids, sizes): all ids with the end id after each text, and how many each text has."""
        if len(self.place) > CACHE:
            self._clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        here = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(here < 0)
        here[new] = np.arange(self.n, self.n + len(new))
        self._learn([words[i] for i in new.tolist()])
        stretch = here[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        counts = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(counts)
        stretch = np.insert(stretch, ends, 0)
        n = self.sizes[stretch]
        total = np.cumsum(n, dtype=np.int64)
        ids = self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(self.starts[stretch] - (total - n), n)]
        last = total[ends + np.arange(len(ends))]
        return ids, np.diff(last, prepend=0)


@lru_cache(maxsize=2)
def encoder(path=None) -> Encoder:
    """One encoder per worker; without a path the installed vocabulary file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return Encoder(path)


def _steps(batch, size):
    """Slices of a batch of about ``size`` bytes of text, of at least one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(lengths)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _to_shards(path, shard_tokens):
    def run(batches):
        part, shard, held, docs, sizes, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def emit():
            matrix = WaveletMatrix.build(np.concatenate(held)).to_bytes()
            cells = [[part], [shard], [n], [[x for d in docs for x in d]], [np.concatenate(sizes)], [matrix]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                                                        pa.list_(pa.int32()), pa.binary()))],
                ["part", "shard", "n", "doc_ids", "sizes", "matrix"])

        for batch in batches:
            for piece in _steps(batch, STEP):
                ids, count = encoder(path).encode(piece.column("text"))
                names, ends, at, doc = piece.column("doc_id").to_pylist(), np.cumsum(count), 0, 0
                while doc < len(count):
                    full = int(np.searchsorted(ends, at + shard_tokens - n))     # document that fills the shard
                    to = min(full + 1, len(count))
                    held.append(ids[at:ends[to - 1]])
                    docs.append(names[doc:to])
                    sizes.append(count[doc:to])
                    n += int(ends[to - 1]) - at
                    at, doc = int(ends[to - 1]), to
                    if n >= shard_tokens:
                        yield emit()
                        shard, held, docs, sizes, n = shard + 1, [], [], [], 0
        if docs:
            yield emit()
    return run


def _read(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            part, shard, docs, sizes, matrix = (batch.column(c)[row] for c in ("part", "shard", "doc_ids", "sizes", "matrix"))
            ids = WaveletMatrix.from_bytes(memoryview(matrix.as_buffer())).tokens().astype("<u4")
            size = sizes.values.to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), size.tolist())]
            k = len(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part.as_py(), np.int32)), pa.array(np.full(k, shard.as_py(), np.int32)),
                 pa.array(np.arange(k, dtype=np.int32)), docs.values, pa.array(ends - size), pa.array(size),
                 pa.array(crc, pa.int64())], ["part", "shard", "nth", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, path: str, tokenizer=None, shard_tokens=SHARD) -> None:
    """Encode every document and write the shards in ascending order of doc_id."""
    order = (docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
             .repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    order.mapInArrow(_to_shards(tokenizer, shard_tokens), SHARDS).write.parquet(path)


def shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start (ids before it), n_tokens and the checksum of its ids."""
    place = shards(spark, path).select("part", "shard", "n")
    parts = place.groupBy("part").agg(F.sum("n").alias("m"))              # one row per writing task
    before = parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("parts_before"))
    own = Window.partitionBy("part").orderBy("shard")
    place = (place.select("part", "shard", (F.sum("n").over(own) - F.col("n")).alias("before"))
             .join(before, "part").select("part", "shard", (F.col("before") + F.col("parts_before")).alias("shard_start")))
    found = shards(spark, path).mapInArrow(_read, DOCS)
    return (found.join(place, ["part", "shard"])
            .select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "nth"))


def encode_documents(docs: DataFrame, tokenizer=None, shard_tokens=SHARD) -> DataFrame:
    """Write the shards to a new path in the shared folder and report on the documents as read back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-shards")
    write_shards(docs, path, tokenizer, shard_tokens)
    return read_documents(spark, path)


def _look(kind, value):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                m = WaveletMatrix.from_bytes(memoryview(batch.column("matrix")[row].as_buffer()))
                if kind == "count":
                    found = [m.count(value)]
                elif kind == "locate":
                    found = [m.select(value, k) for k in range(m.count(value))]
                else:
                    found = [m.access(value)] if 0 <= value < m.n else []
                k = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[row].as_py()] * k, pa.int32()) for c in ("part", "shard")] + [pa.array(found, pa.int64())],
                    ["part", "shard", "value"])
    return run


def count_token(spark, path: str, token: int) -> DataFrame:
    """(part, shard, value): occurrences of a token in each shard."""
    return shards(spark, path).mapInArrow(_look("count", token), "part int, shard int, value long")


def locate_token(spark, path: str, token: int) -> DataFrame:
    """(part, shard, value): each position of a token inside its shard."""
    return shards(spark, path).mapInArrow(_look("locate", token), "part int, shard int, value long")


def token_at(spark, path: str, part: int, shard: int, position: int) -> DataFrame:
    """(part, shard, value): the token at a position; no row beyond the end."""
    one = shards(spark, path).where((F.col("part") == part) & (F.col("shard") == shard))
    return one.mapInArrow(_look("access", position), "part int, shard int, value long")
