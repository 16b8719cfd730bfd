"""Quality classifier by co-training on two views of a document.

The text view sees hashed words and character classes, the metadata view what is known about the page: source,
language, length and layout. Both start from the labelled documents. In each round both score every unlabelled
document; those beyond the ``CONFIDENT`` quantiles at either end are the giver's confident ones, and the other view is
fitted with their pseudo-labels too. Then each view is calibrated on labelled documents held out from the start, a
logistic combination of the calibrated views is fitted there too, and all documents are scored.

The words of all texts are split and hashed once, into a table in the shared folder that every round reads. Quantiles
are taken over distinct contents, so a group of copies has one vote.

Bounds of the fit (parameters): ``LABELLED`` labelled documents, the first by a hash of their id, and per round and
view ``HANDED`` pseudo-labelled ones, the first by their content key among all confident ones. Only their features
reach the driver: at most ``LABELLED + 2 * ROUNDS * HANDED`` rows of ``WORDS + 72`` floats. Rounds and scoring read
every whole text.

kept: the score is not below the one that ``LOSS`` of the held-out good documents stay under.

Defined cases: a null or empty text has zero word features; null metadata is a value of its own; labels with a null
quality are ignored, of several labels of a document the lowest counts; without both classes among the labels every
score is the share of good ones (0.5 without labels) and all are kept; of several rows with a labelled id the fit takes
the least content key; where a view scores all alike it hands nothing over; repeated rows are scored alike; rows without
an id are scored only; an empty table has no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import ascii_lower, row_key, space_words, stored

LABELLED, HANDED, ROUNDS, WORDS, META, LOSS = 8000, 500, 4, 512, 64, 0.01
CONFIDENT = 0.02            # share of the unlabelled contents that a view is confident of per round, by class share
INPUTS = ["h", "chars", "tags", "n_chars"]


def _inputs(docs: DataFrame, words=WORDS) -> DataFrame:
    """doc_id, content key (a, b), hashed words, and dense numbers of both views."""
    t = F.coalesce("text", F.lit(""))
    n = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
    w = space_words(ascii_lower(F.col("text")))
    d = docs.select("doc_id", w.alias("w"), F.array(
        F.length(t), n("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n("0123456789"), n("#*$%&|<>"), n("!?"), n(".,;:"), n("\n"), n(" ")).alias("chars"),
        F.array(F.pmod(F.xxhash64(F.coalesce("source", F.lit("?")), F.lit("s")), F.lit(32)),
                F.pmod(F.xxhash64(F.coalesce("lang", F.lit("?")), F.lit("l")), F.lit(16))).cast("array<int>").alias("tags"),
        F.coalesce("n_chars", F.length(t)).cast("long").alias("n_chars"))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("w", "chars", "tags", "n_chars").alias("k"),
                    F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(words)).cast("int")).alias("h"),
                    "chars", "tags", "n_chars").select("doc_id", "k.a", "k.b", *INPUTS)


def features(docs: DataFrame, words=WORDS) -> DataFrame:
    """The inputs of all documents, written once for all rounds."""
    return stored(_inputs(docs, words), "cotraining")


def _features(batch, words):
    """(text view, metadata view) as dense rows."""
    n = batch.num_rows
    h = batch.column("h")
    sizes = np.diff(h.offsets.to_numpy())
    flat = h.values.to_numpy(zero_copy_only=False)[h.offsets[0].as_py():h.offsets[-1].as_py()].astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), sizes) * words + flat, minlength=n * words).reshape(n, words)
    x = np.log1p(counts).astype(np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)
    chars = np.array(batch.column("chars").to_pylist(), np.float32).reshape(n, 8)
    share = chars[:, 1:] / np.maximum(chars[:, :1], 1)
    distinct = (counts > 0).sum(1) / np.maximum(np.minimum(sizes, words), 1)
    text = np.concatenate([x, np.sqrt(share), distinct[:, None].astype(np.float32)], 1)
    tags = np.array(batch.column("tags").to_pylist(), np.int64).reshape(n, 2)
    meta = np.zeros((n, META), np.float32)
    meta[np.arange(n), tags[:, 0]] = 1
    meta[np.arange(n), 32 + tags[:, 1]] = 1
    long = np.log1p(np.maximum(batch.column("n_chars").to_numpy(zero_copy_only=False), 0).astype(np.float32))
    meta[:, 48], meta[:, 49] = long / 10, (long / 10) ** 2
    meta[:, 50] = np.log1p(chars[:, 6])
    meta[:, 51] = np.log1p(chars[:, 0] / (chars[:, 6] + 1)) / 10
    return text, meta


def _pieces(batch, rows=1000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


class Logistic:
    """Regularised logistic regression on standardised columns, by accelerated gradient steps."""

    def __init__(self, x, y, l2=1e-3, steps=200):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1), x.dtype)], 1)
        z, y = z.astype(np.float32), y.astype(np.float32)
        q = np.float32(1 / len(y))
        step = np.float32(1 / (0.25 * float(np.linalg.eigvalsh((z.T @ z * q).astype(float))[-1]) + l2))
        w = v = np.zeros(z.shape[1], np.float32)
        for k in range(steps):
            g = z.T @ (q * (1 / (1 + np.exp(-(z @ v))) - y)) + np.float32(l2) * np.append(v[:-1], np.float32(0))
            new = v - step * g
            v, w = new + np.float32(k / (k + 3)) * (new - w), new
        self.w = w.astype(float)

    def logit(self, x):
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


class Model:
    """Two views with the rows each is fitted on; after calibration also their combination."""

    def __init__(self, views, y):
        self.rows = [(x, y) for x in views]
        self.fit()

    def fit(self):
        self.views = [Logistic(x, y) for x, y in self.rows]

    def take(self, view, x, y):
        old = self.rows[view]
        self.rows[view] = np.concatenate([old[0], x]), np.concatenate([old[1], y])

    def logits(self, views):
        return [m.logit(x) for m, x in zip(self.views, views)]

    def calibrate(self, views, y):
        """On labelled rows that no view was fitted on."""
        raw = [r[:, None] for r in self.logits(views)]
        self.scales = [Logistic(r, y) for r in raw]
        self.top = Logistic(np.concatenate([c.logit(r)[:, None] for c, r in zip(self.scales, raw)], 1), y)
        self.rows = None                                              # the model travels to the tasks
        self.cut = float(np.quantile(self.score(*views)[0][y == 1], LOSS, method="lower"))

    def score(self, text, meta):
        each = [c.logit(r[:, None]) for c, r in zip(self.scales, self.logits((text, meta)))]
        p = lambda z: np.round(1 / (1 + np.exp(-z)), 6)
        return p(self.top.logit(np.stack(each, 1))), p(each[0]), p(each[1])


class Constant:
    """Where the labels hold one class or none."""

    def __init__(self, share):
        self.share, self.cut = share, -1.0

    def score(self, text, meta):
        return (np.full(len(text), self.share),) * 3


def _fetch(rows: DataFrame, words):
    """Features of chosen rows (id, view, y, inputs), each (id, view) once: ids, views, labels and both feature tables."""
    def run(batches):
        seen = set()                                                  # of chosen rows: bounded as they are
        for batch in batches:
            for b in _pieces(batch):
                new = []
                for i, at in enumerate(zip(b.column("id").to_pylist(), b.column("view").to_pylist())):
                    if at not in seen:
                        seen.add(at)
                        new.append(i)
                if new:
                    b = b.take(pa.array(new))
                    text, meta = _features(b, words)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id"), b.column("view"), b.column("y"), pa.array([r.tobytes() for r in text], pa.binary()),
                         pa.array([r.tobytes() for r in meta], pa.binary())], ["id", "view", "y", "text", "meta"])

    got = (rows.select("id", "view", "y", *INPUTS).mapInArrow(run, "id long, view int, y double, text binary, meta binary")
           .dropDuplicates(["id", "view"]).toArrow().sort_by([("view", "ascending"), ("id", "ascending")]))
    dense = lambda c: np.array([np.frombuffer(x.as_buffer(), np.float32) for x in got.column(c)], np.float32)
    return (*(got.column(c).to_numpy() for c in ("id", "view", "y")), dense("text"), dense("meta"))


def _confident(table: DataFrame, known: DataFrame, model, share, done, handed, confident, words):
    """Contents that each view hands to the other: (a, b, view, y), at most ``handed`` for a view; None without any."""
    def run(batches):
        for batch in batches:
            for b in _pieces(batch):
                each = model.logits(_features(b, words))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "a", "b")] + [pa.array(np.round(x.astype(float), 4)) for x in each],
                                                 ["doc_id", "a", "b", "l0", "l1"])

    scored = table.where("doc_id is not null").mapInArrow(run, "doc_id long, a long, b long, l0 double, l1 double")
    free = stored(scored.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("a", "b").agg(F.max("l0").alias("l0"), F.max("l1").alias("l1")),
                  "cotraining-scores")
    ends = [confident * (1 - share), 1 - confident * share]
    cuts = free.agg(*[F.percentile_approx(c, ends, 10000).alias(c) for c in ("l0", "l1")]).first()
    good, picks = int(np.ceil(handed * share)), None
    for giver, taker in ((0, 1), (1, 0)):
        low, high = cuts[f"l{giver}"] or (0, 0)
        if low < high:
            logit, left = F.col(f"l{giver}"), free
            if done[taker]:
                left = free.join(F.broadcast(table.sparkSession.createDataFrame(done[taker], "a long")), "a", "left_anti")
            for y, side, most in ((0.0, logit <= low, handed - good), (1.0, logit >= high, good)):
                some = left.where(side).orderBy("a", "b").limit(most).select("a", "b", F.lit(taker).alias("view"), F.lit(y).alias("y"))
                picks = some if picks is None else picks.union(some)
    return picks


def train(table: DataFrame, labels: DataFrame, labelled=LABELLED, handed=HANDED, rounds=ROUNDS, confident=CONFIDENT, words=WORDS):
    """Fit both views over the feature table; the driver receives the rows of the fits."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = table.select("doc_id", "a", "b").join(some, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("a", "b")).alias("k"))
    rows = F.broadcast(rows.select("doc_id", "y", "k.a", "k.b"))      # at most `labelled` rows
    chosen = table.join(rows, ["doc_id", "a", "b"]).withColumnRenamed("doc_id", "id").withColumn("view", F.lit(0))
    ids, _, y, text, meta = _fetch(chosen, words)
    held = (ids * 2654435761 % 1000) < 300
    for part in (held | ~held, held, ~held):                          # both parts need both classes
        if len(set(y[part])) < 2:
            return Constant(float(y.mean()) if len(y) else 0.5)
    model, share, done = Model((text[~held], meta[~held]), y[~held]), y[~held].mean(), ([], [])
    for _ in range(rounds):
        picks = _confident(table, known, model, float(share), done, handed, confident, words)
        if picks is None:
            break
        got, view, label, *views = _fetch(table.join(F.broadcast(picks), ["a", "b"]).withColumnRenamed("a", "id"), words)
        for v in (0, 1):
            if (view == v).any():
                model.take(v, views[v][view == v], label[view == v])
                done[v].extend((int(i),) for i in got[view == v])
        model.fit()
    model.calibrate((text[held], meta[held]), y[held])
    return model


def score(table: DataFrame, model, words=WORDS) -> DataFrame:
    """Per document row: doc_id, score, text_score, meta_score, kept."""
    def run(batches):
        for batch in batches:
            for b in _pieces(batch):
                both, text, meta = model.score(*_features(b, words))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(both), pa.array(text), pa.array(meta), pa.array(both >= model.cut)],
                    ["doc_id", "score", "text_score", "meta_score", "kept"])

    return table.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    table = features(docs)
    return score(table, train(table, labels, **how))
