"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing: every word bucket owns a sparse ternary index vector; a word's vector is the sum of the
index vectors around it (``REACH`` words each side, itself included) over all documents. Words are
hashed to ``BUCKETS`` buckets, so the table has a fixed size; tasks of about ``TASK_BYTES`` of words add up integer sums and
Spark adds those, so the table does not depend on partitions or order. A document's features are the mean and the
standard deviation of its words' vectors. A two-layer numpy network is fitted on at most ``TRAIN_ROWS``
labelled documents outside the held-out fold (lowest seeded hashes), and a temperature, fitted on a
fifth of them that the network does not see, calibrates its probabilities. A text is split into words once; what is stored of it
are 16 bits a word, from which the table, the sample's features and the scores are computed.

Only texts enter a score. Words, and every other visible character as a word of its own, are
lower-cased; an all-capitals word counts as another word than its lower-case form. A null text counts
as empty, whose features are zeros: it gets the network's score for those. A null doc_id is held out. Labels that
are null or not 0 or 1 are ignored; of contradictory labels the smaller holds; with labels of one class or
none the score is the smoothed rate of label 1. Repeated rows give a row each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from transitlake.llm.common import materialize
from transitlake.operators.positional import input_bytes

BUCKETS = 1 << 14
DIMS = 64
NONZERO = 2
REACH = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
ACCEPT = 0.3
SEED = 8
CACHE = 1 << 19
FLUSH_WORDS = 1 << 20
TASK_BYTES = 256 << 20

_TOKENS = re.compile(r"\w+|[^\w\s]").findall


class _Buckets(dict):
    """Word to bucket, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        key = "\x00" + word.lower() if len(word) > 1 and word.isupper() else word.lower()
        b = self[word] = zlib.crc32(key.encode()) % BUCKETS
        return b


_BUCKET = _Buckets()


def word_ids(text: str) -> np.ndarray:
    return np.fromiter(map(_BUCKET.__getitem__, _TOKENS(text)), dtype=np.uint16)


def encoded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, doc_id, ids): the columns ``keep`` of each row of ``docs`` (doc_id, text, ...), and its text's word buckets as
    16-bit numbers."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def split(batches):
        for b in batches:
            ids = pa.array([word_ids(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), ids], ["row", "doc_id", "ids"])

    schema = StructType([rows.schema["row"], rows.schema["doc_id"], StructField("ids", BinaryType())])
    return materialize(rows.mapInArrow(split, schema), "words")


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = rng.random((BUCKETS, DIMS)).argsort(axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], size=(BUCKETS, NONZERO))


def context_sums(ids: np.ndarray, places: np.ndarray, signs: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Sums of index vectors around each word from place ``low`` to ``high``. ``ids`` holds documents apart by REACH times -1."""
    total, high = np.zeros(BUCKETS * DIMS), len(ids) if high is None else high
    for d in range(-REACH, REACH + 1):
        at = np.arange(max(low, -d), min(high, len(ids) - d))
        a, b = ids[at], ids[at + d]
        both = (a >= 0) & (b >= 0)
        a, b = a[both] * DIMS, b[both]
        for k in range(NONZERO):
            total += np.bincount(a + places[b, k], weights=signs[b, k], minlength=BUCKETS * DIMS)
    return total.reshape(BUCKETS, DIMS)


def word_vectors(docs: DataFrame, seed: int = SEED) -> np.ndarray:
    """The word table: unit vectors, from all ``encoded`` documents, centred on the corpus mean."""
    def sums(batches):
        places, signs = index_vectors(seed)
        total, seen = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS, dtype=np.int64)
        gap, held, size = np.full(REACH, -1), [], 0

        def add(ids, low=0, high=None):
            np.add(total, context_sums(ids, places, signs, low, high), out=total)
            own = ids[low:high]
            np.add(seen, np.bincount(own[own >= 0], minlength=BUCKETS), out=seen)

        for b in batches:
            for raw in b["ids"]:
                ids = np.frombuffer(raw, np.uint16).astype(np.int64)
                if len(ids) > FLUSH_WORDS:  # a very long text comes in pieces, each with the words around it
                    for at in range(0, len(ids), FLUSH_WORDS):
                        first = max(0, at - REACH)
                        piece = ids[first:at + FLUSH_WORDS + REACH]
                        add(piece, at - first, min(at - first + FLUSH_WORDS, len(piece)))
                    continue
                held += [ids, gap]
                size += len(ids)
                if size >= FLUSH_WORDS:
                    add(np.concatenate(held))
                    held, size = [], 0
        if held:
            add(np.concatenate(held))
        used = np.nonzero(seen)[0]
        yield pd.DataFrame({"b": used, "n": seen[used], "v": pd.Series(list(np.rint(total[used]).astype(np.int64)), dtype=object)})

    spark, words = docs.sparkSession, docs.select("ids")
    # a task hands on up to 8 MB of sums, so tasks are as large as their words allow: the sums grow with the words
    tasks = max(spark.sparkContext.defaultParallelism, -(-input_bytes(words) // TASK_BYTES))
    docs = words.coalesce(tasks)
    parts = docs.select("ids").mapInPandas(sums, "b long, n long, v array<long>")
    rows = parts.groupBy("b").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)])
    got = rows.toArrow()
    m, n = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    at = got["b"].to_numpy()
    n[at] = got["n"].to_numpy()
    for i in range(DIMS):
        m[at, i] = got[f"v{i}"].to_numpy()
    m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)
    m[at] -= (m * n[:, None]).sum(axis=0) / max(n.sum(), 1)
    return m.astype(np.float32)


class Pool:
    """Features of a document's words: mean and standard deviation of their vectors."""

    def __init__(self, table: np.ndarray):
        self.table, self.squares = table, table * table

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(2 * DIMS, dtype=np.float32)
        used, n = np.unique(ids, return_counts=True)
        share = (n / len(ids)).astype(np.float32)
        mean = share @ self.table[used]
        return np.concatenate([mean, np.sqrt(np.maximum(share @ self.squares[used] - mean * mean, 0))])


class Network:
    """Standardised inputs, a tanh layer, a logistic output and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, fit = order[::5], np.setdiff1d(order, order[::5])
        if len(set(y[held].tolist())) < 2 or len(set(y[fit].tolist())) < 2:
            held = fit = order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        self.w = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
                  rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            mixed = rng.permutation(fit)
            for at in range(0, len(mixed), 256):
                rows, step = mixed[at:at + 256], step + 1
                h = np.tanh(z[rows] @ self.w[0] + self.w[1])
                err = (_logistic(h @ self.w[2] + self.w[3]) - y[rows]) / len(rows)
                back = np.outer(err, self.w[2]) * (1 - h * h)
                grads = [z[rows].T @ back + 1e-3 * self.w[0], back.sum(axis=0), h.T @ err + 1e-3 * self.w[2], err.sum(keepdims=True)]
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    self.w[i] -= 3e-3 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        logits = self.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(min(grid, key=lambda t: _loss(logits / t, y[held])))

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1])
        return (h @ self.w[2] + self.w[3]) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _logistic(self.logits(x.astype(np.float64)))


def _logistic(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -60, 60)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -logits, logits)).mean())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) == 0


def _pooled(rows: list[bytes], table) -> np.ndarray:
    """Features of documents, given as ``ids``, with ``table`` the broadcast word vectors."""
    pool = Pool(table.value)
    return np.array([pool(np.frombuffer(raw, np.uint16)) for raw in rows], dtype=np.float32).reshape(len(rows), 2 * DIMS)


def train(words: DataFrame, labels: DataFrame, table, rows: int = TRAIN_ROWS, seed: int = SEED) -> Network:
    """The network, from the labelled documents of ``encoded`` words. Features are computed of its sample only: a count sets the
    hash below which slightly more than ``rows`` documents lie, of which the lowest ``rows`` serve."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")))
    h = F.xxhash64(F.lit(seed), "doc_id")
    labelled = words.select("doc_id", "ids").where(~held_out()).join(known, "doc_id")
    n = labelled.count()
    share = min(1.0, (1.05 * rows + 6 * rows ** 0.5) / max(n, 1))
    below = F.lit(int((1 << 63) * (2 * share - 1)) if share < 1 else (1 << 63) - 1).cast("long")

    def pool(batches):
        for b in batches:
            x = _pooled(b.column("ids").to_pylist(), table)
            yield pa.RecordBatch.from_pydict({"h": b.column("h"), "x": pa.array([v.tobytes() for v in x], pa.binary()), "y": b.column("y")})

    drawn = labelled.select("ids", "y", h.alias("h")).where(F.col("h") <= below).mapInArrow(pool, "h long, x binary, y int")
    sample = sorted(drawn.collect(), key=lambda r: (r["h"], r["x"]))[:rows]
    x = np.array([np.frombuffer(r["x"], np.float32) for r in sample], dtype=np.float64).reshape(len(sample), 2 * DIMS)
    return Network(x, np.array([r["y"] for r in sample], dtype=np.float64), seed)


def fitted(docs: DataFrame, labels: DataFrame, keep: list[str]):
    """(words, table, network): the ``encoded`` documents and what was learnt from them."""
    words = encoded(docs, keep)
    table = docs.sparkSession.sparkContext.broadcast(word_vectors(words))
    return words, table, train(words, labels, table)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    words, table, net = fitted(docs, labels, ["doc_id"])

    def judge(batches):
        for b in batches:
            x = _pooled(b.column("ids").to_pylist(), table)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": net.scores(x)})

    kind = words.schema["doc_id"].dataType.simpleString()
    scored = words.select("doc_id", "ids").mapInArrow(judge, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be of quality, unchanged."""
    words, table, net = fitted(docs, labels, docs.columns)

    def keep(batches):
        for b in batches:
            fine = net.scores(_pooled(b.column("ids").to_pylist(), table)) >= ACCEPT
            yield pa.RecordBatch.from_arrays([b.column("row")], ["row"]).filter(pa.array(fine, pa.bool_()))

    return words.select("row", "ids").mapInArrow(keep, StructType([words.schema["row"]])).select("row.*")
