"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's features are its shingles of ``SHINGLE`` lower-cased words (a shorter text is one shingle). A shingle weighs
its count in the text times the mean IDF of its words, 1 + ln(N / df) / ln(N) with document frequencies over all
documents, held in a hashed table of ``DF_BUCKETS`` buckets whose size does not depend on the corpus. (A
shingle's own document frequency would let a large group of near copies lower the weight of just
what its members share.) ``BANDS * ROWS`` weighted samples are drawn from each text, such that two texts
agree on a sample with probability equal to their weighted Jaccard similarity; texts that agree on all samples
of a band are candidates, and a candidate pair is a link when its weighted Jaccard similarity, computed
from the whole texts, is ``THRESHOLD`` or more. A class is a connected component of links.

Texts of equal words are one representative, found by a 128-bit digest. A band's bucket is never
expanded into pairs. Its members are compared with a leader drawn from them, another one in each of ``ROUNDS`` rounds
and in each bucket, which unites what belongs together at a few comparisons a member. In buckets where members still lie
in several components, every pair of members of different components is then compared, once however many buckets the
two share: first by their samples, in pairs of salted blocks of about ``BLOCK`` members or ``BLOCK_BYTES`` of text, then, those that
agree on ``AGREE`` of the 48 samples, by their whole texts (two texts at the threshold agree on 38 of them on
average, on fewer than 24 in one case in a million). So a bucket whose m members belong together costs m comparisons; one that
stays in several classes costs as many as it has pairs between them, since no other comparison can rule out a link.

A text without words (null, empty, blank) links with nothing. Repeated rows are copies. Rows keep null
ids: such a row has the class of its text, or a null class when it is alone. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from transitlake.llm.common import components, map_texts, materialize, texts

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
DF_BUCKETS = 1 << 18
TABLE = 1 << 14
ROUNDS = 3
AGREE = 24
BLOCK, BLOCK_BYTES = 256, 8 << 20
SEED = 1
PIECE, PIECE_BYTES = 2048, 1 << 20

BASE = 0x9E3779B97F4A7C55
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))

_PLACE = np.random.default_rng(SEED).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up, down = np.full(PIECE_BYTES + 1, BASE, np.uint64), np.full(PIECE_BYTES + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers()
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


def hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's lower-cased words, which blanks part: differences of one running
    polynomial over its bytes, piece by piece. What a piece holds of a word that goes on is carried to the next."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out, at, begun, size = [], 0, 0, 0
    while at < len(data):
        piece = data[at:at + PIECE_BYTES]
        blank = _BLANK[piece]
        more = at + len(piece) < len(data)
        if more and blank.any():
            n = len(blank) - int(blank[::-1].argmax())
            piece, blank = piece[:n], blank[:n]
        at += len(piece)
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * _UP[:len(piece)], out=total[1:])
        start, end = edge[::2], edge[1::2]
        words = (total[end] - total[start]) * _DOWN[start]
        if size and len(words) and not start[0]:  # the rest of a word of which earlier pieces held ``size`` bytes
            words[:1] = words[:1] * np.uint64(pow(BASE, size, 1 << 64)) + np.uint64(begun)
        elif size:
            out.append(mixed(np.array([begun], np.uint64)))
        if more and not blank.any():
            begun, size = int(words[0]), size + len(piece)
            continue
        begun, size = 0, 0
        out.append(mixed(words))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def digest(h: np.ndarray) -> bytes | None:
    """The address of a text's words; None without words."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def shingle_weights(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text's word hashes, and their TF-IDF weights."""
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    word = idf[(h & np.uint64(DF_BUCKETS - 1)).view(np.int64)]
    s, weight = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    for i in range(k):
        s += h[i:i + n] * _PLACE[i]
        weight += word[i:i + n]
    s, weight = mixed(s), weight / np.float32(k)
    order = s.argsort(kind="stable")
    s, weight = s[order], weight[order]
    new = np.flatnonzero(np.diff(s, prepend=~s[:1]))
    if len(new) < n:
        s, weight = s[new], weight[new] * np.diff(new, append=n).astype(np.float32)
    return s, weight


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return low / max(float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low, 1e-12)


class Sampler:
    """Consistent weighted samples. The random draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of (shingle, sample) come
    from tables of ``TABLE`` draws, at a place that hashes the shingle anew for each sample."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.samples = BANDS * ROWS
        self.r = rng.gamma(2, 1, TABLE).astype(np.float32).clip(1e-3)
        self.ln_c = np.log(rng.gamma(2, 1, TABLE)).astype(np.float32)
        self.beta = rng.random(TABLE).astype(np.float32)
        self.times = rng.integers(0, 1 << 63, self.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = (1 / self.r).astype(np.float32)

    def bands(self, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One 64-bit key a band, and 32 bits of each sample."""
        best = np.full(self.samples, np.inf, np.float32)
        who, level = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.float32)
        every = np.arange(self.samples)
        for at in range(0, len(s), PIECE):
            part, ln_w = s[at:at + PIECE], np.log(w[at:at + PIECE])
            place = ((self.times[:, None] * part) >> np.uint64(64 - TABLE.bit_length() + 1)).view(np.int64)
            beta = self.beta.take(place, mode="clip")
            t = self.inverse.take(place, mode="clip")
            t *= ln_w
            t += beta
            np.floor(t, out=t)  # the weight's level, t = floor(ln w / r + beta)
            y = t - beta
            y += 1
            y *= self.r.take(place, mode="clip")
            a = self.ln_c.take(place, mode="clip")
            a -= y  # ln a = ln c - r (t - beta + 1); equal values go to the smaller shingle hash
            low = a.argmin(axis=1)
            value = a[every, low]
            better = value < best
            best[better] = value[better]
            who[better] = part[low[better]]
            level[better] = t[every[better], low[better]]
        one = mixed(who ^ mixed(level.astype(np.int64).view(np.uint64) + _MIX[2])).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            key = mixed(key + one[:, i] * _MIX[2])
        return key.view(np.int64), one.astype(np.uint32).view(np.int32).ravel()


def idf_table(docs: DataFrame) -> np.ndarray:
    """IDF by word bucket, over all documents."""
    def tally(batches):
        df, n = np.zeros(DF_BUCKETS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                used = np.unique(hashes(t) & np.uint64(DF_BUCKETS - 1)).view(np.int64)
                df[used] += 1
                n += len(used) > 0
        used = np.nonzero(df)[0]
        yield pd.DataFrame({"b": np.append(used, -1), "n": np.append(df[used], n)})

    got = docs.select("text").mapInPandas(tally, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = got["b"].to_numpy(), got["n"].to_numpy()
    total = max(2, int(n[b < 0].sum()))
    df = np.ones(DF_BUCKETS)
    df[b[b >= 0]] = np.maximum(n[b >= 0], 1)
    return (1 + np.log(total / np.minimum(df, total)) / np.log(total)).astype(np.float32)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, rid, keys, samples): the digest of the text's words, its band keys and its samples."""
    def start():
        sampler = Sampler()

        def sign(batch):
            rids, keys, samples, done = [], [], [], {}
            for t in batch:
                h = hashes(t)
                rid = digest(h)
                if rid is not None and rid not in done:
                    done[rid] = [x.tolist() for x in sampler.bands(*shingle_weights(h, idf.value))]
                own = done.get(rid, (None, None))
                rids.append(rid)
                keys.append(own[0])
                samples.append(own[1])
            return {"rid": pa.array(rids, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
                    "samples": pa.array(samples, pa.list_(pa.int32()))}

        return sign

    return map_texts(docs, "rid binary, keys array<long>, samples array<int>", start)


def verified(pairs: DataFrame, held: DataFrame, idf) -> DataFrame:
    """The ``pairs`` (a, b) that are links; ``held`` has (rid, text). The texts of b's are read once
    for each run of its pairs."""
    both = (pairs.join(held.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
            .join(held.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b"))

    def check(batches):
        last, of_last = None, None
        for x in batches:
            keep = []
            for b, tb, ta in zip(x.column("b").to_pylist(), x.column("tb").to_pylist(), x.column("ta").to_pylist()):
                if b != last:
                    last, of_last = b, shingle_weights(hashes(tb), idf.value)
                keep.append(similarity(shingle_weights(hashes(ta), idf.value), of_last) >= THRESHOLD)
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def _identity() -> Column:
    """Orders ids, null last, and compares as equal where both are null."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")


def candidate_texts(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(rid, text, size) of the representatives in some bucket, one text each and its bytes."""
    wanted = buckets.select("rid", "low").distinct()
    addressed = map_texts(docs, "rid binary, text string", lambda: lambda batch: {
        "rid": pa.array([digest(hashes(t)) for t in batch], pa.binary()), "text": batch})
    one = addressed.withColumn("low", _identity())
    return one.join(wanted, ["rid", "low"]).groupBy("rid").agg(F.first("text").alias("text")) \
        .withColumn("size", F.octet_length("text"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for each row of ``docs``: the class's smallest doc_id and whether the row has it."""
    signed, of = _classified(texts(docs))
    return (signed.select("doc_id", "rid").join(of.select("rid", F.col("least.doc_id").alias("class_id")), "rid", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each class; texts without words all stay. Of exactly repeated rows one stays."""
    _, of = _classified(texts(docs))
    first = of.where(F.col("low") == F.col("least")).groupBy("least").agg(F.min("rid").alias("_rid")) \
        .select("_rid", F.col("least").alias("_low"), F.lit(True).alias("_first"))

    def address(batches):
        for b in batches:
            rids = [digest(hashes(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rids, pa.binary())], [*b.schema.names, "_rid"])

    rows = docs.mapInArrow(address, StructType([*docs.schema.fields, StructField("_rid", BinaryType())]))
    n = F.row_number().over(Window.partitionBy("_rid", "_low").orderBy(F.lit(0)))
    return (rows.withColumn("_low", _identity()).join(first, ["_rid", "_low"], "left")
            .withColumn("_n", n).where(F.col("_rid").isNull() | F.col("_first") & (F.col("_n") == 1))
            .select(*docs.columns))


def _in_several_components(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, rid, part) of the members of buckets that hold several components so far."""
    member = (buckets.select("key", "rid").join(parts.withColumnRenamed("node", "rid"), "rid", "left")
              .select("key", "rid", F.coalesce("component", "rid").alias("part")))
    several = member.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    return materialize(member.join(several, "key"), "members")


def near_rows(member: DataFrame, reps: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs of members of a bucket that lie in different components and agree on ``AGREE`` samples, each in the
    first bucket the two share. ``member`` has (key, rid, part). A row (key, i, j, rid, place, others) is a text with a place in
    a pair of blocks, and the places of the texts there that it is to be compared with. Buckets of two are left out:
    their leader has met the other one."""
    sized = member.select("key", "rid", "part").join(held.select("rid", "size"), "rid")
    n = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES))
    blocks = sized.groupBy("key").agg(n.alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 2").select("key", "blocks")
    own = F.pmod(F.xxhash64(F.lit(ROUNDS), "key", "rid"), F.col("blocks"))
    # block pairs (i, j), i <= j: a member is sent to the pairs its block is part of
    tiles = (sized.join(blocks, "key").withColumn("block", own)
             .join(reps.select("rid", "keys", "samples"), "rid")
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rid", "part", "keys", "samples"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        key, i, j = rows["key"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
        rows = rows.sort_values(["block", "rid"])
        keys, samples, part = np.stack(rows["keys"]), np.stack(rows["samples"]), pd.factorize(rows["part"])[0]
        k = len(rows) if i == j else int((rows["block"] == i).sum())
        x, y = slice(0, k), slice(0 if i == j else k, len(rows))
        want = part[x, None] != part[None, y]
        if i == j:
            want &= np.tri(k, k, -1, dtype=bool)
        for band in range(BANDS):
            if want.any() and keys[0, band] == key:
                break
            want &= keys[x, band, None] != keys[None, y, band]
        same = np.zeros(want.shape, np.uint8)
        for sample in samples.T if want.any() else ():
            same += sample[x, None] == sample[None, y]
        want &= same >= AGREE
        others = [np.flatnonzero(w) + y.start for w in want] + [np.zeros(0, np.int64)] * (len(rows) - k)
        used = np.zeros(len(rows), bool)
        used[x] |= want.any(axis=1)
        used[y] |= want.any(axis=0)
        place = np.flatnonzero(used)
        return pd.DataFrame({"key": key, "i": i, "j": j, "rid": rows["rid"].to_numpy()[place], "place": place,
                             "others": pd.Series([others[p] for p in place], dtype=object)})

    return materialize(tiles.groupBy("key", "i", "j").applyInPandas(
        compare, "key long, i long, j long, rid binary, place int, others array<int>"), "near")


def cross_links(near: DataFrame, held: DataFrame, idf) -> DataFrame:
    """The links (a, b) among the pairs of ``near_rows``. A text is read once for each pair of blocks; a pair that the links
    found there connect already is not compared again."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {p: shingle_weights(hashes(t), idf.value) for p, t in zip(rows["place"], rows["text"])}
        rid, top, out = dict(zip(rows["place"], rows["rid"])), {p: p for p in rows["place"]}, []

        def root(p):
            while top[p] != p:
                top[p] = p = top[top[p]]
            return p

        for p, others in zip(rows["place"], rows["others"]):
            for q in others:
                if root(p) != root(q) and similarity(weights[p], weights[q]) >= THRESHOLD:
                    top[root(p)] = root(q)
                    out.append((max(rid[p], rid[q]), min(rid[p], rid[q])))
        return pd.DataFrame(out, columns=["a", "b"])

    return (near.join(held.select("rid", "text"), "rid").groupBy("key", "i", "j")
            .applyInPandas(compare, "a binary, b binary").distinct())


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, keys) of each row, and (rid, low, least) of each text: its and its class's smallest id."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs))
    signed = materialize(signatures(docs, idf), "signatures")
    reps = materialize(signed.where("rid is not null").groupBy("rid").agg(
        F.min(_identity()).alias("low"), F.first("keys").alias("keys"), F.first("samples").alias("samples")), "representatives")
    rows = reps.select("rid", "low", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    buckets = materialize(rows.join(shared, "key"), "buckets")
    held = materialize(candidate_texts(docs, buckets), "texts")
    tested = links = None
    member = buckets.select("key", "rid", F.col("rid").alias("part"), F.lit(0).cast("long").alias("n"))
    for salt in range(ROUNDS):  # every member against its bucket's leader: the one with most links so far, drawn among equals
        drawn = F.struct((-F.col("n")).alias("n"), F.xxhash64(F.lit(salt), "key", "rid").alias("h"), "rid", "part")
        lead = member.groupBy("key").agg(F.min(drawn).alias("m")).select("key", F.col("m.rid").alias("lead"), F.col("m.part").alias("other"))
        pairs = (member.join(lead, "key").where("part <> other")
                 .select(F.greatest("rid", "lead").alias("a"), F.least("rid", "lead").alias("b")).distinct())
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = verified(pairs, held, idf)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = materialize(found if links is None else links.unionByName(found), "links")
        several = _in_several_components(buckets, materialize(components(links), "components"))
        degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
        member = several.join(degree, "rid", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    links = materialize(links.unionByName(cross_links(near_rows(several, reps, held), held, idf)), "links")
    parts = materialize(components(links), "components")
    whole = (reps.select("rid", "low").join(parts.withColumnRenamed("node", "rid"), "rid", "left")
             .withColumn("part", F.coalesce("component", "rid")))
    low = whole.groupBy("part").agg(F.min("low").alias("least"))
    return signed, materialize(whole.join(low, "part").select("rid", "low", "least"), "classes")
