"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words. A shingle's weight is its count in the document times its idf, 1 + log10(N / df). Document frequencies are
counted over all shingles of all documents by feature hashing, in SLOTS counters: df is what a shingle's counter holds. Counters are
kept to a twentieth of a decade in one byte, so the idf that tasks look up is 16 MB however large the corpus. What shares a counter
only lowers the idf of rare shingles, and alike for all: on N documents of L shingles it levels off near 1 + log10(SLOTS / L).

A second pass makes each distinct text's signature, BANDS x ROWS samples, in the log domain: the gamma and uniform variates of the
sampling come from quantile tables of 65,536 entries, indexed by bits of a hash of (shingle, number of the sample).

Texts with the same words are one class from the start. Two different texts that share a band's key are compared in three steps, each
by the weighted Jaccard similarity of the texts themselves; classes are the connected components of the links.

1. Every member of a bucket with one leader, which each bucket chooses anew.
2. In buckets that still hold several classes, of up to SMALL_BUCKET members all pairs of different classes, of others each member with
   LEADERS leaders.
3. What is still in a larger bucket of several classes goes through an exact prefix join (``rest_of``), which finds every pair alike.

So no pair that shares a band ends uncompared unless its texts are in one class already or can't be alike by the bounds of the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.analytics import components
from .common import Scratch, table
from .words import Hashed, release, mixed, steps

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Counters of document frequency, in so many ranges that are summed apart from each other.
SLOTS, RANGES = 1 << 24, 64
#: A byte holds the logarithm of a counter in so many steps a decade: up to 10 ** 12 documents.
STEPS_A_DECADE = 20
#: Members up to which a bucket is compared in full; its pairs are then linear in the bucket's rows.
SMALL_BUCKET = 12
#: Members with which all of a larger bucket's are compared in the second step.
LEADERS = 4
#: Rows of a shingle that are put into one block of the prefix join, and the step between the weights that it tells apart.
BLOCK, WEIGHT_STEP = 64, 1.02
#: Characters of text whose signatures are made at once: the arrays then stay in the processor's cache.
STEP = 1 << 18

# ---- weights --------------------------------------------------------------------------------------------------------------------

COUNTERS = "range int, salt int, at binary, n binary"


def emitted(counts: np.ndarray, begin: int, r: int, salt: int) -> Iterator[tuple]:
    """Rows of a range's counters that aren't 0: one byte each where many are set, places and counts otherwise."""
    at = np.flatnonzero(counts)
    if not len(at):
        return
    if len(at) * 8 > len(counts):
        yield r, salt, b"", np.minimum(counts, 255).astype(np.uint8).tobytes()
        at = at[counts[at] > 255]
        counts = counts - 255
    if len(at):
        yield r, salt, (at + begin).astype("<u4").tobytes(), counts[at].astype("<i8").tobytes()


def framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["range", "salt", "at", "n"])


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums the counters of the ranges in a partition, row by row: one range's counters a time are all that is held."""
    size, now, held = SLOTS // RANGES, None, None
    for pdf in batches:
        for r, salt, at, n in zip(pdf["range"], pdf["salt"], pdf["at"], pdf["n"], strict=True):
            if (r, salt) != now:
                if now is not None:
                    yield framed(list(emitted(held, 0, *now)))
                now, held = (r, salt), np.zeros(size, dtype=np.int64)
            if at:
                np.add.at(held, np.frombuffer(at, dtype="<u4"), np.frombuffer(n, dtype="<i8"))
            else:
                held += np.frombuffer(n, dtype=np.uint8)
    if now is not None:
        yield framed(list(emitted(held, 0, *now)))


class Weights:
    """The idf of every shingle: ``codes``, a byte a counter, and the number of documents that have a word."""

    def __init__(self, codes: np.ndarray, n_docs: int):
        self.codes = codes
        self.of_code = np.maximum(1.0, 1 + np.log10(max(n_docs, 1)) - np.arange(256) / STEPS_A_DECADE)

    def code(self, found: np.ndarray) -> np.ndarray:
        return self.codes[(found & np.uint64(SLOTS - 1)).astype(np.intp)]

    def weighted(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct shingles of each text and their weights."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in steps(texts):
            found, owner, counts = Hashed(texts[i:j]).counted(WIDTH)
            weights = counts * self.of_code[self.code(found)]
            edges = np.searchsorted(owner, np.arange(j - i + 1))
            out += [(found[a:b], weights[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out


def coded(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(np.log10(np.maximum(counts, 1)) * STEPS_A_DECADE)).astype(np.uint8)


def fitted(texts: DataFrame, scratch: Scratch) -> Callable[[], Weights]:
    """A function for tasks that gives the corpus's weights. texts: one column, all documents.

    A task counts its own shingles and emits its counters by range; these are summed in two steps, the first of which deals a range to
    several tasks, so neither the number of tasks nor a frequent shingle puts more than a stream of small rows into one.
    """
    size = SLOTS // RANGES
    salts = max(1, texts.sparkSession.sparkContext.defaultParallelism // RANGES)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, dtype=np.uint32)
        n = 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in steps(texts):
                found, owner, _ = Hashed(texts[i:j]).counted(WIDTH)
                n += int(np.count_nonzero(owner[1:] != owner[:-1])) + bool(len(owner))
                np.add.at(counts, (found & np.uint64(SLOTS - 1)).astype(np.intp), np.uint32(1))
        salt = TaskContext.get().partitionId() % salts
        if n:
            yield framed([(-1, salt, np.zeros(1, dtype="<u4").tobytes(), np.array([n], dtype="<i8").tobytes())])
            for r in range(RANGES):
                rows = list(emitted(counts[r * size : (r + 1) * size].astype(np.int64), 0, r, salt))
                if rows:
                    yield framed(rows)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros(size, dtype=np.int64)
        for pdf in summed(batches):
            for r, rows in pdf.groupby("range"):
                whole[:] = 0
                for at, n in zip(rows["at"], rows["n"], strict=True):
                    if at:
                        np.add.at(whole, np.frombuffer(at, dtype="<u4"), np.frombuffer(n, dtype="<i8"))
                    else:
                        whole += np.frombuffer(n, dtype=np.uint8)
                yield pd.DataFrame({"range": [r], "total": [int(whole[0])], "codes": [coded(whole).tobytes() if r >= 0 else b""]})

    counted = texts.mapInPandas(tally, COUNTERS)
    partly = counted.repartition("range", "salt").sortWithinPartitions("range", "salt").mapInPandas(summed, COUNTERS)
    partly = partly.withColumn("salt", F.lit(0)).repartition("range").sortWithinPartitions("range")
    out = scratch.save(partly.mapInPandas(finish, "range int, total long, codes binary"))
    codes, n_docs = np.zeros((RANGES, size), dtype=np.uint8), 0
    for row in out.toLocalIterator():  # one row a range, of one size for any corpus
        if row["range"] < 0:
            n_docs = row["total"]
        else:
            codes[row["range"]] = np.frombuffer(row["codes"], dtype=np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast((codes.reshape(-1), n_docs))
    return lambda: Weights(*shared.value)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


# ---- signatures -----------------------------------------------------------------------------------------------------------------


def quantile_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1), its logarithm, and the uniform distribution at the middles of 65,536 equal parts of probability."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.linspace(1e-6, 30.0, 600_000)
    gamma = np.interp(u, 1 - np.exp(-x) * (1 + x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), u.astype(np.float32)


class Sampler:
    def __init__(self, n: int):
        self.gamma, self.log_gamma, self.uniform = quantile_tables()
        self.salts = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def bands(self, found: np.ndarray, owner: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A row of BANDS keys for each document. owner numbers the shingles' documents from 0, without gaps and in order."""
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        log_w = np.log(weights).astype(np.float32)
        low16 = np.uint64(0xFFFF)
        keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, salt in enumerate(self.salts):
                x = (found ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(29)
                x *= np.uint64(0x94D049BB133111EB)
                r = self.gamma[(x >> np.uint64(48)).astype(np.intp)]
                beta = self.uniform[((x >> np.uint64(32)) & low16).astype(np.intp)]
                t = np.floor(log_w / r + beta)
                log_a = self.log_gamma[((x >> np.uint64(16)) & low16).astype(np.intp)] - r * (t - beta + np.float32(1))
                at = np.flatnonzero(log_a == np.minimum.reduceat(log_a, starts)[owner])
                who = owner[at]
                at = at[np.concatenate([[True], who[1:] != who[:-1]])]
                sample = mixed(found[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                band = k // ROWS
                keys[:, band] = keys[:, band] * np.uint64(0xD6E8FEB86659FD93) + sample
            return mixed(keys)


SIGNED = "doc_id long, d1 long, d2 long, bands array<long>"


def signatures(texts: DataFrame, weights: Callable[[], Weights]) -> DataFrame:
    """doc_id, the digest of all words (null if there are none) and the bands' keys."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, known = Sampler(BANDS * ROWS), weights()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in steps(texts, STEP):
                batch = Hashed(texts[i:j])
                ends = batch.begins.tolist()
                digests = [hashlib.blake2b(batch.words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
                first: dict[bytes, int] = {}
                for x in digests:
                    if x:
                        first.setdefault(x, len(first))
                number = np.full(j - i, -1, dtype=np.int64)  # of the first text with each digest
                seen: set[bytes] = set()
                for k, x in enumerate(digests):
                    if x and x not in seen:
                        seen.add(x)
                        number[k] = first[x]
                found, owner, counts = batch.counted(WIDTH)
                fresh = number[owner] >= 0
                found, owner, counts = found[fresh], number[owner[fresh]], counts[fresh]
                keys = sampler.bands(found, owner, counts * known.of_code[known.code(found)]).view(np.int64).tolist() if first else []
                d = [np.frombuffer(x, dtype="<i8") if x else (None, None) for x in digests]
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[i:j].astype("Int64"),
                        "d1": pd.array([x[0] for x in d], dtype="Int64"),
                        "d2": pd.array([x[1] for x in d], dtype="Int64"),
                        "bands": [keys[first[x]] if x else None for x in digests],
                    }
                )
        release()

    return texts.mapInPandas(sign, SIGNED)


# ---- candidates and links -------------------------------------------------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, weights: Callable[[], Weights]) -> DataFrame:
    """The pairs (a, b) whose texts are at least SIMILARITY alike. texts: one row a doc_id."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighing = weights()
        for pdf in batches:
            sizes = pdf["text_a"].str.len() + pdf["text_b"].str.len()
            for _, some in pdf.groupby((sizes.cumsum() // 4_000_000).to_numpy()):
                held = dict(zip(some["a"], some["text_a"], strict=True)) | dict(zip(some["b"], some["text_b"], strict=True))
                known = dict(zip(held, weighing.weighted(list(held.values())), strict=True))
                good = [similarity(known[a], known[b]) >= SIMILARITY for a, b in zip(some["a"], some["b"], strict=True)]
                yield some.loc[good, ["a", "b"]]
            release()

    # merge joins at any size, so that small runs show what large ones cost
    return pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInPandas(keep, "a long, b long")


def relabelled(named: DataFrame, new: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component after new links: components of the links between the old components, applied to all nodes."""
    of = [named.select(F.col("node").alias(e), F.col("component").alias(f"c_{e}")) for e in ("a", "b")]
    between = new.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    moved = components(between, scratch).select(F.col("node").alias("old"), F.col("component").alias("to"))
    fresh = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left_anti")
    nodes = named.union(fresh.select("node", F.col("node").alias("component")))
    return scratch.save(nodes.join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("to", "component").alias("component")))


def several(rows: DataFrame, scratch: Scratch, *also) -> DataFrame:
    """The rows (bucket, doc_id, class) of buckets with several classes, with the bucket's size n and what else is asked of a bucket."""
    stats = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), *also)
    return scratch.save(rows.join(scratch.save(stats.where("low < high").drop("low", "high")), "bucket"))


def ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked(signed: DataFrame, texts: DataFrame, scratch: Scratch, weights: Callable[[], Weights]) -> DataFrame:
    """node, component: classes of distinct texts by verified links. signed: doc_id and bands, a row per distinct text."""
    rows = signed.select("doc_id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "doc_id", F.col("doc_id").alias("class"))
    # the bucket's own order of its members: their ids under a mask, which the smallest gives back
    leader = F.min(F.col("doc_id").bitwiseXOR(F.col("bucket"))).bitwiseXOR(F.col("bucket")).alias("leader")
    buckets = several(rows, scratch, leader)
    held = scratch.save(texts.join(buckets.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))

    first = scratch.save(buckets.where("doc_id <> leader").select(*ordered("doc_id", "leader")).distinct())
    links = scratch.save(verified(first, held, weights))
    named = components(links, scratch)

    def now() -> DataFrame:
        return buckets.select("bucket", "doc_id").join(named, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("class"))

    leaders = F.array_distinct(F.array(*[F.min_by(F.struct("doc_id", "class"), F.xxhash64("doc_id", "bucket", F.lit(i))) for i in range(LEADERS)])).alias("leaders")
    left = several(now(), scratch, leaders)
    spokes = left.where(F.col("n") > SMALL_BUCKET).select("doc_id", F.explode(F.filter("leaders", lambda x: x["class"] != F.col("class"))).alias("leader"))
    few = left.where(F.col("n") <= SMALL_BUCKET).select("bucket", "doc_id", "class")
    other = few.select("bucket", F.col("doc_id").alias("other"), F.col("class").alias("other_class"))
    full = few.join(other, "bucket").where("doc_id < other AND class <> other_class")
    second = spokes.select(*ordered("doc_id", "leader.doc_id")).union(full.select("doc_id", "other")).distinct()
    second = scratch.save(second.join(first, ["a", "b"], "left_anti"))
    new = scratch.save(verified(second, held, weights))
    if not new.isEmpty():
        named = relabelled(named, new, scratch)
    large = left.where(F.col("n") > SMALL_BUCKET).select("bucket", "doc_id").join(named, F.col("doc_id") == F.col("node"), "left")
    large = several(large.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("class")), scratch).select("doc_id", "class").distinct()
    new = rest_of(large, held, first.union(second), scratch, weights)
    return named if new is None or new.isEmpty() else relabelled(named, new, scratch)


def rest_of(rest: DataFrame, texts: DataFrame, tried: DataFrame, scratch: Scratch, weights: Callable[[], Weights]) -> DataFrame | None:
    """All links between texts of different classes, by an exact prefix join. rest: doc_id, class; tried: pairs that needn't be compared.

    Shingles are put in one order, the rarest first. Two texts that are alike share SIMILARITY of the heavier one's weight and
    2 SIMILARITY / (1 + SIMILARITY) of the lighter one's at least, so the first shingle that they share has so much of either's weight
    at or after it: it is in the long prefix of the heavier and in the short one of the lighter. Only texts that meet so, differ in
    class, and have enough weight from there on for their sum are verified. Common boilerplate comes last in the order, and is in no
    short prefix of texts that are less alike than SIMILARITY because of what is their own.

    What is left from a shingle on says how heavy a partner can be. Texts meet by (shingle, step of the lighter one's weight, step of
    the heavier one's), and each stands in the few steps that it has room for, so those that can't be alike mostly don't meet at all,
    however many texts have the shingle. Rows lie in blocks of about BLOCK, one row a class and block, so a class's members don't meet
    each other, and nothing that grows with a class is gathered.
    """
    rest = scratch.save(rest)
    if rest.isEmpty():
        return None
    share, slack = 2 * SIMILARITY / (1 + SIMILARITY), 1 - 1e-9

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighing = weights()
        for pdf in batches:
            out = []
            for doc_id, own, (found, weight) in zip(pdf["doc_id"], pdf["class"], weighing.weighted(pdf["text"].tolist()), strict=True):
                order = np.lexsort((found, weighing.code(found)))
                total = weight.sum()
                after = total - np.cumsum(weight[order]) + weight[order]
                kept = after >= SIMILARITY * total * slack
                out.append((found[order][kept].view(np.int64), after[kept], own, doc_id, total))
            if out:
                n = [len(x[0]) for x in out]
                one = {k: np.repeat([x[i] for x in out], n) for i, k in ((2, "class"), (3, "doc_id"), (4, "weight"))}
                yield pd.DataFrame({"h": np.concatenate([x[0] for x in out]), "after": np.concatenate([x[1] for x in out])} | one)

    members = rest.join(texts.hint("merge"), "doc_id").select("doc_id", "class", "text")
    rows = scratch.save(members.mapInPandas(prefixes, "h long, after double, class long, doc_id long, weight double"))
    short = F.col("after") >= F.col("weight") * share * slack
    stats = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.max(short).alias("any"))
    stats = scratch.save(stats.where("low < high AND any").select("h", "n"))
    # the heaviest partner that the weight from here on allows for
    room = F.col("after") / (SIMILARITY / (1 + SIMILARITY) * slack) - F.col("weight")
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)).alias("block")
    near = scratch.save(rows.join(stats, "h").select("h", "class", "doc_id", "weight", "after", room.alias("room"), block))

    def step(weight: Column) -> Column:
        return F.floor(F.log(weight) / np.log(WEIGHT_STEP))

    def gathered(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("h", "lighter", "heavier", F.col("class").alias(f"class_{name}"), "block").agg(F.collect_list(F.struct("doc_id", "weight", "room")).alias(name)).drop("block")

    own = step(F.col("weight"))
    x = near.where("room >= weight").select("*", own.alias("lighter"), F.explode(F.sequence(own, step(F.col("room")))).alias("heavier"))
    y = near.select("*", own.alias("heavier"), F.explode(F.sequence(step(F.col("weight") * (SIMILARITY * slack)), step(F.least("weight", "room") * (1 / slack)))).alias("lighter"))
    met = gathered(x, "x").join(gathered(y, "y"), ["h", "lighter", "heavier"]).where("class_x <> class_y")

    def fits(a, b):
        return (a["weight"] <= b["weight"]) & (b["weight"] <= a["room"]) & (a["weight"] <= b["room"])

    found = F.flatten(F.transform("x", lambda a: F.transform(F.filter("y", lambda b: fits(a, b)), lambda b: F.struct(*ordered(a["doc_id"], b["doc_id"])))))
    pairs = met.select(F.explode(found).alias("p")).select("p.a", "p.b")
    pairs = scratch.save(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    return scratch.save(verified(pairs, texts, weights))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id, a row per input row. A class is named after its smallest doc_id.

    Case, punctuation and white space don't count. A null or empty text, or one without any word, is in a class of its own. A row
    whose key is null has a null class. Rows that repeat a key are versions of one document: they are in one class. Other columns are
    left out. An empty table gives no rows. Texts of fewer than five words are one shingle: they are alike only if they have the same
    words. A task holds about 40 bytes a byte of the text it works on.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weights = fitted(texts.select("text"), scratch)
    signed = scratch.save(signatures(texts, weights))
    with_words = signed.where("d1 IS NOT NULL AND doc_id IS NOT NULL")
    firsts = scratch.save(with_words.groupBy("d1", "d2").agg(F.min("doc_id").alias("first")))
    own = with_words.join(firsts, ["d1", "d2"]).where("doc_id = first").groupBy("d1", "d2", "first").agg(F.min("bands").alias("bands"))
    named = linked(own.select(F.col("first").alias("doc_id"), "bands").distinct(), texts.where("doc_id IS NOT NULL AND text IS NOT NULL"), scratch, weights)
    # rows that repeat a key but differ in text tie their texts' classes together
    twice = with_words.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("doc_id")
    tied = with_words.join(scratch.save(twice), "doc_id").select("doc_id", "d1", "d2").distinct().join(firsts, ["d1", "d2"])
    tied = scratch.save(tied.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    if not tied.isEmpty():
        named = relabelled(named, tied, scratch)
    of_text = firsts.join(named, F.col("first") == F.col("node"), "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "first").alias("c"))
    of_text = scratch.save(of_text)
    scratch.keep_only(signed, of_text)
    return (
        signed.select("doc_id", "d1", "d2")
        .join(of_text, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
        .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("class_id"))
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the document with the smallest key, and all rows with a null key.

    Of rows that repeat a key, which are versions of one document, the first by a hash of the text stays.
    """
    chosen = classes(docs, key, text).where("doc_id = class_id").select(F.col("doc_id").alias("__chosen")).distinct()
    order = Window.partitionBy(key).orderBy(F.xxhash64(text), text)
    kept = docs.join(chosen, F.col(key).cast("long") == F.col("__chosen"), "left_semi").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return kept.unionByName(docs.where(F.col(key).isNull()))
