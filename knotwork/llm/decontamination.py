"""Benchmark decontamination.

A CGK random walk reads a sequence of words, repeating each word until a random bit of (step, word) says to go on; two sequences a
small edit distance apart give walks a small Hamming distance apart, since after an edit the walks soon fall into step again. For
every position of every document the first STEPS words of WALKS such walks are computed at once in numpy, each standing for the
item-sized window that starts there. Repeated bit sampling takes SAMPLE of these coordinates, SAMPLES times a walk; where a sample
equals that of an item's window the two are candidates. An item is entered by windows at every second word of it, so that a stretch
without edits anywhere in it suffices. Walks alone miss short items, so every item is also entered by its pieces, one more than the
edits that it may have: one piece at least is then unedited, so items of every length are found at any allowed distance.

Candidates are first checked by a bound: at most as many words match as stand in both. The rest are verified exactly by the edit
distance, in words, between the item and the best-matching stretch of the document: at most MOST_EDITS of the item's length.

Documents are read once, in place: no join, no shuffle. The items are broadcast in blocks of BLOCK_WORDS words, each block with a pass
of its own, so what is broadcast has a fixed bound; a benchmark of usual size is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import Hashed, mixed, steps, words

MOST_EDITS = 0.2
#: Shorter items may have no edits, so their one piece, the whole item, finds every place of them without walks.
LEAST_WORDS = 5
STEPS, SAMPLE = 14, 8
WALKS, SAMPLES = 3, 4
ENTER_EVERY = 2
BLOCK_WORDS = 2_000_000
BATCH_CHARS = 1 << 18
SEED = 20


@dataclass
class Index:
    """A block of items, ready for search. Words are numbered from 1; 0 stands for all words that no item has."""

    ids: list[int]
    texts: list[str]
    items: list[np.ndarray] = field(init=False)
    vocabulary: np.ndarray = field(init=False)
    bits: np.ndarray = field(init=False)
    tables: list = field(init=False)
    owned: np.ndarray = field(init=False)
    pieces: list = field(init=False)

    def __post_init__(self) -> None:
        own = Hashed(self.texts)
        self.vocabulary = np.unique(own.words)
        self.items = np.split(self.numbered(own.words), own.begins[1:-1])
        size = len(self.vocabulary) + 1
        seeds = np.arange(WALKS * STEPS, dtype=np.uint64).reshape(WALKS, STEPS, 1) * np.uint64(1 << 32) + np.uint64(SEED << 56)
        with np.errstate(over="ignore"):
            self.bits = (mixed(mixed(seeds) + np.arange(size, dtype=np.uint64)) >> np.uint64(63)).astype(np.uint8)
        self.owned = np.unique(np.concatenate([np.unique(x).astype(np.int64) + i * size for i, x in enumerate(self.items)]))
        self.tables = [self.entered(n) for n in sorted({min(STEPS, len(x)) for x in self.items if len(x) >= LEAST_WORDS})]
        self.pieces = self.pieced()

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def entered(self, steps: int) -> list:
        """(walk, coordinates, sorted keys, item and offset of each, pairs of first coordinates) of the items with so many steps."""
        chosen = [i for i, x in enumerate(self.items) if min(STEPS, len(x)) == steps]
        places = [(i, o) for i in chosen for o in sorted({*range(0, len(self.items[i]) - steps + 1, ENTER_EVERY), len(self.items[i]) - steps})]
        flat = np.concatenate([np.append(x, np.zeros(STEPS, dtype=x.dtype)) for x in self.items])
        begins = np.cumsum([0, *[len(x) + STEPS for x in self.items]])
        at = np.array([begins[i] + o for i, o in places], dtype=np.int64)
        random = np.random.default_rng(SEED + steps)
        out = []
        for w in range(WALKS):
            seen = self.walk(flat, at, w, steps)
            for _ in range(SAMPLES):
                pick = np.sort(random.choice(steps, min(SAMPLE, steps), replace=False))
                keys = self.keys(seen, pick)
                order = np.argsort(keys, kind="stable")
                pairs = np.zeros(1 << 20, dtype=bool)
                pairs[self.pair(seen[pick[0]], seen[pick[1]])] = True
                out.append((w, pick, keys[order], np.array(places, dtype=np.int64)[order], pairs))
        return [steps, out]

    def pieced(self) -> list:
        """(words, sorted keys, item and offset of each, pairs of first words) of all pieces of so many words."""
        of: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(self.items):
            cuts = np.linspace(0, len(x), int(len(x) * MOST_EDITS + 1e-9) + 2).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                of.setdefault(b - a, []).append((i, a))
        out = []
        for n, places in sorted(of.items()):
            seen = [np.array([self.items[i][o + t] for i, o in places], dtype=np.int32) for t in range(n)]
            keys = self.keys(seen, np.arange(n))
            order = np.argsort(keys, kind="stable")
            pairs = np.zeros(1 << 20, dtype=bool)
            pairs[self.pair(seen[0], seen[min(1, n - 1)])] = True
            out.append((n, keys[order], np.array(places, dtype=np.int64)[order], pairs))
        return out

    def walk(self, tokens: np.ndarray, at: np.ndarray, w: int, steps: int) -> list[np.ndarray]:
        seen = []
        at = at.copy()
        for t in range(steps):
            seen.append(tokens[at])
            at += self.bits[w, t][seen[-1]]
        return seen

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint32) * np.uint32(2654435761) + b.astype(np.uint32) * np.uint32(40503 * 65537)) >> np.uint32(12)).astype(np.intp)

    @staticmethod
    def keys(seen: list[np.ndarray], pick: np.ndarray) -> np.ndarray:
        out = np.zeros(len(seen[0]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for t in pick:
                out = mixed(out + seen[t].astype(np.uint64) + np.uint64(1))
        return out

    def candidates(self, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Distinct rows (item, position where the item would start, text) of tokens that end with STEPS zeros."""
        at = np.arange(len(tokens) - STEPS, dtype=np.int64)
        at = at[tokens[: len(at)] > 0]
        found = [np.zeros((0, 3), dtype=np.int64)]
        for w in range(WALKS):
            seen = self.walk(tokens, at, w, STEPS)
            for _, entries in self.tables:
                for walk, pick, keys, places, pairs in entries:
                    if walk != w:
                        continue
                    near = np.flatnonzero(pairs[self.pair(seen[pick[0]], seen[pick[1]])])
                    asked = self.keys([s[near] for s in seen], pick)
                    low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
                    n = high - low
                    who = np.repeat(np.arange(len(near)), n)
                    entry = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who]
                    here = at[near[who]]
                    found.append(np.stack([places[entry, 0], here - places[entry, 1], np.searchsorted(begins, here, "right") - 1], axis=1))
        for n, keys, places, pairs in self.pieces:
            seen = [tokens[at + t] for t in range(n)]
            near = np.flatnonzero(pairs[self.pair(seen[0], seen[min(1, n - 1)])])
            asked = self.keys([s[near] for s in seen], np.arange(n))
            low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            n_hits = high - low
            who = np.repeat(np.arange(len(near)), n_hits)
            entry = np.arange(len(who)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + low[who]
            here = at[near[who]]
            found.append(np.stack([places[entry, 0], here - places[entry, 1], np.searchsorted(begins, here, "right") - 1], axis=1))
        rows = np.concatenate(found)
        # one number a row sorts faster than three columns: the start, at most STEPS words before the text's, is enough with the text
        code = (rows[:, 0] << 40) | (rows[:, 1] + (1 << 20))
        _, first = np.unique(code, return_index=True)
        return rows[first]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches (item_id, edits, first word, words), the best one of each item."""
        own = Hashed(texts)
        sizes = np.diff(own.begins)
        begins = np.concatenate([[0], np.cumsum(sizes + STEPS)]) + STEPS  # every text is followed by STEPS times word 0
        tokens = np.zeros(begins[-1], dtype=np.int32)
        tokens[np.arange(len(own.words)) + np.repeat(begins[:-1] - own.begins[:-1], sizes)] = self.numbered(own.words)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        maybe = self.candidates(tokens, begins)
        # candidates of one item and text that start close together are one, with a longer reach
        item, at, text_of = maybe.T
        opens = np.concatenate([[True], (item[1:] != item[:-1]) | (text_of[1:] != text_of[:-1]) | (at[1:] - at[:-1] > 2)])[: len(maybe)]
        firsts = np.flatnonzero(opens)
        spread = at[np.append(firsts[1:], len(at)) - 1] - at[firsts] if len(firsts) else at
        maybe = np.concatenate([maybe[firsts], spread[:, None]], axis=1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        vocab = len(self.vocabulary) + 1
        lengths = np.array([len(x) for x in self.items], dtype=np.int64)
        allowed = (lengths * MOST_EDITS + 1e-9).astype(np.int64)
        for i in range(0, len(maybe), 4096):
            item, at, text_of, spread = maybe[i : i + 4096].T
            reach = lengths[item] + 2 * allowed[item] + spread
            spot = (at - allowed[item])[:, None] + np.arange(reach.max())
            inside = (np.arange(reach.max()) < reach[:, None]) & (spot >= 0) & (spot < len(tokens))
            asked = item[:, None] * vocab + tokens[np.where(inside, spot, 0)]
            place = np.minimum(np.searchsorted(self.owned, asked), len(self.owned) - 1)
            shared = ((self.owned[place] == asked) & inside).sum(axis=1)
            for j in np.flatnonzero(shared >= lengths[item] - allowed[item]):
                k, n, doc = int(item[j]), int(lengths[item[j]]), int(text_of[j])
                low, high = max(begins[doc], at[j] - allowed[k]), min(begins[doc + 1] - STEPS, at[j] + spread[j] + n + allowed[k])
                if high <= low:
                    continue
                edits, first, last = closest(self.items[k], tokens[low:high])
                if edits <= allowed[k]:
                    hit = (edits, int(low + first - begins[doc]), last - first)
                    best[doc, k] = min(best.get((doc, k), hit), hit)
        for (doc, k), (edits, first, n) in sorted(best.items()):
            out[doc].append((self.ids[k], edits, first, n))
        return out


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of text with the fewest word edits to item; the first end, then the latest start."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, dtype=np.int64), steps.copy()
    # cost and start share a number, so that a running minimum carries both; a later start is the smaller
    big = n + 1
    row = cost * big + (n - start)
    for word in item:
        swap = row[:-1] + np.where(text == word, 0, big)
        new = row + big
        new[1:] = np.minimum(new[1:], swap)
        row = np.minimum.accumulate(new - steps * big) + steps * big
    end = int(np.argmin(row // big))
    return int(row[end] // big), int(n - row[end] % big), end


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[Index]:
    return list(each_block(benchmark, key, text))


def each_block(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Items by block, one block in memory a time. Null keys or texts and items without a word take no part; repeated items count once."""
    rows = benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct().orderBy("item_id", "text")
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in rows.toLocalIterator():
        n = len(words(row["text"]))
        if not n:
            continue
        if size and size + n > BLOCK_WORDS:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Index(ids, texts)


MATCHES = "array<struct<item_id: long, edits: int, first_word: int, n_words: int>>"


def matches(spark: SparkSession, block: Index, text: str | Column) -> Column:
    """A column of the matches of each text with a block's items; empty for a null or empty text."""
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(MATCHES)
    def search(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        out = [m for i, j in steps(given, BATCH_CHARS) for m in shared.value.search(given[i:j])]
        return pd.Series([[dict(zip(("item_id", "edits", "first_word", "n_words"), m, strict=True)) for m in x] for x in out], dtype=object)

    return search(F.col(text) if isinstance(text, str) else text)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first_word, n_words: a row for each document and item found in it.

    Case, punctuation and white space don't count. Of several places of an item in a document the closest is given, then the first.
    Null and empty texts have no matches; null keys are carried along; repeated rows are each searched. An empty table on either side
    gives no rows. Other columns are left out. A task holds about 40 bytes a byte of the text it works on.
    """
    found = None
    for block in each_block(benchmark):
        one = docs.select(F.col(key).alias("doc_id"), F.explode(matches(docs.sparkSession, block, text)).alias("m")).select("doc_id", "m.*")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.select(F.col(key).alias("doc_id"), F.explode(F.lit(None).cast(MATCHES)).alias("m")).select("doc_id", "m.*")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for block in each_block(benchmark):
        docs = docs.where(F.size(matches(docs.sparkSession, block, text)) == 0)
    return docs


def recall(index: Index, trials: int = 5, seed: int = 1) -> float:
    """The share of items that are found in a text of other words after as many random word edits as are allowed."""
    random = np.random.default_rng(seed)
    hits = total = 0
    for i, text in enumerate(index.texts):
        for _ in range(trials):
            own = words(text)
            item = index.items[i]
            for _ in range(int(len(item) * MOST_EDITS + 1e-9)):
                at, kind = int(random.integers(len(own))), random.integers(3)
                own[at : at + (kind != 0)] = [] if kind == 1 else [f"new{random.integers(1 << 30)}"]
            edited = " ".join([*(f"pad{x}" for x in range(9)), *own, *(f"pad{x}" for x in range(9))])
            hits += any(m[0] == index.ids[i] for m in index.search([edited])[0])
            total += 1
    return hits / max(total, 1)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
