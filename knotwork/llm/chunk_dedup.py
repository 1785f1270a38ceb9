"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text: h = 2 h + G[byte] in 32 bits, so it depends on the last 32 bytes alone. A chunk
ends where the hash is the smallest of some WINDOW consecutive ones; so ends depend on the content around them only, a shift from an
insertion changes nothing beyond it, and chunks are about WINDOW / 2 bytes and WINDOW at most (in monotonous stretches, twice that). Any
passage of n bytes is thus cut alike wherever it stands, but for 32 + WINDOW bytes at its start and WINDOW at its end.

A single short chunk says little, so the unit of deduplication is the shortest run of consecutive chunks of MIN_BYTES or more from
each chunk on, told apart by 96 bits of digest. One aggregation with partial sums finds the digests that stand in two rows, with the
first of them, and a join brings them back to their places; no aggregation shares its stage, so AQE can split a hot digest. The places
found are joined to spans. Nothing that isn't a verbatim repeat of MIN_BYTES is in a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .words import mixed

WINDOW = 64
MIN_BYTES = 100
SIZE_BITS = 31

#: The gear table: a fixed pseudo-random 32-bit number for each byte.
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every run of ``width`` (a power of two) values; the result is width - 1 shorter."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def gear(data: np.ndarray) -> np.ndarray:
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        before = h[:-shift] << np.uint32(shift)
        h[shift:] += before
    return h


def ends(data: bytes) -> np.ndarray:
    """Where the chunks of ``data`` end, the last at its own end."""
    n = len(data)
    if n <= WINDOW:
        return np.array([n] if n else [], dtype=np.int64)
    h = gear(np.frombuffer(data, dtype=np.uint8))
    lows = sliding(h, WINDOW, np.minimum)  # of the runs from 0 to n - WINDOW
    edge = np.zeros(WINDOW - 1, dtype=np.uint32)
    picked = np.flatnonzero(h == sliding(np.concatenate([edge, lows, edge]), WINDOW, np.maximum))
    # in a monotonous stretch every minimum is alike: one end in WINDOW bytes, counted from the stretch's first
    fresh = np.concatenate([[True], h[picked[1:]] != h[picked[:-1]]])
    nth = (picked - picked[fresh][np.cumsum(fresh) - 1]) // WINDOW
    cuts = picked[fresh | np.concatenate([[True], nth[1:] != nth[:-1]])] + 1
    return cuts if len(cuts) and cuts[-1] == n else np.append(cuts, n)


def stretches(stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of chunks of MIN_BYTES or more from each chunk on, and of the last one up to the end."""
    if not len(stops) or stops[-1] < MIN_BYTES:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    last = np.searchsorted(stops, starts + MIN_BYTES)
    starts, ends = starts[last < len(stops)], stops[last[last < len(stops)]]
    return (starts, ends) if ends[-1] == stops[-1] else (np.append(starts, starts[-1]), np.append(ends, stops[-1]))


def chunked(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """uid (a number for each row), doc_id, h (a hash of the text), the stretches' digests, second digests and places (start and size)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = TaskContext.get().partitionId() << 33
        for pdf in batches:
            digests, checks, places, whole = [], [], [], []
            for text in pdf["text"]:
                data = text.encode("utf-8", "surrogatepass") if text else b""
                starts, stops = stretches(ends(data))
                both = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
                numbers = np.frombuffer(both, dtype="<i8")
                digests.append(numbers[0::2])
                checks.append(numbers[1::2].astype(np.int32))
                places.append((starts << SIZE_BITS) + stops - starts)
                whole.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
            out = pd.DataFrame({"uid": np.arange(uid, uid + len(pdf)), "doc_id": pdf["doc_id"].astype("Int64"), "h": whole, "digests": digests, "checks": checks, "places": places})
            yield out.assign(text=pdf["text"].to_numpy()) if with_text else out
            uid += len(pdf)

    return docs.mapInPandas(cut, "uid long, doc_id long, h long, digests array<long>, checks array<int>, places array<long>" + ", text string" * with_text)


def ordered(cut: DataFrame) -> tuple[DataFrame, Column]:
    """cut with ord, the rows' order, which is also what tells them apart; and the key of an ``owner``.

    That is the key where every row has one of its own. Otherwise keys (nulls last), then hashes of the texts decide; rows alike in
    both are interchangeable, so it does not matter how they lay in the input.
    """
    twice = cut.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if twice.isEmpty():
        return cut.withColumn("ord", F.col("doc_id")), F.col("owner")
    return cut.withColumn("ord", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "uid")), F.col("owner.doc_id")


def repeated_stretches(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """ord, start, size, owner (the first row with the stretch): the stretches that stand in two rows or more. cut: with ord."""
    found = cut.select("ord", F.explode(F.arrays_zip("digests", "checks", "places")).alias("c")).select("ord", F.col("c.digests").alias("digest"), F.col("c.checks").alias("check"), F.col("c.places").alias("place"))
    owners = found.groupBy("digest", "check").agg(F.min("ord").alias("owner"), F.max("ord").alias("other"))
    shared = scratch.save(owners.where("owner < other").select("digest", "check", "owner"))
    place = F.col("place")
    return found.join(shared, ["digest", "check"]).select("ord", F.shiftright(place, SIZE_BITS).alias("start"), place.bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).alias("size"), "owner")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans that stand in two rows or more: doc_id, start, n_bytes (of the UTF-8 text), cut_bytes, first_doc_id, is_first.

    A span is a place of which every byte is in a stretch of MIN_BYTES or more that stands whole in another row. first_doc_id is the
    first row, in the order of keys, with any of its stretches; cut_bytes is how much of the span is in stretches that an earlier row
    holds, so deduplication removes it here; is_first is true if that is nothing. Passages of 260 bytes or more that two rows share
    are always found, but for up to 96 bytes at their start and 164 at their end; shorter ones if their chunks lie well.

    Rows that repeat a key are rows of their own, in the order of a hash of their texts; null keys come last. Null and empty texts
    have no spans. Other columns are left out; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "chunk-dedup")
    cut = scratch.save(chunked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))))
    cut, owner_key = ordered(cut)
    end = F.col("start") + F.col("size")
    by_row = Window.partitionBy("ord").orderBy("start", end)
    before = by_row.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("owner") < F.col("ord")
    rows = repeated_stretches(cut, scratch).select(
        "ord",
        "start",
        "owner",
        F.greatest(end, F.col("start")).alias("end"),
        F.max(end).over(before).alias("reach"),
        F.when(earlier, F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(F.when(earlier, end)).over(before), F.lit(0))))).otherwise(0).alias("cut"),
    )
    opens = F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)
    rows = rows.withColumn("span", F.sum(opens).over(Window.partitionBy("ord").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy("ord", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("cut").alias("cut_bytes"), F.min("owner").alias("owner"))
    own = F.col("ord") if dict(cut.dtypes)["ord"] == "bigint" else F.col("ord.doc_id")
    return spans.select(own.alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("n_bytes"), "cut_bytes", owner_key.alias("first_doc_id"), (F.col("cut_bytes") == 0).alias("is_first"))


def without(text: str | None, gone) -> str | None:
    """The text without the places; a character that a place cuts through stays."""
    if text is None or gone is None or not len(gone):
        return text
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    merged: list[list[int]] = []
    for place in sorted(int(x) for x in gone):
        start, end = place >> SIZE_BITS, (place >> SIZE_BITS) + (place & ((1 << SIZE_BITS) - 1))
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, a row per input row, without what an earlier row holds of the spans that ``repeats`` finds."""
    scratch = Scratch(docs.sparkSession, "chunk-dedup")
    cut, _ = ordered(scratch.save(chunked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), True)))
    rows = repeated_stretches(cut.drop("text"), scratch)
    place = F.shiftleft("start", SIZE_BITS) + F.col("size")
    gone = rows.where(F.col("owner") < F.col("ord")).groupBy(F.col("ord").alias("of")).agg(F.collect_list(place).alias("gone"))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([without(t, g) for t, g in zip(texts, places, strict=True)], dtype=object)

    return cut.select("ord", "doc_id", "text").join(gone, F.col("ord") == F.col("of"), "left").select("doc_id", cut_out("text", "gone").alias("text"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
