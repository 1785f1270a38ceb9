"""Token-ID / binary output.

Texts are encoded with a public byte-level BPE tokenizer, and the ids are stored by their rank in the corpus's id frequencies, in a
byte-aligned variable-length code: one to four little-endian bytes a value in a data stream, and apart from it one control byte for
every four values, which holds their lengths in two bits each. Decoding is numpy table lookup: the control byte gives four lengths.

The container is Parquet, so any store that Spark writes to will do: a row per document (part, seq, start in the part, n_tokens,
control, data), in ascending order of doc_id, plus a one-row table with the ids in rank order.

One range exchange of the texts puts documents in order; encoding, counting and the running starts happen in the same stage. Only
id counts (at most one per vocabulary entry) and token totals (one per partition) come to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .words import release, spans_hashed, steps

END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a worker remembers. The first ones are the frequent ones; it starts anew only if most words of a batch are new.
CACHE_WORDS = 700_000
#: White space that is followed by more white space or the end: such texts are encoded in one piece.
IRREGULAR = re.compile(r"[ \n](?:\s|\Z)")

BREAKS = np.isin(np.arange(256), [10, 32])
#: ASCII white space, and first bytes of other white space.
MAYBE_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3])
#: Marks of punctuation, which the splitting pattern separates from a letter or digit before them.
MARK = np.isin(np.arange(256), list(b".,;:!?"))
ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])

# ---- the code -------------------------------------------------------------------------------------------------------------------

#: Lengths of the four values of each control byte, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros((len(values) + 3) // 4 * 4, dtype=np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    cells = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), cells[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``pack``."""
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    source = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    at = ends - sizes
    out = np.zeros(n, dtype=np.uint32)
    for j in range(int(sizes.max(initial=0))):
        out |= np.where(sizes > j, source[at + j], 0).astype(np.uint32) << np.uint32(8 * j)
    return out


# ---- encoding -------------------------------------------------------------------------------------------------------------------


class Encoder:
    """Encodes whole texts; equal to encoding each text at once.

    A byte-level BPE with the usual splitting pattern never joins a space or line feed, when a non-space follows it, to what stands
    before it, nor a mark of punctuation to an ASCII letter or digit. So a text without runs of white space is a sequence of pieces:
    line feeds, words with their leading space, and what follows a mark. Pieces are found in the bytes of a whole batch in numpy, told
    apart by a 64-bit hash and their length, and only distinct ones that aren't remembered go to the tokenizer. Any other text, and
    one that spells an added token such as the end of a text, is encoded in one piece.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if len(vocab) <= 1 << 16 else np.dtype("<u4")
        self.size = max(vocab.values()) + 1
        self.opens = np.zeros(self.size, dtype=bool)
        for token, number in vocab.items():
            self.opens[number] = token.startswith("Ġ")
        self.line_feed = self.ids("\n")
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # hashes in ascending order, and where the piece of each is
        self.places = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=self.dtype)
        self.offsets = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def learned(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; pieces of one kind are joined, so that the tokenizer is called once for many."""
        out: list = [None] * len(pieces)
        for spaced in (True, False):
            chosen = [i for i, p in enumerate(pieces) if p.startswith(b" ") == spaced and p != b"\n"]
            for k in range(0, len(chosen), 20_000):
                some = chosen[k : k + 20_000]
                ids = self.ids((b"" if spaced else b"\n").join([pieces[i] for i in some]).decode("utf-8", "surrogatepass"))
                if spaced:
                    starts = np.flatnonzero(self.opens[ids])
                    ends = np.append(starts[1:], len(ids))
                else:
                    breaks = np.flatnonzero(ids == self.line_feed[0])
                    starts, ends = np.append(0, breaks + 1), np.append(breaks, len(ids))
                if len(starts) == len(some):
                    for i, a, b in zip(some, starts.tolist(), ends.tolist(), strict=True):
                        out[i] = ids[a:b]
                else:  # a piece that holds what the pattern treats as a space
                    for i in some:
                        out[i] = self.ids(pieces[i].decode("utf-8", "surrogatepass"))
        return [self.line_feed if x is None else x for x in out]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        edges = np.cumsum([0, *[len(p) for p in parts]])
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        # a break before what may be white space, or at a text's end: only such texts need a closer look
        odd = np.flatnonzero(BREAKS[data[:-1]] & MAYBE_WHITE[data[1:]])
        last = edges[1:][edges[1:] > edges[:-1]] - 1
        odd = np.concatenate([odd, last[BREAKS[data[last]]]])
        whole = {i for i in np.unique(np.searchsorted(edges, odd, "right") - 1).tolist() if IRREGULAR.search(texts[i])}
        whole |= {i for i, t in enumerate(texts) if any(x in t for x in self.added)}
        if whole:
            parts = [b"" if i in whole else p for i, p in enumerate(parts)]
            edges = np.cumsum([0, *[len(p) for p in parts]])
            data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        blob = data.tobytes()
        opens = BREAKS[data]
        if len(data):
            opens[1:] |= data[:-1] == 10
            opens[1:] |= MARK[data[1:]] & ALNUM[data[:-1]]
            opens[edges[:-1][edges[:-1] < len(data)]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        hashes, first, which = np.unique(spans_hashed(data, starts, ends), return_index=True, return_inverse=True)
        slots = np.searchsorted(self.known, hashes)
        places = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.known):
            near = np.minimum(slots, len(self.known) - 1)
            places = np.where(self.known[near] == hashes, self.places[near], -1)
        new = np.flatnonzero(places < 0)
        kept = len(self.offsets)
        if len(new):
            at = first[new]
            ids = self.learned([blob[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, *ids])
            places[new] = np.arange(kept, kept + len(new))
        which = places[which]
        sizes = self.lengths[which]
        totals = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.offsets[which] - totals[:-1], sizes) + np.arange(totals[-1])]
        cuts = totals[np.searchsorted(starts, edges)].tolist()
        if kept + len(new) <= CACHE_WORDS:
            self.known = np.insert(self.known, slots[new], hashes[new])
            self.places = np.insert(self.places, slots[new], np.arange(kept, kept + len(new)))
        elif 2 * len(new) > len(hashes):  # the texts have changed
            self.forget()
        else:
            size = int(self.offsets[kept])
            self.offsets, self.lengths, self.flat = self.offsets[:kept].copy(), self.lengths[:kept].copy(), self.flat[:size].copy()
        return [self.ids(texts[i]) if i in whole else out[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


_encoder: list = [None, None]


def encoder_for(tokenizer_json: str) -> Encoder:
    """A worker process keeps its encoder, and so what it has remembered, from task to task."""
    if _encoder[0] != hash(tokenizer_json):
        _encoder[:] = [hash(tokenizer_json), Encoder(tokenizer_json)]
    return _encoder[1]


# ---- the operator ---------------------------------------------------------------------------------------------------------------

RAW = "kind int, part int, seq long, doc_id long, start long, n_tokens long, ids binary"
FILES = "part int, seq long, doc_id long, start long, n_tokens long, control binary, data binary"
#: Characters that are encoded at once.
STEP = 1 << 21


def write_files(docs: DataFrame, tokenizer_path: str, scratch: Scratch, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Writes all texts in ascending order of key; returns the files' rows, ids by rank and each part's first position.

    A null text counts as empty and gives the end id alone. Null keys come first; rows that repeat a key stay apart, in the order
    of their texts. Other columns are left out. An empty table gives no rows. A task holds about 40 bytes a byte of the text it works
    on.
    """
    spark = scratch.spark
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(model.value)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        counts = np.zeros(encoder.size, dtype=np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in steps(texts, STEP):
                some = pdf.iloc[i:j]
                ids = [x.tobytes() + end for x in encoder.batch(texts[i:j])]
                counts += np.bincount(np.frombuffer(b"".join(ids), dtype=encoder.dtype), minlength=encoder.size)
                sizes = np.array([len(x) // encoder.dtype.itemsize for x in ids], dtype=np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pd.DataFrame({"kind": 0, "part": part, "seq": np.arange(seq, seq + len(ids)), "doc_id": some["doc_id"].astype("Int64"), "start": starts, "n_tokens": sizes, "ids": ids})
                seq += len(ids)
            release()
        if seq:
            seen = np.flatnonzero(counts)
            table = np.stack([seen, counts[seen]]).astype("<i8").tobytes()
            yield pd.DataFrame({"kind": [1], "part": [part], "seq": [seq], "doc_id": pd.array([None], dtype="Int64"), "start": [start], "n_tokens": [0], "ids": [table]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["ids"]:
                ids, counts = np.frombuffer(blob, dtype="<i8").reshape(2, -1)
                yield pd.DataFrame({"id": ids, "n": counts})

    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    raw = scratch.save(ordered.mapInPandas(encode, RAW))
    per_id = raw.where("kind = 1").select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = {r["id"]: r["n"] for r in per_id.collect()}  # at most one per vocabulary entry
    by_rank = np.array(sorted(seen, key=lambda i: (-seen[i], i)), dtype=np.uint32)
    totals = {r["part"]: r["start"] for r in raw.where("kind = 1").select("part", "start").collect()}  # one per partition
    first = np.zeros(max(totals, default=0) + 2, dtype=np.int64)
    for part, total in totals.items():
        first[part + 1] = total
    first = np.cumsum(first)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    wide = len(Encoder(model.value).opens) > 1 << 16
    shared = spark.sparkContext.broadcast(rank_of)

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [pack(shared.value[np.frombuffer(x, dtype="<u4" if wide else "<u2")]) for x in pdf["ids"]]
            yield pdf.drop(columns=["ids"]).assign(control=[p[0] for p in packed], data=[p[1] for p in packed])

    files = scratch.save(raw.where("kind = 0").drop("kind").mapInPandas(compress, FILES))
    scratch.save(spark.createDataFrame([(by_rank.tobytes(),)], "ids_by_rank binary"))
    scratch.drop(raw)
    return files, by_rank, first


def read_files(files: DataFrame, by_rank: np.ndarray, first: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, decoded from the files."""
    shared = files.sparkSession.sparkContext.broadcast((by_rank, first))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_rank, first = shared.value
        for pdf in batches:
            ids = [by_rank[unpack(c, d, n)] for c, d, n in zip(pdf["control"], pdf["data"], pdf["n_tokens"], strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "start": first[pdf["part"].to_numpy()] + pdf["start"].to_numpy(),
                    "n_tokens": [len(x) for x in ids],
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                }
            )

    return files.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` and reads them back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    return read_files(*write_files(docs, tokenizer_path, Scratch(docs.sparkSession, "token-binary")))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"))
