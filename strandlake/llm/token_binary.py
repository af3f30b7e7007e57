"""Token ids in binary form: a static range asymmetric numeral system over interleaved blocks.

Documents are range-partitioned by id and sorted; each task turns its texts into ids and writes segments of whole
documents. A segment holds one frequency table that all its blocks share; a block has LANES interleaved 64-bit
coder states, a checkpoint (final states and word offset) from which it is decoded without the others, and a crc32.
The segments are rows of a Parquet data set: Spark reads and writes them wherever the cluster stores tables.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import read, stored
from strandlake.llm.kernels import chunks, raw

U = np.uint64
BITS = 18
LANES = 64
BLOCK = 1 << 16
SEGMENT = 1 << 21
LOWEST = U(1 << 31)
END = 1
MAGIC = b"RANS1\0"


# -- coder ------------------------------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts (all over 0) scaled to sum 2**BITS, none under 1. Deterministic."""
    total, slots = int(counts.sum()), 1 << BITS
    if len(counts) > slots:
        raise ValueError(f"{len(counts)} symbols do not fit a table of {slots}")
    f = np.maximum(1, counts.astype(np.float64) * slots / total).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - slots
    while over > 0:  # rounding up of rare symbols is taken from the frequent ones
        take = np.minimum(f[order] - 1, np.maximum(1, f[order] * over // int(f.sum())))
        upto = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        f[order] -= upto
        over = int(f.sum()) - slots
    f[order[0]] -= over
    return f.astype(np.uint64)


def encode(ids: np.ndarray) -> bytes:
    """A segment: header, table, checkpoints, words. ids are unsigned 32-bit."""
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<QIII", 0, 0, 0, 0)
    if int(ids.max()) < 1 << 20:  # any usual vocabulary: counted without a sort
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        rank = np.zeros(len(counts), np.int64)
        rank[symbols] = np.arange(len(symbols))
        index, counts = rank[ids], counts[symbols]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = scaled(counts)
    cum = np.cumsum(freq) - freq
    blocks = -(-n // BLOCK)
    steps = -(-n // (blocks * LANES))
    padded = np.zeros(blocks * steps * LANES, np.int64)
    padded[:n] = index
    grid = padded.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOWEST, np.uint64)
    limit = freq << U(63 - BITS)
    out, where = [], []
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = freq[s]
        full = state >= limit[s]
        b, lane = np.nonzero(full)
        out.append((state[b, lane] & U(0xFFFFFFFF)).astype(np.uint32))
        where.append(b.astype(np.int32))
        state = np.where(full, state >> U(32), state)
        q = state // f
        state = (q << U(BITS)) + (state - q * f) + cum[s]
    words = np.concatenate(out[::-1])
    block_of = np.concatenate(where[::-1])
    words = words[np.argsort(block_of, kind="stable")]
    lengths = np.bincount(block_of, minlength=blocks).astype(np.uint32)
    whole = padded.reshape(blocks, -1)
    sums = np.array([zlib.crc32(symbols.astype("<u4")[whole[b]].tobytes()) for b in range(blocks)], np.uint32)
    head = MAGIC + struct.pack("<QIII", n, blocks, steps, len(symbols))
    return b"".join([head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), state.astype("<u8").tobytes(), lengths.astype("<u4").tobytes(), sums.astype("<u4").tobytes(), words.astype("<u4").tobytes()])


def decode(data: bytes, only: slice = slice(None)) -> np.ndarray:
    """The ids of a segment, or of some of its blocks (only). Raises ValueError where a checksum differs."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a segment")
    at = len(MAGIC)
    n, blocks, steps, m = struct.unpack_from("<QIII", data, at)
    at += struct.calcsize("<QIII")
    if not n:
        return np.zeros(0, np.uint32)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    symbols, freq = take("<u4", m), take("<u4", m).astype(np.uint64)
    state = take("<u8", blocks * LANES).reshape(blocks, LANES)[only].copy()
    lengths, sums = take("<u4", blocks).astype(np.int64), take("<u4", blocks)[only]
    words = np.frombuffer(data, "<u4", -1, at)
    point = (np.cumsum(lengths) - lengths)[only]
    ends = np.cumsum(lengths)[only]
    cum = np.cumsum(freq) - freq
    slot_symbol = np.repeat(np.arange(m, dtype=np.int32), freq.astype(np.int64))
    got = np.empty((len(state), steps, LANES), np.int32)
    mask = U((1 << BITS) - 1)
    for t in range(steps):
        slot = state & mask
        s = slot_symbol[slot]
        got[:, t] = s
        state = freq[s] * (state >> U(BITS)) + slot - cum[s]
        low = state < LOWEST
        count = low.cumsum(1)
        if (point + count[:, -1] > ends).any():
            raise ValueError("a block is too short")
        b, lane = np.nonzero(low)
        state[b, lane] = (state[b, lane] << U(32)) | words[point[b] + count[b, lane] - 1]
        point = point + count[:, -1]
    ids = symbols[got.reshape(len(state), -1)]
    for b, crc in enumerate(sums):
        if zlib.crc32(ids[b].tobytes()) != crc:
            raise ValueError(f"the checksum of block {b} differs")
    flat = ids.reshape(-1)
    per = steps * LANES
    stop = min(n, range(blocks)[only].stop * per) - range(blocks)[only].start * per
    return flat[: max(0, stop)]


# -- texts to ids -----------------------------------------------------------------------------------------------

#: How the vocabulary splits a word after lower-casing, for words of ASCII and Latin-1 letters only; all others go
#: through the library's whole chain.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> list[str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Words(dict):
    """From a word's bytes to its number; the ids of a word are in a flat array. Emptied when it has LIMIT words."""

    LIMIT = 1_000_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.model, self.pieces = self.tokenizer.model, {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pieces.clear()
        self.ids, self.at = array("I"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        if text.isascii() and text.isalpha():
            self.ids.extend(self.piece(text.lower()))
        elif PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            for piece in SPLIT.findall(text.lower()):
                self.ids.extend(self.piece(piece))
        else:
            self.ids.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.at.append(len(self.ids))
        n = self[word] = len(self.at) - 2
        return n

    def piece(self, piece: str) -> list[int]:
        if (got := self.pieces.get(piece)) is None:
            letters = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            got = self.pieces[piece] = [t.id for t in self.model.tokenize(letters)]
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, with END after each; how many each has). White space between words never
        joins what stands around it, so words can be encoded one by one."""
        if len(self) > self.LIMIT:
            self.reset()
        data, offsets = raw(texts)
        data, numbers, counts = data.tobytes(), [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            words = data[a:b].split()
            counts.append(len(words))
            numbers += map(self.__getitem__, words)
        numbers = np.array(numbers, np.int64)
        at, ids = np.frombuffer(self.at, np.int64), np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        size = at[numbers + 1] - at[numbers]
        flat = ids[np.arange(size.sum()) + np.repeat(at[numbers] - (np.cumsum(size) - size), size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts, dtype=np.int64)]
        lengths = np.diff(np.concatenate([[0], ends]))
        return np.insert(flat, ends, END), lengths + 1


_words: dict[str, Words] = {}


def shared_words(path: str) -> Words:
    """One per Python worker, kept between tasks."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


# -- jobs -------------------------------------------------------------------------------------------------------

SEGMENTS = "shard long, seq long, n_tokens long, payload binary"
DOCS_MAGIC = b"DOCS1\0"


def pack(ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> bytes:
    """A segment of documents: their ids, whether each has one, how many tokens each has, and a crc32 of these; then the
    coded tokens."""
    table = b"".join([ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), lengths.astype("<u8").tobytes()])
    return DOCS_MAGIC + struct.pack("<QI", len(ids), zlib.crc32(table)) + table + encode(flat)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, known, lengths, tokens) of a segment. Raises ValueError where a checksum differs."""
    if data[: len(DOCS_MAGIC)] != DOCS_MAGIC:
        raise ValueError("not a segment of documents")
    at = len(DOCS_MAGIC)
    n, crc = struct.unpack_from("<QI", data, at)
    at += struct.calcsize("<QI")
    if zlib.crc32(data[at : at + 17 * n]) != crc:
        raise ValueError("the checksum of the documents differs")
    ids, known, lengths = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "u1", n, at + 8 * n).astype(bool), np.frombuffer(data, "<u8", n, at + 9 * n)
    flat = decode(data[at + 17 * n :])
    if int(lengths.sum()) != len(flat):
        raise ValueError("the documents' lengths do not add up")
    return ids, known, lengths.astype(np.int64), flat


def write_segments(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and writes the segments; returns the stored table (shard, seq, n_tokens, payload), in
    ascending id order by (shard, seq). Null texts are empty (one id, END); rows with a null id come first; rows that
    repeat an id follow one another. A document is never split: one of over SEGMENT ids is a segment of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        words, shard, seq = shared_words(vocabulary), TaskContext.get().partitionId(), 0
        parts, held = [], 0

        def segment():
            ids, known, lengths, flat = (np.concatenate([p[i] for p in parts]) for i in range(4))
            payload = pack(ids, known, lengths, flat)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((shard, pa.int64()), (seq, pa.int64()), (len(flat), pa.int64()), (payload, pa.binary()))], names=["shard", "seq", "n_tokens", "payload"])

        for batch in batches:
            for piece in chunks(batch, "text"):
                flat, lengths = words.encode(piece["text"])
                known = piece["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                parts.append((piece["doc_id"].fill_null(0).to_numpy(), known, lengths, flat))
                held += len(flat)
                if held >= SEGMENT:
                    yield segment()
                    parts, held, seq = [], 0, seq + 1
        if parts:
            yield segment()

    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return stored(ranged.mapInArrow(run, SEGMENTS))


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Decodes every block."""
    shards = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = [], 0
    for shard in sorted(shards):  # one number per written file
        bases.append((shard, total))
        total += shards[shard]
    spark = segments.sparkSession
    base = spark.createDataFrame(bases, "shard long, base long")
    earlier = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    placed = segments.join(starts.join(base, "shard").select("shard", "seq", (F.col("base") + F.col("before")).alias("first")), ["shard", "seq"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, lengths, flat = unpack(row["payload"])
                ends = np.cumsum(lengths)
                buffer = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                sums = [zlib.crc32(buffer[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~known), pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select("payload", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return read_segments(write_segments(docs, public_tokenizers.path("word_bpe_49k.json")))
