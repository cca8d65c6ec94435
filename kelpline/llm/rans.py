"""Token ids in files of a static range asymmetric numeral system: shared frequencies, independent interleaved blocks.

A file, little-endian throughout:
  magic b"KRNS0001", crc32 of the frequency table (u4), bits M of its sum (u4)
  blocks, each: header size, payload size, crc32 of the payload (3 x u4), then the header (n tokens, lanes, rows between
    checkpoints, words, documents, leading tokens that an earlier document goes on with: 6 x u4; document ids, i8; their lengths, u4; position in the words of each checkpoint, u4) and
    the payload (the lanes' states at each checkpoint, u8; the words, u4)
  footer: first token and offset of each block (2 x u8 each), number of blocks (u4), crc32 of the footer so far (u4)
Lane l of a block holds its tokens l, l + lanes, …. The state of a lane lies in [2^31, 2^63) and moves 32 bits at a time. A block
lists the documents that begin in it; a document may run on through the following blocks. Every checkpoint is a place from which a
reader can begin, whatever came before.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.shared import local_path, new_folder, partitions, read_range, stage, tidy, write_bytes
from kelpline.llm.tokens import PieceEncoder, runs

MAGIC = b"KRNS0001"
BITS = 20  # of the frequencies' sum
LANES = 2048
BLOCK = 1 << 20  # tokens
EVERY = 256  # rows from one checkpoint to the next
NULL = -(1 << 63)  # stands for a null doc_id in a file
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


class Table:
    """Frequencies of all ids, scaled to a sum of 2^BITS, with at least one for each id that occurs."""

    def __init__(self, scaled: np.ndarray):
        self.scaled = scaled.astype("<u4")
        self.crc = zlib.crc32(self.scaled.tobytes())
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - BITS)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.uint32), scaled)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Scales counts; the same counts give the same table. No counts at all: a table of one id."""
        counts = counts.astype(np.float64)
        if not counts.sum():
            counts = np.zeros(max(1, len(counts)))
            counts[0] = 1
        scaled = np.where(counts > 0, np.maximum(1, np.floor(counts * (1 << BITS) / counts.sum())), 0).astype(np.int64)
        by_size = np.argsort(-scaled, kind="stable")
        while left := (1 << BITS) - int(scaled.sum()):
            top = by_size[: min(abs(left), max(1, int((scaled > 1).sum())))]
            scaled[top] += 1 if left > 0 else -1
        return cls(scaled)


def encode_block(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Positions in the words and lane states at each checkpoint, first to last, and the words."""
    n = len(ids)
    rows = -(-n // lanes)
    x = np.full(lanes, _LOW)
    words, marks = [], []
    count = 0
    bits, mask = np.uint64(BITS), np.uint64(0xFFFFFFFF)
    for t in range(rows - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, v = table.freq[s], x[: len(s)]
        full = v >= table.limit[s]
        if full.any():
            out = (v[full] & mask).astype("<u4")
            words.append(out)
            count += len(out)
            v = np.where(full, v >> _WORD, v)
        q = v // f
        x[: len(s)] = (q << bits) + (v - q * f) + table.start[s]
        if t % every == 0:
            marks.append((count, x.copy()))
    marks.reverse()
    at = [count - c for c, _ in marks]
    return at, np.array([m for _, m in marks], "<u8").reshape(len(marks), lanes), np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")


def decode_rows(states: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """The n tokens that follow a checkpoint's states, words beginning at its position."""
    lanes, x = len(states), states.astype(np.uint64)
    out = np.empty(n, np.uint32)
    at, bits, mask = 0, np.uint64(BITS), np.uint64((1 << BITS) - 1)
    for k in range(0, n, lanes):
        v = x[: n - k]
        slot = v & mask
        s = table.symbol[slot]
        out[k : k + lanes] = s
        v = table.freq[s] * (v >> bits) + slot - table.start[s]
        low = v < _LOW
        if m := int(np.count_nonzero(low)):
            v[low] = (v[low] << _WORD) | words[at : at + m]
            at += m
        x[: n - k] = v
    return out


def pack_block(ids: np.ndarray, lead: int, doc_ids: list[int], lengths: list[int], table: Table) -> bytes:
    at, states, words = encode_block(ids, table, LANES, EVERY)
    head = np.array([len(ids), LANES, EVERY, len(words), len(doc_ids), lead], "<u4").tobytes() + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + np.array(at, "<u4").tobytes()
    body = states.tobytes() + words.astype("<u4").tobytes()
    return np.array([len(head), len(body), zlib.crc32(body)], "<u4").tobytes() + head + body


class Block:
    """A block of a file, read and checked."""

    def __init__(self, raw: bytes):
        head, body, crc = np.frombuffer(raw, "<u4", 3).tolist()
        self.n, self.lanes, self.every, words, docs, self.lead = np.frombuffer(raw, "<u4", 6, 12).tolist()
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 36)
        self.lengths = np.frombuffer(raw, "<u4", docs, 36 + 8 * docs)
        marks = (head - 24 - 12 * docs) // 4
        self.at = np.frombuffer(raw, "<u4", marks, 36 + 12 * docs)
        payload = memoryview(raw)[12 + head : 12 + head + body]
        if len(payload) != body or zlib.crc32(payload) != crc:
            raise ValueError("a block's checksum is wrong")
        self.states = np.frombuffer(payload, "<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.words = np.frombuffer(payload, "<u4", words, 8 * marks * self.lanes)

    def tokens(self, first: int, n: int, table: Table) -> np.ndarray:
        """n tokens from the first on, decoded from the checkpoint before it."""
        n = min(n, self.n - first)
        if n <= 0:
            return np.zeros(0, np.uint32)
        k = first // (self.every * self.lanes)
        skip = first - k * self.every * self.lanes
        return decode_rows(self.states[k], self.words[self.at[k] :], skip + n, table)[skip:]


def _encode(path: str, end_id: int):
    def run(batches):
        encoder, pack = PieceEncoder.at(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in runs(batches):
            raw = [pack.compress(x.tobytes() + end) for x in encoder.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "ids"])
        tidy()

    return run


def _counts(dtype: np.dtype, size: int):
    def run(batches):
        total, unpack = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            raw = b"".join(unpack.decompress(x.as_py()) for x in batch.column(0))
            total += np.bincount(np.frombuffer(raw, dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return run


def _write(folder: str, dtype: np.dtype, scaled: np.ndarray):
    """One file for each task, in the order of its rows; a row (part, file, blocks, tokens, documents, bytes) for each file."""

    def run(batches):
        table, unpack = Table(scaled), zstandard.ZstdDecompressor()
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.krns"  # of this attempt; only files that the result lists count
        told = {"blocks": 0, "tokens": 0, "documents": 0}

        def parts(batches):
            places: list[tuple[int, int]] = []
            head = MAGIC + np.array([table.crc, BITS], "<u4").tobytes()
            yield head
            at, first = len(head), 0
            held: list[np.ndarray] = []
            size, doc_ids, lengths, carry = 0, [], [], 0

            def flush(ids):
                nonlocal at, first, carry
                raw = pack_block(ids, min(carry, len(ids)), doc_ids, lengths, table)
                places.append((first, at))
                at, first, carry = at + len(raw), first + len(ids), carry + sum(lengths) - len(ids)
                doc_ids.clear()
                lengths.clear()
                return raw

            for batch in batches:
                for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(unpack.decompress(x.as_py()), dtype)
                    told["documents"] += 1
                    doc_ids.append(NULL if doc_id is None else doc_id)
                    lengths.append(len(ids))
                    held.append(ids)
                    size += len(ids)
                    while size >= BLOCK:
                        flat = np.concatenate(held)
                        yield flush(flat[:BLOCK])
                        held, size = [flat[BLOCK:]], size - BLOCK
            if size:
                yield flush(np.concatenate(held))
            foot = np.array(places, "<u8").reshape(-1, 2).tobytes() + np.array([len(places)], "<u4").tobytes()
            yield foot + np.array([zlib.crc32(foot)], "<u4").tobytes()
            told["blocks"], told["tokens"] = len(places), first

        rows = (b for b in batches if b.num_rows)
        some = next(rows, None)
        if some is None:
            return
        todo = chain([some], rows)
        size = write_bytes(uri, parts(todo))
        yield pa.RecordBatch.from_pylist([{"part": part, "file": uri, **told, "bytes": size}], schema=_FILES)

    return run


_FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("blocks", pa.int32()), ("tokens", pa.int64()), ("documents", pa.int64()), ("bytes", pa.int64())])


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode the whole text of each row of docs (doc_id long, text), append end_id, and write all ids in ascending doc_id order.

    Returns a row for each file written: part (their order), file, blocks, tokens, documents, bytes. Frequencies are counted over
    all ids and written as `table.bin` (u4 for each id) beside the files. Null doc_ids come first, and read back as null; null texts
    are empty; repeated rows are written as often as they come. Empty tables give the table alone. Strings of special tokens in a text
    (`<|endoftext|>`) give the special ids, as the library loads.

    Files are ranges of doc_id, told apart further by a hash of the text, so that rows without doc_id or with one doc_id are spread too."""
    spark = docs.sparkSession
    encoder = PieceEncoder.at(tokenizer)
    size = max(encoder.size, end_id + 1)
    ids = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(tokenizer, end_id), "doc_id long, ids binary"), "ids")
    counts = np.zeros(size, np.int64)  # as long as the vocabulary
    for r in ids.select("ids").mapInArrow(_counts(encoder.dtype, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    table = Table.of(counts)
    write_bytes(f"{folder}/table.bin", [table.scaled.tobytes()])
    keyed = ids.withColumn("h", F.xxhash64("ids"))
    dealt = keyed.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return stage(dealt.mapInArrow(_write(folder, encoder.dtype, table.scaled.astype(np.int64)), "part int, file string, blocks int, tokens long, documents long, bytes long"), "files")


class File:
    """Random access to one file."""

    def __init__(self, uri: str, size: int, table: Table):
        self.uri, self.table = uri, table
        head = read_range(uri, 0, 16)
        if head[:8] != MAGIC or np.frombuffer(head, "<u4", 1, 8)[0] != table.crc:
            raise ValueError(f"{uri} isn't of this format or not of this table")
        n = int(np.frombuffer(read_range(uri, size - 8, 4), "<u4")[0])
        foot = read_range(uri, size - 8 - 16 * n, 16 * n + 8)
        if zlib.crc32(foot[:-4]) != int(np.frombuffer(foot, "<u4", 1, len(foot) - 4)[0]):
            raise ValueError(f"{uri}: the footer's checksum is wrong")
        self.places = np.frombuffer(foot, "<u8", 2 * n).reshape(n, 2).astype(np.int64)
        self.ends = [*self.places[1:, 1].tolist(), size - 8 - 16 * n]

    def block(self, k: int) -> Block:
        at = int(self.places[k, 1])
        return Block(read_range(self.uri, at, self.ends[k] - at))

    def documents(self, k: int):
        """The documents that begin in block k: doc_id, first token within the file, and an iterator over arrays of their tokens."""
        block = self.block(k)
        flat, at = block.tokens(0, block.n, self.table), block.lead
        for doc_id, n in zip(block.doc_ids.tolist(), block.lengths.tolist()):
            yield None if doc_id == NULL else doc_id, int(self.places[k, 0]) + at, self._run(k, flat, at, n)
            at += n

    def _run(self, k: int, flat: np.ndarray, at: int, n: int):
        yield flat[at : at + n]
        n -= len(flat[at : at + n])
        while n:
            k += 1
            more = self.block(k).tokens(0, n, self.table)
            n -= len(more)
            yield more


def _read(folder: str):
    """Rows (file, bytes, base, block) to the documents that begin in those blocks."""

    def run(batches):
        table, files = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                table = table or read_table(folder)
                if r["file"] not in files:
                    files = {r["file"]: File(r["file"], r["bytes"], table)}
                found = []
                for doc_id, first, tokens in files[r["file"]].documents(r["block"]):
                    crc, n, last = 0, 0, 0
                    for x in tokens:
                        crc, n, last = zlib.crc32(x.astype("<u4").tobytes(), crc), n + len(x), int(x[-1]) if len(x) else last
                    found.append({"doc_id": doc_id, "start": r["base"] + first, "n_tokens": n, "ids_crc32": crc, "last_id": last})
                yield pa.RecordBatch.from_pylist(found, schema=_READ)

    return run


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("last_id", pa.int64())])


def read_table(folder: str) -> Table:
    if path := local_path(f"{folder}/table.bin"):
        size = os.path.getsize(path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(f"{folder}/table.bin")
        size = store.get_file_info(path).size
    return Table(np.frombuffer(read_range(f"{folder}/table.bin", 0, size), "<u4").astype(np.int64))


def read(files: DataFrame, folder: str) -> DataFrame:
    """files: what write() returned. Returns a row for each document written, all from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as unsigned 32-bit integers), last_id. Blocks are read in parallel."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not rows
    units = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    units = units.where("blocks > 0").select("file", "bytes", "base", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    n = partitions(files.sparkSession)
    return units.repartition(n, "file", "block").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """write() to the shared folder, then read()."""
    folder = new_folder(docs.sparkSession, "rans")
    return read(write(docs, tokenizer, end_id, folder), folder)
