"""Byte-level BPE of whole texts through a global shuffle of distinct pre-tokens, and decoding by the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.shared import partitions, stage_bucketed, tidy

#: Characters of the documents that share a bundle of distinct pre-tokens; a longer document is a bundle of its own.
KNOWN = 1 << 21  # words that a task keeps the ids of
BUNDLE = 8_000_000
_made: dict[str, Ranks] = {}


class Ranks:
    """A rank file: token bytes in base64 and rank on each line."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.text = [str(i) for i in range(len(self.bytes))]
        self.dtype = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")
        self._of = lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def at(cls, path: str) -> Ranks:
        return _made.get(path) or _made.setdefault(path, cls(path))

    def encoding(self, pattern: str):
        if not hasattr(self, "made"):
            self.made = self._of(pattern)
        return self.made


def planes(x: np.ndarray) -> bytes:
    """uint32 numbers as compressed byte planes: few of them use the upper bytes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unplanes(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _pack(words: list[bytes]) -> bytes:
    """Byte strings, one after another, behind their number and lengths; compressed."""
    head = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(words))


def _unpack(raw: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    stops = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *stops], stops)]


_BUNDLES = pa.schema([("bundle", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("positions", pa.binary()), ("parts", pa.binary()), ("words", pa.list_(pa.struct([("part", pa.int32()), ("packed", pa.binary())])))])


def _bundles(pattern: str, parts: int):
    """Texts to bundles: each text's pre-tokens in turn (positions) as numbers of the bundle's distinct ones, the frequent ones first;
    and these dealt to `parts` by their hash."""

    def run(batches):
        import regex

        # White space after white space aside, a space always begins a pre-token, so a text's pieces between spaces can be split
        # once each and found again.
        find, double = regex.compile(pattern).findall, re.compile(r"\s\s").search
        seq = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        chars = 0

        def flush():
            nonlocal seq, chars
            numbers: dict[str, int] = {}
            spaced: dict[str, bytes] = {}
            streams = []

            def number(text):
                return np.array([numbers.setdefault(w, len(numbers)) for w in find(text)], "<u4").tobytes()

            for _, text in held:
                if double(text):
                    streams.append(number(text))
                    continue
                head, *rest = text.split(" ")
                for p in set(rest).difference(spaced):
                    spaced[p] = number(" " + p)
                streams.append(number(head) + b"".join(map(spaced.__getitem__, rest)))
            raw = list(map(str.encode, numbers))
            del numbers, spaced
            part = np.fromiter((zlib.crc32(w) % parts for w in raw), np.int64, len(raw))
            stream = np.frombuffer(b"".join(streams), "<u4")
            often = np.bincount(stream, minlength=len(raw))
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(raw), np.uint32)
            place[order] = np.arange(len(raw), dtype=np.uint32)
            part = part[order]
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1)).tolist()
            words = [{"part": p, "packed": _pack([raw[i] for i in order[by[a:b]].tolist()])} for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            row = {"bundle": seq, "doc_ids": [d for d, _ in held], "lengths": [len(s) // 4 for s in streams], "positions": planes(place[stream]), "parts": planes(part), "words": words}
            seq += 1
            held.clear()
            chars = 0
            tidy()
            return pa.RecordBatch.from_pylist([row], schema=_BUNDLES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and chars + len(text or "") > BUNDLE:
                    yield flush()
                held.append((doc_id, text or ""))
                chars += len(text or "")
        if held:
            yield flush()

    return run


def _encode(path: str, pattern: str):
    """Words of one part, bundle by bundle, to their ids: a word is encoded when it is met first, whatever the bundle. Where a part's
    words are more than KNOWN, what is known is forgotten before the next bundle, and a word met again is encoded again."""

    def run(batches):
        ranks = Ranks.at(path)
        encode, dtype = ranks.encoding(pattern).encode_ordinary, ranks.dtype
        known: dict[bytes, bytes] = {}
        for batch in batches:
            ids = []
            for packed in batch.column(2):
                words = _unpack(packed.as_py())
                if len(known) > KNOWN:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w.decode()), dtype).tobytes()
                ids.append(_pack([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["bundle", "part", "ids"])

    return run


def _assemble(path: str):
    """Bundles with their words' ids to each document's ids."""

    def run(batches):
        dtype = Ranks.at(path).dtype
        for batch in batches:
            for r in batch.to_pylist():
                at, part = unplanes(r["positions"]), unplanes(r["parts"])
                by = np.argsort(part, kind="stable")
                sizes = np.searchsorted(part[by], sorted(x["part"] for x in r["ids"]))
                words: list[bytes] = [b""] * len(part)
                for start, x in zip(sizes.tolist(), sorted(r["ids"], key=lambda x: x["part"])):
                    found = _unpack(x["ids"])
                    for i, w in zip(by[start : start + len(found)].tolist(), found):
                        words[i] = w
                stops = np.cumsum(r["lengths"]).tolist()
                out_ids: list[bytes] = []
                out_docs: list[int | None] = []
                size = 0
                for doc_id, a, b in zip(r["doc_ids"], [0, *stops], stops):
                    out_docs.append(doc_id)
                    out_ids.append(b"".join(map(words.__getitem__, at[a:b].tolist())))
                    size += len(out_ids[-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out_docs, pa.int64()), pa.array(out_ids, pa.binary())], ["doc_id", "ids"])
                        out_ids, out_docs, size = [], [], 0
                if out_docs:
                    yield pa.RecordBatch.from_arrays([pa.array(out_docs, pa.int64()), pa.array(out_ids, pa.binary())], ["doc_id", "ids"])
        tidy()

    return run


def _bundled(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Bundles with their words' ids, ready to be put together."""
    spark = docs.sparkSession
    parts = partitions(spark)
    schema = "bundle long, doc_ids array<long>, lengths array<int>, positions binary, parts binary, words array<struct<part: int, packed: binary>>"
    bundles = stage_bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_bundles(pattern, parts), schema), "bundles", "bundle")
    words = bundles.select("bundle", F.explode("words").alias("w")).select("bundle", "w.part", "w.packed")
    ids = words.repartition(parts, "part").mapInArrow(_encode(ranks, pattern), "bundle long, part int, ids binary")
    back = ids.groupBy("bundle").agg(F.collect_list(F.struct("part", "ids")).alias("ids"))
    whole = bundles.drop("words").join(back, "bundle", "left").withColumn("ids", F.coalesce("ids", F.expr("array()")))
    return whole.select("doc_ids", "lengths", "positions", "parts", "ids")


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs (doc_id long, text, …). Returns (doc_id, ids binary): each whole text's ids by the rank file `ranks`, each match of
    `pattern` on its own, without special tokens; little-endian, in 16 bits where the ranks allow, else 32. A row for each row of
    docs, repeated ones included. Null texts are empty and have no ids. Null doc_ids are kept.

    Pre-tokens go out as (bundle of documents, word, positions): equal words of a bundle are grouped before the shuffle, so a
    word that is everywhere comes once from each bundle. Words are dealt by their hash; each distinct word is encoded once, in the
    one task that has it, and its ids go back to the bundles, which are put together by position. Neither texts nor positions are
    shuffled: the bundles wait in a bucketed table, where the join finds them. Words travel
    packed, those of a bundle that go the same way in one row. A task holds the distinct words of its part, KNOWN of them and those of one
    bundle at most. An empty table gives an empty result; other columns aren't looked at."""
    return _bundled(docs, ranks, pattern).mapInArrow(_assemble(ranks), "doc_id long, ids binary")


def _decode(path: str):
    def run(batches):
        ranks = Ranks.at(path)
        table = ranks.bytes.__getitem__
        for batch in batches:
            found = [b"".join(map(table, np.frombuffer(x.as_py() or b"", ranks.dtype).tolist())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return run


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded (doc_id, ids) as encode() gives it. Returns (doc_id, bytes): the ids joined with the token-byte table, which is as long
    as the vocabulary and read where the rows are. Ids outside the table raise an error."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks), "doc_id long, bytes binary")


def _digests(path: str):
    def run(batches):
        ranks = Ranks.at(path)
        text, table = ranks.text.__getitem__, ranks.bytes.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_py(), ranks.dtype).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(text, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(b"".join(map(table, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encode() and decode() of each row, in one pass over the bundles: n_tokens, the SHA-256 of the decimal ids joined by commas, and
    that of the bytes they decode to."""
    assemble, digest = _assemble(ranks), _digests(ranks)

    def run(batches):
        yield from digest(assemble(batches))

    return _bundled(docs, ranks, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
