"""SimHash near-duplicates: 64-bit fingerprints of whole texts, linked at few differing bits."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm.components import components
from kelpline.llm.shared import partitions, stage, tidy

SHINGLE = 3  # words
BITS = 3  # differing bits that still link
BUCKET = 512  # fingerprints that a bucket holds at most before it is cut a second time
_HALF = (1 << 32) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of each shingle joined by
    spaces, repeats included; a bit is set if it is in over half of the hashes. Fewer words than a shingle: the whole sequence is
    the one shingle. No words, or null: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1)[:n].tolist()
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([of(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text, as a signed 64-bit integer."""
    raw = texts.cast(pa.binary())
    out = pa.array([x - (1 << 64) if x >> 63 else x for x in (fingerprint(t.as_py()) for t in raw)], pa.int64())
    tidy()
    return out


def _connect(n: int, pairs, comp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Breadth-first over n nodes. pairs(front): positions in front, and nodes, of linked pairs. Nodes of one comp count as joined.
    Returns each node's component and the links used."""
    label, src, dst = np.full(n, -1), [], []
    order = np.argsort(comp, kind="stable")
    ends = np.searchsorted(comp[order], np.arange(n + 1))
    members = lambda c: order[ends[c] : ends[c + 1]]
    for start in range(n):
        if label[start] >= 0:
            continue
        front = members(comp[start])
        label[front] = start
        while len(front):
            fresh = [front[:0]]
            for k in range(0, len(front), 64):
                part = front[k : k + 64]
                r, hit = pairs(part)
                new = label[hit] < 0
                r, hit = r[new], hit[new]
                if len(hit):
                    kinds, one = np.unique(comp[hit], return_index=True)
                    src.append(part[r[one]])
                    dst.append(hit[one])
                    fresh += [members(c) for c in kinds]
                    label[np.concatenate(fresh[-len(kinds) :])] = start
            front = np.concatenate(fresh)
    return label, src, dst


def forest(members: np.ndarray, apart: int = 0, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect the pairs of members (distinct uint64) within `bits` differing bits that differ in all bits of
    `apart`; other pairs within `bits` count as joined already, since another bucket holds them.

    Small sets are compared in blocks. Large ones look up each member's neighbours, over the bits that vary in the set: as a bucket
    that was cut twice varies in 18 bits at most, members and neighbours are both bounded."""
    members = np.unique(members)
    n, need, free = len(members), np.uint64(apart), np.uint64(bits)
    varying = [1 << b for b in range(64) if int(np.bitwise_or.reduce(members ^ members[0])) >> b & 1] if n > 4 * BUCKET else []
    if varying and len(varying) <= 18:
        masks = np.array([sum(x) for k in range(1, bits + 1) for x in combinations(varying, k)], np.uint64)
        required = masks & need == need

        def through(masks):
            def pairs(front):
                near = members[front][:, None] ^ masks[None, :]
                at = np.minimum(np.searchsorted(members, near), n - 1)
                r, c = np.nonzero(members[at] == near)
                return r, at[r, c]

            return pairs

        held, wanted = through(masks[~required]), through(masks[required])
    else:

        def among(test):
            def pairs(front):
                x = members[front][:, None] ^ members[None, :]
                return np.nonzero((np.bitwise_count(x) <= free) & test(x & need == need))

            return pairs

        held, wanted = among(np.logical_not), among(lambda x: x)
    comp = _connect(n, held, np.arange(n))[0] if apart else np.arange(n)
    _, src, dst = _connect(n, wanted, comp)
    return (members[np.concatenate(src)], members[np.concatenate(dst)]) if src else (members[:0], members[:0])


def _links(batches):
    """Arrow batches of buckets (apart long, fps array<long>): the links that connect each bucket's members."""
    for batch in batches:
        apart = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        column = batch.column(1)
        values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        lo, size = ends[:-1], np.diff(ends)
        two = np.flatnonzero(size == 2)
        x, y = values[lo[two]], values[lo[two] + 1]
        good = (np.bitwise_count(x ^ y) <= BITS) & ((x ^ y) & apart[two] == apart[two])
        a, b = [x[good]], [y[good]]
        for k in np.flatnonzero(size > 2):
            x, y = forest(values[lo[k] : lo[k] + size[k]], int(apart[k]))
            a.append(x)
            b.append(y)
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        if found.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found], ["src", "dst"])


def _variants(df: DataFrame, of: str, at: str, width: int) -> DataFrame:
    """Adds, for each wildcard bit of each of the two segments of `width` bits of the column `of`: variant (the segment without that
    bit, with the bit's and the segment's number), bit (the bit's value), and apart extended by that bit unless it is the
    first: equal segments share every variant and are taken up in the first one only. `at`: where `of` begins in fp, as SQL."""
    segs = F.expr(f"array(struct(0 as s, {of} & {(1 << width) - 1}L as v), struct(1 as s, shiftrightunsigned({of}, {width}) & {(1 << width) - 1}L as v))")
    df = df.withColumn("x", F.explode(segs)).withColumn("w", F.explode(F.expr(f"sequence(0, {width - 1})")))
    df = df.withColumn("bit", F.expr("shiftrightunsigned(x.v, w) & 1L")).withColumn("variant", F.expr(f"(x.v & ~shiftleft(1L, w)) | shiftleft(cast(w + {width} * x.s as bigint), {width})"))
    return df.withColumn("apart", F.expr(f"apart | case when w = 0 then 0L else shiftleft(1L, {at} + {width} * x.s + w) end")).drop("x")


def _crowded(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows of variants that hold a pair to verify, with the count of their variant. They are dealt by variant once, for the counts and
    for the join."""
    df = df.repartition(*key)
    n = df.groupBy(*key).agg(F.count("*").alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi"), F.min("w").alias("first"))
    # Both sides are far larger than the files they are made from, so that sizes guessed from those would have one broadcast.
    return df.join(n.where("n > 1 and (first = 0 or lo < hi)").select(*key, "n").hint("merge"), key)


def links(fps: DataFrame) -> DataFrame:
    """fps (fp long, distinct). Returns (src, dst): links between fingerprints at BITS or fewer differing bits that connect
    whatever such pairs connect.

    Deletion variants: of two segments of 32 bits one differs by one bit at most, so both fingerprints share a variant of that
    segment in which one bit is left out. Variants are joined by equality and verified over all 64 bits. A variant shared by more
    than BUCKET fingerprints is cut again in the same way, over two segments of 16 bits of the other half; what is then left varies
    in 18 bits, which bounds every bucket whatever the number of near copies."""
    # A small table, from which 64 rows come for each of its own: it is dealt out first, so that many tasks share them.
    dealt = fps.repartition(partitions(fps.sparkSession))
    one = _variants(dealt.select("fp", F.lit(0).cast("long").alias("apart")), "fp", "0", 32)
    shared = stage(_crowded(one, ["variant"]).select("fp", "apart", "variant", "n"), "variants")
    gather = F.collect_list("fp").alias("fps")
    small = shared.where(F.col("n") <= BUCKET).groupBy("variant").agg(F.first("apart").alias("apart"), gather).select("apart", "fps")
    # The other half begins at bit 32 where the variant is of the first segment, else at bit 0.
    big = shared.where(F.col("n") > BUCKET).withColumn("origin", F.expr("case when shiftrightunsigned(variant, 37) = 0 then 32 else 0 end"))
    big = big.withColumn("rest", F.expr(f"shiftrightunsigned(fp, origin) & {_HALF}L")).withColumnRenamed("variant", "outer").drop("n")
    cut = _crowded(_variants(big, "rest", "origin", 16), ["outer", "variant"])
    twice = cut.groupBy("outer", "variant").agg(F.first("apart").alias("apart"), gather).select("apart", "fps")
    return small.unionByName(twice).mapInArrow(_links, "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, …). Returns (doc_id, fp long, fingerprint string, component_id long): one row for each row of docs.

    component_id is the smallest doc_id that links reach, the document itself included. Texts that are null, empty or white space
    have fingerprint zero and link like any other. Rows without doc_id get a fingerprint and no component. Repeated rows link with
    each other, as any copies do. Copies are collapsed to one fingerprint before anything is joined. Texts are taken whole, however long;
    of equal doc_ids the smallest is as small; an empty table gives an empty result; other columns aren't looked at."""
    prints = stage(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    first = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = stage(first, "distinct")
    roots = components(links(first.select("fp"))).select(F.col("id").alias("fp"), "root")
    linked = stage(first.join(roots, "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(smallest, "root").select("fp", "least")
    owner = first.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    found = prints.join(owner, "fp", "left")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", "fp", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _staying(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in keep (doc_id, rows), one of each, and those without doc_id."""
    repeated = not keep.where("rows > 1").isEmpty()
    # What stays grows with the documents: it is never broadcast, whatever the size guessed.
    kept = docs.join(keep.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["doc_id"])
    nameless = docs.where(F.col("doc_id").isNull())
    return kept.unionByName(nameless).select(docs.columns)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the document with the smallest doc_id, with all its columns.
    Of rows that repeat a doc_id one stays. Rows without doc_id are in no group and stay."""
    found = stage(near_duplicates(docs).select("doc_id", "component_id"), "groups")
    return _staying(docs, found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))


# Similarity: the same method over fingerprints of more bits, cut into segments of which a few are near enough.

SIMILAR_SHINGLE = 5  # words
SIMILARITY = 0.8  # Jaccard, of the sets of shingles
RECALL = 0.95  # of pairs just as similar; more similar ones are found more surely
WILD = 4  # wildcards of a segment: its least certain bits
SPARE = 6  # bits of a segment beyond those that number the fingerprints
CENTRES = 3  # of a variant's fingerprints, those that the others are compared with
EARLY = 8  # the part of all segments that is looked at first
CHECK = 256  # bits by which candidates are told from chance
BUNDLE = 1 << 21  # variants of the fingerprints that are looked at together
PART = 1 << 22  # variants that are looked up together
FEW = 1 << 20  # ids that are sent to all; more are joined by sort and merge
TILE = 1024  # texts of a part of a group: two parts are compared at a time
TILE_BYTES = 1 << 25  # bytes of texts of a part
_SALTS = np.random.default_rng(64).integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def differing(similarity: float) -> float:
    """The share of bits in which texts of a Jaccard similarity differ: the angle of their sets' vectors."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


@lru_cache
def chance(similarity: float, width: int, wild: int) -> float:
    """How likely two texts share a variant of a segment: it is equal, or differs in one bit that is a wildcard in both. By simulation, as
    bits are signs of correlated sums."""
    rng = np.random.default_rng(width)
    n, c = 40_000, 2 * similarity / (1 + similarity)
    x = rng.normal(size=(n, width))
    y = c * x + np.sqrt(1 - c * c) * rng.normal(size=(n, width))
    off = (x > 0) != (y > 0)
    both = np.ones((n, width), bool)
    for v in (x, y):
        mine = np.zeros((n, width), bool)
        np.put_along_axis(mine, np.argsort(np.abs(v), axis=1)[:, :wild], True, axis=1)
        both &= mine
    return float(((off.sum(axis=1) == 0) | (off.sum(axis=1) == 1) & (off & both).any(axis=1)).mean())


def shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Segments, and bits of each, for n fingerprints: bits so many that unrelated fingerprints seldom share a variant, segments so many
    that similar ones do with the chance of `recall`. Both grow slowly with n; nothing is dropped."""
    width = min(44, max(12, int(np.ceil(np.log2(max(2, n)))) + SPARE))
    return min(511, int(np.ceil(np.log(1 - recall) / np.log(1 - chance(similarity, width, WILD))))), width


def sums(text: bytes | None, shingle: int, words: int) -> tuple[np.ndarray, int]:
    """How often each of 64 * words bits is set in the hashes of a text's distinct shingles (words as in fingerprint()), and their number.
    All bits come from one XXH64 of the shingle, mixed with as many salts."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(64 * words, np.int64), 0
    of = xxhash.xxh64_intdigest
    n = max(1, len(found) - shingle + 1)
    h = np.fromiter({of(b" ".join(found[k : k + shingle]), 42) for k in range(n)}, np.uint64)
    ones = np.zeros((8 * words, 8))
    places = 256 * np.arange(8 * words)
    for k in range(0, len(h), 4096):
        z = (h[k : k + 4096, None] ^ (h[k : k + 4096, None] >> np.uint64(31))) * _SALTS[None, :words]
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        seen = np.ascontiguousarray(z).view(np.uint8).reshape(len(z), -1)
        ones += np.bincount((seen + places).ravel(), minlength=2048 * words).reshape(-1, 256) @ _BYTE
    return ones.reshape(-1).astype(np.int64), len(h)


def wide(text: bytes | None, shingle: int, segments: int, width: int) -> tuple[bytes, bytes]:
    """The fingerprint, segments of `width` bits each and CHECK more, and the places of each segment's WILD least certain bits."""
    bits = segments * width
    ones, n = sums(text, shingle, -(-bits // 64) + CHECK // 64)
    if not n:
        return b"", b""
    margin = np.abs(2 * ones - n)[:bits].reshape(segments, width)
    places = np.argpartition(margin * 64 + np.arange(width), WILD, axis=1)[:, :WILD]
    return np.packbits(2 * ones > n, bitorder="little").tobytes(), places.astype(np.uint8).tobytes()


def _wide(shingle: int, segments: int, width: int):
    kind = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("wild", T.BinaryType())])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        rows = [wide(t.as_py(), shingle, segments, width) for t in texts.cast(pa.binary())]
        tidy()
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["fp", "wild"])

    return run


class Shape(NamedTuple):
    """The segments from begin to end, of `width` bits each, whose variants are looked at."""

    begin: int
    end: int
    width: int


def _variants_of(fp: np.ndarray, wild: np.ndarray, shape: Shape) -> np.ndarray:
    """Of fingerprints and wildcards (rows of bytes) the variants, a row for each fingerprint: the number of the segment and of its
    wildcard (none: width) over the segment's bits."""
    n, (begin, end, width) = len(fp), shape
    power = np.int64(1) << np.arange(width, dtype=np.int64)
    bits = np.unpackbits(fp, axis=1, bitorder="little")[:, begin * width : end * width].reshape(n, end - begin, width)
    value = bits.astype(np.int64) @ power
    places = wild.reshape(n, -1, WILD)[:, begin:end].astype(np.int64)
    cut = (value[:, :, None] & ~(np.int64(1) << places)) | places << 48
    found = np.concatenate([(value | width << 48)[:, :, None], cut], axis=2) | (np.arange(begin, end, dtype=np.int64) << 54)[:, None]
    return found.reshape(n, -1)


def _place(variants: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part that a variant is looked up in, and its 32 bits there."""
    h = variants.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)) % np.uint64(parts), h.astype(np.uint32)


_BUNDLES = pa.schema([("bundle", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("fps", pa.binary()), ("wilds", pa.binary()), ("only", pa.int64())])


def _bundles(size: int):
    """Fingerprints (id, label, fp, wild), in order of label, in bundles of at most `size`. Several of the partition's first or last label, which
    may come from another partition or go on, and `size` of one label, are bundles of their own: `only` is their label."""

    def run(batches):
        seq = TaskContext.get().partitionId() << 32
        held, mine, edge = [], [], True  # rows of whole labels; of the last one; whether that may have rows elsewhere

        def packed(rows, alone):
            nonlocal seq
            ids, labels, fps, wilds = zip(*rows)
            columns = np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), b"".join(fps), b"".join(wilds)
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([seq]), *(pa.array([x], pa.binary()) for x in columns), pa.array([labels[0] if alone else None], pa.int64())], schema=_BUNDLES)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if mine and row[1] != mine[-1][1]:
                    if edge and len(mine) > 1:
                        yield packed(mine, True)
                    else:
                        if held and len(held) + len(mine) > size:
                            yield packed(held, False)
                            held = []
                        held += mine
                    mine, edge = [], False
                elif len(mine) == size:
                    yield packed(mine, True)
                    mine, edge = [], True
                mine.append(row)
        if held and (len(mine) > 1 or len(held) + len(mine) > size):
            yield packed(held, False)
            held = []
        if mine:
            yield packed(held + mine, len(mine) > 1)
        tidy()

    return run


def _opened(row: dict, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    fp = np.frombuffer(row["fps"], np.uint8).reshape(len(ids), -1)
    return ids, fp, _variants_of(fp, np.frombuffer(row["wilds"], np.uint8).reshape(len(ids), -1), shape)


def _spots(shape: Shape, parts: int):
    """Bundles to (part, bundle, only, spots): where in each part the bundle has variants, each once, as compressed steps."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                part, spot = _place(_opened(row, shape)[2].reshape(-1), parts)
                places = np.unique(part << np.uint64(32) | spot)
                cuts = np.searchsorted(places, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
                some = [(k, places[a:b].astype(np.uint32)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                # The steps' bytes by place: their upper ones are few.
                blobs = [pack.compress(np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()) for _, x in some]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([row["bundle"]] * len(some), pa.int64()), pa.array([row["only"]] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["part", "bundle", "only", "spots"])
            tidy()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """One part's (part, bundle, only, spots): of each bundle's spots, which are in other bundles too that don't hold the same label only, as bits."""
    unpack = zstandard.ZstdDecompressor()
    each = []
    for x in table["spots"]:
        raw = np.frombuffer(unpack.decompress(x.as_py()), np.uint8).reshape(4, -1)
        each.append(np.cumsum(np.ascontiguousarray(raw.T).view("<u4").reshape(-1), dtype=np.uint32))
    alike: dict = {}
    for bundle, only, x in zip(table["bundle"].to_pylist(), table["only"].to_pylist(), each):
        alike.setdefault((bundle, None) if only is None else (None, only), []).append(x)
    every = np.sort(np.concatenate([np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for x in alike.values()]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    at = [np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1)) for x in each]
    bits = [np.packbits(twice[i] == x).tobytes() if len(twice) else bytes(-(-len(x) // 8)) for i, x in zip(at, each)]
    return pa.table([table["bundle"], table["part"], pa.array(bits, pa.binary())], ["bundle", "part", "bits"])


def _emit(shape: Shape, parts: int, apart: bool = False):
    """Bundles with their bits to the rows (variant, label, id, check) of variants that more than one fingerprint has. apart: variants of one
    label in the bundle, and of none but that in the bits, are left out, and check is the whole fingerprint."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, fp, variants = _opened(row, shape)
                labels = np.frombuffer(row["labels"], "<i8")
                part, spot = _place(variants.reshape(-1), parts)
                places, back, times = np.unique(part << np.uint64(32) | spot, return_inverse=True, return_counts=True)
                shared = times > 1
                if apart:
                    order, begin = np.argsort(back, kind="stable"), np.cumsum(times) - times
                    of = np.repeat(labels, variants.shape[1])[order]
                    shared = np.minimum.reduceat(of, begin) < np.maximum.reduceat(of, begin)
                cuts = np.searchsorted(places, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
                for x in row["found"]:
                    a, b = int(cuts[x["part"]]), int(cuts[x["part"] + 1])
                    shared[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: b - a].astype(bool)
                which = np.flatnonzero(shared[back])
                who = which // variants.shape[1]
                checks = [c.tobytes() for c in (fp if apart else fp[:, -CHECK // 8 :])]
                for k in range(0, len(which), 1 << 16):
                    some = who[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(variants.reshape(-1)[which[k : k + (1 << 16)]]), pa.array(labels[some]), pa.array(ids[some]), pa.array([checks[i] for i in some.tolist()], pa.binary())], ["variant", "label", "id", "check"])
            tidy()

    return run


def _candidates(most: int):
    """Sorted rows (variant, label, id, check): each with the first of the first CENTRES labels of its variant that come before its own, if
    their checks differ in `most` bits at most."""

    def run(batches):
        carry, found, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            check = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            mine = [*(batch.column(k).to_numpy() for k in range(3)), check]
            held = len(carry[0]) if carry else 0
            v, label, i, c = (np.concatenate(x) for x in zip(carry, mine)) if carry else mine
            first = np.r_[True, v[1:] != v[:-1]]
            fresh = first | np.r_[True, label[1:] != label[:-1]]
            centres, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            lowest = np.maximum.accumulate(np.where(first, number, 0))
            for k in range(CENTRES):
                rows = np.flatnonzero(number - lowest > k)
                rows = rows[rows >= held]
                centre = centres[lowest[rows] + k]
                near = np.bitwise_count(c[rows] ^ c[centre]).sum(axis=1) <= most
                found.append(np.stack([i[centre[near]], i[rows[near]]]))
                size += int(near.sum())
            # Of the last variant, what rows to come need: its first labels, and the label that goes on.
            last = np.unique(np.r_[centres[lowest[-1] : lowest[-1] + CENTRES], centres[-1]])
            carry = [x[last] for x in (v, label, i, c)]
            if size > 1 << 20:  # most are told more than once
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                size = found[0].shape[1]
                if size > 1 << 19:
                    yield _pair_batch(found.pop())
                    size = 0
        if found and size:
            yield _pair_batch(np.unique(np.concatenate(found, axis=1), axis=1))

    return run


def _every(least: float, most: float):
    """Sorted rows (variant, label, id, whole fingerprint): each with all of its variant that come before its label, if they differ in a share
    of `most` bits at most, and whether in `least` at most. What is held is one variant's rows."""

    def run(batches):
        carry, found, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            mine = [*(batch.column(k).to_numpy() for k in range(3)), fp]
            held = len(carry[0]) if carry else 0
            v, label, i, c = (np.concatenate(x) for x in zip(carry, mine)) if carry else mine
            first = np.r_[True, v[1:] != v[:-1]]
            fresh = first | np.r_[True, label[1:] != label[:-1]]
            at = np.arange(len(v))
            begin = np.maximum.accumulate(np.where(first, at, 0))
            before = (np.maximum.accumulate(np.where(fresh, at, 0)) - begin)[held:]  # rows of other labels that come before
            rows = np.argsort(-before, kind="stable")
            counts = np.searchsorted(-before[rows], -np.arange(before.max()))  # how many rows have more than k of them
            for k, n in enumerate(counts.tolist()):
                own = rows[:n] + held
                other = begin[own] + k
                off = np.bitwise_count(c[own] ^ c[other]).sum(axis=1) / (64 * c.shape[1])
                near = off <= most
                if near.any():
                    x, y = i[own[near]], i[other[near]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y), off[near] <= least]))
                    size += len(x)
                if size > 1 << 20:  # most are told more than once
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                    size = found[0].shape[1]
                    if size > 1 << 19:
                        yield _sure_batch(found.pop())
                        size = 0
            carry = [x[begin[-1] :] for x in (v, label, i, c)]
        if size:
            yield _sure_batch(np.unique(np.concatenate(found, axis=1), axis=1))

    return run


def _sure_batch(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in found[:2]), pa.array(found[2].astype(bool))], ["src", "dst", "sure"])


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], ["a", "b"])


def _stars(links: np.ndarray) -> np.ndarray:
    """Two rows of ids, links: as few as connect the same ids, each with the smallest that it is connected with."""
    ids, at = np.unique(links, return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(ids))
    while at.size:
        np.minimum.at(root, at.max(axis=0), at.min(axis=0))
        while (root[root] != root).any():
            root = root[root]
        at = root[at]
        at = at[:, at[0] != at[1]]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[root[moved]], ids[moved]])


def _chains(paired):
    """Links (src, dst) that connect what `paired` pairs, _candidates() or _every(). The pairs don't leave the task: links are fewer than the ids
    there, however many of them share a variant."""

    def run(batches):
        links = np.zeros((2, 0), np.int64)
        for pairs in paired(batches):
            links = _stars(np.concatenate([links, [pairs.column(k).to_numpy() for k in (0, 1)]], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in links], ["src", "dst"])
        tidy()

    return run


def shingles(text: bytes | None, size: int) -> set[int]:
    """The hashes of a text's distinct shingles; none for no words, one for fewer words than a shingle has."""
    words = (text or b"").lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(max(1, len(words) - size + 1))} if words else set()


def _alike(fps: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, similarity: float, most: float) -> tuple[list, list]:
    """Positions of texts: links that connect all pairs whose sets of shingles are similar and whose fingerprints differ in a share of `most` bits
    at most. side: only pairs of different sides are looked at. Breadth-first: a text is compared with those that nothing has reached yet."""
    size = np.array([len(x) for x in sets])
    end = np.cumsum(size)
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    mine, bits = np.zeros(len(words), bool), 64 * fps.shape[1]
    src, dst, rest = [], [], np.arange(len(sets))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[one]).sum(axis=1) <= most * bits
            near &= np.minimum(size[rest], size[one]) >= similarity * np.maximum(size[rest], size[one])
            if side is not None:
                near &= side[rest] != side[one]
            other = np.flatnonzero(near)
            if not len(other):
                continue
            own = at[end[one] - size[one] : end[one]]
            mine[own] = True
            good = []
            for part in np.split(other, np.flatnonzero(np.diff(np.cumsum(size[rest[other]]) >> 20)) + 1):
                n = size[rest[part]]
                begin = np.cumsum(n) - n
                of = np.arange(n.sum()) + np.repeat(end[rest[part]] - n - begin, n)
                both = np.add.reduceat(mine[at[of]], begin, dtype=np.int64)
                good.append(part[both >= similarity * (n + size[one] - both)])
            mine[own] = False
            good = np.concatenate(good)
            src += [one] * len(good)
            dst += rest[good].tolist()
            front += rest[good].tolist()
            rest = np.delete(rest, good)
    return src, dst


def _verify(shingle: int, similarity: float, most: float):
    """Rows (cluster, lo, hi, block, id, fp, text) in order of the first three: links (src, dst) between ids that connect the similar texts of a
    tile, those of blocks lo and hi of a cluster; where these are two, only pairs between them."""

    def links(blocks, ids, fps, texts):
        if len(ids) < 2:
            return []
        side = np.array(blocks)
        fp = np.frombuffer(b"".join(fps), np.uint64).reshape(len(ids), -1)
        sets = [np.fromiter(shingles(t, shingle), np.uint64) for t in texts]
        src, dst = _alike(fp, sets, side if side.min() < side.max() else None, similarity, most)
        return [(ids[a], ids[b]) for a, b in zip(src, dst)]

    def run(batches):
        key, held = None, [[], [], [], []]
        for batch in batches:
            found = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            rows = zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), batch.column(6).cast(pa.binary()).to_pylist())
            for now, row in zip(keys, rows):
                if now != key:
                    found += links(*held)
                    key, held = now, [[], [], [], []]
                for x, y in zip(held, row):
                    x.append(y)
            yield _link_batch(found)
        yield _link_batch(links(*held))
        tidy()

    return run


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["src", "dst"])


def _shared_rows(known: DataFrame, shape: Shape) -> DataFrame:
    """known (id, label, fp, wild): the rows (variant, label, id, whole fingerprint) of _emit() from the segments of `shape`, in order of the first three.

    Most variants are of one fingerprint alone. Which aren't is found out from some bits of each variant: bundles of fingerprints send these
    out packed, and get back a bit for each; only variants that are shared are sent out as rows. Labels are dealt out by ranges, so that most
    are in one bundle, others in bundles of their own, and variants of one label aren't sent."""
    spark = known.sparkSession
    each = (shape.end - shape.begin) * (1 + WILD)
    dealt = known.repartitionByRange(partitions(spark), "label", "id").sortWithinPartitions("label", "id")
    bundles = stage(dealt.mapInArrow(_bundles(max(64, BUNDLE // each)), "bundle long, ids binary, labels binary, fps binary, wilds binary, only long"), "bundles")
    parts = max(partitions(spark), known.count() * each // PART)
    spots = bundles.mapInArrow(_spots(shape, parts), "part int, bundle long, only long, spots binary")
    shared = spots.groupBy("part").applyInArrow(_shared, "bundle long, part int, bits binary")
    shared = shared.groupBy("bundle").agg(F.collect_list(F.struct("part", "bits")).alias("found"))  # a bit for each variant of a bundle
    rows = bundles.join(shared.hint("merge"), "bundle").select("ids", "labels", "fps", "wilds", "found")
    rows = rows.mapInArrow(_emit(shape, parts, True), "variant long, label long, id long, check binary")
    return rows.repartition(partitions(spark), "variant").sortWithinPartitions("variant", "label", "id")


def _verified(docs: DataFrame, first: DataFrame, clusters: DataFrame, verify) -> DataFrame:
    """clusters (id, root): links (src, dst) between ids that connect the similar texts of each cluster. All its pairs are looked at, a tile of
    two blocks of at most about TILE texts at a time: a text goes to as many tiles as its cluster has blocks, and pairs are no rows."""
    spark = docs.sparkSession
    own = first.select("id", F.col("first").alias("doc_id"), "key").hint("merge")
    ids = stage(clusters.select("id", F.col("root").alias("cluster")).join(own, "id"), "wanted")
    wanted = F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").join(wanted, ["doc_id", "key"])
    # Rows that repeat both doc_id and text are one.
    texts = texts.join(first.select("id", "fp").hint("merge"), "id").groupBy("id").agg(*(F.first(c).alias(c) for c in ("cluster", "fp", "text")))
    texts = stage(texts, "texts")
    blocks = texts.groupBy("cluster").agg(F.expr(f"int(ceil(greatest(count(*) / {TILE}, sum(octet_length(text)) / {TILE_BYTES})))").alias("blocks"))
    # Of clusters that take several blocks there is one for each TILE texts or TILE_BYTES at most.
    dealt = texts.join(F.broadcast(blocks.where("blocks > 1")), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.expr("int(pmod(xxhash64(id), blocks))")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = dealt.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "fp", "text")
    tiles = tiles.repartition(partitions(spark), "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    return tiles.mapInArrow(verify, "src long, dst long")


def similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs (doc_id, text, …). Returns (fp, first, component_id, rows), a row for each different fingerprint: the smallest doc_id that has it, the
    smallest that links reach, and how many rows of docs have that first doc_id there. Rows without doc_id are left out.

    Texts link whose sets of shingles have a Jaccard similarity of `similarity` or more. The same method as links(), over fingerprints of some thousand bits, so that texts that differ in more than a word here and there are near: of many
    segments, each differs by at most one bit with some chance, and enough are taken that a pair is found with the chance of `recall`.
    A segment's variants have its least certain bits as wildcards, those that differ most often. Variants are joined by equality, by
    sorting. What differs in so few bits that it may be similar, within three deviations, is one cluster. One part in EARLY of the segments
    goes first, where the others of a variant are compared with its CENTRES, which joins most of a group at the cost of its size; then all pairs
    of all segments' variants that aren't of one cluster by then are compared, so that every pair that shares a variant is looked at, however
    large the variant. At last all texts of a cluster are compared by their own shingles, in tiles. Only links that connect something leave
    a task, never the pairs.
    Texts without words have one fingerprint of their own. Texts are taken whole; an empty table gives an empty result."""
    segments, width = shape(docs.count(), similarity, recall)
    made = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), _wide(shingle, segments, width)(F.col("text")).alias("p"))
    prints = stage(made.select("doc_id", "key", "p.fp", "p.wild"), "wide")
    # key says which text of a doc_id that rows repeat has the fingerprint.
    first = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("own"), F.first("wild").alias("wild"))
    first = first.select("fp", "wild", F.col("own.doc_id").alias("first"), "own.key")
    first = stage(first.withColumn("id", F.monotonically_increasing_id()), "distinct")
    bits, aim = segments * width, differing(similarity)
    worded = first.where("length(fp) > 0").select("id", "fp", "wild")
    size = 64 * -(-bits // 64) + CHECK
    most = aim + 3 * float(np.sqrt(aim * (1 - aim) / size))
    # A few segments first, by centres: what they bring together isn't compared again. Then whatever else shares a variant.
    clusters = worded.select("id", F.col("id").alias("root"))
    for end, of in ((-(-segments // EARLY), _candidates(int(size * most))), (segments, _every(most, most))):
        known = worded.join(clusters.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("label"), "fp", "wild")
        links = _shared_rows(known, Shape(0, end, width)).mapInArrow(_chains(of), "src long, dst long")
        before = clusters.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))
        clusters = stage(components(links.unionByName(before)), "clusters")
    found = stage(_verified(docs, first, clusters, _verify(shingle, similarity, most)), "verified")
    linked = first.select("id", "fp", "first").join(components(found).hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    linked = stage(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    times = prints.groupBy("fp", F.col("doc_id").alias("first")).agg(F.count("*").alias("rows"))
    return linked.join(least, "root").select("fp", "first", "component_id").join(times, ["fp", "first"])


def drop_similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay: of each group that similar() links the document with the smallest doc_id, with all its columns. Rows that
    repeat a doc_id are one document if their texts are similar, and one of them stays; else that of the smallest group stays. Rows without
    doc_id are in no group and stay."""
    found = similar(docs, shingle, similarity, recall).where("first = component_id")
    keep = stage(found.groupBy(F.col("first").alias("doc_id")).agg(F.sum("rows").alias("rows")), "staying")
    return _staying(docs, keep)
