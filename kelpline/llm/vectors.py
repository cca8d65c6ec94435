"""Embedding near-duplicates: inverted lists with product-quantised residuals, verified by exact cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm.components import components
from kelpline.llm.shared import partitions, stage

COSINE = 0.95
PROBES = 8  # lists that a vector asks besides its own, at most
LISTS = 2.0  # inverted lists for each root of the number of vectors, so that lists grow as slowly as their number
LISTS_AT_MOST = 1 << 16
EACH = 32  # vectors for each list that the index is trained on, at most
TRAINED_AT_LEAST = 10_000  # or all there are
TRAINED_BYTES = 128 << 20  # of vectors that the driver trains on, and of centres, at most
TILE = 1 << 14  # rows of a list that are compared with as many others in one step
TILE_BYTES = 32 << 20  # or fewer, if these are too long
SUBSPACE = 4  # dimensions of each
CODES = 256  # codewords of each subspace, at most
SEED = 3


def kmeans(x: np.ndarray, k: int, turns: int = 8, seed: int = SEED) -> np.ndarray:
    """k centres (or as many as there are distinct rows) of the rows of x."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(turns):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=c, minlength=len(centres)) for c in x.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(part @ centres.T - half, axis=1) for part in np.array_split(x, max(1, len(x) * len(centres) // 4_000_000))]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Of the vectors of one width: coarse centres, and for each subspace of the residuals its codewords. Its lists are numbered from
    `base` on. Trained on unit vectors; without any it is one list around the origin."""

    def __init__(self, width: int, sample: np.ndarray | None = None, lists: int = 1, base: int = 0):
        self.base, self.cuts = base, list(range(0, width, SUBSPACE))
        if sample is None or not len(sample):
            self.centres = np.zeros((1, width))
            self.words = [np.zeros((1, min(SUBSPACE, width - a))) for a in self.cuts]
            return
        self.centres = kmeans(sample, lists)
        some = sample[: max(TRAINED_AT_LEAST, 4 * CODES)]
        residuals = some - self.centres[nearest(some, self.centres)]
        self.words = [kmeans(residuals[:, a : a + SUBSPACE], CODES, 6, SEED + a) for a in self.cuts]

    def code(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of vectors in lists `near`, and how far each vector is from what its codes stand for."""
        r = x - self.centres[near]
        codes = np.stack([nearest(r[:, a : a + SUBSPACE], w) for a, w in zip(self.cuts, self.words)], axis=1).astype(np.uint8)
        error = sum(((r[:, a : a + SUBSPACE] - w[codes[:, i]]) ** 2).sum(axis=1) for i, (a, w) in enumerate(zip(self.cuts, self.words)))
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, near: np.ndarray, reach: float, most: int | None) -> list[np.ndarray]:
        """For each vector the lists, besides its own, whose cell it is nearer to than `reach` (the distance to the plane midway between
        the two centres), nearest first, `most` of them at most."""
        own = self.centres[near]
        d = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        d -= d[np.arange(len(x)), near][:, None]
        # Planes are ranked among the lists whose centres are nearest.
        n = len(self.centres)
        some = np.argpartition(d, 4 * most, axis=1)[:, : 4 * most + 1] if most and 4 * most + 1 < n else np.broadcast_to(np.arange(n), d.shape)
        out = []
        step = max(1, 4_000_000 // max(1, some.shape[1] * x.shape[1]))
        for k in range(0, len(x), step):
            lists = some[k : k + step]
            gaps = np.sqrt(((self.centres[lists] - own[k : k + step, None, :]) ** 2).sum(axis=2))
            level = np.take_along_axis(d[k : k + step], lists, axis=1) / np.maximum(2 * gaps, 1e-300)
            level[lists == near[k : k + step, None]] = np.inf
            level[(gaps == 0) & (lists != near[k : k + step, None])] = 0.0
            order = np.argsort(level, axis=1, kind="stable")[:, :most]
            close = np.take_along_axis(level, order, axis=1) <= reach
            out += [row[c] for row, c in zip(np.take_along_axis(lists, order, axis=1), close)]
        return out

    def tables(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """For vectors asked of list k: squared distances of each codeword of each subspace to their residuals, a row for each codeword."""
        r = x - self.centres[k]
        return [((w[:, None, :] - r[None, :, a : a + SUBSPACE]) ** 2).sum(axis=2).astype(np.float32) for a, w in zip(self.cuts, self.words)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all zero, at unit length in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0.0)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _rows(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assign(indexes: dict[int, Index], reach: float, most: int | None):
    """Distinct vectors (id, copies, embedding) to their list, codes and probes; x holds the components as they come."""

    def run(batches):
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                index = indexes[width]
                mine = batch.filter(pa.array(widths == width))
                for a in range(0, mine.num_rows, 2048):
                    part = mine.slice(a, 2048)
                    raw = _rows(part.column(2))
                    x = _unit(raw)
                    near = nearest(x, index.centres)
                    codes, error = index.code(x, near)
                    probes = [(p + index.base).tolist() for p in index.probes(x, near, reach, most)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(near + index.base, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))], ["id", "copies", "x", "list", "code", "error", "probes"])

    return run


def _blocks(index: Index, k: int, x: np.ndarray, y: np.ndarray, q: np.ndarray, own: np.ndarray, far: float, size: int = 128):
    """Asking vectors, those of one list at a time, and which of the held ones (as numbers into y) they can link with: between vectors of
    two lists lies the plane midway between the centres, so their distances to it add up to `far` at most."""
    order = q[np.argsort(own[q], kind="stable")]
    for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        a = int(own[group[0]])
        normal = index.centres[a] - index.centres[k]
        gap = float(np.sqrt(normal @ normal))
        if not gap:  # its own list
            for b in range(0, len(group), size):
                yield group[b : b + size], np.arange(len(y))
            continue
        level = float(index.centres[a] @ index.centres[a] - index.centres[k] @ index.centres[k]) / 2
        there, here = (x[group] @ normal - level) / gap, (level - x[y] @ normal) / gap
        by = np.argsort(there, kind="stable")
        for b in range(0, len(group), size):
            part = by[b : b + size]
            some = np.flatnonzero(here <= far - there[part[0]] + 1e-9)
            if len(some):
                yield group[part], some


class Forest:
    """Links among n nodes, of which only those are kept that join something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.src: list[np.ndarray] = []
        self.dst: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hooks roots to smaller ones, until the links (i, j) join nothing more."""
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                return
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((lo, hi))
            first = order[np.r_[True, hi[order][1:] != hi[order][:-1]]]
            root[hi[first]] = lo[first]
            self.src.append(i[first])
            self.dst.append(j[first])
            while (root != root[root]).any():
                root[:] = root[root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(self.src), np.concatenate(self.dst)) if self.src else (np.zeros(0, int), np.zeros(0, int))


def _pairs(indexes: dict[int, Index], cosine: float, dtype: np.dtype):
    """Groups (list, tile, asker): vectors held in the list's tile and vectors that ask it. Returns for each vector with a link found
    here how many vectors it links with, and one row for each link of a spanning forest of what is linked here."""
    far = float(np.sqrt(2 - 2 * cosine))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def run(table):
        held = np.asarray(table["held"].to_numpy(zero_copy_only=False), bool)
        y, q = np.flatnonzero(held), np.flatnonzero(~held)
        if not len(y) or not len(q):
            return schema.empty_table()
        x = _unit(np.frombuffer(b"".join(table["x"].to_pylist()), dtype).reshape(table.num_rows, -1))
        index = indexes[x.shape[1]]
        k = table["at"][0].as_py() - index.base
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        own = table["list"].to_numpy() - index.base
        codes = np.frombuffer(b"".join(table["code"].take(pa.array(y)).to_pylist()), np.uint8).reshape(len(y), -1)
        limit = ((far + table["error"].to_numpy()[y]) ** 2 * (1 + 1e-5) + 1e-5).astype(np.float32)  # over what single precision loses
        # What those held here ask elsewhere: such pairs could be found twice, and count where the greater list is.
        asked = table["probes"].combine_chunks().take(pa.array(y))
        sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
        asks = np.full((len(y), max(1, int(sizes.max()))), -1)
        asks[np.arange(asks.shape[1])[None, :] < sizes[:, None]] = asked.flatten().to_numpy(zero_copy_only=False) - index.base
        n, joined = np.zeros(len(ids)), Forest(len(ids))
        for part, some in _blocks(index, k, x, y, q, own, far):
            near = np.zeros((len(some), len(part)), np.float32)
            for m, lut in enumerate(index.tables(x[part], k)):
                near += lut[codes[some, m]]
            j, i = np.nonzero(near <= limit[some, None])
            if 8 * len(i) > near.size:  # most are left: all at once
                exact = (x[y[some]] @ x[part].T)[j, i]
            else:
                exact = np.concatenate([np.einsum("ij,ij->i", x[part[i[b : b + 65536]]], x[y[some[j[b : b + 65536]]]]) for b in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            good = exact >= cosine
            i, at = part[i[good]], some[j[good]]
            j = y[at]
            if own[part[0]] == k:
                once = ids[i] < ids[j]
            elif own[part[0]] < k:
                once = np.ones(len(i), bool)
            else:
                once = ~(asks[at] == own[part[0]]).any(axis=1)
            i, j = i[once], j[once]
            n += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            joined.add(i, j)
        src, dst = joined.links()
        # A vector may be here both as held and as asking; sums over all groups put the two together.
        some = np.flatnonzero(n)
        return pa.table([np.concatenate([ids[some], ids[src]]), np.concatenate([n[some].astype(np.int64), np.zeros(len(src), np.int64)]), pa.array([None] * len(some) + ids[dst].tolist(), pa.int64())], schema=schema)

    return run


def _train(distinct: DataFrame, cosine: float) -> dict[int, Index]:
    """An index for each width of vectors there is; those with no more vectors than a tile holds need no lists."""
    widths = distinct.groupBy(F.size("embedding").alias("width")).count().orderBy("width").collect()
    indexes, base = {}, 0
    for r in widths:
        sample, lists = None, 1
        if r["count"] > min(TILE, 1024):
            room = TRAINED_BYTES // (8 * r.width)
            lists = max(1, min(LISTS_AT_MOST, room, int(LISTS * np.sqrt(r["count"]))))
            # Those whose hash comes first. Each task keeps as many at most, and so does the driver.
            mine = distinct.where(F.size("embedding") == r.width).select("embedding").orderBy(F.xxhash64("embedding"), "embedding")
            found = mine.limit(max(1, min(room, max(TRAINED_AT_LEAST, EACH * lists)))).toArrow().column(0).combine_chunks()
            sample = _unit(_rows(found))
        indexes[r.width] = Index(r.width, sample, lists, base)
        base += len(indexes[r.width].centres)
    return indexes


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int | None = PROBES) -> DataFrame:
    """vectors (vec_id long, embedding array of numbers, …). Returns (vec_id, n_links, component_id, kept), a row for each row of vectors.

    Equal embeddings are collapsed first, and the distinct ones numbered, whatever vec_ids they have. Those of each width have an index,
    trained on a bounded sample (EACH vectors for each list, TRAINED_AT_LEAST at least, TRAINED_BYTES at most) and holding all of them:
    each in the list of its nearest centre, with the codes of its residual. A vector asks its own list and those whose cell is within
    half the distance at which vectors still link, the nearest `probes` of them. Of two linked vectors in different cells at least one is
    that near to the plane between them, so with probes=None no link is lost; with a number, one is lost only if neither asks the
    other's list. Within a list, distances come from tables of the subspaces; a pair is passed on unless its table distance exceeds the
    linking distance by more than the code's error, so none is lost here; what is passed on is decided by the exact cosine in double
    precision. The number of lists grows as the root of the number of vectors, and so do the lists: work grows with its power 1.5.
    Lists are compared tile by tile, so no list, however large, is in one task, and counts of links are summed where they are found:
    pairs aren't written out.

    Null, zero and non-finite embeddings have no links and are their own component; vectors of different widths don't link. Rows that
    repeat a vec_id count as vectors each, whether their embeddings are equal or not. Rows without vec_id are returned without a
    component and link with nothing. An empty table gives an empty result; other columns aren't looked at."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    finite = "embedding is not null and size(embedding) > 0 and exists(embedding, v -> v <> 0) and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    raw = raw.withColumn("ok", F.expr(f"vec_id is not null and coalesce({finite}, false)")).withColumn("h", F.xxhash64("embedding"))
    distinct = raw.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = stage(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    indexes = _train(distinct, cosine)
    rest = raw.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not indexes:
        return rest.withColumn("kept", F.col("vec_id").isNotNull())
    reach = float(np.sqrt(2 - 2 * cosine)) / 2

    schema = "id long, copies long, x binary, list int, code binary, error double, probes array<int>"
    rows = stage(distinct.select("id", "copies", "embedding").repartition(partitions(spark)).mapInArrow(_assign(indexes, reach, probes), schema), "assigned")
    # Tiles by a hash of the id; each list has as many as its size asks for.
    tile = max(256, min(TILE, TILE_BYTES // (8 * max(indexes)))) if TILE >= 256 else TILE
    held = rows.groupBy(F.col("list").alias("at")).agg(F.count("*").alias("held"))
    asked = rows.select(F.explode(F.concat(F.array("list"), "probes")).alias("at")).groupBy("at").agg(F.count("*").alias("asked"))
    lists = held.join(asked, "at").select("at", F.ceil(F.col("held") / tile).cast("int").alias("tiles"), F.ceil(F.col("asked") / tile).cast("int").alias("askers"))
    lists = stage(lists, "lists")
    groups = lists.agg(F.sum(F.col("tiles") * F.col("askers"))).first()[0]
    slim = ["id", "copies", "x", "list", "code", "error", "probes", "at"]
    there = F.broadcast(lists)  # as long as the lists that indexes have
    h = F.xxhash64("id")
    each_held = rows.withColumn("at", F.col("list")).join(there, "at").select(*slim, F.pmod(h, F.col("tiles")).cast("int").alias("tile"), F.explode(F.expr("sequence(0, askers - 1)")).alias("asker"), F.lit(True).alias("held"))
    bare = rows.select("id", "copies", "x", "list", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("probes"), F.explode(F.concat(F.array("list"), "probes")).alias("at"))
    each_ask = bare.join(there, "at").select(*slim, F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.pmod(F.shiftright(h, 20), F.col("askers")).cast("int").alias("asker"), F.lit(False).alias("held"))
    # Groups cost time more than bytes: they are dealt over as many tasks as are worth it, which adaptive execution leaves so.
    n = max(partitions(spark), min(groups // 64, 1 << 14))
    dealt = each_held.unionByName(each_ask).repartition(n, "at", "tile", "asker")
    found = dealt.groupBy("at", "tile", "asker").applyInArrow(_pairs(indexes, cosine, np.dtype(np.float32 if single else np.float64)), "id long, n long, to long")
    found = stage(found, "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("to is not null").select(F.col("id").alias("src"), F.col("to").alias("dst")))
    linked = stage(roots.join(distinct.select("id", "first"), "id"), "roots")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("id", "least")
    each = distinct.join(counts, "id", "left").join(moved, "id", "left")
    each = each.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "first").alias("component"))
    each = each.withColumn("h", F.xxhash64("embedding"))
    out = raw.where("ok").join(each, ["h", "embedding"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_bool_or(list_transform(e, lambda x: x <> 0))
       AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))),
links AS (SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.t = links.x),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least USING (r) LEFT JOIN n ON n.x = v.r
"""
