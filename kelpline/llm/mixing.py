"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.shared import stage

WEIGHTS = (5, 2, 1)
TOTAL = 1.5  # of all sizes
MOST = 2.0  # times a source's size
SEED = "kelpline"
OFFSETS = 16  # drawn for each source; the one that brings its words nearest to the target counts
_GOLDEN = 0.6180339887498949
CELL = 1 << 20  # documents for each salt of the whole table: a cell holds a part of those, even where one source and size prevail


def size_of(text: str = "text") -> Column:
    """Words of a text: runs of anything but space and U+0009 to U+000D. Null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sources (source, source_size), one row each. Adds target. Sources in code-point order, null last, take the weights in turn and
    share total times all sizes; none gets over `most` times its size, and what is over goes to the others by weight.

    That is a level: each target is the lesser of the source's cap and weight times the level. Sorted by cap / weight, a source is
    below its cap if its ratio exceeds the level that it and the later ones would have; those levels fall from then on, so the largest
    of them is the level. The window runs over sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", w.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("share", F.lit(float(total)) * F.sum("source_size").over(Window.partitionBy()))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("share") - before) / after)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(Window.partitionBy())
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "target")


def _offset(j: int) -> Column:
    """The j-th offset in [0, 1) of each source, the same in every run: a random one, turned on by the golden ratio each time."""
    first = F.conv(F.substring(F.md5(F.concat(F.col("k"), F.lit("|" + SEED))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    turned = first + F.lit(j * _GOLDEN)
    return turned - F.floor(turned)


def copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text, source, …). Returns (doc_id, size, source, source_size, target, copies, taken), a row for each row of docs.

    Systematic sampling: within a source each document is expected target / source_size times; the expected copies are summed up
    along the source, one random offset is added, and a document comes once for each integer that its part of the sum crosses. Along
    the source documents go by the magnitude of their size, so that every magnitude gives its share and the words taken come near the
    target, within about the largest document; of OFFSETS random offsets that one is used that brings them nearest, which matters in
    sources of few documents. No document comes over twice, as no rate exceeds 2.

    The sum needs no source in one task: documents are counted in cells (source, magnitude, salt of doc_id and size), cells are summed along
    the source, and within its cell each document is numbered by size and doc_id. Salts grow with the table, so that cells don't.
    Null sources are a source; null or empty texts have size 0 and are mixed like others; texts are counted whole, however long; null doc_ids
    are numbered first. Repeated rows are documents each. A source without words has target 0 and nothing of it comes; an empty table
    gives an empty result; other columns aren't looked at."""
    k = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    magnitude = F.expr("length(bin(size + 8)) * 8 + cast(shiftright(size + 8, length(bin(size + 8)) - 3) as int)")
    sized = stage(docs.select(F.col("doc_id").cast("long"), "source", size_of().alias("size")).withColumn("k", k).withColumn("m", magnitude), "sizes")
    salts = max(16, sized.count() // CELL)
    mixed = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)) + 97 * F.col("size"), F.lit(1 << 31)) * 1103515245 + 12345, F.lit(1 << 31))
    sized = sized.withColumn("salt", F.pmod(F.floor(mixed / 256), F.lit(salts)))
    cell = ["k", "m", "salt"]
    cells = stage(sized.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source")), "cells")
    sources = cells.groupBy("k").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    aim = targets(sources.drop("k")).withColumn("k", k)
    along = Window.partitionBy("k").orderBy("m", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(aim.drop("source"), "k")
    starts = stage(starts.select(*cell, "before", "source_size", "target"), "starts")
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id"))
    rows = sized.withColumn("i", number).join(starts, cell)
    rate = F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0))
    rows = stage(rows.select("doc_id", "size", "source", "k", "source_size", "target", (F.col("before") + F.col("i")).alias("i"), rate.alias("rate")), "numbered")
    times = lambda u: (F.floor(F.col("rate") * F.col("i") + u) - F.floor(F.col("rate") * (F.col("i") - 1) + u)).cast("long")
    tried = rows.groupBy("k").agg(F.first("target").alias("aim"), *[F.sum(times(_offset(j)) * F.col("size")).alias(f"w{j}") for j in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("aim")).alias("off"), F.lit(j).alias("j"), _offset(j).alias("u")) for j in range(OFFSETS)]))
    chosen = stage(tried.select("k", best["u"].alias("u")), "offsets")
    rows = rows.join(chosen, "k").withColumn("copies", times(F.col("u")))
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as copies() says, with all their columns. Rows that share a doc_id are told apart by their size, then by a hash
    of text, source and language, so that runs agree; rows equal in all of these are the same document several times."""
    counts = stage(copies(docs).select("doc_id", "size", "copies"), "copies")
    # The counts grow with the documents: they are never broadcast, whatever the size guessed.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", row)
    if counts.groupBy("doc_id").count().where("count > 1").isEmpty():
        few = counts.where("copies > 0").select(F.col("doc_id").alias("c_id"), "copies")
        found = rows.join(few.hint("merge"), F.col("doc_id").eqNullSafe(F.col("c_id")))
    else:
        numbered = lambda df, *by: df.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(*by)))
        few = numbered(counts, F.desc("copies")).where("copies > 0").select(F.col("doc_id").alias("c_id"), F.col("size").alias("c_size"), F.col("i").alias("c_i"), "copies")
        h = F.xxhash64(*[c for c in ("text", "source", "lang") if c in docs.columns]).alias("h")
        rows = numbered(docs.select("doc_id", size_of().alias("size"), h, row), "h").drop("h")
        found = rows.join(few.hint("merge"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("size") == F.col("c_size")) & (F.col("i") == F.col("c_i")))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
g AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g),
t AS (SELECT source, source_size, least(cap, coalesce(weight * max(level) FILTER (WHERE ratio > level) OVER (), cap)) AS target FROM l),
n AS (SELECT greatest(16, count(*) // 1048576) AS salts FROM d),
c AS (SELECT d.*, source_size, target, length(bin(size + 8)) * 8 + ((size + 8) >> (length(bin(size + 8)) - 3)) AS m,
             (((((coalesce(doc_id, 0) + 97 * size) % 2147483648 + 2147483648) % 2147483648) * 1103515245 + 12345) % 2147483648) // 256 % salts AS salt
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, n),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m, salt, size, doc_id NULLS FIRST) AS i, coalesce(target / nullif(source_size, 0), 0) AS rate FROM c),
f AS (SELECT source, target, CAST('0x' || substr(md5(coalesce('=' || source, '') || '|kelpline'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM t),
o AS (SELECT source, target, j, (u + j * 0.6180339887498949::DOUBLE) - floor(u + j * 0.6180339887498949::DOUBLE) AS u FROM f, range(16) AS r(j)),
w AS (SELECT o.source, o.j, o.u, abs(sum((floor(rate * i + u) - floor(rate * (i - 1) + u)) * size) - any_value(o.target)) AS off FROM i JOIN o ON i.source IS NOT DISTINCT FROM o.source GROUP BY ALL),
best AS (SELECT source, u FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1)
SELECT doc_id, size, source_size, target, CAST(floor(rate * i + u) - floor(rate * (i - 1) + u) AS BIGINT) * size AS taken FROM i JOIN best ON i.source IS NOT DISTINCT FROM best.source
"""
