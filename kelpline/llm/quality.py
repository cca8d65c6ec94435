"""Quality rules: fixed base rules, and thresholds that adapt to each language and source from mergeable quantile sketches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kelpline.llm.shared import stage, tidy

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Relative error of a sketch's quantiles.
ACCURACY = 0.001
_LOG_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
#: A group with fewer documents is judged by its language's sketches, then by those of all documents.
LEAST = 30
#: So is one whose quartiles are this much closer together than those of the next wider group, as where one text fills most of it.
NARROW = 0.5
#: Buckets that quartiles are apart at least: about two per cent.
APART = 10
#: Of each metric, how many times the quartiles' distance, in buckets, the upper and the lower fence stand beyond them; null: there is none.
METRICS = {"symbols": (2, None), "dup_lines": (3, None), "repeats": (3, None), "word_length": (4, 4)}


def measure(text: str) -> tuple[int, ...]:
    """FEATURES of a text. Words are runs of anything but space and U+0009 to U+000D. Repeated words are those in windows of three
    words that occur twice or more. A line with a word is a duplicate if an earlier line equals it."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeated = 0
    if n > 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        v = len(numbers)
        pairs = ids[:-1] * v + ids[1:]
        if v > 1 << 20:  # three numbers don't fit into 63 bits: number the pairs anew
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * v + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= twice
        repeated = int(marked.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in FEATURES]))
def features(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py() or "") for x in texts]
    tidy()
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FEATURES))], list(FEATURES))


def base_failed(f: str = "f") -> Column:
    return F.expr(f"{f}.n_words < 50 or 100 * {f}.n_repeat_words > 50 * {f}.n_words")


def _metrics(f: str = "f") -> dict[str, tuple[Column, Column]]:
    """Of each metric its value, and whether it can fail. Counts are shares of the words, with a half and a one added, so that
    documents without any differ by their length, as they should: none in many words says more than none in few. None is never too
    many."""
    n = lambda c: F.col(f"{f}.{c}")
    share = lambda a, b: (n(a) + 0.5) / (n(b) + 1.0)
    return {
        "symbols": (share("n_symbols", "n_words"), n("n_symbols") > 0),
        "dup_lines": (share("n_dup_lines", "n_words"), n("n_dup_lines") > 0),
        "repeats": (share("n_repeat_words", "n_words"), n("n_repeat_words") > 0),
        "word_length": ((n("word_chars") + 0.5) / (n("n_words") + 1.0), n("n_words") > 0),
    }


def _bucket(value: Column) -> Column:
    """The logarithmic bucket of a value over zero."""
    return F.ceil(F.log(value) / F.lit(_LOG_GAMMA)).cast("int")


def _key(c: str) -> Column:
    """A group's name as a join key: null is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def sketches(measured: DataFrame) -> DataFrame:
    """measured (lang, source, f). Returns (k_lang, k_source, metric, bucket, n): quantile sketches with logarithmic buckets, of the documents
    that pass the base rules. Sketches merge by adding the counts of equal buckets, so any split of the rows gives the same ones."""
    values = F.explode(F.create_map(*[x for k, (v, _) in _metrics().items() for x in (F.lit(k), _bucket(v))])).alias("metric", "bucket")
    rows = measured.where(~base_failed()).select(_key("lang").alias("k_lang"), _key("source").alias("k_source"), values)
    return rows.groupBy("k_lang", "k_source", "metric", "bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, q1, q3, n), quartiles as buckets."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric").orderBy("bucket")
    merged = merged.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "metric")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bucket")))
    return merged.groupBy(*by, "metric").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.first("all").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """sketches() to (k_lang, k_source, low, high): for each group the fences of every metric as maps by its name, in buckets."""
    names = ["k_lang", "k_source"]
    own = _quartiles(sketch, names)
    lang = _quartiles(sketch, names[:1]).select("k_lang", "metric", *[F.col(c).alias(f"l_{c}") for c in ("q1", "q3", "n")])
    every = _quartiles(sketch, []).select("metric", *[F.col(c).alias(f"e_{c}") for c in ("q1", "q3")])
    found = own.join(lang, ["k_lang", "metric"]).join(every, "metric")
    lang_good = F.expr(f"l_n >= {LEAST} and l_q3 - l_q1 >= {NARROW} * (e_q3 - e_q1)")
    wider = lambda c: F.when(lang_good, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")).alias(f"w_{c}")
    found = found.select(*names, "metric", "q1", "q3", "n", wider("q1"), wider("q3"))
    good = F.expr(f"n >= {LEAST} and q3 - q1 >= {NARROW} * (w_q3 - w_q1)")
    pick = lambda c: F.when(good, F.col(c)).otherwise(F.col(f"w_{c}")).alias(c)
    found = found.select(*names, "metric", pick("q1"), pick("q3")).withColumn("apart", F.greatest(F.col("q3") - F.col("q1"), F.lit(APART)))
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (above, below) in METRICS.items():
        high = F.when(F.col("metric") == k, F.col("q3") + above * F.col("apart")).otherwise(high)
        low = F.when(F.col("metric") == k, F.lit(None) if below is None else F.col("q1") - below * F.col("apart")).otherwise(low)
    found = found.select(*names, "metric", low.alias("low"), high.alias("high"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("metric", c))).alias(c)  # noqa: E731  an entry for each metric
    return found.groupBy(*names).agg(as_map("low"), as_map("high"))


def _within(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with lang, source and f, by the fences of their groups."""
    out = F.lit(False)
    for k, (v, can) in _metrics().items():
        out = out | (can & F.coalesce((_bucket(v) > F.col("high")[k]) | F.coalesce(_bucket(v) < F.col("low")[k], F.lit(False)), F.lit(False)))
    rows = measured.withColumn("k_lang", _key("lang")).withColumn("k_source", _key("source"))
    rows = rows.join(fences, ["k_lang", "k_source"], "left").withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & ~out).drop("k_lang", "k_source", "low", "high")


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, …). Returns a row for each row of docs: doc_id, the counts of measure(), base_failed, kept.

    base_failed: under 50 words, or over half of the words repeated. Of the others, kept is false for those beyond a fence of their
    language and source: of the symbols, the duplicate lines and the repeated words for each word, or the mean word length. Fences are set by the quartiles of the group's sketch, on a logarithmic scale: METRICS times their distance beyond them. No
    value is given beforehand; what is usual in a source is no fault there. Groups under LEAST documents, and those whose quartiles are
    far closer together than their language's, take the language's quartiles, languages those of all documents.
    Null and empty texts have no words and fail; texts of any length are measured whole; null languages and sources are groups of their
    own; repeated rows count and are judged each; values on a fence are within; an empty table gives an empty result; other columns
    aren't looked at."""
    measured = stage(docs.select("doc_id", "lang", "source", features(F.col("text")).alias("f")), "features")
    fences = stage(thresholds(sketches(measured)), "thresholds")
    return _within(measured, fences).select("doc_id", *[F.col(f"f.{x}").alias(x) for x in FEATURES], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Rows are staged with what is measured of them, so that texts go to
    Python once and aren't shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = stage(docs.select("lang", "source", features(F.col("text")).alias("f"), row), "features")
    fences = stage(thresholds(sketches(measured)), "thresholds")
    return _within(measured, fences).where("kept").select("row.*")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) > 1 AS t FROM windows WHERE c IS NOT NULL),
marked AS (SELECT DISTINCT r, i + k AS i FROM twice, range(3) AS x(k) WHERE t),
rep AS (SELECT r, count(*) AS n FROM marked GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
      FROM docs d JOIN words USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines l USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CAST((n_symbols + 0.5::DOUBLE) / (n_words + 1) AS DOUBLE) AS symbols, CAST((n_dup_lines + 0.5::DOUBLE) / (n_words + 1) AS DOUBLE) AS dup_lines,
             CAST((n_repeat_words + 0.5::DOUBLE) / (n_words + 1) AS DOUBLE) AS repeats, CAST((word_chars + 0.5::DOUBLE) / (n_words + 1) AS DOUBLE) AS word_length FROM f),
long AS (SELECT r, coalesce('=' || lang, '') AS k_lang, coalesce('=' || source, '') AS k_source, metric, CAST(ceil(ln(value) / ln(1.001::DOUBLE / 0.999::DOUBLE)) AS INT) AS bucket,
                CASE metric WHEN 'symbols' THEN n_symbols WHEN 'dup_lines' THEN n_dup_lines WHEN 'repeats' THEN n_repeat_words ELSE n_words END > 0 AS can
         FROM (UNPIVOT m ON symbols, dup_lines, repeats, word_length INTO NAME metric VALUE value) WHERE NOT base_failed),
sketch AS (SELECT k_lang, k_source, metric, bucket, count(*) AS n FROM long GROUP BY ALL),
levels AS (SELECT 1 AS level, k_lang, k_source, metric, bucket, n FROM sketch
           UNION ALL SELECT 2, k_lang, NULL, metric, bucket, sum(n) FROM sketch GROUP BY ALL
           UNION ALL SELECT 3, NULL, NULL, metric, bucket, sum(n) FROM sketch GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY level, k_lang, k_source, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS u,
                sum(n) OVER (PARTITION BY level, k_lang, k_source, metric) AS total FROM levels),
q AS (SELECT level, k_lang, k_source, metric, any_value(total) AS n, min(bucket) FILTER (WHERE u >= 0.25 * total) AS q1, min(bucket) FILTER (WHERE u >= 0.75 * total) AS q3
      FROM upto GROUP BY ALL),
wide AS (SELECT a.k_lang, a.k_source, a.metric, a.q1, a.q3, a.n, b.n >= 30 AND b.q3 - b.q1 >= 0.5 * (c.q3 - c.q1) AS good,
                CASE WHEN good THEN b.q1 ELSE c.q1 END AS w1, CASE WHEN good THEN b.q3 ELSE c.q3 END AS w3
         FROM q a JOIN q b ON b.level = 2 AND a.k_lang = b.k_lang AND a.metric = b.metric JOIN q c ON c.level = 3 AND a.metric = c.metric WHERE a.level = 1),
pick AS (SELECT k_lang, k_source, metric, n >= 30 AND q3 - q1 >= 0.5 * (w3 - w1) AS own, CASE WHEN own THEN q1 ELSE w1 END AS p1, CASE WHEN own THEN q3 ELSE w3 END AS p3 FROM wide),
fence AS (SELECT k_lang, k_source, metric, p3 + CASE metric WHEN 'symbols' THEN 2 WHEN 'word_length' THEN 4 ELSE 3 END * greatest(p3 - p1, 10) AS high,
                 CASE WHEN metric = 'word_length' THEN p1 - 4 * greatest(p3 - p1, 10) END AS low FROM pick),
bad AS (SELECT DISTINCT r FROM long JOIN fence USING (k_lang, k_source, metric) WHERE can AND (bucket > high OR coalesce(bucket < low, false)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM m
"""
