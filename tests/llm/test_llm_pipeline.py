"""The pipeline against a plain version of its stages, and what the driver's contract asks of it."""

import base64
import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kelpline.llm import mixing, quality, simhash
from kelpline.llm.shared import stage


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)
    near = docs.where("doc_id between 20 and 39").withColumn("doc_id", F.col("doc_id") + 200_000).withColumn("text", F.concat("text", F.lit(" x")))
    odd = spark.createDataFrame([(300_000, None, None, None, 0), (300_001, "", "en", "src0", 0), (None, "a b", "en", None, 3)], docs.schema)
    path = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(copies).unionByName(near).unionByName(odd).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "mix", "tokenise"]
    columns = docs.columns
    for name, of in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(of(spark, docs, planted), name)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}


def test_run_against_a_plain_version(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert None not in kept and 300_000 not in kept and 300_001 not in kept
    ids = sorted(kept)
    sets = [simhash.shingles((rows[i].text or "").encode(), 5) for i in ids]
    x = [(len(a), a) for a in sets]
    first: dict[int, int] = {}
    for a in range(len(ids)):  # breadth first from the smallest id on
        if ids[a] in first:
            continue
        todo = [a]
        first[ids[a]] = ids[a]
        while todo:
            n, mine = x[todo.pop()]
            for b, (m, other) in enumerate(x):
                if ids[b] not in first and (both := len(mine & other)) >= 0.8 * (n + m - both):
                    first[ids[b]] = ids[a]
                    todo.append(b)
    unique = [i for i in ids if first[i] == i]
    assert not any(i >= 100_000 for i in unique if i - 100_000 in kept)
    left = docs.where(F.col("doc_id").isin(unique))
    times = {r.doc_id: r.copies for r in mixing.copies(left).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i in unique:
        tokens = enc.encode_ordinary(rows[i].text)
        want[i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest()] += times[i]
    assert Counter(map(tuple, corpus_pipeline.run(spark, planted).collect())) == +want


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def plain_run(spark, docs, path):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return corpus_pipeline.run(spark, path).collect()


def test_run_on_odd_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    # Columns whose names stages use themselves.
    clashing = docs.select("*", *[F.lit(k).alias(k) for k in ("f", "row", "fp", "id", "size", "k", "n", "copies", "rows", "label", "first", "kept", "h", "salt", "i")])
    assert plain_run(spark, clashing.limit(0), str(tmp_path / "empty")) == []
    plain = Counter(map(tuple, plain_run(spark, docs, str(tmp_path / "plain"))))
    assert Counter(map(tuple, plain_run(spark, clashing, str(tmp_path / "clashing")))) == plain
    # Rows that come twice are one document, whatever else is there; a very long text is taken whole.
    words = [f"word{k * 7919 % 99991}" for k in range(400_000)]
    long = spark.createDataFrame([(900_001, " ".join(words), "en", "src0", 0), (900_002, " ".join([*words, "more"]), "en", "src0", 0)], docs.schema)
    both = docs.unionByName(docs.where("doc_id < 50")).unionByName(long)
    got = plain_run(spark, both, str(tmp_path / "both"))
    times = Counter(r.doc_id for r in got)
    assert 900_002 not in times and max(times.values()) <= 2
    by_id = {r.doc_id: r.n_tokens for r in got}
    assert by_id.get(900_001, 400_001) > 400_000
    assert {r[0] for r in plain} - set(times) <= set(range(10**6))


def test_stages_keep_rows_without_ids_apart(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text, "en", None), (None, text, "en", None), (1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert Counter(r.doc_id for r in kept.collect()) == {None: 2, 1: 2}
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, kept, "").collect()) == {None: 2, 1: 1}
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == {None: 2, 1: 1, 2: 1}
    assert {r.doc_id for r in corpus_pipeline.tokenise(spark, docs, "").collect()} == {None, 1, 2, 3}
