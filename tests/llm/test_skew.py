"""Hot keys and repeated batches: no group of one key grows with the table."""

import random

import pytest
from pyspark.sql import functions as F

from replicakit.llm import exact_dedup as exact
from replicakit.llm import mixing, secret_scan
from replicakit.session import scratch_path


def test_a_batch_appended_twice_counts_once(spark):
    docs = spark.createDataFrame([(1, "token = abcdefghij0123456789"), (2, "nothing"), (3, "token = abcdefghij0123456789"),
                                  (4, "0123456789abcdef01 and token: ABCDEFGHIJKLMNOP")], "doc_id bigint, text string")
    ledger = scratch_path(spark, "ledger-twice")
    ask = lambda df: sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.secret_scan(df, ledger=ledger).collect())
    first = ask(docs)
    assert [len(s) for _, s in first] == [2, 0, 2, 2] or [len(s) for _, s in first] == [1, 0, 1, 2]
    copy = scratch_path(spark, "ledger-copy")
    spark.read.parquet(ledger).write.parquet(copy)
    spark.read.parquet(copy).write.mode("append").parquet(ledger)
    assert ask(docs) == first
    # A table with other blobs sees only its own, though the ledger holds all.
    assert ask(docs.filter("doc_id = 4")) == first[3:]


def test_a_hot_blob_splits_in_the_join(spark):
    """Both sides of the join back to the paths are scans: nothing aggregates above an exchange."""
    docs = spark.createDataFrame([(i, "token = abcdefghij0123456789") for i in range(50)], "doc_id bigint, text string")
    p = secret_scan.secret_scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Relation") == 2 and "Aggregate" not in p


@pytest.mark.parametrize("copies", [20, 2000])
def test_a_text_is_cut_by_bytes_not_by_share(spark, copies):
    """A text of a fixed share of the rows is cut into pieces of a fixed size."""
    rows = [(i, "x" * 900) for i in range(copies)] + [(10_000 + i, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, body string").withColumn("digest", F.unhex(F.sha2("body", 256)))
    limit = 10 * (900 + exact.ROW_BYTES)
    dealt = exact._dealt(docs, 64, limit, 1).filter("salt >= 0").groupBy("salt").count().collect()
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == copies
    # Ten rows a piece on average; hashing deals them.
    assert max(r["count"] for r in dealt) <= 3 * 10
    got = exact.exact_dedup(docs.withColumnRenamed("body", "text"), task_bytes=limit).filter("group_size > 1")
    assert got.count() == copies and got.filter("kept").select("doc_id").first()[0] == copies - 1


def test_low_quality_texts_make_no_large_bucket(spark):
    """Qualities of 0.05 to 1 in one source: buckets stay even."""
    rnd = random.Random(3)
    clean, junk = "plain words of a text ", "1234 #### 5678 "
    rows = [(i, (junk * 20 + "a") if rnd.random() < 0.1 else clean * rnd.randint(1, 5) + "7" * rnd.randint(0, 60), "s")
            for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    seen, real = [], mixing._placed

    def watch(base, known, bucket_rows):
        out = real(base, known, bucket_rows)
        seen.append(out.groupBy("sid", "cell").count())
        return out

    mixing._placed = watch
    try:
        mixing.mix(docs, bucket_rows=200).count()
    finally:
        mixing._placed = real
    sizes = sorted(r["count"] for r in seen[0].collect())
    assert sum(sizes) == 20_000 and sizes[-1] <= 400 and len(sizes) >= 90
