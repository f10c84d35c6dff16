"""Quality: held-out accuracy, shrinking of sites, odd rows."""

from pyspark.sql import functions as F

from auditframe.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    scored = quality.score_quality(docs, labels.filter(~held), carry=["doc_id"])
    rows = scored.join(labels.filter(held), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    assert sum(clean) / len(clean) > 0.99
    assert sum(bad) / len(bad) < 0.06
    assert sum(toxic) / len(toxic) < 0.06


def _texts(n):
    return [(i, "good words in a plain line of text " * 5 if i % 2 else "bad !!! ### $$$ " * 5, f"s{i % 3}", "en") for i in range(n)]


def test_a_site_moves_its_documents_odds(spark):
    rows = _texts(120)
    neutral = [(1000 + i, "something else", "bad" if i < 3 else "fine", "en") for i in range(6)]
    rows += [(2000 + i, "bad !!! ### $$$ " * 5, "bad", "en") for i in range(60)]
    rows += [(3000 + i, "good words in a plain line of text " * 5, "fine", "en") for i in range(60)]
    df = spark.createDataFrame(rows + neutral, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    p = {r.doc_id: r.p_good for r in quality.score_quality(df, labels).collect()}
    assert max(p[1000 + i] for i in range(3)) < min(p[1000 + i] for i in range(3, 6))


def test_rare_toxic_words_late_in_the_sample_count(spark):
    """The rows with a rare toxic word come after 12,000 others in the order of the sample."""
    ids = spark.range(16_000).withColumnRenamed("id", "doc_id")
    late = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc(), "doc_id").limit(60).collect()]
    toxic = F.col("doc_id").isin(late)
    docs = ids.select(
        "doc_id", F.when(toxic, "some plain words and then blargh").otherwise("some plain words and then more").alias("text"),
        F.lit("s").alias("source"), F.lit("en").alias("lang"),
    )
    labels = ids.select("doc_id", F.lit(1).alias("quality"), toxic.cast("int").alias("toxic"))
    weights, _ = quality.fit_classifiers(docs, labels)[1]
    assert weights.any()
    scored = quality.score_quality(docs, labels, carry=["doc_id"])
    assert scored.filter(F.col("doc_id").isin(late) & F.col("kept")).count() == 0


def test_odd_rows(spark):
    rows = [*_texts(20), (None, None, None, None), (20, "", None, "en"), (21, "x" * 100000, "s1", None), (3, _texts(4)[3][1], "s0", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("kept", F.lit(1)).withColumn("good", F.lit("g"))
    labels = spark.createDataFrame([(i, i % 2, None if i == 5 else 0) for i in range(20)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels)
    assert got.columns == ["doc_id", "text", "source", "lang", "good", "p_good", "p_toxic", "kept"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.p_good <= 1 and r.kept is not None for r in out)
    assert quality.score_quality(df, labels.limit(0)).count() == len(rows)
    assert quality.score_quality(df.limit(0), labels).collect() == []
