"""Rows made by the learning and counting steps stay few, whatever the copies."""

from pyspark.sql import functions as F

from quire.llm import phrases, quality


def labelled(spark, copies):
    own = [c.alias(k) for k, c in quality.statistics().items()]
    base = spark.range(400).select(
        (F.col("id") % 8 == 0).alias("poor"), (F.col("id") % 3 != 0).alias("grow"), (F.lit(60) + F.col("id") % 40).cast("long").alias("n_words"),
        F.lit(300).cast("long").alias("word_chars"), F.when(F.col("id") % 8 == 0, 200 + F.col("id") % 50).otherwise(F.col("id") % 5).cast("long").alias("n_symbols"),
        *[F.lit(1).cast("long").alias(c) for c in ("n_upper", "n_marks", "n_digits", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words")])
    return base.select("poor", "grow", *own).withColumn("no", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("no")


def test_copies_are_counted_not_read_again(spark, monkeypatch):
    seen, plain = [], quality._histogram

    def counted(coded, names):
        seen.append(coded.count())
        return plain(coded, names)

    monkeypatch.setattr(quality, "_histogram", counted)
    rules = quality.learn(labelled(spark, 1))
    once, seen[:] = list(seen), []
    assert rules and all(c.name for r in rules for c in r)
    assert quality.learn(labelled(spark, 5)) == rules and seen == once
    # all rows are read once; later only what the conditions cover
    assert sum(n == max(once) for n in once) == 1


def test_last_scan_runs_in_few_tasks(spark):
    rows = [("en", f"alpha beta gamma word{k % 7}") for k in range(600)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(40)
    assert phrases.gathered(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {r.phrase: r.n for r in phrases.count_phrases(docs).where("k > 1").collect()}
    assert got == {"alpha beta": 600, "beta gamma": 600, "alpha beta gamma": 600}
