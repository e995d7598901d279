"""Language detection as a Spark job.

Multinomial naive Bayes on character trigrams (of the lower-cased text),
trained on texts with a known language and scored by join + aggregate:

    score(d, L) = ln(N_L / N) + sum_g n(d, g) * (ln(c(L, g) + 1) - ln(T_L + V))

over trigrams g seen in training (V of them); c = trigram count in
language L, T_L = all trigrams of L.  Scores are rounded to 6 places and
ties go to the smaller language code, so the label is stable.

The model is one row per trigram with one column per language (pivot), so
scoring is a single join and a single aggregate; it is broadcast when the
vocabulary is within a checked bound, else joined by shuffle (AQE splits a
hot trigram).  Document-side trigrams are counted per document first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_root

GRAM = 3
# Largest vocabulary (rows) broadcast to the scoring join.
BROADCAST_MAX_GRAMS = 2_000_000


def trigrams(df: DataFrame, key_cols, text_col: str = "text") -> DataFrame:
    """One row per trigram occurrence, from one linear JVM regex pass: an
    empty-width lookahead match at every code point captures the next three
    (a lambda over positions runs interpreted; substring at an offset
    rescans UTF-8).  Exploded rows carry only keys, never the text."""
    keys = list(key_cols)
    grams = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return df.select(*keys, F.explode(grams).alias("gram"))


class TrigramModel:
    def __init__(self, wide: DataFrame, langs: list[str], priors: dict, denoms: dict, vocab: int):
        self.wide, self.langs, self.priors, self.denoms, self.vocab = wide, langs, priors, denoms, vocab


def save_model(model: TrigramModel, path: str) -> None:
    """Keep a model: its trigram table and, per language, prior and denominator."""
    model.wide.write.mode("overwrite").parquet(f"{path}/grams")
    rows = [(lang, model.priors[lang], model.denoms[lang], model.vocab) for lang in model.langs]
    model.wide.sparkSession.createDataFrame(rows, "lang string, prior double, denom double, vocab long").write.mode("overwrite").parquet(f"{path}/langs")


def load_model(spark: SparkSession, path: str) -> TrigramModel:
    rows = spark.read.parquet(f"{path}/langs").orderBy("lang").collect()  # one row per language
    langs = [r["lang"] for r in rows]
    return TrigramModel(spark.read.parquet(f"{path}/grams"), langs, {r["lang"]: r["prior"] for r in rows}, {r["lang"]: r["denom"] for r in rows},
                        rows[0]["vocab"] if rows else 0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TrigramModel:
    """One pass over the training text: trigram counts per language land
    directly in one row per trigram with a count column per language (the
    language list comes from a lang-only scan first).  The table is written
    once to the shared folder; T_L and V come from one small aggregate."""
    shared_root(docs.sparkSession)
    labeled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_col)
    # one row per language (a handful): fine on the driver
    ndocs = {r["lang"]: r["n"] for r in labeled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(ndocs)
    grams = trigrams(labeled, ["lang"], text_col)
    counts = grams.groupBy("gram").agg(*[F.count_if(F.col("lang") == lang).alias(f"c_{lang}") for lang in langs])
    counts = materialize(counts, "trigram-counts")
    stats = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"c_{lang}").alias(f"t_{lang}") for lang in langs]).first()
    vocab = stats["v"]
    total = sum(ndocs.values())
    import math
    priors = {lang: math.log(ndocs[lang] / total) for lang in langs}
    denoms = {lang: math.log(stats[f"t_{lang}"] + vocab) for lang in langs}
    wide = counts.select("gram", *[F.log(F.col(f"c_{lang}") + 1).alias(lang) for lang in langs])
    return TrigramModel(wide, langs, priors, denoms, vocab)


def detect(texts: DataFrame, model: TrigramModel, key: str, text_col: str = "text",
           out_col: str = "lang") -> DataFrame:
    """Per row of ``texts``: the key and the likeliest language.  No exchange
    carries text: trigrams meet the broadcast model where the text is, and only
    (key, sums) go on; a model too large to broadcast is met by (key, gram) counts."""
    grams = trigrams(texts.select(key, text_col), [key], text_col)
    if model.vocab <= BROADCAST_MAX_GRAMS:
        j = grams.join(F.broadcast(model.wide), "gram").withColumn("n", F.lit(1))
    else:
        j = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n")).join(model.wide, "gram")
    aggs = [F.sum("n").alias("_m")] + [F.sum(F.col("n") * F.col(f"`{lang}`")).alias(f"_s_{lang}")
                                        for lang in model.langs]
    per = j.groupBy(key).agg(*aggs)
    base = texts.select(key).join(per, key, "left")
    m = F.coalesce(F.col("_m"), F.lit(0)).cast("double")
    cands = []
    for lang in model.langs:
        score = (F.lit(model.priors[lang]) - F.lit(model.denoms[lang]) * m
                 + F.coalesce(F.col(f"_s_{lang}"), F.lit(0.0)))
        cands.append(F.struct((-F.round(score, 6)).alias("neg"), F.lit(lang).alias("l")))
    best = F.array_min(F.array(*cands))
    return base.select(key, best["l"].alias(out_col))
