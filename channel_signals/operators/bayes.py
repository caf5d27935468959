"""Language choice by naive Bayes over character grams, one decision a channel.

The model is a bounded table, the commonest grams with a whole-number weight for every
language, so decisions are exact sums: they do not depend on the order of rows. Scoring
looks grams up in the broadcast table and adds weights per channel in the tasks; no gram is
shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.constants import VIETNAMESE_MIN_LETTERS
from channel_signals.functions.text import vietnamese_letters
from channel_signals.operators.language import gram_counts

#: Grams that the model keeps, whatever the training text holds.
MODEL_GRAMS = 2000
#: Weights are log probabilities in steps of a millionth.
SCALE = 1_000_000


@dataclass
class LanguageModel:
    """`weights` has a row for each gram: gram and an array with a weight for each of
    `languages`; `prior` has the weights of the languages themselves."""

    languages: list[str]
    prior: list[int]
    weights: DataFrame

    def rows(self) -> DataFrame:
        """(language, gram, weight); the prior stands under the empty gram."""
        spark = self.weights.sparkSession
        names = F.array(*[F.lit(x) for x in self.languages]).cast("array<string>")
        long = self.weights.select("gram", F.explode(F.arrays_zip(names.alias("l"), "w")).alias("z")).select(
            F.col("z.l").alias("language"), "gram", F.col("z.w").alias("weight"))
        first = spark.createDataFrame([(x, "", p) for x, p in zip(self.languages, self.prior)], "language string, gram string, weight long")
        return first.unionByName(long)


def fit_languages(df: DataFrame, lang: str = "lang", text: str = "text", grams: int = MODEL_GRAMS) -> LanguageModel:
    """Counts of the `grams` commonest grams in each language, one added to each.

    Priors are the shares of the labelled texts. Rows without a language or a text teach nothing.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    shares = known.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()
    names, n = [r["l"] for r in shares], sum(r["n"] for r in shares)
    spark = df.sparkSession
    if not names:
        return LanguageModel([], [], spark.createDataFrame([], "gram string, w array<bigint>"))
    each = gram_counts(known.withColumnRenamed(lang, "l"), "l", text)
    # a column for each language: one shuffle, a row for each gram
    counts = each.groupBy("gram").agg(*[
        F.sum(F.when(F.col("l") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(names)])
    total = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    top = counts.orderBy(F.desc(total), "gram").limit(grams)
    rows = [tuple(r) for r in top.collect()]  # at most `grams` of them
    sums = [sum(r[i + 1] for r in rows) + len(rows) for i in range(len(names))]
    kept = spark.createDataFrame(rows, "gram string, " + ", ".join(f"n{i} long" for i in range(len(names))))
    weights = kept.select("gram", F.array(*[_log((F.col(f"n{i}") + 1) / F.lit(float(s))) for i, s in enumerate(sums)]).alias("w"))
    prior = spark.range(1).select(*[_log(F.lit(r["n"] / n)) for r in shares]).first()
    return LanguageModel(names, [int(p) for p in prior], weights)


def _log(c: Column) -> Column:
    return F.round(F.log(c) * SCALE).cast("long")


def channel_language(titles: DataFrame, model: LanguageModel) -> DataFrame:
    """(channel_id, language): the language of highest posterior over all titles of a channel;
    at equal weight the first by name. Grams the model lacks count alike for all. A channel
    whose titles hold no known gram goes by its Vietnamese letters, else it is 'en'."""
    k = len(model.languages)
    letters = F.sum(vietnamese_letters(F.col("title")))
    fallback = titles.groupBy("channel_id").agg(letters.alias("_vi")).select(
        "channel_id", F.when(F.col("_vi") >= VIETNAMESE_MIN_LETTERS, F.lit("vi")).otherwise(F.lit("en")).alias("_else"))
    if not k:
        return fallback.withColumnRenamed("_else", "language")
    found = gram_counts(titles, "channel_id", "title").join(F.broadcast(model.weights), "gram")
    sums = found.groupBy("channel_id").agg(*[F.sum(F.col("n") * F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    order = sorted(range(k), key=lambda i: model.languages[i], reverse=True)
    best = F.greatest(*[F.struct((F.col(f"s{i}") + F.lit(model.prior[i])).alias("s"), F.lit(rank).alias("r"),
                                 F.lit(model.languages[i]).alias("l")) for rank, i in enumerate(order)]) if k > 1 else F.struct(
        F.lit(model.languages[0]).alias("l"))
    chosen = sums.select("channel_id", best["l"].alias("_best"))
    return fallback.join(chosen, "channel_id", "left").select(
        "channel_id", F.coalesce("_best", "_else").alias("language"))


def is_vietnamese(titles: DataFrame, model: LanguageModel) -> DataFrame:
    """(channel_id, is_vietnamese), as `language=` of a feature build wants it."""
    return channel_language(titles, model).select("channel_id", (F.col("language") == "vi").alias("is_vietnamese"))
