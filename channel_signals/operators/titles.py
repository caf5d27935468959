"""Title style and vocabulary per channel.

Input is the long table titles(channel_id, pos, title). All measures are sums or
distinct counts that combine before the shuffle, so a channel of any size is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.constants import VIETNAMESE_MIN_LETTERS
from channel_signals.functions import text as X
from channel_signals.functions.segment import Segmenter


def clean(titles: DataFrame) -> DataFrame:
    """Stripped titles without the empty ones."""
    return titles.withColumn("title", X.strip(F.col("title"))).where(
        F.col("title").isNotNull() & (F.col("title") != ""))


def title_style(titles: DataFrame) -> DataFrame:
    """One row per channel with titles: n_titles, dash_density, title_length_std,
    capitalization_ratio, click_marker_share, clickbait_phrase_ratio, is_vietnamese."""
    t = F.col("title")
    agg = clean(titles).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_titles"),
        F.sum(X.dash_count(t)).alias("_dashes"),
        F.sum(X.word_count(t)).alias("_words"),
        F.stddev_pop(F.length(t).cast("double")).alias("_len_std"),
        F.avg(X.upper_share(t)).alias("_upper"),
        F.avg(X.has_click_marker(t).cast("double")).alias("click_marker_share"),
        F.avg(X.has_click_phrase(t).cast("double")).alias("clickbait_phrase_ratio"),
        F.sum(X.vietnamese_letters(t)).alias("_vi"),
    )
    return agg.select(
        "channel_id", "n_titles",
        F.coalesce(F.try_divide(F.col("_dashes"), F.col("_words")), F.lit(0.0)).alias("dash_density"),
        F.when(F.col("n_titles") >= 2, F.col("_len_std")).otherwise(F.lit(0.0)).alias("title_length_std"),
        F.coalesce("_upper", F.lit(0.0)).alias("capitalization_ratio"),
        "click_marker_share", "clickbait_phrase_ratio",
        (F.col("_vi") >= VIETNAMESE_MIN_LETTERS).alias("is_vietnamese"),
    )


def vocabulary(titles: DataFrame, tokenizer: str = "words", segment: Segmenter | None = None) -> DataFrame:
    """Type-token and repeated-opening ratios, for both spellings of the tokens.

    `tokenizer` rules the plain spelling: 'words' (lower-cased word tokens) or
    'whitespace' (lower-cased, split at blanks, punctuation kept). The other one is
    the original-case spelling for Vietnamese channels; the caller picks per channel.
    `segment` cuts Vietnamese titles instead (`functions.segment`); the plain spelling stays.

    Each title gives its tokens and one opening. Equal tokens are counted first, and what
    is left of a vocabulary is counted once more, so no distinct count is needed. Lower-cased
    words are those of the original case again: their text is cut up once.
    """
    t = F.col("title")

    def counted(cut: DataFrame) -> DataFrame:
        """(channel_id, opening, token, n) from the tokens `w` of titles, whose opening comes last."""
        w = F.col("w")
        each = cut.select("channel_id", F.size(w).alias("_size"), F.posexplode(F.concat(w, F.array(X.opening(w)))).alias("_i", "token"))
        return each.groupBy("channel_id", (F.col("_i") == F.col("_size")).alias("opening"), "token").agg(F.count(F.lit(1)).alias("n"))

    def ratios(rows: DataFrame, **kinds) -> DataFrame:
        """Kinds over all tokens; a title without tokens leaves a row, but no count."""
        real = F.col("token").isNotNull()
        return rows.groupBy("channel_id", "opening").agg(*[
            F.try_divide(F.sum(F.when(real, F.col(c))).cast("double"), F.sum(F.when(real, F.col("n")))).alias(k)
            for k, c in kinds.items()])

    cut = clean(titles).select("channel_id", X.tokens(t, "vi").alias("w")) if segment is None else segment(clean(titles))
    vi = counted(cut)
    if tokenizer == "words" and segment is None:
        both = vi.groupBy("channel_id", "opening", F.lower("token").alias("token")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("vi"), F.lit(1).alias("plain"))
        found = ratios(both, vi="vi", plain="plain")
    elif tokenizer in ("words", "whitespace"):
        spelled = X.words(t) if tokenizer == "whitespace" else X.tokens(t)
        plain = counted(clean(titles).select("channel_id", spelled.alias("w")))
        both = [rows.withColumn("one", F.lit(1)) for rows in (vi, plain)]
        none = F.lit(None).cast("double")
        found = ratios(both[0], vi="one").withColumn("plain", none).unionByName(
            ratios(both[1], plain="one").withColumn("vi", none))
    else:
        raise ValueError(f"no tokenizer {tokenizer!r}")

    def share(kind: str, opening: bool) -> Column:
        return F.max(F.when(F.col("opening") == opening, F.col(kind)))

    return found.groupBy("channel_id").agg(
        *[F.coalesce(share(k, False), F.lit(0.0)).alias(f"ttr_{k}") for k in ("vi", "plain")],
        *[F.coalesce(1.0 - share(k, True), F.lit(0.0)).alias(f"open_{k}") for k in ("vi", "plain")])


def pick_vocabulary(vietnamese: Column) -> list[Column]:
    """type_token_ratio and opening_repeat_ratio of the spelling that fits the channel."""
    def either(stem: str) -> Column:
        return F.coalesce(
            F.when(vietnamese, F.col(f"{stem}_vi")).otherwise(F.col(f"{stem}_plain")), F.lit(0.0))

    return [either("ttr").alias("type_token_ratio"), either("open").alias("opening_repeat_ratio")]


def temporal_clickbait(click_share: Column, time_interval_std: Column) -> Column:
    """Share of titles with a click marker, damped by irregular timing; 0 if undefined."""
    return F.when(
        click_share.isNull() | time_interval_std.isNull() | (time_interval_std < 0), F.lit(0.0)
    ).otherwise(click_share / (F.lit(1.0) + time_interval_std))


def language(titles: DataFrame) -> DataFrame:
    """(channel_id, language): 'vi' from three Vietnamese letters on, else 'en'."""
    return (
        titles.groupBy("channel_id")
        .agg(F.sum(X.vietnamese_letters(F.col("title"))).alias("_n"))
        .select("channel_id", F.when(F.col("_n") >= VIETNAMESE_MIN_LETTERS, F.lit("vi"))
                .otherwise(F.lit("en")).alias("language"))
    )
