"""Growing the seed lists from scored candidates.

candidates(target, query, query_order, rank, channel_id, title, country,
subscriber_count, video_count, view_count); query_order is the order the searches ran in
and target, 'slop' or 'genuine', the class a search was made for. Slop searches come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channel_signals import constants as C
from channel_signals.operators.similarity import first_titles
from channel_signals.session import materialize


def default_country(country: Column, query: Column) -> Column:
    """'VN' for a missing country when the query holds a lower-case Vietnamese letter."""
    missing = F.coalesce(country, F.lit("")) == ""
    return F.when(missing & query.rlike(f"[{C.VIETNAMESE_LETTERS}]"), F.lit("VN")).otherwise(country)


def enough_audience(subscribers: Column, videos: Column, views: Column) -> Column:
    def n(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    return (
        (n(subscribers) >= C.MIN_SUBSCRIBERS) & (n(videos) >= C.MIN_VIDEOS)
        & (n(views) >= C.MIN_VIEWS)
    )


def first_occurrence(candidates: DataFrame) -> DataFrame:
    """One row per channel: where it turned up first. Combines before the shuffle."""
    rest = [c for c in candidates.columns if c not in ("query_order", "rank")]
    return (
        candidates.groupBy("channel_id")
        .agg(F.min(F.struct("query_order", "rank", *[c for c in rest if c != "channel_id"])).alias("_r"))
        .select("channel_id", "_r.*").select(*candidates.columns)
    )


def upload_cap(query: Column) -> Column:
    return F.when(query.isin(C.LOW_RESULT_QUERIES), F.lit(C.LOW_RESULT_UPLOADS)).otherwise(
        F.lit(C.UPLOADS_PER_CHANNEL))


def _newest(rows: DataFrame, candidates: DataFrame, order: Column) -> DataFrame:
    """The first rows of each candidate up to its cap. The constant bound is applied
    before the shuffle, the smaller one after it."""
    w = Window.partitionBy("channel_id").orderBy(order)
    recent = rows.withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= C.UPLOADS_PER_CHANNEL)
    caps = candidates.select("channel_id", upload_cap(F.col("query")).alias("_cap"))
    return recent.join(caps, "channel_id").where(F.col("_rn") <= F.col("_cap")).drop("_rn", "_cap")


def capped_uploads(uploads: DataFrame, candidates: DataFrame) -> DataFrame:
    """The newest uploads of each candidate: 10 for the low-result searches, else 50."""
    return _newest(uploads, candidates, F.desc("published_at"))


def capped_titles(titles: DataFrame, candidates: DataFrame) -> DataFrame:
    """The titles that go with `capped_uploads`; position 0 is the newest."""
    return _newest(titles, candidates, F.asc("pos"))


def eligible(candidates: DataFrame, uploads: DataFrame) -> DataFrame:
    """Candidates with enough audience and at least three uploads. The cheap test on the
    counters comes first, and prunes the uploads that are counted."""
    known = candidates.where(enough_audience(
        F.col("subscriber_count"), F.col("video_count"), F.col("view_count")))
    enough = (
        uploads.where(F.col("published_at").isNotNull()).groupBy("channel_id")
        .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= C.MIN_TIMESTAMPS)
    )
    return known.join(enough, "channel_id", "left_semi")


def _holds_keyword(text: Column) -> Column:
    out = F.lit(False)
    for kw in C.EXCLUDE_KEYWORDS:
        out = out | text.contains(kw)
    return out


def with_exclusion(channels: DataFrame, titles: DataFrame) -> DataFrame:
    """Add `excluded`: a keyword occurs in the channel title or its first five titles,
    lower-cased and joined by blanks (a keyword may span two of them)."""
    first = (
        first_titles(titles, 5).groupBy("channel_id")
        .agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]), " ")
            .alias("_titles"))
    )
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("_titles")))
    return (
        channels.join(first, "channel_id", "left")
        .withColumn("excluded", _holds_keyword(text)).drop("_titles")
    )


def classify(p1: Column, excluded: Column) -> Column:
    """'slop', 'genuine', or NULL when the score is not sure enough."""
    return (
        F.when(
            (p1 >= C.SLOP_THRESHOLD) & ((p1 >= C.SLOP_SURE_THRESHOLD) | ~excluded), F.lit("slop"))
        .when(p1 <= C.GENUINE_THRESHOLD, F.lit("genuine"))
    )


def self_training_label(p1: Column, forced: Column | None = None) -> Column:
    """Label a scored channel may be added under: forced always, else only a sure one."""
    sure = F.when(p1 >= C.SELF_TRAINING_CONFIDENCE, F.lit("slop")).when(
        p1 <= 1 - C.SELF_TRAINING_CONFIDENCE, F.lit("genuine"))
    return sure if forced is None else F.coalesce(forced, sure)


def within_quota(decided: DataFrame, quota: int = C.MAX_NEW_PER_CLASS) -> DataFrame:
    """The channels found before the searches for their target stop, in search order.

    A search looks at a channel while fewer than `quota` of its target class have been found,
    by any search before; what it then finds counts for either class. So slop searches may
    add any number of genuine channels, and these count when the genuine searches begin.
    One phase of searches stops at a row of its own, so two short cuts decide everything:
    only the place of the quota-th slop row, and the number of genuine rows before the
    genuine searches, leave the tasks.
    """
    order = F.struct("query_order", "rank", "channel_id")
    rows = decided.withColumn("_at", order)

    def place(of: DataFrame, n: int):
        """Place of the n-th row, or None where there are fewer."""
        top = of.orderBy("_at").limit(n).select("_at")
        last = top.agg(F.max("_at").alias("at"), F.count(F.lit(1)).alias("n")).first()
        return F.struct(*[F.lit(v).alias(k) for k, v in last["at"].asDict().items()]) if last["n"] == n else None

    slop_phase = rows.where(F.col("target") == "slop")
    stop = place(slop_phase.where(F.col("decision") == "slop"), quota) if quota > 0 else None
    if quota <= 0:
        slop_phase = slop_phase.where(F.lit(False))
    elif stop is not None:
        slop_phase = slop_phase.where(F.col("_at") <= stop)
    found = slop_phase.where(F.col("decision") == "genuine").count()
    genuine_phase = rows.where(F.col("target") == "genuine")
    if found >= quota:
        genuine_phase = genuine_phase.where(F.lit(False))
    else:
        stop = place(genuine_phase.where(F.col("decision") == "genuine"), quota - found)
        if stop is not None:
            genuine_phase = genuine_phase.where(F.col("_at") <= stop)
    return slop_phase.unionByName(genuine_phase).drop("_at")


def curate(
    candidates: DataFrame, uploads: DataFrame, titles: DataFrame, score,
    quota: int = C.MAX_NEW_PER_CLASS,
) -> DataFrame:
    """new_channels(channel_id, title, label) from landed candidates.

    `score(candidates, uploads, titles)` returns (channel_id, p1). Nothing is written:
    pass the result to `seeds_with` for that. Each step is written once: the quota reads its
    rows several times, and sorts of many steps in one stage would each hold their first page.
    """
    first = first_occurrence(candidates).withColumn(
        "country", default_country(F.col("country"), F.col("query")))
    kept = materialize(eligible(first, uploads))
    recent = capped_uploads(uploads, kept)
    theirs = materialize(capped_titles(titles, kept))
    scored = kept.join(score(kept, recent, theirs), "channel_id")
    decided = materialize(with_exclusion(scored, theirs).withColumn(
        "decision", classify(F.col("p1"), F.col("excluded"))).where(F.col("decision").isNotNull()))
    return within_quota(decided, quota).select(
        "channel_id", "title", F.col("decision").alias("label"))


def seeds_with(seeds: DataFrame, new_channels: DataFrame) -> DataFrame:
    """Seed ids (channel_id, label) with the new channels appended, each id once per label.

    An id may stand under both labels, as it may in two lists; `union_labels` then reads
    it as genuine.
    """
    fresh = new_channels.select(
        "channel_id", F.when(F.col("label") == "slop", C.SLOP).otherwise(C.GENUINE)
        .cast(seeds.schema["label"].dataType).alias("label"))
    fresh = fresh.distinct().join(seeds.select("channel_id", "label"), ["channel_id", "label"], "left_anti")
    return seeds.unionByName(fresh.select(*seeds.columns))
