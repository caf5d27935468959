"""Ratios of subscribers, views and videos. NULL and NaN counters are treated alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counter(c: Column) -> Column:
    """Counter as DOUBLE with NaN turned into NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def view_per_video(views: Column, videos: Column) -> Column:
    """0 without videos; NULL where a counter is missing, for the imputer to fill."""
    v = counter(videos)
    return F.when(v > 0, counter(views) / v).when(v <= 0, F.lit(0.0))


def sub_to_view_ratio(subscribers: Column, views: Column) -> Column:
    """NULL where a counter is missing."""
    return counter(subscribers) / F.nullif(counter(views) + 1.0, F.lit(0.0))


def velocity(count: Column, age_days: Column) -> Column:
    """Count per day of age: -1 without an age or a count, 0 for a count of 0 or less."""
    c = counter(count)
    return (
        F.when((age_days <= 0) | age_days.isNull() | c.isNull(), F.lit(-1.0))
        .when(c <= 0, F.lit(0.0))
        .otherwise(c / age_days)
    )


def velocity_ratio(subscriber_velocity: Column, view_velocity: Column) -> Column:
    """log10((s+1)/(v+1)), 0 unless both are finite and positive."""
    inf = F.lit(float("inf"))

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < inf)

    return F.when(
        usable(subscriber_velocity) & usable(view_velocity),
        F.log10((subscriber_velocity + 1.0) / (view_velocity + 1.0)),
    ).otherwise(F.lit(0.0))
