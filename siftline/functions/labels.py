"""Numbers and days in the words of the reports, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lines import thousands


def times(ratio: Column) -> Column:
    """A ratio as ``85x``, below ten as ``3.8x``."""
    return F.when(ratio >= 10, F.format_string("%.0fx", F.bround(ratio, 0))).otherwise(F.format_string("%.1fx", F.bround(ratio, 1)))


def change(before: Column, after: Column) -> Column:
    """What a mover did, alike in both directions: new, stopped, or how many times up or down."""
    up = F.concat(F.lit("up "), times(after / before))
    return F.when(before == 0, "new").when(after == 0, "stopped").when(after > before, up).otherwise(F.concat(F.lit("down "), times(before / after)))


def percent(score: Column) -> Column:
    """A score of 0 to 1 in per cent; one that is above 0 but rounds to none is ``under 1%``."""
    whole = F.round(score * 100)
    return F.when((whole < 1) & (score > 0), "under 1%").otherwise(F.concat(whole.cast("long").cast("string"), F.lit("%")))


def bar(n: Column, most: Column) -> Column:
    """The length of a bar in whole per cent of the longest; 1 at least for what isn't empty."""
    return F.when(n > 0, F.greatest(F.floor(100 * n / most), F.lit(1))).otherwise(0)


def recurrence(days: Column, run_days: Column) -> Column:
    """On which of the run's days something was seen; ``days`` is an array of dates."""
    said = F.array_join(F.transform(F.array_sort(days), lambda d: F.date_format(d, "EEE d MMM")), ", ")
    return F.concat(F.format_string("Seen on %d of %d run days: ", F.size(days), run_days.cast("int")), said)


def half(median: Column) -> Column:
    """A median of whole numbers: without decimals, or with its half."""
    return F.when(median == F.floor(median), F.floor(median).cast("string")).otherwise(F.format_string("%.1f", median))


#: What the reports say of each kind of anomaly (fixed values).
PEER_HEADLINE = "Louder than its peers"
DIRECTION_HEADLINES = {"louder": "Louder than its own baseline", "quieter": "Quieter than its own baseline", "silent": "Gone silent"}
PEER_SUMMARY = "%s events vs a fleet median of %s across peer hosts."
SILENT_SUMMARY = "No events today - this host normally emits about %s/day of %s (median over %d days). It has gone silent."
BASELINE_SUMMARY = "%s events today, %s an own %d-day median of %s."
BURST_HEADLINE = "Burst in the %s window"
BURST_SUMMARY = "%s events in the %s window today vs an own median of %s for that time of day (over %d days) - a burst beyond its usual rhythm."


def peer_summary(n: Column, median: Column) -> Column:
    return F.format_string(PEER_SUMMARY, thousands(n), half(median))


def baseline_headline(direction: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in DIRECTION_HEADLINES.items() for x in pair])[direction]


def baseline_summary(program: Column, direction: Column, today: Column, median: Column, days_seen: Column) -> Column:
    verb = F.when(direction == "quieter", "down from").otherwise("up from")
    moved = F.format_string(BASELINE_SUMMARY, thousands(today), verb, days_seen, thousands(median))
    return F.when(direction == "silent", F.format_string(SILENT_SUMMARY, thousands(median), program, days_seen)).otherwise(moved)


def burst_headline(bucket: Column) -> Column:
    return F.format_string(BURST_HEADLINE, bucket)


def burst_summary(today: Column, bucket: Column, median: Column, days_seen: Column) -> Column:
    return F.format_string(BURST_SUMMARY, thousands(today), bucket, thousands(median), days_seen)


def short_day(day: Column) -> Column:
    """A day as ``Fri 28 Aug``, of two digits."""
    return F.date_format(day, "EEE dd MMM")


def plain_day(day: Column) -> Column:
    """A day as ``28/08/2026``."""
    return F.date_format(day, "dd/MM/yyyy")


def period(first: Column, last: Column) -> Column:
    """A period as ``30 Jul to 28 Aug 2026``; the first day has its year too if that is another one."""
    head = F.when(F.year(first) == F.year(last), F.date_format(first, "dd MMM")).otherwise(F.date_format(first, "dd MMM yyyy"))
    return F.concat(head, F.lit(" to "), F.date_format(last, "dd MMM yyyy"))


def reduction(raw: Column, filtered: Column) -> Column:
    """How much of the lines was filtered out, in words; null without lines or without a count of those left."""
    return F.when((raw > 0) & filtered.isNotNull(), F.format_string("%.1f%% filtered out as routine noise", F.bround(100 * (raw - filtered) / raw, 1)))


def compact(x: Column) -> Column:
    """A number of six digits at most, without zeros at its end; very large and small ones with an exponent of ten.

    A function of Python's, as the JVM rounds the shortest decimal of a number and not the number: ties differ.
    """
    odd = {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}
    shown = F.udf(lambda v: None if v is None else odd.get("%.6g" % v, "%.6g" % v), "string", useArrow=True)
    return shown(x.cast("double"))
