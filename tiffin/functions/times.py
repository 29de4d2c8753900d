"""Date and time functions. The current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def utc_seconds(text: Column) -> Column:
    """Timestamp text cut to whole seconds, NULL where it does not parse."""
    return F.date_trunc("second", text.try_cast("timestamp"))


def order_number(ts: Column, request_id: Column) -> Column:
    """Time-based number; the request id keeps two orders of one millisecond apart."""
    millis = F.unix_millis(ts.cast("timestamp"))
    return F.concat(F.lit("ORD"), millis.cast("string"), F.lit("-"), request_id.cast("string"))


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm a")


def _day_or_today(ts: Column, as_of: Column) -> Column:
    return F.when(F.to_date(ts) == F.to_date(as_of), "Today").otherwise(F.date_format(ts, "MMM d"))


def schedule_label(scheduled_at: Column, as_of: Column) -> Column:
    """``Today @ 01:30 PM``, ``Oct 3 @ 01:30 PM``, or ``N/A``."""
    label = F.concat(_day_or_today(scheduled_at, as_of), F.lit(" @ "), _clock(scheduled_at))
    return F.coalesce(label, F.lit("N/A"))


def schedule_label_customer(order_type: Column, scheduled_at: Column, as_of: Column) -> Column:
    """Wording for customers; ``ASAP`` for an order without a time."""
    label = F.concat(
        F.lit("Scheduled for "), _day_or_today(scheduled_at, as_of), F.lit(" at "), _clock(scheduled_at)
    )
    return F.when((order_type == "scheduled") & scheduled_at.isNotNull(), label).otherwise("ASAP")
