"""When a record happened: the named rules for event time, and calendar fields that don't depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utc_date(second: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(_c(second) / 86400).cast("int"))


def utc_hour(second: Column | str) -> Column:
    return F.pmod(F.floor(_c(second) / 3600), F.lit(24)).cast("int")


def text_seconds(text: Column | str) -> Column:
    """Whole seconds of a text: a number of seconds, or a date and time in UTC; null if it is neither."""
    t = _c(text)
    number = F.floor(t.try_cast("double")).cast("bigint")
    return F.coalesce(number, F.unix_timestamp(t.try_cast("timestamp_ntz")))  # of a time without zone: zone-free


def event_second(rule: str, epoch: Column | str, ingest: Column | str | None = None, now: Column | None = None) -> Column:
    """Whole epoch seconds of a record.

    bronze        epoch seconds, else the ingest time, else now
    silver        a number as seconds, else a parsed text, else now (text: see text_seconds)
    stream_score  epoch seconds, else the ingest time
    feature       a timestamp as it is
    `now` is always given from outside; without it those rows stay null and belong into quarantine."""
    parts = []
    if rule == "bronze":
        parts = [_c(epoch).cast("bigint"), F.unix_seconds(_c(ingest)) if ingest is not None else None, now]
    elif rule == "silver":
        parts = [text_seconds(epoch), now]
    elif rule == "stream_score":
        parts = [_c(epoch).cast("bigint"), F.unix_seconds(_c(ingest)) if ingest is not None else None]
    elif rule == "feature":
        parts = [F.unix_seconds(_c(epoch).cast("timestamp"))]
    else:
        raise ValueError(f"no rule {rule!r} for event time")
    return F.coalesce(*[p for p in parts if p is not None])


def local_text(second: Column | str, zone: str = "Asia/Kolkata", form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Wall-clock text in a zone, whatever the session's zone is."""
    s = _c(second)
    utc = utc_date(s).cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(s, F.lit(86400)).cast("decimal(18,6)"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), form)


def local_iso(second: Column | str, zone: str = "Asia/Kolkata") -> Column:
    """ISO-8601 wall-clock time in a zone with its offset, yyyy-MM-ddTHH:mm:ss+hh:mm."""
    s = _c(second)
    utc = utc_date(s).cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(s, F.lit(86400)).cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    away = F.abs(minutes)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(away / 60), away % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def run_stamp(second: Column | str) -> Column:
    """yyyyMMddTHHmmssZ in UTC."""
    return F.concat(local_text(second, "UTC", "yyyyMMdd"), F.lit("T"), local_text(second, "UTC", "HHmmss"), F.lit("Z"))


def day_range(mode: str, now_second: int, offset_s: int = 19_800, start: int | None = None, end: int | None = None) -> tuple[int, int]:
    """(first, last) microsecond, inclusive, of `today`, `yesterday` or a `custom` range of days (start, end: epoch
    days in local time), for a zone `offset_s` from UTC. A day ends one millisecond before the next."""
    day = (now_second + offset_s) // 86400
    if mode == "today":
        a = b = day
    elif mode == "yesterday":
        a = b = day - 1
    elif mode == "custom":
        if start is None or end is None:
            raise ValueError("a custom range needs start and end")
        a, b = start, end
    else:
        raise ValueError(f"no range {mode!r}")
    last = 1 if mode == "custom" else 1000
    return (a * 86400 - offset_s) * 1_000_000, ((b + 1) * 86400 - offset_s) * 1_000_000 - last
