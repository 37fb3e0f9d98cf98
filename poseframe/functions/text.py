"""Times, encodings of missing values and small text formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def number(text: Column) -> Column:
    """A double; null for what isn't a number, an empty string or any spelling of nan."""
    d = text.try_cast("double")
    return F.when(~F.isnan(d), d)


def iso_start(text: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO start time; the fraction is cut or padded to six digits, a final Z is dropped."""
    t = F.regexp_replace(F.rtrim(text), "Z$", "")
    head, frac = F.split_part(t, F.lit("."), F.lit(1)), F.split_part(t, F.lit("."), F.lit(2))
    return F.concat(head, F.lit("."), F.rpad(F.substring(frac, 1, 6), 6, "0")).try_cast("timestamp_ntz")


def clock(start: Column, frame: Column, seconds: float) -> Column:
    """The time of a frame as text, cut to milliseconds."""
    t = F.timestamp_add("MICROSECOND", F.floor(frame * F.lit(seconds * 1e6)).cast("int"), start)
    return F.date_format(F.date_trunc("millisecond", t), "yyyy-MM-dd HH:mm:ss.SSS")


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with typed null columns for those that it lacks (name -> type)."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def frame_number(path: Column, pattern: str = r"(\d+)(?:_keypoints)?\.[A-Za-z]+$") -> Column:
    """The number in a file's name; null for a name without one."""
    return F.regexp_extract(path, pattern, 1).try_cast("bigint")


def zero_padded(n: Column, width: int) -> Column:
    """A whole number with zeros in front, as in names of frames; longer numbers stay whole."""
    digits = n.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def odd(n: Column) -> Column:
    """The number itself if odd, else the next one: sizes of windows and kernels that need a middle."""
    return n.bitwiseOR(F.lit(1))


def looked_up(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """What a small fixed table has for a key; the default for others and for null."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))
