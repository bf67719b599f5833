"""Time column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailscope.functions.numbers import finite_number, round_half_up

HTTP_DATE = "^[A-Za-z]{3},\\s+(\\d{1,2} [A-Za-z]{3} \\d{4} \\d{2}:\\d{2}:\\d{2}) GMT$"


def retry_after(header: Column, now: Column) -> Column:
    """Seconds a ``Retry-After`` header asks for, in seconds or as a date."""
    text = F.trim(header)
    seconds = finite_number(F.when(text != "", text))
    plain = F.regexp_extract(text, HTTP_DATE, 1)
    moment = F.coalesce(
        F.try_to_timestamp(F.when(plain != "", plain), F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.when(plain == "", text))
    )
    until = (F.unix_millis(moment) - F.unix_millis(now.cast("timestamp"))) / 1000
    asked = F.coalesce(seconds, until)
    return F.when(asked.isNotNull(), F.greatest(round_half_up(asked), F.lit(0))).cast("bigint")
