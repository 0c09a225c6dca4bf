"""Column functions on timestamps, values and dimension maps; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def epoch_to_ts(epoch: Column) -> Column:
    """Epoch seconds -> wall-clock timestamp."""
    return F.timestamp_seconds(epoch).cast("timestamp_ntz")


def ts_to_epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def parse_ts(text: Column, fmt: str | None = None) -> Column:
    return F.to_timestamp_ntz(text, F.lit(fmt)) if fmt else F.to_timestamp_ntz(text)


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def is_weekday(ts: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(ts) < 5


def week_end_epoch(epoch: Column) -> Column:
    """The Monday midnight that closes the week of ``epoch`` (epoch day 0 was a Thursday)."""
    day = F.floor(epoch / DAY_SECONDS)
    weekday = F.pmod(day + 3, F.lit(7))
    return ((day + 7 - weekday) * DAY_SECONDS).cast("long")


def analysis_window(epoch: Column) -> dict[str, Column]:
    """Four-week window ending at the closing Monday, with its last week."""
    end = week_end_epoch(epoch)
    return {
        "window_start": epoch_to_ts(end - 28 * DAY_SECONDS),
        "last_week_start": epoch_to_ts(end - 7 * DAY_SECONDS),
        "window_end": epoch_to_ts(end),
    }


def to_numeric(text: Column) -> Column:
    """Safe cast: text that is no number becomes NULL."""
    return text.try_cast("double")


def parse_dim(text: Column) -> Column:
    """Stored dimension text (a JSON object) -> map."""
    return F.from_json(text, "map<string,string>")


def dim_values(dim: Column) -> Column:
    return F.array_join(F.map_values(dim), "_")


def dim_names(dim: Column) -> Column:
    return F.array_join(F.map_keys(dim), "_")


def clip(value: Column, lower: Column, upper: Column) -> Column:
    """Clip to the bounds; a missing bound does not clip."""
    return F.when(value.isNull(), None).otherwise(F.greatest(F.least(value, upper), lower))


def fill_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def dim_filter(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose dimension columns equal the whole tuple."""
    for name, want in wanted.items():
        df = df.filter(F.col(name) == F.lit(want))
    return df


def time_range(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).between(start, end))
