"""Row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 0.05


def min_max_row(values: Column) -> Column:
    """Scale a record's own values to [0, 1]; a constant record becomes zeros."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def mean_of(*values: Column) -> Column:
    """Mean of the non-null values of a row, null if there are none."""
    present = F.filter(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(present, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(present) > 0, total / F.size(present))


def std_of(*values: Column) -> Column:
    """Population standard deviation of the non-null values of a row."""
    present = F.filter(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
    mean = F.aggregate(present, F.lit(0.0), lambda s, v: s + v) / F.size(present)
    squares = F.aggregate(present, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(F.size(present) > 0, F.sqrt(squares / F.size(present)))


def round3(value: Column) -> Column:
    """Three decimals, halves to even."""
    return F.rint(value * 1000) / 1000


def format_hms(seconds: Column) -> Column:
    """Whole seconds as H:MM:SS, with a day prefix from 24 hours on."""
    s = F.bround(seconds, 0).cast("bigint")
    days = F.floor(s / 86400)
    clock = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    prefix = F.when(days == 1, F.lit("1 day, ")).when(days > 1, F.concat(days.cast("string"), F.lit(" days, ")))
    return F.concat(F.coalesce(prefix, F.lit("")), clock)


def parse_hms(text: Column) -> Column:
    """Seconds of an H:MM:SS text, with or without a day prefix."""
    days = F.coalesce(F.regexp_extract(text, r"^(\d+) day", 1).try_cast("double"), F.lit(0.0))
    parts = F.split(F.element_at(F.split(text, " "), -1), ":")
    clock = parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double")
    return days * 86400 + clock


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clean_suffix(path: Column) -> Column:
    """``dir/name.ext`` to ``dir/name_clean.ext``."""
    return F.when(path.rlike(r"[^/.][^/]*\.[^./]*$"), F.regexp_replace(path, r"(\.[^./]*)$", "_clean$1")).otherwise(
        F.concat(path, F.lit("_clean"))
    )


def estimator_name(text: Column) -> Column:
    return F.substring_index(text, "(", 1)


def safe_name(name: Column) -> Column:
    """A column name of letters, digits and underscores (not yet made unique)."""
    cleaned = F.trim(F.regexp_replace(name, "[^0-9a-zA-Z_]", "_"), F.lit("_"))
    cleaned = F.when(cleaned == "", F.lit("feature")).otherwise(cleaned)
    return F.when(cleaned.rlike("^[0-9]"), F.concat(F.lit("f_"), cleaned)).otherwise(cleaned)


def report_line(rank: Column, resampler: Column, classifier: Column) -> Column:
    """Columns 7, 25 and 25 wide, numbers to the right, texts to the left; longer ones are kept whole."""

    def pad(value: Column, width: int) -> Column:
        return F.when(F.length(value) < width, F.rpad(value, width, " ")).otherwise(value)

    text = rank.cast("string")
    first = F.when(text.rlike("^[0-9]{1,6}$"), F.lpad(text, 7, " ")).otherwise(pad(text, 7))
    return F.concat_ws(" ", first, pad(resampler, 25), pad(classifier, 25))


def verdict(p: Column, alpha: float = ALPHA) -> Column:
    """The wording of a paired test; a null p means every pair was equal."""
    return (
        F.when(p.isNull(), F.lit("Same distribution"))
        .when(p > alpha, F.lit("Same distribution (fail to reject H0)"))
        .otherwise(F.lit("Different distribution (reject H0)"))
    )
