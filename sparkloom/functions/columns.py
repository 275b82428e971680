"""Column expressions: parsing, labels, dates and tokens. All are built-in functions, no Python in tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds and labels of the letter bands; what is below the last bound is F.
BANDS = ((90.0, "A", "Excellent"), (80.0, "B", "Very Good"), (70.0, "C", "Good"), (60.0, "D", "Pass"))
LOWEST_BAND = ("F", "Fail")
#: Texts that stand for a missing value.
SENTINELS = ("ERROR", "UNKNOWN", "")


def parse_measure(c: Column) -> Column:
    """Whole number of a text; what is missing or not a whole number counts as 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def parse_number(c: Column) -> Column:
    """Number of a text, null where it is none (NaN included)."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_time(c: Column, pattern: str | None = None) -> Column:
    """Timestamp of a text, null where it is none."""
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def without_sentinels(c: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """Null where the text is exactly one of the sentinels."""
    return F.when(~c.isin(*sentinels), c)


def letter(average: Column, bands=BANDS, lowest=LOWEST_BAND) -> Column:
    out = F.lit(lowest[0])
    for bound, name, _ in reversed(bands):
        out = F.when(average >= bound, name).otherwise(out)
    return out


def letter_label(band: Column, bands=BANDS, lowest=LOWEST_BAND) -> Column:
    out = F.lit(lowest[1])
    for _, name, label in reversed(bands):
        out = F.when(band == name, label).otherwise(out)
    return out


def season(ts: Column) -> Column:
    month = F.month(ts)
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isNotNull(), "Fall")


def status_label(status: Column) -> Column:
    return F.when(status == "completed", "Completed").when(status == "in_progress", "In Progress").otherwise("Pending")


def active_label(active: Column) -> Column:
    """Only false is inactive; null is active."""
    return F.when(~active, "Inactive").otherwise("Active")


def initial(name: Column, upper: bool = True) -> Column:
    first = F.substring(name, 1, 1)
    return F.upper(first) if upper else first


def text_or(c: Column, default: str) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit("-"))


def time_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy, hh:mm a"), F.lit("-"))


#: Units of age in seconds; months and years have a fixed length.
AGE_UNITS = (("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60))


def age_label(ts: Column, as_of: Column) -> Column:
    """Age in the largest unit that fits at least once; less than a minute or in the future: Just now; null: a dash."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    out = F.lit("Just now")
    for unit, size in reversed(AGE_UNITS):
        n = F.floor(seconds / size)
        out = F.when(n >= 1, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))).otherwise(out)
    return F.when(ts.isNull(), "-").otherwise(out)


def tokens(text: Column, digits: bool = False) -> Column:
    """Lower-cased words; every character but a-z (and 0-9 if ``digits``) and white space is deleted first, so hyphens
    join their words. Null gives no words."""
    kept = "a-z0-9" if digits else "a-z"
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U)[^{kept}\s]", "")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda x: x != "")


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token lists as binary vectors; 0 if one has none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.sqrt(F.size(x) * F.size(y))), F.lit(0.0))
