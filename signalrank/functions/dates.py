"""Date and number scalars as Catalyst expressions. Nothing reads the clock: the reference date is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalrank.functions.text import let

# Formats that sources write, alert thresholds in days, recency bounds, month names.
ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy"]
LONG_FORMATS = ["MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "MMMM yyyy", "MMM yyyy"]
THRESHOLDS = [60, 30, 14, 7, 3, 1]
PEAK_DAYS, ZERO_DAYS = 7, 90
MONTHS = "January February March April May June July August September October November December".split()
SEASONS = {"winter": 1, "spring": 4, "summer": 7, "fall": 10, "autumn": 10}
_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + r")\.?"
DATE_PATTERNS = [
    rf"(?i)\b({_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+20\d\d)\b",
    rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH},?\s+20\d\d)\b",
    r"\b(20\d\d-\d{2}-\d{2})\b",
    r"\b(\d{1,2}/\d{1,2}/20\d\d)\b",
]


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO date of any of five precisions; missing parts are the first; null when none fits.

    Formats with a T are tried on texts with one only: a format that fails costs many times one that fits.
    """
    first = lambda t, formats: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])
    days = [f for f in ISO_FORMATS if "T" not in f]
    return let(F.trim(text), lambda t: F.when(F.contains(t, F.lit("T")), first(t, ISO_FORMATS)).otherwise(first(t, days)))


def parse_long(text: Column) -> Column:
    """Date of a written date, month first or day first, or of a month and year."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[.,](?=\s)", "")
    plain = F.regexp_replace(F.initcap(F.lower(plain)), r"\s+", " ")
    written = [f for f in LONG_FORMATS if "," not in f]
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("date") for f in [*written, "yyyy-MM-dd", "M/d/yyyy"]])


def parse_any(text: Column) -> Column:
    return F.coalesce(parse_iso(text).cast("date"), parse_long(text))


def parse_slash(text: Column) -> Column:
    """MM/DD/YYYY."""
    return F.try_to_timestamp(F.trim(text), F.lit("MM/dd/yyyy")).cast("date")


def parse_mail_date(text: Column) -> Column:
    """RFC 822 date of a feed, as a timestamp."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|Z)$", "+0000")
    return F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))


def from_parts(parts: Column) -> Column:
    """Date of [[year, month, day]] with missing parts 1; null without a year, or when the parts make no date."""
    first = F.get(parts, 0)
    part = lambda k: F.lpad(F.coalesce(F.get(first, k), F.lit(1)).cast("string"), 2, "0")
    return F.try_to_timestamp(F.concat_ws("-", F.get(first, 0).cast("string"), part(1), part(2)), F.lit("yyyy-MM-dd")).cast("date")


def published_on(online: Column, created: Column, fallbacks: list[Column], as_of: Column) -> Column:
    """The earlier of online and created, else the first fallback; dates after tomorrow fall back to created, and are null without it."""
    chosen = F.coalesce(F.when(online.isNotNull() & created.isNotNull(), F.least(online, created)), online, *fallbacks, created)
    return F.when(chosen <= F.date_add(as_of, 1), chosen).when(created <= F.date_add(as_of, 1), created)


def year_start(year: Column) -> Column:
    return F.when(year.between(1500, 2100), F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def recency(published: Column, as_of: Column, peak: int = PEAK_DAYS, zero: int = ZERO_DAYS) -> Column:
    """1 up to `peak` days old, falling to 0 at `zero`; unknown and future dates are neutral. published: ISO text; as_of: timestamp or date."""
    age = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(parse_iso(published))) / 86400)
    return let(age, lambda age: (
        F.when(age.isNull() | (age < 0), F.lit(0.5)).when(age <= peak, F.lit(1.0)).when(age >= zero, F.lit(0.0))
        .otherwise(F.lit(1.0) - (age - peak) / F.lit(float(zero - peak)))
    ))


def dates_in(text: Column) -> Column:
    """Distinct dates written in a text, sorted, years 2020 to 2035."""
    found = F.concat(*[F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.array().cast("array<string>")) for p in DATE_PATTERNS])
    parsed = F.transform(found, parse_long)
    return F.array_sort(F.array_distinct(F.filter(parsed, lambda d: d.isNotNull() & F.year(d).between(2020, 2035))))


def first_date(text: Column) -> Column:
    """First date that parses, by the order of patterns, then by place."""
    found = F.concat(*[F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.array().cast("array<string>")) for p in DATE_PATTERNS])
    return F.get(F.filter(F.transform(found, parse_long), lambda d: d.isNotNull() & F.year(d).between(2020, 2035)), 0)


def deadline_dates(text: Column, words: list[str], before: int = 50, after: int = 200) -> Column:
    """Distinct sorted dates in the windows around context words."""
    pattern = rf"(?is)(.{{0,{before}}}\b(?:{'|'.join(words)})\b.{{0,{after}}})"
    windows = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(windows, dates_in))))


def next_fifteenth(month: Column, today: Column) -> Column:
    """The next 15th of a month, today included."""
    here = F.make_date(F.year(today), month, F.lit(15))
    return F.when(here >= today, here).otherwise(F.add_months(here, 12))


def curated_dates(explicit: Column, month: Column, second_month: Column, recurrence: Column, today: Column) -> Column:
    """An explicit date that has not passed; else the next occurrence of the yearly month, and of the second one where it is twice a year."""
    date = F.try_to_timestamp(explicit, F.lit("yyyy-MM-dd")).cast("date")
    twice = F.when((recurrence == "biannual") & second_month.isNotNull(), next_fifteenth(second_month, today))
    projected = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(month.isNotNull(), next_fifteenth(month, today)), twice))))
    return F.when(date >= today, F.array(date)).when(recurrence.isin("annual", "biannual"), projected).otherwise(F.array().cast("array<date>"))


def month_start_from(month: Column, from_date: Column) -> Column:
    """First day of the next such month, this month's included."""
    return F.make_date(F.year(from_date) + (month < F.month(from_date)).cast("int"), month, F.lit(1))


def season_or_month(text: Column) -> Column:
    """Date of a season, month and year, or year, of which only letters and digits are left."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9]+", ""))
    year = F.try_to_number(F.nullif(F.regexp_extract(plain, r"((?:19|20)\d\d)", 1), F.lit("")), F.lit("9999")).cast("int")
    names = {m.lower()[:3]: k for k, m in enumerate(MONTHS, 1)} | SEASONS
    month = F.coalesce(*[F.when(F.contains(plain, F.lit(name)), F.lit(k)) for name, k in sorted(names.items(), key=lambda x: -len(x[0]))], F.lit(1))
    return F.when(year.isNotNull(), F.make_date(year, month, F.lit(1)))


def days_left(due: Column, as_of: Column) -> Column:
    return F.date_diff(due, as_of)


def urgency(days: Column) -> Column:
    """final, urgent, soon or upcoming by days left; rolling when there is no date."""
    return F.when(days.isNull(), "rolling").when(days <= 3, "final").when(days <= 14, "urgent").when(days <= 45, "soon").otherwise("upcoming")


def newsletter_urgency(days: Column) -> Column:
    return F.when(days <= 3, "final").when(days <= 7, "urgent").when(days <= 14, "soon").otherwise("upcoming")


def alert_threshold(days: Column, thresholds: list[int] = THRESHOLDS) -> Column:
    """Smallest threshold that is not below the days left; null beyond the largest and for past dates."""
    fitting = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t >= days)
    return F.when(days >= 0, F.array_min(fitting))


def engagement(count: Column) -> Column:
    return F.round(F.log1p(count.cast("double")), 4)


def score_class(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "mid").otherwise("low")
