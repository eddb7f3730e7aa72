"""Dates in texts and scores of age, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of events by words in the context, in order.
EVENT_WORDS = (
    ("Deadline", ("deadline", "frist", "späteste", "bis", "until", "due")), ("Meeting", ("meeting", "termin", "besprechung", "conference", "call")),
    ("Court Hearing", ("hearing", "verhandlung", "gericht", "court")), ("School Event", ("anmeldung", "einschulung", "school", "enrollment")),
)


def absolute_dates(c: Column) -> Column:
    """ISO dates as they stand, and valid D.M.YYYY and D/M/YYYY as ISO dates: distinct, sorted."""
    iso = F.regexp_extract_all(c, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    other = F.concat(_valid(c, r"(\d{1,2}\.\d{1,2}\.\d{4})", "d.M.yyyy"), _valid(c, r"(\d{1,2}/\d{1,2}/\d{4})", "d/M/yyyy"))
    return F.array_sort(F.array_distinct(F.concat(iso, other)))


def _valid(c: Column, pattern: str, form: str) -> Column:
    return F.array_compact(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.date_format(F.try_to_date(x, form), "yyyy-MM-dd")))


def recency(age_days: Column) -> Column:
    """exp(-0.003 days) between 0.05 and 1; 1 without a date."""
    return F.when(age_days.isNull(), 1.0).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.exp(-0.003 * age_days))))


def event_type(context: Column) -> Column:
    low, out = F.lower(context), None
    for kind, words in EVENT_WORDS:
        test = low.rlike("|".join(words))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("Event")


# The forms of relative dates; days of the week from Monday, and units in days or months.
PHRASES = (r"(?i)(next [\p{L}\p{N}_]+)", r"(?i)(nächste[nrs]? [\p{L}\p{N}_]+)", r"(?i)(am [\p{L}\p{N}_]+)", r"(?i)(morgen|tomorrow)", r"(?i)(gestern|yesterday)", r"(?i)(übermorgen)", r"(?i)(letzte[nrs]? [\p{L}\p{N}_]+)", r"(?i)(in \d+ [\p{L}\p{N}_]+)")
WEEKDAYS = {w: k for words in ("monday tuesday wednesday thursday friday saturday sunday", "montag dienstag mittwoch donnerstag freitag samstag sonntag", "lundi mardi mercredi jeudi vendredi samedi dimanche", "lunes martes miércoles jueves viernes sábado domingo") for k, w in enumerate(words.split(), 1)}
UNIT_DAYS = {w: n for n, words in ((1, "day days tag tage tagen jour jours día días"), (7, "week weeks woche wochen semaine semaines semana semanas")) for w in words.split()}
UNIT_MONTHS = {w: n for n, words in ((1, "month months monat monate monaten mois mes meses"), (12, "year years jahr jahre jahren an ans année año años")) for w in words.split()}
FIRST_CHARACTERS, FIRST_SENTENCES, LEAST_CHARACTERS = 3000, 50, 10


def relative_dates(c: Column, base: Column) -> Column:
    """The dates, ISO, distinct and sorted, that a text's relative phrases mean, seen from the row's own base date.

    Phrases are looked for in the first 50 sentences of the first 3,000 characters, those of under ten characters left out. A
    weekday is the next one after the base date, or the last one before it; weeks, months and years are counted from it.
    Words that are neither mean nothing; a null text or base gives no dates.
    """
    table = lambda of: F.create_map(*(F.lit(x) for kv in of.items() for x in kv))
    days, unit, months = table(WEEKDAYS), table(UNIT_DAYS), table(UNIT_MONTHS)
    here = (F.weekday(base) + 1).cast("int")

    def means(phrase: Column) -> Column:
        low = F.lower(phrase)
        words = F.split(low, " ")
        last, back = F.element_at(words, -1), low.startswith("letzte")
        n = F.when(low.startswith("in "), F.element_at(words, 2).try_cast("int")).when(back, -1).otherwise(1)
        day = F.element_at(days, last)
        to = F.when(back, -F.pmod(here - day - 1, F.lit(7)) - 1).otherwise(F.pmod(day - here - 1, F.lit(7)) + 1)
        fixed = F.when(low.isin("morgen", "tomorrow"), 1).when(low.isin("gestern", "yesterday"), -1).when(low == "übermorgen", 2)
        counted = ~low.startswith("am ")
        shift = F.coalesce(fixed, F.when(~low.startswith("in "), to), F.when(counted, n * F.element_at(unit, last)))
        return F.coalesce(F.date_add(base, shift.cast("int")), F.when(counted, F.add_months(base, (n * F.element_at(months, last)).cast("int")))).cast("string")

    sentences = F.slice(F.split(F.substring(c, 1, FIRST_CHARACTERS), r"[.!?\n]"), 1, FIRST_SENTENCES)
    sentences = F.filter(sentences, lambda x: F.length(F.trim(x)) >= LEAST_CHARACTERS)
    found = F.flatten(F.transform(sentences, lambda x: F.concat(*(F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in PHRASES))))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(found, means)))), F.array().cast("array<string>"))
