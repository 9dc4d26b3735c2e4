"""Fields read from a text: parties, date, description, market, sector, team, currency."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import tidy

# Legal forms, labels and shapes of dates.
_FORMS = r"LLC|L\.L\.C\.|LLP|L\.L\.P\.|FZE|FZ-LLC|FZCO|PJSC|PSC|PLC|Ltd\.?|Limited|Inc\.?|Corp\.?|Corporation|Co\.?|Company|Holdings?|Group|W\.L\.L\.|WLL"
ENTITY = rf"(?dU)([A-Z][A-Za-z0-9&,.\-\s]{{2,60}}?\s(?:{_FORMS}))\b"
BETWEEN = r"(?iudU)between\s+(.{3,80}?)\s+and\s+(.{3,80}?)[,.\n]"
LABEL = r"(?iudU)(?:client|customer|counterparty|company name)\s*[:\-]\s*(.{3,80})"
DATE_LABEL = r"(?iudU)(?:dated|effective date|date of (?:this )?agreement)\s*[:\-]?\s*([^\n]{4,30})"
DATE = r"(?dU)\b(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def entity_name(text: Column) -> Column:
    """By a label, else the first side of "between .. and .." that bears a legal
    form (or else its first side), else the first words before a legal form."""
    left, right = tidy(_found(text, BETWEEN, 1)), tidy(_found(text, BETWEEN, 2))
    side = F.when(left.rlike(ENTITY), left).when(right.rlike(ENTITY), right).otherwise(left)
    found = F.when(text.rlike(LABEL), tidy(_found(text, LABEL))).when(text.rlike(BETWEEN), side).when(text.rlike(ENTITY), tidy(_found(text, ENTITY)))
    return F.substring(F.coalesce(found, F.lit("")), 1, 80)


def date_words(text: Column) -> Column:
    """What stands for a date: behind a label, tightened to the shape of a date if
    there is one, else the first thing of that shape; null if there is none."""
    labelled = _found(text, DATE_LABEL)
    return F.when(labelled.isNotNull(), F.coalesce(_found(labelled, DATE), labelled)).otherwise(_found(text, DATE))


def plain_date(words: Column) -> Column:
    """A date in one of the usual forms, month first unless that is impossible."""
    w = F.regexp_replace(F.regexp_replace(F.trim(words), r"(?i)^(\d{1,2})(?:st|nd|rd|th)\b", "$1"), r"(?U)\s+", " ")
    w = F.regexp_replace(w, ",", "")
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "M/d/yyyy", "d/M/yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.when(w.rlike(_SHAPE[f]), F.initcap(w)), F.lit(f)) for f in forms]).cast("date")


_SHAPE = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,9} \d{4}$|^\d{1,2} (?i:may) \d{4}$", "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]{4,9} \d{1,2} \d{4}$|^(?i:may) \d{1,2} \d{4}$", "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
}


def contract_date(docs: DataFrame, text: str = "text", default: str = "2000-01-01", out: str = "contract_date") -> DataFrame:
    """``docs`` with the date as yyyy-MM-dd, or what stands for it (20 characters)
    if it is no date, or ``""``.  Only what the usual forms don't cover is given to a
    lenient parser in Python; parts it lacks are those of ``default``."""
    from dateutil import parser

    day = dt.datetime.fromisoformat(default)

    @F.pandas_udf("string")
    def lenient(words: pd.Series) -> pd.Series:
        def one(w: str | None) -> str | None:
            try:
                return None if w is None else parser.parse(w, fuzzy=True, dayfirst=False, default=day).strftime("%Y-%m-%d")
            except Exception:  # whatever the parser makes of free text
                return None

        return words.map(one)

    d = docs.withColumn("_w", date_words(F.coalesce(F.col(text), F.lit("")))).withColumn("_d", plain_date(F.col("_w")))
    d = d.withColumn("_p", lenient(F.when(F.col("_d").isNull(), F.col("_w"))))
    keep = [c for c in docs.columns if c != out]
    return d.select(*keep, F.coalesce(F.date_format("_d", "yyyy-MM-dd"), "_p", F.substring(tidy(F.col("_w")), 1, 20)).alias(out))


def description(text: Column) -> Column:
    """The first line of 15 characters or more, else the whole text; 160 characters."""
    lines = F.transform(F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1), lambda x: tidy(x))
    long = F.filter(lines, lambda x: F.length(x) >= 15)
    return F.substring(F.when(F.size(long) > 0, F.try_element_at(long, F.lit(1))).otherwise(tidy(text)), 1, 160)


def first_of(text: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words``, in their order, that is part of the text; ``""`` if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(w.lower()), w) for w in words], F.lit(""))


def currency(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(t), code) for t, code in C.CURRENCIES.items()], F.lit(""))


def extract_metadata(docs: DataFrame, text: str = "text", default: str = "2000-01-01") -> DataFrame:
    """``docs`` with seven string columns, ``""`` for what isn't there or where the
    text is null."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({
        "entity_name": entity_name(t), "description": description(t), "market": first_of(t, C.MARKETS), "sector": first_of(t, C.SECTORS), "servicing_team": first_of(t, C.TEAMS), "currency": currency(t),
    })
    return contract_date(d, text, default)
