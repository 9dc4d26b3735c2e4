"""Text expressions: normal form, hashes, heading, keyword hits, n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no such function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def plain(text: Column) -> Column:
    """Lower case, and one blank for each run of anything but a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalise(text: Column) -> Column:
    """The normal form of a text; ``""`` for null.  Take ``normalised`` where most
    texts are ASCII: this one sends every text to Python."""
    return plain(nfkc(F.coalesce(text, F.lit(""))))


def normalised(df, text: str, out: str = "text_norm"):
    """``df`` with the normal form of a text.  Python is given only texts with a
    character beyond ASCII, which alone the compatibility form can change."""
    t = F.coalesce(F.col(text), F.lit(""))
    odd = F.when(~t.rlike(r"^\p{ASCII}*$"), t)
    return df.withColumn(out, plain(F.coalesce(nfkc(odd), t)))


def text_hash(norm: Column) -> Column:
    return F.sha2(norm, 256)


def file_words(name: Column) -> Column:
    """A file name as words: no folder and suffix, camel case and separators split."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\-.]+", " "))


def tidy(text: Column, chars: str = r" ,.\-\t\n") -> Column:
    """White space collapsed, and ``chars`` stripped from both ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), rf"^[{chars}]+|[{chars}]+$", "")


def heading_end(text: Column, lines: int = 3, most: int = 100) -> Column:
    """Where the heading of a text ends: with its first lines, or ``most`` characters."""
    parts = F.split(text, "\n", -1)
    first = F.length(F.array_join(F.slice(parts, 1, lines), "\n"))
    return F.least(F.when(F.size(parts) >= lines, first).otherwise(F.length(text)), F.lit(most))


def alternation(words: Iterable[str]) -> str:
    """One pattern for all words, longest first at any place, each bounded where
    it begins or ends with a word character.  Words that begin alike stand in one
    branch, so that most places of a text are left after a character or two."""
    words = sorted(set(words), key=lambda w: (-len(w), w))
    plain_start = [w for w in words if re.match(r"\w", w)]
    other = [w for w in words if not re.match(r"\w", w)]
    lit = lambda w: re.sub(r"([^\w\s])", r"\\\1", w)
    tail = lambda w: r"\b" if re.search(r"\w$", w) else ""
    key = lambda w: w[:1]
    branches = [lit(k) + "(?:" + "|".join(lit(w[1:]) + tail(w) for w in sorted(g, key=lambda w: (-len(w), w))) + ")" for k, g in groupby(sorted(plain_start, key=key), key=key)]
    out = [r"\b(?:" + "|".join(branches) + ")"] if branches else []
    return "(?U)" + "|".join(out + [lit(w) + tail(w) for w in other])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hits(text: Column, pattern: str, block: int = 64) -> Column:
    """Array of (start, kw) of the matches of ``pattern``, from left to right.  Lengths
    are added up by blocks of matches, so that the work grows with the matches
    and not with their square."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def placed(p: Column) -> Column:
        found, gap = p["found"], p["gap"]
        step = F.zip_with(found, F.slice(gap, F.lit(1), F.size(found)), lambda k, g: F.length(k) + g)
        sums = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int"))), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        start = lambda q, i: total(F.slice(q["sums"], F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(q["step"], (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))) + F.get(gap, i)
        return let(let(step, lambda a: F.struct(a.alias("step"), sums(a).alias("sums"))), lambda q: F.transform(found, lambda k, i: F.struct(start(q, i).alias("start"), k.alias("kw"))))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap")), placed)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of letters inside words, each word with a blank on both sides; a
    padded word shorter than n gives itself once, for the least such n."""
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
    pieces = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) + 3 - n)), lambda p: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), p, n))
    per_word = lambda w: F.flatten(F.transform(F.filter(sizes, lambda n: (n == low) | (F.length(w) + 2 >= n)), lambda n: pieces(w, n)))
    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), per_word))


def word_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the word sets of two normalised texts."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.lit(1), F.size(F.array_union(words(a), words(b))))


def printable(c: Column) -> Column:
    """Without the control characters that spreadsheets refuse."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
