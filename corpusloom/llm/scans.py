"""Noise in text from scanned pages: running lines, broken words, misread letters.

* Running headers, footers and page numbers are lines of one record that stand
  at page boundaries and are alike from page to page, misreadings allowed for.
* A word broken at a line's end goes on in the next line that isn't one of
  those; it counts as broken if the joined word is known, or the parts aren't.
* Misread words are looked up in a symmetric-delete index over the frequency
  lexicon of the whole corpus: a word and a token are compared if they have a
  form in common after leaving out up to two letters each.  A weighted edit
  distance, cheap for letters a scanner confuses and dearer for any letter put
  in, left out or replaced, and the count of the pair with the word before
  choose the repair.  A frequent misreading isn't taken for a word: it is a cheap
  distance from one that is far more frequent.

Counts cover all records.  A word is known from ``LEAST`` occurrences on; the
lexicon sent to the tasks holds the ``WORDS`` most frequent ones (and ``PAIRS``
pairs), so it is bounded whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, drop

#: Words and pairs of words in the lexicon at most, by frequency.
WORDS = 20_000
PAIRS = 200_000
#: Occurrences from which a word is known.
LEAST = 20
#: Letters of the longest word that others are repaired to: the index of a word grows with
#: their square.  Longer ones are known, too.
LETTERS = 60
#: How much more frequent a word is than what is taken for a misreading of it, if any
#: letter may be wrong.
FAR = 50

#: Forms beside the page numbers up to which each two are compared directly: cheaper
#: than an index of their pieces, with the same result.
FEW = 24

# What is printed, what a scanner may see instead, and the cost.
CONFUSED = {
    ("m", "rn"): 0.3, ("rn", "m"): 0.5, ("d", "cl"): 0.3, ("cl", "d"): 0.5, ("w", "vv"): 0.3, ("u", "ii"): 0.3, ("in", "m"): 0.4, ("li", "h"): 0.4, ("h", "li"): 0.4, ("ri", "n"): 0.5, ("nn", "m"): 0.5, ("n", "ri"): 0.5,
    ("o", "0"): 0.1, ("l", "1"): 0.1, ("i", "1"): 0.1, ("i", "l"): 0.3, ("l", "i"): 0.3, ("s", "5"): 0.1, ("a", "@"): 0.1, ("b", "6"): 0.1, ("g", "9"): 0.1, ("z", "2"): 0.1, ("b", "8"): 0.1, ("e", "c"): 0.3, ("c", "e"): 0.3, ("t", "f"): 0.3, ("f", "t"): 0.3,
    ("h", "b"): 0.3, ("b", "h"): 0.3, ("g", "q"): 0.3, ("q", "g"): 0.3, ("i", "j"): 0.4, ("a", "o"): 0.5, ("o", "a"): 0.5, ("i", "!"): 0.1, ("l", "!"): 0.1, ("l", "|"): 0.1, ("i", "|"): 0.1, ("t", "l"): 0.5, ("l", "t"): 0.5, ("v", "y"): 0.5, ("y", "v"): 0.5, ("e", "o"): 0.5, ("n", "u"): 0.4, ("u", "n"): 0.4, ("s", "$"): 0.1, ("e", "3"): 0.1, ("a", "4"): 0.1,
}
MOST = 1.0
ANY = 0.9
#: Words of the language that need no corpus to be trusted.
COMMON = (
    "a about after again all also am an and any are as at back be been before being both but by can could did do does done down each end even ever few first for from get give go goes good had has have he her here him his how i if in into is it its "
    "just last less let like long made make many may me might more most much must my need never new next no nor not now of off old on once one only open or other our out over own part per please put read same say see send set shall she should show so "
    "some such take text than that the their them then there these they this those through time to too two under until up upon us use used very view was way we well were what when where which while who whom whose why will with within without would write year yes yet you your"
).split()
_EDGE = "\"'“”‘’«»()[]{}<>.,;:?*"
_PAGE = re.compile(r"^\W*(?:p\s?a\s?g\s?e|pg\s?\.?|p\s?\.|page|folio|sheet|seite)\W*([\dOoIl|]+)(?:\s*(?:/|of|von|de)\s*[\dOoIl|]+)?\W*$|^\s*[-–—~\[(<|]+\s*([\dOIl]+|[ivxlcdm]+)\s*[-–—~\])>|]+\s*$|^\s*([\dOIl]+)\s*(?:/|of)\s*[\dOIl]+\s*$", re.I)
_BARE = re.compile(r"^\s*(\d+|[ivxlcdm]+)\s*$", re.I)
_DIGITS = re.compile(r"\d+")
_SIGN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

_BROKEN = re.compile(r"([^\W\d_][\w@'’]*)[-‐‑¬­_]\s*$")
_FIRST = re.compile(r"\s*([\w@'’]+)")


def weighted(word: str, token: str, most: float = MOST, any_letter: float | None = ANY) -> float:
    """Cost of reading ``token`` where ``word`` is printed: that of the confusions, and
    ``any_letter`` for a letter put in, left out or replaced (None: not at all)."""
    n, m = len(word), len(token)
    if abs(n - m) > 2:
        return most + 1
    d = [[99.0] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            v = d[i][j]
            if v > most:
                continue
            if i < n and j < m and word[i] == token[j]:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], v)
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m and (c := CONFUSED.get((word[i : i + a], token[j : j + b]))) is not None:
                        d[i + a][j + b] = min(d[i + a][j + b], v + c)
            if any_letter is not None:
                for a, b in ((1, 1), (1, 0), (0, 1)):
                    if i + a <= n and j + b <= m:
                        d[i + a][j + b] = min(d[i + a][j + b], v + any_letter)
    return d[n][m]


def _forms(w: str) -> set[str]:
    out = {w}
    for k in (1, 2):
        if len(w) > k:
            out.update("".join(w[i] for i in range(len(w)) if i not in cut) for cut in combinations(range(len(w)), k))
    return out


_IS_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Lexicon:
    """Trusted words with counts, pairs of words, and the symmetric-delete index.
    ``trusted`` are those of a lexicon built before from the same counts."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], known: Iterable[str], trusted: Iterable[str] | None = None):
        base = {w.lower() for w in known if w} | set(COMMON)
        self.count = {**{w: 1 for w in base}, **words}
        self.pairs = pairs
        self.index: dict[str, list[str]] = {}
        self.words: set[str] = set()
        self.longest = 0
        self.memo: dict[str, list[tuple[float, str]]] = {}
        for w in self._trusted(base) if trusted is None else trusted:
            self.words.add(w)
            if 2 <= len(w) <= LETTERS:
                self.longest = max(self.longest, len(w))
                for f in _forms(w):
                    self.index.setdefault(f, []).append(w)

    def _trusted(self, base: set[str]) -> Iterator[str]:
        # The most frequent first, so that a misreading meets the word it stands for.
        for w in sorted(self.count, key=lambda w: (w not in base, -self.count[w], w)):
            if (w in base or self.count[w] >= LEAST) and _IS_WORD.fullmatch(w):
                if w in base or not any(self.count[v] >= (2 if v in base else 8) * self.count[w] for _, v in self._met(w, None)):
                    yield w

    def _met(self, token: str, any_letter: float | None) -> list[tuple[float, str]]:
        if len(token) > self.longest + 2:
            return []
        seen = {w for f in _forms(token) for w in self.index.get(f, ())} - {token}
        return sorted((c, w) for w in seen if (c := weighted(w, token, MOST, any_letter)) <= MOST)

    def near(self, token: str) -> list[tuple[float, str]]:
        """(cost, word) of the words that ``token`` may stand for, best first.

        Any letter may be wrong only if no confusion explains the token, inside a
        word of six letters or more (at its ends it is another form of the word,
        not a misreading), and if the word is far more frequent."""
        got = self.memo.get(token)
        if got is None:
            got = []
            if len(token) >= 2:
                got = self._met(token, None)
                if not got and len(token) >= 6:
                    own = FAR * max(1, self.count.get(token, 1))
                    got = [(c, w) for c, w in self._met(token, ANY) if len(w) >= 6 and w[0] == token[0] and w[-2:] == token[-2:] and self.count[w] >= own]
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = got
        return got

    def repair(self, token: str, before: str) -> str | None:
        """The word that ``token`` stands for after ``before``; None if it is one
        itself, or none fits."""
        if token in self.words:
            return None
        near = self.near(token)
        if not near:
            return None
        return min(near, key=lambda x: (x[0] - 0.1 * math.log1p(self.count.get(x[1], 0)) - 0.25 * math.log1p(self.pairs.get((before, x[1]), 0)), x[1]))[1]


def _number(s: str) -> int:
    if s.isdigit():
        return int(s) if len(s) < 10 else -1
    v = [_SIGN[c] for c in s]
    return sum(-x if x < y else x for x, y in zip(v, v[1:] + [0]))


def _form(x: str) -> str:
    """A running line without case, numbers and double blanks."""
    return _DIGITS.sub("#", " ".join(x.lower().split()))


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance; more than ``most`` where it is more."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i, n = 0, min(len(a), len(b))
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b or abs(len(a) - len(b)) > most:
        return len(a) + len(b) if abs(len(a) - len(b)) > most else max(len(a), len(b))
    if len(b) > 100:
        x, at = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
        row = at.copy()
        for k, c in enumerate(a, 1):
            new = np.minimum(row + 1, np.concatenate([[k], row[:-1] + (x != ord(c))]))
            row = np.minimum.accumulate(new - at) + at
            if row.min() > most:
                return most + 1
        return int(row[-1])
    row = list(range(len(b) + 1))
    for k, c in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def _near(a: str, b: str) -> bool:
    """Whether two forms are the same but for a few misread letters."""
    if a == b:
        return len(a) > 3
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 3:
        return False
    if len(a) < len(b):
        a, b = b, a
    most, q = _pieces(len(a))
    # with so few edits one of the pieces is whole, at about its place
    return any(b.find(a[i : i + q], max(0, i - most), i + q + most) >= 0 for i in range(0, q * (most + 1), q)) and _distance(a, b, most) <= most


def _pieces(n: int) -> tuple[int, int]:
    """(most edits of the longer of two near forms, of ``n`` letters, length of a piece):
    of so many pieces and one more, one is whole in the other form."""
    most = max(2, n // 8)
    return most, n // (most + 1)


def _twins(forms: Iterable[str]) -> dict[str, set[str]]:
    """The near forms, itself left out, of each form that has any.  Only forms with a
    piece in common at about the same place are compared; no near one is
    without."""
    forms = list(forms)
    out: dict[str, set[str]] = {}
    index: dict[tuple[int, int, str], list[str]] = {}
    for g in forms:
        if len(g) >= 8:
            for q in {_pieces(n)[1] for n in range(len(g), len(g) + 4)}:
                for i in range(len(g) - q + 1):
                    index.setdefault((len(g), i, g[i : i + q]), []).append(g)
    for f in forms:
        if len(f) < 8:
            continue
        most, q = _pieces(len(f))
        tried = {f}
        for n in range(len(f) - 3, len(f) + 1):
            for i in range(0, q * (most + 1), q):
                for j in range(max(0, i - most), i + most + 1):
                    for g in index.get((n, j, f[i : i + q]), ()):
                        if g not in tried:
                            tried.add(g)
                            if _near(f, g):
                                out.setdefault(f, set()).add(g)
                                out.setdefault(g, set()).add(f)
    return out


def _again(forms: Counter[str]) -> set[str]:
    """The forms that come again, misreadings allowed for."""
    out = {f for f, n in forms.items() if n > 1 and len(f) > 3}
    if len(forms) > FEW:
        return out | set(_twins(forms))
    for f, g in combinations(forms, 2):
        if not (f in out and g in out) and _near(f, g):
            out |= {f, g}
    return out


def furniture(lines: list[str]) -> set[int]:
    """Positions of running headers, footers and page numbers."""
    at = [k for k, x in enumerate(lines) if x and not x.isspace()]
    if len(at) < 2:
        return set()
    pages = {k for k in at if _PAGE.match(lines[k])}
    bare = [(k, _number(m.group(1).lower())) for k in at if (m := _BARE.match(lines[k]))]
    want = 1
    for k, v in bare:
        # bare numbers count from 1 on, one after the other
        if v == want and (want > 1 or len(bare) > 1 or k == at[-1]):
            pages.add(k)
            want += 1
    out = set(pages)
    place = {k: n for n, k in enumerate(at)}
    order = sorted(pages)
    nxt = lambda k, d: at[place[k] + d] if 0 <= place[k] + d < len(at) else None
    form: dict[int, str] = {}

    def f(k: int) -> str:
        if k not in form:
            form[k] = _form(lines[k])
        return form[k]

    # Lines beside the page numbers, by how far from them: alike on two pages or more.
    if order:
        for d in (1, 2):
            for group in ([at[d - 1], *(x for k in order if (x := nxt(k, d)) is not None)], [x for k in order if (x := nxt(k, -d)) is not None]):
                group = list(dict.fromkeys(group))
                again = _again(Counter(f(k) for k in group)) if len(group) > 1 else ()
                out.update(k for k in group if f(k) in again)
    # Lines that come again and are no sentences: at the top, beside other such lines,
    # in the middle of a sentence, at the end, or to be filled in on each page.
    same: dict[str, list[int]] = {}
    for k in at:
        x = lines[k].strip()
        if len(x) > 4 and x[-1] not in ".,;":
            same.setdefault(_DIGITS.sub("#", " ".join(x.split())), []).append(k)
    top, tail = set(at[:2]), set(at[-4:])
    # the forms that others may be a misreading of
    anchors = [g for g, ks in same.items() if len(g) >= 8 and (len(ks) > 1 or ks[0] in top or ks[0] in out)]
    twin: dict[str, set[str]] = {}
    for g in same:
        for a in anchors:
            if -4 < len(g) - len(a) < 4 and g is not a and _near(g, a) and not g.startswith(a) and not a.startswith(g):
                twin.setdefault(a, set()).add(g)
    beside = lambda k: any(nxt(k, d) in out for d in (1, -1))

    def breaks(k: int) -> bool:
        a, b = nxt(k, -1), nxt(k, 1)
        return a is not None and b is not None and not _SENTENCE.search(lines[a].rstrip()) and lines[b].strip()[:1].islower()

    for _ in range(2):
        for g, own in same.items():
            ks = sorted({*own, *(k for x in twin.get(g, ()) for k in same[x])})
            if len(ks) < 2 or out.issuperset(ks):
                continue
            near = sum(map(beside, ks))
            if near and ks[-1] == at[-1] or not g[0].islower() and (ks[0] in top or not tail.issuperset(ks) and (near > 1 or "___" in g or any(map(breaks, ks)))):
                out.update(ks)
    return out


_SENTENCE = re.compile(r"[.!?:]['\")\]]*$")


def _tokens(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", line)]


def analyse(text: str, lex: Lexicon, repair: bool = False) -> tuple[list[tuple[int, str]], str | None]:
    """((line number from 1, kind), ...) and, if asked for, the repaired text."""
    lines = text.split("\n")
    skip = furniture(lines)
    found = [(k + 1, "furniture") for k in sorted(skip)]
    body = [k for k in range(len(lines)) if k not in skip and lines[k] and not lines[k].isspace()]
    words, pieces = lex.words, {k: lines[k] for k in body}
    joined: dict[int, tuple[int, int]] = {}
    starts: dict[int, int] = {}
    misread: set[int] = set()
    fixes: dict[int, list[tuple[int, int, str]]] = {}
    for n, k in enumerate(body):
        line = lines[k]
        if n + 1 < len(body) and line.rstrip()[-1:] in "-‐‑¬­_" and (m := _BROKEN.search(line)) and (f := _FIRST.match(lines[body[n + 1]])):
            a, b = m.group(1), f.group(1)
            if b[0].islower() or b[0] in "@015689" or a.isupper() and b[0].isupper():
                whole = (a + b).lower()
                known = whole in words
                fix = None if known else lex.repair(whole, "")
                if known or fix or not (a.lower() in words and b.lower() in words):
                    found.append((k + 1, "hyphen"))
                    joined[k] = (m.start(1), f.end(1))
                    starts[body[n + 1]] = f.end(1)
                    if fix and a[0].islower():
                        # whose part of the word has the wrong letters
                        cut = 0
                        while cut < len(fix) and fix[: cut + 1] == whole[: cut + 1]:
                            cut += 1
                        misread.add(k if cut < len(a) else body[n + 1])
                    pieces[k] = line[: m.start(1)] + (fix if fix and a[0].islower() else a + b) if repair else line
                    continue
    before = ""
    for n, k in enumerate(body):
        line = lines[k]
        lo, hi = starts.get(k, 0), joined[k][0] if k in joined else len(line)
        plain = line.upper() == line
        fresh = n == 0 or before == "" or bool(_SENTENCE.search(lines[body[n - 1]].rstrip()))
        prev = before
        for i, j in _tokens(line[:hi]):
            if i < lo:
                continue
            raw = line[i:j]
            t = raw.strip(_EDGE)
            low = t.lower()
            if low in words or len(t) < 2:
                prev, fresh = low, raw[-1] in ".:!?"
                continue
            hit = None
            letters = sum(c.isalpha() for c in t)
            if letters >= 2 and letters + sum(c in "@0156892!|$34" for c in t) == len(t) and letters * 2 > len(t) - 1:
                if t[0].isupper() and not plain:
                    # a capital begins a name, unless a sentence begins there
                    nxt = line[j:].split(None, 1)[:1]
                    ok = (fresh or not line[:i].strip() or re.fullmatch(r"\W*\d+\.\s*", line[:i]) is not None) and (raw.endswith(":") or bool(nxt) and (nxt[0][:1].islower() or not nxt[0][:1].isalpha()) or not nxt) and t[1:].lower() == t[1:]
                    hit = lex.repair(low, prev) if ok else None
                elif plain:
                    hit = lex.repair(low, prev) if t.isalpha() and len(t) > 3 or any(c.islower() for c in t) or re.search(r"[@0156]", t) else None
                    hit = hit if hit and lex.near(low)[0][0] <= 0.5 else None
                else:
                    hit = lex.repair(low, prev)
            if hit:
                misread.add(k)
                off = raw.find(t)
                if repair:
                    new = hit.upper() if plain else hit.capitalize() if t[0].isupper() else hit
                    fixes.setdefault(k, []).append((i + off, i + off + len(t), new))
                prev = hit
            else:
                prev = low
            fresh = raw[-1] in ".:!?"
        before = prev
    found += [(k + 1, "misread") for k in sorted(misread)]
    if not repair:
        return found, None
    out: list[str] = []
    last, widest = -1, max((len(lines[x]) for x in body), default=0)
    for n, k in enumerate(body):
        s = pieces[k]
        for i, j, w in reversed(fixes.get(k, [])):
            s = s[:i] + w + s[j:]
        cut = starts.get(k, 0)
        s = s[cut:].strip() if cut else s.strip()
        blank = any(not lines[x].strip() for x in range(last + 1, k) if x not in skip) if last >= 0 else False
        prevline = out[-1] if out else ""
        new = not out or blank and bool(_SENTENCE.search(prevline)) or re.match(r"(?:\d+|[a-z])[.)]\s|[-•*]\s", s) or bool(_SENTENCE.search(prevline)) and not s[:1].islower() and len(lines[body[n - 1]]) < 0.75 * widest or lines[k].upper() == lines[k] or prevline.upper() == prevline
        if cut and out:
            out[-1] += s if s[:1] in ".,;:" else (" " + s if s else "")
        elif new:
            out.append(s)
        else:
            out[-1] += " " + s
        last = k
    return found, "\n".join(x for x in out if x)


#: Counts held in a task before they are handed on.
HELD = 400_000
_BREAK = re.compile(r"\S+[-‐‑¬­_][ \t]*\n\s*\S+")


def _most_frequent(counts: DataFrame, most: int) -> list:
    return counts.orderBy(F.desc("n"), "a", "b").limit(most).collect()


def corpus_lexicon(docs: DataFrame, text: str, known: Iterable[str]) -> Lexicon:
    """Counts of words and of pairs of words over all texts of ``docs``.  The parts of
    a word broken at a line's end aren't words."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one: Counter = Counter()
        two: Counter = Counter()

        def rows() -> pd.DataFrame:
            c: Counter = Counter()
            for a, n in one.items():
                c[a.strip(_EDGE), ""] += n
            for (a, b), n in two.items():
                a, b = a.strip(_EDGE), b.strip(_EDGE)
                if a and b and a[-1].islower() and b[0].islower():
                    c[a, b] += n
            one.clear()
            two.clear()
            return pd.DataFrame([(a, b, n) for (a, b), n in c.items()], columns=["a", "b", "n"])

        for pdf in parts:
            for t in pdf["t"]:
                if any(x + "\n" in t for x in "-‐‑¬­_"):
                    t = _BREAK.sub("\n", t)
                for line in t.split("\n"):
                    w = line.split()
                    one.update(w)
                    two.update(zip(w, w[1:]))
                if len(one) + len(two) > HELD:
                    yield rows()
        yield rows()

    raw = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "a string, b string, n long")
    # A word counts where it is written in lower case, or all in capitals.
    lower = (F.lower("a") == F.col("a")) | (F.upper("a") == F.col("a"))
    c = raw.where(lower & F.col("a").rlike(r"^[\p{L}'’@0-9|!$-]+$")).groupBy(F.lower("a").alias("a"), F.lower("b").alias("b")).agg(F.sum("n").alias("n"))
    c = cut(c.where("n >= 3"), "counts")
    words = {r["a"]: r["n"] for r in _most_frequent(c.where("b = ''"), WORDS)}
    pairs = {(r["a"], r["b"]): r["n"] for r in _most_frequent(c.where("b <> ''"), PAIRS)}
    drop(c)
    return Lexicon(words, pairs, known)


def scan_noise(docs: DataFrame, idx: str, text: str, known: Iterable[str] = (), repair: bool = False) -> DataFrame:
    """(idx, line_no, kind) of the noisy lines, or with ``repair`` (idx, text) with
    continuous paragraphs instead.

    Null texts have no row; an empty text has no line that counts and is repaired
    to an empty one.  Repeated rows give repeated results.  Texts are read whole.
    ``known`` is a fixed list of ordinary words; words frequent in the corpus
    needn't be in it.
    """
    known = [w for w in known if w]
    lex = corpus_lexicon(docs, text, known)
    data = docs.sparkSession.sparkContext.broadcast((dict(lex.count), lex.pairs, known, sorted(lex.words)))
    kind = docs.schema[idx].dataType.simpleString()
    cache: dict[str, Lexicon] = {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache.setdefault("lex", Lexicon(*data.value))
        for pdf in parts:
            got = [(i, *analyse(t, cache["lex"], repair)) for i, t in zip(pdf["i"], pdf["t"])]
            yield pd.DataFrame([(i, x) for i, _, x in got], columns=["idx", "text"]) if repair else pd.DataFrame([(i, n, k) for i, f, _ in got for n, k in f], columns=["idx", "line_no", "kind"])

    schema = f"idx {kind}, text string" if repair else f"idx {kind}, line_no int, kind string"
    return docs.where(F.col(text).isNotNull()).select(F.col(idx).alias("i"), F.col(text).alias("t")).mapInPandas(run, schema)
