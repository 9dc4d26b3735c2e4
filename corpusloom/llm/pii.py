"""Personal information inside free text, by a semi-Markov conditional random field.

A line is cut into segments: items of kind ``email``, ``phone``, ``id_number``,
``address`` or ``name`` of bounded length, and single characters outside.  The
score of a segment is a weighted sum of features of the *whole* span (its
shape, its digits and groups, words it holds, what stands before and behind),
that of a line the sum over its segments.  ``decode`` finds the best cut by
dynamic programming over the spans that can be an item at all, choosing
boundaries and kinds jointly.  The weights are trained by ``fit`` on labelled
lines (``pii_train``) by conditional likelihood, with forward and backward sums
over the same spans, and lie in ``pii_weights.json``.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import LEGAL, TRADES

KINDS = ("email", "phone", "id_number", "address", "name")
WEIGHTS = Path(__file__).with_name("pii_weights.json")

# Words that stand before, in or behind an item.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Mme|Mlle|Sir|Sheikh|Sheikha|Eng|Capt|MR|MRS|MS|DR|PROF)"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Way|Square|Sq|Court|Ct|Place|Pl|Terrace|Crescent|Highway|Parade|Close|Row|Quay|Alley|STREET|AVENUE|ROAD|LANE|BOULEVARD|ST|RD|AVE|BLVD)"
_UNIT = r"(?:Flat|Villa|Office|Apt|Apartment|Unit|Suite|Room|Floor|House|Building|Bldg|Plot|Shop|Warehouse|Block|FLAT|VILLA|OFFICE|APT|UNIT|SUITE)"
_TOWER = r"(?:Tower|Building|House|Plaza|Centre|Center|Court|Residence|Residences|Heights|Towers|Bldg|TOWER|BUILDING)"
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*)"
_CITY = rf"(?:{_CAP}(?:\s{_CAP}){{0,2}})"
GIVEN = set(
    "ahmed aisha alex alexander ali alice amina andrew andy anil anna anne anthony barbara benjamin bill bob brian carlos catherine charles chris christopher claire "
    "daniel david deepak diana donald dora dorothy dot edward elena elizabeth emily emma eric fatima fatma francis frank george grace greg gregory hannah hassan helen "
    "helena henry hugo husain hussein ibrahim ingrid isabel jack jacob james jane jean jennifer jessica jim joe john jonathan jose joseph julia karen kate katherine "
    "kenneth kevin khalid laura layla leila linda lisa liz louis lucy maria margaret mariam marie mark marcus martin mary matthew meera michael michelle mohammed mohd "
    "mona mustafa nancy natalia nicholas nick noor nora olga olivia omar pat patricia paul peggy peter philip pierre priya rachel rahul rashid rebecca richard rick "
    "robert ronald rosa ruth sam samuel sana sandra sara sarah scott sergei sofia sophia stephen steven sue sunil susan tarek ted theodora theresa thomas tim timothy "
    "vicky victor victoria viktor vincent walter william youssef yusuf zainab".split()
)
_STOP = set(
    "the a an and or of to in on at by for with from this that each either every all any no not as if when where while until unless because after before upon between "
    "subject re fw thanks thank regards sincerely yours dear hello hi attn attention contact person call tel telephone phone mobile fax email mail e-mail write drafts cc bcc from "
    "her his home keys address deliver residing national identity id emirates number passport holder signed statement order reference lot meter street avenue road lane version clause annex "
    "section schedule table invoice vessel rate page date dated ref signature signatory name names witness copy final draft confidential "
    "le la les l’assureur l’emprunteur l'assureur un une des du de chaque ce cette il elle joindre écrire adresse courriel téléphone mobile portable pièce passeport représenté demeurant à monsieur madame "
    "agreement contract letter memo memorandum notice notices".split()
)
_COMPANY = {w for w in TRADES} | {w for f in LEGAL for w in f if len(w) > 2}
# Kinds of words in front of an item and behind it.
_PRE = [
    ("signed", r"(?:(?:signed|prepared|approved|written|witnessed|represented) by|(?:signé|représenté|rédigé)+e?s? par|وقعه|بحضور)\s*$"),
    ("attn", r"(?:attn|attention|à l[’']attention de|f\.?a\.?o|dear|cher|chère)\s*[.:]?\s*$"),
    ("person", r"(?:contact|person|name|nom|author|applicant|patient|tenant|guest|employee|الاسم)\s*:\s*$"),
    ("thanks", r"(?:thanks|regards|sincerely|cordialement|truly|best|yours)\s*,\s*$"),
    ("stated", r"\b(?:of|with|from|to|by|par|avec|de)\s*$"),
    ("mister", r"(?:السيد|السيدة|monsieur|madame)\s*$"),
    ("phone", r"(?:\b(?:tel|tél|telephone|téléphone|phone|mobile|portable|fax|cell|call|ring|dial|whatsapp|voicemail|T|M)|\breach\w*(?: \w+)? (?:on|at)|\b(?:joindre|appel\w*)(?: le)?|هاتف|جوال|اتصل)\s*[.:]*\s*$"),
    ("id", r"(?:\bID|\bidentity(?: number| card)?|\bpassport|\bpasseport|\bidentité|\b(?:social security|national insurance|ssn|pan|tax id|driving licence|licence)|الهوية|جواز السفر)(?:\s*(?:no|number|n[°º]|num))?\s*[.:#°]*\s*$"),
    ("mail", r"(?:\b(?:e-?mail|mail|courriel|mailto|cc|copy|reply to|write to|send(?: \w+)? to|écri\w+ à)|البريد|الإلكتروني|ايميل)\s*:?\s*<?\s*$"),
    ("live", r"(?:\b(?:home|house|flat|office|premises|venue|keys?|residence|address|adresse)\b[^.:]*?(?: is| are| at| in)?|\b(?:residing|resident|lives?|living|dwells?|located|ship(?:ped)?|deliver(?:ed)?|sent|moved|domicil\w+|demeurant)(?: at| in| to| of| au)?|العنوان|يسكن(?: في)?)\s*:?\s*$"),
    ("number", r"\b(?:order|reference|ref|reading|readings|version|model|invoice|docket|clause|chapter|case|file|lot|table|total|units|and|serial|batch|account|meter|counter|index|isbn|iban)\s*(?:no|number|is|shows)?[.:#]*\s*$"),
    ("between", r"\b(?:between|entre|بين)\s*$"),
    ("craft", r"\b(?:vessel|ship|boat|aboard|hotel|yacht|ferry)(?: the)?\s*$"),
]
_POST = [
    ("verb", r"^[,.]?\s*(?:(?:has|had|was|is|will|a|est)\s)?(?:attend\w*|record\w*|sign\w*|declar\w*|confirm\w*|said|says|wrote|agre\w*|resid\w*|born|holder|approv\w*|called|left|absent|présent\w*|déclar\w*)\b"),
    ("hours", r"^\s*(?:on|during|at|before|after|le|between|ext|x)\b"),
    ("goods", r"^\s*(?:units|boxes|pieces|parts|mm|cm|km|kg|metres|lanes|clicks|holds?|replaces?|remains?|and \d|[A-Z]{3}\b|%)"),
    ("bar", r"^\s*\|"),
    ("and", r"^\.?\s+(?:and|et)\s"),
]
# The kind that reaches furthest back is taken, or the first of the list.
_PRE = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PRE), re.I)
_POST = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _POST), re.I)
_STOPS, _LAST, _NEXT = re.compile(r"[.!?]\)?\s*$"), re.compile(r"([^\W\d_]+|[^\w\s])\W*$"), re.compile(r"\W*([^\W\d_]+)")

_AT = r"(?:\s?[@＠]\s?|\s?[(\[{]\s?(?:at|AT|arobase)\s?[)\]}]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+'-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}")
_DIGITS = re.compile(r"(?<![\w.,/-])(?:\+|\()?[\dOo](?:[\dOo]|[ .()/ -](?=[ ()\dO+])){4,26}\d(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w%])")
_CODE = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{5}\d{4}[A-Z]|[A-Z]{1,2}\d{6,9}|\d{3}-\d{2}-\d{4}|784[- ]?\d{4}[- ]?\d{7}[- ]?\d)(?![\w-]|\.\d)")
_ADDRESS = [
    re.compile(rf"(?:{_UNIT}\.? ?(?:No\.? ?)?[\w/-]*\d[\w/-]*,? )?(?:{_CAP}(?: {_CAP})? {_TOWER}, )?(?:(?:No\.? ?)?\d{{1,5}}[A-Z]?,? )?{_CAP}(?: {_CAP}){{0,2}} {_STREET}\b\.?(?: \d{{1,5}}[A-Z]?\b)?(?:, (?:\d{{4,6}} )?{_CITY}(?: \d{{4,6}}\b)?)?"),
    re.compile(rf"\b\d{{1,4}},? (?:bis,? )?(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route) (?:des |du |de la |de l[’']|de |d[’'])?{_CAP}(?: {_CAP}){{0,2}}(?:, \d{{4,6}} {_CITY})?"),
    re.compile(rf"\b(?:P\.? ?O\.? ?Box|PO Box|BP|B\.P\.) \d{{2,7}}(?:, {_CITY})?"),
]
_TOKEN = rf"(?:{_TITLE}\b\.?|[A-ZÀ-ÖØ-Þ]\.(?!\w)|{_CAP})"
_RUN = re.compile(rf"(?<![\w@.’'-]){_TOKEN}(?:(?:,\s|\s){_TOKEN})*(?![\w@])")
_TOK = re.compile(_TOKEN)
_IS_TITLE = re.compile(rf"{_TITLE}\.?$")
_INITIAL = re.compile(r"[A-Z]\.$")
#: Longest span of a name in tokens: the bound of a segment.
NAME_TOKENS = 7


def _class(token: str) -> str:
    if _IS_TITLE.match(token):
        return "T"
    if _INITIAL.match(token):
        return "I"
    base = "XX" if len(token) > 1 and token.upper() == token else "Xx"
    return base + "-" * ("-" in token)


class _Cues:
    """What stands before and behind a place of a line, each place read once."""

    def __init__(self, line: str):
        self.line = line
        self.pre: dict[int, list[str]] = {}
        self.post: dict[int, list[str]] = {}

    def __call__(self, i: int, j: int) -> list[str]:
        if i not in self.pre:
            before = self.line[max(0, i - 40) : i]
            m = _PRE.search(before)
            out = ["pre=" + m.lastgroup] if m else ["pre=" + ("start" if not before.strip() else "stop" if _STOPS.search(before) else "other")]
            if before.rstrip()[-1:] == ":":
                out.append("colon")
            if m := _LAST.search(before):
                out.append("b=" + m.group(1).lower())
            self.pre[i] = out
        if j not in self.post:
            behind = self.line[j : j + 28]
            m = _POST.match(behind)
            out = ["post=" + m.lastgroup] if m else ["post=" + ("end" if not behind.strip(" .)>,") else "stop" if behind[0] in ".,;)>" else "other")]
            if m := _NEXT.match(behind):
                out.append("a=" + m.group(1).lower())
            self.post[j] = out
        return self.pre[i] + self.post[j]


_DIGIT = re.compile(r"\d")
_AT_SIGNS = ("@", "＠", "(at", "( at", "[at", "[ at", "{at", "{ at", "(AT", "( AT", "[AT", "[ AT", "{AT", "{ AT", "arobase", " at ", " AT ")
_ADDRESS_SIGNS = ("St", "Av", "AV", "R", "L", "B", "Dr", "Way", "Sq", "C", "Pl", "Ter", "High", "Par", "Q", "Al", "ST"), ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "cours", "route"), ("Box", "BP", "B.P")
_TOWN = re.compile(r"[^\W\d]\S*(?: [^\W\d]\S*)*$")
_MAILISH = re.compile(r"[@＠]|[(\[{]\s?(?:at|AT|arobase)\s?[)\]}]|\s(?:at|AT)\s\S+\s(?:dot|DOT)\s")
_EXT = re.compile(r"\s?(?:ext|x)\.?\s?\d{1,5}$")
_GROUP = re.compile(r"[\dOo]+")
#: Letters and digits in groups: what an identity number may be, whatever its form.
_MIXED = re.compile(r"(?<![\w.,/@-])(?=[A-Z]{0,6}[ -]?\d)(?:[A-Z]{1,6}+|\d++)(?:[- ]?(?:[A-Z]{1,4}+(?![a-z])|\d++))*+(?![\w@%]|[-/.,]\d)")
_CLOSING = re.compile(r"\s*(?:best |kind |warm )?(?:regards|thanks|wishes|sincerely|cordialement|yours)\b.*,?\s*$", re.I)
_UNIT_IN = re.compile(rf"\b{_UNIT}\b|\b{_TOWER},")


def _ends(line: str, i: int, j: int) -> Iterator[tuple[int, int]]:
    """An address, and the same with fewer of the words at its end as the town: what is
    written next may begin with a capital, too."""
    yield i, j
    comma = line.rfind(", ", i, j)
    if comma > 0 and (m := _TOWN.search(line, comma, j)):
        words = m.group().split(" ")
        for n in range(1, len(words)):
            yield i, j - len(" ".join(words[-n:])) - 1


def _phones(line: str, cues: _Cues) -> Iterator[tuple[int, int, str, list[str]]]:
    for m in _DIGITS.finditer(line):
        i, j = m.span()
        s = m.group()
        core = _EXT.sub("", s)
        groups = [len(g) for g in _GROUP.findall(core)]
        n, sep = sum(groups), "".join(sorted(set(_GROUP.sub("", core)))) or "none"
        lead = "plus" if s[0] == "+" else "paren" if s[0] == "(" else "00" if core.startswith("00") else "0" if core[0] in "0Oo" else "d"
        f = [f"n={n}", "g=" + "-".join(map(str, groups)), "sep=" + sep, f"lead={lead}", f"lead={lead}&n={n}", f"sep={sep}&lead={lead}&k={len(groups)}", *cues(i, j)]
        if core != s:
            f.append("ext")
        f.append("cue&0" if any(x in f for x in ("pre=phone", "post=bar")) else "nocue")
        if line[max(0, i - 5) : i].rstrip()[-1:].isupper() and "pre=phone" not in f:
            f.append("code")
        yield i, j, "phone", f


def _numbers(line: str, cues: _Cues) -> Iterator[tuple[int, int, str, list[str]]]:
    seen = set()
    for p in (_CODE, _MIXED):
        for m in p.finditer(line):
            s, span = m.group(), m.span()
            digits = sum(c.isdigit() for c in s)
            if span in seen or digits < 4:
                continue
            seen.add(span)
            shape = re.sub(r"[A-Z]+", lambda x: "A" * min(len(x.group()), 5), re.sub(r"\d+", lambda x: str(len(x.group())) + ".", s))
            f = ["shape=" + re.sub(r"[- ]", "", shape)[:12], "head=" + ("784" if s.startswith("784") else "9" if s[0] == "9" else "A" if s[0].isalpha() else "d"), f"digits={min(digits, 20)}", "form" if p is _CODE else "noform", *cues(*span)]
            f.append(("idcue&" if "pre=id" in f else "noidcue&") + f[3])
            f += [x + "&" + f[3] for x in f if x.startswith("pre=")]
            yield *span, "id_number", f


def spans(line: str, common: frozenset[str], given: frozenset[str], before: str = "") -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of all spans of ``line`` that can be an item:
    runs of letters, digits or capitalised words of any form, whatever stands
    around them.  ``common``: ordinary words in lower case; ``given``: given
    names; ``before``: the line above."""
    out: list[tuple[int, int, str, list[str]]] = []
    mails: list[tuple[int, int]] = []
    cues = _Cues(line)
    if any(x in line for x in _AT_SIGNS) and _MAILISH.search(line):
        for m in _EMAIL.finditer(line):
            s = m.group()
            mails.append(m.span())
            out.append((*m.span(), "email", ["plain" if re.fullmatch(r"[\w.+'-]+@[\w.-]+", s) else "veiled", *cues(*m.span())]))
    if _DIGIT.search(line):
        out += _phones(line, cues)
        out += _numbers(line, cues)
        for k, p in enumerate(_ADDRESS):
            # a word without which the form can't be there
            if not any(x in line for x in _ADDRESS_SIGNS[k]):
                continue
            for i, j in (e for m in p.finditer(line) for e in _ends(line, *m.span())):
                # a town doesn't end in an ordinary word: that begins the next sentence
                while (last := re.search(r"\s+([^\W\d]+)$", line[i:j])) and (last[1].lower() in common or last[1].lower() in _STOP) and last[1] not in ("Street", "Avenue", "Road", "Lane"):
                    j = i + last.start()
                s = line[i:j].rstrip(" ,")
                j = i + len(s)
                f = [f"form={k}", *cues(i, j)]
                if _UNIT_IN.search(s):
                    f.append("unit")
                f.append(f"town={len(s.rpartition(', ')[2].split())}")
                f.append("cut" if line[j : j + 1] == " " and line[j + 1 : j + 2].isupper() else "whole")
                num = bool(_DIGIT.search(s))
                f += ["num" if num else "nonum", "city" if "," in s and k < 2 else "nocity", f"num&{'city' if ',' in s else 'nocity'}"]
                if sum(w.lower() in common for w in re.findall(r"\w+", s)) >= 2:
                    f.append("common")
                out.append((i, j, "address", f))
    closing = bool(_CLOSING.match(before))
    for m in _RUN.finditer(line):
        toks = [(t.start() + m.start(), t.end() + m.start(), t.group()) for t in _TOK.finditer(m.group())]
        part: list[tuple[int, int, str]] = []
        parts = []
        for t in toks:
            low = t[2].lower().rstrip(".")
            if (low in common or low in _STOP) and low not in given and not _IS_TITLE.match(t[2]) and not _INITIAL.match(t[2]):
                parts.append(part)
                part = []
            else:
                part.append(t)
        parts.append(part)
        for part in parts:
            for x in range(len(part)):
                for y in range(x, min(len(part), x + NAME_TOKENS)):
                    own = part[x : y + 1]
                    cls = [_class(t[2]) for t in own]
                    words = [t for t, c in zip(own, cls) if c[0] == "X"]
                    i, j = own[0][0], own[-1][1]
                    alone = not line[:i].strip() and not line[j:].strip(" .,\r")
                    if not words or cls[-1] in ("T", "I") or "T" in cls[1:] or (len(own) == 1 and not (alone and closing)):
                        continue
                    commas = line[i:j].count(",")
                    if commas > 1:
                        continue
                    f = ["cls=" + (" ".join(cls) if not commas else " ".join(cls) + ","), *cues(i, j)]
                    known = any(t[2].lower().split("-")[0] in given for t in words)
                    f.append("given" if known else "nogiven")
                    firstw = words[-1] if commas else words[0]
                    if firstw[2].lower() in given:
                        f.append("given1")
                    if cls[0] == "T":
                        f.append("title")
                    f.append("left" if x and part[x - 1][1] + 1 >= i else "noleft")
                    f.append("right" if y + 1 < len(part) and part[y + 1][0] <= j + 2 else "noright")
                    around = re.findall(r"[\w.'’/]+", line[j : j + 34])[:2]
                    if any(t[2].lower().replace(".", "").replace("'", "") in _COMPANY for t in words):
                        f.append("trade")
                    if around and (around[0].lower().replace(".", "") in _COMPANY or len(around) > 1 and around[1].lower().replace(".", "") in _COMPANY and around[0][:1].isupper()):
                        f.append("company")
                    if alone:
                        f += ["alone", "alone&" + ("given" if known else "nogiven")]
                        if closing:
                            f.append("closing")
                    if re.match(r"\s?(?:@|＠|[(\[]at)", line[j:]) or any(a <= i < b for a, b in mails):
                        f.append("inmail")
                    who = "title" if cls[0] == "T" else "given" if known else "none"
                    f += [f"{c}&{who}" for c in f if c.startswith(("pre=", "post=")) or c == "colon"]
                    out.append((i, j, "name", f))
    return out


def _names(kind: str, f: Iterable[str]) -> list[str]:
    return [f"{kind}|", *(f"{kind}|{x}" for x in f)]


def score(w: dict[str, float], kind: str, f: Iterable[str]) -> float:
    return sum(w.get(k, 0.0) for k in _names(kind, f))


def decode(cand: list[tuple[int, int, str, list[str]]], w: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best cut: (start, end, kind), without overlaps, in order."""
    c = sorted(((j, i, k, s) for i, j, k, f in cand if (s := score(w, k, f)) > 0), key=lambda x: (x[0], x[1], x[2]))
    if not c:
        return []
    ends = [x[0] for x in c]
    best = [(0.0, -1, -1)]
    for n, (_, i, _, s) in enumerate(c):
        p = bisect_right(ends, i, 0, n)
        take = best[p][0] + s
        best.append((take, n, p) if take > best[n][0] else (best[n][0], -1, n))
    out, at = [], len(c)
    while at > 0:
        _, n, p = best[at]
        if n >= 0:
            out.append((c[n][1], c[n][0], c[n][2]))
        at = p
    return out[::-1]


def _lse(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def likelihood(cand: list, gold: set, w: dict[str, float]) -> tuple[float, list[float]]:
    """(log-likelihood of the gold cut, probability of each span), by forward and
    backward sums; the gold is a set of (start, end, kind)."""
    order = sorted(range(len(cand)), key=lambda n: (cand[n][1], cand[n][0]))
    pos = sorted({0} | {x for c in cand for x in c[:2]})
    at = {x: n for n, x in enumerate(pos)}
    s = [score(w, c[2], c[3]) for c in cand]
    a = [0.0] * len(pos)
    byend: dict[int, list[int]] = {}
    bystart: dict[int, list[int]] = {}
    for n in order:
        byend.setdefault(at[cand[n][1]], []).append(n)
        bystart.setdefault(at[cand[n][0]], []).append(n)
    for p in range(1, len(pos)):
        v = a[p - 1]
        for n in byend.get(p, ()):
            v = _lse(v, a[at[cand[n][0]]] + s[n])
        a[p] = v
    b = [0.0] * len(pos)
    for p in range(len(pos) - 2, -1, -1):
        v = b[p + 1]
        for n in bystart.get(p, ()):
            v = _lse(v, b[at[cand[n][1]]] + s[n])
        b[p] = v
    z = a[-1]
    prob = [math.exp(a[at[c[0]]] + s[n] + b[at[c[1]]] - z) for n, c in enumerate(cand)]
    return sum(s[n] for n, c in enumerate(cand) if tuple(c[:3]) in gold) - z, prob


def fit(lines: list[tuple[list, set]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4) -> dict[str, float]:
    """Weights from (spans, gold) of labelled lines, by gradient steps with
    adaptive rates on the conditional likelihood."""
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    for _ in range(epochs):
        for cand, gold in lines:
            if not cand:
                continue
            _, prob = likelihood(cand, gold, w)
            grad: dict[str, float] = {}
            for c, p in zip(cand, prob):
                d = (tuple(c[:3]) in gold) - p
                if abs(d) > 1e-4:
                    for k in _names(c[2], c[3]):
                        grad[k] = grad.get(k, 0.0) + d
            for k, d in grad.items():
                d -= l2 * w.get(k, 0.0)
                g2[k] = g2.get(k, 0.0) + d * d
                w[k] = w.get(k, 0.0) + rate * d / math.sqrt(g2[k] + 1e-2)
    return w


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    return json.loads(WEIGHTS.read_text())


def find_items(text: str | None, w: dict[str, float], common: frozenset[str], given: frozenset[str]) -> Iterator[tuple[int, int, int, str]]:
    """(line number from 1, start in the text, end, kind) of each item."""
    if not text:
        return
    at, before = 0, ""
    for n, line in enumerate(text.split("\n"), 1):
        if line and not line.isspace():
            for i, j, kind in decode(spans(line, common, given, before), w):
                yield n, at + i, at + j, kind
            before = line
        at += len(line) + 1


def _lists(common: Iterable[str], given: Iterable[str]) -> tuple[frozenset[str], frozenset[str]]:
    g = frozenset(x.lower() for x in given) | frozenset(GIVEN)
    return frozenset(x.lower() for x in common) - g, g


def personal_items(docs: DataFrame, doc_id: str, text: str, common: Iterable[str] = (), given: Iterable[str] = ()) -> DataFrame:
    """(doc_id, line_no, start, end, kind) of each item; offsets in code points.

    ``common`` and ``given`` are fixed word lists.  Null, empty and blank texts
    have no item.  Repeated rows give repeated items.  Texts are read whole; the
    work grows with their length.
    """
    com, giv = _lists(common, given)
    w = weights()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(d, *item) for d, t in zip(pdf["d"], pdf["t"]) for item in find_items(t, w, com, giv)]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "start", "end", "kind"])

    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, line_no int, start int, end int, kind string")


def redacted(docs: DataFrame, doc_id: str, text: str, common: Iterable[str] = (), given: Iterable[str] = ()) -> DataFrame:
    """(doc_id, text, items): each item replaced by its kind in brackets, such as
    ``[EMAIL]``, the rest of the text letter for letter.  A null text stays null."""
    com, giv = _lists(common, given)
    w = weights()
    kind = docs.schema[doc_id].dataType.simpleString()

    def clean(t: str | None) -> tuple[str | None, int]:
        if t is None:
            return None, 0
        out, at, n = [], 0, 0
        for _, i, j, k in find_items(t, w, com, giv):
            out += [t[at:i], f"[{k.upper()}]"]
            at, n = j, n + 1
        return "".join([*out, t[at:]]), n

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [clean(t) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["d"], "text": [x for x, _ in got], "items": [n for _, n in got]})

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, text string, items int")
