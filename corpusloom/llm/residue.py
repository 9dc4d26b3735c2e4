"""Template residue, filler, error pages and notices in place of content.

1. Texts with the same words, numbers and identifiers left out, are one *class*.
2. Trusted labels: a class is residue if cues of several kinds (that something
   failed, what of a viewer or server it was, what to do about it, a status
   code) make up enough of a text without clauses, or if filler makes up most
   of it; it is genuine if it is made of clauses.  Filler words are learned from
   the corpus: those that mostly stand in lines with well-known filler.
3. Near-duplicate classes are found with partitioned SimHash tables: fingerprints
   of 512 bits, and tables keyed by parts of them, of which one bit may differ.
   Two classes at the similarity differ in a fifth of the bits or less on
   average.  A key has as many bits as the logarithm of the number of classes
   (16 at least), so that buckets don't grow with it, and there are as many
   tables as such keys need to meet at the similarity.  Candidates are verified
   by Hamming distance and by the similarity of their words.
4. Trusted residue labels spread through the connected components of these
   links, unless a component holds a genuine class.  Links between two genuine
   classes change nothing and aren't looked for; genuine classes are looked up
   only for components to which a label would spread.
5. Unfilled fields and filler passages inside other texts mark those texts
   themselves, never their near-duplicates, in which the field may be filled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, drop
from .components import connected_groups

SIMILAR = 0.8
#: 64-bit words of a fingerprint, and most bits in which near-duplicates differ:
#: at the similarity 0.12 to 0.19 of them do on average, in unrelated texts half.
WIDTH = 8
BITS = 128
#: Share of all words, and number, of the cues of a text that is a message.
CUES, CUE_SHARE = 2, 0.1

# Words and phrases of messages by kind; what clauses and filler say.
_CUE_WORDS = {
    "failure": "error errors exception failed failure failing unavailable unauthorised unauthorized forbidden denied expired timed timeout broken unsupported outdated disabled blocked blocks oops whoops sorry damaged corrupt corrupted unexpected gone crashed offline unreachable invalid missing",
    "machine": "javascript script scripts scripting noscript cookie cookies browser viewer reader url link http https server gateway website webpage login cache plugin proxy administrator webmaster loading rendering fetching redirect page site session",
    "remedy": "enable enabled reload refresh retry activate upgrade update install required requires needs needed wait continue allow switch contact",
}
_CUE_OF = {w: kind for kind, words in _CUE_WORDS.items() for w in words.split()}
_CUE_PHRASES = (
    ("failure", r"\b(?:can ?not|can't|could not|couldn't|unable to|not (?:found|supported|available|exist)|went wrong|too old|out of date|no longer (?:available|exists)|bad (?:request|gateway)|temporarily|(?:has|have) ended|(?:turned|switched) off|nothing appears|do not have permission|too many requests)\b"),
    ("machine", r"\b(?:java script|active (?:scripting|content)|(?:internal|service|server) (?:error|unavailable)|trace id|be (?:shown|displayed|opened|loaded|rendered)|status code)\b"),
    ("remedy", r"\b(?:try again|(?:turn|switch) on|(?:sign|log) in|(?:go|head) back|please wait|open it again|to (?:view|read|see|display|open) (?:this|the|your))\b"),
    ("code", r"\b(?:http|error|status|code)\W{0,3}[45]\d\d\b|\([45]\d\d\)|^\W*[45]\d\d\b"),
)
_CUE_PHRASES = tuple((kind, re.compile(p)) for kind, p in _CUE_PHRASES)
_CLAUSE = re.compile(r"\b(?:shall|must be|undertakes? to|agrees? to|is entitled to|is required to|accepts? to|promises? to|may (?:not )?[a-z]+ the|will [a-z]+ the)\b|^(?:dated|client|company name|reference)\s*:|this agreement|pleased to confirm", re.I | re.M)
_FILLER = ("lorem ipsum", "dummy text", *(f"{a} text {b}" for a in ("sample", "placeholder", "example") for b in ("here", "only", "goes")), *(f"{a} text {b}here" for a in ("your", "enter", "enter your", "insert", "insert your", "add", "add your", "type", "type your") for b in ("", "goes ")), "body copy to follow", "text to follow", "copy to come")
_TEMPLATE = re.compile(r"\btemplate\s*[-–—:]\s*do\s+not\s+use\b", re.I)
_KEYS = frozenset("asdf qwer qwerty xxx foo bar test".split())
_FIELD_WORD = r"(?:party|client|customer|company|counterparty|supplier|vendor|employee|name|names|date|effective|start|end|expiry|fee|fees|amount|price|sum|rate|currency|governing|law|jurisdiction|notice|period|term|duration|signatory|signature|signer|address|title|position|role|email|phone|number|no|city|country|place|reference|project|description|details|scope|contract|agreement|first|last|full|legal|registered|office|contact|person|your|day|month|year|a|b|c|1|2)"
_ASK = r"(?:please\s+)?(?:insert|complete|enter|fill\s+in|specify|add|state|tbc|tbd|to\s+be\s+(?:confirmed|completed|inserted|agreed|advised))\b"
_CODE = r"[A-Za-z][A-Za-z]*(?:[_.\- ][A-Za-z0-9]+){0,4}"
# What an unfilled field begins with, and how it goes on: what stands between the
# marks is a name of something, a request to fill it in, or dots.
_FIELDS = tuple(
    (sign, re.compile(p, re.I if fold else 0))
    for sign, fold, p in (
        ("{{", 1, r"\{\{\s*[#/^]?[\w.\- ]+?\s*\}\}"), ("${", 1, r"\$\{\s*[\w.\- ]+?\s*\}"), ("{", 1, rf"(?<![\w{{$])\{{\s*{_CODE}\s*\}}(?!\}})"), ("%%", 1, r"%%\s*\w[\w.\- ]*?\s*%%"), ("%", 0, r"(?<![\w%])%[A-Z][A-Z_]+%(?!\w)"),
        ("@@", 1, r"@@\s*\w[\w.\- ]*?\s*@@"), ("«", 1, r"«\w[\w.\-]*»"), ("<<", 1, r"<<\s*\w[\w.\- ]*?\s*>>"), ("<", 0, r"<[A-Z][A-Z0-9]+(?:[_ ][A-Z0-9]+)*>"), ("##", 0, r"##\s*[A-Z][A-Z_ ]+##"), ("__", 0, r"(?<!_)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!_)"),
        ("[[", 1, rf"\[\[\s*{_CODE}\s*\]\]"), ("[", 1, rf"\[\s*{_ASK}[^\]>)\n]*(?:\n[^\]>)\n]*)?[\]>)]|\[\s*[●•∙○◦.…_*]+\s*\]"), ("(", 1, rf"\(\s*{_ASK}[^\]>)\n]*(?:\n[^\]>)\n]*)?[\]>)]"), ("<", 1, rf"<\s*{_ASK}[^\]>)\n]*(?:\n[^\]>)\n]*)?[\]>)]"),
    )
)
_BRACKET = re.compile(rf"\[\s*({_FIELD_WORD}(?:\s+{_FIELD_WORD}){{0,3}})\s*\]", re.I)
_LOW_FIELDS = (("click", re.compile(r"\bclick\s+(?:here\s+)?(?:or\s+tap\s+)?to\s+(?:add|enter|insert)\b")), ("xx", re.compile(r"\bxx[./-]xx[./-](?:xx|\d\d)(?:xx)?\b")), ("yyyy", re.compile(r"\b(?:dd[./ -]mm[./ -]yyyy|mm[./-]dd[./-]yyyy|yyyy-mm-dd)\b")))
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+|(?=[a-f]*\d)[0-9a-f]{4,}")
_EDGE = "\"'“”‘’«»()[]{}<>.,;:?!*/\\-–—_=|#•●"


def has_field(text: str, low: str | None = None) -> bool:
    """Whether an unfilled field stands in the text."""
    for sign, p in _FIELDS:
        if sign in text and p.search(text):
            return True
    if "[" in text and any(m.group(1)[0].isupper() and all(w[0].isupper() or w[0].isdigit() for w in m.group(1).split()) and not m.group(1).isdigit() for m in _BRACKET.finditer(text)):
        return True
    low = text.lower() if low is None else low
    return any(sign in low and p.search(low) for sign, p in _LOW_FIELDS)


def _stock(text: str, low: str, words: list[str]) -> bool:
    """Whether well-known filler stands in the text."""
    flat = None
    if "text" in low or "copy" in low or "lorem" in low:
        flat = " ".join(words)
        if any(x in flat for x in _FILLER):
            return True
    if "template" in low and _TEMPLATE.search(text):
        return True
    if not _KEYS.isdisjoint(words):
        run = 0
        for w in words:
            run = run + 1 if w in _KEYS else 0
            if run >= 3:
                return True
    return False


def has_filler(text: str, filler: set[str], run: int = 5) -> bool:
    """Whether a passage of ``run`` words or more is filler."""
    low = text.lower()
    words = low.replace(".", " ").replace(",", " ").split()
    return _stock(text, low, words) or _passage(low, words, filler, run)


def _passage(low: str, words: list[str], filler: set[str], run: int = 5) -> bool:
    if filler.isdisjoint(words):
        return False
    got = 0
    for w in _WORD.findall(low):
        got = got + 1 if w in filler else max(0, got - 2)
        if got >= run:
            return True
    return False


def cues(low: str, words: list[str]) -> Counter:
    """Number of cues of each kind in a text in lower case."""
    got = Counter(_CUE_OF[w] for w in words if w in _CUE_OF)
    for kind, p in _CUE_PHRASES:
        if n := sum(1 for _ in p.finditer(low)):
            got[kind] += n
    return got


def trust(text: str, filler: set[str], clauses: int | None = None) -> int:
    """1: certainly residue, -1: certainly genuine, 0: neither."""
    low = text.lower().replace("’", "'")
    if clauses is None:
        clauses = sum(1 for _ in zip(_CLAUSE.finditer(text), range(2)))
    words = _WORD.findall(low)
    if not words:
        return 0
    dull = sum(w in filler for w in words) > 0.6 * len(words)
    if clauses:
        return -1 if clauses == 2 and not dull else 0
    said = cues(low, words)
    if len(said) >= 2 and said.total() >= max(CUES, CUE_SHARE * len(words)):
        return 1
    stock = _stock(text, low, low.replace(".", " ").replace(",", " ").split())
    few = len(words) >= 8 and len(set(words)) <= 7
    return 1 if dull or stock and (few or len(words) <= 12) else 0


class _Hashes(dict):
    """Hash of each token of a text, without outer punctuation and in lower case;
    numbers and identifiers are one word, and what has no letter or digit is none."""

    def __missing__(self, token: str) -> int | None:
        if len(self) > 1_000_000:
            self.clear()
        word = token.strip(_EDGE)
        word = "0" if _NUMBER.fullmatch(word) else re.sub(r"\d+", "0", word)
        got = self[token] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True) if word else None
        return got


class Reader:
    """Reads texts: label, mark, and the hashed words of a text."""

    def __init__(self, filler: set[str]):
        self.filler, self.hashes = filler, _Hashes()

    def words(self, text: str) -> list[int]:
        """The distinct words, hashed and sorted."""
        got = set(map(self.hashes.__getitem__, set(text.lower().split())))
        got.discard(None)
        return sorted(got)

    def read(self, text: str) -> tuple[int, str | None]:
        """(trust, ``field``, ``filler`` or None)."""
        low = text.lower()
        plain = low.replace(".", " ").replace(",", " ").split()
        inside = "field" if has_field(text, low) else "filler" if _stock(text, low, plain) or _passage(low, plain, self.filler) else None
        clauses = 2 if low.count(" shall ") > 1 else sum(1 for _ in zip(_CLAUSE.finditer(text), range(2)))
        if clauses and self.filler.isdisjoint(plain):
            return (-1 if clauses == 2 else 0), inside
        return trust(text, self.filler, clauses), inside


def _marked(line: str) -> bool:
    """Whether well-known filler makes up a fortieth of a line."""
    words = line.lower().split()
    return sum(w.strip(".,") in ("lorem", "ipsum") for w in words) * 40 >= len(words) > 0


_LETTERS = re.compile(r"[\W\d_]+")


def filler_words(texts: DataFrame, text: str) -> set[str]:
    """Words most of whose lines hold well-known filler, counted over all texts; at
    most 10,000, as each makes up a ten-thousandth of all filler or more."""
    t = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))

    def dull(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            c = Counter(_LETTERS.sub("", w) for x in pdf["t"] for line in x.split("\n") if _marked(line) for w in line.lower().split())
            yield pd.DataFrame(list(c.items()), columns=["w", "n"])

    # only texts with a marked line count here, and every one of them does
    d = cut(t.where(F.lower("t").rlike("lorem|ipsum")).mapInPandas(dull, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("length(w) >= 2"), "dull")
    least = max(2, 1e-4 * (d.agg(F.sum("n")).first()[0] or 0))
    seen = {r["w"]: r["n"] for r in d.where(F.col("n") >= least).collect()}
    drop(d)
    if not seen:
        return {"lorem", "ipsum"}
    names = frozenset(seen)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            c: Counter = Counter()
            for x in pdf["t"]:
                words = x.lower().replace(".", " ").replace(",", " ").split()
                if not names.isdisjoint(words):
                    c.update(w for w in words if w in names)
            yield pd.DataFrame(list(c.items()), columns=["w", "n"])

    every = t.mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    total = {r["w"]: r["n"] for r in every}
    return {w for w, n in seen.items() if n >= 0.5 * total.get(w, n)} | {"lorem", "ipsum"}


def _simhash(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SimHash of 64 bits over the distinct words, hashed, of each text."""
    n = len(off) - 1
    out = np.zeros(n, np.uint64)
    base = off - off[0]
    step = max(1, int(250_000 / max(1, len(flat) / max(1, n))))
    for k in range(0, n, step):
        j = min(n, k + step)
        x = flat[base[k] : base[j]]
        size = np.diff(base[k : j + 1])
        if not len(x):
            continue
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        sums = np.add.reduceat(bits, np.minimum(base[k:j] - base[k], len(x) - 1), axis=0)
        out[k:j] = np.packbits((2 * sums > size[:, None]).astype(np.uint8), axis=1).view(np.uint64).ravel()
    return out


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of hashes, other ones for each seed."""
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_parts(classes: int) -> np.ndarray:
    """The bits of a fingerprint that make up the key of each table, one row each.

    A key has as many bits as it takes to tell ``classes`` apart, 16 at least.  At
    the similarity a bit differs with a chance of 0.19, so a key meets, one bit
    of it being free to differ, with a chance of q^b + b q^(b-1) (1 - q); there are
    tables enough that one in 200 pairs at the very similarity meets in none.
    The first tables share no bit, later ones take the bits in another order."""
    b, q = max(16, math.ceil(math.log2(max(2, classes)))), 0.81
    tables = math.ceil(math.log(0.005) / math.log1p(-(q**b + b * q ** (b - 1) * (1 - q))))
    r, rows = np.random.default_rng(5), []
    while len(rows) < tables:
        order = r.permutation(64 * WIDTH)
        rows += [order[k : k + b] for k in range(0, 64 * WIDTH - b + 1, b)]
    return np.array(rows[:tables])


def _size_class(n: int) -> int:
    """Sizes by the step of the similarity."""
    return math.floor(math.log(n) / math.log(1 / SIMILAR))


def class_prints(classes: DataFrame, parts: np.ndarray) -> DataFrame:
    """(h, toks, c, f, k) of classes (h, toks, c) with a word: fingerprint, and a
    key for each of the tables of ``parts``."""
    weight = np.int64(1) << np.arange(parts.shape[1], dtype=np.int64)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("toks")
            flat, off = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
            f = np.stack([_simhash(_mixed(flat, k), off) for k in range(WIDTH)], 1)
            bits = np.unpackbits(f.view(np.uint8), axis=1)
            k = np.stack([bits[:, p].astype(np.int64) @ weight for p in parts], 1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel().view(np.int64))) for x in (f, k)]
            yield pa.RecordBatch.from_arrays([b.column("h"), col, b.column("c"), *lists], ["h", "toks", "c", "f", "k"])

    return classes.select("h", "toks", "c").where(F.size("toks") > 0).mapInArrow(prints, "h long, toks array<long>, c int, f array<long>, k array<long>")


def near_classes(some: DataFrame, others: DataFrame, bits: int) -> DataFrame:
    """(ha, hb) of classes of ``some`` and of ``others`` that are near-duplicates;
    both are from ``class_prints``, with keys of ``bits``.  Words are looked at only
    where fingerprints agree; a class too long or short to reach the similarity
    is in no table with the other."""
    flip = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, *(1 << j for j in range(bits)))]))
    a = some.select(F.col("h").alias("ha"), "c", F.posexplode("k").alias("t", "v")).select("ha", "c", "t", "v", flip.alias("x")).withColumn("v", F.col("v").bitwiseXOR(F.col("x"))).drop("x")
    b = others.select(F.col("h").alias("hb"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), "k").select("hb", "c", F.posexplode("k").alias("t", "v"))
    # not sent to all tasks: the rows are many more than the statistics say
    met = a.hint("merge").join(b.hint("merge"), ["c", "t", "v"]).where("ha <> hb").select("ha", "hb").distinct()
    x, y = (t.select(F.col("h").alias(f"h{s}"), F.col("toks").alias(f"toks_{s}"), F.col("f").alias(f"f_{s}")) for t, s in ((some, "a"), (others, "b")))
    differ = F.aggregate(F.zip_with("f_a", "f_b", lambda m, n: F.bit_count(m.bitwiseXOR(n))), F.lit(0), lambda s, n: s + n)
    two = met.join(x, "ha").join(y, "hb").where(differ <= BITS)
    common = F.size(F.array_intersect("toks_a", "toks_b"))
    return two.where(common >= SIMILAR * (F.size("toks_a") + F.size("toks_b") - common)).select("ha", "hb")


def spread_labels(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(h) of the classes to which a trusted residue label spreads.  ``labels``: (h,
    most, least, c, idx, toks) of each class, with the words where none of it is
    genuine and the idx of one of its texts; ``texts``: (idx, text) of all."""
    maybe = labels.where("least >= 0 and c >= 0")
    parts = key_parts(maybe.count())
    bits = parts.shape[1]
    odd = cut(class_prints(maybe, parts), "prints")
    groups = connected_groups(near_classes(odd, odd, bits).where("ha < hb").select(F.col("ha").alias("u"), F.col("hb").alias("v")))
    of = groups.withColumnRenamed("id", "h").join(labels.select("h", "most"), "h")
    # Only a group with a label and a class without needs to be free of genuine ones.
    open_ = cut(of.join(of.groupBy("group").agg(F.max("most").alias("x"), F.min("most").alias("y")).where("x = 1 and y < 1"), "group").select("group", "h"), "open groups")
    if open_.isEmpty():
        return open_.select("h")
    some = odd.join(open_.select("h"), "h", "left_semi")
    # the size classes are as many as the logarithm of the longest text
    reach = {r["c"] + x for r in some.select("c").distinct().collect() for x in (-1, 0, 1)}
    need = cut(labels.where((F.col("least") < 0) & F.col("c").isin(*reach)).select("h", "c", "idx"), "genuine")
    if need.isEmpty():
        return open_.select("h")

    def words(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(set())
        for pdf in parts_:
            yield pd.DataFrame({"h": pdf["h"], "c": pdf["c"], "toks": [r.words(t) for t in pdf["text"]]})

    # one text of each class: copies of a record have the same words or are another class
    genuine = texts.join(need, "idx").select("h", "c", "text").mapInPandas(words, "h long, c int, toks array<long>").dropDuplicates(["h"])
    held = near_classes(some, cut(class_prints(genuine, parts), "genuine prints"), bits).select(F.col("ha").alias("h")).distinct()
    return open_.join(open_.join(held, "h").select("group").distinct(), "group", "left_anti").select("h")


def residue(docs: DataFrame, idx: str, text: str) -> DataFrame:
    """(idx, reason) of each record to leave out; ``reason`` is ``field``,
    ``filler``, ``message`` or ``near`` (by a near-duplicate's label).

    Null, empty and blank texts are no residue, nor are very short genuine ones.
    Repeated rows count once; of several reasons the first in that order is given.
    """
    d = docs.select(F.col(idx).alias("idx"), F.col(text).alias("text")).where(F.col(text).isNotNull() & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    filler = filler_words(d, "text")
    kind = docs.schema[idx].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(filler)
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [r.read(t) for t in texts]
            toks = [r.words(t) for t in texts]
            h = [int.from_bytes(blake2b(np.array(x, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True) for x in toks]
            c = [_size_class(len(x)) if x else -1 for x in toks]
            yield pa.RecordBatch.from_arrays(
                [b.column("idx"), pa.array(h, pa.int64()), pa.array(c, pa.int32()), pa.array([x for x, _ in got], pa.int32()), pa.array([x for _, x in got], pa.string()), pa.array([t if x >= 0 else None for t, (x, _) in zip(toks, got)], pa.list_(pa.int64()))],
                ["idx", "h", "c", "trust", "inside", "toks"],
            )

    seen = cut(d.mapInArrow(label, f"idx {kind}, h long, c int, trust int, inside string, toks array<long>"), "labels")
    label_of = cut(seen.groupBy("h").agg(F.max("trust").alias("most"), F.min("trust").alias("least"), F.min("c").alias("c"), F.min("idx").alias("idx"), F.max("toks").alias("toks")), "classes")
    spread = spread_labels(label_of, d).withColumn("spread", F.lit(True))
    pure = label_of.join(spread, "h", "left").select("h", (F.col("most") == 1).alias("own"), F.coalesce("spread", F.lit(False)).alias("spread")).where("own or spread")
    out = seen.select("idx", "h", "inside").join(pure, "h", "left").withColumn("reason", F.coalesce("inside", F.when(F.col("own"), "message"), F.when(F.col("spread"), "near")))
    rank = reduce(lambda c, kv: c.when(F.col("reason") == kv[1], kv[0]), list(enumerate(("field", "filler", "message", "near")))[1:], F.when(F.col("reason") == "field", 0))
    return out.where("reason is not null").groupBy("idx").agg(F.min_by("reason", rank).alias("reason"))
