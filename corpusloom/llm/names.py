"""Variant spellings of names: which strings mean the same company or person.

1. ``read_name`` takes a string apart: letter case, accents, titles, brackets,
   legal forms and look-alike digits go, nicknames and abbreviated trade words
   are written out.  What is left are core tokens and a trade word or none.
   Strings with the same reading are one *reading*.
2. A prefix-filtered set-similarity join on the 4-grams of the core tokens
   finds readings that share enough grams; the rarest grams come first, counted
   over all readings in a fixed number of buckets.  Short tokens lose most grams
   by one edit, so readings also meet by deletion forms of their tokens, which
   leave out no pair that the next step can accept (``form_pairs``).
3. ``soft_match`` verifies each pair: tokens match when equal or nearly so, a
   merged token matches the two it was made of, an initial its name, and each
   counts by its rarity over all readings.  If both sides keep a token the
   other lacks, they are different; so are different trade words.
4. Pairs that match in full are linked and closed by connected components.  A
   reading with less in it, such as one without a trade word or with an
   initial, joins the one group it fits and stays apart if it fits several.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import bounded, cut, drop
from .components import connected_groups

# Fixed values.
TRADES = (
    "advisory agriculture automotive aviation banking capital catering chemicals construction consulting contracting cosmetics "
    "development education electronics energy engineering entertainment equipment fashion finance foods furniture garments "
    "healthcare hospitality industries insurance investment investments logistics machinery manufacturing marine marketing media "
    "medical metals mining motors oil packaging petroleum pharmaceuticals plastics power printing properties realty retail "
    "security shipping software solutions steel technologies telecom textiles tourism trading transport travel water"
).split()
LEGAL = [
    x.split()
    for x in (
        "with limited liability", "limited liability company", "limited liability partnership", "free zone limited liability company",
        "free zone establishment", "free zone company", "public joint stock company", "private joint stock company", "joint stock company",
        "public limited company", "public shareholding company", "sole proprietorship", "fz llc", "fz co", "fz e", "pty ltd", "pvt ltd", "co ltd",
        "llc", "llp", "ltd", "limited", "fze", "fzco", "fzc", "fzllc", "pjsc", "psc", "plc", "wll", "inc", "incorporated", "corp", "corporation",
        "company", "co", "est", "establishment", "branch", "gmbh", "ag", "sa", "sarl", "bv", "nv", "spa", "srl", "pvt", "pty",
    )
]
TITLES = set("mr mrs ms miss mx dr prof eng engr sir madam messrs sheikh capt adv hon".split())
LOOKALIKE = str.maketrans("013458", "oleasb")
Q = 4
SHARE = 0.4
BUCKETS = 1 << 16
#: Readings with a gram in common from which it takes two grams to compare them.
HOT = 2000
#: Readings with a form in common up to which all of them are compared.
FEW = 24
#: Tokens of a reading up to which each two are also taken as one.
MERGED = 16
#: Rows that a Python task holds before it hands them on; a reading has hundreds.
PIECE = 50_000

_LEGAL = sorted(LEGAL, key=len, reverse=True)


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s)).casefold()
    return "".join(c for c in s if not unicodedata.combining(c))


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most + 1`` if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _abbreviates(a: str, word: str) -> bool:
    if len(a) < 2 or len(a) >= len(word) or a[0] != word[0]:
        return False
    at = iter(word)
    return all(c in at for c in a)


def _trade_of(token: str, last: bool, trades: set[str]) -> str | None:
    if token in trades:
        return token
    if len(token) >= 6:
        near = [w for w in trades if osa(token, w, 1) <= 1]
        if len(near) == 1:
            return near[0]
    if last:
        fit = [w for w in trades if _abbreviates(token, w)]
        if fit:
            return max(fit, key=lambda w: (w.startswith(token), len(token) / len(w), w))
    return None


def read_name(s: str, trades: set[str], nick: dict[str, str]) -> tuple[list[str], str | None]:
    """(core tokens, sorted; trade word or None) of a name."""
    p = re.sub(r"\([^()]*\)", " ", _plain(s))
    p = re.sub(r"['’`]", "", p)
    p = re.sub(r"\bm/s\b\.?", " ", p).replace("&", " and ")
    p = re.sub(r"\b((?:[^\W\d_]\.){2,}[^\W\d_]?)", lambda m: m.group(1).replace(".", ""), p)
    toks = re.findall(r"[^\W_]+", p) or re.findall(r"[^\W_]+", _plain(s)) or [s]
    toks = [t.translate(LOOKALIKE) if re.search(r"\d", t) and re.search(r"[^\W\d]", t) else t for t in toks]
    while len(toks) > 1 and toks[0] in TITLES:
        toks = toks[1:]
    more = True
    while more:
        more = False
        for form in _LEGAL:
            if len(toks) > len(form) and toks[-len(form) :] == form:
                toks, more = toks[: -len(form)], True
                break
    trade = None
    if len(toks) > 1:
        for i in [len(toks) - 1, 0, *range(1, len(toks) - 1)]:
            # only a token after two others may be an abbreviation
            if w := _trade_of(toks[i], i == len(toks) - 1 and i >= 1 and not (i == 1 and len(toks[i]) > 5), trades):
                trade, toks = w, toks[:i] + toks[i + 1 :]
                break
    if trade is None:
        toks = [nick.get(t, t) for t in toks]
    return sorted(toks), trade


def soft_match(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> tuple[float, list[str], list[str], bool]:
    """(soft weighted similarity, tokens of a and of b without a match, whether
    an initial was matched)."""
    A, B = dict(zip(a, wa)), dict(zip(b, wb))
    got, initial = 0.0, False
    left, right = list(a), list(b)
    for t in a:
        if t in right:
            left.remove(t)
            right.remove(t)
            got += A[t] * B[t]
    near = sorted((d, x, y) for x in left for y in right if min(len(x), len(y)) >= 4 and (d := osa(x, y, 2 if min(len(x), len(y)) >= 9 else 1)) <= (2 if min(len(x), len(y)) >= 9 else 1))
    for d, x, y in near:
        if x in left and y in right:
            left.remove(x)
            right.remove(y)
            got += A[x] * B[y] * (1 - d / max(len(x), len(y)))
    for one, two, P, R in ((left, right, A, B), (right, left, B, A)):
        for x in list(one):
            for y, z in [(y, z) for y in two for z in two if y is not z]:
                if x in one and y in two and z in two and len(y) + len(z) >= 6 and (d := osa(x, y + z, 1)) <= 1:
                    one.remove(x)
                    two.remove(y)
                    two.remove(z)
                    got += P[x] * math.hypot(R[y], R[z]) * (1 - d / len(x))
    for one, two in ((left, right), (right, left)):
        for x in list(one):
            hit = [y for y in two if len(x) == 1 and len(y) > 1 and y[0] == x]
            if hit:
                one.remove(x)
                two.remove(hit[0])
                got += 0.5 * {**A, **B}[x] * {**A, **B}[hit[0]]
                initial = True
    norm = math.sqrt(sum(w * w for w in wa)) * math.sqrt(sum(w * w for w in wb))
    return (got / norm if norm else 0.0), left, right, initial


def _grams(core: list[str]) -> set[int]:
    return {zlib.crc32(g.encode()) for t in core if len(t) > 1 for p in [f" {t} "] for g in ({p[i : i + Q] for i in range(len(p) - Q + 1)} or {p})}


def _forms(t: str) -> set[str]:
    """What is left of a token without one letter, or two where ``soft_match``
    allows two edits: tokens that it takes as nearly equal have one in common."""
    out = {t}
    if len(t) >= 4:
        out |= {t[:i] + t[i + 1 :] for i in range(len(t))}
    if len(t) >= 9:
        out |= {t[:i] + t[i + 1 : j] + t[j + 1 :] for j in range(len(t)) for i in range(j)}
    return out


def _units(core: list[str]) -> Iterator[tuple[str, int, int]]:
    """(form, position, second position or -1) of each token, and of each two
    tokens as one."""
    for p, t in enumerate(core):
        yield from ((f, p, -1) for f in _forms(t))
    if len(core) <= MERGED:
        for p, y in enumerate(core):
            for q, z in enumerate(core):
                if p != q and len(y) + len(z) >= 6:
                    t = y + z
                    yield from ((f, p, q) for f in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))})


def _wide_keys(core: list[str], trade: str, forms: list[tuple[int, int, int]]) -> set[tuple[str, int]]:
    """(key, role) of a reading by its forms that many have.  Readings that
    ``soft_match`` accepts have two such forms in common, or one and nothing else,
    or one and a token that only one of them has, or one and an initial."""
    out: set[tuple[str, int]] = set()
    for k, (f, p, q) in enumerate(forms):
        rest = [t for i, t in enumerate(core) if i not in (p, q)]
        if not rest:
            out |= {(f"= {f}", 0), (f"+ {f} {trade}", 1)}
        if len(rest) == 1:
            out.add((f"+ {f} {trade}", 2))
        out |= {(f". {f} {t[0]} {trade}", 1 if len(t) == 1 else 2) for t in rest}
        out |= {(f"& {min(f, g)} {max(f, g)}", 0) for g, i, j in forms[:k] if not {i, j} & {p, q} - {-1}}
    return out


def _initial_keys(core: list[str], trade: str) -> list[tuple[str, int]]:
    """(key, role) by which readings meet of which every token is an initial on
    one side and written out on the other."""
    own, other = (" ".join(sorted(t[0] + ("." if (len(t) == 1) == x else "") for t in core)) for x in (True, False))
    return [(f"! {other} {trade}", 2), *([(f"! {own} {trade}", 1)] if any(len(t) == 1 for t in core) else [])]


def _frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``rows`` as frames of at most ``PIECE`` rows."""
    rows = iter(rows)
    while part := list(islice(rows, PIECE)):
        yield pd.DataFrame(part, columns=columns)


def form_pairs(keys: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b), a < b, of readings (id, core, trade) that ``soft_match`` may accept:
    every pair that it does accept, with a trade word that isn't another, is here.

    Readings with a form in common that at most ``few`` have are all compared.  Of
    forms that more have, readings need two, or whatever else makes the pair
    acceptable, so the number of pairs grows with the readings and not with their
    square.  The bound of it: tokens of readings with more than ``MERGED`` aren't
    taken as one.
    """

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield from _frames(((i, *u) for i, core in zip(pdf["id"], pdf["core"]) for u in _units(list(core))), ["id", "f", "p", "q"])

    def widen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield from _frames(((i, *k) for i, core, trade, forms in zip(pdf["id"], pdf["core"], pdf["trade"], pdf["forms"]) for k in _wide_keys(list(core), trade or "", [(x["f"], x["p"], x["q"]) for x in forms])), ["id", "k", "role"])

    def initials(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield from _frames(((i, *k) for i, core, trade in zip(pdf["id"], pdf["core"], pdf["trade"]) for k in _initial_keys(list(core), trade or "")), ["id", "k", "role"])

    forms = cut(keys.select("id", "core").mapInPandas(spread, "id long, f string, p int, q int").select("id", F.xxhash64("f").alias("f"), "p", "q"), "forms")
    n = cut(forms.groupBy("f").agg(F.count_distinct("id").alias("n")).where("n > 1"), "form counts")
    narrow = forms.join(n.where(F.col("n") <= few), "f").select("id", F.col("f").alias("k"), F.lit(0).alias("role")).distinct()
    shared = forms.join(n.where(F.col("n") > few), "f").groupBy("id").agg(F.collect_set(F.struct("f", "p", "q")).alias("forms"))
    wide = keys.select("id", "core", "trade").join(shared, "id").mapInPandas(widen, "id long, k string, role int")
    wide = wide.unionByName(keys.select("id", "core", "trade").mapInPandas(initials, "id long, k string, role int"))
    rows = narrow.unionByName(wide.select("id", F.xxhash64("k").alias("k"), "role")).join(keys.select("id", "trade"), "id")
    rows = cut(rows, "form keys")
    a, b = (rows.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "role", "trade")]) for x in "ab")
    met = a.join(b, "k").where("id_a < id_b and (role_a + role_b) in (0, 3) and (trade_a is null or trade_b is null or trade_a = trade_b)")
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def name_readings(names: DataFrame, trades: set[str], nick: dict[str, str]) -> DataFrame:
    """(name, key, core, trade, grams) of each distinct string of column ``name``."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for s in pdf["name"]:
                core, trade = read_name(s, trades, nick)
                rows.append((s, " ".join(core) + " / " + (trade or ""), core, trade, sorted(_grams(core))))
            yield pd.DataFrame(rows, columns=["name", "key", "core", "trade", "grams"])

    return names.mapInPandas(read, "name string, key string, core array<string>, trade string, grams array<long>")


def _prefix_keys(grams: list[int], keep: int, freq: np.ndarray, hot: int) -> set[int]:
    """Keys by which a set of grams, rare ones first, meets others.  A gram that more
    than ``hot`` sets have is a key only together with each other gram of the set: sets
    alike enough have two in common, but for those of so few grams that one is
    enough, which keep it alone as well."""
    out: set[int] = set()
    for x in grams[:keep]:
        if freq[x % BUCKETS] > hot:
            out |= {zlib.crc32(f"{min(x, y)} {max(x, y)}".encode()) + (1 << 32) for y in grams if y != x}
        if freq[x % BUCKETS] <= hot or SHARE * len(grams) <= 2:
            out.add(x)
    return out


def same_names(names: DataFrame, nick: dict[str, str], similarity: float = 0.5, hot: int = HOT) -> DataFrame:
    """(name, entity) for each distinct non-empty string of column ``name``:
    strings with the same ``entity`` mean the same.

    Nulls and strings without a letter or digit have no row.  Repeated strings
    count once.  ``nick`` maps short forms of given names to the full ones, in
    lower case; it may be empty.
    """
    names = names.select("name").where(F.col("name").rlike(r"[\p{L}\p{N}]")).distinct()
    read = cut(name_readings(names, set(TRADES), nick).withColumn("id", F.xxhash64("key")), "readings")
    keys = read.groupBy("id").agg(F.first("core").alias("core"), F.first("trade").alias("trade"), F.first("grams").alias("grams"))
    # Token weights: rare tokens count more.
    total = keys.count()
    tok = keys.select("id", F.posexplode("core").alias("at", "t"))
    df = tok.groupBy("t").agg(F.count_distinct("id").alias("df"))
    weight = tok.join(df, "t").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.log1p(F.lit(float(total)) / F.col("df")).alias("w")))), lambda x: x["w"]).alias("w"))
    keys = cut(keys.join(weight, "id"), "keys")
    bucket = keys.select(F.explode("grams").alias("g")).groupBy(F.pmod("g", F.lit(BUCKETS)).alias("b")).count().toPandas()
    freq = np.zeros(BUCKETS, np.int64)
    freq[bucket["b"].to_numpy(np.int64)] = bucket["count"].to_numpy(np.int64)

    def prefixed(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in parts:
            for i, g in zip(pdf["id"], pdf["grams"]):
                g = np.asarray(g, np.int64)
                g = g[np.lexsort((g, freq[g % BUCKETS]))]
                keep = len(g) - math.ceil(SHARE * len(g) - 1e-9) + 1
                # two numbers that differ in no more bits than the sets in grams
                sketch = [0, 0]
                for x in g.tolist():
                    bit = (x * 2654435761 >> 7) & 127
                    sketch[bit >> 6] ^= 1 << (bit & 63)
                s, t = (x - (1 << 64) if x >> 63 else x for x in sketch)
                yield from ((k, i, len(g), s, t) for k in _prefix_keys(g.tolist(), keep, freq, hot))

    def prefixes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(prefixed(parts), ["g", "id", "n", "s", "t"])

    pre = keys.select("id", "grams").mapInPandas(prefixes, "g long, id long, n int, s long, t long")
    a, b = (pre.select("g", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "s", "t")]) for k in "ab")
    differ = F.bit_count(F.col("s_a").bitwiseXOR(F.col("s_b"))) + F.bit_count(F.col("t_a").bitwiseXOR(F.col("t_b")))
    met = a.join(b, "g").where((F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * SHARE) & (differ <= (1 - SHARE) / (1 + SHARE) * (F.col("n_a") + F.col("n_b")) + 1e-9))
    met = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(form_pairs(keys)).distinct()
    left = keys.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "core", "trade", "w")])
    right = keys.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "core", "trade", "w")])
    pairs = met.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b")).where("trade_a is null or trade_b is null or trade_a = trade_b")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for x in pdf.itertuples(index=False):
                score, la, lb, initial = soft_match(list(x.core_a), list(x.w_a), list(x.core_b), list(x.w_b))
                if score < similarity or (la and lb):
                    continue
                ta, tb = x.trade_a or "", x.trade_b or ""
                if not la and not lb and not initial and ta == tb:
                    out.append((x.a, x.b, 0))
                    continue
                # the side with less in it
                less_a = bool(lb) or bool(tb and not ta) or any(len(t) == 1 for t in x.core_a)
                less_b = bool(la) or bool(ta and not tb) or any(len(t) == 1 for t in x.core_b)
                # what one side has more: a trade word or a given name, not both
                if less_a != less_b and len(la) + len(lb) + (ta != tb) + initial == 1:
                    out.append((x.a, x.b, 1) if less_a else (x.b, x.a, 1))
            yield pd.DataFrame(out, columns=["u", "v", "weak"])

    ok = cut(pairs.select("a", "b", "core_a", "core_b", "w_a", "w_b", "trade_a", "trade_b").mapInPandas(verify, "u long, v long, weak int"), "matches")
    strong = connected_groups(ok.where("weak = 0").select("u", "v"))
    group = cut(keys.select("id").join(strong, "id", "left").select("id", F.coalesce("group", "id").alias("c")), "strong")
    gu, gv = group.select(F.col("id").alias("u"), F.col("c").alias("cu")), group.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    fits = ok.where("weak = 1").join(gu, "u").join(gv, "v").where("cu <> cv").select("cu", "cv").distinct()
    one = fits.groupBy("cu").agg(F.count("*").alias("n"), F.min("cv").alias("cv")).where("n = 1")
    final = connected_groups(one.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    entity = group.join(final, F.col("c") == final["id"], "left").select(group["id"], F.coalesce("group", "c").alias("entity"))
    return read.select("name", "id").join(entity, "id").select("name", "entity")


def name_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point, of the same entity."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def nicknames(alias: DataFrame, most: int = 100_000) -> dict[str, str]:
    """Short form to given name, lower case, of a small fixed table; one of more than
    ``most`` rows is an error."""
    rows = bounded(alias.where("short_form is not null and given_name is not null").select("short_form", "given_name"), most)
    return {_plain(r["short_form"]): _plain(r["given_name"]) for r in rows}
