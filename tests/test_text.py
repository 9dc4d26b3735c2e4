import random
import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import progress as P
from corpusloom.functions import text as T
from corpusloom.operators.classify import _TYPE_OF

TEXTS = ["", "  ", "Hello, World!", "ﬁnal №5 ＡＢＣ", "line\none\ttwo", "ÉCOLE — 12½", "契約書", "P.O. 12 po# x", "a" * 5000, "e-invoice invoice# invoice no 7"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_normal_form(spark):
    def plain(t):
        t = unicodedata.normalize("NFKC", t or "").lower()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t)).strip()

    df = frame(spark, [(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    both = {r["i"]: (r["text_norm"], r["n"]) for r in T.normalised(df, "t").withColumn("n", T.normalise(F.col("t"))).collect()}
    for i, t in enumerate([*TEXTS, None]):
        assert both[i] == (plain(t), plain(t))


def test_file_words(spark):
    cases = {"WO_0098.pdf": "wo 0098", "ServiceAgreement-v2.final.PDF": "service agreement v2 final", "noext": "noext", "a/b/MyFile.pdf": "my file", ".hidden": " hidden", "": "", "x..pdf": "x "}
    df = frame(spark, list(cases.items()), "n string, want string")
    for r in df.withColumn("got", T.file_words(F.col("n"))).collect():
        assert r["got"] == r["want"], r


def test_heading(spark):
    cases = [("", 0), ("one", 3), ("a\nb\nc", 5), ("a\nb\nc\nd", 5), ("x" * 300, 100), ("a\n\n\nb", 3)]
    df = frame(spark, cases, "t string, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.heading_end(F.col("t"))).collect())


def test_keyword_offsets(spark):
    """As one alternation, longest first, would find them."""
    words = sorted(_TYPE_OF, key=lambda w: -len(w))
    ref = re.compile("|".join((r"\b" if w[0].isalnum() else "") + re.escape(w) + (r"\b" if w[-1].isalnum() else "") for w in words))
    r = random.Random(3)
    texts = [" ".join(r.choice([*words, "zzz", "p.o.", "po#", "-", "\n", "nda's", "é"]) for _ in range(20)) for _ in range(60)] + TEXTS
    df = frame(spark, [(i, t.lower()) for i, t in enumerate(texts)], "i int, t string")
    for row in df.withColumn("h", T.hits(F.col("t"), T.alternation(words))).collect():
        assert [(h["start"], h["kw"]) for h in row["h"]] == [(m.start(), m.group()) for m in ref.finditer(row["t"])]


def test_char_ngrams(spark):
    def ref(t):
        out = []
        for w in t.split():
            w = f" {w} "
            for n in (3, 4, 5):
                if len(w) <= n:
                    out.append(w)
                    break
                out += [w[i : i + n] for i in range(len(w) - n + 1)]
        return sorted(out)

    texts = ["", "a", "ab", "abc abcd", "hello big world"]
    df = frame(spark, [(t,) for t in texts], "t string")
    assert [sorted(r["g"]) for r in df.select(T.char_ngrams(F.col("t")).alias("g")).collect()] == [ref(t) for t in texts]


def test_word_jaccard(spark):
    df = frame(spark, [("a b c", "b c d"), ("", ""), ("a a", "a")], "x string, y string")
    assert [r[0] for r in df.select(T.word_jaccard(F.col("x"), F.col("y"))).collect()] == [0.5, 0.0, 1.0]


def test_tables():
    assert len(C.KEYWORDS) == 20 and sum(map(len, C.KEYWORDS.values())) == len(_TYPE_OF) == 145
    assert set(C.PRIORITY) == set(C.KEYWORDS)


def test_progress(spark):
    now, told = [0.0], []
    p = P.Progress(lambda *x: told.append(x), clock=lambda: now[0])
    assert p.at("scan", 1, 2) == 1.5 and p.at("extract", 0, 0) == 45 and p.at("nowhere", 1, 2) == 45
    assert p.at("dedupe", 9, 3) == 83 and p.at("done", 0, 0) == 100 and p.left is None and len(told) == 5
    for percent, seconds, words in ((1, 10, "Estimating time remaining..."), (50, 0, "Estimating time remaining..."), (99.9, 10, "Almost done..."), (50, 45, "About 45s remaining"), (50, 125, "About 2m 05s remaining")):
        p.percent, now[0] = percent, seconds
        assert str(p) == words
    assert [P.spell(x) for x in (0, 59.6, 61)] == ["0s", "1m 00s", "1m 01s"]
    with p.watching(spark, "dedupe", every=0.01):
        spark.range(1000).repartition(4).count()
    assert p.percent == 83 and {x[0] for x in told[5:]} == {"dedupe"}
