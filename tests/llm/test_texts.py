"""Tokens, scanned text and personal items."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pii, pii_train, scans
from corpusloom.llm.tokens import EncodedText, Encoder, PrefixTable, Vocabulary, default_vocabulary, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(open(default_vocabulary(), "rb").read()))


@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers as p

    t = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(s=st.text(max_size=60) | st.text(alphabet="abst' \n\t019<|>.é", max_size=60))
def test_same_ids(encoder, oracle, s):
    ids = encoder.encode(s)
    assert ids == oracle(s) and encoder.decode(ids) == s


def test_long_pieces(encoder, oracle):
    for s in ("a" * 3000, " " * 2000 + "x", "=" * 1500, "ab" * 1500, "😀" * 300, "<|endoftext|>", "it's we'll 'S"):
        assert encoder.encode(s) == oracle(s)
    assert encoder.encode("") == encoder.encode(None) == []


def test_prefixes(encoder):
    """Appending and cutting a piece give what starting anew would."""
    t = PrefixTable(encoder.v, b"inter")
    t.append(b"nationalisation")
    assert t.ids() == PrefixTable(encoder.v, b"internationalisation").ids()
    t.cut(5)
    assert t.ids() == PrefixTable(encoder.v, b"inter").ids()


def test_edits(encoder):
    r = random.Random(2)
    base = "The supplier's notice, dated 12 May 2024, isn't valid.\n\n  See annex 7. " * 12
    for _ in range(200):
        e, i = EncodedText(encoder, base), r.randrange(len(base))
        j, new = min(len(base), i + r.randint(0, 6)), "".join(r.choice("ab '\n19ve") for _ in range(r.randint(0, 5)))
        e.edit(i, j, new)
        e.append(new)
        assert e.ids() == encoder.encode(base[:i] + new + base[j:] + new)
    e = EncodedText(encoder, base)
    e.edit(200, 201, "q")
    assert e.redone < 8


def test_token_ids(spark, encoder):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "x " * 20000), (5, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in token_ids(df.withColumnRenamed("text", "ids"), "doc_id", "ids").collect()}
    assert got == {i: encoder.encode(t) for i, t in rows}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


# ---- scanned text

WORDS = "the supplier shall deliver goods and services under this agreement within thirty days of receipt committee governance charter undertakes promises minutes milestone".split()


@pytest.fixture(scope="module")
def lexicon():
    return scans.Lexicon({**{w: 500 for w in WORDS}, "thc": 9, "undertakcs": 3}, {("governance", "charter"): 90}, ["payment"])


def test_lexicon(lexicon):
    assert lexicon.repair("thc", "") == "the" and "thc" not in lexicon.words
    for bad, good in (("cbarter", "charter"), ("prornises", "promises"), ("undertakcs", "undertakes"), ("servlces", "services"), ("g0vernance", "governance"), ("rninutes", "minutes"), ("paymenf", "payment"), ("miiestone", "milestone")):
        assert lexicon.repair(bad, "governance" if good == "charter" else "") == good, bad
    for w in ("charter", "Gudope", "xylophone", "", "it"):
        assert lexicon.repair(w.lower(), "") is None
    assert scans.weighted("modern", "modem") < 1 and scans.weighted("abc", "xyz") > 1
    # any letter put in, left out or replaced, where the word is far more frequent
    contract = scans.Lexicon({"contract": 500, "contracts": 40, "compact": 30, "conttract": 2}, {}, [])
    for bad in ("contrzct", "contrct", "conttract", "c0ntract"):
        assert contract.repair(bad, "") == "contract", bad
    for other in ("contracted", "contractor", "kontract", "contrived", "compacts"):
        assert contract.repair(other, "") is None, other
    assert scans.Lexicon({"contract": 99, "contrzct": 2}, {}, []).repair("contrzct", "") is None
    assert contract.repair("c" * 100_000, "") is None


def test_a_lexicon_is_the_same_when_built_again(lexicon):
    again = scans.Lexicon(dict(lexicon.count), lexicon.pairs, ["payment"], sorted(lexicon.words))
    assert again.words == lexicon.words and {k: set(v) for k, v in again.index.items()} == {k: set(v) for k, v in lexicon.index.items()}


PAGE = """Ref MX-2022-71881
SERVICES AGREEMENT

1. The supplier shall deliver goods under this agre-
ement within thirty days. The comm1ttee shall
Page 1
Ref MX-2022-7I881
undertakes the governance cbarter and services.
Signed for and on behalf of
Signed for and on behalf of
Page 2"""


def test_analyse(lexicon):
    found, text = scans.analyse(PAGE, lexicon, repair=True)
    assert set(found) == {(1, "furniture"), (6, "furniture"), (7, "furniture"), (11, "furniture"), (4, "hyphen"), (5, "misread"), (8, "misread")}
    assert "under this agreement within" in text and "governance charter" in text and "Page" not in text and "committee shall undertakes" in text
    for odd in ("", "\n", "x", "1", "Page 1", " \n \n", "-\n-\n", "a-\n", "word-"):
        assert isinstance(scans.analyse(odd, lexicon, repair=True)[1], str)
    long = "\n".join(["The supplier shall deliver goods."] * 3000)
    assert scans.analyse(long, lexicon)[0] == []


def test_running_line_twice_in_a_long_scan(lexicon):
    heads = {7: "Annex on Quality Assurance", 8: "Annex on Qualily Assurance"}
    body = [f"{w} goods and {w[::-1]} services of another {w * 2} kind" for w in ("alder", "birch", "cedar", "dogwood", "elm", "fir", "gum", "hazel", "ivy", "juniper", "larch", "maple", "nutmeg", "oak", "pine", "quince", "rowan", "spruce", "teak", "willow")]
    for n in (10, 20):
        lines = [x for p in range(n) for x in (heads.get(p, body[p]), body[p][::-1], f"Page {p + 1}")]
        assert {lines[k] for k in scans.furniture(lines) if not lines[k].startswith("Page")} == set(heads.values()), n


def test_numbers_of_pages(lexicon):
    """However many pages there are, and however long the lines."""
    r = random.Random(6)
    for number in (str, scans_roman):
        lines = [x for p in range(1, 1201) for x in (" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(2)), number(p))]
        assert scans.furniture(lines) == set(range(1, 2400, 2))
    head = "a very long running line " * 40
    lines = [x for p in range(1, 4) for x in (head, f"body of another page {'xyz'[p - 1] * 9}.", f"Page {p} of 3")]
    assert scans.furniture(lines) == {0, 2, 3, 5, 6, 8}


def scans_roman(n):
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def test_running_lines_of_any_wording(lexicon):
    """Headers and footers that no list names."""
    page = ["The supplier shall deliver goods and services under this", "agreement within thirty days."]
    lines = ["Blue folder 12-A", "TITLE", *page, "The client will pay the fees of", "Archive shelf seven", "Blue f0lder 12-A", "each month in advance.", "No other terms apply.", "Archive shelf seven"]
    assert {lines[k] for k in scans.furniture(lines)} == {"Blue folder 12-A", "Blue f0lder 12-A", "Archive shelf seven"}
    assert scans.furniture(["TITLE", *page, "Signed for and on behalf of", "the client", "Signed for and on behalf of", "the supplier"]) == set()


@pytest.mark.parametrize("few", [0, 1000])
def test_forms_that_come_again(few, monkeypatch):
    monkeypatch.setattr(scans, "FEW", few)
    r = random.Random(3)
    for _ in range(30):
        base = ["".join(r.choice("abcde ") for _ in range(r.choice((5, 8, 9, 15, 16, 23, 24, 31, 40, 64, 90)))) for _ in range(12)]
        forms = scans.Counter(base)
        for x in base:
            for _ in range(r.choice((0, 1, 2))):
                y = x
                for _ in range(r.randrange(1, len(x) // 8 + 4)):
                    i = r.randrange(len(y))
                    y = r.choice((y[:i] + y[i + 1 :], y[:i] + "z" + y[i:], y[:i] + "z" + y[i + 1 :]))
                forms[y] += 1
        want = {f for f in forms if forms[f] > 1 and len(f) > 3 or any(f != g and (scans._near(f, g) or scans._near(g, f)) for g in forms)}
        assert scans._again(forms) == want


def test_pair_counts_do_not_depend_on_the_split(spark):
    df = spark.createDataFrame([("the supplier delivers",)] * 12 + [("a bro-\nken word",)] * 9, "text string")
    for n, held in ((1, scans.HELD), (12, scans.HELD), (3, 2)):
        scans.HELD, kept = held, scans.HELD
        lex = scans.corpus_lexicon(df.repartition(n), "text", [])
        scans.HELD = kept
        assert lex.pairs == {("the", "supplier"): 12, ("supplier", "delivers"): 12}, n
        assert lex.count["supplier"] == 12 and "bro" not in lex.count and "ken" not in lex.count and lex.count["word"] == 9


def test_the_split_changes_no_row(spark):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/extracted_doc.parquet").select("idx", "text").distinct()
    got = [sorted(map(tuple, scans.scan_noise(df.repartition(n), "idx", "text", WORDS).collect())) for n in (1, 16, 200)]
    assert got[0] and got[0] == got[1] == got[2]


def test_scan_noise(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (1, PAGE), (4, "The supplier shall deliver goods and services. " * 50)]
    df = spark.createDataFrame(rows, "idx int, text string").withColumn("kind", scans.F.lit("x"))
    got = scans.scan_noise(df, "idx", "text", WORDS + ["agreement"])
    kinds = {(r["idx"], r["kind"]) for r in got.collect()}
    assert kinds == {(1, "furniture"), (1, "hyphen"), (1, "misread")}
    fixed = {r["idx"]: r["text"] for r in scans.scan_noise(df, "idx", "text", WORDS, repair=True).collect()}
    assert set(fixed) == {1, 3, 4} and fixed[3] == ""
    assert scans.scan_noise(df.limit(0), "idx", "text").count() == 0


# ---- personal items


def test_held_out_accuracy():
    got = pii_train.accuracy(pii_train.sample(600, 99), pii.weights())
    # the end of a town before the next capital is a guess
    assert all(p > (0.85 if k == "address" else 0.95) and r > (0.85 if k == "address" else 0.93) for k, (p, r) in got.items()), got


@pytest.mark.parametrize("text,want", [
    ("We met Rachel Torvane at noon.", [("name", "Rachel Torvane")]), ("Patient: Oluwaseun Adeyemi", [("name", "Oluwaseun Adeyemi")]), ("GB29 NWBK 6016 1331 9268 19", []), ("social security 123456789", [("id_number", "123456789")]), ("Invoice 123456789 is due", []),
    ("Ask Ms. Obuya-Lindqvist about it", [("name", "Ms. Obuya-Lindqvist")]), ("She lives at 12 Larch Road, Kelby Cross today", [("address", "12 Larch Road, Kelby Cross")]), ("Between Gorvik Talune Shipping LLC and the carrier", []), ("The ferry Victoria sails at dawn", []),
])
def test_unseen_sentences(text, want):
    com, giv = pii._lists(["met", "noon", "patient", "invoice", "due", "today", "ask", "about", "carrier", "ferry", "sails", "dawn", "she", "lives", "we", "social", "security"], ["rachel", "victoria"])
    assert [(k, text[a:b]) for _, a, b, k in pii.find_items(text, pii.weights(), com, giv)] == want


def test_long_digits_take_linear_time():
    line = "9" * 20_000 + "x " + "A1" * 10_000 + " " + "12-" * 8_000
    assert list(pii.find_items(line, pii.weights(), frozenset(), frozenset())) == []


def test_training_learns():
    w = pii.fit(pii_train.sample(400, 3), epochs=4)
    got = pii_train.accuracy(pii_train.sample(200, 4), w)
    assert sum(p + r for p, r in got.values()) / 10 > 0.9


def test_decode_is_the_best_cut():
    r = random.Random(1)
    w = {"a|": 0.0, **{f"a|f{k}": r.uniform(-1, 2) for k in range(20)}}
    for _ in range(40):
        cand = [(i, i + r.randint(1, 5), "a", [f"f{r.randrange(20)}"]) for i in (r.randrange(15) for _ in range(8))]

        def best(rest):
            if not rest:
                return 0.0
            head, *tail = rest
            with_it = pii.score(w, head[2], head[3]) + best([c for c in tail if c[1] <= head[0] or c[0] >= head[1]])
            return max(best(tail), with_it)

        got = pii.decode(cand, w)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        total = sum(max(pii.score(w, c[2], c[3]) for c in cand if c[:3] == g) for g in got)
        assert abs(total - best(cand)) < 1e-9


def test_items(spark):
    text = "Thanks, Mrs Floje\nCall +971 4 555 0178 on arrival.\nE-mail a(at)b.test before the deadline.\nThe vessel Victoria berths at bay 36.\nEmirates ID: 784-1978-0907511-2\nHer home is Flat 3C, 59 Juniper Road, Kelby Cross."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "   "), (5, "plain words only. " * 3000)], "doc_id long, text string").withColumn("kind", pii.F.lit(1))
    got = {(r["doc_id"], r["line_no"], r["kind"]) for r in pii.personal_items(df, "doc_id", "text", ["the", "her", "call"]).collect()}
    assert got == {(1, 1, "name"), (1, 2, "phone"), (1, 3, "email"), (1, 5, "id_number"), (1, 6, "address")}
    clean = {r["doc_id"]: (r["text"], r["items"]) for r in pii.redacted(df, "doc_id", "text", ["the", "her", "call"]).collect()}
    assert clean[1][0].split("\n")[:2] == ["Thanks, [NAME]", "Call [PHONE] on arrival."] and clean[1][1] == 5 and clean[2] == (None, 0) and clean[5][1] == 0
