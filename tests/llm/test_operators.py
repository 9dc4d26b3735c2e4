"""Each operator on small tables: brute force, and odd input."""

import itertools
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import names
from corpusloom.llm.components import connected_groups, record_groups, record_links
from corpusloom.llm.names import form_pairs, name_pairs, osa, read_name, same_names, soft_match
from corpusloom.llm.nearsets import Classes, _run_pairs, alike_pairs, alike_sets
from corpusloom.llm.packing import fill_report, packed, plan, token_items
from corpusloom.llm.residue import Reader, class_prints, filler_words, has_field, has_filler, key_parts, near_classes, residue, trust
from corpusloom.llm.survivors import golden_records

# ---- components


def brute_groups(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            up[b] = a
    return {x: find(x) for x in up}


def shapes():
    r = random.Random(1)
    chain = list(range(100, 160))
    r.shuffle(chain)
    yield [(i, i + 1) for i in range(1, 40)]
    yield list(zip(chain, chain[1:]))
    yield [(7, i) for i in range(20)] + [(500, 501), (501, 502), (502, 500), (None, 3), (4, None), (9, 9), (700, 700)]
    yield [(r.randrange(60), r.randrange(60)) for _ in range(45)] + list(itertools.combinations(range(200, 208), 2)) + [(207, 300), (300, 301), (301, 302), (302, 200)]
    yield []


@pytest.mark.parametrize("k", range(5))
def test_components(spark, k):
    edges = list(shapes())[k]
    df = spark.createDataFrame(edges * 2 + [(v, u) for u, v in edges[:3]], "u long, v long")
    assert {r["id"]: r["group"] for r in connected_groups(df).collect()} == brute_groups(edges)


RECORD = "idx int, file_name string, duplicate_of string, dup_group_id int, extraction_method string, text_len int, size_bytes int, entity_name string, contract_date string, doc_type string, mtime timestamp, m string, group_idx string"
T = datetime(2024, 1, 1)


def row(i, name="x", of="", gid=None, method="ocr", n=10, size=10, mtime=T):
    return (i, name, of, gid, method, n, size, f"e{i}", "", "PO", mtime, "clash", "clash")


def test_record_groups_and_survivors(spark):
    rows = [
        row(1, "A.pdf", None, 5, " OCR ", 10, 10), row(2, "b.pdf", " /in/x/a.PDF ", None, "native_fitz", 20, 30), row(3, "c.pdf", "C.pdf", -1), row(4, "d.pdf", "gone.pdf", 0),
        row(5, "e.pdf", "", 5, None, -1, None), row(6, "f.pdf", "C:\\in\\g.pdf", None, "pdfplumber", 50, 5), row(7, "g.pdf", "", 9, "failed", 60, 6, None), row(8, "h.pdf", "", 9, "failed", 60, 6, None), row(None, "z", "a.pdf", 5),
    ]
    df = spark.createDataFrame(rows + rows[:3], RECORD)
    groups = record_groups(df)
    got = {r["idx"]: r["group_idx"] for r in groups.collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 6, 7: 6, 8: 6}
    gold = {r["group_idx"]: r for r in golden_records(df, groups).collect()}
    assert (gold[1]["keeper_idx"], gold[1]["dominant"], gold[1]["members"], gold[1]["extraction_method"]) == (2, True, 3, "native_fitz")
    assert gold[6]["dominant"] is False and (gold[6]["text_len"], gold[6]["size_bytes"], gold[6]["extraction_method"]) == (60, 6, "pdfplumber")
    empty = spark.createDataFrame([], RECORD)
    assert record_links(empty).count() == 0 and golden_records(empty, record_groups(empty)).count() == 0


def test_tie_goes_to_the_latest(spark):
    rows = [row(1, "a", "b", mtime=None), row(2, "b", "", mtime=datetime(2024, 1, 2)), row(3, "c", "b", mtime=datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, RECORD)
    r = golden_records(df, record_groups(df)).first()
    assert r["dominant"] and r["keeper_idx"] == 2


def test_shared_file_name(spark):
    """A name that several records bear links them once somebody refers to it."""
    df = spark.createDataFrame([row(1, "s.pdf"), row(2, "S.pdf"), row(3, "t.pdf", "s.pdf"), row(4, "u.pdf"), row(5, "U.pdf")], RECORD)
    assert {r["idx"]: r["group_idx"] for r in record_groups(df).collect()} == {1: 1, 2: 1, 3: 1}


# ---- near-duplicate sets


def brute_pairs(rows, t=0.8, chars=80):
    docs = {(i, b, frozenset(w for w in x.split(" ") if w)) for i, b, x in rows if i is not None and b is not None and x is not None and len(x) >= chars}
    docs = {d for d in docs if d[2]}
    return {(min(p[0], q[0]), max(p[0], q[0])) for p, q in itertools.combinations(docs, 2) if p[0] != q[0] and p[1] == q[1] and len(p[2] & q[2]) * 10 >= t * 10 * len(p[2] | q[2]) - 1e-9}


@pytest.mark.parametrize("seed,long", [(1, 8192), (2, 3)])
def test_alike_sets(spark, seed, long):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    seeds = [[r.choice(words) for _ in range(r.choice([5, 20, 60, 150]))] for _ in range(8)]
    rows = []
    for i in range(90):
        t = list(r.choice(seeds))
        for _ in range(r.choice([0, 0, 1, len(t) // 9, len(t) // 6])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, r.choice(["a", "b", None]), " ".join(t) + "  "))
    rows += [(200, "a", None), (201, "a", ""), (202, "a", " " * 90), (None, "a", rows[0][2]), (203, "a", "long " * 30000 + "tail"), (204, "a", "tail " * 20000 + "long"), (205, "a", "x y"), rows[0]]
    df = spark.createDataFrame(rows, "i int, b string, t string").withColumn("h", F.lit(1)).withColumn("toks", F.lit("clash"))
    members, pairs = alike_sets(df, "i", "b", "t", min_chars=10, long=long)
    got = [tuple(x) for x in alike_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, chars=10)


def test_alike_sets_empty(spark):
    members, pairs = alike_sets(spark.createDataFrame([], "i int, b string, t string"), "i", "b", "t")
    assert alike_pairs(members, pairs).count() == 0


def test_size_classes():
    import numpy as np

    c = Classes(0.8)
    n = np.arange(1, 3000)
    k = c.of(n)
    assert (c.low[k] <= n).all() and (n < c.low[k + 1]).all()
    # the largest partner is at most one class up
    assert (c.of(c.largest(n)) <= k + 1).all()
    for a in range(1, 60):
        for b in range(a, c.largest(np.array([a]))[0] + 1):
            most = max((a + b - 2 * o for o in range(a + 1) if o >= 0.8 * (a + b - o) - 1e-9), default=0)
            assert most <= c.differ(np.array([a + b]))[0]


# ---- names


def test_read_name():
    trades, nick = {"foods", "energy", "technologies", "trading"}, {"bob": "robert"}
    same = ["Kutpedo Zanna Foods LLC", "KUTPEDO ZANNA FOODS L.L.C.", "kutpedo zanna fds limited liability company", "M/s Kutpedo Zanna Fds", "Foods Kutpedo Zanna, LLC", "Kutped0-Zanna Foods", "Kutpedo Zanna Foods LLC (KZF)"]
    assert {tuple(map(str, read_name(s, trades, nick))) for s in same} == {("['kutpedo', 'zanna']", "foods")}
    assert read_name("Mr. Bob Zanna-Kutpedo", trades, nick) == (["kutpedo", "robert", "zanna"], None)
    for odd in ("", "LLC", "(ABC)", "...", "№", "Mr.", "Foods", "日本"):
        core, _ = read_name(odd, trades, nick)
        assert isinstance(core, list)
    assert osa("abcd", "abdc", 1) == 1 and osa("abcd", "abd", 1) == 1 and osa("abc", "xyz", 1) == 2


def test_same_names(spark):
    a = ["Kutpedo Zanna Foods LLC", "Kutpdeo Zanna Foods LLC", "Kutpedozanna Foods LLC", "Kutpedo Zanna"]
    b = ["Kutpedo Zannavi Energy Ltd", "KUTPEDO ZANNAVI ENERGY LTD"]
    p = ["Robert Milnor Feltre", "Bob Milnor Feltre", "FELTRE, Robert Milnor", "R. Milnor Feltre"]
    q = ["Leila Milnor Feltre", "Mr. Leila Milnor-Feltre"]
    c = ["Dorvita Lomak Foods LLC", "Dorvita Lomak Energy LLC", "Dorvita Lomak"]
    names = a + b + p + q + c
    df = spark.createDataFrame([(n, 1, "x") for n in names * 2] + [(None, 1, "x"), ("", 1, "x"), (" - ", 1, "x")], "name string, entity int, id string")
    got = {tuple(r) for r in name_pairs(same_names(df, {"bob": "robert"})).collect()}
    want = {tuple(sorted(x)) for g in (a, b, p, q) for x in itertools.combinations(g, 2)}
    assert got == want
    assert same_names(spark.createDataFrame([], "name string"), {}).count() == 0


def test_hot_grams_lose_no_pair():
    """Sets that share enough grams have a key in common, whatever grams are hot."""
    r = random.Random(12)
    freq = np.zeros(names.BUCKETS, np.int64)
    grams = list(range(40))
    for g in grams:
        freq[g] = r.choice([1, 5, 50])
    sets = [set(r.sample(grams, r.choice([1, 2, 3, 4, 5, 8, 14]))) for _ in range(250)]
    for hot in (0, 10, 100):
        keys = []
        for x in sets:
            g = sorted(x, key=lambda y: (freq[y], y))
            keys.append(names._prefix_keys(g, len(g) - math.ceil(names.SHARE * len(g) - 1e-9) + 1, freq, hot))
        for i, j in itertools.combinations(range(len(sets)), 2):
            if len(sets[i] & sets[j]) >= names.SHARE * len(sets[i] | sets[j]):
                assert keys[i] & keys[j], (hot, sets[i], sets[j])


def test_swap_inside_a_short_token(spark):
    a = ["Viumro Zuclape Technologies Ltd", "Vimuro Zuclape Technologies Ltd"]
    b = ["Zawnolo Virolo Engineering FZCO", "Zanwolo Virolo Engineering FZC"]
    df = spark.createDataFrame([(n,) for n in a + b], "name string")
    assert {tuple(r) for r in name_pairs(same_names(df, {})).collect()} == {tuple(sorted(a)), tuple(sorted(b))}


def test_rows_of_readings_come_in_pieces(monkeypatch):
    monkeypatch.setattr(names, "PIECE", 100)
    rows = [(i, *u) for i in range(9) for u in names._units(["kutpedo", "zannavizannavi"])]
    got = list(names._frames(iter(rows), ["id", "f", "p", "q"]))
    assert max(len(x) for x in got) == 100 and [tuple(x) for f in got for x in f.itertuples(index=False)] == rows
    assert not list(names._frames([], ["id"]))


@pytest.mark.parametrize("few", [1, 4, 24])
def test_no_acceptable_pair_is_missed(spark, few):
    r = random.Random(few)
    tokens = ["".join(r.choice("abcdeiklmnoru") for _ in range(n)) for n in (1, 1, 3, 4, 5, 6, 7, 7, 8, 9, 10, 13)]

    def bent(t):
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            i = r.randrange(len(t))
            t = r.choice((t[:i] + t[i + 1 :], t[:i] + r.choice("xyz") + t[i + 1 :], t[:i] + r.choice("xyz") + t[i:], t[:i] + t[i : i + 2][::-1] + t[i + 2 :])) or t
        return t

    rows = {}
    for _ in range(420):
        core = [bent(t) if r.random() < 0.5 else t for t in r.sample(tokens, r.choice((1, 1, 2, 2, 2, 3, 4)))]
        if len(core) > 1 and r.random() < 0.3:
            core = [core[0] + core[1], *core[2:]]
        if r.random() < 0.2:
            core[0] = core[0][0]
        rows[tuple(sorted(core)), r.choice((None, "foods", "energy"))] = None
    rows = [(i, list(c), t) for i, (c, t) in enumerate(rows)]
    want = set()
    for (i, a, s), (j, b, t) in itertools.combinations(rows, 2):
        score, la, lb, initial = soft_match(a, [1.0] * len(a), b, [1.0] * len(b))
        if score >= 0.5 - 1e-9 and not (la and lb) and (s is None or t is None or s == t) and len(la) + len(lb) + (s != t) + initial <= 1:
            want.add((i, j))
    got = {tuple(x) for x in form_pairs(spark.createDataFrame(rows, "id long, core array<string>, trade string"), few).collect()}
    assert len(want) > 500 and not want - got


# ---- residue


def test_residue_parts():
    for s in ("a {{fee}} b", "${party.b}", "{client_name}", "%%NAME%%", "«Party_B»", "<<DATE>>", "@@x@@", "[●]", "[INSERT DATE]", "[please complete\nname]", "<insert fee>", "Click to add the name", "XX.XX.20XX", "DD/MM/YYYY", "[Party B]", "[Effective Date]"):
        assert has_field(s), s
    for s in ("[signature page follows]", "client [the Purchaser] and [see annex]", "<2 seconds and >99%", "[9]", "[1]", "Signature: ____", "{1, 2}", "a [sic] b", "Merge fields in the letter templates", ""):
        assert not has_field(s), s
    filler = {"lorem", "ipsum", "dolor", "amet"}
    assert has_filler("a b lorem ipsum dolor amet lorem c", filler) and not has_filler("replace all filler copy in the brochure", filler)
    assert trust("HTTP 404 - NOT FOUND\nThe page could not be opened.", filler) == 1
    assert trust("The vendor shall test the portal in browsers where JavaScript is switched off. The client shall pay.", filler) == -1
    for s in ("dated xx/xx/20xx", "from xx-xx-20", "Xx.xX.20xx", "dd/mm/yyyy", "yyyy-mm-dd", "cLICK to add a name"):
        assert has_field(s), s
    page = "Page not found. The page you asked for has gone missing from our server or has moved to another place. Please go back to the start page and look for it there, or try again later. "
    assert trust(page * 4, filler) == 1 and trust("Page not found. " + "We walked along the river and saw birds. " * 40, filler) == 0
    assert trust("Hi", filler) == 0 and trust("", filler) == 0


def test_residue(spark):
    body = "The vendor shall deliver the goods. The client agrees to pay the fees within thirty days of invoice. "
    texts = {
        1: "JavaScript is disabled. The viewer needs scripts to run. 5f6d938b", 2: "JavaScript is disabled. The viewer needs scripts to run!", 3: body * 5, 4: body * 5 + "Fee: {{amount}}", 5: body + "Lorem ipsum dolor lorem ipsum dolor", 6: None, 7: "", 8: "\n", 9: "Hi", 10: "See attached",
        11: "Lorem ipsum " * 2000, 12: "Sample text here.\nSample text here.", 13: body * 3000, 14: "Signature: ________",
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] * 2, "idx int, text string, reason string, h int")
    got = {r["idx"]: r["reason"] for r in residue(df, "idx", "text").collect()}
    assert got == {1: "message", 2: "message", 4: "field", 5: "filler", 11: "filler", 12: "filler"}
    assert residue(spark.createDataFrame([], "idx int, text string"), "idx", "text").count() == 0


def test_filler_counts_do_not_depend_on_the_split(spark):
    df = spark.createDataFrame([("lorem ipsum contract contract dolor dolor",)] + [("the contract",)] * 12, "text string")
    for n in (1, 13):
        assert filler_words(df.repartition(n), "text") == {"lorem", "ipsum", "dolor"}, n


def test_near_classes_against_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(6)) for _ in range(3000)]
    texts = []
    for n in (4, 8, 9, 10, 12, 20, 40, 60, 200):
        for _ in range(40):
            base = r.sample(words, n)
            # as far apart as 0.8 allows: words more, words less, words replaced
            texts += [base, base + r.sample(words, n // 4), base[: n - n // 5], base[: n - n // 9] + r.sample(words, n // 9)]
    sets = [set(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    reader = Reader(set())
    rows = [(i, reader.words(" ".join(t)), int(math.log(len(set(t))) / math.log(1.25))) for i, t in enumerate(texts)]
    # keys as for this many classes, and as for a million times as many
    for parts in (key_parts(len(texts)), key_parts(1000 * len(texts))):
        p = class_prints(spark.createDataFrame(rows, "h long, toks array<long>, c int"), parts).cache()
        got = {(x["ha"], x["hb"]) for x in near_classes(p, p, parts.shape[1]).where("ha < hb").collect()}
        assert len(want) > 1000 and got <= want and len(got) >= 0.99 * len(want), parts.shape


def test_unseen_residue():
    """Wordings that are in no table and no list."""
    for s in (
        "Oops! That link is broken. Head back to the home page.", "Bad request. Your browser sent something this server did not understand.", "502 Bad Gateway\nnginx", "You must switch on cookies, then reload the site.", "Session expired. Please log in again to continue.",
        "Sorry, the website is offline right now. Try again tomorrow.", "Whoops, an unexpected error happened on the server.", "This plugin is blocked. Enable it in your browser.", "Status 503: too many requests", "Your browser is unsupported, please upgrade.",
    ):
        assert trust(s, {"lorem"}) == 1, s
    for s in ("The price is <AMOUNT> a month.", "Dear __CLIENT_NAME__,", "signed by [[ClientName]]", "of %COMPANY_NAME% and", "{{#each items}}", "on <START DATE>", "[to be confirmed]", "[enter the amount here]", "(insert name)", "{{ counterparty.address }}"):
        assert has_field(s), s
    for s in ("a line _______ to sign", "The site is closed. We walk on.", "x < Y and Y > z", "50% OF 70% of it", "see (a) and (b)", "the «General Terms» and more «of such a long and winding kind»"):
        assert not has_field(s) and trust(s, {"lorem"}) == 0, s


def test_label_spreads_to_near_duplicates(spark):
    said = "nothing to see in this place today because our machine is resting"
    texts = {
        1: said + " page not found", 2: said + " page not here", 3: said + " page quiet here", 4: "wholly other words that nobody has put into any list of messages",
        # a genuine near-duplicate holds the label back
        5: "one two three four five six seven eight nine ten eleven page not found", 6: "one two three four five six seven eight nine ten eleven page not", 7: "one two three four five six seven eight nine ten eleven page shall shall",
    }
    assert [trust(texts[i], set()) for i in sorted(texts)] == [1, 0, 0, 0, 1, 0, -1]
    got = {r["idx"]: r["reason"] for r in residue(spark.createDataFrame(list(texts.items()), "idx int, text string"), "idx", "text").collect()}
    assert got == {1: "message", 2: "near", 3: "near", 5: "message"}


# ---- packing


def test_plan():
    for seed in range(60):
        r = random.Random(seed)
        counts = {r.randint(1, 64): r.randint(1, 25) for _ in range(r.randint(1, 30))}
        runs = plan(counts, 64)
        load, seen = {}, {}
        for s, first, start, n, each in runs:
            assert first == seen.get(s, 0)
            seen[s] = first + n * each
            for k in range(n):
                load[start + k] = load.get(start + k, 0) + s * each
        assert seen == counts and max(load.values()) <= 64 and sorted(load) == list(range(len(load)))
        # as good as best fit, item by item
        gaps = []
        for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                gaps.append(64 - s)
        assert len(load) <= len(gaps) + 1
    assert plan({}, 64) == []
    with pytest.raises(ValueError):
        plan({65: 1}, 64)


def test_packed(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice([1, 5, 30, 90]))) for _ in range(60)] + ["", None, "word " * 700, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1)).repartition(3)
    items = token_items(df, "doc_id", "text", 64)
    boxes = packed(items, 64)
    rows = boxes.collect()
    load, parts = {}, {}
    for x in rows:
        load[x["container"]] = load.get(x["container"], 0) + x["n_tokens"]
        parts.setdefault(x["doc_id"], []).append((x["start"], x["n_tokens"]))
    assert max(load.values()) <= 64 and 60 not in parts and 61 not in parts
    for p in parts.values():
        p.sort()
        assert [s for s, _ in p] == list(itertools.accumulate([0, *(n for _, n in p[:-1])]))
        assert len(p) == 1 or all(n == 64 for _, n in p[:-1])
    rep = fill_report(boxes, 64).first()
    assert rep["containers"] == len(load) and rep["tokens"] == sum(load.values()) and rep["containers"] <= rep["least_containers"] * 1.1 + 1
    assert packed(token_items(df.limit(0), "doc_id", "text", 64), 64).count() == 0


def test_pairs_of_a_long_run_come_in_bounded_portions():
    lo, ln = np.array([0, 3, 4]), np.array([3, 1, 300])
    got = [list(zip(left.tolist(), right.tolist())) for left, right in _run_pairs(lo, ln, 500)]
    assert max(map(len, got)) <= 500
    assert sorted(p for x in got for p in x) == sorted((i, j) for a, n in zip(lo.tolist(), ln.tolist()) for i in range(a, a + n) for j in range(i + 1, a + n))
    # one member's pairs stay together, however few are asked for
    assert [len(left) for left, _ in _run_pairs(np.array([5]), np.array([4]), 2) if len(left)] == [3, 2, 1]
    assert list(_run_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)) == []
