"""Labelled lines, made up from a grammar of its own, to train the weights of ``pii``.

``python -m corpusloom.llm.pii_train`` writes ``pii_weights.json``; the number of
lines is the documented bound of the sample.
"""

from __future__ import annotations

import json
import random

from . import pii

LINES = 6000

_SYL = "ba ce do fi gu ha je ki lo mu na pe qui ro sa te vi wo xa ye zu bri cla dre flo gri kle mor nel pol ran ster tal vor zan lin kut".split()
_POOL = (
    "garden river market window engine winter orchard bridge lantern teacher harvest museum kitchen ladder mountain village library station barrel blanket meadow hammer saddle pocket corner summer evening morning story letter bottle candle forest island valley copper silver wooden "
    "narrow gentle quiet heavy early later slowly often walk carry build watch paint repair gather follow borrow measure polish open close bring keep find lose read send water bread paper stone cloud rain glass wheel table chair floor roof wall bell song game road street lane avenue works "
    "le la une des dans pour avec jardin marché fenêtre rivière lettre porter garder ouvrir trouver chaque petit grand"
).split()
_ARABIC = "حديقة نهر سوق نافذة رسالة صباح مساء كتاب جسر قرية يحمل يفتح يكتب".split()


def _plain(r: random.Random) -> str:
    """A sentence, a heading or a list of ordinary words."""
    pool = _ARABIC if r.random() < 0.12 else _POOL
    w = [r.choice(pool) for _ in range(r.randint(3, 9))]
    u = r.random()
    if u < 0.2:
        return " ".join(x.capitalize() for x in w[:4])
    if u < 0.3:
        return " ".join(w[:4]).upper()
    return " ".join([w[0].capitalize(), *w[1:]]) + r.choice([".", ".", ".", "", ";", " - " + r.choice(pool)])


def _word(r: random.Random, lo: int = 2, hi: int = 3) -> str:
    return "".join(r.choice(_SYL) for _ in range(r.randint(lo, hi))).capitalize()


def _company(r: random.Random) -> str:
    return f"{_word(r)} {_word(r)} {r.choice(pii.TRADES).capitalize()} {r.choice(['LLC', 'Ltd', 'FZE', 'PLC', 'WLL', 'FZCO', 'PJSC', 'Limited', 'Inc'])}"


def _name(r: random.Random) -> str:
    g = r.choice(sorted(pii.GIVEN)).capitalize() if r.random() < 0.85 else _word(r)
    s = _word(r)
    t = r.choice(["Mr", "Mrs", "Ms", "Dr", "Mr.", "Ms.", "Dr.", "Prof."])
    return r.choice([f"{g} {s}"] * 3 + [f"{t} {g} {s}", f"{t} {s}", f"{g[0]}. {s}", f"{g} {s}-{_word(r)}", f"{s.upper()}, {g}", f"{g.upper()} {s.upper()}", f"{t} {g} {r.choice('ABKLMR')}. {s}", f"{g} {r.choice('ABKLMR')}. {s}"])


def _phone(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([f"+971-5{d(1)}-555-{d(4)} ext. {d(2)}", f"+971 4 555 {d(4)}", f"+9714555{d(4)}", f"00971 50 555 {d(4)}", f"050-555{d(4)}", f"(04) 555-{d(4)}", f"O4 555 {d(4)}", f"04 555 {d(4)}", f"020 7946 {d(4)}", f"+44 20 7946 {d(4)}", f"+1 (202) 555-{d(4)}", f"202.555.{d(4)}", f"01 99 00 {d(2)} {d(2)}", f"+33 1 99 00 {d(2)} {d(2)}", f"(202) 555-{d(4)}", f"202-555-{d(4)}"])


def _id(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    a = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    return r.choice([f"784-19{d(2)}-{d(7)}-{d(1)}", f"784 19{d(2)} {d(7)} {d(1)}", f"78419{d(2)}{d(8)}", f"9{d(2)}-{d(2)}-{d(4)}", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{r.choice('KNPZ')}{d(7)}", f"{a(5)}{d(4)}{a(1)}", d(r.choice([8, 9, 10, 11])), f"{a(2)}{d(6)}{a(1)}"])


def _mail(r: random.Random) -> str:
    u = r.choice([f"{_word(r)}.{_word(r)}", _word(r) + str(r.randint(1, 99)), "accounts", "legal.desk", f"{_word(r)}_{_word(r)}", f"{_word(r)}+deals"]).lower()
    h = r.choice([_word(r), "mail." + _word(r), _word(r) + "-legal"]).lower()
    e = r.choice(["example", "test", "invalid", "co.example", "com"])
    s = r.choice([f"{u}@{h}.{e}"] * 4 + [f"{u}(at){h}.{e}", f"{u} @ {h}.{e}", f"{u} [at] {h.replace('.', ' [dot] ')} [dot] {e.split('.')[-1]}", f"{u} at {h.split('.')[-1]} dot {e.split('.')[-1]}"])
    return s.upper() if r.random() < 0.15 and "at" not in s else s


def _address(r: random.Random) -> str:
    n, st = r.randint(1, 240), r.choice(["Street", "Road", "Lane", "Avenue", "Boulevard", "St.", "Rd", "Drive"])
    city = r.choice([_word(r), f"{_word(r)} {r.choice(['Bay', 'Cross', 'Harbour'])}", f"Al {_word(r)}"])
    w = r.choice([_word(r), _word(r), "Old " + _word(r)])
    return r.choice([f"{n} {w} {st}, {city}", f"No. {n} {w} {st}, {city}", f"Flat {n}{r.choice('ABC')}, {n} {w} {st}, {city}", f"Villa {n}, {w} {st}, {city} {r.randint(10000, 99999)}", f"Office {n}, {_word(r)} Tower, {w} {st}, {city}", f"{w} {st} {n}, {r.randint(10000, 99999)} {city}", f"{n}, rue des {_word(r)}s, {r.randint(10000, 99999)} {city}"])


_FRAME = {
    "name": ["We met {} at noon.", "Patient: {}", "Author: {}", "Guest: {}", "Dear {},", "Yours, {}", "Best, {}", "{} said so twice.", "{} wrote the report.", "According to {} it rained.", "prepared by {}", "approved by {} in May", "attention {}", "In the presence of {}", "{} is absent.", "{} has signed.", "An interview with {} follows.",
             "The letter of {} was lost.", "Madame {}", "rédigé par {}", "{} est présent", "السيدة {}", "بحضور {}", "{}", "{} called in the evening.", "Tenant: {}", "Name: {}", "The house belongs to {}.", "We thank {} for the loan.", "{}, born in spring, agrees.", "Sincerely, {}"],
    "phone": ["Ring {}", "Phone {}", "Telephone: {}", "Fax {}", "Cell {} only", "Dial {} now.", "WhatsApp {}", "She is reached at {} after six.", "Appelez le {} le soir", "Portable : {}", "اتصل {}", "{}", "T. {}", "M: {}", "Leave voicemail at {} before five.", "Our number is {}, day and night.", "tél {}"],
    "id_number": ["SSN {}", "social security {}", "Passport: {}", "passport number {} is valid", "ID no. {}", "national ID {}", "Identity card {} was shown.", "tax ID {}", "(PAN {})", "carte d’identité {}", "numéro de passeport {}", "passeport n° {}", "رقم الهوية {}", "جواز السفر: {}", "driving licence {}", "National insurance {}"],
    "email": ["Mail me at {}", "Reply to {}", "e-mail: {}", "mailto:{}", "Copy {} in.", "Send it to {} today.", "Questions? <{}>", "courriel {}", "Envoyez-le à {}", "ايميل {}", "{}", "Ask {} or wait", "The address <{}> is new."],
    "address": ["We live at {}.", "Ship to: {}", "Our office at {} is closed.", "located at {}", "They moved to {}.", "Home: {}", "The flat is at {}.", "domicilié au {}", "يسكن في {}", "Parcels are delivered to {}", "Venue: {}", "Residence: {}", "living in {}", "adresse {}", "The key is at {}."],
}
_MAKE = {"name": _name, "phone": _phone, "id_number": _id, "email": _mail, "address": _address}


def _decoy(r: random.Random) -> str:
    """Numbers and capitals that are no item."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    a = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    g = lambda: r.choice(sorted(pii.GIVEN)).capitalize()
    noun = r.choice(["Docket", "Invoice", "Batch", "Serial", "Model", "Account", "Lot", "Order", "Chapter", "Index", "File", "Case", "Version", "Counter", "Meter"])
    number = r.choice([d(7), d(9), d(6), f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(4)} {d(4)}", f"{d(2)} {d(3)} {d(4)}", f"{d(3)}.{d(4)}.{d(2)}", f"{d(4)}/{d(3)}", f"{d(1)}.{d(1)}.{d(1)}", f"{a(3)}-20-{d(4)}-{d(4)}", f"{a(2)}-{d(4)}-{d(5)}", f"{d(2)}-{d(2)}", d(4)])
    return r.choice(
        [f"{noun} {number} is closed.", f"{noun} no. {number}", f"{noun.lower()} {number} and {noun.lower()} {d(9)}", f"The counter shows {d(7)} and {d(7)} clicks.", f"{d(3)} boxes hold {d(4)} pieces of {d(2)} mm", f"USD {d(3)},{d(3)}.00", f"{d(2)} lamps @ {d(1)}.5 each", f"5.5% @ noon", f"GB{d(2)} {a(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"IBAN {a(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(19), d(16),
         f"On 2021-0{d(1)}-1{d(1)} at 10:{d(2)}", f"Point {d(2)}.{d(4)}, {d(2)}.{d(4)}", f"The ship {g()} lies beside the {g()}.", f"aboard the {g()}", f"Hotel {g()} is full", f"{g()} Street works go on.", f"{_word(r)} Road is narrow", "Street lamps on the avenue", f"Lane {d(1)} and road {d(2)}", f"{d(3)} metres of road",
         f"Between {_company(r)} and the buyer", f"Between {_word(r)} {_word(r)} and the buyer", f"Entre {_word(r)} {_word(r)} et", f"Prices / {_company(r)}", f"Prices / {_word(r)} {_word(r)}", _company(r), f"Client: {_company(r)}", f"Company: {_company(r)}", f"For {_company(r)}", f"{g()} {_company(r)} agreed.", f"Owner: {_word(r)} {_company(r)}", f"The sale to {_company(r)} was signed.", f"{_company(r)} has signed.",
         "Mr. or Mrs. may be left out", "Identity papers and a passport are needed.", "The phone and the mail are down.", f"Identity of {d(2)} guests", "Name and address below", f"Call on day {d(1)}"]
    )


def line(r: random.Random) -> tuple[str, set[tuple[int, int, str]], str]:
    """A line, its items, and the line above."""
    text, gold, above = "", set(), ""
    for _ in range(r.randint(1, 4)):
        if text:
            text += r.choice([" ", " ", " ", "  ", " | "]) if not text.endswith(" ") else ""
        u = r.random()
        if u < 0.25:
            text += _plain(r)
        elif u < 0.45:
            text += _decoy(r)
        else:
            k = r.choice(pii.KINDS)
            frame = r.choice(_FRAME[k])
            item = _MAKE[k](r)
            if frame == "{}" and text and k == "name":
                frame = r.choice([x for x in _FRAME[k] if x != "{}"])
            i = len(text) + frame.index("{}")
            text += frame.replace("{}", item)
            gold.add((i, i + len(item), k))
    if len(gold) == 1 and r.random() < 0.2:
        item = _name(r)
        if r.random() < 0.15:
            text, gold, above = (g := r.choice(sorted(pii.GIVEN)).capitalize()), {(0, len(g), "name")}, r.choice(["Best wishes,", "Thanks,", "Kind regards,"])
            return text, gold, above
        text, gold, above = item, {(0, len(item), "name")}, r.choice(["Warm regards,", "Many thanks,", "Yours truly,", "Cordialement,", ""])
    return text, gold, above


def sample(n: int, seed: int) -> list[tuple[list, set]]:
    r = random.Random(seed)
    words = frozenset(w.lower() for w in _POOL) - pii.GIVEN
    out = []
    for _ in range(n):
        t, gold, above = line(r)
        # a tenth of the given names isn't known, as in other texts
        given = frozenset(x for x in pii.GIVEN if r.random() < 0.9)
        # any single word may be missing in front and behind
        cand = [(i, j, k, [x for x in f if x[:2] not in ("b=", "a=") or r.random() < 0.6]) for i, j, k, f in pii.spans(t, words, given, above)]
        out.append((cand, gold))
    return out


def accuracy(lines: list[tuple[list, set]], w: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind, by exact span."""
    tp, got, want = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for cand, gold in lines:
        found = set(pii.decode(cand, w))
        for k in pii.KINDS:
            a, b = {x for x in found if x[2] == k}, {x for x in gold if x[2] == k}
            tp[k] += len(a & b)
            got[k] += len(a)
            want[k] += len(b)
    return {k: (tp[k] / max(1, got[k]), tp[k] / max(1, want[k])) for k in pii.KINDS}


def main() -> None:
    w = pii.fit(sample(LINES, 7))
    print(accuracy(sample(2000, 8), w))
    pii.WEIGHTS.write_text(json.dumps({k: round(v, 3) for k, v in sorted(w.items()) if abs(v) >= 0.02}, ensure_ascii=False, indent=0))


if __name__ == "__main__":
    main()
