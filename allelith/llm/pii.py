"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Base kinds (email, ip, card, phone) follow their given expressions, leftmost non-overlapping per kind; matches that
fail a kind's test are dropped without retry. High-recall generators then propose overlapping spans; boosted trees
score each by its format and context; where the calibrated probability reaches its kind's own threshold, and no base span
and no better candidate overlaps, it is added.

There are no span labels, so they are planted. Base spans of a bounded sample of documents are taken with the text around
them and written anew as people write what should not be found (`name (at) host (dot) org`, dotted cards, phones
without +, defanged addresses), or put side by side so that the base expressions run them together; account and id numbers, which no
base kind covers, are made up. These are the positives. Negatives are look-alikes in the same surroundings: broken
checksums, dates, versions, order and part numbers, handles, numbers out of range. Whether a candidate may be added
(no base span overlaps it) plays no part in its label. The trees are fitted on the driver; a quarter of the planted
texts calibrates probabilities (Platt) and sets each kind's threshold at the asked precision. Offsets are code points.

The expressions below match what the given ones match. A run of characters that failed at its start fails at every
later start inside it, so a match may begin only where a run begins or where the last match ended; with possessive
repeats this makes the scan linear in the text's length.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows each give a row; an empty
table or one without base spans is scored by trees from made-up surroundings; of candidates with equal probability the
earlier wins, then the generator listed later; only doc_id and text are read of other columns, so that names can't clash.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import text_or_empty

#: Base kinds in the order in which spans with one start are listed, with their expressions.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINT = {"email": "@", "phone": "+"}
#: A dot within an address as the generators take it; one with a blank after it alone ends a sentence.
DOT = r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20?\.(?!\x20)|\x20\.\x20)"
#: A dot of a defanged address.
IP_DOT = r"(?:\.|\[\.\]|\(\.\)|\x20?(?:\(dot\)|\[dot\])\x20?)"
#: Countries by the length of their account numbers; others are taken in fours and a shorter end.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _ibans() -> str:
    def rest(n: int) -> str:
        return rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    return "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, c in IBANS.items())


#: Generators of candidates, more generous than the base kinds and free to overlap them and each other.
GENERATORS = {
    "x_email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}",
    "x_ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "x_card": r"(?<![0-9A-Za-z])[0-9](?:[\x20./-]?[0-9]){11,18}(?![0-9A-Za-z])",
    "x_phone": r"(?<![0-9A-Za-z])\+?[(]?[0-9][\x20().0-9/-]{6,22}[0-9](?![0-9A-Za-z])",
    "x_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "x_iban": rf"(?<![A-Za-z0-9])(?:{_ibans()}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
}
#: Words before a span that speak for personal data.
CONTEXT = r"(?i)(mail|phone|tel|call|fax|mobile|card|visa|iban|ssn|ip|address|contact)[^A-Za-z]*$"
#: What a generator's own test asks of a span or of the text before it.
_LABELS = rf"[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}"
MAIL = rf"^[^@]+?(?:\x20?(?:\(at\)|\[at\])\x20?{_LABELS}[A-Za-z]{{2,24}}|@{_LABELS}[A-Za-z]{{2,24}}|\x20?@\x20?{_LABELS}(?i:com|org|net|edu|gov|info|io|eu|us|uk|de|fr|es|it|nl|ch|at|be|pl|pt|se|no|dk|fi|jp|cn|in|br|au|ca))$"
CARD_GROUPS = r"^[0-9](?:[\x20-]?[0-9])+$|^[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([./])[0-9]{6}\2[0-9]{5}$"
PHONE_FORMATS = (
    r"^(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[.-][0-9]{4}$"
    r"|^(?:\(0[1-9][0-9]{1,3}\)\x20?|0[1-9][0-9]{1,3}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}$|^0[1-9](?:[\x20.-][0-9]{2}){4}$"
)
NOT_PHONE = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^(?:19|20)[0-9]{2}[\x20./-]|[./-](?:19|20)[0-9]{2}$|^[0-9]+\.[0-9]+$"
PHONE_CONTEXT = r"(?i)(?<![A-Za-z])(?:(?:tele)?phones?|tel|call|fax|mobile|cell|contact)(?:\x20(?:number|no|us|me|him|her|them|at|on|is)(?![A-Za-z]))*[^A-Za-z0-9]*$"
SSN = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
KINDS = (*BASE, *GENERATORS)
BLOCK, CHUNK = 128, 4096
#: Stands between planted texts in the plan's constant.
MARK = "\x01"


def _matched(text: Column, pattern: str, kind: str) -> Column:
    hint = HINT.get(kind)
    return F.when(text.contains(hint) if hint else text.rlike("[0-9]" if kind != "x_email" else r"@|\(at\)|\[at\]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _placed(found: Column, gaps: Column) -> Column:
    """Matches with their starts, from the texts between them. Blocks keep the copying of growing arrays small."""

    def add(acc: Column, i: Column) -> Column:
        gap = F.char_length(F.element_at(gaps, i + 1))
        return F.struct(
            (acc["at"] + gap + F.char_length(F.element_at(found, i + 1))).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + gap).cast("int").alias("s"), F.element_at(found, i + 1).alias("t")))).alias("out"),
        )

    def block(acc: Column, b: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        part = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(found)) - 1), start, add)
        # one more level, so that part is computed once
        return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out"))), 1)

    none = F.array().cast("array<struct<s:int,t:string>>")
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block)
    return F.when(F.size(found) > 0, whole["out"]).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    """Whether the digits of t pass Luhn's test."""
    d = F.reverse(_digits(t))

    def digit(i: Column) -> Column:
        v = F.try_to_number(F.substring(d, i + 1, F.lit(1)), F.lit("9")).cast("int") * (i % 2 + 1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) > 3) | (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) > 255))
    if kind == "card":
        return F.when(_between(F.char_length(_digits(t)), 12, 19), _luhn(t)).otherwise(False)
    if kind == "phone":
        return _between(F.char_length(_digits(t)), 9, 15)
    return F.lit(True)


def _mod97(t: Column) -> Column:
    """Whether t passes the test of account numbers: its first four characters moved to the end, letters as 10 to 35."""
    t = F.regexp_replace(t, r"\x20", "")
    r = F.concat(F.substring(t, F.lit(5), F.char_length(t)), F.substring(t, 1, 4))

    def add(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(r, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(r)), F.lit(0), add) == 1


def _spans(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One column for each kind: array of (s, t)."""
    df = df.withColumns({f"m_{k}": _matched(F.col("text"), p, k) for k, p in patterns.items()})
    df = df.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p)) for k, p in patterns.items()})
    df = df.withColumns({f"a_{k}": _placed(F.coalesce(F.col(f"m_{k}"), F.array().cast("array<string>")), F.col(f"g_{k}")) for k in patterns})
    return df.drop(*(f"{x}_{k}" for k in patterns for x in "mg"))


def _typed(kinds, valid: bool) -> Column:
    """The kinds' spans in one array of (s, k, e, t); k: the kind's place in KINDS."""

    def typed(kind: str) -> Column:
        spans = F.filter(f"a_{kind}", lambda x: _valid(kind, x["t"])) if valid else F.col(f"a_{kind}")
        place = F.lit(KINDS.index(kind)).alias("k")
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), place, (x["s"] + F.char_length(x["t"])).alias("e"), x["t"].alias("t")))

    return F.concat(*(typed(k) for k in kinds))


def _features(x: Column, text: Column) -> list[Column]:
    """What the trees see of a candidate: its generator, form, checksums and number ranges, and the text before it."""
    t, n, k = x["t"], F.char_length(x["t"]), x["k"]
    digits = F.char_length(_digits(t))
    before = F.when(x["s"] > 0, F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))).otherwise("")
    bit = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda chars: (n - F.char_length(F.regexp_replace(t, chars, ""))).cast("double")
    only = lambda kind, test: F.when(k == KINDS.index(kind), test)
    return [
        k.cast("double"), n.cast("double"), digits.cast("double"), count("[A-Za-z]"), count(r"\."), count(r"[\x20]"), count("-"), count("[()]"), count("@"), bit(t.startswith("+")),
        bit(F.when(_between(digits, 12, 19), _luhn(t))), bit(only("x_iban", _mod97(t))), bit(only("x_id", t.rlike(SSN))), bit(only("x_ip", _valid("ip", t))),
        bit(only("x_email", t.rlike(MAIL))), bit(only("x_card", t.rlike(CARD_GROUPS))), bit(only("x_phone", t.rlike(PHONE_FORMATS))), bit(only("x_phone", t.rlike(NOT_PHONE))),
        bit(only("x_phone", before.rlike(PHONE_CONTEXT))), bit(before.rlike(CONTEXT)), bit(before.rlike(r"[=:#\"'/]$")), bit(before.rlike(r"\x20$|^$")),
    ]


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _candidates(df: DataFrame) -> DataFrame:
    """base: validated base spans; cands: (s, k, e, t, f, covers) of the generators' spans, f their features."""
    df = _spans(df, BASE | GENERATORS).withColumns({"base": F.sort_array(_typed(BASE, True)), "proposed": _typed(GENERATORS, False)})
    return df.withColumn(
        "cands",
        F.transform(
            "proposed",
            lambda x: F.struct(
                x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.array(*_features(x, F.col("text"))).alias("f"), F.exists("base", lambda b: _overlap(x, b)).alias("covers")
            ),
        ),
    ).select("doc_id", "text", "base", "cands")


def _luhn_digits(rng: random.Random, n: int, passing: bool) -> str:
    while True:
        d = str(rng.randint(2, 6)) + "".join(rng.choice("0123456789") for _ in range(n - 1))
        if (sum(sum(divmod(int(c) * (i % 2 + 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0) is passing:
            return d


def _iban(rng: random.Random, passing: bool) -> str:
    country, body = rng.choice((("DE", 18), ("BE", 12), ("GB", 18), ("FR", 23), ("AT", 16), ("NL", 14)))
    letters = "".join(rng.choice("ABCDEFGHKLMNPRSTW") for _ in range(4)) if country in ("GB", "NL") else ""
    body = letters + "".join(rng.choice("0123456789") for _ in range(body - len(letters)))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    made = f"{country}{check if passing else (check + rng.randint(1, 90)) % 97:02d}{body}"
    return made if rng.random() < 0.5 else " ".join(made[j : j + 4] for j in range(0, len(made), 4))


def _forms(rng: random.Random, kind: str, base: str | None) -> tuple[str, str, str, bool]:
    """(before, span, after, whether it is personal data) of one planted example of a generator; base: a base span to be
    written anew, if the sample has one of the kind."""
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    good = rng.random() < 0.5
    if kind == "x_email":
        if not good:
            return "", rng.choice((f"{word()} @ {word()}.{word()}{num(2)}", f"{word()} @ {word()}.{num(2)}", f"{word()}(at){word()}.{num(3)}", f"{word()} @ {word()}.{word()}.{word()}")), "", False
        name, _, host = (base or f"{word()}@{word()}.{rng.choice(('com', 'org', 'net', 'de'))}").partition("@")
        at, dot = rng.choice(((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", ".")))
        return "", name + at + (host if at != " @ " else f"{word()}.com").replace(".", dot), "", True
    if kind == "x_ip":
        parts = (base or ".".join(str(rng.randint(0, 255)) for _ in range(4))).split(".")
        if not good:
            parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return "", rng.choice(("[.]", "(.)", "[dot]", " (dot) ") if good or rng.random() < 0.5 else (".",)).join(str(int(x) % 1000) for x in parts), "", good
    if kind == "x_card":
        digits = "".join(c for c in base if c.isdigit()) if good and base else _luhn_digits(rng, 16, good)
        if good and rng.random() < 0.25:  # beside a phone the base expressions run into it
            return f"+1 ({num(3)}) {num(3)}-{num(4)} ", digits, "", True
        return "", rng.choice((".", "/") if good or rng.random() < 0.7 else ("", " ", "-")).join(digits[j : j + 4] for j in range(0, len(digits), 4)), "", good
    if kind == "x_phone":
        plain = "".join(c for c in base or "" if c.isdigit())[-10:]
        lead = rng.choice(("call ", "phone: ", "tel ", "Tel. ", "mobile ", "fax ", "contact us at ", "call me on "))
        if good:
            return rng.choice(
                (
                    ("", f"({rng.randint(2, 9)}{num(2)}) {rng.randint(2, 9)}{num(2)}-{num(4)}", "", True), ("", f"{rng.randint(2, 9)}{num(2)}-{rng.randint(2, 9)}{num(2)}-{num(4)}", "", True),
                    (lead, f"0{rng.randint(20, 89)} {num(4)} {num(4)}", "", True), ("", f"0{rng.randint(20, 89)} {num(4)} {num(4)}", "", True), (lead, f"{rng.randint(200, 999)} {num(4)}", "", True),
                    (lead, plain if 7 <= len(plain) else num(9), "", True), (lead, f"{num(4)} {num(5)}", "", True), ("", f"0{rng.randint(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}", "", True),
                    ("", f"+1 ({rng.randint(200, 999)}) {num(3)}-{num(4)}", f" {_luhn_digits(rng, 16, True)}", True), (lead, f"+{rng.randint(30, 59)} {num(3)} {num(7)}", f" {num(9)}", True),
                )
            )
        year = rng.randint(1900, 2030)
        return rng.choice(
            (
                ("", f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "", False), ("", f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{year}", "", False), ("", f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{year}", "", False),
                (f"{word()} ", f"{rng.randint(1, 9)}{num(3)} {num(rng.randint(3, 6))}", "", False), ("order ", f"{rng.randint(1, 9)}{num(rng.randint(7, 11))}", "", False), ("part ", f"{rng.randint(1, 9)}{num(6)} {num(2)}", "", False),
                ("version ", ".".join(str(rng.randint(0, 99)) for _ in range(rng.randint(3, 5))) + num(3), "", False), ("ISBN ", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", "", False), ("", f"{year}-{year + 5} {num(4)}", "", False),
                ("total ", f"{rng.randint(1, 999)}.{num(3)}.{num(3)}", "", False), (f"{word()} ", f"{num(3)}-{num(2)}-{num(4)}", "", False), ("page ", f"{rng.randint(1, 9)}{num(2)}-{num(3)} {num(4)}", "", False),
            )
        )
    if kind == "x_id":
        area = f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}" if good else rng.choice(("000", "666", "9" + num(2)))
        return "", f"{area}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "", good
    return "", _iban(rng, good), "", good


def planted(found: list[tuple[str, str, str, str]], each: int, seed: int = 5) -> list[tuple[str, int, int, int, bool]]:
    """(text, start, end, place of the generator in KINDS, whether it is personal data): `each` texts for each generator, set in
    the surroundings of the base spans found (kind, span, text before, text after), in made-up ones where there are none."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    for kind in GENERATORS:
        own = [f for f in found if f"x_{f[0]}" == kind]
        for i in range(each):
            before, span, after, good = _forms(rng, kind, own[i % len(own)][1] if own else None)
            _, _, lead, trail = rng.choice(found) if found and i % 2 else ("", "", f"{word()} {word()}", f"{word()} {word()}")
            # digits and joints of the surroundings would run into the span
            lead, trail = lead.rstrip("0123456789 +-./(@"), trail.lstrip("0123456789 +-./)@")
            text = f"{lead} {before}"
            out.append((f"{text}{span}{after} {trail}".replace(MARK, " "), len(text), len(text) + len(span), KINDS.index(kind), good))
    return out


def surroundings(docs: DataFrame, sample_docs: int, sample_rows: int, seed: int) -> list[tuple[str, str, str, str]]:
    """(kind, span, text before, text after) of base spans of about sample_docs documents, sample_rows of them at most."""
    part = min(1.0, sample_docs / max(1, docs.count()))
    few = docs.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    spans = _spans(few, BASE).withColumn("base", F.sort_array(_typed(BASE, True)))
    each = spans.select("doc_id", "text", F.explode_outer("base").alias("b")).where("b is not null")
    near = each.select(
        F.xxhash64(F.lit(seed), "doc_id", "b.s", "b.k").alias("r"), "b.k", "b.t",
        F.substring("text", F.greatest(F.col("b.s") - 23, F.lit(1)), F.least(F.col("b.s"), F.lit(24))).alias("lead"), F.substring("text", F.col("b.e") + 1, F.lit(12)).alias("trail"),
    )
    return [(KINDS[r.k], r.t, r.lead, r.trail) for r in near.where(F.char_length("t") <= 64).orderBy("r", "k", "t").limit(sample_rows).collect()]


def fit_candidates(docs: DataFrame, sample_docs: int, sample_rows: int, each: int = 240, precision: float = 0.98, seed: int = 11) -> tuple[boost.Boosted, list[float]]:
    """Trees from planted examples, and each kind's threshold (by its place in KINDS)."""
    made = planted(surroundings(docs, sample_docs, sample_rows, seed), each)
    wanted = {(i, s, e, k): good for i, (_, s, e, k, good) in enumerate(made)}
    texts = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(MARK.join(m[0] for m in made)), MARK)).alias("doc_id", "text"))
    # an inner explode would let the optimizer push a filter on the whole expression down to the scan, evaluated anew for each element
    rows = _candidates(texts).select("doc_id", F.explode_outer("cands").alias("c")).where("c is not null").select("doc_id", "c.s", "c.e", "c.k", "c.f").collect()
    rows = sorted((r.doc_id, r.s, r.k, r.f, wanted[r.doc_id, r.s, r.e, r.k]) for r in rows if (r.doc_id, r.s, r.e, r.k) in wanted)
    x, y, held = np.array([r[3] for r in rows], float), np.array([r[4] for r in rows], float), np.array([r[0] % 4 == 0 for r in rows], bool)
    model = boost.fit(x, y, held, trees=32)
    p, kind = model.probability(x), np.array([r[2] for r in rows])
    return model, [least_at(p[held & (kind == k)], y[held & (kind == k)], precision) for k in range(len(KINDS))]


def least_at(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold from a half on at which so large a share of what reaches it is positive; midway to what doesn't."""
    at = np.unique(p[p >= 0.5])
    right = [a for a in at if y[p >= a].mean() >= precision]
    if not right:
        return 0.9
    below = p[p < right[0]]
    return float(max(0.5, (right[0] + below.max()) / 2 if len(below) else 0.5))


def between(chunks: Column, a: Column, b: Column) -> Column:
    """The characters from a up to b of a text given as chunks of CHUNK characters, so that no call walks the whole text."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    first = F.substring(F.coalesce(F.get(chunks, i), F.lit("")), a % CHUNK + 1, F.when(i == j, b - a).otherwise(F.lit(CHUNK)))
    rest = F.concat(F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(chunks, j), F.lit("")), F.lit(1), b % CHUNK))
    return F.when(b <= a, "").when(i == j, first).otherwise(F.concat(first, rest))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span (s, k, e), sorted, replaced by its kind's tag; of overlapping spans the later ones lose what is gone."""
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")

    def add(acc: Column, x: Column) -> Column:
        region = F.struct(F.greatest(x["s"], acc["at"]).alias("s"), x["e"].alias("e"), x["k"].alias("k"))
        return F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(region)).alias("out")))

    tags = F.array(*(F.lit(f"[{k.removeprefix('x_').upper()}]") for k in KINDS))

    def written(both: Column) -> Column:
        chunks, cuts = both["chunks"], both["cuts"]
        n = F.size(cuts)
        piece = lambda i: F.concat(
            between(chunks, F.when(i > 0, F.get(cuts, i - 1)["e"]).otherwise(0), F.when(i < n, F.get(cuts, i)["s"]).otherwise(F.char_length(text))),
            F.when(i < n, F.element_at(tags, F.when(i < n, F.get(cuts, i)["k"]).otherwise(0) + 1)).otherwise(""),
        )
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), piece), "")

    cuts = F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(F.array(F.struct(chunks.alias("chunks"), cuts.alias("cuts"))), written), 1))


def find_pii(docs: DataFrame, precision: float = 0.98, sample_docs: int = 20_000, sample_rows: int = 4_000) -> DataFrame:
    """One row for each document; spans lists base and added spans, base_sha256 the base ones alone, redacted is the text with
    all of them replaced."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    model, cuts = fit_candidates(docs, sample_docs, sample_rows, precision=precision)
    n = len(_features(F.struct(F.lit("").alias("t"), F.lit(0).alias("s"), F.lit(0).alias("k")), F.lit("")))
    reach = F.array(*(F.lit(float(c)) for c in cuts))
    scored = _candidates(docs).withColumn(
        "scored",
        F.filter(
            F.transform(F.filter("cands", lambda c: ~c["covers"]), lambda c: F.struct(model.column([c["f"][i] for i in range(n)]).alias("p"), (-c["s"]).alias("o"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))),
            lambda c: c["p"] >= F.element_at(reach, c["k"] + 1),
        ),
    )
    added = F.filter("scored", lambda c: ~F.exists("scored", lambda d: _overlap(c, d) & (F.struct(d["p"], d["o"], d["k"]) > F.struct(c["p"], c["o"], c["k"]))))
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scored.withColumn("added", plain(added)).withColumn("every", F.sort_array(F.concat(plain(F.col("base")), F.col("added")))).select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(listed(plain(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("every")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        redacted(F.col("text"), F.col("every")).alias("redacted"),
    )
