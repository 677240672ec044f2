"""Personal data by candidates and gradient-boosted trees, in built-in Spark functions only.

Generators of high recall propose spans, which may overlap. Each candidate has features of its
format and of the text beside it; boosted trees, compiled to one SQL expression a tree, score it,
and a threshold for each kind, calibrated on examples kept apart, selects what is added to the base
rules' spans. The trees are fitted on the driver from generated examples whose features the same
expressions compute.
"""

from __future__ import annotations

import json
import math
import random
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The base rules. They are anchored where a leftmost match can begin and never give back, which
#: leaves the matches as they are and keeps long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")

#: Generators of candidates: written-out addresses, and runs of digits with separators.
LOOSE_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}|<at>| at |@) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>| dot |\.) ?[A-Za-z0-9-]++)++"
DIGITS = r"(?<![0-9])[+(]?[0-9](?:[ ().:/-]{0,2}[0-9]){6,}+"
#: Addresses whose dots are written so that nothing links to them.
LOOSE_IP = r"(?i)(?<![0-9.])[0-9]{1,3}(?: ?[\[({](?:\.|dot)[\])}] ?| dot | \. )[0-9]{1,3}(?:(?: ?[\[({](?:\.|dot)[\])}] ?| dot | ?\. ?)[0-9]{1,3}){2}(?![0-9])"
AROUND = 32
BLOCK = 256
MARK = "\u0001"
SAFE = "\u0002"
CUES = {
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|dial|ring|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil)\b",
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|correo|courriel)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|gateway|from)\b",
}
FEATURES = ("mail", "dotted", "mark", "digits", "groups", "first", "last", "plus", "paren", "dots", "dashes", "spaces", "colons", "luhn", "ip", "date", "glued", "cue_phone", "cue_email", "cue_card", "cue_ip")
TREES = 24
RATE = 0.3
EXAMPLES, ROUND = 1400, 7
PRECISION = 0.99


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at all matches; every second piece is a match. Offsets stay as they were."""
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, SAFE)).otherwise(text)
    return F.split(F.regexp_replace(safe, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` takes it."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(items: Column, state: Column, step, out: str) -> Column:
    """The outputs, of SQL type ``out``, of ``step(state, item)``, a pair of the next state and an
    output, over an array from left to right.

    Arrays grow by copying, so outputs are gathered a block at a time: the cost of an item is that
    of half a block, whatever the length of the array.
    """
    none = lambda t: F.array().cast(f"array<{t}>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, F.greatest(b, F.lit(0)) * BLOCK + 1, F.lit(BLOCK)))

    def item(acc: Column, x: Column) -> Column:
        after, made = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(made)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        own = F.struct(acc["state"].alias("state"), none(out).alias("out"))
        return F.aggregate(xs, own, item, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    begin = F.struct(state.alias("state"), none(f"array<{out}>").alias("outs"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, begin, block, lambda acc: F.flatten(acc["outs"]))).otherwise(none(out))


def _spans(pieces: Column, kind: Column | str) -> Column:
    """``array<struct<kind, s, e, v, before, after>>`` of the matches, in code points."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def spans(p: Column, ends: Column) -> Column:
        def one(i: Column) -> Column:
            before, after = F.right(F.get(p, i - 1), F.lit(AROUND)), F.left(F.get(p, i + 1), F.lit(AROUND))
            return F.struct(kind.alias("kind"), F.get(ends, i - 1).alias("s"), F.get(ends, i).alias("e"), F.get(p, i).alias("v"), before.alias("before"), after.alias("after"))

        return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one)

    ends = lambda p: _let(F.transform(p, lambda x: F.char_length(x)), lambda n: scan(n, F.lit(0), lambda at, x: (at + x, at + x), "int"))
    return _let(pieces, lambda p: F.when(F.size(p) > 2, _let(ends(p), lambda e: spans(p, e))).otherwise(_empty()))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.pmod(c.try_cast("int") * 2 - 1, F.lit(9)) + 1).otherwise(c.try_cast("int")) * F.when(c == "0", 0).otherwise(1))
    return F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(v).between(14, 40) & luhn(_digits(v))
    return F.length(_digits(v)).between(10, 15)


def _empty() -> Column:
    return F.array().cast("array<struct<kind:string,s:int,e:int,v:string,before:string,after:string>>")


def base_spans(text: Column, kind: str) -> Column:
    """The base rule's spans of one kind: leftmost, non-overlapping; failing matches are dropped."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    quick = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
    pieces = F.when(quick, _pieces(text, pattern))
    found = F.when(F.size(pieces) > 1, F.filter(_spans(pieces, kind), lambda x: _valid(kind, x["v"])))
    return F.coalesce(found, _empty())


def candidates(text: Column) -> Column:
    """What the generators propose, as spans by generator; those of different generators may overlap."""
    mail = F.when(text.rlike(r"(?i)[@\[({<]at[\])}>]|@| at "), _pieces(text, LOOSE_EMAIL))
    dotted = F.when(text.rlike(r"(?i)[0-9] ?(?:[\[({](?:\.|dot)[\])}]|dot |\. )"), _pieces(text, LOOSE_IP))
    digits = _pieces(text, DIGITS)
    part = lambda pieces, kind: F.coalesce(F.when(F.size(pieces) > 1, _spans(pieces, kind)), _empty())
    return F.concat(part(mail, "m"), part(digits, "d"), part(dotted, "n"))


def _count(v: Column, pattern: str) -> Column:
    return F.regexp_count(v, F.lit(pattern))


def features(c: Column) -> dict[str, Column]:
    """Numbers of a candidate's format and of the text beside it, by name."""
    v, before, after = c["v"], F.coalesce(c["before"], F.lit("")), F.coalesce(c["after"], F.lit(""))
    digits = _digits(v)
    whole = F.regexp_replace(v, r"[^0-9]+$", "")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    out = {
        "mail": flag(c["kind"] == "m"),
        "dotted": flag(c["kind"] == "n"),
        "mark": flag(v.rlike(r"(?i)[\[({<](?:at|dot|\.)[\])}>]")),
        "digits": F.length(digits),
        "groups": _count(v, "[0-9]+"),
        "first": F.length(F.regexp_extract(v, "([0-9]+)", 1)),
        "last": F.length(F.regexp_extract(whole, "([0-9]+)$", 1)),
        "plus": flag(F.startswith(v, F.lit("+"))),
        "paren": _count(v, r"[()]"),
        "dots": _count(v, r"\."),
        "dashes": _count(v, "-"),
        "spaces": _count(v, " "),
        "colons": _count(v, "[:/]"),
        "luhn": flag(F.when(F.length(digits).between(13, 19), luhn(digits))),
        "ip": flag(F.regexp_replace(v, r"[^0-9]+", ".").rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$") & (F.length(digits) <= 12)),
        "date": flag(v.rlike(r"^(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]|^[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2}|^(?:19|20)[0-9]{2}\D{1,2}(?:19|20)[0-9]{2}")),
        "glued": flag(before.rlike(r"[\p{L}_]$") | after.rlike(r"^[\p{L}_]")),
    }
    return out | {f"cue_{k}": flag(before.rlike(p)) for k, p in CUES.items()}


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str]]:
    """Generated ``(text, kind or none)``: each text holds one candidate."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllables = ("an", "ber", "con", "der", "en", "for", "ge", "hal", "in", "kel", "lo", "mi", "nor", "os", "pra", "que", "ra", "sto", "ti", "ver")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def card(sep: str) -> str:
        x = r.choice("3456") + d(14)
        total = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(x)))
        x += str(-total % 10)
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    cue = {"phone": ("call", "tel", "phone", "mobile", "fax", "telefon"), "card": ("card", "visa", "credit", "payment"), "email": ("mail", "contact", "write", "e-mail"), "ip": ("ip", "host", "server", "client")}
    mail = lambda: r.choice((f"{word()}.{word()} [at] {word()} [dot] com", f"{word()}(at){word()}(dot)org", f"{word()}{d(2)} [at] {word()}.com", f"{word()} at {word()} dot com", f"{word()} @ {word()}.net"))
    phone = lambda: r.choice((f"({d(3)}) 555-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"00{r.choice('123469')}{d(1)} {d(2)} {d(7)}"))
    part = lambda: str(r.randint(0, 255))
    address = lambda: r.choice(("[.]", "(.)", " [dot] ", "[dot]", " dot ", " . ")).join((str(r.randint(1, 223)), part(), part(), part()))
    clean = lambda: r.choice((" . ".join(str(r.randint(1, 999)) for _ in range(4)), "[.]".join((str(r.randint(256, 999)), d(3), d(2), d(1))), d(r.randint(7, 20)), f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {d(2)}:{d(2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{d(1)}.{d(9)}", f"{d(5)}/{d(4)}", f"{d(2)}:{d(2)}:{d(2)}.{d(3)}", f"{d(1)},{d(3)}".replace(",", " ") + f" {d(3)} {d(3)} {d(3)}"))
    out = []
    for i in range(n):
        kind = ("email", "phone", "card", "ip", "none", "none", "none")[i % ROUND]
        near = r.random() < 0.6
        lead = f"{word()} {word()} "
        if kind == "none":
            near = r.random() < 0.1
            body = clean() if r.random() < 0.8 else f"{word()} at {word()} . {word().title()}"
            lead += r.choice([x for v in cue.values() for x in v]) + " " if near else f"{word()} "
            if re_digits(body) and near and len(body) < 16:
                lead = f"{word()} {word()} "
        else:
            body = {"email": mail, "phone": phone, "ip": address, "card": lambda: card(r.choice((".", "/", "  ")))}[kind]()
            if kind == "phone" and r.random() < 0.2:
                body, near = d(10), True
            lead += r.choice(cue[kind]) + r.choice((" ", ": ", " is ")) if near else f"{word()} "
        out.append((f"{lead}{body} {word()} {word()}.", kind))
    return out


def re_digits(text: str) -> bool:
    return any(c.isdigit() for c in text)


def _fit_trees(x: list[list[int]], y: list[int], trees: int = TREES, rate: float = RATE, depth: int = 3, least: int = 8) -> tuple[float, list]:
    """Logistic gradient boosting with Newton leaves; a tree is ``(feature, cut, low, high)`` or a number."""
    base = math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5))
    score, out = [base] * len(y), []

    def grow(rows: list[int], g: list[float], h: list[float], left: int):
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for f in range(len(x[0])):
                by: dict[int, list[float]] = {}
                for i in rows:
                    e = by.setdefault(x[i][f], [0.0, 0.0, 0])
                    e[0] += g[i]
                    e[1] += h[i]
                    e[2] += 1
                a = b = n = 0.0
                for cut in sorted(by)[:-1]:
                    a, b, n = a + by[cut][0], b + by[cut][1], n + by[cut][2]
                    if least <= n <= len(rows) - least:
                        gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                        if gain > best[0]:
                            best = (gain, (f, cut))
        if best[1] is None:
            return rate * gs / (hs + 1)
        f, cut = best[1]
        return f, cut, grow([i for i in rows if x[i][f] <= cut], g, h, left - 1), grow([i for i in rows if x[i][f] > cut], g, h, left - 1)

    def value(tree, row: list[int]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(list(range(len(y))), [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p], depth)
        out.append(tree)
        score = [s + value(tree, row) for s, row in zip(score, x)]
    return base, [out, value]


def _expression(tree, names: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(names[FEATURES[tree[0]]] <= tree[1], _expression(tree[2], names)).otherwise(_expression(tree[3], names))


@cache
def _trained(application: str) -> dict[str, tuple[float, list, float]]:
    spark = SparkSession.getActiveSession()
    rows = json.dumps([{"i": i, "text": t} for i, (t, _) in enumerate(examples())])
    frame = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<i:int,text:string>>")))
    found = frame.select("i", F.explode(candidates(F.col("text"))).alias("c"))
    found = found.select("i", *(v.alias(k) for k, v in features(F.col("c")).items())).collect()
    kinds = [k for _, k in examples()]
    out = {}
    for kind in KINDS:
        mine = [(r["i"], [int(r[f]) for f in FEATURES], int(kinds[r["i"]] == kind)) for r in found]
        fit, held = [m for m in mine if m[0] // ROUND % 3], [m for m in mine if m[0] // ROUND % 3 == 0]  # examples come in rounds
        base, (trees, value) = _fit_trees([m[1] for m in fit], [m[2] for m in fit])
        scored = sorted(((base + sum(value(t, m[1]) for t in trees), m[2]) for m in held), reverse=True)
        threshold, right = math.inf, 0
        for n, (s, y) in enumerate(scored, 1):  # the lowest score down to which the kept examples are right
            right += y
            if right / n >= PRECISION and s > 0:
                threshold = s
        out[kind] = (base, trees, threshold)
    return out


def model(spark: SparkSession) -> dict[str, tuple[float, list, float]]:
    """By kind the trees' start, the trees and the calibrated threshold; fitted once an application."""
    return _trained(spark.sparkContext.applicationId)


def added_spans(text: Column, fitted: dict[str, tuple[float, list, float]]) -> Column:
    """Candidates of which the kind with the largest margin over its threshold is beyond it."""

    def judged(c: Column) -> Column:
        inner = F.struct(c.alias("c"), *(v.alias(k) for k, v in features(c).items()))
        return inner

    def margins(r: Column) -> Column:
        names = {f: r[f] for f in FEATURES}
        each = [F.struct((sum((_expression(t, names) for t in trees), F.lit(base)) - F.lit(threshold)).alias("margin"), F.lit(kind).alias("kind")) for kind, (base, trees, threshold) in fitted.items() if threshold < math.inf]
        best = F.array_max(F.array(*each)) if each else F.struct(F.lit(-1.0).alias("margin"), F.lit("").alias("kind"))
        return F.struct(best["kind"].alias("kind"), r["c"]["s"].alias("s"), r["c"]["e"].alias("e"), best["margin"].alias("margin"))

    scored = F.transform(F.transform(candidates(text), judged), margins)
    return F.filter(scored, lambda x: x["margin"] >= 0)


ADDED = "struct<kind:string,s:int,e:int,margin:double>"


def _apart(added: Column, base: Column) -> Column:
    """Those of ``added`` that overlap no base span, by start."""
    item = lambda x, own, margin: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x["kind"].alias("kind"), margin.alias("margin"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: item(x, 0, F.lit(0.0))), F.transform(added, lambda x: item(x, 1, x["margin"]))))
    kind = "struct<x:struct<s:int,own:int,e:int,kind:string,margin:double>,left:int>"
    # base spans that begin before an added one end before it: the largest end so far
    ahead = _let(both, lambda xs: scan(xs, F.lit(0), lambda most, x: (F.when(x["own"] == 0, F.greatest(most, x["e"])).otherwise(most), F.struct(x.alias("x"), most.alias("left"))), kind))
    # and those that begin after it do so after its end: the smallest start from behind
    behind = _let(F.reverse(ahead), lambda xs: scan(xs, F.lit(2**31 - 1), lambda least, y: (F.when(y["x"]["own"] == 0, y["x"]["s"]).otherwise(least), F.when((y["x"]["own"] == 1) & (y["left"] <= y["x"]["s"]) & (least >= y["x"]["e"]), F.struct(y["x"]["kind"].alias("kind"), y["x"]["s"].alias("s"), y["x"]["e"].alias("e"), y["x"]["margin"].alias("margin")))), ADDED))
    return F.reverse(F.filter(behind, lambda x: x.isNotNull()))


def _best(added: Column) -> Column:
    """Of spans by start those that stay: one gives way to the one kept before it, which it overlaps,
    unless its margin is larger."""
    end = F.struct(F.lit("").alias("kind"), F.lit(2**31 - 1).alias("s"), F.lit(2**31 - 1).alias("e"), F.lit(0.0).alias("margin"))
    null = F.lit(None).cast(ADDED)

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        over = held.isNull() | (x["s"] >= held["e"])
        return F.when(over | (x["margin"] > held["margin"]), x).otherwise(held), F.when(over, held)

    return F.filter(_let(F.concat(added, F.array(end)), lambda xs: scan(xs, null, step, ADDED)), lambda x: x.isNotNull())


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, *keep, email, ip, card, phone, spans)`` for every row of ``docs``.

    The first four are the base rules' spans by kind, ``spans`` all spans: the base ones and those
    candidates that the trees add where no base span lies, each ``struct<kind, s, e>``, by start
    and then kind, in code points, the end exclusive. Of candidates that overlap, one gives way to
    the one before it unless its margin is larger. A null text counts as empty; rows that repeat an
    id or a text each keep their row; an empty table gives an empty result. Whole texts; the time
    for one grows with its length, whatever it holds. One pass without shuffle; built-in functions only.
    """
    fitted = model(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    some = F.col("t").rlike(r"[@+]|[0-9][ ().:/\[{-]{0,2}[0-9]|(?i:[\[({<](?:at|dot|\.)[\])}>]| at | dot )|[0-9] \. ")
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    found = slim.withColumns({kind: F.when(some, plain(base_spans(F.col("t"), kind))).otherwise(none) for kind in KINDS})
    found = found.withColumn("added", F.when(some, added_spans(F.col("t"), fitted)).otherwise(F.array().cast(f"array<{ADDED}>")))
    base = F.concat(*(F.col(k) for k in KINDS))
    found = found.withColumn("new", F.when(F.size("added") > 0, plain(_best(_apart(F.col("added"), base)))).otherwise(none))
    return found.select(F.col("id").alias(id_col), F.col("t").alias(text), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *KINDS, in_order(F.concat(*(F.col(k) for k in KINDS), F.col("new"))).alias("spans"))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind in the order of ``KINDS``."""
    place = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.array_position(place, x["kind"]).alias("p"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the part not
    yet replaced goes with the first."""
    # cut at the code points where a replaced span begins or ends: characters are taken once, in order
    first = lambda xs: scan(xs, F.lit(0), lambda at, x: (F.greatest(at, x["e"]), F.when(x["s"] >= at, F.struct(x["kind"].alias("kind"), x["s"].alias("s"), at.alias("from")))), "struct<kind:string,s:int,from:int>")
    some = F.filter(_let(spans, first), lambda x: x.isNotNull())
    end = F.array_max(F.transform(spans, lambda x: x["e"]))
    put = lambda cut: F.array_join(F.transform(some, lambda x: F.concat(cut(x["from"] + 1, x["s"] - x["from"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), "")
    rest = F.substring(text, end + 1, F.char_length(text))
    few = F.concat(put(lambda at, n: F.substring(text, at, n)), rest)
    # a substring is sought from the text's beginning; where there are many, its characters are taken from a list
    many = _let(F.split(text, ""), lambda chars: F.concat(put(lambda at, n: F.array_join(F.slice(chars, at, n), "")), rest))
    return F.when(F.size(spans) > BLOCK, many).when(F.size(spans) > 0, few).otherwise(text)
