r"""Personal data and secrets in texts, with SQL functions only.

Regular expressions propose spans, checksums, ranges and entropy confirm them, and context words before a span move its score; spans
that score at least `least` are returned. Base kinds (email, ip, card, phone) need no context: once confirmed they stay.
Further kinds: iban and nir (French), confirmed by mod-97, dni (Spanish), by its check letter, wallet and key (known prefixes) by their entropy, and, only
where a context word stands near, ssn, short_card (13 to 15 digits, Luhn) and secret (20 characters or more of high entropy).

Quantifiers are possessive or bounded, and a match starts at the end of the one before or where no character of its first class
precedes, which finds the same leftmost matches in linear time and without recursion, however long a text is.
Positions are code points, the end exclusive: they are the lengths of the pieces between matches and of the matches, added up in blocks, so that a text's
matches cost little more than in proportion to their number. Context is read from those pieces, two before a match.

Null and empty texts have no span. Matches of one kind never overlap, those of different kinds may; ties can't occur. Rows are judged each for itself, repeated ones
too; an empty table gives an empty result. All columns of the input are kept; the column that is added has `_` put before its name as often as it takes to be new.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """score: of a confirmed span; context adds `gain` if one of the words stands within `near` characters before it."""

    name: str
    regex: str
    hint: str
    confirm: Callable[[Column], Column]
    score: float
    context: str = ""
    gain: float = 0.3
    near: int = 40


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """d: a string of digits. Every second digit from the right counts double, less 9 if above 9."""

    def step(i: Column) -> Column:
        v = F.substring(F.reverse(d), i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), step), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0  # d has a score of digits at most, so nothing is bound


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def card(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.when(F.length(digits(m)).between(low, high), luhn(digits(m))).otherwise(False)


def mod97(m: Column) -> Column:
    """The first four characters move to the end, letters become 10 to 35, the number is 1 modulo 97."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    s = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    total = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.length(s).between(15, 34) & (total == 1)


def remainder(s: Column, modulus: int) -> Column:
    """Of a string of digits."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.try_cast("int")) % modulus)


def dni(m: Column) -> Column:
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"
    return F.substring(m, -1, 1) == F.substring(F.lit(letters), remainder(F.substring(m, 1, 8), 23) + 1, 1)


def nir(m: Column) -> Column:
    d = digits(m)
    return (F.length(d) == 15) & (97 - remainder(F.substring(d, 1, 13), 97) == F.substring(d, 14, 2).try_cast("int"))


def entropy(least: float) -> Callable[[Column], Column]:
    """Whether a text's characters have so many bits each."""

    def confirm(m: Column) -> Column:
        n = F.length(m).cast("double")
        times = lambda c: n - F.length(F.replace(m, c, F.lit("")))
        letters = F.filter(F.array_distinct(F.split(m, "")), lambda c: c != "")
        return F.aggregate(letters, F.lit(0.0), lambda a, c: a - times(c) / n * F.log2(times(c) / n)) >= least

    return confirm


#: In the order in which spans are listed.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 1.0),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", octets, 0.8),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "", card(16, 19), 0.9),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(digits(m)).between(8, 15), 0.7),
)
FURTHER = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", mod97, 0.8, r"\b(iban|account|konto|compte|cuenta)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, r"\b(ssn|social security|tax id)\b"),
    Kind("short_card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])", "", card(13, 15), 0.3, r"\b(card|visa|amex|mastercard|credit)\b"),
    Kind("dni", r"(?<![A-Za-z0-9])[0-9]{8}[A-Z](?![A-Za-z0-9])", "", dni, 0.7, r"\b(dni|nif|documento)\b"),
    Kind("nir", r"(?<![A-Za-z0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![A-Za-z0-9])", "", nir, 0.7, r"\b(nir|s.curit. sociale|assur.)"),
    Kind("wallet", r"(?<![A-Za-z0-9])0x[0-9a-fA-F]{40}(?![A-Za-z0-9])", "0x", entropy(3.0), 0.7, r"\b(wallet|ether|eth)\b"),
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,64}|xox[abprs]-[A-Za-z0-9-]{20,64})(?![A-Za-z0-9])", "", entropy(3.0), 0.8),
    Kind("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,128}(?![A-Za-z0-9_])", "", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & entropy(3.0)(m), 0.3, r"\b(token|secret|passwords?|passwd|api.?key|key|bearer|credentials?)\b"),
)
LEAST = 0.5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: lambdas work out again, for each element, what stands in them."""
    return F.element_at(F.transform(F.array(value), then), 1)


def totals_before(values: Column) -> Column:
    """The sum of the values before each, in blocks: adding to an array copies it, so none gets long. values: a lambda's variable."""
    none = F.array().cast("array<int>")
    walk = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))
    width = F.ceil(F.cbrt(2.0 * F.size(values))).cast("int")

    def total(size: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1), lambda k: F.slice(values, k * size + 1, size))
        return let(F.transform(cuts, walk), lambda blocks: let(walk(F.transform(blocks, lambda b: b["at"]))["all"], lambda bases: F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["all"], lambda x: x + base)))))

    return F.when(F.size(values) > 0, let(width, total)).otherwise(none)


def spans_of(text: Column, kind: Kind, least: float) -> Column:
    """array<struct<kind, start, end, score>> in order. text: not null."""
    tail = lambda c: F.substring(c, -kind.near, kind.near)

    def scored(r: Column) -> Column:
        score = F.lit(kind.score)
        if kind.context:
            score = score + F.when(F.lower(r["g"]).rlike(kind.context), kind.gain).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), r["s"].alias("start"), (r["s"] + F.length(r["m"])).alias("end"), score.alias("score"))

    def placed(pieces: Column, ends: Column) -> Column:
        rows = F.zip_with(pieces, ends, lambda x, at: F.struct(x["g"].alias("g"), x["m"].alias("m"), (at + F.length(x["g"])).alias("s")))
        if kind.context:
            last = F.concat(F.array(F.struct(F.lit("").alias("g"), F.lit("").alias("m"))), pieces)
            rows = F.zip_with(rows, F.slice(last, F.lit(1), F.size(pieces)), lambda x, y: F.struct(tail(F.concat(tail(y["g"]), y["m"], x["g"])).alias("g"), x["m"].alias("m"), x["s"].alias("s")))
        return F.filter(F.transform(F.filter(rows, lambda r: kind.confirm(r["m"])), scored), lambda x: x["score"] >= least)

    def spans(found: Column) -> Column:
        pieces = F.zip_with(F.slice(F.split(text, kind.regex, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return let(pieces, lambda ps: let(F.transform(ps, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda sizes: let(totals_before(sizes), lambda ends: placed(ps, ends))))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    hinted = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    return F.when(hinted & F.regexp_like(text, F.lit(kind.regex)), let(F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)), spans)).otherwise(none)


def find(documents: DataFrame, text_col: str = "text", least: float = LEAST, out: str = "pii") -> DataFrame:
    """Adds a struct column with an array of spans for each kind."""
    while out in documents.columns:
        out = f"_{out}"
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    return documents.withColumn(out, F.struct(*[spans_of(text, k, 0.0 if k in BASE else least).alias(k.name) for k in BASE + FURTHER]))


def listed(arrays: list[Column]) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.concat(*arrays), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
