"""A 64-bit FNV-1a of bytes and an order shuffled by it, as native folds (A16, P28). Numbers are kept as two halves of 32 bits, so nothing overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the hash's start and its prime, 2**40 + 435
START, FACTOR = 0xCBF29CE484222325, 435
_LOW = (1 << 32) - 1


def _start() -> Column:
    return F.struct(F.lit(START >> 32).cast("long").alias("hi"), F.lit(START & _LOW).cast("long").alias("lo"))


def _feed(state: Column, byte: Column) -> Column:
    lo = state["lo"].bitwiseXOR(byte)
    low = lo * FACTOR
    high = state["hi"] * FACTOR + F.shiftright(low, 32) + F.shiftleft(lo, 8)
    return F.struct(high.bitwiseAND(_LOW).alias("hi"), low.bitwiseAND(_LOW).alias("lo"))


def _bytes(text: Column) -> Column:
    """The bytes of a text's UTF-8, as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), 0)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))


def fnv(text: Column) -> Column:
    """The hash of a text's bytes, as (hi, lo); null for null."""
    return F.when(text.isNotNull(), F.aggregate(_bytes(text), _start(), _feed))


def fnv_hex(parts: list[Column]) -> Column:
    """16 hexadecimal digits: the hash of all parts, each closed by a byte 255, which no text holds. A null part counts as an empty one."""
    fed = F.concat(*[F.concat(_bytes(F.coalesce(p, F.lit(""))), F.array(F.lit(255).cast("long"))) for p in parts])
    h = F.aggregate(fed, _start(), _feed)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def _step(seed: Column) -> Column:
    """The next number of an xorshift by 13, 7 and 17."""
    bind = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    return bind(bind(bind(seed, lambda x: x.bitwiseXOR(F.shiftleft(x, 13))), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 7))), lambda x: x.bitwiseXOR(F.shiftleft(x, 17)))


def _modulo(x: Column, m: Column) -> Column:
    """The remainder of an unsigned number."""
    return ((F.shiftrightunsigned(x, 32) % m) * (F.lit(1 << 32) % m) + x.bitwiseAND(_LOW) % m) % m


def shuffled(n: Column, text: Column) -> Column:
    """The numbers 0 to n - 1 in an order that the text alone settles: from the last place down each changes places with one up to it."""
    h = fnv(text)
    seed = F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])
    start = F.struct(seed.alias("seed"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("int")).alias("order"))

    def swap(state: Column, i: Column) -> Column:
        def put(v: Column) -> Column:
            j = _modulo(v["seed"], (i + 1).cast("long")).cast("int")
            at = lambda k: F.get(v["order"], k)
            return F.struct(v["seed"].alias("seed"), F.transform(v["order"], lambda x, k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(x)).alias("order"))

        return F.element_at(F.transform(F.array(F.struct(_step(state["seed"]).alias("seed"), state["order"].alias("order"))), put), 1)

    places = F.filter(F.reverse(F.sequence(F.lit(0), n - 1)), lambda i: i > 0)
    return F.when((n > 0) & text.isNotNull(), F.aggregate(places, start, swap, lambda s: s["order"]))


def question(text: Column, choices: Column, answer: Column, explanation: Column | None = None) -> Column:
    """(question, choices, answer, explanation) of a reply's question that can be graded, its choices shuffled by its text; else null.

    It needs a text, two to five choices that are not blank, and an answer among them: a whole number, which may be written as text.
    """
    t = F.trim(text)
    cs = F.transform(choices, lambda c: F.trim(c))
    a = F.try_to_number(F.regexp_extract(F.trim(answer.cast("string")), r"^\+?(\d{1,9})$", 1), F.lit("999999999")).cast("int")
    fine = (t != "") & F.size(cs).between(2, 5) & ~F.exists(cs, lambda c: F.coalesce(c, F.lit("")) == "") & (a >= 0) & (a < F.size(cs))
    order = shuffled(F.size(cs), t)
    out = F.struct(t.alias("question"), F.transform(order, lambda o: F.get(cs, o)).alias("choices"), (F.array_position(order, a) - 1).cast("int").alias("answer"), F.trim(F.coalesce(explanation if explanation is not None else F.lit(None).cast("string"), F.lit(""))).alias("explanation"))
    return F.when(F.coalesce(fine, F.lit(False)), out)
