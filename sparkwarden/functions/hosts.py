"""International host names as column expressions: compatibility folding by tables from the Unicode database, and Punycode (RFC 3492)."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of RFC 3492.
BASE, TMIN, TMAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Code points that host names lose before they are looked up.
IGNORED = "\u00ad\u034f\u200b\u2060\u2064\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Other full stops between labels.
STOPS = "\u3002\uff0e\uff61"


@cache
def folds_to(parts: str) -> str:
    """All code points beyond ASCII whose compatibility form (NFKC) holds one of the characters of `parts`."""
    return "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if any(p in unicodedata.normalize("NFKC", c) for p in parts))


@cache
def _compatible() -> tuple[str, str, str]:
    """What host names fold: code points with one character in their place (as two strings for translate), and the rest as `from\\x01to` pairs joined by \\x00."""
    one, to, many = [], [], []
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Cn", "Cs", "Co") or c in STOPS + IGNORED or c == "ß":
            continue
        new = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).lower())
        if len(new) == 1 and new != c:
            one.append(c)
            to.append(new)
        elif len(new) > 1:
            many.append(f"{c}\x01{new}")
    return "".join(one), "".join(to), "\x00".join(many)


@cache
def _composed() -> str:
    """Pairs of characters with the one that they compose to, as `pair\\x01one`, joined by \\x00."""
    made = []
    for c in map(chr, range(128, sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == c:
                made.append(f"{pair}\x01{c}")
    return "\x00".join(made)


def _table(pairs: str) -> Column:
    return F.str_to_map(F.lit(pairs), F.lit("\x00"), F.lit("\x01"))


def folded(host: Column) -> Column:
    """A host as it is looked up: lower-case, ignorable characters gone, full stops alike, compatibility forms replaced, marks composed with the letter before them.

    Several marks in other than canonical order are not put in order first.
    """
    one, to, many = _compatible()
    low = F.lower(F.translate(F.translate(host, STOPS, "..."), IGNORED, ""))
    low = F.translate(low, one, to)
    wide = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(_table(many), c), c)), "")

    def join(t: Column, c: Column) -> Column:
        one = F.try_element_at(_table(_composed()), F.concat(F.right(t, F.lit(1)), c))
        return F.when(one.isNull(), F.concat(t, c)).otherwise(F.concat(F.left(t, F.length(t) - 1), one))

    return F.when(wide.rlike(r"\p{M}"), F.aggregate(F.split(wide, ""), F.lit(""), join)).otherwise(wide)


def _digits(delta: Column, bias: Column) -> Column:
    """delta as a variable-length integer whose thresholds follow from the bias."""
    start = F.struct(F.lit("").alias("out"), delta.alias("q"), F.lit(False).alias("done"))

    def step(t: Column, k: Column) -> Column:
        least = F.greatest(F.lit(TMIN), F.least(F.lit(TMAX), k * BASE - bias)).cast("long")
        last, span = t["q"] < least, F.lit(BASE) - least
        digit = F.when(last, t["q"]).otherwise(least + (t["q"] - least) % span)
        out = F.concat(t["out"], F.substr(F.lit(DIGITS), (digit + 1).cast("int"), F.lit(1)))
        more = F.struct(out.alias("out"), F.floor((t["q"] - least) / span).cast("long").alias("q"), last.alias("done"))
        return F.when(t["done"], t).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), start, step)["out"]


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta was written: larger deltas are expected after larger ones."""
    half = F.floor(delta / F.when(first, DAMP).otherwise(2)).cast("long")
    start = F.struct((half + F.floor(half / points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    most = (BASE - TMIN) * TMAX // 2
    less = lambda t, _: F.when(t["d"] > most, F.struct(F.floor(t["d"] / (BASE - TMIN)).cast("long").alias("d"), (t["k"] + BASE).alias("k"))).otherwise(t)
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, less, lambda t: t["k"] + F.floor((BASE - TMIN + 1) * t["d"] / (t["d"] + SKEW)).cast("long"))


def punycode(label: Column) -> Column:
    """The ASCII form of a label, without its prefix: two folds, over the different code points beyond ASCII and, for each, over all of the label."""
    points = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    plain = F.filter(points, lambda p: p < FIRST)
    head = F.array_join(F.transform(plain, lambda p: F.char(p)), "")
    b = F.size(plain).cast("long")
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(F.when(b > 0, F.concat(head, F.lit("-"))).otherwise("").alias("out"), long(0).alias("delta"), long(BIAS).alias("bias"), b.alias("h"), long(FIRST).alias("n"))

    def level(t: Column, m: Column) -> Column:
        at = F.struct(t["out"].alias("out"), (t["delta"] + (m - t["n"]) * (t["h"] + 1)).alias("delta"), t["bias"].alias("bias"), t["h"].alias("h"), m.alias("n"))
        done = F.aggregate(points, at, lambda s, p: one(s, p, m))
        return F.struct(done["out"].alias("out"), (done["delta"] + 1).alias("delta"), done["bias"].alias("bias"), done["h"].alias("h"), (m + 1).alias("n"))

    def one(s: Column, p: Column, m: Column) -> Column:
        counted = F.struct(s["out"].alias("out"), (s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["n"].alias("n"))
        written = F.struct(
            F.concat(s["out"], _digits(s["delta"], s["bias"])).alias("out"), long(0).alias("delta"), _adapted(s["delta"], s["h"] + 1, s["h"] == b).alias("bias"), (s["h"] + 1).alias("h"), s["n"].alias("n"),
        )
        return F.when(p < m, counted).when(p == m, written).otherwise(s)

    return F.aggregate(F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= FIRST))), start, level)["out"]


def ascii_host(host: Column) -> Column:
    """A folded host with each label beyond ASCII in its Punycode form."""
    beyond = lambda x: x.rlike(r"[^\x00-\x7F]")
    labels = F.transform(F.split(host, r"\."), lambda x: F.when(beyond(x), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
    return F.when(beyond(host), F.array_join(labels, ".")).otherwise(host)
