"""Operator 3 (native): secrets in texts. DataFrame functions only, and no shuffle.

Base spans come from three patterns. The method adds spans: in candidate strings (long runs of token characters) a
window slides, with the counts of its characters and the sum of c*log2(c) kept up to date as one character enters and
one leaves; the window's Shannon entropy is log2(w) - sum/w. Each character class has a threshold of its own. An
allow-list of shapes and words suppresses added spans; base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run's first AKIA leaves the longest match, so a length below 20 fails at once; likewise for hex.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
CHUNK = 128  # matches that are walked together
#: Character class: pattern of the whole candidate, bits from which a window counts.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Characters of candidates and of lower-cased hex ones; each has a count of its own in a window.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
HEX_SYMBOLS = "0123456789abcdef"
#: Allow-list, shapes: a candidate that is one of these as a whole is no secret.
SHAPES = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]+$",
    r"^[0-9+/_=-]+$",
    r"^[a-z]+(?:[-_/][a-z0-9]+)+$",
)
#: Allow-list, words: windows that come within REACH characters of one do not count; those further away in a long candidate do.
WORDS = r"(?i:example|sample|placeholder|dummy|xxxx|0123456789|abcdefgh)"
REACH = 32


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """(start, end, kind, match) of each match, in code points: the pieces between matches give the places.

    Matches are walked in chunks: a chunk's length gives where the next one starts, and no array grows one by one over
    all matches, so a text with very many of them costs little more than its length.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("keep"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,m:string>>")

    def walk(chunk, at):
        return F.aggregate(
            chunk,
            F.struct(at.alias("at"), empty.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["n"]).alias("at"),
                F.when(x["keep"], F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"))))).otherwise(a["out"]).alias("out"),
            ),
        )["out"]

    # one-element arrays bind what is used more than once, so that it is made once
    def chunked(all_steps):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_steps, k * CHUNK + 1, F.lit(CHUNK)))
        return F.transform(F.array(chunks), placed)

    def placed(chunks):
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["n"]))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(F.slice(starts, F.lit(1), F.size(chunks)), chunks, lambda at, c: walk(c, at)))

    walked = F.flatten(F.flatten(F.transform(F.array(steps), chunked)))
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _window_span(m: Column, bits: float, fold: bool, near: Column) -> Column:
    """A struct with (first, last) of the windows of candidate m with `bits` or more, as code points within m; first is -1 if none.

    The fold carries the counts of the window's characters: one goes up and one goes down as the window moves by one, and
    the sum of c*log2(c) changes by two differences. A step costs the same whatever the candidate and the window hold.
    Windows that overlap one of the spans `near` do not count.
    """
    w = WINDOW
    rise = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(w + 1)])
    # counts of 5 bits, 12 in a long; no character is place -1, whose count stays 0
    symbols = HEX_SYMBOLS if fold else SYMBOLS
    places = [symbols.find(chr(c)) for c in range(128)]
    place = F.array(*[F.lit(k) for k in places])
    codes = F.transform(F.split(F.lower(m) if fold else m, ""), lambda c: F.get(place, F.ascii(c)))
    limit = w * (math.log2(w) - bits)
    start = F.struct(F.array(*[F.lit(0).cast("long")] * -(-len(symbols) // 12)).alias("counts"), F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    long_of = lambda k: F.call_function("shiftright", k * 43, F.lit(9))  # noqa: E731  k / 12 for places up to 71
    bit_of = lambda k: (k - long_of(k) * 12) * 5

    def walk(all_codes):
        def moves(new, i):
            old = F.coalesce(F.get(all_codes, i - w), F.lit(-1))
            return F.struct(new.alias("new"), long_of(new).alias("nl"), bit_of(new).alias("nb"), old.alias("old"), F.when(old < 0, -1).otherwise(long_of(old)).alias("ol"), F.when(old < 0, 0).otherwise(bit_of(old)).alias("ob"))

        def step(a, x):
            one = F.lit(1).cast("long")
            count = lambda at, bit: F.call_function("shiftright", F.get(a["counts"], at), bit).bitwiseAND(F.lit(31).cast("long")).cast("int")
            up, down = F.call_function("shiftleft", one, x["nb"]), F.call_function("shiftleft", one, x["ob"])
            grown = F.get(rise, count(x["nl"], x["nb"]) - F.when(x["new"] == x["old"], 1).otherwise(0))
            fallen = F.when(x["old"] < 0, F.lit(0.0)).otherwise(F.get(rise, count(x["ol"], x["ob"]) - 1))
            # one-element arrays bind the sum and the verdict, so that each is made once
            told = F.transform(F.array(a["s"] + grown - fallen), lambda s: F.struct(s.alias("s"), ((a["i"] >= w - 1) & (s <= limit + 1e-9) & ~touched(a["i"])).alias("hot")))
            counts = F.transform(a["counts"], lambda c, k: c + F.when(k == x["nl"], up).otherwise(0) - F.when(k == x["ol"], down).otherwise(0))
            nxt = lambda t: F.struct(counts.alias("counts"), (a["i"] + 1).alias("i"), t["s"].alias("s"), F.when(t["hot"] & (a["first"] < 0), a["i"] - (w - 1)).otherwise(a["first"]).alias("first"), F.when(t["hot"], a["i"] + 1).otherwise(a["last"]).alias("last"))
            return F.get(F.transform(told, nxt), F.lit(0))

        def touched(i):
            return F.when(F.size(near) > 0, _meets(F.struct((i - (w - 1)).alias("start"), (i + 1).alias("end")), near)).otherwise(False)

        return F.aggregate(F.transform(all_codes, moves), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    # the codes are made once: a one-element array binds them for the walk
    return F.get(F.transform(F.array(codes), walk), F.lit(0))


def _added(text: Column, shapes: tuple[str, ...], words: str) -> Column:
    """Spans of high-entropy windows in candidates that the allow-list leaves."""

    def keep(m):
        ok = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        for pattern in shapes:
            ok = ok & ~m.rlike(pattern)
        return ok

    candidates = _spans(text, CANDIDATE, "entropy", keep)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def near(m):
        found = F.transform(_spans(m, words, "word"), lambda x: F.struct((x["start"] - REACH).alias("start"), (x["end"] + REACH).alias("end")))
        return F.when(m.rlike(words), found).otherwise(none)

    def judged(name, bits):
        def judge(x):
            def told(place):
                return F.struct((x["start"] + place["first"]).alias("start"), (x["start"] + place["last"]).alias("end"), F.lit("entropy").alias("kind"), F.lit(name).alias("m"), (place["first"] >= 0).alias("hot"))

            spans = F.transform(F.array(near(x["m"])), lambda allowed: _window_span(x["m"], bits, name == "hex", allowed))
            return F.get(F.transform(spans, told), F.lit(0))

        return judge

    out, is_hex = [], CLASSES[0][1]
    for name, _, bits in CLASSES:
        mine = F.filter(candidates, (lambda x: x["m"].rlike(is_hex)) if name == "hex" else (lambda x: ~x["m"].rlike(is_hex)))
        out.append(F.filter(F.transform(mine, judged(name, bits)), lambda x: x["hot"]))
    return F.transform(F.concat(*out), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["m"].alias("m")))


def _meets(x: Column, spans: Column) -> Column:
    """Whether span x overlaps one of the spans of a kind, which are in order and apart: a binary search for the first
    that ends behind x's start."""
    n = F.size(spans)

    def halve(a, _):
        middle = F.shiftright(a["low"] + a["high"], 1)
        before, open_ = F.get(spans, middle)["end"] <= x["start"], a["low"] < a["high"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(a["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(a["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve)
    return F.coalesce(F.get(spans, found["low"])["start"] < x["end"], F.lit(False))


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", shapes: tuple[str, ...] = SHAPES, words: str = WORDS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Places are code points, ends exclusive. A null text counts as empty: no spans, the hash of the empty string. An
    added span runs from the first to the last window of its candidate that counts, and goes if it overlaps a base
    span. The allow-list suppresses candidates by their shape, and windows within REACH characters of its words: a short
    candidate with such a word goes, a long one is judged by its other windows. Rows are judged one by one, so repeated rows and keys give repeated results.
    """
    order = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
    none = F.array().cast("array<struct<start:int,end:int,kind:string,m:string>>")
    t = F.col("text")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        F.when(t.rlike(ASSIGN), _spans(t, ASSIGN, "assign", value)).otherwise(none).alias("assign"),
        F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, "access")).otherwise(none).alias("access"),
        F.when(t.rlike(HEX), _spans(t, HEX, "hex")).otherwise(none).alias("hex"),
        F.when(t.rlike(CANDIDATE), _added(t, shapes, words)).otherwise(none).alias("entropy"),
    )
    base = F.concat("assign", "access", "hex")
    found = found.withColumn("base", base).withColumn("entropy", F.filter("entropy", lambda x: ~(_meets(x, F.col("assign")) | _meets(x, F.col("access")) | _meets(x, F.col("hex")))))

    def joined(spans: Column) -> Column:
        rank = F.create_map(*[y for k, v in order.items() for y in (F.lit(k), F.lit(v))])
        put = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(put, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in order],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "entropy")).alias("spans"),
    )
