"""Secrets: fixed patterns, and strings of high entropy in a sliding window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratefield.llm.common import documents

# The patterns of the base kinds, and the least length of the group that is tested.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 6, r"(?i:passw(?:or)?d|secret|token|api_?key)"), ("access", ACCESS, 0, 20, "AKIA"), ("hex", HEX, 0, 24, r"[0-9a-f]{24}"))

#: Candidate strings, and the parts of one between its signs, which are candidates where the whole is none.
CANDIDATE, PART = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9]{20,}"
#: Character classes, narrowest first: name, test, and the least share of the entropy that a window's length and the class's alphabet allow.
CLASSES = (
    ("lower_hex", "^[0-9a-f]*[0-9][0-9a-f]*$", 16, 0.78),
    ("upper_hex", "^[0-9A-F]*[0-9][0-9A-F]*$", 16, 0.78),
    ("lower_alnum", "^[0-9a-z]*[0-9][0-9a-z]*$", 36, 0.85),
    ("upper_alnum", "^[0-9A-Z]*[0-9][0-9A-Z]*$", 36, 0.85),
    ("letters", "^[A-Za-z]+$", 52, 0.87),
    ("alnum", "^[A-Za-z0-9]+$", 62, 0.85),
    ("base64", "^.+$", 66, 0.85),
)
#: Letters, and a number behind them at most: names in code are such, with few capitals; random ones have a third of either case.
_WORDS = "^[A-Za-z]+[0-9]{0,8}$"
#: Candidates that hold one of these are no secrets: place holders, runs, UUIDs, words joined by signs, words and a number.
#: Quantifiers within repeated groups are possessive, so that no string takes more than one pass.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|lorem|ipsum",
    r"(.)\1{5}",
    r"0123456789|123456789|abcdefghij|ABCDEFGHIJ",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]*+[-_/+=]++)++[A-Za-z]*+[0-9]{0,8}+$",
    r"^[0-9+/_=-]+$",
)
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of a window lie in numbers of 12 counts each, 5 bits a count (a window has fewer than 32 characters).
_PER, _BITS = 12, 5
_FIELDS = -(-len(ALPHABET) // _PER)
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's leftmost matches that `keep` (of text and matches) accepts: lengths of what lies between matches give the places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(between.alias("b"), found.alias("m"), keep(text, found).alias("k"))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state, x):
        start = state["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.coalesce(x["k"], F.lit(False)), F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def _base(text: Column, kind: int) -> Column:
    _, pattern, group, least, hint = KINDS[kind]
    keep = lambda t, found: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda g: F.char_length(g) >= least)
    return F.when(text.rlike(hint), _spans(text, pattern, kind, keep)).otherwise(F.array().cast(_SPAN))


def best_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of a window of the string, or of the whole of a shorter one.

    One pass keeps each character's count in the window and the sum of c log2 c. A step reads and changes the count of
    the character that enters and of the one that leaves, whatever the alphabet's size.
    """
    if window >= 1 << _BITS:
        raise ValueError("a window has fewer than 32 characters")
    g = F.lit([0.0] + [c * math.log2(c) for c in range(1, window + 2)])
    at = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    at = F.filter(at, lambda i: i >= 0)
    fields = [f"n{i}" for i in range(_FIELDS)]
    begin = F.struct(*[F.lit(0).cast("bigint").alias(f) for f in fields], F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))
    unit = lambda code: F.element_at(F.lit([1 << _BITS * k for k in range(_PER)]), (code % _PER) + 1)

    def count(state, code):
        held = F.lit(0).cast("bigint")
        for i, f in enumerate(fields):
            held = F.when(F.floor(code / _PER) == i, state[f]).otherwise(held)
        return F.floor(held / unit(code)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def of(codes: Column) -> Column:
        def step(state, new):
            gone = state["i"] >= window
            old = F.when(gone, F.get(codes, state["i"] - window))
            same = F.coalesce(old == new, F.lit(False))
            more, less = count(state, new), count(state, old)
            s = state["s"] + F.when(same, 0.0).otherwise(F.get(g, more + 1) - F.get(g, more) - F.when(gone, F.get(g, less) - F.get(g, less - 1)).otherwise(0.0))
            of_field = lambda code, i: F.when(F.floor(code / _PER) == i, unit(code)).otherwise(F.lit(0).cast("bigint"))
            counts = [(state[f] + of_field(new, i) - F.coalesce(of_field(old, i), F.lit(0).cast("bigint"))).alias(f) for i, f in enumerate(fields)]
            size = F.least(state["i"] + 1, F.lit(window))
            now = F.when(size >= F.least(F.lit(window), F.size(codes)), F.log2(size) - s / size).otherwise(0.0)
            return F.struct(*counts, s.alias("s"), F.greatest(state["best"], now).alias("best"), (state["i"] + 1).alias("i"))

        return F.aggregate(codes, begin, step, lambda x: x["best"])

    # an array of one lets the codes be computed once
    return F.get(F.transform(F.array(at), of), 0)


def least_entropy(m: Column, window: int = WINDOW) -> Column:
    """The entropy from which a candidate is a secret: its class's share of what a window of random characters of that alphabet can have."""
    least = F.lit(None).cast("double")
    for _, test, alphabet, share in reversed(CLASSES):
        least = F.when(m.rlike(test), F.lit(share * min(math.log2(window), math.log2(alphabet)))).otherwise(least)
    return least


def _is_secret(m: Column) -> Column:
    plain = F.lit(False)
    for pattern in ALLOW:
        plain = plain | m.rlike(pattern)
    third = lambda c: 3 * F.regexp_count(m, F.lit(c)) >= F.char_length(m)
    plain = plain | (m.rlike(_WORDS) & ~(third("[A-Z]") & third("[a-z]")))
    return F.when(plain, F.lit(False)).otherwise(best_entropy(m) >= least_entropy(m))


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(others, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def _added(text: Column, base: Column) -> Column:
    none, keep = F.array().cast(_SPAN), lambda t, m: F.transform(m, _is_secret)
    found = lambda pattern: F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20}"), _spans(text, pattern, len(KINDS), keep)).otherwise(none)
    whole = _apart(found(CANDIDATE), base)
    # an array of one lets the wholes be computed once
    return F.get(F.transform(F.array(whole), lambda w: F.concat(w, _apart(_apart(found(PART), base), w))), 0)


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to docs: n_assign, n_access, n_hex, base_spans and spans (arrays of start, kind, end: code points, end exclusive).

    Kinds 0 to 2 are assign, access and hex; kind 3 is a candidate string that overlaps no base span, whose best window of
    20 characters reaches its character class's entropy and that no allow-list pattern matches; where a whole run of
    candidate characters isn't one, the parts between its signs are tried. Null and empty texts have no spans; long ones
    are read whole. Matches of one kind don't overlap, of different kinds they may. Each row is scanned by itself, so
    equal rows and ids don't matter; no rows give no rows. Columns of those names are replaced; others may have any name.
    """
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    docs = docs.drop(*new)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kinds = F.struct(*[_base(text, k).alias(f"k{k}") for k in range(3)])

    def all_spans(found: Column) -> Column:
        base = F.array_sort(F.concat(*[found[f"k{k}"] for k in range(3)]))
        counts = [F.size(found[f"k{k}"]).cast("long").alias(new[k]) for k in range(3)]
        return F.get(F.transform(F.array(base), lambda b: F.struct(*counts, b.alias("base_spans"), F.array_sort(F.concat(b, _added(text, b))).alias("spans"))), 0)

    found = F.get(F.transform(F.array(kinds), all_spans), 0)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), found.alias("found")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], *[F.col(f"found.{c}").alias(c) for c in new])


def span_list(spans: Column) -> Column:
    names = F.lit([k[0] for k in KINDS] + ["entropy"])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_list(F.col("base_spans")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
