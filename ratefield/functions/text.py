"""Text expressions, and token similarity by longest common subsequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the business words that names are compared without.
SUFFIXES = r"\b(brewing( company| co)?|brewery|beer( company| co)?|company|ales?|taproom|llc|inc|co\.?)\b"


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital, wherever it begins (after a digit, hyphen or apostrophe too)."""
    letters = F.regexp_extract_all(c, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(letters, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def before(c: Column, literal: str) -> Column:
    """What comes before a literal's first place; all of it where the literal isn't there."""
    return F.substring_index(c, literal, 1)


def without_last_part(c: Column, sign: str = "-") -> Column:
    return F.regexp_replace(c, rf"\{sign}[^\{sign}]*$", "")


def zero_padded(c: Column, width: int) -> Column:
    """Pad on the left; a longer value stays whole."""
    return F.when(F.char_length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def no_float_tail(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def has_word(c: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))


def strip_tags(c: Column) -> Column:
    """A cell's text: tags off, the usual entities read, blanks collapsed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[\s\x{A0}]+", " "))


def normal_name(c: Column) -> Column:
    """Lower case, without business suffixes and signs, blanks collapsed; missing names are empty."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SUFFIXES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))


def name_variants(c: Column) -> Column:
    """The whole normalised name, then the parts that slashes cut, without repeats and empties; [''] if none is left."""
    parts = F.concat(F.array(normal_name(c)), F.transform(F.split(F.coalesce(c, F.lit("")), "/"), normal_name))
    kept = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows (Hyyro, 2004)."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        match = row & places.get(ch, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Insertions and deletions as a similarity in per cent."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the common tokens and the common tokens with each side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not two):
        return 100.0
    left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
    scores = [ratio(left, right)]
    if both:
        scores += [ratio(both, left), ratio(both, right)]
    return max(scores)


def variants_score(a: list[str], b: list[str]) -> float:
    """Whole names by sorted tokens alone; where a side is compound, other pairs by the better of both ratios. Empty names score 0."""
    best = sorted_ratio(a[0], b[0]) if a[0] and b[0] else 0.0
    if len(a) > 1 or len(b) > 1:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if (i or j) and x and y:
                    best = max(best, sorted_ratio(x, y), set_ratio(x, y))
    return best


@F.pandas_udf(T.DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Score of two names' variants; equal pairs of a batch are scored once."""
    pairs = [(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)]
    scores = {p: variants_score(list(p[0]), list(p[1])) for p in set(pairs)}
    return pd.Series([scores[p] for p in pairs], dtype=float)
