"""Column expressions on transcript text."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Hashable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.config import ARTEFACT_PATTERNS, DEVANAGARI, QUESTION_WORDS


#: White space as Python's ``split`` takes it: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"[\s\x{1C}-\x{1F}]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda, or behind several branches, is computed again for
    every element and branch; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends; ``trim`` would only drop spaces."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)^{SPACE}+", ""), rf"(?U){SPACE}+$", "")


def words(text: Column) -> Column:
    """Words between runs of Unicode white space; no words for blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?U){SPACE}+"), lambda w: w != "")


def is_question(text: Column, lexicon: Sequence[str] = QUESTION_WORDS) -> Column:
    """A question mark anywhere, or a lexicon word standing alone; case matters."""
    if any(re.search(r"\s", word) for word in lexicon):
        raise ValueError("lexicon entries are single words")
    text = F.coalesce(text, F.lit(""))
    marked = text.contains("?")
    if not lexicon:
        return marked
    alternatives = "|".join(re.escape(word) for word in lexicon)
    return marked | text.rlike(rf"(?U)(?:^|{SPACE})(?:{alternatives})(?={SPACE}|$)")


@F.pandas_udf(T.StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s).casefold(), na_action="ignore")


def for_scoring(text: Column) -> Column:
    """NFC, case folded, without punctuation and symbols, single spaced.

    Plain ASCII needs neither normalisation nor folding beyond ``lower`` and stays in the
    JVM; only other text goes through the Arrow batch.
    """
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(r"^\p{ASCII}*$")
    folded = F.coalesce(_fold_unicode(F.when(~plain, text)), F.lower(text))
    kept = F.regexp_replace(folded, r"[\p{P}\p{So}]", "")
    return strip(F.regexp_replace(kept, rf"(?U){SPACE}+", " "))


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], rows: int = 4096) -> int:
    """Fewest insertions, deletions and replacements that turn ``a`` into ``b``.

    A column of the table of distances is kept as two bit vectors, the steps up and the steps down between
    neighbours, and one column follows from the one before by a few operations on whole vectors. ``rows``
    of the shorter side are done at a time; what passes to the next ones is the step along their lower
    border, so memory is that of one border and of ``rows`` bits per symbol among them.
    """
    if len(a) > len(b):
        a, b = b, a
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(a))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    border = [1] * len(b)
    for top in range(0, len(a), rows):
        block = a[top:top + rows]
        at: dict[Hashable, int] = {}
        for i, symbol in enumerate(block):
            at[symbol] = at.get(symbol, 0) | 1 << i
        size = len(block)
        ones, lowest = (1 << size) - 1, size - 1
        up, down = ones, 0
        for j, symbol in enumerate(b):
            equal, above = at.get(symbol, 0), border[j]
            level = equal | down
            if above < 0:
                equal |= 1
            free = ((((equal & up) + up) ^ up) | equal) & ones
            right_up, right_down = down | (ones ^ (free | up)), up & free
            border[j] = (right_up >> lowest) - (right_down >> lowest)
            right_up, right_down = right_up << 1 & ones, right_down << 1 & ones
            if above > 0:
                right_up |= 1
            elif above < 0:
                right_down |= 1
            up, down = right_down | (ones ^ (level | right_up)), right_up & level
    return len(a) + sum(border)


@F.pandas_udf(T.IntegerType())
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word edit distance of two texts; null counts as no words."""
    return pd.Series([edit_distance((r or "").split(), (h or "").split()) for r, h in zip(reference, hypothesis)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def char_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance in code points, spaces left out; null counts as empty."""
    return pd.Series([edit_distance((r or "").replace(" ", ""), (h or "").replace(" ", "")) for r, h in zip(reference, hypothesis)], dtype="int32")


def repetition_rate(text: Column, n: int = 4) -> Column:
    """Share of n-gram positions whose n-gram stood earlier in the text; 0 for short text."""
    return bound(words(text), lambda ws: repeated_share(ws, n))


def repeated_share(ws: Column, n: int = 4) -> Column:
    """``repetition_rate`` of words already split; n-grams are told apart by 64-bit hashes."""
    count = F.size(ws)
    grams = F.transform(F.sequence(F.lit(0), count - n), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))
    repeated = (count - n + 1) - F.size(F.array_distinct(grams))
    return F.when(count < 2 * n, 0.0).otherwise(repeated / (count - n + 1))


#: About how many bytes of a repeated text are given to the packer at once.
GZIP_AT_ONCE = 1 << 16


def gzip_size(data: bytes, times: int = 1) -> int:
    """Bytes of the gzip file of ``data`` said ``times`` times; what is packed is fed in parts and never stands whole."""
    packer, per = zlib.compressobj(9, zlib.DEFLATED, 16 + zlib.MAX_WBITS), max(1, min(times, GZIP_AT_ONCE // max(1, len(data))))
    goes, rest = divmod(times, per)
    part = data * per
    size = sum(len(packer.compress(part)) for _ in range(goes))
    return size + len(packer.compress(data * rest)) + len(packer.flush())


@F.pandas_udf(T.LongType())
def _gzip_size(text: pd.Series, times: pd.Series) -> pd.Series:
    return pd.Series([gzip_size((s or "").encode("utf-8"), n) for s, n in zip(text, times)], dtype="int64")


def compression_ratio(text: Column, times: int = 1) -> Column:
    """UTF-8 bytes over gzip bytes, of the text said ``times`` times; looping text compresses hard.

    Only the text itself goes to the Python worker, however often it is said.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", 0.0).otherwise(F.octet_length(text) * F.lit(times).cast("bigint") / _gzip_size(text, F.lit(times)))


def script_ratio(text: Column, characters: str = DEVANAGARI) -> Column:
    """Share of letters inside a script's character range; 0 without letters."""
    def ratio(letters: Column) -> Column:
        inside = F.regexp_replace(letters, f"[^{characters}]+", "")
        return F.when(letters == "", 0.0).otherwise(F.length(inside) / F.length(letters))

    return bound(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""), ratio)


def words_per_second(text: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.size(words(text)) / seconds).otherwise(0.0)


def artefact_hits(text: Column, patterns: Mapping[str, Sequence[str]] = ARTEFACT_PATTERNS) -> Column:
    """Sorted names of the pattern groups with a phrase in the text, whatever the case."""
    def hits(lowered: Column) -> Column:
        names = []
        for name in sorted(patterns):
            found = F.lit(False)
            for phrase in patterns[name]:
                found = found | lowered.contains(phrase.lower())
            names.append(F.when(found, F.lit(name)))
        return F.filter(F.array(*names), lambda h: h.isNotNull())

    if not patterns:
        return F.array().cast("array<string>")
    return bound(F.lower(F.coalesce(text, F.lit(""))), hits)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two word arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def mean_agreement(texts: Column) -> Column:
    """Mean pairwise word overlap of an array of texts; null for fewer than two."""
    def mean(bags: Column) -> Column:
        n = F.size(bags)
        per_first = F.transform(bags, lambda a, i: F.aggregate(
            F.slice(bags, i + 2, n), F.lit(0.0), lambda acc, b: acc + word_overlap(a, b)))
        total = F.aggregate(per_first, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(n >= 2, total / (n * (n - 1) / 2))

    return bound(F.transform(texts, lambda t: F.array_distinct(words(t))), mean)
