"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes.

All of it is DataFrame functions inside one row: no shuffle, no Python. Values used more than once
are bound with a one-element ``transform``, since Spark evaluates an expression at every place it stands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import WORD

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    """Lengths and shares at which a line or a document fails; shares are in percent."""

    #: A line whose last character is none of these fails the punctuation rule.
    ends: str = ".!?:;,…\"'”’»)]。！？"
    #: As many symbols per 100 words fail the punctuation rule too.
    symbols_percent: int = 40
    #: Separators per 100 words, and how many at least, make a line navigation.
    separators: str = "[|>»›•→]"
    separators_percent: int = 20
    least_separators: int = 2
    #: Phrases in lower case that mark boilerplate.
    phrases: tuple[str, ...] = (
        "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie",
        "javascript", "click here", "sign up for", "log in to", "subscribe to", "lorem ipsum")
    #: A document that loses more than this share of its words with its failing lines is rejected.
    most_lost_percent: int = 50


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_facts(line: Column, rules: LineRules) -> Column:
    """A struct of a line, its words and symbols, and which rule it fails (null: none)."""
    def judged(words: Column, symbols: Column, separators: Column, lower: Column) -> Column:
        marked = F.lit(False)
        for phrase in rules.phrases:
            marked = marked | F.contains(lower, F.lit(phrase))
        last = F.right(F.rtrim(line), F.lit(1))
        navigation = (separators >= rules.least_separators) & (separators * 100 >= words * rules.separators_percent)
        shouting = (F.upper(line) == line) & (lower != line) & (words >= 3)
        unpunctuated = ~F.contains(F.lit(rules.ends), last) | (symbols * 100 >= words * rules.symbols_percent) | shouting
        return F.when(words == 0, F.lit(None).cast("string")).when(navigation, "navigation").when(
            marked, "boilerplate").when(unpunctuated, "punctuation")

    return bound(F.struct(
        F.regexp_count(line, F.lit(WORD)).alias("words"), F.regexp_count(line, F.lit(SYMBOLS)).alias("symbols"),
        F.regexp_count(line, F.lit(rules.separators)).alias("separators"), F.lower(line).alias("lower")), lambda n: F.struct(
            line.alias("line"), n["words"].cast("long").alias("words"), n["symbols"].cast("long").alias("symbols"),
            judged(n["words"], n["symbols"], n["separators"], n["lower"]).alias("failed")))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more.

    Windows are compared by 64-bit hashes. Sorted by hash, a repeated window has an equal neighbour;
    sorted by place again, each repeated window adds the words that the one before did not cover.
    """
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def places(by_hash: Column) -> Column:
        same = lambda x, j: x["h"].eqNullSafe(F.get(by_hash, j)["h"])
        return F.transform(F.filter(by_hash, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

    def covered(at: Column) -> Column:
        return F.aggregate(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(
            F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda total, n: total + n)

    # Most texts repeat no window; only the others are sorted.
    return bound(windows, lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        bound(F.sort_array(bound(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)), covered)))


def cleaned(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Per document the base figures, the lines that stay and the verdict.

    ``docs`` needs doc_id and text; other columns are ignored. Null text has no words and no lines;
    so it fails the base rules and is not kept. Repeated rows are judged one by one. Columns:
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_failed, n_words_lost, clean_text (the lines that stay, null if the document is not kept).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.transform(F.split("_text", "\n"), lambda line: line_facts(line, rules)).alias("_lines"))
    worded = F.transform(F.filter("_lines", lambda x: x["words"] > 0), lambda x: x["line"])
    rows = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + x["symbols"]).alias("n_symbols"),
        bound(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_lines", lambda x: x["failed"].isNotNull())).cast("long").alias("n_lines_failed"),
        F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + F.when(
            x["failed"].isNotNull(), x["words"]).otherwise(0)).alias("n_words_lost"),
        F.array_join(F.transform(F.filter("_lines", lambda x: x["failed"].isNull()), lambda x: x["line"]), "\n").alias("_clean"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("n_words_lost") * 100 <= F.col("n_words") * rules.most_lost_percent)
    return rows.withColumn("kept", kept).withColumn("clean_text", F.when(F.col("kept"), F.col("_clean"))).drop("_clean")


RULES_SQL = """with w as (select doc_id, coalesce(text, '') as t from documents),
words as (select doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from w),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from words)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from tri) where n > 1),
covered as (select doc_id, count(distinct j) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id),
lines as (select doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as lw,
    len(regexp_extract_all(line, '[#*$%&|<>]')) as ns, len(regexp_extract_all(line, '[|>»›•→]')) as np
  from (select doc_id, unnest(string_split(t, chr(10))) as line from w)),
judged as (select doc_id, line, len(lw) as n, ns, len(lw) > 0 and (
    (np >= 2 and np * 100 >= len(lw) * 20)
    or regexp_matches(lower(line), 'all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie|javascript|click here|sign up for|log in to|subscribe to|lorem ipsum')
    or not contains('.!?:;,…"''”’»)]。！？', right(rtrim(line, ' '), 1)) or ns * 100 >= len(lw) * 40
    or (upper(line) = line and lower(line) <> line and len(lw) >= 3)) as bad from lines),
per as (select doc_id, sum(ns)::bigint as n_symbols, sum(n)::bigint as nw,
    (count(*) filter (where n > 0) - count(distinct line) filter (where n > 0))::bigint as n_dup_lines,
    count(*) filter (where bad) as n_lines_failed, coalesce(sum(n) filter (where bad), 0)::bigint as n_words_lost
  from judged group by doc_id)
select w.doc_id, nw as n_words, length(array_to_string(ws, ''))::bigint as word_chars, n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  (nw < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * nw) as base_failed,
  (not (nw < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * nw) and n_words_lost * 100 <= nw * 50) as kept,
  n_lines_failed, n_words_lost
from w join words using (doc_id) join per using (doc_id) left join covered using (doc_id)"""
