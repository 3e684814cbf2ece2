"""Quality rules: line-first cleaning, with DataFrame functions only.

Each line is judged by itself: lines that fail a punctuation, navigation or boilerplate rule
are removed, and a document that loses too much of its text is rejected. No row leaves its
partition: there is no shuffle, and a hot source or group of copies costs what its rows cost.

Defined cases: a null or empty text has no words, loses nothing and fails the base rule
(fewer than 50 words); a null doc_id is carried along; repeated rows are judged alike, each by
itself; an empty table gives an empty table; columns named as results are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import DOCUMENTS, SPACES, WORD, fresh, table

SYMBOLS = "#*$%&|<>"
#: Phrases of notices, menus and consent banners; matched in lower case.
BOILERPLATE = (
    "all rights reserved", "released under the mit license", "licensed under the", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use of cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "lorem ipsum", "click here", "sign in", "log in", "subscribe to our", "share this", "powered by", "skip to content",
)
#: One of them is in each phrase; a text without them needs no search for phrases.
STEMS = ("reserved", "licens", "terms of", "policy", "cookie", "javascript", "ipsum", "click here", "sign in", "log in", "subscribe to", "share this", "powered by", "skip to")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost", "kept")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def line_fails(line: Column, symbols: Column, shouts: Column, phrases: Column, max_symbols: float = 0.1, max_shouts: float = 0.5) -> Column:
    """True if a line with a word fails a rule. Blank lines never fail.

    navigation: two or more separators ``|``; boilerplate: a phrase of BOILERPLATE in a line of
    at most 20 words; punctuation: symbols over ``max_symbols`` of the characters in words, or
    more than half of the words end in ``!!``, or no letter or digit at all. ``symbols``, ``shouts`` and
    ``phrases`` tell whether the text has any, so that most lines are tested for a letter or digit only.
    """
    chars = F.length(_without(line, SPACES))
    navigation = F.length(line) - F.length(_without(line, "|")) >= 2
    crowded = F.length(line) - F.length(_without(line, SYMBOLS)) > chars * max_symbols
    words = F.regexp_count(line, F.lit(WORD))
    shouting = F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")) > words * max_shouts
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE)) & (words <= 20)
    mute = ~line.rlike(r"[\p{L}\p{N}]") & line.rlike(WORD)
    return mute | (symbols & (navigation | crowded)) | (shouts & shouting) | (phrases & boilerplate)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable holds it, whatever the optimizer merges or pushes down."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more; ``words`` must be a lambda's variable.
    Windows are compared by 64-bit hashes, and only texts with an equal pair are sorted."""

    def covered(at: Column) -> Column:
        # A window covers three words; the next one starts b - a later.
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(steps, F.lit(3), lambda a, b: a + b)

    def sorted_places(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(placed, lambda p: F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def places(h: Column) -> Column:
        # A few repeated windows are looked up one by one; for many, windows are sorted with their places. Both ways
        # give the same places.
        twice = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        few = lambda d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        return _let(twice, lambda d: F.when(F.size(d) <= 24, few(d)).otherwise(sorted_places(h)))

    def repeats(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(places(h), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows, repeats))


def quality(docs: DataFrame, text_col: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """``docs`` with RESULTS added: counts of the base rules, the cleaned text, the share of the
    characters in words that removed lines held, and the verdict ``kept``.

    ``kept`` is false where the base rule fails (under ``min_words`` words, or over half of the
    words lie in three-word windows that the text repeats) or where ``lost`` is over ``max_lost``.
    """
    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    t, of_words, of_lines = fresh(docs, "t", "w", "l")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    phrases = _let(F.lower(t), lambda low: reduce(or_, [F.contains(low, F.lit(x)) for x in STEMS]))
    symbols = F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long")

    def lines(v: Column) -> Column:
        full = F.filter(v["lines"], lambda s: s.rlike(WORD))
        bad = F.filter(v["lines"], lambda s: line_fails(s, v["symbols"] > 0, v["shouts"], v["phrases"]))
        good = F.filter(v["lines"], lambda s: ~line_fails(s, v["symbols"] > 0, v["shouts"], v["phrases"]))
        return F.struct(
            v["symbols"].alias("n_symbols"),
            _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _let(bad, lambda x: F.when(F.size(x) == 0, F.lit(None)).otherwise(F.array_join(good, "\n"))).alias("cleaned"),
        )

    line_input = F.struct(F.split(t, "\n", -1).alias("lines"), symbols.alias("symbols"), F.contains(F.col(t), F.lit("!!")).alias("shouts"), phrases.alias("phrases"))
    word_counts = _let(F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), counts)
    # A generator of one row: what it gives is computed once, whatever is filtered or selected from it.
    once = F.inline(F.array(F.struct(word_counts.alias(of_words), _let(line_input, lines).alias(of_lines))))
    df = docs.select(*rest, text.alias(t)).select(*rest, t, once)
    left = F.length(_without(F.col(f"{of_lines}.cleaned"), SPACES))  # null, so nothing is lost, where no line was removed
    chars = F.col(f"{of_words}.word_chars")
    lost = F.when(chars > 0, F.coalesce(1.0 - left / chars, F.lit(0.0))).otherwise(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.select(*rest, f"{of_words}.*", f"{of_lines}.n_symbols", f"{of_lines}.n_dup_lines", F.coalesce(f"{of_lines}.cleaned", t).alias("cleaned"), lost.alias("lost"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= max_lost)).select(*rest, *RESULTS)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents with their failing lines removed; n_chars follows the text. Null and short texts are rejected, null
    ids and repeated rows are judged like others, an empty table gives an empty one."""
    judged = quality(docs.select(*DOCUMENTS))
    return judged.where("kept").withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("cleaned").cast("long")).select(*DOCUMENTS)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LINE_FAILS = """length(regexp_replace(s, '[\\x20\\x09-\\x0D]', '', 'g')) > 0 and (
      length(s) - length(replace(s, '|', '')) >= 2
      or length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) > 0.1 * length(regexp_replace(s, '[\\x20\\x09-\\x0D]', '', 'g'))
      or len(regexp_extract_all(s || ' ', '!![\\x20\\x09-\\x0D]')) > 0.5 * len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+'))
      or not regexp_matches(s, '[\\p{L}\\p{N}]')
      or (regexp_matches(lower(s), 'BOILERPLATE') and len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) <= 20))""".replace("BOILERPLATE", "|".join(BOILERPLATE))

ORACLE_SQL = f"""
with w as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws,
         string_split(coalesce(text, ''), chr(10)) ls from documents),
win as (
  select doc_id, i, count(*) over (partition by doc_id, g) n
  from (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w))),
rep as (
  select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from win where n > 1) group by doc_id),
c as (
  select doc_id, len(ws) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
         list_filter(ls, lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) full_lines,
         list_filter(ls, lambda s: {_LINE_FAILS}) bad
  from w),
m as (
  select c.doc_id, n_words, word_chars, n_symbols, len(full_lines) - len(list_distinct(full_lines)) n_dup_lines,
         coalesce(rep.n, 0) n_repeat_words,
         coalesce(list_sum(list_transform(bad, lambda s: length(regexp_replace(s, '[\\x20\\x09-\\x0D]', '', 'g')))), 0) lost
  from c left join rep on c.doc_id = rep.doc_id)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
       cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.5 * word_chars kept
from m
"""
