"""Quality rules, line first, in DataFrame functions only.

Rules are evaluated on every line of a text; lines that fail are removed, and a document
that loses more than half of its word characters is rejected, as is one that fails the base rules.

* punctuation: a line needs a sentence end, at its end or inside it, and not more than one
  of the symbols ``#*$%&|<>`` for every three words;
* navigation: no menu line (two or more separators ``|`` ``>`` ``»`` ``·`` and no more than six words
  between two of them on average);
* boilerplate: none of the phrases below, and not a repetition of an earlier line of the text.

Words repeated in windows of five are found without rows being multiplied: the hashes of the windows of a
text are compared first, and only a text with two equal hashes has its windows sorted as strings.

Defined cases: null is an empty text (no words, rejected); lines without a word count for nothing;
repeated rows are judged one by one; an empty table gives an empty result; other columns are kept by
``judged`` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import WORD, whole_text

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
PHRASES = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|enable javascript|javascript is disabled|"
    "accept (all )?cookies|sign (in|up)|log in to|subscribe (now|to)|click here|read more|share this|lorem ipsum"
)
#: Each of the phrases contains one of these.
PHRASE_WORDS = (
    "rights reserved", "terms of", "privacy policy", "cookie", "javascript", "sign in", "sign up", "log in to", "subscribe", "click here", "read more",
    "share this", "lorem ipsum",
)
SENTENCE_END = r"""[.!?…]["'”’»)\]]*([\x20\x09-\x0D]|\z)"""
SEPARATOR = "[|>»·]"


@dataclass(frozen=True)
class Rules:
    """Parameters: least number of words, most words in repeated windows (per cent), least share of word characters kept (per cent)."""

    least_words: int = 10
    most_repeated: int = 20
    least_kept: int = 50


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blanked(text: Column) -> Column:
    """The text with every white space as a space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def chars(blank: Column) -> Column:
    """Code points in the words of a blanked text."""
    return F.length(F.replace(blank, F.lit(" "), F.lit("")))


def line_fails(line: Column, phrases: Column) -> Column:
    """``phrases``: whether the text has a word that a phrase must contain. Costly tests come last."""
    words = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    punctuation = ~line.rlike(SENTENCE_END) | ((symbols > 0) & (3 * symbols > words))
    navigation = (separators >= 2) & (words - separators <= 6 * (separators + 1))
    return punctuation | navigation | (phrases & F.lower(line).rlike(PHRASES))


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more in the text, first occurrences included."""

    def windows(w: Column, make) -> Column:
        return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), make)).otherwise(F.array())

    def covered(w: Column) -> Column:
        pairs = F.array_sort(windows(w, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["g"] == F.get(s, j)["g"]
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda i: F.get(s, i)["i"]))

        def total(p: Column) -> Column:
            following = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.array(F.element_at(p, -1) + WINDOW))
            steps = F.zip_with(p, following, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
            return F.when(F.size(p) > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))

        return bound(bound(pairs, places), total)

    def counted(w: Column) -> Column:
        # windows without equal hashes have no equal words; a hash of each word, and one of the hashes of each window
        hashes = bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: windows(h, lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)])))
        clear = bound(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(clear, F.lit(0).cast("long")).otherwise(covered(w))

    return bound(words, counted)


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the base figures, base_failed, kept and cleaned_text (the lines that pass)."""
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + chars(blanked(x)))
    some_phrase = F.col("_lower").contains(PHRASE_WORDS[0])
    for word in PHRASE_WORDS[1:]:
        some_phrase = some_phrase | F.col("_lower").contains(word)
    figures = (
        docs.withColumn("_blank", blanked(text))
        .withColumn("_words", F.array_remove(F.split("_blank", " ", -1), ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", chars(F.col("_blank")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
        .drop("_words", "_blank")
        .withColumn("_lower", F.lower(text))
        .withColumn("_phrases", some_phrase)
        .withColumn("_lines", lines)
        .withColumn("_once", F.array_distinct("_lines"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size("_once")).cast("long"))
        .withColumn("_good", F.filter("_once", lambda x: ~line_fails(x, F.col("_phrases"))))
        .withColumn("cleaned_text", F.array_join("_good", "\n"))
        .withColumn("kept_chars", total(F.col("_good")))
    )
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= rules.least_kept * F.col("word_chars")
    return figures.withColumn("base_failed", failed).withColumn("kept", ~failed & enough).drop("_lines", "_once", "_good", "_lower", "_phrases")


def digest(docs: DataFrame) -> DataFrame:
    figures = judged(docs.select("doc_id", "text"))
    return figures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
s AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS k FROM c WHERE n > 1),
r AS (SELECT rid, sum(k)::BIGINT AS n_repeat_words FROM s GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
once AS (SELECT rid, len(l) AS n, list_distinct(l) AS l FROM lines),
parts AS (SELECT rid, x, len(regexp_extract_all(x, '{WORD}')) AS words, len(regexp_extract_all(x, '{SEPARATOR}')) AS seps,
    length(x) - length(translate(x, '{SYMBOLS}', '')) AS syms FROM (SELECT rid, unnest(l) AS x FROM once)),
good AS (SELECT rid, sum(length(regexp_replace(x, '{SPACE}', '', 'g')))::BIGINT AS kept_chars FROM parts
    WHERE NOT (NOT regexp_matches(x, '{SENTENCE_END.replace("'", "''")}') OR 3 * syms > words OR (seps >= 2 AND words - seps <= 6 * (seps + 1))
        OR regexp_matches(lower(x), '{PHRASES}')) GROUP BY rid),
f AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (n - len(once.l))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
    FROM d JOIN w USING (rid) JOIN once USING (rid) LEFT JOIN r USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept, kept_chars FROM f
"""
