"""Line-first cleaning with built-in functions alone: rules per line, then a verdict on what the document lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import WORD

#: A line of two words and more with more of its characters than this in marks that sentences rarely have fails.
PUNCTUATION_SHARE = 0.15
#: A line with at least so many separators, one for every five words or more, is navigation.
NAVIGATION_MARKS = 3
#: A document that loses more of its characters than this is rejected.
LOST_SHARE = 0.5
#: A line of so many words or fewer that has no end mark is a fragment.
FRAGMENT_WORDS = 2

# Phrases, lower case, that mark a line as boilerplate; the usual wording of site notices in English, then of
# the same notices in German, Spanish and French.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "use of cookies",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "subscribe to our",
    "sign up for our",
    "click here",
    "powered by",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "verwendung von cookies",
    "newsletter abonnieren",
    "klicken sie hier",
    "todos los derechos reservados",
    "política de privacidad",
    "términos de uso",
    "uso de cookies",
    "suscríbete a nuestro",
    "haga clic aquí",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "utilisation de cookies",
    "abonnez-vous à notre",
    "cliquez ici",
)

PUNCTUATION = r"[!#$%&*+/<=>@\\\[\]^_`{|}~]"
MARKS = r"[|\x{2022}\x{00BB}\x{203A}>]"
END = r"[.!?:;\"'\)\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x20\x09-\x0D]*$"


ONE_WORD = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$"
TWO_WORDS = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?+[\x20\x09-\x0D]*+$"


def has_boilerplate(text):
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(x) for x in BOILERPLATE])


def line_fails(line, suspect):
    """Whether one line with a word fails; suspect tells that its document has boilerplate somewhere. Cheap tests come
    first: words are counted only where a line has separators."""
    noisy = (F.regexp_count(line, F.lit(PUNCTUATION)) > PUNCTUATION_SHARE * F.length(line)) & ~line.rlike(ONE_WORD)
    marks = F.regexp_count(line, F.lit(MARKS))
    navigation = line.rlike(MARKS) & (marks >= NAVIGATION_MARKS) & (5 * marks >= F.regexp_count(line, F.lit(WORD)))
    fragment = line.rlike(TWO_WORDS) & ~line.rlike(END)
    return noisy | navigation | fragment | (suspect & has_boilerplate(line))


def clean(docs: DataFrame, text: str = "text", ident: str = "doc_id", with_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost_chars, line_chars and, unless with_text is off, cleaned (the lines that passed, joined by line feeds).

    A null or empty text has zeros, fails the base rules and isn't kept. Rows that repeat give equal rows. Null ids
    stay null. Work is per row, so nothing is shuffled; memory follows the longest text. Other columns are not read.
    """
    body = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One select for each generation of arrays, so that no array is computed twice.
    body = body.select("doc_id", "text", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"), F.split("text", "\n", -1).alias("lines"))
    body = body.select(
        "doc_id", "text", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.expr("IF(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("windows"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("lines"), has_boilerplate(F.col("text")).alias("suspect"),
    )
    # Windows found twice: equal neighbours once sorted. Documents where all differ skip the sort.
    body = body.withColumn("windows", F.expr("IF(size(array_distinct(windows)) = size(windows), array(), sort_array(transform(windows, (h, i) -> struct(h, i))))"))
    body = body.withColumn("at", F.expr("sort_array(transform(filter(windows, (w, j) -> (j > 0 AND w.h = windows[greatest(j - 1, 0)].h) OR (j < size(windows) - 1 AND w.h = windows[least(j + 1, size(windows) - 1)].h)), w -> w.i))"))
    body = body.withColumn("lines", F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x, F.col("suspect")).alias("fails"))))
    total = "aggregate(lines, 0L, (a, s) -> a + length(s.line))"
    body = body.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr("aggregate(transform(at, (p, j) -> IF(j < size(at) - 1, least(at[least(j + 1, size(at) - 1)] - p, 3), 3)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.expr("aggregate(lines, 0L, (a, s) -> a + IF(s.fails, length(s.line), 0))").alias("lost_chars"), F.expr(total).alias("line_chars"),
        F.expr("array_join(transform(filter(lines, s -> NOT s.fails), s -> s.line), '\n')").alias("cleaned"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("lost_chars") <= LOST_SHARE * F.col("line_chars"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "lost_chars", "line_chars"]
    return body.select(*columns, *["cleaned"] * with_text)
