"""Line-first quality cleaning in column functions.

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines go, and a document that loses
too much of its text that way is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import computed, let, words

#: Phrases, in lower case, of lines that belong to a page and not to its text.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "licensed under", "this work is licensed", "click here", "read more", "sign up", "log in", "subscribe to",
    "share this", "follow us", "enable javascript", "lorem ipsum", "powered by",
)
#: How a line of prose ends, closing quotes and brackets apart; marks that no prose puts in rows.
LINE_END = r"[.!?:;,…。！？]['\"”’»)\]]*[\x20\x09-\x0D]*$"
MARKS = r"[#*$%&|<>!]{2,}"
#: Separators of menus and tables, as words of their own.
SEPARATORS = ("|", "»", "«", ">", "<", "·", "•", "/", "::", "→")
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(found: Column, width: int = 5) -> Column:
    """Words inside a window of `width` words that the array holds twice or more, overlaps counted once.

    Windows are compared by 64-bit hashes. Only an array with an equal pair of windows is sorted by them.
    """

    def covered(windows: Column) -> Column:
        in_order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        total = F.aggregate(
            let(in_order, positions),
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n")),
        )
        return total["n"]

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))
        )
        return let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
        )

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) <= width, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def line_fails(line: Column) -> Column:
    """Whether a line that holds a word fails a rule: punctuation, navigation or boilerplate."""


    def shape(w: Column) -> Column:
        menu = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS)))
        return (F.regexp_count(line, F.lit(MARKS)) * 10 > F.size(w) * 3) | (menu * 4 >= F.size(w) - menu) & (menu > 0)

    def boilerplate(lower: Column) -> Column:
        return reduce(lambda a, b: a | b, (lower.contains(p) for p in BOILERPLATE))

    return ~line.rlike(LINE_END) | let(words(line), shape) | let(F.lower(line), boilerplate)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.3) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_lost, kept,
    clean_text) of every row of `docs`, in one narrow pass.

    clean_text is the text without failing lines, the very text if no line fails. Lines without a word neither fail nor
    count. kept is false for base_failed (under 10 words, or over 20 % of the words repeated) and where the failing
    lines hold more than `most_lost` of the words. A missing, empty or blank text has no words and is rejected; its
    clean_text is empty. A missing id stays missing. Repeated rows are judged alike. Other columns are ignored.
    """
    long = lambda c: c.cast("long")

    def judged(text: Column, w: Column, lines: Column, real: Column, fails: Column) -> Column:
        lost = F.aggregate(F.filter(lines, lambda x, i: F.get(fails, i)), F.lit(0), lambda n, x: n + F.size(words(x)))
        left = F.array_join(F.filter(lines, lambda x, i: ~F.get(fails, i)), "\n")
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size(real) - F.size(F.array_distinct(real))).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            long(lost).alias("words_lost"),
            F.when(F.exists(fails, lambda x: x), left).otherwise(text).alias("clean_text"),
        )

    def has_word(line: Column) -> Column:
        return line.rlike(r"[^\x20\x09-\x0D]")

    def of_text(text: Column) -> Column:
        return let(
            words(text),
            lambda w: let(
                F.split(text, "\n"),
                lambda lines: let(
                    F.filter(lines, has_word),
                    lambda real: let(
                        F.transform(lines, lambda x: has_word(x) & line_fails(x)),
                        lambda fails: judged(text, w, lines, real, fails),
                    ),
                ),
            ),
        )

    found = computed(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")),
        "doc_id",
        j=of_text(F.col("text")),
    ).select("doc_id", "j.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "words_lost", (~failed & (F.col("words_lost") <= most_lost * F.col("n_words"))).alias("kept"), "clean_text",
    )


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The kept documents with their cleaned text, all columns of `documents`; n_chars follows the text."""
    by_id = quality(docs.select(F.struct("doc_id", "lang", "source").alias("all"), "text"), "all", **options)
    return by_id.filter("kept").select(
        "doc_id.doc_id", F.col("clean_text").alias("text"), "doc_id.lang", "doc_id.source",
        F.length("clean_text").cast("long").alias("n_chars"),
    )
