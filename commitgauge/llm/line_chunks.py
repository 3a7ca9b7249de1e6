"""Removal of repeated passages by content-defined line chunks, in column functions and joins only.

A rolling hash over two neighbouring line hashes values every gap between lines. A gap is a boundary if its value is
smaller than those of both gaps beside it, so boundaries depend on three gaps alone, move with the text, and leave at
least two lines between them. A line of `long_words` words or more is a passage in itself and stands alone.

Chunks miss passages that hold no whole chunk. So the shortest runs of lines of over `long_words` words are met as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import computed, let, stored, words
from commitgauge.operators.joins import hot_join


def chunk_spans(text: Column, long_words: int) -> Column:
    """Array of (start, length, worth, h) of a text's chunks; start from 1; worth: two lines or more, or a long line."""

    def spans(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.md5(x))
        long = F.transform(lines, lambda x: F.size(words(x)) >= long_words)

        def of_hashes(h: Column) -> Column:
            gaps = F.transform(
                F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.md5(F.concat(F.get(h, i - 1), F.get(h, i)))
            )

            def of_gaps(g: Column) -> Column:
                def of_long(is_long: Column) -> Column:
                    inner = F.filter(
                        F.sequence(F.lit(1), F.size(h) - 1),
                        lambda i: F.coalesce(
                            (F.get(g, i - 1) < F.get(g, i - 2)) & (F.get(g, i - 1) < F.get(g, i)), F.lit(False)
                        )
                        | F.get(is_long, i - 1)
                        | F.get(is_long, i),
                    )
                    starts = F.concat(F.array(F.lit(0)), inner, F.array(F.size(h)))

                    def cut(s: Column) -> Column:
                        return F.transform(
                            F.sequence(F.lit(0), F.size(s) - 2),
                            lambda k: F.struct(
                                (F.get(s, k) + 1).alias("start"),
                                (F.get(s, k + 1) - F.get(s, k)).alias("length"),
                                ((F.get(s, k + 1) - F.get(s, k) >= 2) | F.get(is_long, F.get(s, k))).alias("worth"),
                                F.xxhash64(
                                    _joined(lines, F.get(s, k) + 1, F.get(s, k + 1) - F.get(s, k))
                                ).alias("h"),
                            ),
                        )

                    return let(starts, cut)

                return let(long, of_long)

            return F.when(
                F.size(h) > 1, let(gaps, of_gaps)
            ).otherwise(
                F.array(
                    F.struct(
                        F.lit(1).alias("start"), F.lit(1).alias("length"), F.get(long, 0).alias("worth"),
                        F.xxhash64(text).alias("h"),
                    )
                )
            )

        return let(hashes, of_hashes)

    return let(F.split(text, "\n"), spans)


def _joined(lines: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(lines, start, length), "\n")


def run_spans(text: Column, long_words: int) -> Column:
    """Array of (start, length, h) of the shortest runs of whole lines of over `long_words` words, one from every line
    and one up to every line that has a word. Single lines are left out: such a line is a chunk by itself.

    Such a run depends on its own lines alone, so copies of a passage have the same. A passage of over `long_words`
    words is the union of its runs, apart from blank lines: a line from which no run ends inside the passage has so few
    words behind it that the run up to the last line reaches over it. A run has at most `long_words` + 1 lines with a
    word, so the work grows with the lines.
    """

    def reached(full: Column) -> Column:
        """(at, to, n) for every line: where the run in the order of `full` ends, and its words."""

        def more(acc: Column, line: Column) -> Column:
            longer = F.struct(line["at"].alias("to"), (acc["n"] + line["n"]).alias("n"))
            return F.when(acc["n"] > long_words, acc).otherwise(longer)

        return F.transform(
            full,
            lambda line, k: F.struct(
                line["at"].alias("at"),
                F.aggregate(
                    F.slice(full, k + 1, F.lit(long_words + 1)), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), more
                ).alias("run"),
            ),
        )

    def runs(lines: Column) -> Column:
        sized = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), F.size(words(x)).alias("n")))

        def of_full(full: Column) -> Column:
            ends = F.concat(reached(full), let(F.reverse(full), reached))
            ends = F.filter(ends, lambda e: (e["run"]["n"] > long_words) & (e["at"] != e["run"]["to"]))
            spans = F.array_distinct(
                F.transform(
                    ends,
                    lambda e: F.struct(
                        F.least(e["at"], e["run"]["to"]).alias("start"),
                        (F.abs(e["at"] - e["run"]["to"]) + 1).alias("length"),
                    ),
                )
            )
            return F.transform(
                spans,
                lambda s: F.struct(
                    s["start"].alias("start"), s["length"].alias("length"),
                    F.xxhash64(_joined(lines, s["start"], s["length"])).alias("h"),
                ),
            )

        return let(F.filter(sized, lambda s: s["n"] > 0), of_full)

    return let(F.split(text, "\n"), runs)


def _lines_of(spans: Column) -> Column:
    return F.flatten(F.transform(spans, lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))


def _apart(chunks: Column, runs: Column) -> Column:
    """The chunks, and the lines of the runs outside of them as spans that do not meet: (start, length) in order."""

    def spans(at: Column) -> Column:
        starts = F.filter(at, lambda d, i: F.coalesce(d - F.get(at, i - 1) > 1, F.lit(True)))
        ends = F.filter(at, lambda d, i: F.coalesce(F.get(at, i + 1) - d > 1, F.lit(True)))
        return let(ends, lambda e: F.transform(
            starts, lambda d, i: F.struct(d.alias("start"), (F.get(e, i) - d + 1).alias("length"))
        ))

    plain = F.transform(chunks, lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length")))
    rest = F.sort_array(F.array_except(_lines_of(runs), _lines_of(chunks)))
    return F.when(F.size(runs) == 0, plain).otherwise(F.sort_array(F.concat(plain, let(rest, spans))))


def _chunks(text: Column, long_words: int) -> Column:
    """(start, length, h) of the chunks that are worth removing."""
    return F.transform(
        F.filter(chunk_spans(text, long_words), lambda s: s["worth"]),
        lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), s["h"].alias("h")),
    )


def _marked(spans: Column, is_run: bool) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["length"].alias("length"), s["h"].alias("h"), F.lit(is_run).alias("is_run")
        ),
    )


def repeated_chunks(docs: DataFrame, long_words: int = 50, label: str = "lines") -> DataFrame:
    """The columns of `docs` with an array `removed` of (start, length) of chunks that stand earlier somewhere.

    Chunks alone: a passage that holds no whole chunk stays; `repeated_passages` meets those as well.
    """
    return _repeated(docs, _marked(_chunks(F.col("text"), long_words), False), label)


def repeated_passages(docs: DataFrame, long_words: int = 50, label: str = "lines") -> DataFrame:
    """The columns of `docs` with an array `removed` of (start, length): lines that stand earlier, spans that do not meet.

    Removed are chunks that stand earlier, and all lines with a word of any passage of whole lines of over `long_words`
    words that stands earlier, wherever its chunks end.
    """
    runs = run_spans(F.col("text"), long_words)
    both = lambda c: F.concat(_marked(c, False), _marked(F.array_except(runs, c), True))
    return _repeated(docs, let(_chunks(F.col("text"), long_words), both), label)


def _repeated(docs: DataFrame, spans: Column, label: str) -> DataFrame:
    """`docs` with `removed`: those of the spans (start, length, h, is_run) of a text that stand earlier somewhere.

    Earlier: in a smaller doc_id, or further up and not overlapping. Spans are met by hash first and without their
    texts; then the SHA-256 digests of the texts of those that met are compared with the first of their hash. A span
    that very many documents share is cut into slices for both. Two texts under one hash, should that happen, are told
    apart by grouping on the digests. Rows without id or text are left as they are and meet nothing; rows that share an
    id are one document. The texts are shuffled once, by document.
    """
    sure = docs.filter("doc_id is not null and text is not null")
    hashed = sure.select("doc_id", F.explode(spans).alias("s"))
    hashed = hashed.select("doc_id", "s.start", "s.length", "s.h", "s.is_run")
    hashed = stored(hashed, f"{label}-hashes")
    first = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    first = stored(first.filter("n > 1"), f"{label}-repeated")
    total = hashed.count()
    met = hot_join(hashed, first.drop("n"), "h", ["doc_id", "start"], first, total)
    lists = met.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_set(
                F.struct(
                    "start", "length", "h", "is_run", (F.struct("doc_id", "start") == F.col("first")).alias("is_first"),
                    F.expr("doc_id = first.doc_id and start < first.start + length").alias("stays"),
                )
            )
        ).alias("met")
    )
    listed = stored(docs.join(lists, "doc_id", "left"), f"{label}-documents")
    digests = let(
        F.split("text", "\n"),
        lambda lines: F.transform(
            "met",
            lambda c: F.struct(
                c["start"], c["length"], c["h"], c["is_first"],
                F.unhex(F.sha2(_joined(lines, c["start"], c["length"]), 256)).alias("chunk"),
            ),
        ),
    )
    texts = listed.filter("met is not null").select("doc_id", F.inline(digests))
    keepers = texts.filter("is_first").select("h", F.col("chunk").alias("first_chunk")).dropDuplicates(["h"])
    other = stored(
        hot_join(texts.filter("not is_first"), keepers, "h", ["doc_id", "start"], first, total)
        .filter("chunk <> first_chunk")
        .select("doc_id", "start", "length", "chunk"),
        f"{label}-collisions",
    )
    gone = F.filter("met", lambda c: ~c["stays"])
    if other.take(1):
        spare = other.groupBy("chunk").agg(F.min(F.struct("doc_id", "start", "length")).alias("first"))
        spare = spare.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.start", "first.length")).alias("spare"))
        listed = listed.join(spare, "doc_id", "left")
        spared = lambda c: F.array_contains("spare", F.struct(c["start"], c["length"]))
        gone = F.filter("met", lambda c: ~c["stays"] & ~F.coalesce(spared(c), F.lit(False)))
    removed = let(gone, lambda g: _apart(F.filter(g, lambda c: ~c["is_run"]), F.filter(g, lambda c: c["is_run"])))
    none = F.array().cast("array<struct<start:int,length:int>>")
    return listed.select(*docs.columns, F.coalesce(removed, none).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without the lines of the removed chunks; the very text if there are none."""

    def kept(lines: Column) -> Column:
        return let(
            F.array_except(F.sequence(F.lit(1), F.size(lines)), _lines_of(removed)),
            lambda left: F.array_join(F.transform(left, lambda i: F.get(lines, i - 1)), "\n"),
        )

    return F.when(F.size(removed) == 0, text).otherwise(let(F.split(text, "\n"), kept))


def deduplicated_documents(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """The documents without repeated passages, all columns of `documents`; one that keeps no word goes."""
    found = repeated_passages(docs, long_words)
    left = computed(
        found.withColumnRenamed("text", "whole"), "doc_id", "lang", "source", "n_chars", "removed",
        text=without(F.col("whole"), F.col("removed")),
    )
    left = left.filter((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(
        "doc_id", "text", "lang", "source",
        F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars"),
    )
