"""Diffs larger than a row: diffs stored as (commit, part, text) rows, read as a table of lines.

Where ``explode_diff_lines`` reads a whole diff inside one row, this path never holds the text of more than one part
in a row: a diff of millions of lines is as many rows of parts, and every line learns its file, hunk and place by a
segmented scan. Each part is cut into runs, a run starting with the part or with a file or hunk start inside it. A run
is described without its text, by one character a line (``marks``: added, removed, marker or other), so that running
sums over the short table of runs give every run its offsets, its file, its hunk (the last hunk start at or before it,
if that lies after the last file start; its number is the count of hunk starts since that file start) and where its
lines lie in that hunk. Hunks are cut to their declared sizes, as the whole-diff path does (all lines when the counts
match, else up to the first line where they are reached, else none), from the same sums and marks. Only then do the
places of the kept runs meet the texts, by (commit, part): texts move once, and lines are never sorted.

The lines are those of the whole diff: the text of its parts joined by line breaks, in part order. A last empty line
(the diff ends with a line break) is no line. Missing texts hold no lines; a missing commit key is a commit too. A
(commit, part) that comes more than once is read line by line side by side, lines of one place sharing its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgauge.functions import diffs as D

FILE_LINE = "diff --git "
HUNK_LINE = r"\A@@ -[0-9]"
#: The line break before a file or hunk start.
NEXT_RUN = r"\n(?=diff --git |@@ -[0-9])"
PART_LINES = 256


def cut_into_parts(df: DataFrame, diff: str = "diff_raw", key: str = "commit_id", lines: int = PART_LINES) -> DataFrame:
    """Rows (key, part, text): each diff cut after every ``lines`` lines, the way large diffs are stored."""
    split = F.split(F.col(diff), "\n")
    parts = F.sequence(F.lit(0), F.floor((F.size(split) - 1) / lines).cast("int"))
    cut = df.where(F.col(diff).isNotNull()).select(key, split.alias("_l"), F.explode(parts).alias("part"))
    return cut.select(key, "part", F.array_join(F.slice("_l", F.col("part") * lines + 1, lines), "\n").alias("text"))


def _number(line: Column, group: int, default: int) -> Column:
    found = F.nullif(F.regexp_extract(line, D.HUNK_SIZES, group), F.lit(""))
    return F.coalesce(found.try_cast("int"), F.lit(default))


def _side_by_side(texts: Column) -> Column:
    """The lines of several texts as one text: all first lines, all second lines, and so on."""
    none = F.array().cast("array<string>")
    places = F.aggregate(
        texts,
        F.array().cast("array<array<string>>"),
        lambda met, text: F.zip_with(
            met,
            F.split(text, "\n"),
            lambda lines, line: F.concat(F.coalesce(lines, none), F.when(line.isNotNull(), F.array(line)).otherwise(none)),
        ),
    )
    return F.array_join(F.flatten(places), "\n")


def _texts(parts: DataFrame, key: str) -> DataFrame:
    """One row (_k, part, copies, text) of each stored part; ``_k`` holds the commit key, so that a missing key is one too.

    All readers ask for the same columns of the dealt parts, so that Spark deals them once."""
    dealt = parts.where(F.col("text").isNotNull()).select(F.struct(key).alias("_k"), "part", "text").repartition("_k", "part")
    met = dealt.groupBy("_k", "part").agg(F.sort_array(F.collect_list("text")).alias("_t"))
    text = F.when(F.size("_t") == 1, F.get("_t", 0)).otherwise(_side_by_side(F.col("_t")))
    return met.select("_k", "part", F.size("_t").alias("copies"), text.alias("text"))


def _mark(line: Column) -> Column:
    first = F.left(line, F.lit(1))
    return F.when(first.isin("+", "-", "\\"), first).otherwise(" ")


def _runs(texts: DataFrame) -> DataFrame:
    """Every run without its text: its place (_k, part, s), fs and hs (whether a file or a hunk starts it), marks, file_no
    and gh (file and hunk starts so far), p (its first line in the part), start (lines before the part), at (the index
    of its first line), mark (the kind of the last start), and of the last file start f_gh and f_at, of the last hunk
    start h_at, old_size and new_size."""
    cut = texts.select("_k", "part", "copies", F.posexplode(F.split("text", NEXT_RUN)).alias("s", "run"))
    header = F.substring_index("run", "\n", 1)
    hunk_start = F.col("run").rlike(HUNK_LINE)
    runs = cut.select(
        "_k", "part", "copies", "s",
        F.col("run").startswith(FILE_LINE).cast("int").alias("fs"),
        hunk_start.cast("int").alias("hs"),
        F.array_join(F.transform(F.split("run", "\n"), _mark), "").alias("marks"),
        ((F.col("run") == "") | F.col("run").endswith("\n")).alias("open"),
        F.when(hunk_start, _number(header, 2, 1)).alias("old_size"),
        F.when(hunk_start, _number(header, 4, 1)).alias("new_size"),
    )
    runs = runs.withColumn("n", F.length("marks"))
    order = Window.partitionBy("_k").orderBy("part", "s")
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("_k", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)

    def last(when: str, value: Column) -> Column:
        return F.last(F.when(F.col(when) == 1, value), ignorenulls=True).over(here)

    runs = runs.select(
        "*",
        F.sum("fs").over(here).alias("file_no"),
        F.sum("hs").over(here).alias("gh"),
        F.last(F.when(F.col("hs") == 1, "h").when(F.col("fs") == 1, "f"), ignorenulls=True).over(here).alias("mark"),
        F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("p"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"),
        F.lead("part").over(order).isNull().alias("ends"),
    )
    phantom = F.col("ends") & F.col("open") & (F.col("copies") == 1)
    runs = runs.withColumns({
        "marks": F.when(phantom, F.left("marks", F.col("n") - 1)).otherwise(F.col("marks")),
        "start": F.col("lines") - F.col("p"),
    })
    runs = runs.withColumn("at", _line(F.lit(0)))
    return runs.select(
        "_k", "part", "s", "copies", "fs", "hs", "marks", "file_no", "gh", "p", "start", "mark",
        last("fs", F.col("gh")).alias("f_gh"), last("fs", F.col("at")).alias("f_at"), last("hs", F.col("at")).alias("h_at"),
        last("hs", F.col("old_size")).alias("old_size"), last("hs", F.col("new_size")).alias("new_size"),
    )


def _line(q: Column) -> Column:
    """The index in the diff of line ``q`` of a run."""
    return F.col("start") + F.floor((F.col("p") + q) / F.col("copies"))


def _reached(marks: Column, old: Column, new: Column) -> Column:
    """How many lines until ``old`` old lines and ``new`` new lines are met, one line at least; NULL if they never are."""

    def step(met: Column, k: Column) -> Column:
        one = F.substring(marks, k, F.lit(1))
        o = met["o"] + F.when(one.isin("+", "\\"), 0).otherwise(1)
        n = met["n"] + F.when(one.isin("-", "\\"), 0).otherwise(1)
        found = F.coalesce(met["at"], F.when((o == old) & (n == new), k))
        return F.struct(o.alias("o"), n.alias("n"), found.alias("at"))

    zero = F.struct(F.lit(0).alias("o"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.length(marks)), zero, step, lambda met: met["at"])


def _lines(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Every line of the runs in ``places``, which meet the texts by (_k, part); all columns of the run, q and text."""
    rest = [c for c in places.columns if c not in ("_k", "part", "copies")]
    met = places.groupBy("_k", "part").agg(F.collect_list(F.struct(*rest)).alias("_places"))
    cut = texts.join(met, ["_k", "part"]).select("_k.*", "copies", F.split("text", NEXT_RUN).alias("_runs"), "_places")
    runs = cut.select("*", F.explode("_places").alias("_r")).drop("_places")
    runs = runs.select("*", "_r.*").withColumn("_run", F.get("_runs", F.col("s"))).drop("_runs", "_r")
    return runs.select("*", F.posexplode(F.split("_run", "\n")).alias("q", "text")).drop("_run")


def lines_of_parts(parts: DataFrame, key: str = "commit_id") -> DataFrame:
    """Rows (key, file_no, hunk_no, line_no, text, kind) of every kept hunk line."""
    texts = _texts(parts, key)
    runs = _runs(texts).where((F.col("mark") == "h") & (F.col("file_no") > 0))

    # Per hunk: counts and the first line where the declared sizes are reached, from the marks below the header.
    body = F.when(F.col("hs") == 1, F.substring("marks", 2, 1 << 30)).otherwise(F.col("marks"))
    runs = runs.withColumn("body", body)

    def lines_with(one: str) -> Column:
        return F.length("body") - F.length(F.replace("body", F.lit(one), F.lit("")))

    sides = F.length("body") - lines_with("\\")
    runs = runs.withColumns({"o": sides - lines_with("+"), "n": sides - lines_with("-")})
    hunk = Window.partitionBy("_k", "gh")
    before = hunk.orderBy("part", "s").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "*", *(F.sum(c).over(hunk).alias(f"all_{c}") for c in "on"),
        *((F.col(size) - F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"left_{c}") for c, size in (("o", "old_size"), ("n", "new_size"))),
    )
    runs = runs.withColumn("exact", (F.col("all_o") == F.col("old_size")) & (F.col("all_n") == F.col("new_size")))
    passed = F.col("left_o").between(F.lit(0), F.col("o")) & F.col("left_n").between(F.lit(0), F.col("n"))
    q = F.when(~F.col("exact") & passed & (F.col("body") != ""), _reached(F.col("body"), F.col("left_o"), F.col("left_n")))
    runs = runs.withColumn("reach", F.min(_line(F.col("hs") + q - 1) - F.col("h_at")).over(hunk))
    kept = runs.where(F.col("exact") | F.col("reach").isNotNull()).select(
        "_k", "part", "copies", "s", "hs", "file_no", (F.col("gh") - F.col("f_gh")).alias("hunk_no"), "p", "start", "h_at",
        F.length("marks").alias("n"), F.when(~F.col("exact"), F.col("reach")).alias("reach"),
    )
    lines = _lines(texts, kept).where((F.col("q") >= F.col("hs")) & (F.col("q") < F.col("n")))
    lines = lines.withColumn("line_no", _line(F.col("q")) - F.col("h_at"))
    lines = lines.where(F.col("reach").isNull() | (F.col("line_no") <= F.col("reach")))
    return lines.select(key, "file_no", "hunk_no", "line_no", "text", D.line_kind(F.col("text")).alias("kind"))


def file_paths(parts: DataFrame, key: str = "commit_id") -> DataFrame:
    """Rows (key, file_no, path): each file's path from its header lines (from its first line up to its first hunk),
    read as the whole-diff path reads it."""
    texts = _texts(parts, key)
    places = _runs(texts).where(F.col("mark") == "f").select("_k", "part", "copies", "s", "file_no", "p", "start", "f_at")
    header = _lines(texts, places).withColumn("i", _line(F.col("q")))

    def first(pattern: str) -> Column:
        found = F.regexp_extract("text", pattern, 1)
        return F.min(F.when(found != "", F.struct(F.col("i"), found.alias("v"))))["v"]

    def on_first_line(pattern: str, group: int) -> Column:
        found = F.regexp_extract("text", pattern, group)
        return F.max(F.when((F.col("i") == F.col("f_at")) & (found != ""), found))

    files = header.groupBy(key, "file_no").agg(
        first(r"^--- ([^\t\n]+)").alias("dash"), first(r"^\+\+\+ ([^\t\n]+)").alias("plus"),
        F.max(F.col("text").rlike("^new file mode ")).alias("new_mode"),
        F.max(F.col("text").rlike("^deleted file mode ")).alias("deleted_mode"),
        on_first_line(D.GIT_PATHS, 1).alias("git_old"), on_first_line(D.GIT_PATHS, 2).alias("git_new"),
        on_first_line(D.ANY_PATHS, 1).alias("any_old"), on_first_line(D.ANY_PATHS, 2).alias("any_new"),
    )
    dev_null = F.lit(D.V.DEV_NULL)
    old = F.coalesce("dash", F.when(F.col("new_mode"), dev_null), "git_old", "any_old")
    new = F.coalesce("plus", F.when(F.col("deleted_mode"), dev_null), "git_new", "any_new")
    no_old, no_new = old == dev_null, new == dev_null
    renamed = ~no_old & ~no_new & (F.substring(old, 3, 1 << 30) != F.substring(new, 3, 1 << 30))
    path = D._bare_path(F.when(no_old | renamed, new).otherwise(old))
    return files.select(key, "file_no", path.alias("path"))
