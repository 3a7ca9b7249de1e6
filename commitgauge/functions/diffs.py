"""Reading and condensing git diffs inside one row.

A diff is split into files and a file into hunks, as array columns of its own
row. A hunk stays one text: its lines are counted and cut by byte search, and
only split where a rule needs single lines. No step shuffles, so work grows with
the text read and no commit, project or file can become a hot group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions.text import BLANK, WHITESPACE, let, rstrip, strip

# (?d): only \n ends a line. Inside a hunk every line starts with ' ', '+', '-' or '\',
# so these two can only match structure.
FILE_START = r"(?md)^(?=diff --git )"
HUNK_START = r"(?md)^(?=@@ -[0-9])"
HUNK_SIZES = r"\A@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
GIT_PATHS = r"\Adiff --git (a/[^\t\n]+) (b/[^\t\n]+)"
ANY_PATHS = r"\Adiff --git ([^\t\n]+) ([^\t\n]+)"
OLD_PATH = r"(?md)^--- ([^\t\n]+)"
NEW_PATH = r"(?md)^\+\+\+ ([^\t\n]+)"
# In the text of a hunk every line stands behind a line break.
CHANGED_LINE = r"\n[-+\\]"
FIRST_WORD_ADDED = rf"\n\+[{BLANK}]*+([^{WHITESPACE}]+)"


@dataclass(frozen=True)
class Limits:
    """What condensing leaves out; None for ``long_hunk``, ``repetitive_min_added`` or a ``max`` means no cut.

    Hunks longer than ``long_hunk`` lines are folded to ``keep_lines`` at both ends, in code only if they are longer
    than ``huge_hunk`` or hold fewer than ``sparse_changes`` changes between. A hunk of ``repetitive_min_added`` added
    lines, of which more than ``repetitive_share`` start alike, is folded to ``keep_repetitive`` lines at both ends.
    """

    long_hunk: int | None = V.LONG_HUNK
    huge_hunk: int = V.HUGE_HUNK
    keep_lines: int = V.KEEP_LINES
    sparse_changes: int = V.SPARSE_CHANGES
    repetitive_min_added: int | None = V.REPETITIVE_MIN_ADDED
    repetitive_share: float = V.REPETITIVE_SHARE
    keep_repetitive: int = V.KEEP_REPETITIVE
    artifact_lines: int = V.ARTIFACT_LINES
    max_chars: int | None = V.MAX_DIFF_CHARS
    max_broken_chars: int | None = V.MAX_BROKEN_CHARS


def _any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def occurrences(text: Column, needle: str) -> Column:
    """How often ``needle``, which cannot overlap itself, is in ``text``."""
    without = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.octet_length(text) - F.octet_length(without)) / len(needle)).cast("int")


def rstrip_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), rstrip), "\n")


def line_kind(line: Column) -> Column:
    return (
        F.when(line.startswith("+"), "added")
        .when(line.startswith("-"), "removed")
        .when(line.startswith("\\"), "marker")
        .otherwise("context")
    )


# ---- structure ----------------------------------------------------------------------


def _read_hunk(chunk: Column) -> Column:
    """Declared sizes, text below the header, and line counts of one hunk.

    The text keeps the line break of the header in front, so that every line
    stands behind one and a hunk without lines is the empty text.
    """

    def below_header(parts: Column) -> Column:
        rest = F.coalesce(F.get(parts, 1), F.lit(""))
        cut = F.when(rest.endswith("\n"), F.left(rest, F.length(rest) - 1)).otherwise(rest)
        text = F.when(rest == "", "").otherwise(F.concat(F.lit("\n"), cut))
        return F.struct(parts[0].alias("header"), text.alias("text"))

    def measure(hunk: Column) -> Column:
        def number(group: int, default: int) -> Column:
            return F.coalesce(_extract(hunk["header"], HUNK_SIZES, group).try_cast("int"), F.lit(default))

        return F.struct(
            number(1, 0).alias("old_start"),
            number(2, 1).alias("old_size"),
            number(3, 0).alias("new_start"),
            number(4, 1).alias("new_size"),
            hunk["text"].alias("text"),
            *_line_counts(hunk["text"]),
        )

    return let(let(F.split(chunk, "\n", 2), below_header), measure)


def _line_counts(text: Column) -> list[Column]:
    return [
        occurrences(text, "\n").alias("size"),
        occurrences(text, "\n+").alias("added"),
        occurrences(text, "\n-").alias("removed"),
        occurrences(text, "\n\\").alias("marks"),
    ]


def _declared_end(hunk: Column) -> Column:
    """How many lines reach the declared sizes; NULL when they never match."""

    def step(state: Column, line: Column) -> Column:
        first = F.left(line, F.lit(1))
        old = state["old"] + F.when(first.isin("+", "\\"), 0).otherwise(1)
        new = state["new"] + F.when(first.isin("-", "\\"), 0).otherwise(1)
        reached = (old == hunk["old_size"]) & (new == hunk["new_size"])
        end = F.coalesce(state["end"], F.when(reached, state["seen"] + 1))
        return F.struct(
            old.alias("old"), new.alias("new"), (state["seen"] + 1).alias("seen"), end.alias("end")
        )

    start = F.struct(
        F.lit(0).alias("old"),
        F.lit(0).alias("new"),
        F.lit(0).alias("seen"),
        F.lit(None).cast("int").alias("end"),
    )
    return F.aggregate(hunk_lines(hunk), start, step)["end"]


def _trim_hunk(hunk: Column) -> Column:
    """Cut text behind the declared sizes; a hunk that never reaches them is broken."""
    old = hunk["size"] - hunk["added"] - hunk["marks"]
    new = hunk["size"] - hunk["removed"] - hunk["marks"]
    exact = (old == hunk["old_size"]) & (new == hunk["new_size"])

    starts = [hunk[n].alias(n) for n in ("old_start", "old_size", "new_start", "new_size")]
    counts = [hunk[n].alias(n) for n in ("size", "added", "removed", "marks")]

    def cut(end: Column) -> Column:
        first = F.call_function("substring_index", hunk["text"], F.lit("\n"), end + 1)
        return let(
            F.when(end.isNotNull(), first).otherwise(""),
            lambda kept: F.struct(
                *starts, kept.alias("text"), *_line_counts(kept), end.isNull().alias("broken")
            ),
        )

    whole = F.struct(*starts, hunk["text"].alias("text"), *counts, F.lit(False).alias("broken"))
    return F.when(exact, whole).otherwise(let(_declared_end(hunk), cut))


def hunk_lines(hunk: Column) -> Column:
    """Lines of a hunk as an array."""
    lines = F.split(hunk["text"], "\n")
    return F.slice(lines, 2, F.size(lines))


def _read_file(chunk: Column) -> Column:
    """Paths and hunks of one file section."""

    def from_parts(parts: Column) -> Column:
        header = parts[0]
        old = F.coalesce(
            _extract(header, OLD_PATH),
            F.when(header.rlike(r"(?md)^new file mode "), F.lit(V.DEV_NULL)),
            _extract(header, GIT_PATHS, 1),
            _extract(header, ANY_PATHS, 1),
        )
        new = F.coalesce(
            _extract(header, NEW_PATH),
            F.when(header.rlike(r"(?md)^deleted file mode "), F.lit(V.DEV_NULL)),
            _extract(header, GIT_PATHS, 2),
            _extract(header, ANY_PATHS, 2),
        )
        hunks = F.transform(F.slice(parts, 2, F.size(parts)), _read_hunk)
        return F.struct(
            old.alias("old_path"), new.alias("new_path"), F.transform(hunks, _trim_hunk).alias("hunks")
        )

    return let(F.split(chunk, HUNK_START), from_parts)


def _bare_path(path: Column) -> Column:
    """Path without its side letter, keeping quotes."""

    def unsided(text: Column) -> Column:
        return F.when(text.rlike(r"\A[ab]/"), F.substring(text, 3, 1 << 30)).otherwise(text)

    quoted = path.startswith('"') & path.endswith('"') & (F.length(path) > 1)
    inner = F.substring(path, F.lit(2), F.length(path) - 2)
    return F.when(quoted, F.concat(F.lit('"'), unsided(inner), F.lit('"'))).otherwise(unsided(path))


def _name_file(file: Column) -> Column:
    """Add path, status tag and class of a file, and its line counts."""
    hunks = file["hunks"]
    only = F.get(hunks, 0)
    single = F.size(hunks) == 1
    no_old = file["old_path"] == V.DEV_NULL
    no_new = file["new_path"] == V.DEV_NULL
    new_file = no_old | (single & (only["old_start"] == 0) & (only["old_size"] == 0))
    deleted = no_new | (single & (only["new_start"] == 0) & (only["new_size"] == 0))
    renamed = (
        ~no_old
        & ~no_new
        & (F.substring(file["old_path"], 3, 1 << 30) != F.substring(file["new_path"], 3, 1 << 30))
    )
    path = let(
        F.when(no_old | renamed, file["new_path"]).otherwise(file["old_path"]), _bare_path
    )
    tag = (
        F.when(F.coalesce(deleted, F.lit(False)), V.TAG_DELETED)
        .when(F.coalesce(new_file, F.lit(False)), V.TAG_NEW)
        .when(renamed, V.TAG_RENAMED)
        .otherwise("")
    )

    def total(name: str) -> Column:
        return F.aggregate(hunks, F.lit(0).cast("long"), lambda acc, h: acc + h[name])

    return F.struct(
        path.alias("path"),
        tag.alias("tag"),
        let(F.lower(path), classify_path).alias("kind"),
        total("added").alias("added"),
        total("removed").alias("removed"),
        hunks.alias("hunks"),
    )


def classify_path(lower: Column) -> Column:
    """noise, log, artifact or code, for a path in lower case."""
    folder = F.lit(False)
    for name in V.ARTIFACT_FOLDERS:
        folder = folder | lower.startswith(name)
    artifact = folder | lower.rlike(_any_of(V.ARTIFACT_WORDS))
    return (
        F.when(lower.rlike(_any_of(V.NOISE_SUFFIXES) + r"\z"), "noise")
        .when(artifact & lower.rlike(_any_of(V.LOG_WORDS)), "log")
        .when(artifact, "artifact")
        .otherwise("code")
    )


def read_files(diff: Column) -> Column:
    """Files of a diff: array of (path, tag, kind, added, removed, hunks)."""
    chunks = F.filter(F.split(diff, FILE_START), lambda c: c.startswith("diff --git "))
    return F.transform(F.transform(chunks, _read_file), _name_file)


def is_broken(diff: Column, files: Column) -> Column:
    """A hunk before any file, or a hunk that disagrees with its declared sizes."""
    before_files = F.split(diff, FILE_START, 2)[0]
    stray = ~before_files.startswith("diff --git ") & before_files.rlike(HUNK_START)
    return stray | F.exists(files, lambda f: F.exists(f["hunks"], lambda h: h["broken"]))


# ---- condensing ---------------------------------------------------------------------


def is_repetitive(hunk: Column, limits: Limits = Limits()) -> Column:
    """Whether one first word starts more than the given share of the added lines.

    A word with more than half of all words is the middle one after sorting, so
    only that one has to be counted.
    """
    if limits.repetitive_min_added is None:
        return F.lit(False)
    words = F.regexp_extract_all(hunk["text"], F.lit(FIRST_WORD_ADDED), F.lit(1))

    def share(ordered: Column) -> Column:
        middle = F.get(ordered, (F.size(ordered) / 2).cast("int"))
        return let(
            middle, lambda word: F.size(F.filter(ordered, lambda x: x == word)) / hunk["added"]
        )

    enough = hunk["added"] >= limits.repetitive_min_added
    return F.when(
        enough, F.coalesce(let(F.sort_array(words), share) > limits.repetitive_share, F.lit(False))
    ).otherwise(F.lit(False))


def _first_lines(hunk: Column, n: int) -> Column:
    """First lines, each still behind a line break."""
    return F.substring_index(hunk["text"], "\n", n + 1)


def _last_lines(hunk: Column, n: int) -> Column:
    return F.concat(F.lit("\n"), F.substring_index(hunk["text"], "\n", -n))


def _fold(hunk: Column, keep: int, note: str) -> Column:
    """First and last ``keep`` lines around a note of how many are left out."""
    return F.concat(
        _first_lines(hunk, keep),
        F.format_string("\n" + note, hunk["size"] - 2 * keep),
        _last_lines(hunk, keep),
    )


def _is_long(hunk: Column, limits: Limits) -> Column:
    return F.lit(False) if limits.long_hunk is None else hunk["size"] > limits.long_hunk


def _log_text(hunk: Column, limits: Limits) -> Column:
    folded = _fold(hunk, limits.keep_lines, V.SNIP_LOG)
    return F.when(_is_long(hunk, limits), folded).otherwise(hunk["text"])


def _code_text(hunk: Column, limits: Limits) -> Column:
    keep = limits.keep_lines

    def changed(text: Column) -> Column:
        return F.regexp_count(text, F.lit(CHANGED_LINE))

    outside = changed(_first_lines(hunk, keep)) + changed(_last_lines(hunk, keep))
    inside = hunk["added"] + hunk["removed"] + hunk["marks"] - outside
    return (
        F.when(is_repetitive(hunk, limits), _fold(hunk, limits.keep_repetitive, V.SNIP_REPETITIVE))
        .when(
            _is_long(hunk, limits) & ((hunk["size"] > limits.huge_hunk) | (inside < limits.sparse_changes)),
            _fold(hunk, keep, V.SNIP_BODY),
        )
        .otherwise(hunk["text"])
    )


def _texts(hunks: Column, text_of: Callable[[Column], Column]) -> Column:
    """Shown text of each hunk, every line behind a line break."""
    return F.transform(hunks, lambda h: rstrip_lines(text_of(h)))


def _file_text(file: Column, limits: Limits) -> Column:
    """Shown text of a file, ending without a line break."""
    title = F.concat(F.lit(V.FILE_HEADER), file["path"], file["tag"])
    hunks = file["hunks"]
    artifact_title = F.concat(title, F.format_string(V.ARTIFACT_NOTE, file["added"], file["removed"]))
    shown = F.replace(
        rstrip_lines(_first_lines(F.get(hunks, 0), limits.artifact_lines)),
        F.lit("\n"),
        F.lit("\n" + V.ARTIFACT_INDENT),
    )
    artifact = F.when(
        F.size(hunks) > 0, F.concat(artifact_title, shown, F.lit("\n" + V.ARTIFACT_END))
    ).otherwise(artifact_title)

    def with_hunks(text_of: Callable[[Column, Limits], Column]) -> Column:
        return F.array_join(F.concat(F.array(title), _texts(hunks, lambda h: text_of(h, limits))), "")

    return (
        F.when(file["kind"] == "noise", F.concat(title, F.lit(V.NOISE_NOTE)))
        .when(file["kind"] == "artifact", artifact)
        .when(file["kind"] == "log", with_hunks(_log_text))
        .otherwise(with_hunks(_code_text))
    )


def condensed_text(files: Column, limits: Limits = Limits()) -> Column:
    whole = F.array_join(F.transform(files, lambda f: _file_text(f, limits)), "\n")
    if limits.max_chars is None:
        return whole
    return let(
        whole,
        lambda text: F.when(
            F.length(text) > limits.max_chars,
            F.concat(F.left(text, F.lit(limits.max_chars)), F.lit(V.TOO_LONG_END)),
        ).otherwise(text),
    )


def condensed_diff(
    diff: Column, files: Column, error: Column | None = None, limits: Limits = Limits()
) -> Column:
    """Condensed text of a raw diff, given its files as read by ``read_files``."""
    cut = diff if limits.max_broken_chars is None else F.left(diff, F.lit(limits.max_broken_chars))
    result = F.when(strip(diff) == "", V.EMPTY_DIFF).when(
        is_broken(diff, files), F.concat(cut, F.lit(V.BROKEN_END))
    ).otherwise(condensed_text(files, limits))
    if error is not None:
        result = F.when(error.isNotNull(), F.format_string(V.FETCH_ERROR, error)).otherwise(result)
    return result
