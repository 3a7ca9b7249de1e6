"""Text, label and answer cleaning as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitgauge import fixed_values as V

# The same whitespace as ranges for a character class, without and with the line break.
BLANK = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = r"\n" + BLANK
WHITESPACE_RUN = f"[{WHITESPACE}]+"
FULL_TIME = (
    r"\A([0-9]{4})[-/. ]?([0-9]{2})[-/. ]?([0-9]{2})[T ]*([0-9]{2})[:. ]?([0-9]{2})[:. ]?([0-9]{2}(?:\.[0-9]+)?)"
    r" ?(Z|[+-][0-9]{2}:?[0-9]{2})?\z"
)
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Drop whitespace at both ends; ``trim`` alone only knows the space character."""
    return F.btrim(text, F.lit(V.PY_WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(V.PY_WHITESPACE))


def sanitize_text(text: Column) -> Column:
    """Valid UTF-8 with bad bytes replaced, and '' for NULL."""
    return F.coalesce(F.make_valid_utf8(text), F.lit(""))


def clean_text(text: Column) -> Column:
    return strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")))


def clean_reasoning(text: Column, max_words: int = V.REASONING_WORDS) -> Column:
    """One line; beyond ``max_words`` words only those words and an ellipsis."""
    line = F.replace(clean_text(text), F.lit("\n"), F.lit(" "))

    def shortened(line: Column) -> Column:
        # One word more than kept is enough to see that there are more; the rest stays unsplit.
        words = F.split(line, WHITESPACE_RUN, max_words + 1)
        kept = F.array_join(F.slice(words, 1, max_words), " ")
        return F.when(F.size(words) > max_words, F.concat(kept, F.lit("..."))).otherwise(line)

    return let(line, shortened)


def normalize_label_category(raw: Column) -> Column:
    """Hand-made label to one of the five categories; unknown text counts as build work."""
    by_alias = F.create_map(
        *[F.lit(x) for alias, category in V.LABEL_ALIASES.items() for x in (alias.lower(), category)]
    )
    label = strip(F.coalesce(raw, F.lit("")))
    return F.coalesce(
        F.element_at(by_alias, F.lower(label)),
        F.when(label.isin(*V.CATEGORIES), label),
        F.lit(V.BUILD),
    )


def normalize_predicted_category(raw: Column) -> Column:
    """Classifier text to one of the five categories; the first needle list that hits wins."""
    text = strip(F.lower(raw))
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for category in V.CATEGORIES:
        result = result.when(text == category.lower(), category)
    for category, needles in V.PREDICTION_NEEDLES:
        result = result.when(text.rlike("|".join(needles)), category)
    return result.otherwise(V.LOGIC)


def parse_bool(raw: Column) -> Column:
    return F.coalesce(strip(F.upper(raw)).isin(*V.LABEL_TRUE), F.lit(False))


def as_logical(raw: Column) -> Column:
    """True and false words to booleans, everything else to NULL."""
    return F.when(raw.isin(*V.LOGICAL_TRUE), True).when(raw.isin(*V.LOGICAL_FALSE), False)


def label_complexity(raw: Column) -> Column:
    """Number text truncated to an integer, 1 when it is not a number; not clamped."""
    text = strip(raw)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.coalesce(number.try_cast("long"), F.lit(1))


def is_missing_text(raw: Column) -> Column:
    return raw.isNull() | (strip(raw) == "")


def model_input(language: Column, message: Column, diff: Column) -> Column:
    return F.format_string(V.MODEL_INPUT, language, message, diff)


def unique_key(language: Column, repo: Column, commit_id: Column) -> Column:
    return F.concat_ws("_", language, repo, commit_id)


def synthetic_id(commit_id: Column, salt: Column) -> Column:
    return F.sha1(F.format_string(V.SYNTHETIC_ID, salt, commit_id))


def is_interesting(
    message: Column,
    diff: Column,
    words: Sequence[str] = V.INTERESTING_WORDS,
    diff_word: str = V.INTERESTING_DIFF_WORD,
) -> Column:
    """Message holds one of ``words`` or diff holds ``diff_word``, without case; NULL is no hit."""
    in_message = F.coalesce(message.rlike("(?i)" + "|".join(words)), F.lit(False))
    in_diff = F.coalesce(F.contains(F.lower(diff), F.lit(diff_word.lower())), F.lit(False))
    return in_message | in_diff


def parse_key(key: Column) -> Column:
    """``language_repo_commit`` to its three parts; the commit part may hold underscores."""
    parts = F.split(key, "_", 3)
    whole = F.size(parts) == 3
    return F.struct(
        F.when(whole, F.get(parts, 0)).otherwise(V.UNKNOWN).alias("language"),
        F.when(whole, F.get(parts, 1)).otherwise(V.UNKNOWN).alias("repo"),
        F.when(whole, F.get(parts, 2)).otherwise(key).alias("commit_id"),
    )


def strip_markdown_fence(text: Column) -> Column:
    bare = F.replace(text, F.lit("```json"), F.lit(""))
    return strip(F.replace(bare, F.lit("```"), F.lit("")))


def work_type(category: Column) -> Column:
    return F.when(category == V.FEATURE, "Feature").otherwise("Maintenance")


def library_label(language: Column, repo: Column) -> Column:
    return F.concat(language, F.lit(V.LIBRARY_LABEL), repo)


def domain_of(repo: Column, domains: dict[str, str] | None = None) -> Column:
    """Functional domain of a project, NULL when it has none."""
    pairs = (domains or V.DOMAINS).items()
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), repo)


def fill_author(author: Column) -> Column:
    return F.coalesce(author, F.lit(V.UNKNOWN_AUTHOR))


def count_added(diff: Column) -> Column:
    """Added lines of a raw diff, without file headers, empty additions and hunk marks."""
    return F.regexp_count(diff, F.lit(V.ADDED_LINE)).cast("long")


def count_removed(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit(V.REMOVED_LINE)).cast("long")


def commit_timestamp(committed: Column, authored: Column) -> Column:
    """Commit time, or author time where there is none; NULL when it cannot be read.

    Read are full times from year to second in this order, with any usual signs between the parts or none, a
    fraction and a zone; a year, month or day alone is no time.
    """
    text = strip(F.coalesce(committed, authored))
    usual = F.regexp_replace(text, FULL_TIME, "$1-$2-$3 $4:$5:$6$7")
    return F.when(text.rlike(FULL_TIME), usual.try_cast("timestamp"))


def format_range(low: Column, high: Column) -> Column:
    return F.concat(low.cast("string"), F.lit("–"), high.cast("string"))


def percent_change(first: Column, last: Column) -> Column:
    return F.round(100 * (last - first) / first, 1)
