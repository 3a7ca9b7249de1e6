"""Secret scanning: candidates from the words of a text, judged by a random forest that removes false positives.

Candidates, features and forest are column functions, joins and Spark's own tree learner.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import let, stored, words
from commitgauge.operators.joins import hot_join

#: What a candidate looks like, and words that name credentials or harmless identifiers.
RUN = r"[A-Za-z0-9+/_-]{12,}"
#: Marks that end a value within a word, and what stands between a name and its value; a value may be cut by other marks.
MARK, LINK, LOOK_BACK = r"[\"'`=:,;&?|<>(){}\[\]]", r"^[\"'`\])]*[=:]>?[\"'`\[({]*$", 4
CREDENTIAL = r"(?i)pass(word|wd|phrase)?|secret|token|api_?key|access_?key|auth|bearer|credential|private_?key"
HARMLESS = r"(?i)commit|sha\d*|md5|hash|checksum|uuid|guid|order|invoice|phone|tel|isbn|card|version"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|eyJ)"
TEST_PATH = r"(?i)test|example|sample|fixture|mock|doc"
CONFIG_PATH = r"(?i)\.(env|ini|cfg|conf|json|ya?ml|toml|properties|pem|key)$|config|secret"
FEATURES = (
    "length", "transitions", "digit_share", "upper_share", "lower_share", "symbol_share", "distinct_share", "is_hex",
    "coverage", "known_prefix", "assigned", "quoted", "credential_near", "harmless_near", "path_depth", "path_test",
    "path_config",
)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def candidates(docs: DataFrame, id_col: str = "doc_id", path_col: str = "source") -> DataFrame:
    """Rows (doc_id, word_index, run_index, value, ahead, quoted, leads, before, after, path): every run of 12 or more
    characters of keys with a digit in it, numbered among all runs of its word.

    ahead: the text just before the run, from the last mark within the word on, with the run ahead of that if the mark
    assigns to it. leads: no mark stands between the word's start and the run, so the words ahead of the word are just
    before it as well. before: those three words if it leads, else `ahead`. after: the next word for the word's last run.
    So the rows of a word together are as long as the word, apart from a fixed factor.
    """

    def found(all_words: Column) -> Column:
        def seen(w: Column, i: Column) -> Column:
            near = F.array_join(F.slice(all_words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
            hit = (F.length(w) >= 12) & w.rlike("[0-9]") & w.rlike(RUN)
            return F.when(
                hit,
                F.struct(i.alias("i"), w.alias("word"), near.alias("before"), F.get(all_words, i + 1).alias("after")),
            )

        return F.filter(F.transform(all_words, seen), lambda s: s.isNotNull())

    def each_run(runs: Column) -> Column:
        """`between` has one text more than there are runs: what stands ahead of each, and behind the last."""

        def of_between(between: Column) -> Column:
            def placed(value: Column, k: Column) -> Column:
                back = F.sequence(k, F.greatest(k - LOOK_BACK, F.lit(0)), F.lit(-1))
                marked = F.filter(back, lambda i: (i == 0) | F.get(between, i).rlike(MARK))
                base = F.coalesce(F.get(marked, 0), k)
                name = F.when(F.get(between, base).rlike(LINK), F.get(runs, base - 1))
                return F.struct(
                    k.alias("run_index"), value.alias("value"),
                    F.concat(F.coalesce(name, F.lit("")), F.get(between, base)).alias("ahead"),
                    F.get(between, k).rlike("[\"'`]$").alias("quoted"),
                    (base == 0).alias("leads"), (k == F.size(runs) - 1).alias("is_last"),
                )

            return F.filter(F.transform(runs, placed), lambda r: r["value"].rlike("[0-9]"))

        return let(F.split("s.word", RUN, -1), of_between)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.explode(let(words(F.col("text")), found)).alias("s"))
    each = let(F.regexp_extract_all("s.word", F.lit(RUN), F.lit(0)), each_run)
    rows = rows.select("doc_id", "path", F.col("s.i").alias("word_index"), "s.before", "s.after", F.inline(each))
    return rows.select(
        "doc_id", "word_index", "run_index", "value", "ahead", "quoted", "leads",
        F.when(F.col("leads"), F.col("before")).otherwise(F.col("ahead")).alias("before"),
        F.when(F.col("is_last"), F.coalesce("after", F.lit(""))).otherwise(F.lit("")).alias("after"),
        F.coalesce("path", F.lit("")).alias("path"),
    )


def dictionary(docs: DataFrame, least: int = 5) -> DataFrame:
    """Words of three or more ASCII letters that occur `least` times or more, in lower case, over all texts."""
    each = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).filter(F.length("w") >= 3)
    return each.groupBy("w").count().filter(F.col("count") >= least).select("w")


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with their features; coverage is the share of characters in letter runs that are in the dictionary."""
    value = F.col("value")
    rows = found.withColumn(
        "cid", F.xxhash64("doc_id", "word_index", "run_index", "value", "before", "after", "path")
    )
    parts = rows.select("cid", F.explode(F.array_distinct(F.split(F.lower("value"), r"[^a-z]+"))).alias("w")).filter("length(w) >= 3")
    parts = parts.distinct()
    counts = parts.groupBy("w").agg(F.count("*").alias("n"))
    covered = hot_join(parts, known, "w", ["cid"], counts, parts.count()).groupBy("cid").agg(F.sum(F.length("w")).alias("covered"))
    rows = rows.join(covered, "cid", "left")
    classes = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[+/_-]+", "_"
    )
    flag = lambda c: c.cast("double")
    ahead = F.col("ahead")
    return rows.select(
        "doc_id", "word_index", "run_index", "value", "before", "path",
        F.length(value).cast("double").alias("length"),
        ((F.length(classes) - 1) / F.length(value)).alias("transitions"),
        _share(value, "[0-9]").alias("digit_share"),
        _share(value, "[A-Z]").alias("upper_share"),
        _share(value, "[a-z]").alias("lower_share"),
        _share(value, "[+/_-]").alias("symbol_share"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct_share"),
        flag(value.rlike("^[0-9a-fA-F]+$")).alias("is_hex"),
        F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.length(value)).alias("coverage"),
        flag(value.rlike(PREFIX)).alias("known_prefix"),
        flag(ahead.rlike("[=:]") | (F.col("leads") & F.col("before").rlike(r"(^|\s)(=|:|:=|=>)$|[=:]$"))).alias("assigned"),
        flag(F.col("quoted")).alias("quoted"),
        flag(ahead.rlike(CREDENTIAL) | F.col("before").rlike(CREDENTIAL)).alias("credential_near"),
        flag(F.concat_ws(" ", "before", "after").rlike(HARMLESS)).alias("harmless_near"),
        F.size(F.split("path", "/")).cast("double").alias("path_depth"),
        flag(F.col("path").rlike(TEST_PATH)).alias("path_test"),
        flag(F.col("path").rlike(CONFIG_PATH)).alias("path_config"),
    )


def scan(
    docs: DataFrame,
    label: Column,
    may_learn: Column,
    max_labelled: int = 20_000,
    trees: int = 20,
    depth: int = 6,
    threshold: float = 0.5,
    seed: int = 13,
    **columns,
) -> DataFrame:
    """Rows (doc_id, word_index, run_index, value, the features, score, is_secret), one a candidate of every whole text.

    `label` gives 1.0 or 0.0 for a finding with a verdict and NULL for others, over the columns of `featured`;
    `may_learn` says which findings may be learned from. The forest learns from `max_labelled` of them at most, first in
    the order of a hash. A text that is missing, empty or without a candidate has no row; repeated rows give repeated
    findings; a missing id stays missing. Where the labels hold one class or none, the score is that class's share.
    """
    found = stored(candidates(docs, **columns), "secrets-candidates")
    rows = stored(featured(found, dictionary(docs)), "secrets-findings")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    labelled = rows.withColumn("label", label).filter(F.col("label").isNotNull() & may_learn)
    labelled = labelled.orderBy(F.xxhash64("doc_id", "word_index", "value"), "value", "run_index").limit(max_labelled)
    labelled = stored(labelled.select("features", "label"), "secrets-labelled")
    classes = {r["label"] for r in labelled.select("label").distinct().collect()}
    if classes == {0.0, 1.0}:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability")
        rows = forest.fit(labelled).transform(rows)
        rows = rows.withColumn("score", F.get(vector_to_array("probability"), 1))
    else:
        rows = rows.withColumn("score", F.lit(max(classes, default=0.0)))
    rows = rows.select("doc_id", "word_index", "run_index", "value", *FEATURES, F.round("score", 6).alias("score"))
    return rows.withColumn("is_secret", F.col("score") >= threshold)
