"""Registered queries: every operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgauge.checks import adapters as V
from commitgauge.functions import text as X
from commitgauge.functions.diffs import line_kind
from commitgauge.operators import (
    activity,
    batches,
    bayes,
    commits,
    concentration,
    density,
    diff_parts,
    diffs,
    focus,
    labels,
    packages,
    predictions,
    sampling,
    scoring,
    sketches,
    trends,
)
from commitgauge.plans import history
from commitgauge.plans.answers import library_focus, scored_answers
from commitgauge.sources.sinks import llm_requests, tuning_examples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

INSTRUCTION = "Classify the commit and answer in JSON."
FREQUENT_WORDS = ("tion", "leau")
PAIRS = tuple((f"NATION-{i}", f"NATION-{i + 5}") for i in range(5))
LIBRARY_YEAR = ("language", "repo", "year")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.commits_v(spark, sf, stats=True)
    return rows.withColumn(
        "ccs_score",
        scoring.S.ccs_score(F.col("complexity"), F.col("entropy"), F.col("churn")),
    )


# ---- focus --------------------------------------------------------------------------


@query
def avg_ccs_by_category(spark, sf):
    return rounded(scoring.avg_ccs(scored(spark, sf)), "avg_ccs")


@query
def category_counts(spark, sf):
    return focus.category_counts(V.commits_v(spark, sf))


@query
def repo_category_counts(spark, sf):
    return focus.repo_category_counts(V.commits_v(spark, sf))


@query
def category_share_language(spark, sf):
    return rounded(focus.category_share_by_language(V.commits_v(spark, sf)), "share")


@query
def category_share_library(spark, sf):
    return rounded(focus.category_share_by_library(V.commits_v(spark, sf)), "share")


@query
def domain_delta(spark, sf):
    return rounded(focus.domain_delta(V.commits_v(spark, sf)), "c", "rust", "delta")


@query
def memory_ratio(spark, sf):
    return rounded(focus.memory_share_ratio(V.commits_v(spark, sf)), "c", "rust", "ratio")


@query
def top_categories(spark, sf):
    return focus.top_categories(V.commits_v(spark, sf), 3)


@query
def category_by_year_top(spark, sf):
    return rounded(focus.category_by_year(V.commits_v(spark, sf), 3), "share")


# ---- activity -----------------------------------------------------------------------


@query
def net_loc_summary(spark, sf):
    return activity.net_loc_summary(V.commits_v(spark, sf, stats=True))


@query
def cumulative_net_loc(spark, sf):
    rows = activity.cumulative_net_loc(V.commits_v(spark, sf, stats=True))
    return rows.withColumn("day", F.col("day").cast("string"))


@query
def cumulative_net_loc_strict(spark, sf):
    rows = activity.cumulative_net_loc(V.commits_v(spark, sf, stats=True), strict_nulls=True)
    return rows.withColumn("day", F.col("day").cast("string"))


@query
def yearly_net_loc(spark, sf):
    return activity.yearly_net_loc(V.commits_v(spark, sf, stats=True))


@query
def pair_net_loc(spark, sf):
    return activity.pair_yearly_net_loc(V.commits_v(spark, sf, stats=True), PAIRS)


@query
def contributors_by_language(spark, sf):
    return activity.contributors(V.commits_v(spark, sf), "language")


@query
def contributors_from_sketches(spark, sf):
    """Contributors by language and year, united from sketches stored per library and month."""
    stored = sketches.author_sketches(V.commits_v(spark, sf))
    return sketches.contributors_from(stored, ["language", "year"]).select("language", "year", "contributors")


@query
def contributors_by_library(spark, sf):
    return activity.contributors(V.commits_v(spark, sf), "repo")


@query
def commits_by_library_year(spark, sf):
    return activity.commits_by_library_year(V.commits_v(spark, sf))


@query
def traffic(spark, sf):
    return rounded(activity.traffic(V.commits_v(spark, sf)), "commits_per_contributor", "log_commits")


@query
def commit_frequency(spark, sf):
    return rounded(activity.commit_frequency(V.commits_v(spark, sf)), "frequency", "log10_frequency")


@query
def churn_by_year(spark, sf):
    return rounded(activity.churn(V.commits_v(spark, sf, stats=True)), "avg_churn_per_commit")


@query
def churn_by_library_year(spark, sf):
    return rounded(activity.churn(V.commits_v(spark, sf, stats=True), "repo"), "avg_churn_per_commit")


@query
def changes_daily(spark, sf):
    rows = activity.changes_daily(V.commits_v(spark, sf, stats=True))
    return rows.withColumn("day", F.col("day").cast("string"))


@query
def revisions_per_change(spark, sf):
    changes = activity.changes_daily(V.commits_v(spark, sf, stats=True))
    return rounded(activity.revisions_per_change(changes), "avg_revisions")


@query
def revisions_per_file_change(spark, sf):
    rows = V.file_change_rows(spark, sf)
    changes = activity.changes_by_file(V.file_changes_v(spark, sf, rows), rows=rows)
    return rounded(activity.revisions_per_change(changes), "avg_revisions")


@query
def commits_by_year(spark, sf):
    return activity.commits_by_year(V.commits_v(spark, sf))


@query
def commits_by_author_year(spark, sf):
    return activity.commits_by_author_year(V.commits_v(spark, sf))


@query
def api_commits_by_author_year(spark, sf):
    timed = commits.api_commit_times(V.api_commits_v(spark, sf))
    return activity.commits_by_author_year(timed, "author_name", "author_email")


@query
def yearly_activity(spark, sf):
    return rounded(activity.yearly_activity(V.commits_v(spark, sf)), "commits_per_maintainer")


@query
def activity_join(spark, sf):
    rows = V.commits_v(spark, sf)
    maintainers = activity.maintainers_by_year(activity.author_year_counts(rows))
    joined = activity.join_maintainers(activity.commits_by_year(rows), maintainers)
    return rounded(joined, "commits_per_maintainer")


@query
def library_order(spark, sf):
    return activity.library_order(V.commits_v(spark, sf))


@query
def commits_in_window(spark, sf):
    window = commits.date_window(V.commits_v(spark, sf), "1996-03-01", "1997-06-30")
    return focus.count_by(window, "language", "repo")


# ---- concentration ------------------------------------------------------------------


@query
def author_concentration(spark, sf):
    rows = concentration.author_concentration(V.commits_v(spark, sf), LIBRARY_YEAR)
    return rounded(rows, "top1_pct", "top3_pct", "top5_pct")


@query
def concentration_long(spark, sf):
    rows = concentration.author_concentration(V.commits_v(spark, sf), LIBRARY_YEAR)
    return rounded(concentration.concentration_long(rows, LIBRARY_YEAR), "percent")


@query
def gini_library_year(spark, sf):
    return rounded(concentration.gini_by(V.commits_v(spark, sf), LIBRARY_YEAR), "gini")


@query
def gini_language_year(spark, sf):
    return rounded(concentration.gini_by(V.commits_v(spark, sf), ("language", "year")), "gini")


@query
def gini_distribution(spark, sf):
    ginis = concentration.gini_by(V.commits_v(spark, sf), LIBRARY_YEAR)
    return rounded(concentration.gini_distribution(ginis), "q25", "q50", "q75")


@query
def gini_density(spark, sf):
    """The curve of the Gini violin by language: bandwidth nrd0, 512 points, three bandwidths beyond the data."""
    ginis = concentration.gini_by(V.commits_v(spark, sf), LIBRARY_YEAR)
    return rounded(density.density(ginis, "gini", ["language"], points=512, cut=3.0, rule="nrd0"), "x", "density", "bandwidth")


@query
def author_rank(spark, sf):
    return concentration.author_rank(V.commits_v(spark, sf), ("language", "year"))


@query
def author_rank_top(spark, sf):
    return concentration.author_rank(V.commits_v(spark, sf), ("language", "year"), top=5)


def author_years(spark, sf):
    return activity.author_year_counts(V.commits_v(spark, sf))


@query
def top_authors_ties(spark, sf):
    return concentration.top_authors(author_years(spark, sf), 20)


@query
def top_authors_latest(spark, sf):
    return concentration.top_authors_latest(author_years(spark, sf), 10)


@query
def contributor_heatmap(spark, sf):
    return concentration.contributor_heatmap(author_years(spark, sf), 20)


@query
def contributor_totals(spark, sf):
    return concentration.contributor_totals(author_years(spark, sf), 1999)


@query
def max_commits_order(spark, sf):
    return concentration.max_commits_order(author_years(spark, sf))


# ---- trends and packages ------------------------------------------------------------

MEASURES = ("commits", "maintainers", "commits_per_maintainer")


@query
def trend_tests(spark, sf):
    trend = trends.linear_trend(activity.yearly_activity(V.commits_v(spark, sf)), "year", MEASURES)
    return rounded(rounded(trend, "slope", "p_value"), "intercept", digits=4)


@query
def smooth_lines(spark, sf):
    series = activity.yearly_activity(V.commits_v(spark, sf)).select("year", "commits")
    return rounded(trends.fitted_line(series, "year", "commits", "fitted"), "fitted", digits=4)


@query
def fix_ratio_trend(spark, sf):
    rows = V.commits_v(spark, sf).withColumn("is_bug_fix", ~F.col("is_feature"))
    trend = trends.fix_ratio_trend(rows, by=("language",))
    return rounded(trend, "bug_fix_ratio", "trend_line")


@query
def first_last_change(spark, sf):
    return trends.first_last_change(activity.yearly_activity(V.commits_v(spark, sf)), MEASURES)


@query
def grouped_regression(spark, sf):
    fits = trends.grouped_regression(V.packages_v(spark, sf), "sourcerank", "dependents", ["language"])
    return rounded(rounded(fits, "slope", "r2", "slope_error", "p_value"), "intercept", digits=4)


@query
def degree_centrality(spark, sf):
    rows = packages.degree_centrality(V.edges_v(spark, sf))
    return rounded(rows, "in_degree_centrality", "out_degree_centrality")


@query
def top_packages(spark, sf):
    metrics = packages.degree_centrality(V.edges_v(spark, sf)).withColumnRenamed("node", "package")
    return rounded(
        packages.top_packages(metrics, 10), "in_degree_centrality", "out_degree_centrality"
    )


@query
def central_package_docs(spark, sf):
    """Centrality of every node beside the community figures of those that are packages."""
    metrics = packages.degree_centrality(V.edges_v(spark, sf)).withColumnRenamed("node", "package")
    rows = packages.join_package_docs(metrics, packages.fill_package_docs(V.package_docs_v(spark, sf)))
    return rounded(rows, "in_degree_centrality", "out_degree_centrality")


@query
def package_join(spark, sf):
    docs = packages.fill_package_docs(V.package_docs_v(spark, sf))
    metrics = V.packages_v(spark, sf).select("package", "sourcerank")
    return packages.join_package_docs(metrics, docs)


# ---- predictions --------------------------------------------------------------------


@query
def parse_predictions(spark, sf):
    return predictions.parse_predictions(V.responses_v(spark, sf))


@query
def unusable_answers(spark, sf):
    return focus.count_by(predictions.unusable_lines(V.responses_v(spark, sf)), "status")


@query
def scored_predictions(spark, sf):
    metadata = V.commits_v(spark, sf, stats=True)
    keys = ("language", "repo", "commit_id")
    rows = scored_answers(V.responses_v(spark, sf), metadata, keys, carry=("year",))
    return rounded(
        rows.select(*keys, "category", "complexity", "entropy", "churn", "ccs_score", "year"), "ccs_score"
    )


@query
def predicted_library_focus(spark, sf):
    return rounded(library_focus(V.responses_v(spark, sf)), "share")


@query
def maintenance_ccs_by_year(spark, sf):
    return rounded(scoring.maintenance_ccs_by_year(scored(spark, sf)), "avg_ccs_score")


@query
def maintenance_ccs_by_category_year(spark, sf):
    return rounded(scoring.maintenance_ccs_by_category_year(scored(spark, sf)), "avg_ccs_score")


@query
def maintenance_burden(spark, sf):
    return rounded(scoring.maintenance_burden(scored(spark, sf)), "burden", digits=4)


@query
def ccs_quartiles(spark, sf):
    return rounded(scoring.ccs_quartiles(scored(spark, sf)), "q25", "q50", "q75")


@query
def ccs_quartiles_by_year_sketched(spark, sf):
    """Quartiles of the complexity score by language and year, from KLL sketches stored per library and day."""
    stored = sketches.value_sketches(scored(spark, sf), "ccs_score")
    return sketches.quantiles_from(stored.withColumn("year", F.year("day")), ["language", "year"])


@query
def ccs_density(spark, sf):
    """The curve of the complexity violin by language: Scott's bandwidth, 100 points, two bandwidths beyond the data."""
    curve = density.density(scored(spark, sf), "ccs_score", ["language"], points=100, cut=2.0, rule="scott")
    return rounded(curve, "x", "density", "bandwidth")


@query
def plus_one_scores(spark, sf):
    keys = ["language", "repo", "commit_id"]
    rows = V.commits_v(spark, sf, stats=True)
    marks = rows.select(*keys, "category", "complexity")
    return rounded(
        scoring.score_predictions(marks, rows, keys, plus_one=True).select(*keys, "ccs_score"), "ccs_score"
    )


@query
def later_known_commits(spark, sf):
    """Commits with author and complexity after 1995, from pages under their older names."""
    rows = V.commits_v(spark, sf).select(
        "commit_id", "language", "repo", F.col("author").alias("author_name"), F.col("date").alias("authored_datetime"),
        "year", "complexity",
    )
    pages = [rows.where(F.col("language") == "c"), rows.where(F.col("language") == "rust").drop("complexity")]
    known = commits.drop_null_keys(commits.rename_older(commits.concat_pages(pages, rows.schema, rows)), "author")
    later = commits.year_after(known, 1995)
    return later.select("commit_id", "author", F.to_date("date").cast("string").alias("day"), "complexity")


@query
def interesting_documents(spark, sf):
    """Documents with one of the default words."""
    docs = V.table(spark, sf, "documents")
    hit = X.is_interesting(F.col("text"), F.col("text"))
    return docs.select("doc_id", hit.alias("interesting"))


@query
def library_summary(spark, sf):
    return scoring.library_summary(V.commits_v(spark, sf))


# ---- labels -------------------------------------------------------------------------


@query
def clean_labels(spark, sf):
    rows = labels.clean_labels(V.labels_v(spark, sf))
    return rows.select(
        "commit_id", "message", "diff_preview", "cat", "feat", "sec", "comp", "reas"
    )


@query
def tuning_rows(spark, sf):
    """Training examples read back from their own JSON."""
    rows = tuning_examples(V.labels_v(spark, sf), INSTRUCTION)
    turns = F.col("contents")
    answer = turns[1]["parts"][0]["text"]
    return rows.select(
        F.col("systemInstruction.parts")[0]["text"].alias("instruction"),
        turns[0]["role"].alias("first_role"),
        turns[0]["parts"][0]["text"].alias("user_text"),
        F.get_json_object(answer, "$.cat").alias("cat"),
        F.get_json_object(answer, "$.feat").alias("feat"),
        F.get_json_object(answer, "$.comp").alias("comp"),
        F.get_json_object(answer, "$.reas").alias("reas"),
    )


@query
def synthetic_ids(spark, sf):
    rows = labels.tail_rewrite(V.labels_v(spark, sf), "file", "ordinal", n=3)
    return rows.select("file", "ordinal", "commit_id", "is_synthetic_commit_id")


@query
def merge_labels(spark, sf):
    rows = V.labels_v(spark, sf).drop("language_inferred", "n_chars")
    extra = rows.where(F.col("ordinal") % 2 == 1).drop("label_reasoning")
    merged = labels.merge_labeled(
        {"C": rows.where(F.col("ordinal") % 2 == 0), "Rust": extra, "Missing": None}
    )
    return merged.select("commit_id", "language_inferred", "label_category", "label_reasoning")


@query
def label_counts(spark, sf):
    return labels.label_counts(V.labels_v(spark, sf))


@query
def reason_summary(spark, sf):
    return labels.reason_summary(V.labels_v(spark, sf))


@query
def reasons_by_label(spark, sf):
    rows = labels.reasons_by_label(V.labels_v(spark, sf))
    return rows.select("commit_id", "label_category", "label_reasoning", "total", "missing", "is_missing")


@query
def gold_vs_model(spark, sf):
    return labels.gold_vs_model(V.gold_v(spark, sf), V.model_v(spark, sf))


@query
def gold_vs_model_trimmed(spark, sf):
    return labels.gold_vs_model(V.gold_v(spark, sf), V.model_v(spark, sf), trim=True)


AGREEMENT = (
    "category_agreement", "security_agreement", "feature_agreement", "complexity_agreement",
    "complexity_within_one", "complexity_mae", "complexity_bias",
)


@query
def label_agreement(spark, sf):
    compared = labels.gold_vs_model(V.gold_v(spark, sf), V.model_v(spark, sf))
    return rounded(labels.agreement(compared), *AGREEMENT)


@query
def confusion(spark, sf):
    return labels.confusion(labels.gold_vs_model(V.gold_v(spark, sf), V.model_v(spark, sf)))


@query
def category_totals(spark, sf):
    return labels.category_totals(labels.gold_vs_model(V.gold_v(spark, sf), V.model_v(spark, sf)))


@query
def category_kappa(spark, sf):
    compared = labels.gold_vs_model(V.gold_v(spark, sf), V.model_v(spark, sf))
    return rounded(labels.category_kappa(compared), "observed", "chance", "kappa")


@query
def majority_vote(spark, sf):
    return labels.majority_vote(V.votes_v(spark, sf))


# ---- diffs --------------------------------------------------------------------------


@query
def line_counts(spark, sf):
    return diffs.add_loc(V.diffs_v(spark, sf), "diff_raw", drop=("message", "diff_raw", "author"))


@query
def diff_lines(spark, sf):
    rows = diffs.explode_diff_lines(V.diffs_v(spark, sf))
    return rows.groupBy("commit_id", "file_no", "hunk_no", "path", "kind").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("line_no").alias("last_line"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query
def diff_lines_from_parts(spark, sf):
    """diff_lines from diffs stored as parts of 256 lines: a segmented scan instead of one row a diff."""
    parts = diff_parts.cut_into_parts(V.diffs_v(spark, sf))
    lines = diff_parts.lines_of_parts(parts).groupBy("commit_id", "file_no", "hunk_no", "kind").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("line_no").cast("int").alias("last_line"),
        F.sum(F.length("text")).alias("n_chars"),
    )
    paths = diff_parts.file_paths(parts)
    joined = lines.alias("l").join(paths.alias("p"), F.col("l.commit_id").eqNullSafe(F.col("p.commit_id")) & (F.col("l.file_no") == F.col("p.file_no")))
    return joined.select(
        "l.commit_id", F.col("l.file_no").cast("int").alias("file_no"), F.col("l.hunk_no").cast("int").alias("hunk_no"),
        "p.path", "l.kind", "l.n_lines", "l.last_line", "l.n_chars",
    )


@query
def commit_stats(spark, sf):
    return diffs.commit_stats(V.diffs_v(spark, sf)).select("commit_id", "entropy", "churn")


@query
def file_changes(spark, sf):
    rows = diffs.split_file_chunks(V.diffs_v(spark, sf), "diff_raw", drop=("message", "author"))
    return rows


@query
def file_kinds(spark, sf):
    return diffs.list_files(V.diffs_v(spark, sf))


@query
def condensed_diff(spark, sf):
    rows = diffs.condense_diffs(V.diffs_v(spark, sf))
    return rows.select("commit_id", "diff")


@query
def condensed_history(spark, sf):
    """Size figures and condensed diff from one reading."""
    return history.condensed_commits(V.diffs_v(spark, sf)).select("commit_id", "entropy", "churn", "message", "diff")


@query
def truncation_ratio(spark, sf):
    rows = diffs.condense_diffs(V.diffs_v(spark, sf))
    return rounded(diffs.truncation_ratio(rows, by=("language",)), "reduction")


@query
def request_rows(spark, sf):
    """Classifier requests on condensed diffs, read back from their own JSON."""
    condensed = diffs.condense_diffs(V.diffs_v(spark, sf))
    rows = llm_requests(commits.sanitize_commits(condensed), INSTRUCTION)
    json = rows.select(F.to_json(F.struct("*")).alias("line"))
    return json.select(
        F.get_json_object("line", "$.key").alias("key"),
        F.get_json_object("line", "$.request.systemInstruction.parts[0].text").alias("instruction"),
        F.get_json_object("line", "$.request.contents[0].parts[0].text").alias("text"),
    )


# ---- sampling and model -------------------------------------------------------------


@query
def gold_sample(spark, sf):
    rows = V.diffs_v(spark, sf).withColumnRenamed("diff_raw", "diff")
    sample = sampling.gold_sample(rows, frac=0.1, cap=12, words=FREQUENT_WORDS)
    return sample.select("language", "repo", "commit_id", "sample_rank", "is_random")


@query
def holdout_split(spark, sf):
    return sampling.holdout_split(V.commits_v(spark, sf)).select("commit_id", "split")


@query
def classify_documents(spark, sf):
    """A classifier trained on the labelled documents, applied to all of them."""
    docs, known = labelled(spark, sf)
    return bayes.classify(bayes.train_naive_bayes(docs.join(known, "doc_id")), docs, "doc_id")


@query
def classify_documents_in_shards(spark, sf):
    """classify_documents through the ledger of shards: a rerun of the same tables and model goes on where it stopped."""
    docs, known = labelled(spark, sf)
    model = bayes.train_naive_bayes(docs.join(known, "doc_id"))
    folder = f"{batches.shared_folder(spark)}/classified-{batches.run_name('classify_documents', 'staged', sf)}"
    return batches.classify_in_shards(model, docs, "doc_id", folder).select("doc_id", "predicted")


@query
def classifier_holdout(spark, sf):
    """Right answers of a classifier trained on the training part alone, in both parts."""
    docs, known = labelled(spark, sf)
    known = sampling.holdout_split(known, "doc_id")
    fitted = bayes.train_naive_bayes(docs.join(known.where("split = 'train'"), "doc_id"))
    answers = bayes.classify(fitted, docs, "doc_id").join(known, "doc_id")
    return answers.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("correct")
    )


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return docs, V.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))


# ---- scalar functions ---------------------------------------------------------------


@query
def text_functions(spark, sf):
    """Column functions over whole documents."""
    docs = V.table(spark, sf, "documents")
    k, text = F.col("doc_id"), F.col("text")
    framed = F.concat(F.lit("\r\n\t "), text, F.lit(" \r\n"))
    return docs.select(
        "doc_id",
        X.sanitize_text(text).alias("sanitized"),
        X.clean_text(framed).alias("cleaned"),
        X.clean_reasoning(framed).alias("reasoning"),
        X.strip_markdown_fence(F.concat(F.lit("```json\n"), text, F.lit("\n```"))).alias("bare"),
        X.is_interesting(text, text, FREQUENT_WORDS, "unsafe").alias("interesting"),
        X.normalize_predicted_category(text).alias("category"),
        X.as_logical(V.pick(("T", "false", "no"), k)).alias("logical"),
        X.synthetic_id(k.cast("string"), F.col("source")).alias("synthetic"),
        X.fill_author(F.when(k % 5 != 0, F.col("source"))).alias("author"),
        X.domain_of(V.pick(("libxml2", "hyper", "sqlite", "other"), k)).alias("domain"),
        line_kind(text).alias("kind"),
    )
