"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


COMMITS = T.StructType(
    _strings("commit_id", "message", "diff", "author")
    + [
        T.StructField("date", T.TimestampType()),
        T.StructField("entropy", T.IntegerType()),
        T.StructField("churn", T.LongType()),
    ]
)

# Older extracts carry other column names and the raw diff.
OLDER_COMMITS = T.StructType(
    _strings("commit_id", "message", "diff", "author_name")
    + [T.StructField("authored_datetime", T.TimestampType())]
)

ENRICHED_COMMITS = T.StructType(
    COMMITS.fields
    + _strings("repo", "language")
    + [T.StructField(n, T.LongType()) for n in ("lines_added", "lines_removed", "net_lines")]
)

FILE_CHANGES = T.StructType(
    _strings("commit_id", "language", "repo", "author")
    + [T.StructField("date", T.TimestampType())]
    + _strings("file")
    + [T.StructField(n, T.LongType()) for n in ("lines_added", "lines_removed")]
)

_TURN = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StructType(_strings("text")))),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField(
            "request",
            T.StructType(
                [
                    T.StructField("systemInstruction", _TURN),
                    T.StructField("contents", T.ArrayType(_TURN)),
                ]
            ),
        ),
        T.StructField("key", T.StringType()),
    ]
)

TUNING_EXAMPLES = T.StructType(
    [
        T.StructField("systemInstruction", _TURN),
        T.StructField("contents", T.ArrayType(_TURN)),
    ]
)

MODEL_ANSWER = T.StructType(
    [
        T.StructField("cat", T.StringType()),
        T.StructField("feat", T.BooleanType()),
        T.StructField("sec", T.BooleanType()),
        T.StructField("comp", T.IntegerType()),
        T.StructField("reas", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField(
                        "candidates",
                        T.ArrayType(T.StructType([T.StructField("content", _TURN)])),
                    )
                ]
            ),
        ),
    ]
)

PREDICTIONS = T.StructType(
    _strings("language", "repo", "commit_id", "category")
    + [
        T.StructField("is_feature", T.BooleanType()),
        T.StructField("is_security", T.BooleanType()),
        T.StructField("complexity", T.IntegerType()),
        T.StructField("reasoning", T.StringType()),
    ]
)

SCORED = T.StructType(
    PREDICTIONS.fields
    + [
        T.StructField("entropy", T.IntegerType()),
        T.StructField("churn", T.LongType()),
        T.StructField("ccs_score", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
    ]
)

GOLD_LABELS = T.StructType(
    _strings(
        "commit_id", "message", "entropy", "churn", "label_category", "label_is_security",
        "label_is_feature", "label_complexity", "label_reasoning", "diff_preview",
    )
)
MERGED_GOLD_LABELS = T.StructType(
    GOLD_LABELS.fields + _strings("is_synthetic_commit_id", "language_inferred")
)

GOLD_VS_MODEL = T.StructType(
    [
        T.StructField("commit_id", T.StringType()),
        T.StructField("category_match", T.BooleanType()),
        *_strings("label_category", "model_category"),
        T.StructField("is_security_match", T.BooleanType()),
        *_strings("label_is_security", "model_is_security"),
        T.StructField("is_feature_match", T.BooleanType()),
        *_strings("label_is_feature", "model_is_feature"),
        T.StructField("complexity_match", T.BooleanType()),
        *_strings("label_complexity", "model_complexity"),
    ]
)

API_COMMITS = T.StructType(
    _strings(
        "id", "short_id", "title", "author_name", "author_email", "authored_date",
        "committed_date", "committer_name", "committer_email", "web_url",
    )
)

CLASSIFIED_SERIES = T.StructType(
    [
        T.StructField("authored_datetime", T.TimestampType()),
        T.StructField("is_bug_fix", T.BooleanType()),
        *_strings("category", "author_name"),
    ]
)

PACKAGE_METRICS = T.StructType(
    [
        T.StructField("package", T.StringType()),
        T.StructField("in_degree_centrality", T.DoubleType()),
        T.StructField("out_degree_centrality", T.DoubleType()),
    ]
)

PACKAGE_DOCS = T.StructType(
    [
        T.StructField("stars", T.LongType()),
        T.StructField("forks", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("contributions_count", T.LongType()),
    ]
)

PACKAGE_RANK = T.StructType(
    [
        T.StructField("sourcerank", T.IntegerType()),
        T.StructField("dependent_repositories_count", T.LongType()),
        T.StructField("Language", T.StringType()),
    ]
)
