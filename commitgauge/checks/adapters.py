"""Commit-shaped views over the driver tables.

The driver tables hold no commits, so orders stand in for commits, line items
for file changes, and documents for diffs, labels and messages. Small sides
(nations, regions) are left to Spark, which knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.operators.joins import deal

PRIORITY_CATEGORIES = {
    "1-URGENT": V.MEMORY,
    "2-HIGH": V.CONCURRENCY,
    "3-MEDIUM": V.LOGIC,
    "4-NOT SPECIFIED": V.BUILD,
    "5-LOW": V.FEATURE,
}
RAW_LABELS = (" memory ", "Thread Safety", "Logic", "Maintenance", "feat", "Logic & Correctness", "???")
RAW_COMPLEXITIES = ("3.0", "3.7", "", "9", "abc")
ANSWER_CATEGORIES = (
    '"cat":"thread safety",', '"cat":"race fix",', '"cat":"perf",', '"cat":"CI",', '"cat":"xyz",',
    '"cat":null,', "", '"cat":"Memory Safety & Robustness",', '"cat":" build, refactor & internal ",',
    '"cat":"Feature & Value Add",', '"cat":"Concurrency & Thread Safety",',
)
ANSWER_COMPLEXITIES = (
    '"comp":3.7,', '"comp":"3",', '"comp":"3.7",', '"comp":null,', '"comp":true,',
    '"comp":9,', '"comp":0,', "", '"comp":4,',
)
ANSWER_FEATURES = ("true", '"True"', "1", '"yes"', "1.0", "null")
PATH_SUFFIXES = (".c", ".rs", ".lock", "/Makefile", "/ChangeLog", ".c", ".h", ".c", ".rs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Select computed columns so that later steps read them instead of computing them again."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def commits_v(spark: SparkSession, sf_dir: str, stats: bool = False) -> DataFrame:
    """All orders as commits. ``stats`` adds sizes from line items, at the price of a join."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    categories = F.create_map(*[F.lit(x) for kv in PRIORITY_CATEGORIES.items() for x in kv])
    named = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    category = F.element_at(categories, F.col("o_orderpriority"))
    columns = [
        F.col("o_orderkey").cast("string").alias("commit_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "c").otherwise("rust").alias("language"),
        F.replace("n_name", F.lit("_"), F.lit("-")).alias("repo"),
        F.when(F.col("r_name") != "MIDDLE EAST", F.col("r_name")).alias("domain"),
        F.when(F.col("o_custkey") % 97 != 0, F.col("c_name")).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.year("o_orderdate").alias("year"),
        category.alias("category"),
        (category == V.FEATURE).alias("is_feature"),
        (category == V.MEMORY).alias("is_security"),
        F.when(F.col("o_orderkey") % 101 != 0, (1 + F.col("o_orderkey") % 5).cast("int")).alias(
            "complexity"
        ),
        F.col("o_orderkey").alias("n"),
    ]
    if stats:
        sizes = (
            table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.count(F.lit(1)).alias("entropy"),
                F.sum("l_quantity").cast("long").alias("churn"),
                F.sum("l_linenumber").alias("lines_removed"),
            )
        )
        named = named.join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        columns += ["entropy", "churn", F.col("churn").alias("lines_added"), "lines_removed"]
    return named.select(*columns)


def file_change_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``file_changes_v``, up to line items without an order and orders that repeat, from the file footers."""
    return table(spark, sf_dir, "lineitem").count()


def file_changes_v(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """All line items as file changes; ``rows``, if known, deals them to as many tasks as their join needs."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file"),
        F.col("l_quantity").cast("long").alias("lines_added"),
        F.col("l_linenumber").cast("long").alias("lines_removed"),
    )
    commits = commits_v(spark, sf_dir).select("commit_id", "language", "repo", "author", "date", "n")
    joined = deal(commits, rows, "n").join(deal(items, rows, "l_orderkey"), F.col("n") == F.col("l_orderkey"))
    return joined.drop("n", "l_orderkey")


def diffs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as git diffs: changed lines, file kinds and states vary with the id.

    A line of text is a line of the diff; in every fifth document each word is one.
    """
    k = F.col("doc_id")
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text",
        F.when(k % 5 == 4, words).otherwise(F.split("text", "\n")).alias("lines"),
    )

    def body(line: Column, i: Column) -> Column:
        plain = F.get(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), i % 3)
        return F.concat(
            F.when(k % 7 == 0, F.lit("+use "))
            .when((k % 2 == 0) & (i >= 12), F.lit(" "))
            .otherwise(plain),
            line,
        )

    docs = docs.withColumn("body", F.transform("lines", body))

    def count(first: str) -> Column:
        return F.size(F.filter("body", lambda x: x.startswith(first)))

    path = F.concat(
        F.when(k % 9 == 5, "docs/").otherwise("src/"),
        "source",
        F.lit("/f"),
        k.cast("string"),
        pick(PATH_SUFFIXES, k),
    )
    docs = docs.withColumns({"path": path, "plus": count("+"), "minus": count("-"), "same": count(" ")})
    docs = docs.withColumn("target", F.when(k % 11 == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    first = F.concat(
        F.lit("diff --git a/"), "path", F.lit(" b/"), "target", F.lit("\n"),
        F.when(k % 11 == 0, "new file mode 100644\n").when(k % 11 == 1, "deleted file mode 100644\n").otherwise(""),
        F.when(k % 11 == 0, "--- /dev/null\n").otherwise(F.concat(F.lit("--- a/"), "path", F.lit("\n"))),
        F.when(k % 11 == 1, "+++ /dev/null\n").otherwise(F.concat(F.lit("+++ b/"), "target", F.lit("\n"))),
        F.lit("@@ -1,"),
        (F.col("same") + F.col("minus") + F.when(k % 29 == 3, 1).otherwise(0)).cast("string"),
        F.lit(" +1,"), (F.col("same") + F.col("plus")).cast("string"), F.lit(" @@\n"),
        F.array_join("body", "\n"), F.lit("\n"),
    )
    header = F.concat(F.lit("include/h"), k.cast("string"), F.lit(".h"))
    second = F.concat(
        F.lit("diff --git a/"), header, F.lit(" b/"), header, F.lit("\n--- a/"), header,
        F.lit("\n+++ b/"), header, F.lit("\n@@ -0,0 +1,"), F.size("lines").cast("string"), F.lit(" @@\n"),
        F.array_join(F.transform("lines", lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n"),
    )
    diff = (
        F.when(k % 37 == 5, F.lit(None).cast("string"))
        .when(k % 31 == 7, F.lit(" \n"))
        .otherwise(F.concat(first, F.when(k % 3 == 0, second).otherwise("")))
    )
    return settled(
        docs,
        k.cast("string").alias("commit_id"),
        F.when(k % 2 == 0, "c").otherwise("rust").alias("language"),
        F.col("source").alias("repo"),
        F.col("lang").alias("author"),
        F.col("text").alias("message"),
        diff.alias("diff_raw"),
    )


def labels_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as hand-made labels with the usual flaws, all text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return docs.select(
        k.cast("string").alias("commit_id"),
        F.concat(F.col("text"), F.lit("\r\n")).alias("message"),
        F.when(k % 10 != 9, pick(RAW_LABELS, k)).alias("label_category"),
        F.when(F.col("toxic") == 1, "TRUE").when(k % 3 == 0, "False").otherwise("0").alias("label_is_security"),
        F.when(F.col("quality") == 0, "FALSE ").when(k % 2 == 0, "TRUE").otherwise(" yes").alias("label_is_feature"),
        pick(RAW_COMPLEXITIES, k).alias("label_complexity"),
        F.when(k % 13 == 0, "  ").when(k % 11 != 0, F.col("text")).alias("label_reasoning"),
        F.concat(F.lit("\n"), F.col("text")).alias("diff_preview"),
        F.when(k % 2 == 0, "C").otherwise("Rust").alias("language_inferred"),
        F.col("source").alias("file"),
        k.alias("ordinal"),
        F.col("n_chars"),
    )


def model_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions of an imperfect model."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    c = F.col("n_chars")
    return docs.select(
        F.col("doc_id").cast("string").alias("commit_id"),
        F.when(c % 4 == 0, pick(V.CATEGORIES, c)).otherwise(V.BUILD).alias("model_category"),
        F.when((F.col("toxic") == 1) | (c % 9 == 0), "True").otherwise("False").alias("model_is_security"),
        F.when((F.col("quality") == 1) & (c % 3 != 0), "True").otherwise("False").alias("model_is_feature"),
        F.concat((1 + c % 5).cast("string"), F.lit(".0")).alias("model_complexity"),
    )


def gold_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as final labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return docs.select(
        k.cast("string").alias("commit_id"),
        F.when(k % 3 == 0, pick(V.CATEGORIES, k)).otherwise(V.BUILD).alias("label_category"),
        F.when(F.col("toxic") == 1, "TRUE").otherwise("False").alias("label_is_security"),
        F.when(F.col("quality") == 1, "TRUE").when(k % 2 == 0, "FALSE ").otherwise("FALSE").alias("label_is_feature"),
        (1 + k % 5).cast("string").alias("label_complexity"),
    )


def votes_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three votes per commit; priority is the order of the voters."""
    commits = commits_v(spark, sf_dir).select("commit_id", "category", "n")
    votes = F.array(
        F.struct(F.lit(1).alias("priority"), F.col("category").alias("label")),
        F.struct(F.lit(2).alias("priority"), F.when(F.col("n") % 3 == 0, V.LOGIC).otherwise(F.col("category")).alias("label")),
        F.struct(F.lit(3).alias("priority"), pick(V.CATEGORIES, F.col("n")).alias("label")),
    )
    return commits.select("commit_id", F.explode(votes).alias("vote")).select(
        "commit_id", "vote.priority", "vote.label"
    )


def responses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as classifier response lines with every kind of flaw."""
    commits = commits_v(spark, sf_dir)
    k = F.col("n")
    answer = F.concat(
        F.lit("{"),
        pick(ANSWER_CATEGORIES, k),
        pick(ANSWER_COMPLEXITIES, k),
        F.lit('"feat":'), pick(ANSWER_FEATURES, k),
        F.when(k % 5 != 0, F.concat(F.lit(',"reas":"r'), k.cast("string"), F.lit('"'))).otherwise(""),
        F.lit(',"sec":'), F.when(k % 2 == 0, '"1"').otherwise("false"),
        F.lit("}"),
    )
    flaw = k % 23
    text = (
        F.when(flaw == 3, '{"cat":')
        .when(flaw == 4, "[1]")
        .when(flaw == 6, F.concat(answer, F.lit(" ok thanks")))
        .when(flaw == 9, F.concat(F.lit('{"sec":null,'), F.substr(answer, F.lit(2))))
        .when(flaw == 7, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(answer)
    )
    escaped = F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    key = F.when(flaw == 5, "nokey").otherwise(F.concat_ws("_", "language", "repo", "commit_id"))
    head = F.concat(F.lit('{"key":"'), key, F.lit('"'))
    line = (
        F.when(flaw == 0, "  ")
        .when(flaw == 1, F.concat(head, F.lit(',"response":')))
        .when(flaw == 2, F.concat(head, F.lit(',"response":{"candidates":[]}}')))
        .when(flaw == 8, F.concat(head, F.lit("}")))
        .otherwise(
            F.concat(
                head,
                F.lit(',"response":{"candidates":[{"content":{"parts":[{"text":"'),
                escaped,
                F.lit('"}]}}]}}'),
            )
        )
    )
    return settled(commits, line.alias("value"))


def packages_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("package"),
        F.col("p_type").alias("language"),
        F.col("p_size").alias("sourcerank"),
        F.col("p_retailprice").alias("dependents"),
    )


def edges_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )


def package_docs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community figures of packages, gaps included."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("package"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("long")).alias("stars"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("long") * 2).alias("forks"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("language"),
        F.lit(None).cast("long").alias("contributions_count"),
    )


def api_commits_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved API commits: all text, some times missing, unreadable, short of a time or without signs."""
    commits = commits_v(spark, sf_dir)
    k = F.col("n")
    stamp = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.date_format(F.date_add("date", 30), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return commits.select(
        F.col("commit_id").alias("id"),
        F.col("author").alias("author_name"),
        F.lower(F.replace("author", F.lit("#"), F.lit("."))).alias("author_email"),
        F.when(k % 13 != 0, stamp).otherwise("unknown").alias("authored_date"),
        F.when(k % 17 == 3, F.date_format("date", "yyyy-MM"))
        .when(k % 17 == 5, F.date_format(F.date_add("date", 30), "yyyyMMdd HHmmss"))
        .when(k % 4 != 0, later)
        .alias("committed_date"),
    )
