"""Token totals kept up by signed deltas.

A batch of changes becomes signed rows: an insert adds a document's count, a delete takes back what is on record, a
revision does both. Rows and their sums by source, language and tokenizer version are written as the files of that
batch; totals are plain sums over committed batches. A batch that is already committed is never written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
ROWS = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions: a token is a match of the pattern.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[.,;:!?]|[^\x20\x09-\x0D.,;:!?]+",
}


def counts(docs: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """Rows (doc_id, source, lang, tokenizer, n_tokens), one a row of `docs` and version; a missing text counts 0."""
    text = F.coalesce("text", F.lit(""))
    each = F.array(
        *(
            F.struct(F.lit(v).alias("tokenizer"), F.regexp_count(text, F.lit(p)).cast("long").alias("n_tokens"))
            for v, p in versions.items()
        )
    )
    return docs.select("doc_id", "source", "lang", F.inline(each))


def signed_rows(changes: DataFrame, recorded: DataFrame) -> DataFrame:
    """Signed rows of a batch of changes (doc_id, op, source, lang, tokenizer, n_tokens) against what is on record.

    op is insert, revise or delete; an insert of what is on record is a revision, a revision or delete of what is not
    takes nothing back; any other op or a missing id changes nothing. Of several changes of one document and tokenizer
    in a batch, deletes win, then the largest count. A delete without tokenizer takes back all versions.
    """
    sure = changes.filter(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
    exact = sure.filter("tokenizer is not null")
    order = F.struct((F.col("op") == "delete").alias("d"), F.coalesce("n_tokens", F.lit(0)).alias("n"), "source", "lang")
    one = exact.groupBy("doc_id", "tokenizer").agg(F.max(order).alias("c"))
    held = recorded.groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    held = held.filter("n_docs <> 0 or n_tokens <> 0")
    whole = sure.filter("op = 'delete' and tokenizer is null").select("doc_id").distinct()
    back = held.join(one.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
    back = back.unionByName(held.join(whole, "doc_id", "left_semi")).distinct()
    new = one.filter("not c.d").join(whole, "doc_id", "left_anti")
    return back.select(
        "doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")
    ).unionByName(
        new.select(
            "doc_id", "c.source", "c.lang", "tokenizer", F.lit(1).cast("long").alias("n_docs"), F.col("c.n").alias("n_tokens")
        )
    )


class Rollups:
    """Totals in a folder that driver and executors share. Batches are committed one after another."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.folder}/sums/batch={batch}/_SUCCESS")

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The files of committed batches only; rows are written before sums, and sums make a batch count."""
        if not self._exists(f"{self.folder}/sums"):
            return self.spark.createDataFrame([], schema)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sums/batch=*/_SUCCESS")
        marks = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [m.getPath().getParent().getName() for m in marks]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{kind}/{n}" for n in names))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write a batch unless it is committed; a half-written one is written anew. Tells whether it wrote."""
        if self.committed(batch):
            return False
        rows = signed_rows(changes, self._read("rows", ROWS))
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        mine = self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows/batch={batch}")
        sums = mine.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, n_docs, n_tokens) with documents on record; missing keys are a group."""
        sums = self._read("sums", SUMS).groupBy(*KEYS)
        sums = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")
