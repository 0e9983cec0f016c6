"""Token counts as delta-maintained rollups (operator 7).

A ledger holds signed rows: +1 for a document as it now is, -1 for it as it was; totals by source, language
and tokenizer version are sums of documents, tokens and bytes over the ledger's rows. A batch is a table of
changes (doc_id, source, lang, text, op), op being "upsert" or "delete". commit() compares it with the
documents' current state, counts tokens of the new texts alone, and writes

- delta/batch=<id>: signed sums by source, language and tokenizer version,
- state/batch=<id>: the new state of each changed document (a tombstone for a deleted one).

Last comes a marker, commits/batch=<id>; what has no marker is not read and is replaced when the batch
is committed again. A batch whose marker is there is not applied again, so a repeated commit changes
nothing. Each batch has a number; state is the row of the largest committed number for each doc_id.

Within a batch the last change of a doc_id counts, by column seq if there is one, else by a hash of the row. Defined
cases: a null text counts as empty; null source or lang are values of their own; rows with a null doc_id are
documents one by one, which nothing later can revise or delete; deleting what isn't there changes nothing;
empty batches are committed as such; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import common, tokens

KEYS = ("source", "lang", "tokenizer")
STATE = "doc_id long, source string, lang string, tokenizer string, tokens long, bytes long, text_hash long, live boolean, batch long"
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, bytes long"


def counted(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """docs with tokens (of the whole text) and bytes; the text goes."""
    path = tokenizer_path or tokens.default_path()
    keep = [c for c in docs.columns if c not in ("text", "tokens", "bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [len(ids) // 4 for ids in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], names=[*keep, "tokens", "bytes"])
        encoder.forget()

    rows = docs.select(*keep, common.whole_text(F.col("text")).alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + ["tokens long, bytes long"])
    return rows.mapInArrow(run, schema)


class Rollups:
    """The ledger in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = "word_bpe_49k", tokenizer_path: str | None = None) -> None:
        self.spark, self.folder, self.tokenizer, self.tokenizer_path = spark, folder.rstrip("/"), tokenizer, tokenizer_path

    def committed(self) -> list[int]:
        """Numbers of committed batches; one folder name each."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch="))

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/batch={b}" for b in batches])

    def state(self) -> DataFrame:
        """The live and deleted documents as last committed, one row for each doc_id."""
        rows = self._read("state", STATE, self.committed())
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "batch").alias("s")).select("doc_id", "s.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False, and nothing happens, if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        text = common.whole_text(F.col("text"))
        columns = set(changes.columns)
        op = F.lower("op") if "op" in columns else F.lit("upsert")
        rows = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            text.alias("text"), op.alias("op"), F.xxhash64(text).alias("text_hash"),
            (F.col("seq").cast("long") if "seq" in columns else F.lit(0).cast("long")).alias("seq"),
            F.when(F.col("doc_id").cast("long").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")).alias("unnamed"),
        )
        # Tokens are counted before documents are brought together, so only counts are shuffled.
        new = counted(rows, self.tokenizer_path).withColumn("tie", F.xxhash64("text_hash", "source", "lang", "op"))
        last = new.groupBy("doc_id", "unnamed").agg(F.max_by(F.struct("source", "lang", "tokens", "bytes", "text_hash", "op"), F.struct("seq", "tie")).alias("n")).select("doc_id", "unnamed", "n.*")
        old = self.state().where(F.col("live")).select("doc_id", *[F.col(c).alias(f"old_{c}") for c in (*KEYS, "tokens", "bytes")], F.lit(True).alias("was"), F.lit(-1).cast("long").alias("named"))
        both = last.withColumnRenamed("doc_id", "new_doc_id").join(old, (F.col("new_doc_id") == F.col("doc_id")) & (F.col("unnamed") == F.col("named")), "left")
        changed = common.materialize(both.select(
            F.col("new_doc_id").alias("doc_id"), "source", "lang", F.lit(self.tokenizer).alias("tokenizer"), "tokens", "bytes", "text_hash",
            (F.col("op") != "delete").alias("live"), F.lit(batch).cast("long").alias("batch"), F.coalesce("was", F.lit(False)).alias("was"), *[f"old_{c}" for c in (*KEYS, "tokens", "bytes")],
        ), "token-changes")
        plus = changed.where("live").select(*KEYS, F.lit(1).cast("long").alias("sign"), "tokens", "bytes")
        minus = changed.where("was").select(*[F.col(f"old_{k}").alias(k) for k in KEYS], F.lit(-1).cast("long").alias("sign"), (-F.col("old_tokens")).alias("tokens"), (-F.col("old_bytes")).alias("bytes"))
        delta = plus.unionByName(minus).groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch}")
        changed.where("doc_id IS NOT NULL").select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
        self.spark.range(1).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens, bytes: sums of all committed deltas that aren't all zero."""
        rows = self._read("delta", DELTA, self.committed())
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("documents", "tokens", "bytes")])
        return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0) | (F.col("bytes") != 0))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they are, in the last of three batches, which is delivered twice, as after a lost answer.

    Before it, each document is inserted with other values, and then deleted or revised, so the batches insert,
    delete, insert again and revise over the whole table; the totals are those of the documents as they are.
    """
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.lit("earlier").alias("source"), "lang", F.col("source").alias("text"))
    revised = named.withColumns({"source": F.lit("revised"), "op": F.when(F.xxhash64("doc_id") % 2 == 0, "delete").otherwise("upsert")})
    rollups = Rollups(spark, common.fresh_path(spark, "token-rollups"))
    for batch, changes in ((1, named), (2, revised), (3, docs), (3, docs)):
        rollups.commit(batch, changes)
    return rollups.totals()
