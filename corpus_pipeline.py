"""Corpus preparation: toxic documents go, one document of each group of near
duplicates stays, contaminated documents go, personal data is replaced, and
texts are encoded.

Each stage takes all that its predecessor kept, reread from Parquet.  Rows
without an id go if they are toxic or contaminated themselves; as near
duplicates they stay, since no id tells which one would be left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolith.llm import decontam, queries, sigtree, sp_bpe, surrogate, toxicity
from phenolith.llm.runtime import merged, stored, table, written

TOXIC = 0.7
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under ``TOXIC`` stay; the model learns from all labelled documents."""
    docs = merged(docs)
    return toxicity.keep_below(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of rows with one id and one text, one stays.

    Rows that share an id but not the text are documents of their own: then each pair of an id and a text is numbered.
    """
    docs = merged(docs)
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        groups = sigtree.jaccard_components(docs, k=WORDS, percent=PERCENT)
        others = stored(groups.filter("component_id != doc_id").select("doc_id").distinct(), "others")
        return merged(docs.join(others, "doc_id", "left_anti").select(*docs.columns), docs)
    mark = F.sha2(F.coalesce("text", F.lit("")), 256)
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    one = stored(docs.select("doc_id", "text").distinct().select(number.alias("_row_key"), "doc_id", "text"), "numbered")
    groups = sigtree.jaccard_components(one.select(F.col("_row_key").alias("doc_id"), "text"), k=WORDS, percent=PERCENT)
    member = groups.filter("doc_id is not null").select(F.col("doc_id").alias("_row_key"), "component_id")
    first = member.join(one.select("_row_key", "doc_id"), "_row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row_key")).alias("first"))
    kept = stored(first.select(F.col("first._row_key").alias("_row_key")).join(one, "_row_key").select("doc_id", mark.alias("_mark"), F.col("text").isNull().alias("_none")), "kept")
    left = docs.withColumns({"_mark": mark, "_none": F.col("text").isNull()}).join(kept, ["doc_id", "_mark", "_none"], "left_semi")
    return merged(left.dropDuplicates(["doc_id", "_mark", "_none"]).select(*docs.columns).unionByName(docs.filter("doc_id is null")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay of which less than a twentieth of the words lie in windows shared with ``benchmark``; texts without words stay."""
    return decontam.clean(merged(docs), table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by keyed surrogates; null texts stay null."""
    return surrogate.pseudonymize(merged(docs), queries.surrogate_key(spark), entities=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): little-endian 32-bit ids with begin and end."""
    ids = sp_bpe.encode(merged(docs.select("doc_id", "text")), sp_bpe.model_bytes(queries.tokenizer_path()))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal data", replace_personal_data), ("encoding", encode)]

#: Viterbi decoding, learned weights and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; (doc_id, n_tokens, ids) of what is kept, an empty table for an empty one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
