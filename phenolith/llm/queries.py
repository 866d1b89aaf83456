"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolith.llm import bytecnn, maxent, mih, packing, rendezvous, sigtree, sp_bpe, surrogate, toxicity
from phenolith.llm.decontam import decontaminate
from phenolith.llm.runtime import merged, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return merged(table(spark, d, "documents"))


def op1_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    model = sp_bpe.model_bytes(tokenizer_path())
    ids = sp_bpe.encode(_documents(spark, d).select("doc_id", "text"), model).select("doc_id", "ids")
    both = sp_bpe.decode(ids, model)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    encoder = packing.tiktoken_encoder(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(_documents(spark, d), encoder, vocabulary=50256, end=50256, pad=50256)


def _share(modulus: int):
    """crc32 of the document's id as text, modulo a number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "text")
    held_out = F.coalesce(_share(3) == 1, F.lit(False))
    model = toxicity.fit(docs.filter(~held_out), table(spark, d, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate(_documents(spark, d), table(spark, d, "benchmark")).drop("items")


#: Session setting that holds the key of surrogates; jobs that must agree over sessions set it.
KEY = "spark.phenolith.surrogate.key"


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's key; where none is set, a random one that the session keeps."""
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY).encode()


def op8_surrogates(spark: SparkSession, d: str) -> DataFrame:
    out = surrogate.pseudonymize(_documents(spark, d).select("doc_id", "text"), surrogate_key(spark))
    return out.select("doc_id", F.size("entities").alias("n_entities"), F.col("entities.kind").alias("kinds"), "text")


SHARDS = 16


def op9_rendezvous(spark: SparkSession, d: str) -> DataFrame:
    return rendezvous.shard(table(spark, d, "documents"), dict.fromkeys(range(SHARDS), 1.0), grown=dict.fromkeys(range(SHARDS + 1), 1.0))


def op5_maxent(spark: SparkSession, d: str) -> DataFrame:
    learn = F.coalesce(_share(10) != 0, F.lit(False))
    out = maxent.score(_documents(spark, d), learn)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_bytecnn(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    held_out = F.coalesce(_share(4) == 2, F.lit(False))
    net = bytecnn.fit(docs.filter(~held_out))
    return bytecnn.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_multi_index(spark: SparkSession, d: str) -> DataFrame:
    return mih.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return sigtree.jaccard_components(_documents(spark, d))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {"op1_sentencepiece": op1_sentencepiece, "op2_packing": op2_packing, "op3_toxicity": op3_toxicity, "op4_decontaminate": op4_decontaminate, "op5_maxent": op5_maxent, "op6_bytecnn": op6_bytecnn, "op7_multi_index": op7_multi_index, "op8_surrogates": op8_surrogates, "op9_rendezvous": op9_rendezvous, "op10_jaccard": op10_jaccard, "pipeline": corpus_pipeline.run}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT r, item_id, dwin.n, p FROM dwin JOIN iwin ON dwin.n = iwin.n AND dwin.s = iwin.s),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


#: The checksum goes over a text's bytes with a table of 256 entries made by eight shifts each.
OP9_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
b AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CASE WHEN text IS NULL THEN 1 ELSE octet_length(encode(text)) + 1 END AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT row_number() OVER () AS r, doc_id, k, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
h AS (SELECT r, j, CAST('0x' || substr(md5(k || '|' || j), 1, 13) AS BIGINT) AS h FROM c, range({SHARDS + 1}) g(j)),
o AS (SELECT r, arg_max(j, h) FILTER (j < {SHARDS}) AS shard, arg_max(j, h) AS grown FROM h GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || size || '|' || text_crc32), doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM c JOIN o USING (r)
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON x = u.r JOIN n v ON y = v.r WHERE 100 * i >= 85 * (u.n + v.n - i)),
c AS (SELECT r, r AS q FROM d UNION SELECT c.r, l.y FROM c JOIN l ON c.q = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(e.doc_id) AS component_id FROM c JOIN d e ON c.q = e.r GROUP BY c.r) m USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op9_rendezvous": OP9_SQL, "op10_jaccard": OP10_SQL}
