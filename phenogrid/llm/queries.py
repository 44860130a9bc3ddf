"""Queries over whole tables, one per operator, with the SQL each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm import exact_dedup, fill_middle, id_files, language, lexical, line_dedup, near_dedup, neighbours, packing, passages, pieces, resharding, secrets
from phenogrid.llm.common import table
from phenogrid.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES["op9_exact_dedup"] = op9_exact_dedup
ORACLES["op9_exact_dedup"] = r"""
WITH body AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM body
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~out))
    return language.predicted(docs, model).select("doc_id", out.alias("held_out"), "prediction.*")


QUERIES["op5_language_id"] = op5_language_id


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, secrets.thresholds(docs))
    spans = F.col("__spans")
    return found.select(
        "doc_id",
        *(secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.described(spans, base_only=True).cast("binary"), 256).alias("base_sha256"),
        secrets.described(spans).alias("spans"),
    )


QUERIES["op10_secret_scan"] = op10_secret_scan


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), path, end_id=0)
    return id_files.read_index(spark, path)


QUERIES["op1_token_ids"] = op1_token_ids


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), end_id=1, with_ids=False)
    return pieces.drop("ids", "queue")


QUERIES["op7_packing"] = op7_packing


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES["op2_nearest_neighbours"] = op2_nearest_neighbours
ORACLES["op2_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
    AND len([x FOR x IN embedding IF x <> 0]) > 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 20 shards by hash to 24 of equal bytes."""
    shards = resharding.reshard(table(spark, sf_dir, "documents"), resharding.hash_layout(20), 24, new_path(spark, "shards"))
    return resharding.listed(shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op3_resharding"] = op3_resharding


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


QUERIES["op4_near_dedup"] = op4_near_dedup


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_ids", "ids_crc32", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES["op6_sentencepiece"] = op6_sentencepiece


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES["op8_repeated_passages"] = op8_repeated_passages


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    sha = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("text", "restored"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


QUERIES["op11_fill_in_middle"] = op11_fill_in_middle
ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h4 FROM d),
p AS (
  SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h4[3] % 100 >= 100 THEN 'plain'
              WHEN h4[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
q AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM q
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES["op12_line_dedup"] = op12_line_dedup
ORACLES["op12_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=20)


QUERIES["op13_lexical_search"] = op13_lexical_search
ORACLES["op13_lexical_search"] = r"""
WITH w AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
d AS (SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(text, up, low), term)) AS t FROM documents, w),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, up, low), term)) AS t FROM benchmark, w),
ic AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY item_id, t),
tf AS (SELECT doc_id, row, t, count(*) AS tf FROM d GROUP BY doc_id, row, t),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
m AS (SELECT row, 100 - 25 + ((25 * n * docs) // length) AS m FROM n, c),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
s AS (
  SELECT item_id, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM ic JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (row) GROUP BY item_id, doc_id, row),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
