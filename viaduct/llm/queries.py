"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table


def tokenizer(name: str) -> str:
    """A vocabulary file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_texts

    out = encode_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
common AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, common.k IS NOT NULL AND k.doc_id <> common.top AS gone FROM k LEFT JOIN common ON k.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back

    own = spark.sql("SELECT bigint(-7) AS conv_id, bigint(turn) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)")
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_chats(log))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), e AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '<\\*\|(?:turn|text|end|im_start|im_end|endoftext|system|user|assistant)\|>|<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) AS escapes FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(role) + length(text) + escapes) + 23 * count(*))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress, hex_code, joined_text, with_label_error

    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books_sha256 = F.sha2(F.lit(joined_text(books)), 256)
    out = with_label_error(rows.select("vec_id", "label", hex_code(F.col("code")).alias("code"), "error"))
    return out.select("vec_id", "code", "error", "label_error", books_sha256.alias("codebooks_sha256"))


OP11_KEPT = """list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)) = [] AND embedding IS NOT NULL"""


def _op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's rounds written out, every part against every entry."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS q, len(embedding) // {parts} AS w FROM embeddings WHERE {OP11_KEPT}),
x AS (SELECT r, vec_id, p, list_slice(q, p * w + 1, (p + 1) * w) AS q FROM v, (SELECT unnest(range(0, {parts})) AS p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM v ORDER BY vec_id, q LIMIT {entries}),
c0 AS (SELECT p, e, q AS c FROM x JOIN seeds USING (r))"""
    ]
    squares = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, p, min((d, e)) AS b FROM (SELECT r, x.p, e, {squares} AS d FROM x JOIN c{k} ON x.p = c{k}.p) GROUP BY 1, 2)")
        if k < rounds:
            steps.append(
                f"""s{k} AS (SELECT x.p, b[2] AS e, i, CAST(floor(sum(q[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM x JOIN a{k} ON x.r = a{k}.r AND x.p = a{k}.p, unnest(range(1, len(q) + 1)) AS u(i) GROUP BY 1, 2, 3),
c{k + 1} AS (SELECT c{k}.p, c{k}.e, coalesce(n.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM s{k} GROUP BY 1, 2) n ON c{k}.p = n.p AND c{k}.e = n.e)"""
            )
    return f"""WITH {", ".join(steps)},
rows_ AS (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.label) AS label, string_agg(printf('%02x', b[2]), '' ORDER BY p) AS code, sum(b[1])::BIGINT AS error FROM v JOIN a{rounds} USING (r) GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM rows_"""


def op12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialised
    from .media import read_back, stored

    kept = materialised(stored(table(spark, sf_dir, "documents")), "media", "zstd")
    media = kept.select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media", "declared")
    back = read_back(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    samples = F.col("samples")
    return back.select(
        "doc_id", "n_bytes", F.octet_length(samples).cast("bigint").alias("payload_bytes"), F.sha2(samples, 256).alias("payload_sha256"),
        F.crc32(F.substring(samples, -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    own, given = F.col("vec_id"), F.col("label").cast("bigint")
    label = F.when(own % 7 == 0, (given + 1) % 10).otherwise(given)
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {OP11_KEPT}),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat": op6_chat,
    "op7_decontam": op7_decontam,
    "op8_simhash": op8_simhash,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_media": op12_media,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_chat": OP6_SQL,
    "op11_vector_codes": _op11_sql(),
    "op13_hard_negatives": OP13_SQL,
}
