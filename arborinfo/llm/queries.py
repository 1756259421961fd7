"""Registered queries of the pipeline operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborinfo.llm import (
    chat_format, decontamination, embedding_dedup, jaccard_join, language_mixture, lattice, packing,
    periodic_runs, pii, substring_dedup, token_counts, toxicity, whitening,
)
from arborinfo.llm.pieces import tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, tokenizer())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeated_spans(docs)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents, learnt from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score_texts(docs, labels).withColumn("held_out", toxicity.held_out())
    return scored.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between near-equal vectors of a label."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents in rows of fixed width."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(
        docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256, vocabulary=50257
    )


def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and next segmentations of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.encode(docs, tokenizer(), n=3).drop("text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents covered by windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.contamination(marked).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of documents from the selected mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_mixture.identify_by_own_rows(docs)
    return found.withColumn("held_out", language_mixture.held_out()).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents; base spans and those that the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    count = lambda kind, spans="base_spans": F.size(F.filter(
        spans, lambda s: s["kind"] == pii.NUMBER[kind]
    )).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("all_spans").alias("spans"),
        *[count(kind, "all_spans") for kind in ("key", "national", "secret")],
        F.size("all_spans").cast("long").alias("n_spans"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of the vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=32)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words, and what is left without their repetitions."""
    docs = periodic_runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    best = periodic_runs.strongest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "n_words", best.alias("best"), "runs", "collapsed"
    ).select(
        "doc_id", "n_runs", *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in a chat template, read back from it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    formatted = chat_format.format_events(chat_format.log_of_turns(rows.unionByName(tricky)))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chat_format.read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_piece_lattice": op6_piece_lattice,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_language_mixture": op9_language_mixture,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+')"

#: CRC-32 of the decimal doc_id, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
    " lambda c: ascii(c)::BIGINT)), lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)),"
    " lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"
)

ORACLE: dict[str, str] = {
    "op7_jaccard_join": (
        f"WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents), "
        "sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g, least(5, len(w)) AS m"
        " FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)), "
        "n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), "
        "both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.m = b.m"
        " AND a.doc_id < b.doc_id GROUP BY 1, 2), "
        "link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y"
        " WHERE 100*c >= 75*(p.n + q.n - c)), "
        "way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link), "
        "reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, w.y FROM reach r JOIN way w ON w.x = r.y) "
        "SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id FROM d"
        " JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"
    ),
    "op8_decontamination": (
        f"WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), "
        f"i AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark), "
        "win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g"
        " FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)), "
        "grams AS (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT doc_id, w, m,"
        " unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)), "
        "hits AS (SELECT doc_id, s, m, item_id FROM grams JOIN win USING (m, g)), "
        "cov AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits)"
        " GROUP BY doc_id), "
        "its AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS l FROM"
        " (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id) "
        "SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items,"
        " sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20*coalesce(h, 0) >= len(w) AS contaminated"
        " FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"
    ),
    "op12_periodic_runs": (
        "WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,"
        f" {_CRC32} AS h FROM documents), "
        "p AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, (h // 10) % greatest(len(w), 1) AS a,"
        " 3 + (h // 10) % 8 AS k FROM h), "
        "d AS (SELECT doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: w[1 + (CASE WHEN i < a THEN i"
        " ELSE a + (i - a) % (1 + (n - a) // k) END)]) ELSE w END AS w FROM p), "
        "same AS (SELECT doc_id, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM"
        " (SELECT doc_id, n, w, unnest(range(1, n // 3 + 1)) AS q FROM d WHERE n >= 24)), "
        "isles AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER"
        " (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same) GROUP BY doc_id, q, isle), "
        "runs AS (SELECT doc_id, s, l, min(q) AS q FROM isles WHERE l >= greatest(24, 3 * q) GROUP BY doc_id, s, l), "
        "best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1), "
        "lists AS (SELECT doc_id, count(*) AS k, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t"
        " FROM runs GROUP BY doc_id), "
        "gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs), "
        "kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT doc_id, w, unnest(range(n)) AS i"
        " FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,"
        " (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(lists.t, '')) AS runs_sha256,"
        " sha256(coalesce(kept.t, '')) AS collapsed_sha256 FROM d LEFT JOIN best USING (doc_id)"
        " LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"
    ),
    "op13_chat_format": (
        "WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
        " UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)), "
        "e AS (SELECT *, len(text) + len(regexp_extract_all(text, '<\\\\*/?s>|\\[\\\\*/?INST\\]')) AS k FROM c) "
        "SELECT conv_id, count(*)::BIGINT AS n_turns,"
        " sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,"
        " coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,"
        " sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), ''))"
        " AS loss_sha256,"
        " (3 + sum(k + CASE WHEN role = 'assistant' THEN 4 ELSE 14 + len(role) END))::BIGINT AS formatted_chars"
        " FROM e GROUP BY conv_id"
    ),
}
