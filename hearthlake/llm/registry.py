"""The operators' queries over the documents table and its companions, by name, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm import chat, contamination, divergence, exact_dedup, language, line_dedup, overlap, pieces, quality, runs, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = pieces.decode_ids(encoded)
    return decoded.select(
        "doc_id", F.size(F.coalesce("token_ids", F.array().cast("array<int>"))).alias("n_pieces"), F.xxhash64("token_ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )


def held_out(fold: int, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language.train(docs, ~held_out(1, 3))
    return language.identify(docs, network).select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score")


#: The conversation that the chat query adds: both of its turns hold nothing but control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    content = turns.unionByName(extra).select("conv_id", "turn", "role", chat.parts_of_text("text").alias("content"))
    return chat.read_back(chat.format_turns(content))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(0, 5))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(0, 5).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "any_term")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(1, 3))
    found = quality.score(docs, model)
    return found.select("doc_id", held_out(1, 3).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return found.select("doc_id", "removed", "removed_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.jaccard_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), loop=True)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_contamination": op9_contamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_divergence": op11_divergence,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_runs": op13_runs,
}

ORACLES = {
    "op3_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        escaped AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?TURN[ >]|\|(?:image|audio|document):)', '\1\\\2\3', 'g') AS body FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 14 + length(url_encode(role)) END)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments
        FROM escaped GROUP BY conv_id""",
    "op8_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)""",
    "op11_divergence": r"""
        WITH terms AS (
            SELECT line, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS line FROM documents)),
        kept AS (SELECT lang, term, count(*) AS everywhere FROM terms GROUP BY lang, term HAVING count(DISTINCT line) >= 30),
        counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        sources AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        langs AS (SELECT lang, count(*) AS v, sum(everywhere) AS total FROM kept GROUP BY lang),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
        shares AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                   (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0)::HUGEINT + 5 * l.v))::BIGINT AS p,
                   (1 + (1000000000::HUGEINT * (k.everywhere + 5)) // (l.total::HUGEINT + 5 * l.v))::BIGINT AS q
            FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
            LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
        marks AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM (FROM pairs UNION ALL FROM marks) QUALIFY part = 'pair' OR rank <= 50""",
    "op12_jaccard_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 4 THEN list_filter([array_to_string(words, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
            FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (shingle) GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = doc_id GROUP BY doc_id""",
}
