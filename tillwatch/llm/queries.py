"""The operators and the pipeline as registered queries, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.registry import query
from tillwatch.llm import chat, decontaminate, language, lines, negatives, prefix_trie, quality, repeats, secrets, sentencepiece, simhash, token_counts, warc
from tillwatch.session import materialise


#: A merge vocabulary of 32,000 pieces with byte fallback.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "op1_line_dedup",
    r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), d AS (
  SELECT line, length(line) AS c, min([doc_id, n]) AS f FROM l WHERE length(line) >= 10 GROUP BY line
), half AS (
  SELECT *, 'head' AS side, md5(left(line, m // 2)) AS part FROM (SELECT *, unnest([c, c - 1]) AS m FROM d)
  UNION ALL SELECT *, 'tail', md5(right(line, m - m // 2)) FROM (SELECT *, unnest([c, c - 1]) AS m FROM d)
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.f AS fa, b.f AS fb, a.c AS c, b.c - a.c AS longer
  FROM half a JOIN half b USING (m, side, part) WHERE a.c = m AND a.line <> b.line
), near AS (
  SELECT CASE WHEN fa < fb THEN b ELSE a END AS line FROM pairs
  WHERE len(list_filter(range(1, c + 2), lambda i: CASE WHEN longer = 0 THEN left(a, i - 1) || substr(a, i + 1) = left(b, i - 1) || substr(b, i + 1) ELSE a = left(b, i - 1) || substr(b, i + 1) END)) > 0
), marked AS (
  SELECT l.*, length(line) >= 10 AND (line IN (SELECT line FROM near) OR [doc_id, n] > f) AS gone FROM l LEFT JOIN d USING (line)
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY n) FILTER (NOT coalesce(gone, false)) AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(p.text, '')) AS kept_sha256
FROM documents LEFT JOIN per_doc p USING (doc_id)
""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    left = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", left)


@query(
    "op2_chat_format",
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]', '\0+', 'g'))
          + length(regexp_replace(replace(role, '\', '\\'), '<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]', '\0+', 'g')) + 23 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = "</s>[INST] ok [/INST]"
    forger = spark.createDataFrame([(-1, 0, "user", forged), (-1, 1, "assistant", forged)], rows.schema)
    # Turns may repeat or be null; every row is a message of its own.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = rows.unionByName(forger).withColumn("n", F.row_number().over(order))
    events = chat.recorded_log(numbered.select("conv_id", F.col("n").cast("long").alias("message"), "role", "text"))
    chats = chat.read_back(chat.render(chat.fold_events(events.repartition("conv_id", "message"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op3_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)
), twice AS (SELECT g FROM starts GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM starts SEMI JOIN twice USING (g)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded_and_decoded(docs)


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    """Digest of the ids of each document, and whether they give its text back."""
    found = sentencepiece.decode(sentencepiece.encode(docs.select("doc_id", "text"), VOCABULARY), VOCABULARY)
    return found.select(
        "doc_id",
        F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce(F.array_join("tokens", ","), F.lit("")), 256).alias("tokens_sha256"),
        F.col("decoded").eqNullSafe(F.translate("text", "\u2581", " ")).alias("round_trip"),
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, VOCABULARY).select("doc_id", "n_pretokens", "n_tokens")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    per_doc = secrets.scan(docs, secrets.triage).groupBy(F.col("doc_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("is_secret").alias("n_secrets"),
        F.array_sort(F.collect_set(F.when(F.col("is_secret"), F.col("token")))).alias("secrets"),
    )
    every = docs.select("doc_id").join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return every.select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"),
        F.sha2(F.coalesce(F.array_join("secrets", ","), F.lit("")), 256).alias("secrets_sha256"),
    )


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.judge_quality(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "probability")


@query(
    "op9_decontaminate",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' '))) AS g
  FROM i WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n
), starts AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM places
), hits AS (SELECT doc_id, s, n, item FROM starts JOIN grams USING (n, g)),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
""",
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_langid")
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


@query(
    "op11_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
shared AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN shared USING (payload_digest)
""",
)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read(spark, sf_dir, "pages"))
    records = warc.resolve(materialise(warc.read_archives(archives, payloads=False), "records"))
    return records.select(
        F.col("row_key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("original_key").cast("long").alias("refers_to"),
    )


@query(
    "op12_prefix_trie",
    r"""
WITH RECURSIVE crc_step(byte, bit, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT byte, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE bit < 8
), crc AS (SELECT list(c ORDER BY byte) AS tab FROM crc_step WHERE bit = 8),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (
  SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, crc
), convs AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.w, 1, a.h), []), list_slice(a.w, a.h + 1, len(a.w))) AS w
  FROM taken a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, md5(list_slice(w, 1, d)::VARCHAR) AS p, len(w) AS n, coalesce(strlen(w[d].t), 0) AS bytes, CASE WHEN d > 0 THEN md5(list_slice(w, 1, d - 1)::VARCHAR) END AS up
  FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM convs)
), nodes AS (
  SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p
), children AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.p, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((b.n_convs - 1) * b.bytes) AS saved
  FROM nodes b JOIN prefixes a ON a.conv_id = b.conv_id AND a.d <= b.d LEFT JOIN children c ON c.d = b.d AND c.p = b.p GROUP BY a.d, a.p
)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = x.up LEFT JOIN children c ON c.d = x.d AND c.p = x.p JOIN below s ON s.d = x.d AND s.p = x.p
""",
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialise(prefix_trie.sequences(read(spark, sf_dir, "conversations")), "turns")
    taken = F.crc32(F.col("conv_id").cast("string")) % 9
    rebuilt = prefix_trie.with_shared_starts(convs, F.col("conv_id") - F.col("conv_id") % 5, taken)
    found = prefix_trie.prefix_trie(rebuilt)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


@query(
    "op13_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other)::INTEGER AS rank,
  n.other AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other) <= 5
""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
