"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm import (chat, collocations, decontam, langid, linetemplates, mixing, prefixtree, quality, repeats, secretscan,
                         simhash, surrogates, topk)
from docpipe.llm.common import crc32_mod, saved


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


#: A conversation whose texts hold another template's control strings.
CONTROL_CONVERSATION = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op1_simhash_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, data_dir, "documents"), shingle=4, radius=4)


def op2_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of four fifths of the ids."""
    docs, labels = table(spark, data_dir, "documents"), table(spark, data_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_chat_format(spark: SparkSession, data_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the formatted text and its loss mask."""
    given = table(spark, data_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(given.unionByName(extra))
    turns = chat.read_turns(F.col("formatted"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_language(spark: SparkSession, data_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of the ids."""
    docs = table(spark, data_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held), "text", "lang")
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_repeats(spark: SparkSession, data_dir: str) -> DataFrame:
    """Bytes of every document that 400-byte strings found twice cover, a digest of the rest, and words of shared passages of 51 words."""
    kept = F.col("kept")
    return repeats.remove_repeats(table(spark, data_dir, "documents"), length=400, passage=51).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(kept, 256).alias("kept_sha256"),
        F.octet_length(kept).cast("long").alias("n_kept"), F.make_valid_utf8(kept.cast("string")).alias("text"), "n_shared_words")


def op6_line_templates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs."""
    return linetemplates.drop_recurring_lines(table(spark, data_dir, "documents").select("doc_id", "text"))


def op7_topk_search(spark: SparkSession, data_dir: str) -> DataFrame:
    """The 10 best vectors for every vector whose id is divisible by 100."""
    vectors = table(spark, data_dir, "embeddings").select("vec_id", "embedding")
    return topk.topk(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_decontaminate(spark: SparkSession, data_dir: str) -> DataFrame:
    """Benchmark items that leak into documents, with the most similar window of each."""
    return decontam.leaking_documents(table(spark, data_dir, "documents"), table(spark, data_dir, "benchmark"))


def op9_surrogates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    key = spark.conf.get("spark.docpipe.surrogates.key", "key of the example query")
    return surrogates.replace_pii(table(spark, data_dir, "documents").select("doc_id", "text"), key)


def op10_source_mix(spark: SparkSession, data_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.per_document(mixing.mix(table(spark, data_dir, "documents")))


def op11_collocations(spark: SparkSession, data_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of every language."""
    return collocations.collocations(table(spark, data_dir, "documents").select("lang", "text"))


def op12_prefix_trie(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every node of the trie over the conversations rebuilt with common starts."""
    convs = prefixtree.sequences(table(spark, data_dir, "conversations"))
    return prefixtree.trie(prefixtree.with_common_starts(saved(convs)))


def op13_secrets(spark: SparkSession, data_dir: str) -> DataFrame:
    """Places of secrets in every document; the guess costs use the words of all documents."""
    docs = table(spark, data_dir, "documents").select("doc_id", "text")
    found = secretscan.find_secrets(docs, secretscan.learn(docs))
    spans = F.col("spans")
    return found.select(
        "doc_id", *(secretscan.count_of(spans, k).alias(f"n_{k}") for k in secretscan.KINDS),
        F.sha2(secretscan.listed(spans, base_only=True), 256).alias("base_sha256"), secretscan.listed(spans).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_quality, op3_chat_format, op4_language, op5_repeats, op6_line_templates, op7_topk_search,
    op8_decontaminate, op9_surrogates, op10_source_mix, op11_collocations, op12_prefix_trie, op13_secrets)}

_REST = chat.REST.replace("\\<", "<").replace("\\>", ">")

SQL = {
    "op3_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)({_REST})', '\1\2\\\3', 'g')) AS role_len,
         length(regexp_replace(text, '([<\[])(\\*)({_REST})', '\1\2\\\3', 'g')) AS text_len,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns),
marked AS (
  SELECT *, text_len + CASE WHEN before = role THEN {len(chat.NEXT)}
         ELSE role_len + {len(chat.START) + len(chat.BODY) + len(chat.END)} END AS chars
  FROM escaped),
texts AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars
FROM texts""",
    "op6_line_templates": r"""
WITH texts AS (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text),
line AS (
  SELECT text, first_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line
  FROM texts),
token AS (
  SELECT text, first_id, n, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
                                           lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM line),
slot AS (
  SELECT text, first_id, n, n_tokens || ' ' || array_to_string(w[1:3], ' ') AS leaf, j,
         array_to_string(w[4 + (len(w) - 3) * j // 8 : 3 + (len(w) - 3) * (j + 1) // 8], ' ') AS value,
         least(len(w) - 3, 8) AS n_filled
  FROM (SELECT text, first_id, n, CASE len(w) WHEN 1 THEN w || ['', ''] WHEN 2 THEN w || [''] ELSE w END AS w, len(w) AS n_tokens
        FROM token WHERE len(w) >= 1), range(8) AS r(j)),
busy AS (SELECT leaf FROM slot GROUP BY leaf HAVING count(DISTINCT text) >= 10),
kept AS (SELECT * FROM slot WHERE leaf IN (SELECT leaf FROM busy)),
constant AS (SELECT leaf, j, value FROM kept GROUP BY ALL HAVING count(DISTINCT text) >= 10),
template AS (
  SELECT k.text, k.n, any_value(first_id) AS first_id,
         k.leaf || CASE WHEN count(c.leaf) FILTER (k.value <> '') >= 0.75 * any_value(n_filled)
                        THEN ' general ' || string_agg(coalesce('=' || c.value, '*'), chr(10) ORDER BY k.j)
                        ELSE ' own ' || string_agg(k.value, chr(10) ORDER BY k.j) END AS template
  FROM kept k LEFT JOIN constant c ON k.leaf = c.leaf AND k.j = c.j AND k.value = c.value GROUP BY k.text, k.n, k.leaf),
recurring AS (SELECT template, min(first_id) AS keeper FROM template GROUP BY template HAVING count(DISTINCT text) >= 10),
dropped AS (SELECT text, n FROM template t JOIN recurring r ON t.template = r.template WHERE t.first_id <> r.keeper),
cleaned AS (
  SELECT l.text, coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (d.n IS NULL), '') AS new_text,
         count(*)::INTEGER AS n_lines, count(d.n)::INTEGER AS n_dropped
  FROM line l LEFT JOIN dropped d ON l.text = d.text AND l.n = d.n GROUP BY l.text)
SELECT o.doc_id, c.new_text AS text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM documents o LEFT JOIN cleaned c ON o.text = c.text""",
    "op8_decontaminate": r"""
WITH words_of AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
item AS (
  SELECT item_id, w, len(w) AS n, least(len(w), 5) AS size
  FROM (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0),
item_shingle AS (
  SELECT item_id, n, size, place, array_to_string(w[place + 1 : place + size], ' ') AS s
  FROM (SELECT *, unnest(range(n - size + 1)) AS place FROM item)),
doc_shingle AS (
  SELECT doc_id, size, spot, len(w) AS n_words, array_to_string(w[spot + 1 : spot + size], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS spot
        FROM words_of, (SELECT DISTINCT size FROM item) WHERE len(w) >= size)),
laid AS (
  SELECT DISTINCT doc_id, item_id, i.n, i.size,
         unnest([greatest(0, least(spot - place, n_words - i.n)), greatest(0, least(spot, n_words - i.n))]) AS start
  FROM doc_shingle d JOIN item_shingle i ON d.s = i.s AND d.size = i.size),
cut AS (
  SELECT l.*, w[start + 1 : start + n] AS window_words FROM laid l JOIN words_of o ON l.doc_id = o.doc_id),
window_shingle AS (
  SELECT doc_id, item_id, n, start, len(window_words) - size + 1 AS n_window,
         array_to_string(window_words[place + 1 : place + size], ' ') AS s
  FROM (SELECT *, unnest(range(len(window_words) - size + 1)) AS place FROM cut)),
counted AS (SELECT doc_id, item_id, n, start, n_window, s, count(*) AS c FROM window_shingle GROUP BY ALL),
item_counted AS (SELECT item_id, s, count(*) AS c, any_value(n - size + 1) AS n_item FROM item_shingle GROUP BY item_id, s),
alike AS (
  SELECT doc_id, c.item_id, n, start, sum(least(c.c, i.c)) / (n_window + n_item - sum(least(c.c, i.c)))::DOUBLE AS similarity
  FROM counted c JOIN item_counted i ON c.item_id = i.item_id AND c.s = i.s GROUP BY doc_id, c.item_id, n, start, n_window, n_item)
SELECT doc_id, item_id, start::INTEGER AS start_word, n::INTEGER AS n_words, similarity::DOUBLE AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM alike WHERE similarity >= 0.8)
WHERE r = 1""",
    "op7_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op10_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS order_key FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM d GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][source_rank % 3 + 1] AS weight, 2 * source_size AS cap FROM totals),
shares AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight::DOUBLE, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, source_rank, weight,
         CASE WHEN level * weight >= cap THEN cap::DOUBLE
              ELSE weight * max(level) FILTER (level * weight < cap) OVER () END AS target
  FROM shares),
queue AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, source_rank, weight,
         row_number() OVER (PARTITION BY d.source ORDER BY order_key, d.doc_id, d.size) AS n,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY order_key, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
packet AS (
  SELECT source_rank, n, least(256, size - 256 * p) AS words, (copy * source_size + start + 256 * p + words) / weight::DOUBLE AS finish
  FROM (SELECT *, unnest(range((size + 255) // 256)) AS p FROM queue, range(2) AS r(copy))),
ordered AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mix_end FROM packet),
served AS (
  SELECT source_rank, n, sum(greatest(0, least(words, budget - mix_end + words)))::BIGINT AS taken
  FROM ordered, (SELECT (3 * sum(size)::BIGINT) // 2 AS budget FROM d) GROUP BY source_rank, n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN served s ON q.source_rank = s.source_rank AND q.n = s.n""",
    "op11_collocations": r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
line AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM line GROUP BY lang),
gram AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM line, range(1, 4) AS r(m))),
counted AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM gram GROUP BY ALL HAVING count(*) >= 10),
candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2),
cut AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, f.a AS l, g.a AS r, c.a * c.a * 1000000 // (f.a * g.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate) c
  JOIN counted f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counted g ON g.lang = c.lang AND g.phrase = array_to_string(c.w[k + 1 :], ' ')),
least_cut AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cut) WHERE nth = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidate WHERE m = 3)
  GROUP BY lang, phrase),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank
  FROM least_cut c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * c.a)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked r JOIN sizes s ON r.lang = s.lang WHERE rank <= 2000""",
}
