"""The registered query of each operator, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, packing, phrases, pii, quality, quality_model, secrets, simhash, substrings, token_files, toxicity, warc
from .shared import new_folder, table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP4_SQL = r"""
WITH lowered AS (SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
worded AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
items AS (SELECT id, ws, least(len(ws), 10) AS size FROM worded WHERE side = 'b' AND len(ws) > 0),
spots AS (SELECT id, ws, size, unnest(range(len(ws) - size + 1)) AS i FROM items),
wins AS (SELECT DISTINCT id, size, array_to_string(list_slice(ws, i + 1, i + size), ' ') AS run FROM spots),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT d.id, d.ws, s.size, unnest(range(len(d.ws) - s.size + 1)) AS i FROM worded d, sizes s WHERE d.side = 'd' AND len(d.ws) >= s.size),
runs AS (SELECT id, size, i, array_to_string(list_slice(ws, i + 1, i + size), ' ') AS run FROM places),
hits AS (SELECT r.id, r.i, r.size, w.id AS item FROM runs r JOIN wins w ON w.run = r.run AND w.size = r.size),
covered AS (SELECT id, COUNT(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS p FROM hits) t GROUP BY id),
found AS (SELECT id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits) t GROUP BY id)
SELECT d.id AS doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded d LEFT JOIN covered c ON c.id = d.id LEFT JOIN found f ON f.id = d.id WHERE d.side = 'd'
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS i, ws FROM d WHERE len(ws) >= 20),
named AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 20), ' ') AS k FROM win),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM named) t WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM (SELECT doc_id, i, unnest(range(20)) AS o FROM later) t),
words AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM d),
kept AS (SELECT words.doc_id, string_agg(w, ' ' ORDER BY words.pos) AS t, COUNT(*) AS n
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos WHERE gone.pos IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "labels").where("quality = 1")
    found = quality.judge(table(spark, sf_dir, "documents"), clean)
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _op8_sql() -> str:
    """The words of the clean set, counts, references and distances in long form: a row for each bin of a document."""
    between = quality.BETWEEN.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) AS BIGINT) AS chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^.,;:!?]', '', 'g')) AS marks FROM w),
spots AS (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM w WHERE len(ws) > 2),
tri AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) AS k FROM spots),
rep AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM tri WHERE k > 1) x GROUP BY doc_id),
clean AS (SELECT doc_id FROM labels WHERE quality = 1),
words AS (SELECT * FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(t), '{between}')) AS word FROM d) x WHERE word <> ''),
plain AS (SELECT doc_id, COUNT(*) AS n_plain FROM words GROUP BY doc_id),
often AS (SELECT lang, word, COUNT(*) AS n FROM words WHERE doc_id IN (SELECT doc_id FROM clean) GROUP BY ALL),
common AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS bin FROM often QUALIFY bin <= 24),
hits AS (SELECT s.doc_id, s.lang, m.bin, COUNT(*) AS v FROM words s JOIN common m ON m.lang = s.lang AND m.word = s.word GROUP BY ALL),
bins AS (SELECT doc_id, lang, 'w' AS kind, bin, v FROM hits
  UNION ALL SELECT c.doc_id, c.lang, 'w', 0, coalesce((SELECT n_plain FROM plain p WHERE p.doc_id = c.doc_id), 0) - coalesce((SELECT SUM(v) FROM hits h WHERE h.doc_id = c.doc_id), 0) FROM c WHERE lang IN (SELECT lang FROM common)
  UNION ALL SELECT doc_id, lang, 'c', 0, word_chars - n_symbols - upper - digits - marks FROM c UNION ALL SELECT doc_id, lang, 'c', 1, upper FROM c
  UNION ALL SELECT doc_id, lang, 'c', 2, digits FROM c UNION ALL SELECT doc_id, lang, 'c', 3, marks FROM c
  UNION ALL SELECT doc_id, lang, 'c', 4, n_symbols FROM c UNION ALL SELECT doc_id, lang, 'c', 5, chars - word_chars FROM c),
refs AS (SELECT lang, kind, bin, SUM(CASE WHEN doc_id IN (SELECT doc_id FROM clean) THEN v ELSE 0 END) AS v FROM bins
  WHERE lang IN (SELECT lang FROM d WHERE doc_id IN (SELECT doc_id FROM clean)) GROUP BY ALL),
shares AS (SELECT lang, kind, bin, CAST(v AS DOUBLE) / SUM(v) OVER (PARTITION BY lang, kind) AS q FROM refs),
own AS (SELECT doc_id, lang, kind, bin, CAST(v AS DOUBLE) / SUM(v) OVER (PARTITION BY doc_id, kind) AS p FROM bins),
ids AS (SELECT DISTINCT doc_id, lang, kind FROM own),
met AS (SELECT i.doc_id, i.kind, coalesce(o.p, 0) AS p, s.q FROM ids i JOIN shares s ON s.lang = i.lang AND s.kind = i.kind
  LEFT JOIN own o ON o.doc_id = i.doc_id AND o.kind = i.kind AND o.bin = s.bin),
degrees AS (SELECT lang, COUNT(*) AS k FROM common GROUP BY lang),
js AS (SELECT doc_id, kind, sqrt(greatest(0, SUM(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist FROM met GROUP BY ALL),
f AS (SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words, CASE WHEN chars >= 200 THEN a.dist END AS class_distance, CASE WHEN n_plain >= 100 THEN b.dist END AS word_distance, k, n_plain
  FROM c LEFT JOIN degrees USING (lang) LEFT JOIN plain ON plain.doc_id = c.doc_id LEFT JOIN rep ON rep.doc_id = c.doc_id LEFT JOIN js a ON a.doc_id = c.doc_id AND a.kind = 'c' LEFT JOIN js b ON b.doc_id = c.doc_id AND b.kind = 'w'),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(class_distance, 0) > 0.22 + 0.6 / sqrt(greatest(chars, 1)) OR coalesce(word_distance * word_distance > 0.2 * 0.2 + (k + 2 * sqrt(2 * k)) / (8 * ln(2) * greatest(n_plain, 1)), false)) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM g
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, word_bpe_path())
    return token_files.read_token_files(spark, folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")), folder)
    found = warc.read_derivatives(spark, folder).withColumnRenamed("source_id", "page_id")
    return found.select("page_id", "url", "response_id", "metadata_id", "conversion_id", "payload_digest", "text_digest", "title", F.size("links").cast("long").alias("n_links"), F.length("text").cast("long").alias("n_chars"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
sizes AS (SELECT lang, CAST(SUM(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
places AS (SELECT lang, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM (SELECT lang, k, array_to_string(list_slice(ws, i + 1, i + k), ' ') AS phrase FROM places) t GROUP BY ALL HAVING COUNT(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(list_slice(ws, 1, c), ' ') AS lp, array_to_string(list_slice(ws, c + 1, k), ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM c) t),
scored AS (SELECT x.lang, x.k, x.phrase, x.a, x.c, l.f AS l, r.f AS r, s.n, (CAST(1000 AS HUGEINT) * x.a * s.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp JOIN sizes s ON s.lang = x.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored) t WHERE o = 1),
parts AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(k - m + 1), lambda i: array_to_string(list_slice(ws, i + 1, i + m), ' '))))) AS phrase FROM c),
gone AS (SELECT DISTINCT p.lang, p.phrase FROM parts p JOIN c s ON s.lang = p.lang AND s.phrase = p.phrase WHERE 100 * p.a >= 100 * s.a),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN gone g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.phrase IS NULL)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_model.score(documents, quality_model.fit(documents, table(spark, sf_dir, "labels")))


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_simhash": op2_simhash,
        "op3_pii": op3_pii,
        "op4_decontamination": op4_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_substrings": op6_substrings,
        "op7_token_files": op7_token_files,
        "op8_quality": op8_quality,
        "op9_warc": op9_warc,
        "op10_secrets": op10_secrets,
        "op11_phrases": op11_phrases,
        "op12_conversations": op12_conversations,
        "op13_quality_model": op13_quality_model,
    }


def oracle_sql():
    return {
        "op4_decontamination": OP4_SQL,
        "op6_substrings": OP6_SQL,
        "op8_quality": _op8_sql(),
        "op11_phrases": OP11_SQL,
    }
