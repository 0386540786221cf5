"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import chat, decontaminate, language_id, lexical_search, licenses, line_dedup, lm_scoring, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, substring_dedup
from lagwise.llm.common import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
     i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
     iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS win, least(10, len(w)) AS n
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT n FROM iw),
     dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d JOIN lens ON len(w) >= n)),
     occ AS (SELECT doc_id, p, iw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
     hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS at FROM occ) GROUP BY doc_id),
     named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op2_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
     win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
     least AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
     gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS at FROM win JOIN least ON least.win = win.win WHERE m < doc_id),
     words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS at FROM d WHERE len(w) > 0),
     kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.at) AS said
              FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.at = words.at WHERE gone.at IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.read_back(chat.formatted(rows)))


SQL["op4_chat_formatting"] = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
              UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     c AS (SELECT *, length(replace(replace(replace(replace(r, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) AS r_chars,
                  length(replace(replace(replace(replace(t, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) AS t_chars FROM rows),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t) AS said,
                  coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '') AS loss,
                  string_agg(r || ',', '' ORDER BY turn NULLS FIRST, r, t) AS roles, sum(15 + r_chars + t_chars) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, '(system,)?(user,assistant,)+') AS valid FROM g
"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents WHERE doc_id IS NOT NULL),
     n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
     tot AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM n),
     q AS (SELECT DISTINCT item_id, unnest({_PLAIN}) AS term FROM benchmark WHERE item_id IS NOT NULL),
     t AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
     df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
     wt AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS wt FROM df, tot),
     dm AS (SELECT doc_id, 100 - 90 + (90 * n * nd) // nl AS m FROM n, tot),
     s AS (SELECT item_id, t.doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM q JOIN t ON t.term = q.term JOIN wt ON wt.term = t.term JOIN dm ON dm.doc_id = t.doc_id GROUP BY item_id, t.doc_id),
     r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL["op11_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS p
           FROM documents WHERE doc_id IS NOT NULL),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.*, f.keeper IS NULL OR f.keeper = k.doc_id AS stays FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
