"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from grainscore.llm import (
    bpe,
    cap_filters,
    chat_format,
    decontaminate,
    filter_audit,
    language,
    line_chunks,
    ngram_join,
    quality_trees,
    substring,
    toxicity,
    url_filter,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """Which of ``parts`` folds a document is in; a null id is in none that is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


# 1. Chat formatting

_ESCAPED = "replace(coalesce({0}, ''), chr(92), chr(92) || chr(92))"
for _mark in chat_format.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}' || chr(92) || '{_mark[1:]}')"

CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), lengths AS (
  SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len("<||>" + chr(10) + chat_format.END)} AS n,
    row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY place) AS formatted FROM lengths
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(formatted) FILTER (role = 'assistant' OR place = turns))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR place = turns) AS n_examples
FROM running GROUP BY conv_id
"""


@register("op1_chat_format", CHAT_SQL)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.read_back(chat_format.expand(rows.unionByName(own)))


# 2. N-gram Jaccard join

_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reached(links: str, ids: str) -> str:
    """SQL: ``reached(id, component)`` over links (a, b) in both directions."""
    return f"""paths AS (
  SELECT id AS a, id AS b FROM ({ids}) UNION SELECT paths.a, {links}.b FROM paths JOIN {links} ON paths.b = {links}.a
), reached AS (SELECT a AS id, min(b) AS component FROM paths GROUP BY a)"""


JACCARD_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER_SQL}, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 3], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS s FROM texts WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * shared >= 85 * (m.n + k.n - shared)
), {_reached("links", "SELECT DISTINCT doc_id AS id FROM documents")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN reached ON doc_id = id
"""


@register("op2_ngram_join", JACCARD_SQL)
def _(spark, sf_dir):
    found = ngram_join.join(table(spark, sf_dir, "documents"), width=4, threshold=Fraction(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


# 3. Embedding near-dedup

NEAR_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), {_reached("links", "SELECT vec_id AS id FROM embeddings")}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component AS component_id, component = vec_id AS kept
FROM embeddings JOIN reached ON vec_id = id
"""


@register("op3_cap_filters", NEAR_SQL)
def _(spark, sf_dir):
    found = cap_filters.near(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return found.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), kept.alias("kept"))


# 4. Benchmark decontamination

_WORDS_SQL = f"coalesce(regexp_extract_all({_LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

DECONTAMINATION_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS place, doc_id, {_WORDS_SQL} AS words FROM documents
), items AS (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark
), starts AS (
  SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS s FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[s : s + 12], ' ') AS said FROM starts
), places AS (
  SELECT place, words, unnest(range(1, len(words) + 1)) AS spot FROM texts
), occurrences AS (
  SELECT p.place, p.spot, p.n, w.item_id
  FROM (SELECT place, spot, n, array_to_string(words[spot : spot + n - 1], ' ') AS said FROM places, (SELECT DISTINCT n FROM windows) WHERE spot + n - 1 <= len(words)) p
  JOIN windows w ON p.said = w.said AND p.n = w.n
), hits AS (
  SELECT place, count(DISTINCT word) AS n_hit FROM (SELECT place, unnest(range(spot, spot + n)) AS word FROM occurrences) GROUP BY place
), named AS (
  SELECT place, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM occurrences GROUP BY place
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM texts LEFT JOIN hits USING (place) LEFT JOIN named USING (place)
"""


@register("op4_decontamination", DECONTAMINATION_SQL)
def _(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.col("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated"
    )


# 5. Toxicity


@register("op5_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held)
    model = toxicity.fit(labels, docs)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


# 6. BPE


@register("op6_bpe")
def _(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.vocabulary(), digests=True)


# 7. URL filters

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _terms_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"len(list_filter([{listed}], lambda t: regexp_matches(words, '(^|[^0-9a-z])' || t || '($|[^0-9a-z])')))"


_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)

URL_SQL = f"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS place, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS words,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}
), fits AS (
  SELECT place, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY place
), counted AS (
  SELECT page_id, host, path, rule, rule_verdict, {_terms_sql(url_filter.STRICT_TERMS)} AS n_strict, {_terms_sql(url_filter.SOFT_TERMS)} AS n_soft
  FROM split LEFT JOIN fits USING (place)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM counted
"""


@register("op7_url_filter", URL_SQL)
def _(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


# 8. Language ID


@register("op8_language")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold(5) != 0))
    held = F.coalesce(fold(5) == 0, F.lit(False))
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


# 9. Substring dedup

REPEATS_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), runs AS (
  SELECT place, s, array_to_string(words[s : s + 34], ' ') AS said
  FROM (SELECT place, words, unnest(range(1, len(words) - 33)) AS s FROM texts WHERE len(words) >= 35)
), repeated AS (SELECT said FROM runs GROUP BY said HAVING count(*) > 1
), removed AS (SELECT DISTINCT place, unnest(range(s, s + 35)) AS spot FROM runs JOIN repeated USING (said)
), each AS (SELECT place, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM texts
), kept AS (
  SELECT place, string_agg(word, ' ' ORDER BY spot) AS text, count(*) AS n FROM each ANTI JOIN removed USING (place, spot) GROUP BY place
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (place)
"""


@register("op9_substring_dedup", REPEATS_SQL)
def _(spark, sf_dir):
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# 10. Line dedup


@register("op10_line_dedup")
def _(spark, sf_dir):
    kept = line_chunks.dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


# 11. Filter interaction audit

FILTERS = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * (char_length(text) - char_length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * char_length(text)",
    "D": "text RLIKE '[#$%&*|]'",
    "E": filter_audit.COPY_OF_SMALLER,
}

AUDIT_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id
), judged AS (
  SELECT place, part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM texts LEFT JOIN marks USING (doc_id)
), failed AS (
  SELECT *, list_concat(CASE WHEN a THEN ['A'] ELSE [] END, CASE WHEN b THEN ['B'] ELSE [] END, CASE WHEN c THEN ['C'] ELSE [] END,
    CASE WHEN d THEN ['D'] ELSE [] END, CASE WHEN e THEN ['E'] ELSE [] END) AS fails
  FROM judged
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS f, string_split(filter_order[1 : step - 1], '') AS before
  FROM (SELECT DISTINCT part FROM texts), orders, (SELECT unnest(range(1, 6)) AS step)
), grouped AS (SELECT part, fails, good, bad, count(*) AS n FROM failed GROUP BY ALL
), met AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, f)) AS kept,
    sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS removed,
    sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)) AS redundant,
    sum(n) FILTER (fails = [f]) AS unique_fails,
    sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before) AND good) AS good_lost,
    sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before) AND bad) AS toxic_lost
  FROM steps JOIN grouped USING (part) GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM met
"""


@register("op11_filter_audit", AUDIT_SQL)
def _(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), FILTERS, table(spark, sf_dir, "labels"))


# 12. Vector code compression


def _codes_sql() -> str:
    """The rounds one after the other; a component is one row."""
    steps = [
        """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), spots AS MATERIALIZED (
  SELECT row, (spot - 1) // (len(embedding) // 8) AS p, (spot - 1) % (len(embedding) // 8) AS k, floor(4096 * embedding[spot]::DOUBLE)::BIGINT AS x
  FROM (SELECT row, embedding, unnest(range(1, len(embedding) + 1)) AS spot FROM kept)
), book0 AS MATERIALIZED (SELECT row AS entry, p, k, x FROM spots WHERE row < 16)"""
    ]
    for n in range(7):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT row, p, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap
  FROM (SELECT s.row, s.p, b.entry, sum((s.x - b.x) * (s.x - b.x)) AS gap FROM spots s JOIN book{n} b USING (p, k) GROUP BY ALL) GROUP BY row, p
)""")
        if n < 6:
            steps.append(f"""mean{n} AS (
  SELECT entry, p, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM spots JOIN near{n} USING (row, p) GROUP BY entry, p, k
), book{n + 1} AS MATERIALIZED (SELECT entry, p, k, coalesce(m.x, b.x)::BIGINT AS x FROM book{n} b LEFT JOIN mean{n} m USING (entry, p, k))""")
    steps.append("""coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM near6 GROUP BY row
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, entry, k)) FROM book6) AS codebooks_sha256
FROM kept JOIN coded USING (row)
""")
    return ", ".join(steps)


@register("op12_vector_codes", _codes_sql())
def _(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


# 13. Quality classifier


@register("op13_quality_trees")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(5) == 0, F.lit(False))
    model = quality_trees.fit(table(spark, sf_dir, "labels").where(~held), docs)
    return quality_trees.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


# The pipeline

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
