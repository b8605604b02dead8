"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import alignment, bpe, chat, line_dedup, merkle, mixing, ngram_join, page_text, quality_model, quality_rules, substring_dedup, topk, toxicity
from cadenza.llm.common import WORD, crc_mod, table

#: Words of a text column in DuckDB.
SQL_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
#: A conversation whose texts look like the marks of templates.
PROBE = r"\### Assistant: </turn> ok"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs of 3 lines or 50 words, as a digest."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH parts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), counted AS (
    SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '{WORD}'))) AS k FROM parts
), windows AS (
    SELECT doc_id, n, unnest(range(1, len(l) - n + 2)) AS start, l, k FROM counted, (VALUES (1), (2), (3)) AS t(n) WHERE len(l) >= n
), keyed AS (
    SELECT doc_id, n, start, l[start:start + n - 1] AS w FROM windows WHERE n = 3 OR list_sum(k[start:start + n - 1]) >= {line_dedup.WORDS}
), ranked AS (
    SELECT doc_id, n, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS nth FROM keyed
), gone AS (
    SELECT DISTINCT doc_id, start + unnest(range(n)) AS line FROM ranked WHERE nth > 1
), cut AS (
    SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id
), kept AS (
    SELECT p.doc_id, l, coalesce(len(lines), 0) AS n_removed,
           list_filter(l, lambda x, i: NOT list_contains(coalesce(lines, []), i)) AS k
    FROM parts p LEFT JOIN cut c USING (doc_id)
)
SELECT doc_id, len(l)::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, chr(10))) AS kept_sha256 FROM kept
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that a document with a smaller id has in windows of 13, as a digest."""
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH texts AS (
    SELECT doc_id, {SQL_WORDS} AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts
), again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE doc_id > first
), gone AS (
    SELECT DISTINCT doc_id, i + unnest(range(13)) AS word FROM again
), counts AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), placed AS (
    SELECT doc_id, unnest(w) AS one, unnest(range(1, len(w) + 1)) AS word FROM texts
), kept AS (
    SELECT doc_id, string_agg(one, ' ' ORDER BY word) AS k FROM placed ANTI JOIN gone USING (doc_id, word) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class and its number of links."""
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP4_SQL = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, {SQL_WORDS} AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 9 * n_common >= 4 * (p.n + q.n)
), reach AS (
    SELECT doc_id, doc_id AS root FROM documents
    UNION SELECT links.y, reach.root FROM reach JOIN links ON reach.doc_id = links.x
), classes AS (
    SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id
), counts AS (
    SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN counts ON x = doc_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdicts of the base rules and of the learned list."""
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(f"stats.{c}" for c in counts), "base_failed", "kept", "rule")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7, rendered, parsed again and digested. The two tables have different layouts."""
    said = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(PROBE).alias("content")) for role in ("user", "assistant")))
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), said.alias("messages"))
    rows = chat.turns(table(spark, sf_dir, "conversations")).unionByName(chat.turns(probe))
    back = chat.read_back(chat.formatted(rows))
    each = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
    SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe,
           replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe_role FROM rows
), met AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, safe) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, safe) FILTER (role = 'assistant'), '') AS loss,
           sum(length(safe) + length(safe_role) + length('<turn ></turn>') + 1) AS formatted_chars
    FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM met
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from four of five folds."""
    held_out = crc_mod("doc_id", 5) == 0
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from two of three folds."""
    held_out = crc_mod("doc_id", 3) == 1
    scored = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix of all documents: what each gives, and its source's size and target."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP9_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size FROM documents
), by_source AS (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), named AS (
    SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM by_source
), weighed AS (
    SELECT *, place % 3 + 1 AS weight, 3 * source_size AS lim FROM named
), levels AS (
    SELECT *, row_number() OVER o AS ord,
           (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM weighed WINDOW o AS (ORDER BY lim / weight, place)
), water AS (
    SELECT min_by(level, ord) FILTER (level * weight <= lim) AS level FROM levels
), targets AS (
    SELECT source, source_size, n, least(w.level * weight, lim::DOUBLE) AS target FROM levels, water w
), shares AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), rests AS (
    SELECT *, target - whole * source_size AS rest,
           CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM shares
), ranked AS (
    SELECT d.*, r.source_size, r.target, r.whole, r.rest, r.p, sqrt(greatest(d.size, 1)::DOUBLE * r.n / greatest(r.source_size, 1)) AS factor,
           (CAST('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.size), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
), odds AS (
    SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p) * factor) END AS q FROM ranked
), summed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM odds
), taken AS (
    SELECT *, whole + CASE WHEN p > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END AS copies FROM summed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies::BIGINT AS copies FROM taken
"""

def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows for each row whose id is divisible by 50, of all rows."""
    rows = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


OP10_SQL = """
WITH good AS (
    SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.nth, q.vec_id AS query_id, d.vec_id, CASE WHEN len(q.v) = len(d.v) AND len(q.v) > 0 THEN list_dot_product(q.v, d.v)
        ELSE coalesce(list_sum(list_transform(range(1, least(len(q.v), len(d.v)) + 1), lambda i: q.v[i] * d.v[i])), 0) END::BIGINT AS score
    FROM (SELECT * FROM good WHERE vec_id % 50 = 0) q JOIN good d ON q.nth <> d.nth
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots, and the root that its proof gives after tampering with half of the documents."""
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows, n_trees = merkle.manifest(
        docs, "source", "doc_id", merkle.leaf_of([*map(F.col, fields), F.col("text")]), tampered=merkle.leaf_of([*map(F.col, fields), tampered])
    )
    rows = rows.withColumn("again", merkle.hexed(F.col("tampered"))).withColumn("folded_root", merkle.folded("again", n_trees))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_sql_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: One row a tree and level: its nodes as a list, folded up three at a time until one is left.
_SQL_UP = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))"
#: The siblings of node ``spot`` (from 0) in a list of nodes, before and after it.
_SQL_BEFORE = "array_to_string(nodes[spot // 3 * 3 + 1:spot], '')"
_SQL_AFTER = "array_to_string(nodes[spot + 2:spot // 3 * 3 + 3], '')"
OP11_SQL = rf"""
WITH RECURSIVE crcs AS (
    SELECT list(c ORDER BY b) AS crc FROM (
        SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM (SELECT unnest(range(256)) AS b)
    )
), docs AS (
    SELECT *, xor(4294967295, list_reduce([ord(x) FOR x IN string_split(doc_id::VARCHAR, '')],
                  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 2 = 0 AS tamper FROM documents, crcs
), hashed AS (
    SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf("CASE WHEN tamper THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM docs
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed
), low AS (
    SELECT tree, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM placed GROUP BY tree
    UNION ALL SELECT tree, level + 1, {_SQL_UP} FROM low WHERE len(nodes) > 1
), subroots AS (
    SELECT tree, nodes[1] AS subroot FROM low WHERE len(nodes) = 1
), high AS (
    SELECT -1 AS tree, 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
    UNION ALL SELECT tree, level + 1, {_SQL_UP} FROM high WHERE len(nodes) > 1
), roots AS (
    SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1
), climb AS (
    SELECT tree, idx, 0 AS level, idx AS spot, tampered AS acc, '' AS proof FROM placed
    UNION ALL
    SELECT tree, idx, level + 1, spot // 3, sha256({_SQL_BEFORE} || acc || {_SQL_AFTER}), proof || {_SQL_BEFORE} || {_SQL_AFTER}
    FROM climb JOIN low USING (tree, level) WHERE len(nodes) > 1
), reached AS (
    SELECT tree, idx, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM climb GROUP BY ALL
), on_top AS (
    SELECT tree AS owner, idx, 0 AS level, tree AS spot, acc, proof FROM reached
    UNION ALL
    SELECT owner, idx, level + 1, spot // 3, sha256({_SQL_BEFORE} || acc || {_SQL_AFTER}), proof || {_SQL_BEFORE} || {_SQL_AFTER}
    FROM on_top JOIN high USING (level) WHERE len(nodes) > 1
), ends AS (
    SELECT owner AS tree, idx, arg_max(acc, level) AS folded_root, arg_max(proof, level) AS proof FROM on_top GROUP BY ALL
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN ends USING (tree, idx) JOIN subroots USING (tree), roots
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, the cuts they share, and its links weighed by the corpus."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return page_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_toxicity": op7_toxicity,
    "op8_quality_model": op8_quality_model,
    "op9_mixing": op9_mixing,
    "op10_top_k": op10_top_k,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_page_text": op13_page_text,
}
SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op4_ngram_join": OP4_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op10_top_k": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
