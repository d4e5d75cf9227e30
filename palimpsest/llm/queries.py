"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    contamination,
    mixing,
    packing,
    paragraphs,
    pii,
    prefix_free,
    quality,
    ranking,
    sharding,
    structure,
    tokens,
    toxicity,
)
from palimpsest.llm.simhash import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_shard_lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


@query
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hex_digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
ORACLES["op7_mix_sources"] = f"""
WITH docs AS (
    SELECT doc_id, source, {WORDS} AS size,
        ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(text))), 1, 15))::BIGINT
            AS draw
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM docs GROUP BY source
),
-- Sources by how soon they reach their cap; those up to a place are capped, the others share on.
filling AS (
    SELECT *, (sum(source_size) OVER () * 1.5
            - coalesce(sum(2 * source_size) OVER earlier, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
    FROM sources
    WINDOW earlier AS (ORDER BY 2 * source_size / weight, source
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
final AS (SELECT max(level) AS level FROM filling
    WHERE level < 2 * source_size / weight),
targets AS (
    SELECT source, source_size, CASE WHEN 2 * source_size <= weight * level
        THEN (2 * source_size)::DOUBLE ELSE weight * level END AS target
    FROM sources, final
),
draws AS (
    SELECT d.source, draw, sum(size) AS size,
        any_value(target - least(floor(target / source_size), 2) * source_size) AS rest
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
),
below AS (
    SELECT source, draw,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= rest AS more
    FROM draws
)
SELECT doc_id, size, source_size, target,
    (size * least(least(floor(target / source_size), 2) + more::INT, 2))::BIGINT AS taken
FROM docs d
JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
JOIN below b ON d.source IS NOT DISTINCT FROM b.source AND d.draw = b.draw
"""


@query
def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = contamination.search(docs, items)
    containment = (F.col("n_shared") / F.col("n_item")).alias("containment")
    return found.select("doc_id", "item_id", "n_shared", "n_item", containment)


SHINGLES = """
    SELECT {id}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS shingle
    FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""
ORACLES["op8_benchmark_containment"] = f"""
WITH items AS (SELECT DISTINCT * FROM ({SHINGLES.format(id="item_id", table="benchmark")})),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY ALL),
docs AS (SELECT DISTINCT * FROM ({SHINGLES.format(id="doc_id", table="documents")})),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared
    FROM docs JOIN items USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    held_out = F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(True)).alias("held_out")
    return scored.select("doc_id", held_out, "score", toxicity.predicted().alias("predicted"))


@query
def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query
def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Passages of over 50 words, words counted; documents that share short lines only are left alone.
    found = paragraphs.remove_paragraphs(docs, passage=51)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    digest = F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", n_bytes, "n_removed", digest, "keepers")


@query
def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    found = quality.quality(docs)
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def listed(spans: Column) -> Column:
        entries = F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]),
        )
        return F.array_join(entries, ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query
def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs)


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.crc32("ids").alias("ids_crc32")
    pieces = packing.encode_pieces(docs).select("doc_id", "piece", "start", "length", digest)
    return packing.pack(pieces).withColumn("length", F.col("length").cast("long"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ranking.search(docs, items)


def lexical_terms(column: str) -> str:
    """The terms of a text in SQL."""
    lowered = f"translate(coalesce({column}, ''), '{ranking.UPPER}', '{ranking.LOWER}')"
    return f"regexp_extract_all({lowered}, '{ranking.TERM}')"


ORACLES["op12_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {lexical_terms("text")} AS terms FROM documents),
sizes AS (SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
items AS (SELECT DISTINCT item_id, unnest({lexical_terms("text")}) AS term FROM benchmark),
scores AS (
    SELECT item_id, doc_id, row,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
    GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found, repaired = structure.repair(structure.damage(given))
    key = F.struct("conv_id").alias("conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    solved = found.select(key, *counts, "audit")
    digests = structure.digests(repaired).select(key, "repaired_sha256")
    everyone = given.select(key).distinct()
    joined = everyone.join(solved, "conv", "left").join(digests, "conv", "left")
    return joined.select(
        "conv.conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def crc32(text: str, table: str) -> str:
    """The CRC-32 of an ASCII text in SQL, with the table of all bytes' checksums."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    step = f"xor({table}[1 + (xor(crc, c) & 255)], crc >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, c: {step}), 4294967295)"


CRC_TABLE = "range(0, 256)"
for _ in range(8):
    CRC_TABLE = f"list_transform({CRC_TABLE}, lambda c: xor(c >> 1, 3988292384 * (c & 1)))"
#: Inserts that may stand before a turn or at the end: states are 0 (nothing), 1 (s), 2 (u) and 3 (a).
INSERTS = """(VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', 'user:'), (0, 3, 4, 'II', 'user:|assistant:'),
    (1, 1, 0, '', ''), (1, 2, 2, 'I', 'user:'), (1, 3, 4, 'II', 'user:|assistant:'),
    (2, 2, 0, '', ''), (2, 3, 2, 'I', 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', 'user:'))"""
ORACLES["op13_structure_repair"] = f"""
WITH RECURSIVE checksums AS (SELECT {CRC_TABLE} AS crcs),
kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')", "crcs")} % 20 AS kind
    FROM conversations, checksums),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
    FROM kinds, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM damaged),
marked AS (
    SELECT *, bare = '' AS blank,
        bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM placed),
turns AS (
    SELECT *, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
        blank OR duplicate AS bad, left(role, 1) AS initial FROM marked),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size
    FROM turns GROUP BY conv_id),
inserts(state, after, cost, audit, lines) AS {INSERTS},
-- Of every conversation the cheapest edits of its first i turns, for each state.
steps AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state,
        {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM counts
    UNION ALL
    SELECT conv_id, i, state, min(best) FROM (
        SELECT s.conv_id, t.i, e.state, {{
            'cost': s.best.cost + n.cost + e.cost,
            'audit': s.best.audit || n.audit || e.edit,
            'lines': s.best.lines || replace(n.lines || CASE WHEN n.lines = '' THEN '' ELSE '|' END, '|', chr(10))
                || e.line}} AS best
        FROM steps s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1
        JOIN inserts n ON n.state = s.state,
        LATERAL (
            SELECT n.after AS state, 3 AS cost, 'D' AS edit, '' AS line
            UNION ALL
            SELECT a.state, t.truncated::INT + CASE WHEN a.kept THEN 0 ELSE 2 END,
                CASE WHEN a.kept THEN 'K' ELSE 'R' END,
                CASE WHEN a.kept THEN t.role ELSE a.role END || ':' || t.text || chr(10)
            FROM (VALUES (0, 's', 1, true, ''), (0, 'u', 2, true, ''), (1, 'u', 2, true, ''),
                (2, 'a', 3, true, ''), (3, 'u', 2, true, ''), (0, 'u', 2, false, 'user'),
                (1, 'u', 2, false, 'user'), (2, 'a', 3, false, 'assistant'), (3, 'u', 2, false, 'user'))
                AS a(origin, initial, state, kept, role)
            WHERE a.origin = n.after AND NOT t.bad AND (NOT a.kept OR a.initial = t.initial)) e)
    GROUP BY conv_id, i, state),
solved AS (
    SELECT s.conv_id, min({{
        'cost': s.best.cost + n.cost, 'audit': s.best.audit || n.audit,
        'lines': s.best.lines || replace(n.lines || CASE WHEN n.lines = '' THEN '' ELSE '|' END, '|', chr(10))
    }}) AS best
    FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.size = s.i
    JOIN inserts n ON n.state = s.state WHERE n.after IN (0, 3) GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank,
    coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
    coalesce(c.illegal, 0) AS illegal, coalesce(s.best.cost, 0) AS cost, coalesce(s.best.audit, '') AS audit,
    sha256(coalesce(left(s.best.lines, greatest(length(s.best.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""
