"""SQL counterparts of the registered queries, for DuckDB on the same tables.

The statements are put together from common table expressions, each of which names the ones it needs.
"""

from __future__ import annotations

import csv
import re
from importlib import resources

from palimpsest.functions.text import TOKEN, WS
from palimpsest.operators.labels import LABEL_NAMES
from palimpsest.operators.prompts import FIELDS, bundled_template
from workload.queries import LOOKBACK, NEVER
from workload.views import ANSWERS, EPOCH, JSON_ANSWERS, TEXT_ANSWERS

HEADING = f"(==+){WS}*(.*?){WS}*(==+)"


def text(value: str) -> str:
    """A string literal. Line breaks and tabs are spelled out."""
    quoted = "'" + value.replace("'", "''") + "'"
    return quoted.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


def stripped(expression: str) -> str:
    return f"regexp_replace({expression}, '^{WS}+|{WS}+$', '', 'g')"


def taxonomy_values(first_time: bool) -> str:
    name = "taxonomy_first_time.csv" if first_time else "taxonomy.csv"
    with resources.files("palimpsest").joinpath("data", name).open(encoding="utf-8") as file:
        rows = list(csv.reader(file))[1:]
    lines = [f"({r[0]}, {', '.join(text(c) for c in r[1:])})" for r in rows]
    return f"SELECT * FROM (VALUES {', '.join(lines)}) t(label, category, definition, example)"


def rendered(template: str) -> str:
    """A template as SQL concatenation of its pieces and the columns of the same names."""
    pieces = [template]
    for field in FIELDS:
        split = []
        for piece in pieces:
            if piece in FIELDS:
                split.append(piece)
                continue
            for i, part in enumerate(piece.split("{" + field + "}")):
                split += [field, part] if i else [part]
        pieces = split
    return " || ".join(f"p.{p}" if p in FIELDS else text(p) for p in pieces)


REVISIONS = f"""
SELECT 'a' || CAST(art AS VARCHAR) AS article, doc_id AS rev_id, {EPOCH} + doc_id * 3600 AS ts_seconds,
  CASE WHEN doc_id % 7 = 0 THEN 'Anonymous/Bot' ELSE source END AS user_name,
  CASE WHEN doc_id % 11 = 5 THEN '' ELSE concat_ws(chr(10), b0,
    '== History ==' || chr(10) || b1,
    (CASE WHEN r >= 5 THEN '=== Method/x ===' ELSE '=== Methods ===' END) || chr(10) || b2,
    (CASE WHEN doc_id % 13 = 4 THEN '==History==' WHEN r >= 7 THEN '==Applications=='
          ELSE '==Uses== ' END) || chr(10) || b3) END AS wikitext
FROM (
  SELECT *,
    last_value(CASE WHEN r % 4 = 0 THEN text END IGNORE NULLS) OVER h AS b0,
    last_value(CASE WHEN r % 4 = 1 THEN text END IGNORE NULLS) OVER h AS b1,
    last_value(CASE WHEN r % 4 = 2 THEN text END IGNORE NULLS) OVER h AS b2,
    last_value(CASE WHEN r % 4 = 3 THEN text END IGNORE NULLS) OVER h AS b3
  FROM (SELECT *, doc_id % 8 AS r, doc_id - doc_id % 8 AS art FROM documents)
  WINDOW h AS (PARTITION BY art ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""

SOURCE_REVISIONS = f"""
SELECT source AS article, doc_id AS rev_id, {EPOCH} + (doc_id // 4) * 3600 AS ts_seconds, lang AS user_name,
  CASE WHEN doc_id % 11 = 5 THEN '' ELSE lang || chr(10) || CASE doc_id % 3 WHEN 0 THEN '== A ==' WHEN 1 THEN '=== B ==='
    ELSE '== A ==' || chr(10) || 'x' || chr(10) || '== C/d ==' END || chr(10) || text END AS wikitext
FROM documents
"""

LINES = f"""
SELECT article, rev_id, ts_seconds, user_name, i, line,
  regexp_matches(line, '{HEADING}') AS head,
  sum(CAST(regexp_matches(line, '{HEADING}') AS INT)) OVER (
    PARTITION BY article, rev_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
FROM (SELECT article, rev_id, ts_seconds, user_name, unnest(string_split(wikitext, chr(10))) AS line,
        generate_subscripts(string_split(wikitext, chr(10)), 1) AS i
      FROM revs WHERE length(wikitext) > 0)
"""

SECTIONS = f"""
SELECT article, rev_id, ts_seconds, user_name, CAST(min(k) AS INTEGER) AS pos, section,
  arg_max(level, k) AS level, arg_max(content, k) AS content
FROM (
  SELECT article, rev_id, ts_seconds, user_name, k,
    CASE WHEN k = 0 THEN '(Top)' ELSE {stripped(
        f"split_part(regexp_extract(max(CASE WHEN head THEN line END), '{HEADING}', 2), '/', 1)"
    )} END AS section,
    CASE WHEN k = 0 THEN 0
      ELSE length(regexp_extract(max(CASE WHEN head THEN line END), '{HEADING}', 1)) - 1 END AS level,
    {stripped("coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '')")} AS content
  FROM lines GROUP BY article, rev_id, ts_seconds, user_name, k)
GROUP BY article, rev_id, ts_seconds, user_name, section
"""

EDITS = """
SELECT article, row_number() OVER (PARTITION BY article ORDER BY ts_seconds, rev_id, pos) - 1 AS seq,
  rev_id, ts_seconds, user_name, pos, section, level, content
FROM (
  SELECT s.*, n, lag(n) OVER t AS prev_n, lag(content) OVER t AS prev_content
  FROM sections s JOIN (
    SELECT article, rev_id, row_number() OVER (PARTITION BY article ORDER BY ts_seconds, rev_id) AS n
    FROM revs WHERE length(wikitext) > 0) USING (article, rev_id)
  WINDOW t AS (PARTITION BY article, section ORDER BY n))
WHERE prev_n IS NULL OR prev_n <> n - 1 OR prev_content <> content
"""

SOURCE_EDITS = f"""
SELECT source AS article,
  row_number() OVER (PARTITION BY source ORDER BY doc_id // 4, doc_id) - 1 AS seq,
  doc_id AS rev_id, {EPOCH} + (doc_id // 4) * 3600 AS ts_seconds,
  CASE WHEN doc_id % 5 = 0 THEN '(Top)' ELSE 'Notes in ' || lang END AS section, text AS content
FROM documents
"""

TURN_EDITS = """
SELECT CAST(conv_id AS VARCHAR) AS article, turn AS seq, turn AS rev_id, role AS section,
  text AS content FROM conversations
"""

WORDS = f"""
SELECT token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id
FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents)
GROUP BY token
"""

# Means are stored as FLOAT; texts without any known token have a vector of zeros.
VECTORS = f"""
SELECT article, seq, list(x ORDER BY dim) AS vec FROM (
  SELECT article, seq, d.dim, CAST(coalesce(sum(c * x), 0) / greatest(any_value(n), 1) AS FLOAT) AS x FROM (
    SELECT e.article, e.seq, e.n, s.c, s.vec_id FROM
      (SELECT article, seq, len(regexp_extract_all(content, '{TOKEN}')) AS n FROM items) e
      LEFT JOIN (
        SELECT article, seq, vec_id, count(*) AS c FROM (
          SELECT article, seq, unnest(regexp_extract_all(content, '{TOKEN}')) AS token
          FROM items) JOIN words USING (token) GROUP BY ALL) s
      ON s.article = e.article AND s.seq = e.seq) t
  CROSS JOIN (SELECT unnest(range(64)) AS dim) d
  LEFT JOIN (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
        generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) v
    ON v.vec_id = t.vec_id AND v.dim = d.dim
  GROUP BY article, seq, d.dim)
GROUP BY article, seq
"""


def links(title: float, content: float, lookback: int) -> str:
    """The look-back as a self-join, and the newest match of each edit."""
    return f"""
SELECT c.article, c.seq, c.rev_id, c.section, c.content, c.prev_seq,
  CASE WHEN c.seq = 0 THEN 'first-time' WHEN c.prev_seq IS NULL THEN 'none'
    WHEN title_match AND content_match THEN 'both' WHEN content_match THEN 'content' ELSE 'title'
  END AS match_type,
  coalesce(c.seq - c.prev_seq, 0) AS match_distance,
  p.rev_id AS prev_rev_id, p.section AS prev_section, p.content AS prev_content
FROM (
  SELECT e.article, e.seq, e.rev_id, e.section, e.content, m.prev_seq, m.title_match, m.content_match
  FROM items e LEFT JOIN (
    SELECT article, seq, prev_seq, title_match, content_match, row_number() OVER (
        PARTITION BY article, seq ORDER BY is_top AND content_match DESC, prev_seq DESC) AS rank
    FROM (
      SELECT c.article, c.seq, p.seq AS prev_seq, c.section = '(Top)' AS is_top,
        c.section = '(Top)' OR (CASE WHEN greatest(length(c.section), length(p.section)) = 0 THEN 0
          ELSE 1 - CAST(levenshtein(c.section, p.section) AS DOUBLE)
            / greatest(length(c.section), length(p.section)) END) >= {title} AS title_match,
        (CASE WHEN c.norm_text = p.norm_text THEN 1.0 WHEN c.norm = 0 OR p.norm = 0 THEN 0.0
          ELSE list_cosine_similarity(c.vec, p.vec) END) >= {content} AS content_match
      FROM embedded c JOIN embedded p ON p.article = c.article AND p.seq < c.seq
        AND p.seq >= c.seq - {lookback} AND p.rev_id <> c.rev_id
        AND (c.section <> '(Top)' OR p.section = '(Top)'))
    WHERE title_match OR content_match) m
  ON m.article = e.article AND m.seq = e.seq AND m.rank = 1) c
LEFT JOIN items p ON p.article = c.article AND p.seq = c.prev_seq
"""


EMBEDDED = """
SELECT i.article, i.seq, i.rev_id, i.section, i.content AS norm_text,
  CAST(v.vec AS DOUBLE[]) AS vec, list_inner_product(v.vec, v.vec) AS norm
FROM items i JOIN vectors v ON v.article = i.article AND v.seq = i.seq
"""


def lines_of_taxonomy(table: str) -> str:
    return (
        "string_agg(CAST(label AS VARCHAR) || '. ' || category || ': ' || "
        "replace(definition, '{PAGE_NAME}', article) || chr(10) || chr(9) || 'Example: ' || example, "
        f"chr(10) ORDER BY label) FROM arts, {table}"
    )


LABELS_TEXT = f"""
SELECT article, compare_labels, first_time_labels
FROM (SELECT article, {lines_of_taxonomy("tax")} GROUP BY article) t(article, compare_labels)
JOIN (SELECT article, {lines_of_taxonomy("tax_first")} GROUP BY article) f(article, first_time_labels)
  USING (article)
"""

PROMPTS = f"""
SELECT article, seq, rev_id, match_type, article || '#' || CAST(seq AS VARCHAR) AS custom_id,
  is_first_time, CASE WHEN is_first_time THEN {rendered(bundled_template("first_time"))}
    ELSE {rendered(bundled_template("compare"))} END AS prompt
FROM (
  SELECT l.*, l.content AS current, coalesce(l.prev_content, '') AS previous,
    l.match_type IN ('first-time', 'none') AS is_first_time,
    CASE WHEN l.match_type IN ('first-time', 'none') THEN t.first_time_labels ELSE t.compare_labels
    END AS labels
  FROM links l JOIN labels_text t USING (article)) p
"""


def answers(forms: list[str]) -> str:
    cases = []
    for i, form in enumerate(forms):
        filled = text(form.format("\0first\0", "\0second\0", "\0source\0"))
        for name in ("first", "second", "source"):
            filled = filled.replace(f"\0{name}\0", f"' || {name} || '")
        cases.append(f"WHEN {i} THEN {filled}")
    return f"""
SELECT doc_id, source, first, second, CASE doc_id % {len(forms)} {' '.join(cases)} END AS response
FROM (SELECT doc_id, source, CASE WHEN quality = 1 THEN '1' ELSE '11' END AS first,
        CASE WHEN toxic = 1 THEN '5' ELSE '2' END AS second
      FROM labels JOIN documents USING (doc_id))
"""


# What each form of answer is known to hold: labels and explanations.
_PAIR = "concat_ws(',', CAST(least(a, b) AS VARCHAR), CAST(greatest(a, b) AS VARCHAR))"
_TEXTS = (
    "CASE WHEN a < b THEN first || '=from ' || source || chr(10) || second || '={0}' "
    "ELSE second || '={0}' || chr(10) || first || '=from ' || source END"
)
EXPECTED = {
    JSON_ANSWERS[0]: ("first", "first || '=from ' || source"),
    JSON_ANSWERS[1]: (_PAIR, _TEXTS.format("also")),
    JSON_ANSWERS[2]: ("first", "first || '=from ' || source || ' again'"),
    JSON_ANSWERS[3]: ("'9'", "'9=from ' || source || ' again'"),
    TEXT_ANSWERS[0]: (_PAIR, _TEXTS.format("from ' || source || '")),
    TEXT_ANSWERS[1]: (_PAIR, _TEXTS.format("from ' || source || '")),
}


def parsed(forms: list[str]) -> str:
    columns = []
    for part, name in enumerate(("labels", "explanations")):
        cases = [f"WHEN {i} THEN {EXPECTED[f][part]}" for i, f in enumerate(forms) if f in EXPECTED]
        columns.append(f"CASE doc_id % {len(forms)} {' '.join(cases)} END AS {name}")
    return f"""
SELECT doc_id, response, {', '.join(columns)}
FROM (SELECT *, CAST(first AS INT) AS a, CAST(second AS INT) AS b FROM answers)
"""


PARSED_COLUMNS = """SELECT doc_id, labels, explanations,
  CASE WHEN labels IS NULL THEN 'invalid' ELSE 'ok' END AS parse_status FROM parsed"""

LABELLED = """
SELECT l.article, l.section, l.rev_id, i.ts_seconds, i.user_name AS "user",
  md5(coalesce(l.prev_content, '')) AS prev_md5, md5(l.content) AS content_md5,
  p.labels, p.explanations
FROM links l JOIN items i ON i.article = l.article AND i.seq = l.seq
LEFT JOIN parsed p ON p.doc_id = l.rev_id
"""

ITEMS = "SELECT article, seq, rev_id, ts_seconds, user_name, section, content FROM edits"

TABLES = {
    "revs": REVISIONS,
    "lines": LINES,
    "sections": SECTIONS,
    "edits": EDITS,
    "items": ITEMS,
    "words": WORDS,
    "vectors": VECTORS,
    "embedded": EMBEDDED,
    "links": links(0.8, 0.99, 1000),
    "arts": "SELECT DISTINCT article FROM revs",
    "tax": taxonomy_values(False),
    "tax_first": taxonomy_values(True),
    "labels_text": LABELS_TEXT,
    "prompts": PROMPTS,
    "answers": answers(ANSWERS),
    "parsed": parsed(ANSWERS),
    "names": "SELECT * FROM (VALUES "
    + ", ".join(f"({n}, {text(name)})" for n, name in LABEL_NAMES.items())
    + ") t(label, name)",
}


def sql(select: str, **given: str) -> str:
    """``select`` preceded by the tables it reads; ``given`` replaces some of them."""
    tables = {**TABLES, **given}
    read: list[str] = []

    def collect(statement: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_]+)\b", statement):
            if name in tables and name not in read:
                collect(tables[name])
                read.append(name)

    collect(select)
    return f"WITH {', '.join(f'{name} AS ({tables[name]})' for name in read)} {select}"


LINK_COLUMNS = """SELECT article, seq, section, match_type, match_distance, prev_rev_id, prev_section,
  md5(coalesce(prev_content, '')) AS prev_md5 FROM links"""

EDIT_COLUMNS = """SELECT article, seq, rev_id, ts_seconds, user_name AS "user", pos, section,
  repeat('*', level) AS level_stars, md5(content) AS content_md5 FROM edits"""
MEAN_VECTORS = """SELECT article, seq, CAST(generate_subscripts(vec, 1) - 1 AS INT) AS dim,
  round(CAST(unnest(vec) AS DOUBLE), 6) + 0.0 AS x FROM vectors"""
FIGURES = """
SELECT match_type AS figure, count(*)::DOUBLE AS value FROM links GROUP BY match_type
UNION ALL SELECT 'n_linked', count(*) FILTER (match_distance > 0) FROM links
UNION ALL SELECT 'avg_distance', avg(match_distance) FILTER (match_distance > 0) FROM links
UNION ALL SELECT 'max_distance', max(match_distance) FILTER (match_distance > 0) FROM links
UNION ALL SELECT 'n_prompts', count(*) FROM links
UNION ALL SELECT 'n_parsed', count(p.labels) FROM links l JOIN parsed p ON p.doc_id = l.rev_id"""

ORACLES = {
    "section_split": sql(
        """SELECT article, rev_id, pos, section, length(content) AS n_chars, md5(content) AS content_md5
        FROM sections""",
    ),
    "heading_levels": sql(
        """SELECT section, level, repeat('*', level) AS level_stars, count(*) AS n_sections
        FROM sections GROUP BY section, level""",
    ),
    "revision_count": sql(
        """SELECT article, count(*) AS n_revisions,
        count(*) FILTER (WHERE length(wikitext) > 0) AS n_with_text FROM revs GROUP BY article""",
    ),
    "section_changes": sql(EDIT_COLUMNS),
    "section_changes_sliced": sql(EDIT_COLUMNS, revs=SOURCE_REVISIONS),
    "carried_state": sql(EDIT_COLUMNS),
    "edits_by_section": sql(
        "SELECT article, section, count(*) AS n_edits FROM edits GROUP BY article, section"
    ),
    "sections_by_article": sql(
        """SELECT article, count(DISTINCT section) AS n_sections, count(*) AS n_edits
        FROM edits GROUP BY article""",
    ),
    "edit_order": sql(
        "SELECT article, seq, rev_id, ts_seconds, section FROM items", items=SOURCE_EDITS
    ),
    "title_similarities": sql(
        """SELECT article, rev_id, pos, section, next_section,
        round(1 - CAST(levenshtein(section, next_section) AS DOUBLE)
          / greatest(length(section), length(next_section)), 6) AS similarity
        FROM (SELECT *, lead(section) OVER (PARTITION BY article, rev_id ORDER BY pos) AS next_section
          FROM sections) WHERE next_section IS NOT NULL""",
    ),
    "cosine_pairs": """SELECT a.vec_id, round(list_cosine_similarity(
        CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "mean_embedding": sql(MEAN_VECTORS, items=TURN_EDITS),
    "mean_embedding_joined": sql(MEAN_VECTORS, items=TURN_EDITS),
    "own_embedding": sql(
        """SELECT article, seq, CAST(length(content) AS DOUBLE) AS n_chars,
        CAST(length(content) - length(replace(content, ' ', '')) AS DOUBLE) AS n_spaces FROM items""",
        items=TURN_EDITS,
    ),
    "link_full": sql(LINK_COLUMNS),
    "link_title": sql(LINK_COLUMNS, links=links(0.8, NEVER, 1000)),
    "link_content": sql(
        LINK_COLUMNS + " WHERE section <> '(Top)'", links=links(NEVER, 0.99, 1000)
    ),
    "link_top": sql(LINK_COLUMNS + " WHERE section = '(Top)'"),
    "link_lookback": sql(
        LINK_COLUMNS, items=SOURCE_EDITS, links=links(0.8, 0.99, LOOKBACK)
    ),
    "link_blocks": sql(LINK_COLUMNS, items=SOURCE_EDITS),
    "link_type_rows": sql(
        """SELECT article, seq, section, match_type, match_distance,
        match_type IN ('first-time', 'none') AS is_first_time FROM links""",
    ),
    "chain_figures": sql(FIGURES),
    "link_turns": sql(LINK_COLUMNS, items=TURN_EDITS),
    "match_types": sql(
        """SELECT match_type, count(*) AS n,
        round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
        FROM links GROUP BY match_type""",
    ),
    "match_distances": sql(
        """SELECT count(*) AS n_linked, round(avg(match_distance), 6) AS avg_distance,
        max(match_distance) AS max_distance FROM links WHERE match_distance > 0""",
    ),
    "linking_summary": sql(
        """SELECT count(*) AS n_edits, count(DISTINCT (article, rev_id, section)) AS n_embeddings,
        0.8::DOUBLE AS title_threshold, 0.99::DOUBLE AS content_threshold, 1000 AS lookback FROM edits""",
    ),
    "taxonomy_text": sql(
        "SELECT article, compare_labels, first_time_labels FROM labels_text"
    ),
    "prompts_compare": sql(
        """SELECT custom_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5
        FROM prompts WHERE NOT is_first_time""",
    ),
    "prompts_first_time": sql(
        """SELECT custom_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5
        FROM prompts WHERE is_first_time""",
    ),
    "prompt_dispatch": sql(
        """SELECT match_type, is_first_time, count(*) AS n_prompts
        FROM prompts GROUP BY match_type, is_first_time""",
    ),
    "parse_json_labels": sql(
        PARSED_COLUMNS, answers=answers(JSON_ANSWERS), parsed=parsed(JSON_ANSWERS)
    ),
    "parse_text_labels": sql(
        PARSED_COLUMNS, answers=answers(TEXT_ANSWERS), parsed=parsed(TEXT_ANSWERS)
    ),
    "parse_mixed": sql(PARSED_COLUMNS),
    "parse_success": sql(
        "SELECT count(labels) AS n_parsed, count(*) AS n_prompts FROM parsed"
    ),
    "parse_failures": sql(
        "SELECT doc_id, md5(response) AS response_md5 FROM parsed WHERE labels IS NULL"
    ),
    "parse_documents": f"""SELECT source, 'invalid' AS parse_status, count(*) AS n FROM documents
        WHERE NOT regexp_matches(text, '(?im)^{WS}*Labels?{WS}*:') GROUP BY source""",
    "label_counts": sql(
        """SELECT label, name, coalesce(category, name) AS category, count(*) AS n FROM (
          SELECT CAST(unnest(string_split(labels, ',')) AS INT) AS label FROM parsed)
        JOIN names USING (label) LEFT JOIN tax USING (label) GROUP BY ALL""",
    ),
    "api_scan": sql(
        """SELECT article, rev_id, ts_seconds, user_name AS "user", length(wikitext) AS n_chars,
        md5(wikitext) AS text_md5,
        row_number() OVER (PARTITION BY article ORDER BY rev_id % 3, rev_id) - 1 AS rev_seq FROM revs""",
    ),
    "overlapping_pages": """SELECT 'revision' AS kind, doc_id AS rev_id, md5(coalesce(text, '')) AS text_md5
        FROM documents
        UNION ALL SELECT CASE WHEN d.doc_id IS NULL THEN 'revision' ELSE 'conflict' END, e.doc_id + 1,
          md5('early ' || (e.doc_id + 1))
        FROM documents e LEFT JOIN documents d ON d.doc_id = e.doc_id + 1
        UNION ALL SELECT 'corrupt', NULL, md5('T') FROM documents WHERE doc_id % 4 = 0""",
    "empty_history": "SELECT count(*) AS n_pages, 0::BIGINT AS n_prompts FROM documents",
    "taxonomy_files": """SELECT CAST(doc_id % 150 AS INT) AS label, '"Kind", ' || max(doc_id) AS category,
        md5(arg_max(coalesce(text, ''), doc_id)) AS definition_md5, arg_max(source, doc_id) AS example
        FROM documents GROUP BY doc_id % 150""",
    "repeated_responses": """SELECT CAST(doc_id % 150 AS VARCHAR) AS custom_id,
        md5(arg_max(coalesce(text, ''), doc_id)) AS response_md5 FROM documents GROUP BY doc_id % 150""",
    "resumed_exchange": """SELECT CAST(doc_id AS VARCHAR) AS custom_id,
        CASE WHEN length(text) % 3 = 0 THEN 'second ' ELSE 'first ' END || length(text) AS response,
        CASE WHEN length(text) % 3 = 0 THEN 2::BIGINT ELSE 1 END AS n_asked FROM documents""",
    "partial_pages": """SELECT CASE WHEN doc_id % 5 = 0 THEN 'Asked' ELSE 'T' END AS article,
        CAST(2 * doc_id + i AS BIGINT) AS rev_id, md5(coalesce(text, '')) AS text_md5
        FROM documents, (VALUES (0), (1)) AS v(i) WHERE doc_id % 7 <> 6""",
    "batch_exchange": """SELECT CAST(doc_id AS VARCHAR) AS custom_id, 'POST' AS method,
        '/v1/chat/completions' AS url, 'some-model' AS model, 'user' AS role, md5(text) AS prompt_md5
        FROM documents""",
    "response_join": sql(
        """SELECT CAST(d.doc_id AS VARCHAR) AS custom_id, coalesce(response, 'No response') AS response,
        md5(text) AS prompt_md5 FROM documents d LEFT JOIN answers USING (doc_id)""",
    ),
    "batch_errors": """SELECT CAST(doc_id AS VARCHAR) AS custom_id, '{"code":"blocked"}' AS error
        FROM labels WHERE toxic = 1""",
    "scored_prompts": """SELECT CAST(doc_id AS VARCHAR) AS custom_id,
        CAST(1 + length(text) % 10 AS VARCHAR) AS labels,
        CAST(1 + length(text) % 10 AS VARCHAR) || '=' || length(text) || ' characters' AS explanations
        FROM documents""",
    "labelled_history": sql(LABELLED),
    "published_csv": sql(LABELLED),
}
