"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from workload.inputs import MODEL, PASSAGES, PROMPT

# --- small expressions -------------------------------------------------------------------------

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def flat(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def tokens(x: str) -> str:
    words = f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-./][a-z0-9]+)*')"
    return (
        f"flatten(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '[-./]') "
        "THEN list_concat([w], string_split_regex(w, '[-./]')) ELSE [w] END))"
    )


def sentences(x: str, v: str) -> str:
    """RE2 has no lookbehind: mark the break with a control character and split there."""
    marked = rf"regexp_replace({x}, '([.!?;:])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g')"
    parts = (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda {v}1: {strip(v + '1')}), "
        f"lambda {v}2: {v}2 <> '')"
    )
    return let(parts, v, f"CASE WHEN len({v}) > 0 THEN {v} ELSE [{strip(x)}] END")


def short(x: str) -> str:
    out = x
    for old, new in (
        ("onboarding_", "onb_"),
        ("_procurement", ""),
        ("supplier_framework_agreement", "framework"),
        ("returns_and_warranty_policy", "returns"),
        ("quality_inspection_procedure", "quality"),
    ):
        out = f"replace({out}, '{old}', '{new}')"
    return out


def table_line(x: str) -> str:
    return f"(starts_with({strip(x)}, '|') OR (starts_with({x}, '  ') AND {strip(x)} <> ''))"


def tabular(x: str, v: str) -> str:
    lines = f"string_split({x}, chr(10))"
    return let(
        lines, v, f"len(list_filter({v}, lambda {v}x: {table_line(v + 'x')})) >= greatest(2, len({v}) // 2)"
    )


# --- documents ---------------------------------------------------------------------------------

NOTES_RAW = """
  SELECT 'note-' || doc_id || '.TXT' AS source_path,
    replace(chr(65279) || 'NOTE ' || doc_id || E'\\n\\n1. BODY\\n\\n' || text
      || E'\\n\\n2.1 ORIGIN\\n\\nThe origin is listed below.\\n\\n  source    ' || source
      || E'\\n  language  ' || lang || E'\\n\\n3. EMPTY\\n\\n4. REMARK\\n\\nLength is '
      || n_chars || E' characters.\\n', chr(10), E' \\r\\n') AS raw
  FROM documents"""

ORDERS_RAW = """
  SELECT 'order-' || o_orderkey || '.md' AS source_path,
    '# Order ' || o_orderkey || E'\\n\\nReference ORD-' || o_orderstatus || '-' || o_orderkey
      || ' for customer ' || o_custkey || E'.\\n\\n## 1. Priority\\n\\nHandled as ' || o_orderpriority
      || E'.\\n# Not a section\\nSee clause 2.\\n\\n## 2. Fields\\n\\nThe fields of this order follow.\\n\\n'
      || E'| field | value |\\n|---|---|\\n| key | ' || o_orderkey || E' |\\n| customer | ' || o_custkey
      || E' |\\n| status | ' || o_orderstatus || E' |\\n| price | ' || CAST(floor(o_totalprice) AS BIGINT)
      || E' |\\n\\nPrices are rounded. (Fields are final.)' AS raw
  FROM orders"""


def files(raw: str) -> str:
    """source_path, raw to doc_id, title, source_path, fmt, text."""
    trimmed = f"list_transform(string_split(regexp_replace(ltrim(raw, chr(65279)), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: rtrim(x, {_WS}))"
    return f"""
  SELECT doc_id, source_path, fmt, text,
    coalesce(CASE WHEN fmt = 'markdown' AND regexp_matches(first_line, '^#\\s+.+$')
      THEN {strip("regexp_replace(first_line, '^#\\s+', '')")} ELSE first_line END, doc_id) AS title
  FROM (
    SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1] AS first_line
    FROM (
      SELECT regexp_extract(source_path, '^(.*)\\.[^.]*$', 1) AS doc_id, source_path,
        CASE WHEN lower(source_path) LIKE '%.md' THEN 'markdown' ELSE 'text' END AS fmt,
        trim(array_to_string({trimmed}, chr(10)), chr(10)) AS text
      FROM ({raw}))
    WHERE {strip('text')} <> '')"""


PLAIN = """
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, 'doc-' || doc_id || '.txt' AS source_path,
    'text' AS fmt, text FROM documents"""

# --- chunking ----------------------------------------------------------------------------------

_MD = r"'^#{2,6}\s+.+$'"
_MD_TITLE = r"'^#\s+.+$'"
_TXT = r"'^(\d+\.|\d+(?:\.\d+)+\.?)\s+([A-Z][^\n]{0,60})$'"


def sections(docs: str) -> str:
    """doc rows to doc_id, title, source_path, n (from 1), heading, body."""
    heading = (
        f"CASE WHEN fmt = 'markdown' THEN {strip(r"regexp_replace(lines[start], '^#{2,6}\s+', '')")} "
        f"ELSE rtrim(regexp_extract(lines[start], {_TXT}, 1), '.') || '. ' || {strip(f'regexp_extract(lines[start], {_TXT}, 2)')} END"
    )
    return f"""
  SELECT doc_id, title, source_path, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n, heading, body FROM (
    SELECT doc_id, title, source_path, start, CASE WHEN start = 0 THEN '' ELSE {heading} END AS heading,
      trim(array_to_string(list_filter(lines[start + 1 : stop - 1],
        lambda x: NOT (fmt = 'markdown' AND regexp_matches(x, {_MD_TITLE}))), chr(10)), chr(10)) AS body
    FROM (
      SELECT *, starts[j] AS start, coalesce(starts[j + 1], len(lines) + 1) AS stop FROM (
        SELECT *, unnest(range(1, len(starts) + 1)) AS j FROM (
          SELECT *, list_concat([0], list_filter(range(1, len(lines) + 1), lambda i:
            CASE WHEN fmt = 'markdown' THEN regexp_matches(lines[i], {_MD}) ELSE regexp_matches(lines[i], {_TXT}) END)) AS starts
          FROM (SELECT doc_id, title, source_path, fmt, string_split(text, chr(10)) AS lines FROM ({docs}))))))
  WHERE {strip('body')} <> ''"""


def blocks(body: str) -> str:
    """Expression: list of {text, atomic}."""
    paragraphs = (
        rf"list_filter(list_transform(string_split_regex({body}, '\n\s*\n'), lambda p: trim(p, chr(10))), "
        f"lambda p: {strip('p')} <> '')"
    )
    marked = (
        f"list_transform({paragraphs}, lambda p: {{'t': p, 'tab': {tabular('p', 'tl')}, "
        f"'intro': NOT {tabular('p', 'tm')} AND length(p) <= 400}})"
    )
    one = (
        "list_transform(range(1, len(m) + 1), lambda i: {'text': CASE WHEN m[i].tab AND i > 1 AND m[i - 1].intro "
        "THEN m[i - 1].t || chr(10) || chr(10) || m[i].t ELSE m[i].t END, 'atomic': m[i].tab, "
        "'taken': m[i].intro AND i < len(m) AND m[i + 1].tab})"
    )
    return let(marked, "m", f"list_filter({one}, lambda b: NOT b.taken)")


def fit(text: str, v: str) -> str:
    """Expression: list of pieces."""
    step = (
        f"CASE WHEN {v}a.run <> '' AND length({v}a.run) + length({v}s.run) > 1200 "
        f"THEN {{'done': list_append({v}a.done, {v}a.run), 'run': {v}s.run}} "
        f"ELSE {{'done': {v}a.done, 'run': CASE WHEN {v}a.run = '' THEN {v}s.run ELSE {v}a.run || ' ' || {v}s.run END}} END"
    )
    items = f"list_transform({sentences(text, v + 'q')}, lambda {v}z: {{'done': []::VARCHAR[], 'run': {v}z}})"
    folded = f"list_reduce({items}, lambda {v}a, {v}s: {step}, {{'done': []::VARCHAR[], 'run': ''}})"
    return (
        f"CASE WHEN length({text}) <= 1600 THEN [{text}] ELSE "
        + let(folded, f"{v}r", f"CASE WHEN {v}r.run = '' THEN {v}r.done ELSE list_append({v}r.done, {v}r.run) END")
        + " END"
    )


def pieces(body: str) -> str:
    plain = f"list_transform({fit('b.text', 'f')}, lambda y: {{'text': y, 'atomic': false}})"
    return (
        f"flatten(list_transform({blocks(body)}, lambda b: CASE WHEN b.atomic "
        f"THEN [{{'text': b.text, 'atomic': true}}] ELSE {plain} END))"
    )


def tail(text: str) -> str:
    near = (
        "list_filter(range(1, len(ts) + 1), lambda ti: ti = len(ts) OR "
        "list_sum(list_transform(ts[ti:], lambda tx: length(tx))) <= 180)"
    )
    return let(
        let(sentences(text, "tq"), "tr", "CASE WHEN len(tr) > 1 THEN tr[1 : len(tr) - 1] ELSE tr END"),
        "ts",
        f"array_to_string(list_transform({near}, lambda tj: ts[tj]), ' ')",
    )


def pack(pieces_column: str) -> str:
    """Expression over a list column of {text, atomic}: list of chunk texts, last runt merged."""
    closed = strip("array_to_string(a.open, chr(10) || chr(10))")
    seed = f"CASE WHEN p.atomic OR {tabular('a.open[len(a.open)]', 'ol')} THEN '' ELSE {tail('c')} END"
    restart = let(
        closed,
        "c",
        let(
            seed,
            "sd",
            "{'done': list_append(a.done, c), 'open': CASE WHEN sd = '' THEN [p.text] ELSE [sd, p.text] END, "
            "'size': (CASE WHEN sd = '' THEN 0 ELSE length(sd) + 2 END + length(p.text) + 2)::BIGINT, "
            "'text': '', 'atomic': false}",
        ),
    )
    go_on = (
        "{'done': a.done, 'open': list_append(a.open, p.text), 'size': (a.size + length(p.text) + 2)::BIGINT, "
        "'text': '', 'atomic': false}"
    )
    step = (
        "CASE WHEN len(a.open) > 0 AND a.size + length(p.text) > CASE WHEN p.atomic THEN 1600 ELSE 1200 END "
        f"THEN {restart} ELSE {go_on} END"
    )
    start = "{'done': []::VARCHAR[], 'open': []::VARCHAR[], 'size': 0::BIGINT, 'text': '', 'atomic': false}"
    items = (
        f"list_transform({pieces_column}, lambda y: {{'done': []::VARCHAR[], 'open': []::VARCHAR[], "
        "'size': 0::BIGINT, 'text': y.text, 'atomic': y.atomic})"
    )
    last = strip("array_to_string(r.open, chr(10) || chr(10))")
    whole = let(
        f"list_reduce({items}, lambda a, p: {step}, {start})",
        "r",
        f"CASE WHEN len(r.open) = 0 THEN r.done ELSE list_append(r.done, {last}) END",
    )
    return let(
        whole,
        "k",
        "CASE WHEN len(k) >= 2 AND length(k[len(k)]) < 200 AND length(k[len(k) - 1]) + length(k[len(k)]) <= 1600 "
        "THEN list_append(k[1 : len(k) - 2], k[len(k) - 1] || chr(10) || chr(10) || k[len(k)]) ELSE k END",
    )


def chunks(docs: str) -> str:
    """doc rows to chunk rows."""
    return f"""
  SELECT format('{{}}::{{:03d}}', doc_id, ordinal) AS chunk_id, doc_id, title AS doc_title, source_path,
    heading AS section, text, CASE WHEN heading <> '' THEN title || ' > ' || heading ELSE title END || chr(10) || chr(10) || text AS index_text,
    CAST(ordinal AS INT) AS ordinal
  FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, piece) - 1 AS ordinal FROM (
      SELECT doc_id, title, source_path, n, heading, unnest(texts) AS text, unnest(range(1, len(texts) + 1)) AS piece FROM (
        SELECT *, {pack('parts')} AS texts FROM (SELECT *, {pieces('body')} AS parts FROM ({sections(docs)})))))"""


def chunk_rows(docs: str) -> str:
    return f"""
SELECT chunk_id, doc_id, section, ordinal, length(text) AS chars, md5(text) AS text_digest, md5(index_text) AS index_digest,
  CASE WHEN section <> '' THEN doc_title || ', ' || section ELSE doc_title END AS label
FROM ({chunks(docs)})"""


# --- keyword search ----------------------------------------------------------------------------


def bm25(corpus: str, k: int = 20, prefix: str = "") -> str:
    """CTEs over ``corpus`` (chunk_id, text) ending in <prefix>hits(query_id, chunk_id, score, rank)."""
    p = prefix
    return f"""
{p}tok AS MATERIALIZED (SELECT chunk_id, {tokens('text')} AS toks FROM ({corpus})),
{p}siz AS MATERIALIZED (SELECT chunk_id, len(toks) AS dl FROM {p}tok),
{p}post AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM {p}tok) GROUP BY ALL),
{p}df AS MATERIALIZED (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM {p}siz),
{p}raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM {p}df, {p}st),
{p}mean AS (SELECT round(sum(r * c) / sum(c), 9) AS m FROM (SELECT r, count(*) AS c FROM {p}raw GROUP BY r)),
{p}idf AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM {p}raw, {p}mean),
{p}q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
{p}sc AS (SELECT query_id, chunk_id,
    round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 8) AS score
  FROM {p}q JOIN {p}idf USING (term) JOIN {p}post USING (term) JOIN {p}siz USING (chunk_id), {p}st GROUP BY query_id, chunk_id),
{p}hits AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM {p}sc WHERE score > 0) WHERE rank <= {k})"""


DOCS = "SELECT doc_id AS chunk_id, text FROM documents"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def vector_hits(k: int = 20) -> str:
    """CTE vhits(query_id, chunk_id, score, rank)."""
    return f"""
vhits AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (
  SELECT b.item_id AS query_id, e.vec_id AS chunk_id, round({dot('e.embedding', 'q.embedding')}, 8) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e)) WHERE rank <= {k})"""


BOTH = f"{bm25(DOCS)},{vector_hits()}"
EVIDENCE = """
ev AS MATERIALIZED (SELECT coalesce(v.query_id, h.query_id) AS query_id, coalesce(v.chunk_id, h.chunk_id) AS chunk_id,
    v.rank AS vector_rank, v.score AS vector_score, h.rank AS keyword_rank, h.score AS keyword_score
  FROM vhits v FULL JOIN hits h ON v.query_id = h.query_id AND v.chunk_id = h.chunk_id)"""


def fused(k: int = 5, source: str = "ev") -> str:
    return f"""
fu AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (
  SELECT *, coalesce(1.0::DOUBLE / (3 + vector_rank), 0) + coalesce(1.0::DOUBLE / (3 + keyword_rank), 0) AS score FROM {source})) WHERE rank <= {k})"""


SHOWN = "SELECT query_id, chunk_id, vector_rank, vector_score, keyword_rank, keyword_score, round(score, 12) AS score, rank FROM "

PAYLOAD = """
pay AS (SELECT doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, 'Document ' || doc_id AS doc_title,
  CASE WHEN lang = 'en' THEN '' ELSE lang END AS section, source || '.txt' AS source_path, text FROM documents)"""
LABEL = "CASE WHEN section <> '' THEN doc_title || ', ' || section ELSE doc_title END"

# --- approximate search ------------------------------------------------------------------------

CELLS = f"""
cent AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding AS c FROM (
  SELECT * FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM embeddings))),
cells AS MATERIALIZED (SELECT vec_id, embedding, CAST(cell AS INT) AS cell FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round({dot('embedding', 'c')}, 8) DESC, cell) AS near FROM embeddings, cent) WHERE near = 1)"""

# --- golden set --------------------------------------------------------------------------------

GOLDEN = f"""
hold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
expd AS (SELECT query_id, list(DISTINCT CAST(doc_id AS VARCHAR)) AS docs,
    coalesce(bool_or(toxic = 1), false) AS toxic, coalesce(bool_or(quality = 0), false) AS poor
  FROM hold LEFT JOIN labels USING (doc_id) GROUP BY query_id),
gold AS MATERIALIZED (SELECT item_id AS query_id, text AS question,
    CASE WHEN docs IS NULL THEN 'unanswerable' WHEN toxic THEN 'contradiction' WHEN poor THEN 'underspecified'
      WHEN len(docs) > 1 THEN 'multi_hop' ELSE 'factual' END AS type,
    CASE WHEN text[1] < 'N' THEN 'prose' ELSE 'code' END AS phrasing,
    CASE WHEN length(text) % 2 = 0 THEN 'original' ELSE 'extended' END AS cohort,
    coalesce(docs, []::VARCHAR[]) AS expected_documents,
    CASE WHEN docs IS NULL THEN []::VARCHAR[] ELSE string_split(text, ' ') END AS expected_facts,
    CASE WHEN docs IS NULL THEN []::VARCHAR[] ELSE ({sentences('text', 'gs')}) END AS anchors
  FROM benchmark LEFT JOIN expd ON query_id = item_id)"""


def results(hits: str, name: str, mode: bool = False) -> str:
    """CTE <name>: one row per answerable question (and mode) over ``hits`` (..., doc_id, text, rank)."""
    m = "mode, " if mode else ""
    asked = "(SELECT * FROM gold, (SELECT unnest(['hybrid', 'vector', 'keyword']) AS mode))" if mode else "gold"
    distinct = (
        "list_transform(list_filter(list_transform(range(1, len(docs) + 1), lambda i: {'d': docs[i], 'k': list_position(docs, docs[i]) = i}), "
        "lambda x: x.k), lambda x: x.d)"
    )
    return f"""
{name}l AS (SELECT {m}query_id, list(doc_id ORDER BY rank) AS docs, list({flat('text')} ORDER BY rank) AS texts FROM ({hits}) GROUP BY ALL),
{name}r AS (SELECT {m}query_id, type, phrasing, cohort, expected_documents AS e, anchors,
    CASE WHEN docs IS NULL THEN []::VARCHAR[] ELSE {distinct} END AS got,
    coalesce(array_to_string(texts, ' || '), '') AS seen
  FROM {asked} LEFT JOIN {name}l USING ({m}query_id) WHERE type <> 'unanswerable'),
{name} AS MATERIALIZED (SELECT {m}query_id, type, phrasing, cohort,
    len(list_intersect(e, got)) / len(e) AS recall,
    CASE WHEN len(list_intersect(e, got)) = len(e) THEN 1.0 ELSE 0.0 END::DOUBLE AS full_coverage,
    coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(e, lambda d: list_position(got, d)), lambda p: p > 0)), 0.0) AS mrr,
    len(list_filter(anchors, lambda a: contains(seen, {flat('a')}))) / len(anchors) AS anchor_recall,
    CASE WHEN len(list_filter(anchors, lambda a: contains(seen, {flat('a')}))) = len(anchors) THEN 1.0 ELSE 0.0 END::DOUBLE AS anchor_full,
    array_to_string(got, ',') AS retrieved_documents
  FROM {name}r)"""


METRICS = ("recall", "full_coverage", "mrr", "anchor_recall", "anchor_full")
MEANS = "count(*) AS questions, " + ", ".join(f"round(coalesce(avg({m}), 0.0), 9) AS {m}" for m in METRICS)
ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in METRICS)

# The stored orderings put candidates by a digest of question and candidate.
RERANKED = """
re AS MATERIALIZED (SELECT query_id, chunk_id, vector_rank, vector_score, keyword_rank, keyword_score, score,
    CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY md5(query_id || '/' || chunk_id), rank) AS place FROM fu) WHERE place <= 5)"""

# --- responses ---------------------------------------------------------------------------------

_MARKED = "replace(text, '. ', ' [' || (turn + 1) || ']. ') || ' [' || (conv_id % 9) || '] .'"
RESPONSES = f"""
resp AS (SELECT conv_id || '-' || turn AS query_id, CASE
    WHEN (conv_id + turn) % 11 = 7 THEN 'sorry: ' || text
    WHEN (conv_id + turn) % 11 = 8 THEN '[1, 2]'
    WHEN (conv_id + turn) % 11 = 9 THEN ' '
    ELSE '{{"answer": ' || CAST(to_json({_MARKED}) AS VARCHAR) || ', "citations": ' || CASE conv_id % 4
      WHEN 0 THEN '[' || turn || ', 3, 9]' WHEN 1 THEN '["2", 1, true, 7]' WHEN 2 THEN '[]' ELSE '[1.5, 4, ' || turn || ', null]' END
      || CASE conv_id % 5 WHEN 0 THEN ', "refused": true' WHEN 1 THEN ', "refused": "false"' WHEN 2 THEN ', "refused": 0'
        WHEN 3 THEN ', "refused": null' ELSE '' END
      || CASE WHEN turn % 2 = 0 THEN ', "conflict": true}}' ELSE ', "conflict": false}}' END END AS response
  FROM conversations)"""


def _truth(field: str) -> str:
    m = f"json_extract(j, '$.{field}')"
    return (
        f"coalesce(CASE json_type({m}) WHEN 'BOOLEAN' THEN {m}::VARCHAR = 'true' WHEN 'VARCHAR' THEN json_extract_string(j, '$.{field}') <> '' "
        f"WHEN 'NULL' THEN false WHEN 'ARRAY' THEN json_array_length({m}) > 0 WHEN 'OBJECT' THEN {m}::VARCHAR <> '{{}}' ELSE {m}::DOUBLE <> 0 END, false)"
    )


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\[(\\d+)\\]', 1), lambda n: n::BIGINT)"


def _first(lst: str, v: str) -> str:
    """Distinct members in the order of first occurrence."""
    keep = f"list_filter(range(1, len({v}) + 1), lambda {v}i: list_position({v}, {v}[{v}i]) = {v}i)"
    return let(lst, v, f"list_transform({keep}, lambda {v}j: {v}[{v}j])")


_STRIPPED = (
    "list_reduce(list_transform(invalid, lambda n: {'t': '', 'n': n}), lambda a, x: {'t': replace(a.t, '[' || x.n || ']', ''), 'n': x.n}, "
    "{'t': raw_text, 'n': 0::BIGINT}).t"
)
_TIDY = strip(f"replace(replace(regexp_replace({_STRIPPED}, '[ \\t]{{2,}}', ' ', 'g'), ' .', '.'), ' ,', ',')")
_MEMBERS = "json_extract(j, '$.citations[*]')"
VALIDATED = f"""
js AS (SELECT query_id, response, CASE WHEN json_valid(response) AND {strip('response')} <> '' THEN response::JSON END AS j FROM resp),
pr AS (SELECT query_id, CASE WHEN {strip('response')} = '' THEN 'empty response' WHEN j IS NULL THEN 'not JSON'
      WHEN json_type(j) <> 'OBJECT' THEN 'not a JSON object' END AS error,
    {strip("coalesce(json_extract_string(j, '$.answer'), '')")} AS raw_text,
    coalesce(list_sort(list_distinct(list_transform(list_filter({_MEMBERS}, lambda m: json_type(m) IN ('BIGINT', 'UBIGINT')),
      lambda m: m::VARCHAR::BIGINT))), []::BIGINT[]) AS declared,
    {_truth('refused')} AS refused, {_truth('conflict')} AS conflict FROM js),
iv AS (SELECT *, list_sort(list_filter(list_distinct(list_concat({_numbers('raw_text')}, declared)), lambda n: n < 1 OR n > {PASSAGES})) AS invalid FROM pr),
tx AS (SELECT *, CASE WHEN len(invalid) = 0 THEN raw_text ELSE {_TIDY} END AS text FROM iv),
va AS MATERIALIZED (SELECT query_id, text, {_first(f"list_filter(list_concat({_numbers('text')}, declared), lambda n: n >= 1 AND n <= {PASSAGES})", 'o')} AS citations,
    invalid, refused, conflict, len(invalid) = 0 AS grounded, error FROM tx)"""

CITED = f"""
conv_hits AS (SELECT query_id, r AS rank, c + r * 2 % 3 AS chunk_id FROM (
    SELECT conv_id || '-' || turn AS query_id, conv_id AS c, unnest(range(1, {PASSAGES + 1})) AS r FROM conversations)),
cs AS MATERIALIZED (SELECT v.query_id, CAST(place AS INT) AS place, CAST(number AS INT) AS number,
    '[' || number || '] ' || {LABEL} || ' (' || source_path || ')' AS label, doc_id FROM (
    SELECT query_id, unnest(citations) AS number, unnest(range(0, len(citations))) AS place FROM va WHERE error IS NULL) v
  JOIN conv_hits h ON h.query_id = v.query_id AND h.rank = v.number JOIN pay USING (chunk_id))"""

_KINDS = "['factual', 'multi_hop', 'contradiction', 'underspecified', 'unanswerable']"
ANSWERED = f"""
rq AS (SELECT conv_id || '-' || turn AS query_id, {_KINDS}[(conv_id + turn) % 5 + 1] AS type,
    CASE WHEN role = 'system' THEN []::VARCHAR[] ELSE list_append(string_split(text, ' '), '[1]') END AS facts FROM conversations),
an AS MATERIALIZED (SELECT query_id, type, refused, conflict, grounded, len(citations) AS citation_count,
    len(list_filter(facts, lambda f: contains(lower(text), lower(f)))) AS facts_found, len(facts) AS facts_expected,
    refused <> (type <> 'unanswerable') AS refusal_correct
  FROM va JOIN rq USING (query_id) WHERE error IS NULL)"""

# --- stored state ------------------------------------------------------------------------------

KEYED = f"keyed AS (SELECT doc_id, text, sha256('{MODEL}|RETRIEVAL_DOCUMENT|' || text) AS key FROM documents)"
CACHE = f"""
{KEYED},
cache AS (SELECT key, arg_min(CASE WHEN label = 0 THEN embedding[1:10] ELSE embedding END, doc_id) AS vector
  FROM keyed JOIN embeddings ON vec_id = doc_id GROUP BY key),
usable AS (SELECT key FROM cache WHERE len(vector) = 64)"""


def _rate(flag: str, group: str) -> str:
    return f"round(coalesce(avg(CASE WHEN {group} THEN ({flag})::INT::DOUBLE END), 0.0), 9)"


_ANSWERABLE = "type <> 'unanswerable'"


# Lengths and counts that Spark gives as 32-bit integers.
_INTS = {
    "sentence_stats": ("sentences", "longest"),
    "document_titles": ("chars",),
    "sentence_fit": ("chars",),
    "chunk_notes": ("chars",),
    "chunk_orders": ("chars",),
    "chunk_plain": ("chars",),
    "chunk_size_report": ("min_chars", "median_chars", "max_chars"),
    "rerank_keys": ("candidates",),
    "rerank_prompts": ("chars",),
    "answer_prompts": ("chars",),
    "answer_results": ("citation_count", "facts_found", "facts_expected"),
    "cache_misses": ("chars",),
    "paired_vectors": ("dim",),
}


def _typed(name: str, sql: str) -> str:
    columns = _INTS.get(name)
    if not columns:
        return sql
    casts = ", ".join(f"CAST({c} AS INT) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["tokenize_terms"] = f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS term FROM documents) GROUP BY term"
    q["compound_tokens"] = f"""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents)
      WHERE regexp_matches(token, '[-./]') GROUP BY ALL"""
    q["sentence_stats"] = f"""SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest,
      md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {sentences('text', 'sv')} AS s FROM documents)"""
    q["normalise_text"] = f"SELECT doc_id, title, source_path, fmt, md5(text) AS digest FROM ({files(NOTES_RAW)})"
    q["document_titles"] = f"SELECT doc_id, title, fmt, length(text) AS chars FROM ({files(ORDERS_RAW)})"
    q["flatten_preview"] = f"""SELECT doc_id, CASE WHEN length(f) <= 96 THEN f ELSE f[1:93] || '...' END AS preview, md5(f) AS digest
      FROM (SELECT doc_id, {flat('text')} AS f FROM documents)"""
    q["code_phrasing"] = f"""SELECT source_path, regexp_matches(raw, '(HCS-[A-Z]{{2,4}}-\\d{{4}}|[A-Z]{{3}}-[A-Z]{{3}}(-\\d+)?|clause \\d)') AS code
      FROM ({ORDERS_RAW})"""
    q["short_ids"] = f"""SELECT doc_id, {short('doc_id')} AS short FROM (SELECT CASE s_nationkey % 3 WHEN 0 THEN 'onboarding_supplier_'
      WHEN 1 THEN 'internal_faq_procurement_' ELSE 'supplier_framework_agreement_' END || s_suppkey AS doc_id FROM supplier)"""
    q["retry_policy"] = r"""SELECT event_id,
      (contains(message, 'RESOURCE_EXHAUSTED') OR contains(message, '429')) OR NOT (contains(message, '400 ') OR contains(message, '401 ')
        OR contains(message, '403 ') OR contains(message, '404 ') OR contains(message, 'INVALID_ARGUMENT')) AS retryable,
      CASE WHEN s = '' THEN 0.0 ELSE least(s::DOUBLE + 0.5, 90.0) END AS delay
      FROM (SELECT *, regexp_extract(message, '(?i)retry(?:Delay''?:?\s*''?| in )\s*([0-9]+(?:\.[0-9]+)?)s', 1) AS s FROM (
        SELECT event_id, CASE event_id % 6 WHEN 0 THEN '429 RESOURCE_EXHAUSTED {''retryDelay'': ''' || user_id || 's''}'
          WHEN 1 THEN 'Please Retry in ' || user_id || '.25s' WHEN 2 THEN '404 model not found'
          WHEN 3 THEN 'INVALID_ARGUMENT 429 ' || event_type WHEN 4 THEN '503 unavailable ' || event_type
          ELSE '400 bad ' || props END AS message FROM events))"""

    both_files = f"{files(NOTES_RAW)} UNION ALL {files(ORDERS_RAW)}"
    q["section_split"] = f"SELECT doc_id, CAST(n - 1 AS INT) AS n, heading, md5(body) AS digest FROM ({sections(both_files)})"
    q["table_lines"] = f"""SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {table_line('line')}) AS table_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM ({files(ORDERS_RAW)})) GROUP BY doc_id"""
    q["block_split"] = f"""SELECT doc_id, CAST(n AS INT) AS n, b.atomic AS atomic, md5(b.text) AS digest FROM (
      SELECT doc_id, unnest(bs) AS b, unnest(range(0, len(bs))) AS n FROM (SELECT doc_id, {blocks('text')} AS bs FROM ({files(ORDERS_RAW)})))"""
    q["sentence_fit"] = f"""SELECT doc_id, CAST(n AS INT) AS n, length(piece) AS chars, md5(piece) AS digest FROM (
      SELECT doc_id, unnest(ps) AS piece, unnest(range(0, len(ps))) AS n FROM (SELECT doc_id, {fit('text', 'f')} AS ps FROM documents))"""
    q["chunk_notes"] = chunk_rows(files(NOTES_RAW))
    q["chunk_orders"] = chunk_rows(files(ORDERS_RAW))
    q["chunk_plain"] = chunk_rows(PLAIN)
    q["chunk_size_report"] = f"""SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, min(length(text)) AS min_chars,
      list_sort(list(length(text)))[count(*) // 2 + 1] AS median_chars, max(length(text)) AS max_chars FROM ({chunks(files(NOTES_RAW))})"""

    q["bm25_terms"] = f"WITH {bm25(DOCS)} SELECT term, df, round(idf, 8) AS idf FROM idf"
    q["bm25_topk"] = f"WITH {bm25(DOCS)} SELECT * FROM hits"
    q["bm25_postings"] = q["bm25_topk"]
    q["bm25_grid"] = q["bm25_topk"]
    q["bm25_stored"] = q["bm25_topk"]
    q["bm25_pruned"] = q["bm25_topk"]
    q["bm25_chunks"] = f"WITH {bm25(f'SELECT chunk_id, index_text AS text FROM ({chunks(PLAIN)})')} SELECT * FROM hits"

    q["vector_norms"] = f"""SELECT vec_id AS chunk_id, round(n, 6) AS norm, abs(n - 1) <= 1e-3 + 1e-5 AS unit, abs(2 * n - 1) <= 1e-3 + 1e-5 AS doubled_unit,
      round((embedding[1]::DOUBLE / n)::FLOAT::DOUBLE, 7) AS first, round({dot('embedding', 'list_reverse(embedding)')}, 6) AS mirrored
      FROM (SELECT *, sqrt({dot('embedding', 'embedding')}) AS n FROM embeddings)"""
    q["vector_topk"] = f"WITH {vector_hits()} SELECT * FROM vhits"
    q["stored_topk"] = q["vector_topk"]
    q["vector_neighbours"] = f"""SELECT * FROM (SELECT query_id, chunk_id, score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round({dot('e.embedding', 'q.embedding')}, 8) AS score FROM embeddings q, embeddings e)) WHERE rank <= 10"""
    q["vector_neighbours_grid"] = q["vector_neighbours"]
    q["ann_cells"] = f"WITH {CELLS} SELECT cell, count(*) AS n FROM cells GROUP BY cell"
    q["ann_topk"] = q["vector_topk"]
    q["ann_deltas"] = """SELECT vec_id AS chunk_id, round(CASE WHEN vec_id % 3 = 0 AND vec_id % 6 <> 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first
      FROM embeddings WHERE vec_id % 7 <> 5"""
    q["ann_topk_grid"] = q["ann_topk"]

    vector_only = "(SELECT query_id, chunk_id, rank AS vector_rank, score AS vector_score, NULL::INT AS keyword_rank, NULL::DOUBLE AS keyword_score FROM vhits)"
    keyword_only = "(SELECT query_id, chunk_id, NULL::INT AS vector_rank, NULL::DOUBLE AS vector_score, rank AS keyword_rank, score AS keyword_score FROM hits)"
    q["hybrid_rrf"] = f"WITH {BOTH},{EVIDENCE},{fused()} {SHOWN} fu"
    q["mode_vector"] = f"WITH {vector_hits()},{fused(source=vector_only)} {SHOWN} fu"
    q["mode_keyword"] = f"WITH {bm25(DOCS)},{fused(source=keyword_only)} {SHOWN} fu"
    q["rrf_sweep"] = f"""WITH {BOTH},{EVIDENCE} SELECT constant, query_id, chunk_id, round(score, 12) AS score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY constant, query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (
        SELECT *, coalesce(1.0::DOUBLE / (constant + vector_rank), 0) + coalesce(1.0::DOUBLE / (constant + keyword_rank), 0) AS score
        FROM ev, (SELECT unnest([1, 3, 5, 10, 20, 60]) AS constant))) WHERE rank <= 5"""
    q["evidence_table"] = f"""WITH {BOTH},{EVIDENCE},{fused()},{PAYLOAD} SELECT query_id, rank AS position, source_path AS document,
      CASE WHEN section = '' THEN '(document header)' ELSE section END AS section,
      CASE WHEN vector_score IS NULL THEN '-' ELSE printf('%.3f', vector_score) END AS cosine,
      coalesce(vector_rank::VARCHAR, '-') AS vector_rank, coalesce(keyword_rank::VARCHAR, '-') AS keyword_rank,
      printf('%.4f', score) AS fused_score, CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'both'
        WHEN vector_rank IS NOT NULL THEN 'vector only' ELSE 'BM25 only' END AS found_by FROM fu JOIN pay USING (chunk_id)"""
    q["found_paths"] = f"""WITH {BOTH},{EVIDENCE},{fused(20)} SELECT query_id, chunk_id,
      concat_ws('+', 'vector#' || vector_rank, 'bm25#' || keyword_rank) AS paths FROM fu"""

    q["rerank_apply"] = f"WITH {BOTH},{EVIDENCE},{fused(20)},{RERANKED} {SHOWN} re"
    q["rerank_keys"] = f"""WITH {bm25(DOCS)} SELECT query_id, sha256('{MODEL}|' || sha256('{PROMPT}')[1:12] || '|' || text || '|' || ids) AS key, n AS candidates
      FROM (SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS ids, count(*) AS n FROM hits GROUP BY query_id) JOIN benchmark ON item_id = query_id"""
    q["ranking_repair"] = f"""WITH r AS (SELECT conv_id || '-' || turn AS key,
        json_extract(('{{"ranking": [' || (conv_id % 7 + 1) || ', ' || turn || ', ' || (conv_id % 7 + 1) || ', true, "2", 2.5, 0, ' || ((conv_id + turn) % 6 + 1) || ']}}')::JSON, '$.ranking[*]') AS m
        FROM conversations),
      k AS (SELECT key, {_first("list_filter(list_transform(list_filter(m, lambda x: json_type(x) IN ('BIGINT', 'UBIGINT')), lambda x: x::VARCHAR::BIGINT - 1), lambda p: p >= 0 AND p < 6)", 'w')} AS named FROM r),
      o AS (SELECT key, list_concat(named, list_filter(range(0, 6), lambda p: NOT list_contains(named, p))) AS o FROM k)
      SELECT key, array_to_string(o, ',') AS "order", list_sort(o) = range(0, 6) AS whole FROM o"""
    q["rerank_prompts"] = f"""WITH {bm25(DOCS)},{PAYLOAD} SELECT query_id, length(p) AS chars, md5(p) AS digest FROM (
      SELECT query_id, 'Question: ' || b.text || E'\\n\\nPassages:\\n\\n' || ctx AS p FROM (
        SELECT query_id, string_agg('[' || rank || '] ' || {LABEL} || chr(10) || text, E'\\n\\n' ORDER BY rank) AS ctx FROM hits JOIN pay USING (chunk_id) GROUP BY query_id)
      JOIN benchmark b ON item_id = query_id)"""

    context = f"string_agg('[' || rank || '] ' || {LABEL} || ' (source: ' || source_path || ')' || chr(10) || text, E'\\n\\n' ORDER BY rank)"
    q["context_blocks"] = f"WITH {bm25(DOCS, 5)},{PAYLOAD} SELECT query_id, md5({context}) AS digest FROM hits JOIN pay USING (chunk_id) GROUP BY query_id"
    q["context_stored"] = q["context_blocks"]
    q["answer_prompts"] = f"""WITH {vector_hits(5)},{PAYLOAD} SELECT query_id, length(p) AS chars, md5(p) AS digest FROM (
      SELECT b.item_id AS query_id, E'Context passages:\\n\\n' || coalesce(ctx, '(no passages were retrieved)') || E'\\n\\nQuestion: ' || b.text AS p
      FROM benchmark b LEFT JOIN (SELECT query_id, {context} AS ctx FROM vhits JOIN pay USING (chunk_id) GROUP BY query_id) ON item_id = query_id)"""
    q["citation_validate"] = f"""WITH {RESPONSES},{VALIDATED} SELECT query_id, md5(text) AS digest, array_to_string(citations, ',') AS citations,
      array_to_string(invalid, ',') AS invalid_citations, refused, conflict, grounded, coalesce(error, '') AS error FROM va"""
    q["citation_highlight"] = f"""WITH {RESPONSES},{VALIDATED} SELECT query_id,
      md5(regexp_replace(text, '\\[(\\d+)\\]', ':blue-background[**[\\1]**]', 'g')) AS digest FROM va"""
    q["cited_sources"] = f"WITH {RESPONSES},{VALIDATED},{PAYLOAD},{CITED} SELECT * FROM cs"
    q["cited_documents"] = f"""WITH {RESPONSES},{VALIDATED},{PAYLOAD},{CITED} SELECT query_id, string_agg(doc_id, ',' ORDER BY p) AS cited_documents
      FROM (SELECT query_id, doc_id, min(place) AS p FROM cs GROUP BY ALL) GROUP BY query_id"""

    q["golden_questions"] = f"""WITH {GOLDEN} SELECT query_id, type, phrasing, cohort, CAST(len(expected_documents) AS BIGINT) AS expected,
      md5(array_to_string(anchors, '|')) AS anchors, md5(array_to_string(expected_facts, '|')) AS expected_facts FROM gold"""
    q["golden_documents"] = "SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"
    q["golden_problems"] = f"""WITH {GOLDEN}, dm AS (SELECT query_id, CASE WHEN cohort = 'extended' THEN 'unanswerable' ELSE type END AS type, expected_documents,
        CASE WHEN phrasing = 'code' THEN []::VARCHAR[] ELSE anchors END AS anchors, unnest(range(0, length(question) % 3 + 1)) AS copy FROM gold)
      SELECT query_id, problem FROM (SELECT query_id, CASE
        WHEN {_ANSWERABLE} AND len(expected_documents) = 0 THEN 'answerable, but names no expected document'
        WHEN NOT {_ANSWERABLE} AND len(expected_documents) > 0 THEN 'unanswerable, but names expected documents'
        WHEN {_ANSWERABLE} AND len(anchors) = 0 THEN 'answerable, but has no anchor text'
        WHEN NOT {_ANSWERABLE} AND len(anchors) > 0 THEN 'unanswerable, but has anchor texts' END AS problem FROM dm) WHERE problem IS NOT NULL
      UNION ALL SELECT query_id, 'duplicate question id' FROM dm GROUP BY query_id HAVING count(*) > 1"""

    scored = f"{BOTH},{EVIDENCE},{fused()},{PAYLOAD},{GOLDEN},{results('SELECT * FROM fu JOIN pay USING (chunk_id)', 'rr')}"
    q["retrieval_results"] = f"WITH {scored} SELECT query_id, type, phrasing, cohort, {ROUNDED}, retrieved_documents FROM rr"
    q["retrieval_summary"] = f"WITH {scored} SELECT {MEANS} FROM rr"
    q["retrieval_breakdown"] = f"""WITH {BOTH},{EVIDENCE},{PAYLOAD},{GOLDEN},
      md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT mode, query_id, chunk_id, CASE WHEN mode <> 'keyword' THEN coalesce(1.0::DOUBLE / (3 + vector_rank), 0) ELSE 0 END
          + CASE WHEN mode <> 'vector' THEN coalesce(1.0::DOUBLE / (3 + keyword_rank), 0) ELSE 0 END AS score
        FROM ev, (SELECT unnest(['hybrid', 'vector', 'keyword']) AS mode)) WHERE score > 0) WHERE rank <= 5),
      {results('SELECT * FROM md JOIN pay USING (chunk_id)', 'rr', mode=True)}
      SELECT mode, CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(cohort) = 0 THEN 'cohort' WHEN grouping(phrasing) = 0 THEN 'phrasing' ELSE 'all' END AS axis,
        coalesce(type, cohort, phrasing, 'all') AS value, {MEANS} FROM rr GROUP BY GROUPING SETS ((mode), (mode, type), (mode, cohort), (mode, phrasing))"""
    compared = (
        f"{BOTH},{EVIDENCE},{fused(20)},{RERANKED},{PAYLOAD},{GOLDEN},"
        f"{results('SELECT * FROM fu JOIN pay USING (chunk_id) WHERE rank <= 5', 'bef')},{results('SELECT * FROM re JOIN pay USING (chunk_id)', 'aft')}"
    )
    q["rerank_comparison"] = f"WITH {compared} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(b, 9) AS before, round(a, 9) AS after, round(a - b, 9) AS change FROM (SELECT coalesce(avg({m}), 0.0) AS b FROM bef), (SELECT coalesce(avg({m}), 0.0) AS a FROM aft)"
        for m in METRICS
    )
    q["moved_questions"] = f"""WITH {compared} SELECT query_id, round(bef.anchor_recall, 9) AS before, round(aft.anchor_recall, 9) AS after,
      CASE WHEN aft.anchor_recall > bef.anchor_recall THEN 'recovered' ELSE 'LOST' END AS direction
      FROM bef JOIN aft USING (query_id) WHERE bef.anchor_recall <> aft.anchor_recall"""
    q["answer_results"] = f"WITH {RESPONSES},{VALIDATED},{ANSWERED} SELECT * FROM an"
    plain = f"{_ANSWERABLE} AND type NOT IN ('contradiction', 'underspecified')"
    q["answer_summary"] = f"""WITH {RESPONSES},{VALIDATED},{ANSWERED} SELECT count(*) AS questions, {_rate('grounded', 'true')} AS citation_validity,
      {_rate('refused', "type = 'unanswerable'")} AS refusal_accuracy, {_rate('refused', _ANSWERABLE)} AS false_refusal_rate,
      {_rate('conflict', "type = 'contradiction'")} AS conflict_detection, {_rate('conflict', plain)} AS false_conflict_rate,
      {_rate('facts_found = facts_expected', f'{_ANSWERABLE} AND facts_expected > 0')} AS fact_coverage,
      count(*) FILTER (WHERE type = 'unanswerable') AS unanswerable_questions, count(*) FILTER (WHERE {_ANSWERABLE}) AS answerable_questions FROM an"""
    q["question_counts"] = f"WITH {GOLDEN} SELECT type, count(*) AS questions, count(*) FILTER (WHERE {_ANSWERABLE}) AS answerable FROM gold GROUP BY type"

    q["cache_keys"] = f"WITH {KEYED} SELECT doc_id, key FROM keyed"
    q["cache_report"] = f"""WITH {CACHE} SELECT count(*) AS texts, count(u.key) AS cache_hits, count(*) - count(u.key) AS cache_misses,
      CAST(ceil((count(*) - count(u.key)) / 100) AS BIGINT) AS calls FROM keyed k LEFT JOIN usable u ON u.key = k.key"""
    q["cache_vectors"] = f"""WITH {CACHE} SELECT doc_id, round(vector[1]::DOUBLE, 7) AS first
      FROM keyed k LEFT JOIN (SELECT key, vector FROM cache WHERE len(vector) = 64) c ON c.key = k.key"""
    q["cache_misses"] = f"WITH {CACHE} SELECT DISTINCT key, length(text) AS chars FROM keyed WHERE key NOT IN (SELECT key FROM usable)"
    q["upsert_repeated"] = """SELECT doc_id, source AS role FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
      UNION ALL SELECT conv_id, max(role || '-' || turn) FROM conversations GROUP BY conv_id"""
    big = "99999999999999999999"
    removed = f"CASE WHEN n > {PASSAGES} THEN replace(replace(raw, '[{big}]', ''), '[' || n || ']', '') ELSE replace(raw, '[{big}]', '') END"
    tidy = strip(f"replace(replace(regexp_replace({removed}, '[ \\t]{{2,}}', ' ', 'g'), ' .', '.'), ' ,', ',')")
    far = f"CASE WHEN n > {PASSAGES} THEN [n] ELSE []::BIGINT[] END"
    near = "CASE WHEN d = 0 THEN [0] ELSE []::BIGINT[] END"
    high = f"CASE WHEN d > {PASSAGES} AND d <> n THEN [d] ELSE []::BIGINT[] END"
    q["citation_numbers_any_size"] = f"""WITH a AS (
      SELECT conv_id || '-' || turn AS query_id, {strip(f"text || ' see [{big}] and [' || (turn + 1) || ']'")} AS raw, turn + 1 AS n, conv_id % 7 AS d FROM conversations)
      SELECT query_id, md5({tidy}) AS digest, array_to_string(list_concat(
          CASE WHEN n <= {PASSAGES} THEN [n] ELSE []::BIGINT[] END,
          CASE WHEN d BETWEEN 1 AND {PASSAGES} AND d <> n THEN [d] ELSE []::BIGINT[] END), ',') AS citations,
        array_to_string(list_concat({near}, list_sort(list_concat({far}, {high}))), ',')
          || CASE WHEN d = 0 OR n > {PASSAGES} OR d > {PASSAGES} THEN ',' ELSE '' END || '18446744073709551616,{big}' AS invalid_citations,
        false AS grounded FROM a"""
    q["upsert_latest"] = """SELECT conv_id, turn, role, md5(text) AS digest FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"""
    q["upsert_merge"] = """SELECT doc_id, md5(text) AS digest, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT doc_id, md5('relabelled'), 'labels' FROM labels"""
    q["paired_vectors"] = f"""SELECT vec_id AS chunk_id, lang, len(embedding) AS dim, round(sqrt({dot('embedding', 'embedding')}), 6) AS norm
      FROM embeddings JOIN documents ON doc_id = vec_id"""
    return {name: _typed(name, sql) for name, sql in q.items()}
