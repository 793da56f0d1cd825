"""The named queries in SQL, written from their definitions, to compare results with."""

from __future__ import annotations

from corvane.functions.text import ACCENTED, PLAIN

NL = "chr(10)"
PATH = "lang || '/' || source || '/doc_' || doc_id"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", f"' || {NL} || '") + "'"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def _vault() -> str:
    from .views import CODE, HAN, MATH

    return f"""vault AS (SELECT doc_id, {PATH} || '.md' AS relative_path,
        '# ' || source || {NL} || {NL} || '## ' || lang || {NL} || replace(text, {NL}, {NL} || {NL})
        || CASE WHEN doc_id % 7 = 0 THEN {_text(CODE)} ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN {_text(MATH)} ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN {_text(HAN)} ELSE '' END AS content FROM documents)"""


VAULT = _vault()


def _terms(column: str) -> str:
    apart = rf"regexp_replace({column}, '(\p{{Han}}+)', ' \1 ', 'g')"
    words = rf"regexp_extract_all({apart}, '\p{{Han}}+|[\p{{L}}\p{{N}}]+')"
    chars = "string_split(w, '')"
    pairs = "list_transform(range(1, length(w)), lambda i: substr(w, i, 2))"
    return f"""flatten(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '\\p{{Han}}') THEN list_concat({chars}, {pairs})
        ELSE [translate(lower(w), '{ACCENTED}', '{PLAIN}')] END))"""


TRIM = r"regexp_replace({0}, '^[\s\x0B\x{{00A0}}\x{{FEFF}}\x{{3000}}]+|[\s\x0B\x{{00A0}}\x{{FEFF}}\x{{3000}}]+$', '', 'g')"
CHUNKS = f"""plain AS (SELECT doc_id, {PATH} || '.md' AS relative_path, 1 AS start_line, text AS content FROM documents)"""
VECTORS = f"""vecs AS (SELECT doc_id, {PATH} || '.md' AS relative_path, 1 AS start_line, CASE WHEN doc_id % 13 <> 0 THEN embedding END AS embedding
    FROM documents JOIN embeddings ON vec_id = doc_id * 7 % (SELECT greatest(1, count(*)) FROM embeddings))"""
INDEXED = f"""indexed AS (SELECT relative_path, start_line, content, {_terms("content || ' Root ' || relative_path")} AS terms FROM plain)"""
PHRASES = """phrases(k, words) AS (VALUES (1, ['onthe']), (2, ['apache', 'license']), (3, ['eeaux']), (4, ['password']))"""
BM25 = f"""{CHUNKS}, {INDEXED}, {PHRASES},
    tf AS (SELECT relative_path, start_line, len(terms) AS dl, k,
        len(list_filter(range(1, len(terms) - len(words) + 2), lambda i: terms[i:i + len(words) - 1] = words)) AS f FROM indexed, phrases),
    figures AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM indexed),
    having_it AS (SELECT k, count(*) FILTER (f > 0) AS c FROM tf GROUP BY k),
    scored AS (SELECT relative_path, start_line, sum(
        (CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
        FROM tf JOIN having_it USING (k), figures WHERE f > 0 GROUP BY ALL)"""
QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)"
NEAR = f"""{VECTORS}, near AS (SELECT relative_path, start_line, list_dot_product(embedding::DOUBLE[], {QUERY_VECTOR}) AS vector_score
    FROM vecs WHERE embedding IS NOT NULL)"""
FUSED = f"""{BM25}, {NEAR},
    kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, relative_path, start_line) AS a FROM scored QUALIFY a <= 20),
    vec AS (SELECT *, row_number() OVER (ORDER BY vector_score DESC, relative_path, start_line) AS b FROM near QUALIFY b <= 20),
    fused AS (SELECT relative_path, start_line, coalesce(1.0 / (60 + a), 0) + coalesce(1.0 / (60 + b), 0) AS rrf, -kw.score AS bm25_rank, vector_score, a, b,
        CASE WHEN a IS NULL THEN 'vector' WHEN b IS NULL THEN 'bm25' ELSE 'hybrid' END AS match_type FROM kw FULL JOIN vec USING (relative_path, start_line)),
    best AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, a NULLS LAST, b) AS ordinal FROM fused QUALIFY ordinal <= 10)"""
STORED = """stored AS (SELECT doc_id, relative_path, 'markdown' AS file_type, CASE WHEN doc_id % 4 = 0 THEN 'x.pdf' END AS original_pdf,
    CAST(0 AS BIGINT) AS mtime, CAST(0 AS BIGINT) AS created_at, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256(content) END AS content_hash,
    CASE WHEN doc_id % 7 = 0 THEN '0' ELSE '1' END AS index_version, doc_id % 3 <> 0 AS vectors_complete FROM vault WHERE doc_id % 10 < 8)"""
SCANNED = """scanned AS (SELECT doc_id, relative_path, content, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'x.pdf' END AS original_pdf
    FROM vault WHERE doc_id % 10 <> 1)"""
PLAN = """plan AS (SELECT coalesce(s.relative_path, d.relative_path) AS relative_path, CASE WHEN s.relative_path IS NULL THEN 'deleted'
    WHEN d.content_hash = sha256(s.content) AND d.index_version = '1' AND d.original_pdf IS NOT DISTINCT FROM s.original_pdf AND d.vectors_complete THEN 'skipped'
    ELSE 'updated' END AS action FROM scanned s FULL JOIN stored d USING (relative_path))"""
CHANGES = r"""changes AS (SELECT CASE user_id % 4 WHEN 0 THEN 'u' || user_id || '.md' WHEN 1 THEN 'u' || user_id || '.PDF' WHEN 2 THEN 'build/u' || user_id || '.md'
    ELSE 'u' || user_id || '\a.py' END AS path, event_id AS revision, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS op FROM events)"""
# One row for each line; what a line does follows from the state before it.
LINES = rf"""split AS (SELECT relative_path AS p, string_split_regex(content, '\r?\n') AS l FROM vault),
    lines AS (SELECT p, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM split),
    seen AS (SELECT p, n, i, {TRIM.format('line')} AS bare, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 1) AS mark,
        trim(regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 2)) AS rest, regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 1) AS hashes,
        trim(regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 2)) AS title, length(line) + 1 AS size FROM lines),
    state AS (
        SELECT p, max(n) AS n, CAST(0 AS BIGINT) AS i, '' AS fence, false AS math, CAST(0 AS BIGINT) AS held, CAST(1 AS BIGINT) AS start,
            CAST([] AS STRUCT(level BIGINT, title VARCHAR)[]) AS trail, CAST(0 AS BIGINT) AS was_start, CAST([] AS STRUCT(level BIGINT, title VARCHAR)[]) AS was_trail, 'none' AS kind
        FROM lines GROUP BY p
        UNION ALL
        SELECT p, n, i,
            CASE WHEN kind = 'fence' THEN CASE WHEN fence = '' THEN mark ELSE '' END ELSE fence END,
            CASE WHEN kind = 'math' AND NOT (length(bare) > 2 AND ends_with(bare, '$$')) THEN NOT math ELSE math END,
            CASE WHEN kind = 'heading' THEN size WHEN kind = 'cut' THEN 0 ELSE held + size END,
            CASE WHEN kind = 'heading' THEN i WHEN kind = 'cut' THEN i + 1 ELSE start END,
            CASE WHEN kind = 'heading' THEN list_append(list_filter(trail, lambda t: t.level < length(hashes)), {{'level': length(hashes), 'title': title}}) ELSE trail END,
            start, trail, kind
        FROM (SELECT f.*, s.fence, s.math, s.held, s.start, s.trail, CASE
                WHEN NOT math AND mark <> '' AND (fence = '' OR (mark[1] = fence[1] AND length(mark) >= length(fence) AND rest = '')) THEN 'fence'
                WHEN fence = '' AND starts_with(bare, '$$') THEN 'math'
                WHEN fence = '' AND NOT math AND hashes <> '' THEN 'heading'
                WHEN fence = '' AND NOT math AND bare = '' AND held + size >= 800 THEN 'cut' ELSE 'text' END AS kind
              FROM state s JOIN seen f ON f.p = s.p AND f.i = s.i + 1)),
    cuts AS (
        SELECT p, was_start AS a, i - 1 AS b, was_trail AS trail FROM state WHERE kind = 'heading' AND was_start < i
        UNION ALL SELECT p, was_start, i, was_trail FROM state WHERE kind = 'cut'
        UNION ALL SELECT p, start, n, trail FROM state WHERE i = n AND start <= n),
    chunks AS (SELECT p AS relative_path, coalesce(nullif(array_to_string(list_transform(trail, lambda t: t.title), ' > '), ''), 'Root') AS heading_path,
        CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, {TRIM.format(f'array_to_string(l[a:b], {NL})')} AS content FROM cuts JOIN split USING (p))"""


def _paths() -> str:
    from .registry import PATHS

    rows = ", ".join("('" + p.replace("'", "''") + "')" for p in PATHS)
    return f"paths(path) AS (VALUES {rows})"


def _limits() -> str:
    from .registry import LIMITS

    return "limits(id, l) AS (VALUES " + ", ".join(f"({i}, CAST({v} AS DOUBLE[]))" for i, v in LIMITS) + ")"


IGNORED = "['node_modules', 'images', 'assets', '_assets', 'dist', 'build', 'slprj', 'model']"
SUPPORTED = "['.md', '.markdown', '.txt', '.c', '.h', '.cpp', '.py', '.js', '.ts', '.m']"


def _ignored(p: str) -> str:
    return f"len(list_filter(string_split_regex({p}, '[\\\\/]+'), lambda x: starts_with(x, '.') OR list_contains({IGNORED}, lower(x)))) > 0"


def _ext(p: str) -> str:
    return f"lower(regexp_extract(string_split_regex({p}, '[\\\\/]')[-1], '^.+(\\.[^.]*)$', 1))"


def build() -> dict[str, str]:
    ext = _ext("path")
    out = {
        "hybrid_rrf": _with(FUSED) + """SELECT relative_path, start_line, round(rrf, 6) AS score, match_type, round(bm25_rank, 6) AS bm25_rank,
            round(vector_score, 6) AS vector_score, CAST(length(content) AS INTEGER) AS content_length FROM best JOIN plain USING (relative_path, start_line)""",
        "bm25_topk": _with(BM25) + "SELECT relative_path, start_line, round(score, 6) AS score, round(-score, 6) AS bm25_rank FROM scored ORDER BY scored.score DESC, 1, 2 LIMIT 10",
        "bm25_only_fallback": _with(BM25) + "SELECT relative_path, start_line, round(score, 6) AS score, 'bm25' AS match_type FROM scored ORDER BY scored.score DESC, 1, 2 LIMIT 5",
        "vector_topk": _with(NEAR) + "SELECT relative_path, start_line, round(vector_score, 6) AS vector_score FROM near ORDER BY near.vector_score DESC, 1, 2 LIMIT 10",
        "keyword_or": _with(BM25) + "SELECT relative_path, CAST(max(f) AS INTEGER) AS most FROM tf WHERE k < 3 AND f > 0 GROUP BY 1",
        "han_bigram_and": _with(VAULT) + f"""SELECT relative_path FROM vault WHERE list_has_all({_terms('content')}, ['检索', '索引', '引擎', '擎分', '分词'])
            UNION ALL SELECT relative_path FROM vault WHERE list_has_all({_terms('content')}, ['中文']) OR list_has_any({_terms('content')}, ['api'])
            OR list_has_all({_terms('content')}, ['混合', '合检', '检索'])""",
        "tokenize_terms": _with(VAULT) + f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('content')}) AS term FROM vault) GROUP BY ALL",
        "search_text_ngrams": _with(VAULT) + rf"""SELECT relative_path, array_to_string(list_filter({_terms("content || ' ' || relative_path")},
            lambda t: regexp_matches(t, '\p{{Han}}')), ' ') AS han_terms FROM vault""",
        "chunk_documents": _with(VAULT, LINES) + "SELECT relative_path, heading_path, start_line, end_line, sha256(content) AS content_sha256 FROM chunks WHERE content <> ''",
        "heading_breadcrumbs": _with(VAULT, LINES) + "SELECT heading_path, count(*) AS chunks, min(start_line) AS first_line FROM chunks WHERE content <> '' GROUP BY 1",
        "read_line_range": _with(VAULT, rf"cut AS (SELECT relative_path, string_split_regex(content, '\r?\n') AS l FROM vault)")
        + f"SELECT relative_path, array_to_string(l[2:5], {NL}) AS lines, CAST(length(coalesce(array_to_string(l[4:], {NL}), '')) AS INTEGER) AS rest FROM cut",
        "scan_supported_files": _with(_paths()) + f"""SELECT path, {_ignored('path')} AS ignored, NOT ({_ignored('path')}) AND list_contains({SUPPORTED}, {ext}) AS supported,
            CASE WHEN {ext} IN ('.md', '.markdown') THEN 'markdown' ELSE 'code' END AS file_type FROM paths""",
        "path_is_safe": _with(
            _paths(),
            r"""walk AS (SELECT path, list_filter(string_split_regex(replace(path, '\', '/'), '/+'), lambda x: x NOT IN ('', '.')) AS parts, 0 AS k, 0 AS depth, false AS outside FROM paths
                UNION ALL SELECT path, parts, k + 1, depth + CASE WHEN parts[k + 1] = '..' THEN -1 ELSE 1 END, outside OR (parts[k + 1] = '..' AND depth = 0) FROM walk WHERE k < len(parts))""",
        ) + r"""SELECT path, path <> '' AND NOT contains(path, ':') AND NOT starts_with(path, '/') AND NOT starts_with(path, '\') AND NOT bool_or(outside) AS safe FROM walk GROUP BY path""",
        "twin_pdf_binding": f"""WITH pdfs AS (SELECT {PATH} || '.pdf' AS pdf FROM documents WHERE doc_id % 3 = 0 UNION SELECT lang || '/' || source || '/DOC_' || doc_id || '.PDF' FROM documents WHERE doc_id % 3 = 1
                UNION SELECT lang || '/' || source || '.pdf' FROM documents WHERE doc_id % 20 < 10 AND lang = 'en'),
            files AS (SELECT {PATH} AS base, lang || '/' || source AS folder FROM documents)
            SELECT base || '.md' AS relative_path, coalesce((SELECT min(pdf) FROM pdfs WHERE pdf = base || '.pdf'),
                (SELECT min(pdf) FROM pdfs WHERE lower(pdf) = lower(base || '.pdf') AND starts_with(pdf, folder || '/')), (SELECT min(pdf) FROM pdfs WHERE pdf = folder || '.pdf')) AS original_pdf FROM files""",
        "reconcile_plan": _with(VAULT, STORED, SCANNED, PLAN) + "SELECT * FROM plan",
        "index_status": _with(VAULT, STORED, SCANNED, PLAN) + """SELECT count(*) FILTER (action <> 'deleted') AS scanned, count(*) FILTER (action = 'updated') AS updated,
            count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'deleted') AS deleted, CAST(0 AS BIGINT) AS failed, 'ready' AS state FROM plan""",
        "upsert_documents": _with(VAULT, STORED, SCANNED) + """SELECT relative_path, content_hash, index_version FROM stored WHERE NOT (doc_id % 10 > 5)
            UNION ALL SELECT relative_path, sha256(content), '1' FROM scanned WHERE doc_id % 10 > 5""",
        "delete_documents": _with(VAULT, STORED) + "SELECT relative_path, content_hash FROM stored WHERE doc_id % 10 <> 3",
        "purge_stale_vectors": _with(VAULT, STORED, VECTORS) + "SELECT relative_path, start_line FROM vecs WHERE relative_path IN (SELECT relative_path FROM stored WHERE index_version = '1')",
        "repair_completeness": _with(VAULT, STORED, CHUNKS, VECTORS) + """SELECT relative_path, index_version, index_version = '1' AND
            (SELECT count(*) FROM plain p WHERE p.relative_path = s.relative_path) = (SELECT count(*) FROM vecs v WHERE v.relative_path = s.relative_path AND embedding IS NOT NULL) AS vectors_complete FROM stored s""",
        "migrate_add_columns": _with(VAULT, STORED) + "SELECT relative_path, file_type, original_pdf, mtime, created_at, '' AS content_hash, '' AS index_version, false AS vectors_complete FROM stored",
        "rebuild_search_text": _with(CHUNKS, INDEXED) + "SELECT term, count(DISTINCT relative_path) AS rows, count(*) AS occurrences FROM (SELECT relative_path, unnest(terms) AS term FROM indexed) GROUP BY term",
        "chunk_vector_zip": _with(CHUNKS, VECTORS) + """SELECT relative_path, 0 AS chunk_ix, CAST(length(content) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first
            FROM plain JOIN vecs USING (relative_path, start_line) WHERE embedding IS NOT NULL""",
        "vector_validation": "SELECT vec_id, NOT (vec_id % 5 = 0 OR vec_id % 7 = 0 OR vec_id % 11 = 0) AS valid, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
        "vault_stats": _with(VAULT, STORED, CHUNKS, VECTORS) + """SELECT (SELECT count(*) FROM stored) AS total_documents,
            (SELECT count(*) FROM stored WHERE index_version <> '1' OR NOT vectors_complete) AS incomplete_documents, (SELECT count(DISTINCT original_pdf) FROM stored) AS bound_pdfs,
            (SELECT count(*) FROM plain) AS total_chunks, (SELECT count(*) FROM vecs WHERE embedding IS NOT NULL) AS total_vectors, (SELECT count(*) FROM vecs WHERE embedding IS NOT NULL) >= (SELECT count(*) FROM plain) AS vectors_cover_chunks""",
        "document_state": _with(VAULT, STORED) + "SELECT relative_path, content_hash, index_version, original_pdf, vectors_complete FROM stored WHERE relative_path IN ('en/src1/doc_1.md', 'en/none.md')",
        "list_document_paths": _with(VAULT, STORED) + "SELECT relative_path FROM stored ORDER BY 1",
        "weighted_pool": """WITH each AS (SELECT label, greatest(1, vec_id % 7)::DOUBLE AS w, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
            mean AS (SELECT label, i, sum(x * w) / sum(w) AS m FROM each GROUP BY ALL), size AS (SELECT label, sqrt(sum(m * m)) AS s FROM mean GROUP BY label)
            SELECT label, CAST(i AS INTEGER) AS i, round(m / s, 6) AS x FROM mean JOIN size USING (label)""",
        "token_windows": _with(CHUNKS, """parts AS (SELECT relative_path, content AS w, 1 AS pos FROM plain UNION ALL
            SELECT relative_path, CASE side WHEN 0 THEN substr(w, 1, length(w) // 2) ELSE substr(w, length(w) // 2 + 1) END, pos + side * (length(w) // 2) FROM parts, (VALUES (0), (1)) AS s(side) WHERE length(w) + 2 > 402)""")
        + """SELECT relative_path, CAST(row_number() OVER (PARTITION BY relative_path ORDER BY pos) - 1 AS INTEGER) AS ix, CAST(length(w) + 2 AS INTEGER) AS tokens,
            CAST(length(w) AS INTEGER) AS n, sha256(w) AS window_sha256 FROM parts WHERE length(w) + 2 <= 402""",
        "max_tokens": _with(_limits()) + "SELECT id, CAST(coalesce(list_min(list_filter(l, lambda x: x = floor(x) AND x > 0 AND x <= 1000000)), 512) AS INTEGER) AS max_tokens FROM limits",
        "recall_at_k": """WITH scored AS (SELECT q.vec_id AS query_id, q.label AS own, e.label, row_number() OVER (PARTITION BY q.vec_id
                ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
            hits AS (SELECT query_id, max(CASE WHEN own = label THEN 1 ELSE 0 END) AS hit FROM scored WHERE n <= 3 GROUP BY 1)
            SELECT CAST(sum(hit) AS BIGINT) AS hits, count(*) AS queries, round(avg(hit), 6) AS recall FROM hits""",
        "event_routing": _with(CHANGES) + f"""SELECT CASE WHEN NOT ({_ignored('path')}) AND list_contains({SUPPORTED}, {ext}) THEN 'file' WHEN {ext} = '.pdf' THEN 'vault' ELSE 'ignored' END AS route,
            op, count(*) AS events, count(DISTINCT path) AS paths FROM changes GROUP BY ALL""",
        "latest_revision": _with(CHANGES) + "SELECT path, count(*) - 1 AS superseded, max(revision) AS revision, CASE WHEN arg_max(op, revision) = 'unlink' THEN 'deleted' ELSE 'updated' END AS status FROM changes GROUP BY path",
        "stream_latest_revision": _with(CHANGES) + "SELECT path, max(revision) AS revision, arg_max(op, revision) AS op FROM changes GROUP BY path",
        "stream_index": _with(CHANGES.replace("AS op FROM", "AS op, '# ' || event_type || chr(10) || props AS content, event_type FROM"),
            "last AS (SELECT replace(path, chr(92), '/') AS relative_path, path, arg_max(op, revision) AS op, arg_max(content, revision) AS content, arg_max(event_type, revision) AS kind FROM changes GROUP BY path)")
        + f"""SELECT relative_path, kind AS heading_path, CAST(1 AS INTEGER) AS start_line, CAST(2 AS INTEGER) AS end_line, sha256(content) AS content_sha256
            FROM last WHERE op <> 'unlink' AND NOT ({_ignored('path')}) AND list_contains({SUPPORTED}, {ext})""",
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "render_candidates": _with(FUSED) + f"""SELECT CAST(ordinal AS INTEGER) AS ordinal, printf('[%d] %s | score %.6f | %s L1-L1', ordinal, CASE match_type WHEN 'hybrid' THEN 'keyword and vector'
            WHEN 'vector' THEN 'vector only' ELSE 'keyword' END, rrf, relative_path) || coalesce({NL} || printf('similarity %.4f', vector_score), '') || {NL} || {NL} || content || {NL} || '---' AS rendered
            FROM best JOIN plain USING (relative_path, start_line)""",
    }
    return out

