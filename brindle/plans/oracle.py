"""DuckDB SQL with the same rows, for the queries that SQL can express on whole tables."""

from __future__ import annotations

from brindle.functions import guard, scrub

from . import layout, stores

_ASKED = "SELECT id AS query_id, content AS query FROM messages WHERE id % 50 = 0 AND trim(content) <> ''"


def _bm25(passages: str, k: int, name: str = "") -> str:
    """Common tables up to bm{name}: query_id, id, score, rank. passages: SQL of id, ord, text."""
    return f"""
    p{name} AS ({passages}),
    w{name} AS (SELECT id, ord, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{{Z}}]+'), lambda x: x <> '') AS words FROM p{name}),
    dl{name} AS (SELECT id, ord, len(words) AS dl FROM w{name}),
    st{name} AS (SELECT count(*) AS n, avg(dl) AS a FROM dl{name}),
    tf{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM w{name}) GROUP BY ALL),
    raw{name} AS (SELECT term, count(*) AS df, ln((SELECT n FROM st{name}) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf{name} GROUP BY term),
    idf{name} AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw{name}) ELSE raw END AS idf FROM raw{name}),
    qw{name} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS term FROM asked) GROUP BY ALL),
    hit{name} AS (
        SELECT q.query_id, t.id, round(sum(q.qtf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * d.dl / s.a))), 9) AS score
        FROM qw{name} q JOIN idf{name} i USING (term) JOIN tf{name} t USING (term) JOIN dl{name} d USING (id), st{name} s GROUP BY ALL
    ),
    every{name} AS (SELECT a.query_id, d.id, d.ord, coalesce(h.score, 0) AS score FROM asked a CROSS JOIN dl{name} d LEFT JOIN hit{name} h ON h.query_id = a.query_id AND h.id = d.id),
    bm{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM every{name}) WHERE rank <= {k})"""


_DOCS = "SELECT doc_id AS id, doc_id AS ord, text FROM documents WHERE text IS NOT NULL"
_CHUNKS = "SELECT chunk_id AS id, chunk_id AS ord, text FROM (SELECT DISTINCT * FROM chunks) WHERE text IS NOT NULL"
_FUSED = f"""WITH asked AS ({_ASKED}), {_bm25(_DOCS, 20, "0")}, {_bm25(_CHUNKS, 20, "1")},
    lists AS (SELECT query_id, 0 AS list_no, rank, p.text FROM bm0 JOIN p0 p USING (id) UNION ALL SELECT query_id, 1, rank, p.text FROM bm1 JOIN p1 p USING (id)),
    one AS (SELECT query_id, text, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(list_no * 1000 + rank) AS first FROM lists GROUP BY ALL),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS rrf_rank FROM one) WHERE rrf_rank <= 10)"""
_CLEAN = r"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(text, '-\n([\p{L}\p{N}_])', '\1', 'g'), '[\s\p{Z}]+', ' ', 'g')), '^page\s+\d+\s*(of\s*\d+)?$', '', 'i')), '^\d+$', ''))"
_ROLE = "lower(trim(role))"


def _letters(column: str) -> str:
    """How often each letter and digit stands in a text, without case."""
    return f"list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda s: (length(lower({column})) - length(replace(lower({column}), s, '')))::DOUBLE)"


def _hybrid() -> str:
    names = ("pdf", "incident", "defect", "video")
    words = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[\\s\\p{{Z}}]+'), lambda x: x <> ''))"
    score = f"round(len(list_intersect({words('query')}, {words('text')})) / greatest(1, len({words('query')}))::DOUBLE - 1e-6::DOUBLE * least(length(text), 10000), 9)"
    distance = "round(1 - coalesce(nullif(list_cosine_similarity(a.v, p.v), 'nan'::DOUBLE), 0), 9)"
    bm = ", ".join(_bm25(f"SELECT chunk_id AS id, chunk_id AS ord, text FROM passages WHERE source_type = '{n}'", 20, f"_{n}") for n in names)
    keyword = " UNION ALL ".join(f"SELECT query_id, {2 * i + 1} AS list_no, rank, id AS chunk_id FROM bm_{n}" for i, n in enumerate(names))
    kinds = (("figure", guard.FIGURE_INTENT, 3, "true", "image_may_contain_pii = 'True'"), ("sheet_summary", guard.AGGREGATE_INTENT, 2, "source_type IN ('incident', 'defect')", "true"), ("transcript_summary", guard.TRANSCRIPT_INTENT, 3, "source_type = 'video'", "true"))
    steps, last = "", "pinned"
    for n, (kind, pattern, k, among, then) in enumerate(kinds):
        steps += f""",
    want{n} AS (SELECT query_id, query FROM asked WHERE regexp_matches(query, {_quoted(pattern)}, 'i') AND query_id NOT IN (SELECT query_id FROM {last} JOIN passages USING (chunk_id) WHERE chunk_type = '{kind}')),
    cand{n} AS (SELECT * FROM (SELECT query_id, query, chunk_id, text, c, row_number() OVER (PARTITION BY query_id, source_type ORDER BY distance, chunk_id) AS r, image_may_contain_pii FROM dist JOIN want{n} USING (query_id) WHERE chunk_type = '{kind}' AND {among}) WHERE r <= {k} AND {then}),
    best{n} AS (SELECT query_id, chunk_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, 2000 * c + r) AS n FROM (SELECT *, {score} AS s FROM cand{n})) WHERE n = 1),
    step{n} AS (
        SELECT * FROM {last} WHERE query_id NOT IN (SELECT query_id FROM best{n}) UNION ALL
        SELECT query_id, chunk_id, s, pin, row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, s DESC, rank) AS rank FROM (
            SELECT * FROM {last} WHERE rank < 5 AND query_id IN (SELECT query_id FROM best{n}) UNION ALL SELECT query_id, chunk_id, s, false, 5 FROM best{n}))"""
        last = f"step{n}"
    return f"""WITH passages AS MATERIALIZED (SELECT DISTINCT * FROM chunks WHERE text IS NOT NULL), asked AS MATERIALIZED ({_ASKED}), {bm},
    av AS MATERIALIZED (SELECT *, {_letters("query")} AS v FROM asked), pv AS MATERIALIZED (SELECT *, {_letters("text")} AS v, list_position(['pdf', 'incident', 'defect', 'video'], source_type) - 1 AS c FROM passages),
    dist AS MATERIALIZED (SELECT a.query_id, p.* EXCLUDE (v), {distance} AS distance FROM av a, pv p),
    lists AS MATERIALIZED (
        SELECT query_id, list_no, rank, chunk_id, p.text FROM (
            SELECT query_id, 2 * c AS list_no, rank, chunk_id FROM (SELECT query_id, c, chunk_id, row_number() OVER (PARTITION BY query_id, c ORDER BY distance, chunk_id) AS rank FROM dist) WHERE rank <= 20
            UNION ALL {keyword}) JOIN passages p USING (chunk_id)),
    one AS (SELECT query_id, text, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(list_no * 1000 + rank) AS first, arg_min(chunk_id, list_no * 1000 + rank) AS chunk_id FROM lists GROUP BY ALL),
    fused AS (SELECT * FROM (SELECT query_id, text, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS place FROM one) WHERE place <= 10),
    heads AS (SELECT query_id, text, arg_min(chunk_id, list_no) AS chunk_id, 1000 + min(list_no) AS place FROM lists WHERE rank = 1 GROUP BY ALL),
    every AS (SELECT * FROM fused UNION ALL SELECT h.* FROM heads h ANTI JOIN fused f ON f.query_id = h.query_id AND f.text = h.text),
    scored AS (SELECT query_id, chunk_id, text, place, {score} AS s FROM every JOIN asked USING (query_id)),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place) AS rank FROM scored) WHERE rank <= 5),
    ids AS (SELECT query_id, nullif(regexp_extract(query, '(?:^|[^A-Za-z0-9_])([A-Za-z]{{0,6}}\d{{3,}}[A-Za-z0-9]*)(?:$|[^A-Za-z0-9_])', 1), '') AS k FROM asked),
    exact AS (SELECT * FROM (SELECT d.query_id, d.chunk_id, d.text, row_number() OVER (PARTITION BY d.query_id ORDER BY d.c, d.distance, d.chunk_id) AS n FROM dist d JOIN ids ON ids.query_id = d.query_id AND ids.k = d.row_key WHERE d.source_type IN ('incident', 'defect')) WHERE n = 1),
    pinned AS (SELECT * FROM (SELECT query_id, chunk_id, s, pin, row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, rank) AS rank FROM (
        SELECT query_id, chunk_id, NULL::DOUBLE AS s, true AS pin, 0 AS rank FROM exact UNION ALL
        SELECT t.query_id, t.chunk_id, t.s, false, t.rank FROM top t ANTI JOIN exact e ON e.query_id = t.query_id AND e.text = t.text)) WHERE rank <= 5){steps},
    bounds AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM {last}),
    conf AS (SELECT query_id, rank::INT AS rank, chunk_id, CASE WHEN pin THEN 1.0::DOUBLE ELSE round(CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (s - lo) / (hi - lo) END * CASE WHEN hi < -10.5 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END, 4) END AS confidence FROM bounds)
    SELECT query_id, rank, chunk_id, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.40 THEN 'medium' ELSE 'low' END AS band FROM conf"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _redacted() -> str:
    t = "content"
    for pattern, sign in guard.ANSWER_PII:
        t = f"regexp_replace({t}, {_quoted(pattern)}, '{sign}', 'g')"
    return t


def _flags() -> str:
    t, parts = "content", []
    for pattern, sign in guard.ANSWER_PII:
        parts.append(f"CASE WHEN regexp_matches({t}, {_quoted(pattern)}) THEN '{sign}' END")
        t = f"regexp_replace({t}, {_quoted(pattern)}, '{sign}', 'g')"
    return f"concat_ws(',', {', '.join(parts)})"


def _terms(words: list[str]) -> tuple[str, str]:
    t = "text"
    for w in words:
        t = f"regexp_replace({t}, '{w}', '[internal]', 'gi')"
    return t, "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in words) + ")"


_WORDS_450 = "list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')"
_LABEL = lambda x: f"(CASE WHEN {x}_s // 3600 > 0 THEN printf('%d:%02d:%02d', {x}_s // 3600, {x}_s % 3600 // 60, {x}_s % 60) ELSE printf('%d:%02d', {x}_s % 3600 // 60, {x}_s % 60) END)"
_SECONDS = lambda x: f"greatest(0, round_even({x}, 0)::BIGINT) AS {x}_s"
_TERM_LIST = ["batch certificate", "number range", "approval", "worklist"]
_ERR = r"list_distinct(regexp_extract_all(content, '(?i)\berror\s*#?\s*(\d{3,6})\b', 1))"
_HINTS = "list_slice(list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(before, ''), '\\s+'), lambda w: length(w) > 3), lambda w: lower(w)), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in guard.HINT_STOP_WORDS) + "], w)), 1, 3)"

_TAGS = "CASE WHEN contains(text, '<') THEN replace(replace(replace(replace(replace(replace(regexp_replace(text, '<!--[^>]*-->|</?[A-Za-z!][^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') ELSE text END"
#: Windows of speech: a segment joins the open window until that has 700 characters or spans 60 seconds.
_WINDOWS = """
    seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_sec, seg_no) AS i, start_sec AS a, coalesce(end_sec, start_sec) AS z, trim(text) AS t FROM (SELECT DISTINCT * FROM segments WHERE start_sec IS NOT NULL) WHERE trim(coalesce(text, '')) <> ''),
    fold AS (
        SELECT doc_id, i, 1::BIGINT AS w, a AS start, z, length(t)::BIGINT AS size FROM seg WHERE i = 1
        UNION ALL
        SELECT s.doc_id, s.i, CASE WHEN f.size >= 700 OR f.z - f.start >= 60 THEN f.w + 1 ELSE f.w END, CASE WHEN f.size >= 700 OR f.z - f.start >= 60 THEN s.a ELSE f.start END, s.z, CASE WHEN f.size >= 700 OR f.z - f.start >= 60 THEN length(s.t) ELSE f.size + 1 + length(s.t) END
        FROM fold f JOIN seg s ON s.doc_id = f.doc_id AND s.i = f.i + 1
    ),
    win AS MATERIALIZED (SELECT f.doc_id, f.w AS window_no, min(f.start) AS start, arg_max(f.z, f.i) AS "end", count(*) AS n_segments, string_agg(s.t, ' ' ORDER BY f.i) AS text FROM fold f JOIN seg s ON s.doc_id = f.doc_id AND s.i = f.i GROUP BY 1, 2)"""


def _screen_lines(texts: str) -> str:
    lines = f"list_filter(list_transform(flatten(list_transform({texts}, lambda t: regexp_split_to_array(t, '\\r?\\n'))), lambda x: trim(x)), lambda x: x <> '')"
    kept = f"list_reduce(list_transform({lines}, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda s: contains(lower(s), lower(x[1])))) > 0 THEN a ELSE list_concat(a, x) END, []::VARCHAR[])"
    return f"array_to_string({kept}, ' | ')"


def _cut_lines(whole: str) -> str:
    parts = f"string_split(substr({whole}, 1, 1400), ' | ')"
    return f"CASE WHEN length({whole}) > 1400 THEN CASE WHEN len({parts}) > 1 THEN array_to_string({parts}[1:-2], ' | ') ELSE substr({whole}, 1, 1400) END || ' | …' ELSE {whole} END"


_COMPOSED_BODY = f"""WITH RECURSIVE {_WINDOWS},
    scr AS (SELECT DISTINCT doc_id, start_sec, text FROM screen_entries WHERE start_sec IS NOT NULL AND text IS NOT NULL),
    homes AS MATERIALIZED (SELECT v.doc_id, v.start_sec, v.text, min(w.window_no) AS window_no FROM scr v LEFT JOIN win w ON w.doc_id = v.doc_id AND w.start - 2 <= v.start_sec AND v.start_sec <= w."end" + 2 GROUP BY ALL),
    own AS (SELECT doc_id, window_no, list(text ORDER BY start_sec, text) AS screens, false AS inherited FROM homes WHERE window_no IS NOT NULL GROUP BY 1, 2),
    bare AS (SELECT * FROM win w WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = w.doc_id AND o.window_no = w.window_no)),
    carried AS (SELECT b.doc_id, b.window_no, [arg_max(h.text, {{'t': h.start_sec, 'x': h.text}})] AS screens, true AS inherited FROM bare b JOIN homes h ON h.doc_id = b.doc_id AND h.start_sec <= b.start + 2 GROUP BY b.doc_id, b.window_no, b.start HAVING b.start - max(h.start_sec) <= 120),
    shown AS (SELECT w.doc_id, w.start, w."end", 'transcript_segment' AS kind, coalesce(o.inherited, false) AS inherited, w.text AS narration, coalesce(o.screens, []::VARCHAR[]) AS screens FROM win w LEFT JOIN (SELECT * FROM own UNION ALL SELECT * FROM carried) o USING (doc_id, window_no)),
    lone AS (SELECT doc_id, start_sec AS t, text, row_number() OVER (PARTITION BY doc_id ORDER BY start_sec, text) AS i FROM homes WHERE window_no IS NULL),
    ses AS (
        SELECT doc_id, i, t, text, 1 AS n, length(text)::BIGINT AS size FROM lone WHERE i = 1
        UNION ALL
        SELECT l.doc_id, l.i, l.t, l.text, CASE WHEN l.t - s.t > 60 OR s.size >= 700 THEN s.n + 1 ELSE s.n END, CASE WHEN l.t - s.t > 60 OR s.size >= 700 THEN length(l.text) ELSE s.size + 1 + length(l.text) END
        FROM ses s JOIN lone l ON l.doc_id = s.doc_id AND l.i = s.i + 1
    ),
    alone AS (SELECT doc_id, min(t) AS start, max(t) AS "end", 'screen_capture' AS kind, false AS inherited, '' AS narration, list(text ORDER BY i) AS screens FROM ses GROUP BY doc_id, n),
    lines AS (SELECT * EXCLUDE (screens), {_screen_lines("screens")} AS whole FROM (SELECT * FROM shown UNION ALL SELECT * FROM alone)),
    cut AS (SELECT *, {_cut_lines("whole")} AS s, CASE WHEN inherited THEN 'Still on screen' ELSE 'On screen' END AS label FROM lines),
    made AS (SELECT doc_id, start, "end", kind, inherited, s <> '' AS has_screen_text, CASE WHEN narration <> '' AND s <> '' THEN 'Narration: ' || narration || chr(10) || label || ': ' || s WHEN narration <> '' THEN narration ELSE label || ': ' || s END AS body FROM cut)"""
_COMPOSED = f'{_COMPOSED_BODY} SELECT doc_id, start, "end", kind, inherited, md5(body) AS body_md5 FROM made'


def _scrub() -> str:
    t, flags = r"regexp_replace(text, '\A\[[^\]\n]*\]\n', '')", []
    for kind, sign, pattern in scrub.PATTERNS:
        flags.append((kind, f"CASE WHEN regexp_matches({t}, {_quoted(pattern)}) THEN '{kind}' END"))
        t = f"regexp_replace({t}, {_quoted(pattern)}, '{sign}', 'g')"
    types = f"concat_ws(', ', {', '.join(f for _, f in sorted(flags))})"
    return rf"""
        SELECT chunk_id, md5(regexp_extract(text, '\A(\[[^\]\n]*\]\n)', 1) || {t}) AS text_md5, {types} <> '' AS pii_detected, {types} AS pii_types_found, coalesce(chunk_type = 'figure', false) AS image_may_contain_pii
        FROM (SELECT DISTINCT * FROM chunks) WHERE text IS NOT NULL
    """


def _citation() -> str:
    label = lambda x: f"coalesce({_LABEL(x)}, '?')"
    seconds = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(0, round_even({x}, 0)::BIGINT) END AS {x}_s"
    file, sure = "coalesce(source_file, 'unknown')", "'Confidence: 62%'"
    span = f"{label('start_sec')} || '–' || {label('end_sec')}"
    key = "coalesce(nullif(row_key, ''), 'row ' || coalesce(page::VARCHAR, '?'))"
    return f"""
        SELECT chunk_id, CASE
            WHEN source_type = 'pdf' THEN concat_ws(' | ', '📄 Source: ' || {file}, 'Page ' || coalesce(page::VARCHAR, '?'), 'Section: ' || coalesce(section, '?'), {sure})
            WHEN source_type = 'video' AND chunk_type = 'transcript_summary' THEN concat_ws(' | ', '🎬 Source: ' || {file} || ' (transcript overview)', {sure})
            WHEN source_type = 'video' AND chunk_type = 'figure' THEN concat_ws(' | ', '🎬 Source: ' || {file} || ' (screenshot at ' || {label("start_sec")} || ')', {sure})
            WHEN source_type = 'video' AND chunk_type = 'screen_capture' THEN concat_ws(' | ', '🎬 Source: ' || {file} || ' (on-screen text)', {span}, {sure})
            WHEN source_type = 'video' THEN concat_ws(' | ', '🎬 Source: ' || {file}, {span}, {sure})
            WHEN source_type IN ('incident', 'defect') AND chunk_type = 'sheet_summary' THEN concat_ws(' | ', '📊 Source: ' || {file} || ' (sheet overview)', {sure})
            WHEN source_type IN ('incident', 'defect') THEN concat_ws(' | ', '📊 Source: ' || {file}, {key}, {sure})
            ELSE concat_ws(' | ', '📁 Source: ' || {file}, {sure}) END AS citation
        FROM (SELECT *, {seconds("start_sec")}, {seconds("end_sec")} FROM (SELECT DISTINCT * FROM chunks))
    """


def _answer_checks() -> str:
    plain, leaked = _terms(guard.INTERNAL_TERMS)
    words = _WORDS_450.replace("text", "plain")
    errors = lambda x: _ERR.replace("content", x)
    return f"""
        WITH m AS (SELECT id, role, content, coalesce(lag(content) OVER (PARTITION BY conversation_id ORDER BY id), '') AS context FROM messages),
        r AS (SELECT id, context, {_redacted()} AS text FROM m WHERE content IS NOT NULL AND {_ROLE} = 'assistant'),
        p AS (SELECT id, context, {plain} AS plain, {leaked} AS leaked FROM r),
        w AS (SELECT id, plain, leaked, {words} AS words, len(list_filter({errors("plain")}, lambda x: NOT list_contains({errors("context")}, x)))::INT AS n FROM p)
        SELECT id, md5(CASE WHEN len(words) > 450 THEN array_to_string(list_slice(words, 1, 450), ' ') || '...' ELSE plain END) AS text_md5, len(words) > 450 AS truncated, leaked = '' AND n = 0 AS safe, n AS n_invented FROM w
    """


SQL = {
    "bm25_topk": f"WITH asked AS ({_ASKED}), {_bm25(_DOCS, 20)} SELECT query_id, id AS doc_id, rank FROM bm",
    "bm25_term_stats": f"WITH asked AS ({_ASKED}), {_bm25(_DOCS, 20)} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "dense_topk": """
        WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS distance
                   FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
        SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 20
    """,
    "dense_topk_filtered": """
        WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS distance
                   FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label = 3)
        SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 3
    """,
    "rrf_fusion": f"{_FUSED} SELECT query_id, rrf_rank, md5(text) AS text_md5 FROM fused",
    "rrf_best_of_list": f"""{_FUSED},
        heads AS (SELECT DISTINCT query_id, text FROM lists WHERE rank = 1), new AS (SELECT h.* FROM heads h ANTI JOIN fused f ON f.query_id = h.query_id AND f.text = h.text)
        SELECT query_id, sum(f) + sum(h) AS n_candidates, sum(h) AS n_heads FROM (SELECT query_id, 1 AS f, 0 AS h FROM fused UNION ALL SELECT query_id, 0, 1 FROM new) GROUP BY query_id
    """,
    "confidence_bands": f"""WITH asked AS ({_ASKED}), {_bm25(_DOCS, 5)},
        s AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm),
        c AS (SELECT query_id, id AS doc_id, round(CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (score - lo) / (hi - lo) END * CASE WHEN hi < -10.5 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END, 4) AS c FROM s)
        SELECT query_id, doc_id, round(c, 3) AS confidence, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.40 THEN 'medium' ELSE 'low' END AS band FROM c
    """,
    "hybrid_search": _hybrid(),
    "acronym_expansions": f"""
        WITH t AS (SELECT staff_id, given_name || ' works, in ' || site || ', with ' || team || ' (' || upper(left(team, 3)) || ') since spring' AS text FROM staff WHERE length(team) > 4),
        asked AS (SELECT DISTINCT upper(left(team, 3)) AS query_id, upper(left(team, 3)) || ' full form of (' || upper(left(team, 3)) || ')' AS query FROM staff WHERE length(team) > 4), {_bm25("SELECT staff_id AS id, staff_id AS ord, text FROM t WHERE text IS NOT NULL", 10)},
        x AS (SELECT query_id, rank, coalesce(nullif(trim(regexp_extract(t.text, '(?i)([A-Za-z\\s]{{5,60}})\\s*\\(' || query_id || '\\)', 1)), ''), nullif(trim(regexp_extract(t.text, '(?i)' || query_id || '\\s*\\(([A-Za-z\\s]{{5,60}})\\)', 1)), '')) AS e
            FROM bm JOIN t ON t.staff_id = bm.id)
        SELECT query_id, arg_min(e, rank) AS expansion FROM x WHERE e IS NOT NULL GROUP BY 1
    """,
    "answer_assessment": f"""WITH asked AS ({_ASKED}), {_bm25(_DOCS, 5)},
        s AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm),
        c AS (SELECT query_id, CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE round((score - lo) / (hi - lo), 4) END AS c FROM s WHERE rank = 1),
        shorts AS (SELECT a.query_id, coalesce(c.c, 0) AS c, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')) <= 8 AS short FROM asked a LEFT JOIN c USING (query_id))
        SELECT query_id, c AS top_confidence, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.40 OR short THEN 'medium' ELSE 'low' END AS band, c < 0.40 AND NOT short AS escalate FROM shorts
    """,
    "exact_id_pin": r"""
        WITH a AS (SELECT 'm' || id AS query_id, content AS query FROM messages WHERE content IS NOT NULL UNION ALL SELECT DISTINCT 'c' || chunk_id, 'what about ' || row_key || '?' FROM chunks WHERE row_key IS NOT NULL),
        q AS (SELECT query_id, nullif(regexp_extract(query, '(?:^|[^A-Za-z0-9_])([A-Za-z]{0,6}\d{3,}[A-Za-z0-9]*)(?:$|[^A-Za-z0-9_])', 1), '') AS k FROM a),
        r AS (SELECT DISTINCT * FROM chunks WHERE row_key IS NOT NULL AND source_type IN ('incident', 'defect'))
        SELECT query_id, chunk_id FROM (
            SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'incident' THEN 0 ELSE 1 END, doc_id, ord) AS n FROM q JOIN r ON r.row_key = q.k
        ) WHERE n = 1
    """,
    "tokenize_counts": r"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_words FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL)",
    "clean_blocks": f"SELECT doc_id, md5({_CLEAN}) AS text_md5, length({_CLEAN}) >= 30 AS kept FROM documents WHERE text IS NOT NULL",
    "clean_cells": f"SELECT doc_id, md5(CASE WHEN lower(trim(text)) IN ('nan', 'nat', 'none') THEN '' ELSE trim(regexp_replace({_TAGS}, '[\\s\\p{{Z}}]+', ' ', 'g')) END) AS cell_md5 FROM documents WHERE text IS NOT NULL",
    "answer_checks": _answer_checks(),
    "citations": _citation(),
    "screen_noise": r"""
        SELECT doc_id, entry_no, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
            lambda x: regexp_matches(x, '[A-Za-z]{3,}') AND length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) >= length(x) * 0.5), chr(10))) AS text_md5 FROM (SELECT DISTINCT * FROM screen_entries) WHERE text IS NOT NULL
    """,
    "context_blocks": f"""WITH asked AS ({_ASKED}), {_bm25(_DOCS, 5)}
        SELECT query_id, md5(string_agg('[Source ' || rank || ' — ' || coalesce(source_file, 'the uploaded document') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM bm JOIN documents ON doc_id = id GROUP BY query_id
    """,
    "handover_history": f"WITH {stores.HISTORY} SELECT conversation_id, md5(history) AS history_md5 FROM h",
    "sheet_overview": """
        WITH r AS (SELECT count(*) AS n FROM staff WHERE coalesce(given_name, '') <> '' OR coalesce(team, '') <> ''),
        v AS (SELECT k, c, count(*) AS n, string_agg(x, ', ' ORDER BY x) AS l FROM (SELECT DISTINCT 0 AS k, 'given_name' AS c, given_name AS x FROM staff UNION SELECT DISTINCT 1, 'team', team FROM staff) WHERE x <> '' GROUP BY 1, 2 HAVING count(*) <= 12)
        SELECT n AS n_rows, '[staff.xlsx · Sheet1 · overview]' || chr(10) || 'The file ''staff.xlsx'' (sheet ''Sheet1'') contains ' || n || ' incident records in total.' || chr(10) || 'Columns: given_name, team.'
            || coalesce((SELECT string_agg(chr(10) || c || ' values (' || v.n || '): ' || l || '.', '' ORDER BY k) FROM v), '') AS text FROM r
    """,
    "speech_windows": f'WITH RECURSIVE {_WINDOWS} SELECT doc_id, window_no, start, "end", n_segments, length(text)::INT AS n_chars FROM win',
    "transcript_overviews": f"""WITH RECURSIVE {_WINDOWS},
        f AS (SELECT doc_id, count(*) AS n_windows, max("end") AS duration, string_agg(text, ' ' ORDER BY window_no) AS full_text FROM win GROUP BY 1),
        l AS (SELECT *, {_SECONDS("duration")} FROM f)
        SELECT doc_id, n_windows, duration, {_LABEL("duration")} AS length, CASE WHEN length(full_text) > 1500 THEN regexp_replace(substr(full_text, 1, 1500), ' [^ ]*$', '') || ' …' ELSE full_text END AS overview FROM l
    """,
    "composed_timeline": _COMPOSED,
    "id_tokens": r"""SELECT id, nullif(regexp_extract(content, '(?:^|[^A-Za-z0-9_])([A-Za-z]{0,6}\d{3,}[A-Za-z0-9]*)(?:$|[^A-Za-z0-9_])', 1), '') AS identifier,
        nullif(regexp_extract(content, '(?:^|[^A-Za-z0-9_])(\d{3,6})(?:$|[^A-Za-z0-9_])', 1), '') AS number FROM messages WHERE content IS NOT NULL""",
    "error_numbers_not_in_question": f"""
        WITH e AS (SELECT conversation_id, {_ROLE} AS r, unnest({_ERR}) AS number FROM messages WHERE content IS NOT NULL)
        SELECT DISTINCT conversation_id, number FROM e WHERE r = 'assistant' AND (conversation_id, number) NOT IN (SELECT conversation_id, number FROM e WHERE r = 'user')
    """,
    "intents": f"""
        SELECT id, regexp_matches(content, {_quoted(guard.FIGURE_INTENT)}, 'i') AS figure, regexp_matches(content, {_quoted(guard.AGGREGATE_INTENT)}, 'i') AS aggregate,
            regexp_matches(content, {_quoted(guard.TRANSCRIPT_INTENT)}, 'i') AS transcript, regexp_matches(lower(content), {_quoted("|".join(f"(?:{p})" for p in guard.ESCALATION_INTENT))}) AS escalation,
            upper(coalesce({", ".join(f"nullif(regexp_extract(content, {_quoted(p)}, 1, 'i'), '')" for p in guard.DEFINITION)})) AS acronym,
            CASE WHEN {_any("lower(trim(content))", guard.YES_WORDS)} THEN 'yes' WHEN {_any("lower(trim(content))", guard.NO_WORDS)} THEN 'no' ELSE 'unclear' END AS reply
        FROM messages WHERE content IS NOT NULL
    """,
    "input_guard": rf"""
        WITH q AS (SELECT id, regexp_replace(coalesce(content, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS q FROM messages)
        SELECT *, CASE reason WHEN 'empty_query' THEN 'Please enter a question.' WHEN 'query_too_long' THEN 'The question is too long; 500 characters are the limit.'
            WHEN 'prompt_injection' THEN 'This request can''t be processed. Please ask a question about the documents.' WHEN 'abusive_language' THEN 'Please keep the conversation respectful.' END AS message FROM (SELECT id, CASE WHEN trim(q) = '' THEN 'empty_query' WHEN length(q) > 500 THEN 'query_too_long' WHEN regexp_matches(lower(q), {_quoted("|".join(f"(?:{p})" for p in guard.INJECTION))}) THEN 'prompt_injection'
            WHEN {_any("lower(q)", guard.ABUSE)} THEN 'abusive_language' END AS reason FROM q)
    """,
    "output_redaction": f"SELECT id, md5({_redacted()}) AS text_md5, {_flags()} AS found FROM messages WHERE content IS NOT NULL",
    "internal_terms": f"SELECT doc_id, md5({_terms(_TERM_LIST)[0]}) AS text_md5, {_terms(_TERM_LIST)[1]} AS found FROM documents WHERE text IS NOT NULL",
    "truncated_words": f"SELECT doc_id, md5(CASE WHEN len({_WORDS_450}) > 450 THEN array_to_string(list_slice({_WORDS_450}, 1, 450), ' ') || '...' ELSE text END) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "sensitivity_levels": f"""
        SELECT doc_id, CASE WHEN {_any("lower(text)", ["salary", "payroll", "confidential", "executive", "password", "credential"])} THEN 'high'
            WHEN {_any("lower(text)", ["internal", "restricted", "proprietary", "do not distribute", "not for distribution", "draft", "preliminary"])} THEN 'medium' ELSE 'low' END AS level FROM documents WHERE text IS NOT NULL
    """,
    "header_split": r"SELECT chunk_id, regexp_extract(text, '\A(\[[^\]\n]*\]\n)', 1) AS header, length(regexp_replace(text, '\A\[[^\]\n]*\]\n', ''))::INT AS n_body FROM (SELECT DISTINCT * FROM chunks) WHERE text IS NOT NULL",
    "timestamp_labels": f"""
        SELECT doc_id, seg_no, {_LABEL("start_sec")} AS label, printf('%02d:%02d:%02d,%03d', w // 3600, w % 3600 // 60, w % 60, ms) AS srt FROM (
            SELECT doc_id, seg_no, {_SECONDS("start_sec")}, floor(greatest(0.0::DOUBLE, start_sec))::BIGINT AS w, round_even((greatest(0.0::DOUBLE, start_sec) - floor(greatest(0.0::DOUBLE, start_sec))) * 1000, 0)::BIGINT AS ms
            FROM (SELECT DISTINCT * FROM segments) WHERE start_sec IS NOT NULL)
    """,
    "auto_titles": rf"""
        WITH f AS (SELECT conversation_id, trim(regexp_replace(coalesce(arg_min_null(content, id), ''), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM messages WHERE {_ROLE} = 'user' GROUP BY conversation_id)
        SELECT conversation_id, CASE WHEN t = '' THEN 'New chat' WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') || '…' END AS title FROM f
    """,
    "collection_stats": "SELECT c.collection, count(k.chunk_id) AS n FROM (VALUES ('pdf'), ('incident'), ('defect'), ('video')) c(collection) LEFT JOIN chunks k ON k.source_type = c.collection GROUP BY 1",
    "latest_versions": "SELECT filename, doc_id, version, status FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY version DESC, doc_id DESC) AS n FROM document_registry) WHERE n = 1",
    "register_versions": """
        SELECT 'new-' || r.doc_id AS doc_id, r.filename, (t.top + row_number() OVER (PARTITION BY r.filename ORDER BY r.doc_id))::INT AS version, 'processing' AS status
        FROM document_registry r JOIN (SELECT filename, max(version) AS top FROM document_registry GROUP BY 1) t USING (filename) WHERE r.status = 'ready'
    """,
    "duplicate_files": "SELECT DISTINCT source_file AS filename FROM chunks WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT filename FROM document_registry WHERE status = 'ready' AND filename IS NOT NULL)",
    "conversation_list": """
        SELECT c.conversation_id, c.title, c.created_at, c.updated_at, coalesce(m.n, 0) AS n_messages FROM (SELECT DISTINCT * FROM conversations) c
        LEFT JOIN (SELECT conversation_id, count(*) AS n FROM messages GROUP BY 1) m USING (conversation_id)
    """,
    "recent_turns": """
        SELECT conversation_id, id, role, row_number() OVER (PARTITION BY conversation_id ORDER BY id)::INT AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS back FROM messages) WHERE back <= 10
    """,
    "last_turns": f"""
        SELECT conversation_id, md5(arg_max_null(CASE WHEN {_ROLE} = 'user' THEN content END, CASE WHEN {_ROLE} = 'user' THEN id END)) AS user_md5,
            md5(arg_max_null(CASE WHEN {_ROLE} = 'assistant' THEN content END, CASE WHEN {_ROLE} = 'assistant' THEN id END)) AS assistant_md5 FROM messages GROUP BY conversation_id
    """,
    "followup_rewrites": rf"""
        WITH m AS (SELECT id, content, lag(content) OVER w AS before, row_number() OVER w * 2 - 2 AS n FROM messages WHERE {_ROLE} = 'user' AND content IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY id)),
        x AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS words, nullif(regexp_extract(before, '(?:^|[^A-Za-z0-9_])(\d{{3,6}})(?:$|[^A-Za-z0-9_])', 1), '') AS number, {_HINTS} AS hints FROM m)
        SELECT id, CASE WHEN words > 8 OR n < 2 OR coalesce(before, '') = '' THEN content WHEN number IS NOT NULL AND NOT contains(content, number) THEN content || ' for error ' || number
            WHEN len(hints) > 0 THEN content || ' ' || array_to_string(hints, ' ') ELSE content END AS query FROM x
    """,
    "upsert_chunks": """
        WITH c AS (SELECT DISTINCT * FROM chunks), l AS (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY version DESC, doc_id DESC) AS n FROM document_registry) WHERE n = 1)
        SELECT chunk_id, md5(CASE WHEN doc_id IN (SELECT doc_id FROM l) THEN upper(text) ELSE text END) AS text_md5 FROM c
    """,
    "delete_by_document": "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT * FROM chunks) WHERE doc_id NOT IN (SELECT doc_id FROM document_registry WHERE status = 'failed') GROUP BY 1",
    "deleted_conversations": "SELECT conversation_id, count(*) AS n FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM conversations WHERE title = 'New chat') GROUP BY 1",
    "seen_ledger": "SELECT DISTINCT conversation_id FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM conversations)",
    "message_sources": "SELECT id, coalesce(json_array_length(sources), 0)::INT AS n_sources, coalesce(json_array_length(images), 0)::INT AS n_images FROM messages",
    "row_passages": r"""
        SELECT 'd1_row_' || (staff_id + 1) AS chunk_id, given_name AS row_key, concat_ws(chr(10), '[staff.xlsx · Sheet1 · row ' || (staff_id + 1) || ']', 'given_name: ' || nullif(given_name, ''), 'family_name: ' || nullif(family_name, ''), 'team: ' || nullif(team, ''), 'site: ' || nullif(site, '')) AS text,
            concat_ws(';', 'col_given_name=' || nullif(left(given_name, 200), ''), 'col_family_name=' || nullif(left(family_name, 200), ''), 'col_team=' || nullif(left(team, 200), ''), 'col_site=' || nullif(left(site, 200), '')) AS attributes FROM staff
    """,
    "sheet_values": """
        WITH c AS (SELECT 'given_name' AS column_name, given_name AS v FROM staff UNION SELECT 'team', team FROM staff UNION SELECT 'site', site FROM staff)
        SELECT column_name, count(*) AS n_values, string_agg(v, ', ' ORDER BY v) AS value_list FROM c WHERE v <> '' GROUP BY 1 HAVING count(*) <= 12
    """,
    "section_asof": """
        WITH e AS (SELECT *, day(ts) AS page FROM events), toc AS (SELECT user_id, event_id AS pos, 'S' || event_id AS title, page, max(page) OVER (PARTITION BY user_id ORDER BY event_id) AS reach FROM e WHERE event_type = 'click'),
        r AS (SELECT * FROM e WHERE event_type <> 'click'),
        h AS (SELECT r.user_id, r.page, arg_max(t.title, t.pos) AS title FROM (SELECT DISTINCT user_id, page FROM r) r JOIN toc t ON t.user_id = r.user_id AND t.reach <= r.page GROUP BY ALL)
        SELECT r.event_id, coalesce(h.title, 'Unknown Section') AS section FROM r LEFT JOIN h USING (user_id, page)
    """,
    "logo_images": "SELECT event_type AS doc_id, user_id AS xref FROM events GROUP BY ALL HAVING count(DISTINCT day(ts)) >= 4",
    "screen_interval_join": """
        SELECT v.doc_id, v.entry_no, min(w.seg_no) AS window_no FROM (SELECT DISTINCT * FROM screen_entries) v LEFT JOIN (SELECT DISTINCT * FROM segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL) w
            ON w.doc_id = v.doc_id AND w.start_sec - 2 <= v.start_sec AND v.start_sec <= w.end_sec + 2 GROUP BY ALL
    """,
    "carried_screens": """
        WITH v AS (SELECT DISTINCT doc_id, start_sec, text FROM screen_entries), w AS (SELECT DISTINCT * FROM segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
        homes AS (SELECT v.doc_id, v.start_sec, v.text, min(w.seg_no) AS seg_no FROM v JOIN w ON w.doc_id = v.doc_id AND w.start_sec - 2 <= v.start_sec AND v.start_sec <= w.end_sec + 2 GROUP BY ALL),
        bare AS (SELECT * FROM w WHERE (doc_id, seg_no) NOT IN (SELECT doc_id, seg_no FROM homes))
        SELECT b.doc_id, b.seg_no::BIGINT AS window_no, max(v.start_sec) AS start_sec FROM bare b JOIN v ON v.doc_id = b.doc_id AND v.start_sec <= b.start_sec + 2 GROUP BY b.doc_id, b.seg_no, b.start_sec HAVING b.start_sec - max(v.start_sec) <= 120
    """,
    "gap_sessions": """
        WITH v AS (SELECT DISTINCT * FROM screen_entries WHERE start_sec IS NOT NULL), n AS (SELECT doc_id, start_sec, CASE WHEN start_sec - lag(start_sec) OVER (PARTITION BY doc_id ORDER BY start_sec) > 60 THEN 1 ELSE 0 END AS new FROM v),
        s AS (SELECT doc_id, start_sec, sum(new) OVER (PARTITION BY doc_id ORDER BY start_sec) + 1 AS session_no FROM n)
        SELECT doc_id, session_no::BIGINT AS session_no, min(start_sec) AS start, max(start_sec) AS "end", count(*) AS n FROM s GROUP BY ALL
    """,
    "stream_ingest_parity": "SELECT lower(trim(source)) AS source, count(*) AS n FROM documents GROUP BY 1",
    "session_state": f"""
        SELECT conversation_id, count(*) AS n_seen, least(10, count(*))::INT AS n_kept, arg_max(coalesce(role, ''), id) AS last_role,
            arg_max(coalesce({_ROLE}, '') <> 'user' AND coalesce(status = 'escalate', false), id) AS pending FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1
    """,
    "streamed_sheets": "SELECT coalesce(team, '') AS team, count(*) AS n, count(DISTINCT coalesce(given_name, '')) AS n_given FROM staff GROUP BY 1",
    "segment_passages": f"""{_COMPOSED_BODY}
        SELECT doc_id, segment_index::INT AS segment_index, round(start, 2) AS start_sec, {_LABEL("start")} AS start_time, has_screen_text, inherited, md5('[' || doc_id || ' · ' || {_LABEL("start")} || '–' || {_LABEL("end")} || ']' || chr(10) || body) AS text_md5
        FROM (SELECT *, {_SECONDS("start")}, greatest(0, round_even("end", 0)::BIGINT) AS end_s, row_number() OVER (PARTITION BY doc_id ORDER BY start, kind, body) - 1 AS segment_index FROM made)
    """,
    "timeline_markdown": f"""{_COMPOSED_BODY}
        SELECT doc_id, count(*) FILTER (kind = 'transcript_segment') AS n_speech, count(*) FILTER (has_screen_text) AS n_screen, md5(string_agg(line, chr(10) || chr(10) ORDER BY start, "end", line)) AS markdown_md5
        FROM (SELECT *, '### ' || {_LABEL("start")} || '–' || {_LABEL("end")} || chr(10) || chr(10) || body AS line FROM (SELECT *, {_SECONDS("start")}, greatest(0, round_even("end", 0)::BIGINT) AS end_s FROM made)) GROUP BY 1
    """,
    "ingest_scrub": _scrub(),
}
SQL |= stores.sql(_CLEAN, _any) | layout.sql(_CLEAN)
