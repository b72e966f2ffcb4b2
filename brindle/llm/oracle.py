"""DuckDB SQL of the problems that SQL can express over whole tables."""

from .conversations import ASSISTANT_ROLES, STAND_INS, SYSTEM_ROLES, USER_ROLES

_TRIMMED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))"

_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_ROLE = r"regexp_replace(regexp_replace(lower(coalesce(role, '')), '^[^\p{L}]+|[^\p{L}]+$', '', 'g'), '[_\s-]+', ' ', 'g')"
_BARE = r"trim(regexp_replace(lower(regexp_replace(coalesce(content, ''), '<[^<>]*>|&[a-zA-Z]+;|&#\d+;', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'))"
_SEEN = r"regexp_replace(coalesce(content, ''), '[\s\p{Z}\p{Cf}\p{Cc}]+', '', 'g') <> ''"
#: Messages once each, with the role of the one before; system rows left out.
_ORDERED = f"""
    once AS (SELECT conversation_id, role, content, created_at, min(id) AS id FROM messages GROUP BY ALL),
    classed AS (
        SELECT conversation_id, id, created_at, CASE WHEN {_ROLE} IN ({_LIST(USER_ROLES)}) THEN 'user' WHEN {_ROLE} IN ({_LIST(ASSISTANT_ROLES)}) THEN 'assistant' WHEN {_ROLE} IN ({_LIST(SYSTEM_ROLES)}) THEN 'system' ELSE 'other' END AS r,
            {_SEEN} AS says, {_BARE} = '' OR {_BARE} IN ({_LIST(STAND_INS)}) AS none
        FROM once
    ),
    ordered AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM classed WHERE r <> 'system' WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id))"""

_REASONS = f"""{_ORDERED},
        summary AS (
            SELECT conversation_id, bool_or(says AND r IN ('user', 'assistant')) AS says, bool_or(r = 'other' OR r = 'assistant' AND before IS DISTINCT FROM 'user') AS broken,
                bool_or(r = 'user' AND after IS DISTINCT FROM 'assistant' OR r = 'assistant' AND before = 'user' AND none) AS unanswered
            FROM ordered GROUP BY 1
        ),
        known AS (SELECT DISTINCT conversation_id, true AS known FROM conversations),
        reasons AS (SELECT * FROM (
            SELECT coalesce(k.conversation_id, s.conversation_id) AS conversation_id,
                CASE WHEN NOT coalesce(s.says, false) THEN 'empty' WHEN NOT coalesce(k.known, false) OR s.broken THEN 'broken' WHEN s.unanswered THEN 'missing_reply' END AS reason
            FROM known k FULL JOIN summary s ON k.conversation_id = s.conversation_id
        ) WHERE reason IS NOT NULL)"""
#: All runs of shared_span_min_chars characters of each text, and those that two documents have.
_RUNS = """
    n AS (SELECT amount::INT AS n FROM size_limits WHERE setting = 'shared_span_min_chars'),
    every AS (SELECT doc_id, text, unnest(range(1, length(text) - n + 2)) AS p, n FROM documents, n WHERE length(text) >= n),
    runs AS (SELECT doc_id, p, hash(substr(text, p, n)) AS h, n FROM every),
    common AS (SELECT h FROM runs GROUP BY h HAVING min(doc_id) < max(doc_id))"""

SQL = {
    "p2_found": f"WITH {_REASONS} SELECT * FROM reasons",
    "p2_turns": f"""
        WITH {_REASONS}
        SELECT o.conversation_id, row_number() OVER (PARTITION BY o.conversation_id ORDER BY o.created_at, o.id) AS turn_no, r AS role, o.id, m.content FROM ordered o JOIN messages m USING (id)
        WHERE o.conversation_id IS NOT NULL AND o.conversation_id NOT IN (SELECT conversation_id FROM reasons WHERE conversation_id IS NOT NULL)
    """,
    "p9_found": f"""
        WITH {_RUNS}, once AS (SELECT DISTINCT doc_id, h FROM runs SEMI JOIN common USING (h))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM once a JOIN once b ON a.h = b.h AND a.doc_id < b.doc_id
    """,
    "p9_shared": f"""
        WITH {_RUNS}, shared AS (SELECT doc_id, p, n, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM runs SEMI JOIN common USING (h)),
        sums AS (SELECT doc_id, sum(least(n, coalesce(q - p, n)))::BIGINT AS c FROM shared GROUP BY 1)
        SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(c, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text)::DOUBLE ELSE 0.0 END AS shared_part FROM documents d LEFT JOIN sums USING (doc_id)
    """,
    "p6_found": f"""
        SELECT DISTINCT doc_id, seg_no FROM segments
        WHERE length({_TRIMMED}) > (SELECT amount FROM size_limits WHERE setting = 'piece_max_chars')
    """,
    "p7_found": f"""
        SELECT doc_id FROM documents
        WHERE {_TOKENS} > (SELECT amount FROM size_limits WHERE setting = 'container_tokens')
    """,
    "p8_found": f"""
        WITH own AS (
            SELECT t.source, t.target_share, t.max_repeat, coalesce(sum({_TOKENS.replace("text", "d.text")}), 0) AS tokens
            FROM mix_targets t LEFT JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source))
            GROUP BY ALL
        )
        SELECT source FROM own WHERE max_repeat * tokens < target_share * (SELECT sum(tokens) FROM own)
    """,
}
