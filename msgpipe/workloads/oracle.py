"""The same results in SQL over the same tables, for an independent check."""

from __future__ import annotations

from html.entities import name2codepoint

from msgpipe.functions.prompt import INSTRUCTION
from msgpipe.functions.text import SPACE_CHARS
from msgpipe.workloads.inputs import BASE_MILLIS, MODEL


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chars(text: str) -> str:
    """A string literal of any characters, unusual ones by code point."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in text) + ")"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SPACES = _chars(SPACE_CHARS)


def _redact(expr: str) -> str:
    return f"regexp_replace({expr}, '{EMAIL}', '[scrubbed]@example.com', 'g')"


def _strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def _html_text(expr: str) -> str:
    """HTML to text: tokens, then line starts, entities, stripped lines."""
    token = (
        r"(?is)<!--.*?-->"
        r"|<script(?:[\s/][^>]*)?>.*?</script(?:[\s/][^>]*)?>"
        r"|<style(?:[\s/][^>]*)?>.*?</style(?:[\s/][^>]*)?>"
        r"|<(?:script|style)(?:[\s/][^>]*)?>.*"
        r"|<[a-z][^>]*>|</[a-z][^>]*>|<[!?][^>]*>|<[a-z/!?].*|[^<]+|<"
    )
    entity = r"&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
    keys = ", ".join(_quote(f"&{n}{end}") for n in name2codepoint for end in (";", ""))
    values = ", ".join(f"chr({c})" for c in name2codepoint.values() for _ in range(2))
    named = f"map([{keys}], [{values}])"
    tail = r"(^|>)[^<]*&[^\s;&<]{0,33}$"
    raw = r"(?is)^<(?:script|style)[^>]*>(.*)</[^<]*$"
    text = (
        f"list_aggregate(list_transform(regexp_extract_all(t, '{entity}'), "
        f"lambda e: coalesce(({named})[e], e)), 'string_agg', '')"
    )
    block = r"(?i)^<(?:p|br|div|li|tr|h[1-6])(?:[\s/>])"
    pieces = (
        f"list_transform(regexp_extract_all(regexp_replace({expr}, '{tail}', '\\1'), '{token}'), "
        f"lambda t: CASE WHEN regexp_matches(t, '{raw}') THEN regexp_extract(t, '{raw}', 1) "
        f"WHEN regexp_matches(t, '{block}') AND ends_with(t, '>') THEN chr(10) "
        f"WHEN t LIKE '<_%' OR t = '<' THEN '' "
        f"WHEN contains(t, '&') THEN {text} ELSE t END)"
    )
    breaks = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    lines = (
        f"list_filter(list_transform(regexp_split_to_array("
        f"list_aggregate({pieces}, 'string_agg', ''), '{breaks}'), "
        f"lambda l: {_strip('l')}), lambda l: l <> '')"
    )
    return f"coalesce(list_aggregate({lines}, 'string_agg', chr(10)), '')"


ID = "'doc-' || doc_id"
SUBJECT = "'Report ' || doc_id || ' for ' || lang || ' via ' || source || '@lists.example.org'"
MASKED_SUBJECT = "'Report ' || doc_id || ' for ' || lang || ' via [scrubbed]@example.com'"
SENDER = "'Desk ' || source || ' <' || source || '@mail.example.net>'"
THREAD = "CASE WHEN doc_id % 4 <> 3 THEN 'thread-' || (doc_id // 4) END"
SNIPPET = "CASE WHEN doc_id % 5 <> 0 THEN 'from ' || source || '@mail.example.net' END"
MILLIS = f"({BASE_MILLIS} + doc_id * 60000)"
CLOCK = "'2026-01-01T00:00:00.000000Z'"
STATUS = "CASE WHEN doc_id % 13 = 7 THEN 1 WHEN doc_id % 11 = 5 THEN 2 ELSE 0 END"
DATE_ERROR = (
    "CASE WHEN doc_id % 13 = 7 THEN 'internalDate is missing' WHEN doc_id % 11 = 5 "
    "THEN 'internalDate is not an integer: ''not-a-date-' || doc_id || '''' END"
)
DEFECT = (
    "CASE doc_id % 7 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'category is missing' "
    "WHEN 3 THEN 'tl_dr is empty' WHEN 4 THEN 'unknown fields: extra' "
    "WHEN 5 THEN 'category is not text' WHEN 6 THEN 'key_points is not a list of strings' END"
)
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
CALL_PROMPT = "CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END"
CALL_COMPLETION = "CASE WHEN l_discount > 0 THEN l_partkey END"
USAGE = (
    f"SELECT 'order-' || l_orderkey AS message_id, CAST(sum({CALL_PROMPT}) AS BIGINT) "
    f"AS tokens_prompt, CAST(sum({CALL_COMPLETION}) AS BIGINT) AS tokens_completion "
    "FROM lineitem GROUP BY l_orderkey"
)
TIMINGS = (
    "SELECT 'evt-' || event_id AS message_id, CAST(round(value * 100) AS BIGINT) AS duration_ms "
    "FROM events WHERE event_type <> 'error'"
)
P1 = "'NFR-P1 breach: message_id=' || message_id || ' took ' || duration_ms || " \
     "' ms (> 20000 ms per-email budget)'"
P2 = "'NFR-P2 breach: batch total ' || duration_ms || ' ms (> 120000 ms batch budget)'"


def _json_list(*items: str) -> str:
    return "'[' || " + " || ',' || ".join(f"to_json({i})::VARCHAR" for i in items) + " || ']'"


def _shown(column: str) -> str:
    return f"coalesce({column}::VARCHAR, 'None')"


def _order_store() -> str:
    version = "CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 = 4 THEN 2 ELSE 1 END"
    return f"""
        SELECT 'order-' || o_orderkey AS source_message_id,
               'version ' || {version} || ' ' || o_orderpriority AS subject,
               'status ' || o_orderstatus AS tl_dr, 'customer ' || o_custkey AS summary,
               o_orderstatus AS category, o_custkey AS tokens_prompt
        FROM orders"""


def _lines(expr: str) -> str:
    """Lines of a text, stripped, blank ones left out."""
    breaks = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    lines = (f"list_filter(list_transform(regexp_split_to_array({expr}, '{breaks}'), "
             f"lambda l: {_strip('l')}), lambda l: l <> '')")
    return f"coalesce(list_aggregate({lines}, 'string_agg', chr(10)), '')"


ATTACHMENTS = "CASE doc_id % 4 WHEN 2 THEN 'report-' || doc_id || '.pdf' " \
              "WHEN 3 THEN 'pic.png' ELSE '' END"

_TRUNCATED = "CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END"


def _prompt(subject: str, sender: str, body: str) -> str:
    return (f"{_quote(INSTRUCTION)} || chr(10) || chr(10) || 'Subject: ' || {subject} || chr(10) "
            f"|| 'From: ' || {sender} || chr(10) || 'Body:' || chr(10) || {body}")


# Documents and pages as messages.
PAGE_PROBLEM = DATE_ERROR.replace("doc_id", "page_id")
MESSAGES = f"""m AS (
    SELECT {ID} AS message_id, doc_id AS n, {SUBJECT} AS subject, {MASKED_SUBJECT} AS masked,
           {SENDER} AS sender, 'Desk ' || source || ' <[scrubbed]@example.com>' AS masked_sender,
           'team-' || lang || '@example.com|ops+' || source || '@example.com' AS recipients,
           {THREAD} AS thread_id, 'INBOX|' || source AS labels, {MILLIS} AS millis,
           {SNIPPET} AS snippet, {DATE_ERROR} AS problem,
           CASE doc_id % 4 WHEN 2 THEN 'report-' || doc_id || '.pdf' WHEN 3 THEN 'pic.png'
                ELSE '' END AS files,
           CASE WHEN doc_id % 4 <> 3 AND {_strip("text")} <> '' THEN {_strip("text")}
                WHEN doc_id % 4 = 0 THEN '' ELSE {_lines("text")} END AS body,
           'Document ' || doc_id || ' by ' || source || '@example.org' AS tl_dr, text AS answer,
           lang AS category, {_json_list("lang", "source")} AS key_points
    FROM documents
    UNION ALL
    SELECT 'page-' || page_id, page_id, 'Page ' || page_id, 'Page ' || page_id,
           'Crawler <crawler@web.example.net>', 'Crawler <[scrubbed]@example.com>',
           'archive@example.com', NULL, 'INBOX|web',
           {BASE_MILLIS} + page_id * 60000 + 30000, NULL, {PAGE_PROBLEM}, '',
           {_html_text(_strip("html"))}, 'Page ' || page_id, url, 'page', '[]'
    FROM pages)"""


ORACLE = {
    "redact_documents": f"SELECT doc_id, {_redact('text')} AS text FROM documents",
    "redact_rules": f"""
        SELECT doc_id, regexp_replace(regexp_replace({_redact('text')}, '[0-9]{{3,}}', '[number]', 'g'),
               '\\[number\\]-\\[number\\]', '[range]', 'g') AS text FROM documents""",
    "raw_lines_scan": f"""
        WITH r AS (
            SELECT {ID} AS id, {THREAD} AS thread_id, doc_id AS n,
                   CASE WHEN doc_id % 4 = 0 THEN sha256(text) END AS body FROM documents
            UNION ALL SELECT 'page-' || page_id, NULL, page_id, sha256(html) FROM pages)
        SELECT CASE WHEN n % 6 <> 1 THEN id END AS message_id,
               CASE WHEN n % 6 <> 1 THEN thread_id END AS thread_id,
               CASE WHEN n % 6 <> 1 THEN body END AS body_sha256,
               CASE WHEN n % 6 = 1 THEN 'read' END AS stage,
               CASE WHEN n % 6 = 1 THEN 'invalid JSON' END AS error
        FROM r""",
    "response_lines_scan": f"""
        WITH {MESSAGES} SELECT message_id, tl_dr, answer AS summary, category FROM m""",
    "capture_job": f"""
        WITH t AS ({TIMINGS})
        SELECT 'SLO_BREACH' AS outcome, (SELECT count(*) FROM nation) AS records,
               (SELECT count(*) FROM nation) AS samples,
               count(*) FILTER (duration_ms > 20000) + CAST(sum(duration_ms) > 120000 AS BIGINT)
                   AS breaches, count(*) AS messages,
               CAST(sum(duration_ms) AS BIGINT) AS total_ms,
               CAST(max(duration_ms) AS BIGINT) AS slowest_ms
        FROM t""",
    "redact_hits_by_lang": f"""
        SELECT lang, count(*) AS docs,
               CAST(sum(len(regexp_extract_all(text, '{EMAIL}'))) AS BIGINT) AS addresses
        FROM documents GROUP BY lang""",
    "redact_message": f"""
        SELECT {ID} AS message_id, {THREAD} AS thread_id, {MASKED_SUBJECT} AS subject,
               'Desk ' || source || ' <[scrubbed]@example.com>' AS sender,
               '[scrubbed]@example.com|[scrubbed]@example.com' AS recipients,
               'INBOX|' || source AS labels, {_redact('text')} AS body_text,
               CASE WHEN doc_id % 5 <> 0 THEN 'from [scrubbed]@example.com' END AS snippet,
               'invoice-' || source || '@example.com.pdf' AS attachment_filenames
        FROM documents""",
    "html_to_text": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
    "html_to_text_exact": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
    "header_lookup": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority
                    ELSE 'old ' || o_orderpriority END AS subject,
               CASE WHEN o_orderkey % 4 <> 3 THEN 'clerk' || o_custkey || '@example.com'
                    ELSE '' END AS sender,
               '' AS recipient
        FROM orders""",
    "address_list": """
        SELECT c_custkey, 'c' || c_custkey || '@example.com|desk+' || c_custkey || '@'
               || lower(c_mktsegment) || '.example.org|r' || c_custkey || '@example.net'
               AS addresses
        FROM customer""",
    "address_list_exact": """
        SELECT c_custkey, CASE WHEN c_custkey % 2 = 0
               THEN 'a' || c_custkey || '@example.com|b' || c_custkey || '@example.com|c'
                    || c_custkey || '@example.com'
               ELSE 'd' || c_custkey || '@example.com' END AS addresses
        FROM customer""",
    "epoch_millis": f"""
        WITH texts AS (
            SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'at ' || event_id
                   ELSE (epoch_us(ts) // 1000)::VARCHAR END AS t FROM events)
        SELECT event_id, TRY_CAST(t AS BIGINT) AS millis,
               {ISO.format('make_timestamp(TRY_CAST(t AS BIGINT) * 1000)')} AS received_at,
               CASE WHEN TRY_CAST(t AS BIGINT) IS NULL
                    THEN 'internalDate is not an integer: ''' || t || '''' END AS error
        FROM texts""",
    "base64_body": """
        SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN text END AS text,
               CASE WHEN doc_id % 9 = 4 THEN 'body data has incorrect base64 padding' END AS error
        FROM documents""",
    "mime_flatten": f"""
        SELECT {ID} AS message_id,
               CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS INTEGER)
                   AS n_parts,
               CASE doc_id % 4
                   WHEN 0 THEN 'text/plain'
                   WHEN 1 THEN 'multipart/alternative|text/plain|text/html'
                   WHEN 2 THEN 'multipart/mixed|multipart/alternative|text/plain|text/html|'
                               || 'application/pdf'
                   ELSE 'multipart/mixed|multipart/related|text/html|image/png' END AS types,
               {ATTACHMENTS} AS attachments,
               CASE WHEN doc_id % 4 = 3 THEN '' ELSE {_strip('text')} END AS plain,
               CASE WHEN doc_id % 4 = 0 THEN '' ELSE '<html><body><div>' || replace(replace(replace(
                   text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</div></body></html>' END
                   AS html
        FROM documents
        UNION ALL
        SELECT 'page-' || page_id, 1, 'text/html', '', '', {_strip('html')} FROM pages""",
    "parse_messages": f"""
        WITH {MESSAGES}
        SELECT message_id,
               CASE WHEN problem IS NULL THEN thread_id END AS thread_id,
               CASE WHEN problem IS NULL THEN subject END AS subject,
               CASE WHEN problem IS NULL THEN sender END AS sender,
               CASE WHEN problem IS NULL THEN recipients END AS recipients,
               CASE WHEN problem IS NULL THEN labels END AS labels,
               CASE WHEN problem IS NULL THEN
                    {ISO.format('make_timestamp(millis * 1000)')} END AS received_at,
               CASE WHEN problem IS NULL THEN body END AS body_text,
               CASE WHEN problem IS NULL THEN snippet END AS snippet,
               CASE WHEN problem IS NULL THEN files END AS attachment_filenames,
               CASE WHEN problem IS NOT NULL THEN 'parse' END AS stage, problem AS error
        FROM m""",
    "label_resolve_list": f"""
        SELECT {ID} AS message_id FROM documents WHERE source = 'src7'
        ORDER BY {MILLIS} DESC, {ID} LIMIT 5""",
    "label_index": f"""
        WITH {MESSAGES}
        SELECT unnest(string_split(labels, '|')) AS label_id, message_id, millis FROM m""",
    "fetch_by_ids": f"""
        WITH ids AS (
            SELECT CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey * 2 END AS want FROM orders)
        SELECT CASE WHEN want IS NULL THEN '' ELSE 'doc-' || want END AS message_id,
               {THREAD} AS thread_id,
               CASE WHEN doc_id IS NULL THEN 'read' END AS stage,
               CASE WHEN want IS NULL THEN 'no message_id given'
                    WHEN doc_id IS NULL THEN 'unknown message_id: ''doc-' || want || ''''
                    END AS error
        FROM ids LEFT JOIN documents ON doc_id = want""",
    "conversation_payload": """
        SELECT conv_id,
               string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system')
                   AS system,
               count(*) FILTER (role <> 'system') AS n_turns,
               CAST(coalesce(sum(length(text)) FILTER (role <> 'system'), 0) AS BIGINT)
                   AS turn_chars
        FROM conversations GROUP BY conv_id""",
    "conversation_turns":
        "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'",
    "message_list_payload": """
        SELECT doc_id,
               CASE WHEN doc_id % 3 = 0 THEN 'Lang ' || lang || chr(10) || chr(10) || 'Src '
                    || source END AS system,
               CASE doc_id % 3 WHEN 0 THEN 'user:' || text || chr(10) || 'assistant:'
                    WHEN 1 THEN 'user:' || text || source ELSE 'user:' || text END AS turns
        FROM documents""",
    "prompt_render": f"""
        SELECT {ID} AS message_id,
               {_prompt(MASKED_SUBJECT, "'Desk ' || source || ' <[scrubbed]@example.com>'",
                        _redact('text'))} AS prompt
        FROM documents""",
    "respond_lookup": f"""
        SELECT 'doc-' || d.doc_id AS message_id, 'quality ' || quality AS tl_dr,
               CASE WHEN l.doc_id IS NOT NULL THEN 'label' END AS category,
               CAST(CASE WHEN l.doc_id IS NOT NULL THEN 0 END AS INTEGER) AS n_key_points,
               CASE WHEN l.doc_id IS NULL THEN 'summarize' END AS stage
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "respond_callable": f"""
        WITH p AS (SELECT doc_id, {_prompt(
            MASKED_SUBJECT, "'Desk ' || source || ' <[scrubbed]@example.com>'",
            _redact('text'))} AS prompt FROM documents)
        SELECT {ID} AS message_id,
               CASE WHEN doc_id % 10 NOT IN (7, 8) THEN length(prompt) || ' characters' END
                   AS summary,
               CASE doc_id % 10 WHEN 7 THEN NULL WHEN 8 THEN 10 ELSE doc_id + 1 END
                   AS tokens_prompt,
               CAST(CASE WHEN doc_id % 10 NOT IN (7, 8) THEN 2 END AS BIGINT)
                   AS tokens_completion,
               CASE doc_id % 10 WHEN 7 THEN 'no answer in time for ' || doc_id
                    WHEN 8 THEN 'responder returned no text (stop_reason=''max_tokens'', '
                                || 'block_types=[''tool_use''])' END AS error
        FROM p""",
    "missing_responses": f"""
        SELECT {ID} AS message_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "validate_summary": f"""
        SELECT {ID} AS message_id,
               CASE WHEN doc_id % 7 = 0 THEN 'Document ' || doc_id END AS tl_dr,
               CASE WHEN doc_id % 7 = 0 THEN lang END AS key_points,
               CAST(CASE WHEN doc_id % 7 = 0 THEN 0 END AS INTEGER) AS n_action_items,
               CASE WHEN doc_id % 7 <> 0 THEN 'summarize' END AS stage, {DEFECT} AS reason,
               CASE WHEN doc_id % 7 <> 0 THEN true END AS quote_is_short
        FROM documents""",
    "truncate_text": f"SELECT doc_id, {_TRUNCATED} AS quoted FROM documents",
    "record_assemble": f"""
        SELECT {ID} AS source_message_id, {SUBJECT} AS subject, 'Document ' || doc_id AS tl_dr,
               text AS summary, {_json_list('lang')} AS key_points, '[]' AS action_items,
               lang AS category, '{MODEL}' AS model, CAST(NULL AS BIGINT) AS tokens_prompt,
               CAST(NULL AS BIGINT) AS tokens_completion, {CLOCK} AS created_at
        FROM documents WHERE doc_id % 7 = 0""",
    "dead_letter_rows": f"""
        SELECT {ID} AS source_message_id, 'summarize' AS stage,
               'no valid summary: ' || {DEFECT} AS error, '' AS traceback, {CLOCK} AS failed_at
        FROM documents WHERE doc_id % 7 <> 0""",
    "dead_letter_split": f"""
        WITH {MESSAGES}, o AS (SELECT problem IS NOT NULL AS unread,
            message_id LIKE 'doc-%' AND n % 7 = 0 AS valid FROM m)
        SELECT count(*) FILTER (NOT unread AND valid) AS processed,
               count(*) FILTER (unread OR NOT valid) AS failed, CAST(0 AS BIGINT) AS failed_read,
               count(*) FILTER (unread) AS failed_parse,
               count(*) FILTER (NOT unread AND NOT valid) AS failed_summarize,
               CAST(0 AS BIGINT) AS failed_persist
        FROM o""",
    "insert_or_ignore": _order_store(),
    "indexed_append": _order_store(),
    "persist_isolated": f"""
        SELECT 'record' AS kind, {ID} AS message_id, NULL AS stage, 'text: ' || text AS content
        FROM documents WHERE doc_id % 331 <> 7
        UNION ALL
        SELECT 'dead letter', {ID}, 'persist', 'cannot write doc-' || doc_id
        FROM documents WHERE doc_id % 331 = 7""",
    "append_invalid": f"""
        WITH r AS (SELECT doc_id, text, CASE
            WHEN doc_id % 17 = 3 THEN 'source_message_id must not be empty'
            WHEN doc_id % 23 = 5 THEN 'model must not be empty'
            WHEN doc_id % 19 = 4 AND doc_id > 0 THEN 'tokens_prompt must not be negative'
            END AS refusal FROM documents)
        SELECT 'record' AS kind, {ID} AS message_id, NULL AS stage, 'text: ' || text AS content
        FROM r WHERE refusal IS NULL
        UNION ALL
        SELECT 'dead letter', CASE WHEN doc_id % 17 <> 3 THEN {ID} END, 'persist', refusal
        FROM r, (VALUES (1), (2)) runs(k) WHERE refusal IS NOT NULL""",
    "stream_replay": f"""
        WITH {MESSAGES}
        SELECT 'record' AS kind, message_id, NULL AS stage, answer AS content
        FROM m WHERE problem IS NULL
        UNION ALL
        SELECT 'dead letter', message_id, 'parse', problem FROM m WHERE problem IS NOT NULL""",
    "fetch_by_ids_versions": f"""
        WITH held AS (
            SELECT {ID} AS message_id, doc_id AS n, CASE WHEN doc_id % 4 < 2 THEN text ELSE '' END AS body
            FROM documents UNION ALL SELECT 'page-' || page_id, page_id, html FROM pages),
        ids AS (SELECT 'page-' || page_id AS message_id FROM pages UNION ALL
                SELECT {ID} FROM labels UNION ALL SELECT {ID} FROM labels)
        SELECT message_id, CAST(CASE WHEN n IS NOT NULL THEN 1 END AS INTEGER) AS seq,
               CASE WHEN n IS NULL
                    THEN 'unknown message_id: ' || chr(39) || message_id || chr(39)
                    WHEN n % 6 = 1 THEN 'invalid JSON' END AS error,
               CASE WHEN n % 6 <> 1 THEN sha256(coalesce(body, '')) END AS body_sha256
        FROM ids LEFT JOIN held USING (message_id)""",
    "run_label_batch_order": f"""
        SELECT kind, {ID} AS source_message_id, text AS summary
        FROM (SELECT * FROM documents WHERE source = 'src7' ORDER BY doc_id DESC LIMIT 7),
             (VALUES ('table'), ('archive')) kinds(kind)""",
    "export_and_emit_readback": f"""
        SELECT 'line' AS kind, NULL AS name, source_message_id, subject, summary
        FROM ({_order_store()}) WHERE subject LIKE 'version 1%'
        UNION ALL
        SELECT 'sample', printf('%03d_sample.json', row_number() OVER (ORDER BY n_nationkey)),
               'nation-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), n_name, n_name FROM nation""",
    "conversation_messages": """
        SELECT conv_id, turn, role, text, system FROM conversations LEFT JOIN (
            SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system
            FROM conversations WHERE role = 'system' GROUP BY conv_id) USING (conv_id)
        WHERE role <> 'system'""",
    "large_response_object": f"""
        SELECT {ID} AS message_id, 'quality ' || quality AS tl_dr, 'toxic ' || toxic AS summary,
               'label' AS category FROM labels
        UNION ALL SELECT 'first', 't', NULL, NULL""",
    "first_version": """
        SELECT 'order-' || o_orderkey AS source_message_id,
               'version ' || v || ' ' || o_orderpriority AS subject, CAST(v AS INTEGER) AS delivery
        FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 = 4 THEN 2
                        ELSE 1 END AS v FROM orders)""",
    "stream_ingest": _order_store(),
    "batch_store": f"""
        WITH {MESSAGES}
        SELECT 'record' AS kind, message_id, masked AS subject, answer AS content
        FROM m WHERE problem IS NULL
        UNION ALL
        SELECT 'dead letter', message_id, NULL, problem FROM m, (VALUES (1), (2)) runs(r)
        WHERE problem IS NOT NULL
        UNION ALL
        SELECT 'prompt', message_id, NULL, sha256({_prompt('masked', 'masked_sender', _redact('body'))})
        FROM m WHERE problem IS NULL""",
    "token_usage": USAGE,
    "token_running": f"""
        SELECT 'order-' || l_orderkey AS message_id, l_linenumber AS step, l_partkey, l_suppkey,
               CAST(sum({CALL_PROMPT}) OVER w AS BIGINT) AS tokens_prompt,
               CAST(sum({CALL_COMPLETION}) OVER w AS BIGINT) AS tokens_completion
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "run_totals": f"""
        SELECT count(*) AS messages_processed, CAST(3 AS BIGINT) AS messages_dlq,
               CAST(1 AS BIGINT) AS messages_dlq_dropped,
               CAST(sum(tokens_prompt) AS BIGINT) AS tokens_prompt_sum,
               CAST(sum(tokens_completion) AS BIGINT) AS tokens_completion_sum
        FROM ({USAGE})""",
    "run_totals_line": f"""
        SELECT 'run_totals messages_processed=' || count(*) || ' messages_dlq=3'
               || ' messages_dlq_dropped=1 tokens_prompt_sum=' || {_shown('sum(tokens_prompt)')}
               || ' tokens_completion_sum=' || {_shown('sum(tokens_completion)')} AS value
        FROM ({USAGE})""",
    "completion_log": f"""
        SELECT 'summary_completed message_id=' || message_id || ' tokens_prompt='
               || {_shown('tokens_prompt')} || ' tokens_completion='
               || {_shown('tokens_completion')} || ' duration_ms=' || length(message_id) AS value
        FROM ({USAGE})""",
    "timing_log": TIMINGS,
    "timing_summary": f"""
        SELECT count(*) AS messages, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms,
               CAST(coalesce(max(duration_ms), 0) AS BIGINT) AS slowest_ms
        FROM ({TIMINGS})""",
    "slowest_message": f"""
        SELECT message_id, duration_ms FROM ({TIMINGS})
        ORDER BY duration_ms DESC, message_id LIMIT 1""",
    "slo_breaches": f"""
        WITH t AS ({TIMINGS})
        SELECT 'NFR-P1' AS target, message_id, duration_ms, {P1} AS breach FROM t
        WHERE duration_ms > 20000
        UNION ALL
        SELECT 'NFR-P2', NULL, duration_ms, {P2}
        FROM (SELECT CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM t)
        WHERE duration_ms > 120000""",
    "stdout_records": f"""
        SELECT {ID} AS source_message_id, {SUBJECT} AS subject,
               'Ask ' || source || '@example.org' AS tl_dr, text AS summary,
               {_json_list('lang', "source || '@example.net'")} AS key_points,
               {_json_list("'mail ' || lang || '@example.com'")} AS action_items,
               lang AS category, '{MODEL}' AS model, n_chars AS tokens_prompt,
               CASE WHEN doc_id % 6 <> 0 THEN doc_id END AS tokens_completion,
               {CLOCK} AS created_at
        FROM documents""",
    "redact_record": f"""
        SELECT {ID} AS source_message_id, {MASKED_SUBJECT} AS subject,
               'Ask [scrubbed]@example.com' AS tl_dr, {_redact('text')} AS summary,
               {_json_list('lang', "'[scrubbed]@example.com'")} AS key_points,
               {_json_list("'mail [scrubbed]@example.com'")} AS action_items,
               lang AS category, n_chars AS tokens_prompt,
               CASE WHEN doc_id % 6 <> 0 THEN doc_id END AS tokens_completion
        FROM documents""",
    "sample_names": """
        SELECT doc_id, printf('%03d_sample.json', row_number() OVER (
                   ORDER BY lang, n_chars, doc_id)) AS sample_name
        FROM documents""",
    "offline_replay": f"""
        WITH {MESSAGES}
        SELECT message_id AS source_message_id, masked AS subject, tl_dr, answer AS summary,
               key_points, '[]' AS action_items, category, '{MODEL}' AS model,
               CAST(NULL AS BIGINT) AS tokens_prompt, CAST(NULL AS BIGINT) AS tokens_completion,
               {CLOCK} AS created_at,
               sha256({_prompt('masked', 'masked_sender', _redact('body'))}) AS prompt
        FROM m""",
    "records_and_dead_letters": f"""
        WITH {MESSAGES}, p AS (
            SELECT *, {_prompt('masked', 'masked_sender', _redact('body'))} AS prompt FROM m)
        SELECT message_id AS source_message_id,
               CASE WHEN problem IS NULL THEN masked END AS subject,
               CASE WHEN problem IS NULL THEN length(prompt) END AS prompt_chars,
               CASE WHEN problem IS NULL THEN sha256(prompt) END AS prompt_sha256,
               CASE WHEN problem IS NULL THEN tl_dr END AS tl_dr,
               CASE WHEN problem IS NULL THEN category END AS category,
               CASE WHEN problem IS NOT NULL THEN 'parse' END AS stage, problem AS error
        FROM p""",
}
