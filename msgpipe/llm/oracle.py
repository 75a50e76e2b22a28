"""DuckDB SQL for the queries that SQL can express.

The others depend on a trained or mined model (1, 10), a tokenizer (2, 9), XXH64 (3, 4, 7),
discovered patterns (6) or random letter vectors (11); tests compare those with plain
versions.
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)



def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Whole scans of every part over every entry, round by round."""
    def books(before: str, codes: str, name: str) -> str:
        # Position by position; an entry without a part keeps what it was.
        return f"""
        {name}_means AS (
            SELECT p, e, list(m ORDER BY pos) AS x FROM (
                SELECT c.p, c.e, pos, floor(sum(x.x[pos]) / count(*)) AS m
                FROM {codes} c JOIN pieces x USING (r, p), places GROUP BY c.p, c.e, pos) GROUP BY p, e
        ), {name} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.x, b.x) AS x
            FROM {before} b LEFT JOIN {name}_means m USING (p, e))"""

    def codes(book: str, name: str) -> str:
        squared = ("list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) "
                   "+ list_inner_product(b.x, b.x)")
        return f"""
        {name} AS MATERIALIZED (
            SELECT r, p, best % {entries} AS e, best // {entries} AS d FROM (
                SELECT v.r, v.p, min(CAST({squared} AS BIGINT) * {entries} + b.e) AS best
                FROM pieces v JOIN {book} b USING (p) GROUP BY v.r, v.p))"""

    steps = [codes("book0", "codes0")]
    for k in range(rounds):
        steps += [books(f"book{k}", f"codes{k}", f"book{k + 1}"),
                  codes(f"book{k + 1}", f"codes{k + 1}")]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label,
                   list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), size AS (SELECT max(len(v)) // {parts} AS n FROM kept
        ), places AS (SELECT CAST(unnest(range(1, n + 1)) AS BIGINT) AS pos FROM size
        ), pieces AS MATERIALIZED (
            SELECT r, p, v[p * n + 1:(p + 1) * n] AS x
            FROM kept, size, (SELECT unnest(range({parts})) AS p)
        ), book0 AS MATERIALIZED (SELECT p, r AS e, x FROM pieces WHERE r < {entries}),
        {",".join(steps)},
        coded AS (
            SELECT r, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code,
                   CAST(sum(d) AS BIGINT) AS error FROM codes{rounds} GROUP BY r
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y:
                   CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS s
            FROM book{rounds})
        SELECT vec_id, code, error,
               CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               s AS codebooks_sha256
        FROM kept JOIN coded USING (r), digest
    """


SQL = {
    "op5_embedding_pca": """
        WITH RECURSIVE vectors AS (
            SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND x <> 0)) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
            ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reached(a, b) AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), smallest AS (SELECT a, min(least(a, b)) AS component_id FROM reached GROUP BY a
        ), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
               coalesce(component_id, vec_id) AS component_id,
               vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN counts ON vec_id = counts.a LEFT JOIN smallest ON vec_id = smallest.a
    """,
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
        ), items AS (SELECT item_id, w, least(len(w), 10) AS k
            FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
        ), windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM items)
        ), sizes AS (SELECT DISTINCT k FROM windows
        ), places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                  FROM d, sizes WHERE len(w) >= k)
        ), hits AS (SELECT doc_id, item_id, i, p.k FROM places p JOIN windows v USING (k, g)
        ), words AS (SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id
        ), found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op12_importance_resampling": f"""
        WITH bits AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
                   THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc
            FROM (SELECT unnest(range(256)) AS n)
        ), words AS MATERIALIZED (
            SELECT 0 AS side, doc_id, unnest({_WORDS}) AS w FROM documents
            UNION ALL SELECT 1, item_id, unnest({_WORDS}) FROM benchmark
        ), hashed AS MATERIALIZED (
            SELECT w, xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda k:
                   CAST('0x' || substr(hex(encode(w)), 2 * k - 1, 2) AS BIGINT)),
                   lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295),
                   4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT w FROM words), bits
        ), counts AS (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
            FROM words JOIN hashed USING (w) GROUP BY bucket
        ), totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all
            FROM counts
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000)
                   / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
            FROM counts, totals
        ), sums AS (
            SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
            FROM words JOIN hashed USING (w) JOIN gains USING (bucket)
            WHERE side = 0 GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x'
                   || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))
                   AS BIGINT) AS score
            FROM documents LEFT JOIN sums USING (doc_id)
        ), placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
                   count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN place <= 10 * n // 100 THEN place END AS rank
        FROM scored LEFT JOIN placed USING (doc_id)
    """,
    "op13_vector_codes": _vector_codes(),
}
