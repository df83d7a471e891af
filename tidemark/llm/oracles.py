"""The DuckDB equivalents of the queries that SQL can express, written from the contracts and not from the operators."""

EXACT_DEDUP = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

#: crc(t): the 256 steps of the checksum; _CRC32 % bytes: its value for a list of bytes.
_STEPS = """crc AS MATERIALIZED (
        SELECT list(v ORDER BY i) AS t
        FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
              FROM range(256) r(i)))"""
_CRC32 = "xor(list_reduce(list_prepend(4294967295, %s), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
_BYTES = "list_transform(range(1, length(%s), 2), lambda i: ('0x' || substr(%s, i, 2))::BIGINT)"

TARGET_RESAMPLING = rf"""
    WITH {_STEPS},
    found AS MATERIALIZED (
        SELECT 'd' AS kind, row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents
        UNION ALL
        SELECT 't', 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
        FROM benchmark),
    features AS MATERIALIZED (SELECT kind, r, word, count(*) AS n FROM (SELECT kind, r, unnest(words) AS word FROM found) GROUP BY ALL),
    spelt AS (SELECT word, hex(encode(word)) AS x FROM features GROUP BY word),
    hashed AS MATERIALIZED (SELECT word, {_CRC32 % (_BYTES % ("x", "x"))} % 10000 AS bucket FROM spelt, crc),
    counted AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM features JOIN hashed USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
        FROM counted),
    weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
    scored AS (
        SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM found LEFT JOIN weights USING (r) WHERE kind = 'd'),
    ranked AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight DESC, n_features) AS place, count(*) OVER () AS n
        FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)"""

#: A matrix of unity, the entry of an 8 x 8 grey video, and the boxes around the tables, spelt in hex.
_UNITY = "'00010000' || repeat('00', 12) || '00010000' || repeat('00', 12) || '40000000'"
MEDIA_COLUMNS = f"""
    WITH {_STEPS},
    sized AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
               greatest(64, (strlen(coalesce(text, '')) + 63) // 64 * 64)::BIGINT AS p
        FROM documents),
    filled AS (SELECT doc_id, n_bytes, p, p // 64 AS f, (p // 64 + 15) // 16 AS chunks, (p // 64 + 11) // 12 AS keys, lower(x) || repeat('00', p - n_bytes) AS payload FROM sized),
    spread AS (
        SELECT *, CASE WHEN chunks = 1 THEN printf('00000001000000010000%04x00000001', least(f, 16))
                       WHEN f % 16 = 0 THEN '00000001000000010000001000000001'
                       ELSE printf('0000000200000001000000100000000100%06x000000%02x00000001', chunks, f % 16) END AS stsc
        FROM filled),
    tables AS (
        SELECT doc_id, n_bytes, p, f, keys, payload,
               '00000066' || '73747364' || '00000000' || '00000001' || '00000056' || '72617720' || repeat('00', 6) || '0001' || repeat('00', 16) || '00080008'
                   || '00480000' || '00480000' || '00000000' || '0001' || repeat('00', 32) || '0028' || 'ffff'
               || '00000018' || '73747473' || '00000000' || '00000001' || printf('%08x', f) || '00000001'
               || printf('%08x', 16 + 4 * keys) || '73747373' || '00000000' || printf('%08x', keys) || list_aggregate(list_transform(range(keys), lambda i: printf('%08x', 12 * i + 1)), 'string_agg', '')
               || printf('%08x', 12 + length(stsc) // 2) || '73747363' || '00000000' || stsc
               || '00000014' || '7374737a' || '00000000' || '00000040' || printf('%08x', f)
               || printf('%08x', 16 + 4 * chunks) || '7374636f' || '00000000' || printf('%08x', chunks) || list_aggregate(list_transform(range(chunks), lambda i: printf('%08x', 32 + 1024 * i)), 'string_agg', '') AS stbl
        FROM spread),
    files AS (
        SELECT *, length(stbl) // 2 + 8 AS inner_,
               '00000018' || '66747970' || '69736f6d' || '00000000' || '69736f6d' || '71742020'
               || printf('%08x', p + 8) || '6d646174' || payload
               || printf('%08x', inner_ + 353) || '6d6f6f76'
               || '0000006c' || '6d766864' || repeat('00', 12) || '00000019' || printf('%08x', f) || '00010000' || '0100' || repeat('00', 10) || {_UNITY} || repeat('00', 24) || '00000002'
               || printf('%08x', inner_ + 237) || '7472616b'
               || '0000005c' || '746b6864' || '00000003' || repeat('00', 8) || '00000001' || '00000000' || printf('%08x', f) || repeat('00', 16) || {_UNITY} || '00080000' || '00080000'
               || printf('%08x', inner_ + 137) || '6d646961'
               || '00000020' || '6d646864' || repeat('00', 12) || '00000019' || printf('%08x', f) || '55c4' || '0000'
               || '00000021' || '68646c72' || repeat('00', 8) || '76696465' || repeat('00', 13)
               || printf('%08x', inner_ + 64) || '6d696e66'
               || '00000014' || '766d6864' || '00000001' || repeat('00', 8)
               || '00000024' || '64696e66' || '0000001c' || '64726566' || '00000000' || '00000001' || '0000000c' || '75726c20' || '00000001'
               || printf('%08x', inner_) || '7374626c' || stbl AS media
        FROM tables)
    SELECT doc_id, n_bytes, p AS payload_bytes, sha256(unhex(payload)) AS payload_sha256,
           {_CRC32 % (_BYTES % ("right(payload, 128)", "right(payload, 128)"))}::BIGINT AS tail_crc32,
           (length(media) // 2)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256,
           'raw 8x8 ' || f || '/25 ' || f || ' ' || list_aggregate(list_transform(range(keys), lambda i: (32 + 768 * i) || '+64'), 'string_agg', ',') AS feature
    FROM files, crc"""


def _vector_codes(rounds: int = 6) -> str:
    distance = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, p, min({{'d': {distance}, 'e': e}}) AS best FROM cut JOIN book{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            steps.append(
                f"""mean{k} AS (
        SELECT p, e, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS m
        FROM (SELECT p, best.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k} JOIN cut USING (r, p), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL)
        GROUP BY p, e),
    book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
            )
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x
        FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))),
    cut AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS v FROM kept, range(8) parts(p)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM cut WHERE r <= 16),
    {",\n    ".join(steps)},
    coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"""


VECTOR_CODES = _vector_codes()
