"""DuckDB SQL for the queries that SQL can express.

Not here: token merges (op1), square roots summed in another order (op3), fitted
models (op9, op10, pipeline), XXH64 (op13); tests/llm compares those with plain versions.
"""

from __future__ import annotations

from . import chat, decontaminate, jaccard, ranked, spelling, suffixes

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def warc_sql() -> str:
    # 40 hex digits are eight times five, and five are four digits of base 32
    digits = " || ".join(
        f"substr('{_BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INTEGER + 1, 1)"
        for i in range(8)
        for shift in (15, 10, 5, 0)
    )
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    hashed AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
    first AS (SELECT h, min(page_id) AS lead FROM hashed GROUP BY h)
    SELECT page_id, payload_bytes, {digits} AS payload_digest,
        CASE WHEN page_id IS NULL OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> lead THEN lead END AS refers_to
    FROM hashed JOIN first USING (h)"""


def _shingles_sql(words: str, n: int) -> str:
    """Distinct n-word shingles of a list of words; the whole list if it is shorter."""
    return f"""list_distinct(list_transform(range(1, greatest(len({words}) - {n - 1}, 1) + 1),
        lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' ')))"""


def decontaminate_sql() -> str:
    words = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    shingles = _shingles_sql("w", decontaminate.WORDS)
    return f"""WITH dw AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
    i AS (SELECT item_id, {shingles} AS s FROM iw WHERE len(w) > 0),
    ds AS (SELECT doc_id, unnest({shingles}) AS g FROM dw WHERE len(w) > 0),
    ig AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM i)
    SELECT doc_id, item_id, count(*)::INTEGER AS n_shared, n_item::INTEGER AS n_item
    FROM ds JOIN ig USING (g) GROUP BY doc_id, item_id, n_item
    HAVING 100 * count(*) >= {decontaminate.PERCENT} * n_item"""


def chat_sql(said: str) -> str:
    def escaped(text: str) -> str:
        return rf"replace(replace({text}, '\', '\\'), '<|', '<\|')"

    marks = len(chat.START) + len(chat.END) + 2
    role = f"len(replace({escaped('role')}, chr(10), '{chr(92)}' || chr(10)))"
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'))
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(len(text)) FILTER (role = '{chat.TRAINED}'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
            FILTER (role = '{chat.TRAINED}'), '')) AS loss_sha256,
        sum({marks} + {role} + len({escaped('text')}))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


def suffixes_sql() -> str:
    n = suffixes.LENGTH
    return f"""WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
    strings AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS s
        FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {n - 1})) AS i FROM d)),
    first AS (SELECT s, min(doc_id) AS lead FROM strings GROUP BY s),
    gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS p
        FROM (SELECT doc_id, i FROM strings JOIN first USING (s) WHERE lead < doc_id), range(0, {n}) AS t(j)),
    counted AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (step) AS n_spans
        FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS step
        FROM gone) GROUP BY doc_id),
    bytes AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b
        FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d)),
    kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS h FROM bytes
        ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
        coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
    FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def urls_sql(rules) -> str:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    ascii_lower = "translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH rules(rh, rp, rv) AS (VALUES {values}),
    cut AS (SELECT row_number() OVER () AS n, page_id,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (SELECT n, page_id, rest, regexp_extract(rest, '(?s)^([^/?#]*)', 1) AS raw FROM cut),
    located AS (SELECT n, page_id, {ascii_lower} AS host,
        regexp_extract(substr(rest, len(raw) + 1), '(?s)^([^?#]*)', 1) AS path FROM split),
    best AS (SELECT n, arg_max((rh || rp, rv), (len(rh || rp), len(rh))) AS b FROM located JOIN rules
        ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
    SELECT page_id, host, path, b[1] AS rule, coalesce(b[2], 'allow') AS verdict
    FROM located LEFT JOIN best USING (n)"""


def jaccard_sql() -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lowered}, '[^\x20\x09-\x0D]+')"
    shingles = _shingles_sql("w", jaccard.WORDS)
    return f"""WITH RECURSIVE dw AS (SELECT doc_id, {words} AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) > 0 THEN {shingles} ELSE [] END AS s FROM dw),
    g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= {jaccard.PERCENT} * (a.n + b.n - count(*))),
    reach AS (SELECT DISTINCT u, u AS v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
    least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
    SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id
    FROM sets LEFT JOIN least ON u = doc_id"""


def ranked_sql() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = rf"regexp_extract_all({lowered}, '{ranked.TERM}')"
    return f"""WITH q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
    d AS (SELECT doc_id, {terms} AS w FROM documents),
    sizes AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
    whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM tf, whole GROUP BY term, big_n),
    m AS (SELECT doc_id, 10 + (90 * n * big_n) // big_l AS m FROM sizes, whole),
    scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
        doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {ranked.K}"""


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def spelling_sql() -> str:
    s = spelling
    byte = "('0x' || substr(h, 2 * i + 1, 2))::BIGINT"
    return rf"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id,
        translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
        WHERE len(run) >= {s.LEAST_LENGTH} GROUP BY doc_id, run),
    bytes AS (SELECT doc_id, run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
    hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(0, len(h) // 2), lambda i: {byte})),
        lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295) AS c FROM bytes),
    words AS (SELECT CASE WHEN c % {s.SLIP} = 0
        THEN substr(run, 1, (c % len(run))::INTEGER) || substr(run, (c % len(run))::INTEGER + 2)
        ELSE run END AS word, times FROM hashed),
    vocabulary AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM words
        WHERE len(word) >= {s.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {s.LEAST_COUNT}),
    cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, unnest(range(0, len(word))) AS i FROM vocabulary)),
    pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT cut.word, v.word FROM cut JOIN vocabulary v ON rest = v.word
        UNION SELECT v.word, cut.word FROM cut JOIN vocabulary v ON rest = v.word),
    best AS (SELECT pairs.word, count(*) AS n_near, max(n) AS best_n,
        arg_min(near, (-n, encode(near))) AS best FROM pairs JOIN vocabulary v ON near = v.word GROUP BY pairs.word),
    formed AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN best_n >= {s.FORM_RATIO} * n THEN best END AS form,
        CASE WHEN best_n >= {s.FORM_RATIO} * n THEN best_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root FROM formed
        UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL)
    SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
    WHERE root NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)"""
