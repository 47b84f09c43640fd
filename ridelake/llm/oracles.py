"""Check SQL (DuckDB) of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_CTES = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
runs AS (SELECT r, len(words) AS n, unnest(range(1, greatest(len(words) - 3, 1))) AS i, words FROM texts),
hashed AS (SELECT r, i, array_to_string(words[i : i + 4], ' ') AS run FROM runs),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS k FROM hashed) WHERE k > 1),
gaps AS (SELECT r, least(5, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 5)) AS w FROM twice),
repeated AS (SELECT r, sum(w) AS n_repeat_words FROM gaps GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stats AS (SELECT t.r, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM texts t LEFT JOIN dups d ON t.r = d.r LEFT JOIN repeated p ON t.r = p.r),
base AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n_docs, sum(base_failed::INT) AS n_failed FROM base GROUP BY source),
moments AS (SELECT sum(n_failed) / sum(n_docs) AS m, avg((n_failed / n_docs) * (n_failed / n_docs)) AS sq,
                   avg(n_failed / n_docs) AS hm FROM hosts),
spread AS (SELECT m, sq - 2 * m * hm + m * m AS v FROM moments),
prior AS (SELECT m, greatest(CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1 END, 1) AS k FROM spread),
verdicts AS (SELECT source, (n_failed + m * k) / (n_docs + k) <= 0.5 AS host_kept FROM hosts, prior)"""

QUALITY = f"""
WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND host_kept AS kept
FROM base JOIN verdicts ON base.source IS NOT DISTINCT FROM verdicts.source"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"


def _spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Offsets of matches, from the lengths of the pieces between them."""
    return f"""
{kind}_pieces AS (SELECT r, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS pieces
                  FROM texts WHERE regexp_matches(text, '{pattern}')),
{kind}_rows AS (SELECT r, unnest(range(1, len(found) + 1)) AS i, found, pieces FROM {kind}_pieces),
{kind}_sizes AS (SELECT r, i, found[i] AS value, length(pieces[i]) AS gap, length(found[i]) AS size FROM {kind}_rows),
{kind}_at AS (SELECT r, value, size, (sum(gap + size) OVER (PARTITION BY r ORDER BY i) - size)::BIGINT AS begin FROM {kind}_sizes),
{kind}_spans AS (SELECT r, '{kind}' AS kind, {rank} AS rank, begin, begin + size AS stop, value FROM {kind}_at WHERE {keep})"""


SECRET_CTES = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_spans("assign", 0, _ASSIGN, f"length(regexp_extract(value, '{_ASSIGN}', 1)) >= 6")},
{_spans("access", 1, "AKIA[A-Z0-9]+", "length(value) >= 20")},
{_spans("hex", 2, "[0-9a-f]{24,}", "true")},
{_spans("entropy", 3, _CANDIDATE, "true")},
candidates AS (SELECT DISTINCT value, CASE
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-fA-F]')
         AND (regexp_full_match(value, '[0-9a-f]+') OR regexp_full_match(value, '[0-9A-F]+')) THEN 3.0
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND regexp_full_match(value, '[A-Za-z0-9]+') THEN 3.7
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') THEN 3.9 END AS bits FROM entropy_spans
    WHERE NOT regexp_full_match(value, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')
      AND NOT regexp_matches(value, '(?i)example|placeholder|redacted|your[_-]?(key|token|secret|password)')
      AND NOT regexp_full_match(value, '(?i)(sha256|sha384|sha512)-[A-Za-z0-9+/=]+')),
places AS (SELECT value, bits, unnest(range(1, length(value) - 18)) AS i FROM candidates WHERE bits IS NOT NULL),
chars AS (SELECT value, bits, i, unnest(string_split(value[i : i + 19], '')) AS c FROM places),
counts AS (SELECT value, bits, i, c, count(*) AS n FROM chars GROUP BY ALL),
windows AS (SELECT value, bits, i, log2(20) - sum(n * log2(n)) / 20 AS h FROM counts GROUP BY ALL),
secret AS (SELECT value FROM windows GROUP BY value, bits HAVING max(h) >= bits),
spans AS (SELECT * FROM assign_spans UNION ALL SELECT * FROM access_spans UNION ALL SELECT * FROM hex_spans
          UNION ALL SELECT * FROM entropy_spans WHERE value IN (SELECT value FROM secret)),
listed AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                  count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg(concat_ws(':', kind, begin, stop), ',' ORDER BY begin, rank) FILTER (kind <> 'entropy') AS base,
                  string_agg(concat_ws(':', kind, begin, stop), ',' ORDER BY begin, rank) AS spans
           FROM spans GROUP BY r)"""

SECRETS = f"""
WITH {SECRET_CTES}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed ON texts.r = listed.r"""

URLS = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(suffix, prefix, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (SELECT page_id, host, path,
    (SELECT arg_max(suffix || prefix, length(suffix || prefix)) FROM rules
     WHERE (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix)) AS rule FROM parts)
SELECT page_id, host, path, rule,
       coalesce((SELECT verdict FROM rules WHERE suffix || prefix = rule),
                CASE WHEN len(list_intersect(string_split(host, '.'),
                          ['spam-farm', 'cheap-pills', 'casino-win', 'free-bets', 'ads-track', 'adult-x'])) > 0
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""

PREFERENCES = r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text,
                      '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
               FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                     WHERE conv_id IS NOT NULL)),
pairs AS (SELECT conv_id // 2 AS pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM turns
          GROUP BY ALL HAVING min(conv_id) < max(conv_id)),
equal_turns AS (SELECT pair_id, a.k FROM pairs JOIN turns a ON a.conv_id = chosen_id
         JOIN turns b ON b.conv_id = rejected_id AND a.k = b.k AND a.role = b.role AND a.text = b.text),
shared AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id, k, row_number() OVER (PARTITION BY pair_id ORDER BY k) AS i FROM equal_turns)
           WHERE k = i GROUP BY pair_id),
known AS (SELECT pairs.*, coalesce(n, 0) AS n FROM pairs LEFT JOIN shared USING (pair_id)),
sided AS (SELECT pair_id, n, 'chosen' AS side, k, role, shown FROM known JOIN turns ON conv_id = chosen_id
          UNION ALL SELECT pair_id, n, 'rejected', k, role, shown FROM known JOIN turns ON conv_id = rejected_id),
placed AS (SELECT *, coalesce(sum(length(shown)) FILTER (k > n) OVER (PARTITION BY pair_id, side ORDER BY k), 0)::BIGINT AS stop FROM sided),
spans AS (SELECT *, CASE WHEN k > n AND role = 'assistant'
                    THEN (stop - length(shown) + length(role) + 5)::VARCHAR || ':' || stop::VARCHAR END AS span FROM placed),
texts AS (SELECT pair_id, n,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (k <= n AND side = 'chosen'), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (k > n AND side = 'chosen'), '') AS chosen,
    coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 'chosen'), '') AS chosen_mask,
    coalesce(string_agg(shown, '' ORDER BY k) FILTER (k > n AND side = 'rejected'), '') AS rejected,
    coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 'rejected'), '') AS rejected_mask
    FROM spans GROUP BY pair_id, n)
SELECT pair_id, n::INTEGER AS n_prompt_turns, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, chosen_mask,
       sha256(rejected) AS rejected_sha256, rejected_mask FROM texts"""


#: Checksum of a text, byte by byte, through the usual table of 256 remainders.
CRC_TABLE = """
crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)
                          ORDER BY b) AS crcs FROM (SELECT unnest(range(256)) AS b))"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, where ``crcs`` of the table is in reach."""
    return (
        f"xor(4294967295, list_reduce([ord(c) FOR c IN string_split({text}, '')], "
        "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295))"
    )


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _tree(name: str, keys: str) -> str:
    """Nodes of all levels over ``<name>_leaves`` (keys, i, h, n)."""
    return f"""
{name}_nodes AS (
    SELECT 0 AS lvl, {keys} i, h, n FROM {name}_leaves
    UNION ALL
    SELECT lvl + 1, {keys} i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16
    FROM {name}_nodes WHERE n > 1 GROUP BY lvl, {keys} i // 16, n),
{name}_runs AS (SELECT lvl, {keys} i // 16 AS run, string_agg(h, '' ORDER BY i) AS hs FROM {name}_nodes
                WHERE n > 1 GROUP BY lvl, {keys} i // 16)"""


def _fold(name: str, start: str, key: str) -> str:
    """One row per document and level: its hash so far, the untouched one and the siblings met."""
    return f"""
{name}_fold AS (
    {start}
    UNION ALL
    SELECT f.r, f.source, f.lvl + 1, f.i // 16, sha256(hs[: 64 * (f.i % 16)] || f.h || hs[64 * (f.i % 16 + 1) + 1 :]),
           f.proof || hs[: 64 * (f.i % 16)] || hs[64 * (f.i % 16 + 1) + 1 :]
    FROM {name}_fold f JOIN {name}_runs t ON f.lvl = t.lvl AND f.i // 16 = t.run AND {key}),
{name}_top AS (SELECT r, source, h, proof FROM {name}_fold QUALIFY row_number() OVER (PARTITION BY r ORDER BY lvl DESC) = 1)"""


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, source, sha256({_FIELDS} || {_field("text")}) AS leaf,
           CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN sha256({_FIELDS} || {_field(_LOWERED)}) END AS tampered
    FROM documents, crc_table),
source_leaves AS MATERIALIZED (
    SELECT r, doc_id, source, leaf AS h, tampered, count(*) OVER (PARTITION BY source) AS n,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM docs),
{_tree("source", "source,")},
dataset_leaves AS MATERIALIZED (
    SELECT source, h, count(*) OVER () AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
    FROM source_nodes WHERE n = 1),
{_tree("dataset", "")},
{_fold("source", "SELECT r, source, 0 AS lvl, i, coalesce(tampered, h) AS h, '' AS proof FROM source_leaves",
       "f.source IS NOT DISTINCT FROM t.source")},
{_fold("dataset", '''SELECT r, s.source, 0 AS lvl, i, s.h, proof FROM source_top s
                     JOIN dataset_leaves d ON s.source IS NOT DISTINCT FROM d.source''', "true")}
SELECT l.doc_id, l.h AS leaf, d.h AS subroot, root, sha256(proof) AS proof_sha256, t.h AS folded_root, t.h = root AS verified
FROM source_leaves l JOIN dataset_top t ON l.r = t.r JOIN dataset_leaves d ON l.source IS NOT DISTINCT FROM d.source,
     (SELECT h AS root FROM dataset_nodes WHERE n = 1)"""


_TURN_NAME = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

#: The same costs over the places of the grammar (0 begin, 1 after system, 2 after user, 3 after
#: assistant), where a path inserts at most one role before a row that it uses.
REPAIRS = f"""
WITH RECURSIVE {CRC_TABLE},
faulty AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(_TURN_NAME)} % 20 AS fault
    FROM conversations, crc_table),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM faulty)),
ranked AS (
    SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
           left(role, 1) AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS empty,
           regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS open
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS MATERIALIZED (
    SELECT conv_id, turn, role, text, pos, ini, empty, NOT empty AND nth > 1 AS again, NOT empty AND nth = 1 AND open AS cut,
           count(*) OVER (PARTITION BY conv_id) AS n,
           coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini NOT IN ('su', 'ua', 'au'), false) AS bad
    FROM ranked),
moves(q, before, want, next) AS (VALUES
    (0, '', 'd', 0), (1, '', 'd', 1), (2, '', 'd', 2), (3, '', 'd', 3),
    (0, '', 's', 1), (0, '', 'u', 2), (1, '', 'u', 2), (2, '', 'a', 3), (3, '', 'u', 2),
    (0, 'user', 'a', 3), (1, 'user', 'a', 3), (2, 'assistant', 'u', 2), (3, 'user', 'a', 3)),
paths AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS pos, n, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM judged
    UNION ALL
    SELECT p.conv_id, p.pos + 1, p.n, next, min({{
        'cost': p.best.cost + CASE WHEN want = 'd' THEN 2 ELSE 5 * (before <> '')::INT + (ini <> want)::INT + 5 * cut::INT END,
        'audit': p.best.audit || CASE WHEN want = 'd' THEN 'D' ELSE CASE WHEN before <> '' THEN 'I' ELSE '' END
                                 || CASE WHEN ini = want THEN 'K' ELSE 'R' END END,
        'lines': p.best.lines || CASE WHEN want = 'd' THEN []::VARCHAR[] ELSE CASE WHEN before <> '' THEN [before || ':'] ELSE []::VARCHAR[] END
                 || [CASE WHEN ini = want THEN role WHEN want = 'u' THEN 'user' ELSE 'assistant' END || ':' || text] END}})
    FROM paths p JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = p.pos + 1 JOIN moves m ON p.q = m.q
    WHERE want = 'd' OR (NOT empty AND NOT again AND (want <> 's' OR ini = 's'))
    GROUP BY p.conv_id, p.pos, p.n, next),
ended AS (
    SELECT conv_id, min({{'cost': best.cost + CASE WHEN q = 2 THEN 5 ELSE 0 END, 'audit': best.audit || CASE WHEN q = 2 THEN 'I' ELSE '' END,
                         'lines': best.lines || CASE WHEN q = 2 THEN ['assistant:'] ELSE []::VARCHAR[] END}}) AS best
    FROM paths WHERE pos = n AND q <> 1 GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(empty::INT) AS blank,
           sum(again::INT) AS duplicate, sum(cut::INT) AS truncated, sum(bad::INT) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""
