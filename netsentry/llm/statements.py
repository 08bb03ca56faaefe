"""DuckDB statements of the manifest, the trie of conversations and the phrase removal."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: a byte is taken in, then eight bits are shifted out."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda t: CAST(ascii(t) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


WORD = r"[^\x20\x09-\x0D]+"

MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, leaf, claim, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
        FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
                     CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS claim
              FROM documents)),
    tree AS (
        SELECT lang, 0 AS level, place, n, leaf AS h FROM leaves
        UNION ALL
        SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM tree WHERE n > 1
        GROUP BY lang, level, place // 2, n),
    tops AS (
        SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
        FROM tree WHERE n = 1),
    upper AS (
        SELECT 0 AS level, place, n, subroot AS h FROM tops
        UNION ALL
        SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM upper WHERE n > 1
        GROUP BY level, place // 2, n),
    steps AS (
        SELECT l.r, t.level, l.place >> t.level AS place, s.h AS sibling
        FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
        LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.place = xor(l.place >> t.level, 1)
        UNION ALL
        SELECT l.r, o.height + t.level, o.place >> t.level, s.h
        FROM leaves l JOIN tops o ON l.lang IS NOT DISTINCT FROM o.lang
        CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) t
        LEFT JOIN upper s ON s.level = t.level AND s.place = xor(o.place >> t.level, 1)),
    proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY r),
    folded AS (
        SELECT r, 0 AS level, claim AS h FROM leaves
        UNION ALL
        SELECT f.r, f.level + 1, sha256(CASE WHEN s.place % 2 = 1 THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
        FROM folded f JOIN steps s ON f.r = s.r AND f.level = s.level),
    ends AS (SELECT r, max_by(h, level) AS folded_root FROM folded GROUP BY r)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN tops o ON l.lang IS NOT DISTINCT FROM o.lang
    CROSS JOIN (SELECT h AS root FROM upper WHERE n = 1) LEFT JOIN proofs USING (r) JOIN ends USING (r)"""

TRIE = f"""
    WITH t AS (
        SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, turns, CAST({crc32('CAST(conv_id AS VARCHAR)')} % 4 AS BIGINT) AS h, conv_id - conv_id % 20 AS base FROM own),
    c AS (
        SELECT h.conv_id, list_concat(coalesce(own.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
        FROM h LEFT JOIN own ON own.conv_id = h.base),
    p AS (SELECT conv_id, len(turns) AS length, d, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
    n AS (
        SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '') AS ends,
               CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '{WORD}')) END AS words
        FROM p GROUP BY prefix, d),
    k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
    s AS (
        SELECT prefix[1:d] AS prefix, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY ALL)
    SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
    FROM m JOIN s USING (prefix) LEFT JOIN n AS up ON m.depth > 0 AND up.prefix = m.prefix[1:m.depth - 1]"""

PHRASES = f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
               regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
        FROM documents),
    s AS (SELECT r, id, p, array_to_string(w[p:p + 19], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - 18)) AS p FROM d)),
    l AS (SELECT r, p, {{'id': id, 'p': p}} AS own, min({{'id': id, 'p': p}}) OVER (PARTITION BY said) AS first FROM s),
    gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS p FROM l WHERE first < own),
    kept AS (
        SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept
        FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)"""
