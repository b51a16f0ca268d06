"""SQL (DuckDB) of the queries whose results SQL can state over whole tables."""

from __future__ import annotations

from .licenses import COPYRIGHT, KNOWN, PUNCTUATION, SPELLINGS

ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS9 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
ORACLE: dict[str, str] = {}

ORACLE["op2_topk_search"] = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE["op3_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r(node, reached) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS low FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

_PLAIN = f"regexp_replace(%s, '{PUNCTUATION.replace(chr(92) + 'x00-' + chr(92) + 'x2F', chr(92) + 'x00-' + chr(92) + 'x09' + chr(92) + 'x0B-' + chr(92) + 'x2F')}', ' ', 'g')"


def _spelled(text: str) -> str:
    for other, usual in SPELLINGS:
        text = f"replace({text}, '{other}', '{usual}')"
    return text


def _canonical(text: str) -> str:
    """Without case, punctuation and copyright lines, in lines; spellings are still as they were."""
    out = (f"translate(array_to_string([x FOR x IN string_split(coalesce({text}, ''), chr(10)) "
           f"IF NOT regexp_matches(x, '{COPYRIGHT}')], chr(10)), {ABC})")
    out = f"regexp_replace({_PLAIN % out}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"trim(regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g'))"


def _whole(plain: str) -> str:
    return _spelled(f"replace({plain}, chr(10), ' ')")


def _known() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, texts in KNOWN.items() for t in texts)
    return f"SELECT k.l AS license, sha256({_whole(_canonical('k.t'))}) AS digest FROM (VALUES {rows}) k(l, t)"


ORACLE["op4_license_scan"] = f"""
WITH known AS (SELECT digest, min(license) AS license FROM ({_known()}) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical('text')} AS plain FROM documents),
w AS (SELECT d.r, d.doc_id, k.license FROM d LEFT JOIN known k ON d.plain <> '' AND k.digest = sha256({_whole('d.plain')})),
l AS (SELECT r, unnest(string_split({_spelled('plain')}, chr(10))) AS line FROM d),
f AS (SELECT l.r, k.license FROM l JOIN known k ON l.line <> '' AND k.digest = sha256(l.line)),
n AS (SELECT r, count(*) AS n_lines FROM f GROUP BY r),
a AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM
  (SELECT r, license FROM f UNION SELECT r, license FROM w WHERE license IS NOT NULL) GROUP BY r)
SELECT w.doc_id, w.license, coalesce(n.n_lines, 0) AS n_lines, coalesce(a.licenses, '') AS licenses
FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN a ON a.r = w.r
"""

ORACLE["op9_decontamination"] = f"""
WITH b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, {ABC}), {WORDS9}) AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), {WORDS9}) AS w FROM documents),
p AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) l)),
h AS (SELECT p.r, p.i, p.n, win.item_id FROM p JOIN win ON win.g = p.g AND win.n = p.n),
k AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM
  (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AND 20 * coalesce(k.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN m ON m.r = d.r
"""

_FIVE = "('0x' || substr(hex, i, 5))::BIGINT"  # five hex digits of the digest are four base32 ones
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_FIVE} >> {shift} & 31)::INTEGER + 1, 1)" for shift in (15, 10, 5, 0))
ORACLE["op6_warc_zip"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS html FROM pages),
h AS (SELECT page_id, octet_length(html) AS payload_bytes, sha1(html) AS hex FROM p),
l AS (SELECT hex, max(page_id) AS last FROM h GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string([{_BASE32} FOR i IN range(1, 41, 5)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM h JOIN l USING (hex)
"""

ORACLE["op12_collocations"] = f"""
WITH p AS (SELECT row_number() OVER () AS r, lang, s FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {ABC}), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents)),
t AS (SELECT r, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT r, lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM p)),
g AS (SELECT lang, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4, lead(w, 4) OVER x AS w5
  FROM t WINDOW x AS (PARTITION BY r ORDER BY i)),
f AS (SELECT lang, 1 AS m, w AS phrase, count(*) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2 AS phrase, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS phrase, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM f WHERE a >= 100),
c AS (SELECT * FROM h WHERE m > 1),
k AS (SELECT c.*, k, string_split(phrase, ' ') AS w FROM c, (VALUES (1), (2), (3), (4)) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.a AS l, y.a AS r, n.n,
    CAST((CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN h x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(k.w, 1, k.k), ' ')
  JOIN h y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(k.w, k.k + 1, k.m), ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM s),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c x ON x.lang = c.lang AND x.m > c.m AND x.a >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ')),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE j = 1 AND d.phrase IS NULL)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""

_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_HEAD = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || "
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_UP = "SELECT tree, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, max(pos) OVER (PARTITION BY tree) AS last FROM {}) WHERE last > 0 GROUP BY tree, lvl, pos // 8"
_BESIDE = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN {} ), '')"
_SIBLINGS = f"""SELECT tree, lvl, pos, {_BESIDE.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, {_BESIDE.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after
  FROM (SELECT *, max(pos) OVER (PARTITION BY tree, lvl) AS last FROM {{}}) WHERE last > 0"""
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD}{_PART.format('text')}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN sha256({_HEAD}{_PART.format(f"translate(text, {ABC})")}) END AS other FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n(tree, lvl, pos, h) AS (SELECT tree, 0, pos, leaf FROM l UNION ALL ({_UP.format('n')})),
s AS MATERIALIZED (SELECT tree, max_by(h, lvl) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n GROUP BY tree),
u(tree, lvl, pos, h) AS (SELECT '', 0, pos, subroot FROM s UNION ALL ({_UP.format('u')})),
b AS MATERIALIZED ({_SIBLINGS.format('n')}),
c AS MATERIALIZED ({_SIBLINGS.format('u')}),
p AS MATERIALIZED (SELECT r, lvl, before, after FROM l JOIN b ON b.tree = l.tree AND b.pos = l.pos // CAST(pow(8, b.lvl) AS BIGINT)
  UNION ALL SELECT r, 1000 + c.lvl, before, after FROM l JOIN s ON s.tree = l.tree JOIN c ON c.pos = s.pos // CAST(pow(8, c.lvl) AS BIGINT)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step FROM p),
f(r, step, h) AS (SELECT r, 0, coalesce(other, leaf) FROM l UNION ALL SELECT f.r, f.step + 1, sha256(before || h || after) FROM f JOIN o ON o.r = f.r AND o.step = f.step + 1),
e AS (SELECT r, max_by(h, step) AS folded_root FROM f GROUP BY r),
q AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM o GROUP BY r),
t AS (SELECT max_by(h, lvl) AS root FROM u)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON s.tree = l.tree JOIN e ON e.r = l.r LEFT JOIN q ON q.r = l.r, t
"""
