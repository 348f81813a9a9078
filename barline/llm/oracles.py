"""DuckDB SQL that states what the queries return, where SQL can."""

from __future__ import annotations

from barline.llm import secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_scan() -> str:
    """Matches are marked in place by two private characters; a match starts behind the characters of all pieces before it."""
    kinds = ", ".join(f"({i}, {_quoted(r.kind)}, {r.least})" for i, r in enumerate(secrets.RULES))
    marked = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, regexp_replace(s, {_quoted(r.pattern)}, chr(57344) || '\\0' || chr(57345), 'g') AS m, {_quoted(r.pattern)} AS re, {r.group} AS grp FROM docs"
        for i, r in enumerate(secrets.RULES)
    )
    measured = "CASE k " + " ".join(f"WHEN {i} THEN length(regexp_extract(hit, {_quoted(r.pattern)}, {r.group}))" for i, r in enumerate(secrets.RULES)) + " END"
    base = f"k < {len(secrets.BASE)}"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
kinds(k, kind, least) AS (VALUES {kinds}),
marked AS ({marked}),
pieces AS (SELECT rid, k, unnest(string_split(m, chr(57344))) AS piece, generate_subscripts(string_split(m, chr(57344)), 1) AS i FROM marked WHERE contains(m, chr(57344))),
cut AS (SELECT rid, k, i, CASE WHEN i > 1 THEN split_part(piece, chr(57345), 1) END AS hit, length(replace(piece, chr(57345), '')) AS n FROM pieces),
placed AS (SELECT rid, k, i, hit, sum(n) OVER (PARTITION BY rid, k ORDER BY i) - n AS start_at FROM cut),
found AS (SELECT rid, p.k, kind, start_at, start_at + length(hit) AS end_at FROM placed p JOIN kinds USING (k) WHERE i > 1 AND ({measured}) >= least),
told AS (SELECT rid, k, start_at, kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT) AS said FROM found),
summed AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  coalesce(string_agg(said, ',' ORDER BY start_at, k) FILTER ({base}), '') AS base, string_agg(said, ',' ORDER BY start_at, k) AS spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (rid)"""


SECRET_SCAN = _secret_scan()

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS y FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.y, c.y) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

CHAT_FORMAT = r"""
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS t),
c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', t FROM said UNION ALL SELECT -1, 1, 'assistant', t FROM said),
f AS (SELECT *, lag(role) OVER w AS was, row_number() OVER w AS k, lead(role) OVER w IS NULL AS ends FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, t)),
e AS (SELECT *, CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN was IN ('system', 'assistant') THEN role = 'user' WHEN was = 'user' THEN role = 'assistant' ELSE false END AND (NOT ends OR role = 'assistant') AS fits,
  length(regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g')) AS n,
  length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) AS m FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + m + 1 + n + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(fits) AS valid
FROM e GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d),
v AS (SELECT *, payload_bytes >= 1000 AND holder IS NOT NULL AND page_id IS DISTINCT FROM holder AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN holder END AS refers_to FROM v"""


FILTER_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT s, min(doc_id) AS least FROM t GROUP BY s),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 5 * length(s) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN t.doc_id > least THEN 'E' ELSE '' END) AS failed
  FROM t JOIN m USING (s) LEFT JOIN l ON l.doc_id = t.doc_id),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, failed),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
st AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own, left(filter_order, i - 1) AS before FROM o, range(1, 6) r(i)),
p AS (SELECT DISTINCT part FROM g),
r AS (
  SELECT p.part, filter_order, step, own, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, failed,
    contains(failed, own) AS fails, len(translate(before, failed, '')) < len(before) AS gone
  FROM p CROSS JOIN st JOIN g ON g.part = p.part),
c AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
    sum(n) FILTER (failed = own) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c"""


def _crc_steps() -> list[int]:
    """What crc32 adds for each value of the low byte: eight shifts by the reversed polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _spelling_variants() -> str:
    """Near words meet where they are equal with one sign replaced by a mark, or one of them without a sign is the other."""
    byte = "CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)"
    return rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs GROUP BY 1, 2),
hexed AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM low),
steps AS (SELECT {_crc_steps()}::BIGINT[] AS s),
crc AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) // 2 + 1), lambda i: {byte})),
    lambda h, b: xor(h >> 8, s[1 + xor(h & 255, b)])), 4294967295::BIGINT) AS h
  FROM hexed, steps),
cut AS (SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS (SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS marked, left(word, i - 1) || substr(word, i + 1) AS less FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.marked = b.marked AND a.word <> b.word
  UNION SELECT less, h.word, h.n FROM holes h JOIN w ON w.word = less
  UNION SELECT h.word, less, w.n FROM holes h JOIN w ON w.word = less),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT up.word, f.form, d + 1 FROM up JOIN f ON f.word = root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, d) AS root FROM up GROUP BY word) USING (word)"""


SPELLING_VARIANTS = _spelling_variants()
