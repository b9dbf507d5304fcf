"""SQL equals of the operators' queries, for DuckDB. They are written from the definitions, without the operators'
methods: windows are compared as texts, links are found by joining shingles, line runs grow line by line.

Without SQL: op2 (the rules are learned), op9 (places of matches, guess costs) and op12 (tokens). Tests hold them against Python."""

from __future__ import annotations

from .licences import COPYRIGHT, DIGESTS, SPELLINGS, variants

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def folded(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hex_number(text: str, digits: int) -> str:
    return " + ".join(f"(strpos('0123456789abcdef', substr({text}, {i + 1}, 1)) - 1)::BIGINT * {16 ** (digits - 1 - i)}" for i in range(digits))


MIX = f"""
WITH d AS (
  SELECT doc_id, source, len({spaced("text")})::BIGINT AS size, least(len({spaced("text")}), 1000) + 2000 AS liked,
    (({hex_number("md5('17:' || doc_id)", 13)})::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * liked)::DOUBLE AS liked_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), t AS (SELECT sum(source_size)::HUGEINT AS total FROM s
), full_at AS (  -- a source is full if the level at which it fills needs no more than all words
  SELECT a.source, a.weight * sum(CASE WHEN b.source_size * a.weight <= a.source_size * b.weight THEN 3 * b.source_size ELSE 0 END)
    + 3 * a.source_size * sum(CASE WHEN b.source_size * a.weight <= a.source_size * b.weight THEN 0 ELSE b.weight END) <= a.weight * max(total) AS capped
  FROM s a, s b, t GROUP BY a.source, a.weight, a.source_size
), level AS (
  SELECT (max(total) - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END))::DOUBLE / sum(CASE WHEN capped THEN 0 ELSE weight END)::DOUBLE AS level
  FROM s JOIN full_at ON s.source IS NOT DISTINCT FROM full_at.source, t
), g AS (
  SELECT s.source, source_size, liked_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM s JOIN full_at ON s.source IS NOT DISTINCT FROM full_at.source, level
), h AS (
  SELECT d.*, source_size, target, least(CASE WHEN source_size = 0 THEN 0.0 WHEN target >= 3 * source_size THEN 3.0 ELSE target * liked::DOUBLE / liked_size END, 3.0::DOUBLE) AS expected
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (SELECT *, floor(expected)::BIGINT AS certain FROM h
), w AS (
  SELECT source, max(target) - sum(certain * size)::DOUBLE AS wanted FROM c GROUP BY source HAVING max(target) - sum(certain * size)::DOUBLE > 0
), p AS (
  SELECT c.*, wanted, (expected - certain) * least(1.0::DOUBLE, wanted / size) AS p
  FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source WHERE size > 0
), v AS (
  SELECT *, (u / (1.0::DOUBLE - u) * (1.0::DOUBLE - p) / p) / (1.0::DOUBLE + u / (1.0::DOUBLE - u) * (1.0::DOUBLE - p) / p) AS v FROM p WHERE p > 0
), r AS (
  SELECT doc_id, source, size, v, wanted, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) <= wanted AS taken FROM v
), gap AS (SELECT source, max(wanted) - sum(CASE WHEN taken THEN size ELSE 0 END)::DOUBLE AS gap FROM r GROUP BY source
), fill AS (
  SELECT doc_id FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY r.source ORDER BY abs(size - gap), v, doc_id) AS k
    FROM r JOIN gap ON r.source IS NOT DISTINCT FROM gap.source WHERE NOT taken AND abs(size - gap) < gap
  ) WHERE k = 1
), extra AS (SELECT doc_id FROM r WHERE taken UNION ALL SELECT doc_id FROM fill)
SELECT c.doc_id, source, size, source_size, target, certain + (extra.doc_id IS NOT NULL)::BIGINT AS copies, (certain + (extra.doc_id IS NOT NULL)::BIGINT) * size AS taken
FROM c LEFT JOIN extra ON c.doc_id = extra.doc_id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {spaced("text")} AS ws FROM documents
), win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), first AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN first USING (k) WHERE doc_id > first
), word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
  SELECT word.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Base-32 digit i of a SHA-1 is in hexadecimal digits 5i/4 and the next.
_PAIR = "strpos('0123456789abcdef', substr(s, (5 * i) // 4 + 1, 1)) * 16 - 16 + strpos('0123456789abcdef', substr(s, (5 * i) // 4 + 2, 1)) - 1"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages
), m AS (SELECT html, max(page_id) AS winner FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((({_PAIR})::INTEGER >> (3 - ((5 * i) % 4))::INTEGER)) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM p JOIN m USING (html)
"""

CHAT = """
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS x
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', x FROM said UNION ALL SELECT -1, 1, 'assistant', x FROM said
), e AS (
  SELECT *, CASE WHEN regexp_matches(text, '<\\|im_start\\|>|<\\|im_end\\|>|<\\|\\|') THEN regexp_replace(text, '<(\\|+)', '<|\\1', 'g') ELSE text END AS out FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || out || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars, true AS round_trip
FROM e GROUP BY conv_id
"""


def near(shingle: int, percent: int, last: str) -> str:
    """``last``: columns after component_id."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {spaced(folded("text"))} AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + {shingle - 1}), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_in JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id{last}
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON w.doc_id = c.doc_id
"""

LINES = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), b AS (
  SELECT doc_id, i, line, md5(line) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), run AS (  -- each place with the runs of k lines from it that stand twice or more
  SELECT doc_id, pos, 1 AS k, h FROM b WHERE h IN (SELECT h FROM b GROUP BY h HAVING count(*) > 1)
  UNION ALL
  SELECT doc_id, pos, k, h FROM (
    SELECT run.doc_id, run.pos, k + 1 AS k, md5(run.h || b.h) AS h, count(*) OVER (PARTITION BY md5(run.h || b.h)) AS n
    FROM run JOIN b ON run.doc_id = b.doc_id AND run.pos + k = b.pos
  ) WHERE n > 1
), longest AS (SELECT doc_id, max(k) AS longest FROM run GROUP BY doc_id
), first AS (SELECT k, h, min(doc_id * 10000000 + pos) AS first FROM run WHERE k <= 2 GROUP BY k, h
), gone AS (
  SELECT doc_id, unnest(range(pos, pos + 2)) AS pos FROM run JOIN first USING (k, h) WHERE k = 2 AND doc_id * 10000000 + pos <> first
  UNION SELECT run.doc_id, run.pos FROM run JOIN first USING (k, h) JOIN b ON run.doc_id = b.doc_id AND run.pos = b.pos
  WHERE k = 1 AND run.doc_id * 10000000 + run.pos <> first AND len({spaced("line")}) >= 50
), cut AS (SELECT b.doc_id, b.i FROM b JOIN gone ON b.doc_id = gone.doc_id AND b.pos = gone.pos
), kept AS (
  SELECT l.doc_id, count(cut.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE cut.i IS NULL) AS kept
  FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.i = cut.i GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)
SELECT s.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(longest, 0)::BIGINT AS longest_run,
  CASE WHEN s.text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents s LEFT JOIN n ON s.doc_id = n.doc_id LEFT JOIN kept ON s.doc_id = kept.doc_id LEFT JOIN longest ON s.doc_id = longest.doc_id
"""


def canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return f"trim({out}, ' ')"


LICENCES = f"""
WITH known AS (
  SELECT digest, min(licence) AS licence FROM (
    SELECT sha256({canonical("text")}) AS digest, licence FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in variants())}) AS k(licence, text)
    UNION ALL SELECT digest, licence FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in DIGESTS)}) AS g(licence, digest)
  ) GROUP BY 1
), d AS (SELECT doc_id, text, sha256({canonical("text")}) AS text_digest FROM documents
), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), n AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM l JOIN known ON sha256({canonical("line")}) = digest WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
)
SELECT d.doc_id, text_digest, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON text_digest = digest LEFT JOIN n ON d.doc_id = n.doc_id
"""

_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
LEAKS = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all({folded("text")}, {_ALNUM}), []) AS ws FROM documents
), b AS (SELECT item_id, regexp_extract_all({folded("text")}, {_ALNUM}) AS ws FROM benchmark
), own AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, md5(array_to_string(list_slice(ws, i, i + 9), ' ')) AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), win AS (
  SELECT doc_id, n, i, md5(array_to_string(list_slice(ws, i, i + n - 1), ' ')) AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM own))
), found AS (SELECT doc_id, item_id, win.n, i FROM win JOIN own ON win.n = own.n AND win.k = own.k
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN item ON w.doc_id = item.doc_id
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

JOINED = near(3, 90, ", min(w.doc_id) OVER (PARTITION BY (SELECT string_agg(k, ',' ORDER BY k) FROM sh WHERE sh.doc_id = w.doc_id), CASE WHEN n.n IS NULL THEN w.doc_id END) AS class_id")

ORACLES: dict[str, str] = {
    "op1_mix_sources": MIX,
    "op3_substring_dedup": REPEATS,
    "op4_warc_segments": WARC,
    "op5_chat_round_trip": CHAT,
    "op6_near_duplicates": near(5, 75, ", component_id = w.doc_id AS kept"),
    "op7_line_dedup": LINES,
    "op8_licence_scan": LICENCES,
    "op10_decontamination": LEAKS,
    "op11_hard_negatives": NEGATIVES,
    "op13_ngram_join": JOINED,
}
