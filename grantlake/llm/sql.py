"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from grantlake.llm.quality import STOP_WORDS, verdict

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sums
), levels AS (
  SELECT *, row_number() OVER (ORDER BY most / CAST(w AS DOUBLE), source NULLS LAST) AS place, CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM sums) AS budget,
         coalesce(sum(most) OVER before, 0) AS used, (SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0) AS rest
  FROM weighed WINDOW before AS (ORDER BY most / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((budget - used) / CAST(rest AS DOUBLE), place) AS v FROM levels WHERE most >= (budget - used) / CAST(rest AS DOUBLE) * w
), targets AS (
  SELECT source, source_size, CASE WHEN v IS NULL OR most < v * w THEN CAST(most AS DOUBLE) ELSE v * w END AS target FROM weighed, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS r,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(r) + CASE WHEN u < r - floor(r) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY c) AS rep
  FROM (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(g AS VARCHAR), chr(10) ORDER BY g)) AS c FROM s GROUP BY doc_id)
), r AS (
  SELECT s.doc_id, g, n FROM s JOIN classes USING (doc_id) WHERE rep = doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM r AS a JOIN r AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * k >= 75 * (na + nb - k)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
  SELECT rep, least(rep, min(b)) AS component FROM (SELECT DISTINCT rep FROM classes) AS c LEFT JOIN reach ON reach.a = c.rep GROUP BY rep
)
SELECT doc_id, CAST(coalesce(classes.n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN least_of USING (rep)
"""

OP5 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP6 = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), grams AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n >= 2
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_bangs,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({verdict()}, false) AS kept
FROM m
"""

_QUOTE = r"^ ?(?:> ?)+"
_INTRO = r"^\s*(?:On|Am|Le|El) .*(?:wrote|schrieb.*|a écrit|escribió)\s*:\s*$"


def _sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({text}, '[.!?\n]+'), lambda s: trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda s: length(s) >= 1)"


OP7 = rf"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS msg FROM conversations
), lines AS (
  SELECT msg, i, string_split(text, chr(10))[i] AS line FROM (SELECT msg, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM m)
), levels AS (
  SELECT msg, i, line, length(regexp_replace(regexp_extract(line, '{_QUOTE}'), '[^>]', '', 'g')) AS level FROM lines
), seen AS (
  SELECT *, lag(level, 1, 0) OVER w AS before, lead(level, 1, 0) OVER w AS after FROM levels WINDOW w AS (PARTITION BY msg ORDER BY i)
), own AS (
  SELECT msg, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS content
  FROM seen WHERE level = 0 AND NOT (after > 0 AND regexp_matches(line, '{_INTRO}')) GROUP BY msg
), passages AS (
  SELECT msg, level, string_agg(CASE WHEN before = level THEN ' ' ELSE chr(10) END || regexp_replace(line, '{_QUOTE}', ''), '' ORDER BY i) AS p
  FROM seen WHERE level > 0 GROUP BY msg, level
), q AS (
  SELECT msg, level, unnest({_sentences('p')}) AS s FROM passages
), mine AS (
  SELECT conv_id, turn, unnest({_sentences('content')}) AS s FROM own JOIN m USING (msg)
  UNION ALL SELECT conv_id, turn, unnest({_sentences("replace(content, chr(10), ' ')")}) FROM own JOIN m USING (msg)
), source AS (
  SELECT conv_id, s, min(turn) AS source FROM mine GROUP BY ALL
), votes AS (
  SELECT q.msg, level, source, count(*) AS n
  FROM q JOIN m USING (msg) JOIN source ON m.conv_id IS NOT DISTINCT FROM source.conv_id AND q.s = source.s WHERE source < turn GROUP BY ALL
), reply AS (
  SELECT msg, arg_max(source, (-level, n, source)) AS source, sum(n) AS n_linked FROM votes GROUP BY msg
), known AS (
  SELECT m.*, coalesce(content, '') AS content, lag(turn) OVER (PARTITION BY conv_id ORDER BY m.msg) AS before, source, coalesce(n_linked, 0) AS n_linked,
         (SELECT count(*) FROM q WHERE q.msg = m.msg) AS n_quotes
  FROM m LEFT JOIN own USING (msg) LEFT JOIN reply USING (msg)
), opened AS (
  SELECT *, CASE WHEN source IS NOT NULL AND source IS DISTINCT FROM before THEN {{'anchor': source, 'start': turn}} END AS b FROM known
), branched AS (
  SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY msg) AS branch FROM opened
)
SELECT conv_id, turn, role, CAST(coalesce(source, before) AS BIGINT) AS parent_turn,
       row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(branch.anchor, turn) NULLS FIRST, coalesce(branch.start, -1), msg) - 1 AS position,
       CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, content
FROM branched
"""

_WHOLE = """SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, {more}
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

OP11 = f"""
WITH rows AS (
  {_WHOLE.format(more="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND label IS NOT NULL
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5
"""

OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(s.size, 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) AS g LEFT JOIN (SELECT lang, source, sum(n) AS size FROM cells GROUP BY ALL) AS s USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST((1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.size + 2 * l.v) AS BIGINT) AS p,
         1 + CAST((1000000000::HUGEINT * (k.n + 2)) // (l.size + 2 * l.v) AS BIGINT) AS q
  FROM groups AS g JOIN langs AS l USING (lang) JOIN kept AS k USING (lang) LEFT JOIN cells AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13 = f"""
WITH rows AS (
  {_WHOLE.format(more="vec_id % 50 = 0 AS asks")}
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows AS a JOIN rows AS b ON a.asks AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""

SQL = {"op1_mixing": OP1, "op2_minhash": OP2, "op5_warc": OP5, "op6_quality": OP6, "op7_chat": OP7, "op11_negatives": OP11, "op12_divergence": OP12, "op13_topk": OP13}
