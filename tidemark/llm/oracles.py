"""The queries of this folder that SQL can express, as SQL over the given tables."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), src AS (
  SELECT source, source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER AS weight
  FROM totals
), lvl(i, lam) AS (
  SELECT 0, 0::DOUBLE
  UNION ALL
  SELECT i + 1, raised FROM (
    SELECT i, lam,
           (sum(source_size) - sum(CASE WHEN source_size * 3 < lam * weight THEN source_size * 3 ELSE 0 END))::DOUBLE
           / sum(CASE WHEN source_size * 3 < lam * weight THEN 0 ELSE weight END)::DOUBLE AS raised
    FROM lvl, src GROUP BY i, lam) WHERE raised > lam
), plan AS (
  SELECT source, source_size, weight,
         least((source_size * 3)::DOUBLE, (SELECT max(lam) FROM lvl) * weight) AS target FROM src
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan
), quotas AS (
  SELECT *, round(target - whole * source_size)::BIGINT AS quota FROM epochs
), seeded AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM sizes
), ties AS (
  SELECT source, place, sum(size)::BIGINT AS words FROM seeded WHERE size > 0 GROUP BY source, place
), running AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ties
), cuts AS (
  SELECT r.source, r.place AS cut_at, quota - before AS cut_left, words AS cut_sum
  FROM running r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source
  WHERE quota > 0 AND before < quota AND quota <= before + words
), shares AS (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.weight, q.target, q.whole AS epochs,
         CASE WHEN d.place < c.cut_at THEN d.size
              WHEN d.place = c.cut_at THEN floor(c.cut_left * d.size / c.cut_sum)
              ELSE 0 END::BIGINT AS extra
  FROM seeded d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
  LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT *, epochs * size + extra AS taken FROM shares
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS chosen,
         coalesce(turn, 9223372036854775807) AS turn, role, text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT pair_id, chosen, role, text,
         '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
         coalesce(text, '') || '<|im_end|>' || chr(10) AS body,
         row_number() OVER (PARTITION BY pair_id, chosen
                            ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k
  FROM t
), same AS (
  SELECT c.pair_id, c.k FROM p c JOIN p r ON c.pair_id = r.pair_id AND c.k = r.k
  WHERE c.chosen AND NOT r.chosen AND c.role IS NOT DISTINCT FROM r.role
    AND c.text IS NOT DISTINCT FROM r.text
), shared AS (
  SELECT p.pair_id, coalesce(min(p.k) FILTER (WHERE s.k IS NULL) - 1, max(p.k)) AS n
  FROM p LEFT JOIN same s ON p.pair_id = s.pair_id AND p.k = s.k GROUP BY p.pair_id
), q AS (
  SELECT p.*, n, head || body AS whole,
         CASE WHEN role = 'assistant' THEN length(head) || 'x0,' || length(body) || 'x1'
              ELSE length(head || body) || 'x0' END AS mask
  FROM p JOIN shared USING (pair_id)
)
SELECT pair_id, n::BIGINT AS n_prompt_turns,
  coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE chosen AND k <= n), '') AS prompt,
  coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE chosen AND k > n), '') AS chosen,
  coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE chosen AND k > n), '') AS chosen_mask,
  coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE NOT chosen AND k > n), '') AS rejected,
  coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE NOT chosen AND k > n), '') AS rejected_mask
FROM q GROUP BY pair_id, n
"""

_REACH = """
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
{_REACH}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links,
       least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN lowest l ON e.vec_id = l.a
"""

OP3 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), items AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), shared AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM items p JOIN items q ON p.x = q.x
  WHERE p.doc_id <> q.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * k >= 80 * (m.n + n.n - k)
{_REACH}
SELECT z.doc_id, z.n::BIGINT AS n_shingles, least(z.doc_id, coalesce(low, z.doc_id)) AS component_id,
       least(z.doc_id, coalesce(low, z.doc_id)) = z.doc_id AS kept
FROM sizes z LEFT JOIN lowest l ON z.doc_id = l.a
"""

# Turn by turn, for each state (E nothing yet, S, U, A) the cheapest letters so far, the least of ties;
# `hops` are empty turns put in before one, `acts` its edits. Keys are costs and letters as one text.
OP13 = r"""
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT),
    lambda a, b: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)),
    4294967295::BIGINT), 4294967295) % 20 AS code
  FROM original
), turns AS (
  SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded JOIN (VALUES (1), (2)) AS copies(n) ON n <= CASE WHEN code = 3 THEN 2 ELSE 1 END WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM turns
), marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd
  FROM placed
), counts AS (
  SELECT conv, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (WHERE odd) AS illegal
  FROM marked GROUP BY conv
), rows AS (
  SELECT conv, i, role, text, left(role, 1) AS c, blank OR seen AS gone,
         CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM marked
), hops(p, letters, cost, p2, put) AS (
  VALUES ('E', '', 0, 'E', ''), ('S', '', 0, 'S', ''), ('U', '', 0, 'U', ''), ('A', '', 0, 'A', ''),
         ('E', 'I', 3, 'U', 'user:' || chr(10)), ('S', 'I', 3, 'U', 'user:' || chr(10)),
         ('A', 'I', 3, 'U', 'user:' || chr(10)), ('U', 'I', 3, 'A', 'assistant:' || chr(10))
), acts(p2, letter, price, c, q, role2) AS (
  VALUES ('E', 'D', 4, NULL, 'E', ''), ('S', 'D', 4, NULL, 'S', ''), ('U', 'D', 4, NULL, 'U', ''), ('A', 'D', 4, NULL, 'A', ''),
         ('E', 'K', 0, 's', 'S', ''), ('E', 'K', 0, 'u', 'U', ''), ('S', 'K', 0, 'u', 'U', ''), ('A', 'K', 0, 'u', 'U', ''),
         ('U', 'K', 0, 'a', 'A', ''), ('E', 'R', 3, NULL, 'U', 'user'), ('S', 'R', 3, NULL, 'U', 'user'),
         ('A', 'R', 3, NULL, 'U', 'user'), ('U', 'R', 3, NULL, 'A', 'assistant')
), moves AS (
  SELECT p, letters || letter AS letters, cost + price AS cost, letter, c, q, put, role2 FROM hops JOIN acts USING (p2)
), best(conv, i, state, k, repaired) AS (
  SELECT DISTINCT conv, 0::BIGINT, 'E', '000000000', '' FROM rows
  UNION ALL
  SELECT conv, i, state, min(k), arg_min(repaired, k) FROM (
    SELECT b.conv, r.i, m.q AS state,
           lpad((substr(k, 1, 9)::INTEGER + cost + CASE WHEN letter = 'D' THEN 0 ELSE extra END)::VARCHAR, 9, '0')
             || substr(k, 10) || letters AS k,
           repaired || put || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || text || chr(10)
                                          ELSE role2 || ':' || text || chr(10) END AS repaired
    FROM best b JOIN rows r ON r.conv = b.conv AND r.i = b.i + 1 JOIN moves m ON m.p = b.state
    WHERE (letter = 'D' OR NOT gone) AND (m.c IS NULL OR m.c = r.c)
  ) GROUP BY conv, i, state
), ends AS (
  SELECT b.conv, lpad((substr(k, 1, 9)::INTEGER + cost)::VARCHAR, 9, '0') || substr(k, 10) || letters AS k, repaired || put AS repaired
  FROM best b JOIN (SELECT conv, max(i) AS last FROM rows GROUP BY conv) l ON b.conv = l.conv AND b.i = l.last
  JOIN (VALUES ('E', '', 0, ''), ('A', '', 0, ''), ('U', 'I', 3, 'assistant:' || chr(10)),
               ('S', 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10))) AS fin(state, letters, cost, put) ON b.state = fin.state
), chosen AS (
  SELECT conv, min(k) AS k, arg_min(repaired, k) AS repaired FROM ends GROUP BY conv
), every AS (
  SELECT DISTINCT conv, conv_id FROM original
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(substr(k, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(k, 10), '') AS audit,
       sha256(coalesce(left(repaired, greatest(length(repaired) - 1, 0)), '')) AS repaired_sha256
FROM every LEFT JOIN counts USING (conv) LEFT JOIN chosen USING (conv)
"""
