"""SQL, in another engine's dialect, for the queries that SQL can express."""

RULE_LEDGER = r"""
WITH parts AS (
 SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT *, list_transform(generate_series(1, len(words) - 7), lambda i: array_to_string(words[i:i + 7], ' ')) AS wins FROM parts),
often AS (SELECT *, CASE WHEN len(list_distinct(wins)) = len(wins) THEN [] ELSE
  map_keys(map_from_entries(list_filter(map_entries(list_histogram(wins)), lambda e: e.value > 1))) END AS twice FROM windows),
placed AS (SELECT *, CASE WHEN twice = [] THEN [] ELSE list_filter(generate_series(1, len(words) - 7), lambda i: list_contains(twice, wins[i])) END AS starts FROM often),
measured AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_distinct(flatten(list_transform(starts, lambda i: generate_series(i, i + 7)))))::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_capitals FROM placed),
bits AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN 100 * n_capitals > 40 * word_chars THEN 32 ELSE 0 END) AS failed_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
 failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits FROM bits"""

_ESCAPES = r"""length(text) - length(replace(text, '\', ''))
  + (length(text) - length(regexp_replace(text, '\[SYS\]', '', 'g'))) // 5 + (length(text) - length(regexp_replace(text, '\[/SYS\]', '', 'g'))) // 6
  + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
  + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
  + (length(text) - length(replace(text, '[ROLE]', ''))) // 6 + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7
  + (length(text) - length(replace(text, '[END]', ''))) // 5"""

CHAT_FORMAT = rf"""
WITH turns AS (
 SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
seen AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
  CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 8 ELSE 22 + length(role) END + length(text) + {_ESCAPES} AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
 sum(chars)::BIGINT AS formatted_chars,
 bool_and(CASE WHEN prior IS NULL THEN role IN ('system', 'user') WHEN prior = 'user' THEN role = 'assistant' ELSE prior IN ('system', 'assistant') AND role = 'user' END) AS in_order
FROM seen GROUP BY conv_id"""

TOPK_SEARCH = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

PHRASE_MINING = r"""
WITH texts AS (
    SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'),
                             lambda x: x <> '') AS w
    FROM texts
), sizes AS (
    SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS pos
    FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM pieces WHERE len(w) > 0)
), phrases AS (
    SELECT lang, w[pos:pos + m - 1] AS words, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), named AS (
    SELECT lang, array_to_string(words, ' ') AS phrase, words, m, f FROM phrases
), inner_spans AS (
    SELECT lang, words, f, m, s, unnest(range(1, m - s + 2)) AS pos
    FROM (SELECT *, unnest([2, 3]) AS s FROM named WHERE m > 2) WHERE s < m
), covers AS (
    SELECT lang, array_to_string(words[pos:pos + s - 1], ' ') AS phrase, max(f) AS cover FROM inner_spans GROUP BY ALL
), cuts AS (
    SELECT lang, phrase, f, k, array_to_string(words[1:k], ' ') AS p1, array_to_string(words[k + 1:m], ' ') AS p2
    FROM (SELECT *, unnest(range(1, m)) AS k FROM named WHERE m > 1)
), scored AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r,
           CAST(CAST(2000000 AS HUGEINT) * c.f // (l.f + r.f) AS BIGINT) AS score
    FROM cuts AS c JOIN named AS l ON l.lang = c.lang AND l.phrase = c.p1 JOIN named AS r ON r.lang = c.lang AND r.phrase = c.p2
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
    FROM weakest AS w LEFT JOIN covers AS o ON o.lang = w.lang AND o.phrase = w.phrase
    WHERE o.cover IS NULL OR 100 * o.cover < 80 * w.a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
