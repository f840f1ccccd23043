"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from curatrix.llm.jumphash import MULTIPLIER, SLICES

#: Jump consistent hashing as a recursion: one row per key and jump; the last jump inside the shards counts.
JUMP = f"""RECURSIVE keys AS (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents), jump{{n}} AS (
  SELECT k, (CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616 ELSE k::HUGEINT END) AS s, 0::BIGINT AS b, 0::BIGINT AS j FROM keys
  UNION ALL
  SELECT k, s2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((s2 // 8589934592)::DOUBLE + 1.0)))::BIGINT
  FROM (SELECT k, j, ((s % 4294967296) * {MULTIPLIER}::HUGEINT + ((s // 4294967296) * ({MULTIPLIER} % 4294967296)::HUGEINT % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS s2 FROM jump{{n}} WHERE j < {{n}})),
  shard{{n}} AS (SELECT k, max(j) FILTER (j < {{n}}) AS shard FROM jump{{n}} GROUP BY k)"""

#: CRC-32 of a hex string's bytes, by the usual table of 256 remainders.
CRC = """RECURSIVE bits AS (SELECT i AS c, i AS r, 0 AS n FROM range(256) t(i) UNION ALL
  SELECT c, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, n + 1 FROM bits WHERE n < 8),
  remainders AS (SELECT list(r ORDER BY c) AS t FROM bits WHERE n = 8)"""


def jump_sharding(shards: int) -> str:
    a, b = (JUMP.format(n=n).replace("RECURSIVE ", "", 1) for n in (shards, shards + 1))
    b = b.split("), ", 1)[1] if b.startswith("keys") else b
    crc = CRC.replace("RECURSIVE ", "", 1)
    return f"""WITH RECURSIVE {a}, {b}, {crc}, d AS (SELECT doc_id, coalesce(doc_id, 0) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
  c AS (SELECT doc_id, k, length(h) // 2 + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) AS text_crc32 FROM d, remainders),
  p AS (SELECT c.*, s.shard, g.shard AS grown, (((c.k % 1000003 + 1000003) % 1000003) * 7919 + c.text_crc32) % {SLICES} AS slice FROM c JOIN shard{shards} s ON s.k = c.k JOIN shard{shards + 1} g ON g.k = c.k)
  SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard FROM p"""


NEAR_DUPLICATES = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
  n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
  reach AS (SELECT DISTINCT a AS d, a AS r FROM l UNION SELECT reach.d, l.b FROM reach JOIN l ON l.a = reach.r),
  c AS (SELECT d, min(r) AS m FROM reach GROUP BY d)
  SELECT doc_id, n AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM n LEFT JOIN c ON d = doc_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
  SELECT query_id, k::INT AS rank, vec_id, score FROM r WHERE k <= 20"""

CHAT = """WITH c AS (SELECT 0 AS own, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT 1, -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t)),
  e AS (SELECT *, coalesce(role, '') AS r, length(replace(replace(replace(coalesce(role, ''), '\\', '\\\\'), chr(10), '\\n'), '<', '\\l')) AS lr,
    length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) AS lt FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(12 + lr + 1 + lt + 11)::BIGINT AS formatted_chars FROM e GROUP BY own, conv_id"""

#: A kept piece, as hex text, without the bytes at its ends that are no whole character.
WHOLE = "regexp_replace(regexp_replace({0}, '^(?:[89AB].)+', ''), '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', '\\1')"


def repeats(length: int) -> str:
    """Windows of ``length`` bytes, as hex text, counted over all texts; flags and spans by running sums over the bytes."""
    piece, tail = "substr(d.h, 2 * before + 1, 2 * (a - before))", "substr(h, 2 * coalesce(last, 0) + 1)"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT k, unnest(range(length(h) // 2 - {length} + 1)) AS i, h FROM d WHERE length(h) // 2 >= {length}),
  x AS (SELECT k, i, md5_number(substr(h, 2 * i + 1, 2 * {length})) AS g FROM w),
  r AS (SELECT k, i FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)),
  m AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM r),
  b AS (SELECT k, i, sum(CASE WHEN p IS NULL OR i > p + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS s FROM m),
  spans AS (SELECT k, s, min(i) AS a, max(i) + {length} AS e FROM b GROUP BY k, s),
  gaps AS (SELECT k, s, a, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM spans),
  t AS (SELECT k, count(*) AS n, sum(e - a)::BIGINT AS removed, max(e) AS last FROM spans GROUP BY k),
  j AS (SELECT g.k, string_agg({piece}, '' ORDER BY a) AS kept, string_agg({WHOLE.format(piece)}, '' ORDER BY a) AS said FROM gaps g JOIN d ON d.k = g.k GROUP BY g.k)
  SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || {tail})) AS kept_sha256, length(h) // 2 - coalesce(removed, 0) AS n_kept,
    decode(unhex(coalesce(said, '') || {WHOLE.format(tail)})) AS text FROM d LEFT JOIN t ON t.k = d.k LEFT JOIN j ON j.k = d.k"""


FILL_IN_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  r AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
  s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS x FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""

FILTER_AUDIT = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
  f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
  w AS (SELECT d.*, list_filter(regexp_split_to_array(d.text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, coalesce(d.doc_id > f.first, false) AS again FROM d JOIN f ON f.text = d.text),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), again] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
  c AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
  i AS (SELECT unnest(range(1, 6)) AS i),
  o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
  s AS (SELECT o, k.i AS step, o[k.i] AS own, o[1:k.i - 1] AS earlier FROM o, i k),
  x AS (SELECT part, o, step, own, good, toxic, n, fails[own] AS fail, len(list_filter(earlier, lambda j: fails[j])) > 0 AS before, fails[own] AND len(list_filter(fails, lambda y: y)) = 1 AS alone FROM c, s),
  r AS (SELECT part, o, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT fail AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fail AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (fail AND NOT before AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fail AND NOT before AND toxic), 0)::BIGINT AS toxic_lost FROM x GROUP BY part, o, step)
  SELECT part, array_to_string(list_transform(o, lambda j: chr((64 + j)::INT)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""
