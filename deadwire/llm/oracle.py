"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
s AS (SELECT page_id, strlen(payload) AS size, sha1(payload) AS digest,
             max(page_id) OVER (PARTITION BY payload) AS lead FROM p)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM s"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fits
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND a.fits AND b.fits AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(counts.n, 0)::BIGINT AS n_links, least.component_id,
       v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id"""

_WORDS = """
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents)"""

OP9 = f"""
WITH {_WORDS.strip()},
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE later),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS t, count(*) AS n
         FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def _quality() -> str:
    """Base counts and, per n, the characters in n-grams that stand earlier in the text (dup), and of those that
    stand three times or more (many)."""
    sizes = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    # an n-gram is put together from its words' rows; unnesting positions beside the word list would copy it per row
    grams = ",\n".join(f"""
s{n} AS (SELECT doc_id, i, size, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW
         AND {n - 1} FOLLOWING) AS gram FROM u),
g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS later,
         count(*) OVER (PARTITION BY doc_id, gram) AS times FROM s{n} WHERE i + {n - 1} <= size),
c{n} AS (SELECT u.doc_id, sum(length(u.word))::BIGINT AS chars,
         coalesce(sum(length(u.word)) FILTER (x.many), 0)::BIGINT AS many FROM u JOIN
        (SELECT doc_id, i, bool_or(many) AS many FROM
         (SELECT doc_id, unnest(range(i, i + {n})) AS i, times > 2 AS many FROM g{n} WHERE later) GROUP BY doc_id, i) x
        ON x.doc_id = u.doc_id AND x.i = u.i GROUP BY u.doc_id)""" for n in sizes)
    columns = "".join(f", coalesce(c{n}.chars, 0) AS dup_{n}gram_chars, coalesce(c{n}.many, 0) AS many_{n}gram_chars"
                      for n in sizes)
    joins = "".join(f" LEFT JOIN c{n} ON c{n}.doc_id = w.doc_id" for n in sizes)
    limits = {"line": 20, **{f"{n}gram": p for n, p in sizes.items()}}
    fits = " AND ".join(f"50 * (dup_{x}_chars + many_{x}_chars) <= {p} * word_chars" for x, p in limits.items())
    return f"""
WITH {_WORDS.strip()},
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS size FROM w),
{grams.strip()},
rep AS (SELECT doc_id, count(*)::BIGINT AS n FROM
        (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM g8 WHERE times > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) > 1 AS later,
       count(*) OVER (PARTITION BY doc_id, l) AS times FROM
       (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT doc_id, count(*)::BIGINT AS n,
          sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS chars,
          coalesce(sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (times > 2), 0)::BIGINT AS many
          FROM ln WHERE later GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
      length(regexp_replace(array_to_string(w.ws, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(lines.n, 0) AS n_dup_lines, coalesce(lines.chars, 0) AS dup_line_chars,
      coalesce(lines.many, 0) AS many_line_chars,
      coalesce(rep.n, 0) AS n_repeat_words{columns}
      FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id{joins}),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {fits} AS kept FROM b"""


OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
           + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit (reflected polynomial 0xEDB88320)."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce({bits}, lambda a, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM r),
p AS (
  SELECT conv_id, depth, strlen(text) AS size,
         array_agg(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM n
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
longest AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
g AS (
  SELECT p.path, any_value(p.depth) AS depth, any_value(p.size) AS size, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (longest.depth = p.depth) AS ends
  FROM p JOIN longest USING (conv_id) GROUP BY p.path),
kids AS (SELECT a.path, count(b.path) AS n FROM g a LEFT JOIN g b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path
         GROUP BY a.path),
under AS (
  SELECT a.path, sum((b.n_convs - 1) * b.size)::BIGINT AS saved, count(*) FILTER (kids.n = 0) AS leaves
  FROM g a JOIN g b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path JOIN kids ON kids.path = b.path GROUP BY a.path)
SELECT g.conv_id, g.depth, up.conv_id AS parent_conv_id, g.n_convs, kids.n AS n_children, under.leaves AS n_leaves,
       under.saved AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN kids ON kids.path = g.path JOIN under ON under.path = g.path
LEFT JOIN g up ON g.depth > 0 AND up.depth = g.depth - 1 AND up.path = g.path[1:g.depth - 1]"""


def _hashed(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_KEEP = " || ".join(map(_hashed, ("doc_id", "source", "lang", "n_chars")))

OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_KEEP} || {_hashed("text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_KEEP} || {_hashed("replace(text, chr(10), '')")})
              ELSE sha256({_KEEP} || {_hashed("text")}) END AS shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
low AS (
  SELECT source, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM d
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (max(n) + 2) // 3
  FROM low WHERE n > 1 GROUP BY source, level, i // 3),
sub AS (SELECT source, node, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, node, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (max(n) + 2) // 3
  FROM high WHERE n > 1 GROUP BY level, i // 3),
lowside AS (
  SELECT a.source, a.level, a.i, string_agg(b.node, '' ORDER BY b.i) AS both_sides,
         coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM low a LEFT JOIN low b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3
       AND a.i <> b.i WHERE a.n > 1 GROUP BY a.source, a.level, a.i),
highside AS (
  SELECT a.level, a.i, string_agg(b.node, '' ORDER BY b.i) AS both_sides,
         coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM high a LEFT JOIN high b ON a.level = b.level AND a.i // 3 = b.i // 3 AND a.i <> b.i
  WHERE a.n > 1 GROUP BY a.level, a.i),
side AS (
  SELECT source, level AS step, i, before, after, both_sides FROM lowside
  UNION ALL
  SELECT sub.source, sub.height + h.level, h.i, h.before, h.after, h.both_sides FROM sub CROSS JOIN highside h),
path AS (
  SELECT d.source, d.i AS first, 0 AS step, CASE WHEN sub.height = 0 THEN sub.i ELSE d.i END AS at, sub.height,
         sub.i AS sub_at, d.shown AS node, '' AS proof
  FROM d JOIN sub ON d.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT p.source, p.first, p.step + 1, CASE WHEN p.step + 1 = p.height THEN p.sub_at ELSE p.at // 3 END,
         p.height, p.sub_at, sha256(s.before || p.node || s.after), p.proof || coalesce(s.both_sides, '')
  FROM path p JOIN side s ON p.source IS NOT DISTINCT FROM s.source AND s.step = p.step AND s.i = p.at),
done AS (SELECT source, first, max_by(node, step) AS folded, max_by(proof, step) AS proof FROM path GROUP BY source, first)
SELECT d.doc_id, d.leaf, sub.node AS subroot, top.node AS root, sha256(done.proof) AS proof_sha256,
       done.folded AS folded_root, done.folded = top.node AS verified
FROM d JOIN done ON d.source IS NOT DISTINCT FROM done.source AND d.i = done.first
JOIN sub ON d.source IS NOT DISTINCT FROM sub.source JOIN (SELECT node FROM high WHERE n = 1) top ON true"""

ORACLE: dict[str, str] = {"op1_warc": OP1, "op2_embedding_neardup": OP2, "op5_quality": _quality(),
                          "op9_substring": OP9, "op10_chat": OP10, "op11_prefix_trie": OP11,
                          "op12_merkle": OP12}
