"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .class_lm import op4_class_lm
from .embedding_dedup import op9_embedding_near_dedup
from .html_extraction import op1_html_extraction
from .mixing import op3_mixing_sources
from .near_dedup import op8_minhash_near_dedup
from .packing import op10_best_fit_packing
from .prefix_trie import op12_prefix_trie
from .quality import op2_quality_rules
from .substring_dedup import op5_substring_dedup
from .token_alignment import op11_token_alignment
from .topk_search import op13_exact_topk
from .toxicity import op6_toxicity
from .url_filter import op7_url_filters

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_mixing_sources, op4_class_lm, op5_substring_dedup, op6_toxicity, op7_url_filters, op8_minhash_near_dedup, op9_embedding_near_dedup, op10_best_fit_packing, op11_token_alignment, op12_prefix_trie, op13_exact_topk)}

#: op5, op8, op9, op12 and op13 are fixed by what they return. The others hang on a model, a template, a permutation or a plan, which
#: SQL does not have; tests hold them to brute force, round trips or held-out accuracy.
ORACLES = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 34, 0) + 1)) AS p FROM w),
win AS (SELECT doc_id, p, sha256(array_to_string(words[p:p + 34], ' ')) AS h FROM starts),
many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win SEMI JOIN many USING (h)),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT h, count(*) AS f FROM s GROUP BY 1),
o AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY f, h) AS place FROM s JOIN f USING (h)),
p AS (SELECT doc_id, h, n FROM o JOIN n USING (doc_id) WHERE 100 * (place - 2) <= 20 * n),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, na, nb, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.h = x.h GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op9_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT comp.vec_id, coalesce(n, 0) AS n_links, component_id, comp.vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)""",
    "op12_prefix_trie": r"""
WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS had FROM c),
r AS (SELECT k.conv_id, place AS depth, turn FROM k JOIN t ON t.conv_id = k.base AND place <= h
  UNION ALL SELECT k.conv_id, place - h + had, turn FROM k JOIN t ON t.conv_id = k.conv_id AND place > h),
p AS (SELECT conv_id, depth, sha256(CAST(list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS VARCHAR)) AS node, length(turn.text) AS chars FROM r
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM k),
e AS (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY node),
u AS (SELECT n.*, p.node AS parent FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.node, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM n LEFT JOIN kids USING (node) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node),
ended AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM e GROUP BY node)
SELECT u.conv_id, u.depth, v.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u LEFT JOIN n v ON v.node = u.parent LEFT JOIN kids ON kids.node = u.node JOIN sums ON sums.node = u.node LEFT JOIN ended ON ended.node = u.node""",
    "op13_exact_topk": r"""
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score, p.own AS other
  FROM v q JOIN v p ON q.own <> p.own AND len(q.e) = len(p.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, other) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
