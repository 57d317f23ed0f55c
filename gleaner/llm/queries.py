"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, forest, language, lexical, lm, merkle, mixing, packing, setsketch, substring, urlrules, warc
from .common import table


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(language.training_rows(docs))
    return language.predict(docs, model).select("doc_id", (language.fold() == 0).alias("held_out"), "lang_pred", "score", "mixture")


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.components_of(table(spark, sf_dir, "embeddings"))


def op6_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"))


def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.digests(table(spark, sf_dir, "documents"))


def op9_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return lm.score(docs, docs.where(fold != 1), fold == 1)


def op11_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op13_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT s.doc_id, s.i, array_to_string(w[i:i + 19], ' ') AS g FROM s JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
o AS (SELECT d.doc_id, w, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""

_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


_WARC_SQL = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x),
g AS (SELECT page_id, n, first, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS v FROM d JOIN f USING (x))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(v, lambda b: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM g
"""

_COVER_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.c = vec_id AS kept FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


# a checksum bit by bit: each character is followed by eight shifts (-1)
_CRC_SQL = "xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT))"

# leaves and trees as in the manifest; f folds every row's leaf as found through the sibling lists x of its tree and of the tree of subroots
_MERKLE_SQL = rf"""
WITH RECURSIVE c AS (SELECT *, CASE WHEN crc THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found FROM (SELECT *, {_CRC_SQL} % 3 = 0 AS crc FROM documents)),
o AS (SELECT doc_id, lang, found, concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))}) AS head, text FROM c),
l AS (SELECT doc_id, lang, sha256(head || {_field('text')}) AS leaf, sha256(head || {_field('found')}) AS now FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS k FROM l),
u(level, lang, i, k, h) AS (SELECT 0, lang, i, k, leaf FROM n UNION ALL SELECT level + 1, lang, i // 8, (max(k) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE k > 1 GROUP BY level, lang, i // 8),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, lang::BLOB) - 1 AS i, count(*) OVER () AS k FROM u WHERE k = 1),
t(level, i, k, h) AS (SELECT 0, i, k, subroot FROM s UNION ALL SELECT level + 1, i // 8, (max(k) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE k > 1 GROUP BY level, i // 8),
x AS (SELECT level, coalesce('=' || lang, '-') AS tree, i // 8 AS p, list(h ORDER BY i) AS hs FROM u WHERE k > 1 GROUP BY ALL UNION ALL SELECT level, '^', i // 8, list(h ORDER BY i) FROM t WHERE k > 1 GROUP BY ALL),
f(id, doc_id, leaf, subroot, tree, level, i, k, ti, tk, h, proof) AS (
  SELECT row_number() OVER (), doc_id, leaf, subroot, CASE WHEN n.k > 1 THEN coalesce('=' || n.lang, '-') ELSE '^' END, 0, CASE WHEN n.k > 1 THEN n.i ELSE s.i END, CASE WHEN n.k > 1 THEN n.k ELSE s.k END, s.i, s.k, now, '' FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT id, doc_id, leaf, subroot, CASE WHEN f.k <= 8 THEN '^' ELSE f.tree END, CASE WHEN f.k <= 8 THEN 0 ELSE f.level + 1 END, CASE WHEN f.k > 8 THEN f.i // 8 WHEN f.tree = '^' THEN 0 ELSE ti END, CASE WHEN f.k > 8 THEN (f.k + 7) // 8 WHEN f.tree = '^' THEN 1 ELSE tk END, ti, tk,
    sha256(array_to_string(hs[1:(f.i % 8)::INT], '') || h || array_to_string(hs[(f.i % 8 + 2)::INT:], '')), proof || array_to_string(hs[1:(f.i % 8)::INT], '') || array_to_string(hs[(f.i % 8 + 2)::INT:], '')
  FROM f JOIN x ON x.tree = f.tree AND x.level = f.level AND x.p = f.i // 8 WHERE f.k > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM t WHERE k = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM t WHERE k = 1) AS verified FROM f WHERE k = 1
"""

_LEXICAL_SQL = r"""
WITH p AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents, p WHERE text IS NOT NULL),
a AS (SELECT k, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0), s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM a),
f AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, n, unnest(t) AS term FROM a) GROUP BY ALL), g AS (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term),
i AS (SELECT DISTINCT j, item_id, unnest(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS j, * FROM benchmark), p),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM g, s),
r AS (SELECT j, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM i JOIN f USING (term) JOIN w USING (term), s GROUP BY j, item_id, k, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe_lexicon, op2_language_mixture, op3_warc_segments, op4_projection_forest, op5_cover_tree, op6_super_kmers, op7_url_rules, op8_setsketch, op9_cutting_stock, op10_log_bilinear, op11_splitting_tree, op12_merkle_manifest, op13_bit_sliced)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_segments": _WARC_SQL, "op5_cover_tree": _COVER_SQL, "op6_super_kmers": _SUBSTRING_SQL, "op8_setsketch": _NEAR_SQL, "op12_merkle_manifest": _MERKLE_SQL, "op13_bit_sliced": _LEXICAL_SQL}
