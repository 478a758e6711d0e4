"""The registered queries of the operators, with equivalent SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uqframe.llm import (
    collocations, credentials, multi_index, packing, page_differences, pieces, postings, quality, substrings, suffix_tree,
    superminhash, toxicity, warc,
)
from uqframe.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("clean_text", "row")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS ws, string_split(text, chr(10)) AS lines FROM d),
t AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM t) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, source, text, unnest(lines) AS line FROM w),
n AS (SELECT doc_id, source, text, line, {_WORDS.format(_LOWER.format('line'))} AS lw FROM l),
k AS (SELECT *, regexp_replace(array_to_string(lw, ' '), '[0-9]', '0', 'g') AS norm FROM n
  WHERE len(lw) > 0),
h AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY 1),
c AS (SELECT k.source, norm, min(doc_id) AS first_id FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source GROUP BY 1, 2
  HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) > 0.05 * max(texts)),
o AS (SELECT doc_id, sum(len(lw)) AS lost FROM k JOIN c ON k.norm = c.norm AND k.source IS NOT DISTINCT FROM c.source
  WHERE doc_id <> first_id GROUP BY 1),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM k GROUP BY 1),
f AS (SELECT doc_id, len(ws) AS n_words,
  coalesce(cast(list_sum(list_transform(ws, lambda x: length(x))) AS bigint), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  cast(coalesce(lost, 0) AS bigint) AS n_lost
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= 0.5 * n_words AS kept
FROM f"""


def tokenizer_file(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces.encode_documents(docs, model, with_ids=False).drop("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


#: SHA-1 in base 32: the 32 groups of five bits, each found in two hexadecimal digits.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((CAST('0x' || substr(hex || '0',
    CAST(1 + (5 * i) // 4 AS INT), 2) AS INT)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), '')"""
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM d)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM w"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substrings.remove_repeats(docs, with_text=False).drop("kept_text")


SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS key FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
j AS (SELECT d.doc_id, ws, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed, sha256(array_to_string(
  list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM j"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return postings.search(vectors, F.col("vec_id") % 20 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS item
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (item)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM b JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT g.y, c.root FROM c JOIN g ON g.x = c.node),
m AS (SELECT node AS doc_id, min(root) AS component_id FROM c GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN z USING (doc_id)"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, ws[i:i + m - 1] AS ws FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
  FROM (SELECT lang, ws, unnest([1, 2, 3, 4]) AS m FROM w) WHERE len(ws) >= m)),
f AS (SELECT lang, ws, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
n AS (SELECT lang, cast(sum(len(ws)) AS bigint) AS n FROM w GROUP BY 1),
e AS (SELECT lang, ws[:-2] AS part, f FROM f WHERE len(ws) > 2 UNION ALL SELECT lang, ws[2:], f FROM f WHERE len(ws) > 2),
x AS (SELECT lang, part AS ws, max(f) AS longer FROM e GROUP BY 1, 2),
c AS (SELECT f.lang, f.ws, f.f AS a, unnest(range(1, len(f.ws))) AS k FROM f LEFT JOIN x USING (lang, ws)
  WHERE len(f.ws) > 1 AND NOT 100 * coalesce(longer, 0)::HUGEINT >= 80 * f.f::HUGEINT),
s AS (SELECT c.*, l.f AS l, r.f AS r, cast((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS bigint) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]),
b AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM s
  QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
JOIN n USING (lang) WHERE rank <= 2000"""


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_differences.main_text(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = multi_index.whole_vectors(table(spark, sf_dir, "embeddings"), label)
    return multi_index.mine(rows, F.col("vec_id") % 50 == 0)


HARD_NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    cast(list_dot_product(a.v::double[], b.v::double[]) AS bigint) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, cast(rank AS int) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3"""


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, QUALITY_SQL),
    "op2_sentence_pieces": (op2_sentence_pieces, None),
    "op3_packing": (op3_packing, None),
    "op4_warc": (op4_warc, WARC_SQL),
    "op5_suffix_tree": (op5_suffix_tree, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_secrets": (op7_secrets, None),
    "op8_substrings": (op8_substrings, SUBSTRINGS_SQL),
    "op9_near_duplicates": (op9_near_duplicates, NEAR_SQL),
    "op10_neighbours": (op10_neighbours, None),
    "op11_collocations": (op11_collocations, COLLOCATIONS_SQL),
    "op12_main_text": (op12_main_text, None),
    "op13_hard_negatives": (op13_hard_negatives, HARD_NEGATIVES_SQL),
}
