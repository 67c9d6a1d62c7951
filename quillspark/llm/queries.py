"""Registered queries of the operators in this subpackage, with DuckDB twins where SQL can express them.

Each query is a thin wrapper: it reads its table, applies the operator with production parameters to all rows, and
derives digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exactfit, langid, lexical, lines, mixing, neighbours, ngram_join, packing, quality, spans, suffixes, trie
from .shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# SQL fragments: white space as a trim list, words of a text, lower-casing A-Z only
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_ngram_jaccard_join", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform({_WORDS}, lambda x: {_FOLD.format('x')}) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM d
), n AS (
  SELECT doc_id, len(g)::BIGINT AS n FROM s
), e AS (
  SELECT doc_id, hash(unnest(g)) AS h FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 85 * (nx.n + ny.n - common)
), u AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE r.root <= u.y
)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, num=85, den=100)


@register("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(read(spark, sf_dir, "documents"), length=400, digest=True)


@register("op3_chat_formatting", """
WITH t AS (
  SELECT conv_id, list([coalesce(role, 'user'), coalesce(text, '')] ORDER BY turn, role, text) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), w AS (
  SELECT conv_id, ts, md5(ts::VARCHAR) AS whole FROM t
), p AS (
  SELECT DISTINCT md5(ts[1:n]::VARCHAR) AS whole FROM (SELECT ts, unnest(range(1, len(ts))) AS n FROM t)
), f AS (
  SELECT whole, min(conv_id) AS conv_id, count(*)::BIGINT AS n_logged FROM w GROUP BY whole
)
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_logged,
  array_to_string(list_transform(ts, lambda x: '<|' || x[1] || '|>' || chr(10) || x[2] || chr(10) || '<|end|>' || chr(10)), '')
    AS rendered
FROM f JOIN w USING (conv_id, whole) WHERE whole NOT IN (SELECT whole FROM p)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@register("op5_line_dedup", f"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, {_FOLD.format(f'trim(line, {_BLANKS})')} AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.*, f.keep IS NOT NULL AND f.keep <> k.doc_id AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs, min_chars=20, min_docs=3, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@register("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = spans.remove_repeated(docs, span=2, min_words=8, counts=True, grow=True)
    return out.select("doc_id", "n_sentences", "n_removed", F.length(F.encode("text", "UTF-8")).alias("n_kept_bytes"),
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@register("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.metrics(read(spark, sf_dir, "documents"))


@register("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@register("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken_words(*mixing.mix(read(spark, sf_dir, "documents")))
    return out.select("doc_id", F.col("_mx_size").alias("size"), "source_size", "target", "taken")


@register("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


# crc32 of a decimal number: the digits' bytes folded in one by one, eight shifts each
_CRC = """(xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295))"""


@register("op11_conversation_trie", f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), head AS (
  SELECT conv_id, ts, {_CRC.format('conv_id')} % 9 AS h FROM own
), built AS (
  SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts
  FROM head a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), step AS (
  SELECT conv_id, len(ts) AS total, unnest(range(0, len(ts) + 1)) AS depth, ts FROM built
), pre AS (
  SELECT conv_id, total, depth, sha256(ts[1:depth]::VARCHAR) AS node, CASE WHEN depth > 0 THEN sha256(ts[1:depth - 1]::VARCHAR) END AS up,
    CASE WHEN depth > 0 THEN strlen(ts[depth].text) ELSE 0 END AS bytes FROM step
), nodes AS (
  SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
  FROM pre GROUP BY depth, node
), kids AS (
  SELECT depth - 1 AS depth, up AS node, count(*)::BIGINT AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), facts AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, node)
), sums AS (
  SELECT p.depth, p.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved_tokens
  FROM facts f JOIN pre p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM facts f JOIN sums s USING (depth, node) LEFT JOIN facts u ON u.depth = f.depth - 1 AND u.node = f.up
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.conversations(read(spark, sf_dir, "conversations"))
    base = own.filter(F.col("id") % 5 == 0).select(F.col("id").alias("base"), F.slice("turns", 1, 8).alias("start"))
    shared = F.crc32(F.col("id").cast("string").cast("binary")) % 9
    start = F.slice(F.coalesce("start", F.slice("turns", 1, 0)), F.lit(1), shared.cast("int"))
    rest = F.slice("turns", (shared + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1)))
    built = own.join(base, F.col("id") - F.col("id") % 5 == F.col("base"), "left").select("id", F.concat(start, rest).alias("turns"))
    out = trie.prefix_trie(built)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


@register("op12_exact_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactfit.pack(read(spark, sf_dir, "documents"), end_id=2, length=1024)


_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op13_ranked_search", f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_transform({_TERMS.format("coalesce(text, '')")}, lambda x: {_FOLD.format('x')}) AS ts FROM documents
), s AS (
  SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), i AS (
  SELECT DISTINCT item_id, text FROM benchmark
), q AS (
  SELECT item_id, row_number() OVER () AS item, {_FOLD.format('unnest(' + _TERMS.format("coalesce(text, '')") + ')')} AS term FROM i
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM q GROUP BY ALL
), t AS (
  SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d
), f AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM t SEMI JOIN asked USING (term) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term
), score AS (
  SELECT item, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM f JOIN w USING (term) JOIN asked USING (term), s GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 10
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)
