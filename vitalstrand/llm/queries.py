"""Registered queries of the corpus operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstrand.llm import chat, decontaminate, fim, html_extract, mixing, near_dedup, packing, prefix_trie, quality, simhash, token_orc, toxicity, url_filter
from vitalstrand.llm.common import table
from vitalstrand.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
#: Production mix: every document at least once, no source more than this often.
MAX_REPEATS = 1.5
#: Rows at least this likely to be toxic are rejected.
TOXIC = 0.7


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def tokenizer() -> tuple[str]:
    """Arguments that name the vocabulary: its file."""
    import public_tokenizers

    return (public_tokenizers.path(TOKENIZER),)


@query("op1_decontamination")
def op1(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, COUNT(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (nx + ny - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = s.doc_id AS kept
FROM sets s JOIN (SELECT x, MIN(y) AS c FROM reach GROUP BY x) r ON r.x = s.doc_id
"""


@query("op2_minhash_dedup", OP2_SQL)
def op2(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_token_orc")
def op3(spark, sf_dir):
    path = fresh_path(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, *tokenizer())
    return token_orc.checksums(token_orc.read_tokens(spark, path))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
marked AS (
  SELECT *, LAG(role) OVER o IS DISTINCT FROM role AS starts, row_number() OVER o AS k FROM turns
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(SUM(length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + CASE WHEN starts
    THEN 4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 2 + 8 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op4_chat_format", OP4_SQL)
def op4(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    control = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text")
    )
    return chat.digests(chat.read_chats(chat.format_chats(turns.unionByName(extra))))


@query("op5_simhash")
def op5(spark, sf_dir):
    return simhash.fingerprint_edits(table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("op6_url_filter")
def op6(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op7_temperature_mix")
def op7(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"))


@query("op8_html_extract")
def op8(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op9_quality_trees")
def op9(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity_ordinal")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    graded = toxicity.grade_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return graded.select("doc_id", "expected_severity", "p_toxic", (F.col("p_toxic") >= TOXIC).alias("toxic"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, COALESCE(text, '') AS x, sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS e,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT c, [4294967295] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [ord(ch), -1, -1, -1, -1, -1, -1, -1, -1])) AS l
  FROM (SELECT DISTINCT c FROM t)),
convs AS (
  SELECT c, c - c % 20 AS b, xor(4294967295, list_reduce(l, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
    ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 4 AS h FROM steps),
turns AS (
  SELECT k.c, t.i, t.x, t.e FROM convs k JOIN t ON t.c = k.b AND t.i < k.h
  UNION ALL SELECT k.c, t.i, t.x, t.e FROM convs k JOIN t ON t.c = k.c AND t.i >= k.h),
prefixes AS (
  SELECT c, row_number() OVER w AS d, sha256(array_to_string(list(e) OVER w, '')) AS k, sha256(array_to_string(list(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS p,
    len(list_filter(regexp_split_to_array(x, '[ 	-]+'), lambda y: y <> '')) AS words
  FROM turns WINDOW w AS (PARTITION BY c ORDER BY i)
  UNION ALL SELECT c, 0, sha256(''), NULL, 0 FROM convs),
ended AS (SELECT c, MAX(d) AS d FROM prefixes GROUP BY c),
nodes AS (
  SELECT q.d, q.k, CASE WHEN q.d = 1 THEN sha256('') ELSE any_value(q.p) END AS p, MIN(q.c) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * MAX(words) AS saved,
    sha256(COALESCE(string_agg(CASE WHEN e.d = q.d THEN CAST(q.c AS VARCHAR) END, ',' ORDER BY q.c), '')) AS ends_sha256
  FROM prefixes q JOIN ended e ON e.c = q.c GROUP BY q.d, q.k),
family AS (SELECT n.*, m.conv_id AS parent_conv_id, (SELECT COUNT(*) FROM nodes z WHERE z.d = n.d + 1 AND z.p = n.k) AS n_children
  FROM nodes n LEFT JOIN nodes m ON m.d = n.d - 1 AND m.k = n.p),
below AS (
  SELECT a.d, a.k, SUM(f.saved) AS saved_tokens, SUM(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM family f JOIN prefixes own ON own.c = f.conv_id AND own.d <= f.d JOIN nodes a ON a.d = own.d AND a.k = own.k
  GROUP BY a.d, a.k)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN below b ON b.d = f.d AND b.k = f.k
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(*prefix_trie.continue_from_base(prefix_trie.number_turns(table(spark, sf_dir, "conversations"))))


@query("op12_linear_packing")
def op12(spark, sf_dir):
    return packing.packed_checksums(table(spark, sf_dir, "documents"), tokenizer()[0])


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS d3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d4 FROM drawn),
formed AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 90 THEN 'plain'
      WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (SELECT *, t[1:a] AS p, t[a + 1:b] AS m, t[b + 1:] AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark, sf_dir):
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))
