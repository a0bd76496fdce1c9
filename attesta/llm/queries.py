"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe
from attesta.llm import chat
from attesta.llm import decontaminate as dc
from attesta.llm import html_text as ht
from attesta.llm import languages as lg
from attesta.llm import manifest as mf
from attesta.llm import quality as ql
from attesta.llm import simhash as sh
from attesta.llm import spelling as sp
from attesta.llm import suffix_dedup as sd
from attesta.llm import token_counts as tc
from attesta.llm import toxicity as tx
from attesta.llm import url_templates as ut
from attesta.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dc.find_items(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate(F.zip_with("_begin", "_end", lambda a, b: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op3_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.pack(rows, BYTE_BPE))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ut.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ql.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), drop_text=True)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in counts])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sd.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100, digest=True)
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=20_000)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sh.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, budget=3, drop_text=True)
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = mf.build(mf.document_leaves(table(spark, sf_dir, "documents")), ["doc_id"])
    root = F.lit(manifest.root).cast("string")
    found = mf.proofs(manifest).select("carry.doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), F.sha2(mf.proof_text(), 256).alias("proof_sha256"), mf.folded(F.coalesce("carry.tampered", "hash")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lg.predict(docs, lg.fit(docs, sample=400))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.group_variants(sp.words(table(spark, sf_dir, "documents"), min_length=7, min_count=2), ratio=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_html_layout": op2_html_layout,
    "op3_chat_prefix_tree": op3_chat_prefix_tree,
    "op4_url_templates": op4_url_templates,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_spelling_variants": op13_spelling_variants,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTROL = r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>"

#: CRC-32 of a text: the table of its polynomial (a fixed value), then byte by byte.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc32(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_RUNS = "list_transform(range((len(l) + 15) // 16), lambda k: sha256(array_to_string(l[k * 16 + 1:k * 16 + 16], '')))"
_SIBLINGS = "array_to_string(l[(w.p // 16) * 16 + 1:w.p], '') AS a, array_to_string(l[w.p + 2:(w.p // 16) * 16 + 16], '') AS b"

_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x)::BIGINT >> 6), 128 | (unicode(x)::BIGINT & 63)] END))"

ORACLE_SQL: dict[str, str] = {
    "op13_spelling_variants": f"""WITH RECURSIVE t AS ({_CRC_TABLE}), runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents), hashed AS (SELECT run, {_crc32(_BYTES)} AS h FROM runs, t),
v AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) u(k)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN v b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN v b ON a.rest = b.word),
near AS (SELECT word, n, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS best FROM pairs GROUP BY word, n), forms AS (SELECT word, best.other AS form, -best.m AS form_n FROM near WHERE -best.m >= 10 * n),
follow AS (SELECT word, word AS root, 0 AS k FROM v UNION ALL SELECT f.word, forms.form, k + 1 FROM follow f JOIN forms ON forms.word = f.root), ends AS (SELECT word, arg_max(root, k) AS root FROM follow GROUP BY word)
SELECT v.word, form, root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v JOIN ends USING (word) LEFT JOIN near USING (word) LEFT JOIN forms USING (word)""",
    "op11_merkle_manifest": f"""WITH RECURSIVE t AS ({_CRC_TABLE}), d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 5 = 0 THEN {_leaf(f"translate(text, {_AZ})")} END AS changed FROM documents, t),
part AS (SELECT source, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS l FROM d GROUP BY source), tree AS (SELECT source, 0 AS k, l FROM part UNION ALL SELECT source, k + 1, {_RUNS} FROM tree WHERE len(l) > 1),
sub AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM tree WHERE len(l) = 1), top AS (SELECT 0 AS k, list(subroot ORDER BY p) AS l FROM sub UNION ALL SELECT k + 1, {_RUNS} FROM top WHERE len(l) > 1),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
levels AS (SELECT false AS up, * FROM tree UNION ALL SELECT true, NULL, * FROM top),
walk AS (SELECT doc_id, source, leaf, place AS p, 0 AS k, false AS up, '' AS proof, coalesce(changed, leaf) AS f FROM leaves
UNION ALL SELECT doc_id, source, leaf, CASE WHEN more THEN p // 16 ELSE sub_p END, CASE WHEN more THEN k + 1 ELSE 0 END, up OR NOT more, proof || a || b, CASE WHEN more THEN sha256(a || f || b) ELSE f END
FROM (SELECT w.*, len(l) > 1 AS more, sub.p AS sub_p, {_SIBLINGS} FROM walk w JOIN levels v ON v.up = w.up AND v.k = w.k AND v.source IS NOT DISTINCT FROM CASE WHEN NOT w.up THEN w.source END JOIN sub ON sub.source IS NOT DISTINCT FROM w.source) WHERE NOT up OR more)
SELECT doc_id, leaf, subroot, l[1] AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = l[1] AS verified FROM walk w JOIN top ON top.k = w.k AND len(l) = 1 JOIN sub ON sub.source IS NOT DISTINCT FROM w.source WHERE up""",
    "op1_decontamination": f"""WITH iw AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark), win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g FROM iw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), dg AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM dw, (SELECT DISTINCT m FROM win) s, unnest(range(1, len(w) - m + 2)) t(k)),
hit AS (SELECT doc_id, k, dg.m AS m, item FROM dg JOIN win ON win.m = dg.m AND win.g = dg.g), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id""",
    "op3_chat_prefix_tree": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(16 + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
}
