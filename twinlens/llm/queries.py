"""The numbered queries and the pipeline: each maps the given tables to an operator's interface and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from twinlens.llm.archives import index_archives, write_archives
from twinlens.llm.decontaminate import decontaminate
from twinlens.llm.exact_copies import exact_copies
from twinlens.llm.infill import fill_in_middle
from twinlens.llm.langid import identify_languages, learn_languages
from twinlens.llm.licenses import COPYRIGHT_LINE, KNOWN, NOT_A_WORD, SPELLINGS, known_licenses, page_licenses
from twinlens.llm.manifest import fold_root, page_leaf, proof_digest, seal_pages
from twinlens.llm.near_copies import near_copies
from twinlens.llm.pieces import decode_pages, encode_pages
from twinlens.llm.shared import keep
from twinlens.llm.suffix_tree import score_pages
from twinlens.llm.token_counts import token_counts
from twinlens.llm.tool_calls import format_chats
from twinlens.llm.toxicity import score_toxicity
from twinlens.session import scratch_path

PIECES = "piece_bpe_32k.model"
COUNTED = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_pages(documents: DataFrame, *more: Column) -> DataFrame:
    return documents.select(F.col("doc_id").alias("path"), "text", *more)


def fold(n: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether a row is held out; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)) == remainder, F.lit(False))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def model_bytes(name: str) -> bytes:
    with open(tokenizer_path(name), "rb") as file:
        return file.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, documents = model_bytes(PIECES), table(spark, sf_dir, "documents")
    # A text comes back with plain spaces for U+2581, so that is what its digest is of.
    digest = lambda text: F.xxhash64(F.replace(F.coalesce(text, F.lit("")), F.lit("▁"), F.lit(" ")))
    marked = documents.select(F.struct("doc_id", digest(F.col("text")).alias("digest")).alias("path"), "text")
    # Stored between, so that the two models never share an executor's memory.
    back = decode_pages(keep(encode_pages(marked, model)), model)
    return back.select("path.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (digest(F.col("text")) == F.col("path.digest")).alias("round_trip"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_pages(as_pages(documents, (~fold(5, 1)).alias("training")))
    return scored.select(F.col("path").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn_languages(documents.filter(~fold(4, 2)).select("text", "lang"))
    found = identify_languages(as_pages(documents), model)
    return found.withColumnRenamed("path", "doc_id").select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(as_pages(table(spark, sf_dir, "documents")), tokenizer_path(COUNTED), scratch_path(spark, "token-counts"))
    return counted.withColumnRenamed("path", "doc_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(as_pages(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("path").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~fold(3, 1)).select(F.col("doc_id").alias("path"), "toxic")
    scored = score_toxicity(as_pages(table(spark, sf_dir, "documents")), labels)
    return scored.withColumnRenamed("path", "doc_id").select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), "turn", "role", "text")
    # The tables name no tools, so a call in them is one of an unknown tool.
    tools = spark.createDataFrame([], "name string, parameter string, type string, required boolean")
    return format_chats(messages, tools).withColumnRenamed("conversation", "conv_id")


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(as_pages(table(spark, sf_dir, "documents")))
    return found.select(F.col("path").alias("doc_id"), F.col("class_path").alias("class_id"), F.col("group_path").alias("group_id"), "n_links", "kept")


def op9_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(as_pages(table(spark, sf_dir, "documents")))
    return found.select(F.col("path").alias("doc_id"), F.col("keep_path").alias("keep_id"), "group_size", "kept", "text_sha256")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_licenses(as_pages(table(spark, sf_dir, "documents")), known_licenses(spark))
    return found.withColumnRenamed("path", "doc_id")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit(None).cast("string").alias("side"), F.col("page_id").alias("path"), "url", "html")
    records = index_archives(write_archives(pages, scratch_path(spark, "archives")))
    number = lambda c: F.col(c).cast("long")
    return records.select(number("path").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("side"), F.col("doc_id").alias("path"), "lang", "n_chars", "text")
    fields = ("path", "side", "lang", "n_chars", "text")
    tampered = page_leaf(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))
    shown = pages.withColumn("shown", F.when(fold(2, 0, "path"), tampered).otherwise(page_leaf(*fields)))
    sealed = seal_pages(shown, fields, carry=["shown"])
    folded = sealed.withColumn("folded_root", fold_root("witness", F.col("shown")))
    return folded.select(
        F.col("path").alias("doc_id"), "leaf", "subroot", "root", proof_digest("witness").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Restored in the same task: a second row of Python workers would share the executor's memory.
    made = fill_in_middle(as_pages(table(spark, sf_dir, "documents")), keys=["path"], seed=1, prove=True)
    return made.select(
        F.col("path").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_tool_calls": op7_tool_calls,
    "op8_near_copies": op8_near_copies,
    "op9_exact_copies": op9_exact_copies,
    "op10_licenses": op10_licenses,
    "op11_warc": op11_warc,
    "op12_manifest": op12_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase, least(13, len(w)) AS size
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
size AS (SELECT DISTINCT size FROM win),
gram AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, size WHERE len(w) >= size)
),
hit AS (SELECT doc_id, i, size, item_id FROM gram JOIN win USING (phrase, size)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word ON doc.doc_id = word.doc_id LEFT JOIN ids ON doc.doc_id = ids.doc_id
"""

# The tables hold plain messages only; calls and results are tested on small chats.
_OP7 = """
SELECT conv_id, turn, role,
    CASE WHEN text IS NULL AND role IS NULL THEN '{}' WHEN text IS NULL THEN '{"role":' || to_json(role) || '}'
        WHEN role IS NULL THEN '{"content":' || to_json(text) || '}' ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS message,
    CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_answered, CAST(0 AS BIGINT) AS n_invalid, CAST(NULL AS INTEGER) AS level
FROM conversations
"""

_OP9 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _canonical_sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"(' ' || regexp_replace({out}, {quoted(NOT_A_WORD)}, ' ', 'g') || ' ')"
    for seen, meant in SPELLINGS:
        out = f"replace({out}, ' {seen} ', ' {meant} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_OP10 = f"""
WITH known(license_id, text) AS (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)}),
digest AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
line AS (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS block_licenses FROM (SELECT DISTINCT doc_id, license_id FROM line JOIN digest USING (digest)) GROUP BY doc_id),
doc AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc.doc_id, doc.digest, license_id, coalesce(block_licenses, '') AS block_licenses
FROM doc LEFT JOIN digest USING (digest) LEFT JOIN found ON doc.doc_id = found.doc_id
"""

_OP11 = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT payload, min(page_id) AS page_id FROM page GROUP BY payload),
digit AS (
    SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) >> (5 * (3 - d))) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, d) AS digest
    FROM (SELECT DISTINCT hex FROM page), (SELECT CAST(unnest(range(8)) AS INTEGER) AS g), (SELECT CAST(unnest(range(4)) AS INTEGER) AS d) GROUP BY hex
)
SELECT page.page_id, CAST(octet_length(page.payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN page.page_id IS NOT DISTINCT FROM first.page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page.page_id IS DISTINCT FROM first.page_id THEN first.page_id END AS refers_to
FROM page JOIN first ON page.payload = first.payload JOIN digit ON page.hex = digit.hex
"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# CRC-32 in SQL: eight steps of its table for each byte of the decimal id.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, zero: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END))"""

_OP12 = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
        CASE WHEN xor({_CRC}, CAST(4294967295 AS BIGINT)) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown
    FROM documents
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM doc),
node(lvl, tree, pos, n, h) AS (
    SELECT 0, tree, pos, n, leaf FROM ranked
    UNION ALL
    SELECT lvl + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lvl, tree, pos // 3, n
),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper(lvl, pos, n, h) AS (
    SELECT 0, pos, n, h FROM sub
    UNION ALL
    SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n
),
above AS (
    SELECT sub.tree, upper.lvl + 1000 AS lvl, string_agg(upper.h, '' ORDER BY upper.pos) FILTER (WHERE upper.pos < sub.pos // CAST(pow(3, upper.lvl) AS BIGINT)) AS l,
        string_agg(upper.h, '' ORDER BY upper.pos) FILTER (WHERE upper.pos > sub.pos // CAST(pow(3, upper.lvl) AS BIGINT)) AS r
    FROM sub JOIN upper ON upper.n > 1 AND upper.pos // 3 = sub.pos // CAST(pow(3, upper.lvl + 1) AS BIGINT) GROUP BY sub.tree, upper.lvl
),
level AS (
    SELECT leaf.tree, leaf.pos, node.lvl, string_agg(node.h, '' ORDER BY node.pos) FILTER (WHERE node.pos < leaf.pos // CAST(pow(3, node.lvl) AS BIGINT)) AS l,
        string_agg(node.h, '' ORDER BY node.pos) FILTER (WHERE node.pos > leaf.pos // CAST(pow(3, node.lvl) AS BIGINT)) AS r
    FROM ranked AS leaf JOIN node ON node.tree = leaf.tree AND node.n > 1 AND node.pos // 3 = leaf.pos // CAST(pow(3, node.lvl + 1) AS BIGINT) GROUP BY leaf.tree, leaf.pos, node.lvl
    UNION ALL
    SELECT ranked.tree, ranked.pos, above.lvl, l, r FROM ranked JOIN above USING (tree)
),
proof AS (
    SELECT tree, pos, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY lvl) AS siblings, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY lvl) AS steps
    FROM level GROUP BY tree, pos
),
folded AS (
    SELECT ranked.doc_id, ranked.leaf, sub.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
        list_reduce(list_prepend(ranked.shown, coalesce(steps, [])), lambda below, step: sha256(split_part(step, '|', 1) || below || split_part(step, '|', 2))) AS folded_root
    FROM ranked JOIN sub ON ranked.tree = sub.tree LEFT JOIN proof ON ranked.tree = proof.tree AND ranked.pos = proof.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""

_OP13 = """
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
        sha256('1' || coalesce(':' || doc_id, '')) AS h
    FROM documents
),
number AS (
    SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS two,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS three, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS four
    FROM doc
),
part AS (
    SELECT doc_id, text, n, array_to_string(t[1:least(one, two)], '') AS prefix, array_to_string(t[least(one, two) + 1:greatest(one, two)], '') AS middle,
        array_to_string(t[greatest(one, two) + 1:n], '') AS suffix,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM number
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM part
"""

ORACLE_SQL: dict[str, str] = {"op5_decontaminate": _OP5, "op7_tool_calls": _OP7, "op9_exact_copies": _OP9, "op10_licenses": _OP10, "op11_warc": _OP11, "op12_manifest": _OP12, "op13_fill_in_middle": _OP13}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
