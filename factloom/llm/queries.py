"""The registered queries of the llm operators: each reads whole tables and returns its operator's full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, html_text, license_scan, lm, manifest, minhash, packing, periodic, quality, substring, suffix_dedup, warc
from .common import bounded_batches, table, table_if_any, written


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as a file source/lang/doc_id of a tree.

    The first document of a directory that speaks of a licence is its licence file: its name is LICENSE.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    speaks = docs.where(F.rlike("text", F.lit("(?i)licen[cs]e"))).groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    speaks = written(speaks, "speaks")  # a written table has a known size: Spark broadcasts it only if it is small
    name = F.when(F.col("doc_id") == F.col("first"), "LICENSE").otherwise(F.col("doc_id").cast("string"))
    files = docs.join(speaks, ["source", "lang"], "left")
    files = files.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text")
    return license_scan.licenses(files).select("row.doc_id", "row.path", "license", "how", "similarity", "source")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 512, 1024, 2048 or 4096 words."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back and assembled."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the passage and its edit distance."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and the verdict of the quality rules for every document."""
    out = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"], labels=table_if_any(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings of 400 bytes cover, and the text without them."""
    out = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), min_bytes=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), suffix_dedup.text_of("kept").alias("text"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: 4-word shingles, similarity of 80 percent."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too: one row per passage."""
    out = substring.passages(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.explode("spans").alias("x")).select("doc_id", F.col("x.s").alias("start_word"), F.col("x.e").alias("end_word"), F.col("x.home_id").alias("home_doc_id"), F.col("x.home_s").alias("home_start"), F.col("x.home_e").alias("home_end"), F.col("x.edits").alias("edits"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree scores of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after a period is planted into one in ten, as the contract has it."""
    bounded_batches(spark)
    docs = periodic.with_planted_period(table(spark, sf_dir, "documents"))
    x = docs.select("doc_id", periodic.periodic_runs(F.col("text")).alias("x")).select("doc_id", "x.runs", "x.collapsed")
    x = x.withColumn("best", periodic.longest_run(F.col("runs")))
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A text that holds what templates use as marks, and a backslash.
TRAP = "\\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says what templates use as marks, formatted and read back."""
    bounded_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    out = chat.digests(chat.as_records(rows.unionByName(trap)))
    return out.select("row.conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of the manifest, its inclusion proof, and what its (for one in five tampered) content folds to."""
    docs = table(spark, sf_dir, "documents")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = lambda text: manifest.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, digest(small))
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), digest(F.col("text")).alias("digest"), F.struct("doc_id", tampered.alias("tampered")).alias("payload"))
    x = manifest.proofs(manifest.build(leaves))
    x = x.withColumn("folded_root", manifest.folded(F.coalesce("payload.tampered", "leaf"), F.col("path")))
    return x.select("payload.doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_warc_assembly, op4_benchmark_decontamination, op5_quality_rules, op6_suffix_array_dedup, op7_minhash_near_dedup, op8_substring_dedup, op9_html_extraction, op10_lm_scoring, op11_periodic_runs, op12_chat_formatting, op13_merkle_manifest)}


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
hx AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
d AS (
  SELECT page_id, url, payload_bytes, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> (5 * (3 - j))) & 31 AS INTEGER), 1), '' ORDER BY i, j) AS payload_digest
  FROM (SELECT page_id, url, payload_bytes, i, CAST('0x' || substr(x, 1 + 5 * CAST(i AS INTEGER), 5) AS BIGINT) AS v FROM hx, range(8) AS a(i)), range(4) AS b(j)
  GROUP BY page_id, url, payload_bytes
),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, trim(url) AS url
FROM d JOIN f USING (payload_digest)
"""


#: A turn is <turn>role<says>text</turn> and a line feed; marks in roles and texts are broken by a backslash.
_MARKED = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<turn>', '<' || chr(92) || 'turn>'), '<says>', '<' || chr(92) || 'says>'), '</turn>', '<' || chr(92) || '/turn>')"
OP12_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {{trap}} UNION ALL SELECT -7, 1, 'assistant', {{trap}}
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('<turn><says></turn>' || chr(10)) + length({_MARKED.format('role')}) + length({_MARKED.format('text')}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""".replace("{trap}", f"'{TRAP}'")


def _merkle_sql(levels: int = 6) -> str:
    """SQL of the manifest for up to 16 ** levels documents a source, and sources."""
    field = lambda x: f"coalesce(strlen(cast({x} AS VARCHAR)) || ':' || cast({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), {bits})), 4294967295::UBIGINT)"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str) -> list[str]:
        # nodes of a group at height h; the children of the nodes above; a group's last node stays
        out = []
        for h in range(levels):
            out.append(f"{name}{h}k AS (SELECT grp, idx // 16 AS idx, list(digest ORDER BY idx) AS kids FROM {name}{h} WHERE n > 1 GROUP BY ALL)")
            out.append(f"{name}{h + 1} AS (SELECT grp, idx, sha256(array_to_string(kids, '')) AS digest, count(*) OVER (PARTITION BY grp) AS n FROM {name}{h}k)")
        out.append(f"{name}end AS (" + " UNION ALL ".join(f"SELECT grp, digest FROM {name}{h} WHERE n = 1" for h in range(levels + 1)) + ")")
        return out

    def climb(name: str, source: str, idx: str, first: int) -> list[str]:
        # each document's siblings and folded digest, a level a step
        out = []
        for h in range(levels):
            k, d = f"x{first + h}", f"cast(({source}.{idx} >> {4 * h}) % 16 AS INTEGER)"
            left, right = f"array_to_string(kids[1:{d}], '')", f"array_to_string(kids[{d} + 2:], '')"
            grp = f"k.grp = {source}.grp" if name == "s" else "true"
            out.append(f"{k} AS (SELECT {source}.* REPLACE (CASE WHEN kids IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN kids IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold) FROM {source} LEFT JOIN {name}{h}k k ON {grp} AND k.idx = {source}.{idx} >> {4 * (h + 1)})")
            source = k
        return out

    steps = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(small)} END AS tampered FROM documents)",
        "x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d)",
        "s0 AS (SELECT grp, idx, leaf AS digest, n FROM x)", *tree("s"),
        "t0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, digest, count(*) OVER () AS n, grp AS source FROM send)", *tree("t"),
        "x0 AS (SELECT doc_id, x.grp, x.idx, t0.idx AS place, leaf, t0.digest AS subroot, tend.digest AS root, '' AS proof, coalesce(tampered, leaf) AS fold FROM x JOIN t0 ON t0.source = x.grp CROSS JOIN tend)",
        *climb("s", "x0", "idx", 1), *climb("t", f"x{levels}", "place", levels + 1),
    ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM x{2 * levels}"


def oracle_sql() -> dict:
    return {"op3_warc_assembly": OP3_SQL, "op12_chat_formatting": OP12_SQL, "op13_merkle_manifest": _merkle_sql()}
