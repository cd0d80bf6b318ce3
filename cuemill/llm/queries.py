"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import audio, exact_dedup, langid, lines, lm_score, merkle, packing, quality, simhash, spm, suffix, toxicity, whitening
from cuemill.llm.common import join_small, pin, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled as of good quality, the background as many words of other documents."""
    good = pin(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct())
    docs = join_small(table(spark, sf_dir, "documents"), good, ["doc_id"], "left")
    return lm_score.score_documents(docs, F.col("good"))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.read_audio(audio.store_audio(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return spm.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per language; of a third of the documents the text is lower-cased afterwards, which the proofs must show."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(*fields, lowered))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", merkle.leaf(*fields, "text").alias("leaf"), altered.alias("altered"))
    with scratch(spark) as kept:
        found = merkle.manifest(leaves).withColumn("folded_root", merkle.fold(F.coalesce("altered", "leaf")))
        proof = F.sha2(merkle.siblings().cast("binary"), 256).alias("proof_sha256")
        verified = (F.col("folded_root") == F.col("root")).alias("verified")
        return pin(found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", verified), kept)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 8, upper: int = 4) -> str:
    """For languages of up to 8 ** ``levels`` rows: per level the runs of a tree, and what each leaf's proof and changed digest gain by them."""
    field = "coalesce(strlen(cast({0} AS VARCHAR)) || ':' || cast({0} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(field.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "flatten(list_transform(regexp_split_to_array(cast(doc_id AS VARCHAR), ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
        WITH leaves AS (
            SELECT doc_id, lang, {row("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(lowered)} ELSE {row("text")} END AS changed
            FROM documents),
        p0 AS (
            SELECT doc_id, leaf, changed, '' AS proof, coalesce('=' || lang, '-') AS tree, count(*) OVER (PARTITION BY lang) AS size,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
            FROM leaves),
        n0 AS (SELECT tree, place, size, leaf AS node FROM p0)"""

    def climb(k: int) -> str:
        return f""",
        r{k} AS (SELECT tree, place // 8 AS place, any_value(size) AS size, list(node ORDER BY place) AS run FROM n{k} GROUP BY tree, place // 8),
        n{k + 1} AS (SELECT tree, place, (size + 7) // 8 AS size, CASE WHEN size = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node FROM r{k}),
        p{k + 1} AS (
            SELECT doc_id, leaf, tree, p.place // 8 AS place, (p.size + 7) // 8 AS size, PLACEHOLDER
                   proof || array_to_string(run[:p.place % 8], '') || array_to_string(run[p.place % 8 + 2:], '') AS proof,
                   CASE WHEN p.size = 1 THEN changed ELSE sha256(array_to_string(run[:p.place % 8], '') || changed || array_to_string(run[p.place % 8 + 2:], '')) END AS changed
            FROM p{k} p JOIN r{k} r USING (tree) WHERE p.place // 8 = r.place)"""

    for k in range(levels):
        sql += climb(k).replace(" PLACEHOLDER", "")
    top = levels + 1
    sql += f""",
        s AS (SELECT tree, node AS subroot, count(*) OVER () AS size, row_number() OVER (ORDER BY tree) - 1 AS place FROM n{levels}),
        n{top} AS (SELECT '' AS tree, place, size, subroot AS node FROM s),
        p{top} AS (SELECT doc_id, leaf, changed, proof, '' AS tree, s.size, s.place, subroot FROM p{levels} p JOIN s USING (tree))"""
    for k in range(top, top + upper):
        sql += climb(k).replace("PLACEHOLDER", "subroot,")
    last = top + upper
    return f"""{sql}
        SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, changed AS folded_root, changed = node AS verified
        FROM p{last} CROSS JOIN n{last}
    """


ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id)
    """,
    "op11_merkle_manifest": _merkle_sql(),
}


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}
