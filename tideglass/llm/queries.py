"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.llm import common


def op1_imatch_fingerprints(spark, sf_dir):
    from tideglass.llm.imatch import fingerprint_pairs

    return fingerprint_pairs(common.table(spark, sf_dir, "documents"))


def op2_trie_token_counts(spark, sf_dir):
    import public_tokenizers

    from tideglass.llm.trie_tokens import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_harmonic_packing(spark, sf_dir):
    import public_tokenizers

    from tideglass.llm.packing import pack_documents

    packed = pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_matroska(spark, sf_dir):
    from tideglass.llm.matroska import read_media, text_to_media

    read = read_media(text_to_media(common.table(spark, sf_dir, "documents")), with_packets=True)
    spans = F.aggregate("packets", F.lit(0).cast("bigint"), lambda total, p: total + p["size"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("codec=%s;packets=%d;clusters=%d;cues=%d;ms=%d;bytes=%d;last_ns=%d;sum=%d;crossings=%d", "codec", "n_packets", "n_clusters", "n_cues", (F.col("duration_ns") / 1_000_000).cast("bigint"), spans, F.expr("element_at(packets, -1).timestamp_ns"), "level_sum", "level_crossings").alias("feature"),
    )


def op5_dart_minhash(spark, sf_dir):
    from tideglass.llm.dart_minhash import near_duplicate_classes

    return near_duplicate_classes(common.table(spark, sf_dir, "documents"))


def op6_hmm_language_model(spark, sf_dir):
    from tideglass.llm.hmm import hmm_scores

    return hmm_scores(common.table(spark, sf_dir, "documents"), F.expr("crc32(cast(doc_id as string)) % 5 = 1"))


def op7_knn_toxicity(spark, sf_dir):
    from tideglass.llm.knn_toxicity import fit, score_documents

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scorer = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), F.expr("crc32(cast(doc_id as string)) % 5 != 0"))
    scored = score_documents(docs.select("doc_id", "text"), scorer, with_evidence=True)
    nearest = F.transform("toxic_evidence", lambda e: F.concat_ws(":", e["id"].cast("string"), F.round(e["cosine"], 6).cast("string"), e["toxic"].cast("int").cast("string")))
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), F.col("toxic_score").alias("score"), F.expr("cast(toxic_score >= 0.5 as int)").alias("predicted"), "toxic_neighbours", "toxic_nearest", F.array_join(nearest, ",").alias("evidence"))


def op9_bootstrapped_pii(spark, sf_dir):
    from tideglass.llm.pii import KINDS, find_pii, joined_spans

    found = find_pii(common.table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["rank"] < len(KINDS)))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(F.encode(joined_spans(F.col("base")), "UTF-8"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def language_and_quality(spark, sf_dir):
    """Documents' labels with the domain `lang:quality`."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return docs, labels.where("quality is not null").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.concat_ws(":", "lang", F.col("quality").cast("string")).alias("domain"))


def even_languages(natural):
    """Languages share alike; of each, nine tokens in ten are of quality 1."""
    languages = {d.partition(":")[0] for d in natural}
    return {d: (0.9 if d.endswith(":1") else 0.1) / len(languages) for d in natural}


#: No document is repeated more often than this.
MOST_COPIES = 10


def op8_soft_membership_mixing(spark, sf_dir):
    from tideglass.llm.mixing import mixture

    docs, labels = language_and_quality(spark, sf_dir)
    found = mixture(docs, labels, F.col("domain"), even_languages, keep=("doc_id", "source"), most=MOST_COPIES)
    names = F.array(*(F.lit(d) for d, *_ in found.report)) if found.report else F.array(F.lit(None).cast("string"))
    target, reached = (F.array(*(F.lit(round(r[i])).cast("bigint") for r in found.report)) if found.report else F.array(F.lit(None).cast("bigint")) for i in (2, 3))
    best = F.array_max("p")
    at = F.greatest(F.array_position("p", best), F.lit(1)).cast("int") - 1
    return found.table.select(
        "row.doc_id", "row.source", F.col("tokens").cast("bigint").alias("n_tokens"), F.get(names, at).alias("domain"), F.round(best, 6).alias("posterior"),
        F.round("rate", 6).alias("rate"), F.col("copies").cast("bigint").alias("copies"), F.get(target, at).alias("domain_target"), F.get(reached, at).alias("domain_reached"),
    )


def op10_forest_secret_scan(spark, sf_dir):
    from tideglass.llm.secret_scan import scan_secrets

    return scan_secrets(common.table(spark, sf_dir, "documents"))


OPERATORS = (op1_imatch_fingerprints, op2_trie_token_counts, op3_harmonic_packing, op4_matroska, op5_dart_minhash, op6_hmm_language_model, op7_knn_toxicity, op8_soft_membership_mixing, op9_bootstrapped_pii, op10_forest_secret_scan)


def queries():
    return {f.__name__: f for f in OPERATORS}


def oracle_sql():
    return {}
