"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import bloomlm, bpe, chat, earley, jaccard, media, packing, periods, pii, quality, sharding, topk, toxicity
from .common import read_table

#: Bytes of text in a shard of the query's tables.
SHARD_BYTES = 1 << 20


def op1_chat_hmm(spark, sf_dir):
    raw = chat.as_transcripts(read_table(spark, sf_dir, "conversations"))
    return chat.parse(raw, chat.fit(raw, role="true_role"))


def op2_bootstrapped_pii(spark, sf_dir):
    return pii.find(read_table(spark, sf_dir, "documents"))


def op3_ordinal_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).drop("text")


def op4_norm_bucket_topk(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op6_mpeg_media(spark, sf_dir):
    return media.digest_texts(read_table(spark, sf_dir, "documents"))


def op7_bpe_automaton(spark, sf_dir):
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"))


def op10_kneser_ney_toxicity(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_partenum_jaccard(spark, sf_dir):
    return jaccard.classes(read_table(spark, sf_dir, "documents"))


def op9_extendible_sharding(spark, sf_dir):
    return sharding.shard(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_bloom_lm(spark, sf_dir):
    return bloomlm.score_documents(read_table(spark, sf_dir, "documents"))


def op12_earley_repair(spark, sf_dir):
    return earley.repair_conversations(read_table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark, sf_dir):
    return periods.digest_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_hmm, op2_bootstrapped_pii, op3_ordinal_quality, op4_norm_bucket_topk, op5_best_fit_packing, op6_mpeg_media, op7_bpe_automaton, op8_partenum_jaccard, op9_extendible_sharding, op10_kneser_ney_toxicity, op11_bloom_lm, op12_earley_repair, op13_periodic_runs)}
ORACLES = {"op4_norm_bucket_topk": topk.TOP_K_SQL, "op9_extendible_sharding": sharding.shard_sql(SHARD_BYTES)}
