"""Registered queries of the numbered operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from plumbline.session import table

from . import centroids, decontam, dialogs, langid, mixing, neardup, packing, pii, secrets, suffixes, tokens, toxicity, vectors

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query
def op7_token_files(spark, folder):
    return tokens.token_digest(table(spark, folder, "documents"))


@query
def op3_secret_scan(spark, folder):
    return secrets.secret_digest(table(spark, folder, "documents"))


@query
def op10_benchmark_decontamination(spark, folder):
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_minhash_near_dedup(spark, folder):
    return neardup.linked(table(spark, folder, "documents"))


@query
def op5_language_id(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query
def op6_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_embedding_near_dedup(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query
def op8_pii_surrogates(spark, folder):
    return pii.surrogates(table(spark, folder, "documents"))


@query
def op9_suffix_dedup(spark, folder):
    return suffixes.repeat_digest(table(spark, folder, "documents"))


@query
def op11_centroid_clusters(spark, folder):
    return centroids.cluster_vectors(table(spark, folder, "embeddings"))


SQL["op11_centroid_clusters"] = centroids.cluster_sql()


@query
def op12_source_mix(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).drop("source")


@query
def op13_conversation_repair(spark, folder):
    return dialogs.damage_and_repair(table(spark, folder, "conversations"))
