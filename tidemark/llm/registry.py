"""Queries of the training-data operators, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

import functools

from tidemark.llm import audio, bpe, html, minhash, packing, pii, quality, sharding, urls, vectors
from tidemark.llm.storage import bounded_batches


def _bounded(run):
    @functools.wraps(run)
    def query(spark, sf_dir):
        bounded_batches(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    found = {
        "op1_vector_dedup": vectors.op1_vector_dedup,
        "op2_histogram_sort": sharding.op2_histogram_sort,
        "op3_nbsvm": quality.op3_nbsvm,
        "op4_bpe": bpe.op4_bpe,
        "op5_minhash": minhash.op5_minhash,
        "op6_chroma_audio": audio.op6_chroma_audio,
        "op7_html_layout": html.op7_html_layout,
        "op8_pii": pii.op8_pii,
        "op10_packing": packing.op10_packing,
        "op9_url_filters": urls.op9_url_filters,
    }
    return {name: _bounded(run) for name, run in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filters": urls.OP9_SQL}
