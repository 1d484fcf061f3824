"""Queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import embedding_dedup, licenses, line_dedup, mixing, ngram_join, ogg, packing, quality, style_tree, token_alignment, token_counts, warc, whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_mixing_sources": mixing.op3_mixing_sources,
        "op4_ogg_media_columns": ogg.op4_ogg_media_columns,
        "op5_site_style_tree": style_tree.op5_site_style_tree,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_warc_seekable_bundles": warc.op7_warc_seekable_bundles,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
        "op10_embedding_near_dedup": embedding_dedup.op10_embedding_near_dedup,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_cross_tokenizer_alignment": token_alignment.op12_cross_tokenizer_alignment,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing_sources": mixing.OP3_SQL, "op6_license_scan": licenses.license_sql(), "op7_warc_seekable_bundles": warc.OP7_SQL}
