"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op8_byte_bpe
from .chat import OP7_SQL, op7_chat_snapshots
from .collocations import OP13_SQL, op13_collocations
from .exact_top_k import OP10_SQL, op10_exact_top_k
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .imatch import op9_imatch_fingerprints
from .jaccard_join import op3_jaccard_join
from .mixing import OP12_SQL, op12_source_mix
from .packing import op6_best_fit_packing
from .secrets import op5_secret_scan
from .token_blocks import op1_token_blocks
from .toxicity import op2_toxicity
from .url_filter import op4_url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_snapshots": op7_chat_snapshots,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_imatch_fingerprints": op9_imatch_fingerprints,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_mix": op12_source_mix,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_snapshots": OP7_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_source_mix": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
