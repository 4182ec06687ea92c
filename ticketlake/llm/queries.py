"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm.bpe_lexicon import op1_bpe_lexicon
from ticketlake.llm.decontaminate import op5_decontaminate
from ticketlake.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from ticketlake.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from ticketlake.llm.importance import op12_importance_draw
from ticketlake.llm.lm_score import op3_gru_score
from ticketlake.llm.quality import op6_quality_ftrl
from ticketlake.llm.secret_scan import op4_secret_novelty
from ticketlake.llm.simhash import op8_simhash_trie
from ticketlake.llm.suffix_dedup import op10_suffix_repeats
from ticketlake.llm.token_counts import op7_prefix_counts
from ticketlake.llm.toxicity import op9_toxicity_chain
from ticketlake.llm.warc import OP11_SQL, op11_warc_addressed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_lexicon": op1_bpe_lexicon,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_gru_score": op3_gru_score,
    "op4_secret_novelty": op4_secret_novelty,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_ftrl": op6_quality_ftrl,
    "op7_prefix_counts": op7_prefix_counts,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_warc_addressed": op11_warc_addressed,
    "op12_importance_draw": op12_importance_draw,
    "op13_hard_negatives": op13_hard_negatives,
}

QUERY_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op11_warc_addressed": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
