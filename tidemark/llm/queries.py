"""Queries of the corpus operators and their DuckDB counterparts, by name."""

from .chat import op13_event_sourced_chat
from .collocations import OP12_SQL, op12_pivot_collocations
from .decontamination import OP8_SQL, op8_winnowing
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .orc_output import op9_orc_token_ids
from .packing import op4_vector_packing
from .pii import op5_semi_markov_pii
from .quality import op1_kneser_ney_quality
from .secrets import op10_guess_cost_secrets
from .sharding import op2_rendezvous_sharding
from .simhash import op7_simhash_anchors
from .urls import op6_association_rules
from .vector_codes import OP11_SQL, op11_hamerly_lloyd


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES = {
    "pipeline": pipeline,
    "op1_kneser_ney_quality": op1_kneser_ney_quality,
    "op2_rendezvous_sharding": op2_rendezvous_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_vector_packing": op4_vector_packing,
    "op5_semi_markov_pii": op5_semi_markov_pii,
    "op6_association_rules": op6_association_rules,
    "op7_simhash_anchors": op7_simhash_anchors,
    "op8_winnowing": op8_winnowing,
    "op9_orc_token_ids": op9_orc_token_ids,
    "op10_guess_cost_secrets": op10_guess_cost_secrets,
    "op11_hamerly_lloyd": op11_hamerly_lloyd,
    "op12_pivot_collocations": op12_pivot_collocations,
    "op13_event_sourced_chat": op13_event_sourced_chat,
}

LLM_ORACLES = {"op3_exact_dedup": OP3_SQL, "op8_winnowing": OP8_SQL, "op11_hamerly_lloyd": OP11_SQL, "op12_pivot_collocations": OP12_SQL}
