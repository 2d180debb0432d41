"""Queries of this package and their SQL, for the entry points."""

from __future__ import annotations

from spendlake.llm.audit import op11_persistent_audit
from spendlake.llm.bpe import op6_bpe_batched
from spendlake.llm.covertree import op9_covertree_embeddings
from spendlake.llm.exact import OP3_SQL, op3_grace_exact
from spendlake.llm.langid import op1_bloom_language
from spendlake.llm.lexical import OP12_SQL, op12_stratified_search
from spendlake.llm.lattice import op4_lattice_likelihood
from spendlake.llm.mixing import op5_flow_mixing
from spendlake.llm.sharding import op10_flow_resharding
from spendlake.llm.simhash import op8_popcount_simhash
from spendlake.llm.suffixes import op7_refined_suffixes
from spendlake.llm.superkmers import op2_superkmer_substrings
from spendlake.llm.toxicity import op13_levenshtein_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_bloom_language,
        op2_superkmer_substrings,
        op3_grace_exact,
        op4_lattice_likelihood,
        op5_flow_mixing,
        op6_bpe_batched,
        op7_refined_suffixes,
        op8_popcount_simhash,
        op9_covertree_embeddings,
        op10_flow_resharding,
        op11_persistent_audit,
        op12_stratified_search,
        op13_levenshtein_toxicity,
    )
}
ORACLES = {"op3_grace_exact": OP3_SQL, "op12_stratified_search": OP12_SQL}
