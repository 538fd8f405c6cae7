"""Queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from bundlewise.llm import byte_bpe as op10
from bundlewise.llm import byte_dedup as op9
from bundlewise.llm import decontaminate as op8
from bundlewise.llm import langid as op13
from bundlewise.llm import lexical as op11
from bundlewise.llm import ngram_join as op3
from bundlewise.llm import pages as op4
from bundlewise.llm import paragraphs as op1
from bundlewise.llm import toxicity as op5
from bundlewise.llm import revisits as op2
from bundlewise.llm import sharding as op7
from bundlewise.llm import quality as op6
from bundlewise.llm import whitening as op12

QUERIES = {
    "op2_warc_revisits": op2.op2_warc_revisits,
    "op9_suffix_array_dedup": op9.op9_suffix_array_dedup,
    "op1_substring_dedup": op1.op1_substring_dedup,
    "op3_ngram_join": op3.op3_ngram_join,
    "op7_hilbert_sharding": op7.op7_hilbert_sharding,
    "op6_quality_rules": op6.op6_quality_rules,
    "op5_toxicity": op5.op5_toxicity,
    "op4_html_extraction": op4.op4_html_extraction,
    "op8_decontamination": op8.op8_decontamination,
    "op10_byte_bpe": op10.op10_byte_bpe,
    "op11_lexical_search": op11.op11_lexical_search,
    "op12_embedding_whitening": op12.op12_embedding_whitening,
    "op13_language_id": op13.op13_language_id,
}
ORACLES = {
    "op2_warc_revisits": op2.OP2_SQL,
    "op3_ngram_join": op3.OP3_SQL,
    "op8_decontamination": op8.OP8_SQL,
    "op11_lexical_search": op11.OP11_SQL,
}
