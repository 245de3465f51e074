"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from llm import oracles
from llm.ann import op4_multi_index
from llm.bpe import op6_bpe
from llm.decontaminate import op8_decontaminate
from llm.jaccard import op1_ngram_jaccard
from llm.lines import op3_line_dedup
from llm.pitman_yor import op5_pitman_yor
from llm.quality import op9_quality
from llm.substrings import op2_suffix_dedup
from llm.toxicity import op10_toxicity
from llm.warc import op7_warc

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_multi_index": op4_multi_index,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

ORACLE = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op7_warc": oracles.WARC,
    "op8_decontaminate": oracles.DECONTAMINATE,
}
