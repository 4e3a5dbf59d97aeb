"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from . import decontamination, line_dedup, quality_rules
from .decontamination import op4_benchmark_decontamination
from .html_extraction import op5_html_extraction
from .line_dedup import op1_line_dedup
from .lm_scoring import op7_lm_scoring
from .ngram_join import op2_ngram_jaccard_join
from .piece_transducer import op10_sentencepiece
from .quality_rules import op6_quality_rules
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op8_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_ngram_jaccard_join, op3_toxicity, op4_benchmark_decontamination, op5_html_extraction, op6_quality_rules, op7_lm_scoring, op8_token_counts, op9_suffix_dedup, op10_sentencepiece)
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op4_benchmark_decontamination": decontamination.ORACLE, "op6_quality_rules": quality_rules.ORACLE}
