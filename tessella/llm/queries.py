"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .jaccard_join import op4_jaccard_join
from .langid import op6_langid
from .licenses import OP10_SQL, op10_licenses
from .line_dedup import op8_line_dedup
from .ngram_lm import op2_ngram_lm
from .packing import op1_packing
from .quality_rules import op13_quality_rules
from .secrets import OP5_SQL, op5_secrets
from .topk import OP9_SQL, op9_topk

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_lm": op2_ngram_lm,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secrets": op5_secrets,
    "op6_langid": op6_langid,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_topk": op9_topk,
    "op10_licenses": op10_licenses,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_rules": op13_quality_rules,
}

SQL = {
    "op5_secrets": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_topk": OP9_SQL,
    "op10_licenses": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
