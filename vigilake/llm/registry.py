"""The queries of this package: name to (query, SQL counterpart or None)."""

from vigilake.llm.chat_format import ROTATE_SQL, op6_chat_format
from vigilake.llm.collocations import COLLOCATIONS_SQL, op11_collocations
from vigilake.llm.decontamination import op7_decontamination
from vigilake.llm.licence_scan import op5_licence_scan
from vigilake.llm.mixing import MIXING_SQL, op2_mixing
from vigilake.llm.near_dedup import op10_near_dedup
from vigilake.llm.quality_classifier import op12_quality_classifier
from vigilake.llm.quality_rules import op8_quality_rules
from vigilake.llm.secret_scan import op3_secret_scan
from vigilake.llm.spelling_variants import op13_spelling_variants
from vigilake.llm.suffix_dedup import op1_suffix_dedup
from vigilake.llm.token_files import op9_token_files
from vigilake.llm.toxicity import op4_toxicity

REGISTRY = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_mixing": (op2_mixing, MIXING_SQL),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_licence_scan": (op5_licence_scan, None),
    "op6_chat_format": (op6_chat_format, ROTATE_SQL),
    "op7_decontamination": (op7_decontamination, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_token_files": (op9_token_files, None),
    "op10_near_dedup": (op10_near_dedup, None),
    "op11_collocations": (op11_collocations, COLLOCATIONS_SQL),
    "op12_quality_classifier": (op12_quality_classifier, None),
    "op13_spelling_variants": (op13_spelling_variants, None),
}
