"""The queries of this package, by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from .ann import op3_nearest_neighbours
from .divergence import OP13_SQL, op13_divergence_audit
from .fingerprints import op2_document_fingerprints
from .html_extract import op4_html_extraction
from .licenses import op9_license_scan
from .lm import op10_stupid_backoff
from .mixing import OP8_SQL, op8_curriculum_mixing
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op7_best_fit_packing
from .pii import op6_personal_data
from .simhash import op5_simhash_components
from .substrings import OP11_SQL, op11_substring_dedup
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_document_fingerprints, op3_nearest_neighbours, op4_html_extraction, op5_simhash_components, op6_personal_data, op7_best_fit_packing, op8_curriculum_mixing, op9_license_scan, op10_stupid_backoff, op11_substring_dedup, op12_hard_negatives, op13_divergence_audit)}
ORACLES = {"op8_curriculum_mixing": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_divergence_audit": OP13_SQL}
