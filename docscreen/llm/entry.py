"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from docscreen.llm.ann import op8_ann
from docscreen.llm.embedding_dedup import op6_embedding_dedup
from docscreen.llm.license_scan import op4_license_scan
from docscreen.llm.packing import op7_best_fit_packing
from docscreen.llm.sentencepiece import op1_sentencepiece
from docscreen.llm.simhash_dedup import op5_simhash_dedup
from docscreen.llm.substring_dedup import op3_substring_dedup
from docscreen.llm.token_counts import op2_token_counts
from docscreen.llm.toxicity import op10_toxicity
from docscreen.llm.url_filter import ORACLE_SQL as URL_SQL
from docscreen.llm.url_filter import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_token_counts, op3_substring_dedup, op4_license_scan, op5_simhash_dedup, op6_embedding_dedup, op7_best_fit_packing, op8_ann, op9_url_filter, op10_toxicity)
}
ORACLE_SQL = {"op9_url_filter": URL_SQL}
