"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tagsmith.llm.decontamination import op1_template_decontamination
from tagsmith.llm.exact_dedup import OP5_SQL, op5_lsm_dedup
from tagsmith.llm.html_extract import op6_mincut_extraction
from tagsmith.llm.jaccard_join import op3_jaccard_join
from tagsmith.llm.licenses import op2_license_compression
from tagsmith.llm.packing import op8_pack_concat_cut
from tagsmith.llm.pii import op12_personal_data
from tagsmith.llm.secrets import op4_guess_cost_secrets
from tagsmith.llm.token_alignment import op13_token_alignment
from tagsmith.llm.toxicity import op10_compression_toxicity
from tagsmith.llm.url_filters import OP9_SQL, op9_temporal_url_filter
from tagsmith.llm.vector_codes import OP11_SQL, op11_yinyang_codes
from tagsmith.llm.warc import OP7_SQL, op7_seekable_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_template_decontamination,
        op2_license_compression,
        op3_jaccard_join,
        op4_guess_cost_secrets,
        op5_lsm_dedup,
        op6_mincut_extraction,
        op7_seekable_warc,
        op8_pack_concat_cut,
        op9_temporal_url_filter,
        op10_compression_toxicity,
        op11_yinyang_codes,
        op12_personal_data,
        op13_token_alignment,
    )
}

ORACLE_SQL = {"op5_lsm_dedup": OP5_SQL, "op7_seekable_warc": OP7_SQL, "op9_temporal_url_filter": OP9_SQL, "op11_yinyang_codes": OP11_SQL}
