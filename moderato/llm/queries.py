"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from moderato.llm.conversation_repair import op11_conversation_repair
from moderato.llm.conversation_sql import OP11_SQL
from moderato.llm.decontaminate import op3_benchmark_decontamination
from moderato.llm.divergence import OP12_SQL, op12_source_divergence
from moderato.llm.embedding_dedup import OP4_SQL, op4_embedding_near_dedup
from moderato.llm.hd_language import op2_hd_language_id
from moderato.llm.license_scan import op8_license_scan
from moderato.llm.ngram_join import op10_ngram_jaccard_join
from moderato.llm.packing import op9_best_fit_packing
from moderato.llm.pii import op5_personal_data
from moderato.llm.secret_scan import op13_secret_scan
from moderato.llm.substring_dedup import op6_substring_dedup
from moderato.llm.suffix_dedup import op1_suffix_array_dedup
from moderato.llm.warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_hd_language_id, op3_benchmark_decontamination, op4_embedding_near_dedup,
    op5_personal_data, op6_substring_dedup, op7_warc, op8_license_scan, op9_best_fit_packing, op10_ngram_jaccard_join,
    op11_conversation_repair, op12_source_divergence, op13_secret_scan,
)}

ORACLES = {"op4_embedding_near_dedup": OP4_SQL, "op7_warc": OP7_SQL, "op11_conversation_repair": OP11_SQL,
           "op12_source_divergence": OP12_SQL}
