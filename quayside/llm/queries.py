"""The queries of this package and their SQL."""

from __future__ import annotations

from quayside.llm.divergence import OP13_SQL, op13_source_divergence
from quayside.llm.fm_index import OP10_SQL, op10_fm_decontamination
from quayside.llm.jaccard_join import OP6_SQL, op6_ngram_jaccard_join
from quayside.llm.langid import op7_language_families
from quayside.llm.licenses import op1_license_scan
from quayside.llm.media import op9_media_columns
from quayside.llm.packing import op3_ffd_packing
from quayside.llm.private import OP11_SQL, op11_contextual_pii
from quayside.llm.quality import op4_nbsvm_quality
from quayside.llm.sharding import op8_feistel_shards
from quayside.llm.spelling import OP12_SQL, op12_spelling_variants
from quayside.llm.tool_calls import OP5_SQL, op5_tool_call_links
from quayside.llm.warc import op2_arc_to_warc

QUERIES = {
    f.__name__: f
    for f in [
        op6_ngram_jaccard_join,
        op10_fm_decontamination,
        op3_ffd_packing,
        op4_nbsvm_quality,
        op7_language_families,
        op1_license_scan,
        op2_arc_to_warc,
        op5_tool_call_links,
        op8_feistel_shards,
        op9_media_columns,
        op11_contextual_pii,
        op12_spelling_variants,
        op13_source_divergence,
    ]
}
SQL = {
    "op5_tool_call_links": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op10_fm_decontamination": OP10_SQL,
    "op11_contextual_pii": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
