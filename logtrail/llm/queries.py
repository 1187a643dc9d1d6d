"""The registered queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from logtrail.llm.decontaminate import op2_decontaminate
from logtrail.llm import chat_format, line_dedup, oracles
from logtrail.llm.chat_format import op11_chat_format
from logtrail.llm.fill_middle import op13_fill_middle
from logtrail.llm.jaccard import op1_jaccard_join
from logtrail.llm.line_dedup import op8_line_dedup
from logtrail.llm.packing import op4_packing
from logtrail.llm.quality import op6_quality
from logtrail.llm.secret_scan import op3_secret_scan
from logtrail.llm.suffix_array import op5_suffix_array
from logtrail.llm.suffix_tree import op7_suffix_tree
from logtrail.llm.token_align import op12_token_align
from logtrail.llm.toxicity import op9_toxicity
from logtrail.llm.warc import op10_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op5_suffix_array": op5_suffix_array,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op4_packing": op4_packing,
    "op6_quality": op6_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op10_warc": op10_warc,
    "op11_chat_format": op11_chat_format,
    "op12_token_align": op12_token_align,
    "op13_fill_middle": op13_fill_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op5_suffix_array": oracles.SUFFIX_ARRAY,
    "op7_suffix_tree": oracles.SUFFIX_TREE,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op10_warc": oracles.WARC,
    "op11_chat_format": chat_format.ORACLE_SQL,
    "op13_fill_middle": oracles.FILL_MIDDLE,
}
