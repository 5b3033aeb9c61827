"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from .decontaminate import OP13_ORACLE, op13_benchmark_decontamination
from .langid import op10_language_id
from .linededup import op7_line_dedup
from .media import op4_media_columns
from .mixing import OP6_ORACLE, op6_mixing
from .oracles import OP2_ORACLE, OP8_ORACLE
from .packing import op5_packing
from .pii import op3_personal_data
from .quality import op8_quality_rules
from .resampling import OP11_ORACLE, op11_importance_resampling
from .simhash import op1_simhash_near_dedup
from .suffix import op2_suffix_dedup
from .turns import OP12_ORACLE, op12_conversation_repair
from .warc import OP9_ORACLE, op9_warc

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_media_columns": op4_media_columns,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": OP2_ORACLE,
    "op6_mixing": OP6_ORACLE,
    "op8_quality_rules": OP8_ORACLE,
    "op9_warc": OP9_ORACLE,
    "op11_importance_resampling": OP11_ORACLE,
    "op12_conversation_repair": OP12_ORACLE,
    "op13_benchmark_decontamination": OP13_ORACLE,
}
