"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, mixing, negatives
from .chat import op5_chat_repair
from .codes import op13_vector_codes
from .decontaminate import op12_decontaminate
from .langid import op9_language_id
from .linededup import op6_line_dedup
from .lm import op7_lm_score
from .media import op3_media_columns
from .secrets import op1_secret_scan
from .mixing import op4_mix_sources
from .negatives import op11_hard_negatives
from .packing import op10_pack_sequences
from .simhash import op2_simhash
from .winnow import op8_winnow_fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash": op2_simhash,
    "op3_media_columns": op3_media_columns,
    "op4_mix_sources": op4_mix_sources,
    "op5_chat_repair": op5_chat_repair,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_winnow_fingerprints": op8_winnow_fingerprints,
    "op9_language_id": op9_language_id,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontaminate": op12_decontaminate,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": mixing.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_decontaminate": decontaminate.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
