"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from .chunk_dedup import op5_chunk_dedup
from .decontamination import op1_decontamination
from .exact_topk import OP6_SQL, op6_exact_topk
from .language_id import language_id_pages, op8_language_id
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import op10_near_dedup
from .secret_scan import op2_secret_scan
from .token_binary import op4_token_binary
from .tool_chat import op3_tool_chat
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_tool_chat": op3_tool_chat,
    "op4_token_binary": op4_token_binary,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_near_dedup": op10_near_dedup,
    "language_id_pages": language_id_pages,
}

ORACLE_SQL = {
    "op6_exact_topk": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op9_url_filter": OP9_SQL,
}
