"""The queries that apply each operator to its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op11_align
from .bpe import op2_bpe
from .chat import OP3_SQL, op3_chat
from .copies import OP6_SQL, op6_copies
from .leaks import OP8_SQL, op8_leaks
from .licences import op10_licences
from .pages import op7_pages
from .privacy import op5_private
from .search import OP13_SQL, op13_search
from .sentence import op12_sentence
from .shards import op9_shards
from .topk import OP4_SQL, op4_topk
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_chat": op3_chat,
    "op4_topk": op4_topk,
    "op5_private": op5_private,
    "op6_copies": op6_copies,
    "op7_pages": op7_pages,
    "op8_leaks": op8_leaks,
    "op9_shards": op9_shards,
    "op10_licences": op10_licences,
    "op11_align": op11_align,
    "op12_sentence": op12_sentence,
    "op13_search": op13_search,
}

ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op4_topk": OP4_SQL, "op6_copies": OP6_SQL, "op8_leaks": OP8_SQL, "op13_search": OP13_SQL}
