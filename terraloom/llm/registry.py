"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm.decontaminate import OP8_SQL, op8_decontamination
from terraloom.llm.huffman import op6_huffman_tokens
from terraloom.llm.lines import OP5_SQL, op5_line_dedup
from terraloom.llm.neighbours import op1_ivf_pq
from terraloom.llm.packing import op9_packing
from terraloom.llm.pii import op10_personal_data
from terraloom.llm.secret_scan import op3_secret_scan
from terraloom.llm.shards import op2_sharding
from terraloom.llm.simhash import op4_simhash
from terraloom.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ivf_pq, op2_sharding, op3_secret_scan, op4_simhash, op5_line_dedup, op6_huffman_tokens, op7_toxicity, op8_decontamination, op9_packing, op10_personal_data)
}
SQL = {"op5_line_dedup": OP5_SQL, "op8_decontamination": OP8_SQL}
