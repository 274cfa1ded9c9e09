"""The corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from lumenloom.llm import oracles as o
from lumenloom.llm import queries as q

QUERIES = {
    "op1_minhash": q.op1_minhash,
    "op2_vp_trees": q.op2_vp_trees,
    "op3_quality": q.op3_quality,
    "op4_token_files": q.op4_token_files,
    "op5_pii": q.op5_pii,
    "op6_toxicity": q.op6_toxicity,
    "op7_packing": q.op7_packing,
    "op8_byte_bpe": q.op8_byte_bpe,
    "op9_warc": q.op9_warc,
    "op10_url_filters": q.op10_url_filters,
    "op11_runs": q.op11_runs,
    "op12_set_join": q.op12_set_join,
    "op13_whitening": q.op13_whitening,
}
ORACLES: dict[str, str] = {"op1_minhash": o.OP1, "op10_url_filters": o.OP10, "op12_set_join": o.OP12}
