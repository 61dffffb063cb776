"""Queries and DuckDB oracles of this subpackage."""

from plumbline.llm import exact_dedup, lm, mixing, near_dup, packing, quality, secrets, sharding, token_files, vectors

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_sharding": sharding.query,
    "op3_near_dup": near_dup.query,
    "op4_lm": lm.query,
    "op5_packing": packing.query,
    "op6_token_files": token_files.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_secrets": secrets.query,
    "op9_quality": quality.query,
    "op10_vectors": vectors.query,
}

ORACLE_SQL = {
    "op3_near_dup": near_dup.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_vectors": vectors.ORACLE_SQL,
}
