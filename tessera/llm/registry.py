"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm import decontaminate, licenses, mixing, near_join, nearest, quality, secrets, sharding, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_near_join": near_join.op2_near_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_secrets": secrets.op5_secrets,
        "op6_licenses": licenses.op6_licenses,
        "op7_warc": warc.op7_warc,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_sharding": sharding.op9_sharding,
        "op10_nearest": nearest.op10_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_join": near_join.OP2_SQL, "op5_secrets": secrets.OP5_SQL, "op6_licenses": licenses.OP6_SQL, "op7_warc": warc.OP7_SQL, "op8_decontamination": decontaminate.OP8_SQL}
