"""The registered queries of the training-data operators, and their SQL where there is any."""

from lakeloom.llm import decontaminate, fingerprints, katz, langid, neardup, packing, passages, pii, quality, sharding


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_neardup": neardup.query,
        "op3_pii": pii.query,
        "op4_language_id": langid.query,
        "op5_decontamination": decontaminate.query,
        "op6_katz": katz.query,
        "op7_sharding": sharding.query,
        "op8_passages": passages.query,
        "op9_quality": quality.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict:
    return {"op2_neardup": neardup.ORACLE_SQL, "op5_decontamination": decontaminate.ORACLE_SQL}
