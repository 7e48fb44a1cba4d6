"""The subpackage's queries and SQL, added to the entry file where the subpackage is there."""

from __future__ import annotations

from graphloom.llm import alignment, blocks, decontaminate, fingerprints, jaccard, langid, middle, neighbours, packing, pages, pii, secrets, sql, substrings


def queries() -> dict:
    return {
        "op1_substring_dedup": substrings.query,
        "op2_fingerprints": fingerprints.query,
        "op3_jaccard_join": jaccard.query,
        "op4_language_id": langid.query,
        "op5_packing": packing.query,
        "op6_main_text": pages.query,
        "op7_token_blocks": blocks.query,
        "op8_personal_data": pii.query,
        "op9_secret_scan": secrets.query,
        "op10_decontaminate": decontaminate.query,
        "op11_token_alignment": alignment.query,
        "op12_nearest_vectors": neighbours.query,
        "op13_fill_in_middle": middle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": sql.SUBSTRINGS,
        "op9_secret_scan": sql.SECRETS,
        "op10_decontaminate": sql.DECONTAMINATE,
        "op13_fill_in_middle": sql.MIDDLE,
    }
