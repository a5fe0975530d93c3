"""The subpackage's queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, gif, langid, licenses, lines, mixing, pii, simhash, suffix_dedup


def queries() -> dict:
    found = [
        suffix_dedup.op1_suffix_dedup,
        chat.op2_chat_format,
        simhash.op3_simhash,
        mixing.op4_mix_sources,
        decontaminate.op5_decontaminate,
        lines.op6_line_dedup,
        licenses.op7_license_scan,
        gif.op8_gif_media,
        pii.op9_pii,
        langid.op10_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.SQL, "op5_decontaminate": decontaminate.SQL, "op6_line_dedup": lines.SQL}
