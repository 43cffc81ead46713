"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import alignment, chat, decontam, language, licenses, lines, mixing, periodic, pieces, simhash, substrings, toxicity, vectors

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_embeddings": vectors.op2_embeddings,
    "op3_chat": chat.op3_chat,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lines": lines.op6_lines,
    "op7_mixing": mixing.op7_mixing,
    "op8_substrings": substrings.op8_substrings,
    "op9_language": language.op9_language,
    "op10_licenses": licenses.op10_licenses,
    "op11_runs": periodic.op11_runs,
    "op12_pieces": pieces.op12_pieces,
    "op13_alignment": alignment.op13_alignment,
}
ORACLE_SQL = {"op3_chat": chat.SQL, "op4_decontamination": decontam.SQL, "op6_lines": lines.SQL, "op8_substrings": substrings.SQL, "op10_licenses": licenses.SQL}
