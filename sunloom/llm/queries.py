"""The queries of this subpackage and their SQL."""

from . import alignment, bpe, chat, decontaminate, licenses, line_dup, near_dup, neighbours, spelling, suffixes, token_counts, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat": chat.op2_chat,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_bpe": bpe.op5_bpe,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_lines": line_dup.op8_lines,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_licenses": licenses.op10_licenses,
    "op11_spelling": spelling.op11_spelling,
    "op12_token_files": token_files.op12_token_files,
    "op13_alignment": alignment.op13_alignment,
}
SQL = {"op2_chat": chat.OP2_SQL, "op8_lines": line_dup.OP8_SQL, "op4_suffixes": suffixes.OP4_SQL, "op6_neighbours": neighbours.OP6_SQL, "op10_licenses": licenses.OP10_SQL, "op7_near_duplicates": near_dup.OP7_SQL, "op9_decontamination": decontaminate.OP9_SQL, "op11_spelling": spelling.OP11_SQL}
