"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import collocations, decontaminate, html_extract, jaccard_join, language_id, license_scan, line_dedup, merkle, mixing, nn_descent, spelling, toxicity, warc_zip

QUERIES = {
    "op1_warc": warc_zip.op1_warc,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_language_id": language_id.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_nn_descent": nn_descent.op9_nn_descent,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_phrases": collocations.op11_phrases,
    "op12_fingerprints": merkle.op12_fingerprints,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_warc": warc_zip.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op9_nn_descent": nn_descent.ORACLE,
    "op11_phrases": collocations.ORACLE,
    "op12_fingerprints": merkle.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
