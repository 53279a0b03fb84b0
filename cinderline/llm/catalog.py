"""The registered queries of this subpackage and their comparison SQL."""

from cinderline.llm import licenses, lines, mixing, negatives, packing, quality, repeats, secrets, simhash, toxicity, tries, urls, vectors

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_repeats": repeats.op2_repeats,
    "op3_url_filters": urls.op3_url_filters,
    "op4_near_vectors": vectors.op4_near_vectors,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversation_trie": tries.op11_conversation_trie,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
#: The other operators are not expressible in SQL on whole tables; tests hold them against brute force.
ORACLES = {"op3_url_filters": urls.SQL}
