"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import classifier, langid, linededup, mixing, quality, sentencepiece, simhash, tokencount, topk, urls

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mixing,
        urls.op2_url_filters,
        tokencount.op3_token_counts,
        topk.op4_exact_top_k,
        sentencepiece.op5_sentencepiece,
        langid.op6_language_id,
        quality.op7_quality_rules,
        linededup.op8_line_dedup,
        simhash.op9_simhash,
        classifier.op10_quality_classifier,
    )
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_url_filters": urls.OP2_SQL,
    "op4_exact_top_k": topk.OP4_SQL,
    "op6_language_id": langid.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_line_dedup": linededup.OP8_SQL,
    "op9_simhash": simhash.OP9_SQL,
}
