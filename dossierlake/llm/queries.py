"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""
from __future__ import annotations

from . import bpe, chat, decontaminate, htmltext, langid, linededup, nndescent, secretscan, simhash, urlfilter

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.query,
    "op2_byte_bpe": bpe.query,
    "op3_embedding_near_dedup": nndescent.query,
    "op4_html_extraction": htmltext.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_language_id": langid.query,
    "op7_chat_formatting": chat.query,
    "op8_secret_scan": secretscan.query,
    "op9_url_filter": urlfilter.query,
    "op10_line_dedup": linededup.query,
}

ORACLES = {
    "op7_chat_formatting": chat.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
}
