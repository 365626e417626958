"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from wayfold.llm import conversations, topk, warc
from wayfold.llm.alignment import op13_alignment
from wayfold.llm.fingerprint import op7_fingerprint
from wayfold.llm.html import op1_html
from wayfold.llm.langid import op10_langid
from wayfold.llm.lm import op8_lm
from wayfold.llm.mixing import op2_mixing
from wayfold.llm.packing import op4_packing
from wayfold.llm.pii import op6_pii
from wayfold.llm.simhash import op5_simhash
from wayfold.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_html": op1_html,
    "op2_mixing": op2_mixing,
    "op3_topk": topk.op3_topk,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_fingerprint": op7_fingerprint,
    "op8_lm": op8_lm,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
    "op11_warc": warc.op11_warc,
    "op12_conversations": conversations.op12_conversations,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op3_topk": topk.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op12_conversations": conversations.ORACLE_SQL}
