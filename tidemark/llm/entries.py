"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.chat import op3_chat_format
from tidemark.llm.decontaminate import op6_decontaminate
from tidemark.llm.embed_join import op9_embedding_join
from tidemark.llm.html_extract import op4_html_extract
from tidemark.llm.langid import op1_language_id
from tidemark.llm.mixing import op7_mix
from tidemark.llm.simhash import op5_simhash
from tidemark.llm.suffix_dedup import op10_suffix_dedup
from tidemark.llm.warc import OP2_SQL, op2_warc_revisits
from tidemark.llm.weaklabel import op8_quality

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_chat_format": op3_chat_format,
    "op4_html_extract": op4_html_extract,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_mix": op7_mix,
    "op8_quality": op8_quality,
    "op9_embedding_join": op9_embedding_join,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL = {"op2_warc_revisits": OP2_SQL}
