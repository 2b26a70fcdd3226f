"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm.bpe import op6_bpe
from weft.llm.collocations import OP11_SQL, op11_collocations
from weft.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from weft.llm.fingerprint import op10_fingerprint
from weft.llm.html_text import op4_html_text
from weft.llm.jaccard_join import op5_jaccard_join
from weft.llm.langid import op7_langid
from weft.llm.licences import op8_licences
from weft.llm.mixing import OP9_SQL, op9_mixing
from weft.llm.piece_bpe import op12_piece_bpe
from weft.llm.substring_dedup import op2_substring_dedup
from weft.llm.suffix_dedup import op1_suffix_dedup
from weft.llm.timestamps import OP13_SQL, op13_timestamps

_QUERIES = (op1_suffix_dedup, op2_substring_dedup, op3_exact_dedup, op4_html_text, op5_jaccard_join, op6_bpe, op7_langid, op8_licences, op9_mixing, op10_fingerprint, op11_collocations, op12_piece_bpe, op13_timestamps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op9_mixing": OP9_SQL, "op11_collocations": OP11_SQL, "op13_timestamps": OP13_SQL}
