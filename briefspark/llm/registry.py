"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from briefspark.llm.bpe import op2_bpe
from briefspark.llm.credentials import op1_credentials
from briefspark.llm.matroska import op6_matroska
from briefspark.llm.ngram_lm import OP5_SQL, op5_lm_scores
from briefspark.llm.packing import op4_packing
from briefspark.llm.quality import op7_quality
from briefspark.llm.simhash import op10_simhash
from briefspark.llm.urlfilter import OP9_SQL, op9_url_filter
from briefspark.llm.warc import OP3_SQL, op3_warc
from briefspark.llm.wavelet import op8_wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_credentials": op1_credentials,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_packing": op4_packing,
        "op5_lm_scores": op5_lm_scores,
        "op6_matroska": op6_matroska,
        "op7_quality": op7_quality,
        "op8_wavelet": op8_wavelet,
        "op9_url_filter": op9_url_filter,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_scores": OP5_SQL, "op3_warc": OP3_SQL, "op9_url_filter": OP9_SQL}
