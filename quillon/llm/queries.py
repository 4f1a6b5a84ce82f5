"""The named queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from quillon.llm import oracles
from quillon.llm.decontamination import op1_decontamination
from quillon.llm.html_extraction import op10_html_extraction
from quillon.llm.language_id import op6_language_id
from quillon.llm.ngram_join import op5_ngram_join
from quillon.llm.quality_classifier import op8_quality_classifier
from quillon.llm.quality_rules import op7_quality_rules
from quillon.llm.sentencepiece_fst import op4_sentencepiece
from quillon.llm.token_counts import op3_token_counts
from quillon.llm.token_output import op2_token_output
from quillon.llm.url_filter import op9_url_filter


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_decontamination, op2_token_output, op3_token_counts, op4_sentencepiece, op5_ngram_join, op6_language_id, op7_quality_rules, op8_quality_classifier, op9_url_filter, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    """Of three; the others need a model, a vocabulary, an iteration or a parser, and are tested against brute force."""
    return dict(oracles.ALL)
