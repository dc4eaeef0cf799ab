"""Operators for preparing training text: one module per operator, its query ``opN_<name>`` and its SQL beside it."""


def catalogue():
    """({name: query}, {name: SQL}) of this subpackage."""
    from . import context_mixing, decontaminate, language, line_dedup, main_text, mix, quality, quality_gam, ranked_search, sentence_spans, simhash, spelling, tokens

    parts = [decontaminate, mix, line_dedup, language, context_mixing, main_text, tokens, simhash, sentence_spans, quality, quality_gam, spelling, ranked_search]
    queries = {k: v for m in parts for k, v in m.QUERIES.items()}
    return queries, {k: v for m in parts for k, v in m.ORACLES.items()}
