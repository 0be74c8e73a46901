"""Queries of this package by name, with the SQL that gives the same rows."""

from . import hard_negatives, ngram_join, substring_dedup, url_filter, vector_codes
from .edit_fingerprint import op8_edit_fingerprint
from .hard_negatives import op11_hard_negatives
from .ngram_join import op10_ngram_join
from .nn_descent import op6_nn_descent
from .packing import op3_packing
from .quality import op9_quality
from .sentencepiece_codec import op2_sentencepiece
from .sharding import op5_sharding
from .substring_dedup import op7_substring_dedup
from .token_files import op13_token_files
from .toxicity import op1_toxicity
from .url_filter import op4_url_filter
from .vector_codes import op12_vector_codes

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_nn_descent": op6_nn_descent,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_edit_fingerprint": op8_edit_fingerprint,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}
ORACLE: dict[str, str] = {
    "op4_url_filter": url_filter.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
