"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from foliospark.llm.chat_format import OP1_SQL, op1_chat_format
from foliospark.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from foliospark.llm.fingerprints import op6_fingerprints
from foliospark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from foliospark.llm.language_id import op9_language_id
from foliospark.llm.ngram_join import OP8_SQL, op8_ngram_join
from foliospark.llm.packing import op10_packing
from foliospark.llm.recurrent_lm import op3_lm_scores
from foliospark.llm.sampled_pieces import op4_sampled_pieces
from foliospark.llm.secrets import op2_secret_scan
from foliospark.llm.simhash_join import op13_simhash
from foliospark.llm.spelling import op12_spelling
from foliospark.llm.url_filter import op7_url_filter

QUERIES = {"op11_hard_negatives": op11_hard_negatives, "op12_spelling": op12_spelling, "op13_simhash": op13_simhash, "op4_sampled_pieces": op4_sampled_pieces, "op3_lm_scores": op3_lm_scores, "op6_fingerprints": op6_fingerprints, "op8_ngram_join": op8_ngram_join, "op9_language_id": op9_language_id, "op10_packing": op10_packing, "op7_url_filter": op7_url_filter, "op1_chat_format": op1_chat_format, "op2_secret_scan": op2_secret_scan, "op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op11_hard_negatives": OP11_SQL, "op8_ngram_join": OP8_SQL, "op1_chat_format": OP1_SQL, "op5_exact_dedup": OP5_SQL}
