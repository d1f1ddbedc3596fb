"""Registered queries of the training-data operators, and their SQL oracles."""

from __future__ import annotations

from loomwork.llm.embedding_dedup import op10_embedding_dedup
from loomwork.llm.language_crf import op2_language_crf
from loomwork.llm.mixing import op4_pfair_mix
from loomwork.llm.nn_descent import op9_nn_descent
from loomwork.llm.quality_bayes import op8_quality_bayes
from loomwork.llm.secrets import op6_secret_scan
from loomwork.llm.sentencepiece_trie import op7_sentencepiece
from loomwork.llm.sharding import op3_shard_label_propagation
from loomwork.llm.simhash import op1_simhash_near_dedup
from loomwork.llm.warc import OP5_SQL, op5_warc_zip

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_crf": op2_language_crf,
    "op3_shard_label_propagation": op3_shard_label_propagation,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_warc_zip": op5_warc_zip,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_bayes": op8_quality_bayes,
    "op9_nn_descent": op9_nn_descent,
    "op10_embedding_dedup": op10_embedding_dedup,
}
# the other operators are iterative, learned or stateful; tests hold them against brute force
ORACLES = {"op5_warc_zip": OP5_SQL}
