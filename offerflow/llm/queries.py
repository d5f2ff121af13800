"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, divergence, prefixtrie, warc
from .common import read_table
from .hyperminhash import near_duplicates
from .jpeg import jpeg_media
from .langid import identify_languages
from .packing import pack
from .ppm import lm_scores
from .rans import token_digests
from .tokencount import count_tokens
from .tokens import vocabulary_path
from .toxicity import toxicity


def op1_jpeg_media(spark, sf_dir):
    return jpeg_media(read_table(spark, sf_dir, "documents"))


def op2_rans_tokens(spark, sf_dir):
    return token_digests(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=2)


def op3_hyperminhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_minhash_containment(spark, sf_dir):
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op6_mixture_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=1)


def op7_toxicity(spark, sf_dir):
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_perspectives(spark, sf_dir):
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op9_warc_chunks(spark, sf_dir):
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op10_ppm_scores(spark, sf_dir):
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefixtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_hyperdimensional_language(spark, sf_dir):
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark, sf_dir):
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jpeg_media, op2_rans_tokens, op3_hyperminhash, op4_minhash_containment, op5_token_counts, op6_mixture_packing, op7_toxicity, op8_perspectives, op9_warc_chunks, op10_ppm_scores, op11_prefix_trie, op12_hyperdimensional_language, op13_source_divergence)}
ORACLE_SQL: dict[str, str] = {"op4_minhash_containment": decontaminate.ORACLE, "op8_perspectives": chat.ORACLE, "op9_warc_chunks": warc.ORACLE, "op11_prefix_trie": prefixtrie.ORACLE, "op13_source_divergence": divergence.ORACLE}
