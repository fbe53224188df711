"""The operators of this subpackage as registered queries, and their SQL twins."""

from __future__ import annotations

from ledgerloom.llm import (
    collocations,
    decontam,
    lexical,
    mixing,
    neardup,
    pii,
    pitmanyor,
    quality,
    secrets,
    sharding,
    substring,
    toxicity,
    urlrules,
)
from ledgerloom.llm.common import table


def _of_documents(digest):
    return lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))


def _toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _decontaminated(spark, sf_dir):
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.digest(documents, benchmark)


def _ranked(spark, sf_dir):
    return lexical.digest(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fm_substrings": _of_documents(substring.digest),
    "op2_gru_toxicity": _toxicity,
    "op3_seeded_alignment": _decontaminated,
    "op4_histogram_shards": _of_documents(sharding.digest),
    "op5_pitman_yor": _of_documents(pitmanyor.digest),
    "op6_quality_rules": _of_documents(quality.digest),
    "op7_secret_scan": _of_documents(secrets.digest),
    "op8_disclosure_sanitiser": _of_documents(pii.digest),
    "op9_dart_minhash": _of_documents(neardup.digest),
    "op10_source_mix": _of_documents(mixing.digest),
    "op11_term_pipeline": _ranked,
    "op12_url_rules": urlrules.digest,
    "op13_phrase_trie": _of_documents(collocations.digest),
}

ORACLES = {
    "op6_quality_rules": quality.oracle(),
    "op11_term_pipeline": lexical.oracle(),
    "op12_url_rules": urlrules.oracle(),
    "op13_phrase_trie": collocations.oracle(),
}
