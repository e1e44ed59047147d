"""The corpus operators as queries, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import chat, decontaminate, html_text, lang_id, lexical, mixing, neardup, oracles, quality, sharding, substring, suffix, token_align, warc


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.expand(chat.with_probe(table(spark, sf_dir, "conversations"))))


#: Token shares that op5's mixture is to have.
MIX_WEIGHTS = {"clean": 0.9, "junk": 0.07, "toxic": 0.03}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_WEIGHTS)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), 85)


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Vocabulary files of the two tokenizers that op12 compares.
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), token_align.Files.read(*TOKENIZERS))


def op13_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_substring": op2_substring,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_neardup": op9_neardup,
    "op10_suffix": op10_suffix,
    "op11_lexical": op11_lexical,
    "op12_token_align": op12_token_align,
    "op13_lang_id": op13_lang_id,
}
#: Models, hashes of Spark's own and the cutting of pages can't be stated in SQL; tests/llm has plain versions of those operators.
_ORACLE: dict[str, str] = {
    "op2_substring": oracles.SUBSTRING,
    "op4_chat": oracles.CHAT,
    "op7_sharding": oracles.SHARDS,
    "op8_warc": oracles.WARC,
    "op9_neardup": oracles.NEAR,
    "op10_suffix": oracles.SUFFIX,
    "op11_lexical": oracles.LEXICAL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
