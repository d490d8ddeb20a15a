"""The queries over the document tables: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from ._util import table
from .chat_quotes import link_quotes
from .context_mixing import lm_scores
from .jpeg_media import media_features, to_media
from .line_dedup import line_dedup
from .mixing import mix
from .quality_gbt import quality_rules
from .sentencepiece_scan import encode
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .url_reputation import url_filter

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Stand-in for a domain column, which the table lacks: by the last digit of the source's number.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}


def domain_of(source: str = "source"):
    digit = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9])$", 1)
    return F.when(digit.isin("0", "1", "2", "3"), "web").when(digit.isin("4", "5", "6"), "books").when(digit.isin("7", "8", "9"), "code").otherwise("other")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), 35, with_text=False)


def quoting(messages: DataFrame) -> DataFrame:
    """Every message, with quotes put before its text as mail programs do, since the generated conversations hold none.  By (7 * conv_id
    + turn) modulo 4: 0 quotes nothing; 1 the message before, its lines in capitals (A-Z); 2 the message before, wrapped anew, a
    word a line; 3 the message two turns before at level two, and the one before at level one.  What is missing or
    empty is not quoted.  Of rows alike in conv_id and turn the least text is quoted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    said = messages.where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def back(k: int) -> DataFrame:
        return said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"back{k}"))

    def quote(text: F.Column, sign: str) -> F.Column:
        return F.concat(F.lit(sign), F.replace(text, F.lit("\n"), F.lit(f"\n{sign}")))

    both = messages.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    rule = F.pmod(7 * F.col("conv_id") + F.col("turn"), F.lit(4))
    one, two = F.when(F.col("back1") != "", F.col("back1")), F.when(F.col("back2") != "", F.col("back2"))
    quoted = F.when(rule == 1, quote(F.translate(one, lower, upper), "> ")).when(rule == 2, quote(F.replace(one, F.lit(" "), F.lit("\n")), "> ")).when(rule == 3, F.concat(F.coalesce(F.concat(quote(two, "> > "), F.lit("\n")), F.lit("")), quote(one, "> ")))
    return both.select("conv_id", "turn", "role", F.coalesce(F.concat(quoted, F.lit("\n\n"), F.coalesce("text", F.lit(""))), "text").alias("text"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotes(quoting(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return out.select("conv_id", "turn", "role", "parent_turn", "thread_root", F.col("depth").cast("long").alias("depth"), F.col("n_quotes").cast("long").alias("n_quotes"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the label with its number: bad if its quality is 0 or it is toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES).drop("bad_bound")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of())
    return mix(docs, MIX_LEVELS, MIX_WEIGHTS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), online=True)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = to_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media_features(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumb_xxh64", "average_hash")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1, "op2_chat_quotes": op2, "op3_sentencepiece": op3, "op4_url_filter": op4, "op5_simhash": op5, "op6_mixing": op6,
    "op7_lm_scoring": op7, "op8_media": op8, "op9_quality_rules": op9, "op10_line_dedup": op10, "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op2_chat_quotes": sql.CHAT_QUOTES, "op4_url_filter": sql.URL_FILTER, "op6_mixing": sql.MIXING, "op10_line_dedup": sql.LINE_DEDUP}
