"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    classifier,
    conversations,
    decontam,
    line_dedup,
    lm,
    mixing,
    ngram_join,
    oracle,
    pii,
    quality_rules,
    secret_scan,
    spans,
    substring_dedup,
    url_filters,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the overlap."""
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    # How many seeds hit is a matter of the masks; the rest is the overlap's.
    return found.select("doc_id", "item_id", "matched_words", "item_words", "first_word", "overlap")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the divergence rules."""
    out = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(spans.of_kind(base, i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS[:4])),
        F.sha2(spans.joined(base, pii.KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log chances of every text under a pair model of the texts not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = lm.train(docs.where(~held_out))
    out = lm.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that is empty at first."""
    found = secret_scan.scan_and_report(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < secret_scan.BASE)
    return found.select(
        "doc_id",
        *(spans.of_kind(base, i).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.KINDS[: secret_scan.BASE])),
        F.sha2(spans.joined(base, secret_scan.KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("found"), secret_scan.KINDS).alias("spans"),
    )


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document; labels of held-out rows are never read
    into the fit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = labels.where(~held_out)
    model = classifier.train(docs, labels)
    return classifier.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that every document loses to earlier ones."""
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard
    similarity of 0.9 or more."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % takes from every document."""
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def _draw(x, start: int):
    """A number from 0 to 4095 from three digits of a digest."""
    return F.conv(F.substring(F.md5(x.cast("binary")), start, 3), 16, 10).cast("int")


def filter_list(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' hosts and their parent domains, which the tables
    lack: two fifths of the names are listed, some leave it, some come back."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(url_filters.domains_of(F.col("host"))).alias("host")).distinct()
    n = F.col("host")
    listed = names.where(_draw(n, 1) % 5 < 2).select(
        F.when(_draw(n, 4) % 2 == 0, "ads").otherwise("malware").alias("list"),
        "host",
        (_draw(n, 7) % 200).alias("day"),
        (_draw(n, 10) % 100 + 1).alias("stays"),
        (_draw(n, 13) % 4).alias("kind"),
    )
    start = F.lit("2024-01-01").cast("date")
    entry = [F.struct(F.lit("add").alias("action"), F.date_add(start, F.col("day")).alias("date"))]
    entry.append(F.struct(F.lit("remove").alias("action"), F.date_add(start, F.col("day") + F.col("stays")).alias("date")))
    entry.append(F.struct(F.lit("add").alias("action"), F.date_add(start, F.col("day") + 2 * F.col("stays")).alias("date")))
    # Kind 0 stays for good, 1 and 2 leave, 3 leaves and comes back.
    own = F.when(F.col("kind") == 0, F.array(entry[0])).when(F.col("kind") < 3, F.array(*entry[:2])).otherwise(F.array(*entry))
    return listed.select("list", "host", F.explode(own).alias("e")).select("list", "host", "e.action", "e.date")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as of its fetch date against the dated list. The table has no
    dates: a page's is a day of 2024 by its id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return url_filters.match_captures(pages.withColumn("fetched", day), filter_list(pages))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by checksum and repaired at the least cost."""
    out = conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))
    lines = F.transform("repaired", lambda r: F.concat_ws(":", r["role"], r["text"]))
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the first 16 whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat twenty words found earlier, removed."""
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_quality_divergence": op2_quality_divergence,
        "op3_pii": op3_pii,
        "op4_kneser_ney": op4_kneser_ney,
        "op5_secrets": op5_secrets,
        "op6_nbsvm_quality": op6_nbsvm_quality,
        "op7_line_dedup": op7_line_dedup,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_mix_sources": op9_mix_sources,
        "op10_url_filters": op10_url_filters,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_whitening": op12_whitening,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
