"""Queries of the training-text operators, one group per problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafstack.llm import dedup, encoding, knn, mixing, packing, scan_repair, split, toxicity, truncation
from leafstack.session import read_table as read


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the splitter cuts."""
    pieces = split.split_texts(read(spark, root, "parsed_documents"), read(spark, root, "summarization_config"))
    return pieces.where("n_pieces > 1").select("doc_id").distinct()


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every parsed document."""
    return split.split_texts(read(spark, root, "parsed_documents"), read(spark, root, "summarization_config"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of incoming with the rows of history and incoming that they repeat."""
    return dedup.repeated_rows(read(spark, root, "history"), read(spark, root, "incoming"))


def p2_batches(spark: SparkSession, root: str) -> DataFrame:
    """The same pairs, found batch after batch on a growing index."""
    return dedup.check_batches(read(spark, root, "history"), read(spark, root, "incoming"))


def p2_links(spark: SparkSession, root: str) -> DataFrame:
    """Every incoming row with the first row that holds the same document and its number of links."""
    return dedup.link_counts(p2_found(spark, root), read(spark, root, "incoming"))


def p3_pages(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk with its traces of scanning and its repaired text."""
    return scan_repair.repair_pages(read(spark, root, "chunks"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks with traces of scanning."""
    return p3_pages(spark, root).where("noisy").select("doc_id", "chunk_index").distinct()


def p4_records(spark: SparkSession, root: str) -> DataFrame:
    """Every result with the evidence that its summary was cut off."""
    return truncation.find_truncated(read(spark, root, "pipeline_results"), settings=read(spark, root, "summarization_config"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Results whose summary breaks off."""
    return p4_records(spark, root).where("truncated").select("result_id").distinct()


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rate of cut summaries per summary method."""
    return truncation.truncation_rates(p4_records(spark, root))


def p5_records(spark: SparkSession, root: str) -> DataFrame:
    """Every parsed document with its restored text."""
    return encoding.repair_encoding(read(spark, root, "parsed_documents"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a stretch from a wrong decoding."""
    return p5_records(spark, root).where("garbled").select("doc_id").distinct()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of passages with a cosine of 0.90 or more, one among the other's 10 most similar."""
    return knn.similar_pairs(p6_neighbours(spark, root), 0.9)


def p6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 10 most similar other passages of every passage."""
    return knn.most_similar(knn.decode_passages(read(spark, root, "history")), 10)


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """All documents in containers, for each setting."""
    return packing.pack_lengths(packing.token_lengths(read(spark, root, "documents")), read(spark, root, "pack_settings"))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_report(p7_containers(spark, root))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The training order of documents under the target shares."""
    lengths = packing.token_lengths(read(spark, root, "documents"), "doc_id", "text", packing.DEFAULT_VOCABULARY, "source")
    return mixing.mix_sources(lengths, read(spark, root, "mix_targets"))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    lengths = packing.token_lengths(read(spark, root, "documents"), "doc_id", "text", packing.DEFAULT_VOCABULARY, "source")
    targets = read(spark, root, "mix_targets")
    return mixing.mix_report(mixing.mix_sources(lengths, targets), lengths, targets)


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its scores."""
    return toxicity.score_documents(read(spark, root, "documents"), read(spark, root, "review_labels"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return p9_scores(spark, root).where("flagged").select("doc_id").distinct()


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rate of such documents per source."""
    return toxicity.rates(p9_scores(spark, root))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT doc_id FROM parsed_documents JOIN summarization_config USING (file_type) WHERE length(full_text) > chunk_size",
    }
