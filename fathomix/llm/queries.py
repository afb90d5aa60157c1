"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, html_diff, langid, licenses, manifest, packing, periodic_runs, slot_shards, token_store, url_filter, warc
from .common import new_folder, table
from .jaccard_join import JaccardJoin

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; the files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into a store, then read every document back through its index."""
    folder = new_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_store.read_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of all documents, of their edited texts, and likenesses."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other parameters."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out fifth."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, repeats resolved to revisit records, read back."""
    records = warc.deduplicate(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rules, else by the model."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.UrlModel.train())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 85 % of four-word shingles."""
    return JaccardJoin(4, 85, 100).join(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document and the licence that has it."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, by virtual slots, read back."""
    return slot_shards.digest(table(spark, sf_dir, "documents"), 16)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which is made periodic."""
    return periodic_runs.digest(periodic_runs.find(table(spark, sf_dir, "documents"), 12, plant=True))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, each document's proof, and whether it holds after tampering."""
    return manifest.verify(table(spark, sf_dir, "documents"), new_folder(spark, "manifest"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_fingerprints": op2_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_page_differencing": op7_page_differencing,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_scan": op10_license_scan,
    "op11_slot_shards": op11_slot_shards,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op8_url_filter": url_filter.oracle(url_filter.UrlModel.train()),
    "op10_license_scan": licenses.oracle(),
    "op13_merkle_manifest": manifest.oracle(),
}
