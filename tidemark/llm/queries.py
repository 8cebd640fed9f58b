"""Queries of the language-model training-data operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.llm import contamination, encoding, linkage, resolve, tokenize, variants
from tidemark.session import materialise
from tidemark.tables import table

TOKENIZERS = "/opt/tokenizers"


def vocabulary_path(name: str, folder: str = TOKENIZERS) -> str:
    """Where a public vocabulary file lies: in ``folder``, or where its package says."""
    if (found := Path(folder, name)).exists():
        return str(found)
    import public_tokenizers

    return public_tokenizers.path(name)


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(
        table(spark, d, "deal_party", "party_id", "name", "ticker", "underlying_symbol", "firm_id", "cik"),
        table(spark, d, "linkages", "source_gvkey", "source_name", "source_ticker", "source_firm_id"),
        table(spark, d, "gvkey_underlying_bridge", "gvkey", "firm_id", "cik"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each party's gvkeys."""
    return _linked(spark, d).select("party_id", "source_gvkey")


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Each party's gvkeys with the posterior of the match."""
    return _linked(spark, d)


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records of both tables (name_source, record_id, name, t, c) and the list (id, name, t)."""
    party = table(spark, d, "deal_party", "party_id", "name", "ticker", "cik")
    company = table(spark, d, "matched_company", "match_id", "matched_company_name", "matched_ticker", "cik")
    lookup = table(spark, d, "company_lookup", "cik", "name", "ticker")
    record = lambda df, source, key, name, t: df.select(F.lit(source).alias("name_source"), F.col(key).alias("record_id"), F.col(name).alias("name"), K.symbol(t).alias("t"), K.cik10("cik").alias("c"))
    records = record(party, "deal_party", "party_id", "name", "ticker").unionAll(record(company, "matched_company", "match_id", "matched_company_name", "matched_ticker"))
    return records, lookup.select(K.cik10("cik").alias("id"), "name", K.symbol("ticker").alias("t"))


def _meant(records: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``name_source, record_id, name, id``: records with whom they mean."""
    means = resolve.resolve(records, listed)
    same = [records[c].eqNullSafe(means[c]) for c in ("name", "t", "c")]
    return records.join(means.hint("merge"), same, how).select("name_source", "record_id", records["name"], "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of listed names that aren't the listed ones, with the number of whom they mean."""
    records, listed = _named(spark, d)
    letters = listed.select("id", F.col("name")).distinct()
    found = _meant(records, listed, "inner").join(letters.hint("merge"), ["id", "name"], "left_anti")
    return found.select("name_source", "record_id", F.col("id").alias("cik")).distinct()


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every named record with its entity: the number of whom it means, or of nobody listed the fullest of the spellings that are one."""
    records, listed = _named(spark, d)
    meant = materialise(_meant(records, listed, "left").where("name is not null and trim(name) <> ''"))
    merged = variants.merge_variants(meant.where("id is null"))
    got = meant.join(merged.hint("merge"), "name", "left")
    return got.select("name_source", "record_id", F.coalesce("id", "entity").alias("entity"), F.col("id").isNotNull().alias("is_listed")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_ids(table(spark, d, "documents", "doc_id", "text"), vocabulary_path("byte_bpe_50k.json"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of test items, with the items."""
    return contamination.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with garbled passages."""
    return encoding.repaired(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their restored texts and whether nothing stays lost."""
    return encoding.repaired(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_confidence, p4_found, p4_entities, p8_ids, p9_found, p10_found, p10_restored)}
SQL: dict[str, str] = {}
