"""The queries of the training-data problems. ``__spark_entry__.py`` adds them if this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import canon
from tallyline.llm import confusables, leakage, mapping, mixing, names, quality, representative


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    matchers = {
        "bank_name": mapping.bank_matcher(_table(spark, sf_dir, "bank_ref")),
        "transaction_type": mapping.type_matcher(_table(spark, sf_dir, "type_ref")),
    }
    return mapping.map_to_canonical(_table(spark, sf_dir, "bank_transactions"), "tx_id", matchers)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("tx_id", "field_name", "ref_id").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapping_report(_mapped(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.normalise_lookalikes(_table(spark, sf_dir, "bank_transactions"), "tx_id").select("tx_id", "field_name").distinct()


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.normalise_lookalikes(_table(spark, sf_dir, "bank_transactions"), "tx_id")


def _survived(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    # equal trust is settled by the record, as in the SQL
    order = representative.trust_order("review_status", "extraction_confidence", "extracted_at").withField("record", F.col("obs_id"))
    return representative.surviving_values(_table(spark, sf_dir, "observations"), "event_id", "obs_id", order, **options)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survived(spark, sf_dir, torn_only=True).select(F.col("grp").alias("event_id"), "field_name", F.col("record").alias("obs_id"))


def p2_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields decided by the records' votes alone."""
    return _survived(spark, sf_dir, torn_only=True, dominant=False).select(F.col("grp").alias("event_id"), "field_name", F.col("record").alias("obs_id"), "value")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.surviving_records(_survived(spark, sf_dir)).withColumnRenamed("grp", "event_id")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_rows(_table(spark, sf_dir, "counterparties"), "counterparty_id", "cp_name", "aliases", "account", "city")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(p5_entities(spark, sf_dir), "counterparty_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks whose passages may stand in any order, with their coverage."""
    return leakage.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), ordered=False)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = spark.conf.get("tallyline.tokenizer", mixing.TOKENIZER)
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), tokenizer=tokenizer)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "common_words")).drop("text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(p10_statistics(spark, sf_dir)).select("doc_id", "text_kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p2_votes": p2_votes,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p8_found": p8_found,
    "p8_reordered": p8_reordered,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

def _survivors_sql() -> str:
    """The order of trust that the survivors are defined by; it settles every field unless the most trusted values tie."""
    cells = " UNION ALL ".join(f"SELECT event_id, obs_id, u, q, x, '{f}' AS field_name, {canon.field_sql(f, f)} AS value FROM o" for f in representative.FIELDS)
    trust = "CASE WHEN review_status IN ('VERIFIED','CORRECTED') THEN 0 ELSE 1 END AS u, -coalesce(extraction_confidence, -1) AS q, extracted_at AS x"
    return f"""WITH o AS (SELECT DISTINCT event_id, obs_id, {trust}, {', '.join(representative.FIELDS)} FROM observations), c AS (SELECT * FROM ({cells}) WHERE value <> ''),
      best AS (SELECT event_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id, field_name ORDER BY u, q, x DESC NULLS LAST, obs_id) AS rn FROM c) WHERE rn = 1),
      torn AS (SELECT event_id, field_name FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)
      SELECT event_id, field_name, min(obs_id) AS obs_id FROM c JOIN best USING (event_id, field_name, value) JOIN torn USING (event_id, field_name) GROUP BY 1, 2"""


ORACLE_SQL: dict[str, str] = {"p2_found": _survivors_sql()}
