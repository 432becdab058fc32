"""The registered queries of this subpackage: one per operator, over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import exact, extract, lines, markov, mixing, phrases, pieces, quality, runs, secrets, simhash, urls, warc


def _over(table: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _over("documents", quality.query),
    "op2_url_filters": _over("pages", urls.query),
    "op3_exact_dedup": _over("documents", exact.query),
    "op4_line_dedup": _over("documents", lines.query),
    "op5_secret_scans": _over("documents", secrets.query),
    "op6_source_mixing": _over("documents", mixing.query),
    "op7_warc": _over("pages", warc.query),
    "op8_sentencepiece": _over("documents", pieces.query),
    "op9_simhash": _over("documents", simhash.query),
    "op10_markov_scores": _over("documents", markov.query),
    "op11_html_extraction": _over("pages", extract.query),
    "op12_phrase_mining": _over("documents", phrases.query),
    "op13_periodic_runs": _over("documents", runs.query),
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op2_url_filters": urls.SQL,
    "op3_exact_dedup": exact.SQL,
    "op6_source_mixing": mixing.SQL,
    "op12_phrase_mining": phrases.SQL,
}
