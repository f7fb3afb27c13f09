"""Requirements against responses, traced numbers, rule-based requirement lines, scores of a checker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requirement_lines(docs: DataFrame, rules: list[tuple[str, str]], doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, theme, text): each line with the first rule that it matches."""
    lines = docs.select(doc, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    theme = F.coalesce(*(F.when(F.col("line").rlike(pattern), F.lit(name)) for name, pattern in rules))
    return lines.select(doc, "line_no", theme.alias("theme"), F.col("line").alias("text")).where("theme IS NOT NULL")


def match_responses(requirements: DataFrame, responses: DataFrame, least: int = 3) -> DataFrame:
    """(req, resp, shared): pairs that share so many distinct word stems of six letters; an inverted index, no cross join."""
    stems = lambda df, key: df.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)), lambda w: F.substring(w, 1, 6)))).alias("stem"))
    return stems(requirements, "req").join(stems(responses, "resp"), "stem").groupBy("req", "resp").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def untraced_numbers(drafts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Numbers of a draft that its evidence states neither as they are, nor rounded, nor as a percentage. Values are counted in hundredths."""
    numbers = lambda df: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{1,12}(?:[.][0-9]{1,4})?"), F.lit(0)))).alias("raw")).select(key, "raw", F.round(F.col("raw").try_cast("double") * 100).cast("bigint").alias("v"))
    stated = numbers(evidence).select(key, "v")
    forms = stated.unionByName(stated.select(key, (F.round(F.col("v") / 100) * 100).cast("bigint").alias("v"))).unionByName(stated.select(key, (F.col("v") * 100).alias("v"))).distinct()
    return numbers(drafts).join(forms, [key, "v"], "left_anti").select(key, "raw")


def precision_recall(rows: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    both = F.count_if(F.col(predicted) & F.col(actual))
    p, r = both / F.nullif(F.count_if(predicted), F.lit(0)), both / F.nullif(F.count_if(actual), F.lit(0))
    out = rows.groupBy(*keys).agg(both.alias("tp"), F.count_if(predicted).alias("predicted"), F.count_if(actual).alias("actual"), p.alias("p"), r.alias("r"))
    f1 = 2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0))
    return out.select(*keys, "tp", "predicted", "actual", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))
