"""Tokens of Latin words and CJK runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


RUN = "([a-z0-9_]+|[\\u4e00-\\u9fff]+)"


def runs(text: Column) -> Column:
    """Runs of Latin letters, digits and _, and of CJK characters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(1))


def _cut(run: Column, n: int) -> Column:
    return F.when(F.char_length(run) >= n, F.transform(F.sequence(F.lit(1), F.char_length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Distinct words of two letters or more and numbers; of each CJK run itself, its pairs and its triples. In order."""
    each = lambda run: F.when(run.rlike("^[a-z0-9_]"), F.when((F.char_length(run) >= 2) | run.rlike("^[0-9]+$"), F.array(run)).otherwise(F.array().cast("array<string>"))).otherwise(
        F.concat(F.when(F.char_length(run) >= 2, F.array(run)).otherwise(F.array().cast("array<string>")), _cut(run, 2), _cut(run, 3))
    )
    return F.array_distinct(F.flatten(F.transform(runs(text), each)))


def index_tokens(text: Column) -> Column:
    """Terms of the full-text index, repeats kept: w + word; of CJK runs u + each character and b + each pair."""
    each = lambda run: F.when(run.rlike("^[a-z0-9_]"), F.array(F.concat(F.lit("w"), run))).otherwise(
        F.concat(F.transform(_cut(run, 1), lambda c: F.concat(F.lit("u"), c)), F.transform(_cut(run, 2), lambda c: F.concat(F.lit("b"), c)))
    )
    return F.flatten(F.transform(runs(text), each))


def html_text(page: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, the five basic entities decoded, white space as one blank."""
    out = F.regexp_replace(page, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t\\r\\n]+", " "))
