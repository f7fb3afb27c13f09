"""Information-theoretic sanitisation of personal data, DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep

#: Kinds in the order in which spans of one start are listed. Possessive and anchored forms of the plain patterns: a run of
#: characters is entered once, so that very long runs cost no more than their length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "contains({t}, '@')", "ip": "{t} RLIKE '[0-9][.][0-9]'", "card": "{t} RLIKE '[0-9][0-9 -]{{12}}'", "phone": "contains({t}, '+')"}
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_VALID = {
    "email": "{m} IS NOT NULL",
    "ip": "forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 9) AS int), 0) <= 255)",
    "card": "length(" + _DIGITS + ") BETWEEN 14 AND 19 AND aggregate(transform(sequence(1, length(" + _DIGITS + ")), i -> int(substring(" + _DIGITS + ", -i, 1)) * IF(i % 2 = 1, 1, 2)), 0, (s, d) -> s + IF(d > 9, d - 9, d)) % 10 = 0",
    "phone": "length(" + _DIGITS + ") BETWEEN 10 AND 15",
}
#: A term tells of an entity the share PMI(term; entity) / IC(entity) of its information. From the first share on it is
#: removed, from the second on generalised, if the two meet in this many different lines.
REMOVE, GENERALISE, SUPPORT = 0.8, 0.5, 2
_TERM = "[\\\\p{L}\\\\p{N}]+"


def base_spans(text: str = "text") -> Column:
    """array<struct<s, k, e, kind, value>> of the valid matches of every kind, by start, then kind."""
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        quoted = "r'" + pattern + "'"
        step = f"""named_struct('pos', a.pos + length(x.`0`) + coalesce(length(x.`1`), 0L),
            'out', CASE WHEN x.`1` IS NOT NULL AND {_VALID[kind].format(m='x.`1`')} THEN concat(a.out, array(named_struct('s', a.pos + length(x.`0`), 'k', {k},
              'e', a.pos + length(x.`0`) + length(x.`1`), 'kind', '{kind}', 'value', x.`1`))) ELSE a.out END)"""
        empty = "cast(array() AS array<struct<s: bigint, k: int, e: bigint, kind: string, value: string>>)"
        # Pieces between matches and matches, side by side: places are sums of lengths.
        parts.append(
            f"""CASE WHEN {_GUARDS[kind].format(t=text)} THEN aggregate(arrays_zip(split({text}, {quoted}, -1), regexp_extract_all({text}, {quoted}, 0)),
            named_struct('pos', 0L, 'out', {empty}), (a, x) -> {step}, a -> a.out) ELSE {empty} END"""
        )
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, p -> concat(p.kind, ':', p.s, ':', p.e)), ',')"


def _lines(df: DataFrame) -> DataFrame:
    """Lines of df(row, text) with their start in code points."""
    lines = df.select("row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("at", F.coalesce(F.sum(F.char_length("line") + 1).over(before), F.lit(0)).cast("bigint"))


def _words(lines: DataFrame) -> DataFrame:
    """Terms of lines(row, pos, line, at): lower-cased, with their places in the text."""
    zipped = lines.select("row", "pos", "at", F.posexplode(F.expr(f"arrays_zip(split(line, '{_TERM}', -1), regexp_extract_all(line, '{_TERM}', 0))")).alias("w", "z"))
    zipped = zipped.select("row", "pos", "at", "w", F.col("z.0").alias("gap"), F.col("z.1").alias("term"))
    before = Window.partitionBy("row", "pos").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("at") + F.coalesce(F.sum(F.char_length("gap") + F.coalesce(F.char_length("term"), F.lit(0))).over(before), F.lit(0)) + F.char_length("gap")
    placed = zipped.withColumn("s", start.cast("bigint")).where("term IS NOT NULL")
    return placed.select("row", "pos", F.lower("term").alias("term"), "term", "s", (F.col("s") + F.char_length("term")).alias("e")).toDF("row", "pos", "term", "written", "s", "e")


def disclosures(lines: DataFrame, met: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(kind, value, term, share, action) of terms over a threshold.

    lines(line): every line of the corpus, the unit of co-occurrence. met(kind, value, term, row, pos, line_hash): a
    term on the line of an entity. Counts are sums over all lines, made map-side before they are exchanged.
    """
    total = lines.agg(F.count("*").alias("n_lines"))
    counts = lines.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(line), '{_TERM}', 0)"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    both = met.dropDuplicates(["kind", "value", "term", "row", "pos"]).groupBy("kind", "value", "term").agg(F.count("*").alias("n_both"), F.min("line_hash").alias("h1"), F.max("line_hash").alias("h2"), F.count_distinct("line_hash").alias("contexts"))
    entity = met.groupBy("kind", "value").agg(F.count_distinct("row", "pos").alias("n_entity"))
    both = both.where((F.col("contexts") >= support)).join(entity, ["kind", "value"]).join(counts, "term").crossJoin(F.broadcast(total))  # one row
    pmi = F.log(F.col("n_both") * F.col("n_lines") / (F.col("n_entity").cast("double") * F.col("n_term")))
    content = F.log(F.col("n_lines") / F.col("n_entity").cast("double"))
    scored = both.withColumn("share", F.when(content > 0, pmi / content).otherwise(F.lit(0.0)))
    return scored.where(F.col("share") >= generalise).select("kind", "value", "term", "share", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, terms): the base spans and the spans of disclosing terms, each with its action, of every row.

    text is null where a row has no spans. Null text: empty. Rows that repeat are found each. A term inside a base span adds none.
    Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("base", base_spans())
    found = keep(found.select("row", "id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "base")
    hits = found.where("text IS NOT NULL")
    lines = _lines(hits).withColumn("end", F.col("at") + F.char_length("line"))
    entities = hits.select("row", F.explode("base").alias("b")).select("row", "b.kind", "b.value", F.col("b.s").alias("bs"), F.col("b.e").alias("be"))
    on = lines.join(entities, "row").where("bs >= at AND be <= end")
    # The lines that hold entities, with their entities as a set: only these have their words placed.
    marked = keep(on.groupBy("row", "pos").agg(F.first("line").alias("line"), F.first("at").alias("at"), F.collect_set(F.struct("kind", "value")).alias("held"), F.collect_set(F.struct("bs", "be")).alias("spans")), "marked")
    words = _words(marked.select("row", "pos", "line", "at")).join(marked.select("row", "pos", "held", "spans", F.xxhash64("line").alias("line_hash")), ["row", "pos"])
    words = keep(words.where("NOT exists(spans, b -> b.bs < e AND s < b.be)").drop("spans"), "words")
    met = words.select("row", "pos", "term", "line_hash", F.explode("held").alias("h")).select("h.kind", "h.value", "term", "row", "pos", "line_hash")
    every = rows.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    telling = disclosures(every, met)
    placed = words.select("row", "term", "written", "s", "e", F.explode("held").alias("h")).select("row", "term", "written", "s", "e", "h.kind", "h.value")
    flagged = placed.join(telling, ["kind", "value", "term"]).groupBy("row", "s", "e").agg(F.max("action").alias("action"), F.first("written").alias("written"))
    terms = flagged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e", F.lit("term").alias("kind"), F.col("written").alias("value"), "action"))).alias("terms"))
    none = "cast(array() AS array<struct<s: bigint, k: int, e: bigint, kind: string, value: string, action: string>>)"
    return found.join(terms, "row", "left").select(F.col("id").alias(id_col), "text", "base", F.expr(f"coalesce(terms, {none})").alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sanitised, base, terms): text with base spans and telling terms replaced; null where nothing was found.

    A base span becomes its kind in brackets. A removed term becomes [removed]; a generalised one [number], [name] (it starts with a capital) or [word].
    Where spans overlap the one that starts first is replaced, and the other is part of it.
    """
    word = "CASE WHEN p.action = 'remove' THEN '[removed]' WHEN p.value RLIKE '^[0-9]' THEN '[number]' WHEN p.value RLIKE '^\\\\p{Lu}' THEN '[name]' ELSE '[word]' END"
    spans = f"array_sort(concat(transform(base, p -> struct(p.s AS s, p.e AS e, concat('[', p.kind, ']') AS r)), transform(terms, p -> struct(p.s AS s, p.e AS e, {word} AS r))))"
    built = f"""aggregate({spans}, named_struct('at', 0L, 'out', ''), (a, p) -> CASE WHEN p.s < a.at THEN a
        ELSE named_struct('at', p.e, 'out', concat(a.out, substring(text, int(a.at + 1), int(p.s - a.at)), p.r)) END, a -> concat(a.out, substring(text, int(a.at + 1))))"""
    return find(docs, id_col, text_col).select(id_col, F.expr(built).alias("sanitised"), "base", "terms")


def op2_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [F.expr(f"cast(size(filter(base, p -> p.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in PATTERNS]
    every = "array_sort(concat(transform(base, p -> struct(p.s AS s, p.k AS k, p.e AS e, p.kind AS kind)), transform(terms, p -> struct(p.s AS s, p.k AS k, p.e AS e, p.kind AS kind))))"
    return found.select("doc_id", *count, F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined(every)).alias("spans"))
