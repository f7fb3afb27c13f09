"""Sections, snippets and typed figures of texts, and tallies of what is said of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNIPPET = 280
# Kilograms of a unit of mass, by how it is written.
KILOGRAMS = {
    "kg": 1.0, "kgs": 1.0, "kilogram": 1.0, "kilograms": 1.0, "kilo": 1.0, "kilos": 1.0, "公斤": 1.0, "千克": 1.0,
    "t": 1000.0, "ton": 1000.0, "tons": 1000.0, "tonne": 1000.0, "tonnes": 1000.0, "mt": 1000.0, "吨": 1000.0,
    "lb": 0.45359237, "lbs": 0.45359237, "pound": 0.45359237, "pounds": 0.45359237,
    "short ton": 907.18474, "short tons": 907.18474, "us ton": 907.18474, "us tons": 907.18474, "long ton": 1016.0469088, "long tons": 1016.0469088,
}
# Kinds of containers as they are abbreviated and spelled.
KINDS = {"GP": "GP", "HQ": "HQ", "HC": "HQ", "OT": "OT", "FR": "FR"}
SPELLED = {("high", "cube"): "HQ", ("open", "top"): "OT", ("flat", "rack"): "FR"}
CJK_KINDS = {"开顶": "OT", "框架": "FR"}
# Words of money and of mass, and lengths that follow a figure in metres; what stands between one figure and the same in other units.
MONEY = "pay pays payable payment paid cost costs price prices priced charge charges fee fees damages penalty penalties bond bonds retention sterling gbp".split()
MASS = "weigh weighs weight weights weighed weighing wt wts gross mass masses payload heavy heavier heaviest vgm mgw gvw tonnage load loads loaded laden capacity swl".split()
LENGTHS = "long length wide width high height deep span run".split()
AGAIN = ("(", "[", "/", "or", "i e")
ROUGHLY = ("approx", "approximately", "about", "abt", "c", "ca", "~", "≈")
_FIGURE = "[0-9]+(?:[.,][0-9]+|[ \\u00a0\\u202f][0-9]{3}(?![0-9]))*"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body): a text cut before each heading line; the bodies one after another are the text. Null text: none."""
    parts = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"(?m)^(?=#{1,6}(\s|$))")).alias("section", "body"))
    first = F.substring_index("body", "\n", 1)
    heading = F.when(first.rlike(r"^#{1,6}(\s|$)"), F.substring(F.trim(F.regexp_replace(first, "^#+", "")), 1, 120))
    return parts.select(key, "section", heading.alias("heading"), "body")


def snippet(body: Column, tokens: Column) -> Column:
    """Of the lines that are neither blank nor headings the first that holds a token, or else the first; its first 280 characters."""
    # Named alone, F.trim would be given each line's index as the characters to cut.
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    held = F.filter(lines, lambda x: F.exists(tokens, lambda t: F.contains(F.lower(x), t)))
    return F.substring(F.coalesce(F.get(held, F.lit(0)), F.get(lines, F.lit(0)), body), 1, SNIPPET)


def match_string(tokens: Column) -> Column:
    """The search expression of tokens: quoted words, and the pairs of CJK runs, each once, joined by OR."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    none = F.array().cast("array<string>")
    each = lambda t: F.when(t.rlike("^[\\u4e00-\\u9fff]+$"), F.when(F.char_length(t) >= 2, pairs(t)).otherwise(none)).otherwise(F.array(t))
    return F.array_join(F.transform(F.array_distinct(F.flatten(F.transform(tokens, lambda t: each(F.lower(F.trim(t)))))), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def _one_of(words: Iterable[str]) -> str:
    return "|".join(words)


def container_codes(text: Column) -> Column:
    """Sorted distinct codes such as 40HQ of the containers that a text names, in any spelling: a size, perhaps feet, and a kind. A spelled
    kind without a size, and OT or FR in capitals, is a code by itself. Read word by word."""
    for (a, b), kind in SPELLED.items():
        text = F.regexp_replace(text, f"(?i)(?<![A-Za-z]){a}[\\s-]?{b}(?![A-Za-z])", f" §{kind} ")
    for name, kind in CJK_KINDS.items():
        text = F.regexp_replace(text, f"{name}(柜|集装箱)", f" ¤{kind} ")
    found = F.regexp_extract_all(text, F.lit("([0-9]+|[A-Za-z][A-Za-z0-9]*|[§¤][A-Z]{2}|[^\\sA-Za-z0-9-])"), F.lit(1))
    words = F.filter(found, lambda x: ~F.lower(x).isin("ft", "foot", "feet", "'", "’") | x.isNull())
    before = F.concat(F.array(F.lit("")), words)
    plain = lambda x: F.coalesce(*(F.when(F.upper(x) == k, F.lit(v)) for k, v in KINDS.items()), F.when(x.startswith("§"), F.substring(x, 2, 2)))
    bare = lambda x: F.when(x.rlike("^[§¤]"), F.substring(x, 2, 2)).when(x.isin("OT", "FR"), x)
    codes = F.zip_with(before, words, lambda a, x: F.when(a.isin("20", "40", "45") & plain(x).isNotNull(), F.concat(a, plain(x))).otherwise(bare(x)))
    return F.array_sort(F.array_distinct(F.array_compact(codes)))


def figure_words(text: Column) -> Column:
    """The figures, words and signs of a sentence, in order."""
    return F.regexp_extract_all(text, F.lit(f"({_FIGURE}|[A-Za-z]+|公斤|千克|吨|[^\\sA-Za-z0-9.])"), F.lit(1))


def masses_kg(text: Column, words: Column | None = None) -> Column:
    """Every mass that a sentence states, in kilograms and in order; imperial units are converted to a tenth. See ``mass_figures``."""
    return F.transform(mass_figures(text, words), lambda f: f["kg"])


def mass_figures(text: Column, words: Column | None = None) -> Column:
    """array of (kg, first, last): the masses of a sentence and the words (from 0) that state each, read word by word.

    Thousands may be grouped by commas or blanks. Pounds are money in a sentence that speaks of money or not of mass; mt in small letters is
    tonnes in a sentence that speaks of mass, unless a length follows. A figure in other units directly after the same figure, within 3 %, is no second one.
    ``words`` are the sentence's ``figure_words`` where a column holds them: each figure looks around in them.
    """
    tokens = figure_words(text) if words is None else words
    low = F.lower(text)
    money = low.rlike(f"(?<![a-z])({_one_of(MONEY)}|compensat\\w*|insur\\w*|invoice\\w*|per\\s+(day|week|month))(?![a-z])|£")
    mass = low.rlike(f"(?<![a-z])({_one_of(MASS)})(?![a-z])|重")
    known = F.map_from_arrays(F.array(*(F.lit(u) for u in KILOGRAMS)), F.array(*(F.lit(v) for v in KILOGRAMS.values())))

    def figure(x: Column, i: Column) -> Column:
        at = lambda k: F.coalesce(F.get(tokens, i + k), F.lit(""))
        one, two = F.lower(at(1)), F.lower(F.concat(at(1), F.lit(" "), at(2)))
        metric = two.isin("metric ton", "metric tons", "metric tonne", "metric tonnes")
        pair = F.try_element_at(known, two).isNotNull() | metric
        unit = F.when(metric, "t").when(pair, two).otherwise(one)
        scale = F.try_element_at(known, unit)
        imperial = unit.rlike("^(lb|pound|short|long|us )")
        ok = F.when(unit.startswith("pound"), mass & ~money).when(at(1) == "mt", mass & ~F.lower(at(2)).isin(*LENGTHS)).when(one == "mt", at(1) == "MT").otherwise(True)
        well = x.rlike("^([0-9]{1,3}([, \\u00a0\\u202f][0-9]{3})+|[0-9]+)([.][0-9]+)?$")
        value = F.when(well & scale.isNotNull() & ok, F.regexp_replace(x, "[, \\u00a0\\u202f]", "").try_cast("double"))
        return F.struct(F.when(imperial, F.round(value * scale, 1)).otherwise(value * scale).alias("kg"), i.alias("first"), (i + F.when(pair, 2).otherwise(1)).alias("last"))

    # Only what begins with a digit can be a figure; the other words are not looked at one by one.
    figures = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda t: t["x"].rlike("^[0-9]"))
    found = F.filter(F.transform(figures, lambda t: figure(t["x"], t["i"])), lambda f: f["kg"].isNotNull())
    between = lambda a, b: F.lower(F.array_join(F.slice(tokens, a["last"] + 2, F.greatest(b["first"] - a["last"] - 1, F.lit(0))), " "))
    openers = [f"{a}{' ' + r if r else ''}" for a in AGAIN for r in ("", *ROUGHLY)]
    none = F.array().cast("array<struct<kg:double,first:int,last:int>>")

    def more(out: Column, f: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        same = between(last, f).isin(*openers) & (F.abs(f["kg"] - last["kg"]) <= 0.03 * F.greatest(f["kg"], last["kg"]))
        return F.when(F.coalesce(same, F.lit(False)), out).otherwise(F.array_append(out, f))

    return F.when(text.isNotNull(), F.aggregate(found, none, more))


def occurrence_ids(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """rows with id: the name, and from its second occurrence in the group on its number after it."""
    nth = F.row_number().over(Window.partitionBy(*group, name).orderBy(*order))
    return rows.withColumn("_n", nth).withColumn("id", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_n").cast("string")))).drop("_n")


def stated_twice(mentions: DataFrame, topic: str, value: str, origin: str, amount: Column) -> DataFrame:
    """(topic, n_values, same): topics with two different mentions or more; same if all of them are one amount, however written."""
    once = mentions.select(topic, value, origin, F.coalesce(amount, F.col(value)).alias("_a")).distinct()
    found = once.groupBy(topic).agg(F.count("*").alias("n_values"), (F.count_distinct("_a") == 1).alias("same"))
    return found.where("n_values >= 2")


def response_status(requirements: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """requirements with status: those on transport or packaging are covered or a gap by their run, or for a person where a packing
    result does not speak to them; others, and those without a run, are pending. runs(key, can_fit)."""
    met = requirements.join(runs.select(key, "can_fit"), key, "left")
    about = F.col("category").isin("transport", "packaging") & F.col("can_fit").isNotNull()
    fits = F.when(F.col("addressed"), "covered").otherwise("human_required")
    return met.withColumn("status", F.when(about, F.when(F.col("can_fit"), fits).otherwise("gap")).otherwise("pending")).drop("can_fit")


def count_by(rows: DataFrame, group: str, *names: str) -> DataFrame:
    """(group, name, value, n): how often each value of each named column occurs; an empty one is unknown."""
    value = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    each = rows.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), value(c).alias("value")) for c in names))).alias("v"))
    return each.groupBy(group, "v.name", "v.value").agg(F.count("*").alias("n"))


def tally(statements: DataFrame, group: str) -> DataFrame:
    """Of each record's statements how many are covered, partial, gaps and for a person, and how many clauses a covered one names."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("covered", "partial", "gap", "human_required")]
    return statements.groupBy(group).agg(F.count("*").alias("total"), F.count_distinct(F.when(F.col("status") == "covered", F.col("clause"))).alias("clauses_covered"), *status)
