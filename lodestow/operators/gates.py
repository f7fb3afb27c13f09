"""Rows that a person must look at before anything is packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plain_double


def _written(cell: Column) -> Column:
    return cell.isNotNull() & (F.trim(cell) != "")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _picked(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition. It is an entry of a generator: a filter would go below the columns it reads, which are then worked out wherever it names them."""
    return rows.select("*", F.explode(F.array(condition)).alias("_picked")).where("_picked").drop("_picked")


def _number(cell: str) -> Column:
    return F.col(f"_{cell}_number")


def read(rows: DataFrame, *cells: str) -> DataFrame:
    """rows with the number that each cell states, read once."""
    return rows.withColumns({f"_{c}_number": plain_double(F.col(c)) for c in cells})


def unweighed(*cells: str) -> Column:
    """Of rows with their numbers read: none of the cells holds a number above 0, or one that is written is no number or below 0."""
    unusable, positive = F.lit(False), F.lit(False)
    for c in cells:
        value = _number(c)
        sound = value.isNotNull() & ~F.isnan(value)
        unusable |= _written(F.col(c)) & ~(sound & (value >= 0))
        positive |= _written(F.col(c)) & sound & (value > 0)
    return unusable | ~positive


def lacking(*cells: str) -> Column:
    """Of rows with their numbers read: the names of edges that are no number above 0."""
    return F.concat_ws(",", *(F.when(~F.coalesce(_finite(_number(c)) & (_number(c) > 0), F.lit(False)), F.lit(c)) for c in cells))


def uncounted(cell: str) -> Column:
    """Of rows with their numbers read: the quantity is written, but is no whole number of 1 or more."""
    value = _number(cell)
    whole = _finite(value) & (value >= 1) & (value == F.floor(value))
    return _written(F.col(cell)) & ~F.coalesce(whole, F.lit(False))


def missing_weight(rows: DataFrame, *cells: str) -> DataFrame:
    """Rows without a usable weight."""
    return _picked(read(rows, *cells), unweighed(*cells)).select(*rows.columns)


def missing_dimensions(rows: DataFrame, *cells: str) -> DataFrame:
    """Rows with an edge that is no number above 0, with the names of such edges."""
    return _picked(read(rows, *cells).withColumn("missing", lacking(*cells)), F.col("missing") != "").select(*rows.columns, "missing")


def invalid_quantity(rows: DataFrame, cell: str) -> DataFrame:
    """Rows whose quantity is written, but is no whole number of 1 or more."""
    return _picked(read(rows, cell), uncounted(cell)).select(*rows.columns)


# Words that name packaging and transport equipment, alone or as parts of a name, and words that name cargo. A letter is a word's class.
WORDS = {
    "aframe": "E", "stillage": "E", "a": "a", "frame": "f", "returnable": "r", "steel": "s", "transport": "t", "delivery": "t", "rack": "k", "stand": "k",
    "for": "F", "carrying": "F", "holding": "F", "to": "o", "carry": "h", "hold": "h", "unit": "U",
    "panel": "C", "glass": "C", "glazing": "C", "glazed": "C", "mullion": "C", "transom": "C", "cladding": "C", "louver": "C", "louvre": "C", "canopy": "C", "canopies": "C",
    "bracket": "C", "spandrel": "C", "vision": "C", "module": "C",
}
UNSPLIT = {"周转架": "stillage", "回收架": "stillage", "A字架": "stillage", "A型架": "stillage", "板块": "panel", "幕墙": "panel", "玻璃": "panel", "面板": "panel", "单元": "panel"}
_INVARIANT = ("glass", "glazing", "glazed", "cladding", "vision", "returnable", "steel", "transport", "delivery", "a", "for", "carrying", "holding", "to", "carry", "hold", "canopy", "canopies")
#: Names made of several words, as classes: a frame; returnable (steel) rack, frame or stand; steel, transport or delivery rack or stand.
NAMES = (("af", "E"), ("rs?[kf]", "E"), ("[st]k", "E"), ("oh", "F"))
#: Cargo words that don't make a row cargo: what equipment is for or carries, up to three words on; what stands directly before equipment; a unit of equipment.
CARRIED = (("F[^pF|]{0,3}?[CU]+", "w"), ("[CU]{1,3}E", "E"), ("[Ek]U", "E"))


def spellings(word: str) -> tuple[str, ...]:
    return (word,) if word in _INVARIANT else (word, f"{word}s")


def word_classes(field: Column) -> Column:
    """A letter for each word of a cell, in order: its class in WORDS, p for punctuation, w for any other word. Names of several words are one letter."""
    text = F.coalesce(field, F.lit(""))
    for written, word in UNSPLIT.items():
        text = F.regexp_replace(text, f"(?i){written}", f" {word} ")
    known = F.map_from_arrays(*(F.array(*(F.lit(x) for x in xs)) for xs in zip(*((w, c) for k, c in WORDS.items() for w in spellings(k)), strict=True)))
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z'’]+|[0-9]+|[^\\sa-z0-9'’\\-‐–])"), F.lit(1))
    letters = F.array_join(F.transform(found, lambda x: F.coalesce(F.try_element_at(known, x), F.when(x.rlike("^[a-z'’0-9\\u4e00-\\u9fff]"), "w").otherwise("p"))), "")
    for name, letter in NAMES:
        letters = F.regexp_replace(letters, name, letter)
    return letters


def _own(classes: Column) -> Column:
    for pattern, letter in CARRIED:
        classes = F.regexp_replace(classes, pattern, letter)
    return classes


def packaging_names(rows: DataFrame, *fields: str) -> DataFrame:
    """The different cells (fields, an unknown one as '') that name packaging or transport equipment and no cargo. Each is read by itself, and once, however many rows state it."""
    names = rows.select(*(F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields)).distinct()
    # Cells side by side, parted by a letter that no rule crosses: worked out once for both questions.
    classes = F.array(F.concat_ws("|", *(word_classes(F.col(f)) for f in fields)))
    return _picked(names, F.exists(classes, lambda x: x.contains("E") & ~_own(x).rlike("[CU]")))


def packaging(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows that name packaging or transport equipment and no cargo; what equipment carries is no cargo of the row."""
    names = packaging_names(rows, *fields).select(*(F.col(f).alias(f"_{f}_name") for f in fields))
    marked = rows.withColumns({f"_{f}_name": F.coalesce(F.col(f), F.lit("")) for f in fields})
    return marked.join(names, [f"_{f}_name" for f in fields], "left_semi").select(*rows.columns)


def reasons(found: dict[str, tuple[Column, Column]]) -> Column:
    """An array with (reason, detail) of each gate (condition, detail) that a row stands under, null for the others; a row may stand under several."""
    return F.array(*(F.when(when, F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))) for reason, (when, detail) in found.items()))
