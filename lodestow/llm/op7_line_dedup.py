"""Line deduplication by an exact set-similarity join, DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._store import bounded, dealt, keep

#: Jaccard threshold as a fraction.
P, Q = 4, 5
#: Token counts are summed in so many buckets; a byte for each goes to every task.
_BUCKETS, _PIECE_BITS = 1 << 18, 12
#: Tokens of a higher level are hot: lines are not posted under one of them, but under pairs of them. 1 + ceil(3 * log2(count)).
_HOT = 1 + 3 * 24
#: Most texts have no white space but spaces and line ends, and a split at one character is far cheaper than one at a class.
_PIECES = """split(lower({0}), CASE WHEN contains({0}, '\t') OR contains({0}, '\r') OR contains({0}, '\x0b')
    OR contains({0}, '\x0c') THEN '[\\\\x20\\\\x09-\\\\x0D]+' ELSE ' ' END)"""
#: The distinct words of a line as hashes. (An empty piece is no word.)
_HASHES = f"array_remove(array_distinct(transform({_PIECES.format('line')}, w -> xxhash64(w))), xxhash64(''))"
_PLACE = ("id", "h", "pos")
#: Lines of more tokens than this have a parity bitmap of 256 bits besides that of 64: in a short one theirs would look alike.
_LONG = 80
_WIDE = ("w1", "w2", "w3")


def rarity(docs: DataFrame, text_col: str = "text") -> Column:
    """A constant, a byte for each bucket, its level: 1 if the corpus holds one word of it, else 1 + ceil(3 * log2(count)).

    It orders tokens, and any order that all lines share finds every pair: common buckets only make more candidates.
    A word alone in its bucket occurs once, so it is shared with no other line.
    """
    text = f"replace(`{text_col}`, '\n', ' ')"
    words = docs.select(F.explode(F.expr(_PIECES.format(text))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(_BUCKETS - 1).alias("bucket")).count()
    every = docs.sparkSession.range(_BUCKETS).select(F.col("id").alias("bucket"))
    counts = every.join(counts, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    level = F.when(F.col("count") < 2, 1).otherwise(F.least(1 + F.ceil(3 * F.log2("count")), F.lit(126)))
    by_bucket = F.array_sort(F.collect_list(F.struct("bucket", F.chr(level.cast("bigint")).alias("level"))))
    pieces = counts.groupBy(F.shiftright("bucket", _PIECE_BITS).alias("piece")).agg(F.array_join(by_bucket["level"], "").alias("levels"))
    return F.lit("".join(row.levels for row in sorted(pieces.collect())).encode())  # _BUCKETS bytes, whatever the input


def text_hash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows of one id with different texts apart: a hash of the text, or nothing (0) where no id has two texts."""
    h = F.xxhash64(F.lit(0), text_col)
    ids = docs.groupBy(id_col).agg(F.min(h).alias("low"), F.max(h).alias("high"))
    return _no_hash() if ids.where("low <> high").isEmpty() else h


def _no_hash() -> Column:
    return F.lit(0).cast("bigint")


def lines_of(docs: DataFrame, h: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, pos, line); h as of text_hash."""
    rows = docs.select(F.col(id_col).alias("id"), h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "h", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _spoken(lines: DataFrame) -> DataFrame:
    """Lines with a word. (A test of a hash would be pushed below the lines and make hashes twice.)"""
    return lines.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))


def _same(a: str, b: str, fields: tuple[str, ...] = _PLACE) -> Column:
    """Are places a and b one? An id may be null."""
    out = F.lit(True)
    for f in fields:
        equal = F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) if f in ("id",) else F.col(f"{a}.{f}") == F.col(f"{b}.{f}")
        out = out & equal
    return out


def _copies(docs: DataFrame, h: Column, id_col: str, text_col: str) -> DataFrame:
    """Lines of words, (id, h, pos, line, k1, k2, first): first is the place of the first of equal lines, null if there are no others."""
    lines = _spoken(lines_of(docs, h, id_col, text_col)).withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})
    lines_of_key = lines.groupBy("k1", "k2")
    if str(h) == str(_no_hash()) and isinstance(lines.schema["id"].dataType, IntegralType):
        # One number in order of id (none first) and position is summed up by hashing, where places of three fields would be sorted.
        at = F.coalesce(F.col("id").cast("decimal(20,0)"), F.expr(f"{-(1 << 63) - 1}BD")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
        firsts = lines_of_key.agg(F.min(at.cast("decimal(32,0)")).alias("at"), F.count("*").alias("of")).where("of > 1")
        pos = F.expr(f"pmod(at, {1 << 31}BD)")
        firsts = firsts.select("k1", "k2", pos.alias("pos"), F.expr(f"(at - pmod(at, {1 << 31}BD)) / {1 << 31}BD").cast("decimal(20,0)").alias("id"))
        kind = lines.schema["id"].dataType
        firsts = firsts.select("k1", "k2", F.struct(F.when(F.expr(f"id > {-(1 << 63) - 1}BD"), F.col("id").cast(kind)).alias("id"), h.alias("h"), F.col("pos").cast("int").alias("pos")).alias("first"))
    else:
        firsts = lines_of_key.agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("of")).where("of > 1").drop("of")
    return lines.join(bounded(keep(firsts, "firsts")), ["k1", "k2"], "left")


def _posted(lines: DataFrame, levels: Column) -> DataFrame:
    """(key, x): each line under the keys of its prefix; x holds its place, n words, their parity bitmaps and i.

    Tokens are ordered by rarity. Two lines at the threshold share a token of their prefixes. If the rarest that they
    share is hot, so are all that they share, and they share two at least: the hot part of the prefix, longer by one, goes in pairs.
    i is the number of tokens before the key: at most n - i can be shared if the key is the first that is.
    """

    def token(h: Column) -> Column:  # its level in the top byte, its hash below
        level = F.ascii(F.substring(levels, h.bitwiseAND(_BUCKETS - 1).cast("int") + 1, 1).cast("string")).cast("bigint")
        return F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1))

    lines = lines.withColumn("tokens", F.sort_array(F.transform(F.expr(_HASHES), token))).select(
        *_PLACE, F.size("tokens").alias("n"),
        F.expr(f"slice(tokens, 1, size(tokens) - ({P} * size(tokens) + {Q - 1}) DIV {Q} + 2)").alias("prefix"),
        F.expr("aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(1L, int(t & 63)))").alias("bits"),
        # The words of the wide bitmap but the first, which is what they leave of the narrow one.
        *(F.expr(f"CASE WHEN size(tokens) > {_LONG} THEN aggregate(tokens, 0L, (a, t) -> IF(t & 192 = {k * 64}, a ^ shiftleft(1L, int(t & 63)), a)) END").alias(w) for k, w in enumerate(_WIDE, 1)),
    )
    # A prefix proper is without its last token, unless the line has but one token.
    hot, proper = f"{(_HOT + 1) << 56}L", "greatest(size(prefix) - 1, 1)"
    lines = lines.withColumn("cold", F.expr(f"CASE WHEN prefix[{proper} - 1] < {hot} THEN {proper} ELSE size(filter(prefix, t -> t < {hot})) END"))
    pairs = """CASE WHEN size(prefix) = 1 THEN prefix ELSE flatten(transform(slice(prefix, cold + 1, size(prefix)), (s, i) ->
        transform(slice(prefix, cold + i + 2, size(prefix)), t -> xxhash64(s, t)))) END"""
    keys = f"CASE WHEN cold = {proper} THEN slice(prefix, 1, cold) ELSE concat(slice(prefix, 1, cold), {pairs}) END"
    posted = lines.select(*_PLACE, "n", "bits", *_WIDE, "cold", F.posexplode(F.expr(keys)).alias("i", "key"))
    # The first of a pair has the cold tokens before it at least.
    return posted.select("key", F.struct(*_PLACE, "n", F.least("i", "cold").alias("i"), "bits", *_WIDE).alias("x"))


_FIRST = "{0}.bits ^ {0}.w1 ^ {0}.w2 ^ {0}.w3"
#: Bits that differ, of the wide bitmaps if both lines have one.
_DIFFER = f"""coalesce(bit_count(({_FIRST.format("x")}) ^ ({_FIRST.format("y")})) + bit_count(x.w1 ^ y.w1) + bit_count(x.w2 ^ y.w2) + bit_count(x.w3 ^ y.w3), bit_count(x.bits ^ y.bits))"""
#: Overlap needed at the threshold, and the most that lengths, the place of the shared token and the bitmaps allow.
_NEAR = f"""{Q} * least(x.n, y.n) >= {P} * greatest(x.n, y.n) AND {P + Q} * least(x.n - x.i, y.n - y.i) >= {P} * (x.n + y.n)
    AND {P + Q} * (x.n + y.n - {_DIFFER}) >= {2 * P} * (x.n + y.n)"""


def _verified(pairs: DataFrame, docs: DataFrame, h: Column, id_col: str, text_col: str) -> DataFrame:
    """x of the pairs (x, y) of places whose word sets reach the threshold. Pairs should be kept."""
    places = pairs.select(F.col("x").alias("place")).unionByName(pairs.select(F.col("y").alias("place"))).distinct()
    places = bounded(keep(places, "places"))
    lines = _spoken(lines_of(docs, h, id_col, text_col)).select(F.struct(*_PLACE).alias("l"), "line").join(places, _same("l", "place"))
    words = keep(lines.select("place", F.expr(_HASHES).alias("words")), "words")  # repeated rows repeat them
    both = pairs.join(words.select(F.col("place").alias("px"), F.col("words").alias("wx")), _same("x", "px"))
    both = both.join(words.select(F.col("place").alias("py"), F.col("words").alias("wy")), _same("y", "py"))
    both = both.withColumn("common", F.size(F.array_intersect("wx", "wy")))
    return both.where(f"{Q} * common >= {P} * (size(wx) + size(wy) - common)").select("x").distinct()


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", h: Column | None = None) -> DataFrame:
    """(id, h, pos) of every line whose set of words has Jaccard 0.8 or more with that of a line before it.

    Lines come in order of id, text hash and position. Words are cut at white space and lower-cased.
    Equal lines are a class; its first line stands for it, and the others go. Of the others each meets the first line
    of each of its keys; those that are found to go need no other partner, and the rest meet all earlier lines of their keys, the closest first.
    Lengths, places of the shared token and parity bitmaps rule out most that do not reach the threshold, and words decide.

    Lines without words stay, and are no match. Null text: one line without words. Rows equal in id and text are one
    document; its lines may be named more than once. A null id comes first; its lines are compared as earlier lines but,
    not being named, stay. Empty table: no rows.
    """
    h = text_hash(docs, id_col, text_col) if h is None else h
    lines, levels = _copies(docs, h, id_col, text_col), rarity(docs, text_col)
    by_key = Window.partitionBy("key")
    shared = _posted(lines.where(F.col("first").isNull() | (F.struct(*_PLACE) == F.col("first"))), levels)
    shared = shared.withColumn("y", F.min("x").over(by_key)).withColumn("of", F.count("*").over(by_key)).where("of > 1 AND NOT (x.id <=> y.id AND x.h = y.h AND x.pos = y.pos)")
    shared = shared.withColumn("head", F.when(F.expr(_NEAR), F.struct("y.id", "y.h", "y.pos"))).where("of > 2 OR head IS NOT NULL").select("key", "x", "of", "head")
    with dealt(shared, "shared", "key") as shared:
        place = F.struct("x.id", "x.h", "x.pos")
        heads = keep(shared.where("head IS NOT NULL").select(place.alias("x"), F.col("head").alias("y")).distinct(), "heads")
        gone = keep(_verified(heads, docs, h, id_col, text_col), "gone")
        # A line that is found to go is no later line of another pair, but an earlier one it may be. Of all its earlier candidates each
        # line is compared with the one whose bitmap is closest, and only lines that don't match it, and have others, with those.
        found = bounded(gone.select(F.col("x").alias("g")))
        later = shared.where("of > 2").select("key", "x").join(found, _same("x", "g"), "left_anti")
        earlier = shared.where("of > 2").select("key", F.col("x").alias("y"))
        near = later.join(earlier, "key").where(f"{_NEAR} AND y < x")
        candidate = F.struct("y.id", "y.h", "y.pos")
        best = near.groupBy("x.id", "x.h", "x.pos").agg(F.min(F.struct(F.expr(_DIFFER).alias("d"), candidate.alias("y"))).alias("b"), F.min(candidate).alias("low"), F.max(candidate).alias("high"))
        best = keep(best.select(F.struct(*_PLACE).alias("x"), F.col("b.y").alias("y"), (F.col("low") != F.col("high")).alias("others")), "best")
        closest = keep(_verified(best.select("x", "y"), docs, h, id_col, text_col), "closest")
        rest = keep(best.where("others").join(closest.select(F.col("x").alias("g")), _same("x", "g"), "left_anti").select(F.col("x").alias("r"), F.col("y").alias("tried")), "rest")
        asked = shared.where("of > 2").select("key", "x").join(bounded(rest), _same("x", "r")).select("key", "x", "tried")
        earlier = shared.where("of > 2").select("key", F.col("x").alias("y"))
        others = earlier.join(bounded(asked), "key").where(f"{_NEAR} AND y < x").select(place.alias("x"), candidate.alias("y"), "tried").where(~_same("y", "tried"))
        gone = gone.unionByName(closest).unionByName(_verified(keep(others.select("x", "y").distinct(), "others"), docs, h, id_col, text_col)).select("x.*")
    copies = lines.where("first IS NOT NULL").where(F.struct(*_PLACE) != F.col("first")).select(*_PLACE)
    return keep(gone.unionByName(copies).where("id IS NOT NULL"), "removed")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later matches taken out of their texts, with n_lines, n_removed and removed, the positions that went (columns of docs of such names are replaced).

    Rows that repeat an id are told apart by their texts. Null text stays null, with one line.
    """
    h = text_hash(docs, id_col, text_col)
    gone = later_matches(docs, id_col, text_col, h).groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))  # a row's own lines
    rows = docs.drop(*(c for c in ("n_lines", "n_removed", "removed") if c in docs.columns)).withColumn("_h", h)
    rows = rows.withColumn("n_lines", F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("bigint"))
    rows = rows.join(gone.withColumnsRenamed({"id": "_id", "h": "_g"}), (F.col(id_col) == F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    left = F.expr(f"array_join(filter(split(`{text_col}`, '\n', -1), (l, i) -> NOT array_contains(_gone, i)), '\n')")
    counted = rows.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint")).withColumn("removed", F.coalesce("_gone", F.array().cast("array<int>")))
    return counted.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)).drop("_h", "_g", "_id", "_gone")


def op7_line_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest: how many lines each document has, and which go. It leaves out the cleaned texts, so Spark doesn't make them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    positions = F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed")
    return deduplicate(docs).select("doc_id", "n_lines", "n_removed", positions)
