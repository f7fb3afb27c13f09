"""Jaccard join, line deduplication, decontamination against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from lodestow.llm import op1_decontamination as op1
from lodestow.llm import op6_jaccard as op6
from lodestow.llm import op7_line_dedup as op7
from lodestow.llm._graph import components
from lodestow.llm._text import shingle_set, word_blocks

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sets(texts, n):
    out = []
    for t in texts:
        w = SPACE.findall(lower(t))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def expected_components(ids, texts, n, p, q):
    s, root = sets(texts, n), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            c = len(s[a] & s[b])
            if c and q * c >= p * (len(s[a]) + len(s[b]) - c):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: (len(x), find(i)) for i, x in zip(ids, s, strict=True)}


@pytest.mark.parametrize(("n", "t"), [(4, (85, 100)), (5, (80, 100))])
def test_components(docs, texts, n, t):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6.jaccard_components(docs, n, t).collect()}
    assert got == expected_components(list(range(len(texts))), texts, n, *t)
    assert len({c for _, c in got.values()}) < len(texts)


def test_components_edges(empty, odd):
    assert op6.jaccard_components(empty).count() == 0
    rows = op6.jaccard_components(odd).collect()
    assert len(rows) == 42
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert all(r.component_id <= r.doc_id for r in rows if r.doc_id is not None)


def test_near_copies_of_one_text(spark):
    """A star of near copies that are far from one another: one component, found through its middle."""
    from .conftest import frame

    base = [f"t{k}" for k in range(200)]
    texts = [" ".join(base)] + [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(3, 190, 2)]
    got = {r.component_id for r in op6.jaccard_components(frame(spark, texts), 4, (85, 100)).collect()}
    assert got == {0}


def test_texts_of_one_id_share_links(spark):
    """Two rows of id 1 hold different texts; copies of either are linked with id 1."""
    from .conftest import frame

    a, b = "one text of six words here", "and another of seven words as well"
    rows = [(1, a), (1, b), (7, b), (8, a), (9, "not the same at all"), (None, a), (1, None)]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op6.jaccard_components(df, 4, (85, 100)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 4, 1), (7, 4, 1), (8, 3, 1), (9, 2, 9), (None, 3, None), (1, 0, 1)], key=str)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5)}


def test_word_blocks_are_words():
    texts = ["Ab  cd\n", None, "", "ab", "x" * 3_000_000 + " ab"]
    got = [list(w[b[k] : b[k + 1]]) for lo, hi, w, b in word_blocks(texts) for k in range(hi - lo)]
    assert [len(x) for x in got] == [2, 0, 0, 1, 2]
    assert got[0][0] == got[3][0] == got[4][1] != got[0][1]
    assert len(shingle_set(np.array(got[0]), 5)) == 1


def expected_lines(rows):
    """rows in order; positions of lines with an earlier line at Jaccard 0.8."""
    seen, out = [], set()
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            w = {x for x in re.split("[\x20\x09-\x0d]+", line.lower()) if x}
            if not w:
                continue
            if any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                out.add((i, pos))
            seen.append(w)
    return out


def line_texts(texts):
    rows = [t.replace(" w3", "\nw3") if t else t for t in texts]
    base = [f"l{k}" for k in range(25)]
    return rows + ["\n".join(" ".join(base[:k] + ["z"] + base[k + 1 :]) for k in range(a, a + 3)) for a in range(0, 20, 4)] + ["same line here\nsame line here\n\n"]


def test_lines(spark, texts):
    from .conftest import frame

    rows = line_texts(texts)
    df = frame(spark, rows)
    got = {(r.id, r.pos) for r in op7.later_matches(df).collect()}
    assert got == expected_lines(list(enumerate(rows)))
    assert len(got) > 10
    clean = {r.doc_id: r for r in op7.deduplicate(df).collect()}
    assert clean[len(rows) - 1].text == "same line here\n\n"
    for i, t in enumerate(rows):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
        assert clean[i].text == kept
        assert clean[i].n_removed == sum(a == i for a, _ in got)


def test_lines_under_pairs_of_hot_tokens(spark, texts, monkeypatch):
    """All tokens hot, so that lines are posted under pairs; and levels with both kinds in a line."""
    from .conftest import frame

    rows = [*line_texts(texts)[:40], "one", "One", "one  two", "two one", "a b c d e\nA B C D e", "a b c d e f g h i\na b c d e f g h"]
    for hot in (0, 8):
        monkeypatch.setattr(op7, "_HOT", hot)
        got = {(r.id, r.pos) for r in op7.later_matches(frame(spark, rows)).collect()}
        assert got == expected_lines(list(enumerate(rows)))


def test_long_lines(spark):
    """Lines of 70 to 140 words: wide bitmaps on both sides, on one, and none."""
    from .conftest import frame

    words = [f"v{k}" for k in range(400)]
    rows = ["\n".join(" ".join(words[a : a + n]) for n in (70, 80, 81, 99, 140)) for a in range(0, 120, 9)]
    got = {(r.id, r.pos) for r in op7.later_matches(frame(spark, rows)).collect()}
    assert got == expected_lines(list(enumerate(rows)))


def test_lines_of_repeated_and_null_ids(spark):
    """Rows of one id with different texts keep their own positions; a line of a row without id is an earlier line."""
    from .conftest import frame

    a, b, c = "p q r s t\nlost words here\nu v w x y", "new line\nu v w x y", "lost words here\nnew line"
    df = frame(spark, [a, b, c, "lost words here"], [1, 1, 2, None])
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed, tuple(r.removed)) for r in op7.deduplicate(df).collect()}
    first, second = sorted((a, b), key=lambda t: spark.sql("SELECT xxhash64(0, :t)", {"t": t}).first()[0])
    rest = [x for x in second.split("\n") if x != "u v w x y" and x != "lost words here"]
    assert got[1, "\n".join(rest)][1] == len(second.split("\n")) - len(rest)
    assert sum(n for _, n, _ in got.values()) == 4  # twice "lost words here", "u v w x y", "new line"
    assert got[2, ""] == (2, 2, (0, 1))
    assert got[None, "lost words here"] == (1, 0, ())


def test_lines_edges(empty, odd):
    assert op7.later_matches(empty).count() == 0
    assert op7.deduplicate(odd).count() == 42


def tile_cover(item, doc, least=5):
    """Greedy tiling word by word, without hashes."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and free_i[p + n] and free_d[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return covered
        free_i[p : p + n] = free_d[q : q + n] = [False] * n
        covered += n


def test_tiles_against_words():
    rng = np.random.default_rng(3)
    for _ in range(40):
        item = rng.integers(0, 4, 18).astype(np.uint64)
        doc = np.concatenate((rng.integers(0, 4, 6), item[9:], rng.integers(0, 4, 3), item[:9])).astype(np.uint64)
        assert sum(n for _, _, n in op1.tiles(item, doc)) == tile_cover(item.tolist(), doc.tolist())


def test_contamination(spark, docs, texts):
    from .conftest import frame

    passage = " ".join(f"q{k}" for k in range(40))
    words = passage.split()
    reordered = " ".join(words[20:] + ["and", "so"] + words[:20])
    planted = [f"before {passage} after", f"start {reordered.upper()}, end", " ".join(words[:15]), "none of it"]
    df = docs.unionByName(frame(spark, planted, [1000, 1001, 1002, 1003]))
    items = spark.createDataFrame([(1, passage), (2, "too short"), (3, None), (1, passage)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in op1.contamination(df, items).collect()}
    assert got == {(1000, 1): (1.0, 1), (1001, 1): (1.0, 2)}


def test_contamination_of_repeated_words(spark):
    """Items with few distinct windows: one word over and over, digits, a phrase repeated."""
    from .conftest import frame

    bits = " ".join(str(b) for b in np.random.default_rng(8).integers(0, 2, 240))
    repeated = ["7 " * 30, bits, "row row row your boat " * 9]
    df = frame(spark, [f"before {t} after" for t in repeated] + ["7 7 7 7 7 and no more", "7 " * 20_000])
    items = spark.createDataFrame(list(enumerate(repeated)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in op1.contamination(df, items).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (4, 0): 1.0}


def test_contamination_edges(spark, empty, odd):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    assert op1.contamination(empty, items).count() == 0
    assert op1.contamination(odd, items.limit(0)).count() == 0
    assert op1.contamination(odd, items).count() == 0


def test_hot_passage_keeps_links(spark):
    """A passage that all texts share makes no link of its own, and hides none."""
    from .conftest import frame

    shared = " ".join(f"p{k}" for k in range(20))
    rows = [f"{shared} " + " ".join(f"d{i}x{k}" for k in range(60)) for i in range(40)]
    rows += [rows[5] + " tail", rows[6].replace("d6x30", "other")]
    got = {r.doc_id: r.component_id for r in op6.jaccard_components(frame(spark, rows), 5, (80, 100)).collect()}
    assert (got[40], got[41]) == (5, 6)
    assert Counter(got.values()).most_common(3)[2][1] == 1


def test_postings_are_dealt_once(spark, monkeypatch):
    """Postings were dealt by key again for each join; and first places were found by a sort of all lines."""
    plans, real, limit = {}, op7.keep, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    explained = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    monkeypatch.setattr(op7, "keep", lambda df, name: (plans.setdefault(name, explained(df)), real(df, name))[1])
    ids = [3, None, -(2**63), 2**63 - 1, 0, -1]
    texts = ["b c d e f\n\na  b\nsame line", "a  b\nalone here", "x y\nsame line\nx y", "x y\na  b", "a b\nb c d e f g", "b c d e f g h\nsame line\na b"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind in ("long", "string"):
            docs = spark.createDataFrame([(i if kind == "long" or i is None else f"{i:+021d}", t) for i, t in zip(ids, texts, strict=True)], f"doc_id {kind}, text string")
            got = {(r.id, r.pos) for r in op7.later_matches(docs).collect()}
            every = [(i, p, frozenset(x.split())) for i, t in sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or (0 if kind == "long" else ""))) for p, x in enumerate(t.split("\n")) if x.split()]
            assert got == {(i, p) for k, (i, p, w) in enumerate(every) if i is not None and any(5 * len(w & v) >= 4 * len(w | v) for _, _, v in every[:k])}
            assert "hashpartitioning(key" not in plans["best"] and "hashpartitioning(key" not in plans["others"]
            assert ("SortAggregate" in plans["firsts"]) == (kind == "string")
            plans.clear()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not spark.catalog.listTables()
