"""Filter audit, vector codes and nearest neighbours against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from lodestow.llm import op11_audit as op11
from lodestow.llm import op12_codes as op12
from lodestow.llm import op13_neighbours as op13

from .conftest import frame

SPACE = re.compile(r"[^\x20\x09-\x0D]+")

# --- 11


def audited(rows, labels):
    """The audit by its definition. rows: (id, text, source); labels: (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, _ in rows:
        t = t or ""
        words = SPACE.findall(t)
        fails.append(
            {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        )
    out, parts = {}, {s or "" for _, _, s in rows}
    for part in parts:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(fails[k][f] for k in mine) - len(gone), sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def check_audit(spark, texts, ids, labels):
    docs = frame(spark, texts, ids)
    got = op11.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string, fails_A string") if labels and len(labels[0]) == 5 else spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited([(r.doc_id, r.text, r.source) for r in docs.collect()], [x[:3] for x in labels])
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want)


def test_audit(spark, texts):
    long = [" ".join(f"{w}{k}" for k in range(230)) for w in ("alpha", "Beta", "GAMMA", "delta #", "echo&\x0b")]
    check_audit(spark, [*texts[:40], *long, *long, "spam " * 300, long[0] + " #", "A\x1cB"], None, [(k, k % 2, int(k % 3 == 0), "clash", "clash") for k in range(0, 50, 2)])


def test_audit_of_odd_rows(spark, texts, empty):
    check_audit(spark, [*texts[:9], *texts[:9], None, "", None, "lost"], [*range(9), *range(9), 5, None, None, 77], [(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, None)])
    assert op11.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_trie_runs_each_state_once(spark):
    rows = spark.createDataFrame([("s", True, False, False, False, True, True, False), ("s", False, False, False, False, False, False, False)], "part string, fails_A boolean, fails_B boolean, fails_C boolean, fails_D boolean, fails_E boolean, good boolean, toxic boolean")
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    edges = op11.audit_edges(rows).collect()
    assert Counter((r.state, r.filter) for r in edges) == Counter((s, f) for s in range(31) for k, f in enumerate("ABCDE") if not s >> k & 1)
    assert {(r.survivors, r.removed) for r in edges if r.state == 1} == {(1, 0)}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held  # every survivors' frame is given back


# --- 12

VECTORS = "vec_id long, embedding array<float>, label int, code string, codes string, vector string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "clash", "clash", "clash") for i, v, y in rows], VECTORS)


def coded(rows, entries=256, rounds=4):
    """Lloyd's rounds by their definition, over Python's integers."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    dim = -(-max(len(r[1]) for r in rows) // 4) * 4
    points = [[int(np.floor(float(np.float32(x)) * 1024)) for x in r[1]] + [0] * (dim - len(r[1])) for r in rows]
    w = dim // 4
    parts = [[p[k * w : (k + 1) * w] for p in points] for k in range(4)]
    books = [[list(v) for v in part[:entries]] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(book)), key=lambda e: (far(v, book[e]), e)) for v in part] for part, book in zip(parts, books, strict=True)]
    for _ in range(rounds):
        for k, codes in enumerate(nearest()):
            for e in set(codes):
                own = [v for v, c in zip(parts[k], codes, strict=True) if c == e]
                books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = nearest()
    error = [sum(far(parts[k][i], books[k][codes[k][i]]) for k in range(4)) for i in range(len(rows))]
    out = Counter((r[0], r[2], "".join(f"{codes[k][i]:02x}" for k in range(4)), min(error[i], 2**63 - 1)) for i, r in enumerate(rows))
    return out, op12.codebooks_sha256([np.array(b, dtype=object) for b in books])


def check_codes(spark, rows, **options):
    out, books = op12.compress(vector_frame(spark, rows).repartition(3), **options)
    want, digest = coded(rows, **options)
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in out.collect()) == want
    assert op12.codebooks_sha256(books) == digest
    return books


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.integers(-3, 4, 8) / 64 if k % 2 else rng.normal(size=8)).tolist(), k % 4 or None) for k in range(260)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(60)]
    check_codes(spark, rows, entries=20)
    check_codes(spark, rows[:90])


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1, 2, 3, 4, 5, 6, 7, 8], 1), (5, [1, 2, 3, 4, 5, 6, 7, 8], 1), (4, None, 1), (3, [1, None, 2, 3], 2), (2, [nan, 1, 1, 1], 2), (1, [1, inf, 1, 1], 2), (0, [-0.5, 0.25, 9], None), (None, [0.0] * 5, None), (None, [], 7)]
    check_codes(spark, rows)
    check_codes(spark, [*rows, (9, [3e30, -3e30, 1, 1], 1), (10, [2e7, 2e7, -1, 1], 1)], entries=3)
    out, books = op12.compress(vector_frame(spark, []))
    assert out.count() == 0
    assert op12.compress(vector_frame(spark, [(1, None, 1)]))[0].count() == 0


def test_bounds_hold_and_save_scans(spark):
    """After each round upper and lower enclose the true distances, and points away from every border take no scan."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 4))
    points = (centres[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 4))).astype(float)
    book = points[:16].copy()
    codes, near, second = op12._scan(points, book)
    scans = []
    for _ in range(5):
        new = np.array([np.floor(points[codes == e].sum(0) / max((codes == e).sum(), 1)) if (codes == e).any() else book[e] for e in range(16)])
        moved = np.sqrt(op12._own(new, book))
        book = new
        codes, near, second, scanned = op12.reassign(points, book, moved, codes, near, second)
        d = np.sqrt(op12.squared(points, book))
        assert (codes == d.argmin(1)).all()
        own = d[np.arange(2000), codes]
        d[np.arange(2000), codes] = np.inf
        assert (near >= own).all() and (second <= d.min(1) + 1e-9).all()
        scans.append(scanned)
    assert scans[-1] < 400


def test_decoding_is_closer_than_any_other_code(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=16).tolist(), 1) for k in range(300)]
    out, books = op12.compress(vector_frame(spark, rows), entries=32)
    for r in out.collect()[:20]:
        x = np.floor(np.float32(rows[r.vec_id][1]).astype(float) * 1024)
        assert ((op12.decode(r.code, books) * 1024 - x) ** 2).sum() == r.error


# --- 13


def neighbours(rows, queries, k):
    usable = [(i, np.float32(v).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, dim - len(v)))) for i, v in usable]
    out = {}
    for q in {i for i, _ in usable if i in queries}:
        best = {}
        for i, v in usable:
            if i != q:
                best[i] = max(best.get(i, -np.inf), *(float((v * w).sum()) for j, w in usable if j == q))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def search(spark, rows, every=20, **options):
    df = vector_frame(spark, rows).repartition(4)
    got = {}
    for r in op13.nearest(df, df.where(f"vec_id % {every} = 0"), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got, neighbours(rows, {i for i, _, _ in rows if i is not None and i % every == 0}, options.get("k", 20))


@pytest.mark.parametrize("scale", [1, 30])
def test_recall(spark, scale):
    """Random directions, the hardest case, of equal and of very different lengths."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x *= rng.uniform(1, scale, (1500, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    got, want = search(spark, [(k, v.tolist(), 1) for k, v in enumerate(x)])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all(list(v) == sorted(v) for v in got.values())


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    nan, inf = float("nan"), float("inf")
    rows = [(k, x[k % 60 if k < 60 else 0].tolist(), None) for k in range(400)]
    rows += [(20, x[7].tolist(), 1), (21, x[3].tolist(), 1), (21, x[3].tolist(), 1), (None, x[2].tolist(), 1), (500, None, 1), (520, [0] * 8, 1), (540, [nan] * 8, 1), (560, [inf, 1], 1), (580, [1, None], 1), (600, [], 1), (620, [0.5, 0.25], 1)]
    got, want = search(spark, rows, every=20)
    assert got.keys() == want.keys()
    hot = [q for q in want if 60 <= q < 400 or q == 0]
    assert all([i for _, i in got[q]] == [i for _, i in want[q]] for q in hot)  # its copies, the smallest ids first
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_few_rows_are_all_found(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=5).tolist(), 1) for k in range(12)]
    got, want = search(spark, rows, every=4)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert search(spark, rows[:1], every=1)[0] == {} == search(spark, [], every=1)[0]


def test_more_hashes_and_split_buckets_find_as_much(spark, monkeypatch):
    """Buckets of two hashes, tiles of some rows: the same recall, by more probes."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + rng.normal(size=16) / 4).tolist(), 1) for k in range(1200)]
    monkeypatch.setattr(op13, "BUCKET", 8)
    monkeypatch.setattr(op13, "TILE", 16)
    got, want = search(spark, rows)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_probes_begin_with_the_own_bucket():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 15))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for hashes in (1, 2):
        p = op13.Polytopes(15, 1.0, 2, hashes)
        assert p.size == 16 and (p.probes(x, 1, 5)[:, 0] == p.buckets(x, 1)).all()
    y = p.rotate(p.lift(x, False), 0, 0)[:, :16]
    assert np.allclose(y @ y.T, x @ x.T)
