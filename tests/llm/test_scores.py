"""Language model, quality, fingerprints, mixing, sharding, personal data and pages."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestow.llm import op2_pii as op2
from lodestow.llm import op3_fingerprint as op3
from lodestow.llm import op4_quality as op4
from lodestow.llm import op5_sharding as op5
from lodestow.llm import op8_lm as op8
from lodestow.llm import op9_mixing as op9
from lodestow.llm import op10_html as op10

from .conftest import frame

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


# --- 8


def scores(docs, **options):
    df = docs.withColumn("held_out", op8.held_out(F.col("doc_id")))
    return {r.doc_id: r for r in op8.score(df, df.where(~F.col("held_out")).select("text"), **options).collect()}


def model_probability(counts, context, word, order, least, base):
    """The backoff model by its definition."""
    for n in range(min(order, len(context) + 1), 1, -1):
        h = context[len(context) - n + 1 :]
        if counts[n][(*h, word)] >= least and counts[n - 1][h] >= least:
            return (counts[n][(*h, word)] - op8.DISCOUNT) / counts[n - 1][h]
        arcs = {g: c for g, c in counts[n].items() if g[:-1] == h and c >= least}
        if arcs and counts[n - 1][h] >= least:
            kept = sum((c - op8.DISCOUNT) / counts[n - 1][h] for c in arcs.values())
            below = sum(model_probability(counts, h[1:], g[-1], n - 1, least, base) for g in arcs)
            return (1 - kept) / (1 - below) * model_probability(counts, h[1:], word, n - 1, least, base)
    return base(word)


def test_scores(docs, texts):
    got = scores(docs)
    train = [tokens(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = {n: Counter(tuple(t[k : k + n]) for t in train for k in range(len(t) - n + 1)) for n in (1, 2, 3)}
    total, distinct = sum(counts[1].values()), len(counts[1])
    base = lambda w: (counts[1][(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
    for i, t in enumerate(texts):
        w, r = tokens(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[1][(x,)] > 0 for x in w), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10(base(x)) for x in w), rel_tol=1e-9)
        if len(w) < 70:
            own = sum(math.log10(model_probability(counts, tuple(w[:k]), w[k], 3, op8.LEAST, base)) for k in range(len(w)))
            assert math.isclose(r.score, own, rel_tol=1e-6), (i, r.score, own)


def test_rare_words_by_join(docs):
    """With few states most counts come by the join, and base scores are the same."""
    a, b = scores(docs), scores(docs, share=0.01)
    assert all(math.isclose(a[i].base_score, b[i].base_score, rel_tol=1e-9) and a[i].n_known == b[i].n_known for i in a)


def test_rare_states_by_join(docs):
    """What is sent to the tasks does not change what is a state."""
    a, b = scores(docs), scores(docs, share=0.01)
    assert all(math.isclose(a[i].score, b[i].score, rel_tol=1e-9) for i in a)
    assert any(abs(a[i].score - a[i].base_score) > 1 for i in a)


def test_score_edges(empty, odd):
    assert op8.score(empty, empty.select("text")).count() == 0
    rows = op8.score(odd, odd.select("text").limit(0)).collect()
    assert len(rows) == 42 and all(r.train_tokens == 0 and r.n_known == 0 and r.row == "clash" for r in rows)


# --- 4


def quality_data(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{k}" for k in rng.zipf(1.3, 80) if k < 500]
        if bad:
            words[::9] = ["awful"] * len(words[::9])
        rows.append(" ".join(words))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_data(spark)
    kept = {r.doc_id for r in op4.resample(docs, labels, share=0.75).collect()}
    assert len(kept) == 450
    unlabelled = [i for i in range(600) if i % 2 and i % 5]
    assert sum(i in kept for i in unlabelled if i % 4) >= 0.97 * sum(i % 4 > 0 for i in unlabelled)
    assert sum(i % 4 == 0 for i in kept) <= 10
    assert kept == {r.doc_id for r in op4.resample(docs.repartition(3), labels, share=0.75).collect()}


def test_quality_against_counts_of_features(spark):
    """Weights, keys and edge made again from whole features, without tables of hashes."""
    docs, labels = quality_data(spark)
    rows, edge = op4.sampled(docs, labels, share=0.5)
    got = {r.id: r for r in rows.collect()}

    def features(t):
        bare = re.findall("[a-z0-9]+", t.lower())
        return {("raw", w) for w in t.split()} | {("bare", w) for w in bare} | set(itertools.pairwise(bare))

    sets = {r.doc_id: features(r.text) for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = (Counter(f for i in ids for f in sets[i]) for ids in (sets, good))
    share, ratio = len(good) / len(sets), {}
    for f, n in raw.items():
        z = (target[f] - n * share) / math.sqrt(n * share * (1 - share))
        ratio[f] = math.log((target[f] + op4.SMOOTH) / (n * share + op4.SMOOTH)) * z**4 / (z**4 + op4.SURE**4)
    apart = sorted(abs(got[i].log_weight - sum(ratio[f] for f in sets[i])) for i in sets)
    assert apart[len(sets) * 3 // 4] < 1e-3 and apart[-1] < 1  # some of the thousands of pairs share a bucket
    # The noise is Gumbel noise of the id: its mean is Euler's constant, and the same on each run.
    noise = [r.sample_key / op4._FIXED - (1 << 20) - r.log_weight for r in got.values()]
    assert abs(np.mean(noise) - 0.5772) < 0.2 and abs(np.std(noise) - 1.2825) < 0.2
    assert sum(r.sample_key >= edge for r in got.values()) == 300


def test_quality_edges(spark, empty, odd):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert op4.resample(empty, labels).count() == 0
    assert op4.resample(odd, labels.limit(0), share=1.0).count() == 42
    assert 30 <= op4.resample(odd, labels.limit(0)).count() < 42
    assert op4.resample(odd, labels).count() > 0


# --- 3


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in op3.fingerprints(docs, parts=4).collect()}
    n = len(texts)
    prints = {}
    for i in range(n):
        a, b = texts[i] or "", texts[(i + 1) % n] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(a, set()).add(got[i].fingerprint)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    assert len(got) == n


def test_likeness_follows_overlap():
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(words[:400]), " ".join(words[:360] + words[1000:1040]), " ".join(words[:200] + words[1000:1200]), " ".join(words[1000:1400]), " ".join(words[:400])]
    c = op3.codes(texts, np.empty(0, np.uint64))
    near = [float(op3._likeness(c[:1], c[k : k + 1])[0]) for k in range(1, 5)]
    assert near[3] == 1.0 and near[0] > near[1] > near[2] == 0.0


def test_fingerprints_of_copies(spark):
    """However often a text is repeated, its terms stay in the lexicon, and its edited text is like it."""
    rng = np.random.default_rng(6)
    rows = [" ".join(f"v{k}" for k in rng.integers(0, 3000, 60)) for _ in range(200)]
    copied = " ".join(f"c{k}" for k in range(60))
    mixed = [t for k, t in enumerate(rows) for t in ((t, copied) if k % 2 else (t,))]
    once = op3.lexicon(frame(spark, [*rows, copied]).select("text"))
    assert np.array_equal(op3.lexicon(frame(spark, mixed).select("text")), once)
    likeness = {r.doc_id: r.near_edited for r in op3.fingerprints(frame(spark, mixed), parts=2).collect()}
    assert all(likeness[k] > 0.02 for k, t in enumerate(mixed) if t == copied)


def test_texts_outside_the_lexicon_are_compared_by_all_terms(spark, monkeypatch):
    monkeypatch.setattr(op3, "lexicon", lambda docs: np.sort(np.concatenate([w for _, _, w, _ in op3.word_blocks([" ".join(f"v{k}" for k in range(60))], space=op3.PUNCT)])))
    rows = frame(spark, [" ".join(f"c{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))])
    assert min(r.near_edited for r in op3.fingerprints(rows, parts=1).collect()) > 0.02


def test_fingerprint_edges(spark, empty, odd):
    assert op3.fingerprints(empty).count() == 0
    assert op3.fingerprints(odd, parts=3).count() == 42
    one = op3.fingerprints(frame(spark, ["only one here"]), parts=3).first()
    assert one.near_next == 1.0


# --- 9


def test_sainte_lague_against_quotients():
    rng = np.random.default_rng(2)
    for _ in range(60):
        votes, seats = [float(v) for v in rng.integers(0, 50, 6)], int(rng.integers(0, 40))
        quotients = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) for k in range(seats) if v), reverse=True)[:seats]
        won = Counter(-i for _, i in quotients)
        assert op9.sainte_lague(votes, seats) == [won[i] for i in range(6)]


def test_targets():
    assert op9.targets([10, 10, 10]) == [20.0, 16.666666666666668, 8.333333333333334]
    assert op9.targets([]) == [] and op9.targets([0, 4]) == [0.0, 6.0]
    assert sum(op9.targets([1, 100, 3, 70])) == pytest.approx(261)


def test_mix(docs, texts):
    got = {r.doc_id: r for r in op9.mix(docs).collect()}
    size = [len(SPACE.findall(t or "")) for t in texts]
    assert [got[i].size for i in range(len(texts))] == size
    source = [f"s{k % 3}" if k % 7 else None for k in range(len(texts))]
    order = ["s0", "s1", "s2", None]
    total = {s: sum(n for n, t in zip(size, source, strict=True) if t == s) for s in order}
    goal = dict(zip(order, op9.targets([total[s] for s in order]), strict=True))
    taken = Counter()
    for i, s in enumerate(source):
        assert (got[i].source_size, got[i].target) == (total[s], goal[s])
        assert 0 <= got[i].taken <= 2 * size[i]
        taken[s] += got[i].taken
    assert all(abs(taken[s] - goal[s]) <= 2 * op9.BLOCK for s in order)
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in op9.mix(docs.repartition(3)).collect()}


def test_each_shard_gets_its_quota_of_each_source(docs):
    """Blocks counted shard by shard against the quotients; a block that two documents share goes to one shard."""
    blocks, goal = {}, {}
    for r in op9.mix(docs, shards=7).collect():
        goal[r.m_source] = r.target
        assert sum(p.b - p.a for p in r.parts) == r.taken
        for x in {p.x for p in r.parts}:
            shards = sorted(p.shard for p in r.parts if p.x == x)
            assert blocks.setdefault((r.m_source, x), shards) == shards
    order = ["s0", "s1", "s2", None]
    upto = op9.quotas([goal[s] for s in order], round(sum(goal.values()) / op9.BLOCK), 7)
    got = Counter((s, k) for (s, _), shards in blocks.items() for k in shards)
    for k in range(7):
        assert [got[s, k] for s in order] == [upto[k][i] - (upto[k - 1][i] if k else 0) for i in range(4)]


def test_permutation_of_large_sources():
    for n in (1, 2, 3, 10, 1 << 20, (1 << 40) + 12):
        assert np.gcd(op9._step(n), n) == 1 or n == 1
        assert op9._step(n) * n < 1 << 63


def test_mix_edges(empty, odd):
    assert op9.mix(empty).count() == 0
    assert op9.mix(odd).count() == 42


# --- 5


def test_shards(docs, texts):
    got = op5.shard(docs, 4).collect()
    assert {r.doc_id for r in got} == set(range(len(texts))) and len(got) == len(texts)
    for s in range(4):
        assert sorted(r._asdict()["slot"] if hasattr(r, "_asdict") else r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["size"] == "clash" and r["_size"] == len((r["text"] or "").encode()) + 16 for r in got)


def test_shard_bytes(spark):
    rows = frame(spark, ["y" * (k % 97) for k in range(6000)])
    by = Counter()
    for r in op5.shard(rows.drop("size"), 40).collect():
        by[r["shard"]] += r["size"]
    mean = sum(by.values()) / 40
    assert len(by) == 40 and max(abs(b - mean) for b in by.values()) <= 0.04 * mean


def test_shard_edges(empty, odd):
    assert op5.shard(empty, 4).count() == 0
    rows = op5.shard(odd, 3).collect()
    assert len(rows) == 42
    for i in range(20):
        assert len({r["shard"] for r in rows if r["doc_id"] == i}) == 1


# --- 2

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t) if valid(kind, m[0])]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


HARD = [
    "a@b.c._x@d.e and x@y.z@q.r.s mail me@site.example.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 1.2.3.0000000000000000000000255", "4539 1488 0343 6467 and 4539-1488-0343-6468 4539148803436467 12",
    "+1 (212) 555-0100 +49.30.1234567 ++12 345 678 90123 +1 2", "\U0001f600 é me@a.b 10.0.0.1 \U0001f600 +4420 7946 0958", "@a.b a@ a@.b .@a.b a@b..c 5 - 5", None, "", "a" * 20000 + " " + "1." * 5000 + "@" * 50,
]


def test_base_spans(spark):
    rng = np.random.default_rng(1)
    fuzz = ["".join(rng.choice(list("a.@1 2-+()5"), 60)) for _ in range(300)]
    rows = frame(spark, HARD + fuzz)
    for r in op2.find(rows).collect():
        t = (HARD + fuzz)[r.doc_id] or ""
        assert [(b.kind, b.s, b.e) for b in r.base] == plain_spans(t), t[:100]


def test_disclosing_terms(spark):
    """A word that is met with one address only gives it away; words of every line do not."""
    rng = np.random.default_rng(4)
    rows = [" ".join(f"c{k}" for k in rng.integers(0, 30, 12)) for _ in range(300)]
    rows += [f"Zorblax wrote c{k} from zed@corp.example today c{k + 3}" for k in range(4)]
    got = {r.doc_id: r for r in op2.sanitise(frame(spark, rows)).collect()}
    assert got[0].sanitised is None and got[0].terms == []
    spans = {(t.s, t.e, t.action) for t in got[300].terms}
    assert (0, 7, "remove") in spans
    assert not any(t.value.startswith("c") for t in got[300].terms)
    assert "[email]" in got[301].sanitised and "Zorblax" not in got[301].sanitised and "zed@" not in got[301].sanitised


def test_pii_edges(empty, odd):
    assert op2.find(empty).count() == 0
    assert op2.find(odd).count() == 42


# --- 10

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text.</p><p>Second one.</p></article><footer>Copy</footer></body></html>", "Title & more\nFirst bold text.\nSecond one."),
    ("<div class='sidebar'><p>Links here</p></div><main><p>Body text that is long enough to be read.</p><div class='comments'><p>Nice post!</p></div></main>", "Body text that is long enough to be read."),
    ("<article><p>One<script>var t='</p>';</script> two<!-- no --> three<p>Four &lt;5&gt; &#65;&eacute;</article>", "One two three\nFour <5> Aé"),
    ("<header>Site</header><form><p>Sign up now</p></form><article><p>Cut off in a tag <b", "Cut off in a tag"),
    ("<div id='cookie-notice'>We use cookies.</div><div id='content'><ul><li>First item of the list.</li><li>Second item.</li></ul></div>", "First item of the list.\nSecond item."),
    (None, ""),
    ("", ""),
    ("<nav>only</nav>", ""),
    # A wrapper's kind or name must not take the article along, nor an innocent name a section of it.
    ("<form><div class='content no-sidebar'><article><p>One two three four five six.</p></article></div></form>", "One two three four five six."),
    ("<form><p>" + "Many words make a text. " * 6 + "</p><fieldset><div>Your name</div></fieldset></form>", ("Many words make a text. " * 6).strip()),
    ("<article><h1>T</h1><section class='search-algorithms'><p>Binary search halves a range.</p></section></article>", "T\nBinary search halves a range."),
    ("<article><h1>T</h1><p>A text.</p><div id='alert'><p>Flood alert levels are explained here.</p></div></article>", "T\nA text.\nFlood alert levels are explained here."),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", "So x=1 holds."),
    # Long texts of readers, teasers and adverts go with what they lie in.
    ("<main><p>Body text.</p><section class='comments'>" + f"<p>{'I have a long opinion on this. ' * 9}</p>" * 7 + "</section></main>", "Body text."),
    ("<aside><article><h3>Teaser of something</h3><p>Read this other story, it is long enough.</p></article></aside><article><p>Real.</p></article>", "Real."),
    ("<p hidden>Not to be seen by any reader.</p><article><p>Seen.</p></article><div class='ad-slot'>Buy this now, it is the best there is.</div>", "Seen."),
]


def test_pages(spark):
    df = spark.createDataFrame([(k, "u", p, "clash") for k, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in op10.extract(df).collect()}
    for k, (_, expected) in enumerate(PAGES):
        assert (got[k].text, got[k].n_chars) == (expected, len(expected))
    assert op10.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inside = r.html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert op10.main_text(r.html) == "\n".join(x for x in parts if x)


def test_edges_decide():
    """By its own words alone an advert's sentence is text and an article's short line is none; the cut labels both right."""
    page = "<div class='ad'>Nine words that read like a sentence of text.</div><article><h1>A title of it</h1><p>So</p><p>Words follow here.</p></article>"
    found = op10.blocks(page)
    scores, edges = op10.network(found)
    assert [s > 0 for s in scores[:4]] == [True, True, False, True]
    assert op10.min_cut(scores, edges)[:4] == [False, True, True, True]
    assert op10.min_cut(scores, [])[:4] == [True, True, False, True]


def test_min_cut_is_minimal():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = 7
        s = rng.normal(0, 2, n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda x: sum(max(-v, 0) if k else max(v, 0) for k, v in zip(x, s, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert cost(op10.min_cut(s, edges)) == pytest.approx(best)


def test_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {k} with some words.</p>" for k in range(5000)) + "</article><footer>end</footer>"
    assert op10.main_text(page).count("\n") == 4999
