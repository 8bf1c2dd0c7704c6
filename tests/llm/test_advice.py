"""Whole-job tests: stages and operators against brute force where a shortcut could lose results."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from viaduct.llm import decontam, near_dup, toxicity

DOCS = "doc_id long, text string, lang string"


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[i : i + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(10**6)}"]
    return words


def test_near_duplicates_against_brute_force(spark):
    """Copies with edits between none and about 7 % of the words; null and repeated ids; a passage that many share."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for b in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 200))]
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 14)))) for _ in range(6)]
        texts += [" ".join([f"own{b}x{k}" for k in range(rng.randint(2, 60))] + passage)]
    texts += ["", None, "one two", "One  two", "one three", texts[0].upper()]
    ids = [rng.choice([None, 3, *[k + 10] * 6]) for k in range(len(texts))]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append((d is None, d or 0))
    want = Counter(min(v) for v in least.values())
    df = spark.createDataFrame([(d, t, None) for d, t in zip(ids, texts, strict=True)], DOCS)
    got = pipeline.near_duplicates(spark, df, "").collect()
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want
    assert len({find(texts.index(r["text"])) for r in got}) == len(got) == len(least)


def test_radii_meet_sets_at_exactly_the_threshold():
    """Pairs at 0.8, the hardest ones: of 12,000 at most a few lie beyond the radii."""
    rng, lost = np.random.default_rng(0), 0
    for a, b, common in ((4, 5, 4), (5, 6, 5), (8, 10, 8), (16, 20, 16), (20, 25, 20), (36, 36, 32), (100, 125, 100), (270, 270, 240)):
        radii = near_dup.RADII_SMALL if min(a, b) < near_dup.SMALL else near_dup.RADII
        for lanes, times in ((near_dup.LANES, 1500), (near_dup.FINE, 150)):
            near, radius = radii[lanes]
            for _ in range(times):
                x = rng.integers(-(2**63), 2**63 - 1, a + b - common)
                d = np.bitwise_count((near_dup.set_fingerprints(x[:a], lanes) ^ near_dup.set_fingerprints(x[a - common :], lanes)).view(np.uint64))
                lost += bool(d[0] > near or d.sum() > radius)
    assert lost <= 5


def test_near_duplicates_over_many_stripes(spark):
    """A chain of texts, each similar to the next only, over stripes of a few rows."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(160)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 100, 3)] + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: r["component"] for r in near_dup.simhash_groups(df, stripe=8).collect()}
    assert got == {k: 0 if k < 34 else k for k in range(len(texts))}


def counted(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_leaks(docs, items, threshold=0.8):
    """{(doc, item): the best similarity of a window}"""
    found = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, u in items:
            v = (u or "").lower().split()
            if not v or len(w) < min(5, len(v)):
                continue
            b = counted(v, min(5, len(v)))
            for s in range(max(1, len(w) - len(v) + 1)):
                a = counted(w[s : s + len(v)], min(5, len(v)))
                common = sum((a & b).values())
                sim = common / (sum(a.values()) + sum(b.values()) - common)
                if sim >= threshold - 1e-12:
                    found[d, i] = max(sim, found.get((d, i), 0))
    return found


def test_leaks_against_all_windows(spark):
    """Passages whose parts have moved, with words put in, left out or changed."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(5000)}"
    items = [(i, [word() for _ in range(rng.randint(30, 60))]) for i in range(12)] + [(12, ["la", "li", "lo", "lu", "le"] * 8)]
    docs = []
    for d in range(90):
        _, v = items[d % 13]
        cut = rng.randrange(1, len(v))
        v = v[cut:] + v[:cut] if d % 3 == 0 else edited(rng, v, d % 3) if d % 2 else v[d % 4 :]
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 100))] + v + [word() for _ in range(rng.randint(0, 100))])))
    v = items[0][1]
    docs.append((500, " ".join([word() for _ in range(100)] + v[12:] + v[:12] + [word() for _ in range(100)])))
    items = [(i, " ".join(v)) for i, v in items]
    want = brute_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want)
    assert all(abs(s - want[k]) < 1e-9 for k, s in got.items())  # the best window


def test_leaks_of_repeated_rows_and_null_ids(spark):
    """Repeated rows, different texts under one id or none, and items without an id or with a repeated one."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in (None, None, 1, 1, 2)]
    text = lambda k: " ".join([*(word() for _ in range(40)), items[k][1], *(word() for _ in range(40))])
    docs = [(7, text(2))] * 3 + [(None, text(0)), (None, text(3)), (None, " ".join(word() for _ in range(110))), (8, text(4)), (8, text(1)), (8, None), (9, "")]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], r["similarity"]) for r in got) == Counter([(7, 1, 1.0), (None, None, 1.0), (None, 1, 1.0), (8, 2, 1.0), (8, None, 1.0)])


def test_stages_decide_rows_without_an_id_or_with_a_repeated_one(spark, tmp_path):
    rng = random.Random(9)
    body = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(60))
    item, a, b = (body() for _ in range(3))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}", None), (None, a, None), (4, a, None), (4, a, None), (4, b, None), (4, f"{b} {item}", None)]
    df = spark.createDataFrame(rows, DOCS)
    kept = pipeline.benchmark_leaks(spark, df, str(tmp_path))
    assert Counter(map(tuple, kept.collect())) == Counter(rows[1:5])
    assert Counter(map(tuple, pipeline.near_duplicates(spark, kept, "").collect())) == Counter([(4, a, None), (4, b, None)])


def test_toxicity_learns_an_exclusive_or():
    """Either term alone is toxic, both or none are not: the marginals are equal and no sum of weights separates."""
    rng = random.Random(0)
    rows = []
    for k in range(1200):
        has = k % 4
        words = [f"w{rng.randint(0, 300)}" for _ in range(12)] + ["left"] * (has in (1, 3)) + ["right"] * (has in (2, 3))
        rows.append((" ".join(words), int(has in (1, 2))))
    s = toxicity.Scorer(toxicity.fit(rows))
    assert min(s.score("w1 w2 left"), s.score("w1 w2 right")) > 0.5 > max(s.score("w1 w2"), s.score("w1 w2 left right"))


def test_leaks_in_long_texts_odd_columns(spark, monkeypatch):
    """Texts that are cut into many stretches, passages across the cuts, one made of passages only; further columns with names that the plan uses."""
    monkeypatch.setattr(decontam, "STRETCH", 64)
    rng = random.Random(5)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(rng.choice([12, 40, 90])))) for k in range(6)]
    docs = []
    for i in range(8):
        words = [f"d{rng.randrange(10**6)}" for _ in range(rng.randint(50, 700))]
        for k in rng.sample(range(6), 2):
            at = rng.randrange(len(words))
            words[at:at] = edited(rng, items[k][1].split(), rng.choice([0, 1]))
        docs.append((i, " ".join(words)))
    docs += [(100, " ".join(items[1][1] for _ in range(60))), (101, None), (102, ""), (None, items[2][1])]
    want = brute_leaks(docs, items)
    rows = [(i, t, "k", 1, 2, ["w"], 0.5, 3, "x") for i, t in docs]
    odd = spark.createDataFrame(rows, "doc_id long, text string, key string, n int, start int, words array<string>, similarity double, stretch int, item string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(odd, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert {(100, 1), (None, 2)} <= set(got)


def test_leaks_in_a_text_of_passages_only(spark):
    """40,000 words, every window of which can reach the threshold: no row holds them all."""
    item = " ".join(f"w{j}" for j in range(40))
    docs = spark.createDataFrame([(1, " ".join([item] * 1000)), (2, "nothing to see here")], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["start_word"]) for r in got] == [(1, 7, 1.0, 0)]


def test_lower_thresholds_are_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="0.8"):
        near_dup.simhash_groups(spark.createDataFrame([(1, "a")], "row long, text string"), threshold=0.7)


def test_stages_on_odd_and_empty_tables(spark):
    """Null ids and texts, repeated rows, an empty table, further columns: every stage but the last returns the columns of its input."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, component long"
    sf = "/root/testdata/sf0.001"
    rows = [(1, "some plain words of a text " * 3, "en", "s", 1, 1, 1), (1, "some plain words of a text " * 3, "en", "s", 1, 1, 1), (None, None, None, None, None, None, None), (2, "", None, None, 0, None, 2), (None, "another text", "en", None, 5, 4, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= len(given)
        assert pipeline.tokens(spark, docs, sf).count() == len(given)
