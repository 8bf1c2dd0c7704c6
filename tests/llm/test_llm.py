"""Small tests of the training-data operators: libraries, brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import importlib.util
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from viaduct.llm import automaton, bpe, chat, components, decontam, exact_dedup, langid, line_dedup, quality, simhash, token_count, toxicity
from viaduct.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_lines long, fp long, digest string"
ODD = ["", None, " ", "\n", "\n\n", "a", "A", "\t \n x", "日本語 テキスト 🙂👍🏽 é", "<|endoftext|>a<|endoftext|>", "x" * 3000, "it's  we'd b\x1cc \x1d d\x85e", "= " * 500, "word " * 2000, " a b", "ﬁ½²٣"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [(i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "null id", None, None, 1, 0.5, 1, 3, 4, "d"), (None, None, None, None, None, None, None, None, None, None), (3, "other text with id three", "en", "s", 1, 1.0, 1, 1, 1, "x")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, n=200):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def fuzz(n, alphabet, longest=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_automaton_equals_merging_by_rank():
    rng = random.Random(0)
    for trial in range(40):
        names = ["a", "b", "c"]
        merges = []
        for _ in range(12):
            u, v = rng.choice(names), rng.choice(names)
            if u + v not in names:
                names.append(u + v)
                merges.append((u, v))
        ids = {t: i for i, t in enumerate(names)}
        a = automaton.MergeAutomaton(len(names), [0, 1, 2], [(ids[u], ids[v], ids[u + v]) for u, v in merges], {i: t for t, i in ids.items()})
        for text in fuzz(200, "aab" if trial % 2 else "abc", 14, trial):
            parts = list(text)
            for u, v in merges:
                i = 0
                while i + 1 < len(parts):
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert [names[t] for t in a.path(text)] == parts


def test_bpe_equals_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("byte_bpe_50k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.loaded(path)
    for t in [*texts(spark), *fuzz(1500, "abeEthin  \n\t'sdl1290.,!@éß日　\x1c\x85\xa0<|endoftx>"), *fuzz(1500, "ae  \n\t'sd19.\x1c\x1f\x0b\x7f\x00"), *fuzz(500, "a \té'\x1c\x1f\x85\u2028\u200b"), *(t or "" for t in ODD)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_texts(odd, path).collect()
    assert len(rows) == odd.count() and Counter(r["decoded"] for r in rows) == Counter(r["text"] or "" for r in odd.collect())
    ids = bpe.encode_texts(odd, path, decoded=False)
    assert Counter(r["decoded"] for r in bpe.decode_ids(ids, path).collect()) == Counter(r["decoded"] for r in rows)


def test_token_counts_equal_the_library(spark, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), token_count.loaded(path)
    for t in [*texts(spark), *fuzz(3000, "      abeEthin\n\t'sdl1290.,!@éß日　▁=—xq", 60), *(t or "" for t in ODD)]:
        n = len(lib.encode(t))
        assert own.count(t) == n
        for chunk in (1, 2, 7):  # state maps of any chunks compose to the same count
            if len(t) < 200:
                assert own.count(t, chunk) == n
    got = token_count.count_tokens(odd, path).collect()
    assert Counter((r["n_bytes"], r["n_tokens"]) for r in got) == Counter((len((r["text"] or "").encode()), len(lib.encode(r["text"] or ""))) for r in odd.collect())


def test_token_counts_with_a_full_table_and_without_resets(spark, monkeypatch):
    """A table that is emptied again and again, and long texts without a space mark, over chunks of any size."""
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), token_count.PieceCounter(path)
    monkeypatch.setattr(token_count, "MOST", 40)
    for t in [*texts(spark, 20), "".join(texts(spark, 30)).replace(" ", ""), "日本語テキスト" * 500, "a" * 5000, " " * 700 + "x" + " " * 33]:
        assert own.count(t, 64) == own.count(t) == len(lib.encode(t))
        maps = [own.chunk_map(t[i : i + 50], not i) for i in range(0, len(t), 50)]
        assert [m[1][1] + 1 for m in own.scan(maps)][:40] == [len(lib.encode(t[: i + 50])) for i in range(0, len(t), 50)][:40]  # prefixes


def test_cuckoo_index_against_a_dict():
    rng = random.Random(5)
    index, plain = exact_dedup.CuckooIndex(4), {}
    for _ in range(8000):
        d = hashlib.sha256(str(rng.randint(0, 1500)).encode()).digest()
        if rng.random() < 0.4:
            assert index.delete(d) == plain.pop(d, None)
        elif d not in plain:
            plain[d] = (rng.random(), 1)
            index.insert(d, plain[d])
        assert index.get(d) == plain.get(d)
    assert len(index) == len(plain) and index.resizes > 0
    assert all(index.get(d) == v for d, v in plain.items())


def test_exact_dedup(odd, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], (r["text"] or "").translate(low)) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter()
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(odd).collect())) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_lines(rows, min_docs=5, min_chars=40):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(low)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in top or top[key(x)] == i]
        yield i, len(ls), len(ls) - len(kept), "\n".join(kept)


def test_line_dedup_against_brute_force(spark, odd, empty):
    rng = random.Random(2)
    common = [f"This is a common line number {k} that many documents share." for k in range(6)]
    rows = [(i, "\n".join(rng.choice([*common, common[0].upper(), "  " + common[1] + "\t", "short", "", f"own line of document {i} with enough characters in it"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, common[0]), (7, common[2] + "\n" + common[2]), (61, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=5, fanout=2)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == Counter(brute_lines(rows))
    got = line_dedup.line_dedup(odd)
    assert sorted(got.columns) == sorted({*odd.columns, "n_dropped"})
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_runs_hold_each_key_once(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}", fanout=2)
    batches = [[(b"a", 1), (b"b", 1)], [(b"b", 2), (b"c", 2)], [(b"a", 3), (b"d", 3), (b"d", 4)], []]
    for b in batches:
        frame = spark.createDataFrame(b, "key binary, doc_id long")
        runs.add(frame)
    assert sorted(bytes(r["key"]) for r in runs.runs().collect()) == [b"a", b"b", b"c", b"d"]
    assert sorted((bytes(r["key"]), r["n"], r["top"]) for r in runs.totals().collect()) == [(b"a", 2, 3), (b"b", 2, 2), (b"c", 1, 2), (b"d", 2, 4)]
    assert [bytes(r["key"]) for r in runs.fresh(spark.createDataFrame([(b"a", 9), (b"z", 9)], "key binary, doc_id long")).collect()] == [b"z"]
    assert len(runs.levels) > 1
    merged = [spark.table(name) for level in runs.levels for name in level]
    with line_dedup._sorted_buckets(spark):  # no run is shuffled or sorted again
        plan = merged[0].join(merged[-1].select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "gone", "gone_id", "lines", "kept", "doc", "key", "__gone", "a.b"]
    line = "a line of more than forty characters that they share"
    df = spark.createDataFrame([(k, line, *range(8)) for k in range(6)], ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names))
    got = line_dedup.line_dedup(df)
    assert got.columns == [*names, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"], r["gone"], r["a.b"], r["n_dropped"]) for r in got.collect()) == [*((k, "", 0, 7, 1) for k in range(5)), (5, line, 0, 7, 0)]


def test_chat_escapes_are_reversible():
    parts = [*chat.CONTROL, *(c[0] + "\\" + c[1:] for c in chat.CONTROL), "\\", "<", "[", "|", "a", "\n", "</", "<|", "turn|>"]
    rng = random.Random(3)
    for _ in range(3000):
        messages = [(rng.choice(["user", "assistant", "", rng.choice(parts)]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.render(messages)
        assert chat.parse(text) == messages
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]
        assert not any(c in chat.escape(t) for c in chat.CONTROL for _, t in messages)


def test_chat_folds_events(spark):
    log = [
        (1, 0, "message", "user", "hi", None), (1, 1, "message", "assistant", "he", None), (1, 2, "delta", "assistant", "llo", 1), (1, 3, "edit", "user", "hey", 0),
        (1, 4, "message", "user", "more", None), (1, 5, "message", "assistant", "bad", None), (1, 6, "regenerate", None, "go", None), (1, 7, "delta", None, "od", None),
        (2, 0, None, None, None, None), (None, 0, "message", "user", "no id", None), (3, 0, "delta", "assistant", "first", 9),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, event string, role string, text string, target long")
    out = defaultdict(str)
    for r in sorted(chat.format_chats(df, event="event", target="target").collect(), key=lambda r: r["part"]):
        out[r["conv_id"]] += r["formatted"]
    assert chat.parse(out[1]) == [("user", "hey"), ("assistant", "hello"), ("user", "more"), ("assistant", "good")]
    assert chat.parse(out[2]) == [("", "")] and chat.parse(out[None]) == [("user", "no id")] and chat.parse(out[3]) == [("assistant", "first")]


def test_chat_parts_join_to_the_same_digest(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (chat.read_back(chat.format_chats(df, chunk=c)).collect() for c in (512, 7))
    assert a == b and a[0]["n_turns"] == 50
    assert a[0]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_fingerprint(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(low))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_memo_keeps_no_long_keys():
    from viaduct.llm.common import Memo

    m = Memo(len, cap=3)
    assert [m["x" * n] for n in (1, 2, 3, 4, 500, 1, 500)] == [1, 2, 3, 4, 500, 1, 500]
    assert max(map(len, [*m, *m.old])) == 4 and len(m) <= 3 and len(m.old) <= 3


def test_simhash_against_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000 + k, " ".join(f"w{j if j != k else -j}" for j in range(400))) for k in range(40)], "doc_id long, text string")
    for df in (docs.union(more), odd):
        rows = df.collect()
        fps = [brute_fingerprint(r["text"]) for r in rows]
        want = Counter(zip((r["doc_id"] for r in rows), fps, brute_components([r["doc_id"] for r in rows], fps), strict=True))
        got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(df).collect())
        assert got == want
    assert simhash.simhash_components(empty).count() == 0


def test_near_pairs_over_many_stripes(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *(base[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(8))]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.near_pairs(df, 4, stripe=16)).collect()}
    want = brute_components(x.view(np.int64).tolist(), x.tolist())
    assert [got.get(v, v) for v in x.view(np.int64).tolist()] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 900)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(121)} | {500 + i: 500 for i in range(60)}


def test_leaks_find_planted_passages(spark, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(30)] + [(100, "tiny item"), (101, ""), (102, None), (103, items_text := "one two three four five six seven eight nine ten eleven twelve")]
    docs, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            i, t = items[d % 30]
            at = rng.randint(0, len(body))
            body[at:at] = (t.upper() if d % 2 else t.replace(" ", ", ")).split(" ")
            want.add((d, i))
        docs.append((d, " ".join(body)))
    docs += [(1000, items_text), (1001, items_text.replace("six", "6")), (1002, None), (1003, ""), (1004, "a tiny item here"), (1005, "five six seven eight nine")]
    want |= {(1000, 103), (1004, 100)}
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["similarity"] >= 0.8 for r in got)
    assert decontam.leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_hamming_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-(2**63), 2**63 - 1, 60)
    b = np.concatenate([a ^ np.int64(int(sum(1 << int(k) for k in rng.choice(63, n, replace=False)))) for n in (0, 3, 10, 16, 17)])
    left = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(a)], "i long, fp long, k int")
    right = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(b)], "j long, other_fp long, k int")
    got = [(r["i"], r["j"]) for r in decontam.hamming_pairs(left, right, 16, ["k"]).collect()]
    assert sorted(got) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (int(x) ^ int(y)).__and__(2**64 - 1).bit_count() <= 16]


def split(spark, label, sf="/root/testdata/sf0.01"):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", label).collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    return [(r[1], r[2]) for r in rows if not out(r[0])], [(r[1], r[2]) for r in rows if out(r[0])]


def test_quality_on_held_out_rows(spark):
    train, test = split(spark, "quality")
    w = quality.fit(train)
    assert np.mean([(quality.score(w, t) >= 0.3) == y for t, y in test]) >= 0.97
    assert all(0 <= quality.score(w, t) <= 1 for t in ODD)
    assert quality.score(quality.fit([]), "x") == 0.5 and quality.score(quality.fit([("a", 1)]), "b") > 0.99


def test_quality_equals_plain_follow_the_regularised_leader():
    """The vectorised steps against one weight at a time, in plain Python."""
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["ax", "by", "cz", "dw", "%%", "eq eq"]) for _ in range(rng.randint(0, 9))), k % 2) for k in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.01
    z, s = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + s[i] ** 0.5) / alpha + l2)

    for _ in range(quality.EPOCHS):
        for text, y in reversed(rows):
            counts = Counter(quality.features(text).tolist())
            x = {i: float(np.float32(c * (quality.SCALE / max(sum(counts.values()), 1)))) for i, c in counts.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - ((s[i] + g * g) ** 0.5 - s[i] ** 0.5) / alpha * w[i]
                s[i] += g * g
    got = quality.fit(rows)
    for text, _ in rows:
        idx = quality.features(text).tolist()
        dot = weight("bias") + (sum(map(weight, idx)) * quality.SCALE / len(idx) if idx else 0.0)
        assert quality.score(got, text) == pytest.approx(1 / (1 + np.exp(-dot)), abs=1e-4)


def test_toxicity_on_held_out_rows(spark):
    """Both classes count apart; only 41 toxic rows are there to learn from, and six to catch."""
    train, test = split(spark, "toxic")
    s = toxicity.Scorer(toxicity.fit(train))
    caught = [s.score(t) >= 0.5 for t, y in test if y]
    assert np.mean(caught) >= 0.5 and np.mean([s.score(t) < 0.5 for t, y in test if not y]) >= 0.97
    assert all(0 <= s.score(t) <= 1 for t in ODD)
    assert toxicity.Scorer(toxicity.fit([])).score("x") == 0.5


def test_toxicity_learns_pairs():
    """An insult alone and a group alone are harmless, both together are toxic: no sum of weights says so."""
    rng = random.Random(0)
    rows = []
    for k in range(1200):
        has = k % 4
        words = [f"w{rng.randint(0, 300)}" for _ in range(12)] + ["insult"] * (has in (1, 3)) + ["group"] * (has in (2, 3))
        rows.append((" ".join(words), int(has == 3)))
    s = toxicity.Scorer(toxicity.fit(rows))
    assert s.score("w1 insult group") > 0.5 > max(s.score("w1 insult"), s.score("w1 group"))


def test_language_labels(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null").collect()]
    model = langid.fit([*rows[:600], *[("привет мир как дела", "ru")] * 30])
    lab = langid.Labeller(model)
    assert np.mean([lab.label(t)[0] == lang for t, lang in rows[600:]]) >= 0.95
    assert lab.label("слово")[0] == "ru"  # the script alone says so
    assert [lab.label(t)[:2] for t in (None, "", "123 -- ½²")] == [("und", 0.0)] * 3
    mixed = rows[0][0][:600] + " " + "привет мир как дела " * 10
    spans = lab.label(mixed)[2]
    assert [s["lang"] for s in spans] == [rows[0][1], "ru"] and spans[0]["to"] == spans[1]["from"] and spans[1]["to"] == len(mixed)
    assert langid.Labeller(langid.fit([])).label("abc")[0] == "und"


def test_viterbi_shortcut_is_exact():
    lab = langid.Labeller({"langs": ["a", "b", "c"], "scripts": {}, "grams": {}, "table": np.zeros((1, 3), np.float32)})
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = -rng.exponential(rng.choice([0.2, 2.0]), (rng.integers(1, 40), 3)).astype(np.float32)
        path = lab.path(s)
        v = s[0].astype(float)
        for row in s[1:]:
            v = np.maximum(v, v.max() - langid.PENALTY) + row
        got = sum(s[t, k] for t, k in enumerate(path)) - langid.PENALTY * np.count_nonzero(np.diff(path))
        assert got == pytest.approx(v.max(), abs=1e-3)


def test_scorers_take_odd_rows(spark, odd, empty):
    w, m, g = quality.fit([("good text", 1), ("bad %%%", 0)]), toxicity.fit([("a b", 0), ("c d", 1)] * 20), langid.fit([("the cat", "en"), ("le chat", "fr")])
    for df, n in ((odd, odd.count()), (empty, 0)):
        for out in (quality.score_quality(df, w), toxicity.score_toxicity(df, m), langid.identify(df, g)):
            assert out.count() == n and out.filter(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).count() == 0
        assert quality.keep_good(df, w, 0.0).count() == n


def test_registered_queries_and_schemas(spark):
    q = __spark_entry__.queries()
    assert {f"op{k}" for k in range(1, 11)} <= {name.split("_")[0] for name in q} and "pipeline" in q
    cols = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"], "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op6_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op9_langid": ["doc_id", "held_out", "lang_pred", "score"],
    }
    for name, want in cols.items():
        out = q[name](spark, SF)
        assert set(want) <= set(out.columns)
    rows = q["op2_bpe"](spark, SF).orderBy("doc_id").limit(5).collect()
    own = bpe.loaded(tokenizer("byte_bpe_50k.json"))
    for r, t in zip(rows, texts(spark, 5), strict=True):
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own.encode(t))).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        n = out.count()
        assert 0 < n <= kept.count()
        kept = out.cache()
    final = p.STAGES[-1][1](spark, kept, SF)
    assert final.count() == n
    json.dumps([r.asDict() for r in final.limit(2).collect()])


def test_pipeline_module_stands_at_the_top():
    assert importlib.util.find_spec("corpus_pipeline")
