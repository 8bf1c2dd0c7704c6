"""Vector codes, hard negatives and media columns against plain versions, with odd rows."""

import gzip
import hashlib
import io
import math
import random
import struct
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.llm import hard_negatives, media, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, id long, q string, row long"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, None, None, 7) for i, v, y in rows], VECTORS)


def whole(v, dim):
    return [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v))


def kept(rows):
    return [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def odd_rows(rng, n=260, dim=16, levels=None):
    one = (lambda: rng.choice(levels)) if levels else (lambda: rng.gauss(0, 0.2))
    rows = [(i, [one() for _ in range(dim)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [rows[3], (3, [one() for _ in range(dim)], 1), (None, [0.5] * dim, 2), (n + 1, [0.25, -0.5], 0), (n + 2, [], 1)]
    rows += [(n + 3, None, 1), (n + 4, [NAN] * dim, 1), (n + 5, [INF, 1.0], 1), (n + 6, [None, 1.0], None), (n + 7, [-INF], 2)]
    rng.shuffle(rows)
    return rows


def plain_codes(rows, parts, entries, rounds):
    rows = kept(rows)
    longest = max((len(v) for _, v, _ in rows), default=0)
    dim = -(-longest // parts) * parts
    w = dim // parts
    q = [whole(v, dim) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, q[r]))[:entries]
    books = [[q[r][p * w : (p + 1) * w] for r in first] for p in range(parts)]

    def assign():
        return [[min(range(len(first)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x[p * w : (p + 1) * w], books[p][e], strict=True)), e)) for p in range(parts)] for x in q]

    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            own = defaultdict(list)
            for x, c in zip(q, code, strict=True):
                own[c[p]].append(x[p * w : (p + 1) * w])
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    code = assign()
    error = [sum((a - b) ** 2 for p in range(parts) for a, b in zip(x[p * w : (p + 1) * w], books[p][c[p]], strict=True)) for x, c in zip(q, code, strict=True)]
    return [(i, y, tuple(c), e) for (i, _, y), c, e in zip(rows, code, error, strict=True)], books


@pytest.mark.parametrize(("levels", "entries"), [(None, 24), ([-0.5, 0.0, 0.5], 9)])
def test_vector_codes_against_plain_rounds(spark, levels, entries):
    """Real vectors, and such of three levels only, where nearly every distance ties."""
    rows = odd_rows(random.Random(4), levels=levels)
    want, books = plain_codes(rows, 4, entries, 3)
    got, own = vector_codes.compress(table(spark, rows), parts=4, entries=entries, rounds=3)
    assert own.tolist() == books
    out = vector_codes.with_label_error(got).collect()
    assert Counter((r["vec_id"], r["label"], tuple(r["code"]), r["error"]) for r in out) == Counter(want)
    sums = Counter()
    for _, y, _, e in want:
        sums[y] += e
    assert all(r["label_error"] == sums[r["label"]] for r in out)


def test_vector_bounds_spare_comparisons_and_stay_exact():
    """Codes after a small move equal a full comparison, and most parts need none; equal distances are compared."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-3000, 3000, (40, 4))
    x = np.concatenate([entries[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 4)), (entries[:20] + entries[20:]) // 2])
    code, upper, lower = vector_codes.scan(x, entries)
    moved = entries + rng.integers(-3, 4, entries.shape)
    got, up, low, open_ = vector_codes.assign(x, code, upper, lower, moved, vector_codes._distance_up(moved, entries))
    d = vector_codes.squared(x, moved)
    assert (got == d.argmin(axis=1)).all() and len(open_) < 1000
    assert (up >= np.sqrt(d.min(axis=1))).all() and (low <= np.sqrt(np.partition(d, 1, axis=1)[:, 1])).all()


def test_vector_codes_of_few_no_and_large_rows(spark):
    got, books = vector_codes.compress(table(spark, []))
    assert got.count() == 0 and vector_codes.joined_text(books) == ""
    rows = [(1, [1e30, -1e30] * 8, None), (2, [0.0] * 16, None), (2, [], 1)]
    got, books = vector_codes.compress(table(spark, rows))
    out = vector_codes.with_label_error(got).collect()
    assert len(out) == 3 and all(r["error"] == 0 for r in out) and {r["label_error"] for r in out} == {0}
    assert vector_codes.hex_code(F.lit(1)) is not None


def plain_mined(rows, block_label):
    rows = [(i, v, block_label(i, y)) for i, v, y in kept(rows) if y is not None and i is not None]
    dim = max((len(v) for _, v, _ in rows), default=0)
    rows = [(i, whole(v, dim), y) for i, v, y in rows]
    out = Counter()
    for a, (ai, av, ay) in enumerate(rows):
        if ai % 10:
            continue
        scores = [(-sum(x * y for x, y in zip(av, v, strict=True)), i, r) for r, (i, v, _) in enumerate(rows) if r != a]
        same = sorted(s for s in scores if rows[s[2]][2] == ay)[:5]
        other = sorted(s for s in scores if rows[s[2]][2] != ay)
        for ps, pi, _ in same:
            window = [s for s in other if 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out.update((ai, pi, k, ni, -ps, -ns) for k, (ns, ni, _) in enumerate(window, 1))
    return out


@pytest.mark.parametrize("levels", [None, [-0.5, 0.0, 0.5]])
def test_hard_negatives_against_all_pairs(spark, levels):
    """Many blocks of rows and of anchors, ties of scores and ids, negative scores, rows left out."""
    rows = odd_rows(random.Random(8), 500, 15, levels)
    label = lambda i, y: (y + 1) % 3 if i % 7 == 0 else y
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hard_negatives.mine(table(spark, rows), F.col("id") % 10 == 0, own, block=90, anchor_block=20)
    assert Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == plain_mined(rows, label)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(table(spark, []), F.col("id") % 10 == 0, F.col("label")).count() == 0
    alone = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]
    assert hard_negatives.mine(table(spark, alone), F.col("id") > 5, F.col("label")).count() == 0
    assert hard_negatives.mine(table(spark, alone), F.col("id") == 0, F.col("label")).count() == 0


def test_bounds_hold_and_rule_most_rows_out():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q = np.floor(rng.normal(0, 0.125, (4000, 64)) * 256).astype(np.int64)
    books = hard_negatives.fit(q)
    code, residual = hard_negatives.encode(q, books)
    n = np.arange(len(q))
    b = hard_negatives.Block(pa.table({"row": n, "id": n, "label": n % 3, "q": vector_codes.lists(q), "code": [c.tobytes() for c in code], "residual": residual}), books)
    for a, (score, slack) in zip(q[:50], b.bounds(q[:50]), strict=True):
        true = q @ a
        assert (np.abs(true - score) <= slack).all()
        at, known = b.top(a, n[1:], score, slack, 10, true.max() // 2, 5)
        want = sorted((-true[r], r) for r in n[1:] if 5 <= true[r] <= true.max() // 2)[:10]
        assert list(zip(-known, at, strict=True)) == want
    assert b.scored < 0.2 * 50 * len(q)


TEXTS = ["", None, " ", "a", "x" * 191, "y" * 192, "é" * 97, "BM" * 300, "RIFF\x24\x00\x00\x00WAVEfmt ", "\x89PNG\r\n\x1a\n", "GIF89a" + "\x00" * 20, "word " * 40_000, "\x1f\x8b\x08" * 50, "日本語🙂"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, 1, b"z", "t") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_bytes long, media binary, type string")


def test_media_round_trip(spark):
    texts = [*TEXTS, *TEXTS[:4], *(f"line {k} " * k for k in range(60))]
    kept = media.stored(docs(spark, texts)).collect()
    back = media.read_back(spark.createDataFrame(kept, "doc_id long, n_bytes long, media binary, declared string"), ["doc_id", "n_bytes"])
    by_text, kinds = defaultdict(set), Counter()
    stored = {r["doc_id"]: bytes(r["media"]) for r in kept}
    for r in back.collect():
        text = texts[r["doc_id"]] or ""
        raw = text.encode()
        assert bytes(r["samples"]) == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and r["n_bytes"] == len(raw)
        by_text[text].add((stored[r["doc_id"]], r["feature"]))
        kind, declared, at, inside, *_ = r["feature"].split("/")
        kinds[kind, kind == declared, at != "0"] += 1
    assert all(len(v) == 1 for v in by_text.values())
    assert {k[0] for k in kinds} == {"wav", "png", "bmp"} and {k[1] for k in kinds} == {True, False} == {k[2] for k in kinds}


def test_media_as_other_programs_read_them():
    samples = bytes(range(256)) * 3
    with wave.open(io.BytesIO(media.to_wav(samples))) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == samples
    odd = samples[:191]
    with wave.open(io.BytesIO(media.to_wav(odd))) as w:
        assert w.readframes(w.getnframes()) == odd == media.from_wav(media.to_wav(odd))
    b = media.to_png(samples)
    lines = np.frombuffer(zlib.decompress(b[41 : 41 + struct.unpack(">I", b[33:37])[0]]), np.uint8).reshape(-1, 193)
    assert (lines[:, 0] == 2).all() and (np.cumsum(lines[:, 1:], axis=0) % 256).astype(np.uint8).tobytes() == samples == media.from_png(b)
    assert media.from_bmp(media.to_bmp(samples)) == samples


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def jpeg():
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xC0, b"\x08\0\x01\0\x01\x01\x01\x11\0") + part(0xDA, b"\x01\x01\0\0\x3f\0") + b"\x12\xff\x00\x34\xff\xd0\x55" + b"\xff\xd9"


def test_sniffing_confirms_structures_and_carves(spark):
    png, wav, bmp, packed = media.to_png(b"p" * 384), media.to_wav(b"RIFF" * 48), media.to_bmp(b"b" * 192), gzip.compress(b"text " * 100)
    parts = [("png", png), ("wav", wav), ("gif", gif()), ("bmp", bmp), ("jpeg", jpeg()), ("gzip", packed)]
    rng = random.Random(2)
    for _ in range(30):
        rng.shuffle(parts)
        blob, want = b"BM GIF89a RIFF ", []
        for kind, b in parts:
            want.append((kind, len(blob), len(b)))
            blob += b + rng.choice([b"", b"\xff\xd8\xff", b"BMBM", b"between"])
        assert media.sniff(blob) == want
    for _, b in parts:  # cut short or damaged in its structure, none is confirmed
        assert media.sniff(b[:-1]) == [] and media.sniff(b[: len(b) // 2]) == []
    assert media.sniff(png.replace(b"IDAT", b"IDAX")) == [] and media.sniff(packed[:-8] + b"\0" * 8) == []
    rows = [(1, png, "jpeg"), (2, b"junk" + gif() + wav, "gif"), (3, None, "png"), (4, b"", None), (5, b"text only", "wav")]
    df = spark.createDataFrame(rows, "id long, media binary, declared string")
    got = {r["id"]: r for r in media.sniffed(df, keep=["id"]).collect()}
    assert [(got[i]["type"], got[i]["corrected"], len(got[i]["found"])) for i in range(1, 6)] == [("png", True, 1), ("gif", False, 2), (None, False, 0), (None, False, 0), (None, False, 0)]
    cut = {r["id"]: [(m["type"], bytes(m["bytes"])) for m in r["media"]] for r in media.carved(df, keep=["id"]).collect()}
    assert cut == {1: [("png", png)], 2: [("gif", gif()), ("wav", wav)], 3: [], 4: [], 5: []}
    assert media.stored(docs(spark, [])).count() == 0


def test_media_query(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["op12_media"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        raw_padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = media.as_medium(raw_padded)[0]
        want = (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want
