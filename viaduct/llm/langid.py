"""Language of texts and of spans inside them: script ranges, per-word scores and a Viterbi path.

Words are runs of letters. A word's script narrows the languages to those that the training texts write in that script;
a script that no language uses says nothing. Among the candidates a word scores by the log-likelihoods of its padded
character trigrams and of the word itself. A Viterbi path over the words, with a penalty for each switch, labels spans;
the language with the most letters is the text's, and its share of the letters is the score.

Null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned. Rows are labelled
on their own, so ties, repeats and hot keys need no care. Equal scores go to the language first in the alphabet.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, over_texts

#: Documents that the scores are learned from at most.
SAMPLE = 3_000
#: First and last code points of scripts (fixed values).
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
PENALTY, WORST = 12.0, -8.0
_WORDS = re.compile(r"[^\W\d_]+")


def script(word: str) -> str | None:
    """Of the word's first letter; None: it has no letter, or one of another script ('')."""
    if word.isascii():
        return "Latin" if word else None
    for c in word:
        if c.isalpha():
            at = ord(c)
            return next((name for name, a, b in SCRIPTS if a <= at <= b), "")
    return None


def grams(word: str) -> list[str]:
    """Trigrams of the padded word, and the word."""
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)] + [w]


def fit(rows: list[tuple[str, str]]) -> dict:
    """From (text, language): the languages in order, their scripts, and the log-likelihoods of grams by language."""
    langs = sorted({lang for _, lang in rows})
    words = {lang: Counter() for lang in langs}
    for text, lang in rows:
        words[lang].update(_WORDS.findall(text.lower()))
    counts: dict[str, list[float]] = {}
    scripts: dict[str, set[int]] = {}
    for k, lang in enumerate(langs):
        seen: Counter = Counter()
        for w, n in words[lang].items():
            name = script(w)
            if name is None:
                continue
            seen[name] += n
            for g in grams(w):
                counts.setdefault(g, [0.0] * len(langs))[k] += n
        for name, n in seen.items():
            if n >= 0.01 * seen.total():
                scripts.setdefault(name, set()).add(k)
    often = {g: c for g, c in counts.items() if sum(c) >= 3}
    table = np.array(list(often.values()), np.float64).reshape(len(often), len(langs))
    table = np.log(table + 0.5) - np.log(table.sum(axis=0, keepdims=True) + 0.5 * (len(often) + 1))
    unseen = np.log(0.5) - np.log(np.array([sum(c[k] for c in often.values()) for k in range(len(langs))]) + 0.5 * (len(often) + 1))
    return {"langs": langs, "scripts": scripts, "grams": {g: i for i, g in enumerate(often)}, "table": np.vstack([table, unseen[None]]).astype(np.float32)}


class Labeller:
    CAP = 200_000

    def __init__(self, model: dict):
        self.langs, self.scripts, self.gram, self.table = model["langs"], model["scripts"], model["grams"], model["table"]
        self.rows = np.zeros((self.CAP, max(len(self.langs), 1)), np.float32)
        self.at: dict[str, int] = {}

    def fill(self, words: list[str]) -> None:
        """Scores of new words, each relative to its best language."""
        n, k = len(self.langs), len(self.at)
        gram, last, index, begins, names = self.gram.get, len(self.table) - 1, [], [], []
        for w in words:
            padded = f" {w} "
            begins.append(len(index))
            index += [gram(padded[i : i + 3], last) for i in range(len(w))]
            index.append(gram(padded, last))
            names.append(script(w))
        s = np.add.reduceat(self.table[index], begins, axis=0)
        for name in set(names):
            allowed = self.scripts.get(name) if name else None
            if allowed is None or len(allowed) < n:
                own = np.array([x == name for x in names])
                if allowed is None:
                    s[own] = 0
                else:
                    s[np.ix_(own, [j for j in range(n) if j not in allowed])] = -1e9
        self.rows[k : k + len(words)] = np.maximum(s - s.max(axis=1, keepdims=True), WORST)
        self.at.update(zip(words, range(k, k + len(words)), strict=True))

    def scored(self, words: list[str]) -> np.ndarray:
        if len(words) > self.CAP // 4:  # of a very long text, piece by piece
            return np.concatenate([self.scored(words[i : i + self.CAP // 4]) for i in range(0, len(words), self.CAP // 4)])
        new = set(words).difference(self.at)
        if len(self.at) + len(new) > self.CAP:
            self.at.clear()
            new = set(words)
        if new:
            self.fill(list(new))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language for each word, under PENALTY for each switch."""
        total = s.sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        ahead = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum(np.minimum.accumulate(ahead, axis=0), 0.0)
        # No stretch in another language gains more than a switch costs, nor do the best beginning and the best end
        # together: then no path that leaves `best` pays for its switches, with or without a stretch in `best`.
        if (ahead - low).max() <= PENALTY and max(ahead.max(), 0.0) + (ahead[-1] - low[-1]).max() <= PENALTY:
            return np.full(len(s), best)
        v, back = [0.0] * s.shape[1], []
        for row in s.astype(np.float64).tolist():
            most = max(v)
            floor = most - PENALTY
            if min(v) < floor:
                top = v.index(most)
                back.append([k if x >= floor else top for k, x in enumerate(v)])
                v = [(x if x >= floor else floor) + r for x, r in zip(v, row, strict=True)]
            else:
                back.append(None)  # each stays
                v = [x + r for x, r in zip(v, row, strict=True)]
        out = np.empty(len(s), np.int64)
        k = v.index(max(v))
        for t in range(len(s) - 1, -1, -1):
            out[t] = k
            if back[t] is not None:
                k = back[t][k]
        return out

    def label(self, text: str | None) -> tuple[str, float, list[dict]]:
        words = _WORDS.findall((text or "").lower())
        if not self.langs or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return "und", 0.0, []
        path = self.path(self.scored(words))
        if (path == path[0]).all():
            return self.langs[path[0]], 1.0, [{"from": 0, "to": len(text), "lang": self.langs[path[0]]}]
        letters = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(self.langs))
        best = int(letters.argmax())
        turn = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
        begins = [m.start() for m in _WORDS.finditer(text)]
        cut = [0, *(begins[t] if len(begins) == len(words) else len(text) * t // len(words) for t in turn[1:]), len(text)]
        return self.langs[best], float(letters[best] / letters.sum()), [{"from": a, "to": b, "lang": self.langs[path[t]]} for a, b, t in zip(cut, cut[1:], turn, strict=False)]


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every whole text; spans are stretches of characters with their language."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return Labeller(sent.value).label

    return over_texts(df, id_col, text_col, "lang_pred string, score double, spans array<struct<from:int,to:int,lang:string>>", ["lang_pred", "score", "spans"], make)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> dict:
    """Learned from at most `most` documents with a language (and SAMPLE_BYTES of text) that aren't held out, chosen by a hash of the id.

    Of rows that repeat an id the one with the smallest language and text counts."""
    from .labelled import within_bytes

    known = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    chosen = known.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("o")).distinct().orderBy("o", "id").limit(most)
    texts = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).filter(F.col("t").isNotNull())
    # at most `most` ids: a proven bound for the broadcast
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "o").agg(F.min(F.struct("lang", "t")).alias("r")).select("id", "o", "r.lang", "r.t")
    return fit([(r["t"], r["lang"]) for r in sorted(within_bytes(found).collect(), key=lambda r: (r["o"], r["id"]))])
