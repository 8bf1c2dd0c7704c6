"""Token counts of whole texts under a sentence-piece BPE model, by a compiled finite-state transducer over characters.

The pieces' merges compile into the deterministic automaton over tokens of automaton.py, in which every text has exactly one
path. So each prefix of a text has one last token: of the tokens that end there, the one that the state before it accepts. A
state of the transducer holds what later characters can ask for: for each place where a token may have begun that can still
go on, the node of the trie of tokens, the automaton's state at that place, and the tokens emitted there against those
emitted here. Reading a character leads to one next state and emits the difference of tokens, so transitions carry counts
and a text's count is their sum. States are numbered by what they hold, and are compiled when a text first comes to them. A
character outside the vocabulary emits its UTF-8 bytes. A space mark after anything else leads to the same state whatever
came before, and runs of marks, which merge last of all, have states of their own.

A text is cut into chunks. A chunk's map takes the state before it to the state after it and the tokens between; behind the
first reset it is constant, so it is computed once, and only the few characters before that wait for the state. Maps
compose, the composition is associative, and a scan (pairs up, prefixes down) composes all chunks of a text.

Null is the empty text and has no tokens. Rows are independent, so ties, repeats and hot keys need no care; the table
of states is emptied when it is full, so memory depends neither on the number of texts nor on their length. Only the id and
the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .automaton import MergeAutomaton
from .common import over_texts

SPACE = "▁"
#: Characters of a chunk; transitions in the table at most, besides those of one chunk.
CHUNK, MOST = 1 << 12, 400_000


class State(dict):
    """Transitions character -> (state, tokens emitted), compiled when first asked for.

    cuts: ((trie node, automaton state, tokens there less tokens here), ...), the oldest place first, the last one here.
    run: marks read of a run of marks, less whole periods; 0 outside of runs."""

    __slots__ = ("cuts", "of", "run")

    def __init__(self, of: PieceCounter, cuts: tuple, run: int):
        super().__init__()
        self.of, self.cuts, self.run = of, cuts, run

    def __missing__(self, c: str) -> tuple[State, int]:
        step = self.of.step(self, c)
        self[c] = step
        self.of.made += 1
        return step

    __hash__ = object.__hash__


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rank = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in rank):
            raise ValueError("pieces that cross into a space mark are not supported")
        #: Runs of space marks have the last rank of all and merge after everything else; they are counted apart.
        self.runs = {t for t in rank if len(t) > 1 and set(t) == {SPACE}}
        if any(t[:2] == SPACE * 2 for t in rank if t not in self.runs):
            raise ValueError("pieces that begin with two space marks are not supported")
        self.rank = {t: r for t, r in rank.items() if t not in self.runs}
        ids = {t: i for i, t in enumerate(self.rank)}
        merges = []
        done: dict[str, int] = {}
        for t in sorted((t for t in self.rank if len(t) > 1), key=self.rank.get):
            last = self.merged(list(t))
            if last and len(last) == 3:  # it is made whole, from these two at last
                done[t] = len(merges)
                if any(len(x) > 1 and x not in done for x in last[:2]):
                    raise ValueError(f"{t!r} ranks above its own parts")
                merges.append((ids[last[0]], ids[last[1]], ids[t]))
        self.automaton = MergeAutomaton(len(ids), [i for t, i in ids.items() if len(t) == 1], merges, {i: t for t, i in ids.items()})
        self.known = {t for t in self.rank if len(t) == 1}
        self.period = max(map(len, self.runs), default=1)
        tokens = [self.run_tokens(n) for n in range(4 * self.period + 1)]
        if any(tokens[n + self.period] != tokens[n] + 1 for n in range(3 * self.period + 1)):
            raise ValueError("the counts of runs of space marks have no period")
        self.run_step = [b - a for a, b in zip(tokens, tokens[1:], strict=False)]  # emitted by the next mark of a run
        self.child: dict[tuple[int, str], int] = {}
        self.token = [-1]  # by node of the trie
        for t, i in self.automaton.ids.items():
            node = 0
            for c in t:
                node = self.child.setdefault((node, c), len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.grows = {node for node, _ in self.child}
        self.states: dict[tuple, State] = {}
        self.made = 0
        self.reset = re.compile(f"(?<=[^{SPACE} ])[{SPACE} ]").search

    def merged(self, parts: list[str]) -> list[str] | None:
        """[left, right, whole] of the last merge if parts become one piece by the model's own rule, best rank and leftmost first; else None."""
        last = None
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return None
            i = best[1]
            last = [parts[i], parts[i + 1], parts[i] + parts[i + 1]]
            parts[i : i + 2] = [last[2]]
        return last

    def run_tokens(self, n: int) -> int:
        """Tokens of n space marks alone: pieces of marks have one rank, so the leftmost pair that makes a piece merges first."""
        parts, at = [1] * n, 0
        while at + 1 < len(parts):
            if SPACE * (parts[at] + parts[at + 1]) in self.runs:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = max(at - 1, 0)
            else:
                at += 1
        return len(parts)

    def state(self, cuts: tuple, run: int) -> State:
        found = self.states.get((cuts, run))
        if found is None:
            found = self.states[cuts, run] = State(self, cuts, run)
        return found

    @property
    def start(self) -> State:
        return self.state(((0, 0, 0),), 0)

    def accepts(self, state: int, token: int) -> int:
        a = self.automaton
        return a.arcs[token * a.width + (state >> 3)] >> (state & 7) & 1

    def step(self, s: State, c: str) -> tuple[State, int]:
        """The state after c and the tokens emitted by it."""
        if c in (" ", SPACE):
            run, emitted = s.run % self.period + 1, self.run_step[s.run]
            # the last mark of a run may be the head of a token; then the run is one mark shorter
            node = self.child[0, SPACE]
            alone = (0, self.automaton.target[self.automaton.ids[SPACE]], 0)
            return self.state(((node, 0, -emitted), alone) if node in self.grows else (alone,), run), emitted
        if c not in self.known:
            return self.start, len(c.encode())
        cuts, here = [], None
        for node, q, n in s.cuts:
            node = self.child.get((node, c))
            if node is None:
                continue
            token = self.token[node]
            if token >= 0 and self.accepts(q, token):
                here = (0, self.automaton.target[token], n + 1)
            if node in self.grows:
                cuts.append((node, q, n))
        emitted = here[2]
        return self.state((*((node, q, n - emitted) for node, q, n in cuts), (0, here[1], 0)), 0), emitted

    def walk(self, s: State, text: str) -> tuple[State, int]:
        count = 0
        for c in text:
            s, n = s[c]
            count += n
        return s, count

    def chunk_map(self, chunk: str, first: bool) -> tuple[tuple[str, ...], tuple[State, int] | None]:
        """(head, after): what waits for the state before the chunk, and the state and tokens after it, if they are the same for every state."""
        if first:
            return (), self.walk(self.walk(self.start, SPACE)[0], chunk)
        at = self.reset(chunk)
        if not at:
            return (chunk,), None
        return (chunk[: at.start()],), self.walk(self.start, chunk[at.start() :])

    def compose(self, f: tuple, g: tuple) -> tuple:
        """The map of f's chunks followed by g's."""
        if f[1] is None:
            return f[0] + g[0], g[1]
        s, count = f[1]
        for part in g[0]:
            s, n = self.walk(s, part)
            count += n
        if g[1] is not None:
            s, count = g[1][0], count + g[1][1]
        return f[0], (s, count)

    def scan(self, maps: list) -> list:
        """The maps of all prefixes. Compositions on one level don't depend on each other."""
        if len(maps) == 1:
            return maps
        pairs = self.scan([self.compose(f, g) for f, g in zip(maps[::2], maps[1::2], strict=False)])
        return [maps[0], *(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        maps = []
        for at in range(0, len(text), chunk):
            if self.made > MOST:
                self.forget()
            maps.append(self.chunk_map(text[at : at + chunk], not at))
        return self.scan(maps)[-1][1][1] + 1  # the mark that stands before every text

    def forget(self) -> None:
        """Empties the table; states that are still held compile their transitions anew."""
        for s in self.states.values():
            s.clear()
        self.states.clear()
        self.made = 0


@lru_cache(2)
def loaded(path: str) -> PieceCounter:
    """Compiled once in each Python worker."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long) of every whole text, without begin or end tokens."""

    def make():
        count = loaded(path).count
        return lambda text: (len((text or "").encode()), count(text or ""))

    return over_texts(df, id_col, text_col, "n_bytes long, n_tokens long", ["n_bytes", "n_tokens"], make)
