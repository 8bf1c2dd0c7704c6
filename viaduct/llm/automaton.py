"""A deterministic automaton over token arcs that accepts exactly the byte-pair tokenizations.

It starts as one state with a loop for every base token. Each merge (u, v) -> w, taken in order, adds a gadget:
u gets a target state of its own, a copy of the old one without the arc v (so u v is no longer accepted), and
every state with an arc u gets an arc w to where v led. All arcs with one label lead to one state, so the
automaton is a table: `target[token]` and one bit for each (token, state) that says whether the state has the arc.
A text has exactly one accepted path, and that path is its tokenization.
"""

from __future__ import annotations

import numpy as np


class MergeAutomaton:
    """base: ids of the base tokens; merges: (u, v, w) ids in order of priority; spelled: id -> bytes or str of the arc's label."""

    def __init__(self, size: int, base: list[int], merges: list[tuple[int, int, int]], spelled: dict):
        target = [0] * size
        members = [len(base) + 1]  # the start counts as a member of state 0
        made = 1
        order = np.array(base + [w for _, _, w in merges])  # so that the rows in use stand together
        row = np.zeros(size, np.int64)
        row[order] = np.arange(len(order))
        where = row.tolist()
        dense = np.zeros((1024, len(order)), np.uint8)  # bits over states, by token
        dense[0, : len(base)] = 1
        live, unmade = len(base), set()
        for u, v, w in merges:
            q, ru, rv = target[u], where[u], where[v]
            live += 1
            if u in unmade or not dense[q >> 3, rv] >> (q & 7) & 1:
                unmade.add(w)  # u v never stand together: nothing leads over w
                continue
            r = target[v]
            if members[q] > 1 or u == v:
                s, made = made, made + 1
                if s >> 3 == len(dense):
                    dense = np.pad(dense, ((0, 1024), (0, 0)))
                dense[s >> 3, : live - 1] |= (dense[q >> 3, : live - 1] >> (q & 7) & 1) << (s & 7)
                members[q] -= 1
                members.append(1)
                target[u] = s
            else:
                s = q
            dense[s >> 3, rv] &= 255 - (1 << (s & 7))
            dense[: (made + 7) // 8, where[w]] = dense[: (made + 7) // 8, ru]
            target[w] = r
            members[r] += 1
        width = (made + 7) // 8
        has = np.zeros((size, width), np.uint8)
        has[order] = dense[:width].T
        self.target, self.width, self.states = target, width, made
        self.arcs = memoryview(has.reshape(-1))
        #: Only tokens that the start state accepts are ever emitted.
        self.ids = {spelled[t]: t for t in order.tolist() if has[t, 0] & 1}
        longest: dict = {}
        for label in self.ids:
            longest[label[:2]] = max(longest.get(label[:2], 1), len(label))
            longest[label[:1]] = max(longest.get(label[:1], 1), 1)
        self.longest = longest

    def path(self, word) -> list[int]:
        """Labels of the accepted path that spells word; every base token in it must be known."""
        ids, arcs, width, target, longest = self.ids, self.arcs, self.width, self.target, self.longest
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        out: list[int] = []
        lengths: list[int] = []
        dead: set = set()
        at, end, state = 0, len(word), 0
        while at < end:
            k = min(longest.get(word[at : at + 2], 1), end - at)
            while k:
                t = ids.get(word[at : at + k])
                if t is not None and arcs[t * width + (state >> 3)] >> (state & 7) & 1 and not (dead and (at + k, t) in dead):
                    break
                k -= 1
            if k:
                out.append(t)
                lengths.append(k)
                at += k
                state = target[t]
            else:
                if not out:
                    raise ValueError(f"no path spells {word!r}")
                dead.add((at, out.pop()))
                at -= lengths.pop()
                state = target[out[-1]] if out else 0
        return out
