"""A vocabulary trie and its intersection with Levenshtein automata, for many words at once."""

from __future__ import annotations

from array import array

import numpy as np


class Trie:
    """The words of a vocabulary as a trie in flat arrays, level by level."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words) - {""})
        self.chars = {c: i for i, c in enumerate(sorted(set("".join(self.words))))}
        parent, label, end = array("q"), array("q"), array("q", [-1])  # of nodes in the order of the sorted words; the root is node 0
        path = [0]
        before = ""
        for k, word in enumerate(self.words):
            same = 0
            while same < len(before) and before[same] == word[same]:
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                parent.append(path[-1])
                label.append(self.chars[c])
                end.append(-1)
                path.append(len(end) - 1)
            end[path[-1]] = k
            before = word
        up = np.frombuffer(parent, np.int64) if len(parent) else np.zeros(0, np.int64)
        order = np.argsort(up, kind="stable")
        self.child = order + 1
        self.label = np.frombuffer(label, np.int64)[order] if len(label) else np.zeros(0, np.int64)
        self.first = np.searchsorted(up[order], np.arange(len(end) + 1))
        self.ends = np.array(end, dtype=np.int64)

    def within(self, queries: list[str], k: int, confusable: dict[str, frozenset[str]] | None = None) -> list[list[int]]:
        """Per query the indices of all words within Levenshtein distance ``k``.

        The automaton of a query is kept as k + 1 bit masks over its positions
        and walked down the trie together with those of all other queries.
        With ``confusable`` (character of a query -> characters it may stand
        for), the only edits are substitutions of those, which prunes the walk
        to few nodes. Queries of more than 62 characters find nothing.
        """
        found: list[list[int]] = [[] for _ in queries]
        live = [i for i, q in enumerate(queries) if 0 < len(q) <= 62]
        if not live or not len(self.child):
            return found
        match = np.zeros((len(live), len(self.chars)), dtype=np.uint64)
        for r, i in enumerate(live):
            for at, c in enumerate(queries[i]):
                j = self.chars.get(c)
                if j is not None:
                    match[r, j] |= np.uint64(1 << at)
        may = np.zeros_like(match)
        for r, i in enumerate(live if confusable else ()):
            for at, c in enumerate(queries[i]):
                for other in confusable.get(c, ()):
                    j = self.chars.get(other)
                    if j is not None:
                        may[r, j] |= np.uint64(1 << at)
        full = np.array([(1 << (len(queries[i]) + 1)) - 1 for i in live], dtype=np.uint64)
        last = np.array([1 << len(queries[i]) for i in live], dtype=np.uint64)
        one = np.uint64(1)
        row, node = np.arange(len(live)), np.zeros(len(live), np.int64)
        state = [np.full(len(live), np.uint64(1 if confusable else (1 << (d + 1)) - 1)) & full for d in range(k + 1)]
        while len(row):
            n = self.first[node + 1] - self.first[node]
            src = np.repeat(np.arange(len(row)), n)
            if not len(src):
                break
            edge = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + self.first[node][src]
            row, node = row[src], self.child[edge]
            hit, cap = match[row, self.label[edge]], full[row]
            old = [s[src] for s in state]
            new = [((old[0] & hit) << one) & cap]
            swap = may[row, self.label[edge]] if confusable else None
            for d in range(1, k + 1):
                if confusable:
                    new.append((((old[d] & hit) | (old[d - 1] & swap)) << one) & cap)
                    continue
                new.append((((old[d] & hit) << one) | old[d - 1] | (old[d - 1] << one) | (new[d - 1] << one)) & cap)
            keep = np.flatnonzero(new[k])
            row, node, state = row[keep], node[keep], [s[keep] for s in new]
            done = np.flatnonzero((state[k] & last[row] != 0) & (self.ends[node] >= 0))
            for r, w in zip(row[done].tolist(), self.ends[node[done]].tolist()):
                found[live[r]].append(w)
        return found
