"""Minimal acceptors of words of one length, and their composition with a one-edit transducer.

A state is a number; 0 is the end. arcs[state] has (next state, words skipped) by letter: the words that an acceptor takes,
in order, are numbered by what their path skips. States with the same words below are one, across acceptors of a register.
"""

from __future__ import annotations

from collections.abc import Iterator

END = 0


class Register:
    """States that acceptors share: equal ones are made once."""

    def __init__(self):
        self.arcs: list[dict] = [{}]
        self.counts = [1]
        self.known: dict[tuple, int] = {}

    def state(self, key: tuple) -> int:
        """The state with these (letter, next state) arcs, in order of the letters."""
        found = self.known.get(key)
        if found is None:
            arcs, total = {}, 0
            for letter, child in key:
                arcs[letter] = child, total
                total += self.counts[child]
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.counts.append(total)
        return found

    def acceptor(self, words: list[str]) -> int:
        """The initial state of the minimal acceptor of words: sorted, distinct and of one length. Layer by layer from the
        ends of the words, so that long words need no deep recursion."""
        shared = [0] * len(words)  # letters that a word shares with the one before it
        for k in range(1, len(words)):
            a, b = words[k - 1], words[k]
            j = 0
            while a[j] == b[j]:
                j += 1
            shared[k] = j
        layer = [(k, END) for k in range(len(words))]  # the first word of each node, and its state
        for depth in range(len(words[0]) - 1, -1, -1):
            above, at = [], 0
            while at < len(layer):
                first, end = layer[at][0], at + 1
                while end < len(layer) and shared[layer[end][0]] >= depth:
                    end += 1
                above.append((first, self.state(tuple((words[k][depth], child) for k, child in layer[at:end]))))
                at = end
            layer = above
        return layer[0][1]

    def replaced(self, start: int, edits: int) -> Iterator[tuple[int, int]]:
        """Pairs of numbers of words of the acceptor at start that differ in one letter, among the first `edits` ones: the
        composition of the acceptor, a transducer that replaces one letter, and the acceptor. Before the edit both tapes are
        at one state; after it, only equal letters follow."""
        arcs, counts = self.arcs, self.counts
        walk = [(start, 0, 0)]
        while walk:
            state, number, depth = walk.pop()
            if depth == edits or counts[state] == 1:
                continue
            after = list(arcs[state].values())
            for k, (p, skip) in enumerate(after):
                walk.append((p, number + skip, depth + 1))
                for q, other in after[k + 1 :]:
                    yield from self.equal(p, q, number + skip, number + other)

    def deleted(self, longer: int, shorter: int, edits: int) -> Iterator[tuple[int, int]]:
        """Pairs of numbers, of a word of longer and of one of shorter that is the first less one letter, which is the first
        place where they differ and one of the first `edits`."""
        arcs = self.arcs
        walk = [(longer, shorter, 0, 0, 0)]
        while walk:
            p, q, i, j, depth = walk.pop()
            if depth == edits:
                continue
            ahead = arcs[q]
            for letter, (after, skip) in arcs[p].items():
                if q == END:
                    if after == END:
                        yield i + skip, j
                    continue
                for common, (p2, skip2) in arcs[after].items():
                    if common != letter and common in ahead:  # the same letter would differ later
                        q2, other = ahead[common]
                        yield from self.equal(p2, q2, i + skip + skip2, j + other)
                if letter in ahead:
                    q2, other = ahead[letter]
                    walk.append((after, q2, i + skip, j + other, depth + 1))

    def equal(self, p: int, q: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Pairs of numbers of equal words below p and q. One state stands for equal sets, which needs no walk."""
        arcs, counts = self.arcs, self.counts
        walk = [(p, q, i, j)]
        while walk:
            p, q, i, j = walk.pop()
            if p == q:
                yield from ((i + k, j + k) for k in range(counts[p]))
                continue
            a, b = arcs[p], arcs[q]
            if len(a) > len(b):
                for letter, (q2, other) in b.items():
                    if letter in a:
                        p2, skip = a[letter]
                        walk.append((p2, q2, i + skip, j + other))
            else:
                for letter, (p2, skip) in a.items():
                    if letter in b:
                        q2, other = b[letter]
                        walk.append((p2, q2, i + skip, j + other))
