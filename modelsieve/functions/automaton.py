"""Many literals looked for in one pass over bytes: an Aho-Corasick automaton run in numpy lanes.

The text is cut into lanes that advance together, one byte of each per step; a lane runs on into the next one for as many bytes
as the longest literal can still need. Bytes are first mapped to classes, one for each byte that occurs in a literal and one for all others,
so the transition table has (nodes of the trie) x (classes) numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np

LANES = 4096


class Literals:
    """Finds which of ``words`` occur in a text. Made once; it holds arrays alone and travels inside the tasks."""

    def __init__(self, words: Sequence[bytes]) -> None:
        self.longest = max(map(len, words), default=0)
        used = sorted(set(b"".join(words)))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        for number, word in enumerate(words):
            node = 0
            for byte in word:
                found = children[node].get(byte)
                if found is None:
                    found = children[node][byte] = len(children)
                    children.append({})
                node = found
            ends.setdefault(node, []).append(number)
        table = np.zeros((len(children), self.width), np.int32)
        fail = np.zeros(len(children), np.int32)
        # The next node on the way of failures that ends a word; 0 is none.
        link = np.zeros(len(children), np.int32)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            back = int(fail[node])
            if node:
                table[node] = table[back]
                link[node] = back if back in ends else link[back]
            for byte, child in children[node].items():
                at = int(self.classes[byte])
                if node:
                    fail[child] = table[back, at]
                table[node, at] = child
                todo.append(child)
        # States are kept multiplied by the width, so that a step is one addition and one look-up.
        self.table = (table * self.width).ravel()
        self.link = link
        self.marked = np.array([node in ends or bool(link[node]) for node in range(len(children))])
        self.ends = ends

    def found(self, text: bytes) -> list[int]:
        """Numbers of the words that occur in ``text``, ascending; the empty word occurs in any."""
        hits = set(self.ends.get(0, ()))
        size = len(text)
        if not size or not self.longest:
            return sorted(hits)
        lanes = max(1, min(LANES, size // max(1, 4 * self.longest)))
        step = -(-size // lanes)
        reach = step + self.longest - 1
        padded = np.zeros(lanes * step + self.longest, np.int32)
        padded[:size] = self.classes[np.frombuffer(text, np.uint8)]
        rows = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (reach, lanes), (padded.itemsize, step * padded.itemsize)))
        seen = np.zeros(len(self.marked), bool)
        state = np.zeros(lanes, np.int32)
        for row in rows:
            state = self.table[state + row]
            seen[state // self.width] = True
        for node in np.flatnonzero(seen & self.marked).tolist():
            while node:
                hits.update(self.ends.get(node, ()))
                node = int(self.link[node])
        return sorted(hits)
