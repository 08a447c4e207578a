"""A minimal acyclic transducer that maps words to the ids they encode to.

Words are compiled, in sorted order, into an automaton whose equal suffixes are shared. Each
transition carries a number; the numbers along a word add up to its place in the table of id
sequences. The arrays are written to one file that every worker maps into memory, and lookups
walk all words of a batch together, one byte at a step.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from crawlvis.llm.scan import ranges

ARRAYS = ("keys", "target", "add", "final", "ids", "ends")


def compile_words(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The transducer's arrays. keys: state * 256 + byte of each transition, sorted; state 0 is the start."""
    root: list = [False, {}]  # a state: whether a word ends here, and its transitions
    register: dict[tuple, list] = {}
    path: list[tuple[list, int, list]] = []
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            signature = (child[0], tuple((b, id(s)) for b, s in child[1].items()))
            parent[1][byte] = register.setdefault(signature, child)

    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else root
        for byte in word[common:]:
            child: list = [False, {}]
            state[1][byte] = child
            path.append((state, byte, child))
            state = child
        state[0] = True
        last = word
    settle(0)
    number, order = {id(root): 0}, [root]
    for state in order:
        for child in state[1].values():
            if id(child) not in number:
                number[id(child)] = len(order)
                order.append(child)
    below: dict[int, int] = {}  # words that end at a state or after it

    def count(top: list) -> None:
        todo = [top]
        while todo:
            state = todo[-1]
            rest = [c for c in state[1].values() if id(c) not in below]
            if rest:
                todo += rest
            else:
                below[id(state)] = state[0] + sum(below[id(c)] for c in state[1].values())
                todo.pop()

    count(root)
    keys, target, add = [], [], []
    for n, state in enumerate(order):
        passed = int(state[0])
        for byte in sorted(state[1]):
            child = state[1][byte]
            keys.append(n * 256 + byte)
            target.append(number[id(child)])
            add.append(passed)
            passed += below[id(child)]
    outputs = [words[w] for w in ordered]
    return {
        "keys": np.array(keys, dtype=np.int64), "target": np.array(target, dtype=np.int64), "add": np.array(add, dtype=np.int64),
        "final": np.array([s[0] for s in order], dtype=np.uint8), "ids": np.array([i for o in outputs for i in o], dtype=np.uint32),
        "ends": np.cumsum([0, *map(len, outputs)]).astype(np.int64),
    }


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """A line of JSON with the arrays' types and places, then the arrays, each at a multiple of 8 bytes."""
    head, parts, at = {}, [], 4096
    for name in ARRAYS:
        a = arrays[name]
        head[name] = [a.dtype.str, len(a), at]
        parts.append(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))
        at += len(parts[-1])
    return json.dumps(head).encode().ljust(4096) + b"".join(parts)


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    with open(path, "wb") as file:
        file.write(packed(arrays))


class Transducer:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            head = json.loads(file.read(4096))
        for name, (kind, n, at) in head.items():
            setattr(self, name, np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, dtype=kind))

    def find(self, words: pa.StringArray) -> np.ndarray:
        """The place of each word's output, or -1. An empty word is never found."""
        n = len(words)
        found = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return found
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        live = np.flatnonzero(np.diff(offsets) > 0)
        at, end = offsets[live], offsets[live + 1]
        state, total = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        while len(live):
            key = state * 256 + raw[at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            live, at, end, edge, total = live[hit], at[hit] + 1, end[hit], edge[hit], total[hit]
            total = total + self.add[edge]
            state = self.target[edge]
            over = at == end
            good = over & (self.final[state] == 1)
            found[live[good]] = total[good]
            live, at, end, state, total = live[~over], at[~over], end[~over], state[~over], total[~over]
        return found

    def outputs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of found words end to end, and how many each has."""
        count = self.ends[places + 1] - self.ends[places]
        return self.ids[ranges(self.ends[places], count)], count
