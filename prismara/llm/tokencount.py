"""Counts of greedy longest-match word pieces by an automaton that never builds a piece."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, kept, unused


class Automaton:
    """The trie of a vocabulary of byte strings, with failure links and the number of pieces popped on each.

    Where a node has no child for the next byte, the longest piece that starts its string is certain, and so
    on until what is left is a node again that may go on: `fail` is that node and `pops` the number of pieces
    passed. `rest` is the number of pieces if the word ends at a node. Children lie side by side, so that a
    child's number is the first one's plus the bits below its byte in a map of 256 bits.
    """

    def __init__(self, pieces: list[bytes]):
        if missing := {bytes([b]) for b in range(256)} - set(pieces):
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        tree: dict = {}
        for piece in pieces:
            node = tree
            for b in piece:
                node = node.setdefault(b, {})
            node[-1] = True
        order, first, parent, byte = [tree], [], [0], [0]
        queue = deque([tree])
        while queue:
            node = queue.popleft()
            first.append(len(order))
            for b in sorted(k for k in node if k >= 0):
                parent.append(len(first) - 1)
                byte.append(b)
                order.append(node[b])
                queue.append(node[b])
        n = len(order)
        self.first = np.array(first, np.int64)
        bits = np.zeros((n, 256), np.uint8)
        bits[parent[1:], byte[1:]] = 1
        self.map = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, 4)
        ones = np.bitwise_count(self.map).astype(np.int64)
        self.before = np.cumsum(ones, axis=1) - ones
        child = [{b: None for b in node if b >= 0} for node in order]
        for i in range(1, n):
            child[parent[i]][byte[i]] = i
        fail, pops = [0] * n, [0] * n
        for i in range(1, n):  # by depth, so that shorter strings are ready
            if -1 in order[i]:
                fail[i], pops[i] = 0, 1
                continue
            at, count = fail[parent[i]], pops[parent[i]]
            while byte[i] not in child[at]:
                at, count = fail[at], count + pops[at]
            fail[i], pops[i] = child[at][byte[i]], count
        self.fail, self.pops = np.array(fail), np.array(pops)
        rest = [0] * n
        for i in range(1, n):  # a failure link leads to a shorter string, so to a lower number
            rest[i] = pops[i] + rest[fail[i]]
        self.rest = np.array(rest)
        self._steps: dict[int, tuple[int, int]] = {}

    def _child(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each node has a child for its byte, the child)."""
        part, bit = byte >> 6, (byte & 63).astype(np.uint64)
        word = self.map[node, part]
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return (word >> bit & np.uint64(1)).astype(bool), self.first[node] + self.before[node, part] + below

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word; all words go through the automaton in step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = (np.cumsum(size) - size)[by]
        size = size[by]
        node, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = len(words)
        for step in range(int(size[0]) if len(size) else 0):
            if live <= FEW:  # few long words: one by one, without an array's cost a step
                for i in range(int(np.searchsorted(-size[:live], -step, side="left"))):
                    node[i], more = self._rest(int(node[i]), data[begin[i] + step : begin[i] + size[i]].tolist())
                    total[i] += more
                break
            live = int(np.searchsorted(-size[:live], -step, side="left"))
            byte = data[begin[:live] + step]
            has, to = self._child(node[:live], byte)
            node[:live][has] = to[has]
            left = np.flatnonzero(~has)
            while len(left):
                total[left] += self.pops[node[left]]
                node[left] = self.fail[node[left]]
                has, to = self._child(node[left], byte[left])
                node[left[has]] = to[has]
                left = left[~has]
        total += self.rest[node]
        out = np.empty(len(words), np.int64)
        out[by] = total
        return out


    def _rest(self, node: int, rest: list[int]) -> tuple[int, int]:
        """(the node at the end, the pieces popped) of one word from a node on."""
        count, steps = 0, self._steps
        for b in rest:
            to = steps.get(node << 8 | b)
            if to is None:
                at, popped = node, 0
                while not int(self.map[at, b >> 6]) >> (b & 63) & 1:
                    popped += int(self.pops[at])
                    at = int(self.fail[at])
                below = int(np.bitwise_count(self.map[at, b >> 6] & np.uint64((1 << (b & 63)) - 1)))
                to = steps[node << 8 | b] = (int(self.first[at] + self.before[at, b >> 6]) + below, popped)
                if len(steps) > KNOWN:
                    steps.clear()
            node = to[0]
            count += to[1]
        return node, count


#: Bytes of text whose equal words are counted once.
RUN_BYTES = 1 << 21
#: Words that are still going on when the rest is walked one by one, and steps that are remembered meanwhile.
FEW, KNOWN = 16, 1 << 17


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """From a file whose lines begin with a piece in base64."""
    with open(path, "rb") as lines:
        return Automaton([base64.b64decode(x.split()[0]) for x in lines])


_TO_SPACE = bytes(0x20 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, n_words and n_tokens of the whole text.

    Each word, with one space before it, is cut greedily into the longest pieces of the vocabulary from left to
    right; n_tokens is how many. path: vocabulary file that every executor can open, with all single bytes, so
    that no word is left over. Null and empty texts have none. Equal words of a run of texts are counted once; a
    very long text, or word, is read by itself. Rows come out as they come in, repeated ones as often; an empty
    table gives an empty one; a column of `keep` with the name of a new one gives way to it, and others aren't looked at.
    """
    names = kept(keep, "n_words", "n_tokens")
    source = df.select(*names, F.col(text).alias(unused(df, "text")[0]))
    schema = df.select(*names).schema.add("n_words", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(path)
        for batch in batches:
            words, tokens = [], []
            for _, texts in chunks(batch.column(len(names)), RUN_BYTES):
                known: dict[bytes, int] = {}
                number = known.setdefault
                codes = [[number(w, len(known)) for w in x.translate(_TO_SPACE).split()] for x in texts]
                count = automaton.count([b" " + w for w in known])
                words += map(len, codes)
                tokens += [int(count[x].sum()) if x else 0 for x in codes]
            made = [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, "n_words", "n_tokens"])

    return source.mapInArrow(run, schema)
