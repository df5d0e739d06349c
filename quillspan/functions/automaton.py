"""Finding many phrases at once in columns of text.

The phrases are bytes of one automaton: a state stands for the longest beginning of any phrase that ends at the present
byte, and knows the first listed phrase that ends there. One step a byte finds all phrases, so the cost does not depend on
how many there are. The table (a row per state, a column per byte in use) is complete: no step looks twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Cells of one automaton's table (64 MB); longer lists are cut into several automata.
MAX_CELLS = 1 << 24
#: Bytes of text that one lane walks; a longer text is walked in several lanes at once.
LANE = 256
NONE = np.iinfo(np.int32).max


@dataclass
class Automaton:
    """``move[state * width + symbol]`` is the next state, ``first[state]`` the least number of a phrase that ends there."""

    symbol: np.ndarray
    width: int
    move: np.ndarray
    first: np.ndarray
    longest: int

    @classmethod
    def of(cls, phrases: list[bytes], numbers: list[int]) -> Automaton:
        """Built level by level, so that a state's fallback (a shallower state) is complete before it is needed."""
        order = sorted(range(len(phrases)), key=phrases.__getitem__)
        data = np.frombuffer(b"".join(phrases[n] for n in order), np.uint8)
        length = np.array([len(phrases[n]) for n in order], np.int64)
        offset = np.cumsum(length) - length
        number = np.array([numbers[n] for n in order], np.int64)
        used = np.unique(data)
        symbol = np.zeros(256, np.int32)  # bytes that no phrase holds share symbol 0
        symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        levels, alive, state, depth, size = [], np.arange(len(order)), np.zeros(len(order), np.int64), 0, 1
        ends = []
        while len(alive):
            done = length[alive] == depth
            ends.append((state[done], number[alive[done]]))
            alive, state = alive[~done], state[~done]
            if not len(alive):
                break
            by = symbol[data[offset[alive] + depth]]
            new = np.append(True, (state[1:] != state[:-1]) | (by[1:] != by[:-1]))
            made = size + np.arange(int(new.sum()))
            levels.append((made, state[new], by[new]))
            state = made[np.cumsum(new) - 1]
            size += len(made)
            depth += 1
        move, first, back = np.zeros((size, width), np.int32), np.full(size, NONE, np.int64), np.zeros(size, np.int64)
        for at, which in ends:
            np.minimum.at(first, at, which)
        for level, (made, parent, by) in enumerate(levels):
            if level:
                back[made] = move[back[parent], by]
            move[parent, by] = made
            # A state moves as its fallback does, until the next level puts in its children.
            move[made] = move[back[made]]
            first[made] = np.minimum(first[made], first[back[made]])
        return cls(symbol, width, move.ravel(), first.astype(np.int32), int(length.max(initial=0)))

    def find(self, texts: pa.Array) -> np.ndarray:
        """Per text the least number of a phrase in it, or ``NONE``; all lanes advance together, a byte a step."""
        held = texts.cast(pa.large_binary())
        bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
        found = np.full(len(texts), NONE, np.int32)
        size = np.diff(bounds)
        span = max(LANE, 4 * self.longest)
        lanes = -(-size // span)
        text = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = bounds[:-1][text] + nth * span
        # A lane goes on into the next one's stretch by what a phrase that begins in its own may still need.
        stop = np.minimum(start + span + max(0, self.longest - 1), bounds[1:][text])
        order = np.argsort(start - stop, kind="stable")
        text, start, length = text[order], start[order], (stop - start)[order]
        state, best = np.zeros(len(text), np.int32), np.full(len(text), NONE, np.int32)
        for step in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -step, "left"))
            state = self.move[state[:n].astype(np.int64) * self.width + self.symbol[data[start[:n] + step]]]
            best[:n] = np.minimum(best[:n], self.first[state])
        np.minimum.at(found, text, best)
        return found


def automata(phrases: list[str], max_cells: int = MAX_CELLS) -> list[Automaton]:
    """Automata for the phrases in list order; empty phrases are in every text and belong to the caller."""
    held: dict[bytes, int] = {}
    for number, phrase in enumerate(phrases):
        held.setdefault(phrase.encode(), number)
    width = len(set(b"".join(held))) + 1
    out, some, cells = [], [], 0
    for phrase in sorted(held):
        if some and cells + (len(phrase) + 1) * width > max_cells:
            out.append(Automaton.of(some, [held[p] for p in some]))
            some, cells = [], 0
        some.append(phrase)
        cells += (len(phrase) + 1) * width
    if some:
        out.append(Automaton.of(some, [held[p] for p in some]))
    return out


def first_phrase(spark: SparkSession, phrases: list[str], text: Column) -> Column:
    """Number (from 0) of the first listed phrase that the text holds, or null; works in batches and streams.

    The automata are built once and broadcast; a list is configuration and goes through the driver as a whole.
    """
    shared = spark.sparkContext.broadcast(automata(phrases))

    @F.arrow_udf("int")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machines = shared.value
        for texts in batches:
            best = np.full(len(texts), NONE, np.int32)
            for machine in machines:
                best = np.minimum(best, machine.find(texts.fill_null("")))
            yield pa.array(best, pa.int32(), mask=(best == NONE) | texts.is_null().to_numpy(zero_copy_only=False))

    return find(text)
