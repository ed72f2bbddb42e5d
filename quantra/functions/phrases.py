"""Which phrases of a table occur in a text: one automaton for all phrases (Aho and Corasick 1975), run over many texts at once.

The automaton is a dense table of states and characters, so a character costs one look-up whatever the number of phrases. It is built once on the driver
from the phrase table (a dimension table, at most MOST_PHRASES rows) and broadcast; tables of more than CELLS cells are split over several automata. In a task every
piece of a text is a lane of a numpy array, and one step takes the next character of every lane.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST_PHRASES, CELLS = 1_000_000, 1 << 24
#: Characters of a piece, without what it shares with the next one; lanes of one step.
PIECE, LANES = 1024, 1 << 16


class Automaton:
    """Finds where any of the phrases ends; blank phrases never occur."""

    def __init__(self, phrases: list[tuple[int, str]]) -> None:
        points = np.unique(np.frombuffer("".join(p for _, p in phrases).encode("utf-32-le"), np.uint32))
        self.alphabet, kinds = points, len(points) + 1  # 0: a character of no phrase
        code = {chr(c): k + 1 for k, c in enumerate(points.tolist())}
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int]] = []
        for number, phrase in phrases:
            state = 0
            for c in phrase:
                following = children[state].setdefault(code[c], len(children))
                if following == len(children):
                    children.append({})
                state = following
            if state:
                ends.append((state, number))
        self.longest = max((len(p) for _, p in phrases), default=0)
        self.table = np.zeros((len(children), kinds), np.int32)
        fail = np.zeros(len(children), np.int64)
        level = [0]
        while level:  # breadth first: a state's table is that of its fallback, but for its own children
            following = []
            for state in level:
                if state:
                    self.table[state] = self.table[fail[state]]
                for c, child in children[state].items():
                    fail[child] = self.table[fail[state], c] if state else 0
                    following.append(child)
                for c, child in children[state].items():
                    self.table[state, c] = child
            level = following
        ends.sort()
        self.at, self.numbers = np.array([s for s, _ in ends], np.int64), np.array([n for _, n in ends], np.int64)
        final = np.zeros(len(children), bool)
        final[self.at] = True
        # the next state with phrases among a state's fallbacks, itself first
        self.ending = np.zeros(len(children), np.int32)
        self.further = np.zeros(len(children), np.int32)
        order, level = [0], [0]
        while level:
            level = [c for s in level for c in children[s].values()]
            order += level
        for state in order[1:]:
            self.further[state] = self.ending[fail[state]]
            self.ending[state] = state if final[state] else self.further[state]

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase number) of all phrases that occur, in that order, each once a row."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        codes = np.where(self.alphabet[at] == points, at + 1, 0) if len(self.alphabet) else np.zeros(len(points), np.int64)
        pieces = -(-size // PIECE)
        row = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(size) - size)[row] + place * PIECE
        length = np.minimum(PIECE + max(0, self.longest - 1), size[row] - place * PIECE)
        found = []
        for lo in range(0, len(row), LANES):
            part = np.argsort(-length[lo : lo + LANES], kind="stable") + lo
            found += list(self._walk(codes, row[part], start[part], length[part]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        span = int(self.numbers.max(initial=0)) + 1
        return both // span, both % span

    def _walk(self, codes: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        kinds, flat, span = self.table.shape[1], self.table.ravel(), int(self.numbers.max(initial=0)) + 1
        state = np.zeros(len(row), np.int64)
        live = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        for k, n in enumerate(live.tolist()):
            state[:n] = flat[state[:n] * kinds + codes[start[:n] + k]]
            lane = np.flatnonzero(self.ending[state[:n]])
            ending = self.ending[state[lane]]
            while len(lane):
                a, b = np.searchsorted(self.at, ending), np.searchsorted(self.at, ending, side="right")
                for extra in range(int((b - a).max())):  # phrases of one text
                    more = a + extra < b
                    yield row[lane[more]] * span + self.numbers[(a + extra)[more]]
                ending = self.further[ending]
                lane, ending = lane[ending > 0], ending[ending > 0]


class Phrases:
    """The automata of a phrase table, and the table itself in its order, as Arrow."""

    def __init__(self, rows: pa.Table, phrase: str) -> None:
        self.rows = rows.drop_columns([phrase])
        parts: list[list[tuple[int, str]]] = [[]]
        size, kinds = 1, set()
        for n, p in enumerate(rows[phrase].to_pylist()):
            if p:
                if (size + len(p)) * (len(kinds | set(p)) + 1) > CELLS and parts[-1]:
                    parts.append([])
                    size, kinds = 1, set()
                parts[-1].append((n, p))
                size += len(p)
                kinds |= set(p)
        self.automata = [Automaton(p) for p in parts if p]

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [a.find(texts) for a in self.automata]
        if len(got) == 1:
            return got[0]
        row, number = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        order = np.lexsort((number, row))
        return row[order], number[order]


def _collected(table: DataFrame, phrase: Column, *order: str) -> Phrases:
    rows = table.select("*", phrase.alias("__phrase")).orderBy(*order, *(c for c in table.columns if c not in order)).limit(MOST_PHRASES + 1).toArrow()
    if rows.num_rows > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return Phrases(rows.combine_chunks(), "__phrase")


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def occurring(text: Column, table: DataFrame, phrase: Column, *order: str) -> Column:
    """The rows of table (a list of structs, by `order`) whose phrase occurs in text, both as given; blank phrases and null texts have none."""
    phrases = _collected(table, phrase, *order)
    shared = table.sparkSession.sparkContext.broadcast(phrases)
    kind = f"array<{table.schema.simpleString()}>"
    arrow = to_arrow_type(table.schema)

    @F.arrow_udf(kind)
    def find(column: pa.Array) -> pa.Array:
        held = shared.value
        row, number = held.find(_texts(column))
        taken = held.rows.take(pa.array(number)).combine_chunks()
        values = pa.StructArray.from_arrays([(taken[f.name].chunk(0) if taken[f.name].num_chunks else pa.array([], f.type)).cast(f.type) for f in arrow], fields=list(arrow))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(column) + 1)), pa.int32()), values)

    return find.asNondeterministic()(text)  # so that a filter on what it finds does not run it again


def replaced(text: Column, table: DataFrame, phrase: Column, new: Column, bias: Column, *order: str) -> Column:
    """struct t (text after every phrase of the table in its order, whole words only) and h (phrase and bias of those that occurred as a part of the text when their turn came).

    After a phrase had its turn the text is searched again, so what a replacement brings in counts for the phrases that follow.
    """
    phrases = _collected(table.select(*order, new.alias("new"), bias.alias("bias"), phrase.alias("phrase")), F.col("phrase"), *order)
    shared = table.sparkSession.sparkContext.broadcast(phrases)

    @F.arrow_udf("t string, h array<struct<a:string,b:string>>")
    def fold(column: pa.Array) -> pa.Array:
        held = shared.value
        names, news, biases = (held.rows[c].to_pylist() for c in ("phrase", "new", "bias"))
        texts = _texts(column)
        hits: list[list[dict]] = [[] for _ in texts]
        turn = np.full(len(texts), -1)
        live = np.arange(len(texts))
        while len(live):
            row, number = held.find([texts[i] for i in live.tolist()])
            later = number > turn[live[row]]
            row, first = np.unique(row[later], return_index=True)
            live, number = live[row], number[later][first]
            for i, k in zip(live.tolist(), number.tolist()):
                texts[i] = re.sub(rf"\b{re.escape(names[k])}\b", lambda _, to=news[k]: to, texts[i], flags=re.ASCII)
                hits[i].append({"a": names[k], "b": biases[k]})
            turn[live] = number
        hit = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(hits, hit)], fields=[pa.field("t", pa.string()), pa.field("h", hit)])

    return fold.asNondeterministic()(text)
