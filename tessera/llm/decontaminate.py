"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, prepare_python, raw, saved, thrifty, words

WINDOW = 10
#: Words of test items in one automaton. More items make more automata, each scanned for in a pass of its own.
AUTOMATON_WORDS = 500_000
#: Bytes of an automaton's states and words in a worker that no automaton may pass, however long its words are.
AUTOMATON_BYTES = 192 << 20
#: Bytes of changed texts that are sent to all executors; more meet their documents by a shuffle.
BROADCAST_BYTES = 32 << 20


def automaton_bytes(sequence_words: int, distinct_words: int, characters: int) -> int:
    """A bound of what an automaton holds: at most two states and three transitions for each word of its items.

    A state has five 4-byte numbers; a transition beyond a state's first is at most an own table of 300 bytes, of which there
    is one for each word at most; a distinct word is a string and a number in a table.
    """
    return sequence_words * (2 * 5 * 4 + 100) + distinct_words * 160 + characters


class SuffixAutomaton:
    """All substrings of several word sequences. A state stands for substrings with the same ends.

    Most states have one way on: it is held in flat arrays; further ways of a state are in a table of their own.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.only, self.goto = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        sequences = []
        for name, item in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item]
            if ids:
                sequences.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min((min(len(ids), window) for _, ids in sequences), default=0)
        self._mark(sequences)

    def to(self, state: int, c: int) -> int:
        """The state that follows by word c; 0 if there is none."""
        if self.only[state] == c:
            return self.goto[state]
        return self.more[state].get(c, 0) if state in self.more else 0

    def _put(self, state: int, c: int, to: int) -> None:
        if self.only[state] in (-1, c):
            self.only[state], self.goto[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _extend(self, last: int, c: int) -> int:
        known = self.to(last, c)
        if known:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, c, known)
        state = self._state(self.length[last] + 1, 0)
        at = last
        while at >= 0 and not self.to(at, c):
            self._put(at, c, state)
            at = self.link[at]
        if at >= 0:
            to = self.to(at, c)
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._clone(at, c, to)
        return state

    def _state(self, length: int, link: int) -> int:
        self.only.append(-1)
        self.goto.append(0)
        self.length.append(length)
        self.link.append(link)
        return len(self.only) - 1

    def _clone(self, at: int, c: int, of: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[of])
        self.only[copy], self.goto[copy] = self.only[of], self.goto[of]
        if of in self.more:
            self.more[copy] = dict(self.more[of])
        self.link[of] = copy
        while at >= 0 and self.to(at, c) == of:
            self._put(at, c, copy)
            at = self.link[at]
        return copy

    def _mark(self, sequences: list[tuple[str, list[int]]]) -> None:
        """own[state]: for windows that end where the state's longest substring does, (words, item names); near[state]: the state itself or the next by suffix links that has one, 0 if none."""
        own: dict[int, dict[int, set[str]]] = {}
        for name, ids in sequences:
            size = min(len(ids), self.window)
            at, length = 0, 0
            for c in ids:
                at, length = self.to(at, c), length + 1
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                length = min(length, self.length[at])
                if length >= size:
                    # the state whose substrings include the one of exactly `size` words
                    own.setdefault(at, {}).setdefault(size, set()).add(name)
        self.own = {state: tuple((size, frozenset(names)) for size, names in sizes.items()) for state, sizes in own.items()}
        self.near = array("i", bytes(4 * len(self.only)))
        for state in np.argsort(np.frombuffer(self.length, dtype="i4"), kind="stable")[1:].tolist():
            self.near[state] = state if state in self.own else self.near[self.link[state]]

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged spans [from, to) of words inside windows, the items hit, the longest match."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        if not self.shortest:
            return spans, items, longest
        get, only, goto, more, link, lengths, near, own = self.vocabulary.get, self.only, self.goto, self.more, self.link, self.length, self.near, self.own
        none: dict[int, int] = {}
        ids = [get(w, -1) for w in text_words]
        known = np.asarray(ids, dtype=np.int64) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        # a window is made of the items' words only: shorter runs of them can't hold one
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < self.shortest:
                continue
            at, length = 0, 0
            for i in range(start, end):
                c = ids[i]
                while True:
                    to = goto[at] if only[at] == c else more.get(at, none).get(c, 0)
                    if to or not at:
                        break
                    at = link[at]
                    length = lengths[at]
                if not to:
                    length = 0
                    continue
                at, length = to, length + 1
                longest = max(longest, length)
                found = near[at]
                while found:
                    for size, names in own[found]:
                        if size <= length:
                            items |= names
                            first = i + 1 - size
                            while spans and spans[-1][1] >= first:
                                first = min(first, spans.pop()[0])
                            spans.append((first, i + 1))
                    found = near[link[found]]
        return spans, items, longest


SCAN = "doc_id long, n_words long, spans array<array<long>>, items array<string>, longest long"


def _scanner(automaton: Broadcast, with_raw: bool, hits_only: bool):
    """Adds what one automaton finds to rows (doc_id, raw, n_words, spans, items, longest); every row stays one row, or goes if `hits_only` and nothing is hit."""
    names_of = [c.split()[0] for c in SCAN.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc_id, text, spans, items, longest in zip(frame["doc_id"], frame["raw"], frame["spans"], frame["items"], frame["longest"], strict=True):
                found = words(text)
                new, names, length = automaton.value.hits(found)
                if new or len(spans) or not hits_only:
                    row = (doc_id, len(found), _merge([*spans, *new]), sorted(names.union(items)), max(length, longest))
                    rows.append((*row, text) if with_raw else row)
            yield pd.DataFrame(rows, columns=[*names_of, "raw"] if with_raw else names_of).astype({"doc_id": "Int64"})

    return thrifty(scan)


def automata(spark: SparkSession, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, limit: int = AUTOMATON_WORDS) -> list[Broadcast]:
    """Broadcast automata of the test items, each of at most `limit` words (or one item).

    The items stream through the driver one partition at a time; an automaton is built and sent whenever `limit` is
    reached, so the driver and a worker hold one of bounded size each time.
    """
    made, group, size, distinct = [], [], 0, set()
    for row in benchmark.select(F.col(id_col).cast("string").alias("name"), raw(text_col).alias("raw")).where("name is not null").toLocalIterator():
        item = words(bytes(row["raw"]))
        if group and (size + len(item) > limit or automaton_bytes(size + len(item), len(distinct) + len(item), sum(map(len, distinct)) + len(row["raw"])) > AUTOMATON_BYTES):
            made.append(spark.sparkContext.broadcast(SuffixAutomaton(group, window)))
            group, size, distinct = [], 0, set()
        group.append((row["name"], item))
        size += len(item)
        distinct.update(item)
    if group or not made:
        made.append(spark.sparkContext.broadcast(SuffixAutomaton(group, window)))
    return made


def _merge(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(x[0]), int(x[1])) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, limit: int = AUTOMATON_WORDS, hits_only: bool = False) -> DataFrame:
    """(doc_id, n_words, spans of hit words, items, longest matching length) for each document row.

    A hit word lies inside an occurrence of `window` consecutive words of an item, or of a whole shorter item.
    Null or empty texts have no words and no hits; items without words or id never occur; an empty benchmark
    hits nothing. Rows that share an id, or have none, are scanned each on its own, whatever the size of the benchmark;
    no row is shuffled. With `hits_only` the rows are those with a hit, and have their text (raw) as well. Very long texts are one row like others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    nothing = "0L n_words", "cast(array() as array<array<long>>) spans", "cast(array() as array<string>) items", "0L longest"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw"), *[F.expr(x) for x in nothing])
    made = automata(spark, benchmark, item_id_col, item_text_col, window, limit)
    for n, a in enumerate(made, 1):
        keep, last = hits_only or n < len(made), n == len(made)
        rows = rows.mapInPandas(_scanner(a, keep, hits_only and last), f"{SCAN}, raw binary" if keep else SCAN)
    return rows


def report(found: DataFrame) -> DataFrame:
    """The digest columns of scan()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest",
    )


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(text: bytes, spans: list) -> bytes:
    """The text without the given spans of words, from the first byte of a span's first word to the last of its last."""
    gone, at, out = [list(x) for x in spans], 0, []
    if not gone:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    for a, b in gone:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 0, max_coverage: float = 0.5, **options) -> DataFrame:
    """Documents with their contaminated spans removed.

    Spans of more than `max_words` words go; a document of whose words more than `max_coverage` are hit goes whole.
    Other documents and columns, of any name, stay as they are. Only the changed texts come from Python, and are
    written; rows with the same id and text get them. Rows that share an id are cut each on its own; null ids are ids
    like others, null and empty texts stay. An empty table gives an empty result, an empty benchmark changes nothing.
    """
    found = scan(docs, benchmark, id_col, text_col, hits_only=True, **options)
    own_id, own_hash, cut = fresh("id"), fresh("hash"), fresh("cut")
    changed = found.select(F.col("doc_id").alias(own_id), F.xxhash64(F.col("raw").cast("string")).alias(own_hash), "raw", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            left = [_cut(t, x, max_words, max_coverage) for t, x in zip(frame["raw"], frame["spans"], strict=True)]
            yield frame[[own_id, own_hash]].astype({own_id: "Int64"}).assign(**{cut: left})

    changed = saved(saved(changed, "hits").mapInPandas(thrifty(run), f"{own_id} long, {own_hash} long, {cut} binary").dropDuplicates([own_id, own_hash]), "cut")
    if (changed.agg(F.sum(F.coalesce(F.length(cut), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        changed = F.broadcast(changed)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(own_hash))
    marked = docs.join(changed, same, "left")
    untouched = F.col(own_hash).isNull()
    return marked.where(untouched | F.col(cut).isNotNull()).select(
        *[(F.when(untouched, F.col(f"`{c}`")).otherwise(F.col(cut).cast("string")).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns]
    )


def _cut(text: bytes, spans: list, max_words: int, max_coverage: float) -> bytes | None:
    """What is left of a text with hit spans; None if it goes whole."""
    found = [[int(a), int(b)] for a, b in spans]
    if sum(b - a for a, b in found) > max_coverage * len(words(text)):
        return None
    return without_spans(text, [[a, b] for a, b in found if b - a > max_words])
