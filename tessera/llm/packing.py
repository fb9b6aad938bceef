"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import prepare_python, remembered, saved, thrifty

CAPACITY = 2048
#: Distinct words whose ids a worker remembers, and the longest word that it remembers.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 48
#: Words of the texts that are encoded together.
GROUP_WORDS = 200_000
#: Matches that are sent to all executors. More are joined by a shuffle.
BROADCAST_MATCHES = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Pieces that the tokenizer gets as one text.
JOINED = 64

#: White space that Python splits at and the tokenizer's pattern does not, and strings of special tokens.
_UNSAFE = re.compile("[\x1c-\x1f]|<\\|")
#: Words whose lower case and pieces are the same in Python and in the tokenizer, and its pattern for pieces of those (fixed value).
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class _Ids(dict):
    """Little-endian ids of a word. No token of this vocabulary spans white space, so words are encoded one by one.

    Words that a frame meets first are cut into the tokenizer's own pieces (lower-case letters, digits, other signs), and
    only pieces that no word had before are encoded, many in a call: words differ more by case and signs than pieces do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # for pieces, which are in lower case and cut already
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        """A word that was not learned before: too long to keep."""
        return self.encode(word)

    def _learn_pieces(self, new: list[str]) -> None:
        """Ids of pieces: a piece's last token has the mark of a word's end, and no other token of it has."""
        texts = [" ".join(new[at : at + JOINED]) for at in range(0, len(new), JOINED)]
        for at, got in enumerate(self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            own, ids = new[at * JOINED : (at + 1) * JOINED], np.asarray(got.ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(own):
                flat, edges = ids.tobytes(), [0, *(4 * last).tolist()]
                self.pieces.update(zip(own, (flat[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))
            else:
                self.pieces.update((p, self.encode(p)) for p in own)

    def learn(self, words: set[str]) -> None:
        """Make the ids of all of these words known, but for very long ones."""
        new = [w for w in words if w not in self and len(w) <= CACHE_BYTES]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            self.pieces.clear()
            new = [w for w in words if len(w) <= CACHE_BYTES]
        find, plain, of = _PIECES.findall, _PLAIN.fullmatch, self.pieces.get
        waiting, missing = [], set()
        for w in new:
            if not plain(w):
                self[w] = self.encode(w)
                continue
            lower = w.lower()
            ids = of(lower)
            if ids is not None:
                self[w] = ids
                continue
            own = (lower,) if lower.isascii() and lower.isalpha() else tuple(find(lower))
            waiting.append((w, own))
            missing.update(own)
        missing = [p for p in missing if p not in self.pieces]
        if missing:
            self._learn_pieces(missing)
        of = self.pieces.__getitem__
        for w, own in waiting:
            self[w] = of(own[0]) if len(own) == 1 else b"".join(map(of, own))

    def of_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Texts are learned from in groups, so that the words of a few are held at once."""
        group: list[list[str] | str] = []
        held = 0
        for text in texts:
            own = text if _UNSAFE.search(text) else text.split()
            group.append(own)
            held += len(own)
            if held >= GROUP_WORDS:
                yield from self._of_group(group)
                group, held = [], 0
        yield from self._of_group(group)

    def _of_group(self, group: list[list[str] | str]) -> Iterator[bytes]:
        self.learn(set().union(*[own for own in group if not isinstance(own, str)]))
        for own in group:
            yield self.encode(own) if isinstance(own, str) else b"".join(map(self.__getitem__, own))


def _pieces(path: str, capacity: int, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = remembered("packing", path, lambda: _Ids(path))
        for frame in batches:
            rows = []
            for doc_id, found in zip(frame["doc_id"], known.of_all(frame["text"].tolist()), strict=True):
                ids = found + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return pieces


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most `capacity` ids of a document: its ids and then `end_id`. Null text: empty."""
    prepare_python(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(thrifty(_pieces(tokenizer_path, capacity, end_id)), PIECES)


class Gaps:
    """Open sequences by the room that is left, as runs of consecutive sequence numbers.

    Room and lengths are integers up to the capacity, so however many sequences are open, their range-sorted order
    is this many runs of equal room.
    """

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def add(self, room: int, first: int, count: int) -> None:
        if room <= 0:
            return
        if not self.runs[room]:
            insort(self.rooms, room)
        self.runs[room].append((first, count))

    def successor(self, length: int) -> int | None:
        """The least room that holds `length`."""
        at = bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, count: int) -> tuple[int, int]:
        """Up to `count` sequences of one run with this room."""
        first, have = self.runs[room].popleft()
        got = min(have, count)
        if got < have:
            self.runs[room].appendleft((first + got, have - got))
        elif not self.runs[room]:
            self.rooms.remove(room)
        return first, got


def match(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over all pieces at once: (length, from rank, to rank, first sequence, offset).

    One sweep for each length, longest first. A sweep matches the pieces of that length, in the order of their
    ranks, with their successors among the gaps, in the order of theirs, so a gap goes to one piece only; the
    gaps that took a piece are put back with what room is left, and the sweep repeats until no gap holds the length.
    What is left opens new sequences, each with as many pieces of that length as it holds.
    """
    gaps, matches, opened = Gaps(), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (room := gaps.successor(length)) is not None:
            first, got = gaps.take(room, left)
            matches.append((length, rank, rank + got, first, capacity - room))
            gaps.add(room - length, first, got)
            rank, left = rank + got, left - got
        fit = capacity // length
        full, rest = divmod(left, fit)
        for k in range(fit):
            n = full + (k < rest)
            if not n:
                break
            # the first `rest mod fit` places of the last sequence are taken as well
            if full:
                matches.append((length, rank, rank + full, opened, k * length))
                rank += full
        if full:
            gaps.add(capacity - fit * length, opened, full)
        for k in range(rest):
            matches.append((length, rank, rank + 1, opened + full, k * length))
            rank += 1
        if rest:
            gaps.add(capacity - rest * length, opened + full, 1)
        opened += full + bool(rest)
    return matches


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to pieces with columns (doc_id, piece, length).

    Pieces are range-sorted by (length, id, piece) with Spark's external sort and written; a piece's rank among
    those of its length follows from its place in its task and the tasks' counts (at most one count for each task
    and each length at its edges). The matches of ranks with gaps, from match(), are joined back by length and rank.
    The driver holds counts by length and runs of gaps, which the capacity bounds, never rows.

    A piece of length 0 can't occur (a document has at least its end id). Repeated rows are packed each on its own;
    an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(n, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    placed = saved(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "pack-sorted")
    parts = placed.groupBy("length", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")).orderBy("length", "part").collect()
    counts: dict[int, int] = defaultdict(int)
    bases = []
    for p in parts:
        bases.append((p.length, p.part, p.first - counts[p.length]))
        counts[p.length] += p.n
    base = spark.createDataFrame(bases, "length long, part int, base long")
    matches = match(counts, capacity)
    runs = spark.createDataFrame(
        pd.DataFrame(matches, columns=["length", "lo", "hi", "first_sequence", "offset"]).astype("int64")
        if matches else [], T.StructType([T.StructField(c, T.LongType()) for c in ("length", "lo", "hi", "first_sequence", "offset")])
    )
    ranked = placed.join(F.broadcast(base), ["length", "part"]).withColumn("rank", F.col("row") - F.col("base"))
    if len(matches) <= BROADCAST_MATCHES:
        runs = F.broadcast(runs)
    here = (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["lo"]) & (ranked["rank"] < runs["hi"])
    added = {"part", "row", "base", "rank"}
    return ranked.join(runs, here).select(
        *[ranked[c] for c in ranked.columns if c not in added],
        (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"),
        F.col("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole documents, cut those longer than `capacity`, and pack all pieces; one row a piece."""
    pieces = saved(tokenised_pieces(docs, tokenizer_path, capacity, 0, id_col, text_col), "pack-pieces")
    return pack(pieces, capacity)
