"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, saved

#: A repeated run goes if it has so many lines, or so many words.
MIN_LINES, MIN_WORDS = 3, 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_hash(line: Column) -> Column:
    """60 bits of a line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    """The lines that aren't blank, in order: (i: place among all lines, h: hash, n: words). ASCII white space around a line doesn't count."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("x")))
    kept = F.filter(bare, lambda s: s["x"] != "")
    return F.transform(kept, lambda s: F.struct(s["i"].alias("i"), line_hash(s["x"]).alias("h"), F.size(F.split(s["x"], r"[\x20\x09-\x0D]+")).alias("n")))


def _fingerprints(lines: Column) -> Column:
    """One struct (h: the window's least line hash, p: that line's place, k: hash of all its lines, at: their places) for each window, see fingerprints."""

    def of(size: int) -> Column:
        each = F.filter(F.transform(lines, lambda s, p: F.slice(lines, p + 1, size)), lambda w: F.size(w) == size)
        if size < MIN_LINES:
            each = F.filter(each, lambda w: F.aggregate(w, F.lit(0), lambda n, s: n + s["n"]) >= MIN_WORDS)

        def fingerprint(w: Column) -> Column:
            hashes, places = F.transform(w, lambda s: s["h"]), F.transform(w, lambda s: s["i"])
            # of lines with the same least hash the first; hashes of arrays of different sizes differ
            least = F.array_min(hashes)
            return F.struct(least.alias("h"), F.element_at(places, F.array_position(hashes, least).cast("int")).alias("p"), F.xxhash64(hashes).alias("k"), places.alias("at"))

        return F.transform(each, fingerprint)

    return F.concat(*[of(size) for size in range(1, MIN_LINES + 1)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, p, k, at): the least line hash of every window, its place, and the places that a match extends to.

    Windows are MIN_LINES lines one after the other, and fewer lines that have MIN_WORDS words; blank lines aren't counted.
    Equal windows have the same minimum at the same place, so a repeated run of at least MIN_LINES lines or MIN_WORDS
    words has fingerprints with equal `h`, and equal `k` for the window that each is the minimum of. `k` is needed as the
    first line with a hash may stand alone: the first place of the hash in the same surroundings is joined, so no line
    that is frequent elsewhere hides a run.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(_let(_lines(F.col(text_col)), _fingerprints)).alias("w"))
    return rows.select("doc_id", "w.*")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i): lines of runs of at least MIN_LINES lines or MIN_WORDS words that occurred before, at a lesser id or line.

    A fingerprint's position is joined with the first one (least id, then line) of the same fingerprint, never with two
    later ones, so a line that a third of all documents have costs a row for each of them; first positions are
    aggregated before the shuffle. A match extends both ways from the fingerprint's line as far as the window agrees;
    any repeated run is a union of such windows, so runs of any length are followed to their ends.

    Documents without an id take no part. Rows that share an id share their lines' places.
    """
    seeds = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    place = F.struct("doc_id", "p")
    firsts = seeds.groupBy("h", "k").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = seeds.join(firsts, ["h", "k"]).where(place != F.col("first"))
    return again.select("doc_id", F.explode("at").alias("i")).distinct()


def removed_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, places): the places of a document's lines to remove, in order."""
    return repeated_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("places"))


def without_lines(text: Column, gone: Column) -> Column:
    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return _let(F.split(text, "\n"), left)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents, all columns, without their repeated runs of lines; other texts stay as they are, null ones too.

    With `drop_emptied` a document goes if lines were removed and no line but blank ones is left. Rows without an id stay
    as they are; rows that share an id lose the same places. Columns may have any name. An empty table gives an empty result.
    """
    own, gone, left = fresh("id"), fresh("gone"), fresh("left")
    found = removed_by_document(docs, id_col, text_col).select(F.col("doc_id").alias(own), F.col("places").alias(gone))
    marked = docs.join(found, F.col(id_col).cast("long") == F.col(own), "left")
    marked = marked.withColumn(left, without_lines(F.col(text_col), F.col(gone)))
    if drop_emptied:
        marked = marked.where(F.col(gone).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    return marked.select(*[F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(F.col(left)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
