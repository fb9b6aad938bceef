"""Fingerprint tables and candidate joins. Long tables (id, fp) are canonical; sets travel as sizes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tessera.functions import hashing, similarity

K, W = 15, 5


#: Tokens that are hashed together, unless one module has more.
CHUNK_TOKENS = 1 << 20


def _winnowed(k: int, w: int, positions: bool, lists: bool = False):
    # made here so that it travels to executors by value
    bound = CHUNK_TOKENS

    def chosen(tokens):
        """Row, fingerprint and, if asked for, position of what is chosen in each list of tokens."""
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = tokens.flatten().cast(pa.binary()).dictionary_encode()
        hashed = np.array([int.from_bytes(hashlib.sha256(b"\x2a\0\0\0" + x).digest()[:4], "big") for x in words.dictionary.to_pylist()], dtype=np.uint64)
        # fewer than k tokens are all hashed together, and zeros before them change nothing
        size = np.where(n > 0, np.maximum(n, k), 0)
        first = np.cumsum(size) - size
        within = lambda count: np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x = np.zeros(size.sum(), dtype=np.uint64)
        x[np.repeat(first + size - n, n) + within(n)] = hashed[words.indices.to_numpy()]
        count = np.where(n > 0, size - k + 1, 0)
        rolled = np.zeros(max(len(x) - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            rolled = (rolled * np.uint64(257) + x[j : j + len(rolled)]) % np.uint64(2**31 - 1)
        place = within(count)
        g = rolled[np.repeat(first, count) + place]
        if positions:  # the rightmost of equal ones is the least
            g = (g << np.uint64(32)) | (np.uint64(2**32 - 1) - place.astype(np.uint64))
        least = g[: max(len(g) - w + 1, 0)].copy()
        for j in range(1, w):
            np.minimum(least, g[j : j + len(least)], out=least)
        start = np.cumsum(count) - count
        few, windows = np.where(count <= w, count, 0), np.maximum(count - w + 1, 0) * (count > w)
        row = np.concatenate((np.repeat(np.arange(len(n)), few), np.repeat(np.arange(len(n)), windows)))
        g = np.concatenate((g[np.repeat(start, few) + within(few)], least[np.repeat(start, windows) + within(windows)]))
        # neighbouring windows mostly have the same least hash
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])))[: len(row)]
        row, g = row[new], g[new]
        h = g >> np.uint64(32) if positions else g
        each = (row.astype(np.uint64) << np.uint64(31)) | h
        if not positions:
            each = np.unique(each)
            return (each >> np.uint64(31)).astype(np.int64), {"fp": (each & np.uint64(2**31 - 1)).astype(np.int64)}
        at = np.uint64(2**32 - 1) - (g & np.uint64(2**32 - 1))
        order = np.lexsort((at, each))
        each, at = each[order], at[order]
        last = np.append(each[1:] != each[:-1], True)[: len(each)]
        return row[order][last], {"fp": h[order][last].astype(np.int64), "pos": at[last].astype(np.int64)}

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            tokens, keys = batch.column(batch.num_columns - 1), pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            ends = np.cumsum([0, *(x or 0 for x in pc.list_value_length(tokens).to_pylist())])
            at = 0
            while at < len(tokens):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + bound, "right")) - 1)
                row, columns = chosen(tokens.slice(at, to - at))
                if len(row) and lists:
                    n = np.bincount(row)
                    mine = keys.slice(at, to - at).take(pa.array(np.flatnonzero(n)))
                    starts = np.append(0, np.cumsum(n[n > 0])).astype(np.int32)
                    fp, pos = (columns[c].astype(np.int32) for c in ("fp", "pos"))
                    parts = [(fp[i:j].tobytes(), pos[i:j].tobytes()) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                    arrays = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (fp, pos)]
                    digests = [pa.array([hashlib.sha256(x).digest() for x in each], pa.binary()) for each in ([x for x, _ in parts], [x + y for x, y in parts])]
                    yield pa.RecordBatch.from_arrays([*mine.columns, *arrays, *digests], names=[*keys.schema.names, "fps", "at", "class", "place"])
                elif len(row):
                    mine = keys.slice(at, to - at).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*mine.columns, *map(pa.array, columns.values())], names=[*keys.schema.names, *columns])
                at = to

    return run


def _chosen(modules: DataFrame, tokens: Column, keys: list[str], k: int, w: int, positions: bool) -> DataFrame:
    rows = modules.select(*keys, tokens.alias("tokens"))
    schema = StructType([*rows.schema.fields[:-1], StructField("fp", LongType()), *[StructField("pos", LongType())] * positions])
    return rows.mapInArrow(_winnowed(k, w, positions), schema)


def fingerprints(modules: DataFrame, tokens: Column, keys: list[str], k: int = K, w: int = W) -> DataFrame:
    """One row for each distinct winnowed fingerprint of a module: keys, fp. Row-local, no shuffle.

    The same as hashing.winnow of hashing.kgram_hashes of hashing.stable_hash, over flat arrays of many modules at once.
    """
    return _chosen(modules, tokens, keys, k, w, False)


def fingerprint_positions(modules: DataFrame, tokens: Column, keys: list[str], k: int = K, w: int = W) -> DataFrame:
    """keys, fp, pos: the last position at which each fingerprint was chosen."""
    return _chosen(modules, tokens, keys, k, w, True).groupBy(*keys, "fp").agg(F.max("pos").alias("pos"))


def fingerprint_sets(modules: DataFrame, tokens: Column, key: str = "id", k: int = K, w: int = W) -> DataFrame:
    """id, fps, at, class, place: a row for each module with fingerprints, which are in order.

    `at` has the last position at which each was chosen; equal digests `class` stand for equal fps, `place` for equal fps and at.
    """
    rows = modules.select(F.col(key).alias("id"), tokens.alias("tokens"))
    numbers = ArrayType(IntegerType())
    fields = [StructField("fps", numbers), StructField("at", numbers), StructField("class", BinaryType()), StructField("place", BinaryType())]
    each = rows.mapInArrow(_winnowed(k, w, True, True), StructType([rows.schema.fields[0], *fields]))
    parts = each.groupBy("id").agg(F.collect_list(F.struct("fps", "at", "class", "place")).alias("parts"))
    # rows that share an id are one module
    zipped = F.flatten(F.transform("parts", lambda p: F.zip_with(p["fps"], p["at"], lambda x, y: F.struct(x.alias("fp"), y.alias("at")))))
    last = F.transform(F.array(F.array_sort(zipped)), lambda s: F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["fp"] != x["fp"])))[0]
    digest = lambda x: F.unhex(_digest(x))
    joined = F.transform(F.array(last), lambda m: F.struct(m["fp"].alias("fps"), m["at"].alias("at"), digest(m["fp"]).alias("class"), digest(m).alias("place")))[0]
    return parts.select("id", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(joined).alias("m")).select("id", "m.*")


def structure_fingerprints(trees: DataFrame, types: Column, keys: list[str], w: int = W) -> DataFrame:
    """Hashes of consecutive chunks of w node types, without the incomplete last; of all types if fewer than w."""
    rows = trees.select(*keys, types.alias("types")).where(F.size("types") > 0)
    n = F.size("types")
    starts = F.when(n < w, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1)), F.lit(w)))
    return rows.select(*keys, F.explode(F.array_distinct(F.transform(starts, lambda i: hashing.stable_hash(F.array_join(F.slice("types", i, w), ","))))).alias("fp"))


def with_sizes(fps: DataFrame, key: str = "id") -> DataFrame:
    """Add n, the number of a module's fingerprints."""
    return fps.withColumn("n", F.count("*").over(Window.partitionBy(key)))


def overlaps(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, overlap) of modules that share a fingerprint: an equi-join and a count."""
    return left.select(F.col(key).alias("a"), "fp").join(right.select(F.col(key).alias("b"), "fp"), "fp").groupBy("a", "b").agg(F.count("*").alias("overlap"))


def similar_pairs(fps: DataFrame, threshold: float, key: str = "id") -> DataFrame:
    """(a, b, overlap, n_a, n_b, similarity) of all pairs a < b with at least `threshold` of 100.

    A pair this similar has sizes in that proportion, so the join leaves others out before they are counted. And its
    union has at most n_a + n_b elements, so it shares one of either module's first n - ceil(t * n) + 1 fingerprints in
    any fixed order: candidates come from those prefixes, rarest fingerprints first, and whole sets are counted for
    candidates only. A fingerprint that very many modules have is thus rarely joined with itself.

    Modules with the same set are one class: its least module is paired with those of other classes, and the pairs of
    classes are then those of their modules.
    """
    sets = fps.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 0)
    return similar_sets(sets.withColumn("class", _digest(F.col("fps"))), threshold)


def set_classes(sets: DataFrame) -> DataFrame:
    """class, id, fps, members: classes of modules (id, fps, class) with the same set, each with its least module and their number."""
    return sets.groupBy("class").agg(F.min("id").alias("id"), F.min_by("fps", "id").alias("fps"), F.count("*").alias("members"))


def similar_classes(one: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, overlap) of all pairs class_a < class_b of different sets (id, fps), as in similar_pairs."""
    each = one.select(F.col("id").alias("class"), F.explode("fps").alias("fp"))
    df = each.groupBy("fp").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(df, "fp").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "fp"))).alias("met"))
    # fingerprints of no other class come first of all, so those that are met have the last places
    placed = one.select(F.col("id").alias("class"), F.size("fps").cast("long").alias("n")).join(ordered, "class")
    keep = (F.col("n") - F.ceil(F.col("n") * max(threshold, 0.0) / 100 - 1e-9) + 1 - (F.col("n") - F.size("met"))).cast("int")
    prefix = placed.select("class", "n", F.explode(F.slice("met", 1, F.greatest(keep, F.lit(0)))).alias("m")).select("class", "n", "m.fp").persist(StorageLevel.DISK_ONLY)
    a, b = ([F.col("class").alias(f"class_{x}"), "fp", F.col("n").alias(f"n_{x}")] for x in "ab")
    near = (F.least("n_a", "n_b") * 100.0 >= F.greatest("n_a", "n_b") * threshold) & (F.col("class_a") < F.col("class_b"))
    candidates = prefix.select(*a).join(prefix.select(*b), "fp").where(near).select("class_a", "class_b").distinct()
    side = lambda x: one.select(F.col("id").alias(f"class_{x}"), F.col("fps").alias(f"fps_{x}"))
    shared = candidates.join(side("a"), "class_a").join(side("b"), "class_b").select("class_a", "class_b", F.size(F.array_intersect("fps_a", "fps_b")).cast("long").alias("overlap"), F.size("fps_a").alias("x"), F.size("fps_b").alias("y"))
    return shared.where((F.col("overlap") > 0) & (similarity.jaccard(F.col("overlap"), F.col("x"), F.col("y")) >= threshold)).select("class_a", "class_b", "overlap")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """similar_pairs of modules (id, fps, class): equal classes stand for equal sets."""
    one = set_classes(sets).persist(StorageLevel.DISK_ONLY)
    alike = similar_classes(one, threshold)
    members = sets.select("class", F.col("id").alias("member"), F.size("fps").cast("long").alias("n")).join(one.select("class", "id"), "class")
    p, q = (members.select(F.col("id").alias(f"class_{x}"), F.col("member").alias(x), F.col("n").alias(f"n_{x}")) for x in "pq")
    across = alike.join(p, F.col("class_a") == F.col("class_p")).join(q, F.col("class_b") == F.col("class_q"))
    same = p.join(q, (F.col("class_p") == F.col("class_q")) & (F.col("p") < F.col("q"))).withColumn("overlap", F.col("n_p"))
    pairs = across.select("p", "q", "n_p", "n_q", "overlap").unionByName(same.select("p", "q", "n_p", "n_q", "overlap"))
    turned = F.col("p") > F.col("q")
    of = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    counted = pairs.select(of("p", "q", "a"), of("q", "p", "b"), of("n_p", "n_q", "n_a"), of("n_q", "n_p", "n_b"), "overlap")
    return counted.withColumn("similarity", similarity.jaccard(F.col("overlap"), F.col("n_a"), F.col("n_b"))).where(F.col("similarity") >= threshold)


def _digest(values: Column) -> Column:
    """The same for equal arrays only, as far as SHA-256 tells."""
    return F.sha2(F.to_json(values).cast("binary"), 256)


def lookup(query: DataFrame, index: DataFrame, k: int, key: str = "id") -> DataFrame:
    """For each query module the k modules of the index that share most fingerprints; ties by id. (a, b, overlap, rank)."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "b"))
    return overlaps(query, index, key).withColumn("rank", rank).where(F.col("rank") <= k)


def replace_modules(index: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The index with the rows of changed modules in place of their old ones."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def duplicates(fps: DataFrame, key: str = "id") -> DataFrame:
    """(id, others): modules that share a fingerprint, sorted."""
    pairs = overlaps(fps, fps, key).where("a <> b")
    return pairs.groupBy(F.col("a").alias(key)).agg(F.array_sort(F.collect_set("b")).alias("others"))


def continuity(positions: DataFrame, pairs: DataFrame, key: str = "id", gap: int = 2) -> DataFrame:
    """(a, b, common, longest, continuity): the longest run of common fingerprints whose positions advance by at most `gap` in both.

    Modules with the same fingerprints at the same positions are one class, and each pair of classes is compared once.
    """
    places = positions.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct("fp", "pos"))).alias("s"))
    return set_continuity(places.select("id", F.col("s.fp").alias("fps"), F.col("s.pos").alias("at"), _digest(F.col("s")).alias("place")), pairs, gap)


def set_continuity(places: DataFrame, pairs: DataFrame, gap: int = 2) -> DataFrame:
    """continuity of modules (id, fps, at, place): equal places stand for equal fps and positions, and the least module for all of them."""
    own = places.select("id", "place")
    named = pairs.select("a", "b")
    same = own.join(own.groupBy("place").agg(F.min("id").alias("least")), "place")
    for x in "ab":
        named = named.join(same.select(F.col("id").alias(x), F.col("least").alias(f"class_{x}")), x)
    compared = named.select("class_a", "class_b").distinct()
    for x in "ab":
        compared = compared.join(places.select(F.col("id").alias(f"class_{x}"), F.col("fps").alias(f"fp_{x}"), F.col("at").alias(f"pos_{x}")), f"class_{x}")
    name = dict(places.dtypes)["id"]
    runs = compared.select("class_a", "class_b", "fp_a", "pos_a", "fp_b", "pos_b").mapInArrow(_longest_runs(gap), f"class_a {name}, class_b {name}, common long, longest long")
    found = named.join(runs.where("common > 0"), ["class_a", "class_b"])
    return found.select("a", "b", "common", "longest", (F.col("longest") * 100.0 / F.col("common")).alias("continuity"))


def _longest_runs(gap: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            common, longest = [], []
            for fa, pa_, fb, pb in zip(*(batch.column(c) for c in range(2, 6)), strict=True):
                fa, pa_, fb, pb = (x.values.to_numpy(zero_copy_only=False) for x in (fa, pa_, fb, pb))
                fp, i, j = np.intersect1d(fa, fb, assume_unique=True, return_indices=True)
                order = np.lexsort((fp, pb[j], pa_[i]))
                x, y = pa_[i][order], pb[j][order]
                ends = np.flatnonzero(np.concatenate(([True], (np.diff(x) > gap) | (np.abs(np.diff(y)) > gap), [True]))) if len(fp) else np.zeros(1, dtype=int)
                most = int(np.diff(ends).max(initial=0))
                common.append(len(fp))
                longest.append(most if most > 1 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(longest, pa.int64())], names=["class_a", "class_b", "common", "longest"])

    return run


def token_continuity(tokens: DataFrame, pairs: DataFrame, key: str = "id", n: int = 5) -> DataFrame:
    """(a, b, continuity) as by similarity.token_continuity, of tokens (key, t) by pairs (a, b).

    Runs are made once for each module, and travel as 64 bits of their hash. Pairs of equal tokens need no comparison.
    """
    own = tokens.select(F.col(key).alias("id"), _digest(F.col("t")).alias("class"), "t")
    named = pairs.select("a", "b")
    for x in "ab":
        named = named.join(own.select(F.col("id").alias(x), F.col("class").alias(f"class_{x}"), (F.size("t") > 0).alias(f"some_{x}")), x)
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i, n), " ")))
    none = F.array().cast("array<bigint>")
    runs = own.groupBy("class").agg(F.min_by("t", "id").alias("t")).select("class", F.when(F.size("t") < n, none).otherwise(F.array_distinct(grams(F.col("t")))).alias("runs"))
    compared = named.where("class_a <> class_b").select("class_a", "class_b").distinct()
    for x in "ab":
        compared = compared.join(runs.select(F.col("class").alias(f"class_{x}"), F.col("runs").alias(f"runs_{x}")), f"class_{x}")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    short = (F.size("runs_a") == 0) | (F.size("runs_b") == 0)
    measured = compared.select("class_a", "class_b", F.when(short, 0.0).otherwise(similarity.jaccard(shared, F.size("runs_a"), F.size("runs_b"))).alias("measured"))
    same = F.when(F.col("class_a") == F.col("class_b"), F.when(F.col("some_a"), 100.0).otherwise(0.0))
    return named.join(measured, ["class_a", "class_b"], "left").select("a", "b", F.coalesce(same, "measured").alias("continuity"))


def signatures(fps: DataFrame, perms: list[tuple[int, int]], key: str = "id") -> DataFrame:
    """(id, sig): MinHash signatures of modules."""
    return set_signatures(fps.groupBy(key).agg(F.collect_set("fp").alias("fps")), perms, key)


def set_signatures(sets: DataFrame, perms: list[tuple[int, int]], key: str = "id") -> DataFrame:
    """(id, sig) of modules (id, fps), the same as by hashing.minhash, over flat arrays."""
    rows = sets.where(F.size("fps") > 0).select(key, "fps")
    return rows.mapInArrow(_minhashed(perms), StructType([rows.schema.fields[0], StructField("sig", ArrayType(IntegerType()))]))


def _minhashed(perms: list[tuple[int, int]]):
    # made here so that it travels to executors by value
    bound, modulus = 1 << 15, hashing.MODULUS  # numbers at a time, unless one module has more

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        m, half = np.uint64(modulus), np.uint64(31)
        pairs = [(np.uint64(a), np.uint64(b)) for a, b in perms]
        for batch in batches:
            ends = np.cumsum([0, *pc.list_value_length(batch.column(1)).to_pylist()])
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            sig = np.empty((len(batch), len(pairs)), dtype=np.int32)
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + bound, "right")) - 1)
                x, starts = flat[ends[at] : ends[to]], ends[at:to] - ends[at]
                for j, (a, b) in enumerate(pairs):
                    v = a * x + b
                    for _ in range(2):  # the modulus is 2**31 - 1
                        v = (v & m) + (v >> half)
                    sig[at:to, j] = np.minimum.reduceat(np.minimum(v, v - m), starts)
                at = to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(pairs), pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "sig"])

    return run


def banded_candidates(sigs: DataFrame, rows: int, key: str = "id") -> DataFrame:
    """(a, b, estimate): pairs a < b that agree in a band of `rows` slots, and their share of equal slots."""
    name = sigs.select(key).dtypes[0][1]
    slotted = sigs.select(F.col(key).alias("id"), F.col("sig").cast("array<int>").alias("sig"))
    banded = slotted.mapInArrow(_bands(rows), f"id {name}, bucket binary")
    a, b = banded.withColumnRenamed("id", "a"), banded.withColumnRenamed("id", "b")
    pairs = a.join(b, "bucket").where("a < b").select("a", "b").distinct()
    signed = pairs.join(slotted.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(slotted.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return signed.select("a", "b", "sa", "sb").mapInArrow(_estimates(), f"a {name}, b {name}, estimate double")


def _bands(rows: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            sig = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for i in range(0, sig.shape[1], rows):
                # the band's number and its slots, as bytes
                slots = np.column_stack((np.full(len(batch), i, dtype=np.int32), sig[:, i : i + rows].astype(np.int32)))
                width = slots.shape[1] * 4
                buckets = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(batch), [None, pa.py_buffer(slots.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), buckets], names=["id", "bucket"])

    return run


def _estimates():
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in (2, 3))
                equal = (x == y).sum(axis=1) / x.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal)], names=["a", "b", "estimate"])

    return run


def tuning(sets: DataFrame, perms: list[tuple[int, int]], rows: int, thresholds: list[float], similarity: float) -> DataFrame:
    """(threshold, found, good, all): pairs of modules (id, fps, class) by MinHash, those of at least `similarity` of them, and all such.

    Modules with the same set are one class. Only pairs of classes are compared, and count as often as they have pairs of modules;
    the pairs within a class have the estimate 1.
    """
    one = set_classes(sets).persist(StorageLevel.DISK_ONLY)
    count = lambda x: one.select(F.col("id").alias(x), F.col("members").alias(f"n_{x}"))
    weighed = lambda pairs: pairs.join(count("a"), "a").join(count("b"), "b").withColumn("n", F.col("n_a") * F.col("n_b"))
    same = one.where("members > 1").selectExpr("1d as estimate", "true as true", "members * (members - 1) div 2 as n")
    alike = similar_classes(one, similarity).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), F.lit(True).alias("true")).persist(StorageLevel.DISK_ONLY)
    signed = set_signatures(one, perms).persist(StorageLevel.DISK_ONLY)
    scored = weighed(banded_candidates(signed, rows).where(F.col("estimate") >= min(thresholds)).join(alike, ["a", "b"], "left"))
    each = scored.select("estimate", "true", "n").unionByName(same.select("estimate", "true", "n"))
    grid = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("estimate"))).alias("threshold")
    hits = each.select(grid, "true", "n").groupBy("threshold").agg(F.sum("n").alias("found"), F.sum(F.when(F.col("true"), F.col("n")).otherwise(0)).alias("good"))
    total = weighed(alike).select("n").unionByName(same.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return hits.crossJoin(total)


def vector_buckets(vectors: DataFrame, bands: int = 8, rows: int = 4, key: str = "id") -> DataFrame:
    """(id, band, bucket) of vectors: the slots of each band with four decimals, joined and hashed.

    Bands past the vector's end are left out, and bands of zeros only, in which nearly all sparse vectors would meet.
    """
    text = lambda i: F.array_join(F.transform(F.slice("v", i * rows + 1, rows), lambda x: F.replace(F.format_number(x, 4), F.lit(","), F.lit(""))), ",")
    within = F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: (i * rows < F.size("v")) & F.exists(F.slice("v", i * rows + 1, rows), lambda x: x != 0))
    slots = F.transform(within, lambda i: F.struct(i.alias("band"), F.substring(F.md5(text(i).cast("binary")), 1, 8).alias("bucket")))
    return vectors.select(key, F.explode(slots).alias("s")).select(key, "s.band", "s.bucket")


def vector_lookup(query: DataFrame, index: DataFrame, k: int, least: int = 2, key: str = "id") -> DataFrame:
    """(a, b, bands, cosine, rank): for each query vector the k nearest of those that agree with it in `least` bands; ties by id."""
    spoken = lambda rows, x: rows.where(F.size("v") > 0).select(F.col(key).alias(x), "v", _digest(F.col("v")).alias("class"))
    asked, all_ = spoken(query, "a"), spoken(index, "b")
    # equal vectors are one class, which is compared once; of a class only the first k + 1 ids can be among the k nearest others
    first = Window.partitionBy("class").orderBy("b")
    members = all_.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    have = members.where("place = 1").select(F.col("class").alias("id"), "v", F.col("b").alias("least"))
    want = asked.groupBy("class").agg(F.first("v").alias("v")).withColumnRenamed("class", "id")
    x, y = (vector_buckets(t.select("id", "v"), key="id").withColumnRenamed("id", name) for t, name in ((want, "x"), (have, "y")))
    met = x.join(y, ["band", "bucket"]).groupBy("x", "y").agg(F.count("*").alias("bands")).where(F.col("bands") >= least)
    both = met.join(want.select(F.col("id").alias("x"), F.col("v").alias("va")), "x").join(have.select(F.col("id").alias("y"), F.col("v").alias("vb"), "least"), "y")
    scored = both.select("x", "y", "least", "bands", F.round(similarity.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))
    # so many classes, each with its least id, are before all others
    near = scored.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "least"))).where(F.col("place") <= k + 1)
    listed = near.select("x", F.col("y").alias("class"), "bands", "cosine").join(members.select("class", "b"), "class")
    best = listed.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "b"))).where(F.col("place") <= k + 1)
    found = asked.select("a", F.col("class").alias("x")).join(best.select("x", "b", "bands", "cosine"), "x").where("a <> b").select("a", "b", "bands", "cosine")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
