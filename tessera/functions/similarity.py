"""Similarity measures as columns, on a scale of 0 to 100 unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of fused views, and their names. Fixed values.
FUSION = {"winnowing": 0.4, "ast": 0.25, "token": 0.2, "behavior": 0.15}
#: What shows a behaviour, whatever the case: names and patterns of each category. Fixed values.
API_CALLS = {
    "http_request": r"\b(requests|httpx|urllib|fetch|axios)\.\w+\(",
    "database": r"\b(sqlite|mysql|postgres|mongo|redis|sqlalchemy)\.\w+\(",
    "file_io": r"\bopen\s*\(|\bread\s*\(|\bwrite\s*\(|\.read\(|\.write\(",
    "network": r"\bsocket\s*\(|\.connect\s*\(|\.bind\s*\(",
    "logging": r"\blogger\.\w+\(|logging\.\w+\(",
    "testing": r"\bassert\s+|\bpytest|unittest|\.assertEqual",
    "serialization": r"\bjson\.\w+\(|\.dumps\(|\.loads\(|pickle\.\w+\(",
    "cli": r"\bargparse|click|sys\.argv",
}
EXCEPTIONS = [r"\btry\s*:", r"\bexcept\s+\w+", r"\bfinally\s*:", r"\braise\s+\w+", r"\bthrow\s+\w+"]
CONCURRENCY = [r"\bthreading\.\w+|Thread\s*\(", r"\basync\s+def|await\s+", r"\bmultiprocessing\.\w+|Process\s*\(", r"\bconcurrent\.\w+", r"\bmutex|Lock\s*\(|Semaphore"]
TRANSFORMS = [r"\bmap\s*\(|\.map\s*\(", r"\bfilter\s*\(|\.filter\s*\(", r"\breduce\s*\(", r"\bsorted\s*\(|\.sort\s*\(", r"\bsum\s*\(|max\s*\(|min\s*\(", r"\bgroupby\s*\("]
ALGORITHMS = {
    "sorting": r"\bsort|sorted|qsort|mergesort",
    "searching": r"\bbinary_search|bsearch|find|index",
    "graph": r"\bbfs|dfs|dijkstra|bellman|floyd",
    "dynamic_programming": r"\bmemoriz|dp\[|fibonacci",
    "hashing": r"\bhash|md5|sha256|digest",
    "encryption": r"\bencrypt|decrypt|cipher|aes|rsa",
}
SECURITY = [r"\bsanitiz|escape|encode|validate", r"\bauth|permission|token|jwt|csrf", r"\bpassword|secret|credential"]
#: A matched transform is named by so many of its first characters.
TRANSFORM_CHARACTERS = 20
#: Categories of which only the presence counts as structure.
STRUCTURE = ["exception_handling", "concurrency", "security"]


def jaccard(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """From set sizes; two empty sets are the same."""
    union = n_a + n_b - overlap
    return F.when(union == 0, 100.0).otherwise(overlap * 100.0 / union)


def jaccard_sets(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def node_jaccard(a: Column, b: Column) -> Column:
    """Of sets of nodes; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard_sets(a, b))


def sets_differ(a: Column, b: Column) -> Column:
    """Whether one of two arrays has an element that the other hasn't."""
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """-1 to 1; 0 if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size == 0, 0.0).otherwise(x.cast("double") / size))


def reuse_suggestion(similarity: Column) -> Column:
    return F.when(similarity >= 90, "direct_reuse").when(similarity >= 80, "reference_adapt").otherwise("need_refactor")


def fused(views: dict[str, Column], weights: dict[str, float] = FUSION) -> Column:
    """Weighted mean of the views that are there; their plain mean if their weights add up to 0."""
    there = [F.when(v.isNotNull(), weights.get(k, 0.0)).otherwise(0.0) for k, v in views.items()]
    total = reduce(lambda a, b: a + b, there)
    plain = [F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in views.values()]
    mean = lambda w: reduce(lambda a, b: a + b, [x * F.coalesce(v, F.lit(0.0)) for x, v in zip(w, views.values(), strict=True)]) / reduce(lambda a, b: a + b, w)
    return F.when(total > 0, mean(there)).when(reduce(lambda a, b: a + b, plain) > 0, mean(plain))


def grams(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of n tokens; none if they are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))))


def token_continuity(a: Column, b: Column, n: int = 5) -> Column:
    """Jaccard of runs of n tokens; if one text is shorter, 100 for equal texts with tokens, else 0."""
    short = (F.size(a) < n) | (F.size(b) < n)
    return F.when(short, F.when((a == b) & (F.size(a) > 0), 100.0).otherwise(0.0)).otherwise(jaccard_sets(grams(a, n), grams(b, n)))


def behaviour(text: Column) -> Column:
    """The signature of a text: the sorted, distinct `category:item` that its patterns show."""
    shows = lambda pattern: text.rlike(f"(?i){pattern}")
    one = lambda category, item, patterns: F.when(reduce(lambda a, b: a | b, map(shows, patterns)), F.lit(f"{category}:{item}"))
    items = [one("api_call", name, [p]) for name, p in API_CALLS.items()]
    items += [one("algorithm", name, [p]) for name, p in ALGORITHMS.items()]
    items += [one("exception_handling", "try_catch", EXCEPTIONS), one("concurrency", "concurrent", CONCURRENCY), one("security", "security_aware", SECURITY), one("io_operation", "file_io", [API_CALLS["file_io"]])]
    for p in TRANSFORMS:
        first = F.substring(F.regexp_extract(text, f"(?i){p}", 0), 1, TRANSFORM_CHARACTERS)
        items.append(F.when(first != "", F.concat(F.lit("data_transform:"), first)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*items))))


def behaviour_similarity(a: Column, b: Column) -> Column:
    """0 to 1: 0.6 of the items' overlap and 0.4 of the agreement on STRUCTURE; 1 if neither shows anything, 0 if one does not."""
    has = lambda s, c: F.exists(s, lambda x: x.startswith(f"{c}:"))
    same = reduce(lambda x, y: x + y, [F.when(has(a, c) == has(b, c), 1.0).otherwise(0.0) for c in STRUCTURE]) / len(STRUCTURE)
    both = 0.6 * jaccard_sets(a, b) / 100 + 0.4 * same
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def multiset_jaccard(minima: Column, maxima: Column) -> Column:
    """From the sums of the lesser and of the larger counts."""
    return F.when(maxima == 0, 100.0).otherwise(minima * 100.0 / maxima)


def node_multiset(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays, each row by itself."""
    every = F.array_distinct(F.concat(a, b))
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    total = lambda f: F.aggregate(F.transform(every, f), F.lit(0), lambda s, x: s + x)
    return multiset_jaccard(total(lambda x: F.least(count(a, x), count(b, x))), total(lambda x: F.greatest(count(a, x), count(b, x))))


def ir_similarity(types: Column, depth: Column, count: Column, other_types: Column, other_depth: Column, other_count: Column) -> Column:
    """0 to 1: types' overlap, depth and number of nodes."""
    deep = 0.25 / (1 + 0.2 * F.abs(depth - other_depth))
    many = 0.25 * (1 - 0.3 * F.abs(count - other_count) / F.greatest(count, other_count, F.lit(1)))
    return 0.5 * jaccard_sets(types, other_types) / 100 + deep + many


def view_similarity(types: Column, depth: Column, count: Column, other_types: Column, other_depth: Column, other_count: Column) -> Column:
    """0 to 1, of one view: as of trees; 1 if neither has types, 0 if one has none."""
    both = ir_similarity(types, depth, count, other_types, other_depth, other_count)
    return F.when((F.size(types) == 0) & (F.size(other_types) == 0), 1.0).when((F.size(types) == 0) | (F.size(other_types) == 0), 0.0).otherwise(both)


def confidence(n: Column, ratio: Column, mean: Column) -> Column:
    """Of a source: how many modules match, what share of all, how similar they are. At most 100."""
    return F.least(F.lit(100.0), 0.4 * ratio * 100 + 0.4 * mean + 0.2 * F.least(F.lit(100.0), 20 * F.log1p(n)))
