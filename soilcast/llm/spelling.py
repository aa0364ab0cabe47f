"""Spelling variant grouping: words at one edit, found by a relational trie frontier.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with only A-Z lower-cased. If 31 divides the unsigned crc32 of
``<doc_id>:<run>``, the run loses the code point at crc32 mod its length. A word counts if it has ``LEAST_LENGTH`` code
points and ``LEAST_COUNT`` occurrences; two words are near if one inserted, deleted or replaced code point makes them
equal. A word's form is its near word with the largest count (ties: smallest in code-point order), if that is at least
``FACTOR`` times the word's own; its root is the end of the chain of forms.

The trie is a table of edges (node, code point, child). Nodes are numbered by a 64-bit rolling hash of their prefix; an
edge with code point 0 leads from a whole word's node to that word. Only nodes that several words pass are kept: below any
other there is no neighbour. An edge with one word below it holds the rest of that word, and a state that takes it is
compared at once; an edge with more holds one bit of 64 for each rest below it, and a state whose rest has no bit there
ends. A state is (word, node, rest): the prefix spelled so far, with at most one edit, and the part of the word still to be
read. States without an edit need no join: they are the word's own prefixes. From each of them one edit is spent: the next
code point is dropped, or replaced by a larger one along another edge of the node (inserted and smaller code points are the
same pairs seen from the other word). Then what lives is joined with the edge table level by level, one code point a level.
After ``LEVELS`` levels what still lives is finished by looking up its whole spelling, so that one long word does not ask
for as many joins as it has letters.

An edit in the first half of a word would start near the root, where nodes have many edges. So there are two tries, of
the words and of the reversed words, and each spends its edit in the second half only; the prefix before it is then at
least half a word long. Pairs found twice are merged, and every pair is checked by its edit distance, so two prefixes
with one hash could cost time, never a wrong or a lost pair.

Scale: counts are combined map-side; paths, edges and states are dealt by node; no group of words is ever paired with
itself, and a state is written only if its rest may be below the edge it takes. A word spends at most (length + 1) / 2 edits a trie times the edges of a node, so the work grows with the
words, not with their pairs.

Nulls and edges: a null text has no words; a null doc_id is written as the empty string before the colon; repeated rows
count again; a table without words gives no rows; other columns are ignored; words and texts may have any length (the states
of a word of n letters hold about n * n / 4 code points, written out as they are made).
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from soilcast.llm.common import ship, written

ship(__name__)

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
DROP = 31
LEVELS = 24
_HELD = 400_000               # distinct words a task holds before it hands its counts on
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROOTS = (np.uint64(0x51ED270B35A94D6F), np.uint64(0xA3C59AC2F0D3B1E9))
_LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                drop: int = DROP) -> DataFrame:
    """(word, n) over (doc_id, text)."""
    pattern = f"(?<![{_LETTERS}])[{_LETTERS}]{{{max(1, least_length)},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(pattern).findall       # a run that is too short stays so
        total: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())],
                                             names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(runs(text)).items():
                    w = w.lower() if w.isascii() else w.translate(_LOWER)
                    h = zlib.crc32(w.encode(), start)
                    if not h % drop:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < least_length:
                            continue
                    total[w] += n
                if len(total) > _HELD:
                    yield rows()
        yield rows()

    counted = docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _prefix_hashes(words: list[str], root: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, hashes, lengths): flat code points of all words, and flat hashes of each word's prefixes, the
    empty one and the whole word included."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(length) - length
    place = first + np.arange(len(words))        # of a word's first hash
    out = np.empty(len(points) + len(words), np.uint64)
    out[place] = root
    order = np.argsort(-length, kind="stable")   # at depth p the words longer than p are a prefix of this order
    longer = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), "right")
    for p, k in enumerate(longer.tolist()):
        o = order[:k]
        x = (out[place[o] + p] ^ (points[first[o] + p] + np.uint64(1))) * _BASE
        out[place[o] + p + 1] = x ^ (x >> np.uint64(29))
    return points, out, length


def _words_both_ways(words: list[str]) -> Iterator[tuple[list[str], bool]]:
    yield words, False
    yield [w[::-1] for w in words], True


_SPELLED = "id bigint, back boolean, cut int, node bigint, point int, child bigint, rest string"


def _cuts(words: list[str], back: bool) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (word, from, to): the cuts of second halves, the end included; a group's rests have about a million
    code points, and a long word is dealt over several groups."""
    group, held = [], 0
    for i, w in enumerate(words):
        n = len(w)
        low, step = n - n // 2 if back else n // 2, max(1, (1 << 20) // n)
        for at in range(low, n + 1, step):
            to = min(n + 1, at + step)
            group.append((i, at, to))
            held += (to - at) * (n + 50)
            if held > 1 << 22:
                yield group
                group, held = [], 0
    if group:
        yield group


def spelled_halves(words: DataFrame) -> DataFrame:
    """Both tries' paths of (id, word) from the first node where a word may spend its edit: per cut the prefix's node, the
    next code point, the node it leads to and what follows it. At the end of a word point 0 leads to its id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = part.column("id").to_numpy()
                for spelled, back in _words_both_ways(part.column("word").to_pylist()):
                    points, hashes, length = _prefix_hashes(spelled, _ROOTS[back])
                    hashes, first = hashes.view(np.int64), np.cumsum(length) - length
                    for group in _cuts(spelled, back):
                        g = np.array(group, np.int64)
                        count = g[:, 2] - g[:, 1]
                        word = np.repeat(g[:, 0], count)
                        cut = np.arange(len(word)) + np.repeat(g[:, 1] - np.cumsum(count) + count, count)
                        end = cut == length[word]
                        place = first[word] + cut
                        point = np.where(end, 0, points[np.minimum(place, len(points) - 1)]).astype(np.int32)
                        child = np.where(end, ids[word], hashes[np.minimum(place + word + 1, len(hashes) - 1)])
                        rest = [spelled[i][k:] for i, low, to in group for k in range(low + 1, to + 1)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[word]), pa.array(np.full(len(word), back)), pa.array(cut.astype(np.int32)),
                             pa.array(hashes[place + word]), pa.array(point), pa.array(child), pa.array(rest, pa.string())],
                            names=["id", "back", "cut", "node", "point", "child", "rest"])

    return words.select("id", "word").mapInArrow(run, _SPELLED)


def _bit(rest: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(rest).bitwiseAND(F.lit(63)).cast("int"))


def edge_table(shared: DataFrame) -> DataFrame:
    """(node, point, child, words, tail, leaf, below) of the paths ``shared``: ``words`` paths go through the edge; if it
    is one, ``tail`` is what it spells after the edge and ``leaf`` its word. ``below`` has a bit set for what each spells."""
    return shared.groupBy("node", "point", "child").agg(
        F.count(F.lit(1)).alias("words"), F.min("rest").alias("tail"), F.min("id").alias("leaf"),
        F.bit_or(_bit(F.col("rest"))).alias("below"))


def _leads_on(left: Column) -> Column:
    """Whether ``left`` may be spelled below the edge: surely if one word is below it, else by its bit."""
    return F.when(F.col("words") == 1, left == F.col("tail")).otherwise(
        F.col("below").bitwiseAND(_bit(left)) != 0)


def _next(rest: Column) -> Column:
    return F.when(rest == "", 0).otherwise(F.ascii(rest))


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(a, b): ids of all pairs of near words of (id, word), each pair once, in one of its two orders."""
    # a node on one word's path only has no neighbour below it
    shared = written(spelled_halves(words).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("node")))
                     .where("_n > 1").drop("_n"), "spelling-paths")
    edges = written(edge_table(shared), "spelling-edges")
    # a state is about to read ``point`` of its own word; it leaves along another edge, with the point dropped or replaced
    # by a larger one (of a run of equal code points the last is dropped)
    state = shared.where("point > 0").select("id", "back", "cut", "node", F.col("point").alias("own"), "rest")
    shorter = F.expr("substring(rest, 2)")
    replaced = (F.col("point") > F.col("own")) & _leads_on(F.col("rest"))
    dropped = (F.col("point") == _next(F.col("rest"))) & (F.col("point") != F.col("own")) & _leads_on(shorter)
    e = edges.withColumnRenamed("node", "_node")
    moved = state.join(e, (F.col("node") == F.col("_node")) & (replaced | dropped))
    ways = F.filter(F.array(F.struct(replaced.alias("ok"), F.col("point").alias("swap"), F.col("rest").alias("rest")),
                            F.struct(dropped.alias("ok"), F.lit(None).cast("int").alias("swap"), shorter.alias("rest"))),
                    lambda w: w["ok"])
    moved = moved.select("id", "back", "cut", "child", "words", "leaf", F.explode(ways).alias("w")) \
        .select("id", "back", "cut", F.col("w.swap").alias("swap"), F.col("w.rest").alias("rest"), "child", "words", "leaf")
    found = live = None
    for level in range(levels + 1):
        if level:      # one code point a level
            ahead = live.withColumn("own", _next(F.col("rest")))
            moved = ahead.join(e, (F.col("node") == F.col("_node")) & (F.col("own") == F.col("point")) & _leads_on(shorter)) \
                .select("id", "back", "cut", "swap", shorter.alias("rest"), "child", "words", "leaf")
        moved = written(moved, f"spelling-level-{level}")
        done = moved.where("words = 1").select(F.col("id").alias("a"), F.col("leaf").alias("b"))
        found = done if found is None else found.unionByName(done)
        live = moved.where("words > 1").select("id", "back", "cut", "swap", "rest", F.col("child").alias("node"))
        if live.isEmpty():
            live = None
            break
    if live is not None:
        w = words.select("id", "word")
        spelled = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
        n = F.length("word")
        target = live.join(w, "id").select("id", F.concat(
            spelled.substr(F.lit(1), F.col("cut")), F.coalesce(F.char(F.col("swap")), F.lit("")),
            spelled.substr(F.col("cut") + 2, n)).alias("t"), "back")
        target = target.select("id", F.when(F.col("back"), F.reverse("t")).otherwise(F.col("t")).alias("word"))
        found = found.unionByName(target.withColumnRenamed("id", "a").join(
            w.withColumnRenamed("id", "b"), "word").select("a", "b"))
    pairs = found.distinct()
    left = words.select(F.col("id").alias("a"), F.col("word").alias("_a"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("_b"))
    return pairs.join(left, "a").join(right, "b").where(F.levenshtein("_a", "_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of every chain. A form's count is a multiple of its word's, so chains are
    short and have no cycle; each round follows all chains twice as far."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(at.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR,
             least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int = DROP,
             levels: int = LEVELS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    counted = written(word_counts(d, least_length, least_count, drop), "spelling-counts")
    words = written(counted.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    pairs = written(near_pairs(words, levels), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = both.join(words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("n"), "word").alias("w")), "b") \
        .groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("w").alias("best"))
    j = words.join(near, "id", "left")
    top = -F.col("best.n")
    ok = top >= F.lit(factor) * F.col("n")
    j = written(j.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(ok, F.col("best.word")).alias("form"), F.when(ok, top).alias("form_n")),
                "spelling-forms")
    r = roots(j.where("form is not null"))
    return j.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                            "form_n")
