"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order (null last) get the weights 3, 1, 2, repeating; together the targets are
``budget`` (150 %) of all words; a target stops at ``most`` (2) times its source's words and the excess is shared again
by weight until none is above: a water level, found from running sums over the sources.

Quotas: the total is cut into blocks of ``block`` words, which go to the sources by highest quotients target / (2k + 1)
and, inside a source, by the same method to its shards in proportion to their words. A shard is a bounded group of a
source's documents by seeded hash. Instead of ranking every seat, the divisor is bracketed: rounding each share at the
two ends of the bracket leaves at most about two contested seats per party, and only these are ranked, so the result
equals the full highest-quotient procedure.

Selection: a shard's documents lie one after another in a seeded hash order, cut into blocks. A quota of q over b
blocks takes every block floor(q / b) times and a seeded cyclic run of q mod b blocks once more. A run keeps documents
whole except at its two ends. No block, so no document, is taken more than ``most`` times.

Scale: counting words is one narrow pass; sums are combined map-side over (source, hash bucket), so a source holding a
third of all rows is spread over many buckets and shards. Ranking tables have a row per source or shard. Documents are
placed by a window over (source, shard), each of about ``shard_words`` words.

Nulls and edges: a null text has size 0 and is taken 0 times; a null source is a source of its own; null ids and
repeated rows count as rows; an empty table gives none; other columns pass through ``plan`` unchanged. Reruns agree:
order and run starts depend on the seed and on row values only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from soilcast.llm.common import SPACE, WORD, cut_lineage, fresh, text_or_empty

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 19
BUCKETS = 1 << 16
SEED = 42


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
            most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so one small window each."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # byte order is code-point order
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                       (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources in the order in which a rising level per weight fills them up
    rise = Window.orderBy(F.col("cap") / F.col("w"), "i")
    whole = Window.partitionBy()
    s = (s.withColumn("full", F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)),
                                         F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("all", F.sum("source_size").over(whole) * F.lit(budget)))
    s = s.withColumn("level", (F.col("all") - F.col("full")) / F.col("open_w"))
    # the level is the first one at which the source itself is not yet full; if all are full there is none
    s = s.withColumn("at", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("full", "level")))
                     .over(whole))
    t = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at.level") * F.col("w")))
    return s.select("source", "source_size", t.alias("target"), F.col("i").alias("rank"))


def apportion(parties: DataFrame, share: str, seats: Column, group: list[str], tie: list[str],
              into: str) -> DataFrame:
    """``parties`` with an integer column ``into``: ``seats`` (an expression constant inside a group) dealt inside
    each group by Sainte-Lague on ``share``. Ties go by ``tie``."""
    p, n, total, m, low = fresh(parties, "party_", "seats_", "total_", "m_", "low_")
    g = Window.partitionBy(*group)
    order = [F.col(c) for c in tie]
    t = (parties.withColumn(n, seats.cast("long")).withColumn(total, F.sum(share).over(g))
         .withColumn(m, F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(g))
         .withColumn(p, F.row_number().over(g.orderBy(*order))))

    def rounded(extra: Column) -> Column:
        """Seats of a party if the divisor is total / (seats + extra)."""
        return F.greatest(F.lit(0), F.floor(F.col(share) * (F.col(n) + extra) / F.col(total) + 0.5)).cast("long")

    # half a seat per party on either side always brackets the divisor; one more seat covers rounding errors
    spare = F.col(m) / 2 + 1
    at_least = F.when(F.col(share) > 0, F.greatest(F.lit(0), rounded(-spare) - 1)).otherwise(0)
    t = t.withColumn(low, at_least.cast("long"))
    high = F.when(F.col(share) > 0, rounded(spare) + 1).otherwise(0)
    contested = t.withColumn("k_", F.explode(F.when(high > F.col(low), F.sequence(F.col(low), high - 1))))
    contested = contested.withColumn("r_", F.row_number().over(
        g.orderBy((F.col(share) / (2 * F.col("k_") + 1)).desc(), p)))
    given = t.groupBy(*group).agg(F.sum(low).alias("base_"))
    won = (contested.join(given.select(*[F.col(c).alias(f"g_{c}") for c in group], "base_"),
                          [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group])
           .where(F.col("r_") <= F.col(n) - F.col("base_"))
           .groupBy(*[F.col(c).alias(f"h_{c}") for c in group], F.col(p).alias("p_")).agg(F.count("*").alias("won_")))
    out = t.join(won, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in group] + [F.col(p) == F.col("p_")], "left")
    return out.select(*parties.columns,
                      (F.col(low) + F.coalesce("won_", F.lit(0))).cast("long").alias(into))


def quotas(sums: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, weights=WEIGHTS,
           budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Per (source, shard): source_size, target, shards (of the source), words, blocks (of the shard), quota, from
    (source, bucket, words)."""
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = cut_lineage(targets(sizes, weights, budget, most).withColumn("all_", F.lit(1)))
    total = F.round(F.sum("target").over(Window.partitionBy("all_")) / block)
    t = apportion(t.withColumn("n_", total), "target", F.col("n_"), ["all_"], ["rank"], "source_quota")
    t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    t = cut_lineage(t.select(F.col("source").alias("t_source"), "source_size", "target", "shards", "source_quota"))
    s = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "source", "source_size", "target", "shards", "source_quota", shard_of(F.col("bucket"), F.col("shards"))
        .alias("shard"), "words")
    s = s.groupBy("source", "source_size", "target", "shards", "source_quota", "shard").agg(
        F.sum("words").alias("words"))
    s = apportion(s, "words", F.col("source_quota"), ["source"], ["shard"], "quota")
    blocks = F.ceil(F.col("words") / block).cast("long")
    return s.select("source", "source_size", "target", "shards", "shard", "words", blocks.alias("blocks"),
                    F.least("quota", blocks * most).alias("quota"))


def shard_of(bucket: Column, shards: Column) -> Column:
    """Buckets lie side by side in shards."""
    return F.floor(bucket.cast("long") * shards / BUCKETS).cast("int")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, weights=WEIGHTS, budget: float = BUDGET,
         most: int = MOST, seed: int = SEED, into: str = "mix") -> DataFrame:
    """``docs`` with a struct ``into``: size, source_size, target, taken, repeats (times the whole document is taken),
    parts (up to two word ranges [from, to) taken once more)."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    z, src, h, b, sh, at = fresh(docs, "size_", "source_", "hash_", "bucket_", "shard_", "at_")
    # the hash is of the id, the source and the size: narrow, so the window below need not move any text
    d = docs.withColumn(z, size).withColumn(src, F.col(source_col))
    d = d.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, src, z))
    d = d.withColumn(b, F.pmod(F.col(h), F.lit(BUCKETS)).cast("int"))
    sums = d.groupBy(F.col(src).alias("source"), F.col(b).alias("bucket")).agg(F.sum(z).alias("words"))
    q = quotas(cut_lineage(sums), block, shard_words, weights, budget, most)
    q = cut_lineage(q).select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "source_size",
                              "target", "shards", "words", "blocks", "quota")
    per_source = q.select(F.col("q_source").alias("s_source"), F.col("shards").alias("s_shards")).dropDuplicates()
    d = d.join(per_source, F.col(src).eqNullSafe(F.col("s_source")))
    d = d.withColumn(sh, shard_of(F.col(b), F.col("s_shards")))
    order = Window.partitionBy(src, sh).orderBy(h, id_col, z)
    d = d.withColumn(at, F.sum(z).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(z))
    d = d.join(q, F.col(src).eqNullSafe(F.col("q_source")) & (F.col(sh) == F.col("q_shard")))
    # the cyclic run of blocks starts at a seeded block; in words it is one range, or two where it wraps
    repeats = F.floor(F.col("quota") / F.greatest("blocks", F.lit(1)))
    run = F.col("quota") - repeats * F.col("blocks")
    first = F.pmod(F.xxhash64(F.lit(seed + 1), "q_source", "q_shard"), F.greatest("blocks", F.lit(1)))
    last = first + run

    def part(lo: Column, hi: Column) -> Column:
        """The part of the document's words inside blocks [lo, hi)."""
        a = F.greatest(lo * block - F.col(at), F.lit(0))
        e = F.least(hi * block - F.col(at), F.col(z))
        return F.struct(F.least(a, F.col(z)).cast("long").alias("from"),
                        F.greatest(F.least(a, F.col(z)), e).cast("long").alias("to"))

    parts = F.array(part(F.lit(0), last - F.col("blocks")), part(first, F.least(last, F.col("blocks"))))
    parts = F.filter(parts, lambda x: x["to"] > x["from"])
    taken = repeats * F.col(z) + F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.col(z).alias("size"), F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"),
        repeats.cast("int").alias("repeats"), parts.alias("parts")).alias(into))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        n_chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a document taken k times gives k rows; a part of a document at
    the end of a run gives a row whose text is that part, white space inside it kept (``n_chars_col`` recounted)."""
    (m, r) = fresh(docs, "mix", "row_")
    d = plan(docs, id_col, text_col, source_col, into=m, **options)
    size = F.col(f"{m}.size")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("from"), size.alias("to")), F.col(f"{m}.repeats"))
    d = d.withColumn(r, F.explode(F.filter(F.concat(whole, F.col(f"{m}.parts")), lambda x: x["to"] > x["from"])))
    # words with the white space in front of them
    pieces = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.regexp_replace(F.array_join(F.slice(pieces, (F.col(f"{r}.from") + 1).cast("int"),
                                                (F.col(f"{r}.to") - F.col(f"{r}.from")).cast("int")), ""),
                           f"^{SPACE}", "")
    is_whole = (F.col(f"{r}.from") == 0) & (F.col(f"{r}.to") == size)
    text = F.when(is_whole, F.col(text_col)).otherwise(cut)
    d = d.withColumn(text_col, text)
    if n_chars_col in docs.columns:
        d = d.withColumn(n_chars_col, F.when(is_whole, F.col(n_chars_col)).otherwise(
            F.char_length(text_col)).cast(docs.schema[n_chars_col].dataType))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])
