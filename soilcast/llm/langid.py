"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of ``slots`` words; bit l of a slot belongs to language l. An n-gram's ``hashes`` slots joined by AND give
the set of all languages whose filter holds it, in one look-up. A text's n-grams are counted per language (a
popcount of each bit slice), the expected false positives of each language's filter (its fill to the power
``hashes``) are taken off, and the language with the most corrected hits is predicted; score is its share of all
languages' corrected hits.

Training: ``sample_docs`` documents per language (the documented bound, chosen by seeded hash) from the rows whose
crc32(doc_id) modulo 4 is not 2; document counts per (language, n-gram) are combined map-side. A language's filter
takes its ``grams`` most frequent n-grams among those that occur in at least ``least_docs`` of its documents (in all of them, if it has fewer) and whose
document rate is at least ``least_share`` of the highest rate among languages, so that foreign passages do not enter.
The model is bounded by slots x ceil(languages / 64) words, 8 MB up to 64 languages; languages are checked against
``MAX_LANGUAGES``. Prediction is a narrow pass over whole texts, in slices of bounded memory.

Nulls and edges: null text, or text without a letter: ``und``, score 0. A text with letters but no hit gets the
language with most training documents, score 0. Rows with a null id are predicted but never trained on (held_out is
false). With nothing to learn from, all rows are ``und``. Repeated rows are predicted alike, and trained on once.
lang, source and doc_id are no inputs of a prediction; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from soilcast.llm.common import ship, written

ship(__name__)

SIZES = (3, 4, 5)
SAMPLE_DOCS = 3000
GRAMS = 30_000
LEAST_DOCS = 3
LEAST_SHARE = 0.25
SLOTS = 1 << 20
HASHES = 2
SEED = 42
MAX_LANGUAGES = 4096
UNKNOWN = "und"
_SLICE = 1 << 20
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str) -> str:
    """Lower-case letters (with their marks), words one space apart, a space at both ends."""
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams that start at each position."""
    if len(cp) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(cp) - n + 1, np.uint64(n))
    for j in range(n):
        h = (h ^ cp[j:len(cp) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def slots_of(h: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(hashes)]


@dataclass
class Model:
    languages: list[str]
    default: int
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray
    sizes: tuple[int, ...]
    hashes: int

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """(n-grams found per language, n-grams) of a normalised text, slice by slice."""
        found, total = np.zeros(len(self.languages), np.int64), 0
        for at in range(0, max(1, len(text) - 1), _SLICE):
            cp = points(text[at:at + _SLICE + max(self.sizes) - 1])
            for n in self.sizes:
                h = gram_hashes(cp, n)[:_SLICE]
                total += len(h)
                found += self._count(h)[0]
        return found, total

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        first, *rest = slots_of(h, len(self.table), self.hashes)
        masks = self.table[first]
        for s in rest:
            masks = masks & self.table[s]
        return masks

    def _count(self, h: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        """Hits per language in each of the runs of ``h`` that start at ``cuts`` (none of them empty)."""
        masks = self._lookup(h)
        cuts = np.zeros(1, np.int64) if cuts is None else cuts
        out = np.zeros((len(cuts), len(self.languages)), np.int64)
        if len(h):
            for l in range(len(self.languages)):
                bit = ((masks[:, l >> 6] >> np.uint64(l & 63)) & np.uint64(1)).astype(np.int32)
                out[:, l] = np.add.reduceat(bit, cuts)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        where, joined, size = [], [], 0

        def flush():
            if where:
                for i, found, total in zip(where, *self._many(joined)):
                    out[i] = self._decide(found, total)
                where.clear(), joined.clear()

        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                continue
            s = normalise(t)
            if len(s) > _SLICE:
                out[i] = self._decide(*self.hits(s))
                continue
            if size + len(s) > _SLICE:
                flush()
                size = 0
            where.append(i), joined.append(s)
            size += len(s)
        flush()
        return out

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """hits of many texts at once. Each has three or more characters, so at least one n-gram of 3; n-grams that
        run over the end of a text are cleared."""
        cp, lengths = points("".join(texts)), np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        total = np.zeros(len(texts), np.int64)
        for n in self.sizes:
            h = gram_hashes(cp, n)
            own = np.maximum(lengths - n + 1, 0)
            some = own > 0
            at = np.repeat(starts[some], own[some]) + _ranges(own[some])
            cuts = np.concatenate([[0], np.cumsum(own[some])[:-1]]).astype(np.int64)
            if len(at):
                found[some] += self._count(h[at], cuts)
            total += own
        return found, total

    def _decide(self, found: np.ndarray, total: int) -> tuple[str, float]:
        right = np.maximum((found - total * self.false_rate) / (1 - self.false_rate), 0)
        if right.sum() <= 0:
            return self.languages[self.default], 0.0
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum())


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> DataFrame:
    """(doc_id, lang, text) of at most ``sample_docs`` documents a language."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    d = d.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")
    picked = (d.select("lang", "doc_id").dropDuplicates().withColumn("r", F.row_number().over(order))
              .where(F.col("r") <= sample_docs).select("lang", "doc_id"))
    # at most sample_docs ids per language: small by its bound
    return d.join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").dropDuplicates(["lang", "doc_id"])


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sizes: tuple[int, ...] = SIZES, sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS,
          least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, slots: int = SLOTS,
          hashes: int = HASHES) -> Model:
    sample = written(training_rows(docs, id_col, text_col, lang_col, sample_docs), "langid-sample")
    sizes_of = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes_of)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is bounded to {MAX_LANGUAGES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                s = normalise(text)
                own = [np.empty(0, np.uint64)]
                for at in range(0, len(s), _SLICE):
                    cp = points(s[at:at + _SLICE + max(sizes) - 1])
                    own += [np.unique(gram_hashes(cp, n)[:_SLICE]) for n in sizes]
                h = np.unique(np.concatenate(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h)],
                                                 names=["lang", "h"])

    per = sample.select("lang", "text").mapInArrow(count, "lang string, h bigint").groupBy("lang", "h").agg(
        F.count("*").alias("docs"))
    n_of = F.create_map(*[x for k, v in sizes_of.items() for x in (F.lit(k), F.lit(float(v)))]) if sizes_of else None
    masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    fill = np.zeros(len(languages), np.int64)
    if languages:
        per = per.where(F.col("docs") >= F.least(F.lit(float(least_docs)), n_of[F.col("lang")]))
        per = per.withColumn("rate", F.col("docs") / n_of[F.col("lang")])
        per = per.withColumn("top", F.max("rate").over(Window.partitionBy("h"))).where(
            F.col("rate") >= F.col("top") * least_share)
        order = Window.partitionBy("lang").orderBy(F.col("docs").desc(), "h")
        chosen = per.withColumn("r", F.row_number().over(order)).where(F.col("r") <= grams).select("lang", "h")
        number = {l: i for i, l in enumerate(languages)}
        got = chosen.toArrow()  # at most ``grams`` rows a language
        lang = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
        h = got.column("h").to_numpy().view(np.uint64)
        for s in slots_of(h, slots, hashes):
            np.bitwise_or.at(masks, (s, lang >> 6), np.uint64(1) << (lang & 63).astype(np.uint64))
        fill = np.array([int(((masks[:, l >> 6] >> np.uint64(l & 63)) & np.uint64(1)).sum())
                         for l in range(len(languages))])
    default = max(range(len(languages)), key=lambda l: sizes_of[languages[l]], default=0)
    return Model(languages, default, masks, (fill / slots) ** hashes, sizes, hashes)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, id_col, text_col, lang_col, **options)
    # plain values: a broadcast is pickled by reference, which needs no class of this module
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                      F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            got = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()),
                 pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
