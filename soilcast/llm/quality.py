"""Quality rules as weak supervision (DataFrame expressions only).

Every rule votes good (1), bad (-1) or abstains (0) on a document. Votes are aggregated to counts per vote pattern;
expectation-maximisation on those counts estimates how often each rule votes each way among good and among bad
documents, and the posterior probability of ``good`` replaces all-must-pass filtering.

Scale: features and votes are one pass over the text without a shuffle. The pattern table has at most 3^rules rows
whatever the input (checked), and is made by a map-side combined count over all documents; EM runs on these counts on
the driver, a fixed number of steps. Scoring is one more narrow pass: a sum of literal log-odds.

Nulls and edges: a null text counts as empty (no words: base_failed, not kept). Word, symbol and line counts use the
whole text. A repeated 8-word window is found by the 64-bit hash of its words' hashes. Repeated rows each get their
own verdict; an empty table gives an empty result. Other columns are ignored by ``judge`` and returned by ``accept``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from soilcast.llm.common import WORD, cut_lineage, fresh, let, run_folder, text_or_empty, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
EM_STEPS = 30
PRIOR_GOOD = 0.8
THRESHOLD = 0.5
START_GOOD, START_BAD = 1.2, 8.0
# Beta priors (mean, weight) of a rule's error rates, which keep EM near what the rules are written for and leave the
# estimates to the data: a rule misfires on some good documents, so one bad vote against good votes of the others is no
# verdict. The prior of false alarms weighs a tenth of the documents a rule votes on, as a rule that never misfired
# in one corpus may in a script or format it has not met; that of passed bad documents weighs a few documents.
FALSE_ALARM, ALARM_WEIGHT = 0.05, 0.1
PASSES_BAD, PASSES_WEIGHT = 0.6, 20.0
# The estimated share of good documents stays this far from 0 and 1.
SHARE_FLOOR = 0.01


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a ``window``-word window found twice or more, the first one included, from the
    words' hashes."""
    def joined(h: Column, step: int) -> Column:
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(1 + step), F.size(h) - step),
                          lambda x, y: F.xxhash64(x, y))

    # hashes of 2, 4, 8 ... words: each pass joins neighbours of the one before
    grams, step = hashes, 1
    while step < window:
        grams = let(grams, (lambda s: lambda h: joined(h, s))(step))
        step *= 2
    if step != window:
        raise ValueError("window must be a power of two")

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))),
            lambda x: x["i"])))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))),
            F.lit(0), lambda a, x: a + x))

    return F.when(F.size(hashes) < window, F.lit(0)).otherwise(
        let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))


def features(docs: DataFrame, text_col: str = "text", into: str = "f") -> DataFrame:
    """``docs`` with a struct column ``into`` of text counts."""
    text = text_or_empty(text_col)
    w, h, lines, rest, chars_in = fresh(docs, "words_", "hashes_", "lines_", "rest_", "chars_")
    t = docs.withColumn(w, words(text))
    t = t.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    t = t.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))))
    # what is neither lower-case letter nor white space is a few percent of a text: other counts are made on it
    t = t.withColumn(rest, F.regexp_replace(text, r"[a-z\x20\x09-\x0D\p{Ll}]+", ""))
    t = t.withColumn(chars_in, F.char_length(F.array_join(w, "")))

    def count(chars: str) -> Column:
        return (F.char_length(rest) - F.char_length(F.translate(F.col(rest), chars, ""))).cast("long")

    upper = F.regexp_count(rest, F.lit(r"\p{Lu}"))
    # a combining mark is part of its letter: scripts such as Devanagari write vowels with them
    others = F.regexp_count(rest, F.lit(r"[^\p{L}\p{M}]"))
    signed = F.regexp_count(text, F.lit(f"[{SYMBOLS}]+"))
    # a word that is its left neighbour again
    again = F.size(F.filter(F.col(h), lambda x, i: F.coalesce(F.get(F.col(h), i - 1) == x, F.lit(False))))
    return t.withColumn(into, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.col(chars_in).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(h)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.col(chars_in) - others).cast("long").alias("n_letters"),
        upper.cast("long").alias("n_upper"),
        F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
        count(".!?").alias("n_stops"),
        count("!").alias("n_bangs"),
        signed.cast("long").alias("n_signed"),
        again.cast("long").alias("n_again"),
    )).drop(w, h, lines, rest, chars_in)


def votes(f: str = "f") -> dict[str, Column]:
    """The rules: each gives 1 (good), -1 (bad) or 0 (abstains) from the counts. Ratios of an empty text abstain."""
    c = {n: F.col(f"{f}.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "n_lines", "n_letters", "n_upper", "n_distinct", "n_stops", "n_bangs",
                                        "n_signed", "n_again")}

    def rule(part: Column, whole: Column, good: Column | float, bad: Column | float, least: int = 1) -> Column:
        """good if part/whole is below ``good``, bad if above ``bad``; abstains between, and if whole < least."""
        return F.when(whole < least, 0).when(part > whole * bad, -1).when(part < whole * good, 1).otherwise(0)

    return {
        "symbols": rule(c["n_symbols"], c["word_chars"], 0.01, 0.05),
        "repeats": rule(c["n_repeat_words"], c["n_words"], 0.15, 0.3, WINDOW),
        "capitals": rule(c["n_upper"], c["n_letters"], 0.3, 0.5, 10),
        "variety": -rule(c["n_distinct"], c["n_words"], 0.3, 0.45, 50),
        "bangs": rule(c["n_bangs"], c["n_words"], 0.1, 0.3),
        "stops": rule(c["n_stops"], c["n_words"], 0.4, 0.8, 5),
        "letters": -rule(c["n_letters"], c["word_chars"], 0.7, 0.9, 20),
        "lines": rule(c["n_dup_lines"], c["n_lines"], 0.3, 0.6, 4),
        "signed": rule(c["n_signed"], c["n_words"], 0.2, 0.4),
        "again": rule(c["n_again"], c["n_words"], 0.1, 0.3, WINDOW),
    }


def base_failed(f: str = "f") -> Column:
    n, rep = F.col(f"{f}.n_words"), F.col(f"{f}.n_repeat_words")
    return (n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT_PERCENT)


def pattern_counts(voted: DataFrame, v: str) -> list[tuple[tuple[int, ...], int]]:
    """(votes, documents) per vote pattern, over all documents: at most 3^rules rows, whatever the input."""
    rows = voted.groupBy(v).agg(F.count("*").alias("n")).collect()
    got = sorted((tuple(r[0]), r["n"]) for r in rows)
    if got and len(got) > 3 ** len(got[0][0]):
        raise ValueError("more vote patterns than the rules allow")
    return got


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = EM_STEPS, prior: float = PRIOR_GOOD,
        floor: float = SHARE_FLOOR) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation of a two-class model with independent rules on vote pattern counts.

    Returns the share of good documents, and per rule {vote: (P(vote | good), P(vote | bad))}. It starts from what
    the rules are written for: most text passes each of them, so a good vote is weak evidence (odds START_GOOD) and a
    bad vote stronger evidence (odds START_BAD), of which two are needed."""
    total = sum(n for _, n in patterns)
    if not total:
        return prior, []
    k = len(patterns[0][0])

    def start(p):
        odds = prior / (1 - prior) * START_GOOD ** sum(x > 0 for x in p) / START_BAD ** sum(x < 0 for x in p)
        return odds / (1 + odds)

    post = [start(p) for p, _ in patterns]
    good, rates = prior, []
    for _ in range(steps):
        good = min(1 - floor, max(floor, sum(n * q for (_, n), q in zip(patterns, post)) / total))
        rates = []
        for j in range(k):
            # an abstention is no evidence: rates are those of the documents on which the rule votes
            said = [(p[j], n * q, n * (1 - q)) for (p, n), q in zip(patterns, post) if p[j]]
            g, b = sum(x for _, x, _ in said), sum(x for _, _, x in said)
            table = {0: (1.0, 1.0)}
            # a pseudo-document more keeps rates off zero where no rule voted
            w = ALARM_WEIGHT * g + 1
            alarm = (sum(x for v, x, _ in said if v < 0) + w * FALSE_ALARM) / (g + w)
            passes = (sum(x for v, _, x in said if v > 0) + PASSES_WEIGHT * PASSES_BAD) / (b + PASSES_WEIGHT)
            table[-1], table[1] = (alarm, 1 - passes), (1 - alarm, passes)
            rates.append(table)
        post = [posterior(p, good, rates) for p, _ in patterns]
    return good, rates


def posterior(p: tuple[int, ...], good: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    z = math.log(good / (1 - good)) + sum(math.log(r[v][0] / r[v][1]) for r, v in zip(rates, p))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def posterior_column(v: Column, model: tuple[float, list[dict[int, tuple[float, float]]]]) -> Column:
    """Posterior probability of ``good`` from a vote array: a sum of literal log-odds through the logistic curve."""
    good, rates = model
    z = F.lit(math.log(good / (1 - good)))
    for j, r in enumerate(rates):
        x = F.get(v, F.lit(j))
        z = z + F.when(x == -1, math.log(r[-1][0] / r[-1][1])).when(x == 1, math.log(r[1][0] / r[1][1])).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def vote_array(f: str = "f") -> Column:
    return F.array(*[x.cast("tinyint") for x in votes(f).values()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, quality (posterior), kept."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    voted = cut_lineage(features(narrow).select("doc_id", "f", vote_array().alias("v")))
    model = fit(pattern_counts(voted, "v"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    q = F.round(posterior_column(F.col("v"), model), 6)
    return voted.select("doc_id", *[f"f.{c}" for c in counts], base_failed().alias("base_failed"),
                        q.alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def accept(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base checks and whose posterior reaches the threshold. The
    texts are written once with their votes to the shared folder, so their features are made once and no text is
    shuffled."""
    spark = docs.sparkSession
    f, v, failed = fresh(docs, "features_", "votes_", "base_failed_")
    voted = features(docs, text_col, f).withColumn(v, vote_array(f)).withColumn(failed, base_failed(f)).drop(f)
    folder = run_folder(spark, "quality")
    voted.write.parquet(folder)
    voted = spark.read.schema(voted.schema).parquet(folder)
    model = fit(pattern_counts(voted, v))
    ok = ~F.col(failed) & (F.round(posterior_column(F.col(v), model), 6) >= threshold)
    return voted.where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
