import random
import re

import pytest
from pyspark.sql import functions as F

from soilcast.llm import quality as Q

from .helpers import SF, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(2)
    out = [None, "", " \x0b\x1c ", "a b c d e f g h " * 4, "a " * 9, "x y\nx y\n \n\nx y \n", "#*$ %&|<> ä😀 é"]
    for _ in range(40):
        block = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 40))]
        out.append((rng.choice([" ", "\n", "  \t"])).join(block + block[:rng.randint(0, 20)]))
    return out


def test_base_counts_equal_plain_form(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:7]) for r in Q.judge(df).collect()}
    assert got == {i: slow_base(t) for i, t in rows}


def test_posterior_column_equals_plain_posterior(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    voted = Q.features(df).select("doc_id", Q.vote_array().alias("v"))
    patterns = Q.pattern_counts(voted, "v")
    assert sum(n for _, n in patterns) == df.count() and len(patterns) <= 3 ** len(Q.votes())
    model = Q.fit(patterns)
    for v, p in voted.select("v", Q.posterior_column(F.col("v"), model)).collect():
        assert p == pytest.approx(Q.posterior(tuple(v), *model), abs=1e-9)


def test_em_finds_accuracies_of_simulated_rules():
    rng = random.Random(4)
    counts = {}
    for _ in range(20000):
        good = rng.random() < 0.85
        p = tuple(0 if rng.random() < 0.2 else (-1 if rng.random() < (0.001 if good else r) else 1)
                  for r in (0.45, 0.4, 0.5, 0.35, 0.3))
        counts[p] = counts.get(p, 0) + 1
    good, rates = Q.fit(sorted(counts.items()))
    assert good == pytest.approx(0.85, abs=0.05)
    assert rates[2][-1][1] == pytest.approx(0.5, abs=0.1)


def test_agreement_with_labels(spark):
    """The labels are never read by the operator."""
    sf = SF.replace("0.001", "0.01")
    got = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(
        spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    rows = got.select("label", "kept", "base_failed").collect()
    clean = [r for r in rows if r.label == 1 and not r.base_failed]
    junk = [r for r in rows if r.label == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)


HINDI = ("किसान ने खेत में मिट्टी की नमी मापी और पानी देने का समय चुना। सुबह की ठंडी हवा में पौधे धीरे धीरे बढ़ते हैं, "
         "इसलिए सिंचाई बहुत जल्दी नहीं करनी चाहिए। पिछले साल बारिश कम हुई थी, फिर भी फसल अच्छी रही। "
         "गाँव के लोगों ने मिलकर नया कुआँ खोदा, जिससे तीन सौ परिवारों को लाभ मिला। अब हर सप्ताह आँकड़े लिखे जाते हैं।")
CODE = "\n".join(["def mean_moisture(rows, n0=10):", "    total, k = 0.0, 0", "    for r in rows[:n0]:",
                  "        if r['v'] >= 0.25:", "            total += r['v']; k += 1",
                  "    return total / max(k, 1)", "", "def week_of(t0, t1):", "    days = (t1 - t0) / 86400.0",
                  "    return int(days // 7) + 1", "", "print(mean_moisture([{'v': 0.31}, {'v': 0.27}]))"])
TABLE = "\n".join(["| Sensor place in the field | What was seen this week |", "| North gate beside the barn | Dry soil since Monday morning |",
                   "| South slope below the trees | Wet after the long rain |", "| Old well near the road | Pump repaired by two neighbours |",
                   "| Lower meadow along the river | Frost on several early mornings |",
                   "| Greenhouse behind the school | Seedlings grow without any trouble |"])


def test_one_bad_vote_does_not_reject_clean_documents(spark):
    corpus = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    names = list(Q.votes())
    extra = spark.createDataFrame([(-1, HINDI), (-2, CODE), (-3, TABLE)], "doc_id long, text string")
    docs = corpus.unionByName(extra)
    voted = Q.features(docs).select("doc_id", Q.vote_array().alias("v"))
    model = Q.fit(Q.pattern_counts(voted, "v"))
    for j, name in enumerate(names):
        one = tuple(-1 if i == j else 1 for i in range(len(names)))
        assert Q.posterior(one, *model) >= 0.5, name
        two = tuple(-1 if i in (j, (j + 1) % len(names)) else 1 for i in range(len(names)))
        assert Q.posterior(two, *model) < 0.5, name
    got = {r.doc_id: dict(zip(names, r.v)) for r in voted.where("doc_id < 0").collect()}
    assert got[-1]["letters"] == 1  # marks are parts of letters
    assert [k for k, v in got[-2].items() if v < 0] == ["letters"]
    assert [k for k, v in got[-3].items() if v < 0] == ["symbols"]
    kept = {r.doc_id for r in Q.judge(docs).where("kept and doc_id < 0").collect()}
    assert kept == {-1, -2, -3}


def test_awkward_rows(spark):
    df = awkward(spark)
    got = Q.judge(df)
    assert got.count() == df.count() and {r.kept for r in got.where("n_words < 20").collect()} == {False}
    kept = Q.accept(df)
    assert kept.columns == df.columns
    assert kept.count() == got.where("kept").count()
    assert Q.judge(empty(spark)).count() == 0 and Q.accept(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
