"""Spelling variants against brute force over all pairs of words."""
import random
import re
import zlib
from collections import Counter

import pytest

from soilcast.llm import spelling
from tests.llm.helpers import SF, awkward, empty, rows_of

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(docs, least=7):
    c = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= 2}


def brute(v, factor=10):
    """Rows of words with their counts; every pair of words of alike length is compared."""
    by_length = {}
    for w in v:
        by_length.setdefault(len(w), []).append(w)
    links = {w: [u for k in (-1, 0, 1) for u in by_length.get(len(w) + k, ()) if near(w, u)] for w in v}
    form = {}
    for w, us in links.items():
        best = min(us, key=lambda u: (-v[u], u), default=None)
        if best and v[best] >= factor * v[w]:
            form[w] = best
    out = []
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, v[w], len(links[w]), v[form[w]] if w in form else None))
    return sorted(out, key=repr)


def family(seed):
    """Words at one and two edits of one another, with accents and repeated letters, counts that chain."""
    r = random.Random(seed)
    out = {}
    for _ in range(25):
        w = "".join(r.choices("abéñÿ÷", k=r.randint(7, 12)))
        n = 2000
        for _ in range(12):
            out[w] = max(2, n)
            n //= r.choice([1, 10, 12])
            p = r.randrange(len(w))
            w = r.choice([w[:p] + w[p + 1:], w[:p] + r.choice("abñ") + w[p:], w[:p] + r.choice("abñ") + w[p + 1:], w + w[-1]])
            if len(w) < 7:
                w += "abababa"
    return out


@pytest.mark.parametrize("levels", [24, 1, 3])
def test_pairs_of_word_families(spark, levels):
    v = family(levels)
    words = spark.createDataFrame([(i, w) for i, w in enumerate(v)], "id long, word string").repartition(4)
    names = list(v)
    got = spelling.near_pairs(words, levels=levels).collect()
    pairs = [tuple(sorted((names[a], names[b]))) for a, b in got]
    assert sorted(set(pairs)) == sorted({tuple(sorted((a, b))) for a in v for b in v if near(a, b)})


def test_forms_and_chains_from_texts(spark):
    v = {"absolute": 2000, "absolutte": 150, "absolluttes": 2, "absoluttes": 15, "bsolute": 3, "absolüte": 200}
    texts = [(i, " ".join(w for w, n in v.items() for _ in range(n // 2 if i < 2 else 0))) for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows_of(spelling.variants(df), *COLUMNS)
    assert got == brute(counts(texts))
    assert any(r[1] and r[2] != r[1] for r in got)      # a chain of forms


def test_long_words(spark):
    w = "".join(random.Random(2).choices("abcdefgh", k=300))
    v = [w, w[:5] + w[6:], w[:290] + "z" + w[291:], w[::-1]]
    words = spark.createDataFrame(list(enumerate(v)), "id long, word string")
    got = {tuple(sorted(r)) for r in spelling.near_pairs(words).collect()}
    assert got == {(a, b) for a in range(4) for b in range(a + 1, 4) if near(v[a], v[b])}


def test_whole_table(spark):
    from soilcast.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_spelling_variants"](spark, SF), *COLUMNS) == brute(counts(docs))


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, ["Spelling SPELLING spellinG", None, "", "spellings spellings ÀÉspell ÀÉspell", "short"])
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(spelling.variants(docs), *COLUMNS) == brute(counts(plain))
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(awkward(spark, ["a b"])).count() == 0


def test_words_without_neighbours_make_no_states(spark, monkeypatch):
    r, rows, written = random.Random(5), {}, spelling.written

    def counted(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(spelling, "written", counted)
    v = sorted({"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(500)})
    words = spark.createDataFrame([(i, w) for i, w in enumerate(v + [v[0][:-1] + "é"])], "id long, word string")
    assert [sorted(x) for x in spelling.near_pairs(words).collect()] == [[0, len(v)]]
    assert sum(n for name, n in rows.items() if "level" in name) <= 10 and rows["spelling-edges"] <= 30
