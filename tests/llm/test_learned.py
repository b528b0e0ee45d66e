"""Models that are trained here: held-out accuracy on planted languages and insults, and what is defined for odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidegate.llm import langid, toxicity

SYLLABLES = {"aa": ["ba", "do", "ki", "la", "mo"], "bb": ["sch", "ung", "eit", "ver", "pf"], "cc": ["ción", "ñe", "rra", "lló", "que"]}


def make(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_language_id(spark, empty):
    rnd = random.Random(1)
    langs = [rnd.choice(list(SYLLABLES)) for _ in range(300)]
    rows = [(i, make(rnd, SYLLABLES[lang], rnd.randrange(4, 80)), None if i % 17 == 0 else lang, 7) for i, lang in enumerate(langs)]
    rows += [(1000, None, "aa", 7), (1001, "", None, 7), (1002, "12 34 !?", "bb", 7), (1003, "x" * 200_000, "aa", 7), (None, "ba do", "aa", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(4)
    got = {r.doc_id: r for r in langid.learn_and_identify(docs).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1002].score == 0
    assert langid.learn_and_identify(empty).count() == 0
    assert langid.learn_and_identify(docs.where("doc_id = 1")).count() == 1


def test_profiles_equal_a_plain_count(spark):
    from collections import Counter

    texts = ["Abc abd", "abc-é É", None, "zz"]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    count = Counter()
    for t in texts:
        low = " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
        for n in (1, 2, 3):
            for k in range(len(low) - n + 1):
                g = low[k : k + n]
                if g.strip() and (n < 3 or g[1] != " "):
                    count[g] += 1
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    want = sorted(count, key=lambda g: (-count[g], key(g)))[:20]
    assert langid.profiles(docs, 20)["xx"].tolist() == [key(g) for g in want]


@pytest.fixture(scope="module")
def insults():
    rnd = random.Random(3)
    vocabulary = [make(rnd, SYLLABLES["aa"], 1) + make(rnd, SYLLABLES["bb"], 1) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["oaf", "twit", "dolt"]))
        rows.append((i, " ".join(words)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, insults, empty):
    rows, labels = insults
    odd = [(5000, None), (5001, ""), (5002, "123 !!"), (5003, "word " * 30_000), (None, "you twit dolt oaf")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(4)
    said = spark.createDataFrame([*labels, (None, 1), (7, None), (1, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.learn_and_score(docs, said).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(1500))
    assert np.mean([got[i].predicted for i in held if i % 6 == 0]) > 0.9
    assert np.mean([got[i].predicted for i in held if i % 6]) < 0.01
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert got[5000].score == got[5001].score == got[5002].score and got[5003].predicted == 0 and got[None].predicted == 1
    kept = toxicity.ordinary(docs, said)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.learn_and_score(empty, said).count() == 0
    none = said.where("toxic = 0")
    assert {r.score for r in toxicity.learn_and_score(docs, none).collect()} == {0.0}


def brute_differences(rows, discount=toxicity.DISCOUNT, least=toxicity.LEAST):
    """Kneser-Ney by plain counting: log P(word | toxic) - log P(word | ordinary) of each word. rows: text, toxic."""
    import math
    import re

    before = [{}, {}]
    for text, toxic in rows:
        last = None
        for w in re.findall(r"\w+", (text or "").lower()):
            before[toxic].setdefault(w, set()).add(last)
            last = w
    every = {w: before[0].get(w, set()) | before[1].get(w, set()) for w in {*before[0], *before[1]}}
    n = [{w: len(before[c].get(w, ())) for w in every} for c in (0, 1)]
    total = sum(map(len, every.values()))
    left = {w: max(len(b) - discount, 0) for w, b in every.items()}
    base = {w: (left[w] + (total - sum(left.values())) / len(every)) / total for w in every}
    clear = [{w: max(n[c][w] - discount, 0) if n[0][w] + n[1][w] >= least else 0 for w in every} for c in (0, 1)]
    mass = [sum(c.values()) for c in clear]
    backoff = max(1 - mass[c] / sum(n[c].values()) for c in (0, 1))
    p = [{w: backoff * base[w] + (1 - backoff) * clear[c][w] / mass[c] for w in every} for c in (0, 1)]
    return {w: math.log(p[1][w] / p[0][w]) for w in every}


def hashed(word):
    from tidegate.llm.words import Words

    return Words([word]).of(0)[0]


def test_differences_equal_plain_counting(spark, insults):
    rows, labels = insults
    said = dict(labels)
    known = [(t, said[i], i % 5) for i, t in rows if i in said] + [(None, 0, 0), ("", 1, 1), ("ONE word", 1, 2)]
    counts = toxicity.word_counts(spark.createDataFrame(known, "text string, toxic int, fold int").repartition(3)).cache()
    table = toxicity.differences(counts)
    values = dict(zip(table.words.tolist(), table.values.tolist()))
    for column, keep in ((toxicity.FOLDS, lambda f: True), (2, lambda f: f != 2)):
        want = brute_differences([(t, y) for t, y, f in known if keep(f)])
        got = {w: values.get(int(hashed(w)), [0.0] * 6)[column] for w in want}
        assert all(abs(got[w] - want[w]) < 1e-5 for w in want)
        assert want["twit"] > 2 and want.get("word", 0) == 0


def test_rare_words_come_by_a_shuffle(spark, insults):
    """With room for few broadcast words, or none, scores are the same."""
    rows, labels = insults
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, rows[0][1]), (9002, rows[0][1])], "doc_id long, text string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.learned_from(docs, said)
    want = sorted((r.doc_id, round(r.score, 9), round(r.passage, 9)) for r in toxicity.scores(docs, whole).collect())
    for shared in (150, 0):
        model = toxicity.learn(docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1"), said, shared=shared)
        assert model.table.rare is not None and len(model.table.words) <= shared
        assert np.allclose(model.weights, whole.weights)
        assert sorted((r.doc_id, round(r.score, 9), round(r.passage, 9)) for r in toxicity.scores(docs, model).collect()) == want


def test_rare_words_weigh_the_same_in_both_classes():
    known = brute_differences([("a rare b", 0)] * 3 + [(f"w{k} insult x{k}", 1) for k in range(9)] + [(f"w{k} plain x{k}", 0) for k in range(9)])
    assert known["rare"] == 0 and known["insult"] > 0.5 > -0.5 > known["plain"]


def test_predictions_equal_plain_distances(spark):
    """Rank-order distances by plain Python, on the profiles of the operator and short and long texts."""
    from collections import Counter

    rnd = random.Random(5)
    rows = [(i, make(rnd, SYLLABLES[lang], rnd.randrange(1, 60)), lang) for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(200))]
    rows += [(500, "ba", "aa"), (501, "é", "cc"), (502, None, "aa"), (503, "...", "bb"), (504, "ba do ki " * 5000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = {lang: p.tolist() for lang, p in langid.profiles(docs.where(langid.id_crc("doc_id") % 5 != 0)).items()}
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))

    def judged(text):
        low = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        count = Counter(g for n in (1, 2, 3) for k in range(len(low) - n + 1) for g in [low[k : k + n]] if g.strip() and (n < 3 or g[1] != " "))
        if not count:
            return "und"
        own = [k for k, _ in sorted(((key(g), n) for g, n in count.items()), key=lambda x: (-x[1], x[0]))[:300]]
        far = {lang: sum(abs(p.index(k) - r) if k in p else 300 for r, k in enumerate(own)) for lang, p in known.items()}
        return min(sorted(far), key=far.get)

    got = {r.doc_id: r.lang_pred for r in langid.learn_and_identify(docs).collect()}
    assert got == {i: judged(t) for i, t, _ in rows}
