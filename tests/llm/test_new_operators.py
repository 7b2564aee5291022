"""Collocations, hard negatives and quality rules against brute force, and their odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import collocations, exact_dedup, hard_negatives, quality_rules

DOCS = "doc_id long, text string, lang string, word string, n long, good string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def best_phrases(texts, least, top):
    """Brute force over (lang, text)."""
    f, words = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    out = {}
    inside = Counter()
    for (lang, *p), a in f.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                k = (lang, *p[i : i + n])
                inside[k] = max(inside[k], a if a >= least else 0)
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least and not 100 * inside[(lang, *p)] >= 80 * a:
            cuts = [(2000000 * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p))]
            score, _, left, right = min(cuts, key=lambda c: c[:2])
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, x, y, words[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("dictionary", "held"), [(1 << 22, 1 << 20), (0, 300)])
def test_collocations(spark, monkeypatch, dictionary, held):
    monkeypatch.setattr(collocations, "DICTIONARY", dictionary)
    monkeypatch.setattr(collocations, "BUCKET_ROWS", 7)
    monkeypatch.setattr(collocations, "HELD", held)
    rng = random.Random(4)
    vocab = ["a", "B", "été", "the", "THE", "x" * 300, "\x01", "日本", "rare1", "rare2"]
    weights = [9, 8, 5, 9, 5, 3, 4, 4, 1, 1]
    texts = [(rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for w in rng.choices(vocab, weights, k=rng.randrange(60)))) for _ in range(80)]
    texts += [("en", None), ("fr", ""), ("en", "word " * 30_000), ("en", "a b c d e"), ("en", "a b c d e")]
    docs = spark.createDataFrame([(k, t, lang, "x", 1, "g") for k, (lang, t) in enumerate(texts)], DOCS).repartition(5)
    for least, top in ((5, 9), (3, 2000)):
        found = rows(collocations.collocations(docs, least, top), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert found == best_phrases(texts, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_radix_order():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, k, 5000).astype(np.uint64) for k in (3, 1 << 40, 70_000)]
    order = collocations.radix_order(columns)
    assert (order == np.lexsort(columns[::-1])).all()


def mined(vectors, is_anchor, positives, negatives, scale):
    """Brute force over (row, id, label, vector)."""
    out = []
    ints = [(row, i, label, [int(np.floor(x * scale)) for x in v]) for row, (i, label, v) in enumerate(vectors) if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for row, i, label, v in ints:
        if not is_anchor(i):
            continue
        ranked = sorted((-dot(v, w), j, y == label) for other, j, y, w in ints if other != row)
        for s, j, _ in [r for r in ranked if r[2]][:positives]:
            hard = [(-t, k) for t, k, same in ranked if not same and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 5])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", min(block, 64))
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12))
    vectors = []
    for k in range(220):
        label = int(rng.integers(0, 4))
        vectors.append((k, label, [float(x) for x in (centre[label] + rng.normal(size=12) + 1) / 8]))
    vectors += [(7, 1, vectors[7][2]), (7, 2, vectors[9][2]), (300, 1, None), (301, None, vectors[1][2]), (None, 1, vectors[1][2]), (302, 1, [1.0, None]), (303, 2, [float("nan")] * 12), (304, 2, [0.5] * 3), (305, 0, [float("inf")] * 12)]
    vectors += [(310 + k, k % 4, vectors[0][2]) for k in range(40)] + [(400, 1, []), (410, 2, [0.0] * 12), (420, 9, vectors[3][2])]
    for more in ([], [(500, 1, [1e5] * 12), (501, 2, [7e4] * 12)]):  # the last ones go by Python's integers
        table = spark.createDataFrame([(*v, "x") for v in vectors + more], "vec_id long, label int, embedding array<double>, score string")
        found = hard_negatives.hard_negatives(table, table.vec_id % 10 == 0)
        names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        assert rows(found, *names) == mined(vectors + more, lambda i: i % 10 == 0, 5, 3, 256)
    assert hard_negatives.hard_negatives(table.limit(0), table.vec_id % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(table.where("label = 1"), table.vec_id % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, table.vec_id < 0).count() == 0


def test_intervals_of_large_scores():
    scores = np.array([0, 1, 99, 100, 101, -7, (1 << 62) - 1, -(1 << 62)])
    low, high = hard_negatives.intervals(scores, 50, 95)
    assert low.tolist() == [-(-50 * int(s) // 100) for s in scores] and high.tolist() == [95 * int(s) // 100 for s in scores]


def counted(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


GOOD = "The house stands by the river, and in the spring of the year water comes to the garden. It was built for a family that has since gone away. Nobody knows where they are now, but letters still arrive. Somebody reads them on the porch in the evening, with a lamp. "


def test_quality_rules(spark):
    rng = random.Random(6)
    vocab = ["a", "b&", "é", "日本", "#1", "x\x0by", "q\r", "w"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "  ", "\n \n"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [None, "", " \n\t", "word " * 30_000, "one two three four five six seven eight " * 2, "a\na\r\na\n\n\na"]
    shuffled = [" ".join(rng.sample(GOOD.split(), 45)) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in t.split()) for t in shuffled[:25]] + [t.upper().replace(" ", "!! ") + "!!" for t in shuffled[25:40]]
    docs = spark.createDataFrame([(k, t, "en", "x", 1, "g") for k, t in enumerate([*texts, *shuffled, *junk, shuffled[0]])], DOCS)
    found = {r.doc_id: r for r in quality_rules.quality_verdicts(docs, carry=["doc_id", "text", "word"]).collect()}
    assert len(found) == docs.count()
    for r in found.values():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(r.text), r.text
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.good >= 0.5)
    at = len(texts)
    assert all(found[at + k].kept for k in range(150)) and not any(found[at + 150 + k].kept for k in range(40))
    assert found[docs.count() - 1].good == found[at].good
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0


def test_learning_equals_plain_expectation_maximisation(spark):
    rng = random.Random(8)
    names = ["p", "q", "r", "s"]
    votes = []
    for _ in range(400):
        good = rng.random() < 0.7
        votes.append([rng.choices([0, 1, -1], [2, 7, 0.2] if good else [2, 3, 5])[0] for _ in names])
    p, share = quality_rules.learn(spark.createDataFrame([(v,) for v in votes], "v array<tinyint>"), "v", names)
    belief = quality_rules.BELIEF
    t = np.array([[belief[c][0] / sum(belief[c])] * 4 for c in ("good", "bad")])
    pi, v = belief["share"][0] / sum(belief["share"]), np.array(votes)
    for _ in range(quality_rules.STEPS):
        like = [np.where(v > 0, t[c], np.where(v < 0, 1 - t[c], 1.0)).prod(1) for c in (0, 1)]
        g = pi * like[0] / (pi * like[0] + (1 - pi) * like[1])
        new = np.array([[(w[v[:, j] > 0].sum() + belief[c][0]) / (w[v[:, j] != 0].sum() + sum(belief[c])) for j in range(4)] for c, w in (("good", g), ("bad", 1 - g))])
        new[0] = np.clip(new[0], 1 - quality_rules.MOST_BLAMED, 1 - quality_rules.LEAST_BLAMED)
        new[1] = np.minimum(new[1], new[0])
        old, pi = pi, (g.sum() + belief["share"][0]) / (len(v) + sum(belief["share"]))
        moved, t = max(abs(pi - old), np.abs(new - t).max()), new
        if moved < quality_rules.CHANGE:
            break
    assert abs(share - pi) < 1e-9 and all(abs(p[c, n] - t[k][j]) < 1e-9 for k, c in enumerate(("good", "bad")) for j, n in enumerate(names))


def test_exact_stage_keeps_the_largest_id(spark):
    long = "x" * 9000
    texts = [(1, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (None, "b"), (None, "b"), (5, long + "1"), (6, long + "2"), (7, long + "1"), (7, long + "1"), (8, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "x", k, "g") for k, (i, t) in enumerate(texts)], DOCS.replace("word", "_text").replace("good", "_doc"))
    out = exact_dedup.exact_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    found = Counter((r.doc_id, (r.text or "")[-1:]) for r in out.collect())
    assert found == Counter([(2, "a"), (4, ""), (None, "b"), (6, "2"), (7, "1"), (8, "e")])
    assert exact_dedup.exact_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_keys_are_made_of_slices_of_a_batch(monkeypatch):
    """A batch larger than BLOCK is handled in slices of whole texts, with the same keys."""
    import pyarrow as pa

    texts = [f"a b c{k % 3} a b. x{k}" * (1 + 30 * (k == 7)) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(texts)], ["lang", "text"])
    sizes, real = [], collocations.words_of
    monkeypatch.setattr(collocations, "words_of", lambda b: sizes.append((b.num_rows, sum(map(len, b.column(1).to_pylist())))) or real(b))
    find_of = lambda: lambda prints: prints % collocations.U(1000) + collocations.U(1)

    def keys():
        out = Counter()
        for b in collocations._encode(find_of, 4)(iter([batch])):
            out.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        return out

    whole = keys()
    assert sizes.pop() and not sizes
    monkeypatch.setattr(collocations, "BLOCK", 100)
    assert keys() == whole and sum(n for n, _ in sizes) == 40 and all(size <= 100 or n == 1 for n, size in sizes)
