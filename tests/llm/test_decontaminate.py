import random

import numpy as np
import pytest

from codeloom.llm import decontaminate as D


def sellers(item, text):
    """Least edit distance of item to any stretch of text."""
    last = [0] * (len(text) + 1)
    for i, s in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (s != t)))
        last = row
    return min(last)


def test_bit_vector_distance():
    rng = random.Random(1)
    for _ in range(600):
        item, text = [rng.randint(1, 4) for _ in range(rng.randint(1, 80))], [rng.randint(0, 4) for _ in range(rng.randint(0, 90))]
        assert D.edit_distance(np.array(item), np.array(text, np.int64))[0] == sellers(item, text)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, say(rng.randint(5, 60))) for k in range(40)]
    docs = []
    for k in range(300):
        body = say(rng.randint(0, 200))
        if k % 3 == 0:
            _, item = rng.choice(items)
            item = list(item)
            for _ in range(rng.randint(0, int(0.3 * len(item)))):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((k, " ".join(body)))
    return docs, [(k, " ".join(w).capitalize() + ".") for k, w in items]


def test_recall_and_precision_against_brute_force(corpus):
    docs, items = corpus
    index = D.build_index(items)
    want, got = set(), set()
    for k, text in docs:
        symbols = np.array([index.vocabulary.get(w, 0) for w in D.words(text)], np.int64)
        got |= {(k, index.ids[i], d) for i, d, _ in D.search(symbols, index)}
        for i, item in enumerate(index.items):
            distance = sellers(item.tolist(), [s or -1 for s in symbols.tolist()])
            if distance <= index.edits[i]:
                want.add((k, index.ids[i], distance))
    assert len(want) > 60
    assert {g[:2] for g in got} <= {w[:2] for w in want}
    assert len(got & want) >= 0.97 * len(want)


def test_exact_copies_are_never_missed():
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40)))) for k in range(30)]
    index = D.build_index(items)
    for k, text in items:
        symbols = np.array([index.vocabulary.get(w, 0) for w in D.words("before " + text + " after")], np.int64)
        assert any(index.ids[i] == k and d == 0 for i, d, _ in D.search(symbols, index))


def test_rows(spark, messy, nothing, corpus):
    docs, items = corpus
    bench = spark.createDataFrame([*items, (None, "five words of no id"), (77, None), (78, ""), (79, "too short"), items[0]], "item_id long, text string")
    got = D.contaminated(messy, bench)
    assert got.columns == ["doc_id", "item_id", "distance", "item_words", "last_word"]
    got.collect()
    planted = spark.createDataFrame([(1, "intro: " + items[0][1] + " outro"), (1, "intro: " + items[0][1] + " outro"), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["distance"]) for r in D.contaminated(planted, bench).where("item_id = 0").collect()] == [(1, 0), (1, 0)]
    assert D.contaminated(nothing, bench).collect() == []
    assert D.contaminated(messy, bench.limit(0)).collect() == []


def test_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    docs, items = corpus
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sum(1 for _ in D._blocks(bench)) > 2
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).count()
    monkeypatch.setattr(D, "BLOCK_BYTES", 1 << 24)
    assert got == D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).count()


def test_walks_hold_for_each_length():
    rng = random.Random(9)
    say = lambda n: np.array([rng.randint(1, 3000) for _ in range(n)], np.int64)
    items = [say(8) for _ in range(450)] + [say(20) for _ in range(3)] + [say(400) for _ in range(3)] + [say(2100)]
    text = [(k, " ".join(f"w{s}" for s in i.tolist())) for k, i in enumerate(items)]
    index = D.build_index(text)
    assert len(set(index.walks[:450])) == 1 and D.WHOLE not in index.walks
    for at in (0, 451, 454, 456):
        found = 0
        for _ in range(150):
            changed = D._mutated(index.items[at], index.edits[at], rng)
            near = D.edit_distance(index.items[at], changed)[0]
            hit = [d for i, d, _ in D.search(np.r_[np.zeros(7, np.int64), changed, np.zeros(9, np.int64)], index) if i == at]
            found += hit == [near]
        assert found >= 147


def test_few_random_windows_pass(corpus):
    docs, items = corpus
    index, rng = D.build_index(items), np.random.default_rng(3)
    text = rng.integers(1, len(index.vocabulary) + 1, 200_000)
    windows = len({(i, s) for met in D._met([text], index) for i, _, s in met.tolist()})
    assert windows < 0.01 * len(text) * len(items)


def test_result_comes_from_the_samples(corpus, monkeypatch):
    docs, items = corpus
    texts = [[w for w in D.words(t)] for _, t in docs]
    index = D.build_index(items)
    symbols = [np.array([index.vocabulary.get(w, 0) for w in t], np.int64) for t in texts]
    assert any(D.search_all(symbols, index))
    empty = D.Index(index.ids, index.items, index.edits, index.vocabulary, index.walks, {})
    assert not any(D.search_all(symbols, empty))
    monkeypatch.setattr(D, "CHUNK", 16)
    monkeypatch.setattr(D, "PAIRS", 3)
    assert D.search_all(symbols, index) == [D.search(s, index) for s in symbols]


def test_unreached_recall_is_verified_against_whole_texts(monkeypatch):
    monkeypatch.setattr(D, "MOST_WALKS", 0)
    rng = random.Random(10)
    item = [f"w{rng.randint(0, 500)}" for _ in range(60)]
    index = D.build_index([(1, " ".join(item))])
    assert index.walks == [D.WHOLE]
    for _ in range(40):
        changed = list(item)
        for at in rng.sample(range(60), 12):
            changed[at] = "other"
        symbols = np.array([index.vocabulary.get(w, 0) for w in D.words(" ".join(["x"] * 9 + changed + ["y"] * 9))], np.int64)
        assert [i for i, _, _ in D.search(symbols, index)] == [0]


def test_one_run_shared_by_many_items_and_a_long_text():
    items = [(k, "which of the following statements is true about " + " ".join(f"t{k}x{n}" for n in range(12))) for k in range(300)]
    index = D.build_index(items)
    symbols = np.array([index.vocabulary[w] for w in D.words(items[5][1])[:8]] * 400, np.int64)
    assert D.search(symbols, index) == []
    planted = np.r_[symbols, [index.vocabulary[w] for w in D.words(items[7][1])]]
    assert [(i, d) for i, d, _ in D.search(planted, index)] == [(7, 0)]


def test_short_and_unspaced_items():
    chinese = "下列哪一项是光合作用的主要产物之一并且储存能量"
    index = D.build_index([(1, "Answer: blue"), (2, "42"), (3, chinese), (4, "..."), (5, "one two three four")])

    def found(text):
        symbols = np.array([index.vocabulary.get(w, 0) for w in D.words(text)], np.int64)
        return {(index.ids[i], d) for i, d, _ in D.search(symbols, index)}

    assert found("the answer blue, is right") == {(1, 0)} and found("blue answer") == set()
    assert found("is 42.") == {(2, 0)} and found("one two three") == set() and found("so one, two three four") == {(5, 0)}
    assert found("问题：" + chinese + "。") == {(3, 0)}
    assert found("问题" + chinese[:8] + "错" + chinese[9:] + "答案") == {(3, 1)}
