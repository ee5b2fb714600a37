import random
import zlib

import numpy as np
import pytest

from facetry.llm import periods
from facetry.llm.periods import find_runs, runs_of
from facetry.llm.queries import with_planted_periods
from llm_data import documents, odd_texts, prose, sha, words


def brute_runs(w):
    """By the definition: for every period the maximal stretches, those with a smaller period left out."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def expected_row(text):
    w = words(text, lower=False)
    runs = brute_runs(w)
    gone = {j for s, n, q in runs for j in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for j, x in enumerate(w) if j not in gone)
    milli = best[1] * 1000 // best[2] if best else None
    return len(runs), *(best or (None,) * 3), milli, sha(listed.encode()), sha(kept.encode())


def periodic_texts():
    r = random.Random(12)
    texts = list(odd_texts())
    for k in range(60):
        body = []
        for _ in range(r.randint(1, 5)):
            unit = [r.choice("ab" if k % 2 else "abcdefgh") for _ in range(r.randint(1, 30))]
            body += unit * r.randint(1, 7) + unit[: r.randint(0, len(unit))]
        texts.append(("\n" if k % 3 else " ").join(body))
    unit = prose(9, 700)
    texts += [" ".join([unit] * 5), "a " * 5000, "ab " * 5, "ab " * 6, "x y " * 4, "x y " * 3 + "x"]
    return texts


def test_runs_as_brute_force():
    r = random.Random(5)
    for _ in range(400):
        w = []
        for _ in range(r.randint(1, 4)):
            unit = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 12))]
            w += (unit * 9)[: r.randint(1, 9 * len(unit))]
        assert runs_of(np.array(w, np.uint64)) == brute_runs(w)


def test_every_period_is_in_one_class_that_its_seeds_fit():
    seen = {}
    for low, high, seed in periods._classes(3000):
        for q in range(low, high + 1):
            seen[q] = seen.get(q, 0) + 1
            assert 2 * q <= seed or q == 1
            assert seed <= max(6, 4 * q) - q
    assert set(seen.values()) == {1} and set(seen) >= set(range(1, 1001))


def test_each_diagonal_is_walked_once(monkeypatch):
    walked = []
    agree = periods._agree
    monkeypatch.setattr(periods, "_agree", lambda w, place, lag: walked.append(lag) or agree(w, place, lag))
    unit = list(range(100))
    assert runs_of(np.array(unit * 50, np.uint64)) == [(0, 5000, 100)]
    assert walked.count(100) == 1 and len(walked) < 5


@pytest.mark.parametrize("planted", [False, True])
def test_documents_as_brute_force(spark, planted):
    texts = periodic_texts()
    docs = documents(spark, texts)
    if planted:
        docs = with_planted_periods(docs)
        texts = [rebuilt(i, t) for i, t in enumerate(texts)]
        assert sum(a != b for a, b in zip(texts, periodic_texts(), strict=True)) > 3
    got = {r["doc_id"]: tuple(r)[1:] for r in find_runs(docs, digest=True).collect()}
    real = {r["doc_id"]: r for r in find_runs(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == expected_row(text)
        assert [tuple(run) for run in real[i]["runs"]] == brute_runs(words(text, lower=False))
        assert sha(real[i]["collapsed"].encode()) == got[i][-1] and real[i]["n_runs"] == got[i][0]


def rebuilt(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    w = words(text, lower=False)
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["a " * 9, "a " * 9, None], [None, None, None])
    rows = find_runs(with_planted_periods(docs), digest=True).collect()
    assert sorted((r["doc_id"], r["n_runs"]) for r in rows) == [(None, 0), (None, 1), (None, 1)] or [
        r["n_runs"] for r in sorted(rows, key=lambda r: r["n_runs"])
    ] == [0, 1, 1]
    assert find_runs(documents(spark).limit(0)).count() == 0
