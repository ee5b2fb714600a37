import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from facetry.errors import FacetryError
from facetry.llm import exchange, substrings, suffixes
from facetry.llm.components import connected_components
from facetry.llm.neardups import near_duplicates
from facetry.llm.spherical import Code, near_vectors
from facetry.llm.substrings import remove_repeated_windows
from facetry.llm.suffixes import remove_repeated_bytes, repeats_to_remove
from llm_data import components, documents, near_components, odd_texts, prose, sha, windows_removed, words


def spans_of(gone):
    return sum(1 for j, x in enumerate(gone) if x and not (j and gone[j - 1]))


@pytest.mark.parametrize("chunk_bytes", [2_000, 4_000_000])
def test_word_windows_as_brute_force(spark, chunk_bytes):
    docs = [(i, words(t, lower=False)) for i, t in enumerate(odd_texts())]
    got = {r["doc_id"]: r for r in remove_repeated_windows(documents(spark), 50, chunk_bytes, digest=True).collect()}
    real = {r["doc_id"]: r for r in remove_repeated_windows(documents(spark), 50, chunk_bytes).collect()}
    assert sum(sum(g) for g in windows_removed(docs, 50)) > 300
    for (i, w), gone in zip(docs, windows_removed(docs, 50), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["n_spans"]) == (len(w), sum(gone), spans_of(gone))
        assert got[i]["kept_sha256"] == sha(kept.encode()) and real[i]["kept"] == kept
        assert sum(s["end"] - s["start"] for s in real[i]["spans"]) == sum(gone)


@pytest.mark.parametrize("chunk_bytes, many", [(2_000, 2000), (4_000_000, 1)])
def test_byte_strings_as_brute_force(spark, chunk_bytes, many, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", many)
    docs = [(i, (t or "").encode()) for i, t in enumerate(odd_texts())]
    got = {r["doc_id"]: r for r in remove_repeated_bytes(documents(spark), 50, chunk_bytes, digest=True).collect()}
    rows = remove_repeated_bytes(documents(spark), 50, chunk_bytes, carry=("source", "n_chars"))
    real = {r["doc_id"]: r for r in rows.collect()}
    for (i, data), gone in zip(docs, windows_removed(docs, 50), strict=True):
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(data), sum(gone), spans_of(gone))
        assert got[i]["kept_sha256"] == sha(kept)
        assert real[i]["source"] == f"s{i % 3}" and len(real[i]["spans"]) == spans_of(gone)
        assert len(real[i]["text"].encode()) >= len(kept)


def removed_in_chunks(texts, chunks, window=50, bits=4):
    """The digest rows of the passes over these chunks, without Spark."""

    def exchanged(bucket_of, sent):
        return {b: sorted((c, body) for c, to, body in sent if bucket_of(c, to) == b) for b in {bucket_of(c, to) for c, to, _ in sent}}

    tables = {
        k: exchange.sorted_chunk(pa.table({"doc_id": ids, "text": [texts[i] for i in ids], "chunk": [k] * len(ids)}))
        for k in range(chunks)
        if (ids := list(range(k, len(texts), chunks)))
    }
    asked = exchanged(lambda c, to: to, [(k, b, body) for k, t in tables.items() for b, body in suffixes._emit(t, window, bits)])
    got = {k: [] for k in tables}
    for bucket, sent in asked.items():
        for (k, _), body in zip(sent, suffixes._reply([body for _, body in sent], bits), strict=True):
            got[k].append((bucket, body))
    resolved = pa.concat_tables([suffixes._resolve(t, sorted(got[k]), window, bits) for k, t in tables.items()])
    spans = {k: [] for k in tables}
    for bucket in resolved["bucket"].unique():
        part = resolved.filter(pa.compute.equal(resolved["bucket"], bucket))
        for r in suffixes._compare((bucket,), part, window).to_pylist():
            spans[r["chunk"]].append((r["bucket"], r["body"]))
    return {r["doc_id"]: r for k, t in tables.items() for r in suffixes._finish(t, sorted(spans[k]), True).to_pylist()}


def assert_removed_as_brute_force(texts, chunks):
    got = removed_in_chunks(texts, chunks)
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    for (i, data), gone in zip(docs, windows_removed(docs, 50), strict=True):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (sum(gone), spans_of(gone))
        assert got[i]["kept_sha256"] == sha(bytes(x for x, g in zip(data, gone, strict=True) if not g))


@pytest.mark.parametrize("chunks", [1, 2, 3])
def test_windows_of_frequent_anchors_that_a_document_repeats(chunks, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 1)
    line = prose(70, 12)[:70]
    new = [prose(80 + n, 30) for n in range(12)]
    texts = [new[0] + line + new[1], new[2] + line + new[3] + line + new[4] + line + new[5], new[6] + line + new[7]]
    texts.append(new[8] + line + new[9] + line + new[8] + line + new[9])
    assert_removed_as_brute_force(texts, chunks)


@pytest.mark.parametrize("chunks", [1, 2, 3])
def test_passages_repeated_in_one_document_with_equal_surroundings(chunks):
    x, p, y, a, b, c = (prose(90 + n, 30)[:n_bytes] for n, n_bytes in enumerate((80, 60, 80, 90, 90, 40)))
    assert_removed_as_brute_force([x + p + y, a + p + b + c + a + p + b, c + a + p + b + a + p + b], chunks)
    random = np.random.default_rng(7)
    blocks = [prose(200 + n, 30)[: int(random.integers(20, 120))] for n in range(9)]
    for _ in range(20):
        texts = ["".join(blocks[i] for i in random.integers(0, 9, random.integers(1, 12))) for _ in range(5)]
        assert_removed_as_brute_force(texts, chunks)


def test_maximal_repeats_as_brute_force():
    random = np.random.default_rng(3)
    for _ in range(300):
        width = int(random.integers(3, 8))
        strings = [bytes(random.choice([97, 98], random.integers(width, width + 7)).tolist()) for _ in range(random.integers(1, 9))]
        docs = random.integers(0, 5, len(strings))
        first = {}
        for s, d in zip(strings, docs, strict=True):
            for j in range(len(s) - width + 1):
                first[s[j : j + width]] = min(first.get(s[j : j + width], 9), d)
        expected = {
            (i, k)
            for i, (s, d) in enumerate(zip(strings, docs, strict=True))
            for j in range(len(s) - width + 1)
            if first[s[j : j + width]] < d
            for k in range(j, j + width)
        }
        got = {(i, k) for i, a, b in repeats_to_remove(strings, docs, width).T.tolist() for k in range(a, b)}
        assert got == expected


def test_packed_numbers_and_ids():
    numbers = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64) >> np.uint64(8) << np.uint64(8))
    for bucket, a, b, body in exchange.pack_sorted(numbers, 5, 6):
        whole = exchange.unpack_sorted(body, 5, 6, bucket)
        assert (whole >> np.uint64(8) == numbers[a:b] >> np.uint64(8)).all()
    for ids in ([], [7], [-3, 5, 2**40], list(range(0, 9000, 7))):
        ids = np.array(ids, np.int64)
        assert (exchange.unpack_ids(exchange.pack_ids(ids)) == ids).all() if len(ids) else True


def test_owners_of_numbers():
    r = np.random.default_rng(5)
    for n, most in ((0, 5), (1, 5), (300, 2**50), (70_000, 2**63 - 1)):
        ids = np.unique(r.integers(-most, most, max(n, 1)))
        ranks = r.integers(0, len(ids), n)
        body = exchange.pack_owners(ids, ranks)
        assert (exchange.unpack_owners(body, n) == ids[ranks]).all()


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_what_a_chunk_sends_hardly_grows_with_the_corpus(module):
    """Messages name only the documents their hashes are from, however many buckets a chunk is dealt over."""
    texts = [prose(seed, 560) for seed in range(1200)]
    sent = []
    for n_ids, bits in ((256_410, 8), (15_000_000, 14)):
        ids = np.sort(np.random.default_rng(2).choice(n_ids, len(texts), replace=False))
        table = pa.table({"doc_id": pa.chunked_array([pa.array(ids)]), "text": pa.chunked_array([pa.array(texts)])})
        sent.append(sum(len(body) for _, body in module._emit(table, 50, bits)))
    assert sent[1] <= 1.3 * sent[0]


@pytest.mark.parametrize("operator", [remove_repeated_windows, remove_repeated_bytes, near_duplicates])
def test_odd_ids_and_empty_tables(spark, operator):
    text = odd_texts()[0]
    docs = documents(spark, [text, text, text, text, None], [5, 5, None, 9, None])
    rows = operator(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 5), (False, 5), (False, 9), (True, 0), (True, 0)]
    assert operator(docs.limit(0)).count() == 0
    if operator is near_duplicates:
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(5, 5, True), (9, 5, False), (None, None, True)}
    else:
        gone = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_removed"] > 0) for r in rows)
        assert gone == [((False, 5), False), ((False, 5), False), ((False, 9), True), ((True, 0), False), ((True, 0), True)]


def test_near_duplicates_as_brute_force(spark):
    base = odd_texts()[0].split()
    texts = odd_texts()
    for n in range(40):  # a family of copies with edits of all sizes
        copy = list(base)
        for k in range(n % 8):
            copy[(7 * n + 13 * k) % len(copy)] = f"edit{n % 5}"
        texts.append(" ".join(copy))
    sets, labels = near_components(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in near_duplicates(documents(spark, texts)).collect()}
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), labels[i], labels[i] == i)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*path, *star, (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(edges.limit(0)).count() == 0


def test_near_vectors_as_brute_force(spark):
    random = np.random.default_rng(5)
    centres = random.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.22 * random.standard_normal(24)).tolist(), 0) for i in range(150)]
    rows += [(200 + i, rows[3][1], 1) for i in range(5)] + [(300, (2.0 * np.array(rows[3][1])).tolist(), 1)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 24, 0), (403, [float("nan")] + [1.0] * 23, 0)]
    rows += [(404, [None] + [1.0] * 23, 0), (405, [1.0, 2.0], 0), (406, [2.0, 4.1], 0), (407, [1e300] * 24, 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rep int")
    ok = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    labels = components([r[0] for r in rows], links)
    counts = {i: sum(i in link for link in links) for i in labels}
    assert len(links) > 50
    got = {r["vec_id"]: r for r in near_vectors(vectors).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (counts[i], labels[i], labels[i] == i) for i in labels
    }
    assert near_vectors(vectors.limit(0)).count() == 0


def test_thresholds_below_those_of_the_filters_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    for least in (0.94, float("nan")):
        with pytest.raises(FacetryError):
            near_vectors(vectors, least)
    with pytest.raises(FacetryError):
        near_duplicates(documents(spark), 74)
    assert near_vectors(vectors, 0.97).count() == 1


def test_filters_find_pairs_at_the_threshold():
    random = np.random.default_rng(11)
    decoder = Code.for_vectors(50_000).decoder(64)
    a = random.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = random.standard_normal((4000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    found = [len(np.intersect1d(x, y)) > 0 for x, y in zip(decoder.filters(a), decoder.filters(b), strict=True)]
    assert np.mean(found) >= 0.999


