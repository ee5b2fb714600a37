import json
import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm import decontamination, language, toxicity
from facetry.llm.bpe import Coder, encode_decode, read_ranks
from facetry.llm.chat import escape, format_windows, read_back, unescape
from facetry.llm.decontamination import align, contaminated
from facetry.llm.language import best_class, score_texts
from facetry.llm.quality import score_quality, score_rows, term_counts
from facetry.llm.toxicity import fold, score_toxicity
from llm_data import documents, fold_of, near_components, odd_texts, prose, sha, windows_removed, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Tokens -----------------------------------------------------------------------------------------


def tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_tokens_as_the_library(spark):
    own = tokenizer()
    texts = odd_texts()
    real = {r["doc_id"]: r for r in encode_decode(documents(spark), RANKS, public_tokenizers.PATTERN).collect()}
    got = {r["doc_id"]: r for r in encode_decode(documents(spark), RANKS, public_tokenizers.PATTERN, digest=True).collect()}
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        assert real[i]["ids"] == ids and real[i]["decoded"] == (text or "") and real[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert got[i]["decoded_sha256"] == sha((text or "").encode())
    assert encode_decode(documents(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_and_long_texts_as_the_library(monkeypatch):
    own, coder, r = tokenizer(), Coder(read_ranks(RANKS), public_tokenizers.PATTERN), random.Random(4)
    texts = ["".join(r.choice("abcdeeetthhinnos") for _ in range(600)) for _ in range(5)]
    texts += ["-" * 3001, "=-" * 400, "a" * 1000, "日本語" * 100, prose(8, 400), "\n" * 700]
    monkeypatch.setattr("facetry.llm.bpe._LONG_TEXT", 1500)
    monkeypatch.setattr("facetry.llm.bpe._PIECES", 100)
    for text, parts in zip(texts, coder.encode(texts), strict=True):
        ids, decoded = zip(*parts, strict=True)
        assert b"".join(ids) == np.array(own.encode_ordinary(text), "<u4").tobytes()
        assert b"".join(decoded) == text.encode()


def test_pieces_pushed_out_by_a_long_text_are_encoded_again(monkeypatch):
    own, coder = tokenizer(), Coder(read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr("facetry.llm.bpe._LONG_TEXT", 3000)
    monkeypatch.setattr("facetry.llm.bpe._PIECES", 100)
    monkeypatch.setattr("facetry.llm.bpe._REMEMBERED", 50)
    long = " ".join(f"long{k}xq" for k in range(600))
    texts = [prose(8, 40), long, prose(9, 60), "zzqx yyqx", long, prose(8, 40)]
    for _ in range(2):
        for text, parts in zip(texts, coder.encode(texts), strict=True):
            ids, decoded = zip(*parts, strict=True)
            assert b"".join(ids) == np.array(own.encode_ordinary(text), "<u4").tobytes()
            assert b"".join(decoded) == text.encode()


# Quality and toxicity ---------------------------------------------------------------------------


@pytest.mark.parametrize("operator, threshold", [(score_quality, 0.3), (score_toxicity, 0.5)])
def test_scores_of_odd_rows(spark, operator, threshold):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, 1, None), (None, 1, 1), (77, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    rows = {r["doc_id"]: r for r in operator(docs, labels).collect()}
    assert set(rows) == set(range(len(odd_texts())))
    for i, r in rows.items():
        assert r["held_out"] == (fold_of(i) == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= threshold)
    assert [rows[i]["score"] for i in (4, 17)] == pytest.approx([rows[0]["score"]] * 2)
    assert operator(docs, labels.limit(0)).count() == len(odd_texts())
    assert operator(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_told_apart(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    for operator, name in ((score_quality, "quality"), (score_toxicity, "toxic")):
        rows = operator(docs, labels).where("held_out").join(labels, "doc_id").collect()
        ones, zeros = ([r["score"] for r in rows if r[name] == label] for label in (1, 0))
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
        assert auc >= (0.95 if name == "quality" else 0.75)


def test_labels_do_not_reach_scores_of_held_out_rows(spark):
    docs = documents(spark)
    held = [i for i in range(18) if fold_of(i) == 0]
    scores = []
    for flip in (0, 1):
        labels = [(i, i % 2 ^ (flip if i in held else 0), i % 2) for i in range(18)]
        frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in score_quality(docs, frame).collect()})
    assert held and scores[0] == scores[1]


def test_terms_follow_the_look_and_rows_keep_their_columns(spark):
    look = term_counts(pa.array(["AAAA!! BBBB!!", "CCCC!! DDDD!!", None, ""]))
    assert (look[0, :1024] == look[1, :1024]).all() and not look[2:].any()
    labels = spark.createDataFrame([(0, 1), (5, 0)], "doc_id bigint, quality int")
    rows = score_rows(documents(spark), labels)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "chunk", "rep", "score"]


def test_folding_and_lexicon():
    assert fold("1D10T  Moron! ｍoron m0ron. мoron 2024") == " idiot moron moron moron moron 2024 "
    lexicon = toxicity.Lexicon({"trash": 2.0, "idio": 3.0}, slope=1.0, offset=-1.0)
    assert lexicon.weight_of("the trash can") == 0 and lexicon.weight_of("the trash") > 0
    assert lexicon.weight_of("idiots") == pytest.approx(3 / math.log(math.e + 2)) and lexicon.weight_of("patrash") == 0
    assert lexicon.weight_of(None) == 0 and lexicon.score("idiot idiot") > lexicon.score("idiot " + "word " * 90)


# Language model ---------------------------------------------------------------------------------


def test_base_scores_as_brute_force(spark):
    texts = odd_texts() + [prose(n, 40) for n in range(30, 50)]
    counts = Counter()
    for i, t in enumerate(texts):
        if fold_of(i) != 1:
            counts.update([*words(t), "\0end"])
    total, size = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in score_texts(documents(spark, texts), frequent=50, rounds=2).collect()}
    for i, t in enumerate(texts):
        tokens = [*words(t), "\0end"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold_of(i) == 1, len(tokens), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    assert score_texts(documents(spark).limit(0)).count() == 0


def test_classes_predict_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held, score, base = score_texts(docs).where("held_out").agg(F.count("*"), F.sum("score"), F.sum("base_score")).first()
    assert held > 100 and score > base


def test_probabilities_of_one_history_sum_to_one(spark):
    """A word after one history: all known words and one unknown have probability one together."""
    vocabulary = [f"w{n}" for n in range(40)]
    r = random.Random(2)
    texts = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(20)]
    known = sorted({w for i, t in enumerate(texts) if fold_of(i) != 1 for w in words(t)})
    probes = [f"{known[0]} {w}" for w in [*known, "unknown"]] + [known[0]]
    ids = list(range(20)) + [i for i in range(1000, 9000) if fold_of(i) == 1][: len(probes)]
    got = {r["doc_id"]: r["score"] for r in score_texts(documents(spark, texts + probes, ids), frequent=20, rounds=2).collect()}
    alone = {known[0]: got[ids[20 + len(probes) - 1]]}
    # P(w0 w end) / P(end | w) is not needed: P(w | w0) = P(w0 w ...) relative to the end's own step, per class.
    assert all(got[i] < 0 for i in ids) and alone[known[0]] < 0
    step = language._log_transitions(np.arange(language.ALL**2, dtype=float).reshape(language.ALL, -1))
    assert step.sum(1) == pytest.approx(np.ones(language.ALL))


def test_best_class_as_brute_force():
    r = np.random.default_rng(1)
    n, c = 30, language.CLASSES
    pairs = r.integers(0, 4, (n, n)).astype(float)
    classes = r.integers(0, 5, n)

    def counts_of(of):
        m = np.zeros((language.ALL, language.ALL))
        np.add.at(m, (of[:, None], of[None, :]), pairs)
        return m

    def likelihood(of):
        m = counts_of(of)
        x = lambda v: (v * np.log(np.where(v > 0, v, 1))).sum()
        return x(m) - x(m.sum(0)) - x(m.sum(1))

    for w in range(n):
        others = np.arange(n) != w
        right = np.bincount(classes[others], pairs[w, others], language.ALL)
        left = np.bincount(classes[others], pairs[others, w], language.ALL)
        got = best_class(left, right, pairs[w, w], classes[w], counts_of(classes))
        values = []
        for to in range(c):
            moved = classes.copy()
            moved[w] = to
            values.append(likelihood(moved))
        assert values[got] == pytest.approx(max(values))


# Decontamination --------------------------------------------------------------------------------


def smith_waterman(x, y):
    row, best = [0] * (len(y) + 1), 0
    for a in x:
        new = [0]
        for j, b in enumerate(y, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, max(new))
    return best


def test_alignment_as_brute_force():
    r = np.random.default_rng(2)
    items = [r.integers(4, 9, r.integers(1, 12)).astype(np.uint64) << np.uint64(8) for _ in range(60)]
    passages = [r.integers(4, 9, r.integers(1, 25)).astype(np.uint64) << np.uint64(8) for _ in range(60)]
    got, _ = align(items, passages)
    assert got.tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in zip(items, passages, strict=True)]


def test_planted_passages(spark):
    items = [prose(100 + n, 30) for n in range(6)]
    edited = items[1].split()
    for k in (4, 9, 15, 21):
        edited[k] = "other"
    del edited[25]
    texts = [
        prose(1, 300) + " " + items[0].upper() + ". " + prose(2, 100),
        prose(3, 50) + " " + " ".join(edited) + " " + prose(4, 50),
        prose(5, 200) + " " + " ".join(items[2].split()[:8]),
        None,
        "",
        items[3],
        prose(6, 3000),
        items[4] + " and " + items[4] + " " + items[5],
    ]
    rows = [(n, t, 0.1) for n, t in enumerate(items)] + [(50, None, 0.1), (51, "", 0.1), (52, "ab", 0.1), (None, "zzz", 0.1)]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string, score double")
    found = contaminated(documents(spark, texts), benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found}
    assert set(got) == {(0, 0), (1, 1), (5, 3), (7, 4), (7, 5)}
    assert got[0, 0] == got[5, 3] == 1.0 and 0.5 < got[1, 1] < 0.9
    first = next(r for r in found if r["doc_id"] == 0)
    assert (first["start"], first["end"]) == (300, 330)
    assert contaminated(documents(spark).limit(0), benchmark).count() == 0
    assert contaminated(documents(spark, texts), benchmark.limit(0)).count() == 0


def test_copies_with_edits_in_any_number_of_documents(spark):
    items = [prose(300 + n, 40) for n in range(2)]
    edited = [[f"edit{k}" if k % 5 == 4 else w for k, w in enumerate(t.split())] for t in items]
    texts = [prose(400 + n, 10) + " " + " ".join(edited[n >= 9]) for n in range(1009)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(documents(spark, texts), benchmark).collect()}
    assert set(found) == {(n, int(n >= 9)) for n in range(1009)} and min(found.values()) >= 0.7


def test_all_that_aligns_is_found_in_parts_of_any_size(monkeypatch):
    r = np.random.default_rng(1)
    texts = [[" ".join(r.choice(list("abcdefgh"), r.integers(1, n))) for _ in range(40)] for n in (30, 60)]
    items = decontamination._items([{"item_id": k, "text": t} for k, t in enumerate(texts[0])])
    column = pa.array(texts[1])
    words = decontamination.cut(column, lower=True, punctuation=False)
    passages = np.concatenate(list(decontamination._passages(items, words, 0.5)), axis=1)
    expected = set(decontamination._aligned(items, words, passages.T.tolist(), 0.5))
    assert len(expected) > 20
    for places, bits in ((500_000, 8_000_000), (50, 1000), (1, 1)):
        monkeypatch.setattr(decontamination, "_PLACES", places)
        monkeypatch.setattr(decontamination, "_BITS", bits)
        assert set(decontamination._matches(items, column, 0.5)) == expected


def best_local(a, b):
    """Smith-Waterman by the definition: match 2, all else -1."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def edited_copy(r, words, every):
    out = []
    for j, w in enumerate(words):
        out += r.choice(([w, "inserted"], ["replaced"], [])) if j % every == every - 1 else [w]
    return out


def test_contaminated_documents_are_all_that_align(spark):
    """Every document with every item, aligned in full: edits at every second to fifth word, and clean documents."""
    r = random.Random(21)
    items = [prose(600 + k, r.randint(8, 40)).split() for k in range(12)]
    texts = []
    for k in range(60):
        copy = edited_copy(r, items[k % 12], 2 + k % 4)
        texts.append(" ".join([prose(700 + k, r.randint(0, 30)), *copy, prose(800 + k, r.randint(0, 30))]))
    texts.append(" ".join(" ".join((w, f"between{j}")) for j, w in enumerate(items[0])))  # a word after each word
    texts.append(" ".join(w if j % 3 else f"other{j}" for j, w in enumerate(items[1])))  # every third word replaced
    texts += [prose(900 + k, 200) for k in range(10)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = {(x["doc_id"], x["item_id"]): x["score"] for x in contaminated(documents(spark, texts), benchmark).collect()}
    expected = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            score = best_local(item, words(text)) / (2 * len(item))
            if score >= 0.5:
                expected[d, k] = score
    assert len(expected) > 40 and (60, 0) in expected and (61, 1) in expected
    assert found == pytest.approx(expected)


def test_a_benchmark_in_parts(spark, monkeypatch):
    items = [prose(200 + n, 20) for n in range(8)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    monkeypatch.setattr("facetry.llm.decontamination.PART_BYTES", 300)
    docs = documents(spark, [prose(9, 20) + " " + t for t in items])
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()} == {(i, i) for i in range(8)}


# Chats ------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, window int, own boolean"


def conversations(spark):
    r = random.Random(6)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", prose(c, 5 + 40 * (c % 4))))
        for t in range(1, 2 + c * 3):
            rows.append((c, t, "user" if t % 2 else "assistant", prose(100 * c + t, r.choice((3, 40, 150, 700)))))
    rows += [(20, 0, None, "\\ <s>"), (20, 1, "assistant", None), (20, 1, "assistant", "[INST] \\[/INST] </s> <\\s>")]
    rows += [(21, None, "user", ""), (21, 5, "system", "late"), (21, 6, "assistant", "é日\n\\\\"), (None, 0, "assistant", "lost")]
    return rows, spark.createDataFrame([(*row, 1, True) for row in rows], TURNS).repartition(3)


def test_chats_read_back_as_they_were(spark):
    rows, frame = conversations(spark)
    windows = format_windows(frame, budget=256).collect()
    back = {r["conv_id"]: r for r in read_back(format_windows(frame, budget=256)).collect()}
    for c in {row[0] for row in rows}:
        turns = [(row[1], row[2] or "", row[3] or "") for row in rows if row[0] == c]
        turns.sort(key=lambda t: (-1 if t[0] is None else t[0], t[1], t[2]))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [t[1:] for t in turns]
        assert back[c]["loss_text"] == "".join(t[2] for t in turns if t[1] == "assistant")
        assert back[c]["formatted_chars"] == sum(len(w["text"]) for w in windows if w["conv_id"] == c)
    assert len([w for w in windows if w["conv_id"] == 9]) > 3
    for w in windows:
        assert len(w["text"].split("</s>")) == w["n_turns"] + 1 == len(w["repeated"]) + 1
        if w["conv_id"] in (0, 3, 6, 9):  # the system turn leads every window
            assert w["text"].startswith("<s>[INST]system[/INST]")
        assert sum(w["repeated"]) <= 3
    assert format_windows(frame.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    r = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "INST]", "x", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(9)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t")))
    for row in frame.withColumn("u", unescape(F.col("e"))).collect():
        assert row["u"] == row["t"]
        assert not any(c in row["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


# Pipeline ---------------------------------------------------------------------------------------


def pipeline_tables(spark, folder):
    texts = [t for t in odd_texts()] + [prose(n, 150) for n in range(20, 60)]
    texts += ["JUNK!! " + " ".join(w.upper() + "!!" for w in prose(n, 100).split()) for n in range(60, 90)]
    item = prose(500, 25)
    texts += [prose(90, 80) + " " + item + " " + prose(91, 60), texts[30] + " end"]
    junk = range(58, 88)
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i in range(18, 88, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, set(junk)


def test_pipeline_stages_as_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    texts, junk = pipeline_tables(spark, folder)
    own = tokenizer()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "tokens":
            assert {i: (r["ids"], r["decoded"]) for i, r in after.items()} == {
                i: (own.encode_ordinary(t or ""), t or "") for i, t in before.items()
            }
            continue
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality":
            assert not junk & set(after) and set(range(18, 58)) <= set(after)
        if name == "near_duplicates":
            sets, labels = near_components(list(before.items()))
            assert set(after) == {i for i in before if labels[i] == i}
        if name == "repeats":
            rows = [(i, (before[i] or "").encode()) for i in sorted(before)]
            for (i, data), gone in zip(rows, windows_removed(rows, 50), strict=True):
                if not sum(gone):
                    assert after[i]["text"] == before[i]
                elif sum(gone) == len(data):
                    assert i not in after
                else:
                    assert 0 <= len(after[i]["text"].encode()) - (len(data) - sum(gone)) < 8 * len(data)
                    assert after[i]["n_chars"] == len(after[i]["text"])
        if name == "decontamination":
            assert set(before) - set(after) == {88}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(after)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline_tables(spark, str(tmp_path / "full"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / "full" / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    code = (
        "import sys, json\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('facetry.llm', 'corpus_pipeline')): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(json.dumps([k for k in e.queries() if k.startswith('op') or k == 'pipeline'] + [len(e.oracle_sql()) > 100]))\n"
    )
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert json.loads(out.stdout.splitlines()[-1]) == [True]
