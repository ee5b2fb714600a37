"""Small tables with every odd kind of row, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, chunk string, rep string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(1, 8))) for _ in range(n))


def odd_texts():
    """Texts with nulls, empties, ties, copies, near copies, shared passages and a very long one."""
    base, passage = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[40] = "changed"
    return [
        base,
        None,
        "",
        "   \t\n ",
        base,
        base.upper(),
        " ".join(edited),
        "one two",
        "one  two",
        prose(3, 30) + "\n" + passage + "\n" + prose(4, 30),
        passage,
        prose(5, 80) + " " + passage,
        prose(6, 9000),
        "é" * 60 + " ñandú 日本語 " + passage[:200],
        "x" * 300,
        "-" * 400 + " " + "ab" * 200,
        "\x00 null \x00",
        base,
    ]


def documents(spark, texts=None, ids=None):
    texts = odd_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), 0.5, "c", "r") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def windows_removed(docs, width):
    """docs: (id, sequence). Which places of each sequence a window covers that an earlier document has."""
    first = {}
    for i, s in docs:
        for j in range(len(s) - width + 1):
            key = tuple(s[j : j + width]) if isinstance(s, list) else s[j : j + width]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, s in docs:
        gone = bytearray(len(s))
        for j in range(len(s) - width + 1):
            key = tuple(s[j : j + width]) if isinstance(s, list) else s[j : j + width]
            if first[key] < i:
                gone[j : j + width] = b"\1" * width
        out.append(gone)
    return out


def shingle_set(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}


def components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, components(sets, links)


def fold_of(doc_id, folds=5):
    return zlib.crc32(str(doc_id).encode()) % folds
