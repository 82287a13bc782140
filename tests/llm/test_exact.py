"""Chunk recipes, the filter audit and vector codes against plain versions of each."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import filter_audit, recipes, vector_codes

LOWER = str.maketrans(recipes._UPPER, recipes._LOWER)


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijÄß語") for _ in range(rng.randint(1, 8))) for _ in range(n))


def _texts():
    """Copies, copies that differ in case or in one byte, shared passages, repeated bytes, odd ones."""
    rng = random.Random(4)
    shared = _prose(rng, 1500)
    out = [None, "", "", " ", "A", "a", "Ä", "ä", "x" * 30_000, "X" * 30_000, "x" * 30_001, "\x00\x00", "\x00"]
    for i in range(12):
        own = _prose(rng, 200 + 150 * i)
        out += [own, own, own.upper(), own.title(), own + " ", own[:-1] + "_", own + shared, shared + own, own + shared]
    return out


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, keep, len(ids), i == keep, sha) for i in ids)
        for extra in range(ids.count(keep) - 1):  # of repeated rows one stays
            out[(keep, keep, len(ids), True, sha)] -= 1
            out[(keep, keep, len(ids), False, sha)] += 1
    return +out


@pytest.mark.parametrize("kinds", [None, 7])
def test_exact_classes_equal_brute_force(frame, monkeypatch, kinds):
    """With seven fingerprints almost all chunks share theirs with others."""
    if kinds:
        monkeypatch.setattr(recipes, "_fingerprint", lambda chunk: F.pmod(F.xxhash64(chunk), F.lit(kinds)))
    texts = _texts()
    ids = random.Random(9).sample(range(10_000), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, "none"), (None, "none"), (None, texts[-1]), (ids[0], None), (ids[20], texts[20])]
    got = recipes.exact_classes(frame(rows, "doc_id long, text string")).drop("n_chunks")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == _expected(rows)
    assert recipes.exact_classes(frame([], "doc_id long, text string")).count() == 0


def test_chunks_follow_the_bytes():
    rng = random.Random(2)
    data = _prose(rng, 40_000).encode()
    ends = recipes.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= recipes.LEAST and sizes.max() <= recipes.MOST and 700 < sizes.mean() < 1800
    # what stands before moves only the first chunks, also across the borders of the steps
    moved = recipes.chunk_ends(b"another beginning" * 40 + data)
    cut = {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    other = b"another beginning" * 40 + data
    same = sum(b - a for a, b in zip([0, *moved], moved, strict=False) if other[a:b] in cut)
    assert same > 0.95 * len(data)
    long = data * (3_000_000 // len(data) + 1)
    assert recipes.chunk_ends(long)[: len(ends) - 2] == ends[: len(ends) - 2]
    assert recipes.chunk_ends(b"") == [] and recipes.chunk_ends(b"a") == [1]
    assert set(np.diff([0, *recipes.chunk_ends(b"z" * 100_000)])) <= {recipes.MOST, recipes.LEAST, 100_000 % recipes.MOST}


def test_long_texts_have_recipes(spark):
    long = _prose(random.Random(1), 2_000_000)
    assert len(long) > 10_000_000
    got = {r["doc_id"]: r for r in recipes.exact_classes(spark.createDataFrame([(1, long), (2, long + "."), (3, long.upper().replace("SS", "ß"))], "doc_id long, text string")).collect()}
    assert got[1]["group_size"] == got[3]["group_size"] == 2 and got[1]["keep_id"] == 3 and got[2]["kept"] and got[1]["n_chunks"] > 5000


def _failing(text, smaller):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": smaller}
    return {f for f, fails in tests.items() if fails}


def test_filter_audit_equals_replay_by_hand(frame):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "Ab", "語" * 300]
    for _ in range(60):
        words = [rng.choice(["ab", "cd", "Ef", "語", "x#", "gh", *map(str, range(rng.choice((5, 400))))]) for _ in range(rng.choice((3, 199, 200, 201, 500)))]
        texts.append(rng.choice((" ", "\x0b", " \r\n")).join(words) + rng.choice(("", " A|", " ")))
    rows = [(i, rng.choice(texts), rng.choice((None, "", "s1", "s2"))) for i in range(150)]
    rows += [rows[3], (None, rows[5][1], "s1"), (None, rows[5][1], None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    want = defaultdict(Counter)
    for doc_id, text, source in rows:
        text = text or ""
        smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        failing = _failing(text, smaller)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c, here = want[source or "", order, step], not gone and f in failing
                c["removed"] += here
                c["redundant"] += gone and f in failing
                c["unique_fails"] += failing == {f}
                c["good_lost"] += here and doc_id in good
                c["toxic_lost"] += here and doc_id in toxic
                gone = gone or here
                c["kept"] += not gone
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    shapley = Counter()
    for (part, order, step), c in want.items():
        shapley[part, order[step - 1]] += c["removed"]
    got = filter_audit.filter_audit(frame(rows, "doc_id long, text string, source string"), frame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 3 * 600 == len(want)
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert [r[n] for n in names] == [want[key][n] for n in names] and r["shapley"] == shapley[key[0], key[1][key[2] - 1]]
    assert filter_audit.filter_audit(frame([], "doc_id long, text string, source string"), frame(labels, "doc_id long, quality int, toxic int")).count() == 0


def _codes_by_hand(vectors, entries, rounds, parts=4):
    whole = [[[int(np.floor(x * 1024)) for x in v][p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for v in vectors]
    books = [[w[p] for w in whole[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((distance(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for w in whole:
                members[nearest(w[p], book)[1]].append(w[p])
            for i, mine in members.items():
                book[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(w[p], books[p]) for p in range(parts)] for w in whole]
    return [[i for _, i in f] for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize(("kind", "entries"), [("normal", 9), ("ties", 6), ("large", 5), ("few", 40)])
def test_codes_equal_brute_force(spark, frame, kind, entries):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(300, 8)), "ties": rng.integers(-1, 2, (200, 8)) / 1024, "large": rng.normal(size=(80, 8)) * 60_000, "few": rng.normal(size=(12, 8))}[kind]
    vectors = [[float(c) for c in v] for v in x]
    vectors[5], vectors[7] = vectors[2], vectors[2]  # equal entries in the first codebooks
    rows = [(i * 3, v, 1) for i, v in enumerate(vectors)]
    odd = [(1, None, 1), (4, [*vectors[0][:7], None], 1), (7, [*vectors[0][:7], float("nan")], 1), (10, [*vectors[0][:7], float("inf")], None), (2, [], 1), (8, vectors[0][:4], 1)]
    shuffled = rows + odd
    random.Random(2).shuffle(shuffled)
    fitted = vector_codes.fit_codes(frame([(i, v, lab) for i, v, lab in shuffled], "vec_id long, vector array<double>, label int"), entries=entries)
    codes, errors, books = _codes_by_hand(vectors, entries, 4)
    got = {r["vec_id"]: (list(np.frombuffer(r["codes"], "<u2")), r["error"]) for r in fitted.rows.collect()}
    assert got == {i * 3: (c, e) for i, (c, e) in enumerate(zip(codes, errors, strict=True))}
    assert [b.tolist() for b in fitted.books] == books
    assert fitted.sha256() == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_exponion_looks_at_few_entries():
    """From the entry of the round before, most rows need a few distances of the 256."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(40, 4)) * 1024).astype(np.int64)[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 4))
    lists = vector_codes.Neighbours(x[:256])
    best, least, looked = lists.nearest(x, np.zeros(len(x), np.int64))
    full = vector_codes._squares(x, x[:256])
    assert (best == full.argmin(1)).all() and (least == full.min(1)).all()
    again, _, fewer = lists.nearest(x, best)
    assert (again == best).all() and fewer < 0.3 * full.size and fewer < looked


def test_no_vectors_and_too_large_ones(spark):
    none = vector_codes.fit_codes(spark.createDataFrame([(1, None)], "vec_id long, vector array<float>"))
    assert none.rows.count() == 0 and none.books == []
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.fit_codes(spark.createDataFrame([(1, [1e30] * 8)], "vec_id long, vector array<double>"))
