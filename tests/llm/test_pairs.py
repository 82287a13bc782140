import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import graph, near_vectors, shingle_join


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_thinned_ties_keep_components(spark):
    rng = random.Random(1)
    ties = [(i, rng.randrange(300)) for i in range(300) for _ in range(rng.choice((0, 1, 1, 3)))]
    edges = [(r["a"], r["b"]) for r in graph.thinned(spark.createDataFrame(ties, "id long, lead long")).collect()]
    assert len(edges) == len(set(edges)) and _components(range(300), edges) == _components(range(300), ties)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((7, i) for i in range(200, 260)), (5, 5), (1, 2), (2, 1), (1, 2), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(path, min(path)), **dict.fromkeys(range(200, 260), 7), 7: 7, 5: 5, 1: 1, 2: 1}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def _near_texts(seed=5):
    """Groups of edited copies around the threshold, copies, passages that many share, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n", "one", "one", "a b c d", "a b c d", "a b c d e", "a  b\nc d e"]
    for size in (20, 60, 200, 600):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts += [" ".join(base)] * 2
            for edits in (1, 2, size // 40 + 1, size // 25 + 1, size // 10):
                changed = list(base)
                for at in rng.sample(range(size), edits):
                    changed[at] = word()
                texts.append(" ".join(changed))
            texts.append(passage + " " + " ".join(word() for _ in range(size)))
    hub = [word() for _ in range(150)]
    for i in range(80):  # one group of near copies that are all different
        texts.append(" ".join([*hub[: 150 - i % 3], word()]))
    return texts


def _expected_links(ids, texts):
    sets = [_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return links


def test_jaccard_classes_equal_brute_force(frame, monkeypatch):
    texts = _near_texts()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(ids)
    texts[-1], ids[-1] = texts[20] + " x", ids[30]  # two texts under one id
    links = _expected_links(ids, texts)
    n = Counter(x for pair in links for x in pair)
    want = _components(ids, [(ids[a], ids[b]) for a, b in links])
    docs = frame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for block in (1500, 20):  # a cluster in one block, and dealt to many pairs of blocks
        monkeypatch.setattr(shingle_join, "BLOCK_DOCS", block)
        got = Counter((r["doc_id"], r["n_links"], r["kept"]) for r in shingle_join.jaccard_classes(docs).collect())
        classes = {r["doc_id"]: r["class_id"] for r in shingle_join.jaccard_classes(docs).where(f"doc_id <> {ids[-1]}").collect()}
        one_text = {i: c for i, c in want.items() if i != ids[-1] and c not in (want[ids[-1]], ids[-1])}
        assert {i: classes[i] for i in one_text} == one_text
        assert Counter((i, k) for i, k, _ in got.elements()) == Counter((i, n[k]) for k, i in enumerate(ids)), block


def test_long_copies_in_more_blocks_than_documents_link_once(frame, monkeypatch):
    """Two or three near copies over several blocks each: some blocks are empty, some hold all of a cluster."""
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 60)
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        texts = []
        for cluster in range(16):
            base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
            for copy in range(2 + cluster % 2):
                texts.append(" ".join([*base[: 119 - copy], f"end{copy}"]))
        ids = list(range(len(texts)))
        n = Counter(x for pair in _expected_links(ids, texts) for x in pair)
        got = shingle_join.jaccard_classes(frame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
        assert {r["doc_id"]: r["n_links"] for r in got.collect()} == {i: n[i] for i in ids}


def test_one_of_each_class_keeps_columns_and_repeated_rows_once(frame):
    texts = _near_texts()[:40]
    rows = list(zip(range(40), texts, strict=True))
    rows += [(0, None), (7, texts[7]), (7, texts[7]), (None, "a b c d e"), (None, "x")]
    docs = frame(rows, "doc_id long, text string")
    want = {i for i, c in _components(range(40), [(a, b) for a, b in _expected_links(range(40), texts)]).items() if i == c}
    out = shingle_join.one_of_each_class(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert set(got) == want | {None} and got[None] == 2 and got[7] == 1
    assert shingle_join.one_of_each_class(docs.limit(0)).count() == 0


def test_a_verdict_belongs_to_the_text_where_an_id_has_several(frame):
    text = lambda c, end="": " ".join(f"{c}{i}" for i in range(60)) + end
    rows = [(3, text("a")), (5, text("a", " x")), (5, text("b")), (8, text("c")), (8, text("c", " x")), (9, text("d")), (9, text("e")), (9, text("e"))]
    got = Counter((r["doc_id"], r["text"].removesuffix(" x")) for r in shingle_join.one_of_each_class(frame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(3, text("a")), (5, text("b")), (8, text("c")), (9, text("d")), (9, text("e"))])


def test_prefixes_are_shortened_where_few_share_them():
    recall, deep = shingle_join.recall, [shingle_join.MAX_DEPTH] * shingle_join.TREES
    assert recall(deep) < shingle_join.TARGET_RECALL <= recall([shingle_join.MIN_DEPTH] * shingle_join.TREES)
    crowded = [[9000, 5000, 4000] if t in (3, 7) else [4 + t, 3, 1] for t in range(shingle_join.TREES)]
    depths = shingle_join.chosen_depths(crowded)
    assert recall(depths) >= shingle_join.TARGET_RECALL and depths[3] == depths[7] == shingle_join.MAX_DEPTH
    assert all(k == shingle_join.MIN_DEPTH for t, k in enumerate(depths) if t not in (3, 7, 14, 15))
    assert shingle_join.chosen_depths(crowded, target=0.9) == deep
    assert shingle_join.chosen_depths([[99, 98, 97]] * shingle_join.TREES, target=1.0) == [shingle_join.MIN_DEPTH] * shingle_join.TREES


def test_shared_elements_and_links_about_a_centre_equal_sets():
    rng = random.Random(8)
    for size, n in ((60, 40), (30, 90), (0, 30)):
        base = list(range(1000, 1000 + size))
        sets = [sorted({x for x in base if rng.random() > 0.1 * (i % 4)} | {rng.randrange(200) for _ in range(i % 9)} | {5 + i % 3}) for i in range(n)]
        arrays = [np.array(s, np.uint64) for s in sets]
        got = np.concatenate(list(shingle_join._shared(arrays, arrays[:17], strip=7)))
        assert got.tolist() == [[len(set(a) & set(b)) for b in sets[:17]] for a in sets]
        for centre in (shingle_join.majority(arrays), np.array(sets[1], np.uint64), np.zeros(0, np.uint64)):
            for min_jaccard, p, q in ((0.8, 4, 5), (0.5, 1, 2), (0.7, 7, 10)):
                apart, lacks, more = shingle_join._differences(arrays, centre)
                cost = shingle_join._cost(lacks, more, min_jaccard)
                found = np.concatenate([m for _, m in shingle_join._linked((apart, cost), (apart, cost), len(centre), min_jaccard)])
                assert found.tolist() == [[q * len(set(a) & set(b)) >= p * len(set(a) | set(b)) for b in sets] for a in sets]
                core = 2 * cost <= (q - p) * len(centre)
                assert found[np.ix_(core, core)].all()


def _copies_of_one(n, seed=2, every=5):
    """Texts that are all different and a word or two from one text."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(140)]
    out = []
    for i in range(n):
        words = list(base)
        words[rng.randrange(140)] = f"x{i}"
        if i % every == 0:
            words[rng.randrange(140)] = f"y{i}"
        out.append(" ".join(words))
    return out


def test_rows_of_one_group_grow_in_proportion(frame, monkeypatch):
    """A group of different near copies: what is stored and what is dealt to tasks is linear in it, if nearly all are near its centre."""
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", 100)
    counted = {}
    for n in (400, 1600):
        sizes = Counter()

        def spy(df, what, compression="snappy", sizes=sizes, real=shingle_join.materialise):
            stored = real(df, what, compression)
            sizes[what] += stored.count()
            return stored

        verified = []
        with monkeypatch.context() as m:
            m.setattr(shingle_join, "materialise", spy)
            m.setattr(shingle_join, "thinned", lambda ties, real=shingle_join.thinned: (verified.append(real(ties).count()), real(ties))[1])
            m.setattr(shingle_join, "discard", lambda *x: None)
            got = shingle_join.jaccard_classes(frame(list(enumerate(_copies_of_one(n, every=n))), "doc_id long, text string")).collect()
        assert {r["class_id"] for r in got} == {0}
        counted[n] = dict(sizes, ties_thinned=verified[0], links_thinned=verified[1])
    for what, rows in counted[1600].items():
        assert rows <= 6 * max(counted[400][what], 16), (what, counted)


def test_links_within_a_large_group_are_exact(frame, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", 60)
    monkeypatch.setattr(shingle_join, "NODE_MEMBERS", 50)
    texts = _copies_of_one(250) + [" ".join([*t.split()[: 120 + i % 20], *(f"z{i}{j}" for j in range(i % 30))]) for i, t in enumerate(_copies_of_one(120, 5))]
    ids = list(range(len(texts)))
    links = _expected_links(ids, texts)
    n = Counter(x for pair in links for x in pair)
    want = _components(ids, links)
    got = shingle_join.jaccard_classes(frame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == {i: (n[i], want[i]) for i in ids}


# lists of both levels; these in blocks and divided; one list a label, divided over two levels and more
@pytest.mark.parametrize(("list_size", "block", "cells"), [(12, 4096, 0), (12, 30, 1), (10**6, 8, 65)])
def test_near_vectors_equal_brute_force(frame, monkeypatch, list_size, block, cells):
    monkeypatch.setattr(near_vectors, "LIST_SIZE", list_size)
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    divided, seen = near_vectors._divided, []

    def watched(*args):
        out = divided(*args)
        seen.append(out.agg({"cell": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(near_vectors, "_divided", watched)
    rng = np.random.default_rng(2)
    rows, vec_id = [], 0

    def add(vector, label):
        nonlocal vec_id
        vec_id += 1
        rows.append((5000 - vec_id, None if vector is None else [None if v is None else float(np.float32(v)) for v in vector], label))

    for label in (0, 1, 2):
        centres = rng.normal(size=(12, 16))
        for c in centres:
            for noise in (0.0, 0.0, 0.02, 0.05, 0.05, 0.09, 0.1, 0.2, 0.6):
                add((c + noise * rng.normal(size=16)) * rng.uniform(0.5, 3), label)
        for _ in range(300):
            add(rng.normal(size=16), label)
    hub = rng.normal(size=16)
    for _ in range(150):
        add(hub + 0.03 * rng.normal(size=16), 1)
    for _ in range(40):
        add(hub, 2)
    for odd in (None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]):
        add(odd, 1)
    add(hub, None)
    for size in (1e-200, 1e-160, 1e160, 1e300):  # squares of these aren't doubles
        rows.append((4100 + len(rows), [float(v * size) for v in hub], 2))
    add([2.0, 4.0], 1)
    rows.append((4000, rows[0][1], 0))  # an id that is given twice
    x = {k: np.array(r[1], float) for k, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}
    x = {k: v / np.abs(v).max() for k, v in x.items()}
    links = [(a, b) for a in x for b in x if b < a and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= 0.98]
    n = Counter(k for pair in links for k in pair)
    component = _components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    want = Counter((r[0], n[k], component[r[0]], component[r[0]] == r[0]) for k, r in enumerate(rows))
    got = near_vectors.near_vectors(frame(rows, "vec_id long, embedding array<double>, label int"))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == want
    assert sum(n.values()) > 10_000 and len(set(component.values())) > 500
    assert seen[0] >= cells and (cells or not seen[0])
    assert near_vectors.near_vectors(frame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_groups_are_found_whatever_the_partitions(frame):
    rows = [(i, t) for i, t in enumerate(_near_texts(9))]
    seen = defaultdict(set)
    for parts in (1, 7):
        for r in shingle_join.jaccard_classes(frame(rows, "doc_id long, text string", parts)).collect():
            seen[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert all(len(v) == 1 for v in seen.values())
