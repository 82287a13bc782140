import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import boilerplate, lm_score, mixing, ppm, toxicity


def test_probabilities_of_all_symbols_add_up_to_one():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    for order in (1, 3, 5):
        values, n = ppm.counted(np.concatenate([ppm.grams(t, order) for t in texts]))
        for context in (b"ab abc", b"aaaaaa", b"zzzzzz", b"\xfe" * 6, b"bc zab"):
            base = int.from_bytes(context[-order:], "big") << 8
            asked = np.array([base | s for s in range(256) if s != ppm.START], np.uint64)
            v, c = ppm.counted(np.concatenate([values, asked]), np.concatenate([n, np.zeros(len(asked), np.int64)]))
            p = 10 ** ppm.log10_probabilities(v, c, order, {})[np.searchsorted(v, asked)]
            assert abs(p.sum() - 1) < 1e-9


def _ppm_by_hand(train, text, order):
    """The method as it is described, one symbol at a time, over dictionaries."""
    tries = [Counter() for _ in range(order + 1)]
    for t in train:
        s = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(s)):
            for k in range(order + 1):
                tries[k][(s[i - k : i], s[i])] += 1
    total, s = 0.0, bytes([ppm.START]) * order + text + bytes([ppm.END])
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = {y: n for (c, y), n in tries[k].items() if c == s[i - k : i] and y not in excluded}
            mass = 2 * sum(seen.values())
            if s[i] in seen:
                total += math.log10((2 * seen[s[i]] - 1) / mass)
                break
            if seen:
                total += math.log10(len(seen) / mass)
            excluded |= seen.keys()
        else:
            total -= math.log10(ppm.ALPHABET - len(excluded))
    return total


@pytest.mark.parametrize("shard", [300_000, 60, 3])
def test_scores_equal_the_method_by_hand(frame, monkeypatch, shard):
    """Also where contexts have to be told by three, four and five bytes to have few enough grams."""
    monkeypatch.setattr(lm_score, "SHARD_GRAMS", shard)
    rng = random.Random(4)
    texts = [None, "", "  ", "Ab aB", "éa　b", "ab " * 50, *[" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))) for _ in range(30)]]
    rows = [(i, t, i % 4 == 1 if i % 5 else None) for i, t in enumerate(texts)] + [(3, "Ab aB", False), (None, "ba", True)]
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 300)
    got = lm_score.language_scores(frame(rows, "doc_id long, text string, held_out boolean")).collect()
    train = [lm_score.tokens(t) for _, t, held in rows if not held]
    count = Counter(w for t in train for w in t)
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    want = Counter()
    for i, t, held in rows:
        words = lm_score.tokens(t)
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words) + math.log10((len(train) + 1) / (total + kinds + 1))
        score = _ppm_by_hand([b" ".join(x) for x in train], b" ".join(words), lm_score.ORDER)
        want[(i, bool(held), len(words) + 1, sum(count[w] > 0 for w in words) + 1, total, round(base, 6), round(score, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_scores_without_anything_to_learn_from(frame):
    schema = "doc_id long, text string, held_out boolean"
    assert lm_score.language_scores(frame([], schema)).count() == 0
    r = lm_score.language_scores(frame([(1, "ab", True)], schema)).first()
    assert r["n_known"] == 0 and abs(r["score"] + 3 * math.log10(255)) < 1e-9


def test_rows_of_a_block_come_in_batches(frame, capsys):
    """A cogroup would hold a block's texts and values as one piece in the JVM and again in the worker."""
    lm_score.language_scores(frame([(1, "ab", False)], "doc_id long, text string, held_out boolean")).explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan


def test_counts_of_a_block_take_little_memory():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(4000)) for _ in range(1500)]
    batches = [pa.RecordBatch.from_pydict({"held_out": [i % 7 == 2 for i in range(500)], "text": texts[k : k + 500]}) for k in (0, 500, 1000)]
    tracemalloc.start()
    n_keys, total = 0, 0
    for out in lm_score._count_block((pa.scalar(0),), iter(batches)):
        n_keys, total = n_keys + len(out), total + sum(n for n, kind in zip(out["n"].to_numpy(), out["kind"].to_numpy(), strict=True) if kind == 0)
        del out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(len(" ".join(t.split())) + 1 for i, t in enumerate(texts) if i % 500 % 7 != 2)
    assert n_keys > 2_000_000 and peak < 45 * n_keys


def test_site_lines(frame):
    menu, blank = "Home | About", " \t"
    rows = [(i, "a", f"{menu}\nstory {i}\n\n  {menu}\t\n{blank}") for i in range(10)] + [(20 + i, "b", f"only {i % 2}\n{menu}") for i in range(2)]
    rows += [(40, "a", None), (41, "a", ""), (42, None, f"{menu}\nx"), (43, "a", menu), (44, "a", menu), (45, "a", menu), (None, "a", f"{menu}\nkeep")]
    rows += [(50 + i, "c", "mirrored page\nwith lines") for i in range(30)] + [(100 + i, "c", f"own {i}") for i in range(400)]  # lines of 30 of 430 pages
    rows += [(600 + i, "e", f"in 21 of 420\nx {i}" if i < 21 else f"x {i}") for i in range(420)]  # just at the ratio, so not above it
    rows += [(90, "d", "same"), (90, "d", "same")]
    out = boilerplate.without_boilerplate(frame(rows, "doc_id long, source string, text string"), F.col("source"), counts=True)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    want = Counter()
    for i, site, text in rows:
        lines = (text or "").split("\n")
        bare = [x.strip(" \t") for x in lines]
        drop = [(site == "a" and b == menu) or (site == "c" and b in ("mirrored page", "with lines")) for b in bare]
        clean = None if text is None else "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
        want[(i, clean, sum(b != "" for b in bare), sum(drop))] += 1
    assert got == want
    assert boilerplate.without_boilerplate(frame([], "doc_id long, source string, text string"), F.col("source")).count() == 0


def test_hosts(spark):
    urls = ["http://A.example.com:80/x?y", "https://u:p@b.org", "ftp://[::1]:9/", "no host", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(boilerplate.host_of(F.col("u"))).collect()]
    assert got == ["a.example.com", "b.org", "[::1]", "", None]


def test_sites_are_hosts_where_there_are_urls(spark):
    rows = [(1, "http://a.org/x", "src1"), (2, None, "src1"), (3, "no host", "src2"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, source string")
    assert [r[0] for r in docs.select(boilerplate.site_of(docs)).collect()] == ["a.org", "src1", "src2", None]
    assert [r[0] for r in docs.drop("url").select(boilerplate.site_of(docs.drop("url"))).collect()] == ["src1", "src1", "src2", None]


def test_counts_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a", "x\ny", 7, 8)], "doc_id long, source string, text string, n_lines long, n_dropped long")
    out = boilerplate.without_boilerplate(docs, F.col("source"), counts=True)
    assert out.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"] and tuple(out.first())[3:] == (2, 0)


def _temperature(tokens, budget_share, entropy_share, max_repeats):
    """By plain search over [0, 1]: the exponent, weights and repeats."""
    n = {k: v for k, v in tokens.items() if v}
    total = sum(n.values())

    def weights(x):
        p = {k: (v / total) ** x for k, v in n.items()}
        return {k: v / sum(p.values()) for k, v in p.items()}

    def search(good, want_low):
        low, high = 0.0, 1.0
        for _ in range(30):
            middle = (low + high) / 2
            low, high = (middle, high) if good(middle) else (low, middle)
        return low if want_low else high

    enough = lambda x: -sum(w * math.log(w) for w in weights(x).values()) >= entropy_share * math.log(len(n)) - 1e-12
    exceeds = lambda x: max(w * budget_share * total / n[k] for k, w in weights(x).items()) > max_repeats
    x = 0.0 if entropy_share is None else 1.0 if enough(1.0) else search(enough, True)
    if max_repeats is not None and exceeds(x):
        x = 1.0 if exceeds(1.0) else search(exceeds, False)
    return x, weights(x)


def test_temperature_meets_entropy_and_limit(spark):
    tokens = {"a": 1_000_000, "b": 30_000, "c": 500, None: 20, "none": 0}
    table = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    x, weights = _temperature(tokens, 1.0, 0.8, None)
    assert abs(entropy(weights) - 0.8 * math.log(4)) < 1e-6 and 0 < x < 1
    assert abs(mixing.temperature(table, 1.0, 0.8, None) - x) < 1e-8
    limited, weights = _temperature(tokens, 1.0, 0.8, 3.0)
    repeats = [weights[k] * 1_030_520 / v for k, v in tokens.items() if v]
    assert limited > x and 2.99 < max(repeats) <= 3.0 and abs(mixing.temperature(table, 1.0, 0.8, 3.0) - limited) < 1e-8
    assert mixing.temperature(table, 1.0, 0.05, None) == 1.0 and mixing.temperature(table, 1.0, None, None) == 0.0
    assert mixing.temperature(table, 5.0, None, 3.0) == 1.0 and mixing.temperature(table.limit(0)) == 1.0


def test_mixture_is_read_in_whole_epochs(spark, frame):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(1000, None, "a b c"), (1001, "hot", None), (5, rows[5][1], rows[5][2]), (None, "hot", "x y")]
    docs = frame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(3) for c in ("there", "part", "epochs", "blocks", "place")})
    got = mixing.realise(mixing.counted(docs), 1.5, 0.9, 3.0).collect()
    n = Counter()
    for _, source, text in rows:
        n[source] += len((text or "").split())
    exponent, weights = _temperature(n, 1.5, 0.9, 3.0)
    assert 0 < exponent < 1 and {r["exponent"] for r in got} == {round(exponent, 6)}
    for source in n:
        part = int(1.5 * sum(n.values()) * weights.get(source, 0))
        mine = sorted((r["place"], r["n_tokens"], r["epoch"], r["doc_id"] or -1) for r in got if r["source"] == source and r["n_tokens"])
        at = 0
        for place, size, _, _ in mine:
            assert place == at < part
            at += size
        assert at >= part and {r["repeats"] for r in got if r["source"] == source} == {round(part / n[source], 6)}
        there = Counter((i or -1) if i is not None else -1 for i, s, t in rows if s == source and (t or "").split())
        for epoch in range(max(e for _, _, e, _ in mine)):
            assert Counter(d for _, _, e, d in mine if e == epoch) == there
    assert max(r["epoch"] for r in got) >= 1
    assert sum(r["n_tokens"] == 0 for r in got) == sum(not (t or "").split() for _, _, t in rows)
    mixed = mixing.mixed(docs, 1.5, 0.9, 3.0)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in got}
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_query_bisects_and_repeats(spark, sf_dir):
    r = mixing.op5_temperature(spark, sf_dir).agg(F.min("exponent").alias("x"), F.max("epoch").alias("e"), F.max("repeats").alias("most")).first()
    assert 0 < r["x"] < 1 and r["e"] >= 1 and r["most"] > 1.2


def _loss(bags, bias, w, l1, l2):
    """The negative log likelihood of document labels under the noisy-or of their sentences, each class weighing half, with the penalties."""
    total = l1 * sum(map(abs, w)) + 0.5 * l2 * sum(x * x for x in w)
    for label, n, held in bags:
        clean = 1.0
        for words in [*held, *([[]] * (n - len(held)))]:
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(w[i] for i in words))))
        share = 0.5 / sum(b[0] == label for b in bags)
        total -= share * math.log(max(1 - clean if label else clean, 1e-300))
    return total


def test_fit_is_a_minimum_of_the_loss():
    rng = random.Random(5)
    bags = []
    for i in range(60):
        n = rng.randint(1, 6)
        held = [[rng.randrange(4) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, n))]
        label = int(any(0 in words for words in held)) if rng.random() < 0.9 else i % 2
        bags.append((label, n, held))
    l1, l2 = 1e-4, 5e-5
    bias, w = toxicity.fit_noisy_or(bags, 4, rounds=3000, rate=0.02, l1=l1, l2=l2)
    found = _loss(bags, bias, w, l1, l2)
    assert found < _loss(bags, -1.0, [0.0] * 4, l1, l2) - 0.1 and w[0] == max(w)
    for _ in range(200):
        step = [rng.gauss(0, 0.05) for _ in range(5)]
        assert found <= _loss(bags, bias + step[0], [x + d for x, d in zip(w, step[1:], strict=True)], l1, l2) + 2e-3


def test_a_score_is_the_noisy_or_of_sentences():
    model = toxicity.NoisyOr(-3.0, {"vile": 4.0, "vil*": 0.5, "nice": -1.0})
    memory = toxicity._Weights(model.weights)
    p = lambda z: 1 / (1 + math.exp(-z))
    text = "You are VILE. Nice vilest day! ...\nplain"
    want = 1 - (1 - p(-3 + 4.5)) * (1 - p(-3 - 1 + 0.5)) * (1 - p(-3))
    assert abs(model.score(text, memory) - want) < 1e-12 and model.score(None, memory) == model.score("?!", memory) == 0
    spans = model.locate(text, memory)
    assert [(s["start"], s["end"]) for s in spans] == [(0, 13)] and abs(spans[0]["score"] - p(1.5)) < 1e-12
    assert model.score("vile. " * 500_000, memory) > 0.999  # three million characters


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxic_sentences_are_learned_from_document_labels(spark, frame):
    rng = random.Random(6)
    bad = ["vilefoo", "vilebar", "vilebaz", "rotten"]
    plain = ["".join(rng.choice("aeioustnr") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choices(plain, k=rng.randint(4, 9))).capitalize() + rng.choice([".", "!", "\n"])
    rows, labels, faults = [], [], {}
    for i in range(900):
        parts = [sentence() for _ in range(rng.randint(1, 25))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] = f"You {rng.choice(bad)} {rng.choice(plain)}."
            faults[i] = parts[at]
        rows.append((i, "".join(parts)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "..."), (2002, "..."), (None, "rotten")]
    labels += [(3, None), (None, 1), (5000, 1), (6, 0)]
    docs = frame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("old"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.remainder("doc_id", 3) != 1)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    score = {i: r["toxicity"]["score"] for i, r in got.items()}
    assert all(0 <= s <= 1 for s in score.values()) and score[2000] == score[2001] == score[2002] == 0
    held = [i for i in range(900) if _held_out(i)]
    tests = [i for i in faults if _held_out(i)]
    assert len(tests) > 30 and sum(score[i] >= 0.7 for i in tests) > 0.95 * len(tests)
    assert sum(score[i] >= 0.7 for i in held if i not in faults) <= 0.01 * len(held)
    found = {r["doc_id"]: r["sentence"] for r in toxicity.offending_sentences(docs, model).collect()}
    assert sum(found.get(i, "").strip() == faults[i].strip() for i in tests) > 0.9 * len(tests)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    nobody = toxicity.train(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert all(r["toxicity"]["score"] < 0.01 for r in toxicity.scored(docs, nobody).collect())


def test_the_query_finds_held_out_toxic_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op1_noisy_or(spark, sf_dir).join(labels, "doc_id").where("held_out").select("doc_id", "predicted", "toxic").collect()
    assert all(_held_out(r["doc_id"]) for r in rows)
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]  # some labels are noise
    assert len(toxic) > 30 and sum(r["predicted"] for r in toxic) > 0.9 * len(toxic) and sum(r["predicted"] for r in clean) < 0.01 * len(clean)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None)]])
def test_nothing_to_learn_from_finds_nothing(spark, frame, labels):
    docs = frame([(1, "some text."), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert all(r["toxicity"]["score"] < 0.01 for r in toxicity.scored(docs, model).collect())


def test_lines_of_a_page_cost_in_proportion(spark):
    """Eight times the lines take far less than the 64 times that a search for each line would."""

    def seconds(n):
        lines = [f"line {i} of the page" for i in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(lines), "s"), (2, "\n".join([*lines[:-40], "the end."]), "s")], "doc_id long, text string, source string")
        began = time.perf_counter()
        out = {r["doc_id"]: r for r in boilerplate.without_boilerplate(docs, F.col("source"), min_pages=2, counts=True).collect()}
        assert out[1]["text"].count("\n") == 39 and out[2]["text"] == "the end." and out[2]["n_dropped"] == n - 40
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 24 * seconds(10_000)


def test_rows_without_id_keep_their_own_lines(frame):
    """Rows that share an id, or have none, lose the lines of their own text, also of equal texts."""
    rows = [(None, "s", "menu\na"), (None, "s", "b\nmenu\nmenu"), (None, "s", "b\nmenu\nmenu"), (7, "s", "menu"), (7, "s", "x\n\nmenu\ny")]
    rows += [(i, "s", f"own {i}") for i in range(60)]
    out = boilerplate.without_boilerplate(frame(rows, "doc_id long, source string, text string"), F.col("source"), counts=True)
    got = sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect() if not r["text"].startswith("own"))
    assert got == sorted([("a", 2, 1), ("b", 3, 2), ("b", 3, 2), ("", 1, 1), ("x\n\ny", 3, 1)])


def test_unusable_documents_take_no_place_in_the_sample(spark, monkeypatch):
    """Long and missing texts are passed over before the sample is limited, and the sample is limited in characters too."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    monkeypatch.setattr(toxicity, "LEARNED_CHARS", 400)
    rows = [(i, None if i % 3 == 0 else "x " * 300 if i % 3 == 1 else ("you vile worm. fine day." if i % 2 else "a fine day. all good.")) for i in range(600)]
    labels = [(i, int(i % 2)) for i in range(600)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, told, F.lit(True))
    scores = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.scored(docs.where("doc_id in (5, 2)"), model).collect()}
    assert scores[5] > 0.7 > 0.3 > scores[2]
    monkeypatch.setattr(toxicity, "CLASS_CHARS", 10)
    assert toxicity.train(docs, told, F.lit(True)).weights == {}
