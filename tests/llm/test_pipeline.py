"""The pipeline's stages against brute force, on the smallest tables and on odd rows."""

import math
import os
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from vellum.llm import mixing

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, None), (None, docs.first()["text"], "en", "src1", 5), (9003, "short text", "xx", "src2", 10)]
    x = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(3))
    out = [x]
    for name, stage in corpus_pipeline.STAGES:
        x = corpus_pipeline.materialise(stage(spark, x, SF_DIR), name)
        out.append(x)
    return [f.collect() for f in out], [f.columns for f in out]


def test_columns_stay_until_the_last_stage(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[:5]) and len(corpus_pipeline.STAGES) == 5
    assert all(len(r) > 0 for r in rows)


def test_quality_drops_what_the_rules_reject(stages):
    from tests.llm.test_tokens import _brute, _fertile

    before, after = stages[0][0], stages[0][1]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter(r for r in before if not _brute(r["text"], r["lang"])[-1] and _fertile(model, r["text"], r["lang"])[-1])
    assert want == Counter(after)


def test_lines_drop_site_boilerplate(stages):
    before, after = stages[0][1], stages[0][2]
    pages = defaultdict(list)
    for r in before:
        pages[r["source"]].append(r["text"])
    frequent = defaultdict(set)
    for site, texts in pages.items():
        n = Counter(line for t in texts for line in {x.strip(" \t\r\x0b\x0c") for x in t.split("\n")} if line)
        frequent[site] = {line for line, k in n.items() if k >= 3 and k > 0.05 * len(texts)}
    want = Counter((r["doc_id"], "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\r\x0b\x0c") not in frequent[r["source"]])) for r in before)
    assert Counter((r["doc_id"], r["text"]) for r in after) == want and all(r["n_chars"] == len(r["text"]) for r in after)


def test_one_of_each_group_stays(stages):
    before, after = stages[0][2], stages[0][3]
    rows = [r for r in before if r["doc_id"] is not None]
    sets = [_shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda k: (rows[k]["doc_id"], k))
                parent[y] = x
    want = {rows[find(i)]["doc_id"] for i in range(len(rows))}
    kept = [r["doc_id"] for r in after if r["doc_id"] is not None]
    assert set(kept) == want and len(kept) == len(want)


def test_mixture_reads_each_source_to_its_weight(stages):
    before, after = stages[0][3], stages[0][4]
    n = Counter()
    for r in before:
        n[r["source"]] += len((r["text"] or "").split())
    budget = sum(n.values())
    least = mixing.ENTROPY_SHARE * math.log(sum(v > 0 for v in n.values()))
    x = 1.0

    def weights_at(x):
        p = {k: (v / budget) ** x for k, v in n.items() if v}
        return {k: v / sum(p.values()) for k, v in p.items()}

    while -sum(w * math.log(w) for w in weights_at(x).values()) < least:
        x -= 1e-4
    weights = weights_at(x)
    read, longest = Counter(), Counter()
    for r in after:
        read[r["source"]] += len((r["text"] or "").split())
        longest[r["source"]] = max(longest[r["source"]], len((r["text"] or "").split()))
    assert set(after) <= set(before)
    assert all(abs(read[s] - budget * w) <= longest[s] + 1 for s, w in weights.items())


def test_packing_holds_every_token_once(stages):
    before, after = stages[0][4], stages[0][5]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        cut = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(cut, len(ids) + 1, 1024)]
        want.update((r["doc_id"], k, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in after) == want
    bins = defaultdict(list)
    for r in after:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_everything_is_registered():
    names = set(entry_point.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
