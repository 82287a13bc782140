"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Each text becomes its set of five-word shingles (64-bit hashes) and a signature of TREES x
   MAX_DEPTH minima. Texts with equal sets are one class; only the class goes on.
2. In each tree a class stands at the leaf that its part of the signature spells. Classes that
   share no prefix of MIN_DEPTH minima with another are alone in that tree. For the others the
   sizes of their nodes at all depths are counted. A class first asks for its full prefixes, and
   shortens them, where the shorter prefix is shared by the fewest first, until a text at the
   threshold would be met with the target recall. So crowded nodes are left deep, and sparse
   ones are searched in full.
3. A node that a class asks for ties its members: those whose signatures agree well enough with
   its first member to that one, the others to whom they agree with. What hangs together by such
   ties is a cluster, found by connected components.
4. Clusters are verified exactly, in tasks that hold the shingle sets; pairs are never rows.
   Sets are held against a centre, the shingles of most members (of a sample of them; any centre
   gives the same links). Let a member lack a of the centre's L shingles and have b more, and
   c = 5a + 4b. Two members link at 0.8 if, and only if, 9 times what their differences share is
   at least c + c' - L. So two members whose c is at most L / 2 always link. In a cluster too
   large for a task such members are only counted, and the rest ("rim") meets rim and members in
   blocks of differences, not texts. What is dealt to tasks is so linear in a group about one
   centre; a member of the rim is dealt once more for every BLOCK_DOCS members of its cluster.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .graph import connected_components, thinned

SHINGLE_WORDS = 5
MIN_JACCARD = 0.8
TREES, MIN_DEPTH, MAX_DEPTH = 16, 4, 6
TARGET_RECALL = 0.9995
#: Documents, and shingles, that one block of a cluster holds.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 1_500_000
#: Members of a node whose signatures are compared; all members of a larger one are tied to its first.
NODE_MEMBERS = 2048
#: Memberships of nodes that one task compares, about.
NODE_ROWS = 40_000
#: Documents of a cluster that its centre is made of, at most.
CENTRE_DOCS = 32
#: Distinct words whose hashes a Python worker remembers; beyond it the memory starts anew.
MEMORY = 800_000
#: Standard deviations that a signature's estimate may fall short by before a tie is given up.
_SLACK = 5.0

_FEATURES = "doc_id long, print long, n long, fp1 long, fp2 long, sig binary, keys array<long>"
_FOUND = "id long, links long, other long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; of all its words if it has fewer."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - size + 1, 1)
    total = np.full(n, min(len(w), size), np.uint64)
    for j in range(min(len(w), size)):
        total = total * np.uint64(0xD1342543DE82EF95) + w[j : j + n]
    return np.unique(_mix(total))


def recall(depths: list[int], min_jaccard: float = MIN_JACCARD) -> float:
    """How surely a text at the threshold shares a prefix of one of these lengths in its tree."""
    return 1 - float(np.prod([1 - min_jaccard**k for k in depths]))


def chosen_depths(sizes: list[list[int]], min_jaccard: float = MIN_JACCARD, target: float = TARGET_RECALL) -> list[int]:
    """The prefix lengths that a class asks for, by tree.

    ``sizes``: for each tree how many share the prefixes of MIN_DEPTH to MAX_DEPTH. Prefixes
    are shortened, the least shared next, until the target recall is reached or all are short.
    """
    depths = [MAX_DEPTH] * len(sizes)
    queue = [(s[MAX_DEPTH - 1 - MIN_DEPTH], t) for t, s in enumerate(sizes)]
    heapq.heapify(queue)
    missed = 1 - recall(depths, min_jaccard)
    while queue and missed > 1 - target:
        _, t = heapq.heappop(queue)
        missed *= (1 - min_jaccard ** (depths[t] - 1)) / (1 - min_jaccard ** depths[t])
        depths[t] -= 1
        if depths[t] > MIN_DEPTH:
            heapq.heappush(queue, (sizes[t][depths[t] - 1 - MIN_DEPTH], t))
    return depths


class Forest:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = TREES * MAX_DEPTH
        self.times = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 2**63, n, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 8192):
            v = (s[i : i + 8192, None] ^ self.plus) * self.times
            v ^= v >> np.uint64(32)
            least = np.minimum(least, (v * np.uint64(0x9E3779B97F4A7C15)).min(0))
        return least

    def prefixes(self, least: np.ndarray) -> np.ndarray:
        """A number for each tree and prefix of MIN_DEPTH; longer ones add bytes of the signature."""
        total = np.arange(1, TREES + 1, dtype=np.uint64)
        for level in least.reshape(TREES, MAX_DEPTH).T[:MIN_DEPTH]:
            total = _mix(total * np.uint64(0xD1342543DE82EF95) + level)
        return total


def _fingerprint(s: np.ndarray) -> list[int]:
    """128 bits that depend on the set only."""
    return [int(s.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(_mix(s)).astype(np.int64)) if len(s) else 0]


def _features(docs: DataFrame, forest: Forest) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, print_ in zip(batch["doc_id"], batch["text"], batch["print"], strict=True):
                s = shingles(text)
                least = forest.signature(s)
                out.append((doc_id, print_, len(s), *_fingerprint(s), (least >> np.uint64(17)).astype(np.uint8).tobytes(), forest.prefixes(least).astype(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "print", "n", "fp1", "fp2", "sig", "keys"])

    return _printed(docs).where("doc_id is not null").mapInPandas(rows, _FEATURES)


def _printed(docs: DataFrame) -> DataFrame:
    """doc_id, text, print: a hash of the text, which tells rows of the same doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("print"))


def _branches(members: DataFrame, min_jaccard: float) -> DataFrame:
    """node, id, size, lead of every member of a node that some class asks for; of nested nodes the largest.

    Sizes are counts with partial sums, so a node that all classes share is no large group.
    """
    levels = [F.expr(f"substring(sig, tree * {MAX_DEPTH} + {k}, 1)") for k in range(MIN_DEPTH + 1, MAX_DEPTH + 1)]
    keyed = members.select("id", "sig", F.posexplode("keys").alias("tree", "key")).select("id", "tree", "key", *[x.alias(f"l{i}") for i, x in enumerate(levels)])
    met = lambda df, key: df.groupBy(key).agg(F.count("*").alias("size"), F.min("id").alias("lead"))
    held = keyed.join(met(keyed, "key").where("size > 1").select("key"), "key")
    names = [f"node{k}" for k in range(MIN_DEPTH, MAX_DEPTH + 1)]
    steps = [F.xxhash64("key", *[f"l{i}" for i in range(k)]).alias(name) for k, name in enumerate(names)]
    held = materialise(held.select("id", "tree", *steps), "branches")
    levels = held.select("id", "tree", F.posexplode(F.array(*names)).alias("depth", "node"))
    nodes = materialise(met(levels, "node"), "nodes")
    place = F.struct("tree", "depth", "node", "size")
    trees = levels.join(nodes, "node").groupBy("id").agg(F.collect_list(place).alias("places"))  # a node for each tree and depth, at most

    @F.pandas_udf("array<long>")
    def asked(all_places: pd.Series) -> pd.Series:
        out = []
        for places in all_places:
            sizes = [[1] * len(names) for _ in range(TREES)]
            found = {}
            for p in places:
                sizes[p["tree"]][p["depth"]] = p["size"]
                found[p["tree"], p["depth"]] = p["node"]
            depths = enumerate(chosen_depths(sizes, min_jaccard))
            out.append([int(found[t, k - MIN_DEPTH]) for t, k in depths if sizes[t][k - MIN_DEPTH] > 1])
        return pd.Series(out, dtype=object)

    used = materialise(trees.select(F.explode(asked("places")).alias("node")).distinct(), "asked")
    largest = levels.join(used, "node").groupBy("id", "tree").agg(F.min_by("node", "depth").alias("node"))
    out = materialise(largest.join(nodes, "node").select("node", "id", "size", "lead"), "places")
    discard(held, nodes, used)
    return out


def _agree(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, min_jaccard: float) -> np.ndarray:
    """Whether signatures and sizes don't rule the threshold out."""
    k = a.shape[-1]
    least = k * (min_jaccard - _SLACK * (min_jaccard * (1 - min_jaccard) / k) ** 0.5)
    return ((a == b).sum(-1) >= least) & (np.minimum(n_a, n_b) >= min_jaccard * np.maximum(n_a, n_b))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that links (a, b) lead to."""
    root = np.arange(n)
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _tied(part: pd.DataFrame, min_jaccard: float) -> pd.DataFrame:
    """Ties (id, lead) among the members of the nodes in ``part``, each node whole."""
    part = part.sort_values(["node", "id"])
    nodes, ids, n = (part[c].to_numpy(np.int64) for c in ("node", "id", "n"))
    sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
    first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    sizes = np.diff(np.append(first, len(nodes)))
    lead = np.repeat(first, sizes)
    near = np.concatenate([_agree(sigs[i : i + 65536], sigs[lead[i : i + 65536]], n[i : i + 65536], n[lead[i : i + 65536]], min_jaccard) for i in range(0, len(nodes), 65536)])
    out_a, out_b = [np.flatnonzero(near & (lead != np.arange(len(lead))))], [lead[near & (lead != np.arange(len(lead)))]]
    for at in np.flatnonzero((sizes > 2) & (np.add.reduceat(~near, first) > 0)):
        rows = np.arange(first[at], first[at] + sizes[at])
        for x in rows[~near[rows]]:
            others = rows[_agree(sigs[rows], sigs[x], n[rows], n[x], min_jaccard) & (rows != x)]
            out_a.append(np.full(len(others), x))
            out_b.append(others)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    root = _roots(len(ids), a, b)
    tied = root != np.arange(len(root))
    return pd.DataFrame({"id": ids[tied], "lead": ids[root[tied]]})


def _clusters(members: DataFrame, min_jaccard: float) -> DataFrame:
    """id, cluster of every class that is tied to another."""
    places = _branches(members, min_jaccard)
    total = places.where(F.col("size") <= NODE_MEMBERS).count()
    pools = total // NODE_ROWS + 1
    compared = places.where(F.col("size") <= NODE_MEMBERS).select("node", "id").join(members.select("id", "n", "sig"), "id")
    compared = compared.withColumn("pool", F.pmod(F.xxhash64("node"), F.lit(pools))).groupBy("pool").applyInPandas(lambda part: _tied(part, min_jaccard), "id long, lead long")
    ties = materialise(compared.unionByName(places.where(F.col("size") > NODE_MEMBERS).select("id", "lead")), "ties")
    found = connected_components(thinned(ties)).select("id", F.col("component").alias("cluster"))
    discard(places, ties)
    return found


def _differences(sets: list[np.ndarray], centre: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What each set and the centre don't share; and how many each lacks and has more."""
    apart = [np.setxor1d(s, centre, assume_unique=True) for s in sets]
    sizes, both = np.array([len(s) for s in sets], np.int64), np.array([len(d) for d in apart], np.int64)
    lacks = (both - sizes + len(centre)) // 2
    return apart, lacks, both - lacks


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """What more than half of the sets hold."""
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    return values[2 * n > len(sets)]


def _shared(left: list[np.ndarray], right: list[np.ndarray], strip: int = 512) -> Iterator[np.ndarray]:
    """The sizes of the intersections of left with right sets, as matrices of ``strip`` left sets.

    An element that few right sets hold is met set by set; the frequent ones by matrix products.
    """
    values = np.concatenate([*right, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    owner = owner[order]
    values, first, n = np.unique(values[order], return_index=True, return_counts=True)
    often = np.flatnonzero(n > max(64, len(right) // 16))
    rank = np.full(len(values), -1)
    rank[often] = np.arange(len(often))
    for i in range(0, len(left), strip):
        part = left[i : i + strip]
        flat = np.concatenate([*part, np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
        met = values[at] == flat if len(values) else np.zeros(len(flat), bool)
        at, row = at[met], row[met]
        out = np.zeros((len(part), len(right)), np.int64)
        few = rank[at] < 0
        counts, starts = n[at[few]], first[at[few]]
        ends = np.cumsum(counts)
        for j in range(0, len(counts), 16_384):
            c, s, e = counts[j : j + 16_384], starts[j : j + 16_384], ends[j : j + 16_384]
            inner = np.repeat(s - e + c, c) + np.arange(e[0] - c[0], e[-1])
            out += np.bincount(np.repeat(row[few][j : j + 16_384], c) * len(right) + owner[inner], minlength=out.size).reshape(out.shape)
        for j in range(0, len(often), 4096):
            columns = often[j : j + 4096]
            a, b = np.zeros((len(part), len(columns)), np.float32), np.zeros((len(columns), len(right)), np.float32)
            mine = (rank[at] >= j) & (rank[at] < j + 4096)
            a[row[mine], rank[at[mine]] - j] = 1
            b[np.repeat(np.arange(len(columns)), n[columns]), owner[np.concatenate([np.arange(first[c], first[c] + n[c]) for c in columns])]] = 1
            out += np.rint(a @ b).astype(np.int64)
        yield out


def _ratio(min_jaccard: float) -> tuple[int, int]:
    """The threshold as a fraction p / q of small numbers."""
    x = Fraction(min_jaccard).limit_denominator(10_000)
    return x.numerator, x.denominator


def _cost(lacks, more, min_jaccard: float):
    """What two members' differences must share to link: (p + q) * shared >= cost + cost - (q - p) * L.

    With sets of L - a + b and what they share, L - a - a' + shared, this is Jaccard >= p / q.
    """
    p, q = _ratio(min_jaccard)
    return q * lacks + p * more


def _linked(left: tuple, right: tuple, size: int, min_jaccard: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first left row, matrix of links) for members given as (differences, costs) from a centre of ``size``."""
    p, q = _ratio(min_jaccard)
    i = 0
    for shared in _shared(left[0], right[0]):
        yield i, (p + q) * shared >= left[1][i : i + len(shared), None] + right[1][None] - (q - p) * size
        i += len(shared)


def _links_and_roots(found: list[tuple[int, np.ndarray]], n_left: int, n_right: int, within: bool, copies_left: np.ndarray, copies_right: np.ndarray):
    """Links of left and right members, and for all of them (left first) the least that links lead to."""
    links_left, links_right = np.zeros(n_left, np.int64), np.zeros(n_right, np.int64)
    whole = np.zeros((n_left, n_right), bool)
    for i, true in found:
        whole[i : i + len(true)] = true
    if within:
        np.fill_diagonal(whole, False)
    for i in range(0, n_left, 512):
        links_left[i : i + 512] = whole[i : i + 512] @ copies_right
        links_right += copies_left[i : i + 512] @ whole[i : i + 512]
    root_left, root_right = np.arange(n_left), np.arange(n_right) + (0 if within else n_left)
    far = n_left + n_right
    while True:
        before = (root_left.copy(), root_right.copy())
        for i in range(0, n_left, 512):
            rows = whole[i : i + 512]
            root_left[i : i + 512] = np.minimum(root_left[i : i + 512], np.where(rows, root_right[None], far).min(1, initial=far))
            np.minimum(root_right, np.where(rows, root_left[i : i + 512, None], far).min(0, initial=far), out=root_right)
        if within:
            root_left = root_right = np.minimum(root_left, root_right)
        if (before[0] == root_left).all() and (before[1] == root_right).all():
            return links_left, links_right, root_left, root_right


def _rows(ids: list, links: list, other: list) -> pd.DataFrame:
    empty = [np.zeros(0, np.int64)]
    return pd.DataFrame({"id": np.concatenate(ids or empty), "links": np.concatenate(links or empty), "other": np.concatenate(other or empty)})


def _own_texts(part: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """Members with their sets, each once: repeated rows of a doc_id bring a text again."""
    part = part.drop_duplicates("id").sort_values("id")
    return part, [shingles(t) for t in part["text"]]


def _verify_clusters(part: pd.DataFrame, min_jaccard: float) -> pd.DataFrame:
    """Links of the clusters in ``part``, each cluster whole: per document the count, and the least that it hangs with."""
    p, q = _ratio(min_jaccard)
    ids_out, links_out, other_out = [], [], []
    for _, cluster in part.groupby("cluster"):
        cluster, sets = _own_texts(cluster)
        ids, copies = cluster["id"].to_numpy(np.int64), cluster["copies"].to_numpy(np.int64)
        if len(ids) <= 12:
            # every pair is compared exactly, as in larger clusters; sizes that are too far apart rule a link out
            n = np.array([len(s) for s in sets], np.int64)
            a, b = np.triu_indices(len(ids), 1)
            fit = q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])
            a, b = a[fit], b[fit]
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
            true = (p + q) * common >= p * (n[a] + n[b])
            a, b = a[true], b[true]
            links = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
            root = _roots(len(ids), a, b)
        else:
            centre = majority(sets)
            apart, lacks, more = _differences(sets, centre)
            side = (apart, _cost(lacks, more, min_jaccard))
            links, _, root, _ = _links_and_roots(list(_linked(side, side, len(centre), min_jaccard)), len(ids), len(ids), True, copies, copies)
        linked = links > 0
        ids_out.append(ids[linked])
        links_out.append(links[linked].astype(np.int64))
        other_out.append(ids[root[linked]])
    return _rows(ids_out, links_out, other_out)


def _centre_of(part: pd.DataFrame) -> pd.DataFrame:
    part, sets = _own_texts(part)
    return pd.DataFrame({"cluster": part["cluster"].iloc[:1], "centre": [majority(sets).astype("<u8").tobytes()]})


_APART = "cluster long, id long, copies long, n_apart long, cost long, size long, apart binary"


def _apart_from(part: pd.DataFrame, centres: pd.DataFrame, min_jaccard: float) -> pd.DataFrame:
    """A block of a cluster's members as differences from its centre."""
    if part.empty:
        return part[["cluster", "id", "copies"]].assign(n_apart=0, cost=0, size=0, apart=b"")
    part, sets = _own_texts(part)
    centre = np.frombuffer(centres["centre"].iloc[0], "<u8")
    apart, lacks, more = _differences(sets, centre)
    made = {"n_apart": [len(d) for d in apart], "cost": _cost(lacks, more, min_jaccard), "size": len(centre), "apart": [d.astype("<u8").tobytes() for d in apart]}
    return part[["cluster", "id", "copies"]].assign(**made)


def _verify_blocks(part: pd.DataFrame, min_jaccard: float) -> pd.DataFrame:
    """Links of one block of a cluster with another (sides 0 and 1), or within one (``within``)."""
    part = part.sort_values("id")
    within = bool(part["within"].iloc[0])
    left, right = part[part["side"] == 0], part[part["side"] == (0 if within else 1)]
    if left.empty or right.empty:
        return _rows([], [], [])
    sides = [([np.frombuffer(d, "<u8") for d in x["apart"]], x["cost"].to_numpy(np.int64)) for x in (left, right)]
    copies = [x["copies"].to_numpy(np.int64) for x in (left, right)]
    ids = [x["id"].to_numpy(np.int64) for x in (left, right)]
    found = list(_linked(*sides, int(part["size"].iloc[0]), min_jaccard))
    links_left, links_right, root_left, root_right = _links_and_roots(found, len(left), len(right), within, *copies)
    every = ids[0] if within else np.concatenate(ids)
    kept = [(ids[0], links_left, root_left)] if within else [(ids[0], links_left, root_left), (ids[1], links_right, root_right)]
    return _rows([i[n > 0] for i, n, _ in kept], [n[n > 0] for _, n, _ in kept], [every[r[n > 0]] for _, n, r in kept])


def _large_clusters(large: DataFrame, texts: DataFrame, min_jaccard: float) -> DataFrame:
    """Links of clusters of several blocks. ``large``: members with cluster, copies, n, least, print, blocks."""
    p, q = _ratio(min_jaccard)
    text_of = lambda df: df.join(texts, (F.col("least") == F.col("t_id")) & (F.col("print") == F.col("t_print"))).select(*df.columns, "text")
    slot = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CENTRE_DOCS))
    sample = large.groupBy("cluster", slot.alias("slot")).agg(F.min_by(F.struct("id", "least", "print", "n"), F.xxhash64("id", F.lit(6))).alias("x"))
    drawn = sample.groupBy("cluster").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # CENTRE_DOCS entries at most
    drawn = drawn.withColumn("room", F.greatest(F.lit(1), F.least(F.lit(CENTRE_DOCS), F.floor(BLOCK_SHINGLES / F.greatest(F.array_max(F.transform("xs", lambda x: x["n"])), F.lit(1)))))).select("cluster", F.explode(F.slice("xs", F.lit(1), F.col("room").cast("int"))).alias("x"))
    centres = materialise(text_of(drawn.select("cluster", "x.id", "x.least", "x.print")).groupBy("cluster").applyInPandas(_centre_of, "cluster long, centre binary"), "centres")
    dealt = large.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    spread = centres.join(large.select("cluster", "blocks").distinct(), "cluster").select("cluster", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    mine = text_of(dealt.select("cluster", "block", "id", "copies", "least", "print"))
    apart = mine.groupBy("cluster", "block").cogroup(spread.groupBy("cluster", "block")).applyInPandas(lambda x, c: _apart_from(x, c, min_jaccard), _APART)
    apart = materialise(apart.withColumn("core", 2 * F.col("cost") <= (q - p) * F.col("size")), "apart")
    # members near enough to the centre link with each other, so they are only counted
    core = apart.where("core").groupBy("cluster").agg(F.min("id").alias("other"), F.sum("copies").alias("core_copies"))
    near = apart.where("core").join(core, "cluster").select("id", (F.col("core_copies") - F.col("copies")).alias("links"), "other")
    n_blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK_DOCS), F.ceil(F.sum(F.when(which, F.col("n_apart"))) / BLOCK_SHINGLES)).cast("int")
    sizes = apart.groupBy("cluster").agg(F.coalesce(n_blocks(~F.col("core")), F.lit(0)).alias("rims"), F.coalesce(n_blocks(F.col("core")), F.lit(0)).alias("cores"))
    placed = apart.join(sizes.where("rims > 0"), "cluster")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(4)), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["cluster", "id", "copies", "cost", "size", "apart"]
    rim, mid = placed.where("not core").withColumn("own", own("rims")), placed.where("core").withColumn("own", own("cores"))
    # rim block i meets rim block j >= i, where the larger is side 1; and every core block, as side 1
    tasks = (
        rim.withColumn("to", to("rims"))
        .select(*row, F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), F.lit(False).alias("with_core"), (F.col("own") == F.col("to")).alias("within"), F.when(F.col("own") > F.col("to"), 1).otherwise(0).alias("side"))
        .unionByName(rim.where("cores > 0").withColumn("to", to("cores")).select(*row, F.col("to").alias("i"), F.col("own").alias("j"), F.lit(True).alias("with_core"), F.lit(False).alias("within"), F.lit(1).alias("side")))
        .unionByName(mid.withColumn("to", to("rims")).select(*row, F.col("own").alias("i"), F.col("to").alias("j"), F.lit(True).alias("with_core"), F.lit(False).alias("within"), F.lit(0).alias("side")))
    )
    met = tasks.groupBy("cluster", "with_core", "i", "j").applyInPandas(lambda x: _verify_blocks(x, min_jaccard), _FOUND)
    return near.unionByName(met)


def _classified(docs: DataFrame, min_jaccard: float) -> DataFrame:
    """What :func:`jaccard_classes` gives, with each row's ``print`` and ``component``.

    The component numbers the class itself: two classes may have the same smallest doc_id. It
    is null for texts without words.
    """
    features = materialise(_features(docs, Forest()), "features")
    full = features.where("n > 0")
    fp = ["fp1", "fp2", "n"]
    # one row stands for a set; it is told by its smallest doc_id and text
    classes = full.groupBy(*fp).agg(F.min(F.struct("doc_id", "print")).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    members = classes.select(F.monotonically_increasing_id().alias("id"), "least.doc_id", "least.print", "copies", *fp, "sig", "keys")
    members = materialise(members.withColumnRenamed("doc_id", "least"), "classes")  # stored with numbers of our own
    clusters = materialise(members.drop("keys", "fp1", "fp2").join(_clusters(members, min_jaccard), "id"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
    sizes = materialise(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("weight") / BLOCK_SHINGLES))), "sizes")
    total = sizes.where("blocks = 1").agg(F.sum("docs").alias("docs"), F.sum("weight").alias("weight")).first()
    pools = max(1, 2 * (total["docs"] or 0) // BLOCK_DOCS, 2 * (total["weight"] or 0) // BLOCK_SHINGLES)
    placed = clusters.join(sizes.select("cluster", "blocks"), "cluster")
    texts = _printed(docs).select(F.col("doc_id").alias("t_id"), F.col("print").alias("t_print"), "text")
    small = placed.where("blocks = 1").join(texts, (F.col("least") == F.col("t_id")) & (F.col("print") == F.col("t_print"))).select("cluster", "id", "copies", "sig", "text")
    found = small.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(pools))).applyInPandas(lambda part: _verify_clusters(part, min_jaccard), _FOUND)
    if not sizes.where("blocks > 1").isEmpty():
        found = found.unionByName(_large_clusters(placed.where("blocks > 1").drop("sig"), texts, min_jaccard))
    found = materialise(found, "links")
    components = connected_components(thinned(found.select("id", F.col("other").alias("lead"))))
    named = components.join(members.select("id", "least"), "id")
    named = named.select("id", "component").join(named.groupBy("component").agg(F.min("least").alias("class_id")), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    settled = (
        members.select("id", "least", "copies", *fp)
        .join(links, "id", "left")
        .join(named, "id", "left")
        .select(*fp, F.col("least").alias("copy_id"), F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("component", "id").alias("component"))
    )
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    names = ["doc_id", "class_id", "copy_id", "n_copies", "n_links"]
    plain = features.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), one.alias("n_copies"), (one - 1).alias("n_links"), "print", none.alias("component"))
    nameless = docs.where("doc_id is null").select(*[none.alias(c) for c in names[:3]], one.alias("n_copies"), (one - 1).alias("n_links"), *[none.alias(c) for c in ("print", "component")])
    joined = full.select("doc_id", "print", *fp).join(settled, fp).select(*names, "print", "component").unionByName(plain).unionByName(nameless)
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def jaccard_classes(docs: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links, kept for every row of (doc_id, text).

    Two documents link if the Jaccard similarity of their shingle sets is at least
    ``min_jaccard``; ``n_links`` counts the documents that one links with, copies included.
    ``class_id`` is the smallest doc_id that links lead to, ``copy_id`` the smallest with an equal
    set. Texts of fewer than five words are one shingle; null texts and texts without words link
    with nothing, nor do rows with a null doc_id (class_id null, kept). Repeated rows are
    documents that are copies of each other. Texts of any length are compared whole: a task holds
    the sets of one block, and at least of one text with a number for each of its words. An empty
    table gives an empty result; other columns are ignored.
    """
    return _classified(docs, min_jaccard).drop("print", "component")


def one_of_each_class(docs: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """The rows of ``docs`` whose document stands for its class, with all columns; one row where such a document is repeated.

    Of a class the smallest doc_id stands, and of several texts under it the one with the
    smallest hash. Texts without words and rows with a null doc_id all stay.
    """
    classes = materialise(_classified(docs, min_jaccard).where("component is not null").groupBy("component", "doc_id", "print").agg(F.count("*").alias("rows")), "jaccard")
    stands = classes.groupBy("component").agg(F.min(F.struct("doc_id", "print")).alias("x"))
    verdicts = classes.join(stands, "component").select(
        F.col("doc_id").alias("k_id"), F.col("print").alias("k_print"), F.when(F.struct("doc_id", "print") == F.col("x"), F.col("rows")).otherwise(0).alias("rows")
    )
    verdicts = materialise(verdicts.where("rows <> 1"), "verdicts")  # the rest are single rows that stay
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    row = row.select("row", F.col("row.doc_id").cast("long").alias("row_id"), F.coalesce(F.xxhash64("row.text"), F.lit(0)).alias("row_print"))
    joined = row.join(verdicts, (F.col("row_id") == F.col("k_id")) & (F.col("row_print") == F.col("k_print")), "left")
    once = joined.where("rows is null").select("row")
    again = joined.where("rows > 1").dropDuplicates(["row_id", "row_print"]).select("row")
    return once.unionByName(again).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of all documents."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
