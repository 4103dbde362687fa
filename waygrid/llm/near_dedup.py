"""Near-duplicates by BagMinHash signatures, bands, and exact multiset overlap.

Documents are bags of five-word shingles with their counts. Two bags are linked if the sum
of the smaller counts is at least `similarity` of the sum of the larger ones.

Signatures: each shingle and each unit of its count has a Poisson process of points, each
point with a time and a component; a component's value is its first point's time. Equal
values of two bags then have the probability of their weighted Jaccard similarity. Counts
are discretised in blocks [0,1), [1,2), [2,4), [4,8), ...: a block has one process for all
its units, whose points carry a place in it and count for bags that reach beyond that
place, so a count c costs log c processes. Points come in the order of time, and only those
up to the time by which all components have surely got one are made, longer where
need be.

Candidates: bands of `ROWS` components; with 32 bands of 4, a pair at 0.8 shares no band
with a chance under 1e-7. Copies are one node (a hash of the text). In a bucket, one node
leads and all others are compared with it, so near copies of one document cost one
comparison each. What remains are buckets with several classes: there, the nodes
outside the largest class meet all nodes of other classes in blocks, by a wide signature
only. A pair is compared exactly unless these agree in under similarity - 0.07 of their
components (at 0.8, a pair that counts does so with a chance of 1e-8), or its
distances from the leader differ by more than 1 - similarity, which the triangle
inequality rules out. First each node's best few pairs are tried, which joins most nodes to
a class; then all pairs that are left. Nothing is capped. Classes are connected components
by label passing with shortcuts.

Words are runs of anything but ASCII white space. A text of 1 to 4 words has one shingle,
all its words. Null and empty texts and those without words have no shingles; equal ones
are copies of each other. Null doc_id counts as the least id and is given back as null.
Rows that repeat an id and text are copies. `first_of_each` carries all columns through.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.common import by_bytes, dropped, saved, utf8_size

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, COMPONENTS, ROWS = 5, 128, 4
#: Components of the wide signature, of which a byte each is kept, and how far its estimate may
#: fall below a similarity: 5.6 standard deviations at 0.8.
WIDE, SLACK = 1024, 0.07
LEAST = -(1 << 63)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count) of all texts, by doc and shingle."""
    words = [WORD.findall(t) for t in texts]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), U, len(number))[ids] if len(ids) else np.zeros(0, U)
    docs, shingles, counts, at = [], [], [], 0
    for i, w in enumerate(words):
        h, at = hashes[at : at + len(w)], at + len(w)
        if not len(w):
            continue
        k = min(SHINGLE, len(w))
        x = np.full(len(w) - k + 1, U(k))
        for j in range(k):
            x = mix(x + h[j : j + len(x)])
        s, c = np.unique(x, return_counts=True)
        docs.append(np.full(len(s), i))
        shingles.append(s)
        counts.append(c)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(shingles), np.concatenate(counts)


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (n_docs x m first times); rows of documents without shingles are inf."""
    first = np.full(n_docs * m, np.inf)
    if not len(doc):
        return first.reshape(n_docs, m)
    weight = np.bincount(doc, count, n_docs)
    # a process for each block that a count reaches into
    n_blocks = np.where(count > 1, np.frexp(np.maximum(count - 1, 1).astype(float))[1], 0) + 1
    row = np.repeat(np.arange(len(doc)), n_blocks)
    block = np.arange(len(row)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    width = np.where(block > 0, 2.0 ** (block - 1), 1.0)
    start = np.where(block > 0, width, 0.0)
    seed = mix(shingle[row] + mix((block + 1).astype(U) * U(0x9E3779B97F4A7C15)))
    owner, reach = doc[row], count[row].astype(float)
    rate = width * m
    time, nth = np.zeros(len(row)), np.zeros(len(row), U)
    upto = (np.log(m) + 6) / np.maximum(weight, 1)

    def points(a: np.ndarray):
        """The next point of processes a: its draw, and its time."""
        z = mix(seed[a] + (nth[a] + U(1)) * U(0xD1B54A32D192ED03))
        nth[a] += U(1)
        time[a] += -np.log(((z >> U(11)).astype(float) + 1) / float(1 << 53)) / rate[a]
        return z

    live = np.arange(len(row))
    draw = points(live)
    pending = draw.copy()  # the draw of the point that stands at `time`
    while len(live):
        active = live[time[live] <= upto[owner[live]]]
        while len(active):
            z = mix(pending[active] + U(0x632BE59BD9B4E019))
            place = start[active] + (z >> U(24)).astype(float) / float(1 << 40) * width[active]
            hit = place < reach[active]
            a = active[hit]
            np.minimum.at(first, owner[a] * m + (z[hit] % U(m)).astype(np.int64), time[a])
            pending[active] = points(active)
            active = active[time[active] <= upto[owner[active]]]
        short = np.isinf(first.reshape(n_docs, m)).any(axis=1)  # some component has no point yet
        upto[short] *= 3
        live = live[short[owner[live]]]
    return first.reshape(n_docs, m)


def short_signatures(sig: np.ndarray) -> np.ndarray:
    """32 bits of each component, which is what travels."""
    return (mix(sig.view(U)) >> U(32)).astype("<u4")


def _node() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def nodes(docs: DataFrame) -> DataFrame:
    """node (hash of the text), doc (least id of its copies), sig (null if there are no words)."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows: list = []
            for part in by_bytes(texts, [*map(utf8_size, texts)], 1 << 21):
                sig = signatures(*bags(part), len(part))
                rows += [None if np.isinf(x[0]) else h.tobytes() for x, h in zip(sig, short_signatures(sig))]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc"), pa.array(rows, pa.binary())], ["node", "doc", "sig"])

    slim = docs.select(_node().alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), "text")
    found = slim.mapInArrow(run, "node binary, doc long, sig binary")
    return found.groupBy("node").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"))  # copies have one signature


def _bags_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles, counts of the wanted nodes (node, doc), a tag for each band, and a wide signature."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            out = {k: [] for k in ("shingles", "counts", "tags", "wide")}
            for part in by_bytes(texts, [*map(utf8_size, texts)], 1 << 19):
                doc, sh, c = bags(part)
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                tags = short_signatures(signatures(doc, sh, c, len(part))).reshape(len(part), -1, ROWS)
                tags = mix(mix(tags[:, :, ::2].astype(U) << U(32) | tags[:, :, 1::2]).sum(axis=2)).astype("<u8")
                wide = short_signatures(signatures(doc, mix(sh + U(1)), c, len(part), WIDE)).astype("<u1")
                out["tags"] += [x.tobytes() for x in tags]
                out["wide"] += [x.tobytes() for x in wide]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    out["shingles"].append(sh[lo:hi].tobytes())
                    out["counts"].append(c[lo:hi].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), *[pa.array(v, pa.binary()) for v in out.values()]], ["node", *out])

    slim = docs.select(_node().alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), "text")
    return slim.join(wanted, ["node", "doc"], "left_semi").dropDuplicates(["node", "doc"]).mapInArrow(run, "node binary, shingles binary, counts binary, tags binary, wide binary")


def overlap(s1: np.ndarray, c1: np.ndarray, s2: np.ndarray, c2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags with sorted shingles."""
    both, i, j = np.intersect1d(s1, s2, assume_unique=True, return_indices=True)
    small = int(np.minimum(c1[i], c2[j]).sum())
    return small / max(1, int(c1.sum()) + int(c2.sum()) - small)


def _compared(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """a, b, sim of the pairs. The leader's bag is joined while rows are narrow, so what is
    shuffled wide is keyed by the other, which recurs once a leader."""

    def run(batches):
        for b in batches:
            u8 = lambda c: [np.frombuffer(x, U) for x in b.column(c).to_pylist()]
            u4 = lambda c: [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(c).to_pylist()]
            sim = [overlap(*x) for x in zip(u8("s1"), u4("c1"), u8("s2"), u4("c2"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    one = bag.select(F.col("node").alias("a"), F.col("shingles").alias("s1"), F.col("counts").alias("c1"))
    two = bag.select(F.col("node").alias("b"), F.col("shingles").alias("s2"), F.col("counts").alias("c2"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a binary, b binary, sim double")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several classes, with the bucket's largest class and the number of
    nodes in it and outside."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("band", "hash", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("band", "hash").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("classes"), F.sum("size").alias("n")).where("classes > 1")
    return named.join(mixed.select("band", "hash", F.col("most.label").alias("largest"), "n", (F.col("n") - F.col("most.size")).alias("n_out")), ["band", "hash"])


def _candidates(opened: DataFrame, sims: DataFrame, bag: DataFrame, similarity: float, best: int | None, block: int = 1024) -> DataFrame:
    """a, b (a < b) of different classes in an open bucket that may be similar. A pair that shares
    several bands is given in the first; `best` limits the pairs that one node brings from
    a block, in a round that another without limit follows."""
    near = sims.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("away"))
    rows = opened.join(near, ["leader", "node"], "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
    rows = rows.join(bag.select("node", "tags", "wide"), "node")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("long")
    mine = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    out = F.col("label") != F.col("largest")
    keys = ["band", "hash", "i", "j"]
    rest = ["node", "label", "away", "tags", "wide", out.alias("out")]
    x = rows.where(out).select("band", "hash", mine("n_out").alias("i"), upto("n").alias("j"), F.lit(True).alias("asks"), *rest)
    y = rows.select("band", "hash", upto("n_out").alias("i"), mine("n").alias("j"), F.lit(False).alias("asks"), *rest)

    def meet(key, table):
        band = key[0].as_py()
        asks = np.array(table["asks"])
        node, label = np.array(table["node"].to_pylist(), object), np.array(table["label"].to_pylist(), object)
        away, outside = np.array(table["away"]), np.array(table["out"])
        tags = np.frombuffer(b"".join(table["tags"].to_pylist()), "<u8").reshape(len(node), -1)
        wide = np.frombuffer(b"".join(table["wide"].to_pylist()), "<u1").reshape(len(node), -1)
        ys = np.flatnonzero(~asks)
        low, high = [], []
        for i in np.flatnonzero(asks):
            ok = ys[(label[ys] != label[i]) & (np.abs(away[ys] - away[i]) <= 1 - similarity + 1e-9)]
            ok = ok[~outside[ok] | (node[ok] > node[i])]
            if not len(ok):
                continue
            share = (wide[ok] == wide[i]).mean(axis=1)
            first = (tags[ok] == tags[i]).argmax(axis=1)
            pick = np.flatnonzero((share >= similarity - SLACK) & (first == band))
            if best is not None and len(pick) > best:
                pick = pick[np.argsort(-share[pick], kind="stable")[:best]]
            for j in ok[pick]:
                low.append(min(node[i], node[j]))
                high.append(max(node[i], node[j]))
        return pa.Table.from_pydict({"a": pa.array(low, pa.binary()), "b": pa.array(high, pa.binary())})

    return x.unionByName(y).groupBy(*keys).applyInArrow(meet, "a binary, b binary").join(sims.select("a", "b"), ["a", "b"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) of all nodes that have a link."""
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = saved(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "seen").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = saved(step.join(jump, "new").select("node", F.least("new", "far").alias("new_label"), "label"), "near-labels")
        dropped(labels)
        labels = step.select("node", F.col("new_label").alias("label"))
        if step.where(F.col("label") != F.col("new_label")).isEmpty():
            dropped(edges)
            return labels


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """node, label of all nodes that have a near copy with another text."""
    found = saved(nodes(docs), "near-nodes")
    width = 4 * ROWS
    hashes = F.array(*[F.xxhash64(F.lit(k), F.expr(f"substring(sig, {width * k + 1}, {width})")) for k in range(COMPONENTS // ROWS)])
    rows = found.where("sig is not null").select("node", "doc", F.posexplode(hashes).alias("band", "hash"))
    buckets = rows.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    members = saved(rows.join(buckets, ["band", "hash"]).select("band", "hash", "leader", "node", "doc"), "near-members")
    bag = saved(_bags_of(docs, members.select("node", "doc").distinct()), "near-bags")
    members = members.drop("doc")
    pairs = members.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sims = saved(_compared(pairs, bag), "near-sims")
    labels = components(sims.where(F.col("sim") >= similarity))
    for best in (4, None):
        opened = saved(_open(members, labels), "near-open")
        more = saved(_candidates(opened, sims, bag, similarity, best), "near-pairs")
        dropped(opened)
        if more.isEmpty():
            break
        sims = sims.unionByName(saved(_compared(more, bag), "near-sims"))
        dropped(labels)
        labels = components(sims.where(F.col("sim") >= similarity))
    for step in (found, members, bag, sims):
        dropped(step)
    return labels


def classified(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc (id, null as the least), node, first (doc and node of the class's first document)."""
    ids = docs.select(_node().alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"))
    per_node = ids.groupBy("node").agg(F.min("doc").alias("least")).join(near_classes(docs, similarity), "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_node = saved(per_node, "near-per-node")
    per_class = per_node.groupBy("label").agg(F.min(F.struct(F.col("least").alias("doc"), "node")).alias("first"))
    return ids.join(per_node.join(per_class, "label").select("node", "first"), "node")


def near_digest(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept (whether it is that document)."""
    real = lambda c: F.when(c != LEAST, c)
    return classified(docs, similarity).select(real(F.col("doc")).alias("doc_id"), real(F.col("first.doc")).alias("class_id"), ((F.col("doc") == F.col("first.doc")) & (F.col("node") == F.col("first.node"))).alias("kept"))


def first_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each class, with all columns of docs: its document with the least id."""
    firsts = classified(docs, similarity).select(F.col("first.doc").alias("__near_doc"), F.col("first.node").alias("__near_node")).distinct()
    marked = docs.withColumn("__near_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn("__near_node", _node())
    return marked.join(firsts, ["__near_doc", "__near_node"], "left_semi").dropDuplicates(["__near_doc", "__near_node"]).drop("__near_doc", "__near_node")
