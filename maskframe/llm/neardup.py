"""Near-duplicate documents: an LSH forest over MinHash signatures, then exact links on full shingle sets.

1.  One pass makes each document's set of word shingles (hashed to 64 bits) and its
    signature of ``TREES * DEPTH`` minima. Documents of equal sets form a class; only
    the smallest id of a class goes on.
2.  Every tree of the forest is one order of the signature: it starts at another place
    and wraps round. Documents that share the first ``DEPTH`` values of an order are a
    region of that tree. Each tree is sorted by region and then by the rest of the
    order, so those with the longest common prefix stand side by side. A region of up to
    ``RUN`` documents is compared whole, a larger one first in runs along the order.
    Signatures are compared, and what agrees in ``AGREE`` values or more is joined to the
    smallest id of its run; a run gives fewer links than it has documents, never its
    pairs. Regions that are larger than a run, or that a partition boundary may cut, are
    named as well. Where the links so far leave such a region in several components,
    what is outside its largest one is compared with the whole region, in bounded blocks.
3.  The components of these loose links are the candidates. Within each the true links
    are found on full sets. A component is dealt into blocks of bounded size; a block
    is searched by an inverted index, smallest component first, and stops when only one
    component has documents left to look up. For candidates of several blocks the hubs
    of the blocks' components are linked with each other in the same way, then what
    is still outside the largest component is compared with every block.
4.  The components of the true links, spread to all members of the classes.

Two documents at the similarity limit of 0.8 share a region of at least one tree with
probability 1 - (1 - 0.8^3)^24, all but one in 30 million, and agree in too few values
with a probability of about one in 10 million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, space_words, stored, with_keys
from .components import components

TREES, DEPTH = 24, 3
SIZE = TREES * DEPTH
#: Of ``SIZE`` signature values; at a similarity of 0.8 58 agree on average, with a deviation of 3.3.
AGREE = 40
#: Documents of a region that are compared with each other at once.
RUN = 512
#: Documents on each side of a block of a region that is larger than a run.
SIDE = 4096
#: Parts that the members of a region are spread over where they meet the region's own row.
SALT = 32
#: Most documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20

_MASK = (1 << 64) - 1


def _odd(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}".encode()) | 1 for k in range(n)], np.uint64)


_PLACES = _odd(1, 64)
_MINIMA = _odd(2, SIZE)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of all runs of ``words`` words, ascending; fewer words make one run, none none."""
    tokens = space_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    n = min(words, len(hashed))
    total = np.full(len(hashed) - n + 1, np.uint64(n))
    for k in range(n):
        total += hashed[k : len(hashed) - n + 1 + k] * _PLACES[k % 64]
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``SIZE`` minima (32 bits each) of the hashes under multiplicative permutations."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 2048):
        some = hashes[k : k + 2048]
        np.minimum(out, ((_MINIMA[:, None] * some[None, :]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the digest of the set, a key for each tree's region, and the signature at eight bits a value."""

    def rows(batch: dict) -> dict:
        out: dict = {k: [] for k in ("doc_id", "n_shingles", "digest", "regions", "values")}
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = shingles(text, words)
            out["doc_id"].append(doc)
            out["n_shingles"].append(len(found))
            if not len(found):
                out["digest"].append(None), out["regions"].append(None), out["values"].append(None)
                continue
            values = signature(found)
            first = values.reshape(TREES, DEPTH).astype(np.uint64)
            keys = first[:, 0] * _PLACES[0] ^ first[:, 1] * _PLACES[1] ^ first[:, 2] * _PLACES[2]
            out["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            out["regions"].append(keys.view(np.int64).tolist())
            out["values"].append((values & 0xFF).astype(np.uint8).tobytes())
        return out

    return map_rows(docs, rows, "doc_id long, n_shingles long, digest binary, regions array<long>, values binary")


def _loose(names: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links of each document of a run to the smallest id that it is joined to by agreeing signatures."""
    n = len(names)
    if n == 2:
        return [(max(names), min(names))] if (values[0] == values[1]).sum() >= AGREE else []
    near = np.zeros((n, n), np.uint8)
    for k in range(SIZE):
        near += values[:, k, None] == values[None, :, k]
    near = near >= AGREE
    label = np.full(n, -1)
    for i in np.argsort(names, kind="stable"):
        if label[i] >= 0:
            continue
        front = np.zeros(n, bool)
        front[i] = True
        while front.any():
            label[front] = i
            front = near[front].any(axis=0) & (label < 0)
    return [(int(names[k]), int(names[label[k]])) for k in range(n) if label[k] != k]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loose links (a, b) within the regions of a sorted tree, in runs that overlap by half where a region is large.

    The members (a) of regions larger than a run, and of the first and the last region
    of the partition, come with the tree and region and without b.
    """
    found: list[tuple[int, int]] = []
    named: list[tuple[np.ndarray, int, int]] = []

    def drain(doc: np.ndarray, values: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        while len(doc) > RUN:
            found.extend(_loose(doc[:RUN], values[:RUN]))
            doc, values = doc[RUN // 2 :], values[RUN // 2 :]
        if last and len(doc) > 1:
            found.extend(_loose(doc, values))
        return doc, values

    def made() -> list[pa.RecordBatch]:
        pairs = np.array(found, np.int64).reshape(-1, 2)
        links = pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "tree": pa.nulls(len(pairs), pa.int32()), "region": pa.nulls(len(pairs), pa.int64())})
        own = [pa.table({"a": doc, "b": pa.nulls(len(doc), pa.int64()), "tree": pa.array([tree] * len(doc), pa.int32()), "region": pa.array([region] * len(doc), pa.int64())}) for doc, tree, region in named]
        found.clear(), named.clear()
        return pa.concat_tables([links, *own]).combine_chunks().to_batches()

    held: tuple | None = None
    seen: list[np.ndarray] = []  # all documents of the region that is held
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        now = [b["tree"].to_numpy(), b["region"].to_numpy(), b["doc_id"].to_numpy(), np.frombuffer(b"".join(b["order"].to_pylist()), np.uint8).reshape(-1, SIZE)]
        new = 0
        if held:
            new = len(held[0])
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        tree, region, doc, values = now
        edge = np.flatnonzero((tree[1:] != tree[:-1]) | (region[1:] != region[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(tree)]])
        seen.append(doc[new : ends[0]])
        several = np.flatnonzero(ends - starts > 1)
        for k in several[several < len(starts) - 1]:
            drain(doc[starts[k] : ends[k]], values[starts[k] : ends[k]], last=True)
            if k and ends[k] - starts[k] > RUN:
                named.append((doc[starts[k] : ends[k]], tree[starts[k]], region[starts[k]]))
        if len(starts) > 1:
            if first or sum(map(len, seen)) > RUN:
                named.append((np.concatenate(seen), tree[0], region[0]))
            first = False
            seen = [doc[starts[-1] :]]
        rest = drain(doc[starts[-1] :], values[starts[-1] :], last=False)
        held = (tree[-len(rest[0]) :], region[-len(rest[0]) :], *rest)
        yield from made()
    if held:
        drain(held[2], held[3], last=True)
        named.append((np.concatenate(seen), held[0][0], held[1][0]))
        yield from made()


def _sides(asking: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], group: np.ndarray, asked_group: np.ndarray) -> list[tuple[int, int]]:
    """Loose links between two sides (names and signatures) that join components; ``group`` is what each belongs to so far."""
    heads, label = np.unique(np.concatenate([group, asked_group]), return_inverse=True)
    mine, theirs = label[: len(group)], label[len(group) :]
    found: list[tuple[int, int]] = []
    for i in range(0, len(mine), RUN):
        for j in range(0, len(theirs), RUN):
            a, b = slice(i, i + RUN), slice(j, j + RUN)
            if (mine[a] == mine[i]).all() and (theirs[b] == mine[i]).all():
                continue
            near = np.zeros((len(mine[a]), len(theirs[b])), np.uint8)
            for k in range(SIZE):
                near += asking[1][a, k, None] == asked[1][None, b, k]
            for x, y in np.argwhere((near >= AGREE) & (mine[a, None] != theirs[None, b])):
                p, q = mine[i + x], theirs[j + y]
                if p != q:
                    found.append((int(asking[0][i + x]), int(asked[0][j + y])))
                    label[label == q] = p  # mine and theirs are views of it
    return found


def _large(named: DataFrame, so_far: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Loose links (a, b) within the named regions (tree, region, doc_id) that components ``so_far`` leave in several parts."""
    members = stored(named.join(so_far.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id")))
    counts = members.groupBy("tree", "region", "group").agg(F.count("*").alias("n"))
    open_regions = counts.groupBy("tree", "region").agg(F.max(F.struct("n", "group")).alias("m"), F.count("*").alias("groups"), F.sum("n").alias("all")).where("groups > 1")
    deal = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.ceil(n / SIDE)).cast("int")
    # one region may hold a third of all members: they meet its row in parts
    spread = open_regions.select("tree", "region", F.col("m.group").alias("largest"), (F.col("all") - F.col("m.n")).alias("outside"), "all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    state = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALT))).join(spread, ["tree", "region", "salt"]).drop("salt")
    state = stored(state.join(classes.select("doc_id", "values"), "doc_id").withColumns({"asks": F.col("group") != F.col("largest"), "block": deal(F.col("all"), "block"), "part": deal(F.col("outside"), "part")}))
    if not state.limit(1).count():
        return None
    upto = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / SIDE) - 1).cast("int")))
    same = ["tree", "region", "part", "block", "doc_id", "group", "values"]
    asking = state.where("asks").withColumn("block", upto("all")).select(*same, F.lit(True).alias("asks"))
    asked = state.withColumn("part", upto("outside")).select(*same, F.lit(False).alias("asks"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["group", "doc_id"])
        sides = []
        for one in (frame[frame["asks"]], frame[~frame["asks"]]):
            sides.append((one["doc_id"].to_numpy(), np.frombuffer(b"".join(one["values"]), np.uint8).reshape(-1, SIZE), one["group"].to_numpy()))
        links = _sides(sides[0][:2], sides[1][:2], sides[0][2], sides[1][2]) if all(len(x[0]) for x in sides) else []
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    links = stored(asking.unionByName(asked).groupBy("tree", "region", "part", "block").applyInPandas(run, "a long, b long"))
    return links if links.limit(1).count() else None


def links_in_block(sets: list[np.ndarray], percent: int, groups: np.ndarray | None = None) -> np.ndarray:
    """The component of each set (the index of one member), linked where 100 * intersection >= percent * union.

    ``groups`` are components known before. Each look-up compares one set with all
    others through an inverted index. The component with the fewest sets left to look
    up goes first; when only one component has any, no link can be missing.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left: dict[int, list[int]] = {}
    for i in range(n):
        at = i if groups is None else int(np.flatnonzero(groups == groups[i])[0])
        parent[i] = at
        left.setdefault(at, []).append(i)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    unique, inverse = np.unique(values, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    posts = owner[by]
    starts = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(unique)))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    while sum(1 for v in left.values() if v) > 1:
        at = min((k for k, v in left.items() if v), key=lambda k: (len(left[k]), k))
        i = left[at].pop()
        own = inverse[first[i] : first[i + 1]]
        a, many = starts[own], starts[own + 1] - starts[own]
        total = int(many.sum())
        take = np.arange(total) + np.repeat(a - (np.cumsum(many) - many), many)
        shared = np.bincount(posts[take], minlength=n)
        for j in np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared)):
            x, y = root(i), root(int(j))
            if x != y:
                parent[y] = x
                left[x] = left.get(x, []) + left.pop(y, [])
    return np.array([root(i) for i in range(n)])


def _blocks(texts: DataFrame, keys: list[str], words: int, percent: int, known: bool = False) -> DataFrame:
    """keys, doc_id and the smallest id that a block's links join it to; blocks are bounded before they get here."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("doc_id").sort_values("doc_id").reset_index(drop=True)
        groups = links_in_block([shingles(t, words) for t in frame["text"]], percent, frame["group"].to_numpy() if known else None)
        heads = frame["doc_id"].groupby(groups).transform("min")
        return frame[keys].assign(doc_id=frame["doc_id"], head=heads)

    return texts.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {dict(texts.dtypes)[k]}" for k in keys) + ", doc_id long, head long")


def _candidates(classes: DataFrame) -> DataFrame:
    """node and component of the loose links among ``classes`` (doc_id, regions, values)."""
    placed = classes.select("doc_id", "values", F.posexplode("regions").alias("tree", "region"))
    cut = F.col("tree") * DEPTH
    forest = placed.select("tree", "region", "doc_id", F.concat(F.substr("values", cut + 1), F.substr("values", F.lit(1), cut)).alias("order"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = forest.repartitionByRange(parts, "tree", "region", "order").sortWithinPartitions("tree", "region", "order")
    runs = stored(ordered.mapInArrow(_runs, "a long, b long, tree int, region long"))
    links = runs.where("b IS NOT NULL").select("a", "b")
    loose = components(links)
    further = _large(runs.where("b IS NULL").select("tree", "region", F.col("a").alias("doc_id")), loose, classes)
    return loose if further is None else components(loose.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(further))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the groups of near copies among ``docs`` (doc_id, text).

    Documents are linked where their sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` per cent or more; a component is what links reach. kept
    marks the smallest id of each. A text of fewer words is one shingle; a null or empty
    text has none, is linked with nothing and is kept. Rows of equal doc_id count as one
    document. A row with a null doc_id is a document of its own, later in order than all
    others; where only such rows are copies of each other, component_id is null and one is
    kept. Further columns are ignored, an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed, top = with_keys(docs, repeated=False)
    docs = keyed.select(F.col("_key").alias("doc_id"), "doc.text")
    signed = stored(_signed(docs, words))
    classes = stored(signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "regions", "values")).alias("r")).select("digest", "r.*"))
    loose = _candidates(classes)
    members = stored(loose.join(classes.select(F.col("doc_id").alias("node"), "n_shingles"), "node").select("component", F.col("node").alias("doc_id"), "n_shingles"))
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"))
    # a candidate of several blocks has more than block_docs documents or block_shingles shingles, so few are sent to all tasks
    several = F.broadcast(sizes.where("blocks > 1"))
    dealt = members.join(several, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # the candidates are a share of all documents at every size, so both sides are always sorted by doc_id
    texts = stored(dealt.select("component", "block", "blocks", "doc_id").join(docs.hint("merge"), "doc_id"))
    inner = stored(_blocks(texts, ["component", "block", "blocks"], words, percent))
    links = inner.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    if texts.where("blocks > 1").limit(1).count():
        links = links.unionByName(_across(texts.where("blocks > 1"), inner.where("blocks > 1"), words, percent, block_docs))
    joined = components(links)
    of_class = classes.select("digest", F.col("doc_id").alias("node")).join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.withColumns({c: F.when(F.col(c) <= top, F.col(c)) for c in ("doc_id", "component_id")})


def _across(texts: DataFrame, heads: DataFrame, words: int, percent: int, block_docs: int) -> DataFrame:
    """Links between the blocks of the candidates that have several, from each document's ``heads`` in its own block."""
    hubs = heads.groupBy("component", "block", "head").agg(F.count("*").alias("n")).where("n > 1").select("component", F.col("head").alias("doc_id"))
    many = hubs.groupBy("component").agg(F.ceil(F.count("*") / block_docs).alias("parts"))
    of_hub = hubs.join(F.broadcast(many), "component").select("component", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("hub")), F.col("parts")).cast("int").alias("block"), "doc_id")
    hub_texts = of_hub.join(texts.select("doc_id", "text"), "doc_id")
    by_hub = _blocks(hub_texts, ["component", "block"], words, percent)
    found = heads.select(F.col("doc_id").alias("a"), F.col("head").alias("b")).unionByName(by_hub.select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    so_far = stored(heads.select("component", "block", "blocks", "doc_id").join(components(found).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "group"), "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id")))
    counts = so_far.groupBy("component", "group").agg(F.count("*").alias("n"))
    largest = counts.groupBy("component").agg(F.max(F.struct("n", "group")).alias("m")).select("component", F.col("m.group").alias("largest"))
    state = so_far.join(F.broadcast(largest), "component")
    # Those outside the largest component are dealt into parts of their own; each part meets every block of its
    # candidate once, so a block's texts are sent as often as there are parts, however the outsiders lie.
    outside = state.where("group <> largest")
    parts = outside.groupBy("component").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("parts"))
    dealt = outside.join(F.broadcast(parts), "component").select("component", "blocks", "group", "doc_id", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.col("parts")).cast("int").alias("asking"))
    rows = dealt.select("component", "asking", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "group", "doc_id")
    others = state.join(F.broadcast(parts), "component").select("component", F.explode(F.expr("sequence(0, parts - 1)")).alias("asking"), "block", "group", "doc_id")
    pairs = rows.unionByName(others).distinct().join(texts.select("doc_id", "text"), "doc_id")
    last = _blocks(pairs, ["component", "asking", "block"], words, percent, known=True)
    return so_far.select(F.col("doc_id").alias("a"), F.col("group").alias("b")).unionByName(last.select(F.col("doc_id").alias("a"), F.col("head").alias("b")))


SQL = r"""
    WITH w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
        JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
    r AS (
        WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
    FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id
"""
