"""Near-duplicate classes by an inverted join on MinHash signature coordinates.

Documents with the same set of word shingles are one node. A node's signature has COORDINATES coordinates, each
of RUN minima read together; a coordinate and its value are a token, and nodes with at least MATCHES tokens in
common are candidates. (One minimum alone is often that of a frequent shingle, and the more so the larger the corpus.)
Prefix: tokens are ordered from rare to frequent, and a node is posted only under its first COORDINATES - MATCHES + 1.
Two candidates always meet under one of these; a node whose prefix holds only tokens of its own has no candidate at all.
Merging: the lists of a node are joined through their hubs, the members whose tokens are the most frequent,
so nobody lists the pairs of a list. Skip: the tokens outside the prefix are read from the two signatures
only when a pair has met. Pairs that collide in MATCHES coordinates are confirmed on full sets and merged.
In a list whose members, hub aside, still are of several components, those outside its largest component are
compared with all others in blocks, first by signatures, which leaves members that collide with one of another component,
then by sets, and what is close is confirmed on full sets too; pairs that are connected already
are skipped. So no link between candidates is left out, however long a list is.

Two texts with similarity 0.8 have fewer than MATCHES collisions once in 200,000 pairs, others less often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import materialize, slices, utf8
from almanac.operators.graph import components

RUN, COORDINATES, MATCHES = 2, 64, 24
#: Bytes of 32-bit sets in one block of a list, of the members outside its largest component and of all; rows of a block compared at once.
REST_BYTES, BLOCK_BYTES, TILE = 4 << 20, 8 << 20, (256, 1024)
#: The error allowed for 32-bit hashes when blocks are compared.
GRAIN_SLACK = 0.005
#: Words whose hashes a worker remembers.
CACHE_ENTRIES = 500_000

_seeds = np.random.default_rng(20260101).integers(1, 2**63, size=(2, RUN * COORDINATES), dtype=np.uint64)
_FACTOR, _SHIFT = (_seeds[0] | np.uint64(1))[:, None], _seeds[1][:, None]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z. With fewer words the whole sequence is one shingle; without words there is none."""
    found = utf8(text).lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    if len(_hashes) > CACHE_ENTRIES:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    size = min(words, n)
    rolled = np.full(n - size + 1, size if n < words else 0, np.uint64)
    for j in range(size):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
    return np.unique(rolled)


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def signature(found: np.ndarray) -> np.ndarray:
    """32 bits of each coordinate over a non-empty set."""
    least = np.full(RUN * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[None, at : at + 4096] * _FACTOR + _SHIFT).min(axis=1), out=least)
    value = np.zeros(COORDINATES, np.uint64)
    for run in least.reshape(RUN, COORDINATES):
        value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + run)
    return (value >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, node, marks`` per row; the last two are null for an empty set. ``marks`` is the signature."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            sizes, nodes, marks = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                marks.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "node", "marks"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, marks array<int>")


def prefixes(nodes: DataFrame) -> DataFrame:
    """``node, tokens, weight`` of the nodes that may have a candidate: the tokens of the prefix that other nodes have too, and how frequent all its tokens are.

    A token is the coordinate and 32 bits of its value. ``n`` orders tokens from rare to frequent, the token itself breaks ties.
    """
    tokens = nodes.select("node", F.posexplode("marks").alias("i", "v")).select("node", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND((1 << 32) - 1)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A node has at most COORDINATES rows here.
    own = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"), F.sum("n").alias("weight"))
    return own.filter(F.size("held") >= MATCHES).select("node", F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1)).getField("token").alias("tokens"), "weight")


def _colliding(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures collide in MATCHES coordinates at least, with ``met``."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("marks").alias("ma")), "a").join(nodes.select(F.col("node").alias("b"), F.col("marks").alias("mb")), "b").select("a", "b", "met", "ma", "mb")

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES) for c in ("ma", "mb"))
                keep = pa.array((x == y).sum(axis=1) >= MATCHES)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "met")], names=["a", "b", "met"])

    return both.mapInArrow(run, "a long, b long, met long")


def _sets(nodes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``node, full, grains``: the sorted 64-bit shingle hashes of each of ``node, rep``, and their distinct 32-bit halves. Written."""
    # An id may come with several texts; the one wanted has the node's set.
    own = nodes.select("node", "rep").join(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")), "rep").select("node", "text")

    def run(batches):
        for batch in slices(batches):
            out = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(text, words)
                if len(found) and node_of(found) == node:
                    out.append((node, found.tobytes(), np.unique(found.astype(np.uint32)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["node", "full", "grains"])

    return materialize(own.mapInArrow(run, "node long, full binary, grains binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs that reach the similarity on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("full").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("full").alias("y")), "b").select("a", "b", "x", "y")
    part, whole = similarity

    def run(batches):
        for batch in slices(batches, 200):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                near = whole * min(len(x), len(y)) >= part * max(len(x), len(y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if near else 0
                keep.append(near and whole * shared >= part * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _close_pairs(rest: list[tuple], others: list[tuple], least: float, root: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs of ``(node, label, grains)`` of both lists with other labels and a similarity of ``least`` on 32-bit hashes, less GRAIN_SLACK.

    Of pairs surely above it only those that connect something new: ``root`` has the labels that are known to be connected.
    """
    sets = [np.frombuffer(r[2], np.uint32) for r in (*rest, *others)]
    sizes = np.array([len(x) for x in sets], np.float64)
    n, all_ = len(rest), len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(all_), sizes.astype(np.int64))
    shared = np.bincount(column)[column] > 1  # what only one member has is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, all_ - n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((all_, min(4096, width - at)), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        both += dense[:n] @ dense[n:].T
    similar = both / np.maximum(sizes[:n, None] + sizes[None, n:] - both, 1)
    x, y = np.nonzero(similar >= least - GRAIN_SLACK)

    def find(v: int) -> int:
        while root.get(v, v) != v:
            v = root[v]
        return v

    found = []
    for i, j in sorted(zip(x.tolist(), y.tolist()), key=lambda p: -similar[p]):
        u, v = find(rest[i][1]), find(others[j][1])
        if u != v:
            found.append((rest[i][0], others[j][0]))
            if similar[i, j] >= least + GRAIN_SLACK:
                root[max(u, v)] = min(u, v)
    return found


def _parted(placed: DataFrame) -> DataFrame:
    """The members ``token, node, label, bytes`` of lists with several labels, with the most frequent label and the numbers of blocks of the rest and of all."""
    by_label = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    lists = by_label.groupBy("token").agg(F.max_by(F.struct("label", "bytes"), F.struct("n", "label")).alias("most"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda b, size: F.ceil(b / size).cast("int")
    lists = lists.select("token", F.col("most.label").alias("top"), blocks(F.col("bytes") - F.col("most.bytes"), REST_BYTES).alias("n_rest"), blocks(F.col("bytes"), BLOCK_BYTES).alias("n_all"))
    return placed.drop("bytes").join(lists, "token")


def _bytes(nodes: DataFrame) -> DataFrame:
    """``node, data``: one byte of each coordinate."""

    def run(batches):
        for batch in slices(batches):
            marks = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in marks], pa.binary())], names=["node", "data"])

    return nodes.select("node", "marks").mapInArrow(run, "node long, data binary")


def _blocks(members: DataFrame, data: DataFrame, compare) -> DataFrame:
    """What ``compare(rest, others, root)`` gives for the members ``token, node, label, top, n_rest, n_all`` of lists, with ``node, data``.

    ``rest``: members whose label is not the list's ``top``; ``others``: all members. Each kind is dealt into blocks of
    bounded bytes; a block of one meets a block of the other in one task. ``compare`` gets lists of ``(node, label, data)``
    and a dictionary that lasts for the block, and returns tuples that begin with the list's token.
    """
    own = members.join(data, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = own.filter("label <> top").select("token", deal(F.col("n_rest")).alias("i"), every("n_all").alias("j"), F.lit(0).alias("kind"), "node", "label", "data")
    others = own.select("token", every("n_rest").alias("i"), deal(F.col("n_all")).alias("j"), F.lit(1).alias("kind"), "node", "label", "data")
    ordered = rest.unionByName(others).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "kind")

    def run(batches):
        key, rest, others, root = None, [], [], {}

        def answer():
            found = []
            if rest and others:
                for at in range(0, len(rest), TILE[0]):
                    found += compare(rest[at : at + TILE[0]], others, root)
            others.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), *(pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))], names=["token", "a", "b"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if others:
                        yield answer()
                    key, root = row[:3], {}
                    rest.clear()
                (others if row[3] else rest).append(row[4:])
                if len(others) == TILE[1]:
                    yield answer()
        if others:
            yield answer()

    return ordered.mapInArrow(run, "token long, a long, b long")


def _meeting(rest: list[tuple], others: list[tuple], root: dict) -> list[tuple[int, int]]:
    """The members that collide in MATCHES coordinates with one of another label, each once, with themselves: as many rows as members at most."""
    x, y = (np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, COORDINATES) for rows in (rest, others))
    apart = np.array([r[1] for r in rest])[:, None] != np.array([r[1] for r in others])[None]
    count = np.zeros(apart.shape, np.uint8)
    for c in range(COORDINATES):
        count += x[:, c, None] == y[None, :, c]
    meet = apart & (count >= MATCHES)
    found = {rest[i][0] for i in np.flatnonzero(meet.any(axis=1))} | {others[j][0] for j in np.flatnonzero(meet.any(axis=0))}
    new = found - root.keys()
    root.update(dict.fromkeys(new))
    return [(n, n) for n in sorted(new)]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two rows are linked when ``similarity[1] * intersection >= similarity[0] * union`` of their
    shingle sets (0.8 at least: MATCHES is set for it). ``component_id`` is the smallest doc_id
    reachable by links, the row's own included; ``kept`` marks rows whose id it is. Null and empty
    texts, or texts without words, have an empty set and are linked with nothing. Rows with a null id take no part in
    links: their component is null and they are kept. Rows alike in id and set get the
    same answer; an id that comes with several sets gets an answer for each. An empty table gives
    no rows. Other columns are not read. Nodes are 64-bit hashes of sets.
    """
    part, whole = similarity
    if part * 10 < whole * 8:
        raise ValueError("signatures are laid out for similarities of 0.8 or more")
    rows = materialize(sketch(docs, words, id_col, text_col), "sketch")
    every = materialize(rows.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("marks").alias("marks")), "nodes")
    nodes = materialize(every.join(prefixes(every), "node"), "prefixes")
    posts = nodes.select(F.explode("tokens").alias("token"), "node", "weight")
    lists = posts.groupBy("token").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    held = materialize(posts.drop("weight").join(lists, "token").filter("node <> hub"), "lists")
    star = held.groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    close = materialize(_colliding(star, nodes), "close")
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    known = nodes.select("node", "rep")
    sets = _sets(known.join(ends, "node", "left_semi"), docs, words, id_col, text_col)
    # The hub met in most lists first; others only where that leaves nodes apart.
    first = close.groupBy("a").agg(F.max_by("b", F.struct("met", "b")).alias("b"))
    links = materialize(_confirmed(first, sets, similarity), "links")
    labels = components(links)
    more = materialize(_confirmed(_apart(close, labels).join(first, ["a", "b"], "left_anti"), sets, similarity), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = components(links)

    # Lists whose members, hub aside, are still in several components: first the members that collide with another component's.
    placed = held.select("token", "node").join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    members = materialize(_parted(placed.withColumn("bytes", F.lit(COORDINATES))), "parted")
    met = materialize(_blocks(members, _bytes(nodes), _meeting).select("token", F.col("a").alias("node")).distinct(), "met") if members.limit(1).count() else None
    if met is not None and met.limit(1).count():
        wanted = known.join(met.select("node").distinct(), "node", "left_semi")
        sets = sets.unionByName(_sets(wanted.join(sets.select("node"), "node", "left_anti"), docs, words, id_col, text_col))
        grains = sets.select("node", F.col("grains").alias("data"))
        members = materialize(_parted(members.select("token", "node", "label").join(met, ["token", "node"]).join(grains.select("node", F.length("data").alias("bytes")), "node")), "parted")
        least = part / whole
        near = _blocks(members, grains, lambda rest, others, root: _close_pairs(rest, others, least, root))
        near = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
        more = materialize(_confirmed(near, sets, similarity), "links")
        if more.limit(1).count():
            labels = components(links.unionByName(more))

    named = every.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Written first: the join's sides are then dealt by it alone, and Spark can split a large component.
    smallest = materialize(named.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    answer = materialize(named.join(smallest, "label").select("node", "component_id"), "answers")
    out = rows.select("doc_id", "n_shingles", "node").join(answer, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
