"""N-gram Jaccard join in prefix trees.

A document's set holds the distinct hashes of its word shingles in one global
order, that of the hash values. Two sets link when
`den * intersection >= num * union`.

1. Equal sets form one class, stood for by its least id.
2. Filter. A set with a link holds some of its partner's least members: with o
   members in common, the first n - o + k of either in the global order hold k of
   them. So sets of whose first members too few stand among another's leave.
   Only these members are counted, and each task sends a member once.
3. Dealing. Sets whose sizes can link fall into common size classes. Linked sets
   of a size class with largest size r differ in at most
   `H = floor((den - num) * 2 r / (den + num))` members. Dealing the hash values
   into H + 1 parts leaves one part in which linked sets are equal. The hash of
   each part is a key; sets with a common key are tied, and the components of
   the ties are families. No link leaves a family.
4. A family's sets are stored in a prefix tree and joined there: a traversal
   carries the overlap so far, which all sets below share, and leaves a subtree
   as soon as the members still to come on either side can't raise it to the
   threshold, or when all sets below already are in the seeker's component.
5. A family above `block_members` members of sets in all first loses the sets
   that can't link: too few of their members stand in any other set of it. What
   is left is tied anew. A family still above is dealt into blocks,
   each a tree of its own. The blocks' components are joined through one
   set of each; where a family then still has several components, the
   sets outside its largest component seek links in the blocks where other
   components hold enough of their first members. Blocks and
   lots of seekers are bounded, so no task holds an unbounded group.

The result has each row's component (the least id reachable by links). Copies
are never expanded into pairs. Hashes have 64 bits.

Defined cases: a null text, or one without words, has an empty set and is linked
with nothing; a text with fewer words than a shingle is one shingle; rows
with a null id are linked with nothing and have a null component; ids may have any
type that sorts; equal texts are one set, so ties and repeated rows make no pairs; a
very long text is one set in one task's memory; other columns are ignored, whatever
their names; an empty table gives no rows. Rows with one id and several texts are
each judged by their own text, and may join their components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .components import connected
from .storage import cut, numbered, write_table

BLOCK_MEMBERS = 30_000
#: Bytes of text to a shard of keys at most, and those from which on small inputs are
#: cut for the cores' sake; keys that a task holds before it sends them on.
SHARD_BYTES = 64 << 20
SMALL_SHARD_BYTES = 2 << 20
TIE_BUFFER = 1_000_000
#: Rows up to which a table of ids goes to every task, so that the texts it is joined with
#: stay where they are; beyond, both are dealt by id.
FEW_IDS = 1_000_000
#: One of so many members is looked for beyond the first that sets without a link may lack.
SPARE = 10
_STEP = 1.5
_PARTS = 64
_SEEK = ("family", "block", "lot", "doc_id", "component", "text")


def size_class(n: int, step: float = _STEP) -> int:
    """k with bounds[k] < n <= bounds[k + 1]."""
    k = max(0, int(math.log(max(n, 1), step)) - 1)
    while int(step**k) < n:
        k += 1
    return k


def keys_of(members: np.ndarray, num: int, den: int, step: float = _STEP) -> np.ndarray:
    """The keys of one sorted set in its own size class, and in each further one
    where a larger set may link with it.

    There are a few parts more than H + 1. A part without members is no key:
    linked sets still are equal in a part that has some, as long as either has no
    more empty parts than there are spare ones. Sets with more add their prefix:
    of linked sets, one of the n - ceil(num * n / den) + 1 first members of each
    is common.
    """
    n, out = len(members), []
    if not n:
        return np.zeros(0, np.uint64)
    own = size_class(n, step)
    if num <= 0:
        raise ValueError("the threshold must be above zero")
    classes = [own]
    while (int(step ** classes[-1]) + 1) * num <= n * den:
        classes.append(classes[-1] + 1)
    prefix = False
    for k in classes:
        largest = int(step**k)
        differ = (den - num) * 2 * largest // (den + num)
        most = (den - num) * (n + min(largest, n * den // num)) // (den + num)
        if most == 0:
            continue  # only equal sets link
        parts = differ + 2 + int(3 * differ * math.exp(-largest / (differ + 1)))
        part = ((members >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        # The wrapping sum of its mixed members stands for a part.
        total = np.zeros(parts, np.uint64)
        np.add.at(total, part, kernel.mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        label = np.arange(parts, dtype=np.uint64) + np.uint64(k << 40)
        filled = np.bincount(part, minlength=parts) > 0
        out.append(kernel.mix(total + kernel.mix(label))[filled])
        prefix |= int(filled.sum()) <= most
    if prefix:
        out.append(kernel.mix(members[: n + (-num * n // den) + 1] ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Trie:
    """A radix tree of sorted sets that joins them as they are stored.

    A node is [run of members, children by first member, sets that end here,
    least and greatest size of a set below, component of all sets below or -1
    where they may be several].
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.nodes: list[list] = [[np.zeros(0, np.uint64), {}, [], 1 << 60, 0, -1]]
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> int:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return min(i, j)

    def add(self, members: np.ndarray, component: int = -1) -> int:
        """Stores a set, as part of a stored set's component if one is given; its number."""
        number, n = len(self.parent), len(members)
        self.parent.append(number)
        self.sizes.append(n)
        if component >= 0:
            self.unite(component, number)
        nodes, node, at, path = self.nodes, 0, 0, [0]
        while at < n:
            children = nodes[node][1]
            child = children.get(int(members[at]))
            if child is None:
                nodes.append([members[at:], {}, [], 1 << 60, 0, number])
                node = children[int(members[at])] = len(nodes) - 1
                path.append(node)
                break
            run = nodes[child][0]
            m = min(len(run), n - at)
            same = run[:m] == members[at : at + m]
            agree = m if same.all() else int(np.argmin(same))
            if agree < len(run):  # the run is parted; a new node takes its beginning
                nodes.append([run[:agree], {int(run[agree]): child}, [], *nodes[child][3:]])
                nodes[child][0] = run[agree:]
                child = children[int(members[at])] = len(nodes) - 1
            node = child
            path.append(node)
            at += agree
        nodes[node][2].append(number)
        own = self.find(number)
        for p in path:
            x = nodes[p]
            x[3], x[4] = min(x[3], n), max(x[4], n)
            if x[5] >= 0 and self.find(x[5]) != own:
                x[5] = -1
        return number

    def relabel(self) -> None:
        """Finds anew which subtrees are of one component."""
        order = [0]
        for node in order:
            order.extend(self.nodes[node][1].values())
        for node in reversed(order):
            x = self.nodes[node]
            below = {self.find(e) for e in x[2]}
            for c in x[1].values():
                below.add(self.find(self.nodes[c][5]) if self.nodes[c][5] >= 0 else -1)
            x[5] = below.pop() if len(below) == 1 else -1

    def linked(self, members: np.ndarray, component: int = -1) -> Iterator[int]:
        """Stored sets that link with `members`, one at least of each component
        other than `component` that has any."""
        n, num, den = len(members), self.num, self.den
        low, high = -(-num * n // den), den * n // num
        seen = {self.find(component)} if component >= 0 else set()
        stack = [(0, 0, 0, 0)]
        while stack:
            node, at, depth, overlap = stack.pop()
            run, children, ends, least, most, label = self.nodes[node]
            if least > high or most < low or (label >= 0 and self.find(label) in seen):
                continue
            if len(run):
                stop = at + int(np.searchsorted(members[at:], run[-1], "right"))
                if stop > at:
                    own = members[at:stop]
                    spot = np.searchsorted(own, run)
                    spot[spot == len(own)] = 0
                    overlap += int(np.count_nonzero(own[spot] == run))
                at, depth = stop, depth + len(run)
            # What sets below, and what the seeker, have still to come bounds the overlap.
            reach = overlap + min(most - depth, n - at)
            if (den + num) * reach < num * (n + max(least, low, depth)):
                continue
            for e in ends:
                if (den + num) * overlap >= num * (n + self.sizes[e]) and self.find(e) not in seen:
                    seen.add(self.find(e))
                    yield e
            stack.extend((c, at, depth, overlap) for c in children.values())


def join_block(sets: list[np.ndarray], num: int, den: int, ids: list | None = None) -> list[int]:
    """For each set the number of the first set of its component. Sets with one
    id are one component."""
    trie = Trie(num, den)
    by_id: dict = {}
    for i, members in enumerate(sets):
        if i & (i - 1) == 0:  # as the tree doubles
            trie.relabel()
        component = by_id.get(ids[i], -1) if ids is not None else -1
        links = list(trie.linked(members, component))
        for e in links:
            component = e if component < 0 else trie.unite(component, e)
        number = trie.add(members, component)
        if ids is not None:
            by_id.setdefault(ids[i], number)
    return [trie.find(i) for i in range(len(sets))]


def _sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in kernel.chunks(texts):
        words, first = kernel.word_hashes(data, offsets)
        yield from kernel.run_shingles(words, first, width)


def _group_links(num: int, den: int, width: int):
    """Links within one block: (a, b) ids, a the first of b's component."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        sets = list(_sets_of(table.column("text").take(pa.array(order)), width))
        ids = ids[order]
        heads = join_block(sets, num, den, ids.tolist())
        return pa.table(
            {
                "family": table.column("family").take(pa.array(order)),
                "doc_id": pa.array(ids),
                "component": pa.array(ids[np.array(heads, np.int64)]),
            }
        )

    return run


def _seek_links(num: int, den: int, width: int):
    """Links from a lot of seekers to the stored sets of one block."""

    def run(key: tuple, stored: pa.Table, seekers: pa.Table) -> pa.Table:
        trie = Trie(num, den)
        ids, component_of = stored.column("doc_id").to_numpy(), stored.column("component").to_pylist()
        first_of: dict[int, int] = {}
        for c, members in zip(component_of, _sets_of(stored.column("text"), width), strict=True):
            number = trie.add(members, first_of.get(c, -1))
            first_of.setdefault(c, number)
        trie.relabel()
        out = set()
        own, theirs = seekers.column("doc_id").to_pylist(), seekers.column("component").to_pylist()
        for doc, c, members in zip(own, theirs, _sets_of(seekers.column("text"), width), strict=True):
            out.update((doc, int(ids[e])) for e in trie.linked(members, first_of.get(c, -1)))
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return run


def _signatures(members: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums of mixed members; equal sets have equal ones."""
    if not len(members):
        return np.uint64(0), np.uint64(0)
    return (
        np.add.reduce(kernel.mix(members ^ np.uint64(0x1234567))),
        np.add.reduce(kernel.mix(members + np.uint64(0x7654321))),
    )


def _tie(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its least node, and pairs that tie a key's other nodes to it."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    least = nodes[first][np.cumsum(first) - 1]
    other = nodes != least
    return keys[first], nodes[first], np.unique(np.stack([nodes[other], least[other]], 1), axis=0)


def _shards(texts: DataFrame, most: int = SHARD_BYTES) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / most), min(64, math.ceil(size / SMALL_SHARD_BYTES)))


def _sent(ids: DataFrame) -> DataFrame:
    """A table of ids, marked to go to every task where it has FEW_IDS rows at most."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def spare(n: int, num: int, den: int) -> int:
    """Members that a set's prefix has beyond the shortest."""
    return min(max(1, n // SPARE), -(-num * n // den))


def prefix_of(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first members of a sorted set. Of two linked sets' prefixes, as many are
    common as the lesser spare of both."""
    n = len(members)
    return members[: n + (-num * n // den) + spare(n, num, den)]


def _held_twice(hashes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes and nodes, sorted and without repeats, and whether another node has the hash."""
    order = np.lexsort((nodes, hashes))
    hashes, nodes = hashes[order], nodes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])
    hashes, nodes = hashes[new], nodes[new]
    twice = np.zeros(len(hashes), bool)
    same = hashes[1:] == hashes[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    return hashes, nodes, twice


def _shared(rows: DataFrame, sets, shards: int) -> DataFrame:
    """one, shared: by node, how many of its members another node has, or more.
    `sets` gives the members and the node of each row of a batch.

    Members go by shard, as 32 bits beside the shard's own: a collision lets more
    through. A member that several nodes of a task's buffer hold is counted there,
    and sent once without their names. What copies in several buffers count twice
    lets more through, too.
    """
    low = np.uint64((1 << 32) - 1)

    def send(held: list) -> pa.RecordBatch:
        hashes, nodes, twice = _held_twice(*(np.concatenate(x) for x in zip(*held, strict=True)))
        own, counts = np.unique(nodes[twice], return_counts=True)
        shard = ((hashes & low) * np.uint64(shards)) >> np.uint64(32)
        order = np.argsort(shard, kind="stable")
        shard, hashes, nodes, twice = shard[order], (hashes[order] >> np.uint64(32)).astype(np.uint32), nodes[order], twice[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        # Counts ride with the shards in turn.
        lots = np.array_split(np.stack([own, counts.astype(np.uint64)], 1), shards)
        out = []
        for i in range(shards):
            h, n, t = (x[cuts[i] : cuts[i + 1]] for x in (hashes, nodes, twice))
            if len(h) or len(lots[i]):
                out.append((i, h[~t].tobytes(), n[~t].tobytes(), np.unique(h[t]).tobytes(), lots[i].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        arrays = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["shard", "hashes", "nodes", "several", "counts"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for own, node in sets(batch):
                if len(own):
                    held.append((own, np.full(len(own), node)))
                    n += len(own)
                if n >= TIE_BUFFER:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        def of(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

        hashes, nodes, twice = _held_twice(of("hashes", np.uint32), of("nodes", np.uint64))
        several = np.unique(of("several", np.uint32))
        spot = np.searchsorted(several, hashes)
        inside = spot < len(several)
        twice[inside] |= several[spot[inside]] == hashes[inside]
        met, n = np.unique(nodes[twice], return_counts=True)
        own = of("counts", np.uint64).reshape(-1, 2)
        zeros = np.zeros
        return pa.table(
            {
                "one": pa.array(np.concatenate([met, own[:, 0]]).view(np.int64)),
                "met": pa.array(np.concatenate([n, zeros(len(own), n.dtype)]).astype(np.int64)),
                "own": pa.array(np.concatenate([zeros(len(met), np.int64), own[:, 1].astype(np.int64)])),
            }
        )

    packed = rows.mapInArrow(emit, "shard int, hashes binary, nodes binary, several binary, counts binary")
    found = packed.repartition(shards, "shard").groupBy("shard").applyInArrow(count, "one long, met long, own long")
    return found.groupBy("one").agg((F.sum("met") + F.max("own")).alias("shared"))


def _candidates(texts: DataFrame, classes: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """doc_id of the classes' representatives that may have a link, by the filter."""

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.uint64]]:
        for members in _sets_of(batch.column(0), width):
            yield prefix_of(members, num, den), _signatures(members)[0]

    found = _shared(texts.where("doc_id is not null").select("text"), sets, _shards(texts))
    return classes.join(found, "one").where(F.col("shared") >= _need(num, den)).select(F.col("rep").alias("doc_id")).distinct()


def _need(num: int, den: int) -> Column:
    """Members that the prefix of a set of n_shingles has in common with any linked one's."""
    lesser = F.ceil(F.col("n_shingles") * num / den)  # the smallest partner's size
    return F.least(F.greatest(F.lit(1), F.floor(lesser / SPARE)), F.ceil(lesser * num / den))


def _ties(texts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """u, v: pairs of nodes that connect all nodes with a common key; a node is the
    first signature of a text's set.

    Keys travel packed, by shard: a task sorts what it holds, ties the nodes of
    equal keys, and sends each key once, with its least node. So a key that very
    many sets have comes to its shard once from each task's buffer. Shards follow
    the texts' size.
    """
    shards = _shards(texts)

    def send(held: list) -> pa.RecordBatch:
        keys, nodes, pairs = _tie(*(np.concatenate(x) for x in zip(*held, strict=True)))
        shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        # Ties ride with the shards in turn.
        lots = np.array_split(pairs, shards)
        used = [i for i in range(shards) if cuts[i + 1] > cuts[i] or len(lots[i])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array([keys[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()),
                pa.array([nodes[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()),
                pa.array([lots[i].tobytes() for i in used], pa.binary()),
            ],
            ["shard", "keys", "nodes", "ties"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for members in _sets_of(batch.column(0), width):
                own = keys_of(members, num, den)
                if len(own):
                    held.append((own, np.full(len(own), _signatures(members)[0])))
                    n += len(own)
                if n >= TIE_BUFFER:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, nodes, ties = (
            np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column(c)]) for c in ("keys", "nodes", "ties")
        )
        pairs = np.unique(np.concatenate([_tie(keys, nodes)[2], ties.reshape(-1, 2)]), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0].copy().view(np.int64)), "v": pa.array(pairs[:, 1].copy().view(np.int64))})

    packed = texts.where("doc_id is not null").select("text").mapInArrow(emit, "shard int, keys binary, nodes binary, ties binary")
    return packed.repartition(shards, "shard").groupBy("shard").applyInArrow(merge, "u long, v long")


def _family_join(rows: DataFrame, of_family: DataFrame, how: str = "inner") -> DataFrame:
    """rows (family, doc_id, ...) joined with a table of one row a family, in parts: the
    rows of one family are no single task's."""
    spread = of_family.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(_PARTS)).cast("int"))
    return parted.join(spread, ["family", "part"], how).drop("part")


def _families(ties: DataFrame, classes: DataFrame, block_members: int) -> DataFrame:
    """doc_id, family, blocks, n_shingles, block of the classes' representatives
    that share a key with another class. Classes with one first signature are one
    node, which can only make a family larger."""
    families = connected(ties).withColumnsRenamed({"vertex": "one", "component": "family"})
    families = families.join(classes, "one").select("family", F.col("rep").alias("doc_id"), "n_shingles")
    blocks = families.groupBy("family").agg(F.ceil(F.sum("n_shingles") / F.lit(block_members)).cast("int").alias("blocks"))
    # Only large families are looked up.
    found = _family_join(families, blocks.where("blocks > 1"), "left")
    return found.withColumn("blocks", F.coalesce("blocks", F.lit(1))).select(
        "doc_id", "family", "blocks", "n_shingles", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    )


def _able(large: DataFrame, texts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """doc_id of the sets of large families that can have a link: a set's share of
    members that any other set of its family holds must reach the threshold. So
    sets that only have a passage in common leave."""

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.uint64]]:
        family, node = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
        for i, members in enumerate(_sets_of(batch.column(2), width)):
            yield kernel.mix(members + kernel.mix(family[i : i + 1])), node[i]

    held = texts.join(_sent(large.select("family", "doc_id")), "doc_id").select("family", "doc_id", "text")
    # Sets go whole: three times as many members as the filter's.
    found = _shared(held, sets, _shards(texts, SHARD_BYTES // 3)).withColumnRenamed("one", "doc_id")
    # An id in several rows counts all its texts' members, which lets more through.
    sizes = large.select("doc_id", "n_shingles")
    return found.join(sizes, "doc_id").where(F.col("shared") * den >= F.col("n_shingles") * num).select("doc_id").distinct()


def _sought(seekers: DataFrame, known: DataFrame, texts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """family, doc_id, component, n_shingles, block: seekers (family, doc_id, component,
    n_shingles) with the blocks of known sets (family, doc_id, component, block) where
    they may have a link, by the filter: sets of other components there hold enough of a
    seeker's prefix. A member is counted once a block, however many sets have it."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [prefix_of(members, num, den) for members in _sets_of(batch.column(4), width)]
            at = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
            members = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), pa.array(members)], ["family", "doc_id", "component", "block", "member"])

    rows = texts.join(_sent(known), "doc_id").select("family", "doc_id", "component", "block", "text")
    rows = write_table(rows.mapInArrow(prefixes, "family long, doc_id long, component long, block int, member long"), "prefixes")
    stored = rows.groupBy("family", "member", "block").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    # An id in several rows has all their members, which lets more through.
    own = seekers.groupBy("family", "doc_id", "component").agg(F.min("n_shingles").alias("n_shingles"))
    asked = rows.join(_sent(own.select("family", "doc_id")), ["family", "doc_id"], "left_semi").select("family", "member", "doc_id", "component")
    met = asked.join(stored, ["family", "member"]).where("least != component or most != component")
    met = met.groupBy("family", "doc_id", "block").agg(F.count("*").alias("met"))
    return met.join(own, ["family", "doc_id"]).where(F.col("met") >= _need(num, den)).drop("met")


def _components(docs: DataFrame, num: int, den: int, width: int, block_members: int) -> tuple[DataFrame, DataFrame]:
    """(row table with n_shingles and class, table of representatives and their components)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures = [], []
            for members in _sets_of(batch.column(1), width):
                sizes.append(len(members))
                signatures.append(_signatures(members))
            pairs = np.array(signatures, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                ["doc_id", "n_shingles", "one", "two"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = write_table(texts.mapInArrow(describe, "doc_id long, n_shingles long, one long, two long"), "sets")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = write_table(classes, "classes")
    able = cut(_candidates(texts, classes, num, den, width))
    texts = write_table(texts.join(_sent(able), "doc_id", "left_semi"), "candidates")
    families = cut(_families(_ties(texts, num, den, width), classes, block_members))
    large = families.where("blocks > 1")
    if not large.isEmpty():
        able = cut(_able(large, texts, num, den, width))
        again = _ties(texts.join(_sent(able), "doc_id", "left_semi"), num, den, width)
        families = cut(families.where("blocks = 1").unionByName(_families(again, classes, block_members)))
    weights = families.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    # Ids that stand in several rows bring all their texts.
    held = texts.join(_sent(families), "doc_id").select("family", "block", "blocks", "doc_id", "text")
    schema = "family long, doc_id long, component long"
    found = held.groupBy("family", "block").applyInArrow(_group_links(num, den, width), schema)
    found = write_table(found.distinct(), "links")
    split = families.where("blocks > 1").select("family").distinct()
    if split.isEmpty():
        own = found.groupBy("doc_id").agg(F.min("component").alias("component"))
        return rows, _with_classes(own, classes)

    # Families of several blocks. One set of each block's component meets the others'.
    links = [found.select(F.col("doc_id").alias("u"), F.col("component").alias("v"))]
    inner = _family_join(found, split, "left_semi")
    heads = inner.select("family", F.col("component").alias("doc_id")).distinct()
    heads = heads.join(weights, "doc_id")
    lots = heads.groupBy("family").agg(F.ceil(F.sum("n_shingles") / F.lit(block_members)).cast("int").alias("lots"))
    heads = _family_join(heads, lots).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("lots")).cast("int"))
    met = (
        texts.join(_sent(heads), "doc_id")
        .select("family", "block", "doc_id", "text")
        .groupBy("family", "block")
        .applyInArrow(_group_links(num, den, width), schema)
    )
    links.append(met.select(F.col("doc_id").alias("u"), F.col("component").alias("v")))
    edges = cut(links[0].union(links[1]).where("u != v"))
    now = cut(_labels(inner.select("doc_id", "family"), edges))
    # Sets outside their family's largest component seek links in its blocks.
    sizes = now.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("x")).select("family", F.col("x.component").alias("main"))
    seekers = _family_join(now, largest).where("component != main").join(families.select("doc_id", "n_shingles"), "doc_id")
    seekers = cut(seekers.select("family", "doc_id", "component", "n_shingles"))
    if not seekers.isEmpty():
        known = cut(now.join(families.where("blocks > 1").select("family", "doc_id", "block").distinct(), ["family", "doc_id"]))
        sought = cut(_sought(seekers, known, texts, num, den, width))
        lots = sought.groupBy("family", "block").agg(F.ceil(F.sum("n_shingles") / F.lit(block_members)).cast("int").alias("lots"))
        lots = _sent(cut(lots))
        sought = sought.join(lots, ["family", "block"]).withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("lots")).cast("int"))
        seek_rows = texts.join(_sent(sought), "doc_id").select("family", "block", "lot", "doc_id", "component", "text")
        stored = texts.join(_sent(known.join(lots, ["family", "block"])), "doc_id").select(
            "family", "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "doc_id", "component", "text"
        )
        # New names for the columns: both sides come from the same tables.
        stored, seek_rows = (x.select(*(F.col(c).alias(c) for c in _SEEK)) for x in (stored, seek_rows))
        more = (
            stored.groupBy("family", "block", "lot")
            .cogroup(seek_rows.groupBy("family", "block", "lot"))
            .applyInArrow(_seek_links(num, den, width), "u long, v long")
        )
        edges = cut(edges.union(more))
    final = connected(edges).select(F.col("vertex").alias("doc_id"), "component")
    return rows, _with_classes(final, classes)


def _labels(members: DataFrame, edges: DataFrame) -> DataFrame:
    own = connected(edges).withColumnRenamed("vertex", "doc_id")
    return members.distinct().join(own, "doc_id", "left").select(
        "doc_id", "family", F.coalesce("component", "doc_id").alias("component")
    )


def _with_classes(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Components of representatives, for every class."""
    return classes.join(found.where("doc_id != component").withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "one", "two", "n_shingles", "rep", F.coalesce("component", "rep").alias("component")
    )


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block_members: int = BLOCK_MEMBERS
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text). Ids that
    are no integers are numbered in their order first."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        docs = docs.select("doc_id", "text")
        ids = write_table(numbered(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id"), "ids")
        numbers = docs.join(ids, "doc_id", "left").select(F.col("n").alias("doc_id"), "text")
        found = jaccard_components(numbers, width, num, den, block_members).withColumnRenamed("doc_id", "n")
        names = ids.select(F.col("n").alias("component_id"), F.col("doc_id").alias("component"))
        named = found.join(ids, "n", "left").join(names, "component_id", "left")
        return named.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    rows, classes = _components(docs, num, den, width, block_members)
    out = rows.select("doc_id", "n_shingles", "one", "two").join(
        classes.select("one", "two", "n_shingles", F.col("component").alias("component_id")), ["one", "two", "n_shingles"], "left"
    )
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose component has a lesser id. Documents
    without words, and those with a null id, stay."""
    gone = jaccard_components(docs, **options).where("doc_id != component_id").select("doc_id").distinct()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"))
    gone = _sent(cut(gone.select(F.col("doc_id").alias("gone"))))
    return keyed.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
