"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their hashes. Fragments cut it into
ranges, and every step works on fragments of sets:

* Candidates: two sets of similar size that link differ in at most D n-grams.
  Cut into D + 1 + SPARE fragments, they agree on a whole fragment, which need
  not be an empty one. Only sets that have a fragment in common meet; n-grams
  that are merely frequent bring nothing together.
* Within such a bucket a parity sketch bounds the difference of two sets from
  below. Of the pairs that the bound admits a bucket first proposes a spanning
  forest. Later rounds propose the few admitted pairs that are left between
  components, or again a forest where they are more than MOST_PER_NODE a node.
* Proposed pairs are counted exactly: overlaps fragment by fragment, summed per
  pair. Links join components; refuted pairs are not proposed again. Later rounds only
  see buckets that may have untried pairs left. Rounds end when none could join
  two components, so the components are those of all links.

Sets that are equal are one node throughout, however many documents have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels as K
from weft.llm.filters import FILTER_WORDS, may_match
from weft.llm.frames import NULL_ID, cut, mapped, table
from weft.llm.phrases import by_trigger, keyed
from weft.operators.components import connected_components

SPARE = 2  # fragments beyond D + 1: so many may be empty on both sides
COUNT_FRAGMENTS = 16  # of the exact count
SKETCH_BITS = 2  # least bits of a parity sketch per element; more only sharpen the bound
MOST_PER_NODE = 16  # pairs a bucket proposes at once; the others wait for later rounds
MOST_SIFTED = 16 * FILTER_WORDS  # documents for which the filter alone suffices: a quarter of the others pass it at most
_GROWTH = 1.5  # of the size classes
_NODES_HELD = 1 << 18  # that a task remembers to have cut into fragments
MOST_SHARED = 1 << 20  # names that two sets share; about n * n / 2 ** 65 of n sets do


def size_classes(num: int, den: int, largest: int = 1 << 34) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size classes and the number of fragments in each."""
    bounds = [1]
    while bounds[-1] < largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * _GROWTH)))
    bounds_ = np.array(bounds)
    most = 2 * (bounds_[1:] - 1)  # sizes of both sets together
    return bounds_, most * (den - num) // (den + num) + 1 + SPARE


def most_difference(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of two sets of so many elements together that link."""
    return sizes - 2 * -(-num * sizes // (num + den))


def document_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each document; with fewer words the hash of them all."""
    data = K.lower_ascii(data)
    starts, ends, first = K.word_bounds(data, offsets)
    sums = K.prefix_sums(K.word_hashes(data, starts, ends))
    grams = K.rolling_hashes(sums, n)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield K.slice_hashes(sums, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, np.uint64)


def _all_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    data, offsets = K.text_buffer(batch.column(batch.schema.get_field_index("text")))
    return [s for _, _, part, offs in K.document_chunks(data, offsets) for s in document_sets(part, offs, n)]


def _totals(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash per set, of its size and the sum of its elements' hashes."""
    if not sets:
        return np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in sets])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(np.concatenate(sets) + np.uint64(salt)))])
    ends = np.cumsum(sizes)
    return K.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


class Namer:
    """64-bit names of n-gram sets. Where two sets share one, as some do among billions, a second hash tells them apart."""

    def __init__(self, shared: list[int] | None = None, bits: int = 64):
        self.shared, self.shift = np.array(sorted(shared or []), np.int64), 64 - bits

    def first(self, sets: list[np.ndarray]) -> np.ndarray:
        return _totals(sets, 1) >> self.shift

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.settle(self.first(sets), lambda: _totals(sets, 2))

    def settle(self, names: np.ndarray, check: Callable[[], np.ndarray]) -> np.ndarray:
        if not len(self.shared) or not len(names):
            return names
        at = np.minimum(np.searchsorted(self.shared, names), len(self.shared) - 1)
        return np.where(self.shared[at] == names, K.mix(names.view(np.uint64) + K.mix(check().view(np.uint64), K._MIX_C)).view(np.int64), names)


def parity_sketch(s: np.ndarray) -> bytes:
    """A bit for each of at least SKETCH_BITS |s| classes of elements: whether s holds an odd number of the class."""
    bits = 1 << max(6, int(SKETCH_BITS * len(s) - 1).bit_length())
    odd = np.bincount((K.mix(s, K._MIX_C) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fragment_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of every fragment of every size class that the set takes part in."""
    bounds, fragments = size_classes(num, den)
    sizes = np.array([len(s) for s in sets])
    home = np.searchsorted(bounds, sizes, "right") - 1
    who, what = [], []
    step = 0
    while True:
        level = home + step
        some = np.flatnonzero((sizes > 0) & ((step == 0) | (sizes * den >= bounds[level] * num)))
        if not len(some):
            return (np.concatenate(who), np.concatenate(what)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        values = np.concatenate([sets[i] for i in some])
        owner = np.repeat(np.arange(len(some)), sizes[some])
        count = fragments[level[some]]
        base = np.concatenate([[0], np.cumsum(count)])
        at = base[owner] + ((values >> np.uint64(32)) * count[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content = np.add.reduceat(K.mix(values), edge)
        at = at[edge]
        of = owner[edge]
        empty = np.diff(np.append(np.searchsorted(of, np.arange(len(some))), len(of))) < count - SPARE
        if empty.any():  # sets with more than SPARE empty fragments also match on those
            bare = np.setdiff1d(np.concatenate([np.arange(base[i], base[i + 1]) for i in np.flatnonzero(empty)]), at)
            at, content = np.concatenate([at, bare]), np.concatenate([content, np.zeros(len(bare), np.uint64)])
            of = np.searchsorted(base, at, "right") - 1
        place = (level[some][of] << 40) + at - base[of]
        who.append(some[of])
        what.append(K.mix(K.mix(content) + K.mix(place.astype(np.uint64), K._MIX_C)).view(np.int64))
        step += 1


def _describe(rows: DataFrame, n: int, namer: Namer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _all_sets(batch, n)
            size = np.array([len(s) for s in sets], np.int64)
            node, check = (pa.array(x, mask=size == 0) for x in (namer.first(sets), _totals(sets, 2)))
            sketch = pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), node, check, sketch], names=["did", "n", "node", "check", "sketch"])

    return rows.select("did", "text").transform(mapped, run, "did long, n long, node long, check long, sketch binary")


def _settled(described: DataFrame, namer: Namer) -> DataFrame:
    """described with the names that tell all its sets apart."""
    if not len(namer.shared):
        return described

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check = batch.column(2), batch.column(3)
            names = namer.settle(np.asarray(node.fill_null(0)), lambda c=check: np.asarray(c.fill_null(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, mask=np.asarray(node.is_null())), *batch.columns[3:]], names=batch.schema.names)

    return described.transform(mapped, run, described.schema)


def _fragments(rows: DataFrame, n: int, num: int, den: int, namer: Namer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task emits a node once
        for batch in batches:
            sets = _all_sets(batch, n)
            nodes = namer.of(sets)
            new = []
            for i, node in enumerate(nodes.tolist()):
                if len(sets[i]) and node not in seen:
                    seen.add(node)
                    new.append(i)
            for k in range(0, len(new), 512):
                part = new[k : k + 512]
                who, key = fragment_keys([sets[i] for i in part], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[part][who])], names=["key", "node"])
            if len(seen) > _NODES_HELD:  # _buckets drops those that come again
                seen.clear()

    return rows.select("text").transform(mapped, run, "key long, node long")


def _buckets(keys: DataFrame) -> DataFrame:
    """(bucket, node) of the keys that two nodes share; buckets of the same nodes are one."""

    def group(t: pa.Table) -> pa.Table | None:
        key, node = (t.column(i).to_numpy() for i in (0, 1))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        total = K.mix(np.add.reduceat(K.mix(node.view(np.uint64)), first)).view(np.int64)
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        return pa.table([np.repeat(total, size)[keep], node[keep]], names=["bucket", "node"])

    sorted_keys = keys.repartition("key").sortWithinPartitions("key")
    return sorted_keys.transform(mapped, lambda it: by_trigger(it, "key", group), "bucket long, node long").distinct()


def _propose(buckets: DataFrame, known: DataFrame, state: DataFrame, num: int, den: int, first: bool) -> DataFrame:
    """(a, b): pairs of each bucket that the sketches admit and that would join two components; (null, bucket): buckets to see again.

    A bucket is done when all pairs that it admits are tried or proposed. The
    sketches only travel to buckets that hold two components: at first all do.
    """
    if not first:
        of = buckets.join(state.select("node", "comp"), "node").groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        buckets = cut(buckets.join(of.where("lo <> hi").select("bucket"), "bucket", "left_semi"))

    def forest(t: pa.Table) -> pa.Table | None:
        bucket, node, comp, n = (t.column(c).to_numpy() for c in ("bucket", "node", "comp", "n"))
        sketch, refuted = t.column("sketch"), t.column("refuted")
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        out = []
        for i, j in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            if (comp[i:j] != comp[i]).any():
                bad = [set(x) if x else None for x in refuted.slice(i, j - i).to_pylist()]
                given = (node[i:j], comp[i:j], n[i:j], fold(sketch.slice(i, j - i).to_pylist()), bad, num, den)
                pairs = None if first else bucket_pairs(*given)
                if pairs is None:
                    pairs = bucket_forest(*given)
                    if pairs and j - i > 2:
                        out.append((None, int(bucket[i])))
                out.extend(pairs)
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"]) if out else None

    rows = buckets.join(state, "node").join(known, "node").select("bucket", "node", "comp", "n", "sketch", "refuted")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "n", "node")
    return rows.transform(mapped, lambda it: by_trigger(it, "bucket", forest), "a long, b long").distinct()


def fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, the smallest, as rows of 64-bit words."""
    width = min(map(len, sketches))
    folded = []
    for s in sketches:
        x = np.frombuffer(s, np.uint8)
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        folded.append(x)
    return np.stack(folded).view(np.uint64)


def bucket_pairs(node, comp, n, bits, refuted, num: int, den: int) -> list[tuple[int, int]] | None:
    """All admitted untried pairs between components; None if they are more than MOST_PER_NODE a node."""
    out: list[tuple[int, int]] = []
    for x in range(len(node) - 1):
        far = np.bitwise_count(bits[x + 1 :] ^ bits[x]).sum(1, dtype=np.int64)
        hit = x + 1 + np.flatnonzero((far <= most_difference(n[x + 1 :] + n[x], num, den)) & (comp[x + 1 :] != comp[x]))
        out.extend((min(a, b), max(a, b)) for a, b in ((int(node[x]), int(node[y])) for y in hit) if not (refuted[x] and b in refuted[x]))
        if len(out) > MOST_PER_NODE * len(node):
            return None
    return out


def bucket_forest(node, comp, n, bits, refuted, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the admitted untried pairs over the components."""
    reached = np.zeros(len(node), bool)
    out = []
    for strict in (True, False):  # likely links first, then all that the bound admits
        reached[:] = False
        labels = comp.copy()
        for a, b in out:  # what is proposed counts as joined
            labels[labels == labels[node == b][0]] = labels[node == a][0]
        for start in range(len(node)):
            if reached[start]:
                continue
            queue = np.flatnonzero(labels == labels[start]).tolist()
            reached[queue] = True
            while queue and not reached.all():
                x = queue.pop()
                rest = np.flatnonzero(~reached)
                far = np.bitwise_count(bits[rest] ^ bits[x]).sum(1, dtype=np.int64)
                room = most_difference(n[rest] + n[x], num, den)
                hit = rest[far <= (room * 3 // 4 if strict else room)]
                if refuted[x]:
                    hit = hit[[int(v) not in refuted[x] for v in node[hit]]]
                for y in hit.tolist():
                    if not reached[y]:
                        out.append((min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))))
                        more = np.flatnonzero((labels == labels[y]) & ~reached)
                        reached[more] = True
                        queue.extend(more.tolist())
    return out


def _verify(pairs: DataFrame, rows: DataFrame, described: DataFrame, n: int, num: int, den: int, namer: Namer) -> DataFrame:
    """(a, b, linked): overlaps counted fragment by fragment and summed per pair."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    holders = cut(described.join(ends, "node").groupBy("node").agg(F.min(F.struct("did", "n")).alias("one")).select("node", "one.did", "one.n"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _all_sets(batch, n)
            nodes = namer.of(sets)
            out = []
            for s, node in zip(sets, nodes, strict=True):
                if len(s):
                    cuts = np.searchsorted(s >> np.uint64(60), np.arange(COUNT_FRAGMENTS + 1))
                    out.extend((int(node), f, s[cuts[f] : cuts[f + 1]].view(np.int64)) for f in range(COUNT_FRAGMENTS) if cuts[f] < cuts[f + 1])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["node", "f", "grams"])

    wanted = holders.select("did").distinct()
    texts = may_match(rows.select("did", "text"), wanted, "did")
    if wanted.count() > MOST_SIFTED:  # the filter lets too many pass: texts move once to be joined
        texts = texts.join(wanted, "did", "left_semi")
    fetched = texts.select("text").transform(mapped, pieces, "node long, f int, grams array<long>")  # the join on node drops what the filter let pass
    fetched = cut(fetched.join(holders.select("node"), "node", "left_semi").dropDuplicates(["node", "f"]))
    left = pairs.join(fetched.withColumnsRenamed({"node": "a", "grams": "x"}), "a")
    both = left.join(fetched.withColumnsRenamed({"node": "b", "grams": "y"}), ["b", "f"])
    shared = both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("x", "y")).cast("long")).alias("both"))
    sized = pairs.join(holders.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(holders.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    common = F.coalesce("both", F.lit(0).cast("long"))
    return sized.join(shared, ["a", "b"], "left").select("a", "b", (common * den >= (F.col("na") + F.col("nb") - common) * num).alias("linked"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", node_bits: int = 64) -> DataFrame:
    """One row per input row: id, n_shingles (size of its n-gram set) and component_id.

    Rows link if den * |A & B| >= num * |A | B| for their sets of n-word
    shingles, lower-cased in ASCII; component_id is the smallest id reachable.
    Null or empty texts have no set and link with nothing. Null ids count as the
    smallest; rows that repeat an id are rows of their own. Other columns are
    ignored; an empty table gives no rows. node_bits below 64 makes the names of
    sets collide; they are still told apart.
    """
    rows = keyed(docs, id_col, text_col)
    described = cut(_describe(rows, n, Namer(bits=node_bits)))
    twice = described.groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 <> c1").limit(MOST_SHARED + 1)
    namer = Namer([r.node for r in twice.select("node").toLocalIterator()], node_bits)
    if len(namer.shared) > MOST_SHARED:
        raise ValueError("too many n-gram sets share a name")
    described = _settled(described, namer)
    buckets = cut(_buckets(_fragments(rows, n, num, den, namer)))
    members = buckets.select("node").distinct()
    known = cut(described.join(members, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    comps = known.select("node", F.col("node").alias("comp"))
    refuted = known.select("node", F.expr("cast(null as array<long>)").alias("refuted")).limit(0)
    tried = None
    while True:
        state = cut(comps.join(refuted, "node", "left"))
        proposed = cut(_propose(buckets, known, state, num, den, tried is None))
        pairs = proposed.where("a is not null")
        if pairs.isEmpty():
            break
        result = cut(_verify(pairs, rows, described, n, num, den, namer))
        tried = cut(result) if tried is None else cut(tried.unionByName(result))
        links = tried.where("linked")
        again = proposed.where("a is null").select(F.col("b").alias("bucket"))
        buckets = cut(buckets.join(again, "bucket", "left_semi"))
        joined = connected_components(links, "a", "b").withColumnsRenamed({"component": "comp"})
        comps = cut(known.select("node").join(joined, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
        no = tried.where("not linked")
        refuted = no.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(no.select(F.col("b").alias("node"), F.col("a").alias("other"))).groupBy("node").agg(F.collect_list("other").alias("refuted"))
    named = described.select("did", "n", "node")
    smallest = named.where("node is not null").groupBy("node").agg(F.min("did").alias("least")).join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    smallest = cut(smallest)
    ids = smallest.groupBy("comp").agg(F.min("least").alias("component"))
    by_node = cut(smallest.join(cut(ids), "comp").select("node", "component"))
    null = F.lit(NULL_ID)
    return named.join(by_node, "node", "left").select(F.nullif("did", null).alias(id_col), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "did"), null).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """op5: components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)
