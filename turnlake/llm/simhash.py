"""SimHash near-duplicates: fingerprints of word shingles, linked through shards of BK-trees.

Fingerprints that differ in at most r bits agree in some of any r + 2 bands of bits: two bands at least.
Each pair of bands is a shard key, so every link lies inside a shard and no fingerprint need meet
all others. The trees are not broadcast, as their size has no bound: both sides of a shard, tree and
queries, are dealt to the same task. A shard's distinct fingerprints form a BK-tree: a child hangs
below its parent under their Hamming distance, so a query at distance d follows only the edges d - r
to d + r. All trees of a task are built and searched together, level by level.

Copies share a fingerprint and count once. Links inside a task are cut to one per fingerprint, to the
smallest of those it is connected with there, before they go on to the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import column, settled, tidy, whole_partition
from turnlake.llm.components import components

SHINGLES_AT_ONCE = 100_000
PAIRS_AT_ONCE = 2_000_000


def _bit_sums(hashes: list[int] | np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each document (``sizes`` hashes each, none empty), how many hashes have each bit; highest first."""
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def shingle_hashes(text: str, width: int, seed: int) -> Iterator[list[int]]:
    """XXH64 of every shingle of a text, in lists of bounded length."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    width = min(width, len(words))
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    for i in range(0, len(first), SHINGLES_AT_ONCE):
        yield [digest(whole[a:b], seed) for a, b in zip(first[i:i + SHINGLES_AT_ONCE], last[i:i + SHINGLES_AT_ONCE])]


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (long): a bit is set if over half the shingle hashes have it."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            rows: list[int] = []
            hashes: list[int] = []
            sizes: list[int] = []

            def flush() -> None:
                if rows:
                    over = 2 * _bit_sums(hashes, sizes) > np.array(sizes)[:, None]
                    out[rows] = np.packbits(over, axis=1).reshape(-1).view(">u8")
                    for kept in (rows, hashes, sizes):
                        kept.clear()

            for row, text in enumerate(batch.column("text")):
                pieces = list_of_two(shingle_hashes(text.as_py() or "", width, seed))
                if isinstance(pieces, list):
                    if pieces:
                        rows.append(row)
                        hashes.extend(pieces)
                        sizes.append(len(pieces))
                    if len(hashes) >= SHINGLES_AT_ONCE:
                        flush()
                    continue
                total, n = np.zeros(64, dtype=np.int64), 0
                for piece in pieces:
                    total += _bit_sums(piece, [len(piece)])[0]
                    n += len(piece)
                out[row] = np.packbits(2 * total > n).view(">u8")[0]
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fingerprint long")


def list_of_two(pieces: Iterator[list[int]]) -> list[int] | Iterator[list[int]]:
    """The one list of a text of ordinary length, or all lists of a very long one as they come."""
    first = next(pieces, [])
    second = next(pieces, None)
    if second is None:
        return first

    def rest() -> Iterator[list[int]]:
        yield first
        yield second
        yield from pieces
    return rest()


class Forest:
    """BK-trees of many shards. ``shard`` numbers the shards from 0; values of a shard are distinct."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        self.shard, self.value = shard, value
        place, item = shard.astype(np.int64), np.arange(len(value))
        parent = np.full(int(shard.max()) + 1 if len(shard) else 0, -1, np.int64)
        edge = np.zeros(len(parent), np.int64)
        nodes, parents, edges = [], [], []
        made = 0
        while len(item):
            order = np.argsort(place, kind="stable")
            place, item = place[order], item[order]
            first = np.concatenate(([True], place[1:] != place[:-1]))
            run = np.cumsum(first) - 1
            nodes.append(item[first])
            parents.append(parent[place[first]])
            edges.append(edge[place[first]])
            rest = ~first
            d = np.bitwise_count(value[item[rest]] ^ value[item[first]][run[rest]]).astype(np.int64)
            spot, place = np.unique((made + run[rest]) * 65 + d, return_inverse=True)
            parent, edge = spot // 65, spot % 65
            made += int(first.sum())
            item = item[rest]
        self.node_item = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        parents = np.concatenate(parents) if nodes else np.zeros(0, np.int64)
        edges = np.concatenate(edges) if nodes else np.zeros(0, np.int64)
        self.roots = np.flatnonzero(parents < 0)  # in the order of the shards
        below = np.flatnonzero(parents >= 0)
        code = parents[below] * 65 + edges[below]
        order = np.argsort(code)
        self.child_code, self.child = code[order], below[order]

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of item numbers of the same shard within the radius, each once or twice."""
        sizes = np.bincount(self.shard, minlength=len(self.roots))
        upto = np.cumsum(sizes[self.shard])
        start = 0
        while start < len(self.value):
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE)))
            query = np.arange(start, min(end, len(self.value)))
            node = self.roots[self.shard[query]]
            while len(query):
                other = self.node_item[node]
                d = np.bitwise_count(self.value[query] ^ self.value[other]).astype(np.int64)
                hit = (d <= radius) & (other != query)
                if hit.any():
                    yield query[hit], other[hit]
                low = np.searchsorted(self.child_code, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.child_code, node * 65 + np.minimum(d + radius, 64), side="right")
                n = high - low
                query = np.repeat(query, n)
                node = self.child[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            start = end


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest item each is connected with) after ``a`` and ``b`` are tied pairwise."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def merged_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each item the smallest item it is connected with."""
    label = np.arange(n)
    for a, b in pairs:
        label = joined(label, a, b)
    return label


def bands(radius: int) -> list[tuple[int, int]]:
    """``radius + 2`` bands of the 64 bits as (shift, mask)."""
    n, out, at = radius + 2, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append((at, (1 << width) - 1))
        at += width
    return out


def links(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (fingerprint: long, distinct) to links (a, b) that connect all within the radius."""
    value = F.col("fingerprint")

    def band(at: int, mask: int):
        return F.shiftrightunsigned(value, at).bitwiseAND(F.lit(mask))

    keys = [F.xxhash64(F.lit(i), band(*a), band(*b)) for i, (a, b) in enumerate(combinations(bands(radius), 2))]
    dealt = prints.select("fingerprint", F.explode(F.array(*keys)).alias("shard")).repartition("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_partition(batches)
        if table is None:
            return
        key, prints = column(table, "shard"), column(table, "fingerprint").view(np.uint64)
        order = np.lexsort((prints, key))
        key, prints = key[order], prints[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        shard = np.cumsum(first) - 1
        shared = np.bincount(shard)[shard] > 1
        _, shard = np.unique(shard[shared], return_inverse=True)
        prints = prints[shared]
        forest = Forest(shard, prints)
        label = merged_labels(len(prints), forest.near(radius))
        tied = label != np.arange(len(prints))
        pairs = np.unique(np.stack([prints[tied], prints[label[tied]]]).view(np.int64), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return dealt.mapInArrow(search, "a long, b long").distinct()


def grouped(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Per document: doc_id, fingerprint (long) and component_id, the smallest doc_id reachable.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts have fingerprint
    zero and are linked by it like any other. Texts of fewer than ``width`` words are one shingle.
    Repeated rows are returned as often as they come. A null doc_id is never the smallest, but
    its row is grouped; a group of null ids only has a null component.
    """
    prints = settled(fingerprints(docs, width, seed), "simhash")
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"))
    roots = components(links(own.select("fingerprint"), radius))
    groups = own.join(roots, own["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root"))
    ids = groups.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = groups.join(ids, "_root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_of(fingerprint):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ------------------------------------------------------------------------------- by similarity of shingle sets
CELLS_AT_ONCE = 300_000
CLUSTER_ITEMS = 4_000


def prefix_length(n, similarity: float):
    """How many of a set's ``n`` shingles, first in an order common to all sets, hold one of any similar set.

    Sets alike to ``similarity`` share at least that part of either; were none of the shared among the
    first n - ceil(similarity * n) + 1, too few would be left.
    """
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xBB67AE8584CAA73B)


def shingle_set(text: str, width: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    parts = [np.unique(_mixed(np.array(piece, np.uint64))) for piece in shingle_hashes(text, width, seed)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def frequent_shingles(docs: DataFrame, width: int, one_in: int = 8, least: int = 2, most: int = 1 << 18) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a sample hold; they only rank last, so any choice is right."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)

    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py() or "", width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    counted = sample.select("text").mapInArrow(of, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least)
    found = [r[0] for r in counted.orderBy(F.desc("count"), "shingle").limit(most).collect()]
    return np.sort(np.array(found, dtype=np.int64).view(np.uint64))


def among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which ``values`` the sorted ``ranked`` holds."""
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values if len(ranked) else np.zeros(len(values), bool)


#: The part of all shingles, told by their hash, that are counted to see which texts stand alone.
COUNTED = 0.375


def shingle_rows(docs: DataFrame, frequent: np.ndarray, width: int, similarity: float, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint and mark (a hash of all shingles), both of the distinct shingles, slack (how many of them a similar
    text may lack) and cells, those to be counted: the part COUNTED without the frequent ones; m is their number."""
    bound = np.uint64(int(COUNTED * 2 ** 64))

    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, marks, slack, cells = [], [], [], [np.zeros(0, np.uint64)]
            for text in batch.column("text"):
                own = shingle_set(text.as_py() or "", width, seed)
                total = np.zeros(64, np.int64)
                for i in range(0, len(own), SHINGLES_AT_ONCE):
                    total += _bit_sums(own[i:i + SHINGLES_AT_ONCE], [len(own[i:i + SHINGLES_AT_ONCE])])[0]
                prints.append(np.packbits(2 * total > len(own)).view(">u8")[0])
                marks.append((own ^ (own >> np.uint64(31))).sum(dtype=np.uint64))
                slack.append(prefix_length(len(own), similarity) - 1)
                own = own[:np.searchsorted(own, bound)]
                cells.append(own[~among(own, frequent)])
            sizes = np.cumsum([len(c) for c in cells]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(slack, pa.int64()), pa.array(np.diff(sizes), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(cells).view(np.int64)))],
                ["doc_id", "fingerprint", "mark", "slack", "m", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fingerprint long, mark long, slack long, m long, cells array<long>")


def alone(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Marks of texts that no other text is similar to: more of their shingles are in no other text than ``slack`` allows.

    Which shingles are counted depends on the shingle only, so both sides of a pair count the same ones, and a lack among
    them is a lack of the whole. Frequent shingles are taken as held by others; what is shuffled is in few texts.
    Copies have one mark and do not count for each other. ``told``: the same rows where they are at hand, cells not needed.
    """
    one = Window.partitionBy("shingle")
    lacking = (F.min("mark").over(one) == F.max("mark").over(one)).cast("long")
    counted = rows.select("mark", F.explode("cells").alias("shingle")).select("mark", lacking.alias("lack")).groupBy("mark").agg(
        F.sum("lack").alias("lack"), F.count(F.lit(1)).alias("n"))
    limits = (rows if told is None else told).groupBy("mark").agg(F.min("slack").alias("slack"), F.min("m").alias("m"))
    # Each of a mark's copies brings its m cells.
    return counted.join(limits, "mark").filter("lack * m > slack * n").select("mark")


def shingle_sets(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``items`` (item) with size and body, the sorted shingles."""
    texts = docs.select("doc_id", "text").join(items, F.col("doc_id") == F.col("item")).select("item", "text")

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                bodies = [shingle_set(text.as_py() or "", width) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array([len(b) for b in bodies], pa.int64()),
                                                  pa.array([b.tobytes() for b in bodies], pa.binary())], ["item", "size", "body"])

    return texts.mapInArrow(sets, "item long, size long, body binary")


def prefixes(sets: DataFrame, frequent: np.ndarray, similarity: float) -> DataFrame:
    """item, size and shard, one row for each shingle of the set's prefix."""
    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros(0, np.uint64)]
            for body in batch.column("body"):
                own = np.frombuffer(body.as_py(), np.uint64)
                common = among(own, frequent)
                keys.append(np.concatenate((own[~common], own[common]))[:prefix_length(len(own), similarity) if len(own) else 0])
            n = [len(k) for k in keys[1:]]
            item, size = (np.repeat(column(pa.Table.from_batches([batch]), name), n) for name in ("item", "size"))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(size), pa.array(np.concatenate(keys).view(np.int64))], ["item", "size", "shard"])

    return sets.mapInArrow(of, "item long, size long, shard long")


def similar_sets(shard: np.ndarray, first: np.ndarray, shingle: np.ndarray, similarity: float, label: np.ndarray | None = None) -> np.ndarray:
    """Labels that connect all sets of a shard with an exact Jaccard similarity of ``similarity`` or more.

    Set i holds ``shingle[first[i]:first[i + 1]]``, each once. Only sets that share a shingle of their prefixes,
    rarest in the shard first, can be similar. Those lists are walked member by member, so sets already
    connected, by ``label`` (smallest set each is known to be connected with) or on the way, meet no more.
    """
    count = len(shard)
    size = np.diff(first)
    owner = np.repeat(np.arange(count), size)
    order = np.lexsort((owner, shingle, shard[owner]))
    owner, value, home = owner[order], shingle[order], shard[owner[order]]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (home[1:] != home[:-1])
    cell = np.cumsum(new) - 1
    often = np.bincount(cell)[cell] if len(cell) else cell
    # Cells of each set from the rarest on.
    order = np.lexsort((cell, often, owner))
    place = np.arange(len(owner)) - first[owner[order]]
    used = order[(place < prefix_length(size, similarity)[owner[order]]) & (often[order] > 1)]
    used = used[np.lexsort((owner[used], cell[used]))]
    member, listed = owner[used], cell[used]
    several = often > 1
    width = int(cell[-1]) + 1 if len(cell) else 1
    codes = np.sort(owner[several] * width + cell[several])
    begin = np.searchsorted(codes, np.arange(count + 1) * width)
    common = np.diff(begin)
    label, failed, step = np.arange(count) if label is None else label, np.zeros(0, np.int64), 0
    while len(member):
        # Lists of one component have nothing more to say.
        lead = np.flatnonzero(np.concatenate(([True], listed[1:] != listed[:-1])))
        length = np.diff(np.concatenate((lead, [len(member)])))
        mixed = np.minimum.reduceat(label[member], lead) != np.maximum.reduceat(label[member], lead)
        alive = np.repeat(mixed & (length > step + 1), length)
        member, listed = member[alive], listed[alive]
        if not len(member):
            break
        length = length[mixed & (length > step + 1)]
        lead = np.cumsum(length) - length
        a = np.repeat(member[lead + step], length)
        later = np.arange(len(member)) - np.repeat(lead, length) > step
        a, b = a[later], member[later]
        fits = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
        code = np.unique(a[fits] * count + b[fits])
        code = code[~among(code, failed)]
        at, met = 0, [failed if len(failed) < PAIRS_AT_ONCE else failed[:0]]
        while at < len(code):
            # The pairs whose cells fit into one go, of those not connected meanwhile.
            a, b = np.divmod(code[at:at + 100_000], count)
            less = np.where(common[a] <= common[b], a, b)
            reach = max(1, int(np.searchsorted(np.cumsum(common[less]), CELLS_AT_ONCE, side="right")))
            a, b, less, at = a[:reach], b[:reach], less[:reach], at + min(reach, len(a))
            apart = label[a] != label[b]
            a, b, less = a[apart], b[apart], less[apart]
            if not len(a):
                continue
            n = common[less]
            pair = np.repeat(np.arange(len(a)), n)
            own = codes[np.repeat(begin[less] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            wanted = own + ((a + b - 2 * less) * width)[pair]
            hit = codes[np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)] == wanted
            both = np.bincount(pair, weights=hit, minlength=len(a)).astype(np.int64)
            alike = both / (size[a] + size[b] - both) >= similarity
            label = joined(label, a[alike], b[alike])
            met.append((a * count + b)[~alike])
        # Sorted runs, so this merges; a search in them costs no sort of all that failed.
        failed = np.sort(np.concatenate(met), kind="stable")
        step += 1
    return label


def whole_shards(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """Rows sorted by shard as tables of whole shards, of about ``at_once`` bytes unless a shard is larger."""
    held, size, limit = [], 0, at_once
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            table = pa.Table.from_batches(held)
            key = table.column("shard").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
            limit = max(at_once, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def clouds(items: DataFrame, radius: int) -> DataFrame:
    """item and cloud, for items whose fingerprints are equal or linked by the trees: the cloud is the smallest of them."""
    linked = components(links(items.select("fingerprint").distinct(), radius))
    placed = items.filter("item is not null").join(linked, items["fingerprint"] == linked["node"], "left").select(
        "item", F.coalesce("root", "fingerprint").alias("cloud")).distinct()
    return placed.join(placed.groupBy("cloud").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "cloud").select("item", "cloud", "n")


def found_in(dealt: DataFrame, similarity: float) -> DataFrame:
    """``dealt`` (item, group, shard, body) to links (a, b) that connect the similar items of each shard, b the smallest of
    them there. Items of one group are known to be connected."""
    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_shards(batches, 8 * CELLS_AT_ONCE):
            item, bodies = column(table, "item"), table.column("body").to_pylist()
            _, shard = np.unique(column(table, "shard"), return_inverse=True)
            _, group = np.unique(column(table, "group"), return_inverse=True)
            order = np.lexsort((item, shard))
            first = np.concatenate(([0], np.cumsum([len(bodies[i]) // 8 for i in order])))
            _, lead, place = np.unique(shard[order] * (int(group.max()) + 1) + group[order], return_index=True, return_inverse=True)
            label = similar_sets(shard[order], first, np.frombuffer(b"".join(bodies[i] for i in order), np.uint64), similarity, lead[place])
            item = item[order]
            tied = item != item[label]
            pairs = np.unique(np.stack([item[tied], item[label[tied]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long").distinct()


def tied(keys: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Items and shards where a neighbour by size is near enough to be similar; before: the next smaller item, if that is.
    Shards of one group (``known``: item and group, of items with others) have nothing more to say."""
    group = F.coalesce("group", "item")
    met = keys.join(known, "item", "left").groupBy("shard").agg(F.min(group).alias("low"), F.max(group).alias("high")).filter("low <> high")
    by_size = Window.partitionBy("shard").orderBy("size", "item")
    near = lambda small, big: F.coalesce(small >= similarity * big - 1e-9, F.lit(False))
    return keys.join(met.select("shard"), "shard").select(
        "item", "shard", F.lag("item").over(by_size).alias("before"), near(F.lag("size").over(by_size), F.col("size")).alias("down"),
        near(F.col("size"), F.lead("size").over(by_size)).alias("up")).filter("down or up").select(
        "item", "shard", F.when(F.col("down"), F.col("before")).alias("before"))


def similar_links(sets: DataFrame, known: DataFrame, frequent: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) that, with what is ``known`` (item and group), connect all similar items of ``sets``.

    Similar sets share a shard, a shingle of their prefixes, and are of similar size, so in each shard items are tied to the next
    smaller one if that is near enough. Tied items form clusters, and each goes to the place of its cluster once with its set. Clusters
    of more than CLUSTER_ITEMS go by their shards instead: one place for each shard, of shards with the same items one.
    """
    ties = settled(tied(prefixes(sets, frequent, similarity), known, similarity), "ties")
    roots = components(ties.filter("before is not null").select(F.col("item").alias("a"), F.col("before").alias("b")))
    large = settled(roots.groupBy("root").count().filter(F.col("count") > CLUSTER_ITEMS).select("root"), "large-clusters")
    small = roots.join(large, "root", "left_anti").select(F.col("node").alias("item"), F.array("root").alias("shards"))
    inside = ties.join(roots.join(large, "root", "left_semi").select(F.col("node").alias("item")), "item")
    h = F.xxhash64("item")
    kept = inside.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("item").alias("low"), F.max("item").alias("high"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("total"), F.bit_xor(h).alias("mix")).groupBy("n", "low", "high", "total", "mix").agg(
        F.min("shard").alias("shard")).select("shard")
    split = inside.join(kept, "shard").groupBy("item").agg(F.collect_set("shard").alias("shards"))
    wanted = settled(small.unionByName(split).join(known, "item", "left").select("item", F.coalesce("group", "item").alias("group"), "shards"), "wanted")
    return found_in(sets.join(wanted, "item").select("item", "group", F.explode("shards").alias("shard"), "body"), similarity)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Per document: doc_id and component_id, the smallest doc_id reachable over similar texts.

    Two texts are similar if their sets of ``width``-word shingles (as 64-bit hashes) have a Jaccard similarity of
    ``similarity`` or more, counted on the sets. First the trees: texts whose fingerprints are linked at ``radius`` bits form
    clouds, and in a cloud similarity is checked on the sets. Then what fingerprints miss: texts of different groups meet by shards,
    the shingles of their prefixes, and within a cluster of shards pairs are found the same way; so do clouds of more than CLUSTER_ITEMS.
    Texts too many of whose shingles no other text holds have no similar one and stay out of both checks.
    Texts with the same shingles are one item. Null and empty texts have none and are copies
    of each other; very long ones are taken whole. Rows of one doc_id are one document. A null doc_id is grouped but never the smallest. No rows
    give no rows.
    """
    frequent = frequent_shingles(docs, width)
    cells = shingle_rows(docs, frequent, width, similarity)
    # The cells are most of the rows' bytes: they are made once more where they are counted rather than written.
    rows = settled(cells.drop("cells"), "rows")
    same = ["fingerprint", "mark"]
    items = settled(rows.groupBy(*same).agg(F.min("doc_id").alias("item")), "items")
    left = settled(items.filter("item is not null").join(alone(cells, rows), "mark", "left_anti").select("item").distinct(), "left")
    sets = settled(shingle_sets(docs, left, width), "sets")
    near = clouds(items, radius).filter(F.col("n") <= CLUSTER_ITEMS).select("item", F.col("item").alias("group"), F.col("cloud").alias("shard"))
    by_trees = settled(found_in(near.join(sets, "item").select("item", "group", "shard", "body"), similarity), "by-trees")
    known = by_trees.groupBy(F.col("a").alias("item")).agg(F.min("b").alias("group"))
    # An id that names one item and has a row in another ties the two.
    copies = rows.join(items, same).filter("doc_id <> item").select(F.col("doc_id").alias("a"), F.col("item").alias("b"))
    again = copies.join(items.select(F.col("item").alias("a")), "a", "left_semi")
    roots = components(by_trees.unionByName(similar_links(sets, known, frequent, similarity)).unionByName(again))
    named = items.join(roots, items["item"] == roots["node"], "left").select(*same, F.coalesce("root", "item").alias("component_id"))
    return rows.select("doc_id", *same).join(named, same).select("doc_id", "fingerprint", "component_id")
