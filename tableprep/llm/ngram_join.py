"""Exact Jaccard self-join of documents over word shingles, by size-banded tiles with bitmap signatures.

Two documents link when 100 * |A n B| >= 80 * |A u B| for their sets of distinct five-word shingles (as 64-bit hashes).

1. One pass over the texts leaves a thin row per document: set size, a digest of the set, a few minima of the set, a
   bitmap of about as many bits as shingles, and the set's prefix: of n shingles the n - ceil(0.8 n) + 1 first ones in a
   global order. Linked documents share a shingle of their prefixes, whatever the order. The order puts shingles that a
   sample of documents shows to be common last; the sample decides about speed, never about results.
2. Documents with equal sets become one representative.
3. Representatives that share a minimum are compared with the smallest of them: this ties large groups of near copies
   together with about as many comparisons as documents.
4. Rows (shingle, size, document, component) are dealt by shingle and sorted by size: the rows of a shingle are a tile.
   Tiles of one component have nothing to offer. A small tile gives its pairs of different components whose sizes fit.
   Rows of a large tile get their bitmaps. A tile of more than TILE_ROWS rows is cut into blocks, and every pair of blocks
   is a tile of its own, so a task never holds more than two blocks of one tile. Inside, size band by size band, bit counts
   bound each overlap from above, and only pairs with room for a link come out. Tiles of shingles that the sample shows to
   be common are counted before any row moves and go there at once; a tile that meets whole in one task is a rare one.
5. What is left is decided on the whole texts by intersecting the two sorted arrays. Union-find over all links gives the
   classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm import graph, shingles
from tableprep.llm.common import broadcast_if_small, drop, written

MINIMA = 8
#: Documents in the sample that finds common shingles, how often one must occur there, and how many are kept at most.
#: They only shape the global order of shingles.
SAMPLE, COMMON, MOST_COMMON = 3000, 4, 50_000
#: A tile of more rows compares bitmaps before it gives pairs.
SMALL_TILE = 12
#: Rows of a block of a large tile.
TILE_ROWS = 2_000
#: Id tables up to so many rows are broadcast (16 bytes a row); longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_XOR = (np.arange(MINIMA, dtype=np.uint64) << np.uint64(61)) ^ (shingles.seeds(MINIMA, 50) >> np.uint64(3))


def _needed(size: np.ndarray) -> np.ndarray:
    """The least overlap that a set can have with any linked one: ceil(0.8 n)."""
    return (4 * size + 4) // 5


def bitmap_bits(size: int) -> int:
    """A power of two, four to eight bits an element; sets of linked documents may differ by one power."""
    return 1 << max(6, int(size - 1).bit_length() + 2)


def _bitmap(values: np.ndarray, size: int) -> bytes:
    bits = bitmap_bits(size)
    flags = np.zeros(bits, bool)
    flags[(values >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded to the shorter's width: no more than elements differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        flags = np.unpackbits(x).reshape(len(y) * 8, -1).any(axis=1)
        x = np.packbits(flags)
    return int(np.bitwise_count(x ^ y).sum())


def _features(common: np.ndarray):
    """common: hashes sorted ascending, beside their rank in the global order (rarer first)."""
    table, rank = common
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("minima", pa.list_(pa.int64())), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, rows, sizes, values in shingles.sets(batch.column(1)):
                start = np.concatenate(([0], np.cumsum(sizes)))
                full = np.flatnonzero(sizes)
                lo = start[full]
                place = np.searchsorted(table, values)
                place[place == len(table)] = 0
                late = (table[place] == values) if len(table) else np.zeros(len(values), bool)
                owner = np.repeat(np.arange(rows), sizes)
                # the rare ones keep their order by hash; common ones follow, the most frequent last
                order = np.lexsort((np.where(late, rank[place].astype(np.uint64), values) if len(table) else values, late, owner))
                ordered = values[order]
                take = sizes - _needed(sizes) + 1
                inside = np.arange(len(values)) - np.repeat(start[:-1], sizes)
                prefix = ordered[inside < np.repeat(take, sizes)].view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, take, 0)))).astype(np.int32)
                minima = np.zeros((rows, MINIMA), np.uint64)
                d1, d2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                if len(full):
                    for k in range(MINIMA):
                        minima[full, k] = np.minimum.reduceat(values ^ _XOR[k], lo)
                    d1[full], d2[full] = np.add.reduceat(values, lo), np.add.reduceat(shingles.mix(values), lo)
                bits = [_bitmap(values[a:b], b - a) if b > a else None for a, b in zip(start[:-1], start[1:])]
                at = np.arange(0, rows * MINIMA + 1, MINIMA, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, rows), pa.array(sizes.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(minima.reshape(-1).view(np.int64))),
                    pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix))], schema=schema)
    return run


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, values in shingles.sets(batch.column(0)):
            value, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])


def common_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are common in a sample of documents, ascending, and their rank from rare to frequent."""
    each = max(1, rows // SAMPLE)
    seen = docs.where(F.pmod(F.xxhash64("id"), F.lit(each)) == 0).select("text").mapInArrow(_sample_counts, "value long, n long")
    top = (seen.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
           .orderBy(F.desc("n"), "value").limit(MOST_COMMON).toArrow())
    values = top.column("value").to_numpy().view(np.uint64)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[:] = np.arange(len(values))[::-1]
    return values[order], rank[order]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (token, size, doc, comp) sorted by token and size: pairs (a, b) of small tiles of several components, and
    the rows (token, doc, comp, rows of the tile) of large ones."""
    def tiles(token, size, doc, comp) -> Iterator[pa.RecordBatch]:
        edge = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))
        rows = np.diff(edge)
        mixed = np.minimum.reduceat(comp, edge[:-1]) != np.maximum.reduceat(comp, edge[:-1])
        large = np.repeat(mixed & (rows > SMALL_TILE), rows)
        yield _tile_batch(token=token[large], doc=doc[large], comp=comp[large], rows=np.repeat(rows, rows)[large])
        keep = np.repeat(mixed & (rows <= SMALL_TILE), rows)
        token, size, doc, comp = token[keep], size[keep], doc[keep], comp[keep]
        left, found = np.arange(len(token)), [np.zeros((2, 0), np.int64)]
        for step in range(1, SMALL_TILE):
            left = left[left + step < len(token)]
            left = left[(token[left] == token[left + step]) & (5 * size[left] >= 4 * size[left + step])]
            cross = left[comp[left] != comp[left + step]]
            found.append(np.sort(np.stack((doc[cross], doc[cross + step])), axis=0))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        yield _tile_batch(a=a, b=b)

    yield from _whole_tiles(batches, 4, tiles)


def _tile_batch(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    empty = pa.nulls(n, pa.int64())
    names = ["a", "b", "token", "doc", "comp", "rows"]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else empty for c in names], names)


def _whole_tiles(batches: Iterator[pa.RecordBatch], columns: int, work) -> Iterator[pa.RecordBatch]:
    """Calls work(*arrays) on successive runs of rows, sorted by the first column, that end where a tile ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
        cut = int(np.searchsorted(rest[0], rest[0][-1], "left"))  # the last tile may go on in the next batch
        if cut:
            yield from work(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
    if rest is not None:
        yield from work(*rest)


def _folded(bits: np.ndarray) -> np.ndarray:
    """Rows of bitmaps at half their width."""
    flags = np.unpackbits(bits, axis=1).reshape(len(bits), -1, 2).any(axis=2)
    return np.packbits(flags, axis=1)


def _room(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For all rows of two blocks of bitmaps of one width: whether bit counts leave room for a link."""
    x, y = (np.ascontiguousarray(v).view(np.uint64) for v in (x, y))
    differ = np.zeros((len(x), len(y)), np.int64)
    for k in range(0, x.shape[1], 16):
        differ += np.bitwise_count(x[:, None, k:k + 16] ^ y[None, :, k:k + 16]).sum(axis=2, dtype=np.int64)
    both = n[:, None] + m[None, :]
    most = (both - differ) // 2
    return (5 * np.minimum(n[:, None], m[None, :]) >= 4 * np.maximum(n[:, None], m[None, :])) & (100 * most >= 80 * (both - most))


def _large_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different components with room for a link, from rows (token, size, doc, comp, bits) sorted by token
    and size."""
    def bands(size, doc, comp, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = np.array([len(x) for x in bits])
        runs = np.concatenate(([0], np.flatnonzero(np.diff(width)) + 1, [len(width)]))
        before = None
        for first, last in zip(runs[:-1], runs[1:]):
            rows = np.frombuffer(b"".join(bits[first:last]), np.uint8).reshape(last - first, -1)
            half = max(16, min(256, 2_000_000 // rows.shape[1]))
            for i in range(first, last, half):
                spans = [(rows, first, j) for j in range(i, last, half)]
                mine = rows[i - first:i - first + half]
                if before is not None and 2 * before[0].shape[1] == rows.shape[1]:
                    spans += [(before[0], before[1], j) for j in range(before[1], first, half)]
                for other, start, j in spans:
                    stop = min(j + half, last if other is rows else first)
                    if 5 * min(size[stop - 1], size[min(i + half, last) - 1]) < 4 * max(size[i], size[j]):
                        continue  # these bands of sizes can't link
                    block = mine if other is rows else _folded(mine)
                    x, y = slice(i, min(i + half, last)), slice(j, stop)
                    good = _room(block, other[j - start:stop - start], size[x], size[y]) & (comp[x][:, None] != comp[y][None, :])
                    a, b = np.nonzero(good)
                    yield doc[x][a], doc[y][b]
            before = (rows, first)

    def tiles(token, size, doc, comp, bits) -> Iterator[pa.RecordBatch]:
        edge = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))
        for first, last in zip(edge[:-1], edge[1:]):
            for a, b in bands(size[first:last], doc[first:last], comp[first:last], bits[first:last]):
                if len(a):
                    pair = np.unique(np.sort(np.stack((a, b)), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    yield from _whole_tiles(batches, 5, tiles)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for the overlap they need."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        differ = np.fromiter((_differ(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))), np.int64, len(a))
        most = (n + m - differ) // 2
        keep = 100 * most >= 80 * (n + m - most)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs of texts, by intersecting sorted arrays."""
    def arrays(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, sizes, values in shingles.sets(column):
            yield from np.split(values, np.cumsum(sizes)[:-1])

    for batch in batches:
        keep = []
        for x, y in zip(arrays(batch.column(2)), arrays(batch.column(3))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, features: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of distinct candidate pairs (a, b) that are links, as a written table."""
    side = lambda x: features.select(F.col("id").alias(x), F.col("size").cast("long").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    near = written(near.mapInArrow(_bounded, "a long, b long").distinct())
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(broadcast_if_small(ids, 2 * near.count(), BROADCAST_ROWS), "id", "left_semi")
    both = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = written(both.select("a", "b", "text_a", "text_b").mapInArrow(_exact, "a long, b long"))
    drop(near)
    return links


def _block_pairs(large: DataFrame) -> DataFrame:
    """Rows of large tiles under the keys of the tiles they are compared in. A tile of k > 1 blocks becomes k (k - 1) / 2
    tiles of two blocks; rows of one block meet in any of them."""
    blocks = F.ceil(F.col("rows") / F.lit(TILE_ROWS)).cast("int")
    mine = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    others = F.when(blocks == 1, F.array(mine)).otherwise(F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != mine))
    rows = large.select("token", "size", "doc", "comp", "bits", mine.alias("mine"), F.explode(others).alias("other"))
    key = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select(key.alias("token"), "size", "doc", "comp", "bits")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of `df`: the size of its set and the smallest key that links reach
    from it. Keys must be integers.

    A null, empty or blank text has an empty set and links with nothing. Fewer than five words make one shingle. Equal
    sets always link. Repeated rows each come back; if a key has several texts, each row is judged by its own. A null key
    links with nothing and comes back with its own size and a null component. An empty table gives no rows. Other columns
    of `df` are left out. Texts of any length are used whole.
    """
    spark = df.sparkSession
    named = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    docs = named.where("id is not null")
    common = common_shingles(docs, docs.count())
    columns = "id long, size int, d1 long, d2 long, minima array<long>, bits binary, prefix array<long>"
    features = written(named.mapInArrow(_features(common), columns))

    known = features.where("size > 0 and id is not null")
    same = written(known.groupBy("size", "d1", "d2").agg(F.min("id").alias("id")))
    first = written(known.join(same, ["size", "d1", "d2", "id"], "left_semi").dropDuplicates(["size", "d1", "d2", "id"]))
    own = written(features.select("id", "size", "d1", "d2"))
    drop(features)  # representatives alone go on with bitmaps and prefixes

    minima = first.select("id", F.posexplode("minima").alias("k", "value"))
    star = minima.join(minima.groupBy("k", "value").agg(F.min("id").alias("a")), ["k", "value"])
    star = star.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    strong = _links(star, first, docs)
    tied = graph.components(strong)

    comps = first.join(broadcast_if_small(tied, tied.count(), BROADCAST_ROWS), "id", "left")
    tokens = comps.select(F.explode("prefix").alias("token"), F.col("size").cast("long").alias("size"), F.col("id").alias("doc"),
                          F.coalesce("component", "id").alias("comp"))
    # tiles of common shingles are counted before any row moves: those of one component have no pair to offer, large ones
    # are cut into blocks
    usual = spark.createDataFrame(pa.table({"token": common[0].view(np.int64)}))
    counted = written(tokens.join(F.broadcast(usual), "token").groupBy("token").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("rows")))
    settled = counted.where((F.col("least") == F.col("most")) | (F.col("rows") > SMALL_TILE))
    hot = counted.where((F.col("least") < F.col("most")) & (F.col("rows") > SMALL_TILE)).select("token", "rows")
    rest = tokens.join(F.broadcast(settled.select("token")), "token", "left_anti")  # lists of MOST_COMMON rows at most
    tiles = rest.repartition("token").sortWithinPartitions("token", "size", "doc")
    found = written(tiles.mapInArrow(_tiles, "a long, b long, token long, doc long, comp long, rows long"))
    sides = first.select(F.col("id").alias("doc"), F.col("size").cast("long").alias("size"), "bits")
    large = found.where("token is not null").select("token", "doc", "comp", "rows").join(sides, "doc")
    # a hot tile takes its bitmaps along from the features; they need no shuffle of their own
    large = large.unionByName(comps.select(F.explode("prefix").alias("token"), F.col("id").alias("doc"), F.coalesce("component", "id").alias("comp"),
                                           F.col("size").cast("long").alias("size"), "bits").join(F.broadcast(hot), "token"))
    large = _block_pairs(large).repartition("token").sortWithinPartitions("token", "size", "doc").mapInArrow(_large_tiles, "a long, b long")
    cross = written(found.where("token is null").select("a", "b").unionByName(large).distinct())
    drop(found, counted)
    weak = _links(cross, first, docs)
    drop(cross, tied, first)

    joined = graph.components(strong.unionByName(weak))
    drop(strong, weak)
    final = same.join(broadcast_if_small(joined, joined.count(), BROADCAST_ROWS), "id", "left")
    final = final.select("size", "d1", "d2", F.coalesce("component", "id").alias("component"))
    return own.join(final, ["size", "d1", "d2"], "left").select(F.col("id").alias(key), F.col("size").cast("long").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df`, all columns, without those whose class has a smaller key; null keys stay."""
    found = classes(df.select(key, text), key, text).where(F.col(key) != F.col("component_id"))
    gone = written(found.select(F.col(key)).distinct())
    return df.join(broadcast_if_small(gone, gone.count(), BROADCAST_ROWS), key, "left_anti").select(*df.columns)
