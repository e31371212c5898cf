"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimate, verification.

A document's distinct five-word shingles are hashed once. The top bits choose one of 256 registers; a
register keeps, of the smallest remaining hash, the leading-zero count and ten mantissa bits (16 bits
together). A register that no shingle fell into is filled from all shingles under a hash of its own, so
each register agrees for two sets with a probability equal to their Jaccard similarity, however small
the sets are, and the registers of small sets still come from different shingles.

51 bands of five registers make bucket keys: a pair at similarity 0.75 shares no bucket with a
probability of about 1e-6. In a bucket every member is first held against the smallest one only;
components of the links so found settle whole groups of copies without pairing them up. What then
still shares a bucket with members of another component is held against all of those, so no pair that
shares a bucket goes untested unless the two are already connected.

Members are compared in cells. In the first pass a cell is a leader with some of its members, salted to
about CELL shingles. In the second it is a block of members with members of smaller blocks that meet it in
a bucket and visit it, so a large block is not sent out again for each small one that it meets. Blocks and
what visits them grow with the square root of the group, so rows sent grow with the power 1.5 of a group
that shares buckets and is not connected, up to blocks of LARGEST cells; only tests of sketches within a
task are as many as its pairs. A bucket of any size is dealt over many tasks, and a member's sketch is
sent once for each cell, not once for each pair. A task compares a cell's sketches by numpy and emits only
the pairs whose estimate, corrected for registers that agree by chance, is not clearly below the threshold,
as lists of partners; only their texts are then brought to the cell and verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.storage import cut, discard, release, through_table
from millrace.llm.words import codes, hash_words, mix, row_slices, text_buffer, window_hashes

SHINGLE = 5
REGISTERS = 256
MANTISSA_BITS = 10
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
#: Six standard deviations of a 256-register estimate below the threshold of 0.75.
ESTIMATE_SLACK = 0.165
#: Shingles, and members, of a block on the average.
CELL, CELL_MEMBERS = 1 << 18, 512
#: Cells' worth of members in a block at most, by which a task's memory is bounded.
LARGEST = 32
_EMPTY = np.uint16(0xFFFF)
_FLIP, _SPREAD = codes(REGISTERS, 41), codes(REGISTERS, 43)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes; fewer than five words are one shingle."""
    if not len(hashes):
        return hashes
    size = min(SHINGLE, len(hashes))
    found = window_hashes(hashes, np.arange(len(hashes) - size + 1), size)
    return np.unique(found if size == SHINGLE else mix(found + np.uint64(size)))


def _compress(rest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 53-bit hashes, in 16 bits."""
    rest = rest.astype(np.float64)
    fraction, exponent = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - exponent, 53)
    mantissa = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA_BITS), 0)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 256 registers of one sorted shingle set; 0xFFFF throughout where it is empty."""
    out = np.full(REGISTERS, _EMPTY, np.uint16)
    if len(shingles):
        index = (shingles >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[first]] = _compress((shingles[first] << np.uint64(8)) >> np.uint64(11))
        holes = np.flatnonzero(out == _EMPTY)
        if len(holes):
            # The more shingles, the fewer holes: at most about 24,000 products for any set.
            least = ((shingles[:, None] ^ _FLIP[holes]) * _SPREAD[holes]).min(axis=0)
            out[holes] = _compress(least >> np.uint64(11))
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two register rows, corrected for registers that agree by chance.

    Two registers of different minima agree when zero counts and mantissas both do: the zero count z has
    probability 2**-(z+1), so they agree with about (1/3) * 2**-mantissa_bits.
    """
    chance = 2.0**-MANTISSA_BITS / 3
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_slices(whole, "text"):
            data, at = text_buffer(batch.column("text"))
            hashes, first = hash_words(data, at, lower=True)
            matrix = np.full((batch.num_rows, REGISTERS), _EMPTY, np.uint16)
            size = np.zeros(batch.num_rows, np.int64)
            digest = np.zeros((batch.num_rows, 2), np.int64)
            for i in range(batch.num_rows):
                found = shingle_set(hashes[first[i] : first[i + 1]])
                size[i] = len(found)
                if len(found):
                    matrix[i] = registers(found)
                    digest[i] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "t")] + [pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([x.tobytes() for x in matrix], pa.binary())],
                ["doc_id", "t", "n_shingles", "s1", "s2", "sketch"],
            )


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = codes(BAND_ROWS, 31)
    salt = codes(BANDS, 37)
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            rows = _sketches(batch.column("sketch"))
            groups = rows[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                key = mix((groups * weight).sum(axis=2, dtype=np.uint64) + salt)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            size = np.repeat(batch.column("n_shingles").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(node), pa.array(size)], ["key", "node", "n_shingles"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole cells of batches sorted by (c1, c2), and where each cell starts and the last one ends."""
    rest: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        c1, c2 = (table.column(c).to_numpy() for c in ("c1", "c2"))
        new = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        return np.concatenate(([0], np.flatnonzero(new) + 1, [len(c1)]))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, int(at[-2])), at[:-1]
        rest = table.slice(int(at[-2]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


_PARTNERS = "c1 long, c2 long, node long, partners array<long>"


def _partner_rows(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """A row for each member in a pair (row numbers left, right), with the partners that it stands left of."""
    node = table.column("node").to_numpy()
    used = np.unique(np.concatenate((left, right)))
    order = np.argsort(left, kind="stable")
    ends = np.searchsorted(left[order], used, "left"), np.searchsorted(left[order], used, "right")
    offsets = np.concatenate((ends[0], [len(left)])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[right[order]]))
    c1, c2 = (pa.array(table.column(c).to_numpy()[used]) for c in ("c1", "c2"))
    return pa.RecordBatch.from_arrays([c1, c2, pa.array(node[used]), lists], ["c1", "c2", "node", "partners"])


def _fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _stars(percent: int):
    """Pairs of a cell's hub and its other members that the estimate does not rule out."""
    low = percent / 100 - ESTIMATE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _cells(batches):
            rows, sizes, hub = _sketches(table.column("sketch")), table.column("n_shingles").to_numpy(), table.column("hub").to_numpy()
            cell = np.repeat(np.arange(len(at) - 1), np.diff(at))
            hub_of = np.full(len(at) - 1, -1)
            hub_of[cell[hub]] = np.flatnonzero(hub)
            other = np.flatnonzero(~hub)
            centre = hub_of[cell[other]]
            other, centre = other[centre >= 0], centre[centre >= 0]
            fits = _fit(sizes[other], sizes[centre], percent)
            other, centre = other[fits], centre[fits]
            keep = np.concatenate([np.zeros(0, bool), *((rows[other[k : k + 4096]] == rows[centre[k : k + 4096]]).mean(axis=1) >= low for k in range(0, len(other), 4096))])
            if keep.any():
                yield _partner_rows(table, centre[keep], other[keep])

    return run


def _blocks(percent: int):
    """Pairs of two blocks (or within one) of different components that the estimate does not rule out."""
    low = percent / 100 - ESTIMATE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _cells(batches):
            rows = _sketches(table.column("sketch"))
            sizes, component, part = (table.column(c).to_numpy() for c in ("n_shingles", "component", "part"))
            lefts, rights = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                first = a + np.flatnonzero(part[a:b] == 0)
                second = a + np.flatnonzero(part[a:b] == 1)
                for k, i in enumerate(first.tolist()):
                    to = second if len(second) else first[k + 1 :]
                    to = to[(component[to] != component[i]) & _fit(sizes[to], sizes[i], percent)]
                    if len(to):
                        to = to[(rows[to] == rows[i]).mean(axis=1) >= low]
                        lefts.append(np.full(len(to), i))
                        rights.append(to)
            left = np.concatenate([np.zeros(0, np.int64), *lefts])
            if len(left):
                yield _partner_rows(table, left, np.concatenate(rights))

    return run


def _verifier(percent: int):
    """(a, b): pairs of partners whose full shingle sets are similar enough, leaving out those that links of the cell connect already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _cells(batches):
            sets: list[np.ndarray] = []
            for whole in table.select(["text"]).combine_chunks().to_batches():
                for batch in row_slices(whole, "text", 2 << 20):
                    hashes, first = hash_words(*text_buffer(batch.column("text")), lower=True)
                    sets += [shingle_set(hashes[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
            node, partners = table.column("node").to_numpy(), table.column("partners").combine_chunks()
            starts, members = partners.offsets.to_numpy(), partners.values.to_numpy()
            links: list[tuple[int, int]] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                row_of = dict(zip(node[a:b].tolist(), range(a, b), strict=True))
                root = {i: i for i in range(a, b)}

                def find(i: int, root: dict[int, int] = root) -> int:
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                for i in range(a, b):
                    mine = sets[i]
                    others = [row_of[x] for x in members[starts[i] : starts[i + 1]].tolist()]
                    for k in range(0, len(others), 64):
                        tested = [j for j in others[k : k + 64] if find(j) != find(i)]
                        if not tested:
                            continue
                        lengths = np.array([len(sets[j]) for j in tested])
                        each = np.concatenate([sets[j] for j in tested])
                        place = np.minimum(np.searchsorted(mine, each), len(mine) - 1)
                        both = np.add.reduceat((mine[place] == each).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
                        for j, similar in zip(tested, (100 * both >= percent * (len(mine) + lengths - both)).tolist(), strict=True):
                            if similar:
                                links.append((int(node[i]), int(node[j])))
                                root[find(j)] = find(i)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("c1", "c2").sortWithinPartitions("c1", "c2")


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets (words lower-cased
    in A-Z). component_id is the smallest doc_id reachable, kept says whether that is the document itself.
    text_hash is xxhash64 of the text, which tells rows of one doc_id apart.

    Null or empty texts and texts without words have no shingles, are linked with nothing and kept. A null
    doc_id takes part; its component_id is the smallest doc_id reached, or null, and it is kept only where
    that is null. Repeated rows are copies of one another: all rows of the smallest doc_id are kept. Any
    64-bit doc_id will do. Other columns are ignored. An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    sketched = through_table(docs.mapInArrow(_sketch, "doc_id long, t long, n_shingles long, s1 long, s2 long, sketch binary"), "sketch")
    # `name` finds the text of a class again, also where it has no doc_id; `node` numbers the classes.
    classes = (
        sketched.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", "t").alias("name"), "t")).alias("of"), F.first("sketch").alias("sketch"))
        .select("s1", "s2", "n_shingles", "least", "of.name", "of.t", "sketch", F.monotonically_increasing_id().alias("node"))
    )
    classes = through_table(classes, "classes")
    release(documents.sparkSession)
    bands = classes.select("node", "n_shingles", "sketch").mapInArrow(_bands, "key long, node long, n_shingles long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader")).where("members > 1")
    members = through_table(bands.join(shared.select("key", "leader"), "key"), "members")
    release(documents.sparkSession)
    sketches = classes.select("node", "n_shingles", "sketch")

    def links(cells: DataFrame, compare) -> DataFrame:
        """Verified pairs of the cells (c1, c2, node and what `compare` reads): sketches first, then texts of those that may pass."""
        found = through_table(_dealt(cells.join(sketches, "node")).mapInArrow(compare(percent), _PARTNERS), "plausible")
        wanted = found.select("node").distinct().join(classes.select("node", "name", "t"), "node")
        named = docs.select(F.coalesce("doc_id", "t").alias("name"), "t", "text")
        texts = named.join(wanted, ["name", "t"]).groupBy("name", "t").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
        out = through_table(_dealt(found.join(texts, "node")).mapInArrow(_verifier(percent), "a long, b long"), "links")
        discard(found)
        return out

    def weight(total: str, count: str):
        """Cells that members of so many shingles fill, one at least."""
        return F.greatest(F.col(total) / CELL, F.col(count) / CELL_MEMBERS, F.lit(1.0))

    def parts(total: str, count: str):
        return F.ceil(weight(total, count)).cast("long")

    def roots(total: str, count: str):
        """Blocks of a group: the square root of its cells, so that they are as large as they are many."""
        return F.ceil(F.greatest(F.sqrt(weight(total, count)), weight(total, count) / LARGEST)).cast("long")

    # First pass: every leader with its members, in as many cells as they need.
    star = members.where("node <> leader").groupBy("leader", "node").agg(F.first("n_shingles").alias("n"))
    salts = star.groupBy("leader").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).select("leader", parts("total", "k").alias("salts"))
    hubs = salts.select(F.col("leader").alias("c1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("c2"), F.col("leader").alias("node"), F.lit(True).alias("hub"))
    rays = star.join(salts, "leader").select(F.col("leader").alias("c1"), F.expr("pmod(xxhash64(node), salts)").alias("c2"), "node", F.lit(False).alias("hub"))
    found = links(hubs.unionByName(rays), _stars)
    linked = cut(components(found))
    release(documents.sparkSession)

    # Second pass: members of buckets that still hold several components. A block has one home, the component of
    # the smallest leader that its members share a bucket with; those of that component keep to blocks of their own.
    placed = members.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    placed = through_table(placed.join(mixed.select("key"), "key", "left_semi"), "mixed")
    if placed.isEmpty():
        final = linked
    else:
        homes = placed.groupBy("node").agg(F.min("leader").alias("home"), F.first("component").alias("component"), F.first("n_shingles").alias("n"))
        of_home = linked.select(F.col("node").alias("home"), F.col("component").alias("main"))
        homes = homes.join(of_home, "home", "left").withColumn("home", F.coalesce("main", "home")).withColumn("own", F.col("component") == F.col("home")).drop("main")
        sizes = homes.groupBy("home", "own").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).select("home", "own", roots("total", "k").alias("salts"))
        homes = homes.join(sizes, ["home", "own"]).select("node", "component", "n", F.expr("xxhash64(home, own, pmod(xxhash64(node), salts))").alias("block"))
        homes = through_table(homes, "blocks")
        inside = placed.select("key", "node").join(homes, "node").groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        inside = through_table(inside, "inside")
        other = inside.select("key", F.col("block").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        meet = inside.withColumnRenamed("block", "c1").join(other, "key").where("c1 <= c2 and least(lo, lo2) <> greatest(hi, hi2)").select("c1", "c2").distinct()
        # The smaller block of two visits the larger, in as many cells as the visitors of a block need.
        blocks = homes.groupBy("block").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
        one, two = (blocks.select(F.col("block").alias(c), F.struct("k", "total", "block").alias(x)) for c, x in (("c1", "x"), ("c2", "y")))
        visits = meet.join(one, "c1").join(two, "c2").select(F.greatest("x", "y").alias("stay"), F.least("x", "y").alias("guest"))
        visits = through_table(visits.select("stay.block", F.col("guest.block").alias("guest"), "stay.k", "stay.total", F.col("guest.k").alias("gk"), F.col("guest.total").alias("gtotal")), "visits")
        met = visits.where("block <> guest")
        room = met.groupBy("block", "k", "total").agg(F.sum("gk").alias("gk"), F.sum("gtotal").alias("gtotal"))
        room = room.select("block", F.ceil(weight("gtotal", "gk") / weight("total", "k")).cast("long").alias("salts"))
        salted = met.join(room, "block").select("block", "guest", F.expr("pmod(xxhash64(guest), salts)").alias("c2"))
        zero = F.lit(0).alias("part")
        sides = salted.select(F.col("block").alias("c1"), "c2", F.col("guest").alias("block"), F.lit(1).alias("part"))
        sides = sides.unionByName(salted.select(F.col("block").alias("c1"), "c2").distinct().select("c1", "c2", F.col("c1").alias("block"), zero))
        sides = sides.unionByName(visits.where("block = guest").select(F.col("block").alias("c1"), F.lit(-1).cast("long").alias("c2"), "block", zero))
        more = links(sides.join(homes.drop("n"), "block").drop("block"), _blocks)
        final = linked if more.isEmpty() else cut(components(found.unionByName(more)))
        discard(homes, inside, visits)
    discard(members, placed)

    placed = classes.select("s1", "s2", "n_shingles", "least", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("c"))
    placed = placed.join(least, "component").select("s1", "s2", "n_shingles", "c", F.lit(True).alias("known"))
    out = sketched.select("doc_id", "t", "n_shingles", "s1", "s2").join(placed, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("known"), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("t").alias("text_hash"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
