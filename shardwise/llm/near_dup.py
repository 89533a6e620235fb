"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has COMPONENTS values of 16 bits (more at thresholds below 78 %), the lowest bits of minima of as many hash functions over the shingle set. It is cut
into chunks of CHUNK values; by the pigeonhole principle two signatures that differ in at most
D = chunks * (ERRORS + 1) - 1 values differ in at most ERRORS = 1 values of some chunk. Each chunk is listed once with
each of its values left out, so all such pairs meet under an equal key, and nearly all that differ in some more values do. With 50 values in ten
chunks D is 19. Pairs that meet are candidates up to an allowed distance that follows from the threshold, such that a pair at exactly the
threshold is missed, by its keys or by its distance, with a probability below MISS = 10^-5: at 80 % 23 values of 50
are allowed (missed with 9.8 * 10^-6), at 85 % 20 (3.9 * 10^-6).

1. Documents of equal shingle sets form a class, known by a 64-bit hash of the set; only classes go on.
2. Keys that two classes share make candidates: within a key a spanning forest of the pairs within the allowed distance. Keys of more than
   HOT classes link all to their least class instead: more candidates, but no pairs are made.
3. Candidates fall into components. A component of more than BLOCK classes is dealt into blocks; each block is compared in itself, on full
   sets, and with the component's least class. Most components are one cluster of links then. Where some are not, classes are
   dealt into blocks anew, by cluster, and each pair of blocks that are not of one cluster is a group of
   bounded size in which pairs across clusters are compared. So no link is lost, there is no row for each pair, and
   what grows with the square of a component is only the part that its clusters leave unsettled. Each group returns a spanning forest of its links.
4. The components of the links are the near-duplicate groups.

Scale: work on keys is combined before shuffles, by count, least and greatest class; texts move only for classes with a candidate, one text a class.

Defined results: words are runs of bytes other than 9 to 13 and 32, A-Z lower-cased. A document of fewer words than a shingle has one
shingle, its whole sequence; null text, or text without words, has none and is linked with nothing. Repeated rows and
copies share a class; the component's id is the least id in it, so ties cannot occur. A null id links documents like any other; it is ignored
in that minimum, so the component's id is null only where all ids in it are, and `kept` is true where id and component id are equal or both
null. An empty table gives an empty table. Only the named columns are read. Two
different sets share a class with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import mix64, prefix_hash, range_hash, shingle_sets, sliced, string_buffer
from shardwise.llm.graph import connected_components
from shardwise.llm.storage import gathered, settled

COMPONENTS, CHUNK, ERRORS = 50, 5, 1
DISTANCE = COMPONENTS // CHUNK * (ERRORS + 1) - 1
#: Classes under one key from which they are linked to their least one; classes in a block.
HOT, BLOCK = 512, 128

#: Bound of the probability that a pair at exactly the threshold is no candidate.
MISS = 1e-5


def miss_rate(percent: int, components: int, distance: int) -> float:
    """Bound of the probability that a pair of similarity percent / 100 shares no key or differs in more than `distance` of `components` values."""
    same = percent / 100
    apart = 1 - same
    meets = same**CHUNK + CHUNK * apart * same ** (CHUNK - 1)
    return (1 - meets) ** (components // CHUNK) + sum(math.comb(components, k) * apart**k * same ** (components - k) for k in range(distance + 1, components + 1))


def allowed(percent: int) -> tuple[int, int]:
    """The number of values of a signature, COMPONENTS at least, and the allowed distance for which `miss_rate` is below MISS."""
    if not 0 < percent <= 100:
        raise ValueError(f"no threshold: {percent} %")
    components = COMPONENTS
    while miss_rate(percent, components, components) > MISS / 2:
        components += CHUNK
    return components, next(d for d in range(components + 1) if miss_rate(percent, components, d) < MISS)


def _factors(components: int) -> np.ndarray:
    return mix64(np.arange(1, components + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def set_classes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return np.where(sizes > 0, range_hash(prefix_hash(mix64(flat)), ends - sizes, ends), np.uint64(0)).view(np.int64)


def signatures(sets: list[np.ndarray], components: int = COMPONENTS) -> np.ndarray:
    """The signature of each set (rows); all zero for an empty one."""
    out = np.zeros((len(sets), components), dtype=np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        for c, factor in enumerate(_factors(components)):
            out[full, c] = mix64(np.minimum.reduceat(flat * factor >> np.uint64(24), starts)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each signature (rows) one key for each chunk and each of its values left out."""
    keys = []
    values = signature.astype(np.uint64)
    for chunk in range(values.shape[1] // CHUNK):
        for out in range(CHUNK):
            key = np.full(len(values), chunk * CHUNK + out + 1, dtype=np.uint64)
            for c in range(chunk * CHUNK, (chunk + 1) * CHUNK):
                if c != chunk * CHUNK + out:
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, c])
            keys.append(key)
    return np.stack(keys, 1).view(np.int64)


class _Forest:
    """Which links join two parts that were not connected before."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first n_keys columns, from batches of sorted rows."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in range(n_keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *cuts.tolist()]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(bounds[-1])
    if rest is not None:
        yield rest


def sketch(df: DataFrame, words: int, components: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_shingles, class, signature) of each row; `row` is a hash of id and text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            sets = shingle_sets(*string_buffer(batch.column(1)), words)
            columns = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_classes(sets)), pa.array([s.tobytes() for s in signatures(sets, components)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n_shingles", "class", "signature"])

    return df.select(id_col, text_col, F.xxhash64(id_col, text_col)).mapInArrow(make, f"id {df.schema[id_col].dataType.simpleString()}, row bigint, n_shingles bigint, class bigint, signature binary")


def candidate_links(nodes: DataFrame, components: int, distance: int) -> DataFrame:
    """(a, b): links whose components hold all pairs of nodes (class, signature of so many components) that share a key and are within the distance."""

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, components))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "class"])

    keyed = nodes.select("class", "signature").mapInArrow(list_keys, "key bigint, class bigint")
    shared = keyed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low < high")
    members = settled(keyed.join(shared, "key").select("key", "class", "low", "n"))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for g in groups(batches, 1):
            ids = g.column("class").to_pylist()
            values = np.frombuffer(b"".join(g.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, components)
            parts = _Forest(len(ids))
            for k in range(len(ids) - 1):
                near = (values[k + 1 :] != values[k]).sum(1) <= distance
                for j in np.flatnonzero(near) + k + 1:
                    if parts.join(k, int(j)):
                        left.append(ids[k])
                        right.append(ids[j])
            if len(left) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    small = members.where(F.col("n") <= HOT).select("key", "class").join(nodes.select("class", "signature"), "class").select("key", "class", "signature")
    found = gathered(small, "key").mapInArrow(forest, "a bigint, b bigint")
    stars = members.where((F.col("n") > HOT) & (F.col("class") != F.col("low"))).select(F.col("class").alias("a"), F.col("low").alias("b"))
    return found.unionByName(stars).distinct()


def full_sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of `wanted` (node, and bigint columns) with `shingles`, the full set of each node, from the text of one of its rows."""
    kept = wanted.columns
    rows = wanted.join(nodes.select(F.col("class").alias("node"), "row", "copies"), "node")
    found = df.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(rows, "row")
    texts = found.select(*kept, "text")
    if nodes.where("copies > 1").take(1):  # of rows that are repeated, id and all, one
        texts = found.where("copies = 1").select(*kept, "text").unionByName(found.where("copies > 1").groupBy(*kept).agg(F.min("text").alias("text")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = shingle_sets(*string_buffer(batch.column(len(kept))), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "shingles"])

    return texts.mapInArrow(sets_of, ", ".join(f"`{c}` bigint" for c in kept) + ", shingles binary")


def links_within(full: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each group of rows (keys, node, block, cluster, shingles). In a group whose last two keys differ, pairs of one block are not compared; pairs of one cluster never are."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, len(keys)):
            ids, first = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            block, cluster = (g.column(c).to_numpy()[first] for c in ("block", "cluster"))
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g.column("shingles").take(pa.array(first)).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            starts = np.cumsum(sizes) - sizes
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            marked = np.zeros(len(values), dtype=np.int32)
            across = g.column(keys[-2])[0] != g.column(keys[-1])[0]
            parts, left, right = _Forest(len(ids)), [], []
            for k in range(len(ids) - 1):
                apart = cluster[k + 1 :] != cluster[k]
                if across:
                    apart &= block[k + 1 :] != block[k]
                if not apart.any():
                    continue
                own = codes[starts[k] : starts[k] + sizes[k]]
                marked[own] = 1
                common = np.add.reduceat(marked[codes[starts[k + 1] :]], starts[k + 1 :] - starts[k + 1])
                marked[own] = 0
                linked = apart & (100 * common >= percent * (sizes[k] + sizes[k + 1 :] - common))
                for j in np.flatnonzero(linked) + k + 1:
                    if parts.join(k, int(j)):
                        left.append(ids[k])
                        right.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return gathered(full.select(*keys, "node", "block", "cluster", "shingles"), *keys).mapInArrow(confirm, "a bigint, b bigint").distinct()


def pairs_of_blocks(open_nodes: DataFrame) -> DataFrame:
    """(root, i, j, node, block, cluster): each node (node, root, cluster) in every group of two blocks, or of one, that may hold links across clusters.

    Clusters of at least BLOCK nodes have blocks of their own; the others share blocks. Groups of blocks of one cluster, and a cluster's own block by itself, are left out.
    """
    sizes = open_nodes.groupBy("root", "cluster").agg(F.count("*").alias("size")).withColumn("alone", F.col("size") >= BLOCK)
    sizes = sizes.withColumn("owner", F.when(F.col("alone"), F.col("cluster")).otherwise(F.lit(0)))
    shared = sizes.groupBy("root", "alone", "owner").agg(F.ceil(F.sum("size") / BLOCK).cast("long").alias("parts"))
    spread = settled(sizes.join(shared, ["root", "alone", "owner"]).select("root", "cluster", "alone", "owner", "parts"))
    placed = open_nodes.join(spread, ["root", "cluster"]).withColumn("block", F.xxhash64("alone", "owner", F.pmod(F.xxhash64("node"), F.col("parts"))))
    placed = settled(placed.select("root", "node", "cluster", F.when(F.col("alone"), F.col("owner")).alias("owner"), "block"))
    blocks = placed.groupBy("root", "block").agg(F.first("owner").alias("owner"))
    left, right = blocks.select("root", F.col("block").alias("i"), F.col("owner").alias("of_i")), blocks.select("root", F.col("block").alias("j"), F.col("owner").alias("of_j"))
    pairs = left.join(right, "root").where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("of_i") == F.col("of_j"), F.lit(False))).select("root", "i", "j")
    member = pairs.select("root", "i", "j", F.col("i").alias("block")).unionByName(pairs.where("i <> j").select("root", "i", "j", F.col("j").alias("block")))
    return placed.select("root", "node", "cluster", "block").join(member, ["root", "block"])


def confirmed_links(df: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links whose components are those of all pairs of classes in one candidate component (node, root) with enough common shingles."""
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = candidates.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    full = full_sets(df, nodes, dealt.select("node", "root", "block", "blocks"), words, id_col, text_col)
    homes = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    full = full.withColumn("i", F.explode(homes)).withColumns({"j": F.col("i"), "cluster": F.col("node")})
    links = settled(links_within(full, ["root", "i", "j"], percent))
    large = dealt.where("blocks > 1").select("node", "root")
    clusters = connected_components(links).select("node", F.col("root").alias("cluster"))
    large = settled(large.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
    apart = large.groupBy("root").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("root")
    unsettled = settled(large.join(apart, "root", "left_semi"))
    if not unsettled.take(1):
        return links
    more = full_sets(df, nodes, pairs_of_blocks(unsettled), words, id_col, text_col)
    return links.unionByName(links_within(more, ["root", "i", "j"], percent))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: documents with at least `percent` % of their joint `words`-word shingles in common are linked."""
    size, distance = allowed(percent)
    made = settled(sketch(df, words, size, id_col, text_col))
    rows = made.where("n_shingles > 0").groupBy("class", "row").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
    nodes = rows.groupBy("class").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.min(F.struct("row", "copies")).alias("least"))
    nodes = settled(nodes.select("class", "id", "signature", "least.row", "least.copies"))
    candidates = settled(connected_components(candidate_links(nodes, size, distance)))
    components = connected_components(confirmed_links(df, nodes, candidates, words, percent, id_col, text_col))
    rooted = nodes.select("class", "id").join(components.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = settled(rooted)  # so that Spark can split a hot root
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("class", "component_id")
    return made.join(named, "class", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
