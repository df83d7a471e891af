"""SimHash near-dedup by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, forgetting, sha, slices, texts, written
from .graph import components
from .sketches import remembered, shingle_hashes, word_hashes

BITS = 64
#: Distinct fingerprints of a block whose pairs are compared directly; fuller blocks go through shared neighbours instead.
DIRECT = 32
#: Shingles hashed at once, so that a very long text needs no more memory.
CHUNK = 1 << 15


def simhash(text: str, shingle: int, seed: int) -> int:
    """64-bit fingerprint as a signed long: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, CHUNK), repeat(seed)), np.uint64, min(CHUNK, n - at))
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of a (doc_id, text) table; no words give 0, fewer than a shingle the whole sequence."""

    def run(batches):
        for b in slices(batches):
            fp = pa.array([simhash(t, shingle, seed) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fp within ``distance`` (at most 2) bits.

    With distance + 2 blocks, close fingerprints agree in two blocks at least: a row for each pair
    of blocks, keyed by the masked value. Groups of up to DIRECT fingerprints are compared pair by
    pair. Members of fuller groups are listed under every fingerprint one bit away instead: two lie
    within 2 bits of each other exactly if they share such a neighbour (or are one), and no neighbour
    has more than 65 members, so no group is unbounded and no link is lost.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    parts = np.array_split(np.arange(BITS), distance + 2)
    masks = [_signed(sum(1 << int(i) for p in pair for i in p)) for pair in combinations(parts, 2)]
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    members = keyed.join(sizes.where(F.col("c") <= DIRECT), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("g"))
    direct = members.select(F.explode(_close("g", distance)).alias("p")).select("p.a", "p.b")
    full = keyed.join(sizes.where(F.col("c") > DIRECT), ["t", "key"]).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)))
    shared = full.select("fp", F.explode(near).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("g")).where("size(g) > 1")
    if distance == 2:
        star = shared.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where("a <> b")
    else:
        star = shared.select(F.explode(_close("g", distance)).alias("p")).select("p.a", "p.b")
    return direct.unionByName(star).distinct()


def _close(group: str, distance: int):
    return F.expr(
        f"flatten(transform({group}, (x, i) -> transform(filter(slice({group}, i + 2, size({group})), "
        f"y -> bit_count(x ^ y) <= {distance}), y -> named_struct('a', least(x, y), 'b', greatest(x, y)))))"
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_groups(
    docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over fingerprints within ``distance`` bits.

    Documents of equal fingerprints are one node, so copies are never compared or expanded; they
    meet their node's component in a join whose skewed side AQE splits. Null texts count as empty
    (fingerprint 0). Repeated ids keep a row each; a null doc_id is never a component's id unless
    the component has no other. An empty table gives no rows.
    """
    fps = written(fingerprints(texts(docs, id_col, text_col), shingle, seed), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = written(components(links(nodes.select("fp"), distance)), "labels")
    labelled = written(nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", "component"), "labelled")
    alone = labelled.where("component is null").select("fp", F.col("least").alias("component_id"))  # never shuffled by the null
    tied = labelled.where("component is not null")
    of = written(tied.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    final = alone.unionByName(tied.join(of, "component").select("fp", "component_id"))
    drop(nodes, labels)
    return fps.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Members of a bucket whose pairs are all candidates; fuller ones are settled by pivots first and by tiles then.
ALL_PAIRS = 16
#: Partners of a text that one task compares it with, as a mean.
PARTNERS = 256
#: Members and bytes of shingle sets of a tile, as a mean.
TILE, TILE_BYTES = 256, 16 << 20
#: Shingles whose columns are multiplied at once.
COLUMNS = 1 << 13


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2, bands: int = 16, lanes: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text_sha256 (binary), component_id, kept of documents with a near duplicate: shingle sets of Jaccard similarity of at least ``similarity``.

    Nodes are distinct texts, so copies are never compared and never expanded into pairs. Candidates share a bucket: a pair of pigeonhole
    blocks of their SimHash fingerprints (all within ``distance`` bits do) or, as 64 bits put most pairs of similarity 0.8 further apart
    than blocks can reach, one of ``bands`` keys of ``lanes`` minima each (a pair of similarity 0.8 shares one with probability 0.998).
    Every candidate is verified on the exact shingle sets, then links are closed transitively.

    Only texts with a candidate are read again. Buckets of up to ALL_PAIRS texts are compared pair by pair. In a fuller one
    all are compared with two pivots first, the smallest node and the member whose buckets are the fullest; what is
    then not of one component is compared in tiles, every pair of different components, so no pair of any bucket is left out and only members
    that no link ties to the bucket's largest component cost the square of their number.

    ``component_id`` is the smallest doc_id of a component's rows; that row stays (of several texts of that id, the one of the smallest hash). Rows
    that share an id but not a text are documents of their own. Rows repeating both are one document, returned once. A null doc_id comes after all others and
    is a component's id only if it has no other. Texts without words are never linked, not even to each other. No links give no rows.
    """
    rows = texts(docs, id_col, text_col).withColumn("sha", sha(F.col("text")))
    signed = written(_signatures(rows, shingle, bands, lanes), "signatures")
    lo, hi, none = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull()).alias("none")
    nodes = signed.groupBy("sha").agg(lo, hi, none, F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    least, copied = F.struct(F.col("lo").isNull().alias("none"), F.col("lo").alias("doc_id")), F.coalesce((F.col("hi") > F.col("lo")) | F.col("none"), F.lit(False)) & F.col("lo").isNotNull()
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "sha", least.alias("least"), copied.alias("copied"), "fp", "keys"), "nodes")
    met = written(_buckets(nodes, distance), "buckets")
    pairs = written(_candidates(met), "candidates")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(ends, "node").select("node", F.col("sha").alias("its_sha"), F.col("least.doc_id").alias("its_id"))
    found = rows.join(wanted, (F.col("sha") == F.col("its_sha")) & F.col("doc_id").eqNullSafe(F.col("its_id"))).select("node", "text")
    items = forgetting(lambda batches: _shingle_sets(batches, shingle), remembered)
    sets = written(found.mapInArrow(items, "node long, items binary").dropDuplicates(["node"]), "sets")
    labels = components(_verified(pairs, sets, similarity))
    open_ = written(_open(met.where(F.col("c") > ALL_PAIRS), labels), "open")
    if not open_.isEmpty():
        more = written(_tiled(open_, sets, similarity), "tiled")
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        drop(more)
    of = written(nodes.join(labels, "node", "left").where(F.col("component").isNotNull() | (F.col("copied") & F.col("fp").isNotNull())).select(F.coalesce("component", "node").alias("component"), "least", "sha"), "members")
    drop(met, pairs, sets, open_, nodes)
    stays = of.groupBy("component").agg(F.min(F.struct("least", "sha")).alias("first"))
    tied = written(of.join(stays, "component").select("sha", F.col("first.least.doc_id").alias("component_id"), F.col("first.sha").alias("first_sha")), "tied")
    drop(of)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("first_sha"))
    return signed.select("doc_id", "sha").distinct().join(tied, "sha").select("doc_id", F.col("sha").alias("text_sha256"), "component_id", kept.alias("kept"))


def _signatures(rows: DataFrame, shingle: int, bands: int, lanes: int) -> DataFrame:
    draw = np.random.default_rng(20)
    mult = draw.integers(1, 1 << 63, bands * lanes, dtype=np.uint64) | np.uint64(1)
    add = draw.integers(0, 1 << 63, bands * lanes, dtype=np.uint64)
    mix = draw.integers(1, 1 << 63, lanes, dtype=np.uint64) | np.uint64(1)

    def keys(text: str) -> list[int]:
        h = shingle_hashes(word_hashes(text), shingle).astype(np.uint64)
        if not len(h):
            return []
        least = np.full(bands * lanes, ~np.uint64(0))
        for at in range(0, len(h), 2048):
            least = np.minimum(least, (h[at : at + 2048, None] * mult + add).min(axis=0))
        return (least.reshape(bands, lanes) * mix).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()

    def run(batches):
        for b in slices(batches):
            got = b.column(1).to_pylist()
            k = [keys(t) for t in got]
            fp = [simhash(t, shingle, 42) if x else None for t, x in zip(got, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64()), pa.array(k, pa.list_(pa.int64()))], ["doc_id", "sha", "fp", "keys"])

    return rows.mapInArrow(forgetting(run, remembered), "doc_id long, sha binary, fp long, keys array<long>")


def _buckets(nodes: DataFrame, distance: int) -> DataFrame:
    """(t, key, node, c): the buckets of more than one node, and their numbers of nodes."""
    parts = np.array_split(np.arange(BITS), distance + 2)
    masks = [_signed(sum(1 << int(i) for p in pair for i in p)) for pair in combinations(parts, 2)]
    blocks = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))
    keyed = nodes.where("fp is not null").select("node", F.posexplode(F.concat(blocks, "keys")).alias("t", "key"))
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")  # beside an exchange of its own AQE splits a hot bucket
    return keyed.join(sizes, ["t", "key"])


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs a < b to verify first: all of a small bucket, two pivots with the members of a full one."""
    full = met.where(F.col("c") > ALL_PAIRS)
    fullness = full.groupBy("node").agg(F.sum("c").alias("w"))
    pivots = full.join(fullness, "node").groupBy("t", "key").agg(F.array(F.min("node"), F.max_by("node", F.struct("w", -F.col("node")))).alias("pivots"))
    pivots = written(pivots, "pivots")
    star = full.join(pivots, ["t", "key"]).select(F.explode(F.array_distinct("pivots")).alias("p"), "node").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
    members = met.where(F.col("c") <= ALL_PAIRS).groupBy("t", "key").agg(F.array_sort(F.collect_set("node")).alias("g"))
    each = members.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("b"))
    return star.unionByName(each).where("a < b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar.

    Each pair is dealt to the end with more pairs, its hub; a hub's partners are dealt to groups of about PARTNERS, and its own set travels once
    for each group, so neither a hub with a third of all partners nor its long set is a burden of one task.
    """
    both = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    degree = written(both.groupBy("node").agg(F.count("*").alias("n")), "degrees")
    a, b = (degree.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    hub_is_a = F.struct(F.col("n_a"), -F.col("a")) >= F.struct(F.col("n_b"), -F.col("b"))
    dealt = pairs.join(a, "a").join(b, "b").select(F.when(hub_is_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub_is_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("n_a", "n_b").alias("n"))
    dealt = dealt.select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PARTNERS)).cast("int").alias("part"), "node")
    dealt = written(dealt, "dealt")
    partners = dealt.join(sets, "node").select("hub", "part", "node", "items")
    hubs = dealt.select("hub", "part").distinct().join(sets, F.col("hub") == F.col("node")).select("hub", "part", "node", "items")
    near = hubs.unionByName(partners).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))
    links = written(near.select("hub", "part", "node", "items").mapInArrow(lambda batches: _similar(batches, similarity), "a long, b long"), "links")
    drop(degree, dealt)
    return links


def _similar(batches, similarity: float):
    """Pairs of a hub and its similar partners, from rows sorted so that a group's hub comes first."""
    group, own = None, None
    for b in slices(batches, 3):
        found = []
        for hub, part, node, items in zip(*(b.column(i).to_pylist() for i in range(4))):
            has = np.frombuffer(items, np.uint32)
            if node == hub:
                group, own = (hub, part), has
            elif group == (hub, part):
                both = len(np.intersect1d(own, has, assume_unique=True))
                if both and both >= similarity * (len(own) + len(has) - both):
                    found.append((hub, node))
        if found:
            x, y = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _open(full: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, key, node, part, main) of full buckets with more than one component; ``main`` is whether ``part`` is the largest."""
    of = written(full.join(labels, "node", "left").select("t", "key", "node", F.coalesce("component", "node").alias("part")), "parts")
    parts = of.groupBy("t", "key", "part").agg(F.count("*").alias("n"))
    largest = parts.groupBy("t", "key").agg(F.count("*").alias("kinds"), F.max_by("part", F.struct("n", "part")).alias("most")).where("kinds > 1")
    largest = written(largest, "largest")
    return of.join(largest, ["t", "key"]).select("t", "key", "node", "part", (F.col("part") == F.col("most")).alias("main"))


def _tiled(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that have similar members in one bucket.

    The members outside the largest component are dealt to tiles, those inside to others, and every two tiles meet of which
    one at least is outside.
    """
    sized = open_.join(sets.select("node", F.length("items").alias("bytes")), "node")
    tiles = lambda side: F.ceil(F.greatest(F.count(F.when(side, 1)) / TILE, F.sum(F.when(side, F.col("bytes"))) / TILE_BYTES)).cast("int")
    plan = sized.groupBy("t", "key").agg(tiles(~F.col("main")).alias("outer"), tiles(F.col("main")).alias("inner"))
    dealt = open_.join(written(plan, "plan"), ["t", "key"])
    hashed = F.xxhash64("node")
    dealt = dealt.withColumn("i", F.when(F.col("main"), F.col("outer") + F.pmod(hashed, "inner")).otherwise(F.pmod(hashed, "outer")).cast("int"))
    last = F.when(F.col("main"), F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    dealt = dealt.select("t", "key", "node", "part", "i", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    dealt = dealt.select("t", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "part").join(sets, "node")
    return dealt.groupBy("t", "key", "i", "j").applyInArrow(lambda tile: _tile_links(tile, similarity), "a long, b long").distinct()


def _tile_links(tile: pa.Table, similarity: float) -> pa.Table:
    part = tile["part"].to_numpy()
    items = [np.frombuffer(x.as_buffer(), np.uint32) for x in tile["items"]]
    sizes = np.array([len(x) for x in items], np.int64)
    _, column, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(items)), sizes)
    shared = count[column] > 1
    column, row = (np.cumsum(count > 1) - 1)[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(items), len(items)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(items), COLUMNS), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        both += (has @ has.T).astype(np.int64)
    alike = both >= similarity * (sizes[:, None] + sizes[None, :] - both)
    x, y = np.nonzero(alike & (part[:, None] < part[None, :]))
    found = np.unique(np.stack([part[x], part[y]], axis=1), axis=0)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def _shingle_sets(batches, shingle: int):
    for b in slices(batches):
        items = [np.unique(shingle_hashes(word_hashes(t), shingle)).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.binary())], ["node", "items"])
