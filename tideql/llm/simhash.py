"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints are compared by numpy exclusive-or and bit counts. A fingerprint's
tile is the bit counts of its four 16-bit quarters. Fingerprints within the radius
differ by no more than it in these counts, added up over the quarters, so tile
pairs beyond that are skipped and no link is lost. Each fingerprint is at home in
its own tile and visits those tiles above its own within reach. A tile with more
than CHUNK homes is cut in fine ones, by the bit counts of all eight bytes, and what
visits it goes to those fine tiles only that are within reach; a fine tile with more
homes than that is dealt in chunks, past each of which its visitors stream. Of each
block of comparisons only a spanning forest of the links leaves the task, never all
pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.functions.shipping import ship
from tideql.llm.common import BROADCAST_ROWS, LOWER, fields, partitions, written
from tideql.llm.components import components

SHINGLE = 3
RADIUS = 2
CHUNK = 4096
#: A fingerprint is hot that one in HOT rows has, and LEAST_HOT rows.
HOT, LEAST_HOT = 10_000, 100
#: Shingles hashed at once: bounds memory for very long texts.
PIECE = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text as an unsigned number; without words 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_digest
    counts = np.zeros(2048, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + SHINGLE - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
        counts += np.bincount((raw + _OFFSETS).ravel(), minlength=2048)
    ones = np.einsum("kv,vb->kb", counts.reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry..., fp): fp is the fingerprint's bits as a signed long; carry: longs."""

    def run(batches):
        for batch in batches:
            texts = fields(batch, "text")[0]
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fps)], [*names, "fp"])

    ship(docs.sparkSession)
    names = ["doc_id", *carry]
    return docs.select(*(F.col(n).cast("long").alias(n) for n in names), "text").mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def bytes_of(fps: np.ndarray) -> np.ndarray:
    """(n, 8) bit counts of the bytes."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)).astype(np.int64)


def _quarters(counts: np.ndarray) -> np.ndarray:
    return counts[..., ::2] + counts[..., 1::2]


_RADIX, _FINE_RADIX = 32 ** np.arange(4)[::-1], 9 ** np.arange(8)[::-1]
#: Fine tiles are numbered from here; tiles below.
FINE = 32**4


@functools.cache
def _steps(radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Steps from a tile to itself and to those after it, in order, that are within reach;
    with each the steps of the bytes' counts that make it up. To itself: those to fine
    tiles not before the own."""
    span, fine = range(-radius, radius + 1), {}
    # counted up from no step, a place at a time, so that only steps within reach are made
    every = [()]
    for _ in range(8):
        every = [(*s, x) for s in every for x in span if sum(map(abs, s)) + abs(x) <= radius]
    for s in every:
        quarter = tuple(s[i] + s[i + 1] for i in range(0, 8, 2))
        if quarter > (0,) * 4 or (quarter == (0,) * 4 and s >= (0,) * 8):
            fine.setdefault(quarter, []).append(s)
    return [(np.array(q, np.int64), np.array(sorted(f), np.int64)) for q, f in sorted(fine.items())]


def visited(fps: np.ndarray, radius: int, split: np.ndarray):
    """(tile, whether at home there, fingerprint) of each fingerprint's own tile and of those
    it visits. split: the tiles, in order, that are cut in fine ones."""
    counts = bytes_of(fps)
    quarters, out = _quarters(counts), []
    for step, fine in _steps(radius):
        dest = quarters + step
        at = np.flatnonzero(((dest >= 0) & (dest <= 16)).all(axis=1))
        tile = dest[at] @ _RADIX
        cut = np.isin(tile, split) if len(split) else np.zeros(len(tile), bool)
        out.append((tile[~cut], np.full(int((~cut).sum()), not step.any()), fps[at[~cut]]))
        if cut.any():
            at = at[cut]
            for part in fine:
                dest = counts[at] + part
                inside = ((dest >= 0) & (dest <= 8)).all(axis=1)
                out.append((FINE + dest[inside] @ _FINE_RADIX, np.full(int(inside.sum()), not part.any()), fps[at[inside]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(a: np.ndarray, b: np.ndarray, n: int):
    """Links a[i]-b[i] among n nodes as (node, least node of its component) of those not their own least."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            at = np.flatnonzero(root != np.arange(n))
            return at, root[at]


def compared(home: np.ndarray, other: np.ndarray, radius: int, same: bool):
    """Forest edges of links between home and other fingerprints (same: among home)."""
    every = home if same else np.concatenate([home, other])
    home, other = home.view(np.uint64), other.view(np.uint64)  # of signed numbers bitwise_count takes the absolute value
    shift = 0 if same else len(home)
    ends = []
    for i in range(0, len(home), 512):
        for j in range(i if same else 0, len(other), 4096):
            near = np.bitwise_count(home[i : i + 512, None] ^ other[None, j : j + 4096]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j + shift
            if same:
                x, y = x[x < y], y[x < y]
            if len(x) > 8 * (near.shape[0] + near.shape[1]):  # thin out a dense block before it is kept
                y_, x_ = forest(x, y, len(every))
                x, y = x_, y_
            ends.append((x, y))
    x, y = (np.concatenate([e[k] for e in ends]) for k in (0, 1)) if ends else (np.array([], int), np.array([], int))
    if not len(x):
        return every[:0], every[:0]
    node, root = forest(x, y, len(every))
    return every[node], every[root]


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct
    longs in column fp. Null fingerprints have no links."""
    spark = fps.sparkSession
    ship(spark)

    def counted(number):
        def count(batches):
            for batch in batches:
                tile, n = np.unique(number(np.asarray(batch.column(0))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(n.astype(np.int64))], ["tile", "n"])

        # only those over a chunk are gathered: of tiles 17^4 at most, of fine ones one a chunk
        return fps.mapInArrow(count, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).where(F.col("n") > chunk).orderBy("tile").collect()

    def fine_of(some):
        counts = bytes_of(some)
        inside = np.isin(_quarters(counts) @ _RADIX, split)
        return FINE + counts[inside] @ _FINE_RADIX

    fps = fps.where(F.col("fp").isNotNull())
    split = np.array([r["tile"] for r in counted(lambda some: _quarters(bytes_of(some)) @ _RADIX)], np.int64)
    parts = {r["tile"]: -(-r["n"] // chunk) for r in counted(fine_of)} if len(split) else {}

    def spread(batches):
        for batch in batches:
            every = np.asarray(batch.column(0))
            for at in range(0, len(every), 20000):
                tile, home, value = visited(every[at : at + 20000], radius, split)
                part = np.zeros(len(tile), np.int64)
                if parts:
                    n = np.array([parts.get(t, 1) for t in tile.tolist()], np.int64)
                    mine = ((value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                    # visitors go to every chunk of a tile, homes also visit the chunks after their own
                    first = np.where(home, mine, 0)
                    times = n - first
                    part = np.arange(times.sum()) - np.repeat(times.cumsum() - times - first, times)
                    home = np.repeat(home, times) & (part == np.repeat(first, times))
                    tile, value = np.repeat(tile, times), np.repeat(value, times)
                key = tile * (1 << 36) + part
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.where(home, 0, 1).astype(np.int8)), pa.array(value)], ["tile", "visits", "fp"])

    def compare(batches):
        key, homes, held = None, [], None
        for batch in batches:
            tile, visits, fp = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tile)]):
                if lo == hi:
                    continue
                if tile[lo] != key:
                    if held is None and homes:
                        yield from out(homes_of(homes), None)
                    key, homes, held = tile[lo], [], None
                n_home = int(np.searchsorted(visits[lo:hi], 1))
                if n_home:
                    homes.append(fp[lo : lo + n_home])
                if n_home < hi - lo and homes:
                    if held is None:
                        held = homes_of(homes)
                        yield from out(held, None)
                    yield from out(held, fp[lo + n_home : hi])
        if held is None and homes:
            yield from out(homes_of(homes), None)

    def homes_of(homes):
        return np.concatenate(homes)

    def out(home, other):
        a, b = compared(home, home if other is None else other, radius, other is None)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = fps.mapInArrow(spread, "tile long, visits byte, fp long").repartition(partitions(spark), "tile").sortWithinPartitions("tile", "visits")
    return rows.mapInArrow(compare, "a long, b long")


def _classes(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, n, root, component_id) of nodes(fp, least, n): root names the component,
    component_id is the least id in it."""
    found = components(links(nodes.select("fp"), radius))
    linked = nodes.join(found, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    inside = linked.select("fp", "root").join(least, "root")
    return nodes.join(inside, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id"))


def _classed(docs: DataFrame, radius: int, *carry: str) -> DataFrame:
    """(doc_id, carry..., fp, root, component_id) of each row. Classes go back to the rows by
    fingerprint: those of a fingerprint that one in HOT rows or more has, HOT of them at most,
    by broadcast, so that no group of copies meets in one task."""
    rows = written(fingerprints(docs, *carry), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    classes = written(_classes(nodes, radius), "classes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") * HOT >= max(total, LEAST_HOT * HOT)
    hot = F.broadcast(classes.where(many).drop("n"))
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(classes.where(~many).drop("n"), "fp")
    names = ["doc_id", *carry, "fp", "root", "component_id"]
    return rows.join(hot, "fp").select(*names).union(cold.select(*names))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    fingerprint: 16 lowercase hex digits. component_id: the least doc_id reached by
    links of fingerprints that differ in at most `radius` bits, itself included.
    Exact copies share a fingerprint and meet as one node, so a group of any size
    costs one row. Null texts count as empty; texts without words all have
    fingerprint zero and link like any other; very long texts are hashed a piece at a
    time. Rows with a null doc_id take part and get the component's least id that is not
    null (null if it has none). Repeated rows each give a row. An empty table gives an
    empty result."""
    return _classed(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near-duplicates, one a
    group: that with the least doc_id, of several with that id the first by hashes of the
    text and of the other columns, of rows equal in all these one. So rows alike in doc_id
    with different texts are each in the group of its own text. Rows with a null doc_id
    cannot be named by a group and stay. Groups are settled on ids and hashes; the texts are
    joined with what stays once."""
    others = [F.col(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumn("__llm_hash", F.xxhash64(F.xxhash64("text"), *others))
    rows = _classed(keyed.where(F.col("doc_id").isNotNull()), radius, "__llm_hash")
    each = rows.groupBy("root", "doc_id", "__llm_hash").agg(F.count("*").alias("times"))
    first = each.groupBy("root").agg(F.min(F.struct("doc_id", "__llm_hash", "times")).alias("s"))
    keep = written(first.select(F.col("s.doc_id").alias("__llm_id"), F.col("s.__llm_hash").alias("__llm_key"), F.col("s.times").alias("__llm_times")), "keep")
    same = (F.col("doc_id").cast("long") == F.col("__llm_id")) & (F.col("__llm_hash") == F.col("__llm_key"))
    named = keyed.join(F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep, same)
    alone = named.where(F.col("__llm_times") == 1).select(*docs.columns)
    equal = named.where(F.col("__llm_times") > 1).dropDuplicates(["doc_id", "__llm_hash"]).select(*docs.columns)
    return alone.union(equal).union(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir):
    """Near-duplicate classes of all documents."""
    from tideql.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
