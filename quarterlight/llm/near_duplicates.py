"""Near-duplicates by MinHash bands, sequential Bayesian verification and exact confirmation.

1. Every text becomes a set of word shingles, a signature, and band keys.  Texts with the same set form a class; only
   its smallest id goes on, so that copies never meet each other.
2. Classes that share a band key are candidates.  Each member of a key is tied to the key's smallest
   member; of these ties, one link for a member and few between the smallest ones are enough (``ties``).  Connected
   components of the links are clusters: all candidates of a class are in its cluster.
3. Inside a cluster, signatures of banded candidates are compared in batches.  After each batch, a pair goes if
   the posterior probability that it reaches the threshold is below ``MISS``.  Survivors are confirmed on their full sets,
   unless links found before connect the two already.  So a cluster gives a spanning forest, not its pairs.
4. Connected components of the confirmed links are the groups.

A cluster with more shingles than ``BLOCK_SHINGLES`` is cut into blocks, and every two blocks meet in a task of their
own; no task holds more than two blocks, whatever a cluster's size.  Bands are chosen so that a pair at the threshold
shares none with probability below ``UNBANDED``.  Intermediate tables are written below ``spark.checkpoint.dir``; only
counts come to the driver.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; a text shorter than
a shingle is one shingle.  In ``near_duplicates``, rows that repeat an id are one document, and a row without id is never
the one that is kept.  ``deduplicated`` goes by rows instead: one row of each group stays, the one with the smallest id or,
without any, the first; so do all rows that are linked with nothing.  Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.common import fresh, map_rows
from quarterlight.session import stored

MISS, UNBANDED, MOST_HASHES, BATCH = 1e-7, 5e-6, 320, 32
BLOCK_SHINGLES = 2_000_000


def plan_bands(similarity: float) -> tuple[int, int]:
    """Rows of a band and number of bands: the steepest choice within ``MOST_HASHES``."""
    best = (1, 1)
    for rows in range(1, 13):
        bands = math.ceil(math.log(UNBANDED) / math.log1p(-(similarity**rows)))
        if rows * bands <= MOST_HASHES:
            best = (rows, bands)
    return best


def needed_matches(similarity: float, hashes: int) -> list[tuple[int, int, int]]:
    """(start, stop, least matches so far) of each batch.

    With a uniform prior, the posterior probability that a pair with m of n equal bytes reaches the threshold is that of
    at most m successes in n + 1 trials; bytes of different hashes are equal once in 256.
    """
    p = similarity + (1 - similarity) / 256
    out, start = [], 0
    for stop in [*range(BATCH, hashes, BATCH), hashes]:
        total, below = stop + 1, 0.0
        for m in range(total + 1):
            below += math.exp(
                math.lgamma(total + 1) - math.lgamma(m + 1) - math.lgamma(total - m + 1) + m * math.log(p) + (total - m) * math.log1p(-p)
            )
            if below >= MISS:
                break
        out.append((start, stop, m))
        start = stop
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=64)
def place_factors(k: int) -> np.ndarray:
    """An odd factor for each place in a shingle of k words."""
    return np.random.default_rng(1000 + k).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are runs without white space, ASCII letters in lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i, f in enumerate(place_factors(k)):
        total += mixed(w[i : n - k + 1 + i] * f)
    return np.unique(mixed(total + np.uint64(k)))


class Signer:
    """Signatures of shingle sets: smallest values of linear hashes, as bytes, and keys of their bands."""

    def __init__(self, similarity: float):
        self.rows, self.bands = plan_bands(similarity)
        self.hashes = self.rows * self.bands
        rng = np.random.default_rng(7)
        self.a = rng.integers(0, 2**31, (self.hashes, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, (self.hashes, 1), dtype=np.uint32)
        self.fold = rng.integers(0, 2**63, (1, self.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def smallest(self, keys: np.ndarray) -> np.ndarray:
        x = (keys >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.hashes, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            values = self.a * x[None, at : at + 512]
            values += self.b
            np.minimum(out, values.min(axis=1), out=out)
        return out

    def sign(self, keys: np.ndarray) -> tuple[bytes, list[int]]:
        low = self.smallest(keys)
        short = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        folded = (mixed(low.astype(np.uint64)).reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64)
        return short.tobytes(), mixed(folded).astype(np.int64).tolist()


def features(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, number of shingles, digest of the set, signature and band keys (none for an empty set)."""

    def run(rows):
        signer = Signer(similarity)
        for doc_id, text in rows:
            keys = shingles(text, width)
            if len(keys):
                yield doc_id, len(keys), xxhash.xxh3_128_hexdigest(keys.tobytes()), *signer.sign(keys)
            else:
                yield doc_id, 0, None, None, None

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, digest string, sig binary, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected links (a, b), for every node that has a link.

    Each round takes the smallest label among neighbours, then the label's own label; rounds are written to the shared
    folder, and end when no label changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.least("label", "offer").alias("next"), "label")
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = lower.join(above, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("new"), "label")
        step = stored(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.filter("new < label").isEmpty():
            return labels


def ties(tied: DataFrame) -> DataFrame:
    """Links (a, b) with the components of the pairs (rep, low), where a member has at most one low for each of its bands.

    A member keeps one link, to the smallest of its lows; its other lows are linked with that one, and as the members of
    a large group have the same few lows, these links are few after ``distinct``.
    """
    each = tied.groupBy("rep").agg(F.min("low").alias("least"), F.collect_set("low").alias("lows"))
    own = each.select(F.col("rep").alias("a"), F.col("least").alias("b"))
    between = each.filter(F.size("lows") > 1).select(F.explode("lows").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    return own.unionByName(between)


class Block:
    """Candidate pairs of one task, confirmed and joined."""

    def __init__(self, rows: list[tuple], width: int, similarity: float, needed: list[tuple[int, int, int]]):
        """rows: id, side, text, signature, band keys."""
        self.ids = [r[0] for r in rows]
        self.side = np.array([r[1] for r in rows])
        sets = [shingles(r[2], width) for r in rows]
        self.size = np.array([len(s) for s in sets])
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        every = np.concatenate(sets)
        values, self.index = np.unique(every, return_inverse=True)
        self.marked = np.zeros(len(values), bool)
        self.sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([r[4] for r in rows], np.int64)
        self.similarity, self.needed = similarity, needed

    def buckets(self) -> list[list[np.ndarray]]:
        """For each member, the members of each of its bands that has more than one."""
        out: list[list[np.ndarray]] = [[] for _ in self.ids]
        for k in range(self.bands.shape[1]):
            order = np.argsort(self.bands[:, k], kind="stable")
            keys = self.bands[order, k]
            for group in np.split(order, np.flatnonzero(keys[1:] != keys[:-1]) + 1):
                if len(group) > 1:
                    for i in group:
                        out[i].append(group)
        return out

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x's set with the others' sets."""
        own = self.index[self.start[x] : self.start[x + 1]]
        self.marked[own] = True
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.start[others] - (ends - sizes), sizes)
        hits = np.concatenate(([0], np.cumsum(self.marked[self.index[places]])))
        self.marked[own] = False
        return hits[ends] - hits[ends - sizes]

    def links(self, across: bool) -> Iterator[tuple[int, int]]:
        """Confirmed links that connect what was not connected; ``across``: between the two sides only."""
        label = np.arange(len(self.ids))
        near = np.zeros(len(self.ids), bool)
        for x, groups in enumerate(self.buckets()):
            if not groups:
                continue
            near[:] = False
            for group in groups:
                near[group] = True
            left = np.flatnonzero(near[:x])
            left = left[label[left] != label[x]]
            if across:
                left = left[self.side[left] != self.side[x]]
            small, large = np.minimum(self.size[left], self.size[x]), np.maximum(self.size[left], self.size[x])
            left = left[small >= self.similarity * large - 1e-9]
            matches = np.zeros(len(left), np.int32)
            for start, stop, least in self.needed:
                if not len(left):
                    break
                matches += (self.sig[left, start:stop] == self.sig[x, start:stop]).sum(axis=1, dtype=np.int32)
                alive = matches >= least
                left, matches = left[alive], matches[alive]
            left, chunk = left[np.argsort(-matches, kind="stable")], 1
            while len(left):
                tried, left = left[:chunk], left[chunk:]
                chunk = min(4 * chunk, 256)
                common = self.shared(x, tried)
                union = self.size[tried] + self.size[x] - common
                for y in tried[reaches(common, union, self.similarity)]:
                    if label[y] != label[x]:
                        yield self.ids[x], self.ids[y]
                        label[label == label[y]] = label[x]
                left = left[label[left] != label[x]]


def reaches(common: np.ndarray, union: np.ndarray, similarity: float) -> np.ndarray:
    """Exact in ten-thousandths."""
    return 10_000 * common >= round(10_000 * similarity) * union


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    found = stored(features(docs, width, similarity), "features")
    classes = stored(
        found.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    keys = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    lowest = keys.groupBy("band", "key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    tied = keys.join(lowest, ["band", "key"]).filter("rep <> low").select("rep", "low")
    clusters = components(ties(tied)).withColumnsRenamed({"node": "rep", "label": "cluster"})
    members = stored(clusters.join(classes.drop("digest"), "rep"), "members")
    weights = members.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    placed = members.join(weights, "cluster").join(texts, "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "own", "text", "sig", "bands"
    )
    dealt = placed.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "rep")
    hashes = math.prod(plan_bands(similarity))

    def run(rows):
        needed = needed_matches(similarity, hashes)
        for (_, lo, hi), group in groupby(rows, key=lambda r: r[:3]):
            block = Block([r[3:] for r in group], width, similarity, needed)
            yield from block.links(lo != hi)

    links = stored(map_rows(dealt, run, "a long, b long"), "confirmed")
    groups = components(links).withColumnsRenamed({"node": "rep", "label": "component_id"})
    reps = classes.select("digest", "rep").join(groups, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group, by id (those without last) and place; all columns come through."""
    (row_,) = fresh(docs, "_row")
    # Stored, as every use must see the same numbers.
    rows = stored(docs.withColumn(row_, F.monotonically_increasing_id()), "numbered")
    numbered = rows.select(F.col(row_).alias("doc_id"), "text")
    groups = near_duplicates(numbered, width, similarity).select(F.col("doc_id").alias("row"), "component_id")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # One strategy at every size: both sides have a small row for each document.
    ids = rows.select(F.col(row_).alias("row"), F.col("doc_id").alias("id"))
    best = groups.join(ids.hint("merge"), "row").groupBy("component_id").agg(F.min(place).alias("first"))
    kept = best.select(F.col("first.row").alias(row_))
    return rows.join(kept, row_, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
