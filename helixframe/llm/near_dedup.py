"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts are sets of word shingles. Equal sets are one class, so copies cost no comparison. Signatures of the classes are
cut into bands; classes that share a band's bucket are candidates. A candidate's signatures are compared batch by batch:
with a uniform prior on the similarity, matches so far give its posterior, and a pair goes as soon as the probability
that it reaches the threshold falls below MISS. Survivors are verified on their full sets.

A bucket of m classes isn't expanded into its m * m pairs. First each class is compared with the bucket's smallest (a
row for each class), and the links found are closed into components. Then only buckets that still hold several
components are looked at again: their signatures are compared in blocks, between components alone, and what survives is
verified. So every pair of a bucket is either compared or already in one component, and large groups of near copies
cost one comparison a member. Large buckets are split into blocks of BLOCK rows that meet pairwise.

With 32 bands of 6, two texts of similarity 0.8 share no bucket with a chance of 6e-5 (0.9: 6e-11); MISS adds at most
about 1e-6 for each of the six batches.

A class is told by a number that is written with it; doc_id appears in the result alone, so rows that share one with
different texts, or have none, lose no link.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and kept; a row without a
doc_id links like any other, takes the smallest doc_id it reaches (null if there is none) and isn't kept by `cluster`;
rows of one doc_id are one document, so their texts' components are one there; repeated rows of a doc_id are all kept if
it is the smallest; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import WORD_CLASS, by_bytes, merged, settle
from helixframe.llm.components import components
from helixframe.llm.shingles import MinHash, _coefficients, _mix, shingle_sets

WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 6
BATCH = 32
MISS = 1e-6
BLOCK = 2048


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest matches among `compared` hashes at which P(similarity >= threshold) is at least miss."""
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= miss:
            return m
    return compared


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Places of the signature pairs that no batch prunes."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for start in range(0, a.shape[1], BATCH):
        stop = min(start + BATCH, a.shape[1])
        matches = matches + (a[left, start:stop] == b[left, start:stop]).sum(1)
        good = matches >= least_matches(stop, threshold, miss)
        left, matches = left[good], matches[good]
    return left


def _sign(words: int, size: int):
    """doc_id, key of the text, set size, digest of the set, signature."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(size)
        for batch in by_bytes(batches, 1 << 20):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signs = [minhash(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "key", "n_shingles", "digest", "sign"])

    return run


def _signatures(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint16).reshape(batch.num_rows, -1)


def _bands(bands: int, rows: int):
    factors = _coefficients(bands * rows, 5).reshape(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _signatures(batch, "sign").reshape(-1, bands, rows).astype(np.uint64) + np.uint64(1)
                keys = _mix((s * factors).sum(2) + factors[:, 0]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(keys))), pa.array(np.repeat(batch.column("node").to_numpy(), bands))], ["bucket", "band", "node"])

    return run


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = surviving(_signatures(batch, "sign_a"), _signatures(batch, "sign_b"), threshold, miss)
                yield batch.select(["a", "b"]).take(pa.array(left))

    return run


class _Cell:
    """Rows of two blocks of a bucket (or of one with itself), each with a component label and a signature."""

    def __init__(self, rows: list[tuple], band: int, bands: int, threshold: float, miss: float):
        self.rows, self.band, self.bands, self.threshold, self.miss = rows, band, bands, threshold, miss
        self.node, self.label, self.block = (np.array([r[i] for r in rows]) for i in range(3))
        self.sign = np.frombuffer(b"".join([r[3] for r in rows]), np.uint16).reshape(len(rows), -1)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row, and rows of other components that no batch prunes against it, most alike first. Each pair once; pairs
        that share an earlier band are left to that one."""
        labels, counts = np.unique(self.label, return_counts=True)
        main, two = labels[counts.argmax()], self.block.min() != self.block.max()
        banded = self.sign.reshape(len(self.rows), self.bands, -1)
        for i in np.flatnonzero(self.label != main).tolist():
            other = self.label != self.label[i]
            if two:
                other &= self.block != self.block[i]
            # a pair of two lesser labels is met from both sides, one with the main label from its lesser side only
            other = np.flatnonzero(other & ((self.label == main) | (self.node > self.node[i])))
            other = other[surviving(np.broadcast_to(self.sign[i], (len(other), self.sign.shape[1])), self.sign[other], self.threshold, self.miss)]
            if len(other):
                other = other[(banded[other] == banded[i]).all(2).argmax(1) == self.band]
            if len(other):
                yield i, other[np.argsort(-(self.sign[other] == self.sign[i]).sum(1), kind="stable")]


def _cells(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], make) -> Iterator[tuple[list, _Cell]]:
    """Cells of batches that come sorted by (bucket, i, j)."""
    rows: list[tuple] = []
    now = None
    for batch in batches:
        for *cell, band, row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "band")), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if now is None or now[0] != cell:
                if len(rows) > 1:
                    yield now[0], make(rows, now[1])
                rows, now = [], (cell, band)
            rows.append(row)
    if len(rows) > 1:
        yield now[0], make(rows, now[1])


def _involved(bands: int, threshold: float, miss: float):
    """Rows of cells that have a surviving partner in another component there: at most the rows that came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), cell in _cells(batches, ("node", "label", "block", "sign"), lambda rows, band: _Cell(rows, band, bands, threshold, miss)):
            hit = sorted({k for a, others in cell.pairs() for k in (a, *others.tolist())})
            if hit:
                own = [cell.rows[k] for k in hit]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array([cell.band] * n, pa.int32()), *(pa.array([r[c] for r in own], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary())))], ["bucket", "i", "j", "band", "node", "label", "block", "sign"])

    return run


def _links_between(words: int, percent: int, bands: int, threshold: float, miss: float):
    """Exactly verified links between components. A row is compared with a component until one link to it is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for _, cell in _cells(batches, ("node", "label", "block", "sign", "packed"), lambda rows, band: _Cell(rows, band, bands, threshold, miss)):
            sets: dict[int, np.ndarray] = {}
            joined: dict[int, int] = {}
            found = []

            def root(x: int, joined: dict[int, int] = joined) -> int:
                while x in joined:
                    x = joined[x]
                return x

            def set_of(k: int, sets: dict[int, np.ndarray] = sets, cell: _Cell = cell) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingle_sets([z.decompress(cell.rows[k][4])], words)[0]
                return sets[k]

            for i, others in cell.pairs():
                for k in others.tolist():
                    a, b = root(cell.label[i].item()), root(cell.label[k].item())
                    if a != b and alike(set_of(i), set_of(k), percent):
                        joined[max(a, b)] = min(a, b)
                        found.append((cell.rows[i][0], cell.rows[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' Jaccard similarity reaches percent, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in by_bytes(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([z.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "key", "packed"])


def _verify(words: int, percent: int):
    """Pairs (a, b, and both texts) whose full sets are similar enough. Rows come sorted by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for k, (a, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True)):
                if a != last:
                    last, own = a, shingle_sets([z.decompress(x)], words)[0]
                other = shingle_sets([z.decompress(y)], words)[0]
                if alike(own, other, percent):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


#: What tells rows apart: doc_id (two plain columns, for a null) and a digest of the text.
ROW = ["no_id", "id", "key"]


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})


def _key(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _linked(docs: DataFrame, words: int, percent: int, bands: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, n_shingles, digest), and classes (digest, node, label, one): label is the smallest node that
    links reach, one the least row (ROW) of the class."""
    threshold = percent / 100
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _key().alias("key"))
    signed = settle(read.mapInArrow(_sign(words, bands * rows), "doc_id long, key binary, n_shingles long, digest binary, sign binary"), "signed")
    first = _identified(signed.where("digest is not null")).groupBy("digest").agg(F.min(F.struct(*ROW)).alias("one"), F.min("sign").alias("sign"))
    classes = settle(first.withColumns({"node": F.monotonically_increasing_id()}), "classes")
    signs = classes.select("node", "sign")

    in_band = signs.mapInArrow(_bands(bands, rows), "bucket long, band int, node long")
    buckets = in_band.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    members = settle(in_band.join(merged(buckets), "bucket"), "members")

    texts = _identified(read.mapInArrow(_shrink, "doc_id long, key binary, packed binary")).drop("doc_id")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """One text for each node that is asked for."""
        one = classes.select("node", "one.*").join(merged(wanted.distinct()), "node")
        return settle(texts.join(merged(one), ROW).dropDuplicates(["node"]).select("node", "packed"), "texts")

    def sign_as(name: str) -> DataFrame:
        return merged(signs.select(F.col("node").alias(name), F.col("sign").alias(f"sign_{name}")))

    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pruned = stars.join(sign_as("a"), "a").join(sign_as("b"), "b").mapInArrow(_prune(threshold, miss), "a long, b long")
    pairs = settle(pruned, "pairs")
    held = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    text_as = lambda x: merged(held.select(F.col("node").alias(x), F.col("packed").alias(f"text_{x}")))
    both = pairs.join(text_as("a"), "a").join(text_as("b"), "b").sortWithinPartitions("a")
    links = settle(both.mapInArrow(_verify(words, percent), "a long, b long"), "links")
    labels = settle(components(links), "labels")

    of_three = members.where("n > 2").join(merged(labels), "node", "left").select("bucket", "band", "node", "n", F.coalesce("component", "node").alias("label"))
    mixed = of_three.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("bucket")
    open_ = of_three.join(merged(mixed), "bucket", "left_semi").join(merged(signs), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = open_.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    cells = open_.withColumns({"other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    columns = ["bucket", "i", "j", "band", "node", "label", "block", "sign"]
    met = cells.select(*columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    met = settle(met.mapInArrow(_involved(bands, threshold, miss), "bucket long, i int, j int, band int, node long, label long, block int, sign binary"), "open")
    if not met.isEmpty():
        told = met.join(merged(texts_of(met.select("node"))), "node").select(*columns, "packed").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        more = settle(told.mapInArrow(_links_between(words, percent, bands, threshold, miss), "a long, b long").distinct(), "more")
        if not more.isEmpty():
            stars_now = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(stars_now.union(more))
    of_class = classes.select("digest", "node", "one").join(merged(labels), "node", "left")
    return signed.select("doc_id", "n_shingles", "digest"), settle(of_class.select("digest", "node", F.coalesce("component", "node").alias("label"), "one"), "of_class")


def cluster(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    signed, classes = _linked(docs, words, percent, bands, rows, miss)
    of_id = signed.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    shared = of_id.where("least <> most").select("doc_id")
    if not shared.isEmpty():
        label = merged(classes.select("digest", "label"))
        of_row = signed.join(merged(shared), "doc_id").join(label, "digest").select("doc_id", "label").distinct()
        same = of_row.join(merged(of_row.groupBy("doc_id").agg(F.min("label").alias("b"))), "doc_id").select(F.col("label").alias("a"), "b")
        wider = components(same).select(F.col("node").alias("label"), "component")
        classes = classes.join(merged(wider), "label", "left").select("digest", F.coalesce("component", "label").alias("label"), "one")
    least = classes.where(~F.col("one.no_id")).groupBy("label").agg(F.min("one.id").alias("component"))
    of_class = classes.join(merged(least), "label", "left").select("digest", "component")
    out = signed.join(merged(of_class), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pipeline's stage: one document of each group of linked texts stays, that with the smallest doc_id (then text);
    of rows equal in both, one. Texts without words are linked with nothing, and all stay.

    Rows that share a doc_id stay if their texts aren't linked. Of a group without a doc_id one row stays.
    """
    names = docs.columns
    _, classes = _linked(docs, words, percent, BANDS, ROWS, MISS)
    winners = classes.groupBy("label").agg(F.min("one").alias("one")).select(*[F.col(f"one.{c}").alias(f"__{c}") for c in ROW])
    id_ = F.col("doc_id").cast("bigint")
    # a row without words has no class; its like are told by that there is nothing but white space
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD_CLASS)
    keyed = docs.where(~wordless).withColumns({"__no_id": id_.isNull(), "__id": F.coalesce(id_, F.lit(0)), "__key": _key()})
    held = keyed.join(merged(winners), [f"__{c}" for c in ROW], "left_semi").dropDuplicates([f"__{c}" for c in ROW])
    columns = [F.col(f"`{c}`") for c in names]
    return held.select(*columns).unionByName(docs.where(wordless).select(*columns))
