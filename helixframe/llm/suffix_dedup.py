"""Exact removal of repeated byte strings: every byte covered by a string of LENGTH bytes that also starts elsewhere.

Finding repeats needs a suffix order over the whole corpus; sharding makes it local. Each LENGTH-byte window has a
minimizer, the least hash among its GRAM-byte grams. Equal windows have equal minimizers, so the corpus falls into
shards by minimizer: maximal runs of windows with the same minimizer occurrence ("stretches") go to its shard, and two
equal windows always meet there. A shard is suffix-sorted by external induced sorting (suffix_sort): windows whose
common prefix with a neighbour in suffix order is LENGTH or more are repeats. Every span comes from that sort.

What keeps shards small: a minimizer that occurs once has no repeat and goes no further. Stretches of equal content are
one class; a class that occurs more than once lies in its shard twice, so the sort finds its windows repeated, and what
it finds is handed to all of the class's places by a join. So a text with a third of all documents as copies costs two
stretches in the sort, and nothing is dropped. A class that is the only one under its key can lie in any shard: it goes
with its neighbours in the text, in one piece, so that their overlapping ends are sorted once. A minimizer with more than HOT classes (a passage in very many contexts)
is split: its windows are dealt by the place of the gram in them, and each part is keyed by the bytes that all its
windows hold. Equal windows still meet, the classes of each new key are again counted before they are sorted, and the
parts get finer until a part is one window and so one class. All this is the same at every size.

A partition's rows come sorted by key; shards of about SHARD_BYTES are cut from them where the key changes, so neither
partitions nor memory grow with the corpus.

Digests: a class is told by its key (64 bits) and a 64-bit digest of its bytes. Documents are told by a number that is
written with their text before anything else is done; doc_id is never compared.

Defined results: a null or empty text has 0 bytes and keeps 0; windows never cross documents; repeated rows are
documents each; a null doc_id is a document like any other; a text of one repeated byte keeps nothing from 201
bytes on; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import suffix_sort
from helixframe.llm.common import by_bytes, merged, settle
from helixframe.llm.shingles import _coefficients, _mix

LENGTH, GRAM = 200, 64
HOT = 2048
SHARD_BYTES = 1 << 20
#: Neighbouring classes whose keys are theirs alone are sorted as one piece, so many at most.
NEIGHBOURS = 64
PIECE = 1 << 18
#: A hot key's windows fall into this many parts by the place of its gram, and each part into as many again.
FINER = 4

_OF_BYTE = _coefficients(256, 11)
_FACTORS = _coefficients(16, 12)
#: A stretch: its key and the digest of its bytes, its owner (a document's number, or a class one level up), its first
#: byte there, its windows, and where its gram begins.
PLACE = "h long not null, d long not null, o1 long not null, o2 long not null, start long not null, windows int not null, gram int not null"
#: Bytes to sort: of one class, or of neighbouring ones that share no key with others.
PIECES = "h long, copied boolean, gram int, content binary, members array<struct<h:long,d:long,first:int,windows:int>>"
FOUND = "h long, d long, first int, last int"
MEMBERS = pa.list_(pa.struct([("h", pa.int64()), ("d", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())]))


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each place; gram is a power of two."""
    h, k = _OF_BYTE[b], 1
    while k < gram:
        h = h[:-k] * _FACTORS[k.bit_length()] + h[k:]
        k *= 2
    return _mix(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbouring values."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def stretches(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer occurrence in joined documents that end at ends: minimizer, first window,
    windows, and the minimizer's place."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(b) < length:
        return none
    grams = gram_hashes(b, gram)
    least = sliding_least(grams, length - gram + 1)
    n = len(b) - length + 1
    inside = np.ones(n, bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1) : end] = False
    new = np.r_[True, (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1]) | ~inside[:-1]]
    at = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.r_[(new[1:] | ~inside[1:]), True] & inside) + 1
    # the first gram from a window's start on that has the least hash, among those that are the least of any window
    h, width = least[at], length - gram + 1
    most = ~sliding_least(~np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)], width)
    chosen = np.flatnonzero(most == grams)
    place = np.searchsorted(chosen, at)
    left = np.arange(len(at))
    while len(left := left[grams[chosen[place[left]]] != h[left]]):
        place[left] += 1
    place = chosen[place]
    return h, at, stop - at, place - at


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts as bytes with the documents' ends, places in the batch, and offsets in their texts; long ones in parts."""
    joined, ends, docs, offsets, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[a : a + PIECE + length - 1] if len(t) > PIECE + length else t
            joined.append(part)
            size += len(part)
            ends.append(size)
            docs.append(i)
            offsets.append(a)
            if size >= PIECE:
                yield np.frombuffer(b"".join(joined), np.uint8), np.array(ends), np.array(docs), np.array(offsets)
                joined, ends, docs, offsets, size = [], [], [], [], 0
            if part is t:
                break
    if joined:
        yield np.frombuffer(b"".join(joined), np.uint8), np.array(ends), np.array(docs), np.array(offsets)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a number of their own, and their texts compressed."""
    import zstandard

    z, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 36
    for batch in by_bytes(batches, 4 << 20):
        packed = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(packed)), pa.int64()), batch.column("doc_id"), pa.array(packed, pa.binary())], ["number", "doc_id", "packed"])
        number += len(packed)


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """A batch's rows, a few at a time as Python objects."""
    for a in range(0, batch.num_rows, 128):
        yield from zip(*(batch.column(c).slice(a, 128).to_pylist() for c in columns), strict=True)


def _batch(columns: Iterable, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<struct<h:long,d:long,first:int,windows:int>>": MEMBERS}
    fields = [f.split()[:2] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _cut(length: int, gram: int):
    """The stretches of each document."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
        import zstandard

        z, numbers, texts, size = zstandard.ZstdDecompressor(), [], [], 0
        for batch in batches:
            for number, packed in _rows(batch, "number", "packed"):
                numbers.append(number)
                texts.append(z.decompress(packed))
                size += len(texts[-1])
                if size > 1 << 20:
                    yield numbers, texts
                    numbers, texts, size = [], [], 0
        yield numbers, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for numbers, texts in groups(batches):
            of_text = np.array(numbers, np.int64)
            for b, ends, docs, offsets in _pieces(texts, length):
                h, at, n, place = stretches(b, ends, length, gram)
                if len(h):
                    data = b.tobytes()
                    d = np.array([digest(data[s:e]) for s, e in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)], np.uint64)
                    of = np.searchsorted(ends, at, "right")
                    begins = np.r_[0, ends[:-1]]
                    yield _batch((h.view(np.int64), d.view(np.int64), of_text[docs[of]], np.zeros(len(h), np.int64), at - begins[of] + offsets[of], n.astype(np.int32), place.astype(np.int32)), PLACE)

    return run


def neighbours(wanted: list[dict]) -> Iterator[list[dict]]:
    """A text's wanted classes in groups that are sorted as one piece: runs of neighbours that are alone under their keys."""
    group: list[dict] = []
    for w in sorted(wanted, key=lambda w: w["start"]):
        if group and not (w["alone"] and group[-1]["alone"] and w["start"] == group[-1]["start"] + group[-1]["windows"] and len(group) < NEIGHBOURS):
            yield group
            group = []
        group.append(w)
    if group:
        yield group


def _extract(length: int):
    """The bytes of one stretch of each class, from the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, rows, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for packed, wanted in _rows(batch, "packed", "wanted"):
                text = z.decompress(packed)
                for group in neighbours(wanted):
                    start, last = group[0]["start"], group[-1]
                    content = text[start : last["start"] + last["windows"] + length - 1]
                    rows.append((last["h"], last["copied"], last["gram"], content, [{"h": w["h"], "d": w["d"], "first": w["start"] - start, "windows": w["windows"]} for w in group]))
                    size += len(content)
                if size > 1 << 20:
                    yield _batch(zip(*rows, strict=True), PIECES)
                    rows, size = [], 0
        if rows:
            yield _batch(zip(*rows, strict=True), PIECES)

    return run


def split(content: bytes, gram: int, length: int, step: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Parts of a stretch whose gram begins at `gram`: place of the part, first window, windows, and the bytes shared.

    A window's place is the gram's offset in it, in steps. Equal windows have equal places, and the bytes that every
    window of a place must hold, so both may be the key under which they meet.
    """
    windows = len(content) - length + 1
    for place in range((gram - windows + 1) // step, gram // step + 1):
        first, last = max(0, gram - (place + 1) * step + 1), min(windows - 1, gram - place * step)
        yield place, first, last - first + 1, content[gram - place * step : gram + length - (place + 1) * step + 1]


def _split(length: int, step: int):
    """Finer stretches of the classes of hot keys; a class with copies is there twice, as in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for h, copied, gram, content, members in _rows(batch, "h", "copied", "gram", "content", "members"):
                d = members[0]["d"]
                for place, first, windows, core in split(content, gram, length, step):
                    part = content[first : first + windows + length - 1]
                    key, digest = (x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh3_64_intdigest(core, place), xxhash.xxh3_64_intdigest(part)))
                    rows += [(key, digest, h, d, first, windows, gram - first, part)] * (2 if copied else 1)
            if rows:
                yield _batch(zip(*rows, strict=True), PLACE.replace(" not null", "") + ", content binary")

    return run


def _sort_shards(length: int, memory: int):
    """Repeated windows (first, last) of classes. Rows come sorted by key; a shard ends where the key changes."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows, size, now = [], 0, None
        for batch in batches:
            for row in _rows(batch, "h", "copied", "content", "members"):
                if row[0] != now:
                    now = row[0]
                    if size > SHARD_BYTES:
                        yield rows
                        rows, size = [], 0
                rows.append(row)
                size += (len(row[2]) + 1) * (2 if row[1] else 1)
        if rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            for rows in shards(batches):
                content = [r[2] for r in rows]
                twins = [r[2] for r in rows if r[1]]
                raw = np.frombuffer(b"\xff".join(content + twins) + b"\xff", np.uint8) + np.uint8(suffix_sort.SHIFT)  # 0xFF wraps to the separator
                hit = suffix_sort.repeated(np.concatenate([raw, np.zeros(1, np.uint8)]), length, folder, memory)
                begin = np.cumsum([0, *(len(c) + 1 for c in content)])[:-1]
                member = np.array([(m["h"], m["d"], b + m["first"], m["windows"]) for b, r in zip(begin.tolist(), rows, strict=True) for m in r[3]], np.int64)
                of = np.searchsorted(member[:, 2], hit, "right") - 1
                at = hit - member[of, 2]
                inside = at < member[of, 3]  # else it is a twin, or runs over a separator into the next piece
                of, at = of[inside], at[inside]
                if not len(at):
                    continue
                head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])
                tail = np.r_[head[1:], len(at)] - 1
                yield _batch((member[of[head], 0], member[of[head], 1], at[head].astype(np.int32), at[tail].astype(np.int32)), FOUND)

    return run


def _remove(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, spans in _rows(batch, "doc_id", "packed", "spans"):
                text = z.decompress(packed)
                runs: list[list[int]] = []
                for s, e in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                parts, at = [], 0
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                kept = b"".join([*parts, text[at:]])
                out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None, [{"start": s, "stop": e} for s, e in runs] if keep_bytes else None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "spans"])

    return run


def _parts(size: int) -> int:
    """Partitions for the sort: small ones while there are few, of a gigabyte when there is much."""
    return max(1, min(size // (8 << 20), 4096), size >> 30)


def _solve(places: DataFrame, contents, length: int, memory: int, step: int, hot: int) -> DataFrame:
    """The repeated windows (o1, o2, first, last) of places (PLACE) whose key occurs more than once.

    contents: gives the pieces (PIECES) of a table of classes (h, d, copied, alone, and one place).
    """
    one = F.struct("o1", "o2", "start", "windows", "gram")
    counted = places.groupBy("h", "d").agg(F.count("*").alias("copies"), F.min(one).alias("one"))
    counted = settle(counted.select("h", "d", (F.col("copies") > 1).alias("copied"), "one.*"), "counted")
    kinds = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.max("copied").alias("any"))
    kinds = kinds.where(F.col("any") | (F.col("kinds") > 1))
    known = settle(counted.join(merged(kinds.select("h", (F.col("kinds") > hot).alias("hot"), (F.col("kinds") == 1).alias("alone"))), "h"), "classes")
    size, any_hot = known.agg(F.sum(F.when(~F.col("hot"), (F.col("windows") + length) * (1 + F.col("copied").cast("int")))), F.max("hot")).first()
    plain = contents(known.where(~F.col("hot"))).repartition(_parts(size or 0), "h").sortWithinPartitions("h")
    found = plain.select("h", "copied", "content", "members").mapInArrow(_sort_shards(length, memory), FOUND)
    if any_hot:
        finer = settle(contents(known.where("hot")).mapInArrow(_split(length, step), PLACE + ", content binary"), "finer")
        inner = _solve(finer.drop("content"), _within(finer), length, memory, max(1, -(-step // FINER)), hot)
        found = found.union(inner.select(F.col("o1").alias("h"), F.col("o2").alias("d"), "first", "last"))
    met = places.select("h", "d", "o1", "o2", "start").join(merged(found), ["h", "d"])
    return met.select("o1", "o2", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def _within(finer: DataFrame):
    """contents() of classes whose places carry their bytes."""

    def of(classes: DataFrame) -> DataFrame:
        bytes_of = finer.groupBy("h", "d").agg(F.first("content").alias("content"))
        member = F.struct("h", "d", F.lit(0).alias("first"), "windows")
        return bytes_of.join(merged(classes.select("h", "d", "copied", "gram", "windows")), ["h", "d"]).select("h", "copied", "gram", "content", F.array(member).alias("members"))

    return of


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, memory: int = suffix_sort.MEMORY, keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes kept_bytes and the removed spans."""
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = settle(read.mapInArrow(_number, "number long, doc_id long, packed binary"), "numbered")
    texts = numbered.select("number", "packed")
    cut = texts.mapInArrow(_cut(length, gram), PLACE)
    often = settle(cut.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select("h"), "often")
    places = settle(cut.join(merged(often), "h"), "places")

    def contents(classes: DataFrame) -> DataFrame:
        wanted = classes.groupBy(F.col("o1").alias("number")).agg(F.collect_list(F.struct("h", "d", "copied", "alone", "start", "windows", "gram")).alias("wanted"))
        return texts.join(merged(wanted), "number").select("packed", "wanted").mapInArrow(_extract(length), PIECES)

    spans = _solve(places, contents, length, memory, -(-(length - gram + 1) // FINER), hot)
    of_doc = spans.groupBy(F.col("o1").alias("number")).agg(F.collect_list(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("stop"))).alias("spans"))
    met = numbered.join(merged(of_doc), "number", "left")
    out = met.select("doc_id", "packed", "spans").mapInArrow(_remove(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, spans array<struct<start:long,stop:long>>")
    return out if keep_bytes else out.drop("kept_bytes", "spans")
