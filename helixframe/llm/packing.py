"""Bounded-space online packing of tokenized documents into training windows.

Each partition keeps a fixed number of open windows. A document goes to the open window that it fills best; when none
has room, the fullest takes as much as it holds and is emitted, and the rest goes on. What partitions leave open is
merged at the end, in groups of partitions, the same way; the last window of a group is cut into powers of two. So
every sequence is full or a power of two long, and nothing is padded.

Tokens are made once: documents are read in one pass, whole; only the pieces of windows left open (a fixed number per
partition) meet in a shuffle. Words met before in a task are looked up, about
KNOWN_WORDS of them.

Defined results: a null or empty text is the end token alone; repeated rows are documents each; an empty table gives
no piece; extra columns are ignored. sequence_id depends on how the input is split, the pieces' contents don't.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import by_bytes, settle

WINDOW = 4096
OPEN_WINDOWS = 16
MERGED = 64
KNOWN_WORDS = 400_000
AT_ONCE = 200
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Texts of these characters only are cut at white space and looked up word by word; others go through the tokenizer whole.
_ODD = r"[^\t-\r\x20-\x7e¡«»¿À-ÖØ-öø-įı-ž]"


class WordTokenizer:
    """Ids of a word-level BPE tokenizer as little-endian 32-bit bytes: the same as its own encode(), by remembered words.

    Texts are lower-cased, cut and numbered by Arrow, and only the distinct words of a batch are looked up. What is
    remembered lies in two halves: when the new half is full, it becomes the old one, and words met again move over.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        spec = json.loads(open(path, encoding="utf-8").read())
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        spaces = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": spaces, "added_tokens": []}))
        end = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(end)]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer as it is, made when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def recall(self, words: Iterable[str]) -> list[str]:
        """Moves what the old half knows of these to the new half; the rest."""
        old, rest = self.old, []
        for w in words:
            if w in old:
                self.new[w] = old[w]
            else:
                rest.append(w)
        return rest

    def learn(self, tokens: list[str]) -> None:
        """Remembers white-space-delimited lower-case tokens, and the words they are made of, which are tokens as well."""
        parts = {t: self.split(t) for t in tokens if not t.isalpha()}
        inner = set(chain.from_iterable(parts.values())).difference(self.new)
        words = list({*self.recall(inner), *(t for t in tokens if t not in parts)})
        for a in range(0, len(words), AT_ONCE):
            now = words[a : a + AT_ONCE]
            ids = np.array(self.words.encode_batch_fast([" ".join(now)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.new.update(zip(now, [raw[x:y] for x, y in zip([0, *stops], stops)], strict=True))
        ids_of = self.new.__getitem__
        for t, ws in parts.items():
            if t not in self.new:
                self.new[t] = b"".join(map(ids_of, ws))

    def look_up(self, tokens: list[str]) -> list[bytes]:
        if len(self.new) > KNOWN_WORDS // 2:
            self.new, self.old = {}, self.new
        if missing := list(filterfalse(self.new.__contains__, tokens)):
            self.learn(self.recall(missing))
        return list(map(self.new.__getitem__, tokens))

    def encode(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = pc.fill_null(odd, False)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(pc.if_else(odd, "", texts), "")))
        tokens = lists.values.dictionary_encode()
        known = self.look_up(tokens.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = tokens.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n)].tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
        out = [raw[a:b] for a, b in pairwise(cuts)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


class Windows:
    """Open windows; put() places ids and yields the pieces of each window that fills up."""

    def __init__(self, first_id: int, size: int = WINDOW, count: int = OPEN_WINDOWS):
        self.size, self.next = size, first_id
        self.open: list[list] = [[] for _ in range(count)]
        self.used = [0] * count

    def put(self, doc_id: int | None, ids: bytes, start: int, doc_tokens: int) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while at < n:
            rest = n - at
            fits = [w for w, u in enumerate(self.used) if self.size - u >= rest]
            w = max(fits or range(len(self.used)), key=self.used.__getitem__)
            take = min(rest, self.size - self.used[w])
            self.open[w].append((doc_id, start + at, take, ids[4 * at : 4 * (at + take)], doc_tokens))
            self.used[w] += take
            at += take
            if self.used[w] == self.size:
                yield from self.shut(self.open[w])
                self.open[w], self.used[w] = [], 0

    def shut(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, n, ids, total in pieces:
            yield doc_id, start, n, ids, total, self.next, offset
            offset += n
        self.next += 1

    def left(self) -> list[tuple]:
        """Pieces of the windows still open, fullest window first."""
        return [p for w in sorted(range(len(self.used)), key=lambda w: -self.used[w]) for p in self.open[w]]

    def finish(self) -> Iterator[tuple]:
        """Shuts what is open: pours the windows into one another, the last into powers of two."""
        pieces = self.left()
        total = sum(p[2] for p in pieces)
        sizes = [self.size] * (total // self.size) + [1 << k for k in range(self.size.bit_length() - 1, -1, -1) if total % self.size >> k & 1]
        pieces.reverse()
        for size in sizes:
            now, room = [], size
            while room:
                doc_id, start, n, ids, of = pieces.pop()
                if n > room:
                    pieces.append((doc_id, start + room, n - room, ids[4 * room :], of))
                    n, ids = room, ids[: 4 * room]
                now.append((doc_id, start, n, ids, of))
                room -= n
            yield from self.shut(now)


def _rows(pieces: list[tuple], keep_ids: bool, group: int | None = None) -> pa.RecordBatch:
    cols = list(zip(*pieces, strict=True)) or [()] * 7
    crc = [zlib.crc32(x) for x in cols[3]]
    arrays = [pa.array(x, pa.int64()) for x in (cols[0], cols[1], cols[2], crc, cols[4], cols[5], cols[6])]
    ids = pa.array(cols[3] if keep_ids or group is not None else [None] * len(crc), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    if group is None:
        return pa.RecordBatch.from_arrays([*arrays, ids, pa.nulls(len(crc), pa.int64())], [*names, "open_group"])
    return pa.RecordBatch.from_arrays([*arrays, ids, pa.array([group] * len(crc), pa.int64())], [*names, "open_group"])


def pack(docs: DataFrame, vocab_path: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = True) -> DataFrame:
    """Pieces of docs (doc_id, text): PIECE, and ids (little-endian 32-bit) if keep_ids."""
    end = int(end_id).to_bytes(4, "little")

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer, windows = WordTokenizer(vocab_path), Windows(part << 32, window, open_windows)
        for batch in by_bytes(batches):
            done = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text")), strict=True):
                done += windows.put(doc_id, ids + end, 0, len(ids) // 4 + 1)
            yield _rows(done, keep_ids)
        if left := windows.left():
            yield _rows([(*p, None, None) for p in left], True, part // MERGED)

    def merge(table: pa.Table) -> pa.Table:
        group = table.column("open_group")[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True), key=lambda r: (-len(r[3]), r[0] is None, r[0] or 0, r[1], r[3]))
        windows = Windows(1 << 62 | group << 32, window, open_windows)
        done = []
        for doc_id, start, total, ids in rows:
            done += windows.put(doc_id, ids, start, total)
        return pa.Table.from_batches([_rows([*done, *windows.finish()], keep_ids)])

    schema = PIECE + ", ids binary, open_group long"
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle(read.mapInArrow(online, schema), "pieces")
    merged = pieces.where("open_group is not null").groupBy("open_group").applyInArrow(merge, schema)
    out = pieces.where("open_group is null").unionByName(merged).drop("open_group")
    return out if keep_ids else out.drop("ids")
