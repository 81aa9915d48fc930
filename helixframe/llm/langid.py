"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has its own probability for every piece. The likelihood of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words.
Words and pieces are whole, whatever their length: the recursion carries the last few sums alone, and their scale as a
logarithm, so long words neither underflow nor take memory.
Piece probabilities are fitted by expectation maximisation (forward-backward) on counted words of labelled documents.

The fit uses at most DOCS_PER_LANG documents a language, chosen by a hash of doc_id: the word table is then bounded
and so is what the driver gathers (pieces x languages). Scoring reads every text once and shuffles nothing; words met
before in a task are looked up.

Defined results: a text that is null or has no letter is `und` with score 0; without a labelled document all texts
are; ties go to the first language in code-point order; repeated rows and further columns don't matter.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import by_bytes

DOCS_PER_LANG = 4000
ROUNDS = 3
KNOWN_WORDS = 400_000
#: Characters of words that a task keeps, and that one call of the recursion takes (a longer word is one alone).
KNOWN_CHARS, PART = 16 << 20, 1 << 15
_LETTER = re.compile(r"[^\W\d_]")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def vocabulary(path: str) -> dict[str, int]:
    """Piece -> row of the tables, from a SentencePiece model; row 0 is for characters without a piece of their own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return {p: i for i, p in enumerate(sorted({p for p in pieces if p == p.lower() and _LETTER.search(p)}), 1)}


def word_of(token: str) -> str:
    """A lower-case token without its edges' digits and marks, led by a word mark; empty if nothing is left."""
    word = _EDGES.sub("", token)
    return "▁" + word if word else ""


class Pieces:
    """Finds pieces at every place of many words at once: two hash tables without collisions, probed by array."""

    BITS = 20

    def __init__(self, vocab: dict[str, int]):
        self.size, self.longest = len(vocab) + 1, max(map(len, vocab), default=1)
        self.keys, self.rows = np.zeros((2, 1 << self.BITS), np.uint64), np.full((2, 1 << self.BITS), -1, np.int32)
        rest = list(vocab.items())
        for t in range(2):
            left, taken = [], set()
            for piece, row in rest:
                key = self._key(piece)
                at = int(self._slot(np.array([key], np.uint64), t)[0])
                if at in taken:
                    left.append((piece, row))
                else:
                    taken.add(at)
                    self.keys[t, at], self.rows[t, at] = key, row
            rest = left
        self.rest = {np.uint64(self._key(p)): r for p, r in rest}

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for c in piece:
            key = (key * 0x9E3779B97F4A7C15 + ord(c) + 1) & ((1 << 64) - 1)
        return key

    def _slot(self, keys: np.ndarray, t: int) -> np.ndarray:
        return (keys * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[t])) >> np.uint64(64 - self.BITS)

    def find(self, words: list[str]) -> np.ndarray:
        """[word, i, k]: the row of the piece of k + 1 characters at i (-1: none). All words are of one length."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out = np.full((len(words), n, min(n, self.longest)), -1, np.int32)
        keys = np.zeros((len(words), n + 1), np.uint64)
        for k in range(out.shape[2]):
            keys = keys[:, : n - k] * np.uint64(0x9E3779B97F4A7C15) + codes[:, k:]
            for t in (0, 1):
                slot = self._slot(keys, t)
                hit = self.keys[t][slot] == keys
                out[:, : n - k, k][hit] = self.rows[t][slot[hit]]
            for key, row in self.rest.items():
                out[:, : n - k, k][keys == key] = row
        none = out[:, :, 0] < 0
        out[:, :, 0][none] = 0
        return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, in handy parts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        step = max(1, PART // int(size[part[0]]))
        for a in range(0, len(part), step):
            yield part[a : a + step]


def ending(ids: np.ndarray) -> np.ndarray:
    """ids [word, start, k] by the place where the piece ends: [end, k, word]; -1 where it would start before the word."""
    w, n, longest = ids.shape
    out = np.full((n, longest, w), -1, ids.dtype)
    for k in range(longest):
        out[k:, k] = ids[:, : n - k, k].T
    return out


def _scaled(window: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The window with its largest sum as 1, and the logarithm of what it was divided by added to logs."""
    most = np.maximum(window.max(0), 1e-290)
    logs += np.log(most)
    return window / most


def forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log P of each word in each language, over all segmentations. table's last row is 0."""
    ends = ending(ids)
    n, longest, w = ends.shape
    window, logs = np.zeros((longest, w, table.shape[1])), np.zeros((w, table.shape[1]))
    window[0] = 1  # window[k]: the sum up to k characters before this one
    for i in range(n):
        total = np.einsum("kwl,kwl->wl", window[: i + 1], table[ends[i, : i + 1]])
        window[1:] = window[:-1].copy()
        window[0] = total
        if i % 8 == 7:
            window = _scaled(window, logs)
    return np.log(np.maximum(window[0], 1e-290)) + logs


def sums(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For p [end, k, word], the piece probabilities of one language a word: the sums up to each place [place, word], and
    the logarithms of their scales."""
    n, longest, w = p.shape
    alpha, logs, now = np.zeros((n + 1, w)), np.zeros((n + 1, w)), np.zeros(w)
    alpha[0] = 1
    for i in range(n):
        first = max(0, i + 1 - longest)
        alpha[i + 1] = np.einsum("kw,kw->w", alpha[first : i + 1][::-1], p[i, : i + 1 - first])
        logs[i + 1] = now
        if i % 8 == 7:
            old = now.copy()
            alpha[first : i + 2] = _scaled(alpha[first : i + 2], now)
            logs[first : i + 2] += now - old
    return alpha, logs


def likelihoods(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log P(word | language) by the forward algorithm, for distinct words."""
    out = np.zeros((len(words), table.shape[1]))
    for some in by_length(words) if words else ():
        out[some] = forward(pieces.find([words[i] for i in some]), table)
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    held = 0

    def out() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    for batch in by_bytes(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for token, n in Counter((text or "").lower().split()).items():
                if word := word_of(token):
                    counts[lang, word] += n
                    held += len(word)
        if len(counts) > KNOWN_WORDS or held > KNOWN_CHARS:
            yield out()
            counts.clear()
            held = 0
    if counts:
        yield out()


def _expected(langs: list[str], vocab: dict[str, int], table: np.ndarray):
    """Expected uses of each piece in each language, by forward-backward over counted words."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = Pieces(vocab), len(vocab) + 1
        total = np.zeros(size * len(langs))
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
            words, count = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for some in by_length(words):
                ends, own = ending(pieces.find([words[i] for i in some])), lang[some]
                n, longest, _ = ends.shape
                p = table[ends, own]
                alpha, before = sums(p)
                # the same recursion from the other end: a piece that ends at i starts at i - k
                back = np.zeros_like(p)
                for k in range(longest):
                    back[k:, k] = p[::-1, k][: n - k]
                beta, after = sums(back)
                whole = np.log(np.maximum(alpha[n], 1e-290)) + before[n]
                for k in range(min(longest, n)):
                    i = np.arange(k, n)
                    use = alpha[i - k] * p[k:, k] * beta[n - 1 - i] * np.exp(before[i - k] + after[n - 1 - i] - whole) * count[some]
                    there = ends[k:, k] >= 0
                    total += np.bincount((ends[k:, k].astype(np.int64) * len(langs) + own)[there], use[there], len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // len(langs), pa.int64()), pa.array(at % len(langs), pa.int64()), pa.array(total[at], pa.float64())], ["piece", "lang", "uses"])

    return run


def _table(uses: np.ndarray) -> np.ndarray:
    """Smoothed probabilities, and a last row of zeros for pieces that a place doesn't have (index -1)."""
    smooth = uses + 0.05
    out = np.vstack([smooth / smooth.sum(0), np.zeros(uses.shape[1])])
    out[0] = np.minimum(out[0], 1e-5)
    return out


def fit(labelled: DataFrame, vocab_path: str, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and the piece table, from (doc_id, text, lang) rows with a non-null lang."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    vocab = vocabulary(vocab_path)
    if not langs:
        return [], np.zeros((len(vocab) + 2, 0))
    scale = 1 << 30
    bar: Column = F.lit(0)
    for lang in langs:
        bar = F.when(F.col("lang") == lang, F.lit(min(scale, scale * docs_per_lang // sizes[lang]))).otherwise(bar)
    sample = labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(scale)) < bar).select("text", "lang")
    words = sample.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.persist()
    uses = np.ones((len(vocab) + 1, len(langs)))
    for _ in range(rounds):
        found = words.mapInArrow(_expected(langs, vocab, _table(uses)), "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros_like(uses)
        uses[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["uses"].to_numpy()
    words.unpersist()
    return langs, _table(uses)


class _Known(dict):
    """Numbers tokens as they come; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        self.new.append(token)
        self.chars += len(token)
        return at


def _token_logs(tokens: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log P(token | language); a token without a word says nothing."""
    words = [word_of(t) for t in tokens]
    flat = list(dict.fromkeys(filter(None, words)))
    row = dict(zip(flat, range(len(flat)), strict=True))
    of = np.vstack([likelihoods(flat, pieces, table), np.zeros(table.shape[1])])
    return of[[row[w] if w else len(flat) for w in words]]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab_path: str) -> DataFrame:
    """doc_id, lang_pred and score, the posterior of that language under equal priors."""
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float64))
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = Pieces(vocab.value), shared.value
        known, logs = _Known(), np.zeros((0, len(langs)))
        for batch in by_bytes(batches, 4 << 20):
            texts = batch.column("text").to_pylist()
            tokens = [(t or "").lower().split() for t in texts]
            if len(known) > KNOWN_WORDS or known.chars > KNOWN_CHARS:
                known, logs = _Known(), logs[:0]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            at = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
            if known.new:
                logs = np.vstack([logs, _token_logs(known.new, pieces, table)])
                known.new = []
            ends = np.cumsum(sizes)
            best, scores = [], []
            for text, a, z in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
                if not langs or not text or not _LETTER.search(text):
                    best.append("und")
                    scores.append(0.0)
                    continue
                total = logs[at[a:z]].sum(0)
                total = np.exp(total - total.max())
                k = int(total.argmax())
                best.append(langs[k])
                scores.append(float(total[k] / total.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
