"""Motif scores of introns against position-weight matrices, in one fused Arrow pass. F8-F13, O4, W9.

Matrices are the user's files, a few thousand numbers, so each task holds all of them. Scores are products, as the
tie-breaks need; matrices.product_score and best_window are the same in SQL and check this pass in the tests.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from helixframe.config import Config
from helixframe.functions.dna import ambiguous_pair

SCORES = "intron_id long, five_raw double, bp_raw double, three_raw double, bp_seq string, bp_seq_u2 string, bp_start int, u12_matrix string, u2_matrix string"
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _i


def tables(pwms: DataFrame) -> dict[tuple[str, str], dict[str, list[tuple[str, np.ndarray, int]]]]:
    """(subtype, dnts) -> region -> [(version, freq[pos, base], first pos)] in order of version; gathers the matrices."""
    cells = pwms.toPandas()
    out: dict = defaultdict(lambda: defaultdict(list))
    for (subtype, dnts, region, version), m in sorted(cells.groupby(["subtype", "dnts", "region", cells["version"].fillna("")]), key=lambda x: x[0]):
        first, width = int(m.pos.min()), int(m.pos.max() - m.pos.min() + 1)
        freq = np.full((width, 4), np.nan)
        known = m.base.isin(list("ACGT"))
        freq[m.pos[known] - first, m.base[known].map("ACGT".index)] = m.freq[known]
        out[subtype, dnts][region].append((version, freq, first))
    return {k: dict(v) for k, v in out.items()}


def _codes(seqs: pd.Series) -> np.ndarray:
    """Base codes, 4 for other characters, 5 after the end."""
    raw = [s.encode("ascii", "replace") for s in seqs.fillna("")]
    out = np.full((len(raw), max(map(len, raw), default=0)), 5, np.int8)
    for i, s in enumerate(raw):
        out[i, : len(s)] = _CODE[np.frombuffer(s, np.uint8)]
    return out


def _factors(freq: np.ndarray, missing: float) -> np.ndarray:
    """freq[pos] by code; characters outside the matrix count missing, places after the end nothing."""
    return np.hstack([np.where(np.isnan(freq), missing, freq), np.full((len(freq), 1), missing), np.ones((len(freq), 1))])


def place_scores(codes: np.ndarray, freq: np.ndarray, first: int, start: int, missing: float, skip: np.ndarray | None = None, skipped: tuple[int, ...] = ()) -> np.ndarray:
    """Product over the places of fixed windows; nan for empty ones. Rows in skip leave out the places in skipped."""
    f, out = _factors(freq, missing), np.ones(len(codes))
    for j in range(codes.shape[1]):
        at = start + j - first
        by = f[at][codes[:, j]] if 0 <= at < len(f) else np.where(codes[:, j] == 5, 1.0, missing)
        if skip is not None and start + j in skipped:
            by = np.where(skip, 1.0, by)
        out = out * by
    return np.where((codes == 5).all(1), np.nan, out)


def best_places(codes: np.ndarray, sizes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best product over the windows of each of the texts that lie end to end in codes, and its start in the text, the
    leftmost of equals; nan and -1 without any. Work and memory grow with the characters, however they are dealt."""
    best, at = np.full(len(sizes), np.nan), np.full(len(sizes), -1)
    width, some = len(factors), np.flatnonzero(sizes >= len(factors))
    if not len(some):
        return best, at
    windows = len(codes) - width + 1
    scores = np.ones(windows)
    for j in range(width):
        scores *= factors[j][codes[j : j + windows]]
    first = (np.cumsum(sizes) - sizes)[some]
    inside = np.zeros(windows + 1, np.int8)
    inside[first] += 1
    inside[first + sizes[some] - width + 1] -= 1
    scores[np.cumsum(inside[:-1], dtype=np.int8) == 0] = -np.inf  # these run into the next text
    top, lengths = np.maximum.reduceat(scores, first), np.diff(np.append(first, windows))
    hits = np.flatnonzero(scores[first[0] :] == np.repeat(top, lengths))
    owner = np.repeat(np.arange(len(some)), lengths)[hits]
    best[some], at[some] = top, hits[np.diff(owner, prepend=-1) > 0] + first[0] - first
    return best, at


def window_scores(codes: np.ndarray, freq: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Best product over windows as wide as the matrix, and its start, the leftmost of equals; nan and -1 without any."""
    inside = codes != 5
    return best_places(codes[inside], inside.sum(1), _factors(freq, missing))


def best_windows(df: DataFrame, seq: str, freq: np.ndarray, alphabet: str, missing: float, slice_bytes: int = 4 << 20) -> DataFrame:
    """The other columns with score, start (0-based) and seq of the best window under freq[pos, letter], the leftmost of
    equals; rows without a window (null or short texts) are left out. Letters are ASCII, texts need not be. F9."""
    width, keep = len(freq), [c for c in df.columns if c != seq]
    factors = np.hstack([freq, np.full((width, 1), missing)])
    letters = np.full(256, len(alphabet), np.uint8)
    letters[list(alphabet.encode("ascii"))] = np.arange(len(alphabet))

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(seq).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # of characters, in UTF-8
        before = np.searchsorted(starts, offsets - offsets[0])
        best, at = best_places(letters[data[starts]], np.diff(before), factors)
        rows = np.flatnonzero(at >= 0)
        begin, bounds = before[rows] + at[rows], np.append(starts, len(data))
        low, sizes = bounds[begin], bounds[begin + width] - bounds[begin]
        ends = np.append(0, np.cumsum(sizes))
        cut = data[np.repeat(low - ends[:-1], sizes) + np.arange(ends[-1])]
        windows = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cut))
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in keep], pa.array(best[rows]), pa.array(at[rows]), windows], [*keep, "score", "start", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(seq)))
            done = np.cumsum(pc.binary_length(batch.column(seq)).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:  # long texts one by one
                stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + slice_bytes, side="right")))
                yield found(batch.slice(start, stop - start))
                start = stop

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in keep], StructField("score", DoubleType()), StructField("start", LongType()), StructField("seq", StringType())]))


def score(introns: DataFrame, pwms: DataFrame, config: Config) -> DataFrame:
    """SCORES of introns (intron_id, five_seq, bp_region_seq, three_seq, dnts): log2 ratios of the best minor-type and the
    best major-type matrix set; a set of the intron's own terminal pair comes before better ones of others."""
    known, missing, empty = tables(pwms), config.missing, 4 * config.pseudocount

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if not len(rows):
                continue
            five, bp, three = (_codes(rows[c]) for c in ("five_seq", "bp_region_seq", "three_seq"))
            skip = rows["ends_ignored"].to_numpy(bool)
            own = rows["dnts"].str.replace("-", "").str.lower().to_numpy()
            chosen: dict[str, dict] = {}
            for subtype in ("u12", "u2"):
                sets = []
                for (kind, dnts), regions in sorted(known.items()):
                    if kind != subtype:
                        continue
                    raw, place = {}, np.full(len(rows), -1)
                    versions = {}
                    for region, options in regions.items():
                        best, name = np.full(len(rows), -np.inf), np.array([""] * len(rows), object)
                        for version, freq, first in options:
                            if region == "five":
                                s = place_scores(five, freq, first, config.five_coords[0], missing, skip, (0, 1))
                            elif region == "three":
                                s = place_scores(three, freq, first, config.three_coords[0], missing, skip, (-2, -1))
                            else:
                                s, at = window_scores(bp, freq, missing)
                                place = np.where(np.nan_to_num(s, nan=empty) >= best, at, place)
                            s = np.nan_to_num(s, nan=empty)
                            later = s >= best
                            best, name = np.where(later, s, best), np.where(later, version, name)
                        raw[region], versions[region] = best, name
                    used = [raw[r] for r in config.regions if r in raw]
                    if used:
                        gmean = np.exp(np.mean(np.log(np.maximum(used, 1e-300)), axis=0))
                        sets.append((dnts, gmean, raw, place, len(regions.get("bp", [(0, [])])[0][1])))
                pick = np.zeros(len(rows), int)
                rank = np.full(len(rows), -np.inf)
                for i, (dnts, gmean, *_) in enumerate(sets):
                    value = np.where(own == dnts, gmean + 1e6, gmean)
                    later = value >= rank
                    pick, rank = np.where(later, i, pick), np.where(later, value, rank)
                chosen[subtype] = {"sets": sets, "pick": pick}
            get = lambda t, f: np.select([chosen[t]["pick"] == i for i in range(len(chosen[t]["sets"]))], [f(s) for s in chosen[t]["sets"]], np.nan)
            out = {"intron_id": rows["intron_id"]}
            for r in ("five", "bp", "three"):
                none = np.full(len(rows), empty)
                out[f"{r}_raw"] = np.log2(get("u12", lambda s, r=r: s[2].get(r, none)) / get("u2", lambda s, r=r: s[2].get(r, none)))
            for t, c in (("u12", "bp_seq"), ("u2", "bp_seq_u2")):
                at, width = get(t, lambda s: s[3]).astype(int), get(t, lambda s, n=len(rows): np.full(n, s[4])).astype(int)
                out[c] = [x[a : a + w] if a >= 0 and x else None for x, a, w in zip(rows["bp_region_seq"], at, width, strict=True)]
                if t == "u12":
                    out["bp_start"] = pd.array(np.where(at >= 0, at, 0), "Int32")
            for t in ("u12", "u2"):
                names = np.array([f"{t}_{s[0]}" for s in chosen[t]["sets"]], object)
                out[f"{t}_matrix"] = names[chosen[t]["pick"]]
            yield pd.DataFrame(out)[["intron_id", "five_raw", "bp_raw", "three_raw", "bp_seq", "bp_seq_u2", "bp_start", "u12_matrix", "u2_matrix"]]

    ignored = ambiguous_pair(F.col("dnts")) & ~F.col("dnts").isin("GT-AG", "GC-AG", "AT-AC") if config.ignore_ambiguous_ends else F.lit(False)
    return introns.select("intron_id", "five_seq", "bp_region_seq", "three_seq", "dnts", F.coalesce(ignored, F.lit(False)).alias("ends_ignored")).mapInPandas(run, SCORES)
