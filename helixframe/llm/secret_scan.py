"""Secret scans: three fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (`name = "literal"`, `name: literal`, `"name" => 'literal'`,
`name: type = "literal"`, with escapes and every kind of quote) into name-literal pairs, carries constants from name to
name, also through `$name` and `${name}`, and scores each literal by how sensitive its target names are
and how random it looks. Spans are code points, end exclusive.

Each text is scanned alone, whole, in time linear in its length; nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import by_bytes

KINDS = ("assign", "access", "hex", "named")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: How much a word of a target name says that its value is secret (fixed values).
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "private": 2, "access": 1, "api": 1, "key": 2, "signing": 1, "bearer": 3, "jwt": 2, "session": 1, "salt": 1, "cert": 1}
#: Words of a name that say the value is about a secret, not one (fixed values).
HARMLESS = {"file", "path", "url", "name", "type", "length", "size", "field", "prompt", "count", "hint", "policy", "id", "public"}
_PLACEHOLDER = re.compile(r"(?is)(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|changeme|example.*|your.*|dummy.*|test|none|null|true|false|todo)\Z")

_SEPARATOR = re.compile(r"=>|:=|[=:]")
_NAME = re.compile(r"""([A-Za-z_$][A-Za-z0-9_$.-]{0,127})["']?\]?[ \t]{0,16}$""")
_LITERAL = re.compile(
    r"""[ \t]{0,64}(?:"{3}(?P<long>(?:[^"\\]++|\\.|"(?!""))*+)"{3}|'{3}(?P<long1>(?:[^'\\]++|\\.|'(?!''))*+)'{3}"""
    r"""|"(?P<double>(?:[^"\\\n]++|\\.)*+)"|'(?P<single>(?:[^'\\\n]++|\\.)*+)'|`(?P<back>(?:[^`\\]++|\\.)*+)`"""
    r"""|(?P<bare>\$\{[A-Za-z_][A-Za-z0-9_.]*\}|[A-Za-z0-9+/_.$~=-]++))""",
    re.S,
)
#: A whole literal that stands for a name's value.
_REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_.]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
#: A type between a name's colon and its equals sign, without what its brackets hold.
_TYPE = re.compile(r"(?:(?:const|constant|dyn|mut|readonly|unsigned|'\w+)[ \t]+|[*&])*(?:\w|\.|::)++[ \t]*[?!*&]*(?:[ \t]*\|[ \t]*(?:\w|\.|::)++[ \t]*[?!*&]*)*+")
_IN_TYPE = re.compile(r"""[\w .,|?!*&:'"\[\]<>()\t-]++""")
#: Types that are no names of constants.
BUILT_IN = {"Any", "None", "Optional", "Str", "String", "bytes", "char", "null", "object", "str", "string", "undefined"}
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16}")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
THRESHOLD = 5.0
#: Names have at most 128 characters (_NAME); a longer literal, with its $, {, }, is none.
LONGEST_NAME = 160


def is_type(text: str, start: int, end: int) -> bool:
    """Whether a stretch of text reads as a type: words joined by |, with any brackets after them."""
    if not _IN_TYPE.fullmatch(text, start, end):
        return False
    kind = text[start:end].strip()
    if kind[-1:] in ("'", '"'):
        kind = kind.strip("'\"")
    outer, depth = [], 0
    for c in kind:
        depth += c in "[<("
        if not depth:
            outer.append(c)
        depth -= c in "])>"
        if depth < 0:
            return False
    return not depth and bool(_TYPE.fullmatch("".join(outer)))


def pairs(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, start, end, whether an identifier may be meant) of the literal in each assignment that the text's syntax
    shows. An unquoted literal runs to the last character that it may hold, however long; the separators inside one
    share its end, so that each character is read once. In `name: type = literal` the literal is the name's (and the
    last word's, which may be a name too)."""
    end = run = 0
    typed: tuple[str, int] | None = None
    for m in _SEPARATOR.finditer(text):
        at, to = m.span()
        if at < end or text[at - 1 : at] in ("=", "!", "<", ">", ":") or text[to : to + 1] in ("=", ":"):
            continue
        name = _NAME.search(text, max(end, at - 148), at)
        names = [name[1]] if name else []
        if m[0] == ":":
            typed = (name[1], to) if name else typed
        else:
            if typed and m[0] != "=>" and is_type(text, typed[1], at):
                names = [typed[0], *(n for n in names if n not in BUILT_IN)]
            typed = None
        if to < run:
            start, stop, bare = to, run, True
        elif value := _LITERAL.match(text, to):
            bare = value.lastgroup == "bare"
            start, stop = value.span(value.lastgroup)
            run = stop if bare else run
        else:
            continue
        for n in names:
            yield n, start, stop, bare
        end = to if names else end


def name_score(name: str) -> int:
    words = [w.lower() for w in _CAMEL.findall(name)]
    return sum(SENSITIVE.get(w, 0) for w in words) - 2 * sum(w in HARMLESS for w in words) if words else 0


class Scores:
    """Scores of a text's literals, up to 4: length and randomness, or a private key in PEM; placeholders and prose
    score nothing. A literal is scored once, and one that ends another is counted from the other's counts, so time is
    linear in the text."""

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.start = self.end = 0
        self.counts: Counter[str] = Counter()

    def __call__(self, start: int, end: int) -> float:
        if (start, end) not in self.known:
            self.known[start, end] = self._score(start, end)
        return self.known[start, end]

    def _score(self, start: int, end: int) -> float:
        size = end - start
        if size < 8 or _PLACEHOLDER.match(self.text, start, end):
            return 0.0
        if end == self.end and self.start <= start:
            self.counts -= Counter(self.text[self.start : start])
        else:
            self.counts = Counter(self.text[start:end])
        self.start, self.end = start, end
        if self.counts[" "]:
            head = _PEM.search(self.text, start, end)
            return 4.0 if head and _PEM_BODY.search(self.text, head.end(), end) else 0.0
        bits = -sum(n / size * math.log2(n / size) for n in self.counts.values())
        classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "" for c in self.counts})
        return min(4.0, max(0.0, bits - 2.0) + 0.5 * (classes - 1) + (size >= 20))


def named_spans(text: str) -> set[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through other names."""
    if "=" not in text and ":" not in text:
        return set()
    known: dict[str, tuple[int, int]] = {}
    found = set()
    score = Scores(text)
    for name, start, end, bare in pairs(text):
        if end - start <= LONGEST_NAME:
            if bare:
                start, end = known.get(text[start:end].strip("${}"), (start, end))
            elif reference := _REFERENCE.fullmatch(text, start, end):
                start, end = known.get(reference[1] or reference[2], (start, end))
        known[name] = known[name.rpartition(".")[2]] = (start, end)
        target = name_score(name)
        if target > 0 and (s := score(start, end)) > 0 and target + s >= THRESHOLD:
            found.add((start, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, sorted by start, then kind."""
    text = text or ""
    base = sorted(base_spans(text))
    return base, sorted([*base, *((s, 3, e) for s, e in named_spans(text))])


def shown(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, at = [], 0
    for s, e in merged(spans):
        parts += [text[at:s], mark]
        at = e
    return "".join([*parts, text[at:]])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        counts = [[sum(k == i for _, k, _ in base) for base, _ in rows] for i in range(len(BASE))]
        digests = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts, [pa.int64()] * 3), pa.array(digests, pa.string()), pa.array([shown(x) for _, x in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """The pipeline's stage: docs with every span replaced by mark (and n_chars, where there is one, counted anew)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = [None if t is None else redacted(t, scan(t)[1], mark) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumns({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}) if "n_chars" in docs.columns else out
