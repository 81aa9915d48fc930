"""Contract queries against their SQL, and against brute force where SQL can't say it."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import oracles, registry
from tests.oracle import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert_same(spark, FOLDER, QUERIES[name], oracles.ORACLES[name], con)


def documents(con):
    return con.sql("select doc_id, text, lang from documents").fetchall()


def shown(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_secrets_against_plain_regular_expressions(spark, con):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: r for r in QUERIES["op2_secret_scan"](spark, FOLDER).collect()}
    for doc_id, text, _ in documents(con):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
        base = shown(spans, ("assign", "access", "hex"))
        assert got[doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[doc_id].spans.split(","))
        assert (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def test_personal_data_against_plain_regular_expressions(spark, con):
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, FOLDER).collect()}
    for doc_id, text, _ in documents(con):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        base = shown(spans, ("email", "ip", "card", "phone"))
        assert got[doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[doc_id].spans.split(","))


def test_language_on_held_out_documents(spark, con):
    got = QUERIES["op4_language_id"](spark, FOLDER).collect()
    lang = {d: x for d, _, x in documents(con)}
    assert {r.doc_id for r in got if r.held_out} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nearest_neighbours_against_brute_force(spark, con):
    rows = con.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    cosine = x @ x.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))
    found = defaultdict(list)
    for r in QUERIES["op5_nearest"](spark, FOLDER).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = []
    for q in ids[ids % 50 == 0]:
        at = int(np.searchsorted(ids, q))
        order = [i for i in np.lexsort((ids, -cosine[at].round(12))) if i != at][:5]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1))
        assert all(abs(cosine[at][np.searchsorted(ids, v)] - s) < 1e-12 for _, v, s in got)
        hits += [int(ids[i]) in {v for _, v, _ in got} for i in order]
    assert np.mean(hits) >= 0.9


def test_packing_is_an_exact_round_trip(spark, con):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in QUERIES["op8_packing"](spark, FOLDER).collect():
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for doc_id, text, _ in documents(con):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(of_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in of_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_pipeline_against_its_parts(spark, con):
    """The packed stream holds each surviving document's tokens as often as the mix takes it."""
    import corpus_pipeline
    from helixframe.llm.common import table

    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        docs = stage(spark, docs, FOLDER).persist()
    stream = docs.toPandas()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stream.itertuples():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert pieces.groupby("doc_id").length.sum().to_dict() == dict(want)
    assert (pieces.ids.map(len) == 4 * pieces.length).all()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
