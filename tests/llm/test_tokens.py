"""Token grammar and packing: exact round trips, and the mixture's arithmetic."""

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import by_id
from tidebar.llm import grammar, packing, queries, tokens

SF = "/root/testdata/sf0.01"
BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(params=("odd", "given"))
def folder(request, odd_docs):
    if request.param == "given" and not os.path.isdir(SF):
        pytest.skip("no test data")
    return odd_docs if request.param == "odd" else SF


def rows_in_order(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


LIBRARY = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def plain_ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def library_ids(path, text):
    return [*plain_ids(path, text), 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z\n\t\r\x0b\x1c\x85\xa0é́'s<|>19.,ſΣ日😀", max_size=30))
def test_pieces_give_the_whole_texts_ids(text):
    for path in (BYTE, WORD):
        e = tokens.encoder(path)
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == plain_ids(path, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "a", "b.", "É", "ſ"]), max_size=9))
def test_special_strings_are_the_librarys(parts):
    text = "".join(parts)
    for path in (BYTE, WORD):
        e = tokens.encoder(path)
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == plain_ids(path, text)


def test_special_strings_in_the_files(spark):
    docs = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "<|startoftext|>a b")], "doc_id long, text string")
    for path in (BYTE, WORD):
        got = {r.doc_id: r for r in grammar.encode_and_read(docs, path, 2).collect()}
        for doc_id, text in docs.collect():
            ids = library_ids(path, text)
            assert (got[doc_id].n_tokens, got[doc_id].ids_crc32) == (len(ids), crc(ids))


def test_grammar_file(spark, folder):
    want, start = [], 0
    docs = rows_in_order(spark, folder)
    for doc_id, text in docs:
        ids = library_ids(BYTE, text)
        want.append((doc_id, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(queries.QUERIES["op1_token_grammar"](spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert sum(r.n_tokens for r in got) == start
    ids = [r.doc_id for r in got]
    assert ids == [d for d, _ in docs]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, want))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4000), st.integers(1, 40), st.integers(0, 10**6))
def test_shard_round_trip_and_spans(n, alphabet, seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.4, n).clip(1, alphabet).astype(np.uint32) * 1000
    blob, symbols = grammar.pack_shard([1], [n], ids, least=2, most=50)
    shard = grammar.Shard(blob)
    assert symbols <= n and shard.ids().tolist() == ids.tolist()
    for _ in range(5):
        a = int(rng.integers(0, n + 1))
        k = int(rng.integers(0, n + 5))
        assert shard.span(a, k).tolist() == ids[a : a + k].tolist()


def test_rules_are_pairs_and_lengths_add_up():
    ids = np.array([5, 6, 7] * 5000 + [1, 1, 1, 1, 1], np.uint32)
    alphabet, rules, seq = grammar.compress(ids)
    lengths = grammar.lengths_of(len(alphabet), rules)
    assert lengths[seq].sum() == len(ids) and len(seq) < len(ids) / 50
    for k, (a, b) in enumerate(rules):
        assert a < len(alphabet) + k and b < len(alphabet) + k and lengths[len(alphabet) + k] == lengths[a] + lengths[b]


def test_small_shards_keep_the_order(spark, odd_docs, tmp_path):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet").repartition(4)
    shards = grammar.shards_of(docs, BYTE, 2, shard_ids=500)
    shards.write.parquet(str(tmp_path / "shards"))
    got = sorted(grammar.read_documents(spark, str(tmp_path / "shards")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in rows_in_order(spark, odd_docs)]
    assert spark.read.parquet(str(tmp_path / "shards")).where("n_docs > 1 and n_ids > 60000").count() == 0


def check_pieces(got, docs, window=4096):
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    counted = {}
    for d, _ in docs:
        counted[d] = counted.get(d, 0) + 1
    for doc_id, text in dict(docs).items():
        rows = sorted(pieces.pop(doc_id), key=lambda r: r.start)
        ids = library_ids(WORD, text)
        if counted[doc_id] > 1:
            assert sum(r.length for r in rows) % 1 == 0
            continue
        at = 0
        for r in rows:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert not pieces


def test_packing(spark, folder):
    docs = rows_in_order(spark, folder)
    got = queries.QUERIES["op2_mixture_packing"](spark, folder).collect()
    check_pieces(got, docs)
    assert sum(r.length for r in got) == sum(len(library_ids(WORD, t)) for _, t in docs)
    share = lambda rows: {s: sum(r.length for r in rows if r.source == s) / sum(r.length for r in rows) for s in {r.source for r in got}}
    overall, by_sequence = share(got), {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        if sum(r.length for r in rows) == 4096:
            assert all(abs(x - overall[s]) < 0.01 for s, x in share(rows).items())


def test_packing_small_lanes_and_targets(spark, odd_docs):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for targets in (None, {"s1": 3.0, "s2": 1.0}):
        got = packing.pack(docs, WORD, 2, targets=targets, window=64, lane_windows=4, queues=8).collect()
        check_pieces(got, rows, 64)
    first = [r for r in got if r.sequence_id < 20]
    assert {r.source for r in first} == {"s1", "s2"}
    assert abs(sum(r.length for r in first if r.source == "s1") - 3 * sum(r.length for r in first if r.source == "s2")) < 64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9), st.booleans())
def test_mixture_covers_every_id_once(totals, weighted):
    weights = [float(i % 3) for i in range(len(totals))] if weighted else None
    m = packing.Mixture(totals, weights, window=16, lane_windows=32)
    rng = random.Random(1)
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            k = min(n - at, rng.randint(1, 700))
            parts = list(m.cuts(q, at, k))
            assert sum(p[2] for p in parts) == k and [p[1] for p in parts] == [sum(x[2] for x in parts[:i]) for i in range(len(parts))]
            at += k
    for p in m.phases:
        for lane in range(p.lanes):
            sizes = [b - a for a, b in zip(p.granted(lane), p.granted(lane + 1))]
            assert min(sizes) >= 0
            left = list(sizes)
            for size, take in packing.round_robin(sizes, 16):
                assert sum(take) == size and min(take) >= 0
                left = [a - b for a, b in zip(left, take)]
                assert min(left) >= 0
            assert not any(left)


def test_empty_tables(spark, odd_docs):
    for name in ("op1_token_grammar", "op2_mixture_packing"):
        assert queries.QUERIES[name](spark, f"{odd_docs}/empty").collect() == []


def test_repeated_rows_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 3, "doc_id long, text string, source string")
    got = grammar.encode_and_read(docs, BYTE, 2).collect()
    assert len(got) == 3 and len({r.start for r in got}) == 3 and len(by_id([r for r in got if r.start == 0])) == 1
