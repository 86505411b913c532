"""Word encoder, packing, token files, BPE by ranks."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from langatlas.llm import bpe, eliasfano, packing, tokenbin
from langatlas.llm.wordids import WordEncoder, file_encoder, rank_encoder, read_ranks
from langatlas.session import scratch_path
from tests.llm.helpers import documents, edge_rows, frame

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    r = random.Random(1)
    signs = "ab a\n\t.,'s é漢🙂\x1c\x85  0-=_!<|endoftext|> "
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(800)] + [
        "a" * n for n in range(30)] + ["ab" * n for n in range(20)] + [" " * n + "x" for n in range(40)] + [
        "".join(r.choice("ab") for _ in range(25)) for _ in range(400)] + [
        "".join(r.choice(["an", "ana", "n", "is", "si", "s"]) for _ in range(9)) for _ in range(400)] + [
        "", "-" * 90, "banana" * 5, "é" * 50, "漢" * 30]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS),
                            special_tokens={})
    return lambda text: enc.encode_ordinary(text or "")


def test_word_encoder_gives_the_library_ids(plain):
    texts = odd_texts() + [t for _, t in documents()]
    ids, bounds = file_encoder(JSON).encode(texts, end=0)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == plain(text) + [0]


def test_a_full_store_starts_anew(plain):
    t = Tokenizer.from_file(JSON)
    small = WordEncoder(t, max_words=3)
    for _ in range(3):
        for text in ("one two, three four five", "", "one two"):
            assert small.encode([text])[0].tolist() == plain(text)


def test_lines_are_put_together_from_known_words(plain, monkeypatch):
    encoder = WordEncoder(Tokenizer.from_file(JSON))
    encoder.encode(["Then one, two.", "one"])
    asked = []
    whole = encoder.encode_cut
    monkeypatch.setattr(encoder, "encode_cut", lambda *a: asked.append(a) or whole(*a))
    texts = ["a one.\nThen two\none", "one\n" * 3000 + "two", " one  two \n one \x1c two ", "one \u2003two"]
    ids, bounds = encoder.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == plain(text)
    assert not [word for _, word in asked if "\n" in word.strip()]


def test_rank_encoder_gives_tiktoken_ids(tik):
    texts = odd_texts() + [t for _, t in documents()]
    ids, bounds = rank_encoder(RANKS, P.PATTERN).encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == tik(text)


def test_bpe_round_trip_and_offsets(spark, tik):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(odd_texts()[:200])]
    coded = bpe.encode(frame(spark, rows), RANKS, P.PATTERN, offsets=True)
    got = bpe.decode(coded, RANKS).withColumn("back", bpe.decoded_text()).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=key) == sorted(
        ((i, t or "") for i, t in rows), key=key)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == tik(r["back"]) and r["n_tokens"] == len(ids) == len(r["offsets"])
        assert r["offsets"] == sorted(r["offsets"]) and (not ids or r["offsets"][0] == 0)


def test_offsets_of_split_characters():
    tokens = [b"a", b"\xf0\x9f", b"\x99\x82", b"b"]
    assert bpe.char_offsets(np.array([0, 1, 2, 3]), tokens, "a🙂b").tolist() == [0, 1, 1, 2]


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)              # room 3 fits better than room 4
    assert bins.place(9) == (2, 0) and bins.place(8) == (3, 0)   # closes room 1, sequence 2
    assert bins.place(1) == (3, 8) and bins.place(4) == (0, 6)
    assert bins.place(10) == (4, 0)


def test_cut_sizes():
    assert packing.cut_sizes(0, 4) == [0] and packing.cut_sizes(4, 4) == [4]
    assert packing.cut_sizes(9, 4) == [1, 4, 4] and packing.cut_sizes(8, 4) == [4, 4]


@pytest.mark.parametrize("params", [{}, {"capacity": 16, "max_open": 3, "window_tokens": 200}])
def test_packing_holds_every_token_once(spark, plain, params):
    rows = edge_rows()
    capacity = params.get("capacity", packing.SEQUENCE_TOKENS)
    got = packing.pack_documents(frame(spark, rows), JSON, **params).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in rows:
        if i is None or i == 20:
            continue
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids"]) for r in got
                        if r["doc_id"] == i)
        ids = plain(text) + [0]
        assert [p[2] for p in pieces] == packing.cut_sizes(len(ids), capacity)
        assert np.frombuffer(b"".join(p[3] for p in pieces), "<u4").tolist() == ids
        assert [p[1] for p in pieces] == np.cumsum([0] + [p[2] for p in pieces[:-1]]).tolist()
    assert packing.pack_documents(frame(spark, []), JSON).collect() == []


def test_packing_is_close_to_the_least(spark):
    rows = documents()
    got = packing.pack_documents(frame(spark, rows).coalesce(1), JSON)
    tokens, used = got.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used <= -(-tokens // 2048) * 1.02 + 1


def test_elias_fano_round_trip():
    r = np.random.default_rng(3)
    for values in ([0], [5], [0, 0, 0], [1 << 40], list(range(300)), [7] * 200,
                   sorted(r.integers(0, 1 << 33, 1000).tolist()),
                   sorted(r.integers(0, 900, 1000).tolist())):
        data = eliasfano.encode(np.array(values))
        held = eliasfano.EliasFano(data)
        assert held.all().tolist() == values
        assert [held.select(i) for i in range(len(values))] == values
        with pytest.raises(IndexError):
            held.select(len(values))
    dense = eliasfano.encode(np.cumsum(r.integers(300, 900, 10_000)))
    assert len(dense) < 10_000 * 2              # 16 bits a value, not 64


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_token_files_round_trip(spark, plain, block):
    rows = edge_rows() + [(-5, "below zero"), (1 << 60, "far away")]
    path = scratch_path(spark, "tokens")
    tokenbin.write_token_files(frame(spark, rows), path, JSON, block_ids=block)
    got = sorted(tokenbin.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in sorted(rows, key=lambda x: (
        x[0] is not None, x[0] or 0))]
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(plain(t) + [0])
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        texts[r["doc_id"]].remove(ids)
        assert r["start"] == at and r["n_tokens"] == len(ids)
        at += len(ids)
    for row in spark.read.parquet(path).collect():
        ends = np.concatenate(([0], eliasfano.EliasFano(row["bounds"]).all()))
        for i in range(len(ends) - 1):
            assert len(tokenbin.read_document(row, i)) == ends[i + 1] - ends[i]


def test_token_files_of_an_empty_table(spark):
    path = scratch_path(spark, "tokens")
    tokenbin.write_token_files(frame(spark, []), path, JSON)
    assert tokenbin.read_token_files(spark, path).collect() == []


def test_query_digests(spark, plain):
    from langatlas.llm.queries import op7_token_binary
    from tests.llm.helpers import SF
    want, at = {}, 0
    for i, t in sorted(documents()):
        data = np.array(plain(t) + [0], "<u4").tobytes()
        want[i] = (at, len(data) // 4, zlib.crc32(data))
        at += len(data) // 4
    assert {r[0]: tuple(r)[1:] for r in op7_token_binary(spark, SF).collect()} == want


def test_signs_after_letters_come_from_known_words(plain, monkeypatch):
    encoder = WordEncoder(Tokenizer.from_file(JSON))
    words = ["wordy", "wordy%%%", "wordy.\"", "wordy...", "wordy)", "wordy's", "wordy'", "wordy*.", "4%%%"]
    text = " ".join(words)
    asked = []
    whole = encoder.encode_cut
    monkeypatch.setattr(encoder, "encode_cut", lambda *a: asked.append(a[1]) or whole(*a))
    ids, _ = encoder.encode([text])
    assert ids.tolist() == plain(text)
    assert not {"wordy%%%", "wordy.\"", "wordy...", "wordy)", "wordy*."} & set(asked)
