from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import packing, token_files
from ledgerlake.llm.bpe import Encoder
from ledgerlake.llm.registry import TOKENIZER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER())


def ids_of(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_encoder_equals_the_library(library):
    rnd = random.Random(5)
    signs = [*"ab1é'.,!&- \n\n  ", "’", "€", "'s", "word", "<|endoftext|>", "\t", "“", "日"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 16))) for _ in range(8000)] + ["it's.b", "a,,b", "3.5%", None, "x" * 20_000]
    got = Encoder(TOKENIZER()).encode(texts)
    assert got == [ids_of(library, t, 0)[:-1].tobytes() for t in texts]


def test_encoders_with_a_lead_and_of_pieces_equal_the_libraries(library):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from ledgerlake.llm.bpe import PieceEncoder

    rnd = random.Random(6)
    signs = [*"ab1é'.,!&- \n\n  ", "’", "€", "'s", "word", "tion", "<|endoftext|>", "</s>", "\t", "▁", "日", "😀", "\x00"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 16))) for _ in range(8000)] + ["the house of the", "x" * 20_000]
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = SentencePieceProcessor(model_file=path)
    assert PieceEncoder(path).encode([*texts, "", None]) == [*(np.array(pieces.encode(t), dtype="<u4").tobytes() for t in texts), b"", b""]
    plain = Tokenizer.from_file(TOKENIZER())
    plain.encode_special_tokens = True
    assert Encoder(TOKENIZER(), special=False, lead=" ").encode(texts) == [np.array(plain.encode(" " + t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_token_files_of_a_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, at = {}, 0
    for doc, text in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = ids_of(library, text, 0)
        want[doc] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(docs, TOKENIZER()).collect()} == want


def test_token_files_of_odd_rows(odd_docs, no_docs):
    found = sorted(token_files.round_trip(odd_docs, TOKENIZER()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    assert token_files.round_trip(no_docs, TOKENIZER()).count() == 0


def test_one_id_on_most_rows_fills_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_SHARD_IDS", 500)
    monkeypatch.setattr(token_files, "SLICE_IDS", 64)
    docs = spark.range(400).selectExpr("CASE WHEN id % 4 > 0 THEN CASE WHEN id % 8 > 4 THEN 9 END ELSE id END AS doc_id", "concat('word number ', id, repeat(' and more', id % 5)) AS text").repartition(5)
    path = token_files.new_path(spark, "test")
    token_files.write(docs, TOKENIZER(), path)
    files = [r["n"] for r in token_files._contents(spark, f"{path}/files").selectExpr("length(content) as n").collect()]
    assert len(files) >= 6 and max(files) < 3 * sum(files) / len(files)
    found = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert [a["start"] + a["n_tokens"] for a in found[:-1]] == [b["start"] for b in found[1:]]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert len(ids) == 400 and ids == sorted(ids)


def test_control_bytes_round_trip():
    rnd = np.random.default_rng(1)
    counts = np.array([0, 1, 5, 4, 1000, 3])
    ranks = (rnd.integers(0, 1 << 32, counts.sum()) >> rnd.integers(0, 32, counts.sum())).astype("<u4")
    control, data = token_files.pack(ranks, counts)
    joined = lambda x: np.frombuffer(b"".join(x), dtype=np.uint8)
    assert (token_files.unpack(joined(control), joined(data), counts) == ranks).all()


@pytest.mark.parametrize("which", ["table", "odd"])
def test_packing(spark, sf_dir, odd_docs, library, which):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "table" else odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    parts, places = defaultdict(list), defaultdict(list)
    for r in packing.pieces(docs, TOKENIZER()).collect():
        parts[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert parts.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = ids_of(library, text, 1), 0
        for r in sorted(parts[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for n, held in places.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 2048 or n == max(places)


def test_packing_of_repeated_and_no_rows(odd_docs, no_docs):
    pieces = packing.pieces(odd_docs, TOKENIZER())
    rows = pieces.collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    filled = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * 2048 or r["n_tokens"].bit_count() == 1 for r in filled)
    assert packing.pieces(no_docs, TOKENIZER()).count() == 0
