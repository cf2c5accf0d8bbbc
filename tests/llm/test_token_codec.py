import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import token_codec as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [5], [0] * 5000, np.arange(131070)[::-1], rng.integers(0, 2**32 - 1, 9000), rng.zipf(1.3, 20000) % 50257):
        ids = np.array(ids, np.int64)
        tables, payloads, crcs = T.encode_blocks(ids)
        assert (T.decode_blocks(tables, payloads, crcs, len(ids)) == ids).all()
        if len(payloads) > 1:  # blocks stand alone
            assert (T.decode_blocks(tables, payloads[1:], crcs[1:], len(ids) - T.BLOCK) == ids[T.BLOCK :]).all()
        lens = [len(ids)] if len(ids) else []
        assert (T.unpack(T.pack([1] * len(lens), lens, ids))[2] == ids).all()


def test_smaller_than_order_0_and_zlib():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    ids = np.frombuffer(b"".join(T.Ids(PATH, 0).encode(texts)), "<u4").astype(np.int64)
    share = np.bincount(ids) / len(ids)
    order_0 = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    size = len(T.pack([1], [len(ids)], ids)) / len(ids)
    assert size < 0.9 * order_0
    assert size < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_damage_is_found():
    ids = np.arange(5000) % 700
    tables, payloads, crcs = T.encode_blocks(ids)
    bad = bytearray(payloads[1])
    bad[10] ^= 255
    with pytest.raises(ValueError):
        T.decode_blocks(tables, [payloads[0], bytes(bad), *payloads[2:]], crcs, len(ids))


def test_pieces_against_the_library():
    rng = np.random.default_rng(5)
    letters = list(" \n\t ab'sé1.!日\u00a0\u3000 <|")
    texts = ["".join(rng.choice(letters, 60)) for _ in range(500)] + ["", " ", "  ", "a<|endoftext|> b", "x  ", "a b " * 20_000, None]
    tok = Tokenizer.from_file(PATH)
    for text, got in zip(texts, T.Ids(PATH, 0).encode(texts), strict=True):
        assert got == np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes(), text


def test_ids_that_are_not_integers_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        T.write_tokens(spark.createDataFrame([("a", "x")], "doc_id string, text string"), PATH, f"file://{tmp_path}/s")


def test_files_against_brute_force(spark, tmp_path):
    texts = [(7, "Hello  world's\n\n end "), (2, None), (5, ""), (3, "x<|endoftext|>y  z"), (5, "é日本 12345!!! " * 400), (11, "  lead"), (1, "trail   \t")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, ids string")
    path = f"file://{tmp_path}/t"
    T.write_tokens(df, PATH, path, record_ids=30)
    got = {(r.doc_id, r.n_tokens, r.start): r.ids_crc32 for r in T.summary(T.read_tokens(spark, path)).collect()}
    tok, at, want = Tokenizer.from_file(PATH), 0, {}
    for d, t in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[(d, len(ids), at)] = zlib.crc32(ids.tobytes())
        at += len(ids)
    assert got == want


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert T.read_tokens(spark, path).count() == 0


def encoded(enc, texts):
    """Numbers of the parts of ``texts``, and the library's ids."""
    import pyarrow as pa

    tok = Tokenizer.from_file(PATH)
    want = [i for t in texts for i in [*tok.encode(t, add_special_tokens=False).ids, 0]]
    return enc.parts(pa.array(texts))[0], want


def test_a_recurring_part_is_one_symbol():
    texts = [f"unbelievableness {i}, antidisestablishment.\nUnforeseeably x" if i % 9 else f"a <|endoftext|> {i}  b" for i in range(400)]
    texts += [" ".join(["incomprehensibilities"] * 5 + [f"q{i}zzx, q{i}zzx."]) for i in range(400)]
    enc = T.Ids(PATH, 0)
    parts, want = encoded(enc, texts)
    phrases, symbols = T.Phrases.of(parts, enc.flat, enc.lens)
    assert len(phrases.flat) + len(symbols) < 0.8 * len(want)
    assert phrases.ids(symbols).tolist() == want
    assert T.unpack(T.pack([1], [len(want)], symbols, phrases))[2].tolist() == want


def test_parts_stay_known_from_task_to_task(monkeypatch):
    monkeypatch.setattr(T.Ids, "MEMO", 100)
    enc, held, want = T.Ids(PATH, 0), [], []
    assert T.ids_of(PATH, 0) is T.ids_of(PATH, 0)
    for k in range(6):  # what a record still holds outlives what is forgotten
        held = enc.tidy(held)
        parts, ids = encoded(enc, [f"common word{k}x{i}, other{i}." for i in range(60)])
        held.append(parts)
        want += ids
        if k == 3:
            held, want = [], []
    parts = np.concatenate(held)
    assert T._runs(enc.flat, (np.cumsum(enc.lens) - enc.lens)[parts], enc.lens[parts]).tolist() == want
    enc.tidy([])
    assert len(enc.lens) <= 200
