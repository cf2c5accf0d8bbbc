import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm import lexicon_bpe as L

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello world's end", "a\x1cb \x1f", "x<|endoftext|>y <|startoftext|>", "ΣΑΣ ΟΔΟΣ", "é É ́x", "日本語 text 12345 ½Ⅷ²",
    "it's we'll I'D", "İstanbul", "a b c​d\u0085e", "😀😀 ok!!!", "!!!???...", "word " * 3000, "A" * 5000, "ﬁ ǅ ß ẞ", "á̧", "\x00\x01\x7f",
]


def want(texts):
    t = Tokenizer.from_file(PATH)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    return out


def test_exact(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abé ñÇ'’sΣ1٣\n\t<|>_-😀Ａ") for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for size in (5, 1000):
        got = {r.doc_id: (bytes(r.ids), r.decoded) for r in L.encode_decode(df, PATH, lexicon_size=size).collect()}
        for i, w in enumerate(want(texts)):
            assert got[i] == w, (size, texts[i])
    d = {r.doc_id: r for r in L.digests(L.encode_decode(df, PATH)).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert L.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) + rng.choice([b"", b"ing", b"tion"]) for _ in range(2000)})
    flat = L.compile_lexicon((w, [i, i + 1]) for i, w in enumerate(words))
    (tmp_path / "x").write_bytes(flat)
    lex = L.Lexicon(str(tmp_path / "x"))
    assert lex.numbers(words).tolist() == list(range(len(words)))
    assert lex.outputs(np.array([7, 0])) == [np.array([7, 8], '<u4').tobytes(), np.array([0, 1], '<u4').tobytes()]
    absent = [w + b"z" for w in words[:50]] + [b"", b"zz", b"a" * 40]
    assert set(lex.numbers(absent).tolist()) == {-1}
    assert len(lex.final) < sum(map(len, words)) / 4  # suffixes are shared


def test_merging_together_equals_merging_alone():
    rng = random.Random(2)
    bpe = L.WordBpe(PATH)
    words = ["".join(rng.choice("abcdeinorstéß'日") for _ in range(rng.randint(1, 70))).encode() for _ in range(3000)] + [b"a", b"", b"aaaaaaa"]
    tok = Tokenizer.from_file(PATH).model
    for w, got in zip(words, bpe.merge_many(words), strict=True):
        want_ids = [t.id for t in tok.tokenize("".join(bpe.alphabet[b] for b in w))] if w else []
        assert np.frombuffer(got, "<u4").tolist() == want_ids
        assert not w or bpe.merge(w) == want_ids


def test_long_unspaced_text():
    import time

    text = "漢字假名交" * 20_000
    began = time.perf_counter()
    got = L.WordBpe(PATH).merge(text.encode())
    assert time.perf_counter() - began < 20
    assert got == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_lexicon_uses_its_room(spark):
    df = spark.createDataFrame([(i, "common w" + "".join("abcdefghij"[int(c)] for c in str(i))) for i in range(3000)], "doc_id long, text string")
    from pyspark import SparkFiles

    name = L.build_lexicon(df, PATH, size=2000)
    assert 1900 < len(L.Lexicon(SparkFiles.get(name)).offsets) - 1 <= 2000
