"""Clashing names, empty tables and very long rows of the operators that have no such test of their own."""

import random
import zlib

import public_tokenizers

from quern.llm import decontaminate, exact_dedup, host_reputation, ngram_join, token_codec
from quern.llm.queries import URL_RULES

CLASH = "host path suffix domain good n m rule verdict norm head x salt text_sha256 sha raw k_id k_text hot_n a b d d64 token id pos".split()


def clashing(spark, rows, schema):
    """``rows`` with further columns whose names the operators use themselves."""
    own = {f.split()[0] for f in schema.split(", ")}
    more = [c for c in CLASH if c not in own]
    return spark.createDataFrame([(*r, *["z"] * len(more)) for r in rows], ", ".join([schema, *(f"{c} string" for c in more)]))


def test_host_reputation(spark):
    rows = [(1, "http://a.example.net/en/x", ""), (2, "http://b.com/q", ""), (3, None, ""), (4, "nothing", "")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in host_reputation.judge(clashing(spark, rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("b.com", "/q", None), 3: ("", "", None), 4: ("", "", None)}
    assert host_reputation.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    df = clashing(spark, rows, "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df, keep="largest").collect()} == {1: 2, 2: 2, 3: 3}
    kept = exact_dedup.drop_copies(df, keep="largest")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3}


def test_ngram_join_with_very_long_texts(spark):
    long = [f"w{i % 9973}x{i // 9973}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:55_000])), (3, " ".join(long[:30_000])), (4, "word " * 50_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(clashing(spark, rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1, 1), 2: (54_996, 1, 1), 3: (29_996, 3, 0), 4: (1, 4, 0)}


def test_decontamination_with_a_very_long_item(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**6)}" for _ in range(8000)]
    docs = [(1, "before " + " ".join(words) + " after"), (2, " ".join(words[:5000])), (3, " ".join(words[:7000])), (4, None)]
    items = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[100:109])), (9, None), (10, "four words only here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(clashing(spark, docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 7), (3, 7), (1, 8), (2, 8), (3, 8)}


def test_token_files_with_a_very_long_document(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = [(3, " ".join(rng.choice(["alpha", "beta", "gamma", "été", "123"]) + str(rng.randrange(50)) for _ in range(60_000))), (1, None), (2, "x" * 20_000)]
    token_codec.write_tokens(clashing(spark, texts, "doc_id long, text string"), path, f"file://{tmp_path}/t")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_codec.summary(token_codec.read_tokens(spark, f"file://{tmp_path}/t")).collect()}
    at = 0
    for i, t in sorted(texts):
        ids = [*Tokenizer.from_file(str(path)).encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids)))
        at += len(ids)
