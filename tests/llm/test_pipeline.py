import hashlib
import re

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import toxicity
from quern.llm.labels import fold

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_run_against_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.7").collect()}
    keep = {}
    for i in sorted(set(text) - toxic):
        keep[text[i].translate(LOWER)] = i  # the largest id stays
    left = sorted(keep.values())
    sets = {i: shingles(re.findall(r"[^\x20\x09-\x0D]+", text[i].translate(LOWER))) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(left):
        for b in left[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = [i for i in left if find(i) == i]
    plain = lambda t: shingles([w for w in re.split(r"[\W_]+", t.lower()) if w])
    want = [(s, len(s)) for s in map(plain, items)]
    left = [i for i in left if not any(n and len(s & plain(text[i])) >= 0.8 * n - 1e-9 for s, n in want)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i in left:
        ids = tok.encode(text[i], add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, sf_dir).collect()}
    assert got == out and len(out) < len(text)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_with_repeated_ids_other_columns_and_no_rows(spark, sf_dir):
    """In every dropping stage a row goes for its own text; helper columns of the same name do no harm."""
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").head().text
    rows = [(5, "a lone text of more than five words here", "k"), (5, leak, "k"), (None, "another text without an id at all", "k"), (7, "twice the very same row of words", "k"), (7, "twice the very same row of words", "k"), (8, None, "k"), (9, "", "k")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, k_id string, lang string, source string, k_text int").repartition(3)
    stages = dict(C.STAGES)
    kept = {n: sorted(((r.doc_id, r.text) for r in stages[n](spark, docs, sf_dir).collect()), key=str) for n in stages if n != "BPE encoding and decoding"}
    all_rows = sorted(((i, t) for i, t, _ in rows), key=str)
    assert kept["toxicity"] == all_rows
    assert kept["exact dedup"] == sorted(set(all_rows) - {(8, None)}, key=str)  # null counts as empty, 9 is larger
    assert kept["n-gram Jaccard join"] == sorted(set(all_rows), key=str)
    assert kept["benchmark decontamination"] == sorted((r for r in all_rows if r[1] != leak), key=str)
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
