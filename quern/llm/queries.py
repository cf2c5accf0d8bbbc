"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ball_search, decontaminate, exact_dedup, host_reputation, lexicon_bpe, ngram_join, page_diff, pu_quality, repeats, secrets, token_codec, toxicity, variants
from .common import read

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(read(spark, sf_dir, "pages"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; the method learns from the pages that the rules decide."""
    return host_reputation.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's 5-word shingles."""
    pairs = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return pairs.withColumn("containment", F.round("containment", 6))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op7_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.digests(lexicon_bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files below the shared checkpoint folder and reads them back."""
    path = token_codec.token_folder(spark)
    token_codec.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_codec.summary(token_codec.read_tokens(spark, path))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = repeats.strip_repeats(read(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


def op13_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ball_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 50).select("item_id", "rank", "doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_diff": op1_page_diff,
    "op2_host_reputation": op2_host_reputation,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pu_quality": op5_pu_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_lexicon_bpe": op7_lexicon_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_token_codec": op9_token_codec,
    "op10_secret_scan": op10_secret_scan,
    "op11_repeats": op11_repeats,
    "op12_variants": op12_variants,
    "op13_ball_search": op13_ball_search,
}

#: In SQL, url parts, the prior of each level and the posterior bound, as host_reputation has them.
_OP2 = """
    WITH raw AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
    q AS (SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
    seen AS (SELECT host, CASE WHEN rule IS NOT NULL THEN rule IN ('example.net/en/', 'org/fr/') END AS good FROM q),
    h0 AS (SELECT host, sum(CASE WHEN good THEN 1.0 ELSE 0.0 END)::DOUBLE AS good, count(good)::DOUBLE AS n FROM seen GROUP BY host),
    l AS (SELECT *, string_split(host, '.') AS l, CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (SUFFIXES) THEN 2 ELSE 1 END AS k FROM h0),
    h AS (SELECT host, good, n, array_to_string(list_slice(l, -k, -1), '.') AS suffix, array_to_string(list_slice(l, -k - 1, -1), '.') AS domain FROM l),
    d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY ALL),
    t AS (SELECT (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m FROM s),
    ks AS (SELECT sum(n * (good / n - m) ** 2) AS ss, sum(m * (1 - m)) AS pq, sum((n - 1) * m * (1 - m)) AS npq FROM s, t WHERE n > 0),
    s2 AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM s, t, (SELECT K(ss, pq, npq) AS k FROM ks)),
    d1 AS (SELECT d.*, m FROM d JOIN s2 USING (suffix)),
    kd AS (SELECT sum(n * (good / n - m) ** 2) AS ss, sum(m * (1 - m)) AS pq, sum((n - 1) * m * (1 - m)) AS npq FROM d1 WHERE n > 0),
    d2 AS (SELECT domain, suffix, (good + k * m) / (n + k) AS m FROM d1, (SELECT K(ss, pq, npq) AS k FROM kd)),
    h1 AS (SELECT h.*, m FROM h JOIN d2 USING (domain, suffix)),
    kh AS (SELECT sum(n * (good / n - m) ** 2) AS ss, sum(m * (1 - m)) AS pq, sum((n - 1) * m * (1 - m)) AS npq FROM h1 WHERE n > 0),
    h2 AS (SELECT host, good + k * m AS a, n - good + k * (1 - m) AS b FROM h1, (SELECT K(ss, pq, npq) AS k FROM kh)),
    h3 AS (SELECT host, round(a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 9) AS posterior_bound FROM h2),
    r AS (SELECT q.*, posterior_bound FROM q JOIN h3 USING (host))
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
           WHEN posterior_bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, posterior_bound FROM r
"""
_K = "coalesce(CASE WHEN npq > 0 AND ss > pq AND (ss - pq) / npq > 0.001 THEN greatest(1.0, least(1000.0, 1 / ((ss - pq) / npq) - 1)) ELSE 1000.0 END, 1000.0)"

ORACLE_SQL: dict[str, str] = {
    "op2_host_reputation": _OP2.replace("K(ss, pq, npq)", _K).replace("SUFFIXES", ", ".join(f"'{x}'" for x in host_reputation.SUFFIXES)),
    "op3_decontaminate": """
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
        iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw),
        iss AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw),
        n AS (SELECT item_id, count(*) AS n_shingles FROM iss GROUP BY item_id),
        c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN iss USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9)
    """,
    "op4_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op6_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(k, 0) AS n_links FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM link GROUP BY a) USING (doc_id)
    """,
    "op11_repeats": """
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM t WHERE len(w) >= 50),
        k AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM v),
        s AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) < doc_id AS again FROM k),
        i AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
        c AS (SELECT i.doc_id, i.p, i.x, coalesce(bool_or(again) OVER (PARTITION BY i.doc_id ORDER BY i.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM i LEFT JOIN s ON s.doc_id = i.doc_id AND s.p = i.p),
        o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN o USING (doc_id)
    """,
    "op12_variants": """
        WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))),
        u AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
        g AS (SELECT run, count(*) AS n, hex(concat(doc_id, ':', run)) AS h FROM u GROUP BY doc_id, run),
        c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM g, tab),
        a AS (SELECT CASE WHEN crc % 97 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM c),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM a WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y USING (i, rest) WHERE x.word <> y.word UNION SELECT w.word, d.word FROM w JOIN d ON d.rest = w.word UNION SELECT d.word, w.word FROM w JOIN d ON d.rest = w.word),
        best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS b, max(w.n) AS bn FROM near JOIN w ON w.word = b GROUP BY a),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * w.n THEN b END AS form, CASE WHEN bn >= 2 * w.n THEN bn END AS form_n FROM w LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
        SELECT f.*, chain.at AS root FROM f JOIN chain USING (word) JOIN f AS last ON last.word = chain.at AND last.form IS NULL
    """,
    "op13_ball_search": """
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        d AS (SELECT doc_id, len(w)::BIGINT AS n, w FROM t WHERE len(w) > 0),
        s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
        f AS (SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS x FROM d) GROUP BY ALL),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark),
        df AS (SELECT x, count(*) AS df FROM f GROUP BY x),
        w AS (SELECT x, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))))::BIGINT AS score FROM q JOIN f USING (x) JOIN w USING (x), s GROUP BY ALL),
        o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
    """,
}
