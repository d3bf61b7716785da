"""Near-dedup and substring stages of the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from foliospark.llm import common, toxicity
from foliospark.llm.queries import QUERIES
from foliospark.llm.sql import ORACLES


def words(text, lower=False):
    data = (text or "").encode("utf-8", "surrogatepass")
    return re.findall(rb"[^\x20\x09-\x0D]+", data.lower() if lower else data)


def first_of_classes(rows):
    """The smallest id of each class of near copies, by all pairs."""
    sets = {}
    for k, t in rows.items():
        w = words(t, lower=True)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(rows)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                i, j = find(a), find(b)
                up[max(i, j)] = min(i, j)
    return [k for k in keys if find(k) == k]


def without_repeats(rows):
    """Words of each document without those in a window that starts in an earlier one; None where nothing goes. Documents that lose all are gone."""
    seen, want = {}, {}
    split = {k: words(rows[k]) for k in sorted(rows)}
    for k, w in split.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), k)
    for k, w in split.items():
        gone = {p for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        if not gone or len(gone) < len(w):
            want[k] = [x for p, x in enumerate(w) if p not in gone] if gone else None
    return want


def test_near_dedup_and_substring_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = corpus_pipeline.drop_near_copies(spark, docs, sf)
    kept = first_of_classes(rows)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == kept
    got = {r.doc_id: words(r.text) for r in corpus_pipeline.cut_repeats(spark, left, sf).collect()}
    assert got == {k: words(rows[k]) if w is None else w for k, w in without_repeats({k: rows[k] for k in kept}).items()}


def test_the_whole_run_by_brute_force(spark, sf):
    """The network's own scores, all pairs, all windows, the mixture in SQL and the tokenizers library, one after the other."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").toPandas()
    clean = {r.doc_id for r in QUERIES["op5_toxicity"](spark, sf).where("predicted = 0").collect()}
    texts = {k: t for k, t in zip(table["doc_id"], table["text"], strict=True) if k in clean}
    kept = first_of_classes(texts)
    left = {k: texts[k] if w is None else b" ".join(w).decode("utf-8", "surrogatepass") for k, w in without_repeats({k: texts[k] for k in kept}).items()}
    documents = pd.DataFrame({"doc_id": list(left), "text": list(left.values())}).merge(table[["doc_id", "source"]], on="doc_id")
    duck = duckdb.connect()
    duck.register("documents", documents)
    taken = Counter(r[0] for r in duck.sql(f"SELECT doc_id FROM ({ORACLES['op10_mixing']})").fetchall())
    lib, want = Tokenizer.from_file(common.tokenizer_path()), Counter()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, times in taken.items():
        ids = lib.encode(left[k] or "", add_special_tokens=False).ids
        want[(k, len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False)))] = times
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_sample_is_not_cut():
    assert toxicity.SAMPLE >= 2500


def test_stages_on_messy_rows(spark, sf, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns, and no rows at all."""
    w = [" ".join(f"{c}{i}" for i in range(120)) for c in "abc"]
    rows = [(1, w[0]), (2, w[0]), (2, w[1]), (None, w[2]), (None, None), (3, None), (4, ""), (5, w[1] + " " + w[2]), (5, w[1] + " " + w[2])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, h string, m_tokens int, g int, first string"
    docs = spark.createDataFrame([(k, t, "en", "web" if i % 2 else None, None if t is None else len(t), 1, "h", 2, 3, "f") for i, (k, t) in enumerate(rows)], schema)
    for name, given in (("full", docs), ("empty", docs.where("false"))):
        for stage, fn in corpus_pipeline.STAGES:
            out = fn(spark, given, sf)
            if stage != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}/{stage}")
            given = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            if name == "full" and stage == "near_dedup":
                assert sorted({(r.doc_id, r.text) for r in given.collect()}, key=repr) == sorted({x for x in rows if x != (2, w[0])}, key=repr)
        assert given.count() == (0 if name == "empty" else spark.read.parquet(f"{tmp_path}/{name}/mixing").count())
