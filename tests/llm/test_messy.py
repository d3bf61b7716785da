"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import ann, bpe, common, htmltext, lmscore, media, mixing, neardup, sharding, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, size long, root long, code int, m_key string, score double"


def messy():
    g = random.Random(3)
    words = [f"w{g.randrange(400)}" for _ in range(200)]
    long = " ".join(f"v{g.randrange(900)}" for _ in range(60_000))
    near = list(words)
    near[10] = "changed"
    other = [f"z{i}" for i in range(70)]
    texts = [None, "", " \n\t ", "a", "A b c d", "a b c d", " ".join(words), " ".join(words), " ".join(near), long, "x" * 70_000, " " * 70_000, "éß \U0001f600 don't  stop it's", " ".join(words[:60] + other), " ".join(other + words[100:160]), "\x00 zero \x7f", "<|endoftext|> plain <|endoftext|>"]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return [*rows, (None, None), (None, " ".join(words)), (7, " ".join(words)), (3, "a")]


@pytest.fixture(scope="module")
def rows():
    return messy()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(k, t, "en", "web" if i % 3 else None, None if t is None else len(t), i, "clash", 1, 2, 3, "key", 0.5) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_same_ids_as_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.tokenizer_path())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digest(docs).collect())
    want = Counter()
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(k, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    assert bpe.round_trip_digest(empty).count() == 0
    back = bpe.decode(bpe.encode(docs))
    assert Counter(r.text for r in back.collect()) == Counter(t or "" for _, t in rows)


def small_table(tmp_path, merges):
    import json

    letters = "abcd"
    vocab = {x: i for i, x in enumerate([*letters, *("".join(m) for m in merges)])}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [" ".join(m) for m in merges]}, "added_tokens": []}))
    return bpe.MergeTable(str(path))


def test_bpe_lookahead_is_sufficient_and_no_byte_less(tmp_path):
    from itertools import product

    table = small_table(tmp_path, [("c", "d"), ("b", "c"), ("a", "b")])
    assert table.lookahead == 3

    def streamed(text, lookahead):
        t = bpe.PieceTransducer(table, lookahead, room=1)
        return [*t.push(text.encode()), *t.finish()]

    texts = ["".join(x) for n in range(1, 8) for x in product("abcd", repeat=n)]
    assert all(streamed(x, table.lookahead) == table.encode_bytes(x.encode()) for x in texts)
    assert any(streamed(x, table.lookahead - 1) != table.encode_bytes(x.encode()) for x in texts)


def test_bpe_transducer_holds_a_bounded_buffer():
    table, _ = bpe.load(bpe.tokenizer_path())
    g = random.Random(2)
    text = "".join(g.choice("abcdefgh th ing the") for _ in range(20_000)).replace(" ", "").encode()
    t, out, most = bpe.PieceTransducer(table), [], 0
    for k in range(0, len(text), 100):
        out += t.push(text[k : k + 100])
        most = max(most, len(t.buffer))
    assert out + t.finish() == table.encode_bytes(text)
    assert most <= t.room + table.lookahead + max(map(len, table.token_bytes))


def test_bpe_chunks_do_not_matter():
    table, known = bpe.load(bpe.tokenizer_path())
    g = random.Random(5)
    for _ in range(60):
        text = "".join(g.choice(["a", "B", "é", " ", "  ", "\n", "9", "'s", "…", "字", "th", "ing"]) for _ in range(g.randrange(400)))
        whole = bpe.encode_text(text)
        assert [i for part in bpe.encode_parts(text, table, known, chunk=7) for i in part] == whole
        decoder = bpe.StreamingDecoder(table)
        assert "".join(decoder.push([i]) for i in whole) + decoder.finish() == text


def test_ann_finds_the_nearest(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((400, 24)).astype(np.float32)
    x[200:260] = x[0]
    data = [(i, v.tolist(), 1, "b") for i, v in enumerate(x)]
    data += [(1000, None, 1, "b"), (1001, [0.0] * 24, 1, "b"), (1002, [float("nan")] * 24, 1, "b"), (1003, [None] * 24, 1, "b"), (None, x[0].tolist(), 1, "b"), (1020, [float("inf")] + [0.0] * 23, 1, "b"), (1040, [], 1, "b")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int, bucket string")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    wide = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        score = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        for _, i, s in found:
            assert abs(s - score[i]) < 1e-9
        hits += len({f[1] for f in found} & set(order))
    assert hits >= 0.9 * 20 * len(got)
    assert [f[1] for f in got[200]][:20] == [0, *range(201, 220)]
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2


def nearest(spark, x, asked, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {int(q): [] for q in asked}
    for r in sorted(ann.search(df, df.where(F.col("vec_id").isin([int(q) for q in asked]))).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    want = {}
    for q in got:
        score = x @ x[q]
        want[q] = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:k]
    return got, want


def test_ann_keys_reach_the_recall_with_a_share_of_the_products():
    x = np.random.default_rng(9).standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::200]
    near = np.argsort(-(q @ x.T), axis=1)[:, 1:21]
    met, products = np.zeros((len(q), len(x)), dtype=bool), 0
    for table in range(16):
        one, two = ann.keys(x, table, len(x))
        a, b = ann.probed(q, table, len(x), 52)
        for i in range(len(q)):
            hit = np.isin(one * 1000 + two, a[i] * 1000 + b[i])
            met[i] |= hit
            products += int(hit.sum())
    assert np.take_along_axis(met, near, 1).mean() >= 0.9
    assert products <= 0.3 * met.size and met.mean() <= 0.25


def test_ann_searches_by_hashing(spark):
    x = np.random.default_rng(11).standard_normal((10_000, 64)).astype(np.float32).astype(np.float64)
    got, want = nearest(spark, x / np.linalg.norm(x, axis=1, keepdims=True), range(0, 10_000, 100))
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.9 * 20 * len(got)


def test_ann_counts_repeated_rows_once(spark):
    g = np.random.default_rng(6)
    one, x = g.standard_normal(16), g.standard_normal((40, 16))
    rows = [(1, one)] * 30 + [(i, one) for i in range(2, 10)] + [(11, one), (20, one)] + [(100 + i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    got = [(r.rank, r.vec_id) for r in sorted(ann.search(df, df.where("vec_id = 20")).collect())]
    assert [i for _, i in got[:10]] == [1, *range(2, 10), 11] and [r for r, _ in got] == list(range(1, 21)) and len({i for _, i in got}) == 20


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_ann_on_the_supplied_tables(spark, table):
    """Recall by brute force, and by hashing alone: no range is scanned where the keys give enough."""
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows["embedding"].to_list()).astype(np.float64)
    got, want = nearest(spark, x, range(0, len(x), 20))
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.9 * 20 * len(got)
    assert got != want and ann.probes_for(len(x), 52) < ann.probes_for(500, 52) + 1 <= 130


def test_ann_gives_all_of_a_few(spark):
    got, want = nearest(spark, np.random.default_rng(1).standard_normal((15, 64)), range(15))
    assert got == want


def test_ann_with_one_huge_norm(spark):
    x = np.random.default_rng(2).standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1000
    got, want = nearest(spark, x, range(0, 6000, 100))
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.9 * 20 * len(got)


def test_ann_with_all_away_from_the_query(spark):
    x = np.random.default_rng(3).standard_normal((6000, 64)) * 0.001
    x[:, 0] += 1
    x[5] = -x[5]
    got, want = nearest(spark, x, [5])
    assert got == want


def test_html_names_are_read_whole():
    prose = "<p>" + "A long enough sentence of the article that says something here. " * 5 + "</p>"
    readers = '<div class="comments-area"><p>no way, a reader</p></div><div class="post-comments"><p>another reader</p></div><ul class="comment-list"><li>reader three</li></ul>'
    for name, article in enumerate(('<article class="post comments-open">%s</article>', '<div class="post has-comments">%s</div>', '<div class="comments"><article>%s</article></div>', '<div id="reply-to-critics">%s</div>')):
        assert htmltext.main_text(f"<html><body>{article.replace('%s', prose)}{readers}</body></html>") == prose[3:-4].strip(), name
    for part in ('<div id="side-effects">%s</div>', '<section id="reply-to-critics">%s</section>'):
        assert htmltext.main_text(f"<article>{prose}{part.replace('%s', prose)}</article>").count("\n") == 1
    assert [htmltext.hinted(x) for x in ("site-header", "has-comments", "post comment-list", "side-effects", "sidebar-2", "")] == [1, 0, 2, 0, 1, 0]


@pytest.mark.parametrize("bad", ["<![foo", "<![foo bar>", "<![ endif]>", "<![1]>"])
def test_html_goes_on_after_an_unknown_section(bad):
    page = f"<html><body><article><p>The first paragraph.</p>{bad}<p>The second one.</p><p>The third one.</p></article></body></html>"
    assert htmltext.main_text(page) == "The first paragraph.\nThe second one.\nThe third one."


def test_neardup_trees_branch_at_every_level(spark):
    g = np.random.default_rng(6)
    n, trees = 3000, 4
    one = g.integers(0, 1 << 16, (n, neardup.PLACES)).astype(np.uint16)
    two = np.where(g.random(one.shape) < 0.75, one, g.integers(0, 1 << 16, one.shape)).astype(np.uint16)
    sig = np.concatenate((one, two))
    roots = [[] for _ in sig]
    for tree in range(trees):
        rows, names = neardup._children(np.full(len(sig), tree + 1, dtype=np.uint64), sig, 4 / 3)
        for i, name in zip(rows.tolist(), names.view(np.int64).tolist(), strict=True):
            roots[i].append(name)
    known = spark.createDataFrame([(i, sig[i].tobytes(), roots[i]) for i in range(2 * n)], "r long, sig binary, roots array<long>")
    edges, _ = neardup.coarse_edges(known, common.Tables(spark, "test"), node_limit=1, max_depth=4)
    missed = n - edges.where("b = a + 3000").select("a").distinct().count()
    assert missed <= 0.065 * n  # four levels of 4/3 places miss 0.47 ** 4, two of them with one place 0.54 ** 4


def test_neardup_trees_meet_the_recall():
    g = np.random.default_rng(8)
    for levels in (1, 3):
        trees = neardup.trees_for(0.9, 0.75, levels)
        one = g.integers(0, 1 << 16, (4000, neardup.PLACES)).astype(np.uint16)
        two = np.where(g.random(one.shape) < 0.75, one, g.integers(0, 1 << 16, one.shape)).astype(np.uint16)
        found = np.zeros(len(one), dtype=bool)
        for tree in range(trees):
            alive = [(np.arange(len(one)), np.full(len(one), tree + 1, dtype=np.uint64), np.full(len(one), tree + 1, dtype=np.uint64))]
            for _ in range(levels):
                rows = np.concatenate([r for r, _, _ in alive])
                node = np.concatenate([x for _, x, _ in alive])
                at, a = neardup._children(node, one[rows], 4 / 3)
                _, b = neardup._children(node, two[rows], 4 / 3)
                alive = [(rows[at][a == b], a[a == b], b[a == b])]
            found[alive[0][0]] = True
        assert found.mean() >= 0.88


def test_media_round_trip(docs, rows, empty):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_digest(docs).collect())
    want = Counter()
    for k, t in rows:
        data = (t or "").encode()
        full = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        want[(k, len(data), len(full), sha(full), zlib.crc32(full[-16:]))] += 1
    assert got == want
    by = {}
    for r in media.media_digest(docs).collect():
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_digest(empty).count() == 0


def test_media_knows_the_length_of_what_it_stores():
    for text in (None, "x" * 1000, "y" * 3_000_000):
        n, payload = media.payload_of(text)
        (file,) = media.store([payload])
        assert media.stored_bytes(file) == len(payload) and media.restore([file])[0] == [payload]
        if len(payload) < 10_000:
            tensor = media.decode([file])[0]
            assert media.restore([file])[1][0].endswith(hashlib.sha256(np.ascontiguousarray(tensor)).hexdigest())
    with pytest.raises(ValueError):
        media.restore([file[:2] + file[2 + 2 + int.from_bytes(file[4:6], "big") :]])


def test_media_picture_matches_a_plain_transform():
    g = np.random.default_rng(1)
    layout = media.Layout(19, 13, ((2, 2), (1, 1), (1, 1)))
    rows = (g.integers(-9, 10, (layout.blocks, 64)) * (g.random((layout.blocks, 64)) < 0.3)).astype(np.int64)
    filled = np.setdiff1d(np.arange(layout.blocks), np.concatenate([layout.order((c,))[0] for c in range(3)]))
    rows[filled, 1:] = 0  # scans of one component leave out the blocks that only fill up the grid
    quant = np.arange(1, 65)
    data = media.encode([rows], [layout], quant)[0]
    _, _, back, _ = media.read_coefficients([data])
    assert (back == rows).all()
    got = media.decode([data])[0]
    planes = []
    for c, (h, v) in enumerate(layout.sampling):
        down, across = layout.grid[c]
        plane = np.zeros((down * 8, across * 8))
        for i, block in enumerate(rows[layout.start[c] : layout.start[c + 1]] * quant):
            f = np.zeros(64)
            f[media.ZIGZAG] = block
            f = f.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if w == 0 else 1) * f[w, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * w * np.pi / 16) for u in range(8) for w in range(8))
                    plane[i // across * 8 + y, i % across * 8 + x] = min(255, max(0, s / 4 + 128))
        planes.append(np.kron(plane, np.ones((layout.vmax // v, layout.hmax // h)))[:13, :19])
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    want = np.clip(np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), axis=-1), 0, 255)
    assert np.abs(got - want).max() <= 2
    with pytest.raises(ValueError):
        media.decode([b"not a picture"])


def test_sharding(docs, rows, empty):
    got = sharding.assign(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 16 and r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.assign(empty).count() == 0


def test_changed_weight_stays_in_its_subtree(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    tree = sharding.even_tree()
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    moved = keys.select(sharding.place(F.col("key"), tree).alias("a"), sharding.place(F.col("key"), heavy).alias("b")).where("a <> b").collect()
    assert moved and all(m.b == 5 or m.b // 4 == 1 or m.b // 8 == 0 for m in moved)


def test_toxicity(spark, docs, rows, empty):
    bad = [(100 + i, f"you are awful trash number{i % 7} and {'stupid' if i % 2 else 'vile'} person {i}") for i in range(120)]
    good = [(300 + i, f"the river number{i % 7} runs past the {'old' if i % 2 else 'new'} mill {i}") for i in range(120)]
    known = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = known.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") < 300).cast("int").alias("toxic"), F.lit("clash").alias("text"))
    out = {r.doc_id: r for r in toxicity.classify(known, labels).collect()}
    held = [r for r in out.values() if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())
    assert sum(r.predicted == (r.doc_id < 300) for r in held) >= 0.9 * len(held)
    net = toxicity.train(known, labels)
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert net.scores(["the river runs " * 4000 + "awful stupid vile trash person"])[0] > net.scores(["the river runs " * 4000])[0]
    assert toxicity.classify(empty, labels).count() == 0
    few = docs.limit(12)
    kept = toxicity.keep_clean(few, labels)
    assert kept.columns == docs.columns and toxicity.keep_clean(empty, labels).count() == 0
    wide = "the river runs past the mill and " * 60_000
    assert net.scores([wide + "awful stupid vile trash person " + wide])[0] >= net.scores([wide])[0]
    assert {r.score for r in toxicity.classify(known, labels.where("false")).collect()} == {0.5}


def _brute_classes(rows):
    sets = {}
    for k, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets[k] = s
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_neardup_messy(docs, rows, empty):
    got = neardup.classes(docs).collect()
    want = _brute_classes({k: t for k, t in rows if k is not None and (k, t) != (3, "a")}.items())
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id not in (None, 3, 4))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert len([r for r in got if r.doc_id is None]) == 2
    assert neardup.classes(empty).count() == 0
    assert neardup.keep_first(docs).columns == docs.columns
    assert neardup.keep_first(empty).count() == 0


def test_neardup_loses_no_text_of_a_repeated_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    schema = "doc_id long, text string, k long, h long, first string, finger string"
    for given, want in (([(3, a), (5, a), (5, b), (9, b)], [(3, a), (5, b)]), ([(2, b), (5, a), (5, b)], [(2, b), (5, a)]), ([(None, a), (4, None), (4, ""), (4, a)], [(None, a), (4, None), (4, ""), (4, a)])):
        df = spark.createDataFrame([(k, t, 1, 2, "clash", "clash") for k, t in given], schema)
        got = sorted(((r.doc_id, r.text) for r in neardup.keep_first(df).collect()), key=repr)
        assert got == sorted(want, key=repr)


def test_neardup_many_texts_and_rows_of_one_id(spark):
    g = random.Random(8)
    base = [f"w{g.randrange(9000)}" for _ in range(100)]
    rows = [(1, " ".join([*base, f"end{i}"])) for i in range(300)] + [(2, " ".join(base))] * 300 + [(3, "something else that has nothing in common with it")]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)} and len(got) == 601


def test_linked_labels_by_brute_force():
    g = np.random.default_rng(3)
    for _ in range(40):
        base = g.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(60):
            s = base.copy()
            s[g.choice(60, g.integers(0, 14), replace=False)] = g.integers(10_000, 10_300)
            sets.append(np.unique(s).astype(np.uint64))
        up = np.arange(60)
        hits = [(i, j) for i in range(60) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - both)]
        want = neardup.least_labels(up, np.array([i for i, _ in hits], dtype=int), np.array([j for _, j in hits], dtype=int))
        assert (neardup.linked_labels(sets, up, leaders=4) == want).all()


@pytest.mark.parametrize("limits", [{}, {"node_limit": 20, "class_limit": 40}])
def test_neardup_large_class(spark, limits):
    g = random.Random(1)
    base, rows = [f"w{g.randrange(5000)}" for _ in range(150)], []
    for i in range(160):
        w = list(base)
        for _ in range(g.choice([0, 1, 3, 5, 9])):
            w[g.randrange(150)] = f"x{g.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()}
    assert got == _brute_classes(rows)


def test_html(spark):
    body = "<p>The mill stood by the river for a very long time &amp; nobody   knew\nwho built it.</p>" * 3
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header><article><h1>Mill</h1>{body}</article><aside>Ads</aside><div class='comments'><p>first!</p></div><footer>foot</footer></body></html>"
    rows = [(1, "u", page, "clash"), (2, "u", None, "clash"), (3, "u", "", "clash"), (4, None, "<p>unclosed <b>text", "clash"), (5, "u", "<![", "clash"), (None, "u", page, "clash"), (1, "u", page, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    line = "The mill stood by the river for a very long time & nobody knew who built it."
    assert [r.text for r in got if r.page_id == 1] == ["\n".join(["Mill", line, line, line])] * 2
    assert all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert next(r.text for r in got if r.page_id == 4) == "unclosed text"
    assert htmltext.extract(df.where("false")).count() == 0


def plain_article(page):
    """The text of a well-formed page's only article, by taking tags away."""
    body = re.search(r"<article[^>]*>(.*)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body, flags=re.S)
    body = re.sub(r"<br\b[^>]*>", " ", body)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|pre|section|table|tr|td|th)\b[^>]*>", body)
    lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in blocks]
    return "\n".join(x for x in lines if x)


def test_html_of_all_pages_by_taking_tags_away(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: (r.url, plain_article(r.html)) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text) for r in htmltext.extract(pages).collect()} == want


def test_html_keeps_formulas_parts_and_linked_items():
    line = "<p>The mill stood by the river for a very long time and nobody knew who built it, or when, or why.</p>"
    two = f"<body><nav><a href=x>Home</a></nav><article>{line * 3}</article><div class=ad>Buy!</div><article>{line * 2}<p>x = <math><mi>a</mi></math></p></article></body>"
    text = htmltext.main_text(two)
    assert text.count("The mill") == 5 and "x = a" in text and "Buy" not in text and "Home" not in text
    bare = f"<body><ul><li><a href=x>Home</a></li></ul><div>{line * 3}<ul><li><a href=y>First source</a></li><li><a href=z>Second source</a></li></ul>{line * 3}</div></body>"
    assert "First source\nSecond source" in htmltext.main_text(bare) and "Home" not in htmltext.main_text(bare)
    long = f"<article>{line * 20_000}</article>"
    assert htmltext.main_text(long).count("\n") == 19_999


def test_lm_scores(spark, docs, rows, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1), (5, 1), (None, 1), (7, 0), (8, None)], "doc_id long, quality int")
    got = lmscore.difference(docs, labels).collect()
    assert len(got) == len(rows)
    words = {(i, k): WORD.findall(t or "") for i, (k, t) in enumerate(rows)}
    models = []
    for only in (False, True):
        two, one, total = Counter(), Counter(), 0
        for (_, k), w in words.items():
            if w and (not only or k in (5, 6)):
                two.update(zip(["", *w], w, strict=False))
                one.update(["", *w])
                total += len(w)
        models.append((two, one, total))
    every = models[0][2]
    div = lambda a, b: a / b if b > 0 else 0.0
    want = Counter()
    for (_, k), w in words.items():
        own2, own1, loss = Counter(zip(["", *w], w, strict=False)), Counter(["", *w]), []
        for m, (two, one, total) in enumerate(models):
            x = 1 if m == 0 or k in (5, 6) else 0
            loss.append(sum(-np.log(0.6 * div(two[u, v] - x * own2[u, v], one[u] - x * own1[u]) + 0.3 * div(one[v] - x * own1[v], total - x * len(w)) + 0.1 / (every + 1)) for u, v in zip(["", *w], w, strict=False)) / max(1, len(w)))
        want[(k, len(w), round(loss[0], 6), round(loss[1], 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, round(r.background_loss, 6), round(r.target_loss, 6)) for r in got) == want
    assert all(abs(r.score - r.target_loss + r.background_loss) < 1e-9 for r in got)
    assert lmscore.difference(empty, labels).count() == 0
    assert lmscore.difference(docs, labels.where("false")).count() == len(rows)


def _brute_removed(rows, window=50):
    first = {}
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if k is not None:
                first[key] = min(first.get(key, k), k)
    out = Counter()
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if k is not None else ():
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out[(k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


def test_substring(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs, digest=True).collect())
    want = _brute_removed(rows)
    assert sum(x[2] for x in want) > 200 and got == want
    assert substring.dedup(empty, digest=True).count() == 0
    clash = docs.withColumns({"g": F.lit(1), "k": F.lit(2), "t": F.lit("t"), "row": F.lit(3), "s": F.lit(4), "bits": F.lit(5)})
    assert substring.remove_repeats(clash).count() == substring.remove_repeats(docs).count() and substring.remove_repeats(empty).count() == 0
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.where("text is not null and text <> '' and n_chars <> length(text)").count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    keys = lambda found: Counter((r.doc_id, r.text) for r in found if r.m_pass == 0)
    assert keys(got) == Counter(rows)  # without a budget nothing is dropped
    tokens = lambda t: len(WORD.findall(t or "")) + 1
    assert all(r.m_tokens == tokens(r.text) for r in got)
    share, once = Counter(), Counter()
    for r in got:
        share[r.source] += r.m_tokens
        once[r.source] += r.m_tokens * (r.m_pass == 0)
    assert all(share[s] <= 2 * once[s] + 1 for s in share)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).select(*docs.columns).columns == docs.columns
    clash = docs.withColumns({"m_tokens": F.lit("mine"), "m_pass": F.lit(1), "m_weight": F.lit(1), "m_start": F.lit(1), "m_doc": F.lit(1), "weight": F.lit(1), "passes": F.lit(1)})
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).count() == len(got)
    assert {r.m_tokens for r in mixing.mix(clash).select("m_tokens", "_m_tokens").collect()} == {"mine"}
    flat = mixing.mix(docs, entropy=0.69).collect()
    assert len({r.m_weight for r in flat}) <= 2
