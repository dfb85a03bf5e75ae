"""Top-k search, clustering and token alignment against plain versions on odd rows, ties, empty tables and clashing columns."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from oracle_compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetspark.llm import alignment, block_topk, centroids, queries

SF = "/root/testdata/sf0.001"
LONG = (1 << 63) - 1
CLASH = ["row", "range", "query", "v", "d", "hi", "lo", "score", "rank", "cluster", "n", "a", "b", "count", "links", "hash"]
VECTOR = "vec_id long, embedding array<double>, label int"


def extra(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_centroid_clusters"])
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == ""


# ---------------------------------------------------------------- top-k


def plain_top_k(rows, k, every, scale):
    kept = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    out = Counter()
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = []
        for other, (j, x) in enumerate(kept):
            if other != at:
                scored.append((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, x)))), j is None, j or 0))
        for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1):
            out[(i, rank, None if none else j, -s)] += 1
    return out


def vectors(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(2).tolist(), 0) for i in range(n)]
    rows += [(i, rows[3][1], 0) for i in range(n, n + 40)]  # equal vectors: ties by id
    return rows


ODD = [
    (0, [0.5] * 6, 0), (0, [0.5] * 6, 0), (20, [1.0, -1.0], 0), (None, [0.4] * 6, 0), (5, None, 0), (6, [], 0), (40, [], 0),
    (7, [0.1, None], 0), (8, [float("nan")] * 6, 0), (9, [float("inf"), 1.0], 0), (60, [1e12, -3e11, 0.0, 0.0, 5.0, 1.0], 0),
    (61, [1e12, 3e11, 1.0, 2.0, 3.0, 4.0], 0), (80, [0.0] * 6, 0), (81, [-0.01] * 6, 0),
]


@pytest.mark.parametrize("rows", [vectors(300, 1), ODD, vectors(90, 2) + ODD, ODD[:1], vectors(5, 3)[:5]])
def test_top_k_equals_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(block_topk, "BLOCK", 8)
    monkeypatch.setattr(block_topk, "RANGE_BLOCKS", 4)
    monkeypatch.setattr(block_topk, "SLICE_QUERIES", 5)
    monkeypatch.setattr(block_topk, "BUCKET_RANGES", 2)
    got = block_topk.exact_top_k(extra(spark.createDataFrame(rows, VECTOR)), F.col("vec_id") % 20 == 0, 7, 64)
    assert Counter(map(tuple, got.collect())) == plain_top_k(rows, 7, 20, 64)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(12, 16)) * 40
    data = np.floor(np.concatenate([c + rng.normal(size=(block_topk.BLOCK, 16)) for c in centre]))
    cuts = np.arange(0, len(data), block_topk.BLOCK)
    bounds = block_topk._bounds(data, np.maximum.reduceat(data, cuts), np.minimum.reduceat(data, cuts))
    scores = data @ data.T
    assert (np.maximum.reduceat(scores, cuts, axis=1) <= bounds).all()
    seen = []
    plain = block_topk._scores
    try:
        block_topk._scores = lambda q, r: seen.append(len(q) * len(r)) or plain(q, r)
        none = np.zeros(len(data), np.int64)
        block_topk._best_in_range(data, np.arange(len(data)), none, none.astype(bool), data, np.arange(len(data)), np.arange(len(data)), 5)
    finally:
        block_topk._scores = plain
    assert sum(seen) < len(data) ** 2 / 2  # close vectors leave most blocks out


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], VECTOR)
    assert block_topk.exact_top_k(none, F.col("vec_id") % 20 == 0, 7, 64).count() == 0
    assert block_topk.exact_top_k(spark.createDataFrame([(1, [1.0], 0)], VECTOR), F.lit(False), 7, 64).count() == 0


# ---------------------------------------------------------------- clusters


def plain_lloyd(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds if cents else 0):
        near = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if mine:
                cents[j] = [sum(column) // len(mine) for column in zip(*mine)]
    near = assign() if cents else []
    each = defaultdict(int)
    for d, c in near:
        each[c] += min(LONG, d)
    total = min(LONG, sum(each.values()))
    return Counter(
        (i, c, min(LONG, d), min(LONG, each[c]), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, near)
    )


def clustered(spark, rows, **how):
    how = {"k": 4, "rounds": 5, "dim": 6, "scale": 1024, "seed": "3:"} | how
    got = centroids.cluster_vectors(extra(spark.createDataFrame(rows, VECTOR)), **how).digest()
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_lloyd(rows, **how)


def test_lloyd_rounds(spark):
    clustered(spark, vectors(250, 4))
    clustered(spark, vectors(40, 5) + ODD)
    clustered(spark, [(i, [float(i % 2), 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(30)])  # ties and empty clusters
    clustered(spark, ODD, k=3)
    clustered(spark, vectors(4, 6)[:2], k=8)  # fewer vectors than centroids
    clustered(spark, [], k=8)


def test_sums_beyond_longs(spark):
    rng = np.random.default_rng(8)
    clustered(spark, [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 30)).tolist(), 0) for i in range(60)])


def test_pivots_prune_and_never_change_the_nearest():
    rng = np.random.default_rng(9)
    x = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) for c in rng.normal(size=(6, 8)) * 300]))
    cents = [[int(v) for v in x[i]] for i in range(0, 1200, 150)]
    pivots = centroids._pivots([[int(v) for v in row] for row in x[::40]])
    d = centroids._lengths(x, pivots)
    assert (centroids._lower_bounds(d, cents, pivots) <= centroids._lengths(x, cents)).all()
    cluster, best, looked = centroids.nearest(x, d, cents, pivots)
    exact = np.square(x[:, None] - np.array(cents)[None]).sum(2)
    assert (cluster == exact.argmin(1)).all() and best == exact.min(1).astype(int).tolist()
    assert looked < exact.size / 2
    assert centroids.nearest(x[:0], d[:0], cents, pivots)[1] == []
    same = centroids.nearest(x, np.zeros((len(x), 0)), cents, [])
    assert (same[0] == cluster).all() and same[2] == exact.size  # without pivots nothing is ruled out


# ---------------------------------------------------------------- alignment

PROSE = "The quick brown fox; jumps over l'été naïve — 東京 is 12,345.67 km away!\n\n\tvoilà "
TEXTS = [
    (1, PROSE), (2, None), (3, ""), (4, " "), (5, "  two  spaces "), (6, "<|endoftext|> and <s> </s> <unk> ▁ <0x41>"), (7, "\x00\x01 nul"),
    (8, "🙂👩‍👩‍👧 Ǆ ﬁ é é"), (9, PROSE * 40), (9, PROSE * 40), (None, "one two three"), (11, "one two three"), (12, "\n"), (13, " " * 3000),
    (14, "a" * 5000), (15, "ÀÉ" * 2000),
]


@pytest.fixture(scope="module")
def plain_pair():
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    return a, b


def plain_tokens(pair, text):
    """Ids and byte strings of both tokenizers, none if one of them does not give the text back."""
    a, b = pair
    if not text:
        return [], []
    letters = {v: k for k, v in alignment._byte_letters().items()}
    back = {c: k for k, c in letters.items()}
    out_a = [(t, bytes(back[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
    out_b = []
    for t in b.encode(text):
        piece = b.id_to_piece(t)
        out_b.append((t, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and b.is_byte(t) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    same = b"".join(x for _, x in out_a) == want == b"".join(x for _, x in out_b)
    return (out_a, out_b) if same else ([], [])


def plain_alignment(pair, rows):
    docs = []
    for i, text in rows:
        a, b = plain_tokens(pair, text)
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        links = [(x, y) for (x, _), e in zip(a, ends_a) for (y, _), f in zip(b, ends_b) if e == f] if len(a) < 3000 else [
            (a[ends_a.index(e)][0], b[ends_b.index(e)][0]) for e in sorted(set(ends_a) & set(ends_b))
        ]
        groups, at_a, at_b = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(str(t) for t, _ in a[at_a:to_a]) + "|" + ",".join(str(t) for t, _ in b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        docs.append((i, len(a), len(b), groups, links))
    counts = Counter(link for *_, links in docs for link in links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter(
        (
            i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for i, n_a, n_b, groups, links in docs
    )


@pytest.mark.parametrize("pair_rows", [1 << 20, 0])
def test_alignment_equals_the_plain_version(spark, monkeypatch, plain_pair, pair_rows):
    monkeypatch.setattr(alignment, "PAIR_ROWS", pair_rows)  # 0: counts come by a shuffle
    monkeypatch.setattr(alignment, "PIECE", 7)
    monkeypatch.setattr(alignment, "CHUNK", 900)
    df = extra(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    got = alignment.align_documents(df, queries.alignment_tokenizers())
    assert Counter(map(tuple, got.collect())) == plain_alignment(plain_pair, TEXTS)
    assert alignment.align_documents(df.filter("false"), queries.alignment_tokenizers()).count() == 0


def test_query_equals_the_plain_version_on_a_table(spark, plain_pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.QUERIES["op13_token_alignment"](spark, SF).collect())) == plain_alignment(plain_pair, rows)


def test_group_rows_give_back_text_and_ids(spark, plain_pair):
    df = spark.createDataFrame(TEXTS[:9], "doc_id long, text string")
    got = alignment.token_groups(df, queries.alignment_tokenizers()).orderBy("doc_id", "group").collect()
    for i, text in TEXTS[:9]:
        a, b = plain_tokens(plain_pair, text)
        mine = [r for r in got if r.doc_id == i]
        assert [x for r in mine for x in r.a_ids] == [x for x, _ in a]
        assert [x for r in mine for x in r.b_ids] == [x for x, _ in b]
        assert [r.group for r in mine] == list(range(len(mine)))
        if mine:
            assert mine[-1].end == len((" " + text).encode())


def test_merge_path_pieces_are_equal_and_complete():
    rng = np.random.default_rng(10)
    for _ in range(60):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 200))) for _ in range(2))
        total = len(a) + len(b)
        order = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        diagonals = np.arange(total + 1)
        want = np.cumsum([0] + [kind == 0 for _, kind in order])
        assert alignment.crossings(a, b, diagonals).tolist() == want.tolist()
        for piece in (1, 2, 7, 1000):
            at_a, at_b = alignment.shared_ends(a, b, piece)
            assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
