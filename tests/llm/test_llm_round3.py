"""Fill-in-middle, token alignment and nearest neighbours against brute force, on rows that hold the awkward cases."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftbase.llm import alignment, fill_middle, neighbours
from test_llm_operators import SCHEMA, docs, nothing, rows  # noqa: F401


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_by_hand(doc_id, text):
    """(n, form, prefix, middle, suffix, output) by the rules, without a match."""
    text, n = text or "", len(text or "")
    h = digest(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, docs, rows, nothing):  # noqa: F811
    names = ["n", "form", "prefix", "middle", "suffix", "output"]
    made = fill_middle.fill_in_middle(docs.withColumn("form", F.lit("clash")))
    assert made.columns == [*docs.columns, *names]
    got = sorted((tuple(r) for r in made.select("doc_id", "text", *names).collect()), key=repr)
    assert got == sorted(((r[0], r[1], *cut_by_hand(r[0], r[1])) for r in rows), key=repr)
    assert {r[3] for r in got} == {"plain", "spm", "psm"}
    back = made.select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert fill_middle.fill_in_middle(nothing).count() == 0


def test_fill_in_middle_sentinels(spark):
    """Texts with a sentinel stay plain; halves of sentinels at the cuts do no harm."""
    texts = ["a<P>b", "<S>", "x<M>" * 50] + ["<<P<S<M>>S>P>M"[: 3 + i % 12].replace("<M>", "<M") * 9 for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    for r in made:
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == cut_by_hand(r.doc_id, r.text)
        assert r.back == r.text
    assert sum(r.form != "plain" for r in made) > 40


def test_units():
    text = "né 日\n" * 50
    assert fill_middle.Units().ends(text) == list(range(1, len(text) + 1))
    assert fill_middle.Units(matched=7).ends(text) == list(range(1, len(text) + 1))  # in stretches
    words = fill_middle.Units(r"\s*\S+|\s+$")
    assert words.ends("one two\n three ") == [3, 7, 14, 15]
    assert words.ends("") == []
    with pytest.raises(ValueError):
        fill_middle.Units("a").ends("aab")


@pytest.fixture(scope="module")
def by_hand():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(alignment.FIRST), SentencePieceProcessor(model_file=alignment.SECOND)
    first.encode_special_tokens = True
    byte = alignment.byte_level()
    entries = {i: bytes(byte[c] for c in e) for e, i in first.get_vocab(with_added_tokens=False).items() if all(c in byte for c in e)}

    def piece(i):
        text = second.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if second.is_byte(i) else text.replace("▁", " ").encode()

    def run(text):
        """Ids, groups and links of a whole text, or None; every position is walked."""
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_ = [[entries[i] for i in a], [piece(i) for i in b]]
        if any(b"".join(x) != b" " + text.encode() for x in bytes_):
            return None
        begin = [[0, *np.cumsum([len(y) for y in x]).tolist()] for x in bytes_]
        groups, i, j = [], 0, 0
        for end in sorted(set(begin[0][1:]) & set(begin[1][1:])):
            x, y = begin[0].index(end, i), begin[1].index(end, j)
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links, j = [], 0
        for i in range(len(a)):
            while begin[1][j + 1] <= begin[0][i]:
                j += 1
            k = j
            while k < len(b) and begin[1][k] < begin[0][i + 1]:
                links.append((a[i], b[k]))
                k += 1
        return a, b, groups, links

    return run


def compare_alignment(spark, rows_, by_hand, chunk_bytes=alignment.CHUNK_BYTES):
    from siftbase.session import written

    df = spark.createDataFrame(rows_, "doc_id long, text string, chunk string, n_a string").repartition(3)
    made = written(alignment.align(df, chunk_bytes=chunk_bytes), "alignment")
    pairs_ = alignment.told_pairs(made)
    out = made.join(alignment.link_sums(made, pairs_), ["chunk", "place"])
    got = sorted((tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=repr)
    told = [(r[0], by_hand(r[1])) for r in rows_]
    counts = collections.Counter(link for _, t in told if t for link in t[3])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for doc_id, t in told:
        if t is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in t[2])
        want.append((doc_id, len(t[0]), len(t[1]), len(t[2]), len(t[3]), sum(counts[x] == best[x[1]] for x in t[3]), sum(counts[x] for x in t[3]), text))
    assert got == sorted(want, key=repr)
    mapped = {(r.a_id, r.b_id): (r.n, r.best) for r in alignment.link_counts(pairs_).collect()}
    assert mapped == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    return got, made.select("chunk").distinct().count()


def test_alignment(spark, rows, by_hand):  # noqa: F811
    odd = [
        " leading blank", "  two", "trailing ", "a  b   c", "tab\t x\n y", "a b 　c  d", "mark ▁ inside", "▁", "\x00 zero", "<0x41> <s> </s> <unk>", "<|endoftext|> x<|endoftext|>",
        "don't we'll it's", "😀 emoji 👩‍👩‍👧 family", "ﬁ ligature Å", "1234567 3.14 1,000", "x" * 3000, "日本語のテキスト " * 20, "\r\n\r\n a", " ", "\n", "é è", "́ combining",
    ]
    table_ = [(r[0], r[1], "x", "y") for r in rows if len(r[1] or "") < 100_000] + [(1000 + i, t, None, None) for i, t in enumerate(odd)]
    got, _ = compare_alignment(spark, table_, by_hand)
    zero = {r[0] for r in got if r[0] is not None and r[0] >= 1000 and r[1] == 0}
    assert zero == {1000 + odd.index("mark ▁ inside"), 1000 + odd.index("▁")}


def test_alignment_chunks(spark, by_hand):
    """Small chunks: sums still cover all rows; an empty table gives an empty one."""
    rng = np.random.default_rng(4)
    vocabulary = ["alpha", "beta,", "gamma's", "délta", "épsilon.", "0x1F", "zeta-eta", "θήτα"]
    texts = [" ".join(rng.choice(vocabulary, 30)) for _ in range(60)]
    _, chunks = compare_alignment(spark, [(i, t, "x", "y") for i, t in enumerate(texts)], by_hand, chunk_bytes=1)
    assert chunks == 3  # a batch each
    none = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and alignment.link_sums(none, alignment.told_pairs(none)).count() == 0


def test_aligned_overlaps():
    """Tokens that cross each other's ends share a group, and only overlapping ones are linked."""
    a_ends, b_ends = [2, 5, 6, 9], [3, 6, 9]
    assert alignment.groups_of(a_ends, b_ends) == ([3, 4], [2, 3])
    assert list(zip(*(x.tolist() for x in alignment.links_of(np.array(a_ends), np.array(b_ends))), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2)]


def brute_nearest(rows_, k=5):
    """All others by cosine, of rows (id, vector); distinct rows only."""
    usable = sorted({(i, tuple(v)) for i, v in rows_ if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in usable], np.float64)
    ids = np.array([i for i, _ in usable])
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x @ x[q]) / (norms * norms[q])
        others = np.flatnonzero(ids != ids[q])
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in others[np.lexsort((ids[others], -np.round(s[others], 12)))][:k]]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def recall(got, want):
    assert got.keys() == want.keys()
    assert all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_nearest_recall(spark, sf_dir):
    """Small blocks, so that rounds of introductions and the walk do the work: at least 0.9 of what brute force finds, scores exact."""
    table_ = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    want = brute_nearest([(r.vec_id, r.embedding) for r in table_.collect()])
    got = found(neighbours.nearest(table_, F.col("id") % 50 == 0, block=64, neighbours=20, sampled=10))
    assert recall(got, want) >= 0.9
    exact = {q: dict(brute_nearest([(r.vec_id, r.embedding) for r in table_.collect()], 10**6)[q]) for q in list(want)[:3]}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in exact for i, s in got[q])


def test_nearest_awkward(spark):
    """Nulls, zeros, non-finite components, other lengths, copies beyond k, ties, repeated rows and ids, a clashing column."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 8)).astype(np.float32).tolist()
    rows_ = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[3]) for i in range(20)] + [(200 + i, [2 * x for x in base[5]]) for i in range(3)]
    rows_ += [(50, base[7]), (50, base[7]), (150, base[3]), (None, base[0]), (300, None), (350, [0.0] * 8), (400, [*base[0][:7], None]), (450, [*base[0][:7], float("nan")]), (500, [*base[0][:7], float("inf")]), (550, base[0][:4]), (600, [-0.0, *base[9][1:]]), (650, [0.0, *base[9][1:]])]
    df = spark.createDataFrame([(*r, 0.0) for r in rows_], "vec_id long, embedding array<float>, score double").repartition(4)
    want = brute_nearest([r for r in rows_ if r[1] is None or len(r[1]) == 8])
    got = found(neighbours.nearest(df, F.col("id") % 50 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in v] for q, v in found(neighbours.nearest(few, F.col("id") % 50 == 0)).items()} == {0: [2, 1]}
    assert neighbours.nearest(few.where("vec_id < 0"), F.col("id") % 50 == 0).count() == 0


def test_search_of_new_vectors(spark, sf_dir):
    """Queries that are no rows of the table start from the common nodes only."""
    table_ = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index = neighbours.build(table_, block=64, neighbours=20, sampled=10)
    rng = np.random.default_rng(8)
    asked = rng.standard_normal((10, index.dimension)).astype(np.float32).tolist()
    queries = spark.createDataFrame([(i, v, None) for i, v in enumerate(asked)], "query long, embedding array<float>, start long")
    got = collections.defaultdict(dict)
    for r in neighbours.search(index, queries).collect():
        got[r["query"]][r.node] = r.score
    nodes = {r.node: np.array(r.embedding, np.float64) for r in index.nodes.collect()}
    hits = 0
    for q, v in enumerate(asked):
        s = {n: x @ np.array(v) / np.linalg.norm(x) / np.linalg.norm(v) for n, x in nodes.items()}
        hits += len(set(sorted(s, key=s.get)[-5:]) & set(sorted(got[q], key=got[q].get)[-5:]))
    assert hits >= 45


def test_walk_asks_blocks():
    """What queries want scored is a row per block of queries and block of nodes, not one per node; every pair comes back with its cosine."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    nodes, n, dimension, blocks = np.arange(5000, dtype=np.int64) * 7, 300, 16, 3
    vectors, asked = neighbours.coded(rng.standard_normal((len(nodes), dimension))), neighbours.coded(rng.standard_normal((n, dimension)))
    pending = [np.sort(rng.choice(nodes, 400, replace=False)) if q % 5 else nodes[:0] for q in range(n)]
    state = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n, dtype=np.int32) % 2), pa.array(np.arange(n)), neighbours._packed(asked), pa.array([p.tobytes() for p in pending], pa.binary())], names=["block", "query", "code", "pending"]
    )
    asks = pa.Table.from_batches(neighbours._asked(dimension, blocks)([state.slice(0, 150), state.slice(150)]))
    assert asks.num_rows <= 2 * 2 * blocks
    got, home = {}, neighbours.block_of(nodes, blocks)
    for b in range(blocks):
        mine = asks.filter(pa.compute.equal(asks["block"], b))
        graph = pa.table({"node": nodes[home == b], "code": neighbours._packed(vectors[home == b])})
        for r in neighbours._answered(dimension)((pa.scalar(b),), mine, graph).to_pylist():
            for q, w, s in zip(*[np.frombuffer(r[c], k).tolist() for c, k in (("query", np.int64), ("w", np.int64), ("s", np.float32))], strict=True):
                assert q % 2 == r["block"] and (q, w) not in got
                got[q, w] = s
    assert got.keys() == {(q, w) for q in range(n) for w in pending[q].tolist()}
    x, own = neighbours.directions(vectors), neighbours.directions(asked)
    assert all(abs(s - float(x[w // 7] @ own[q])) < 1e-5 for (q, w), s in got.items())


def test_introductions_need_blocks():
    """Members' vectors travel in one row per block that needs and block that holds them; each comes once, with its own vector and limit."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    nodes, dimension, blocks = np.arange(3000, dtype=np.int64) * 5, 16, 4
    vectors, kth, home = neighbours.coded(rng.standard_normal((len(nodes), dimension))), rng.random(len(nodes)).astype(np.float32), neighbours.block_of(nodes, blocks)
    lists = [[np.append(rng.choice(nodes, 2000), -1) for _ in range(blocks)] for _ in range(2)]
    table_ = pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), *[pa.array([x.tobytes() for x in y], pa.binary()) for y in lists]], names=["block", "fresh", "old"])
    needs = pa.Table.from_batches(neighbours._needed(blocks)([table_]))
    assert needs.num_rows <= blocks * blocks
    got = {b: [] for b in range(blocks)}
    for b in range(blocks):
        mine, at = needs.filter(pa.compute.equal(needs["block"], b)), np.flatnonzero(home == b)
        graph = pa.table({"node": nodes[at], "code": neighbours._packed(vectors[at]), "kth": kth[at]})
        for r in neighbours._sent(dimension)((pa.scalar(b),), mine, graph).to_pylist():
            node = np.frombuffer(r["node"], np.int64)
            assert (np.frombuffer(r["code"], np.uint8).reshape(-1, dimension + 4) == vectors[node // 5]).all() and (np.frombuffer(r["kth"], np.float32) == kth[node // 5]).all()
            got[r["block"]] += node.tolist()
    assert all(sorted(got[b]) == sorted({i for y in lists for i in y[b].tolist() if i >= 0}) for b in got)
