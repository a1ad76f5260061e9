"""Operators of the training-text subpackage against brute force, on rows that hold the awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftbase.llm import exact_dedup, language_id, lm_score, mixing, near_dup, packing, quality, suffix_dedup, token_files, warc
from siftbase.llm.tokens import VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size string, length string"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghéß"), rng.integers(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[10], near[70] = "changed", "Other"
    texts = [
        None, "", "   \n\t", "one", "one two three", "ONE two  three", base, base.upper(), base + " ", base, " ".join(near), base.replace(" ", "\n"),
        words(rng, 80) + " " + passage, passage + "\n" + words(rng, 90), "la la la " * 150, "12 34 !! 56", "日本語 テキスト 。 " * 30, words(rng, 30_000), "a\r\nb c　d 's it's <|endoftext|> x",
        "one",
    ]
    out = [(i, t, ["aa", "bb", None][i % 3], ["s", "t", None, "u"][i % 4], None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    out += [out[6], out[6], (None, base, "aa", "s", 1, None, None, None, None), (77, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def removed(texts):
    """Brute force of the repeated 200-byte strings: (n_bytes, n_removed, n_spans, sha of the rest)."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup(docs, rows, nothing):
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    want = sorted(((r[0], *w) for r, w in zip(rows, removed([r[1] for r in rows]), strict=True)), key=repr)
    assert got == want
    assert sum(r[2] for r in got) > 1000
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_overlaps(spark):
    """Shifted, overlapping and self-repeating strings, and multi-byte characters at their edges."""
    rng = np.random.default_rng(2)
    a, b = words(rng, 300), "é" * 150 + "xy" * 130
    texts = [a[:600], "q" + a[100:500] + "r", a[300:900], b, b[3:], "ab" * 300, "ab" * 99, "z" * 200, "z" * 201, a[0:199], a[400:600] + a[100:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == [(i, *w) for i, w in enumerate(removed(texts))]


def test_multikey_order():
    rng = np.random.default_rng(3)
    rows_ = [bytes(rng.integers(97, 99, 24, dtype=np.uint8)) if i % 3 else b"a" * 24 for i in range(300)]
    segment = rng.integers(0, 3, 300)
    table = np.frombuffer(b"".join(rows_), ">u8").reshape(300, 3).astype(np.uint64)
    order, common = suffix_dedup.multikey_order(table, segment)
    keys = [(segment[i], rows_[i]) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 300):
        (s, x), (t, y) = keys[k - 1], keys[k]
        assert common[k] == (-1 if s != t else next((i for i in range(24) if x[i] != y[i]), 24))


def test_exact_dedup(docs, rows, nothing):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[key(r[1])].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), math.inf if r[0] is None else r[0]))[0] for k, v in groups.items()}
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        k = key(r.text)
        assert (r.keep_id, r.group_size, r.text_sha256) == (best[k], len(groups[k]), hashlib.sha256(k.encode()).hexdigest())
        assert not r.kept or r.doc_id == r.keep_id
    assert collections.Counter(key(r.text) for r in got if r.kept) == {k: 1 for k in groups}
    assert exact_dedup.exact_dedup(nothing).count() == 0
    full = exact_dedup.exact_dedup(docs, max_filter_bytes=4096)  # a filter far too small changes no row
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    assert sorted(map(repr, full.select(*cols).collect())) == sorted(map(repr, exact_dedup.exact_dedup(docs).select(*cols).collect()))


def test_language_id(spark, docs, rows, nothing):
    df = spark.createDataFrame([(i, "the cat and this thing that" if i % 2 else "der hund und das ding ist", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = {r.text: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame([("that thing", "x"), ("das ist", "y"), (None, "z"), ("12 !", "w"), ("", "v"), ("é", "u")], "text string, score string"), model).collect()}
    assert got["that thing"][0] == "en" and got["das ist"][0] == "de" and got["é"][0] in ("de", "en")
    assert got[None] == got["12 !"] == got[""] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    told = language_id.identify(docs, language_id.train(docs))
    assert told.count() == len(rows) and told.columns.count("score") == 1
    empty = language_id.train(nothing)
    assert empty.languages == [] and {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_language_id_sums_every_ngram():
    model = language_id.Model(["x", "y"], np.log([0.5, 0.5]), np.random.default_rng(1).normal(size=(language_id.FEATURES, 2)).astype(np.float32))
    texts = ["abc", "", "éa", "z", "Hello wörld"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together = language_id.scores(np.frombuffer(data, np.uint8), offsets, model)
    for i, t in enumerate(texts):  # a row's score does not depend on its neighbours
        alone = language_id.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), model)
        assert np.allclose(together[i], alone[0], atol=1e-5)


def test_lm_scores(docs, rows, nothing):
    told = collections.Counter()
    tokens = []
    for r in rows:
        held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1
        t = WORD.findall((r[1] or "").translate(LOWER)) + [None]
        tokens.append((r[0], held, t))
        if not held:
            told.update(t)
    n, v = sum(told.values()), len(told)
    want = sorted(((i, h, len(t), sum(told[w] > 0 for w in t), n, round(sum(math.log10((told[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for i, h, t in tokens), key=repr)
    got = lm_score.lm_scores(docs).collect()
    assert sorted(((*r[:5], round(r.base_score, 4)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)
    assert lm_score.lm_scores(nothing).count() == 0


def test_lm_learns_from_all_training_rows(spark):
    from types import SimpleNamespace

    from siftbase.llm import attention as at
    from siftbase.llm.common import mixed

    rng = np.random.default_rng(8)
    ids = [i for i in range(200) if int(mixed(np.array([i], np.uint64))[0]) % 16 and zlib.crc32(str(i).encode()) % 5 != 1][:12] + [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    table = spark.createDataFrame([(i, words(rng, 40), h) for i, h in zip(ids, held, strict=True)], "doc_id long, text string, held_out boolean").repartition(2)
    chunks = table.mapInArrow(lm_score._chunks(12, VOCABULARY), lm_score._CHUNK).where("part = -1").cache()
    start = at.initial()
    p, vocab = lm_score.learned(chunks)
    assert not np.allclose(p["classes"], start["classes"])  # none of these ids is a sixteenth one
    batches = chunks.select("doc_ids", "ids", "lengths", "held").toArrow().to_batches()
    shared = SimpleNamespace(value=(start, vocab.of, vocab.share))
    learned = 0
    for r in range(lm_score.ROUNDS):
        for out in lm_score._local_training(shared, r, lm_score.ROUNDS)(iter(batches)):
            learned += out.column("value").to_numpy()[out.column("entry").to_numpy() < 0].sum()
    rows = [row for b in batches for row in b.to_pylist()]
    want = sum(int(n) for row in rows for n, h in zip(np.frombuffer(row["lengths"], "<u4"), row["held"], strict=True) if not h)
    assert learned == want  # each training id in one round


def test_attention_model():
    from siftbase.llm import attention as at

    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, 500).astype(np.uint16)
    offsets = np.array([0, 1, 1, 26, 74, 500])
    vocab = at.vocabulary(np.bincount(ids, minlength=400).astype(float))
    p = {k: v.astype(np.float64) for k, v in at.initial(3).items()}
    inputs, targets, counts = at.cut(ids, offsets)
    assert counts.sum() == 500 and sorted(targets[counts].tolist()) == sorted(ids.tolist())  # each id once
    classes = vocab.of[targets].astype(np.int64)
    _, g = at.gradients(p, inputs, classes, counts)
    for name in p:
        at_ = tuple(np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape))
        ends = []
        for e in (1e-4, -1e-4):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at_] += e
            ends.append(at.gradients(q, inputs, classes, counts)[0])
        assert abs((ends[0] - ends[1]) / 2e-4 - g[name][at_]) < 1e-6
    p32 = at.initial(3)
    logits, _ = at.forward(p32, inputs)
    assert np.allclose(logits, at.class_scores(p32, inputs), atol=1e-5)
    later = ids.copy()
    later[offsets[4] + 100 :] = 7  # the future changes no earlier score: causal
    a, b = (at.forward(p32, at.cut(x, offsets)[0])[0] for x in (ids, later))
    before = at.cut(np.arange(500, dtype=np.uint16), offsets)[1] <= offsets[4] + 100
    assert np.allclose(a[before & counts], b[before & counts], atol=1e-6)
    shares = 10.0 ** vocab.share
    assert np.allclose(np.bincount(vocab.of, shares), 1, atol=1e-4)  # probabilities of a class sum to one
    one = at.log10_probabilities(p32, vocab, ids, offsets, windows=3)
    assert np.allclose(one, at.log10_probabilities(p32, vocab, ids, offsets), atol=1e-3)
    ids = np.tile(np.arange(10, dtype=np.uint16), 600)
    offsets = np.arange(0, 6001, 300)
    vocab = at.vocabulary(np.bincount(ids, minlength=400).astype(float))
    p = at.initial()
    for seed in range(8):
        p = at.trained(p, vocab, ids, offsets, seed)
    assert at.log10_probabilities(p, vocab, ids, offsets).sum() > 0.7 * at.log10_probabilities(at.initial(), vocab, ids, offsets).sum()


def test_packing(docs, rows, nothing, tokenizer):
    got = packing.best_fit_packing(docs).collect()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        many = -(-len(ids) // 2048)
        first, at = len(ids) - (many - 1) * 2048, 0
        for k in range(many):
            n = first if k == 0 else 2048
            want[(r[0], k, at, n, zlib.crc32(ids[at : at + n]))] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)  # the lower bound
    assert packing.best_fit_packing(nothing).count() == 0


def test_genetic_packing_beats_best_fit():
    rng = np.random.default_rng(8)
    sizes, capacity = rng.integers(20, 60, 120), 100
    children = packing.evolve(sizes, capacity, 1, [], generations=30)
    loads = np.bincount(children[0], sizes)
    plain, _ = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)
    assert loads.max() <= capacity and len(loads) <= plain.max() + 1
    child = packing.crossover(plain, children[-1], sizes, capacity, rng)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= capacity
    assert len(np.unique(child)) == child.max() + 1


def test_mixing(spark, docs, rows, nothing):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    total, weights = sum(size.values()), {s: [1, 2, 3][i % 3] for i, s in enumerate([*sorted(s for s in size if s is not None), None])}
    want, free = {}, set(size)
    while True:  # reshare until no source is above its cap
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] > 3 * size[s]}
        if not above:
            break
        want |= {s: 3.0 * size[s] for s in above}
        free -= above
    want |= {s: level * weights[s] for s in free}
    by_id = {r[0]: r[3] for r in rows}
    for r in plan:
        assert math.isclose(r.target, want[by_id[r.doc_id]], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[by_id[r.doc_id]]
    assert collections.Counter(r._copies for r in mixing.mix_plan(docs).collect()) == collections.Counter(r._copies for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._copies for r in plan)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("source"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"))
    sums = {r.source: r for r in mixing.mix_plan(many).join(many.drop("text"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()}
    assert all(abs(r.n - r.t) <= 50 for r in sums.values())


def test_quality_counts(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (12, 1, 0), (14, 0, 0), (16, 0, 1), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        x = r.text or ""
        w, lines, dup = WORD.findall(x), set(), 0
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(again), failed)
        assert not (r.base_failed and r.kept)
    assert quality.judged(nothing, quality.fit(nothing, labels)).count() == 0
    assert all(r.kept or r.base_failed for r in quality.judged(docs, quality.fit(docs, labels.limit(0))).collect())


def test_quality_learns_from_every_label(spark):
    every = spark.range(100_060).withColumnRenamed("id", "doc_id")
    last = [r.doc_id for r in every.orderBy(F.xxhash64("doc_id").desc()).limit(60).collect()]
    bad = set(last[::2])
    rng = np.random.default_rng(7)
    texts = [(i, words(rng, 100).upper() if i in bad else words(rng, 100)) for i in last]
    labels = every.select("doc_id", F.when(F.col("doc_id").isin(*bad), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    verdict = quality.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert np.isfinite(verdict.threshold)


def test_quality_verdict(spark):
    rng = np.random.default_rng(6)
    data = [(i, words(rng, 100) if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 100).split())) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 75)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judged(df, quality.fit(df, labels)).collect()}
    assert sum(got[i] == (i % 3 > 0) for i in range(75, 150)) >= 70  # unseen rows


def test_warc(spark):
    long = "日本é<p>" * 9000
    pages = [(1, "http://a/ b\r\nX: y", long, "c"), (2, None, long, None), (3, "u", None, ""), (4, "u", "", ""), (5, "u", "short", ""), (6, "v", "short", ""), (7, "w", "x" * 999, ""), (8, "w", "x" * 999, ""),
             (9, "w", "y\r\n\r\nWARC/1.1\r\n" * 100, ""), (None, "n", "z" * 2000, ""), (10, "r", "q" * 3000, ""), (10, "r", "q" * 3000, ""), (None, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    got = sorted((tuple(r) for r in warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    largest = {}
    for p in pages:
        largest[p[2]] = max([x for x in (largest.get(p[2]), p[0]) if x is not None], default=None)
    want, seen = [], set()
    for p in pages:
        b = (p[2] or "").encode()
        again = len(b) >= 1000 and (p[0] != largest[p[2]] or p[2] in seen)
        seen |= {p[2]} if p[0] == largest[p[2]] else set()
        want.append((p[0], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", largest[p[2]] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archived(df.limit(0)).count() == 0
    assert warc.archived(df).where("error IS NOT NULL").count() == 0


def test_warc_damage(spark):
    """A lost segment, a wrong total and a broken chunk are told as errors."""
    import io

    payload = ("é" * 40_000).encode()
    records = warc.records_of(1, "u", payload, hashlib.sha1(payload).hexdigest(), "response", None)
    assert len(records) > 3
    whole = io.BytesIO(b"".join(r + warc.END.encode() for r in records))
    parsed = list(warc.parsed(whole))
    assert [h.get("warc-segment-number") for h, _ in parsed] == [str(i + 1) for i in range(len(records))]

    def read(rows):
        names = list(warc._FIELDS)
        df = spark.createDataFrame([(*[h.get(k) for k in names], bytearray(b)) for h, b in rows], warc._RECORD)
        schema = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, error string"
        return warc.reassembled(df).mapInArrow(warc._decoded, schema).collect()

    (good,) = read(parsed[::-1] + parsed[:1])
    assert bytes(good.payload) == payload and good.error is None
    (lost,) = read(parsed[:1] + parsed[2:])
    assert lost.error and lost.payload is None
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_token_files(docs, rows, nothing, tokenizer):
    files = token_files.write_token_files(docs)
    got = token_files.read_documents(files).collect()
    want, start = [], 0
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0]))
    for r in order:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert token_files.read_documents(token_files.write_token_files(nothing)).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8192, 8193, 40_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n) - 1, 50256).astype(np.uint16)
    lengths = np.array([n // 2, n - n // 2])
    data = token_files.encode(ids, lengths)
    back, sizes = token_files.decode(data)
    assert (back == ids).all() and sizes.tolist() == lengths.tolist()
    if n > 8192:
        assert (token_files.decode(data, [1])[0][: n - 8192][:8192] == ids[8192 : 2 * 8192]).all()  # one block alone
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.decode(bytes(broken))


def linked(texts):
    """Brute force: set sizes and, for every text, the smallest index that it reaches."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_near_duplicates(docs, rows, nothing):
    known = {r[0]: r[1] for r in rows if r[0] is not None}
    ids = sorted(known)
    n, label = linked([known[i] for i in ids])
    want = {i: (n[k], ids[label[k]]) for k, i in enumerate(ids)}
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(116, None)]
    assert near_dup.near_duplicates(nothing).count() == 0
    dropped = near_dup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    assert near_dup.without(docs, dropped).where("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("frequent", [64, 3])
def test_near_duplicates_at_all_sizes(spark, monkeypatch, frequent):
    """Texts of 1 to 400 words with few and many edits, a shared passage, and a large group round one text."""
    monkeypatch.setattr(near_dup, "FREQUENT", frequent)
    rng = np.random.default_rng(frequent)
    passage, texts = words(rng, 40).split(), []
    for n in [*range(1, 40), 60, 90, 150, 400]:
        base = words(rng, n).split()
        for edits in (0, 0, 1, 1, 2, 3, max(1, n // 40), max(1, n // 25)):
            other = list(base)
            for at in rng.integers(0, n, edits):
                other[at] = words(rng, 1) + "x"
            texts.append(" ".join(other if rng.random() < 0.7 else other[: max(1, n - edits)]))
        texts.append(" ".join(words(rng, n).split() + passage))
    hub = words(rng, 120).split()
    for _ in range(120):
        other = list(hub)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            other[at] = words(rng, 1) + "y"
        texts.append(" ".join(other))
    n, label = linked(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (n[i], label[i]) for i in range(len(texts))}


def test_buckets_have_content():
    """Distinct short texts without a common shingle meet nobody."""
    from siftbase.llm.common import Powers

    rng = np.random.default_rng(12)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), 9)) for _ in range(n)).encode() for n in range(1, 40) for _ in range(60)]
    h, offsets = near_dup.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), Powers())
    name, row, *_ = near_dup.index_entries(h, offsets, np.zeros(near_dup.COUNTERS, bool))
    _, count = np.unique(np.unique(np.stack([name, row.astype(np.uint64)]), axis=1)[0], return_counts=True)
    assert count.max() == 1


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups that share a passage, in buckets that are dealt in blocks of a few members."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = np.random.default_rng(21)
    texts = []
    for n in (9, 14, 30, 90):
        hub = words(rng, n).split()
        for _ in range(50):
            other = list(hub)
            for at in rng.integers(0, n, rng.integers(0, 1 + max(2, n // 15))):
                other[at] = words(rng, 1) + "z"
            texts.append(" ".join(other))
    n, label = linked(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (n[i], label[i]) for i in range(len(texts))}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (70, 100), (-5, 200)]
    rng = np.random.default_rng(1)
    rng.shuffle(chain)
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame([tuple(map(int, c)) for c in chain], "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50, -5: -5, 200: -5}


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        x, y = (near_dup.parity_sketches(s, np.array([0, len(s)]))[0] for s in (a, b))
        assert near_dup.sketch_difference(x, y) <= len(np.setxor1d(a, b))


def test_ids_are_those_of_the_tokenizer(tokenizer):
    from hypothesis import given, settings, strategies as st

    from siftbase.llm.tokens import Ids

    encoder = Ids(remembered=64)
    piece = st.sampled_from([" ", "\n", "a", "é", "×", "÷", "'s", "'", "ß", "12", "!", ",", " ", "　", "\t", "日", "word", " The", "\r\n", "<|endoftext|>", "\x85", "À", "."])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(piece, max_size=14).map("".join), min_size=1, max_size=5))
    def check(texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ids, at = encoder.rows(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_lm_scores_of_held_out_rows_beat_the_unigram(spark):
    rng = np.random.default_rng(12)
    lists = [[f"{c}{i}" for i in range(60)] for c in "xyz"]  # a text keeps to one list: context tells which
    told = [(i, " ".join(rng.choice(lists[i % 3], 60))) for i in range(3000)]
    for n, most in ((30, 1.005), (3000, 0.97)):  # with next to nothing to learn from it is the unigram
        docs = spark.createDataFrame(told[:n], "doc_id long, text string").coalesce(1)
        got = [r for r in lm_score.lm_scores(docs).collect() if r.held_out]
        assert got and all(math.isfinite(r.score) for r in got)
        assert sum(r.score for r in got) > most * sum(r.base_score for r in got)


def test_attention_predicts_cells():
    from siftbase.llm import attention as at

    rng = np.random.default_rng(5)
    ids = (rng.integers(0, 40, 900) ** 2).astype(np.uint16)
    offsets = np.array([0, 300, 900])
    vocab = at.vocabulary(np.bincount(ids, minlength=2000).astype(float))
    p = {k: v.astype(np.float64) for k, v in at.initial(3).items()}
    p["cells"] = rng.normal(0, 0.3, p["cells"].shape)
    inputs, targets, counts = at.cut(ids, offsets)
    classes, cells = vocab.of[targets].astype(np.int64), vocab.cell[targets]
    g = at.gradients(p, inputs, classes, counts, vocab, cells)[1]
    for name in p:
        at_ = tuple(np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape))
        ends = []
        for e in (1e-4, -1e-4):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at_] += e
            ends.append(at.gradients(q, inputs, classes, counts, vocab, cells)[0])
        assert abs((ends[0] - ends[1]) / 2e-4 - g[name][at_]) < 1e-5, name
    # after any context the probabilities of all ids sum to one, once classes without ids are out
    p["bias"][~np.isin(np.arange(at.CLASSES), vocab.of)] = -30
    head = ids[:5]
    every = np.concatenate([np.append(head, i) for i in range(2000)]).astype(np.uint16)
    with_next = at.log10_probabilities(p, vocab, every, np.arange(0, 12001, 6))
    assert abs((10.0 ** (with_next - at.log10_probabilities(p, vocab, head, np.array([0, 5]))[0])).sum() - 1) < 1e-3
