"""Every operator on awkward rows and on empty tables, and against brute force."""

import collections
import functools
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from fluxtape.llm import bpe, induced, line_rules, mixing, ppm, quality, sharding, similar, simhash, suffix_dedup, topk, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, spans int, doc string, fp int, h string"
TABLES = "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(text):
    return text.encode().lower().split()


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    passage = "".join(random.choice("abcde fghi\n") for _ in range(900))
    out = [(i, " ".join("".join(random.choices("abcdeé", k=random.randint(1, 6))) for _ in range(random.randint(0, 150))), random.choice(["en", "de", None]), random.choice(["s1", "s2", None])) for i in range(60)]
    out += [(100 + i, f"{random.random()} {passage[i * 10:]} x{i}", "en", "s1") for i in range(12)]
    out += [(200, None, None, None), (201, "", "en", "s1"), (None, "no id here", "en", "s2"), (None, None, None, None), (7, out[7][1], "en", "s1"), out[3], out[3]]
    out += [(300, "Ab" * 40_000, "en", "s1"), (301, " \n\t ", "en", "s1"), (302, "one two", "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1]), "k", 1, "d", 2, "h") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], None, 1 if r[0] and r[0] % 9 == 0 else 0) for r in rows[:50]], "doc_id bigint, quality int, toxic int")


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    assert simhash.near_duplicate_classes(none).count() == 0
    assert similar.similar_classes(none).count() == 0
    assert topk.exact_top_k(none.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), F.lit(True)).count() == 0
    assert quality.weak_label_quality(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert bpe.token_digests(none, PATH, PATTERN).count() == 0
    assert line_rules.line_frequency_rules(none).count() == 0
    assert ppm.language_scores(none).count() == 0
    assert sharding.stratified_shards(none).count() == 0


def test_simhash_components(docs, rows):
    got = simhash.near_duplicate_classes(docs).collect()

    def fingerprint(text):
        ws = words(text or "")
        shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((r[0], f"{fingerprint(r[1]):016x}") for r in rows)
    groups = [({int(r.fingerprint, 16)}, {r.doc_id}) for r in got]
    merged = []
    for fps, ids in groups:
        near = [g for g in merged if any((a ^ b).bit_count() <= 2 for a in fps for b in g[0])]
        merged = [g for g in merged if g not in near] + [(fps.union(*(g[0] for g in near)), ids.union(*(g[1] for g in near)))]
    for r in got:
        own = next(g for g in merged if int(r.fingerprint, 16) in g[0])
        assert r.component_id == min((i for i in own[1] if i is not None), default=None)


def test_simhash_crowded_values(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    random.seed(2)
    fps = {random.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:10]:
        fps |= {f ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    from fluxtape.llm.components import connected_components

    got = {r.node: r.root for r in connected_components(edges).collect()}
    root = {f: f for f in signed}
    while True:
        new = {a: min(root[b] for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2) for a in signed}
        if new == root:
            break
        root = new
    linked = {a for a in signed if any(a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for b in signed)}
    assert got == {a: root[a] for a in linked}


def test_similar_classes(spark, monkeypatch):
    monkeypatch.setattr(similar, "PAIRED", 4)  # groups go past it
    monkeypatch.setattr(similar, "LEADERS", 1)  # and past those linked to a leader
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(3)
    texts = []
    ends = [f"u{i}" for i in range(200)]  # two groups around texts of similarity 0.7, which share band values
    for part in (ends[:164] + ["x"] * 3, ends[36:] + ["y"] * 3):
        texts += [" ".join([*part, *(f"z{rng.randrange(10**6)}" for _ in range(k % 3))]) for k in range(30)]
    texts += [" ".join(ends[i : i + 150]) for i in range(0, 50, 6)]  # a chain whose ends are far apart
    for size in (1, 1, 2, 3, 12, 40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(f"v{rng.randrange(10**6)}" if rng.random() < (0.012 if k else 0) else w for w in base) for k in range(size)]
    texts += ["", None, "one two", texts[3], texts[3].upper() + " "]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, texts[4], "a", "b")], "doc_id bigint, text string, fp string, bands string")
    got = {r.doc_id: r.component_id for r in similar.similar_classes(docs).collect()}

    def shingles(text):
        ws = words(text or "")
        return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets, low = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    assert [got[i] for i in range(len(texts))] == low
    assert got[None] == low[4]


def test_equal_fingerprints_of_different_sets_are_not_one_class(spark):
    rng = random.Random(4)
    texts = ["same three words\n" * 200 + " ".join(f"v{rng.randrange(10**6)}" for _ in range(50)) for _ in range(25)]
    got = similar.similar_classes(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id bigint, text string")).collect()
    assert len({r.fingerprint for r in got}) == 1
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(25)}, 25: 0}


def test_thresholds_cover_the_distance():
    """The dynamic program finds the cheapest thresholds that any two fingerprints within the distance must meet."""
    rng = random.Random(7)
    for _ in range(50):
        parts, budget = rng.randint(1, 4), rng.randint(1, 4)
        costs = [[0, *(rng.randint(1, 50) for _ in range(4))] for _ in range(parts)]
        cost, found = simhash.allocate(costs, budget)
        every = [t for t in itertools.product(range(-1, 4), repeat=parts) if sum(x + 1 for x in t) == budget]
        assert sum(x + 1 for x in found) == budget and cost == sum(costs[i][t + 1] for i, t in enumerate(found)) == min(sum(costs[i][x + 1] for i, x in enumerate(t)) for t in every)
    for t in ((0, 1, -1), (2, -1, -1), (0, 0, 0)):  # two bits anywhere: some part has no more than its threshold
        for bits in itertools.product(range(3), repeat=2):
            assert any(bits.count(i) <= x for i, x in enumerate(t))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE", 64)
    monkeypatch.setattr(topk, "FLOOR_ROWS", 20)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 7]) for i in range(300)]
    data += [(400, None), (401, [0.5, None]), (402, [float("nan")] * 8), (403, [1.0, 2.0]), (404, [3.0, -1.0]), (None, [0.1] * 8), (10, data[10][1])]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    for block in (4096, 7):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(frame, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 403), k=5).collect())
        clean = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
        want = []
        for q, v in {i: v for i, v in clean if i % 10 == 0 or i == 403}.items():
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v)))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
        assert got == sorted(want)


@pytest.mark.parametrize("step", [4096, 6])
@pytest.mark.parametrize("options", [{}, {"base": 2, "memory": 5, "block": 3}, {"base": 2, "memory": 1000, "block": 100}])
def test_suffix_sorting_in_memory_and_on_disk(options, step, monkeypatch):
    """Order and common prefixes equal sorting, with names sorted in memory or in turn, queues in memory or on disk."""
    monkeypatch.setattr(induced, "STEP", step)
    monkeypatch.setattr(induced, "LEAST", 2)
    random.seed(5)
    for _ in range(400):
        unit = [random.randint(1, random.choice([1, 2, 3, 50])) for _ in range(random.randint(0, 50))]
        text = unit + unit[: random.randint(0, len(unit))] + [0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            common.append(k)
        got = induced.sort_suffixes(np.array(text, np.int32), 10**6, **options)
        assert (list(got[0]), list(got[1])) == (order, common)


def test_a_long_text_is_sorted_on_disk():
    """A shard far larger than the memory of its sort: names are sorted in turn and queues spill."""
    rng = random.Random(9)
    words_ = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(300)]
    data = " ".join(rng.choices(words_, k=40_000)).encode()
    data += data[5_000:9_000] + data[100:700] + data[-300:]
    text = np.append(np.frombuffer(data, np.uint8).astype(np.int16) + 2, np.int16(0))
    disk = []
    made = induced.Disk
    try:
        induced.Disk = lambda *a: disk.append(made(*a)) or disk[-1]
        hit = induced.repeated(text, 100, memory=1000, base=500, block=4096)
    finally:
        induced.Disk = made
    seen = collections.Counter(data[i : i + 100] for i in range(len(data) - 99))
    want = [seen[data[i : i + 100]] > 1 for i in range(len(data) - 99)]
    assert hit[: len(want)].tolist() == want
    assert len(disk) > 2 and disk[0].spilled > len(text) // 2


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeats_are_removed(docs, rows, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    got = collections.Counter((r.doc.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, 400).collect())
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = collections.Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[r[0], len(t), int(gone.sum()), int((np.diff(np.r_[0, gone, 0]) == 1).sum()), kept] += 1
    assert got == want


def test_snippets_of_a_crowded_hash_are_not_dealt_by_it(docs, monkeypatch):
    """Whether a snippet's hash is crowded is looked up in a small table: one task does not get all snippets of a hash."""
    plans, made = {}, suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or made(df, name))
    assert suffix_dedup.remove_repeats(docs, 400).where("n_removed > 0").count() and "crowded" in plans
    assert "wants" in plans["cut"] and "hashpartitioning(h#" not in plans["cut"]


def test_bpe_equals_the_library(docs, rows):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, PATH, PATTERN).collect())
    want = collections.Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    coder = bpe.codec(PATH, PATTERN)
    random.seed(1)
    for k in range(500):
        text = "".join(random.choice(["a", "ab", "the", "é", "ing", "x", "漢", "er", "in", "tion"]) for _ in range(random.randint(1, 150)))
        text = random.choice("a=-_ ") * random.randint(1, 700) if k % 3 == 0 else text
        assert coder.encode(text) == library.encode_ordinary(text)
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert collections.Counter(bytes(r.data) for r in back.collect()) == collections.Counter((r[1] or "").encode() for r in rows)


@pytest.mark.parametrize("window_hash", [line_rules.WINDOW_HASH, "shiftleft(cast(length(get(ws, i)) as bigint), 50)"])
def test_line_rules(docs, rows, window_hash, monkeypatch):
    """Also where many windows have one hash."""
    monkeypatch.setattr(line_rules, "WINDOW_HASH", window_hash)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules.line_frequency_rules(docs).collect()}
    want = set()
    for r in rows:
        text = r[1] or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
        wins = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        hit = {j for i in range(len(ws) - 2) if wins[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want.add((r[0], len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)))
    assert got == want


def test_line_rules_reject_documents_of_common_lines(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    common = " ".join(f"c{j}" for j in range(60))
    frame = spark.createDataFrame([(i, common if i < 30 else own(i) + "\n" + common if i < 40 else own(i), "h") for i in range(50)], "doc_id int, text string, source string")
    kept = {r.doc_id for r in line_rules.line_frequency_rules(frame).where("kept").collect()}
    assert kept == set(range(30, 50))


def test_line_rules_return_texts_without_common_lines(spark):
    texts = [f"\n  Common   LINE\nown {i} a b\n\ncommon line" if i < 30 else f"own {i}\n" for i in range(40)]
    got = line_rules.line_frequency_rules(spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id int, text string, source string")).collect()
    want = {i: f"\nown {i} a b\n" if i < 30 else t for i, t in enumerate(texts)}
    assert {r.doc_id: r.text_left for r in got} == want
    assert all(r.n_words_left == len(want[r.doc_id].split()) for r in got)


def test_language_scores(docs, rows):
    got = ppm.language_scores(docs).collect()
    counts = collections.Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            counts.update(words(r[1] or ""))
            counts[b"\n"] += 1
    total, bottom = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = collections.Counter()
    for r in rows:
        tokens = [*words(r[1] or ""), b"\n"]
        want[r[0], len(tokens), sum(counts[w] > 0 for w in tokens), round(sum(math.log10((counts[w] + 0.5) / bottom) for w in tokens), 5)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)


def test_language_scores_use_every_count(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ppm, "GRAMS", 30)  # the rest is looked up in the table
    monkeypatch.setattr(ppm, "HELD", 100)
    forms = [b"\n" * 5 + b" ".join(words(r[1] or "")) + b"\n" for r in rows]
    trie = collections.defaultdict(collections.Counter)
    for r, form in zip(rows, forms):
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            for i in range(5, len(form)):
                for k in range(6):
                    trie[form[i - k : i]][form[i]] += 1

    @functools.cache
    def cost(string):
        barred, total = set(), 0.0
        for k in range(5, -1, -1):
            seen = {s: c for s, c in trie.get(string[5 - k : 5], {}).items() if s not in barred}
            if seen:
                bottom = sum(seen.values())
                if string[5] in seen:
                    return total + math.log10((seen[string[5]] - 0.5) / bottom)
                total, barred = total + math.log10(len(seen) / 2 / bottom), barred | seen.keys()
        return total - math.log10(256 - len(barred))

    want = collections.Counter((r[0], round(sum(cost(f[i - 5 : i + 1]) for i in range(5, len(f))), 4)) for r, f in zip(rows, forms))
    assert collections.Counter((r.doc_id, round(r.score, 4)) for r in ppm.language_scores(docs).collect()) == want


def test_byte_probabilities_add_up():
    grams, counts = ppm._gram_counts([b"the cat sat on the mat", b"the hat", "é".encode()])
    levels = []
    for order in range(ppm.ORDER + 1):
        levels.append(ppm.Level(grams, counts, order, levels[-1] if levels else None))
    for context in {int(g) >> 8 for g in grams} | {0, int.from_bytes(b"zzzth", "big")}:
        p = 10 ** ppm.log_probabilities(np.uint64(context << 8) + np.arange(256, dtype=np.uint64), levels)
        assert p.sum() == pytest.approx(1) and (p > 0).all()
    assert ppm.adaptive_score(b"abababababababab") > ppm.adaptive_score(b"abqzcmwpxkdoeitu")


def test_sharding(docs, rows):
    got = sharding.stratified_shards(docs, shards=7).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(7)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_shards_have_the_mixture_of_the_whole(spark, tmp_path, monkeypatch):
    """Against ranking everything at once; a third of all rows are equal and without an id."""
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 20)
    data = [(None, "same text", "hot")] * 400 + [(i, f"text {i}", "hot" if i % 3 else "b" if i % 2 else None) for i in range(800)]
    frame = spark.createDataFrame(data, "doc_id int, text string, source string").repartition(5)
    got = sharding.stratified_shards(frame, shards=8, carry=True).collect()
    assert collections.Counter((r.doc.doc_id, r.doc.text) for r in got) == collections.Counter((d, t) for d, t, _ in data)
    sources = collections.Counter(s for _, _, s in data)
    for shard in range(8):
        own = collections.Counter(r.doc.source for r in got if r.shard == shard)
        assert sum(own.values()) == 150 and all(abs(own[s] - n / 8) <= len(sources) for s, n in sources.items())
    place = {(r.shard, r.slot): r for r in got}
    ranks = collections.Counter()
    last = 0.0
    for at in sorted(place):  # the order of the whole is that of fractional ranks within sources
        source = place[at].doc.source
        ranks[source] += 1
        fraction = (2 * ranks[source] - 1) / (2 * sources[source])
        assert fraction >= last - 1e-12
        last = fraction
    again = {r.doc.doc_id: (r.shard, r.slot) for r in sharding.stratified_shards(frame.repartition(2), shards=8, carry=True).collect() if r.doc.doc_id is not None and r.doc.source != "hot"}
    assert again == {r.doc.doc_id: at for at, r in place.items() if r.doc.doc_id is not None and r.doc.source != "hot"}
    sharding.write_shards(frame, f"{tmp_path}/shards", shards=8)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {r["count"] for r in back.groupBy("_shard").count().collect()} == {150} and set(back.columns) == {"doc_id", "text", "source", "_shard"}


def test_weak_labels_equal_plain_expectation_maximisation():
    """Votes of simulated labellers: their accuracies are found, and each step is that of the textbook."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.6
    right = np.array([0.9, 0.8, 0.75, 0.7, 0.85, 0.65])
    votes_ = np.where(rng.random((4000, 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes_[rng.random((4000, 6)) < 0.2] = -1
    patterns, counts = np.unique(votes_, axis=0, return_counts=True)
    model = quality.Labellers(patterns, counts.astype(float))
    share, p = 0.7, {(j, y, v): x for j in range(6) for y, row in ((0, (0.5, 0.2, 0.3)), (1, (0.1, 0.6, 0.3))) for v, x in zip((0, 1, -1), row)}

    def good(row):
        a, b = share, 1 - share
        for j, v in enumerate(row):
            a, b = a * p[j, 1, v], b * p[j, 0, v]
        return a / (a + b)

    for _ in range(60):
        each = [good(row) for row in patterns.tolist()]
        share = sum(g * n for g, n in zip(each, counts)) / counts.sum()
        for j, y, v in list(p):
            part = [(g if y else 1 - g) * n for g, n in zip(each, counts)]
            p[j, y, v] = (sum(x for x, row in zip(part, patterns) if row[j] == v) + 1) / (sum(part) + 3)
    assert model.share == pytest.approx(share) and model.posterior(patterns) == pytest.approx([good(r) for r in patterns.tolist()])
    assert abs(model.share - truth.mean()) < 0.03 and np.mean((model.posterior(votes_) > 0.5) == truth) > 0.9
    found = model.p[:, 1, 1] / (model.p[:, 1, 0] + model.p[:, 1, 1])
    assert np.abs(found - right).max() < 0.05


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables of the driver are not here")
def test_quality_ranks_rows_of_the_tables(spark):
    """The labels were never seen by the heuristics or the scorer."""
    known = spark.read.parquet(f"{TABLES}/labels.parquet").where("quality IS NOT NULL")
    rows = quality.weak_label_quality(spark.read.parquet(f"{TABLES}/documents.parquet")).join(known, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85


def test_mixing_reaches_the_targets(spark):
    frame = spark.createDataFrame([(i, "x" * 400, "en" if i % 3 else "de", "a" if i % 4 else "b") for i in range(4000)], "doc_id int, text string, lang string, source string")
    cells = mixing.raked_cells(mixing._placed(frame, mixing.TOPIC_SQL), {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}, rounds=20).collect()
    whole = sum(c.w for c in cells)
    assert sum(c.w for c in cells if c.source_ == "a") / whole == pytest.approx(0.5, abs=1e-3)
    assert sum(c.w for c in cells if c.lang_ == "de") / whole == pytest.approx(0.5, abs=1e-3)
    drawn = mixing.mixed(frame, {"source": {"a": 0.5, "b": 0.5}}, budget=0.4).where("drawn_").groupBy("source_").count().collect()
    counts = {r.source_: r["count"] for r in drawn}
    assert counts["a"] / counts["b"] == pytest.approx(1, abs=0.2)


def test_mixing_draws_the_raked_shares(spark):
    texts = {"prose": "x" * 400, "markup": "=" * 400}
    frame = spark.createDataFrame([(i, texts["prose" if i % 90 else "markup"], "en" if i % 7 else "de", "a" if i % 5 else "b") for i in range(9000)], "doc_id int, text string, lang string, source string")
    cells = mixing.raked_cells(mixing._placed(frame, mixing.TOPIC_SQL)).collect()
    rows = mixing.mixed(frame).select("source_", "lang_", "topic_", "tokens_", "p_").collect()
    kept = sum(r.tokens_ * r.p_ for r in rows)
    assert kept <= mixing.BUDGET * sum(r.tokens_ for r in rows) and max(r.p_ for r in rows) <= 1 + 1e-9
    for d in ("source_", "lang_", "topic_"):
        for member in {c[d] for c in cells}:
            goal = sum(c.w for c in cells if c[d] == member) / sum(c.w for c in cells)
            assert sum(r.tokens_ * r.p_ for r in rows if r[d] == member) / kept == pytest.approx(goal, rel=1e-6)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables of the driver are not here")
def test_mixing_reaches_its_targets_on_the_tables(spark):
    """Production parameters: the expected tokens have the target share of each member within one percent."""
    rows = mixing.mixed(spark.read.parquet(f"{TABLES}/documents.parquet")).select("source_", "lang_", "topic_", "tokens_", "p_").collect()
    kept = sum(r.tokens_ * r.p_ for r in rows)
    assert max(r.p_ for r in rows) <= 1 + 1e-9
    for d in mixing.DIMENSIONS:
        own = collections.Counter()
        for r in rows:
            own[r[f"{d}_"]] += r.tokens_
        goal = {k: v ** mixing.FLATTEN[d] for k, v in own.items()}
        for member, g in goal.items():
            share = sum(r.tokens_ * r.p_ for r in rows if r[f"{d}_"] == member) / kept
            assert share == pytest.approx(g / sum(goal.values()), rel=0.01)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables of the driver are not here")
def test_toxicity_ranks_held_out_rows_of_the_tables(spark):
    known = spark.read.parquet(f"{TABLES}/labels.parquet")
    done = toxicity.toxicity(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text"), known).where("held_out")
    rows = done.select("doc.doc_id", "score").join(known, "doc_id").select("score", "toxic").collect()
    bad, fine = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(b > f) + (b == f) / 2 for b in bad for f in fine]) > 0.9


def test_awkward_rows_are_scored(docs, rows, labels):
    assert mixing.mixed(docs).count() == len(rows)
    scored = toxicity.toxicity(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    assert quality.weak_label_quality(docs).count() == len(rows)


def test_toxicity_on_held_out_rows(spark):
    random.seed(6)
    bad, plain = ["vile", "rotten"], [f"w{i}" for i in range(300)]
    data = []
    for i in range(900):
        ws = random.choices(plain, k=40)
        if i % 8 == 0:
            ws[5] = ws[20] = random.choice(bad)
        data.append((i, " ".join(ws), int(i % 8 == 0)))
    frame = spark.createDataFrame(data, "doc_id int, text string, toxic int")
    held = [r for r in toxicity.toxicity(frame.select("doc_id", "text"), frame.where("doc_id % 2 = 0").select("doc_id", "toxic")).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc.doc_id % 8 == 0) for r in held]) > 0.95


CLASHING = ["tokens_", "source_", "lang_", "topic_", "key_", "g_", "p_", "drawn_", "doc", "key", "did", "k1", "k2", "fp", "times", "kept", "spans", "own", "score", "predicted", "held_out", "toxic"]


def test_pipeline_stages_on_awkward_rows(spark, docs, rows, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, an empty table and clashing names."""
    import corpus_pipeline

    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 1), (7, None, None), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = base.select("*", *(F.lit("c").alias(c) for c in CLASHING))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        for frame in (base, wide):
            out = stage(spark, frame, str(tmp_path))
            if name != "byte-level BPE":
                assert out.columns == frame.columns
            assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
            kept[name, len(frame.columns)] = out.collect()
        assert len(kept[name, 5]) == len(kept[name, 5 + len(CLASHING)])
    assert len(kept["suffix-array dedup", 5]) == len(kept["byte-level BPE", 5]) == len(rows)
    once = kept["SimHash near-dedup", 5]
    texts = collections.Counter(r.text for r in once)
    assert max(texts.values()) == 1 and len([r for r in once if r.doc_id is None]) == 1
    assert {r.doc_id for r in once if not words(r.text or "")} == {200}  # null and wordless texts are one class


def test_near_dedup_keeps_one_row_of_each_class(spark):
    """A doc_id on two rows does not save the row that is a near copy of another document."""
    rng = random.Random(2)
    b, o = (" ".join(rng.choices("abcdefghijklmnop", k=300)) for _ in range(2))
    frame = spark.createDataFrame([(3, b), (7, b + " end"), (7, o), (7, o)], "doc_id int, text string")
    assert sorted((r.doc_id, r.text) for r in similar.one_of_each(frame).collect()) == [(3, b), (7, o)]


def test_near_dedup_finds_all_similar_pairs(spark):
    """Classes equal those of all pairs of five-word shingle sets of a similarity of 0.8 or more."""
    rng = random.Random(12)
    data = []
    for _ in range(25):
        base_ = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 200))]
        data.append(" ".join(base_))
        for _ in range(3):
            near = list(base_)
            for _ in range(rng.randint(0, max(1, len(near) // 30))):
                near[rng.randrange(len(near))] = f"x{rng.randrange(9)}"
            data.append(" ".join(near))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in data]
    low = list(range(len(data)))
    for _ in data:
        for i in range(len(data)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if all(low[low[i]] == low[i] for i in range(len(data))):
            break
    got = {r.doc_id: r.component_id for r in similar.similar_classes(spark.createDataFrame(list(enumerate(data)), "doc_id int, text string")).collect()}
    assert got == dict(enumerate(low)) and 25 < len(set(low)) < 100


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 50 < out.count() <= 200 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
