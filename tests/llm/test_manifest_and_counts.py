"""Fill-in-middle, token counts and the Merkle manifest against brute force, on awkward rows and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import string
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from fluxtape.llm import fill_in_middle, merkle, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, form string, doc string, g string, leaf string, root string, n_tokens int"
MODEL, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    bits = ["a", "Ab", "é", "漢", "😀", "\n", "\n\n", " ", "\t", "\r\n", "<", "P>", "\x01", "\x02", "\x021", "\x022", "$0", "\\", "▁", "\u0000", "the ", "12"]
    out = [(i, "".join(rng.choices(bits, k=rng.randint(0, 60))), rng.choice(["en", "en", "en", "de", None, "", "é"]), rng.choice(["s1", None]), rng.choice([i, None])) for i in range(150)]
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, "no\nid here", "en", "s2", 4), (None, None, None, None, None), (7, out[7][1], "en", "s1", 1)]
    out += [(210, "x<P>y\nz", "en", "s1", 1), (211, "<S>", "en", "s1", 1), (212, "a\nb<M>", "en", "s1", 1), (213, "one line", "one", "s1", 1), (214, "\n", "en", "s1", 1)]
    out += [(300, "Ab" * 40_000, "en", "s1", 2), (301, "line\n" * 20_000, "en", "s1", 3), *[(302, "Same Row", "hot", "s1", 1)] * 90, *[(None, "Same Row", "hot", None, 1)] * 40]
    return [(*r, 1, "f", "d", "g", "l", "r", 2) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def cut(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(part) for part in (units[:lo], units[lo:hi], units[hi:]))
    return (len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (60, 100)])
def test_fill_in_middle(docs, rows, rate, spm):
    done = fill_in_middle.fill_in_middle(docs, rate=rate, spm=spm)
    got = collections.Counter((r.doc.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.restored) for r in done.collect())
    assert got == collections.Counter((r[0], *cut(r[0], r[1] or "", rate, spm), r[1] or "") for r in rows)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_by_other_units_and_sentinels(spark):
    words = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(40)], "doc_id int, text string")
    done = fill_in_middle.fill_in_middle(words, units=r"\s*\S+", sentinels=("<|p|>", "<|s|>", "<|m|>"), seed="x").collect()
    assert all(r.n == r.doc.doc_id and r.restored == r.doc.text for r in done)
    assert all(r.prefix + r.middle + r.suffix == r.doc.text for r in done if r.form != "plain") and {r.form for r in done} == {"plain", "psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("<a<b>", "<c>", "<d>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(words, sentinels=bad)


def test_fill_in_middle_needs_no_python_worker(docs):
    plan = fill_in_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counts_equal_the_library(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = collections.Counter((r.doc_id, r.source, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, MODEL, keep=["doc_id", "source"]).collect())
    want = collections.Counter()
    for r in rows:
        n = len(library.encode(r[1] or ""))
        want[r[0], r[3], len((r[1] or "").encode()), n, n > 4096] += 1
    assert got == want
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_token_counts_of_ranked_bytes_equal_the_library(docs, rows):
    pattern = public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=token_counts.Ranked(RANKS, pattern).ranks, special_tokens={})
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, RANKS, pattern=pattern).collect())
    assert got == collections.Counter((r[0], len(library.encode_ordinary(r[1] or ""))) for r in rows)


def test_counts_of_random_texts(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    bits = ["a", "ab", "the", " ", "   ", "é", "ing", "\n", "漢", "<s>", "</s>", "<unk>", "▁", "\t", "12", "\u0000", "😀", "tion", "<0x0A>", "\xa0", " the", "Ａ", "ﬁ"]
    for short, listed, remembered in ((64, 1 << 20, 300_000), (3, 10, 5)):  # cut units, generators and forgotten units
        monkeypatch.setattr(token_counts, "SHORT", short)
        monkeypatch.setattr(token_counts, "LISTED", listed)
        monkeypatch.setattr(token_counts, "REMEMBERED", remembered)
        counts = token_counts.Pieces(MODEL)
        for _ in range(1500):
            text = "".join(rng.choices(bits, k=rng.randint(0, 60)))
            assert counts.count(text) == len(library.encode(text))
        for text in (" " * 999, "a" * 5001, "\n" * 99, "=-" * 999):
            assert counts.count(text) == len(library.encode(text))


def test_merging_takes_the_lowest_rank_and_leftmost_first():
    """Against looking at all pairs before every merge; ranks tie."""
    rng = random.Random(5)
    for _ in range(500):
        alphabet = "abc"
        ranks = {"".join(p): rng.randint(0, 9) for n in (2, 3, 4) for p in itertools.product(alphabet, repeat=n) if rng.random() < 0.4}
        symbols = rng.choices(alphabet, k=rng.randint(0, 25))
        weights = [rng.randint(1, 4) for _ in symbols]
        plain, worth = list(symbols), list(weights)
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a + b in ranks]:
            i = min(found)[1]
            plain[i : i + 2], worth[i : i + 2] = [plain[i] + plain[i + 1]], [1]
        assert token_counts.merged(symbols, ranks) == len(plain) and token_counts.merged(symbols, ranks, weights) == sum(worth)


def tree(leaves):
    """Root, and for each leaf its siblings by level with the leaf's place among them."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        runs = [leaves[i : i + 8] for i in range(0, len(leaves), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            proofs[k].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            at[k] = i // 8
        leaves = [sha("".join(run)) for run in runs]
    return leaves[0], proofs


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proven(rows, changed):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    groups = collections.defaultdict(list)
    for r in rows:
        leaf, shown = (sha("".join(map(field, (r[0], r[3], r[2], r[4], t)))) for t in (r[1], changed(r)))
        groups[r[2]].append((r[0], leaf, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([leaf for _, leaf, _ in groups[g]]))
    root, above = tree([t[0] for t in trees])
    out = collections.Counter()
    for g, (subroot, proofs), upper in zip(names, trees, above):
        for (doc_id, leaf, shown), own in zip(groups[g], proofs):
            steps = own + upper
            folded = shown
            for place, siblings in steps:
                folded = sha("".join([*siblings[:place], folded, *siblings[place:]]))
            out[doc_id, leaf, subroot, root, sha("".join(s for _, run in steps for s in run)), folded, folded == root] += 1
    return out


def lowered(r):
    tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    return r[1] and r[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) if tampered else r[1]


# one partition; ranges of a few rows; chunks of one run, which climb several rounds
@pytest.mark.parametrize(("rows_", "few", "chunk", "climb"), [(1 << 18, 1 << 11, 4, 3), (9, 4, 2, 1), (1, 1, 1, 2), (20, 1, 0, 1)])
def test_merkle_manifest(docs, rows, rows_, few, chunk, climb, monkeypatch):
    for name, value in (("ROWS", rows_), ("FEW", few), ("CHUNK", chunk), ("CLIMB", climb)):
        monkeypatch.setattr(merkle, name, value)
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    done = merkle.manifest(docs, presented={"text": F.when(drawn, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))}, proofs=True).collect()
    assert collections.Counter(tuple(r)[:7] for r in done) == proven(rows, lowered)
    for r in done:
        assert merkle.fold(r.leaf, [(s.place, s.siblings) for s in r.proof]) == r.root
        assert sha("".join(x for s in r.proof for x in s.siblings)) == r.proof_sha256
    assert {r.verified for r in done} == {True, False}


def test_merkle_manifest_of_few_rows(spark, docs, rows):
    assert merkle.manifest(docs.limit(0)).count() == 0
    for n in (1, 2, 8, 9):
        some = [r for r in rows if r[0] is not None and r[0] < 150][:n]
        got = collections.Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(some, SCHEMA)).collect())
        assert got == proven(some, lambda r: r[1])


def test_merkle_manifest_of_very_many_groups(spark, monkeypatch):
    """Subroots are a tree of several partitions, too; a group for every row or two."""
    monkeypatch.setattr(merkle, "ROWS", 50)
    monkeypatch.setattr(merkle, "CHUNK", 1)
    many = [(i, f"T{i}", f"g{i // 3 * 2 % 317}", "s", i) for i in range(900)]
    frame = spark.createDataFrame(many, "doc_id int, text string, lang string, source string, n_chars int")
    assert collections.Counter(tuple(r) for r in merkle.manifest(frame).collect()) == proven(many, lambda r: r[1])
