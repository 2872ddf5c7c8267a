import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from icuflow.llm import alignment
from icuflow.llm.alignment import Tokenizers, align, align_tokens, encoder, groups_written, inverted_index, link_postings, pair_code, pair_counts

A = Tokenizer.from_file(Tokenizers().a)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=Tokenizers().b)
BYTES_A = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
TEXTS = [
    "The cat sat.", "", None, " ", "  two  blanks ", "Überprüfung naïve 中文字符 😀😀", "a▁b", "<|endoftext|> <s> </s>", "tab\tand\r\nlines\n\n", " x",
    "antidisestablishmentarianism" * 3, "The cat sat.", "ﬁne ½", "zero\x00byte", "�", "é", "x" * 700, "0x1F 3.14159 %%% $$$",
]


def plain(text):
    """(ids of A, ids of B, groups) by the definition."""
    if not text:
        return [], [], []
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    pieces_a = [BYTES_A[i] for i in ids_a]
    pieces_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in ids_b)]
    if b"".join(pieces_a) != (" " + text).encode() or b"".join(pieces_b) != (" " + text).encode():
        return [], [], []

    def ends(pieces):
        at, out = 0, []
        for p in pieces:
            at += len(p)
            out.append(at)
        return out
    ends_a, ends_b = ends(pieces_a), ends(pieces_b)
    groups, start = [], 0
    for cut in sorted({*ends_a} & {*ends_b}):
        groups.append(([i for i, e in zip(ids_a, ends_a) if start < e <= cut], [i for i, e in zip(ids_b, ends_b) if start < e <= cut]))
        start = cut
    return ids_a, ids_b, groups


def brute(texts):
    found = [plain(t) for t in texts]
    links = [[(a, b) for x, y in groups for a in x for b in y] for _, _, groups in found]
    count = Counter(p for one in links for p in set(one))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (ids_a, ids_b, groups), mine in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(mine), text, sum(count[p] == most[p[0]] for p in mine), sum(count[p] for p in mine)))
    return out, count, Counter(p for one in links for p in one)


def test_align_equals_definition_over_many_blocks(spark):
    random.seed(4)
    words = "the of Überprüfung cat sat naïve extraordinary 中文 123 re-entry !!! token".split()
    texts = TEXTS + [" ".join(random.choices(words, k=random.randint(1, 40))) for _ in range(150)]
    want, count, links = brute(texts)
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, block int").repartition(5)
    for digest in (False, True):
        got = {r.doc_id: tuple(r)[1:] for r in align(docs, digest=digest).collect()}
        for i, w in enumerate(want):
            groups = hashlib.sha256(w[4].encode()).hexdigest() if digest and w[4] else w[4]
            assert got[i] == (*w[:4], groups, *w[5:]), (i, texts[i])
    counted = pair_counts(inverted_index(docs)).collect()
    assert {(r.a, r.b): (r.docs, r.links) for r in counted} == {p: (count[p], links[p]) for p in count}


def test_frequent_pairs_are_bits(spark):
    texts = ["the cat the cat the"] * 700 + ["the dog"] * 300 + ["dog"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    index = inverted_index(docs)
    assert index.where("dense").count() and index.where("dense and docs is null").count()  # documents, and a plane of further links
    want = brute(["the cat the cat the", "the dog", "dog"])
    got = {r.doc_id: tuple(r)[1:5] for r in align(docs).collect()}
    assert [got[0], got[700], got[1000]] == [w[:4] for w in want[0]]
    every = brute(texts[:1] * 700 + texts[700:701] * 300 + texts[1000:])[0]
    assert {i: tuple(r)[1:] for i, r in enumerate(sorted(align(docs).collect()))} == dict(enumerate(every))


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (3, None), (3, "the")], "doc_id long, text string")
    got = align(docs).collect()
    assert sorted((r.doc_id is None, r.n_a, r.n_links) for r in got) == [(False, 0, 0), (False, 1, 1), (True, 2, 2), (True, 2, 2)]
    assert align(docs.where("doc_id = 99")).collect() == []


def test_wide_groups_are_counted_before_they_are_paired(monkeypatch):
    enc = encoder(Tokenizers())
    found = align_tokens(enc, TEXTS)
    narrow = link_postings(found)
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert all(np.array_equal(x, y) for x, y in zip(narrow, link_postings(found)))
    assert groups_written(enc, found) == [w[4] for w in brute(TEXTS)[0]]


def test_blocks_cut_long_batches():
    assert list(alignment.pieces(["a"] * 3, 0)) == [(0, 3)]
    big = "b" * (alignment.CHUNK_CHARS - 1)
    assert list(alignment.pieces([big, "ccc", None, big], 0)) == [(0, 1), (1, 3), (3, 4)]
    assert list(alignment.pieces([None] * (alignment.BLOCK_ROWS + 1), 0)) == [(0, alignment.BLOCK_ROWS), (alignment.BLOCK_ROWS, alignment.BLOCK_ROWS + 1)]


@pytest.mark.parametrize("size", [3, 600])
def test_planes_give_back_multiplicities(size):
    rng = np.random.default_rng(size)
    block = alignment.Block(7)
    count = rng.integers(1, 40, size)
    pair = np.full(size, pair_code(5, 9))
    block.add((pair, np.arange(size), count), ["x"] * size)
    total = np.zeros(alignment.BLOCK_ROWS, np.int64)
    for batch in block.bitmaps():
        for r in batch.to_pylist():
            rows = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) if r["dense"] else np.frombuffer(r["bits"], "<u2")
            total[rows] += r["weight"]
            assert r["pair"] == pair_code(5, 9) and (r["docs"] is None or r["docs"] == size)
    assert np.array_equal(total[:size], count) and not total[size:].any()


def test_ranked_ids_equal_the_files_own_library():
    enc = encoder(Tokenizers())
    odd = [f" a{c}b {c} {c}{c}1{c}!{c}  {c}" for c in map(chr, [*range(1, 0x3100, 3), *range(0xE000, 0x1F700, 17)])]
    odd += [" " + t for t in TEXTS if t] + [" " + "ab" * 20_000, " " * 5_000, "\n" * 3_000]
    want = [e.ids for e in A.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in enc.a(odd)] == want
    described = {"model": {"type": "BPE", "merges": [], "vocab": {}, "dropout": 0.1}, "added_tokens": [], "pre_tokenizer": None, "normalizer": None}
    own = alignment.byte_level(Tokenizers().a, described, {})
    assert [x.tolist() for x in own(odd[:50])] == want[:50]


def test_further_columns_are_not_read(spark):
    docs = spark.createDataFrame([(1, "the", 2)], "doc_id long, text string, n_a int").withColumn("bits", F.lit("y"))
    assert align(docs).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
