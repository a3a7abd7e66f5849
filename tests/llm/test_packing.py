"""Best-fit packing: pieces against the tokenizer on whole texts, bins against a plain search."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from graphloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def pieces(rows, size=2048):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            out.append((i or 0, k // size, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def check_places(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs, packing.Params(PATH)).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(rows)
    least = -(-sum(r["length"] for r in got) // 2048)
    assert check_places(got, 2048) <= 1.05 * least + 1


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two " * 9), (3, "one two " * 9), (None, "x"), (4, "[PAD] <s> é 😀\n\ttext"), (5, "a <|endoftext|> b"), (6, "x<|startoftext|>y<|ENDOFTEXT|> <|endoftext|><|endoftext|>.")]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], f"{SCHEMA}, piece int, offset long")
    got = packing.pack(docs, packing.Params(PATH, max_tokens=8)).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(rows, 8)
    check_places(got, 8)
    assert packing.WordEncoder(PATH, 10).encode("a <|endoftext|> b") == struct.pack("<3I", 320, 49407, 321)
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.Params(PATH)).count() == 0


@pytest.mark.parametrize("open_bins", [1, 5, 1000])
def test_bins_are_those_of_a_plain_search(open_bins):
    rng, size = random.Random(open_bins), 64
    bins, free, left = packing.BestFit(size, open_bins), {}, {}
    for _ in range(3000):
        length = rng.randint(1, size)
        number, offset = bins.place(length)
        fitting = [f for f in free.values() if f >= length]
        if fitting:  # one with the least space that is enough
            assert free[number] == min(fitting)
        else:
            assert number not in left
            if len(free) == open_bins:
                del free[next(k for k, v in free.items() if v == min(free.values()) and k not in bins.free[v])]
        before = left.get(number, size)
        assert offset == size - before
        left[number] = before - length
        free[number] = left[number]
        if not free[number]:
            del free[number]
        assert {k for group in bins.free for k in group} == set(free)
