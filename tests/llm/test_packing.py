import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tenderspring.llm import packing as P
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 40), max_size=60))
def test_a_plan_places_every_item_once(counts):
    filled = defaultdict(list)
    found = P.plan(counts)
    assert set(found) == set(counts)
    for size, runs in found.items():
        end = 0
        for a, b, pieces in runs:
            assert a == end and sum(n for _, n, _, _ in pieces) == size
            end, start = b, 0
            for s, n, at, offset in pieces:
                assert s == start
                start += n
                for j in range(b - a):
                    filled[at + j].append((offset, n))
        assert end == counts[size]
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_little_padding():
    r = random.Random(5)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[r.randint(1, 2047)] += 1
    n = 1 + max(at + b - a - 1 for runs in P.plan(counts).values() for a, b, pieces in runs for _, _, at, _ in pieces)
    assert sum(k * v for k, v in counts.items()) / (n * 2048) > 0.985


def test_pieces_hold_the_tokens_of_the_other_library(spark):
    docs = table(spark, SF, "documents")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (None, "a <|endoftext|> b"), (9003, "<|endoftext|><|endoftext|>x"), (9004, "<|endoftext |> é <|endoftext|>\n 12")], "doc_id long, text string"))
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in P.packed(docs.selectExpr("*", "1 as rank", "2 as row")).collect():
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in docs.collect():
        ids = [*encode.encode(d.text or "", add_special_tokens=False).ids, 1]
        own = sorted(parts[d.doc_id], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u2") for r in own]).tolist() == ids and all(r.doc_tokens == len(ids) for r in own)
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048


def test_checksums_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two")], "doc_id long, text string")
    rows = P.with_checksums(P.packed(df)).collect()
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("one two", add_special_tokens=False).ids
    assert len(rows) == 2 and {r.ids_crc32 for r in rows} == {zlib.crc32(np.array([*ids, 1], "<u4").tobytes())}
    assert P.packed(df.limit(0)).count() == 0
