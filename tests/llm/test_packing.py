import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparklith.llm import packing

from .helpers import DOCS

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello, World! It's 10 o'clock...", "naïve café ÀÉÎ ßtraße aaaaaaaa aaa", "日本語 text 😀", "</w> <|endoftext|> <|startoftext|>", "a" * 3000, "don't we'll you've (x) [y] #1 a.b,c;d", "İstanbul ǅ ÷ ×", "x y z", "é combining", "word " * 9000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS).selectExpr("*", "'c' as ids", "1 as start")


def expected(texts):
    coder = Tokenizer.from_file(PATH)
    return [coder.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check(spark, texts, **options):
    rows = packing.pack(spark, frame(spark, texts), PATH, **options).collect()
    want, window = expected(texts), options.get("window", 4096)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
    for i, ids in enumerate(want):
        got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(docs[i], key=lambda r: r["start"])]).tolist()
        assert got == ids, texts[i]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences), sum(map(len, want))


def test_ids_are_the_tokenizers(spark):
    check(spark, TEXTS)


def test_random_texts(spark):
    rnd = random.Random(1)
    alphabet = "abcdeéßñüABC  \n\t.,;!?'\"-()0123<>/|日😀"
    check(spark, ["".join(rnd.choices(alphabet, k=rnd.randrange(200))) for _ in range(300)], window=64)


def test_documents_of_the_test_data(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    sequences, total = check(spark, texts)
    assert sequences * 4096 < 1.2 * total + 8 * 4096


def test_windows_are_carried_over(spark):
    texts = [f"word{i} " * 30 for i in range(300)]
    one, total = check(spark, texts, window=512)
    few, _ = check(spark, texts, window=512, block_tokens=2000)
    assert few <= 1.25 * one + 8


def test_best_fit_decreasing_is_the_plain_one():
    rnd = random.Random(3)
    for _ in range(60):
        window = rnd.choice([7, 16, 100])
        lengths = [rnd.randrange(1, window + 1) for _ in range(rnd.randrange(80))]
        where, offset, free = packing.best_fit_decreasing(lengths, window)
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = [b for b in bins if b >= n]
            if fit:
                bins.remove(min(fit))
            bins.append((min(fit) if fit else window) - n)
        assert sorted(bins) == sorted(free)
        for w in set(where):
            mine = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
            assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(n for _, n in mine) + free[w] == window


def test_query(spark):
    rows = packing.op9_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts, expected(texts.values())))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, "a b"), (1, None)]])
def test_nulls_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(spark, df, PATH).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == ([] if not rows else [(False, 1), (True, 3), (True, 3)])
