import pytest

from sparklith.llm import substring

from .helpers import DOCS, prose, rng, without_repeats


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS).selectExpr("*", "1 as id", "'c' as h", "3 as at")


@pytest.mark.parametrize("n", [1, 2, 5, 12, 35])
def test_agrees_with_all_windows(spark, n):
    rnd, texts = rng(n), []
    passage = prose(rnd, 3 * n + 2)
    for i in range(40):
        t = prose(rnd, rnd.randrange(0, 150), 5000 if n > 2 else 200_000)
        if i % 4 == 0:
            w = passage.split(" ")
            a = rnd.randrange(len(w) - n + 1)
            t += " " + " ".join(w[a : a + rnd.randrange(max(1, n - 1), 3 * n)]) + "\n" + prose(rnd, 10, 5000)
        texts.append(t)
    texts += [None, "", " \n", "a " * (3 * n), "z " * n, texts[3], texts[3], " ".join("ab"), "é\tÉ " * n]
    got = substring.remove_repeats(spark, frame(spark, texts), n).orderBy("doc_id").collect()
    assert [(r["_n_words"], r["_n_removed"], r["_kept"]) for r in got] == without_repeats(texts, n)
    for r, t in zip(got, texts):
        assert sum(s["end"] - s["start"] for s in r["_spans"]) == r["_n_removed"] and r["text"] == t


def test_periodic_text(spark):
    texts = ["a b " * 40, "c " + "a b " * 6 + "d", "x y z " * 3]
    got = substring.remove_repeats(spark, frame(spark, texts), 8).orderBy("doc_id").collect()
    assert [(r["_n_words"], r["_n_removed"], r["_kept"]) for r in got] == without_repeats(texts, 8)


def test_repeated_rows_and_null_ids(spark):
    row = (None, prose(rng(1), 60), None, None, None)
    df = spark.createDataFrame([row, row, (1, "short", None, None, None), (1, prose(rng(2), 50), None, None, None)], DOCS)
    got = substring.remove_repeats(spark, df, 20).collect()
    assert sorted(r["_n_removed"] for r in got) == [0, 0, 60, 60]


def test_empty_table(spark):
    out = substring.remove_repeats(spark, frame(spark, []), 35)
    assert out.count() == 0 and "_kept" in out.columns


def test_levels():
    assert substring.lengths(35) == [9, 18, 35] and substring.lengths(1) == [1]
    assert all(b <= 2 * a for n in range(1, 200) for a, b in zip(substring.lengths(n), substring.lengths(n)[1:]))
