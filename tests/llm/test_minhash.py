import numpy as np
import pytest

from sparklith.llm import minhash

from .helpers import DOCS, components, near_copy, prose, rng, shingles


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "'clash' as node", "1 as h", "2 as row")


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (5, 80)])
def test_agrees_with_all_pairs(spark, n, percent):
    rnd, rows = rng(n), []
    for i in range(60):
        base = prose(rnd, rnd.randrange(20, 120))
        rows.append((len(rows) * 3, base))
        for _ in range(rnd.randrange(4)):
            rows.append((len(rows) * 3, near_copy(rnd, base, rnd.randrange(3))))
    # A chain: neighbours are linked, the ends are not.
    chain = prose(rnd, 120).split(" ")
    for k in range(8):
        rows.append((len(rows) * 3, " ".join(chain[k * 3 : k * 3 + 96])))
    rows += [(10_001, None), (10_002, ""), (10_003, " \t\n"), (10_004, "one two"), (10_005, "ONE\ttwo"), (10_006, "one  two "), (10_007, "one"), (10_008, "x " * 5000)]
    assert result(minhash.near_duplicates(spark, frame(spark, rows), words=n, percent=percent)) == components(rows, n, percent)


def test_large_groups_are_dealt_into_chunks(spark, monkeypatch):
    rnd = rng(9)
    base = prose(rnd, 80)
    rows = [(i, base) for i in range(50)] + [(100 + i, near_copy(rnd, base, 1)) for i in range(90)] + [(300 + i, near_copy(rnd, base, 5)) for i in range(40)]
    monkeypatch.setattr(minhash, "CHUNK", 16)
    assert result(minhash.near_duplicates(spark, frame(spark, rows), words=4, percent=80)) == components(rows, 4, 80)


def test_keep_one_keeps_columns_and_rows_without_words(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, None), (9, None), (10, "other words that stand alone here")]
    df = frame(spark, rows)
    kept = minhash.keep_one(spark, df, words=5)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8, 9, 10]


def test_nulls_and_empty_tables(spark):
    assert minhash.near_duplicates(spark, frame(spark, []), words=4).count() == 0
    assert minhash.keep_one(spark, frame(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (4, "a b c d e"), (None, "only null ids here"), (None, "only null ids here"), (None, None)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark, frame(spark, rows), words=4).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True), (None, None, True)], key=repr)
    assert minhash.keep_one(spark, frame(spark, rows), words=4).count() == 3


def test_near_copies_with_null_ids(spark):
    rnd = rng(3)
    a, b = prose(rnd, 100), prose(rnd, 100)
    near_a, near_b = near_copy(rnd, a, 1), near_copy(rnd, b, 1)
    # Of b all rows have null ids; one near copy of a has an id.
    rows = [(None, a), (7, near_a), (None, b), (None, near_b), (None, near_b), (9, prose(rnd, 100))]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark, frame(spark, rows), words=4).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 7, False), (7, 7, True), (None, None, True), (None, None, True), (None, None, True), (9, 9, True)], key=repr)
    kept = [tuple(r) for r in minhash.keep_one(spark, frame(spark, rows), words=4).select("doc_id", "text").collect()]
    assert sorted(i for i, _ in kept if i is not None) == [7, 9]
    assert len(kept) == 3 and [t for i, t in kept if i is None][0] in (b, near_b)


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            common, own = int(1000 * share), int(1000 * (1 - share) / 2)
            a = rnd.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            x, y = np.sort(a[: common + own]), np.sort(np.concatenate([a[:common], a[common + own :]]))
            s = minhash.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            errors.append((s[0] == s[1]).mean() - common / (common + 2 * own))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.2 * np.sqrt(share * (1 - share) / minhash.T)
    # Small sets fill every coordinate, too, and agree wholly if equal.
    s = minhash.sketches(np.array([7, 7], np.uint64), np.array([0, 1, 2, 2]))
    assert (s[0] == s[1]).all() and (s[0] != minhash._FULL).all() and (s[2] == minhash._FULL).all()


def test_sets_are_those_of_the_contract():
    import pyarrow as pa

    from sparklith.llm.text import Words, blocks, shingle_sets

    texts = ["A b c D", "a a a a a a a", "\x0b\x0c x", "", "é É ß\t1\r2", "q"]
    for _, _, data, offsets in blocks(pa.array(texts)):
        x, bounds = shingle_sets(Words(data, offsets, True), 4)
        assert np.diff(bounds).tolist() == [len(shingles(t, 4)) for t in texts]


def test_forest_connects_what_all_pairs_connect():
    rnd = np.random.default_rng(2)
    for trial in range(30):
        sets = []
        for _ in range(rnd.integers(2, 9)):
            base = rnd.integers(0, 300, rnd.integers(1, 60)).astype(np.uint64)
            for _ in range(rnd.integers(1, 6)):
                sets.append(np.unique(np.where(rnd.random(len(base)) < 0.1, rnd.integers(0, 300, len(base)).astype(np.uint64), base)))
        group = rnd.integers(0, len(sets), len(sets)) if trial % 2 else np.arange(len(sets))

        def joined(links):
            label = group.copy()
            for i, j in links:
                label[label == label[j]] = label[i]
            return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        found = minhash.forest(sets, group, 80)
        assert set(map(frozenset, found)) <= set(map(frozenset, pairs))
        assert joined(found) == joined(pairs)


def test_unlinked_members_of_a_hot_bucket(spark, monkeypatch):
    """Texts of one template, too different to be linked, with some linked pairs among them that chunks keep apart."""
    rnd = rng(12)
    template = prose(rnd, 100).split(" ")
    rows = []
    for i in range(60):
        own = [f"{x}" if rnd.random() > 0.04 else f"y{rnd.randrange(10**6)}" for x in template]
        rows.append((len(rows), " ".join(own)))
        if i % 5 == 0:
            rows.append((len(rows), near_copy(rnd, rows[-1][1], 2)))
    monkeypatch.setattr(minhash, "CHUNK", 4)
    monkeypatch.setattr(minhash, "FIRST", 1)
    assert result(minhash.near_duplicates(spark, frame(spark, rows), words=4, percent=80)) == components(rows, 4, 80)


def test_work_on_a_large_group_of_near_copies(spark, monkeypatch):
    """Near copies of one text, about half of them too different to be linked with it: a pair is compared a few times, not once for each shingle and chunk."""
    rnd = rng(21)
    base = prose(rnd, 100, 10**6)
    rows = [(i, near_copy(rnd, base, 1 + 2 * (i % 2))) for i in range(160)]
    monkeypatch.setattr(minhash, "CHUNK", 8)
    within, asked = minhash._links_within, []

    def count(groups, percent):
        chunks = {}
        for r in groups.collect():
            chunks.setdefault((r["bucket"], r["chunk"]), []).append(r)
        total = 0
        for rs in chunks.values():
            if rs[0].asDict().get("ask") is None:
                roots = [r["root"] for r in rs]
                total += (len(rs) - max(map(roots.count, roots))) * len(rs)
            else:
                total += sum(r["ask"] for r in rs) * len(rs)
        asked.append(total)
        return within(groups, percent)

    monkeypatch.setattr(minhash, "_links_within", count)
    assert result(minhash.near_duplicates(spark, frame(spark, rows), words=4, percent=80)) == components(rows, 4, 80)
    assert len(asked) == 2 and 0 < asked[1] < 2 * len(rows) ** 2


def test_forest_of_those_that_ask():
    """Outsiders alone ask; shingles that few sets hold and those that many hold both count."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**60, 200).astype(np.uint64)
    sets = [np.unique(np.where(rnd.random(200) < share, rnd.integers(0, 2**60, 200).astype(np.uint64), base)) for share in (0.02, 0.03, 0.05, 0.15, 0.16, 0.3)]
    for _ in range(4):
        own = rnd.integers(0, 2**60, 50).astype(np.uint64)
        sets += [np.unique(own), np.unique(own[:45])]
    sets += [rnd.integers(0, 2**60, 5).astype(np.uint64) for _ in range(20)]
    sets = [np.unique(x) for x in sets]
    pairs = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    asks = np.arange(len(sets)) % 2 == 1
    found = minhash.forest(sets, np.arange(len(sets)), 80, asks)
    assert set(found) <= pairs and all(asks[i] for i, _ in found)
    assert {(6, 7), (8, 9), (10, 11), (12, 13)} <= {(min(p), max(p)) for p in found}
