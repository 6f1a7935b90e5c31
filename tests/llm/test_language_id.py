import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparklith.llm import langid

SAMPLES = [("en", "the cat and the dog went over the hill with their friends " * 3), ("de", "der Hund und die Katze gingen über den Hügel mit ihren Freunden " * 3), ("fr", "le chat et le chien sont allés sur la colline avec leurs amis " * 3)]


def profiles(spark, rows=SAMPLES, size=langid.PROFILE):
    return langid.learn(spark, spark.createDataFrame(rows, "lang string, text string").withColumn("gram", F.lit(1)), size)


def grams(text):
    """n-grams up to 3 of the letters, with one gap around and between words."""
    line = "_" + "_".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split()) + "_"
    if line == "__":
        return Counter()
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != "_")


def test_counts_are_the_plain_ones(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 7)
    for text in ("Hello, wörld! 12 ab", "a", "", "123", "x" * 30, "é É日本 -- ß\n\nq"):
        keys, counts = langid.gram_counts(text)
        got = Counter()
        for k, c in zip(keys.tolist(), counts.tolist()):
            s = ""
            while k:
                s = ("_" if k & 0x1FFFFF == 0x1FFFFF else chr(k & 0x1FFFFF)) + s
                k >>= 21
            got[s] += c
        assert got == grams(text), text


def test_distance_is_the_plain_one(spark):
    found = profiles(spark, size=30)
    ranked = {}
    for lang, text in SAMPLES:
        order = lambda g: [langid_code(c) for c in g]
        ranked[lang] = sorted(grams(text).items(), key=lambda x: (-x[1], packed(x[0])))[:30]
    for text in ("the hill", "die Freunde gingen", "amis et chien", "zzz qqq"):
        own = [g for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], packed(x[0])))][:30]
        distance = {}
        for lang, profile in ranked.items():
            place = {g: i for i, (g, _) in enumerate(profile)}
            distance[lang] = sum(abs(place[g] - i) if g in place else 30 for i, g in enumerate(own))
        best = min(sorted(distance), key=distance.get)
        assert found.predict(text) == (best, 1 - distance[best] / (30 * len(own)))


def langid_code(c):
    return 0x1FFFFF if c == "_" else ord(c)


def packed(g):
    out = 0
    for c in g:
        out = out << 21 | langid_code(c)
    return out


def test_nulls_and_empty_tables(spark):
    found = profiles(spark, [*SAMPLES, (None, "text without a language"), ("en", None)])
    assert found.languages == ["de", "en", "fr"]
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (None, "the dog"), (5, "le chat " * 200_000)], "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, found).collect()}
    assert got == {1: "und", 2: "und", 3: "und", None: "en", 5: "fr"}
    nothing = profiles(spark, []) if False else langid.learn(spark, spark.createDataFrame([], "text string, lang string"))
    assert [tuple(r)[1:] for r in langid.predict(rows.where("doc_id = 5"), nothing).collect()] == [("und", 0.0)]
    assert langid.predict(rows.limit(0), found).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    got = langid.op4_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97
