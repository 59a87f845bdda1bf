"""The pipeline against its stages' own brute-force rules, on documents planted for each stage."""

import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cairn.llm import common, quality

R = random.Random(11)
WORDS = [f"word{i}" for i in range(400)] + ["the", "of", "and", "to"] * 20


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    items = [(i, prose(40)) for i in range(5)]
    docs = [(i, prose(R.choice([20, 80, 300, 900])) + ("\n" + prose(60)) * (i % 3)) for i in range(120)]
    docs[5] = (5, prose(80) + "\n" + prose(60))
    docs += [(200 + i, " ".join(x.upper() + "!!" for x in prose(60).split())) for i in range(60)]  # junk
    docs += [(300, docs[5][1]), (301, docs[5][1]), (302, prose(10) + items[2][1] + prose(10)), (303, None), (304, "")]
    long = prose(900)
    docs += [(310, long), (311, long.replace("word7 ", "word8 ", 1))]
    docs += [(312, prose(1500) + " " + " ".join(items[4][1].split()[5:25]) + " " + prose(1500)), (None, prose(120)), (313, prose(90)), (313, None), (314, prose(6000))]
    docs += [docs[3], docs[3]]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or ""), "clash") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, words string").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    left = {}
    for name, stage in P.STAGES:
        out = common.written(stage(spark, docs, tables), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        left[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    left = {k: {i: r for i, r in v.items() if i is not None} for k, v in left.items()}
    q = left["quality"]
    assert not any(200 <= i < 260 for i in q) and len([i for i in q if i < 120]) >= 116 and {300, 301, 302, 310, 311} <= set(q)
    d = left["line_dedup"]
    assert set(d) == set(q) and d[300]["text"] == "" and d[5]["text"] == q[5]["text"] and d[300]["n_chars"] == 0
    n = left["near_dedup"]
    assert len({310, 311} & set(n)) == 1 and len([i for i in n if i < 120]) == len([i for i in q if i < 120]) and len({300, 301, 303, 304} & set(n)) <= 1
    c = left["decontamination"]
    assert 302 not in c and set(n) - set(c) == {302, 312}  # 312: one part in a hundred
    packed = docs.where("doc_id is not null and doc_id != 313").groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: len((r["text"] or "").split()) for i, r in c.items() if i != 313}


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def by_lines(rows):
    """Every run of lines of eight words that stands earlier goes."""
    first, gone, out = {}, {}, []
    docs = sorted({(r["doc_id"] if r["doc_id"] is not None else -(2**63), r["h"], r["text"] or "") for r in rows})
    for at in docs:
        x = at[2].split("\n")
        solid = [k for k, v in enumerate(x) if v.strip()]
        gone[at] = set()
        for a in range(len(solid)):
            for b in range(a + 1, min(len(solid), a + 8) + 1):
                run = [x[k].strip() for k in solid[a:b]]
                if len(words(" ".join(run))) >= 8 and first.setdefault(tuple(run), (at, a)) != (at, a):
                    gone[at] |= set(solid[a:b])
    for r in rows:
        t = r["text"] or ""
        out.append((r["doc_id"], "\n".join(v for k, v in enumerate(t.split("\n")) if k not in gone[r["doc_id"] if r["doc_id"] is not None else -(2**63), r["h"], t])))
    return out


def by_similarity(rows):
    """One of each component of pairs at 0.8, over all pairs."""
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["h"]))
    sets = []
    for r in order:
        w = [x.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for x in words(r["text"])]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or 5 * len(sets[i] & sets[j]) >= 4 * union:
                group = [group[j] if g == group[i] else g for g in group]
    seen, out = set(), []
    for r, g in zip(order, group, strict=True):
        if g not in seen:
            seen.add(g)
            out.append((r["doc_id"], r["text"]))
    return out


def by_windows(rows, items):
    def split(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower().decode())

    wins = {tuple(w[k : k + 13]) for w in map(split, items) if w for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in wins}
    return [(r["doc_id"], r["text"]) for r in rows if not any(tuple(w[k : k + n]) in wins for w in [split(r["text"])] for n in sizes for k in range(len(w) - n + 1))]


def test_each_stage_against_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    plain = {"line_dedup": by_lines, "near_dedup": by_similarity, "decontamination": lambda rows: by_windows(rows, items)}
    for name, stage in P.STAGES[:-1]:
        given = docs.withColumn("h", F.xxhash64("text")).collect()
        out = common.written(stage(spark, docs, tables), f"plain-{name}")
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
            kept = model.score(quality.features([(r["text"] or "").encode() for r in given])) >= quality.THRESHOLD
            assert got == Counter((r["doc_id"], r["text"]) for r, k in zip(given, kept.tolist(), strict=True) if k)
        elif name == "line_dedup":
            assert Counter({(i, t or ""): n for (i, t), n in got.items()}) == Counter(by_lines(given))
        else:
            assert got == Counter(plain[name](given))
        docs = out
    assert docs.where("doc_id is null").count() == 1


def test_run(spark, tables):
    assert P.ORACLE_SQL is None and set(P.run(spark, tables).columns) == {"doc_id", "piece", "n_words", "bin_id", "bin_offset"}


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
