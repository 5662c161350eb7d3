"""Near-duplicate documents, lines and fingerprints against plain versions; the pipeline's stages."""

import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from choicerank.llm import forest, lines, spotsigs
from choicerank.llm.common import CLEANUP, Work, on_workers
from choicerank.llm.components import _with_least, components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def workers(spark):
    on_workers(spark)


def plain_components(texts, percent=75):
    sets = {i: set(forest.shingle_hashes(t or "").tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_with_a_crowd(spark):
    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    texts = {}
    for i in range(60):  # a crowd: each is like the base, many are not like each other
        own = list(base)
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(150)] = f"n{draw.randrange(10**6)}"
        texts[i] = " ".join(own)
    texts |= {100 + i: " ".join(f"v{draw.randrange(9)}" for _ in range(draw.choice([0, 1, 4, 5, 30]))) for i in range(30)}
    texts |= {200: "one two three", 201: "ONE  two\tthree", 202: None, 203: "", 204: "one two three four five six",
              205: "one two three four five six", 206: "x " * 30_000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as node", "2 as kept")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(frame).collect()}
    assert found == plain_components(texts)


def star(first, copies, draw):
    """Texts by id: a base of 160 shingles, then copies with 20 of them changed, like the base (0.78), not each other (0.62)."""
    base = [f"w{draw.randrange(10**6)}" for _ in range(164)]
    texts = {first: " ".join(base)}
    for i in range(copies):
        own = list(base)
        at = draw.randrange(4, 32)
        for k in range(4):
            own[at + 32 * k] = f"n{draw.randrange(10**9)}"
        texts[first + 1 + i] = " ".join(own)
    return texts


def test_near_duplicates_of_a_star_with_the_smallest_id(spark):
    texts = star(5, 600, random.Random(3))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in forest.near_duplicates(frame).collect()}
    assert {i for i, c in found.items() if c != 5} == set()


def test_near_duplicates_of_small_families_in_a_crowd(spark):
    draw = random.Random(11)
    passage = [f"w{draw.randrange(10**6)}" for _ in range(133)]
    texts = {}
    for family in range(400):  # 0.68 between families, 0.76 to 0.87 inside of one
        first = passage + [f"n{draw.randrange(10**9)}" for _ in range(31)]
        second = first[:-draw.randint(12, 22)]
        second += [f"n{draw.randrange(10**9)}" for _ in range(164 - len(second))]
        texts[2 * family], texts[2 * family + 1] = " ".join(first), " ".join(second)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(frame).collect()}
    assert found == plain_components(texts)
    assert len({c for _, c in found.values()}) == 400


def test_stored_tables_leave_no_shuffle_files(spark):
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for folder in folders for f in glob.glob(f"{folder}/**/shuffle_*", recursive=True)}

    work, before, setting = Work(spark), files(), spark.conf.get(CLEANUP)
    frame = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n"))
    stored = work.store(frame.join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"), "counted")
    assert files() <= before and spark.conf.get(CLEANUP) == setting
    assert stored.agg(F.sum("n")).first()[0] == 1000


def test_near_duplicates_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")],
                                  "doc_id long, text string")
    found = sorted((tuple(r) for r in forest.near_duplicates(frame).collect()), key=str)
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert forest.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    links = spark.createDataFrame(chain, "a long, b long")
    found = {r.node: r.component for r in components(links, Work(spark), "test").collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_hot_node_is_split(spark):
    """Half of the links lead to one node: the join with the minima cuts them into several tasks."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        links = spark.range(60_000).repartition(8).selectExpr("if(id % 2 = 0, -1, id) as hi", "id * 7 as lo")
        joined = _with_least(links)
        rows = {(r.hi, r.lo): r.m for r in joined.collect()}
        assert len(rows) == 60_000 and all(m == (0 if hi == -1 else lo) for (hi, lo), m in rows.items())
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plain_repeats(rows, percent=80, least=5):
    seen, out = [], set()
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            own = frozenset(line.lower().split())
            if not own:
                continue
            for other in seen:
                n = len(own & other)
                long = min(len(own), len(other)) >= least
                if own == other or long and 100 * n >= percent * (len(own) + len(other) - n):
                    out.add((i, k))
                    break
            seen.append(own)
    return out


@pytest.mark.parametrize("crowd", [lines.CROWD, 1])
def test_lines_against_plain_search(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    draw = random.Random(4)
    base = [[f"w{draw.randrange(60)}" for _ in range(draw.choice([5, 8, 20]))] for _ in range(12)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(draw.randint(0, 4)):
            line = list(draw.choice(base))
            for _ in range(draw.randint(0, 3)):
                line[draw.randrange(len(line))] = f"w{draw.randrange(60)}"
            own.append("  ".join(line))
        rows.append((i, "\n".join(own)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "to be or not"), (74, "not or be to"), (75, "to be or")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as doc", "3 as gone")
    want = plain_repeats(rows)
    assert {(r.doc, r.line) for r in lines.repeated_lines(frame).collect()} == want and len(want) >= 20
    found = {r.doc_id: r for r in lines.dedup_lines(frame, removed="n").collect()}
    for i, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in want)
        assert found[i].text == kept and found[i].gone == 3
    assert lines.dedup_lines(frame.limit(0)).count() == 0


def test_prefixes_of_lines_are_exchanged_once(spark, monkeypatch):
    """Both sides of the join of prefixes read one exchange, and no prefixes are stored for their common words."""
    found = {}
    store = Work.store

    def kept(self, df, name, *args):
        found[name] = df
        return store(self, df, name, *args)

    monkeypatch.setattr(Work, "store", kept)
    monkeypatch.setattr(lines, "CROWD", 1)
    texts = [" ".join(f"w{(i * 7 + k * k) % 40}" for k in range(12)) for i in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    monkeypatch.setattr(Work, "release", lambda self, *names: None)
    lines.repeated_lines(rows)
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in fixed}
    try:
        for name, value in fixed.items():
            spark.conf.set(name, value)
        plan = found["pairs"].select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    token = [line for line in plan.splitlines() if "hashpartitioning(token" in line]
    assert sum("ReusedExchange" not in line for line in token) == 1, plan
    assert "ReusedExchange" in plan and "array(band" not in plan
    assert "crowded" not in found  # prefixes of common words are not stored


def test_bitmaps_of_long_lines_differ(spark):
    """Unlike lines of 100 tokens that share their rarest ones are told apart without their sets; alike ones never are."""
    draw = random.Random(4)
    rare = [f"r{i}" for i in range(8)]
    common = [f"c{i}" for i in range(4000)]
    texts = [" ".join(rare + draw.sample(common, 92)) for _ in range(40)]
    base = texts[0].split()
    texts += [" ".join(base[:-k] + [f"x{k}-{i}" for i in range(k)]) for k in (1, 5, 9)]
    tokens = lines._tokens(F.col("text"))
    sets = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").select(
        "doc", F.transform(tokens, lambda t: F.xxhash64(t)).alias("t"))
    marks = sets.select("doc", F.lit(0).alias("line"), F.size("t").alias("n"), *(
        lines._bitmap(F.col("t"), half).alias(name) for half, name in enumerate(("low", "high"))))
    pairs = spark.createDataFrame([(b, 0, a, 0) for b in range(43) for a in range(b)], "b_doc int, b_line int, a_doc int, a_line int")
    left = {(r.b_doc, r.a_doc) for r in lines._likely(pairs, marks, 80).collect()}
    assert {(b, 0) for b in (40, 41, 42)} <= left and left <= {(b, a) for b in (40, 41, 42) for a in (0, 40, 41)}


def test_lines_of_equal_and_missing_keys(spark):
    line = "one two three four five six"
    frame = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line + "\nrest")], "doc_id long, text string")
    found = sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(frame).collect())
    assert found == [("1", line), ("1", line), ("2", "rest"), ("None", line)]


def test_short_lines_with_equal_sets(spark):
    long = "one two three four five six"
    frame = spark.createDataFrame([(1, f"All rights reserved.\n\n{long}"), (2, "new\n\nall  RIGHTS reserved."),
                                   (3, f"All rights\n{long}\nreserved. all rights all")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()}
    assert found == {1: f"All rights reserved.\n\n{long}", 2: "new\n", 3: "All rights"}
    assert {r.doc for r in lines.repeated_lines(frame, short=False).collect()} == {3}


def test_documents_against_the_next(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "!"), (10_003, "word"), (10_004, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as part").repartition(5)
    found = {r.doc_id: r for r in spotsigs.compare_with_next(frame).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, text) in enumerate(order):
        then = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + then[:half]
        own, mixed, other = (set(spotsigs.signatures(t).tolist()) for t in (text, changed, then))
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == (len(own & mixed) / len(own | mixed) if own | mixed else 1.0)
        assert r.near_next == (len(own & other) / len(own | other) if own | other else 1.0)
    assert found[10_004].fingerprint == found[rows[0][0]].fingerprint
    lone = spotsigs.compare_with_next(spark.createDataFrame([(1, "a lone text")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0
    assert spotsigs.compare_with_next(frame.limit(0)).count() == 0


def test_similar_fingerprints(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {}
    for r in docs.orderBy("doc_id").collect():
        own = frozenset(spotsigs.signatures(r.text or "").tolist())
        if own and own not in sets.values():
            sets[r.doc_id] = own
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in spotsigs.similar(docs, 0.5).collect()} == want


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_duplicates", "decontamination", "tokenization"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    work = Work(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = work.store(stage(spark, docs, DATA), name)
        if name != "tokenization":
            assert after.columns == docs.columns
            kept = {r.doc_id: r for r in after.collect()}
            assert set(kept) <= set(before) and len(kept) > 0.6 * len(before)
            if name == "line_dedup":
                gone = plain_repeats(sorted(before.items()))
                assert {i: r.text for i, r in kept.items()} == {
                    i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
                assert all(r.n_chars == len(r.text) for r in kept.values())
            if name == "near_duplicates":
                assert set(kept) == {i for i, (_, c) in plain_components(before).items() if c == i}
            if name == "decontamination":
                items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
                clean = {i for i, t in before.items() if not any(x in " ".join(t.lower().split()) for x in items)}
                assert set(kept) == clean
        else:
            assert {r.doc_id for r in after.collect()} == set(before)
        docs = after
