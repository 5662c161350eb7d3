"""Spelling variants, conversation repair and fingerprints at anchors against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash

from choicerank.llm import anchors, spelling, turns
from choicerank.llm.common import on_workers
from choicerank.llm.queries import QUERIES

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True, scope="module")
def workers(spark):
    on_workers(spark)


@pytest.fixture
def table(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain_variants(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def misspelt(rng, n):
    """Texts with families of words one or two edits apart, of very different frequencies."""
    letters = "abcdéÿ"
    words = []
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        for times in (200, 30, 5):
            words += [word] * times
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1:], word[:k] + rng.choice(letters) + word[k:],
                               word[:k] + rng.choice(letters) + word[k + 1:]])
    rng.shuffle(words)
    return [(k, rng.choice([" ", "\n", "1", "–"]).join(words[k::n])) for k in range(n)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 8])
def test_spelling_variants(table, spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)  # eight: nearly every affix is split into chunks
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (block,))
    docs = misspelt(random.Random(3), 20) + [(None, "Éclairs ÉCLAIRS éclairs " * 5), (21, None), (22, ""),
                                              (23, "x" * 5000 + " " + "cafétéria " * 6)]
    docs += docs[:2]
    folder = table("documents", docs, "doc_id long, text string")
    found = QUERIES["op11_spelling_variants"](spark, folder)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])
    want = plain_variants(docs)
    assert got == want
    assert len([r for r in want if r[1] and r[2] != r[1]]) > 3  # forms of forms


def test_no_words(table, spark):
    folder = table("documents", [(1, "a b"), (2, None)], "doc_id long, text string")
    assert QUERIES["op11_spelling_variants"](spark, folder).count() == 0
    empty = spark.createDataFrame([], "doc_id string, text string, word int, n int")
    assert spelling.variants(spelling.count_words(empty)).count() == 0


def test_index_walks_like_the_plain_rule():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abü") for _ in range(6)) for _ in range(150)})
    index = spelling.Index(words, 6)
    for length in (6, 7):
        queries = ["".join(rng.choice("abüz") for _ in range(length)) for _ in range(200)] + words * (length == 6)
        q, i = index.near(queries, length)
        found = {(queries[a], words[b]) for a, b in zip(q, i)}
        assert found == {(a, b) for a in queries for b in words if one_edit(a, b)}


# Conversations ------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Faults, cheapest cost, ASCII-least audit and repaired rows by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    blank = duplicate = truncated = 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = ("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
    initials = [role[:1] for _, role, _ in rows]

    @cache
    def best(i, so_far, inserts):
        """``so_far`` stands for what was given out: '', 's' or the last of u and a."""
        found = []
        if i == len(rows) and so_far in ("", "a"):
            found.append((0, "", ()))
        steps = {"": "u", "s": "u", "u": "a", "a": "u"}
        new, names = steps[so_far], {"u": "user", "a": "assistant"}
        if inserts:
            cost, audit, out = best(i, new, inserts - 1)
            found.append((cost + 3, "I" + audit, ((names[new], ""),) + out))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, so_far, 2)
            found.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                if initials[i] == new or (initials[i] == "s" and so_far == ""):
                    cost, audit, out = best(i + 1, initials[i], 2)
                    found.append((cost + more, "K" + audit, ((role, text),) + out))
                cost, audit, out = best(i + 1, new, 2)
                found.append((cost + more + 3, "R" + audit, ((names[new], text),) + out))
        return min(found, default=(10 ** 9, "", ()))

    cost, audit, out = best(0, "", 2)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), out


def plain_damage(key, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        out += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def conversations(rng, n):
    roles = ["user", "assistant", "system", None, "", "tool", "User", "unknown"]
    out = []
    for key in [*range(n), None]:
        rows, turn = [], rng.randrange(3)
        if rng.random() < 0.1:
            rows.append((None, "system", "Be good."))
        for k in range(rng.choice([1, 1, 2, 5, 8, 30])):
            role = rng.choice(roles) if rng.random() < 0.3 else roles[k % 2]
            text = rng.choice(["Fine.", "So\t", "", None, " \t", f"No {k}!", f"Why {k}? \n", f"And {k}", "Ü…"])
            rows.append((turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 7])
        out.append((key, rows))
    return out


def test_conversation_repair(table, spark):
    talks = conversations(random.Random(1), 400)
    talks.append((400, [(k, "user", f"Line {k}.") for k in range(3000)]))  # long runs of one symbol
    talks.append((401, [(k, "assistant", "Same.") for k in range(1000)]))
    rows = [(key, *row, 7) for key, own in talks for row in own]
    random.Random(2).shuffle(rows)
    folder = table("conversations", rows, "conv_id long, turn long, role string, text string, id int")
    found = QUERIES["op12_conversation_repair"](spark, folder)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert set(got) == {key for key, _ in talks}
    for key, own in talks[:401]:
        assert got[key] == plain_repair(plain_damage(key, own))[0], key
    assert any(not plain_damage(key, own) for key, own in talks)


def test_long_runs_like_the_plain_rule():
    import sys

    sys.setrecursionlimit(20_000)
    rng = random.Random(8)
    for trial in range(60):
        rows, turn = [], 0
        for _ in range(rng.randrange(1, 6)):
            role, full, n = rng.choice(["user", "assistant", "system", "x"]), rng.random() < 0.7, rng.choice([1, 2, 3, 17, 64, 90])
            for _ in range(n):
                rows.append((turn, role, f"t {turn}" + "." * full))
                turn += 1
        symbols = turns.Symbols()
        for _, role, text in rows:
            symbols.add(role[0] if text.endswith(".") else role[0].upper())
        cost, audit = symbols.repair()
        assert (cost, audit) == plain_repair(rows)[0][5:7]


def test_many_short_runs(monkeypatch):
    rng = random.Random(9)
    for stride in (1, 2, 7):
        monkeypatch.setattr(turns, "STRIDE", stride)
        for _ in range(40):
            kinds = [rng.choice("suaxSUAX-") for _ in range(rng.randrange(0, 40))]
            symbols = turns.Symbols()
            rows = []
            for k, kind in enumerate(kinds):
                symbols.add(kind)
                rows.append((k, kind.lower(), "" if kind == "-" else f"{k}" if kind.isupper() else f"{k}."))
            assert symbols.repair() == plain_repair(rows)[0][5:7]


def test_repaired_rows(spark):
    talks = conversations(random.Random(4), 40)
    rows = [(key, *row) for key, own in talks for row in own]
    frame = turns.prepared(spark.createDataFrame(rows, "c int, t int, r string, x string"), "c", "t", "r", "x")
    got = defaultdict(list)
    for r in turns.repaired(frame, turns.plans(frame)).orderBy("id", "place").collect():
        assert r.place == len(got[r.id])
        got[r.id].append((r.role, r.text))
    for key, own in talks:
        filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]
        assert tuple(got[key]) == plain_repair(filled)[1]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair(empty).count() == 0


# Fingerprints -------------------------------------------------------------------------------------------------------


def plain_print(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(ASCII)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    found = list(range(len(prints)))

    def root(k):
        while found[k] != k:
            k = found[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                found[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(prints))]


def test_fingerprints_at_anchors(table, spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(40)]
    docs = []
    for key in range(600):  # texts of few shingles, so that many are a bit or two apart
        words = list(rng.choice([base[:12], base[5:30], base[20:]]))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(base)
        docs.append((1000 - key, rng.choice([" ", "\t", "\x0b "]).join(words)))
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "Ä\x1cB É"), (5004, "ONE two"), (5005, "one TWO"),
             (5006, "long text " * 50_000), (5007, docs[0][1]), (5007, docs[0][1])]
    folder = table("documents", docs, "doc_id long, text string")
    found = QUERIES["op13_simhash_anchors"](spark, folder)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    docs.sort(key=lambda d: d[0])
    prints = [plain_print(text) for _, text in docs]
    want = sorted((key, f"{p:016x}", docs[c][0]) for (key, _), p, c in zip(docs, prints, plain_components(prints)))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert len({c for *_, c in want}) < len(set(prints)) < 600


def test_anchors_meet():
    known, rng = anchors.codes(2), np.random.default_rng(1)
    assert all((code.levels[0][1] == 1).all() for code in known)  # perfect: one home
    prints = rng.integers(-2 ** 63, 2 ** 63 - 1, 300)
    reached = [set() for _ in prints]
    for rows, found in anchors.anchors(prints, known, 2):
        for k, anchor in zip(rows.tolist(), found.tolist()):
            assert anchor not in reached[k]
            reached[k].add(anchor)
    for n in (0, 1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in prints], np.uint64).view(np.int64)
        (rows, homes), = anchors.anchors(prints ^ flips, known, 0)
        assert rows.tolist() == list(range(300))
        assert all(home in own for home, own in zip(homes.tolist(), reached))


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, 40).repeat(30)
                       ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
                                   for _ in range(1200)], np.uint64).view(np.int64))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    got = sorted(tuple(r) for r in anchors.links(frame).collect())
    mask = 2 ** 64 - 1
    want = [(a, b) for i, a in enumerate(prints.tolist()) for b in prints.tolist()[i + 1:]
            if ((a & mask) ^ (b & mask)).bit_count() <= 2]
    assert got == sorted(want) and want


def test_replicas_are_not_broadcast(spark):
    frame = spark.range(50).selectExpr("xxhash64(id) as fp")
    plan = anchors.links(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_fingerprints_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 7)
    for text in ("", " a ", "a b", "The quick\tbrown\x0bfox  jumps", "é ü x y z" * 9):
        assert anchors.fingerprint(text.encode()) & (2 ** 64 - 1) == plain_print(text)
    docs = spark.createDataFrame([(None, "a b c d", 1), ("k", "a b c d", 2), (None, "other words entirely here", 3)],
                                 "id string, body string, fp int")
    got = sorted(((r.id or "", r.component_id or "") for r in anchors.near_duplicates(docs, "id", "body").collect()))
    assert got == [("", ""), ("", "k"), ("k", "k")]
    assert anchors.near_duplicates(docs.limit(0), "id", "body").count() == 0
