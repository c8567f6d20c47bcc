"""Filter audit, prefix trie and LSH forest against brute force on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geostrain.llm import filter_audit, minhash_forest, ngram_join, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Further columns with the names of intermediate and result columns.
CLASHING = "part string, A boolean, digest string, n long, size long, hub long, key long, sig string, kept boolean, rep long, component_id long"
EXTRA = ("p", True, "d", 1, 1, 1, 1, "s", False, 1, 1)


def words(text):
    return WORD.findall(text or "")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ------------------------------------------------------------ filter audit


def _audit(docs, labels):
    """Every order applied document by document."""
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    fails, good, toxic = [], [], []
    for i, text, _ in docs:
        t, w = text or "", words(text)
        first = firsts.get(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first is not None and first < i}
        fails.append({k for k, v in f.items() if v})
        good.append(any(d == i and i is not None and q == 1 for d, q, _ in labels))
        toxic.append(any(d == i and i is not None and x == 1 for d, _, x in labels))
    out, shapley = [], Counter()
    for part in {lang or "" for _, _, lang in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in fails[k]]
                alive = [k for k in alive if f not in fails[k]]
                earlier = sum(f in fails[k] for k in own) - len(gone)
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(alive), len(gone), earlier, sum(fails[k] == {f} for k in own), sum(good[k] for k in gone), sum(toxic[k] for k in gone), f])
    return [(*r[:9], shapley[r[0], r[9]]) for r in out]


def test_audit(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "ONE TWO", "# x", prose(199), prose(200), prose(201) + " |", (prose(4) + " ") * 60, prose(220).upper(), prose(6000), "é" * 3 + "A", " a  b\x0bc ", "la " * 400 + "%"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(160)]
    docs += [(3, docs[3][1], docs[3][2]), (3, "another text of that id", "en"), (None, prose(250), "en"), (None, docs[5][1], "fr"), (-7, texts[7], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-7, 120)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, *EXTRA) for d in docs], "doc_id long, text string, lang string, " + CLASHING).repartition(3)
    marks = spark.createDataFrame([(*x, "e", "t") for x in labels], "doc_id long, quality int, toxic int, part string, text string")
    got = filter_audit.audit(df, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert plain(got.collect()) == plain(_audit(docs, labels))


def test_audit_makes_each_state_once(spark, monkeypatch):
    made = []
    visit = filter_audit.Trie._visit
    monkeypatch.setattr(filter_audit.Trie, "_visit", lambda self, state, rows: (made.append(state), visit(self, state, rows)))
    flags = spark.createDataFrame([("en", i % 2 == 0, i % 3 == 0, i % 5 == 0, True, False) for i in range(30)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    trie = filter_audit.Trie(flags, "ABC")
    assert made == ["", "A", "AB", "ABC", "AC", "B", "BC", "C"]  # depth first, each set of filters once
    removed = {(r.state, r.filter): r.removed for r in trie.edges().collect()}
    assert removed["", "A"] == 15 and removed["A", "B"] == 5 and removed["AB", "C"] == 2 and len(removed) == 12


def test_empty_audit_and_forest(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    assert minhash_forest.near_duplicates(docs).count() == 0
    some = spark.createDataFrame([(1, "a b c", None)], docs.schema)
    assert {(r.part, r.removed + r.redundant) for r in filter_audit.audit(some, labels).where("filter_order like 'A%' and step = 1").collect()} == {("", 1)}


# ------------------------------------------------------------ prefix trie


def _trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], set()).add(c)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        children = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(words(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _conversations():
    rng = random.Random(9)
    turn = lambda: ("user" if rng.random() < 0.5 else None, rng.choice(["hello there", "", None, "a b c d", "what is  that\n", "x" * 40, "no"]))
    rows = []
    for c in [*range(0, 130), *range(-45, -30), 3_000_000_000]:
        if c % 11 == 3:
            continue  # some bases and followers are absent
        same = c % 3 == 0
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, *(("user", f"turn {t}") if same else turn())))
    rows += [(60, None, "system", "first of all"), (61, 2**40, "user", "last"), (None, 0, "user", "nobody's")]
    rows += [(200, t, "user", f"long {t // 50}") for t in range(120)] + [(201, t, "user", f"long {t // 50}") for t in range(120)]
    rows += [(77, 3, "user", "again")] * 2  # equal rows are two turns
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_trie(spark, chunk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "ENDS", 4 if chunk == 3 else 256)
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "conv_id long, turn long, role string, text string, pos long, depth long, k1 long, n long").repartition(3)
    got = prefix_trie.trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert plain(got.collect()) == plain(_trie(rows))


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    for c in range(1, 20):  # its only turn goes, and there is no base
        if zlib.crc32(str(c).encode()) % 4:
            break
    assert plain(prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "x")], schema)).collect()) == plain(_trie([(c, 0, "user", "x")]))


def test_paths_are_few_light_edges(spark):
    """Each node lies on one path, and light edges above it are at most the logarithm of the conversations."""
    nodes, named = prefix_trie._nodes(*prefix_trie.rebuilt(spark.createDataFrame(_conversations(), "conv_id long, turn long, role string, text string")))
    on = prefix_trie.heavy_paths(nodes, named).collect()
    assert len(on) == nodes.count() and len({(r.k1, r.k2) for r in on}) == len(on)
    assert max(r.level for r in on) <= np.log2(len({r[0] for r in _conversations()}))
    for path, group in itertools.groupby(sorted(on, key=lambda r: (r.path, r.depth)), key=lambda r: r.path):
        depths = [r.depth for r in group]
        assert depths == list(range(depths[0], depths[-1] + 1)), path


# ------------------------------------------------------------ LSH forest


def _shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _classes(rows, percent):
    sets = {i: _shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            least[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def _families(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(10**6))
    texts = [None, "", " \t", "one", "ONE", "a b c d e", "A b C d e", "a b c d", word() * 300]
    passage = [word() for _ in range(120)]
    for size, length, edits in ((60, 150, (0, 1, 1, 2, 3, 5)), (30, 200, (1, 2)), (5, 60, (1, 1, 2)), (40, 150, (3, 4, 5)), (12, 3000, (5, 20, 40))):
        family = [word() for _ in range(length)]
        for _ in range(size):
            copy = list(family)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(40):  # not linked, but of one passage: their regions stay open
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(5, 60))]))
    texts += texts[10:14] + [" ".join(word() for _ in range(80)) for _ in range(10)]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1000, 7])
def test_forest(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = _families(block)
    rows += [rows[20], (None, rows[21][1]), (None, "of no id at all " * 3)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], "doc_id long, text string, " + CLASHING).repartition(3)
    want = _classes(rows, minhash_forest.PERCENT)
    got = minhash_forest.near_duplicates(df).collect()
    assert len(got) == len(rows)
    text = Counter((i, len(_shingles(t))) for i, t in rows)
    assert Counter((g.doc_id, g.n_shingles) for g in got) == text
    for g in got:
        if g.doc_id is not None:
            assert g.component_id == want[g.doc_id] and g.kept == (g.doc_id == g.component_id)
    alone = [g for g in got if g.doc_id is None]
    assert {g.component_id for g in alone} == {want[21], None} and all(g.kept for g in alone if g.component_id is None)
    assert max(Counter(want.values()).values()) > 4 * ngram_join.ALL_PAIRS


def test_minima_estimate_similarity():
    rng = np.random.default_rng(6)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1700, 150, 150))
    x, y = minhash_forest.minima([np.sort(np.r_[shared, a]), np.sort(np.r_[shared, b])])
    assert abs(float((x == y).mean()) - 0.85) < 0.08
