"""Each corpus operator against brute force on a table of awkward rows, and on an empty one."""

import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geostrain.llm import exact_dedup, html_extract, language_id, mixing, ngram_join, packing, quality, secrets, substring_dedup, toxicity
from geostrain.llm.common import Words, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, `group` string, id long, n long, kept boolean, places binary, h string"


def _rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(700)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, family = prose(60), prose(150).split()
    texts = [None, "", " \t\n", "one", "One two", "a b c d e", "tail  é ß 漢字 🙂", "x" * 3000, "Ab c\td", "ab c d", "ABC D", "la la " * 40, "a b c " * 30]
    texts += [prose(20) + " " + passage + " " + prose(15), prose(33) + "\n" + passage, passage + " " + prose(80), prose(2500)]
    texts += [prose(rng.randint(5, 120)) for _ in range(30)]
    for _ in range(40):  # a family of near copies, some of them far from all others
        copy = list(family)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 9])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[16], texts[20], texts[20] + " ", texts[20]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src7", None]), 1, 1, "g", 1, 1, True, b"x", "h") for i, t in enumerate(texts)]
    rows += [rows[20], (None, "a null id " + prose(40), "en", "src0", 1, 1, "g", 1, 1, True, b"x", "h")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        packing.pack(empty), language_id.identify(empty, language_id.train(empty)), exact_dedup.report(empty), secrets.find_secrets(empty),
        ngram_join.near_duplicates(empty), substring_dedup.drop_repeats(empty), mixing.mix(empty), html_extract.extract(pages), quality.judge(empty),
        toxicity.score(empty, toxicity.train(empty, labels)),
    ):
        assert df.count() == 0


# ------------------------------------------------------------ packing


def test_fast_ids_are_those_of_the_tokenizer(rows):
    """Against an untouched tokenizer: special tokens, odd white space and endless runs included."""
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(12)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext |>", " " * 5000, "a" * 200_000, "\u00a0\u2003 x\u0000", "1" * 300, "'s 'S don't", "\r\n \t x  "]
    odd += ["".join(rng.choice("ab '1.\n \t<|>é漢🙂\u0301") for _ in range(200)) for _ in range(100)]
    for text in [r.text for r in rows] + odd:
        assert packing.token_ids(text).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_round_trip(docs, rows):
    got = packing.pack(docs, group_tokens=3000).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        windows[p.sequence_id].append((p.offset, p.length))
    count = Counter(r.doc_id for r in rows)
    for r in rows:
        ids = packing.token_ids(r.text)
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) * count[r.doc_id]
        for p in own:
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 512, 600)
    window = packing.differencing(sizes, 75)
    sums = np.bincount(window, sizes, 75)
    assert sums.max() - sums.min() <= 4
    assert (np.bincount(packing.spread(np.array([2048, 2047, 3]), 2048), [2048, 2047, 3]) <= 2048).all()


# ------------------------------------------------------------ language


def test_language_of_mixed_text(spark):
    rng = random.Random(3)
    en, de = "the house and that with river stone walk green".split(), "der haus und über straße grün laufen stein fluß".split()
    ru = "дом и река камень зелёный".split()
    train = [(i, " ".join(rng.choice(v) for _ in range(60)), k) for i, (k, v) in enumerate([("en", en), ("de", de), ("ru", ru)] * 12)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    english, german = " ".join(rng.choice(en) for _ in range(40)), " ".join(rng.choice(de) for _ in range(25))
    texts = [english, german, english + "\n" + german, "река камень", None, "", "123 456 !?", "漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(df, model, spans=True).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["en", "de", "en", "ru"]
    assert [s.lang for s in got[2].spans] == ["en", "de"]
    raw = texts[2].encode()
    assert raw[got[2].spans[1].start : got[2].spans[1].end].decode() == german
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6))
    assert got[7].lang_pred in model.languages and got[7].score < 0.5


def test_letters_by_unicode_category(spark):
    """Of each category two characters: a text has a label if and only if it has a letter."""
    model = language_id.train(spark.createDataFrame([(i, "plain words of it", k) for i, k in enumerate(["en", "de"] * 4)], "doc_id long, text string, lang string"))
    by_kind = defaultdict(list)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(by_kind[unicodedata.category(chr(c))]) < 400:
            by_kind[unicodedata.category(chr(c))].append(c)
    texts = [chr(v[i]) for v in by_kind.values() for i in (0, -1) if v]
    texts += ["😀😀😀", "、。", "×÷", "٣٤", "१२", "𝟏𝟐", "🇫🇷 100% 🎉", "a1", "½ é", "\u0301", "ไทย", "हिन्दी", "ქართული", "ệ", "𠀀"]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        assert (got[i].lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in text)), text
        assert got[i].score > 0 or got[i].lang_pred == "und"
    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    data = "".join(map(chr, every)).encode()
    bits = language_id.byte_scripts(np.frombuffer(data, np.uint8))
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    assert np.array_equal(bits[first], language_id.script_bits()[every]) and not bits[~first].any()
    own = lambda t: int(np.bitwise_or.reduce(language_id.byte_scripts(np.frombuffer(t.encode(), np.uint8))))
    assert len({own(t) for t in ("ไทย", "हिन्दी", "ქართული", "ệ", "漢", "かな", "한")}) == 7 and own("ệ") == own("e")


def test_viterbi_shortcut_equals_the_full_search():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = rng.normal(0, 6, (rng.integers(1, 30), 3)).astype(np.float32)
        model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), np.zeros(3, np.uint64))
        path = model.labels(s)
        value = s[np.arange(len(s)), path].sum() - language_id.SWITCH * np.count_nonzero(np.diff(path))
        best = s[0].astype(float)
        for t in range(1, len(s)):
            best = np.maximum(best, best.max() - language_id.SWITCH) + s[t]
        assert value == pytest.approx(best.max(), abs=1e-3)


# ------------------------------------------------------------ exact duplicates


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    got = exact_dedup.report(docs).collect()
    assert len(got) == len(rows)
    by_id = {g.doc_id: g for g in got}
    for normal, own in groups.items():
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id
        for r in own:
            g = by_id[r.doc_id]
            assert (g.keep_id, g.group_size, g.kept, g.text_sha256) == (best, len(own), r.doc_id == best, hashlib.sha256(normal.encode()).hexdigest())
    assert by_id[None].kept and by_id[None].group_size == 1


# ------------------------------------------------------------ secrets


def test_secrets(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    texts = [
        None, "", f"login: bob then token = abc then {key}", "secret=token:abcdefgh", "PassWord : 'abc123'", "aaa " + "0123456789abcdef" * 2, "AKIAAKIA" + "Z" * 14,
        "user=alice and pwd=hunter22 at https://db.example.com/x", "pwd=hunter22 alone", "user=alice alone", "é🙂 api_key=" + "x" * 8, "user=alice" + " " * 300 + "pwd=hunter22",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    patterns = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(patterns) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        line = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert [got[i][f"n_{n}"] for n, *_ in patterns] == [sum(f[3] == n for f in found) for n, *_ in patterns]
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))
    assert got[7].spans == "ident:0:10,weak:15:27,endpoint:31:55"
    assert got[8].spans == "" and got[9].spans == "" and got[11].spans == ""


def _secrets(text, scope=secrets.SCOPE):
    """All spans of a text by comparing each with each."""
    text = text or ""
    found = {name: [(m.start(), k, m.end(), name) for m in re.finditer(p, text) if len(m[g]) >= least] for k, (name, (p, g, least)) in enumerate((secrets.BASE | secrets.WEAK).items())}
    base = [x for name in secrets.BASE for x in found[name]]
    weak = {name: [x for x in found[name] if not any(y[0] < x[2] and x[0] < y[2] for y in base)] for name in secrets.WEAK}
    near = lambda x, others: any(y[0] - x[2] <= scope and x[0] - y[2] <= scope for y in others)
    ids, keys = found["access"] + weak["ident"], found["assign"] + found["hex"] + weak["weak"]
    linked = [x for x in weak["ident"] if near(x, keys)] + [x for x in weak["weak"] if near(x, ids)] + [x for x in weak["endpoint"] if near(x, ids) and near(x, keys)]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(base + linked))


def test_secrets_against_all_pairs(spark):
    rng = random.Random(21)
    parts = ["user=alice", "login: bob_7", "pwd=hunter22", "pass = 'abcdefg'", "auth=zzzzzzz", "token=abcdef123", "secret: xy", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "https://h.example/x", "s3://b", "user=pwd=abcdefgh", "token=user=alice99", "é🙂", "x" * 60, " " * 90, "\n", "plain words"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "\t", " " * 70]) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "z" * 300_000 + " user=alice pwd=hunter22"]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].spans == _secrets(t), t
    assert sum("ident" in r.spans for r in got.values()) > 20


def test_secrets_of_a_long_text(spark):
    """Time follows the number of spans; repeated rows, null ids and clashing columns are kept apart."""
    text = "user=alice pwd=hunter22\n" * 20_000
    df = spark.createDataFrame([(1, text), (2, "token=abcdefg"), (2, "token=abcdefg"), (None, "user=alice")], "doc_id long, text string").selectExpr("*", *(f"1L as `{c}`" for c in ("row", "kind", "start", "end", "pos", "found", "step", "size", "spans", "base")))
    assert sorted((str(r.doc_id), r.n_assign, r.spans.count(":") // 2) for r in secrets.find_secrets(df).collect()) == [("1", 0, 40_000), ("2", 1, 1), ("2", 1, 1), ("None", 0, 0)]


# ------------------------------------------------------------ near duplicates


def _components(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in rows:
        w = words((r.text or "").translate(fold))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates(docs, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    component, size = _components(rows)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.n_shingles == size[g.doc_id]
        if g.doc_id is not None:
            assert g.component_id == component[g.doc_id]


@pytest.mark.parametrize("block", [1000, 7])
def test_number_of_links(spark, block, monkeypatch):
    """Every link of large groups is counted: families above ALL_PAIRS against all pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(10**6))
    texts = []
    for size, edits in ((60, (0, 1, 1, 2, 3, 5)), (25, (1, 2)), (5, (1, 2)), (12, (6, 7, 8))):
        family = [word() for _ in range(150)]
        for _ in range(size):
            copy = list(family)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += texts[:3] + [" ".join(word() for _ in range(80)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    n_links = {x: sum(x != y and 100 * len(x & y) >= 75 * len(x | y) for y in set(sets)) for x in set(sets)}
    assert max(n_links.values()) > 4 * ngram_join.ALL_PAIRS
    assert {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs, count_links=True).collect()} == {i: n_links[x] for i, x in enumerate(sets)}


def test_shared_counts():
    rng = np.random.default_rng(3)
    usual = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    some = lambda: [np.unique(np.r_[usual[rng.random(5000) < p], rng.integers(0, 200, 60, dtype=np.uint64)]) for p in rng.random(40)]
    for a, b in ((some(), some()), ([usual[:1]], [usual[1:2]]), ([np.unique(usual)], some())):
        want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert ngram_join.shared_counts(a, b).tolist() == want


def test_signatures_meet():
    """Sets at the threshold share a signature, whatever their sizes."""
    rng = np.random.default_rng(2)
    bands, common = ngram_join.Bands(), np.zeros(ngram_join.COUNTERS, bool)
    for _ in range(300):
        union = int(rng.integers(4, 400))
        every = np.unique(rng.integers(0, 1 << 63, union, dtype=np.uint64))
        union = len(every)
        shared = -(-75 * union // 100)
        side = rng.permutation(union)
        cut = shared + int(rng.integers(0, union - shared + 1))
        a, b = np.sort(every[side[:cut]]), np.sort(every[np.r_[side[:shared], side[cut:]]])
        assert set(ngram_join.signatures(a, bands, common).tolist()) & set(ngram_join.signatures(b, bands, common).tolist())


# ------------------------------------------------------------ repeated passages


def _passages(rows):
    """n_words, n_removed and digest of each row, by comparing words."""
    n = substring_dedup.WINDOW
    count = Counter(tuple(w[i : i + n]) for r in rows for w in [words(r.text)] for i in range(len(w) - n + 1))
    out = []
    for r in rows:
        w = words(r.text)
        kept = [True] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                kept[i : i + n] = [False] * n
        out.append((len(w), kept.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, kept, strict=True) if k).encode()).hexdigest()))
    return out


def test_repeated_passages(docs, rows):
    got = {g.doc_id: g for g in substring_dedup.drop_repeats(docs).collect()}
    want = _passages(rows)
    for r, x in zip(rows, want, strict=True):
        if r.doc_id is not None:
            g = got[r.doc_id]
            assert (g.n_words, g.n_removed, g.kept_sha256) == x
    assert sum(x[1] for x in want) > 500


@pytest.mark.parametrize("flush", [1 << 19, 500])
def test_long_repeats_with_other_borders(spark, flush, monkeypatch):
    """Copies of long passages, whole, nested, cut anywhere, run together, and in a row without an id."""
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    rng = random.Random(17)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    long, other = prose(900), prose(300)
    texts = [long, long, prose(20) + long[100:700] + prose(9), long[:420] + other, other + long[410:], long[33:80], prose(400), other[:150] * 3, ["la"] * 200, ["la"] * 34, ["a", "b"] * 80, prose(7) + ["a", "b"] * 20]
    for _ in range(40):
        a = rng.randrange(860)
        texts.append(prose(rng.randrange(30)) + long[a : a + rng.randrange(20, 300)] + prose(rng.randrange(30)))
    table = [(i if i % 9 else None, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = {g.doc_id: g for g in substring_dedup.drop_repeats(df).collect()}
    for r, x in zip(df.collect(), _passages(df.collect()), strict=True):
        if r.doc_id is not None:
            assert (got[r.doc_id].n_words, got[r.doc_id].n_removed, got[r.doc_id].kept_sha256) == x


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements, on which hashes modulo a power of two collide."""
    one = _thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    head = [f"q{i}" for i in range(34)]
    texts = [" ".join([*head, one]), " ".join([*head, two]), " ".join(["x", "y", "z", "t", one[:200]]), " ".join(["x", "y", "z", "t", two[:200]])]
    texts += [" ".join(_thue_morse(64)), " ".join(_thue_morse(64).translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df.where("doc_id < 4")).collect()}
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]  # 30 and 30 shingles, 29 of them shared
    assert got[0].n_links == got[1].n_links == 1
    rows = df.collect()
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    assert [(got[r.doc_id].n_words, got[r.doc_id].n_removed, got[r.doc_id].kept_sha256) for r in rows] == _passages(rows)


def test_hashes_tell_words_apart():
    seen = {f"w{i}" for i in range(30_000)} | {"x" * i for i in range(1, 600)} | {"a" * i + "b" + "a" * (700 - i) for i in range(700)}
    seen = sorted(seen)
    line = "  ".join(seen).encode()
    w = Words(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
    for seed in (0, 1):
        h = w.hashes(seed)
        assert len(h) == len(seen) == len(np.unique(h))
        alone = [Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])).hashes(seed)[0] for x in seen[::97]]
        assert alone == h[::97].tolist()
    values = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint64)
    for width in (1, 2, 3, 5, 35, 64):
        h = window_hashes(values, width)
        assert len(h) == 3000 - width + 1
        assert len(set(h.tolist())) == len({tuple(values[i : i + width]) for i in range(len(h))})


# ------------------------------------------------------------ mixing


def test_division_of_budgets(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 1000), ("web", "en", "b", 10), ("web", "de", "c", 50), ("books", "en", "d", 400), ("books", None, None, 0)], "domain string, lang string, source string, n_tokens long")
    plan = mixing.Plan(target_share=(1, 2), domains={"web": 1, "books": 1}, languages={"en": 1, "de": 1})
    got = {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.leaf_budgets(leaves, plan).collect()}
    # 730 tokens: 365 for each domain; de is short by 132, which en takes; b is short, which a takes
    assert got == {("web", "en", "a"): 305, ("web", "en", "b"): 10, ("web", "de", "c"): 50, ("books", "en", "d"): 365, ("books", None, None): 0}


def test_mixing(docs, rows):
    plan = mixing.Plan(max_epochs=3, target_share=(2, 1))
    got = mixing.mix(docs, plan).collect()
    assert len(got) == len(rows)
    leaves = defaultdict(list)
    for g in got:
        assert g.n_tokens == len(words(next(r.text for r in rows if r.doc_id == g.doc_id)))
        leaves[(g.domain, g.lang, g.source)].append(g)
    for own in leaves.values():
        total, budget = sum(g.n_tokens for g in own), own[0].leaf_budget
        used = sum(g.n_tokens * g.n_copies for g in own)
        assert used <= budget <= 3 * total
        assert max(g.n_copies for g in own) - min(g.n_copies for g in own) <= 1
        left = [g.n_tokens for g in own if total and g.n_copies == budget // total]
        assert not left or budget - used < max(left) or budget == used
    assert sum(g.leaf_budget for g in {id(v): v[0] for v in leaves.values()}.values()) <= 2 * sum(g.n_tokens for g in got)


# ------------------------------------------------------------ pages


PAGE = """<html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><a href="/">menu</a></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text that is long enough to count</p></div>
<article><header><h1>A &amp; B&nbsp;title</h1></header><p>First   paragraph<br>goes <b>on</b>.<p>Short.</p><form><input><p>send</p></form>
<blockquote>Quoted &eacute;t&eacute; &#8211; words</blockquote><div class="comments"><p>reader says</p></div></article><footer>foot</footer></body></html>"""


def test_html():
    assert html_extract.main_text(PAGE) == "A & B title\nFirst paragraph goes on.\nShort.\nQuoted été – words"
    plain = "<body><div class='menu'><a>x</a><a>y</a></div><div><p>" + "Long text of the page here. " * 8 + "</p><p>End.</p></div><div><a>link one</a> <a>link two</a></div></body>"
    assert html_extract.main_text(plain).endswith("\nEnd.")
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "<script>x")] == [""] * 4


def test_html_keeps_every_line_of_the_root():
    """Cells, runs of short lines and paragraphs in containers of their own are text too."""
    long = [f"{i} " + "word " * 59 + "end." for i in range(20)]
    cells = [f"cell{i}" for i in range(10)]
    ps = lambda x: "".join(f"<p>{v}</p>" for v in x)
    table = "<table><tr>" + "".join(f"<td>{v}</td>" for v in cells) + "</tr></table>"
    short = "<div>" + ps(cells) + "</div>"
    links = "<div>" + "".join(f"<a href='/{i}'>link {i}</a> " for i in range(12)) + "</div>"
    want = "\n".join(long[:10] + cells + long[10:])
    for inner in (table, short):
        text = ps(long[:10]) + inner + ps(long[10:])
        assert html_extract.main_text(f"<body><article>{text}</article>{links}</body>") == want
        assert html_extract.main_text(f"<body>{links}<div>{text}</div>{links}</body>") == want
    divs = ["word " * 399 + "end.", "word " * 59 + "end."]
    assert html_extract.main_text("<body><div>" + "".join(f"<div><p>{v}</p></div>" for v in divs) + f"</div>{links}</body>") == "\n".join(divs)
    assert html_extract.main_text("<body>" + "".join(f"<div>{v}</div>" for v in divs) + "</body>") == "\n".join(divs)
    each = "".join(f"<div><p>{v}</p></div>" for v in long[:10]) + short + "".join(f"<div><p>{v}</p></div>" for v in long[10:])
    assert html_extract.main_text(f"<body><div>{each}</div>{links}</body>") == want


def test_html_names_are_evidence_only():
    article = "<article><h1>Title</h1><p>" + "Words of the article. " * 12 + "</p><p>End.</p></article>"
    want = html_extract.main_text(article)
    assert want.startswith("Title\n") and want.endswith("\nEnd.")
    for a, b in (("<div class='layout no-sidebar'>", "</div>"), ("<div id=page class=has-banner>", "</div>"), ("<section class='legal-analysis'>", "</section>"), ("<div class='content share-enabled'>", "</div>"), ("<div class='post comment-count-3'>", "</div>"), ("<div class='sidebar'>", "</div>"), ("<body class=modal>", "</body>")):
        assert html_extract.main_text(a + article + b) == want, a
        assert html_extract.main_text(a + article.replace("article>", "div>") + b) == want, a
    comments = "<p>" + "A reader's long opinion on it all. " * 40 + "</p>"
    for c in (f"<div class=comments>{comments}</div>", f"<section id='comment-list'>{comments}</section>", f"<article class='comment'>{comments}</article>", f"<div class='CommentThread'>{comments}</div>"):
        assert html_extract.main_text(f"<body>{article}{c}</body>") == want, c
        assert html_extract.main_text("<body>" + article.replace("</article>", f"<div class='user-comments'>{comments}</div></article>") + "</body>") == want
    assert html_extract.main_text("<table><tr><td>alpha</td><td>beta</td><td>gamma</td></tr></table>") == "alpha\nbeta\ngamma"
    assert html_extract.main_text("<article><table><tr><td>alpha</td><td>beta</td><td>gamma</td></tr></table></article>") == "alpha\nbeta\ngamma"


def test_html_of_loose_pages():
    """A head without its end, a form around the page, controls in sentences, other forms."""
    text = "Words of the article, and more of them. " * 6
    want = ("Title\n" + text).strip()
    article = f"<article><h1>Title</h1><p>{text}</p></article>"
    assert html_extract.main_text(f"<html><head><title>x</title><meta charset=utf-8><body>{article}") == want
    assert html_extract.main_text(f"<html><head><title>x</title><link rel=a>{article}") == want
    assert html_extract.main_text(f"<head><title>x</title>{text}") == text.strip()
    for inner in (article, article.replace("article>", "div>")):
        page = f"<body><form id='aspnetForm'><input type=hidden><nav><a>menu</a></nav>{inner}<button>Go</button></form></body>"
        assert html_extract.main_text(page) == want
    assert html_extract.main_text(f"<body>{article}<form><p>{text}</p></form></body>") == want
    assert html_extract.main_text(f"<body><article><h1>Title</h1><p>{text}</p><form><p>Mail</p><label>Your name</label></form></article></body>") == want
    assert html_extract.main_text("<article><p>Press <button>Save</button> to keep the <label>name</label> there.</p><button>Share</button></article>") == "Press Save to keep the name there."
    assert html_extract.main_text(f"<body>{article}<div id=discussion><p>{text}</p></div></body>") == want


def test_html_clusters_choose_inside_articles(monkeypatch):
    text = "".join("<p>" + "A sentence that goes on for long enough to count here. " * 5 + "</p>" for _ in range(6))
    links = "<div>" + "".join(f"<p><a href='/{i}'>another story {i}</a></p>" for i in range(9)) + "</div>"
    chips = "<section>" + "".join(f"<div>{'<i></i>' * 9}{i}</div>" for i in range(9)) + "</section>"
    want = html_extract.main_text(f"<article>{text}</article>")
    assert html_extract.main_text(f"<article>{text}{links}{chips}</article>") == want
    assert html_extract.main_text(f"<body><div>{text}</div>{links}{chips}</body>") == want
    monkeypatch.setattr(html_extract, "smoothed", lambda values: [1.0] * len(values))
    assert html_extract.main_text(f"<article>{text}{chips}</article>") != want


def test_html_ratios_decide(monkeypatch):
    """Without smoothing and thresholds, lines full of tags would join the content."""
    long = ["A sentence of the text that goes on for long enough to count. " * 5 for _ in range(8)]
    chips = "".join(f"<div><i></i><i></i><i></i><i></i><i></i><span>tag</span><i></i><i></i>{i}</div>" for i in range(8))
    page = f"<body><div>{chips}</div><div>" + "".join(f"<p>{x}</p>" for x in long) + "</div></body>"
    teasers = "<body><article>" + "".join(f"<p>{x}</p>" for x in long) + f"</article>{'<p>' * 6}<article>{chips}</article></body>"
    want = "\n".join(x.strip() for x in long)
    assert html_extract.main_text(page) == html_extract.main_text(teasers) == want
    monkeypatch.setattr(html_extract, "smoothed", lambda values: [1.0] * len(values))
    assert html_extract.main_text(page) != want and html_extract.main_text(teasers) != want


def test_html_of_random_pages(spark):
    """Pages put together from a known article and known boilerplate."""
    rng = random.Random(31)
    say = lambda n: " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(2, 9))) for _ in range(n))
    escape = lambda t: t.replace("é", rng.choice(["é", "&eacute;", "&#233;", "&#xE9;"]))

    def block(text):
        x = rng.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<div><p>{}</p></div>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>"])
        words_ = escape(text).split(" ")
        words_[len(words_) // 2] = f"<b>{words_[len(words_) // 2]}</b>"
        return x.format(rng.choice([" ", "\n ", "<br>", "  \t"]).join(words_)) + ("" if x != "<p>{}" else "\n")

    junk = [lambda: f"<nav><ul><li><a href=/>{say(2)}</a></ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'cookie-notice', 'sidebar', 'comments', 'share-buttons'])}'><p>{say(rng.randint(1, 60))}</p></div>", lambda: f"<aside>{say(20)}</aside>", lambda: f"<form><p>{say(5)}<input></form>", lambda: f"<script>x='<p>{say(3)}'</script>", lambda: f"<style>p{{}}</style><!-- {say(4)} -->"]
    pages, want = [], []
    for i in range(150):
        texts = [say(rng.choice([1, 5, 30, 80])) for _ in range(rng.randint(1, 9))]
        inner = "".join(block(t) + (rng.choice(junk)() if rng.random() < 0.3 else "") for t in texts)
        around = lambda: "".join(rng.choice(junk)() for _ in range(rng.randrange(4)))
        a, b = rng.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<div class='page no-sidebar'><article>", "</article></div>"), ("<main><div>", "</div></main>")])
        pages.append((i, "u", f"<html><head><title>{say(3)}</title></head><body><header>{say(3)}</header>{around()}{a}{inner}{b}{around()}<footer>{say(9)}</footer></body></html>", 1, "t"))
        want.append("\n".join(texts))
    pages += [(None, None, None, 1, "t"), (3, "u", "<p>" + "x " * 400_000, 1, "t")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, n_chars long, text string").coalesce(1)).collect()
    assert [r.text for r in got] == [*want, "", ("x " * 400_000).strip()] and all(r.n_chars == len(r.text) for r in got)


def test_html_is_linear():
    began = time.perf_counter()
    for page in ("<div>" * 60_000 + "x" + "</p></span>" * 60_000, "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000, "<td>y" * 40_000, "<div class='a'><p>t</p>" * 20_000):
        assert html_extract.main_text(page) is not None
    assert time.perf_counter() - began < 20


# ------------------------------------------------------------ quality


def _statistics(text):
    t, w = text or "", words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for own in at.values() if len(own) > 1 for i in own for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered)


def test_quality(docs, rows):
    for r in quality.judge(docs).collect():
        want = _statistics(next(x.text for x in rows if x.doc_id == r.doc_id))
        assert tuple(r[c] for c in quality.STATISTICS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


VECTORS = "row long, own string, tongue string, x0 double, x1 double, x2 double, x3 double, x4 double"


def test_outliers_of_each_group(spark):
    """Groups of any size; a third of the rows of one group are outliers that lie together."""
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i % 3}", "t", *(float(v) for v in rng.normal(i % 3, 1, 5))) for i in range(900)] + [(900 + i, "g0", "t", *(float(v) for v in rng.normal(14, 0.5, 5))) for i in range(90)]
    rows += [(2000, "g1", "t", *[40.0] * 5), (2001, "alone", "t", *[1.0] * 5), (2002, "same", "u", *[2.0] * 5), (2003, "same", "u", *[2.0] * 5)]
    d2 = {r.row: r.d2 for r in quality.robust_distances(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(d2) == len(rows)
    assert min(d2[900 + i] for i in range(90)) > 150 and np.quantile([d2[i] for i in range(900)], 0.99) < 25
    assert d2[2000] > 150 and max(d2[2001], d2[2002], d2[2003]) < 20


def test_least_determinant_of_a_small_case(spark):
    """Concentration steps against the determinants of all subsets."""
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, (9, 5)), rng.normal(9, 1, (3, 5))]
    rows = [(i, "p", *map(float, v)) for i, v in enumerate(x)]
    h = -(-len(x) * 3 // 4)
    best = min(np.linalg.slogdet(quality.floored(np.cov(x[list(c)].T, bias=True)))[1] for c in itertools.combinations(range(len(x)), h))
    got = quality.least_determinants(spark.createDataFrame(rows, "row long, pool string, x0 double, x1 double, x2 double, x3 double, x4 double")).collect()
    assert len(got) == 1
    inverse = np.zeros((5, 5))
    for (i, j), v in zip(quality._PAIRS, got[0].inverse, strict=True):
        inverse[i, j] = inverse[j, i] = v / (1 if i == j else 2)
    assert -np.linalg.slogdet(inverse)[1] <= best + 0.05
    assert np.abs(np.array(got[0].centre)).max() < 1.5


# ------------------------------------------------------------ toxicity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(9)
    terms = {"idiot": 1.0, "worthless": 0.8, "scum": 0.6, "moron": 0.5}
    automaton = toxicity.Automaton.build(terms)
    tries = list(terms) + ["idot", "idiots", "xidiot", "worthles", "worhtless", "scums", "morrron", "wrthles"]
    for _ in range(400):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("aeioxt")
        tries.append("".join(w))
    line = " ".join(tries)
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) + 1 for w in tries]) - 1
    edits = automaton.edits[automaton.run(points, end - [len(w) for w in tries], end)]
    for w, e in zip(tries, edits.tolist(), strict=True):
        near = [d for t in terms if (d := _distance(w, t)) <= toxicity.edits_allowed(t)]
        assert e == (min(near) if near else -1), w


def test_automaton_of_many_terms_and_forgotten_states(monkeypatch):
    rng = random.Random(12)
    terms = {"".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 11))): 1 + rng.random() for _ in range(2000)}
    rigid = frozenset(sorted(terms)[:300])
    began = time.perf_counter()
    automaton = toxicity.Automaton.build(terms, rigid)
    assert time.perf_counter() - began < 5 and len(automaton.states) == 2
    tries = rng.sample(sorted(terms), 12)
    for w in list(tries):
        k = rng.randrange(len(w))
        tries += [w[:k] + "z" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "y" + w[k:], w[::-1], w[1:] + "zz"]
    line = " ".join(tries)
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) + 1 for w in tries]) - 1
    start = end - [len(w) for w in tries]
    names = sorted(terms)
    for limit in (10**6, 0):  # kept, then forgotten before each run
        monkeypatch.setattr(toxicity, "MAX_STATES", limit)
        for _ in range(2):
            states = automaton.run(points, start, end)
            got = list(zip(automaton.edits[states].tolist(), automaton.weight[states].tolist(), automaton.term[states].tolist(), strict=True))
        for w, (e, weight, term) in zip(tries, got, strict=True):
            near = [(d, -terms[t], i) for i, t in enumerate(names) if abs(len(t) - len(w)) <= 2 and (d := _distance(w, t)) <= (0 if t in rigid else toxicity.edits_allowed(t))]
            assert (e, -weight, term) == min(near) if near else e == -1, w


def test_toxicity(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    say = lambda k, *more: " ".join([*(rng.choice(clean) for _ in range(k)), *more])
    rows = [(i, say(30, *(["you", "idiot"] if i % 4 == 0 else ["you"]))) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    tests = [say(30, "idiot"), say(30, "idiott"), say(30), None, "", say(30, '"idiot"')]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    assert [got[i].predicted for i in range(5)] == [1, 1, 0, 0, 0]
    assert got[5].score < got[0].score and all(0 <= r.score <= 1 for r in got.values())


# ------------------------------------------------------------ pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = [set(ids)]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept[:-1], kept[1:], strict=True))
    assert all(any(c.isalpha() for c in ids[i]) for i in kept[1])
    normal = Counter(re.sub(r"[\x20\x09-\x0D]", "", ids[i]) for i in kept[2])
    assert max(normal.values()) == 1 and len(normal) == len({re.sub(r"[\x20\x09-\x0D]", "", ids[i]) for i in kept[1]})

    class Row:
        def __init__(self, i):
            self.doc_id, self.text = i, ids[i]

    component, _ = _components([Row(i) for i in kept[2]])
    assert kept[3] == {i for i in kept[2] if component[i] == i}
    assert 0 < len(kept[4]) < len(kept[3])
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[4]
    assert packed.agg(F.sum("length")).first()[0] == sum(len(packing.token_ids(ids[i])) for i in kept[4])


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Empty tables, null texts, no labelled language, repeated and null ids, and columns with the names of results."""
    import corpus_pipeline as pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "label", "keep_id", "component_id", "n_copies"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, label string, keep_id long, component_id long, n_copies long"
    long = "some words of a text that is long enough to be told apart " * 3
    tables = {
        "empty": ([], set()),
        "unlabelled": ([(1, long, None, None, 1, "x"), (2, None, None, "s1", None, None), (3, "123", None, "s1", 1, "x"), (None, "other words here", None, None, 1, "x")], {1, None}),
        "labelled": ([(1, long, "en", "s1", 1, "x"), (1, long, "en", "s1", 1, "x"), (2, long + " ", "en", "s1", 1, "x"), (3, "", "en", "s1", 1, "x"), (None, long, "en", "s1", 1, "x")], {2, None}),
    }
    for name, (rows, want) in tables.items():
        folder = tmp_path / name
        spark.createDataFrame([(*r, "p", "q", 5, 6, 0) for r in rows], schema).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in pipeline.STAGES[:3]:
            docs = pipeline.stored(stage(spark, docs, str(folder)), "stage")
            assert docs.columns == names
        assert {r.doc_id for r in docs.collect()} == want, name
        assert {r.doc_id for r in pipeline.run(spark, str(folder)).collect()} <= want
