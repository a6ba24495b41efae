"""Operators against plain Python versions on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogrid.llm import bpe, exact_dedup, html_text, line_dedup, minhash_dedup, mtree, packing, quality, substring_dedup, suffix_dedup
from chronogrid.llm.tokens import default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(70)
    rows = [(i, "\n".join(prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(100 + i, prose(rng.randint(0, 9)) + " " + shared + "\n" + prose(rng.randint(0, 9))) for i in range(25)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(250 + i, rows[i][1].replace(" ", "  ", 2) + " x") for i in range(8)]
    return rows + [(300, None), (301, ""), (302, " \n\t"), (303, "é" * 300), (304, "ab " * 400), (305, prose(4000)), (306, "x" * 5000)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "a", "b") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_removed string").repartition(5)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_exact_dedup(table):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in texts():
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(table).collect()}
    for i, t in texts():
        g = groups[norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(g)[1], len(g), min(g)[1] == i, sha(norm(t)))


def test_exact_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(-1, -1, True), (-1, 5, False), (5, 5, True)]


def test_substring_dedup(table):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table).collect()}
    seen = set()
    for i, t in sorted(texts()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        assert (got[i].text, got[i].n_removed) == (" ".join(x for x, g in zip(w, gone) if not g), sum(gone))


def test_suffix_dedup(table):
    count = {}
    raw = {i: (t or "").encode() for i, t in texts()}
    for b in raw.values():
        for a in range(len(b) - 199):
            count[b[a : a + 200]] = count.get(b[a : a + 200], 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(table).collect()}
    for i, b in raw.items():
        off = bytearray(len(b))
        for a in range(len(b) - 199):
            if count[b[a : a + 200]] > 1:
                off[a : a + 200] = b"\1" * 200
        assert (bytes(got[i].kept), got[i].n_removed) == (bytes(x for x, o in zip(b, off) if not o), sum(off))


def test_multikey_sort():
    keys = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    keys[250:] = keys[:250] + (np.arange(250) % 3 == 0)[:, None].astype(np.uint64) * np.uint64(256)
    order = suffix_dedup.multikey_sort(keys)
    rows = [keys[i].astype(">u8").tobytes() for i in order]
    assert rows == sorted(rows)
    common = [next((k for k in range(32) if a[k] != b[k]), 32) for a, b in zip(rows, rows[1:])]
    assert suffix_dedup.common_prefixes(keys, order).tolist() == [0, *common]


def test_line_dedup(table):
    lines = [(i, n, WORD.findall(x)) for i, t in sorted(texts()) for n, x in enumerate((t or "").split("\n"))]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        s, w = sorted((a, b), key=len)
        return any(w[:k] + w[k + 1 :] == s for k in range(len(w)))

    gone = {}
    for k, (i, n, w) in enumerate(lines):
        if w and any(near(w, v) for _, _, v in lines[:k] if v):
            gone.setdefault(i, set()).add(n)
    got = {r.doc_id: r for r in line_dedup.line_dedup(table).collect()}
    for i, t in texts():
        assert got[i].text == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(i, ()))


def test_near_groups(table):
    rows = [(i, [w.lower() for w in WORD.findall(t or "")]) for i, t in texts()]
    sets = {i: set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set()) for i, w in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in ids):
            break
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(table, shingle=3, percent=85).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def test_bpe_and_packing(spark, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    rng = random.Random(4)
    rows = texts() + [(400, "<|endoftext|>a <|endoftext|>"), (401, "it's  \n \n we'll   x ")] + [(500 + i, "".join(rng.choice(" \n\tab'sé1!\x85|<") for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    for r in bpe.bpe_decode(bpe.bpe_encode(df)).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id]
        assert r.decoded == (dict(rows)[r.doc_id] or "")
    pieces, bins = {}, {}
    for r in packing.pack(df).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in ids.items():
        joined = b"".join(x for _, x, _ in sorted(pieces[i]))
        assert np.frombuffer(joined, "<u4").tolist() == [*t, 0] and {n for *_, n in pieces[i]} == {len(t) + 1}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024


def test_pages_of_several_levels():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 40, (3000, 8)) + 90 * rng.integers(0, 3, (3000, 1)))
    x[1000:1100] = x[:100] * 2
    ids = [[i] if i % 7 else [i, i + 5000, i + 9000] for i in range(3000)]
    big = float((x * x).sum(1).max())
    page = mtree.Page.read(mtree.Page(x, ids, big, leaf=20, fan=4).stored())
    assert len(page.nodes) > 100
    flat = [(i, row) for row, own in enumerate(ids) for i in own]
    for own in range(0, 3000, 50):
        scores = x @ x[own]
        want = sorted((-scores[row], i) for i, row in flat if i != own)[:5]
        for least in (-np.inf, -want[-1][0]):
            assert [(-s, i) for s, i in page.search(x[own], own, 5, big, least)] == want


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(30)]
    bad = [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (None, [1.0] * 8)]
    got = {}
    for r in mtree.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), page_rows=50, pivots=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    for q in (i for i in v if i % 50 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:5]
        assert sorted(got[q]) == [(n + 1, c, -s) for n, (s, c) in enumerate(best)]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    right, n = out.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count(F.lit(1))).first()
    assert n > 100 and right / n > 0.97


def test_main_text(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><div class='sidebar'>side, bar</div><article><h1>Title &amp; more</h1><p>First, a   long paragraph of words that goes on, and on, for a while.<p>Second paragraph, also of a good length, with commas.</article><div id=comments><p>A reader, who comments at some length, here.</p></div><footer>foot</footer></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "<p>unclosed")]
    got = {r[0]: r[1] for r in html_text.extract(spark.createDataFrame(rows, "id long, html string")).select("id", "text").collect()}
    assert got[1] == "Title & more\nFirst, a long paragraph of words that goes on, and on, for a while.\nSecond paragraph, also of a good length, with commas."
    assert got[2] == got[3] == ""


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for f in (exact_dedup.exact_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, line_dedup.line_dedup, bpe.bpe_encode, packing.pack, lambda d: mtree.top_k(d.selectExpr("doc_id as vec_id", "array(1.0d) as embedding"))):
        assert f(df).count() == 0


def test_near_groups_edited_copies(spark):
    """Many copies of one text, each with words of its own: links lie on both sides of the threshold."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(150)] = f"n{rng.randrange(2000)}"
        rows.append((i, " ".join(w)))
    sets = {i: set(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == {i: find(i) for i in sets}
    assert 20 < len(set(got.values())) < 130


def test_prefix_lengths():
    """Of any two sizes that may be linked, both search one class far enough for their least intersection."""
    for percent in (80, 85):
        for n in range(1, 400):
            for m in range(-(-percent * n // 100), n + 1):
                t = -(-percent * (n + m) // (100 + percent))
                if t > m:
                    continue
                small = {c: reach for c, reach, is_small in minhash_dedup.prefix_lengths(m, percent) if is_small}
                large = {c: reach for c, reach, is_small in minhash_dedup.prefix_lengths(n, percent) if not is_small}
                (c, reach), = small.items()
                assert reach >= m - t + 1 and large[c] >= n - t + 1


def test_line_dedup_permuted_lines(spark):
    """Lines that differ by the order of words between equal ones aren't taken for each other."""
    line = lambda *w: "Sizes on offer today | " + " | ".join(w)
    rows = [(1, line("small", "medium", "large", "huge")), (2, line("medium", "small", "large", "huge")), (3, line("medium", "small", "large", "tiny"))]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_dedup_of_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: every row is a document, and only its own copies go."""
    name = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    own = [name(k) for k in "abcdefg"]
    rows = [(None, name("p") + " " + own[0]), (None, name("p") + " " + own[1]), (None, own[2]), (7, name("q") + " " + own[3]), (7, name("q") + " " + own[4]), (7, own[5]), (9, own[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.text.split()[-60:], r.n_words, r.n_removed, r.doc_id) for r in substring_dedup.substring_dedup(df).collect())
    assert [" ".join(w) for w, *_ in got] == own and [i for *_, i in got] == [i for i, _ in rows]
    cut = [n for _, _, n, _ in got]
    assert sorted(cut[:2]) == sorted(cut[3:5]) == [0, 60] and cut[2] == cut[5] == cut[6] == 0
    assert sorted((bytes(r.kept).decode(), r.doc_id) for r in suffix_dedup.suffix_dedup(df).collect()) == [(t, i) for t, (i, _) in zip(own, rows)]
    lines = [(None, own[0] + "\n" + own[1]), (None, own[2] + "\n" + own[0] + " x"), (7, own[3] + "\n" + own[4]), (7, own[5] + "\n" + own[3]), (7, own[6])]
    got = line_dedup.line_dedup(spark.createDataFrame(lines, "doc_id long, text string").repartition(3)).collect()
    left = sorted(x.removesuffix(" x") for r in got for x in r.text.split("\n"))
    assert left == own and sum(r.n_removed for r in got) == 2


def test_near_dedup_of_null_ids(spark):
    """One row of each group stays, also where ids are null or repeated."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (5, text("c")), (6, text("d")), (6, text("d")), (6, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.text, r.doc_id) for r in minhash_dedup.near_dedup(df).collect())
    assert kept == [(text("a"), None), (text("b"), None), (text("c"), 5), (text("d"), 6), (text("e"), 6)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_groups(df).collect())
    assert got == [(0, 0, False), (0, 0, True), (0, 0, True), (0, 5, False), (5, 5, True), (6, 6, False), (6, 6, True), (6, 6, True)]


def test_every_vector_length_is_searched(spark):
    assert mtree._lengths(spark.range(1, 1501).selectExpr("cast(id as int) as _d")) == list(range(1, 1501))


def test_sketches_refuse_nearly_no_pair_at_the_threshold():
    """Chance that a pair at the threshold differs in more bits than allowed: by the number of samples that differ, two toggles each."""
    cells, samples = minhash_dedup.SKETCH, 256
    for least in (0.8, 0.85):
        odd = np.zeros(cells + 1)
        odd[0] = 1.0
        more, limit, up = 0.0, minhash_dedup.most_bits(samples, least), 1 - np.arange(cells + 1) / cells
        for d in range(samples + 1):
            more += math.comb(samples, d) * (1 - least) ** d * least ** (samples - d) * odd[limit + 1 :].sum()
            for _ in range(2):
                odd = np.concatenate([[0.0], (odd * up)[:-1]]) + np.concatenate([(odd * (1 - up))[1:], [0.0]])
        print(least, limit, more)
        assert more < 1e-7


def test_top_k_of_large_components(spark):
    """Products beyond the exact range of doubles are exact; what needn't fit a long is an error."""
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2_000_000, 2_000_000)) for _ in range(6)]) for i in range(120)]
    rows += [(200, rows[50][1][:5] + [rows[50][1][5] + 1 / 256])]
    got = {}
    for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), page_rows=20, pivots=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {i: [math.floor(256 * a) for a in x] for i, x in rows}
    assert set(got) == {0, 50, 100, 200}
    for q in got:
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        assert sorted(got[q]) == [(n + 1, c, -s) for n, (s, c) in enumerate(best)]
    for huge in (1e12, 1e308):
        with pytest.raises(ValueError, match="long"):
            mtree.top_k(spark.createDataFrame([(0, [huge, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))


def test_top_k_over_many_rings(spark):
    """Pages cut by distance from their pivot, several rings and parts of rings for each pivot."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (1500, 4)) * rng.uniform(0.1, 3, (1500, 1))
    got = {}
    for r in mtree.top_k(spark.createDataFrame([(i, list(map(float, a))) for i, a in enumerate(x)], "vec_id long, embedding array<double>"), page_rows=5, pivots=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(256 * x).astype(int)
    for q in range(0, 1500, 50):
        s = v @ v[q]
        best = sorted((-int(s[c]), c) for c in range(1500) if c != q)[:5]
        assert sorted(got[q]) == [(n + 1, c, -s) for n, (s, c) in enumerate(best)]


def _thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_cancel_in_polynomials(spark):
    """The Thue-Morse word and its complement are different words, whatever the hash."""
    a, b = _thue_morse(11)
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}"), (4, " ".join([a, b, a, b, b, a])), (5, a + "x" * 300), (6, b + "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 20, 4: 0, 5: 0, 6: 0}
    assert {r.doc_id: r.n_shingles for r in minhash_dedup.near_groups(df.filter("doc_id = 4"), shingle=3, percent=85).collect()} == {4: 4}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df.filter("doc_id in (5, 6)")).collect()}
    raw = {i: t.encode() for i, t in rows[4:]}
    places = {}
    for i, t in raw.items():
        for s in range(len(t) - 199):
            places.setdefault(t[s : s + 200], []).append((i, s))
    off = {i: set() for i in raw}
    for spots in places.values():
        if len(spots) > 1:
            for i, s in spots:
                off[i].update(range(s, s + 200))
    assert got == {i: len(x) for i, x in off.items()}


def test_equal_hashes_of_different_windows():
    """Windows are told apart by their bytes, even where every hash is the same."""
    data = np.frombuffer(b"abcdabcdabxdabcd", np.uint8)
    at = np.arange(13)
    first, twice = suffix_dedup.alike(np.zeros(13, np.uint64), data, at, np.arange(16), np.arange(16) + 4)
    texts = [data[i : i + 4].tobytes() for i in at]
    assert twice.tolist() == [texts.count(t) > 1 for t in texts]
    assert [texts[i] for i in first] == texts
    found = np.zeros(13, [("h", "<u8"), ("d", "<i8"), ("s", "<i4")])
    found["s"] = at
    assert substring_dedup.later(found, data, at, np.arange(16), np.arange(16) + 4).tolist() == [t in texts[:i] for i, t in enumerate(texts)]


PROSE = ["First comes a paragraph, of some length, about one thing and another, so that it counts.", "Short one.", "Then another, with commas, clauses, and more words than anyone would care to read, at length."]


def _body(paragraphs=PROSE):
    return "".join(f"<p>{p}</p>" for p in paragraphs)


PAGES = {
    "no article": (f"<body><div id=menu><ul><li><a href=a>Home</a><li><a href=b>More</a></ul></div><div id=c>{_body()}</div><div id=footer>All rights</div></body>", PROSE),
    "bare paragraphs": (f"<nav><a href=a>x</a></nav>{_body()}<footer>foot</footer>", PROSE),
    "two parts": (f"<article><h1>Title</h1><div>{_body()}</div><div>{_body(['Second part, which is as long, as rich in commas, and as fine, as the first one was, by and large.'])}</div></article>", ["Title", *PROSE, "Second part, which is as long, as rich in commas, and as fine, as the first one was, by and large."]),
    "title above": (f"<div><header><h1>Title</h1></header></div><main><h1>Big</h1><div>{_body()}</div></main>", ["Big", *PROSE]),
    "link list beside": (f"<div><div>{_body()}</div><div><p><a href=1>One long link, with words, that leads away</a></p><p><a href=2>Another long link, with words, elsewhere</a></p></div></div>", PROSE),
    "stray quote": (f"<div><p title=\"it\"s\">{PROSE[0]}</p><p>{PROSE[2]}</p></div>", [PROSE[0], PROSE[2]]),
    "legal paragraph": (f"<div>{_body()}<p class=legal>The legal side of it, which is long, and belongs to the text, has its own paragraph.</p></div>", [*PROSE, "The legal side of it, which is long, and belongs to the text, has its own paragraph."]),
    "tags and foot": (f"<div>{_body()}<div class=tags><a href=1>red</a> <a href=2>blue</a></div><div class=foot>Printed in 1999</div></div>", PROSE),
    "comments": (f"<article>{_body()}</article><section id=comments><p>A reader, at length, with commas, about what was said above, and more.</p></section>", PROSE),
    "comments inside": (f"<article>{_body()}<div class='comment-list'><p>A reader, at length, with commas, about what was said above, and more.</p></div></article>", PROSE),
    "hidden": (f"<div>{_body()}<p hidden>Nobody, nowhere, sees this, or should.</p><p style='display: none'>Nor this, or that, at all.</p></div>", PROSE),
    "cookie notice": (f"<div role=dialog><p>We use cookies, as all do, and ask for consent, as all must.</p></div><div class='cookie-bar'>Cookies, again, and again.</div><div>{_body()}</div>", PROSE),
    "advert": (f"<article><p class=ad>Buy this, now, for less, while it lasts, and be happy.</p>{_body()}<div class='sponsored'>More, to buy.</div></article>", PROSE),
    "form": (f"<div>{_body()}<form><label>Mail</label><input><button>Go</button> Please, do, enter it here.</form></div>", PROSE),
    "scripts": (f"<div><script>var a = '<p>no, no, no</p>';</script><style>p {{}}</style>{_body()}<noscript>Turn it on, please.</noscript></div>", PROSE),
    "references": ("<div><p>Fish &amp; chips, &lt;here&gt;, cost &pound;5 &#8212; or so they say, in the town.</p></div>", ["Fish & chips, <here>, cost £5 — or so they say, in the town."]),
    "white space": ("<div><p>One\n  two\t three,\r\n four, five,   six and <b>seven</b>, and so on.</p></div>", ["One two three, four, five, six and seven, and so on."]),
    "unclosed": (f"<div><p>{PROSE[0]}<p>{PROSE[2]}<b><p>{PROSE[1]}</div>", [PROSE[0], PROSE[2], PROSE[1]]),
    "unclosed comment": (f"<div>{_body()}<!-- <p>never, ever, shown, though long</p></div>", PROSE),
    "list": (f"<div>{_body()}<ul><li>An item, of some length.<li>Another item, as long.</ul></div>", [*PROSE, "An item, of some length.", "Another item, as long."]),
    "table": (f"<table><tr><td>{_body()}</td><td class=sidebar><a href=a>x</a></td></tr></table>", PROSE),
    "less than": ("<div><p>If a < b, and c > d, then a + c < b + c, as is well known.</p></div>", ["If a < b, and c > d, then a + c < b + c, as is well known."]),
    "upper case": (f"<DIV><P>{PROSE[0]}</P><P CLASS='AD'>Buy, buy, buy, this is an advert.</P></DIV>", [PROSE[0]]),
    "related": (f"<article>{_body()}</article><aside><p>Beside, and apart, at some length, it stands, and is left.</p></aside><div class=related><p>Read this, too, and that, and the other, all day.</p></div>", PROSE),
    "nothing": ("<nav><a href=x>Home</a></nav><script>1</script>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == "\n".join(want)


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<a b='x\"", "<", "</", "<b>", "<div>", "<p>x", "<!--", "<li>", "<svg>", "a&"])
def test_pages_take_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 6


def test_blank_and_long_texts(spark):
    """A megabyte of blanks, one long word, and long prose pass through every operator on texts."""
    rng = random.Random(9)
    rows = [(1, " " * 1_000_000), (2, "x" * 1_000_000), (3, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 10**6)) for _ in range(120_000))), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.n_words for r in substring_dedup.substring_dedup(df).collect()} == {1: 0, 2: 1, 3: 120_000, 4: 0, 5: 0}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df).collect()} == {1: 1_000_000, 2: 1_000_000, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_groups(df).collect()} == {i: i for i, _ in rows}
    sizes = {r.doc_id: r.n_tokens for r in bpe.bpe_encode(df).collect()}
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: (r.n, r.t) for r in packed} == {i: (n + 1, n + 1) for i, n in sizes.items()}
    assert line_dedup.line_dedup(df).count() == exact_dedup.exact_dedup(df).count() == 5


def test_packing_cuts_little(spark):
    """Documents that fit a sequence are mostly whole, splinters are whole documents, and sequences are full."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs.coalesce(1)).collect()
    n = {}
    for r in rows:
        n.setdefault(r.doc_id, []).append(r.length)
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert all(sum(x) == total[i] for i, x in n.items())
    assert all(r.length >= 16 or r.length == r.doc_tokens for r in rows)
    fit = [i for i in n if total[i] <= 1024]
    assert sum(len(n[i]) > 1 for i in fit) < 0.6 * len(fit)
    assert sum(r.length for r in rows) > 0.97 * 1024 * len({r.sequence_id for r in rows})


def test_html_nesting_takes_linear_time():
    import time

    for page in (lambda n: "<li><ul>" + "<div>" * n + "<li>a" * n, lambda n: "<div><i><div>" + "<b>" * n + "x, y</i>" * n, lambda n: "<p>word, <a href=q>" * n):
        began = time.time()
        html_text.main_text(page(40_000))
        assert time.time() - began < 10


def test_html_end_tags_and_implied_ends():
    def tree(n):
        return n.tag, [k if isinstance(k, str) else tree(k) for k in n.kids]

    read = lambda s: tree(html_text.read_tree(s))[1]
    assert read("<i><div><b>x</i>y</b>z</div>") == [("i", []), ("div", [("b", ["x", "y"]), "z"])]  # a block ends inline elements, their end tag no block
    assert read("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("ul", [("li", ["a", ("ul", [("li", ["b"]), ("li", ["c"])])]), ("li", ["d"])])]
    assert read("<p>a<p>b</x></p>") == [("p", ["a"]), ("p", ["b"])]
    assert read("<table><tr><td>a<tr><td>b</table>") == [("table", [("tr", [("td", ["a"])]), ("tr", [("td", ["b"])])])]
