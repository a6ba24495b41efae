"""The pipeline against plain Python versions of its stages, each on what its predecessor kept."""

import re

import corpus_pipeline
from chronogrid.llm.quality import score

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines(docs):
    seen, whole, less, out = set(), {}, {}, {}
    for i in sorted(docs):
        stay = []
        for x in docs[i].split("\n"):
            w = tuple(WORD.findall(x))
            gone = w in seen
            if len(w) >= 8:
                cut = [w[:k] + w[k + 1 :] for k in range(len(w))]
                gone = gone or any((k, c) in less for k, c in enumerate(cut)) or any(c in whole for c in cut) or w in less
                whole[w] = True
                for k, c in enumerate(cut):
                    less[(k, c)] = less[c] = True
            if w:
                seen.add(w)
            if not (w and gone):
                stay.append(x)
        out[i] = "\n".join(stay)
    return {i: t for i, t in out.items() if t == docs[i] or WORD.search(t)}


def groups(docs):
    low = {i: [w.lower() for w in WORD.findall(t)] for i, t in docs.items()}
    sets = {i: set(zip(*(w[k:] for k in range(5)))) if len(w) > 4 else ({tuple(w)} if w else set()) for i, w in low.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def substrings(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        w = WORD.findall(docs[i])
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        if w and all(gone):
            continue
        out[i] = " ".join(x for x, g in zip(w, gone) if not g)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in score(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    plain = [lambda d: {i: t for i, t in d.items() if i in kept}, lines, groups, substrings]
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        want = version(want)
        rows = docs.collect()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id: r.text for r in rows} == want, name
        assert all(r.n_chars == len(r.text) for r in rows)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for i in want:
        own = [r for r in pieces if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens
