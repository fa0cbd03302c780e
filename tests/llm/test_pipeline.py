"""The pipeline's stages, each on its own input, against brute force."""

import itertools
import re

import corpus_pipeline
from pricemap.llm import langid, repetition
from pricemap.llm.store import saved


def shingles(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def near_copies_removed(docs):
    """doc_ids that stay: the smallest of each group of all pairs' links."""
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    parent = {d: d for d, _ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if 5 * len(x & y) >= 4 * len(x | y):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {root(d) for d, _ in rows}


def without_passages(docs, benchmark, n=10):
    """doc_ids of the texts that hold no window of an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in benchmark.collect():
        own = words(r.text)
        windows |= {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))} if own else set()
    sizes = {len(w) for w in windows}
    clean = set()
    for r in docs.collect():
        own = words(r.text)
        if not any(tuple(own[k : k + s]) in windows for s in sizes for k in range(len(own) - s + 1)):
            clean.add(r.doc_id)
    return clean


def test_stages_and_run(spark, small):
    docs, places = spark.read.parquet(f"{small}/documents.parquet"), ["doc_id", "piece", "start", "length", "ids_crc32"]
    names, ids = docs.columns, lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, small), name)
        assert out.columns == names and out.exceptAll(docs).count() == 0, name
        if name == "language_id":
            told = langid.keep_identified(docs, least_probability=0.5)
            assert ids(out) == ids(told) and not ids(docs.filter("trim(text) = ''")) & ids(out)
        elif name == "quality_rules":
            assert ids(out) == ids(repetition.quality_rules(docs).filter("kept"))
        elif name == "near_duplicates":
            assert ids(out) == near_copies_removed(docs) and out.count() < docs.count()
        else:
            assert ids(out) == without_passages(docs, spark.read.parquet(f"{small}/benchmark.parquet")) and out.count() < docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    table = packed.toPandas()
    assert set(table["doc_id"]) == ids(docs) and (table.groupby("sequence_id")["length"].sum() <= 2048).all()
    run = corpus_pipeline.run(spark, small)
    assert sorted(run.select(places).collect()) == sorted(packed.select(places).collect())
    assert run.agg({"sequence_id": "max"}).first()[0] == table["sequence_id"].max()


def test_empty_and_odd_tables(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    for data in ([], [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", None, 3)]):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, small), "odd")
        assert docs.count() == 0


def test_near_duplicates_are_found_by_fingerprints_first(spark, small, monkeypatch):
    from pricemap.llm import simhash

    made, real = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *args: made.append(real(*args)) or made[-1])
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[150:]), "alone here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect())
    nodes = dict(simhash.distinct_documents(docs).select("__node", "__row.doc_id").collect())
    assert kept == [0, 2, 3] and [sorted((nodes[r.src], nodes[r.dst])) for r in made[0].collect()] == [[0, 1]]
