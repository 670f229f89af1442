"""Operators that compare documents: lines, near-duplicates, packing, mixing, search, substrings, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tanadex.llm import components, lines, mixing, packing, quality, queries, retrieval, simhash, substrings
from tests.check_tool import compare, connect
from tests.llm.helpers import TINY, awkward, empty, frame, words


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_with_sql(spark, name):
    verdict = compare(spark, connect(TINY), TINY, name, queries.QUERIES[name], queries.CHECKS[name])
    assert verdict.startswith("ok "), verdict


def brute_lines(rows, host, text):
    pages, hold = Counter(), Counter()
    for r in rows:
        pages[host(r)] += 1
        for x in {x.strip(" \t\n\x0b\x0c\r") for x in (text(r) or "").split("\n")} - {""}:
            hold[host(r), x] += 1
    out = []
    for r in rows:
        kept, n = [], 0
        for x in (text(r) or "").split("\n"):
            bare = x.strip(" \t\n\x0b\x0c\r")
            n += bare != ""
            if not bare or hold[host(r), bare] < lines.MIN_PAGES or hold[host(r), bare] <= lines.MAX_RATIO * pages[host(r)]:
                kept.append(x)
        out.append((r[0], n, len((text(r) or "").split("\n")) - len(kept), None if text(r) is None else "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    rows = awkward(20) + [(200 + k, f"own {k}\n  common\nrare {k % 25}\n\n{'common' * (k % 2)}", "en", rng.choice(["a", "b", None]), 1)
                          for k in range(60)]
    got = lines.without_boilerplate(frame(spark, rows), F.col("source"), F.col("text")).select(
        "row.doc_id", "n_lines", "n_dropped", "text").collect()
    want = brute_lines(rows, lambda r: r[3] or "", lambda r: r[1])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(r[2] for r in want)
    assert lines.without_boilerplate(empty(spark), F.col("source"), F.col("text")).count() == 0


def test_pipeline_drops_template_lines_of_every_source(spark):
    """A line on 8, 10 or 13 of 100 documents of a source goes; short fragments and rarer lines stay."""
    rows = []
    for s, often in (("a", 8), ("b", 10), ("c", 13)):
        for k in range(100):
            text = [f"own line {s} {k}", "one template line of the site" if k < often else "", "de" if k % 2 else "",
                    " two\twords " if k % 3 else "", "a rarer line here" if k < 5 else ""]
            rows.append((len(rows), "\n".join(text), "en", s, 1))
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), TINY).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if x != "one template line of the site") for d, t, *_ in rows}


def brute_print(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(low)
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[k:k + shingle]).encode(), 42) for k in range(max(1, len(ws) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    values = sorted(set(prints))
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v
    a = np.array(values, np.uint64)
    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[k] ^ a[k + 1:]) <= 3).tolist():
            up[max(top(v), top(values[k + 1 + j]))] = min(top(v), top(values[k + 1 + j]))
    return {v: top(v) for v in values}


def check_near(docs, rows):
    got = docs.collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    top, least = brute_components(prints), defaultdict(list)
    for (d, *_), p in zip(rows, prints):
        least[top[p]].append(d)
    want = [(d, p, min((x for x in least[top[p]] if x is not None), default=None)) for (d, *_), p in zip(rows, prints)]
    assert sorted(map(repr, [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got])) == sorted(map(repr, want))


def test_near_duplicates_against_brute_force(spark):
    rng, rows = random.Random(7), awkward(20)
    base = [rng.choice(["tion", "ther", "ing", "and", "of", "st", "ou"]) + str(rng.randint(0, 9)) for _ in range(250)]
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(250)] = f"w{k}"
        rows.append((1000 + k, " ".join(copy), "en", "a", 1))
    check_near(simhash.near_duplicates(frame(spark, rows)), rows)
    left = simhash.one_of_each(frame(spark, rows)).collect()
    groups = {r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(g for g in groups if g is not None)
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [2048, 4])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, limit):
    """Dense groups of fingerprints, with and without split buckets."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    rng, prints = random.Random(limit), set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            p = center
            for b in rng.sample(range(64), rng.randint(0, 6)):
                p ^= 1 << b
            prints.add(p)
    signed = [(p - (p >> 63 << 64),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"))
    pairs = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links.collect()]
    assert all(bin(a ^ b).count("1") <= 30 for a, b in pairs)
    top = brute_components(prints)
    assert all(top[a] == top[b] for a, b in pairs)
    found = {r.node: r.root for r in components.components(links).collect()}
    groups, mine = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[top[p]].add(p)
        s = p - (p >> 63 << 64)
        mine[found.get(s, s)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    rows = [(k, k + 1) for k in range(0, 60)] + [(100, 100), (None, 3), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 200, 201: 200}


def check_packed(packed, docs):
    """Pieces are the documents' ids, sequences hold no more than they may, places have no gaps."""
    from tokenizers import Tokenizer
    import public_tokenizers
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for d, t in docs:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())] += 1
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    return len(sequences), -(-sum(r.length for r in rows) // 4096)


def test_packing_whole_table_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    used, least = check_packed(packing.pack(docs), docs.select("doc_id", "text").collect())
    assert used <= 1.02 * least + 1
    rows = awkward(10) + [(70, "<|endoftext|> I'll x\x01y é Straße", "en", "a", 1)]
    check_packed(packing.pack(frame(spark, rows)), [r[:2] for r in rows])
    assert packing.pack(empty(spark)).count() == 0


def test_genetic_search_mends_a_bad_grouping():
    rng = np.random.default_rng(1)
    size = [2730, 1366, 2048, 2048, 3000, 1096, 1500, 1500, 1096] * 20
    bad = [[k] for k in range(len(size))]
    best = packing.evolve(size, [bad], 3)
    assert sorted(i for b in best for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 4096 for b in best)
    assert len(best) <= 1.1 * -(-sum(size) // 4096)
    child = packing.crossover(best, packing.mutated(best, size, rng), size, rng)
    assert sorted(i for b in child for i in b) == list(range(len(size)))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark):
    rows = awkward(80) + [(500, "tiny source", "en", "z", 1), (501, " ", "en", "none", 1)]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = Counter()
    for d, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want, taken = brute_targets(sizes), Counter()
    assert sorted(map(repr, [(r.doc_id, r.source, r["size"], r.source_size) for r in got])) == sorted(
        map(repr, [(d, s, len(words(t)), sizes[s]) for d, t, _, s, _ in rows]))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    key = lambda rs: sorted(repr((r.doc_id, r.source, r["size"], r.taken)) for r in rs)
    assert key(again) == key(got)
    texts = mixing.mixed_documents(frame(spark, rows)).collect()
    assert sum(len(words(r.text)) for r in texts) == sum(taken.values())
    assert texts[0].asDict().keys() == frame(spark, rows).first().asDict().keys() and all(r.n_chars == len(r.text) for r in texts)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mix_deals_sources_to_shards(spark, monkeypatch):
    """The output names the shards of a document's words, and the slots of a source fall to them as drawn, not evenly."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    found, wants = defaultdict(Counter), Counter()
    for r in rows:
        assert r.taken == sum(s.taken for s in r.shards) and all(s.taken > 0 for s in r.shards)
        wants[r.source] = r.target
        for s in r.shards:
            found[r.source][s.shard] += s.taken
    assert all(abs(sum(found[s].values()) - wants[s]) <= 1 for s in wants)
    n = 1 + max(x for c in found.values() for x in c)
    assert n > 20 and all(0 <= x < n for c in found.values() for x in c)
    chi, free = 0.0, 0
    for s, c in found.items():
        slots = wants[s] / mixing.BLOCK  # nearly: a few slots are short
        chi += sum((c[x] / mixing.BLOCK - slots / n) ** 2 for x in range(n)) / (slots / n)
        free += n - 1
    assert 0.85 * free < chi < 1.15 * free
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1024])
def test_permutation_is_one_to_one(spark, size):
    got = [r[0] for r in spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit("k"))).collect()]
    assert sorted(got) == list(range(size)) and (size < 100 or got != list(range(size)))


def brute_search(rows):
    usable = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (q, a) in enumerate(usable):
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(usable) if j != k and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5])]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 16])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = random.Random(4)
    vec = lambda n, s=1.0: [rng.gauss(0, s) for _ in range(n)]
    rows = [(k, vec(8, rng.choice([.01, .3, 1, 5]))) for k in range(260)]
    rows += [(300 + k, [0.5] * 8) for k in range(60)] + [(400, [0.0] * 8), (450, [0.0] * 8), (500, vec(3)), (501, vec(3)), (550, [])]
    rows += [(600, None), (650, [None] * 8), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (None, vec(8)), (100, vec(8))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit(1)).withColumn("level", F.lit(2))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = retrieval.top_products(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_search(exact)
    assert retrieval.top_products(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_leaves_most_vectors_out():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(0, 1, (500, 4)) * rng.choice([.1, 1], (500, 1)))
    rows = rows[np.argsort(-(rows ** 2).sum(axis=1))]
    block = retrieval.Block(np.arange(500).tobytes(), np.arange(500).tobytes(), rows.tobytes(), 4)
    for q in rows[:40]:
        score = rows @ q
        theta = np.sort(score)[-5]
        left = np.arange(500)[block.candidates(q, float(np.sqrt(q @ q)), float(theta))]
        assert set(np.flatnonzero(score >= theta)) <= set(left.tolist()) and len(left) < 400


def brute_substrings(rows):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ws = words(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - 19):
            window = tuple(ws[k:k + 20])
            if window in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk", [400_000, 150])
def test_substrings_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    rng, rows = random.Random(6), awkward(20)
    passage = [f"p{k}" for k in range(120)]
    for k in range(50):
        a, n = rng.randrange(100), rng.randint(15, 40)
        own = [f"o{k}x{j}" for j in range(rng.randint(0, 60))]
        rows.append((2000 - k, " ".join(own[:20] + passage[a:a + n] + own[20:]), "en", "a", 1))
    rows += [(5000, " ".join(["again"] * 100), "en", "a", 1), (5001, "again " * 19, "en", "a", 1)]
    got = substrings.repeated_words(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_substrings(rows)
    assert substrings.repeated_words(empty(spark)).count() == 0


@pytest.mark.parametrize("length", [1, 3, 10, 20])
def test_rolling_hash(length):
    w = np.random.default_rng(1).integers(0, 2 ** 63, 60).astype(np.uint64)
    want = [sum(int(x) * pow(substrings.FIRST, length - 1 - k, 2 ** 64) for k, x in enumerate(w[i:i + length])) % 2 ** 64
            for i in range(61 - length)]
    assert (substrings.rolled(w, length, substrings.FIRST) == substrings.mixed(np.array(want, np.uint64))).all()


def test_pipeline_stages(spark):
    """Every stage against brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels = {r.doc_id for r in spark.read.parquet(f"{TINY}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]

    def after(name, df):
        out = corpus_pipeline.saved(stages[name](spark, df, TINY))
        assert name == "best_fit_packing" or out.schema.names == docs.columns
        return out, sorted(tuple(r) for r in out.collect())
    from tests.llm.test_words import brute_quality
    kept = {r[0] for r in brute_quality(rows, labels) if r[-1]}
    df, got = after("quality_rules", docs)
    assert got == sorted(r for r in rows if r[0] in kept) and got
    want = {d: t for d, _, _, t in brute_lines(got, lambda r: r[3], lambda r: r[1])}
    df, new = after("line_dedup", df)
    assert new == [(d, want[d], lang, s, len(want[d])) for d, _, lang, s, _ in got]
    top = brute_components([brute_print(r[1]) for r in new])
    least = {}
    for r in new:
        least.setdefault(top[brute_print(r[1])], r[0])
    df, left = after("near_dedup", df)
    assert left == [r for r in new if r[0] in least.values()]
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    df, mixed = after("source_mixing", df)
    assert {r[0]: len(words(r[1])) for r in mixed} == {d: n for d, n in taken.items() if n}
    source = {r[0]: words(r[1]) for r in left}
    assert all(set(words(r[1])) <= set(source[r[0]]) for r in mixed)
    packed, _ = after("best_fit_packing", df)
    used, most = check_packed(packed, [r[:2] for r in mixed])
    assert used <= 1.02 * most + 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, TINY).select("doc_id", "piece", "ids_crc32").collect())) == Counter(
        map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))
