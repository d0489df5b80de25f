"""Text operators against brute force on small tables with nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, mixing, quality, repeats, secrets, sharding, similar, simhash, surrogates, warc

DOCS = "doc_id long, text string, lang string, source string, `__size` string, n string, blob string"


def table(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "É", "ß"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 9, 12, 80, 300)))) for _ in range(60)]
    texts += [None, None, "", "", " \n\t", "one", "one two", texts[3], texts[3], texts[4] + " tail", " ".join(["again and again we say"] * 30), "x" * 70 + " " + "y" * 70, "\n".join(["same line here"] * 5 + ["", "other"])]
    longest = max(texts[:60], key=len)
    texts += [longest, longest, "head " + longest[:400] + " tail", " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    rows = [(i, t, rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3", None)), "kept", "n", "b") for i, t in enumerate(texts)]
    rows += [(None, texts[5], "en", "s1", "kept", "n", "b"), rows[7]]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prints(text):
    w = low(text).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    fps = [(r.doc_id, prints(r.text)) for r in rows]
    group = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    names = {}
    for (d, _), g in zip(fps, group, strict=True):
        if d is not None:
            names[g] = min(names.get(g, d), d)
    want = sorted(((str(d), f, names.get(g)) for (d, f), g in zip(fps, group, strict=True)), key=str)
    got = sorted(((str(r.doc_id), r["__fp"] % 2**64, r["__component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).columns == empty.columns


def test_near_duplicates_find_all_pairs_within_three_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # so that groups are compared by blocks
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f, [f]) for f in signed], "node long, fps array<long>"))
    from tidemark.llm.components import components

    root = {r.node: r.root for r in components(found).collect()}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                assert root[signed[i]] == root[signed[j]]


def _edges_of_odd_shapes():
    rng = random.Random(21)
    chain = [(k, k + 1) for k in range(100, 180)]
    star = [(500, k) for k in range(501, 560)]
    rest = [(rng.randrange(-(10**12), 10**12), rng.randrange(-50, 50)) for _ in range(60)]
    return [*chain, *star, *rest, (7, 7), (180, 501), (501, 180), (180, 501)]


@pytest.mark.parametrize("most", [500_000, 40])
def test_components_equal_brute_force(spark, monkeypatch, most):
    from tidemark.llm import components

    monkeypatch.setattr(components, "FOREST_EDGES", most)
    edges = _edges_of_odd_shapes()
    parent = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted(tuple(r) for r in found) == sorted(parent.items())
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()


def test_components_of_few_edges_need_no_rounds(spark):
    """A round's shuffles have as many tasks as there are partitions, however few edges there are."""
    from tidemark.llm.components import components

    sc = spark.sparkContext
    edges = spark.createDataFrame(_edges_of_odd_shapes(), "a long, b long").repartition(5)
    sc.setJobGroup("components", "")
    try:
        components(edges).collect()
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(key, None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("components")) <= 8


def test_drop_near_duplicates_keeps_one_of_similar_texts(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(10**6)}" for _ in range(400)] for _ in range(20)]
    data = [(2 * i, " ".join(b)) for i, b in enumerate(base)] + [(2 * i + 1, " ".join(b[:200] + ["changed"] + b[201:])) for i, b in enumerate(base)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(20)} <= kept and len(kept) <= 21


def test_drop_near_duplicates_equals_brute_force_at_08(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for k in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 200)))]
        texts += [" ".join(w)] + ["of one template"] * (k < 2)
        for _ in range(3):  # 0.6 to 1.0 of the shingles are shared
            v = list(w)
            for at in rng.sample(range(len(w)), rng.randrange(0, len(w) // 20 + 1)):
                v[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(v))
    base = [f"t{i}" for i in range(120)]  # a template that is shared by documents at about 0.7 and its near copies
    texts += [" ".join(base + [f"y{k}-{i}" for i in range(n)]) for k, n in enumerate([24] * 40 + [5] * 20)]
    rng.shuffle(texts)
    grams = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) or frozenset([t]) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = []
    for a in range(len(texts)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            seen.append(both / (len(grams[a]) + len(grams[b]) - both))
            if both * 10 >= 8 * (len(grams[a]) + len(grams[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {x for x in range(len(texts)) if find(x) == x}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == want
    assert all(any(lo <= s < lo + 0.05 for s in seen) for lo in (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9))
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "PAIRS", 8)
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == want


def test_bitmaps_bound_the_difference_of_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (5, 60, 70, 300, 5000):
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for changed in (0, n // 10, n // 2):
            y = np.unique(np.concatenate((x[changed:], rng.integers(0, 2**64, changed + n // 5, np.uint64))))
            maps = similar._Bitmaps([similar.parities(x), similar.parities(y), None])
            got = maps.differ(np.array([0, 1, 0]), np.array([1, 0, 2])).tolist()
            assert got[0] == got[1] <= len(np.setxor1d(x, y)) <= 1.5 * got[0] + 2 and got[2] == 0


def test_spanning_pairs_join_what_all_pairs_join():
    import numpy as np

    rng = np.random.default_rng(4)
    x, y, far, root = rng.integers(0, 80, 60), rng.integers(0, 80, 60), rng.random(60), rng.integers(0, 50, 80)
    near, parts = similar._spanning(x, y, far, root).tolist(), []
    for pairs in (range(60), near):
        top = {r: r for r in root.tolist()}
        for e in [*pairs] * 50:
            top[int(root[x[e]])] = top[int(root[y[e]])] = min(top[int(root[x[e]])], top[int(root[y[e]])])
        parts.append(top)
    assert parts[0] == parts[1] and len(near) == len(parts[0]) - len(set(parts[0].values()))
    cheapest = min((e for e in range(60) if root[x[e]] != root[y[e]]), key=lambda e: far[e])
    assert cheapest in near


def test_drop_near_duplicates_verifies_few_pairs_of_a_large_group(spark, monkeypatch):
    rng = random.Random(6)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(160):  # three changed words in 150: most pairs are at 0.65 to 0.8 and pass the prefix filter
        v = list(base)
        for at in rng.sample(range(5, 145), 3):
            v[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(v))
    grams = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for _ in range(12):
        for a in range(len(texts)):
            for b in range(a):
                both = len(grams[a] & grams[b])
                if both * 10 >= 8 * (len(grams[a]) + len(grams[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    verified, seen = similar._verified, []

    def counted(sets, pairs, size, least):
        pairs = similar.cut(pairs)
        seen.append(pairs.distinct().count())
        return verified(sets, pairs, size, least)

    monkeypatch.setattr(similar, "_verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {x for x in range(len(texts)) if root[x] == x}
    assert sum(seen) < 6 * len(texts), seen


def test_drop_near_duplicates_searches_simhashes_first(spark, monkeypatch):
    rng = random.Random(12)
    base = [[f"s{rng.randrange(10**6)}" for _ in range(300)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "changed"]) for b in base]
    sets = [similar.shingles(t.encode()) for t in texts]
    fps = [similar.fingerprint(s) for s in sets]
    assert all(f == sum((sum(int(h) >> b & 1 for h in s) * 2 > len(s)) << b for b in range(64)) - (f < 0) * 2**64 for f, s in zip(fps, sets, strict=True))
    close = {(a, b) for b in range(24) for a in range(b) if (fps[a] ^ fps[b] & 2**64 - 1).bit_count() <= 3 or fps[a] == fps[b]}
    assert len(close) >= 6
    node = dict(zip(similar.nodes_of([t.encode() for t in texts], 5), range(24), strict=True))
    links, found, verified, given = simhash.links, [], similar._verified, []

    def counted(prints, *more):
        found.append(prints.select("fps").collect())
        return links(prints, *more)

    def kept(sets, pairs, size, least):
        pairs = similar.cut(pairs)
        given.append({tuple(sorted((node[r.a], node[r.b]))) for r in pairs.collect()})
        return verified(sets, pairs, size, least)

    monkeypatch.setattr(simhash, "links", counted)
    monkeypatch.setattr(similar, "_verified", kept)
    monkeypatch.setattr(similar, "_min_keys", lambda sets, least: sets.sparkSession.createDataFrame([], "a long, b long"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(range(12))
    assert {r.fps[0] for r in found[0]} == set(fps) and close <= given[0]


def test_hot_keys_are_given_out_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similar, "HOT", 3)
    keys = [1] * 3 + [2] * 4 + [3] + [4] * 20 + [5] * 3 + [7] * 4
    for step in (1, 2, 5, 9, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + step], pa.int64())], ["key"]) for k in range(0, len(keys), step)]
        assert [r["key"] for b in similar._hot_keys(iter(batches)) for r in b.to_pylist()] == [2, 4, 7]


def test_drop_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(1)
    a, b, c, d, e = (" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    data = [(2, b, "r1"), (5, a, "r2"), (5, b, "r3"), (7, a, "r4"), (9, c, "r5"), (9, d, "r6"), (9, d, "r7"), (9, d, "r7"), (None, e, "r8"), (None, e, "r9"), (11, e, "r10"), (12, None, "r11"), (13, "", "r12"), (13, " ", "r13")]
    df = spark.createDataFrame(data, "doc_id long, text string, `__node` string")
    want = ["r1", "r10", "r11", "r2", "r5", "r6", "r8", "r9"]
    assert sorted(r["__node"] for r in simhash.drop_near_duplicates(df.repartition(3)).collect()) == want
    assert sorted(r["__node"] for r in simhash.drop_near_duplicates(df.coalesce(1)).collect()) == want
    unique = spark.createDataFrame([x for x in data if x[0] in (2, 7, 11, 12)], df.schema)
    assert sorted(r["__node"] for r in simhash.drop_near_duplicates(unique).collect()) == ["r1", "r10", "r11", "r4"]
    assert simhash.drop_near_duplicates(df.limit(0)).columns == df.columns and simhash.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1 << 14, 4])
def test_shared_keys_of_several_roots(monkeypatch, held):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similar, "HELD", held)
    rng = random.Random(3)
    rows = sorted({(rng.randrange(30), rng.randrange(4) if k % 3 else 0, rng.randrange(40)) for k in range(600)})  # key, root, node
    rows = [(k, n, 0, r) for k, r, n in dict.fromkeys((k, r, n) for k, r, n in rows)]
    rows += rows[-1:]
    batches, at = [], 0
    while at < len(rows):
        size = rng.choice((1, 2, 7, 50))
        batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.array(rows[at : at + size]).T], ["key", "node", "place", "root"]))
        at += size
    got = [tuple(r.values()) for b in similar._shared(iter(batches)) for r in b.to_pylist()]
    several = {k for k in range(30) if len({r[3] for r in rows if r[0] == k}) > 1}
    want = [r for r in dict.fromkeys(rows) if r[0] in several]
    assert len(got) == len(set(got)) and set(want) <= set(got)
    assert held < 5 or got == want


def test_mix_takes_near_the_targets(docs, rows, empty):
    out = mixing.mix(docs, keep=["doc_id", "source", "n"]).collect()
    assert sorted((str(r.doc_id), r["__size"]) for r in out) == sorted((str(r.doc_id), len(words(r.text))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, todo = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    open_ = set(order)
    while open_:
        share = todo / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3 * sizes[s] if full else share * weight[s]
        todo -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    longest = max(len(words(r.text)) for r in rows)
    for s in order:
        mine = [r for r in out if r.source == s]
        assert all(abs(r["__target"] - target[s]) < 1e-6 * max(1, target[s]) and r["__source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["__taken"] for r in mine) - target[s]) <= longest
    assert all(r["__taken"] <= 3 * r["__size"] for r in out) and sum(r["__taken"] for r in out) <= sum(sizes.values())
    assert sorted(map(str, mixing.mix(docs.repartition(3), keep=["doc_id", "source", "n"]).collect())) == sorted(map(str, out))
    assert mixing.mix(empty).count() == 0


def test_language_model_learns_and_labels_switches(docs, empty):
    rng = random.Random(3)
    make = lambda syllables: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    a, b = ("ka", "to", "mi", "ra"), ("schl", "ung", "eit", "ver")
    sample = {"aa": [[make(a) for _ in range(200)] for _ in range(10)], "bb": [[make(b) for _ in range(200)] for _ in range(10)]}
    model = langid.train(sample)
    mixed = [make(a) for _ in range(30)] + [make(b) for _ in range(30)]
    got = langid.label(model, [" ".join(mixed), " ".join(make(b) for _ in range(40)), "12 34 ...", "", "É"])
    assert (got[0][2].argmax(axis=1) == [0] * 30 + [1] * 30).mean() > 0.95
    assert got[1][0] == "bb" and got[1][1] > 0.9 and [g[0] for g in got[2:4]] == ["und", "und"] and got[4][0] != "und"
    out = langid.identify(docs, model).collect()
    assert len(out) == docs.count() and all((r["__lang"] == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r["__score"] <= 1 for r in out)
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty).langs == []


def test_seventy_languages_are_learned_and_judged(spark):
    rng = random.Random(12)
    make = lambda k, n: " ".join("".join(rng.choice("abcdefghijklmnop"[(k + j) % 16 :: 5]) for j in range(3)) + f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for _ in range(n))
    data = [(i, make(i % 70, 60), f"language {i % 70:02d}") for i in range(700)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    assert len(model.langs) == 70
    out = langid.identify(df, model).collect()
    assert sum(r["__lang"] == r.lang for r in out) > 0.9 * len(out)
    repeated = df.unionByName(spark.createDataFrame([(None, make(3, 30), "language 03")] * 500, df.schema))
    assert len(langid.fit(repeated, docs_per_lang=2).langs) == 70
    refs = quality.references(quality._features(df, "text", "lang", ["doc_id"]))
    assert refs.count() == 70 and all(1 <= len(r["__common"]) <= 16 and abs(sum(r["__ref_words"]) - 1) < 1e-9 for r in refs.collect())


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}?q=é", t) for i, t in enumerate(["<p>a</p>", "<p>a</p>", None, "", "b\r\n\r\nc" * 5000, "b"])] + [(None, None, "b"), (1, "again", "<p>a</p>"), (-7, "neg", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url is None) for r in warc.round_trip(df).collect()), key=str)
    first = {}
    for i, _, t in pages:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, u, t in pages:
        raw, revisit = (t or "").encode(), i != first[t or ""]
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[t or ""] if revisit else None, u is None))
    assert got == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in warc.round_trip(df, with_payload=True).filter("record_type = 'response'").collect()} == {t or "" for _, _, t in pages}
    assert warc.round_trip(df.limit(0)).count() == 0


def _foreign(names_files=True):
    """An archive that others might have written: two members of records, a gzip index of two members, a deflated one,
    lines out of order, a plain record, a warcinfo, a record without digest."""
    import io
    import json
    import zipfile
    import zlib

    def record(kind, i, body, digest=True, gz=True, http=True):
        block = (b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n" if http else b"") + body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-{i:012d}>\r\nContent-Length: {len(block)}\r\n"
        head += f"WARC-Target-URI: http://x/{i}\r\n" + ("Content-Type: application/http; msgtype=response\r\n" if http else "Content-Type: text/plain\r\n")
        head += f"WARC-Payload-Digest: sha1:{warc.payload_digest(body)}\r\n" if digest and kind != "revisit" else ""
        raw = head.encode() + b"\r\n" + block + b"\r\n\r\n"
        squeeze = zlib.compressobj(9, zlib.DEFLATED, 31)
        return squeeze.compress(raw) + squeeze.flush() if gz else raw

    one = [record("warcinfo", 0, b"software: x", http=False), record("response", 1, b"first"), record("revisit", 2, b"")]
    two = [record("response", 3, b"third " * 9, digest=False, gz=False), record("response", 4, b"fourth", gz=False)]
    lines = []
    for name, records in (("a.warc.gz", one), ("b.warc", two)):
        at = 0
        for k, r in enumerate(records):
            lines.append(f"com,x)/{k} 2024 " + json.dumps({"offset": str(at), "length": len(r)} | ({"filename": name} if names_files else {})) + "\n")
            at += len(r)
    lines.reverse()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(one))
        z.writestr("archive/b.warc", b"".join(two))
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"!meta 0 {}\n" + lines[0].encode()) + gzip.compress("".join(lines[1:3]).encode()))
        z.writestr("indexes/more.cdxj", "".join(lines[3:]), zipfile.ZIP_DEFLATED)
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def test_foreign_archives_are_read_by_their_indexes(spark, tmp_path):
    (tmp_path / "a.wacz").write_bytes(_foreign())
    archives = lambda name: spark.createDataFrame([(str(tmp_path / name),)], "archive string")
    got = {r.url[-1]: r for r in warc.read_archives(archives("a.wacz"), with_payload=True).collect()}
    assert {k: (r.record_type, r.payload_bytes, r.payload and bytes(r.payload), r.page_id) for k, r in got.items()} == {
        "0": ("warcinfo", 11, b"software: x", None), "1": ("response", 5, b"first", None), "2": ("revisit", 1, None, None),
        "3": ("response", 54, b"third " * 9, None), "4": ("response", 6, b"fourth", None),
    }
    assert got["3"].payload_digest == warc.payload_digest(b"third " * 9) and got["2"].payload_digest is None
    assert {(r.member, r.ok) for r in warc.verified(archives("a.wacz")).collect()} == {(m, True) for m in ("archive/a.warc.gz", "archive/b.warc", "indexes/index.cdx.gz", "indexes/more.cdxj", "datapackage.json")}


def test_broken_archives_stop_the_reader(spark, tmp_path):
    raw = _foreign()
    read = lambda raw: lambda at, n: raw[at : at + n]
    with pytest.raises(ValueError, match="names no member"):
        list(warc.places(read(_foreign(False)), len(_foreign(False))))
    spoilt = bytearray(raw)
    spoilt[raw.index(b"fourth")] ^= 1  # a payload
    (tmp_path / "b.wacz").write_bytes(spoilt)
    archives = spark.createDataFrame([(str(tmp_path / "b.wacz"),)], "archive string")
    assert {r.member for r in warc.verified(archives).filter("NOT ok").collect()} == {"archive/b.warc"}
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(archives).collect()
    index = warc.zip_directory(read(raw), len(raw))["indexes/index.cdx.gz"]
    spoilt = bytearray(raw)
    spoilt[warc.member_start(read(raw), index) + 4] ^= 1  # the time in the gzip header: only the member's checksum tells
    with pytest.raises(ValueError, match="checksum"):
        list(warc.places(read(bytes(spoilt)), len(raw)))


def test_records_of_a_large_archive_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 64)
    monkeypatch.setattr(warc, "PLACES", 7)
    pages = [(i, "u", f"page {i} " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    archives = spark.createDataFrame(warc.write_archives(df, str(tmp_path / "w")).collect())
    assert archives.count() == 1 and warc.located(archives).count() == 300
    assert sorted(r.page_id for r in warc.read_archives(archives).collect()) == list(range(300))


def test_zip_directory_reads_both_kinds(tmp_path):
    import io
    import zipfile

    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a/b", b"hello")
        z.writestr("c", b"")
    for raw in (plain.getvalue(), warc.build_zip([("a/b", b"hello"), ("c", b"")])):
        read = lambda at, n, raw=raw: raw[at : at + n]
        d = warc.zip_directory(read, len(raw))
        assert set(d) == {"a/b", "c"} and read(warc.member_start(read, d["a/b"]), 5) == b"hello"
        assert zipfile.ZipFile(io.BytesIO(raw)).read("a/b") == b"hello"


def test_secrets_and_ledger(spark, empty, tmp_path):
    key = "AKIA" + "Q7" * 9
    texts = [f'é password = "{"a1" * 8}" x', f"{key} token:secret=abcdefghijkl", "f" * 20 + " " + "0" * 15, None, "", f"{key} token:secret=abcdefghijkl", "token=api_key:abcdefghijklmnop", "ghp_" + "Z" * 36]
    df = spark.createDataFrame([(f"path{i % 5}", i, t) for i, t in enumerate(texts)], "path string, doc_id long, text string")  # some paths have two versions
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    spans = lambda d: {r.doc_id: [(s["start"], s["kind"], s["stop"]) for s in r["__spans"]] for r in d.collect()}
    got = spans(secrets.find_secrets(df, str(tmp_path / "one")))
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(base) for m in p.finditer(t or "") if len(m.group(g)) >= least)
        assert [s for s in got[i] if s[1] in secrets.BASE_KINDS] == [(a, n, b) for a, _, b, n in want]
    assert got[7] == [(0, "github", 40)]
    ledger, blobs = str(tmp_path / "two"), len(set(t or "" for t in texts))
    rows = lambda: sorted(r.version for r in secrets.read_ledger(spark, ledger).collect())
    assert rows() == []
    first = spans(secrets.find_secrets(df, ledger, versions=(1,)))
    assert rows() == [1] * blobs and first[7] == [] and first[0] == got[0]
    assert spans(secrets.find_secrets(df, ledger)) == got and rows() == [1] * blobs + [2] * blobs  # the new rules alone
    assert secrets.scan(df, ledger=secrets.read_ledger(spark, ledger)).count() == 0  # nothing is left to scan
    more = df.unionByName(spark.createDataFrame([("path0", 9, "new"), ("path9", 10, texts[1])], df.schema))
    assert spans(secrets.find_secrets(more, ledger)) == got | {9: [], 10: got[1]} and len(rows()) == 2 * blobs + 2  # one new blob, both versions
    assert secrets.find_secrets(empty, str(tmp_path / "none")).count() == 0
    clash = df.withColumnsRenamed({"path": "__spans"}).withColumn("__b", F.lit(1))
    out = secrets.find_secrets(clash, ledger)
    assert spans(out) == got and out.columns == ["doc_id", "text", "__b", "__blob", "__spans"]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_contamination_equals_brute_force(spark, docs, rows, empty, block):
    long = next(r.text for r in rows if r.text and len(r.text) > 50_000).split()
    items = [("a", " ".join(long[500:525])), ("b", " ".join(long[510:540]).upper()), ("c", "one two"), ("d", None), ("e", "..."), (None, " ".join(long[7000:7012])), ("a2", " ".join(long[500:525])), ("f", " ".join(long[40:60] + ["elsewhere"] + long[41:75]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i or "")
    want = []
    for r in rows:
        w, hit, found = pattern.findall(low(r.text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want.append((str(r.doc_id), len(w), len(hit), sorted(found)))
    out = decontaminate.contamination(docs, bench, block=block).collect()
    got = [(str(r.doc_id), r["__n_words"], r["__n_hit"], r["__items"]) for r in out]
    for r in out:  # longest matches, by comparing all places
        w = pattern.findall(low(r.text))
        assert [m.item for m in r["__matches"]] == r["__items"]
        for m in r["__matches"]:
            best = (0, 0)
            for v in (pattern.findall(low(t)) for i, t in items if (i or "") == m.item):
                least = min(10, len(v))
                for a in range(len(w)):
                    for b in range(len(v) - least + 1):
                        if w[a] != v[b] or w[a : a + least] != v[b : b + least]:
                            continue
                        n = least
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        best = max(best, (n, -a))
            assert (m.length, -m.start) == best
    assert sorted(got) == sorted(want) and sum(n > 0 for _, _, n, _ in want) >= 2
    clean = decontaminate.contamination(docs, bench, only_clean=True, block=block)
    assert clean.count() == sum(n == 0 for _, _, n, _ in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("__n_hit")).first()[0] == 0


def test_surrogates_are_consistent(spark, empty):
    texts = ["a.b@mail.com, A.B@mail.com c12@mail.com +1 (017) 555-7713 97.51.17.173 4111 1111 1111 1111 4111111111111112", "Mrs. Anna Schmidt and Mr Schmidt; г-жа Иванова 123-45-6789", None, "", "plain 2024", "97.51.17.173"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in surrogates.replace_entities(df, "k").collect()}
    mails = re.findall(r"\S+@\S+\.example", out[0]["__text"])
    assert mails[0] == mails[1] != mails[2] and len({m.split("@")[1] for m in mails}) == 1
    assert not any(x in out[0]["__text"] for x in ("mail.com", "555-7713", "97.51.17.173", "4111")) and out[0]["__text"].split("+1 (")[1][3] == ")"
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10
    cards = [re.sub(" ", "", x) for x in re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[0]["__text"])]
    assert luhn(cards[0]) == 0 and luhn(cards[1]) == 1
    assert re.fullmatch(r"\w+\.\w+", mails[0].split("@")[0]) and re.fullmatch(r"[a-z]+\d\d", mails[2].split("@")[0])
    assert (m := re.fullmatch(r"Mrs\. \w+na (\w+) and Mr (\w+); г-жа [а-я]+ова \d{3}-\d{2}-\d{4}", out[1]["__text"], re.I)) and m[1] == m[2]
    assert out[2]["__text"] is None and out[3]["__text"] == "" and out[4]["__text"] == texts[4]
    assert out[5]["__text"] in out[0]["__text"] and out[0]["__entities"]["email"] == 3
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(surrogates.permute_digits(F.col("d"), "k").alias("p")).filter("p rlike '^[0-9]{3}$'").distinct().count() == 1000
    assert surrogates.replace_entities(empty, "k").count() == 0


def test_surrogates_of_ibans_and_families(spark):
    ibans = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE88370400440532013000"]
    names = ["Mr Schmidt", "Ms SCHMIDT", "Dr. Otto Schmidt", "г-н Иванов", "г-жа Иванова"]
    clash = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ibans + names)], "doc_id long, text string, `__text` string, `__put` int")
    out = {r.doc_id: r for r in surrogates.replace_entities(clash, "k").collect()}
    turned = lambda t: t.replace(" ", "")[4:] + t[:4]
    mod = lambda t: int("".join(str(int(c, 36)) for c in turned(t))) % 97
    made = [out[k]["__text"] for k in range(3)]
    assert [mod(t) == 1 for t in made] == [mod(t) == 1 for t in ibans] == [True, True, False]
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) and a != b for a, b in zip(made, ibans, strict=True)) and out[0]["__entities"]["iban"] == 1
    family = [out[3 + k]["__text"].split()[-1] for k in range(5)]
    assert family[0].upper() == family[1] == family[2].upper() and family[0] != family[1]
    assert family[3].endswith("ов") and family[4] == family[3] + "а" and out[3]["__put"] == 1


def test_surrogates_find_phone_and_card_formats(spark):
    phones = ["+49 151 23456789", "+49 30 901820", "+44 7911 123456", "+7 (495) 123-45-67", "+7 495 123-45-67", "+33 1 23 45 67 89", "+9 (999) 999-9999", "+4915123456789"]
    cards = ["4111 1111-1111 1111", "41111111 11111111", "6304 0000 0000 0000 000", "4111111111111111", "3782 822463 10005"]
    texts = [f"call {x} now" for x in phones + cards] + ["+49 151 23456789 97.51.17.173", "4111 1111 1111 1111 97.51.17.173"]
    out = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    for k, x in enumerate(phones + cards):
        found = {kind: n for kind, n in out[k]["__entities"].items() if n}
        assert found == {"phone" if k < len(phones) else "card": 1}, x
        assert len(out[k]["__text"]) == len(texts[k]) and x not in out[k]["__text"], x
    for k, kind in ((len(texts) - 2, "phone"), (len(texts) - 1, "card")):
        assert {x: n for x, n in out[k]["__entities"].items() if n} == {kind: 1, "ip": 1}


def test_surrogates_of_long_entities_and_of_one_phone_in_two_forms(spark):
    """Texts of a megabyte of each shape end; local parts that agree in 36 digits stay apart; phones by their digits."""
    n = 1_000_000
    shapes = ["x@" + "a." * (n // 2) + "com", "x@" + "a" * n + ".com", "a" * n + "@b.com", "+" + "1" * n, "1 " * (n // 2), "1-" * (n // 2), "DE12" + " ABCD" * (n // 5), "1.1." * (n // 4), "Mr A" + "b" * n, "Mr " * (n // 3), "(" * n, "x@" + "é𐐀." * (n // 4) + "org"]
    ones, mails = "1" * 36, ["1" * 41 + "@b.com", "1" * 36 + "22222" + "@b.com", "1" * 80 + "@b.com"]
    rows = [(i, t) for i, t in enumerate(shapes)] + [(100 + i, m) for i, m in enumerate(mails)] + [(200, "+4930901820"), (201, "+49 30 901820"), (202, "+49 (30) 90-18-20"), (203, "x@" + "ab." * 126 + "com end"), (204, "+1 415 555 0199"), (205, "+1(415)555-0199")]
    out = {r.doc_id: r["__text"] for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert len(out) == len(rows) and out[10] == shapes[10]
    made = [out[100 + i].split("@") for i in range(3)]
    assert [len(m[0]) for m in made] == [41, 41, 80] and len({m[0] for m in made}) == 3 and all(ones not in m[0] for m in made) and len({m[1] for m in made}) == 1
    digits = {"".join(c for c in out[i] if c.isdigit()) for i in (200, 201, 202)}
    assert len(digits) == 1 and digits.pop()[:2] == "49" and out[201][:4] == "+49 " and out[200] != "+4930901820"
    assert "".join(c for c in out[204] if c.isdigit()) == "".join(c for c in out[205] if c.isdigit()) != "14155550199" and out[204].startswith("+1 ")
    assert out[203].endswith(".example end") and "ab." not in out[203]


def test_repeats_equal_brute_force(docs, rows, empty):
    seen, want = {}, []
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        for k in range(len(raw) - 49):
            seen.setdefault(raw[k : k + 50], r.doc_id)
    for r in rows:
        raw = (r.text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if r.doc_id is not None and seen[raw[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want.append((str(r.doc_id), len(raw), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r["__n_bytes"], r["__n_removed"], r["__n_spans"], r["__kept_sha256"]) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_that_differ_at_the_edges(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    core = letters(60)
    texts = [letters(40) + core[:55] + letters(30), letters(20) + core + letters(45), core[5:] + letters(10), letters(5) + core[:49] + letters(5), letters(60) + core + letters(3) + core]
    test_repeats_equal_brute_force(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").collect(), spark.createDataFrame([], "doc_id long, text string"))


def test_repeats_of_hot_anchors_and_small_buckets(docs, rows, empty, monkeypatch):
    for name, value in (("HOT", 3), ("RANGE", 8192), ("BUCKET_TEXT", 8192), ("BUCKET_CONTEXT", 8192)):
        monkeypatch.setattr(repeats, name, value)
    test_repeats_equal_brute_force(docs, rows, empty)


def test_anchors_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (40, 5000, 49, 300, 50)] + [b"z" * 700]
    assert len(list(repeats._pieces(texts))) == 1
    want = repeats.anchors([(i, 0, t) for i, t in enumerate(texts)])
    windows = {(n, s): (h, p) for h, n, p, lo, hi in zip(*(x.tolist() for x in want), strict=True) for s in range(lo, hi + 1)}
    assert sorted(windows) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)]
    monkeypatch.setattr(repeats, "SLICE", 256)
    got = {}
    for part in repeats._pieces(texts):
        for h, n, p, lo, hi in zip(*(x.tolist() for x in repeats.anchors(part)), strict=True):
            assert not {(n, s) for s in range(lo, hi + 1)} & got.keys()
            got |= {(n, s): (h, p) for s in range(lo, hi + 1)}
    assert got == windows


def test_interval_tree_equals_brute_force():
    rng = random.Random(13)
    for _ in range(200):
        lcp = [0] + [rng.choice((0, 3, 5, 6, 7, 7, 9)) for _ in range(rng.randrange(12))]
        want = set()
        for i in range(len(lcp)):
            for j in range(i + 1, len(lcp)):
                depth = min(lcp[i + 1 : j + 1])
                outside = max(lcp[i] if i else 0, lcp[j + 1] if j + 1 < len(lcp) else 0)
                if depth >= 5 and outside < depth:
                    want.add((depth, i, j, outside < 5))
        got = repeats.interval_tree(lcp, 5)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


@pytest.mark.parametrize("hot", [1 << 30, 2])
def test_repeat_groups_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, tail = letters(150), letters(90)
    texts = [letters(30) + core + letters(20), core + letters(40), letters(7) + core[:70] + letters(9) + core[60:] + tail, letters(80), letters(33) + tail, core[20:] + "x" + tail, letters(33) + tail[:49]]
    texts.append(texts[0])  # a copy of a text is that text
    found = repeats.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.group, r.length), []).append((r.doc_id, r.start, r.open))
    # Every pair of occurrences whose bytes before them differ is in one group, in which all agree and no more do.
    starts = {}
    for i, t in enumerate(texts[:-1]):
        for k in range(len(t) - 49):
            starts.setdefault(t[k : k + 50], []).append((i, k))
    left = lambda i, k: (i, k) if k == 0 else texts[i][k - 1]
    want = {s for s, at in starts.items() if len({left(i, k) for i, k in at}) > 1 and len({i for i, _ in at}) > 1}
    assert {texts[at[0][0]][at[0][1] : at[0][1] + 50] for at in groups.values()} == want and want
    for (name, length), at in groups.items():
        strings = {texts[i][k : k + length] for i, k, _ in at}
        assert len(strings) == 1 and len(at) == len({x[:2] for x in at}) > 1 and length >= 50
        s = strings.pop()
        assert hashlib.sha256(s.encode()).hexdigest() == name
        everywhere = {(i, k) for i, k in starts[s[:50]] if texts[i][k : k + length] == s}
        assert {x[:2] for x in at} == everywhere and len({left(i, k) for i, k in everywhere}) > 1
        assert at[0][2] or len({texts[i][k + length : k + length + 1] or i for i, k in everywhere}) > 1


def test_shards_are_even_and_keep_copies_together(docs, rows, empty):
    out = sharding.kd_shards(docs, shards=4).collect()
    assert sorted((str(r.doc_id), r["__size"]) for r in out) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1) for r in rows)
    home = {}
    for r in out:
        assert home.setdefault(r.text, r["__shard"]) == r["__shard"]
    for s in range(4):
        assert sorted(r["__slot"] for r in out if r["__shard"] == s) == list(range(sum(r["__shard"] == s for r in out)))
    assert sharding.kd_shards(empty).count() == 0
    even = docs.sparkSession.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 37).cast("int")).alias("t"), F.col("id").cast("string").alias("x")).select("doc_id", F.concat("t", "x").alias("text"), F.lit("en").alias("lang"))
    sizes = sharding.kd_shards(even, shards=7).groupBy("__shard").agg(F.sum("__size").alias("s")).collect()
    assert len(sizes) == 7 and max(r.s for r in sizes) < 1.05 * min(r.s for r in sizes)
    assert sharding.kd_shards(even, shards=None, target_bytes=20_000).agg(F.countDistinct("__shard")).first()[0] >= 8


@pytest.mark.parametrize("small", [64, 0])
def test_shards_equal_a_tree_by_hand(spark, monkeypatch, small):
    monkeypatch.setattr(sharding, "SMALL", small)
    monkeypatch.setattr(sharding, "_CLOSE", 0)
    rng = random.Random(17)
    prefix = "a common prefix of all sources/"
    data = [(f"id-{rng.randrange(10**6):07d}", "x" * rng.choice((3, 10, 200)) + f" {i}", rng.choice((None, "de", "en")), prefix + rng.choice("abcdefgh")) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id string, text string, lang string, source string").repartition(3)
    out = {r.text: r["__shard"] for r in sharding.kd_shards(df, shards=6).collect()}
    rank = lambda values: {v: i for i, v in enumerate(sorted({x for x in values if x is not None}))} | {None: -1}
    ranks = [rank(r[k] for r in data) for k in (0, 2, 3)]
    coords = {t: (len(t.encode()) + 1, ranks[0][i], ranks[1][la], ranks[2][so]) for i, t, la, so in data}
    low, high = [min(c[k] for c in coords.values()) for k in range(4)], [max(c[k] for c in coords.values()) for k in range(4)]
    unit = {t: [int((c[k] - low[k]) / (high[k] - low[k]) * (2**24 - 1)) for k in range(4)] for t, c in coords.items()}

    def split(texts, shards, first):
        if shards == 1:
            return {t: first for t in texts}
        spread = [max(unit[t][k] for t in texts) - min(unit[t][k] for t in texts) for k in range(4)]
        k = max(range(4), key=lambda k: (spread[k], -k))
        lower = {t for t in texts if out[t] < first + shards // 2}
        # The halves lie on both sides of the weighted median along the widest coordinate, ties by hash.
        assert max(unit[t][k] for t in lower) <= min(unit[t][k] for t in texts - lower)
        weight = lambda ts: sum(len(t.encode()) + 1 for t in ts)
        assert abs(weight(lower) - weight(texts) * (shards // 2) / shards) <= max(len(t.encode()) + 1 for t in texts)
        return split(lower, shards // 2, first) | split(texts - lower, shards - shards // 2, first + shards // 2)

    assert split(set(out), 6, 0) == out
    assert sharding._ranks(df.select(F.col("source").alias("v"))).count() == 8


def test_quality_counts_equal_brute_force(docs, rows, empty):
    want = []
    for r in rows:
        text, w = r.text or "", words(r.text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 5000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {k for i, x in enumerate(windows) if x in twice for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed))
    out = quality.quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *[r[f"__{n}"] for n in names]) for r in out) == sorted(want)
    assert all(not r["__kept"] for r in out if r["__base_failed"])
    assert quality.quality(empty).count() == 0


def test_divergent_text_is_rejected(spark):
    rng = random.Random(4)
    plain = [" ".join(rng.choice(("the", "of", "and", "house", "river", "stone", "walking")) + rng.choice(("", "s", "er")) for _ in range(120)) for _ in range(40)]
    odd = " ".join("".join(rng.choice("#$%&*0123456789") for _ in range(6)) for _ in range(120))
    df = spark.createDataFrame([*((i, t, "en") for i, t in enumerate(plain)), (99, odd, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.quality(df).filter("NOT __kept").collect()} == {99}


def test_crc_third_holds_out(spark):
    ids = spark.range(50).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.t for r in ids.select("doc_id", (langid._third("doc_id")).alias("t")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}
