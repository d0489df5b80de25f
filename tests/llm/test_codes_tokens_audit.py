"""Vector codes, token counts and the filter audit against brute force, with nulls, ties, repeats, long and empty input."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import filteraudit, tokencounts, vectorcodes

WORD = public_tokenizers.path("word_bpe_49k.json")


# --- vector codes ---


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Codes and errors by plain integers; rows (key, vector, label) in any order."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = -(-max(len(r[1]) for r in kept) // parts)
    grid = [[n * 256 // d for n, d in (float(x).as_integer_ratio() for x in r[1])] for r in kept]
    grid = [g + [0] * (parts * length - len(g)) for g in grid]
    cut = [[g[j * length : (j + 1) * length] for j in range(parts)] for g in grid]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda j, a: min((far(a, e), k) for k, e in enumerate(books[j]))
    for _ in range(rounds):
        given = [[near(j, c[j])[1] for j in range(parts)] for c in cut]
        moved = []
        for j in range(parts):
            own = defaultdict(list)
            for c, g in zip(cut, given, strict=True):
                own[g[j]].append(c[j])
            moved.append([[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[j])])
        books = moved
    out, sums = [], Counter()
    for r, c in zip(kept, cut, strict=True):
        best = [near(j, c[j]) for j in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), r[2]))
        sums[r[2]] += out[-1][2]
    return sorted(((*o[:3], sums[o[3]]) for o in out), key=str)


def codes(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted(((r.vec_id, r["__code"], r["__error"], r["__label_error"]) for r in vectorcodes.product_codes(df, **how).collect()), key=str)


@pytest.mark.parametrize(("kind", "scale"), [("float", 1), ("double", 1), ("float", 2.0**22), ("double", 1e30)])
def test_codes_equal_brute_force_at_any_magnitude(spark, kind, scale, monkeypatch):
    monkeypatch.setattr(vectorcodes, "SLICE", 17)
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 1) * scale)) for _ in range(22)], rng.choice((1, 2, None))) for i in range(90)]
    rows += [(200, None, 1), (201, [float("inf")] * 22, 1), (202, [1.0] * 5, 2), rows[4], (None, rows[7][1], None), (5, rows[8][1], 1), (203, [], 2)]
    want = brute_codes(rows, parts=4, entries=8)
    wide = [(k, c, None if e >= 2**63 else e) for k, c, e, _ in want]
    have = codes(spark, rows, kind, parts=4, entries=8)
    assert [h[:3] for h in have] == wide
    if scale == 1:
        assert have == want


def test_search_equals_all_distances():
    rng = np.random.default_rng(4)
    for length in (1, 2, 3, 5, 8, 33):
        x, e = rng.integers(-9, 9, (200, length)), rng.integers(-9, 9, (40, length))
        far = ((x[:, None] - e[None]) ** 2).sum(-1)
        index, scaled = vectorcodes.nearest(vectorcodes.hadamard(x), vectorcodes.hadamard(e))
        size = vectorcodes.hadamard(x).shape[1]
        assert (index == far.argmin(1)).all() and (scaled == size * far.min(1)).all()
        changes = [(np.diff(np.sign(h)) != 0).sum() for h in vectorcodes.hadamard(np.eye(size, dtype=int)).T]
        assert changes == sorted(changes) == list(range(size))


def test_fewer_vectors_than_entries_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], 7), (2, [1.0, 2.0], 7), (3, [-1.0, 0.25], None)]
    assert codes(spark, rows) == brute_codes(rows)
    df = spark.createDataFrame([(1, [1.0], 5, "a", "b")], "vec_id long, embedding array<double>, label int, `__code` string, `__group` string")
    r = vectorcodes.product_codes(df).first()
    assert (r["__code"], r["__group"], r["__error"]) == ("00" * 16, "b", 0)
    assert vectorcodes.product_codes(df.filter("false")).count() == 0 and vectorcodes.product_codes(df.withColumn("embedding", df.embedding.cast("array<float>")).filter("vec_id = 9")).columns == vectorcodes.product_codes(df).columns


# --- token counts ---


def texts():
    rng = random.Random(12)
    bits = [*"abcXYZ 019\'.,!-\t\n", "\x1c", "\x00", "\x7f", "é", "İ", "Σ", "ß", "\u0301", "\u00a0", "\u2028", "\u200b", "ﬁ", "字", "가", "ᄀ", "ᅡ", "²", "٣", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "\u212a", "ẞ", "😀", "\x85", "ǅ", "Ⅷ", "ͅ", "<|endof", "text|>"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(3000)]
    return [*out, None, "", " \n", "word " * 3000, "z" * 50_000, "9" * 5000, out[0], out[0]]


@pytest.fixture(scope="module")
def counted(spark):
    return spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts())], "doc_id long, text string, `__n_tokens` string").repartition(4)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens_equal_the_library(counted, name, monkeypatch):
    monkeypatch.setattr(tokencounts, "SLICE", 50)
    monkeypatch.setattr(tokencounts, "CACHE", 100)
    monkeypatch.setattr(tokencounts, "WORDS", 10)
    path = public_tokenizers.path(name)
    if name.endswith("model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        size = lambda t: len(model.encode(t, add_special_tokens=False))
    for r in tokencounts.token_counts(counted, path, limit=100).collect():
        t = r.text or ""
        assert (r["__n_tokens"], r["__n_bytes"], r["__over_limit"]) == (size(t), len(t.encode()), size(t) > 100), ascii(t)[:200]


def test_table_changes_no_count(counted, spark):
    spec = open(WORD, encoding="utf-8").read()
    top = tokencounts.frequent_pieces(counted, spec, most=5)
    assert top[:2] == ["9", "word"] and len(top) == 5
    some = counted.filter("length(text) < 40")
    n = lambda f: sorted((r.doc_id, r["__n_tokens"]) for r in tokencounts.token_counts(some, WORD, frequent=f, keep=["doc_id"]).collect())
    assert n([]) == n(top) == n(["a b", "", "word", "x" * 400]) == n(None)
    assert tokencounts.token_counts(counted.filter("false"), WORD).count() == 0


def test_summaries_keep_the_frequent(monkeypatch):
    monkeypatch.setattr(tokencounts, "COUNTED", 40)
    monkeypatch.setattr(tokencounts, "REPORTED", 3)
    import pyarrow as pa

    rng = random.Random(1)
    body = [f"often {rng.choice(('seldom', 'usual usual'))} {''.join(rng.choice('bcdfg') for _ in range(8))}" for _ in range(500)]
    got = [*tokencounts._summary(open(WORD, encoding="utf-8").read())(iter([pa.RecordBatch.from_arrays([pa.array(body)], ["text"])]))]
    assert got[0].column(0).to_pylist()[:2] == ["often", "usual"] and got[0].column(1).to_pylist()[0] == 500


# --- filter audit ---


def audited():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["Big", "LOUD", "a#b", "x|", "é"]
    body = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    texts = [body(rng.choice((10, 60, 120)), vocabulary[: rng.choice((30, 300, 305))]) for _ in range(80)]
    head = body(400, vocabulary[:300])
    texts += [head + c for c in ("", " x", " y", " y z", " x")] + [head[:900], head[:900] + "!"]
    texts += [None, "", "", " \n", "é" * 60, "A" * 9, texts[0], texts[0], body(40_000, vocabulary), "p\x0bq\x0cr s\x85t\u00a0u"]
    rows = [(i, t, rng.choice(("s1", "s2", None, "")), "m") for i, t in enumerate(texts)]
    rows += [rows[3], (2, texts[9], "s1", "m"), (None, texts[5], "s3", "m"), (None, texts[5], "s3", "m"), (-4, texts[20], "s1", "m")]
    rows += [(1000 + i, texts[11], "s2", "m") for i in range(300)]
    rng.shuffle(rows)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (8, None, None)]
    return rows, labels


def brute_audit(rows, labels):
    import re

    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for i, t, p, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[p or ""].append((frozenset(f for f in fails if fails[f]), i in good, i in toxic))
    out, shapley = [], Counter()
    for p, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in docs if f in d[0] and not d[0] & before]
                shapley[p, f] += len(here)
                out.append([p, "".join(order), k + 1, sum(not d[0] & {*before, f} for d in docs), len(here), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), f])
    return sorted((*o[:-1], shapley[o[0], o[-1]]) for o in out)


@pytest.mark.parametrize(("held", "target", "reach"), [(32 << 20, 32 << 20, 64), (2000, 3000, 2), (1, 1, 64)])
def test_audit_equals_brute_force(spark, monkeypatch, held, target, reach):
    for name, value in (("HELD_BYTES", held), ("RANGE_BYTES", target), ("REACH", reach), ("_SLICE", min(held, 1 << 20))):
        monkeypatch.setattr(filteraudit, name, value)
    rows, labels = audited()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `__mask` string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(docs, known).collect()
    assert got[0].asDict().keys() == {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"}
    assert sorted(tuple(r) for r in got) == brute_audit(rows, labels)
    assert filteraudit.audit(docs.filter("false"), known).count() == 0


def test_prefixes_grow_where_texts_are_many(spark, monkeypatch):
    """Texts that agree in 900 bytes are split beyond them; a text that is there once a task isn't split."""
    monkeypatch.setattr(filteraudit, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(filteraudit, "REACH", 8)
    head = "licence " * 112
    rows = [(i, f"{head}{i * 7919 % 1000:04d} {'t' * 50}", "s") for i in range(200)] + [(500 + i, "q" * 30_000, "s") for i in range(9)] + [(900 + i, f"{chr(97 + i % 26)}{i} one", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    import pyspark.sql.functions as F

    t = docs.select(F.col("doc_id").alias("id"), F.lit("").alias("part"), F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("text"))
    heads = t.mapInArrow(filteraudit._scan, f"id long, part string, print long, mask int, {filteraudit._HEADS}").filter("mask IS NULL")
    bounds = filteraudit.prefix_bounds(t, heads)
    assert sum(b.startswith(head.encode()) and len(b) > len(head) for b in bounds) > 5 and bounds == sorted(set(bounds))
    assert filteraudit.first_copies(t, bounds).count() == 200 + 1 + 60


def test_trie_and_common_prefixes():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(500)] + [b"ab" * 300, b"ab" * 300 + b"c", b""]
    trie, least = filteraudit.Trie(), {}
    for i, w in enumerate(words):
        trie.insert(w, -i)
        least[w] = min(least.get(w, 0), -i)
    assert [*trie.terminals()] == [least[w] for w in sorted(least)]
    for a, b in itertools.product(words[:40] + words[-3:], repeat=2):
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert filteraudit.common(a, b) == n
