"""The registered queries' columns and the pipeline's stages against brute force, on a small folder of tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import surrogates
from tidemark.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__kept` string, `__copies` int"
KEY = "AKIA" + "Z9" * 9


def make_docs():
    rng = random.Random(31)
    words = {lang: [f"{lang}{a}{b}" for a in "abcdefgh" for b in ("", "x", "yz", "long")] for lang in ("en", "de")}
    texts = []
    for i in range(70):
        lang = ("en", "de")[i % 2]
        body = [rng.choice(words[lang][: rng.choice((6, 32))]) + (f"{i}w{k}" if k % 3 == 0 else "") for k in range(rng.choice((4, 60, 90, 200)))]
        texts.append((" ".join(body), lang))
    texts += [(texts[5][0], "de"), (texts[6][0] + " tail end", "en"), (None, None), ("", "en"), (" \n", "de"), ("One Two", "en"), (" ".join(["again and again we say"] * 30), "en"), ("#$% " * 80, "de")]
    texts += [(f'password = "{"a1" * 8}" {KEY} mail a.b@c.com and {"f" * 20}', "en"), ("é" * 300, None), (" ".join(f"q{rng.randrange(9**9)}" for _ in range(3000)), "en"), ("Mrs Ann Lee, Mr Lee: 4111 1111 1111 1111", "en")]
    rows = [(i, t, la, rng.choice(("s/one", "s/two", "s/three", None)), len(t or ""), "k", 7) for i, (t, la) in enumerate(texts)]
    rows += [rows[3], (None, texts[4][0], "en", "s/one", 1, "k", 7), (2, texts[9][0], "de", None, 1, "k", 7)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def bench(rows):
    w = next(r[1] for r in rows if r[1] and len(r[1].split()) == 3000).split()
    return [("b1", " ".join(w[100:125]).upper()), ("b2", None), ("b3", " ".join(w[110:121])), ("b4", "one two"), ("b5", "...")]


@pytest.fixture(scope="module")
def folder(spark, rows, bench, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    pages = [(i, f"http://x/{i}", t) for i, t in enumerate(["<a>", "<a>", None, "", "<b>é"])] + [(None, None, "<b>é"), (9, "http://x/9", "<a>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{d}/pages.parquet")
    rng, inf = random.Random(8), float("inf")
    vectors = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(40 if i % 7 else 37)], rng.choice((0, 1, None)), i) for i in range(150, 0, -1)]
    vectors += [(0, None, 1, 0), (500, [1.0, None], 1, 0), (501, [float("nan")] * 40, 1, 0), (502, [0.0, -inf], 1, 0), (3, vectors[5][1], 1, 0), (None, vectors[9][1], None, 0), (77, [], 0, 0), (9, [2.5] * 40, 0, 0), vectors[3]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, `__code` int").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 3)] + [(3, 1, 1), (6, None, None), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2).write.parquet(f"{d}/labels.parquet")
    return d


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def got(spark, folder, name, *columns):
    out = QUERIES[name](spark, folder)
    return sorted((tuple(r[c] for c in columns) for r in out.collect()), key=str)


def test_op1_columns(spark, folder, rows):
    prints = []
    for r in rows:
        w = low(r[1]).encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    group = list(range(len(rows)))
    for _ in range(6):
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    name = {g: min(rows[k][0] for k, x in enumerate(group) if x == g and rows[k][0] is not None) for g in group}
    want = [(r[0], f"{p:016x}", name[g]) for r, p, g in zip(rows, prints, group, strict=True)]
    assert got(spark, folder, "op1_simhash", "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_op3_columns(spark, folder, rows):
    out = QUERIES["op3_language_id"](spark, folder).collect()
    assert sorted(((r.doc_id, r.held_out) for r in out), key=str) == sorted(((r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows), key=str)
    text = {r[0]: r[1] for r in rows if r[0] not in (2, None)}
    for r in out:
        if r.doc_id in text:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or ""))) and r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1
    real = [(r.lang_pred, la) for r in out for i, t, la, *_ in rows if i == r.doc_id and i is not None and i < 70 and len(t.split()) > 50 and i != 2]
    assert sum(a == b for a, b in real) > 0.95 * len(real)


def test_op3_model_equals_all_label_paths():
    import numpy as np

    from tidemark.llm.langid import forward_backward

    rng = np.random.default_rng(4)
    scores, t, first = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    start = np.array([True, False, False, False, True, False, False])
    want = np.zeros((7, 3))
    for a, b in ((0, 4), (4, 7)):
        total = 0.0
        for path in np.ndindex(*[3] * (b - a)):
            w = math.exp(first[path[0]] + sum(scores[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                want[a + i, y] += w
        want[a:b] /= total
    assert np.allclose(forward_backward(scores, start, t, first)[0], want)


def test_op4_columns(spark, folder):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    first = {}
    for i, raw in pages:
        if i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = [(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first[raw] else "revisit", None if i == first[raw] else first[raw]) for i, raw in pages]
    assert got(spark, folder, "op4_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)


def test_op5_columns(spark, folder, rows):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    want = []
    for r in rows:
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(kinds) for m in p.finditer(r[1] or "") if len(m.group(g)) >= least)
        joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
        want.append((r[0], *[sum(s[3] == n for s in spans) for n, *_ in kinds], hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got(spark, folder, "op5_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == sorted(want, key=str)
    assert sum(w[1] for w in want) == 1 and sum(w[2] for w in want) == 1


def test_op7_columns(spark, folder, rows):
    regex = pytest.importorskip("regex")
    pattern = regex.compile(surrogates._ANY)
    out = {}
    for r in QUERIES["op7_pii_surrogates"](spark, folder).collect():
        out.setdefault(r.doc_id, []).append(r)
    made = {}
    for r in rows:
        hits = [x for x in out[r[0]] if (x.text is None) == (r[1] is None) and all(p in (x.text or "") for p in pattern.split(r[1] or ""))]
        assert hits, r
        x = hits[0]
        found = list(pattern.finditer(r[1] or ""))
        assert sum(x[f"n_{k}"] for k in surrogates.KINDS) == len(found)
        if not found:
            assert any(y.text == r[1] for y in hits)
            continue
        between = "(.+?)".join(map(re.escape, pattern.split(r[1])))
        for a, b in zip((m.group() for m in found), re.fullmatch(between, x.text, re.S).groups(), strict=True):
            assert a != b and made.setdefault(a.lower(), b.lower()) == b.lower()
    assert len(set(made.values())) == len(made) >= 4


def test_op8_columns(spark, folder, rows):
    seen, want = {}, []
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (r[1] or "").encode()
        for k in range(len(raw) - 49):
            seen.setdefault(raw[k : k + 50], r[0])
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if r[0] is not None and seen[raw[k : k + 50]] < r[0]:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want.append((r[0], len(raw), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    assert got(spark, folder, "op8_repeats", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)


def test_op9_columns(spark, folder, rows):
    out = QUERIES["op9_sharding"](spark, folder).collect()
    raw = [(r[1] or "").encode() for r in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == sorted(((r[0], len(b) + 1, zlib.crc32(b)) for r, b in zip(rows, raw, strict=True)), key=str)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and all(0 <= r.shard < 16 for r in out)
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    home = {}
    assert all(home.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard for r in out if r["size"] > 1)  # a null text is not an empty one


def classes(text):
    space = sum(c in " \t\n\x0b\f\r" for c in text)
    lower = sum("a" <= c <= "z" or __import__("unicodedata").category(c) in ("Ll", "Lo") for c in text)
    upper = sum(__import__("unicodedata").category(c) == "Lu" for c in text)
    digit = sum("0" <= c <= "9" for c in text)
    return [lower, space, upper, digit, len(text) - lower - space - upper - digit]


def distance(p, q):
    term = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum((term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))))


def judged(rows):
    """(id, base_failed, char distance, word distance, kept) of each row."""
    known = [(r[2], classes(r[1] or ""), [w.lower() for w in split(r[1])]) for r in rows]
    total, common, shares = {}, {}, {}
    for lang in {k[0] for k in known}:
        some = [k for k in known if k[0] == lang]
        sums = [sum(k[1][i] for k in some) for i in range(5)]
        total[lang] = [s / sum(sums) for s in sums]
        count = Counter(w for k in some for w in k[2])
        top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:16]
        n = sum(count.values())
        common[lang], shares[lang] = [w for w, _ in top], [c / n for _, c in top] + [max(0.0, 1 - sum(c for _, c in top) / n)]
    pooled = [sum(k[1][i] for k in known) for i in range(5)]
    total[None], common[None], shares[None] = [s / sum(pooled) for s in pooled], [], [1.0]
    out = []
    for r, (lang, chars, words) in zip(rows, known, strict=True):
        plain = split(r[1])
        grams = [tuple(plain[i : i + 5]) for i in range(len(plain) - 4)]
        twice = {g for g, c in Counter(grams).items() if c > 1}
        covered = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 5)}
        failed = len(plain) < 10 or 100 * len(covered) > 20 * len(plain)
        a = b = None
        if len(words) >= 50 and sum(chars) >= 200:
            a = distance([c / sum(chars) for c in chars], total[lang])
            own = [words.count(w) / len(words) for w in common[lang]]
            b = distance([*own, 1 - sum(own)], shares[lang])
        out.append((r[0], failed, a, b, not failed and (a or 0) <= 0.28 and (b or 0) <= 0.45))
    return out


def test_op10_columns(spark, folder, rows):
    near = lambda x: None if x is None else round(x, 6)
    want = sorted(((i, f, near(a), near(b), k) for i, f, a, b, k in judged(rows)), key=str)
    have = sorted(((r.doc_id, r.base_failed, near(r.char_distance), near(r.word_distance), r.kept) for r in QUERIES["op10_quality_rules"](spark, folder).collect()), key=str)
    assert have == want and {w[4] for w in want} == {True, False} and any(not w[1] and not w[4] for w in want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_of_queries(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cur = c.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert got(spark, folder, name, *names) == sorted(cur.fetchall(), key=str)


def test_empty_tables_give_no_rows(spark, folder, tmp_path):
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        out = query(spark, str(tmp_path))
        assert out.count() == 0 and out.columns == QUERIES[name](spark, folder).columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_brute_force(spark, folder, rows, bench):
    """Each stage on all that the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda d: sorted((tuple(r) for r in d.select(*docs.columns).collect()), key=str)
    frame = lambda data: spark.createDataFrame(data, docs.schema)
    kept = sorted((r for r, j in zip(rows, judged(rows), strict=True) if j[4]), key=str)
    out = stages["quality_rules"](spark, docs, folder)
    assert out.columns == docs.columns and plain(out) == kept

    given = sorted(rows, key=str)
    grams = [frozenset(zip(*(low(r[1]).split()[k:] for k in range(5)), strict=False)) or frozenset(tuple(low(r[1]).split()) for _ in range(1 if low(r[1]).split() else 0)) for r in given]
    root = list(range(len(given)))
    for _ in range(6):
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if a == b or 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    one = plain(stages["near_dedup"](spark, frame(given), folder))
    firsts = {g: min(given[k][0] for k, x in enumerate(root) if x == g and given[k][0] is not None) for g in root}
    assert sorted(r[0] for r in one if r[0] is not None) == sorted(firsts.values()) and [r for r in one if r[0] is None] == [r for r in given if r[0] is None]

    windows = set()
    for _, t in bench:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    clean = []
    for r in given:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r[1]))
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            clean.append(r)
    assert plain(stages["decontaminate"](spark, frame(given), folder)) == clean and len(clean) < len(given)

    taken = duckdb.connect()
    taken.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    copies = Counter()
    for i, size, _, _, n in taken.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op2_mixing']})").fetchall():
        copies[i] += n // size if size else 1
    mixed = stages["mix_sources"](spark, docs, folder)
    assert Counter(r[0] for r in plain(mixed)) == +copies and mixed.columns == docs.columns

    placed = stages["shard"](spark, docs, folder)
    assert placed.columns == [*docs.columns, "shard", "slot"] and plain(placed) == given
    assert placed.select("shard", "slot").distinct().count() == len(given)
    assert placed.groupBy("shard").agg((F.max("slot") + 1 - F.count(F.lit(1))).alias("gap")).filter("gap <> 0").count() == 0


def test_texts_longer_than_any_slice(spark, tmp_path):
    """A text of 3 MB and 430,000 words: over the slices, pieces and shards in which texts are worked on."""
    rng = random.Random(77)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(430_000))
    item = " ".join(long.split()[-40:-10])
    docs = [(1, long, "en", "s", 1, "k", 1), (2, long[1_990_000:2_200_000], "en", "s", 1, "k", 1), (3, "short " * 5, "en", "t", 1, "k", 1)]
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", item)], "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    raw = long.encode()
    op8 = out("op8_repeats")
    assert (op8[1].n_removed, op8[2].n_removed, op8[2].n_spans) == (0, 210_000, 1) and op8[1].kept_sha256 == hashlib.sha256(raw).hexdigest()
    op6 = out("op6_decontamination")
    assert (op6[1].n_words, op6[1].n_hit, op6[1].n_items, op6[2].n_hit) == (430_000, 30, 1, 0)
    assert out("op3_language_id")[1].lang_pred == "en" and out("op5_secrets")[1].n_assign == 0
    op10, op9, op2 = out("op10_quality_rules"), out("op9_sharding"), out("op2_mixing")
    assert op10[1].n_words == 430_000 and not op10[1].base_failed and op10[3].base_failed
    assert op9[1]["size"] == len(raw) + 1 and op9[1].text_crc32 == zlib.crc32(raw) and op2[1]["size"] == 430_000
    w = low(long).encode().split()
    counts = [0] * 64
    for i in range(len(w) - 2):
        v = xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42)
        for b in range(64):
            counts[b] += v >> b & 1
    assert out("op1_simhash")[1].fingerprint == f"{sum(1 << b for b in range(64) if 2 * counts[b] > len(w) - 2):016x}"


def test_archives_roll_over(spark, tmp_path):
    """Payloads of 90 MB in all, in one task: more than an archive holds."""
    pages = [(i, f"http://x/{i}", chr(97 + i) * 18_000_000) for i in range(4)] + [(9, "http://x/9", "b" * 18_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got_ = {r.page_id: r for r in QUERIES["op4_warc"](spark, str(tmp_path)).collect()}
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got_.items()} == {i: (18_000_000, "response", None) for i in range(4)} | {9: (18_000_000, "revisit", 1)}
    assert got_[9].payload_digest == base64.b32encode(hashlib.sha1(b"b" * 18_000_000).digest()).decode()
