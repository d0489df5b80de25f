"""Language identification of words by a linear-chain conditional random field, and of texts by their words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shielded, small_batches

#: Bounds of the training sample: labelled documents of a language and of all (each language has one at least), and words
#: of a document (whole windows spread over all of its text). All languages that the labels name are learned.
DOCS_PER_LANG = 120
MOST_DOCS = 12_000
WORDS_PER_DOC = 800
#: Words of a stretch in one language in the code-switched training sequences: least and most.
STRETCH = (4, 30)
EPOCHS, BATCH_WORDS, RATE, PENALTY = 4, 6000, 0.4, 1e-6
#: Bytes of text that are labelled at once.
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
_BITS = 16
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_P = np.uint64(0x100000001B3)
_P_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Words:
    """Features of the words of some texts: runs of letters, lower-cased, in UTF-8."""

    pairs: np.ndarray  # of bytes, by position
    triples: np.ndarray
    cuts: np.ndarray  # start and end of each word's positions, in turn
    prefix: np.ndarray
    suffix: np.ndarray
    whole: np.ndarray  # 64-bit hash
    text: np.ndarray  # number of the text


def extract(texts: list[str]) -> Words:
    parts = [t.lower().encode() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    raw = np.frombuffer(b" " + b" ".join(parts) + b"     ", np.uint8)
    letter = _LETTER[raw]
    data = np.where(letter, raw, 32).astype(np.int64)
    edges = np.diff(letter.astype(np.int8), prepend=0)
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    pairs = data[:-1] << 8 | data[1:]
    triples = _hash(pairs[:-1] << 8 | data[2:])
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, _P))), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, _P_INVERSE))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(data.astype(np.uint64) * powers, dtype=np.uint64)))
    whole = (sums[ends] - sums[starts]) * inverse[starts]
    four = (pairs[:-2] << 16 | pairs[2:])[:, None] if len(pairs) > 2 else np.zeros((0, 1), np.int64)
    size = ends - starts
    prefix = four[starts, 0] >> (8 * np.maximum(0, 4 - size))
    suffix = four[np.maximum(ends - 4, 0), 0] & ((1 << (8 * np.minimum(4, size))) - 1)
    text = np.searchsorted(np.cumsum(sizes), starts - 1, "right")
    return Words(pairs, triples, np.stack((starts - 1, ends), axis=1).reshape(-1), _hash(prefix * 4 + 1), _hash(suffix * 4 + 2), whole, text)


@dataclass
class Model:
    langs: list[str]
    tables: dict[str, np.ndarray]  # weights by feature and language: pairs, triples, prefix, suffix, lexicon
    lexicon: np.ndarray  # word hash in each slot
    transitions: np.ndarray
    initial: np.ndarray

    def slots(self, whole: np.ndarray) -> np.ndarray:
        """Slot of each word in the lexicon; the last slot is that of unknown words."""
        at = (whole * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
        return np.where(self.lexicon[at] == whole, at, len(self.lexicon) - 1)

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of each word in each language."""
        by_place = self.tables["pairs"][w.pairs[:-1]] + self.tables["triples"][w.triples]
        by_place = np.concatenate((by_place, np.zeros((2, by_place.shape[1]), by_place.dtype)))
        inside = np.add.reduceat(by_place, w.cuts, axis=0)[::2]
        return inside + self.tables["prefix"][w.prefix] + self.tables["suffix"][w.suffix] + self.tables["lexicon"][self.slots(w.whole)]


def forward_backward(scores: np.ndarray, start: np.ndarray, transitions: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each word, and forward and (weighted) backward vectors.

    Sequences lie end to end, start marks their first words. The words are dealt to rows of equal length; products of
    the rows' matrices carry the exact vectors from row to row, so any lengths take about sqrt(n) vectorised steps.
    """
    n, k = scores.shape
    cols = max(1, int(np.sqrt(n)))
    rows = -(-n // cols)
    e = np.ones((rows * cols, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    s = np.ones(rows * cols, bool)
    s[:n] = start
    s[0] = True
    e, s = e.reshape(rows, cols, k), s.reshape(rows, cols)
    t, first = np.exp(transitions - transitions.max()), np.exp(initial - initial.max())
    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for c in range(cols):
        moved = (product.reshape(-1, k) @ t).reshape(rows, k, k)
        if s[:, c].any():
            moved[s[:, c]] = product[s[:, c]].sum(axis=2, keepdims=True) * first
        product = moved * e[:, c, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.full((rows, k), 1 / k), np.full((rows, k), 1 / k)
    for r in range(1, rows):
        a = ahead[r - 1] @ product[r - 1]
        ahead[r] = a / a.sum()
        b = product[rows - r] @ behind[rows - r]
        behind[rows - r - 1] = b / b.sum()
    alpha, beta = np.empty((rows, cols, k)), np.empty((rows, cols, k))
    for c in range(cols):
        a = ahead @ t
        a[s[:, c]] = first
        a *= e[:, c]
        ahead = a / a.sum(axis=1, keepdims=True)
        alpha[:, c] = ahead
    for c in range(cols - 1, -1, -1):
        beta[:, c] = behind
        v = e[:, c] * behind
        b = v @ t.T
        b[s[:, c]] = (v[s[:, c]] @ first)[:, None]
        behind = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return gamma.reshape(-1, k)[:n], alpha.reshape(-1, k)[:n], (e * beta).reshape(-1, k)[:n]


def train(sample: dict[str, list[list[str]]], seed: int = 7) -> Model:
    """A model from {language: documents as words}. Documents are cut into stretches, which are shuffled and joined to
    code-switched sequences, so that transitions are learned as well."""
    rng = np.random.default_rng(seed)
    langs = sorted(sample)
    k = len(langs)
    stretches: list[tuple[int, list[str]]] = []
    for y, lang in enumerate(langs):
        for doc in sample[lang]:
            at = 0
            while at < len(doc):
                size = int(rng.integers(*STRETCH))
                stretches.append((y, doc[at : at + size]))
                at += size
    counts: dict[int, np.ndarray] = {}
    for y, words in stretches:
        for h in extract([" ".join(words)]).whole.tolist():
            counts.setdefault(h, np.zeros(k, np.int64))[y] += 1
    lexicon = np.zeros((1 << _BITS) + 1, np.uint64)
    for h in sorted((h for h, c in counts.items() if c.sum() >= 3), key=lambda h: (counts[h].sum(), h)):  # the frequent last
        lexicon[(h * int(_MIX) % 2**64) >> (64 - _BITS)] = h
    tables = {name: np.zeros((size, k), np.float32) for name, size in (("pairs", 1 << 16), ("triples", 1 << _BITS), ("prefix", 1 << _BITS), ("suffix", 1 << _BITS), ("lexicon", (1 << _BITS) + 1))}
    model = Model(langs, tables, lexicon, np.zeros((k, k)), np.zeros(k))
    square = {name: np.full(t.shape, 1e-3, np.float32) for name, t in tables.items()}
    square_t, square_i = np.full((k, k), 1e-3), np.full(k, 1e-3)

    for _ in range(EPOCHS):
        order = rng.permutation(len(stretches))
        at = 0
        while at < len(order):
            texts, labels, held = [], [], 0
            while at < len(order) and held < BATCH_WORDS:
                run = [stretches[i] for i in order[at : at + int(rng.integers(1, 5))]]
                at += len(run)
                texts.append(" ".join(" ".join(words) for _, words in run))
                labels += [y for y, words in run for _ in words]
                held += sum(len(words) for _, words in run)
            w, y = extract(texts), np.array(labels)
            if len(w.whole) != len(y) or not len(y):
                continue  # a word that lower-cases to more than one
            start = np.diff(w.text, prepend=-1) != 0
            gamma, alpha, weighted = forward_backward(model.emissions(w), start, model.transitions, model.initial)
            g = gamma.astype(np.float32)
            g[np.arange(len(y)), y] -= 1
            spans = w.cuts.reshape(-1, 2)
            place = np.concatenate([np.arange(a, b) for a, b in spans])
            per_place = np.repeat(g, spans[:, 1] - spans[:, 0], axis=0)
            for name, at_, grad in (("pairs", w.pairs[place], per_place), ("triples", w.triples[place], per_place), ("prefix", w.prefix, g), ("suffix", w.suffix, g), ("lexicon", model.slots(w.whole), g)):
                used, inverse = np.unique(at_, return_inverse=True)
                total = np.stack([np.bincount(inverse, grad[:, j]) for j in range(k)], axis=1).astype(np.float32) + PENALTY * len(y) * tables[name][used]
                square[name][used] += total**2
                tables[name][used] -= RATE * total / np.sqrt(square[name][used])
            inner = np.nonzero(~start)[0]
            t = np.exp(model.transitions - model.transitions.max())
            both = alpha[inner - 1][:, :, None] * t * weighted[inner][:, None, :]
            both = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(both, (y[inner - 1], y[inner]), -1)
            square_t += both**2
            model.transitions -= RATE * both / np.sqrt(square_t)
            first = gamma[start].sum(axis=0) - np.bincount(y[start], minlength=k)
            square_i += first**2
            model.initial -= RATE * first / np.sqrt(square_i)
    tables["lexicon"][-1] = 0
    return model


def label(model: Model, texts: list[str]) -> list[tuple[str, float, np.ndarray]]:
    """(language, score, marginals of its words) of each text; the language has the largest sum of the words' marginals."""
    none = (UNKNOWN, 0.0, np.zeros((0, len(model.langs))))
    out = [none] * len(texts)
    w = extract(texts)
    if not model.langs or not len(w.whole):
        return out
    gamma, _, _ = forward_backward(model.emissions(w), np.diff(w.text, prepend=-1) != 0, model.transitions, model.initial)
    starts = np.nonzero(np.diff(w.text, prepend=-1))[0]
    sums = np.add.reduceat(gamma, starts, axis=0)
    ends = np.append(starts[1:], len(gamma))
    for a, b, total in zip(starts, ends, sums, strict=True):
        i = int(w.text[a])
        if any(map(str.isalpha, texts[i])):
            best = int(total.argmax())
            out[i] = (model.langs[best], min(1.0, float(total[best] / (b - a))), gamma[a:b])
    return out


def _third(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 1, docs_per_lang: int = DOCS_PER_LANG, most_docs: int = MOST_DOCS) -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out (crc32 of the id modulo 3). Which
    documents are taken depends on ids and texts alone; rows that repeat both count once."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(_third(id_col) != held_out, F.lit(True)))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("sample"), F.col(f"`{id_col}`").cast("string"), text_col).alias("key"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    langs = sizes.count()
    docs_per_lang = max(1, min(docs_per_lang, most_docs // max(1, langs)))
    # Of each language's keys, which are spread evenly, a share of some twice as many as are needed; all of small ones.
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_per_lang + 20) / F.col("n"))
    picked = known.join(sizes, "lang").filter((F.shiftrightunsigned("key", 1) / F.lit(float(2**63))) <= share).select("lang", "key", "text").dropDuplicates(["lang", "key"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                w = bytes(b if _LETTER[b] else 32 for b in text.lower().encode()).decode(errors="ignore").split()
                windows = max(1, -(-len(w) // 40))
                step = max(1, -(-windows * 40 // WORDS_PER_DOC))
                out.append([x for i in range(0, windows, step) for x in w[40 * i : 40 * i + 40]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["lang", "key", "words"])

    rows = sorted(picked.mapInArrow(words, "lang string, key long, words array<string>").collect(), key=lambda r: (r["lang"], r["key"], r["words"])) if langs else []
    sample: dict[str, list[list[str]]] = {}
    for r in rows:
        if r["words"] and len(sample.setdefault(r["lang"], [])) < docs_per_lang:
            sample[r["lang"]].append(list(r["words"]))
    return train(sample)


@shielded
def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of keep (all by default), __lang and __score for each row, from the text alone.

    Nulls: a null text, and one without letters, is und with score 0; so is any text if the model has no language.
    Repeated rows are alike. An empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, part, held = [], [], 0
            for text in batch.column(len(keep)).to_pylist():
                part.append(text or "")
                held += len(part[-1])
                if held >= SLICE_BYTES:
                    results += [x[:2] for x in label(sent.value, part)]
                    part, held = [], 0
            results += [x[:2] for x in label(sent.value, part)] if part else []
            arrays = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64())], [*keep, "__lang", "__score"])

    schema = T.StructType([*fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
