"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

A tokenizer that drops white space encodes each pre-token (a run of letters, a digit, a run of signs) by itself, so that a
text has as many tokens as its pre-tokens have. Tier one is a table of the corpus' frequent pre-tokens and their lengths,
sent to all tasks; tier two is a cache of each Python worker, which encodes what the table hasn't. No pre-token is
shuffled: the frequent ones come from summaries of bounded size that each task makes of all its texts.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shielded, small_batches

#: Tokens above which a text is over the limit.
LIMIT = 2048
#: Rows of the table that is sent, and the longest pre-token in it (characters): some 2 MB at most.
FREQUENT = 32_768
LONGEST = 64
#: Pre-tokens that a task keeps counts of, and those of them that it reports.
COUNTED = 400_000
REPORTED = 8192
#: Lengths that a worker keeps, and words with other letters than ASCII's whose pre-tokens it keeps.
CACHE = 400_000
WORDS = 100_000
#: Characters of a text that are worked on at once, up to the next white space.
SLICE = 1 << 20

_SPACE = re.compile(r"[\t-\r ]")
#: ASCII form of the pre-tokens of the tokenizers this reads piece by piece (a fixed value of the format).
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_piece(spec: dict) -> bool:
    """Whether texts may be cut at white space: NFC, lower case, pre-tokens by _PATTERN with white space dropped, byte
    level, and added tokens that are found as they stand."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    added = spec.get("added_tokens") or []
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": _PATTERN}, "Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
    )


class Lengths(dict):
    """Tokens of each pre-token: the frequent ones, and those that this worker has met. Full, it keeps the frequent."""

    def __init__(self, spec: str, frequent: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent, self.tokenizer, self.whole = frequent, Tokenizer.from_str(spec), not _by_piece(json.loads(spec))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.words = self.tokenizer.model, {}
        if not self.whole:
            self.split, self.level, self.normalizer = self.tokenizer.pre_tokenizer[0], self.tokenizer.pre_tokenizer[1], self.tokenizer.normalizer
            added = sorted((a.content for a in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
            self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, piece: str) -> int:
        level = piece if piece.isascii() and piece.isalnum() else self.level.pre_tokenize_str(piece)[0][0]  # those stand for themselves
        n = len(self.model.tokenize(level))
        if len(piece) <= LONGEST:
            if len(self) >= CACHE + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens. Words of ASCII are cut here, others by the library."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        plain, own = [], []
        for w in text.encode().split():
            if w.isascii():
                plain.append(w)
            else:
                own += self.words.get(w) or self._pieces_of_word(w)
        return own + _ASCII.findall(b" ".join(plain).decode().lower())

    def _pieces_of_word(self, word: bytes) -> list[str]:
        pieces = [p for p, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(word.decode()))]
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = pieces
        return pieces

    def spans(self, text: str | None) -> Iterator[list[str]]:
        """Pre-tokens of a whole text, slice by slice; added tokens stand for themselves, as None."""
        for k, part in enumerate(self.added.split(text or "") if self.added else [text or ""]):
            if k:
                yield [None]
            at = 0
            while at < len(part):
                end = _SPACE.search(part, at + SLICE) if at + SLICE < len(part) else None
                stop = end.start() if end else len(part)
                yield self.pieces(part[at:stop])
                at = stop

    def count(self, text: str | None) -> int:
        if self.whole:
            return len(self.tokenizer.encode(text or "", add_special_tokens=False))
        return sum(1 if p == [None] else sum(map(self.__getitem__, p)) for p in self.spans(text))


@functools.lru_cache(maxsize=2)
def _lengths(spec: str, pieces: str, counts: bytes) -> Lengths:
    """One for each worker and table."""
    return Lengths(spec, dict(zip(pieces.split(" "), counts, strict=True)) if pieces else {})


def _summary(spec: str):
    """Frequent pre-tokens of a task's texts with their counts: once COUNTED are held, the rarer half goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = _lengths(spec, "", b""), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for pieces in lengths.spans(text):
                    seen.update(p for p in pieces if p is not None and len(p) <= LONGEST)
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(REPORTED)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    return run


def frequent_pieces(docs: DataFrame, spec: str, text: str = "text", most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, by the tasks' summaries; most of them at the most."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.length(text) > 0).select(text).mapInArrow(_summary(spec), "piece string, n long")
    best = rows.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    return [r["piece"] for r in best.collect()]


@shielded
def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, frequent: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows with __n_bytes, __n_tokens and __over_limit, by the tokenizer in the file at path (.json or .model).

    Counts are those of the library without begin, end or added special tokens; strings of special tokens in a text are
    what the library takes them for. The driver reads the file; tasks need it not. frequent names the pre-tokens of the
    table (of a corpus counted before); by default all texts are counted for it. The table changes no count.
    Tokenizers that don't drop white space, and those of .model files, encode whole texts, without a table.
    Null and empty texts have no tokens; long texts are counted in slices that end at white space; repeated rows are
    counted one by one; an empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        data = f.read()
    if str(path).endswith(".model"):
        counter = _pieces_of_model(data)
    else:
        spec = data.decode()
        lengths = Lengths(spec, {})
        if not lengths.whole and frequent is None:
            frequent = frequent_pieces(docs, spec, text)
        table = {p: lengths[p] for p in (frequent or [])[:FREQUENT] if not lengths.whole and 0 < len(p) <= LONGEST}
        table = {p: n for p, n in table.items() if n < 256 and not _SPACE.search(p)}
        counter = _counter(docs.sparkSession.sparkContext.broadcast((spec, " ".join(table), bytes(table.values()))))
    n = F.arrow_udf(counter, "long")(F.coalesce(F.col(text), F.lit("")))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    out = docs.select(*[F.col(f"`{c}`") for c in keep], size.alias("__n_bytes"), n.alias("__n_tokens"))
    return out.withColumn("__over_limit", F.col("__n_tokens") > limit)


def _counter(sent):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths = _lengths(*sent.value)
        for column in columns:
            yield pa.array([lengths.count(t) for t in column.to_pylist()], pa.int64())

    return run


def _pieces_of_model(data: bytes):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        for column in columns:
            yield pa.array([len(model.encode(t, num_threads=1)) for t in column.to_pylist()], pa.int64())

    return run
