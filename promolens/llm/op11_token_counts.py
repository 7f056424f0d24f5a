"""Token counts by a two-tier lookup inside map tasks; no pre-token is shuffled.

A text is cut into pre-tokens by the vocabulary's own pattern, vectorised over code point classes. The first tier is
a compact hash table of the lengths (in tokens) of frequent pre-tokens, broadcast to the tasks; its size is fixed by
``TABLE``. What it lacks goes through a cache that each Python worker keeps across its tasks, and what the cache lacks
is encoded by the vocabulary's merges. The table is filled from an expected ``SAMPLE`` texts of the whole input. It
only decides where a length is looked up, never what it is.

Characters are classed by the tokenizers library itself, the rest of the normal form too wherever a text holds
characters beyond U+02FF. Special strings of the vocabulary count as one token, as the library counts them by default.

Null text and empty text have no tokens and no bytes. Every input row gives one row, repeated rows and null ids
included; an empty table gives no rows. Further columns are left out by the query; ``token_counts`` keeps them, and
replaces those named like its results.
"""

from __future__ import annotations

import collections
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm.hashed_sample import scored
from promolens.llm.keys import WIDTH, KeyTable, keys_of, spans
from promolens.llm.op4_bpe import byte_characters
from promolens.llm.staging import table
from promolens.llm.words import sliced, text_bytes

SAMPLE, TABLE, SAMPLE_TASKS = 4096, 1 << 16, 8
CACHE_WORDS, CACHE_WORD_BYTES = 200_000, 64
#: Texts with code points under this need no normal form but lower case; İ becomes two characters and is left out.
PLAIN = 0x300
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Contractions that the vocabulary's pattern takes as one pre-token.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


class PreTokens:
    """Pre-tokens and exact token counts of one vocabulary (``tokenizers`` JSON)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        self.model, self.normal, self.cut = tok.model, tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.marks = [s.encode() for s in special]
        self.stand_in = dict(enumerate(byte_characters()))
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(PLAIN)], np.uint32)
        self.cache: dict[bytes, int] = {}

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point, learned from the library when it is first seen."""
        out = self.kind[points]
        if (new := points[out == UNKNOWN]).size:
            for p in np.unique(new).tolist():
                c = chr(p)
                pair = self.cut("a" + c)
                if len(pair) == 1:
                    self.kind[p] = LETTER if pair[0][1][1] == 2 else SPACE
                else:
                    self.kind[p] = OTHER if len(self.cut(c + c)) == 1 else NUMBER
            out = self.kind[points]
        return out

    def pieces(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Strings free of special ones, the row of each, and the number of special strings by row."""
        data, off = text_bytes(column)
        body, n = data.tobytes(), len(off) - 1
        odd = data >= 0xCC
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        odd = np.diff(np.r_[0, np.cumsum(odd)][off]) > 0
        marked = any(m in body for m in self.marks)
        out, row, special = [], [], np.zeros(n, np.int64)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            parts = [body[a:b].decode()]
            if marked and any(m in body[a:b] for m in self.marks):
                parts = self.special.split(parts[0])
                special[i] = len(parts) // 2
                parts = parts[::2]
            out += map(self.normal, parts) if odd[i] else parts
            row += [i] * len(parts)
        return out, np.array(row, np.int64), special

    def spans(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all pieces in normal form; start and end of each pre-token, and its piece."""
        points = np.frombuffer("\n".join(pieces).encode("utf-32-le"), np.uint32)
        points = np.where(points < PLAIN, self.lower[np.minimum(points, PLAIN - 1)], points)
        kind = np.r_[self.kinds(points), np.uint8(SPACE)]
        fresh = kind != SPACE
        fresh[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        border = np.flatnonzero(fresh | (kind == SPACE))
        is_start = fresh[border]
        start, end = border[is_start], border[np.flatnonzero(is_start) + 1]
        self._contract(points, kind, start, end)
        full = start < end
        start, end = start[full], end[full]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.r_[0, np.cumsum(width)]
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        return data, at[start], at[end], np.searchsorted(ends, start, "right")

    @staticmethod
    def _contract(points, kind, start, end) -> None:
        """A lone apostrophe takes the ending after it."""
        lone = np.flatnonzero((points[start] == ord("'")) & (end - start == 1) & (kind[end] == LETTER))
        if not len(lone):
            return
        after = np.r_[points, np.zeros(2, points.dtype)]
        a, b = after[start[lone] + 1], np.where(end[lone + 1] - start[lone + 1] > 1, after[start[lone] + 2], 0)
        take = np.isin(a, [ord(c) for c in SHORT_ENDINGS]).astype(np.int64)
        for x, y in LONG_ENDINGS:
            take[(a == ord(x)) & (b == ord(y))] = 2
        end[lone] += take
        start[lone + 1] += take

    def length(self, word: bytes) -> int:
        return len(self.model.tokenize(word.decode("latin-1").translate(self.stand_in)))

    def missed(self, words: list[bytes]) -> list[int]:
        """Lengths by the worker's cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out = self.cache, []
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.length(w)
                if len(w) <= CACHE_WORD_BYTES:
                    cache[w] = n
            out.append(n)
        return out

    def counts(self, column, known: KeyTable) -> np.ndarray:
        """Tokens of each row."""
        pieces, row, total = self.pieces(column)
        if not pieces:
            return total
        data, start, end, piece = self.spans(pieces)
        n = np.zeros(len(start), np.int64)
        short = np.flatnonzero(end - start <= WIDTH)
        slot = known.find(*keys_of(data, start[short], end[short]))
        hit = slot >= 0
        n[short[hit]] = known.value[slot[hit]]
        todo = np.ones(len(start), bool)
        todo[short[hit]] = False
        todo = np.flatnonzero(todo)
        body = data.tobytes()
        n[todo] = self.missed([body[a:b] for a, b in zip(start[todo].tolist(), end[todo].tolist())])
        return total + np.bincount(row[piece], n, len(total)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def worker(spec: str) -> PreTokens:
    """One per vocabulary and Python worker, so the cache lives across tasks."""
    return PreTokens(spec)


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent(docs: DataFrame, spec) -> KeyTable:
    """The most frequent pre-tokens of sampled texts with their lengths; at most ``TABLE`` words from each task."""
    n = docs.count()
    share = docs.select("text").sample(withReplacement=False, fraction=min(1.0, SAMPLE / max(n, 1)), seed=11)

    def tally(batches):
        pre, seen = worker(spec.value), collections.Counter()
        for batch in batches:
            for a, b in sliced(batch):
                pieces, _, _ = pre.pieces(batch.slice(a, b - a).column("text"))
                if pieces:
                    data, start, end, _ = pre.spans(pieces)
                    short = end - start <= WIDTH
                    body = data.tobytes()
                    seen.update(body[x:y] for x, y in zip(start[short].tolist(), end[short].tolist()))
        best = seen.most_common(TABLE)
        yield pa.record_batch([pa.array([w for w, _ in best], pa.binary()), pa.array([c for _, c in best], pa.int64())], names=["word", "n"])

    total: collections.Counter = collections.Counter()
    for r in share.repartition(SAMPLE_TASKS).mapInArrow(tally, "word binary, n long").toLocalIterator():
        total[bytes(r["word"])] += r["n"]
    words = [w for w, _ in total.most_common(TABLE)]
    pre = worker(spec.value)
    return KeyTable(*keys_of(*spans(words)), np.array([pre.length(w) for w in words], np.uint8))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) of the column ``text``."""
    sc = docs.sparkSession.sparkContext
    spec = sc.broadcast(vocabulary_text(path))
    known = sc.broadcast(frequent(docs, spec))

    def work():
        pre, lengths = worker(spec.value), known.value
        return lambda part: [pa.array(pre.counts(part.column("text"), lengths), pa.int64())]

    return scored(docs, "n_tokens long", work)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_counts(spark, base: str, limit: int = 2048) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(docs, vocabulary()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
