"""Byte-level BPE over whole texts: batched numpy merge rounds, and decoding by one gather.

The pre-tokens of a slice of documents are looked up in a worker's cache; unseen ones are encoded together. Their
symbols lie in one flat array. A round finds the rank of every adjacent pair by binary search in the sorted pair
keys, takes the lowest-ranked pair of each word and merges all its places, left to right. Words without a
mergeable pair leave the batch.

The vocabulary file (``tokenizers`` JSON) is read on the driver; its tables, of the vocabulary's size, go to the
tasks as a broadcast. Null text encodes as empty; null ids decode to null. Special strings in a text become their
id. Ids without a token decode to nothing; bytes that are no UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.staging import table
from promolens.llm.words import sliced, text_bytes

CACHE_SYMBOLS, SLICE = 600_000, 1 << 19
#: The pre-tokenisation of the vocabulary, with letters L and other characters O.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?\p{N}+| ?O+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


@functools.cache
def load(path: str) -> dict:
    """Tables of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    stand_in = {c: b for b, c in enumerate(byte_characters())}
    token = [b""] * size
    for t, i in vocab.items():
        token[i] = bytes(stand_in[c] for c in t)
    for t, i in special.items():
        token[i] = t.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(key)
    lens = np.array([len(t) for t in token], np.int64)
    # characters of the regex module's letter class that are not assigned are no letters here
    import regex

    unassigned = "".join(c for c in map(chr, range(0x500, 0x110000)) if unicodedata.category(c) == "Cn")
    odd = "".join(regex.findall(r"\p{L}", unassigned))
    return {
        "size": size, "special": special, "byte": np.array([vocab[c] for c in byte_characters()], np.int32),
        "key": key[order], "rank": np.arange(len(pairs), dtype=np.int32)[order],
        "merged": np.array([vocab["".join(p)] for p in pairs], np.int32)[order],
        "bytes": np.frombuffer(b"".join(token), np.uint8), "len": lens, "at": np.cumsum(lens) - lens, "odd": odd,
    }


class Encoder:
    """Pre-tokens to ids, with a cache of bounded size."""

    def __init__(self, t: dict):
        import regex

        self.t = t
        plain = PATTERN.replace("L", r"\p{L}").replace("O", r"[^\s\p{L}\p{N}]")
        odd = regex.escape(t["odd"], special_only=False)
        full = PATTERN.replace("L", rf"[\p{{L}}--[{odd}]]").replace("O", rf"[[^\s\p{{L}}\p{{N}}]||[{odd}]]") if t["odd"] else plain
        self.plain, self.full = regex.compile(plain).findall, (lambda: regex.compile("(?V1)" + full).findall)
        self.special = regex.compile("(" + "|".join(map(regex.escape, t["special"])) + ")") if t["special"] else None
        self.clear()

    def clear(self) -> None:
        self.cache = {s: i for i, s in enumerate(self.t["special"])}
        self.pool = np.array(list(self.t["special"].values()), np.int32)
        self.len = np.ones(len(self.cache), np.int64)
        self.at = np.arange(len(self.cache), dtype=np.int64)

    def split(self, text: str, common: bool) -> list[str]:
        """Pre-tokens; ``common``: no character at or above U+0540."""
        if not common and callable(self.full) and self.full.__name__ == "<lambda>":
            self.full = self.full()
        find = self.plain if common else self.full
        if self.special is None or not self.special.search(text):
            return find(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else find(part)
        return out

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        ids, lens = merged(self.t["byte"][np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw], np.int64), self.t)
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words))))
        self.at = np.r_[self.at, len(self.pool) + np.cumsum(lens) - lens]
        self.len = np.r_[self.len, lens]
        self.pool = np.r_[self.pool, ids]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and their row offsets."""
        data, off = text_bytes(column)
        body = data.tobytes()
        words, count = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            part = self.split(body[a:b].decode(), not (data[a:b] >= 0xD5).any())
            words += part
            count.append(len(part))
        if len(self.pool) > CACHE_SYMBOLS:
            self.clear()
        new = list(set(words).difference(self.cache))
        if new:
            self.learn(new)
        i = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        ids = gathered(self.pool, self.at[i], self.len[i])
        ends = np.r_[0, np.cumsum(self.len[i])]
        return ids, ends[np.r_[0, np.cumsum(np.array(count, np.int64))]]


def gathered(pool: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenated pieces ``pool[at:at + len]``."""
    end = np.cumsum(lens)
    return pool[np.repeat(at - (end - lens), lens) + np.arange(end[-1] if len(end) else 0)]


def merged(sym: np.ndarray, lens: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Merge rounds over the words of ``lens`` symbols each; ids and their number per word, in order."""
    word = np.repeat(np.arange(len(lens)), lens)
    out_sym, out_word, none = [], [], np.iinfo(np.int32).max
    while len(sym):
        key = sym[:-1].astype(np.int64) * t["size"] + sym[1:]
        i = np.minimum(np.searchsorted(t["key"], key), len(t["key"]) - 1)
        able = (t["key"][i] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(able, t["rank"][i], none), none)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        best = np.repeat(np.minimum.reduceat(rank, first), size)
        done = best == none
        if done.any():
            out_sym.append(sym[done])
            out_word.append(word[done])
        hit = np.flatnonzero((rank == best) & ~done)
        # of overlapping places of a pair of equal symbols, every second one of a run
        start = np.r_[True, hit[1:] != hit[:-1] + 1] if len(hit) else np.zeros(0, bool)
        run = np.arange(len(hit)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(hit) else hit
        hit = hit[run % 2 == 0]
        sym = sym.copy()
        sym[hit] = t["merged"][i[hit]]
        keep = ~done
        keep[hit + 1] = False
        sym, word = sym[keep], word[keep]
    if not out_sym:
        return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
    word = np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return np.concatenate(out_sym)[order], np.bincount(word, minlength=len(lens))


def _appended(df: DataFrame, source: str, results: dict[str, T.DataType], work) -> DataFrame:
    """``work()(column) -> list of Arrow arrays`` of a slice as further columns; those of their names are replaced."""
    names = [c for c in df.columns if c not in results]
    fields = [T.StructField(f"result_{i}", kind) for i, kind in enumerate(results.values())]
    schema = T.StructType([T.StructField("rest", T.StructType([df.schema[c] for c in names])), *fields])
    packed = df.select(F.col(f"`{source}`").alias("source"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"))

    def run(batches):
        do = work()
        for batch in batches:
            for a, b in do.ranges(batch):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column("rest"), *do(part.column("source"))], names=schema.names)

    return packed.mapInArrow(run, schema).select(
        *[F.col(f"rest.`{c}`").alias(c) for c in names], *[F.col(f.name).alias(name) for f, name in zip(fields, results)])


def decoded(column: pa.Array, t: dict) -> pa.Array:
    """Texts of an array of id lists."""
    n = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten().fill_null(-1)).astype(np.int64)
    known = (flat >= 0) & (flat < t["size"])
    flat = np.where(known, flat, 0)
    lens = np.where(known, t["len"][flat], 0)
    data = gathered(t["bytes"], t["at"][flat], lens).tobytes()
    off = np.r_[0, np.cumsum(lens)][np.r_[0, np.cumsum(n)]]
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False))
    return pa.array([None if x else data[a:b].decode("utf-8", "replace") for x, a, b in zip(null, off[:-1].tolist(), off[1:].tolist())], pa.string())


class _Encode:
    def __init__(self, tables):
        self.encoder = Encoder(tables)

    def ranges(self, batch):
        return sliced(batch, "source", SLICE)

    def __call__(self, column) -> list[pa.Array]:
        flat, off = self.encoder.encode(column)
        return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))]


class _Decode:
    def __init__(self, tables):
        self.tables = tables

    def ranges(self, batch):
        n = np.asarray(batch.column("source").value_lengths().fill_null(0))
        total, a = np.r_[0, np.cumsum(n)], 0
        while a < len(n):
            b = min(len(n), max(a + 1, int(np.searchsorted(total, total[a] + SLICE, "right")) - 1))
            yield a, b
            a = b

    def __call__(self, column) -> list[pa.Array]:
        return [decoded(column, self.tables)]


class _Both(_Encode):
    def __call__(self, column) -> list[pa.Array]:
        ids, = super().__call__(column)
        return [ids, decoded(ids, self.encoder.t)]


IDS = T.ArrayType(T.IntegerType())


def _tables(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(load(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids`` (array of int)."""
    tables = _tables(df, path)
    return _appended(df, text, {ids: IDS}, lambda: _Encode(tables.value))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text`` of what ``ids`` stand for."""
    tables = _tables(df, path)
    return _appended(df, ids, {text: T.StringType()}, lambda: _Decode(tables.value))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass over the rows."""
    tables = _tables(df, path)
    return _appended(df, text, {ids: IDS, back: T.StringType()}, lambda: _Both(tables.value))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, base: str) -> DataFrame:
    path = vocabulary()
    docs = table(spark, base, "documents").select("doc_id", "text")
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
