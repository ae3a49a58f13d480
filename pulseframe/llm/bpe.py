"""Byte-pair encoding with word ends, and decoding.

Per distinct piece of text: symbols form a doubly linked list, a priority queue holds the
merges that are possible by rank and place, entries whose symbols have changed meanwhile are
skipped.  Decoding concatenates vocabulary strings.  Text is prepared as the tokenizer file
says: NFC, white space, lower case, split by the file's pattern, bytes as printable
characters.  Pieces repeat, so each worker keeps a bounded cache of the pieces it has seen.

Results: null and empty texts have no ids and an empty decoded text; every row keeps its
place, repeated rows give repeated results; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm.common import Memo, by_batch, prepare, text_or_empty

# Characters that Python's str.split() takes for white space and Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANK = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable character standing for each byte: itself where Latin-1 prints it, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class MergeList:
    """The merges of a vocabulary, applied to the symbols of one piece."""

    def __init__(self, ranked: list[tuple[int, int, int]]):
        """``ranked``: left, right and merged symbol of each merge, in order of rank."""
        # One integer per pair of symbols, and per queue entry, keeps look-ups and comparisons short.
        self.merges = {a << 32 | b: rank for rank, (a, b, _) in enumerate(ranked)}
        self.made = [m for _, _, m in ranked]

    def apply(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        if n < 2:
            return symbols
        look, made = self.merges.get, self.made
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []  # rank and place in one number
        for i in range(n - 1):
            rank = look(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = right[i]
            # Stale: the symbol was swallowed, is the last, or has another partner now.
            if symbols[i] < 0 or j < 0 or look(symbols[i] << 32 | symbols[j]) != rank:
                continue
            new = symbols[i] = made[rank]
            symbols[j] = -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                rank = look(new << 32 | symbols[k])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = left[i]
            if h >= 0:
                rank = look(symbols[h] << 32 | new)
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]


class WordBpe:
    """One tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = MergeList([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.pieces = Memo(lambda pieces: [self.merge_piece(p) for p in pieces])
        self.words = Memo(self.encode_words)

    def merge_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        return self.merges.apply([*(self.inner[b] for b in data[:-1]), self.final[data[-1]]])

    def encode_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        split = [self.pattern.findall(w) for w in words]
        distinct = list({p for pieces in split for p in pieces})
        coded = dict(zip(distinct, self.pieces.values(distinct)))
        out = []
        for pieces in split:
            ids = [i for p in pieces for i in coded[p]]
            out.append((np.array(ids, "<u4").tobytes(), " ".join([self.strings[i] for i in ids])))
        return out

    @staticmethod
    def normalize(text: str) -> str:
        if not text.isascii():
            # Lower case letter by letter: a final sigma has no form of its own here.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text that decoding them gives."""
        ids, strings = [], []
        parts = self.special_pattern.split(text) if self.special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
                strings.append(part)
                continue
            part = self.normalize(part)
            words = [w for w in BLANK.split(part) if w] if SEPARATORS.search(part) else part.split()
            found = self.words.values(words)
            ids.extend([f[0] for f in found])
            strings.extend([f[1] for f in found if f[1]])
        return b"".join(ids), " ".join(strings)

    def decode(self, ids: bytes) -> str:
        return " ".join([self.strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded``: ids of each whole text as little-endian 32-bit integers and their decoded text."""
    prepare(docs.sparkSession)

    def run(columns):
        model = load(path)
        coded = [model.encode(t) for t in columns["t"]]
        return {"k": columns["k"], "ids": [c[0] for c in coded], "decoded": [c[1] for c in coded]}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return by_batch(rows, run, f"k {kind}, ids binary, decoded string").withColumnRenamed("k", key)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    return coded.select(key, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as token count and digests."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))
