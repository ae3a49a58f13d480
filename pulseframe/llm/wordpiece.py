"""Word-piece counts by linear longest match.

The vocabulary is a trie; a failure link leads from a node to the node where matching goes on
after the longest pieces of the node's string have been popped, and the number of pieces popped
is stored with the link.  One pass over a word's letters then gives the number of pieces that
greedy longest-match-first would cut, without building any.  A word that can't be cut counts as
one unknown piece.

Words are runs of anything but white space.  Null and empty texts have zero words and pieces.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm.common import Memo, by_batch, prepare, text_or_empty

START = "▁"


class PieceCounter:
    """``first``: pieces that may begin a word; ``later``: pieces that may continue it."""

    def __init__(self, first: list[str], later: list[str]):
        # Node 0 begins a word, node 1 continues it.
        self.next: dict[tuple[int, str], int] = {}
        self.fail, self.pops = [-1, -1], [0, 0]
        parent, letter, ends = [-1, -1], ["", ""], set()
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.next.get((node, c))
                    if child is None:
                        child = self.next[node, c] = len(parent)
                        parent.append(node)
                        letter.append(c)
                    node = child
                if piece:
                    ends.add(node)
        children: list[list[int]] = [[] for _ in parent]
        for node in range(2, len(parent)):
            children[parent[node]].append(node)
        self.fail = [-1] * len(parent)
        self.pops = [0] * len(parent)
        level = [0, 1]
        while level:  # by depth: links lead to nodes of smaller depth
            below = [c for node in level for c in children[node]]
            for v in below:
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                u, c = parent[v], letter[v]
                at, popped = self.fail[u], self.pops[u]
                while at >= 0 and (at, c) not in self.next:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.pops[v] = self.next[at, c], popped
            level = below
        self.memo = Memo(lambda words: [self.count(w) for w in words])

    def count(self, word: str) -> int:
        """Number of pieces; -1 if the word can't be cut."""
        follow, fail, pops = self.next.get, self.fail, self.pops
        at, n = 0, 0
        for c in word:
            child = follow((at, c))
            while child is None:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
                child = follow((at, c))
            at = child
        while at > 1:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n

    def totals(self, text: str) -> tuple[int, int, int]:
        """Words, pieces, unknown words."""
        words = text.split()
        counts = self.memo.values(words)
        unknown = counts.count(-1)
        return len(words), sum(counts) + 2 * unknown, unknown


def sentence_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece file: those after the word mark may begin a word, the others continue one."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    first = [p[1:] for p in plain if p.startswith(START) and len(p) > 1]
    return first, [p for p in plain if START not in p]


@lru_cache(maxsize=4)
def load(path: str) -> PieceCounter:
    return PieceCounter(*sentence_pieces(path))


def count_pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_pieces, n_unknown`` of each whole text; an unknown word is one piece."""
    prepare(docs.sparkSession)

    def run(columns):
        model = load(path)
        words, pieces, unknown = zip(*[model.totals(t) for t in columns["t"]])
        return {"k": columns["k"], "n_words": words, "n_pieces": pieces, "n_unknown": unknown}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return by_batch(rows, run, f"k {kind}, n_words long, n_pieces long, n_unknown long").withColumnRenamed("k", key)


def op2_linear_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every document."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
