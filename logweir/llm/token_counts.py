"""Unigram token counts with dynamic programming shared along a trie.

Distinct pre-tokens are inserted in a trie that lives as long as its worker.  A
node holds the forward score of its prefix, so each prefix is scored once however
many pre-tokens share it, and a terminal node its pre-token's count.  A document's
count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import ensure_importable, quoted

MARK = "▁"  # stands before each pre-token in sentencepiece vocabularies
#: Nodes at which a worker's trie begins anew, which bounds its memory and changes no result.
NODES = 1_000_000


class UnigramTrie:
    """Best segmentations of pre-tokens under additive piece scores.

    A character that no piece covers is one token for each of its UTF-8 bytes,
    each with the score ``unknown``.  Equal scores go to fewer tokens.
    """

    def __init__(self, scores: dict[str, float], unknown: float | None = None, nodes: int = NODES):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = unknown if unknown is not None else min(scores.values(), default=0.0) - 10.0
        self.nodes = nodes
        self.computed = 0  # forward scores computed so far
        self.clear()

    def clear(self) -> None:
        """The root alone: its child by node and letter, forward score and tokens of each node, terminal counts by pre-token."""
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.ends: dict[str, tuple[int, float]] = {}

    def _forward(self, word: str, path: list[int]) -> tuple[float, int]:
        """Best score, and tokens, of the prefix of ``word`` one longer than those of the nodes on ``path``."""
        end, letter = len(path), word[len(path) - 1]
        scores, best = self.scores, None
        for start in range(max(0, end - self.longest), end):
            v = scores.get(word[start:end])
            if v is not None:
                s, t = self.score[path[start]] + v, self.tokens[path[start]] + 1
                if best is None or s > best[0] or (s == best[0] and t < best[1]):
                    best = s, t
        if letter not in scores:
            width = len(letter.encode("utf-8", "surrogatepass"))
            s, t = self.score[path[-1]] + width * self.unknown, self.tokens[path[-1]] + width
            if best is None or s > best[0] or (s == best[0] and t < best[1]):
                best = s, t
        self.computed += 1
        return best

    def insert(self, word: str) -> tuple[int, float]:
        """Terminal ``(tokens, score)`` of a pre-token; only nodes that are new are scored."""
        child, path = self.child, [0]
        for letter in word:
            node = child.get((path[-1], letter))
            if node is None:
                node = len(self.score)
                s, t = self._forward(word, path)
                child[path[-1], letter] = node
                self.score.append(s)
                self.tokens.append(t)
            path.append(node)
        return self.tokens[path[-1]], self.score[path[-1]]

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """``(pre-tokens, tokens, score)`` of each text."""
        out, ends = [], self.ends
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            for w in {w for w in words if w not in ends}:
                if len(self.score) > self.nodes:
                    self.clear()
                    ends = self.ends
                ends[w] = self.insert(MARK + w.decode("utf-8", "surrogatepass"))
            try:
                got = [ends[w] for w in words]
            except KeyError:  # the trie began anew within this text
                got = [ends.get(w) or self.insert(MARK + w.decode("utf-8", "surrogatepass")) for w in words]
            out.append((len(words), sum([g[0] for g in got]), float(sum([g[1] for g in got]))))
        return out


def rank_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log probabilities of pieces from the most frequent on, by Zipf's law: in proportion to ``1 / rank``, and one in all."""
    listed = list(pieces)
    total = math.log(sum(1 / (r + 1) for r in range(len(listed)))) if listed else 0.0
    return {p: -math.log(r + 1) - total for r, p in enumerate(listed)}


def piece_scores(model_path: str) -> dict[str, float]:
    """A unigram model of the ordinary pieces of a sentencepiece model.

    The scores of a merge model are places in the order of merges and no
    probabilities, so only that order counts, the first id of equal ones first.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
    return rank_scores(p.id_to_piece(i) for i in sorted(plain, key=lambda i: (-p.get_score(i), i)))


_tries: dict[str, UnigramTrie] = {}


def trie(model_path: str) -> UnigramTrie:
    """One to a worker process, kept between tasks."""
    if model_path not in _tries:
        _tries[model_path] = UnigramTrie(piece_scores(model_path))
    return _tries[model_path]


def token_counts(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and ``n_pretokens, n_tokens, score`` for each row.

    Null and empty texts have no tokens and score 0; very long texts are counted
    whole; segmentations of equal score go to fewer tokens; repeated rows each come
    back; an empty table gives no rows; other columns are not read and may have any
    name.  Nothing is shuffled: each worker has its trie, whose size is bounded
    without any effect on results.
    """
    ensure_importable(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"), *(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(model_path)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                found = t.count(b.column(0).to_pylist())
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], [*names, "n_pretokens", "n_tokens", "score"])

    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "n_pretokens long, n_tokens long, score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_pretokens", "n_tokens", "score")
