"""Problem 6: the ids of every text in a public byte-level BPE vocabulary.

The words of a batch that were not seen before are walked in sorted order, which is the depth-first
order of their trie: what two neighbours share as a prefix is encoded once. Each trie node keeps only
the last token of the encoding of its prefix; the rest of that encoding is the encoding of the node
where this token begins. The last token of a prefix is the one suffix token that the merges of the
vocabulary leave beside the last token of what precedes it.

The work is per row, so the operator adds no shuffle; the trie's finished words stay with the Python
worker from batch to batch, up to `CACHE_WORDS` words (memory only: a word beyond that is encoded again).
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges of byte_bpe_50k.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
CACHED_LENGTH = 64


class TrieEncoder:
    """Encodes words of one vocabulary; holds tables of the vocabulary's size and a bounded word cache."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.split = regex.compile(SPLIT_PATTERN).findall
        self.rank = ranks
        self.length = [0] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)
        self.children: dict = {}
        for piece, rank in ranks.items():
            node = self.children
            for byte in reversed(piece):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(piece) > 1:
                left, right = self._last_merge(piece, rank)
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def _last_merge(self, piece: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one: what the merges below its rank leave of its bytes."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best = min((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1], rank)) < rank)
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undo the younger of the two, again and again; if the two that meet at the border would have merged
        before the part that was undone came to be, the border does not survive.
        """
        key = (left, right)
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        limit = len(self.length)
        merged, parts = self.merged, self.parts
        ok = True
        while True:
            together = merged.get((left, right))
            if together is not None and together < limit:
                ok = False
                break
            if left > right and left in parts:
                limit, left = left, parts[left][1]
            elif right in parts:
                limit, right = right + 1, parts[right][0]
            elif left in parts:
                limit, left = left, parts[left][1]
            else:
                break
        if len(self.pair_ok) > 2_000_000:
            self.pair_ok.clear()
        self.pair_ok[key] = ok
        return ok

    def _extend(self, word: bytes, last: list[int], end: int) -> None:
        """Append to `last` the last token of the encoding of word[:end]."""
        node, start, fits = self.children, end, []
        while start:
            node = node.get(word[start - 1])
            if node is None:
                break
            start -= 1
            token = node.get(-1)
            if token is not None:
                fits.append((start, token))
        for start, token in reversed(fits):
            if not start or self._neighbours(last[start - 1], token):
                last.append(token)
                return
        raise ValueError(f"the vocabulary has no token for byte {word[end - 1]}")

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """The encodings of distinct words, by one depth-first walk over their trie."""
        out: dict[str, list[int]] = {}
        before: bytes = b""
        last: list[int] = []
        for word, text in sorted((w.encode("utf-8", "replace"), w) for w in words):
            whole = self.rank.get(word)
            if whole is not None:
                out[text] = [whole]
                continue
            shared = len(os.path.commonprefix((before, word)))
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                self._extend(word, last, end)
            before, at, ids = word, len(word), []
            while at:
                ids.append(last[at - 1])
                at -= self.length[last[at - 1]]
            ids.reverse()
            out[text] = ids
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Null and empty texts have no ids."""
        split, known = self.split, self.words
        parts = [split(text) if text else [] for text in texts]
        new = {w for words in parts for w in words if w not in known}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = {w for words in parts for w in words}
        found = self.learn(list(new))
        long = {w: ids for w, ids in found.items() if len(w) > CACHED_LENGTH}
        known.update((w, ids) for w, ids in found.items() if len(w) <= CACHED_LENGTH)
        out = []
        for words in parts:
            ids: list[int] = []
            for w in words:
                ids += known.get(w) or long[w]
            out.append(ids)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder for each Python worker, from a file of ranks."""
    with open(path, "rb") as lines:
        return TrieEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, keep_ids: bool = True
) -> DataFrame:
    """(id, ids), or (id, n_ids) where only the number is asked for: one row for each input row.

    Null and empty texts give an empty list (0). Repeated rows stay repeated; other columns are not read.
    No shuffle. The file of ranks goes from the driver to all executors.
    """
    docs.sparkSession.sparkContext.addFile(os.path.join(tokenizer_dir, RANKS_FILE))
    field = T.StructField("ids", T.ArrayType(T.IntegerType()), False) if keep_ids else T.StructField("n_ids", T.IntegerType(), False)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType, True), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(RANKS_FILE))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            step = 512
            for at in range(0, len(texts), step):
                ids = enc.encode_batch(texts[at : at + step])
                values = pa.array(ids, pa.list_(pa.int32())) if keep_ids else pa.array([len(x) for x in ids], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), values], names=[id_col, field.name])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
