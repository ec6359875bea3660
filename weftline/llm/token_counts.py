"""Token counts by a linear longest-match automaton (operator 3).

The pieces of a vocabulary form a trie over bytes. A node that cannot go on
with the next byte pops the longest pieces that are certain by then and falls
back to the node of what is left (its failure link); how many pieces are popped
is precomputed, so a word's greedy longest-match length is a sum of counts and
no piece is ever built. Transitions are closed, so each byte costs one lookup,
and all words of a batch advance together, one byte a step.

A word is read as the vocabulary's word-start mark followed by its bytes; a
byte without a piece counts as one token.

Defined cases: a null or empty text, or one of spaces only, has 0 words and 0
tokens; rows are judged alone, so repeated rows, extra columns and empty tables
need no care; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import _text
from weftline.llm._graph import table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
#: Words of more bytes go through the automaton one by one.
LANE_BYTES = 256


class Automaton:
    """Closed transitions `step`, popped counts `pops` and word ends `rest`."""

    def __init__(self, pieces: list[bytes], mark: bytes):
        words = {p for p in pieces if p} | {bytes([b]) for b in range(256)}
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for word in words:
            node = 0
            for byte in word:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][byte]
            whole[node] = True
        n = len(children)
        step, pops = np.zeros((n, 256), np.int32), np.zeros((n, 256), np.uint16)
        fail, lost = [0] * n, [0] * n  # where a node falls back to, and the pieces popped by that
        rest = np.zeros(n, np.int32)
        level = [0]
        for byte, child in children[0].items():
            step[0, byte] = child
        while level:
            below = []
            for node in level:
                if node:
                    step[node], pops[node] = step[fail[node]], pops[fail[node]] + lost[node]
                    rest[node] = rest[fail[node]] + lost[node]
                for byte, child in children[node].items():
                    if whole[child]:
                        fail[child], lost[child] = 0, 1
                    else:  # what stays unmatched after the parent's pops takes the byte too
                        fail[child], lost[child] = int(step[fail[node], byte]), lost[node] + int(pops[fail[node], byte])
                    below.append(child)
            for node in level:
                for byte, child in children[node].items():
                    step[node, byte], pops[node, byte] = child, 0
            level = below
        self.step, self.pops, self.rest = step.reshape(-1), pops.reshape(-1), rest
        self.start, popped = 0, 0
        for byte in mark:
            popped += int(self.pops[self.start * 256 + byte])
            self.start = int(self.step[self.start * 256 + byte])
        self.start_pops = popped

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy longest-match lengths of the words data[start:end]."""
        sizes = ends - starts
        counts = np.full(len(starts), self.start_pops, np.int64)
        order = np.argsort(-sizes, kind="stable")
        long = int(np.searchsorted(-sizes[order], -LANE_BYTES, "left"))
        for i in order[:long].tolist():
            node, popped = self.start, 0
            for byte in data[starts[i] : ends[i]].tolist():
                popped += int(self.pops[node * 256 + byte])
                node = int(self.step[node * 256 + byte])
            counts[i] += popped + int(self.rest[node])
        order = order[long:]
        node, first, got = np.full(len(order), self.start, np.int64), starts[order], np.zeros(len(order), np.int64)
        falling = -sizes[order]
        for k in range(int(-falling[0]) if len(order) else 0):
            live = int(np.searchsorted(falling, -k, "left"))
            at = node[:live] * 256 + data[first[:live] + k]
            got[:live] += self.pops[at]
            node[:live] = self.step[at]
        counts[order] += got + self.rest[node]
        return counts


def load_pieces(path: str) -> tuple[list[bytes], bytes]:
    """The pieces of a SentencePiece model as bytes, and its word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i).encode() for i in kept], "▁".encode()


@lru_cache(1)
def _automaton(path: str) -> Automaton:
    return Automaton(*load_pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word): longs, one row per document.

    `longest_word` is the largest number of tokens of a word. `vocabulary` is the
    path of a SentencePiece model that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        for batch, data, at in _text.groups(batches):
            starts, ends, of = _text.words(data, at)
            counts = automaton.count(data, starts, ends)
            total = np.concatenate(([0], np.cumsum(counts)))
            most = np.zeros(len(of) - 1, np.int64)
            filled = np.flatnonzero(of[1:] > of[:-1])
            if len(filled):
                most[filled] = np.maximum.reduceat(counts, of[filled])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": np.diff(of), "n_tokens": np.diff(total[of]), "longest_word": most})

    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, longest_word long")


def op3_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
